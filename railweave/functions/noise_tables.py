"""Word lists, rewrite tables and probabilities of the noise model.

All tables are data that decide which noisy texts can appear; the order of a rewrite
table is the order in which its rules are tried.
"""

# --- Fixed values: probabilities of each step, per intensity -----------------------
STEPS = [
    "filler_words", "false_starts", "repetitions", "incomplete", "phonetic_confusion",
    "station_misspelling", "punctuation_errors", "capitalization_errors", "number_format",
    "code_switching", "hallucinations", "noise_artifacts", "accent_variations", "homophones",
]
PROFILES = {
    "clean": [0.0] * 14,
    "light": [0.10, 0.05, 0.03, 0.01, 0.05, 0.05, 0.15, 0.20, 0.05, 0.01, 0.005, 0.02, 0.03, 0.05],
    "moderate": [0.15, 0.08, 0.05, 0.03, 0.10, 0.12, 0.20, 0.25, 0.08, 0.02, 0.015, 0.05, 0.06, 0.08],
    "heavy": [0.25, 0.15, 0.10, 0.08, 0.20, 0.20, 0.35, 0.40, 0.15, 0.05, 0.03, 0.10, 0.12, 0.15],
}
# share of TRIP rows per intensity, as upper ends of a uniform draw
INTENSITY_ENDS = [("clean", 0.20), ("light", 0.60), ("moderate", 0.90), ("heavy", 1.0)]

# --- Fixed values: inserted words ----------------------------------------------------
FILLERS = ["euh", "hum", "hmm", "ben", "bah", "alors", "enfin", "donc", "voila", "tu vois",
           "genre", "quoi", "en fait", "bon", "hein", "ouais"]
TRAINING_FILLERS = ["euh", "donc", "bon", "alors", "genre", "enfin", "bref", "hein"]
HALLUCINATIONS = [
    "Merci d'avoir regarde cette video.", "N'oubliez pas de vous abonner.",
    "Like and subscribe.", "Sous-titres par la communaute.", "Copyright 2024.",
    "Thanks for watching.", "[Musique]", "[Applaudissements]", "...",
    "Abonnez-vous a notre chaine.", "Rendez-vous sur notre site.", "Pour plus d'informations.",
]
MARKERS = ["[inaudible]", "[bruit]", "[musique]", "[annonce]", "...", "---", "[coupure]",
           "[static]", "*bruit*", "[incomprehensible]", "[???]", "[silence]"]
CUT_SUFFIXES = ["...", "---", " [coupure]", ""]
END_MARKS = ["", ".", ",", "..."]

# --- Fixed values: rewrite tables ------------------------------------------------------
FALSE_STARTS = {
    "Je veux": ["Je veux... enfin je voudrais"], "Je voudrais": ["Je... je voudrais"],
    "Je souhaite": ["Je sou... je souhaite"], "un train": ["un... un train"],
    "aller de": ["aller... de"], "aller a": ["aller... a"], "prendre": ["pren... prendre"],
    "partir de": ["partir... de"], "Un billet": ["Un... un billet"],
    "Bonjour": ["Bon... bonjour"],
}
PHONETIC_WORDS = {
    "train": ["trin", "tran", "trein", "traing"], "billet": ["bilet", "billait", "biyé"],
    "aller": ["allez", "aler", "haller", "ale"], "gare": ["gar", "guare", "garre"],
    "voyage": ["voyaje", "voiage", "voyag"], "voudrais": ["voudrai", "voudrait", "voudrè"],
    "partir": ["partire", "parti", "partiir"], "arriver": ["ariver", "arrivé", "arivé"],
    "prendre": ["prandre", "prendr", "prende"], "depuis": ["depui", "depuit", "depu"],
    "destination": ["destinacion", "destinassion"], "depart": ["depar", "dépar", "depard"],
}
PHONETIC_SOUNDS = {
    "an": ["en", "ant", "and"], "en": ["an", "ent", "ant"], "in": ["ain", "ein", "un", "aint"],
    "ain": ["in", "ein", "aint"], "on": ["ont", "ond"], "e": ["ai", "ais", "et"],
    "ai": ["e", "ais", "et", "ait"], "ais": ["ai", "ait", "e"], "er": ["e", "ez", "ais"],
    "ez": ["e", "er", "ais"], "s": ["ss", "c"], "ss": ["s", "c"], "c": ["s", "ss", "k"],
    "qu": ["c", "k", "q"], "k": ["c", "qu"], "ph": ["f"], "f": ["ph"], "ent": ["e", "an"],
    "ait": ["ai", "ais", "e"],
}
STATION_SOUNDS = {
    "Saint": ["Sain", "Sin", "Cent", "St"], "Sainte": ["Sainte", "Sinte", "Ste"],
    "Montparnasse": ["Monparnasse", "Montparnace", "Mon Parnasse", "Montparnass"],
    "Lyon": ["Lion", "Léon", "Lillon", "Lyons"], "Lille": ["Lil", "Lile", "Lilles", "Lill"],
    "Marseille": ["Marseye", "Marceille", "Marsei", "Marceil"],
    "Bordeaux": ["Bordo", "Bordau", "Bordeau", "Bordo"],
    "Toulouse": ["Toulouze", "Tolouse", "Toulous"],
    "Strasbourg": ["Strasbour", "Strassbourg", "Strasburg"], "Nantes": ["Nante", "Nant", "Nants"],
    "Nice": ["Nisse", "Nis", "Nices"], "Montpellier": ["Monpellier", "Montpelier", "Montpelié"],
    "Rennes": ["Renne", "Ren", "Renn"], "Grenoble": ["Grenobl", "Grennoble", "Grenobe"],
    "Dijon": ["Dijonn", "Dijons", "Digeon"], "Avignon": ["Avignion", "Avignonn", "Avignon TGV"],
    "-sur-": [" sur ", "sur", "-sûr-", " sûr "], "-les-": [" les ", "les", "-lès-", " lès "],
    "-la-": [" la ", "la", " La "], "-le-": [" le ", "le", " Le "],
    "Aeroport": ["Aéroport", "Aeroport", "Airoport"],
    "Charles de Gaulle": ["Charles De Gaulle", "CDG", "Charle de Gaulle"],
}
CODE_SWITCHES = {
    "Je veux": ["I want", "Je want"], "Je voudrais": ["I would like", "Je would like"],
    "aller": ["to go", "go", "aller to"], "un train": ["a train", "un train"],
    "s'il vous plait": ["please", "s'il vous please", "please s'il vous plait"],
    "billet": ["ticket", "billette"], "de": ["from"], "pour": ["for", "to"],
    "vers": ["to", "towards"], "gare": ["station", "gare station"],
    "merci": ["thank you", "merci beaucoup thank you"],
}
SOUTHERN = {"pain": ["pang", "paing"], "vin": ["vang", "ving"], "demain": ["demaing"],
            "bien": ["bieng"]}
NORTHERN = {"je": ["ch'"], "c'est": ["ch'est"], "ce": ["ch'"]}
HOMOPHONES = {
    "a": "à", "à": "a", "ou": "où", "où": "ou", "vers": "vert", "vert": "vers", "ce": "se",
    "se": "ce", "ces": "ses", "ses": "ces", "c'est": "sait", "sait": "c'est", "et": "est",
    "est": "et", "son": "sont", "sont": "son", "ont": "on", "on": "ont", "mes": "mais",
    "mais": "mes", "la": "là", "là": "la", "du": "dû", "sur": "sûr", "sûr": "sur",
    "notre": "nôtre", "votre": "vôtre",
}
NUMBER_WORDS = ["un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix",
                "onze", "douze", "treize", "quatorze", "quinze", "seize", "dix-sept", "dix-huit",
                "dix-neuf", "vingt"]
KEY_NEIGHBOURS = {
    "a": "zqs", "z": "aesq", "e": "zrds", "r": "etfd", "t": "rygf", "y": "tuhg", "u": "yijh",
    "i": "uokj", "o": "iplk", "p": "olm", "q": "azws", "s": "qdzxwe", "d": "sfxcer",
    "f": "dgcvrt", "g": "fhvbty", "h": "gjbnuy", "j": "hknui", "k": "jlmio", "l": "kmop",
    "m": "lkp", "w": "qsx", "x": "wsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhj",
}
