"""Word lists, patterns and constants that decide results.

Every list here is data, not logic.  Order is significant where a list feeds an
alternation (the first alternative that fits wins).
"""

# --- Fixed values: language indicators (each stands between word boundaries) ---
FRENCH_PHRASES = [
    r"je\s+veux", r"je\s+voudrais", r"je\s+souhaite", r"aller\s+[aà]", r"partir\s+de",
    r"prendre\s+le\s+train", r"en\s+passant\s+par", r"jusqu['\s]?[aà]",
    "je", "voudrais", "veux", "souhaite", "aller", "prendre", "partir", "voyager",
    "un", "une", "le", "la", "les", "du", "des", "bonjour", "merci",
    r"s'il\s+vous\s+pla[iî]t", "vers", "puis", "direction", "qu[ei]", "c'?est", "faut",
    "pour", "depuis", "comment", "quand", "euh", "ben", "bah",
]
ENGLISH_PHRASES = [
    r"I\s+want\s+to", r"I\s+would\s+like", r"I['\s]d\s+like", r"from\b.*\bto",
    r"going\s+to", r"travel\s+to", r"ticket\s+to", r"get\s+to",
    "I", "want", "would", "like", "please", r"thank\s+you", "how", "what", "where", "when",
    "the", "this", "that", "can", "could", "will", "do", "does", "am", "are", "is",
    "my", "your", "me", "you", "travel", "train", "station",
]
OTHER_PHRASES = [
    "quiero", r"me\s+gustar[ií]a", r"un\s+billete", "hola", "gracias", r"por\s+favor",
    "d[oó]nde", "cu[aá]ndo",
    r"ich\s+m[oö]chte", r"ein\s+zug", "fahrkarte", r"guten\s+tag", "danke", "bitte", "wo",
    "wann", "nach",
    "vorrei", r"un\s+biglietto", "ciao", "buongiorno", r"per\s+favore", "dove", "quando",
]
FRENCH_TIE_WORDS = ["je", "voudrais", "veux", "aller", "prendre"]

# --- Fixed values: trip indicators (each stands between word boundaries) ---
TRIP_PHRASES = [
    "aller", "voyager", "partir", r"prendre\b.*\btrain", "train", "billet", "trajet", "route",
    "depart", "destination", "direction", r"jusqu['\s]?[aà]", "depuis", "vers",
    r"de\b.*\b[aà]", r"puis\b.*\bpuis", "via", r"en\s+passant\s+par",
    "travel", "ticket", r"from\b.*\bto", r"going\s+to", r"get\s+to", r"I\s+want\s+to\s+go",
    r"I\s+would\s+like\s+to\s+go",
    r"quiero\s+ir", "viajar", "billete", r"desde\b.*\bhasta",
    "fahren", "reisen", "fahrkarte", r"von\b.*\bnach",
    r"vorrei\s+andare", "viaggiare", "biglietto", r"da\b.*\ba",
]

# --- Fixed values: slot patterns ---
THREE_STOPS = r"^(.+?)\s+puis\s+(.+?)\s+puis\s+(.+?)$"
DE_A = (
    r"(?:de|depuis|au\s+depart\s+de)\s+(.+?)\s+(?:[aà]|vers|direction|pour|jusqu['\s]?[aà])\s+(.+?)"
    r"(?:\s*[,.]|\s+(?:en\s+passant|via|demain|ce\s+soir|pour)|$)"
)
A_DEPUIS = r"[aà]\s+(.+?)\s+(?:depuis|en\s+partant\s+de)\s+(.+?)(?:\s*[,.]|$)"
VERS = r"^(.+?)\s+(?:vers|direction|-|puis)\s+(.+?)(?:\s*[,.]|$)"
FROM_TO = (
    r"(?:from)\s+(.+?)\s+(?:to|towards|for)\s+(.+?)"
    r"(?:\s*[,.]|\s+(?:via|through|stopping|tomorrow|tonight|please)|$)"
)
X_TO_Y = r"^(.+?)\s+(?:to)\s+(.+?)(?:\s*[,.]|$)"
VIA_FR = (
    r"(?:via|en\s+passant\s+par|avec\s+(?:un\s+)?arr[eê]t\s+[aà]|puis)\s+(.+?)"
    r"(?:\s+(?:puis|et)|$)"
)
VIA_EN = r"(?:via|through|stopping at|with a stop at)\s+(.+?)(?:\s+(?:and|then)|$)"
PART_DELIMITERS = r"[-,;:]|\bpuis\b|\bvia\b|\bet\b"
PART_PREFIX = (
    r"^(?:de|du|des|le|la|les|un|une|à|a|au|aux|en|pour|vers|direction|depuis|jusqu['\s]?[aà])\s+"
)
MENTION_TAIL_PUNCTUATION = r"[,.:;!?]+$"
MENTION_ARTICLE = r"^(?:le|la|les|un|une|du|de la|de l'|d'|l'|the|a|an)\s+"
MENTION_TAIL_WORDS = (
    r"\s+(?:demain|aujourd'hui|ce soir|s'il vous plait|svp|tomorrow|today|tonight|please)$"
)
PART_STOPWORDS = (
    "je tu il elle nous vous ils elles "
    "le la les un une des de du au aux a à et ou mais donc car ni or "
    "pour par sur sous avec sans dans en "
    "aller prendre partir voyager veux voudrais train billet trajet gare direction vers demain "
    "aujourd'hui soir matin ce cette comment quel quelle est sont avoir être puis via passant "
    "arret correspondance bonjour merci s'il plait "
    "i you he she we they it the an to from for of in on at by "
    "want would like need going travel go get take ticket station trip journey "
    "tomorrow today tonight please how what which where when"
).split()

# --- Fixed values: transcript artifacts ---
ARTIFACT_MARKERS = [
    "[coupure]", "[bruit]", "[musique]", "[silence]", "[annonce]", "[bruit de fond]",
    "[incomprehensible]", "*bruit*", "[Musique]", "[Applaudissements]", "[interruption]",
    "[rire]", "[rires]", "[toux]", "[inaudible]", "[static]", "[noise]", "[music]", "[cut]",
    "[applause]", "[???]", "[background noise]", "[Music]", "[Applause]", "[laughter]",
    "[cough]", "[incompréhensible]", "[unintelligible]",
]
ARTIFACT_PATTERNS = [r"\[.*?\]", r"\*[^*]+\*", r"\.{3,}", r"-{3,}", r"_{3,}", r"…+"]

# --- Fixed values: text cleaning ---
APOSTROPHES = "ʼˈ´`"
DASHES = "–—−‐‑⁃"

# --- Fixed values: station names ---
CITY_SUFFIXES = [
    r"\s+tgv$", r"\s+ville$", r"\s+gare\s+de\s+\w+$", r"\s+gare\s+du\s+\w+$", r"\s+st\s+\w+$",
    r"\s+grand\s+cormier$", r"\s+country\s+club$", r"\s*\(intramuros\)$",
]
STATION_ALIASES = {
    "paris gare de lyon": ["paris lyon", "gare de lyon"],
    "paris gare du nord": ["paris nord", "gare du nord"],
    "paris gare de l est": ["paris est", "gare de l est"],
    "paris gare saint lazare": ["paris st lazare", "saint lazare"],
    "paris gare montparnasse": ["paris montparnasse", "montparnasse"],
    "paris gare d austerlitz": ["paris austerlitz", "austerlitz"],
    "aeroport charles de gaulle 2 tgv": ["cdg", "roissy", "charles de gaulle"],
    "aeroport charles de gaulle 1": ["cdg 1", "roissy 1"],
    "lyon part dieu": ["lyon", "part dieu"],
    "lyon perrache": ["perrache"],
    "marseille st charles": ["marseille", "saint charles"],
    "bordeaux st jean": ["bordeaux", "saint jean"],
    "lille flandres": ["lille"],
    "lille europe": ["lille europe tgv"],
}
TRANSFER_HUBS = ["Paris", "Lyon", "Lille", "Marseille", "Bordeaux", "Nantes"]
KEPT_HUBS = ["Paris", "Lyon", "Lille", "Bordeaux", "Marseille"]
MENTION_BOUNDARY_CHARS = " .,;:!?()[]{}\"'\t\n-"
VIA_KEYWORDS = ["via", "par", "passant par", "en passant par", "arret"]

# --- Fixed values: generated-output parsing ---
OUTPUT_EMPTY_WORDS = ["aucun", "none", "n/a", ""]
OUTPUT_LABELS = {
    "voyage": "TRIP", "pas_voyage": "NOT_TRIP", "pas_francais": "NOT_FRENCH",
    "inconnu": "UNKNOWN", "pas voyage": "NOT_TRIP", "pas francais": "NOT_FRENCH",
}

# --- Fixed values: sentence codes ---
FRENCH_SENTENCE_WORDS = (
    "je de du des le la les un une pour dans en au aux et ou mais que qui ce cette mon ma mes ton "
    "sa ses nous vous ils elles est sont suis veux voudrais souhaite peux faut "
    "aller partir prendre avoir faire"
).split()
TRIP_SENTENCE_WORDS = [
    "aller", "billet", "train", "trajet", "voyage", "voyager", "partir", "gare", "destination",
    "depart", "reserve", "horaire", "direct", "correspondance", "tgv", "ter", "aller-retour",
    "simple", "rendre", "emmene", "amene", "direction", "vers", "depuis",
]
