"""URL filters (operator 2); DataFrame functions only.

A rule (host, path) fits its host and all subdomains; the longest fitting rule decides.  All other URLs
are judged by a logistic regression on hashed character trigrams of host and path.  It is trained in dual
form: the labelled table is small, so the state is one coefficient per labelled URL, each step of the
gradient is an array expression over the matrix of trigram overlaps, and the bucket weights are one join
and sum at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
STEPS = 400
PENALTY = 0.05
#: Labelled URLs that are used at most (those of smallest md5).
MAX_LABELLED = 400

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

# The default labelled URLs; 1 means block.
ALLOWED = """
https://encyclopedia.example.org/wiki/Photosynthesis
https://library.example.edu/catalogue/history/4411
https://www.city-museum.example/en/exhibitions/2021
https://news.example.com/world/2020/05/12/report.html
https://docs.example.org/manual/install.html
https://blog.example.com/en/gardening-in-spring
https://recipes.example.com/soup/lentil
https://university.example.edu/courses/linguistics
https://www.weather.example/forecast/today
https://forum.example.org/thread/1182?page=2
https://science.example.net/articles/ocean-currents
https://health.example.org/guides/first-aid
https://travel.example.com/fr/paris/museums
https://www.example.org/about
https://magazine.example.com/de/kultur/theater.html
https://archive.example.org/letters/1890
https://school.example.edu/lessons/algebra/3
https://m.example.com/en/9897/
https://www.example.net/es/26123
https://books.example.com/review/33180.html
https://open-data.example.gov/statistics/population
https://parliament.example.gov/minutes/2019
https://music.example.org/composers/baroque
https://support.example.com/help/password
""".split()
BLOCKED = """
http://free-casino-bonus.example.com/slots/jackpot
http://xxx-porn-videos.example.net/watch/123
http://cheap-pills-viagra.example.biz/buy-now
http://win-poker-online.example.info/bet/casino
http://hot-sex-cams.example.tv/live
http://adult-dating-xxx.example.com/join
http://casino777.example.biz/free-spins
http://download-crack-keygen.example.ru/warez.exe
http://torrent-warez.example.to/crack/serial
http://viagra-cialis-pharmacy.example.com/order
http://payday-loans-fast.example.biz/apply-now
http://porn-tube.example.xxx/free-porn
http://click-win-prize.example.info/free-iphone
http://replica-watches-cheap.example.biz/buy
http://sexy-girls-cams.example.com/xxx
http://betting-odds-poker.example.net/casino/bonus
http://nude-celebs.example.tv/porn
http://spam-links.example.info/seo/backlinks-cheap
http://get-rich-quick.example.biz/bitcoin-bonus
http://slots-jackpot.example.com/bonus/free-casino
http://escort-service.example.net/sex
http://keygen-serials.example.ru/download-crack
http://weight-loss-pills.example.biz/cheap
http://xxx.example.xxx/porn/hot-sex
""".split()


def default_labels(spark: SparkSession) -> DataFrame:
    """(url, blocked) of the default labelled table."""
    return spark.createDataFrame([(u, 0) for u in ALLOWED] + [(u, 1) for u in BLOCKED], "url string, blocked int")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null or no ``://``: both empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def trigram_buckets(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Hash bucket of every trigram of ``<host>path$``."""
    codes = F.transform(F.split(F.concat(F.lit("<"), host, F.lit(">"), path, F.lit("$")), ""), lambda c: F.ascii(c).cast("bigint"))
    # Each step keeps the last two code points and appends the bucket of the three.
    return F.transform(
        F.arrays_zip(F.slice(codes, 1, F.size(codes) - 2).alias("a"), F.slice(codes, 2, F.size(codes) - 2).alias("b"),
                     F.slice(codes, 3, F.size(codes) - 2).alias("c")),
        lambda t: F.pmod(t["a"] * 73856093 + t["b"] * 19349663 + t["c"] * 83492791, F.lit(buckets)))


def _with_parts(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    here, there = url_parts(F.col(url))
    return df.withColumn(host, here).withColumn(path, there)


def train(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS, penalty: float = PENALTY) -> list[float]:
    """Weights of the buckets and, last, the bias; ``labelled`` has url and blocked (1 or 0; null: left out).

    At most ``MAX_LABELLED`` distinct URLs are used, so the driver gets ``buckets`` + 1 numbers and the
    matrix of overlaps has a bounded size.  Without labels all weights are 0.
    """
    rows = labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull()).groupBy("url").agg(
        F.max("blocked").cast("double").alias("y")).orderBy(F.md5("url"), "url").limit(MAX_LABELLED)
    grams = _with_parts(rows, "url", "host", "path").select(
        "url", "y", trigram_buckets(F.col("host"), F.col("path"), buckets).alias("grams"))
    cells = grams.select("url", "y", F.size("grams").alias("n"), F.explode("grams").alias("bucket")).groupBy(
        "url", "y", "n", "bucket").agg((F.count(F.lit(1)) / F.sqrt("n")).alias("x"))
    left, right = cells.alias("l"), cells.alias("r")
    overlap = left.join(right, F.col("l.bucket") == F.col("r.bucket")).groupBy(
        F.col("l.url").alias("one"), F.col("l.y").alias("y"), F.col("r.url").alias("two")).agg(
        F.sum(F.col("l.x") * F.col("r.x")).alias("k"))
    urls = rows.select(F.col("url").alias("two"))
    dense = rows.select(F.col("url").alias("one"), "y").join(urls, F.lit(True)).join(
        overlap.drop("y"), ["one", "two"], "left").groupBy("one", "y").agg(
        F.sort_array(F.collect_list(F.struct("two", F.coalesce("k", F.lit(0.0)).alias("k")))).alias("row"))
    state = dense.agg(F.sort_array(F.collect_list(F.struct("one", "y", "row"))).alias("rows"))
    pace = 1.0 / F.greatest(F.size("rows"), F.lit(1))
    start = F.transform("rows", lambda r: F.lit(0.0))

    def step(a: Column, _: Column) -> Column:
        def update(r: Column, i: Column) -> Column:
            fit = F.aggregate(F.zip_with(r["row"], a, lambda k, x: (k["k"] + 1.0) * x), F.lit(0.0), lambda s, v: s + v)
            own = F.get(a, i)
            return own + pace * (r["y"] - 1.0 / (1.0 + F.exp(-fit)) - F.lit(penalty) * own)
        return F.transform("rows", update)

    solved = state.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("alpha"))
    alphas = solved.select(F.explode(F.arrays_zip(F.col("rows.one").alias("url"), F.col("alpha").alias("alpha"))).alias("z")
                           ).select("z.url", "z.alpha")
    alphas = [(r["url"], r["alpha"]) for r in alphas.collect()]
    found = rows.sparkSession.createDataFrame(alphas, "url string, alpha double")
    sums = cells.join(found, "url").groupBy("bucket").agg(F.sum(F.col("x") * F.col("alpha")).alias("w"))
    weights = [0.0] * buckets
    for r in sums.collect():
        weights[r["bucket"]] = r["w"]
    return [*weights, sum(a for _, a in alphas)]


def blocked_odds(host: Column, path: Column, weights: list[float]) -> Column:
    """Log odds of being blocked."""
    table = F.split(F.lit(",".join(map(repr, weights[:-1]))), ",").cast("array<double>")
    grams = trigram_buckets(host, path, len(weights) - 1)
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table, g.cast("int")))
    return total / F.sqrt(F.greatest(F.size(grams), F.lit(1))) + F.lit(weights[-1])


def filter_urls(pages: DataFrame, rules: DataFrame, labelled: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``rules`` has host, path and verdict, ``labelled`` url and blocked.  Rules meet the suffixes of the
    distinct hosts in an equi-join; of the rules that fit a page the longest wins, then the greatest by
    code point, and block before allow if one rule is there twice.  Null URLs and URLs without ``://`` have
    an empty host and path and are judged by the regression.  Existing columns of the new names are
    replaced; repeated rows are judged each; no rows give no rows.
    """
    weights = train(labelled)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # The page travels as one struct, so that no column of it meets a name used here.
    parts = _with_parts(pages.select(F.struct(*kept).alias("page"), F.col(url).alias("url")), "url", "host", "path")
    labels = F.split("host", "\\.")
    suffixes = parts.select("host").distinct().select(
        "host", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("i"), labels.alias("labels")).select(
        "host", F.concat_ws(".", F.slice("labels", F.col("i"), F.size("labels"))).alias("suffix"))
    named = rules.select(F.col("host").alias("suffix"), F.struct(
        (F.length("host") + F.length("path")).alias("length"), F.concat("host", "path").alias("rule"),
        F.col("verdict"), F.col("path").alias("path")).alias("fit"))
    fits = suffixes.join(named, "suffix").groupBy("host").agg(F.collect_set("fit").alias("fits"))
    best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["path"])))
    judged = parts.join(fits, "host", "left").withColumn("best", best)
    method = F.when(blocked_odds(F.col("host"), F.col("path"), weights) > 0, "block").otherwise("allow")
    return judged.select("page.*", "host", "path", F.col("best.rule").alias("rule"),
                         F.coalesce(F.col("best.verdict"), method).alias("verdict"))
