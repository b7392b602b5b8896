"""URL filter: host and path rules, and logistic regression on hashed character n-grams.

Everything is DataFrame functions: hosts and paths are cut out by string functions,
n-grams of ``SIZES`` characters of host and path are hashed into ``BUCKETS``, and
the weights, learned by Spark's logistic regression from a small labelled URL
table, are looked up in an array literal. A rule decides where one fits, the
longest first; the model decides the rest.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and gets the model's verdict for empty strings; repeated rows are judged
each; an empty table is fine; columns that clash with the result's are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import cut

SIZES = (3, 4)
BUCKETS = 1 << 14
THRESHOLD = 0.5
ADDED = ("host", "path", "rule", "score", "verdict")
#: Actions and rules as host and path; a rule fits its host and all subdomains.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BAD = ("casino", "poker", "betting", "jackpot", "xxx", "adult", "camgirls", "escort", "pills", "viagra", "warez", "torrent", "keygen", "cracked", "cheapmeds", "payday", "lottery", "phish", "freeprize", "clickbait")
_GOOD = ("library", "museum", "science", "history", "garden", "recipes", "weather", "physics", "poetry", "archive", "school", "health", "travel", "music", "letters", "research", "docs", "journal", "nature", "news")
_PLAIN = [a + b for a in ("lor", "ven", "tam", "and", "wor", "bel", "the", "sur", "ing") for b in ("on", "er", "isa", "und", "able")]
_SCHEMES, _ENDINGS, _SECTIONS = ("http", "https"), ("com", "net", "org"), ("en", "de", "es", "fr")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table (url, bad): words of either kind in hosts and in paths.

    Schemes, endings, sections and numbers turn through both kinds alike, so only
    the words tell them apart; made-up names without either are not bad.
    """
    rows = []
    for bad, words in ((1, _BAD), (0, _GOOD)):
        for k, w in enumerate(words):
            scheme, ending, section = _SCHEMES[k % 2], _ENDINGS[k % 3], _SECTIONS[k % 4]
            rows += [
                (f"{scheme}://{w}.example.{ending}/{section}/{100 + 37 * k}", bad),
                (f"{scheme}://www.{w}site.example.{ending}/{section}/{200 + 41 * k}.html", bad),
                (f"{scheme}://blog.example.{ending}/{section}/{w}/{300 + 43 * k}?page=2", bad),
                (f"{scheme}://m.example.{ending}/{w}-{400 + 47 * k}/", bad),
                (f"{scheme}://best{w}s.example.{ending}/{section}/{500 + 53 * k}", bad),
                (f"{scheme}://shop.example.{ending}/{section}/my{w}24/", bad),
            ]
    for k, name in enumerate(_PLAIN):
        for j, (sub, tail) in enumerate((("", "/"), ("www.", ".html"), ("blog.", "?ref=x"), ("m.", "#top"), ("shop.", ""))):
            rows.append((f"{_SCHEMES[k % 2]}://{sub}{name}.example.{_ENDINGS[(k + j) % 3]}/{_SECTIONS[(k + j) % 4]}/{53 * k + 17 * j}{tail}", 0))
    return spark.createDataFrame(rows, "url string, bad int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _grams(text: Column, kind: str, n: int) -> Column:
    """The hashed n-grams of a text, none if it is shorter."""

    def hashed(i: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(kind), F.substr(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int")

    places = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(places, hashed)).otherwise(F.array().cast("array<int>"))


def features(host: Column, path: Column) -> Column:
    """The distinct hashed n-grams, those of host and of path apart."""
    marked = {kind: F.concat(F.lit("^"), part, F.lit("$")) for kind, part in (("h", host), ("p", path))}
    return F.array_distinct(F.concat(*[_grams(text, kind, n) for kind, text in marked.items() for n in SIZES]))


def train(urls: DataFrame, url: str = "url", bad: str = "bad") -> tuple[list[float], float]:
    """Weights by bucket and intercept from labelled URLs; all zero if only one kind is there."""
    host, path = host_and_path(F.col(url))
    rows = cut(urls.where(F.col(bad).isin(0, 1)).select(F.col(bad).cast("double").alias("label"), features(host, path).alias("f")), "urls")
    if rows.select("label").distinct().count() < 2:
        return [0.0] * BUCKETS, 0.0
    to_vector = CountVectorizerModel.from_vocabulary([str(k) for k in range(BUCKETS)], inputCol="f", outputCol="features", binary=True)
    data = to_vector.transform(rows.select("label", F.col("f").cast("array<string>").alias("f")))
    model = LogisticRegression(regParam=0.0001, maxIter=100, standardization=False).fit(data)
    return [float(w) for w in model.coefficients], float(model.intercept)


def judge(pages: DataFrame, model: tuple[list[float], float], rules: tuple[tuple[str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """Rows and columns of ``pages`` with host, path, rule, score and verdict (allow or block)."""
    weights, intercept = model
    table = F.split(F.lit(",".join(f"{w:.5g}" for w in weights)), ",").cast("array<double>")
    host, path = host_and_path(F.col(url))
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        of, slash, rest = text.partition("/")
        fits = ((F.col("host") == of) | F.endswith(F.col("host"), F.lit(f".{of}"))) & F.startswith(F.col("path"), F.lit(slash + rest))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    margin = F.aggregate(features(F.col("host"), F.col("path")), F.lit(intercept), lambda total, f: total + F.element_at(table, f + 1))
    base = pages.drop(*ADDED)
    return (
        base.withColumns({"host": host, "path": path})
        .withColumns({"rule": rule, "action": action, "score": F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))})
        .withColumn("verdict", F.coalesce("action", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")))
        .select(*base.columns, *ADDED)
    )
