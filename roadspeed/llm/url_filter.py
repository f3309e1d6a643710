"""URL filters: domain rules first, then a logistic regression on character n-grams.

Host and path are cut into character n-grams (each tagged with its field), hashed
into a fixed number of features, and a logistic regression is fitted on a small
labelled URL table. URLs that no rule decides get the model's verdict.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules as (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Words of unwanted and of ordinary hosts, from which the labelled table is made.
UNWANTED = """casino poker slots jackpot bets betting lottery pills viagra pharma meds adult xxx porn sexy
dating cams escort spam seo-links link-farm backlinks ads adserver banner popup track clicks payday loans
cash-now crypto-win winner prize cheap replica free-money warez crack keygen torrent""".split()
ORDINARY = """library university school museum council government hospital charity theatre orchestra radio news
press journal weather wiki encyclopedia history science physics maths astronomy nature birds river mountain garden
recipes kitchen travel hiking cycling chess football music painting photos poems books archive letters family
teacher farmers engineering software docs forum blog maps transport market village church harbour""".split()


def labelled_rows() -> list[tuple[str, float]]:
    """(url, 1.0 unwanted or 0.0 ordinary): every word alone and in pairs, under paths that both labels share.

    Ordinary hosts are three times as frequent, as an unknown host is an ordinary one.
    """
    out = []
    for label, known, pairs in ((1.0, UNWANTED, 2), (0.0, ORDINARY, 6)):
        for k, word in enumerate(known):
            hosts = [word, f"www.{word}", f"blog.{word}"]
            hosts += [f"{word}-{known[(k + 5 * j) % len(known)]}" for j in range(1, pairs + 1)]
            hosts += [f"m.{known[(k + 7 * j) % len(known)]}{word}" for j in range(1, pairs + 1)]
            for j, host in enumerate(hosts):
                lang = ("en", "de", "fr", "es")[j % 4]
                out.append((f"http://{host}.test/{lang}/{(4099 * (j + 1)) % 9973}", label))
    return out


FEATURES = 1 << 14
SIZES = (3, 4, 5)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` with A-Z lower-cased, path up to ``?`` or ``#``; else both empty."""
    rule = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, rule, 1), UPPER, LOWER), F.regexp_extract(known, rule, 2)


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct (rule, verdict), or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Of rules of one length the one that sorts first is taken.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(text: Column, tag: str, size: int) -> Column:
    """All runs of ``size`` characters of ``^text$``, tagged with their field."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    # One parameter only: a second one, even with a default, would be given the element's position.
    return F.when(F.size(chars) >= size, F.transform(
        F.sequence(F.lit(1), F.size(chars) - (size - 1)),
        lambda i: F.concat(F.lit(tag), F.array_join(F.slice(chars, i, size), "")))).otherwise(F.array().cast("array<string>"))


def features(df: DataFrame, host: str, path: str, out: str, size: int = FEATURES) -> DataFrame:
    """Add hashed presence features of the character n-grams of host and path."""
    grams = F.concat(*[_grams(F.col(c), tag, k) for c, tag in ((host, "h"), (path, "p")) for k in SIZES])
    return HashingTF(inputCol="_grams", outputCol=out, numFeatures=size, binary=True).transform(
        df.withColumn("_grams", grams)).drop("_grams")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table: url, label (1.0 unwanted, 0.0 ordinary)."""
    return spark.createDataFrame(labelled_rows(), "url string, label double")


def fit(labelled: DataFrame, regularisation: float = 0.001, iterations: int = 60) -> LogisticRegressionModel:
    """Fit on a labelled URL table; it must hold both labels. One partition, as the table is small."""
    host, path = parts(F.col("url"))
    rows = features(labelled.coalesce(1).select(host.alias("host"), path.alias("path"), "label"), "host", "path", "x")
    return LogisticRegression(featuresCol="x", labelCol="label", regParam=regularisation, maxIter=iterations,
                              standardization=False).fit(rows.select("x", "label"))


def url_filter(df: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url",
               rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (the model's probability of unwanted).

    Null urls and urls without ``://`` have an empty host and path, so no rule
    fits and the model's answer for an empty address holds. Repeated rows are
    answered each on its own; other columns are ignored.
    """
    host, path = parts(F.col(url_col).cast("string"))
    rows = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = model.copy({model.getParam("probabilityCol"): "prob", model.getParam("predictionCol"): "guess",
                        model.getParam("rawPredictionCol"): "raw", model.getParam("featuresCol"): "x"})
    scored = known.transform(features(rows, "host", "path", "x"))
    rule = matched(F.col("host"), F.col("path"), RULES if rules is None else rules)
    return scored.select(
        F.col("id").alias(id_col), "host", "path", rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(F.col("guess") == 1.0, "block").otherwise("allow")).alias("verdict"),
        F.round(_second(F.col("prob")), 6).alias("score"))


def _second(vector: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)[1]
