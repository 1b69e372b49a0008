"""URL filter: host and path rules, and a logistic regression for the rest.

The model is a logistic regression on hashed character n-grams of host and path,
fitted with Spark's own trainer on a small labelled table of URLs. Its size is
bounded by ``buckets``; features are built with SQL functions and the model is
applied by Spark inside the JVM. Rules come first: the longest that fits decides.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.session import scratch_path

# A small labelled table, for use where no own one is given: hosts and paths of the
# kind that URL filters for text corpora reject, and ordinary ones.
_REJECTED = """
casino-royal.example.com/en/1840 lucky-casino.example.net/slots/ www.online-casino.example.org/es/720
casino-win-big.example.com/de/311.html poker-room.example.net/en/12 m.slots-jackpot.example.com/fr/408/
free-bets-today.example.org/odds best-bets.example.net/fr/66 www.bets-online.example.com/en/7305
sports-betting.example.org/de/52/ free-spins.example.net/casino win-cash-now.example.com/en/3.html
cheap-pills-shop.example.com/es/94 www.pills-online.example.net/order cheap-meds.example.org/en/2077/
m.discount-pills.example.com/de/44.html cheap-loans.example.net/fr/618 payday-cash.example.org/en/930
adult-videos.example.com/es/15/ www.adult-chat.example.net/de/1207 x-adult.example.org/en/18.html
blog.adult-x-tube.example.com/fr/563 hot-adult.example.net/live/ sex-cams.example.org/es/4410
spam-links.example.com/en/29 link-farm.example.net/de/871.html www.spam-blog.example.org/fr/9/
content-farm.example.com/es/3056 m.spam-offers.example.net/en/147 free-prizes.example.org/winner
ads-track.example.com/fr/250/ m.ads-click.example.net/en/81 www.track-ads.example.org/de/6402.html
big-bets.example.org/fr/66 free-pills.example.com/en/12 casino-online.example.org/de/52 bets4free.example.net/es/94
win-prizes.example.com/es/77 cheap-replica.example.net/en/5113/ adserver-track.example.org/fr/39
"""
_ACCEPTED = """
www.library.example.org/en/1840 blog.gardening.example.com/roses/ news.harbour.example.net/es/720
therapy.example.org/de/311.html www.theatre.example.com/en/12 m.weather.example.net/fr/408/
museum.example.org/history blog.thornbury.example.com/fr/66 www.reading.example.net/en/7305
station.example.com/de/52/ kitchen.example.org/recipes blog.another.example.net/en/3.html
www.nation.example.org/es/94 m.tidal.example.com/tables notes.hering.example.net/en/2077/
heritage.example.com/de/44.html blog.theses.example.org/fr/618 www.thinking.example.net/en/930
orient.example.com/es/15/ erosion.example.org/de/1207 www.enterprise.example.net/en/18.html
blog.estuary.example.com/fr/563 the-ordinary.example.org/birds/ m.stories.example.net/es/4410
www.teaching.example.com/en/29 ting.example.org/de/871.html blog.andover.example.net/fr/9/
school.example.com/es/3056 www.orchard.example.org/en/147 m.bridges.example.net/apples
poetry.example.com/fr/250/ www.hospital.example.org/en/81 health.example.net/de/6402.html
windmills.example.com/en/12 betsy.example.org/fr/66 drills.example.net/es/94 casting.example.org/de/52/
island.example.com/es/77 forests.example.net/en/5113/ m.rivers.example.org/fr/39
"""


@dataclass(frozen=True)
class UrlModel:
    """``buckets`` hashed n-grams of ``sizes`` characters; reject from ``reject_from``."""

    buckets: int = 1 << 14
    sizes: tuple[int, ...] = (3, 4, 5)
    ridge: float = 0.003
    reject_from: float = 0.5


def default_labels(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, label (1 rejects)."""
    rows = [("http://" + u, 1.0) for u in _REJECTED.split()] + [("http://" + u, 0.0) for u in _ACCEPTED.split()]
    return spark.createDataFrame(rows, "url string, label double")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def _grams(value: Column, sizes: tuple[int, ...], mark: str) -> Column:
    """Distinct character n-grams of a value between bounds, marked by where they are from."""
    bounded = F.concat(F.lit("^"), value, F.lit("$"))
    runs = [
        F.when(
            F.char_length(bounded) >= size,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.char_length(bounded) - (size - 1), F.lit(1))),
                lambda at: F.concat(F.lit(mark), F.substring(bounded, at, size)),
            ),
        ).otherwise(F.array().cast("array<string>"))
        for size in sizes
    ]
    return F.concat(*runs)


def features(urls: DataFrame, host: Column, path: Column, model: UrlModel) -> DataFrame:
    """``urls`` with a vector column ``_url_features``.

    Digits of the path count as one character: page numbers say nothing of a page.
    """
    path = F.regexp_replace(path, "[0-9]+", "0")
    grams = F.array_distinct(F.concat(_grams(host, model.sizes, "h"), _grams(path, model.sizes, "p")))
    hashing = HashingTF(
        numFeatures=model.buckets, binary=True, inputCol="_url_grams", outputCol="_url_features"
    )
    return hashing.transform(urls.withColumn("_url_grams", grams)).drop("_url_grams")


def train(labelled: DataFrame, model: UrlModel = UrlModel()) -> LogisticRegressionModel:
    """Fit on a small table of url and label (1 rejects); null labels are left out.

    The model is written to the shared folder and loaded back: a fitted one keeps its
    training summary and with it the session, which cannot be sent to executors.
    """
    rows = labelled.where(F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("label"))
    rows = features(rows, host_of(F.col("url")), path_of(F.col("url")), model).coalesce(1).cache()
    try:
        fitted = LogisticRegression(
            featuresCol="_url_features", labelCol="label", regParam=model.ridge, maxIter=60
        ).fit(rows)
    finally:
        rows.unpersist()
    path = scratch_path(labelled.sparkSession, "url-model")
    fitted.write().save(path)
    return LogisticRegressionModel.load(path)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    ``rules`` is a short policy list of (verdict, host/path): a rule fits its host
    and all subdomains when the path starts with the rule's path. Of equally long
    rules the first one listed wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    listed = sorted(enumerate(rules), key=lambda r: (len(r[1][1]), -r[0]))
    for _, (decision, text) in listed:  # the longest is applied last, and so first
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(
            path, F.lit(slash + rest)
        )
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def judge(
    urls: DataFrame,
    fitted: LogisticRegressionModel,
    rules: list[tuple[str, str]],
    model: UrlModel = UrlModel(),
    url: str = "url",
) -> DataFrame:
    """Adds host, path, rule, reject_probability and verdict (allow or block).

    A null url, or one without ``://``, has an empty host and path, which no rule
    fits and which are allowed without asking the model, as there is nothing to
    judge. Repeated rows are judged alike; an empty table stays empty. Columns of
    ``urls`` with the names added are replaced.
    """
    made = {"host", "path", "rule", "reject_probability", "verdict", "probability", "rawprediction", "prediction"}
    kept = [F.col(f"`{c}`") for c in urls.columns if c == url or c.lower() not in made]
    parts = urls.select(*kept, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    scored = fitted.transform(features(parts, F.col("host"), F.col("path"), model))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    reject = vector_to_array("probability")[1]
    by_model = F.when((F.col("host") != "") & (reject >= model.reject_from), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        *kept,
        "host",
        "path",
        rule.alias("rule"),
        reject.alias("reject_probability"),
        F.coalesce(verdict, by_model).alias("verdict"),
    )
