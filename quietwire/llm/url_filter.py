"""URL filter: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

The host runs from the first ``://`` to the next ``/``, ``?``, ``#`` or the end and is lower-cased (A-Z); the path goes on to ``?``, ``#`` or the end.
A rule names a host (with all its subdomains) and the beginning of a path; of several that fit the longest decides. What no rule decides is judged
by the model, trained on a small labelled table of URLs.

N-grams of three to five characters of ``host + path`` are hashed to ``FEATURES`` places; digits count as one sign, so that page numbers carry no
weight. All of it is expressions over columns and a model of fixed size.

Cases: null URLs and URLs without ``://`` have an empty host and path, fit no rule and get the verdict of an empty input; very long URLs
take time in proportion to their length; repeated rows are judged one by one; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwire.llm.tables import literal_rows

FEATURES = 1 << 13
SIZES = (3, 4, 5)
#: Fixed values: (action, rule) of the query; a rule is a host and the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The labelled table: what a reviewer would block, and what not.
BLOCKED = (
    "http://cheap-pills.example.com/en/1", "https://www.cheap-pills.example.net/buy", "http://pills-online.test/offer", "https://discount-pharmacy.test/order",
    "https://free-bets.example.com/en/5", "http://m.free-bets.example.org/de/7", "https://casino-bonus.test/spin", "http://best-casino.test/free-spins",
    "https://slots-jackpot.test/win", "https://spam-farm.example.org/en/3", "http://www.spam-farm.example.com/fr/8", "http://link-farm.test/page/1",
    "https://seo-spam.test/links", "https://ads-track.example.org/en/4", "http://ads-track.example.net/es/2", "https://ad-tracker.test/click",
    "http://click-ads.test/banner", "https://track-pixel.test/p.gif", "http://adult-cams.test/live", "https://xxx-video.test/watch",
    "http://free-porn.test/clip", "https://malware-download.test/setup.exe", "http://cracked-software.test/keygen", "https://warez-download.test/full",
    "http://payday-loans.test/apply", "https://easy-cash-loans.test/now", "http://replica-watches.test/shop", "https://fake-bags.test/sale",
    "http://crypto-doubler.test/invest", "https://quick-money.test/join",
    "https://adult-chat.example.com/en/2", "http://www.adult-dating.example.net/fr/6", "https://adult-x-videos.test/all", "http://casino-games.example.com/de/9",
    "https://win-casino.example.org/en/11", "http://casino-win-big.test/play", "https://casino-royal.example.net/es/3", "http://adult-x.test/clips")
ALLOWED = (
    "https://www.library.example.org/en/12", "http://blog.garden.example.com/fr/3", "https://news.village.example.net/de/44", "https://m.weather.example.com/es/9",
    "http://school.example.org/en/history", "https://www.museum.test/collection/7", "http://recipes.test/soup.html", "https://docs.project.test/manual/install",
    "https://forum.cycling.test/thread/81", "http://www.university.test/research/paper.html", "https://cityhall.test/services", "https://travel-notes.test/alps/2",
    "http://therti.example.org/en/196/", "https://www.ththhe.example.com/en/773", "http://ththin.example.com/fr/92.html", "https://blog.ththan.example.net/de/503",
    "https://m.ththth.example.net/en/673/", "http://www.therer.example.com/fr/144.html", "https://theren.example.org/es/88", "http://blog.thonan.example.com/en/15",
    "https://science.test/articles/stars", "http://poetry.test/spring", "https://www.orchestra.test/season", "https://maps.test/rivers",
    "http://chess.test/openings/4", "https://health-office.test/advice", "http://bakery.test/bread", "https://www.parliament.test/minutes/3",
    "https://farm-museum.test/visit", "http://track-and-field.test/results")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones override
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path; any digits count as one ``0``."""
    text = F.concat(F.lit("^"), F.regexp_replace(F.concat(host, path), "[0-9]+", "0"), F.lit("$"))
    each = [F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - n + 1)), lambda i: text.substr(i, F.lit(n))))
            .otherwise(F.array().cast("array<string>")) for n in SIZES]
    return F.concat(*each)


def labelled_urls(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, ("url", "label"), [(u, 1.0) for u in BLOCKED] + [(u, 0.0) for u in ALLOWED])


def _vectors(urls: DataFrame) -> DataFrame:
    """``urls`` with host, path and the hashed n-grams as ``_vector``."""
    named = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    counted = named.withColumn("_grams", grams(F.col("host"), F.col("path")))
    return HashingTF(inputCol="_grams", outputCol="_vector", numFeatures=FEATURES, binary=True).transform(counted).drop("_grams")


def trained(labelled: DataFrame) -> LogisticRegressionModel:
    """Ridge logistic regression on (url, label); label 1 is to be blocked."""
    return LogisticRegression(featuresCol="_vector", labelCol="label", regParam=0.02, maxIter=100, standardization=False).fit(_vectors(labelled))


def verdicts(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_probability."""
    model = trained(labelled).setProbabilityCol("_probability").setPredictionCol("_prediction").setRawPredictionCol("_raw")
    judged = model.transform(_vectors(pages.select("page_id", "url")))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    chance = vector_to_array("_probability")[1]
    return judged.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(action, F.when(chance >= 0.5, "block").otherwise("allow")).alias("verdict"), chance.alias("block_probability"))
