"""Hosts, paths and rules against a plain reading, and the model's verdicts."""

import re

from quietwire.llm import url_filter as U

URLS = ["https://www.a.EXAMPLE.org/en/196/", "http://example.org/es/1?x=/fr/", "http://sub.example.org/en/12", "http://example.org/en/2", "https://x.example.com/fr/9#t",
        "https://x.example.com/de/9", "https://com/de/", "http://notexample.com.evil/de/", "no scheme", None, "", "http://", "ftp://h?a=http://example.com/de/1", "HTTP://EXAMPLE.COM",
        "http://É.com/fr/é?q", "http://u:p@example.com:80/de/x", "https://spam-farm.example.net/en/3", "https://quiet.example.net/en/3", "https://www.library.example.org/en/99", "x" * 3000 + "://a.org/p"]


def plain(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")
    fits = [(len(rule), what, rule) for what, rule in U.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
    return host, path, *(max(fits)[2:0:-1] if fits else (None, None))


def test_rules_and_model(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string").selectExpr("*", "'x' as host", "'y' as label", "1 as _grams")
    rows = U.verdicts(pages, U.labelled_urls(spark)).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, action = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == (action or ("block" if r.block_probability >= 0.5 else "allow"))
    said = {URLS[r.page_id]: r.verdict for r in rows}
    assert said["https://spam-farm.example.net/en/3"] == "block" and said["https://www.library.example.org/en/99"] == "allow"
    assert U.verdicts(pages.limit(0), U.labelled_urls(spark)).count() == 0


def test_model_fits_its_table_and_carries_over_to_unseen_rows(spark):
    from pyspark.sql import functions as F

    table = U.labelled_urls(spark).withColumn("page_id", F.monotonically_increasing_id()).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(3)))
    right = 0
    for fold in range(3):
        judged = U.verdicts(table.where(f"fold = {fold}"), table.where(f"fold <> {fold}"), rules=()).join(table.select("page_id", "label"), "page_id")
        right += judged.where((F.col("verdict") == "block") == (F.col("label") == 1)).count()
    assert right >= 0.65 * table.count()  # unseen names: much better than a guess
    own = U.verdicts(table, table, rules=()).join(table.select("page_id", "label"), "page_id")
    assert own.where((F.col("verdict") == "block") == (F.col("label") == 1)).count() >= 0.97 * table.count()
