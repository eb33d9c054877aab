"""The pipeline's stages against brute force on a small corpus, and the registered queries against their SQL."""

import random
import re
from pathlib import Path

import pytest

import corpus_pipeline
from check_oracle import TABLES, rows_of
from quietwire.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def _folder(spark, tmp_path):
    rng = random.Random(1)
    good = [f"word{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(good) for _ in range(n))
    junk = lambda n: " ".join(f"{rng.choice(good)}***" for _ in range(n))
    rows = [(i, text(rng.randint(30, 120))) for i in range(160)] + [(200 + i, junk(rng.randint(30, 120))) for i in range(80)]
    near = rows[5][1].split()
    near[3] = "changed"
    item = text(30)
    rows += [(300, rows[4][1] + " \n"), (301, rows[4][1]), (302, " ".join(near)), (303, text(40) + " " + item + " " + text(40)), (304, None)]
    labels = [(i, 1, 0) for i in range(160)] + [(200 + i, 0, 0) for i in range(80)]
    langs = ["en", "de", "fr", "es"]
    spark.createDataFrame([(i, t, langs[i % 4], "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, [(1, item)]


def test_stages(spark, tmp_path):
    rows, items = _folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        path = f"{tmp_path}/{len(held)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        held[name] = {r.doc_id: r.text for r in docs.collect()}
    texts = dict(rows)
    first, exact, near, clean, mixed = held.values()
    assert not any(200 <= i < 280 for i in first) and len([i for i in first if i < 160]) == 160
    squeezed = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = {}
    for i in first:
        key = squeezed(texts[i])
        want[key] = min(want.get(key, (1, 0)), (-len(texts[i] or ""), i))
    assert set(exact) == {i for _, i in want.values()} and 300 in exact and 4 not in exact
    words = lambda t: decontaminate.words_of(t)
    shingles = lambda t: {tuple(words(t)[k:k + 5]) for k in range(max(1, len(words(t)) - 4))}
    assert 302 not in near and 5 in near
    for i in exact:
        others = [j for j in near if j < i and len(shingles(texts[i]) & shingles(texts[j])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[j]))] if words(texts[i]) else []
        assert (i in near) != bool(others)
    for i in near:
        n, hit, _ = decontaminate.brute_force(texts[i], items)
        assert (i in clean) == (not (hit and 20 * hit >= n))
    assert 303 in near and 303 not in clean
    assert set(mixed) <= set(clean) and all(r.copies > 0 for r in docs.collect())


def test_run_on_empty_documents(spark, tmp_path):
    _folder(spark, tmp_path / "full")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    spark.read.parquet(f"{tmp_path}/full/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="sample tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(queries.SQL[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
