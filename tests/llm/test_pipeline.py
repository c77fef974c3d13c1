"""The pipeline on hard documents, and each query of the registry on the smallest tables."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from tidemark.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, path, rows, bench):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages(spark, tmp_path):
    r = random.Random(0)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    clean = [(i, say(150), "en", f"s{i % 3}", 1) for i in range(90)]
    item = say(30)
    near = clean[0][1].split(" ")
    near[75] = "changed"
    rows = [*clean, (200, " ".join(near), "en", "s0", 1), (201, clean[1][1], "fr", None, None), (202, say(80) + " " + item + " " + say(40), "en", "s1", 1), (203, say(100) + " me@mail.example.com " + say(20), "en", "s1", 1),
            (204, None, None, None, None), (205, "", "en", "s0", 0), (206, "short text", "en", "s0", 1), (5, clean[5][1], "en", "s2", 1), (None, say(120), "en", "s0", 1), (207, "spam spam " * 200, "en", "s0", 1)]
    write(spark, str(tmp_path), rows, [(1, item), (2, None)])
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in kept[:-1])
    ids = [sorted((x.doc_id is None, x.doc_id or 0) for x in d.select("doc_id").collect()) for d in kept]
    ids = [[None if n else i for n, i in x] for x in ids]
    assert set(ids[0]) >= {*range(90), 200, 201, 202, 203, None} and not set(ids[0]) & {204, 205, 206, 207}
    assert set(ids[1]) >= {*range(90), 202, 203, None} and not set(ids[1]) & {200, 201} and ids[1].count(5) == 1
    assert set(ids[2]) == set(ids[1]) - {202}
    assert sorted(map(str, ids[3])) == sorted(map(str, ids[2]))
    red = next(x for x in kept[3].collect() if x.doc_id == 203)
    assert "<EMAIL>" in red.text and red.n_chars == len(red.text)
    assert set(ids[4]) == set(ids[3])


def test_run_on_an_empty_table(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    rel = con.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    want = sorted(map(repr, rel.select(*(f'"{c}"' for c in order)).fetchall()))
    assert sorted(map(repr, (tuple(r) for r in df.select(*order).collect()))) == want


def test_near_duplicates_keep_every_text_of_an_id(spark):
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    a, b, c, d = (say(120) for _ in range(4))
    near = c.split(" ")
    near[60] = "changed"
    rows = [(5, a), (5, b), (5, a), (6, c), (7, " ".join(near)), (8, b), (9, d), (9, d), (9, " ".join(near)), (None, a), (None, None), (10, None), (10, ""), (11, "")]
    clash = spark.createDataFrame([(i, t, "en", f"s{k % 2}", k, k, "x", 1.0) for k, (i, t) in enumerate(rows)], COLUMNS + ", node bigint, count string, r double").repartition(3)
    for _ in range(2):
        got = corpus_pipeline.near_duplicates(spark, clash, "").collect()
        kept = sorted(((x.doc_id is None, x.doc_id or 0), x.text or "") for x in got)
        assert kept == sorted(((i is None, i or 0), t or "") for i, t in [(5, a), (6, c), (8, b), (9, d), (None, a), (None, None), (10, None), (10, ""), (11, "")])
        assert next(x.n_chars for x in got if x.doc_id == 9) == 6  # of equal rows the least
        assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
