"""The stages of the pipeline against plain Python."""

import collections

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from geoagg.llm import common, mixing, quality, secrets

from .test_operators import CLASHES, COLUMNS, EDGES, brute_components

SF = "/root/testdata/sf0.001"


def by_sql(docs, sql, column):
    """doc_id -> ``column`` of an operator's SQL over the documents of a stage."""
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    rel = con.sql(sql)
    at = rel.columns.index("doc_id"), rel.columns.index(column)
    return {r[at[0]]: r[at[1]] for r in rel.fetchall()}


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [common.alnum_words((r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, given = {r.doc_id: r for r in docs.collect()}, docs
        docs = common.stored(spark, stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == list(spark.read.parquet(f"{SF}/documents.parquet").columns)
        if name == "quality":
            assert {d for d in good & set(before) if len(before[d].text.split()) >= 10} <= set(after) < set(before)
            assert set(after) == {d for d, kept in by_sql(given, quality.OP4_SQL, "kept").items() if kept}
        if name == "near_copies":
            ids = sorted(before)
            _, comp = brute_components([before[i].text for i in ids], 5, 80)
            assert set(after) == {ids[c] for c in comp}
        if name == "decontamination":
            def hit(t):
                w = common.alnum_words(t.encode())
                return any(tuple(w[i : i + len(x)]) == x for n in {len(x) for x in windows} for i in range(len(w) - n + 1) for x in [tuple(w[i : i + n])] if x in windows)

            assert set(after) == {d for d, r in before.items() if not hit(r.text)}
        if name == "secrets":
            assert set(after) == set(before)
            for d, r in after.items():
                assert r.text == before[d].text or (secrets.MARK in r.text and r.n_chars == len(r.text))
        if name == "mixing":
            assert {d: r.taken for d, r in after.items()} == {d: n for d, n in by_sql(given, mixing.OP1_SQL, "taken").items() if n}
            sums = collections.Counter()
            for r in after.values():
                sums[r.source] += r.taken
            assert all(abs(sums[r.source] - r.target) <= 1 for r in after.values())


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, missing ids and columns of any name, in all stages."""
    words = lambda k, n=40: " ".join(f"w{k}x{i * 7919 % 100_003}" for i in range(n))
    passage = " ".join(f"bench{i}" for i in range(15))
    rows = [*EDGES, (20, words(20, 30_000), "en", "a", 0), (21, words(21), "en", "a", 0), (21, words(21), "en", "a", 0), *[(None, words(30 + i), None, "b", None) for i in range(3)], (40, words(40) + " " + passage, "en", None, 0), (41, words(41) + ' token = "76ce86d4952db1ee140095c8f6e334d186126d15" end', "en", "b", 0), (42, words(41) + ' token = "76ce86d4952db1ee140095c8f6e334d186126d15" end', "en", "b", 0)]
    d = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (None, "q"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(spark, stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == d.columns
    got = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    want = [(0, words(30)), (0, words(31)), (0, words(32)), (8, "a b c d e f g h i j k l"), (20, words(20, 30_000)), (21, words(21)), (41, words(41) + f' token = "{secrets.MARK}" end')]
    assert got == sorted(want) and all(r[c] == f"own {c}" for r in docs.collect() for c in CLASHES)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() <= len(want) and len(out.columns) == len(set(out.columns)) and set(d.columns) <= set(out.columns)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_runs_agree(spark):
    key = lambda: sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SF).select("doc_id", "taken").collect())
    assert key() == key()
    assert corpus_pipeline.run(spark, SF).agg(F.count_if(F.col("taken") <= 0)).first()[0] == 0
