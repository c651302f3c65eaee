"""Operators on small fixtures: edge cases that the tables do not hold."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark import sources, streaming
from quillspark.functions import text as T
from quillspark.operators import changes, documents, graph, matching, merging, metrics, retrieval


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize("said, value", [("1.234,56 €", 1234.56), ("12,5", 12.5), ("1.234", 1234.0), ("1,234.5", 1234.5), ("-3.25", -3.25), ("none", None)])
def test_number(spark, said, value):
    assert one(spark, T.number(F.lit(said))) == value


@pytest.mark.parametrize("said, iso", [("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("1.3.2024", "2024-03-01"), ("31/12/2023", "2023-12-31"), ("soon", None)])
def test_parse_date(spark, said, iso):
    found = one(spark, T.parse_date(F.lit(said)))
    assert (str(found) if found else None) == iso


def test_column_number(spark):
    assert [one(spark, T.column_number(F.lit(c))) for c in ("A", "Z", "AA", "xfd")] == [1, 26, 27, 16384]


def test_cosine_is_null_for_zero_and_safe_for_huge(spark):
    vectors = spark.createDataFrame([([0.0, 0.0],), ([1e200, 1e200],)], "v array<double>")
    got = [r[0] for r in vectors.select(retrieval.cosine(F.col("v"), F.array(F.lit(1e200), F.lit(1e200)))).collect()]
    assert got[0] is None and math.isclose(got[1], 1.0)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "c c")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, ["a", "a"]).collect()}
    idf = math.log1p((3 - 1 + 0.5) / 1.5)
    assert got.keys() == {1} and math.isclose(got[1], idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)))


def test_retrieve_modes(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "blue ring"), (3, "sky")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "doc_id long, embedding array<double>")
    query = spark.createDataFrame([(9, [1.0, 0.0])], "vec_id long, embedding array<double>")
    ids = lambda mode: [r.doc_id for r in retrieval.retrieve(docs, mode, "red ring", vectors, query).orderBy("rank").collect()]
    assert ids("lexical") == [1, 2] and ids("vector") == [1, 3, 2] and ids("hybrid")[0] == 1 and ids("structured") == [1, 2, 3]
    with pytest.raises(ValueError):
        retrieval.retrieve(docs, "direct", budget=3)
    with pytest.raises(ValueError):
        retrieval.retrieve(docs, "vector")


def test_ranking_metrics(spark):
    run = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 2, 3), ("z", 5, 1)], "query_id string, doc_id long, rank int")
    rel = spark.createDataFrame([("q", 2, 1), ("q", 7, 2)], "query_id string, doc_id long, grade int")
    got = {r.query_id: r for r in metrics.ranking_metrics(run, rel, 10).collect()}
    assert got["q"].recall == 0.5 and got["q"].mrr == 0.5 and got["z"].recall is None
    assert math.isclose(got["q"].ndcg, (1 / math.log2(3)) / (3 / math.log2(2) + 1 / math.log2(3)))


def test_changes_with_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, d string")
    new = spark.createDataFrame([(2, None), (3, "x"), (4, "n")], "k long, d string")
    assert {tuple(r) for r in changes.changes(old, new, "k", "d").collect()} == {(1, "delete"), (3, "upsert"), (4, "upsert")}


def test_components_and_trace(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (5, 3)], "u long, v long")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)}
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.trace(path, seeds, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_unique_best_needs_a_margin(spark):
    pairs = spark.createDataFrame([(1, 10, "x", "y", 0.9), (1, 11, "x", "y", 0.85), (2, 12, "x", "y", 0.9), (2, 13, "x", "y", 0.5)], "a long, b long, da string, db string, score double")
    assert {(r.a, r.b): r.best for r in matching.unique_best(pairs).collect()} == {(1, 10): False, (1, 11): False, (2, 12): True, (2, 13): False}


def test_projection_prefers_the_language(spark):
    facts = spark.createDataFrame([("r", "f", "de", "x", 1), ("r", "f", "en", "y", 1), ("r", "g", "en", "p", 1), ("r", "g", "en", "q", 2)], "record string, field string, lang string, value string, source int")
    merged = merging.candidates(facts)
    assert {(r.field, r.value, r.conflict) for r in merging.project(merged, "preview", "de").collect()} == {("f", "x", False), ("g", "p", True)}
    assert {r.field for r in merging.project(merged, "approved", "de").collect()} == {"f"}


def test_chunks_are_the_text(spark):
    text = "short\n" + "word " * 700 + "\n\nend" + "x" * 4000
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = documents.chunks(docs).orderBy("ordinal").collect()
    assert "".join(r.chunk for r in got) == text and all(len(r.chunk) <= 1600 for r in got) and [r.start for r in got] == [sum(len(x.chunk) for x in got[:k]) for k in range(len(got))]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<html><p>x</p></html>")
    (tmp_path / "in" / "b.PDF").write_bytes(b"%PDF-1.7 ...")
    d = sources.folder(spark, f"file://{tmp_path}/in").withColumn("sniffed", sources.sniffed_format(F.col("content")))
    assert {(r.format, r.sniffed) for r in d.collect()} == {("html", "html"), ("pdf", "pdf")}
    df = spark.range(3)
    head = sources.append_revision(df, f"file://{tmp_path}/t", "r1", None, None)
    assert sources.append_revision(df, f"file://{tmp_path}/t", "r1", None, head) == "r1"
    with pytest.raises(ValueError):
        sources.append_revision(df, f"file://{tmp_path}/t", "r2", "r0", head)


def test_stream_reconcile(spark, tmp_path):
    rows = [(k, k % 3, "e", float(k)) for k in range(12)]
    schema = "event_id long, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streaming.reconcile(stream, f"{tmp_path}/state", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.user_id, r.event_id) for r in streaming.newest(spark, f"{tmp_path}/state").collect()} == {(0, 9), (1, 10), (2, 11)}


def test_trace_ends_on_cycles(spark):
    from quillspark.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")], "parent string, child string")
    got = graph.trace(edges, spark.createDataFrame([("a",)], "node string"))
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]


def test_pairs_of_a_large_group_are_shared_by_tasks(spark, tmp_path):
    from quillspark.plans import catalog

    rows = [(k, "bolt" if k % 50 else "ring", None if k % 31 == 30 else "Brand#1" if k % 41 else "Brand#2", None if k % 11 == 3 else f"T{k % 3}", None if k % 13 == 5 else k % 4) for k in range(1200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pairs = [(x, y) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and None not in (x[2], y[2]) and x[2] != y[2]]
    differ = lambda p, k: None if None in (p[0][k], p[1][k]) else p[0][k] != p[1][k]
    both = lambda s, t: False if False in (s, t) else None if None in (s, t) else True
    conflict = catalog.QUERIES["er_identity_conflict"](spark, str(tmp_path))
    assert {tuple(r) for r in conflict.collect()} == {(p[0][0], p[1][0], both(differ(p, 4), differ(p, 3))) for p in pairs}
    assert conflict.count() == len(pairs)
    bolts = conflict.where("a % 50 <> 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(bolts) > 1
    told = lambda s, t: 1.0 if None in (s, t) else (0.0 if t else 0.2) if s else (0.9 if t else 1.0)
    score = catalog.QUERIES["er_score_translated"](spark, str(tmp_path))
    assert {tuple(r) for r in score.collect()} == {(p[0][0], p[1][0], told(differ(p, 4), differ(p, 3))) for p in pairs}


def test_pairs_in_groups_for_any_block(spark):
    rows = [(k, k % 3, k % 2, k % 5) for k in range(40)]
    d = spark.createDataFrame(rows, "id long, doc long, group int, f int")
    want = {(x[0], y[0], x[3] == y[3]) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1] and x[2] == y[2]}
    for block in (1, 3, 100):
        got = [tuple(r) for r in matching.pairs_in_groups(d, ["f"], block).collect()]
        assert set(got) == want and len(got) == len(want)
