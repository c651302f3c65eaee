"""Fits take all that there is, not a sample."""

import math
import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import common, lm, quality, shingle_join
from quillspark.llm.common import in_fold


def plain_threshold(scored, dear=5.0):
    scored = sorted(scored)
    good, bad = sum(1 for _, q in scored if q), sum(1 for _, q in scored if not q)
    if not good or not bad:
        return -math.inf
    best, cut, lost, caught = 1.0, -math.inf, 0, 0
    for k, (x, q) in enumerate(scored):
        lost, caught = lost + (q == 1), caught + (q == 0)
        cost = dear * lost / good + 1 - caught / bad
        if cost < best and (k + 1 == len(scored) or scored[k + 1][0] > x):
            best, cut = cost, x if k + 1 == len(scored) else (x + scored[k + 1][0]) / 2
    return cut


def test_threshold_of_a_table_is_that_of_a_list(spark):
    rng = random.Random(4)
    cases = [[(0.5, 1), (0.5, 0)], [(0.1, 0), (0.9, 1)], [(0.3, 1)], [(0.2, 1), (0.8, 0)]]
    cases += [[(round(rng.gauss(q, 1.2), rng.choice([1, 9])), q) for q in (rng.randint(0, 1) for _ in range(300))] for _ in range(3)]
    for rows in cases:
        assert quality._threshold(spark.createDataFrame(rows, "llr double, quality int")) == plain_threshold(rows)


def test_quality_takes_every_label(spark, monkeypatch):
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit(w) for w in "one two three four five six seven eight nine ten".split()], F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(quality, "_threshold", lambda scored: seen.append(scored.count()) or 0.0)
    assert quality.rate(docs, labels).count() == n
    assert seen == [labels.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 1).count()]


def plain_kinds(bags, rounds=20):
    x = np.rint(lm.FINE * np.sqrt(bags) / np.sqrt(bags.sum(axis=1, keepdims=True)))
    centers = lm._coarse(x.sum(axis=0, keepdims=True))
    for _ in range(lm.KINDS):
        likeness = (x @ centers.T).max(axis=1)
        far = min((r.astype(np.uint16).tobytes(), k) for k, r in enumerate(x) if likeness[k] == likeness.min())[1]
        centers = np.concatenate([centers, lm._coarse(x[[far]])])
    centers = centers[1:]
    for _ in range(rounds):
        near = np.argmax(x @ centers.T, axis=1)
        sums = np.array([x[near == k].sum(axis=0) for k in range(lm.KINDS)])
        centers = np.where(sums.any(axis=1, keepdims=True), lm._coarse(sums), centers)
    counts = np.array([bags[near == k].sum(axis=0) for k in range(lm.KINDS)])
    overall = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * lm.TELLING)
    return np.log((counts + 20 * overall) / (counts.sum(axis=1, keepdims=True) + 20)).T


def test_kinds_are_of_every_training_text(spark, monkeypatch):
    n, kinds, seen = 5_000, lm.text_kinds, []
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[((F.col("id") * k) % (7 + 10 * k)).cast("string") for k in range(1, 9)], F.lit("ab")).alias("text"))

    def told(bags):
        seen.append((bags, kinds(bags)))
        return seen[0][1]

    monkeypatch.setattr(lm, "text_kinds", told)
    assert lm.score(docs).count() == n
    rows = seen[0][0].collect()
    assert len(rows) == docs.where(~in_fold("doc_id", 10, 0)).count() > 4_000
    bags = np.zeros((len(rows), lm.TELLING))
    for k, r in enumerate(rows):
        bags[k, np.frombuffer(r[0], np.uint16)] = np.frombuffer(r[1], np.uint32)
    assert (bags.sum(axis=1) > 0).all() and np.allclose(seen[0][1], plain_kinds(bags), atol=1e-5)
    assert np.array_equal(kinds(seen[0][0].repartition(7)), seen[0][1])


def test_target_takes_one_plan_at_any_size(spark, monkeypatch):
    """Texts that are in no target are not shuffled, few labels are not broadcast, ids of other types match."""
    docs = spark.range(2_000).select(F.when(F.col("id") >= 40, F.col("id")).alias("doc_id"), F.concat_ws(" ", F.lit("one two"), F.col("id").cast("string")).alias("text"))
    labels = spark.range(2_000).select(F.col("id").cast("string").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen, base_counts = [], quality.base_counts
    monkeypatch.setattr(quality, "base_counts", lambda d, keep: seen.append(d) or base_counts(d, keep))
    assert quality.rate(docs, labels).count() == 2_000
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "Union" in plan
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0
    assert seen[0].count() == 2_000
    assert seen[0].where("g = 1").count() == docs.where(half & (F.col("doc_id") % 2 == 1)).count() > 400


def test_frequency_classes_are_bytes_on_the_driver(spark):
    docs = spark.range(200).select(F.concat_ws(" ", F.lit("a b c d e f g"), F.col("id").cast("string")).alias("text"))
    tracemalloc.start()
    try:
        classes = shingle_join.frequency_classes(docs)
        assert tracemalloc.get_traced_memory()[1] < 4 << shingle_join.SKETCH_BITS
    finally:
        tracemalloc.stop()
    assert classes.dtype == np.uint8 and len(classes) == 1 << shingle_join.SKETCH_BITS and np.bincount(classes, minlength=16)[1:].sum() >= 1


def test_outlines_rest_as_two_bits_a_cell(spark):
    """Of the join's largest rows: nothing is lost, and an element and a cell take one bit each."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(n))) for k, n in enumerate((0, 3, 5, 70, 400, 5_000))], "doc_id long, text string")
    classes = np.zeros(1 << shingle_join.SKETCH_BITS, np.uint8)
    rows = shingle_join._prefixes(docs, spark.sparkContext.broadcast(classes), 5, 75).orderBy("doc_id").collect()
    assert rows[0].cells is None
    for r, text in zip(rows[1:], docs.orderBy("doc_id").toPandas().text[1:], strict=True):
        cells = shingle_join.outline(shingle_join.ordered_set(next(shingle_join.shingle_hashes([text.encode()])), classes))
        assert cells.sum() == r.n and 8 * len(r.cells) < len(cells) + r.n + 8
        assert np.array_equal(shingle_join.unpacked(np.frombuffer(r.cells, np.uint8)), cells)
    for cells in (np.full(64, 255, np.uint8), np.zeros(64, np.uint8), np.array([0, 255, 0, 1] * 16, np.uint8)):
        assert np.array_equal(shingle_join.unpacked(np.frombuffer(shingle_join.packed(cells), np.uint8)), cells)


def test_settling_returns_what_the_driver_has_freed(spark, monkeypatch):
    monkeypatch.setattr(common, "GIVE_BACK_S", 0, raising=False)
    memory, size = spark._jvm.org.apache.spark.unsafe.Platform, 100_000
    status = Path(f"/proc/{spark._jvm.ProcessHandle.current().pid()}/smaps_rollup")
    held_mb = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", status.read_text())[1]) / 1024
    df = spark.range(10)
    common.settle(df, "first").count()
    blocks = [memory.allocateMemory(size) for _ in range(2000)]
    for block in blocks:
        memory.setMemory(block, 1, size)
    for k, block in enumerate(blocks):  # some stay, so that glibc itself gives little back
        if k % 50:
            memory.freeMemory(block)
    before = held_mb()
    common.settle(df, "second")
    after = held_mb()
    for block in blocks[::50]:
        memory.freeMemory(block)
    assert before - after > 100
