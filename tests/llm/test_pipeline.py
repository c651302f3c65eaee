"""The pipeline's stages on inputs of any nature, and the whole of it on a small table."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(n=120, seed=5):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bcdlmnrst") + rng.choice("aeiou") for _ in range(3))
    vocabulary = [name() for _ in range(400)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60))), "en", f"s{rng.randint(0, 9) % 4}", 0) for k in range(n)]
    return rows + [(None, "one of its own kind here", None, None, None), (n, None, "en", "s1", None), (n + 1, "", "en", None, 0), (3, "another text under the same number", "en", "s0", 0)]


def test_copies_follow_the_schedule_on_any_plan(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA).withColumn("u", F.lit("clash")).withColumn("lane", F.col("doc_id")).withColumn("epoch", F.lit(1))
    for plan in (docs, docs.repartition(7), docs.orderBy(F.desc("text")).limit(1000)):
        wanted = Counter()
        for r in mixing.schedule(plan).collect():
            if r["size"] == 0:
                wanted[r.doc_id, 0] = 1
            elif r.taken > 0 and 2 * r.taken >= r["size"]:
                wanted[r.doc_id, r["size"]] += 1
        out = mixing.mixed_documents(plan)
        assert out.columns == docs.columns
        got = Counter((r.doc_id, len((r.text or "").split())) for r in out.collect())
        assert got == wanted
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_repeated_rows_are_mixed_each(spark):
    docs = spark.createDataFrame([(7, "a b c d e", "en", "x", 0)] * 40 + [(8, "f g h", "en", "y", 0)] * 5, SCHEMA)
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    assert taken == 215
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs.repartition(3)).collect())
    assert abs(5 * copies[7] + 3 * copies[8] - 215) <= 5


def test_whole_pipeline(spark, tmp_path):
    rows = rows_of()
    rows += [(500 + k, rows[k][1], "en", "s2", 0) for k in range(10)]  # copies
    rows += [(600 + k, rows[k][1] + " you stupid idiot", "en", "s2", 0) for k in range(40, 70)]
    rows.append((700, "write to ana.lima@example.org or not at all", "en", "s3", 0))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(100)] + [(600 + k, 1, 1) for k in range(40, 70)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "mix", "best_fit_packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and not any(600 <= (k or 0) < 700 for k in ids) and {r[0] for r in rows if (r[0] or 0) < 200} <= ids
    kept = corpus_pipeline.drop_near_copies(spark, clean, str(tmp_path))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr(r) for r in rows if not 500 <= (r[0] or 0) < 700)
    safe = {r.doc_id: r.text for r in corpus_pipeline.redact(spark, kept, str(tmp_path)).collect()}
    assert safe[700] == "write to <email> or not at all" and all(safe[r[0]] == r[1] for r in rows if r[0] in range(60) and r[0] != 3)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mixed = corpus_pipeline.mix(spark, corpus_pipeline.redact(spark, kept, str(tmp_path)), str(tmp_path))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pieces(mixed).collect())
    assert not re.search("@", " ".join(r.text or "" for r in mixed.collect()))
