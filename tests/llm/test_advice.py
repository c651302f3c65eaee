"""What the reviewer of round 1 found missing."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import embedding_dedup, pii, shingle_join, toxicity


def character_counts(text):
    c = toxicity._CLASS[np.frombuffer(f" {text}  ".encode(), np.uint8)].astype(int)
    sums = np.zeros((toxicity.CLASSES,) * toxicity.ORDER)
    np.add.at(sums, tuple(c[k : len(c) - 3 + k] for k in range(4)), 1)
    return toxicity._smoothed(sums)


MODEL = character_counts("you are a stupid idiot  el tonto y el idiota  the boob and a stupid man  " * 40)


def test_spaced_passages_have_word_breaks():
    restored = toxicity.Decoder(MODEL).restore
    for text, word in {"a s t u p i d": "stupid", "el y t o n t o": "tonto", "y o u i d i o t": "idiot", "s. t. u. p. i. d.": "stupid", "b o o b": "boob", "y.o.u.i.d.i.o.t": "idiot", "a s t u u u u p i d": "stupid"}.items():
        assert word in restored(text), text
    assert not restored("| " * 50_000)


def test_no_length_hides_a_word():
    restored = toxicity.Decoder(MODEL).restore
    assert "stupid" in restored("st" + "u" * 500 + "pid")
    assert "stupid" in restored("a " * 300 + "s t u p i d")
    assert any("idiot" in w for w in restored("the-boob-and-a-stupid-man-you-are-a-stupid-1d10t"))
    assert "stupid" in toxicity.Scorer(MODEL, {"=stupid": 1.0}, 0.0)._learn("st" + "u" * 500 + "pid")
    assert any(w.startswith("idiots") for w in restored("idiot$$$$"))


def told(k, n=60):
    return [f"w{k}x{i}" for i in range(n)]


def test_null_ids_are_links(spark):
    a = told(0)
    b, c = [*told(1, 4), *a[4:]], [*told(1, 4), *a[4:-4], *told(2, 4)]
    rows = [(5, " ".join(a)), (None, " ".join(b)), (7, " ".join(c))]
    got = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, None: 5, 7: 5}


def test_pipeline_keeps_unrelated_texts(spark):
    near = [*told(9)[:-2], "other", "end"]
    rows = [(None, " ".join(told(k)), "a") for k in range(6)] + [(1, " ".join(told(7)), "a"), (1, " ".join(told(8)), "a")]  # unrelated
    rows += [(None, None, "a"), (None, None, "b"), (2, "", "a"), (2, None, "a")]  # without words
    one = [(4, " ".join(told(9)), "a"), (3, " ".join(near), "b"), (None, " ".join(near), "c"), (3, " ".join(near), "b")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows + one, "doc_id long, text string, source string"), "")
    assert got.columns == ["doc_id", "text", "source"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [*rows, one[1]]))


def test_items_side_by_side_are_found(spark):
    card, next_card, phone, ip = "4111111111111111", "5500000000000004", "+1 (826) 555-4081", "190.137.223.204"
    rows = [f"paid {card} {next_card} now", f"call {phone} {ip} ok", f"paid 1234 4111 1111 1111 1111 {next_card} now", "write to jane.doe (at) mail (dot) example (dot) com soon"]
    noise = [f"order {k} of {1000003 * k} {1000000007 * k} with {k % 97:02d} {k:04d} {k * 7919:09d} parts" for k in range(1, 60)]
    docs = spark.createDataFrame(list(enumerate(rows * 20 + noise)), "doc_id long, text string")
    got = {r.doc_id: set(r.spans.split(",")) for r in pii.scan(docs).where("doc_id < 4").collect()}
    for k, items in enumerate([[card, next_card], [phone, ip], ["4111 1111 1111 1111", next_card], ["jane.doe (at) mail (dot) example (dot) com"]]):
        for item in items:
            at = rows[k].index(item)
            assert any(x.endswith(f":{at}:{at + len(item)}") for x in got[k]), (item, got[k])
    clean = [r.text for r in pii.redact(docs).where("doc_id < 4").orderBy("doc_id").collect()]
    assert not any(x in t for t in clean for x in (card, next_card, "555-4081", "1111 1111", "jane.doe"))


def test_recall_guard_raises(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 8))
    rows = [(k, [float(y) for y in base[k % 20] + 0.001 * rng.normal(size=8)]) for k in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicates(docs).where("n_links >= 2").count() == 60
    search = embedding_dedup._search
    monkeypatch.setattr(embedding_dedup, "_search", lambda *a: search(*a).limit(0))
    with pytest.raises(RuntimeError):
        embedding_dedup.near_duplicates(docs)
