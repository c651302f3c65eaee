"""The corpus operators against brute force on small fixtures, and on the cases that break things."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import components, embedding_dedup, lm, mixing, packing, pii, quality, sharding, shingle_join, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["the", "ring", "of", "stone", "is", "blue", "and", "old", "river", "goes", "by", "hill"]) + rng.choice(["", "", "s", "er", "."]) for _ in range(n))


def corpus(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.randint(1, 90)), "en", f"s{k % 4}", 0) for k in range(n)]
    rows += [(n + k, rows[k % 9][1], "en", "s0", 0) for k in range(20)]
    rows += [(n + 20, None, None, None, None), (n + 21, "", "en", "s1", 0), (n + 22, "   \n\t ", "en", None, 3), (n + 23, "x" * 5000, "en", "s2", 0), (n + 24, "Ünïcode ñandú 漢字 ​", "fr", "s9", 0)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA).withColumn("uid", F.lit("clash")).withColumn("base", F.lit(1)).withColumn("lane", F.lit(2))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_mixing(spark):
    docs = corpus(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, targets, taken = Counter(), {}, Counter()
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        sizes[source[r.doc_id]] += r["size"]
        targets[source[r.doc_id]] = r.target
        taken[source[r.doc_id]] += r.taken
    total = sum(sizes.values())
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, open_, left = {}, set(names), float(total)
    while True:  # the resharing as it is told
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            want.update(share)
            break
        for s in full:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= full
        if not open_:
            break
    for s in names:
        assert math.isclose(targets[s], want[s], abs_tol=1e-6) and abs(taken[s] - want[s]) <= 2
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize("shards", [3, 40])
def test_sharding(spark, shards):
    docs = corpus(spark, 300)
    rows = sharding.shard(docs, shards=shards).collect()
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(slots) < shards
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(text[r.doc_id].encode()) + 16, zlib.crc32(text[r.doc_id].encode()))
    sums = Counter()
    for r in rows:
        sums[r.shard] += r["size"]
    assert shards > 3 or max(sums.values()) - min(sums.values()) <= 2 * 5016
    assert sharding.shard(empty(spark)).count() == 0


def test_best_fit_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 9), 7]) for _ in range(rng.randint(1, 80))]
        plan = packing.best_fit_plan(Counter(lengths), 64)
        bins, seen = {}, Counter()
        for length, rank, n, first, each, offset in plan:
            for k in range(n):
                bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
            seen[length] += n
        assert seen == Counter(lengths)
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64
        gaps = []
        for length in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= length]
            g = min(fit) if fit else 64
            if fit:
                gaps.remove(g)
            gaps.append(g - length)
        assert len(bins) == len(gaps)


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = corpus(spark)
    docs = docs.union(spark.createDataFrame([(900, "It's o'clock, HELLO-World! 12'345 ΑΣ İstanbul é ñ <|endoftext|> a.b,c", "en", "s", 0), (901, "ring " * 700, "en", "s", 0)], SCHEMA).withColumn("uid", F.lit("")).withColumn("base", F.lit(0)).withColumn("lane", F.lit(0)))
    t = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack(docs, capacity=256).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in docs.dropDuplicates(["doc_id"]).collect():
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [0]
        want = {(k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256))}
        assert {(r.piece, r.start, r.length, r.ids_crc32) for r in by[d.doc_id]} == want
    filled = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 256 and len(filled) <= math.ceil(sum(r.length for r in rows) / 256) + 1
    assert packing.pack(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(25)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    low = list(range(len(rows)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("small, block", [(32, 256), (2, 3)])
def test_near_duplicates(spark, monkeypatch, small, block):
    monkeypatch.setattr(shingle_join, "SMALL", small)
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(9)
    made = prose(rng, 120).split()
    rows = [(r.doc_id, r.text) for r in corpus(spark, 30).collect()]
    for k in range(40):  # near copies around the threshold
        w = list(made)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 99)}"
        rows.append((500 + k, " ".join(w)))
    passage = prose(rng, 60)
    rows += [(700 + k, prose(rng, 30) + f" own{k} " + passage) for k in range(12)]
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_near(rows)


def test_near_duplicates_of_nothing(spark):
    assert shingle_join.near_duplicates(empty(spark)).count() == 0
    got = shingle_join.near_duplicates(spark.createDataFrame([(2, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2)]


def test_quality_counts(spark):
    docs = corpus(spark).union(spark.createDataFrame([(800, "a b c d e f\n" * 6, "en", "s", 0), (801, "### | <x> & 5% $\n\n \n### | <x> & 5% $", "en", "s", 0)], SCHEMA).withColumn("uid", F.lit("")).withColumn("base", F.lit(0)).withColumn("lane", F.lit(0)))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.rate(docs, labels).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        t = text[r.doc_id]
        w = t.encode().split()
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.rate(empty(spark), labels).count() == 0
    assert quality.rate(docs, labels.limit(0)).where("kept = base_failed").count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, v):
    d = [int(c) for c in v if c.isdigit()]
    luhn = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark):
    rng = random.Random(4)
    parts = ["a.b+c@mail.example.com", "x@y", "@@", "256.1.1.1", "10.0.0.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49 30", "12345678901234567890123", "é漢 ", "q@w.e.r_t@z.zz", "00000000000000000000000000.1.1.1", "+", "-", ". "]
    rows = [(k, rng.choice(["", " ", "x"]).join(rng.choice(parts) for _ in range(rng.randint(1, 9)))) for k in range(250)]
    rows += [(1000, None), (1001, ""), (1002, "1 " * 9000), (1003, "a" * 20000 + "@b.cc"), (1004, 'token = "0123456789abcdef0123456789abcdef01234567"')]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("clash"))
    for r in pii.scan(docs).collect():
        t = dict(rows)[r.doc_id] or ""
        want = sorted((m.start(), list(PATTERNS).index(k), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if fits(k, m[0]))
        told = [f"{k}:{a}:{b}" for a, _, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest(), t
        assert set(told) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in want) for k in PATTERNS]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.where("text rlike '@mail.example.com'").count() == 0
    assert pii.scan(empty(spark)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    for k in range(100, 180):
        x[k] = x[k % 10] + 0.15 * rng.normal(size=16)
    x[200:230] = x[7]
    rows = [(k, [float(v) for v in x[k]]) for k in range(400)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None] + [0.0] * 14), (404, [1.0, 2.0]), (405, [float("inf")] * 16), rows[3]]
    got = {}
    for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1))).collect():
        got.setdefault(r.vec_id, r)
    y = np.concatenate([x, x[3:4]])
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    ids = [*range(400), 3]
    low = list(range(401))
    for a, b in zip(*np.nonzero(near), strict=True):
        ra, rb = a, b
        while low[ra] != ra:
            ra = low[ra]
        while low[rb] != rb:
            rb = low[rb]
        low[max(ra, rb)] = min(ra, rb)
    for k in range(400):
        r = k
        while low[r] != r:
            r = low[r]
        assert got[k].component_id == ids[r] and got[k].n_links == near[k].sum() - 1 and got[k].kept == (k == ids[r])
    for k in range(400, 406):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_token_counts(spark):
    count = token_counts.counter()
    rng = random.Random(6)
    for text in ["", " ", "it's a ring\n\n  of stone", prose(rng, 400), "漢字 é́ ​" * 40]:
        tree, now = token_counts.Tree(text, count), text
        for _ in range(30):
            p, d, i = rng.randint(0, len(now) + 2), rng.choice([0, 1, 5, 300]), rng.choice(["", " ", "\n", "'s", "new words", "  12", "é"])
            tree.edit(p, d, i)
            p = min(p, len(now))
            now = now[:p] + i + now[p + d :]
            assert tree.text() == now and tree.n_tokens == len(count.encoding.encode_ordinary(now)) and tree.n_chars == len(now)
    docs = corpus(spark)
    rows = token_counts.recount(token_counts.routine_edits(docs)).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count() and all(r.n_tokens_before == len(count.encoding.encode_ordinary(text[r.doc_id])) for r in rows)
    edits = spark.createDataFrame([(1, 2, 0, 0, "b"), (1, 1, 0, 0, "a"), (2, 1, None, None, None)], "doc_id long, seq int, position int, delete int, insert string")
    after = token_counts.recount(token_counts.with_edits(docs, edits))
    assert {r.doc_id: r.n_chars for r in after.where("doc_id in (1, 2)").collect()} == {1: len(text[1]) + 2, 2: len(text[2])}
    assert token_counts.recount(token_counts.routine_edits(empty(spark))).count() == 0


def test_language_model(spark):
    docs = corpus(spark, 200)
    rows = lm.score(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter()
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            counts.update(words(r.text))
            counts[b" "] += 1
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == docs.count()
    for r in rows:
        w = [*words(text[r.doc_id]), b" "]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0 and math.isfinite(r.score)
    assert lm.score(empty(spark)).count() == 0


def test_language_model_is_a_distribution():
    """The bits of a code tree's leaves and of all short spellings are those of a distribution."""
    rng = np.random.default_rng(1)
    counts = rng.integers(2, 500, 40)
    code = lm.Codes(rng.integers(0, 2**63, 40).astype(np.uint64), counts, 25)
    tables = [np.zeros(1 << s, np.int16) for s in lm.SLOTS]
    total = 0.0
    for k in range(41):
        total += 2.0 ** -lm._text_bits(np.array([k]), np.array([0, 1]), code, tables)[0]
    assert math.isclose(total, 1.0, rel_tol=1e-4)
    paths = lm.huffman(rng.integers(1, 99, 256))
    assert math.isclose(sum(2.0 ** -len(b) for _, b in paths), 1.0)


def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["idiot", "moron", "stupid"]
    rows, labels = [], []
    for k in range(400):
        t, toxic = prose(rng, 40), k % 5 == 0
        if toxic:
            t = t + " " + rng.choice(bad) + " " + prose(rng, 5)
        rows.append((k, t))
        labels.append((k, 1, int(toxic)))
    shown = ["you 1d10t here", "what an i d i o t , really", "so stuuuupid of him", "m.o.r.o.n he said", "the stone is old and blue", None, ""]
    rows += [(1000 + k, t) for k, t in enumerate(shown)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[1000 + k].predicted for k in range(7)] == [1, 1, 1, 1, 0, 0, 0]
    held = [k for k in range(400) if got[k].held_out]
    assert held == [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(got[k].predicted == int(k % 5 == 0) for k in held) >= 0.97 * len(held)
    none = toxicity.score(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("predicted = 1").count() == 0
    assert toxicity.score(empty(spark), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_shared_runs_over_batches():
    import pyarrow as pa

    rng = random.Random(11)
    for _ in range(60):
        rows = sorted((rng.randint(0, 12), k) for k in range(rng.randint(0, 40)))
        step = rng.randint(1, 7)
        told = sorted(rows + rng.choices(rows, k=rng.randint(0, 20))) if rows else rows  # rows may repeat
        batches = [pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in told[i : i + step]], pa.int64()), "nid": pa.array([r[1] for r in told[i : i + step]], pa.int64())}) for i in range(0, len(told), step)]
        got = [tuple(r.values()) for b in shingle_join._shared(iter(batches)) for r in b.to_pylist()]
        by = {}
        for k, n in rows:
            by.setdefault(k, []).append(n)
        want = [(k, n, None) for k, v in by.items() if len(v) > 2 for n in v] + [(None, *sorted(v)) for v in by.values() if len(v) == 2]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_outlines_bound_what_is_common():
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = rng.integers(0, 1 << 59, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 400))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        reaches = 100 * both >= 75 * (len(a) + len(b) - both)
        may = shingle_join.may_reach(shingle_join.outline(a), len(a), shingle_join.outline(b)[None], np.array([len(b)]))[0]
        assert may or not reaches
        assert shingle_join.Trie(a.view(np.int64)).reaches(b.view(np.int64)) == reaches
    full = np.full(64, 255, np.uint8)
    assert shingle_join.may_reach(full, 40_000, full[None], np.array([40_000]))[0]


def test_added_spans_by_kind(spark):
    """Items that the base patterns miss, among look-alikes, on values that no example has."""
    rng = random.Random(17)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    planted, clean = {"secret": [], "number": [], "address": []}, []
    for k in range(60):
        planted["secret"].append(rng.choice(("", "password=", 'token = "')) + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789" if k % 2 else "0123456789abcdef") for _ in range(24)))
        planted["number"].append(f"({rng.randint(200, 999)}) 555-{digits(4)}")
        planted["address"].append(f"{prose(rng, 1).strip('.')}{k} (at) mail (dot) example (dot) org")
        clean += [f"2024-0{k % 9 + 1}-17 at 10", f"order {digits(10)}", f"page {k}, {k * 1000 + 123456}.50 in all", f"the-old-river-goes-by-{k}", f"section/20{k:02d}/stone", f"version {k}.{k + 1}.{digits(4)}"]
    rows, wanted = [], {}
    for kind, items in planted.items():
        for item in items:
            wanted[len(rows)] = kind
            rows.append((len(rows), prose(rng, 8) + " " + item + " " + prose(rng, 8)))
    rows += [(len(rows) + k, prose(rng, 8) + " " + x + " " + prose(rng, 8)) for k, x in enumerate(clean)]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in planted:
        caught = [kind in got[k].spans for k, want in wanted.items() if want == kind]
        assert sum(caught) >= 0.85 * len(caught), (kind, sum(caught))
    alarms = [rows[k][1] for k in range(len(wanted), len(rows)) if got[k].flagged]
    assert len(alarms) <= 0.05 * len(clean), alarms


def two_tongues(n=400, seed=23):
    rng = random.Random(seed)
    tongue = [["".join(rng.choice(a) + rng.choice(b) for _ in range(rng.randint(1, 4))) for _ in range(900)] for a, b in (("bdglmn", "aeiou"), ("ptkfsz", "yäöüå"))]
    weight = [1 / (k + 3) for k in range(900)]
    return [(k, " ".join(rng.choices(tongue[k % 2], weight, k=rng.randint(1, 80))), "en", "s", 0) for k in range(n)]


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.createDataFrame(two_tongues(), SCHEMA)
    got = lm.score(docs).where("held_out").collect()
    base, model = sum(r.base_score for r in got), sum(r.score for r in got)
    assert model > base * 0.97, (base, model)
    again = {r.doc_id: r.score for r in lm.score(docs.repartition(5)).collect()}
    assert all(math.isclose(again[r.doc_id], r.score, rel_tol=1e-4) for r in got)


def test_paths_are_a_code(spark):
    """What stands before a word decides bits, and the words' probabilities still sum to one."""
    rng = np.random.default_rng(4)
    hashes = np.unique(rng.integers(1, 1 << 63, 700).astype(np.uint64))
    codes = lm.Codes(hashes, rng.integers(2, 500, len(hashes)), 300)
    codes.telling[:] = rng.normal(size=codes.telling.shape)
    codes.lean(rng.integers(0, 40, (lm.KINDS + 1, codes.escape + 1)))
    tables = [np.clip(rng.integers(-200, 200, 1 << s) << 3 | rng.integers(0, 5, 1 << s), -32768, 32767).astype(np.int16) for s in lm.SLOTS]
    before = rng.integers(0, codes.escape + 1, 6)
    n = codes.escape + 1
    ids = np.concatenate([np.append(before, k) for k in range(n)])
    whole = lm._text_bits(ids, np.arange(0, len(ids) + 1, 7), codes, tables)
    begun = lm._text_bits(before, np.array([0, 6]), codes, tables)[0]
    assert math.isclose(np.exp2(begun - whole).sum(), 1, rel_tol=1e-3)


def test_verdict_on_unlabelled_texts(spark):
    rng = random.Random(29)
    junk = lambda: " ".join(rng.choice(["click", "here", "buy", "now", "cheap", "win", "prize", "free"]) + rng.choice(["", "!!!", "$$$"]) for _ in range(rng.randint(15, 60)))
    rows = [(k, prose(rng, rng.randint(15, 60)) if k % 3 else junk(), "en", "s", 0) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.rate(spark.createDataFrame(rows, SCHEMA), labels).collect() if not r.base_failed}
    new = [k for k in got if k >= 300]
    good, bad = [got[k].kept for k in new if k % 3], [got[k].kept for k in new if not k % 3]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
