"""N-gram Jaccard join over a prefix tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from . import wordhash
from .common import released, settle
from .components import components

WIDTH, PERCENT = 5, 75
#: Cells of the frequency sketch and the rows that it is merged in.
SKETCH_BITS, SKETCH_ROWS = 24, 64
#: Hashes below this, three eighths of all, are counted and come first in the order.
COUNTED = np.uint64(3 << 61)
#: Most members of a group whose pairs are listed, and nodes in a block beyond that.
SMALL, BLOCK = 32, 256
#: Least and most cells of a set's outline.
CELLS = 64, 1 << 16
#: Most bits of the filter that says which documents are read again.
FILTER_BITS = 1 << 27


def shingle_hashes(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The 64-bit shingle hashes of each text, repeats included. Fewer words than width: one of
    the whole sequence. No words: none."""
    for lo, hi in wordhash.chunks(texts):
        flat, _, _, first, _ = wordhash.words(texts[lo:hi])
        rolled = wordhash.fold([flat[k : len(flat) - width + 1 + k] for k in range(width)]) if len(flat) >= width else flat[:0]
        bounds = first.tolist()
        for start, end in zip(bounds, bounds[1:], strict=False):
            n = end - start
            if n >= width:
                yield rolled[start : end - width + 1]
            elif n:
                yield wordhash.fold([np.array([n], np.uint64), *(flat[k : k + 1] for k in range(start, end))])
            else:
                yield flat[:0]


def frequency_classes(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """For each cell of a hashed sketch how often its counted shingles occur, as a class: 0 for what a
    cell holds by chance, one more for each doubling. A fixed number of bytes, over all texts."""
    cells, part = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_ROWS
    spark = docs.sparkSession

    def count(batches):
        sums, held, n = np.zeros(cells, np.uint16), [], 0

        def add():
            cell, times = np.unique(np.concatenate(held), return_counts=True)
            sums[cell] = np.minimum(sums[cell].astype(np.int64) + times, 65535)

        for batch in batches:
            for h in shingle_hashes(wordhash.texts_of(batch.column(0)), width):
                held.append((h[h < COUNTED] & np.uint64(cells - 1)).astype(np.int64))
                n += len(held[-1])
                if n > 200_000:
                    add()
                    held.clear()
                    n = 0
        if held:
            add()
        for k in range(SKETCH_ROWS):
            x = sums[k * part : (k + 1) * part]
            small = x.astype(np.uint8) if x.max() < 256 else x
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "sums": pa.array([small.tobytes()], pa.binary())})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, np.uint8 if len(raw) == part else np.uint16)
                held[k] = held[k] + x if k in held else x.astype(np.int64)
        for k, x in held.items():  # a byte a cell: eighths of a doubling
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "sums": pa.array([np.minimum(255, np.round(8 * np.log2(x + 1.0))).astype(np.uint8).tobytes()], pa.binary())})

    tasks = max(2 * spark.sparkContext.defaultParallelism, 8)
    found = docs.select("text").coalesce(tasks).mapInArrow(released(count), "part int, sums binary")
    levels = np.zeros(cells, np.uint8)
    for k, raw in found.repartition(SKETCH_ROWS, "part").mapInArrow(released(merge), "part int, sums binary").toLocalIterator():
        levels[k * part : (k + 1) * part] = np.frombuffer(raw, np.uint8)
    usual = max(1.0, 2 ** (float(np.median(levels)) / 8) - 1)
    chance = 8 * np.log2(usual + 4 * usual**0.5 + 1)
    of_level = np.clip(np.ceil((np.arange(256) - chance) / 8), 0, 15).astype(np.uint8)
    for k in range(0, cells, part):  # in place and by parts: the driver holds one byte a cell and little besides
        levels[k : k + part] = of_level[levels[k : k + part]]
    return levels


def ordered_set(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set in the global order: what is counted and rare, what is not counted, then the frequent
    classes. The class is in four bits below the sign, then comes the hash."""
    cls = classes[(h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    cls = np.where(h < COUNTED, np.where(cls > 0, np.minimum(cls + 1, 15), 0), 1).astype(np.uint64)
    return np.unique((cls << np.uint64(59)) | (h & np.uint64((1 << 59) - 1)))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Two sets that reach the threshold share an element among so many first ones of each."""
    return n + (-percent * n // 100) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def outline(s: np.ndarray) -> np.ndarray:
    """How many elements of a set fall into each of so many cells as it has elements, roughly: a byte a
    cell, by the low bits of the hashes, so that halves folded together are the outline of half the cells."""
    cells = min(CELLS[1], max(CELLS[0], 1 << int(len(s) - 1).bit_length()))
    return np.minimum(255, np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells)).astype(np.uint8)


def packed(cells: np.ndarray) -> bytes:
    """An outline in bits, for each cell as many zeros as it counts and then a one: nothing is lost, and where
    outlines travel or rest they take a bit for each cell and element, two bits a cell up to CELLS[1] elements."""
    bits = np.zeros(len(cells) + int(cells.sum(dtype=np.int64)), np.uint8)
    bits[np.cumsum(cells, dtype=np.int64) + np.arange(len(cells))] = 1
    return np.packbits(bits).tobytes()


def unpacked(bits: np.ndarray) -> np.ndarray:
    """The outline that packed() made these bytes of."""
    return (np.diff(np.flatnonzero(np.unpackbits(bits)), prepend=-1) - 1).astype(np.uint8)


def _folded(x: np.ndarray, cells: int) -> np.ndarray:
    """Outlines, one a row, over fewer cells."""
    while x.shape[-1] > cells:
        half = x.shape[-1] // 2
        x = np.minimum(255, x[..., :half].astype(np.uint16) + x[..., half:]).astype(np.uint8)
    return x


def may_reach(one: np.ndarray, n: int, many: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which of many outlines may belong to sets that reach the threshold with this one's: no more
    elements can be common than the smaller counts of the cells say. Full cells say nothing."""
    cells = min(one.shape[-1], many.shape[-1])
    one, many = _folded(one, cells), _folded(many, cells)
    both = np.minimum(one, many)
    most = both.sum(axis=1, dtype=np.int64)
    alike = 100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)
    return alike & (((100 + percent) * most >= percent * (n + sizes)) | (both == 255).any(axis=1))


def _arrays(lists: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in lists])]).astype(np.int32), pa.int32()), pa.array(flat, pa.int64()))


def _nid(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None


def _prefixes(docs: DataFrame, classes, width: int, percent: int) -> DataFrame:
    """(doc_id, n, nid, keys, cells): the size, name, prefix and packed outline of each document's set. Of
    equal sets that one task meets the first alone has the prefix."""

    def run(batches):
        table, seen = classes.value, set()  # a task reads one split
        for batch in batches:
            n, nid, keys, cells = [], [], [], []
            for h in shingle_hashes(wordhash.texts_of(batch.column(1)), width):
                s = ordered_set(h, table)
                n.append(len(s))
                nid.append(_nid(s))
                keys.append(_signed(s[: prefix_length(len(s), percent)] if len(s) and nid[-1] not in seen else s[:0]))
                seen.add(nid[-1])
                cells.append(packed(outline(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nid, pa.int64()), _arrays(keys), pa.array(cells, pa.binary())], names=["doc_id", "n", "nid", "keys", "cells"])

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n long, nid long, keys array<long>, cells binary")


def _whole_sets(docs: DataFrame, classes, width: int, wanted) -> DataFrame:
    """(nid, n, keys): the whole ordered sets of the documents that a bitmap of hashed ids holds."""

    def run(batches):
        table, bits = classes.value, wanted.value
        for batch in batches:
            at = (batch.column(1).to_numpy(zero_copy_only=False) % (8 * len(bits))).astype(np.int64)
            keep = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            sets = [s for s in (ordered_set(h, table) for h in shingle_hashes(wordhash.texts_of(batch.column(0).take(pa.array(keep))), width)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_nid(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _arrays([_signed(s) for s in sets])], names=["nid", "n", "keys"])

    return docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("at")).mapInArrow(released(run), "nid long, n long, keys array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, nid) rows sorted by both, where rows may repeat: (key, nid, null) for keys of three
    nodes or more, and for keys of two the pair (null, a, b), each pair once a batch. Holds two rows
    over at most."""
    empty = np.zeros(0, np.int64)
    held_key, held_nid, large, last = empty, empty, None, None

    def out(keys, nids, pairs):
        k = pairs.shape[1]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(keys), pa.nulls(k, pa.int64())]), pa.array(np.concatenate([nids, pairs[0]])), pa.concat_arrays([pa.nulls(len(keys), pa.int64()), pa.array(pairs[1])])], names=["key", "nid", "other"])

    def pairs_of(a, b):
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)

    for batch in batches:
        key, nid = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        if not len(key):
            continue
        fresh = np.append(last != (key[0], nid[0]), (key[1:] != key[:-1]) | (nid[1:] != nid[:-1]))
        last = key[-1], nid[-1]
        key, nid = np.concatenate([held_key, key[fresh]]), np.concatenate([held_nid, nid[fresh]])
        if not len(key):
            continue
        start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        size = np.diff(np.append(start, len(key)))
        many = size >= 3
        many[0] |= large is not None and key[0] == large
        last_open = not many[-1]
        large = None if last_open else key[-1]
        keep = np.repeat(many, size)
        held_key, held_nid = (key[start[-1] :], nid[start[-1] :]) if last_open else (empty, empty)
        two = start[(size == 2) & ~many & (start < start[-1])]
        yield out(key[keep], nid[keep], pairs_of(nid[two], nid[two + 1]))
    if len(held_key) == 2:
        yield out(empty, empty, pairs_of(held_nid[:1], held_nid[1:]))


class Trie:
    """A prefix tree walked along its sorted sequences: what two neighbours share is counted once,
    and a branch ends as soon as what remains can't reach the overlap that is asked for."""

    BLOCK = 64

    def __init__(self, probe: np.ndarray, percent: int = PERCENT):
        self.probe, self.percent = probe, percent
        self.path, self.counts = probe[:0], np.zeros(1, np.int64)

    def reaches(self, s: np.ndarray) -> bool:
        size, n = len(self.probe), len(s)
        if 100 * min(size, n) < self.percent * max(size, n):
            return False
        need = -(-self.percent * (size + n) // (100 + self.percent))
        m = min(len(self.path), n)
        differ = np.flatnonzero(self.path[:m] != s[:m])
        depth = int(differ[0]) if len(differ) else m
        counts = [self.counts[: depth + 1]]
        have = int(counts[0][-1])
        passed = int(np.searchsorted(self.probe, s[depth - 1], side="right")) if depth else 0
        while depth < n and have + min(n - depth, size - passed) >= need:
            block = s[depth : min(n, depth + self.BLOCK)]
            at = np.searchsorted(self.probe, block)
            hit = np.cumsum(self.probe[np.minimum(at, size - 1)] == block)
            counts.append(have + hit)
            passed = int(np.searchsorted(self.probe, block[-1], side="right"))
            have, depth = have + int(hit[-1]), depth + len(block)
        self.path, self.counts = s[:depth], np.concatenate(counts)
        return depth == n and have >= need


def _led(pairs: DataFrame, held: DataFrame, column: str, judge, salts: int = 16) -> DataFrame:
    """The (a, b) of pairs that judge takes, a function of a leader that gives a function of its
    partners. A leader a goes once to each of the salted groups of its partners, which arrive after it in
    the order of column."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    ask = salted.select("a", "salt", F.col("b").alias("nid"), F.lit(1).alias("role")).union(salted.select("a", "salt", F.col("a").alias("nid"), F.lit(0).alias("role")).distinct())
    rows = ask.join(held.select("nid", "n", column), "nid").select("a", "salt", "role", "nid", "n", column)
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", column)

    def run(batches):
        at, takes = None, None
        for batch in batches:
            a, salt, role, nid, n = (batch.column(c).to_pylist() for c in range(5))
            data, out = batch.column(5), [[], []]
            bounds = data.offsets.to_numpy() if column == "keys" else np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
            flat = data.values.to_numpy(zero_copy_only=False) if column == "keys" else np.frombuffer(data.buffers()[2] or b"", np.uint8)
            for k in range(len(a)):
                s = flat[bounds[k] : bounds[k + 1]]
                if role[k] == 0:
                    at, takes = (a[k], salt[k]), judge(s.copy(), n[k])
                elif at == (a[k], salt[k]) and takes(s, n[k]):
                    out[0].append(a[k])
                    out[1].append(nid[k])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["u", "v"])

    return rows.mapInArrow(released(run), "u long, v long")


def _screened(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs whose outlines do not rule the threshold out."""

    def judge(one, n):
        mine = unpacked(one)
        return lambda s, m: may_reach(mine, n, unpacked(s)[None], np.array([m]), percent)[0]

    return _led(pairs, heads, "cells", judge)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold."""

    def judge(one, n):
        trie = Trie(one, percent)
        return lambda s, m: trie.reaches(s)

    return _led(pairs, sets, "keys", judge)


def _wanted_bits(involved: DataFrame, n: int) -> np.ndarray:
    """A bitmap of hashed ids, of FILTER_BITS at most: it only spares work, the join after it decides."""
    size = min(FILTER_BITS, max(1 << 16, 1 << int(16 * n).bit_length()))

    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy(zero_copy_only=False) % size).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    few = involved.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("at")).coalesce(8).mapInArrow(released(run), "bits binary")
    for row in few.toLocalIterator():
        out |= np.frombuffer(row[0], np.uint8)
    return out


def _block_pairs(rest: DataFrame, heads: DataFrame, percent: int, block: int) -> DataFrame:
    """The pairs (a, b) of members of one group (key, m, nid, comp) and different components whose outlines do
    not rule the threshold out. Members whose largest group is the same make blocks of about block
    nodes; a probe meets all outlines of a block at once. Whoever is not of a group's largest component goes to every
    block that holds one of the group."""
    sizes = rest.select("nid", "comp").distinct().groupBy("comp").agg(F.count("*").alias("size"))
    of = rest.groupBy("nid", "comp").agg(F.max(F.struct("m", "key")).alias("h")).select("nid", "comp", F.col("h.key").alias("home"))
    many = of.groupBy("home").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    at = of.join(many, "home").select("nid", "comp", "home", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int").alias("block"))
    at = settle(at, "join-blocks")
    main = rest.join(sizes, "comp").groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top")).select("key", F.col("top.comp").alias("main"))
    held = rest.select("key", "nid").join(at.select("nid", "home", "block"), "nid").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("home", "block"))).alias("at"))
    asking = rest.join(main, "key").where("comp <> main").select("key", "nid", "comp").join(held, "key")
    asking = asking.groupBy("nid", "comp").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("at")).select("nid", "comp", F.explode("at").alias("x")).select("nid", "comp", "x.home", "x.block")
    rows = at.select("nid", "comp", "home", "block", F.lit(0).alias("role")).unionByName(asking.withColumn("role", F.lit(1)))
    rows = rows.join(heads.select("nid", "n", "cells"), "nid").select("home", "block", "role", "nid", "comp", "n", "cells")
    rows = rows.repartition("home", "block").sortWithinPartitions("home", "block", "role", "nid")

    def run(batches):
        at, held, index = None, [], None
        for batch in batches:
            home, blk, role, nid, comp, n, cells = (batch.column(c).to_pylist() for c in range(7))
            out = [[], []]
            for k in range(len(nid)):
                if at != (home[k], blk[k]):
                    at, held, index = (home[k], blk[k]), [], None
                if role[k] == 0:
                    held.append((nid[k], comp[k], n[k], unpacked(np.frombuffer(cells[k], np.uint8))))
                    continue
                if not held:
                    continue
                if index is None:
                    index = [(np.stack([x[3] for x in held if len(x[3]) == c]), *(np.array([x[j] for x in held if len(x[3]) == c]) for j in range(3))) for c in sorted({len(x[3]) for x in held})]
                one = unpacked(np.frombuffer(cells[k], np.uint8))
                for many, ids, comps, sizes in index:
                    hit = np.flatnonzero(comps != comp[k])
                    hit = hit[100 * np.minimum(n[k], sizes[hit]) >= percent * np.maximum(n[k], sizes[hit])]
                    if len(hit):
                        hit = hit[may_reach(one, n[k], many[hit], sizes[hit], percent)]
                    out[0] += np.minimum(ids[hit], nid[k]).tolist()
                    out[1] += np.maximum(ids[hit], nid[k]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return rows.mapInArrow(released(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents with 100 * intersection >= percent * union of
    their shingle sets are linked; component_id is the smallest doc_id reachable.

    1. A sketch over all texts gives each shingle a frequency class, and so a global order.
    2. Equal sets are one node. Nodes meet in the groups of the elements among their first
       n - ceil(t n) + 1 ones; two nodes that reach the threshold share such a group.
    3. Pairs that alone share an element are compared. In each larger group the member whose prefix
       meets others most, which is what copies were made from, is compared with all others: a group
       of near copies costs one comparison each.
    4. Then pairs that no chain of links joins yet are compared, for no other link changes a
       component: in groups of SMALL members at most pair by pair, and in larger ones by blocks.
       Every pair that could join two components is compared.
    A pair is compared by outlines first, counts of elements by cell, which bound what can be
    common. For those that are left the whole sets are made from the texts again, and the partners'
    ordered sets are walked as a prefix tree (Trie).

    Null and empty texts: n_shingles 0, component_id the own doc_id. Repeated rows are rows of one
    node. A null doc_id stays null unless linked to others. An empty table gives an empty result.
    Other columns are not read. Nodes and shingles are told apart by 64-bit and 59-bit hashes.
    """
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(docs, width))  # 1 byte a cell
    firsts = settle(_prefixes(docs, classes, width, percent), "join-prefixes")
    postings = firsts.select(F.explode("keys").alias("key"), "nid").repartition("key").sortWithinPartitions("key", "nid")
    met = settle(postings.mapInArrow(released(_shared), "key long, nid long, other long"), "join-groups")
    shared, two = met.where("key is not null").select("key", "nid"), met.where("key is null").select("nid", "other").distinct()
    often = met.where("key is not null").select("nid").union(two.select("nid")).union(two.select("other")).groupBy("nid").agg(F.count("*").alias("met"))
    heads = firsts.select("nid", "n", "doc_id", "cells", (F.col("n") + F.floor(F.col("n") * F.lit(-percent) / 100) + 1).alias("prefix")).join(often, "nid").groupBy("nid")
    heads = heads.agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("cells").alias("cells"), F.first(F.col("met") / F.col("prefix")).alias("central"))
    heads = settle(heads, "join-heads")
    if heads.isEmpty():
        classes.destroy()
        return _labelled(firsts, None)
    order = W.partitionBy("key").orderBy(F.desc("central"), F.xxhash64("nid"), "nid")
    groups = settle(shared.join(heads.select("nid", "n", "central"), "nid").withColumn("rank", F.row_number().over(order)).withColumn("m", F.max("rank").over(W.partitionBy("key"))).drop("central"), "join-ranked")
    sets: list[DataFrame] = []

    def gather(wanted_nodes: DataFrame) -> None:
        """Adds the whole sets of nodes that are not there yet."""
        fresh = wanted_nodes.distinct()
        for have in sets:
            fresh = fresh.join(have.select("nid"), "nid", "left_anti")
        fresh = settle(fresh.join(heads.select("nid", "doc_id"), "nid"), "join-fresh")
        if n := fresh.count():
            wanted = spark.sparkContext.broadcast(_wanted_bits(fresh, n))
            more = _whole_sets(docs, classes, width, wanted).join(fresh.select("nid"), "nid", "left_semi")
            sets.append(settle(more.groupBy("nid").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "join-sets"))
            wanted.destroy()

    def compared(pairs: DataFrame) -> DataFrame:
        """The links among pairs of nodes that outlines do not rule out."""
        gather(pairs.select(F.col("a").alias("nid")).union(pairs.select("b")))
        if not sets:
            return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        every = sets[0]
        for more in sets[1:]:
            every = every.union(more)
        return settle(_verified(pairs, every, percent), "join-links")

    def screened(pairs: DataFrame) -> DataFrame:
        return settle(_screened(settle(pairs, "join-pairs"), heads, percent).select(F.col("u").alias("a"), F.col("v").alias("b")), "join-maybe")

    def still_open(groups: DataFrame, joined: DataFrame) -> DataFrame:
        comp = joined.withColumnsRenamed({"node": "nid", "component": "comp"})
        marked = groups.join(comp, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        keys = marked.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where(F.col("c0") != F.col("c1")).select("key")
        return settle(marked.join(keys, "key", "left_semi"), "join-open")

    similar = "100 * least(n, na) >= %d * greatest(n, na)" % percent
    first = groups.where("rank = 1").select("key", F.col("nid").alias("a"), F.col("n").alias("na"))
    led = groups.where("rank > 1").join(first, "key").where(similar).select("a", F.col("nid").alias("b"))
    joined = components(compared(screened(led.union(two).distinct())))
    edges = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
    few = still_open(groups.where(F.col("m") <= SMALL).select("key", "nid", "n", "rank"), joined)
    lead = few.where("rank > 1").select("key", F.col("nid").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.col("comp").alias("ca"))
    pairs = few.where("rank > 2").join(lead, "key").where("rank > ra and comp <> ca and " + similar)
    edges = edges.union(compared(screened(pairs.select(F.least("a", "nid").alias("a"), F.greatest("a", "nid").alias("b")).distinct())))
    joined = components(edges)
    rest = still_open(groups.where(F.col("m") > SMALL).select("key", "m", "nid"), joined)
    if not rest.isEmpty():
        links = compared(settle(_block_pairs(rest, heads, percent, BLOCK), "join-maybe"))
        joined = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links))
    classes.destroy()
    return _labelled(firsts, joined)


def _labelled(firsts: DataFrame, joined: DataFrame | None) -> DataFrame:
    """(doc_id, n_shingles, component_id), the smallest doc_id by node first and then by component."""
    names = firsts.where("nid is not null").groupBy("nid").agg(F.min("doc_id").alias("low"))
    if joined is not None:
        comp = joined.withColumnsRenamed({"node": "nid", "component": "comp"})
        linked = names.join(comp, "nid")
        lowest = linked.groupBy("comp").agg(F.min("low").alias("lowest"))
        names = names.join(comp.join(lowest, "comp").select("nid", "lowest"), "nid", "left").select("nid", F.coalesce("lowest", "low").alias("low"))
    names = settle(names, "join-names")
    return firsts.select("doc_id", "n", "nid").join(names, "nid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))
