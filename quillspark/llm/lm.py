"""Online logistic context mixing over hashed-context bit predictors: bits of a text and of its bytes."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import in_fold, released, settle

#: Words that have a code of their own; all others are an escape and then spelt.
HEAD = (1 << 18) - 2
#: Bits of a word's code that are mixed; what follows them is told by the word counts alone.
DEPTH = 8
#: Contexts of the word bits: the word before, if it is among so many, and the last two words among few.
NEAR, FEW = 1 << 14, 64
#: Bytes before that the spelling predictors look at.
ORDERS = (1, 2, 3, 4, 6)
#: log2 of the slots of each hashed table: word before, last two frequent words, spelling orders, kind of text.
SLOTS = (21, 20, 16, 18, 20, 21, 21, 16)
#: Kinds of texts and the most frequent words that tell them.
KINDS, TELLING = 8, 1024
#: Steps of the unit vectors of texts and of kinds, and texts that are compared at once.
FINE, COARSE, VECTORS = 1 << 12, 1 << 11, 512
#: Words that a kind's share of a word leans on the share over all texts with.
LEAN = 8.0
END = np.uint64(0x5EED0F7E87E4D)
#: Words of a text that are scored before its weights are refined, and the step of refining.
BLOCK, RATE = 64, 0.003
CHUNK_BYTES, PART = 1 << 19, 1 << 16
#: Weights that every text begins with, of the kind of text, the word before and the frequent words, by how often
#: the word before was seen at the node (fixed values).
START_WEIGHTS = np.array([[0.95, 0.0, 0.1], [0.8, 0.2, 0.1], [0.6, 0.35, 0.15], [0.4, 0.5, 0.2], [0.3, 0.6, 0.2]], np.float32)
#: Weights of spelling orders 1 to 4 by how often order 4 was seen, of order 4 where order 6 was seen too, and of
#: order 6 by how often (fixed values).
SPELL_WEIGHTS = np.array([[0.2, 0.4, 0.22, 0.0], [0.28, 0.3, 0.25, 0.2], [0.15, 0.2, 0.4, 0.36], [0.1, 0.1, 0.3, 0.36], [0.1, 0.05, 0.2, 0.3]], np.float32)
SPELL_BOTH, SPELL_LAST = np.array([0.0, 1.0, 0.7, 0.5, 0.35], np.float32), np.array([0.0, 0.65, 0.35, 0.4, 0.3], np.float32)
GATES = len(START_WEIGHTS)


def huffman(counts: np.ndarray):
    """(path of internal nodes, path of bits) of each symbol; node 0 is the root."""
    heap = [(int(c), k, k) for k, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    children, next_id = {}, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[next_id] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], next_id, next_id))
        next_id += 1
    root, names, paths = next_id - 1, {}, [None] * len(counts)
    level = [(root, (), ())]
    while level:  # level by level, so that low numbers are near the root
        below = []
        for node, nodes, bits in level:
            if node < len(counts):
                paths[node] = (nodes, bits)
                continue
            names[node] = len(names)
            for bit, child in enumerate(children[node]):
                below.append((child, (*nodes, names[node]), (*bits, bit)))
        level = below
    return paths


def _stretch(n1: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n - n1 + 0.4)).astype(np.float32)


class Codes:
    """The code tree of the head words and the escape, and what follows from the counts alone."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, escapes: int):
        order = np.argsort(-counts, kind="stable")
        self.hashes, counts = hashes[order], counts[order].astype(np.float64)
        self.escape = len(hashes)
        weights = np.append(counts, max(1.0, escapes))
        paths = huffman(weights)
        self.length = np.array([min(DEPTH, len(b)) for _, b in paths], np.int32)
        n = len(paths)
        self.nodes, self.bits = np.zeros((n, DEPTH), np.uint32), np.zeros((n, DEPTH), np.uint8)
        for k, (nodes, bits) in enumerate(paths):
            m = self.length[k]
            self.nodes[k, :m], self.bits[k, :m] = nodes[:m], bits[:m]
        size = 1 << DEPTH
        # a word's share of those with the same first bits, in bits
        last = self.nodes[np.arange(n), np.maximum(self.length - 1, 0)] * 2 + self.bits[np.arange(n), np.maximum(self.length - 1, 0)]
        beyond = np.where(self.length > 0, last, 2 * size)
        sums = np.bincount(beyond, weights, 2 * size + 1)
        self.beyond, self.share = beyond, weights / sums[beyond]
        self.telling = np.zeros((TELLING + 1, KINDS), np.float32)
        self.lean(np.zeros((KINDS + 1, n)))
        # node and bit of each step of each path, one path after another
        self.path = (self.nodes.astype(np.uint16) << 1 | self.bits).ravel()
        self._index()

    def lean(self, counts: np.ndarray) -> None:
        """Sets rest, by kind of text and word the bits that tell the word from those with the same first bits."""
        self.rest = np.zeros(counts.shape, np.float32)
        for k, c in enumerate(counts):
            total = np.bincount(self.beyond, c, int(self.beyond.max()) + 1)[self.beyond]
            self.rest[k] = -np.log2((c + LEAN * self.share) / (total + LEAN))

    def _index(self) -> None:
        bits = max(4, int(2 * len(self.hashes) + 1).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        at = (self.hashes & self.mask).astype(np.int64)
        left = np.arange(len(self.hashes))
        while len(left):
            slot = at[left]
            free = self.ids[slot] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            done = free & first
            self.ids[slot[done]], self.keys[slot[done]] = left[done], self.hashes[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & int(self.mask)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The id of each word, the escape's for those without."""
        slot = (h & self.mask).astype(np.int64)
        out = self.ids[slot]
        miss = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & int(self.mask)
            out[miss] = self.ids[slot[miss]]
            miss = miss[(out[miss] >= 0) & (self.keys[slot[miss]] != h[miss])]
        out[out < 0] = self.escape
        return out


def _binary(sizes: np.ndarray, flat: np.ndarray) -> pa.Array:
    """flat as one binary a text, of so many numbers each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.int32(flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(how many numbers each text has, the numbers) of a column of _binary."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(dtype).itemsize
    return np.diff(offsets), np.frombuffer(column.buffers()[2] or b"", dtype)[offsets[0] : offsets[-1]]


def _bags(docs: DataFrame, codes) -> DataFrame:
    """(ids, times): which of the TELLING most frequent words each text has and how often, as 16-bit and
    32-bit numbers. Texts without any are left out."""

    def run(batches):
        c = codes.value
        for batch in batches:
            texts = wordhash.texts_of(batch.column(0))
            for lo, hi in wordhash.chunks(texts, 8 * CHUNK_BYTES):
                ids, _, first, _, _, _ = _tokens(texts[lo:hi], c)
                told = ids < TELLING
                text = np.repeat(np.arange(hi - lo), np.diff(first))
                key, times = np.unique(text[told] * TELLING + ids[told], return_counts=True)
                sizes = np.bincount(key // TELLING, minlength=hi - lo)
                sizes = sizes[sizes > 0]
                yield pa.RecordBatch.from_arrays([_binary(sizes, (key % TELLING).astype(np.uint16)), _binary(sizes, times.astype(np.uint32))], names=["ids", "times"])

    return settle(docs.select("text").mapInArrow(released(run), "ids binary, times binary"), "lm-bags")


def _vectors(batches: Iterator[pa.RecordBatch]):
    """(unit vectors of square roots in whole 1 / FINE, text, id and count of each entry) of runs of bags.
    Products with centers in whole 1 / COARSE, and sums over a run, are whole numbers below 2^24: float32
    holds them in any order of adding, so nothing hangs on how files are split."""
    for batch in batches:
        for lo in range(0, len(batch), VECTORS):
            part = batch.slice(lo, VECTORS)
            sizes, ids = _flat(part.column(0), np.uint16)
            _, times = _flat(part.column(1), np.uint32)
            text = np.repeat(np.arange(len(part)), sizes)
            norm = np.sqrt(np.bincount(text, times, len(part)))
            x = np.zeros((len(part), TELLING), np.float32)
            x[text, ids] = np.rint(FINE * np.sqrt(times) / norm[text])
            yield x, text, ids, times


def _coarse(centers: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(centers, axis=1, keepdims=True)
    return np.rint(COARSE * centers / np.maximum(size, 1e-12)).astype(np.float32)


def _gathered(bags: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By center, of all texts that are nearest to it: the sum of the vectors, and how often each word occurs."""
    k = len(centers)

    def run(batches):
        sums, words = np.zeros((k, TELLING)), np.zeros(k * TELLING)
        for x, text, ids, times in _vectors(batches):
            near = np.argmax(x @ centers.T, axis=1)
            pick = np.zeros((k, len(x)), np.float32)
            pick[near, np.arange(len(x))] = 1
            sums += pick @ x
            words += np.bincount(near[text] * TELLING + ids, times, k * TELLING)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary()), "words": pa.array([words.tobytes()], pa.binary())})

    tasks = max(2 * bags.sparkSession.sparkContext.defaultParallelism, 8)
    sums, words = np.zeros((k, TELLING)), np.zeros((k, TELLING))
    for a, b in bags.coalesce(tasks).mapInArrow(released(run), "sums binary, words binary").collect():  # tasks rows
        sums += np.frombuffer(a).reshape(k, TELLING)
        words += np.frombuffer(b).reshape(k, TELLING)
    return sums, words


def _farthest(bags: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The vector of all texts that is least like its nearest center; of equals the first by its bytes."""

    def run(batches):
        best = None
        for x, _, _, _ in _vectors(batches):
            likeness = (x @ centers.T).max(axis=1)
            least = float(likeness.min())
            if best is None or least <= best[0]:
                found = least, min(r.astype(np.uint16).tobytes() for r in x[likeness == least])
                best = found if best is None else min(best, found)
        if best:
            yield pa.RecordBatch.from_pydict({"likeness": pa.array([best[0]]), "x": pa.array([best[1]], pa.binary())})

    tasks = max(2 * bags.sparkSession.sparkContext.defaultParallelism, 8)
    found = bags.coalesce(tasks).mapInArrow(released(run), "likeness double, x binary").collect()  # tasks rows
    return np.frombuffer(min((r[0], bytes(r[1])) for r in found)[1], np.uint16).astype(np.float64)


def text_kinds(bags: DataFrame, rounds: int = 20) -> np.ndarray:
    """log P(word | kind) of KINDS kinds of texts, from how often each text has each telling word: k-means of
    unit vectors of square roots over all texts, begun at the text farthest from the kinds so far. Each
    round is a pass over the bags; it ends early where a further one would change nothing."""
    total, _ = _gathered(bags, np.zeros((1, TELLING), np.float32))
    if not total.any():
        return np.zeros((TELLING, KINDS), np.float32)
    centers = _coarse(total)
    for _ in range(KINDS):
        centers = np.concatenate([centers, _coarse(_farthest(bags, centers)[None])])
    centers = centers[1:]
    for _ in range(rounds):
        sums, counts = _gathered(bags, centers)
        moved = np.where(sums.any(axis=1, keepdims=True), _coarse(sums), centers)
        if np.array_equal(moved, centers):
            break
        centers = moved
    overall = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * TELLING)
    return np.log((counts + 20 * overall) / (counts.sum(axis=1, keepdims=True) + 20)).T.astype(np.float32)


def _kinds(ids: np.ndarray, starts: np.ndarray, codes: Codes) -> np.ndarray:
    """The likeliest kind of the text by its words before each word; KINDS at its beginning."""
    told = np.cumsum(np.concatenate([np.zeros((1, KINDS), np.float32), codes.telling[np.minimum(ids, TELLING)]]), axis=0, dtype=np.float64)[:-1]
    told -= np.repeat(told[starts], np.diff(np.append(starts, len(ids))), axis=0)
    out = np.argmax(told, axis=1)
    out[starts] = KINDS
    return out


def _hash(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def _contexts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the word before, and the last two words among the FEW most frequent."""
    n = len(ids)
    before = np.empty(n, np.int64)
    before[1:] = np.minimum(ids[:-1], NEAR)
    before[starts] = NEAR + 1
    text = np.zeros(n, np.int64)
    text[starts[1:]] = 1
    text = np.cumsum(text)
    frequent = np.flatnonzero(ids < FEW)
    upto = np.searchsorted(frequent, np.arange(n))  # of frequent ones before this word
    padded = np.concatenate([[-1, -1], frequent])
    last, last2 = padded[upto + 1], padded[upto]
    known = lambda at: np.where((at >= 0) & (text[np.maximum(at, 0)] == text), ids[np.maximum(at, 0)], FEW)
    return before, known(last) * (FEW + 1) + known(last2)


def _tokens(texts: list[bytes], codes: Codes):
    """Ids, hashes and spans of the words and ends of texts: (ids, hashes, first of each text, start,
    end, bytes); an end has start = end = 0."""
    h, start, end, first, joined = wordhash.words(texts)
    at = first[1:]
    h = np.insert(h, at, END)
    return codes.find(h), h, np.concatenate([[0], at + np.arange(1, len(at) + 1)]), np.insert(start, at, 0), np.insert(end, at, 0), joined


def _expand(ids: np.ndarray, codes: Codes):
    """(word of each bit, its node, the bit) of a run of words."""
    length = codes.length[ids]
    word = np.repeat(np.arange(len(ids)), length)
    at = np.arange(len(word)) + np.repeat(ids.astype(np.int64) * DEPTH - np.cumsum(length) + length, length)
    path = codes.path[at]
    return word, path >> 1, path & 1


class Spelling:
    """The code of bytes, and the bits of words spelt with it."""

    def __init__(self, byte_counts: np.ndarray):
        paths = huffman(byte_counts + 1)
        longest = max(len(b) for _, b in paths)
        self.length = np.array([len(b) for _, b in paths], np.int64)
        self.nodes, self.bits = np.zeros((256, longest), np.uint32), np.zeros((256, longest), np.uint8)
        for k, (nodes, bits) in enumerate(paths):
            self.nodes[k, : len(nodes)], self.bits[k, : len(bits)] = nodes, bits

    def expand(self, joined: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(word, bit, slots in the tables of the orders) of each bit; a space ends a word."""
        size = end - start + 1
        word = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + start[word]
        byte = joined[at].astype(np.int64)
        byte[at == end[word]] = 32
        depth = at - start[word]
        length = self.length[byte]
        of = np.repeat(np.arange(len(byte)), length)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
        node, bit = self.nodes[byte[of], nth], self.bits[byte[of], nth]
        context, slots = np.zeros(len(at), np.uint64), []
        for k in range(1, max(ORDERS) + 1):
            before = np.where(depth >= k, joined[np.maximum(at - k, 0)], 32)
            context = context << np.uint64(8) | before.astype(np.uint64)
            if k in ORDERS:
                slots.append(_hash(context[of], node, SLOTS[2 + len(slots)]))
        return word[of], bit, slots


def _count(docs: DataFrame) -> DataFrame:
    """(kind, h, c) of training texts: word hashes (0) and bytes (1)."""

    def run(batches):
        for batch in batches:
            texts = wordhash.texts_of(batch.column(0))
            found, sums, seen = np.zeros(256, np.int64), [], []
            for lo, hi in wordhash.chunks(texts, 8 * CHUNK_BYTES):
                h, _, _, _, joined = wordhash.words(texts[lo:hi])
                found += np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
                u, c = np.unique(h, return_counts=True)
                seen.append(u)
                sums.append(c)
            if not texts:
                continue
            seen.append(np.array([END]))
            sums.append(np.array([len(texts)]))
            u, inverse = np.unique(np.concatenate(seen), return_inverse=True)
            c = np.bincount(inverse, np.concatenate(sums)).astype(np.int64)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(u), len(some)]).astype(np.int32)), pa.array(np.concatenate([u.view(np.int64), some])), pa.array(np.concatenate([c, found[some]]))], names=["kind", "h", "c"])

    return docs.select("text").mapInArrow(released(run), "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c"))


def _learn_tables(docs: DataFrame, codes, spelling) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts of ones and zeros in each slot of the tables, over all training texts; as one
    16-bit number a slot: the stretched probability in 1/64, and a class of how often it was seen.
    And how often each kind of text has each word of the code tree."""
    spark = docs.sparkSession
    tables = [1 << s for s in SLOTS]
    own, width = len(tables), codes.value.escape + 1

    def count(batches):
        held = [np.zeros(2 * t, np.uint32) for t in tables]
        c, s = codes.value, spelling.value
        words = np.zeros((KINDS + 1) * width, np.uint32)
        one = np.uint32(1)
        for batch in batches:
            texts = wordhash.texts_of(batch.column(0))
            for lo, hi in wordhash.chunks(texts, CHUNK_BYTES):
                ids, h, first, start, end, joined = _tokens(texts[lo:hi], c)
                before, few = _contexts(ids, first[:-1])
                word, node, bit = _expand(ids, c)
                np.add.at(held[0], _hash(before[word], node, SLOTS[0]) * 2 + bit, one)
                np.add.at(held[1], _hash(few[word], node, SLOTS[1]) * 2 + bit, one)
                kind = _kinds(ids, first[:-1], c)
                np.add.at(held[7], (kind[word] << DEPTH | node) * 2 + bit, one)
                np.add.at(words, kind * width + ids, one)
                rare = np.flatnonzero(ids == c.escape)  # as often as they occur, so that no table hangs on how files are split
                _, bit, slots = s.expand(np.frombuffer(joined, np.uint8), start[rare], end[rare])
                for t, slot in enumerate(slots, 2):
                    np.add.at(held[t], slot * 2 + bit, one)
        for t, x in enumerate(held):
            for k in range(0, len(x), 2 * PART):
                part = x[k : k + 2 * PART]
                if top := int(part.max()):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([t * 10_000 + k // (2 * PART)], pa.int32()), "raw": pa.array([part.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32).tobytes()], pa.binary())})

        for k in range(0, len(words), PART):
            if (part := words[k : k + PART]).any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([own * 10_000 + k // PART], pa.int32()), "raw": pa.array([part.astype("<u4").tobytes()], pa.binary())})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        kinds = {2 * PART: np.uint8, 4 * PART: np.uint16, 8 * PART: np.uint32}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, "<u4" if k >= own * 10_000 else kinds[len(raw)])
                sums[k] = sums[k] + x if k in sums else x.astype(np.int64)
        for k, x in sums.items():
            if k >= own * 10_000:
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "raw": pa.array([x.astype("<i8").tobytes()], pa.binary())})
                continue
            n, n1 = x[0::2] + x[1::2], x[1::2]
            level = np.digitize(n, [1, 2, 8, 64])  # five classes
            packed = (np.clip(np.round(64 * _stretch(n1.astype(np.float64), n.astype(np.float64))), -1000, 1000).astype(np.int16) << 3) | level.astype(np.int16)
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "raw": pa.array([packed.tobytes()], pa.binary())})

    tasks = max(2 * spark.sparkContext.defaultParallelism, 8)
    parts = sum(t // PART for t in tables)
    found = docs.select("text").coalesce(tasks).mapInArrow(released(count), "part int, raw binary").repartition(parts, "part").mapInArrow(released(merge), "part int, raw binary")
    out, of_kind = [np.zeros(t, np.int16) for t in tables], np.zeros((KINDS + 1) * width, np.int64)
    for k, raw in found.toLocalIterator():
        t, at = k // 10_000, k % 10_000 * PART
        if t == own:
            of_kind[at : at + PART] = np.frombuffer(raw, "<i8")
        else:
            out[t][at : at + PART] = np.frombuffer(raw, np.int16)
    return out, of_kind.reshape(KINDS + 1, width)


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x >> 3).astype(np.float32) * np.float32(1 / 64), x & 7


def _bits(z: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost in bits of each bit, the bit less the probability of a one), given the stretched probability."""
    e = np.exp(-np.abs(z))
    low = e / (1 + e)  # of the less likely bit
    up = z > 0
    cost = np.log(1 + e) + np.where(up == (bit == 1), np.float32(0), np.abs(z))
    return cost * np.float32(1 / math.log(2)), bit - np.where(up, 1 - low, low)


def _text_bits(ids, first, codes: Codes, tables) -> np.ndarray:
    """Bits of each text but for the spelling of escapes. A text's words go in blocks; after each,
    the text's gated weights take a step along the gradient of that block's cost."""
    texts = len(first) - 1
    sizes = np.diff(first)
    before, few = _contexts(ids, first[:-1])
    kind = _kinds(ids, first[:-1], codes)
    text = np.repeat(np.arange(texts), sizes)
    block = (np.arange(len(ids)) - first[:-1][text]) // BLOCK
    order = np.argsort(block, kind="stable")
    ids, before, few, kind, text, block = ids[order], before[order], few[order], kind[order], text[order], block[order]
    out = np.bincount(text, codes.rest[kind, ids], texts)
    word, node, bit = _expand(ids, codes)
    s1, seen1 = _unpack(tables[0][_hash(before[word], node, SLOTS[0])])
    s2, _ = _unpack(tables[1][_hash(few[word], node, SLOTS[1])])
    s3, _ = _unpack(tables[7][kind[word] << DEPTH | node])
    of = text[word]
    gate = of * GATES + seen1
    weights = np.tile(START_WEIGHTS, (texts, 1))
    bounds = np.searchsorted(block[word], np.arange(int(block[-1]) + 2)) if len(block) else np.zeros(1, int)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if lo == hi:
            continue
        g, b = gate[lo:hi], bit[lo:hi]
        inputs = s3[lo:hi], s1[lo:hi], s2[lo:hi]
        w = weights[g]
        z = np.einsum("nk,kn->n", w, np.stack(inputs))
        cost, miss = _bits(z, b)
        out += np.bincount(of[lo:hi], cost, texts)
        miss *= np.float32(RATE)
        for k, a in enumerate(inputs):
            weights[:, k] += np.bincount(g, miss * a, len(weights)).astype(np.float32)
    return out


def _spell_bits(joined, start, end, spelling: Spelling, tables) -> np.ndarray:
    """Bits of each spelt word. The weights of the orders go with how often their contexts were seen."""
    word, bit, slots = spelling.expand(joined, start, end)
    parts = [_unpack(tables[t][slot]) for t, slot in enumerate(slots, 2)]
    seen4, seen6 = parts[3][1], parts[4][1]
    z = SPELL_LAST[seen6] * parts[4][0] + np.where(seen6 > 0, SPELL_BOTH[seen4], SPELL_WEIGHTS[seen4, 3]) * parts[3][0]
    for k in range(3):
        z += SPELL_WEIGHTS[seen4, k] * parts[k][0]
    return np.bincount(word, _bits(z, bit)[0], len(start))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    The model codes a text's tokens, its words with A-Z lowered and an end. A token is a path in a
    code tree of the HEAD most frequent ones; the first DEPTH bits of the path are each predicted
    by the word before, by the last two frequent words and by the kind of
    text that the words so far tell, in hashed tables of fixed size that are counted over all training
    texts, and mixed in the logistic domain by weights that a gate selects and that each text refines
    as it goes; the rest of the path is told by the words' counts in texts of the kind. Kinds are found
    in all training texts by their TELLING most frequent words. A word without a path is
    an escape: then its count among such words and its spelling by hashed bit predictors share the
    probability by how often such words are new. score is log10 of the probability of the text.

    Null text: as the empty one, the end alone. Rows that repeat are scored each. Without training
    rows N and V are 0. An empty table gives an empty result. Other columns are not read. Words are
    told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), in_fold("doc_id", 10, 0).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    vocabulary = settle(_count(training), "lm-counts")
    byte_counts = np.zeros(256, np.int64)
    for k, c in vocabulary.where("kind = 1").select("h", "c").collect():
        byte_counts[k] = c
    words = vocabulary.where("kind = 0").select("h", "c")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = words.where("c > 1").orderBy(F.desc("c"), "h").limit(HEAD).toArrow()
    hashes, counts = head.column(0).to_numpy().view(np.uint64), head.column(1).to_numpy()
    if END not in hashes:
        hashes, counts = np.append(hashes, END), np.append(counts, 1)
    tail_tokens = max(1, int(total - counts.sum()))
    least, at_least = (int(counts.min()), len(counts))
    singles = words.where("c = 1").count()
    new = min(0.5, max(0.02, singles / tail_tokens))
    code = Codes(hashes, counts, tail_tokens)
    first_codes = spark.sparkContext.broadcast(code)
    code.telling[:TELLING] = text_kinds(_bags(training, first_codes))
    first_codes.destroy()
    told_codes, spelling = spark.sparkContext.broadcast(code), spark.sparkContext.broadcast(Spelling(byte_counts))
    learnt, of_kind = _learn_tables(training, told_codes, spelling)
    told_codes.destroy()
    code.lean(of_kind)
    # HEAD entries and tables of fixed size
    codes, tables = spark.sparkContext.broadcast(code), spark.sparkContext.broadcast(learnt)
    divisor = float(total + 0.1 * (distinct + 1))
    by_hash = dict(zip(hashes.tolist(), counts.tolist(), strict=True))
    count_of = np.array([by_hash[x] for x in code.hashes.tolist()], np.float64)
    base_of = spark.sparkContext.broadcast(np.append(np.log10((count_of + 0.1) / divisor), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, s, t, base = codes.value, spelling.value, tables.value, base_of.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, done = wordhash.texts_of(batch.column(1)), 0
            for lo, hi in wordhash.chunks(texts, CHUNK_BYTES):
                ids, h, first, start, end, joined = _tokens(texts[lo:hi], c)
                n = hi - lo
                text = np.repeat(np.arange(n), np.diff(first))
                bits = _text_bits(ids, first, c, t)
                rare = np.flatnonzero(ids == c.escape)
                pair, at, times = np.unique(np.stack([text[rare].astype(np.uint64), h[rare]]), axis=1, return_index=True, return_counts=True) if len(rare) else (np.zeros((2, 0), np.uint64), np.zeros(0, int), np.zeros(0, int))
                _, one, which = np.unique(pair[1], return_index=True, return_inverse=True)
                spelt = rare[at[one]]
                cost = _spell_bits(np.frombuffer(joined, np.uint8), start[spelt], end[spelt], s, t)[which] if len(rare) else np.zeros(0)
                k = len(at)
                own = row + done + np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own, own[pair[0].astype(np.int64)]])),
                        pa.concat_arrays([batch.column(0).slice(lo, n), pa.nulls(k, batch.column(0).type)]),
                        pa.concat_arrays([batch.column(2).slice(lo, n), pa.nulls(k, pa.bool_())]),
                        pa.array(np.concatenate([own - (1 << 62), pair[1].view(np.int64)])),
                        pa.array(np.concatenate([np.diff(first), times])),
                        pa.array(np.concatenate([np.bincount(text, ids != c.escape, n), np.zeros(k)]).astype(np.int64)),
                        pa.array(np.concatenate([np.bincount(text, base[ids], n), np.zeros(k)])),
                        pa.array(np.concatenate([-bits * math.log10(2), -cost * math.log10(2)])),
                        pa.array(np.concatenate([[len(x) for x in texts[lo:hi]], np.full(k, -1)]).astype(np.int64)),
                    ],
                    names=["uid", "doc_id", "held_out", "h", "n", "known", "base", "model", "size"],
                )
                done += n
            row += done

    kind = dict(docs.dtypes)["doc_id"]
    out = rows.select("doc_id", "text", "held_out").mapInArrow(released(run), f"uid long, doc_id {kind}, held_out boolean, h long, n long, known long, base double, model double, size long")
    # a text's own row has a key that no word meets, or else is not counted as one: size tells
    tail = words.where((F.col("c") < least) | F.lit(at_least >= HEAD) & (F.col("c") == least) | (F.col("c") == 1))
    d = out.join(tail, "h", "left")
    own = F.col("size") >= 0
    c = F.coalesce(F.when(~own, F.col("c")), F.lit(0))
    share = F.lit(1 - new) * c / F.lit(float(tail_tokens)) + F.lit(new) * F.pow(F.lit(10.0), F.col("model"))
    d = d.select(
        "uid", F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("held_out")).alias("held_out"), F.when(own, F.col("n")).otherwise(0).alias("n_tokens"),
        F.when(own, F.col("known")).when(c > 0, F.col("n")).otherwise(0).alias("n_known"),
        F.when(own, F.col("base")).otherwise(F.col("n") * F.log10((c + 0.1) / F.lit(divisor))).alias("base"),
        F.when(own, F.col("model")).otherwise(F.col("n") * F.log10(F.greatest(share, F.lit(1e-300)))).alias("model"), F.when(own, F.col("size")).otherwise(0).alias("size"),
    )
    d = d.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "model", "size")])
    return d.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"),
        (-F.col("model") / F.lit(math.log10(2)) / F.greatest("size", F.lit(1))).alias("bits_per_byte"),
    )
