"""Best-fit packing of token sequences in bulk-synchronous sweeps."""

from __future__ import annotations

import functools
import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import released, settle

CAPACITY = 2048
#: Characters of text that are split at once; one longer text goes by itself.
CHUNK_CHARS = 1_500_000
END_ID = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The forms that a vocabulary file must say for words to be encoded apart (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]


def _printable() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: its own where that is visible,
    else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


class PlainEncoder:
    """Token ids of texts by any vocabulary file, text by text."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        for text in texts:
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Merges:
    """The merges of a byte-level BPE with word ends, done for many words of one length at once."""

    NONE = np.int32(2**31 - 1)
    PLACES = 32

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        printable = _printable()
        self.first = np.array([[vocabulary[printable[b]], vocabulary[printable[b] + end]] for b in range(256)], np.int32)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocabulary[x] << 20 | vocabulary[y] for x, y in pairs], np.int64)
        self.made = np.array([vocabulary[x + y] for x, y in pairs], np.int32)
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # linear probing
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            done = first & (self.ranks[at] < 0)
            self.keys[at[done]], self.ranks[at[done]] = keys[left[done]], left[done]
            left, at = left[~done], (at[~done] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray, place) -> np.ndarray:
        """rank * PLACES + place of each pair, NONE for what is no merge."""
        keys = a.astype(np.int64) << 20 | b
        at = self._slot(keys)
        found, rank = self.keys[at], self.ranks[at]
        odd = np.flatnonzero((found != keys) & (rank >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & self.mask
            rank[odd] = self.ranks[at[odd]]
            found[odd] = self.keys[at[odd]]
            odd = odd[(found[odd] != keys[odd]) & (rank[odd] >= 0)]
        return np.where(rank >= 0, rank * self.PLACES + place, self.NONE)

    def encode(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each word has, ids by place) of words, one a column, a byte a row."""
        size, n = letters.shape
        ids = self.first[letters, 0]
        ids[-1] = self.first[letters[-1], 1]
        out, count = np.zeros((size, n), np.int32), np.full(n, size)
        who = np.arange(n)
        keys = np.stack([self._rank(ids[k], ids[k + 1], k) for k in range(size - 1)]) if size > 1 else np.zeros((0, n), np.int32)
        for width in range(size, 0, -1):
            if width == 1:
                out[:1, who], count[who] = ids[:1], 1
                break
            best = keys.min(axis=0)
            over = best == self.NONE
            if over.any():
                done = who[over]
                out[:width, done], count[done] = ids[:, over], width
                go = ~over
                who, ids, keys, best = who[go], ids[:, go], keys[:, go], best[go]
                if not len(who):
                    break
            at, column = best % self.PLACES, np.arange(len(who))
            made = self.made[best // self.PLACES]
            later = [k >= at for k in range(width - 1)]
            ids = np.stack([np.where(later[k], ids[k + 1], ids[k]) for k in range(width - 1)])
            ids[at, column] = made
            moved = [np.where(later[k], np.where(keys[k + 1] == self.NONE, self.NONE, keys[k + 1] - 1), keys[k]) for k in range(width - 2)]
            keys = np.stack(moved) if moved else np.zeros((0, len(who)), np.int32)
            left = np.flatnonzero(at > 0)
            keys[at[left] - 1, left] = self._rank(ids[at[left] - 1, left], made[left], at[left] - 1)
            right = np.flatnonzero(at < width - 2)
            keys[at[right], right] = self._rank(made[right], ids[at[right] + 1, right], at[right])
        return count, out


class WordEncoder:
    """Token ids of texts by a vocabulary file whose pre-tokenizer never joins what white space
    parts, so that a text's ids are its words' ids one after another.

    The distinct words of a run of texts are encoded once each: those of Latin letters, which are
    one piece, and single characters by Merges, all at once; all others by the tokenizer. A closing
    mark after a letter is a word of its own. Nothing is kept from run to run."""

    def __init__(self, tokenizer, merges: Merges, special: list[str]):
        self.tokenizer, self.merges = tokenizer, merges
        self.special = [s.lower().encode() for s in special]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends of each word's ids, the ids) of distinct words."""
        bounds, data = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1], np.frombuffer(words.buffers()[2] or b"", np.uint8)
        sizes = np.diff(bounds)
        plain = (data >= 97) & (data <= 122)
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] != 0xB7))
        plain[lead] = plain[lead + 1] = True
        wrong = np.concatenate([[0], np.cumsum(~plain)])
        direct = (wrong[bounds[1:]] == wrong[bounds[:-1]]) | ((sizes == 1) & (data[bounds[:-1]] < 128))
        direct &= sizes <= Merges.PLACES
        counts, parts, order = np.zeros(len(words), np.int64), [], []
        for size in np.unique(sizes[direct]).tolist():
            who = np.flatnonzero(direct & (sizes == size))
            count, ids = self.merges.encode(data[bounds[who] + np.arange(size)[:, None]])
            counts[who] = count
            parts.append(ids.T[np.arange(size) < count[:, None]])
            order.append(who)
        rest = np.flatnonzero(~direct)
        if len(rest):
            coded = [self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words.take(pa.array(rest)).to_pylist()]
            counts[rest] = [len(c) for c in coded]
            parts.append(np.fromiter((i for c in coded for i in c), np.int32, int(counts[rest].sum())))
            order.append(rest)
        if not parts:
            return np.zeros(1, np.int64), np.zeros(0, np.int32)
        who, flat = np.concatenate(order), np.concatenate(parts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(len(flat), np.int32)
        out[_spots(ends[who], counts[who])] = flat
        return ends, out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        for lo, hi in _chunks([len(t) for t in texts], CHUNK_CHARS):
            coded = [t.encode("utf-8", "replace") for t in texts[lo:hi]]
            joined = b" " + b" ".join(coded) + b" "
            low = joined.lower()
            if any(s in low for s in self.special):
                low = joined  # letter case tells what is a special token
            b = np.frombuffer(low, np.uint8).copy()
            at = np.flatnonzero(b[:-1] == 0xC3) + 1
            at = at[(b[at] >= 0x80) & (b[at] <= 0x9E) & (b[at] != 0x97)]
            if low is not joined:
                b[at] += 0x20
            gap = (b == 32) | ((b >= 9) & (b <= 13))
            mark = np.flatnonzero(((b[1:-1] == 46) | (b[1:-1] == 44)) & gap[2:]) + 1
            before = b[mark - 1]
            mark = mark[((before >= 97) & (before <= 122)) | ((before >= 0x9F) & (before <= 0xBF) & (before != 0xB7) & (b[mark - 2] == 0xC3))]
            start = np.zeros(len(b), bool)
            start[1:] = gap[:-1] & ~gap[1:]
            start[mark] = True
            first = np.flatnonzero(start)
            packed = b[~gap]
            bounds = np.append(np.flatnonzero(start[~gap]), len(packed)).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
            ends, ids = self._words(words.dictionary)
            index = words.indices.to_numpy()
            counts = np.diff(ends)[index]
            flat = ids[_spots(ends[index], counts)].astype("<u4")
            starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]) + 1
            upto = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(first, starts)].tolist()
            for x, y in zip(upto, upto[1:], strict=False):
                yield flat[x:y].tobytes()


def _spots(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield lo, k
            lo, total = k, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


@functools.cache
def encoder(path: str) -> WordEncoder | PlainEncoder:
    """One for each worker process and vocabulary; of a size that hangs on the vocabulary alone. By words if the file's normaliser, pre-tokenizer and model are of the form that allows it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, steps, normal = said["model"], (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}], (said.get("normalizer") or {}).get("normalizers") or []
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    fits = (
        [x.get("type") for x in normal] == NORMAL and normal[1].get("pattern") == {"Regex": r"\s+"}
        and len(steps) == 2 and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
        and byte_level.items() <= {k: v for k, v in steps[1].items()}.items()
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        and said.get("post_processor") is None and len(model["vocab"]) < 1 << 20 and len(model["merges"]) * Merges.PLACES < Merges.NONE
    )
    return WordEncoder(tokenizer, Merges(model["vocab"], model["merges"], model["end_of_word_suffix"]), [x["content"] for x in said["added_tokens"]]) if fits else PlainEncoder(tokenizer)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a closing 0, cut only if
    longer than capacity."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, out = batch.column(0), [[], [], [], [], []]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k, coded in enumerate(enc.encode(texts)):
                coded += end
                for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    for column, value in zip(out, (k, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Sweeps over run-length coded sorted lists of pieces and gaps.

    All pieces of one length are one run and so are sequences that were filled alike, so a sweep
    costs what the number of distinct lengths and gaps asks, whatever the number of documents.
    Lengths go from long to short. In a sweep each piece's successor is the smallest gap that
    holds it; pieces that ask for one gap are told apart by rank: rank r takes place r of the run.
    Then the gaps are updated. What finds no gap opens new sequences. The outcome is that of
    best-fit decreasing piece by piece.

    Rows: (length, first rank, ranks, first sequence, pieces of each sequence, offset).
    """
    gaps: list[int] = []  # sorted
    runs: dict[int, list[tuple[int, int]]] = {}
    plan, next_sequence = [], 0

    def put(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(first: int, count: int, gap: int) -> int:
            """Sequences of the run that were used."""
            nonlocal left, rank
            each = gap // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - gap))
                put(gap - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if left and full < count:
                plan.append((length, rank, left, first + full, left, capacity - gap))
                put(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            return full

        while left and (at := bisect_left(gaps, length)) < len(gaps):
            gap = gaps.pop(at)
            waiting = runs.pop(gap)
            while waiting and left:
                first, count = waiting.pop()
                used = fill(first, count, gap)
                if used < count:
                    waiting.append((first + used, count - used))
            for first, count in waiting:
                put(gap, first, count)
        if left:
            fresh = -(-left // (capacity // length))
            fill(next_sequence, fresh, capacity)
            next_sequence += fresh
    return plan


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, lane_rows: int = 20_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece.

    A piece's rank among those of its length comes from running counts by (length, lane), a lane
    being a hash of doc_id, piece and ids, so that a length which a third of all documents have is
    spread over all lanes; there are as many lanes as one length has lane_rows pieces. The driver sees one count for each length, capacity at most, and sends
    out the plan over lengths and gaps.

    Null or empty text: one piece, the closing 0. Rows that repeat are packed each. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, path, capacity), "pack-pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    plan = np.array(sorted(best_fit_plan(counts, capacity)) or np.zeros((0, 6)), dtype=np.int64)
    # its size hangs on capacity alone: no more rows than pairs of a length and a run of gaps
    sent = spark.sparkContext.broadcast(plan)
    lanes = max(64, -(-max(counts.values(), default=0) // lane_rows))
    laned = cut.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lanes)).cast("int"))
    starts = laned.groupBy("length", "lane").count()
    starts = starts.select("length", "lane", (F.sum("count").over(W.partitionBy("length").orderBy("lane")) - F.col("count")).alias("lane_start"))
    order = W.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32")
    ranked = laned.withColumn("rank", F.row_number().over(order) - 1).join(starts, ["length", "lane"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("lane_start")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        key = rows[:, 0] * (1 << 44) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 5))
            row = rows[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(released(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
