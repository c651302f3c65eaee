"""Edit-aware token counts: a segment tree of pre-tokens for each document."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

#: Pre-tokens of a leaf; bound of a worker's cache, in pre-tokens.
LEAF, CACHE = 32, 300_000


class Counter:
    """Token counts of pre-tokens by a vocabulary of byte-level ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, int] = {}

    def count(self, piece: str) -> int:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = found = len(self.encoding.encode_ordinary(piece))
        return found


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str | None = None, pattern: str | None = None) -> Counter:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


class Tree:
    """Leaves hold up to LEAF pre-tokens of text; each inner node the characters and tokens below.

    An edit re-encodes the leaves from the one that holds the second character before it, since a
    pre-token looks at one character beyond its end, to one where the new pre-tokens end together
    with the old ones: from there on the text is the same and so are they. The new region takes
    the first leaf's place, the others are emptied, and the sums on their ways to the root change.
    """

    def __init__(self, text: str, counter: Counter):
        self.counter, self.reencoded = counter, 0
        pieces = counter.split(text)
        cache, count = counter.cache, counter.count
        self.texts = ["".join(pieces[k : k + LEAF]) for k in range(0, len(pieces), LEAF)] or [""]
        self.size = 1 << max(0, len(self.texts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, t in enumerate(self.texts):
            self.chars[self.size + k] = len(t)
            total = 0
            for p in pieces[k * LEAF : (k + 1) * LEAF]:
                n = cache.get(p)
                total += count(p) if n is None else n
            self.tokens[self.size + k] = total
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.texts)

    def leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf, its first character) of the character at a position; the last one beyond the end."""
        position = max(0, min(position, self.n_chars - 1))
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if position >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        return min(k - self.size, len(self.texts) - 1), start

    def edit(self, position: int, delete: int, insert: str) -> None:
        """Replace delete characters from position on by insert; both are kept within the text."""
        position = max(0, min(position, self.n_chars))
        delete = max(0, min(delete, self.n_chars - position))
        first, start = self.leaf_at(position - 2)
        last, _ = self.leaf_at(position + delete)
        at = position - start
        while True:
            region = "".join(self.texts[first : last + 1])
            region = region[:at] + insert + region[at + delete :]
            after = next((t for t in self.texts[last + 1 :] if t), "")
            pieces, end, whole = [], 0, not region
            for p in self.counter.split(region + after):
                end += len(p)
                pieces.append(p)
                if end >= len(region):
                    whole = end == len(region)
                    break
            if whole or not after:
                break
            last += 1
            while not self.texts[last]:
                last += 1
        self.reencoded += len(region)
        self.texts[first : last + 1] = [region] + [""] * (last - first)
        sums = [(len(region), sum(map(self.counter.count, pieces)))] + [(0, 0)] * (last - first)
        for k, (c, t) in enumerate(sums, self.size + first):
            self.chars[k], self.tokens[k] = c, t
        lo, hi = (self.size + first) // 2, (self.size + last) // 2
        while lo:
            for k in range(lo, hi + 1):
                self._sum(k)
            lo, hi = lo // 2, hi // 2


EDITS = "array<struct<position:int,delete:int,insert:string>>"


def recount(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens_before, n_edits, n_chars, n_tokens, reencoded_chars) of documents with a
    column edits (array of position, delete, insert), applied one after another.

    Null text: as the empty one. Null edits, and null parts of one: nothing to delete or insert, at
    0. Positions beyond the end are the end. Rows that repeat are counted each. An empty table
    gives an empty result. Other columns are not read. A tree takes a few times its text's memory,
    one document at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            out = [[], [], [], [], []]
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = Tree(text or "", count)
                before = tree.n_tokens
                for e in edits or []:
                    if e:
                        tree.edit(e["position"] or 0, e["delete"] or 0, e["insert"] or "")
                for column, value in zip(out, (before, len(edits or []), tree.n_chars, tree.n_tokens, tree.reencoded), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out]], names=["doc_id", "n_tokens_before", "n_edits", "n_chars", "n_tokens", "reencoded_chars"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(released(run), f"doc_id {kind}, n_tokens_before long, n_edits long, n_chars long, n_tokens long, reencoded_chars long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with their edits (doc_id, seq, position, delete, insert) in the order of seq. A
    document's edits are one row's array, as its text is."""
    lists = edits.where("doc_id is not null").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "position", "delete", "insert"))), lambda e: F.struct(e.position.alias("position"), e.delete.alias("delete"), e.insert.alias("insert"))).alias("edits"))
    return docs.select("doc_id", "text").join(lists, "doc_id", "left")


def routine_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each, at places that a hash of doc_id tells: a replacement, an
    insertion and a deletion."""
    n = F.coalesce(F.length("text"), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n + 1).cast("int")
    one = lambda p, d, i: F.struct(p.alias("position"), F.lit(d).alias("delete"), F.lit(i).alias("insert"))
    edits = F.array(one(place(1), 7, "revised"), one(place(2), 0, " see note 12"), one(place(3), 24, ""))
    return docs.select("doc_id", "text", edits.alias("edits"))
