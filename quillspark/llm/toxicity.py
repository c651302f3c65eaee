"""Toxicity: noisy-channel deobfuscation under a character model, then a score over restored words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import in_fold, released, settle
from .shingle_join import shingle_hashes

#: Most labelled documents that the lexicon is fitted on, by a hash of doc_id; most of its candidates.
LABELLED, CANDIDATES = 20_000, 500
#: What a worker keeps of tokens that it has decoded: so many, of so many characters at most. Longer ones are decoded each time.
CACHE_WORDS, CACHE_LENGTH = 100_000, 100
#: Character classes: 0 for what is no letter, 1 to 26, 27 for bytes of other letters.
CLASSES, ORDER = 28, 4
#: What a written character may stand for.
CHANNEL = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou"}
_ODD = re.compile(r"[0-9@$!|+€£*]")
_RUN = re.compile(r"(.)\1\1")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„’‘–—…¿¡"
#: Four single characters or more with separators between; possessive, so that rows of bars cost their length.
_SPACED = re.compile(r"(?<!\S)[a-z0-9@$!|+](?:[ .\-_*]{1,2}+[a-z0-9@$!|+](?![^\s.,;:!?\-_*])){3,}+")
_BETWEEN = re.compile(r"[ .\-_*]")
#: Ways to write a run of one letter in a spaced passage: one or two of it, or some on each side of a word break.
_SPLIT = ((1, 0), (2, 0), (1, 1), (2, 1), (1, 2), (2, 2))
_DOTTED = re.compile(r"^(?:[a-z0-9@$!|+][.\-_*]){2,}[a-z0-9@$!|+]$")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(class | three classes before) from the counts over all texts, each order leaning on the
    next lower one. Every task adds up a table of fixed size, and tables are added by part."""
    cells = CLASSES**ORDER
    parts = 16
    width = cells // parts

    def count(batches):
        sums = np.zeros(cells, np.int64)
        for batch in batches:
            texts = wordhash.texts_of(batch.column(0))
            for lo, hi in wordhash.chunks(texts, 1 << 20):
                c = _CLASS[np.frombuffer(b" " + b"  ".join(texts[lo:hi]) + b"  ", np.uint8)]
                code = c[:-3] * np.uint32(CLASSES**3)
                for k in (1, 2, 3):
                    code += c[k : len(c) - 3 + k] * np.uint32(CLASSES ** (3 - k))
                sums += np.bincount(code, minlength=cells)
        for k in range(parts):
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "sums": [sums[k * width : (k + 1) * width].astype("<i8").tobytes()]})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(raw, "<i8")
        for k, x in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "sums": [x.tobytes()]})

    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, 8)
    found = docs.select("text").coalesce(tasks).mapInArrow(released(count), "part int, sums binary").repartition(parts, "part").mapInArrow(released(merge), "part int, sums binary").collect()
    sums = np.zeros(cells)
    for k, raw in found:
        sums[k * width : (k + 1) * width] += np.frombuffer(raw, "<i8")
    return _smoothed(sums)


def _smoothed(sums: np.ndarray, lean: float = 4.0) -> np.ndarray:
    n = sums.reshape((CLASSES,) * ORDER)
    p = (n.sum((0, 1, 2)) + 1) / (n.sum() + CLASSES)
    for k in range(1, ORDER):
        m = n.sum(tuple(range(ORDER - 1 - k)))
        p = (m + lean * p) / (m.sum(-1, keepdims=True) + lean)
    return np.log(p).astype(np.float32)


def _class_of(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0


class Decoder:
    """Restores words: each written character is a choice of letters, a run of three or more one or
    two of them, a separator of a spaced passage a word break or nothing, and Viterbi takes the
    likeliest way through."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.cache: dict[str, tuple[str, ...]] = {}

    def viterbi(self, written: str, spaced: bool = False) -> str:
        """The likeliest reading. spaced: between any two characters there was a separator."""
        # a way is (way before, option): ways that no state leads on are freed, the cost is linear
        states: dict[tuple, tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
        k = 0
        while k < len(written):
            run = 1
            while k + run < len(written) and written[k + run] == written[k]:
                run += 1
            letters = CHANNEL.get(written[k], written[k])
            if spaced:
                splits = [x for x in _SPLIT if (sum(x) <= run if run >= 3 else sum(x) == run)]
                options = [o * x if not y else o * x + " " + o * y for o in letters for x, y in splits]
                options += [" " + o for o in options] if k else []
            else:
                options = [o * n for o in letters for n in ((1, 2) if run >= 3 else (run,))]
            coded = [(option, [_class_of(letter) for letter in option]) for option in options]
            after: dict[tuple, tuple[float, tuple | None]] = {}
            for state, (score, way) in states.items():
                for option, classes in coded:
                    s, total = state, score
                    for c in classes:
                        total += float(self.model[s[0], s[1], s[2], c])
                        s = (s[1], s[2], c)
                    if s not in after or total >= after[s][0]:
                        after[s] = (total, (way, option))
            states, k = after, k + run
        way = max((score + float(self.model[s[0], s[1], s[2], 0]), n, way) for n, (s, (score, way)) in enumerate(states.items()))[2]
        out = []
        while way is not None:
            way, option = way
            out.append(option)
        return "".join(reversed(out))

    def spelt(self, text: str) -> Iterator[str]:
        """What the spaced passages of a lower-case text spell, with word breaks and as one word."""
        for m in _SPACED.finditer(text):
            units = _BETWEEN.sub("", m[0]).rstrip("!|+")
            if len(units) > 3:
                yield from self.viterbi(units, spaced=True).split()
                yield self.viterbi(units)

    def words(self, token: str) -> tuple[str, ...]:
        """The restored words of one lower-case token."""
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            found = self._words(token)
            if len(token) <= CACHE_LENGTH:
                self.cache[token] = found
        return found

    def _words(self, token: str) -> tuple[str, ...]:
        core = token.strip(_MARKS)
        lead = token[: len(token) - len(token.lstrip(_MARKS))]
        out = set()
        if _DOTTED.match(core):
            units = _BETWEEN.sub("", core)
            out.update((self.viterbi(units), self.viterbi(units, spaced=True)))
        if lead[-1:] in CHANNEL and core:
            out.add(self.viterbi(lead[-1] + core))
        tail = token[len(lead) + len(core) :]
        if tail[:1] in ("$", "@") and core:
            out.add(self.viterbi(core + tail[: len(tail) - len(tail.lstrip("$@"))]))
        if core and (_ODD.search(core) or _RUN.search(core)) and any(c.isalpha() for c in core):
            out.add(self.viterbi(core))
        out.update(_LETTERS.findall(core))
        return tuple(sorted({w for o in out for w in _LETTERS.findall(o)}))

    def restore(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        low = text.lower()
        if not low.isascii():
            low = _HIDDEN.sub("", low)
        tokens = set(low.split())
        out: set[str] = set()
        for token in tokens:
            out.update(self.words(token))
        for word in self.spelt(low):
            out.update(_LETTERS.findall(word))
        return out


def features(word: str) -> list[str]:
    """The word itself and how it begins."""
    return ["=" + word, *(word[:k] for k in range(3, min(len(word), 9)))]


def _fit(rows: list[tuple[dict[str, int], int]], names: list[str], ridge: float = 0.2, rounds: int = 12):
    """Ridge logistic regression by Newton steps: (weight of each feature, intercept)."""
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, -1] = 1
    for k, (found, _) in enumerate(rows):
        for f, n in found.items():
            x[k, at[f]] = n
    y = np.array([r[1] for r in rows], np.float64)
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = np.maximum(p * (1 - p), 1e-6)
        gradient = x.T @ (y - p) - penalty * w
        hessian = (x * r[:, None].astype(np.float32)).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian.astype(np.float64), gradient)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:
            break
    return dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id"):
    """(character model, weight of each word feature, intercept)."""
    spark = docs.sparkSession
    model = character_model(docs)
    sent = spark.sparkContext.broadcast(model)  # CLASSES ** ORDER numbers
    chosen = labels.where(F.col(id_column).isNotNull() & F.col("toxic").isNotNull() & ~in_fold(id_column, 3, 1))
    chosen = chosen.groupBy(id_column).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(id_column), id_column).limit(LABELLED)
    known = spark.createDataFrame([tuple(r) for r in chosen.collect()], chosen.schema)
    sample = docs.select(id_column, "text").join(F.broadcast(known), id_column).where("text is not null")  # LABELLED rows

    def words(batches):
        dec = Decoder(sent.value)
        for batch in batches:
            out = [sorted(dec.restore(t)) for t in batch.column(1).to_pylist()]
            least = [int(h.min() >> np.uint64(1)) if len(h) else 0 for h in shingle_hashes(wordhash.texts_of(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array([int(y) for y in batch.column(2).to_pylist()], pa.int32()), pa.array(least, pa.int64())], names=["words", "toxic", "least"])

    # copies and most near copies have the same least shingle; they count once, whichever task meets them
    told = sample.mapInArrow(released(words), "words array<string>, toxic int, least long")
    restored = settle(told.groupBy("least", "toxic").agg(F.min("words").alias("words")).select("words", "toxic"), "toxic-words")

    def count(batches):
        sums = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"feature": [f for f, _ in sums], "toxic": pa.array([y for _, y in sums], pa.int32()), "n": pa.array(list(sums.values()), pa.int64())})

        for batch in batches:
            for ws, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.update((f, y) for f in {f for w in ws for f in features(w)})
                if len(sums) > 300_000:
                    yield out()
                    sums.clear()
        yield out()

    toxic = F.col("toxic") == 1
    counts = restored.mapInArrow(released(count), "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("n0"))
    bad, all_ = restored.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    expected = (F.col("n1") + F.col("n0")) * (bad / max(1, all_))
    names = [r[0] for r in counts.where((F.col("n1") >= 3) & (F.col("n1") > 1.5 * expected)).orderBy(F.desc((F.col("n1") - expected) / F.sqrt(expected + 1.0)), "feature").limit(CANDIDATES).collect()]
    wanted = frozenset(names)  # CANDIDATES strings

    def pick(batches):
        for batch in batches:
            found = [[f for w in ws for f in features(w) if f in wanted] for ws in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"found": pa.array(found, pa.list_(pa.string())), "toxic": pa.array(batch.column(1).to_pylist(), pa.int32())})

    rows = [(Counter(r[0]), r[1]) for r in restored.mapInArrow(released(pick), "found array<string>, toxic int").collect()]
    weights, intercept = _fit(rows, names) if 0 < bad < all_ else ({}, -4.6)
    return model, weights, intercept


class Scorer:
    """Scores texts by the words that they are restored to."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], intercept: float):
        self.decoder, self.weights, self.intercept = Decoder(model), weights, intercept
        self.telling: dict[str, tuple[str, ...]] = {}
        self.worth: dict[str, float] = {}

    def _learn(self, token: str) -> tuple[str, ...]:
        if len(self.telling) >= CACHE_WORDS:
            self.telling.clear()
            self.worth.clear()
        found = []
        for w in self.decoder._words(token):
            worth = sum(self.weights.get(f, 0.0) for f in features(w))
            if worth:
                self.worth[w] = worth
                found.append(w)
        if len(token) <= CACHE_LENGTH:
            self.telling[token] = tuple(found)
        return tuple(found)

    def score(self, text: str) -> float:
        hits: dict[str, float] = {}
        for token in _tokens(text, self.decoder):
            words = self.telling.get(token)
            if words is None:
                words = self._learn(token)
            for w in words:
                hits[w] = self.worth[w]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + math.fsum(hits.values())))))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Tokens that are oddly written, spaced or stretched are decoded by Viterbi under a character
    model of the whole corpus; passages of four or more single characters also into words.
    Tokens and passages of any length are decoded whole. The score is a logistic one over a text's distinct restored words
    and their beginnings, CANDIDATES features, fitted on at most LABELLED labelled documents
    outside the held-out third, copies once.

    Null and empty texts: the intercept's score. Without labels of both kinds: 0.01 everywhere.
    Rows that repeat are scored each. An empty table gives an empty result. Other columns are not
    read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            p = np.array([scorer.score(text or "") for text in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.7).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    asked = docs.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "text")
    return asked.mapInArrow(released(run), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents whose score is 0.7 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "") < 0.7 for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def _tokens(text: str, dec: Decoder) -> set[str]:
    """The distinct tokens of a text, and what its spaced out words spell."""
    low = text.lower()
    if not low.isascii():
        low = _HIDDEN.sub("", low)
    tokens = set(low.split())
    tokens.update(dec.spelt(low))
    return tokens
