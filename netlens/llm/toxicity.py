"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character language model is counted over every document. A written word is read as
a lattice: each symbol may stand for itself or for the letters it imitates, runs of a
letter may be one or two of it, separators inside a word may be nothing, and the gaps
of a row of fragments of one or two characters, whatever white space they are, may or may
not be blanks. The likeliest reading under channel and language model is found by Viterbi
search over the whole word or row, however long. A word whose lattice has one path only is
its own reading, so only words with such marks are searched; words without any letter are
searched like others, and the language model decides whether a number stays one.

The score is a logistic regression on the presence and the density of restored words,
their beginnings and their inner strings, fitted by follow-the-regularised-leader with elastic-net
penalties on at most ``PER_CLASS`` labelled documents of each class (those with the
least hash of their id). Features are found and counted in tasks; the driver gets the counts
of features that several toxic documents of the sample have, and the examples in these.

Defined results for odd input: a null or empty text has the score of a text without
features; without labels of both classes every score is 0; a document labelled twice
counts as toxic if one label says so, and so does a text that several documents share; a
labelled id that several documents have counts with its least text; labels other than 0 and
1 are ignored; equal texts get equal scores; of readings that are equally likely the one whose
symbols stand first in the lattice is taken; an empty table gives an empty result. Labels,
languages, sources and ids are never inputs of a score, and only id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import by_bytes, checkpointed, held_out, texts_of, tidied
from netlens.llm.ftrl import Ftrl, temperature
from netlens.llm.langid import _letters

THRESHOLD = 0.7
#: Most labelled documents of a class that the regression is fitted on; passes over them.
PER_CLASS, EPOCHS = {1: 1500, 0: 3000}, 4
#: Toxic documents of the sample that must have a feature; tasks over which the sample is spread.
LEAST_TOXIC, SPREAD = 3, 16
ORDER, BUCKETS = 4, 1 << 20
REMEMBERED = 300_000
#: Letters that a symbol may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "×": "x",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "*": "aeiou", "#": "aeiou",
}
_SEPARATORS = ".-_*~'’·"
_ODD = re.compile("[" + re.escape("".join(READINGS)) + r"]|([^\W\d_])\1\1|[^\W\d_][" + re.escape(_SEPARATORS) + r"]+[^\W\d_]")
#: A row of fragments of one or two characters.
_SPACED = re.compile(r"(?<!\S)\S{1,2}+(?:\s++\S{1,2}+(?!\S))+")
_WORD = re.compile(r"[^\W\d_]+")


def _fold(h: int, c: int) -> int:
    return ((h * 1000003) ^ c) & 0xFFFFFFFF


class CharacterModel:
    """P(letter | up to three letters before it) from hashed counts, interpolated over orders."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # [ORDER, BUCKETS]; order k counts strings of k + 1 symbols
        self.total = max(1.0, float(counts[0].sum()))
        self.known: dict[tuple[str, str], float] = {}

    def _count(self, s: str) -> float:
        h = len(s)
        for c in s:
            h = _fold(h, ord(c))
        return float(self.counts[len(s) - 1][h % BUCKETS])

    def log(self, before: str, c: str) -> float:
        key = (before, c)
        if (found := self.known.get(key)) is None:
            p = (self._count(c) + 0.1) / (self.total + 100)
            for k in range(1, ORDER):
                context = before[-k:]
                # what follows a context is counted by the strings that extend it
                n = self._count(context + c)
                seen = self._context(context)
                p = (n + 4 * p) / (seen + 4)
            found = self.known[key] = math.log(p)
            if len(self.known) > 500_000:
                self.known.clear()
        return found

    def _context(self, context: str) -> float:
        h = 100 + len(context)
        for c in context:
            h = _fold(h, ord(c))
        return float(self.counts[len(context)][h % BUCKETS])


def count_characters(texts: DataFrame) -> np.ndarray:
    """Hashed counts of strings of one to four symbols and of their contexts, over all texts.

    Every task adds up its own table and emits the cells that are not zero, so what is
    shuffled follows the number of tasks and the variety of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ORDER * BUCKETS, np.int64)
        for batch in by_bytes(batches, "text", 1 << 19):
            joined = (" " + " ".join(texts_of(batch, "text")).lower() + " ").encode("utf-32-le")
            c = np.frombuffer(joined, np.uint32)
            c = np.where(_letters()[c], c, np.uint32(32))
            past = [np.concatenate([np.full(k, 32, np.uint32), c[: len(c) - k]])[: len(c)] for k in range(1, ORDER)]
            for k in range(1, ORDER - 1):
                past[k] = np.where(past[k - 1] == 32, np.uint32(32), past[k])
            kept = (c != 32) | (past[0] != 32)
            c, past = c[kept], [p[kept] for p in past]
            for k in range(ORDER):
                symbols = [*reversed(past[:k]), c]
                for start, part in ((k + 1, symbols), *(((100 + k, symbols[:-1]),) if k else ())):
                    h = np.full(len(c), start, np.uint32)  # arithmetic modulo 2 ** 32, as in _fold
                    for x in part:
                        h *= np.uint32(1000003)
                        h ^= x
                    h &= np.uint32(BUCKETS - 1)
                    table[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(h, minlength=BUCKETS)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["cell", "n"])

    total = np.zeros(ORDER * BUCKETS, np.float32)
    cells = texts.mapInArrow(tidied(run), "cell int, n long").groupBy("cell").agg(F.sum("n").cast("float").alias("n"))
    found = cells.toArrow()  # ORDER * BUCKETS cells at most
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    return total.reshape(ORDER, BUCKETS)


class Reader:
    """Restores obfuscated words."""

    def __init__(self, model: CharacterModel):
        self.model = model

    def _options(self, word: str, spaced: bool) -> list[list[tuple[str, float]]]:
        out, i = [], 0
        while i < len(word):
            c, j = word[i], i + 1
            while j < len(word) and word[j] == c:
                j += 1
            run = j - i
            if c == " " and spaced:
                out += [[("", -0.7), (" ", -0.7)]]
            elif c.isalpha() and c not in READINGS:
                out += [[(c, -0.5), (c * 2, -0.9)]] if run > 2 else [[(c, 0.0)]] * run if run == 1 else [[(c * 2, -0.2), (c, -1.8)]]
            else:
                own = [(c, -0.3 if c.isalpha() else -4.0)]
                own += [(x, -1.2) for x in READINGS.get(c, "")]
                own += [("", -1.0)] if c in _SEPARATORS else []
                out += [own] * min(run, 2 if run > 2 else run)
            i = j
        return out

    def step(self, score: float, context: str, read: str, cost: float) -> tuple[float, str]:
        """Score and context after one more reading of a symbol."""
        score += cost
        for c in read:
            if c.isalpha():
                score += self.model.log(context, c)
                context = context[1:] + c
            else:
                score += self.model.log(context, " ") if context[-1] != " " else 0.0
                context = "   "
        return score, context

    def read(self, word: str, spaced: bool = False) -> str:
        """The likeliest reading of a lower-case word, or of a row of fragments between single blanks."""
        done: list[str] = []
        known, log, step = self.model.known, self.model.log, self.step
        # by context: score and text, as a chain of (the one before, reading). Where all paths have one context, what
        # they share is put away and its score with it, since only differences between paths count
        context, states = "   ", None
        for options in self._options(word, spaced):
            if states is None and len(options) == 1:
                read = options[0][0]
                done.append(read)
                context = (context + read)[-3:] if read.isalpha() else "   " if read else context
                continue
            if states is None:
                states = {context: (0.0, None)}
            after: dict[str, tuple[float, tuple | None]] = {}
            for context, (score, chain) in states.items():
                for read, cost in options:
                    if len(read) == 1 and read.isalpha():
                        if (p := known.get((context, read))) is None:
                            p = log(context, read)
                        s, ctx = score + cost + p, context[1:] + read
                    else:
                        s, ctx = step(score, context, read, cost)
                    if (old := after.get(ctx)) is None or s > old[0]:
                        after[ctx] = (s, (chain, read))
            states = after
            if len(after) == 1:
                ((context, (_, chain)),) = after.items()
                done.append(_text(chain))
                states = None
        if states is None:
            return "".join(done)
        ends = (step(s, ctx, " " if ctx[-1] != " " else "", 0.0)[0] for ctx, (s, _) in states.items())
        best = max((end, _text(chain)) for end, (_, chain) in zip(ends, states.values(), strict=True))
        return "".join(done) + best[1]


def _text(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        chain, read = chain
        out.append(read)
    return "".join(reversed(out))


def _features(word: str) -> list[str]:
    out: list[str] = []
    for part in _WORD.findall(word):
        out.append("=" + part)
        if (n := len(part)) > 4:
            out += ["^" + part[:k] for k in range(4, min(8, n))]
            out += [part[i : i + 5] for i in range(n - 4)]
    return out


class Scorer:
    """A fitted model; a worker remembers which features each written word has."""

    def __init__(self, counts: np.ndarray, weights: dict[str, tuple[float, float]], bias: float, heat: float):
        self.counts, self.weights, self.bias, self.heat = counts, weights, bias, heat
        self.reader = Reader(CharacterModel(counts))
        self.seen: dict[str, tuple[str, ...]] = {}
        self.rows: dict[str, tuple[str, ...]] = {}

    def __reduce__(self):
        return Scorer, (self.counts, self.weights, self.bias, self.heat)

    def readings(self, word: str, spaced: bool = False) -> tuple[str, ...]:
        """The word as written and, where its lattice has more than one path, as restored."""
        if not spaced and not _ODD.search(word):
            return (word,)
        return (word, self.reader.read(word, spaced))

    def joined(self, row: str) -> list[str]:
        """The words that a row of fragments was made of, without those that are written so."""
        row = " ".join(row.split())
        written = set(row.split())
        return [w for w in self.reader.read(row, True).split() if w not in written]

    def forget(self) -> None:
        """Workers live on after a task; what they remember of it should not."""
        self.seen.clear()
        self.rows.clear()
        self.reader.model.known.clear()

    def _known(self, readings, only) -> tuple[str, ...]:
        found: dict[str, None] = {}
        for r in readings:
            found |= dict.fromkeys(_features(r) if only is None else [f for f in _features(r) if f in only])
        return tuple(found)

    def found(self, text: str, only=()) -> tuple[Counter, int]:
        """How often each feature occurs in the restored text (those in ``only``; None: all), and the number of words."""
        text = text.lower()
        words = Counter(text.split())
        if len(self.seen) + 4 * len(self.rows) > (REMEMBERED if only is not None else REMEMBERED // 10):
            self.seen.clear()
            self.rows.clear()
        seen, rows, counts = self.seen, self.rows, Counter()
        for w, n in words.items():
            if (own := seen.get(w)) is None:
                own = seen[w] = self._known(self.readings(w), only)
            for f in own:
                counts[f] += n
        for row, n in Counter(_SPACED.findall(text)).items():
            if (own := rows.get(row)) is None:
                own = self._known(self.joined(row), only)
                if len(row) <= 64:
                    rows[row] = own
            for f in own:
                counts[f] += n
        return counts, sum(words.values())

    def score(self, text: str) -> float:
        counts, n = self.found(text, self.weights)
        x = self.bias
        for f in sorted(counts):
            there, dense = self.weights[f]
            x += there + dense * _density(counts[f], n)
        x /= self.heat
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _density(count: int, words: int) -> float:
    """Near 0 for a feature that is rare for the length of its text, at most 2."""
    return min(2.0, 80 * count / max(words, 40))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, per_class: dict[int, int]) -> DataFrame:
    """(text, toxic): different texts of at most ``per_class`` labelled documents of each class that may be learnt from."""
    named = labels.select(F.col("doc_id"), F.col("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    named = named.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    least = lambda k: named.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(per_class[k])
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = own.join(F.broadcast(least(0).unionByName(least(1))), "doc_id")  # bounded by per_class
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return checkpointed(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(SPREAD, F.xxhash64("text")))


def _count_features(rows: DataFrame, scorer: Scorer, only: frozenset[str] | None, least: int) -> dict[str, int]:
    """In how many of the texts each feature occurs, counted in tasks; those in ``least`` texts or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in by_bytes(batches, "text", 1 << 20):
            for t in texts_of(batch, "text"):
                counts.update(scorer.found(t, only)[0].keys())
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["feature", "n"])

    found = rows.select("text").mapInArrow(tidied(run), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    return dict(zip(found["feature"].to_pylist(), found["n"].to_pylist(), strict=True))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: dict[int, int] | None = None) -> Scorer | None:
    """None where labels of one class are missing."""
    rows = sample(docs, labels, doc_id, text, per_class or PER_CLASS)
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if set(n) != {0, 1}:
        return None
    counts_of_letters = count_characters(docs.select(F.col(text).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(counts_of_letters, {}, 0.0, 1.0))
    plain = _Shared(shared)
    bad = _count_features(rows.where("toxic = 1"), plain, None, LEAST_TOXIC)
    good = _count_features(rows.where("toxic = 0"), plain, frozenset(bad), 1)
    # a feature of few toxic documents, or about as usual in clean ones, tells nothing
    kept = sorted(f for f, k in bad.items() if k / n[1] > 4 * (good.get(f, 0) + 0.5) / n[0])
    number = {f: i for i, f in enumerate(kept)}

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            at, times, size = [], [], []
            for t in texts_of(batch, "text"):
                counts, words = plain.found(t, number)
                own = sorted((number[f], k) for f, k in counts.items())
                at.append([i for i, _ in own])
                times.append([k for _, k in own])
                size.append(words)
            ints = pa.list_(pa.int32())
            made = [pa.array(at, ints), pa.array(times, ints), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("toxic")), *made], ["toxic", "at", "times", "size"])

    made = rows.mapInArrow(tidied(examples), "toxic int, at array<int>, times array<int>, size long").toArrow().to_pylist()  # per_class rows at most of each class
    made.sort(key=lambda r: (r["toxic"], r["size"], r["at"], r["times"]))
    model = Ftrl(2 * len(kept) + 1, 2, alpha=0.3, l1=0.3, l2=0.01)
    data = []
    for r in made:
        at = r["at"] + [len(kept) + i for i in r["at"]] + [2 * len(kept)]
        data.append((np.array(at), np.array([1.0] * len(r["at"]) + [_density(k, r["size"]) for k in r["times"]] + [1.0]), r["toxic"]))
    order = np.random.default_rng(3).permutation(len(data))
    for _ in range(EPOCHS):
        for i in order:
            model.learn(*data[i])
    w = model.weights()
    logit = w[:, 1] - w[:, 0]
    values = np.array([value @ logit[at] for at, value, _ in data])
    heat = temperature(np.stack([np.zeros(len(values)), values], 1), np.array([y for *_, y in data]))
    weights = {f: (float(logit[i]), float(logit[len(kept) + i])) for f, i in number.items() if logit[i] or logit[len(kept) + i]}
    return Scorer(counts_of_letters, weights, float(logit[-1]), max(heat, 0.5))


class _Shared:
    """A broadcast scorer that tasks use for features only; each use with other features forgets what was remembered."""

    def __init__(self, shared):
        self.shared, self.only = shared, ()

    def __reduce__(self):
        return _Shared, (self.shared,)

    def found(self, text: str, only) -> tuple[Counter, int]:
        scorer = self.shared.value
        if only is not self.only:
            scorer.seen.clear()
            scorer.rows.clear()
            self.only = only
        return scorer.found(text, only)


def scores(docs: DataFrame, scorer: Scorer | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    if scorer is None:
        return kept.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # ORDER * BUCKETS numbers and the weights of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in by_bytes(batches, "text", 2 << 20):
            found = [model.score(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64()), pa.array([int(s >= THRESHOLD) for s in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])
        model.forget()

    schema = [kept.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return kept.mapInArrow(tidied(run), T.StructType(schema))


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic; columns are unchanged and rows without an id are judged by their own text."""
    scorer = train(docs, labels, doc_id, text)
    if scorer is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, 2 << 20):
            yield batch.filter(pa.array([shared.value.score(t) < THRESHOLD for t in texts_of(batch, text)], pa.bool_()))
        shared.value.forget()

    return docs.mapInArrow(tidied(run), docs.schema)
