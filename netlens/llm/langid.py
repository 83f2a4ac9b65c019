"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every document that may be learnt from. The
regression is fitted by follow-the-regularised-leader with elastic-net penalties on at
most ``PER_LANGUAGE`` different texts of each language (those with the least hash of
language and text), a fifth of which is held back to calibrate the temperature.

Defined results for odd input: a text that is null or has no letter is ``und`` with
score 0; with nothing to learn from, every text is ``und``; equal texts get equal
results; a text that has several languages is an example of each; of languages that are
equally likely the one that sorts first is taken; a null id is never held out and still
predicted; an empty table gives an empty result. Languages, sources and ids are never inputs
of a prediction, and only id, text and, to learn, language are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import by_bytes, held_out, texts_of, tidied
from netlens.llm.ftrl import Ftrl, softmax, temperature

BUCKETS, ORDERS, SCALE = 1 << 17, 3, 20.0
#: Most training documents of a language, and most passes over them.
PER_LANGUAGE, EPOCHS = 800, 3


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets[ORDERS, n], first gram of each text, whether it has a letter); grams are of lower-case letters and blanks."""
    framed = [f" {t.lower()}  ".encode("utf-32-le") for t in texts]
    size = np.fromiter(map(len, framed), np.int64, len(framed)) // 4
    code = np.frombuffer(b"".join(framed), np.uint32)
    letter = _letters()[code]
    at = np.cumsum(size) - size
    has = np.add.reduceat(letter, at) > 0
    c = np.where(letter, code, 32).astype(np.uint32)
    inner = np.ones(len(c), bool)
    inner[at + size - 1] = inner[at + size - 2] = False
    h, found = np.zeros(len(c), np.uint32), []
    for k in range(ORDERS):
        h = h[: len(c) - k] * np.uint32(0x01000193) ^ c[k:] * np.uint32(0x85EBCA6B) ^ np.uint32(k)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        padded = np.zeros(len(c), np.int64)
        padded[: len(mixed)] = (mixed >> np.uint32(8)) % np.uint32(BUCKETS)
        found.append(padded[inner])
    return np.stack(found), at - 2 * np.arange(len(at)), has


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # [BUCKETS, languages], idf and scale within
    bias: np.ndarray
    heat: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, best = ["und"] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t]
        if not some or not self.languages:
            return names, best
        found, at, has = grams([texts[i] for i in some])
        total = np.diff(np.append(at, found.shape[1])) * ORDERS
        score = sum(np.add.reduceat(self.weights[f], at, axis=0) for f in found) / total[:, None] + self.bias
        p = softmax(score.astype(np.float64) / self.heat)
        for i, k, q, h in zip(some, p.argmax(1).tolist(), p.max(1).tolist(), has.tolist(), strict=True):
            if h:
                names[i], best[i] = self.languages[k], min(1.0, q)
        return names, best


def _document_frequency(texts: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, n = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS, bool), 0
        for batch in by_bytes(batches, "text", 1 << 20):
            some = [t for t in texts_of(batch, "text") if t]
            if not some:
                continue
            found, at, _ = grams(some)
            for lo, hi in zip(at.tolist(), [*at.tolist()[1:], found.shape[1]], strict=True):
                seen[found[:, lo:hi].ravel()] = True
                df[:-1] += seen
                seen[:] = False
            n += len(some)
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "df"])

    total = np.zeros(BUCKETS + 1, np.int64)
    for r in texts.mapInArrow(tidied(run), "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():  # BUCKETS + 1 rows at most
        total[r.bucket] = r.df
    return total


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    own = own.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    place = F.xxhash64("lang", "text")
    sizes = {r.lang: r.n for r in own.select("lang", place.alias("place")).distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    df = _document_frequency(own.select("text"))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1.0
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))]), F.col("lang"))
    # about per_language rows of a language come through; copies are one, and the least of the rest are taken
    chosen = own.where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod(place, F.lit(1 << 30)), "text")
    chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("text", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            found, at, _ = grams(texts_of(batch, "text"))
            both = [np.unique(found[:, lo:hi], return_counts=True) for lo, hi in zip(at, np.append(at[1:], found.shape[1]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([b.astype(np.int32).tobytes() for b, _ in both]), pa.array([n.astype(np.int32).tobytes() for _, n in both])], ["lang", "bucket", "n"])

    rows = chosen.mapInArrow(tidied(vectors), "lang string, bucket binary, n binary").collect()  # per_language rows of each language at most
    data = []
    for r in rows:
        b, n = np.frombuffer(r.bucket, np.int32), np.frombuffer(r.n, np.int32)
        data.append((b.tobytes(), np.append(b, BUCKETS), np.append(n / n.sum() * idf[b] * SCALE, 1.0), languages.index(r.lang)))
    data = [d[1:] for d in sorted(data, key=lambda d: (d[3], d[0]))]
    order = np.random.default_rng(5).permutation(len(data))
    kept, back, seen = [], [], Counter()
    for i in order:  # every fifth example of a language is held back
        seen[data[i][2]] += 1
        (back if seen[data[i][2]] % 5 == 0 else kept).append(data[i])
    model = Ftrl(BUCKETS + 1, len(languages), alpha=1.0, l1=1e-3, l2=1e-3)
    for _ in range(EPOCHS):
        for example in kept:
            model.learn(*example)
    w = model.weights()
    logits = np.array([v @ w[b] for b, v, _ in back])
    heat = temperature(logits, np.array([t for *_, t in back], np.int64)) if back else 1.0
    return Model(languages, (w[:-1] * (idf * SCALE)[:, None]).astype(np.float32), w[-1], heat)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a number for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            names, best = shared.value.predict(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(best, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    schema = [kept.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return kept.mapInArrow(tidied(run), T.StructType(schema))
