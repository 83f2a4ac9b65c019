"""Benchmark decontamination by winnowing.

A text is a sequence of words. Every ``gram`` consecutive words get a hash; of each
``window`` consecutive hashes the least is kept. Two texts that share
``gram + window - 1`` words in a row therefore share a kept hash. Kept hashes of
documents are joined with those of the benchmark, hits are extended to the whole
shared span and compared word by word, so the result is exact.

Results depend on texts alone: where the index of the benchmark is small it is sent to the
tasks that read the documents; otherwise distinct texts and items meet by shuffle, and each
text moves once for every ``ITEMS`` items that it may hold.

Defined results for odd input: a null text has no words; an item without words
matches nothing; an item shorter than a span is matched as a whole; repeated rows get
equal results and rows of one id are judged by their own texts, as are rows without an id;
items of one id are counted once, whichever of them occurs; an empty benchmark marks
nothing; an empty table gives an empty result; a null item id counts as the text ``null``.
Only ids and texts are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import by_bytes, checkpointed, free_name, tidied, utf8_view

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: UTF-8 bytes of benchmark ids and texts up to which its index is made in the driver and broadcast (it takes
#: about eight times that, see ``Index.nbytes``); a larger benchmark is joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Items that a text is compared with at once where they are joined by shuffle.
ITEMS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BLOCK = 1 << 20
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_P, -1, 1 << 64)
        _POWERS[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (_P, inverse))
    return _POWERS[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts laid end to end; ``at`` has each text's first word, and one more."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    hash: np.ndarray = field(repr=False)

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[j] : self.end[j]].tobytes() for j in range(i, i + n))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = _LOWER[data]
    inside = _IS_WORD[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, ~inside[:-1]
    edge = offsets[:-1]
    first[edge[edge < len(data)]] = True
    start = np.flatnonzero(inside & first)
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, ~inside[1:]
    edge = offsets[1:] - 1
    last[edge[edge >= 0]] = True
    end = np.flatnonzero(inside & last) + 1
    hashes, i = np.empty(len(start), np.uint64), 0
    while i < len(start):  # blocks bound the memory of the sums
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        lo, hi = start[i], end[j - 1]
        up, down = _powers(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        hashes[i:j] = _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return Words(data, start, end, np.searchsorted(start, offsets), hashes)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the n words from each word on, and whether they lie in one text."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total = total * np.uint64(_Q) + words.hash[i : i + m]
    doc = words.doc()
    return _mix(total), doc[:m] == doc[n - 1 :]


def winnowed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The least gram hash of the window that begins at each word, and whether that window lies in one text."""
    hashes, _ = grams(words, GRAM)
    m = len(hashes) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least = hashes[:m].copy()
    for i in range(1, WINDOW):
        np.minimum(least, hashes[i : i + m], out=least)
    doc = words.doc()
    return least, doc[:m] == doc[SPAN - 1 :][:m]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


class Index:
    """Fingerprints of benchmark items, and the hash and place of each of their spans."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.ids = [i for i, _ in items]
        texts = [(t or "").encode() for _, t in items]
        self.words = words_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        self.item = self.words.doc().astype(np.int32)
        size = np.diff(self.words.at)[self.item] if len(self.item) else np.zeros(0, np.int64)
        self.spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(size, SPAN)).tolist():
            hashes, valid = grams(self.words, n)
            at = np.flatnonzero(valid & (np.minimum(size, SPAN)[: len(valid)] == n))
            order = np.argsort(hashes[at], kind="stable")
            self.spans[n] = hashes[at[order]], at[order].astype(np.int32)
        least, valid = winnowed(self.words)
        self.kept = np.unique(least[valid])

    @property
    def nbytes(self) -> int:
        w = self.words
        arrays = [w.data, w.start, w.end, w.at, w.hash, self.item, self.kept, *(a for pair in self.spans.values() for a in pair)]
        return sum(a.nbytes for a in arrays) + sum(len(i) + 64 for i in self.ids)

    def _items(self, words: Words, i: int, n: int, lo: int, hi: int) -> set[str]:
        """Items that have the n words at place i, among the spans lo to hi of like hash."""
        own, starts = words.text(i, n), self.spans[n][1][lo:hi].tolist()
        return {self.ids[self.item[k]] for k in starts if self.words.text(k, n) == own}

    def hits(self, words: Words) -> list[tuple[int, int, set[str]]]:
        """(first word, number of words, items) of every occurrence of a benchmark span."""
        found = []
        for n, (known, _) in self.spans.items():
            if n == SPAN:
                least, valid = winnowed(words)
                if not len(least):
                    continue
                new = np.ones(len(least), bool)
                new[1:] = least[1:] != least[:-1]
                joined = _among(least[new], self.kept)[np.cumsum(new) - 1] & valid
                at = np.flatnonzero(joined)
                hashes = np.zeros(len(at), np.uint64)
                for i in range(n):
                    hashes = hashes * np.uint64(_Q) + words.hash[at + i]
                hashes = _mix(hashes)
            else:
                hashes, valid = grams(words, n)
                at = np.flatnonzero(valid)
                hashes = hashes[at]
            same = _among(hashes, known)
            at, hashes = at[same], hashes[same]
            lo, hi = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            for i, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                if items := self._items(words, i, n, a, b):
                    found.append((i, n, items))
        return found


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_SCHEMA = [
    ("n_words", T.LongType(), pa.int64()), ("n_hit", T.LongType(), pa.int64()), ("n_items", T.LongType(), pa.int64()),
    ("items_sha256", T.StringType(), pa.string()), ("contaminated", T.BooleanType(), pa.bool_()),
]


def _marked(words: Words, hits) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Hit words of each text, and the items that hit it."""
    change, items, doc = np.zeros(len(words.hash) + 1, np.int64), defaultdict(set), None
    for i, n, found in hits:
        change[i] += 1
        change[i + n] -= 1
        items[int(np.searchsorted(words.at, i, "right")) - 1].update(found)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return inside[words.at[1:]] - inside[words.at[:-1]], items


def _scan(docs: DataFrame, index, doc_id: str) -> DataFrame:
    kept = docs.select(F.col(doc_id).alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in by_bytes(batches, "text", 2 << 20):
            words = words_of(*utf8_view(batch.column(1)))
            n_hit, items = _marked(words, known.hits(words))
            none = _digest(())
            columns = [
                np.diff(words.at), n_hit, [len(items.get(i, ())) for i in range(batch.num_rows)],
                [_digest(items[i]) if i in items else none for i in range(batch.num_rows)], n_hit > 0,
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, (_, _, t) in zip(columns, _SCHEMA, strict=True))], ["doc_id", *(n for n, *_ in _SCHEMA)]
            )

    return kept.mapInArrow(tidied(run), T.StructType([kept.schema["doc_id"], *(T.StructField(n, t) for n, t, _ in _SCHEMA)]))


def _fingerprint_rows(df: DataFrame, keep: list[str], runs: list[int]) -> DataFrame:
    """``keep`` and (kind, fp) for each distinct fingerprint of a row: kind 0 is a kept hash, kind n a whole run of n words, for n in ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            words = words_of(*utf8_view(batch.column(batch.schema.get_field_index("text"))))
            parts = []
            doc = words.doc()
            for kind in (0, *runs):
                value, valid = grams(words, kind) if kind else winnowed(words)
                at = np.flatnonzero(valid)
                parts.append(np.stack([doc[at], np.full(len(at), kind), value[at].view(np.int64)], 1))
            rows = np.unique(np.concatenate(parts), axis=0)
            row = pa.array(rows[:, 0])
            own = [batch.column(batch.schema.get_field_index(k)).take(row) for k in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(rows[:, 1]), pa.array(rows[:, 2])], [*keep, "kind", "fp"])

    return df.mapInArrow(tidied(run), T.StructType([*(df.schema[k] for k in keep), T.StructField("kind", T.LongType()), T.StructField("fp", T.LongType())]))


_N_WORDS = r"size(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0))"


def _rid(text: str):
    """128 bits of a digest stand for a text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)


def _by_text(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(rid, n_hit, n_items, joined) of the distinct texts that an item of the benchmark occurs in; docs has ``text``."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), _rid("text").alias("rid")).dropDuplicates(["rid"])
    own = items.withColumns({"n": F.expr(_N_WORDS), "iid": F.xxhash64("item_id", "text")}).where("n > 0")
    runs = sorted(r.n for r in own.where(F.col("n") < SPAN).select("n").distinct().collect())  # SPAN - 1 at most
    few = _fingerprint_rows(own, ["item_id", "iid", "n"], runs).where(F.when(F.col("n") < SPAN, F.col("kind") == F.col("n")).otherwise(F.col("kind") == 0))
    pairs = _fingerprint_rows(texts, ["rid"], runs).join(few.select("item_id", "iid", "kind", "fp"), ["kind", "fp"]).select("rid", "item_id", "iid").distinct()
    pairs = checkpointed(pairs)
    parts = pairs.groupBy("rid").agg(F.ceil(F.count("*") / ITEMS).alias("parts"))
    dealt = pairs.join(parts, "rid").withColumn("part", F.pmod(F.xxhash64("iid", "item_id"), "parts"))
    met = dealt.join(own.select("item_id", "iid", F.col("text").alias("item_text")), ["item_id", "iid"])
    met = met.groupBy("rid", "part").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))  # about ITEMS of them
    met = met.join(texts, "rid").select("rid", "items", "text")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in by_bytes(batches, "text", 2 << 20):
            ids, covered, found = [], [], []
            for rid, items, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rid", "items", "text")), strict=True):
                data = text.encode()
                words = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                hits = Index([(x["item_id"], x["item_text"]) for x in items]).hits(words)
                runs_: list[list[int]] = []
                for i, n, _ in sorted(hits, key=lambda h: h[:2]):
                    if runs_ and i <= runs_[-1][1]:
                        runs_[-1][1] = max(runs_[-1][1], i + n)
                    else:
                        runs_.append([i, i + n])
                ids.append(rid)
                covered.append([{"lo": a, "hi": b} for a, b in runs_])
                found.append(sorted(set().union(*(k for *_, k in hits))))
            columns = [pa.array(ids, pa.binary()), pa.array(covered, spans), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "spans", "ids"])

    hits = met.mapInArrow(tidied(extend), "rid binary, spans array<struct<lo:long,hi:long>>, ids array<string>").where(F.size("ids") > 0)
    by_row = hits.groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    covered = F.expr("aggregate(spans, named_struct('n', 0L, 'at', 0L), (a, x) -> named_struct('n', a.n + greatest(0, x.hi - greatest(a.at, x.lo)), 'at', greatest(a.at, x.hi)), a -> a.n)")
    return by_row.select("rid", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("joined"))


def _join(docs: DataFrame, items: DataFrame, doc_id: str) -> DataFrame:
    """The same result for a benchmark of any size: fingerprints meet in a shuffle join, then each text is extended."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), _rid("text").alias("rid"), F.expr(_N_WORDS.replace("text", "coalesce(text, '')")).cast("long").alias("n_words"))
    return rows.join(_by_text(docs, items), "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _index(items: DataFrame, broadcast_bytes: int) -> Index | None:
    """The benchmark's index, unless it is too large to broadcast."""
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 32)).first()[0] or 0
    return None if size > broadcast_bytes else Index([(r.item_id, r.text) for r in items.collect()])  # at most broadcast_bytes


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    docs, items = docs.select(F.col(doc_id), F.col(text).alias("text")), _items(benchmark)
    if (index := _index(items, broadcast_bytes)) is None:
        return _join(docs, items, doc_id)
    return _scan(docs, docs.sparkSession.sparkContext.broadcast(index), doc_id)


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of whose text no word lies in a benchmark span; columns are unchanged."""
    items = _items(benchmark)
    if (index := _index(items, broadcast_bytes)) is None:
        key = free_name(docs, "rid")
        found = _by_text(docs.select(F.col(text).alias("text")), items).select(F.col("rid").alias(key))
        return docs.withColumn(key, _rid(text)).join(found, key, "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, 2 << 20):
            words = words_of(*utf8_view(batch.column(batch.schema.get_field_index(text))))
            n_hit, _ = _marked(words, shared.value.hits(words))
            yield batch.filter(pa.array(n_hit == 0, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


#: DuckDB: every window of ten words, matched by text.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS span
  FROM b, LATERAL (SELECT unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM d, lens, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) WHERE len(w) >= n
), hit AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.span = bw.span AND dw.n = bw.n
), covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM hit, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS k) GROUP BY r
), named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
