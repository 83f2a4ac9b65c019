"""SimHash near-duplicate classes: pigeonhole blocks, a join on blocks, then a Hamming check.

Defined results for odd input: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; fewer words than a shingle make one
shingle of the whole sequence; repeated rows share their class; a null id takes part
in its class but never names it; an empty table gives an empty result. Only the id and
text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import by_bytes, checkpointed, free_name, released, texts_of, tidied

SEED = 42
#: Blocks of a fingerprint. Pairs at 2 bits or fewer leave two of four blocks untouched.
BLOCKS = 4
#: A block with more distinct fingerprints than this is linked through common neighbours instead of pairs.
CROWDED = 32
#: Parts over which the rows of one key are dealt.
SALTS = 64
_STEP = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over the ``words``-word shingles of a text, repeats included."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    width = min(words, len(tokens))
    n, ones, digest = len(tokens) - width + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):  # bounded memory however long the text
        part = tokens[at : min(at + _STEP, n) + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row; fp is the fingerprint as a signed long."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = np.array([fingerprint(t, words) for t in texts_of(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    schema = T.StructType([kept.schema["doc_id"], T.StructField("fp", T.LongType())])
    return kept.mapInArrow(tidied(run), schema)


def _bits_apart(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(u, v), u > v: verified links that connect whatever distinct fingerprints lie within ``radius`` bits.

    Two fingerprints within two bits agree in two of four 16-bit blocks, so they meet in
    one of six 32-bit keys. A key of few fingerprints is joined with itself and verified.
    In a crowded key, every fingerprint emits itself and its 64 one-bit neighbours: two
    fingerprints are within two bits exactly when they share such a point, and all that
    share one are within two bits of each other, so a star per point (at most 65 members)
    is exact without forming the pairs of the group.
    """
    if radius != 2:
        raise ValueError("the block layout is for a radius of two bits")
    fp = F.col("fp")
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(BLOCKS)]
    pairs = [(i, j) for i in range(BLOCKS) for j in range(i)]
    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for k, (i, j) in enumerate(pairs)]
    entries = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    marked = checkpointed(entries.join(sizes, "key"))
    few = marked.where(F.col("n") <= crowded)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    paired = a.join(b, "key").where((F.col("u") > F.col("v")) & (_bits_apart(F.col("u"), F.col("v")) <= radius)).select("u", "v")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    points = (
        marked.where(F.col("n") > crowded).select("fp").distinct()
        .select("fp", F.explode(masks).alias("mask"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    )
    stars = (
        points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        .select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
        .where((F.col("u") > F.col("v")) & (_bits_apart(F.col("u"), F.col("v")) <= radius))
    )
    return paired.unionByName(stars).distinct()


def with_least(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The rows with the least ``value`` of their key as ``name``. A key that holds most rows is dealt over ``SALTS`` parts."""
    salt = free_name(df, "salt")
    salted = df.withColumn(salt, F.pmod(F.xxhash64(value), F.lit(SALTS)))
    part = salted.groupBy(key, salt).agg(F.min(value).alias(name))
    least = part.groupBy(key).agg(F.min(name).alias(name))
    return salted.join(part.select(key, salt).join(least, key), [key, salt]).drop(salt)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over undirected (u, v) edges, for every node that has an edge.

    Alternates large-star and small-star steps until nothing changes (a number of rounds that
    grows with the logarithm of the edges); each keeps one row per edge, aggregates before it
    shuffles, deals the edges of a hub over many tasks, and is checkpointed.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        joined = with_least(both, "u", "v", "m").withColumn("m", F.least("u", "m"))
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        out = out.where(F.col("a") != F.col("b"))
        return out.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = checkpointed(edges)
    before = state(edges)
    while before[0]:
        last, edges = edges, checkpointed(star(star(edges, True), False))
        released(last)
        if (now := state(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row."""
    rows = checkpointed(fingerprints(docs, doc_id, text, words))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    root = components(links(distinct, radius)).withColumnsRenamed({"node": "fp"})
    named = distinct.join(root, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    by_fp = checkpointed(with_least(named, "root", "rep", "component_id").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
