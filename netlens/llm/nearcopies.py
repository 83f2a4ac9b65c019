"""Near copies of any stated similarity with wide SimHash fingerprints in pigeonhole blocks.

For corpora where near copies share, say, four fifths of their five-word shingles, 64 bits
and two differing bits are too narrow. Here a document has a SimHash of 1024 bits over its
distinct shingles, and its blocks are made of the shingles themselves: shingles are dealt
into buckets by their hash, so copies that differ in few shingles differ in few buckets
and agree in all others. The number of buckets follows the size of a document: a bucket
for each shingle up to ``BLOCKS``, then ``BLOCKS`` buckets up to 191 shingles, then three
to six shingles a bucket, of which ``BLOCKS`` buckets are kept. A document near the edge
of a size class emits the blocks of both classes, so sizes that differ within the
similarity still meet. This is hashing, not a pigeonhole guarantee over the fingerprint: a
pair at the similarity may share no block, which the tests measure by size.

Members of a block are joined with one representative, chosen by a hash that differs from
block to block, and verified by Hamming distance, at the angle that belongs to the
similarity. Within ``DOUBT`` bits of that angle (four deviations of the estimate), and
where one text has ``SMALL`` shingles or fewer, whatever their distance, the shingles of
the two texts are compared themselves.

A member that does not verify against the representative of a block may still be a copy of
another member. Such leftovers and the members of their blocks are compared by an exact
prefix filter: shingles are put into one order for all (rarest first, by a count sketch of
these documents), and two sets of the stated similarity share one of the first
n - ceil(similarity * n) + 1. Keys whose documents are linked already are dropped; the
documents of a key are compared with one of them first, and what that links is linked; pairs are then
formed only between documents not yet linked that have enough shingles left behind the shared
one (so a passage that many documents share pairs only those that are little else), and they
are verified as above. Classes are the connected components of verified links.

Defined results for odd input: as for ``simhash``; texts whose lower-case words agree are
exact copies; texts without words are copies of each other; a null id is never dropped. Of a
class the row with the least id stays, of rows with that id the one with the least digest of
its text, once: what is kept is a row, so different texts that share an id are judged each for
itself, and all stay that are not copies of anything.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import by_bytes, checkpointed, free_name, released, texts_of, tidied
from netlens.llm.simhash import SEED, components, with_least

WORDS, SIMILARITY, LANES, BLOCKS = 5, 0.8, 16, 32
_ODD = (np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Differing bits about the expected number among which the estimate is not trusted.
DOUBT = 46
#: Shingles up to which the estimate is not trusted at all.
SMALL = 200
_STEP = 1 << 15
#: Cells of the sketch that orders shingles by how many documents have them.
CELLS = 1 << 20
#: Cells of the filter that tells which rows to move, 16 bytes each as they are broadcast: 8 MB at most.
SIEVE = 1 << 19


def radius(similarity: float, bits: int = 64 * LANES) -> int:
    """Differing bits to expect of two equally large sets of this Jaccard similarity."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, int]:
    """Distinct shingle hashes of a text, and a hash of its words."""
    tokens = (text or "").encode().lower().split()
    hashed = xxhash.xxh64_intdigest
    whole = hashed(b" ".join(tokens), SEED)
    width, parts = min(words, len(tokens)), []
    for at in range(0, len(tokens) - width + 1 if tokens else 0, _STEP * 8):
        part = tokens[at : at + _STEP * 8 + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        parts.append(np.unique(np.fromiter((hashed(g, SEED) for g in grams), np.uint64)))
    return (np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)), whole


def wide_simhash(hashes: np.ndarray) -> bytes:
    """64 * LANES bits: a bit is set where over half the hashes have it."""
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        lanes = _mix(hashes[at : at + 255, None] * _ODD[None, :])
        ones += np.add.reduce(np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), -1), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _size_class(n: float) -> int:
    return -1 if n <= BLOCKS else max(BLOCKS.bit_length() - 1, int(math.log2(n / 3)))


def blocks(hashes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Distinct 64-bit keys of the blocks of a document."""
    n, out = len(hashes), []
    for k in {_size_class(n), _size_class(n * similarity)} if n else ():
        if k < 0:
            out.append(_mix(hashes + np.uint64(1)))
            continue
        mixed = _mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
        bucket = mixed >> np.uint64(64 - k) if k else np.zeros(n, np.uint64)
        kept = bucket < BLOCKS
        bucket, own = bucket[kept], hashes[kept]
        order = np.argsort(bucket, kind="stable")
        bucket, own = bucket[order], own[order]
        if len(own):
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out.append(_mix(np.add.reduceat(_mix(own), first) + bucket[first] * np.uint64(977) + np.uint64(k + 2)))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def digest(text: str):
    """128 bits of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest (of the text), node (hash of the words), size (shingles), wide (SimHash), keys (blocks): one row per input row."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), digest(text).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            node, size, wide, keys = [], [], [], []
            for t in texts_of(batch, "text"):
                hashes, whole = shingles(t, words)
                node.append(whole - (1 << 63))
                size.append(len(hashes))
                wide.append(wide_simhash(hashes))
                keys.append(blocks(hashes, similarity))
            made = [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], ["doc_id", "digest", "node", "size", "wide", "keys"])

    schema = [kept.schema["doc_id"], kept.schema["digest"], T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("wide", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return kept.mapInArrow(tidied(run), T.StructType(schema))


def sifted(df: DataFrame, keys: list[str], wanted: DataFrame, mark: str) -> DataFrame:
    """``df`` with a boolean ``mark`` that is true where its keys are in ``wanted``, and seldom elsewhere.

    A Bloom filter, two bits a key in 64-bit cells of four keys, of at most ``SIEVE`` cells: it may mark too many rows, so an exact
    join has to follow, but it never misses one, and what is not marked need not be moved.
    """
    cells = 1 << min(max(4, (wanted.count() // 4).bit_length()), SIEVE.bit_length() - 1)
    cell, mask, bits = (free_name(df, n) for n in ("cell", "mask", "bits"))
    h = f"xxhash64({', '.join(keys)})"
    places = [
        F.expr(f"{h} & {cells - 1}L").alias(cell),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, 52) & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned({h}, 58) & 63 as int))").alias(mask),
    ]
    filled = wanted.select(*places).groupBy(cell).agg(F.bit_or(mask).alias(bits))
    met = df.select("*", *places).join(F.broadcast(filled), cell, "left")
    return met.select(*df.columns, F.coalesce(F.col(bits).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False)).alias(mark))


def _texts(wanted: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``wanted`` (node, digest and more, a row per node) with the text of that digest. Only these texts are moved."""
    wanted = checkpointed(wanted)
    texts = sifted(docs.select(digest(text).alias("digest"), F.col(text).alias("text")), ["digest"], wanted, "near").where("near").drop("near")
    return checkpointed(texts.join(wanted, "digest").dropDuplicates(["digest"]).drop("digest"))


def _compared(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (node, head) pairs whose texts have this Jaccard similarity of shingles. ``texts`` has node and text of them at least."""
    met = pairs.join(texts.select("node", "text"), "node").join(texts.select(F.col("node").alias("head"), F.col("text").alias("other")), "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            known: dict[str, np.ndarray] = {}
            like = []
            for a, b in zip(texts_of(batch, "text"), texts_of(batch, "other"), strict=True):
                x = shingles(a, words)[0]
                if b not in known:
                    known[b] = shingles(b, words)[0]
                y = known[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                like.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("node", "head")], ["node", "head"]).filter(pa.array(like, pa.bool_()))

    return met.mapInArrow(tidied(run), "node long, head long")


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The rarest shingles of a document, one of which it shares with every set of this similarity."""
    n = len(hashes)
    kept = n - math.ceil(similarity * n - 1e-9) + 1
    order = np.lexsort((hashes, counts[(_mix(hashes) % np.uint64(CELLS)).astype(np.int64)]))
    return hashes[order[:kept]].view(np.int64)


def _open(found: DataFrame) -> DataFrame:
    """The entries of keys that can add a link: a leftover is among their documents, and not all are linked already."""
    return found.join(found.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("left").alias("l")).where("a <> b AND l").select("key"), "key")


def _prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, node, root, left, size, pos): the prefixes of leftovers and of the members of their blocks, by open keys.

    ``texts`` has node, text, root, left.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.int64)
        for batch in by_bytes(batches, "text", 2 << 20):
            for t in texts_of(batch, "text"):
                np.add.at(table, (_mix(shingles(t, words)[0]) % np.uint64(CELLS)).astype(np.int64), 1)
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], ["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    sums = texts.select("text").mapInArrow(tidied(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            size, keys = [], []
            for t in texts_of(batch, "text"):
                hashes = shingles(t, words)[0]
                size.append(len(hashes))
                keys.append(prefix(hashes, shared.value, similarity) if len(hashes) else np.zeros(0, np.int64))
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("node", "root", "left")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["node", "root", "left", "size", "keys"])

    found = texts.mapInArrow(tidied(run), "node long, root long, left boolean, size long, keys array<long>")
    found = checkpointed(found.select("node", "root", "left", "size", F.posexplode("keys").alias("pos", "key")))
    kept = checkpointed(_open(found))
    released(found)
    return kept


def _leftover_pairs(found: DataFrame, similarity: float, every: bool) -> DataFrame:
    """(node, head) of documents not linked yet that may have this similarity, where at least one is a leftover.

    Of prefix entries by open keys: every pair of a key, or the members of a key with one representative.
    """
    entry = ("node", "root", "left", "size", "pos")
    a, b = (found.select("key", *[F.col(c).alias(f"{c}_{x}") for c in entry]) for x in "ab")
    if not every:
        point = F.col("node").bitwiseXOR(F.xxhash64("key"))
        b = found.groupBy("key").agg(F.min(F.struct(point.alias("o"), *entry)).alias("head")).select("key", *[F.col(f"head.{c}").alias(f"{c}_b") for c in entry])
    fits = (F.col("size_a") >= similarity * F.col("size_b") - 1e-6) & (F.col("size_b") >= similarity * F.col("size_a") - 1e-6)
    # shingles lie in one order for all: at the first one that two sets share, no more can be common than what follows it in both
    follow = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    fits &= follow >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
    once = F.col("left_a") & (~F.col("left_b") | (F.col("node_a") > F.col("node_b"))) if every else F.col("left_a") | F.col("left_b")
    met = a.join(b, "key").where((F.col("root_a") != F.col("root_b")) & once & fits)
    return met.select(F.col("node_a").alias("node"), F.col("node_b").alias("head")).distinct()


def _named(distinct: DataFrame, root: DataFrame) -> DataFrame:
    return distinct.select("node", "rep").join(root, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))


def _tidy(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of many checkpoints, whose queries drop their shuffle files as they end; the session's setting is put back."""

    @wraps(step)
    def inner(docs: DataFrame, *args, **named) -> DataFrame:
        conf, key = docs.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        given = conf.get(key, None)
        conf.set(key, "true")
        try:
            made = step(docs, *args, **named)
        finally:
            if given is None:
                conf.unset(key)
            else:
                conf.set(key, given)
        return made.select("*")  # a plan of its own, under the setting as it was

    return inner


@_tidy
def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, root, component_id), one row per input row: its text, its class and the smallest id of that."""
    rows = checkpointed(signatures(docs, doc_id, text, words, similarity))
    lanes = [F.expr(f"cast(conv(hex(substring(wide, {8 * i + 1}, 8)), 16, -10) as bigint)") for i in range(LANES)]
    distinct = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("digest").alias("digest"), F.min("size").alias("size"), F.min("wide").alias("wide"), F.min("keys").alias("keys"))
    distinct = checkpointed(distinct.select("node", "rep", "digest", "size", F.array(*lanes).alias("wide"), "keys"))
    wide = distinct.select("node", "size", "wide")
    far = F.expr(" + ".join(f"bit_count(wide[{i}] ^ other[{i}])" for i in range(LANES)))

    def verified(pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """Those (node, head) that have the similarity; texts that are at hand already need not be fetched."""
        both = pairs.join(wide, "node").join(wide.select(F.col("node").alias("head"), F.col("size").alias("size_o"), F.col("wide").alias("other")), "head")
        least, most = F.least("size", "size_o"), F.greatest("size", "size_o")
        both = both.where(least >= similarity * most - 1e-6).select("node", "head", far.alias("far"), (least <= SMALL).alias("small"))
        both = checkpointed(both.where(F.col("small") | (F.col("far") <= radius(similarity) + DOUBT)))
        sure = ~F.col("small") & (F.col("far") <= radius(similarity) - DOUBT)
        sure, doubted = both.where(sure).select("node", "head"), both.where(~sure).select("node", "head")
        if texts is None:
            nodes = doubted.select("node").unionByName(doubted.select(F.col("head").alias("node"))).distinct()
            texts = _texts(nodes.join(distinct.select("node", "digest"), "node"), docs, text)
        return checkpointed(sure.unionByName(_compared(doubted, texts, words, similarity)))

    entries = distinct.select("node", F.explode("keys").alias("key"))
    # the representative is the member nearest to a point that differs from block to block, by exclusive or
    point = F.xxhash64("key")
    heads = entries.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(point)).alias("o"), F.count("*").alias("n")).where("n > 1")
    heads = heads.select("key", F.col("o").bitwiseXOR(point).alias("head"), (F.col("n") > 2).alias("many"))
    met = checkpointed(entries.join(heads, "key").where(F.col("node") != F.col("head")))
    agreed = verified(met.select("node", "head").distinct())
    edges = agreed.select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")).distinct()
    named = checkpointed(_named(distinct, components(edges)))
    # members of blocks of three or more, where one of them did not verify against the head
    members = met.where("many").select("node", "head", "key").join(agreed.withColumn("ok", F.lit(True)), ["node", "head"], "left")
    members = checkpointed(members.select("node", "key", F.col("ok").isNull().alias("left")))
    parts = members.join(members.where("left").select("key").distinct(), "key", "left_semi").groupBy("node").agg(F.max("left").alias("left"))
    parts = checkpointed(parts.join(named.select("node", "root"), "node"))
    if not parts.isEmpty():
        texts = _texts(parts.join(distinct.select("node", "digest"), "node"), docs, text)
        found = _prefixes(texts, words, similarity)
        for every in (False, True):  # what the representatives link need not be paired
            more = verified(_leftover_pairs(found, similarity, every), texts)
            linked = more.join(named.select("node", "root"), "node").join(named.select(F.col("node").alias("head"), F.col("root").alias("to")), "head")
            again = components(linked.select(F.greatest("root", "to").alias("u"), F.least("root", "to").alias("v")).where("u <> v").distinct())
            again = checkpointed(again.select(F.col("node").alias("root"), F.col("root").alias("top")))
            named = checkpointed(named.join(again, "root", "left").select("node", "rep", F.coalesce("top", "root").alias("root")))
            if not every:
                found = checkpointed(_open(found.join(again, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")))
    by_node = checkpointed(with_least(named, "root", "rep", "component_id").select("node", "root", "component_id"))
    return rows.select("doc_id", "digest", "node").join(by_node, "node").select("doc_id", "digest", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, and the rows without an id. Columns are unchanged."""
    found = checkpointed(classes(docs, doc_id, text, words, similarity).where(F.col("doc_id").isNotNull()))
    key, mark = free_name(docs, "digest"), free_name(docs, "kept")
    kept = found.where(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias(mark))
    kept = checkpointed(kept.select(F.col(f"{mark}.doc_id").alias(doc_id), F.col(f"{mark}.digest").alias(key)).distinct())
    # rows that are kept and stand alone stay where they are; only the others, which may go, are moved
    alone = found.groupBy(F.col("doc_id").alias(doc_id), F.col("digest").alias(key)).agg(F.count("*").alias(mark))
    may_go = checkpointed(alone.join(kept.withColumn("stays", F.lit(True)), [doc_id, key], "left").where(F.col("stays").isNull() | (F.col(mark) > 1)).select(doc_id, key))
    named = sifted(docs.where(F.col(doc_id).isNotNull()).withColumn(key, digest(text)), [f"`{doc_id}`", f"`{key}`"], may_go, mark)
    moved = named.where(F.col(mark)).join(kept, [doc_id, key], "left_semi").dropDuplicates([doc_id, key])
    return named.where(~F.col(mark)).select(docs.columns).unionByName(moved.select(docs.columns)).unionByName(docs.where(F.col(doc_id).isNull()))
