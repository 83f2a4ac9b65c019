"""Multi-pattern search: which signatures occur in which payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of patterns up to which one automaton is broadcast.
BROADCAST_BYTES = 32 << 20


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """(name, pattern) of a file of name=HEX lines."""
    line = F.regexp_extract_all("value", F.lit(r"^\s*([^=#]+?)\s*=\s*([0-9A-Fa-f]+)\s*$"), 0)
    rows = spark.read.text(path).where(F.size(line) > 0)
    return rows.select(F.trim(F.substring_index("value", "=", 1)).alias("name"), F.unhex(F.trim(F.substring_index("value", "=", -1))).alias("pattern"))


def search(texts: DataFrame, by: str, body: str, patterns: DataFrame) -> DataFrame:
    """(by, name, at): every signature that occurs in a BINARY body, with its first offset.

    Up to ``BROADCAST_BYTES`` of patterns one automaton reads each body once; more are cut
    into several automata of that size, in passes.
    """
    import ahocorasick

    spark = texts.sparkSession
    size = patterns.agg(F.sum(F.length("pattern") + F.octet_length("name"))).first()[0] or 0
    passes = max(1, -(-size // BROADCAST_BYTES))
    own, out = texts.select(F.col(by).alias("id"), F.col(body).alias("body")), None
    for k in range(passes):
        part = patterns if passes == 1 else patterns.where(F.pmod(F.xxhash64("name", "pattern"), F.lit(passes)) == k)
        by_pattern: dict[str, list[str]] = {}
        for r in part.collect():  # bounded by BROADCAST_BYTES
            if r.pattern:
                by_pattern.setdefault(bytes(r.pattern).decode("latin-1"), []).append(r.name)
        machine = ahocorasick.Automaton()
        for pattern, found in by_pattern.items():
            machine.add_word(pattern, (len(pattern), tuple(found)))
        machine.make_automaton()
        shared = spark.sparkContext.broadcast(machine)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                rows, names, offsets = [], [], []
                for i, content in enumerate(batch.column(1).to_pylist() if len(automaton) else ()):
                    first: dict[str, int] = {}
                    for end, (n, found) in automaton.iter((content or b"").decode("latin-1")):
                        for name in found:
                            first.setdefault(name, end - n + 1)
                    rows += [i] * len(first)
                    names += first
                    offsets += first.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(offsets, pa.int64())], ["id", "name", "at"])

        found = own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, name string, at long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", by)
