"""What several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 on division by 3: rows no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the reliable checkpoint folder of the session.

    ``spark.checkpoint.dir`` is used as set; only where it is unset (tests on one
    machine) is a temporary folder chosen.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="netlens-checkpoints-"))
    return df.checkpoint()


def released(df: DataFrame) -> None:
    """Deletes the files of a checkpointed table that no plan reads any more."""
    jvm, plan = df.sparkSession.sparkContext._jvm, df._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that none holds more than ``most`` bytes of text, but for single rows above that."""
    for batch in batches:
        _, ends = utf8_view(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def vocabulary_file(name: str) -> str:
    """Where the public tokenizer files lie; TOKENIZER_DIR overrides the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


Batches = Iterator[pa.RecordBatch]


#: Bytes that Spark puts into a batch for Python, where the session leaves the default.
BATCH_BYTES, _DEFAULT = 4 << 20, 64 << 20


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A map over batches that hands free memory back at the end of its task, since workers live on.

    Also asks the session for batches of ``BATCH_BYTES``, which bounds the memory of both sides.
    """
    session, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    given = session.conf.get(key, None) if session is not None else None  # releases without the setting count rows only
    if given and given.rstrip("b") == str(_DEFAULT):
        session.conf.set(key, str(BATCH_BYTES))

    @wraps(run)
    def inner(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only where the C library can
                ctypes.CDLL(None).malloc_trim(0)

    return inner
