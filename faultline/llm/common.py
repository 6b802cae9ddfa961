"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: the white space that separates words: space and 0x09 to 0x0D, nothing else
WORD = r"[^\x20\x09-\x0D]+"
#: bytes of text that one step inside a task holds as arrays at a time (a single longer text is one step)
STEP_BYTES = 4_000_000


#: rows of an Arrow batch: texts are long, and a batch is held by the executor and by its Python worker
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, in a session with `small_batches`."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one only where ``spark.checkpoint.dir`` is not set and the master is local, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """The table written as Parquet in the shared checkpoint folder and read again: a lineage cut that is compressed.

    The files lie beside the checkpoints and can be removed with them once the result has been read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts add up to about ``limit`` bytes; texts are never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.diff(np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64))
        cut_at = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
        for a, b in zip([0, *cut_at], [*cut_at, batch.num_rows]):
            yield batch.slice(a, b - a)


def pack(docs: DataFrame) -> DataFrame:
    """(id, packed): each text of (id, text) compressed, to travel through a shuffle; a null text stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else z.compress(x.encode("utf-8", "surrogatepass")) for x in b.column(1).to_pylist()], pa.binary())], ["id", "packed"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, packed binary")


def unpack(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of packed texts."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    return [None if x is None else z.decompress(x) for x in col.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
