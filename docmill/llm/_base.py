"""Shared plumbing of the corpus operators: tables, scratch folders, Arrow chunks and vectorised byte work.

Nothing here depends on how many rows there are: Python code sees Arrow batches cut into
chunks of at most ``CHUNK_BYTES`` of text (a single longer text makes a chunk of its own).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_local_scratch: str | None = None


#: Texts on their way to Python take at most so many bytes a batch (a single longer text makes a batch of its own).
BATCH_BYTES = 8 << 20
_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Lower the session's limit on an Arrow batch to BATCH_BYTES, so that long texts do not add up in a worker, and let
    workers find this package where the driver did (a cluster's executors get it by --py-files, say)."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _HOME not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_HOME, known]))
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a temporary folder in local mode and an error on a cluster."""
    global _local_scratch
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="docmill-")
        atexit.register(shutil.rmtree, _local_scratch, True)
    return f"file://{_local_scratch}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    prepare(df.sparkSession)
    path = f"{scratch_root(df.sparkSession)}/docmill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few longs that may be sent to all tasks.
SENT_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """df, written before (see settle) and of a few longs a row, to be broadcast in a join if it has at most SENT_ROWS rows; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def free(name: str, taken) -> str:
    """A column name like this one that is not among those taken."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def sampled(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, most_bytes: int) -> DataFrame:
    """(label, _text) of the chosen documents (id, label), one text an id (the least), as many as have most_bytes together in the order of a hash."""
    (label,) = [c for c in chosen.columns if c != id_col]
    keys = chosen.select(F.col(id_col).alias("_key"), F.col(label).alias("_mark"))
    texts = docs.select(F.col(id_col).alias("_key"), text_or_empty(text_col).alias("_text"))
    sizes = texts.join(F.broadcast(keys), "_key").groupBy("_key", "_mark").agg(F.max(F.octet_length("_text").cast("long")).alias("size"))
    running = F.sum("size").over(Window.orderBy(F.xxhash64("_key"), "_key"))  # no more rows than were chosen
    fitting = sizes.withColumn("sum", running).where(F.col("sum") <= most_bytes).select("_key", "_mark")
    return texts.join(F.broadcast(fitting), "_key").groupBy("_key", "_mark").agg(F.min("_text").alias("_text")).select(F.col("_mark").alias(label), "_text")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def chunks(batches, text_field: str = "text", most: int = CHUNK_BYTES):
    """Arrow batches, cut so that each has at most `most` bytes of text or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text_field))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def spans(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between gaps."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], is_gap, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


_M = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0xD1342543DE82EF95)
_P_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_BYTE_CODES = [np.random.RandomState(seed).randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20, 21)]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 2 * CHUNK_BYTES:  # a very long text: not kept
            return tables
        _powers = tables
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of codes[start:end] for each range, from one prefix sum."""
    up, down = _power_tables(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A hash of each word; families (0 and 1) are independent."""
    return range_hashes(_BYTE_CODES[family][data], starts, ends)


def concat_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a line feed after each, and where each begins (one more entry: the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return data, begins


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i]+lengths[i]-1, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(first - offsets, lengths)


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
