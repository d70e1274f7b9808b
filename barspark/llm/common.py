"""Helpers shared by the text operators: words, hashes, shared scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

SHINGLE_WORDS = 5
#: Bytes of the texts that a task works on at a time; Arrow batches may hold many more.
SLICE_BYTES = 1 << 20
_SCRATCH: list[tuple[SparkSession, str]] = []


def words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` separates at exactly
    those six characters, so no pattern is needed.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_slices(batches, column: int = -1, most: int = SLICE_BYTES):
    """The rows of Arrow batches in slices of about ``most`` bytes of the string or binary column; a longer text is a slice of its own.

    Whoever yields one output batch a slice holds no more than a slice's results.
    """
    for b in batches:
        texts = b.column(column % b.num_columns)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        first, done = 0, 0
        while first < len(sizes):
            stop = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(first, stop - first)
            first, done = stop, int(ends[stop - 1])
    release()


def release() -> None:
    """Give freed memory back, so that a worker that waits for other work does not hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):     # another C library
        pass


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash per run of ``size`` words; a shorter text is one run, none is empty."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    count = n - size + 1
    acc = np.full(count, size, np.uint64)
    for j in range(size):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + count]
    return mix(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def stored(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a recompute.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/barspark-llm-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_drop_all)
    _SCRATCH.append((spark, path))
    return path


def drop(*frames_or_paths) -> None:
    """Delete scratch tables that no later plan reads."""
    for x in frames_or_paths:
        names = x.inputFiles() if isinstance(x, DataFrame) else [x]
        for spark, path in list(_SCRATCH):
            if any(path.rpartition("/")[2] in n for n in names):
                _delete(spark, path)
                _SCRATCH.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _SCRATCH:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def text_input(docs: DataFrame, text_col: str, keep: list[str]) -> tuple[DataFrame, int]:
    """(the columns ``keep`` of ``docs`` and its text as a string, the number of the text's column).

    A text that is kept as a string already is not sent to Python twice."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    if text_col in keep and isinstance(docs.schema[text_col].dataType, T.StringType):
        return rows, keep.index(text_col)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_own_text")), len(keep)


#: Bytes of an Arrow batch in sessions that do not set it.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` would; once a context.

    Texts may be long: batches sent to Python are bounded in bytes where the session does not say how."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_barspark_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="barspark-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(str(target))
    context._barspark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, modulus: int) -> "F.Column":
    """crc32 of the id written as text, modulo ``modulus`` (null ids: fold 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0))


#: Blocks of the Bloom prefilter: 64 bits each, so the broadcast table stays under 4 MB.
BLOOM_BLOCKS = 1 << 17


def bloom_split(df: DataFrame, col: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ``keys``, rows whose key surely is not).

    The filter has a fixed size whatever the number of keys; more keys only let
    more rows pass on to the exact join. Null keys count as possible hits.
    """
    key = keys.columns[0]

    def bits(c):
        h = F.xxhash64(F.lit(11), c)
        places = [F.pmod(F.shiftrightunsigned(h, 18 + 6 * j), F.lit(64)).cast("int") for j in range(4)]
        mask = F.lit(0).cast("bigint")
        for p in places:
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p))
        return F.pmod(h, F.lit(BLOOM_BLOCKS)), mask

    block, mask = bits(F.col(key))
    table = keys.where(F.col(key).isNotNull()).select(block.alias("_block"), mask.alias("_mask")).groupBy("_block").agg(F.bit_or("_mask").alias("_bits"))
    block, mask = bits(F.col(col))
    probed = df.withColumn("_block", block).join(F.broadcast(table), "_block", "left")
    hit = F.col(col).isNull() | (F.coalesce("_bits", F.lit(0)).bitwiseAND(mask) == mask)
    keep = [F.col(f"`{c}`") for c in df.columns]
    return probed.where(hit).select(*keep), probed.where(~hit).select(*keep)
