"""What several operators of this subpackage share: shared-folder tables, text slices, word hashes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
#: The same as a class for Java's and RE2's regular expressions.
WS_CLASS = r"[\x20\x09-\x0D]"

#: A side is broadcast only up to so many rows of one 64-bit key (some 16 MB); beyond it, the join shuffles.
BROADCAST_ROWS = 500_000

MASK = (1 << 64) - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C55)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


# ---------------------------------------------------------------- shared tables


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or in local mode, where it is unset (tests), one of our own.

    Elsewhere an unset folder is an error: executors would each write to a disk of their own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tideframe-"))


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


_live: dict[str, SparkSession] = {}


@atexit.register
def _delete_at_exit() -> None:
    for path, spark in _live.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; the cluster clears its checkpoint folder
            return


class Written:
    """A DataFrame written once as Parquet into the shared folder, so that a lost executor costs no recomputation.

    `drop` deletes it once nothing reads it any more; what a returned DataFrame reads stays until the driver exits.
    """

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/tideframe-{name}-{uuid.uuid4().hex}"
        _live[self.path] = spark
        df.write.mode("overwrite").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _live.pop(self.path, None)


def by_size(small: DataFrame, rows: int) -> DataFrame:
    """The side with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def row_key(id_col: str, text_col: str) -> Column:
    """The id, or for a null id a negative number made from the text, so that every row has a key."""
    return F.coalesce(F.col(id_col).cast("long"), -F.abs(F.shiftright(F.xxhash64(F.col(text_col)), 1)) - 1)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


# ---------------------------------------------------------------- text blocks


def text_spans(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row spans [lo, hi) of a column with about `limit` bytes of text each; a longer text is a span of its own."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for hi, size in enumerate(sizes):
        if hi > lo and total + size > limit:
            yield lo, hi
            lo, total = hi, 0
        total += int(size)
    if lo < len(sizes):
        yield lo, len(sizes)


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """The same for a column of a batch."""
    return text_spans(batch.column(column), limit)


def slices(batch: pa.RecordBatch, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes on average, whatever its columns."""
    step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and each row's offset into them; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, _BASE)]))
    return _powers


#: Which byte values separate words: the six of WS.
SEPARATES = np.zeros(256, bool)
SEPARATES[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray, separates: np.ndarray = SEPARATES, outside: np.ndarray | None = None, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all rows, in order, and each row's offset into them.

    Each word's hash is a polynomial over its bytes modulo 2^64, mixed with its
    length; rows never share a word. `outside` are places of further bytes that are in no word,
    `cuts` places where a word begins even inside one. No Python object is made per word.
    """
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~separates[raw]
    if outside is not None:
        inside[outside] = False
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    if cuts is not None:
        opens[cuts] = inside[cuts]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    opens[edges] = inside[edges]
    starts = np.flatnonzero(opens)
    first = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    kept = np.cumsum(inside, dtype=np.int64)
    at = kept[starts] - 1
    sizes = np.diff(np.append(at, kept[-1]))
    place = np.arange(kept[-1]) - np.repeat(at, sizes)
    terms = (raw[inside].astype(np.uint64) + np.uint64(1)) * _power(int(sizes.max()) + 1)[place]
    return mix(np.add.reduceat(terms, at) + sizes.astype(np.uint64) * _M1), first


def fold(hashes: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit hash for each row from the sequence of its word hashes; 0 words give a fixed value."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    if len(hashes):
        place = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
        terms = mix(hashes ^ np.uint64(salt)) * _power(int(counts.max()) + 1)[place]
        full = counts > 0
        out[full] = np.add.reduceat(terms, first[:-1][full])
    return mix(out + counts.astype(np.uint64) * _M2 + np.uint64(salt))
