"""What the training-data operators share: Arrow text access, word spans and hashes, all vectorised.

Texts are handled as one UTF-8 byte array per block with document offsets, straight from Arrow's
buffers. Blocks hold a bounded number of bytes, or a single longer document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.sources.tables import shared_folder

#: Text bytes that are worked on at once; numpy temporaries take about 60 bytes for each.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All but ASCII letters, digits and the bytes of other characters.
NOT_ALNUM = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder: it outlives executors, unlike local blocks."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``checkpointed`` table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and int64 offsets; a null row is empty. No copy unless there are nulls."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``size`` bytes or a single row."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64; kept up to a block's length."""
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    n = max(n, 1)
    have = _powers.get(0)
    if have is None or len(have) < n:
        if n > 4 * BLOCK_BYTES:
            return run(_ODD), run(_INVERSE)
        n = max(n, BLOCK_BYTES + 1)
        _powers[0], _powers[1] = run(_ODD), run(_INVERSE)
    return _powers[0][:n], _powers[1][:n]


class RollHash:
    """Hashes of any ranges of one sequence of 64-bit values: a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.prefix[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + length * U64(0xD6E8FEB86659FD93))

    def all_of(self, length: int) -> np.ndarray:
        """The hash of the range of that length at each start."""
        n = len(self.prefix) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[length:] - self.prefix[:n]) * self.down[:n] + U64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


class ByteHash(RollHash):
    """Hashes of any byte ranges of one block, over random values for the bytes."""

    def __init__(self, data: np.ndarray):
        super().__init__(_BYTE[data])


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and per document the first word's index (n + 1 values).

    ``between``: for each byte value, whether it separates words.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def owner(bounds: np.ndarray) -> np.ndarray:
    """For n + 1 bounds, the index of the range that each element belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def per_range(values: np.ndarray, bounds: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sum of the values within each range; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=total[1:], dtype=dtype)
    return total[bounds[1:]] - total[bounds[:-1]]


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def crc_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
