"""Parts the training-data operators share: text batches, rolling hashes, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text that are turned into arrays at one time; a longer document is its own piece.
PIECE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Where the session names none it is a folder of the
    warehouse, which executors share as well; where that is on the driver's own disk, all must run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        home = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and (home.startswith("file:") or "://" not in home):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = f"{home.rstrip('/')}/scratch"
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe when executors are lost."""
    return Tables(df.sparkSession).write(df)


class Tables:
    """Parquet tables that one job writes to the shared folder, and removes when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/tables", {}

    def write(self, df: DataFrame, **options: int) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.options(compression="zstd", **options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table_ in tables:
            path, _ = self.paths.pop(id(table_))
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def share(column: Column, seed: str) -> Column:
    """A seeded number in [0, 1) that depends on the value only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(column.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a batch's texts, and where each text begins and ends (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, limit: int = PIECE, rows: int = 512) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``limit`` bytes and at most ``rows``: first, last, their bytes, their offsets therein. Only
    those are copied, not the batch."""
    for at in range(0, len(column), rows):
        data, offsets = texts(column.slice(at, rows))
        first, n = 0, len(offsets) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield at + first, at + last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts, for what copies its texts."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def mapped(df: DataFrame, fields: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` through ``fn`` batch by batch; the result has the columns of ``fields``."""
    return df.mapInArrow(fn, fields)


def appended(df: DataFrame, fields: list[tuple[str, T.DataType, pa.DataType]], fn: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """All columns of ``df`` and those that ``fn`` computes for each batch (a column of ``df`` with such a name is replaced)."""
    df = df.drop(*(name for name, _, _ in fields))
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind, _ in fields)])

    def run(batches):
        for batch in batches:
            values = fn(batch)
            arrays = [pa.array(v, kind) for v, (_, _, kind) in zip(values, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *(f[0] for f in fields)])

    return df.mapInArrow(run, schema)


# -- rolling hashes ---------------------------------------------------------------------------


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base, and of its inverse, modulo 2**64."""
    if 0 not in _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for key, base in ((0, _BASE), (1, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


_LETTERS = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_LETTERS[data] * p[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal content gives equal hashes wherever it stands."""
    _, inv = powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64))


def lowered(separators: np.ndarray) -> np.ndarray:
    """A byte table: A-Z lower-cased, separators (a mask over 256 bytes) as blanks."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[separators] = 32
    return t


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For words ``[^\x20\x09-\x0D]+``.
SPACED = lowered(_SPACE)
_PUNCT = np.zeros(256, bool)
_PUNCT[0:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:128] = True
#: For words of letters, digits and whatever is not ASCII.
WORDED = lowered(_PUNCT)


def words(data: np.ndarray, offsets: np.ndarray, to: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The normalised bytes, and start, end and document of each word; words end where documents do."""
    norm = to[data]
    inside = norm != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(norm))]
    begins[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return norm, start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, to: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the document of each word. A long document (a piece of its own) is hashed a part at a time."""
    if len(data) > 2 * PIECE and len(offsets) == 2:
        found, at = [], 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            if end < len(data):
                blank = np.flatnonzero(to[data[at:end]] == 32)
                more = np.flatnonzero(to[data[end:]] == 32) if not len(blank) else blank
                end = at + int(blank[-1]) + 1 if len(blank) else end + int(more[0]) if len(more) else len(data)
            found.append(word_hashes(data[at:end], np.array([0, end - at]), to)[0] if end - at <= 2 * PIECE else _hashes(data[at:end], np.array([0, end - at]), to)[0])
            at = end
        h = np.concatenate(found)
        return h, np.zeros(len(h), np.int64)
    return _hashes(data, offsets, to)


def _hashes(data: np.ndarray, offsets: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm, start, end, doc = words(data, offsets, to)
    return span_hash(prefix(norm), start, end), doc


# -- bitmaps ----------------------------------------------------------------------------------

#: A bitmap has 2**BITS bits whatever the input: 4 MB.
BITS = 25


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of a long column, by its lowest ``BITS`` bits."""
    low = f"({column} & {(1 << BITS) - 1})"
    rows = df.groupBy(F.expr(f"cast(shiftright({low}, 5) as int)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({low} & 31 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def among(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may have been in the column of ``bitmap``."""
    low = values.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (bits[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & 1 == 1


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
