"""Helpers shared by the training-data operators: tables, scratch storage, text expressions, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Largest table that an operator broadcasts after counting its rows and measuring their bytes; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scratch storage -------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share; removed when the driver exits.

    Where the setting is absent (unit tests on one machine) a folder of this process below the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended before this hook ran
        return


def drop_scratch(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing will read any more."""
    for df in tables:
        _remove(df.sparkSession, df._scratch)


#: Lets Spark remove the shuffle files of a query when the query ends, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleanup(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def gathered(df: DataFrame) -> list:
    """The few rows of ``df`` at the driver; the shuffle files behind them go."""
    with _cleanup(df.sparkSession):
        return df.collect()


def stored(spark: SparkSession, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: cuts lineage, survives lost executors.

    ``files``: for tables whose size does not follow the number of documents, the number of files at most.
    """
    path = scratch(spark, name)
    with _cleanup(spark):
        (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path.rpartition("/")[0]
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a stored or short table, with a broadcast hint if it has at most ``rows`` rows of ``size`` bytes (as JSON texts) together.

    Else unchanged, for a shuffled join. Rows and bytes are counted where they lie; one row of sums reaches the driver.
    """
    if df.count() > rows:
        return df
    measured = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0] or 0
    return F.broadcast(df) if measured <= size else df


# --- rows that are carried along ---------------------------------------------------------------------------------------


def carried(docs: DataFrame, *without: str) -> Column:
    """All columns of ``docs`` but ``without`` as one struct ``row``: no name in it can clash with an operator's own."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {w.lower() for w in without}]
    return F.struct(*(kept or [F.lit(None).cast("boolean").alias("_none")])).alias("row")


def restored(df: DataFrame, *added: str | Column, without: tuple[str, ...] = ()) -> DataFrame:
    """The fields of ``row`` and then ``added``; fields named like an added one, or in ``without``, are left out."""
    made = df.select(*added) if added else None
    gone = {n.lower() for n in (*(made.columns if made is not None else ()), *without, "_none")}
    return df.select(*[F.col(f"row.`{f.name}`") for f in df.schema["row"].dataType.fields if f.name.lower() not in gone], *added)


def text_key() -> Column:
    """``key``: the MD5 of ``text`` (null: empty), by which results that are functions of the text are joined back."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key")


# --- column expressions ----------------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def pieces(text: Column, separators: str) -> Column:
    """The non-empty parts of ``text`` between runs of ``separators`` (a regular expression of single characters)."""
    parts = F.split(text, f"(?:{separators})+")
    # only the first and the last part can be empty
    return let(
        parts,
        lambda p: let(
            F.when(F.get(p, F.lit(0)) == "", F.slice(p, F.lit(2), F.size(p))).otherwise(p),
            lambda q: F.when(F.get(q, F.size(q) - 1) == "", F.slice(q, F.lit(1), F.size(q) - 1)).otherwise(q),
        ),
    )


SPACE = r"[\x20\x09-\x0D]"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"

# --- Python side: words of UTF-8 bytes ---------------------------------------------------------------------------------

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; ``bytes.split`` separates at just these six bytes."""
    return text.translate(_LOWER).split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: ASCII letters, digits, all non-ASCII."""
    return text.translate(_WORDS).split() if text else []


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        a = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return a ^ (a >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int, starts: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` consecutive word hashes, or of those at ``starts``; none if there are fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    part = (lambda k: words[k : len(words) - n + 1 + k]) if starts is None else (lambda k: words[starts + k])
    with np.errstate(over="ignore"):
        out = mix(part(0) + np.uint64(n))
        for k in range(1, n):
            out = mix(out * np.uint64(0xA24BAED4963EE407) + part(k))
    return out


def byte_texts(column: Iterable) -> list[bytes | None]:
    """An Arrow string column as a list of bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def extended(batch, arrays: list, schema, drop: tuple[str, ...] = ()):
    """``batch`` without the columns ``drop``, with ``arrays`` appended, as a record batch of the Arrow ``schema``."""
    import pyarrow as pa

    kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in drop]
    columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip([*kept, *arrays], schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def arrow_schema(fields: str | list, like: DataFrame | None = None, drop: tuple[str, ...] = ()):
    """(Spark schema, Arrow schema) of ``like`` without ``drop`` and then ``fields`` (a DDL string)."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    own = [f for f in like.schema.fields if f.name not in drop] if like is not None else []
    spark_schema = T.StructType([*own, *T.StructType.fromDDL(fields).fields])
    spark_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in spark_schema.fields])
    return spark_schema, to_arrow_schema(spark_schema)


def from_batches(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` whose workers, which Spark uses again, give freed memory back at the end of a task."""

    def run(batches):
        yield from f(batches)
        given_back()

    return df.mapInArrow(run, schema)


def given_back() -> None:
    """Returns what this process has freed to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_LOW_BYTES = np.array([0, *[(1 << 8 * k) - 1 for k in range(1, 9)]], np.uint64)
_SPACED = bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))


class HashedWords:
    """The words of an Arrow string column as 64-bit hashes, without a Python object for each.

    ``kind`` "space" cuts as ``space_words``, "alnum" as ``alnum_words``. ``hashes``: of all words in a row; ``sizes``: words of
    each text. ``word(i)`` gives the bytes of one. Words over 256 bytes are hashed one by one.
    """

    def __init__(self, column, kind: str):
        import pyarrow as pa

        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        raw = memoryview(column.buffers()[2])[first : first + n] if n else b""
        self._bytes = bytes(raw).translate(_SPACED if kind == "space" else _WORDS) + bytes(8)
        at = offsets - first
        inside = np.frombuffer(self._bytes, np.uint8, n) != 32
        starts, stops = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        full = np.flatnonzero(at[1:] > at[:-1])  # texts that touch are cut where they meet
        starts[at[:-1][full]] = inside[at[:-1][full]]
        stops[at[1:][full] - 1] = inside[at[1:][full] - 1]
        self.starts, self.stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.sizes = np.diff(np.searchsorted(self.starts, at))
        self.hashes = self._hash(n)

    def _hash(self, n: int) -> np.ndarray:
        eight = np.ndarray((n + 1,), "<u8", self._bytes, strides=(1,))
        length = self.stops - self.starts
        with np.errstate(over="ignore"):
            h = mix(mix(eight[self.starts] & _LOW_BYTES[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for k in range(1, 33):
                long = np.flatnonzero(length > 8 * k)
                if not len(long):
                    return h
                if k == 32:
                    import xxhash

                    for i in long.tolist():
                        h[i] = xxhash.xxh3_64_intdigest(self.word(i))
                    return h
                v = eight[self.starts[long] + 8 * k] & _LOW_BYTES[np.minimum(length[long] - 8 * k, 8)]
                h[long] = mix(h[long] * np.uint64(0xA24BAED4963EE407) + v)
        return h

    def word(self, i: int) -> bytes:
        return self._bytes[self.starts[i] : self.stops[i]]


def column_chunks(batches: Iterable, column: str = "text", budget: int = 4 << 20) -> Iterable:
    """(slice of the record batch, its text column) of about ``budget`` bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + budget, side="right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


# --- bit tables --------------------------------------------------------------------------------------------------------

#: Bits of a table, at most (32 MB) and for each entry.
FILTER_BITS = 1 << 28
BITS_EACH = 64


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h, mask = mix(hashes), np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def passes(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which ``hashes`` may be in the set that the bit table was made of."""
    a, b = _places(hashes, 8 * len(table))
    return ((table[a >> 3] >> (a & 7).astype(np.uint8)) & (table[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A bit table over the one column of ``hashes``: built in blocks by Spark, at most ``FILTER_BITS`` bits."""
    n = hashes.count()
    bits = min(FILTER_BITS, 1 << max(15, (BITS_EACH * max(n, 1) - 1).bit_length()))
    schema, _ = arrow_schema("place long")

    def places(batches):
        import pyarrow as pa

        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["place"])

    at = from_batches(hashes, places, schema)
    blocks = at.groupBy(F.expr("place div 32768").alias("block")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out
