"""Open metric and metadata maps to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Which stored types count as which kind of metadata; others are dropped.
KINDS = {"string": "s", "double": "n", "float": "n", "int": "n", "bigint": "n", "smallint": "n", "tinyint": "n", "boolean": "b"}


def metadata_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """column -> "s", "n" or "b"; timestamps, decimals and nested values are left out."""
    kinds = dict(df.dtypes)
    return {c: KINDS[kinds[c]] for c in columns if kinds[c] in KINDS}


def typed_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (id, key, type, s, n, b) of the columns that can be metadata; nulls are absent."""
    types = metadata_types(df, columns)
    pick = lambda c, t, kind, as_: (F.col(c) if t == kind else F.lit(None)).cast(as_)
    entries = [F.struct(F.lit(c).alias("key"), F.lit(t).alias("type"), pick(c, t, "s", "string").alias("s"), pick(c, t, "n", "double").alias("n"), pick(c, t, "b", "boolean").alias("b")) for c, t in types.items()]
    rows = df.select("id", F.explode(F.array(*entries)).alias("e")).select("id", "e.*")
    return rows.filter(F.col("s").isNotNull() | F.col("n").isNotNull() | F.col("b").isNotNull())


def key_dictionary(metadata: DataFrame) -> DataFrame:
    """(key, key_id): the keys numbered in text order."""
    from pyspark.sql.window import Window

    keys = metadata.select("key").distinct()  # as many rows as there are keys
    return keys.withColumn("key_id", (F.row_number().over(Window.orderBy("key")) - 1).cast("long"))


def metric_columns(df: DataFrame, column: str = "metrics", keys: list[str] | None = None, zero_fill: bool = False) -> DataFrame:
    """``df`` with a FLOAT column for each key of a map column. Without ``keys`` they are discovered by one aggregate."""
    if keys is None:
        keys = [r["k"] for r in df.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").collect()]
    value = lambda k: F.try_element_at(F.col(column), F.lit(k)).cast("float")
    return df.select(*[c for c in df.columns if c != column], *[(F.coalesce(value(k), F.lit(0.0).cast("float")) if zero_fill else value(k)).alias(k) for k in keys])


def upserted(df: DataFrame, order: str, column: str = "metrics") -> DataFrame:
    """(id, column): one row an id, whose map has for each key the value of the last row by ``order`` that has the key.

    An empty or null map changes nothing; a null value of a key is no value.
    """
    entries = df.select("id", order, F.explode(F.map_entries(column)).alias("e")).filter(F.col("e.value").isNotNull())
    last = entries.groupBy("id", F.col("e.key").alias("key")).agg(F.max_by("e.value", order).alias("value"))
    maps = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(column))
    kind = df.schema[column].dataType
    empty = F.map_from_arrays(F.array().cast(T.ArrayType(kind.keyType)), F.array().cast(T.ArrayType(kind.valueType)))
    return df.select("id").distinct().join(maps, "id", "left").select("id", F.coalesce(column, empty).alias(column))


def duplicates_dropped(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["id"])
