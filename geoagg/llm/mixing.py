"""Mixing sources to target weights along a time-varying curriculum.

1. Targets: sources share the sum of all sizes by weight; a target stops at ``max_repeats`` times its source's size and
   the excess is shared again by weight until none is above (water filling, closed form over the per-source table).
2. Order: the documents of a source follow each other by MD5 of (doc_id, size, MD5 of the text); the source's stream is that
   order repeated. The first ``target`` words of the stream are taken, so each document is taken whole ``floor(target / size of
   the source)`` times and the documents at the front once more, the last of them in part.
3. Positions: a source's weight over training time t in [0, 1] is a line from ``start`` to ``stop``; its integral is the
   cumulative demand. The words before a copy are set equal to the demand and the quadratic is inverted: that t is the
   copy's position. Rows are range-partitioned and sorted by position, ties by the order of step 2, so that documents of one
   position (all those of which nothing is taken have the last) do not meet in one task. ``training_rows`` gives the sequence
   itself, one row for each time that a document is taken.

Running sums over a source are taken in three steps, over ranges of buckets, buckets of the order and within a bucket, so that
a hot source never meets in one task; the number of buckets follows the number of documents.

Defined results: a null text has size 0; null sources are one source, the last; documents of size 0 take nothing and
have the position of the next document; rows equal in doc_id and text are interchangeable, all others have a fixed order, so
reruns agree; empty tables give empty results; extra columns pass through, whatever their names, and columns of the input named
like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, carried, restored, small, stored

#: Weights of the sources in code point order, repeating, and their lines over training time.
WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MAX_REPEATS = 3
#: Documents in one bucket of the running sums, and buckets in one range, on average.
BUCKET_ROWS = 2000
RANGE_BUCKETS = 2000
ADDED = ("size", "source_size", "target", "taken", "copies", "position")


def sized(docs: DataFrame) -> DataFrame:
    """(row, source, size, ord) of each document: its columns, its number of words and its place in the order of its source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(f"[^{SPACE[1:-1]}]++")).cast("long")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), size.cast("string"), F.md5(text)))
    return docs.select(carried(docs, *ADDED), F.col("source"), size.alias("size"), key.alias("ord"))


def targets(sizes: DataFrame, weights=WEIGHTS, schedule=SCHEDULE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: source, source_size, target, start, stop. ``sizes``: source, source_size, one row a source.

    The only single-task step; its rows are the sources, not the documents.
    """
    nulls_last = [F.col("source").isNull(), F.col("source")]
    every = Window.partitionBy()
    k = (F.row_number().over(Window.orderBy(*nulls_last)) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), k + 1)
    t = sizes.withColumns({"weight": pick(weights), "start": pick([a for a, _ in schedule]), "stop": pick([b for _, b in schedule])})
    t = t.withColumns({"ratio": F.lit(max_repeats) * F.col("source_size") / F.col("weight"), "total": F.sum("source_size").over(every)})
    # those with the smallest cap per weight reach it first
    before = Window.orderBy("ratio", *nulls_last).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "capped": F.coalesce(F.sum(F.lit(max_repeats) * F.col("source_size")).over(before), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # of the levels that leave the next cap unreached, the first in this order, which is the largest
    level = F.max(F.when((F.col("total") - F.col("capped")) <= F.col("ratio") * F.col("open"), (F.col("total") - F.col("capped")) / F.col("open"))).over(every)
    t = t.withColumn("level", level)
    return t.select("source", "source_size", F.least(F.col("level") * F.col("weight"), (F.lit(max_repeats) * F.col("source_size")).cast("double")).alias("target"), "start", "stop")


def position(share: Column, start: Column, stop: Column) -> Column:
    """t in [0, 1] at which a weight line from ``start`` to ``stop`` has used up ``share`` of its integral."""
    half = (stop - start) / 2
    goal = share * (start + half)
    return F.when(half == 0, share).otherwise(2 * goal / (start + F.sqrt(F.greatest(start * start + 4 * half * goal, F.lit(0.0)))))


def mix(docs: DataFrame, weights=WEIGHTS, schedule=SCHEDULE, max_repeats: int = MAX_REPEATS, partitions: int | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, taken, copies and position, one row a document, sorted by position.

    ``copies``: array of (words, position), one for each time that the document is taken; ``position``: the first.
    """
    return mix_sized(sized(docs), weights, schedule, max_repeats, partitions)


def training_rows(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each copy of ``mix``'s result: the document's columns, ``words`` and ``at`` (the copy's position), sorted by it."""
    rows = mixed.select(carried(mixed, "copies", "words", "at"), F.inline("copies").alias("words", "at"))
    return _ranged(restored(rows, "words", "at"), partitions, "at", "doc_id", "size")


def mix_sized(docs: DataFrame, weights=WEIGHTS, schedule=SCHEDULE, max_repeats: int = MAX_REPEATS, partitions: int | None = None) -> DataFrame:
    """``mix`` for the rows of ``sized``."""
    spark = docs.sparkSession
    buckets = max(1, docs.select("source").count() // BUCKET_ROWS)
    place = F.conv(F.substring("ord", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    docs = docs.withColumn("bucket", F.floor(place * buckets).cast("long"))
    sums = stored(spark, docs.groupBy("source", "bucket").agg(F.sum("size").alias("s")).withColumn("range", F.expr(f"bucket div {RANGE_BUCKETS}")), "sums")
    plan = stored(spark, targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, schedule, max_repeats), "targets")
    upto = lambda keys, by: F.sum("s").over(Window.partitionBy(*keys).orderBy(by)) - F.col("s")
    ranges = sums.groupBy("source", "range").agg(F.sum("s").alias("s"))
    ranges = ranges.select(F.col("source").alias("_source"), F.col("range").alias("_range"), upto(["source"], "range").alias("ahead"))
    offsets = sums.withColumn("within", upto(["source", "range"], "bucket")).join(small(ranges), F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    offsets = stored(spark, offsets.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), (F.col("ahead") + F.col("within")).alias("before")), "offsets")
    plan = small(plan).withColumnRenamed("source", "_source")
    w = Window.partitionBy("source", "bucket").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = docs.withColumn("at", F.sum("size").over(w) - F.col("size"))
    out = out.join(small(offsets), F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")), "left").drop("_source", "_bucket")
    out = out.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return _taken(out.withColumn("at", F.col("before") + F.col("at")), partitions)


def _taken(out: DataFrame, partitions: int | None) -> DataFrame:
    whole = F.floor(F.col("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = (whole - F.col("passes") * F.col("source_size")).cast("long")
    last = F.least(F.greatest(F.col("rest") - F.col("at"), F.lit(0)), F.col("size"))
    share = lambda p: F.when(whole > 0, F.least((p * F.col("source_size") + F.col("at")) / whole, F.lit(1.0))).otherwise(F.lit(0.0))
    copy = lambda p, words: F.struct(words.cast("long").alias("words"), position(share(p), F.col("start"), F.col("stop")).alias("position"))
    out = out.withColumn("passes", passes).withColumn("rest", rest).withColumn("last", last.cast("long"))
    out = out.withColumn("taken", F.col("passes") * F.col("size") + F.col("last"))
    full = F.transform(F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(F.array().cast("array<bigint>")), lambda p: copy(p, F.col("size")))
    copies = F.filter(F.concat(full, F.array(copy(F.col("passes"), F.col("last")))), lambda c: c["words"] > 0)
    out = out.withColumn("copies", copies).withColumn("position", position(share(F.lit(0)), F.col("start"), F.col("stop")))
    return restored(_ranged(out.select("row", "ord", *ADDED), partitions, "position", "ord"), *ADDED)


def _ranged(rows: DataFrame, partitions: int | None, *by: str) -> DataFrame:
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    # the report needs no texts: they are read once, for their sizes
    slim = stored(spark, docs.select(F.struct("row.doc_id").alias("row"), "source", "size", "ord"), "slim")
    return mix_sized(slim).select("doc_id", "size", "source_size", "target", "taken", "position")


OP1_SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size, md5(coalesce(text, '')) hash from documents),
o as (
  select *, sum(size) over (partition by source order by md5(coalesce(doc_id::varchar, 'null') || ':' || size::varchar || ':' || hash) rows unbounded preceding) - size at_ from d),
s as (select source, sum(size)::bigint source_size from d group by source),
s1 as (select *, [5e0, 2e0, 1e0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] weight,
    [1.5e0, 1e0, 0.5e0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] a,
    [0.5e0, 1e0, 1.5e0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] b from s),
s2 as (select *, 3 * source_size / weight ratio, sum(source_size) over () total from s1),
s3 as (select *, coalesce(sum(3 * source_size) over w, 0) capped, sum(weight) over () - coalesce(sum(weight) over w, 0) open_
  from s2 window w as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
s4 as (select *, max(case when total - capped <= ratio * open_ then (total - capped) / open_ end) over () lvl from s3),
t as (select source, source_size, least(lvl * weight, 3e0 * source_size) target, a, b, (b - a) / 2 half from s4),
j as (
  select doc_id, size, source_size, target, floor(target)::bigint goal, at_::bigint at_, a, half,
    case when source_size > 0 then floor(floor(target) / source_size)::bigint else 0 end passes
  from o join t on o.source is not distinct from t.source),
k as (select *, case when goal > 0 then least(at_ / goal, 1e0) else 0e0 end share from j)
select doc_id, size, source_size, target,
  (passes * size + least(greatest(goal - passes * source_size - at_, 0), size))::bigint taken,
  case when half = 0 then share else 2 * share * (a + half) / (a + sqrt(greatest(a * a + 4 * half * share * (a + half), 0e0))) end as position
from k
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLE = {"op1_mixing": OP1_SQL}
