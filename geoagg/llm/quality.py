"""Quality rules with adaptive thresholds (native).

Every document gets base counts (words, characters, symbols, repeated lines, words in repeated 5-word windows) and three
metrics, all above zero: symbols a word, repeated lines for each different one (half an event is added to the counts) and
characters a word. Per (language, source) a mergeable quantile sketch of each metric is kept over the documents that the base
rules pass: counts per logarithmic bucket of relative width ``GAMMA``. Merging is addition, so the sketches of a language and of
the corpus are sums of the finer ones.

No limit is fixed: from a sketch come its median and the ratio of the median to the tenth percentile, both from the half that
junk does not reach unless it is the majority. Both are drawn, as logarithms, towards those of the language, and these towards
those of the corpus, as ``PRIOR`` documents would, at every size of a group alike; the corpus's ratio is drawn towards two in the
same way, so that a handful of documents does not set narrow limits. A metric fails above ``median * ratio **
spread``, characters a word also below ``median / ratio ** spread``, with the ``SPREAD`` of the metric. Of a count only what is
more than chance is held against the limit (x - sqrt(x); for mean word lengths a share of 0.5 / sqrt(words)), so that short
documents are not judged by one symbol.

Defined results: a null text has no words and no lines; a null language or source is a group of its own; in a group without
documents that pass the base rules nothing else is judged; empty tables give empty results; documents with equal texts get equal
counts; very long texts are counted whole; extra columns pass through, and the report has its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, carried, let, pieces, restored, small, stored

GAMMA = 1.02
#: metric -> power of its ratio
SPREAD = {"symbol_rate": 3.0, "dup_line_odds": 2.5, "chars_per_word": 6.0}
#: Documents that the next wider group weighs in a narrower one, and that ``WIDE`` weighs in the corpus.
PRIOR = 100.0
#: The logarithm of the ratio where nothing is known: the median twice the tenth percentile.
WIDE = 0.6931471805599453
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = r"#*$%&|<>"


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a ``width``-word window found twice or more in ``words``."""

    def covered(starts: Column) -> Column:
        # starts in ascending order: each covers the words up to the next start, width at most
        return F.aggregate(
            F.transform(starts, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width)))),
            F.lit(0), lambda a, x: a + x,
        )

    def repeats(windows: Column) -> Column:
        by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            by_hash,
            lambda s: F.filter(
                s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            ),
        )
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(
        hashes,
        lambda h: F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - width + 1, F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]),
        ),
    )
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), repeats(w)).otherwise(F.lit(0)))


def with_counts(df: DataFrame) -> DataFrame:
    """``df`` with ``m``: the five base counts, ``n_lines`` and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = pieces(text, SPACE)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
        F.length(F.regexp_replace(text, f"{SPACE}++", "")).cast("long").alias("c"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]++", "")).cast("long").alias("s"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
    )
    named = lambda x: F.struct(
        x["w"]["n"].alias("n_words"), x["c"].alias("word_chars"), x["s"].alias("n_symbols"), x["l"]["d"].alias("n_dup_lines"), x["w"]["r"].alias("n_repeat_words"), x["l"]["n"].alias("n_lines"),
        ((x["w"]["n"] < 10) | (100 * x["w"]["r"] > 20 * x["w"]["n"])).alias("base_failed"),
    )
    return df.withColumn("m", let(made, named))


def _rate(events, of) -> Column:
    return (events + F.lit(0.5)) / (of + F.lit(1.0))


def metrics(m: Column) -> dict[str, Column]:
    """The metrics of a document with the counts ``m``, for the sketch."""
    return {"symbol_rate": _rate(m["n_symbols"], m["n_words"]), "dup_line_odds": _rate(m["n_dup_lines"], m["n_lines"] - m["n_dup_lines"]), "chars_per_word": _rate(m["word_chars"], m["n_words"])}


def judged_values(m: Column) -> dict[str, Column]:
    """What of the metrics is more than chance: compared with the upper limits, ``least_chars`` with the lower one."""
    sure = lambda x: x - F.sqrt(x)
    chars, doubt = metrics(m)["chars_per_word"], F.lit(0.5) / F.sqrt(F.greatest(m["n_words"], F.lit(1)))
    odd = sure(m["n_dup_lines"])
    return {"symbol_rate": _rate(sure(m["n_symbols"]), m["n_words"]), "dup_line_odds": _rate(odd, m["n_lines"] - odd), "chars_per_word": chars * (F.lit(1.0) - doubt), "least_chars": chars * (F.lit(1.0) + doubt)}


def sketch(counted: DataFrame) -> DataFrame:
    """Mergeable sketches: (lang, source, metric, bucket, n). Bucket b holds values up to GAMMA ** b."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), x.alias("x")) for k, x in metrics(F.col("m")).items()])
    # not a filter, which would be pushed below the counts and make them twice
    rows = counted.select("lang", "source", F.explode(F.when(~F.col("m.base_failed"), each)).alias("v"))
    bucket = F.ceil(F.log(F.col("v.x")) / F.lit(_LOG_GAMMA)).cast("int")
    return rows.groupBy("lang", "source", F.col("v.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


_LOG_GAMMA = 0.01980262729617973  # ln(1.02)


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row (lang, source, upper_<metric> .., lower_chars_per_word) a group."""

    def facts(s: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, metric, total, mid, ratio): the logarithms of the median and of its ratio to the tenth percentile."""
        w = Window.partitionBy(*keys, "metric")
        s = s.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
        q = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(p)), F.col("bucket")))
        s = s.groupBy(*keys, "metric").agg(q(0.5).alias("q50"), q(0.1).alias("q10"), F.max("total").cast("double").alias("total"))
        return s.select(*keys, "metric", "total", (F.col("q50") * F.lit(_LOG_GAMMA)).alias("mid"), ((F.col("q50") - F.col("q10")) * F.lit(_LOG_GAMMA)).alias("ratio"))

    def drawn(narrow: str, wide: Column, of: str) -> Column:
        n = F.col(f"{narrow}.total")
        return (n * F.col(f"{narrow}.{of}") + F.lit(PRIOR) * wide) / (n + F.lit(PRIOR))

    g = facts(sketches, ["lang", "source"]).alias("g")
    a = small(facts(sketches.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")), ["lang"])).alias("a")
    o = small(facts(sketches.groupBy("metric", "bucket").agg(F.sum("n").alias("n")), [])).alias("o")
    merged = g.join(a, F.col("g.lang").eqNullSafe(F.col("a.lang")) & (F.col("g.metric") == F.col("a.metric"))).join(o, F.col("g.metric") == F.col("o.metric"))
    widest = {"mid": F.col("o.mid"), "ratio": drawn("o", F.lit(WIDE), "ratio")}
    own = {of: drawn("g", drawn("a", top, of), of) for of, top in widest.items()}
    merged = merged.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), F.col("g.metric").alias("metric"), own["mid"].alias("mid"), own["ratio"].alias("ratio"))
    limit = lambda k, sign: F.max(F.when(F.col("metric") == k, F.exp(F.col("mid") + F.lit(sign * SPREAD[k]) * F.col("ratio"))))
    return merged.groupBy("lang", "source").agg(*[limit(k, 1).alias(f"upper_{k}") for k in SPREAD], limit("chars_per_word", -1).alias("lower_chars_per_word"))


LIMITS = [*[f"upper_{k}" for k in SPREAD], "lower_chars_per_word"]


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` (lang, source, m, ..) with the limits of its group and ``kept``."""
    t = small(limits).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    value = judged_values(F.col("m"))
    fits = value["least_chars"] >= F.col("lower_chars_per_word")
    for k in SPREAD:
        fits = fits & (value[k] <= F.col(f"upper_{k}"))
    out = counted.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    # one piece: a pushed-down part would count twice
    return out.withColumn("kept", F.when(F.col("m.base_failed"), False).otherwise(F.coalesce(fits, F.lit(True))))


def fitted(docs: DataFrame) -> DataFrame:
    """The stored limits of all groups of ``docs``."""
    spark = docs.sparkSession
    return stored(spark, thresholds(stored(spark, sketch(with_counts(docs.select("text", "lang", "source"))), "sketches", 4)), "limits", 1)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that pass, with the columns of ``docs``. Two passes over the texts, none is stored or moved."""
    limits = fitted(docs)
    return restored(judged(with_counts(docs.select(carried(docs), "text", "lang", "source")), limits).filter("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the five counts, the limits of its group, base_failed, kept."""
    spark = docs.sparkSession
    counted = stored(spark, with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "counted")
    limits = stored(spark, thresholds(stored(spark, sketch(counted), "sketches", 4)), "limits", 1)
    return judged(counted, limits).select("doc_id", *[f"m.{c}" for c in COUNTS], *LIMITS, "m.base_failed", "kept")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *COUNTS, "base_failed", "kept")


OP4_SQL = f"""
with d as (
  select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l
  from documents),
win as (
  select rid, unnest(range(1, len(w) - 3)) i, w from d where len(w) >= 5),
win2 as (select rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] g from win),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, g) c from win2) where c > 1),
rep as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + 5)) p from dup) group by rid),
c as (
  select d.rid, doc_id, lang, source, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
    coalesce(rep.n, 0)::bigint n_repeat_words, len(l) n_lines
  from d left join rep on d.rid = rep.rid),
f as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) base_failed from c),
m as (
  select rid, lang, source, unnest([
    {{'metric': 'symbol_rate', 'x': (n_symbols + 0.5e0) / (n_words + 1e0)}},
    {{'metric': 'dup_line_odds', 'x': (n_dup_lines + 0.5e0) / (n_lines - n_dup_lines + 1e0)}},
    {{'metric': 'chars_per_word', 'x': (word_chars + 0.5e0) / (n_words + 1e0)}}], recursive := true) from f where not base_failed),
s as (select lang, source, metric, ceil(ln(x) / {_LOG_GAMMA})::int bucket, count(*) n from m group by all),
q as (
  select grouping(lang) gl, grouping(source) gs, lang, source, metric, bucket, sum(n) n
  from s group by grouping sets ((lang, source, metric, bucket), (lang, metric, bucket), (metric, bucket))),
q2 as (
  select *, sum(n) over (partition by gl, gs, lang, source, metric order by bucket) upto,
    sum(n) over (partition by gl, gs, lang, source, metric) total from q),
q3 as (
  select gl, gs, lang, source, metric, max(total)::double total, min(bucket) filter (upto >= ceil(total * 0.5::double)) q50,
    min(bucket) filter (upto >= ceil(total * 0.1::double)) q10 from q2 group by all),
u as (select *, q50 * {_LOG_GAMMA}::double mid, (q50 - q10) * {_LOG_GAMMA}::double ratio from q3),
lim as (
  select g.lang, g.source, g.metric,
    (g.total * g.mid + {PRIOR}::double * ((a.total * a.mid + {PRIOR}::double * o.mid) / (a.total + {PRIOR}::double))) / (g.total + {PRIOR}::double) mid,
    (g.total * g.ratio + {PRIOR}::double * ((a.total * a.ratio + {PRIOR}::double * ((o.total * o.ratio + {PRIOR}::double * {WIDE}::double) / (o.total + {PRIOR}::double))) / (a.total + {PRIOR}::double))) / (g.total + {PRIOR}::double) ratio
  from u g join u a on g.lang is not distinct from a.lang and g.metric = a.metric and a.gl = 0 and a.gs = 1
  join u o on o.metric = g.metric and o.gl = 1 where g.gl = 0 and g.gs = 0),
lim2 as (
  select lang, source, max(exp(mid + {SPREAD["symbol_rate"]}::double * ratio)) filter (metric = 'symbol_rate') symbols,
    max(exp(mid + {SPREAD["dup_line_odds"]}::double * ratio)) filter (metric = 'dup_line_odds') lines,
    max(exp(mid + {SPREAD["chars_per_word"]}::double * ratio)) filter (metric = 'chars_per_word') chars,
    max(exp(mid - {SPREAD["chars_per_word"]}::double * ratio)) filter (metric = 'chars_per_word') least_chars
  from lim group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(
    (n_symbols - sqrt(n_symbols) + 0.5e0) / (n_words + 1e0) <= symbols
    and (n_dup_lines - sqrt(n_dup_lines) + 0.5e0) / (n_lines - n_dup_lines + sqrt(n_dup_lines) + 1e0) <= lines
    and (word_chars + 0.5e0) / (n_words + 1e0) * (1e0 - 0.5e0 / sqrt(greatest(n_words, 1))) <= chars
    and (word_chars + 0.5e0) / (n_words + 1e0) * (1e0 + 0.5e0 / sqrt(greatest(n_words, 1))) >= least_chars, true) kept
from f left join lim2 on f.lang is not distinct from lim2.lang and f.source is not distinct from lim2.source
"""

QUERIES = {"op4_quality": op4_quality}
ORACLE = {"op4_quality": OP4_SQL}
