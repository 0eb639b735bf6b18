"""License scans by diagonal voting (native).

Templates are short word sequences with a label. Every position of a document's word sequence gives a rolling k-gram
(k = 4 words, or the whole template where it is shorter); its 64-bit hash is joined to the positions of the templates. A hit
votes for the diagonal ``document position - template position``. Votes are summed per (text, template, diagonal),
diagonals at most ``slack`` apart whose stretches of the document overlap or adjoin are merged to a span, and a span is
verified: the template positions that its hits cover must make up ``min_cover`` of the template (all of it, on one diagonal,
for an exact phrase).

All results are functions of the text alone, so hits are keyed by the text's MD5: copies are counted once and rows
need no identifier. Only hits, spans and rows without their texts are shuffled.

Defined results: a null text is an empty one; empty texts and tables have no hits; equal texts have equal results; null
or repeated doc_ids stay as they are; a text of any length is read whole; of overlapping places of a phrase all count; extra
columns pass through, whatever their names, and columns of the input named like an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NON_WORD, ascii_lower, carried, let, pieces, restored, small, stored, text_key

K = 4


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # every word in its place; else min_cover of the words


#: Phrases that must be found wherever their words stand consecutively.
BASE = [Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True)]

#: Sentences of well-known public licences and notices, lower case, words only.
NOTICES = [
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]


def _grams(words: Column, k: int) -> Column:
    """The rolling hashes of all runs of ``k`` words, in order: of the words' hashes and of k."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(
        hashes,
        lambda h: F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - k + 1, F.lit(0))),
            lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(h, i + j) for j in range(1, k)]),
        ),
    )


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """One row for each k-gram position of each template: tid, tpos, k, gram."""
    words = [t.text.split() for t in templates]
    if any(len(w) < 2 for w in words):
        raise ValueError("a template has two words at least")
    df = spark.createDataFrame([(i, min(K, len(w)), w) for i, w in enumerate(words)], "tid int, k int, w array<string>")
    made = [df.filter(F.col("k") == k).select("tid", "k", F.posexplode(_grams(F.col("w"), k)).alias("tpos", "gram")) for k in sorted({min(K, len(w)) for w in words})]
    return reduce(DataFrame.unionByName, made)


def gram_hits(texts: DataFrame, templates: list[Template]) -> DataFrame:
    """(key, tid, pos, tpos): k-grams of ``texts.text`` whose hash is that of a template's k-gram; k is the template's."""
    table = template_grams(texts.sparkSession, templates)
    words = pieces(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), NON_WORD)
    lengths = sorted({min(K, len(t.text.split())) for t in templates})
    every = let(words, lambda w: F.array(*[_grams(w, k) for k in lengths]))
    rows = texts.select(text_key(), F.explode(every).alias("grams"))
    hits = rows.select("key", F.posexplode("grams").alias("pos", "gram")).join(small(table), "gram")
    return hits.select("key", "tid", "pos", "tpos").distinct()


def spans(texts: DataFrame, templates: list[Template], slack: int = 2, min_cover: float = 0.8) -> DataFrame:
    """Verified spans: key, tid, start, stop (document words, stop excluded), cover (share of the template's words)."""
    spark = texts.sparkSession
    lens = [len(t.text.split()) for t in templates]
    facts = small(spark.createDataFrame([(i, n, min(K, n), t.exact) for i, (n, t) in enumerate(zip(lens, templates, strict=True))], "tid int, words int, k int, exact boolean"))
    votes = gram_hits(texts, templates).join(facts, "tid")
    # one place of a template on one diagonal: votes whose document positions lie in [diagonal, diagonal + words)
    votes = votes.groupBy("key", "tid", "words", "k", "exact", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), (F.max("pos") + F.max("k")).alias("stop"), F.collect_set("tpos").alias("at")
    )
    w = Window.partitionBy("key", "tid").orderBy("diagonal", "first")
    near = (F.col("diagonal") - F.lag("diagonal").over(w) <= slack) & (F.col("first") <= F.lag("stop").over(w) + slack) & (F.col("stop") >= F.lag("first").over(w) - slack)
    votes = votes.withColumn("new", F.when(~F.col("exact") & F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("span", F.sum("new").over(w))
    merged = votes.groupBy("key", "tid", "words", "k", "exact", "span").agg(F.min("first").alias("start"), F.max("stop").alias("stop"), F.flatten(F.collect_list("at")).alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    merged = merged.withColumn("cover", covered / F.col("words"))
    return merged.filter(F.when(F.col("exact"), F.col("cover") == 1).otherwise(F.col("cover") >= min_cover)).select("key", "tid", "start", "stop", "cover")


def license_scan(docs: DataFrame, templates: list[Template] | None = None, slack: int = 2, min_cover: float = 0.8) -> DataFrame:
    """The columns of ``docs`` but text, with n_words and ``found``: an array of (label, exact, start, stop, cover), null without one."""
    spark = docs.sparkSession
    templates = BASE + NOTICES if templates is None else templates
    labels = small(spark.createDataFrame([(i, t.label, t.exact) for i, t in enumerate(templates)], "tid int, label string, exact boolean"))
    found = (
        spans(docs.select("text"), templates, slack, min_cover)
        .join(labels, "tid")
        .groupBy(F.col("key").alias("_key"))
        .agg(F.array_sort(F.collect_list(F.struct("label", "exact", "start", "stop", "cover"))).alias("found"))
    )
    found = small(stored(spark, found, "found"))
    words = pieces(F.coalesce(F.col("text"), F.lit("")), NON_WORD.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60"))
    rows = docs.select(carried(docs, "text", "n_words", "found"), text_key(), F.size(words).cast("long").alias("n_words"))
    return restored(rows.join(found, F.col("key") == F.col("_key"), "left"), "n_words", "found")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanned = license_scan(docs)
    base = F.coalesce(F.filter("found", lambda x: x["exact"]), F.array())
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        F.coalesce(names(F.col("found")), F.lit("")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["cover"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    rows = ", ".join(f"({i}, '{t.label}', {str(t.exact).lower()}, string_split('{t.text}', ' '))" for i, t in enumerate(BASE + NOTICES))
    return f"""
with tpl(tid, label, exact, tw) as (values {rows}),
tg as (select tid, least({K}, len(tw)) k, unnest(range(0, len(tw) - least({K}, len(tw)) + 1)) tpos, tw from tpl),
tg2 as (select tid, k, tpos, array_to_string(tw[tpos + 1 : tpos + k], ' ') g from tg),
d as (
  select row_number() over () rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
  from documents),
p as (select rid, unnest(range(0, len(w))) pos, w from d),
g as (select rid, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') g from p, (select unnest([2, 3, 4]) k) where pos + k <= len(w)),
h as (select rid, tid, pos, tpos, tg2.k from g join tg2 on g.k = tg2.k and g.g = tg2.g),
v as (
  select rid, tid, k, pos - tpos diagonal, min(pos) first, max(pos) + max(k) stop, list(tpos) at_ from h group by rid, tid, k, pos - tpos),
v2 as (
  select v.*, exact, len(tw) words, label,
    case when not exact and coalesce(diagonal - lag(diagonal) over w <= 2 and first <= lag(stop) over w + 2 and stop >= lag(first) over w - 2, false) then 0 else 1 end fresh
  from v join tpl using (tid) window w as (partition by rid, tid order by diagonal, first)),
v3 as (select *, sum(fresh) over (partition by rid, tid order by diagonal, first) span from v2),
sp as (
  select rid, tid, label, exact, words, k, min(first) start, flatten(list(at_)) at_ from v3 group by rid, tid, label, exact, words, k, span),
sp2 as (select *, len(list_distinct(flatten(list_transform(at_, lambda x: range(x, x + k))))) / words cover from sp),
ok as (select * from sp2 where case when exact then cover = 1 else cover >= 0.8::double end),
f as (
  select rid, count(*) filter (exact) n_base, min(start) filter (exact) first_word, max(start) filter (exact) last_word,
    string_agg(distinct label, ',' order by label) filter (exact) base_labels, string_agg(distinct label, ',' order by label) labels, max(cover) score
  from ok group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::double score
from d left join f using (rid)
"""


OP2_SQL = _sql()
QUERIES = {"op2_licenses": op2_licenses}
ORACLE = {"op2_licenses": OP2_SQL}
