"""Benchmark decontamination by a prefix-filtered join.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window). A document is contaminated
by a window when the window's words stand consecutively in it. A window is a sequence of ``shingle``-word shingles (a shorter
window is one shingle); for containment of the whole window its prefix is one shingle, the rarest over all documents:

1. one pass counts, over all documents, every shingle that occurs in the benchmark; tasks hand on sums;
2. each window is indexed by its rarest shingle (ties: the smaller hash, then the smaller offset) and that shingle's offset;
3. a second pass looks for the prefix shingles. A place fixes the window's start for each offset; the length and positional
   bounds ask that the window lies inside the document. What is left is joined with the index on the prefix shingle, its
   offset, the length and a 128-bit hash of all words of the window, which is the check of the whole window.

Index, counts and places are tables, joined by Spark; nothing of the benchmark or the documents is held by the driver. Both
passes use a bit table of bounded size (``common.bit_table``), without false negatives, to leave out most of what the joins would
discard; a benchmark of any size takes two passes. Results are functions of the text and are joined back by its MD5, so
copies are one key and texts do not move.

Defined results: null and empty texts have no words and are clean; items without words have no windows; items with a null
item_id are looked for but not listed; repeated items and documents are treated alike; a text of any length is read whole; an
empty benchmark contaminates nothing; extra columns pass through and columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashedWords, arrow_schema, bit_table, carried, column_chunks, from_batches, gram_hashes, mix, passes, restored, small, stored, text_key

WINDOW = 10
SHINGLE = 5
#: Hits that a counting task holds before it hands its sums on.
FLUSH = 1 << 20

_OTHER = np.uint64(0x8F1BBCDC5A827999)


def _windows(words: np.ndarray, n: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of all runs of ``n`` words, or of those at ``starts``."""
    return gram_hashes(words, n, starts), gram_hashes(mix(words ^ _OTHER), n, starts)


def _longs(a: np.ndarray):
    import pyarrow as pa

    return pa.array(a.view(np.int64))


# --- the benchmark -----------------------------------------------------------------------------------------------------


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, w1, w2, size, k, grams): each window of each item, with the hashes of its ``k``-word shingles in order."""
    schema, arrow = arrow_schema("item string, w1 long, w2 long, size int, k int, grams array<long>")

    def cut(batches):
        import pyarrow as pa

        for batch, texts in column_chunks(batches):
            words, at = HashedWords(texts, "alnum"), 0
            names = batch.column(batch.schema.get_field_index("item")).to_pylist()
            for name, n in zip(names, words.sizes.tolist(), strict=True):
                own = words.hashes[at : at + n]
                at += n
                if not n:
                    continue
                size = min(window, n)
                k = min(shingle, size)
                w1, w2 = _windows(own, size)
                _, first = np.unique(np.stack([w1, w2]), axis=1, return_index=True)
                grams = np.lib.stride_tricks.sliding_window_view(gram_hashes(own, k), size - k + 1)[first]
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * (size - k + 1)), _longs(np.ascontiguousarray(grams).ravel()))
                same = lambda v, t, m=len(first): pa.array([v] * m, t)
                yield pa.RecordBatch.from_arrays([same(name, pa.string()), _longs(w1[first]), _longs(w2[first]), same(size, pa.int32()), same(k, pa.int32()), each], schema=arrow)

    return from_batches(items.select(F.col("item_id").cast("string").alias("item"), "text"), cut, schema)


def shingle_counts(docs: DataFrame, tables) -> DataFrame:
    """(k, gram, n): how often the ``k``-word shingles that pass the broadcast bit tables occur in all documents."""
    schema, arrow = arrow_schema("k int, gram long, n long")

    def count(batches):
        import pyarrow as pa

        held, size = {k: [] for k in tables.value}, 0

        def flush():
            for k, h in held.items():
                if h:
                    g, n = np.unique(np.concatenate(h), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), _longs(g), pa.array(n)], schema=arrow)

        for _, texts in column_chunks(batches):
            words = HashedWords(texts, "alnum")
            for k, table in tables.value.items():
                g, at = gram_hashes(words.hashes, k), _inside(words.sizes, k)
                g = g[at]
                held[k].append(g[passes(g, table)])
                size += len(held[k][-1])
            if size >= FLUSH:
                yield from flush()
                held, size = {k: [] for k in tables.value}, 0
        yield from flush()

    return from_batches(docs.select("text"), count, schema).groupBy("k", "gram").agg(F.sum("n").alias("n"))


def _inside(sizes: np.ndarray, k: int) -> np.ndarray:
    """The starts of the runs of ``k`` words that lie in one of the texts, whose words follow each other."""
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(int(ends[-1]) if len(ends) else 0)
    return np.flatnonzero(left >= k)


def indexed(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: the items' windows, and one row (w1, w2, size, k, gram, shift) a distinct window: its rarest shingle."""
    spark = docs.sparkSession
    windows = stored(spark, item_windows(items, window, shingle), "windows")
    each = windows.select("w1", "w2", "size", "k", F.posexplode("grams").alias("shift", "gram")).distinct()
    wanted = stored(spark, each.select("k", "gram").distinct(), "shingles")
    tables = {r["k"]: bit_table(wanted.filter(F.col("k") == r["k"]).select("gram")) for r in wanted.select("k").distinct().collect()}  # ``shingle`` rows at most
    counts = stored(spark, shingle_counts(docs, spark.sparkContext.broadcast(tables)).join(small(wanted), ["k", "gram"], "left_semi"), "counts")
    ranked = each.join(small(counts), ["k", "gram"], "left").groupBy("w1", "w2", "size", "k")
    best = ranked.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "shift")).alias("b"))
    return windows, stored(spark, best.select("w1", "w2", "size", "k", "b.gram", "b.shift"), "index")


# --- the documents -----------------------------------------------------------------------------------------------------


HITS = "array<struct<start:int,size:int,shift:int,gram:bigint,w1:bigint,w2:bigint>>"


def scanned(docs: DataFrame, index: DataFrame, row: Column | None) -> DataFrame:
    """(row if given, key, n_words, hits) of each document: places that may be windows, in the order of the text."""
    spark = docs.sparkSession
    shapes = sorted((r["size"], r["k"]) for r in index.select("size", "k").distinct().collect())  # ``window`` rows at most
    prefix = {k: bit_table(index.filter(F.col("k") == k).select("gram").distinct()) for k in {k for _, k in shapes}}
    shared = spark.sparkContext.broadcast((prefix, bit_table(index.select("w1"))))
    rows = docs.select(*([row] if row is not None else []), text_key(), F.col("text"))
    schema, arrow = arrow_schema(f"n_words long, hits {HITS}", rows, ("text",))

    def scan(batches):
        import pyarrow as pa

        prefixes, table = shared.value
        for batch, texts in column_chunks(batches):
            words = HashedWords(texts, "alnum")
            sizes = words.sizes
            ends = np.cumsum(sizes)
            found = []
            for size, k in shapes:
                grams = gram_hashes(words.hashes, k)
                at = _inside(sizes, k)
                at = at[passes(grams[at], prefixes[k])]
                if not len(at):
                    continue
                text = np.searchsorted(ends, at, side="right")
                for shift in range(size - k + 1):
                    start = at - shift
                    fits = (start >= ends[text] - sizes[text]) & (start + size <= ends[text])
                    p, s, t = at[fits], start[fits], text[fits]
                    w1, w2 = _windows(words.hashes, size, s)
                    ok = passes(w1, table)
                    p, s, t, w1, w2 = p[ok], s[ok], t[ok], w1[ok], w2[ok]
                    n = np.full(len(s), size, np.int32)
                    found.append((t, s - (ends[t] - sizes[t]), n, n * 0 + shift, grams[p].view(np.int64), w1.view(np.int64), w2.view(np.int64)))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 7
            order = np.lexsort((columns[1], columns[0]))
            text, *columns = [c[order] for c in columns]
            kinds = [f.type for f in arrow[-1].type.value_type]
            hits = pa.StructArray.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds, strict=True)], fields=list(arrow[-1].type.value_type))
            bounds = np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32)
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            made = [pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), hits)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip([*kept, *made], arrow, strict=True)], schema=arrow)

    return from_batches(rows, scan, schema)


def occurrences(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(key, start, size, w1, w2) of the windows that stand in the texts: the places of ``scanned`` joined with the index."""
    places = rows.filter(F.size("hits") > 0).select("key", F.inline("hits"))
    on = ["gram", "shift", "size", "w1", "w2"]
    return places.join(small(index.select(*on)), on, "left_semi").select("key", "start", "size", "w1", "w2").distinct()


def _covered(places: Column) -> Column:
    """Words in the union of (start, size) places."""
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
    step = lambda a, p: F.struct(
        (a["n"] + F.greatest(F.lit(0), p["start"] + p["size"] - F.greatest(p["start"], a["last"]))).alias("n"),
        F.greatest(a["last"], p["start"] + p["size"]).alias("last"),
    )
    return F.aggregate(F.array_sort(places), first, step, lambda a: a["n"])


ADDED = ("n_words", "n_hit", "items", "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` but text, with n_words, n_hit (words inside occurrences), items (sorted ids as strings), contaminated."""
    spark = docs.sparkSession
    windows, index = indexed(docs, items, window, shingle)
    rows = stored(spark, scanned(docs, index, carried(docs, "text", *ADDED)), "scanned")
    met = stored(spark, occurrences(rows, index), "occurrences")
    covers = met.groupBy("key").agg(_covered(F.collect_set(F.struct("start", "size"))).cast("long").alias("n_hit"))
    named = met.select("key", "w1", "w2", "size").distinct().join(small(windows.select("w1", "w2", "size", "item").distinct()), ["w1", "w2", "size"])
    named = named.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = small(stored(spark, covers.join(named, "key"), "found"))
    out = rows.select("row", "key", "n_words").join(found, "key", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return restored(out, "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, whole, whose text holds no window of an item."""
    spark = docs.sparkSession
    _, index = indexed(docs, items, window, shingle)
    rows = stored(spark, scanned(docs, index, None).filter(F.size("hits") > 0), "scanned")
    found = small(stored(spark, occurrences(rows, index).select("key").distinct(), "found"))
    return restored(docs.select(carried(docs), text_key()).join(found, "key", "left_anti"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = """
with d as (
  select row_number() over () rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
  from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
  from benchmark),
iw as (select item_id, least(10, len(w)) n, unnest(range(0, len(w) - least(10, len(w)) + 1)) p, w from i where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[p + 1 : p + n], ' ') g from iw),
dp as (select rid, unnest(range(0, len(w))) p, w from d),
dg as (
  select rid, p, n, array_to_string(w[p + 1 : p + n], ' ') g from dp, (select distinct n from win) where p + n <= len(w)),
h as (select rid, p, dg.n, item_id from dg join win on dg.n = win.n and dg.g = win.g),
c as (select rid, count(distinct q) n_hit from (select rid, unnest(range(p, p + n)) q from h) group by rid),
t as (
  select rid, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from h group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c using (rid) left join t using (rid)
"""

QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE = {"op10_decontamination": OP10_SQL}
