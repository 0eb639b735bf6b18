"""Language-model scores: an interpolated modified Kneser-Ney model of any order from 2 on, counted in Spark.

Training texts are cut to words; a text is ``begin w1 .. wn end`` and every token but ``begin`` is predicted from the one
before. Counting is one pass: each task sums its word and bigram hashes up and hands them on in packed arrays, one row for
each of ``shards`` ranges of the hash; each range is merged to a sorted hash array with its counts, in files below
``spark.checkpoint.dir``. A second pass over the training texts looks every bigram up and sums, per word, ``1 / count``
(so each different bigram adds one): the number of different words before it, and of words that follow it once, twice or
more, which the discounts and the interpolation weights are made of. A third pass scores all texts. Workers map the files
into memory; where the shared folder is not a mounted one, they fetch them once to their own disk first.

``P(w | v) = (max(c(vw) - D(c(vw)), 0) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) P1(w)) / c(v)``; P1 has the same form over the
numbers of different words before w, with ``1 / (V + 1)`` beneath. D1, D2, D3 come from the counts of counts.

With an order above 2 a text starts with ``order - 1`` begins, the first pass counts words and n-grams of the full order, and
the second pass runs once for each level beneath, from the longest: a gram's sums over its occurrences are those of the level
above (``count`` at the top, else the number of different words before it). P is then nested level by level down to P1.

What is gathered grows with the corpus (all words and bigrams are counted, none is left out). In each task: the arrays of
``FLUSH`` tokens, and one range of a merged table.

Defined results: a null text is an empty one (one token, its end); rows with a null doc_id are training rows; an unknown
history uses P1; an empty training set gives uniform probabilities; empty tables give empty results; equal texts have
equal scores; extra columns pass through unless named like an added one.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashedWords, arrow_schema, carried, column_chunks, extended, from_batches, gathered, gram_hashes, restored, scratch

#: Tokens that a counting task holds before it hands its sums on.
FLUSH = 4_000_000
#: Text bytes scored at once.
CHUNK = 8 << 20


def _chunk(order: int) -> int:
    """Less at higher orders, whose chunks have more columns."""
    return CHUNK if order == 2 else CHUNK // 4
#: Hashes of the two marks, taken at random.
BEGIN, END = np.uint64(0x6B1F3C5D9E274A81), np.uint64(0xC3A5D7E912B4F608)


# --- shared files ----------------------------------------------------------------------------------------------------


def _mounted(folder: str) -> str:
    """The local path of a folder URI. Only a mounted folder can be mapped; another one is refused, not copied."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"the model's arrays are mapped into memory, for which {folder} has to be a mounted folder (set spark.checkpoint.dir to one)")
    return folder


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """All or nothing, so that a task that runs twice leaves one whole file."""
    path = _mounted(folder)
    os.makedirs(path, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=path, delete=False) as f:
        np.save(f, array)
    os.replace(f.name, f"{path}/{name}.npy")


@lru_cache(maxsize=1 << 14)
def _map(folder: str, name: str) -> np.ndarray:
    """An array of the model; a worker keeps so many maps at once as the system allows it."""
    return np.load(f"{_mounted(folder)}/{name}.npy", mmap_mode="r")


class Arrays:
    """Values of sorted hashes, in ``shards`` files by the hash's first bits."""

    def __init__(self, folder: str, kind: str, shards: int, columns: tuple[str, ...]):
        self.shift = np.uint64(64 - shards.bit_length() + 1)
        self.shards = shards
        self.part = lambda s: tuple(_map(folder, f"{kind}-{s}-{c}") for c in ("keys", *columns))
        self.columns = len(columns)

    def __call__(self, queries: np.ndarray) -> list[np.ndarray]:
        """Their columns for sorted ``queries``; 0 where a query is absent."""
        bounds = np.searchsorted(queries, np.arange(1, self.shards, dtype=np.uint64) << self.shift) if self.shards > 1 else []
        out = [np.zeros(len(queries)) for _ in range(self.columns)]
        for s, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(queries)], strict=True)):
            if a == b:
                continue
            keys, *values = self.part(s)
            if not len(keys):
                continue
            q = queries[a:b]
            at = np.searchsorted(keys, q)
            at[at == len(keys)] = 0
            found = keys[at] == q
            for o, v in zip(out, values, strict=True):
                o[a:b] = np.where(found, v[at], 0)
        return out


# --- counting --------------------------------------------------------------------------------------------------------


def _tokens(texts, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``order - 1`` begins and ``w1 .. wn end`` of all texts of an Arrow column, and each text's number of them."""
    words = HashedWords(texts, "space")
    sizes = words.sizes + order
    stops = np.cumsum(sizes)
    tokens = np.empty(int(stops[-1]) if len(stops) else 0, np.uint64)
    inner = np.ones(len(tokens), bool)
    for k in range(order - 1):
        tokens[stops - sizes + k], inner[stops - sizes + k] = BEGIN, False
    tokens[stops - 1], inner[stops - 1] = END, False
    tokens[inner] = words.hashes
    return tokens, sizes


def _ends(sizes: np.ndarray, order: int) -> np.ndarray:
    """The indexes of all tokens but the begins: those that are predicted."""
    starts = np.cumsum(sizes) - sizes
    return np.delete(np.arange(int(sizes.sum())), (starts[:, None] + np.arange(order - 1)).ravel())


def _hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams by their first token's index; a word's is its own."""
    return tokens if k == 1 else gram_hashes(tokens, k)


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return [k[starts], *[np.add.reduceat(v[order], starts) if len(k) else v for v in values]]


def _packed(kind: str, shards: int, keys: np.ndarray, columns: list[np.ndarray]):
    """Rows (kind, shard, keys, columns as one binary) of sorted keys."""
    shift = np.uint64(64 - shards.bit_length() + 1)
    bounds = np.searchsorted(keys, np.arange(1, shards, dtype=np.uint64) << shift) if shards > 1 else []
    for s, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(keys)], strict=True)):
        if a < b:
            yield kind, s, keys[a:b].tobytes(), *[c[a:b].tobytes() for c in columns]


ROWS = "kind string, shard int, keys binary, counts binary"


def _counts(docs: DataFrame, shards: int, order: int) -> DataFrame:
    schema, arrow = arrow_schema(ROWS)

    def count(batches):
        import pyarrow as pa

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        def flush():
            for kind, hashed in (("word", words), ("gram", grams)):
                k, n = np.unique(np.concatenate(hashed), return_counts=True)
                rows = list(_packed(kind, shards, k, [n.astype(np.uint32)]))
                for i in range(0, len(rows), 256):
                    yield batch_of(rows[i : i + 256])

        words, grams, held = [], [], 0
        for _, texts in column_chunks(batches):
            t, sizes = _tokens(texts, order)
            words.append(t)
            grams.append(_hashes(t, order)[_ends(sizes, order) - order + 1] if len(t) else t)
            held += len(t)
            if held >= FLUSH:
                yield from flush()
                words, grams, held = [], [], 0
        if held:
            yield from flush()

    return from_batches(docs.select("text"), count, schema)


STATS = "kind string, shard int, keys long, total double, n1 long, n2 long, n3 long, n4 long"


def _classes(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _narrow(c: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest of them needs, up to eight."""
    return c.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if c.max(initial=0) <= np.iinfo(t).max))


def _merge_counts(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the sorted arrays of each range; one row of sums a range."""
    def merge(key, pdf):
        import pandas as pd

        kind, shard = key
        k, c = _summed(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]]), np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf["counts"]]))
        _write(folder, f"{kind}-{shard}-keys", k)
        _write(folder, f"{kind}-{shard}-count", _narrow(c))
        own = c[k != BEGIN] if kind == "word" else c
        return pd.DataFrame([[kind, shard, len(own), float(own.sum()), *_classes(own)]], columns=[x.split()[0] for x in STATS.split(", ")])

    return rows.groupBy("kind", "shard").applyInPandas(merge, STATS)


def _kind(k: int, order: int) -> str:
    return "word" if k == 1 else "gram" if k == order else f"gram{k}"


def _columns(k: int, order: int) -> tuple[str, ...]:
    """What ``_contexts`` gives for a level; with order 2 a history's total is its word's count."""
    return ("before", "n1", "n2", "n3", *(("total",) if order > 2 else ()), *(("count",) if k > 1 else ()))


def _contexts(docs: DataFrame, folder: str, shards: int, order: int, k: int) -> DataFrame:
    """Per k-gram and task: different words before it, and of different words after it those of class 1, 2, more.

    Over order 2 also the sum over what follows it, and for more than words its own occurrences."""
    names = _columns(k, order)
    schema, arrow = arrow_schema(", ".join(["shard int, keys binary", *[f"{c} binary" for c in names]]))

    def look(batches):
        import pyarrow as pa

        def flush():
            merged = _summed(*[np.concatenate(x) for x in zip(*held, strict=True)])
            # few different values in the columns of sums: much smaller when packed
            rows = [(r[1], r[2], *[zlib.compress(c, 1) for c in r[3:]]) for r in _packed("", shards, merged[0], merged[1:])]
            for i in range(0, len(rows), 256):
                own = rows[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own, strict=True), arrow, strict=True)], schema=arrow)

        held, size = [], 0
        above = None
        for _, texts in column_chunks(batches, budget=_chunk(order)):
            above = above or Arrays(folder, _kind(k + 1, order), shards, ("count", *(("before",) if k + 1 < order else ())))
            t, sizes = _tokens(texts, order)
            if not len(t):
                continue
            first = _ends(sizes, order) - k
            different, at = np.unique(_hashes(t, k + 1)[first], return_inverse=True)
            found = above(different)
            share, c = 1.0 / found[0][at], found[-1][at]
            nothing = np.zeros(len(c))
            own = _hashes(t, k)
            given = {"before": np.r_[share, nothing], "total": np.r_[nothing, c * share], "count": np.r_[nothing + 1, nothing]}
            given |= {f"n{i}": np.r_[nothing, np.where(x, share, 0)] for i, x in enumerate((c == 1, c == 2, c >= 3), 1)}
            held.append(_summed(np.concatenate([own[first + 1], own[first]]), *[given[n] for n in names]))
            size += len(held[-1][0])
            if size >= FLUSH // 4:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return from_batches(docs.select("text"), look, schema)


def _merge_contexts(rows: DataFrame, folder: str, order: int, k: int) -> DataFrame:
    kind, names = _kind(k, order), _columns(k, order)

    def merge(key, pdf):
        import pandas as pd

        hashed = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        keys, *sums = _summed(hashed, *[np.concatenate([np.frombuffer(zlib.decompress(x), np.float64) for x in pdf[c]]) for c in names])
        sums = [np.rint(s).astype(np.uint64) for s in sums]
        # a word's keys are those of the word counts, whose tokens these are
        if k > 1:
            _write(folder, f"{kind}-{key[0]}-keys", keys)
        for name, s in zip(names, sums, strict=True):
            _write(folder, f"{kind}-{key[0]}-{name}", _narrow(s))
        return pd.DataFrame([[kind, key[0], len(keys), float(sums[0].sum()), *_classes(sums[0])]], columns=[x.split()[0] for x in STATS.split(", ")])

    return rows.groupBy("shard").applyInPandas(merge, STATS)


def _discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """D1, D2, D3 of modified Kneser-Ney, within (0, class] where counts of counts are too few to tell."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [i - (i + 1) * y * above / own if own and above else i * 0.5 for i, own, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), float(i)) for i, d in enumerate(raw, 1)]


class Model:
    """A trained model: the folder of its arrays and its few totals."""

    def __init__(self, folder: str, shards: int, totals: dict, order: int = 2):
        self.folder, self.shards, self.totals, self.order = folder, shards, totals, order

    def scorer(self):
        """A function: texts -> arrays of n_tokens, n_known, base_score, score."""
        order = self.order
        levels = [Arrays(self.folder, _kind(k, order), self.shards, (*(("count",) if k == 1 else ()), *_columns(k, order))) for k in range(1, order)]
        grams = Arrays(self.folder, "gram", self.shards, ("count",))
        t = self.totals
        d = [np.array([0, *x]) for x in t["d"]]  # by level from 1
        level = lambda c: np.minimum(c, 3).astype(np.int64)

        def score(texts):
            tokens, sizes = _tokens(texts, order)
            ends = _ends(sizes, order)
            for k in range(1, order + 1):
                own, at = np.unique(_hashes(tokens, k) if k < order else _hashes(tokens, k)[ends - k + 1], return_inverse=True)
                if k < order:
                    found = dict(zip((*(("count",) if k == 1 else ()), *_columns(k, order)), levels[k - 1](own), strict=True))
                    this = at[ends - k + 1]
                c = found["before"][this] if k < order else grams(own)[0][at]
                if k == 1:
                    low = (np.maximum(found["before"] - d[0][level(found["before"])], 0) + t["spare"] / (t["types"] + 1)) / t["before"] if t["before"] else np.full(len(own), 1.0 / (t["types"] + 1))
                    p, base, known = low[this], np.log10((found["count"] + 1) / (t["tokens"] + t["types"] + 1))[this], found["count"][this] > 0
                else:
                    rest = d[k - 1][1] * n1 + d[k - 1][2] * n2 + d[k - 1][3] * n3
                    with np.errstate(divide="ignore", invalid="ignore"):
                        p = np.where(total > 0, (np.maximum(c - d[k - 1][level(c)], 0) + rest * p) / total, p)
                if k < order:
                    v = at[ends - k]
                    n1, n2, n3, total = (found[x][v] for x in ("n1", "n2", "n3", "total" if order > 2 else "count"))
            starts = np.cumsum(sizes - order + 1) - (sizes - order + 1)
            sums = lambda x: np.add.reduceat(x, starts)
            return sizes - order + 1, sums(known.astype(np.int64)), sums(base), sums(np.log10(p))

        return score


def train(docs: DataFrame, order: int = 2) -> Model:
    """A model of all texts of ``docs``, with ``order - 1`` words of context."""
    if order < 2:
        raise ValueError(f"order {order} is below 2")
    spark = docs.sparkSession
    folder = scratch(spark, "model")
    # two ranges a partition of the input, whose size Spark bounds, so that a range does not grow with the corpus
    shards = 1 << max(3, int(2 * docs.rdd.getNumPartitions() - 1).bit_length())
    stats = gathered(_merge_counts(_counts(docs, shards, order), folder))  # one row for each range
    _fill(folder, shards, {(r["kind"], r["shard"]) for r in stats}, order)
    total = {k: [sum(r[x] for r in stats if r["kind"] == k) for x in ("keys", "total", "n1", "n2", "n3", "n4")] for k in ("word", "gram")}
    d = [_discounts(*total["gram"][2:])]
    for k in range(order - 1, 0, -1):
        rows = gathered(_merge_contexts(_contexts(docs, folder, shards, order, k), folder, order, k))
        if k > 1:
            _fill(folder, shards, {(r["kind"], r["shard"]) for r in rows}, order, (k,))
        low = [sum(x) for x in zip(*[(r["total"], r["n1"], r["n2"], r["n3"], r["n4"], r["keys"]) for r in rows], strict=True)] or [0] * 6
        d.insert(0, _discounts(*low[1:5]))
    types, e = total["word"][0], d[0]
    many = types - low[1] - low[2]
    return Model(folder, shards, {"tokens": total["word"][1], "types": types, "d": d, "before": low[0], "spare": e[0] * low[1] + e[1] * low[2] + e[2] * many}, order)


def _fill(folder: str, shards: int, there: set, order: int, levels: tuple[int, ...] | None = None) -> None:
    """Empty arrays for ranges without a key."""
    for s in range(shards):
        for k in levels or (1, order):
            kind, columns = _kind(k, order), ("count",) if k == order else ("count", *_columns(1, order)) if k == 1 else _columns(k, order)
            if (kind, s) not in there:
                _write(folder, f"{kind}-{s}-keys", np.empty(0, np.uint64))
                for c in columns:
                    _write(folder, f"{kind}-{s}-{c}", np.empty(0, np.uint32))


ADDED = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score (add-one unigram) and score (log10 probability of the text)."""
    names = [x.split()[0] for x in ADDED.split(", ")]
    gone = ("text",) if "text" in drop else ()
    rows = docs.select(carried(docs, *names, *drop, "text"), F.col("text"))
    schema, arrow = arrow_schema(ADDED, rows, gone)
    folder, shards, totals, order = model.folder, model.shards, model.totals, model.order

    def run(batches):
        import pyarrow as pa

        scorer = None
        for batch, texts in column_chunks(batches, budget=_chunk(order)):
            scorer = scorer or Model(folder, shards, totals, order).scorer()
            yield extended(batch, [pa.array(x) for x in scorer(texts)], arrow, gone)

    return restored(from_batches(rows, run, schema), *(() if gone else ("text",)), *names)


def held_out(doc_id: Column, of: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == fold, F.lit(False))


def op5_kneser_ney(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))), order)
    out = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, ("text",))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.totals["tokens"])).cast("long").alias("train_tokens"), F.round("base_score", 7).alias("base_score"), F.round("score", 7).alias("score"))


def op5_kneser_ney_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_kneser_ney(spark, sf_dir, 3)


OP5_SQL = """
with d as (
  select row_number() over () rid, doc_id, list_concat(list_concat([' begin'], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')), [' end']) t,
    list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) crc
  from documents),
e as (select rid, doc_id, coalesce(xor(crc, 4294967295) % 7 = 2, false) held_out, t from d),
p as (select rid, held_out, t[i] v, t[i + 1] w from (select rid, held_out, t, unnest(range(1, len(t))) i from e)),
c2 as (select v, w, count(*) c from p where not held_out group by v, w),
c1 as (select w, sum(c) c, count(*) before from c2 group by w),
hv as (select v, sum(c) c, count(*) filter (c = 1) n1, count(*) filter (c = 2) n2, count(*) filter (c >= 3) n3 from c2 group by v),
k as (
  select (select coalesce(sum(c), 0)::bigint from c1) tokens, (select count(*) from c1) types, (select count(*) from c2) pairs,
    (select [count(*) filter (c = 1), count(*) filter (c = 2), count(*) filter (c = 3), count(*) filter (c = 4)] from c2) a,
    (select [count(*) filter (before = 1), count(*) filter (before = 2), count(*) filter (before = 3), count(*) filter (before = 4)] from c1) b),
k2 as (
  select *, case when a[1] > 0 then a[1]::double / (a[1] + 2 * a[2]) else 0.5e0 end ya, case when b[1] > 0 then b[1]::double / (b[1] + 2 * b[2]) else 0.5e0 end yb from k),
k3 as (
  select *, list_transform(range(1, 4), lambda i: least(greatest(case when a[i] > 0 and a[i + 1] > 0 then i - (i + 1) * ya * a[i + 1] / a[i] else i * 0.5e0 end, 0.05e0), i::double)) dd,
    list_transform(range(1, 4), lambda i: least(greatest(case when b[i] > 0 and b[i + 1] > 0 then i - (i + 1) * yb * b[i + 1] / b[i] else i * 0.5e0 end, 0.05e0), i::double)) ee from k2),
s as (
  select rid, c1.c is not null known, log10((coalesce(c1.c, 0) + 1) / (tokens + types + 1)::double) base,
    case when pairs > 0 then (greatest(coalesce(before, 0) - case when before is null then 0 else ee[least(before, 3)] end, 0)
      + (ee[1] * b[1] + ee[2] * b[2] + ee[3] * (types - b[1] - b[2])) / (types + 1)) / pairs else 1e0 / (types + 1) end low,
    hv.c head, greatest(coalesce(c2.c, 0) - case when c2.c is null then 0 else dd[least(c2.c, 3)] end, 0) top, dd[1] * n1 + dd[2] * n2 + dd[3] * n3 rest
  from p left join c1 using (w) left join hv using (v) left join c2 using (v, w) cross join k3),
g as (
  select rid, count(*) n_tokens, count(*) filter (known) n_known, sum(base) base_score, sum(log10(case when head is null then low else (top + rest * low) / head end)) score from s group by rid)
select doc_id, held_out, n_tokens, n_known, (select tokens from k) train_tokens, round(base_score, 7) base_score, round(score, 7) score
from e join g using (rid)
"""

QUERIES = {"op5_kneser_ney": op5_kneser_ney, "op5_kneser_ney_order3": op5_kneser_ney_order3}
ORACLE = {"op5_kneser_ney": OP5_SQL}
