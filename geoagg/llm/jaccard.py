"""N-gram Jaccard join: components of documents whose shingle sets are similar, by a token-group matrix.

A document's set is its distinct ``width``-word shingles (64-bit hashes). Two sets link when
``100 * |A and B| >= percent * |A or B|``. Equal sets are one node, named by a 64-bit signature of the set (two of n different
sets share one with a chance of n * n / 2**65). Steps:

1. Signatures: one row (doc_id, n, sig) a document. Copies meet here, in a partial aggregate, and nowhere later.
2. Token order: counts of hashed tokens in a table of fixed size, summed over all documents; rare tokens come first, ties
   by hash. Any fixed order gives exact results, this one keeps common lines and passages out of the prefixes.
3. Prefixes: linked sets share a token among the first ``n - ceil(percent * n / 100) + 1`` of each. Only tokens in the
   prefixes of two different sets matter further; what has none of these is linked to nothing.
   Sets with a frequent token in their prefix would meet in numbers that grow with its square. For these, frequent
   tokens are replaced by segments: hashed into one more segment than linked sets of their size can differ in tokens, two
   linked sets agree in a whole segment; its hash takes the place of a token. Sizes are dealt to classes so that linked
   sets lie in the same or in adjoining ones.
4. Groups: sets are linked with the leader (the most shared prefix) of each of their tokens if the exact test holds; the components of these links partition similar documents into groups. Leaders give as many pairs as there are
   prefix rows at most, never all pairs of a group.
5. Token-group matrix: (token, group) rows with the group's range of sizes, and each group's token union as a bit map. A
   set queries the groups of its tokens that are larger than its own (ties by name); sizes and the overlap bound ``|q| - bits of q missing in the
   union`` discard most (tokens of a prefix that no other prefix has count as missing at once), and only groups that qualify are opened: their members are bounded in the same way and the rest
   compared exactly. All links between groups share a prefix token, so none is lost.
6. Components over both kinds of links by repeated minimum with pointer jumping; labels are tables, nothing is collected.

Pairs are first bounded by bit maps of their tokens, sizes included; full token sets are fetched, from the texts, only for
pairs that pass, selected by a bit table that is sized by their number.

Defined results: null or empty texts and texts without words have n_shingles 0 and are their own component; a text with
fewer words than ``width`` has one shingle; rows with a null doc_id get the smallest doc_id of their component, or null;
repeated rows are copies; empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashedWords, arrow_schema, bit_table, carried, column_chunks, drop_scratch, extended, from_batches, gram_hashes, mix, passes, restored, small, stored, text_key

#: Bits of a set's or a group's token union.
UNION_BITS = 2048
#: Entries of the hashed token counts, as a power of two, and of one of their blocks.
COUNT_BITS = 22
BLOCK = 4096
#: Prefix tokens in more sets than this are frequent.
FREQUENT = 128


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow column."""
    words = HashedWords(column, "space")
    grams = gram_hashes(words.hashes, width)
    out, at = [], 0
    for n in words.sizes.tolist():
        own = grams[at : at + n - width + 1].copy() if n >= width else gram_hashes(words.hashes[at : at + n], n) if n else grams[:0]
        at += n
        own.sort()
        out.append(own[np.r_[True, own[1:] != own[:-1]]] if n > width else own)
    return out


def signature(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


COUNT_ROWS = "_part int, _block int, _counts binary"


def signed(docs: DataFrame, width: int, keep: tuple[str, ...] | None = None, bits: int = 0) -> DataFrame:
    """The columns ``keep`` (None: all) of ``docs`` with ``_n`` and ``_sig``, null for an empty set.

    With ``bits``, rows with a ``_block`` follow: each task's token counts, in a table of 2**bits entries.
    """
    drop = tuple(c for c in docs.columns if keep is not None and c not in keep)
    schema, arrow = arrow_schema("_n long, _sig long" + f", {COUNT_ROWS}" * bool(bits), docs, drop)

    def sign(batches):
        import pyarrow as pa

        counts = Counts(bits) if bits else None
        for batch, texts in column_chunks(batches):
            sets = shingle_sets(texts, width)
            if counts:
                counts.add(np.concatenate(sets))
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.int64())]
            yield extended(batch, made + ([pa.nulls(len(sets))] * 3 if bits else []), arrow, drop)
        for rows in counts.rows() if counts else ():
            nothing = [pa.nulls(len(rows[0]), f.type) for f in list(arrow)[:-3]]
            yield pa.RecordBatch.from_arrays(nothing + rows, schema=arrow)

    return from_batches(docs, sign, schema)


# --- tables of fixed size --------------------------------------------------------------------------------------------


class Counts:
    """One task's counts of hashes."""

    def __init__(self, bits: int):
        self.total = np.zeros(1 << bits, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        at, c = np.unique((hashes & np.uint64(len(self.total) - 1)).astype(np.uint32), return_counts=True)
        self.total[at] += c.astype(np.uint32)

    def rows(self):
        """Column lists (part, block, counts) of the blocks that are not all zero."""
        import pyarrow as pa
        from pyspark import TaskContext

        parts = np.minimum(self.total, 255).astype(np.uint8).reshape(-1, BLOCK)
        blocks = np.flatnonzero(parts.any(axis=1))
        for i in range(0, len(blocks), 256):
            own = blocks[i : i + 256]
            yield [pa.array(np.full(len(own), TaskContext.get().partitionId(), np.int32)), pa.array(own.astype(np.int32)), pa.array([_packed(parts[b]) for b in own], pa.binary())]


def _packed(counts: np.ndarray) -> bytes:
    """A block's counts up to 255: all of them, or places and counts where most are zero."""
    at = np.flatnonzero(counts).astype(np.uint16)
    return counts.tobytes() if 3 * len(at) >= BLOCK else at.tobytes() + counts[at].tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    if len(x) == BLOCK:
        return np.frombuffer(x, np.uint8).astype(np.uint32)
    n, out = len(x) // 3, np.zeros(BLOCK, np.uint32)
    out[np.frombuffer(x, np.uint16, n)] = np.frombuffer(x, np.uint8, n, 2 * n)
    return out


def summed(rows: DataFrame, bits: int) -> np.ndarray:
    """All tasks' counts added up, in two steps, to one byte an entry: exact below 64, then in steps of a tenth."""

    def adder(read):
        def add(key, pdf):
            import pandas as pd

            total = np.zeros(BLOCK, np.uint64)
            for x in pdf["_counts"]:
                total += read(x)
            return pd.DataFrame({"_block": [key[0]], "_counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

        return add

    schema = "_block int, _counts binary"
    once = rows.groupBy("_block", F.pmod(F.xxhash64("_part"), F.lit(4)).alias("_part")).applyInPandas(adder(_unpacked), schema)
    out = np.zeros(1 << bits, np.uint8)
    for r in once.groupBy("_block").applyInPandas(adder(lambda x: np.frombuffer(x, np.uint32)), schema).toLocalIterator():
        c = np.frombuffer(r["_counts"], np.uint32)
        steps = 64 + np.floor(np.log(np.maximum(c, 1) / 64.0) * 10)
        out[r["_block"] * BLOCK : (r["_block"] + 1) * BLOCK] = np.where(c < 64, c, np.minimum(steps, 255)).astype(np.uint8)
    return out


# --- prefixes and sets -----------------------------------------------------------------------------------------------


def union_bits(tokens: np.ndarray) -> bytes:
    flags = np.zeros(UNION_BITS, bool)
    flags[(mix(tokens) % np.uint64(UNION_BITS)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def prefixes(docs: DataFrame, width: int, percent: int, counts) -> DataFrame:
    """Rows (sig, lead, ord, n, bits) for each set and (sig, lead, ord, token) for each token of its prefix. A task gives copies once.

    ``ord``: the token's place in the order of all tokens (rank and 24 bits of hash), for a set that of its prefix's last.

    ``lead``: mean rank of the prefix, then the first bits of the signature. What a set shares with many others ranks high,
    so the set that a group of near copies derives from, which has few tokens of its own, has the group's largest value.
    """
    schema, arrow = arrow_schema("sig long, lead long, ord long, token long, n long, bits binary")

    def cut(batches):
        import pyarrow as pa

        table, seen = counts.value, set()
        mask = np.uint64(len(table) - 1)
        for _, texts in column_chunks(batches):
            tokens, orders, sigs, leads, sizes, bits = [], [], [], [], [], []
            for s in shingle_sets(texts, width):
                n = len(s)
                if not n or (sig := signature(s)) in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(sig)
                p = n - (percent * n + 99) // 100 + 1
                rank = table[(s & mask).astype(np.int64)]
                # the p smallest by (rank, hash): the hashes are sorted already
                cutoff = np.partition(rank, p - 1)[p - 1]
                low = np.flatnonzero(rank < cutoff)
                own = np.concatenate([low, np.flatnonzero(rank == cutoff)[: p - len(low)]])
                tokens.append(s[own])
                orders.append((rank[own].astype(np.int64) << 24) + (s[own] >> np.uint64(40)).astype(np.int64))
                sigs.append(sig)
                leads.append((int(rank[own].mean()) << 55) + ((sig & (1 << 64) - 1) >> 9))
                sizes.append(n)
                bits.append(union_bits(s))
            if tokens:
                k, token = np.repeat(np.arange(len(sigs)), [len(t) for t in tokens]), np.concatenate(tokens).view(np.int64)
                sigs, leads = np.array(sigs, np.int64), np.array(leads, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sigs[k]), pa.array(leads[k]), pa.array(np.concatenate(orders)), pa.array(token), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.binary())], schema=arrow)
                yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(leads), pa.array([x.max() for x in orders], pa.int64()), pa.nulls(len(sigs), pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], schema=arrow)

    return from_batches(docs.select("text"), cut, schema)


def _active(sets: list[np.ndarray], table: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signature, set) of the sets, without empty ones, that pass a bit table of signatures."""
    own = [s for s in sets if len(s)]
    sigs = np.array([signature(s) for s in own], np.int64)
    return [(int(sigs[i]), own[i]) for i in np.flatnonzero(passes(sigs.view(np.uint64), table))]


def token_sets(docs: DataFrame, width: int, active) -> DataFrame:
    """(part, sig, tokens) of the sets that pass the bit table ``active``; a task gives copies once."""
    schema, arrow = arrow_schema("part int, sig long, tokens binary")

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        seen, part = set(), TaskContext.get().partitionId()
        for _, texts in column_chunks(batches):
            rows = []
            for sig, s in _active(shingle_sets(texts, width), active.value):
                if sig in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(sig)
                rows.append((part, sig, s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return from_batches(docs.select("text"), gather, schema)


def size_classes(percent: int, most: int) -> list[int]:
    """First size of each class, up to ``most``: a size linked with one of a class lies in it or in a neighbour."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(100 * starts[-1] // percent + 1)
    return starts


def segment_hashes(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the segments of a set, for the class of its size as the smaller and as the larger one of a pair."""
    starts = size_classes(percent, len(tokens))
    own = len(starts) - 2
    out = []
    with np.errstate(over="ignore"):
        for c in (own, own - 1):
            if c < 0:
                continue
            a = starts[c + 1] - 1 if c + 1 < len(starts) else 100 * starts[c] // percent
            segments = (100 - percent) * (a + 100 * a // percent) // (100 + percent) + 1
            h = mix(tokens + np.uint64(0x632BE59BD9B4E019))
            sums = np.zeros(segments, np.uint64)
            np.add.at(sums, (h % np.uint64(segments)).astype(np.int64), mix(h))
            out.append(mix(sums + mix(np.arange(segments, dtype=np.uint64) + np.uint64((c + 1) << 32))))
    return np.concatenate(out)


def segments(docs: DataFrame, width: int, percent: int, active) -> DataFrame:
    """(sig, token): the segment hashes, as tokens, of the sets that pass the bit table ``active``."""
    schema, arrow = arrow_schema("sig long, token long")

    def cut(batches):
        import pyarrow as pa

        seen = set()
        for _, texts in column_chunks(batches):
            for sig, s in _active(shingle_sets(texts, width), active.value):
                if sig in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(sig)
                h = segment_hashes(s, percent)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), sig, np.int64)), pa.array(h.view(np.int64))], schema=arrow)

    return from_batches(docs.select("text"), cut, schema)


def _one_row_each(sets: DataFrame) -> DataFrame:
    """``sets`` with one row a signature: copies that lay in several partitions were gathered in each."""
    several = sets.groupBy("sig").agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first < last")
    several = small(stored(sets.sparkSession, several.select("sig", "first"), "several_parts"))
    return sets.join(several, "sig", "left").filter(F.col("part") == F.coalesce("first", "part")).drop("first", "part")


# --- bounds and links ------------------------------------------------------------------------------------------------


def needed(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b: ceil(percent * (a + b) / (100 + percent))."""
    return -(-percent * (a + b) // (100 + percent))


def _missing(a: list, b: list) -> np.ndarray:
    """Bits of each a that its b lacks."""
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)


def bounded(pairs: DataFrame, percent: int, both: bool) -> DataFrame:
    """Rows of (a, b, na, nb, bits_a, bits_b) whose overlap bound reaches what a link needs; ``both``: b is a set too."""
    schema, arrow = arrow_schema("a long, b long")

    def bound(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb, x, y = (batch.column(i) for i in range(6))
            na, nb, x, y = na.to_numpy(zero_copy_only=False), nb.to_numpy(zero_copy_only=False), x.to_pylist(), y.to_pylist()
            fits = na - _missing(x, y) >= needed(na, nb, percent)
            if both:
                fits &= nb - _missing(y, x) >= needed(na, nb, percent)
            keep = pa.array(fits)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], schema=arrow)

    return from_batches(pairs.select("a", "b", "na", "nb", "bits_a", "bits_b"), bound, schema)


def _side(node: DataFrame, s: str, *columns: str) -> DataFrame:
    return node.select(F.col("sig").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])


def _need(a: str, b: str, percent: int):
    return F.ceil(percent * (F.col(a) + F.col(b)) / F.lit(100.0 + percent) - 1e-9)


FACTS = ("n", "ord", "alone", "until")


def _plausible(percent: int):
    """Whether sizes and lonely tokens of (n_a, ..) and (n_b, ..) allow a link."""
    need = _need("n_a", "n_b", percent)
    left = lambda x, y: F.col(f"n_{x}") - F.when(F.col(f"until_{x}") < F.col(f"ord_{y}"), F.col(f"alone_{x}")).otherwise(0)
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (left("a", "b") >= need) & (left("b", "a") >= need)


def near(pairs: DataFrame, node: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bit maps allow to link."""
    sized = pairs.join(_side(node, "a", *FACTS), "a").join(_side(node, "b", *FACTS), "b").filter(_plausible(percent))
    sized = stored(pairs.sparkSession, sized.select("a", "b", F.col("n_a").alias("na"), F.col("n_b").alias("nb")), "sized")
    mapped = sized.join(_side(node, "a", "bits"), "a").join(_side(node, "b", "bits"), "b")
    return stored(pairs.sparkSession, bounded(mapped, percent, True), "near")


def linked(docs: DataFrame, width: int, percent: int, pairs: DataFrame) -> DataFrame:
    """The stored pairs (a, b) of signatures whose sets link."""
    spark = docs.sparkSession
    if not pairs.limit(1).count():
        return pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sig"))
    sets = _one_row_each(stored(spark, token_sets(docs, width, spark.sparkContext.broadcast(bit_table(ends.distinct()))), "sets"))
    side = lambda s: sets.select(F.col("sig").alias(s), F.col("tokens").alias(f"tokens_{s}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "tokens_a", "tokens_b")
    schema, arrow = arrow_schema("a long, b long")

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], schema=arrow)

    return stored(spark, from_batches(full, compare, schema), "links")


def components(links: DataFrame) -> DataFrame:
    """(sig, comp): the smallest signature that each linked one reaches."""
    spark = links.sparkSession
    both = stored(spark, links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "both")
    labels = held = stored(spark, both.groupBy(F.col("u").alias("sig")).agg(F.min(F.least("u", "v")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("sig").alias("v"), "comp"), "v").groupBy(F.col("u").alias("sig")).agg(F.min("comp").alias("near"))
        moved = labels.join(seen, "sig").select("sig", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("sig").alias("low"), F.col("comp").alias("far"))
        step = stored(spark, moved.join(jump, "low", "left").select("sig", "comp", F.least("low", F.coalesce("far", "low")).alias("next")), "step")
        changed = step.filter(F.col("comp") != F.col("next")).limit(1).count()
        drop_scratch(held)
        labels, held = step.select("sig", F.col("next").alias("comp")), step
        if not changed:
            drop_scratch(both)
            return labels


def _unions(node: DataFrame) -> DataFrame:
    """(b, nb, bits_b): each group's smallest size and the token union of its members; large groups in two salted steps."""
    schema = "comp long, least long, bits binary"

    def join(key, pdf):
        import pandas as pd

        bits = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in pdf["bits"]]), axis=0)
        return pd.DataFrame({"comp": [key[0]], "least": [pdf["least"].min()], "bits": [bits.tobytes()]})

    rows = node.filter("grouped").select("comp", F.col("n").alias("least"), "bits", F.pmod(F.xxhash64("sig"), F.lit(256)).alias("salt"))
    groups = rows.groupBy("comp", "salt").applyInPandas(join, schema).groupBy("comp").applyInPandas(join, schema)
    alone = node.filter("not grouped").select("comp", F.col("n").alias("least"), "bits")
    return groups.union(alone).select(F.col("comp").alias("b"), F.col("least").alias("nb"), F.col("bits").alias("bits_b"))


def set_components(docs: DataFrame, counts: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """(sig, comp) for the sets of ``docs.text`` that link with a different set. ``counts``: the block rows of ``signed``."""
    spark = docs.sparkSession
    rows = stored(spark, prefixes(docs, width, percent, spark.sparkContext.broadcast(summed(counts, bits))), "prefixes")
    prefix = rows.filter(F.col("token").isNotNull()).select("token", "sig", "lead", "ord")

    def met_in(rows: DataFrame, name: str) -> DataFrame:
        """The tokens that two different sets have, with the leader's value and the number of rows."""
        tokens = rows.groupBy("token").agg(F.max("lead").alias("head"), F.min("lead").alias("least"), F.count("*").alias("rows"))
        return stored(spark, tokens.filter("least < head").select("token", "head", "rows"), name)

    leaders = met_in(prefix, "leaders")
    joined = stored(spark, prefix.select("token", "sig").join(leaders, "token"), "joined")
    shared = joined.filter(F.col("rows") <= FREQUENT).drop("rows")
    lonely = None
    if leaders.filter(F.col("rows") > FREQUENT).limit(1).count():
        busy = joined.filter(F.col("rows") > FREQUENT).select("sig").distinct()
        busy = stored(spark, rows.filter(F.col("token").isNull()).select("sig", "lead").distinct().join(busy, "sig"), "busy")
        cut = segments(docs, width, percent, spark.sparkContext.broadcast(bit_table(busy.select("sig"))))
        cut = stored(spark, cut.join(busy, "sig").select("token", "sig", "lead"), "segments")
        shared = shared.unionByName(cut.select("token", "sig").join(met_in(cut, "segment_leaders").drop("rows"), "token"))
        own = prefix.join(small(busy.select("sig")), "sig", "left_semi").select("token", "sig", "ord").distinct().join(leaders.select("token"), "token", "left_anti")
        lonely = stored(spark, own.groupBy("sig").agg(F.max("ord").alias("last_alone")), "lonely")
    shared = stored(spark, shared, "shared")
    # alone: tokens of the prefix that no other prefix has; until: none of these lies behind it
    met = joined.groupBy("sig").agg(F.count("*").alias("met"))
    node = rows.filter(F.col("token").isNull()).select("sig", "lead", "ord", "n", "bits").join(met, "sig").dropDuplicates(["sig"])
    node = node.join(lonely, "sig", "left") if lonely is not None else node.withColumn("last_alone", F.lit(None).cast("long"))
    length = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    node = node.withColumns({"alone": F.greatest(length - F.col("met"), F.lit(0)).cast("long"), "until": F.coalesce("last_alone", "ord")})
    node = stored(spark, node.drop("met", "last_alone"), "node")
    drop_scratch(rows, joined)

    pairs = shared.select(F.col("sig").alias("a"), "head").distinct()
    pairs = pairs.join(node.select(F.col("lead").alias("head"), F.col("sig").alias("b")), "head").filter("a <> b").select("a", "b")
    first = linked(docs, width, percent, near(pairs, node, percent))
    # the token-group matrix: each set's group is its component, or itself
    groups = components(first)
    groups = groups.join(groups.groupBy("comp").agg(F.count("*").alias("members")), "comp")
    node = node.join(groups, "sig", "left").select("sig", "n", "bits", "ord", "alone", "until", F.coalesce("comp", "sig").alias("comp"), F.coalesce("members", F.lit(1)).alias("members"), F.col("comp").isNotNull().alias("grouped"))
    node = stored(spark, node, "grouped")
    asks = stored(spark, shared.select("token", "sig").join(node.select("sig", "n", "comp", "members", "ord", "alone", "until"), "sig"), "asks")
    matrix = asks.groupBy("token", F.col("comp").alias("b")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("ord").alias("first_ord"), F.max("until").alias("b_until"), F.max(F.col("n") - F.col("alone")).alias("free"), F.max("members").alias("b_members")
    )
    matrix = stored(spark, matrix, "matrix")
    # a token that no other prefix has is in no set whose prefix ends behind it (``near`` bounds single pairs like this, too)
    need = _need("n", "least", percent)
    fits = (F.col("n") - F.when(F.col("until") < F.col("first_ord"), F.col("alone")).otherwise(0) >= need) & (F.when(F.col("b_until") < F.col("ord"), F.col("free")).otherwise(F.col("most")) >= need)
    # the smaller group asks the larger one
    asking = (F.col("members") < F.col("b_members")) | ((F.col("members") == F.col("b_members")) & (F.col("comp") < F.col("b")))
    met = asks.join(matrix, "token").filter(asking & (100 * F.col("n") >= percent * F.col("least")) & (percent * F.col("n") <= 100 * F.col("most")) & fits)
    met = stored(spark, met.select(F.col("sig").alias("a"), "b").distinct(), "met")
    opened = stored(spark, bounded(met.join(_side(node, "a", "n", "bits").withColumnRenamed("n_a", "na"), "a").join(_unions(node), "b"), percent, False), "opened")
    # the members of the opened groups, bounded as they are met
    asked = opened.withColumnRenamed("b", "g").join(_side(node, "a", *FACTS, "bits"), "a")
    members = node.select(F.col("comp").alias("g"), F.col("sig").alias("b"), *[F.col(c).alias(f"{c}_b") for c in (*FACTS, "bits")])
    inside = asked.join(members, "g").filter(_plausible(percent)).select("a", "b", F.col("n_a").alias("na"), F.col("n_b").alias("nb"), "bits_a", "bits_b")
    second = linked(docs, width, percent, stored(spark, bounded(inside, percent, True), "inside"))
    out = components(first.union(second))
    drop_scratch(shared, node, asks, matrix, met, opened)
    return out


def named_components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: the documents' (doc_id, key, _n, _sig), and (_sig, component_id, comp) of all sets that are not empty.

    ``key``: MD5 of the text.
    """
    spark = docs.sparkSession
    # tables of token counts grow with the documents, from 4 to 16 MB; any order is right, a good one is cheap
    bits = min(COUNT_BITS + 2, max(COUNT_BITS, (16 * docs.select("doc_id").count()).bit_length()))
    both = stored(spark, signed(docs.select("doc_id", text_key(), "text"), width, ("doc_id", "key"), bits), "signs")
    signs = both.filter(F.col("_block").isNull()).select("doc_id", "key", "_n", "_sig")
    found = set_components(docs, both.filter(F.col("_block").isNotNull()).select("_part", "_block", "_counts"), width, percent, bits)
    least = signs.filter(F.col("_sig").isNotNull()).groupBy(F.col("_sig").alias("sig")).agg(F.min("doc_id").alias("least"))
    comp = stored(spark, least.join(found, "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "comp")
    ids = comp.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = stored(spark, comp.join(ids, "comp").select(F.col("sig").alias("_sig"), "component_id", "comp"), "names")
    drop_scratch(comp)
    return signs, names


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    signs, names = named_components(docs, width, percent)
    out = signs.join(names, "_sig", "left")
    return out.select("doc_id", F.col("_n").alias("n_shingles"), F.when(F.col("_sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, of any type (null last; ties: smallest MD5 of the text).

    Documents without words stay. Of rows that agree in doc_id and text the one with the smallest text form of all columns stays.
    The keys of dropped documents are joined with the documents; texts move only where these keys are too many to broadcast.
    """
    spark = docs.sparkSession
    signs, names = named_components(docs, width, percent)
    rows = stored(spark, signs.join(names, "_sig").groupBy("comp", "doc_id", "key").agg(F.count("*").alias("rows")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key"))
    # most components have one row, which stays
    several = stored(spark, rows.groupBy("comp").agg(F.count("*").alias("n"), F.min(order).alias("stays")).filter("n > 1"), "several")
    marked = rows.join(small(several), "comp", "left").withColumn("first", F.col("n").isNull() | order.eqNullSafe(F.col("stays")))
    named = lambda keep: marked.filter(keep).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    gone, twice = stored(spark, named("not first"), "gone"), stored(spark, named("first and rows > 1"), "twice")
    drop_scratch(rows, names, several)
    own = docs.select(carried(docs), F.col("doc_id").alias("_own"), text_key())
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    left = own.join(small(gone), same, "left_anti")
    if twice.limit(1).count():
        once = left.join(small(twice), same, "left_semi").groupBy("_own", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        left = left.join(small(twice), same, "left_anti").select("row").unionByName(once.select("row"))
    return restored(left)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


#: All pairs that share a shingle, compared exactly; components by reachability.
OP7_SQL = """
with recursive d as (
  select row_number() over () rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w
  from documents),
s as (
  select distinct rid, g from (
    select rid, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d)),
n as (select rid, count(*) n from s group by rid),
p as (select a.rid x, b.rid y, count(*) c from s a join s b on a.g = b.g and a.rid < b.rid group by a.rid, b.rid),
l as (select x, y from p join n a on a.rid = x join n b on b.rid = y where 100 * c >= 90 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r(rid, near) as (select rid, rid from d union select r.rid, e.y from r join e on r.near = e.x),
m as (select r.rid, min(d.doc_id) component_id from r join d on d.rid = r.near group by r.rid)
select doc_id, coalesce(n, 0) n_shingles, component_id from d join m using (rid) left join n using (rid)
"""

QUERIES = {"op7_jaccard": op7_jaccard}
ORACLE = {"op7_jaccard": OP7_SQL}
