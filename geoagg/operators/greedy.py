"""Ordered greedy groups: the clustering operator.

Points are visited in order; a point that is still free takes all free points within the radius if they are ``min_points`` or
more with itself, else stays alone and leaves them free. Points whose cells are not connected never meet, so connected sets of
occupied cells are dealt to tasks whole, many small ones to one task. Cells are labelled in blocks, and the blocks' edges joined.

A set of cells with more than ``MAX_GROUP`` points is not handed to one task at once. By x it is swept in strips, one after the
other, in one task that reads the points by x: it keeps the strip, the points the last one could not decide and the groups' seeds
within the radius of the strip. By id the first points are swept as far as they decide, and all others within the radius of their
seeds are taken by many tasks at once; where that decides little, the rest is solved in rounds: in a round every free point that is
the first among the free ones within two radii is decided. All ways give what the sequential visit gives.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoagg.sources.scratch import dropped, stored

from .neighbors import SLACK, celled, within

#: Points of one connected set that one task sweeps: 16 bytes a point and a few index arrays.
MAX_GROUP = 1_000_000
#: Points of a strip, or of a step by id, of a larger set.
STRIP = 1_000_000
#: Points of one row of bytes that the task of a larger set gives back.
PACK = 50_000
#: Points of the many small sets that one task sweeps together; sets do not meet, so sweeping them at once changes nothing.
TASK_POINTS = 100_000
#: Points that one task sweeps without a look at their sets, which costs more than it saves.
FEW_POINTS = 20_000
#: Occupied cells that one task labels at once, and the side of a block of cells where there are more.
TASK_CELLS = 1_000_000
BLOCK_SIDE = 512
#: Candidates a point up to which all near pairs are listed before the visit.
FEW_NEAR = 8
#: Share of the points that a step by id has to decide; below it, rounds are the better way.
LEAST_DECIDED = 0.1


def sweep(ids: np.ndarray, x: np.ndarray, y: np.ndarray, order: np.ndarray, radius: float, min_points: int) -> np.ndarray:
    """The seed's id for each point of a set, visiting by ``order``; single precision."""
    return ids[visit(x, y, order, radius, min_points)[0]] if len(ids) else ids.copy()


def visit(x: np.ndarray, y: np.ndarray, order: np.ndarray, radius: float, min_points: int, sure: np.ndarray | None = None, taken: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, leads, decided) for each point: its seed's index, whether it took a group, whether the visit reached or took it.

    ``sure``: the points whose neighbours are all here. The visit stops at another one that finds fewer than ``min_points`` free
    ones; it may have more elsewhere. ``taken``: points that are no longer free at the start.
    """
    n = len(x)
    x, y, r = x.astype(np.float32), y.astype(np.float32), np.float32(radius)
    limit, reach = r * r, float(radius) * SLACK
    # rows of cells, by x within a row: what a point may take lies in three runs of rows
    row = np.floor(y.astype(np.float64) / reach).astype(np.int64)
    row -= row.min(initial=0)
    by_x = bool((np.diff(x[order]) >= 0).all())  # then nothing to the left is free at a visit
    if by_x:
        narrow = row.astype(np.uint16) if row.max(initial=0) < 1 << 16 else row
        at = order[np.argsort(narrow[order], kind="stable")]
    else:
        at = np.lexsort((x, row))
    x, y, row, rank = x[at], y[at], row[at], np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rank = rank[at]
    left = float(x.min(initial=0))
    stride = float(x.max(initial=0)) - left + 4 * reach
    place = row * stride + (x.astype(np.float64) - left)
    back = reach * 0.001 if by_x else reach
    edges = np.array([d + e for d in (-stride, 0.0, stride) for e in (-back, reach)])

    def runs_of(where):
        return [(np.searchsorted(place, where + edges[k], "left"), np.searchsorted(place, where + edges[k + 1], "right")) for k in (0, 2, 4)]

    some = place[:: max(n // 4096, 1)]
    listed = sum((e - s).sum() for s, e in runs_of(some)) <= FEW_NEAR * len(some)
    if listed:  # a few points' candidates do not show a dense spot elsewhere
        runs = runs_of(place)
        listed = sum(int((e - s).sum()) for s, e in runs) <= FEW_NEAR * n
    seed, leads, free, stop = np.arange(n), np.zeros(n, bool), np.ones(n, bool) if taken is None else ~taken[at], n
    unsure = np.zeros(n, bool) if sure is None else ~sure[at]
    if listed:
        pairs = []
        for s, e in runs:
            size = e - s
            i = np.repeat(np.arange(n), size)
            j = np.arange(len(i)) - np.repeat(np.cumsum(size) - size - s, size)
            dx, dy = x[j] - x[i], y[j] - y[i]
            near = (rank[j] > rank[i]) & (np.abs(dx) <= r) & (dx * dx + dy * dy <= limit)
            pairs.append((i[near], j[near]))
        i, j = (np.concatenate(side) for side in zip(*pairs, strict=True))
        j = j[np.argsort(i, kind="stable")]
        degree = np.bincount(i, minlength=n)
        ends = np.cumsum(degree)
        todo = np.flatnonzero(((degree > 0) | (min_points < 2)) & (degree + 1 >= min_points) | unsure)
        todo = todo[np.argsort(rank[todo])]
        open_, heads, others = bytearray(free.tobytes()), seed.tolist(), j.tolist()
        for i, b, e, u in zip(todo.tolist(), (ends - degree)[todo].tolist(), ends[todo].tolist(), unsure[todo].tolist(), strict=True):
            if not open_[i]:
                continue
            near = [k for k in others[b:e] if open_[k]]
            if len(near) + 1 >= min_points:
                leads[i] = True
                open_[i] = 0
                for k in near:
                    open_[k] = 0
                    heads[k] = i
            elif u:
                stop = rank[i]
                break
        seed, free = np.array(heads, np.int64), np.frombuffer(bytes(open_), bool)
    elif by_x:
        rows_at_once(x, y, row, place, stride, rank, seed, leads, free, unsure, radius, min_points)
        stop = 0  # what it has not reached is free
    else:
        index, doubtful = np.arange(n), bool(unsure.any())
        open_ = memoryview(free.view(np.uint8))
        for i in np.argsort(rank).tolist():
            if not open_[i]:
                continue
            a, b, c, d, e, f = place.searchsorted(edges + place[i]).tolist()
            near = np.concatenate((index[a:b], index[c:d], index[e:f]))
            near = near[free[near]]
            dx, dy = x[near] - x[i], y[near] - y[i]
            near = near[(np.abs(dx) <= r) & (dx * dx + dy * dy <= limit)]  # what was visited is not free any more
            if len(near) >= min_points:
                seed[near] = i
                free[near] = False
                leads[i] = True
            elif doubtful and unsure[i]:
                stop = rank[i]
                break
            else:
                open_[i] = 0
    decided = ~free | (rank < stop)
    out = tuple(np.empty_like(v) for v in (seed, leads, decided))
    for o, v in zip(out, (at[seed], leads, decided), strict=True):
        o[at] = v
    return out


def rows_at_once(x, y, row, place, stride: float, rank, seed, leads, free, unsure, radius: float, min_points: int) -> None:
    """The visit by x, many rows at once, for points by row and by rank in it; fills ``seed``, ``leads`` and ``free``.

    A row's head is its first free point. What can change a head's group lies within two radii, so within two rows: a head that
    comes before those of two rows on each side is decided, and no other such head takes from the same rows. A head that is unsure
    and finds too few waits, and the rows around it with it.
    """
    n, r = len(x), np.float32(radius)
    if not n:
        return
    limit, reach, never = r * r, float(radius) * SLACK, len(x)
    used, start = np.unique(row, return_index=True)
    # rows side by side, with two empty ones for a gap and at both ends
    spot = np.cumsum(np.minimum(np.diff(used, prepend=used[:1]).astype(np.int64), 3)) + 2
    rows = int(spot[-1]) + 3
    at, end, head, waits = np.full(rows, n), np.full(rows, n), np.full(rows, never), np.zeros(rows, bool)
    at[spot], end[spot] = start, np.append(start[1:], n)
    key, open_ = np.append(rank, never), np.append(free, True)  # one more at the end, where every search stops

    def advance(which):
        left, width = which, 8
        while len(left):
            block = open_[np.minimum(at[left][:, None] + np.arange(width), n)]
            found = block.any(1)
            at[left] = np.minimum(at[left] + np.where(found, block.argmax(1), width), end[left])
            left = left[~found & (at[left] < end[left])]
            width = min(2 * width, 4096)
        head[which] = np.where(at[which] < end[which], key[at[which]], never)

    advance(spot)
    steps = np.array([-1, 0, 1])
    while True:
        near = np.minimum(np.minimum(head[:-4], head[1:-3]), np.minimum(head[3:-1], head[4:]))
        todo = np.flatnonzero((head[2:-2] < near) & ~waits[2:-2]) + 2
        if not len(todo):
            break
        p = at[todo]
        around = todo[:, None] + steps
        first = at[around].ravel()
        size = np.maximum(place.searchsorted((place[p][:, None] + (steps * stride + reach)).ravel(), "right") - first, 0)
        own = np.repeat(np.arange(len(p)), size.reshape(-1, 3).sum(1))
        i = np.arange(len(own)) - np.repeat(np.cumsum(size) - size - first, size)
        still = open_[i]
        i, own = i[still], own[still]
        dx, dy = x[i] - x[p][own], y[i] - y[p][own]
        met = (np.abs(dx) <= r) & (dx * dx + dy * dy <= limit)
        i, own = i[met], own[met]
        takes = np.bincount(own, minlength=len(p)) >= min_points
        late = ~takes & unsure[p]
        waits[todo[late]] = True
        taken = takes[own]
        seed[i[taken]] = p[own[taken]]
        leads[p[takes]] = True
        open_[i[taken]] = False
        open_[p[~late]] = False
        moved = around[~late].ravel()
        advance(moved[at[moved] < end[moved]])
    free[:] = open_[:n]


def first_seed(x: np.ndarray, y: np.ndarray, seeds: dict[str, np.ndarray], radius: float) -> np.ndarray:
    """For each point the index of the first of some seeds (x, y; in the order of their visits) within the radius, or -1."""
    r, size = np.float32(radius), float(radius) * SLACK
    best = np.full(len(x), len(seeds["x"]), np.int64)
    if not len(best) or not len(seeds["x"]):
        return np.full(len(x), -1, np.int64)
    cell = lambda v: np.floor(v.astype(np.float64) / size).astype(np.int64)
    cx, cy, sx, sy = cell(x), cell(y), cell(seeds["x"]), cell(seeds["y"])
    low, width = min(cy.min(), sy.min()) - 1, max(cy.max(), sy.max()) - min(cy.min(), sy.min()) + 3
    key, listed = cx * width + (cy - low), sx * width + (sy - low)
    by = np.argsort(listed, kind="stable")
    listed = listed[by]
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            want = key + dx * width + dy
            start, end = np.searchsorted(listed, want, "left"), np.searchsorted(listed, want, "right")
            left = np.flatnonzero(start < end)
            t = 0
            while len(left):
                s = by[start[left] + t]
                ux, uy = x[left] - seeds["x"][s], y[left] - seeds["y"][s]
                met = (np.abs(ux) <= r) & (ux * ux + uy * uy <= r * r)
                best[left[met]] = np.minimum(best[left[met]], s[met])
                t += 1
                left = left[start[left] + t < end[left]]
    return np.where(best < len(seeds["x"]), best, -1)


def label(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """For each of some distinct cells the index of a cell that stands for its connected set (eight neighbours)."""
    order = np.lexsort((cy, cx))
    x, y = cx[order], cy[order]
    width = np.int64(y.max() - y.min() + 3) if len(y) else np.int64(1)
    key = (x - x.min(initial=0)) * width + (y - y.min(initial=0)) if len(y) else x  # ascending; a neighbour's key differs by a fixed step
    pairs = []
    for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
        want = key + dx * width + dy
        at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        found = np.flatnonzero(key[at] == want)
        pairs.append((found, at[found]))
    a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
    part = np.arange(len(key))
    while True:
        low = np.minimum(part[a], part[b])
        new = part.copy()
        np.minimum.at(new, part[a], low)  # the sets' heads take the smaller one,
        np.minimum.at(new, part[b], low)
        new = new[new]
        while True:  # and all cells the head of their head
            again = new[new]
            if (again == new).all():
                break
            new = again
        if (new == part).all():
            break
        part = new
    out = np.empty(len(key), np.int64)
    out[order] = order[part]
    return out


def connected_cells(points: DataFrame, task_cells: int = TASK_CELLS, side: int = BLOCK_SIDE) -> DataFrame:
    """(cx, cy, part): a cell that stands for each connected set of occupied cells (eight neighbours).

    Blocks of cells are labelled in one task each, then the sets that meet at the blocks' edges are joined in rounds.
    """
    cells = stored(points.select("cx", "cy").distinct(), "cells")
    whole = cells.count() <= task_cells
    block = lambda c: F.lit(0).cast("long") if whole else F.floor(F.col(c) / side)

    def labelled(pdf):
        import pandas as pd

        cx, cy = pdf["cx"].to_numpy(), pdf["cy"].to_numpy()
        head = label(cx, cy)
        return pd.DataFrame({"cx": cx, "cy": cy, "px": cx[head], "py": cy[head]})

    parts = cells.groupBy(block("cx").alias("bx"), block("cy").alias("by")).applyInPandas(labelled, "cx long, cy long, px long, py long")
    parts = stored(parts.select("cx", "cy", F.struct(F.col("px").alias("cx"), F.col("py").alias("cy")).alias("part")), "parts")
    dropped(cells)
    if whole:
        return parts
    at_edge = lambda c: F.pmod(F.col(c), F.lit(side)).isin(0, side - 1)
    edge = parts.filter(at_edge("cx") | at_edge("cy"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    around = edge.withColumn("s", F.explode(steps)).select((F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), F.col("part").alias("u"))
    links = stored(around.join(edge.withColumnRenamed("part", "v"), ["cx", "cy"]).filter(F.col("u") != F.col("v")).select("u", "v").distinct(), "links")
    joined = _joined(links)
    return parts.join(joined.select(F.col("part").alias("from"), "to"), F.col("part") == F.col("from"), "left").select("cx", "cy", F.coalesce("to", "part").alias("part"))


def _joined(links: DataFrame) -> DataFrame:
    """(part, to): the smallest label that the links (u, v), given both ways, reach: repeated minimum with a jump a round."""
    step = stored(links.groupBy(F.col("u").alias("part")).agg(F.min(F.least("u", "v")).alias("to")), "step")
    while True:
        near = links.join(step.select(F.col("part").alias("v"), F.col("to").alias("near")), "v").groupBy(F.col("u").alias("part")).agg(F.min("near").alias("near"))
        moved = step.join(near, "part").select("part", "to", F.least("to", "near").alias("low"))
        jump = step.select(F.col("part").alias("low"), F.col("to").alias("far"))
        new = stored(moved.join(jump, "low", "left").select("part", "to", F.least("low", F.coalesce("far", "low")).alias("next")), "step")
        changed = new.filter(F.col("to") != F.col("next")).limit(1).count()
        dropped(step)
        if not changed:
            return new.select("part", "to")
        step = stored(new.select("part", F.col("next").alias("to")), "step")
        dropped(new)


def greedy_groups(projected: DataFrame, radius: float, min_points: int, order: str = "x", max_group: int = MAX_GROUP) -> DataFrame:
    """(id, cluster_id): each point's seed. ``projected``: id, x, y, one row an id. ``order``: "x" (ties by id) or "id"."""
    points = stored(celled(projected.select("id", "x", "y"), radius), "points")

    def sets(pdf):
        import pandas as pd

        ids, x = pdf["id"].to_numpy(), pdf["x"].to_numpy(np.float32)
        by = np.lexsort((ids, x)) if order == "x" else np.argsort(ids, kind="stable")
        return pd.DataFrame({"id": ids, "cluster_id": sweep(ids, x, pdf["y"].to_numpy(np.float32), by, radius, min_points)})

    result = "id long, cluster_id long"
    if points.count() <= min(FEW_POINTS, max_group):
        return points.groupBy(F.lit(0).alias("task")).applyInPandas(sets, result)
    cells = stored(points.groupBy("cx", "cy").agg(F.count("*").alias("n")), "counted")  # the points are read once for this
    parts = connected_cells(cells)
    sizes = stored(parts.join(cells, ["cx", "cy"]).groupBy("part").agg(F.sum("n").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = max(projected.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_POINTS))
    giant = sizes.filter(F.col("n") > max_group).select("part.*", "n").collect()  # at most rows / max_group
    labelled = points.join(parts, ["cx", "cy"])
    is_giant = F.lit(False)
    for g in giant:
        is_giant = is_giant | ((F.col("part.cx") == g["cx"]) & (F.col("part.cy") == g["cy"]))
    small = None
    if sum(g["n"] for g in giant) < total or not giant:
        dealt = labelled.filter(~is_giant).groupBy(F.pmod(F.xxhash64("part"), F.lit(tasks)).alias("task"))
        small = stored(dealt.applyInPandas(sets, result), "small")  # read more than once by what follows
    if not giant:
        return small
    if small is None:
        return (greedy_strips if order == "x" else greedy_steps)(points, radius, min_points)
    large = labelled.filter(is_giant).select("id", "x", "y")
    if order == "x":
        return small.unionByName(greedy_strips(large, radius, min_points))
    return small.unionByName(greedy_steps(stored(large, "large"), radius, min_points))


_SWEPT = "id long, cluster_id long, x float, y float, leads boolean"


def _swept(points: DataFrame, radius: float, min_points: int, order: str, seeds: dict[str, np.ndarray], end: float) -> DataFrame:
    """One task's visit of ``points`` behind ``seeds``: cluster_id is null where it is not decided. All points left of ``end`` are here."""

    def task(pdf):
        import pandas as pd

        ids, x, y = pdf["id"].to_numpy(), pdf["x"].to_numpy(np.float32), pdf["y"].to_numpy(np.float32)
        by = np.lexsort((ids, x)) if order == "x" else np.argsort(ids, kind="stable")
        before = first_seed(x, y, seeds, radius)
        seed, leads, decided = visit(x, y, by, radius, min_points, x.astype(np.float64) + radius * SLACK < end, before >= 0)
        own = ids[seed]
        own[before >= 0] = seeds["id"][before[before >= 0]]
        return pd.DataFrame({"id": ids, "cluster_id": pd.array(own, "Int64"), "x": x, "y": y, "leads": leads}).assign(cluster_id=lambda f: f["cluster_id"].mask(~decided))

    return points.select("id", "x", "y").groupBy(F.lit(0).alias("task")).applyInPandas(task, _SWEPT)


def _seeds(rows: list) -> dict[str, np.ndarray]:
    return {c: np.array([row[c] for row in rows], t) for c, t in (("id", np.int64), ("x", np.float32), ("y", np.float32))}


def _decided(tables: list[DataFrame]) -> DataFrame:
    """(id, cluster_id) of all tables, which share their columns: one scan."""
    paths = [f for t in tables for f in t.inputFiles()]
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths).filter(F.col("cluster_id").isNotNull()).select("id", "cluster_id")


def _packed(points: DataFrame) -> DataFrame:
    """(x0, id0, id, x, y): points sorted by (x, id) by many tasks, a batch's columns as bytes in one row; rows follow by (x0, id0)."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                ids, x, y = (b.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("id", np.int64), ("x", np.float32), ("y", np.float32)))
                yield pa.RecordBatch.from_pydict({"x0": pa.array(x[:1]), "id0": pa.array(ids[:1]), **{c: pa.array([v.tobytes()]) for c, v in (("id", ids), ("x", x), ("y", y))}})

    by_x = points.select("id", "x", "y").repartitionByRange("x").sortWithinPartitions("x", "id")
    return by_x.mapInArrow(pack, "x0 float, id0 long, id binary, x binary, y binary")


def _unpacked(table: DataFrame) -> DataFrame:
    """(id, cluster_id) of rows that hold both as bytes."""

    def unpack(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_pydict({c: pa.array(np.frombuffer(row[c], np.int64)) for c in ("id", "cluster_id")})

    return table.repartition(table.sparkSession.sparkContext.defaultParallelism).mapInArrow(unpack, "id long, cluster_id long")


def greedy_strips(points: DataFrame, radius: float, min_points: int, strip: int | None = None) -> DataFrame:
    """``greedy_groups`` by x in one task, which reads the points by x and sweeps about ``strip`` of them at once. It keeps those that
    lie within the radius of the strip's end and are still free there, and the groups' seeds in that margin. The points are sorted
    by many tasks and come and go as rows of bytes, so that the one task has the sweep only."""
    size = strip or STRIP

    def swept(batches):
        import pyarrow as pa

        waiting, seeds, new, first = [], _seeds([]), 0, -np.inf  # first: the least x of the points that no strip has had

        def flush(end):
            nonlocal waiting, seeds, new
            ids, x, y = (np.concatenate([part[k] for part in waiting]) for k in range(3))  # by x and id
            here = np.searchsorted(x, np.float32(end), "left") if end < np.inf else len(x)  # more points at the end may follow
            late = ids[here:], x[here:], y[here:]
            ids, x, y = ids[:here], x[:here], y[:here]
            before = np.full(here, -1)
            if len(seeds["x"]):
                reached = np.searchsorted(x, np.float32(seeds["x"].max() + radius * SLACK), "right")
                before[:reached] = first_seed(x[:reached], y[:reached], seeds, radius)
            seed, leads, decided = visit(x, y, np.arange(here), radius, min_points, x.astype(np.float64) + radius * SLACK < end, before >= 0)
            own = ids[seed]
            own[before >= 0] = seeds["id"][before[before >= 0]]
            waiting, new = [tuple(v[~decided] for v in (ids, x, y)), late], len(late[0])
            old = seeds["x"] >= end - radius * SLACK
            leads &= x >= end - radius * SLACK
            seeds = {c: np.concatenate((seeds[c][old], v[leads])) for c, v in zip(seeds, (ids, x, y), strict=True)}
            ids, own = ids[decided], own[decided]
            for i in range(0, len(ids), PACK):
                yield pa.RecordBatch.from_pydict({c: pa.array([v[i : i + PACK].tobytes()]) for c, v in (("id", ids), ("cluster_id", own))})

        for b in batches:
            for row in b.to_pylist():
                waiting.append((np.frombuffer(row["id"], np.int64), np.frombuffer(row["x"], np.float32), np.frombuffer(row["y"], np.float32)))
                new += len(waiting[-1][0])
                if new >= size and waiting[-1][1][-1] > first:
                    yield from flush(float(waiting[-1][1][-1]))
                    first = float(waiting[-1][1][0])
        if waiting:
            yield from flush(np.inf)

    packed = _packed(points).repartition(1).sortWithinPartitions("x0", "id0").select("id", "x", "y")
    return _unpacked(stored(packed.mapInArrow(swept, "id binary, cluster_id binary"), "swept"))


def greedy_steps(points: DataFrame, radius: float, min_points: int, step: int | None = None) -> DataFrame:
    """``greedy_groups`` by id: the first ``step`` points are visited as far as they decide, then their seeds take from all others."""
    step = step or STRIP
    tables, rounds, n = [], None, points.count()
    while n > step:
        last = points.approxQuantile("id", [step / n], 0.1 * step / n)[0]
        first = stored(_swept(points.filter(F.col("id") <= int(last)), radius, min_points, "id", _seeds([]), -np.inf), "swept")
        seeds = _seeds(first.filter("leads").select("id", "x", "y").orderBy("id").collect())

        def taken(frames, seeds=seeds):
            import pandas as pd

            for pdf in frames:
                at = first_seed(pdf["x"].to_numpy(np.float32), pdf["y"].to_numpy(np.float32), seeds, radius)
                own = pd.array(np.append(seeds["id"], 0)[at], "Int64")
                own[at < 0] = pd.NA
                yield pd.DataFrame({"id": pdf["id"], "cluster_id": own, "x": pdf["x"], "y": pdf["y"], "leads": False})

        others = stored(points.filter(F.col("id") > int(last)).select("id", "x", "y").mapInPandas(taken, _SWEPT), "others")
        tables += [first, others]
        points = first.unionByName(others).filter(F.col("cluster_id").isNull()).select("id", "x", "y")
        left = points.count()
        if left > step and left > (1 - LEAST_DECIDED) * n:
            rounds = greedy_rounds(points, radius, min_points, "id")
            break
        n = left
    else:
        tables.append(stored(_swept(points, radius, min_points, "id", _seeds([]), np.inf), "swept"))
    return _decided(tables) if rounds is None else _decided(tables).unionByName(rounds)


def greedy_rounds(points: DataFrame, radius: float, min_points: int, order: str = "x") -> DataFrame:
    """``greedy_groups`` by rounds of joins, for sets too large for one task."""
    key = F.struct("x", "id") if order == "x" else F.struct(F.col("id").alias("x"), F.col("id"))
    free = stored(celled(points, 2 * radius).withColumn("key", key), "free")
    done = None
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    while free.limit(1).count():
        # a cell of two radii hides nothing further off: only the first point of each cell can be first within two radii
        heads = free.groupBy("cx", "cy").agg(F.min_by(F.struct("id", "x", "y", "key"), "key").alias("p")).select("cx", "cy", "p.*")
        copies = heads.withColumn("s", F.explode(steps)).select((F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), F.col("id").alias("seed"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("key").alias("skey"))
        met = free.join(F.broadcast(copies) if copies.limit(200_001).count() <= 200_000 else copies, ["cx", "cy"])
        met = stored(met.select("id", "x", "y", "key", "seed", "skey", within(F.col("sx"), F.col("sy"), F.col("x"), F.col("y"), radius).alias("near"), within(F.col("sx"), F.col("sy"), F.col("x"), F.col("y"), 2.01 * radius).alias("wide")), "met")
        blocked = F.max(F.col("wide") & (F.col("key") < F.col("skey")))
        first = met.groupBy("seed").agg(blocked.alias("blocked"), F.count_if("near").alias("n")).filter(~F.col("blocked"))
        taken = met.filter("near").join(first, "seed").filter((F.col("n") >= min_points) | (F.col("id") == F.col("seed"))).select("id", F.col("seed").alias("cluster_id"))
        taken = stored(taken, "taken")
        done = taken if done is None else done.unionByName(taken)
        free = stored(free.join(taken.select("id"), "id", "left_anti"), "free")
    return done if done is not None else points.select("id", F.col("id").alias("cluster_id")).limit(0)
