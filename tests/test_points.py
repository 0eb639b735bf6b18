"""Hand fixtures and invariants of the point engine."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoagg.functions import texts
from geoagg.functions import projection as P
from geoagg.operators import geojson, greedy, grid, index, neighbors, rollup, summary, viewport
from geoagg.operators.greedy import connected_cells, greedy_groups, label, sweep
from geoagg.options import WORLD, Bounds, ClusterOptions
from geoagg.plans.session import Session
from geoagg.sources import ingest, store
from geoagg.streaming.append import append_points, windowed_cells

TWO = ClusterOptions(min_points=2)


def points(spark, rows, extra="value double"):
    return spark.createDataFrame(rows, f"id long, lng float, lat float, {extra}")


def test_options_are_held_in_range():
    o = ClusterOptions(min_zoom=18, max_zoom=20, radius=-1, min_points=0).normalized()
    assert (o.min_zoom, o.max_zoom, o.radius, o.min_points) == (18, 16, 40.0, 3)
    assert ClusterOptions().effective_zoom(17) == 0 and ClusterOptions().effective_zoom(-1) == 0


@pytest.mark.parametrize("lng,lat,zoom", [(0, 0, 0), (180, 85, 10), (-180, -85, 5), (45, 45, 8)])
def test_projection_round_trip(spark, lng, lat, zoom):
    df = viewport.with_projection(points(spark, [(1, float(lng), float(lat), 0.0)]), zoom)
    r = df.select(P.unproject_lng(F.col("x"), zoom).alias("lng"), P.unproject_lat(F.col("y"), zoom).alias("lat")).first()
    assert abs(r.lng - lng) < 1e-4 and abs(r.lat - lat) < 1e-4


def test_three_points_roll_up(spark):
    df = points(spark, [(1, 0.0, 0.0, 100.0), (2, 0.1, 0.1, 200.0), (3, 0.2, 0.2, 300.0)])
    rows = rollup.cluster_rows(rollup.members(df, WORLD, 2, TWO), 2, ["value"], TWO).collect()
    assert [(r["count"], r["value"], r["children"]) for r in rows] == [(3, 600.0, [1, 2, 3])]


def test_four_points_part_with_zoom(spark):
    df = points(spark, [(1, -100.0, 40.0, 100.0), (2, -100.1, 40.1, 200.0), (3, -100.2, 40.2, 300.0), (4, -105.0, 35.0, 400.0)])
    n = lambda z: rollup.cluster_rows(rollup.members(df, Bounds(-180, 20, -60, 50), z, TWO), z, [], TWO).count()
    assert (n(5), n(15)) == (2, 4)


def test_no_points(spark):
    df = points(spark, [])
    assert rollup.cluster_rows(rollup.members(df, WORLD, 5, TWO), 5, ["value"], TWO).count() == 0
    assert summary.counts(rollup.cluster_rows(rollup.members(df, WORLD, 5, TWO), 5, [], TWO)).first()["total_points"] == 0


def test_repeated_ids_count_once_and_distance_is_inclusive(spark):
    df = points(spark, [(1, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 1.0), (2, 50.0, 0.0, 1.0)])
    assert rollup.members(df, WORLD, 0, TWO).count() == 2
    flat = spark.createDataFrame([(1, 0.0, 0.0), (2, 40.0, 0.0), (3, 80.01, 0.0)], "id long, x float, y float")
    got = {r.id: r.cluster_id for r in greedy_groups(flat, 40.0, 2).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_frequencies_ignore_points_without_the_key(spark):
    df = points(spark, [(1, 0.0, 0.0, None, None), (2, 0.0, 0.0, "store", "Boston"), (3, 0.0, 0.0, "store", "New York")], "type string, city string")
    rows = rollup.metadata_rows(rollup.members(df, WORLD, 3, TWO), {"type": "s", "city": "s"}).collect()
    assert {(r.key, r.value): r.freq for r in rows} == {("type", "store"): 1.0, ("city", "Boston"): 0.5, ("city", "New York"): 0.5}


def test_metadata_is_dealt_once(spark):
    """One exchange by cluster, before the rows are multiplied by their keys."""
    grouped = spark.range(100).selectExpr("id", "id % 7 as cluster_id", "10L as group_size", "true as grouped", "string(id % 3) as a", "double(id) as b")
    rows = rollup.metadata_rows(grouped, {"a": "s", "b": "n"})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("Initial Plan") :].count("Exchange") == 1 if "Initial Plan" in plan else plan.count("Exchange") == 1
    got = rows.filter("key = 'a'").groupBy("cluster_id").agg(F.sum("freq")).collect()
    assert len(got) == 7 and all(abs(r[1] - 1) < 1e-9 for r in got)


def brute(pts, radius, least):
    order, free, seed = sorted(pts, key=lambda p: (p[1], p[0])), {p[0] for p in pts}, {}
    r = np.float32(radius)
    for i, x, y in order:
        if i not in free:
            continue
        near = [j for j, u, v in pts if j in free and abs(np.float32(u) - np.float32(x)) <= r and (np.float32(u) - np.float32(x)) ** 2 + (np.float32(v) - np.float32(y)) ** 2 <= r * r]
        near = near if len(near) >= least else [i]
        seed.update(dict.fromkeys(near, i))
        free -= set(near)
    return seed


def brute_by_id(pts, radius, least):
    free, seed, r = {p[0] for p in pts}, {}, np.float32(radius)
    for i, x, y in sorted(pts):
        if i in free:
            near = [j for j, u, v in pts if j in free and abs(np.float32(u) - np.float32(x)) <= r and (np.float32(u) - np.float32(x)) ** 2 + (np.float32(v) - np.float32(y)) ** 2 <= r * r]
            near = near if len(near) >= least else [i]
            seed.update(dict.fromkeys(near, i))
            free -= set(near)
    return seed


@pytest.mark.parametrize("least", [1, 2, 4])
def test_all_ways_to_group_equal_the_sequential_visit(spark, monkeypatch, least):
    rng = np.random.default_rng(5)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 300, (250, 2)))]
    want = brute(pts, 25.0, least)
    df = spark.createDataFrame(pts, "id long, x float, y float")
    for few, most in ((20_000, 10**6), (0, 10**6), (0, 3)):
        monkeypatch.setattr(greedy, "FEW_POINTS", few)
        assert {r.id: r.cluster_id for r in greedy_groups(df, 25.0, least, max_group=most).collect()} == want


@pytest.mark.parametrize("most", [0, 8, 10**6])
def test_strips_equal_the_sequential_visit(monkeypatch, most):
    """Strips by x of any width, with near pairs listed or not: every point is decided once."""
    monkeypatch.setattr(greedy, "FEW_NEAR", most)
    rng = np.random.default_rng(7)
    for least, radius in ((1, 25.0), (2, 12.5), (4, 60.0)):
        x, y = rng.integers(0, 300, (2, 250)).astype(np.float32)
        ids = rng.permutation(250)
        want = brute([(int(i), float(a), float(b)) for i, a, b in zip(ids, x, y, strict=True)], radius, least)
        for width in (7, 40):
            got, left, rows = {}, np.zeros(250, bool), []
            edges = [-np.inf, *range(width, 300, width), np.inf]
            for low, high in zip(edges, edges[1:], strict=False):
                at = np.flatnonzero((x >= low) & (x < high) | left)
                seeds = greedy._seeds(rows)
                before = greedy.first_seed(x[at], y[at], seeds, radius)
                seed, leads, decided = greedy.visit(x[at], y[at], np.lexsort((ids[at], x[at])), radius, least, x[at] + radius * 1.001 < high, before >= 0)
                own = ids[at][seed]
                own[before >= 0] = seeds["id"][before[before >= 0]]
                assert not set(ids[at][decided].tolist()) & set(got)
                got |= dict(zip(ids[at][decided].tolist(), own[decided].tolist(), strict=True))
                left[:] = False
                left[at[~decided]] = True
                rows += sorted(({"id": ids[i], "x": x[i], "y": y[i]} for i in at[leads]), key=lambda r: (r["x"], r["id"]))
            assert got == want


@pytest.mark.parametrize("order", ["x", "id"])
def test_large_sets_take_few_steps(spark, monkeypatch, order):
    """A set above the bound is swept in strips or steps, not in a round for each link of its longest chain."""
    rng = np.random.default_rng(6)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 200, (600, 2)))]
    want = (brute if order == "x" else brute_by_id)(pts, 40.0, 2)
    for name, value in (("FEW_POINTS", 0), ("STRIP", 150)):
        monkeypatch.setattr(greedy, name, value)
    monkeypatch.setattr(greedy, "greedy_rounds", None)
    df = spark.createDataFrame(pts, "id long, x float, y float")
    assert {r.id: r.cluster_id for r in greedy_groups(df, 40.0, 2, order, max_group=100).collect()} == want


def test_strips_are_read_in_one_pass(spark, monkeypatch):
    """One table is written for a set, however many strips it has; strips may end between points with equal x."""
    rng = np.random.default_rng(8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    written = []
    monkeypatch.setattr(greedy, "stored", lambda df, name, f=greedy.stored: written.append(name) or f(df, name))
    try:
        for size, least, radius in ((300, 2, 40.0), (60, 4, 12.0), (1, 3, 9.0)):
            pts = [(int(i), float(x), float(y)) for i, x, y in zip(rng.permutation(600), rng.integers(0, size, 600), rng.integers(0, 200, 600), strict=True)]
            df = spark.createDataFrame(pts, "id long, x float, y float")
            got = greedy.greedy_strips(df, radius, least, 50).collect()
            assert len(got) == 600 and {r.id: r.cluster_id for r in got} == brute(pts, radius, least)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert written == ["swept"] * 3


@pytest.mark.parametrize("least", [1, 2, 4])
def test_rows_at_once_equal_the_sequential_visit(monkeypatch, least):
    """Heads of rows that no other head can reach are visited together: few rounds, the groups of the visit one by one."""
    monkeypatch.setattr(greedy, "FEW_NEAR", -1)
    calls = []
    monkeypatch.setattr(greedy, "rows_at_once", lambda *a, f=greedy.rows_at_once: calls.append(len(a[0])) or f(*a))
    rng = np.random.default_rng(9)
    for high, radius in ((300, 25.0), (300, 4.0), (30, 9.0), (5000, 60.0)):
        x, y = rng.integers(0, 300, 400).astype(np.float32), rng.integers(0, high, 400).astype(np.float32)
        ids = rng.permutation(400)
        got = sweep(ids, x, y, np.lexsort((ids, x)), radius, least)
        assert dict(zip(ids.tolist(), got.tolist(), strict=True)) == brute([(int(i), float(a), float(b)) for i, a, b in zip(ids, x, y, strict=True)], radius, least)
    assert calls == [400] * 4


def test_points_of_strips_are_packed_by_many_tasks(spark):
    """The one task of the strips gets rows of bytes that other tasks have sorted by x and id."""
    rng = np.random.default_rng(10)
    pts = [(int(i), float(x), float(y)) for i, x, y in zip(rng.permutation(900), rng.integers(0, 40, 900), rng.integers(0, 200, 900), strict=True)]
    rows = greedy._packed(spark.createDataFrame(pts, "id long, x float, y float")).orderBy("x0", "id0").collect()
    back = [t for r in rows for t in zip(*[np.frombuffer(r[c], d).tolist() for c, d in (("id", np.int64), ("x", np.float32), ("y", np.float32))], strict=True)]
    assert back == sorted(pts, key=lambda p: (p[1], p[0]))


def test_sparse_steps_end_in_rounds(spark):
    pts = [(i, float(x), 0.0) for i, x in enumerate(np.random.default_rng(3).permutation(60) * 30)]
    df = spark.createDataFrame(pts, "id long, x float, y float")
    assert {r.id: r.cluster_id for r in greedy.greedy_steps(df, 40.0, 2, 20).collect()} == brute_by_id(pts, 40.0, 2)


def flood(cells):
    """The connected sets of some cells."""
    left, out = set(cells), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            own.add((x, y))
            near = {(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(frozenset(own))
    return set(out)


def test_cells_are_labelled_by_connected_set(spark):
    rng = np.random.default_rng(2)
    cells = sorted({(int(x), int(y)) for x, y in rng.integers(-30, 30, (900, 2))} | {(x, 40) for x in range(-40, 40)})
    xy = np.array(cells)
    heads = label(xy[:, 0], xy[:, 1])
    sets = lambda pairs: {frozenset(c for c, h in pairs if h == k) for k in {h for _, h in pairs}}
    assert sets(list(zip(cells, heads.tolist(), strict=True))) == flood(cells)
    df = spark.createDataFrame(cells + cells[:50], "cx long, cy long")
    for most, side in ((10**6, 512), (10, 8), (10, 3)):
        rows = connected_cells(df, most, side).collect()
        assert len(rows) == len(cells) and sets([((r.cx, r.cy), tuple(r.part)) for r in rows]) == flood(cells)


def test_sweep_of_nothing():
    e = np.empty(0)
    assert len(sweep(e.astype(np.int64), e, e, e.astype(np.int64), 1.0, 2)) == 0


def test_neighbours_have_no_missing_pair(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(-50, 50, (120, 2)).astype(np.float32)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x float, y float")
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if abs(xy[i, 0] - xy[j, 0]) <= 9 and ((xy[i] - xy[j]) ** 2).sum() <= 81}
    assert {(r.id, r.other) for r in neighbors.neighbor_pairs(df, 9.0).collect()} == want


def test_bounds_and_filter_reach_the_scan(spark, tmp_path):
    df = points(spark, [(1, -10.0, 5.0, 0.0), (2, 10.0, -5.0, 0.0), (3, 0.0, 0.0, 0.0)])
    assert tuple(index.dataset_bounds(df).first()) == (-10.0, -5.0, 10.0, 5.0)
    df.write.parquet(str(tmp_path / "p"))
    plan = viewport.viewport(spark.read.parquet(str(tmp_path / "p")), Bounds(-1, -1, 1, 1), 5)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(lng), IsNotNull(lat), GreaterThan(lng" in plan


def test_summary_rules(spark):
    rows = [
        (1, 100, "level", "map", "n", "5", 0.29), (1, 100, "level", "map", "n", "7", 0.71), (2, 1, "zip", "single", "s", "123", 1.0), (3, 1, "timestamp", "single", "s", "2024-01-02T00:00:00Z", 1.0),
        (1, 100, "timestamp", "map", "s", "2024-01-01T00:00:00Z", 1.0), (1, 100, "timestamp", "map", "s", "soon", 0.5), (2, 1, "when", "single", "s", "2024-01-01", 1.0), (2, 1, "flag", "single", "b", "true", 1.0),
    ]
    meta = spark.createDataFrame(rows, "cluster_id long, count long, key string, kind string, type string, value string, freq double")
    assert {r.key: (r.min, r.max, round(r.average, 6)) for r in summary.numeric_range(meta).collect()} == {"level": (5.0, 7.0, round((5 * 28 + 7 * 71) / 99, 6))}
    assert [r.key for r in summary.time_range(meta).collect()] == ["timestamp"]
    assert {(r.key, r.value): r.percent for r in summary.distribution(meta).collect()} == {("zip", "123"): 100.0, ("when", "2024-01-01"): 100.0, ("flag", "true"): 100.0}


def test_summaries_read_their_rows_once(spark, tmp_path):
    spark.createDataFrame([(1, 2, "a", "map", "s", "x", 1.0)], "cluster_id long, count long, key string, kind string, type string, value string, freq double").write.parquet(str(tmp_path / "m"))
    meta = spark.read.parquet(str(tmp_path / "m"))
    for summed in (summary.distribution(meta), summary.time_range(meta)):
        assert summed._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


@pytest.mark.parametrize("value,text", [(123456.0, "123456"), (1234567.0, "1.234567e+06"), (0.00001, "1e-05"), (12.5, "12.5"), (0.0, "0"), (0.00025, "0.00025"), (-3.0, "-3")])
def test_shortest_numbers(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(texts.shortest(F.col("v"))).first()[0] == text


@pytest.mark.parametrize("text,number", [("12", 12.0), ("1e3", 1000.0), ("12d", None), ("nan", None), ("1_0", None), (" 12 ", None), (".5", 0.5)])
def test_number_texts(spark, text, number):
    assert spark.createDataFrame([(text,)], "v string").select(texts.parse_number(F.col("v"))).first()[0] == number


def test_ingest_drops_what_is_no_metadata(spark):
    df = spark.sql("select 1L id, 'a' s, 2 i, 1.5D d, true b, timestamp'2024-01-01' t, array(1) l, cast(null as string) z")
    assert ingest.metadata_types(df, ["s", "i", "d", "b", "t", "l"]) == {"s": "s", "i": "n", "d": "n", "b": "b"}
    assert {r.key for r in ingest.typed_metadata(df, ["s", "i", "d", "b", "t", "l", "z"]).collect()} == {"s", "i", "d", "b"}
    maps = spark.sql("select 1L id, map('a', 1.0F) metrics union all select 2L, map('b', 2.0F)")
    assert {tuple(r) for r in ingest.metric_columns(maps, zero_fill=True).collect()} == {(1, 1.0, 0.0), (2, 0.0, 2.0)}


def test_metrics_are_overwritten_key_by_key(spark):
    rows = [(1, 1, {"a": 1.0, "b": 2.0}), (1, 2, {"a": 5.0}), (1, 3, {}), (2, 1, None), (3, 2, {"c": 1.0}), (3, 1, {"c": 9.0})]
    df = spark.createDataFrame(rows, "id long, at int, metrics map<string,float>")
    assert {r.id: r.metrics for r in ingest.upserted(df, "at").collect()} == {1: {"a": 5.0, "b": 2.0}, 2: {}, 3: {"c": 1.0}}


def test_bounds_from_texts():
    assert Bounds.from_texts("50", "20.5", "-60", "-180") == Bounds(-180.0, 20.5, -60.0, 50.0)
    for bad in ("x", "", "nan", None):
        with pytest.raises(ValueError, match="east"):
            Bounds.from_texts("50", "20", bad, "0")


def test_tangent_form_agrees(spark):
    df = points(spark, [(1, 0.0, -60.0, 0.0), (2, 0.0, 45.0, 0.0)])
    for r in df.select(P.project_y(F.col("lat"), 4).alias("y"), P.tangent_y(F.col("lat"), 4).alias("t")).collect():
        assert abs(r.y / 2 - r.t) < 0.01


def test_geojson_shapes(spark):
    df = points(spark, [(1, 0.0, 0.0, 1.0, "x"), (2, 0.0, 0.0, 2.0, "x"), (3, 90.0, 0.0, 5.0, "y")], "value double, id_text string")
    grouped = rollup.members(df, WORLD, 3, TWO)
    rows = rollup.cluster_rows(grouped, 3, ["value"], TWO)
    flat = {r.id: json.loads(r.feature) for r in geojson.flat_features(rows, ["value"], rollup.metadata_rows(grouped, {"id_text": "s"})).collect()}
    assert flat[1]["properties"] == {"cluster": True, "cluster_id": 1, "point_count": 2, "value": 3.0, "id_text": {"x": 1.0}}
    assert flat[3]["properties"] == {"cluster": False, "id": 3, "value": 5.0, "id_text": "y"}
    service = geojson.service_features(rows, ["value"])
    assert len(json.loads(geojson.collection(service).first()["collection"])["features"]) == 2


def test_later_names_win_and_entries_are_built_once(spark):
    rows = spark.createDataFrame([(1, 2, 0.0, 0.0, 7.0, 8.0)], "id long, count long, lng float, lat float, cluster double, value double")
    meta = spark.createDataFrame([(1, 2, "value", "map", "s", "x", 1.0)], "cluster_id long, count long, key string, kind string, type string, value string, freq double")
    features = geojson.flat_features(rows, ["cluster", "value"], meta)
    assert json.loads(features.first()["feature"])["properties"] == {"cluster": 7.0, "cluster_id": 1, "point_count": 2, "value": {"x": 1.0}}
    assert features._jdf.queryExecution().optimizedPlan().toString().count("map_from_arrays(") == 1


def test_save_and_load(spark, tmp_path):
    df = points(spark, [(i, i / 10.0, -i / 10.0, float(i)) for i in range(50)])
    store.save(df, str(tmp_path / "d"), TWO)
    back, options = store.load(spark, str(tmp_path / "d"))
    assert options == TWO and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_session_cap_and_time_to_live(spark, tmp_path):
    now = [0.0]
    s = Session(spark, str(tmp_path), cap=2, ttl=10, clock=lambda: now[0])
    keys = []
    for t in range(3):
        now[0] = float(t)
        keys.append(s.create(200))
    assert s.opened() == sorted(keys[1:])
    assert sorted((r.id, r.num_points) for r in s.list().collect()) == sorted((k, 200) for k in keys)
    assert [r.id for r in s.info(keys[0]).collect()] == [keys[0]] and s.info("nothing").count() == 0
    with pytest.raises(KeyError):
        s.open("nothing")
    d = s.open(keys[2])
    assert d.clusters(WORLD, 2).agg(F.sum("count")).first()[0] == 200
    assert d.summary(WORLD, 2)["counts"].first()["total_points"] == 200
    assert d.features(WORLD, 1).count() > 0
    now[0] = 100.0
    assert len(s.sweep()) == 2 and s.opened() == []


def test_grid_reach_and_method(spark):
    df = spark.createDataFrame([(2, 3000), (2, 9000), (6, 20000), (10, 20000), (10, 500)], "z int, n int")
    got = [tuple(r) for r in df.select(grid.method(F.col("z"), F.col("n")), grid.cell_reach(F.col("z"), F.col("n"))).collect()]
    assert got == [("grid", 2), ("grid_parallel", 1), ("grid_parallel", 1), ("sweep_parallel", 1), ("sweep", 1)]


def test_streams(spark, tmp_path):
    df = points(spark, [(i % 40, i / 10.0, 0.0, 1.0) for i in range(50)])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    append_points(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() == 40
    timed = stream.withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    q = windowed_cells(timed, 3, 40.0).writeStream.format("memory").queryName("cells").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from cells").first()[0] == 50
