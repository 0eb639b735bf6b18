"""The registered queries over the tables of a scale-factor folder, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoagg.functions import display, texts
from geoagg.functions import projection as P
from geoagg.operators import geojson, grid, index, neighbors, rollup, summary, viewport
from geoagg.options import SERVICE_OPTIONS, WORLD, Bounds, ClusterOptions
from geoagg.plans.session import expired, lru_victim
from geoagg.sources import ingest, points, scratch, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: CONUS holds all events (``points.event_points``).
SMALL, SECOND, CONUS = Bounds(-110, 30, -106, 36), Bounds(-80, 30, -75, 36), Bounds(-125, 25, -65, 49)
TWO = ClusterOptions(min_points=2)
THREE = ClusterOptions()
METADATA = {"event_type": "s", "level": "n", "even": "b", "timestamp": "s"}

EVENTS = """
ev as (
  select event_id as id,
    cast(-125e0 + ((user_id * 7919) % 55000) / 1000e0 + ((event_id * 7907) % 2000) / 1000e0 as float) as lng,
    cast(26e0 + ((user_id * 104729) % 20000) / 1000e0 + ((event_id * 7877) % 1600) / 1000e0 as float) as lat,
    value, cast(json_extract_string(props, '$.k') as int)::double as k, event_type, ts,
    cast(json_extract_string(props, '$.k') as int) as level, (cast(json_extract_string(props, '$.k') as int) % 2 = 0) as even,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp
  from events)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: Queries over all events whose SQL walks the seeds one by one: right on any table, in time only on small ones.
SLOW_SQL: set[str] = set()


def boxed(name: str, box: Bounds, sql: Callable[[Bounds], str]):
    """Registers a query over a viewport twice: over ``box``, and as ``name_all`` over all events."""

    def add(f):
        for n, b in ((name, box), (f"{name}_all", CONUS)):
            query(n, sql(b))(lambda spark, sf_dir, b=b: f(spark, sf_dir, b))
        SLOW_SQL.add(f"{name}_all")
        return f

    return add


def _view(b: Bounds, zoom: int, options: ClusterOptions = THREE) -> str:
    """CTE ``v``: the projected events of a viewport."""
    x, y = P.project_x_sql("lng", zoom, options), P.project_y_sql("lat", zoom, options)
    edge = lambda v, f: f(f"{float(v)!r}::float", zoom, options)
    return f"""{EVENTS},
v as (
  select * from (select *, {x} as x, {y} as y from ev)
  where x between {edge(b.min_x, P.project_x_sql)} and {edge(b.max_x, P.project_x_sql)}
    and y between {edge(b.max_y, P.project_y_sql)} and {edge(b.min_y, P.project_y_sql)})"""


def _groups(b: Bounds, zoom: int, options: ClusterOptions, order: str = "x, id") -> str:
    """CTE ``m``: the events of a viewport with their seed and the size of its group, by the sequential definition."""
    r = f"{float(options.radius)!r}::float"
    near = f"abs(q.x - s.x) <= {r} and (q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y) <= {r} * {r}"
    return f"""with recursive {_view(b, zoom, options)},
p as materialized (select id, x, y, row_number() over (order by {order}) as rn from v),
g(seed, taken, done) as (
  select null::bigint, []::bigint[], []::bigint[]
  union all
  select n.id, n.taken, list_concat(g.done, n.taken)
  from g, lateral (
    select s.id, case when len(s.near) >= {options.min_points} then s.near else [s.id] end as taken
    from (
      select s.id, s.rn, (select list(q.id) from p q where not list_contains(g.done, q.id) and {near}) as near
      from p s where not list_contains(g.done, s.id) order by s.rn limit 1) s) n),
gm as (select seed as cluster_id, unnest(taken) as id, len(taken) as size from g where seed is not null),
m as (select gm.cluster_id, gm.size, gm.size >= {options.min_points} as grouped, v.* from gm join v using (id))"""


def _clusters(b: Bounds, zoom: int, options: ClusterOptions, order: str = "x, id") -> str:
    """CTE ``c``: one row a cluster."""
    return f"""{_groups(b, zoom, options, order)},
c as (
  select cluster_id as id, count(*) as count, cast(avg(x::double) as float) as x, cast(avg(y::double) as float) as y,
    sum(value::decimal(24,6))::double as value, sum(k::decimal(24,6))::double as k
  from m group by cluster_id)"""


def _metadata(b: Bounds, zoom: int, options: ClusterOptions) -> str:
    """CTE ``f``: long metadata of clusters, as ``metadata_rows`` gives it; ``cl`` with class and weight."""
    return f"""{_groups(b, zoom, options)},
e as (
  select cluster_id, size, grouped, key, type, value from (
    select cluster_id, size, grouped, 'event_type' as key, 's' as type, event_type as value from m
    union all select cluster_id, size, grouped, 'level', 'n', level::varchar from m
    union all select cluster_id, size, grouped, 'even', 'b', even::varchar from m
    union all select cluster_id, size, grouped, 'timestamp', 's', stamp from m) where value is not null),
ec as (select cluster_id, size, grouped, key, type, value, count(*) as n from e group by all),
f as (
  select cluster_id, size as count, key, case when grouped then 'map' else 'single' end as kind, type, value,
    n / sum(n) over (partition by cluster_id, key) as freq from ec),
cl as (
  select *, case when kind = 'map' then trunc(freq * count)::bigint else count end as weight,
    case when kind = 'map' and key = 'timestamp' then 'time'
      when kind = 'map' and regexp_matches(value, '{texts.NUMBER}') then 'number' when kind = 'map' then 'text'
      when type = 'n' then 'number' when type = 's' and regexp_matches(value, '{texts.TIME}') then 'time' else 'text' end as class
  from f)"""


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# --- geometry --------------------------------------------------------------------------------------------------------


def _projected(zoom: int):
    def run(spark, sf_dir):
        return viewport.with_projection(points.event_points(spark, sf_dir), zoom).select("id", "x", "y")

    return run


for _name, _zoom in (("project_z0", 0), ("project_z5", 5), ("project_z16", 16), ("project_zoom_out_of_range", 17)):
    query(_name, f"with {EVENTS} select id, {P.project_x_sql('lng', _zoom)} as x, {P.project_y_sql('lat', _zoom)} as y from ev")(_projected(_zoom))


@query("unproject_roundtrip", f"with {EVENTS}, q as (select id, {P.project_x_sql('lng', 10)} as x, {P.project_y_sql('lat', 10)} as y from ev) select id, round({P.unproject_lng_sql('x', 10)}::double, 4) as lng, round({P.unproject_lat_sql('y', 10)}::double, 4) as lat from q")
def unproject_roundtrip(spark, sf_dir):
    q = viewport.with_projection(points.event_points(spark, sf_dir), 10)
    return _rounded(q.select("id", P.unproject_lng(F.col("x"), 10).alias("lng"), P.unproject_lat(F.col("y"), 10).alias("lat")), "lng", "lat")


@query("pole_clamp", f"with q as (select c_custkey as id, cast((c_custkey * 37) % 361 - 180 as float) as lng, cast(80 + c_custkey % 11 as float) as lat from customer) select id, {P.project_x_sql('lng', 3)} as x, {P.project_y_sql('lat', 3)} as y from q")
def pole_clamp(spark, sf_dir):
    k = F.col("c_custkey")
    q = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), ((k * 37) % 361 - 180).cast("float").alias("lng"), (80 + k % 11).cast("float").alias("lat"))
    return viewport.with_projection(q, 3).select("id", "x", "y")


@query("dataset_bounds", f"with {EVENTS} select min(lng) as min_x, min(lat) as min_y, max(lng) as max_x, max(lat) as max_y from ev")
def dataset_bounds(spark, sf_dir):
    return index.dataset_bounds(points.event_points(spark, sf_dir))


_TILES = "select (floor((lat::double + 90e0) / 5e0) * 72 + floor((lng::double + 180e0) / 5e0))::bigint as tile, count(*) as n, min(lng) as min_x, min(lat) as min_y, max(lng) as max_x, max(lat) as max_y, min(id) as min_id, max(id) as max_id from ev group by 1"


@query("bounds_overlap", f"with {EVENTS}, t as ({_TILES}) select tile, (max_x >= -100 and min_x <= -80 and max_y >= 30 and min_y <= 40) as meets from t")
def bounds_overlap(spark, sf_dir):
    tiles = index.tile_stats(points.event_points(spark, sf_dir))
    view = {"min_x": F.lit(-100.0), "min_y": F.lit(30.0), "max_x": F.lit(-80.0), "max_y": F.lit(40.0)}
    return tiles.select("tile", viewport.overlapping(tiles, view).alias("meets"))


# --- filters and scans -----------------------------------------------------------------------------------------------


def _in_view(b: Bounds, zoom: int):
    def run(spark, sf_dir):
        return viewport.viewport(points.event_points(spark, sf_dir), b, zoom).select("id", "x", "y")

    return run


for _name, _bounds, _zoom in (("viewport_filter_z5", Bounds(-100, 30, -95, 40), 5), ("viewport_world", WORLD, 3), ("viewport_antimeridian", Bounds(170, -10, -170, 10), 4)):
    query(_name, f"with {_view(_bounds, _zoom)} select id, x, y from v")(_in_view(_bounds, _zoom))


@query("viewport_wrapped", f"with {EVENTS} select id from ev where lng >= -70 or lng <= -120")
def viewport_wrapped(spark, sf_dir):
    return viewport.viewport(points.event_points(spark, sf_dir), Bounds(-70, -90, -120, 90), 16, wrap=True).select("id")


@query("viewport_density_sample", f"with {_view(CONUS, 5)}, s as (select id from ev where id % 10 = 0) select count(*) as sampled, count(v.id) as inside, count(v.id) / count(*) as ratio from s left join v using (id)")
def viewport_density_sample(spark, sf_dir):
    return viewport.density_sample(points.event_points(spark, sf_dir), CONUS, 5, 10)


_VIEWS = [(1, -110.0, 30.0, -106.0, 36.0), (2, -80.0, 30.0, -75.0, 36.0), (3, -90.0, 30.0, -85.0, 40.0), (4, -100.0, 30.0, -95.0, 40.0), (5, -125.0, 25.0, -65.0, 49.0)]


@query("batch_viewports", f"with {EVENTS}, w(view_id, a, b, c, d) as (values {', '.join(map(str, _VIEWS))}) select view_id, count(*) as n, min(id) as min_id, max(id) as max_id, sum(value::decimal(18,2))::double as total from ev join w on lng between a and c and lat between b and d group by view_id")
def batch_viewports(spark, sf_dir):
    views = spark.createDataFrame(_VIEWS, "view_id int, min_x double, min_y double, max_x double, max_y double")
    met = viewport.batch_viewports(points.event_points(spark, sf_dir), views)
    return met.groupBy("view_id").agg(F.count("*").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


_ZOOMS = (2, 5, 9)


def _views_sql() -> str:
    edge = lambda v, f, z: f(f"{v!r}::float", z)
    one = lambda i, a, b, c, d, z: (
        f"select {i} as view_id, {z} as zoom, count(*) as n, round(avg(x::double), 4) as mean_x, round(avg(y::double), 4) as mean_y, sum(value::decimal(18,2))::double as total "
        f"from (select *, {P.project_x_sql('lng', z)} as x, {P.project_y_sql('lat', z)} as y from ev) "
        f"where x between {edge(a, P.project_x_sql, z)} and {edge(c, P.project_x_sql, z)} and y between {edge(d, P.project_y_sql, z)} and {edge(b, P.project_y_sql, z)} having count(*) > 0"
    )
    return f"with {EVENTS} " + " union all ".join(one(*v, z) for v in _VIEWS for z in _ZOOMS)


@query("batch_viewports_zooms", _views_sql())
def batch_viewports_zooms(spark, sf_dir):
    views = spark.createDataFrame([(*v, z) for v in _VIEWS for z in _ZOOMS], "view_id int, min_x double, min_y double, max_x double, max_y double, zoom int")
    met = viewport.batch_projected(points.event_points(spark, sf_dir), views, _ZOOMS)
    means = {f"mean_{c}": F.avg(F.col(c).cast("double")) for c in "xy"}
    rows = met.groupBy("view_id", "zoom").agg(F.count("*").alias("n"), *[m.alias(n) for n, m in means.items()], F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return _rounded(rows, *means)


_CASES = [(z, n, r) for z in (2, 5, 9, 14, 16) for n in (1000, 20000, 60000, 200000) for r in (0.005, 0.1, 0.5)]


@query("scan_strategy_table", f"with t(zoom, n, ratio) as (values {', '.join(f'({z}, {n}, {r}::double)' for z, n, r in _CASES)}) select zoom, n, ratio, case when zoom >= 14 then 'index' when n > 100000 and ratio < 0.01 then 'index' when n > 100000 and ratio > 0.4 then 'parallel' else 'sequential' end as scan from t")
def scan_strategy_table(spark, sf_dir):
    t = spark.createDataFrame(_CASES, "zoom int, n int, ratio double")
    return t.withColumn("scan", viewport.scan_method(F.col("zoom"), F.col("n"), F.col("ratio")))


# --- index -----------------------------------------------------------------------------------------------------------


@query("tile_stats", f"with {EVENTS} {_TILES}")
def tile_stats(spark, sf_dir):
    return index.tile_stats(points.event_points(spark, sf_dir))


@query("median_split", f"with {EVENTS}, t as (select id, lng, (floor((lat::double + 90e0) / 5e0) * 72 + floor((lng::double + 180e0) / 5e0))::bigint as tile from ev), r as (select *, row_number() over (partition by tile order by lng, id) - 1 as rank, count(*) over (partition by tile) as n from t) select tile, id as median_id, lng as split, rank as left_n, n - rank - 1 as right_n from r where rank = floor((n - 1) / 2)")
def median_split(spark, sf_dir):
    return index.median_split(points.event_points(spark, sf_dir).withColumn("tile", index.tile()))


# --- grid ------------------------------------------------------------------------------------------------------------

_GRID = [(z, n) for z in range(17) for n in (1000, 5000, 8000, 20000, 60000)]
_GRID_SQL = ", ".join(map(str, _GRID))


@query("cell_size_table", f"with t(zoom, n) as (values {_GRID_SQL}) select zoom, n, round(case when zoom < 4 then 1.1e0 - 0.75e0 * zoom / 16e0 when zoom < 8 then 0.9e0 - 0.3e0 * zoom / 16e0 when zoom > 12 then 0.7e0 - 0.2e0 * zoom / 16e0 else 0.75e0 end * case when n > 50000 then 1.1e0 when n < 5000 then 0.9e0 else 1e0 end * 40, 6) as cell from t")
def cell_size_table(spark, sf_dir):
    t = spark.createDataFrame(_GRID, "zoom int, n int")
    return t.withColumn("cell", F.round(grid.cell_factor(F.col("zoom"), F.col("n")) * 40, 6))


@query("method_dispatch_table", f"with t(zoom, n) as (values {_GRID_SQL}), u as (select *, n > 10000 or (n > 5000 and zoom < 8) as par, zoom < 4 or (zoom < 8 and n > 10000) or n > 50000 as gr from t) select zoom, n, case when gr and par then 'grid_parallel' when gr then 'grid' when n > 10000 then 'sweep_parallel' else 'sweep' end as method, case when zoom < 4 and not par then 2 else 1 end as reach from u")
def method_dispatch_table(spark, sf_dir):
    t = spark.createDataFrame(_GRID, "zoom int, n int")
    return t.withColumns({"method": grid.method(F.col("zoom"), F.col("n")), "reach": grid.cell_reach(F.col("zoom"), F.col("n"))})


_CELLS = f"cl as (select id, x, y, value, floor(x::double / 30e0)::bigint as cell_x, floor(y::double / 30e0)::bigint as cell_y from v)"


@query("grid_assign", f"with {_view(CONUS, 5)}, {_CELLS} select id, cell_x, cell_y from cl")
def grid_assign(spark, sf_dir):
    return grid.assign_cells(viewport.viewport(points.event_points(spark, sf_dir), CONUS, 5), 30.0).select("id", "cell_x", "cell_y")


@query("grid_cell_rollup", f"with {_view(CONUS, 5)}, {_CELLS} select cell_x, cell_y, count(*) as n, sum(value::decimal(18,2))::double as total, round(avg(x::double), 4) as mean_x, round(avg(y::double), 4) as mean_y from cl group by all")
def grid_cell_rollup(spark, sf_dir):
    celled = grid.assign_cells(viewport.viewport(points.event_points(spark, sf_dir), CONUS, 5), 30.0)
    return _rounded(grid.cell_rollup(celled, "value"), "mean_x", "mean_y")


_NEAR = f"with {_view(CONUS, 7)}, pr as (select a.id, b.id as other from v a join v b on a.id < b.id and abs(b.x - a.x) <= 4::float and (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 16::float)"


@query("neighbor_pairs", f"{_NEAR} select id, other from pr")
def neighbor_pairs(spark, sf_dir):
    return neighbors.neighbor_pairs(viewport.viewport(points.event_points(spark, sf_dir), CONUS, 7), 4.0)


@query("neighbor_counts", f"{_NEAR}, b as (select id from pr union all select other from pr) select v.id, count(b.id) as neighbors from v left join b using (id) group by v.id")
def neighbor_counts(spark, sf_dir):
    return neighbors.neighbor_counts(viewport.viewport(points.event_points(spark, sf_dir), CONUS, 7), 4.0)


# --- greedy groups ---------------------------------------------------------------------------------------------------


def _members(spark, sf_dir, b, zoom=5, options=TWO, order="x", sized=True) -> DataFrame:
    return rollup.members(points.event_points(spark, sf_dir), b, zoom, options, order, sized=sized)


def _cluster_rows(spark, sf_dir, b, zoom=5, options=TWO) -> DataFrame:
    return rollup.cluster_rows(_members(spark, sf_dir, b, zoom, options, sized=False), zoom, ["value", "k"], options)


for _name, _b, _z, _o, _order in (
    ("greedy_membership_z5", SMALL, 5, TWO, "x"),
    ("greedy_minpoints3", SECOND, 8, THREE, "x"),
    ("greedy_input_order", SMALL, 6, TWO, "id"),
    ("greedy_z15_singletons", SMALL, 15, TWO, "x"),
):
    boxed(_name, _b, lambda b, z=_z, o=_o, order=_order: f"{_groups(b, z, o, 'x, id' if order == 'x' else 'id')} select id, cluster_id, size from m")(
        lambda spark, sf_dir, b, z=_z, o=_o, order=_order: _members(spark, sf_dir, b, z, o, order).select("id", "cluster_id", F.col("group_size").alias("size"))
    )


@boxed("greedy_clusters_z2", SMALL, lambda b: f"{_clusters(b, 2, TWO)} select id, count, value from c")
def greedy_clusters_z2(spark, sf_dir, b):
    return _cluster_rows(spark, sf_dir, b, zoom=2).select("id", "count", "value")


@query("greedy_full", f"{_clusters(CONUS, 5, TWO)} select id, count, round({P.unproject_lng_sql('x', 5)}::double, 3) as lng, round({P.unproject_lat_sql('y', 5)}::double, 3) as lat, value from c")
def greedy_full(spark, sf_dir):
    return _rounded(_cluster_rows(spark, sf_dir, b=CONUS, zoom=5).select("id", "count", "lng", "lat", "value"), "lng", "lat", digits=3)


SLOW_SQL.add("greedy_full")


@query("greedy_orders_z8")
def greedy_orders_z8(spark, sf_dir):
    o = ClusterOptions()
    return rollup.cluster_rows(rollup.members(points.order_points(spark, sf_dir), CONUS, 8, o, sized=False), 8, ["value"], o).select("id", "count", "lng", "lat", "value")


@boxed("service_clusters_z5", SMALL, lambda b: f"{_clusters(b, 5, SERVICE_OPTIONS)} select id, count, value from c")
def service_clusters_z5(spark, sf_dir, b):
    return _cluster_rows(spark, sf_dir, b, 5, SERVICE_OPTIONS).select("id", "count", "value")


@boxed("first_clusters", SMALL, lambda b: f"{_clusters(b, 5, TWO)} select id, count from c order by id limit 3")
def first_clusters(spark, sf_dir, b):
    return summary.first_clusters(_cluster_rows(spark, sf_dir, b)).select("id", "count")


@boxed("cluster_size_histogram", SECOND, lambda b: f"{_clusters(b, 7, TWO)} select count, count(*) as clusters from c group by count")
def cluster_size_histogram(spark, sf_dir, b):
    return summary.size_histogram(_cluster_rows(spark, sf_dir, b, 7))


# --- roll-ups --------------------------------------------------------------------------------------------------------


@boxed("cluster_metrics_sum", SMALL, lambda b: f"{_clusters(b, 5, TWO)} select id, count, value, k from c")
def cluster_metrics_sum(spark, sf_dir, b):
    return _cluster_rows(spark, sf_dir, b).select("id", "count", "value", "k")


@boxed("cluster_centroid", SMALL, lambda b: f"{_clusters(b, 5, TWO)} select id, round({P.unproject_lng_sql('x', 5)}::double, 3) as lng, round({P.unproject_lat_sql('y', 5)}::double, 3) as lat from c")
def cluster_centroid(spark, sf_dir, b):
    return _rounded(_cluster_rows(spark, sf_dir, b).select("id", "lng", "lat"), "lng", "lat", digits=3)


@boxed("cluster_members", SMALL, lambda b: f"{_groups(b, 5, TWO)} select cluster_id as id, string_agg(id::varchar, ',' order by id) as children from m group by cluster_id")
def cluster_members(spark, sf_dir, b):
    return _cluster_rows(spark, sf_dir, b).select("id", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


def _meta(spark, sf_dir, b, zoom=5, options=TWO) -> DataFrame:
    return rollup.metadata_rows(_members(spark, sf_dir, b, zoom, options), METADATA)


@boxed("cluster_metadata_freq", SMALL, lambda b: f"{_metadata(b, 5, TWO)} select cluster_id, key, value, round(freq, 6) as freq from f where kind = 'map'")
def cluster_metadata_freq(spark, sf_dir, b):
    return _rounded(_meta(spark, sf_dir, b).filter("kind = 'map'").select("cluster_id", "key", "value", "freq"), "freq", digits=6)


@boxed("singleton_raw_metadata", SECOND, lambda b: f"{_metadata(b, 12, TWO)} select cluster_id, key, type, value from f where kind = 'single'")
def singleton_raw_metadata(spark, sf_dir, b):
    return _meta(spark, sf_dir, b, 12).filter("kind = 'single'").select("cluster_id", "key", "type", "value")


@boxed("minpoints1_metadata_freq", SECOND, lambda b: f"{_metadata(b, 12, ClusterOptions(min_points=1))} select cluster_id, key, value, round(freq, 6) as freq from f where kind = 'map'")
def minpoints1_metadata_freq(spark, sf_dir, b):
    return _rounded(_meta(spark, sf_dir, b, 12, ClusterOptions(min_points=1)).filter("kind = 'map'").select("cluster_id", "key", "value", "freq"), "freq", digits=6)


@boxed("nested_rollup", SMALL, lambda b: f"{_clusters(b, 7, TWO)}, u as (select id, count, value, {P.unproject_lng_sql('x', 7)} as lng, {P.unproject_lat_sql('y', 7)} as lat from c) select id % 5 as group_id, sum(count)::bigint as count, round(sum(lng::double * count) / sum(count), 3) as lng, round(sum(lat::double * count) / sum(count), 3) as lat, sum(value::decimal(24,6))::double as value from u group by 1")
def nested_rollup(spark, sf_dir, b):
    rows = _cluster_rows(spark, sf_dir, b, zoom=7)
    return _rounded(rollup.nested_rollup(rows, F.col("id") % 5, ["value"]), "lng", "lat", digits=3)


@query("dedupe_ids", "select count(distinct l_orderkey) as n, min(l_orderkey) as min_id, max(l_orderkey) as max_id from lineitem")
def dedupe_ids(spark, sf_dir):
    rows = ingest.duplicates_dropped(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), "l_quantity"))
    return rows.agg(F.count("*").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


# --- summaries -------------------------------------------------------------------------------------------------------


@boxed("summary_counts", SMALL, lambda b: f"{_clusters(b, 8, TWO)} select coalesce(sum(count), 0)::bigint as total_points, count(*) filter (count > 1) as num_clusters, count(*) filter (count <= 1) as num_single_points from c")
def summary_counts(spark, sf_dir, b):
    return summary.counts(_cluster_rows(spark, sf_dir, b, zoom=8))


@boxed("metric_stats", SMALL, lambda b: f"{_clusters(b, 8, TWO)}, u as (select 'value' as key, value as v from c union all select 'k', k from c) select key, min(v) as min, max(v) as max, round(sum(v::decimal(30,6))::double, 4) as sum, round(sum(v::decimal(30,6))::double / count(*), 4) as average from u where v is not null group by key")
def metric_stats(spark, sf_dir, b):
    return _rounded(summary.metric_stats(_cluster_rows(spark, sf_dir, b, zoom=8), ["value", "k"]), "sum", "average")


@boxed("numeric_range", SMALL, lambda b: f"{_metadata(b, 8, TWO)} select key, min(value::double) as min, max(value::double) as max, case when sum(weight) > 0 then round(sum(value::double * weight) / sum(weight), 4) end as average from cl where class = 'number' group by key")
def numeric_range(spark, sf_dir, b):
    return _rounded(summary.numeric_range(_meta(spark, sf_dir, b, zoom=8)), "average")


@boxed("categorical_distribution", SMALL, lambda b: f"{_metadata(b, 8, TWO)}, n as (select key, value, sum(weight) as n from cl where class = 'text' and key not in (select key from cl where class in ('number', 'time')) group by key, value) select key, value, case when sum(n) over (partition by key) > 0 then round(n / sum(n) over (partition by key) * 100, 4) end as percent from n")
def categorical_distribution(spark, sf_dir, b):
    return _rounded(summary.distribution(_meta(spark, sf_dir, b, zoom=8)), "percent")


@boxed("time_range", SMALL, lambda b: f"{_metadata(b, 8, TWO)} select key, min(value) as earliest, max(value) as latest from cl where class = 'time' and key not in (select key from cl where class = 'number') group by key")
def time_range(spark, sf_dir, b):
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    return summary.time_range(_meta(spark, sf_dir, b, zoom=8)).select("key", text("earliest"), text("latest"))


@boxed("summary_precedence", SMALL, lambda b: f"{_metadata(b, 8, TWO)} select key, case when bool_or(class = 'number') then 'range' when bool_or(class = 'time') then 'time_range' else 'distribution' end as summary from cl group by key")
def summary_precedence(spark, sf_dir, b):
    return summary.summary_kinds(_meta(spark, sf_dir, b, zoom=8))


# --- ingest ----------------------------------------------------------------------------------------------------------


@query("metadata_typing", f"with {EVENTS} select id, 'event_type' as key, 's' as type, event_type as s, null::double as n, null::boolean as b from ev where event_type is not null union all select id, 'level', 'n', null, level::double, null from ev where level is not null union all select id, 'even', 'b', null, null, even from ev where even is not null")
def metadata_typing(spark, sf_dir):
    df = points.event_points(spark, sf_dir).withColumn("at", F.current_timestamp())
    return ingest.typed_metadata(df, ["event_type", "level", "even", "at"])


@query("metric_columns", f"with {EVENTS} select id, value::float as value, case when level % 3 = 0 then level::float end as level from ev")
def metric_columns(spark, sf_dir):
    df = points.event_points(spark, sf_dir)
    maps = F.map_filter(F.create_map(F.lit("value"), F.col("value").cast("float"), F.lit("level"), F.when(F.col("level") % 3 == 0, F.col("level").cast("float"))), lambda k, v: v.isNotNull())
    return ingest.metric_columns(df.select("id", maps.alias("metrics")))


@query("key_dictionary", f"with {EVENTS}, d as (select distinct unnest([case when event_type is not null then 'event_type' end, case when level is not null then 'level' end, case when even is not null then 'even' end]) as key from ev) select key, row_number() over (order by key) - 1 as key_id from d where key is not null")
def key_dictionary(spark, sf_dir):
    return ingest.key_dictionary(ingest.typed_metadata(points.event_points(spark, sf_dir), ["event_type", "level", "even"]))


@query("point_lookup", f"with {EVENTS} select id, value, event_type from ev where id % 100 = 7")
def point_lookup(spark, sf_dir):
    wanted = points.event_points(spark, sf_dir).filter("id % 100 = 7").select("id")
    return index.point_lookup(points.event_points(spark, sf_dir), wanted).select("id", "value", "event_type")


@query("point_lookup_all", f"with {EVENTS} select id, value, event_type from ev")
def point_lookup_all(spark, sf_dir):
    return index.point_lookup(points.event_points(spark, sf_dir), points.event_points(spark, sf_dir).select("id")).select("id", "value", "event_type")


# --- output ----------------------------------------------------------------------------------------------------------


def _fields(features: DataFrame, **paths: str) -> DataFrame:
    return features.select("id", *[F.get_json_object("feature", p).alias(n) for n, p in paths.items()])


@boxed("geojson_flat", SECOND, lambda b: f"{_clusters(b, 9, TWO)} select id, 'Feature' as type, (count > 1)::varchar as cluster, case when count > 1 then id::varchar end as cluster_id, case when count > 1 then count::varchar end as point_count, case when count <= 1 then id::varchar end as own_id, round(value, 2) as value from c")
def geojson_flat(spark, sf_dir, b):
    grouped = scratch.stored(_members(spark, sf_dir, b, 9), "grouped")
    features = geojson.flat_features(rollup.cluster_rows(grouped, 9, ["value", "k"], TWO), ["value", "k"], rollup.metadata_rows(grouped, METADATA))
    out = _fields(features, type="$.type", cluster="$.properties.cluster", cluster_id="$.properties.cluster_id", point_count="$.properties.point_count", own_id="$.properties.id", value="$.properties.value")
    return out.withColumn("value", F.round(F.col("value").cast("double"), 2))


@boxed("feature_collection_api", SECOND, lambda b: f"{_clusters(b, 9, TWO)} select id, (count > 1)::varchar as cluster, count::varchar as point_count, round(value, 2) as value, round(k, 2) as k from c")
def feature_collection_api(spark, sf_dir, b):
    features = geojson.service_features(_cluster_rows(spark, sf_dir, b, 9), ["value", "k"])
    out = _fields(features, cluster="$.properties.cluster", point_count="$.properties.point_count", value="$.properties.metrics.value", k="$.properties.metrics.k")
    return out.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in ("value", "k")})


@boxed("feature_collection", SECOND, lambda b: f"{_clusters(b, 9, TWO)} select 'FeatureCollection' as type, count(*) as features, min(id) as least_id, max(id) as most_id from c")
def feature_collection(spark, sf_dir, b):
    text = geojson.collection(geojson.service_features(_cluster_rows(spark, sf_dir, b, 9), ["value", "k"]))
    whole = F.from_json("collection", "type string, features array<struct<properties:struct<id:bigint>>>")
    ids = F.transform(F.col("c.features"), lambda f: f["properties"]["id"])
    return text.select(whole.alias("c")).select("c.type", F.size(ids).cast("long").alias("features"), F.array_min(ids).alias("least_id"), F.array_max(ids).alias("most_id"))


@query("display_scalars", """
select o_orderkey as id, 'Total Price' as title,
  case when o_totalprice::double >= 1e6 then round(cast(o_totalprice::double / 1e6 as decimal(20, 9)), 1)::varchar || 'M' when o_totalprice::double >= 1e3 then round(cast(o_totalprice::double / 1e3 as decimal(20, 9)), 1)::varchar || 'K' else round(cast(o_totalprice::double as decimal(20, 9)), 1)::varchar end as short,
  round(case when n <= 0 then 15e0 when n <= 100 then 15 + n * 10e0 / 100 when n <= 1000 then 25 + (n - 100) * 10e0 / 900 when n <= 10000 then 35 + (n - 1000) * 10e0 / 9000 else 45e0 end, 4) as radius,
  case when n >= 1000 then '#f28cb1' when n >= 100 then '#f1f075' else '#51bbd6' end as colour, least(o_orderkey % 17 + 2, 16)::bigint as opens
from (select *, o_orderkey % 12000 as n from orders)
""")
def display_scalars(spark, sf_dir):
    n = F.col("o_orderkey") % 12000
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), display.metric_title(F.lit("total_price")).alias("title"), display.short_number(F.col("o_totalprice")).alias("short"),
        F.round(display.circle_radius(n), 4).alias("radius"), display.circle_colour(n).alias("colour"), display.opening_zoom(F.col("o_orderkey") % 17).cast("long").alias("opens"),
    )


# --- catalog ---------------------------------------------------------------------------------------------------------

_FILES = [("cluster-4200p-20240229-101112-58c0ffee.zst", 100), ("cluster-1000p-20240101-000000-aaaa1111.zst", 5), ("cluster-1000p-20240101-aaaa1111.zst", 6), ("cluster-10p-20240101-000000-bbbb.bin", 7), ("cluster-xp-20240101-000000-cccc.zst", 8), ("cluster-5p-20241399-000000-dddd.zst", 9), ("cluster-77p-20250301-235959-58ee77aa.zst", 10)]
_FILES_SQL = "f(name, file_size) as (values " + ", ".join(f"('{n}', {s}::bigint)" for n, s in _FILES) + ")"


def _files(spark):
    return spark.createDataFrame(_FILES, "name string, file_size long")


@query("list_saved", f"with {_FILES_SQL}, q as (select *, regexp_extract(name, '^cluster-([0-9]+)p-([0-9]{{8}})-([0-9]{{6}})-([^-]+)\\.zst$', ['n', 'd', 't', 'id']) as r from f) select r.id as id, try_cast(r.n as bigint) as num_points, strftime(try_strptime(r.d || r.t, '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') as saved_at, file_size from q where r.id <> '' and try_strptime(r.d || r.t, '%Y%m%d%H%M%S') is not null")
def list_saved(spark, sf_dir):
    return store.listed(_files(spark)).drop("name").withColumn("saved_at", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss"))


@query("find_by_substring", f"with {_FILES_SQL} select name, file_size from f where contains(name, '58') and ends_with(name, '.zst') order by name limit 1")
def find_by_substring(spark, sf_dir):
    return store.find(_files(spark), "58")


_OPEN_SQL = "o as (select c_custkey as id, (c_custkey * 7919) % 3601 as last_access from customer)"


def _opened(spark, sf_dir):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), ((k * 7919) % 3601).alias("last_access"))


@query("lru_victim", f"with {_OPEN_SQL} select id from o order by last_access, id limit 1")
def lru_victim_query(spark, sf_dir):
    return lru_victim(_opened(spark, sf_dir))


@query("ttl_expired", f"with {_OPEN_SQL} select id from o where 3600 - last_access > 1800")
def ttl_expired(spark, sf_dir):
    return expired(_opened(spark, sf_dir), 3600)


@query("save_load_roundtrip", f"with {EVENTS} select id, lng, lat, value, event_type, 40e0 as radius, 2 as min_points from ev")
def save_load_roundtrip(spark, sf_dir):
    path = scratch.folder(spark, "saved")
    store.save(points.event_points(spark, sf_dir), path, TWO)
    df, options = store.load(spark, path)
    return df.select("id", "lng", "lat", "value", "event_type", F.lit(options.radius).alias("radius"), F.lit(options.min_points).alias("min_points"))


# --- generators ------------------------------------------------------------------------------------------------------


def _uniform_sql(seed: int) -> str:
    return f"(((id * 1103515245 + {seed} * 12345 + 1013904223) % 1000003) / 1000003e0)"


def _attributes_sql(seed: int) -> str:
    """The generated metrics and metadata."""
    u = lambda k: _uniform_sql(seed + k)
    pick = lambda values: f"[{', '.join(repr(v) for v in values)}][(id % {len(values)} + 1)::int]"
    return f"""cast({u(2)} * 100e0 as float) as value, cast({u(3)} * 1000e0 as float) as sales, cast({u(4)} * 50e0 as float) as size,
      cast(trunc(cast({u(5)} * 500e0 as float)) as float) as customers, {pick(points.CATEGORIES)} as category, {pick(points.REGIONS)} as region,
      cast({u(7)} * 3000e0 as float) as elevation,
      strftime(make_timestamp((1700000000 + floor({u(6)} * 2592000)::bigint) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as timestamp"""


@query("uniform_points", f"with r as (select range as id from range(5000)) select id, cast(-180e0 + {_uniform_sql(42)} * 360e0 as float) as lng, cast(-90e0 + {_uniform_sql(43)} * 180e0 as float) as lat, {_attributes_sql(42)} from r")
def uniform_points(spark, sf_dir):
    return points.uniform_points(spark, 5000)


@query("city_points", f"with r as (select range as id from range(5000)), q as (select id, ['New York', 'Los Angeles', 'Chicago'][(id % 3 + 1)::int] as city, [40.7128e0, 34.0522e0, 41.8781e0][(id % 3 + 1)::int] as la, [-74.006e0, -118.2437e0, -87.6298e0][(id % 3 + 1)::int] as lo, sqrt({_uniform_sql(42)}) * (50e0 / 69e0) as reach, {_uniform_sql(43)} * 2e0 * pi() as angle from r) select id, city, round(lo + reach * cos(angle) / cos(radians(la)), 4) as lng, round(la + reach * sin(angle), 4) as lat, {_attributes_sql(42)} from q")
def city_points(spark, sf_dir):
    return _rounded(points.city_points(spark, 5000), "lng", "lat")
