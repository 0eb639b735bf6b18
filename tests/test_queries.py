import pytest

from geoagg.plans.queries import ORACLE, QUERIES

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE[name], SF)


@pytest.mark.parametrize("name", ["greedy_full", "greedy_orders_z8"])
def test_every_point_is_counted_once(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    table, key = ("events", "event_id") if name == "greedy_full" else ("orders", "o_orderkey")
    assert sum(r["count"] for r in rows) == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()


GROUPED = "greedy_membership_z5 greedy_minpoints3 greedy_input_order greedy_z15_singletons greedy_clusters_z2 cluster_size_histogram cluster_metrics_sum cluster_centroid cluster_members cluster_metadata_freq singleton_raw_metadata minpoints1_metadata_freq nested_rollup summary_counts metric_stats numeric_range categorical_distribution time_range summary_precedence geojson_flat feature_collection_api".split()


@pytest.mark.parametrize("name", [*GROUPED, "point_lookup"])
def test_whole_table_is_registered(name):
    assert {f"{name}_all", name} <= set(QUERIES) & set(ORACLE)


@pytest.mark.parametrize("name", [f"{n}_all" for n in (*GROUPED[:4], "point_lookup")])
def test_whole_table_has_every_event(spark, name):
    ids = sorted(r["id"] for r in QUERIES[name](spark, SF).select("id").collect())
    assert ids == sorted(r["event_id"] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect())


def test_whole_table_sums(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    for name, column in (("greedy_clusters_z2_all", "count"), ("cluster_metrics_sum_all", "count"), ("nested_rollup_all", "count"), ("summary_counts_all", "total_points")):
        assert sum(r[column] for r in QUERIES[name](spark, SF).collect()) == n


def test_batches_have_views_and_zooms(spark):
    rows = {(r.view_id, r.zoom): r for r in QUERIES["batch_viewports_zooms"](spark, SF).collect()}
    assert len({z for _, z in rows}) == 3 and {v for v, _ in rows} == {1, 2, 3, 4, 5} and len(rows) == 15
    plain = {r.view_id: r.n for r in QUERIES["batch_viewports"](spark, SF).collect()}
    assert all(r.n == plain[v] for (v, _), r in rows.items())
    assert all(abs(rows[v, 9].mean_x / rows[v, 2].mean_x - 128) < 0.01 for v in plain)


@pytest.mark.parametrize("name", ["cluster_members_all", "first_clusters_all", "summary_counts_all", "greedy_input_order_all"])
def test_points_are_not_sent_to_all(spark, name):
    """A query that reads few columns makes a side of the join by id look small; all points would go through the driver."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    join = [line for line in plan.splitlines() if "Join Inner, (id#" in line]
    assert len(join) == 1 and "strategy=merge" in join[0]


def test_times_are_not_counted_for_ranges(spark):
    """Each point has a time of its own: for ranges of numbers they are left out before the values are counted."""
    lines = QUERIES["numeric_range_all"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(i for i, line in enumerate(lines) if "Window [" in line)
    assert any("Filter" in line and "timestamp" in line for line in lines[window:])
