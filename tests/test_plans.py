"""Plans: a filter on a key reaches every scan through derived columns."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import walk
from wayfold import session
from wayfold.functions.staging import let, pinned
from wayfold.operators import association, metrics, surface
from wayfold.operators.ordered import Chunks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans_of(df):
    return [line for line in plan_of(df).splitlines() if "FileScan" in line]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A trajectory and points, partitioned by drive."""
    folder = tmp_path_factory.mktemp("plans")
    both = spark.createDataFrame(walk("1", 60, 1)).unionByName(spark.createDataFrame(walk("2", 60, 2)))
    both.write.partitionBy("drive").parquet(f"{folder}/poses")
    rng = np.random.default_rng(3)
    rows = [(str(1 + i % 2), i % 3, i, float(rng.uniform(0, 9)), *map(float, rng.uniform(0, 4, 3))) for i in range(300)]
    cloud = spark.createDataFrame(rows, "drive string, scan_id int, idx long, t double, x double, y double, z double")
    cloud.write.partitionBy("drive").parquet(f"{folder}/points")
    schema = "idx long, stamp double, x double, y double, z double, qw double, qx double, qy double, qz double, drive string"
    return spark.read.schema(schema).parquet(f"{folder}/poses"), spark.read.schema(cloud.schema).parquet(f"{folder}/points")


def pruned(df):
    lines = scans_of(df)
    assert lines, "no scan in the plan"
    # Spark shortens long lines, so the comparison itself may be cut off.
    return all("PartitionFilters: [isnotnull(drive" in line for line in lines)


def test_interpolations_prune(stored):
    poses, _ = stored
    for pairs in (association.interpolate_screw(poses, poses, 0.5), association.interpolate_split(poses, poses, 0.5)):
        one = pairs.filter("drive = '1'")
        assert pruned(one)
        assert one.count() == pairs.collect().__len__() - pairs.filter("drive = '2'").count() > 0


def test_surface_map_prunes(stored):
    _, cloud = stored
    assert pruned(surface.surface_map(cloud, 2.0).filter("drive = '1'"))


def test_a_filter_on_a_derived_column_stays_above(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    out = let(df, {"a": F.sin("id"), "b": F.col("a") * 2, "c": F.col("b") + 1}, ["a"])
    assert out.columns == ["id", "k", "b", "c"]
    plan = plan_of(out.filter("k = 1 AND c > 1.5"))
    above, below = plan.split("Generate", 1)
    assert "1.5" in above and "1.5" not in below.split("Filter", 1)[-1] and "k#" in below
    got = {r.id: r.c for r in out.filter("k = 1 AND c > 1.5").collect()}
    assert got == {i: pytest.approx(2 * np.sin(i) + 1) for i in range(1, 10, 2) if 2 * np.sin(i) + 1 > 1.5}


def test_pinned_columns_of_an_empty_table(spark):
    assert pinned(spark.range(0), {"s": F.lit(1.0)}).collect() == []


def test_steps_along_one_axis_share_a_shuffle(spark):
    """A chunked distance deals its rows once, beside the totals of the two steps; big tables are kept as Parquet."""
    rows = spark.range(4000).select((F.col("id") % 2).alias("drive"), F.col("id").alias("idx"), (F.col("id") * 0.1).alias("stamp"), F.sin("id").alias("x"), F.cos("id").alias("y"), F.lit(0.0).alias("z"))
    chunks = Chunks.plan(rows, ("drive",), "stamp", 100)
    out = metrics.cumulative_distance(rows, chunks=chunks)
    assert out.columns == [*rows.columns, "distance"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert chunks.pieces > 20 and len(re.findall(r"Exchange hashpartitioning\(drive#\d+L, _chunk#\d+L", plan)) <= 3
    kept = session.stored(out)
    assert kept.schema.names == out.schema.names and kept.count() == 4000 and all(f.endswith(".parquet") for f in kept.inputFiles())
