import duckdb
import pytest

from lodemap.plans import catalogue, composed
from lodemap.sources import fixtures as fx


@pytest.fixture
def small(tmp_path, spark):
    """Points of every frame, so near each other that a voxel's points can be at one distance from their mean."""
    rows = [(i, [((i * 7919) % 997) / 1000, ((i * 104729) % 983) / 1000, ((i * 1299709) % 977) / 1000] + [0.0] * 8, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    return str(tmp_path), con


def test_poses_are_those_of_the_sql_to_the_last_bit(spark, small):
    folder, con = small
    want = con.sql(f"WITH {fx.POINTS}, {fx.POSES} SELECT frame, c, s FROM poses ORDER BY frame").fetchall()
    found = fx.poses(spark, folder).selectExpr("frame", "pose[0]", "pose[4]").orderBy("frame").collect()
    assert [tuple(r) for r in found] == want


def test_points_moved_to_the_map_are_those_of_the_sql(spark, small):
    """A voxel of two points has both at one distance from its mean, but for the last bit."""
    folder, con = small
    want = con.sql(f"WITH {composed._MAP} SELECT point_id, x, y, z FROM moved ORDER BY point_id").fetchall()
    found = composed._map(spark, folder).select("point_id", *"xyz").orderBy("point_id").collect()
    assert [tuple(r) for r in found] == want
    want = con.sql(catalogue.oracles()["thinned_map"]).fetchall()
    found = catalogue.queries()["thinned_map"](spark, folder).collect()
    assert sorted(tuple(r) for r in found) == sorted(want)
