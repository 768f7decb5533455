"""Equivalence of the scale-oriented helpers with their plain forms."""

import pytest
from pyspark.sql import functions as F

from tidelink.functions.temporal import tumbling_start
from tidelink.operators.joins import left_join_skew_safe
from tidelink.tables import read_table


@pytest.mark.parametrize("width", ["1 minute", "5 minutes", "15 minutes", "1 hour", "6 hours", "1 day",
                                   "7 minutes", "2 days"])
def test_tumbling_start_equals_window(spark, sf_dir, width):
    ev = read_table(spark, sf_dir, "events").select("ts")
    got = ev.select(tumbling_start("ts", width).alias("a"), F.window("ts", width)["start"].alias("b"))
    assert got.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_left_join_skew_safe_equals_left_join(spark):
    left = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("lv"))
    hot = spark.range(0, 3000).select(F.lit(7).cast("long").alias("rk"), F.col("id").alias("rv"))
    rest = spark.range(0, 300).select((F.col("id") % 40).alias("rk"), (F.col("id") + 10_000).alias("rv"))
    right = hot.unionByName(rest)
    plain = left.join(right, left.k == right.rk, "left")
    ours = left_join_skew_safe(left, right, "k", "rk")
    assert sorted(ours.select("k", "lv", "rk", "rv").collect()) == sorted(plain.select("k", "lv", "rk", "rv").collect())



def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tidelink import session

    conf = SimpleNamespace(get=lambda *_: None)
    for master, fails in (("local[2]", False), ("local", False), ("spark://host:7077", True), ("local-cluster[2,1,512]", True)):
        made = []
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf, setCheckpointDir=made.append)
        if fails:
            with pytest.raises(RuntimeError):
                session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
        else:
            session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
        assert bool(made) != fails
