from pyspark.sql import functions as F

from gridmesa.operators import fields
from gridmesa.plans import fixtures as fx
from gridmesa.streaming import live

SF = "/root/testdata/sf0.001"


def test_region_traffic_counts_every_position(spark, tmp_path):
    labels = fields.component_labels(fx.walk_cells(spark, SF), "raw", eight=False).cache()
    rows = fx.points(spark, SF).withColumn("ts", F.timestamp_seconds(F.col("x") * 60))
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.region_traffic(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), labels)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("traffic").start()
    query.processAllAvailable()
    query.stop()
    expected = rows.join(labels.where("label > 0"), ["map_id", "x", "y"]).count()
    assert spark.sql("SELECT sum(n) FROM traffic").head()[0] == expected > 0


def test_building_events_close_cells(spark, tmp_path):
    cells = fx.walk_cells(spark, SF).withColumn("walk", F.col("raw")).cache()
    events = fx.buildings(spark, SF)
    events.write.parquet(str(tmp_path / "in"))
    seen = []
    query = live.follow_buildings(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), cells, lambda df, n: seen.append(df.where("walk").count()), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert seen[-1] < cells.where("walk").count()
