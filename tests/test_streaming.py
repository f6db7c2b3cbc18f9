from pyspark.sql import functions as F

from skein.streaming.edges import append_edges, graph_at, streaming_degrees


def test_degrees_and_batches(spark, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    rows = spark.createDataFrame([(0, 1, "2024-01-01 00:00:01"), (0, 2, "2024-01-01 00:00:02"), (0, 1, "2024-01-01 00:10:00")], "src long, dst long, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(source)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(source)
    q = streaming_degrees(stream()).writeStream.outputMode("complete").format("memory").queryName("degrees").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: (r["out_degree"], r["in_degree"]) for r in spark.table("degrees").collect()} == {0: (3, 0), 1: (0, 2), 2: (0, 1)}
    q = streaming_degrees(stream(), ("ts", "1 minute"), "5 minutes").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").filter("id = 1").count() == 2
    q = stream().select("src", "dst").writeStream.foreachBatch(append_edges(table)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    g = graph_at(spark, table)
    assert g.num_edges() == 2 and graph_at(spark, table, keep="all").num_edges() == 3
