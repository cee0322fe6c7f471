from kmerloom.operators import graph
from kmerloom.streaming.reads import running_graph


def test_running_graph(spark, tmp_path):
    rows = [(0, "AGTTCTGATCTGGGCTATATGCT"), (1, "AGTTCGAATCTGGGCTATATGCT"), (0, "AGTTCTGATC")]
    schema = "color int, seq string"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = running_graph(stream, 7).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    want = graph.build(graph.kmerize(spark.createDataFrame(rows, schema), 7, "seq", ("color",)))
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, want.collect()))
