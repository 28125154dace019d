from phraseweave.streaming.triples import stream_triples, unknown_triples


def test_only_unknown_triples_pass(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("<a> <p> <b> .\n<a> <p> <c> .\nnothing\n")
    known = spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")
    query = unknown_triples(stream_triples(spark, str(tmp_path / "in")), known).writeStream.format("memory").queryName("unknown").start()
    try:
        query.processAllAvailable()
        assert [tuple(r) for r in spark.sql("SELECT * FROM unknown").collect()] == [("a", "p", "c")]
    finally:
        query.stop()
