from entitylink.streaming.incremental import match_stream


def test_records_are_matched_as_they_arrive(spark, tmp_path):
    rec = "source string, entity_id string, business_name string, business_address string, country string"
    targets = spark.createDataFrame([("S2", "S2_1", "Acme Corp", "12 Main St", "US"), ("S2", "S2_2", "Zed", "9 Elm", "US")], rec)
    for i, name in enumerate(("Acme", "Other Thing")):
        spark.createDataFrame([("S1", f"S1_{i}", name, "12 Main Street", "US")], rec).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rec).json(str(tmp_path / "in"))
    match_stream(stream, targets, str(tmp_path / "out"), str(tmp_path / "cp"), cap=50).awaitTermination(120)
    got = {(r.source1_id, r.target_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("S1_0", "S2_1") in got and ("S1_1", "S2_1") in got
    # the index is written once: a stream that goes on reads what is there
    built = {p: p.stat().st_mtime_ns for p in (tmp_path / "out-index").rglob("part-*")}
    spark.createDataFrame([("S1", "S1_9", "Zed", "9 Elm", "US")], rec).write.mode("append").json(str(tmp_path / "in"))
    match_stream(stream, targets, str(tmp_path / "out"), str(tmp_path / "cp"), cap=50).awaitTermination(120)
    assert built == {p: p.stat().st_mtime_ns for p in (tmp_path / "out-index").rglob("part-*")}
    assert ("S1_9", "S2_2") in {(r.source1_id, r.target_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
