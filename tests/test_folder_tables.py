import __spark_entry__ as entry


def test_stream_of_a_table_that_is_a_folder(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(12)
    rows.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    want = {r.doc_id for r in rows.filter("text <> ''").collect()}
    assert {r.source_id for r in entry.queries()["stream_ingest"](spark, str(tmp_path)).collect()} == want


def test_event_stream_of_a_table_that_is_a_folder(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").limit(200)
    rows.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    assert entry.queries()["route_messages_stream"](spark, str(tmp_path)).count() == 200
