from verbarium.streaming import flows


def test_daily_counts_and_upserts(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    got = flows.run_once(flows.daily_counts(flows.stream(spark, str(tmp_path / "in"), 1)), "counts")
    assert sorted(map(str, got.select("day", "event_type", "n").collect())) == sorted(map(str, flows.daily_counts(log).select("day", "event_type", "n").collect()))
    flows.upsert_each(flows.stream(spark, str(tmp_path / "in"), 1).select("user_id", "event_id"), str(tmp_path / "t"), ["user_id"], "event_id", str(tmp_path / "c")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "t/2"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in log.groupBy("user_id").agg({"event_id": "max"}).collect()}


def test_entry_states(spark, tmp_path):
    rows = [("s", "1", i, "failure") for i in range(7)] + [("s", "2", 0, "failure"), ("s", "2", 1, "success"), ("s", "2", 2, "failure")]
    spark.createDataFrame(rows, "data_source string, source_id string, ts int, outcome string").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = flows.run_once(flows.entry_states(flows.stream(spark, str(tmp_path / "in"))), "states", "update")
    assert {tuple(r) for r in got.collect()} == {("s", "1", "failure", 5), ("s", "2", "success", 2)}


def test_entry_states_of_a_table_of_several_files(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["stream_entry_states"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("create view events as select * from read_parquet('/root/testdata/sf0.001/events.parquet')")
    want = con.execute(entry.oracle_sql()["stream_entry_states"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_tries_of_one_entry_come_in_frames_of_any_order(spark, tmp_path):
    rows = [("s", "1", i, "success" if i == 2 else "failure") for i in range(40)]
    rows = rows[20:] + rows[:20]
    spark.createDataFrame(rows, "data_source string, source_id string, ts int, outcome string").coalesce(1).write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = flows.run_states(flows.entry_states(flows.stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        assert [tuple(r) for r in got.collect()] == [("s", "1", "success", 3)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
