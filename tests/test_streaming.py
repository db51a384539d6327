from pyspark.sql import functions as F

from candela.streaming import jobs


def feed(spark, path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id int, ts timestamp, v double").coalesce(1)
        df.write.mode("append").parquet(path)


def test_sync_keeps_the_latest_row_over_batches(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    path, root, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    handle = jobs.sync_handler(root, "id", "ts")
    for rows in ([(1, t(0), 1.0), (2, t(0), 5.0)], [(1, t(9), 2.0)], [(2, t(3), 6.0), (3, t(1), 7.0)]):
        feed(spark, path, [rows])
        stream = spark.readStream.schema("id int, ts timestamp, v double").parquet(path)
        jobs.per_batch(stream, handle, mark).awaitTermination()
    got = {r.id: r.v for r in jobs.read_latest(spark, root).collect()}
    assert got == {1: 2.0, 2: 6.0, 3: 7.0}


def test_a_repeated_batch_does_not_change_the_table(spark, tmp_path):
    root = str(tmp_path / "table")
    handle = jobs.sync_handler(root, "id", "ts")
    one = spark.createDataFrame([(1, 1, 1.0)], "id int, ts int, v double")
    two = spark.createDataFrame([(1, 2, 9.0)], "id int, ts int, v double")
    handle(one, 0)
    handle(two, 1)
    handle(two, 1)
    assert [(r.id, r.v) for r in jobs.read_latest(spark, root).collect()] == [(1, 9.0)]


def test_indicators_continue_over_batches(spark, tmp_path, bars_of):
    from candela.operators import indicators as ind

    history, path = str(tmp_path / "h"), str(tmp_path / "o")
    handle = jobs.indicator_handler(history, path, ind.sma((3,)), 3, ["symbol"], "ts")
    bars = bars_of(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])
    for number, upper in enumerate((2, 6, 6, 8)):
        handle(bars.where((F.col("close") <= upper) & (F.col("close") > (0, 2, 6, 6)[number])), number)
    handle(bars.where(F.col("close") > 6), 3)  # again
    got = [r.sma_3 for r in spark.read.parquet(path).orderBy("ts").collect()]
    assert got == [None, None, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    for number, kept in enumerate(([1.0, 2.0], [4.0, 5.0, 6.0], [4.0, 5.0, 6.0], [6.0, 7.0, 8.0])):
        assert sorted(r.close for r in spark.read.parquet(f"{history}/tail={number}").collect()) == kept


def test_reports_add_up_over_batches(spark, tmp_path):
    states, path = str(tmp_path / "s"), str(tmp_path / "r")
    sums = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    mean = lambda state: state.select("k", "n", (F.col("total") / F.col("n")).alias("mean"))
    handle = jobs.report_handler(states, path, ["k"], sums, mean)
    batches = [[("a", 1.0), ("b", 4.0)], [], [("a", 3.0), ("c", 5.0)]]
    for number, rows in [*enumerate(batches), (2, batches[2])]:
        handle(spark.createDataFrame(rows, "k string, v double"), number)
    got = {(r.k, r.n, r["mean"]) for r in spark.read.parquet(f"{path}/report=2").collect()}
    assert got == {("a", 2, 2.0), ("b", 1, 4.0), ("c", 1, 5.0)}
