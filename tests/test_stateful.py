import datetime as dt

from pyspark.sql import functions as F

from featurescore.streaming.stateful import count_flushes, run_counted, tick_summaries


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_flushes_fill_up_across_batches_and_a_restart(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema, sent = "lane int, item binary", 0
    for sizes in ([7, 4], [10, 3]):
        for n in sizes:
            spark.createDataFrame([(k, f"{k}-{i}".encode()) for k in (0, 1) for i in range(sent, sent + n)], schema).coalesce(1).write.mode("append").parquet(src)
            sent += n
        run_counted(count_flushes(stream(spark, src, schema), 5), out, at)
    got = spark.read.parquet(out).collect()
    for lane in (0, 1):
        flushes = {f: [r for r in got if r.lane == lane and r.flush == f] for f in {r.flush for r in got if r.lane == lane}}
        assert sorted(flushes) == [0, 1, 2, 3] and all(len(x) == 5 for x in flushes.values())
        items = [bytes(r.item) for f in sorted(flushes) for r in sorted(flushes[f], key=lambda r: r.place)]
        assert len(set(items)) == 20 and set(items) <= {f"{lane}-{i}".encode() for i in range(24)}


def test_ticks_close_once_and_late_rows_are_counted(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    t0, schema = dt.datetime(2024, 1, 1, tzinfo=dt.UTC), "ts timestamp, value double"
    batches = [
        [(0.1, 5.0), (0.9, 1.0), (0.5, None), (1.2, 7.0)],
        [(0.95, 3.0), (4.0, 2.0)],  # the first tick is open still when this batch begins
        [(0.2, 100.0), (9.0, 1.0)],  # now it is closed: late
    ]
    for rows in batches:
        spark.createDataFrame([(t0 + dt.timedelta(seconds=s), v) for s, v in rows], schema).coalesce(1).write.mode("append").parquet(src)
        counted = run_counted(tick_summaries(stream(spark, src, schema), "ts", "value", "1 second", "1 second", {"p50": 0.5, "p99": 0.99}), out, at)
    assert counted["late"] == 1
    got = {(r.window_start.replace(tzinfo=dt.UTC) - t0).seconds: (r.n, r.avg, r.p50, r.p99) for r in spark.read.parquet(out).withColumn("window_start", F.col("window_start")).collect()}
    assert got == {0: (3, 3.0, 3.0, 5.0), 1: (1, 7.0, 7.0, 7.0), 4: (1, 2.0, 2.0, 2.0)}


def test_arriving_rows_are_made_once(spark):
    from pyspark.sql import functions as F

    from featurescore.plans.catalogue import arriving

    made = spark.sparkContext.accumulator(0)

    def seen(x: int) -> int:
        made.add(1)
        return x

    rows = spark.range(40).select(F.udf(seen, "long")("id").alias("v"))
    files = []
    path = arriving(spark, rows, "once", lambda stream, path: files.append(spark.read.parquet(f"{path}/in").count()))
    assert made.value == 40 and files[1] <= 40 and spark.read.parquet(f"{path}/in").count() == 40
