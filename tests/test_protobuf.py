import pytest
from pyspark.sql import functions as F

from featurescore.sources.protobuf import FlushWriter, from_protobuf, log_batches_of, message_classes, read_messages, stream_messages, to_protobuf, write_flushes
from featurescore.types import FIELDS, LOG_BATCH, REQUEST

ONE = {"double_value": 0.0, "float_value": 1.5, "integer_value": -7, "long_value": 2**62, "string_value": "é", "double_array": [0.1, -2.0], "float_array": [], "integer_array": [1, -1], "long_array": [2**40], "string_array": ["", "x"]}


def features():
    return {name: {**dict.fromkeys(FIELDS), name: x} for name, x in ONE.items()} | {"unset": dict.fromkeys(FIELDS)}


@pytest.fixture
def requests(spark):
    return spark.createDataFrame([("r1", [("row1", features()), ("row2", {})]), ("", []), ("r3", [("", {"only": {**dict.fromkeys(FIELDS), "string_value": ""}})])], REQUEST)


def test_round_trip_of_every_alternative(spark, requests):
    back = requests.select(to_protobuf(F.struct("request_id", "inputs"), "request").alias("b")).select(from_protobuf(F.col("b"), "request").alias("m"))
    got = {r.m.message.request_id: r.m for r in back.collect()}
    assert all(m.error is None for m in got.values())
    for r in requests.collect():
        assert got[r.request_id].message.asDict(True) == r.asDict(True)


def test_bytes_on_the_wire(spark):
    # request_id is field 1, inputs 2; a row's id is 1, its map 2 with entries key 1, value 2; float_value is field 2
    df = spark.createDataFrame([("a", [("b", {"c": {**dict.fromkeys(FIELDS), "float_value": 1.0}})])], REQUEST)
    raw = bytes(df.select(to_protobuf(F.struct("request_id", "inputs"), "request").alias("b")).first().b)
    value = b"\x15\x00\x00\x80\x3f"
    entry = b"\x0a\x01c\x12\x05" + value
    row = b"\x0a\x01b\x12" + bytes([len(entry)]) + entry
    assert raw == b"\x0a\x01a\x12" + bytes([len(row)]) + row


def test_unknown_fields_nulls_and_truncated_bytes(spark):
    good = b"\x0a\x01a"
    df = spark.createDataFrame([(good + b"\x7a\x03xyz",), (b"\x0a\x09a",), (None,), (b"",)], "b binary")
    got = [r.m for r in df.select(from_protobuf(F.col("b"), "request").alias("m")).collect()]
    assert got[0].message.request_id == "a" and got[0].error is None
    assert got[1].message is None and got[1].error.startswith("Not a message")
    assert got[2].message is None and got[2].error is None
    assert got[3].message.request_id == "" and got[3].message.inputs == []


def batch(i):
    return (f"r{i}", "m", [(f"row{i}", features(), [0.5, 0.25])])


def test_files_of_flushes(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = spark.createDataFrame([(k, i // 3, i % 3, batch(10 * k + i)) for k in (0, 1) for i in range(6)], "lane int, flush long, place int, batch " + LOG_BATCH.simpleString())
    flushes = rows.select("lane", "flush", "place", to_protobuf(F.col("batch"), "log_batch").alias("item"))
    write_flushes(flushes, path, "job")
    write_flushes(flushes, path, "job")  # the same flushes again: nothing new
    logs = read_messages(spark, path, "logs")
    assert logs.count() == 4 and logs.where("error is not null").count() == 0
    assert {tuple(b.request_id for b in r.message.batches) for r in logs.collect()} == {tuple(f"r{10 * k + i}" for i in range(3 * f, 3 * f + 3)) for k in (0, 1) for f in (0, 1)}
    assert log_batches_of(logs).count() == 12
    names = [r.path for r in logs.collect()]
    assert all(F.lit and __import__("re").search(r"/year=\d{4}/month=\d\d/day=\d\d/hour=\d\d/mi=\d{1,2}/[0-9a-f-]{14}4[0-9a-f-]{21}_\d{16}\.pb$", n) for n in names)
    whole = message_classes()["logs"]()
    whole.ParseFromString((tmp_path / "logs" / names[0].split("/logs/")[1]).read_bytes())
    assert len(whole.batches) == 3
    seen = stream_messages(spark, path, "logs", files=1).select("message.batches")
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    seen.select(F.explode("batches").alias("b")).select("b.request_id").writeStream.option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 12


def test_an_aborted_write_leaves_nothing(tmp_path):
    writer = FlushWriter(str(tmp_path), "job")
    staged = writer.write(iter([{"lane": 0, "flush": 0, "place": 0, "item": b"x"}]))
    assert len(staged.names) == 1
    writer.abort([staged])
    assert not list(tmp_path.rglob("*.pb")) and not list(tmp_path.rglob("*_*_*"))


def test_truncated_file_is_reported(spark, tmp_path):
    (tmp_path / "a.pb").write_bytes(b"\x0a\x09abc")
    r = read_messages(spark, str(tmp_path), "logs").first()
    assert r.message is None and r.error.startswith("Not a message")


def test_time_grows_with_the_rows(spark):
    import time

    one = F.map_from_arrays(F.array(*[F.lit(f"f{k}") for k in range(12)]), F.array(*[F.struct(*[F.lit(1.0 if n == "double_value" else None).cast(t).alias(n) for n, t in FIELDS.items()])] * 12))
    rows = spark.range(0, 30000, 1, 1).select(F.col("id").cast("string").alias("request_id"), F.array(F.struct(F.lit("r").alias("row_id"), one.alias("features"))).cast(REQUEST["inputs"].dataType).alias("inputs"))
    coded = rows.select(to_protobuf(F.struct("request_id", "inputs"), "request").alias("b"))
    taken = []
    for n in (1000, 3000, 30000):
        start = time.perf_counter()
        assert coded.limit(n).agg(F.sum(F.length("b"))).first()[0] > n
        taken.append(time.perf_counter() - start)
    assert taken[2] < 40 * taken[1] and taken[2] < 45
