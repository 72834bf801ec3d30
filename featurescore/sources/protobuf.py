"""Protobuf messages of requests, responses and logs: columns of bytes, files of messages, and a sink for flushes.

Files are read by Spark's own binary source, in batches and as streams, so any path that Spark knows will do; a column of
bytes becomes a column of structs and back in Arrow batches. Unknown fields are skipped, and bytes that are no message
(a truncated file) give an error beside a null message, not a failed job. Proto3 has no nulls: a null text is written as
the empty one, null arrays and maps as empty ones, a value without an alternative as an unset one; a null element of an
array cannot be written and fails the job.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..types import FEATURES, FIELDS, LOG_BATCH, REQUEST, RESPONSE

LOGS = T.StructType([T.StructField("batches", T.ArrayType(LOG_BATCH))])
#: Messages by name, with the struct that holds each.
MESSAGES = {"request": REQUEST, "response": RESPONSE, "log_batch": LOG_BATCH, "logs": LOGS}
ERROR = "Not a message of the expected type: {}"

# The fields of each message in the order of their numbers, which begin at 1; value has one of its fields
# set, and lists of numbers are messages with a single repeated field.
_KINDS = {"double": 1, "float": 2, "long": 3, "integer": 5, "string": 9}
_LAYOUT = {
    "request": [("request_id", "string", False), ("inputs", "input", True)],
    "response": [("request_id", "string", False), ("outputs", "output", True)],
    "input": [("row_id", "string", False), ("features", "entry", True)],
    "output": [("row_id", "string", False), ("scores", "float", True)],
    "entry": [("key", "string", False), ("value", "value", False)],
    "log_row": [("row_id", "string", False), ("features", "entry", True), ("scores", "float", True)],
    "log_batch": [("request_id", "string", False), ("model_id", "string", False), ("inference_log_rows", "log_row", True)],
    "logs": [("batches", "log_batch", True)],
    "value": [(name, name.split("_")[0] if name.endswith("_value") else name, False) for name in FIELDS],
    **{name: [("values", name.split("_")[0], True)] for name in FIELDS if name.endswith("_array")},
}


@cache
def message_classes() -> dict:
    """Message classes by name. A map is written as its entries, which is what a map field is on the wire."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    file = descriptor_pb2.FileDescriptorProto(name="featurescore.proto", package="featurescore", syntax="proto3")
    for name, fields in _LAYOUT.items():
        message = file.message_type.add(name=name)
        if name == "value":
            message.oneof_decl.add(name="held")
        for number, (field, kind, repeated) in enumerate(fields, 1):
            f = message.field.add(name=field, number=number, label=3 if repeated else 1, type=_KINDS.get(kind, 11))
            if kind not in _KINDS:
                f.type_name = f".featurescore.{kind}"
            if name == "value":
                f.oneof_index = 0
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return {name: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"featurescore.{name}")) for name in _LAYOUT}


#: Rows whose messages are in memory at once.
SLICE = 512


def _lists(parts: list, values: pa.Array | list, kind: pa.DataType) -> pa.Array:
    """The flat values as lists as long as the parts."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values, type=kind.value_type), type=kind)


def _columns(messages: list, name: str, kind: pa.DataType) -> pa.Array:
    """Messages as structs of the given type, a column at a time."""
    arrays = []
    if name == "value":
        held = [m.WhichOneof("held") for m in messages]
        seen = set(held)
        for f in kind:
            if f.name not in seen:
                arrays.append(pa.nulls(len(messages), f.type))
            elif f.name.endswith("_value"):
                arrays.append(pa.array([getattr(m, f.name) if h == f.name else None for m, h in zip(messages, held, strict=True)], type=f.type))
            else:
                arrays.append(pa.array([list(getattr(m, f.name).values) if h == f.name else None for m, h in zip(messages, held, strict=True)], type=f.type))
        return pa.StructArray.from_arrays(arrays, fields=list(kind))
    for field, inner, repeated in _LAYOUT[name]:
        t = kind.field(field).type
        parts = [getattr(m, field) for m in messages]
        if inner == "entry":
            # of a key that comes twice the last value holds
            maps = [{e.key: e.value for e in p} for p in parts]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in maps])]).astype(np.int32)
            values = _columns([v for x in maps for v in x.values()], "value", t.item_type)
            arrays.append(pa.MapArray.from_arrays(pa.array(ends), pa.array([k for x in maps for k in x], type=t.key_type), values, type=t))
        elif inner not in _KINDS:
            arrays.append(_lists(parts, _columns([x for p in parts for x in p], inner, t.value_type), t))
        else:
            arrays.append(_lists(parts, [x for p in parts for x in p], t) if repeated else pa.array(parts, type=t))
    return pa.StructArray.from_arrays(arrays, fields=list(kind))


def _dense(column: Column, name: str) -> Column:
    """A struct without null lists and texts, its values with the place of the alternative that is set (the last one, of several).

    Spark asks for the size of an Arrow batch after each row, and then walks along each vector of lists or texts from its
    last one that is not null: with nulls only, that is all of the batch for each row.
    """
    if name == "value":
        held = F.coalesce(*[F.when(column[f].isNotNull(), F.lit(k)) for k, f in reversed(list(enumerate(FIELDS)))])
        return F.struct(held.alias("held"), *[F.coalesce(column[f].cast(t), F.array().cast(t) if isinstance(t, T.ArrayType) else F.lit("0").cast(t)).alias(f) for f, t in FIELDS.items()])
    out = []
    for field, kind, repeated in _LAYOUT[name]:
        x = column[field]
        if kind == "entry":
            none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(T.ArrayType(FEATURES.valueType)))
            x = F.transform_values(F.coalesce(x, none), lambda _, v: _dense(v, "value"))
        elif repeated:
            one = (lambda kind: lambda e: e if kind in _KINDS else F.when(e.isNotNull(), _dense(e, kind)))(kind)
            x = F.coalesce(F.transform(x, one), F.array())
        out.append(x.alias(field))
    return F.struct(*out)


def _parts(column: pa.Array) -> tuple[pa.Array, list[int]]:
    """(the flat elements of lists, where each begins and ends); a null list has none."""
    return column.flatten(), [0, *np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()]


def _filler(column: pa.Array, name: str) -> Callable[[object, int], None]:
    """A function that fills a message with the i-th struct of a column, whose numbers and texts are unpacked at once."""
    if name == "value":
        held, which = [None] * len(column), column.field("held").fill_null(-1).to_numpy(zero_copy_only=False)
        for k, field in enumerate(FIELDS):
            there = np.flatnonzero(which == k)
            for i, v in zip(there.tolist(), column.field(field).take(pa.array(there)).to_pylist(), strict=True):
                held[i] = (field, v)

        def fill_value(message, i: int) -> None:
            if held[i]:
                field, x = held[i]
                if field.endswith("_value"):
                    setattr(message, field, x)
                else:
                    part = getattr(message, field)
                    part.SetInParent()
                    part.values.extend(x)

        return fill_value
    fills = [_field_filler(column.field(field), field, kind, repeated) for field, kind, repeated in _LAYOUT[name]]
    valid = None if column.null_count == 0 else column.is_valid().to_pylist()

    def fill(message, i: int) -> None:
        if valid and not valid[i]:
            raise TypeError("a null element of an array cannot be written")
        for f in fills:
            f(message, i)

    return fill


def _field_filler(column: pa.Array, field: str, kind: str, repeated: bool) -> Callable[[object, int], None]:
    if kind in _KINDS and not repeated:
        held = column.to_pylist()

        def fill(message, i: int) -> None:
            if held[i] is not None:
                setattr(message, field, held[i])

        return fill
    if kind != "entry":
        flat, ends = _parts(column)
    if kind in _KINDS:
        numbers = flat.to_pylist()
        return lambda message, i: getattr(message, field).extend(numbers[ends[i] : ends[i + 1]])
    if kind == "entry":
        at = column.offsets.to_numpy()
        length = int(at[-1] - at[0])
        keys, one = column.keys.slice(at[0], length).to_pylist(), _filler(column.items.slice(at[0], length), "value")
        begins, stops = (at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist()
        none = set(np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist())

        def fill_map(message, i: int) -> None:
            entries = getattr(message, field)
            for j in range(begins[i], begins[i] if i in none else stops[i]):
                e = entries.add(key=keys[j])
                e.value.SetInParent()
                one(e.value, j)

        return fill_map
    inner = _filler(flat, kind)

    def fill_all(message, i: int) -> None:
        items = getattr(message, field)
        for j in range(ends[i], ends[i + 1]):
            inner(items.add(), j)

    return fill_all


def from_protobuf(column: Column, message: str) -> Column:
    """A struct (message, error) of a column of bytes; both are null for null bytes."""
    schema = T.StructType([T.StructField("message", MESSAGES[message]), T.StructField("error", T.StringType())])

    def some(data: pa.Array, kind: pa.DataType) -> pa.Array:
        from google.protobuf.message import DecodeError

        made, good, places, errors = message_classes()[message], [], [], []
        for x in data.to_pylist():
            error = None
            if x is not None:
                try:
                    good.append(made.FromString(x))
                except DecodeError as e:
                    error = ERROR.format(e)
            places.append(None if x is None or error else len(good) - 1)
            errors.append(error)
        found = _columns(good, message, kind.field("message").type).take(pa.array(places, type=pa.int64()))
        return pa.StructArray.from_arrays([found, pa.array(errors, type=pa.string())], fields=list(kind))

    def run(data: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema)
        return pa.concat_arrays([some(data.slice(lo, SLICE), kind) for lo in range(0, max(1, len(data)), SLICE)])

    return F.arrow_udf(run, schema)(column)


def to_protobuf(column: Column, message: str) -> Column:
    """A column of structs (see MESSAGES) as bytes; null for a null struct."""

    def some(data: pa.Array) -> list[bytes | None]:
        made, out, there = message_classes()[message], [None] * len(data), np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False))
        fill = _filler(data.take(pa.array(there)), message)
        for k, i in enumerate(there.tolist()):
            one = made()
            fill(one, k)
            out[i] = one.SerializeToString(deterministic=True)
        return out

    def run(data: pa.Array) -> pa.Array:
        return pa.array([x for lo in range(0, len(data), SLICE) for x in some(data.slice(lo, SLICE))], type=pa.binary())

    return F.arrow_udf(run, "binary")(F.when(column.isNotNull(), _dense(column, message)))


#: What Spark's binary source gives.
FILE = "path string, modificationTime timestamp, length long, content binary"


def _unpacked(files: DataFrame, message: str) -> DataFrame:
    return files.select("path", from_protobuf(F.col("content"), message).alias("got")).select("path", "got.message", "got.error")


def read_messages(spark: SparkSession, path: str, message: str, pattern: str = "*.pb") -> DataFrame:
    """Rows (path, message, error): a file is a message. Folders below path are searched too."""
    return _unpacked(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path), message)


def stream_messages(spark: SparkSession, path: str, message: str, pattern: str = "*.pb", files: int | None = None) -> DataFrame:
    """As read_messages, for a stream: each new file is read once, as many in a micro-batch as files says."""
    source = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return _unpacked((source.option("maxFilesPerTrigger", files) if files else source).load(path), message)


def log_batches_of(logs: DataFrame) -> DataFrame:
    """The batches of read log files, one a row; files with an error have none."""
    return logs.select(F.explode("message.batches").alias("batch")).select("batch.*")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def framed(item: bytes) -> bytes:
    """An encoded batch as an entry of a file of logs: the field's tag, its length, itself."""
    return b"\x0a" + _varint(len(item)) + item


def flush_name(lane: int, flush: int, salt: str) -> str:
    """A uuid (version 4) that depends on the flush only, so that a flush which is written again has the same."""
    return str(uuid.UUID(bytes=hashlib.sha256(f"{salt}:{lane}:{flush}".encode()).digest()[:16], version=4))


class Staged(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class FlushWriter(DataSourceWriter):
    """Writes each flush as one file. Tasks write under _staged; the commit moves whole files to their places.

    A flush that is there already, from a batch that came again, is not moved a second time.
    """

    def __init__(self, path: str, salt: str):
        self.path, self.salt, self.run = path.rstrip("/"), salt, uuid.uuid4().hex

    def files(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return store, base

    def write(self, iterator: Iterator) -> Staged:
        store, base = self.files()
        store.create_dir(f"{base}/_staged/{self.run}", recursive=True)
        names = []
        for (lane, flush), rows in groupby(iterator, key=lambda r: (r["lane"], r["flush"])):
            # a task that is tried again writes other files; those of the lost try are never moved
            name = f"{flush_name(lane, flush, self.salt)}_{uuid.uuid4().hex}"
            with store.open_output_stream(f"{base}/_staged/{self.run}/{name}") as out:
                for r in rows:
                    out.write(framed(bytes(r["item"])))
            names.append(name)
        return Staged(names)

    def commit(self, messages: list) -> None:
        store, base = self.files()
        now = time.time_ns() // 1000
        # the minute has no leading zero (see PARTITIONS)
        at = time.gmtime(now // 1_000_000)
        folder = f"{base}/{time.strftime('year=%Y/month=%m/day=%d/hour=%H', at)}/mi={at.tm_min}"
        there = self._known(store, base)
        for name in [n for m in messages if m is not None for n in m.names]:
            flush = name.split("_")[0]
            if flush not in there:
                store.create_dir(folder, recursive=True)
                store.move(f"{base}/_staged/{self.run}/{name}", f"{folder}/{flush}_{now}.pb")
        self.abort(messages)

    @staticmethod
    def _known(store, base: str) -> set[str]:
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
        return {f.base_name.split("_")[0] for f in found if f.base_name.endswith(".pb")}

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, base = self.files()
        if store.get_file_info(f"{base}/_staged/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_staged/{self.run}")


class FlushSource(DataSource):
    """Rows (lane, flush, place, item) as files, one for each flush: df.write.format("flushes").option("salt", job)."""

    @classmethod
    def name(cls) -> str:
        return "flushes"

    def schema(self) -> str:
        return "lane int, flush long, place int, item binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> FlushWriter:
        return FlushWriter(self.options["path"], self.options.get("salt", ""))


def write_flushes(flushes: DataFrame, path: str, salt: str = "") -> None:
    """Writes rows (lane, flush, place, item) of encoded batches under path, a file for each flush, all or none of them."""
    flushes.sparkSession.dataSource.register(FlushSource)
    dealt = flushes.select("lane", "flush", "place", "item").repartition("lane", "flush").sortWithinPartitions("lane", "flush", "place")
    dealt.write.format("flushes").option("salt", salt).mode("append").save(path)
