"""Scoring of vectors: dense layers as joins and sums, networks as numpy layers or ONNX sessions in Arrow batches."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator
from typing import ClassVar, Protocol

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Scorer(Protocol):
    """A model: it takes rows of input_width numbers and gives a row of scores for each, of 32 bits unless it has a dtype float64."""

    input_width: int

    def score(self, batch: np.ndarray) -> np.ndarray: ...


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def dense_sigmoid(vector: Column, weight: float, bias: float, outputs: int) -> Column:
    """sigmoid(W x + b) with one weight and bias throughout, within generated code."""
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * weight)
    return F.array(*[sigmoid(total + bias)] * outputs)


def dense_layer(rows: DataFrame, keys: list[str], weights: DataFrame, bias: DataFrame) -> DataFrame:
    """Rows (keys.., out, z) of a dense layer over the long form (keys.., pos, value); weights (pos, out, w), bias (out, b).

    For narrow layers: it makes a row for each row, position and output. Wide ones are for Mlp, which has no shuffle.
    """
    sums = rows.join(weights, "pos").groupBy(*keys, "out").agg(F.sum(F.col("value").cast("double") * F.col("w")).alias("s"))
    return sums.join(bias, "out").select(*keys, "out", (F.col("s") + F.col("b")).alias("z"))


class Shared:
    """Files that every executor gets once, by their paths there, and what worker processes made of them, by digest.

    Nothing of a model travels in closures: a scorer that is sent to tasks holds names and digests only.
    """

    #: What this process has opened, latest last; each may be hundreds of MB, so few are kept.
    opened: ClassVar[dict[str, object]] = {}
    KEPT: ClassVar[int] = 4
    #: How often this process opened something.
    opens: ClassVar[int] = 0

    @staticmethod
    def send(spark: SparkSession, path: str) -> tuple[str, str]:
        """(name, digest) of a file, which Spark copies to each executor when a task first asks for it."""
        spark.sparkContext.addFile(path)
        name = path.rstrip("/").rpartition("/")[2]
        with open(SparkFiles.get(name), "rb") as f:
            return name, hashlib.file_digest(f, "sha256").hexdigest()

    @staticmethod
    def send_bytes(spark: SparkSession, data: bytes, suffix: str) -> tuple[str, str]:
        """As send, for bytes that the driver holds."""
        digest = hashlib.sha256(data).hexdigest()
        # Spark serves the file from here while the driver runs
        folder = tempfile.mkdtemp(prefix="spark-model-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"{digest}{suffix}")
        with open(path, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(path)
        return f"{digest}{suffix}", digest

    @classmethod
    def get(cls, name: str, digest: str, make: Callable[[str], object]) -> object:
        """make(path of the file here), once in this process while it is among the latest."""
        found = cls.opened.pop(digest, None)
        if found is None:
            found = make(SparkFiles.get(name))
            cls.opens += 1
        cls.opened[digest] = found
        while len(cls.opened) > cls.KEPT:
            cls.opened.pop(next(iter(cls.opened)))
        return found


#: Units of a layer that are multiplied at once, so that what is in memory beside the mapped weights is small.
UNIT_TILE = 1024


class Mlp:
    """Dense layers with ReLU and an affine batch norm between them; dropout is the identity when scoring.

    Layers are pairs (weights, bias) of arrays. Those of a shared network are mapped from files that each executor has
    once, so its processes share their memory, and tiles of UNIT_TILE units are multiplied one after the other.
    """

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], norms: list[tuple[np.ndarray, np.ndarray]], files: list[tuple[str, str]] | None = None, input_width: int | None = None):
        self.held, self.norms, self.files = layers, norms, files
        self.input_width = input_width if input_width is not None else layers[0][0].shape[1]

    @classmethod
    def from_table(cls, units: DataFrame, dtype: str = "float32") -> Mlp:
        """From a table with a row per unit: (layer, out, weights array, bias, scale, shift); scale is null in the last layer.

        A layer at a time comes to the driver as Arrow numbers of dtype and is sent to the executors as a file.
        """
        spark, kind = units.sparkSession, {"float32": "float", "float64": "double"}[dtype]
        last, files, norms, width = units.agg(F.max("layer")).first()[0], [], [], None
        for k in range(last + 1):
            found = units.where(F.col("layer") == k).orderBy("out").select(F.col("weights").cast(f"array<{kind}>"), *[F.col(c).cast(kind) for c in ("bias", "scale", "shift")]).toArrow()
            number = lambda c: np.nan_to_num(found[c].to_numpy().astype(dtype))  # noqa: B023, E731
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in found["weights"].chunks]
            layer = np.concatenate(flat).reshape(found.num_rows, -1)
            width = width or layer.shape[1]
            data = io.BytesIO()
            np.save(data, np.concatenate([layer, number("bias")[:, None]], axis=1))
            files.append(Shared.send_bytes(spark, data.getvalue(), ".npy"))
            if k < last:
                norms.append((number("scale"), number("shift")))
        return cls([], norms, files, width)

    def layer(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.files is None:
            return self.held[k]
        whole = Shared.get(*self.files[k], lambda path: np.load(path, mmap_mode="r"))
        return whole[:, :-1], whole[:, -1]

    @property
    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.layer(k) for k in range(len(self.held if self.files is None else self.files))]

    def score(self, batch: np.ndarray) -> np.ndarray:
        n = len(self.held if self.files is None else self.files)
        Shared.KEPT = max(Shared.KEPT, n)
        for i in range(n):
            w, b = self.layer(i)
            batch = np.asarray(batch, dtype=w.dtype)
            out = np.empty((len(batch), len(w)), dtype=w.dtype)
            for lo in range(0, len(w), UNIT_TILE):
                out[:, lo : lo + UNIT_TILE] = batch @ w[lo : lo + UNIT_TILE].T + b[lo : lo + UNIT_TILE]
            batch = out
            if i < len(self.norms):
                scale, shift = self.norms[i]
                batch = np.maximum(batch, 0) * scale + shift
        return batch


def _session(model: str | bytes):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])


class OnnxScorer:
    """An ONNX model of 32-bit or 64-bit numbers; a worker process opens its session once, whatever the number of its tasks."""

    def __init__(self, model: bytes | None = None, shared: tuple[str, str] | None = None):
        """From bytes that the driver holds, or from a file that Shared has sent."""
        self.name, self.digest = shared or Shared.send_bytes(SparkSession.active(), model, ".onnx")
        width = self.session().get_inputs()[0].shape[1]
        if not isinstance(width, int):
            raise ValueError("the model's input has no fixed width")
        self.input_width = width
        double = lambda ports: np.float64 if ports[0].type == "tensor(double)" else np.float32
        self.takes, self.dtype = double(self.session().get_inputs()), double(self.session().get_outputs())

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, fmt: str | None = None) -> OnnxScorer:
        """From a model file that Spark can read, or, with fmt, from a table with the model's bytes in the column content."""
        if fmt is None:
            return cls(shared=Shared.send(spark, path))
        return cls(bytes(spark.read.format(fmt).load(path).select("content").first().content))

    def session(self):
        return Shared.get(self.name, self.digest, _session)

    def score(self, batch: np.ndarray) -> np.ndarray:
        s = self.session()
        out = s.run([s.get_outputs()[0].name], {s.get_inputs()[0].name: batch.astype(self.takes)})[0]
        if out.ndim != 2:
            raise ValueError(f"the model's output has {out.ndim} dimensions, not 2")
        return out


#: Columns of micros that score() gives.
TIMINGS = ("vec_micros", "tensor_micros", "infer_micros")


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the given width, which rows these are)."""
    good = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width
    return column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(int(good.sum()), width), good


def _sparse_matrix(column: pa.StructArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from structs (size, positions, values)."""
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.field("size").fill_null(-1).to_numpy(zero_copy_only=False), -1)
    good = size == width
    some = column.filter(pa.array(good))
    x = np.zeros((len(some), width), dtype=np.float32)
    row = np.repeat(np.arange(len(some)), some.field("positions").value_lengths().to_numpy(zero_copy_only=False))
    x[row, some.field("positions").flatten().to_numpy(zero_copy_only=False)] = some.field("values").flatten().to_numpy(zero_copy_only=False)
    return x, good


def score(df: DataFrame, scorer: Scorer, vector: str = "vector", timings: bool = False) -> DataFrame:
    """df with scores (array<float>, or array<double> of a scorer whose dtype is float64), and with timings the micros of each Arrow batch: until its vectors were there, for its
    matrix, and for the model.

    Only the vectors go to Python. Rows without a vector, and rows with one of another width than the model's, get null
    scores; the others of their batch are scored. Where df has a column error, it says so for a wrong width. A null number
    in a vector is scored as NaN. The vector may be sparse (see vectorize_sparse).
    """
    sparse = isinstance(df.schema[vector].dataType, T.StructType)
    dtype = np.dtype(getattr(scorer, "dtype", np.float32))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ended = time.perf_counter_ns()
        for column in columns:
            t0 = time.perf_counter_ns()
            x, good = (_sparse_matrix if sparse else _matrix)(column, scorer.input_width)
            t1 = time.perf_counter_ns()
            out = np.asarray(scorer.score(x), dtype=dtype) if len(x) else np.zeros((0, 0), dtype=dtype)
            t2 = time.perf_counter_ns()
            ends = np.concatenate([[0], np.cumsum(good * out.shape[1])])
            scores = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out.ravel()), mask=pa.array(~good))
            micros = [pa.array(np.full(len(column), t // 1000, dtype=np.int64)) for t in (t0 - ended, t1 - t0, t2 - t1)]
            yield pa.StructArray.from_arrays([scores, *micros], names=["scores", *TIMINGS])
            ended = time.perf_counter_ns()

    made = F.arrow_udf(run, f"struct<scores:array<{'double' if dtype == np.float64 else 'float'}>,{','.join(f'{c}:long' for c in TIMINGS)}>")(F.col(vector))
    out = df.withColumn("__scored", made)
    out = out.withColumns({c: F.col(f"__scored.{c}") for c in ("scores", *(TIMINGS if timings else ()))}).drop("__scored")
    if "error" in df.columns:
        width = F.col(vector)["size"] if sparse else F.size(vector)
        wrong = F.when(F.col(vector).isNotNull() & (width != scorer.input_width), F.concat(F.lit(f"Expected feature vector length {scorer.input_width} but got "), width.cast("string")))
        out = out.withColumn("error", F.coalesce("error", wrong))
    return out
