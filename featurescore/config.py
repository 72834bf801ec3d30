"""Configurations: which features to transform, how, and in what order; and which model to score with."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.transforms import TRANSFORMATIONS, Transformation


class ConfigError(ValueError):
    """A configuration that cannot be used; problems has every reason found."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class VectorizationConfig:
    transformations: dict[str, Transformation] = field(default_factory=dict)
    order: tuple[str, ...] = ()

    @classmethod
    def from_json(cls, text: str, strict: bool = False, checked: bool = True) -> VectorizationConfig:
        """The configuration that a JSON text spells; one with problems (or, if strict, warnings) is an error unless it is not checked."""
        try:
            raw = json.loads(text)
            out = cls({name: _transformation(name, spec) for name, spec in raw["feature_transformations"].items()}, tuple(raw["feature_order"]))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise e if isinstance(e, ConfigError) else ConfigError([f"not a vectorization config: {e!r}"]) from e
        if checked and (problems := out.problems() + (out.warnings() if strict else [])):
            raise ConfigError(problems)
        return out

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, strict: bool = False) -> VectorizationConfig:
        return cls.from_json(spark.read.text(path, wholetext=True).first().value, strict)

    def problems(self) -> list[str]:
        """Everything that makes the config unusable: of each transformation, then of the order, then of what it leaves out."""
        out = [f"{t.label} for {name}: {p}" for name, t in sorted(self.transformations.items()) for p in t.problems()]
        out += [f"Feature {name} in feature_order has no transformation" for name in self.order if name not in self.transformations]
        return out + [f"Feature {name} has a transformation but is not in feature_order" for name in sorted(set(self.transformations) - set(self.order))]

    def warnings(self) -> list[str]:
        out = [f"{t.label} for {name}: {w}" for name, t in sorted(self.transformations.items()) for w in t.warnings()]
        return out + [f"Feature {name} is in feature_order more than once" for name in sorted({n for n in self.order if self.order.count(n) > 1})]


def _transformation(name: str, spec: dict) -> Transformation:
    kind = spec.get("type")
    if kind not in TRANSFORMATIONS:
        raise ConfigError([f"Feature {name}: unknown type {kind!r}"])
    made = TRANSFORMATIONS[kind]
    names = [f.name for f in fields(made)]
    if missing := [n for n in names if n not in spec]:
        raise ConfigError([f"Feature {name}: {kind} needs {', '.join(missing)}"])
    return made.parse({n: spec[n] for n in names})


def validate_configs(configs: DataFrame, key: str = "config_id", text: str = "config") -> DataFrame:
    """Rows (key, kind, problem) of configurations stored as JSON texts in a table: kind is "problem" or "warning"."""
    rows = configs.select(key, F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            keys, kinds, texts = [], [], []
            for i, raw in enumerate(batch.column("__text").to_pylist()):
                try:
                    out = VectorizationConfig.from_json(raw or "", checked=False)
                    found = [("problem", p) for p in out.problems()] + [("warning", w) for w in out.warnings()]
                except ConfigError as e:
                    found = [("problem", p) for p in e.problems]
                for kind, said in found:
                    keys.append(i)
                    kinds.append(kind)
                    texts.append(said)
            yield pa.record_batch([batch.column(key).take(pa.array(keys, pa.int64())), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=[key, "kind", "problem"])

    return rows.mapInArrow(run, f"`{key}` {configs.schema[key].dataType.simpleString()}, kind string, problem string")


@dataclass(frozen=True)
class JobConfig:
    model_path: str
    model_id: str
    vectorization_instruction_path: str
    #: Accepted for old configurations; a Spark job has no port and no connections.
    port_number: int = 8279
    connection_concurrency: int = 50

    @classmethod
    def from_json(cls, text: str) -> JobConfig:
        try:
            raw = json.loads(text)
            out = cls(**{f.name: raw[f.name] for f in fields(cls) if f.name in raw})
        except (ValueError, TypeError) as e:
            raise ConfigError([f"not a job config: {e}"]) from e
        bad = [f.name for f in fields(cls) if not isinstance(getattr(out, f.name), int if f.name in ("port_number", "connection_concurrency") else str)]
        if bad:
            raise ConfigError([f"wrong type of {', '.join(bad)}"])
        return out
