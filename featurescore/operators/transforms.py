"""Feature transformations as column builders: a value becomes a vector of 32-bit floats, or an error.

Each transformation accepts some alternatives of a feature value only (`ACCEPTED`); for others it gives an error. Arrays are
transformed element by element and laid end to end, so an empty array gives an empty vector. A null element is an error.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import f32, lit32, lits32, parsed32, scaled32, scaled64

#: Tables of up to this many keys are looked up in a literal map; larger ones are joined (see lookup).
LITERAL_KEYS = 64

# Error texts, names of the types and the alternatives that each accepts.
WRONG_TYPE = "Invalid data type for {}"
BAD_STRING = "Error in parsing StringValue"
BAD_STRINGS = "Error in parsing StringArray"
NULL_ELEMENT = "Null element in array"
NUMBERS = ("double_value", "float_value", "integer_value", "long_value")
ACCEPTED = {
    "embedding": ("string_value", "string_array"),
    "identity": (*NUMBERS, "string_value", "double_array", "float_array", "integer_array", "long_array", "string_array"),
    "min_max_scaling32": ("float_value", "integer_value", "float_array", "integer_array"),
    "min_max_scaling64": ("double_value", "long_value", "double_array", "long_array"),
    "one_hot_encoding": ("string_value", "string_array"),
    "standardization32": ("float_value", "integer_value", "float_array", "integer_array"),
    "standardization64": ("double_value", "long_value", "double_array", "long_array"),
}


def no_error() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Transformation(ABC):
    default_val: tuple[float, ...]
    kind: ClassVar[str] = ""
    label: ClassVar[str] = ""

    @classmethod
    def parse(cls, spec: dict) -> Transformation:
        return cls(**spec | {"default_val": tuple(map(f32, spec["default_val"]))})

    @abstractmethod
    def element(self, x: Column) -> Column:
        """The number of a single element, or its vector for lookups."""

    def problems(self) -> list[str]:
        return [] if self.default_val else ["default_val must not be empty"]

    def warnings(self) -> list[str]:
        return []

    def default(self) -> Column:
        return lits32(self.default_val)

    def build(self, x: Column, alternative: str | None) -> tuple[Column, Column]:
        """(vector, error) of values of one alternative that are not null."""
        nothing = F.lit(None).cast("array<float>")
        if alternative not in ACCEPTED.get(self.kind, (alternative,)):
            return nothing, F.lit(WRONG_TYPE.format(self.label))
        if not alternative.endswith("_array"):
            return self.scalar(x, alternative)
        vector, error = self.array(x, alternative)
        hole = F.exists(x, lambda e: e.isNull())
        return F.when(~hole, vector), F.when(hole, F.lit(NULL_ELEMENT)).otherwise(error)

    def scalar(self, x: Column, alternative: str) -> tuple[Column, Column]:
        return F.array(self.element(x)).cast("array<float>"), no_error()

    def array(self, x: Column, alternative: str) -> tuple[Column, Column]:
        return F.transform(x, self.element).cast("array<float>"), no_error()


@dataclass(frozen=True)
class Identity(Transformation):
    kind: ClassVar[str] = "identity"
    label: ClassVar[str] = "Identity"

    def element(self, x: Column) -> Column:
        return x.cast("float")

    def scalar(self, x: Column, alternative: str) -> tuple[Column, Column]:
        if alternative != "string_value":
            return super().scalar(x, alternative)
        number = parsed32(x)
        return F.when(number.isNotNull(), F.array(number)), F.when(number.isNull(), F.lit(BAD_STRING))

    def array(self, x: Column, alternative: str) -> tuple[Column, Column]:
        if alternative != "string_array":
            return super().array(x, alternative)
        bad = F.filter(x, lambda s: parsed32(s).isNull())
        return F.when(F.size(bad) == 0, F.transform(x, parsed32)), F.when(F.size(bad) > 0, F.concat(F.lit(f"{BAD_STRINGS}: "), F.array_join(bad, ", ")))


@dataclass(frozen=True)
class MinMax(Transformation):
    min: float
    max: float

    def problems(self) -> list[str]:
        return ([] if self.min < self.max else [f"min ({self.min:g}) must be less than max ({self.max:g})"]) + super().problems()


@dataclass(frozen=True)
class MinMax32(MinMax):
    kind: ClassVar[str] = "min_max_scaling32"
    label: ClassVar[str] = "MinMaxScaling32"

    @classmethod
    def parse(cls, spec: dict) -> Transformation:
        # bounds are rounded first: they may be equal then
        return super().parse(spec | {"min": f32(spec["min"]), "max": f32(spec["max"])})

    def element(self, x: Column) -> Column:
        return scaled32(x, self.min, f32(self.max - self.min))


@dataclass(frozen=True)
class MinMax64(MinMax):
    kind: ClassVar[str] = "min_max_scaling64"
    label: ClassVar[str] = "MinMaxScaling64"

    def element(self, x: Column) -> Column:
        return scaled64(x, self.min, self.max - self.min)


@dataclass(frozen=True)
class Standardize(Transformation):
    mean: float
    std_dev: float

    def problems(self) -> list[str]:
        return ([] if self.std_dev > 0 else [f"std_dev ({self.std_dev:g}) must be greater than zero"]) + super().problems()


@dataclass(frozen=True)
class Standardize32(Standardize):
    kind: ClassVar[str] = "standardization32"
    label: ClassVar[str] = "Standardization32"

    @classmethod
    def parse(cls, spec: dict) -> Transformation:
        return super().parse(spec | {"mean": f32(spec["mean"]), "std_dev": f32(spec["std_dev"])})

    def element(self, x: Column) -> Column:
        return scaled32(x, self.mean, self.std_dev)


@dataclass(frozen=True)
class Standardize64(Standardize):
    kind: ClassVar[str] = "standardization64"
    label: ClassVar[str] = "Standardization64"

    def element(self, x: Column) -> Column:
        return scaled64(x, self.mean, self.std_dev)


@dataclass(frozen=True)
class Lookup(Transformation):
    """A text is a key of a table of vectors; an unknown key gives the default."""

    @abstractmethod
    def table(self) -> dict[str, tuple[float, ...]]: ...

    def element(self, x: Column) -> Column:
        table = self.table()
        known = F.map_from_arrays(F.array(*[F.lit(k) for k in table]), F.array(*[lits32(v) for v in table.values()]))
        return F.coalesce(F.try_element_at(known, x), self.default())

    def scalar(self, x: Column, alternative: str) -> tuple[Column, Column]:
        return self.element(x), no_error()

    def array(self, x: Column, alternative: str) -> tuple[Column, Column]:
        return F.flatten(F.transform(x, self.element)), no_error()


@dataclass(frozen=True)
class Embedding(Lookup):
    embeddings: dict[str, tuple[float, ...]]
    kind: ClassVar[str] = "embedding"
    label: ClassVar[str] = "Embedding"

    @classmethod
    def parse(cls, spec: dict) -> Transformation:
        return super().parse(spec | {"embeddings": {str(k): tuple(map(f32, v)) for k, v in spec["embeddings"].items()}})

    def table(self) -> dict[str, tuple[float, ...]]:
        return self.embeddings

    def problems(self) -> list[str]:
        return ([] if self.embeddings else ["embeddings must not be empty"]) + super().problems()

    def warnings(self) -> list[str]:
        widths = {len(v) for v in self.embeddings.values()} | {len(self.default_val)}
        return [f"vectors have different lengths {sorted(widths)}"] if len(widths) > 1 else []


@dataclass(frozen=True)
class OneHot(Lookup):
    categories: tuple[str, ...]
    kind: ClassVar[str] = "one_hot_encoding"
    label: ClassVar[str] = "OneHotEncoding"

    @classmethod
    def parse(cls, spec: dict) -> Transformation:
        return super().parse(spec | {"categories": tuple(spec["categories"])})

    def table(self) -> dict[str, tuple[float, ...]]:
        n = len(self.categories)
        return {c: tuple(float(i == j) for j in range(n)) for i, c in enumerate(self.categories)}

    def problems(self) -> list[str]:
        twice = sorted({c for c in self.categories if self.categories.count(c) > 1})
        return ([] if self.categories else ["categories must not be empty"]) + ([f"categories repeat {', '.join(twice)}"] if twice else []) + super().problems()

    def warnings(self) -> list[str]:
        out = [] if list(self.categories) == sorted(self.categories, key=lambda c: c.encode()) else ["categories are not sorted"]
        return out + ([] if len(self.default_val) == len(self.categories) else [f"default_val has {len(self.default_val)} numbers for {len(self.categories)} categories"])


TRANSFORMATIONS: dict[str, type[Transformation]] = {t.kind: t for t in (Embedding, Identity, MinMax32, MinMax64, OneHot, Standardize32, Standardize64)}


def register_transformation(kind: str, made: type[Transformation]) -> None:
    """Makes a user's transformation known to configurations; its build() may return any columns, pandas UDFs too."""
    TRANSFORMATIONS[kind] = made


__all__ = ["ACCEPTED", "TRANSFORMATIONS", "Embedding", "Identity", "Lookup", "MinMax32", "MinMax64", "OneHot", "Standardize32", "Standardize64", "Transformation", "lit32", "register_transformation"]
