"""Rows of features to vectors: wide tables (a typed column per feature), maps of typed values, and a long form.

Each feature's value is a column of its own below the vector, and the vector is one below its checks, so that no
expression is copied into another: the plan grows with the number of features and of the alternatives that each accepts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ConfigError, VectorizationConfig
from ..types import FIELDS, field_of
from .lookup import array_lookup, dictionary, lookup_join, sent_lookup
from .transforms import ACCEPTED, LITERAL_KEYS, NULL_ELEMENT, WRONG_TYPE, Embedding, Lookup, MinMax64, OneHot, Standardize64, Transformation


def _large(t: Transformation) -> bool:
    """A table that is probed by a join, not searched in every row."""
    return isinstance(t, Lookup) and len(t.table()) > LITERAL_KEYS


def _probed(found: Column, x: Column, field: str) -> tuple[Column, Column]:
    """(vector, error) of a value whose vector a join gave."""
    hole = F.exists(x, lambda e: e.isNull()) if field == "string_array" else F.lit(False)
    return found, F.when(hole, F.lit(NULL_ELEMENT))


def _from_map(t: Transformation, v: Column, found: dict[str, Column]) -> tuple[Column, Column]:
    """(vector, error) of a value of any alternative; found has the vectors that a join gave for some of them."""
    vector, error = t.default(), F.lit(None).cast("string")
    refused = F.lit(False)
    for name in reversed(FIELDS):
        there = v[name].isNotNull()
        if name not in ACCEPTED.get(t.kind, FIELDS):
            # alternatives in a row that are refused make one case
            refused = there | refused
            continue
        own, wrong = t.build(v[name], name) if name not in found else _probed(found[name], v[name], name)
        vector, error = F.when(refused, F.lit(None)).otherwise(vector), F.when(refused, F.lit(WRONG_TYPE.format(t.label))).otherwise(error)
        vector, error, refused = F.when(there, own).otherwise(vector), F.when(there, wrong).otherwise(error), F.lit(False)
    return F.when(refused, F.lit(None)).otherwise(vector), F.when(refused, F.lit(WRONG_TYPE.format(t.label))).otherwise(error)


def _parts(df: DataFrame, config: VectorizationConfig, features: str | None) -> tuple[DataFrame, list[Column], list[Column]]:
    """df with what the features need, and the vector and the error of each feature of the order."""
    if problems := config.problems():
        raise ConfigError(problems)
    rows, values = df, {}
    for i, name in enumerate(config.order):
        if features:
            values[name] = f"__value{i}"
            rows = rows.withColumn(f"__value{i}", F.try_element_at(F.col(features), F.lit(name)))
        elif name in df.columns:
            if field_of(df.schema[name].dataType) is None:
                raise TypeError(f"column {name} has the type {df.schema[name].dataType.simpleString()}, which no feature value holds")
            values[name] = name
    found: dict[str, dict[str, Column]] = {}
    for i, name in enumerate(config.order):
        t = config.transformations[name]
        if name not in values or not _large(t) or name in found:
            continue
        held = {"string_value": F.col(values[name])["string_value"], "string_array": F.col(values[name])["string_array"]} if features else {field_of(df.schema[name].dataType): F.col(name)}
        found[name] = {}
        for field in ("string_value", "string_array"):
            if field in held:
                sent = sent_lookup(df.sparkSession, t, held[field]) if field == "string_array" else None
                if sent is not None:
                    rows = rows.withColumn(f"__{field}{i}", sent)
                else:
                    join = lookup_join if field == "string_value" else array_lookup
                    rows = join(rows, held[field], dictionary(df.sparkSession, t), t.default(), f"__{field}{i}")
                found[name][field] = F.col(f"__{field}{i}")
    vectors, errors = [], []
    for name in config.order:
        t = config.transformations[name]
        if name not in values:
            vectors.append(t.default())
            continue
        v = F.col(values[name])
        if features:
            vector, error = _from_map(t, v, found.get(name, {}))
        else:
            field = field_of(df.schema[name].dataType)
            vector, error = _probed(found[name][field], v, field) if field in found.get(name, {}) else t.build(v, field)
            vector, error = F.when(v.isNotNull(), vector).otherwise(t.default()), F.when(v.isNotNull(), error)
        vectors.append(vector)
        errors.append(error)
    return rows, vectors, errors


def _checked(out: DataFrame, length: Column, expected_len: int | None, mode: str) -> DataFrame:
    if expected_len is not None:
        wrong = F.when(F.col("error").isNull() & (length != expected_len), F.concat(F.lit(f"Expected feature vector length {expected_len} but got "), length.cast("string")))
        out = out.withColumn("error", F.coalesce("error", wrong))
    if mode == "failfast":
        return out.withColumn("vector", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast(out.schema["vector"].dataType)).otherwise(F.col("vector")))
    return out.withColumn("vector", F.when(F.col("error").isNull(), F.col("vector")))


def vectorize(df: DataFrame, config: VectorizationConfig, expected_len: int | None = None, features: str | None = None, mode: str = "permissive") -> DataFrame:
    """df with vector (array<float>) and error (text, null if all is well; the first of feature_order, then a wrong length).

    features names a column map<string, feature value>; without it each feature is the column of its name, and an
    unknown column is a missing feature. Missing and null values give the default as it stands. Features outside the
    order are not read. mode "failfast" raises the error in place of returning it. Single keys are joined with tables of many
    keys; keys in arrays are looked up in a table that every executor has (sent_lookup), on streams too. Only where such a
    table is too large for that, df is read twice and must give the same rows in the same order (a stored table does).
    """
    kept = [c for c in df.columns if c not in ("vector", "error")]
    rows, vectors, errors = _parts(df, config, features)
    whole = F.concat(*vectors).cast("array<float>") if vectors else F.array().cast("array<float>")
    out = rows.select(*kept, whole.alias("vector"), F.coalesce(*errors, F.lit(None).cast("string")).alias("error"))
    return _checked(out, F.size("vector"), expected_len, mode)


class _Place(Embedding):
    """The place of a text among the categories of a one-hot feature; -1 for others."""

    label = OneHot.label


def _entries(t: OneHot | None, vector: Column, offset: Column) -> Column:
    """Entries (pos, value) of a feature that begins at offset: what is not zero. With t the vector has places of its categories."""
    entry = lambda pos, value: F.struct(pos.cast("int").alias("pos"), value.cast("float").alias("value"))
    if t is None:
        return F.filter(F.transform(vector, lambda x, i: entry(offset + i, x)), lambda e: e["value"] != 0)
    width = len(t.categories)
    other = [(j, d) for j, d in enumerate(t.default_val) if d]

    def one(x: Column, i: Column) -> Column:
        base = offset + i * width
        unknown = F.array(*[entry(base + j, F.lit(d)) for j, d in other]).cast("array<struct<pos:int,value:float>>")
        return F.when(x >= 0, F.array(entry(base + x.cast("int"), F.lit(1.0)))).otherwise(unknown)

    return F.flatten(F.transform(vector, one))


def vectorize_sparse(df: DataFrame, config: VectorizationConfig, expected_len: int | None = None, features: str | None = None, mode: str = "permissive") -> DataFrame:
    """As vectorize, with vector as a struct (size, positions, values) of the numbers that are not zero, by position.

    A one-hot text is one entry, and no vector of its categories is made for it.
    """
    kept = [c for c in df.columns if c not in ("vector", "error")]
    short = {}
    for name, t in config.transformations.items():
        narrow = isinstance(t, OneHot) and len(t.default_val) == len(t.categories)
        short[name] = _Place((-1.0,), {c: (float(i),) for i, c in enumerate(t.categories)}) if narrow else t
    rows, vectors, errors = _parts(df, VectorizationConfig(short, config.order), features)
    # each vector is a column of its own, since its entries and its size are used apart
    rows = rows.select(*kept, *[v.cast("array<float>").alias(f"__part{i}") for i, v in enumerate(vectors)], F.coalesce(*errors, F.lit(None).cast("string")).alias("error"))
    offset, found = F.lit(0), []
    for i, name in enumerate(config.order):
        t, part = config.transformations[name], F.col(f"__part{i}")
        placed = isinstance(short[name], _Place)
        found.append(_entries(t if placed else None, part, offset))
        offset = offset + F.size(part) * (len(t.categories) if placed else 1)
    entries = F.flatten(F.array(*found)) if found else F.array().cast("array<struct<pos:int,value:float>>")
    out = rows.select(*kept, "error", offset.alias("__size"), entries.alias("__entries"))
    vector = F.struct(F.col("__size").alias("size"), F.col("__entries.pos").alias("positions"), F.col("__entries.value").alias("values"))
    return _checked(out.select(*kept, vector.alias("vector"), "error"), F.col("vector.size"), expected_len, mode)


def long_form(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Rows (keys.., pos, value) of sparse vectors: an entry for each number that is not zero. Rows without a vector have none."""
    rows = df.select(*keys, F.explode_outer(F.arrays_zip(F.col(vector)["positions"].alias("pos"), F.col(vector)["values"].alias("value"))).alias("e"))
    return rows.where("e is not null").select(*keys, F.col("e.pos").alias("pos"), F.col("e.value").alias("value"))


def dense(vector: Column) -> Column:
    """A sparse vector as an array."""
    at = F.map_from_arrays(vector["positions"], vector["values"])
    return F.when(vector["size"] == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), vector["size"] - 1), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0).cast("float"))))


def vectorize_long(df: DataFrame, keys: list[str], config: VectorizationConfig) -> DataFrame:
    """Rows (keys.., pos, value) for configurations of 64-bit scalings only: features are unpivoted and joined with their parameters."""
    rows = []
    for pos, name in enumerate(config.order):
        t = config.transformations[name]
        if not isinstance(t, (MinMax64, Standardize64)):
            raise ConfigError([f"{name}: the long form takes 64-bit scalings only"])
        shift, scale = (t.min, t.max - t.min) if isinstance(t, MinMax64) else (t.mean, t.std_dev)
        rows.append((name, pos, float(shift), float(scale), t.default_val[0]))
    params = df.sparkSession.createDataFrame(rows, "feature string, pos int, shift double, scale double, dflt double")
    names = list(dict.fromkeys(config.order))
    long = df.select(*keys, *[F.col(n).cast("double") for n in names]).unpivot(keys, names, "feature", "x")
    # one row per feature of the configuration, so the broadcast is bounded by it
    return long.join(F.broadcast(params), "feature").select(*keys, "pos", F.coalesce(((F.col("x") - F.col("shift")) / F.col("scale")).cast("float"), F.col("dflt").cast("float")).alias("value"))
