"""Row numbers and exact ranks of values without a sorted group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: Rows of a table of offsets or cut points that is sent to every task at most; a larger one is joined by a shuffle.
SENT_GROUPS = 1 << 16
#: Cut points on either side of a wanted rank: shares of the rows that the innermost buckets hold, about.
NEAR = (0.0005, 0.005, 0.05)
#: Accuracy of the sketch that proposes cut points; exactness does not depend on it, only the length of buckets does.
ACCURACY = 10_000


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, made from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its values, row numbers among them, stay as they are."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(table: DataFrame) -> DataFrame:
    """A stored table, broadcast if it is short enough."""
    return F.broadcast(table) if table.count() <= SENT_GROUPS else table


def same_keys(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)], F.lit(True))


def number_rows(df: DataFrame, keys: list[str], order: list, out: str = "n", total: str | None = None) -> DataFrame:
    """df with the 0-based number of each row among the rows of its keys, and with total how many these are.

    Rows are sorted by ranges of (keys, order), so a key with most of the rows is spread over many tasks, and the sorted
    rows are stored once with their place. A row's number is its place less that of the first of its key in the range, plus
    the rows of the key in earlier ranges: a table with a row for each key and range. Null keys are a key; rows with equal
    order columns are numbered in any order, but those numbers stay, since they are read from the stored table. Rows
    that are equal in all order columns meet in one range, so the order should tell most rows apart.
    """
    at, part, first, rows, base, whole = unused(df, "__at", "__part", "__first", "__rows", "__base", "__whole")
    by = [*map(F.col, keys), *order]
    placed = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), "numbered")
    range_of = F.shiftright(F.col(at), 33)
    heads = placed.groupBy(*keys, range_of.alias(part)).agg(F.min(at).alias(first), F.count("*").alias(rows))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.withColumns({base: F.coalesce(F.sum(rows).over(earlier), F.lit(0)) - F.col(first), whole: F.sum(rows).over(group)})
    own = [f"{first}{i}" for i in range(len(keys))]
    offsets = sent(stored(offsets.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], part, base, whole), "offsets"))
    joined = placed.join(offsets, same_keys([placed[k] for k in keys], [offsets[o] for o in own]) & (range_of == offsets[part]))
    more = [F.col(whole).alias(total)] if total else []
    return joined.select(*[placed[c] for c in df.columns if c not in (out, total)], (F.col(at) + F.col(base)).alias(out), *more)


def index_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Rows (keys.., n, avg, a column for each share): the elements at floor(share * n) of the sorted values, 0-based.

    Exact, by selection: a sketch of each key proposes cut points close to the wanted ranks, the rows between two cut
    points are a bucket, and buckets are counted. Sums of the counts tell which bucket holds a rank and how far inside; only
    its values are sorted, with their counts. So nothing but counts and the values of those buckets is shuffled, and a key
    with most of the rows, or a value that fills most of a key, is summed up where it is read. A bad sketch makes a bucket
    long, never a result wrong. Nulls are left out; a key without values has no row; df is read three times.
    """
    cut_at = sorted({min(1.0, max(0.0, s + d)) for s in shares.values() for near in NEAR for d in (-near, near)})
    b, c, v, cuts, k = unused(df, "__bucket", "__count", "__value", "__cuts", "__key")
    own = [f"{k}{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(x).alias(o) for x, o in zip(keys, own, strict=True)], F.col(value).alias(v)).where(F.col(v).isNotNull())
    points = sent(stored(rows.groupBy(*own).agg(F.percentile_approx(v, [float(x) for x in cut_at], ACCURACY).alias(cuts)), "cut-points"))
    points = points.withColumnsRenamed({o: f"{o}p" for o in own})
    over = reduce(lambda x, y: x + y, [(F.col(v) > F.col(cuts)[i]).cast("int") for i in range(len(cut_at))])
    dealt = rows.join(points, same_keys([rows[o] for o in own], [points[f"{o}p"] for o in own])).select(*own, v, over.alias(b))
    sums = dealt.groupBy(*own, b).agg(F.count("*").alias(c), F.sum(v).alias("s"))
    group = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))
    whole = sums.withColumns({"n": F.sum(c).over(group), "avg": F.sum("s").over(group), "upto": F.coalesce(F.sum(c).over(group.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rank = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.col("n") * F.lit(float(s))).alias("rank")) for name, s in shares.items()])).alias("r")
    inside = (F.col("r.rank") >= F.col("upto")) & (F.col("r.rank") < F.col("upto") + F.col(c))
    wanted = sent(stored(whole.select(*own, b, c, "n", (F.col("avg") / F.col("n")).alias("avg"), "upto", rank).where(inside), "wanted-buckets"))
    ranks = wanted.groupBy(*own, b).agg(F.first("upto").alias("upto"), F.max("r.rank").alias("last")).withColumnsRenamed({**{o: f"{o}q" for o in own}, b: f"{b}q"})
    held = dealt.join(ranks, same_keys([dealt[o] for o in own], [ranks[f"{o}q"] for o in own]) & (dealt[b] == ranks[f"{b}q"])).select(*own, b, v, "upto")
    counted = held.groupBy(*own, b, v, "upto").agg(F.count("*").alias(c))
    end = F.sum(c).over(Window.partitionBy(*own, b).orderBy(v).rowsBetween(Window.unboundedPreceding, 0)) + F.col("upto")
    counted = counted.select(*[F.col(o).alias(f"{o}r") for o in own], F.col(b).alias(f"{b}r"), v, (end - F.col(c)).alias("lo"), end.alias("hi"))
    at = same_keys([wanted[o] for o in own], [counted[f"{o}r"] for o in own]) & (wanted[b] == counted[f"{b}r"]) & (F.col("r.rank") >= F.col("lo")) & (F.col("r.rank") < F.col("hi"))
    found = counted.join(wanted, at).select(*[F.col(o).alias(x) for o, x in zip(own, keys, strict=True)], "n", "avg", F.col("r.name").alias(k), v)
    return found.groupBy(*keys).agg(F.first("n").alias("n"), F.first("avg").alias("avg"), *[F.max(F.when(F.col(k) == name, F.col(v))).alias(name) for name in shares])
