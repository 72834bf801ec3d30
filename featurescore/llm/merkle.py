"""A Merkle manifest of a dataset: a digest of every row, a tree for each source, a tree of the sources, and proofs.

Checkpoint and recompute. Leaves are numbered in their order and stored; of the levels above, only every `STEP`-th is
stored, so a stored node stands for an aligned subtree of FANOUT ** STEP nodes of the stored level below. Proofs come
from the top down: the missing nodes of each aligned subtree are made again from its stored descendants, the siblings of
every node on the way are put before the proof of the subtree's own node, and what was made again is dropped. No task
holds more than one subtree of FANOUT ** STEP nodes at a time, and a source of any size is many subtrees.

Defined results: a null value counts as `-` in a leaf, and an empty text as `0:`; a null source is a source of its own and
comes first; leaves of a source ascend by id (null ids first), equal ids by their digest, and rows that are equal
throughout have equal leaves, but proofs of their own places; a lone leaf is the root of its source and has no siblings
there; an empty table gives no rows. Only the columns that make a leaf are read: others neither clash nor change a digest.
A text of any length is hashed as a whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import number_rows
from .common import discard, materialise

#: Children of a node.
FANOUT = 16
#: Levels from one stored level to the next.
STEP = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values, each as its UTF-8 length, a colon and itself, or as `-`."""
    framed = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def _run_hash(nodes: Column, fanout: int):
    """The node above the run of a number."""
    return lambda run: _hash(F.slice(nodes, run * fanout + 1, F.lit(fanout)))


def _joined(nodes: Column, first: Column, n: Column) -> Column:
    """n nodes from the 0-based place first on, end to end."""
    return F.array_join(F.slice(nodes, first + 1, n), "")


def _with_levels(trees: DataFrame, fanout: int, step: int) -> DataFrame:
    """trees with level0, total0 and so on: the nodes (hex) of a subtree and of its whole level, up to the next stored level.

    A level that is a single node is its own next level.
    """
    out = trees.withColumn("level0", F.transform("nodes", lambda x: F.lower(F.hex(x["digest"])))).withColumn("total0", F.col("total"))
    for k in range(step):
        nodes, n = F.col(f"level{k}"), F.col(f"total{k}")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int")), _run_hash(nodes, fanout))
        out = out.withColumn(f"level{k + 1}", F.when(n > 1, runs).otherwise(nodes)).withColumn(f"total{k + 1}", F.ceil(n / fanout).cast("long"))
    return out


def _siblings(nodes: Column, total: Column, place: Column, fanout: int) -> Column:
    """What stands left and right of a node in its run, as an array of one entry, or of none where the level is one node."""
    first = place - place % fanout
    right = F.least(first + fanout, F.size(nodes)) - place - 1
    entry = F.struct(_joined(nodes, first, place - first).alias("left"), _joined(nodes, place + 1, right).alias("right"))
    return F.when(total > 1, F.array(entry)).otherwise(F.array().cast(_PATH))


def _subtrees(nodes: DataFrame, keys: list[str], fanout: int, step: int) -> DataFrame:
    """Rows (keys.., sub, total, nodes): the nodes of each aligned subtree in order, with the columns they have beside n and total."""
    span = fanout**step
    more = [c for c in nodes.columns if c not in (*keys, "n", "total")]
    packed = F.struct((F.col("n") % span).cast("int").alias("place"), *more)
    return nodes.groupBy(*keys, F.floor(F.col("n") / span).alias("sub"), "total").agg(F.array_sort(F.collect_list(packed)).alias("nodes"))


def stored_levels(leaves: DataFrame, keys: list[str], fanout: int = FANOUT, step: int = STEP) -> list[DataFrame]:
    """The stored levels of the tree of each key, leaves first; the last has one node for each key.

    leaves has (keys.., n, total, digest): the 0-based number of a leaf, the leaves of its key, and its digest as 32 bytes.
    """
    most = leaves.agg(F.max("total")).first()[0] or 1
    levels = [leaves]
    while most > 1:
        below = _subtrees(levels[-1].select(*keys, "n", "total", "digest"), keys, fanout, step)
        top = _with_levels(below, fanout, step).select(*keys, F.col("sub").alias("n"), F.col(f"total{step}").alias("total"), F.unhex(F.col(f"level{step}")[0]).alias("digest"))
        levels.append(materialise(top, "merkle-level"))
        most = -(-most // fanout**step)
    return levels


def extend_paths(nodes: DataFrame, keys: list[str], above: DataFrame, fanout: int = FANOUT, step: int = STEP) -> DataFrame:
    """The nodes of a stored level with path: the siblings of each level up to the root as (left, right), nearest first.

    above has (keys.., n, path) of the next stored level. Nodes of a subtree share the path of their common node, so paths
    are joined to subtrees, not to nodes.
    """
    more = [c for c in nodes.columns if c not in (*keys, "n", "total")]
    extra = [c for c in above.columns if c not in (*keys, "n", "path")]
    met = _with_levels(_subtrees(nodes, keys, fanout, step).join(above.withColumnsRenamed({"n": "sub", "path": "above"}), [*keys, "sub"]), fanout, step)

    def path(place: Column) -> Column:
        steps = [_siblings(F.col(f"level{k}"), F.col(f"total{k}"), F.floor(place / fanout**k).cast("int"), fanout) for k in range(step)]
        return F.concat(*steps, F.col("above"))

    # a place in the array is a node's place in its subtree: subtrees are aligned, and none has a gap
    each = F.explode(F.transform("nodes", lambda x: F.struct(x.alias("node"), path(x["place"]).alias("path")))).alias("x")
    rows = met.select(*keys, "sub", "total", *extra, each)
    return rows.select(*keys, (F.col("sub") * fanout**step + F.col("x.node.place")).alias("n"), "total", *[F.col(f"x.node.{c}").alias(c) for c in more], *extra, F.col("x.path").alias("path"))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def manifest(rows: DataFrame, key: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT, step: int = STEP) -> DataFrame:
    """rows (key, order.., leaf as hex, and more) with subroot, root and path, a proof as rows of siblings.

    key tells the trees of the first kind apart; their roots, by key with null first, are the leaves of the second.
    """
    if clash := [c for c in rows.columns if c in ("at", "n", "total", "digest", "path", "place", "sub", "subroot", "root") and c != key]:
        raise ValueError(f"columns of rows have names of the result: {clash}")
    # a null key is less than any other: keys are texts that begin with a sign, and the null one is empty
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("at"), *[c for c in rows.columns if c not in (key, leaf)], F.unhex(leaf).alias("digest"))
    leaves = number_rows(named, ["at"], [*[F.col(c) for c in order], F.col("digest")], "n", "total")
    levels = stored_levels(leaves, ["at"], fanout, step)
    tops = number_rows(levels[-1].select("at", "digest"), [], [F.col("at")], "n", "total").withColumn("tree", F.lit(0))
    upper = stored_levels(tops, ["tree"], fanout, step)
    root = upper[-1].select("tree", F.lit(0).cast("long").alias("n"), F.lower(F.hex("digest")).alias("root"), F.array().cast(_PATH).alias("path"))
    for nodes in reversed(upper[:-1]):
        root = extend_paths(nodes, ["tree"], root, fanout, step)
        root = root if nodes is upper[0] else root.select("tree", "n", "root", "path")
    if len(upper) == 1:
        root = root.join(upper[0].select("tree", "at", "digest"), "tree")
    above = materialise(root.select("at", F.lit(0).cast("long").alias("n"), F.lower(F.hex("digest")).alias("subroot"), "root", "path"), "merkle-paths")
    for nodes in reversed(levels[1:-1]):
        lower = materialise(extend_paths(nodes.select("at", "n", "total", "digest"), ["at"], above, fanout, step).select("at", "n", "subroot", "root", "path"), "merkle-paths")
        discard(above)
        above = lower
    out = extend_paths(levels[0], ["at"], above, fanout, step) if len(levels) > 1 else levels[0].join(above.drop("n"), "at")
    back = F.when(F.col("at") != "", F.expr("substring(at, 2)")).alias(key)
    return out.select(back, *[c for c in rows.columns if c not in (key, leaf)], F.lower(F.hex("digest")).alias(leaf), "subroot", "root", "path")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = digest(*[F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    rows = docs.select("source", "doc_id", digest(*[F.col(c) for c in FIELDS]).alias("leaf"), F.when(changed, F.unhex(lowered)).alias("tampered"))
    out = manifest(rows, "source", ["doc_id"])
    again = folded(F.coalesce(F.lower(F.hex("tampered")), F.col("leaf")), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """SQL with a level for each power of 16: six for documents of a source, three for sources."""
    framed = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
    lowered = framed.replace("text", f"translate(text, '{UPPER}', '{LOWER}')")
    bits = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT), xor(a, c))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::UBIGINT), lambda a, c: {bits}, 4294967295::UBIGINT), 4294967295::UBIGINT)"
    sql = f"WITH d AS (SELECT doc_id, source, sha256({framed}) AS leaf, CASE WHEN ({crc}) % 5 = 0 THEN sha256({lowered}) END AS other FROM documents),\n"
    sql += "t0 AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS i, leaf AS h FROM d),\n"
    sql += "numbered AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS i FROM d),\n"

    def whole(t: str, key: str, depth: int) -> str:
        # n of a level is its number of nodes
        out = ""
        for k in range(depth):
            out += f"{t}r{k} AS (SELECT {key}, i // {FANOUT} AS i, string_agg(h, '' ORDER BY i) AS run, (sum(count(*)) OVER (PARTITION BY {key}))::BIGINT AS n FROM {t}{k} GROUP BY {key}, i // {FANOUT}),\n"
            out += f"{t}{k + 1} AS (SELECT {key}, i, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h FROM {t}r{k}),\n"
        return out

    def climb(t: str, key: str, depth: int, first: str, kept: str) -> str:
        """A row of first (key, i, proof, node) goes up level by level; first names the table at the start."""
        out, at = "", first
        for k in range(depth):
            run, place = "r.run", f"(a.j % {FANOUT})"
            left, right = f"substring({run}, 1, 64 * {place})", f"substring({run}, 64 * {place} + 65)"
            out += (
                f"{first}{k} AS (SELECT {kept}, a.j // {FANOUT} AS j, CASE WHEN r.n > 1 THEN a.proof || {left} || {right} ELSE a.proof END AS proof, "
                f"CASE WHEN r.n > 1 THEN sha256({left} || a.node || {right}) ELSE a.node END AS node FROM {at} AS a JOIN {t}r{k} AS r ON a.{key} IS NOT DISTINCT FROM r.{key} AND a.j // {FANOUT} = r.i),\n"
            )
            at = f"{first}{k}"
        return out

    depth, wide = 6, 3
    sql += whole("t", "source", depth)
    sql += f"s0 AS (SELECT 0 AS one, (row_number() OVER (ORDER BY source NULLS FIRST) - 1)::BIGINT AS i, h, source FROM t{depth}),\n"
    sql += whole("s", "one", wide)
    sql += "a AS (SELECT doc_id, source, leaf, i AS j, '' AS proof, coalesce(other, leaf) AS node FROM numbered),\n"
    sql += climb("t", "source", depth, "a", "a.doc_id, a.source, a.leaf")
    sql += f"b AS (SELECT a.doc_id, a.leaf, s0.h AS subroot, 0 AS one, s0.i AS j, a.proof, a.node FROM a{depth - 1} AS a JOIN s0 ON a.source IS NOT DISTINCT FROM s0.source),\n"
    sql += climb("s", "one", wide, "b", "a.doc_id, a.leaf, a.subroot, a.one")
    return sql + f"o AS (SELECT b.doc_id, b.leaf, b.subroot, s.h AS root, sha256(b.proof) AS proof_sha256, b.node AS folded_root FROM b{wide - 1} AS b, s{wide} AS s)\nSELECT *, folded_root = root AS verified FROM o"


OP12_SQL = _sql()
