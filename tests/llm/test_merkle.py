import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from featurescore.llm import merkle

from .sqlcheck import same

H = lambda text: hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """(root, paths of siblings) of a list of nodes."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run = runs[i // fanout]
            paths[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            at[k] = i // fanout
        nodes = [H("".join(run)) for run in runs]
    return nodes[0], paths


def brute(rows, fanout=16):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    tops = {s: climb([leaf(r) for r in t], fanout) for s, t in trees.items()}
    root, above = climb([tops[s][0] for s in sources], fanout)
    out = []
    for s, up in zip(sources, above, strict=True):
        for r, path in zip(trees[s], tops[s][1], strict=True):
            path = path + up
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], r[4] if r[4] is None else r[4].translate({c: c + 32 for c in range(65, 91)}))) if changed else leaf(r)
            for left, right in path:
                node = H(left + node + right)
            out.append((r[0], leaf(r), tops[s][0], root, H("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, fanout=None, step=None, extra=()):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    df.repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return merkle.op12_merkle_manifest(spark, path)


ROWS = [(i, f"s{i % 3}" if i % 7 else None, "en", i, f"Text Number {i}") for i in range(400)]
ODD = [(None, "s1", None, None, None), (None, "s1", None, None, ""), (5, "s0", "en", 5, "Text Number 5"), (5, "s0", "en", 5, "Text Number 5"), (900, "lone", "de", 3, "Straße"), (901, "", "en", 1, "A" * 200_000), (903, "é", None, 1, "\n")]


def test_brute_force(spark, tmp_path):
    got = run(spark, tmp_path, ROWS + ODD, extra=("n", "total", "leaf", "at"))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS + ODD)
    same(got, merkle.OP12_SQL, "/root/testdata/sf0.001", documents=f"{tmp_path}/t/documents.parquet/*.parquet")


@pytest.mark.parametrize(("fanout", "step"), [(2, 1), (2, 3), (3, 2)])
def test_deep_trees(spark, table, fanout, step):
    rows = [r for r in ROWS if r[1] != "s2"] + ODD[:-1]
    df = table([(r[1], r[0], leaf(r)) for r in rows], "source string, doc_id long, leaf string")
    out = merkle.manifest(df, "source", ["doc_id"], fanout=fanout, step=step)
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")).cast("binary"), 256).alias("p"), merkle.folded(F.col("leaf"), F.col("path")).alias("f"))
    want = [(*r[:5], r[3]) for r in brute(rows, fanout)]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)


def test_one_source_one_row_and_none(spark, tmp_path, table):
    one = run(spark, tmp_path, ROWS[1:2]).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H("")
    empty = table([("a", 1, "00")], "source string, doc_id long, leaf string").where("doc_id > 1")
    assert merkle.manifest(empty, "source", ["doc_id"]).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(merkle.op12_merkle_manifest(spark, sf), merkle.OP12_SQL, sf)
