"""Queries over a copy of the tables whose keys are far up, as in larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from featurescore.operators.scoring import OnnxScorer, score
from featurescore.plans.catalogue import ORACLES, QUERIES
from featurescore.plans.models import sigmoid_model

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["score_bad_rows", "score_onnx"])
@pytest.mark.parametrize("shift", [700_000, 1_200_000])
def test_scores_close_to_one(spark, tmp_path, name, shift):
    spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + shift).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_models_of_64_bits(spark):
    rows = spark.createDataFrame([(1, [60.0, 0.0]), (2, [-3.0, 1.0]), (3, None)], "id int, vector array<float>")
    out = {r.id: r.scores for r in score(rows, OnnxScorer(sigmoid_model(2, double=True))).collect()}
    assert out[1][0] == 1 / (1 + 2.718281828459045 ** -30.1) < 1 and abs(out[2][0] - 0.289050497374996) < 1e-12 and out[3] is None
