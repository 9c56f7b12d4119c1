"""Rows meet the means of their labels without a shuffle."""

from __future__ import annotations

from heddle.operators import evaluate as E


def test_rows_stay_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(0, k % 3, f"c{k}", f"d{k % 4}", f"t{k % 2}", float(k)) for k in range(24)], "repeat int, fold int, cell string, drug string, disease string, y double")
        for out in (E.drug_mean(df, "y", "drug", "fold", ["repeat"]), E.residual(df, "y", "drug", "fold", ["repeat"], "disease"), E.tissue_oracle(df, "y", "cell", "drug", "disease", "fold", ["repeat"]), E.leave_fold_out(df, "y", "fold", [], "p", ["repeat"])):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
            assert out.count() == 24
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
