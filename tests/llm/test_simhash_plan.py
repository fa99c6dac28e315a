"""How the SimHash joins are planned."""

import numpy as np

from tessera.llm import simhash


def test_probes_are_not_gathered_by_the_driver(spark, tmp_path):
    fps = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 2000).tolist()
    spark.createDataFrame([(x,) for x in fps], "fp long").write.parquet(f"file://{tmp_path}/prints")
    pairs = simhash.near_pairs(spark.read.parquet(f"file://{tmp_path}/prints"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan  # each print is 34 probes, which the optimizer's estimate of a small table leaves out
