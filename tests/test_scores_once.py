"""Scores with their AUC from one reading of the rows."""

import math

from hearthlog.operators import evaluate as e


def test_score_with_auc_sums_tied_counts_once(spark):
    data = [(k, y, p) for k in (1, 2) for y, p in
            [(0.9, 0.8), (0.2, 0.8), (0.7, 0.3), (0.1, 0.0), (1.0, 1.0), (0.4, 0.3), (None, 0.5), (0.6, None)]]
    rows = spark.createDataFrame([*data, (3, 0.9, 0.4), (3, 0.8, 0.6)], "k int, y double, p double")
    out = e.score(rows, ["k"])
    # The rows were read twice before, once for the AUC and once for the rest.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    plain = {r.k: r for r in e.score(rows, ["k"], with_auc=False).collect()}
    for r in out.collect():
        for name in ("n", "base_rate", "brier", "log_loss", "mae_frac"):
            assert math.isclose(r[name], plain[r.k][name], rel_tol=1e-12), name
        assert (r.auc is None) == (r.k == 3)
        if r.auc is not None:
            # Pairs won by (0.9, 0.8), (0.7, 0.3), (1.0, 1.0) against (0.2, 0.8), (0.1, 0.0), (0.4, 0.3), ties a half.
            assert math.isclose(r.auc, (0.5 + 1 + 1 + 0 + 1 + 0.5 + 3) / 9)
