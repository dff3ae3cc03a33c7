"""Percentiles from counts of ranges against sorted values, also where the first cuts miss."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import quantiles
from barwright.operators.shared import stored

SHARES = {"least": 0.0, "p01": 0.01, "p05": 0.05, "half": 0.5, "p51": 0.51, "p99": 0.99, "most": 1.0}


def rows():
    rng = random.Random(5)
    groups = {"many": [rng.gauss(0, 1) for _ in range(3000)], "ties": [float(rng.randrange(3)) for _ in range(500)], "one": [4.5], "two": [1.0, 2.0], "same": [7.0] * 200, None: [rng.random() for _ in range(50)]}
    return groups, [(k, v) for k, x in groups.items() for v in x] + [("many", None), ("none", None)]


@pytest.mark.parametrize("accuracy, beside", [(10_000, 2e-4), (2, 1e-9), (50, 0.3)])
def test_percentiles_are_exact_however_rough_the_cuts(spark, monkeypatch, accuracy, beside):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "BESIDE", beside)
    groups, table = rows()
    with stored(spark.createDataFrame(table, "k string, v double")) as df:
        found = quantiles.summed_up(df, ["k"], "v", SHARES, F.count("*").alias("rows"), F.sum("v").alias("total"))
    got = {r.k: r for r in found.collect()}
    assert set(got) == {*groups, "none"} and got["none"].half is None and got["none"].rows == 1 and got["many"].rows == 3001
    for k, values in groups.items():
        assert got[k].total == pytest.approx(sum(values))
        for name, p in SHARES.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-15), (k, name)
