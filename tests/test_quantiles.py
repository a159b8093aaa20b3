"""Exact quantiles against sorting."""

import math
import random

import pytest

from rivalscope.operators.quantiles import exact_median, exact_quantile


def want(values, fraction):
    values = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not values:
        return None
    at = fraction * (len(values) - 1)
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a if at == int(at) else a + (b - a) * (at - math.floor(at))


@pytest.mark.parametrize("fraction", [0.5, 0.93])
def test_narrowing_equals_sorting(spark, fraction):
    """Small leaves force rounds: continuous, repeated, skewed, infinite and missing values; null keys; a hot group."""
    rnd = random.Random(3)
    groups = {
        "hot": [rnd.lognormvariate(0, 4) for _ in range(4_000)],
        "ties": [float(rnd.choice([1, 1, 1, 2, 7])) for _ in range(700)],
        "same": [0.25] * 300,
        "odd": [rnd.gauss(0, 1) for _ in range(301)] + [None] * 50,
        "wide": [math.inf, -math.inf] + [float(10 ** rnd.randint(-300, 300)) for _ in range(200)],
        "nan": [math.nan] * 150 + [float(i) for i in range(40)],
        "one": [5.0], "none": [None, None], None: [rnd.random() for _ in range(120)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r.q for r in exact_quantile(df, ["k"], "x", fraction, "q", leaf=20, cells=4).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        a, b = got[k], want(vs, fraction)
        assert (a is None and b is None) or (math.isnan(a) and math.isnan(b)) or a == b, (k, a, b)


def test_median_without_keys_and_of_nothing(spark):
    df = spark.range(1_001).selectExpr("cast(id as double) as x", "'z' as m")
    assert [r.med for r in exact_median(df, [], "x", "med", leaf=50).collect()] == [500.0]
    assert exact_median(df.filter("x < 0"), ["m"], "x").collect() == []
    with pytest.raises(ValueError):
        exact_quantile(df, [], "x", 1.5)
