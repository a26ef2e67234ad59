import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from sitegauge.operators import normalize as norm


def run(spark, values, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r.x for r in norm.normalize(df, ["x"], **options).orderBy("i").collect()]


def test_examples(spark):
    assert run(spark, [1.0, 2.0]) == pytest.approx([100 / 3, 200 / 3])
    assert run(spark, [5.0, None, None]) == [5.0, 50.0, 50.0]
    assert run(spark, [4.0, 4.0, 4.0]) == [None, None, None]
    assert run(spark, [None, None]) == [50.0, 50.0]
    assert run(spark, [5.0, None], fill_too_few=False) == [5.0, None]


def test_nulls_stay_unknown(spark):
    got = run(spark, [1.0, None, 3.0, 2.0])
    assert got[1] is None and got[3] == pytest.approx(50.0)


def test_heavy_skew_uses_percentiles(spark):
    values = [1.0, 2.0, 2.0, 3.0, 1000.0, None, 4.0, 5.0, 6.0, 7.0]
    want = (pd.Series(values, dtype=float).rank(pct=True) * 100).tolist()
    got = run(spark, values)
    assert got[5] is None
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if not np.isnan(w)])


def test_inverted(spark):
    plain, turned = run(spark, [1.0, 2.0, 4.0]), run(spark, [1.0, 2.0, 4.0], inverted=["x"])
    assert turned == pytest.approx([100 - v for v in plain])


def test_table_skips_identifiers_and_sparse_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0, None), ("b", 2.0, 5.0, 7.0)],
                               "county_fips string, lat double, f double, g double")
    got = norm.normalize_table(df).orderBy("county_fips").collect()
    assert [r.lat for r in got] == [1.0, 2.0]
    assert [r.g for r in got] == [None, 7.0]
    assert [r.f for r in got] == pytest.approx([100 / 3, 200 / 3])


def reference_form(values):
    s = pd.Series(values, dtype=float)
    known = s.dropna()
    if len(known) < 2:
        return s.fillna(50.0)
    if abs(known.skew()) > 2:
        return s.rank(pct=True) * 100
    spread = known.std(ddof=0)
    return ((((s - known.mean()) / spread).clip(-3, 3) + 3) / 6 * 100) if spread else s * np.nan


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float), st.just(4000.0)), min_size=1, max_size=30))
def test_against_pandas(spark, values):
    got = pd.Series(run(spark, values), dtype=float)
    assert np.allclose(got, reference_form(values), equal_nan=True, atol=1e-8)
