import datetime as dt
from decimal import Decimal as D

import numpy as np
import pytest

from conftest import rows
from tesoro.operators import anomaly, forecast


def series(spark, entity, values, start=(2020, 1)):
    y, m = start
    data = []
    for i, v in enumerate(values):
        yy, mm = y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1
        data.append((entity, dt.date(yy, mm, 1), D(f"{v:.2f}")))
    return data


def mart(spark, data):
    return spark.createDataFrame(data, "entity_id bigint, month date, net_cashflow decimal(24,2)")


def test_gate_periods_and_month_ends(spark):
    data = series(spark, 1, [100 + 10 * i for i in range(24)]) + series(spark, 2, [1, 2, 3, 4, 5]) + \
        series(spark, 3, [5.0] * 6, start=(2021, 7))
    fc, rejected = forecast.forecast_refresh(mart(spark, data), periods=6)
    got = fc.collect()
    assert sorted({r["entity_id"] for r in got}) == [1, 3]
    assert rows(rejected, "entity_id", "history_months") == [(2, 5)]
    e1 = sorted((r for r in got if r["entity_id"] == 1), key=lambda r: r["month"])
    # trap 20: month ends, starting with the end of the last history month
    assert [r["month"] for r in e1] == [dt.date(2021, 12, 31), dt.date(2022, 1, 31), dt.date(2022, 2, 28),
                                         dt.date(2022, 3, 31), dt.date(2022, 4, 30), dt.date(2022, 5, 31)]
    for r in got:
        assert r["lower_bound"] <= r["predicted_net_cashflow"] <= r["upper_bound"]
        assert r["history_months"] in (24, 6)


def test_noiseless_line_is_continued():
    ds = np.array([np.datetime64(f"{2018 + i // 12}-{i % 12 + 1:02d}-01") for i in range(36)])
    y = 1000.0 + 50.0 * np.arange(36)
    future = forecast.month_ends(ds.max(), 3)
    yhat, lo, hi = forecast.fit_predict(ds, y, future)
    # the month-end points sit ~1 month past each month start: slope 50 per month
    expected = 1000.0 + 50.0 * (35 + np.array([1, 2, 3]) - 0.03)
    assert np.allclose(yhat, expected, rtol=0.02)
    assert np.all(hi - lo < 0.05 * yhat)


def test_periods_validation():
    for bad in (0, 25, 2.5, True):
        with pytest.raises(ValueError):
            forecast.validate_periods(bad)
    assert forecast.validate_periods(24) == 24


def test_forecast_independent_of_row_order_and_partitions(spark):
    data = series(spark, 1, [100 + (i % 5) * 7 for i in range(30)])
    a = rows(forecast.forecast_cashflow(mart(spark, data)))
    b = rows(forecast.forecast_cashflow(mart(spark, list(reversed(data))).repartition(7)))
    assert a == b


def test_anomalies_flag_the_extreme_month(spark):
    vals = [100, 102, 98, 101, 99, 100, 103, 97, 100, 5000, 101, 99]
    data = series(spark, 1, vals) + series(spark, 2, [7] * 12) + series(spark, 3, [1, 2, 3, 4, 5])
    out = anomaly.detect_cashflow_anomalies(mart(spark, data)).collect()
    flagged = [(r["entity_id"], r["net_cashflow"]) for r in out]
    assert (1, D("5000.00")) in flagged
    assert all(e == 1 for e, _ in flagged)              # constant series and short series: none
    assert len(flagged) <= int(np.ceil(0.1 * (len(vals) - 1)))
    assert all(r["reason"] == anomaly.ANOMALY_REASON for r in out)


def brute_path_lengths(values, limit):
    """E[h] by recursion over every split of every node."""
    def grow(points, depth):
        size = len(points)
        rest = float(anomaly.average_path_length([size])[0])
        if depth == limit or size == 1 or points[0][1] == points[-1][1]:
            return {i: depth + rest for i, _ in points}
        out = dict.fromkeys((i for i, _ in points), 0.0)
        for j in range(size - 1):
            p = (points[j + 1][1] - points[j][1]) / (points[-1][1] - points[0][1])
            if p:
                for part in (points[:j + 1], points[j + 1:]):
                    for i, h in grow(part, depth + 1).items():
                        out[i] += p * h
        return out
    found = grow(list(enumerate(values)), 0)
    return [found[i] for i in range(len(values))]


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 4.0, 9.0, 9.0, 40.0], [0.0, 0.0, 0.0], [5.0], [1.0, 2.0],
                                    [-3.0, -1.0, 0.5, 0.5, 0.5, 7.0, 7.5, 8.0]])
def test_path_lengths_are_the_expectation_over_all_trees(values):
    limit = int(np.ceil(np.log2(max(len(values), 2))))
    got = anomaly.expected_path_lengths(np.array(values))
    assert np.allclose(got, brute_path_lengths(values, limit), atol=1e-12)


def test_isolation_scores_are_ordered_at_any_length():
    v = np.array([1.0, 2.0, 3.0, 2.5, 1.5, 40.0, 2.2])
    assert np.argmin(anomaly.isolation_scores(v)) == 5
    big = np.random.default_rng(0).normal(size=400)
    big[17] = 25.0
    assert np.argmin(anomaly.isolation_scores(big)) == 17


def backtest(history):
    """Coverage of the interval and mean absolute error over that of the mean, for the
    last 6 months of every entity of the sf0.01 mart."""
    import duckdb
    from tesoro.plans.oracle import MART_CASHFLOW
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    mart_rows = con.sql("WITH " + MART_CASHFLOW + " SELECT entity_id, month, CAST(net_cashflow AS DOUBLE) AS y "
                        "FROM mart_cashflow ORDER BY 1, 2").df()
    inside, error, plain = [], 0.0, 0.0
    for _, g in mart_rows.groupby("entity_id"):
        ds, y = g["month"].to_numpy().astype("datetime64[D]"), g["y"].to_numpy()
        known = slice(-6 - history if history else None, -6)
        yhat, lo, hi = forecast.fit_predict(ds[known], y[known], ds[-6:])
        inside += list((lo <= y[-6:]) & (y[-6:] <= hi))
        error += np.abs(yhat - y[-6:]).sum()
        plain += np.abs(y[known].mean() - y[-6:]).sum()
    return np.mean(inside), error / plain


@pytest.mark.parametrize("history", [12, 18, 24, 36, None])
def test_held_out_months_lie_in_the_interval_and_near_the_forecast(history):
    coverage, ratio = backtest(history)
    assert 0.75 <= coverage <= 0.95 and ratio <= 1.1


def test_six_months_of_noise_stay_near_the_mean():
    rng = np.random.default_rng(0)
    ds = np.array([np.datetime64(f"2020-{m:02d}-01") for m in range(1, 7)])
    ahead = forecast.month_ends(ds.max(), 6)
    worst = [np.abs(forecast.fit_predict(ds, 1000 + 100 * rng.normal(size=6), ahead)[0] - 1000).max() for _ in range(100)]
    assert np.quantile(worst, 0.97) < 300


def test_a_yearly_pattern_and_a_trend_are_learned():
    rng = np.random.default_rng(1)
    ds = np.array([np.datetime64(f"{2016 + i // 12}-{i % 12 + 1:02d}-01") for i in range(72)])
    y = 500 + 20.0 * np.arange(72) + 300 * np.sin(2 * np.pi * np.arange(72) / 12) + rng.normal(0, 40, 72)
    yhat, lo, hi = forecast.fit_predict(ds[:60], y[:60], ds[60:])
    assert np.abs(yhat - y[60:]).mean() < 100 and np.mean((lo <= y[60:]) & (y[60:] <= hi)) >= 0.7


def test_spark_month_spine_matches_forecast_and_gate(spark):
    data = series(spark, 1, [100 + 10 * i for i in range(24)]) + series(spark, 2, [1, 2, 3, 4, 5])
    m = mart(spark, data)
    spine = rows(forecast.forecast_months(m), "entity_id", "month")
    fc = rows(forecast.forecast_cashflow(m), "entity_id", "month")
    assert spine == fc and len(spine) == 6
    gate = {r["entity_id"]: (r["history_months"], r["eligible"], r["reason"])
            for r in forecast.history_summary(m).collect()}
    assert gate[1] == (24, True, None)
    assert gate[2] == (5, False, forecast.SHORT_HISTORY_REASON)


def test_interval_widens_with_horizon():
    rng = np.random.default_rng(3)
    ds = np.array([np.datetime64(f"{2015 + i // 12}-{i % 12 + 1:02d}-01") for i in range(60)])
    y = 1000.0 + np.cumsum(rng.normal(0, 40, 60))
    future = forecast.month_ends(ds.max(), 24)
    yhat, lo, hi = forecast.fit_predict(ds, y, future)
    width = hi - lo
    assert np.all(np.diff(width) >= -1e-9) and width[-1] > width[0]
    assert np.all(lo <= yhat) and np.all(yhat <= hi)


def test_forecast_for_one_entity(spark):
    data = series(spark, 1, [100 + 10 * i for i in range(12)]) + series(spark, 2, [50 + i for i in range(12)])
    one = forecast.forecast_cashflow(mart(spark, data), periods=3, entity_id=2).collect()
    assert {r["entity_id"] for r in one} == {2} and len(one) == 3


def test_missing_months_are_not_fitted(spark):
    data = series(spark, 1, [100 + 10 * i for i in range(12)])
    data[4] = (1, data[4][1], None)
    got = forecast.forecast_cashflow(mart(spark, data), periods=2).collect()
    assert len(got) == 2 and all(r["predicted_net_cashflow"] == r["predicted_net_cashflow"] for r in got)
    assert {r["history_months"] for r in got} == {12}
