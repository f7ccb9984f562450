"""Cash-flow forecast F1/F2 with the minimum-history gate P11 and month-end
steps X13.

One Spark job forecasts every entity: the monthly mart (one row per entity and
month, so a group is bounded by the calendar, not by the raw data volume) is
grouped by entity and each series is fitted in ``applyInPandas``.

The model follows the decomposable form of Taylor & Letham (2018), "Forecasting
at scale": y scaled by max|y|, time scaled to [0, 1], a piecewise-linear trend
with up to 25 changepoints in the first 80 % of the history and, from two years
of history on, yearly seasonality as a Fourier series of the orders that monthly
points tell apart. Slope, trend changes and seasonality have normal priors whose
variances, and that of the noise, are set by maximum evidence (MacKay 1992), so a
component that the series doesn't show shrinks away and the noise is judged on the
effective degrees of freedom. The interval is that of the predictive Student
distribution: noise, parameter uncertainty and future trend changes; it never
narrows with the horizon.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesoro.session import ship_package

# Minimum history, default horizon and interval width of the
# reference's forecast, and its rejection message.
MIN_HISTORY_MONTHS = 6
DEFAULT_PERIODS = 6
INTERVAL_WIDTH = 0.85
SHORT_HISTORY_REASON = "Need at least 6 months of history to forecast reliably."
_Z = 1.4395314709384563          # two-sided 85 % normal quantile
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_ORDER = 5                 # higher orders alias on monthly points
MIN_SEASONAL_DAYS = 730
YEAR_DAYS = 365.25
EVIDENCE_STEPS = 200
# Weights of size zero that each component is taken to have besides its own: a few
# months of noise don't pass for a slope.
SHRINKAGE = 2.0

FORECAST_COLUMNS = ("month date, predicted_net_cashflow double, lower_bound double, "
                    "upper_bound double, history_months int")


def _schema(df: DataFrame) -> str:
    return f"entity_id {df.schema['entity_id'].dataType.simpleString()}, {FORECAST_COLUMNS}"


def validate_periods(periods: int) -> int:
    """Horizon 1..24 months (default 6)."""
    if isinstance(periods, bool) or not isinstance(periods, int) or not 1 <= periods <= 24:
        raise ValueError("periods_months must be an integer between 1 and 24")
    return periods


def _fourier(days: np.ndarray) -> np.ndarray:
    k = np.arange(1, YEARLY_ORDER + 1)
    ang = 2.0 * np.pi * days[:, None] * k[None, :] / YEAR_DAYS
    return np.concatenate([np.sin(ang), np.cos(ang)], axis=1)


def _student_quantile(freedom: float) -> float:
    """Two-sided 85 % quantile of Student's t (Cornish-Fisher expansion)."""
    z, v = _Z, max(freedom, 1.0)
    return z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2) + (
        3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3)


def fit_predict(ds: np.ndarray, y: np.ndarray, future: np.ndarray):
    """Fit on (ds, y) and return (yhat, lower, upper) at ``future``.

    ``ds``/``future`` are datetime64[D]; ``y`` float. Pure numpy, deterministic.
    """
    order = np.argsort(ds)
    ds, y = ds[order], y[order].astype(float)
    n = len(y)
    start = ds[0]
    span = float((ds[-1] - start) / np.timedelta64(1, "D")) or 1.0
    scale = float(np.max(np.abs(y))) or 1.0

    def t_of(d):
        return ((d - start) / np.timedelta64(1, "D")).astype(float) / span

    t = t_of(ds)
    hist = int(np.floor(n * CHANGEPOINT_RANGE))
    n_cp = max(0, min(N_CHANGEPOINTS, hist - 1))
    cps = t[np.linspace(0, hist - 1, n_cp + 1).round().astype(int)[1:]] if n_cp else np.empty(0)
    seasonal = span >= MIN_SEASONAL_DAYS

    def design(d):
        tt = t_of(d)
        parts = [np.ones_like(tt), tt, np.clip(tt[:, None] - cps[None, :], 0.0, None)]
        if seasonal:
            days = (d - np.datetime64("1970-01-01")) / np.timedelta64(1, "D")
            parts.append(_fourier(days.astype(float)))
        return np.column_stack(parts)

    X, ys = design(ds), y / scale
    p = X.shape[1]
    groups = [g for g in (np.array([1]), np.arange(2, 2 + n_cp), np.arange(2 + n_cp, p)) if len(g)]
    variance = np.full(p, 0.01)
    variance[0] = 25.0
    noise = max(float(np.var(ys)), 1e-8)
    gram, moment = X.T @ X, X.T @ ys
    for _ in range(EVIDENCE_STEPS):
        cov = np.linalg.inv(gram / noise + np.diag(1.0 / variance))
        w = cov @ moment / noise
        used = np.clip(1.0 - np.diag(cov) / variance, 0.0, 1.0)  # how far the data set each weight
        old = np.r_[variance, noise]
        for g in groups:
            variance[g] = np.clip(float(np.sum(w[g] ** 2)) / (float(np.sum(used[g])) + SHRINKAGE), 1e-9, 1e3)
        freedom = max(n - float(np.sum(used)), 1.0)
        noise = max(float(np.sum((ys - X @ w) ** 2)) / freedom, 1e-10)
        if np.max(np.abs(np.log(np.r_[variance, noise] / old))) < 1e-6:
            break
    cov = np.linalg.inv(gram / noise + np.diag(1.0 / variance))
    w = cov @ moment / noise
    ahead_x = design(future)
    yhat = ahead_x @ w * scale
    # Beyond the history rate changes keep arriving at the historical rate (n_cp per
    # unit of scaled time) with the learned variance. A change at s adds
    # delta * (t - s) at t, so the trend variance at t > 1 is n_cp * var * (t - 1)^3 / 3.
    ahead = np.clip(t_of(future) - 1.0, 0.0, None)
    changes = n_cp * float(variance[2]) * ahead ** 3 / 3.0 if n_cp else 0.0 * ahead
    spread = np.sqrt(noise + np.einsum("ij,jk,ik->i", ahead_x, cov, ahead_x) + changes)
    half = np.maximum.accumulate(_student_quantile(freedom) * spread * scale)
    return yhat, yhat - half, yhat + half


def month_ends(last_month: np.datetime64, periods: int) -> np.ndarray:
    """X13 / trap 20: month *ends* starting with the end of the last history
    month (the reference mixes month-start history with month-end steps)."""
    first = np.datetime64(str(last_month)[:7], "M")
    return (np.arange(1, periods + 1) + first).astype("datetime64[D]") - np.timedelta64(1, "D")


def _forecast_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Forecast of one entity at the months of its ``ahead`` array. A month end is
    evaluated a day later, on the grid of month starts that the model is fitted on."""
    cols = ["entity_id", "month", "predicted_net_cashflow", "lower_bound", "upper_bound", "history_months"]
    known = pdf.dropna(subset=["net_cashflow"])  # missing y is not fitted
    if known.empty:
        return pd.DataFrame(columns=cols)
    ds = pd.to_datetime(known["month"]).to_numpy().astype("datetime64[D]")
    future = np.sort(np.array(list(pdf["ahead"].iloc[0]), dtype="datetime64[D]"))
    yhat, lo, hi = fit_predict(ds, known["net_cashflow"].astype(float).to_numpy(), future + np.timedelta64(1, "D"))
    return pd.DataFrame({
        "entity_id": pdf["entity_id"].iloc[0], "month": pd.to_datetime(future).date,
        "predicted_net_cashflow": np.round(yhat, 2), "lower_bound": np.round(lo, 2),
        "upper_bound": np.round(hi, 2), "history_months": len(pdf)})[cols]


def _forecast(mart: DataFrame, eligible: DataFrame, periods: int) -> DataFrame:
    """Fit every entity of the ``eligible`` series at the months of ``forecast_months``
    (one array of ``periods`` dates an entity joins its few rows)."""
    ahead = forecast_months(mart, periods).groupBy("entity_id").agg(F.collect_list("month").alias("ahead"))
    return eligible.join(ahead, "entity_id").groupBy("entity_id").applyInPandas(_forecast_group, _schema(eligible))


def history_gate(mart: DataFrame, key: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """Split the monthly series into (eligible rows, rejected entities).

    Eligible: entities with at least 6 months. The count window is partitioned
    like the following grouped map, so the gate adds no shuffle."""
    counted = mart.withColumn("history_months", F.count(F.lit(1)).over(Window.partitionBy(key)))
    ok = counted.where(F.col("history_months") >= MIN_HISTORY_MONTHS).drop("history_months")
    rejected = (counted.where(F.col("history_months") < MIN_HISTORY_MONTHS)
                .groupBy(key).agg(F.first("history_months").cast("int").alias("history_months"))
                .withColumn("reason", F.lit(SHORT_HISTORY_REASON)))
    return ok, rejected


def forecast_cashflow(mart: DataFrame, periods: int = DEFAULT_PERIODS,
                      entity_id=None) -> DataFrame:
    """F1 for every entity at once (or one, with ``entity_id``, as the
    reference's request does): (entity_id, month, predicted_net_cashflow,
    lower_bound, upper_bound, history_months). Entities below the gate yield no
    rows; ``forecast_refresh`` also reports them."""
    validate_periods(periods)
    ship_package(mart.sparkSession)
    if entity_id is not None:
        mart = mart.where(F.col("entity_id") == F.lit(entity_id))
    ok, _ = history_gate(mart.select("entity_id", "month",
                                     F.col("net_cashflow").cast("double").alias("net_cashflow")))
    return _forecast(mart, ok, periods)


def forecast_refresh(mart: DataFrame, periods: int = DEFAULT_PERIODS) -> tuple[DataFrame, DataFrame]:
    """the weekly refresh over every entity found in the mart (trap 21):
    (forecasts, rejected entities with the reason)."""
    validate_periods(periods)
    ship_package(mart.sparkSession)
    series = mart.select("entity_id", "month",
                         F.col("net_cashflow").cast("double").alias("net_cashflow"))
    ok, rejected = history_gate(series)
    return _forecast(mart, ok, periods), rejected


def history_summary(mart: DataFrame) -> DataFrame:
    """P11 per entity: months of history, whether it can be forecast, and the
    rejection reason otherwise (F2 logs and skips those)."""
    n = F.count(F.lit(1)).cast("int")
    return (mart.groupBy("entity_id").agg(n.alias("history_months"))
                .withColumn("eligible", F.col("history_months") >= MIN_HISTORY_MONTHS)
                .withColumn("reason", F.when(~F.col("eligible"), F.lit(SHORT_HISTORY_REASON))))


def forecast_months(mart: DataFrame, periods: int = DEFAULT_PERIODS) -> DataFrame:
    """X13 + P12 in Spark SQL: the month ends each eligible entity is forecast
    for, ``last_day(add_months(last history month, k))`` for k = 0..periods-1
    (all later than the last month start, trap 20)."""
    validate_periods(periods)
    last = (mart.groupBy("entity_id")
                .agg(F.max("month").alias("_last"), F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") >= MIN_HISTORY_MONTHS))
    steps = last.select("entity_id", "_last",
                        F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("_k"))
    return steps.select("entity_id", F.last_day(F.add_months("_last", F.col("_k"))).alias("month"))
