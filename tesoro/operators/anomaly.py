"""Cash-flow anomalies N1 and the anomaly report N3.

N1 scores each entity's monthly net cash flow by the isolation forest of Liu, Ting &
Zhou (2008), with the expectation over all random trees in place of a sample of them: in
one dimension a node is a run of sorted values, a split falls into a gap with a
probability proportional to the gap, and the probability of every run at every depth
follows from that of the runs one level up. The height limit is ceil(log2 n), the score
-2^(-E[h(x)] / c(n)) (lower is more anomalous), rounded to 9 digits. A month is flagged
when its score is strictly below the 10th percentile (contamination 0.1, linear
interpolation). Series shorter than 6 months are not scored. There is no random number,
so results depend on the series alone.

The monthly mart is grouped by entity; a group holds one row per month.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesoro.session import ship_package

from tesoro.operators.forecast import MIN_HISTORY_MONTHS, history_gate

# Contamination and reason text of the reference's detector.
CONTAMINATION = 0.1
ANOMALY_REASON = "Unusual net cash flow relative to historical pattern"
SCORE_DIGITS = 9
_EULER = 0.5772156649015329


def average_path_length(n) -> np.ndarray:
    """c(n): mean path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + _EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def expected_path_lengths(values: np.ndarray) -> np.ndarray:
    """E[h(x)] of each of the sorted ``values`` over all isolation trees on them.

    ``reach[a, b]`` is the probability that a tree has a node of exactly the points
    a..b at the current depth. A node at the height limit, of one point or of equal
    points is a leaf; any other is split in gap j with probability gap[j] / (x[b] - x[a]).
    """
    n = len(values)
    limit = int(math.ceil(math.log2(max(n, 2))))
    size = np.arange(n)[None, :] - np.arange(n)[:, None] + 1
    rest = average_path_length(np.maximum(size, 1))
    width = values[None, :] - values[:, None]
    gap = np.diff(values)
    reach = np.zeros((n, n))
    reach[0, n - 1] = 1.0
    leaf = np.zeros((n, n))
    for depth in range(limit + 1):
        ends = (size == 1) | (width <= 0) | (depth == limit)
        leaf += np.where(ends, reach * (depth + rest), 0.0)
        flow = np.where(ends, 0.0, reach / np.where(width > 0, width, 1.0))
        reach = np.zeros((n, n))
        if n > 1:
            beyond = np.cumsum(flow[:, ::-1], axis=1)[:, ::-1]  # runs from a that end at b or later
            reach[:, :-1] += beyond[:, 1:] * gap[None, :]
            before = np.cumsum(flow, axis=0)                    # runs to b that begin at a or before
            reach[1:, :] += before[:-1, :] * gap[:, None]
        reach = np.triu(reach)
    return np.cumsum(leaf.sum(axis=1)) - np.r_[0.0, np.cumsum(leaf.sum(axis=0))[:-1]]


def isolation_scores(values) -> np.ndarray:
    """Scores in the scikit-learn sign convention (lower = more anomalous)."""
    values = np.asarray(values, dtype=float)
    order = np.argsort(values, kind="stable")
    lengths = expected_path_lengths(values[order])
    scores = np.empty(len(values))
    scores[order] = -np.power(2.0, -lengths / average_path_length([max(len(values), 2)])[0])
    return np.round(scores, SCORE_DIGITS)


def flag_anomalies(values: np.ndarray, contamination: float = CONTAMINATION) -> tuple:
    scores = isolation_scores(values)
    threshold = np.round(np.percentile(scores, 100.0 * contamination), SCORE_DIGITS)
    return scores, scores < threshold


def _anomaly_group(pdf: pd.DataFrame) -> pd.DataFrame:
    cols = ["entity_id", "month", "net_cashflow", "anomaly_score", "reason"]
    if len(pdf) < MIN_HISTORY_MONTHS:
        return pd.DataFrame(columns=cols)
    pdf = pdf.dropna(subset=["net_cashflow"]).sort_values("month")   # nothing to score
    if pdf.empty:
        return pd.DataFrame(columns=cols)
    scores, flagged = flag_anomalies(pdf["net_cashflow"].astype(float).to_numpy())
    out = pdf.assign(anomaly_score=scores, reason=ANOMALY_REASON)[flagged]
    return out[cols]


def detect_cashflow_anomalies(mart: DataFrame) -> DataFrame:
    """N1 for every entity: flagged months with net_cashflow and the score."""
    key_type = mart.schema["entity_id"].dataType.simpleString()
    net_type = mart.schema["net_cashflow"].dataType.simpleString()
    ship_package(mart.sparkSession)
    ok, _ = history_gate(mart.select("entity_id", "month", "net_cashflow"))
    schema = (f"entity_id {key_type}, month date, net_cashflow {net_type}, "
              "anomaly_score double, reason string")
    return ok.groupBy("entity_id").applyInPandas(_anomaly_group, schema)


def anomaly_report(cashflow_mart: DataFrame, turnover_mart: DataFrame, entity_id=None) -> dict:
    """N3 = N1 + N2 (optionally for one entity)."""
    from tesoro.operators.marts import slow_moving_inventory
    if entity_id is not None:
        cashflow_mart = cashflow_mart.where(F.col("entity_id") == F.lit(entity_id))
        turnover_mart = turnover_mart.where(F.col("entity_id") == F.lit(entity_id))
    return {"cashflow_anomalies": detect_cashflow_anomalies(cashflow_mart),
            "slow_moving_inventory": slow_moving_inventory(turnover_mart)}
