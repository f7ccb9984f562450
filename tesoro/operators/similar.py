"""Fuzzy duplicates, transactions of one account and a few days whose descriptions
differ by a few edits.

A partition-based similarity join on Spark SQL built-ins. Equal (account, date,
description) rows are one node. A description is cut into ``max_distance + 1`` segments;
one within so many edits of it holds at least one of them unchanged, near its place. So a
node has keys for its own segments and for the substrings of its description that can be a
segment of another, and only what meets on the hash of (account, days, length, segment) is
verified by edit distance: no account is compared all to all. Both sides of the join are
one shuffled table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesoro.functions.storage import stored

NODE = ("account_id", "transaction_date", "description")


def _segments(d: int) -> str:
    """The ``d + 1`` segments of a description as (length, number, text); they differ by
    at most one character in size."""
    return (f"transform(sequence(0, {d}), i -> struct(len AS len, i AS i, substring(description, "
            f"cast((i * len) div {d + 1} AS int) + 1, cast(((i + 1) * len) div {d + 1} - (i * len) div {d + 1} AS int)) AS seg))")


def _substrings(d: int) -> str:
    """Substrings that can be segment ``i`` of a description of ``len - d`` to ``len``
    characters. With k segments before it, at most k edits lie before it if none of those
    is unchanged, and at most ``d - k`` behind it if none of the later ones is; so its
    shift lies between the bounds that either view gives, for a length that is ``gap``
    shorter. Without the description's own segments."""
    return f"""flatten(transform(sequence(0, least({d}, len)), gap ->
        flatten(transform(sequence(0, {d}), i -> transform(
            filter(sequence(-{d}, {d}), shift ->
                NOT (gap = 0 AND shift = 0) AND shift >= greatest(-i, gap - ({d} - i)) AND shift <= least(i, gap + ({d} - i))
                AND (i * (len - gap)) div {d + 1} + shift >= 0
                AND ((i + 1) * (len - gap)) div {d + 1} + shift <= len),
            shift -> struct(len - gap AS len, i AS i, substring(description,
                cast((i * (len - gap)) div {d + 1} + shift AS int) + 1,
                cast(((i + 1) * (len - gap)) div {d + 1} - (i * (len - gap)) div {d + 1} AS int)) AS seg))))))"""


def similar_pairs(nodes: DataFrame, days: int, max_distance: int) -> DataFrame:
    """``account_id``, the date, description and copies of either (``_a``, ``_b``), and
    ``distance`` once for each pair of ``nodes`` of one account, at most ``days`` apart,
    whose descriptions differ by 1 to ``max_distance`` edits."""
    d, size = max_distance, 4 * (days + 1)
    day = F.datediff("transaction_date", F.lit("1970-01-01").cast("date"))
    base = nodes.select(*NODE, "copies", F.char_length("description").alias("len"), day.alias("day"))
    keys = F.expr(f"concat(transform({_segments(d)}, k -> struct(true AS own, k)), transform({_substrings(d)}, k -> struct(false AS own, k)))")
    # two days that are close lie in one block, or the earlier day's next one is the later day's
    blocks = F.expr(f"array_distinct(array(floor(day / {size}), floor((day + {days}) / {size})))")
    met = (base.select(*NODE, "copies", blocks.alias("blocks"), F.explode(keys).alias("key"))
           .select(*NODE, "copies", "key", F.explode("blocks").alias("block"))
           .select(*NODE, "copies", "key.own", F.xxhash64("block", "key.k").alias("key")))
    x, y = met.alias("x"), met.alias("y")
    earlier = (F.col("x.transaction_date") < F.col("y.transaction_date")) | (
        (F.col("x.transaction_date") == F.col("y.transaction_date")) & (F.col("x.description") < F.col("y.description")))
    close = F.abs(F.datediff("x.transaction_date", "y.transaction_date")) <= days
    pairs = x.join(y, [F.col("x.key") == F.col("y.key"), F.col("x.account_id") == F.col("y.account_id"), F.col("x.own") | F.col("y.own"),
                       close, earlier, F.col("x.description") != F.col("y.description")])
    sides = [F.col(f"{side}.{c}").alias(f"{c}_{name}") for side, name in (("x", "a"), ("y", "b")) for c in (*NODE[1:], "copies")]
    pairs = pairs.select("x.account_id", *sides, F.levenshtein(F.col("x.description"), F.col("y.description"), d).alias("distance"))
    return pairs.where("distance > 0").dropDuplicates(["account_id", *(f"{c}_{name}" for name in "ab" for c in NODE[1:])])


def fuzzy_duplicates(stg_transactions: DataFrame, days: int = 3, max_distance: int = 1) -> DataFrame:
    """Every transaction with ``confidence_score`` filled and ``n_similar`` added.

    Similar are two transactions of one account, at most ``days`` apart, whose
    descriptions are equal or within ``max_distance`` edits (code points). ``n_similar``
    counts them all; ``confidence_score`` is the greatest ``1 - distance / longer length``
    (two empty descriptions: 1), NULL without a similar one. Rows without account, date or
    description have none. Copies are never expanded into pairs: equal rows are one node,
    equal descriptions of other days a range window over the dates of one description,
    and the links of a node are sums over its partners. Only nodes that have a similar one
    are joined to the rows; they are stored, so that Spark knows how few they are.
    """
    rows = stg_transactions.drop("confidence_score")
    whole = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in NODE))
    day = F.datediff("transaction_date", F.lit("1970-01-01").cast("date"))
    near = Window.partitionBy("account_id", "description").orderBy("_day").rangeBetween(-days, days)
    nodes = stored(whole.groupBy(*NODE).agg(F.count(F.lit(1)).alias("copies")).withColumn("_day", day)
                   .withColumn("n_equal", F.sum("copies").over(near) - 1).drop("_day"), "similar-nodes")
    longest = F.greatest(F.char_length("description_a"), F.char_length("description_b"))
    ends = similar_pairs(nodes, days, max_distance).select("account_id", F.explode(F.array(*[
        F.struct(*[F.col(f"{c}_{this}").alias(c) for c in NODE[1:]], F.col(f"copies_{other}").alias("n"))
        for this, other in ("ab", "ba")])).alias("end"), (F.lit(1.0) - F.col("distance") / longest.cast("double")).alias("score"))
    equal = nodes.where("n_equal > 0").select(*NODE, F.col("n_equal").alias("n"), F.lit(1.0).alias("score"))
    found = stored(equal.unionByName(ends.select("account_id", "end.*", "score")).groupBy(*NODE).agg(
        F.sum("n").alias("n_similar"), F.max("score").alias("confidence_score")), "similar-found")
    return rows.join(found, list(NODE), "left").select(
        *[c for c in rows.columns], "confidence_score", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"))
