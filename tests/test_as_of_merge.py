"""J3 with more rule sets than are broadcast: the sort-merge lookup."""
import datetime as dt
import random
from statistics import median

import duckdb
import pyarrow as pa

from pyspark.sql import functions as F

from tesoro.operators import tax


def generated_sets(spark, count):
    """``count`` sets of three jurisdictions, some of one date, a draft now and then."""
    return spark.range(count).selectExpr(
        "concat('set-', id) AS id", "element_at(array('MX', 'US', 'CA'), cast(id % 3 + 1 AS int)) AS jurisdiction",
        "date_add(date'1900-01-01', cast((id * 7919) % 52000 AS int)) AS effective_date", "'' AS published_gazette_ref",
        "IF(id % 11 = 0, 'draft', 'active') AS status", "'' AS notes", "cast(NULL AS timestamp) AS created_at", "'' AS published_by",
        "timestamp'2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 5) AS published_at")


def test_equals_the_asof_join_of_another_engine(spark):
    sets = generated_sets(spark, 150_000)
    amounts = spark.range(30_000).selectExpr(
        "id AS n", "element_at(array('MX', 'US', 'CA', 'XX'), cast(id % 4 + 1 AS int)) AS jur",
        # a third of all amounts on one day of one jurisdiction
        "IF(id % 3 = 0, date'1999-09-09', date_add(date'1890-01-01', cast((id * 31) % 58000 AS int))) AS day", "map(id, 'x') AS _row")
    amounts = amounts.withColumn("jur", F.expr("IF(n % 3 = 0, 'MX', jur)"))
    con = duckdb.connect()
    con.register("s", pa.Table.from_pandas(sets.toPandas()))
    con.register("a", pa.Table.from_pandas(amounts.select("n", "jur", "day").toPandas()))
    want = con.sql("""
        SELECT n, id, e FROM a ASOF LEFT JOIN (
            SELECT jurisdiction, CAST(effective_date AS DATE) AS e, id FROM s WHERE status = 'active'
            QUALIFY row_number() OVER (PARTITION BY jurisdiction, effective_date ORDER BY published_at DESC, id DESC) = 1) x
        ON a.jur = x.jurisdiction AND CAST(a.day AS DATE) >= x.e""").fetchall()
    got = tax.as_of_rule_set(amounts, sets, "day", jurisdiction_col="jur")
    assert got.columns == ["n", "jur", "day", "_row", "rule_set_id", "rule_set_effective_date"]
    assert sorted((r[0], r[4], r[5]) for r in got.collect()) == sorted(want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in tax.merge_slices(amounts, sets, "day", "jur", ("active",)).groupBy("_slice").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 3 and max(sizes) <= 2 * median(sizes)


def test_small_tables_by_merge_equal_the_buckets(spark, monkeypatch):
    rng = random.Random(1)
    day = lambda: dt.date(1999, 1, 1) + dt.timedelta(rng.randint(0, 900))
    rows = [(i, rng.choice(["MX", "US", None]), rng.choice([day(), day(), None])) for i in range(200)] * 2
    amounts = spark.createDataFrame(rows, "n long, jur string, day date")
    for sets in (generated_sets(spark, 40).withColumn("effective_date", F.expr("date_add(date'1999-01-01', cast(substr(id, 5) AS int) * 20)")),
                 generated_sets(spark, 0)):
        want = sorted(map(repr, map(tuple, tax.as_of_rule_set(amounts, sets, "day", jurisdiction_col="jur").collect())))
        one = sorted(map(repr, map(tuple, tax.as_of_rule_set(amounts, sets, "day", "US").collect())))
        with monkeypatch.context() as patch:
            patch.setattr(tax, "MAX_RULE_ROWS", -1 if sets.isEmpty() else 3)
            assert sorted(map(repr, map(tuple, tax.as_of_rule_set(amounts, sets, "day", jurisdiction_col="jur").collect()))) == want
            assert sorted(map(repr, map(tuple, tax.as_of_rule_set(amounts, sets, "day", "US").collect()))) == one
