import datetime as dt
from decimal import Decimal as D

from conftest import rows
from tesoro.operators import anomaly, marts, review, staging, tax
from tesoro.plans import daily, tax_cycle
from tesoro.plans.catalog import cashflow_mart, deduped_transactions, flags_mart, turnover_mart

SF = "/root/testdata/sf0.001"


def test_rule_set_listing_and_versions(spark, tmp_path):
    rule_sets, rules = tax_cycle.example_rule_history(spark)
    listing = tax.list_rule_sets(rule_sets).collect()
    assert listing[0]["jurisdiction"] == "US"                      # earliest effective date first
    assert [r["effective_date"] for r in listing] == sorted(r["effective_date"] for r in listing)
    assert listing[0].asDict().keys() == {"id", "jurisdiction", "effective_date", "status",
                                          "published_gazette_ref"}
    base = str(tmp_path / "rule_sets")
    tax.save_version(rule_sets, base, "001")
    seed_id = [r["id"] for r in listing if r["effective_date"] == dt.date(2026, 1, 1)][0]
    draft_rs, _, draft = tax.create_draft(spark, rule_sets, rules, tax.monthly_draft_spec("2026-02-01"),
                                          dt.datetime(2026, 2, 1))
    tax.save_version(tax.publish(draft_rs, draft, "me", dt.datetime(2026, 2, 2)), base, "002")
    latest = dict(rows(tax.load_latest(spark, base), "id", "status"))
    assert latest[draft] == "active" and latest[seed_id] == "superseded"


def test_report_reads(spark):
    cf = cashflow_mart(spark, SF)
    one = review.monthly_cashflow_read(cf, entity_id=3)
    assert one.columns == ["month", "total_inflow", "total_outflow", "net_cashflow"]
    months = [r["month"] for r in one.collect()]
    assert months == sorted(months) and len(months) > 6
    inv = review.inventory_turnover_read(turnover_mart(spark, SF), entity_id=1)
    got = [(r["sku"], r["month"]) for r in inv.collect()]
    assert got == sorted(got) and inv.columns[0] == "sku"
    rv = review.normalization_review(deduped_transactions(spark, SF), flags_mart(spark, SF))
    spikes = [r["month"] for r in rv["cost_spike_flags"].collect()]
    assert spikes == sorted(spikes, reverse=True)
    dups = rv["likely_duplicates"].collect()
    assert all(r["dup_group_size"] > 1 for r in dups)


def test_anomaly_report_for_one_entity(spark):
    rep = anomaly.anomaly_report(cashflow_mart(spark, SF), turnover_mart(spark, SF), entity_id=5)
    assert {r["entity_id"] for r in rep["cashflow_anomalies"].collect()} <= {5}
    assert {r["entity_id"] for r in rep["slow_moving_inventory"].collect()} <= {5}


def test_models_as_views(spark):
    from tesoro.sources import driver_tables as dt_
    bronze = {"core_transaction": dt_.transactions(spark, SF),
              "core_cashflowevent": dt_.cashflow_events(spark, SF),
              "core_inventorysnapshot": dt_.inventory_snapshots(spark, SF),
              "core_category": dt_.categories(spark, SF)}
    models = daily.build_models(bronze)
    daily.register_views(models)
    n = spark.sql("SELECT count(*) AS n FROM mart_profitability_flags WHERE NOT is_cost_spike").first()["n"]
    assert n == 0
    assert spark.sql("SELECT count(*) FROM stg_transactions_deduped").first()[0] == \
        dt_.transactions(spark, SF).count()


def test_rule_table_versions_are_immutable(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException
    rule_sets, _ = tax_cycle.example_rule_history(spark)
    base = str(tmp_path / "rs")
    tax.save_version(rule_sets, base, "001")
    with pytest.raises(AnalysisException):
        tax.save_version(rule_sets, base, "001")      # never overwritten in place
