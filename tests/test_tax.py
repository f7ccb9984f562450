import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tesoro import schemas
from tesoro.operators import tax
from tesoro.plans import tax_cycle
from tesoro.sources.literal import literal_frame

ISR_SPEC_RULES = [{"rule_type": "ISR", "applies_to": tax.ISR_APPLIES_TO,
                   "formula_expression": tax.brackets_formula(tax.ISR_MONTHLY_BRACKETS_2026)}]


def _amounts(spark, values, tax_type="ISR", applies_to=tax.ISR_APPLIES_TO, as_of="2026-03-01"):
    data = [(i, D(v) if v is not None else None, tax_type, applies_to, dt.date.fromisoformat(as_of))
            for i, v in enumerate(values)]
    schema = "k int, amount decimal(14,2), tax_type string, applies_to string, as_of_date date"
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def seeded(spark):
    rule_sets, rules, sid = tax_cycle.seed_rules(spark)
    return rule_sets, rules, sid


def test_hand_worked_isr_and_iva(spark, seeded):
    rule_sets, rules, sid = seeded
    isr = _amounts(spark, ["0.00", "-5.00", "844.60", "14644.64", "55736.74", "500000.00", "0.01"])
    out = tax.calculate_tax(isr, rule_sets, rules, applies_to="applies_to", as_of="as_of_date")
    got = dict((k, v) for k, v in rows(out, "k", "tax_amount"))
    assert got == {0: D("0.00"), 1: D("0.00"), 2: D("16.22"), 3: D("1339.14"),
                   4: D("10457.10"), 5: D("159513.84"), 6: D("0.00")}
    iva = _amounts(spark, ["100.00", "2.50"], "IVA", "general")
    out = tax.calculate_tax(iva, rule_sets, rules, applies_to="applies_to", as_of="as_of_date")
    assert [r[1] for r in rows(out, "k", "tax_amount")] == [D("16.00"), D("0.40")]
    assert {r[0] for r in rows(out, "tax_status")} == {"ok"}
    assert {r[0] for r in rows(out, "rule_set_id")} == {sid}


def test_half_even_not_half_up(spark):
    df = spark.createDataFrame([(D("10457.105"),), (D("2.665"),), (D("2.675"),)], "x decimal(20,3)")
    got = [r[0] for r in df.select(tax.quantize_half_even("x", 2).alias("y")).collect()]
    assert got == [D("10457.10"), D("2.66"), D("2.68")]


def test_zero_max_is_open_ended_and_first_match_wins(spark):
    brackets = [(D("0.01"), D("100.00"), D("0.00"), D("0.1000")),
                (D("50.00"), D("0.00"), D("1.00"), D("0.5000"))]
    df = spark.createDataFrame([(D("75.00"),), (D("1000.00"),), (D("0.00"),)], "income decimal(14,2)")
    arr = F.array(*[F.struct(F.lit(lo).alias("min"), F.lit(hi).alias("max"), F.lit(fee).alias("fixed_fee"),
                             F.lit(rate).alias("rate")) for lo, hi, fee, rate in brackets])
    got = [r[0] for r in df.select(tax.isr_tax("income", arr).alias("t")).collect()]
    # 75 matches the first bracket (list order), 1000 only the open-ended one
    assert got == [D("7.50"), D("476.00"), D("0.00")]


def test_missing_set_and_missing_rule(spark, seeded):
    rule_sets, rules, _ = seeded
    early = _amounts(spark, ["100.00"], "IVA", "general", as_of="2025-12-31")
    out = tax.calculate_tax(early, rule_sets, rules, applies_to="applies_to", as_of="as_of_date")
    assert rows(out, "tax_status", "tax_amount") == [("no_rule_set", None)]
    general_isr = _amounts(spark, ["100.00"], "ISR", "general")  # trap 6
    out = tax.calculate_tax(general_isr, rule_sets, rules, applies_to="applies_to", as_of="as_of_date")
    assert rows(out, "tax_status", "tax_amount") == [("no_rule", None)]


def _history(spark):
    rs, rr = tax.empty_rule_tables(spark)
    spec = lambda eff, rate, jur="MX": {"jurisdiction": jur, "effective_date": eff,
                                        "rules": [{"rule_type": "IVA", "applies_to": "general",
                                                   "rate": rate}]}
    drafts = [(spec("2020-01-01", "0.10"), dt.datetime(2020, 1, 1), "A"),
              (spec("2022-01-01", "0.12"), dt.datetime(2021, 1, 1), "B"),
              (spec("2022-01-01", "0.13"), dt.datetime(2021, 1, 2), "C"),   # tie on date
              (spec("2030-01-01", "0.20"), dt.datetime(2021, 1, 3), "F"),   # future-dated
              (spec("2019-01-01", "0.50", "US"), dt.datetime(2019, 1, 1), "U"),
              (spec("2021-01-01", "0.99"), dt.datetime(2021, 1, 4), "D")]   # stays draft
    rs, rr, ids = tax.create_drafts(spark, rs, rr, drafts)
    return rs, rr


def test_asof_ties_history_and_visibility(spark):
    rs, rr = _history(spark)
    rs = tax.publish_in_order(rs, ["A", "B", "C", "U"], "t", dt.datetime(2022, 1, 1))
    statuses = dict(rows(rs, "id", "status"))
    assert statuses == {"A": "superseded", "B": "superseded", "C": "active", "F": "draft",
                        "U": "active", "D": "draft"}
    amounts = _amounts(spark, ["100.00"] * 4, "IVA", "general")
    amounts = amounts.withColumn("as_of_date", F.element_at(F.array(
        *[F.lit(x).cast("date") for x in ["2019-06-01", "2020-06-01", "2022-06-01", "2031-01-01"]]),
        F.col("k") + 1))
    hist = tax.as_of_rule_set(amounts, rs, statuses=("active", "superseded"))
    assert [r[1] for r in rows(hist, "k", "rule_set_id")] == [None, "A", "C", "C"]
    # default: only the active set is visible, so 2020 history is lost (trap 5)
    active = tax.as_of_rule_set(amounts, rs)
    assert [r[1] for r in rows(active, "k", "rule_set_id")] == [None, None, "C", "C"]
    # a future-dated publish leaves a gap until it takes effect
    rs2 = tax.publish(rs, "F", "t", dt.datetime(2023, 1, 1))
    after = tax.as_of_rule_set(amounts, rs2)
    assert [r[1] for r in rows(after, "k", "rule_set_id")] == [None, None, None, "F"]
    # a tie on effective_date goes to the set published last, not the larger id
    rs3 = tax.publish(rs, "B", "t", dt.datetime(2024, 1, 1))   # republish the superseded B
    tie = tax.as_of_rule_set(amounts, rs3, statuses=("active", "superseded"))
    assert [r[1] for r in rows(tie, "k", "rule_set_id")] == [None, "A", "B", "B"]
    one = tax.active_rule_set(rs2, "2031-01-01")
    assert [r[0] for r in one.select("id").collect()] == ["F"]


def test_publish_guards_and_single_active(spark):
    rs, rr = _history(spark)
    with pytest.raises(LookupError):
        tax.publish(rs, "nope")
    rs = tax.publish(rs, "A", "t", dt.datetime(2022, 1, 1))
    with pytest.raises(ValueError):
        tax.publish(rs, "A")
    rs = tax.publish(rs, "B", "t", dt.datetime(2022, 1, 2))
    rs = tax.publish(rs, "A", "t", dt.datetime(2022, 1, 3))   # republishing superseded is allowed
    active = rows(rs.where("status = 'active'"), "jurisdiction", "id")
    assert active == [("MX", "A")]
    stamped = dict(rows(rs, "id", "published_by"))
    assert stamped["A"] == "t" and stamped["D"] == ""


def test_approval_gated_monthly_update(spark, seeded):
    rule_sets, rules, seed_id = seeded
    run = "2026-02-01"
    draft_id = tax.rule_set_id("MX", run, dt.datetime(2026, 2, 1))
    pending = tax_cycle.approvals_frame(spark, [(draft_id, "pending", dt.datetime(2026, 2, 1))])
    rs, rr, sid = tax_cycle.monthly_tax_update(spark, rule_sets, rules, run, pending)
    assert sid == draft_id
    assert dict(rows(rs, "id", "status")) == {seed_id: "active", draft_id: "draft"}
    approved = tax_cycle.approvals_frame(spark, [
        (draft_id, "pending", dt.datetime(2026, 2, 1)), (draft_id, "approved", dt.datetime(2026, 2, 2))])
    rs, rr, _ = tax_cycle.monthly_tax_update(spark, rule_sets, rules, run, approved)
    assert dict(rows(rs, "id", "status")) == {seed_id: "superseded", draft_id: "active"}
    # the monthly draft carries IVA only: ISR now has no rule (trap 7)
    out = tax.calculate_tax(_amounts(spark, ["1000.00"]), rs, rr, applies_to="applies_to",
                            as_of="as_of_date")
    assert rows(out, "tax_status") == [("no_rule",)]


def test_isr_monotone_within_a_cent(spark, seeded):
    rule_sets, rules, _ = seeded
    incomes = [f"{x / 100:.2f}" for x in range(1, 60000001, 977777)] + [
        "844.59", "844.60", "17533.64", "17533.65", "425641.99", "425642.00"]
    out = tax.calculate_tax(_amounts(spark, incomes), rule_sets, rules, applies_to="applies_to",
                            as_of="as_of_date")
    pairs = sorted((r[0], r[1]) for r in out.select("amount", "tax_amount").collect())
    for (a0, t0), (a1, t1) in zip(pairs, pairs[1:]):
        assert t1 >= t0 - D("0.01"), (a0, t0, a1, t1)


def test_spec_validation_and_tax_type_check(spark):
    with pytest.raises(ValueError):
        tax.validate_spec({"effective_date": "2026-01-01", "rules": [{"rule_type": "VAT"}]})
    tax.validate_spec({"effective_date": "2026-01-01", "rules": [{"rule_type": "RETENCION"}]})
    df = spark.createDataFrame([("IVA",), ("RETENCION",), (None,)], "tax_type string")
    assert sorted(r[0] or "" for r in tax.check_tax_types(df).collect()) == ["", "RETENCION"]


def test_tax_plan_is_python_free_and_hash_joined(spark, seeded):
    rule_sets, rules, _ = seeded
    out = tax.calculate_tax(_amounts(spark, ["1.00"]), rule_sets, rules, applies_to="applies_to",
                            as_of="as_of_date")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "PythonUDF" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_literal_frame_types(spark):
    df = literal_frame(spark, [("r", "s", "IVA", "g", D("0.16"), None, None, D("0"), None,
                                dt.datetime(2026, 1, 1))], schemas.TAX_RULE)
    assert df.schema.simpleString() == schemas.TAX_RULE.simpleString()
    assert df.count() == 1


def test_literal_frame_round_trips_awkward_text(spark):
    awkward = ["it's", 'back\\slash', "quote\"d", "físicas — ñ", "line\nbreak", "%s {x}"]
    rows_in = [(f"id{i}", text, dt.datetime(2026, 1, 1)) for i, text in enumerate(awkward)]
    df = literal_frame(spark, rows_in, schemas.APPROVAL)
    got = sorted((r["rule_set_id"], r["decision"]) for r in df.collect())
    assert got == sorted((r[0], r[1]) for r in rows_in)


def test_single_request_answers(spark, seeded):
    rule_sets, rules, sid = seeded
    out = tax.calculate_one(spark, rule_sets, rules, "ISR", "55736.74",
                            applies_to=tax.ISR_APPLIES_TO, as_of_date="2026-05-01")
    assert out == {"tax_type": "ISR", "input_amount": D("55736.74"), "tax_amount": D("10457.10"),
                   "rule_set_id": sid, "rule_set_effective_date": dt.date(2026, 1, 1)}
    with pytest.raises(LookupError):
        tax.calculate_one(spark, rule_sets, rules, "IVA", "1.00", as_of_date="2025-01-01")
    with pytest.raises(LookupError):
        tax.calculate_one(spark, rule_sets, rules, "ISR", "1.00", as_of_date="2026-05-01")
    with pytest.raises(ValueError):
        tax.calculate_one(spark, rule_sets, rules, "RETENCION", "1.00")


def test_types_and_rules_that_cannot_be_calculated(spark, seeded):
    rule_sets, rules, _ = seeded
    for bad in ("RETENCION", "VAT", None):
        out = tax.calculate_tax(_amounts(spark, ["1000.00"], bad, "general"), rule_sets, rules,
                                applies_to="applies_to", as_of="as_of_date")
        assert rows(out, "tax_status", "tax_amount") == [("bad_tax_type", None)]
    rs, rr = tax.empty_rule_tables(spark)
    spec = {"jurisdiction": "MX", "effective_date": "2026-01-01", "rules": [
        {"rule_type": "ISR", "applies_to": "none"}, {"rule_type": "IVA", "applies_to": "general"},
        {"rule_type": "ISR", "applies_to": "empty", "formula_expression": {"brackets": []}}]}
    rs, rr, sid = tax.create_draft(spark, rs, rr, spec, dt.datetime(2026, 1, 1))
    rs = tax.publish(rs, sid, "t", dt.datetime(2026, 1, 1))
    for kind, applies in (("ISR", "none"), ("ISR", "empty"), ("IVA", "general")):
        out = tax.calculate_tax(_amounts(spark, ["1000.00"], kind, applies), rs, rr, applies_to="applies_to",
                                as_of="as_of_date")
        assert rows(out, "tax_status", "tax_amount") == [("bad_rule", None)]


def test_one_order_for_ties_and_a_jurisdiction_column(spark):
    rs, _ = _history(spark)
    for order in (["B", "C"], ["C", "B"]):
        published = tax.publish_in_order(rs, order, "t", dt.datetime(2022, 1, 1))
        amounts = _amounts(spark, ["1.00"], as_of="2022-06-01").withColumn("where", F.lit("MX"))
        shown = ("active", "superseded")
        by_range = tax.as_of_rule_set(amounts, published, statuses=shown, jurisdiction_col="where")
        one = tax.active_rule_set(published, "2022-06-01", statuses=shown)
        assert rows(by_range, "rule_set_id") == [(order[-1],)] == rows(one, "id")
    published = tax.publish_in_order(rs, ["A", "U"], "t", dt.datetime(2022, 1, 1))
    both = _amounts(spark, ["1.00"] * 3, as_of="2022-06-01").withColumn(
        "where", F.element_at(F.array(F.lit("MX"), F.lit("US"), F.lit("CA")), F.col("k") + 1))
    assert [r[1] for r in rows(tax.as_of_rule_set(both, published, jurisdiction_col="where"), "k", "rule_set_id")] == [
        "A", "U", None]


def test_many_rule_sets_take_the_shuffle_join(spark, monkeypatch):
    rs, _ = _history(spark)
    rs = tax.publish_in_order(rs, ["A", "B", "C", "U"], "t", dt.datetime(2022, 1, 1))
    amounts = _amounts(spark, ["1.00"], as_of="2022-06-01")
    shown = ("active", "superseded")
    few = rows(tax.as_of_rule_set(amounts, rs, statuses=shown), "rule_set_id", "rule_set_effective_date")
    monkeypatch.setattr(tax, "MAX_RULE_ROWS", 2)
    assert rows(tax.as_of_rule_set(amounts, rs, statuses=shown), "rule_set_id", "rule_set_effective_date") == few


def test_too_many_approved_drafts_raise(spark, monkeypatch):
    rs, _ = _history(spark)
    monkeypatch.setattr(tax, "MAX_RULE_ROWS", 1)
    approved = tax_cycle.approvals_frame(spark, [(i, "approved", dt.datetime(2026, 1, 1)) for i in ("A", "B")])
    with pytest.raises(ValueError):
        tax.publish_approved(rs, approved)


def test_one_date_plans_no_nested_loop(spark, seeded):
    rule_sets, rules, sid = seeded
    out = tax.calculate_tax(_amounts(spark, ["844.60"]), rule_sets, rules, applies_to="applies_to",
                            as_of_date="2026-06-30")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out, "rule_set_id", "tax_amount", "tax_status") == [(sid, D("16.22"), "ok")]


def test_rules_from_json_text(spark):
    text = '{"brackets": [{"min": 0.01, "max": null, "fixed_fee": "16.22", "rate": 0.064}]}'
    frame = spark.createDataFrame([("r1", text), ("r2", "{"), ("r3", None)], "id string, formula_expression string")
    got = {r["id"]: r["formula_expression"] for r in tax.rules_from_json(frame).collect()}
    b = got["r1"]["brackets"][0]
    assert (b["min"], b["max"], b["fixed_fee"], b["rate"]) == (D("0.01"), None, D("16.22"), D("0.0640"))
    assert got["r2"] is None and got["r3"] is None
