"""Registered queries: one per SURVEY 7.3 key, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables through ``sources.driver_tables`` and runs
over whole tables. Output columns are aliased to the names used by the DuckDB
oracle in ``plans.oracle``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesoro import schemas
from tesoro.operators import anomaly, forecast, marts, quality, review, similar, staging, tax
from tesoro.plans import tax_cycle
from tesoro.plans.rule_store import RuleStore, VersionConflict
from tesoro.session import ensure_checkpoint_dir
from tesoro.sources import driver_tables as dt
from tesoro.sources import feed

# Statuses that keep rule-set history visible (trap 5: the default sees only 'active').
HISTORY_STATUSES = tax.HISTORY_STATUSES
# Dates of the scheduled monthly update used by t8 (run date, and the as-of date).
MONTHLY_RUN_DATE = "2026-02-01"
AFTER_MONTHLY_RUN = "2026-03-01"
# t5: a retroactive publication drafted in mid-2026 (illustrative rate).
T5_DRAFT = ("MX", "1999-01-01", "0.10", 90, "example publication retroactive")
T5_CREATED = "2026-06-01"
# w5_hot_group: rows of a group beyond which it is split.
HOT_GROUP_ROWS = 400
# t4: days after its date at which an order's rule set is asked for, by priority.
AS_KNOWN_DAYS = {"1-URGENT": 0, "2-HIGH": 60, "3-MEDIUM": 180, "4-NOT SPECIFIED": 365, "5-LOW": 1000}
# As-of date for taxing customer balances with the 2026 seed.
BALANCES_AS_OF = "2026-06-30"


# ---- shared lazy building blocks -------------------------------------------------

def cashflow_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.monthly_cashflow(staging.stg_cashflow(dt.cashflow_events(spark, sf_dir)))


def deduped_transactions(spark: SparkSession, sf_dir: str, account_id=None) -> DataFrame:
    """W5, of one account if it is given: the windows are partitioned by account, so
    the filter goes below them, and below the look for hot groups (P8)."""
    stg = staging.stg_transactions(dt.transactions(spark, sf_dir))
    if account_id is not None:
        stg = stg.where(F.col("account_id") == F.lit(account_id))
    return staging.flag_duplicates(stg)


def _transaction_rows(spark: SparkSession, sf_dir: str, account_id=None) -> int | None:
    """Rows of the transactions, from the files' footers; not known for one account."""
    return dt.read_table(spark, sf_dir, "lineitem").count() if account_id is None else None


def expense_mart(spark: SparkSession, sf_dir: str, account_id=None) -> DataFrame:
    return marts.expense_summary(deduped_transactions(spark, sf_dir, account_id), dt.categories(spark, sf_dir),
                                 rows=_transaction_rows(spark, sf_dir, account_id))


def flags_mart(spark: SparkSession, sf_dir: str, account_id=None) -> DataFrame:
    return marts.profitability_flags(expense_mart(spark, sf_dir, account_id), _transaction_rows(spark, sf_dir, account_id))


def turnover_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.inventory_turnover(staging.stg_inventory(dt.inventory_snapshots(spark, sf_dir)))


# ---- queries ---------------------------------------------------------------------

def a1_monthly_cashflow(spark, sf_dir):
    """P2 P6 A1 X1 X2."""
    return cashflow_mart(spark, sf_dir)


def s9_cashflow_read(spark, sf_dir):
    """S9 over every entity."""
    return review.monthly_cashflow_read(cashflow_mart(spark, sf_dir), numbered=True)


def w5_duplicate_flags(spark, sf_dir):
    """P1 W1 W2 P10."""
    return deduped_transactions(spark, sf_dir).select(
        "transaction_id", "account_id", "category_id", "transaction_date", "amount",
        "dup_group_size", "dup_rank", "is_likely_duplicate", "is_duplicate_secondary")


def w5_hot_group(spark, sf_dir):
    """W5 with groups beyond the limit of a task: a few accounts, one amount and one date a
    year, found by the sketch and ranked slice by slice."""
    stg = staging.stg_transactions(dt.transactions(spark, sf_dir))
    hot = stg.withColumn("account_id", F.regexp_extract("description", "line ([0-9]+)", 1).cast("bigint")).withColumn(
        "amount", F.lit("1.00").cast("decimal(14,2)")).withColumn("transaction_date", F.trunc("transaction_date", "year"))
    hot = hot.select("transaction_id", *staging.DUP_KEY, "created_at")  # what is ranked and returned
    return staging.flag_duplicates(hot, hot_group_rows=HOT_GROUP_ROWS).select(
        "transaction_id", "account_id", "transaction_date", "dup_group_size", "dup_rank", "is_duplicate_secondary")


def u1_fuzzy_duplicates(spark, sf_dir):
    """Every transaction with the similarity to others of its account, up to three days
    apart and one edit away."""
    found = similar.fuzzy_duplicates(staging.stg_transactions(dt.transactions(spark, sf_dir)))
    return found.select("transaction_id", "account_id", "transaction_date", "description", "confidence_score", "n_similar")


def a2_expense_summary(spark, sf_dir):
    """J1 A2."""
    return expense_mart(spark, sf_dir)


def w3_rolling_trend(spark, sf_dir):
    """W3 W4."""
    return marts.category_trend(expense_mart(spark, sf_dir), _transaction_rows(spark, sf_dir))


def r2_cost_spikes(spark, sf_dir):
    """R2 P9 X4 X6."""
    return flags_mart(spark, sf_dir)


def r1_duplicate_report(spark, sf_dir):
    """R1 P7 O2."""
    return review.duplicate_report(deduped_transactions(spark, sf_dir), numbered=True)


def r3_cost_spike_report(spark, sf_dir):
    """R3 O2."""
    return review.cost_spike_report(flags_mart(spark, sf_dir), numbered=True, rows=_transaction_rows(spark, sf_dir))


# The account and the entity whose reports are asked for.
ONE_ACCOUNT = 7
ONE_ENTITY = 7


def r1_one_account(spark, sf_dir):
    """The duplicate report of one account."""
    return review.duplicate_report(deduped_transactions(spark, sf_dir, ONE_ACCOUNT), ONE_ACCOUNT)


def r3_one_account(spark, sf_dir):
    """The cost-spike report of one account."""
    return review.cost_spike_report(flags_mart(spark, sf_dir, ONE_ACCOUNT), ONE_ACCOUNT)


def s9_one_entity(spark, sf_dir):
    """The cash flow of one entity."""
    return review.monthly_cashflow_read(cashflow_mart(spark, sf_dir), ONE_ENTITY)


def s10_one_entity(spark, sf_dir):
    """The inventory turnover of one entity."""
    return review.inventory_turnover_read(turnover_mart(spark, sf_dir), ONE_ENTITY)


def a3_inventory_turnover(spark, sf_dir):
    """P3 A3."""
    return turnover_mart(spark, sf_dir)


def s10_inventory_read(spark, sf_dir):
    """S10 over every entity."""
    return review.inventory_turnover_read(turnover_mart(spark, sf_dir), numbered=True)


def n2_slow_moving(spark, sf_dir):
    """A4 P13 N2 X9."""
    return marts.slow_moving_inventory(turnover_mart(spark, sf_dir))


def typed_order_amounts(spark, sf_dir):
    """Orders as tax requests: urgent/high priority -> IVA, low -> RETENCION (which
    can't be calculated, trap 8), others -> ISR; pending orders ask for 'general',
    which has no ISR rule (trap 6)."""
    a = dt.order_tax_amounts(spark, sf_dir)
    tax_type = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("IVA"))
                 .when(F.col("o_orderpriority") == "5-LOW", F.lit("RETENCION"))
                 .otherwise(F.lit("ISR")))
    a = a.withColumn("tax_type", tax_type)
    applies = (F.when(F.col("o_orderstatus") == "P", F.lit("general"))
                .when(F.col("tax_type") == "IVA", F.lit("general"))
                .otherwise(F.lit(tax.ISR_APPLIES_TO)))
    return a.withColumn("applies_to", applies)


def j3_asof_rule_set(spark, sf_dir):
    """Rule set in force on each order date in the order's jurisdiction (history
    visible; two sets share a date)."""
    rule_sets, _ = tax_cycle.example_rule_history(spark)
    amounts = dt.order_tax_amounts(spark, sf_dir)
    return tax.as_of_rule_set(amounts, rule_sets, "as_of_date", statuses=HISTORY_STATUSES,
                              jurisdiction_col="jurisdiction").select(
        "o_orderkey", "jurisdiction", "as_of_date", "rule_set_id", "rule_set_effective_date")


def t4_as_known(spark, sf_dir):
    """Rule set in force on each order date in the order's jurisdiction, as it was
    known some time later; low priorities ask later."""
    delay = F.create_map(*[F.lit(x) for kv in AS_KNOWN_DAYS.items() for x in kv])[F.col("o_orderpriority")]
    amounts = dt.order_tax_amounts(spark, sf_dir).withColumn(
        "known_at", F.date_add("as_of_date", delay).cast("timestamp"))
    out = tax.as_known_rule_set(amounts, tax_cycle.example_publications(spark), "as_of_date", "known_at", "jurisdiction")
    return out.select("o_orderkey", "jurisdiction", "as_of_date", F.to_date("known_at").alias("known_at"), "rule_set_id",
                      "rule_set_effective_date")


def _tax_columns(df, key):
    return df.select(key, "amount", "rule_set_id", "rule_set_effective_date",
                     "tax_amount", "tax_status")


def t1_iva(spark, sf_dir):
    """IVA on every order total, with the rate in force on the order date."""
    rule_sets, rules = tax_cycle.example_rule_history(spark)
    amounts = dt.order_tax_amounts(spark, sf_dir).withColumn("tax_type", F.lit("IVA"))
    out = tax.calculate_tax(amounts, rule_sets, rules, as_of="as_of_date",
                            statuses=HISTORY_STATUSES)
    return _tax_columns(out, "o_orderkey")


def t2_isr(spark, sf_dir):
    """Monthly ISR brackets on every order total, as of the order date."""
    rule_sets, rules = tax_cycle.example_rule_history(spark)
    amounts = (dt.order_tax_amounts(spark, sf_dir)
               .withColumn("tax_type", F.lit("ISR"))
               .withColumn("applies_to", F.lit(tax.ISR_APPLIES_TO)))
    out = tax.calculate_tax(amounts, rule_sets, rules, applies_to="applies_to",
                            as_of="as_of_date", statuses=HISTORY_STATUSES)
    return _tax_columns(out, "o_orderkey")


def t2_isr_balances(spark, sf_dir):
    """T2 on customer balances with the active 2026 set (incomes <= 0 owe 0.00)."""
    rule_sets, rules = tax_cycle.example_rule_history(spark)
    amounts = (dt.customer_incomes(spark, sf_dir)
               .withColumn("tax_type", F.lit("ISR"))
               .withColumn("applies_to", F.lit(tax.ISR_APPLIES_TO)))
    out = tax.calculate_tax(amounts, rule_sets, rules, applies_to="applies_to",
                            as_of_date=BALANCES_AS_OF)
    return _tax_columns(out, "c_custkey")


def x11_rules_from_json(spark, sf_dir):
    """ISR on customer balances with the rules read from JSON text, as the
    reference stores them."""
    rule_sets, rules = tax_cycle.example_rule_history(spark)
    text = rules.withColumn("formula_expression", F.to_json("formula_expression"))
    amounts = (dt.customer_incomes(spark, sf_dir).withColumn("tax_type", F.lit("ISR"))
               .withColumn("applies_to", F.lit(tax.ISR_APPLIES_TO)))
    out = tax.calculate_tax(amounts, rule_sets, tax.rules_from_json(text), applies_to="applies_to", as_of_date=BALANCES_AS_OF)
    return _tax_columns(out, "c_custkey")


def t3_calculate_tax(spark, sf_dir):
    """Mixed IVA/ISR/RETENCION requests of two jurisdictions with ok / no_rule_set /
    no_rule / bad_tax_type outcomes."""
    rule_sets, rules = tax_cycle.example_rule_history(spark)
    out = tax.calculate_tax(typed_order_amounts(spark, sf_dir), rule_sets, rules,
                            applies_to="applies_to", as_of="as_of_date",
                            statuses=HISTORY_STATUSES, jurisdiction_col="jurisdiction")
    # the response fields of the calculation (tax_type, input_amount, tax_amount,
    # rule_set_id, rule_set_effective_date) plus the request key and outcome
    return out.select("o_orderkey", "tax_type", "applies_to",
                      F.col("amount").alias("input_amount"), "rule_set_id",
                      "rule_set_effective_date", "tax_amount", "tax_status")


def t5_publish(spark, sf_dir):
    """Draft a retroactive rule set, publish it over the history, then
    tax every order as of its date (history visible; the new set now covers
    1999-01-01 until the next publication)."""
    rule_sets, rules = tax_cycle.example_rule_history(spark)
    jurisdiction, eff, _, _, ref = T5_DRAFT
    rule_sets, rules, sid = tax.create_draft(
        spark, rule_sets, rules, tax_cycle._history_spec(*T5_DRAFT),
        tax_cycle.day_start(T5_CREATED), tax_cycle.example_set_id(jurisdiction, eff, ref))
    rule_sets = tax.publish(rule_sets, sid, "api_user", tax_cycle.day_start(T5_CREATED))
    amounts = dt.order_tax_amounts(spark, sf_dir).withColumn("tax_type", F.lit("IVA"))
    out = tax.calculate_tax(amounts, rule_sets, rules, as_of="as_of_date",
                            statuses=HISTORY_STATUSES)
    return _tax_columns(out, "o_orderkey")


def t5_atomic_switch(spark, sf_dir):
    """The rules of ``t5_publish`` as stored versions: a draft, a publish, and one
    from the version before, which loses; orders taxed with the latest version."""
    store = RuleStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/rules-{uuid4().hex}")
    store.swap(0, *tax_cycle.example_rule_history(spark))
    jurisdiction, eff, _, _, ref = T5_DRAFT
    created = tax_cycle.day_start(T5_CREATED)
    sid = store.add_draft(tax_cycle._history_spec(*T5_DRAFT), created, tax_cycle.example_set_id(jurisdiction, eff, ref))
    seen = store.version()
    store.publish(sid, "api_user", created)
    try:
        store.publish(sid, "late", created, seen=seen)
    except VersionConflict:
        pass
    else:
        raise AssertionError("two publishes from one version")
    amounts = dt.order_tax_amounts(spark, sf_dir).withColumn("tax_type", F.lit("IVA"))
    return _tax_columns(tax.calculate_tax(amounts, *store.load(), as_of="as_of_date", statuses=HISTORY_STATUSES), "o_orderkey")


def t8_approved_publish(spark, sf_dir):
    """Seed, monthly IVA-only draft, approval, publish; then tax every
    order as of the following month (ISR now has no rule, trap 7)."""
    rule_sets, rules, _ = tax_cycle.seed_rules(spark)
    draft_id = tax.rule_set_id("MX", MONTHLY_RUN_DATE, tax_cycle.day_start(MONTHLY_RUN_DATE))
    approvals = tax_cycle.approvals_frame(spark, [
        (draft_id, "approved", tax_cycle.day_start(MONTHLY_RUN_DATE))])
    rule_sets, rules, _ = tax_cycle.monthly_tax_update(
        spark, rule_sets, rules, MONTHLY_RUN_DATE, approvals)
    out = tax.calculate_tax(typed_order_amounts(spark, sf_dir), rule_sets, rules, applies_to="applies_to",
                            as_of_date=AFTER_MONTHLY_RUN)
    return out.select("o_orderkey", "tax_type", "applies_to", "amount", "rule_set_id",
                      "rule_set_effective_date", "tax_amount", "tax_status")


def _cashflow_stg(spark, sf_dir):
    return staging.stg_cashflow(dt.cashflow_events(spark, sf_dir))


def _transactions_stg(spark, sf_dir):
    return staging.stg_transactions(dt.transactions(spark, sf_dir))


def d1_unique(spark, sf_dir):
    """The two dbt unique tests, plus unique category ids."""
    return quality.summarize([
        ("stg_transactions", "transaction_id", "unique",
         quality.unique(_transactions_stg(spark, sf_dir), "transaction_id")),
        ("stg_cashflow", "cashflow_event_id", "unique",
         quality.unique(_cashflow_stg(spark, sf_dir), "cashflow_event_id")),
        ("core_category", "id", "unique", quality.unique(dt.categories(spark, sf_dir), "id")),
    ])


def d2_not_null(spark, sf_dir):
    """The five dbt not_null tests (each model checked in one scan)."""
    return (quality.null_counts(_transactions_stg(spark, sf_dir), "stg_transactions",
                                ["transaction_id", "amount"])
            .unionByName(quality.null_counts(_cashflow_stg(spark, sf_dir), "stg_cashflow",
                                             ["cashflow_event_id"]))
            .unionByName(quality.null_counts(cashflow_mart(spark, sf_dir),
                                             "mart_monthly_cashflow", ["month"]))
            .unionByName(quality.null_counts(flags_mart(spark, sf_dir),
                                             "mart_profitability_flags", ["category"])))


def d3_accepted_values(spark, sf_dir):
    """D3: enumerations of real columns, each narrower than the data, and the requested
    tax types."""
    return quality.union_all([
        quality.failures(dt.read_table(spark, sf_dir, "orders"), "orders", [
            ("o_orderstatus", "accepted_values", quality.not_accepted("o_orderstatus", ("F", "O"))),
            ("o_orderpriority", "accepted_values",
             quality.not_accepted("o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM")))]),
        quality.failures(dt.read_table(spark, sf_dir, "lineitem"), "lineitem", [
            ("l_returnflag", "accepted_values", quality.not_accepted("l_returnflag", ("A", "N")))]),
        quality.failures(_cashflow_stg(spark, sf_dir), "stg_cashflow", [
            ("event_type", "accepted_values", quality.not_accepted("event_type", schemas.EVENT_TYPES))]),
        quality.failures(typed_order_amounts(spark, sf_dir), "tax_requests", [
            ("tax_type", "accepted_values", quality.not_accepted("tax_type", tax.TAX_TYPES))]),
    ])


def d4_orphans(spark, sf_dir):
    """Foreign keys without a parent (categories are missing for large parts)."""
    def orphans(model, child, fk, parent, pk):
        rows, (orphan,) = quality.with_parents(child, [(fk, parent, pk)])
        return quality.failures(rows, model, [(fk, "relationships", orphan)])
    return quality.union_all([
        orphans("stg_transactions", _transactions_stg(spark, sf_dir), "category_id",
                dt.categories(spark, sf_dir), "id"),
        orphans("stg_cashflow", _cashflow_stg(spark, sf_dir), "entity_id",
                dt.read_table(spark, sf_dir, "nation"), "n_nationkey"),
        orphans("stg_inventory", staging.stg_inventory(dt.inventory_snapshots(spark, sf_dir)), "entity_id",
                dt.read_table(spark, sf_dir, "supplier"), "s_suppkey"),
    ])


def d6_limits(spark, sf_dir):
    """Varchar lengths and decimal precision of the raw values (one scan each)."""
    return quality.union_all([
        quality.failures(_transactions_stg(spark, sf_dir), "stg_transactions", [
            ("description", "max_length_500", quality.longer_than("description", 500)),
            ("source_doc_ref", "max_length_255", quality.longer_than("source_doc_ref", 255))]),
        quality.failures(dt.read_table(spark, sf_dir, "lineitem"), "lineitem", [
            ("l_quantity", "decimal_14_2", quality.not_a_decimal("l_quantity", 14, 2)),
            ("l_extendedprice", "decimal_12_2", quality.not_a_decimal("l_extendedprice", 12, 2)),
            ("l_discount", "decimal_3_1", quality.not_a_decimal("l_discount", 3, 1))]),
    ])


# Entities known before this date count as already loaded in s6.
S6_PREVIOUS_LOADS_BEFORE = "1998-01-01"


def d7_delete_closure(spark, sf_dir):
    """The transactions left after the entities (nations) of a region and the categories
    (parts, in a tree by tens) of one size are deleted with all that hangs on them."""
    read = lambda t: dt.read_table(spark, sf_dir, t)
    nation, part = read("nation"), read("part")
    tables = {
        "core_entity": nation.select(F.col("n_nationkey").cast("bigint").alias("id")),
        "core_account": read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("entity_id")),
        "core_category": part.select(F.col("p_partkey").alias("id"), F.expr("nullif(p_partkey div 10, 0)").alias("parent_id")),
        "core_transaction": dt.transactions(spark, sf_dir).select("id", "account_id", "category_id")}
    deleted = {"core_entity": nation.where("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("id")),
               "core_category": part.where("p_size = 1").select(F.col("p_partkey").alias("id"))}
    keys = [k for k in quality.FOREIGN_KEYS if k[0] in tables and k[2] in tables and k[1] != "parent_id"]
    after, _ = quality.delete_closure(tables, deleted, [*keys, ("core_category", "parent_id", "core_category", "cascade")])
    return after["core_transaction"].select(F.col("id").alias("transaction_id"), "account_id", "category_id")


def s6_new_dimension_rows(spark, sf_dir):
    """Entities a day's feed would create (get-or-create by rfc)."""
    from tesoro.sources.feed import DEFAULT_ENTITY_NAME, DEFAULT_ENTITY_TYPE, get_or_create
    from tesoro.functions.columns import deterministic_id
    feed = dt.customer_entities_feed(spark, sf_dir)
    cut = F.lit(S6_PREVIOUS_LOADS_BEFORE).cast("date")
    existing = feed.where(F.col("feed_date") < cut).select("rfc").distinct().select(
        deterministic_id(F.lit("entity"), "rfc").alias("id"), "rfc",
        F.lit(DEFAULT_ENTITY_NAME).alias("name"), F.lit(DEFAULT_ENTITY_TYPE).alias("entity_type"))
    incoming = feed.where(F.col("feed_date") >= cut)
    _, new_rows = get_or_create(
        existing, incoming, ["rfc"],
        lambda k: k.select(deterministic_id(F.lit("entity"), "rfc").alias("id"), "rfc",
                           F.lit(DEFAULT_ENTITY_NAME).alias("name"),
                           F.lit(DEFAULT_ENTITY_TYPE).alias("entity_type")))
    return new_rows


def p4_nested_extract(spark, sf_dir):
    """A field out of a JSON document column (explicit schema)."""
    ev = dt.events_props(spark, sf_dir)
    return ev.select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


# The load that the feed queries run: its time and the name of its batch.
FEED_LOAD_TS = "2026-01-01 00:00:00"
FEED_BATCH = "tables"


def feed_load(spark: SparkSession, sf_dir: str, *kinds: str) -> dict:
    """The tables written as feed files of the ``kinds``, parsed, typed and loaded into
    empty Bronze tables: S1 P4 P5 J2 S3-S7. Returns the rows added."""
    files = dt.feed_files(spark, sf_dir)
    parsed = [feed.parse_feed_files(files[kind], kind, FEED_BATCH) if kind in kinds else feed.empty_feed(spark, kind)
              for kind in feed.FEED_SCHEMAS]
    return feed.load_records(spark, *parsed, feed.empty_bronze(spark), FEED_LOAD_TS)[1]


def s1_feed_transactions(spark, sf_dir):
    """JSON invoices to Bronze transactions, one for each uuid."""
    return feed_load(spark, sf_dir, "transactions")["core_transaction"].drop("created_at", "confidence_score")


def s1_split_feed(spark, sf_dir):
    """Invoices from JSON-array files that are read by ranges, each record by itself."""
    records = feed.read_feed(spark, dt.invoice_arrays(spark, sf_dir), "transactions", FEED_BATCH, split=True)
    return feed.typed_transactions(records).drop("_source_file", "_pos")


def s4_feed_cashflow(spark, sf_dir):
    """JSON cash-flow records to Bronze."""
    return feed_load(spark, sf_dir, "cashflow")["core_cashflowevent"]


def s5_feed_inventory(spark, sf_dir):
    """JSON inventory snapshots to Bronze."""
    return feed_load(spark, sf_dir, "inventory")["core_inventorysnapshot"]


def s7_load_counts(spark, sf_dir):
    """Rows added and rejected by the load, and repeated entity keys."""
    added = feed_load(spark, sf_dir, *feed.FEED_SCHEMAS)
    repeated = quality.unique(added["core_entity"], "rfc").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("repeated_rfc").alias("table"), "rows")
    return feed.load_counts(added).unionByName(repeated)


def f1_forecast(spark, sf_dir):
    """Six-month forecast for every entity of the cash-flow mart."""
    forecasts, _ = forecast.forecast_refresh(cashflow_mart(spark, sf_dir))
    return forecasts


def p11_history_gate(spark, sf_dir):
    """Which entities can be forecast, with the rejection reason."""
    return forecast.history_summary(cashflow_mart(spark, sf_dir))


def x13_forecast_months(spark, sf_dir):
    """The six forecast month ends of every eligible entity."""
    return forecast.forecast_months(cashflow_mart(spark, sf_dir))


def n1_anomalies(spark, sf_dir):
    """Months in the most anomalous tenth of each entity's monthly net cash flow."""
    return anomaly.detect_cashflow_anomalies(cashflow_mart(spark, sf_dir))


QUERIES = {
    "a1_monthly_cashflow": a1_monthly_cashflow,
    "s9_cashflow_read": s9_cashflow_read,
    "w5_duplicate_flags": w5_duplicate_flags,
    "w5_hot_group": w5_hot_group,
    "u1_fuzzy_duplicates": u1_fuzzy_duplicates,
    "a2_expense_summary": a2_expense_summary,
    "w3_rolling_trend": w3_rolling_trend,
    "r2_cost_spikes": r2_cost_spikes,
    "r1_duplicate_report": r1_duplicate_report,
    "r3_cost_spike_report": r3_cost_spike_report,
    "r1_one_account": r1_one_account,
    "r3_one_account": r3_one_account,
    "s9_one_entity": s9_one_entity,
    "s10_one_entity": s10_one_entity,
    "s1_feed_transactions": s1_feed_transactions,
    "s1_split_feed": s1_split_feed,
    "s4_feed_cashflow": s4_feed_cashflow,
    "s5_feed_inventory": s5_feed_inventory,
    "s7_load_counts": s7_load_counts,
    "a3_inventory_turnover": a3_inventory_turnover,
    "s10_inventory_read": s10_inventory_read,
    "n2_slow_moving": n2_slow_moving,
    "j3_asof_rule_set": j3_asof_rule_set,
    "t4_as_known": t4_as_known,
    "t1_iva": t1_iva,
    "t2_isr": t2_isr,
    "t2_isr_balances": t2_isr_balances,
    "x11_rules_from_json": x11_rules_from_json,
    "t3_calculate_tax": t3_calculate_tax,
    "t5_publish": t5_publish,
    "t5_atomic_switch": t5_atomic_switch,
    "t8_approved_publish": t8_approved_publish,
    "d1_unique": d1_unique,
    "d2_not_null": d2_not_null,
    "d3_accepted_values": d3_accepted_values,
    "d4_orphans": d4_orphans,
    "d6_limits": d6_limits,
    "d7_delete_closure": d7_delete_closure,
    "s6_new_dimension_rows": s6_new_dimension_rows,
    "p4_nested_extract": p4_nested_extract,
    "p11_history_gate": p11_history_gate,
    "x13_forecast_months": x13_forecast_months,
    "f1_forecast": f1_forecast,
    "n1_anomalies": n1_anomalies,
}
