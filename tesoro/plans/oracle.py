"""DuckDB oracle SQL for the registered queries (driver correctness gate).

These strings are *test oracles*, written independently of the Spark code in
plain SQL over the pre-registered driver views. They state the reference's
semantics directly; where DuckDB would fall back to DOUBLE (``avg`` of decimals,
decimal division) the SQL uses exact integer arithmetic or casts to the same
DECIMAL type the Spark side produces, so both engines return equal values.
"""

from __future__ import annotations

# ---- reference-shaped views over the driver tables -------------------

STG_CASHFLOW = """
stg_cashflow AS (
    SELECT o.o_orderkey AS cashflow_event_id,
           c.c_nationkey AS entity_id,
           CAST(o.o_orderdate AS DATE) AS event_date,
           CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
                THEN 'inflow' ELSE 'outflow' END AS event_type,
           CAST(o.o_totalprice AS DECIMAL(14,2)) AS amount,
           o.o_orderstatus = 'P' AS projected
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)"""

MART_CASHFLOW = STG_CASHFLOW + """,
mart_cashflow AS (
    SELECT entity_id,
           CAST(date_trunc('month', event_date) AS DATE) AS month,
           CAST(sum(CASE WHEN event_type = 'inflow' THEN amount ELSE 0 END) AS DECIMAL(24,2)) AS total_flow,
           CAST(sum(CASE WHEN event_type = 'outflow' THEN amount ELSE 0 END) AS DECIMAL(24,2)) AS total_outflow,
           CAST(sum(CASE WHEN event_type = 'inflow' THEN amount ELSE -amount END) AS DECIMAL(24,2)) AS net_cashflow
    FROM stg_cashflow
    WHERE NOT projected
    GROUP BY 1, 2
)"""

STG_TRANSACTIONS = """
stg_transactions AS (
    SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'),
                          lpad(CAST(l_linenumber AS VARCHAR), 4, '0'),
                          lpad(CAST(l_partkey AS VARCHAR), 12, '0'),
                          lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0'))
             AS transaction_id,
           l_suppkey AS account_id,
           l_partkey AS category_id,
           CAST(l_shipdate AS DATE) AS transaction_date,
           CAST(l_quantity AS DECIMAL(14,2)) AS amount,
           'order ' || CAST(l_orderkey AS VARCHAR) || ' line ' || CAST(l_linenumber AS VARCHAR) AS description,
           l_shipdate AS created_at
    FROM lineitem
)"""

DEDUPED = STG_TRANSACTIONS + """,
ranked AS (
    SELECT *,
           count(*) OVER (PARTITION BY account_id, amount, transaction_date) AS dup_group_size,
           CAST(row_number() OVER (PARTITION BY account_id, amount, transaction_date
                                   ORDER BY created_at ASC NULLS LAST,
                                            transaction_id ASC NULLS LAST) AS INTEGER) AS dup_rank
    FROM stg_transactions
),
deduped AS (
    SELECT *, dup_group_size > 1 AS is_likely_duplicate, dup_rank > 1 AS is_duplicate_secondary
    FROM ranked
)"""

EXPENSE = DEDUPED + """,
categories AS (
    SELECT p_partkey AS id, p_type AS name FROM part WHERE p_size <= 40
),
expense AS (
    SELECT t.account_id,
           CAST(date_trunc('month', t.transaction_date) AS DATE) AS month,
           c.name AS category,
           count(*) FILTER (WHERE NOT t.is_duplicate_secondary) AS transaction_count,
           CAST(sum(t.amount) FILTER (WHERE NOT t.is_duplicate_secondary) AS DECIMAL(24,2)) AS total_amount,
           count(*) FILTER (WHERE t.is_likely_duplicate) AS flagged_duplicate_count
    FROM deduped t LEFT JOIN categories c ON t.category_id = c.id
    GROUP BY 1, 2, 3
)"""

FLAGS = EXPENSE + """,
trend AS (
    SELECT account_id, category, month, total_amount,
           CAST(avg(total_amount) OVER w6 AS DECIMAL(28,6)) AS rolling_6mo_avg,
           CAST(total_amount * 100 AS BIGINT) AS t,
           CAST(sum(total_amount) OVER w6 * 100 AS BIGINT) AS s,
           count(total_amount) OVER w6 AS n
    FROM expense
    WINDOW w6 AS (PARTITION BY account_id, category ORDER BY month
                  ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
),
spikes AS (
    SELECT *, sign(t * n - s) * ((2000 * abs(t * n - s) + s) // (2 * s)) AS th
    FROM trend
    WHERE s > 0 AND t * n * 10 > s * 13
),
flags AS (
    SELECT account_id, category, month, total_amount, rolling_6mo_avg,
           CAST(CAST(th AS DECIMAL(20,0)) * 0.001 AS DECIMAL(20,3)) AS pct_above_rolling_avg,
           true AS is_cost_spike,
           'Category spend ' || CAST(CAST(CAST(th AS DECIMAL(20,0)) * 0.1 AS DECIMAL(20,1)) AS VARCHAR)
             || '% above 6-month rolling average — review for waste' AS flag_reason
    FROM spikes
)"""

INVENTORY_MART = """
stg_inventory AS (
    SELECT l_suppkey AS entity_id,
           l_partkey AS sku,
           CAST(l_shipdate AS DATE) AS snapshot_date,
           CAST(l_quantity AS INTEGER) AS quantity,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_cost,
           l_discount * 10 AS turnover_rate
    FROM lineitem
),
turnover AS (
    SELECT entity_id, sku,
           CAST(date_trunc('month', snapshot_date) AS DATE) AS month,
           CAST(avg(quantity) AS DECIMAL(14,4)) AS avg_qty,
           CAST(avg(CAST(turnover_rate AS DECIMAL(18,6))) AS DECIMAL(22,10)) AS avg_turnover_rate,
           CAST(CAST(avg(unit_cost) AS DECIMAL(16,6)) * CAST(avg(quantity) AS DECIMAL(14,4))
                AS DECIMAL(31,10)) AS inventory_value
    FROM stg_inventory
    GROUP BY 1, 2, 3
)"""


def half_even_mean(sum_expr: str, count_expr: str, in_scale: int, out_scale: int,
                   precision: int) -> str:
    """Exact ``bround(sum/count, out_scale)`` for a non-negative DECIMAL sum."""
    units = f"CAST({sum_expr} * {10 ** in_scale} AS HUGEINT)"
    den = f"(CAST({count_expr} AS HUGEINT) * {10 ** (in_scale - out_scale)})"
    q = f"({units} // {den})"
    r = f"({units} - {q} * {den})"
    rounded = (f"({q} + CASE WHEN 2 * {r} > {den} THEN 1 "
               f"WHEN 2 * {r} = {den} THEN {q} % 2 ELSE 0 END)")
    return (f"CAST(CAST({rounded} AS DECIMAL(38,0)) * {10.0 ** -out_scale:.{out_scale}f} "
            f"AS DECIMAL({precision},{out_scale}))")


_RATE3 = half_even_mean("rs", "rn", 10, 3, 20)

ORACLE = {
    "a1_monthly_cashflow": "WITH " + MART_CASHFLOW + """
SELECT entity_id, month, total_flow, total_outflow, net_cashflow FROM mart_cashflow""",

    "s9_cashflow_read": "WITH " + MART_CASHFLOW + """
SELECT entity_id, month, total_flow AS total_inflow, total_outflow, net_cashflow,
       row_number() OVER (ORDER BY entity_id, month) AS position
FROM mart_cashflow""",

    "w5_duplicate_flags": "WITH " + DEDUPED + """
SELECT transaction_id, account_id, category_id, transaction_date, amount,
       dup_group_size, dup_rank, is_likely_duplicate, is_duplicate_secondary
FROM deduped""",

    "a2_expense_summary": "WITH " + EXPENSE + """
SELECT * FROM expense""",

    "w3_rolling_trend": "WITH " + EXPENSE + """
SELECT account_id, category, month, total_amount,
       CAST(avg(total_amount) OVER (PARTITION BY account_id, category ORDER BY month
            ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS DECIMAL(28,6)) AS rolling_6mo_avg,
       lag(total_amount, 1) OVER (PARTITION BY account_id, category ORDER BY month) AS prev_month_amount
FROM expense""",

    "r2_cost_spikes": "WITH " + FLAGS + """
SELECT * FROM flags""",

    "r1_duplicate_report": "WITH " + DEDUPED + """
SELECT transaction_id, account_id, transaction_date, amount, description, dup_group_size, dup_rank,
       row_number() OVER (ORDER BY transaction_date, amount, account_id, dup_rank) AS position
FROM deduped WHERE is_likely_duplicate""",

    "r3_cost_spike_report": "WITH " + FLAGS + """
SELECT account_id, category, month, total_amount, rolling_6mo_avg, pct_above_rolling_avg, flag_reason,
       row_number() OVER (ORDER BY month DESC NULLS FIRST, account_id, category) AS position
FROM flags""",

    "a3_inventory_turnover": "WITH " + INVENTORY_MART + """
SELECT * FROM turnover""",

    "s10_inventory_read": "WITH " + INVENTORY_MART + """
SELECT entity_id, sku, month, avg_qty, avg_turnover_rate, inventory_value,
       row_number() OVER (ORDER BY entity_id, sku, month) AS position
FROM turnover""",

    "n2_slow_moving": "WITH " + INVENTORY_MART + """,
summary AS (
    SELECT entity_id, sku,
           sum(avg_turnover_rate) AS rs, count(avg_turnover_rate) AS rn,
           sum(inventory_value) AS vs, count(inventory_value) AS vn,
           count(month) AS months_tracked
    FROM turnover GROUP BY 1, 2
)
SELECT entity_id, sku,
       """ + _RATE3 + """ AS avg_turnover_rate,
       """ + half_even_mean("vs", "vn", 10, 2, 24) + """ AS avg_inventory_value,
       'Turnover rate ' || CAST(""" + _RATE3 + """ AS VARCHAR)
         || ' below threshold 0.4 — capital tied up in slow-moving stock' AS reason
FROM summary
WHERE rs < 0.4 * rn AND months_tracked > 0""",
}


# ---- tax engine -------------------------------------------------------------------

def _tax_sql() -> dict:
    from tesoro.operators import tax

    # the 2026 tariff: fixed values
    brackets_values = ", ".join(
        f"({i}, CAST('{lo}' AS DECIMAL(14,2)), "
        f"{'NULL' if hi is None else f'CAST({chr(39)}{hi}{chr(39)} AS DECIMAL(14,2))'}, "
        f"CAST('{fee}' AS DECIMAL(14,2)), CAST('{rate}' AS DECIMAL(8,4)))"
        for i, (lo, hi, fee, rate) in enumerate(tax.ISR_MONTHLY_BRACKETS_2026))
    isr_to = "personas_fisicas_mensual"

    # the visible sets: example publications in their order, then the seed; of two sets
    # of one date the one published last counts
    history = [("US", "1990-01-01", "0.07", 30, "jurisdiction"), ("MX", "1995-04-01", "0.15", 50, "1995"),
               ("MX", "1998-01-01", "0.14", 60, "replaced"), ("MX", "1998-01-01", "0.12", 75, "1998"),
               ("US", "1999-07-01", "0.08", 40, "later"), ("MX", "2000-07-01", "0.16", 80, "2000")]

    def sets(extra=()):
        rows = [f"({i}, '{jur}', '{jur}-{eff}-{name}', DATE '{eff}', CAST('{rate}' AS DECIMAL(6,4)), {pct})"
                for i, (jur, eff, rate, pct, name) in enumerate([*history, *extra])]
        rows.append("(99, 'MX', 'MX-20260101-' || substr(sha256('MX|2026-01-01|2026-01-01 00:00:00'), 1, 12), "
                    "DATE '2026-01-01', CAST('0.16' AS DECIMAL(6,4)), 100)")
        return f"""
published(seq, jur, id, effective_date, iva_rate, pct) AS (VALUES {', '.join(rows)}),
sets AS (
    SELECT * FROM published QUALIFY row_number() OVER (PARTITION BY jur, effective_date ORDER BY seq DESC) = 1
),
tariff(idx, lo, hi, fee, rate) AS (VALUES {brackets_values}),
brackets AS (
    SELECT s.id AS set_id, b.idx, b.lo, b.hi,
           CAST(round_even(CAST(b.fee AS DECIMAL(18,2)) * s.pct * CAST('0.01' AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) AS fee,
           CAST(round_even(CAST(b.rate AS DECIMAL(18,4)) * s.pct * CAST('0.01' AS DECIMAL(4,2)), 4) AS DECIMAL(8,4)) AS rate
    FROM sets s, tariff b
)"""

    def isr(table: str, key: str) -> str:
        # first matching bracket of the request's set (list order), as a range join
        return f"""
isr_pick AS (
    SELECT r.{key}, min(b.idx) AS idx
    FROM {table} r JOIN brackets b ON b.set_id = r.rule_set_id
     AND b.lo <= r.amount AND (b.hi IS NULL OR b.hi = 0 OR r.amount <= b.hi)
    GROUP BY 1
),
isr_tax AS (
    SELECT p.{key}, CAST(round_even(b.fee + (r.amount - b.lo) * b.rate, 2) AS DECIMAL(14,2)) AS isr
    FROM isr_pick p JOIN {table} r ON r.{key} = p.{key} JOIN brackets b ON b.idx = p.idx AND b.set_id = r.rule_set_id
)"""

    def matched(jur: str) -> str:
        return f"""
ord AS (
    SELECT o_orderkey, o_orderstatus, o_orderpriority,
           CAST(o_totalprice AS DECIMAL(14,2)) AS amount,
           CAST(o_orderdate AS DATE) AS as_of_date, {jur} AS jur
    FROM orders
),
matched AS (
    SELECT o.*, s.id AS rule_set_id, s.effective_date AS rule_set_effective_date, s.iva_rate
    FROM ord o ASOF LEFT JOIN sets s
      ON o.jur = s.jur AND o.as_of_date >= s.effective_date
)"""

    by_customer = "CASE WHEN o_custkey % 5 = 0 THEN 'US' ELSE 'MX' END"
    iva = """
SELECT o_orderkey, amount, rule_set_id, rule_set_effective_date,
       CASE WHEN rule_set_id IS NULL THEN NULL
            ELSE CAST(round_even(amount * iva_rate, 2) AS DECIMAL(14,2)) END AS tax_amount,
       CASE WHEN rule_set_id IS NULL THEN 'no_rule_set' ELSE 'ok' END AS tax_status
FROM matched"""
    out = {}
    out["t1_iva"] = "WITH " + sets() + "," + matched("'MX'") + iva
    out["t5_publish"] = ("WITH " + sets([("MX", "1999-01-01", "0.10", 90, "retroactive")]) + ","
                         + matched("'MX'") + iva)
    out["t5_atomic_switch"] = out["t5_publish"]
    out["j3_asof_rule_set"] = "WITH " + sets() + "," + matched(by_customer) + """
SELECT o_orderkey, jur AS jurisdiction, as_of_date, rule_set_id, rule_set_effective_date FROM matched"""
    out["t2_isr"] = "WITH " + sets() + "," + matched("'MX'") + "," + isr("matched", "o_orderkey") + """
SELECT m.o_orderkey, m.amount, m.rule_set_id, m.rule_set_effective_date,
       CASE WHEN m.rule_set_id IS NULL THEN NULL
            ELSE coalesce(t.isr, CAST(0 AS DECIMAL(14,2))) END AS tax_amount,
       CASE WHEN m.rule_set_id IS NULL THEN 'no_rule_set' ELSE 'ok' END AS tax_status
FROM matched m LEFT JOIN isr_tax t ON t.o_orderkey = m.o_orderkey"""
    out["t2_isr_balances"] = "WITH " + sets() + """,
bal AS (
    SELECT c_custkey, CAST(c_acctbal AS DECIMAL(14,2)) AS amount, s.id AS rule_set_id,
           s.effective_date AS rule_set_effective_date
    FROM customer, sets s WHERE s.seq = 99
),""" + isr("bal", "c_custkey") + """
SELECT b.c_custkey, b.amount, b.rule_set_id, b.rule_set_effective_date,
       coalesce(t.isr, CAST(0 AS DECIMAL(14,2))) AS tax_amount, 'ok' AS tax_status
FROM bal b LEFT JOIN isr_tax t ON t.c_custkey = b.c_custkey"""

    tax_type = ("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'IVA' "
                "WHEN o_orderpriority = '5-LOW' THEN 'RETENCION' ELSE 'ISR' END")
    out["t3_calculate_tax"] = "WITH " + sets() + "," + matched(by_customer) + f""",
typed AS (SELECT m.*, {tax_type} AS tax_type FROM matched m),
req AS (
    SELECT *, CASE WHEN o_orderstatus = 'P' OR tax_type = 'IVA' THEN 'general' ELSE '{isr_to}' END AS applies_to
    FROM typed
),""" + isr("req", "o_orderkey") + f""",
answered AS (
    SELECT r.*, t.isr,
           CASE WHEN tax_type NOT IN ('IVA', 'ISR') THEN 'bad_tax_type'
                WHEN rule_set_id IS NULL THEN 'no_rule_set'
                WHEN tax_type = 'IVA' OR applies_to = '{isr_to}' THEN 'ok'
                ELSE 'no_rule' END AS tax_status
    FROM req r LEFT JOIN isr_tax t ON t.o_orderkey = r.o_orderkey
)
SELECT o_orderkey, tax_type, applies_to, amount AS input_amount, rule_set_id, rule_set_effective_date,
       CASE WHEN tax_status <> 'ok' THEN NULL
            WHEN tax_type = 'IVA' THEN CAST(round_even(amount * iva_rate, 2) AS DECIMAL(14,2))
            ELSE coalesce(isr, CAST(0 AS DECIMAL(14,2))) END AS tax_amount, tax_status
FROM answered"""

    out["t8_approved_publish"] = f"""
WITH req AS (
    SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(14,2)) AS amount, {tax_type} AS tax_type, o_orderstatus
    FROM orders
)
SELECT o_orderkey, tax_type,
       CASE WHEN o_orderstatus = 'P' OR tax_type = 'IVA' THEN 'general' ELSE '{isr_to}' END AS applies_to,
       amount, 'MX-20260201-' || substr(sha256('MX|2026-02-01|2026-02-01 00:00:00'), 1, 12) AS rule_set_id,
       DATE '2026-02-01' AS rule_set_effective_date,
       CASE WHEN tax_type = 'IVA' THEN CAST(round_even(amount * CAST('0.16' AS DECIMAL(6,4)), 2) AS DECIMAL(14,2))
            ELSE NULL END AS tax_amount,
       CASE WHEN tax_type = 'IVA' THEN 'ok' WHEN tax_type = 'ISR' THEN 'no_rule' ELSE 'bad_tax_type' END AS tax_status
FROM req"""
    return out


ORACLE.update(_tax_sql())


ORACLE["x11_rules_from_json"] = ORACLE["t2_isr_balances"]

ORACLE["t4_as_known"] = """
WITH sets(jur, id, effective_date, published) AS (VALUES
    ('US', 'US-1990-01-01-jurisdiction', DATE '1990-01-01', DATE '1990-01-01'),
    ('MX', 'MX-1995-04-01-1995', DATE '1995-04-01', DATE '1995-04-01'),
    ('MX', 'MX-1998-01-01-replaced', DATE '1998-01-01', DATE '1997-12-15'),
    ('MX', 'MX-1998-01-01-1998', DATE '1998-01-01', DATE '1998-06-01'),
    ('US', 'US-1999-07-01-later', DATE '1999-07-01', DATE '1999-07-01'),
    ('MX', 'MX-2000-07-01-2000', DATE '2000-07-01', DATE '2001-01-01')),
o AS (
    SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'US' ELSE 'MX' END AS jurisdiction,
           CAST(o_orderdate AS DATE) AS as_of_date,
           CAST(o_orderdate AS DATE) + CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 60
               WHEN '3-MEDIUM' THEN 180 WHEN '4-NOT SPECIFIED' THEN 365 WHEN '5-LOW' THEN 1000 END AS known_at
    FROM orders)
SELECT o_orderkey, jurisdiction, as_of_date, known_at, id AS rule_set_id, effective_date AS rule_set_effective_date
FROM o LEFT JOIN sets ON jur = jurisdiction AND effective_date <= as_of_date AND published <= known_at
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY effective_date DESC, published DESC, id DESC) = 1"""


# ---- quality, dimensions, JSON -----------------------------------------------------

def _summary(rows):
    return "\nUNION ALL\n".join(
        f"SELECT '{m}' AS model, '{c}' AS column_name, '{t}' AS test, "
        f"(SELECT count(*) FROM ({q})) AS failures" for m, c, t, q in rows)


ORACLE["d1_unique"] = "WITH " + STG_TRANSACTIONS + "," + STG_CASHFLOW + """,
core_category AS (SELECT p_partkey AS id FROM part WHERE p_size <= 40)
""" + _summary([
    ("stg_transactions", "transaction_id", "unique",
     "SELECT transaction_id FROM stg_transactions WHERE transaction_id IS NOT NULL "
     "GROUP BY 1 HAVING count(*) > 1"),
    ("stg_cashflow", "cashflow_event_id", "unique",
     "SELECT cashflow_event_id FROM stg_cashflow WHERE cashflow_event_id IS NOT NULL "
     "GROUP BY 1 HAVING count(*) > 1"),
    ("core_category", "id", "unique",
     "SELECT id FROM core_category WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
])

ORACLE["d2_not_null"] = "WITH " + FLAGS + "," + MART_CASHFLOW + "\n" + _summary([
    ("stg_transactions", "transaction_id", "not_null",
     "SELECT 1 FROM stg_transactions WHERE transaction_id IS NULL"),
    ("stg_transactions", "amount", "not_null", "SELECT 1 FROM stg_transactions WHERE amount IS NULL"),
    ("stg_cashflow", "cashflow_event_id", "not_null",
     "SELECT 1 FROM stg_cashflow WHERE cashflow_event_id IS NULL"),
    ("mart_monthly_cashflow", "month", "not_null", "SELECT 1 FROM mart_cashflow WHERE month IS NULL"),
    ("mart_profitability_flags", "category", "not_null",
     "SELECT 1 FROM flags WHERE category IS NULL"),
])

ORACLE["d3_accepted_values"] = "WITH " + STG_CASHFLOW + "\n" + _summary([
    ("orders", "o_orderstatus", "accepted_values",
     "SELECT 1 FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')"),
    ("orders", "o_orderpriority", "accepted_values",
     "SELECT 1 FROM orders WHERE o_orderpriority IS NOT NULL "
     "AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"),
    ("lineitem", "l_returnflag", "accepted_values",
     "SELECT 1 FROM lineitem WHERE l_returnflag IS NOT NULL AND l_returnflag NOT IN ('A', 'N')"),
    ("stg_cashflow", "event_type", "accepted_values",
     "SELECT 1 FROM stg_cashflow WHERE event_type IS NOT NULL AND event_type NOT IN ('inflow', 'outflow')"),
    ("tax_requests", "tax_type", "accepted_values",
     "SELECT 1 FROM orders WHERE o_orderpriority = '5-LOW'"),
])

ORACLE["d4_orphans"] = "WITH " + STG_TRANSACTIONS + "," + STG_CASHFLOW + "\n" + _summary([
    ("stg_transactions", "category_id", "relationships",
     "SELECT 1 FROM stg_transactions t WHERE t.category_id IS NOT NULL AND NOT EXISTS "
     "(SELECT 1 FROM part p WHERE p.p_size <= 40 AND p.p_partkey = t.category_id)"),
    ("stg_cashflow", "entity_id", "relationships",
     "SELECT 1 FROM stg_cashflow c WHERE c.entity_id IS NOT NULL AND NOT EXISTS "
     "(SELECT 1 FROM nation n WHERE n.n_nationkey = c.entity_id)"),
    ("stg_inventory", "entity_id", "relationships",
     "SELECT 1 FROM lineitem l WHERE l.l_suppkey IS NOT NULL AND NOT EXISTS "
     "(SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey)"),
])


def _not_decimal(col, p, s):
    return (f"SELECT 1 FROM lineitem WHERE {col} IS NOT NULL AND ("
            f"TRY_CAST({col} AS DECIMAL({p},{s})) IS NULL OR "
            f"CAST(TRY_CAST({col} AS DECIMAL({p},{s})) AS DECIMAL(38,10)) <> TRY_CAST({col} AS DECIMAL(38,10)))")


ORACLE["d6_limits"] = "WITH " + STG_TRANSACTIONS + "\n" + _summary([
    ("stg_transactions", "description", "max_length_500",
     "SELECT 1 FROM stg_transactions WHERE length(description) > 500"),
    ("stg_transactions", "source_doc_ref", "max_length_255",
     "SELECT 1 FROM stg_transactions WHERE length(transaction_id) > 255"),
    ("lineitem", "l_quantity", "decimal_14_2", _not_decimal("l_quantity", 14, 2)),
    ("lineitem", "l_extendedprice", "decimal_12_2", _not_decimal("l_extendedprice", 12, 2)),
    ("lineitem", "l_discount", "decimal_3_1", _not_decimal("l_discount", 3, 1)),
])

ORACLE["s6_new_dimension_rows"] = """
WITH feed AS (
    SELECT 'C' || lpad(CAST(c.c_custkey AS VARCHAR), 12, '0') AS rfc, CAST(o.o_orderdate AS DATE) AS feed_date
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
new_rfc AS (
    SELECT DISTINCT rfc FROM feed WHERE feed_date >= DATE '1998-01-01' AND rfc IS NOT NULL
    EXCEPT
    SELECT rfc FROM feed WHERE feed_date < DATE '1998-01-01'
)
SELECT sha256('entity|' || rfc) AS id, rfc, 'Synthetic Test Entity SA de CV' AS name,
       'persona_moral' AS entity_type
FROM new_rfc"""

# ---- one account or entity, and the feed load --------------------------------------

_ONE_ACCOUNT = "SELECT * EXCLUDE (position) FROM ({}) WHERE account_id = 7"
ORACLE["r1_one_account"] = _ONE_ACCOUNT.format(ORACLE["r1_duplicate_report"])
ORACLE["r3_one_account"] = _ONE_ACCOUNT.format(ORACLE["r3_cost_spike_report"])
ORACLE["s9_one_entity"] = "WITH " + MART_CASHFLOW + """
SELECT month, total_flow AS total_inflow, total_outflow, net_cashflow FROM mart_cashflow WHERE entity_id = 7"""
ORACLE["s10_one_entity"] = "WITH " + INVENTORY_MART + """
SELECT sku, month, avg_qty, avg_turnover_rate, inventory_value FROM turnover WHERE entity_id = 7"""

_SUPPLIER = "sha256('entity|S' || lpad(CAST(l_suppkey AS VARCHAR), 11, '0'))"
_CUSTOMER = "sha256('entity|C' || lpad(CAST(o_custkey AS VARCHAR), 11, '0'))"
# cash-flow records that load: they have a date
_LOADED_ORDER = "o_orderdate IS NOT NULL"

ORACLE["s1_feed_transactions"] = "WITH " + STG_TRANSACTIONS + f"""
SELECT DISTINCT sha256('txn|' || t.transaction_id) AS id, sha256('account|' || {_SUPPLIER} || '|checking') AS account_id,
       sha256('category|' || l_returnflag) AS category_id, t.transaction_date AS date, t.amount,
       'line ' || CAST(l_linenumber AS VARCHAR) AS description, t.transaction_id AS source_doc_ref,
       false AS is_duplicate_flag
FROM stg_transactions t JOIN lineitem ON t.transaction_id = concat_ws('-',
     lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), lpad(CAST(l_linenumber AS VARCHAR), 4, '0'),
     lpad(CAST(l_partkey AS VARCHAR), 12, '0'), lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0'))"""

ORACLE["s1_split_feed"] = """
SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), lpad(CAST(l_linenumber AS VARCHAR), 4, '0'),
                 lpad(CAST(l_partkey AS VARCHAR), 12, '0'),
                 lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0')) AS source_doc_ref,
       'S' || lpad(CAST(l_suppkey AS VARCHAR), 11, '0') AS entity_rfc, CAST(l_shipdate AS DATE) AS date,
       CAST(l_quantity AS DECIMAL(14,2)) AS amount, l_returnflag AS category_name,
       'line ' || CAST(l_linenumber AS VARCHAR) AS description
FROM lineitem, range(2)"""

ORACLE["s4_feed_cashflow"] = f"""
SELECT sha256('cashflow|tables|' || CAST(o_orderkey AS VARCHAR) || '|0') AS id, {_CUSTOMER} AS entity_id,
       CAST(o_orderdate AS DATE) AS date,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'inflow' ELSE 'outflow' END AS event_type,
       CAST(o_totalprice AS DECIMAL(14,2)) AS amount, false AS projected, 'tables' AS batch_id
FROM orders WHERE {_LOADED_ORDER}"""

ORACLE["s5_feed_inventory"] = "WITH " + STG_TRANSACTIONS + f"""
SELECT sha256('inventory|tables|' || concat_ws('-',
         lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), lpad(CAST(l_linenumber AS VARCHAR), 4, '0'),
         lpad(CAST(l_partkey AS VARCHAR), 12, '0'),
         lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0')) || '|0') AS id,
       {_SUPPLIER} AS entity_id, CAST(l_partkey AS VARCHAR) AS sku, CAST(l_shipdate AS DATE) AS date,
       CAST(l_quantity AS INTEGER) AS qty, CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_cost,
       CAST(l_discount AS DOUBLE) AS turnover_rate, 'tables' AS batch_id
FROM lineitem"""

ORACLE["s7_load_counts"] = "WITH " + STG_TRANSACTIONS + f"""
SELECT 'core_entity' AS "table", (SELECT count(DISTINCT l_suppkey) FROM lineitem)
       + (SELECT count(DISTINCT o_custkey) FROM orders WHERE {_LOADED_ORDER}) AS "rows"
UNION ALL SELECT 'core_account', (SELECT count(DISTINCT l_suppkey) FROM lineitem)
UNION ALL SELECT 'core_category', (SELECT count(DISTINCT l_returnflag) FROM lineitem)
UNION ALL SELECT 'core_transaction', (SELECT count(DISTINCT transaction_id) FROM stg_transactions)
UNION ALL SELECT 'core_cashflowevent', (SELECT count(*) FROM orders WHERE {_LOADED_ORDER})
UNION ALL SELECT 'core_inventorysnapshot', (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'rejected_transactions', 0
UNION ALL SELECT 'rejected_cashflow', (SELECT count(*) FROM orders WHERE NOT ({_LOADED_ORDER}))
UNION ALL SELECT 'rejected_inventory', 0
UNION ALL SELECT 'repeated_rfc', 0"""

ORACLE["w5_hot_group"] = "WITH " + STG_TRANSACTIONS + """,
g AS (SELECT transaction_id, CAST(regexp_extract(description, 'line ([0-9]+)', 1) AS BIGINT) AS account_id,
             CAST(date_trunc('year', transaction_date) AS DATE) AS transaction_date, created_at
      FROM stg_transactions)
SELECT transaction_id, account_id, transaction_date,
       count(*) OVER (PARTITION BY account_id, transaction_date) AS dup_group_size,
       CAST(row_number() OVER w AS INTEGER) AS dup_rank, row_number() OVER w > 1 AS is_duplicate_secondary
FROM g WINDOW w AS (PARTITION BY account_id, transaction_date ORDER BY created_at, transaction_id)"""

ORACLE["d7_delete_closure"] = "WITH RECURSIVE " + STG_TRANSACTIONS.strip() + """,
gone(id) AS (
    SELECT p_partkey FROM part WHERE p_size = 1
    UNION
    SELECT p_partkey FROM part JOIN gone ON p_partkey // 10 = gone.id AND p_partkey >= 10),
gone_account AS (SELECT s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)
SELECT transaction_id, account_id, CASE WHEN category_id NOT IN (SELECT id FROM gone) THEN category_id END AS category_id
FROM stg_transactions WHERE account_id NOT IN (SELECT id FROM gone_account)"""

ORACLE["u1_fuzzy_duplicates"] = """
WITH t AS (
    SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), lpad(CAST(l_linenumber AS VARCHAR), 4, '0'),
                     lpad(CAST(l_partkey AS VARCHAR), 12, '0'),
                     lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0')) AS transaction_id,
           l_suppkey AS account_id, CAST(l_shipdate AS DATE) AS transaction_date,
           'order ' || l_orderkey || ' line ' || l_linenumber AS description, row_number() OVER () AS n
    FROM lineitem),
links AS (
    SELECT a.n, count(*) AS n_similar,
           max(1.0::DOUBLE - levenshtein(a.description, b.description)
               / CAST(greatest(length(a.description), length(b.description)) AS DOUBLE)) AS confidence_score
    FROM t a JOIN t b ON a.account_id = b.account_id AND a.n <> b.n
         AND abs(a.transaction_date - b.transaction_date) <= 3
         AND abs(length(a.description) - length(b.description)) <= 1
    WHERE levenshtein(a.description, b.description) <= 1
    GROUP BY a.n)
SELECT transaction_id, account_id, transaction_date, description, confidence_score,
       coalesce(n_similar, 0) AS n_similar
FROM t LEFT JOIN links USING (n)"""

ORACLE["p4_nested_extract"] = """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"""


# ---- forecast gate and month spine -----------------------------------------------

ORACLE["p11_history_gate"] = "WITH " + MART_CASHFLOW + """,
g AS (SELECT entity_id, CAST(count(*) AS INTEGER) AS history_months FROM mart_cashflow GROUP BY 1)
SELECT entity_id, history_months, history_months >= 6 AS eligible,
       CASE WHEN history_months < 6 THEN 'Need at least 6 months of history to forecast reliably.'
       END AS reason
FROM g"""

ORACLE["x13_forecast_months"] = "WITH " + MART_CASHFLOW + """,
g AS (SELECT entity_id, max(month) AS last_month FROM mart_cashflow GROUP BY 1 HAVING count(*) >= 6),
steps AS (SELECT entity_id, last_month, unnest(generate_series(0, 5)) AS k FROM g)
SELECT entity_id, CAST(last_day(last_month + to_months(CAST(k AS INTEGER))) AS DATE) AS month
FROM steps"""


# ---- anomalies: expected path lengths, one CTE for each level of the trees ----------

_LEVELS = 10  # covers series of up to 2 ** 10 months


def _anomaly_sql() -> str:
    c = ("CASE WHEN {0} <= 1 THEN 0.0 WHEN {0} = 2 THEN 1.0 "
         "ELSE 2.0 * (ln({0} - 1.0) + 0.5772156649015329) - 2.0 * ({0} - 1.0) / {0} END")
    levels = ["""
l0 AS (SELECT entity_id, 1 AS a, n AS b, 1.0::DOUBLE AS p FROM sizes)"""]
    for d in range(_LEVELS):
        levels.append(f"""
s{d} AS (
    SELECT l.entity_id, l.a, l.b, l.p / (xb.x - xa.x) AS flow
    FROM l{d} l JOIN sizes z USING (entity_id)
    JOIN points xa ON xa.entity_id = l.entity_id AND xa.i = l.a
    JOIN points xb ON xb.entity_id = l.entity_id AND xb.i = l.b
    WHERE {d} < z.top AND xb.x > xa.x
),
l{d + 1} AS (
    SELECT entity_id, a, b, sum(p) AS p FROM (
        SELECT s.entity_id, s.a, g.i AS b, s.flow * g.gap AS p
        FROM s{d} s JOIN gaps g ON g.entity_id = s.entity_id AND g.i >= s.a AND g.i < s.b
        UNION ALL
        SELECT s.entity_id, g.i + 1, s.b, s.flow * g.gap
        FROM s{d} s JOIN gaps g ON g.entity_id = s.entity_id AND g.i >= s.a AND g.i < s.b
    ) WHERE p > 0 GROUP BY 1, 2, 3
)""")
    leaves = " UNION ALL ".join(f"""
    SELECT l.entity_id, l.a, l.b, l.p * ({d} + {c.format('(l.b - l.a + 1)')}) AS h
    FROM l{d} l JOIN sizes z USING (entity_id)
    JOIN points xa ON xa.entity_id = l.entity_id AND xa.i = l.a
    JOIN points xb ON xb.entity_id = l.entity_id AND xb.i = l.b
    WHERE {d} = z.top OR xb.x <= xa.x""" for d in range(_LEVELS + 1))
    return "WITH " + MART_CASHFLOW + """,
points AS (
    SELECT entity_id, month, net_cashflow, CAST(net_cashflow AS DOUBLE) AS x,
           row_number() OVER (PARTITION BY entity_id ORDER BY net_cashflow, month) AS i,
           count(*) OVER (PARTITION BY entity_id) AS n
    FROM mart_cashflow QUALIFY n >= 6
),
sizes AS (SELECT entity_id, max(n) AS n, ceil(log2(max(n))) AS top FROM points GROUP BY 1),
gaps AS (
    SELECT entity_id, i, lead(x) OVER (PARTITION BY entity_id ORDER BY i) - x AS gap FROM points
),""" + ",".join(levels) + f""",
leaves AS ({leaves}),
scored AS (
    SELECT p.entity_id, p.month, p.net_cashflow,
           round(-pow(2.0, -sum(f.h) / any_value({c.format('p.n')})), 9) AS anomaly_score
    FROM points p JOIN leaves f ON f.entity_id = p.entity_id AND p.i BETWEEN f.a AND f.b
    GROUP BY 1, 2, 3
),
limits AS (SELECT entity_id, round(quantile_cont(anomaly_score, 0.1), 9) AS bound FROM scored GROUP BY 1)
SELECT s.entity_id, s.month, s.net_cashflow, s.anomaly_score,
       'Unusual net cash flow relative to historical pattern' AS reason
FROM scored s JOIN limits USING (entity_id) WHERE s.anomaly_score < bound"""


ORACLE["n1_anomalies"] = _anomaly_sql()
