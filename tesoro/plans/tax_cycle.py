"""Tax-rule jobs: seeding (S12), the monthly draft -> approval -> publish cycle
(T9 -> T8 -> T5), and the rule-set history the driver-table tax queries use."""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tesoro import schemas
from tesoro.operators import tax
from tesoro.sources.literal import literal_frame

# Example history for the driver-table queries (orders are dated 1995-2001): earlier MX
# publications, each with a general IVA rate and its own ISR table, then the 2026 seed.
# Two of them share an effective date (the later published one counts). Also a draft
# that is never published and sets of another jurisdiction. Only the 2026 set carries
# the reference's tariff; the earlier rates are illustrative: each ISR table is the
# tariff with fees and rates of the given percentage.
EXAMPLE_HISTORY = [
    # (jurisdiction, effective_date, IVA general rate, ISR percentage, gazette reference)
    ("US", "1990-01-01", "0.07", 30, "example other jurisdiction"),
    ("MX", "1995-04-01", "0.15", 50, "example publication 1995"),
    ("MX", "1998-01-01", "0.14", 60, "example publication 1998, replaced"),
    ("MX", "1998-01-01", "0.12", 75, "example publication 1998"),
    ("US", "1999-07-01", "0.08", 40, "example other jurisdiction, later"),
    ("MX", "2000-07-01", "0.16", 80, "example publication 2000"),
]
EXAMPLE_UNPUBLISHED_DRAFT = ("MX", "1999-06-01", "0.99", 99, "example draft never approved")


# When the example sets were published: ahead, on the day, and after the fact (the second
# publication of 1998 and that of 2000 change what holds for days that have passed).
EXAMPLE_PUBLISHED = ["1990-01-01", "1995-04-01", "1997-12-15", "1998-06-01", "1999-07-01", "2001-01-01"]


def scaled_brackets(percentage: int) -> list[tuple]:
    """The 2026 ISR table with fees and rates at a percentage of the tariff's."""
    share = Decimal(percentage) / 100
    return [(lo, hi, str((Decimal(fee) * share).quantize(Decimal("0.01"))),
             str((Decimal(rate) * share).quantize(Decimal("0.0001"))))
            for lo, hi, fee, rate in tax.ISR_MONTHLY_BRACKETS_2026]


def _history_spec(jurisdiction: str, eff: str, iva_rate: str, percentage: int, ref: str) -> dict:
    return {
        "jurisdiction": jurisdiction,
        "effective_date": eff,
        "published_gazette_ref": ref,
        "notes": "",
        "rules": [
            {"rule_type": "IVA", "applies_to": "general", "rate": iva_rate},
            {"rule_type": "ISR", "applies_to": tax.ISR_APPLIES_TO,
             "formula_expression": tax.brackets_formula(scaled_brackets(percentage))},
        ],
    }


def example_set_id(jurisdiction: str, eff: str, ref: str) -> str:
    """A readable id: the two publications of one date differ in their reference only."""
    return f"{jurisdiction}-{eff}-{ref.split()[-1]}"


def day_start(eff: str) -> _dt.datetime:
    d = _dt.date.fromisoformat(eff)
    return _dt.datetime(d.year, d.month, d.day)


def seed_rules(spark: SparkSession, rule_sets: DataFrame | None = None,
               rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Create the 2026 seed set as a draft and publish it."""
    if rule_sets is None:
        rule_sets, rules = tax.empty_rule_tables(spark)
    spec = tax.seed_2026_spec()
    created = day_start(spec["effective_date"])
    rule_sets, rules, sid = tax.create_draft(spark, rule_sets, rules, spec, created)
    rule_sets = tax.publish(rule_sets, sid, tax.SEED_PUBLISHED_BY, created)
    return rule_sets, rules, sid


def example_rule_history(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Rule tables after publishing EXAMPLE_HISTORY in order and then the seed.

    Final statuses follow the reference's publish: only the 2026 set is active,
    earlier MX sets are superseded, the unpublished draft stays a draft.
    """
    rule_sets, rules = tax.empty_rule_tables(spark)
    drafts = [(_history_spec(*row), day_start(row[1]), example_set_id(row[0], row[1], row[4]))
              for row in EXAMPLE_HISTORY]
    seed = tax.seed_2026_spec()
    drafts.append((seed, day_start(seed["effective_date"])))
    row = EXAMPLE_UNPUBLISHED_DRAFT
    drafts.append((_history_spec(*row), day_start(row[1]), example_set_id(row[0], row[1], row[4])))
    rule_sets, rules, ids = tax.create_drafts(spark, rule_sets, rules, drafts)
    rule_sets = tax.publish_in_order(rule_sets, ids[:-1], "history",
                                     day_start(tax.SEED_EFFECTIVE_DATE))
    return rule_sets, rules


def example_publications(spark: SparkSession) -> DataFrame:
    """EXAMPLE_HISTORY, each set published at its time of EXAMPLE_PUBLISHED, and the draft
    that never was."""
    rule_sets, rules = tax.empty_rule_tables(spark)
    drafts = [(_history_spec(*row), day_start(row[1]), example_set_id(row[0], row[1], row[4]))
              for row in [*EXAMPLE_HISTORY, EXAMPLE_UNPUBLISHED_DRAFT]]
    rule_sets, _, ids = tax.create_drafts(spark, rule_sets, rules, drafts)
    for sid, published in zip(ids, EXAMPLE_PUBLISHED):
        rule_sets = tax.publish(rule_sets, sid, "history", day_start(published))
    return rule_sets


def monthly_tax_update(spark: SparkSession, rule_sets: DataFrame, rules: DataFrame,
                       run_date, approvals: DataFrame | None = None,
                       published_at: _dt.datetime | None = None
                       ) -> tuple[DataFrame, DataFrame, str]:
    """T9 then T8: create the monthly IVA-only draft effective on ``run_date`` and
    publish every draft approved in ``approvals`` (rule_set_id, decision,
    decided_at). Without approvals the draft simply waits."""
    spec = tax.monthly_draft_spec(run_date)
    created = day_start(str(run_date))
    rule_sets, rules, sid = tax.create_draft(spark, rule_sets, rules, spec, created)
    if approvals is not None:
        rule_sets = tax.publish_approved(rule_sets, approvals, tax.MONTHLY_DRAFT_PUBLISHED_BY,
                                         published_at or created)
    return rule_sets, rules, sid


def approvals_frame(spark: SparkSession, rows) -> DataFrame:
    """Approval decisions as a DataFrame: rows of (rule_set_id, decision, decided_at)."""
    return literal_frame(spark, rows, schemas.APPROVAL)
