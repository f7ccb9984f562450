"""Scalar column helpers.

All are plain ``pyspark.sql.functions`` expressions, so they stay inside
whole-stage codegen. Money is DECIMAL end to end; doubles only appear where
the reference itself stores a float (turnover rates), and those are averaged as
exact decimals so results do not depend on partition order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"        # DECIMAL(14,2) amounts
UNIT_COST = "decimal(12,2)"    # DECIMAL(12,2) unit costs
RATE = "decimal(6,4)"          # DECIMAL(6,4) flat tax rates
BRACKET_RATE = "decimal(8,4)"  # bracket rates
TURNOVER = "decimal(18,6)"     # exact form of a float turnover rate for averaging


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c) -> Column:
    """``date_trunc('month', d)::date`` -> DATE of the first day."""
    return F.trunc(F.to_date(col_(c)), "month")


def money(c) -> Column:
    """Coerce a number to DECIMAL(14,2) (ANSI: overflow raises)."""
    return col_(c).cast(MONEY)


def try_money(c) -> Column:
    """X5 for dirty input: NULL instead of an error."""
    return col_(c).try_cast(MONEY)


def quantize_half_even(c, scale: int = 2) -> Column:
    """``Decimal.quantize`` under the default HALF_EVEN context."""
    return F.bround(col_(c), scale)


def round_half_away(c, scale: int) -> Column:
    """PostgreSQL ``round(numeric, n)`` (half away from zero)."""
    return F.round(col_(c), scale)


def iso_date(c) -> Column:
    """``date.isoformat()``."""
    return F.date_format(col_(c), "yyyy-MM-dd")


def int_div(a: Column, b: Column) -> Column:
    """Integral division (SQL ``a div b``) on BIGINT operands."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def ratio_thousandths(num: Column, den: Column) -> Column:
    """round_half_away(1000 * num / den) for integer ``num`` and ``den > 0``, exactly.

    sign(num) * ((2000 * |num| + den) div (2 * den)), all BIGINT.
    """
    num = num.cast("bigint")
    den = den.cast("bigint")
    magnitude = int_div(F.lit(2000) * F.abs(num) + den, F.lit(2) * den)
    return F.signum(num).cast("bigint") * magnitude


def cents(c) -> Column:
    """A DECIMAL(p,2) money value as BIGINT cents."""
    return (col_(c) * 100).cast("bigint")


def scaled_decimal(units: Column, scale: int, precision: int = 20) -> Column:
    """BIGINT count of 10^-scale units -> DECIMAL(precision, scale), exactly."""
    return (units.cast(f"decimal({precision},0)") / F.lit(10 ** scale)).cast(
        f"decimal({precision},{scale})")


def deterministic_id(*parts) -> Column:
    """A stable id from natural keys (sha-256 hex), so a re-run gives the same ids."""
    return F.sha2(F.concat_ws("|", *[col_(p).cast("string") for p in parts]), 256)
