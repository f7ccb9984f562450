"""Explicit StructTypes. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
UNIT_COST = T.DecimalType(12, 2)
RATE = T.DecimalType(6, 4)
BRACKET_RATE = T.DecimalType(8, 4)


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# ---- raw JSON feed (FIXTURES 1) -------------------------------------------------
CONCEPTO = _s(("descripcion", T.StringType()), ("categoria", T.StringType()),
              ("cantidad", T.IntegerType()), ("valor_unitario", MONEY))

RAW_TRANSACTION = _s(
    ("uuid", T.StringType()), ("folio", T.StringType()), ("fecha_emision", T.StringType()),
    ("rfc_emisor", T.StringType()), ("rfc_receptor", T.StringType()),
    ("conceptos", T.ArrayType(CONCEPTO)),
    ("subtotal", MONEY), ("iva", MONEY), ("total", MONEY),
    ("moneda", T.StringType()), ("metodo_pago", T.StringType()), ("forma_pago", T.StringType()),
)

RAW_CASHFLOW = _s(("entity_rfc", T.StringType()), ("date", T.StringType()),
                  ("type", T.StringType()), ("amount", MONEY))

RAW_INVENTORY = _s(("entity_rfc", T.StringType()), ("sku", T.StringType()),
                   ("date", T.StringType()), ("qty", T.IntegerType()),
                   ("unit_cost", UNIT_COST), ("turnover_rate", T.DoubleType()))

# ---- Bronze tables ----------------------------------------------------
CORE_ENTITY = _s(("id", T.StringType()), ("rfc", T.StringType()), ("name", T.StringType()),
                 ("entity_type", T.StringType()), ("created_at", T.TimestampType()))

CORE_ACCOUNT = _s(("id", T.StringType()), ("entity_id", T.StringType()),
                  ("account_type", T.StringType()), ("currency", T.StringType()),
                  ("created_at", T.TimestampType()))

CORE_CATEGORY = _s(("id", T.StringType()), ("name", T.StringType()), ("parent_id", T.StringType()))

CORE_TRANSACTION = _s(
    ("id", T.StringType()), ("account_id", T.StringType()), ("category_id", T.StringType()),
    ("date", T.DateType()), ("amount", MONEY), ("description", T.StringType()),
    ("source_doc_ref", T.StringType()), ("is_duplicate_flag", T.BooleanType()),
    ("confidence_score", T.DoubleType()), ("created_at", T.TimestampType()),
)

CORE_INVENTORYSNAPSHOT = _s(
    ("id", T.StringType()), ("entity_id", T.StringType()), ("sku", T.StringType()),
    ("date", T.DateType()), ("qty", T.IntegerType()), ("unit_cost", UNIT_COST),
    ("turnover_rate", T.DoubleType()), ("batch_id", T.StringType()),
)

CORE_CASHFLOWEVENT = _s(
    ("id", T.StringType()), ("entity_id", T.StringType()), ("date", T.DateType()),
    ("event_type", T.StringType()), ("amount", MONEY), ("projected", T.BooleanType()),
    ("batch_id", T.StringType()),
)

BRACKET = _s(("min", MONEY), ("max", MONEY), ("fixed_fee", MONEY), ("rate", BRACKET_RATE))
FORMULA = _s(("brackets", T.ArrayType(BRACKET)))

TAX_RULESET = _s(
    ("id", T.StringType()), ("jurisdiction", T.StringType()), ("effective_date", T.DateType()),
    ("published_gazette_ref", T.StringType()), ("status", T.StringType()),
    ("notes", T.StringType()), ("created_at", T.TimestampType()),
    ("published_by", T.StringType()), ("published_at", T.TimestampType()),
)

TAX_RULE = _s(
    ("id", T.StringType()), ("rule_set_id", T.StringType()), ("rule_type", T.StringType()),
    ("applies_to", T.StringType()), ("rate", RATE), ("min_threshold", MONEY),
    ("max_threshold", MONEY), ("fixed_fee", MONEY), ("formula_expression", FORMULA),
    ("created_at", T.TimestampType()),
)

APPROVAL = _s(("rule_set_id", T.StringType()), ("decision", T.StringType()),
              ("decided_at", T.TimestampType()))

# ---- choices (accepted values, D3) -------------------------------------------------
# The enumerations declared by the reference's models.
ENTITY_TYPES = ("persona_fisica", "persona_moral")
ACCOUNT_TYPES = ("checking", "savings", "credit")
EVENT_TYPES = ("inflow", "outflow")
RULESET_STATUSES = ("draft", "active", "superseded")
RULE_TYPES = ("IVA", "ISR", "RETENCION")
