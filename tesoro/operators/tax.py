"""Tax engine: S11, S12, J3-J5, T1-T9.

Rule sets and rules are small tables (one set per tariff publication). Lookups
against them are broadcast joins behind a row-count check; the bracket lookup
is a row-local array filter, so taxing a column of amounts is one scan with no
shuffle and no Python.

The lifecycle (draft, publish, approval-gated publish) is expressed as
projections over the rule-set table that return a new DataFrame; persisting a
new version is a separate write (``save_version``/``load_latest``), never an
overwrite of the path being read.
"""

from __future__ import annotations

import bisect
import datetime as _dt
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesoro import schemas
from tesoro.functions.columns import MONEY, quantize_half_even
from tesoro.functions.joins import bounded_broadcast
from tesoro.functions.storage import stored
from tesoro.sources.literal import literal_frame, typed_lit

# ---- fixed values -----------------------------------------------------------------
# The 2026 seed rule set (MX): general IVA rate, and the monthly ISR
# table for personas fisicas as (min, max, fixed_fee, rate); max None = open-ended.
SEED_JURISDICTION = "MX"
SEED_EFFECTIVE_DATE = "2026-01-01"
SEED_GAZETTE_REF = "DOF - Anexo 8 RMF 2026 (publicado 28-dic-2025)"
SEED_NOTES = "ISR mensual personas físicas + IVA general. Fuente: Anexo 8, RMF 2026."
SEED_PUBLISHED_BY = "seed_command"
IVA_GENERAL_RATE = "0.16"
ISR_APPLIES_TO = "personas_fisicas_mensual"
ISR_MONTHLY_BRACKETS_2026 = [
    ("0.01", "844.59", "0.00", "0.0192"),
    ("844.60", "7168.51", "16.22", "0.0640"),
    ("7168.52", "12598.02", "420.95", "0.1088"),
    ("12598.03", "14644.64", "1011.68", "0.1600"),
    ("14644.65", "17533.64", "1339.14", "0.1792"),
    ("17533.65", "35362.83", "1856.84", "0.2136"),
    ("35362.84", "55736.68", "5665.16", "0.2352"),
    ("55736.69", "106410.50", "10457.09", "0.3000"),
    ("106410.51", "141880.66", "25659.23", "0.3200"),
    ("141880.67", "425641.99", "37009.69", "0.3400"),
    ("425642.00", None, "133488.54", "0.3500"),
]
# The monthly draft the scheduled tax update creates.
MONTHLY_DRAFT_GAZETTE_REF = "PENDING - manual entry required"
MONTHLY_DRAFT_NOTES = ("Auto-created draft, awaiting SHCP/Gaceta Oficial confirmation "
                       "and human review.")
MONTHLY_DRAFT_PUBLISHED_BY = "airflow_monthly_dag"

TAX_TYPES = ("IVA", "ISR")          # what can be calculated (D8, trap 8)
DEFAULT_APPLIES_TO = "general"
DEFAULT_STATUSES = ("active",)      # trap 4/5: superseded sets are invisible by default
HISTORY_STATUSES = ("active", "superseded")  # all that was ever published

# Rule tables are tiny; this bounds what the lookups broadcast.
MAX_RULE_ROWS = 100_000


# ---- specs (plain Python data describing a draft) ---------------------------------

def brackets_formula(brackets) -> dict:
    return {"brackets": [
        {"min": Decimal(lo), "max": None if hi is None else Decimal(hi),
         "fixed_fee": Decimal(fee), "rate": Decimal(rate)}
        for lo, hi, fee, rate in brackets]}


def seed_2026_spec() -> dict:
    """The 2026 IVA + ISR rule set, as the seed command creates it."""
    return {
        "jurisdiction": SEED_JURISDICTION,
        "effective_date": SEED_EFFECTIVE_DATE,
        "published_gazette_ref": SEED_GAZETTE_REF,
        "notes": SEED_NOTES,
        "rules": [
            {"rule_type": "IVA", "applies_to": "general", "rate": IVA_GENERAL_RATE},
            {"rule_type": "ISR", "applies_to": ISR_APPLIES_TO,
             "formula_expression": brackets_formula(ISR_MONTHLY_BRACKETS_2026)},
        ],
    }


def monthly_draft_spec(run_date) -> dict:
    """MX, effective on the run date, IVA 0.16 only (publishing it unedited
    drops ISR, trap 7)."""
    return {
        "jurisdiction": "MX",
        "effective_date": str(run_date),
        "published_gazette_ref": MONTHLY_DRAFT_GAZETTE_REF,
        "notes": MONTHLY_DRAFT_NOTES,
        "rules": [{"rule_type": "IVA", "applies_to": "general", "rate": IVA_GENERAL_RATE}],
    }


def validate_spec(spec: dict) -> None:
    """D8 for drafts: known rule types, a date, decimals that fit their columns."""
    _dt.date.fromisoformat(str(spec["effective_date"]))
    for rule in spec.get("rules", []):
        if rule["rule_type"] not in schemas.RULE_TYPES:
            raise ValueError(f"unknown rule_type {rule['rule_type']!r}")
        rate = rule.get("rate")
        if rate is not None and abs(Decimal(str(rate))) >= 100:
            raise ValueError(f"rate {rate} does not fit DECIMAL(6,4)")


def rule_set_id(jurisdiction: str, effective_date, created_at: _dt.datetime) -> str:
    """A stable id from the natural key of a draft (re-runs give the same id)."""
    import hashlib
    key = f"{jurisdiction}|{effective_date}|{created_at.isoformat(sep=' ')}"
    return f"{jurisdiction}-{str(effective_date).replace('-', '')}-" + \
        hashlib.sha256(key.encode()).hexdigest()[:12]


def empty_rule_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (literal_frame(spark, [], schemas.TAX_RULESET),
            literal_frame(spark, [], schemas.TAX_RULE))


def rules_from_json(rules: DataFrame, column: str = "formula_expression") -> DataFrame:
    """X11: rule rows whose formula is JSON text, ``{"brackets": [{"min": .., "max": ..,
    "fixed_fee": .., "rate": ..}]}``, typed as in TAX_RULE. Numbers may be JSON numbers
    or strings; text that does not parse gives a NULL formula (status ``bad_rule``)."""
    text = T.StructType([T.StructField("brackets", T.ArrayType(T.StructType([
        T.StructField(f.name, T.StringType()) for f in schemas.BRACKET.fields])))])
    parsed = F.from_json(column, text)
    typed = F.transform(parsed["brackets"], lambda b: F.struct(*[
        b[f.name].try_cast(f.dataType).alias(f.name) for f in schemas.BRACKET.fields]))
    return rules.withColumn(column, F.when(parsed["brackets"].isNotNull(), F.struct(typed.alias("brackets"))))


# ---- T7 / T9: drafts ---------------------------------------------------------------

def _draft_rows(spec: dict, created_at: _dt.datetime, set_id: str | None):
    validate_spec(spec)
    eff = _dt.date.fromisoformat(str(spec["effective_date"]))
    jur = spec.get("jurisdiction", "MX")
    sid = set_id or rule_set_id(jur, eff, created_at)
    set_row = (sid, jur, eff, spec.get("published_gazette_ref", ""), "draft",
               spec.get("notes", ""), created_at, "", None)
    rule_rows = []
    for i, rule in enumerate(spec.get("rules", [])):
        rate = rule.get("rate")
        rule_rows.append((
            f"{sid}-r{i + 1}", sid, rule["rule_type"], rule.get("applies_to", DEFAULT_APPLIES_TO),
            None if rate is None else Decimal(str(rate)), None, None, Decimal("0.00"),
            rule.get("formula_expression"), created_at))
    return sid, set_row, rule_rows


def create_drafts(spark: SparkSession, rule_sets: DataFrame, rules: DataFrame, drafts
                  ) -> tuple[DataFrame, DataFrame, list]:
    """T7 for several drafts at once: ``drafts`` is a list of (spec, created_at)
    or (spec, created_at, id). Appends status-'draft' sets and their rules and
    returns (rule_sets, rules, ids)."""
    ids, set_rows, rule_rows = [], [], []
    for d in drafts:
        spec, created_at = d[0], d[1]
        sid, srow, rrows = _draft_rows(spec, created_at, d[2] if len(d) > 2 else None)
        ids.append(sid)
        set_rows.append(srow)
        rule_rows.extend(rrows)
    return (rule_sets.unionByName(literal_frame(spark, set_rows, schemas.TAX_RULESET)),
            rules.unionByName(literal_frame(spark, rule_rows, schemas.TAX_RULE)), ids)


def create_draft(spark: SparkSession, rule_sets: DataFrame, rules: DataFrame, spec: dict,
                 created_at: _dt.datetime, set_id: str | None = None
                 ) -> tuple[DataFrame, DataFrame, str]:
    """Append one draft rule set and its rules. Returns (rule_sets, rules, id)."""
    rule_sets, rules, ids = create_drafts(spark, rule_sets, rules,
                                          [(spec, created_at, set_id)])
    return rule_sets, rules, ids[0]


# ---- T5 / T6 / T8: publishing -------------------------------------------------------

def publish_in_order(rule_sets: DataFrame, set_ids, published_by: str = "api_user",
                     published_at: _dt.datetime | None = None) -> DataFrame:
    """T5 applied to ``set_ids`` one after another, with the T6 guards, as one
    projection: per jurisdiction the last id published is active, every other
    published id and every formerly active set is superseded. Published ids get
    published_by/published_at.

    Unknown id -> LookupError; an id that is already active -> ValueError.
    Republishing a superseded set is allowed. Only the (id, status,
    jurisdiction) of the named sets reach the driver. The sets of a call are
    stamped a microsecond apart, in their order.
    """
    set_ids = list(set_ids)
    if len(set(set_ids)) != len(set_ids):
        raise ValueError("a rule set can be published once per call")
    if not set_ids:
        return rule_sets
    found = {r["id"]: r for r in rule_sets.where(F.col("id").isin(*set_ids))
             .select("id", "status", "jurisdiction").distinct().collect()}
    for sid in set_ids:
        if sid not in found:
            raise LookupError(f"rule set {sid} not found")
        if found[sid]["status"] == "active":
            raise ValueError(f"rule set {sid} is already active")
    winners = {}
    for sid in set_ids:
        winners[found[sid]["jurisdiction"]] = sid
    losers = [sid for sid in set_ids if sid not in winners.values()]
    stamp = published_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    published = F.col("id").isin(*set_ids)
    # one microsecond apart, so that the order of publication is kept (J3 ties)
    stamps = F.create_map(*[x for i, sid in enumerate(set_ids) for x in (
        F.lit(sid), typed_lit(stamp + _dt.timedelta(microseconds=i), T.TimestampType()))])
    status = F.when(F.col("id").isin(*winners.values()), F.lit("active"))
    if losers:
        status = status.when(F.col("id").isin(*losers), F.lit("superseded"))
    status = (status.when(F.col("jurisdiction").isin(*winners.keys())
                          & (F.col("status") == "active"), F.lit("superseded"))
                    .otherwise(F.col("status")))
    return rule_sets.select(
        "id", "jurisdiction", "effective_date", "published_gazette_ref",
        status.alias("status"), "notes", "created_at",
        F.when(published, F.lit(published_by)).otherwise(F.col("published_by")).alias("published_by"),
        F.when(published, stamps[F.col("id")]).otherwise(F.col("published_at")).alias("published_at"),
    )


def publish(rule_sets: DataFrame, set_id: str, published_by: str = "api_user",
            published_at: _dt.datetime | None = None) -> DataFrame:
    """T5 with the T6 guards: every active set of the same jurisdiction becomes
    superseded; the target becomes active with published_by/at stamped."""
    return publish_in_order(rule_sets, [set_id], published_by, published_at)


def approved_drafts(rule_sets: DataFrame, approvals: DataFrame) -> DataFrame:
    """T8 gate: drafts a human marked approved (latest decision per set wins)."""
    latest = (approvals
              .withColumn("_rn", F.row_number().over(
                  Window.partitionBy("rule_set_id").orderBy(F.col("decided_at").desc_nulls_last())))
              .where((F.col("_rn") == 1) & (F.col("decision") == "approved")))
    return rule_sets.where(F.col("status") == "draft").join(
        latest.select(F.col("rule_set_id").alias("id")), "id", "left_semi")


def publish_approved(rule_sets: DataFrame, approvals: DataFrame,
                     published_by: str = MONTHLY_DRAFT_PUBLISHED_BY,
                     published_at: _dt.datetime | None = None) -> DataFrame:
    """Publish every approved draft, in effective-date order.

    Only the ids of approved drafts come to the driver (a handful of rows); more than
    MAX_RULE_ROWS of them raise ValueError and publish nothing.
    """
    ids = [r["id"] for r in approved_drafts(rule_sets, approvals)
           .orderBy("effective_date", "id").select("id").limit(MAX_RULE_ROWS + 1).collect()]
    if len(ids) > MAX_RULE_ROWS:
        raise ValueError(f"more than {MAX_RULE_ROWS} approved drafts")
    return publish_in_order(rule_sets, ids, published_by, published_at)


def list_rule_sets(rule_sets: DataFrame) -> DataFrame:
    """All rule sets by effective date (API listing columns)."""
    return (rule_sets.select("id", "jurisdiction", "effective_date", "status",
                             "published_gazette_ref")
                     .orderBy(F.col("effective_date").asc_nulls_last(), "id"))


def save_version(rule_sets: DataFrame, base_path: str, version: str) -> str:
    """Write one immutable version of a rule table; readers use load_latest."""
    path = f"{base_path.rstrip('/')}/version={version}"
    rule_sets.write.mode("errorifexists").parquet(path)
    return path


def load_latest(spark: SparkSession, base_path: str) -> DataFrame:
    df = spark.read.parquet(base_path)
    latest = df.select(F.max("version")).first()[0]
    return df.where(F.col("version") == F.lit(latest)).drop("version")


# ---- J3 / T4: active rule set as of a date ------------------------------------------

# The set in force: the latest effective date; among sets of one date (the reference
# leaves the tie open) the one published last, then the greatest id.
def _newest_first() -> list:
    return [F.col("effective_date").desc(), F.col("published_at").desc_nulls_last(), F.col("id").desc()]


def validity_ranges(rule_sets: DataFrame, statuses=DEFAULT_STATUSES) -> DataFrame:
    """Visible rule sets as [valid_from, valid_to) ranges per jurisdiction, one for
    each effective date (ties as in ``_newest_first``)."""
    sets = rule_sets.where(F.col("status").isin(*statuses)).select(
        "id", "jurisdiction", "effective_date", "published_at")
    sets = (sets.withColumn("_rn", F.row_number().over(
                Window.partitionBy("jurisdiction", "effective_date").orderBy(*_newest_first())))
                .where(F.col("_rn") == 1).drop("_rn", "published_at"))
    return sets.withColumn("valid_to", F.lead("effective_date").over(
        Window.partitionBy("jurisdiction").orderBy("effective_date")))


def _driver_ranges(rule_sets: DataFrame, jurisdiction: str | None, statuses) -> list[tuple] | None:
    """``validity_ranges`` as (jurisdiction, id, from, to) rows on the driver, or None
    if there are more than MAX_RULE_ROWS visible sets."""
    sets = rule_sets.where(F.col("status").isin(*statuses) & F.col("effective_date").isNotNull())
    if jurisdiction is not None:
        sets = sets.where(F.col("jurisdiction") == jurisdiction)
    rows = sets.select("id", "jurisdiction", "effective_date", "published_at").limit(MAX_RULE_ROWS + 1).collect()
    if len(rows) > MAX_RULE_ROWS:
        return None
    newest: dict = {}
    for r in sorted(rows, key=lambda r: (r["published_at"] is not None, r["published_at"] or _dt.datetime.min, r["id"])):
        newest[(r["jurisdiction"], r["effective_date"])] = r["id"]
    out, starts = [], sorted(newest, key=lambda k: (k[0] or "", k[1]))
    for (jur, start), following in zip(starts, [*starts[1:], (None, None)]):
        out.append((jur, newest[(jur, start)], start, following[1] if following[0] == jur else None))
    return out


def _year_buckets(ranges: DataFrame, cap_year: int) -> DataFrame:
    """One row per (range, calendar year it touches, up to ``cap_year``): turns
    the range join into an equi-join on the year plus a range check. Only
    open-ended ranges reach past the latest effective year, so amounts dated
    later are looked up in the ``cap_year`` bucket (see as_of_rule_set)."""
    last_day = F.coalesce(F.date_sub("valid_to", 1), F.make_date(
        F.lit(cap_year), F.lit(12), F.lit(31)))
    return ranges.withColumn(
        "_year", F.explode(F.sequence(F.year("effective_date"), F.year(last_day))))


_BUCKETS = T.StructType([
    T.StructField("_jurisdiction", T.StringType()), T.StructField("rule_set_id", T.StringType()),
    T.StructField("rule_set_effective_date", T.DateType()), T.StructField("_valid_to", T.DateType()),
    T.StructField("_year", T.IntegerType())])


def merge_slices(amounts: DataFrame, rule_sets: DataFrame, as_of_col: str, jurisdiction, statuses) -> DataFrame:
    """Amounts and rule sets in one order (jurisdiction, date, sets before amounts), cut
    into slices of about equal size and stored: ``_jur, _date, _kind, _tie, _slice``, the
    amount as the struct ``_row`` and the set as ``_set``. Amounts of one jurisdiction and
    date are dealt over as many slices as they fill."""
    sets = validity_ranges(rule_sets.where(F.col("jurisdiction").isNotNull() & F.col("effective_date").isNotNull()), statuses)
    found = F.struct(F.col("id").alias("rule_set_id"), F.col("effective_date").alias("rule_set_effective_date"))
    row = F.struct(*[F.col(f"`{c}`") for c in amounts.columns])
    jurisdiction = F.col(jurisdiction) if isinstance(jurisdiction, str) else jurisdiction
    asked = amounts.select(jurisdiction.cast("string").alias("_jur"), F.col(as_of_col).cast("date").alias("_date"), F.lit(1).alias("_kind"),
                           F.monotonically_increasing_id().alias("_tie"), row.alias("_row"))
    given = sets.select(F.col("jurisdiction").alias("_jur"), F.col("effective_date").alias("_date"), F.lit(0).alias("_kind"),
                        F.lit(0).cast("long").alias("_tie"), found.alias("_set"))
    both = asked.unionByName(given, allowMissingColumns=True)
    return stored(both.repartitionByRange("_jur", "_date", "_kind", "_tie").withColumn("_slice", F.spark_partition_id()),
                  "as-of-slices")


def _as_of_by_merge(amounts: DataFrame, rule_sets: DataFrame, as_of_col: str, jurisdiction, statuses) -> DataFrame:
    """J3 by sort and merge, for any number of rule sets: within a slice of the common order
    the last set before an amount is carried to it; an amount before the first set of its
    slice takes the last one of the slices before, carried over the slices' ends (a row
    for each slice and jurisdiction)."""
    slices = merge_slices(amounts, rule_sets, as_of_col, jurisdiction, statuses)
    within = Window.partitionBy("_slice", "_jur").orderBy("_date", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = slices.withColumn("_own", F.last("_set", ignorenulls=True).over(within)).where("_kind = 1")
    ends = slices.groupBy("_slice", "_jur").agg(F.max(F.when(F.col("_kind") == 0, F.struct("_date", "_set"))).alias("_end"))
    before = Window.partitionBy("_jur").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_slice", "_jur", F.last("_end", ignorenulls=True).over(before)["_set"].alias("_earlier"))
    ends = ends.where(F.col("_earlier").isNotNull() & F.col("_jur").isNotNull())
    out = carried.join(ends, ["_slice", "_jur"], "left").withColumn("_found", F.when(
        F.col("_date").isNotNull(), F.coalesce("_own", "_earlier")))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in amounts.columns],
                      F.col("_found.rule_set_id").alias("rule_set_id"),
                      F.col("_found.rule_set_effective_date").alias("rule_set_effective_date"))


def as_of_rule_set(amounts: DataFrame, rule_sets: DataFrame, as_of_col: str = "as_of_date",
                   jurisdiction: str = "MX", statuses=DEFAULT_STATUSES,
                   jurisdiction_col: str | None = None) -> DataFrame:
    """Add ``rule_set_id`` and ``rule_set_effective_date`` of the latest
    visible set with effective_date <= as_of (NULL when there is none), in one
    ``jurisdiction`` or in that of the column ``jurisdiction_col``.

    The visible sets (checked to be at most MAX_RULE_ROWS) are cut into calendar
    years on the driver and matched by hash on (jurisdiction, as-of year), the year
    clamped to the latest effective one: no count job, no shuffle of the amounts and
    no nested-loop join. More sets take the sort-merge lookup (``_as_of_by_merge``).
    """
    spark = amounts.sparkSession
    ranges = _driver_ranges(rule_sets, None if jurisdiction_col else jurisdiction, statuses)
    if ranges is not None and not ranges:
        return (amounts.withColumn("rule_set_id", F.lit(None).cast("string"))
                       .withColumn("rule_set_effective_date", F.lit(None).cast("date")))
    if ranges is not None:
        cap_year = max(start.year for _, _, start, _ in ranges)
        rows = [(jur, sid, start, to, year) for jur, sid, start, to in ranges
                for year in range(start.year, (to - _dt.timedelta(days=1)).year + 1 if to else cap_year + 1)]
        buckets = literal_frame(spark, rows, _BUCKETS)
        if len(rows) <= MAX_RULE_ROWS:
            buckets = F.broadcast(buckets)
    else:
        return _as_of_by_merge(amounts, rule_sets, as_of_col, jurisdiction_col or F.lit(jurisdiction), statuses)
    as_of = F.col(as_of_col)
    left = amounts.withColumn("_as_of_year", F.least(F.year(as_of), F.lit(cap_year)))
    cond = ((left["_as_of_year"] == buckets["_year"])
            & (as_of >= buckets["rule_set_effective_date"])
            & (buckets["_valid_to"].isNull() | (as_of < buckets["_valid_to"])))
    if jurisdiction_col is not None:
        cond = cond & (left[jurisdiction_col] == buckets["_jurisdiction"])
    return left.join(buckets, cond, "left").drop("_as_of_year", "_year", "_valid_to", "_jurisdiction")


def _known_rectangles(sets: list[tuple]) -> list[tuple]:
    """``(id, effective from, to, known from, to)`` of the sets ``(id, effective_date,
    published_at)`` of one jurisdiction; to is open or None. In the order of publication a
    set takes the dates from its own to the next known one from the set that had them."""
    starts: list = []  # known effective dates
    current: dict = {}  # by effective date: id, known from
    out = []

    def close(start, upto) -> None:
        i = bisect.bisect_left(starts, start)
        sid, since = current[start]
        if since < upto:  # sets published at one time leave no empty rectangle
            out.append((sid, start, starts[i + 1] if i + 1 < len(starts) else None, since, upto))

    for sid, start, published in sorted(sets, key=lambda s: (s[2], s[0])):
        if start in current:
            close(start, published)
        else:
            i = bisect.bisect_left(starts, start)
            if i:
                close(starts[i - 1], published)
                current[starts[i - 1]] = (current[starts[i - 1]][0], published)
            starts.insert(i, start)
        current[start] = (sid, published)
    for i, start in enumerate(starts):
        sid, since = current[start]
        out.append((sid, start, starts[i + 1] if i + 1 < len(starts) else None, since, None))
    return out


def known_ranges(rule_sets: DataFrame, statuses=HISTORY_STATUSES) -> DataFrame:
    """T4: the sets ever published as rectangles of effective date and publication time,
    ``jurisdiction, id, effective_date, valid_to, known_from, known_to``: disjoint within
    a jurisdiction, at most two for each set and one more for each later one that
    cuts it."""
    sets = rule_sets.where(F.col("status").isin(*statuses) & F.col("jurisdiction").isNotNull()
                           & F.col("effective_date").isNotNull() & F.col("published_at").isNotNull())

    def cut(key, table):
        rows = _known_rectangles([(r["id"], r["effective_date"], r["published_at"]) for r in table.to_pylist()])
        kinds = (pa.string(), pa.date32(), pa.date32(), table.schema.field("published_at").type, table.schema.field("published_at").type)
        names = ["id", "effective_date", "valid_to", "known_from", "known_to"]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(rows), pa.string()), *columns], ["jurisdiction", *names])

    return sets.select("jurisdiction", "id", "effective_date", "published_at").groupBy("jurisdiction").applyInArrow(
        cut, "jurisdiction string, id string, effective_date date, valid_to date, known_from timestamp, known_to timestamp")


def as_known_rule_set(amounts: DataFrame, rule_sets: DataFrame, as_of_col: str, known_at_col: str,
                      jurisdiction_col: str, statuses=HISTORY_STATUSES) -> DataFrame:
    """T4 in two times: add ``rule_set_id`` and ``rule_set_effective_date`` of the set in
    force on the date ``as_of_col`` as far as it was published at the time ``known_at_col``
    (NULL without one, or for a null date, time or jurisdiction). What is published later
    changes no answer for an earlier time.

    The rectangles of ``known_ranges`` are cut into calendar years and met by hash on
    (jurisdiction, year); broadcast if they are few, else a shuffle join.
    """
    ranges = stored(known_ranges(rule_sets, statuses), "known-ranges")  # small; read by the count and the join
    cap_year = ranges.agg(F.max(F.year("effective_date"))).first()[0]
    if cap_year is None:
        return (amounts.withColumn("rule_set_id", F.lit(None).cast("string"))
                       .withColumn("rule_set_effective_date", F.lit(None).cast("date")))
    buckets, _ = bounded_broadcast(_year_buckets(ranges, cap_year).select(
        F.col("jurisdiction").alias("_jurisdiction"), F.col("id").alias("rule_set_id"),
        F.col("effective_date").alias("rule_set_effective_date"), F.col("valid_to").alias("_valid_to"),
        F.col("known_from").alias("_known_from"), F.col("known_to").alias("_known_to"), "_year"), MAX_RULE_ROWS)
    as_of, known_at = F.col(as_of_col), F.col(known_at_col).cast("timestamp")
    left = amounts.withColumn("_as_of_year", F.least(F.year(as_of), F.lit(cap_year)))
    cond = ((left["_as_of_year"] == buckets["_year"]) & (left[jurisdiction_col] == buckets["_jurisdiction"])
            & (as_of >= buckets["rule_set_effective_date"])
            & (buckets["_valid_to"].isNull() | (as_of < buckets["_valid_to"]))
            & (known_at >= buckets["_known_from"])
            & (buckets["_known_to"].isNull() | (known_at < buckets["_known_to"])))
    return left.join(buckets, cond, "left").drop("_as_of_year", "_year", "_valid_to", "_jurisdiction", "_known_from", "_known_to")


def active_rule_set(rule_sets: DataFrame, as_of, jurisdiction: str = "MX",
                    statuses=DEFAULT_STATUSES) -> DataFrame:
    """J3 for one date: at most one row (orderBy + limit 1, O3), in the order that
    ``as_of_rule_set`` uses."""
    return (rule_sets.where((F.col("jurisdiction") == jurisdiction)
                            & F.col("status").isin(*statuses)
                            & (F.col("effective_date") <= F.lit(as_of).cast("date")))
                     .orderBy(*_newest_first())
                     .limit(1))


def with_active_rule_set(amounts: DataFrame, rule_sets: DataFrame, as_of, jurisdiction: str = "MX",
                         statuses=DEFAULT_STATUSES) -> DataFrame:
    """J3 where all amounts share one date: the set's id and date as literals."""
    row = active_rule_set(rule_sets, as_of, jurisdiction, statuses).select("id", "effective_date").first()
    return (amounts.withColumn("rule_set_id", F.lit(row["id"] if row else None).cast("string"))
                   .withColumn("rule_set_effective_date",
                               F.lit(row["effective_date"] if row else None).cast("date")))


# ---- J4: rule within a set -----------------------------------------------------------

def first_rules(rules: DataFrame) -> DataFrame:
    """One rule per (set, rule_type, applies_to): the first created (then by id)."""
    w = Window.partitionBy("rule_set_id", "rule_type", "applies_to").orderBy(
        F.col("created_at").asc_nulls_last(), F.col("id"))
    return rules.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# ---- T1 / T2 / J5: the calculators ----------------------------------------------------

def iva_tax(amount, rate) -> F.Column:
    """Amount * rate, quantized to cents half-even."""
    a = F.col(amount) if isinstance(amount, str) else amount
    r = F.col(rate) if isinstance(rate, str) else rate
    return quantize_half_even(a * r, 2).cast(MONEY)


def matching_bracket(income, brackets) -> F.Column:
    """The first bracket with min <= income <= max, where a NULL or zero max
    means open-ended (trap 4). NULL when none matches (income <= 0, sub-cent gaps)."""
    inc = F.col(income) if isinstance(income, str) else income
    br = F.col(brackets) if isinstance(brackets, str) else brackets
    hits = F.filter(br, lambda b: (b["min"] <= inc)
                    & (F.nullif(b["max"], F.lit(0)).isNull() | (inc <= b["max"])))
    return F.get(hits, 0)


def isr_tax(income, brackets) -> F.Column:
    """fixed_fee + (income - min) * rate of the matching bracket, half-even
    to cents; 0.00 when no bracket matches. Exact decimals throughout, so edge
    incomes such as 844.60 fall in their bracket (trap 2)."""
    inc = F.col(income) if isinstance(income, str) else income
    return isr_from_bracket(inc, matching_bracket(inc, brackets))


def isr_from_bracket(income, bracket) -> F.Column:
    """T2 given the already matched bracket (a struct column, NULL for none)."""
    inc = F.col(income) if isinstance(income, str) else income
    b = F.col(bracket) if isinstance(bracket, str) else bracket
    raw = F.coalesce(b["fixed_fee"], F.lit(0)) + (inc - b["min"]) * b["rate"]
    return F.coalesce(quantize_half_even(raw, 2).cast(MONEY),
                      F.lit("0.00").cast(MONEY))


def calculate_tax(amounts: DataFrame, rule_sets: DataFrame, rules: DataFrame,
                  tax_type: str = "tax_type", amount: str = "amount",
                  applies_to: str | None = None, as_of: str | None = None,
                  jurisdiction: str = "MX", statuses=DEFAULT_STATUSES,
                  jurisdiction_col: str | None = None, as_of_date=None) -> DataFrame:
    """T3 over a DataFrame of amounts.

    Adds tax_amount, rule_set_id, rule_set_effective_date and tax_status:
    ``bad_tax_type`` (a type that is not IVA or ISR, such as RETENCION, D8),
    ``no_rule_set`` (nothing active as of the date), ``no_rule`` (the set has no
    rule for the tax type and applies_to), ``bad_rule`` (an IVA rule without a rate
    or an ISR rule without brackets) or ``ok``; the tax is NULL unless ``ok``.
    ``applies_to`` defaults to 'general'. The date is the column ``as_of`` or the
    one date ``as_of_date``, and the current date without either; with one date and
    jurisdiction the set is looked up once and no join is planned for it.
    """
    df = amounts
    if applies_to is None:
        df = df.withColumn("_applies_to", F.lit(DEFAULT_APPLIES_TO))
        applies_to = "_applies_to"
    if as_of is None and jurisdiction_col is None:
        with_set = with_active_rule_set(df, rule_sets, as_of_date or _dt.date.today(), jurisdiction, statuses)
    else:
        if as_of is None:
            df = df.withColumn("_as_of", F.lit(as_of_date).cast("date") if as_of_date else F.current_date())
            as_of = "_as_of"
        with_set = as_of_rule_set(df, rule_sets, as_of, jurisdiction, statuses, jurisdiction_col)
    # Spark broadcasts the rules by their size; a larger table is a shuffle join
    rule_lookup = first_rules(rules).select(
        F.col("rule_set_id").alias("_r_set"), F.col("rule_type").alias("_r_type"),
        F.col("applies_to").alias("_r_applies"), F.col("rate").alias("_r_rate"),
        F.col("formula_expression.brackets").alias("_r_brackets"), F.lit(True).alias("_r_found"))
    cond = ((with_set["rule_set_id"] == rule_lookup["_r_set"])
            & (with_set[tax_type] == rule_lookup["_r_type"])
            & (with_set[applies_to] == rule_lookup["_r_applies"]))
    joined = with_set.join(rule_lookup, cond, "left")
    # the bracket search runs once per row in its own projection; the tax
    # expression then reads the matched struct's fields
    # (an unrolled CASE over the brackets keeps codegen but measured 2x slower)
    joined = joined.withColumn("_r_bracket", F.when(
        F.col(tax_type) == "ISR", matching_bracket(amount, "_r_brackets")))
    incomplete = F.when(F.col(tax_type) == "IVA", F.col("_r_rate").isNull()).otherwise(
        F.coalesce(F.size("_r_brackets") <= 0, F.lit(True)))
    status = (F.when(F.col(tax_type).isNull() | ~F.col(tax_type).isin(*TAX_TYPES), F.lit("bad_tax_type"))
               .when(F.col("rule_set_id").isNull(), F.lit("no_rule_set"))
               .when(F.col("_r_found").isNull(), F.lit("no_rule"))
               .when(incomplete, F.lit("bad_rule"))
               .otherwise(F.lit("ok")))
    tax = (F.when(F.col("tax_status") != "ok", F.lit(None).cast(MONEY))
            .when(F.col(tax_type) == "IVA", iva_tax(amount, "_r_rate"))
            .otherwise(isr_from_bracket(amount, "_r_bracket")))
    out = joined.withColumn("tax_status", status).withColumn("tax_amount", tax)
    return out.drop("_r_set", "_r_type", "_r_applies", "_r_rate", "_r_brackets", "_r_bracket",
                    "_r_found", "_applies_to", "_as_of")


def calculate_one(spark: SparkSession, rule_sets: DataFrame, rules: DataFrame, tax_type: str,
                  amount, applies_to: str = DEFAULT_APPLIES_TO, as_of_date=None,
                  jurisdiction: str = "MX") -> dict:
    """T3 for one request, with the reference's answers: the response fields,
    or LookupError when no rule set is active as of the date or the set has no
    matching rule. Runs the same batch operator on a one-row frame."""
    if tax_type not in TAX_TYPES:
        raise ValueError(f"tax_type must be one of {TAX_TYPES}")
    as_of = _dt.date.fromisoformat(str(as_of_date)) if as_of_date else _dt.date.today()
    request = literal_frame(spark, [(tax_type, Decimal(str(amount)), applies_to, as_of)], T.StructType([
        T.StructField("tax_type", T.StringType()), T.StructField("amount", schemas.MONEY),
        T.StructField("applies_to", T.StringType()), T.StructField("as_of_date", T.DateType())]))
    row = calculate_tax(request, rule_sets, rules, applies_to="applies_to", as_of="as_of_date",
                        jurisdiction=jurisdiction).first()
    if row["tax_status"] == "no_rule_set":
        raise LookupError(f"no rule set is in force on {as_of}")
    if row["tax_status"] == "no_rule":
        raise LookupError(f"the rule set in force has no {tax_type} rule for {applies_to!r}")
    if row["tax_status"] == "bad_rule":
        raise ValueError(f"the {tax_type} rule for {applies_to!r} lacks a rate or brackets")
    return {"tax_type": tax_type, "input_amount": row["amount"], "tax_amount": row["tax_amount"],
            "rule_set_id": row["rule_set_id"],
            "rule_set_effective_date": row["rule_set_effective_date"]}


def check_tax_types(amounts: DataFrame, tax_type: str = "tax_type") -> DataFrame:
    """Rows whose tax type cannot be calculated (e.g. RETENCION, trap 8)."""
    return amounts.where(~F.col(tax_type).isin(*TAX_TYPES) | F.col(tax_type).isNull())
