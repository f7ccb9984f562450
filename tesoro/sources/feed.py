"""The JSON feed path: S1 scan, P4/P5 typing, J2 key lookup, S6 get-or-create
dimensions, S3-S5 Bronze appends and S7 load counts.

Feed files are JSON arrays of objects. Each file is read whole (like
``multiLine``), parsed with an explicit schema and exploded with its position; very large
files can be read by ranges instead.
Nothing is inferred and nothing passes through the driver.

Loads are idempotent by default and lose nothing: a transaction is known by its uuid, a
cash-flow or inventory record by its batch (the content of its file, unless the caller
names the batch), file and position. Re-running the same files adds nothing (the
reference appends again and turns every row into a "duplicate", trap 12); new content at
a known path is loaded whole; a file that does not parse is a counted reject.
``mode="append"`` reproduces the reference.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesoro import schemas
from tesoro.functions.columns import deterministic_id
from tesoro.functions.joins import bounded_broadcast
from tesoro.functions.storage import dealt, stored
from tesoro.sources.json_array import read_arrays

FEED_SCHEMAS = {
    "transactions": schemas.RAW_TRANSACTION,
    "cashflow": schemas.RAW_CASHFLOW,
    "inventory": schemas.RAW_INVENTORY,
}

# Defaults the reference's loader uses for dimension rows it creates.
DEFAULT_ENTITY_NAME = "Synthetic Test Entity SA de CV"
DEFAULT_ENTITY_TYPE = "persona_moral"
DEFAULT_ACCOUNT_TYPE = "checking"
DEFAULT_CURRENCY = "MXN"


def parse_feed_files(files: DataFrame, kind: str, batch_id: str | None = None) -> DataFrame:
    """Records of whole-file text rows ``(_source_file, value)`` of one feed kind, with
    ``_pos`` and ``batch_id``.

    A record that does not match the schema leaves NULL fields (never a guessed
    type). A file that does not parse is one record of NULLs, which the load counts
    as a reject. The batch is ``batch_id``, or else the SHA-256 of the file's text:
    the same content is the same batch wherever it lies, new content at a known path
    is a new one. Also used by the streaming loader on each micro-batch."""
    kind_type = T.ArrayType(FEED_SCHEMAS[kind])
    batch = F.lit(batch_id) if batch_id is not None else F.sha2("value", 256)
    records = F.coalesce(F.from_json("value", kind_type), F.array(F.lit(None).cast(FEED_SCHEMAS[kind])))
    parsed = files.select("_source_file", batch.alias("batch_id"), F.posexplode(records).alias("_pos", "r"))
    return parsed.select("_source_file", "_pos", "batch_id", "r.*")


def read_feed(spark: SparkSession, path: str | Iterable[str], kind: str, batch_id: str | None = None,
              split: bool = False) -> DataFrame:
    """Records of one feed kind with ``_source_file``, ``_pos`` and ``batch_id``.

    ``path`` may be a file, a directory or a glob. Each file is one task, and its text
    and records must fit in that task's memory; with ``split`` a file is read by many tasks
    (``json_array.read_array``), where a record that does not parse is a reject of its own,
    and ``path`` may be several that are read in turn (``json_array.read_arrays``).
    The two name a file's content differently: name the batch, or stay with one of them.
    """
    if split:
        return read_arrays(spark, [path] if isinstance(path, str) else path, FEED_SCHEMAS[kind], batch_id)
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("_source_file"), "value")
    return parse_feed_files(files, kind, batch_id)


def empty_feed(spark: SparkSession, kind: str) -> DataFrame:
    from tesoro.sources.literal import literal_frame
    schema = T.StructType([T.StructField("_source_file", T.StringType()),
                           T.StructField("_pos", T.IntegerType()),
                           T.StructField("batch_id", T.StringType())] + FEED_SCHEMAS[kind].fields)
    return literal_frame(spark, [], schema)


def iso_date(column: str):
    """P5: ISO ``yyyy-MM-dd`` text -> DATE; NULL (a reject) instead of an ANSI error."""
    return F.to_date(F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd")))


# Fields a record cannot be loaded without (it is counted as a reject instead).
REQUIRED = {
    "transactions": ("source_doc_ref", "entity_rfc", "date", "amount"),
    "cashflow": ("entity_rfc", "date", "type", "amount"),
    "inventory": ("entity_rfc", "sku", "date"),
}


def _complete(df: DataFrame, kind: str):
    ok = F.lit(True)
    for c in REQUIRED[kind]:
        ok = ok & F.col(c).isNotNull()
    return ok


def first_concept(field: str):
    """``conceptos[0].<field>``; NULL (not an error) when the list is empty."""
    return F.get(F.col("conceptos"), 0)[field]


def typed_transactions(raw: DataFrame) -> DataFrame:
    """P4 + P5: the fields the loader keeps, typed. ``amount`` is ``total`` (tax
    included); the date is parsed from ISO text."""
    return raw.select(
        "_source_file", "_pos",
        F.col("uuid").alias("source_doc_ref"),
        F.col("rfc_receptor").alias("entity_rfc"),
        iso_date("fecha_emision").alias("date"),
        F.col("total").alias("amount"),
        first_concept("categoria").alias("category_name"),
        first_concept("descripcion").alias("description"),
    )


def get_or_create(existing: DataFrame, incoming_keys: DataFrame, key: list[str],
                  build) -> tuple[DataFrame, DataFrame]:
    """Dimension rows for keys not yet present.

    ``build`` maps the distinct new keys to full dimension rows (same columns
    as ``existing``). Returns (dimension after the load, new rows). Keys are
    deduplicated before the anti join, so the shuffle carries distinct keys only.
    """
    present = F.lit(True)
    for k in key:
        present = present & F.col(k).isNotNull()
    new_keys = incoming_keys.select(*key).where(present).dropDuplicates(key)
    new_keys = new_keys.join(existing.select(*key), key, "left_anti")
    new_rows = build(new_keys).select(*existing.columns)
    return existing.unionByName(new_rows), new_rows


def empty_bronze(spark: SparkSession) -> dict:
    tables = {
        "core_entity": schemas.CORE_ENTITY,
        "core_account": schemas.CORE_ACCOUNT,
        "core_category": schemas.CORE_CATEGORY,
        "core_transaction": schemas.CORE_TRANSACTION,
        "core_cashflowevent": schemas.CORE_CASHFLOWEVENT,
        "core_inventorysnapshot": schemas.CORE_INVENTORYSNAPSHOT,
    }
    from tesoro.sources.literal import literal_frame
    return {name: literal_frame(spark, [], schema) for name, schema in tables.items()}


def _check_mode(mode: str) -> None:
    if mode not in ("idempotent", "append"):
        raise ValueError("mode must be 'idempotent' or 'append'")


def _first_of_each(rows: DataFrame, key: str, n: int) -> DataFrame:
    """One of the ``n`` rows for each value of ``key``: the first in the feed. Few rows are
    combined before the shuffle; many are dealt over tasks first, and sorted only there."""
    kept = [c for c in rows.columns if c not in (key, "_source_file", "_pos")]
    rows = dealt(rows, n, key).groupBy(key).agg(F.min_by(F.struct(*kept), F.struct("_source_file", "_pos")).alias("_row"))
    return rows.select(key, *[F.col(f"_row.{c}").alias(c) for c in kept])


def _new_transactions(known: DataFrame, rows: DataFrame, mode: str) -> DataFrame:
    """The rows, unless appending only those of ids that are not ``known``, whatever their date."""
    return rows if mode == "append" else rows.join(known.select("id"), "id", "left_anti")


def _new_batches(existing: DataFrame, rows: DataFrame, mode: str) -> DataFrame:
    """The rows of batches that Bronze lacks (it is partitioned by batch)."""
    if mode == "append":
        return rows
    return rows.join(existing.select("batch_id").distinct(), "batch_id", "left_anti").select(*rows.columns)


def load_feed(spark: SparkSession, feed_dir: str, bronze: dict, load_ts,
              mode: str = "idempotent", batch_id: str | None = None, split: bool = False) -> tuple[dict, dict]:
    """S3-S6 + J2: load transactions.json, cashflow.json and inventory.json of
    ``feed_dir``, by ranges of the files if ``split``. See :func:`load_records`."""
    feed_dir = feed_dir.rstrip("/")
    return load_records(spark, *(read_feed(spark, f"{feed_dir}/{kind}.json", kind, batch_id, split) for kind in FEED_SCHEMAS),
                        bronze, load_ts, mode)


def load_records(spark: SparkSession, raw_txn: DataFrame, cf: DataFrame, inv: DataFrame,
                 bronze: dict, load_ts, mode: str = "idempotent") -> tuple[dict, dict]:
    """Load parsed feed records (any of them may be empty) into Bronze frames.

    Transactions that Bronze has are known by ``bronze["transaction_ids"]`` (the bucketed
    index of a warehouse) or else by the table itself. Every record is attached to the entity of its own rfc (the reference gives
    all records the first transaction's receptor, trap 11; equal on a
    one-entity feed). Records missing a required field (or with a malformed
    date) are not loaded; they are returned as ``rejected_<kind>``. Transactions are
    keyed by uuid, one row each; cash-flow and inventory records, which have no key,
    by (batch, file, position). Returns (bronze after the load, rows added per table,
    rejected records, and the whole batches as ``replay_<table>``).
    ``load_ts`` stamps created_at; with ``mode="append"`` it also enters the ids and
    batches, so a re-run appends copies as the reference does.
    """
    _check_mode(mode)
    ts = F.lit(str(load_ts)).cast("timestamp")
    salt = [F.lit(str(load_ts))] if mode == "append" else []
    # parsed and typed once: the dimensions, the facts and the counts read what they need
    txn = stored(typed_transactions(raw_txn), "feed-transactions")
    cf = stored(cf.withColumn("date", iso_date("date")), "feed-cashflow")
    inv = stored(inv.withColumn("date", iso_date("date")), "feed-inventory")
    read = txn.count()  # from the files' footers
    rejected = {"transactions": txn.where(~_complete(txn, "transactions")),
                "cashflow": cf.where(~_complete(cf, "cashflow")),
                "inventory": inv.where(~_complete(inv, "inventory"))}
    txn = txn.where(_complete(txn, "transactions"))
    cf = cf.where(_complete(cf, "cashflow"))
    inv = inv.where(_complete(inv, "inventory"))

    # the keys of the dimensions, found in one reading of the records and stored
    txn_keys = stored(txn.select("entity_rfc", "category_name").distinct(), "feed-keys")
    rfcs = stored(txn_keys.select(F.col("entity_rfc").alias("rfc"))
                  .unionByName(cf.select(F.col("entity_rfc").alias("rfc")))
                  .unionByName(inv.select(F.col("entity_rfc").alias("rfc"))).distinct(), "feed-rfcs")
    entities, new_entities = get_or_create(
        bronze["core_entity"], rfcs, ["rfc"],
        lambda k: k.select(deterministic_id(F.lit("entity"), "rfc").alias("id"), "rfc",
                           F.lit(DEFAULT_ENTITY_NAME).alias("name"),
                           F.lit(DEFAULT_ENTITY_TYPE).alias("entity_type"),
                           ts.alias("created_at")))
    # A feed usually carries one entity (the reference's has exactly one), so the
    # lookups below join on a single hot key: the dimensions are broadcast when
    # provably small, and the facts never shuffle on that key.
    ent_key, _ = bounded_broadcast(
        entities.select(F.col("id").alias("entity_id"), F.col("rfc").alias("entity_rfc")))

    accounts, new_accounts = get_or_create(
        bronze["core_account"],
        ent_key.join(txn_keys.select("entity_rfc").distinct(), "entity_rfc", "left_semi")
               .select("entity_id", F.lit(DEFAULT_ACCOUNT_TYPE).alias("account_type")),
        ["entity_id", "account_type"],
        lambda k: k.select(deterministic_id(F.lit("account"), "entity_id", "account_type").alias("id"),
                           "entity_id", "account_type", F.lit(DEFAULT_CURRENCY).alias("currency"),
                           ts.alias("created_at")))

    categories, new_categories = get_or_create(
        bronze["core_category"], txn_keys.select(F.col("category_name").alias("name")), ["name"],
        lambda k: k.select(deterministic_id(F.lit("category"), "name").alias("id"), "name",
                           F.lit(None).cast("string").alias("parent_id")))

    # Surrogate-key lookups (small dimensions: hash joins on distinct keys)
    acct_key, _ = bounded_broadcast(accounts.where(
        F.col("account_type") == DEFAULT_ACCOUNT_TYPE).select(F.col("id").alias("account_id"),
                                                              "entity_id"))
    cat_key, _ = bounded_broadcast(categories.select(F.col("id").alias("category_id"),
                                                     F.col("name").alias("category_name")))
    # one row for each uuid, which is one id, before the lookups widen it
    t = (_first_of_each(txn, "source_doc_ref", read).join(ent_key, "entity_rfc", "left").join(acct_key, "entity_id", "left")
         .join(cat_key, "category_name", "left"))
    known = bronze.get("transaction_ids", bronze["core_transaction"])
    new_txn = _new_transactions(known, t.select(
        deterministic_id(F.lit("txn"), "source_doc_ref", *salt).alias("id"), "account_id", "category_id",
        "date", "amount", "description", "source_doc_ref",
        F.lit(False).alias("is_duplicate_flag"), F.lit(None).cast("double").alias("confidence_score"),
        ts.alias("created_at")), mode)

    batch = F.concat_ws("|", "batch_id", *salt).alias("batch_id") if salt else F.col("batch_id")
    all_cf = cf.join(ent_key, "entity_rfc", "left").select(
        deterministic_id(F.lit("cashflow"), "batch_id", "_source_file", "_pos", *salt).alias("id"), "entity_id",
        "date", F.col("type").alias("event_type"), "amount", F.lit(False).alias("projected"), batch)
    new_cf = _new_batches(bronze["core_cashflowevent"], all_cf, mode)

    all_inv = inv.join(ent_key, "entity_rfc", "left").select(
        deterministic_id(F.lit("inventory"), "batch_id", "_source_file", "_pos", *salt).alias("id"), "entity_id",
        "sku", "date", "qty", "unit_cost", "turnover_rate", batch)
    new_inv = _new_batches(bronze["core_inventorysnapshot"], all_inv, mode)

    added = {"core_entity": new_entities, "core_account": new_accounts,
             "core_category": new_categories, "core_transaction": new_txn,
             "core_cashflowevent": new_cf, "core_inventorysnapshot": new_inv}
    core = [f.name for f in schemas.CORE_TRANSACTION.fields]
    after = {"core_entity": entities, "core_account": accounts, "core_category": categories,
             "core_transaction": bronze["core_transaction"].select(*core).unionByName(new_txn),
             "core_cashflowevent": bronze["core_cashflowevent"].select(*new_cf.columns).unionByName(new_cf),
             "core_inventorysnapshot": bronze["core_inventorysnapshot"].select(*new_inv.columns).unionByName(new_inv)}
    added.update({f"rejected_{kind}": df for kind, df in rejected.items()})
    added.update(replay_core_cashflowevent=all_cf, replay_core_inventorysnapshot=all_inv)
    return after, added


def load_counts(added: dict) -> DataFrame:
    """Rows added per table, as one small DataFrame (one job)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in added.items() if not name.startswith("replay_")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
