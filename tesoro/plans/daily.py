"""L1: the daily job (load -> build models -> run data tests) and S8 model
materialisation.

Storage layout under ``warehouse`` (a shared path on a cluster)::

    bronze/<table>/                 parquet; transactions by month and load, cash flow
                                    and inventory by month and batch, dimensions by load
    bronze/transaction_ids/         ids of all transactions, bucketed: the identity index
    run_log/                        finished steps of all runs
    models/<run_id>/_load/          what the run's feed added and rejected
    models/<run_id>/<model>/        marts written once per run, never overwritten
                                    in place; month-partitioned where the model
                                    has a month (partition pruning for reports)
    models/<run_id>/_tests/         data-test summary of the run (the dbt tests)
    models/<run_id>/_constraints/   D3-D6 checks of Bronze (the database constraints)
    marts/<model>/                  the same marts kept up by month (refresh_marts)

Re-running the same feed content adds no Bronze rows (idempotent load), and writes a fresh
run folder; new content at a known path is a new batch. A run that broke off and is started
again with its id goes on after its last finished step: what a load adds is staged before
Bronze changes, and written to partitions of its own, so that writing it again replaces
it. A staged load that never reached Bronze is finished before another run loads. Readers
take the models of the run that ``published_run`` names: the last one that finished. One
run at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesoro import schemas
from tesoro.operators import marts, quality, staging
from tesoro.plans.run_log import RunLog, published_run
from tesoro.sources import feed
from tesoro.session import ensure_checkpoint_dir
from tesoro.sources.literal import literal_frame

BRONZE_SCHEMAS = {
    "core_entity": schemas.CORE_ENTITY,
    "core_account": schemas.CORE_ACCOUNT,
    "core_category": schemas.CORE_CATEGORY,
    "core_transaction": schemas.CORE_TRANSACTION,
    "core_cashflowevent": schemas.CORE_CASHFLOWEVENT,
    "core_inventorysnapshot": schemas.CORE_INVENTORYSNAPSHOT,
}
# Models written month-partitioned.
MONTH_PARTITIONED = ("mart_monthly_cashflow", "mart_expense_summary", "mart_inventory_turnover",
                     "mart_profitability_flags")
# The reference's indexes, as sort orders within each written file: parquet
# min/max statistics then let filters on these keys skip row groups. A sort
# within partitions is local to each task (no shuffle).
CLUSTER_KEYS = {
    "core_transaction": ("account_id", "date"),
    "core_inventorysnapshot": ("entity_id", "sku", "date"),
    "core_cashflowevent": ("entity_id", "date"),
    "stg_transactions_deduped": ("account_id", "transaction_date"),
    "mart_monthly_cashflow": ("entity_id",),
    "mart_expense_summary": ("account_id",),
    "mart_inventory_turnover": ("entity_id", "sku"),
    "mart_profitability_flags": ("account_id",),
}
# Partition columns of the Bronze tables: a load writes partitions of its own.
BRONZE_PARTITION = {"core_entity": ("load",), "core_account": ("load",), "core_category": ("load",),
                    "core_transaction": ("month", "load"), "core_cashflowevent": ("month", "batch_id"),
                    "core_inventorysnapshot": ("month", "batch_id")}
# Buckets of the identity index when a warehouse is made: about one for each ten million
# transactions that it is to hold.
ID_BUCKETS = 16
BRONZE_ORDER = ("core_entity", "core_account", "core_category",
                "core_transaction", "core_cashflowevent", "core_inventorysnapshot")


def clustered(df: DataFrame, name: str) -> DataFrame:
    """Rows ordered for the write. A month- or batch-partitioned table is dealt by that
    column first (Spark splits a large month and joins small ones), so that a task does
    not leave a small file in every partition."""
    part = "month" if name in MONTH_PARTITIONED else BRONZE_PARTITION.get(name, (None,))[0]
    if part:
        df = df.hint("rebalance", F.col(part))
    keys = ([part] if part else []) + list(CLUSTER_KEYS.get(name, ()))
    return df.sortWithinPartitions(*keys) if keys else df


def transaction_ids(spark: SparkSession, warehouse: str, buckets: int = ID_BUCKETS) -> str:
    """S3: the name of the identity index of a warehouse, a table of (id, load) bucketed by
    id below its Bronze folder, so that looking up new ids never shuffles the history.
    Registered in the session's catalog if need be; an index that is empty is filled from
    Bronze."""
    name = f"tesoro_ids_{hashlib.sha256(warehouse.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        path = f"{warehouse}/bronze/transaction_ids".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id STRING, load STRING) USING parquet "
                  f"CLUSTERED BY (id) INTO {buckets} BUCKETS LOCATION '{path}'")
        if spark.table(name).isEmpty():
            _add_ids(_stored(spark, warehouse, "core_transaction").select("id", "load"), warehouse, buckets)
    spark.catalog.refreshTable(name)  # another session may have added to it
    return name


def _add_ids(rows: DataFrame, warehouse: str, buckets: int = ID_BUCKETS) -> None:
    spark = rows.sparkSession
    name = transaction_ids(spark, warehouse)
    rows.select("id", "load").repartition(buckets, "id").write.mode("append").bucketBy(buckets, "id").format(
        "parquet").saveAsTable(name)


def append_bronze(added: dict, warehouse: str, load: str) -> None:
    """S3-S5 sink (dimensions first). New rows of transactions and dimensions go to
    partitions of the ``load``, cash flow and inventory to those of their batches, and
    what these held is overwritten: a replay, also one after a write that broke off,
    leaves each row once. A whole batch may be given as ``replay_<table>``; else the new
    rows are it."""
    for name in BRONZE_ORDER:
        rows = added.get(f"replay_{name}", added[name])
        if "month" in BRONZE_PARTITION[name]:
            rows = rows.withColumn("month", F.trunc("date", "month"))
        if "load" in BRONZE_PARTITION[name]:
            rows = rows.withColumn("load", F.lit(load))
        writer = clustered(rows, name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*BRONZE_PARTITION[name]).parquet(f"{warehouse}/bronze/{name}")
        if name == "core_transaction":
            _add_ids(rows, warehouse)  # a replay adds them again, which changes no answer


def _stored(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """A Bronze table with its partition columns; empty before the first load. Any other
    error than a missing path is raised."""
    extra = {"month": T.DateType(), "load": T.StringType()}
    schema = T.StructType([*BRONZE_SCHEMAS[name].fields, *(T.StructField(c, extra[c]) for c in BRONZE_PARTITION[name] if c in extra)])
    try:
        return spark.read.schema(schema).parquet(f"{warehouse}/bronze/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return literal_frame(spark, [], schema)


def read_bronze(spark: SparkSession, warehouse: str, load: str | None = None) -> dict:
    """S2 on Bronze: every table, and ``transaction_ids``, the ids that loads other than
    ``load`` have added."""
    out = {name: _stored(spark, warehouse, name).drop("load") for name in BRONZE_SCHEMAS}
    out["transaction_ids"] = spark.table(transaction_ids(spark, warehouse))
    if load is not None:
        out["transaction_ids"] = out["transaction_ids"].where(F.col("load") != load)
        # what a broken attempt of this load has written is written again
        for name in ("core_entity", "core_account", "core_category"):
            out[name] = _stored(spark, warehouse, name).where(F.col("load") != load).drop("load")
    return out


def build_models(bronze: dict) -> dict:
    """The dbt model graph as lazy DataFrames (S8 ``ref``)."""
    stg_t = staging.stg_transactions(bronze["core_transaction"])
    stg_c = staging.stg_cashflow(bronze["core_cashflowevent"])
    stg_i = staging.stg_inventory(bronze["core_inventorysnapshot"])
    deduped = staging.flag_duplicates(stg_t)
    expense = marts.expense_summary(deduped, bronze["core_category"])
    return {
        "stg_transactions": stg_t,
        "stg_cashflow": stg_c,
        "stg_inventory": stg_i,
        "stg_transactions_deduped": deduped,
        "mart_monthly_cashflow": marts.monthly_cashflow(stg_c),
        "mart_expense_summary": expense,
        "mart_inventory_turnover": marts.inventory_turnover(stg_i),
        "mart_profitability_flags": marts.profitability_flags(expense),
    }


def data_tests(models: dict) -> DataFrame:
    """The reference's dbt tests (2 unique, 5 not_null) as one summary table; the
    not_null tests of a model are one scan."""
    return quality.union_all([
        quality.summarize([
            ("stg_transactions", "transaction_id", "unique",
             quality.unique(models["stg_transactions"], "transaction_id")),
            ("stg_cashflow", "cashflow_event_id", "unique",
             quality.unique(models["stg_cashflow"], "cashflow_event_id"))]),
        quality.null_counts(models["stg_transactions"], "stg_transactions", ["transaction_id", "amount"]),
        quality.null_counts(models["stg_cashflow"], "stg_cashflow", ["cashflow_event_id"]),
        quality.null_counts(models["mart_monthly_cashflow"], "mart_monthly_cashflow", ["month"]),
        quality.null_counts(models["mart_profitability_flags"], "mart_profitability_flags", ["category"]),
    ])


def bronze_checks(bronze: dict) -> DataFrame:
    """D3-D6 on Bronze: the constraints the reference's database declares
    (choices, foreign keys, varchar lengths, unique rfc), one scan a table."""
    e, a, c = bronze["core_entity"], bronze["core_account"], bronze["core_category"]
    t, i, f = bronze["core_transaction"], bronze["core_inventorysnapshot"], bronze["core_cashflowevent"]
    a_rows, (a_entity,) = quality.with_parents(a, [("entity_id", e, "id")])
    t_rows, (t_account, t_category) = quality.with_parents(
        t, [("account_id", a, "id"), ("category_id", c, "id")])
    i_rows, (i_entity,) = quality.with_parents(i, [("entity_id", e, "id")])
    f_rows, (f_entity,) = quality.with_parents(f, [("entity_id", e, "id")])
    return quality.union_all([
        quality.summarize([("core_entity", "rfc", "unique", quality.unique(e, "rfc"))]),
        quality.failures(e, "core_entity", [
            ("rfc", "max_length_13", quality.longer_than("rfc", 13)),
            ("entity_type", "accepted_values", quality.not_accepted("entity_type", schemas.ENTITY_TYPES))]),
        quality.failures(a_rows, "core_account", [
            ("account_type", "accepted_values", quality.not_accepted("account_type", schemas.ACCOUNT_TYPES)),
            ("entity_id", "relationships", a_entity)]),
        quality.failures(c, "core_category", [("name", "max_length_100", quality.longer_than("name", 100))]),
        quality.failures(t_rows, "core_transaction", [
            ("account_id", "relationships", t_account), ("category_id", "relationships", t_category),
            ("description", "max_length_500", quality.longer_than("description", 500)),
            ("source_doc_ref", "max_length_255", quality.longer_than("source_doc_ref", 255))]),
        quality.failures(i_rows, "core_inventorysnapshot", [
            ("entity_id", "relationships", i_entity), ("sku", "max_length_100", quality.longer_than("sku", 100))]),
        quality.failures(f_rows, "core_cashflowevent", [
            ("entity_id", "relationships", f_entity),
            ("event_type", "accepted_values", quality.not_accepted("event_type", schemas.EVENT_TYPES))]),
    ])


def register_views(models: dict) -> None:
    """S8 as views: every model is queryable by its dbt name from SQL."""
    for name, df in models.items():
        df.createOrReplaceTempView(name)


def materialise(models: dict, path: str, names=None) -> dict:
    """S8 as tables: write models to a fresh folder; returns {model: path}."""
    written = {}
    for name in names or ("stg_transactions_deduped", *MONTH_PARTITIONED):
        written[name] = write_model(models[name], name, path)
    return written


def write_model(df: DataFrame, name: str, path: str, mode: str = "errorifexists") -> str:
    target = f"{path}/{name}"
    writer = clustered(df, name).write.mode(mode)
    if name in MONTH_PARTITIONED:
        writer = writer.partitionBy("month")
    writer.parquet(target)
    return target


def build_stored_models(spark: SparkSession, bronze: dict, path: str, log: RunLog) -> tuple[dict, dict]:
    """P1-P3, W5, A1-A3, R2, written one after the other: each model reads the stored
    one before it, so the duplicate windows and the expense aggregate run once. Models
    that the ``log`` has are there already; parts of one that broke off are replaced.
    Returns (models, with the stored ones read back, and {model: path})."""
    models = {"stg_transactions": staging.stg_transactions(bronze["core_transaction"]),
              "stg_cashflow": staging.stg_cashflow(bronze["core_cashflowevent"]),
              "stg_inventory": staging.stg_inventory(bronze["core_inventorysnapshot"])}
    written = {}

    def keep(name: str, build) -> DataFrame:
        written[name] = f"{path}/{name}"
        if log.has(f"model:{name}"):
            models[name] = spark.read.parquet(written[name])
        else:
            df = build()
            write_model(df, name, path, "overwrite")
            log.add(f"model:{name}")
            models[name] = spark.read.schema(df.schema).parquet(written[name])
        return models[name]

    deduped = keep("stg_transactions_deduped", lambda: staging.flag_duplicates(models["stg_transactions"]))
    expense = keep("mart_expense_summary", lambda: marts.expense_summary(deduped, bronze["core_category"]))
    keep("mart_profitability_flags", lambda: marts.profitability_flags(expense))
    keep("mart_monthly_cashflow", lambda: marts.monthly_cashflow(models["stg_cashflow"]))
    keep("mart_inventory_turnover", lambda: marts.inventory_turnover(models["stg_inventory"]))
    return models, written


def _staged(spark: SparkSession, warehouse: str, run_id: str) -> dict:
    """The staged load of a run."""
    names = [*BRONZE_ORDER, "replay_core_cashflowevent", "replay_core_inventorysnapshot"]
    return {name: spark.read.parquet(f"{warehouse}/models/{run_id}/_load/{name}") for name in names}


# The marts that follow from one Bronze table, month by month: what a mart says of a month
# depends on that table's rows of the month alone (duplicates share their date).
MARTS_OF = {"core_transaction": ("stg_transactions_deduped", "mart_expense_summary"),
            "core_cashflowevent": ("mart_monthly_cashflow",), "core_inventorysnapshot": ("mart_inventory_turnover",)}


def _months_to_refresh(spark: SparkSession, warehouse: str, log: RunLog) -> dict[str, list]:
    """For each Bronze fact the months that loads have touched since the marts were
    refreshed; all months before the first time. At most a calendar's months come back."""
    loads = sorted({run for run, step in log.done if step == "bronze" and not log.has("marts", run)})
    first = not any(step == "marts" for _, step in log.done)
    out = {}
    for table in MARTS_OF:
        if first:
            months = _stored(spark, warehouse, table).select("month")
        else:
            months = literal_frame(spark, [], T.StructType([T.StructField("month", T.DateType())]))
            for load in loads:
                months = months.unionByName(_staged(spark, warehouse, load)[table].select(F.trunc("date", "month").alias("month")))
        out[table] = sorted(r["month"] for r in months.distinct().collect())
    return out


def refresh_marts(spark: SparkSession, warehouse: str) -> dict:
    """A1-A3, W5 and R2 kept up under ``marts/``: only the months that loads have touched
    since the last refresh are built again, from Bronze partitions of these months, and
    replace their partitions. The flags compare a month with the five before, so they are
    built from the whole expense mart (one row for each account, category and month).
    Loads are those of ``run_daily``; the first refresh takes all of Bronze.
    Returns {model: path}. One that breaks off leaves its months to the next one."""
    warehouse = warehouse.rstrip("/")
    log = RunLog(spark, warehouse, "marts")
    paths = {name: f"{warehouse}/marts/{name}" for names in MARTS_OF.values() for name in names}
    paths["mart_profitability_flags"] = f"{warehouse}/marts/mart_profitability_flags"
    loads = sorted({run for run, step in log.done if step == "bronze" and not log.has("marts", run)})

    def write(name: str, df: DataFrame) -> DataFrame:
        if "month" not in df.columns:  # the rows behind the expense mart
            df = df.withColumn("month", F.trunc("transaction_date", "month"))
        (df.hint("rebalance", F.col("month")).sortWithinPartitions("month", *CLUSTER_KEYS[name]).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(paths[name]))
        return spark.read.schema(df.schema).parquet(paths[name])

    months = _months_to_refresh(spark, warehouse, log)
    rows = {t: _stored(spark, warehouse, t).where(F.col("month").isin(m)) for t, m in months.items() if m}
    if "core_transaction" in rows:
        touched = months["core_transaction"]
        stg = staging.stg_transactions(rows["core_transaction"])
        deduped = write("stg_transactions_deduped", staging.flag_duplicates(stg)).where(F.col("month").isin(touched)).drop("month")
        categories = _stored(spark, warehouse, "core_category").drop("load")
        expense = write("mart_expense_summary", marts.expense_summary(deduped, categories))
        flags = marts.profitability_flags(expense)
        flags.hint("rebalance", F.col("month")).write.mode("overwrite").partitionBy("month").parquet(paths["mart_profitability_flags"])
    if "core_cashflowevent" in rows:
        write("mart_monthly_cashflow", marts.monthly_cashflow(staging.stg_cashflow(rows["core_cashflowevent"])))
    if "core_inventorysnapshot" in rows:
        write("mart_inventory_turnover", marts.inventory_turnover(staging.stg_inventory(rows["core_inventorysnapshot"])))
    for load in loads or ["marts"]:
        log.add("marts", run_id=load)
    return paths


def read_published(spark: SparkSession, warehouse: str, model: str) -> DataFrame:
    """A model of the run that finished last; LookupError before the first one."""
    warehouse = warehouse.rstrip("/")
    run_id = published_run(spark, warehouse)
    if run_id is None:
        raise LookupError(f"no run of {warehouse} has finished")
    return spark.read.parquet(f"{warehouse}/models/{run_id}/{model}")


def run_daily(spark: SparkSession, feed_dir: str, warehouse: str, run_id: str, load_ts,
              mode: str = "idempotent", batch_id: str | None = None) -> dict:
    """L1: load the feed into Bronze, rebuild the models, run the data tests.

    Tests run after the marts are written, as in the reference: they report,
    they do not hold data back. Rejected records are stored with the run. The load's
    new rows are stored once, counted while they are written, and appended from there.
    Started again with the same ``run_id``, it goes on after the last finished step.
    Returns the S7 load counts, the written model paths and the test summary (as
    DataFrames read back from storage).
    """
    ensure_checkpoint_dir(spark)
    warehouse = warehouse.rstrip("/")
    out = f"{warehouse}/models/{run_id}"
    log = RunLog(spark, warehouse, run_id)
    for broken in log.open_loads():
        append_bronze(_staged(spark, warehouse, broken), warehouse, broken)
        log.add("bronze", run_id=broken)
    if not log.has("staged"):
        _, added = feed.load_feed(spark, feed_dir, read_bronze(spark, warehouse, run_id), load_ts, mode, batch_id)
        counts = []
        for name, df in added.items():
            seen = Observation(name)
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{out}/_load/{name}")
            if not name.startswith("replay_"):
                counts.append((f"rows:{name}", seen.get["rows"]))
        log.add(*counts, "staged")
    if not log.has("bronze"):
        append_bronze(_staged(spark, warehouse, run_id), warehouse, run_id)
        log.add("bronze")
    load_counts = literal_frame(spark, list(log.rows("rows").items()), T.StructType([
        T.StructField("table", T.StringType()), T.StructField("rows", T.LongType())]))
    bronze = read_bronze(spark, warehouse)
    models, written = build_stored_models(spark, bronze, out, log)
    for name, checks in (("_tests", lambda: data_tests(models)), ("_constraints", lambda: bronze_checks(bronze))):
        if not log.has(name):
            checks().write.mode("overwrite").parquet(f"{out}/{name}")
            log.add(name)
    if not log.has("published"):
        log.add("published")
    return {"load_counts": load_counts, "models": written,
            "tests": spark.read.parquet(f"{out}/_tests"),
            "constraints": spark.read.parquet(f"{out}/_constraints")}
