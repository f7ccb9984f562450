"""Data-quality checks D1-D7 on DataFrames.

Each check returns the *failing* rows (or values) as a lazy DataFrame, like a
dbt test's SELECT; ``summarize`` turns a list of them into one small table of failure
counts. ``failures`` counts any number of row checks of one table in a single scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesoro.functions.storage import stored

SUMMARY_COLUMNS = ("model", "column_name", "test", "failures")


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that occur more than once (NULLs ignored).

    Partial aggregation runs map-side, so a hot value is combined before the
    shuffle."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") > 1))


# Failing-row predicates: combined by ``failures`` into one scan of a table.

def is_null(column: str) -> Column:
    """D2."""
    return F.col(column).isNull()


def not_accepted(column: str, values) -> Column:
    """D3: a non-NULL value outside ``values``."""
    return F.col(column).isNotNull() & ~F.col(column).isin(*values)


def longer_than(column: str, max_length: int) -> Column:
    """A string longer than the varchar(n) limit."""
    return F.length(F.col(column).cast("string")) > max_length


def not_a_decimal(column: str, precision: int, scale: int) -> Column:
    """A value that does not fit DECIMAL(precision, scale) exactly.

    ``try_cast`` catches overflow and non-numbers; extra decimals would be
    rounded silently, so the value is also compared with a wider cast."""
    c = F.col(column)
    narrow = c.try_cast(f"decimal({precision},{scale})")
    wide = c.try_cast("decimal(38,10)")
    return c.isNotNull() & (narrow.isNull() | wide.isNull() | (narrow.cast("decimal(38,10)") != wide))


def with_parents(child: DataFrame, links) -> tuple[DataFrame, list[Column]]:
    """D4 for several foreign keys of one table: ``links`` is a list of (fk, parent,
    pk). Returns the child joined with its parents' distinct keys, and a predicate for
    each link: a non-NULL key without a parent. Spark broadcasts parents by their size;
    larger ones are shuffle joins, which adaptive execution splits where a key is hot."""
    orphans = []
    for i, (fk, parent, pk) in enumerate(links):
        keys = parent.select(F.col(pk).alias(f"_pk{i}")).where(F.col(pk).isNotNull()).distinct()
        child = child.join(keys, F.col(fk) == F.col(f"_pk{i}"), "left")
        orphans.append(F.col(fk).isNotNull() & F.col(f"_pk{i}").isNull())
    return child, orphans


def failures(df: DataFrame, model: str, checks) -> DataFrame:
    """Several checks of one model in one scan: ``checks`` is a list of (column, test,
    failing predicate). Returns (model, column_name, test, failures)."""
    counts = df.agg(*[F.count_if(failing).alias(f"_{i}") for i, (_, _, failing) in enumerate(checks)])
    stack = ", ".join(f"'{c}', '{t}', _{i}" for i, (c, t, _) in enumerate(checks))
    return counts.select(F.expr(f"stack({len(checks)}, {stack}) AS (column_name, test, failures)")).select(
        F.lit(model).alias("model"), "column_name", "test", "failures")


def union_all(parts) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows where ``column`` is NULL."""
    return df.where(is_null(column))


def accepted_values(df: DataFrame, column: str, values) -> DataFrame:
    """D3: rows whose non-NULL ``column`` is outside ``values``."""
    return df.where(not_accepted(column, values))


def relationships(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent row."""
    keys = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == keys["_pk"], "left_anti")


def too_long(df: DataFrame, column: str, max_length: int) -> DataFrame:
    """Rows with a string longer than the varchar(n) limit."""
    return df.where(longer_than(column, max_length))


def not_decimal(df: DataFrame, column: str, precision: int, scale: int) -> DataFrame:
    """Rows with a value that does not fit DECIMAL(precision, scale) exactly."""
    return df.where(not_a_decimal(column, precision, scale))


def cascade_delete(child: DataFrame, fk: str, deleted_keys: DataFrame, key: str) -> DataFrame:
    """D7 CASCADE: child rows that survive deleting the parents in ``deleted_keys``."""
    gone = deleted_keys.select(F.col(key).alias("_gone")).distinct()
    return child.join(gone, F.col(fk) == gone["_gone"], "left_anti")


def set_null_on_delete(child: DataFrame, fk: str, deleted_keys: DataFrame, key: str) -> DataFrame:
    """D7 SET NULL: child rows with ``fk`` cleared where the parent was deleted."""
    gone = deleted_keys.select(F.col(key).alias("_gone"), F.lit(True).alias("_hit")).distinct()
    joined = child.join(gone, F.col(fk) == gone["_gone"], "left")
    return joined.withColumn(fk, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(fk))) \
                 .drop("_gone", "_hit")


# The foreign keys of the model: child table, column, parent, and what a deleted parent does.
FOREIGN_KEYS = (
    ("core_account", "entity_id", "core_entity", "cascade"),
    ("core_inventorysnapshot", "entity_id", "core_entity", "cascade"),
    ("core_cashflowevent", "entity_id", "core_entity", "cascade"),
    ("core_transaction", "account_id", "core_account", "cascade"),
    ("core_transaction", "category_id", "core_category", "set_null"),
    ("core_category", "parent_id", "core_category", "set_null"),
)


def delete_closure(tables: dict, deleted: dict, foreign_keys=FOREIGN_KEYS) -> tuple[dict, dict]:
    """D7 to the end: delete the rows of ``deleted`` (table -> frame with ``id``) and all
    that hangs on them along ``foreign_keys``, parents before children. Returns (the
    tables afterwards, the deleted ids of each table as frames).

    A cascading key deletes the child rows, whose own children follow; a key that is set
    null keeps them. A table that refers to itself by a cascading key is followed level by
    level until a level is empty (each level is stored; deeper than the tree is no level,
    so cycles end, too). Joins are on keys, so Spark broadcasts few deleted ids and
    shuffles many; ids that aren't in a table delete nothing there.
    """
    order, rest = [], list(tables)
    while rest:  # parents first; a reference to the own table doesn't count
        ready = [t for t in rest if all(p == t or p not in rest for c, _, p, _ in foreign_keys if c == t)]
        if not ready:
            raise ValueError(f"foreign keys of {sorted(rest)} form a cycle")
        order += ready
        rest = [t for t in rest if t not in ready]
    gone: dict = {}
    for table in order:
        rows = tables[table]
        found = []
        if table in deleted:
            found.append(rows.join(deleted[table].select("id").distinct(), "id", "left_semi").select("id"))
        for child, column, parent, action in foreign_keys:
            if child == table and parent != table and action == "cascade" and parent in gone:
                keys = gone[parent].select(F.col("id").alias("_gone"))
                found.append(rows.join(keys, F.col(column) == keys["_gone"], "left_semi").select("id"))
        if not found:
            continue
        ids = found[0]
        for more in found[1:]:
            ids = ids.unionByName(more)
        ids = stored(ids.distinct(), "deleted-ids")
        for child, column, parent, action in foreign_keys:
            level = ids
            while child == parent == table and action == "cascade" and not level.isEmpty():
                keys = level.select(F.col("id").alias("_gone"))
                below = rows.join(keys, F.col(column) == keys["_gone"], "left_semi").select("id").distinct()
                level = stored(below.join(ids, "id", "left_anti"), "deleted-ids")
                ids = ids.unionByName(level)
        gone[table] = ids
    after = {}
    for table, rows in tables.items():
        if table in gone:
            rows = cascade_delete(rows, "id", gone[table], "id")
        for child, column, parent, action in foreign_keys:
            if child == table and action == "set_null" and parent in gone:
                rows = set_null_on_delete(rows, column, gone[parent], "id").select(*tables[table].columns)
        after[table] = rows
    return after, gone


def summarize(checks) -> DataFrame:
    """One row per check: (model, column_name, test, failures).

    ``checks`` is a list of (model, column, test_name, failing DataFrame)."""
    return union_all([
        failing.agg(F.count(F.lit(1)).alias("failures")).select(
            F.lit(model).alias("model"), F.lit(column).alias("column_name"), F.lit(test).alias("test"), "failures")
        for model, column, test, failing in checks])


def null_counts(df: DataFrame, model: str, columns) -> DataFrame:
    """D2 for several columns in one scan: (model, column_name, test, failures)."""
    return failures(df, model, [(c, "not_null", is_null(c)) for c in columns])
