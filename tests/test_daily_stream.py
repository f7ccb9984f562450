import datetime as dt
import json
import shutil

import pytest

from conftest import rows
from test_feed_quality import write_feed
from tesoro.plans import daily
from tesoro.streaming.feed_stream import start_feed_stream


def test_run_daily_twice_is_idempotent(spark, tmp_path):
    feed_dir = write_feed(tmp_path / "feed")
    wh = str(tmp_path / "wh")
    first = daily.run_daily(spark, feed_dir, wh, "run1", dt.datetime(2026, 1, 1))
    assert dict(rows(first["load_counts"]))["core_transaction"] == 4
    tests = {(r["model"], r["column_name"], r["test"]): r["failures"] for r in first["tests"].collect()}
    assert tests[("stg_transactions", "transaction_id", "unique")] == 0
    assert tests[("mart_monthly_cashflow", "month", "not_null")] == 0
    constraints = {(r["model"], r["column_name"], r["test"]): r["failures"]
                   for r in first["constraints"].collect()}
    assert constraints[("core_entity", "rfc", "unique")] == 0
    assert constraints[("core_transaction", "category_id", "relationships")] == 0
    assert sum(constraints.values()) == 0
    mart = spark.read.parquet(first["models"]["mart_monthly_cashflow"])
    assert "month" in mart.columns and mart.count() == 2
    second = daily.run_daily(spark, feed_dir, wh, "run2", dt.datetime(2026, 1, 2))
    assert {r[1] for r in rows(second["load_counts"]) if not r[0].startswith("rejected")} == {0}
    bronze = daily.read_bronze(spark, wh)
    assert bronze["core_transaction"].count() == 4
    dedup = spark.read.parquet(second["models"]["stg_transactions_deduped"])
    assert dedup.where("is_likely_duplicate").count() == 2        # the injected pair only


def test_daily_load_is_lossless_and_models_build_once(spark, tmp_path, monkeypatch):
    from tesoro.operators import staging
    calls = []
    flag = staging.flag_duplicates
    monkeypatch.setattr(staging, "flag_duplicates", lambda *a, **k: calls.append(1) or flag(*a, **k))
    feed_dir = write_feed(tmp_path / "feed")
    wh = str(tmp_path / "wh")
    daily.run_daily(spark, feed_dir, wh, "run1", dt.datetime(2026, 1, 1))
    cash = tmp_path / "feed" / "cashflow.json"
    records = json.loads(cash.read_text())
    cash.write_text(json.dumps([{**r, "date": "2025-06-01"} for r in records]))
    (tmp_path / "feed" / "inventory.json").write_text("[{")
    second = daily.run_daily(spark, feed_dir, wh, "run2", dt.datetime(2026, 1, 2))
    counts = dict(rows(second["load_counts"]))
    assert (counts["core_cashflowevent"], counts["rejected_inventory"], counts["core_transaction"]) == (3, 1, 0)
    assert daily.read_bronze(spark, wh)["core_cashflowevent"].count() == 6
    assert len(calls) == 2  # once a run
    # the stored models are those of the whole graph
    whole = daily.build_models(daily.read_bronze(spark, wh))["mart_expense_summary"]
    stored = spark.read.schema(whole.schema).parquet(second["models"]["mart_expense_summary"])
    assert rows(stored, *whole.columns) == rows(whole, *whole.columns)


def test_a_replayed_batch_overwrites_itself(spark, tmp_path):
    from tesoro.sources import feed
    feed_dir, wh = write_feed(tmp_path / "feed"), str(tmp_path / "wh")
    _, added = feed.load_feed(spark, feed_dir, feed.empty_bronze(spark), dt.datetime(2026, 1, 1))
    for _ in range(2):  # the same micro-batch again, as after a crash between two tables
        daily.append_bronze({**added, "core_transaction": added["core_transaction"].limit(0)}, wh, "load1")
    assert daily.read_bronze(spark, wh)["core_cashflowevent"].count() == 3


def test_only_a_missing_path_reads_as_empty(spark, tmp_path):
    wh = tmp_path / "wh"
    assert daily.read_bronze(spark, str(wh))["core_entity"].count() == 0
    (wh / "bronze" / "core_entity" / "part=1" / "x=2").mkdir(parents=True)
    (wh / "bronze" / "core_entity" / "part=1" / "f.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        daily.read_bronze(spark, str(wh))["core_entity"].count()


def test_streaming_feed_load(spark, tmp_path):
    src = tmp_path / "src"
    write_feed(src)
    root = tmp_path / "landing"
    for kind in ("transactions", "cashflow", "inventory"):
        (root / kind).mkdir(parents=True)
        shutil.copy(src / f"{kind}.json", root / kind / "day1.json")
    wh, ck = str(tmp_path / "wh"), str(tmp_path / "ck")
    start_feed_stream(spark, str(root), wh, ck, dt.datetime(2026, 1, 1)).awaitTermination(120)
    bronze = daily.read_bronze(spark, wh)
    assert bronze["core_transaction"].count() == 4
    assert bronze["core_cashflowevent"].count() == 3
    assert bronze["core_inventorysnapshot"].count() == 1
    # a restart sees no new files: nothing is added twice
    start_feed_stream(spark, str(root), wh, ck, dt.datetime(2026, 1, 2)).awaitTermination(120)
    assert daily.read_bronze(spark, wh)["core_transaction"].count() == 4
    # a new file is loaded whole, a cut one is skipped, a known uuid stays one row
    cash = json.loads((src / "cashflow.json").read_text())
    (root / "cashflow" / "day2.json").write_text(json.dumps([{**r, "date": "2025-01-01"} for r in cash]))
    (root / "cashflow" / "day3.json").write_text("[{\"entity_rfc\"")
    (root / "transactions" / "day2.json").write_text((src / "transactions.json").read_text())
    start_feed_stream(spark, str(root), wh, ck, dt.datetime(2026, 1, 3)).awaitTermination(120)
    bronze = daily.read_bronze(spark, wh)
    assert bronze["core_cashflowevent"].count() == 6 and bronze["core_transaction"].count() == 4


def test_a_uuid_sent_again_in_another_month_is_one_row(spark, tmp_path):
    feed_dir, wh = write_feed(tmp_path / "feed"), str(tmp_path / "wh")
    daily.run_daily(spark, feed_dir, wh, "run1", dt.datetime(2026, 1, 1))
    path = tmp_path / "feed" / "transactions.json"
    records = json.loads(path.read_text())
    loaded = {r["source_doc_ref"] for r in daily.read_bronze(spark, wh)["core_transaction"].collect()}
    path.write_text(json.dumps([{**r, "fecha_emision": "2027-02-01"} for r in records if r["uuid"] in loaded]
                               + [{**records[0], "uuid": "new"}]))
    again = daily.run_daily(spark, feed_dir, wh, "run2", dt.datetime(2026, 1, 2))
    assert dict(rows(again["load_counts"]))["core_transaction"] == 1
    stored = daily.read_bronze(spark, wh)["core_transaction"]
    assert stored.count() == stored.select("id").distinct().count() == 5
    # a session that doesn't know the index yet finds it below the warehouse
    spark.sql(f"DROP TABLE {daily.transaction_ids(spark, wh)}")
    assert daily.read_bronze(spark, wh)["transaction_ids"].select("id").distinct().count() == 5


def test_new_ids_are_looked_up_without_a_shuffle_of_the_history(spark, tmp_path):
    from tesoro.sources import feed
    feed_dir, wh = write_feed(tmp_path / "feed"), str(tmp_path / "wh")
    daily.run_daily(spark, feed_dir, wh, "run1", dt.datetime(2026, 1, 1))
    known = daily.read_bronze(spark, wh, "run2")["transaction_ids"]
    rows_ = spark.range(50).selectExpr("cast(id AS string) AS id", "'f' AS _source_file", "1 AS _pos", "id AS amount")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = feed._new_transactions(known, rows_, "idempotent")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    join = plan.index("SortMergeJoin")
    right = plan[join:].split("FileScan parquet")[0].rsplit("+- ", 3)
    assert "Bucketed: true" in plan and "Exchange" not in "".join(right[1:])


@pytest.mark.parametrize("broken", ["staged", "bronze", "model:mart_profitability_flags"])
def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, broken):
    from tesoro.plans import run_log
    feed_dir, wh = write_feed(tmp_path / "feed"), str(tmp_path / "wh")
    add = run_log.RunLog.add

    def fail(self, *steps, **more):
        if broken in steps:
            raise RuntimeError("lost")
        add(self, *steps, **more)
    with monkeypatch.context() as patch:
        patch.setattr(run_log.RunLog, "add", fail)
        with pytest.raises(RuntimeError):
            daily.run_daily(spark, feed_dir, wh, "run1", dt.datetime(2026, 1, 1))
    with pytest.raises(LookupError):
        daily.read_published(spark, wh, "mart_monthly_cashflow")
    result = daily.run_daily(spark, feed_dir, wh, "run1", dt.datetime(2026, 1, 1))
    counts = dict(rows(result["load_counts"]))
    assert (counts["core_transaction"], counts["core_cashflowevent"], counts["core_entity"]) == (4, 3, 2)
    bronze = daily.read_bronze(spark, wh)
    assert {n: bronze[n].count() for n in ("core_transaction", "core_cashflowevent", "core_entity", "core_inventorysnapshot")} \
        == {"core_transaction": 4, "core_cashflowevent": 3, "core_entity": 2, "core_inventorysnapshot": 1}
    assert daily.read_published(spark, wh, "mart_monthly_cashflow").count() == 2
    assert sum(r["failures"] for r in result["constraints"].collect()) == 0


def test_a_staged_load_reaches_bronze_before_the_next_run(spark, tmp_path, monkeypatch):
    """The first run dies between two Bronze tables and is never started again."""
    feed_dir, wh = write_feed(tmp_path / "feed"), str(tmp_path / "wh")
    write = daily._add_ids
    with monkeypatch.context() as patch:
        patch.setattr(daily, "_add_ids", lambda rows_, *_: (_ for _ in ()).throw(RuntimeError("lost")) if rows_.count() else write(rows_, *_))
        with pytest.raises(RuntimeError):
            daily.run_daily(spark, feed_dir, wh, "run1", dt.datetime(2026, 1, 1))
    assert daily.published_run(spark, wh) is None
    second = daily.run_daily(spark, feed_dir, wh, "run2", dt.datetime(2026, 1, 2))
    assert {n for t, n in rows(second["load_counts"]) if not t.startswith("rejected")} == {0}
    bronze = daily.read_bronze(spark, wh)
    assert bronze["core_transaction"].count() == 4 and bronze["core_inventorysnapshot"].count() == 1
    assert daily.published_run(spark, wh) == "run2"


def test_marts_are_refreshed_for_touched_months_only(spark, tmp_path, monkeypatch):
    feed_dir, wh = write_feed(tmp_path / "feed"), str(tmp_path / "wh")
    daily.run_daily(spark, feed_dir, wh, "run1", dt.datetime(2026, 1, 1))
    paths = daily.refresh_marts(spark, wh)
    source = tmp_path / "feed"
    sent = json.loads((source / "transactions.json").read_text())
    (source / "transactions.json").write_text(json.dumps(
        [{**sent[0], "uuid": "late", "total": 50.0}, {**sent[0], "uuid": "next", "fecha_emision": "2024-09-01"}]))
    cash = json.loads((source / "cashflow.json").read_text())
    (source / "cashflow.json").write_text(json.dumps([{**cash[0], "date": "2024-11-05"}]))
    (source / "inventory.json").write_text("[]")
    daily.run_daily(spark, feed_dir, wh, "run2", dt.datetime(2026, 1, 2))
    months = daily._months_to_refresh(spark, wh, daily.RunLog(spark, wh, "marts"))
    assert {t: [str(m)[:7] for m in found] for t, found in months.items()} == {
        "core_transaction": [sent[0]["fecha_emision"][:7], "2024-09"], "core_cashflowevent": ["2024-11"], "core_inventorysnapshot": []}
    files = lambda name: {f: f.stat().st_mtime_ns for f in (tmp_path / "wh" / "marts" / name).glob("month=*/*.parquet")}
    before = {name: files(name) for name in ("mart_expense_summary", "mart_monthly_cashflow", "mart_inventory_turnover")}
    read, seen = daily._stored, []
    monkeypatch.setattr(daily, "_stored", lambda s, w, t: seen.append(t) or read(s, w, t))
    daily.refresh_marts(spark, wh)
    assert "core_inventorysnapshot" not in seen and files("mart_inventory_turnover") == before["mart_inventory_turnover"]
    kept = [f for f in before["mart_expense_summary"] if "2024-03" in f.parent.name]
    assert kept and all(files("mart_expense_summary").get(f) == before["mart_expense_summary"][f] for f in kept)
    # equal to the models of the whole history
    whole = daily.build_models(daily.read_bronze(spark, wh))
    for name in ("mart_expense_summary", "mart_monthly_cashflow", "mart_inventory_turnover", "mart_profitability_flags", "stg_transactions_deduped"):
        got = spark.read.schema(whole[name].schema).parquet(paths[name])
        assert rows(got, *whole[name].columns) == rows(whole[name], *whole[name].columns), name
    assert all(not m for m in daily._months_to_refresh(spark, wh, daily.RunLog(spark, wh, "marts")).values())
