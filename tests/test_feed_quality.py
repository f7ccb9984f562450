import datetime as dt
import json
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import rows
from tesoro.functions import storage
from tesoro.operators import quality
from tesoro.sources import feed

RFC = "ABC123456XYZ"


def write_feed(folder, rfc=RFC):
    folder.mkdir(parents=True, exist_ok=True)
    txns = []
    for i, (day, total, cat) in enumerate([("2024-01-05", 116.00, "renta"), ("2024-01-05", 116.00, "renta"),
                                           ("2024-02-10", 58.00, "nomina")]):
        txns.append({"uuid": f"u{i}", "folio": f"F-{i:05d}", "fecha_emision": day, "rfc_emisor": "E",
                     "rfc_receptor": rfc, "conceptos": [{"descripcion": f"d{i}", "categoria": cat,
                                                         "cantidad": 1, "valor_unitario": total / 1.16}],
                     "subtotal": round(total / 1.16, 2), "iva": 0, "total": total, "moneda": "MXN",
                     "metodo_pago": "PUE", "forma_pago": "01"})
    txns.append({"uuid": "u9", "fecha_emision": "2024-03-01", "rfc_receptor": rfc, "conceptos": [],
                 "total": 10.0})
    # rejects: a malformed date and a missing total
    txns.append({"uuid": "bad1", "fecha_emision": "2024-13-45", "rfc_receptor": rfc, "total": 1.0})
    txns.append({"uuid": "bad2", "fecha_emision": "2024-03-01", "rfc_receptor": rfc})
    cash = [{"entity_rfc": rfc, "date": "2024-01-01", "type": "inflow", "amount": 153973.71},
            {"entity_rfc": rfc, "date": "2024-01-01", "type": "outflow", "amount": 124371.65},
            {"entity_rfc": "OTHER0000000", "date": "2024-03-01", "type": "inflow", "amount": 1.0}]
    inv = [{"entity_rfc": rfc, "sku": "SKU-0001", "date": "2024-01-01", "qty": 5, "unit_cost": 20.5,
            "turnover_rate": 0.25}]
    (folder / "transactions.json").write_text(json.dumps(txns, indent=2))
    (folder / "cashflow.json").write_text(json.dumps(cash, indent=2))
    (folder / "inventory.json").write_text(json.dumps(inv, indent=2))
    return str(folder)


def test_feed_load_is_idempotent_and_typed(spark, tmp_path):
    path = write_feed(tmp_path / "feed")
    ts = dt.datetime(2026, 1, 1)
    bronze, added = feed.load_feed(spark, path, feed.empty_bronze(spark), ts)
    counts = dict(rows(feed.load_counts(added)))
    assert counts == {"core_entity": 2, "core_account": 1, "core_category": 2, "core_transaction": 4,
                      "core_cashflowevent": 3, "core_inventorysnapshot": 1,
                      "rejected_transactions": 2, "rejected_cashflow": 0, "rejected_inventory": 0}
    t = {r["source_doc_ref"]: r for r in bronze["core_transaction"].collect()}
    assert t["u0"]["amount"] == D("116.00") and t["u0"]["date"] == dt.date(2024, 1, 5)
    assert t["u9"]["category_id"] is None and t["u9"]["description"] is None   # empty conceptos
    # every record keeps its own entity (trap 11)
    ents = dict(rows(bronze["core_entity"], "rfc", "id"))
    cf_entities = {r[0] for r in rows(bronze["core_cashflowevent"], "entity_id")}
    assert cf_entities == set(ents.values())
    # a re-run of the same files adds nothing (trap 12)
    _, added2 = feed.load_feed(spark, path, bronze, dt.datetime(2026, 1, 2))
    assert {r[1] for r in rows(feed.load_counts(added2)) if not r[0].startswith("rejected")} == {0}
    # the reference's append mode duplicates every fact row
    _, added3 = feed.load_feed(spark, path, bronze, dt.datetime(2026, 1, 2), mode="append")
    assert dict(rows(feed.load_counts(added3)))["core_transaction"] == 4


def load(spark, path, bronze=None, **options):
    after, added = feed.load_feed(spark, path, bronze or feed.empty_bronze(spark), dt.datetime(2026, 1, 1), **options)
    return after, dict(rows(feed.load_counts(added)))


def test_new_content_at_a_known_path_is_loaded_whole(spark, tmp_path):
    path = write_feed(tmp_path / "feed")
    bronze, _ = load(spark, path)
    bronze = {k: v.checkpoint() for k, v in bronze.items()}
    for kind, amount in (("cashflow", 7.0), ("inventory", None)):
        file = tmp_path / "feed" / f"{kind}.json"
        records = json.loads(file.read_text())
        for r in records:
            r["date"] = "2025-05-01"
            if amount:
                r["amount"] = amount
        file.write_text(json.dumps(records))
    after, counts = load(spark, path, bronze)
    assert (counts["core_cashflowevent"], counts["core_inventorysnapshot"], counts["core_transaction"]) == (3, 1, 0)
    assert after["core_cashflowevent"].count() == 6
    # a named batch is one batch, whatever its files hold
    _, named = load(spark, path, after, batch_id="2026-01-02")
    assert named["core_cashflowevent"] == 3


def test_a_truncated_file_is_one_reject_and_the_rest_loads(spark, tmp_path):
    path = write_feed(tmp_path / "feed")
    for kind in ("cashflow", "transactions"):
        file = tmp_path / "feed" / f"{kind}.json"
        file.write_text(file.read_text()[:40])
    _, counts = load(spark, path)
    assert counts["rejected_cashflow"] == 1 and counts["rejected_transactions"] == 1
    assert counts["core_cashflowevent"] == 0 and counts["core_inventorysnapshot"] == 1
    (tmp_path / "feed" / "cashflow.json").write_text("[]")
    assert load(spark, path)[1]["rejected_cashflow"] == 0


def test_a_uuid_twice_in_a_feed_is_one_transaction(spark, tmp_path):
    path = write_feed(tmp_path / "feed")
    file = tmp_path / "feed" / "transactions.json"
    records = json.loads(file.read_text())
    file.write_text(json.dumps([*records, {**records[0], "total": 1.0}]))
    bronze, counts = load(spark, path)
    assert counts["core_transaction"] == 4
    assert bronze["core_transaction"].where("source_doc_ref = 'u0'").first()["amount"] == D("116.00")


def test_quality_checks(spark):
    df = spark.createDataFrame(
        [("a", 1, "inflow", "x" * 3, "1.234"), ("a", None, "outflow", "y", "12.50"),
         ("b", 3, "bogus", "zzzzzz", "abc"), (None, 4, None, None, "99999999999999")],
        "id string, fk int, event_type string, name string, raw string")
    parents = spark.createDataFrame([(1,), (4,)], "pk int")
    summary = quality.summarize([
        ("m", "id", "unique", quality.unique(df, "id")),
        ("m", "fk", "not_null", quality.not_null(df, "fk")),
        ("m", "event_type", "accepted_values", quality.accepted_values(df, "event_type", ("inflow", "outflow"))),
        ("m", "fk", "relationships", quality.relationships(df, "fk", parents, "pk")),
        ("m", "name", "max_length_4", quality.too_long(df, "name", 4)),
        ("m", "raw", "decimal_14_2", quality.not_decimal(df, "raw", 14, 2)),
    ])
    got = {r["test"]: r["failures"] for r in summary.collect()}
    assert got == {"unique": 1, "not_null": 1, "accepted_values": 1, "relationships": 1,
                   "max_length_4": 1, "decimal_14_2": 3}
    nulls = {r["column_name"]: r["failures"] for r in quality.null_counts(df, "m", ["id", "fk"]).collect()}
    assert nulls == {"id": 1, "fk": 1}
    gone = spark.createDataFrame([(1,)], "pk int")
    assert quality.cascade_delete(df, "fk", gone, "pk").count() == 3
    cleared = quality.set_null_on_delete(df, "fk", gone, "pk")
    assert cleared.where(F.col("fk").isNull()).count() == 2 and cleared.count() == 4


def test_dimensions_come_from_stored_keys_and_a_uuid_is_one_row_before_the_lookups(spark, tmp_path, monkeypatch):
    def load():
        return feed.load_feed(spark, write_feed(tmp_path / "feed"), feed.empty_bronze(spark), "2026-01-01 00:00:00", batch_id="b")[1]
    added = load()
    for table in ("core_entity", "core_account", "core_category"):
        assert all("/feed-keys-" in f or "/feed-rfcs-" in f for f in added[table].inputFiles())
    plan = added["core_transaction"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("min_by")   # the join is above
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 0.1)  # dealt first, as many rows are
    dealt = load()
    assert "RepartitionByExpression [source_doc_ref" in dealt["core_transaction"]._jdf.queryExecution().optimizedPlan().toString()
    for table in added:
        assert rows(dealt[table]) == rows(added[table])
