import datetime as dt
import threading
from urllib.parse import urlparse

import pytest

from conftest import rows
from tesoro.operators import tax
from tesoro.plans import rule_store, tax_cycle
from tesoro.plans.rule_store import RuleStore, VersionConflict

DAY = dt.datetime(2026, 2, 1)


def stored(spark, path):
    store = RuleStore(spark, str(path))
    assert store.version() == 0 and [df.count() for df in store.load()] == [0, 0]
    ids = [store.add_draft(tax.monthly_draft_spec(f"2026-0{m}-01"), DAY, f"draft-{m}") for m in (2, 3)]
    assert ids == ["draft-2", "draft-3"] and store.version() == 2
    return store


def test_two_publishes_from_one_version_one_wins(spark, tmp_path):
    store = stored(spark, tmp_path / "rules")
    seen, results = store.version(), {}
    gate = threading.Barrier(2)

    def publish(sid):
        mine = RuleStore(spark, store.base)
        gate.wait()
        try:
            results[sid] = mine.publish(sid, sid, DAY, seen=seen)
        except VersionConflict:
            results[sid] = None
    threads = [threading.Thread(target=publish, args=(s,)) for s in ("draft-2", "draft-3")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(results.values(), key=str) == [3, None]
    winner = next(s for s, v in results.items() if v)
    assert dict(rows(store.load()[0], "id", "status")) == {
        s: "active" if s == winner else "draft" for s in ("draft-2", "draft-3")}
    assert sorted(p.name for p in (tmp_path / "rules").iterdir()) == [f"version=0000000{k}" for k in (1, 2, 3)]
    # the loser starts again from what is there now
    loser = next(s for s, v in results.items() if not v)
    assert store.publish(loser, "again", DAY) == 4
    assert dict(rows(store.load()[0], "id", "status")) == {winner: "superseded", loser: "active"}
    assert dict(rows(store.load(3)[0], "id", "status"))[winner] == "active"    # versions stay


@pytest.mark.parametrize("mounted", [True, False])
def test_rename_onto_a_version_fails_and_leaves_it(spark, tmp_path, monkeypatch, mounted):
    """Both of two writers may pass the first check: the rename decides, that of Hadoop's too."""
    if not mounted:
        monkeypatch.setattr(rule_store, "urlparse", lambda path: urlparse(f"store:{path}"))
    store = stored(spark, tmp_path / "rules")
    held = rows(store.load()[0])
    aside = tmp_path / "rules" / "_aside-x"
    (aside / "rules").mkdir(parents=True)
    assert not store._rename(str(aside), store._folder(2))
    assert rows(store.load()[0]) == held


def test_unfinished_version_is_never_read(spark, tmp_path):
    store = stored(spark, tmp_path / "rules")
    held = rows(store.load()[0])

    class Broken(RuntimeError):
        pass

    def breaks(rule_sets, rules):
        raise Broken
    with pytest.raises(Broken):
        store.change(breaks)
    rule_sets, rules = store.load()
    with pytest.raises(Exception):                       # after the first table is written
        store.swap(2, rule_sets, rules.drop("rate"))
    assert store.version() == 2 and rows(store.load()[0]) == held
    # a writer that died left its folder aside
    rule_sets.write.parquet(f"{store.base}/_aside-dead/rule_sets")
    assert store.version() == 2 and rows(store.load()[0]) == held
    with pytest.raises(LookupError):
        store.publish("nope")
    with pytest.raises(VersionConflict):
        store.swap(1, *store.load())


def test_stored_rules_tax_as_the_ones_in_memory(spark, tmp_path):
    rule_sets, rules = tax_cycle.example_rule_history(spark)
    store = RuleStore(spark, str(tmp_path / "rules"))
    assert store.swap(0, rule_sets, rules) == 1
    again = store.load()
    assert rows(again[0]) == rows(rule_sets) and rows(again[1]) == rows(rules)
