"""Log snapshots against folding the whole log."""

import random
from datetime import datetime, timedelta

import pytest

from mailsift.operators import allowlist, lifecycle
from mailsift.schema import REGISTRY
from mailsift.sources.snapshots import ACTIONS, DEPLOYED, TRUST, Snapshots
from mailsift.sources.tables import Store

START = datetime(2024, 1, 1)


def trust_rows(seed, ids):
    rng = random.Random(seed)
    names = [" A@x.test", "a@X.test ", "b.test", "c.test", "  "]
    return [
        (i, rng.choice(names), rng.choice(["n1", "n2", None]), START + timedelta(minutes=i), rng.choice(["add", "add", "remove"]))
        for i in ids
    ]


def land(store, rows):
    store.append("trust_log", store.spark.createDataFrame(rows, Store.TRUST_LOG))


def same(snapshots, fold):
    table = snapshots.store.read(snapshots.log.name)
    got, want = snapshots.state(), fold(table)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_trust_equals_the_whole_log(spark, tmp_path, seed):
    store = Store(spark, str(tmp_path))
    snapshots = Snapshots(store, TRUST)
    same(snapshots, allowlist.current_list)
    ids = list(range(40))
    late = [i for i in ids if i % 7 == seed]  # these land last
    for part in ([i for i in ids[:15]], [i for i in ids[15:30]], ids[30:] + late):
        land(store, trust_rows(seed, [i for i in part if part[-1] in late or i not in late]))
        same(snapshots, allowlist.current_list)
        if 39 not in part:
            snapshots.take()
            same(snapshots, allowlist.current_list)
    counted = {r["pattern"]: r["n"] for r in snapshots.late().collect()}
    assert sum(counted.values()) == len([i for i in late if i < 30])


def test_a_late_removal_undoes_what_came_before_it(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    snapshots = Snapshots(store, TRUST)
    land(store, [(1, "a.test", "old", START, "add"), (5, "a.test", "new", START + timedelta(1), "add"), (2, "b.test", None, START, "add")])
    snapshots.take()
    land(store, [(3, "A.test", None, START, "remove")])
    got = {r["pattern"]: (r["id"], r["note"]) for r in snapshots.state().collect()}
    assert got == {"a.test": (5, "new"), "b.test": (2, None)}
    # The next snapshot holds the settled state; the row is late no more.
    snapshots.take()
    assert snapshots.late().count() == 0
    same(snapshots, allowlist.current_list)


def test_only_the_tail_is_read(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    snapshots = Snapshots(store, TRUST)
    for k in range(3):
        land(store, trust_rows(k, range(10 * k, 10 * k + 10)))
    snapshots.take()
    assert snapshots.tail().count() == 0
    land(store, trust_rows(9, range(30, 33)))
    old = set(store.read("trust_log").inputFiles())
    assert set(snapshots.tail().inputFiles()) < old and snapshots.tail().count() == 3


def test_an_unfinished_snapshot_does_not_count(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    snapshots = Snapshots(store, TRUST)
    land(store, trust_rows(1, range(10)))
    snapshots.take()
    # A second one that failed before its list of files was written.
    spark.range(3).write.parquet(f"{snapshots.path}/states/number=2")
    assert snapshots.newest() == 1
    land(store, trust_rows(2, range(10, 20)))
    assert snapshots.take() == 2
    same(snapshots, allowlist.current_list)


def test_actions_and_deployments(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rng = random.Random(4)
    actions, deployed = Snapshots(store, ACTIONS), Snapshots(store, DEPLOYED)
    for k in range(4):
        rows = [(rng.choice(["a", "b", "c", None]), START + timedelta(days=rng.randrange(9))) for _ in range(5)]
        store.append("action_log", spark.createDataFrame(rows, Store.ACTIONS))
        rows = [
            (rng.choice(["ko", "en"]), f"{rng.randrange(99):04d}", f"p{k}{i}", rng.choice(["deploy", "backup"]), START)
            for i in range(4)
        ]
        store.append("registry", spark.createDataFrame(rows, REGISTRY))
        same(actions, ACTIONS.fold)
        assert {r["lang"]: r["backup_id"] for r in deployed.state().collect()} == {
            r["lang"]: r["backup_id"] for r in lifecycle.deployed(store.read("registry")).collect()
        }
        if k % 2:
            actions.take()
            deployed.take()
