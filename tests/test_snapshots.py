import random
from datetime import datetime

from conftest import rows

from corvane.operators import snapshots
from corvane.operators.snapshots import snapshot_changes

SCHEMA = "release_no int, variation_id int, s string, r string, loaded_at timestamp_ntz, _key string, release string"
AT = datetime(2024, 1, 1)


def changes(spark, data):
    full = [(*d, "clash", "clash") for d in data]
    return rows(snapshot_changes(spark.createDataFrame(full, SCHEMA), "release_no", "variation_id", ["s", "r"], loaded="loaded_at"))


def test_kinds_of_change(spark):
    data = [
        (1, 1, "A", "x", AT), (2, 1, " a ", "X", AT), (5, 1, "b", "x", AT),  # spelling wavers, then it changes; no release 3 or 4
        (1, 2, "A", None, AT), (2, 2, "A", "  ", AT), (5, 2, "A", "", AT),  # null and blank are the same
        (2, 3, "A", "x", AT), (1, 4, "A", "x", AT), (5, 4, "a  b", "x", AT),
    ]
    assert changes(spark, data) == [(2, 3, "added"), (2, 4, "removed"), (5, 1, "changed"), (5, 3, "removed"), (5, 4, "added")]


def test_latest_counts_and_ties_are_decided(spark):
    later = datetime(2024, 1, 2)
    data = [(1, 1, "a", "x", AT), (1, 1, "b", "x", later), (1, 1, "c", "x", None), (2, 1, "b", "x", AT), (2, 1, "b", "x", AT)]
    assert changes(spark, data) == []
    tie = [(1, 1, "a", "x", AT), (1, 1, "b", "x", AT), (2, 1, "b", "x", AT)]
    assert changes(spark, tie) == [] == changes(spark, tie[::-1])


def test_nulls_and_empty(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(None, 1, "a", "x", AT), (1, None, "a", "x", AT), (1, 1, None, None, None)]) == []
    assert changes(spark, [(1, 1, None, None, None), (2, 1, None, "", None), (2, 2, "y" * 100_000, None, None)]) == [(2, 2, "added")]


def test_against_brute_force_and_without_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    data = [(rng.choice([1, 2, 4, 9]), rng.randrange(40), rng.choice(["a", "A ", "b", None]), rng.choice(["x", " x", "y"]), datetime(2024, 1, rng.randint(1, 28))) for _ in range(600)]
    data += [(4, 7, "hot", "x", AT)] * 300  # one key with a third of all rows
    norm = lambda t: (" ".join((t or "").lower().split()) or None)
    cur = {}
    for rel, key, s, r, at in data:
        new = (at, norm(s) is not None, norm(s) or "", norm(r) is not None, norm(r) or "")
        cur[rel, key] = max(cur.get((rel, key), new), new)
    want, rels = [], [1, 2, 4, 9]
    for a, b in zip(rels, rels[1:]):
        for key in range(40):
            x, y = cur.get((a, key)), cur.get((b, key))
            if x and not y:
                want.append((b, key, "removed"))
            elif y and not x:
                want.append((b, key, "added"))
            elif x and x[1:] != y[1:]:
                want.append((b, key, "changed"))
    assert changes(spark, data) == sorted(want)
    monkeypatch.setattr(snapshots, "MAX_BROADCAST_RELEASES", 1)
    assert changes(spark, data) == sorted(want)
