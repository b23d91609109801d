import numpy as np
import pytest
from conftest import rows

from corvane.llm.neighbours import Hashing, _bound, _outline, _unfold, bucket_keys, neighbour_pairs, probe_sets, search_neighbours, similar_neighbours

SCHEMA = "id long, embedding array<float>, v string, rep string"


def brute(x, ids, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in range(len(ids)):
        c = np.round(u @ u[i], 9)
        order = sorted((j for j in range(len(ids)) if j != i and c[j] >= least), key=lambda j: (-c[j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return sorted((int(a), int(b)) for a, b in out)


def near_data(rng, n=400, dim=16):
    base = rng.standard_normal((n, dim))
    near = base[: n // 4] + 0.05 * rng.standard_normal((n // 4, dim))
    return np.concatenate([base, near, near[:30] * 3.0])


def test_pairs_match_brute_force(spark):
    x = near_data(np.random.default_rng(0))
    df = spark.createDataFrame([(i, [float(f) for f in r], "a", "b") for i, r in enumerate(x)], SCHEMA)
    got = rows(neighbour_pairs(similar_neighbours(df, "id", "embedding", min_cosine=0.95), "id"))
    assert got == brute(np.array(x, np.float32).astype(float), list(range(len(x))), 5, 0.95)
    # Every bucket counts as crowded: the exact blocks give the same.
    crowded = Hashing(crowd=2, block=7, sample=1)
    assert rows(neighbour_pairs(similar_neighbours(df, "id", "embedding", min_cosine=0.95, h=crowded), "id")) == got


def test_bound_is_never_less_than_the_cosine():
    rng = np.random.default_rng(4)
    for dim in (2, 16, 23, 24, 64, 300):
        x = rng.standard_normal((500, dim))
        x[:100] *= np.eye(dim)[0]
        x[100:200] = x[200:300] + 0.2 * x[100:200]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        shape = _unfold(list(_outline(x, Hashing()).T))
        a, b = rng.integers(0, 500, 20_000), rng.integers(0, 500, 20_000)
        a[:100], b[:100] = np.arange(100, 200), np.arange(200, 300)
        bound = _bound(tuple(c[a] for c in shape), tuple(c[b] for c in shape))
        assert (bound >= (x[a] * x[b]).sum(1)).all()
        assert dim < 64 or (bound < 0.95).mean() > 0.5


def test_crowds_found_on_a_sample_change_nothing(spark):
    """Nearby vectors of one cone, in numbers below and above the limit of a crowd, and vectors of another dimension."""
    rng = np.random.default_rng(6)
    x = np.eye(12)[0] + 0.08 * rng.standard_normal((700, 12))
    data = [(i, [float(f) for f in r], "", "") for i, r in enumerate(x)] + [(5000 + i, [float(f) for f in r[:5]], "", "") for i, r in enumerate(x[:20])]
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(np.array(x, np.float32).astype(float), list(range(700)), 5, 0.95)
    few = brute(np.array(x[:20, :5], np.float32).astype(float), list(range(5000, 5020)), 5, 0.95)
    for h in (Hashing(), Hashing(crowd=100, block=50, sample=4)):
        assert rows(neighbour_pairs(similar_neighbours(df, "id", "embedding", h=h), "id")) == sorted(want + few)


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    x[20:50] = x[20]
    df = spark.createDataFrame([(i, [float(f) for f in r], "a", "b") for i, r in enumerate(x)], SCHEMA)
    near = similar_neighbours(df, "id", "embedding", min_cosine=0.9)
    assert rows(neighbour_pairs(near, "id")) == brute(np.array(x, np.float32).astype(float), list(range(60)), 5, 0.9)
    assert near.groupBy("id").count().where("count > 5").count() == 0


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(3)
    n, dim, cosines = 1000, 64, (0.9501, 0.955, 0.96, 0.965)
    c = np.repeat(cosines, n)[:, None]
    x = rng.standard_normal((len(c), dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(f) for f in r], "", "") for i, r in enumerate(np.concatenate([x, y]))], SCHEMA)
    pairs = {(a, b) for a, b in rows(neighbour_pairs(similar_neighbours(df, "id", "embedding", min_cosine=0.95), "id"))}
    for j, cosine in enumerate(cosines):
        found = sum((i, i + len(c)) in pairs for i in range(j * n, (j + 1) * n))
        assert found / n >= 0.99, cosine


def test_edges(spark):
    data = [(1, [1.0, 0.0], "", ""), (1, [1.0, 0.0], "", ""), (2, [2.0, 0.0], "", ""), (3, None, "", ""), (4, [0.0, 0.0], "", ""), (5, [float("nan"), 1.0], "", ""), (6, [], "", ""), (None, [1.0, 0.0], "", ""), (7, [None, 1.0], "", ""), (8, [1e-30, 0.0], "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(neighbour_pairs(similar_neighbours(df, "id", "embedding"), "id")) == [(1, 2), (1, 8), (2, 8)]
    assert similar_neighbours(df.limit(0), "id", "embedding").count() == 0


def test_probes_in_order_of_success():
    sets = probe_sets(4, 12)
    assert sets[0].tolist() == [1, 0, 0, 0, 0, 0, 0, 0] and len({tuple(s) for s in sets.tolist()}) == 12
    assert all(s[r] + s[7 - r] < 2 for s in sets for r in range(8))
    x = np.random.default_rng(0).standard_normal((5, 8))
    keys = bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True), Hashing(tables=3, hashes=4), 6)
    assert keys.shape == (5, 3, 7) and all(len(set(keys[i, t])) == 7 for i in range(5) for t in range(3))


def test_search_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((10, 64))
    x = centres[rng.integers(0, 10, 3000)] + 1.2 * rng.standard_normal((3000, 64))
    df = spark.createDataFrame([(i, [float(f) for f in r]) for i, r in enumerate(x)], "id long, e array<float>")
    asked = df.where("id % 100 = 0").selectExpr("id AS q", "id AS own", "e")
    got = {}
    for r in search_neighbours(df, "id", "e", asked, "q", "e", own="own", block=11).collect():
        got.setdefault(r["q"], set()).add(r["id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 100):
        c = u @ u[q]
        c[q] = -2
        hits += len(got[q] & set(np.argsort(-c)[:5].tolist()))
    assert hits / 150 >= 0.9
    assert search_neighbours(df, "id", "e", asked.limit(0), "q", "e").count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_k(spark, k):
    x = [[1.0, 0.01 * i] for i in range(8)]
    df = spark.createDataFrame([(i, v, "", "") for i, v in enumerate(x)], SCHEMA)
    got = rows(neighbour_pairs(similar_neighbours(df, "id", "embedding", k=k, min_cosine=0.99), "id"))
    assert got == brute(np.array(x, np.float32).astype(float), list(range(8)), k, 0.99)
