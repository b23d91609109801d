import random
from datetime import datetime, timedelta

from conftest import rows

from corvane.operators.skew import first_per_key, rank_per_key

SCHEMA = "gene string, variation_id int, created_at timestamp_ntz, k string, o string, i int"
AT = datetime(2024, 1, 1)


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", "y", 1) for d in data], SCHEMA)


def brute(data, n=3):
    best = {}
    for g, v, at in data:
        if g and g.strip() and v is not None and at is not None:
            best.setdefault(g, {}).setdefault(v, at)
            best[g][v] = min(best[g][v], at)
    return sorted((g, v) for g, vs in best.items() for v in sorted(vs, key=lambda v: (vs[v], v))[:n])


def test_first_per_key_with_a_heavy_key(spark):
    rng = random.Random(1)
    data = [("hot", rng.randrange(50), AT + timedelta(days=rng.randrange(9))) for _ in range(900)]
    data += [(rng.choice(["a", "b", "c", "ä", ""]), rng.randrange(20), AT + timedelta(days=rng.randrange(3))) for _ in range(400)]
    data += data[:50]
    for parts in (1, 3, 16):
        assert rows(first_per_key(frame(spark, data), "gene", "variation_id", "created_at", partitions=parts)) == brute(data)


def test_first_per_key_edges(spark):
    assert rows(first_per_key(frame(spark, []), "gene", "variation_id", "created_at")) == []
    data = [(None, 1, AT), ("  ", 1, AT), ("g", None, AT), ("g", 5, None), ("g", 2, AT), ("g", 1, AT), ("x" * 10_000, 1, AT)]
    assert rows(first_per_key(frame(spark, data), "gene", "variation_id", "created_at")) == brute(data)


def test_one_key_spreads_over_partitions(spark):
    from corvane.operators.skew import range_split

    df = frame(spark, [("hot", i, AT + timedelta(minutes=i)) for i in range(4000)])
    sizes = [len(p) for p in range_split(df, "gene", ["created_at", "variation_id"], 8).rdd.glom().collect()]
    assert max(sizes) < 1200


def test_rank_per_key(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot"] * 8 + ["a", None]), i, AT + timedelta(days=rng.randrange(5))) for i in range(500)]
    got = rows(rank_per_key(frame(spark, data), "gene", ["created_at", "variation_id"], "place", partitions=7).select("variation_id", "place"))
    want, seen = [], {}
    for g, v, at in sorted(data, key=lambda d: (d[0] or "", d[2], d[1])):
        seen[g] = seen.get(g, 0) + 1
        want.append((v, seen[g]))
    assert got == sorted(want)
    assert rows(rank_per_key(frame(spark, []), "gene", ["created_at"], "place")) == []
