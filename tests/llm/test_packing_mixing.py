import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corvane.llm.mixing import mix, mixture_report, pivot, pivot_group, plan_sources
from corvane.llm.packing import Capacity, best_fit, fill_containers
from corvane.llm.tokens import count_tokens, encoder, DEFAULT_VOCABULARY, token_sizes


def test_best_fit_keeps_every_capacity():
    rng = random.Random(0)
    cap = Capacity(tokens=100, items=5, attention=100 * 100)
    n = [rng.randrange(0, 101) for _ in range(400)]
    at = best_fit(n, cap)
    for c in set(at):
        mine = [n[i] for i in range(400) if at[i] == c]
        assert sum(mine) <= 100 and len(mine) <= 5 and sum(x * x for x in mine) <= 100 * 100
    assert best_fit([], cap) == []


def test_containers(spark):
    rng = random.Random(1)
    data = [(i % 700, rng.choice([rng.randrange(1, 400), rng.randrange(1, 2000)]), "x", "y") for i in range(2100)]
    data += [(9000, 5000, "x", "y"), (9001, 0, "x", "y"), (9002, None, "x", "y"), (9003, 2048, "x", "y"), (9003, 2048, "x", "y")] + [(7, 0, "x", "y")] * 900
    df = spark.createDataFrame(data, "doc_id long, n_tokens long, id string, _row string")
    out = fill_containers(df, group_items=500)
    per = out.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    assert per.where("t > 2048 OR n > 256").count() == 0
    assert out.agg(F.sum("n_tokens")).first()[0] == sum(d[1] or 0 for d in data)
    assert rows(out.where("doc_id = 9000").select("piece_no", "token_start", "n_tokens")) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert out.groupBy("doc_id").count().where("doc_id = 7").first()["count"] == 903
    total = sum(d[1] or 0 for d in data)
    assert total / (2048 * per.where("t > 0").count()) > 0.97
    assert fill_containers(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_containers(df, cap=Capacity(tokens=10, attention=0))
    tight = Capacity(tokens=2048, items=256, attention=400 * 2048)
    out = fill_containers(df, cap=tight, group_items=500)
    assert out.agg(F.max("n_tokens")).first()[0] == tight.longest == 905 and out.agg(F.sum("n_tokens")).first()[0] == total
    per = out.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("a"))
    assert per.where(f"t > 2048 OR n > 256 OR a > {400 * 2048}").count() == 0


def test_each_capacity_binds():
    rng = random.Random(3)
    n = [rng.randrange(1, 400) for _ in range(600)]
    free = Capacity(tokens=10**6, items=10**6, attention=10**12)
    tokens, items, attention = Capacity(2048, 10**6, 10**12), Capacity(10**6, 12, 10**12), Capacity(10**6, 10**6, 300_000)
    packed = [best_fit(n, c) for c in (free, tokens, items, attention)]
    assert max(packed[0]) == 0 and len({tuple(p) for p in packed}) == 4
    # With tokens and items alike, the default attention capacity and a smaller one give other containers than an unlimited one.
    by_attention = [best_fit(n, Capacity(2048, 256, a)) for a in (10**12, 2048 * 2048, 350_000)]
    assert len({tuple(p) for p in by_attention}) == 3
    for c in set(by_attention[2]):
        assert sum(x * x for x, at in zip(n, by_attention[2]) if at == c) <= 350_000


def test_tokens(spark):
    text = "Die Häufigkeit liegt unter 0,5 Prozent. 你好"
    assert count_tokens(text) == len(encoder(DEFAULT_VOCABULARY).encode_ordinary(text)) and count_tokens(None) == count_tokens("") == 0
    # Longer than one stretch: the same as in one go.
    for long in ("word " * 60_000, "naïve\n\nwords, 12 of " * 20_000 + " " * 7_000 + "x", "a" * 150_000, " " * 6_000 + "é " * 90_000):
        assert count_tokens(long) == len(encoder(DEFAULT_VOCABULARY).encode_ordinary(long))
    assert count_tokens(" " * 1_500_000) > 0
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string")
    assert rows(token_sizes(df, "doc_id", "text", keep=["source"]).select("doc_id", "n_tokens")) == [(1, 2), (2, 0), (3, 0)]


def test_pivot_keeps_mass_and_expectation():
    rng = random.Random(0)
    sizes = [rng.randrange(1, 50) for _ in range(60)]
    p = [rng.random() for _ in sizes]
    hits = [0] * 60
    for _ in range(3000):
        f = list(p)
        out, open_ = pivot(f, sizes, [rng.random() for _ in p])
        got = [o + (f[i] if i == open_ else 0) for i, o in enumerate(out)]
        assert abs(sum(g * s for g, s in zip(got, sizes)) - sum(a * s for a, s in zip(p, sizes))) < 1e-6
        hits = [h + g for h, g in zip(hits, got)]
    assert max(abs(h / 3000 - a) for h, a in zip(hits, p)) < 0.06
    assert pivot([0.5, 0.5], [0, 0], [0.1, 0.9]) == ([1, 0], -1) and pivot([], [], []) == ([], -1)


@pytest.mark.parametrize("giant, tail", [(900, [1] * 100), (300, [7] * 100), (5000, [3, 9, 27]), (31, [1000] * 31)])
def test_expectation_holds_beside_a_giant(giant, tail):
    """A document of any part of its source, below and above every earlier limit, keeps its own and the others' expectation."""
    rng, trials = random.Random(5), 6_000
    sizes = sorted([giant, *tail], reverse=True)
    for p, split in ((0.3, 1), (0.1, 2)):
        hits = [0] * len(sizes)
        for _ in range(trials):
            # With and without items that are settled later with the fraction that is left to them.
            n = len(sizes) // split
            out, open_, left, after = pivot_group(p, sizes[:n], sum(sizes[n:]), [rng.random() for _ in sizes])
            got = [o + (left if i == open_ else 0) for i, o in enumerate(out)] + [after] * (len(sizes) - n)
            assert abs(sum(g * s for g, s in zip(got, sizes)) - p * sum(sizes)) < 1e-6 * sum(sizes)
            hits = [h + g for h, g in zip(hits, got)]
        at = sizes.index(giant)
        assert abs(hits[at] / trials - p) < 0.02
        assert abs((sum(hits) - hits[at]) / trials / len(tail) - p) < 0.01


def test_mixture(spark):
    rng = random.Random(2)
    data = [(i, "big", rng.randrange(50, 150), "a", 1) for i in range(4000)] + [(5000 + i, "small", rng.randrange(50, 150), "a", 1) for i in range(40)]
    data += [(6000, "none", 10, "a", 1), (6001, None, 10, "a", 1), (6002, "big", None, "a", 1), (6003, "small", 0, "a", 1)]
    df = spark.createDataFrame(data, "doc_id long, source string, n_tokens long, id string, size int")
    targets = spark.createDataFrame([("big", 3.0, 1), ("small", 1.0, 3), ("absent", 2.0, 2), ("none", 0.0, 2), ("none", None, None)], "source string, target_share double, max_repeats int")
    for leaf in (20_000, 300):
        out = mix(df, targets, leaf_rows=leaf)
        assert out.count() == len(data) and out.where("copies < 0 OR source = 'big' AND copies > 1 OR source = 'small' AND copies > 3").count() == 0
        share = {r["source"]: r["source_share"] for r in out.where("copies > 0").select("source", "source_share").distinct().collect()}
        assert abs(share["big"] - 0.75) < 0.005 and abs(share["small"] - 0.25) < 0.005 and set(share) == {"big", "small"}
        assert rows(out) == rows(mix(df, targets, leaf_rows=leaf))
    report = {r["source"]: r for r in mixture_report(out, targets).collect()}
    assert report["absent"]["tokens"] == 0 and report["small"]["most_copies"] == 3
    assert mix(df.limit(0), targets).count() == 0 and mix(df, targets.limit(0)).where("copies > 0").count() == 0
    plan = {r["source"]: r["expected_copies"] for r in plan_sources(df.where("source IS NOT NULL"), targets, total=1e9).collect()}
    assert plan["big"] == 1.0 and plan["small"] == 3.0
