import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from corvane.functions import parse
from corvane.operators import retrieve as R
from corvane.operators.route import exact_hits, route, tiers


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    data = [(i, f"NM_1.{i}(GENE{i % 3}):c.{i}A>G", f"GENE{i % 3}", "practice guideline" if i % 5 == 0 else None, f"Gene GENE{i % 3} doc {i}", [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    data += [(60, "none", "GENE0", None, "no vector", None), (61, "zero", "GENE0", None, "zero", [0.0] * 8)]
    return spark.createDataFrame(data, "variation_id int, name string, gene string, review_status string, document string, embedding array<float>")


def test_vector_top_k_is_exact_in_blocks(spark, corpus):
    queries = corpus.where("embedding IS NOT NULL").select(F.col("variation_id").alias("query_id"), F.col("embedding").alias("qvec"))
    data = {r[0]: np.array(r[1]) for r in queries.collect()}
    want = []
    for q, v in data.items():
        if np.linalg.norm(v):
            sims = sorted(((-(v @ x) / np.linalg.norm(v) / np.linalg.norm(x), k) for k, x in data.items() if np.linalg.norm(x)))[:4]
            want += [(q, k) for _, k in sims]
    for block in (7, 1000):
        got = R.vector_top_k(corpus, "variation_id", "embedding", queries, "query_id", "qvec", 4, block=block)
        assert rows(got.select("query_id", "variation_id")) == sorted(want)
    assert R.vector_top_k(corpus, "variation_id", "embedding", queries.limit(0), "query_id", "qvec", 4).count() == 0


def test_hybrid_rules(spark, corpus):
    q = corpus.where("variation_id = 7").select(F.lit(1).alias("query_id"), F.col("name").alias("text"), F.col("embedding").alias("qvec"))
    out = R.hybrid(corpus, "variation_id", "embedding", ["name", "document"], q, k=5, floor=0.45).collect()
    assert out and all(0 <= r["score"] <= 1 and r["lexical"] >= 0.45 for r in out)
    single = R.hybrid(corpus, "variation_id", "embedding", ["name"], q, k=5, floor=0.999).collect()
    assert [(r["variation_id"], r["score"]) for r in single] == [(7, 0.0)]


def test_exact_match_wildcard_and_escape(spark):
    df = spark.createDataFrame([(1, "c.1521-1523del"), (2, "c.1521_1523DEL")], "variation_id int, name string")
    assert [r[0] for r in R.exact_match(df, "name", [["C.1521_1523del"]], 9, "variation_id").collect()] == [1, 2]
    assert [r[0] for r in R.exact_match(df, "name", [["C.1521_1523del"]], 9, "variation_id", escape=True).collect()] == [2]
    assert R.exact_match(df, "name", [], 9, "variation_id").count() == 0


def test_tiers(spark, corpus):
    asked = ["Is c.6A>G in GENE0 known", "GENE1", "c.999999A>G in GENE2", "hello there", "anything on c.4A>G"]
    q = spark.createDataFrame([(a, [1.0] * 8) for a in asked], "text string, qvec array<float>")
    q = q.withColumn("genes", parse.gene_symbols("text")).withColumn("tok", parse.variant_tokens("text"))
    got = dict(rows(tiers(q, exact_hits(q, corpus)).select("text", "tier")))
    assert got == dict(zip(asked, ["exact", "gene", "hybrid", "none", "exact"]))
    out = route(q, corpus, k=2)
    by = {}
    for r in out.collect():
        by.setdefault(r["text"], []).append((r["tier"], r["variation_id"]))
    assert by[asked[0]] == [("exact", 6)] and [t for t, _ in by[asked[1]]] == ["gene", "gene"] and by[asked[4]] == [("exact", 4)]


def test_overlap_filter(spark):
    df = spark.createDataFrame([(1, ["A"], "x", False), (2, None, "x", False), (3, ["A"], "y", True), (4, ["B"], "x", False)], "id int, gene_symbols array<string>, section_type string, retired boolean")
    assert [r[0] for r in R.filtered(df, ["A"]).collect()] == [1]
    assert [r[0] for r in R.filtered(df, ["A"], include_retired=True).collect()] == [1, 3]


def test_sources_of_a_question(spark, corpus):
    from corvane.operators.route import article_top_k, route_sources

    vec = lambda i: [float(x) for x in np.random.default_rng(i).standard_normal(8)]
    chunks = spark.createDataFrame(
        [(i, [f"GENE{i % 3}", "GENE1"] if i % 4 else ["GENE2"], "x" if i % 2 else "y", i % 7 == 0, vec(100 + i)) for i in range(60)] + [(60, ["GENE1"], "x", False, None), (61, None, "x", False, vec(5)), (62, ["GENE1"], "x", False, [0.0] * 8), (1, ["GENE1"], "x", False, vec(101))],
        "id int, gene_symbols array<string>, section_type string, retired boolean, embedding array<float>",
    )
    entries = spark.createDataFrame([(i, vec(200 + i)) for i in range(20)] + [(3, vec(203)), (30, None)], "id int, embedding array<float>")
    abstracts = spark.createDataFrame([("GENE1", i, 9 - i) for i in range(4)], "gene string, pmid int, rank int")
    asked = ["variants of GENE1 and GENE2", "renal disease of childhood", "GENE9 in the kidney", "hello there", "rs789 in this syndrome"]
    q = spark.createDataFrame([(a, vec(i)) for i, a in enumerate(asked)], "text string, qvec array<float>").withColumn("genes", parse.gene_symbols("text")).withColumn("tok", parse.variant_tokens("text"))

    def nearest(rows_, v, k, floor):
        unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
        scored = sorted({(-float(unit(v) @ unit(x)), i) for i, x in rows_ if x is not None and np.linalg.norm(x)})
        return [i for s, i in scored if -s > floor][:k]

    data = chunks.collect()
    named = lambda genes: [(r["id"], r["embedding"]) for r in data if not r["retired"] and (not genes or set(genes) & set(r["gene_symbols"] or []))]
    out: dict = {}
    for r in route_sources(q, corpus, chunks, entries, abstracts, k=3, article_floor=0.1, entry_floor=0.0).orderBy("text", "source", "place").collect():
        out.setdefault((r["text"], r["source"]), []).append(int(r["key"]))
    for i, (a, genes) in enumerate(zip(asked, (["GENE1", "GENE2"], [], ["GENE9"], None, []))):
        want = nearest(named(genes), vec(i), 3, 0.1) if genes is not None else []
        assert out.get((a, "GeneReviews"), []) == want, a
        assert out.get((a, "NephroGenetics"), []) == (nearest([tuple(r) for r in entries.collect()], vec(i), 3, 0.0) if i in (1, 2) else [])
        assert (out.get((a, "ClinVar")) is not None) == (i == 0)
    assert out[asked[0], "PubMed"] == [3, 2] and not any(a == "hello there" for a, _ in out)
    steps = []

    def report(source, n, of):
        steps.append((source, n, of))
        raise ValueError("reports may fail")

    again = route_sources(q, corpus, chunks, entries, abstracts, k=3, article_floor=0.1, entry_floor=0.0, on_step=report)
    assert again.count() == sum(map(len, out.values())) == sum(n for _, n, _ in steps) and [x for x, _, _ in steps] == ["ClinVar", "GeneReviews", "NephroGenetics", "PubMed"]
    assert steps[3] == ("PubMed", 2, 1)
    only = article_top_k(chunks, q, 3, 0.1, types=["y"]).join(chunks, "id")
    assert only.where("section_type <> 'y' OR retired").count() == 0 and only.count() > 0
