from pyspark.sql import functions as F
from conftest import rows

from corvane.functions import cite, render, text
from corvane.functions.register import register


def test_trace_and_browser(spark):
    df = spark.createDataFrame([(1, 2, "Variation 5", True, ["A", "B"], "variant"), (2, 0, None, True, [], "phenotype"), (3, 0, None, False, [], None)], "q int, n int, top string, searched boolean, genes array<string>, kind string")
    line = render.trace_line("ClinVar", "n", "top", "variant", "searched", "phenotype-only query")
    assert [r[0] for r in df.select(line).collect()] == ["✓ ClinVar — 2 variants (top: Variation 5)", "· ClinVar — no matching variants", "· ClinVar — skipped (phenotype-only query)"]
    assert [r[0] for r in df.select(render.trace_header("kind", "genes")).collect()] == ["🔍 variant lookup (A, B)", "🔍 phenotype search", "🔍 search"]
    assert df.select(render.trace([line])).first()[0].count("<details>") == 1
    records = spark.createDataFrame([(1, "b", 1, "T <x>", "text"), (1, "a", 2, "U", None), (1, "a", 1, "V", "w")], "q int, source string, rank int, title string, body string")
    out = render.evidence_browser(records, "q", "source", "rank", "title", "body").first()["browser"]
    assert out.count("<details>") == out.count("</details>") == 5 and "T &lt;x&gt;" in out and out.index("V") < out.index("U")


def test_look_ups(spark):
    index = spark.createDataFrame([("G1", "Fabry disease", "NBK1"), ("G2", "Fabry disease", "NBK1"), ("G3", "Other", "x")], "gene string, disease string, nbk_id string")
    asked = spark.createDataFrame([(1, " fabry "), (2, ""), (3, "what is fabry")], "query_id int, text string")
    assert rows(render.genes_of_disease(asked, index)) == [(1, "Fabry disease", ["G1", "G2"])]
    # A larger index is met on trigrams, with the same result.
    more = asked.unionByName(spark.createDataFrame([(4, "ry d"), (5, "o"), (6, "th"), (7, "disease of fabry"), (8, "Fabry Disease")], asked.schema))
    assert rows(render.genes_of_disease(more, index, most=0)) == rows(render.genes_of_disease(more, index))
    assert dict(rows(render.gene_links(index)))["G3"].endswith("NBK1116/)")
    assert asked.select(render.augmented_prompt("Use this.", F.lit(None).cast("string"))).first()[0] == "Use this.\n\nEVIDENCE:\n(none)"


def test_functions_in_sql(spark):
    assert "nxml_sections" in register(spark)
    row = spark.sql("SELECT round(trigram_similarity('word', 'two words'), 6) AS t, cosine_similarity(array(3f, 4f), array(4f, 3f)) AS c, significance_tier('Likely benign') AS s, hgvs_forms('c.5266dupC') AS f").first()
    assert (row["t"], round(row["c"], 6), row["s"], row["f"]) == (0.363636, 0.96, "benign", ["c.5266dupC", "c.5266dup"])
    xml = "<article><article-title>T</article-title><body><sec id=\"x.Diagnosis\"><title>D</title><p>" + "long " * 20 + "</p></sec></body></article>"
    assert spark.sql(f"SELECT section_title FROM nxml_sections('{xml}', 'x.nxml')").first()[0] == "D"
    long = "A sentence of some words. " * 100 + "x" * 2500 + ". End. " + "Another one here! " * 150
    df = spark.createDataFrame([(long,), ("short",), ("a | b " * 900,)], "t string")
    want = [r[0] for r in df.select(text.sentence_chunks("t")).collect()]
    assert [text.chunk_sentences(r["t"]) for r in df.collect()] == want and text.chunk_sentences(None) == []
    df.createOrReplaceTempView("chunked_t")
    assert [r[0] for r in spark.sql("SELECT count(*) FROM chunked_t, LATERAL text_chunks(t) GROUP BY t ORDER BY 1").collect()] == sorted(map(len, want))
    said = spark.createDataFrame(
        [("See [1] and [2](old). Source: UniProt [P0]; ClinVar - x\n\n## References\nown", [(1, "t1", "u$1"), (2, "t2", "")]), ("Not mentioned in the evidence [1].", [(1, "t", "u")]), ("Bare. Source: RefSeq", None), (None, [(1, "t", "u")])],
        "t string, c array<struct<number:int,title:string,url:string>>",
    )
    in_sql = said.selectExpr("sanitise_source_line(t) AS a", "postprocess_citations(t, c) AS b").collect()
    assert in_sql == said.select(cite.sanitise_source_line("t").alias("a"), cite.postprocess_citations("t", "c").alias("b")).collect()
