import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import cite, guard, parse, similarity, text


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_trigrams(spark):
    assert one(spark, similarity.trigram_similarity, "word", "two words") == pytest.approx(0.363636, abs=1e-6)
    assert one(spark, similarity.trigram_similarity, "", "") == 0.0
    assert one(spark, similarity.trigram_similarity, None, "a") in (None, 0.0)
    assert one(spark, similarity.trigram_similarity, "Ünïcode  x", "ünïcode x") == 1.0


def test_trigram_sets_agree(spark):
    from corvane.operators.retrieve import trigram_set

    for t in ("two words", "NM_1.2(ABC):c.3A>G", "Ünïcode – naïve² x", "", "e\u0301a_b"):
        assert set(one(spark, similarity.trigrams, t)) == trigram_set(t)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(similarity.cosine_similarity("a", "b")).collect()]
    assert got[0] == pytest.approx(0.96) and got[1] is None and got[2] is None
    assert df.select(similarity.l2_normalise("a")).first()[0] == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize("token, forms", [
    ("c.1521_1523delCTT", ["c.1521_1523delCTT", "c.1521_1523del"]), ("c.5266dupC", ["c.5266dupC", "c.5266dup"]), ("c.526G>A", ["c.526G>A"]),
    ("c.1521_1523del", ["c.1521_1523del"]), ("c.581_582delCCinsAA", ["c.581_582delCCinsAA"]),
])
def test_forms(spark, token, forms):
    assert one(spark, parse.hgvs_forms, token) == forms


@pytest.mark.parametrize("question, genes", [
    ("muc1 gene", ["MUC1"]), ("gene kmt2d", ["KMT2D"]), ("variant in brca1", ["BRCA1"]), ("mutations of col4a3", ["COL4A3"]), ("what gene causes this", ["CAUSES"]),
    ("what causes Kabuki syndrome", []), ("the BRCA1 gene", ["BRCA1"]), ("BRCA1 and the TP53 gene", ["BRCA1", "TP53"]),
])
def test_genes(spark, question, genes):
    assert [g for g in one(spark, parse.gene_symbols, question) if g != "CAUSES"] == [g for g in genes if g != "CAUSES"]


def test_titles_links_and_sections(spark):
    for t, want in (("x ─ Retired Chapter", True), ("Lynch Syndrome", False), ("", False), (None, False)):
        assert one(spark, parse.is_retired_title, t) is want
    assert one(spark, parse.article_url, "NBK1211").endswith("/books/NBK1211/")
    for bad in ("NBKwagner", "", None):
        assert one(spark, parse.article_url, bad).endswith("/NBK1116/")
    assert one(spark, parse.section_type, "hnpcc.Differential_Diagnosis") == "diagnosis"
    assert one(spark, parse.section_type, "x.GenotypePhenotype_Correlations") == "clinical_features"
    assert one(spark, parse.section_type, "x.Else") == "other"
    assert one(spark, parse.gnomad_id, "NC_000017.11:g.43057051T>C") == "17-43057051-T-C"


def test_chunker_branches(spark):
    s = "A" * 150 + "."
    assert one(spark, text.sentence_chunks, "short") == ["short"]
    assert one(spark, text.sentence_chunks, "a | b " * 500) == ["a | b " * 500]
    got = one(spark, text.sentence_chunks, " ".join([s] * 20))
    assert len(got) == 2 and got[0] == " ".join([s] * 13) and got[1] == " ".join([s] * 8)  # one sentence of overlap
    big = "B" * 2500 + "."
    assert one(spark, text.sentence_chunks, f"{big} {s}") == [big, s]
    assert one(spark, text.sentence_chunks, f"{s} {big}") == [s, f"{s} {big}"]


def test_snippet_think_and_counts(spark):
    assert one(spark, text.snippet, None) == "" and one(spark, text.snippet, " a \n b ") == "a b"
    long = one(spark, text.snippet, "word " * 100)
    assert long.endswith("word…") and len(long) <= 321
    assert one(spark, text.strip_think, "a<think>x\ny</think>  b") == "ab"
    df = spark.createDataFrame([(1,), (3,)], "n int")
    assert [r[0] for r in df.select(text.plural("n", "entry")).collect()] == ["1 entry", "3 entries"]
    assert one(spark, text.references_suffix, "x\n\n---\n**References:**\n- [1]") == "\n\n---\n**References:**\n- [1]"
    assert one(spark, text.cut_at_references, "answer\n\n**References:**\n- a") == "answer"


def test_screens(spark):
    assert one(spark, guard.query_reason, "Can I RULE OUT this?") == "diagnosis"
    assert one(spark, guard.query_reason, " ") == "blank" and one(spark, guard.query_reason, "what does X do") is None
    df = spark.createDataFrame([("You have gout [1]", True), ("all fine", True), ("ok [1]", True), ("you have", False)], "t string, e boolean")
    assert [r[0] for r in df.select(guard.response_reason("t", "e")).collect()] == ["diagnosis", "uncited", None, None]


# The cases that must be refused, allowed, flagged and passed.
REFUSED = {
    "Diagnose this 5-year-old presenting with cystic kidneys, polydactyly, and retinal degeneration.": "diagnosis",
    "Is my patient's BRCA1 variant definitely disease-causing - should I tell them they will get cancer?": "diagnosis",
    "Classify this novel TTN missense variant for me using ACMG criteria.": "pathogenicity",
    "Is this VUS actually pathogenic in your opinion?": "pathogenicity",
    "Apply the ACMG PS3/PM2/PP3 criteria and give me a final pathogenicity score for this variant.": "pathogenicity",
}
ALLOWED = (
    "How is the sweat chloride test used to diagnose cystic fibrosis?",
    "What is the recommended colonoscopy surveillance interval in Lynch syndrome?",
    "How is hypertension managed in ADPKD according to GeneReviews?",
    "Which genes cause Alport syndrome and what kidney phenotype do they produce?",
    "What is the inheritance pattern of Huntington disease?",
    "What is the clinical significance of the CFTR c.1521_1523delCTT (p.Phe508del) variant?",
)
FLAGGED = (
    "The combination of cystic kidneys, polydactyly, and retinal degeneration in a 5-year-old is associated with autosomal recessive conditions including Senior-Loken syndrome.",
    "This patient is consistent with Joubert syndrome.",
)
PASSED = (
    "Alport syndrome should be considered in a young man with renal failure. This condition is associated with COL4A3, COL4A4, COL4A5.",
    "Lynch syndrome is caused by variants in EPCAM, MLH1, MSH2.",
    "The CFTR variant is associated with cystic fibrosis.",
    "BRCA1 mutations are associated with hereditary breast and ovarian cancer, inherited autosomal dominantly.",
    "You have access to the record.",
)
NOTHING_FOUND = (
    "GeneReviews does not document phlebotomy treatment for hereditary hemochromatosis in the retrieved evidence.",
    "No gene-disease association from a 2026 issue of Nature Genetics is described in the retrieved evidence.",
    "No 2026 issue of Nature Genetics or any gene-disease association from that year is mentioned in the provided references.",
    "No conditions are reported to be caused by pathogenic variants in the OR4F5 olfactory receptor gene based on the retrieved evidence.",
    "Die Variante ist nicht in den abgerufenen Belegen erwähnt.",
    "Es wurden keine relevanten Varianten gefunden.",
)
SOMETHING_FOUND = (
    "The CFTR variant is pathogenic and associated with cystic fibrosis.",
    "No population frequency data is available, but the variant is pathogenic and well documented.",
)


def test_screening_cases(spark):
    asked = spark.createDataFrame([(q,) for q in [*REFUSED, *ALLOWED]], "t string")
    assert [r[0] for r in asked.select(guard.query_reason("t")).collect()] == [*REFUSED.values(), *[None] * len(ALLOWED)]
    said = spark.createDataFrame([(t + " [1]", True) for t in (*FLAGGED, *PASSED)], "t string, e boolean")
    assert [r[0] for r in said.select(guard.response_reason("t", "e")).collect()] == ["diagnosis"] * len(FLAGGED) + [None] * len(PASSED)
    found = spark.createDataFrame([(t,) for t in (*NOTHING_FOUND, *SOMETHING_FOUND)], "t string")
    assert [r[0] for r in found.select(cite.says_no_evidence("t")).collect()] == [True] * len(NOTHING_FOUND) + [False] * len(SOMETHING_FOUND)


@pytest.mark.parametrize("question, kind", [
    ("What about g.43057051T>C in this syndrome", "variant"), ("Is p.Ala176Thr known in this disease?", "phenotype"), ("significance of rs121918007 in this disease", "phenotype"),
    ("is c.526G>A in ALPL pathogenic", "variant"), ("hello", "non-clinical"), ("Welche Krankheit führt zu Nierenversagen, syndrome?", "phenotype"),
])
def test_query_type(spark, question, kind):
    assert one(spark, parse.query_type, question) == kind


@pytest.mark.parametrize("token, form", [("C.526g>a", "c.526G>A"), ("c. 1521_1523DELctt", "c.1521_1523delCTT"), ("c.5_6delinsaa", "c.5_6delinsAA"), ("c.7&gt;T", "c.7>T"), ("c.5266dupc", "c.5266dupC"), ("c.12-3t&gt;a", "c.12-3T>A")])
def test_nucleotide_form(spark, token, form):
    assert one(spark, parse.nucleotide_form, token) == form


def test_citations(spark):
    for text_, want in (
        ("A. Source: ClinVar - x [1]; UniProt [P0]", "A. Source: ClinVar - x [1]"),
        ("A. Source: NCBI Gene [7]", "A."),
        ("No. The family. Source: NCBI Gene - OR4F5 [GeneID 340070]; UniProt - OR4F5 [P0DJD8].", "No. The family."),
        ("Source: GeneReviews - Alport [NBK1207]; UniProt - COL4A5 [P29400]; ClinVar - COL4A5 [12345]", "Source: GeneReviews - Alport [NBK1207]; ClinVar - COL4A5 [12345]"),
        ("CFTR. Source: GeneReviews - Cystic Fibrosis [NBK1250]; PMID:34934215 - Cystic fibrosis: current concepts.", "CFTR. Source: GeneReviews - Cystic Fibrosis [NBK1250]; PMID:34934215 - Cystic fibrosis: current concepts."),
        ("source: refseq; ; x\nnext line  here ", "source: x\nnext line here"),
        ("Alport syndrome.", "Alport syndrome."), ("", ""), (None, None), ("ends in Source:", "ends in Source:"),
    ):
        assert one(spark, cite.sanitise_source_line, text_) == want, text_
    data = [
        ("See [1] and [10].\n\nReferences:\n- [1] own", [(1, "t1", "http://a?b=$1"), (10, "t10", "")]),
        ("Not mentioned in the retrieved evidence [1].", [(1, "t", "u")]),
        ("Linked [2](old) [[1]](x) [3]", [(1, "t1", "u1"), (2, "t2", "u2")]),
        ("No marker [7].", [(1, "t", "u")]), ("Bare. Source: UniProt", []), (None, [(1, "t", "u")]), ("None [1]", None),
    ]
    df = spark.createDataFrame(data, "t string, c array<struct<number:int,title:string,url:string>>")
    assert [r[0] for r in df.select(cite.postprocess_citations("t", "c")).collect()] == [
        "See [[1]](http://a?b=$1) and [10].\n\n---\n**References:**\n- [1] [t1](http://a?b=$1)\n- [10] t10",
        "Not mentioned in the retrieved evidence [1].",
        "Linked [[2]](u2) [[1]](x) [3]\n\n---\n**References:**\n- [1] [t1](u1)\n- [2] [t2](u2)",
        "No marker [7].", "Bare.", None, "None [1]",
    ]


def test_evidence_of_five_sources(spark):
    variants = spark.createDataFrame([(1, 0, 7, "G", "c.1A>G", "", None, ["X", "Y"], "doc")], "query_id int, rank int, variation_id int, gene string, name string, clinical_significance string, review_status string, phenotypes array<string>, document string")
    chunks = spark.createDataFrame([(1, 0, "NBK1", "Cond", ["G", "H"], "A > B", "first"), (1, 1, "NBK2", None, [], None, "other"), (1, 2, "NBK1", "Cond", ["G", "H"], "A > C", "second")], "query_id int, rank int, nbk_id string, condition_name string, gene_symbols array<string>, section_path string, chunk_text string")
    entries = spark.createDataFrame([(1, 0, 3, "G", "T", "AR", "k", "{}", 99), (1, 1, 4, "H", None, None, None, None, None)], "query_id int, rank int, id int, gene_symbol string, title string, inheritance string, kidney_manifestations string, extrarenal_manifestations string, omim_phenotype_id int")
    seen = spark.createDataFrame([(1, 0, "1-2-A-G", "0.1", "u", {"nfe": "0.2"}), (1, 1, "1-3-A-G", None, None, None)], "query_id int, rank int, variant_id string, allele_frequency string, url string, populations map<string,string>")
    papers = spark.createDataFrame([(1, 0, 5, "P", "z" * 301, None), (1, 1, 6, "Q", "", "here")], "query_id int, rank int, pmid int, title string, abstract string, url string")
    sources = [cite.variant_source(variants), cite.article_source(chunks), cite.entry_source(entries), cite.frequency_source(seen), cite.abstract_source(papers)]
    cites = cite.build_citations(sources)
    assert [(r["number"], r["title"], r["url"]) for r in cites.orderBy("number").collect()] == [
        (1, "ClinVar:7 - G c.1A>G, Unknown significance", "https://www.ncbi.nlm.nih.gov/clinvar/variation/7/"),
        (2, "GeneReviews: Cond (G, H) [NBK1]", "https://www.ncbi.nlm.nih.gov/books/NBK1/"), (3, "GeneReviews:  [NBK2]", "https://www.ncbi.nlm.nih.gov/books/NBK2/"),
        (4, "NephroGenetics: G - T", "https://omim.org/entry/99"), (5, "NephroGenetics: H - ", ""), (6, "gnomAD: 1-2-A-G, AF=0.1", "u"), (7, "gnomAD: 1-3-A-G, AF=N/A", ""),
        (8, "PMID:5 - P", "https://pubmed.ncbi.nlm.nih.gov/5/"), (9, "PMID:6 - Q", "here"),
    ]
    text_ = cite.evidence_text(cite.evidence_blocks(sources, cites), place="place").first()["evidence"]
    assert text_.split("\n\n") == [
        "[1] ClinVar:7 - G c.1A>G (, )\nConditions: X; Y\ndoc", "[2] GeneReviews: Cond (NBK1) > A > B\nfirst", "[3] GeneReviews:  (NBK2)\nother", "[2] (continued) > A > C\nsecond",
        "[4] NephroGenetics: G - T\nInheritance: AR\nKidney manifestations: k\nExtrarenal: {}\nOMIM: 99", "[5] NephroGenetics: H - \nInheritance: \nKidney manifestations: ",
        "[6] gnomAD: 1-2-A-G\nAllele frequency: 0.1\nPopulations: nfe: 0.2", "[7] gnomAD: 1-3-A-G\nAllele frequency: N/A", "[8] PMID:5 - P\n" + "z" * 300 + "...", "[9] PMID:6 - Q",
    ]
    assert cite.build_citations([x.limit(0) for x in sources]).count() == 0


def test_raw_tokens_and_settings(spark):
    df = spark.createDataFrame([("g.43T>C and p.(Arg1Ter)", " YES "), ("c. 5delA", "0"), ("none", None)], "t string, s string")
    assert [r[0] for r in df.select(parse.variant_tokens("t")["raw_tokens"]).collect()] == [["g.43T>C", "p.(Arg1Ter)"], ["c. 5delA"], []]
    assert [r[0] for r in df.select(parse.is_on("s")).collect()] == [True, False, False]
