import re
from collections import Counter

import pytest
from conftest import rows

from corvane.functions import parse
from corvane.operators.route import exact_hits, route, tiers
from corvane.plans import retrieval as Q

ASKED = [
    "Which gene causes Grellsby–Grellamore syndrome?",
    "Is c.2961G>T in JDUKA9 pathogenic? The Brandoway sign was seen.",
    "Is éQPIB8 a name? QPIB8é, QPIB8ß and _JTAM4 are none",
    "¿Qué hace el gen «QPIB8»?",
    "the variant in qpib8 – known?",
    "mutation of éabc, tübingen gene, abc12 gene",
    "ärs123 or rs456é and RS789",
    "éc.12 only",
    "Grüße",
    "hello",
    "日本GENE1 日本 GENE2",
    "kidney – pain",
]


def genes(text):
    """As Python's own expressions, whose word boundaries know every script, have it."""
    word = "[A-Za-z][A-Za-z0-9]{1,9}"
    cued = re.findall(rf"(?i)\b(?:(?:gene|variant|mutation|allele)s?\s+(?:in\s+|of\s+)?({word})|({word})\s+gene)\b", text)
    every = re.findall(r"\b([A-Z][A-Z0-9]{1,9})\b", text) + [(a or b).upper() for a, b in cued]
    return sorted({g for g in every if g not in parse.NOT_GENES})


def kind(text):
    low, gene = text.lower(), bool(genes(text))
    if not (re.search(r"\b[cpgmn]\.[0-9]", text) or gene or any(t in low for t in (*parse.CLINICAL_TERMS, *parse.RENAL_TERMS))):
        return "non-clinical"
    return "variant" if gene or re.search(r"\b[cpgmn]\.[0-9]", text) else "phenotype"


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("logs"))
    spark.createDataFrame([(x,) for x in [*ASKED, ASKED[0], None]], "query_text string").write.parquet(f"{at}/audit_logs.parquet")
    return at


def test_gene_symbols_of_any_script(spark, logs):
    assert rows(Q.q_gene_symbols(spark, logs)) == sorted((x, ",".join(genes(x))) for x in ASKED)


def test_classes_of_any_script(spark, logs):
    assert dict(rows(Q.q_classify(spark, logs))) == Counter(map(kind, ASKED))
    assert [r[0] for r in rows(Q.every_question(spark, logs).select("text"))] == sorted(ASKED)


NAMES = [("GENE0", "NM_1.1(GENE0):c.52A>G (p.Arg18Gly)"), ("GENE0", "NM_1.1(GENE0):c.523A>G (p.Arg175Gly)"), ("GENE1", "c.52del and c.77dup"), ("GENE1", "c.1A>G, then c.52A>T rs789"), ("GENE2", "rs7891 c.9_11delCTT"), ("GENE2", None)]
ROUTED = ["what of c.52?", "what of c.52A>G – p.Arg18Gly?", "rs789?", "what of p.Arg17?", "what of c.77dup", "is c.9_11delCTT known?", "c.52A>G in GENE0, said the doctor", "GENE1", "GENE9", "c.4T>A in GENE0", "Grüße", "GENE9 or GENE1"]


def brute(text):
    """(tier, records): every name against every token of the question."""
    found = genes(text)
    tokens = [re.search(x, text) for x in (r"c\.[0-9][0-9_]*(?:[ACGT]>[ACGT]|del[ACGT]*|dup[ACGT]*)?", r"p\.[A-Z][a-z]{2}[0-9]+(?:[A-Z][a-z]{2})?", r"rs[0-9]+")]
    tokens = [m.group().lower() for m in tokens if m]
    held = [i for i, (g, n) in enumerate(NAMES) if tokens and n and (not found or g == found[0]) and all(t in n.lower() or re.sub("(del|dup)[acgt]+$", r"\1", t) in n.lower() for t in tokens)]
    known = found and text.split()[0] in {g for g, _ in NAMES}
    if not (found or re.search(r"\b[cpgmn]\.[0-9]", text)):
        return "none", held
    return "exact" if held else "gene" if known and not tokens else "hybrid" if tokens or found else "none", held


def test_route_of_any_question(spark):
    records = spark.createDataFrame([(i, g, n, n, "", [1.0, float(i)]) for i, (g, n) in enumerate(NAMES)], "variation_id int, gene string, name string, document string, review_status string, embedding array<float>")
    asked = spark.createDataFrame([(x, [1.0, 0.5]) for x in ROUTED], "text string, qvec array<float>").withColumn("genes", parse.gene_symbols("text")).withColumn("tok", parse.variant_tokens("text"))
    hits = exact_hits(asked, records)
    assert rows(hits.select("text", "variation_id")) == sorted((x, i) for x in ROUTED for i in brute(x)[1])
    want = {x: brute(x)[0] for x in ROUTED}
    assert set(want.values()) == {"exact", "gene", "hybrid", "none"} and want["GENE9"] == "hybrid"
    assert dict(rows(tiers(asked, hits, records).select("text", "tier"))) == want
    out = route(asked, records, k=9)
    assert {r["text"]: r["tier"] for r in out.select("text", "tier").distinct().collect()}.items() <= want.items()
    got = rows(out.where("tier <> 'hybrid'").select("text", "variation_id"))
    assert got == sorted((x, i) for x in ROUTED for i in (brute(x)[1] if want[x] == "exact" else [j for j, n in enumerate(NAMES) if n[0] == x] if want[x] == "gene" else []))
