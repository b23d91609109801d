import gzip
import io
import json
import tarfile
from datetime import datetime

import pandas as pd
import pytest
from conftest import rows

from corvane.sources import articles, embed, external, store, tables

NXML = b"""<article><front><article-id pub-id-type="nbk">NBK1</article-id><article-title>Title <b>one</b> - RETIRED CHAPTER</article-title></front><body>
<sec id="a.Diagnosis"><title>Diagnosis</title><p>A first paragraph that is <xref>long</xref> enough to be kept, with a tail.</p>
<sec id="a.Deep"><title>Deep</title><p>Nested text that is also more than fifty characters long, surely.</p>
<table-wrap><table><tr><td>a</td><td></td></tr><tr><td>b</td><td>c</td></tr></table></table-wrap></sec></sec>
<sec id="a.Short"><title>Short</title><p>tiny</p></sec></body></article>"""


def test_variant_summary(spark, tmp_path):
    head = "Assembly\tClinicalSignificance\tVariationID\tGeneSymbol\tName\tReviewStatus\tPhenotypeList\tExtra"
    lines = [
        "GRCh38\tPathogenic\t1\tABC\tn1\tok\tX;not provided;Y\t.", "GRCh37\tPathogenic\t2\tABC\tn2\tok\tX\t.", "GRCh38\tConflicting classifications of pathogenicity\t3\tABC\tn3\tok\tX\t.",
        "GRCh38\tLikely pathogenic\tx4\tABC\tn4\tok\tX\t.", "GRCh38\tPathogenic\t5\t-\tn5\tok\tX\t.", "GRCh38\tBenign\t6\tDEF\tn6\tok\t\t.", "GRCh38\tPathogenic\t7\tdef\t\"n\t7\"\tok\tX\t.",
    ]
    path = tmp_path / "s.txt.gz"
    path.write_bytes(gzip.compress("\n".join([head, *lines]).encode()))
    got = tables.read_variant_summary(spark, str(path))
    assert rows(got.select("variation_id", "gene", "name")) == [(1, "ABC", "n1"), (7, "def", "n\t7")]
    assert got.where("variation_id = 1").first()["phenotypes"] == ["X", "Y"]
    assert [r[0] for r in rows(tables.read_variant_summary(spark, str(path), all_significance=True, genes=["DEF"]).select("variation_id"))] == [6, 7]
    assert tables.read_variant_summary(spark, str(path), all_significance=True, limit=2).count() == 2
    assert "Associated conditions: Not specified." in tables.read_variant_summary(spark, str(path), all_significance=True).where("variation_id = 6").first()["document"]


def test_metadata(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# comment\n\nabc|NBK1|G1|Cond one\nabc|NBK9|G2|other\nabc|NBK9|G1|other\nxyz|NBK2|Not applicable|Two|more\nbad|line\n")
    got = {r["shortname"]: r for r in tables.read_metadata(spark, str(tmp_path / "m.txt")).collect()}
    assert got["abc"]["gene_symbols"] == ["G1", "G2"] and got["abc"]["nbk_id"] == "NBK1" and got["abc"]["condition_name"] == "Cond one"
    assert got["xyz"]["gene_symbols"] == [] and set(got) == {"abc", "xyz"}
    assert rows(tables.read_gene_index(spark, str(tmp_path / "m.txt")).select("gene")) == [("G1",), ("G1",), ("G2",)]


def test_sheet(spark):
    cells = {0: "G1", 1: "panel", 4: "1", 5: "2", 6: "T", 7: "AR", 9: "big", 16: " blue ", 24: "x", 27: "y", 61: "z", 68: " "}
    df = pd.DataFrame([[cells.get(i) for i in range(70)], [None] * 70, ["G2"] + [None] * 69])
    one, two = tables.sheet_table(spark, df).orderBy("gene_symbol").collect()
    assert one["extrarenal_manifestations"] == {"eyes": "blue", "respiratory": "x; y", "peripheral_nervous": "z"} and one["omim_phenotype_id"] == "1" and one["panel_categories"] == "panel"
    assert one["document"] == "Gene: G1 Condition: T Inheritance: AR Kidney manifestations: big Extrarenal manifestations: Eyes: blue; Respiratory: x; y; Peripheral Nervous: z"
    assert two["document"] == "Gene: G2" and two["extrarenal_manifestations"] == {} and len(tables.SHEET_SYSTEMS) == 33
    narrow = tables.sheet_table(spark, df.iloc[:, :8], systems={"eyes": (5, 6), "ears": (90, 91)}).orderBy("gene_symbol").first()
    assert narrow["extrarenal_manifestations"] == {"eyes": "2; T"} and narrow["kidney_manifestations"] is None


def test_articles(spark, tmp_path):
    (tmp_path / "abc.nxml").write_bytes(NXML)
    (tmp_path / "bad.nxml").write_bytes(b"<broken")
    (tmp_path / "skip.txt").write_bytes(NXML)
    with tarfile.open(tmp_path / "all.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("d/abc.nxml")
        info.size = len(NXML)
        t.addfile(info, io.BytesIO(NXML))
    for df in (articles.read_articles(spark, str(tmp_path)), articles.read_archives(spark, str(tmp_path))):
        got = df.orderBy("position").collect()
        assert [(r["shortname"], r["nbk_id"], r["section_path"], r["section_type"], r["retired"]) for r in got] == [
            ("abc", "NBK1", "Diagnosis", "diagnosis", True), ("abc", "NBK1", "Diagnosis > Deep", "other", True)]
        assert "a | -\nb | c" in got[1]["text"] and "long enough" in got[0]["text"] and got[0]["token_estimate"] == len(got[0]["text"]) // 4
    meta = spark.createDataFrame([("abc", "NBK5", ["G"], "C")], "shortname string, nbk_id string, gene_symbols array<string>, condition_name string")
    assert articles.with_metadata(df, meta).first()["gene_symbols"] == ["G"]


def test_embedders(spark):
    calls = []

    class Fake:
        dim = 2

        def encode(self, texts):
            calls.append(len(texts))
            return [[float(len(t)), 0.0] for t in texts]

    assert len(embed.encode_batches(Fake(), ["a"] * 7, 3)) == 7 and calls == [3, 3, 1]
    for answer in ([[1.0]], {"embeddings": [[1.0]]}, {"data": [{"embedding": [1.0]}]}):
        assert embed.vectors_of(answer) == [[1.0]]
    with pytest.raises(ValueError):
        embed.encode_batches(embed.HttpEmbedder("http://x", dim=3, post=lambda *a: b"[[1.0]]"), ["a"])
    with pytest.raises(ValueError):
        embed.HttpEmbedder("").encode(["a"])
    got = embed.with_embeddings(spark.createDataFrame([("a b",), (None,), ("a b",)], "t string"), "t", embed.HashEmbedder(16)).collect()
    assert got[0]["embedding"] == got[2]["embedding"] and got[1]["embedding"] is None and len(got[0]["embedding"]) == 16


def test_external(spark):
    xml = "<r><PubmedArticle><PMID>5</PMID><ArticleTitle>T <i>x</i></ArticleTitle><AbstractText>" + "w " * 400 + "</AbstractText></PubmedArticle></r>"
    fetch = lambda url: json.dumps({"esearchresult": {"idlist": ["5"]}}).encode() if "esearch" in url else xml.encode()
    got = external.abstracts("G", fetch)
    assert got[0]["title"] == "T x" and got[0]["abstract"].endswith("...") and len(got[0]["abstract"]) == 303
    assert external.abstracts("G", lambda url: 1 / 0) == []
    answer = json.dumps({"data": {"variant": {"genome": None, "exome": {"af": 0.12345678, "populations": [{"id": "a", "ac": 1, "an": 3}, {"id": "b", "ac": 0, "an": 3}]}}}})
    row = external.frequencies(spark.createDataFrame([(answer,)], "answer string")).first()
    assert row["allele_frequency"] == 0.123457 and row["populations"] == {"a": 0.333333}


def test_upsert_and_versions(spark, tmp_path):
    at = [datetime(2024, 1, d) for d in (1, 2, 3)]
    old = spark.createDataFrame([(1, "a", at[0], at[0]), (None, "n", at[0], at[0])], "id int, v string, created_at timestamp_ntz, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, "b", at[1], at[1]), (1, "c", at[2], at[2]), (2, "d", at[1], at[1]), (None, "m", at[1], at[1])], old.schema)
    want = [(None, "m", at[0]), (1, "c", at[0]), (2, "d", at[1])]
    once = store.upsert(old, new, ["id"], ["updated_at"])
    assert rows(once.select("id", "v", "created_at")) == want
    assert rows(store.upsert(once, new, ["id"], ["updated_at"]).select("id", "v", "created_at")) == want
    t = store.VersionedTable(spark, str(tmp_path), "x")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.swap(t.stage(old)) == 2
    v = t.stage(new)
    with pytest.raises(FileExistsError):
        t.stage(new)
    with pytest.raises(ValueError):
        t.swap(v, min_rows=100)
    assert t.read().count() == 2
    t.swap(t.stage(new, force=True))
    assert t.read().count() == 4
    with pytest.raises(ValueError):
        store.VersionedTable(spark, str(tmp_path), "x; drop")
    with pytest.raises(ValueError):
        store.replace_articles(old, old.limit(0), on="v")
