"""Sources behind a network: abstracts and frequencies, with a fetcher that callers may replace."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fetcher = Callable[[str], bytes]


def http_get(url: str, timeout: float = 10.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read()


def abstracts(gene: str, fetch: Fetcher = http_get, limit: int = 2, cut: int = 300, base: str = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils") -> list[dict]:
    """pmid, title, abstract and url of articles on a gene's pathogenic variants; any failure gives none."""
    try:
        term = urllib.parse.quote(f"{gene}[Gene] AND pathogenic variant")
        ids = json.loads(fetch(f"{base}/esearch.fcgi?db=pubmed&retmode=json&retmax={limit}&term={term}"))["esearchresult"]["idlist"]
        if not ids:
            return []
        root = ET.fromstring(fetch(f"{base}/efetch.fcgi?db=pubmed&retmode=xml&id={','.join(ids)}"))
    except Exception:
        return []
    out = []
    for article in root.iter("PubmedArticle"):
        pmid = article.findtext(".//PMID") or ""
        text = " ".join(" ".join("".join(e.itertext()).split()) for e in article.iter("AbstractText"))
        title = article.find(".//ArticleTitle")
        out.append({
            "gene": gene,
            "pmid": pmid,
            "title": "".join(title.itertext()) if title is not None else "",
            "abstract": text[:cut] + "..." if len(text) > cut else text,
            "url": f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/",
        })
    return out


def gene_abstracts(genes: DataFrame, gene_col: str, fetch: Fetcher = http_get, limit: int = 2) -> DataFrame:
    """(gene, pmid, title, abstract, url) for every distinct gene."""

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for g in b["gene"] for r in abstracts(g, fetch, limit)]
            yield pd.DataFrame(rows, columns=["gene", "pmid", "title", "abstract", "url"])

    asked = genes.select(F.col(gene_col).alias("gene")).where("gene IS NOT NULL").distinct()
    return asked.mapInPandas(look_up, "gene string, pmid string, title string, abstract string, url string")


def frequencies(answers: DataFrame, json_col: str = "answer") -> DataFrame:
    """`answers` with the allele frequency of the genome data, else the exome data, and of populations above 0, to 6 places."""
    part = "struct<af: double, populations: array<struct<id: string, ac: long, an: long>>>"
    parsed = F.from_json(json_col, f"struct<data: struct<variant: struct<genome: {part}, exome: {part}>>>")
    best = F.coalesce(parsed["data"]["variant"]["genome"], parsed["data"]["variant"]["exome"])
    shares = F.map_from_entries(F.transform(best["populations"], lambda p: F.struct(p["id"], F.round(p["ac"] / F.nullif(p["an"], F.lit(0)), 6))))
    return answers.withColumns({"allele_frequency": F.round(best["af"], 6), "populations": F.map_filter(shares, lambda k, v: v > 0)})
