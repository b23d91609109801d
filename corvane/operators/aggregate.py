"""Statistics of the section tables: views as functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def section_stats(chunks: DataFrame) -> DataFrame:
    """(section_type, n_chunks, total_tokens, mean_tokens): the mean is rounded half away from zero."""
    return chunks.groupBy("section_type").agg(
        F.count("*").alias("n_chunks"), F.sum("token_estimate").alias("total_tokens"), F.round(F.avg("token_estimate")).cast("int").alias("mean_tokens")
    )


def articles(chunks: DataFrame) -> DataFrame:
    """One row per article: its first chunk's fields with the article's number of chunks and tokens."""
    whole = Window.partitionBy("nbk_id")
    first = whole.orderBy("id", "chunk_index", "section_id")
    counted = chunks.withColumns({"n_chunks": F.count("*").over(whole), "tokens": F.sum("token_estimate").over(whole), "_r": F.row_number().over(first)})
    return counted.where(F.col("_r") == 1).select("nbk_id", "shortname", "article_title", "n_chunks", "tokens")


def section_filter(sections: DataFrame, genes: list[str] | None = None, types: list[str] | None = None, min_chars: int = 50, text: str = "text") -> DataFrame:
    """Sections worth keeping at ingest: longer than `min_chars`, sharing a gene, of a wanted type."""
    out = sections.where(F.length(text) > min_chars)
    if genes:
        out = out.where(F.arrays_overlap("gene_symbols", F.array(*[F.lit(g) for g in genes])))
    return out.where(F.col("section_type").isin(types)) if types else out
