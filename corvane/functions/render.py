"""Rendering of what retrieval found: traces, evidence blocks, prompts and look-ups, as column expressions and small frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import plural, snippet

# What a type of question is called in a trace, and the wording of its lines.
TYPE_LABELS: Mapping[str, str] = {"variant": "variant lookup", "phenotype": "phenotype search", "non-clinical": "non-clinical (no retrieval)"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trace_line(source: str, n: Column | str, top: Column | str, noun: str, searched: Column | str, why_not: str) -> Column:
    """One source's line: how many records and which is first, that none match, or why it was not searched."""
    n, top, searched = _col(n), _col(top), _col(searched)
    hits = F.concat(F.lit(f"✓ {source} — "), plural(n, noun), F.lit(" (top: "), F.coalesce(top, F.lit("?")), F.lit(")"))
    many = noun[:-1] + "ies" if noun.endswith("y") else noun + "s"
    return F.when(n > 0, hits).when(searched, f"· {source} — no matching {many}").otherwise(f"· {source} — skipped ({why_not})")


def trace_header(query_type: Column | str, genes: Column | str, labels: Mapping[str, str] = TYPE_LABELS) -> Column:
    kind, genes = _col(query_type), _col(genes)
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), kind), kind, F.lit("search"))
    return F.concat(F.lit("🔍 "), label, F.when(F.size(genes) > 0, F.concat(F.lit(" ("), F.array_join(genes, ", "), F.lit(")"))).otherwise(""))


def trace(lines: Sequence[Column], title: str = "Retrieval trace") -> Column:
    """A folded block of the lines."""
    return F.concat(F.lit(f"<details>\n<summary>🔎 {title}</summary>\n\n```\n"), F.concat_ws("\n", *lines), F.lit("\n```\n\n</details>\n\n"))


def folded(title: Column | str, body: Column | str, limit: int = 320) -> Column:
    """One record as a folded block: its title, and an excerpt of its text with angle brackets escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<details><summary>"), safe(_col(title)), F.lit("</summary>\n\n"), safe(snippet(_col(body), limit)), F.lit("\n\n</details>"))


def evidence_browser(records: DataFrame, query: str, source: str, rank: str, title: str, body: str) -> DataFrame:
    """(query, browser): per question a folded block per source, in the order of `source`, with its records folded in it."""
    blocks = records.withColumn("_b", folded(title, body))
    each = blocks.groupBy(query, source).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("_b").alias("b")))).alias("_l"))
    inner = F.array_join(F.transform("_l", lambda x: x["b"]), "\n")
    one = F.concat(F.lit("<details><summary>"), F.col(source), F.lit(" ("), F.size("_l").cast("string"), F.lit(")</summary>\n\n"), inner, F.lit("\n\n</details>"))
    listed = each.withColumn("_o", one).groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(source).alias("s"), F.col("_o").alias("o")))).alias("_l"))
    return listed.select(query, F.array_join(F.transform("_l", lambda x: x["o"]), "\n").alias("browser"))


def augmented_prompt(system: str, evidence: Column | str) -> Column:
    """The instruction of a conversation with its evidence behind it."""
    return F.concat(F.lit(system.rstrip() + "\n\nEVIDENCE:\n"), F.coalesce(_col(evidence), F.lit("(none)")))


def genes_of_disease(queries: DataFrame, index: DataFrame, query: str = "query_id", text: str = "text", disease: str = "disease", gene: str = "gene", most: int = 10_000) -> DataFrame:
    """(query, disease, genes): diseases whose name holds the whole question, in any case, with their sorted genes.

    The index is the small table of articles, one row per article and gene. It is sent to every task if it has at most `most`
    rows; a larger one is met on the trigrams of the question, which every name that holds it has, rarest first for each question.
    Questions of one or two characters are met on those.
    """
    asked = queries.select(query, F.lower(F.trim(text)).alias("_q")).where("_q <> ''")
    names = index.select(disease, gene, F.lower(F.col(disease)).alias("_d")).where("_d IS NOT NULL")
    holds = F.col("_d").contains(F.col("_q"))
    if names.limit(most + 1).count() <= most:
        hits = asked.join(F.broadcast(names), holds)
    else:

        def grams(c: Column, n: int = 3) -> Column:
            return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n))))

        known = names.select("_d").distinct().where(F.length("_d") >= 3).select("_d", F.explode(grams(F.col("_d"))).alias("_t"))
        often = known.groupBy("_t").agg(F.count("*").alias("_n"))
        long = asked.where(F.length("_q") >= 3)
        # The rarest trigram of a question; one that no name has rules the question out.
        rare = long.select("_q").distinct().select("_q", F.explode(grams(F.col("_q"))).alias("_t")).join(often, "_t", "left")
        rare = rare.groupBy("_q").agg(F.min_by("_t", F.coalesce("_n", F.lit(0))).alias("_t"))
        met = rare.join(known, "_t").where(holds).select("_q", "_d")
        short = asked.where(F.length("_q") < 3).select("_q").distinct()
        least = names.select("_d").distinct().where("_d <> ''")
        ones = least.select("_d", F.explode(grams(F.col("_d"), 1)).alias("_q")).unionByName(least.where(F.length("_d") > 1).select("_d", F.explode(grams(F.col("_d"), 2)).alias("_q")))
        met = met.unionByName(short.join(ones, "_q").select("_q", "_d")).distinct()
        hits = asked.join(met, "_q").join(names, "_d")
    return hits.groupBy(query, disease).agg(F.sort_array(F.collect_set(gene)).alias("genes"))


def gene_links(index: DataFrame, gene: str = "gene", nbk: str = "nbk_id", disease: str = "disease") -> DataFrame:
    """(gene, links): the articles on a gene as a list of links."""
    from corvane.functions.parse import article_url

    entry = F.concat(F.lit("- ["), F.col(disease), F.lit("]("), article_url(nbk), F.lit(")"))
    return index.groupBy(gene).agg(F.array_join(F.array_sort(F.collect_set(entry)), "\n").alias("links"))
