"""Routing a table of parsed questions to the tiers of retrieval: exact, gene, hybrid.

Instead of asking one tier after the other for one question, each tier is one join for all questions; a question keeps the
best tier that has rows for it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.parse import VARIANT_NOTATION, hgvs_forms
from corvane.session import cut_lineage

# How tokens of the three kinds start, in lower case.
_STARTS = (r"c\.[0-9]+", r"p\.[a-z]{1,3}[0-9]+", "rs[0-9]+")


def exact_hits(questions: DataFrame, records: DataFrame, name: str = "name", gene: str = "gene", key: str = "variation_id") -> DataFrame:
    """(text, key) of records that hold every token of the question, of its gene if it names one.

    They meet by an equi-join on the start of the question's first token, up to its number, and on the gene if there is one;
    the test of all tokens decides.
    """
    t = F.col("tok")
    asked = questions.where(t["has_variant_token"]).select("text", t["gene"].alias("_g"), t["c_hgvs"].alias("_c"), t["p_hgvs"].alias("_p"), t["rsid"].alias("_rs"))
    # A token has one or two forms. They are plain columns: a lambda over both sides of a join would not be bound rightly.
    asked = asked.withColumn("_forms", hgvs_forms("_c")).withColumns({"_f0": F.lower(F.get("_forms", F.lit(0))), "_f1": F.lower(F.get("_forms", F.lit(1)))})
    low = F.lower(F.col(name))
    # As in the pattern language, an underscore in a token stands for any character.
    held = lambda form: F.coalesce(F.like(low, F.concat(F.lit("%"), F.col(form), F.lit("%"))), F.lit(False))
    asked = asked.withColumn("_lp", F.lower("_p"))
    with_c = F.col("_c").isNull() | held("_f0") | held("_f1")
    with_p = F.col("_p").isNull() | held("_lp")
    with_rs = F.col("_rs").isNull() | held("_rs")
    # Where a name holds the token, it holds the token's letters and number, and maybe further digits.
    starts = F.concat(*[F.regexp_extract_all(low, F.lit(x), F.lit(0)) for x in _STARTS])
    named = records.select(key, name, F.col(gene).alias("_g"), F.explode(F.array_distinct(starts)).alias("_s"))
    letters = F.length(F.regexp_extract("_s", "^(.*?)[0-9]+$", 1))
    own = named.select(key, name, "_g", F.explode(F.transform(F.sequence(letters + 1, F.length("_s")), lambda n: F.substr("_s", F.lit(1), n))).alias("_k")).distinct()
    asked = asked.withColumn("_k", F.regexp_extract(F.coalesce("_f0", F.lower("_p"), "_rs"), f"^({'|'.join(_STARTS)})", 1))
    by_gene = asked.where(F.col("_g").isNotNull()).join(own, ["_g", "_k"])
    free = asked.where(F.col("_g").isNull()).drop("_g").join(own.drop("_g"), "_k")
    return by_gene.where(with_c & with_p & with_rs).select("text", key).unionByName(free.where(with_c & with_p & with_rs).select("text", key)).distinct()


def tiers(questions: DataFrame, exact: DataFrame, records: DataFrame | None = None, gene: str = "gene") -> DataFrame:
    """(text, tier, n_exact): 'exact' if there are records, 'gene' for a gene without variant token, else 'hybrid'.

    A question that names no gene and holds no position in variant notation is not searched for: 'none'. With `records`, a question whose first gene has none is left to 'hybrid', as the tier 'gene' would find nothing.
    """
    known = F.lit(True)
    if records is not None:
        there = records.select(F.col(gene).alias("_first")).distinct().withColumn("_known", F.lit(True))
        questions = questions.withColumn("_first", F.get("genes", F.lit(0))).join(there, "_first", "left").drop("_first")
        known = F.coalesce("_known", F.lit(False))
    found = exact.groupBy("text").agg(F.count("*").alias("n_exact"))
    token = F.coalesce(F.col("tok")["has_variant_token"], F.lit(False))
    searched = (F.size("genes") > 0) | F.col("text").rlike(VARIANT_NOTATION)
    tier = F.when(~searched, "none").when(F.col("n_exact") > 0, "exact").when(~token & (F.size("genes") > 0) & known, "gene").otherwise("hybrid")
    return questions.join(found, "text", "left").withColumn("n_exact", F.coalesce("n_exact", F.lit(0))).withColumn("tier", tier).drop("_known")


def route(questions: DataFrame, records: DataFrame, k: int = 5, text: str = "text", qvec: str = "qvec", key: str = "variation_id") -> DataFrame:
    """(text, key, tier, place): the first `k` records of the best tier of every question.

    `questions` has text, qvec and what `corvane.functions.parse` makes of the text: genes and tok.
    """
    from corvane.functions.parse import review_rank
    from corvane.operators.retrieve import hybrid, ranked_by_key, top_k

    # Written once: the tiers, their records and the search for the rest all depend on these.
    exact = cut_lineage(exact_hits(questions, records, key=key))
    sorted_out = cut_lineage(tiers(questions, exact, records))
    of = lambda name: sorted_out.where(F.col("tier") == name)
    found = exact.join(of("exact").select("text"), "text", "left_semi")
    first = top_k(found, k, [text], [F.col(key)]).select(text, key, F.lit("exact").alias("tier"), "place")
    genes = of("gene").select(text, F.get("genes", F.lit(0)).alias("gene"))
    ranked = ranked_by_key(records, genes, "gene", review_rank("review_status"), key, k, query=text).select(text, key, F.lit("gene").alias("tier"), "place")
    open_ = of("hybrid").select(F.col(text).alias("query_id"), F.col(text).alias("text"), F.col(qvec).alias("qvec"))
    blended = hybrid(records, key, "embedding", ["name", "document"], open_, k=k).select(F.col("query_id").alias(text), key, F.lit("hybrid").alias("tier"), "place")
    return first.unionByName(ranked).unionByName(blended)


def article_top_k(chunks: DataFrame, questions: DataFrame, k: int = 5, threshold: float = 0.6, types: list[str] | None = None, include_retired: bool = False, text: str = "text", qvec: str = "qvec", genes: str = "genes", key: str = "id", vec: str = "embedding") -> DataFrame:
    """(text, key, similarity, place): per question the `k` chunks of greatest cosine over `threshold`, in one plan.

    A question that names genes sees only chunks on one of them: they meet by an equi-join on the gene, and if there are none, the
    question has no rows. Any other question sees all chunks. Retired chunks and, with `types`, chunks of other sections take no
    part. Vectors that are null, of another dimension or of length zero take no part. Ties go to the lesser key.
    """
    from corvane.functions.similarity import cosine_similarity
    from corvane.operators.retrieve import filtered, top_k, vector_top_k

    rows = filtered(chunks, types=types, include_retired=include_retired).where(F.col(vec).isNotNull())
    rows = rows.select(key, vec, "gene_symbols").dropDuplicates([key])
    named = questions.where(F.size(genes) > 0).select(text, qvec, F.explode(F.array_distinct(genes)).alias("_g"))
    by_gene = rows.select(key, vec, F.explode(F.array_distinct("gene_symbols")).alias("_g"))
    # A chunk on two of the genes counts once.
    pairs = named.join(by_gene, "_g").where(F.size(qvec) == F.size(vec)).select(text, key, cosine_similarity(qvec, vec).alias("similarity"))
    pairs = pairs.where(F.col("similarity") > threshold).distinct()
    near = top_k(pairs, k, [text], [F.col("similarity").desc(), F.col(key)])
    free = questions.where(F.coalesce(F.size(genes), F.lit(0)) <= 0)
    everywhere = vector_top_k(rows, key, vec, free, text, qvec, k, threshold)
    return near.select(text, key, "similarity", "place").unionByName(everywhere.select(text, key, "similarity", "place"))


def route_sources(questions: DataFrame, variants: DataFrame, chunks: DataFrame, entries: DataFrame, abstracts: DataFrame | None = None, k: int = 10, text: str = "text", qvec: str = "qvec", article_floor: float = 0.6, entry_floor: float = 0.3, on_step: Callable[[str, int, int], None] | None = None) -> DataFrame:
    """(text, source, key, tier, place): what every source has on every question; keys are text.

    Questions without a clinical signal get nothing. Variants are asked for questions on a gene or variant, by the best of
    their tiers; articles always, anchored on the question's genes if it names any; gene table entries where it has a renal term;
    and of `abstracts` (gene, pmid, rank) the first two on its first gene. With `on_step` every source is carried out by itself and
    then reported: its name, its records and the questions that it has any on; an error in the report is logged and ignored. `questions` has text, qvec and what
    `corvane.functions.parse` makes of the text: genes and tok.
    """
    from corvane.functions.parse import has_clinical_signal, has_renal_terms
    from corvane.operators.retrieve import top_k, vector_top_k

    asked = cut_lineage(questions.where(has_clinical_signal(text)))
    parts = [route(asked, variants, k=k, text=text, qvec=qvec).select(text, F.lit("ClinVar").alias("source"), F.col("variation_id").cast("string").alias("key"), "tier", "place")]
    on = lambda df, source, key: df.select(text, F.lit(source).alias("source"), F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("tier"), "place")
    parts.append(on(article_top_k(chunks, asked, k, article_floor, text=text, qvec=qvec), "GeneReviews", "id"))
    renal = asked.where(has_renal_terms(text))
    parts.append(on(vector_top_k(entries.select("id", "embedding").dropDuplicates(["id"]), "id", "embedding", renal, text, qvec, k, entry_floor), "NephroGenetics", "id"))
    if abstracts is not None:
        first = asked.where(F.size("genes") > 0).select(text, F.get("genes", F.lit(0)).alias("gene"))
        parts.append(on(top_k(first.join(abstracts, "gene"), 2, [text], [F.col("rank"), F.col("pmid")]), "PubMed", "pmid"))
    out = None
    for part, source in zip(parts, ("ClinVar", "GeneReviews", "NephroGenetics", "PubMed")):
        if on_step is not None:
            part = cut_lineage(part)
            n, of = part.agg(F.count("*"), F.countDistinct(text)).first()
            try:
                on_step(source, n, of)
            except Exception:
                logging.getLogger(__name__).exception("the report on %s failed", source)
        out = part if out is None else out.unionByName(part)
    return out
