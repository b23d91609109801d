"""Queries of the retrieval operators over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import parse
from corvane.functions.similarity import l2_normalise, dot, trigram_distance, trigram_similarity
from corvane.operators import retrieve as R
from corvane.plans.registry import Registry
from corvane.session import cut_lineage, table

registry = Registry()

#: The current state of each variant: the row updated last.
CURRENT = "SELECT * FROM variants QUALIFY row_number() OVER (PARTITION BY variation_id ORDER BY updated_at DESC, id DESC) = 1"


def current_variants(spark, sf_dir):
    w = Window.partitionBy("variation_id").orderBy(F.col("updated_at").desc(), F.col("id").desc())
    return table(spark, sf_dir, "variants").withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def trigram_sql(c: str) -> str:
    words = f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def similarity_sql(a: str, b: str) -> str:
    """Of two trigram lists."""
    common = f"len(list_intersect({a}, {b}))"
    return f"coalesce({common} / nullif(len({a}) + len({b}) - {common}, 0), 0.0)"


def unit_sql(v: str) -> str:
    return f"list_sum(list_transform({v}, lambda x: x::DOUBLE * x)) > 0"


def cosine_sql(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def question_rows(corpus):
    """The stated set of questions: every record whose id is divisible by 100."""
    asked = corpus.where((F.col("id") % 100 == 0) & F.col("embedding").isNotNull())
    return asked.select(F.col("id").alias("query_id"), F.col("name").alias("text"), F.col("embedding").alias("qvec"))


def _hybrid_sql(pool: int, floor: float, k: int) -> str:
    return rf"""
    WITH cur AS ({CURRENT}),
    q AS (SELECT id AS query_id, name AS text, embedding AS qvec, {trigram_sql('name')} AS qt FROM cur
          WHERE id % 100 = 0 AND embedding IS NOT NULL),
    v AS (SELECT variation_id, embedding FROM cur WHERE embedding IS NOT NULL AND {unit_sql('embedding')}),
    s AS (SELECT query_id, variation_id, {cosine_sql('qvec', 'embedding')} AS semantic FROM q, v WHERE {unit_sql('qvec')}
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(semantic, 12) DESC, variation_id) <= {pool}),
    sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(semantic, 12) DESC, variation_id) AS r FROM s),
    t AS (SELECT variation_id, {trigram_sql('name')} AS nt, {trigram_sql('document')} AS dt FROM cur),
    x AS (SELECT query_id, variation_id, greatest({similarity_sql('nt', 'qt')}, {similarity_sql('dt', 'qt')}) AS lexical FROM q, t),
    xp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, variation_id) AS r FROM x WHERE lexical > 0
           QUALIFY r <= {pool}),
    m AS (SELECT coalesce(sp.query_id, xp.query_id) AS query_id, coalesce(sp.variation_id, xp.variation_id) AS variation_id,
                 coalesce(semantic, 0.0) AS semantic, coalesce(lexical, 0.0) AS lexical, sp.r AS a, xp.r AS b
          FROM sp FULL JOIN xp ON sp.query_id = xp.query_id AND sp.variation_id = xp.variation_id),
    f AS (SELECT *, max(semantic) OVER w - min(semantic) OVER w AS sr, max(lexical) OVER w - min(lexical) OVER w AS lr,
                 min(semantic) OVER w AS s0, min(lexical) OVER w AS l0 FROM m WHERE lexical >= {floor} WINDOW w AS (PARTITION BY query_id)),
    z AS (SELECT *, 0.3 * (semantic - s0) / coalesce(nullif(sr, 0), 1) + 0.7 * (lexical - l0) / coalesce(nullif(lr, 0), 1) AS score FROM f)
    SELECT query_id, variation_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id
           ORDER BY round(score, 12) DESC, a NULLS LAST, b NULLS LAST, variation_id) AS place
    FROM z QUALIFY place <= {k}
    """


def _hybrid(spark, sf_dir, k=5, **kw):
    # Written once: the questions and both legs read it.
    cur = cut_lineage(current_variants(spark, sf_dir).select("id", "variation_id", "name", "document", "embedding"))
    out = R.hybrid(cur, "variation_id", "embedding", ["name", "document"], question_rows(cur), k=k, **kw)
    return out.select("query_id", "variation_id", F.round("score", 6).alias("score"), "place")


@registry.query("q_hybrid_topk", sql=_hybrid_sql(200, 0.2, 10))
def q_hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, k=10, pool=200, floor=0.2)


@registry.query("q_hybrid_degenerate", sql=_hybrid_sql(50, 0.95, 5))
def q_hybrid_degenerate(spark, sf_dir):
    """A floor that only the record itself passes: a single survivor scores 0."""
    return _hybrid(spark, sf_dir, pool=50, floor=0.95)


@registry.query("q_hybrid_batch", sql=_hybrid_sql(50, 0.45, 5))
def q_hybrid_batch(spark, sf_dir):
    return _hybrid(spark, sf_dir)


def _semantic_sql(k: int, threshold: str) -> str:
    return f"""
    WITH cur AS ({CURRENT}),
    q AS (SELECT id AS query_id, embedding AS qvec FROM cur WHERE id % 100 = 0 AND embedding IS NOT NULL),
    s AS (SELECT query_id, variation_id, {cosine_sql('qvec', 'embedding')} AS c FROM q, cur
          WHERE embedding IS NOT NULL AND {unit_sql('embedding')} AND {unit_sql('qvec')})
    SELECT query_id, variation_id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, variation_id) AS place
    FROM s WHERE {threshold} QUALIFY place <= {k}
    """


def _semantic(spark, sf_dir, k, threshold=None):
    cur = cut_lineage(current_variants(spark, sf_dir).select("id", "variation_id", "name", "embedding"))
    out = R.vector_top_k(cur, "variation_id", "embedding", question_rows(cur), "query_id", "qvec", k, threshold)
    return out.select("query_id", "variation_id", F.round("similarity", 6).alias("similarity"), "place")


@registry.query("q_semantic_topk", sql=_semantic_sql(10, "true"))
def q_semantic_topk(spark, sf_dir):
    return _semantic(spark, sf_dir, 10)


@registry.query("q_semantic_threshold", sql=_semantic_sql(10, "c > 0.6"))
def q_semantic_threshold(spark, sf_dir):
    return _semantic(spark, sf_dir, 10, threshold=0.6)


@registry.query("q_semantic_batch", sql=_semantic_sql(5, "true"))
def q_semantic_batch(spark, sf_dir):
    return _semantic(spark, sf_dir, 5)


@registry.query("q_l2_normalise", sql=f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / nullif(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 0), 6) AS squares FROM embeddings")
def q_l2_normalise(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").withColumn("v", l2_normalise(F.transform("embedding", lambda x: x * 3)))
    return scaled.select("vec_id", F.round(dot("v", "v"), 6).alias("squares"))


@registry.query(
    "q_trigram_topk",
    sql=f"""WITH n AS (SELECT DISTINCT name FROM variants), t AS (SELECT name, {trigram_sql('name')} AS a, {trigram_sql("'c.1841T>A QVINR9'")} AS b FROM n)
    SELECT name, round({similarity_sql('a', 'b')}, 6) AS similarity, round(1 - {similarity_sql('a', 'b')}, 6) AS distance FROM t
    ORDER BY {similarity_sql('a', 'b')} DESC, name LIMIT 20""",
)
def q_trigram_topk(spark, sf_dir):
    names = table(spark, sf_dir, "variants").select("name").distinct()
    asked = F.lit("c.1841T>A QVINR9")
    scored = names.withColumn("s", trigram_similarity("name", asked)).withColumn("d", trigram_distance("name", asked))
    return scored.orderBy(F.col("s").desc(), "name").limit(20).select("name", F.round("s", 6).alias("similarity"), F.round("d", 6).alias("distance"))


@registry.query(
    "q_trigram_docs",
    sql=f"""WITH t AS (SELECT doc_id, {trigram_sql('text')} AS a, {trigram_sql("'early hearing loss in carriers'")} AS b FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, round({similarity_sql('a', 'b')}, 6) AS similarity FROM t WHERE {similarity_sql('a', 'b')} > 0""",
)
def q_trigram_docs(spark, sf_dir):
    """Whole texts against a fixed question."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    asked = spark.createDataFrame([(1, "early hearing loss in carriers")], "query_id int, text string")
    return R.trigram_scores(docs, "doc_id", ["text"], asked, "query_id", "text").select("doc_id", F.round("lexical", 6).alias("similarity"))


@registry.query(
    "q_exact_ilike",
    sql="SELECT variation_id, name FROM (SELECT DISTINCT variation_id, name FROM variants) WHERE name ILIKE '%c.1_4%del%' ORDER BY variation_id, name LIMIT 50",
)
def q_exact_ilike(spark, sf_dir):
    """An underscore in a token stands for any character."""
    rows = table(spark, sf_dir, "variants").select("variation_id", "name").distinct()
    hits = rows.where(F.ilike("name", F.lit("%c.1_4%del%")))
    return hits.orderBy("variation_id", "name").limit(50)


@registry.query(
    "q_exact_multi_form",
    sql=f"""SELECT variation_id, gene, name FROM ({CURRENT}) WHERE gene = 'QPIB8' AND (name ILIKE '%delCTT%' OR name ILIKE '%del%') AND name ILIKE '%c.%'
    ORDER BY variation_id LIMIT 25""",
)
def q_exact_multi_form(spark, sf_dir):
    out = R.exact_match(current_variants(spark, sf_dir), "name", [["delCTT", "del"], ["c."]], 25, "variation_id", gene="QPIB8")
    return out.select("variation_id", "gene", "name")


_RANK_SQL = "CASE review_status " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in parse.REVIEW_RANKS.items()) + " ELSE 8 END"


@registry.query(
    "q_gene_ranked",
    sql=f"""SELECT gene, variation_id, {_RANK_SQL} AS rank, row_number() OVER (PARTITION BY gene ORDER BY {_RANK_SQL}, variation_id) AS place
    FROM ({CURRENT}) WHERE gene IN (SELECT gene_symbol FROM nephrogenetics) QUALIFY place <= 5""",
)
def q_gene_ranked(spark, sf_dir):
    """The best reviewed variants of every gene of the gene table."""
    genes = table(spark, sf_dir, "nephrogenetics").select(F.col("gene_symbol").alias("gene")).distinct().withColumn("query_id", F.col("gene"))
    out = R.ranked_by_key(current_variants(spark, sf_dir), genes, "gene", parse.review_rank("review_status"), "variation_id", 5)
    return out.select("gene", "variation_id", "rank", "place")


@registry.query(
    "q_array_overlap",
    sql="""SELECT id, section_id, section_type FROM genereviews_chunks
    WHERE NOT retired AND list_has_any(gene_symbols, ['QPIB8', 'JTAM4']) AND section_type IN ('diagnosis', 'management', 'summary')""",
)
def q_array_overlap(spark, sf_dir):
    chunks = table(spark, sf_dir, "genereviews_chunks")
    return R.filtered(chunks, ["QPIB8", "JTAM4"], ["diagnosis", "management", "summary"]).select("id", "section_id", "section_type")


@registry.query(
    "q_filtered_semantic",
    sql=f"""WITH q AS (SELECT min_by(embedding, variation_id) AS qvec FROM ({CURRENT}) WHERE embedding IS NOT NULL AND {unit_sql('embedding')} AND gene = 'QPIB8')
    SELECT id, gene_symbol, round({cosine_sql('qvec', 'embedding')}, 6) AS similarity
    FROM (SELECT * FROM nephrogenetics QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1), q
    WHERE embedding IS NOT NULL AND {unit_sql('embedding')} AND inheritance IN ('AR', 'AD') AND {cosine_sql('qvec', 'embedding')} > 0.05
    ORDER BY round({cosine_sql('qvec', 'embedding')}, 12) DESC, id LIMIT 10""",
)
def q_filtered_semantic(spark, sf_dir):
    """Filters, a threshold and the first k by cosine."""
    cur = current_variants(spark, sf_dir).where((F.col("gene") == "QPIB8") & F.col("embedding").isNotNull() & (dot("embedding", "embedding") > 0))
    asked = cur.orderBy("variation_id").limit(1).select(F.lit(1).alias("query_id"), F.col("embedding").alias("qvec"))
    genes = table(spark, sf_dir, "nephrogenetics").where(F.col("inheritance").isin("AR", "AD")).dropDuplicates(["id"])
    best = R.vector_top_k(genes.select("id", "embedding"), "id", "embedding", asked, "query_id", "qvec", 10, threshold=0.05)
    return best.join(genes.select("id", "gene_symbol"), "id").select("id", "gene_symbol", F.round("similarity", 6).alias("similarity"))


# ------------------------------------------------------------------ routing
def every_question(spark, sf_dir):
    """Every distinct question of the log, with what is parsed from it."""
    logs = table(spark, sf_dir, "audit_logs").select(F.col("query_text").alias("text")).where("text IS NOT NULL").distinct()
    parsed = logs.withColumn("genes", parse.gene_symbols("text")).withColumn("tok", parse.variant_tokens("text"))
    return parsed.withColumn("query_type", parse.query_type("text"))


# Word boundaries of the SQL engine know ASCII only. Letters and digits of other scripts become an underscore first, which is part of a
# word but of no gene; other characters become a hyphen, spaces a space.
_PLAIN_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(text, '[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]', ' ', 'g'), "
    "'[^\\p{L}\\p{N}\\x00-\\x7f]', '-', 'g'), '[^\\x00-\\x7f]', '_', 'g')"
)
_STOP_SQL = "'THE','AND','FOR','ARE','BUT','NOT','YOU','ALL','CAN','HER','WAS','ONE','OUR','OUT','HAS','HIS','HOW','ITS','MAY','NEW','NOW','OLD','SEE','WAY','WHO','DID','GET','HIM','LET','SAY','SHE','TOO','USE','DNA','RNA','VUS','WHAT','WHICH','WITH','FROM','HAVE','THIS','THAT','THEY','BEEN','RISK','TYPE','GENE','DOES','MOST','RARE','ALSO','MORE','THAN','INTO','SOME'"
_GENES_SQL = (
    "list_filter(list_distinct(list_concat(regexp_extract_all(plain, '\\b([A-Z][A-Z0-9]{1,9})\\b', 1), list_transform(regexp_extract_all(plain, "
    "'(?i)\\b(?:(?:gene|variant|mutation|allele)s?\\s+(?:in\\s+|of\\s+)?[A-Za-z][A-Za-z0-9]{1,9}|[A-Za-z][A-Za-z0-9]{1,9}\\s+gene)\\b'), lambda m: upper("
    "CASE WHEN regexp_matches(m, '(?i)^(?:gene|variant|mutation|allele)s?\\s') THEN regexp_extract(m, '(?i)^(?:gene|variant|mutation|allele)s?\\s+(?:in\\s+|of\\s+)?([A-Za-z][A-Za-z0-9]{1,9})$', 1) "
    "ELSE regexp_extract(m, '(?i)^([A-Za-z][A-Za-z0-9]{1,9})\\s+gene$', 1) END)))), lambda g: length(g) >= 2 AND NOT list_contains(["
    + _STOP_SQL
    + "], g))"
)
_FIRST_GENE_SQL = _GENES_SQL.replace("list_distinct(list_concat(", "(list_concat(", 1) + "[1]"
_ASKED_SQL = f"(SELECT *, {_PLAIN_SQL} AS plain FROM (SELECT DISTINCT query_text AS text FROM audit_logs WHERE query_text IS NOT NULL))"
_SIGNAL_SQL = (
    "regexp_matches(lower(text), 'gene|variant|mutation|allele|phenotype|syndrome|disease|disorder|inherit|heredit|pathogen|benign|clinvar|omim|acmg|vus|genotype|carrier|homozyg|heterozyg|autosomal|x-linked|recessive|"
    "dominant|diagnos|screen|panel|exome|genome|sequenc|kidney|renal|nephro|nephrotic|nephritic|glomerul|tubul|polycystic|pkd|alport|fabry|iga nephropathy|fsgs|cakut|ckd|dialysis|transplant')"
)
_HGVS_SQL = "regexp_matches(plain, '\\b[cpgmn]\\.[0-9]')"


@registry.query("q_gene_symbols", sql=f"SELECT text, coalesce(array_to_string(list_sort({_GENES_SQL}), ','), '') AS genes FROM {_ASKED_SQL}")
def q_gene_symbols(spark, sf_dir):
    return every_question(spark, sf_dir).select("text", F.array_join(F.sort_array("genes"), ",").alias("genes"))


@registry.query(
    "q_classify",
    sql=f"""WITH g AS (SELECT text, len({_GENES_SQL}) > 0 OR {_HGVS_SQL} AS specific FROM {_ASKED_SQL})
    SELECT CASE WHEN specific THEN 'variant' WHEN {_SIGNAL_SQL} THEN 'phenotype' ELSE 'non-clinical' END AS query_type, count(*) AS n FROM g GROUP BY 1""",
)
def q_classify(spark, sf_dir):
    return every_question(spark, sf_dir).groupBy("query_type").agg(F.count("*").alias("n"))


@registry.query(
    "q_question_tokens",
    sql=f"""WITH q AS (SELECT text, regexp_extract_all(plain, '\\b([A-Z][A-Z0-9]{{1,9}})\\b', 1) AS caps, nullif(regexp_extract(plain, '\\b([NX][MRCG]_[0-9]+\\.[0-9]+)\\b', 1), '') AS transcript,
                 regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9])([cgmn]\\.\\s*[0-9][0-9_+\\-*]*(?:[ACGT]+)?(?:(?:>|&gt;)[ACGT]+|del[ACGT]*|dup[ACGT]*|ins[ACGT]+|delins[ACGT]+)?)', 1) AS nt,
                 nullif(regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9])(p\\.\\(?[A-Z][a-z]{{0,2}}[0-9]+(?:[A-Z][a-z]{{0,2}}|=|\\*|Ter|fs(?:Ter)?[0-9]*|del|dup)?\\)?)', 1), '') AS pt,
                 nullif(lower(regexp_extract(plain, '(?i)\\b(rs[0-9]+)\\b', 1)), '') AS rsid FROM {_ASKED_SQL})
    SELECT text, CASE WHEN lower(nt[1]) = 'c' THEN lower(replace(regexp_replace(nt, '\\s', '', 'g'), '&gt;', '>')) END AS c, lower(regexp_replace(pt, '[\\s()]', '', 'g')) AS p, transcript, rsid,
      list_filter(caps, lambda x: NOT list_contains([{_STOP_SQL}], x))[1] AS gene FROM q""",
)
def q_question_tokens(spark, sf_dir):
    """What is parsed from every distinct question of the log."""
    t = F.col("tok")
    return every_question(spark, sf_dir).select("text", F.lower(t["c_hgvs"]).alias("c"), F.lower(t["p_hgvs"]).alias("p"), t["transcript"].alias("transcript"), t["rsid"].alias("rsid"), t["gene"].alias("gene"))


@registry.query(
    "q_route_tiers",
    sql=f"""WITH cur AS ({CURRENT}),
    q AS (SELECT text, {_GENES_SQL} AS genes, {_FIRST_GENE_SQL} AS first_gene, {_HGVS_SQL} AS hgvs, regexp_extract_all(plain, '\\b([A-Z][A-Z0-9]{{1,9}})\\b', 1) AS caps,
                 regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9])([cgmn]\\.\\s*[0-9][0-9_+\\-*]*(?:[ACGT]+)?(?:(?:>|&gt;)[ACGT]+|del[ACGT]*|dup[ACGT]*|ins[ACGT]+|delins[ACGT]+)?)', 1) AS nt,
                 nullif(regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9])(p\\.\\(?[A-Z][a-z]{{0,2}}[0-9]+(?:[A-Z][a-z]{{0,2}}|=|\\*|Ter|fs(?:Ter)?[0-9]*|del|dup)?\\)?)', 1), '') AS pt,
                 nullif(lower(regexp_extract(plain, '(?i)\\b(rs[0-9]+)\\b', 1)), '') AS rs FROM {_ASKED_SQL}),
    t AS (SELECT text, genes, first_gene, hgvs, list_filter(caps, lambda x: NOT list_contains([{_STOP_SQL}], x))[1] AS g, rs, lower(regexp_replace(pt, '[\\s()]', '', 'g')) AS p,
                 CASE WHEN lower(nt[1]) = 'c' THEN lower(replace(regexp_replace(nt, '\\s', '', 'g'), '&gt;', '>')) END AS c FROM q),
    f AS (SELECT *, regexp_replace(c, '([^a-z])(del|dup)[acgt]+$', '\\1\\2') AS d FROM t),
    e AS (SELECT text, variation_id FROM f JOIN cur ON (g IS NULL OR cur.gene = g) AND (c IS NOT NULL OR p IS NOT NULL OR rs IS NOT NULL)
            AND (c IS NULL OR name ILIKE '%' || c || '%' OR name ILIKE '%' || d || '%') AND (p IS NULL OR name ILIKE '%' || p || '%') AND (rs IS NULL OR name ILIKE '%' || rs || '%')),
    n AS (SELECT text, count(DISTINCT variation_id) AS n FROM e GROUP BY 1)
    SELECT text, coalesce(n, 0) AS n_exact, CASE WHEN NOT (len(genes) > 0 OR hgvs) THEN 'none' WHEN n > 0 THEN 'exact'
      WHEN c IS NULL AND p IS NULL AND rs IS NULL AND first_gene IN (SELECT gene FROM cur) THEN 'gene' ELSE 'hybrid' END AS tier
    FROM f LEFT JOIN n USING (text)""",
)
def q_route_tiers(spark, sf_dir):
    """Which tier answers each distinct question of the log, whatever its form and script."""
    from corvane.operators.route import exact_hits, tiers

    asked = every_question(spark, sf_dir)
    cur = cut_lineage(current_variants(spark, sf_dir).select("variation_id", "name", "gene"))
    return tiers(asked, exact_hits(asked, cur), cur).select("text", "tier", "n_exact")


def asked_with_vectors(spark, sf_dir):
    """The stated questions, those of rows with an id divisible by 100, each with the vector of the variant row of that id."""
    logs = table(spark, sf_dir, "audit_logs").where((F.col("id") % 100 == 0) & F.col("query_text").isNotNull()).groupBy("id").agg(F.min("query_text").alias("text"))
    vectors = table(spark, sf_dir, "variants").where("embedding IS NOT NULL").groupBy("id").agg(F.min("embedding").alias("qvec"))
    asked = logs.join(vectors, "id").groupBy("text").agg(F.min_by("qvec", "id").alias("qvec"))
    return asked.withColumn("genes", parse.gene_symbols("text")).withColumn("tok", parse.variant_tokens("text"))


def chunks_with_vectors(spark, sf_dir):
    """The chunks, which have no vectors of their own, each with that of the variant row of its id."""
    chunks = table(spark, sf_dir, "genereviews_chunks").groupBy("id").agg(F.min("gene_symbols").alias("gene_symbols"), F.min("section_type").alias("section_type"), F.max("retired").alias("retired"))
    vectors = table(spark, sf_dir, "variants").where("embedding IS NOT NULL").groupBy("id").agg(F.min("embedding").alias("embedding"))
    return chunks.join(vectors, "id")


_VECTORS_SQL = f"""v AS (SELECT id, min(embedding) AS e FROM variants WHERE embedding IS NOT NULL GROUP BY 1),
    a AS (SELECT text, arg_min(e, id) AS qvec FROM (SELECT id, min(query_text) AS text FROM audit_logs WHERE id % 100 = 0 AND query_text IS NOT NULL GROUP BY 1) JOIN v USING (id) GROUP BY 1),
    q AS (SELECT text, qvec, {_GENES_SQL} AS genes, {_HGVS_SQL} AS hgvs FROM (SELECT *, {_PLAIN_SQL} AS plain FROM a)),
    c AS (SELECT id, min(gene_symbols) AS gs, min(section_type) AS st, bool_or(retired) AS retired FROM genereviews_chunks GROUP BY 1)"""


@registry.query(
    "q_article_topk",
    sql=f"""WITH {_VECTORS_SQL},
    s AS (SELECT text, id, {cosine_sql('qvec', 'e')} AS x FROM q, (SELECT * FROM c JOIN v USING (id) WHERE NOT retired) k
          WHERE (len(genes) = 0 OR list_has_any(gs, genes)) AND {unit_sql('qvec')} AND {unit_sql('e')})
    SELECT text, id, round(x, 6) AS similarity, row_number() OVER (PARTITION BY text ORDER BY round(x, 12) DESC, id) AS place FROM s WHERE x > 0.1 QUALIFY place <= 5""",
)
def q_article_topk(spark, sf_dir):
    """Filters, threshold and first k on chunks in one plan, anchored on the genes of a question that names any."""
    from corvane.operators.route import article_top_k

    near = article_top_k(cut_lineage(chunks_with_vectors(spark, sf_dir)), cut_lineage(asked_with_vectors(spark, sf_dir)), threshold=0.1)
    return near.select("text", "id", F.round("similarity", 6).alias("similarity"), "place")


@registry.query("q_route")
def q_route(spark, sf_dir):
    """What the variants, the articles and the gene table have on each stated question."""
    from corvane.operators.route import route_sources

    cur = cut_lineage(current_variants(spark, sf_dir).select("variation_id", "name", "gene", "document", "review_status", "embedding"))
    return route_sources(asked_with_vectors(spark, sf_dir), cur, cut_lineage(chunks_with_vectors(spark, sf_dir)), table(spark, sf_dir, "nephrogenetics"), article_floor=0.1)
