"""Queries of the text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import cite, guard, parse, text
from corvane.plans.registry import Registry
from corvane.plans.retrieval import CURRENT, current_variants
from corvane.session import cut_lineage, table

registry = Registry()


def literals(spark, column: str, values: list[str | None]):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def values_sql(values: list[str | None]) -> str:
    return "(VALUES " + ", ".join("(NULL)" if v is None else "('" + v.replace("'", "''") + "')" for v in values) + ")"


_FORMS = ["c.1521_1523delCTT", "c.5266dupC", "c.526G>A", "c.1521_1523del", "c.581_582delCCinsAA", "c.10DELct"]


@registry.query(
    "q_hgvs_forms",
    sql=f"""SELECT c, array_to_string(CASE WHEN regexp_matches(c, '(?i)(?:^|[^a-z])(del|dup)[ACGT]+$')
      THEN list_distinct([c, regexp_replace(c, '(?i)(del|dup)[ACGT]+$', lower(regexp_extract(c, '(?i)(del|dup)[ACGT]+$', 1)))]) ELSE [c] END, '|') AS forms
    FROM {values_sql(_FORMS)} t(c)""".replace("list_distinct([", "list_sort(list_distinct([").replace("$', 1)))]) ELSE", "$', 1)))])) ELSE"),
)
def q_hgvs_forms(spark, sf_dir):
    return literals(spark, "c", _FORMS).select("c", F.array_join(F.sort_array(parse.hgvs_forms("c")), "|").alias("forms"))


_TOKENS = {
    "Is c.526g&gt;a in ALPL known?": ("c.526G>A", None, None, None, "ALPL"),
    "p.(Ala176Thr) and rs121918007": (None, "p.Ala176Thr", None, "rs121918007", None),
    "NM_000478.6(ALPL):c.526G>A (p.Ala176Thr)": ("c.526G>A", "p.Ala176Thr", "NM_000478.6", None, "ALPL"),
    "c.581_582delCCinsAA": ("c.581_582delCC", None, None, None, None),
    "p.Leu520ArgfsTer86": (None, "p.Leu520Arg", None, None, None),
    "m.1555A>G": (None, None, None, None, None),
    "c.5266DUPC": ("c.5266dupC", None, None, None, None),
    "nothing here": (None, None, None, None, None),
}


def _sql_value(v):
    return "NULL::VARCHAR" if v is None else f"'{v}'"


@registry.query(
    "q_variant_tokens",
    sql="SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', {', '.join(_sql_value(x) for x in v)}, {any(v[i] for i in (0, 1, 3))})" for t, v in _TOKENS.items())
    + ") t(text, c_hgvs, p_hgvs, transcript, rsid, gene, has_variant_token)",
)
def q_variant_tokens(spark, sf_dir):
    return literals(spark, "text", list(_TOKENS)).select("text", parse.variant_tokens("text").alias("t")).select("text", F.col("t").dropFields("raw_tokens").alias("t")).select("text", "t.*")


@registry.query(
    "q_significance_tier",
    sql="""SELECT CASE WHEN contains(s, 'conflicting') THEN 'conflicting' WHEN contains(s, 'uncertain') THEN 'uncertain' WHEN contains(s, 'pathogenic') THEN 'pathogenic'
      WHEN contains(s, 'benign') THEN 'benign' ELSE 'other' END AS tier, count(*) AS n FROM (SELECT lower(clinical_significance) AS s FROM variant_snapshots) GROUP BY 1""",
)
def q_significance_tier(spark, sf_dir):
    return table(spark, sf_dir, "variant_snapshots").groupBy(parse.significance_tier("clinical_significance").alias("tier")).agg(F.count("*").alias("n"))


_NOTE_SQL = " ".join(f"WHEN contains(lower(clinical_significance), '{k}') THEN ' {v}'" for k, v in parse.TIER_NOTES.items())


@registry.query(
    "q_build_document",
    sql=f"""SELECT variation_id, 'Gene: ' || gene || '. Variant: ' || name || '. Clinical significance: ' || clinical_significance || '. Review status: ' ||
      coalesce(review_status, '') || '. Associated conditions: ' || coalesce(nullif(array_to_string(list_filter(phenotypes, lambda x: x IS NOT NULL)[1:5], '; '), ''), 'Not specified')
      || '.' || CASE {_NOTE_SQL} ELSE '' END AS document FROM ({CURRENT})""",
)
def q_build_document(spark, sf_dir):
    listed = F.filter("phenotypes", lambda x: x.isNotNull())
    return current_variants(spark, sf_dir).select("variation_id", parse.variant_document("gene", "name", "clinical_significance", "review_status", listed).alias("document"))


_LISTS = ["Kidney failure; ;Gout;not provided", " Not Provided ", "a;b;c;d;e;f", "", None]


@registry.query(
    "q_phenotype_split",
    sql=f"""SELECT x, array_to_string(list_filter(list_transform(string_split(x, ';'), lambda p: trim(p)), lambda p: p <> '' AND lower(p) <> 'not provided'), '|') AS parts
    FROM {values_sql(_LISTS)} t(x)""",
)
def q_phenotype_split(spark, sf_dir):
    return literals(spark, "x", _LISTS).select("x", F.array_join(parse.phenotype_list("x"), "|").alias("parts"))


_TYPE_SQL = (
    "CASE "
    + " ".join(f"WHEN contains(s, '{k}') THEN '{v}'" for k, v in parse.SECTION_TYPES)
    + " ELSE 'other' END"
)


@registry.query(
    "q_section_type",
    sql=f"""WITH t AS (SELECT id, section_id, regexp_replace(regexp_replace(lower(CASE WHEN contains(section_id, '.') THEN regexp_replace(section_id, '^[^.]*\\.', '') ELSE section_id END),
      '[_0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM genereviews_sections WHERE section_id IS NOT NULL)
    SELECT id, section_id, {_TYPE_SQL} AS kind FROM t""",
)
def q_section_type(spark, sf_dir):
    rows = table(spark, sf_dir, "genereviews_sections").where("section_id IS NOT NULL")
    return rows.select("id", "section_id", parse.section_type("section_id").alias("kind"))


_TITLES = ["Lynch Syndrome – RETIRED CHAPTER, FOR HISTORICAL REFERENCE ONLY", "X ─ Retired Chapter", "for historical REFERENCE only", "Lynch Syndrome", "", None]


@registry.query("q_retired_flag", sql=f"SELECT title, coalesce(regexp_matches(title, '(?i)retired chapter|for historical reference only'), false) AS retired FROM (SELECT DISTINCT article_title AS title FROM genereviews_sections UNION ALL FROM {values_sql(_TITLES)} t(title))")
def q_retired_flag(spark, sf_dir):
    titles = table(spark, sf_dir, "genereviews_sections").select(F.col("article_title").alias("title")).distinct()
    return titles.unionByName(literals(spark, "title", _TITLES)).select("title", parse.is_retired_title("title").alias("retired"))


_NBK = ["NBK1211", "NBKwagner", "NBKdel2q37_2", "", None]


@registry.query(
    "q_url_guard",
    sql=f"""SELECT nbk_id, CASE WHEN regexp_matches(nbk_id, '^NBK[0-9]+$') THEN 'https://www.ncbi.nlm.nih.gov/books/' || nbk_id || '/' ELSE 'https://www.ncbi.nlm.nih.gov/books/NBK1116/' END AS url
    FROM (SELECT DISTINCT nbk_id FROM genereviews_sections UNION ALL FROM {values_sql(_NBK)} t(nbk_id))""",
)
def q_url_guard(spark, sf_dir):
    ids = table(spark, sf_dir, "genereviews_sections").select("nbk_id").distinct().unionByName(literals(spark, "nbk_id", _NBK))
    return ids.select("nbk_id", parse.article_url("nbk_id").alias("url"))


_GNOMAD = ["NC_000017.11:g.43057051T>C", "NC_000023.11:g.100G>A", "NC_000024.10:g.5A>T", "NM_007294.4(BRCA1):c.5266dupC", None]


@registry.query("q_gnomad_id", sql="SELECT * FROM (VALUES ('NC_000017.11:g.43057051T>C', '17-43057051-T-C'), ('NC_000023.11:g.100G>A', 'X-100-G-A'), ('NC_000024.10:g.5A>T', 'Y-5-A-T'), ('NM_007294.4(BRCA1):c.5266dupC', NULL), (NULL, NULL)) t(name, id)")
def q_gnomad_id(spark, sf_dir):
    return literals(spark, "name", _GNOMAD).select("name", parse.gnomad_id("name").alias("id"))


#: The chunker as SQL: a fold over sentences, the state being lists of finished and open sentences.
_CHUNKS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL),
big AS (SELECT * FROM d WHERE length(text) > 2000 AND NOT contains(text, ' | ')),
f AS (
  SELECT doc_id, s, 1 AS i, []::VARCHAR[] AS chunks, []::VARCHAR[] AS buf, 0::BIGINT AS n FROM big
  UNION ALL
  SELECT doc_id, s, i + 1,
    CASE WHEN alone THEN list_append(chunks, x) WHEN over THEN list_append(chunks, array_to_string(buf, ' ')) ELSE chunks END,
    CASE WHEN alone THEN buf WHEN over THEN list_append(list_slice(buf, len(buf) - k + 1, len(buf)), x) ELSE list_append(buf, x) END,
    CASE WHEN alone THEN n WHEN over THEN kept + length(x) + 1 ELSE n + length(x) + 1 END
  FROM (
    SELECT *, coalesce(list_sum(list_transform(list_slice(buf, len(buf) - k + 1, len(buf)), lambda y: length(y) + 1)), 0) AS kept
    FROM (SELECT *, s[i] AS x, length(s[i]) > 2000 AND len(buf) = 0 AS alone, n + length(s[i]) > 2000 AND len(buf) > 0 AS over,
            coalesce(list_max(list_filter(range(0, len(buf) + 1), lambda k: k = 0 OR
              coalesce(list_sum(list_transform(list_slice(buf, len(buf) - k + 1, len(buf)), lambda y: length(y) + 1)), 0) - 1 <= 200)), 0) AS k
          FROM f WHERE i <= len(s)))),
last AS (SELECT doc_id, CASE WHEN len(buf) > 0 THEN list_append(chunks, array_to_string(buf, ' ')) ELSE chunks END AS chunks FROM f WHERE i > len(s)),
every AS (SELECT doc_id, chunks FROM last UNION ALL SELECT doc_id, [text] FROM d WHERE length(text) <= 2000 OR contains(text, ' | '))
"""


def document_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    chunks = docs.select("doc_id", "lang", "source", F.posexplode(text.sentence_chunks("text")).alias("chunk_index", "chunk"))
    return chunks.withColumn("tokens", text.token_estimate("chunk"))


@registry.query(
    "q_chunks",
    sql=_CHUNKS_SQL + "SELECT doc_id, (i - 1)::INT AS chunk_index, length(chunks[i]) AS chars, length(chunks[i]) // 4 AS tokens, md5(chunks[i]) AS digest FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM every)",
)
def q_chunks(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("doc_id", "chunk_index", F.length("chunk").alias("chars"), "tokens", F.md5("chunk").alias("digest"))


@registry.query(
    "q_chunk_stats",
    sql=_CHUNKS_SQL
    + """SELECT lang, source, count(*) AS n_chunks, sum(length(c) // 4)::BIGINT AS tokens, round(avg(length(c) // 4))::INT AS mean_tokens
    FROM (SELECT e.doc_id, lang, source, unnest(chunks) AS c FROM every e JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((lang), (source), ())""",
)
def q_chunk_stats(spark, sf_dir):
    """Statistics by language, by source and over all, in one pass."""
    document_chunks(spark, sf_dir).createOrReplaceTempView("_chunks")
    return spark.sql(
        "SELECT lang, source, count(*) AS n_chunks, sum(tokens) AS tokens, cast(round(avg(tokens)) AS INT) AS mean_tokens FROM _chunks GROUP BY GROUPING SETS ((lang), (source), ())"
    )


@registry.query(
    "q_snippet",
    sql=r"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g'), ' ') AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 320 THEN t ELSE regexp_replace(substring(t, 1, 320), ' [^ ]*$', '') || '…' END AS snippet FROM t""",
)
def q_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet("text").alias("snippet"))


_ASKS = ["Do I have Fabry disease?", "rule out PKD", "please RECLASSIFY this", "which drug helps", "what does QPIB8 do", "Diagnose this 5-year-old", "should I tell them?", "give me a FINAL score", "clinical management of PKD", "  ", None]


def _any_sql(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


# The lists are written out here on their own, so that a wrong list in the library shows.
_REASON_SQL = r"""CASE WHEN coalesce(trim(q), '') = '' THEN 'blank'
 WHEN regexp_matches(lower(q), 'do i have|does my patient have|diagnose (me|my patient|this|the patient)|am i affected|is my patient affected|what (disease|condition) do i have|confirm (disease|condition|the diagnosis|my suspicion)|rule out|what does my patient have|what''?s wrong with my patient|should i tell (my patient|them)|tell my patient|will (my patient|they get|i get)|how long (does he|does she|do i) have|interpret (it and tell me|my)') THEN 'diagnosis'
 WHEN regexp_matches(lower(q), 'classify th(is|e variant)|reclassify|in your opinion|pathogenicity score|apply the acmg|acmg criteria|predict (whether|if)|what is the real answer|give me a final') THEN 'pathogenicity'
 WHEN regexp_matches(lower(q), 'how to (treat|manage)|(treatment|therapy|cure) for|what medication|which drug|prescribe|prescription|should i take|dosage|dose of|treatment options|clinical management') THEN 'treatment' END"""


@registry.query("q_guard_query", sql=f"SELECT reason, count(*) AS n FROM (SELECT {_REASON_SQL} AS reason FROM (SELECT query_text AS q FROM audit_logs UNION ALL FROM {values_sql(_ASKS)} t(q))) GROUP BY 1")
def q_guard_query(spark, sf_dir):
    asked = table(spark, sf_dir, "audit_logs").select(F.col("query_text").alias("q")).unionByName(literals(spark, "q", _ASKS))
    return asked.groupBy(guard.query_reason("q").alias("reason")).agg(F.count("*").alias("n"))


_SAYS = [
    ("You have gout [1]", True), ("You have access to it [1]", True), ("the treatment is rest", True), ("As known [2].", True), ("you have", False), ("This patient is consistent with X [1]", True),
    ("seen in a 5-year-old and is associated with Y", True), ("I recommend a quick treatment", True), ("start the therapy", True), ("based on these results, the patient has Z", True),
]


@registry.query(
    "q_guard_response",
    sql=r"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT has THEN NULL
      WHEN regexp_matches(regexp_replace(l, '\byou have( access| the option| provided)', '', 'g'), '\byou have\b') OR regexp_matches(l, '\byour patient has\b|\bi diagnose\b|\bthe diagnosis is\b')
        OR regexp_matches(l, '\bthis confirms\b[^\n]*\bdiagnosis\b') OR regexp_matches(l, '\bbased on (this|these) (variant|result)s?,? (you|the patient) (has|have)\b')
        OR regexp_matches(l, '\b(this|the)\s+([0-9]+[\s-]?year[\s-]?old|patient|child|individual|case|boy|girl|man|woman)\b[^\n]{0,120}?\b(is (consistent with|associated with|suggestive of|diagnostic of|indicative of)|most likely has|likely has|points to)\b')
        OR regexp_matches(l, '\bin (a|this|the)\s+([0-9]+[\s-]?year[\s-]?old|patient|child|individual|case)\b[^\n]{0,120}?\bis associated with\b') THEN 'diagnosis'
      WHEN regexp_matches(l, 'you should take\b|i recommend\b[^\n]*\btreatment\b|prescribe\b|start\b[^\n]*\btherapy\b|the treatment is\b|take\b[^\n]*\bmedication\b') THEN 'treatment'
      WHEN NOT regexp_matches(r, '\[[0-9]+\]') THEN 'uncited' END AS reason
    FROM (SELECT *, lower(r) AS l FROM (SELECT response_text AS r, len(retrieved_variant_ids) > 0 AS has FROM audit_logs WHERE response_text IS NOT NULL AND retrieved_variant_ids IS NOT NULL
          UNION ALL SELECT * FROM (VALUES """
    + ", ".join(f"('{t}', {str(h).lower()})" for t, h in _SAYS)
    + ") t(r, has)))) GROUP BY 1",
)
def q_guard_response(spark, sf_dir):
    logs = table(spark, sf_dir, "audit_logs").where("response_text IS NOT NULL AND retrieved_variant_ids IS NOT NULL")
    said = logs.select(F.col("response_text").alias("r"), (F.size("retrieved_variant_ids") > 0).alias("has"))
    extra = spark.createDataFrame(_SAYS, "r string, has boolean")
    return said.unionByName(extra).groupBy(guard.response_reason("r", "has").alias("reason")).agg(F.count("*").alias("n"))


@registry.query("q_think_strip", sql=r"SELECT id, regexp_replace(response_text, '(?s)<think>.*?</think>\s*', '', 'g') AS shown FROM audit_logs WHERE response_text IS NOT NULL")
def q_think_strip(spark, sf_dir):
    return table(spark, sf_dir, "audit_logs").where("response_text IS NOT NULL").select("id", text.strip_think("response_text").alias("shown"))


_LINES = ["A. Source: ClinVar - x [1]; UniProt [P0]", "A. source: NCBI Gene [7]", "Source: GeneReviews - y; ; z\nnext  line ", "none"]


@registry.query(
    "q_source_sanitise",
    sql=r"""WITH t AS (SELECT id, response_text AS t FROM audit_logs WHERE response_text IS NOT NULL UNION ALL SELECT -i, x FROM (VALUES """
    + ", ".join("({}, '{}')".format(i + 1, x.replace("\n", "' || chr(10) || '")) for i, x in enumerate(_LINES))
    + r""") v(i, x)),
    p AS (SELECT id, string_split_regex(t, '(?i)source:\s*') AS parts, regexp_extract_all(t, '(?i)source:\s*') AS labels FROM t),
    c AS (SELECT id, parts[1] || coalesce(array_to_string(list_transform(range(1, len(labels) + 1), lambda i:
        CASE WHEN regexp_extract(parts[i + 1], '^[^\n]*') = '' THEN labels[i] || parts[i + 1] ELSE
          coalesce(labels[i] || nullif(array_to_string(list_filter(list_transform(string_split(regexp_extract(parts[i + 1], '^[^\n]*'), ';'), lambda e: trim(e)), lambda e: e <> '' AND NOT
            regexp_matches(lower(e), 'ncbi ?gene|gene ?id|entrez|uniprot|ensembl|refseq|dbsnp|genecards|wikipedia')), '; '), ''), '') || regexp_replace(parts[i + 1], '^[^\n]*', '') END), ''), '') AS x FROM p)
    SELECT id, regexp_replace(regexp_replace(x, '[ \t]{2,}', ' ', 'g'), '(?m)[ \t]+$', '', 'g') AS clean FROM c""",
)
def q_source_sanitise(spark, sf_dir):
    logs = table(spark, sf_dir, "audit_logs").where("response_text IS NOT NULL").select("id", "response_text")
    more = spark.createDataFrame([(-i - 1, x) for i, x in enumerate(_LINES)], "id long, response_text string")
    return logs.unionByName(more).select("id", cite.sanitise_source_line("response_text").alias("clean"))


# ------------------------------------------------------------------ citations over the log
def cited_sources(spark, sf_dir):
    """What each logged row cites: the variants it retrieved, in order; articles and gene table entries on the genes of these, articles
    by their two first chunks; and the frequency of each variant, which the tables do not hold."""
    logs = table(spark, sf_dir, "audit_logs").where("retrieved_variant_ids IS NOT NULL").groupBy(F.col("id").alias("query_id")).agg(F.min("retrieved_variant_ids").alias("ids"))
    used = logs.select("query_id", F.posexplode("ids").alias("rank", "variation_id"))
    v = current_variants(spark, sf_dir).select("variation_id", "gene", "name", "clinical_significance", "review_status", "phenotypes", "document")
    # Read by all four sources: written once.
    variants = cut_lineage(used.join(v, "variation_id"))
    genes = variants.groupBy("query_id", "gene").agg(F.min("rank").alias("rank"))
    chunks = table(spark, sf_dir, "genereviews_chunks").where("NOT retired AND chunk_text IS NOT NULL AND section_type = 'management'")
    first = Window.partitionBy("gene").orderBy("id", "chunk_text")
    # Of rows that repeat an id the one with the least text counts, and of a chunk on two genes the better place.
    one = chunks.groupBy("id").agg(F.min(F.struct("chunk_text", "nbk_id", "condition_name", "gene_symbols", "section_path")).alias("x")).select("id", "x.*")
    per_gene = one.withColumn("gene", F.explode(F.array_distinct("gene_symbols"))).withColumn("c", F.row_number().over(first)).where("c <= 2")
    met = genes.join(per_gene, "gene").withColumn("rank", F.col("rank") * 10 + F.col("c"))
    articles = met.groupBy("query_id", "id").agg(F.min(F.struct("rank", *one.columns[1:])).alias("x")).select("query_id", "x.*")
    fields = ("id", "title", "inheritance", "kidney_manifestations", "extrarenal_manifestations", "omim_phenotype_id")
    entries = table(spark, sf_dir, "nephrogenetics").groupBy(F.col("gene_symbol").alias("gene")).agg(F.min(F.struct(*fields)).alias("e"))
    entries = genes.join(entries, "gene").select("query_id", "rank", F.col("gene").alias("gene_symbol"), "e.*")
    unknown = variants.where("rank = 0").select("query_id", "rank", F.concat(F.lit("v"), "variation_id").alias("variant_id"), F.lit(None).cast("string").alias("allele_frequency"), F.lit(None).cast("string").alias("url"), F.create_map().cast("map<string,string>").alias("populations"))
    return [cite.variant_source(variants), cite.article_source(articles), cite.entry_source(entries), cite.frequency_source(unknown)]


_CITED_SQL = f"""
WITH logs AS (SELECT id, min(retrieved_variant_ids) AS ids FROM audit_logs WHERE retrieved_variant_ids IS NOT NULL GROUP BY id),
used AS (SELECT id AS query_id, unnest(ids) AS variation_id, generate_subscripts(ids, 1) - 1 AS rank FROM logs),
cv AS (SELECT * FROM used JOIN ({CURRENT}) USING (variation_id)),
ge AS (SELECT query_id, gene, min(rank) AS rank FROM cv GROUP BY ALL),
pg AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id, chunk_text) AS c FROM (SELECT DISTINCT ON (g, id) *, g FROM (SELECT *, unnest(list_distinct(gene_symbols)) AS g FROM genereviews_chunks
       WHERE NOT retired AND chunk_text IS NOT NULL AND section_type = 'management') ORDER BY g, id, chunk_text) QUALIFY c <= 2),
ar AS (SELECT DISTINCT ON (query_id, id) query_id, ge.rank * 10 + c AS rank, id, nbk_id, condition_name, gene_symbols, section_path, chunk_text FROM ge JOIN pg ON g = gene ORDER BY query_id, id, ge.rank * 10 + c),
en AS (SELECT DISTINCT ON (gene_symbol) * FROM nephrogenetics ORDER BY gene_symbol, id),
ps AS (
  SELECT query_id, 0 AS source_rank, rank, variation_id::VARCHAR AS key, 'ClinVar:' || variation_id || ' - ' || gene || ' ' || name || ', ' || coalesce(nullif(clinical_significance, ''), 'Unknown significance') AS title,
    'https://www.ncbi.nlm.nih.gov/clinvar/variation/' || variation_id || '/' AS url,
    'ClinVar:' || variation_id || ' - ' || gene || ' ' || name || ' (' || clinical_significance || ', ' || coalesce(review_status, '') || ')' || coalesce(chr(10) || 'Conditions: ' || nullif(array_to_string(phenotypes, '; '), ''), '') || chr(10) || document AS body, NULL AS more FROM cv
  UNION ALL SELECT query_id, 1, rank, nbk_id, 'GeneReviews: ' || coalesce(condition_name, '') || coalesce(' (' || nullif(array_to_string(gene_symbols, ', '), '') || ')', '') || ' [' || nbk_id || ']',
    CASE WHEN regexp_full_match(nbk_id, 'NBK[0-9]+') THEN 'https://www.ncbi.nlm.nih.gov/books/' || nbk_id || '/' ELSE 'https://www.ncbi.nlm.nih.gov/books/NBK1116/' END,
    'GeneReviews: ' || coalesce(condition_name, '') || ' (' || nbk_id || ')' || coalesce(' > ' || nullif(section_path, ''), '') || chr(10) || chunk_text, '(continued)' || coalesce(' > ' || nullif(section_path, ''), '') || chr(10) || chunk_text FROM ar
  UNION ALL SELECT query_id, 2, ge.rank, en.id::VARCHAR, 'NephroGenetics: ' || gene || ' - ' || coalesce(title, ''), coalesce('https://omim.org/entry/' || omim_phenotype_id, ''),
    'NephroGenetics: ' || gene || ' - ' || coalesce(title, '') || chr(10) || 'Inheritance: ' || coalesce(inheritance, '') || chr(10) || 'Kidney manifestations: ' || coalesce(kidney_manifestations, '')
      || coalesce(chr(10) || 'Extrarenal: ' || nullif(extrarenal_manifestations, ''), '') || coalesce(chr(10) || 'OMIM: ' || omim_phenotype_id, ''), NULL FROM ge JOIN en ON gene_symbol = gene
  UNION ALL SELECT query_id, 3, 0, 'v' || variation_id, 'gnomAD: v' || variation_id || ', AF=N/A', '', 'gnomAD: v' || variation_id || chr(10) || 'Allele frequency: N/A', NULL FROM cv WHERE rank = 0),
ke AS (SELECT query_id, source_rank, key, min(rank) AS r, arg_min(title, (rank, title)) AS title, arg_min(url, (rank, title)) AS url FROM ps GROUP BY ALL),
nu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_rank, r, key) AS number FROM ke),
bl AS (SELECT ps.query_id, number, row_number() OVER (PARTITION BY ps.query_id ORDER BY ps.source_rank, ps.rank, number) AS place,
         CASE WHEN more IS NOT NULL AND row_number() OVER (PARTITION BY ps.query_id, ps.source_rank, ps.key ORDER BY ps.rank) > 1 THEN more ELSE body END AS body FROM ps JOIN nu USING (query_id, source_rank, key))
"""


@registry.query("q_citations", sql=_CITED_SQL + "SELECT query_id, number, title, url FROM nu")
def q_citations(spark, sf_dir):
    return cite.build_citations(cited_sources(spark, sf_dir)).select("query_id", "number", "title", "url")


@registry.query("q_evidence_text", sql=_CITED_SQL + "SELECT query_id, string_agg('[' || number || '] ' || body, chr(10) || chr(10) ORDER BY place) AS evidence FROM bl GROUP BY 1")
def q_evidence_text(spark, sf_dir):
    sources = cited_sources(spark, sf_dir)
    return cite.evidence_text(cite.evidence_blocks(sources, cite.build_citations(sources)), place="place")


@registry.query(
    "q_used_markers",
    sql=_CITED_SQL
    + r"""SELECT DISTINCT m.id AS query_id, nu.number, nu.title FROM (SELECT id, unnest(list_transform(regexp_extract_all(response_text, '\[([0-9]{1,9})\]', 1), lambda x: x::INT)) AS n FROM audit_logs) m
    JOIN nu ON nu.query_id = m.id AND nu.number = m.n""",
)
def q_used_markers(spark, sf_dir):
    """Citations that an answer's markers point to."""
    said = table(spark, sf_dir, "audit_logs").select(F.col("id").alias("query_id"), F.explode(cite.markers("response_text")).alias("number")).distinct()
    return cite.build_citations(cited_sources(spark, sf_dir)).join(said, ["query_id", "number"], "left_semi").select("query_id", "number", "title")


@registry.query("q_postprocess")
def q_postprocess(spark, sf_dir):
    """Answers with linked markers and a list of the sources used."""
    cites = cite.build_citations(cited_sources(spark, sf_dir)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "title", "url"))).alias("c"))
    logs = table(spark, sf_dir, "audit_logs").where("response_text IS NOT NULL").select("id", "response_text").distinct()
    joined = logs.join(cites, logs["id"] == cites["query_id"], "left")
    return joined.select("id", cite.postprocess_citations("response_text", "c").alias("answer"))


# ------------------------------------------------------------------ conversations
def messages(spark, sf_dir):
    """(conversation, turn, role, text): the log as turns of the sessions' conversations."""
    logs = table(spark, sf_dir, "audit_logs").dropDuplicates(["id"])
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id"))
    both = logs.select("session_id", turn.alias("_n"), "query_text", "response_text")
    each = both.select("session_id", F.explode(F.array(
        F.struct((F.col("_n") * 2 - 1).alias("turn"), F.lit("user").alias("role"), F.col("query_text").alias("text")),
        F.struct((F.col("_n") * 2).alias("turn"), F.lit("assistant").alias("role"), F.col("response_text").alias("text")),
    )).alias("m"))
    return each.select(F.col("session_id").alias("conversation"), "m.*")


_MESSAGES_SQL = """
l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS n FROM (SELECT DISTINCT ON (id) * FROM audit_logs)),
m AS (SELECT session_id AS conversation, n * 2 - 1 AS turn, 'user' AS role, query_text AS text FROM l UNION ALL SELECT session_id, n * 2, 'assistant', response_text FROM l)
"""


@registry.query("q_last_user_msg", sql=f"WITH {_MESSAGES_SQL} SELECT conversation, max_by(text, turn) AS last_question, starts_with(ltrim(max_by(text, turn)), '### Task:') AS is_task FROM m WHERE role = 'user' GROUP BY 1")
def q_last_user_msg(spark, sf_dir):
    asked = messages(spark, sf_dir).where("role = 'user'").groupBy("conversation").agg(F.max_by("text", "turn").alias("last_question"))
    return asked.withColumn("is_task", F.ltrim("last_question").startswith("### Task:"))


@registry.query(
    "q_augmented_messages",
    sql=f"WITH {_MESSAGES_SQL} SELECT conversation, turn, role, text FROM m UNION ALL SELECT DISTINCT conversation, 0, 'system', 'Answer from the evidence only.' FROM m",
)
def q_augmented_messages(spark, sf_dir):
    """Conversations with the system's own instruction in front, and none of a client's."""
    turns = messages(spark, sf_dir).where("role <> 'system'")
    first = turns.select("conversation").distinct().select("conversation", F.lit(0).alias("turn"), F.lit("system").alias("role"), F.lit("Answer from the evidence only.").alias("text"))
    return turns.select("conversation", "turn", "role", "text").unionByName(first)


@registry.query(
    "q_trace_counts",
    sql="""SELECT id, CASE WHEN n = 0 THEN '· ClinVar — no matching variants' WHEN n = 1 THEN '✓ ClinVar — 1 variant (top: ' || top || ')'
      ELSE '✓ ClinVar — ' || n || ' variants (top: ' || top || ')' END AS line
    FROM (SELECT id, len(retrieved_variant_ids) AS n, retrieved_variant_ids[1] AS top FROM audit_logs WHERE retrieved_variant_ids IS NOT NULL)""",
)
def q_trace_counts(spark, sf_dir):
    logs = table(spark, sf_dir, "audit_logs").where("retrieved_variant_ids IS NOT NULL")
    n, top = F.size("retrieved_variant_ids"), F.get("retrieved_variant_ids", F.lit(0)).cast("string")
    line = F.when(n == 0, "· ClinVar — no matching variants").otherwise(F.concat(F.lit("✓ ClinVar — "), text.plural(n, "variant"), F.lit(" (top: "), top, F.lit(")")))
    return logs.select("id", line.alias("line"))
