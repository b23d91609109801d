"""Queries of sources, sinks, statistics and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import aggregate
from corvane.operators.retrieve import min_max
from corvane.plans.registry import Registry
from corvane.plans.retrieval import CURRENT, cosine_sql, current_variants, question_rows, unit_sql
from corvane.session import cut_lineage, table
from corvane.sources import articles, store
from corvane.sources.tables import fold_metadata
from corvane.streaming import filters, sessions

registry = Registry()


@registry.query(
    "q_upsert_last_wins",
    sql="""WITH old AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-01' + INTERVAL 0 DAY), every AS (SELECT user_id, event_type, event_id, ts, value FROM events)
    SELECT user_id, event_type, event_id, value FROM every QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def q_upsert_last_wins(spark, sf_dir):
    """All events laid over the even ones by user and kind: the last wins."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return store.upsert(rows.where("event_id % 2 = 0"), rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@registry.query(
    "q_upsert_records",
    sql="""SELECT gene_symbol, omim_phenotype_id, max(id) AS id FROM nephrogenetics GROUP BY ALL""",
)
def q_upsert_records(spark, sf_dir):
    """The gene table over itself by its composite key, null ids being equal to one another."""
    rows = table(spark, sf_dir, "nephrogenetics").select("id", "gene_symbol", "omim_phenotype_id", "created_at")
    return store.upsert(rows, rows, ["gene_symbol", "omim_phenotype_id"], ["id"]).select("gene_symbol", "omim_phenotype_id", "id")


@registry.query("q_delete_by_keys", sql="SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)")
def q_delete_by_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return store.delete_by_keys(rows, rows.where("event_id % 97 = 0"), ["user_id"]).select("event_id", "user_id")


@registry.query(
    "q_metadata_fold",
    sql="""WITH g AS (SELECT shortname, id, nbk_id, condition_name, unnest(gene_symbols) AS g, generate_subscripts(gene_symbols, 1) AS p FROM genereviews_sections),
    f AS (SELECT shortname, g, min(id * 1000 + p) AS o FROM g WHERE g IS NOT NULL AND g <> '' GROUP BY ALL)
    SELECT shortname, arg_min(nbk_id, id) AS nbk_id, genes FROM genereviews_sections JOIN (SELECT shortname, string_agg(g, ',' ORDER BY o) AS genes FROM f GROUP BY 1) USING (shortname) GROUP BY shortname, genes""",
)
def q_metadata_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "genereviews_sections").select("shortname", "nbk_id", "condition_name", "id", F.posexplode("gene_symbols").alias("p", "gene"))
    rows = rows.withColumn("o", F.col("id") * 1000 + F.col("p"))
    return fold_metadata(rows, "o").select("shortname", "nbk_id", F.array_join("gene_symbols", ",").alias("genes"))


@registry.query(
    "q_section_stats",
    sql="SELECT section_type, count(*) AS n_chunks, sum(token_estimate)::BIGINT AS total_tokens, round(avg(token_estimate))::INT AS mean_tokens FROM genereviews_chunks GROUP BY 1",
)
def q_section_stats(spark, sf_dir):
    return aggregate.section_stats(table(spark, sf_dir, "genereviews_chunks"))


@registry.query(
    "q_distinct_on",
    sql="""SELECT nbk_id, shortname, article_title, n_chunks, tokens::BIGINT AS tokens FROM (SELECT *, count(*) OVER w AS n_chunks, sum(token_estimate) OVER w AS tokens,
      row_number() OVER (PARTITION BY nbk_id ORDER BY id, chunk_index NULLS FIRST, section_id NULLS FIRST) AS r FROM genereviews_chunks WINDOW w AS (PARTITION BY nbk_id)) WHERE r = 1""",
)
def q_distinct_on(spark, sf_dir):
    return aggregate.articles(table(spark, sf_dir, "genereviews_chunks"))


@registry.query(
    "q_section_filter",
    sql="SELECT id, section_type FROM genereviews_sections WHERE length(text) > 50 AND list_has_any(gene_symbols, ['XBEV9', 'JLET2']) AND section_type IN ('diagnosis', 'clinical_features')",
)
def q_section_filter(spark, sf_dir):
    return aggregate.section_filter(table(spark, sf_dir, "genereviews_sections"), ["XBEV9", "JLET2"], ["diagnosis", "clinical_features"]).select("id", "section_type")


@registry.query("q_totals", sql="SELECT count(*) AS n, sum(token_estimate)::BIGINT AS tokens FROM genereviews_sections")
def q_totals(spark, sf_dir):
    return table(spark, sf_dir, "genereviews_sections").agg(F.count("*").alias("n"), F.sum("token_estimate").alias("tokens"))


@registry.query(
    "q_minmax_norm",
    sql="""SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER w) / coalesce(nullif(max(l_quantity) OVER w - min(l_quantity) OVER w, 0), 1), 6) AS scaled
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
)
def q_minmax_norm(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    return rows.select("l_orderkey", "l_linenumber", F.round(min_max("q", ["l_orderkey"]), 6).alias("scaled"))


@registry.query(
    "q_audit_rows",
    sql=f"""WITH cur AS ({CURRENT}), u AS (SELECT * FROM cur WHERE embedding IS NOT NULL AND {unit_sql('embedding')}),
    s AS (SELECT q.id AS query_id, c.variation_id, {cosine_sql('q.embedding', 'c.embedding')} AS x FROM u q, u c WHERE q.id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12) DESC, variation_id) AS place FROM s QUALIFY place <= 5)
    SELECT query_id, list(variation_id ORDER BY place) AS retrieved_variant_ids, list(round(x, 4) ORDER BY place) AS scores, 'spark' AS model_version FROM r GROUP BY 1""",
)
def q_audit_rows(spark, sf_dir):
    """Rows of the log for the stated questions; the scores are read back from their JSON."""
    from corvane.operators.retrieve import vector_top_k

    cur = cut_lineage(current_variants(spark, sf_dir).select("id", "variation_id", "name", "embedding"))
    best = vector_top_k(cur, "variation_id", "embedding", question_rows(cur), "query_id", "qvec", 5)
    rows = store.audit_rows(best)
    parsed = F.from_json("retrieval_scores", "array<struct<id:int,score:double,rank:int>>")
    return rows.select("query_id", "retrieved_variant_ids", F.transform(parsed, lambda x: x["score"]).alias("scores"), "model_version")


_SESSIONS_SQL = "SELECT session_id, count(*) AS query_count, min(created_at) AS first_query_at, max(created_at) AS last_query_at FROM audit_logs GROUP BY 1"


@registry.query("q_sessions", sql=_SESSIONS_SQL)
def q_sessions(spark, sf_dir):
    return sessions.session_counts(table(spark, sf_dir, "audit_logs"))


@registry.query("q_stream_sessions", sql=_SESSIONS_SQL)
def q_stream_sessions(spark, sf_dir):
    """The same counters, kept by a stream over the log."""
    stream = sessions.session_counts(sessions.stream_of(spark, f"{sf_dir}/audit_logs.parquet"))
    return sessions.run_to_folder(stream, store.temporary_folder(spark, "sessions"), store.temporary_folder(spark, "state"))


@registry.query(
    "q_stream_windows",
    sql="SELECT time_bucket(INTERVAL 1 DAY, created_at) AS window_start, count(*) AS n FROM audit_logs GROUP BY 1",
)
def q_stream_windows(spark, sf_dir):
    """Rows per day of event time, by a stream with a watermark."""
    stream = sessions.windowed_counts(sessions.stream_of(spark, f"{sf_dir}/audit_logs.parquet"), length="1 day")
    out = sessions.run_to_folder(stream, store.temporary_folder(spark, "windows"), store.temporary_folder(spark, "state"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@registry.query("q_stream_think", sql=r"SELECT id, regexp_replace(response_text, '(?s)<think>.*?</think>', '', 'g') AS shown FROM (SELECT DISTINCT id, response_text FROM audit_logs) WHERE response_text <> ''")
def q_stream_think(spark, sf_dir):
    """Answers cut into chunks of seven characters, filtered by a stream with state, and put together again."""
    folder = store.temporary_folder(spark, "chunks")
    said = table(spark, sf_dir, "audit_logs").select("id", "response_text").distinct().where("response_text <> ''")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("response_text") - 1) / 7).cast("int")), lambda i: F.substring("response_text", i * 7 + 1, F.lit(7)))
    chunks = said.select(F.col("id").alias("stream_id"), F.size(parts).alias("_n"), F.posexplode(parts).alias("seq", "chunk"))
    chunks.select("stream_id", "seq", "chunk", (F.col("seq") == F.col("_n") - 1).alias("is_last")).write.parquet(folder)
    out = sessions.run_to_folder(filters.hide_reasoning(sessions.stream_of(spark, folder)), store.temporary_folder(spark, "think"), store.temporary_folder(spark, "state"), mode="append")
    shown = F.array_sort(F.collect_list(F.struct("seq", "shown")))
    return out.groupBy(F.col("stream_id").alias("id")).agg(F.array_join(F.transform(shown, lambda x: x["shown"]), "").alias("shown"))


@registry.query(
    "q_json_map",
    sql="""SELECT id, k AS system, extrarenal_manifestations ->> ('$."' || k || '"') AS finding FROM (SELECT id, extrarenal_manifestations, unnest(json_keys(extrarenal_manifestations)) AS k FROM
    (SELECT DISTINCT id, extrarenal_manifestations FROM nephrogenetics) WHERE extrarenal_manifestations IS NOT NULL)""",
)
def q_json_map(spark, sf_dir):
    rows = table(spark, sf_dir, "nephrogenetics").select("id", "extrarenal_manifestations").distinct()
    parsed = F.from_json("extrarenal_manifestations", T.MapType(T.StringType(), T.StringType()))
    return rows.select("id", F.explode(F.map_filter(parsed, lambda k, v: v.isNotNull())).alias("system", "finding"))


@registry.query("q_swap", sql="SELECT count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part")
def q_swap(spark, sf_dir):
    """A table built aside in two versions, each shown whole."""
    t = store.VersionedTable(spark, store.temporary_folder(spark, "swap"), "part")
    rows = table(spark, sf_dir, "part")
    t.swap(t.stage(rows.where("p_size > 10")))
    t.swap(t.stage(rows), min_rows=1)
    return t.read().agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@registry.query("q_nxml_sections")
def q_nxml_sections(spark, sf_dir):
    """The section table written as articles in XML and parsed again."""
    rows = table(spark, sf_dir, "genereviews_sections").dropDuplicates(["id"])
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " ")
    sec = F.concat(F.lit('<sec id="'), esc(F.col("section_id")), F.lit('"><title>'), esc(F.col("section_title")), F.lit("</title><p>"), esc(F.col("text")), F.lit("</p></sec>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", sec.alias("x")))), lambda s: s["x"]), "")
    xml = rows.groupBy("nbk_id", "shortname").agg(
        F.concat(F.lit('<article><front><article-id pub-id-type="book">'), F.first("nbk_id"), F.lit("</article-id><article-title>"), esc(F.min("article_title")), F.lit("</article-title></front><body>"), body, F.lit("</body></article>")).alias("xml")
    )
    out = articles.sections_of_text(xml, "shortname", "xml")
    return out.select("nbk_id", "shortname", "section_id", "section_title", "section_path", "section_type", "char_count", "token_estimate")


@registry.query("q_semi_join", sql="SELECT DISTINCT gene FROM variants WHERE gene IN (SELECT gene_symbol FROM nephrogenetics)")
def q_semi_join(spark, sf_dir):
    """Genes of the variant table that the gene table has."""
    genes = table(spark, sf_dir, "nephrogenetics").select(F.col("gene_symbol").alias("gene"))
    return table(spark, sf_dir, "variants").select("gene").distinct().join(genes, "gene", "left_semi")


@registry.query(
    "q_nth_of_source",
    sql="SELECT source, doc_id FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 3",
)
def q_nth_of_source(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").withColumn("r", F.row_number().over(w)).where("r = 3").select("source", "doc_id")
