"""Queries of the operators on text and vectors, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.llm.mixing import mix, mixture_report, plan_sources
from corvane.llm.neighbours import clean_vectors, neighbour_pairs, search_neighbours, similar_neighbours
from corvane.llm.packing import Capacity, fill_containers
from corvane.llm.pairs import find_defects
from corvane.llm.personal import sanitise
from corvane.llm.skeleton import look_alike_pairs, look_classes
from corvane.llm.splitting import split_items
from corvane.llm.tokens import token_sizes
from corvane.operators.retrieve import top_k, vector_top_k
from corvane.session import cut_lineage, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(f):
    _QUERIES[f.__name__] = f
    return f


@_query
def p1_found(spark, sf_dir):
    found = sanitise(table(spark, sf_dir, "audit_logs"), "id", ["query_text", "response_text"], table(spark, sf_dir, "person_names"))
    return found.select("id", "field_name", F.explode("types").alias("pii_type")).distinct()


@_query
def p1_sanitised(spark, sf_dir):
    """The texts themselves, with a placeholder for every detail."""
    clean = sanitise(table(spark, sf_dir, "audit_logs"), "id", ["query_text", "response_text"], table(spark, sf_dir, "person_names"))
    return clean.select("id", "field_name", "clean", F.array_join("types", ",").alias("types"))


@_query
def p1_planted(spark, sf_dir):
    """Every question of the log with details of four types put behind it, and what becomes of them."""
    logs = table(spark, sf_dir, "audit_logs").where("query_text IS NOT NULL").select("id", "query_text").distinct()
    planted = logs.withColumn("query_text", F.concat("query_text", F.lit("\nSigned by Dr Zorba Quill, zorba.quill@mail.test, +1 415 555 0195, 12 Mill Road.")))
    clean = sanitise(planted, "id", ["query_text"], table(spark, sf_dir, "person_names"))
    return clean.select("id", F.substring_index("clean", "\n", -1).alias("tail")).distinct()


_SQL["p1_planted"] = "SELECT DISTINCT id, 'Signed by Dr [NAME], [EMAIL], [PHONE], [ADDRESS].' AS tail FROM audit_logs WHERE query_text IS NOT NULL"


@_query
def p3_planted(spark, sf_dir):
    """The questions of the log with themselves in presenting words, with nothing, or with an answer behind them."""
    logs = table(spark, sf_dir, "audit_logs").where("length(trim(query_text)) > 8").groupBy("id").agg(F.min("query_text").alias("query_text"))
    given = F.when(F.col("id") % 3 == 0, F.concat(F.lit('You asked: "'), "query_text", F.lit('"'))).when(F.col("id") % 3 == 1, F.lit(" [1]"))
    answer = F.concat("query_text", F.lit("\nDie Antwort darauf liegt in der Akte, die Labore haben sie geprüft und bestätigt."))
    return find_defects(logs.withColumn("response_text", given.otherwise(answer))).where("defect IN ('copied', 'empty')")


_SQL["p3_planted"] = "SELECT DISTINCT id, CASE id % 3 WHEN 0 THEN 'copied' ELSE 'empty' END AS defect FROM audit_logs WHERE length(trim(query_text)) > 8 AND id % 3 < 2"


@_query
def p3_found(spark, sf_dir):
    return find_defects(table(spark, sf_dir, "audit_logs"))


#: The two tables of sections and their text columns.
_SECTIONS = (("genereviews_sections", "text"), ("genereviews_chunks", "chunk_text"))


def _section_pieces(spark, sf_dir):
    parts = []
    for name, text in _SECTIONS:
        rows = table(spark, sf_dir, name)
        pieces = split_items(rows, "id", text, keep=["section_id", "chunk_index"])
        parts.append(pieces.withColumn("tbl", F.lit(name)))
    return parts[0].unionByName(parts[1])


@_query
def p5_found(spark, sf_dir):
    pieces = _section_pieces(spark, sf_dir)
    return pieces.where(F.col("n_chars") > 2_000).select("tbl", "id", "cut_kind").distinct()


@_query
def p5_pieces(spark, sf_dir):
    """Every piece of every section and chunk, with its place in the text."""
    return _section_pieces(spark, sf_dir)


_SQL["p5_found"] = r"""
WITH t AS (SELECT 'genereviews_sections' AS tbl, id, text AS x FROM genereviews_sections
           UNION ALL SELECT 'genereviews_chunks', id, chunk_text FROM genereviews_chunks)
SELECT DISTINCT tbl, id,
  CASE WHEN list_max(list_transform(string_split_regex(regexp_replace(x, '([.!?])\s+', '\1' || chr(10), 'g'), '[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]+'),
                                    lambda s: length(regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')))) > 2000 THEN 'forced' ELSE 'boundary' END AS cut_kind
FROM t WHERE length(x) > 2000
"""


#: White space as the splitter takes it, for expressions of both engines.
_WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@_query
def p5_rebuilt(spark, sf_dir):
    """Every text put together again from its pieces without their overlaps, and whether its pieces keep limit and overlap."""
    parts = []
    for name, text in _SECTIONS:
        rows = table(spark, sf_dir, name).where(F.col(text).isNotNull()).select("id", text, F.md5(text).alias("digest")).distinct()
        pieces = split_items(rows, "id", text, keep=["digest"])
        core = F.substr("piece", F.col("core") - F.col("start") + 1)
        sound = (F.length("piece") <= 2000) & (F.col("core") - F.col("start") <= 200)
        each = pieces.select("id", "digest", sound.alias("sound"), F.struct("piece_no", F.regexp_replace(core, _WHITE, "").alias("c")).alias("p"))
        whole = each.groupBy("id", "digest").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["c"]), "")).alias("rebuilt"), F.min("sound").alias("sound"))
        parts.append(whole.withColumn("tbl", F.lit(name)))
    return parts[0].unionByName(parts[1])


_SQL["p5_rebuilt"] = rf"""
SELECT DISTINCT tbl, id, md5(x) AS digest, md5(regexp_replace(x, '{_WHITE}', '', 'g')) AS rebuilt, true AS sound
FROM (SELECT 'genereviews_sections' AS tbl, id, text AS x FROM genereviews_sections UNION ALL SELECT 'genereviews_chunks', id, chunk_text FROM genereviews_chunks) WHERE x IS NOT NULL
"""


@_query
def p6_found(spark, sf_dir):
    parts = []
    for name, key in (("variants", "variation_id"), ("nephrogenetics", "id")):
        rows = table(spark, sf_dir, name).select(F.col(key).cast("long").alias("id"), "embedding")
        pairs = neighbour_pairs(similar_neighbours(rows, "id", "embedding", k=5, min_cosine=0.95), "id")
        parts.append(pairs.select(F.lit(name).alias("tbl"), "id_a", "id_b"))
    return parts[0].unionByName(parts[1])


_SQL["p6_found"] = """
WITH v AS (
  SELECT 'variants' AS tbl, variation_id::BIGINT AS id, any_value(embedding)::DOUBLE[] AS e FROM variants
  WHERE list_sum(list_transform(embedding, lambda x: x * x)) > 0 GROUP BY variation_id
  UNION ALL
  SELECT 'nephrogenetics', id, any_value(embedding)::DOUBLE[] FROM nephrogenetics
  WHERE list_sum(list_transform(embedding, lambda x: x * x)) > 0 GROUP BY id),
p AS (SELECT a.tbl, a.id AS id, b.id AS other, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.tbl = b.tbl AND a.id <> b.id),
n AS (SELECT * FROM p WHERE c >= 0.95 QUALIFY row_number() OVER (PARTITION BY tbl, id ORDER BY c DESC, other) <= 5)
SELECT DISTINCT tbl, least(id, other) AS id_a, greatest(id, other) AS id_b FROM n
"""


@_query
def p6_knn(spark, sf_dir):
    """The 5 nearest records, whatever their distance, of every row whose id is divisible by 100."""
    parts = []
    for name, key in (("variants", "variation_id"), ("nephrogenetics", "id")):
        rows = table(spark, sf_dir, name).select(F.col("id").alias("row_id"), F.col(key).cast("long").alias("record"), "embedding")
        asked = rows.where(F.col("row_id") % 100 == 0).groupBy("row_id").agg(F.max("record").alias("own"), F.max("embedding").alias("qvec"))
        near = search_neighbours(rows, "record", "embedding", asked.withColumnRenamed("row_id", "query_id"), "query_id", "qvec", own="own")
        parts.append(near.select(F.lit(name).alias("tbl"), "query_id", F.col("record").alias("other"), F.round("cosine", 6).alias("cosine"), "place"))
    return parts[0].unionByName(parts[1])


@_query
def p6_recall(spark, sf_dir):
    """Whether p6_knn names at least nine of ten of the exact nearest records, by brute force over all rows."""
    near, parts = p6_knn(spark, sf_dir), []
    for name, key in (("variants", "variation_id"), ("nephrogenetics", "id")):
        rows = table(spark, sf_dir, name).select(F.col("id").alias("row_id"), F.col(key).cast("long").alias("record"), "embedding")
        asked = rows.where(F.col("row_id") % 100 == 0).groupBy("row_id").agg(F.max("record").alias("own"), F.max("embedding").alias("qvec")).withColumnRenamed("row_id", "query_id")
        one = clean_vectors(rows, "record", "embedding").groupBy("id").agg(F.max(F.struct("vkey", "v")).alias("x")).select(F.col("id").alias("other"), F.col("x.v").alias("v"))
        exact = vector_top_k(one, "other", "v", asked, "query_id", "qvec", 6).join(asked.select("query_id", "own"), "query_id").where("other <> own")
        exact = top_k(exact, 5, ["query_id"], [F.col("similarity").desc(), F.col("other")]).select("query_id", "other")
        hit = near.where(F.col("tbl") == name).select("query_id", "other", F.lit(1).alias("hit"))
        share = F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")
        parts.append(exact.join(hit, ["query_id", "other"], "left").agg(F.coalesce(share >= 0.9, F.lit(True)).alias("at_least_nine_tenths")).withColumn("tbl", F.lit(name)))
    return parts[0].unionByName(parts[1])


_SQL["p6_recall"] = "SELECT * FROM (VALUES ('variants', true), ('nephrogenetics', true)) t(tbl, at_least_nine_tenths)"


@_query
def p7_containers(spark, sf_dir):
    """Which document, or piece of one above 2,048 tokens, lies in which container."""
    return fill_containers(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"))


@_query
def p7_audit(spark, sf_dir):
    """For every document whether all of its tokens lie in as few pieces as they need, and its containers keep every capacity."""
    cap = Capacity()
    sizes = cut_lineage(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"))
    placed = cut_lineage(fill_containers(sizes, cap=cap))
    squares = F.sum(F.col("n_tokens") * F.col("n_tokens"))
    kept = placed.groupBy("container_id").agg(((F.sum("n_tokens") <= cap.tokens) & (F.count("*") <= cap.items) & (squares <= cap.attention)).alias("within"))
    of = placed.join(kept, "container_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.min("within").alias("within"))
    whole = (F.col("t") == F.col("n_tokens")) & (F.col("n") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / cap.tokens)))
    return sizes.join(of, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce("within", F.lit(False)).alias("within"))


_SQL["p7_audit"] = "SELECT doc_id, true AS whole, true AS within FROM documents"


@_query
def p8_mixture(spark, sf_dir):
    """Every document with its copies, and the share that its source reached."""
    sizes = token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["source"])
    return mix(sizes, table(spark, sf_dir, "mix_targets"))


@_query
def p8_shares(spark, sf_dir):
    """Target and reached share of every source."""
    return mixture_report(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@_query
def p8_audit(spark, sf_dir):
    """For every source its documents, its share of the weights, and whether its copies keep cap and target.

    The target is kept if the source's tokens miss it by less than its longest document, the one that rounding may leave over.
    """
    sizes = cut_lineage(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["source"]))
    targets = table(spark, sf_dir, "mix_targets")
    plan = plan_sources(sizes, targets).select("source", "target_share", (F.col("expected_copies") * F.col("size")).alias("wanted"))
    got = mix(sizes, targets).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("n_tokens").alias("longest"), F.max("copies").alias("most"))
    cap = targets.groupBy("source").agg(F.max("max_repeats").alias("cap"))
    joined = plan.join(got, "source", "left").join(cap, "source", "left")
    return joined.select(
        "source", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.round("target_share", 9).alias("target_share"),
        (F.coalesce("most", F.lit(0)) <= F.coalesce("cap", F.lit(0))).alias("within_cap"), (F.abs(F.coalesce("t", F.lit(0)) - F.col("wanted")) <= F.coalesce("longest", F.lit(0)) + 1e-6).alias("on_target"),
    )


_SQL["p8_audit"] = """
WITH s AS (SELECT source, count(*) AS n_docs, sum(length(text)) > 0 AS any_text FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT source, max(target_share) AS w FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
b AS (SELECT source, coalesce(n_docs, 0) AS n_docs, CASE WHEN any_text AND w > 0 THEN w ELSE 0 END AS w FROM s FULL JOIN t USING (source))
SELECT source, n_docs, round(w / sum(w) OVER (), 9) AS target_share, true AS within_cap, true AS on_target FROM b
"""


@_query
def p9_found(spark, sf_dir):
    return look_alike_pairs(table(spark, sf_dir, "documents"))


@_query
def p9_forms(spark, sf_dir):
    """Every document's consistent form and the class of documents that look the same."""
    return look_classes(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
