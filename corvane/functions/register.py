"""The functions in SQL: `register(spark)` makes them callable in statements of a session.

All but the table functions are SQL expressions, so the optimizer sees through them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.functions.cite import NO_EVIDENCE, UNKNOWN_SOURCES
from corvane.functions.text import REFERENCES_HEADING, chunk_sentences

_WORDS = r"filter(split(lower(t), '[^\\p{L}\\p{N}]+'), w -> w <> '')"
_PART = r"r'(?is)^(source:\s*)([^\n]*)(.*)$'"
_MADE_UP = "exists(array(" + ", ".join(f"'{u}'" for u in UNKNOWN_SOURCES) + "), u -> contains(lower(e), u))"
_KEPT = f"array_join(filter(transform(split(regexp_extract(x, {_PART}, 2), ';'), e -> trim(e)), e -> e <> '' AND NOT {_MADE_UP}), '; ')"
_SQL = {
    "sanitise_source_line": (
        "t STRING",
        "STRING",
        f"regexp_replace(regexp_replace(array_join(transform(split(t, '(?i)(?=source:)'), x -> CASE WHEN regexp_extract(x, {_PART}, 1) = '' OR regexp_extract(x, {_PART}, 2) = '' THEN x"
        f" ELSE concat(CASE WHEN {_KEPT} <> '' THEN concat(regexp_extract(x, {_PART}, 1), {_KEPT}) ELSE '' END, regexp_extract(x, {_PART}, 3)) END), ''), r'[ \t]{{2,}}', ' '), r'(?m)[ \t]+$', '')",
    ),
    "answer_body": ("t STRING", "STRING", rf"regexp_replace(regexp_replace(sanitise_source_line(t), r'(?is){REFERENCES_HEADING}.*$', ''), r'\s+$', '')"),
    "used_citations": (
        "t STRING, c ARRAY<STRUCT<number INT, title STRING, url STRING>>",
        "ARRAY<STRUCT<number INT, title STRING, url STRING>>",
        r"filter(c, x -> array_contains(transform(regexp_extract_all(t, r'\[(\d{1,9})\]', 1), n -> int(n)), x.number))",
    ),
    "postprocess_citations": (
        "t STRING, c ARRAY<STRUCT<number INT, title STRING, url STRING>>",
        "STRING",
        f"CASE WHEN coalesce(size(c), 0) <= 0 THEN sanitise_source_line(t) WHEN answer_body(t) RLIKE r'(?iu){NO_EVIDENCE}' OR size(used_citations(answer_body(t), c)) = 0 THEN answer_body(t) ELSE concat("
        r"aggregate(filter(used_citations(answer_body(t), c), x -> coalesce(x.url, '') <> ''), answer_body(t), (acc, x) -> regexp_replace(acc, concat(r'(?<!\[)\[', x.number, r'\](?:\([^)]*\))?'), concat('[[', x.number, ']](', regexp_replace(x.url, r'([\\$])', r'\\$1'), ')'))),"
        " '\n\n---\n**References:**\n', array_join(transform(used_citations(answer_body(t), c), x -> concat('- [', x.number, '] ', CASE WHEN coalesce(x.url, '') <> '' THEN concat('[', x.title, '](', x.url, ')') ELSE x.title END)), '\n')) END",
    ),
    "trigrams": ("t STRING", "ARRAY<STRING>", f"array_distinct(flatten(transform({_WORDS}, w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"),
    "trigram_similarity": (
        "a STRING, b STRING",
        "DOUBLE",
        "coalesce(size(array_intersect(trigrams(a), trigrams(b))) / nullif(size(array_union(trigrams(a), trigrams(b))), 0), 0.0D)",
    ),
    "cosine_similarity": (
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
        "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0.0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0.0D, (s, x) -> s + double(x) * double(x)))"
        " * sqrt(aggregate(b, 0.0D, (s, x) -> s + double(x) * double(x))), 0.0D)",
    ),
    "significance_tier": (
        "s STRING",
        "STRING",
        "CASE WHEN contains(lower(s), 'conflicting') THEN 'conflicting' WHEN contains(lower(s), 'uncertain') THEN 'uncertain' WHEN contains(lower(s), 'pathogenic') THEN 'pathogenic'"
        " WHEN contains(lower(s), 'benign') THEN 'benign' ELSE 'other' END",
    ),
    "hgvs_forms": (
        "c STRING",
        "ARRAY<STRING>",
        r"CASE WHEN c RLIKE '(?i)(?<![a-z])(del|dup)[ACGT]+$' THEN array_distinct(array(c, concat(regexp_extract(c, '(?i)^(.*?)(del|dup)[ACGT]+$', 1), lower(regexp_extract(c, '(?i)^(.*?)(del|dup)[ACGT]+$', 2))))) ELSE array(c) END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in `spark` and return their names."""
    for name, (args, kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")

    from corvane.sources.articles import SECTION_SCHEMA, parse_article

    names = [c.split()[0] for c in SECTION_SCHEMA.split(", ")]

    @F.udtf(returnType=SECTION_SCHEMA)
    class NxmlSections:
        def eval(self, xml: str, name: str) -> Iterator[tuple]:
            for row in parse_article((xml or "").encode(), name or ""):
                yield tuple(row[c] for c in names)

    @F.udtf(returnType="chunk_index int, chunk string")
    class TextChunks:
        def eval(self, text: str) -> Iterator[tuple]:
            yield from enumerate(chunk_sentences(text))

    spark.udtf.register("nxml_sections", NxmlSections)
    spark.udtf.register("text_chunks", TextChunks)
    return [*_SQL, "nxml_sections", "text_chunks"]
