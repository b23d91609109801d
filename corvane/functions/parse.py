"""Parsing and normalising text: variant tokens, gene symbols, classification, titles, links, documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of variant tokens. The order of alternatives matters: "del" before "delins", short before long.
NUCLEOTIDE = r"(?i)(?<![A-Za-z0-9])([cgmn]\.\s*[0-9][0-9_+\-*]*(?:[ACGT]+)?(?:(?:>|&gt;)[ACGT]+|del[ACGT]*|dup[ACGT]*|ins[ACGT]+|delins[ACGT]+)?)"
PROTEIN = r"(?i)(?<![A-Za-z0-9])(p\.\(?[A-Z][a-z]{0,2}[0-9]+(?:[A-Z][a-z]{0,2}|=|\*|Ter|fs(?:Ter)?[0-9]*|del|dup)?\)?)"
# A word ends at what is no letter, number or underscore of any script; \b and \s may know ASCII only.
_HEAD, _TAIL, _GAP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])", r"[\s\p{Z}\x1c-\x1f\x85]+"
TRANSCRIPT = rf"{_HEAD}([NX][MRCG]_[0-9]+\.[0-9]+){_TAIL}"
RSID = rf"(?i){_HEAD}(rs[0-9]+){_TAIL}"
GENE = rf"{_HEAD}([A-Z][A-Z0-9]{{1,9}}){_TAIL}"
CUED_EITHER = rf"(?i){_HEAD}(?:(?:gene|variant|mutation|allele)s?{_GAP}(?:in{_GAP}|of{_GAP})?([A-Za-z][A-Za-z0-9]{{1,9}})|([A-Za-z][A-Za-z0-9]{{1,9}}){_GAP}gene){_TAIL}"
# Upper-case words that are no genes.
NOT_GENES = (
    "THE AND FOR ARE BUT NOT YOU ALL CAN HER WAS ONE OUR OUT HAS HIS HOW ITS MAY NEW NOW OLD SEE WAY WHO DID GET HIM LET SAY SHE TOO USE "
    "DNA RNA VUS WHAT WHICH WITH FROM HAVE THIS THAT THEY BEEN RISK TYPE GENE DOES MOST RARE ALSO MORE THAN INTO SOME"
).split()
# Terms that route a question.
RENAL_TERMS = ("kidney", "renal", "nephro", "nephrotic", "nephritic", "glomerul", "tubul", "polycystic", "pkd", "alport", "fabry", "iga nephropathy", "fsgs", "cakut", "ckd", "dialysis", "transplant")
CLINICAL_TERMS = (
    "gene variant mutation allele phenotype syndrome disease disorder inherit heredit pathogen benign clinvar omim acmg vus genotype carrier homozyg heterozyg autosomal x-linked recessive "
    "dominant diagnos screen panel exome genome sequenc"
).split()
# Section names and their types, in the order in which they are tried.
SECTION_TYPES = (
    ("diagnosis", "diagnosis"),
    ("suggestive_findings", "diagnosis"),
    ("establishing_the_diagnosis", "diagnosis"),
    ("clinical_characteristics", "clinical_features"),
    ("clinical_description", "clinical_features"),
    ("phenotype", "clinical_features"),
    ("genotype", "genetics"),
    ("genotypephenotype", "genetics"),
    ("penetrance", "genetics"),
    ("prevalence", "epidemiology"),
    ("management", "management"),
    ("treatment", "management"),
    ("surveillance", "surveillance"),
    ("prevention", "prevention"),
    ("genetic_counseling", "genetic_counseling"),
    ("differential_diagnosis", "differential_diagnosis"),
    ("molecular_genetics", "molecular_genetics"),
    ("resources", "resources"),
    ("references", "references"),
    ("nomenclature", "other"),
)
# Review statuses and their ranks, best first; any other status has rank 8.
REVIEW_RANKS = {
    "practice guideline": 0,
    "reviewed by expert panel": 1,
    "criteria provided, multiple submitters, no conflicts": 2,
    "criteria provided, single submitter": 3,
    "criteria provided, conflicting classifications": 4,
    "criteria provided, conflicting interpretations": 4,
    "no assertion criteria provided": 5,
    "no assertion for the individual variant": 6,
    "no classification provided": 7,
}
# Notes that a document carries for a classification that is not firm.
TIER_NOTES = {
    "conflicting": "NOTE: submitters DISAGREE on this classification (conflicting). Report the disagreement; do not resolve it.",
    "uncertain": "NOTE: UNCERTAIN significance (VUS) - this is NOT an established pathogenic or benign classification.",
}
RETIRED_TITLE = r"(?i)retired chapter|for historical reference only"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first(c: Column | str, pattern: str) -> Column:
    """The first match's first group, null if there is none."""
    found = F.regexp_extract(_col(c), pattern, 1)
    return F.when(found != "", found)


def contains_any(c: Column | str, terms: Sequence[str]) -> Column:
    """Whether any term is part of the text, as written; null text gives null."""
    c = _col(c)
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms]) if terms else c.isNull() & F.lit(False)


def nucleotide_form(token: Column) -> Column:
    """A nucleotide token as prefix, position, bases and event: the prefix and event words small, the bases large, no blanks."""
    t = F.regexp_replace(F.regexp_replace(token, "&gt;", ">"), r"\s+", "")
    # Parts between event words are positions and bases; the words themselves are what lies between the parts.
    event = "(?i)(delins|del|dup|ins)"
    bases = F.transform(F.split(F.substring(t, 2, 1_000_000), event), F.upper)
    events = F.transform(F.regexp_extract_all(t, F.lit(event), F.lit(1)), F.lower)
    pairs = F.zip_with(bases, events, lambda x, e: F.concat(x, F.coalesce(e, F.lit(""))))
    return F.concat(F.lower(F.substring(t, 1, 1)), F.array_join(pairs, ""))


def protein_form(token: Column) -> Column:
    """A protein token without blanks and parentheses, its letters as written but for the prefix."""
    t = F.regexp_replace(F.regexp_replace(token, r"[\s()]+", ""), "&gt;", ">")
    return F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))


def variant_tokens(text: Column | str) -> Column:
    """Struct of c_hgvs, p_hgvs, transcript, rsid, gene, has_variant_token and raw_tokens; missing parts are null.

    raw_tokens are the first nucleotide token, of any type, and the first protein token, as written.
    Only a first nucleotide token of type c counts as c_hgvs; gene is the first upper-case token that is not a stop word.
    """
    text = _col(text)
    token = _first(text, NUCLEOTIDE)
    c = F.when(F.lower(F.substring(token, 1, 1)) == "c", nucleotide_form(token))
    protein = _first(text, PROTEIN)
    p = protein_form(protein)
    rs = F.lower(_first(text, RSID))
    genes = F.filter(F.regexp_extract_all(text, F.lit(GENE), 1), lambda g: ~g.isin(NOT_GENES))
    return F.struct(
        c.alias("c_hgvs"),
        p.alias("p_hgvs"),
        _first(text, TRANSCRIPT).alias("transcript"),
        rs.alias("rsid"),
        F.get(genes, F.lit(0)).alias("gene"),
        (c.isNotNull() | p.isNotNull() | rs.isNotNull()).alias("has_variant_token"),
        F.array_compact(F.array(token, protein)).alias("raw_tokens"),
    )


def hgvs_forms(c: Column | str) -> Column:
    """The token, and without the bases that a trailing deletion or duplication names; compound events keep one form."""
    c = _col(c)
    simple = c.rlike(r"(?i)(?<![a-z])(del|dup)[ACGT]+$")
    bare = F.regexp_replace(c, r"(?i)(?<![a-z])(del|dup)[ACGT]+$", "$1")
    event = F.lower(F.substring(bare, -3, 3))
    lowered = F.concat(F.substring(bare, F.lit(1), F.length(bare) - 3), event)
    return F.when(simple, F.array_distinct(F.array(c, lowered))).otherwise(F.array(c))


def gene_symbols(text: Column | str, stop_words: Sequence[str] = tuple(NOT_GENES)) -> Column:
    """Upper-case tokens, then tokens of any case beside a cue word, in upper case, without stop words, each once."""
    text = _col(text)
    cued = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(CUED_EITHER), 1).alias("a"), F.regexp_extract_all(text, F.lit(CUED_EITHER), 2).alias("b")),
        lambda x: F.upper(F.when(x["a"] != "", x["a"]).otherwise(x["b"])),
    )
    every = F.concat(F.regexp_extract_all(text, F.lit(GENE), 1), cued)
    return F.array_distinct(F.filter(every, lambda g: ~g.isin(list(stop_words)) & (F.length(g) >= 2)))


def has_renal_terms(text: Column | str, terms: Sequence[str] = RENAL_TERMS) -> Column:
    return contains_any(F.lower(_col(text)), terms)


def has_clinical_signal(text: Column | str, terms: Sequence[str] = tuple(CLINICAL_TERMS)) -> Column:
    text = _col(text)
    return text.rlike(rf"{_HEAD}[cpgmn]\.[0-9]") | (F.size(gene_symbols(text)) > 0) | contains_any(F.lower(text), terms) | has_renal_terms(text)


# Fixed value: what makes a question one on a variant if it names no gene.
VARIANT_NOTATION = rf"{_HEAD}[cpgmn]\.[0-9]"


def query_type(text: Column | str) -> Column:
    """'non-clinical', 'variant' (a gene or a position in variant notation) or 'phenotype'."""
    text = _col(text)
    specific = (F.size(gene_symbols(text)) > 0) | text.rlike(VARIANT_NOTATION)
    return F.when(~has_clinical_signal(text), "non-clinical").when(specific, "variant").otherwise("phenotype")


def significance_tier(significance: Column | str) -> Column:
    s = F.lower(_col(significance))
    tier = F.when(s.contains("conflicting"), "conflicting").when(s.contains("uncertain"), "uncertain")
    return tier.when(s.contains("pathogenic"), "pathogenic").when(s.contains("benign"), "benign").otherwise("other")


def review_rank(status: Column | str) -> Column:
    """Rank of a review status, best first; unknown and null last."""
    ranks = F.create_map(*[F.lit(x) for pair in REVIEW_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, _col(status)), F.lit(8))


def phenotype_list(text: Column | str, sep: str = ";", drop: Sequence[str] = ("not provided",)) -> Column:
    """Trimmed, non-empty parts of a delimited list, without those in `drop`, whatever their case."""
    parts = F.transform(F.split(_col(text), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & ~F.lower(x).isin(list(drop)))


def variant_document(gene, name, significance, review, phenotypes, missing: str = "Not specified") -> Column:
    """The text that is embedded and searched for a variant: a sentence per field, up to five conditions, and a note."""
    listed = F.array_join(F.slice(_col(phenotypes), 1, 5), "; ")
    shown = F.coalesce(F.nullif(listed, F.lit("")), F.lit(missing))
    tier = significance_tier(significance)
    note = reduce(lambda w, kv: w.when(tier == kv[0], F.lit(" " + kv[1])), list(TIER_NOTES.items())[1:], F.when(tier == list(TIER_NOTES)[0], F.lit(" " + TIER_NOTES[list(TIER_NOTES)[0]])))
    fields = (("Gene: ", gene), (". Variant: ", name), (". Clinical significance: ", significance), (". Review status: ", review))
    body = F.concat(*[x for label, c in fields for x in (F.lit(label), F.coalesce(_col(c), F.lit("")))], F.lit(". Associated conditions: "), shown, F.lit("."))
    return F.concat(body, F.coalesce(note, F.lit("")))


def section_type(section_id: Column | str, types: Sequence[tuple[str, str]] = SECTION_TYPES) -> Column:
    """Type of a section by the first name, in order, that is part of its id after the first dot."""
    s = _col(section_id)
    name = F.lower(F.when(s.contains("."), F.regexp_replace(s, r"^[^.]*\.", "")).otherwise(s))
    name = F.regexp_replace(F.regexp_replace(name, r"[_\d]+", "_"), "^_+|_+$", "")
    chain = F.when(name.contains(types[0][0]), types[0][1])
    for key, kind in types[1:]:
        chain = chain.when(name.contains(key), kind)
    return chain.otherwise("other")


def is_retired_title(title: Column | str) -> Column:
    return F.coalesce(_col(title).rlike(RETIRED_TITLE), F.lit(False))


def article_url(nbk_id: Column | str, base: str = "https://www.ncbi.nlm.nih.gov/books/", landing: str = "https://www.ncbi.nlm.nih.gov/books/NBK1116/") -> Column:
    """Link to an article whose id is well-formed, else to the landing page."""
    c = _col(nbk_id)
    return F.when(c.rlike(r"^NBK\d+$"), F.concat(F.lit(base), c, F.lit("/"))).otherwise(landing)


def gnomad_id(name: Column | str) -> Column:
    """chrom-pos-ref-alt of a chromosomal single-base change; null for anything else."""
    pattern = r"NC_0000(\d\d)\.\d+:g\.(\d+)([ACGT])>([ACGT])"
    c = _col(name)
    number = F.regexp_replace(F.regexp_extract(c, pattern, 1), "^0+", "")
    chrom = F.when(number == "23", "X").when(number == "24", "Y").when(number == "", "0").otherwise(number)
    return F.when(c.rlike(pattern), F.concat_ws("-", chrom, *[F.regexp_extract(c, pattern, i) for i in (2, 3, 4)]))


def is_identifier(name: str) -> bool:
    """Whether a table name is safe in a statement."""
    return bool(name) and all(ch.isascii() and (ch.isalnum() or ch == "_") for ch in name)


# What switches a setting on.
def is_on(setting: Column | str) -> Column:
    """Whether a setting is switched on, in any case and with blanks around it; null is off."""
    return F.coalesce(F.lower(F.trim(_col(setting))).isin("1", "true", "yes", "on"), F.lit(False))
