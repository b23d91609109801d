"""Sources of records: tab-separated summaries, pipe-separated metadata, spreadsheets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.parse import phenotype_list, variant_document

#: Columns that are read from a variant summary; all others are left in the file.
SUMMARY_COLUMNS = ("Assembly", "ClinicalSignificance", "VariationID", "GeneSymbol", "Name", "ReviewStatus", "PhenotypeList")
FIRM = ("Pathogenic", "Likely pathogenic", "Pathogenic/Likely pathogenic")


def read_variant_summary(spark: SparkSession, path: str, limit: int | None = None, all_significance: bool = False, genes: Sequence[str] | None = None, assembly: str = "GRCh38", significances: Sequence[str] = FIRM) -> DataFrame:
    """Typed variants of a (gzipped) tab-separated summary, with the document that is searched.

    Rows of another assembly, of another significance (by part, in the case written, unless `all_significance`), without an
    integer id, without gene ("-" is none) or without name are left out. `limit` keeps the first rows in the order of the file.
    Fields in quotes may hold tabs and line breaks, so a file is read by one task, gzipped or not; its rows are spread over all
    cores before anything is done with them.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True).select(*SUMMARY_COLUMNS)
    if limit is not None:
        raw = raw.withColumn("_at", F.monotonically_increasing_id())
    raw = raw.repartition(spark.sparkContext.defaultParallelism)
    gene, name = F.trim("GeneSymbol"), F.trim("Name")
    keep = (F.col("Assembly") == assembly) & gene.isNotNull() & ~gene.isin("", "-") & (F.coalesce(name, F.lit("")) != "")
    if not all_significance:
        hit = F.lit(False)
        for s in significances:
            hit = hit | F.col("ClinicalSignificance").contains(s)
        keep = keep & hit
    if genes:
        keep = keep & F.upper(gene).isin([g.upper() for g in genes])
    rows = raw.where(keep).select(
        F.expr("try_cast(trim(VariationID) AS INT)").alias("variation_id"),
        name.alias("name"),
        gene.alias("gene"),
        F.coalesce("ClinicalSignificance", F.lit("")).alias("clinical_significance"),
        F.coalesce("ReviewStatus", F.lit("")).alias("review_status"),
        phenotype_list(F.coalesce("PhenotypeList", F.lit(""))).alias("phenotypes"),
        *([F.col("_at")] if limit is not None else []),
    )
    rows = rows.where("variation_id IS NOT NULL")
    rows = rows.withColumn("document", variant_document("gene", "name", "clinical_significance", "review_status", "phenotypes"))
    return rows.orderBy("_at").limit(limit).drop("_at") if limit is not None else rows


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(shortname, nbk_id, gene_symbols, condition_name), one row per shortname of a pipe-separated file.

    Blank lines, lines that start with # and lines of fewer than four fields are skipped. The first line of a shortname gives
    its id and condition; genes are gathered in order, each once, and "Not applicable" is none. The order is that of lines
    within the file; metadata fits one.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    parts = F.transform(F.split(F.trim("value"), r"\|"), lambda x: F.trim(x))
    rows = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).select("_at", parts.alias("p")).where(F.size("p") >= 4)
    rows = rows.select("_at", F.get("p", F.lit(0)).alias("shortname"), F.get("p", F.lit(1)).alias("nbk_id"), F.get("p", F.lit(2)).alias("gene"), F.get("p", F.lit(3)).alias("condition_name"))
    return fold_metadata(rows, "_at")


def fold_metadata(rows: DataFrame, order: str) -> DataFrame:
    """First id and condition, ordered distinct genes of each shortname."""
    genes = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("gene").alias("g")))), lambda x: x["g"])
    named = F.filter(genes, lambda g: g.isNotNull() & (g != "") & (F.lower(g) != "not applicable"))
    return rows.groupBy("shortname").agg(
        F.min_by("nbk_id", order).alias("nbk_id"), F.array_distinct(named).alias("gene_symbols"), F.min_by("condition_name", order).alias("condition_name")
    )


def read_gene_index(spark: SparkSession, path: str) -> DataFrame:
    """(gene, shortname, nbk_id, disease): lines of exactly four fields, "Not applicable" left out, genes in upper case."""
    parts = F.transform(F.split(F.trim("value"), r"\|"), lambda x: F.trim(x))
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 4)
    rows = rows.select(F.upper(F.get("p", F.lit(2))).alias("gene"), F.get("p", F.lit(0)).alias("shortname"), F.get("p", F.lit(1)).alias("nbk_id"), F.get("p", F.lit(3)).alias("disease"))
    return rows.where((F.col("gene") != "") & (F.col("gene") != "NOT APPLICABLE"))


# The columns of the gene sheet by position, and those of its organ systems (first and last).
SHEET_FIELDS = {"gene_symbol": 0, "panel_categories": 1, "omim_phenotype_id": 4, "omim_gene_id": 5, "title": 6, "inheritance": 7, "kidney_manifestations": 9}
SHEET_SYSTEMS = {
    "height": (10, 10), "weight": (11, 11), "face": (14, 14), "ears": (15, 15), "eyes": (16, 16), "nose": (17, 17), "mouth": (18, 18), "teeth": (19, 19), "neck": (20, 20),
    "heart": (21, 21), "vascular": (22, 22), "respiratory": (24, 27), "liver": (34, 34), "pancreas": (35, 35), "gastrointestinal": (38, 38), "genitourinary": (40, 45),
    "skull": (47, 47), "spine": (48, 48), "limbs": (50, 50), "hands": (51, 51), "feet": (52, 52), "skin": (53, 53), "nails": (56, 56), "hair": (57, 57), "muscle": (58, 58),
    "cns": (60, 60), "peripheral_nervous": (61, 61), "behavioral": (62, 62), "metabolic": (64, 64), "endocrine": (65, 65), "hematology": (66, 66), "immunology": (67, 67),
    "neoplasia": (68, 68),
}


def sheet_table(spark: SparkSession, source: str | pd.DataFrame, header: int = 4, fields: dict[str, int] = SHEET_FIELDS, systems: dict[str, tuple[int, int]] = SHEET_SYSTEMS) -> DataFrame:
    """(*fields, extrarenal_manifestations, document) of a sheet read by position.

    `source` is a table in memory, or the path of a CSV file or workbook (a workbook needs its reader installed). `fields` names
    columns, `systems` column ranges, both ends included, whose non-empty cells are joined by "; "; columns that the sheet does not
    have are empty. Rows without gene_symbol are left out. Sheets hold hundreds of rows and are read on the driver.
    """
    if isinstance(source, str):
        source = pd.read_csv(source, header=header, dtype=str) if source.lower().endswith((".csv", ".tsv")) else pd.read_excel(source, header=header, dtype=str)
    sheet = source.astype(object).where(source.notna(), None)
    width = sheet.shape[1]
    sheet.columns = [f"c{i}" for i in range(width)]
    raw = spark.createDataFrame(sheet, ", ".join(f"c{i} string" for i in range(width)))
    cell = lambda i: F.nullif(F.trim(f"c{i}"), F.lit("")) if i < width else F.lit(None).cast("string")
    pairs = [x for name, (a, b) in systems.items() for x in (F.lit(name), F.concat_ws("; ", *[cell(i) for i in range(a, b + 1)]))]
    shown = F.map_filter(F.create_map(*pairs), lambda k, v: v != "") if pairs else F.create_map().cast("map<string,string>")
    rows = raw.select(*[cell(i).alias(name) for name, i in fields.items()], shown.alias("extrarenal_manifestations")).where("gene_symbol IS NOT NULL")
    listed = F.array_join(F.transform(F.map_entries("extrarenal_manifestations"), lambda e: F.concat(F.initcap(F.regexp_replace(e["key"], "_", " ")), F.lit(": "), e["value"])), "; ")
    labels = (("Gene: ", "gene_symbol"), ("Condition: ", "title"), ("Inheritance: ", "inheritance"), ("Kidney manifestations: ", "kidney_manifestations"))
    said = [F.concat(F.lit(label), F.col(c)) for label, c in labels if c in fields]
    return rows.withColumn("document", F.concat_ws(" ", *said, F.concat(F.lit("Extrarenal manifestations: "), F.nullif(listed, F.lit("")))))
