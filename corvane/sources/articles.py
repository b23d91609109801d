"""Articles in XML: files, folders and archives as tables of sections."""

from __future__ import annotations

import io
import re
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.parse import is_retired_title, section_type
from corvane.functions.text import token_estimate

SECTION_SCHEMA = "nbk_id string, shortname string, article_title string, section_id string, section_title string, section_path string, text string, depth int, position int"
#: Inline elements of which only the own text is kept.
_PLAIN = {"xref", "ext-link", "sup", "sub"}


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def table_text(table: ET.Element) -> str:
    """Rows as lines, cells parted by " | ", an empty cell as "-"."""
    rows = []
    for tr in (e for e in table.iter() if _tag(e) == "tr"):
        cells = [" ".join("".join(c.itertext()).split()) or "-" for c in tr if _tag(c) in ("td", "th")]
        if cells:
            rows.append(" | ".join(cells))
    return "\n".join(rows)


def element_text(e: ET.Element, skip: tuple[str, ...] = ("sec", "title", "label")) -> str:
    """Readable text: paragraphs parted by blank lines, list items with a bullet, tables as rows; nested sections left out."""
    out: list[str] = []

    def walk(x: ET.Element) -> None:
        for c in x:
            t = _tag(c)
            if t in skip:
                pass
            elif t in ("table-wrap", "table"):
                out.append("\n" + table_text(c) + "\n")
            elif t == "list-item":
                out.append("\n• ")
                out.append(" ".join("".join(c.itertext()).split()))
            elif t in _PLAIN:
                out.append(c.text or "")
            elif t in ("p", "list", "disp-quote", "boxed-text"):
                out.append("\n\n" + (c.text or "").strip("\n"))
                walk(c)
                out.append("\n")
            else:
                out.append(c.text or "")
                walk(c)
            out.append(c.tail or "")

    out.append(e.text or "")
    walk(e)
    text = re.sub(r"[ \t]+", " ", "".join(out))
    text = re.sub(r" ?\n ?", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def parse_article(data: bytes, name: str = "", min_chars: int = 50) -> list[dict]:
    """The sections of an article, a section before those nested in it; only those of more than `min_chars` characters.

    A file that is no well-formed XML has no sections.
    """
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return []
    ids = {(e.get("book-id-type") or e.get("pub-id-type") or "").lower(): "".join(e.itertext()).strip() for e in root.iter() if _tag(e) in ("book-id", "book-part-id", "article-id")}
    nbk = next((v for v in ids.values() if v.startswith("NBK")), "")
    short = re.sub(r"\.n?xml$", "", name.rsplit("/", 1)[-1])
    wanted = [e for e in root.iter() if _tag(e) in ("article-title", "book-title")] or [e for e in root.iter() if _tag(e) == "title"]
    title = " ".join("".join(wanted[0].itertext()).split()) if wanted else ""
    body = next((e for e in root.iter() if _tag(e) in ("body", "book-body")), root)
    out: list[dict] = []

    def section(e: ET.Element, path: tuple[str, ...]) -> None:
        head = next((c for c in e if _tag(c) == "title"), None)
        own = " ".join("".join(head.itertext()).split()) if head is not None else ""
        here = (*path, own) if own else path
        text = element_text(e)
        if len(text) > min_chars:
            out.append(
                {"nbk_id": nbk, "shortname": short, "article_title": title, "section_id": e.get("id", ""), "section_title": own, "section_path": " > ".join(here), "text": text, "depth": len(path), "position": len(out)}
            )
        for c in e:
            if _tag(c) == "sec":
                section(c, here)

    for c in body:
        if _tag(c) == "sec":
            section(c, ())
    return out


def _sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SECTION_SCHEMA.split(", ")]
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            rows = parse_article(bytes(content), path)
            if rows:
                yield pd.DataFrame(rows, columns=names)


def describe(sections: DataFrame) -> DataFrame:
    """Sections with their type, counts, and whether the article is retired."""
    return sections.withColumns({
        "section_type": section_type("section_id"),
        "char_count": F.length("text"),
        "token_estimate": token_estimate("text"),
        "retired": is_retired_title("article_title"),
    })


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Sections of every *.nxml file of a folder, or of one file; each file is read by the task it falls to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nxml").load(path)
    return describe(files.select("path", "content").mapInPandas(_sections, SECTION_SCHEMA))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Sections of the *.nxml members of .tar.gz archives. An archive is one task; its articles are spread before parsing."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tarfile.open(fileobj=io.BytesIO(bytes(content)), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(".nxml"):
                            yield pd.DataFrame({"path": [m.name], "content": [tar.extractfile(m).read()]})

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path)
    files = archives.select("content").mapInPandas(members, "path string, content binary").repartition("path")
    return describe(files.mapInPandas(_sections, SECTION_SCHEMA))


def sections_of_text(df: DataFrame, name_col: str, xml_col: str) -> DataFrame:
    """Sections of articles that are held as text in a column."""
    rows = df.select(F.col(name_col).cast("string").alias("path"), F.encode(xml_col, "utf-8").alias("content"))
    return describe(rows.mapInPandas(_sections, SECTION_SCHEMA))


def with_metadata(sections: DataFrame, metadata: DataFrame) -> DataFrame:
    """Sections with their article's genes and condition; an article without metadata keeps its title as condition."""
    m = metadata.select("shortname", "gene_symbols", "condition_name", F.col("nbk_id").alias("_nbk"))
    joined = sections.join(m, "shortname", "left")
    return joined.withColumns({
        "condition_name": F.coalesce("condition_name", "article_title"),
        "nbk_id": F.coalesce(F.nullif("nbk_id", F.lit("")), "_nbk"),
        "gene_symbols": F.coalesce("gene_symbols", F.array().cast("array<string>")),
    }).drop("_nbk")
