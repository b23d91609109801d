"""One consistent form for texts that look the same.

The skeleton of a text: canonical decomposition, every character replaced by the prototype it looks like, canonical
decomposition again. Texts look the same if their skeletons are equal. Prototypes come from the confusables data of the
Unicode consortium, as the ICU library that Spark brings along holds them, for every assigned character; before them go the
rules of Unicode's own properties on width, breaking, fonts and characters that are not drawn.

Two ASCII characters never become one: a reader tells I, l, 1 and |, O and 0, or m and rn apart where it matters, and texts that
differ in a visible letter or digit are different texts. A character of another script that the data puts into such a group goes to
the member of its own kind: a capital to I or O, a digit to 1 or 0, any other to l.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import broadcast_if_small, cut_lineage, spread

#: Compatibility forms that differ from their plain character in width, breaking or font only. Superscripts, fractions and
#: the like differ visibly and stay.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>"}


# Characters that the data lists, for the sake of identifiers, beside one they differ from visibly in running text
# (alpha, beta, gamma, ligatures that are letters, dashes of other lengths), and two that it does not list with their twin.
VISIBLE = set("αβγœŒæÆ–—―−‒")
TWINS = {"Ԛ": "Q", "ӏ": "l"}


def _own_rule(ch: str) -> str | None:
    """What `ch` is drawn as by its Unicode properties, if that is something else; '' for what is not drawn at all."""
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if kind == "Zs" or ch == "\t":
        return " " if ch != " " else None
    tag = unicodedata.decomposition(ch).split(" ")[0]
    if tag in _SAME_LOOK or "ﬀ" <= ch <= "ﬆ" or ch == "µ":
        return unicodedata.normalize("NFKD", ch)
    return None


def _resolved(ch: str, prototype: str) -> str:
    """The prototype of `ch`, where the data's groups hold several ASCII characters the one of its own kind."""
    if ch in TWINS:
        return TWINS[ch]
    if ch in VISIBLE or unicodedata.category(ch)[0] == "M":
        return ch  # an accent is never another one
    plain = unicodedata.normalize("NFKD", ch)
    if len(plain) == 1 and plain.isascii() and prototype in ("l", "O", "rn"):
        return plain
    if prototype == "l":
        return {"Lu": "I", "Nd": "1"}.get(unicodedata.category(ch), "|" if unicodedata.category(ch)[0] == "S" else "l")
    if prototype == "O":
        return "0" if unicodedata.category(ch) == "Nd" else "O"
    # m and the double quote are ASCII; the data writes them as two characters.
    return prototype.replace("rn", "m").replace("''", '"')


_TABLES: dict[str, dict[int, str]] = {}


def look_alikes(spark: SparkSession) -> dict[int, str]:
    """Code point to prototype, for every code point that has one: some 17,000, whatever the data."""
    key = spark.sparkContext.applicationId
    if key not in _TABLES:
        chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
        # One call for all characters; a line break is its own prototype.
        checker = getattr(spark._jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
        shown = checker.getSkeleton(0, "\n".join(chars)).split("\n")
        if len(shown) != len(chars):
            raise RuntimeError("the confusables data maps a character to a line break")
        raw = {9: " "}
        for ch, prototype in zip(chars, shown):
            own = _own_rule(ch)
            raw[ord(ch)] = own if own is not None else _resolved(ch, prototype)
        # The image of a character may have a prototype itself (a wide letter of another script): followed to the end, so that
        # one pass over a text is enough.
        table = {}
        for cp, image in raw.items():
            for _ in range(8):
                then = unicodedata.normalize("NFD", unicodedata.normalize("NFD", image).translate(raw))
                if then == image:
                    break
                image = then
            if image != unicodedata.normalize("NFD", chr(cp)):
                table[cp] = image
        table[ord("\t")] = " "
        _TABLES.clear()
        _TABLES[key] = table
    return _TABLES[key]


def skeleton(text: str | None, table: dict[int, str]) -> str | None:
    """The common form of all texts that look like `text`; null stays null, white space at the ends is kept."""
    if text is None:
        return None
    if text.isascii():
        return text.replace("\t", " ")
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def readable_form(text: str | None, table: dict[int, str]) -> str | None:
    """The skeleton with its accents composed again: the form to store and to compare."""
    s = skeleton(text, table)
    return None if s is None else unicodedata.normalize("NFC", s)


def add_forms(df: DataFrame, id_col: str, text_col: str, with_form: bool = False) -> DataFrame:
    """(id, same, look[, form]): digests of the text as it is and of its skeleton; one row per row of `df`.

    A null text has null digests. A text that is blank once the skeleton is taken has a null `look`: it looks like nothing
    and belongs to no group. Digests are 128 bits, so that long texts are not shuffled.
    """

    # Of fixed size, set by Unicode and not by the data.
    shared = df.sparkSession.sparkContext.broadcast(look_alikes(df.sparkSession))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            skel = [skeleton(t, table) for t in texts]
            out = {
                "id": b["id"],
                "same": [None if t is None else md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts],
                "look": [None if not s or s.isspace() else md5(s.encode("utf-8", "surrogatepass")).digest() for s in skel],
            }
            if with_form:
                out["form"] = [None if s is None else unicodedata.normalize("NFC", s) for s in skel]
            yield pd.DataFrame(out)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, same binary, look binary" + (", form string" if with_form else "")
    return spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInPandas(forms, schema)


#: Members of a group that meet one another in one task.
BLOCK = 2_000


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents whose texts look the same but are not the same characters.

    Texts that are null or blank take no part; equal texts are no pair, and rows that repeat an id count once. Grouping is
    by skeleton; only groups that hold at least two different texts are paired, and within them only documents of different
    texts: copies are never paired with one another. The pairs asked for are the size of the result and nothing else is made.

    A group of more than `block` members is cut into blocks, and every two blocks meet by themselves, so that a look that a
    third of all documents share is spread over tasks like any other. `look_classes` gives the same links as classes.
    """
    # Written once: three joins read the digests, the texts are read and decomposed one time.
    forms = cut_lineage(add_forms(df, id_col, text_col).where(F.col("look").isNotNull() & F.col("id").isNotNull()))
    classes = forms.groupBy("look", "same").agg(F.count("*").alias("n"))
    sizes = classes.groupBy("look").agg(F.count("*").alias("n_forms"), F.sum("n").alias("n"))
    mixed = sizes.where(F.col("n_forms") > 1).select("look", F.ceil(F.col("n") / block).cast("int").alias("_blocks"))
    # AQE sees how few groups are mixed and broadcasts them if they are small.
    members = forms.join(mixed, "look").select("look", "same", "id", "_blocks").distinct()
    at = F.pmod(F.xxhash64("id", "same"), F.col("_blocks")).cast("int")
    placed = members.withColumn("_at", at).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = placed.select("look", "same", "id", F.least("_at", "_with").alias("_i"), F.greatest("_at", "_with").alias("_j"), "_at")
    a, b = placed.alias("a"), placed.alias("b")
    met = (F.col("a.look") == F.col("b.look")) & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j"))
    # Where two blocks meet, members of one block have met already.
    once = (F.col("a._i") == F.col("a._j")) | (F.col("a._at") != F.col("b._at"))
    pairs = a.join(b, met & once & (F.col("a.same") != F.col("b.same")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias("doc_a"), F.col("b.id").alias("doc_b")).distinct()


def look_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, form, class_id, members, forms, links): every row's consistent form and its class, the rows that look the same.

    class_id is the least id of the class, members its rows, forms its different texts, links the rows of the class with another text
    than this row's. Rows whose text is null or blank have the class of their own id and are its one member.
    """
    forms = cut_lineage(add_forms(df, id_col, text_col, with_form=True))
    # Counted by text first, so that a hot look is summed from few rows.
    texts = forms.where(F.col("look").isNotNull()).groupBy("look", "same").agg(F.min("id").alias("_least"), F.count("*").alias("_n"))
    looks = texts.groupBy("look").agg(F.min("_least").alias("class_id"), F.sum("_n").alias("members"), F.count("*").alias("forms"))
    # A class of one row says nothing that the row does not; the others are what is looked up.
    many = texts.join(broadcast_if_small(looks.where("members > 1"), 100_000), "look").select("look", "same", "class_id", "members", "forms", (F.col("members") - F.col("_n")).alias("links"))
    joined = forms.join(many, ["look", "same"], "left")
    one = F.lit(1).cast("long")
    return joined.select(
        F.col("id").alias(id_col), "form", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("members", one).alias("members"),
        F.coalesce("forms", one).alias("forms"), F.coalesce("links", F.lit(0).cast("long")).alias("links"),
    )
