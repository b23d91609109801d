"""Personal details inside free text, replaced by placeholders of their type.

Details with a form of their own (mail, telephone, numbers of a person, addresses) are found by that form. Names have none: how strongly
a term gives a person away is estimated from the corpus. Every word with a capital is counted together with the words around it,
and how often those go with entities that are known without any estimate: a word after a title, one that the local part of a
mail address in the same text repeats, two listed names side by side. That gives P(person | context) for every context, from it
P(person | term) for every term, and, with the terms so found as further entities, both once more. The disclosure of a term is
log2 P(person | term) / P(person), its pointwise mutual information with the entity; terms that give away more than a share of the
entity's own information are removed where they stand in a telling context or side by side. In the name of a disease, sign, score
or set of criteria they stay. Contexts are words, too, and are learned alike: no list says what stands before or after a name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Set
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import broadcast_if_small, cut_lineage, spread

TYPES = ("email", "phone", "id_number", "address", "name")

# ---------------------------------------------------------------- forms
_DOT = r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\s+dot\s+)"
_EMAIL = re.compile(
    r"(?<![\w.+%-])(?:mailto:)?[A-Za-z0-9][\w.+%'-]*(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?|\s+at\s+(?=[\w-]+(?:\s+|\s?[(\[]\s?)dot\b))"
    rf"[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,24}}(?![\w@-])",
    re.I,
)

# Labels of numbers that an authority, insurer or hospital gives a person.
_ID_LABELS = (
    r"ssn|social security(?: (?:number|no\.?|nr\.?))?|nhs(?: (?:number|no\.?|nr\.?))?|mrn|medical record(?: number| no\.?)?|passport(?: (?:number|no\.?|nr\.?))?"
    r"|national id(?:entity)?(?: (?:number|card|no\.?))?|identity (?:card|number)(?: no\.?)?|driv(?:ing|er'?s?) licen[cs]e(?: (?:number|no\.?))?|member(?:ship)? (?:id|no\.?|number)"
    r"|insurance (?:policy|id|no\.?|number)(?: (?:no\.?|number))?|policy (?:no\.?|number)|hospital (?:number|no\.?|id)|patient (?:id|number|no\.?)|chart (?:no\.?|number)|health (?:card|id|number)"
    r"|medicare(?: (?:number|no\.?))?|tax (?:id|number)|kv-nr\.?|versicherten(?:nummer|-nr\.?)|versicherungsnummer|sozialversicherungsnummer|rentenversicherungsnummer|ausweis(?:nummer|-nr\.?)"
    r"|personalausweis(?:nummer)?|reisepass(?:nummer)?|patienten(?:nummer|-nr\.?|-id)|steuer-?id|numéro de sécurité sociale|n° de sécurité sociale|nir|numéro (?:de passeport|de patient)"
    r"|carte (?:vitale|d'identité)|dni|nie|nif|número de (?:la seguridad social|pasaporte|historia clínica|afiliación)|historia clínica|pasaporte|codice fiscale"
)
_ID = re.compile(rf"(?<![\w-])(?:{_ID_LABELS})(?:\s*(?:is|ist|:|#|=|nr\.?|no\.?|n°))*\s*(?P<v>[A-Z]{{0,3}}[- ]?\d[\dA-Z]*(?:[ /-]\d{{1,}})*)(?![\w-])", re.I)
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")
# An account number of a person at a bank, with its country and check digits.
_IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])")
_SHAPED = re.compile(r"(?<![\w-])[A-Z]{1,3}-?\d{4,}(?:-\d{4,})*(?![\w-])")

_EXT = r"(?:\s?(?:ext|x|durchwahl|poste)\.?\s?\d{1,5})?"
_PHONE = re.compile(
    r"(?<![\w.+/:-])(?:"
    r"\+\d{1,3}[ ./-]?(?:\(0\)[ ./-]?)?(?:\(\d{1,4}\)[ ./-]?)?\d(?:[ ./-]?\d){5,11}"
    r"|00\d{2,3}(?:[ ./-]\d{1,8}){2,5}"
    r"|\(\d{3,5}\)\s?\d{3}[-. ]?\d{3,4}"
    r"|\d{3}(?P<s>[-. ])\d{3}(?P=s)\d{4}"
    r"|0\d(?:[ .]\d\d){4}"
    r"|0\d{4}[ -]\d{3}[ -]?\d{3}"
    r"|0\d{1,4}[/-]\d{5,9}"
    rf"){_EXT}(?![\w-]|[./]\d)"
)
# What stands before a number that is a telephone number whatever its form.
_CALL = (
    r"tel(?:ephone|efon|éfono|éphone|\.)?|phone|mobile|cell|handy|call(?: me| us| back)?(?: on| at)?|reach(?:ed|able)?(?: me| us)? (?:on|at|under)|my number is|number is|contact|ring|fax"
    r"|rückruf unter|erreichbar unter|unter der nummer|mon numéro est le|numéro est le|appelez(?:-moi)? au|joignable au|mi teléfono es|mi número es|teléfono es|llámeme al"
)
_CALLED = re.compile(rf"\b(?:{_CALL})\s*[:.]?\s*(?P<v>\+?\(?\d[\d ()./-]{{5,18}}\d{_EXT})(?![\w-])", re.I)
_NOT_PHONE = re.compile(r"(?:lot|run|pmid|omim|vcv|scv|rcv|nm_|rs|chr\w{0,2}:|codon|record|under|ci|build|version|isbn|doi)\s*[:#]?\s*$", re.I)
_OTHER_CONTACT = re.compile(r"\bor\s+(?P<v>\d[\d ./-]{6,16}\d)(?![\w-])")

_CITY = r"(?!(?:[Aa]ttn|ATTN|is|IS)\b)[A-ZÄÖÜÉÁÍÓÚÑ][\w'’-]+(?: (?!What|Which|How|Is|Are|Does|Explain|Tell|List|Summarise|Gibt|Welche|Wie|Ist|Führt|Quel|Comment|La|Y|My|The|We|I|Please|For|Seen|Ship|Report|Dear|Hi|Patient|Spoke|Regards|Thanks|Befund|Bitte)[A-ZÄÖÜÉÁÍÓÚÑ][\w'’-]+)?"
_STREETS = r"(?:[Ss]treet|[Ss]t|[Rr]oad|[Rr]d|[Ll]ane|[Ll]n|[Aa]venue|[Aa]ve|[Dd]rive|[Cc]lose|[Tt]errace|[Cc]ourt|[Cc]rescent|[Ww]ay|[Pp]lace|[Ss]quare|[Bb]oulevard|[Bb]lvd|[Gg]ardens|[Gg]rove|[Rr]ow|[Hh]ill|[Pp]arkway|[Hh]ighway)"
_TAIL = rf"(?:,? ?(?:[Aa]pt|[Aa]partment|[Ss]uite|[Uu]nit|[Ff]lat)\.? ?\w{{1,5}})?(?:,\s(?:\d{{4,5}}\s)?{_CITY}(?:,? [A-Z]{{2}})?(?:\s\d{{4,6}})?|\n{_CITY}\s\d{{4,6}})?"
_ADDRESS_PARTS = (
    rf"(?:[Ff]lat \w{{1,4}}, )?\d{{1,5}}[a-zA-Z]?,? (?:(?:St\. )?[A-Z][\w'’-]*\.? ){{1,3}}{_STREETS}\b(?:(?<=[Ss]t|[Rr]d|[Ll]n)\.|(?<=[Aa]ve)\.|(?<=[Bb]lvd)\.)?{_TAIL}",
    rf"(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|allee|gasse|platz)|(?:[A-ZÄÖÜ][\wäöüß-]+ )(?:Straße|Strasse|Weg|Allee|Gasse|Platz)) \d{{1,4}}[a-z]?(?:,? \d{{5}} [A-ZÄÖÜ][\w-]+)?",
    r"(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Hinter der|Unter den) [A-ZÄÖÜ][\wäöüß-]+|[A-ZÄÖÜ][\wäöüß-]*(?:ring|damm|ufer|hof|markt|bach|berg)) \d{1,4}[a-z]?,? \d{5} [A-ZÄÖÜ][\w-]+",
    r"\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|bd|chemin|place|impasse|allée|quai|route|cours|sentier|square)\s(?:(?:de la|de l['’]|des|du|de|d['’]|l['’])\s?)?[A-ZÉÈ]?[\w'’-]+(?: [A-ZÉÈ][\w'’-]+)*(?:,? \d{5} [A-ZÉÈ][\w-]+)?",
    rf"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carretera|Ronda)\s(?:(?:de los|de las|de la|del|de) )?[A-ZÁÉÍÓÚÑ]\w+(?: [A-ZÁÉÍÓÚÑ]\w+)*,? (?:n\.?º ?)?\d{{1,4}}(?:,? \d{{5}})?(?:, {_CITY})?",
    r"[A-Z][\wé'’-]*(?:straat|laan|gracht|plein|kade|dreef|singel|steeg) \d{1,4}[a-zA-Z]?(?:,? \d{4} ?[A-Z]{2} [A-Z][\w'-]+(?: [A-Z][\w'-]+)?)?",
    rf"(?:Rua|Travessa|Largo|Praça|Estrada|Via|Viale|Piazza|Corso|Vicolo|[Uu]l\.|[Uu]lica|[Aa]l\.)\s(?:(?:do|da|dos|das|de|del|della|dei|delle|di) )?[A-ZÀ-Ý]\w+(?: [A-ZÀ-Ý]\w+)*,? (?:n\.?º ?)?\d{{1,4}}(?:,? \d{{2}}-?\d{{3}}(?:-\d{{3}})?)?(?:,? {_CITY})?",
    rf"(?:P\.? ?O\.? ?[Bb]ox|Post Office Box|Postfach|Apartado(?: de [Cc]orreos)?|Boîte [Pp]ostale|B\.?P\.|Casilla(?: [Pp]ostal)?)\s\d{{1,6}}(?:, (?:\d{{4,5}} )?{_CITY}(?: \d{{4,6}})?)?",
)
_ADDRESS = re.compile(r"(?<![\w-])(?:" + "|".join(_ADDRESS_PARTS) + r")(?!\w)")
_ADDRESS_ANY = re.compile(_ADDRESS.pattern, re.I)

# ---------------------------------------------------------------- names
# Titles, and how people give their own name; a person's name follows. All other contexts are learned.
_TITLES = set(
    "dr prof professor mr mrs ms miss nurse sister doctor herr frau herrn fräulein m mme mlle monsieur madame docteur sr sra srta señor señora don doña dra sig dott".split()
)
#: Titles that are abbreviations, and may have a full stop.
_SHORT_TITLES = set("dr prof mr mrs ms m mme mlle sr sra srta dra sig dott".split())
_OWN_NAME = {"name is", "called", "i'm", "ich heiße", "name ist", "m'appelle", "me llamo", "nombre es", "chiamo"}
# What makes the name before it that of a disease, sign, score or set of criteria.
_EPONYM = re.compile(
    r"(?:['’]s)?[\s-]+(?:[a-zäöüß]+[\s-]+)?(?:syndromes?|syndrom|disease|disorder|signs?|scores?|criteria|criterion|stain|test|index|scale|classification|anomaly|phenotype|type|krankheit|zeichen|kriterien|síndrome|enfermedad|signo|criterios|maladie|signe|critères|sindrome|variant|mutation)\b",
    re.I,
)
_EPONYM_BEFORE = re.compile(r"\b(?:syndrome|síndrome|sindrome|maladie|enfermedad|malattia|signe|signo|critères|criterios|score|morbus)\s+(?:de|di|d['’])\s*$", re.I)
_PARTICLES = {"van", "von", "de", "der", "den", "del", "della", "la", "le", "di", "da", "dos", "zu", "ter", "ten", "bin", "ibn", "al", "el"}
_PIECE = r"(?:[^\W\d_]['’])?[^\W\d_]+(?:[-–‑](?:[^\W\d_]['’])?[^\W\d_]+)*"
_WORD = re.compile(rf"(?<![\w>])(?:[^\W\d_]\.|{_PIECE})")
_TOKEN = re.compile(rf"{_PIECE}|\d+|\n|[^\w\s]")


@dataclass(frozen=True)
class Telling:
    """What gives persons away: terms, listed names (which may be common words, too), and contexts to the left and right of a name.

    A context is the one or two tokens beside a word. One of two tokens in `not_left` or `not_right` does not tell, though its
    nearer token alone would.
    """

    known: Set[str] = frozenset()
    listed: Set[str] = frozenset()
    left: Set[str] = frozenset()
    right: Set[str] = frozenset()
    not_left: Set[str] = frozenset()
    not_right: Set[str] = frozenset()

    def after(self, two: str) -> bool:
        """Whether a name is to be expected after these two tokens."""
        return two in self.left or two not in self.not_left and two.split(" ")[-1] in self.left

    def before(self, two: str) -> bool:
        return two in self.right or two not in self.not_right and two.split(" ")[0] in self.right


@lru_cache(200_000)
def _parts(word: str) -> tuple[str, ...]:
    """The terms of a word: its hyphenated parts, in lower case."""
    return tuple(p.lower().replace("’", "'") for p in re.split(r"[-–‑]", word) if p)


def _terms(text: str) -> set[str]:
    """Every term of a text, and what stands after the first two letters of it, as O' and D' may be left out."""
    return {q for w in set(_WORD.findall(text)) for p in _parts(w) for q in (p, p[2:]) if q}


def _is_initial(w: str) -> bool:
    return len(w) == 2 and w.endswith(".")


def _eponym(text: str, start: int, end: int) -> bool:
    return _EPONYM.match(text, end) is not None or _EPONYM_BEFORE.search(text, max(0, start - 24), start) is not None


class _Around:
    """The tokens of a text, details with a form of their own as one token each, and what stands beside any word."""

    def __init__(self, text: str, spans: list[tuple[int, int, str]]):
        self.tokens: list[str] = []
        self.at: dict[int, int] = {}  # start of a word to its token
        self.ends: dict[int, int] = {}
        spans = sorted(spans)
        k = 0
        for m in _TOKEN.finditer(text):
            s, e = m.span()
            while k < len(spans) and spans[k][1] <= s:
                k += 1
            if k < len(spans) and spans[k][0] < e:
                shown = f"<{spans[k][2]}>"
                if self.tokens and self.tokens[-1] == shown:
                    self.ends[e] = len(self.tokens) - 1
                    continue
            else:
                word = m.group().lower().replace("’", "'")
                shown = "9" if word[0].isdigit() else word
            self.at[s], self.ends[e] = len(self.tokens), len(self.tokens)
            self.tokens.append(shown)

    def left(self, start: int) -> str:
        i = self.at.get(start, 0)
        return f"{self.tokens[i - 2] if i > 1 else '^'} {self.tokens[i - 1] if i else '^'}"

    def right(self, end: int) -> str:
        i = self.ends.get(end, len(self.tokens)) + 1
        get = lambda j: self.tokens[j] if j < len(self.tokens) else "$"
        return f"{get(i)} {get(i + 1)}"


def _runs(text: str, around: _Around | None = None, telling: Telling = Telling(), name_like=lambda w: False) -> Iterator[tuple[list[tuple[str, int, int]], bool]]:
    """Stretches of words that may be one name, and whether such a stretch follows a telling context.

    Words of a stretch are parted by a blank, or by a comma and a blank after the first word (family name, given name).
    """
    run: list[tuple[str, int, int]] = []
    cued = False
    for m in _WORD.finditer(text):
        w = (m.group(), m.start(), m.end())
        here = around is not None and telling.after(around.left(w[1]))
        if run:
            # Within a name its parts tell of one another; only after another word does a context begin a name.
            starts = here and not name_like(run[-1][0]) and not _is_initial(run[-1][0]) and run[-1][0].lower() not in _PARTICLES
            if text[run[-1][2] : w[1]] not in (" ", ", ", " ") or starts:
                yield run, cued
                run, cued = [], False
        if not run:
            cued = here
        run.append(w)
    if run:
        yield run, cued


def known_persons(text: str, words: list[tuple[str, int, int]], around: _Around, spans: list[tuple[int, int, str]], listed: Set[str]) -> list[bool]:
    """Which words of a text are names without any estimate: after a title or "my name is", repeated in a mail address, listed and beside another listed one."""
    mails = [re.sub(r"[^a-zà-ÿ]+", " ", text[s:e].lower().split("@")[0].replace("[at]", "@").split("@")[0]) for s, e, k in spans if k == "email"]
    is_listed = [listed.issuperset(_parts(w)) for w, _, _ in words] if listed else [False] * len(words)
    out, after_title = [], False
    for i, (w, s, _) in enumerate(words):
        two = around.left(s)
        before = two.split(" ")
        title = before[1] in _TITLES or before[1] == "." and before[0] in _SHORT_TITLES or two in _OWN_NAME or before[1] in _OWN_NAME
        mailed = len(w) > 3 and any(p in m for p in _parts(w) if len(p) > 3 for m in mails)
        pair = is_listed[i] and any(
            0 <= j < len(words) and (is_listed[j] or _is_initial(words[j][0])) and text[min(words[i][2], words[j][2]) : max(words[i][1], words[j][1])] in (" ", ", ") for j in (i - 1, i + 1)
        )
        # The word after the first one of such a name belongs to it.
        goes_on = i > 0 and after_title and w[0].isupper() and text[words[i - 1][2] : s] == " "
        out.append(title or mailed or pair or goes_on)
        after_title = title
    return out


def co_occurrences(texts: list[str | None], listed: Set[str]) -> Counter:
    """(term, two tokens to the left, two to the right, whether it is a known person) of every word with a capital, and how often.

    Words in the names of diseases and the like, and in details with a form of their own, are left out. A word without a capital,
    in a text that has any, is counted without what is beside it: it speaks against the term.
    """
    out: Counter = Counter()
    for text in texts:
        if not text:
            continue
        spans = find_forms(text)
        around = _Around(text, spans)
        words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [w for w in words if not _is_initial(w[0]) and w[0].lower() not in _PARTICLES and _free(spans, w[1], w[2])]
        sure = None
        cased = not text.islower()
        for i, (w, s, e) in enumerate(words):
            if not w[0].isupper():
                if cased:
                    for p in _parts(w):
                        out[p, None, None, False] += 1
            elif not _eponym(text, s, e):
                sure = known_persons(text, words, around, spans, listed) if sure is None else sure
                for p in _parts(w):
                    if len(p) > 1:
                        out[p, around.left(s), around.right(e), sure[i]] += 1
    return out


#: What the rate of a nearer context, or of all, counts for beside a context's own occurrences.
_PRIOR = 2.0
#: What an occurrence of a term that is not known as a person counts against it, where others are known. It may well be one.
_UNKNOWN = 0.1


#: What a context must hold to tell by itself: a letter, or a detail with a form of its own.
_TELLS = r"[\p{L}<]"


def _context_rates(seen: DataFrame, side: str, base: float) -> DataFrame:
    """(two, c, near, near_c): P(person), the mean of `s`, beside every two tokens and beside the nearer one alone, smoothed."""
    sums = seen.groupBy(F.col(side).alias("two")).agg(F.sum(F.col("n") * F.col("s")).alias("w"), F.sum("n").alias("n"))
    sums = sums.withColumn("near", F.substring_index("two", " ", -1 if side == "left" else 1))
    # Marks after a word, or the end of the text, say nothing of it: it may be cut anywhere.
    sums = sums.where(F.col("two").rlike(_TELLS)) if side == "right" else sums
    wide = sums.groupBy("near").agg(((F.sum("w") + base) / (F.sum("n") + 1)).alias("near_c"))
    return sums.join(wide, "near").select("two", "near", "near_c", ((F.col("w") + _PRIOR * F.col("near_c")) / (F.col("n") + _PRIOR)).alias("c"))


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def disclosure(df: DataFrame, text_col: str, names: DataFrame | None = None, name_col: str = "name_part", threshold: float = 0.7, rounds: int = 3, max_terms: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(term, bits, p) and (side, context, tells): terms that give a person away, and the contexts that do.

    bits is the pointwise mutual information of the term with a person, log2 p / P(person); a term is in the result if that
    is `threshold` or more of the person's own information, -log2 P(person): at 1 only terms that are never anything else, at 0 all
    that are persons more often than words with a capital are at all. A context tells by the same measure; one of two tokens
    that does not, though its nearer token alone would, is listed with tells = false.

    Listed names are sent to every task if there are at most `max_terms` of them; beyond that each text's own terms are joined with
    them instead, with the same result.
    """
    spark = df.sparkSession
    listed_rows = names.where(F.col(name_col).isNotNull()).select(F.lower(name_col).alias("term")).distinct() if names is not None else None
    first = listed_rows.limit(max_terms + 1).collect() if listed_rows is not None else []
    texts = df.select(F.col(text_col).alias("text"))

    def table_of(c: Counter) -> pd.DataFrame:
        keys = list(c)
        return pd.DataFrame({"term": [k[0] for k in keys], "left": [k[1] for k in keys], "right": [k[2] for k in keys], "sure": [float(k[3]) for k in keys], "n": [c[k] for k in keys]})

    # Summed per batch, then per partition, before the shuffle.
    schema = "term string, left string, right string, sure double, n long"
    if len(first) <= max_terms:
        shared = spark.sparkContext.broadcast(frozenset(r[0] for r in first))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield table_of(co_occurrences([t if isinstance(t, str) else None for t in b["text"]], shared.value))

        counted = texts.mapInPandas(count, schema)
    else:

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(row, x) for row, text in zip(b["_row"], b["text"]) if isinstance(text, str) for x in _terms(text)], columns=["_row", "term"])

        def count_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                c: Counter = Counter()
                for text, listed in zip(b["text"], b["listed"]):
                    c.update(co_occurrences([text if isinstance(text, str) else None], frozenset(listed if listed is not None else ())))
                yield table_of(c)

        # More listed names than fit are joined with each text's own terms, which its length bounds.
        rows = cut_lineage(texts.withColumn("_row", F.monotonically_increasing_id()))
        hits = rows.mapInPandas(own, "_row long, term string").join(listed_rows, "term").groupBy("_row").agg(F.collect_list("term").alias("listed"))
        counted = rows.join(hits, "_row", "left").select("text", "listed").mapInPandas(count_own, schema)
    seen = cut_lineage(counted.groupBy("term", "left", "right", "sure").agg(F.sum("n").alias("n")))
    capital = seen.where(F.col("left").isNotNull())
    small = seen.where(F.col("left").isNull()).groupBy("term").agg(F.sum("n").alias("small"))
    # In the beginning a term is a person's as often as it is known to be one, against its small spellings and, far less, its
    # other occurrences, of which nothing is known yet.
    known = capital.groupBy("term").agg(F.sum(F.col("n") * F.col("sure")).alias("w"), F.sum("n").alias("n")).where("w > 0").join(small, "term", "left")
    rate = known.select("term", (F.col("w") / (F.col("w") + F.coalesce("small", F.lit(0)) + _UNKNOWN * (F.col("n") - F.col("w")))).alias("p"))
    terms, sides, base = rate, {}, 0.0
    for _ in range(rounds):
        shares = broadcast_if_small(terms.select("term", F.col("p").alias("_p")), 200_000)
        weighed = cut_lineage(capital.join(shares, "term", "left").withColumn("s", F.greatest("sure", F.coalesce("_p", F.lit(0.0)))).drop("_p"))
        base = weighed.agg(F.sum(F.col("n") * F.col("s")) / F.sum("n")).first()[0] or 0.0
        base = min(max(base, 1e-6), 0.5)
        sides = {side: cut_lineage(_context_rates(weighed, side, base)) for side in ("left", "right")}
        rated = capital
        for side, rates in sides.items():
            rates = broadcast_if_small(rates.select(F.col("two").alias(side), F.col("c").alias(f"c_{side}")), 200_000)
            rated = rated.join(rates, side, "left").fillna({f"c_{side}": base})
        # What both sides give away of an occurrence adds up, as information on one event does; a known person is one.
        odds = _log_odds(F.col("c_left")) + _log_odds(F.col("c_right")) - _log_odds(F.lit(base))
        rated = rated.withColumn("e", F.greatest("sure", 1 / (1 + F.exp(-odds))))
        sums = rated.groupBy("term").agg(F.sum(F.col("n") * F.col("e")).alias("w"), F.sum("n").alias("n")).join(small, "term", "left")
        terms = cut_lineage(sums.select("term", (F.col("w") / (F.col("n") + F.coalesce("small", F.lit(0)))).alias("p")))
    bits = F.log2(F.col("p") / F.lit(base))
    terms = terms.where("p > 0").select("term", bits.alias("bits"), "p").where(F.col("bits") >= -threshold * math.log2(base))
    contexts = sides
    enough = base ** (1 - threshold)
    listed_contexts = None
    for side, rates in contexts.items():
        near = rates.where((F.col("near_c") >= enough) & F.col("near").rlike(_TELLS)).select(F.col("near").alias("context"), F.lit(True).alias("tells")).distinct()
        two = rates.where((F.col("c") >= enough) & ((F.col("near_c") < enough) | ~F.col("near").rlike(_TELLS))).select(F.col("two").alias("context"), F.lit(True).alias("tells"))
        against = rates.where((F.col("c") < enough) & (F.col("near_c") >= enough)).select(F.col("two").alias("context"), F.lit(False).alias("tells"))
        part = near.unionByName(two).unionByName(against).withColumn("side", F.lit(side))
        listed_contexts = part if listed_contexts is None else listed_contexts.unionByName(part)
    return terms, listed_contexts


def _free(spans: list[tuple[int, int, str]], s: int, e: int) -> bool:
    return all(e <= a or s >= b for a, b, _ in spans)


_AT, _DIGIT = re.compile(r"[(\[]\s?at"), re.compile(r"\d")


def find_forms(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the details that have a form of their own; none overlap."""
    spans: list[tuple[int, int, str]] = []

    def add(s: int, e: int, kind: str) -> None:
        if s < e and _free(spans, s, e):
            spans.append((s, e, kind))

    low = text.lower()
    # What a form cannot do without is looked for first.
    if "@" in low or "dot" in low or _AT.search(low):
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if _DIGIT.search(text) is None:
        return spans
    plain = text == low or text.isupper() or sum(map(str.isupper, text)) > 0.8 * sum(map(str.isalpha, text))
    for m in (_ADDRESS_ANY if plain else _ADDRESS).finditer(text):
        add(m.start(), m.end(), "address")
    for m in _ID.finditer(text):
        if sum(ch.isdigit() for ch in m.group("v")) >= 5:
            add(m.start("v"), m.end("v"), "id_number")
    for m in (*_IBAN.finditer(text), *_SSN.finditer(text)):
        add(m.start(), m.end(), "id_number")
    for m in _PHONE.finditer(text):
        if not _NOT_PHONE.search(text, max(0, m.start() - 16), m.start()):
            add(m.start(), m.end(), "phone")
    for m in _CALLED.finditer(text):
        if 7 <= sum(ch.isdigit() for ch in m.group("v")) <= 17:
            add(m.start("v"), m.end("v"), "phone")
    if any(k == "email" for _, _, k in spans):
        for m in _OTHER_CONTACT.finditer(text):
            if any(k == "email" and 0 <= m.start() - b <= 4 for _, b, k in spans):
                add(m.start("v"), m.end("v"), "phone")
    return spans


def find_names(text: str, telling: Telling, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, 'name') of persons' names."""
    known, listed = telling.known, telling.listed
    out: list[tuple[int, int, str]] = []
    seen: dict[str, int] = {}
    for w in set(_WORD.findall(text)):
        parts = _parts(w)
        strong = sum(p in known or p[:2] in ("o'", "d'") and p[2:] in known for p in parts)
        seen[w] = 2 if strong and strong * 2 >= len(parts) else 1 if all(p in listed or p in known for p in parts) else 0
    if not any(v == 2 or v and w[0].isupper() for w, v in seen.items()):
        return out
    strength = seen.__getitem__
    around = _Around(text, spans)

    for run, cued in _runs(text, around, telling, lambda w: seen[w] > 0):
        if not any(strength(w) for w, _, _ in run):
            continue
        cues_here = cued or any(kind == "id_number" and 0 <= run[0][1] - e <= 2 and text[e : run[0][1]].strip() in (",", "") for s, e, kind in spans)
        k = 0
        while k < len(run):
            # A stretch of name-like words from k on: known or listed terms, initials and particles between them.
            j, got, strong, weak = k, [], 0, 0
            while j < len(run):
                w, s, e = run[j]
                if not _free(spans, s, e):
                    break
                kind = strength(w)
                leads = cues_here and j == 0 and len(run) > 1 and strength(run[1][0]) == 2
                # Right after a cue and before a known name, a listed name may be small, and a capital word be unknown.
                if leads and kind == 0 and w[0].isupper() and not _is_initial(w):
                    kind = 1
                # In a name that is written small throughout, a listed name may follow a known one.
                small = bool(got) and kind == 1 and run[got[-1]][0].islower() and strength(run[got[-1]][0]) == 2
                if kind == 2 or kind == 1 and (w[0].isupper() or leads or small):
                    if _eponym(text, s, e):
                        got, strong, weak = [], 0, 0
                        break
                    strong, weak = strong + (kind == 2), weak + (kind == 1)
                    got.append(j)
                elif not (_is_initial(w) and w[0].isupper() or w.lower() in _PARTICLES and j + 1 < len(run)):
                    break
                j += 1
            if got:
                first, last = got[0], got[-1]
                while first > k and (_is_initial(run[first - 1][0]) or run[first - 1][0].lower() in _PARTICLES):
                    first -= 1
                # A trailing initial belongs to a name only after a comma ("Family, G.").
                if last + 1 < j and _is_initial(run[last + 1][0]) and text[run[last][2] : run[last + 1][1]] == ", ":
                    last += 1
                s, e = run[first][1], run[last][2]
                slot = cues_here and first == 0 or telling.before(around.right(e))
                initial = any(_is_initial(run[i][0]) for i in range(first, last + 1))
                if slot or strong and (strong + weak >= 2 or initial):
                    out.append((s, e, "name"))
            k = max(j, k + 1)
    return out


def find_details(text: str | None, telling: Telling = Telling()) -> list[tuple[int, int, str]]:
    """(start, end, type) of every personal detail in `text`, in order; none overlap. A null or empty text has none."""
    if not text:
        return []
    spans = find_forms(text)
    return sorted(spans + [x for x in find_names(text, telling, spans) if _free(spans, x[0], x[1])])


def replace_details(text: str, spans: list[tuple[int, int, str]]) -> str:
    """`text` with each detail replaced by a placeholder of its type, [NAME] and the like, and nothing else changed."""
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, id_col: str, fields: list[str], names: DataFrame | None = None, name_col: str = "name_part", threshold: float = 0.7, max_terms: int = 500_000, with_text: bool = True) -> DataFrame:
    """(id, field_name, types[, clean]): for every row and field the sorted types of details in it, and the text without them.

    A field that is null has no row. Rows that repeat an id give rows of their own. Without a list of names, the corpus alone
    tells which terms are names. Columns besides the id and the fields are not read. An empty table gives an empty result.

    The terms that give persons away are sent to every task if there are at most `max_terms` of them; beyond that each text's
    own terms are joined with them instead, with the same result.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    texts = spread(df.select(F.col(id_col).alias("id"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)]))
    texts = texts.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_f{i}").alias("text")) for i, f in enumerate(fields)])).alias("_x"))
    texts = texts.select("id", "_x.field_name", "_x.text").where(F.col("text").isNotNull())
    found, contexts = disclosure(texts, "text", names, name_col, threshold, max_terms=max_terms)
    terms, contexts = cut_lineage(found.select("term")), cut_lineage(contexts)
    few = terms.limit(max_terms + 1).count() <= max_terms
    spark = df.sparkSession
    given = names.where(F.col(name_col).isNotNull()).select(F.lower(name_col).alias("term")).distinct() if names is not None else None
    schema = f"id {id_type}, field_name string, types array<string>" + (", clean string" if with_text else "")

    def clean(rows: pd.DataFrame, telling_of) -> pd.DataFrame:
        types, texts = [], []
        for i, text in enumerate(rows["text"]):
            spans = find_details(text, telling_of(i))
            types.append(sorted({k for _, _, k in spans}))
            if with_text:
                texts.append(replace_details(text, spans))
        out = rows[["id", "field_name"]].assign(types=types)
        return out.assign(clean=texts) if with_text else out

    def sets(rows: list) -> dict[str, frozenset]:
        return {name: frozenset(r["context"] for r in rows if (r["side"], r["tells"]) == key) for name, key in (("left", ("left", True)), ("right", ("right", True)), ("not_left", ("left", False)), ("not_right", ("right", False)))}

    few_contexts = contexts.limit(max_terms + 1).count() <= max_terms
    if few and few_contexts and (given is None or given.limit(max_terms + 1).count() <= max_terms):
        told = Telling(frozenset(r[0] for r in terms.collect()), frozenset(r[0] for r in given.collect()) if given is not None else frozenset(), **sets(contexts.collect()))
        shared = spark.sparkContext.broadcast(told)

        def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield clean(b, lambda i: shared.value)

        return texts.mapInPandas(small, schema).withColumnRenamed("id", id_col)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every term of a text, and every context in it."""
        for b in batches:
            rows = []
            for row, text in zip(b["_row"], b["text"]):
                around = _Around(text, find_forms(text))
                words = list(_WORD.finditer(text))
                rows += [(row, "term", x) for x in _terms(text)]
                for side, twos in (("left", {around.left(m.start()) for m in words}), ("right", {around.right(m.end()) for m in words})):
                    rows += [(row, side, x) for x in twos | {t.split(" ")[-1 if side == "left" else 0] for t in twos}]
            yield pd.DataFrame(rows, columns=["_row", "side", "context"])

    rows = cut_lineage(texts.withColumn("_row", F.monotonically_increasing_id()))
    kinds = terms.select(F.lit("term").alias("side"), F.col("term").alias("context"), F.lit("known").alias("as"))
    if given is not None:
        kinds = kinds.unionByName(given.select(F.lit("term").alias("side"), F.col("term").alias("context"), F.lit("listed").alias("as")))
    kinds = kinds.unionByName(contexts.select("side", "context", F.concat(F.when(F.col("tells"), "").otherwise("not_"), "side").alias("as")))
    # A row's own terms are bounded by its text.
    hits = rows.select("_row", "text").mapInPandas(own, "_row long, side string, context string").join(kinds, ["side", "context"])
    hits = hits.groupBy("_row").agg(F.collect_list(F.concat_ws("\t", "as", "context")).alias("hits"))

    def large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = []
            for hits in b["hits"]:
                by_kind: dict[str, set] = {}
                for x in hits if hits is not None else ():
                    kind, what = x.split("\t", 1)
                    by_kind.setdefault(kind, set()).add(what)
                told.append(Telling(**by_kind))
            yield clean(b, told.__getitem__)

    return rows.join(hits, "_row", "left").select("id", "field_name", "text", "hits").mapInPandas(large, schema).withColumnRenamed("id", id_col)
