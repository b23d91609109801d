"""Broken prompt and response pairs: each defective pair with its kind of defect.

Copies are found by compression: the response is compressed with its prompt as a zstandard dictionary and the prompt with its
response, and what these cost decides. Languages and refusals are found by dictionaries; truncation by terminal contexts counted
over the whole corpus: how often a text ends after the last words it ends with, against how often it goes on.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import broadcast_if_small, cut_lineage, spread

# ---------------------------------------------------------------- dictionaries
# Function words of each language: articles, pronouns, prepositions, conjunctions, auxiliaries, question words.
FUNCTION_WORDS = {
    "en": """the of and to in is are was were be been being am a an for with that on by from this these those which what how does do did who whom whose when where
        why not no yes has have had it its as at or their there all other than into each after before both may might can could will would shall should must about you your
        yours my mine i me we us our ours they them he she him her his if then so such only also because until while since per up down out off over under again once
        here any some none more most few many much very just but nor between among without within through during against upon across along toward towards like""",
    "de": """der die das dem den des und ist sind war waren ein eine einer eines einem einen von vom zu zur zum mit für auf im in ins bei beim nicht nur wird werden wurde wurden
        worden welche welcher welches welchem welchen wie wer wen wem wo warum wann gibt es als auch aus nach vor über unter oder aber sich kann können konnte haben hat hatte hatten
        habe bin bist sei wäre alle allem allen wenn sobald ja nein mein meine meiner ich sie er wir ihr ihm ihn uns euch dazu dabei daher damit dass ob weil diese dieser dieses diesem
        diesen jede jeder jedes kein keine keiner keinem sehr seit durch gegen ohne um bis ab an am noch schon mehr viel man etwa soll sollte sollten muss müssen darf dürfen
        wird würde hier dort nun so doch""",
    "fr": """le la les de des du et est sont un une dans pour par avec sur que qui quoi quel quelle quelles quels comment où quand pourquoi pas ne plus ce cet cette ces se au
        aux en l' d' n' s' c' j' m' t' qu' jusqu' lorsqu' il elle ils elles on nous vous je tu me te lui leur leurs été être ont avoir a avait chez avant après depuis sans sous entre vers tous toute toutes tout
        environ oui non lorsque ma mon mes ta ton tes sa son ses votre vos notre nos fait peut peuvent doit doivent très aucune aucun si mais ou donc car ni comme aussi
        encore déjà y""",
    "es": """el la los las de del y es son un una unos unas en para por con sin que qué cuál cuáles cómo dónde cuándo quién no más se lo le les al su sus está están estaba hay fue
        fueron ha han había haber ser sobre entre antes después desde hasta hacia todos todas todo toda cerca sí según cuando mi mis tu tus este esta estos estas ese esa eso muy
        ninguna ningún nada era eran tiene tienen puede pueden debe deben yo él ella ellos nosotros usted ustedes me te nos pero ni o u como también ya aún solo donde si""",
    "it": """il lo la i gli le di del dello della dei degli delle da dal dalla dai è e sono era un uno una nel nello nella nei nelle per con su sul sulla che chi quale quali come dove quando
        perché non più si al allo alla ai agli alle stato stata stati state dopo prima fino tra fra ogni viene vengono circa anche senza questo questa questi queste ha hanno
        l' un' d' dell' all' nell' sull' dall' c' può possono deve devono io lei lui noi voi loro mi ti ci vi ma o se anche già solo molto sì no""",
    "pt": """o os as um uma uns umas do da dos das no na nos nas ao aos à às pelo pela em para por com sem que qual quais como onde quando quem não mais se seu sua seus suas é são foi
        foram ser está estão há tem têm sobre entre antes depois desde até todos todas muito nenhuma nenhum pode podem deve devem eu ele ela eles nós você vocês me mas ou
        também já ainda só sim isso esta este de e a""",
    "nl": """de het een en van ik is zijn was waren wordt worden werd voor met op aan bij uit naar om te niet geen wel ook maar dat die dit deze welke wat wie waar wanneer waarom hoe er
        hier als of dan nog al door over onder tegen tussen na tot zonder heeft hebben had kan kunnen moet moeten mag zal zou zo zeer meer je jij hij zij ze wij we u mijn uw
        ons hun haar in""",
    "pl": """i w we z ze na nie się to jest są był była było były do od dla po przez przy o u za nad pod między bez jak co który która które kto gdzie kiedy dlaczego czy że
        ale lub albo także też już jeszcze tylko bardzo ten ta te tego tej tych ma mają może mogą być ja ty on ona my wy oni mnie jego jej ich""",
    "sv": """och att det som en ett är var på för med av till inte den de om har hade han hon jag vi ni du man men eller från vid under över efter före utan mellan kan ska skulle
        måste blir blev vilken vilket vilka vad hur när där varför mycket också bara redan ingen inget alla denna detta dessa i""",
}
#: Letters that one of these languages alone uses, or nearly so.
LETTERS = {"de": "ßäöü", "fr": "çêëîûœàèâ", "es": "ñ¿¡", "it": "ìò", "pt": "ãõ", "pl": "ąćęłńśźż", "sv": "å"}
# Names of languages in requests for an answer in one.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles inglese inglês",
    "de": "german deutsch allemand alémán alemán aleman tedesco alemão",
    "fr": "french französisch franzoesisch français francais francés frances francese francês",
    "es": "spanish spanisch espagnol español espanol spagnolo castellano espanhol",
    "it": "italian italienisch italien italiano",
    "pt": "portuguese portugiesisch portugais portugués português portoghese",
    "nl": "dutch niederländisch néerlandais neerlandés holandés nederlands olandese",
    "pl": "polish polnisch polonais polaco polski polacco",
    "sv": "swedish schwedisch suédois sueco svenska svedese",
}
# What stands for "nothing here", and labels that may stand before an answer.
PLACEHOLDERS = {"n a", "na", "null", "none", "nil", "nan", "undefined", "tbd", "todo", "empty", "no answer", "no response", "placeholder", "lorem ipsum", "xxx"}
LABELS = r"(?:answer|response|reply|antwort|réponse|reponse|respuesta|risposta|assistant|output|a|r)"
# What presents a question that is given back, for the compressor; and the shortest answers there are.
PRESENTING = (
    "you asked", "your question was", "the question is", "question", "you wanted to know", "you would like to know whether", "this was your query", "the original prompt", "user", "q",
    "as you asked", "here is the question again", "to repeat the question", "you wrote", "asked about", "in answer to the question", "sie fragten", "ihre frage lautete", "die frage ist",
    "frage", "sie möchten wissen", "gefragt wurde", "vous avez demandé", "votre question était", "la question est", "vous souhaitez savoir", "usted preguntó", "su pregunta fue", "la pregunta es",
    "pregunta", "quiere saber", "lei ha chiesto", "la domanda è", "domanda",
)
SHORT_ANSWERS = set("yes no ja nein oui non sí si none unknown unclear possibly probably likely unlikely vielleicht unbekannt inconnu peut être desconocido quizás forse sconosciuto both neither".split())

# The parts that ways of declining are put together from, by language: what says that one cannot, may not or will not, and
# what is then not done; and sayings that decline by themselves. In lower case, within one sentence.
CANNOT = {
    "en": r"can ?not|can't|could not|couldn't|will not|won't|would not|wouldn't|unable to|not able to|not (?:in a position|permitted|allowed|authori[sz]ed|supposed|going|willing|free|at liberty|equipped|qualified) to|(?:must|have to|need to|forced to)? ?(?:decline|refuse) to|not to|(?:would |i'd |we'd )?rather not|prefer not to|refrain from|abstain from|avoid|stop short of",
    "de": r"(?:kann|darf|können|dürfen|könnte|möchte|will|werde|soll|sollte)\b[^.!?]*\b(?:nicht|keine?n?r?)|nicht (?:befugt|berechtigt|in der lage|bereit|imstande)|außerstande",
    "fr": r"ne (?:peux|puis|saurais|veux|souhaite|dois|pourrai|vais|peut|pouvons)|(?:suis|sommes) pas (?:autorisée?s?|en mesure|habilitée?s?)|n'est pas possible de|(?:m'est|nous est) impossible de|refuse de|préfère ne pas",
    "es": r"no (?:puedo|podemos|podría|debo|quiero|voy a|me es posible|nos es posible|me está permitido|estoy autorizad[oa] a|estoy en condiciones de)|me niego a|prefiero no|imposible",
    "it": r"non (?:posso|possiamo|devo|voglio|mi è possibile|sono in grado di|sono autorizzat[oa] a)|preferisco non|mi rifiuto di",
    "pt": r"não (?:posso|podemos|devo|quero|me é possível|estou autorizad[oa] a)|prefiro não|recuso-me a",
}
DONE = {
    "en": r"help|assist|answer(?:ing)?|discuss(?:ing)?|comment(?:ing)?|say(?:ing)?|repl(?:y|ying)|respond(?:ing)?|go(?:ing)? into|provid(?:e|ing)|giv(?:e|ing)|shar(?:e|ing)|speak(?:ing)?|talk(?:ing)?|advis(?:e|ing)|offer(?:ing)?|address|engage|handle|take (?:this|that|it)|cover|tell|do (?:that|this|so)|support|comply|entertain|touch|judge|decide",
    "de": r"helfen|weiterhelfen|beantworten?|antworten|auskunft|sagen|äußern|geben|besprechen|eingehen|beraten|beurteilen|kommentieren|mitteilen|behandeln|sprechen|reden|tun",
    "fr": r"répondre|aider|discuter|commenter|dire|donner|aborder|parler|conseiller|traiter|prononcer|fournir|faire",
    "es": r"ayudar\w*|responder|contestar|comentar|hablar|decir|dar|tratar|aconsejar|opinar|proporcionar|hacer|pronunciarme",
    "it": r"aiutar\w*|rispondere|commentare|parlare|dire|dare|trattare|consigliare|discutere|fare",
    "pt": r"ajudar|responder|comentar|falar|dizer|dar|tratar|aconselhar|discutir|fazer",
}
_MATTER = r"(?:request|question|query|topic|subject|matter|this|that|it)"
SAYINGS = [
    # English: out of scope, not mine to say, left unanswered, not allowed.
    r"\b(?:outside|beyond|not within|out of|exceeds?|goes past)\b[^.!?]{0,20}\b(?:my|our|the|its|what|of what)\b[^.!?]{0,30}\b(?:scope|remit|competence|mandate|role|purview|limits?|bounds|authority|capabilit\w+|expertise|area|provides?|may|can|discuss|answer|offer|say)\b",
    rf"\b{_MATTER}\b[^.!?]*\bcan(?:not| not|'t) be (?:answered|discussed|handled|addressed|dealt with|processed)",
    r"\bno (?:answer|reply|comment|advice|response|information) (?:can|will|may|could) be (?:given|made|provided|offered)", r"\bno comment\b",
    r"\b(?:asked|told|instructed|required|obliged) not to\b", r"\bnot (?:something|one|a \w+) (?:that )?(?:i|we) (?:can|may|could|will|am able|want|wish|care)\b",
    r"\bnot (?:for me|my place|mine|up to me) to\b", r"\bmatter for (?:your|a|the)\b[^.!?]*\b(?:doctor|physician|clinician|specialist|professional|court|lawyer)",
    r"\bpass on (?:this|that|it)\b", r"\bleave (?:this|that|it|your question|the question)\b[^.!?]*\b(?:unanswered|to others|to (?:a|your|the) \w+|there|aside)",
    r"\b(?:policy|policies|rules?|guidelines?|terms|instructions|orders)\b[^.!?]*\b(?:keeps?|prevents?|stops?|forbids?|prohibits?|bars?|(?:does|do) not (?:allow|permit|let))\b",
    r"\bagainst (?:my|our|the) (?:policy|policies|rules|guidelines|principles|instructions)\b", r"\boff[- ]limits\b", r"\b(?:i|we) (?:must |have to |would )?(?:respectfully |politely )?(?:decline|refuse|abstain|refrain|demur)\b",
    # German
    r"\b(?:lehne|lehnen)\b[^.!?]*\bab\b", r"\bablehnen\b", r"\b(?:gehe|gehen)\b[^.!?]*\bnicht\b[^.!?]*\bein\b", r"\b(?:enthalte|enthalten) (?:ich )?(?:mich|uns)\b", r"\b(?:verweigere|verzichte)\b",
    r"\b(?:keine|keinerlei) (?:auskunft|antwort|angaben|stellungnahme|beratung)\b", r"\bkein kommentar\b", r"\b(?:außerhalb|jenseits) (?:meine[rs]|unsere[rs]|dessen)\b", r"\bnicht (?:meine aufgabe|in meine[rn]? zuständigkeit|zuständig|in meinem bereich)\b",
    r"\b(?:steht mir nicht zu|übersteigt mein\w*|lieber nicht|nicht (?:beantwortet|besprochen) werden)\b",
    # French
    r"\b(?:m'abst(?:iens|iendrai|enir)|décline|sans commentaire)\b", r"\b(?:hors|en dehors) de (?:mon|ma|mes|notre|ce que)\b", r"\bdépasse (?:mon|ma|mes|le cadre)\b", r"\bn?e? ?(?:relève|est) pas (?:de|du) (?:ma|mon|mes|notre) (?:ressort|compétence|domaine|rôle)", r"\bne (?:peut|pourra) (?:être|recevoir)\b[^.!?]*\b(?:répondue?|traitée?|réponse)",
    # Spanish
    r"\b(?:me abstengo|abstenerme|declino|rehúso|sin comentarios)\b", r"\bfuera de (?:mi|mis|nuestro|lo que)\b", r"\bexcede (?:mi|mis|lo que)\b", r"\bno (?:me corresponde|es de mi competencia|entra en mi|puede ser (?:respondida|contestada|tratada))\b",
    # Italian, Portuguese
    r"\b(?:mi astengo|astenermi|declino|no comment)\b", r"\b(?:fuori|al di fuori) (?:dal|dalla|del|della|dalle|dai) mi\w+", r"\b(?:abstenho-me|abster-me|recuso)\b", r"\bfora d[oae]s? me\w+ (?:alcance|âmbito|competência)",
]
REFUSALS = [rf"\b(?:{CANNOT[k]})\b[^.!?]{{0,60}}\b(?:{DONE[k]})\b" for k in CANNOT] + [r"\b(?:nicht|keine)\b[^.!?]*\b(?:helfen|beantworten|geben|sagen|eingehen)\b[^.!?]*\b(?:kann|darf|möchte|will|werde)\b"] + SAYINGS
# Sentences that decline one thing but announce an answer, and things that are not found rather than declined.
CAVEATS = [
    r"\b(?:but|however|here is|here are|follows?|following|while|although|though|instead|aber|hier|jedoch|dennoch|mais|voici|cependant|pero|sin embargo|aquí|ma|ecco|mas)\b",
    r"\b(?:letter|report|copy|file|record|entry) (?:for|of)\b",
    r"\b(?:find|found|locate|identify|detect|index|indexed|gefunden|finden|trouver|trouvée?|encontrar|encontrado|trovare)\b",
]
# Sentences around a refusal or an answer that say nothing on the matter.
COURTESIES = [
    r"^(?:please|kindly|bitte|veuillez|por favor)\b",
    r"\b(?:thank you|thanks|danke|merci|gracias|grazie|obrigad[oa])\b",
    r"\b(?:hope you understand|understanding|verständnis|compréhension|comprensión|you may wish to|something else|anything else|andere frage|autre chose|algo más)\b",
    r"\b(?:sorry|apologi[sz]e|apologies|unfortunately|regrettably|leider|hm|malheureusement|lamentablemente)\b[^a-z]*$",
    r"^(?:sorry,? no|no|hm|tut mir leid|es tut mir leid|désolée?|lo siento)[,.! ]*$",
    r"^(?:dear|liebe|lieber|cher|chère|estimad[oa])\b",
    r"\b(?:speak (?:with|to)|consult|see|contact|turn to|ask|wenden sie sich|fragen sie|consulte[zr]?|adressez-vous|acuda|diríjase)\b[^.!?]*\b(?:clinician|specialist|professional|doctor|physician|clinic|counsell?or|arzt|ärztin|fachperson|praxis|médecin|spécialiste|médico|médica|especialista|profesional)",
]

_TAGS = re.compile(r"<[^<>]{0,200}>|```\w*|[*_#`|~]+")
_CITE = re.compile(r"(?:\[\d+(?:\s*[,–-]\s*\d+)*\]\s*)+")
_SENTENCE = re.compile(r"(?<=[.!?])(?<!\b[A-Z]\.)[\"”»)]*\s+|\n+")
_TOKEN = re.compile(r"(?<![\w.>])[^\W\d_]+(?:['’][^\W\d_]+)?(?![\w>]|\.\w)")
_ITEM = re.compile(r"\s*(?:[-*•–+]|\d+[.)]|[a-z]\))\s+\S")
_CLOSERS = "\"'”»’)]*_"
_REFUSE, _CAVEAT, _COURT = (re.compile("|".join(p), re.I) for p in (REFUSALS, CAVEATS, COURTESIES))
_APOLOGY = re.compile(r"^\W*(?:i'?m|i am|we are|es tut mir|je suis|lo)?\s*(?:very |so |really )?(?:sorry|afraid|leid|désolée?|siento)\W+(?:but|aber|mais|pero)\b", re.I)
_ASK = re.compile(
    r"\b(?:answer|reply|respond|write|text|response|explain|antworte\w*|antwort|répond\w*|réponse|respond\w*|respuesta|responde\w*|auf|in|en)\b[^.?!\n]{0,25}?\b(?:in|auf|en)\s+(?P<n>"
    + "|".join(w for v in LANGUAGE_NAMES.values() for w in v.split())
    + r")\b",
    re.I,
)
_BY_NAME = {w: k for k, v in LANGUAGE_NAMES.items() for w in v.split()}
_BY_WORD: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _BY_WORD.setdefault(_w, []).append(_lang)


#: Scripts that no language of the dictionaries is written in, and what a text in each is taken for.
_SCRIPTS = (("CYRILLIC", "ru"), ("GREEK", "el"), ("HIRAGANA", "ja"), ("KATAKANA", "ja"), ("HANGUL", "ko"), ("CJK", "zh"), ("ARABIC", "ar"), ("HEBREW", "he"), ("DEVANAGARI", "hi"), ("THAI", "th"))


def _script(text: str) -> tuple[str | None, int]:
    """The language of the script that more than half of the letters are of, if it is none of the dictionaries' script."""
    if text.isascii():
        return None, 0
    found: Counter = Counter()
    letters = 0
    for ch, n in Counter(text).items():
        if ch.isalpha():
            letters += n
            if ord(ch) > 0x2FF:
                name = unicodedata.name(ch, "")
                found.update({k: n for start, k in _SCRIPTS if name.startswith(start)})
    if sum(found.values()) * 2 <= letters:
        return None, 0
    # Japanese mixes kana with Chinese characters.
    return ("ja" if found["ja"] else found.most_common(1)[0][0]), sum(found.values())


def language_scores(text: str) -> dict[str, float]:
    """For every language the function words of it in the text, and what its own letters add."""
    script, n = _script(text)
    if script:
        return {script: float(n)}
    score: dict[str, float] = {}
    low = text.lower()
    for w in _TOKEN.findall(low.replace("’", "'")):
        parts = w.split("'")
        for part in [*(p + "'" for p in parts[:-1]), *parts] if len(parts) > 1 else parts:
            for k in _BY_WORD.get(part, ()):
                score[k] = score.get(k, 0.0) + 1.0
    if not low.isascii():
        for k, letters in LETTERS.items():
            if n := sum(low.count(ch) for ch in letters):
                score[k] = score.get(k, 0.0) + min(n, 6) * 0.4
    return score


def language(text: str) -> tuple[str | None, float]:
    """The language whose words and letters the text has most of, and by how much it leads; None if there is no sign."""
    ranked = sorted(language_scores(text).items(), key=lambda x: (-x[1], x[0]))
    if not ranked:
        return None, 0.0
    return ranked[0][0], ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0.0)


def wanted_languages(question: str) -> set[str]:
    """The languages an answer may be in: the one that `question` asks for, else those it may itself be in.

    A short question may be one in several languages; all that have as many of its words are accepted.
    """
    asked = [m.group("n").lower() for m in _ASK.finditer(question)]
    if asked:
        return {_BY_NAME[asked[-1]]}
    # What asks counts: sentences that end in a question mark, if any, else all of them.
    parts = [s for s in re.split(r"(?<=[.!])\s+|\n+|(?<=\?)\s*", question) if s.strip()]
    for part in (" ".join(s for s in parts if s.rstrip().endswith("?")), question):
        score = language_scores(part)
        if score and max(score.values()) >= 1:
            return {k for k, v in score.items() if v > max(score.values()) - 1}
    return set()


def is_other_language(question: str, answer: str) -> bool:
    """Whether the answer has more of some other language than of any wanted one."""
    want = wanted_languages(question)
    if not want:
        return False
    score = language_scores(strip_citations(answer))
    # A word or two speak for themselves; a longer text must show more than a stray word.
    words = len(_TOKEN.findall(answer))
    enough = 0.75 if words <= 3 else 1.0 if words <= 5 else 1.5
    return bool(score) and max(score.values()) - max(score.get(w, 0.0) for w in want) >= enough


def is_empty(text: str | None) -> bool:
    """Nothing in it that a reader could take as content: mark-up, citation marks, labels and placeholders are none."""
    if text is None:
        return True
    rest = _CITE.sub(" ", _TAGS.sub(" ", text))
    rest = re.sub(rf"^\s*{LABELS}\s*:\s*", "", rest, flags=re.I)
    words = " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", rest))).casefold()
    return not words or words in PLACEHOLDERS


def _plain(text: str) -> str:
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text).casefold()))


def _bytes(data: bytes, base: bytes = b"") -> int:
    """Bytes that `data` costs with `base` as dictionary. The strongest level, as matches of three bytes count here."""
    kw = {"write_checksum": False, "write_content_size": False}
    if len(base) >= 8:
        kw |= {"dict_data": zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT), "write_dict_id": False}
    return len(zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(19, source_size=len(data), dict_size=len(base), **{k: v for k, v in kw.items() if k != "dict_data"}), **{k: v for k, v in kw.items() if k == "dict_data"}).compress(data))


_PRESENTING = " ".join(PRESENTING).encode()
#: More bytes than a text costs beside itself: a frame's and a block's header, one match and what its length takes.
_ONE_MATCH = 40


@dataclass(frozen=True)
class CopyLimits:
    """Up to how many bytes a copy may cost more than the question costs beside itself."""

    #: The question beside the answer: what of it the answer lacks.
    missing: float = 3.0
    #: The answer beside the question and the presenting phrases: what it adds.
    added: float = 24.0


def _letters(text: str) -> bytes:
    """What of a text is compressed: case, marks and spacing do not count."""
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text).casefold())).encode("utf-8", "surrogatepass")


def copy_costs(question: str, answer: str, missing_at_most: float = float("inf")) -> tuple[float, float] | None:
    """(missing, added) bytes of an answer as a copy of the question; None if more than `missing_at_most` are missing.

    Case, marks and spacing do not count. Each is the cost beyond what the question costs with itself as dictionary. What a copy
    adds is compressed with the question and the presenting phrases as dictionary.
    """
    q, a = _letters(question), _letters(answer)
    # The question can be missing little only if the answer is about as long.
    if not q or len(a) + max(8.0, missing_at_most) < len(q):
        return None
    beside = _bytes(q, a)
    # A question beside itself is one match; where it costs more than any one match can, it is not worth knowing exactly.
    if beside > _ONE_MATCH + len(q) // 5_000 + missing_at_most:
        return None
    own = _bytes(q, q)
    missing = beside - own
    if missing > missing_at_most:
        return None
    # The question stands last, as near to the answer as can be.
    return missing, _bytes(a, _PRESENTING + b" " + q) - own


def is_copied(question: str | None, answer: str, limits: CopyLimits = CopyLimits()) -> bool:
    """The whole question comes back, once or more, and nothing is added but what presents it."""
    if not question or not question.strip():
        return False
    costs = copy_costs(question, answer, limits.missing)
    # What presents a question stands before it; what follows it is an answer more often, and may cost a third only.
    after = not _plain(answer).endswith(" ".join(_plain(question).split()[-2:]))
    if costs is None or costs[1] > (limits.added / 3 if after else limits.added):
        return False
    # The shortest answers cost less than any presenting phrase: a word the question does not have.
    return not (set(_plain(answer).split()) - set(_plain(question).split())) & SHORT_ANSWERS


def _first_sentence(answer: str) -> str:
    return _SENTENCE.split(answer.strip())[0]


def limit_costs(question: str, other: str, no: int) -> Iterator[tuple[str, int]]:
    """('copy', 'answer' or 'lacking', bytes) of what the limits lie between, made of a question and another row's first sentence.

    The question is given back as it is, in a presenting phrase and in one that the compressor does not know ('copy': what is added),
    with `other` behind it ('answer': what is added), and with `other` in place of its last word ('lacking': what is missing).
    """
    q = _letters(question)
    if not q:
        return
    own, base = _bytes(q, q), _PRESENTING + b" " + q
    phrase = PRESENTING[no % len(PRESENTING)]
    unknown = " ".join(w[::-1] for w in phrase.split())  # as long, and nothing the compressor knows
    for text in (question, f"{phrase}: {question}", f"{unknown}: {question}"):
        yield "copy", _bytes(_letters(text), base) - own
    if len(_plain(other).split()) > 3 and _plain(other) not in _plain(question):
        yield "answer", _bytes(_letters(f"{question} {other}"), base) - own
    words = question.split()
    if len(words) > 3:
        yield "lacking", _bytes(q, _letters(" ".join(words[:-1]) + " " + other)) - own


def _limits(costs: Counter) -> CopyLimits:
    """The limits by how often each (kind, bytes) of `limit_costs` came.

    That on what is added lies where most copies and answers are told apart, that on what is missing between whole questions and
    ones without their last word.
    """
    values, times = {}, {}
    for kind in ("copy", "answer", "lacking"):
        values[kind] = np.array(sorted(v for k, v in costs if k == kind), dtype=float)
        times[kind] = np.cumsum([costs[kind, int(v)] for v in values[kind]])
    total = {kind: int(t[-1]) if len(t) else 0 for kind, t in times.items()}
    if total["copy"] < 20 or total["answer"] < 20:
        return CopyLimits()
    grid = np.union1d(values["copy"], values["answer"])
    up_to = {kind: np.append(0, times[kind])[np.searchsorted(values[kind], grid, "right")] for kind in ("copy", "answer")}
    wrong = (total["copy"] - up_to["copy"]) / total["copy"] + up_to["answer"] / total["answer"]
    best = grid[wrong <= wrong.min() + 1e-12]
    missing = CopyLimits.missing
    if total["lacking"]:
        at = 0.02 * (total["lacking"] - 1)
        low, high = (values["lacking"][np.searchsorted(times["lacking"], place, "right")] for place in (int(at), min(int(at) + 1, total["lacking"] - 1)))
        missing = max(1.0, min(4.0, float(low + (high - low) * (at - int(at))) - 1))
    return CopyLimits(missing, float((best.min() + best.max()) / 2))


def fit_copy_limits(pairs: Sequence[tuple[str, str]]) -> CopyLimits:
    """Limits between copies and answers, from questions and answers; each question meets the answer of the pair after it."""
    costs: Counter = Counter()
    for i, (q, _) in enumerate(pairs):
        costs.update(limit_costs(q, _first_sentence(pairs[(i + 1) % len(pairs)][1]), i))
    return _limits(costs)


def table_copy_limits(pairs: DataFrame) -> CopyLimits:
    """`fit_copy_limits` over all rows of `pairs` (q, r).

    Equal questions with equal first sentences are compressed once and counted as often as they are there. They are put in the order
    of their hashes, so that the pair after one is any other, and the same however the rows are partitioned.
    """
    spark = pairs.sparkSession

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"q": b["q"], "other": b["r"].map(_first_sentence)})

    each = pairs.select("q", "r").mapInPandas(cut, "q string, other string").groupBy("q", "other").agg(F.count("*").alias("n"))
    by = ("h", "q", "other")
    each = cut_lineage(each.withColumn("h", F.xxhash64("q", "other")).repartitionByRange("h").sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits of _at are the partition, the lower ones the place in it.
    part = F.shiftright("_at", 33)
    sizes, before, total = {r["part"]: r["n"] for r in each.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}, [], 0
    for k in sorted(sizes):
        before.append((k, total))
        total += sizes[k]
    if not total:
        return CopyLimits()
    starts = F.broadcast(spark.createDataFrame(before, "part long, start long"))
    placed = each.withColumn("part", part.cast("long")).join(starts, "part").withColumn("no", F.col("start") + F.col("_at") - F.shiftleft("part", 33))
    # Every row takes long to compress, so a small table is spread, too.
    tasks = max(spark.sparkContext.defaultParallelism, total // 10_000)
    questions = placed.select("no", "q", "n", ((F.col("no") + 1) % total).alias("next")).repartition(tasks, "next")
    met = questions.join(placed.select(F.col("no").alias("next"), "other").repartition(tasks, "next"), "next")

    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for no, q, n, other in zip(b["no"], b["q"], b["n"], b["other"]):
                for x in limit_costs(q, other, no):
                    c[x] += n
            keys = list(c)
            yield pd.DataFrame({"kind": [k[0] for k in keys], "cost": [k[1] for k in keys], "n": [c[k] for k in keys]})

    counted = met.select("no", "q", "n", "other").mapInPandas(cost, "kind string, cost long, n long").groupBy("kind", "cost").agg(F.sum("n").alias("n"))
    return _limits(Counter({(r["kind"], r["cost"]): r["n"] for r in counted.collect()}))


def is_refusal(text: str) -> bool:
    """A sentence declines, and besides it there are only courtesies."""
    said = False
    for s in _SENTENCE.split(_TAGS.sub(" ", text).replace("’", "'")):
        s = s.strip()
        if not s or not re.search(r"\w", s):
            continue
        if _REFUSE.search(s) and not _CAVEAT.search(_APOLOGY.sub("", s)):
            said = True
        elif len(_TOKEN.findall(s)) >= 4 and not _COURT.search(s):
            return False  # something is said on the matter
    return said


# ---------------------------------------------------------------- terminal contexts
def _shape(token: str) -> str:
    """A token with its digits as one, so that all numbers of a kind are alike."""
    shape = re.sub(r"\d+", "9", token).strip("\"'”»«“()[]").lower()
    # A token of great length is known by its digest, so that contexts stay short and different tokens different.
    return shape if len(shape) <= 40 else md5(shape.encode("utf-8", "surrogatepass")).hexdigest()


def _ends(text: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, context, ended) for every place where `text` might end: after a full stop, and between the words of list items.

    The context is the two tokens before the place, whatever follows. A full stop has ended the text if nothing follows. An
    item has ended if another line follows; the last line of a text says nothing, as it may be cut itself.
    """
    lines = text.rstrip().split("\n")
    for no, line in enumerate(lines):
        final = no == len(lines) - 1
        tokens = line.split()
        item = not final and _ITEM.match(line) is not None
        for i, t in enumerate(tokens):
            before = tokens[i - 1] if i else "^"
            last = i == len(tokens) - 1
            stop = -1
            while (stop := t.find(".", stop + 1)) >= 0:
                yield "stop", f"{_shape(before)} {_shape(t[:stop])}", final and last and not t[stop + 1 :].strip(_CLOSERS)
            if item:
                yield "item", f"{_shape(before)} {_shape(t)}", last


def end_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(kind, context, ended, went_on): over all texts, how often a text or line ended in a context and how often it went on.

    Counts are summed per batch before they are shuffled, so a context that is everywhere costs no more than any other.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ended, on = Counter(), Counter()
            for text in b["text"]:
                if isinstance(text, str):
                    for kind, context, final in _ends(text):
                        (ended if final else on)[kind, context] += 1
            keys = list(ended | on)
            yield pd.DataFrame({"kind": [k[0] for k in keys], "context": [k[1] for k in keys], "ended": [ended[k] for k in keys], "went_on": [on[k] for k in keys]})

    counted = df.select(F.col(text_col).alias("text")).mapInPandas(count, "kind string, context string, ended long, went_on long")
    return counted.groupBy("kind", "context").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on"))


def strip_citations(text: str) -> str:
    """`text` without white space, citation marks and a closing line of sources at its end."""
    body = re.sub(r"\n\s*(?:sources?|references?|quellen?|fuentes?|fonti?)\s*:\s*(?:\[\d+\]\s*\w+[\s,;]*)+$", "", text.rstrip().rstrip("​"), flags=re.I).rstrip()
    return re.sub(r"(?:\s*\[\d+\])+$", "", body).rstrip()


def truncation(text: str) -> bool | tuple[str, str]:
    """Whether `text` stops before its end, or, where the corpus decides, the kind and the context it ends in.

    Open brackets, a comma, dash, colon or ellipsis at the end, or no closing mark at all outside a list decide at once; after a
    full stop, and in a list, the counts do: an abbreviation, ordinal or decimal is a stop that texts go on after.
    """
    body = strip_citations(text)
    last_line = body.rsplit("\n", 1)[-1]
    tail = re.split(r"(?<=[.!?])\s+", last_line)[-1]
    bare = body.rstrip(_CLOSERS)
    if not bare:
        return False
    if any(tail.count(a) > tail.count(b) for a, b in ("()", "[]", "{}", "«»", "“”")):
        return True
    if bare[-1] in "!?。":
        return False
    tokens = last_line.split()
    before = _shape(tokens[-2]) if len(tokens) > 1 else "^"
    if bare[-1] == ".":
        return True if bare.endswith("..") else ("stop", f"{before} {_shape(tokens[-1].rstrip(_CLOSERS)[:-1])}")
    if bare[-1] in ",;:-–—…/&(" or not bare[-1].isalnum() and bare[-1] not in "%>+":
        return True
    if _ITEM.match(last_line):
        return "item", f"{before} {_shape(tokens[-1])}"
    return True


#: How many occurrences the rate of a word, or of a kind, counts for beside a context's own. After a full stop texts seldom end, so it
#: takes many that went on to tell; the words that items end with are few and always the same.
_PRIOR = {"stop": 20, "item": 1}


def find_defects(df: DataFrame, id_col: str = "id", query_col: str = "query_text", response_col: str = "response_text") -> DataFrame:
    """(id, defect), one row per defective id: 'empty', 'copied', 'refusal', 'other_language' or 'truncated'.

    The first that holds, in this order, is the defect. A null response is empty; with a null or blank question nothing can be
    copied and no language is expected. Rows that repeat an id give one row, by the least defect name if they differ; rows
    without id are left out. An empty table has no defects. A hint such as was_rejected is not used: it is unsure, and the
    response itself decides.

    A text is truncated after a full stop if texts end in that context less than a fifth as often as after any full stop; in a
    list, if fewer than 3 of 10 items that another line follows end after those two words. Both are smoothed rates: a context that
    is rare in the table leans on its last word, and a rare word on all of the kind, so there is no number from which counts begin
    to matter. The limits of copies are fitted on all rows with a question and an answer.
    """
    pairs = df.select(F.col(id_col).alias("id"), F.col(query_col).alias("q"), F.col(response_col).alias("r")).where(F.col("id").isNotNull())
    pairs = spread(pairs)
    id_type = df.schema[id_col].dataType.simpleString()
    both = pairs.where((F.length(F.trim("q")) > 0) & (F.length(F.trim("r")) > 0))
    limits = table_copy_limits(both)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, r in zip(b["q"], b["r"]):
                q, r = (x if isinstance(x, str) else None for x in (q, r))
                if is_empty(r):
                    out.append(("empty", None, None))
                elif is_copied(q, r, limits):
                    out.append(("copied", None, None))
                elif is_refusal(r):
                    out.append(("refusal", None, None))
                elif q and q.strip() and is_other_language(q, r):
                    out.append(("other_language", None, None))
                else:
                    cut = truncation(r)
                    out.append((None, *cut) if isinstance(cut, tuple) else ("truncated" if cut else None, None, None))
            yield pd.DataFrame(out, columns=["defect", "kind", "context"]).assign(id=b["id"].to_numpy())[["id", "defect", "kind", "context"]]

    judged = cut_lineage(pairs.mapInPandas(judge, f"id {id_type}, defect string, kind string, context string"))
    counts = cut_lineage(end_counts(pairs, "r"))
    n = F.col("ended") + F.col("went_on")
    rates = {r["kind"]: (r["ended"] / r["n"] if r["n"] else 0.0) for r in counts.groupBy("kind").agg(F.sum("ended").alias("ended"), F.sum(n).alias("n")).collect()}
    rate = F.when(F.col("kind") == "stop", F.lit(rates.get("stop", 0.0))).otherwise(F.lit(rates.get("item", 0.0)))
    # The rate of each level weighs as much as `_PRIOR` occurrences of the level below it. A text that ends in a context is not
    # evidence for itself: one ending is left out.
    last = F.substring_index("context", " ", -1)
    words = counts.groupBy("kind", last.alias("last")).agg(F.sum("ended").alias("we"), F.sum(n).alias("wn"))
    # The last line of a text is in no count of items.
    own = F.when(F.col("kind") == "stop", 1).otherwise(0)
    less_one = lambda e, t: (F.greatest(e - own, F.lit(0)), F.greatest(t - own, F.lit(0)))
    prior = F.when(F.col("kind") == "stop", F.lit(_PRIOR["stop"])).otherwise(F.lit(_PRIOR["item"]))
    (we, wn), (ce, cn) = less_one(F.col("we"), F.col("wn")), less_one(F.col("ended"), n)
    of_word = (we + prior * rate) / (wn + prior)
    smoothed = counts.withColumn("last", last).join(words, ["kind", "last"]).withColumn("p", (ce + prior * of_word) / (cn + prior))
    stop = (F.col("kind") == "stop") & (F.col("p") < 0.2 * rate)
    whole = (F.col("kind") == "item") & (F.col("p") >= 0.3)
    # Contexts that texts go on after, and ones that items end with or not: far fewer than texts, and looked up by context. The last
    # line of a text is no item of the counts, so its context may be in none; then its last word decides.
    decided = smoothed.where(stop | (F.col("kind") == "item")).select("kind", "context", F.coalesce(stop | whole, F.lit(False)).alias("known"))
    by_word = words.where("kind = 'item'").select("kind", "last", (of_word >= 0.3).alias("word_known"))
    open_ = judged.where(F.col("context").isNotNull()).withColumn("last", last)
    open_ = open_.join(broadcast_if_small(decided, 200_000), ["kind", "context"], "left").join(broadcast_if_small(by_word, 200_000), ["kind", "last"], "left")
    cut = open_.where(F.coalesce("known", "word_known", F.lit(False)) == (F.col("kind") == "stop")).select("id", F.lit("truncated").alias("defect"))
    found = judged.where(F.col("defect").isNotNull()).select("id", "defect").unionByName(cut)
    return found.groupBy("id").agg(F.min("defect").alias("defect")).withColumnRenamed("id", id_col)
