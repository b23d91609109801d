import pytest
from conftest import rows
from pyspark.sql import functions as F

from corvane.llm import pairs as P
from corvane.llm.pairs import CopyLimits, copy_costs, find_defects, fit_copy_limits, is_copied, is_empty, is_other_language, is_refusal, language, truncation, wanted_languages

Q = "Which gene causes infantile dystellar dysplasia?"


@pytest.mark.parametrize("text, empty", [(None, True), ("", True), (" \n\t​", True), ("n/a", True), ("<think></think>", True), ("Answer:", True), ("[1]", True), ("...", True), ("—", True), ("null", True), ("Yes.", False), ("QPIB8.", False)])
def test_empty(text, empty):
    assert is_empty(text) is empty


@pytest.mark.parametrize("answer, copied", [
    (Q, True), (Q.upper(), True), (f"  {Q[:-1]}\n", True), (f'You asked: "{Q}"', True), (f"{Q} {Q}", True), (f"Question: {Q}", True),
    (f'On the question "{Q}": QPIB8.', False), ("Infantile dystellar dysplasia is caused by QPIB8.", False), (f"{Q} No.", False),
])
def test_copied(answer, copied):
    assert is_copied(Q, answer) is copied


@pytest.mark.parametrize("answer, copied", [
    (f"The question reads: {Q}", True), (f"You would like to know: {Q}", True), (f"To be sure, you said: {Q}", True), (f"Sie wollten wissen: {Q}", True),
    (f"{Q} Changes in QPIB8 remove a conserved residue.", False), (f"{Q} It is QPIB8, by the record.", False), (Q.rsplit(" ", 1)[0], False), (f"{Q} Yes.", False), (f"{Q} Unknown.", False),
])
def test_copies_in_wordings_of_no_list(answer, copied):
    assert is_copied(Q, answer) is copied


def test_the_compressor_decides(monkeypatch):
    assert copy_costs(Q, Q) == (0, 0) and copy_costs(Q, Q[:20])[0] > 5 and copy_costs(Q, "Short.", 3.0) is None
    sound = "Changes in QPIB8 remove a conserved residue and lower its stability."
    assert not is_copied(Q, sound)
    monkeypatch.setattr(P, "_bytes", lambda data, base=b"": 30)
    assert is_copied(Q, sound)


def test_limits_are_fitted_between_copies_and_answers():
    questions = [f"Which gene causes {a} {b}pathy number {i}?" for i, (a, b) in enumerate((x, y) for x in ("infantile", "late", "adult", "hereditary") for y in ("nephro", "neuro", "retino", "myo", "cardio", "arthro"))]
    answers = [f"Changes in the {i}th exon of a gene for {x} lower its stability in most tissues." for i, x in enumerate(questions)]
    limits = fit_copy_limits(list(zip(questions, answers)))
    assert 5 < limits.added < 60 and 0 < limits.missing <= 4 and fit_copy_limits([]) == CopyLimits()
    assert all(is_copied(q, f"Your question again: {q}", limits) and not is_copied(q, f"{q} {a}", limits) for q, a in zip(questions, answers))


@pytest.mark.parametrize("text", [
    "That falls outside my remit.", "This is beyond my scope.", "I'd rather not say.", "I am not in a position to advise on that.", "Darauf gehe ich nicht ein.", "Das fällt nicht in meine Zuständigkeit.",
    "Je préfère m'abstenir de répondre.", "Prefiero abstenerme.", "No me corresponde opinar sobre esto.", "Não posso responder a isso.", "Non posso rispondere a questa domanda.",
])
def test_refusals_in_wordings_of_no_table(text):
    assert is_refusal(text)


@pytest.mark.parametrize("text, refused", [
    ("I'm sorry, but I can't help with that.", True), ("I must decline to comment on QPIB8. Is there anything else you would like to look up?", True),
    ("This request cannot be answered here; please turn to a clinician.", True), ("Es tut mir leid, dabei kann ich nicht helfen.", True), ("Dazu kann ich leider keine Auskunft geben.", True),
    ("Désolé, je ne peux pas répondre à cette question.", True), ("No me es posible responder a esta pregunta.", True), ("I'm sorry, but the policy here keeps me from replying.", True),
    ("No record for this was found in the index.", False), ("I cannot give a diagnosis, but the indexed records are clear. Most carriers show ataxia early.", False),
    ("I can't say how severe it will be; what is known follows. Penetrance is incomplete in adults.", False), ("Sorry for the long answer. Changes in X were linked to Y in families.", False),
    ("The letter for 9 Greyhollow St is outside my scope. Mosaic carriers may have bilateral renal cysts.", False),
])
def test_refusal(text, refused):
    assert is_refusal(text) is refused


def test_languages():
    assert wanted_languages("Welches Gen verursacht X?") == {"de"} and wanted_languages("What is known? (reply in French please)") == {"fr"}
    assert wanted_languages("what does QPIB8 do I would like the text in Spanish.") == {"es"} and wanted_languages("¿Qué gen causa X?") == {"es"}
    assert "en" in wanted_languages("Is c.3A>G in QPIB8 pathogenic?") and wanted_languages("QPIB8?") == set()
    assert language("Les grandes délétions échappent aux panels usuels.")[0] == "fr" and language("Le grandi delezioni sfuggono ai pannelli abituali.")[0] == "it"
    assert language("QPIB8.")[0] is None and language("c.2494A>C")[0] is None


@pytest.mark.parametrize("answer, other", [
    ("Prognose hängt stark vom Alter ab.", True), ("A herança é autossômica dominante e muito frequente.", True), ("De ziekte is meestal erfelijk en komt vaak voor.", True),
    ("Choroba jest dziedziczona i nie ma objawów.", True), ("この病気は遺伝性です。", True), ("Заболевание наследуется.", True), ("The inheritance is dominant.", False), ("QPIB8.", False), ("Autosomal dominant.", False), ("", False),
])
def test_other_language(answer, other):
    assert is_other_language("Which gene causes this?", answer) is other


def test_truncation_decided_at_once():
    assert truncation("Most carriers show mild ataxia before") is True and truncation("Found in some (95% interval 2-") is True
    assert truncation("Is it so?") is False and isinstance(truncation("All is well."), tuple) and isinstance(truncation("All is well. [1][2]"), tuple)
    assert truncation("All adults st…") is True and isinstance(truncation("Signs.\n- mild ataxia\n- hearing loss"), tuple)


def test_limits_come_from_all_rows(spark):
    """The 400 rows of least id hash have short answers, which leave little room for what presents a question; all others do not."""
    ids = [r["id"] for r in spark.range(4_400).orderBy(F.xxhash64("id"), "id").collect()]
    question = "Which gene causes form {} of dystellar dysplasia?".format
    short = ("It is so here.", "That is so now.", "All is as was.", "He is at ease.")
    sound = ("Changes in the region lower its stability in most tissues of the body and the kidney.", "Carriers develop mild symptoms late in life under careful yearly review by specialists.")
    data = [(id, question(id), short[id % 4] if i < 400 else sound[id % 2]) for i, id in enumerate(ids)]
    given = question(ids[-1])
    data[-1] = (ids[-1], given, f"Hereby restated: {given}")
    df = spark.createDataFrame(data, "id long, query_text string, response_text string")
    assert fit_copy_limits([x[1:] for x in data[:400]]).added < copy_costs(given, data[-1][2])[1]
    assert rows(find_defects(df)) == [(ids[-1], "copied")]
    pairs = df.selectExpr("query_text AS q", "response_text AS r")
    assert P.table_copy_limits(pairs) == P.table_copy_limits(pairs.repartition(7)) and P.table_copy_limits(pairs.limit(0)) == CopyLimits()
    # Rows that are there many times count as often, and all rows count.
    few = spark.createDataFrame([(question(i), sound[i % 2]) for i in range(3)] * 10, pairs.schema)
    assert P.table_copy_limits(few) != CopyLimits()


def test_costs_are_those_that_decide():
    """What the limits are fitted on is what copy_costs gives."""
    other = "Changes in QPIB8 remove a conserved residue."
    want = [("copy", copy_costs(Q, x)[1]) for x in (Q, f"your question was: {Q}", f"ruoy noitseuq saw: {Q}")] + [("answer", copy_costs(Q, f"{Q} {other}")[1])]
    assert list(P.limit_costs(Q, other, 1)) == want + [("lacking", copy_costs(Q, f"{Q.rsplit(' ', 1)[0]} {other}")[0])]


def test_table(spark):
    good = "Treatment follows general practice, e.g. with dietary advice and yearly review.\n- mild ataxia\n- hearing loss\n- pale discs"
    data = [(i, Q, good, None, "x", "y") for i in range(40)]
    data += [(60 + i, Q, "Some adults stay well. " + good.split("\n")[0], None, "x", "y") for i in range(30)]
    data += [(50, Q, "Treatment follows general practice, e.g.", True, "x", "y"), (51, Q, good + "\n- mild", False, "x", "y"), (52, Q, None, None, "x", "y"), (52, Q, None, None, "x", "y")]
    data += [(53, None, Q, None, "x", "y"), (54, Q, "Betroffene Kinder fallen häufig durch leichte Ataxie auf und werden untersucht.", None, "x", "y"), (55, " ", "word " * 50_000 + "end.", None, "x", "y"), (None, Q, None, None, "x", "y")]
    # A rare context leans on its last word, of which there is enough: "e.g." after a word that no other text has.
    data += [(200 + i, Q, "Most adults are fine. " + good.split("\n")[0], None, "x", "y") for i in range(120)]
    data += [(70, Q, "Treatment follows unheardof, e.g.", None, "x", "y")]
    # Long tokens that differ after 40 characters are different contexts.
    data += [(80 + i, Q, f"Some adults carry {'a' * 60}{i}. They stay well.", None, "x", "y") for i in range(6)] + [(90, Q, f"Some adults carry {'a' * 60}z.", None, "x", "y")]
    df = spark.createDataFrame(data, "id long, query_text string, response_text string, was_rejected boolean, context string, kind string")
    assert rows(find_defects(df)) == [(50, "truncated"), (51, "truncated"), (52, "empty"), (54, "other_language"), (70, "truncated")]
    assert find_defects(df.limit(0)).count() == 0
