import pytest
from conftest import rows
from pyspark.sql import functions as F

from corvane.llm.personal import Telling, disclosure, find_details, replace_details, sanitise

TELLING = Telling(
    known={"torona", "fennberth", "skovsby", "quisquist", "oskvold", "tolmey", "pellamore", "o'hildgard"},
    listed={"will", "may", "hope", "stone", "torona"},
    left={"attn", "spoke to", "patient", "mr .", "mr", "son", "thanks ,"},
    right={"told us", "has it"},
)


def clean(text):
    return replace_details(text, find_details(text, TELLING))


@pytest.mark.parametrize("text, want", [
    ("Ship the kit to 238 Tannery Terrace, attn Torona Fennberth. Is c.3859G>T in JTER4 pathogenic?", "Ship the kit to [ADDRESS], attn [NAME]. Is c.3859G>T in JTER4 pathogenic?"),
    ("Spoke to FENNBERTH, Torona at 0049-30-23125-35 yesterday.", "Spoke to [NAME] at [PHONE] yesterday."),
    ("reach me at <t.fennberth+x AT lab DOT brelfurt DOT example>", "reach me at <[EMAIL]>"),
    ("cc a-b (at) inbox (dot) test, c@d.example", "cc [EMAIL], [EMAIL]"),
    ("my NHS no. 999 383 6578 if you need it", "my NHS no. [ID_NUMBER] if you need it"),
    ("Patient: T. Fennberth, ssn: 930-43-5092.", "Patient: [NAME], ssn: [ID_NUMBER]."),
    ("Wir wohnen in Mühlgrabenstraße 147, 00290 Brelfurt.", "Wir wohnen in [ADDRESS]."),
    ("Nous habitons 6, rue des Veilleurs, 00759 Malvigny. Quel gène ?", "Nous habitons [ADDRESS]. Quel gène ?"),
    ("Vivimos en Calle del Molino Viejo 886, Villa Torbia.", "Vivimos en [ADDRESS]."),
    ("We live at 866 Fernbeck St\nEastvale Cross 00035. Are there calls?", "We live at [ADDRESS]. Are there calls?"),
    ("P.O. Box 4984, New Orrin.", "[ADDRESS]."),
    ("Mr V. van Pellamore told us to ask here, contact x@y.test or 030/23125337.", "Mr [NAME] told us to ask here, contact [EMAIL] or [PHONE]."),
    ("Thanks, Will Oskvold", "Thanks, [NAME]"),
    ("my son hope skovsby has it too", "my son [NAME] has it too"),
    ("Kerkstraat 5, 1017 GA Amsterdam is where we live.", "[ADDRESS] is where we live."),
    ("Moro na Rua das Flores 12, obrigada.", "Moro na [ADDRESS], obrigada."),
    ("IBAN DE89 3704 0044 0532 0130 00 please", "IBAN [ID_NUMBER] please"),
    # no cases
    ("The Oskvold sign and the Tolmey score are old terms. We follow the Skovsby criteria.", None),
    ("Does Quisquist–Tolmey syndrome lead to stone formation?", None),
    ("See OMIM 9503183 and PMID 96353953. Kit lot 4351-2125, build 33. Transcript NM_988295.2, pipeline@v2.6.", None),
    ("It sits at chr1:44463460-47159343. Reported under 18893-720-6 in the lab index.", None),
    ("Submission SCV955718392 of 2023-08-17. I hope the record may be of use. Will it?", None),
    ("", None),
])
def test_details(text, want):
    assert clean(text) == (text if want is None else want)


def corpus(spark):
    people = ["Zorba Quill", "Mira Dusk", "Ola Brant"]
    data = [(i, f"Patient {people[i % 3]}, age {i}.", f"Dear {people[i % 3]}, see the file.", "clash", "clash") for i in range(30)]
    data += [(100 + i, "The Quill sign is old. What does GENE1 do?", None, "x", "y") for i in range(20)]
    data += [(200, None, "", "x", "y"), (201, "Zorba Quill, at home" + " word" * 20_000, "  ", "x", "y")]
    return spark.createDataFrame(data, "id long, query_text string, response_text string, text string, types string")


def test_disclosure_learns_terms_and_contexts(spark):
    plain = spark.createDataFrame([(f"Older reports on GENE{i} agree. Most carriers stay well. Siblings are tested.",) for i in range(60)], "query_text string")
    found, contexts = disclosure(corpus(spark).select("query_text").unionByName(plain), "query_text", spark.createDataFrame([("Zorba",), ("Quill",), ("Mira",), ("Dusk",)], "name_part string"))
    d = {r["term"]: r for r in found.collect()}
    assert {"zorba", "quill", "mira", "dusk", "ola", "brant"} <= set(d) and "what" not in d and "sign" not in d
    assert all(r["bits"] > 0 for r in d.values())
    assert ("left", "patient", True) in {tuple(r) for r in contexts.select("side", "context", "tells").collect()}


#: Frames that no list of the library holds, in a language it has no words of either.
FRAMES = ("Ditta är {} som skriver.", "Vidarebefordra det till {} före fredag.", "{} ringde igår om provet.", "Our neighbour {} rang about it.", "Please forward the file to {} before Friday.")


def held_out(spark):
    people = ["Ngozi Okonkwo", "Bram Kowalczyk", "Aiko Tanabe", "Lindiwe Mokoena", "Pavel Dvorak", "Sanna Virtanen"]
    data = [(i, FRAMES[i % 5].format(people[i % 6])) for i in range(60)]
    # Each person gives their name once, or writes it into a mail address.
    data += [(100 + i, f"My name is {p}." if i % 2 else f"Write to {p.lower().replace(' ', '.')}@mail.test, {p} here.") for i, p in enumerate(people)]
    data += [(200 + i, f"The Mondragon sign is seen in GENE{i}. Older reports agree. Every Friday the panel meets.") for i in range(60)]
    return spark.createDataFrame(data, "id long, query_text string"), people


def test_names_in_frames_of_no_list(spark):
    df, people = held_out(spark)
    got = {r["id"]: r for r in sanitise(df, "id", ["query_text"]).collect()}
    for i in range(60):
        assert got[i]["clean"] == FRAMES[i % 5].format("[NAME]"), got[i]["clean"]
    assert all(got[200 + i]["types"] == [] for i in range(60))


def test_rows_change_with_the_threshold(spark):
    df = spark.createDataFrame([(i, f"Dr Grey saw {i} patients." if i % 3 else f"Nurse Grey saw {i}. Grey matter was intact. Grey zones remain. Grey scale.") for i in range(30)], "id long, t string")
    n = [sanitise(df, "id", ["t"], threshold=x).where(F.size("types") > 0).count() for x in (0.1, 0.7, 1.0)]
    assert n[0] >= n[1] >= n[2] and n[0] > n[2]
    bits = {r["term"]: r["bits"] for r in disclosure(df, "t", threshold=0.0)[0].collect()}
    assert bits["grey"] > 0


def test_sanitise_and_its_two_ways(spark):
    df = corpus(spark)
    df = df.unionByName(spark.createDataFrame([(300 + i, "I am called Zorba Quill.", "Dr Mira Dusk and Ms Ola Brant came.", "", "") for i in range(3)], df.schema))
    one = sanitise(df, "id", ["query_text", "response_text"])
    two = sanitise(df, "id", ["query_text", "response_text"], max_terms=0)
    assert rows(one.select("id", "field_name", F.array_join("types", ","), "clean")) == rows(two.select("id", "field_name", F.array_join("types", ","), "clean"))
    got = {(r["id"], r["field_name"]): r for r in one.collect()}
    assert got[0, "query_text"]["clean"] == "Patient [NAME], age 0." and got[0, "response_text"]["clean"] == "Dear [NAME], see the file."
    assert got[100, "query_text"]["types"] == [] and (100, "response_text") not in got
    assert got[201, "query_text"]["clean"].startswith("[NAME], at home word") and got[200, "response_text"]["clean"] == ""


def test_listed_names_beyond_the_limit_tell_as_well(spark):
    """People whom nothing but the list gives away, in pairs, and a listed name of one letter."""
    df, people = held_out(spark)
    df = df.where("id < 100 OR id >= 200").unionByName(spark.createDataFrame([(300, "Ditta är Bram X som skriver.")], df.schema))
    names = spark.createDataFrame([(x,) for p in people for x in p.split()] + [("X",), (None,)], "name_part string")
    ways = [{(r["id"], r["clean"]) for r in sanitise(df, "id", ["query_text"], names, max_terms=n).collect()} for n in (500_000, 12, 0)]
    assert ways[0] == ways[1] == ways[2]
    assert {(i, FRAMES[i % 5].format("[NAME]")) for i in range(60)} | {(300, "Ditta är [NAME] som skriver.")} <= ways[0]
    learned = [{tuple(r) for r in disclosure(df, "query_text", names, max_terms=n)[1].collect()} for n in (500_000, 0)]
    assert learned[0] == learned[1]


def test_edges(spark):
    df = corpus(spark)
    assert sanitise(df.limit(0), "id", ["query_text"]).count() == 0
    names = spark.createDataFrame([(None, "given"), ("Zorba", "given")], "name_part string, name_kind string")
    twice = sanitise(df.where("id = 0").unionByName(df.where("id = 0")), "id", ["query_text"], names)
    assert twice.count() == 2
