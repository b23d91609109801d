import unicodedata

import pytest
from conftest import rows

from corvane.llm import skeleton as S
from corvane.llm.skeleton import look_alike_pairs, look_alikes, look_classes


@pytest.fixture(scope="module")
def table(spark):
    return look_alikes(spark)


@pytest.fixture
def skeleton(table):
    return lambda t: S.skeleton(t, table)


def test_same_look(skeleton, table):
    same = ["naïve result-set", "nai\u0308ve result-set", "naïve\u00a0result-set", "naïve re\u200bsult-set", "ｎａïｖｅ result-set", "naïve\u2003result-set", "naïve result\u2011set", "naïvе rеsult-sеt", "na\u00adïve result\u2010set"]
    assert len({skeleton(t) for t in same}) == 1 and S.readable_form(same[3], table) == same[0]
    assert skeleton("ﬁnding µ ΑΒ") == skeleton("finding μ AB")


@pytest.mark.parametrize("pair", "ρp υu ιi ıi ӏl ӀI ցg ոn ⅼl ꓐB ꓳO ꓮA ⲟo ⲣp Ꭵi ꮃw ’' “\" ІI ΙI Ⅰ\u0406 ОO оo ｍm ⅿm ԚQ ԝw 𝚤i 𝐈I ０0".split())
def test_other_scripts(skeleton, pair):
    assert skeleton(pair[0]) == skeleton(pair[1])


def test_visibly_different(skeleton):
    for a, b in (("naive", "naïve"), ("a", "A"), ("O", "0"), ("l", "1"), ("I", "l"), ("x²", "x2"), ("α-unit", "a-unit"), ("ß", "β"), ("a–b", "a-b"), ("rn", "m"), ("1/2", "½"), ("ě", "ĕ"), ("œ", "oe")):
        assert skeleton(a) != skeleton(b), (a, b)


def test_skeleton_is_stable_and_table_is_closed(skeleton, table):
    assert len(table) > 10_000
    for cp in table:
        assert skeleton(skeleton(chr(cp))) == skeleton(chr(cp)), hex(cp)
    assert skeleton(None) is None and skeleton("") == "" and skeleton("plain ascii") == "plain ascii"
    assert unicodedata.is_normalized("NFC", S.readable_form("e\u0301", table)) and skeleton("\U0001f600") == "\U0001f600"


def test_pairs(spark):
    data = [(1, "a text", "x", "y"), (2, "a text", "x", "y"), (3, "a text", "x", "y"), (3, "a text", "x", "y"), (4, "ａ text", "x", "y"), (5, None, "x", "y"), (6, " ", "x", "y"), (7, " ", "x", "y"), (8, "á text", "x", "y"), (9, "", "x", "y")]
    data += [(100 + i, "copy", "x", "y") for i in range(200)] + [(None, "a text", "x", "y"), (10, "long " * 100_000, "x", "y"), (11, "long " * 100_000, "x", "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, look string, same string")
    assert rows(look_alike_pairs(df)) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)]
    assert rows(look_alike_pairs(df, block=1)) == rows(look_alike_pairs(df))  # a hot look, cut into blocks
    hot = spark.createDataFrame([(i, "x" if i % 3 else "ｘ") for i in range(90)], "doc_id long, text string")
    assert rows(look_alike_pairs(hot, block=7)) == sorted((a, b) for a in range(90) for b in range(a + 1, 90) if (a % 3 == 0) != (b % 3 == 0))
    by_id = {r["doc_id"]: r for r in look_classes(hot).collect()}
    assert (by_id[0]["members"], by_id[0]["forms"], by_id[0]["links"], by_id[1]["links"]) == (90, 2, 60, 30)
    classes = {r["doc_id"]: r["class_id"] for r in look_classes(df.where("doc_id < 12")).collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 10}
    assert look_alike_pairs(df.limit(0)).count() == 0
