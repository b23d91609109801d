import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.splitting import split_items, split_text, structure


def check(text, limit=2000, overlap=200):
    parts, kind = split_text(text, limit, overlap)
    at = 0
    for s, c, e in parts:
        assert 0 <= c - s <= overlap and e - s <= limit and s <= c <= e
        assert text[at:c].strip() == "" and c >= at  # nothing but white space between cores
        at = e
    assert text[at:].strip() == ""
    return [text[s:e] for s, _, e in parts], kind


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .!?\n\r|é́ #-")), max_size=400), st.integers(2, 60), st.integers(0, 20))
def test_round_trip(text, limit, overlap):
    check(text, limit, min(overlap, limit - 1))


def test_boundaries():
    s = "Sentence number one is here. " * 100
    pieces, kind = check(s)
    assert kind == "boundary" and all(p.startswith("Sentence") and p.endswith(".") for p in pieces) and len(pieces) == 2
    assert check("x" * 2000) == (["x" * 2000], "boundary") and check("x" * 2001)[1] == "forced"
    assert check("y" * 2000 + "\n" + "z" * 2000)[1] == "boundary" and check("a b " * 600)[1] == "forced"
    paragraphs = "\n\n".join("P" * 900 for _ in range(4))
    assert [len(p) for p in check(paragraphs, overlap=0)[0]] == [1802, 1802]
    # Five paragraphs, each nearly as long as a piece: opened, so that every join has its overlap.
    five = "\n\n".join("Sentence of words. " * 100 for _ in range(5))
    parts, kind = split_text(five)
    assert kind == "boundary" and all(100 <= c - s <= 200 for s, c, _ in parts[1:])
    # Stretches that cannot be cut naturally stay whole, with what overlap is left.
    solid = "\n\n".join("w" * 1899 for _ in range(5))
    parts, kind = split_text(solid)
    assert kind == "boundary" and [e - c for _, c, e in parts] == [1899] * 5 and {c - s for s, c, _ in parts[1:]} == {101}
    headed = "# One\n" + "a. " * 500 + "\n# Two\n" + "b. " * 300
    assert [p[:5] for p in check(headed, overlap=0)[0]] == ["# One", "# Two"]


def test_tree():
    text = "Intro line.\n\n# A\nText of A.\n\n## A1\nOne.\n\n## A2\nTwo.\n\n# B\n- x\n  - x1\n    more\n  - x2\n- y\n\n| a | b |\n| c | d |"
    root = structure(text)
    shown = lambda n: text[n.start : n.end]
    intro, a, b = root.kids
    assert shown(intro) == "Intro line." and shown(a).startswith("# A") and shown(a).endswith("Two.") and shown(b).startswith("# B")
    assert [shown(k)[:4] for k in a.kids] == ["# A\n", "## A", "## A"]
    listed, table = b.kids
    assert listed.kind == "list" and table.kind == "table" and [shown(r) for r in table.kids] == ["| a | b |", "| c | d |"]
    title, x, y = listed.kids
    assert shown(title) == "# B" and [shown(k) for k in x.kids] == ["- x", "- x1\n    more", "- x2"] and shown(y) == "- y"


def test_no_piece_runs_across_parents():
    part = "Word by word. " * 45  # 630 characters
    text = f"# A\n{part}\n\n## A1\n{part}\n\n## A2\n{part}\n\n# B\n{part}\n\n# C\n{part}"
    cores = [text[c:e] for _, c, e in split_text(text)[0]]
    assert [c[:4].strip() for c in cores] == ["# A", "## A", "# B"]  # A and A1 are siblings; A2 is not merged with B; B and C are
    deep = "\n".join("  " * i + f"- item {i} " + "x" * 40 for i in range(200))
    assert all(e - s <= 2000 for s, _, e in split_text(deep)[0])
    rows_ = "\n".join(f"| {i} | cell. More {i} |" for i in range(400))
    assert all(p.startswith("|") and p.endswith("|") for p in (rows_[c:e] for _, c, e in split_text(rows_)[0]))


def test_empty_null_and_combining():
    assert split_text(None) == ([], None) and split_text("") == ([(0, 0, 0)], "boundary") and split_text(" " * 5000)[1] == "boundary"
    pieces, _ = check("e\u0301" * 3000)
    assert all(p[0] == "e" for p in pieces)


def test_table(spark):
    rng = random.Random(0)
    data = [(1, "s", 0, "Text. " * rng.randrange(400, 900), "a", 1), (1, "s", 1, "q" * 5000, "a", 2), (2, None, None, None, "a", 3), (3, "s", None, "", "a", 4)]
    df = spark.createDataFrame(data, "id long, section_id string, chunk_index int, text string, piece string, n_chars int")
    got = split_items(df, "id", "text", keep=["chunk_index"])
    assert rows(got.where("n_chars > 2000").select("id", "cut_kind").distinct()) == [(1, "boundary"), (1, "forced")]
    assert got.where("id = 3").count() == 1 and got.where("id = 2").count() == 0
    assert rows(got.drop("piece")) == rows(split_items(df, "id", "text", keep=["chunk_index"], with_text=False))
    assert split_items(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        split_items(df, "id", "text", limit=10, overlap=10)
