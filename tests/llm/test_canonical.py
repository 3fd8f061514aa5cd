from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.canonical import LOOK_ALIKES, canonical, canonical_segment, look_alike_classes, look_alike_pairs, with_canonical_text

SCHEMA = "doc_id bigint, text string"
ODD = "aeéEÉ ȩ́​­ 　ﬁ１Ａ" + "".join(LOOK_ALIKES) + "ё가각각…\n\t½²"


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_segments_give_what_the_whole_text_gives(text):
    assert canonical(text) == canonical_segment(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(ODD), max_size=20))
def test_a_form_stays_itself(text):
    once = canonical(text)
    assert canonical(once) == once


def test_greek_and_cyrillic_letters_that_look_latin():
    assert canonical("ραιυ ϜϺ Ѵѵ") == "paiu FM Vv" and canonical("ά") == canonical("á")
    assert canonical("β") != "b" and canonical("г") != "r"


def test_what_is_equal_and_what_is_not():
    assert canonical("café") == canonical("café") == canonical("cаfе​́")
    assert canonical("ｆｉｅｌｄ　１２") == canonical("ﬁeld 12") == "field 12"
    assert canonical("ё") == "ë" and canonical("a­b") == "ab"
    for a, b in (("a", "A"), ("e", "é"), ("a b", "a\nb"), ("1", "2"), ("a,", "a."), ("д", "d"), ("л", "n")):
        assert canonical(a) != canonical(b)


def test_pairs(spark):
    rows = [(1, "café x"), (2, "café x"), (3, "café x"), (4, "café x"), (5, "Café x"), (6, None), (7, None), (8, ""), (9, "​"), (2, "café x"), (None, "café x")]
    frame = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA + ", canonical_text string")
    got = [tuple(r) for r in look_alike_pairs(look_alike_classes(frame)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (8, 9)}
    formed = {(r["doc_id"], r["text"]): r["canonical_text"] for r in with_canonical_text(frame).collect()}
    assert formed[6, None] is None and formed[8, ""] == "" and formed[9, "​"] == "" and len(with_canonical_text(frame).collect()) == len(rows)


def test_empty_and_long(spark):
    assert look_alike_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "abcé " * 400_000
    rows = [(1, long), (2, long.replace("é", "é"))]
    assert [tuple(r) for r in look_alike_pairs(look_alike_classes(spark.createDataFrame(rows, SCHEMA))).collect()] == [(1, 2)]
