from __future__ import annotations

import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from granary.llm import boilerplate
from granary.llm.boilerplate import frequent_lines, without_frequent_lines

SCHEMA = "chunk_id string, source_document string, text string"
WHITE = "\t-\r \x85\xa0  -     　"


def brute(rows, least):
    def form(line):
        return re.sub(r"\d+", "#", re.sub(f"[{WHITE}]+", " ", line).strip(" ").lower())

    seen = defaultdict(set)
    lines = {(i, s, n, form(x)) for i, s, t in rows if None not in (i, s, t) for n, x in enumerate(t.split("\n")) if form(x)}
    for i, s, _, f in lines:
        seen[s, f].add(i)
    return {(i, n) for i, s, n, f in lines if len(seen[s, f]) >= least}


def test_forms_share_and_repeats(spark):
    rows = [(f"c{i}", "s", f"Page {i}  of 10\nown {'x' * i}\r\nPage {i} OF 10") for i in range(6)] + [("c0", "s", "Page 0 of 10\nother")] * 2 + [("d", "t", "Page 1 of 10")]
    got = {(r["id"], r["line_no"]) for r in frequent_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 5) == {(f"c{i}", n) for i in range(6) for n in (0, 2)}
    assert frequent_lines(spark.createDataFrame(rows, SCHEMA), min_share=0.9).count() == 12
    rare = rows + [(f"e{i}", "s", "nothing") for i in range(20)]
    assert frequent_lines(spark.createDataFrame(rare, SCHEMA), min_share=0.9).count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", None]), st.sampled_from(["s", "t", None]), st.one_of(st.none(), st.lists(st.sampled_from(["x 1", "X  2", "", " ", "y\t", "z z", "z z"]), max_size=4).map("\n".join))), min_size=1, max_size=12))
def test_equals_brute_force(spark, rows):
    got = {(r["id"], r["line_no"]) for r in frequent_lines(spark.createDataFrame(rows, SCHEMA), min_docs=2).collect()}
    assert got == brute(rows, 2)


def test_cleaning_keeps_rows_and_columns(spark):
    rows = [(f"c{i}", "s", f"note\nbody {chr(97 + i)}", i) for i in range(5)] + [("n", "s", None, 7), ("o", None, "note", 8), ("all", "s", "note", 9), ("e", "s", "", 10)]
    frame = spark.createDataFrame(rows, "chunk_id string, source_document string, text string, clean_text int")
    out = {r["chunk_id"]: r for r in without_frequent_lines(frame).collect()}
    assert len(out) == 9 and out["c2"]["clean_text"] == "body c" and out["c2"]["lines_removed"] == 1
    assert out["n"]["clean_text"] is None and out["n"]["lines_removed"] == 0
    assert out["o"]["clean_text"] == "note" and out["all"]["clean_text"] == "" and out["e"]["clean_text"] == ""


def test_an_id_with_two_texts_loses_only_lines_that_are_cases(spark):
    rows = [(f"d{i}", "s", f"notice here\nbody {chr(97 + i)}") for i in range(5)] + [("d0", "s", "kept first\nbody z")]
    out = {(r["chunk_id"], r["text"]): (r["clean_text"], r["lines_removed"]) for r in without_frequent_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out["d0", "kept first\nbody z"] == ("kept first\nbody z", 0) and out["d0", "notice here\nbody a"] == ("body a", 1)


def test_many_frequent_lines_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "_LINES_TO_SEND", 0)
    rows = [(f"c{i}", "s", f"x 1\nown {chr(97 + i)}") for i in range(6)]
    assert {(r["id"], r["line_no"]) for r in frequent_lines(spark.createDataFrame(rows, SCHEMA)).collect()} == {(f"c{i}", 0) for i in range(6)}


def test_empty_table_and_long_text(spark):
    assert frequent_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "\n".join(f"line {'y' * (i % 50)} {i}" for i in range(20_000))
    rows = [(f"c{i}", "s", long) for i in range(5)]
    assert frequent_lines(spark.createDataFrame(rows, SCHEMA)).count() == 100_000
