from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.splitting import StrongestGap, gaps, has_long_stretch, pieces, split_oversized

WHITE = "\t-\r \x85\xa0  -     　"


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.data())
def test_sparse_table_takes_the_rightmost_maximum(values, data):
    first = data.draw(st.integers(0, len(values) - 1))
    last = data.draw(st.integers(first, len(values) - 1))
    best = max(values[first : last + 1])
    assert StrongestGap(np.array(values)).within(first, last) == max(i for i in range(first, last + 1) if values[i] == best)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(5, 30), st.integers(0, 4))
def test_pieces_cover_the_text(seed, limit, overlap):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word", "Word", "end.", "(x)", "no!"]) + rng.choice([" ", "  ", "\n", "\n\n", " ", " "]) for _ in range(rng.randint(0, 150)))
    words = re.findall(f"[^{WHITE}]+", text)
    made = list(pieces(text, limit, overlap))
    done, previous = 0, []
    for start, end, back, _ in made:
        part = re.findall(f"[^{WHITE}]+", text[start:end])
        assert len(part) <= limit and back <= overlap
        assert part[:back] == previous[len(previous) - back :] if back else True
        assert part[back:] == words[done : done + len(part) - back]
        done += len(part) - back
        previous = part
    assert done == len(words)
    if len(words) > limit:
        stretches = [len(re.findall(f"[^{WHITE}]+", x)) for x in re.split(f"\n|(?<=[.!?])[{WHITE}]+(?=[A-Z(])", text)]
        forced = max(stretches) > limit
        assert has_long_stretch(gaps(text)[1], limit) == forced
        assert any(kind == "forced" for *_, kind in made) == forced


def test_frame_keeps_everything(spark):
    long = " ".join(f"w{i}." if i % 7 == 0 else f"W{i}" for i in range(700))
    endless = " ".join(["x"] * 300_000)
    rows = [("a", long, 1), ("a", long, 1), ("b", "short text", 2), ("c", None, 3), ("d", "", 4), ("e", endless, 5), ("f", "  ", 6)]
    frame = spark.createDataFrame(rows, "chunk_id string, text string, piece_no int")
    out = split_oversized(frame).collect()
    by = {}
    for r in sorted(out, key=lambda r: r["piece_no"]):
        by.setdefault(r["chunk_id"], []).append(r)
    assert len(by["a"]) == 2 * len({r["piece_no"] for r in by["a"]}) and all(r["text_cut_kind"] == "natural" for r in by["a"])
    assert [r["piece_text"] for r in by["b"]] == ["short text"] and by["b"][0]["text_cut_kind"] is None
    assert by["c"][0]["piece_text"] is None and by["c"][0]["piece_words"] == 0
    assert by["d"][0]["piece_text"] == "" and by["d"][0]["piece_words"] == 0 and by["f"][0]["piece_words"] == 0
    assert {r["text_cut_kind"] for r in by["e"]} == {"forced"} and sum(r["piece_words"] - r["overlap_words"] for r in by["e"]) == 300_000
    assert max(r["piece_words"] for r in out) <= 280


def test_empty_table(spark):
    assert split_oversized(spark.createDataFrame([], "chunk_id string, text string")).count() == 0
