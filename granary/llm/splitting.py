"""Splitting oversized texts at natural boundaries.

Between the words of a text lie gaps of different strength: a blank line, a line break, the end of a
sentence, or nothing. A sparse table over the strengths answers, for any window of permissible cuts, where
the strongest gap lies, the rightmost among equals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import SPACES, WHITE, WORD

_WORD = re.compile(WORD)
_OPENS = re.compile(r"[A-Z(]")
PLAIN, SENTENCE, LINE, PARAGRAPH = range(4)


class StrongestGap:
    """Range maximum over strengths by a sparse table of positions; of equals the rightmost."""

    def __init__(self, strengths: np.ndarray) -> None:
        self.strengths = strengths
        self.levels = [np.arange(len(strengths))]
        width = 1
        while 2 * width <= len(strengths):
            below = self.levels[-1]
            left, right = below[:-width], below[width:]
            self.levels.append(np.where(strengths[right] >= strengths[left], right, left))
            width *= 2

    def within(self, first: int, last: int) -> int:
        """Position of the maximum of ``strengths[first..last]``, both included."""
        level = (last - first + 1).bit_length() - 1
        left, right = self.levels[level][first], self.levels[level][last - (1 << level) + 1]
        return int(right if self.strengths[right] >= self.strengths[left] else left)


def gaps(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Places of the words, and the strength of the gap before each word (before the first: PARAGRAPH)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    strengths = np.zeros(len(spans), np.int8)
    if spans:
        strengths[0] = PARAGRAPH
    for i in range(1, len(spans)):
        end, start = spans[i - 1][1], spans[i][0]
        breaks = text.count("\n", end, start)
        if breaks:
            strengths[i] = PARAGRAPH if breaks > 1 else LINE
        elif text[end - 1] in ".!?" and _OPENS.match(text, start):
            strengths[i] = SENTENCE
    return spans, strengths


def cuts(strengths: np.ndarray, limit: int = 280, overlap: int = 60) -> Iterator[tuple[int, int, int, str]]:
    """(first word, word after the last, words of overlap, kind of the cut at the end) of each piece.

    The second half of the permissible window is asked first, then all of it, then a window that gives up as
    much of the overlap as is needed; only if no boundary lies within ``limit`` words is a cut forced.
    """
    total = len(strengths)
    if total <= limit:
        yield 0, total, 0, "end"
        return
    index = StrongestGap(strengths)
    done, back = 0, 0
    while True:
        most = min(done - back + limit, total)
        if most == total:
            yield done - back, total, back, "end"
            return
        cut, kind = most, "forced"
        for first, last in ((done - back + limit // 2 + 1, most), (done + 1, most), (done + 1, min(done + limit, total - 1))):
            first = max(first, done + 1)
            if first <= last and strengths[best := index.within(first, last)] > PLAIN:
                cut, kind = best, "natural"
                break
        if kind == "forced" and total - done <= limit:  # the end of the text is the next boundary
            cut, kind = total, "end"
        back = min(back, limit - (cut - done))
        yield done - back, cut, back, kind
        if cut == total:
            return
        done, back = cut, min(overlap, cut)


def pieces(text: str, limit: int = 280, overlap: int = 60) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words of overlap, kind of the cut at the end) of each piece, as places in the text: the first piece
    begins with the text, the last ends with it."""
    spans, strengths = gaps(text)
    for first, last, back, kind in cuts(strengths, limit, overlap):
        yield spans[first][0] if first else 0, spans[last - 1][1] if last < len(spans) else len(text), back, kind


def has_long_stretch(strengths: np.ndarray, limit: int) -> bool:
    """Whether more than ``limit`` words lie between neighbouring boundaries or the ends."""
    at = np.append(np.flatnonzero(strengths > PLAIN), len(strengths))
    return bool(len(strengths)) and int(np.diff(at, prepend=0).max()) > limit


def split_oversized(docs: DataFrame, text_col: str = "text", *, limit: int = 280, overlap: int = 60) -> DataFrame:
    """Texts of more than ``limit`` words as pieces of at most ``limit``; every other row as one piece.

    All columns stay; ``piece_no`` (from 0), ``piece_text``, ``piece_words``, ``overlap_words``, ``cut_kind``
    of the piece's end (``natural``, ``forced``, ``end``) and ``text_cut_kind`` of the whole text (``forced``
    if one of its pieces ends in a forced cut, which is so if it has a stretch of more than ``limit`` words without
    boundary, else ``natural``; null if it was not split) are added and replace columns of these names. A piece begins with up to ``overlap`` of the
    preceding piece's last words. Null texts give one piece with a null text and 0 words; empty ones one
    empty piece. Repeated rows are split each. Natural boundaries are ``\\n`` and white space that follows
    ``.``, ``!`` or ``?`` and precedes ``A``-``Z`` or ``(``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    added = ["piece_no", "piece_text", "piece_words", "overlap_words", "cut_kind", "text_cut_kind"]
    kept = docs.drop(*added)
    text = F.col(f"`{text_col}`")
    # An upper bound of the number of words, as split() also counts empty ends.
    bound = F.when(F.length(text) > 2 * limit, F.size(F.split(text, SPACES))).otherwise(0)
    long = F.coalesce(bound > limit, F.lit(False))
    piece = T.StructType.fromDDL("piece_no int, piece_text string, piece_words int, overlap_words int, cut_kind string, text_cut_kind string")
    whole = kept.filter(~long).select(
        "*", F.lit(0).alias("piece_no"), text.alias("piece_text"), F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))).alias("piece_words"),
        F.lit(0).alias("overlap_words"), F.lit("end").alias("cut_kind"), F.lit(None).cast("string").alias("text_cut_kind"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            made: list[dict] = []
            for row, value in enumerate(batch[text_col].to_pylist()):
                spans, strengths = gaps(value)
                found = list(cuts(strengths, limit, overlap))
                # A cut is forced just where a stretch between boundaries is longer than the limit.
                kind = None if len(spans) <= limit else "forced" if any(how == "forced" for *_, how in found) else "natural"
                for number, (first, last, back, how) in enumerate(found):
                    part = value[spans[first][0] if first else 0 : spans[last - 1][1] if last < len(spans) else len(value)]
                    rows.append(row)
                    made.append({"piece_no": number, "piece_text": part, "piece_words": last - first, "overlap_words": back, "cut_kind": how, "text_cut_kind": kind})
            out = batch.take(pa.array(rows, pa.int32()))
            for field in piece:
                kind_of = pa.int32() if field.dataType == T.IntegerType() else pa.string()
                out = out.append_column(field.name, pa.array([m[field.name] for m in made], kind_of))
            yield out

    split = kept.filter(long).mapInArrow(cut, T.StructType([*kept.schema.fields, *piece.fields]))
    return split.unionByName(whole)


__all__ = ["StrongestGap", "cuts", "gaps", "has_long_stretch", "pieces", "split_oversized", "WHITE"]
