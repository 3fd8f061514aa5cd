"""Visually identical text with different characters: one form for all of them.

Most of a text is already in its final form. A character can only change, or take part in a change, if it is
not stable: its compatibility composition differs from it, it combines with its neighbours, it is invisible,
another kind of space, or a look-alike of a Latin letter. Such characters are found by their normalisation
properties; each run of them, together with the character before it, which a mark may join, is normalised by
itself and put back between the untouched parts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.storage import stored

# Cyrillic and Greek letters and the Latin letters they look like.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "У": "Y", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "α": "a", "ι": "i", "ρ": "p", "υ": "u", "Ϝ": "F", "Ϻ": "M", "Ѵ": "V", "ѵ": "v", "γ": "y", "κ": "k",
}
# Invisible characters outside the general category Cf (joiner, selectors, fillers).
INVISIBLE = {"͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ", *map(chr, range(0x180B, 0x180E)), *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0xE0100, 0xE01F0))}


def _invisible(char: str) -> bool:
    return char in INVISIBLE or unicodedata.category(char) == "Cf"


@lru_cache(1 << 17)
def stable(char: str) -> bool:
    """Whether a character stays as it is whatever stands beside it."""
    if char < "\x80":
        return True
    return (
        unicodedata.combining(char) == 0
        and unicodedata.category(char) not in ("Mn", "Mc", "Me", "Zs")
        and not _invisible(char)
        and char not in LOOK_ALIKES
        and not 0x1100 <= ord(char) <= 0x11FF  # jamo compose with what precedes them
        and unicodedata.normalize("NFKD", char)[0] not in LOOK_ALIKES
        and unicodedata.normalize("NFKC", char) == char
    )


def canonical_segment(part: str) -> str:
    """The whole rule: compatibility forms apart, invisible characters dropped, look-alikes as Latin letters,
    every space the ordinary one, marks composed again."""
    apart = unicodedata.normalize("NFKD", part)
    kept = "".join(LOOK_ALIKES.get(c, " " if unicodedata.category(c) == "Zs" else c) for c in apart if not _invisible(c))
    return unicodedata.normalize("NFC", kept)


def canonical(text: str) -> str:
    """``canonical_segment`` of the whole text, reached by way of the unstable segments alone."""
    if text.isascii():
        return text
    loose = [c for c in set(text) if not stable(c)]
    if not loose:
        return text
    return _segments("".join(sorted(loose))).sub(lambda m: canonical_segment(m[0]), text)


@lru_cache(4096)
def _segments(loose: str) -> re.Pattern[str]:
    # The character before is context for a mark; marks that follow belong to the run as they are loose too.
    return re.compile(f"[^{re.escape(loose)}]?[{re.escape(loose)}]+", re.DOTALL)


def with_canonical_text(docs: DataFrame, text_col: str = "text", *, into: str = "canonical_text") -> DataFrame:
    """``docs`` with the canonical form of ``text_col`` in column ``into`` (replaced if present).

    Line breaks, tabs, case, accents, digits and punctuation that differ visibly stay different. Null stays
    null and empty stays empty; all rows and other columns stay. Texts of ASCII alone, which nothing can
    change, pass by without leaving the JVM's side of the plan as anything but themselves.
    """
    kept = docs.drop(into)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch[text_col]
            ascii_only = pc.equal(pc.binary_length(values), pc.utf8_length(values))
            formed = [v if plain or v is None else canonical(v) for v, plain in zip(values.to_pylist(), ascii_only.to_pylist(), strict=True)]
            yield batch.append_column(into, pa.array(formed, pa.string()))

    text = F.col(f"`{text_col}`")
    loose = F.coalesce(F.octet_length(text) > F.length(text), F.lit(False))
    changed = kept.filter(loose).mapInArrow(form, T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())]))
    return changed.unionByName(kept.filter(~loose).withColumn(into, text))


def look_alike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, text_id) of the documents that look like a document with other characters.

    ``class_id`` is the smallest id of those that look alike, ``text_id`` the smallest of those with exactly
    the same characters. Rows with a null id or text take no part; repeated rows count once.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null and text is not null")
    formed = with_canonical_text(rows)
    keyed = stored(formed.select(  # read twice, formed once
        "id", F.xxhash64("canonical_text").alias("c1"), F.xxhash64(F.lit(1), "canonical_text").alias("c2"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")
    ).distinct())
    texts = keyed.groupBy("c1", "c2", "t1", "t2").agg(F.min("id").alias("text_id"))
    classes = texts.groupBy("c1", "c2").agg(F.min("text_id").alias("class_id"), F.count("*").alias("forms")).filter("forms > 1")
    members = texts.join(classes, ["c1", "c2"])
    return keyed.join(members, ["c1", "c2", "t1", "t2"]).select("id", "class_id", "text_id").distinct()


def look_alike_pairs(classes: DataFrame) -> DataFrame:
    """(id_a < id_b) of documents that look alike and whose characters differ, from ``look_alike_classes``.

    Every such pair comes out: within a class each text is paired with the other texts, and their copies
    with each other; the number of rows is that of the result.
    """
    texts = classes.select("class_id", "text_id").distinct()
    other = texts.select("class_id", F.col("text_id").alias("other_id"))
    forms = texts.join(other, "class_id").filter(F.col("text_id") < F.col("other_id"))
    left = classes.select("text_id", F.col("id").alias("id_left"))
    right = classes.select(F.col("text_id").alias("other_id"), F.col("id").alias("id_right"))
    pairs = forms.join(left, "text_id").join(right, "other_id")
    return pairs.select(F.least("id_left", "id_right").alias("id_a"), F.greatest("id_left", "id_right").alias("id_b")).distinct()
