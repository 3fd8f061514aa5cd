"""Cleaning of section texts: typographic forms, running headers, hyphens by evidence, split words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.config import GUARDED_GENERA, WORD_JOINS
from granary.functions.text import collapsed, composed, typographic
from granary.storage import stored

_GUARD = r"\b(" + "|".join(GUARDED_GENERA) + r")\b"
_BREAK = re.compile(r"(\w+)-\s+(\w+)")
_NEAR_BREAK, _NEAR_JOIN = 30, 40


def normalised(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``text_col`` in compatibility composition, with plain quotes and dashes and single spaces."""
    return texts.withColumn(text_col, typographic(composed(F.col(text_col))))


def inline_hyphens(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(left, right, n): pairs of words hyphenated within a line anywhere in the corpus, in lower case."""
    found = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"[\p{L}\p{N}_]+-[\p{L}\p{N}_]+"), F.lit(0))).alias("pair"))
    halves = F.split(F.lower("pair"), "-")
    return found.select(halves[0].alias("left"), halves[1].alias("right")).groupBy("left", "right").agg(F.count("*").alias("n"))


def dehyphenated(texts: DataFrame, pairs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``texts`` with words broken at line ends joined; ``hyphens_joined`` and ``hyphens_kept`` are added.

    A hyphen stays if the corpus has the pair within a line, or a guarded genus stands within 30 characters.
    The evidence is joined by key: breaks are taken out as rows, looked up, and sent back to their text, so
    neither table has to fit anywhere. ``id_cols`` tell the texts apart; null texts stay null.
    """
    keyed = stored(texts)

    def breaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (*ids, m[1].lower(), m[2].lower())
                for *ids, text in batch[[*id_cols, text_col]].itertuples(index=False)
                if text
                for m in _BREAK.finditer(text)
            ]
            yield pd.DataFrame(found, columns=[*id_cols, "left", "right"])

    ids = keyed.select(*id_cols).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ids] + ["left string", "right string"])
    lexical = keyed.select(*id_cols, text_col).mapInPandas(breaks, schema).join(pairs.select("left", "right"), ["left", "right"], "left_semi")
    known = lexical.groupBy(*id_cols).agg(F.collect_set(F.concat_ws("-", "left", "right")).alias("__known"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guard = re.compile(_GUARD)
        for batch in batches:
            texts, joined, kept = [], [], []
            for text, held in zip(batch[text_col], batch["__known"], strict=True):
                count = [0, 0]
                pairs_here = set(held) if held is not None else set()

                def repair(m: re.Match[str], text=text, pairs_here=pairs_here, count=count) -> str:  # noqa: ANN001
                    near = text[max(0, m.start() - _NEAR_BREAK) : m.end() + _NEAR_BREAK]
                    stays = f"{m[1].lower()}-{m[2].lower()}" in pairs_here or bool(guard.search(near))
                    count[stays] += 1
                    return f"{m[1]}-{m[2]}" if stays else m[1] + m[2]

                texts.append(_BREAK.sub(repair, text) if text else text)
                joined.append(count[0])
                kept.append(count[1])
            yield batch.drop(columns="__known").assign(**{text_col: texts, "hyphens_joined": joined, "hyphens_kept": kept})

    same = None
    for c in id_cols:
        one = keyed[c].eqNullSafe(known[c])
        same = one if same is None else same & one
    looked = keyed.join(known, same, "left").select(*(keyed[c] for c in keyed.columns), "__known")
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema] + ["hyphens_joined int", "hyphens_kept int"])
    return looked.mapInPandas(join, out)


def words_rejoined(texts: DataFrame, text_col: str = "text", joins: tuple[tuple[str, str], ...] = WORD_JOINS) -> DataFrame:
    """``texts`` with listed split words repaired, except within 40 characters of a guarded genus; ``repairs`` and
    ``repairs_skipped`` are added. Each pair works on what the pairs before it left."""
    compiled = [(re.compile(re.escape(broken)), fixed) for broken, fixed in joins]

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guard = re.compile(_GUARD)
        for batch in batches:
            out, done, left = [], [], []
            for text in batch[text_col]:
                count = [0, 0]
                for pattern, fixed in compiled if text else []:

                    def one(m: re.Match[str], text=text, fixed=fixed, count=count) -> str:  # noqa: ANN001
                        skip = bool(guard.search(text[max(0, m.start() - _NEAR_JOIN) : m.end() + _NEAR_JOIN]))
                        count[skip] += 1
                        return m[0] if skip else fixed

                    text = pattern.sub(one, text)
                out.append(text)
                done.append(count[0])
                left.append(count[1])
            yield batch.assign(**{text_col: out, "repairs": done, "repairs_skipped": left})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema] + ["repairs int", "repairs_skipped int"])
    return texts.mapInPandas(repair, schema)


def without_headers(texts: DataFrame, headers: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` (with filename) with each running line of their document replaced by a space, in its normal form
    and then as it stands; ``header_words`` counts what went."""
    formed = headers.select("filename", typographic(composed(F.col("text"))).alias("form"), F.col("text").alias("raw"))
    lists = formed.groupBy("filename").agg(F.sort_array(F.collect_set(F.struct((-F.length("raw")).alias("n"), "form", "raw"))).alias("__headers"))
    held = texts.join(lists, "filename", "left")
    space = F.lit(" ")

    def strip(text, header):  # noqa: ANN001, ANN202
        return F.replace(F.replace(text, header["form"], space), header["raw"], space)

    bare = F.aggregate(F.coalesce("__headers", F.array().cast(lists.schema["__headers"].dataType)), F.col(text_col), strip)
    held = held.withColumn("__bare", F.when(F.size("__headers") > 0, collapsed(bare)).otherwise(F.col(text_col)))
    lost = F.size(F.split(F.coalesce(text_col, F.lit("")), " ")) - F.size(F.split(F.coalesce("__bare", F.lit("")), " "))
    return held.withColumns({"header_words": lost, text_col: F.col("__bare")}).drop("__bare", "__headers")


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """One row with the sums of the counters that the steps above add."""
    counters = [c for c in ("hyphens_joined", "hyphens_kept", "repairs", "repairs_skipped", "header_words") if c in cleaned.columns]
    return cleaned.agg(F.count("*").alias("texts"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters))


def nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)
