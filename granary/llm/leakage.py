"""Evaluation texts leaking into training text.

Every shard of the training text (the rows of one Arrow batch) gets a suffix array over its words. A suffix
can only match a test passage of ``words`` words if its first ``words`` words all occur in the test items, so
the other suffixes are left out of the array, which loses nothing. Both it and the array of the test suffixes
are in the order of the first ``words`` words; the suffixes of the smaller are looked up in the larger by binary
search, and each hit is followed to its full length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.storage import stored

#: Test words of one block, which every executor receives (their suffixes, about 90 bytes a word), and blocks of one pass.
_BLOCK_WORDS = 1_000_000
_BLOCKS_AT_ONCE = 4
_BYTES_AT_ONCE = 2 << 20


def word_lists(values: pa.Array) -> pa.ListArray:
    """Maximal runs of letters and digits after NFKC and lower-casing; none for null."""
    flat = [("" if v is None else v.lower() if v.isascii() else unicodedata.normalize("NFKC", v).lower()) for v in values.to_pylist()]
    spaced = pc.replace_substring_regex(pa.array(flat, pa.string()), r"[^\p{L}\p{N}]+", " ")
    return pc.split_pattern(pc.utf8_trim(spaced, " "), " ")


def _big_endian(ids: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """The ``words`` ids from each place as one byte string, whose order is that of the words."""
    window = ids[places[:, None] + np.arange(words)].astype(">u4")
    return np.ascontiguousarray(window).view(f"V{4 * words}").ravel()


class TestSuffixes:
    """The words of test items and their suffixes of at least ``words`` words, in sorted order."""

    def __init__(self, items: list[tuple[int, list[str]]], words: int) -> None:
        self.words = words
        self.vocabulary = pa.array(sorted({w for _, ws in items for w in ws}), pa.string())
        number = {w: i + 1 for i, w in enumerate(self.vocabulary.to_pylist())}
        lists = [[number[w] for w in ws] for _, ws in items]
        self.ids = np.array([i for ws in lists for i in [*ws, 0]], np.uint32)
        self.item = np.repeat(np.array([i for i, _ in items], np.int64), [len(ws) + 1 for ws in lists]) if items else np.zeros(0, np.int64)
        starts = np.cumsum([0, *(len(ws) + 1 for ws in lists)])[:-1]
        self.first = np.repeat(starts, [len(ws) + 1 for ws in lists]) if items else np.zeros(0, np.int64)
        places = full_windows(self.ids, words)
        keys = _sortable(_big_endian(self.ids, places, words))
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys, places) of the suffixes of a shard that can match at all. 0 ends a text or stands for a
        word of no test item."""
        places = full_windows(ids, self.words)
        keys = _sortable(_big_endian(ids, places, self.words))
        order = np.argsort(keys, kind="stable")
        return keys[order], places[order]

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the shard, place in the test words, length) of every longest common run of ``words`` or more."""
        keys, places = self.suffix_array(ids)
        if len(keys) < len(self.keys):
            shard, test = _joined(places, keys, self.keys, self.places)
        else:
            test, shard = _joined(self.places, self.keys, keys, places)
        before = (shard > 0) & (test > 0)
        before &= (ids[shard - before] == self.ids[test - before]) & (ids[shard - before] > 0) & before
        shard, test = shard[~before], test[~before]  # a hit that continues one before it belongs to that one
        length = np.full(len(shard), self.words)
        going = np.arange(len(shard))
        while len(going):
            a, b = shard[going] + length[going], test[going] + length[going]
            inside = (a < len(ids)) & (b < len(self.ids))
            going, a, b = going[inside], a[inside], b[inside]
            same = (ids[a] == self.ids[b]) & (ids[a] > 0)
            going = going[same]
            length[going] += 1
        return shard, test, length


def _joined(places: np.ndarray, keys: np.ndarray, among: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, place there) of equal keys; ``among`` is sorted and ``at`` are its places."""
    low, high = np.searchsorted(among, keys, "left"), np.searchsorted(among, keys, "right")
    hits = high - low
    return np.repeat(places, hits), at[np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)]


def full_windows(ids: np.ndarray, words: int) -> np.ndarray:
    """Places from which ``words`` ids other than 0 follow."""
    if len(ids) < words:
        return np.zeros(0, np.int64)
    none = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.flatnonzero(none[words:] == none[:-words])


def _sortable(keys: np.ndarray) -> np.ndarray:
    return keys.view(f"S{keys.dtype.itemsize}")


def leaked_passages(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 13) -> DataFrame:
    """(doc_id, item_id, item_word, doc_word, length): the longest runs of at least ``words`` consecutive words
    that a document shares with a test item; places count words from 0.

    Words are the maximal runs of letters and digits after NFKC and lower-casing. Items of fewer words, null
    or empty texts and null ids take no part; repeated rows give repeated matches. Test items are handled in
    blocks of bounded size, several in one pass over the documents, whose words are told apart once. Other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null and text is not null")
    test = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").alias("text")).filter("id is not null and text is not null").distinct()
    schema = T.StructType.fromDDL("doc_id bigint, item_id bigint, item_word int, doc_word int, length int")
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(test, words)]
    if not blocks:
        return spark.createDataFrame([], schema)
    passes = [blocks[n : n + _BLOCKS_AT_ONCE] for n in range(0, len(blocks), _BLOCKS_AT_ONCE)]
    if len(passes) == 1:
        return rows.mapInArrow(lambda batches: _found(_worded(batches), passes[0], schema.names), schema)
    worded = stored(rows.mapInArrow(_worded, _WORDED))
    found = None
    for some in passes:
        part = worded.mapInArrow(lambda batches, some=some: _found(batches, some, schema.names), schema)
        found = part if found is None else found.unionByName(part)
    return found


_WORDED = "id bigint, words array<string>"


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) from (id, text)."""
    for batch in batches:
        for first, last in _ranges(batch["text"]):
            yield pa.RecordBatch.from_arrays([batch["id"].slice(first, last - first), word_lists(batch["text"].slice(first, last - first))], names=["id", "words"])


def _found(batches: Iterator[pa.RecordBatch], blocks: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["words"]
        flat = lists.flatten()
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        begins = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])[:-1]
        for block in blocks:
            suffixes = block.value
            known = pc.add(pc.fill_null(pc.index_in(flat, value_set=suffixes.vocabulary), -1), 1).to_numpy().astype(np.uint32)
            ids = np.insert(known, ends, 0)  # a 0 after each text
            at, test_at, length = suffixes.matches(ids)
            row = np.searchsorted(begins, at, side="right") - 1
            columns = (batch["id"].to_numpy()[row], suffixes.item[test_at], test_at - suffixes.first[test_at], at - begins[row], length)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if n < 2 else np.int32)) for n, c in enumerate(columns)], names=names)


def _ranges(values: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(sizes):
        held = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, held + _BYTES_AT_ONCE, side="right")))
        yield first, last
        first = last


def _blocks(test: DataFrame, words: int) -> Iterator[TestSuffixes]:
    """The items of enough words, in blocks of about ``_BLOCK_WORDS``; the words are told apart on the executors."""
    block: list[tuple[int, list[str]]] = []
    held = 0
    for row in stored(test.mapInArrow(_worded, _WORDED).filter(F.size("words") >= words)).toLocalIterator():
        block.append((row["id"], row["words"]))
        held += len(row["words"])
        if held >= _BLOCK_WORDS:
            yield TestSuffixes(block, words)
            block, held = [], 0
    if block:
        yield TestSuffixes(block, words)


def leaked_documents(passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest, matches): each document with each item it contains words of."""
    return passages.groupBy("doc_id", "item_id").agg(F.max("length").alias("longest"), F.count("*").alias("matches"))


def without_leaked(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that contain test passages; rows with a null id stay."""
    affected = passages.select(F.col("doc_id").alias("__affected")).distinct()
    return docs.join(affected, F.col(f"`{id_col}`") == F.col("__affected"), "left_anti")
