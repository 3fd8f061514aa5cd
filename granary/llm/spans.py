"""Long exact spans shared between records.

Paragraph MinHash compares whole paragraphs and can't promise a span that is a small part of long,
otherwise different paragraphs, so another method is used: winnowing. Of every ``length - gram + 1``
neighbouring grams the one with the smallest hash is an anchor. Two texts that share a span of ``length``
characters share all grams in it and thus at least one anchor, at the same place of the span: no pair is
missed. Every anchor that stands in more than one text travels with the characters around it, so that all
occurrences of one anchor can be compared there and then: each stretch of ``length`` characters that holds the
anchor has a label, and texts with the same label share that stretch. Labels are grouped, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.storage import stored

_CHARS_AT_ONCE = 1 << 20
_PLACE_BITS = np.uint64(24)
_PLACES = np.uint64((1 << 24) - 1)
#: Keys of texts that may be sent to every executor: 16 bytes each.
_KEYS_TO_SEND = 1_000_000
#: Occurrences of anchors that one step compares (about 4 KB each), and pairs that it makes at once.
_ROWS_AT_ONCE = 4_096
_PAIRS_AT_ONCE = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def gram_hashes(codes: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each window of ``gram`` code points along the last axis, from hashes of windows of doubling width."""
    if codes.shape[-1] < gram:
        return np.zeros((*codes.shape[:-1], 0), np.uint64)
    hashed = _mixed((codes.astype(np.uint64) + np.uint64(1 + seed)) * np.uint64(0x9E3779B97F4A7C15))
    width = 1
    while 2 * width <= gram:
        hashed = _mixed(hashed[..., :-width] * np.uint64(0x94D049BB133111EB) + hashed[..., width:])
        width *= 2
    if width < gram:
        n = codes.shape[-1] - gram + 1
        hashed = _mixed(hashed[..., :n] * np.uint64(0xD6E8FEB86659FD93) + hashed[..., gram - width : gram - width + n])
    return hashed


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    if done < width:
        n = len(values) - (width - done)
        values = np.minimum(values[:n], values[width - done :])
    return values


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of texts that lie one behind the other in ``codes``: the rightmost
    smallest gram of each ``window`` neighbouring ones within one text."""
    hashed = gram_hashes(codes, gram)
    if len(hashed) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(len(hashed), dtype=np.uint64)
    least = _sliding_min((hashed & ~_PLACES) | (_PLACES - place), window)
    inside = np.zeros(len(codes) + 1, np.int8)
    fits = ends - starts >= gram + window - 1
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - (gram + window - 1) + 1, -1)
    chosen = least[np.cumsum(inside)[: len(least)] > 0]
    at = np.unique((_PLACES - (chosen & _PLACES)).astype(np.int64))
    return at, hashed[at]


def _slices(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``_CHARS_AT_ONCE`` bytes; a longer text comes alone."""
    sizes = pc.binary_length(values).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > _CHARS_AT_ONCE:
            yield first, row
            first, held = row, 0
        held += size
    if len(sizes):
        yield first, len(sizes)


def _anchors_of_text(text: str, gram: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of one text of any length, by overlapping stretches."""
    codes = _code_points(text)
    step, reach = 4 * _CHARS_AT_ONCE, gram + window - 2
    for start in range(0, max(1, len(codes) - reach), step):
        part = codes[start : start + step + reach]
        at, hashed = anchors(part, np.array([0]), np.array([len(part)]), gram, window)
        yield at + start, hashed


def _fingerprints(texts: DataFrame, gram: int, window: int) -> DataFrame:
    """(gram_hash, text_key, place) of all anchors. ``texts``: text_key, text; copies that one task meets count once."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            fresh = [row for row, key in enumerate(batch["text_key"].to_pylist()) if not (key in met or met.add(key))]
            batch = batch if len(fresh) == batch.num_rows else batch.take(pa.array(fresh, pa.int32()))
            keys = batch["text_key"].to_numpy()
            for first, last in _slices(batch["text"]):
                part = batch["text"].slice(first, last - first)
                if last - first == 1:
                    found = [(np.full(len(at), keys[first]), at, hashed) for at, hashed in _anchors_of_text(part[0].as_py(), gram, window)]
                else:
                    long = pc.utf8_length(part).to_numpy(zero_copy_only=False)
                    ends = np.cumsum(long)
                    codes = _code_points("".join(part.to_pylist()))
                    at, hashed = anchors(codes, ends - long, ends, gram, window)
                    row = np.searchsorted(ends, at, side="right")
                    found = [(keys[first:last][row], at - (ends - long)[row], hashed)]
                for key, at, hashed in found:
                    yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(key), pa.array(at.astype(np.int32))], names=["gram_hash", "text_key", "place"])

    return texts.select("text_key", "text").mapInArrow(mark, "gram_hash bigint, text_key bigint, place int")


def _common_runs(a: np.ndarray, b: np.ndarray, shift: int, length: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, characters) of runs of at least ``length`` equal ones where a[i + shift] meets b[i]."""
    first = max(0, -shift)
    last = min(len(b), len(a) - shift)
    if last - first < length:
        return []
    same = np.concatenate([[0], (a[first + shift : last + shift] == b[first:last]).view(np.int8), [0]])
    turns = np.flatnonzero(np.diff(same))
    begins, ends = turns[::2], turns[1::2]
    long = ends - begins >= length
    return [(int(s) + first + shift, int(s) + first, int(e - s)) for s, e in zip(begins[long], ends[long], strict=True)]


class Corpus:
    """The texts of at least ``length`` code points, by a 64-bit key that is proven to tell different texts apart.

    ``rows``: text_key, text, repeated as they came. ``members``: id, text_key, chars, each once."""

    def __init__(self, docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", length: int = 240) -> None:
        rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= length))
        seed = 0
        while True:
            key = F.xxhash64(F.lit(seed), "text")
            told = stored(rows.select("id", key.alias("text_key"), F.xxhash64("text", F.lit(seed + 1)).alias("check"), F.length("text").alias("chars")).distinct())
            if told.groupBy("text_key").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low < high").isEmpty():
                break
            seed += 2  # two different texts had one key
        self.members, self.rows, self.length = told.drop("check"), rows.select(key.alias("text_key"), "text"), length

    def needed(self, keys: DataFrame) -> DataFrame:
        """One row (text_key, text) for each of the given keys; these are sent around if they are few enough."""
        keys = stored(keys.distinct())
        keys = F.broadcast(keys) if keys.count() <= _KEYS_TO_SEND else keys
        return self.rows.join(keys, "text_key", "left_semi").dropDuplicates(["text_key"]).select("text_key", "text")


def _surroundings(corpus: Corpus, gram: int) -> DataFrame:
    """(gram_hash, text_key, place, before, around): the occurrences of anchors that stand in several texts, with up to
    ``length - gram + 1`` characters before (``before`` tells how many) and ``length - gram`` behind them."""
    reach = corpus.length - gram
    marks = stored(_fingerprints(corpus.rows, gram, reach + 1))
    several = marks.groupBy("gram_hash").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("low < high").select("gram_hash")
    shared = stored(marks.join(several, "gram_hash"))
    places = shared.groupBy("text_key").agg(F.collect_set(F.struct("place", "gram_hash")).alias("marks"))
    near = corpus.needed(shared.select("text_key")).join(places, "text_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text, marks in zip(*(batch[c].to_pylist() for c in ("text_key", "text", "marks")), strict=True):
                for mark in marks:
                    at = mark["place"]
                    first = max(0, at - reach - 1)
                    for column, value in zip(out, (mark["gram_hash"], key, at, at - first, text[first : at + gram + reach]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["gram_hash", "text_key", "place", "before", "around"])

    return near.mapInArrow(cut, "gram_hash bigint, text_key bigint, place int, before int, around string")


class _Meeting:
    """Occurrences of anchors with their surroundings as a matrix, and the label of every stretch of ``length`` characters
    that holds the anchor: column 0 would begin one character too early, and only tells whether all begin alike."""

    def __init__(self, table: pa.Table | pa.RecordBatch, gram: int, length: int) -> None:
        reach = length - gram
        self.length, self.columns = length, reach + 2
        self.text, self.place, before = (table[c].to_numpy() for c in ("text_key", "place", "before"))
        self.group = table["gram_hash"].to_numpy()
        told = table["around"].to_pylist()
        self.codes = np.zeros((len(told), length + reach + 1), np.uint32)
        for row, (skip, value) in enumerate(zip(reach + 1 - before, told, strict=True)):
            points = _code_points(value)
            self.codes[row, skip : skip + len(points)] = points
        after = np.array([len(t) for t in told], np.int64) - before - gram
        column = np.arange(self.columns)
        self.valid = (column >= (reach + 1 - before)[:, None]) & (column <= (after + 1)[:, None])
        self.labels = gram_hashes(self.codes, length, seed=1 << 32)
        self.starts = (self.place - reach - 1)[:, None] + column

    def sets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns, bounds): occurrences in one order in which those of one anchor, column and label stand
        together, from ``bounds[n]`` to ``bounds[n + 1]``; only where different texts meet."""
        row, column = np.nonzero(self.valid[:, 1:])
        column += 1
        key = _mixed(self.labels[row, column] ^ (self.group[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (column.astype(np.uint64) << np.uint64(57)))
        order = np.lexsort((self.text[row], key))
        row, column = row[order], column[order]
        told = np.stack([self.labels[row, column], self.group[row].view(np.uint64), column.astype(np.uint64)])
        turns = np.flatnonzero(np.concatenate([[True], (told[:, 1:] != told[:, :-1]).any(0)])) if len(row) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(turns, len(row)))
        several = self.text[row[turns]] != self.text[row[turns + sizes - 1]]
        keep = np.repeat(several, sizes)
        return row[keep], column[keep], np.concatenate([[0], np.cumsum(sizes[several])])

    def covered(self) -> Iterator[pa.RecordBatch]:
        """(text_key, start, stop, link): stretches of each text that others hold too; ``link`` is the smallest of them."""
        row, column, bounds = self.sets()
        links = np.full(self.valid.shape, np.iinfo(np.int64).max)
        links[row, column] = np.repeat(self.text[row[bounds[:-1]]], np.diff(bounds))
        row, column = np.nonzero(links != np.iinfo(np.int64).max)
        link = links[row, column]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1] + 1) | (link[1:] != link[:-1])
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(row)) - 1
        start, stop = self.starts[row[at], column[at]], self.starts[row[last], column[last]] + self.length
        yield pa.RecordBatch.from_arrays([pa.array(self.text[row[at]]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(link[at])], names=["text_key", "start", "stop", "link"])

    def uniform(self) -> np.ndarray:
        """Rows of anchors all of whose occurrences begin alike: whoever meets there meets in an earlier anchor too."""
        _, group = np.unique(self.group, return_inverse=True)
        label = np.where(self.valid[:, 0], self.labels[:, 0], np.uint64(0))
        low, high, none = np.full(group.max(initial=-1) + 1, np.iinfo(np.uint64).max), np.zeros(group.max(initial=-1) + 1, np.uint64), np.zeros(group.max(initial=-1) + 1, bool)
        np.minimum.at(low, group, label)
        np.maximum.at(high, group, label)
        np.logical_or.at(none, group, ~self.valid[:, 0])
        return ((low == high) & ~none)[group]

    def before(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Label of the stretch that begins one character earlier; where there is none, one that no other row has."""
        held = self.valid[row, column - 1] & (column > 1)
        return np.where(held, self.labels[row, column - 1], row.astype(np.uint64))

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """(text_a, text_b, shift) of occurrences of different texts, once for each anchor in which two meet: where the
        stretch before is not shared as well. Characters are compared before a pair is told."""
        row, column, bounds = self.sets()
        known = self.before(row, column)
        skip = self.uniform()
        low, high = (f.reduceat(known, bounds[:-1]) if len(row) else known for f in (np.minimum, np.maximum))
        for n in np.flatnonzero((low != high) & ~skip[row[bounds[:-1]]]) if len(row) else []:
            here, at = slice(bounds[n], bounds[n + 1]), column[bounds[n]]
            who, label = row[here], known[here]
            for first in range(0, len(who), step := max(1, _PAIRS_AT_ONCE // len(who))):
                some = slice(first, first + step)
                i, j = np.nonzero((label[some, None] != label) & (self.text[who[some], None] < self.text[who]))
                for part in range(0, len(i), _ROWS_AT_ONCE):
                    a, b = who[some][i[part : part + _ROWS_AT_ONCE]], who[j[part : part + _ROWS_AT_ONCE]]
                    same = (self.codes[a, at : at + self.length] == self.codes[b, at : at + self.length]).all(1)
                    a, b = a[same], b[same]
                    yield pa.RecordBatch.from_arrays([pa.array(self.text[a]), pa.array(self.text[b]), pa.array((self.place[a] - self.place[b]).astype(np.int32))], names=["text_a", "text_b", "shift"])

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(gram_hash, col, label, known, text_key, place) of every stretch; ``known`` is null where there is none before."""
        row, column = np.nonzero(self.valid[:, 1:])
        column += 1
        held = self.valid[row, column - 1] & (column > 1)
        columns = [
            pa.array(self.group[row]), pa.array(column.astype(np.int16)), pa.array(self.labels[row, column].view(np.int64)),
            pa.array(self.labels[row, column - 1].view(np.int64), mask=~held), pa.array(self.text[row]), pa.array(self.starts[row, column].astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["gram_hash", "col", "label", "known", "text_key", "place"])


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by gram_hash in tables of about ``_ROWS_AT_ONCE``, no anchor in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS_AT_ONCE):
            held.append(batch.slice(first, _ROWS_AT_ONCE))
            if sum(b.num_rows for b in held) < _ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            group = table["gram_hash"].to_numpy()
            cut = int((group != group[-1]).sum())
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _met(around: DataFrame, what: str, schema: str, gram: int, length: int) -> DataFrame:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _flushes(batches):
            if table.num_rows:
                yield from getattr(_Meeting(table, gram, length), what)()

    return around.mapInArrow(meet, schema)


_HOT_ROWS = "gram_hash bigint, col smallint, label bigint, known bigint, text_key bigint, place int"


def _by_heat(corpus: Corpus, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Surroundings of anchors with at most ``hot`` occurrences, each anchor in one partition and sorted, and the stretches
    (``_Meeting.rows``) of all others, which Spark groups itself, spread over all tasks."""
    if not 0 < gram <= corpus.length:
        raise ValueError("gram must be between 1 and length")
    around = stored(_surroundings(corpus, gram))
    often = around.groupBy("gram_hash").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("gram_hash")
    often = stored(often)
    often = F.broadcast(often) if often.count() <= _KEYS_TO_SEND else often
    cold = around.join(often, "gram_hash", "left_anti").repartition("gram_hash").sortWithinPartitions("gram_hash")
    return cold, _met(around.join(often, "gram_hash", "left_semi"), "rows", _HOT_ROWS, gram, corpus.length)


_STRETCH = ["gram_hash", "col", "label"]


def shared_pairs(corpus: Corpus, *, gram: int = 120, hot: int = 8_192) -> DataFrame:
    """(text_a < text_b, shift) of different texts with a run of ``length`` characters in common: place in a less place
    in b; each once. ``hot`` only decides where an anchor's occurrences are compared, not what comes out."""
    cold, rows = _by_heat(corpus, gram, hot)
    found = _met(cold, "pairs", "text_a bigint, text_b bigint, shift int", gram, corpus.length)
    rows = stored(rows)
    if not rows.isEmpty():
        # Stretches with different stretches before them, by these; pairs that share those as well are told there.
        own = F.coalesce("known", F.xxhash64("text_key", "place"))
        rows = rows.withColumn("known", own)
        mixed = rows.groupBy(*_STRETCH).agg(F.min("known").alias("low"), F.max("known").alias("high")).filter("low < high").select(*_STRETCH)
        members = stored(rows.join(mixed, _STRETCH))
        kinds = members.select(*_STRETCH, "known").distinct()
        both = kinds.join(kinds.withColumnRenamed("known", "other"), _STRETCH).filter("known < other")
        one = members.withColumnsRenamed({"text_key": "one", "place": "place_one"})
        two = members.withColumnsRenamed({"known": "other", "text_key": "two", "place": "place_two"})
        pairs = both.join(one, [*_STRETCH, "known"]).join(two, [*_STRETCH, "other"]).filter("one <> two")
        shift = F.when(F.col("one") < F.col("two"), F.col("place_one") - F.col("place_two")).otherwise(F.col("place_two") - F.col("place_one"))
        found = found.unionByName(pairs.select(F.least("one", "two").alias("text_a"), F.greatest("one", "two").alias("text_b"), shift.alias("shift")))
    return found.distinct()


def shared_stretches(corpus: Corpus, *, gram: int = 120, hot: int = 8_192) -> DataFrame:
    """(text_key, start, stop, link): stretches of texts that stand in another text too, which cover all such characters.
    ``link`` is the smallest of the texts that share it. No pairs are made: the work grows with the texts alone."""
    cold, rows = _by_heat(corpus, gram, hot)
    found = _met(cold, "covered", "text_key bigint, start int, stop int, link bigint", gram, corpus.length)
    several = rows.groupBy(*_STRETCH).agg(F.min("text_key").alias("link"), F.max("text_key").alias("high")).filter("link < high").drop("high")
    warm = rows.join(several, _STRETCH).select("text_key", F.col("place").alias("start"), (F.col("place") + corpus.length).alias("stop"), "link")
    return found.unionByName(warm)


def shared_spans(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", *, length: int = 240, gram: int = 120, hot: int = 8_192) -> DataFrame:
    """(text_a, text_b, start_a, start_b, span): the longest runs of at least ``length`` code points that two
    different texts have in common, text keys with text_a < text_b, places from 0; each once.

    Texts are told apart by their characters: identical texts are one (``Corpus.members`` lists their ids).
    Null, empty and shorter texts, and null ids, take no part. Other columns are not read.
    """
    corpus = Corpus(docs, id_col, text_col, length)
    met = stored(shared_pairs(corpus, gram=gram, hot=hot).groupBy("text_a", "text_b").agg(F.collect_set("shift").alias("shifts")))
    left = corpus.needed(met.select(F.col("text_a").alias("text_key"))).select(F.col("text_key").alias("text_a"), F.col("text").alias("a"))
    right = corpus.needed(met.select(F.col("text_b").alias("text_key"))).select(F.col("text_key").alias("text_b"), F.col("text").alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, two, shifts, a, b in zip(*(batch[c].to_pylist() for c in ("text_a", "text_b", "shifts", "a", "b")), strict=True):
                x, y = _code_points(a), _code_points(b)
                rows += [(one, two, *run) for shift in sorted(shifts) for run in _common_runs(x, y, shift, length)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["text_a", "text_b", "start_a", "start_b", "span"])

    schema = "text_a bigint, text_b bigint, start_a int, start_b int, span int"
    return met.join(left, "text_a").join(right, "text_b").mapInArrow(compare, schema)


def sharing_pairs(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", *, length: int = 240, gram: int = 120, hot: int = 8_192) -> DataFrame:
    """(id_a < id_b): different ids whose texts share a span of ``length`` characters, identical texts among them; each
    pair once. Null, empty and shorter texts, and null ids, take no part. ``shared_pairs`` and ``Corpus.members`` are the
    same result as pairs of texts and the ids of each, which stays small where one text has many ids."""
    corpus = Corpus(docs, id_col, text_col, length)
    texts = shared_pairs(corpus, gram=gram, hot=hot).select("text_a", "text_b").distinct()
    members = corpus.members
    copied = members.groupBy("text_key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("text_key")
    texts = texts.unionByName(copied.select(F.col("text_key").alias("text_a"), F.col("text_key").alias("text_b")))
    one = members.select(F.col("text_key").alias("text_a"), F.col("id").alias("one"))
    two = members.select(F.col("text_key").alias("text_b"), F.col("id").alias("two"))
    pairs = texts.join(one, "text_a").join(two, "text_b").filter("one <> two")
    return pairs.select(F.least("one", "two").alias("id_a"), F.greatest("one", "two").alias("id_b")).distinct()


def shared_share(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", *, length: int = 240, gram: int = 120, hot: int = 8_192) -> DataFrame:
    """(id, class_id, chars, shared_chars): for every id how many of its characters also stand, in a run of at least
    ``length``, in a record of another id; ``class_id`` is the smallest id of the records that hang together by such runs.

    One row for each id (and text, if it came with several) whose text has ``length`` characters or more;
    shorter ones share nothing. Copies of one text under several ids share all of it. No pairs are made.
    """
    corpus = Corpus(docs, id_col, text_col, length)
    stretches = stored(shared_stretches(corpus, gram=gram, hot=hot))
    runs = stretches.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs"))
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("covered"))

    def cover(state, run):  # noqa: ANN001, ANN202
        fresh = F.greatest(run["stop"] - F.greatest(run["start"], state["reach"]), F.lit(0))
        return F.struct(F.greatest(state["reach"], run["stop"]).alias("reach"), (state["covered"] + fresh).alias("covered"))

    covered = runs.select("text_key", F.aggregate("runs", zero, cover, lambda s: s["covered"]).alias("covered"))
    classes = components(stretches.filter("link <> text_key").select(F.col("link").alias("a"), F.col("text_key").alias("b")))
    texts = corpus.members.groupBy("text_key").agg(F.min("id").alias("first_id"), (F.min("id") < F.max("id")).alias("copied"))
    texts = texts.join(classes.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    named = texts.groupBy("root").agg(F.min("first_id").alias("class_id"))
    rows = corpus.members.join(texts.join(named, "root").drop("first_id", "root"), "text_key").join(covered, "text_key", "left")
    return rows.select("id", "class_id", "chars", F.when(F.col("copied"), F.col("chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) hangs together with, over any number of edges.

    Every round each node takes the smallest root among its neighbours', then its root's root; rounds end when none
    changes. Tables are written between rounds, nothing is gathered."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both)
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        held = roots.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        least = both.join(held, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        nearer = roots.join(least, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        further = roots.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        jumped = stored(nearer.join(further, "root").select("node", "old", F.least("root", "beyond").alias("root")))
        roots = jumped.select("node", "root")
        if jumped.filter("root < old").isEmpty():
            return roots
