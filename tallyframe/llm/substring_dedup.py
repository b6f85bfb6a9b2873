"""Substring deduplication: windows of words that start in an earlier document, by an FM-index per shard.

Equal windows choose the same anchor, the least hash among their word n-grams, so the
anchor decides the shard and no window needs more than one. Anchors that only one
document has are left out first. What lies around an anchor is one segment of words. Of
equal segments one goes to the shard, with the least doc_id that has it, so a passage that
a third of all documents share loads no task. A shard indexes the distinct segments of a
run of anchors (FM-index: wavelet matrix over the Burrows-Wheeler transform), then streams
them by backward search. Where the match reaches the window's length, the least label of
the interval is the first document that has the window; if that is smaller than a
document's own doc_id, its words there are removed. Words travel as 40-bit hashes.

An anchor with more distinct segments than an index should hold (a very large group of near
copies) is split: its windows choose a second anchor by another hash, which deals them, as
shorter segments, to as many indexes; then a third one and so on, and at last each window is
an anchor of its own. Equal windows always choose alike, so every window still meets all its
equals in one index.

Defined results: null, empty and short texts have no windows and lose nothing; a window
that repeats within one document only stays; rows of one doc_id count as one
document, each by its own text; a row without doc_id is neither earlier nor later than
any and loses nothing; an empty table gives no rows; a very long text is read whole,
all of its windows by their anchors; extra columns are ignored.

Words are compared by 40 bits of their hashes and segments by names of 128 bits; the words themselves are not compared after that, so
of two different windows 50 hashes in a row would have to meet.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import discard, map_batches, partitions, written
from .textops import gram_hashes, mix, row_blocks, text_buffers, word_bounds, word_hashes

U = np.uint64
WINDOW = 50
#: Words of the n-grams that anchors are chosen from.
GRAM = 8
#: Words of distinct segments that one index holds, about.
INDEX_WORDS = 1_000_000
#: Distinct segments of one anchor that an index takes; the windows of an anchor with more choose another anchor.
MOST_SEGMENTS = 1_000
#: How often they do so before each distinct window is its own anchor.
SPLITS = 6
#: n-grams whose places are told apart at a time when the least is looked for.
_PIECE = 1 << 23
_LOW = U((1 << 24) - 1)
_words = re.compile(r"[^\x20\x09-\x0D]+").findall


class Segments(NamedTuple):
    """Runs of window starts with one anchor, in a block of rows."""

    row: np.ndarray
    anchor: np.ndarray
    begin: np.ndarray  # of the first window, as a word of its row
    first: np.ndarray  # the same as a word of the block
    count: np.ndarray  # of windows
    words: np.ndarray  # hashes of all words of the block


def segments(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Segments:
    starts, ends, first = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends, False)
    none = np.zeros(0, np.int64)
    room = np.maximum(np.diff(first) - window + 1, 0)
    if not room.any():
        return Segments(none, none, none, none, none, words)
    grams = gram_hashes(words, gram)
    place = least_places(grams, window - gram + 1)
    row = np.repeat(np.arange(len(room)), room)
    at = np.repeat(first[:-1] - np.append(0, np.cumsum(room)[:-1]), room) + np.arange(room.sum())
    chosen = place[at]
    new = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])))
    begin = at[new]
    return Segments(row[new], grams[chosen[new]].astype(np.int64), begin - first[row[new]], begin, np.diff(np.append(new, len(at))), words)


def least_places(grams: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbours is, the leftmost of equals; numbers are compared by their upper 40 bits."""
    out = []
    for start in range(0, len(grams) - width + 1, _PIECE):
        part = grams[start : start + _PIECE + width - 1]
        least, size = part & ~_LOW | np.arange(len(part), dtype=np.uint64), 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        out.append((least & _LOW).astype(np.int64) + start)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = text_buffers(column)
    for a, b in row_blocks(offsets):
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def anchored(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n_words, whole_sha256, anchors) of each row of (doc_id, tie, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column(2).to_pylist()
            for a, b, raw, offsets in _blocks(batch.column(2)):
                s = segments(raw, offsets)
                cut = np.searchsorted(s.row, np.arange(b - a + 1))
                words = [_words(x or "") for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(map(len, words), pa.int64()),
                        pa.array([hashlib.sha256(" ".join(w).encode()).hexdigest() for w in words], pa.string()),
                        pa.array([np.unique(s.anchor[cut[i] : cut[i + 1]]) for i in range(b - a)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "tie", "n_words", "whole_sha256", "anchors"],
                )

        return step

    return map_batches(docs, make, "doc_id long, tie long, n_words long, whole_sha256 string, anchors array<long>")


PLACED = "segment binary, anchor long, doc_id long, tie long, begin int, low binary, high binary"
#: Names of segments that a task remembers, to send the words of each once.
NAMES_KEPT = 500_000


def placed_segments(candidates: DataFrame) -> DataFrame:
    """The segments of (doc_id, tie, text, shared) around shared anchors: a name, the anchor, the row and the word where
    it begins, and its words as 32 and 8 bits of their hashes (null where the task has sent them before)."""

    def make():
        sent: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = batch.column(3)
            for a, b, raw, offsets in _blocks(batch.column(2)):
                s = segments(raw, offsets)
                cut = np.searchsorted(s.row, np.arange(b - a + 1))
                keep = np.zeros(len(s.row), bool)
                for i in range(b - a):
                    keep[cut[i] : cut[i + 1]] = np.isin(s.anchor[cut[i] : cut[i + 1]], wanted[a + i].values.to_numpy())
                at = np.flatnonzero(keep)
                low, high = s.words.astype(np.uint32), (s.words >> U(32)).astype(np.uint8)
                names, lows, highs = [], [], []
                for x, n in zip(s.first[at].tolist(), s.count[at].tolist(), strict=True):
                    p, q = low[x : x + n + WINDOW - 1].tobytes(), high[x : x + n + WINDOW - 1].tobytes()
                    name = xxhash.xxh3_128_digest(p + q)
                    new = name not in sent
                    names.append(name)
                    lows.append(p if new else None)
                    highs.append(q if new else None)
                    sent.add(name)
                if len(sent) > NAMES_KEPT:
                    sent.clear()
                rows = a + s.row[at]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(s.anchor[at]), pa.array(ids[rows]), pa.array(ties[rows]), pa.array(s.begin[at].astype(np.int32)), pa.array(lows, pa.binary()), pa.array(highs, pa.binary())], [x.split()[0] for x in PLACED.split(", ")])

        return step

    return map_batches(candidates, make, PLACED)


RUNS = "segment binary, runs array<struct<lo:int,hi:int,earliest:bigint>>"


def _searched(held: dict[bytes, tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    """Each segment's windows as runs of starts with one first document, by an index of all of them."""
    parts = [np.frombuffer(low, np.uint32).astype(np.int64) | np.frombuffer(high, np.uint8).astype(np.int64) << 32 for _, low, high in held.values()]
    labels = np.array([least for least, _, _ in held.values()], np.int64)
    runs = []
    for found in FMIndex(parts, labels, WINDOW).stream(parts):
        edge = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        stop = np.append(edge[1:], len(found))
        runs.append([{"lo": int(x), "hi": int(y) - 1, "earliest": int(found[x])} for x, y in zip(edge, stop, strict=True)])
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("earliest", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(runs, kind)], ["segment", "runs"])


def searched_shards(rows: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """(segment, runs) of (anchor, segment, least, low, high): where each window of a segment is first found.

    A segment's label and its words come in rows of their own, the other columns null, so the words are shuffled once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, words, size, now = {}, {}, 0, None

        def whole() -> pa.RecordBatch:
            return _searched({k: (labels[k], *w) for k, w in words.items()})

        for batch in batches:
            for anchor, segment, least, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != now and size >= index_words:
                    yield whole()
                    labels, words, size = {}, {}, 0
                now = anchor
                if low is None:
                    labels[segment] = least
                elif segment not in words:  # other tasks may have sent it too
                    words[segment] = (low, high)
                    size += len(high)
        if words:
            yield whole()

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, RUNS)


def split_segments(rows: DataFrame, level: int) -> DataFrame:
    """(parent, shift, segment, anchor, least, low, high): the segments (segment, anchor, least, low, high) of large anchors cut
    where their windows choose another anchor, the least n-gram by the hash of this level; at level SPLITS each window by itself."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for segment, anchor, least, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(high, np.uint8).astype(np.uint64) << U(32)
                n = len(words) - WINDOW + 1
                if level < SPLITS:
                    grams = gram_hashes(mix(words + U(level)), GRAM)
                    place = least_places(grams, WINDOW - GRAM + 1)
                    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                    chosen = grams[place[first]]
                else:
                    first, chosen = np.arange(n), gram_hashes(mix(words), WINDOW)
                for a, b, x in zip(first.tolist(), np.append(first[1:], n).tolist(), mix(chosen ^ U(anchor % 2**64)).astype(np.int64).tolist(), strict=True):
                    p, q = low[4 * a : 4 * (b + WINDOW - 1)], high[a : b + WINDOW - 1]
                    out.append((segment, a, xxhash.xxh3_128_digest(p + q), x, least, p, q))
                    size += len(q)
                if size > INDEX_WORDS:
                    yield flat(out)
                    out, size = [], 0
            yield flat(out)

        def flat(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["parent", "shift", "segment", "anchor", "least", "low", "high"])

        return step

    return map_batches(rows.select("segment", "anchor", "least", "low", "high"), make, "parent binary, shift int, segment binary, anchor long, least long, low binary, high binary")


def first_windows(least: DataFrame, words: DataFrame, index_words: int, most_segments: int, level: int = 0) -> DataFrame:
    """(segment, runs) of the segments (anchor, segment, least), whose words (anchor, segment, low, high) may come more than once."""
    sizes = least.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.filter(F.col("n") > (most_segments if level <= SPLITS else 2**62)).select("anchor"), "large-anchors")
    none = {c: F.lit(None).cast("binary") for c in ("low", "high")}
    both = words.withColumn("least", F.lit(None).cast("long")).unionByName(least.withColumns(none)).select("anchor", "segment", "least", "low", "high")
    if large.isEmpty():
        return searched_shards(both, index_words)
    found = searched_shards(both.join(large, "anchor", "left_anti").select(both.columns), index_words)
    # a segment's words come from each task that had it: one of those rows is enough
    held = words.join(large, "anchor", "left_semi").groupBy("anchor", "segment").agg(F.min(F.struct("low", "high")).alias("w"))
    held = held.join(least, ["anchor", "segment"]).select("segment", "anchor", "least", "w.low", "w.high")
    parts = written(split_segments(held, level + 1), "split-segments")
    own = parts.groupBy("anchor", "segment").agg(F.min("least").alias("least"), F.min(F.struct("low", "high")).alias("w"))
    own = written(own.select("anchor", "segment", "least", "w.low", "w.high"), "split-words")
    inner = first_windows(own.select("anchor", "segment", "least"), own.select("anchor", "segment", "low", "high"), index_words, most_segments, level + 1)
    met = parts.select("parent", "shift", "segment").hint("merge").join(inner.hint("merge"), "segment")
    moved = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("shift")).alias("lo"), (r["hi"] + F.col("shift")).alias("hi"), r["earliest"].alias("earliest")))
    return found.unionByName(met.select("parent", moved.alias("runs")).groupBy(F.col("parent").alias("segment")).agg(F.flatten(F.collect_list("runs")).alias("runs")))


def repeated_spans(placed: DataFrame, index_words: int = INDEX_WORDS, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """(doc_id, tie, low, high): the words of each row that a window of an earlier document covers."""
    least = placed.groupBy("anchor", "segment").agg(F.min("doc_id").alias("least"))
    words = placed.filter("low is not null").select("anchor", "segment", "low", "high")
    found = first_windows(least, words, index_words, most_segments)
    # a segment that very many rows have is a skewed key of this join, which adaptive execution splits
    met = placed.select("segment", "doc_id", "tie", "begin").hint("merge").join(found.hint("merge"), "segment")
    each = met.select("doc_id", "tie", "begin", F.explode("runs").alias("r")).filter("r.earliest < doc_id")
    return each.select("doc_id", "tie", (F.col("begin") + F.col("r.lo")).cast("long").alias("low"), (F.col("begin") + F.col("r.hi") + WINDOW).cast("long").alias("high"))


def _cut(rows: DataFrame) -> DataFrame:
    """(doc_id, tie, n_removed, kept_sha256, kept_text) of (doc_id, tie, text, spans)."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = _words(text)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [s["low"] for s in spans], 1)
                np.add.at(change, [s["high"] for s in spans], -1)
                stays = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                kept = " ".join([words[i] for i in stays.tolist()])
                out.append((len(words) - len(stays), hashlib.sha256(kept.encode()).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "tie", "n_removed", "kept_sha256", "kept_text"])

        return step

    return map_batches(rows, make, "doc_id long, tie long, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_words: int = INDEX_WORDS, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text); kept_text is null where nothing was removed."""
    key = ["doc_id", "tie"]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    base = written(anchored(texts), "anchored")
    anchors = base.filter("doc_id is not null").select(*key, F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("anchor")
    met = anchors.join(shared.hint("merge"), "anchor", "left_semi").groupBy(*key).agg(F.collect_set("anchor").alias("shared"))
    candidates = written(texts.dropna(subset=["doc_id"]).hint("merge").join(met.hint("merge"), key).select(*key, "text", "shared"), "candidates")
    placed = written(placed_segments(candidates), "segments")
    spans = repeated_spans(placed, index_words, most_segments).groupBy(*key).agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    cut = candidates.select(*key, "text").hint("merge").join(spans.hint("merge"), key).select(*key, "text", "spans")
    cut = written(_cut(cut).dropDuplicates(key), "cut")
    discard(candidates, placed)
    out = base.join(cut, (base.doc_id == cut.doc_id) & (base.tie == cut.tie), "left")
    return out.select(base.doc_id, "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept_text")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)
), f AS (SELECT win, min(doc_id) AS first_doc FROM p GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM p JOIN f USING (win) WHERE first_doc < doc_id
), e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM e ANTI JOIN gone USING (doc_id, pos) GROUP BY 1
)
SELECT w.doc_id, len(w.words) AS n_words, len(w.words) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
