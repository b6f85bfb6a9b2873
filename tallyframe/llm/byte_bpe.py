"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers the distinct pre-tokens of a block of documents, lays their bytes out
in one symbol array with links to both neighbours, and keeps an inverted index from
merge rank (all symbol pairs that spell that token) to positions. Ranks are replayed
in ascending order over all words at once; a merge touches only its two neighbours,
whose new pairs enter the index. Every document is then spelled from its words' ids.
Nothing is shuffled: blocks are independent and of bounded size.

Defined results: null and empty texts have no ids; an empty table gives no rows; a
pre-token that is itself in the vocabulary is that one id; rows are taken one by one, so repeated rows and
rows without doc_id (null there) have results of their own; a very long text is a block by itself; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_batches

#: Characters of text whose pre-tokens are replayed together, and words kept from earlier blocks of a task.
BLOCK_CHARS = 8_000_000
KEPT_WORDS = 400_000


class MergeTable:
    """Ranks of a vocabulary of byte strings, and the rank that each adjacent pair of symbols merges into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelled = dict(zip(ranks.values(), ranks, strict=True))
        size = max(self.spelled) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                if a is not None and (b := ranks.get(token[cut:])) is not None:
                    keys.append(a * size + b)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.size = size
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int64)[order], -1)

    @classmethod
    def load(cls, path: str) -> MergeTable:
        """From a file of lines "base64-of-token rank"."""
        pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        return cls({base64.b64decode(a): int(b) for a, b in pairs})

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, or -1."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)


def replay(words: list[bytes], table: MergeTable) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers."""
    out: list[bytes | None] = [None] * len(words)
    todo = []
    for i, w in enumerate(words):
        rank = table.ranks.get(w)
        if rank is not None:
            out[i] = rank.to_bytes(4, "little")
        else:
            todo.append(i)
    if not todo:
        return out
    raw = np.frombuffer(b"".join(words[i] for i in todo), np.uint8)
    lengths = np.array([len(words[i]) for i in todo], np.int64)
    stops = np.cumsum(lengths)
    n = len(raw)
    sym = np.append(table.single[raw], -1)
    follow = np.arange(1, n + 1)
    follow[stops - 1] = n  # n stands for "no neighbour"
    before = np.arange(-1, n - 1)
    before[stops - lengths] = n
    before, follow = np.append(before, n), np.append(follow, n)
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Pairs that start at these positions go into the index."""
        at = at[follow[at] < n]
        if not len(at):
            return
        made = table.merged(sym[at], sym[follow[at]])
        at, made = at[made >= 0], made[made >= 0]
        if not len(at):
            return
        order = np.argsort(made, kind="stable")
        at, made = at[order], made[order]
        cuts = np.flatnonzero(np.diff(made)) + 1
        for rank, some in zip(made[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
            if rank not in index:
                heapq.heappush(heap, rank)
            index[rank].append(some)

    enter(np.flatnonzero(follow[:n] < n))
    while heap:
        rank = heapq.heappop(heap)
        held = index.pop(rank)
        at = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
        at = at[(sym[at] >= 0) & (follow[at] < n)]
        at = at[table.merged(sym[at], sym[follow[at]]) == rank]
        if len(at) > 1:  # of overlapping pairs the leftmost merges first
            run = np.append(0, follow[at[:-1]] == at[1:])
            if run.any():
                place = np.arange(len(at))
                since = place - np.maximum.accumulate(np.where(run == 0, place, 0))
                at = at[since % 2 == 0]
        if not len(at):
            continue
        gone = follow[at]
        after = follow[gone]
        sym[at] = rank
        sym[gone] = -1
        follow[at] = after
        before[after[after < n]] = at[after < n]
        left = before[at]
        enter(np.unique(np.concatenate([at, left[left < n]])))
    alive = sym[:n] >= 0
    ids = sym[:n][alive].astype("<u4")
    ends = np.cumsum(np.add.reduceat(alive.astype(np.int64), stops - lengths))
    spelled = ids.tobytes()
    begin = 0
    for i, end in zip(todo, ends.tolist(), strict=True):
        out[i] = spelled[4 * begin : 4 * end]
        begin = end
    return out


class Encoder:
    """Encodes blocks of texts; words met before in the task are kept, up to a bound."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.table = MergeTable.load(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.split(x) for x in texts]
        fresh = set().union(*words).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > KEPT_WORDS:
                self.known = {}
                fresh = set().union(*words)
            listed = list(fresh)
            self.known.update(zip(listed, replay([w.encode() for w in listed], self.table), strict=True))
        known = self.known
        return [b"".join([known[w] for w in some]) for some in words]

    def decode(self, ids: bytes) -> bytes:
        spelled = self.table.spelled
        return b"".join([spelled[i] for i in np.frombuffer(ids, "<u4").tolist()])


def text_blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters."""
    start = chars = 0
    for i, x in enumerate(texts):
        if chars and chars + len(x) > most:
            yield start, i
            start, chars = i, 0
        chars += len(x)
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary of little-endian uint32, decoded binary) for every document."""

    def make():
        encoder = Encoder(vocabulary, pattern)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in text_blocks(texts):
                ids = encoder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

        return step

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), make, "doc_id long, ids binary, decoded binary")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
