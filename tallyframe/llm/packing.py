"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task tokenises its documents and packs them in pools of bounded size, so nothing
is shuffled. A document longer than the capacity first gives full windows; what is left
of it and the shorter documents are the items of the pool. Differencing starts with one
partition for each item, and again and again merges the two whose windows differ most,
laying the fullest window of one on the emptiest of the other; the end is a partition
into near-equal windows. If a window passes the capacity, the pool is packed again
with one window more. The last pool of a task gives up its odd remainder as windows of
a power of two tokens, which need no padding.

Defined results: null and empty texts are the end token alone; an empty table gives no
rows; repeated rows, and rows without doc_id (null there), are packed as often as they occur; a very long text is
tokenised whole and cut over as many sequences as it needs; extra columns are ignored.
A task's number is part of sequence_id, and a task that is run again on the same
rows gives the same windows.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 4096
#: Windows in a pool, characters tokenised together, and words kept from earlier blocks of a task.
POOL_WINDOWS = 128
BLOCK_CHARS = 4_000_000
KEPT_WORDS = 400_000
#: The least window that the last pool of a task may cut off, and the room left a window there.
LEAST_WINDOW = 64
ROOM = 24


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k windows of near-equal sums."""
    if k <= 1:
        return [list(range(len(sizes)))]
    # a partition is (window sums relative to its least, ascending, without the zeros; their members as nested pairs)
    heap: list = []
    for i, s in enumerate(sizes):
        heapq.heappush(heap, (-s, i, [s], [i]))
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, am = heapq.heappop(heap)
        _, _, b, bm = heapq.heappop(heap)
        free = k - len(a) - len(b)
        if free >= 0:
            sums, members = a + b, am + bm
        else:  # the fullest of each meets the emptiest of the other
            over = -free
            sums = [x + y for x, y in zip(a[:over], reversed(b[:over]), strict=True)] + a[over:] + b[over:]
            members = [(x, y) for x, y in zip(am[:over], reversed(bm[:over]), strict=True)] + am[over:] + bm[over:]
        order = sorted(range(len(sums)), key=sums.__getitem__)
        sums, members = [sums[i] for i in order], [members[i] for i in order]
        if free <= 0:  # every window holds something: keep the differences; a window at the least keeps its members
            least = sums[0]
            sums = [x - least for x in sums]
        spread = sums[-1] - (0 if len(sums) < k else sums[0])
        heapq.heappush(heap, (-spread, serial, sums, members))
        serial += 1
    out = []
    for m in heap[0][3] if heap else []:
        flat, todo = [], [m]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                flat.append(x)
        out.append(sorted(flat))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of sizes, each at most the capacity, in as few near-equal windows as differencing finds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += 1


class Tokens:
    """Ids of texts by a tokenizer that works on words apart, so that each word is encoded once.

    The tokenizer lower-cases, then splits at white space, and there into contractions,
    runs of letters, digits and runs of other signs. Texts of ASCII and Latin-1 letters are
    split that way here; in other texts the words are what lies between white space. The
    tokenizer's added tokens (such as <|endoftext|>) are one id each wherever they stand in a
    text, as the library has it, and what lies between them is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that aren't matched as they are written")
        self.added = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        # the longest of those that begin at one place wins
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.other = re.compile(r"[^\x09-\x0D\x20-~À-ÖØ-öø-ÿ]").search
        self.pieces = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+|[0-9]").findall
        self.split = re.compile(r"[^\x20\x09-\x0D]+").findall
        self.known: dict[str, bytes] = {}
        # single words go to the model itself, with its signs for the bytes of Latin-1 letters
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {ord(c): signs.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))}
        self.model = self.tokenizer.model

    def learn(self, words: list[str], single: bool) -> None:
        """The ids of new words; single ones are one pre-token each, in lower case."""
        if single:
            tokenize, signs = self.model.tokenize, self.signs
            for w in words:
                self.known[w] = array("I", [t.id for t in tokenize(w if w.isascii() else w.translate(signs))]).tobytes()
            return
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            coded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, coded, strict=True))

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """The ids of each text, and end."""
        # texts and added tokens in turn
        parts = [self.parts(x) if any(a in x for a in self.added) else [x] for x in texts]
        coded = iter(self.encode_plain([x for some in parts for x in some[::2]]))
        return [b"".join([self.added[x] if i % 2 else next(coded) for i, x in enumerate(some)]) + end for some in parts]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without added tokens."""
        odd = [bool(self.other(x)) for x in texts]
        words = [self.split(x) if o else self.pieces(x.lower()) for x, o in zip(texts, odd, strict=True)]
        kinds = [set().union(*(w for w, o in zip(words, odd, strict=True) if o == kind)) for kind in (False, True)]
        if len(self.known) + sum(len(k.difference(self.known)) for k in kinds) > KEPT_WORDS:
            self.known = {}
        for kind, single in zip(kinds, (True, False), strict=True):
            self.learn(list(kind.difference(self.known)), single)
        known = self.known
        return [b"".join([known[w] for w in some]) for some in words]


class _Packer:
    """Pools of one task; a piece is (doc_id, start, ids bytes, tokens of its document)."""

    def __init__(self, capacity: int, pool_windows: int, first: int):
        self.capacity, self.most, self.next = capacity, pool_windows * capacity, first
        self.pool: list[tuple] = []
        self.held = 0

    def window(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            out.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset, ids))
            offset += n
        self.next += 1
        return out

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        out, step, total = [], 4 * self.capacity, len(ids) // 4
        full = len(ids) - len(ids) % step
        for at in range(0, full, step):
            out += self.window([(doc_id, at // 4, ids[at : at + step], total)])
        if full < len(ids):
            self.pool.append((doc_id, full // 4, ids[full:], total))
            self.held += (len(ids) - full) // 4
        if self.held >= self.most:
            out += self.flush()
        return out

    def flush(self) -> list[tuple]:
        pool, self.pool, self.held = self.pool, [], 0
        out = []
        for w in windows([len(p[2]) // 4 for p in pool], self.capacity) if pool else []:
            out += self.window([pool[i] for i in w])
        return out

    def last(self) -> list[tuple]:
        """The odd remainder goes as windows of a power of two tokens, the rest as any pool."""
        full = self.held // self.capacity
        spare = self.held - full * self.capacity
        spare = min(self.held, -(-(spare + ROOM * full) // LEAST_WINDOW) * LEAST_WINDOW) if spare else 0
        out, size = [], self.capacity
        while size > 1:
            while spare >= size and size < self.capacity:
                out += self.window(self.cut(size))
                spare -= size
            if size <= LEAST_WINDOW and full:
                break
            size //= 2
        return out + self.flush()

    def cut(self, size: int) -> list[tuple]:
        """size tokens off the end of the pool."""
        taken = []
        while size:
            doc_id, start, ids, total = self.pool.pop()
            n = len(ids) // 4
            if n > size:
                self.pool.append((doc_id, start, ids[: 4 * (n - size)], total))
                start, ids, n = start + n - size, ids[4 * (n - size) :], size
            taken.append((doc_id, start, ids, total))
            size -= n
            self.held -= n
        return taken


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, pool_windows: int = POOL_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, and its ids (little-endian uint32)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens(vocabulary), end_id.to_bytes(4, "little")
        packer = _Packer(capacity, pool_windows, TaskContext.get().partitionId() << 40)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= BLOCK_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                rows = []
                for doc_id, coded in zip(ids[start:stop], tokens.encode(texts[start:stop], end), strict=True):
                    rows += packer.add(doc_id, coded)
                yield told(rows)
                start = stop
        yield told(packer.last())

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
