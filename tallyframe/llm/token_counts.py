"""Token counts under a unigram model, by dynamic programming shared over a trie.

The distinct pre-tokens of a block of documents go into a trie in sorted order. Each
node holds the forward score of its prefix (the best sum of piece scores that spells
it) and the number of pieces of that best spelling, so a prefix that many pre-tokens
share is scored once. A pre-token's terminal node holds its count; documents add up
the counts of their pre-tokens. Blocks are bounded and nothing is shuffled.

A pre-token is a maximal run of characters other than space and 0x09-0x0D, with a mark
in front. The pieces are those of a public vocabulary and a piece's score is
-log(rank + 1) - log(sum of 1 / (rank + 1)), so no tokenizer is trained. A character
that is no piece costs ``UNKNOWN`` less than the worst piece and counts as its UTF-8 bytes.
Of spellings with equal scores the one with fewer pieces counts.

Defined results: null and empty texts have 0 tokens and a score of 0; an empty table
gives no rows; repeated rows repeat, and so do rows without doc_id (null there); a very long text is
counted whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import text_blocks
from .shared import map_batches

MARK = "▁"
UNKNOWN = 10.0
BLOCK_CHARS = 16_000_000


def load_pieces(path: str) -> dict[str, float]:
    """Scores of the normal pieces of a sentencepiece vocabulary file, by their place in it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(names))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(names)}


class UnigramTrie:
    """Forward scores and piece counts of all prefixes of the words inserted."""

    def __init__(self, pieces: dict[str, float]):
        self.unknown = min(pieces.values()) - UNKNOWN
        # pieces spelled backwards in nested dicts; the score of a piece is under ""
        self.back: dict = {}
        for piece, score in pieces.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.scores, self.tokens = [0.0], [0]

    def insert(self, words: list[str]) -> dict[str, int]:
        """The terminal node of each word; words are sorted and distinct."""
        scores, tokens, back, unknown = self.scores, self.tokens, self.back, self.unknown
        terminal: dict[str, int] = {}
        path, last = [0], ""  # nodes of the prefixes of the last word
        for word in words:
            depth, most = 0, min(len(word), len(last))
            while depth < most and word[depth] == last[depth]:
                depth += 1
            del path[depth + 1 :]
            for end in range(depth, len(word)):
                best, count = -math.inf, 0
                node, i = back.get(word[end]), end
                if node is None or "" not in node:
                    best, count = scores[path[end]] + unknown, tokens[path[end]] + len(word[end].encode("utf-8", "surrogatepass"))
                while node is not None:
                    if "" in node:
                        at = path[i]
                        score = scores[at] + node[""]
                        if score > best or score == best and tokens[at] + 1 < count:
                            best, count = score, tokens[at] + 1
                    i -= 1
                    if i < 0:
                        break
                    node = node.get(word[i])
                path.append(len(scores))
                scores.append(best)
                tokens.append(count)
            terminal[word] = path[-1]
            last = word
        return terminal


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_score) for every document."""

    def make():
        pieces = load_pieces(vocabulary)
        split = re.compile(r"[^\x20\x09-\x0D]+").findall

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in text_blocks(texts, BLOCK_CHARS):
                words = [split(x) for x in texts[a:b]]
                trie = UnigramTrie(pieces)
                terminal = trie.insert(sorted(set().union(*(map(MARK.__add__, w) for w in words))))
                nodes = [[terminal[MARK + w] for w in some] for some in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(map(len, words), pa.int64()),
                        pa.array((sum(map(trie.tokens.__getitem__, some)) for some in nodes), pa.int64()),
                        pa.array((math.fsum(map(trie.scores.__getitem__, some)) for some in nodes), pa.float64()),
                    ],
                    ["doc_id", "n_pretokens", "n_tokens", "log_score"],
                )

        return step

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), make, "doc_id long, n_pretokens long, n_tokens long, log_score double")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
