"""Fingerprints, encoding, packing, secrets, quality, token counts, chat formatting and the pipeline."""

import base64
import binascii
import functools
import gzip
import hashlib
import json
import os
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import byte_bpe, chat, fingerprints, packing, quality, secret_scan, token_counts

from . import edges

tokenizer_files = pytest.importorskip("public_tokenizers")
TEXT = st.text(alphabet=st.sampled_from(list("aaabcdeht  \n\t''.,!#$09éßÀ日本😀\x1c\x85\xa0Σİ̈")), max_size=80)


# Fingerprints.


def test_edited_texts_and_fingerprints(spark):
    got = fingerprints.fingerprint_documents(edges.table(spark)).collect()
    rows = edges.rows()
    assert len(got) == len(rows)
    numbered = sorted((i, x or "") for i, x in rows if i is not None)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for at, (i, x) in enumerate(numbered):
        if sum(j == i for j, _ in numbered) > 1 or at + 1 == len(numbered):
            continue
        following = numbered[at + 1][1]
        edited = x[: len(x) - len(x) // 4] + following[: len(x) // 4]
        (r,) = by[i]
        assert (r.n_chars, r.edited_text, r.edited_sha256) == (len(x), edited, hashlib.sha256(edited.encode()).hexdigest())
        assert r.common_head == len(os.path.commonprefix([x, edited]))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1
    assert by[1][0].fingerprint != by[5][0].fingerprint
    assert by[6][0].near_next == 1.0 and by[7][0].n_chars == 0
    assert fingerprints.fingerprint_documents(edges.empty(spark)).count() == 0
    (alone,) = fingerprints.fingerprint_documents(edges.table(spark, [(1, "abcdefgh")])).collect()
    assert alone.edited_text == "abcdefab" and alone.near_next == 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", max_size=60), st.text(alphabet="ab", max_size=60), st.integers(0, 60), st.integers(0, 60))
def test_spans_and_common_extensions(x, y, i, j):
    i, j = min(i, len(x)), min(j, len(y))
    p, q = fingerprints.PrefixHash.of(x), fingerprints.PrefixHash.of(y)
    assert p.common(i, q, j) == len(os.path.commonprefix([x[i:], y[j:]]))
    n = min(len(x) - i, len(y) - j)
    assert p.equal(i, q, j, n) == (x[i : i + n] == y[j : j + n])


# Byte-level BPE.


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    path = tokenizer_files.path("byte_bpe_multi_50k.tiktoken")
    encoder = byte_bpe.Encoder(path, tokenizer_files.PATTERN)
    return encoder, tiktoken.Encoding("own", pat_str=tokenizer_files.PATTERN, mergeable_ranks=encoder.table.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_bpe_equals_library(bpe, text):
    encoder, library = bpe
    (ids,) = encoder.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_bpe_of_edges(spark, bpe):
    path = tokenizer_files.path("byte_bpe_multi_50k.tiktoken")
    got = byte_bpe.encode_documents(edges.table(spark), path, tokenizer_files.PATTERN).collect()
    want = sorted(((-1 if i is None else i), np.array(bpe[1].encode_ordinary(x or ""), "<u4").tobytes(), (x or "").encode()) for i, x in edges.rows())
    assert sorted(((-1 if r.doc_id is None else r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.encode_documents(edges.empty(spark), path, tokenizer_files.PATTERN).count() == 0


# Packing.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 12))
def test_differencing_is_a_partition(sizes, k):
    found = packing.differencing(sizes, k)
    assert sorted(i for w in found for i in w) == list(range(len(sizes))) and len(found) <= k
    for w in packing.windows(sizes, 100):
        assert sum(sizes[i] for i in w) <= 100


def test_differencing_is_near_equal():
    r = random.Random(5)
    sizes = [r.randint(1, 4000) for _ in range(600)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 64)]
    assert max(sums) - min(sums) < 0.05 * max(sums)


@settings(max_examples=200, deadline=None)
@given(text=TEXT)
def test_packing_tokens_equal_library(text):
    tokens = _tokens()
    want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encode([text], b"")[0], "<u4").tolist() == want


_kept = []


def _tokens():
    if not _kept:
        _kept.append(packing.Tokens(tokenizer_files.path("word_bpe_49k.json")))
    return _kept[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", "a", "one Two", " ", "\n", "é", "e\u0301", "\u0301", "日本", "'s", "9"]), max_size=10))
def test_packing_tokens_equal_unmodified_library(parts):
    library = _library()
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(_tokens().encode([text], b"")[0], "<u4").tolist() == want
    assert want.count(49407) == text.count("<|endoftext|>")


@functools.cache
def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_files.path("word_bpe_49k.json"))


def test_packing_added_tokens(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|startoftext|>"), (3, "plain")], "doc_id long, text string")
    rows = packing.pack_documents(docs, tokenizer_files.path("word_bpe_49k.json")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert {i: np.frombuffer(x, "<u4").tolist() for i, x in got.items()} == {i: [*_library().encode(x, add_special_tokens=False).ids, 2] for i, x in ((1, "a <|endoftext|> b"), (2, "<|startoftext|>"), (3, "plain"))}


def test_packing_edges(spark):
    path = tokenizer_files.path("word_bpe_49k.json")
    rows = packing.pack_documents(edges.table(spark), path, pool_windows=4).collect()
    ends = {}
    for r in rows:
        assert r.ids_crc32 == binascii.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    used = 0
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        used += at
    tokens = _tokens()
    want = sorted(tokens.encode([x or ""], b"\2\0\0\0")[0] for _, x in edges.rows())
    assert used == sum(map(len, want)) // 4
    for i in (1, 11, 13):
        own = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == i)
        assert b"".join(x for _, x in own) == tokens.encode([dict(edges.rows())[i]], b"\2\0\0\0")[0]
    assert packing.pack_documents(edges.empty(spark), path).count() == 0


def test_padding_is_small(spark, sf):
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer_files.path("word_bpe_49k.json")).groupBy("sequence_id").sum("length").collect()
    sums = [r[1] for r in rows]
    padding = sum(0 if n & (n - 1) == 0 else packing.CAPACITY - n for n in sums)
    assert padding < 0.05 * sum(sums)


# Secrets.

SECRET = "password = hunter2hunter2"


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: quote(s, safe=""),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
        lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
        lambda s: quote(base64.b64encode(gzip.compress(s.encode())).decode(), safe=""),
        lambda s: base64.b64encode(base64.b64encode(base64.b64encode(s.encode()))).decode(),
        lambda s: s.encode().hex(),
    ],
)
def test_secrets_inside_layers(wrap):
    text = f"é {wrap(SECRET)} end"
    base, spans, oversize = secret_scan.scan(text)
    assert not [s for s in base if s.kind == 0] and oversize == 0
    found = [text[s.start : s.end] for s in spans if s.kind == 0]
    assert len(found) == 1 and len(found[0]) >= 0.9 * len(wrap(SECRET).rstrip("="))


def test_secret_scan_ends_on_itself():
    wrapped = SECRET
    for _ in range(6):
        wrapped = base64.b64encode(quote(wrapped).encode()).decode()
    assert any(s.kind == 0 for s in secret_scan.scan(wrapped)[1])
    assert secret_scan.scan(base64.b64encode(zlib.compress(b"a" * 100_000)).decode(), most=1000)[2] == 1


def unmasked(text):
    """What is left of a text once its spans are masked."""
    return secret_scan.masked(text, secret_scan.scan(text)[1])


@pytest.mark.parametrize("wrapped", ["?token%3Dabcdefgh123", base64.b64encode(SECRET.encode()).decode(), base64.b64encode(zlib.compress(SECRET.encode())).decode(), "".join(f"\\u{ord(c):04x}" for c in SECRET), base64.b64encode(quote(SECRET).encode()).decode()])
def test_secrets_in_each_copy_of_a_layer(wrapped):
    text = f"one {wrapped} two {wrapped} three {quote(wrapped, safe='')}"
    spans = [s for s in secret_scan.scan(text)[1] if s.kind == 0]
    assert len({s.start for s in spans}) == 3
    first, second = text.index(wrapped), text.rindex(f" {wrapped} three") + 1
    shift = second - first
    assert {(s.start + shift, s.end + shift) for s in spans if s.end <= first + len(wrapped)} == {(s.start, s.end) for s in spans if second <= s.start < second + len(wrapped)}
    assert wrapped.rstrip("=")[-20:] not in unmasked(text)


@pytest.mark.parametrize(
    "text",
    [
        '"password": "\\u0068\\u0075\\u006e\\u0074\\u0065\\u0072\\u0032\\u0033"',
        "password = %68%75%6e%74%65%72%32%33",
        "password %3D hunter2345",
        "p\\u0061ssword %3D hunter%32\\u0033",
        "pass%77ord  =  \\u0068unter2345",
    ],
)
def test_secrets_span_escapes_and_spaces(text):
    whole = f"é %C3%A9 {text}, tail"
    (span,) = [s for s in secret_scan.scan(whole)[1] if s.kind == 0]
    start = 9 + (text[0] == '"')
    assert (span.start, span.end) == (start, 9 + len(text) - (text[0] == '"'))
    assert unmasked(whole) == whole[:start] + "[secret]" + whole[span.end :]


def test_secrets_in_escapes_do_not_depend_on_the_words_before():
    text = 'token: secret%3D"hunter2345" end'
    assert "hunter" not in unmasked(text)


def _compressed_url_safe(plain_head):
    """URL-safe base64 of zlib data whose first - or _ comes after so many plain characters."""
    for i in range(100_000):
        wrapped = base64.urlsafe_b64encode(zlib.compress(f"{i} {SECRET} {i * i}".encode())).decode()
        if re.match(rf"[A-Za-z0-9]{{{plain_head},}}[-_]", wrapped):
            return wrapped


@pytest.mark.parametrize(
    "wrapped",
    [
        _compressed_url_safe(20),
        base64.urlsafe_b64encode(f"a plain head of some length >>>???>>> {SECRET}".encode()).decode(),
        base64.encodebytes(f"{'x' * 50} {SECRET} {'y' * 60} ".encode()).decode().strip(),
        base64.encodebytes(zlib.compress(random.Random(1).randbytes(150).hex().upper().encode() + SECRET.encode())).decode().strip().replace("\n", "\r\n  "),
        "\n".join(re.findall(".{1,64}", base64.urlsafe_b64encode(gzip.compress(random.Random(2).randbytes(150).hex().upper().encode() + SECRET.encode())).decode())),
    ],
)
@pytest.mark.parametrize("around", ["{} end", "key: {}\nHello world", "-----BEGIN KEY-----\n{}\n-----END KEY-----"])
def test_secrets_in_whole_base64_stretches(wrapped, around):
    text = around.format(wrapped)
    (span, *more) = [s for s in secret_scan.scan(text)[1] if s.kind == 0]
    assert all(text.index(wrapped) <= s.start < s.end <= text.index(wrapped) + len(wrapped) for s in (span, *more))


def test_secrets_in_base64_beside_other_signs():
    wrapped = base64.b64encode(SECRET.encode()).decode().rstrip("=")
    for text in (f"{wrapped}-tail", f"id-{wrapped}", f"/a/path_to/{wrapped}/x", f"{wrapped}_{wrapped}/{wrapped}"):
        assert wrapped[8:] not in unmasked(text)


@pytest.mark.parametrize(
    "data",
    [
        gzip.compress(zlib.compress(SECRET.encode())),
        zlib.compress(gzip.compress(gzip.compress(SECRET.encode()))),
        gzip.compress(b"first ") + gzip.compress(b"second ") + gzip.compress(SECRET.encode()),
        gzip.compress(b"first ") + gzip.compress(SECRET.encode()) + b"trailing",
        zlib.compress(gzip.compress(b"a" * 5000) + gzip.compress(b" " + base64.b64encode(zlib.compress(zlib.compress(SECRET.encode()))))),
    ],
)
@pytest.mark.parametrize("most", [secret_scan.MAX_LAYER, 20])
def test_secrets_in_nested_and_joined_compression(data, most):
    wrapped = base64.b64encode(data).decode()
    text = f"é {wrapped} end"
    assert (2, 0, 2 + len(wrapped)) in [tuple(s) for s in secret_scan.scan(text, most)[1]]
    assert unmasked(text) == "é [secret] end"


@pytest.mark.parametrize("inside", [SECRET, quote(SECRET), base64.b64encode(SECRET.encode()).decode(), base64.encodebytes(f"{'x' * 50} {SECRET} {'y' * 60}".encode()).decode(), "password %3D hunter2345", '"password": "\\u0068\\u0075\\u006e\\u0074\\u0065\\u0072\\u0032\\u0033"', gzip.compress(zlib.compress(SECRET.encode())).hex()])
def test_secrets_in_large_layers_are_found_in_pieces(inside, monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 64)
    for n in (0, 50, 64, 300):
        large = ("word. " * n + "\n" + inside + "\n, tail of words" * n).encode()
        for data in (zlib.compress(large), gzip.compress(zlib.compress(large))):
            text = f"é {data.hex()} end"
            held, pieces = secret_scan.scan(text), secret_scan.scan(text, most=20)
            assert {s.kind for s in held[1]} >= {0} and held[2] == 0
            assert pieces[1] == held[1] and pieces[2] >= 1


def plain_spans(text):
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


@pytest.mark.parametrize("code", ["utf-16", "utf-16-le", "utf-16-be"])
def test_secrets_in_wide_characters(code):
    wrapped = base64.b64encode("password = hunter2hunter2".encode(code)).decode()
    (span,) = [x for x in secret_scan.scan(f"see {wrapped} end")[1] if x.kind == 0]
    assert 4 <= span.start and span.end >= 4 + len(wrapped) - 4 and "aHVu" not in unmasked(wrapped)
    assert unmasked(f"see {wrapped} end").count("[secret]") == 1


def test_secrets_among_other_bytes():
    wrapped = base64.b64encode(b"\xff\xfe\x00\x01\x90password = hunter2hunter2\x00\x88\xfa").decode()
    assert [s.kind for s in secret_scan.scan(wrapped)[1]] == [0]
    noise = base64.b64encode(bytes(random.Random(1).randrange(128, 256) for _ in range(300))).decode()
    assert [s for s in secret_scan.scan(noise)[1] if s.kind != 2] == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "Passwd", "TOKEN", "api_key", "apikey", "secret", ":", "=", " ", '"', "abcdefgh", "x", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "%20", "\\u0041"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    base, spans, _ = secret_scan.scan(text)
    assert [tuple(s) for s in base] == plain_spans(text) and set(base) <= set(spans)


def test_secret_edges(spark):
    got = secret_scan.scan_documents(edges.table(spark)).collect()
    assert len(got) == len(edges.rows()) and {r.doc_id: r.n_assign for r in got}[14] == 1
    assert secret_scan.scan_documents(edges.empty(spark)).count() == 0
    hidden = secret_scan.mask_secrets(edges.table(spark))
    assert hidden.columns == edges.table(spark).columns
    texts = {r.doc_id: r.text for r in hidden.collect()}
    assert texts[14].startswith("[secret] ") and texts[6] is None and texts[1] == dict(edges.rows())[1]


# Quality.


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    model = quality.train(docs, labels, quality.fold(F.col("doc_id")) != 0)
    held = quality.score_documents(docs, model).join(labels.select("doc_id", "quality"), "doc_id").filter(quality.fold(F.col("doc_id")) == 0).collect()
    assert len(held) > 50
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert len(model.vectors) <= 2 * quality.SAMPLE


def test_quality_edges(spark):
    df = edges.table(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (11, 0), (None, 1), (9, None), (13, 0)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = quality.score_documents(df, model)
    assert got.columns == [*df.columns, "score", "predicted"]
    scores = [tuple(r)[-2:] for r in got.collect()]
    assert len(scores) == len(edges.rows()) and all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in scores)
    assert quality.keep_quality(df, model).columns == df.columns
    none = quality.train(df, labels.limit(0))
    assert {tuple(r)[-2] for r in quality.score_documents(df, none).collect()} == {0.5}
    assert quality.score_documents(edges.empty(spark), model).count() == 0


def test_quality_features_do_not_depend_on_blocks():
    texts = [x for _, x in edges.rows()]
    whole = quality.features(pa.array(texts))
    for i in (0, 6, 10, 15):
        assert np.allclose(whole[i], quality.features(pa.array([texts[i]], pa.string()))[0])


# Token counts.


def test_token_counts_equal_a_unigram_library(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    path = tokenizer_files.path("piece_bpe_32k.model")
    pieces = token_counts.load_pieces(path)
    library = Tokenizer(Unigram(vocab=[("<unk>", 0.0), *pieces.items()], unk_id=0))
    got = token_counts.count_tokens(edges.table(spark), path).collect()
    assert len(got) == len(edges.rows())
    by = {r.doc_id: r for r in got}
    for i in (1, 5, 9, 11):
        words = dict(edges.rows())[i].split()
        assert (by[i].n_pretokens, by[i].n_tokens) == (len(words), sum(len(library.encode("▁" + w).ids) for w in words))
    assert (by[6].n_tokens, by[7].n_pretokens, by[6].log_score) == (0, 0, 0.0)
    assert token_counts.count_tokens(edges.empty(spark), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc☃", max_size=7), max_size=12), st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=3), st.floats(-5, -0.1), min_size=1, max_size=8))
def test_trie_equals_enumeration(words, pieces):
    trie = token_counts.UnigramTrie(pieces)
    terminal = trie.insert(sorted(set(words)))

    def best(w):
        table = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            options = [(table[a][0] + pieces[w[a:end]], -(-table[a][1] + 1)) for a in range(end) if w[a:end] in pieces]
            if w[end - 1] not in pieces:
                options.append((table[end - 1][0] + trie.unknown, table[end - 1][1] - len(w[end - 1].encode())))
            table.append(max(options))
        return table[-1]

    for w in words:
        score, count = best(w)
        assert trie.scores[terminal[w]] == pytest.approx(score) and trie.tokens[terminal[w]] == -count


def test_votes_equal_a_recount(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    texts = [x for (x,) in docs.select("text").limit(60).collect()]
    for text, score in zip(texts, model.score(quality.features(pa.array(texts))), strict=True):
        latent = model.latent(quality.features(pa.array([text])))[0]
        cosines = [round(float(np.dot(latent, v)) * 1e6) for v in model.vectors]
        near = sorted(range(len(cosines)), key=lambda j: (-cosines[j], j))[: quality.NEIGHBOURS]
        weights = [max(0, cosines[j]) ** 4 for j in near]
        vote = sum(w for w, j in zip(weights, near, strict=True) if model.labels[j]) / sum(weights)
        assert score == pytest.approx(vote, abs=2e-4)


def test_equal_texts_score_alike_and_ties_go_to_the_first():
    r = np.random.default_rng(1)
    x = r.random((40, quality.TRIGRAMS + quality.SHAPES), dtype=np.float32)
    x = np.concatenate([x, x[:20]])  # each of the first half twice
    labels = np.array([1, 0] * 30)
    model = quality.fit(x, labels)
    rows = np.concatenate([x[:1], r.random((600, x.shape[1]), dtype=np.float32), x[:1], x[:1]])
    scores = model.score(rows)
    assert scores[0] == scores[601] == scores[602] == model.score(x[:1])[0]


def test_quality_query(spark, sf):
    got = quality.op9_quality(spark, sf).collect()
    ids = [x for (x,) in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in got) == sorted(ids)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    rows = spark.createDataFrame([(None, "a b c"), (1, None), (1, None)], "doc_id long, text string")
    scored = quality.score_documents(rows, quality.train(rows, spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert [r.score for r in scored] == [0.5] * 3


# Chat formatting.


def test_tool_calls(spark):
    calls = [
        (1, "a", 5, "add", '{"y": 2, "x": 1.5, "z": {"b": 1, "a": [true, null]}}', ["b"]), (1, "b", 7, "add", '{"x": "one"}', []), (1, "c", 8, "add", "[1]", ["a", "b", "nowhere"]), (1, "d", 9, "lost", "{}", None),
        (2, "p", 0, "add", '{"x": 1, "y": 2}', ["q"]), (2, "q", 1, "add", '{"x": 1, "y": null}', ["p"]), (2, "r", 2, None, None, []),
        (3, "a", 0, "add", '{"x": 1, "y": 2}', []), (3, "b", 1, "add", '{"x": 1, "y": 3}', ["a", "a"]), (3, "b", 4, "add", '{"x": 9, "y": 9}', []), (None, "z", 0, "add", "{}", []), (4, None, 0, "add", "{}", []),
    ]
    calls = spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "b", 9, 'say "hi"\n'), (1, "b", 8, "first"), (3, "a", 2, None), (None, "z", 1, "x")], "conv_id long, call_id string, position long, content string")
    schemas = spark.createDataFrame([("add", "x", "number", True), ("add", "y", "integer", True), ("add", "z", "object", False)], "name string, field string, kind string, required boolean")
    got = {(r.conv_id, r.call_id): r for r in chat.link_tool_calls(calls, results, schemas).collect()}
    assert len(got) == 11
    a, b, c = got[1, "a"], got[1, "b"], got[1, "c"]
    assert (a.valid, a.linked) == (True, False)
    assert [(x.place, x.round) for x in (a, b, c)] == [(5, 2), (5, 1), (8, 0)]
    assert a.canonical_json == '{"arguments":{"x":1.5,"y":2,"z":{"a":[true,null],"b":1}},"depends_on":["b"],"id":"a","name":"add","result":null}'
    assert b.errors == ["missing y", "mistyped x"] and json.loads(b.canonical_json)["result"] == "first"
    assert c.errors == ["no object"] and (c.depends_on, c.n_dangling) == (["a", "b"], 1)
    assert got[1, "d"].errors == ["unknown tool"] and got[1, "d"].round == 0
    assert got[2, "p"].round is None and got[2, "q"].errors == ["missing y"] and (got[2, "r"].place, got[2, "r"].round) == (2, 0)
    assert (got[3, "a"].linked, got[3, "b"].n_repeats, got[3, "b"].depends_on, got[3, "b"].round) == (True, 2, ["a"], 0)
    assert got[None, "z"].linked is False and got[None, "z"].round is None and got[4, None].round is None
    assert chat.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


CALLS = "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>"
NO_RESULTS = "conv_id long, call_id string, position long, content string"
SCHEMA = [("add", "x", "number", True)]


def linked(spark, calls, **options):
    schemas = spark.createDataFrame(SCHEMA, "name string, field string, kind string, required boolean")
    return chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], NO_RESULTS), schemas)


def test_tool_calls_in_long_chains(spark):
    n = 10_000
    calls = [(1, f"c{i}", i, "add", '{"x": 1}', [f"c{i + 1}"]) for i in range(n)]
    got = {r.position: (r.place, r.round) for r in linked(spark, calls).select("position", "place", "round").collect()}
    assert got == {i: (0, n - i) if i < n - 1 else (0, 1) for i in range(n)}


@pytest.mark.parametrize("seed", range(2))
def test_tool_calls_are_in_topological_order(spark, seed):
    r, calls = random.Random(seed), []
    for conv in range(25):
        n = r.randint(1, 30)
        places = [r.randrange(2 * n) for _ in range(n)]
        calls += [(conv, f"c{i}", places[i], "add", '{"x": 1}', [f"c{r.randrange(n)}" for _ in range(r.choice([0, 0, 1, 1, 2]))]) for i in range(n)]
    got = {(x.conv_id, x.call_id): x for x in linked(spark, calls).select("conv_id", "call_id", "place", "round", "position", "depends_on").collect()}
    want = {}
    for key in got:  # rounds within a block, by Kahn's algorithm
        want.setdefault((key[0], got[key].place), set()).add(key)
    for members in want.values():
        needs = {k: {(k[0], d) for d in got[k].depends_on} & members for k in members}
        number, left = 0, set(members)
        while free := {k for k in left if not needs[k] & left}:
            number += 1
            for k in free:
                assert got[k].round == (number if any(needs.values()) else 0)  # without a need in it there is no block
            left -= free
        assert all(got[k].round is None for k in left)
    for k, x in got.items():
        for d in x.depends_on:
            y = got[k[0], d]
            if None not in (x.round, y.round):
                assert (y.place, y.round, y.position) < (x.place, x.round, x.position)


def test_tool_calls_on_turning_paths(spark, monkeypatch):
    """Calls that need, by turns, the last and the first of those that are left, so that no sweep finds more than a few; in one job and in several."""
    n = 600
    path = [x for a, b in zip(range(n // 2), range(n - 1, n // 2 - 1, -1), strict=True) for x in (a, b)]
    calls = [(1, f"c{x}", x, "add", "{}", [f"c{needed}"] if needed is not None else []) for x, needed in zip(path, [*path[1:], None], strict=True)]
    want = {x: n - i for i, x in enumerate(path)}
    for sweeps in (chat.SWEEPS, 512):
        monkeypatch.setattr(chat, "SWEEPS", sweeps)
        assert {r.position: r.round for r in linked(spark, calls).select("position", "round").collect()} == want
    # cycles end at once, and what needs them has no round
    loop = [(2, f"c{i}", i, "add", "{}", [f"c{(i + 1) % 300}"] if i < 300 else ["c0"] if i == 300 else []) for i in range(302)]
    assert {r.round for r in linked(spark, loop).filter("position <= 300").select("round").collect()} <= {None, 0}


def test_each_number_has_one_form(spark):
    from decimal import Context, Decimal

    from pyspark.sql import functions as F

    r = random.Random(3)
    tokens = ["1e10", "10000000000", "1E+10", "1.0e10", "-0.0", "-0", "0e0", "-0e5", "2.5e-7", "0.00000025", "1e-1", "0.10", "1e22", "2.2250738585072014e-308", "1.7976931348623157e308", "-1.25e30", "123456789012345678901234567890", "-12.50E1", "100.0", "1e0"]
    tokens += [f"{r.choice(['', '-'])}{r.randint(0, 999)}{r.choice(['', '.5', '.250', '.0'])}{r.choice(['', 'e3', 'E-9', 'e+25', 'e-40'])}" for _ in range(200)]
    df = spark.createDataFrame([(i, f'{{"b":[{t},"1.0E7, -0"],"a":{{"x":{t}}},"c":{t}}}', f"{t}") for i, t in enumerate(tokens)], "i int, json string, t string")
    got = {x.i: x.c for x in df.select("i", chat.canonical(F.col("json")).alias("c")).collect()}
    for i, t in enumerate(tokens):
        exact = Decimal(repr(float(t))) if "e" in t.lower() else Decimal(t)
        spelled = f"{exact.normalize(Context(prec=400)):f}" if exact else "0"
        assert got[i] == f'{{"a":{{"x":{spelled}}},"b":[{spelled},"1.0E7, -0"],"c":{spelled}}}', t
    alone = df.select("i", chat.canonical(F.col("t")).alias("c")).collect()
    assert all(f'"c":{x.c}}}' in got[x.i] for x in alone)


def test_tool_calls_with_other_columns_and_numbers(spark):
    from pyspark.sql import functions as F

    calls = spark.createDataFrame([(1, "a", None, "add", '{"x": 1.0, "w": [1e3, 2.50, 1e10], "v": "1.0, \\\\\\" 2.0"}', [None, "b"]), (1, "b", 1, "add", '{"x": 7}', [])], CALLS)
    results = spark.createDataFrame([(1, "a", 2, "1.0")], NO_RESULTS)
    schemas = spark.createDataFrame(SCHEMA, "name string, field string, kind string, required boolean")
    names = ["errors", "round", "place", "answer", "found", "n_repeats", "_held", "spread", "reach", "at"]
    wide = [t.select("*", *(F.lit(c).alias(c) for c in names if c not in t.columns)) for t in (calls, results, schemas)]
    got = {x.call_id: x for x in chat.link_tool_calls(*wide).collect()}
    assert got["a"].canonical_json == '{"arguments":{"v":"1.0, \\\\\\" 2.0","w":[1000,2.5,10000000000],"x":1},"depends_on":["b"],"id":"a","name":"add","result":"1.0"}'
    assert (got["a"].position, got["a"].place, got["a"].round, got["b"].round, got["a"].linked) == (-1, -1, 2, 1, True)
    assert got["a"].errors == ["unexpected v", "unexpected w"] and got["b"].valid


# The registered queries, recomputed.


@pytest.fixture(scope="module")
def documents(spark, sf):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def test_fingerprint_query(spark, sf, documents):
    from collections import Counter

    got = {r.doc_id: r for r in fingerprints.op2_fingerprints(spark, sf).collect()}
    assert len(got) == len(documents)
    spans = lambda x: Counter(x[i : i + fingerprints.SPAN] for i in range(max(1, len(x) - fingerprints.SPAN + 1))) if x else Counter()
    mark = lambda x: fingerprints.spelled(fingerprints.sketch(fingerprints._grams(fingerprints.PrefixHash.of(x))))
    for at, (i, x) in enumerate(documents):
        following = documents[(at + 1) % len(documents)][1]
        edited = x[: len(x) - len(x) // 4] + following[: len(x) // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (mark(x), mark(edited))
        for near, y in ((r.near_edited, edited), (r.near_next, following)):
            p, q = spans(x), spans(y)
            assert abs(near - (sum((p & q).values()) / sum((p | q).values()) if p or q else 1.0)) < 0.35


def test_byte_bpe_query(spark, sf, documents):
    tiktoken = pytest.importorskip("tiktoken")

    with open(tokenizer_files.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    library = tiktoken.Encoding("plain", pat_str=tokenizer_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.op7_byte_bpe(spark, sf).collect()}
    assert len(got) == len(documents)
    for i, x in documents:
        ids = library.encode_ordinary(x)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(x.encode()).hexdigest()


def test_secret_query(spark, sf, documents):
    kinds = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "(AKIA[A-Z0-9]+)"), ("hex", "([0-9a-f]+)")]
    least = {"assign": 8, "access": 16, "hex": 32}
    got = {r.doc_id: r for r in secret_scan.op8_secret_scan(spark, sf).collect()}
    assert len(got) == len(documents)
    for i, x in documents:
        found = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(kinds) for m in re.finditer(p, x, re.ASCII) if len(m[1]) >= least[k])
        base = [f"{k}:{a}:{b}" for a, _, k, b in found]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == f[2] for f in found) for k, _ in kinds]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i].spans.split(","))


def test_packing_query(spark, sf, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_files.path("word_bpe_49k.json"))
    pieces, windows = {}, {}
    for r in packing.op6_packing(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == {i for i, _ in documents}
    for i, x in documents:
        ids, at = [*library.encode(x, add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), binascii.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


# The pipeline.


def test_pipeline_stages(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from .test_dedup import near_components

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, columns = docs, docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in seen.collect()}
        seen = spark.createDataFrame(stage(spark, seen, sf).collect(), docs.schema)
        after = {r.doc_id: r.text for r in seen.collect()}
        assert seen.columns == columns and set(after) <= set(before)
        norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x or "")
        if name == "quality classifier":
            bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 0}
            assert len(bad & set(after)) <= 0.05 * len(bad) + 1
            good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1} & set(before)
            assert len(good - set(after)) <= 0.02 * len(good) + 1
        elif name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(norm(before[i]), i)
            assert set(after) == set(first.values())
        elif name == "n-gram Jaccard join":
            assert set(after) == {c for _, c in near_components(list(before.items())).values()}
        else:
            assert set(after) == set(before)
            assert not any(plain_spans(x or "") for x in after.values())
    packed = corpus_pipeline.pack(spark, seen, sf).collect()
    assert {r.doc_id for r in packed} == set(after)


def _wrappings(r):
    """Ways to hide a text: behind a random prefix, in an alphabet, escaped, compressed, in lines."""
    import bz2
    import gzip
    import json
    import zlib

    def raw(data):
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()

    plain, safe = (lambda d: base64.b64encode(d).decode()), (lambda d: base64.urlsafe_b64encode(d).decode())
    pressed = {"zlib": zlib.compress, "gzip": gzip.compress, "bz2": bz2.compress, "raw": raw, "none": lambda d: d}
    before = lambda signs: "".join(r.choice(signs) for _ in range(r.randrange(0, 9)))
    lines = lambda t: "\n".join(t[i : i + 76] for i in range(0, len(t), 76))
    any_case = lambda h: "".join(r.choice([c.upper(), c.lower()]) for c in h)
    inner = lambda make: lambda t: t.replace("hunter2hunter2", "".join(make(ord(c)) for c in "hunter2hunter2"))
    out = {f"{n} after a {kind}": lambda t, f=f, p=p, s=s: before("abcXYZ019") + s + p(f(t.encode())) for n, f in pressed.items() for kind, p, s in (("path", plain, "/"), ("name", safe, "_"), ("dash", safe, "-"))}
    out |= {f"{n} after letters": lambda t, f=f: before("abcXYZ019") + plain(f(t.encode())) for n, f in pressed.items() if n != "raw"}
    out |= {f"{n} in JSON": lambda t, f=f: json.dumps(lines(plain(f(t.encode())))).replace("/", "\\/") for n, f in pressed.items()}
    out |= {f"{n} in hexadecimal": lambda t, f=f: r.choice(["", "0x", "a", "id:"]) + any_case(f(t.encode()).hex()) for n, f in pressed.items() if n != "raw"}
    out |= {"\\U": inner("\\U{:08x}".format), "\\u{}": inner("\\u{{{:x}}}".format), "\\x": inner("\\x{:02X}".format), "&#": inner("&#{};".format), "&#x": inner("&#x{:x};".format), "nested": lambda t: "v_" + safe(zlib.compress(("z/" + plain(raw(t.encode()))).encode()))}
    return out


def test_no_wrapped_secret_is_lost(spark):
    import random

    from tallyframe.llm import secret_scan as X

    r = random.Random(11)
    words = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(r.randint(0, 30)))
    rows = []
    for name, wrap in _wrappings(r).items():
        for _ in range(40):
            text = f"see {wrap(f'{words()} password = hunter2hunter2 {words()}')} end"
            _, spans, _ = X.scan(text)
            assert any(s.kind == 0 for s in spans), (name, text)
            rows.append((len(rows), text, len(text)))
    kept = X.mask_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()
    assert len(kept) == len(rows)
    for row in kept:  # what is left holds no secret in any layer
        assert not any(s.kind == 0 for s in X.scan(row.text)[1]), row.text


def test_clean_texts_stay_clean(spark, sf):
    """No span comes of trying all ways to begin a stretch on what is no secret."""
    import os as _os

    from tallyframe.llm import secret_scan as X

    for size in (12, 100, 5_000):
        data = _os.urandom(size)
        for text in (base64.b64encode(data).decode(), data.hex(), f"a/b/{base64.b64encode(data).decode()}"):
            found = [s for s in X.scan(text)[1] if s not in X.base_spans(text)]
            assert found == [] or all(s.kind == 2 for s in found)


def test_the_pipeline_masks_planted_encoded_secrets_and_takes_any_rows(spark, sf, tmp_path):
    import random
    import zlib

    import corpus_pipeline
    from tallyframe.llm import secret_scan as X

    r = random.Random(12)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    planted = [(i, f"text {i} of some words " + base64.b64encode(zlib.compress(f"{r.random()} password = hunter2hunter2".encode())).decode(), "en", "s", 0) for i in range(20)]
    edges = [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (102, "word " * 30_000, "en", "s", 150_000)]
    stages = dict(corpus_pipeline.STAGES)
    out = stages["secret scans"](spark, spark.createDataFrame(planted + edges, schema), sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = out.collect()
    assert len(kept) == len(planted) + len(edges)
    assert all(not X.scan(x.text)[1] for x in kept if x.doc_id is not None and x.doc_id < 20)
    none = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
        assert stage(spark, spark.createDataFrame(edges, schema), sf).count() >= 0, name
    copies = stages["exact dedup"](spark, spark.createDataFrame(edges + edges[:1], schema), sf).collect()
    assert len([x for x in copies if x.text is None or not x.text.strip()]) == 1
