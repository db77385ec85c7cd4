import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from specframe.llm import bpe, token_counts, token_files, word_encoder  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", "\n", "  x", "a  b", "   ", "a ", "hellö ̈z", "<|endoftext|>abc<|startoftext|>", "it's 'S x y don't we'll X'LL", "İstanbul ΣΑΣ ΣΑΣ.", "\t tab\x1c x", "ﬁ ½ x12 3a...!!", "é É", "\r\nq", "x \n y", "a\n\nb",
    "日本 語 テキスト", "🙂 🙂x", "<|endoftext|> y<|endoftext|>", "s 's 't x't", "\x00 \x85  x　 y", "a" * 3000, " " * 500, "word," * 400,
]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(enc, text):
    return np.frombuffer(enc.encode([text])[0], enc.dtype).tolist()


@pytest.mark.parametrize(("path", "lower"), [(BYTE, False), (WORD, True)])
def test_encoder_is_the_library(path, lower):
    lib, enc, small = library(path), word_encoder.Encoder(path, lower), word_encoder.Encoder(path, lower, remembered=3)
    for text in HARD:
        expected = lib.encode(text, add_special_tokens=False).ids
        assert ids_of(enc, text) == expected and ids_of(small, text) == expected, repr(text[:40])


_ENCODERS = {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab  é1🙂.,'\n\t s<|>ZÉ̈　\x1c"), max_size=40)), max_size=6))
def test_columns_are_encoded_as_the_library_does(texts):
    """Whole batches, cut by Arrow, whatever stands beside the blanks."""
    column = pa.array(texts, pa.string())
    for path, lower in ((BYTE, False), (WORD, True)):
        lib, enc = _ENCODERS.setdefault(path, (library(path), word_encoder.Encoder(path, lower, remembered=50)))
        expected = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        ids, n = enc.encode_column(column)
        assert n.tolist() == list(map(len, expected)) == enc.lengths(column).tolist() and ids.tolist() == [x for e in expected for x in e]
    model = bpe.bpe(BYTE)
    codes, offsets, keys = word_encoder.chunk_codes(column, lower_words=False)
    pieces = model.pieces(keys)
    for k, t in enumerate(texts):
        own = [pieces[c] for c in codes[offsets[k] : offsets[k + 1]].tolist()]
        ids = library_cache().encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(b"".join(x[0] for x in own), model.dtype).tolist() == ids
        assert b"".join(x[1] for x in own)[:-1].decode() == ",".join(map(str, ids)) and b"".join(x[2] for x in own).decode() == (t or "")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é1🙂.'\n\t s<|>Z̈"), max_size=60))
def test_bpe_is_the_library(text):
    lib, model = library_cache(), bpe.bpe(BYTE)
    expected = lib.encode(text, add_special_tokens=False).ids
    got = model.encode(text).tolist()
    assert got == expected
    assert model.decode(got) == lib.decode(expected, skip_special_tokens=False) == text


_LIB = {}


def library_cache():
    return _LIB.setdefault(BYTE, library(BYTE))


def test_bpe_hard_texts_and_digests(spark):
    lib = library_cache()
    texts = [*HARD, "the quick brown fox, " * 20_000, "no" * 3_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None), (0, HARD[0])], "doc_id int, text string").selectExpr("*", "1 AS n_tokens", "'x' AS ids")
    rows = bpe.encode_decode(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[r.doc_id] if r.doc_id != 99 else ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(df.limit(0)).count() == 0


def test_stale_entries_are_skipped():
    model = bpe.bpe(BYTE)
    for word in (b"aaaaaaa", b"abababab", b"lowerlower", b"x" * 500):
        assert model.merge(word) == library_cache().encode(word.decode(), add_special_tokens=False).ids


def test_resynchronised_chunks():
    r, lib = random.Random(5), library_cache()
    parts = ["a", "b ", " ", "\n", "'s", "'re", "  ", "<|endoftext|>", "é", "1", "🙂", "...", "\t", "<|endof", "xyz"]
    for k in range(150):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 300)))
        if k % 5 == 0:
            text += "q" * 300 + text + " " * 200
        assert token_counts.encode_huge(text, lib, r.choice((40, 64, 100)), r.choice((34, 40, 64))) == lib.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        token_counts.encode_huge("a" * 100, lib, 5, 10)


def test_counts(spark):
    lib = library_cache()
    texts = [*HARD, "the quick brown fox " * 3000, "no" * 40_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string").selectExpr("*", "0 AS n_bytes")
    for r in token_counts.token_counts(df).collect():
        text = texts[r.doc_id] if r.doc_id >= 0 else ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.spliced) == (len(text.encode()), n, n > 512, len(text) > token_counts.HUGE)
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_token_files(spark, tmp_path):
    lib = library(WORD)
    texts = {k: t for k, t in enumerate([*HARD * 3, "The quick, brown fox Jumps\n" * 20_000, "x" * 10_000])}
    rows = [(k, t) for k, t in texts.items()] + [(7000, None), (5, texts[5]), (None, "without id")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start")
    manifest = token_files.write_token_files(df, str(tmp_path), files=3)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    start = 0
    for r in got:
        text = "without id" if r.doc_id is None else texts.get(r.doc_id) or ""
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    first = min((r for r in manifest.collect() if r.n_docs), key=lambda r: r.part).asDict()
    assert token_files.token_ids(first, 0)[-1] == 2
    assert sum(os.path.getsize(tmp_path / f) for f in os.listdir(tmp_path) if f.startswith("tokens")) == 2 * start
    assert token_files.read_token_files(token_files.write_token_files(df.limit(0), files=2)).count() == 0
