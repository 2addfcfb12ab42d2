import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm import dac
from leafmill.llm.token_counts import token_counts
from leafmill.llm.token_files import read_token_files, write_token_files
from leafmill.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
ENC = Encoder(PATH)
ODD = ["", " ", "á b", "ë\n\n\tx", "<|endoftext|>a<|startoftext|> <|END", "don't We'LL 12 3,4", "\x1c\x85x y　z", "ǅ İ ΑΣ Σ", "a" * 3000, "日本語 テキスト", "\r\n\r", "🙂🙂 a‍b", "x ̈y", "Été, ÀÉß. Straße ÿÜ!? naïve×÷ µm ªº", "the, THE. The;; the's"]


def lib(text):
    return LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_pieces_give_the_library_ids(text):
    assert ENC.encode([text])[0].tolist() == lib(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tabcAZ'tsé́<|>.,1\xa0\x85")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert ENC.encode([text])[0].tolist() == lib(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n'.1", min_size=0, max_size=200), st.integers(4, 30), st.integers(1, 12))
def test_chunks_are_spliced_exactly(text, chunk, overlap):
    assert ENC.count(text, chunk, overlap)[0] == len(lib(text))


def test_no_blank_at_all_widens_to_the_whole_text():
    n, _, widened = ENC.count("ab" * 3000, 100, 10)
    assert n == len(lib("ab" * 3000)) and widened


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab é\n'.1", max_size=200), st.integers(4, 30), st.integers(1, 12))
def test_chunks_of_another_tokenizer(text, chunk, overlap):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = test_chunks_of_another_tokenizer.__dict__.setdefault("enc", Encoder(path))
    assert enc.count(text, chunk, overlap)[0] == len(enc.tok.encode(text, add_special_tokens=False).ids)


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_codes_are_addressable(docs):
    raw = dac.pack(list(range(len(docs))), [np.array(d, np.uint32) for d in docs])
    x = dac.Image(raw)
    flat = [t for d in docs for t in d]
    assert x.all().tolist() == flat and [x.get(i) for i in range(len(flat))] == flat
    assert [x.doc(k).tolist() for k in range(len(docs))] == docs
    with pytest.raises(IndexError):
        x.get(len(flat))


def test_long_bitmaps_use_the_rank_directory():
    ids = np.random.default_rng(1).integers(0, 70000, 20000).astype(np.uint32)
    x = dac.Image(dac.pack([5], [ids]))
    assert all(x.get(i) == ids[i] for i in range(0, 20000, 37))


ROWS = [(3, "b b", "x"), (1, None, "x"), (2, "", None), (9, "word " * 40_000, "x"), (4, "Ünï " * 7, "x"), (None, "zz", "x"), (4, "again", "x")]


def test_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    write_token_files(docs, f"file://{tmp_path}/t", PATH)
    got = read_token_files(spark, f"file://{tmp_path}/t").collect()
    want, start = [], 0
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib(t or ""), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids[0]))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert not read_token_files(spark, _empty(spark, tmp_path)).count()


def _empty(spark, tmp_path):
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", PATH)
    return f"file://{tmp_path}/e"


def test_counts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect())
    assert got == sorted((i is not None, i or 0, len((t or "").encode()), len(lib(t or "")), len(lib(t or "")) > 2048) for i, t, _ in ROWS)
    assert token_counts(docs.limit(0), PATH).count() == 0
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
    assert sorted(r.n_tokens for r in token_counts(docs, pieces).collect()) == sorted(len(sp.encode(t or "")) for _, t, _ in ROWS)
