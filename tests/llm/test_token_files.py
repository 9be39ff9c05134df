"""Coded blocks of ids against the tokenizer itself, exact round trips, and damaged blocks."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmere.llm import range_coder, token_files
from quillmere.llm.common import tokenizer_path
from quillmere.llm.queries import op11_token_files
from quillmere.llm.tokens import Words

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["", " \n\t", "a,b..c <|endoftext|> x", "It's we'll, don't.", "é. è, ça,va …. ,, . a.b.c 3.14 İstanbul ΣΑΣ,ς é. x", "z" * 3000 + " " + "1" * 1000, "w x y.z", "́a é,", "word, " * 30_000]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 300), max_size=3000), st.sampled_from([301, 49408]))
def test_blocks_come_back(ids, vocabulary):
    assert range_coder.decode(range_coder.encode(np.array(ids, np.int64), vocabulary)).tolist() == ids


@pytest.mark.parametrize("n", [0, 1, 255, 256, 511, 70_001])
@pytest.mark.parametrize("of", [1, 50, 49408])
def test_blocks_of_many_sizes(n, of):
    ids = np.random.default_rng(n + of).integers(0, of, n)
    block = range_coder.encode(ids, 49408)
    assert (range_coder.decode(block) == ids).all()
    if n > 70_000:
        assert len(block) < n * (2.3 if of == 49408 else 0.9)


def test_what_comes_again_is_predicted():
    line = np.random.default_rng(1).integers(0, 49408, 61)
    ids = np.tile(line, 4000)
    assert len(range_coder.encode(ids, 49408)) < len(ids) / 4  # order 0 alone needs 6 bits an id


@pytest.mark.parametrize("at", [0, 12, 40, 400, -1])
def test_a_damaged_block_is_an_error(at):
    block = bytearray(range_coder.encode(np.arange(5000) % 700, 49408))
    block[at] ^= 4
    with pytest.raises(ValueError):
        range_coder.decode(bytes(block))
    with pytest.raises(ValueError):
        range_coder.decode(bytes(block[:20]))


@pytest.mark.parametrize("keep", [50, 1_000_000])
def test_words_have_the_tokenizers_ids(spark, keep):
    import pyarrow as pa

    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [None, *ODD]
    words = Words(PATH, 1, keep=keep, keep_bytes=4000)
    got = [ids[offsets[k] : offsets[k + 1]].tolist() for _, ids, offsets in words.encode(pa.array(texts), 5000) for k in range(len(offsets) - 1)]
    assert got == [[*words.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    from quillmere.llm import tokens

    monkeypatch.setattr(tokens, "span_hashes", lambda sums, starts, ends: np.ones(len(starts), np.uint64))
    words = Words(PATH)
    for text in ("one two three one", "two four", "one one"):
        (_, ids, _), *_ = words.encode(pa.array([text]))
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_is_the_tokenizers(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, op11_token_files(spark, SF).collect())) == expected(rows)


def test_awkward_rows(spark):
    rows = [(None, "a b"), (None, None), (3, "x"), (3, "x"), (-5, "later"), *[(10 + k, t) for k, t in enumerate(ODD)]]
    docs = spark.createDataFrame([(k, t, "?", 0) for k, t in rows], "doc_id int, text string, start string, file int")
    got = sorted(token_files.round_trip(docs, PATH).collect(), key=lambda r: r.start)
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append(t)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in {e[2:] for t in texts[r.doc_id] for e in expected([(None, t)])}
        at += r.n_tokens
    assert token_files.round_trip(docs.limit(0), PATH).collect() == []


def test_small_blocks_and_written_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    token_files.write(docs, str(tmp_path / "ids"), PATH, block_ids=9000)
    assert spark.read.parquet(str(tmp_path / "ids")).count() > 3
    back = sorted(token_files.read(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in back] == expected(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert all(len(r.ids) == r.n_tokens and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in back)


def test_signs_and_digits_make_no_new_words(spark):
    import pyarrow as pa

    words = Words(PATH, 1)
    texts = [f"{a}{b}{k} {b}{a}{b}{k}{a} é{b} {a}É{b}{k}" for k in range(3000) for a, b in [("word it's dog".split()[k % 3], "*** && , . ### ' '' - _".split()[k % 9])]]
    got = [ids[offsets[k] : offsets[k + 1]].tolist() for _, ids, offsets in words.encode(pa.array(texts)) for k in range(len(offsets) - 1)]
    assert got == [[*words.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert words.n < 100  # of 12,000 words, each with a number of its own


PARTS = ["'", "'s", "'T", "'ll", "'re", ",", ".", "!", "_", "a", "b", "Z", "s", "don", "7", "0", "é", "É", "ß", "ÿ", "×", "÷", "ø", "ü", "ç", "İ", "ñ", "²", "½", "́", "̸", "=", "<", "<|", "|>", "<|endoftext|>", "…", "“", "Σ", "ς", "漢", "　", "\x0b", "\x00", "\x85", " ", " ", "\n", "🙂", "x" * 70, "é" * 130]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_words_of_odd_parts_have_the_tokenizers_ids(texts):
    import pyarrow as pa

    global odd
    odd = globals().get("odd") or Words(PATH, 1, keep=300)
    got = [ids[offsets[k] : offsets[k + 1]].tolist() for _, ids, offsets in odd.encode(pa.array(texts, pa.string()), 40) for k in range(len(offsets) - 1)]
    assert got == [[*odd.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
