"""The piece encoder against the library: ids, digests and decoded texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import sentencepieces as sp


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sp.MODEL))


ODD = ["", " ", "  a", "a  b ", "▁x", "▁▁ ▁a  ", "　x\xa0y", "ﬁ ①", "é", "\0a", "a​b", "한국", "😀" * 5, "x\r\ny", "a" * 13, " " * 100, " " * 1000 + "the", " " * 33 + "a" + " " * 17, "<s> </s> <unk> <0x41>",
       "abcabcabc" * 50, "\n" * 50, "\t\t\t", "naïve Ünïcödé ß", "1234567890" * 9]


def strings(seed, alphabet, most, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("texts", [ODD, strings(1, "abcdeth  ▁\n\t.,0123éèß한국😀①　\x00ZQ", 60, 2000), strings(2, "aeth in", 200, 500), strings(3, [chr(c) for c in range(1, 0x2FFF)], 40, 500)])
def test_ids_and_decoding_are_the_library_s(library, texts):
    own = sp.codec()
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text
        assert own.decode(ids) == library.decode(want).encode()


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(1, 258), rng.randint(1, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 12))]
        assert sp.codec().decode(np.array(ids, np.int64)) == library.decode(ids).encode()


@pytest.mark.parametrize("text", ["the" * 60_000, " " * 60_000, "ab" * 100_000, "".join(strings(6, "etaoinshrdlu", 120_000, 1)), "word " * 100_000])
def test_long_texts_and_words(library, text):
    assert sp.codec().encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_rounds_agree_with_one_merge_at_a_time():
    """Merges by the definition: the best pair, leftmost first, one by one."""
    v = sp.codec().v
    for text in strings(7, "▁aeinorst", 25, 200):
        own = [int(v.char[ord(c)]) for c in text]
        while len(own) > 1:
            rank, piece = v.look_up(np.array(own[:-1]), np.array(own[1:]))
            at = int(np.argmin(rank))
            if rank[at] == sp.NEVER:
                break
            own[at : at + 2] = [int(piece[at])]
        symbols = np.array([v.char[ord(c)] for c in text], np.int64)
        assert sp.merge_rounds(v, symbols, np.zeros(len(symbols), np.int64))[0].tolist() == own
        assert sp.heap_merge(v, symbols.tolist()) == own


def test_a_full_memory_starts_afresh(library):
    own = sp.Codec(sp.codec().v, most=100)
    for text in strings(8, "abc de", 30, 50) * 2:
        assert own.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_rows(spark, library):
    rows = [(1, "one two", "x"), (2, None, "y"), (3, "", "z"), (1, "one two", "x"), (None, "né", "w"), (5, "a " * 50_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(2)
    got = sp.encode_documents(docs, keep_ids=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sp.encode_documents(docs.filter(F.lit(False))).count() == 0
