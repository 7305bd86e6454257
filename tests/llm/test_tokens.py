import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.fixtures import awkward_docs, no_docs, pairs
from tokenizers import Tokenizer

from tessera.llm import bpe as B
from tessera.llm import packing as P

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIB, CODER = Tokenizer.from_file(BYTE), B.BytePairCoder(open(BYTE, encoding="utf-8").read())
WLIB, WORDS = Tokenizer.from_file(WORD), P.WordCoder(open(WORD, encoding="utf-8").read())
PARTS = ["a", "b", "the", " ", "  ", "'s", "\n", "\t", " ", "　", "é", "ß", "É", "İ", "Σ", "日", "1", "22", ".", ",", "!", "_", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "🤷", "é"]
texts = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_byte_level_matches_the_library(t):
    ids = CODER.encode_batch([t])[0].tolist()
    want = LIB.encode(t, add_special_tokens=False).ids
    assert ids == want and CODER.decode(ids) == LIB.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_word_level_matches_the_library(t):
    assert np.frombuffer(WORDS.encode([t])[0], WORDS.dtype).tolist() == WLIB.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=64))
def test_long_words_agree_with_rows(w):
    assert CODER.encode_long(w) == CODER.encode_rows([w])[0].tolist()


def test_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(B, "CACHE_ENTRIES", 3)
    coder = B.BytePairCoder(open(BYTE, encoding="utf-8").read())
    for t in ("alpha beta gamma delta", "beta epsilon", "alpha zeta eta theta", "beta beta"):
        assert coder.encode_batch([t])[0].tolist() == LIB.encode(t, add_special_tokens=False).ids


def test_encode_and_decode_tables(spark):
    docs = awkward_docs(spark)
    ids = B.encode(docs, BYTE)
    got = sorted((str(r.doc_id), r.ids) for r in ids.collect())
    assert got == sorted((str(d), LIB.encode(t or "", add_special_tokens=False).ids) for d, t in pairs(docs))
    assert sorted(map(str, pairs(B.decode(ids, BYTE)))) == sorted(str((d, t or "")) for d, t in pairs(docs))
    assert B.encode(no_docs(spark), BYTE).count() == 0


def test_nnls_reaches_the_optimum():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.random(8) * 10
        x = P.nnls(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and (slope > -1e-6).all() and abs(slope @ x) < 1e-5


def test_combinations_fill_the_window():
    got = P.combinations(12, 3)
    assert all(sum(c) == 12 and 2 <= len(c) <= 3 and list(c) == sorted(c, reverse=True) for c in got)
    assert len(got) == len(set(got)) == 6 + 12


def check_packing(rows, texts_, window):
    ids = {d: np.array([*WLIB.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for d, t in texts_}
    at, seqs = dict.fromkeys(ids, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : at[r.doc_id]].tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(at[d] == len(v) for d, v in ids.items())
    sizes = []
    for pieces in seqs.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        sizes.append(end)
    assert max(sizes) <= window and sum(s < window for s in sizes) <= 1


@pytest.mark.parametrize("window", [64, 256, 4096])
def test_packing_is_a_partition_without_padding(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice(["the", "water", "xyzzy", "é"]) for _ in range(int(rng.lognormvariate(4, 1.2))))) for i in range(150)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_packing(P.with_crc32(P.pack(docs, WORD, window=window)).collect(), rows, window)


def test_packing_takes_awkward_rows(spark):
    docs = awkward_docs(spark)
    packed = P.pack(docs, WORD).select("doc_id", "length", "sequence_id", "offset").collect()
    total = sum(len(WLIB.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs(docs))
    assert sum(r.length for r in packed) == total
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert P.with_crc32(P.pack(no_docs(spark), WORD)).count() == 0


def test_words_are_the_same_with_a_small_cache_and_it_is_given_back():
    rng = random.Random(4)
    coder = P.WordCoder(open(WORD, encoding="utf-8").read(), cache_bytes=4000)
    assert coder.direct
    letters = "abcdeéßüñçœšžÀÉŒİıſªǅʼnɐ日本"
    for _ in range(40):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "!?", "&&&", "'s", "’", "…", "9", ").", "́"]) for _ in range(60)]
        texts = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(5)] + ["<|endoftext|> A", ""]
        got = [np.frombuffer(x, dtype=coder.dtype).tolist() for x in coder.encode(texts)]
        assert got == [WLIB.encode(t, add_special_tokens=False).ids for t in texts]
    coder.forget()
    assert not coder.young and not coder.old


def test_a_word_is_looked_up_once_a_batch_however_often_it_occurs():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return dict.get(self, *args)

        def __getitem__(self, key):
            self.asked += 1
            return dict.__getitem__(self, key)

    coder = P.WordCoder(open(WORD, encoding="utf-8").read())
    coder.young = Counted()
    coder.encode(["Some water.  some WATER. " * 500] * 20)
    assert coder.young.asked < 100


def test_words_at_the_ends_of_texts_and_marks_behind_them():
    coder = P.WordCoder(open(WORD, encoding="utf-8").read())
    batch = ["", "a", ".", " ", "ab", ". cd", "ab. ", " ab", "!", "ab!. cd.. ef.\ngh,ij, 3. É. é, ́. z", "Ab. <|endoftext|>. AB. ", "", "\x1c.\x0b,\ta.\t", "日. 本", "x. "]
    for texts in (batch, batch[::-1], ["", ""], [" "], *([t] for t in batch)):
        got = [np.frombuffer(x, dtype=coder.dtype).tolist() for x in coder.encode(texts)]
        assert got == [WLIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_refuses_tokenizers_that_keep_case_or_space():
    with pytest.raises(ValueError):
        P.WordCoder(open(BYTE, encoding="utf-8").read())
