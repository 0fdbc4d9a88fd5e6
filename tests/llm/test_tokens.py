"""Token counts and SentencePiece coding, against the libraries."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from revlake.llm.pieces import Pieces, encode_and_decode, encode_digests
from revlake.llm.token_counts import MergeCounter, count_tokens

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCRAPS = [
    "<|endoftext|>", "<|endof", " ", "  ", "    ", "\n", "\t", "'s", "don't", "é", "漢字", "😀", "123", "a", "ab", " the", "ing",
    "\x85", "\x1c", "!!", "\r\n", "\x00", "ﬁ", "՘", "\U00033000", "▁", "<s>", "<0x41>", "<unk>", "aaaa", "abab", "́",
]


def scraps(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(SCRAPS) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library():
    lib, own = Tokenizer.from_file(BYTE_BPE), MergeCounter(open(BYTE_BPE, "rb").read())
    texts = scraps(3000)
    assert [own.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_heap_merges_long_words_in_order():
    lib, own = Tokenizer.from_file(BYTE_BPE), MergeCounter(open(BYTE_BPE, "rb").read())
    text = "".join(random.Random(1).choice("abcdehilnorst") for _ in range(20_000))
    assert own.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_count_tokens_odd_rows(make_docs, odd_pairs):
    lib = Tokenizer.from_file(BYTE_BPE)
    got = sorted(map(tuple, count_tokens(make_docs(odd_pairs), BYTE_BPE).collect()), key=repr)
    want = []
    for i, t in odd_pairs:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert count_tokens(make_docs([]), BYTE_BPE).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return Pieces(open(PIECE_BPE, "rb").read())


def test_pieces_equal_the_library(pieces):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    texts = scraps(4000)
    ids = pieces.encode_batch(texts)
    assert ids == lib.encode(texts)
    assert [pieces.decode(i) for i in ids] == [lib.decode(i) for i in ids]


def test_long_words_and_runs_of_spaces(pieces):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    r = random.Random(2)
    texts = [" " * 2500, " " * 9000, "".join(r.choice("abcdefgh") for _ in range(2500)), "".join(r.choice("abcdefgh") for _ in range(9000))]
    assert pieces.encode_batch(texts) == lib.encode(texts)


def test_decode_any_ids(pieces):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    r = random.Random(4)
    for _ in range(1500):
        ids = [r.choice([r.randint(3, 258), r.randint(259, 31_999), r.randint(0, 300)]) for _ in range(r.randint(0, 10))]
        assert pieces.decode(ids) == lib.decode(ids)


def test_decode_arrays_of_any_ids(pieces):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    r = random.Random(5)
    many = [[r.choice([r.randint(3, 258), r.randint(259, 31_999)]) for _ in range(r.randint(0, 10))] for _ in range(400)]
    for rows in (many, [[], [], many[3]], [[1, *many[1]], [2], many[2]], lib.encode(scraps(400))):
        ids, at = np.array(sum(rows, []), np.int32), np.cumsum([0, *map(len, rows)])
        assert pieces.decode_arrays(ids, at).to_pylist() == [lib.decode(x) for x in rows]


def test_arrays_of_texts_without_words(pieces):
    for texts in ([], ["", ""], ["", "a b", ""]):
        ids, at = pieces.encode_arrays(texts)
        assert len(at) == len(texts) + 1 and pieces.decode_arrays(ids, at).to_pylist() == texts


def test_words_in_use_are_not_merged_again(monkeypatch):
    """A full memory keeps the words of the batch at hand, those it knew before among them."""
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), Pieces(open(PIECE_BPE, "rb").read())
    monkeypatch.setattr("revlake.llm.pieces.MEMORY", 12)
    learnt, learn = [], own.learn
    monkeypatch.setattr(own, "learn", lambda words: learnt.append(sorted(words)) or learn(words))
    texts = ["common b c d e f g h i", "common j k l m", "common"]
    assert [own.encode_batch([t])[0] for t in texts] == lib.encode(texts)
    assert learnt[2] == [] and len(own.known) <= 12


def test_every_pair_is_found_by_its_hash(pieces):
    rank, at = pieces._ranks(pieces.pair[:-1] >> 32, pieces.pair[:-1] & 0xFFFFFFFF)
    assert (at == np.arange(len(at))).all() and (rank == pieces.rank[:-1]).all()
    left, right = np.random.default_rng(1).integers(0, 32_000, (2, 100_000))
    assert ((pieces._ranks(left, right)[0] < 1 << 40) == np.isin(left << 32 | right, pieces.pair)).all()


def test_encode_digests_odd_rows(make_docs, odd_pairs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for i, t in odd_pairs:
        ids = lib.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    docs = make_docs(odd_pairs)
    assert sorted(map(tuple, encode_digests(docs, PIECE_BPE).collect()), key=repr) == sorted(want, key=repr)
    decoded = encode_and_decode(docs, PIECE_BPE).collect()
    assert sorted(((r.doc_id, r.decoded) for r in decoded), key=repr) == sorted(((i, t or "") for i, t in odd_pairs), key=repr)
    assert encode_digests(make_docs([]), PIECE_BPE).count() == 0
