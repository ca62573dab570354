"""Encoding and decoding beside the library on whole texts."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ragtables.llm import tree_bpe
from ragtables.llm.queries import QUERIES
from tests.llm.test_operators import EDGE, docs, plain_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["It's we'LL 'S ''s don't've'd x'", "<|startoftext|>a<|endoftext|>B <|STARTOFTEXT|> <|endoftext| >", "éà ́x ẹ́",
         "\x1ca b\x85c\xa0d e\x00\x7f​", "İstanbul ǅ ΑΣ ς ﬁ ½ ² Ⅷ ٣ 123,4.5", "日本語テキスト" * 40, "😀👩‍👩‍👧 ok", "a" * 3000, "ab" * 900 + "!" * 700, "\t\n \v\f\r",
         "x " * 500, "ͅα ẞß", "_under_score__ a_b", "힣각", "'" * 50 + "s" * 50, " " * 2000 + "end",
         "<|startoftext|>" * 30 + "y" * 400 + "<|endoftext|>"]


@pytest.fixture(scope="module")
def vocabulary():
    return tree_bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("long, piece", [(tree_bpe.LONG, tree_bpe.PIECE), (20, 7), (0, 64)])
def test_ids_and_texts_are_those_of_the_library(spark, vocabulary, library, long, piece, monkeypatch):
    rows = EDGE + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(90 + i, "".join(TEXTS)) for i in range(2)]
    got = tree_bpe.decode_ids(tree_bpe.encode_texts(docs(spark, rows), vocabulary, long, piece), vocabulary).collect()
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id or 0, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in got) == sorted(want)


def test_query_over_the_table(spark, sf, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_tree_bpe"](spark, sf).collect()}
    rows = plain_documents(sf)
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        texts = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        assert got[doc_id] == (len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts))


def test_empty_table(spark, vocabulary):
    assert tree_bpe.decode_ids(tree_bpe.encode_texts(docs(spark, []), vocabulary), vocabulary).count() == 0


def test_leaves_join_to_the_encoding_of_the_word(vocabulary):
    """Any halves of any word, also where the first window disagrees."""
    encoder = tree_bpe.Encoder(vocabulary)
    rng = np.random.default_rng(5)
    words = ["a" * 97, "ab" * 60, "hahaha" * 30, *["".join(rng.choice(list("aehinrst"), rng.integers(2, 90))) for _ in range(400)]]
    grown = 0
    for word in words:
        want = [t.id for t in encoder.closed.tokenize(word)]
        at = int(rng.integers(1, len(word)))
        left, right = encoder.leaf(word[:at], False), encoder.leaf(word[at:], True)
        assert encoder.join(word[:at], left, word[at:], right, True).tolist() == want
        grown += not (left.tolist() + right.tolist() == want)
        leaves = tree_bpe.halves(word, 5)
        assert "".join(leaves) == word
        parts = [(x, encoder.leaf(x, i == len(leaves) - 1)) for i, x in enumerate(leaves)]
        assert encoder.tree(parts).tolist() == want
    assert grown > 200


def test_pieces_are_the_text_in_order(vocabulary):
    encoder = tree_bpe.Encoder(vocabulary)
    for text in (*TEXTS, " a  b " * 30, ""):
        for most in (3, 16, 200):
            found = list(tree_bpe.pieces(encoder, text, most))
            assert all(len(p) <= most or p in encoder.special for _, _, p in found)
            if all(kind == tree_bpe.TEXT for kind, _, _ in found):
                assert " ".join(text.split()) == " ".join(" ".join(p for _, _, p in found).split()) or "\x1c" in text


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tree_bpe.Encoder(tree_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
