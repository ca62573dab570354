"""Fill-in-the-middle texts beside a plain version on strings."""

import hashlib
import re

import numpy as np
import pytest

from ragtables.llm.fill_middle import Piece, arranged, cut, fill_in_middle, restore, restored, token_ends
from tests.llm.test_operators import EDGE, docs

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKED = [(20 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M>", "<P", "S> <", "a<", " \n a", "a \n ", "é<P >", "  x", "a\x1cb c"])]


def plain(doc_id, text, rate=50):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    key = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("rate", [50, 100])
def test_texts_are_those_of_strings(spark, rate):
    rows = EDGE + MARKED + [(1000 + i, "one two  three\nfour é 日本 six ") for i in range(40)]
    got = restore(fill_in_middle(docs(spark, rows), rate=rate)).collect()
    want = []
    for doc_id, text in rows:
        n, form, prefix, middle, output = plain(doc_id, text, rate)
        want.append((doc_id or 0, n, form, prefix, middle, sha(output), sha(text or ""), text or ""))
    order = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256, r.restored)
                   for r in got), key=order) == sorted(want, key=order)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_outputs_are_texts_and_empty_tables_stay_empty(spark):
    got = {r.doc_id: r.output for r in fill_in_middle(docs(spark, MARKED), rate=100).collect()}
    assert got == {d: plain(d, t, 100)[-1] for d, t in MARKED}
    assert restore(fill_in_middle(docs(spark, []))).count() == 0


def test_cutting_splits_one_piece_and_permuting_back_restores():
    text = memoryview(b"hello world again")
    whole = [Piece(text, 0, 5), Piece(text, 5, 12)]
    for at in range(18):
        left, right = cut(whole, at)
        assert b"".join(p.bytes() for p in left) == bytes(text[:at]) and b"".join(p.bytes() for p in right) == bytes(text[at:])
        assert len(left) + len(right) <= 3
        middle, suffix = cut(right, min(3, 17 - at))
        for form in ("psm", "spm"):
            output = b"".join(p.bytes() for p in arranged({"prefix": left, "middle": middle, "suffix": suffix}, form))
            back = restored(Piece(memoryview(output), 0, len(output)), form)
            assert b"".join(p.bytes() for p in back) == bytes(text)


def test_token_ends_on_many_texts():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab \né"), rng.integers(0, 12))) for _ in range(500)]
    parts = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, parts)])
    places, at = token_ends(np.frombuffer(b"".join(parts), np.uint8), offsets)
    for i, text in enumerate(texts):
        lengths = np.cumsum([len(t.encode()) for t in TOKEN.findall(text)])
        assert (places[at[i] : at[i + 1]] - offsets[i]).tolist() == lengths.tolist()
