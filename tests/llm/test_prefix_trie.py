"""The prefix trie beside a plain one that holds every prefix."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from ragtables.llm.prefix_trie import prefix_keys, prefix_trie, shared_turns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, node string, path string, depth long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", "p", 7) for r in rows], SCHEMA)


def plain(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = (*own.get(c - c % 20, [])[:h], *ts[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, found in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(found) - 1) * len(WORD.findall(path[-1][1])) if path else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def found(spark, rows, turns_per_range):
    out = prefix_trie(table(spark, rows), turns_per_range)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in out.collect())


def chatter(seed=1, convs=150):
    """Few different turns, so that conversations share prefixes; one group of equal conversations, some longer ones."""
    rng, rows = np.random.default_rng(seed), []
    for c in range(convs):
        n = 3 if c % 3 == 0 else int(rng.integers(1, 7))
        for t in range(n):
            pick = 0 if c % 3 == 0 else int(rng.integers(0, 3))
            rows.append((c, t, ("user", "assistant")[t % 2], f"turn {pick} of some words " * (pick + 1)))
    return rows


EDGE = [(1, None, None, None), (1, 0, "user", ""), (2, None, "", ""), (None, 0, "user", "lost"), (20, 5, "user", "b"), (20, 5, "user", "a"),
        (21, 0, "user", "a"), (21, 1, "user", "b"), (22, 0, "user", "a"), (22, 0, "user", "a"), (1003, 0, "us", "er"), (1004, 0, "u", "ser"),
        (5, 0, "user", "long " * 20000), (7, 2, "a", "\x0b1\t2"), (7, 1, "a", None), *[(40, t, "r", "again") for t in range(90)],
        *[(41, t, "r", "again") for t in range(70)]]


@pytest.mark.parametrize("turns_per_range", [3, 40, 8192])
def test_nodes_are_those_of_all_prefixes(spark, turns_per_range):
    rows = chatter()
    assert found(spark, rows, turns_per_range) == plain(rows)


@pytest.mark.parametrize("turns_per_range", [7, 8192])
def test_nulls_ties_repeats_and_missing_conversations(spark, turns_per_range):
    assert found(spark, EDGE, turns_per_range) == plain(EDGE)


def test_whole_group_ends_at_one_node_of_many_ranges(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(2)] + [(c, 0, "user", "same 0") for c in range(300, 400)]
    got = found(spark, rows, 16)
    assert got == plain(rows)
    assert max(r[3] for r in got) == 400


def test_empty_table_has_no_node(spark):
    assert prefix_trie(table(spark, [])).count() == 0
    assert prefix_trie(table(spark, [(None, 0, "user", "x")])).count() == 0


def test_shared_turns_and_keys():
    a, b = b"x" * 48, b"x" * 40 + b"y" * 8
    assert shared_turns(a, b) == 2 and shared_turns(a, a) == 3 and shared_turns(b"", a) == 0
    assert prefix_keys(a, 2) == prefix_keys(b, 2) and prefix_keys(a, 3) != prefix_keys(b, 3) and prefix_keys(a, -1) == []
