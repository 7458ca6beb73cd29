"""The trie of conversation prefixes against one built by dictionaries."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tallyloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_dictionaries(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    children, leaves, saved = defaultdict(list), {}, {}
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    for prefix in sorted(members, key=len, reverse=True):
        leaves[prefix] = sum(leaves[x] for x in children[prefix]) or 1
        saved[prefix] = (len(members[prefix]) - 1) * (len(prefix[-1][1]) if prefix else 0) + sum(saved[x] for x in children[prefix])
    digest = lambda found: hashlib.sha256(",".join(map(str, sorted(found))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(ends[p]))
        for p, m in members.items()
    )


def found(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, schema)).collect())


def made(seed, n):
    pick = random.Random(seed)
    ids = [None, -7, -3, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13]
    return [(pick.choice(ids), pick.choice([None, 1, 2, 2, 3]), pick.choice([None, "u", "a"]), pick.choice(["", None, "hi", "é"])) for _ in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, 1, "u", "x")],
        # Ties, repeated rows, null turns, roles and texts, negative ids.
        made(3, 120),
        # A conversation that holds most rows, beside one that agrees with it for long.
        [(100, i, "u", "x" * (i % 3)) for i in range(70)] + [(103, i, "u", "x" * (i % 3)) for i in range(37)] + [(7, 0, "u", "")],
        # Many equal conversations.
        [(5 * c, turn, "u", f"turn {turn}") for c in range(60) for turn in range(3)],
    ],
)
def test_as_by_dictionaries(spark, rows):
    assert found(spark, rows) == by_dictionaries(rows)


def test_members_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ends = spark.createDataFrame([(d, 1, c) for d in (1, 2) for c in range(40)], "depth long, node long, conv long")
    digest = hashlib.sha256(",".join(map(str, range(40))).encode()).hexdigest()
    assert sorted(map(tuple, prefix_trie.ends_digest(ends).collect())) == [(1, 1, digest), (2, 1, digest)]


def test_other_columns_with_names_of_its_own(spark):
    rows = [(1, 1, "u", "a", 9, "x"), (2, 1, "u", "a", 8, "y")]
    assert found(spark, rows, SCHEMA + ", pos long, block string") == by_dictionaries([r[:4] for r in rows])
