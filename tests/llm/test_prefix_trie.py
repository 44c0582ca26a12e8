import collections
import hashlib
import random
import re
import zlib

import pytest

from innsight.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, name string"  # clashing extra columns


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, v in sorted(whole.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = collections.Counter(v[:-1] for v in members if v)
    leaves, saved = collections.Counter(), collections.Counter()
    for v, m in members.items():
        for d in range(len(v) + 1):
            leaves[v[:d]] += not children[v]
            saved[v[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) if v else 0
    digest = lambda v: hashlib.sha256(",".join(str(c) for c in members[v] if whole[c] == v).encode()).hexdigest()
    return sorted((m[0], len(v), members[v[:-1]][0] if v else None, len(m), children[v], leaves[v], saved[v], digest(v)) for v, m in members.items())


def got(spark, rows, parts=3):
    return sorted(map(tuple, prefix_trie.query(spark.createDataFrame(rows, SCHEMA).repartition(parts)).select(prefix_trie.COLUMNS).collect()))


@pytest.mark.parametrize("turns_a_part", [500_000, 40])
def test_equals_brute_force(spark, monkeypatch, turns_a_part):
    monkeypatch.setattr(prefix_trie, "TURNS", turns_a_part)  # few turns: many range partitions, so most nodes go over edges
    rnd = random.Random(turns_a_part)
    rows = [(c, t, rnd.choice(["user", None]), rnd.choice(["hi there", "hi", "", None, "a b  c\n"]), "x", None) for c in range(0, 220) if c % 7 for t in range(rnd.choice([1, 1, 2, 3, 5]))]
    rows += [(c, t, "user", f"turn {t}", None, None) for c in range(300, 420) for t in range(5)]  # copies of one conversation
    rows += [(500, t, "user", f"turn {t}", None, None) for t in range(150)] + [(501, t, "user", f"turn {t}" + " more" * (t > 120), None, None) for t in range(150)]
    rows += [(None, 1, "user", "nobody's", None, None), (600, None, "user", "first", None, None), (600, 0, "user", "second", None, None)]
    assert got(spark, rows) == brute(rows)


def test_repeats_and_ties(spark):
    rows = [(c, 1, "u", "same", None, None) for c in (20, 21, 22) for _ in range(3)]
    assert got(spark, rows) == brute(rows)
    tied = [(c, 1, "u", t, None, None) for c in (1, 2) for t in ("one", "two")]
    assert got(spark, tied) == got(spark, tied[::-1])  # turns of one number have an order of their own


def test_empty_and_turnless(spark):
    assert got(spark, [], 1) == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)  # its base is absent and it is shorter than its head: no turn is left
    assert got(spark, [(c, 0, "u", "t", None, None)]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_last_turns_of_nodes(spark):
    rows = [(c, t, "user", f"{t} word" * (t + 1), None, None) for c in (1, 2, 3) for t in range(3)]
    arrays = prefix_trie.turn_arrays(spark.createDataFrame(rows, SCHEMA))
    found = prefix_trie.node_turns(prefix_trie.trie(arrays), arrays).orderBy("depth").collect()
    assert [(r["conv_id"], r["depth"], r["turn"]) for r in found] == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
