"""The prefix trie of conversations against brute force, and its stitching over any cut of the sorted paths."""

from __future__ import annotations

import collections
import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SMALL, cells  # noqa: E402

from lexiweave.llm import prefix_trie as trie  # noqa: E402
from lexiweave.llm.common import table  # noqa: E402
from lexiweave.llm.oracles import OP13_SQL  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, key string, part long, path string, first int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes of the trie of rebuilt conversations, all prefixes written out."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(p[-1][1].encode().split()) if p else 0
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[c] for c in children[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def nodes(df):
    return sorted(tuple(-1 if r[n] is None else r[n] for n in NAMES) for r in df.collect())


def conversations(seed: int, n: int, spread: int = 60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(spread), n):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["", "a", "b c", "d\te f"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "p", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rows = conversations(seed, 40)
    assert nodes(trie.prefix_trie(frame(spark, rows), fan_in=2)) == brute(rows)


def test_table(spark, duck):
    df = table(spark, SMALL, "conversations")
    got = trie.op13_prefix_trie(spark, SMALL)
    assert nodes(got) == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert cells(got.toPandas()) == cells(duck.execute(OP13_SQL).df())


def test_copies_and_odd_rows(spark):
    copies = [(c, t, "user", f"turn {t}") for c in range(100, 400) for t in range(3)]
    odd = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", " "), (None, 0, "user", "y"), (None, None, None, None), (3, 5, "", "z " * 5000), (20, 1, "user", "only"), (21, 1, "user", "a"), (22, 1, "user", "a")]
    rows = copies + odd
    assert nodes(trie.prefix_trie(frame(spark, rows))) == brute(rows)
    assert nodes(trie.prefix_trie(frame(spark, []))) == []
    assert nodes(trie.prefix_trie(frame(spark, [(None, 1, "a", "b")]))) == []


def test_every_cut_gives_the_same_nodes():
    """Sweeps over pieces of sorted paths, stitched in either shape of tree, against one sweep."""
    rng = random.Random(5)
    for _ in range(400):
        paths = sorted((b"".join(bytes([rng.randrange(3)]) * trie.CODE for _ in range(rng.randrange(5))), c) for c in range(rng.randrange(1, 14)))

        def spine_of(part, out, ends):
            s = trie.Sweep()
            for path, c in part:
                s.add(c, path, np.arange(len(path) // trie.CODE, dtype=np.int64) + 1, out)
            got = s.spine()
            ends.extend(s.fragments)
            return got

        def finished(spines, out, ends):
            if rng.random() < 0.5:
                spine = spines[0]
                for s in spines[1:]:
                    spine = trie.stitch(spine, s, out)
            else:
                while len(spines) > 1:
                    spines = [trie.stitch(*spines[i : i + 2], out) if i + 1 < len(spines) else spines[i] for i in range(0, len(spines), 2)]
                spine = spines[0]
            trie.finish(spine, out)
            joined = collections.defaultdict(list)
            for key, ids in ends:
                joined[key] += ids
            return sorted((*r[:8], trie._ends_hash(joined[r[0]]) if r[9] else r[8]) for r in out if r[1]) + [r[2:8] for r in out if not r[1]]

        whole, ends = [], []
        want = finished([spine_of(paths, whole, ends)], whole, ends)
        at = sorted({0, len(paths), *[rng.randrange(len(paths) + 1) for _ in range(rng.randrange(5))]})
        out, ends = [], []
        spines = [spine_of(paths[a:b], out, ends) for a, b in zip(at, at[1:])]
        assert finished(spines, out, ends) == want
