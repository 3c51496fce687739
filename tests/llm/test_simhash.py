import random

import numpy as np
import pytest
import xxhash

from vectide.llm import simhash as S
from vectide.llm.components import connected_components
from vectide.llm.scratch import Scratch


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], fps[i], min(ids, default=None)))
    return sorted(out, key=str)


def test_by_brute_force(documents, odd):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, t) for i, t, *_ in odd]
    for i in range(100, 180):
        words = rng.choices(vocabulary, k=rng.choice([2, 3, 40, 400, 1500]))
        rows.append((i, " ".join(words)))
        for k in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            if rng.random() < 0.8:
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i * 10 + k, " ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy)))
    got = S.near_duplicates(documents([(i, t, None, None, None) for i, t in rows]))
    mine = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got.collect()), key=str)
    assert mine == slow_groups(rows)


def test_long_runs_are_counted_in_pieces(monkeypatch):
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    ends = np.array([0, 3, 3, 700, 1000])
    whole = S.majority(h, ends)
    monkeypatch.setattr(S, "CHUNK", 7)
    assert (S.majority(h, ends) == whole).all() and whole[0] == whole[2] == 0


def test_keep_one(documents):
    one = "a b c d e f g h"
    rows = [(5, one), (2, one), (2, one), (9, "other words stand here now"), (None, one), (None, "lonely text of no id"), (None, "lonely text of no id"), (None, "LONELY text of no id"), (2, "a third text under a repeated id"), (None, None)]
    docs = documents([(i, t, None, None, None) for i, t in rows])
    kept = [(r["doc_id"], r["text"]) for r in S.keep_one(docs).collect()]
    lonely = {(None, "lonely text of no id"), (None, "LONELY text of no id")}
    assert len(lonely & set(kept)) == 1
    assert sorted((x for x in kept if x not in lonely), key=str) == sorted([(2, one), (9, rows[3][1]), (2, rows[8][1]), (None, None)], key=str)
    assert S.keep_one(docs).columns == docs.columns


def test_empty(documents):
    assert S.near_duplicates(documents([])).collect() == [] and S.keep_one(documents([])).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100), (100, 101), (None, 3)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
