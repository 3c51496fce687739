import random

from vectide.llm import decontam as D


def slow_tiles(a, b, least):
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k and k == best:
                    found.append((i, j))
        if best < least:
            return covered
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                covered += best


def test_tiles_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.choices([b"a", b"b", b"c"], k=rng.randint(1, 25))
        b = rng.choices([b"a", b"b", b"c", b"d"], k=rng.randint(0, 40))
        least = min(3, len(a))
        want = slow_tiles(a, b, least)
        near, most = D.near_seeds(a, b, least)
        assert most * len(a) + 1e-9 >= want
        assert sum(n for _, _, n in D.tiles(a, near, least)) == want == sum(n for _, _, n in D.tiles(a, b, least))


def by_id(docs, found):
    k, m = D.text_key(docs["text"])
    return {r["doc_id"]: r["coverage"] for r in docs.join(found, (k == found["k"]) & (m == found["l"])).select("doc_id", "coverage").collect()}


def test_each_row_is_decided_by_its_own_text(documents, frame):
    """Rows without an id and rows that repeat one: only those that hold the item go."""
    item = "quite unlike all other words here stand twelve more so that tiles match"
    rows = [(None, f"x {item} y"), (None, "clean words of a row without an id stand here"), (7, item), (7, "another clean text under the same id as one above"), (8, item), (None, None)]
    docs, bench = documents([(i, t, None, None, None) for i, t in rows]), frame([(1, item), (None, item), (1, item)], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in D.keep_clean(docs, bench).where("text is not null").collect()) == sorted([("None", rows[1][1]), ("7", rows[3][1])])
    assert D.keep_clean(docs, bench).count() == 3
    assert {r["n_items"] for r in D.contaminated(docs, bench).collect()} == {2}


def test_op1_rows(spark, documents, frame, tmp_path):
    item = "quite unlike all other words here stand twelve more so that tiles match"
    documents([(None, item, None, None, None), (None, "clean text without an id", None, None, None), (3, None, None, None, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    frame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted((str(r["doc_id"]), r["contaminated"], r["n_items"]) for r in D.op1_decontam(spark, str(tmp_path)).collect()) == [("3", False, 0), ("None", False, 0), ("None", True, 1)]


def test_a_phrase_of_all_items_is_not_joined_on(documents, frame):
    """Every item starts with one phrase: what holds the phrase alone is clean, what holds half an item is not."""
    rng = random.Random(8)
    phrase = "answer the following question in one word please"
    items = [(i, phrase + " " + " ".join(rng.choices([f"v{k}" for k in range(900)], k=40))) for i in range(30)]
    rows = [(i, f"text {phrase} and more {i}") for i in range(40)] + [(100 + i, "y " + " ".join(t.split()[20:]) + f" z{i}") for i, t in items]
    docs, bench = documents([(i, t, None, None, None) for i, t in rows]), frame(items, "item_id long, text string")
    assert sorted(by_id(docs, D.contaminated(docs, bench))) == [100 + i for i, _ in items]


def test_hashes_that_meet_without_words_end(monkeypatch):
    """All hashes alike: the words decide, and tiling comes to an end."""
    real = D._window
    monkeypatch.setattr(D, "_window", lambda h, free, size: (real(h, free, size)[0], real(h, free, size)[1] * 0))
    a, b = [b"a", b"b", b"c", b"d", b"e", b"f"], [b"a", b"b", b"c", b"x", b"d", b"e", b"f"]
    assert sorted(D.tiles(a, b, 3)) == [(0, 0, 3), (3, 4, 3)]


def test_documents_by_brute_force(documents, frame, odd):
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 20, 45])))) for i in range(12)] + [(90, None), (91, ""), (92, "word word word word word word"), (None, "no id but these words stand here")]
    rows = [(i, t) for i, t, *_ in odd]
    for i in range(100, 160):
        words = rng.choices(vocabulary, k=rng.choice([10, 200, 900]))
        kind = rng.random()
        if kind < 0.6:
            item = rng.choice([t for _, t in items if t]).split()
            if kind < 0.2:  # halves swapped
                item = item[len(item) // 2 :] + item[: len(item) // 2]
            elif kind < 0.3:
                item = item[: max(1, len(item) // 3)]
            words[5:5] = item
        rows.append((i, rng.choice([" ", "\n", ", "]).join(words).upper() if kind < 0.1 else " ".join(words)))
    docs, bench = documents([(i, t, None, None, None) for i, t in rows]), frame(items, "item_id long, text string")
    want = {}
    for i, t in rows:
        for _, b in items:
            w = D.words(b)
            c = slow_tiles(w, [x for x in D.words(t)][:2000], min(5, len(w))) / len(w) if w else 0
            if c >= D.THRESHOLD:
                want[i] = max(want.get(i, 0), c)
    got = by_id(docs, D.contaminated(docs, bench))
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    clean = D.keep_clean(docs, bench)
    assert clean.count() == sum(i not in want for i, _ in rows) and clean.columns == docs.columns


def test_empty(documents, frame):
    some, none = documents([(1, "a b c d e f", None, None, None)]), frame([], "item_id long, text string")
    assert D.contaminated(some, none).collect() == [] and D.keep_clean(some, none).count() == 1
    assert D.contaminated(documents([]), frame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


def test_hash_of_a_word_does_not_depend_on_its_place():
    import numpy as np

    _, _, h = D.word_hashes(np.frombuffer("Über, x UBER-über x".encode(), np.uint8))
    assert h[1] == h[4] and len(set(h.tolist())) == 4 - 0 - (h[0] == h[3])
