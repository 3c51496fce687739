import math
import random
from collections import Counter

import numpy as np

from vectide.llm import lmscore as M


def slow(texts, size):
    """Bigram probabilities of lists of words: Dirichlet over Witten-Bell over uniform."""
    lines = [["<s>", *t, "</s>"] for t in texts if t]
    pairs = Counter(p for x in lines for p in zip(x, x[1:]))
    ones, before = Counter(w for x in lines for w in x[1:]), Counter(v for x in lines for v in x[:-1])

    def p(v, w):
        low = (ones[w] + len(ones) / size) / (sum(ones.values()) + len(ones)) if ones else 1 / size
        return (pairs[v, w] + M.PRIOR * low) / (before[v] + M.PRIOR)

    return p


def test_words():
    assert M.words("it's 12 año_s -- 漢字kana ไทย") == ["it", "'", "s", "12", "año", "_", "s", "--", "漢", "字", "kana", "ไ", "ท", "ย"]


def test_planes():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.zeros(3, np.uint64), np.array([255, 256, 0]), rng.integers(0, 1 << 63, 1000).astype(np.uint64) * 2 + 1):
        assert (M.unpack(M.pack(x)) == x).all()


def test_scores_by_brute_force(documents, frame, odd, monkeypatch):
    rng = random.Random(1)
    vocabulary = ["red", "blue", "Год", "λόγος", "漢字", "x1"]
    rows = [(i, " ".join(rng.choices(vocabulary[: 3 if i % 2 else 6], k=rng.randint(1, 30))), None, None, None) for i in range(100, 140)]
    rows += [(101, rows[1][1], None, None, None)]
    table, good = documents(rows + odd), frame([(i,) for i in range(101, 140, 2)] + [(101,), (None,), (77777,)], "doc_id long")
    every = [M.words(t) for _, t, *_ in rows + odd]
    size = len({w for t in every for w in t}) + 1
    back, target = slow(every, size), slow([M.words(t) for i, t, *_ in rows if i % 2], size)
    want = []
    for i, t, *_ in rows + odd:
        x = ["<s>", *M.words(t), "</s>"]
        total = sum(math.log(target(v, w) / back(v, w)) for v, w in zip(x, x[1:]))
        want.append((i, len(x) - 2, total / (len(x) - 1) if len(x) > 2 else 0.0))
    want.sort(key=str)
    for group in (M.GROUP, 40):  # one group, and very many
        monkeypatch.setattr(M, "GROUP", group)
        got = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in M.score_corpus(table.repartition(3), good).collect()), key=str)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_blocks_of_a_partition(documents):
    """A partition of many blocks: each is named by itself, and their rows give the documents back."""
    M_BLOCK = M.BLOCK
    try:
        M.BLOCK = 5
        rows = [(i, f"a b c{i}") for i in range(10)]
        import pyarrow as pa

        class Context:
            @staticmethod
            def partitionId():
                return 7

        M_TASK, M.TaskContext = M.TaskContext, type("T", (), {"get": staticmethod(lambda: Context)})
        batches = [pa.record_batch([pa.array([i]), pa.array([t])], ["doc_id", "text"]) for i, t in rows]
        out = pa.Table.from_batches(list(M._blocks(batches)))
    finally:
        M.BLOCK, M.TaskContext = M_BLOCK, M_TASK
    assert len(set(out.column("block").to_pylist())) == 5 and min(out.column("block").to_pylist()) == 7 << 32
    for b in set(out.column("block").to_pylist()):
        block = M.Block(out.filter(pa.compute.equal(out.column("block"), b)))
        assert len(block.ids) == 2 and block.sizes.tolist() == [3, 3] and block.counts(np.ones(2, bool)).sum() == 8 + 8 + 2


def test_other_scripts_are_told_apart(spark, tmp_path):
    """In a mostly Latin corpus, a text in each of two other scripts: only one is in the target."""
    latin = "".join(map(chr, [*range(97, 123), *range(0xE0, 0xF7), *range(0xF8, 0x100)]))
    rows = [(i, f"{latin} {latin}") for i in range(50)] + [(100 + i, "добрый день друзья") for i in range(5)] + [(200 + i, "καλημερα στον κοσμο") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, 1) for i in range(4)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in M.op10_lmscore(spark, str(tmp_path)).collect()}
    assert got[104] > 0.5 and got[104] - got[204] > 0.5


def test_empty(documents, frame):
    none = frame([], "doc_id long")
    some = documents([(1, "abc", None, None, None), (2, None, None, None, None)])
    assert {r["doc_id"]: r["n_tokens"] for r in M.score_corpus(some, none).collect()} == {1: 1, 2: 0}
    assert M.score_corpus(documents([]), none).collect() == []
