import numpy as np
import pytest

from vectide.llm import embdedup as D


def slow(rows):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(link[todo.pop()]).tolist()) - seen
            seen |= new
            todo += new
        out.append((rows[i][0], int(link[i].sum()), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def run(frame, rows):
    got = D.link_vectors(frame(rows, "vec_id long, embedding array<float>"))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("run_size", [4096, 64])
def test_by_brute_force(frame, monkeypatch, run_size):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(D, "RUN", run_size)
    monkeypatch.setattr(D, "WINDOW", 32)
    monkeypatch.setattr(D, "BLOCK", 16)
    rows = []
    for c in range(60):
        centre = rng.normal(size=32)
        for _ in range(int(rng.choice([1, 1, 2, 5, 40 if c < 3 else 1]))):
            rows.append((len(rows) + 7, (centre + rng.normal(size=32) * 0.12).astype(np.float32).tolist()))
    rows += [(rows[0][0] + 1000, rows[0][1]), (rows[0][0] + 1001, [x * 3 for x in rows[0][1]]), (rows[5][0], rows[5][1])]
    rows += [(2001, None), (2002, []), (2003, [0.0] * 32), (2004, [float("nan")] * 32), (2005, [float("inf")] + [1.0] * 31), (2006, [None] + [1.0] * 31), (2007, rows[0][1][:16]), (None, rows[1][1])]
    mine, want = run(frame, rows), slow(rows)
    assert np.mean([a == b for a, b in zip(mine, want, strict=True)]) >= (1.0 if run_size == 4096 else 0.97)


def test_empty(frame):
    assert run(frame, []) == []


def test_passes_follow_the_number_of_rows():
    assert 3 <= D.passes_needed(10) <= 5 and D.passes_needed(10**6) < D.passes_needed(10**9)


def test_extreme_magnitudes(frame):
    big = [3e38] * 4
    assert [r[1] for r in run(frame, [(1, big), (2, [1e-38] * 4), (3, [-1.0, 1.0, 1.0, 1.0])])] == [1, 1, 0]


def test_recall_inside_a_cone(monkeypatch):
    """A third of the rows has mean cosine 0.75: the passes that n alone asks for miss links, those that density asks for don't."""
    import pandas as pd

    monkeypatch.setattr(D, "WINDOW", 8)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = unit(rng.normal(size=(1, 64)))
    z = rng.normal(size=(3000, 64))
    cone = 0.75**0.5 * centre + 0.5 * unit(z - (z @ centre.T) * centre)
    z = rng.normal(size=(400, 64))
    near = 0.902 * cone[:400] + (1 - 0.902**2) ** 0.5 * unit(z - (z * cone[:400]).sum(1, keepdims=True) * cone[:400])
    x = np.concatenate([cone, near, unit(rng.normal(size=(5600, 64)))])
    a, b = np.nonzero(np.triu(x @ x.T >= D.THRESHOLD, 1))
    rows = pd.DataFrame({"cid": np.arange(len(x)), "dim": 64, "vec": list(x)})

    def recall(passes):
        group = np.arange(len(x))
        for keyed in D._key_batches(0, passes)([rows]):
            for i, j in D._compare_run(keyed).itertuples(index=False):
                group[group == group[i]] = group[j]
        return np.mean(group[a] == group[b])

    bits = D.bits_needed(x[rng.permutation(len(x))], len(x), 8)
    assert len(a) >= 400 and recall(D.passes_needed(len(x), window=8)) < 0.95
    assert recall(D.passes_needed(len(x), window=8, bits=bits)) >= 0.99
