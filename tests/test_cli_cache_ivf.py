"""The command line, the graph cache and the IVF baseline."""

import json

import numpy as np
import pytest

from vectide.__main__ import main
from vectide.errors import EngineError
from vectide.operators import exact as X
from vectide.operators.cache import load_or_build
from vectide.operators.graph import GraphConfig
from vectide.operators.ivf import Ivf
from vectide.sources.vecfiles import convert_hdf5, write_vectors


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(11).normal(size=(200, 8)).astype(np.float32)


def test_command_line(spark, tmp_path, x, capsys):
    truth = np.argsort(((x[:20, None] - x[None]) ** 2).sum(2), axis=1)[:, :5]
    for name, a in (("b.fvecs", x), ("q.fbin", x[:20]), ("t.ivecs", truth)):
        write_vectors(str(tmp_path / name), a)
    common = ["--query", str(tmp_path / "q.fbin"), "--groundtruth", str(tmp_path / "t.ivecs"), "--k", "5"]
    out = main(["--base", str(tmp_path / "b.fvecs"), *common, "--degree", "10", "--build-l", "20", "--output", str(tmp_path / "o"), "--save", str(tmp_path / "s")])
    assert out["queries"] == 20 and out["recall"] >= 0.9
    assert spark.read.json(str(tmp_path / "o")).count() == 20
    assert main(["--snapshot", str(tmp_path / "s"), *common, "--exact"])["recall"] == 1.0
    with pytest.raises(EngineError):
        main(["--base", str(tmp_path / "b.fvecs"), *common, "--output", str(tmp_path / "o")])
    assert main(["--base", str(tmp_path / "b.fvecs"), "--query", "-", "--preflight"])["base"] == 200 * 8 * 4
    json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_cache(spark, tmp_path, x):
    base = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>")
    config = GraphConfig(degree=8, build_l=16, passes=1)
    a, first = load_or_build(base, config, "squared-l2", str(tmp_path))
    b, second = load_or_build(base, config, "squared-l2", str(tmp_path))
    c, third = load_or_build(base.where("id < 150"), config, "squared-l2", str(tmp_path))
    assert (first, second, third) == ("built", "cache", "built") and a.exceptAll(b).count() == 0 and c.count() == 150


def test_ivf(spark, tmp_path, x):
    base = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>")
    q = base.where("id < 10").selectExpr("id query_id", "vec")
    ivf = Ivf.build(base, lists=8)
    want = {(r["query_id"], r["rank"], r["id"]) for r in X.topk(base, q, 3).collect()}
    assert {(r["query_id"], r["rank"], r["id"]) for r in ivf.search(q, 3, probes=8).collect()} == want
    some = {(r["query_id"], r["id"]) for r in ivf.search(q, 3, probes=3).collect()}
    assert len(some & {(a, c) for a, _, c in want}) >= 20
    ivf.write(str(tmp_path / "ivf"))
    assert len(list((tmp_path / "ivf").glob("list=*"))) == 8


def test_hdf5_is_optional(tmp_path):
    with pytest.raises((EngineError, FileNotFoundError, OSError)):
        convert_hdf5(str(tmp_path / "none.h5"), str(tmp_path / "x.fbin"))
