"""Vector files, staged graphs, sinks and query streams."""

import numpy as np
import pytest

from vectide.errors import EngineError
from vectide.operators.graph import SCHEMA
from vectide.sources import sinks, staged, vecfiles as F
from vectide.streaming.queries import exact_stream, query_source


@pytest.mark.parametrize("kind", list(F.FORMATS))
def test_round_trip(spark, tmp_path, kind):
    x = np.random.default_rng(1).integers(0, 100, (50, 7))
    path = str(tmp_path / f"x.{kind}")
    F.write_vectors(path, x, kind)
    for df in (F.read_vectors(spark, path), F.read_small(spark, path, kind)):
        assert [r["vec"] for r in df.orderBy("id").collect()] == x.tolist()
    assert F.read_vectors(spark, path, max_points=3).count() == 3
    with pytest.raises(FileExistsError):
        F.write_vectors(path, x, kind)
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(EngineError) as e:
        F.read_vectors(spark, path)
    assert e.value.code == "INVALID_DATA"


def test_formats():
    assert F.format_of("a/b") == "fvecs" and F.format_of("x.U8BIN") == "u8bin"
    with pytest.raises(EngineError):
        F.format_of("x.csv")


def test_arrays_and_padding(spark):
    df = F.from_array(spark, np.ones((2, 3), np.float32))
    assert F.zero_pad(df, 4).first()["vec"] == [1, 1, 1, 0]
    for bad in (np.ones(3, np.float32), np.ones((2, 2)), np.ones((0, 2), np.float32)):
        with pytest.raises(EngineError):
            F.from_array(spark, bad)


def test_ground_truth(spark):
    df = spark.createDataFrame([(0, [3, 1]), (1, [0, 2])], "id long, vec array<int>")
    assert [(r["query_id"], r["rank"], r["id"]) for r in F.ground_truth(df, 2, 4).orderBy("query_id", "rank").collect()] == [(0, 1, 3), (0, 2, 1), (1, 1, 0), (1, 2, 2)]
    for k, n in ((3, 4), (2, 3)):
        with pytest.raises(EngineError):
            F.ground_truth(df, k, n)


@pytest.mark.parametrize("about", [None, {"metric": "squared-l2"}])
def test_staged_graphs(spark, tmp_path, about):
    g = spark.createDataFrame([(0, [1], [2], []), (1, [0], [], [2]), (2, [], [0], [])], SCHEMA)
    path = str(tmp_path / "g.staged")
    staged.write_staged(path, g, 1, about)
    back, head = staged.read_staged(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, g.collect())) and head["entry"] == 1
    for damage in (lambda r: r + b"\0\0\0\0", lambda r: r[:-4], lambda r: b"x" + r[1:], lambda r: r[:-4] + b"\x09\0\0\0"):
        with open(path, "rb") as f:
            raw = f.read()
        bad = tmp_path / "bad.staged"
        bad.write_bytes(damage(raw))
        with pytest.raises(EngineError):
            staged.read_staged(spark, str(bad))


def test_result_sink_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(0, 2, 7, 0.5), (0, 1, 3, 0.1)], "query_id long, rank int, id long, score double")
    sinks.write_results(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["ids"] == [3, 7]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_results(df, str(tmp_path / "r"))


def test_query_stream(spark, tmp_path):
    base = spark.createDataFrame([(0, [0.0]), (1, [5.0])], "id long, vec array<double>")
    for i, v in enumerate((1.0, 4.0)):
        spark.createDataFrame([(i, [v])], "query_id long, vec array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = exact_stream(base, query_source(spark, str(tmp_path / "in")), 1, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("query_id").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(0, 0), (1, 1)] and len({r["batch"] for r in got}) == 2
