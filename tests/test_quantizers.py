"""Quantizers: hand-computed codes, estimates against NumPy, and the sketches' properties."""

import numpy as np
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import quantizers as Q


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")


def codes(df, fitted):
    return [r[0] for r in df.orderBy("id").select(fitted.encode(F.col("vec"))).collect()]


def test_affine_codes(spark):
    df = table(spark, [[0, 1], [2, 4]])
    u8 = Q.fit_l2_u8(df)
    assert u8.slope == 63.75 and u8.offset == 0
    assert codes(df, u8) == [[0, 64], [128, 255]]
    assert codes(df, Q.fit_l2_kt(df)) == [[-128, -64], [0, 127]]
    flat = table(spark, [[3, 3]])
    assert codes(flat, Q.fit_l2_u8(flat)) in ([[0, 0]], [[255, 255]])


def test_symmetric_codes(spark):
    df = table(spark, [[-2, 1], [0.5, 2]])
    assert codes(df, Q.fit_mips_i8(df)) == [[-127, 64], [32, 127]]
    assert codes(table(spark, [[0, 0]]), Q.SymmetricCode(0.0)) == [[0, 0]]


def test_sparse_sketch_expression_equals_matrix(spark):
    x = np.random.default_rng(1).normal(size=(20, 12)).astype(np.float32)
    s = Q.SparseSketch(Q.sparse_indices(12, bits=128))
    df = table(spark, x)
    by_matrix = [r["code"] for r in s.encode_table(df).orderBy("id").collect()]
    assert by_matrix == [r[0] for r in df.orderBy("id").select(s.encode(F.col("vec"))).collect()]
    counts = np.bincount(np.ravel(s.indices), minlength=12)
    assert counts.max() - counts.min() <= 1


def test_walsh_hadamard():
    h = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]], float)
    x = np.random.default_rng(2).normal(size=(5, 4))
    assert np.allclose(Q.fwht(x), x @ h)


def test_rotation_is_orthogonal():
    r = Q.rotation(16)
    assert np.allclose(r @ r.T, np.eye(16))


def test_product_codes(spark):
    x = np.random.default_rng(3).normal(size=(40, 8))
    pq = Q.ProductCode.fit(table(spark, x), chunks=2, centres=64)
    assert [len(b) for b in pq.books] == [40, 40]  # few rows are centres all
    got = {r["id"]: r["code"] for r in pq.encode_table(table(spark, x)).collect()}
    assert np.allclose(pq.estimate(pq.lookup(x[3]), np.array([got[i] for i in range(40)]))[3], 0, atol=1e-9)
    pq2 = Q.ProductCode([b[:4] for b in pq.books])
    assert pq2.codes(x).max() < 4


def test_kmeans_keeps_empty_clusters():
    x = np.array([[0.0], [0.0], [0.0], [10.0]])
    assert Q.kmeans(x, 2, seed=1).shape == (2, 1) and len(Q.kmeans(x, 2, plus_plus=True)) == 2


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.squared_l2("a", "b").alias("l2"), V.dot("a", "b").alias("ip"), V.cosine("a", "b").alias("cos"), V.normalized("b").alias("n"), V.early_abandon_l2("a", "b", F.lit(5.0)).alias("ea")).collect()
    assert (r[0]["l2"], r[0]["cos"], r[0]["n"], r[0]["ea"]) == (25.0, None, None, -1.0)
    assert (r[1]["l2"], r[1]["ip"], r[1]["cos"], r[1]["ea"]) == (4.0, -1.0, -1.0, 4.0)
    bits = spark.createDataFrame([([-1, 0], [0, 1])], "a array<bigint>, b array<bigint>")
    assert bits.select(V.hamming(F.col("a"), F.col("b"))).first()[0] == 65
