"""Quantizers and sketches (Q1-Q13): fit -> encode -> estimate.

Scalar codes, packed sign bits and estimates are Catalyst expressions over parameters that fit in a row. Products that
need a matrix (rotation, Hadamard, product quantiser) run as one matrix product per Arrow batch.

Rounding is half away from zero throughout, as SQL's ROUND does on DOUBLE; NumPy's half-to-even is not used for codes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vectide.errors import require
from vectide.functions.vectors import hamming, int_dot, int_l2
from vectide.operators.exact import matrix_of
from vectide.session import share_code

MASK = (1 << 64) - 1


def value_range(base: DataFrame) -> tuple[float, float]:
    """Least and greatest coordinate of base(vec); partial per row, so nothing is exploded or shuffled but two numbers."""
    r = base.agg(F.min(F.array_min("vec")).alias("low"), F.max(F.array_max("vec")).alias("high")).first()
    require(r["low"] is not None, "quantizer", "no rows to fit")
    return float(r["low"]), float(r["high"])


def half_away(x: np.ndarray) -> np.ndarray:
    return np.trunc(x + np.copysign(0.5, x))


@dataclass(frozen=True)
class AffineCode:
    """Q1, Q2: codes 0..top, slope = top / max(range, 1e-9), offset = round(low * slope); estimate: squared L2 of codes."""

    low: float
    high: float
    top: int = 255

    @property
    def slope(self) -> float:
        return float(np.float32(self.top) / np.maximum(np.float32(self.high) - np.float32(self.low), np.float32(1e-9)))

    @property
    def offset(self) -> float:
        return float(half_away(np.float32(self.low) * np.float32(self.slope)))

    def encode(self, v: Column) -> Column:
        slope, offset = F.lit(self.slope).cast("float"), F.lit(self.offset)
        code = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(float(self.top)), F.round((x.cast("float") * slope).cast("double")) - offset)).cast("int")
        return F.transform(v, code)

    def estimate(self, q: Column, c: Column) -> Column:
        return int_l2(q, c)


@dataclass(frozen=True)
class SymmetricCode:
    """Q3, Q4: round(v * top / absmax), clamped to +-top; estimate: minus the product of codes."""

    absmax: float
    top: int = 127

    @property
    def scale(self) -> float:
        return 1.0 if self.absmax == 0 else float(np.float32(self.top) / np.float32(self.absmax))

    def encode(self, v: Column) -> Column:
        scale, top = F.lit(self.scale).cast("float"), float(self.top)
        return F.transform(v, lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.round((x.cast("float") * scale).cast("double")))).cast("int"))

    def estimate(self, q: Column, c: Column) -> Column:
        return -int_dot(q, c)


@dataclass(frozen=True)
class KernelTrickCode:
    """Q5: the 8-bit code less 128, with its squared norm; estimate: |q|^2 + |x|^2 - 2 q.x."""

    plain: AffineCode

    def encode(self, v: Column) -> Column:
        return F.transform(self.plain.encode(v), lambda c: F.greatest(F.lit(-128), F.least(F.lit(127), c - 128)))

    def estimate(self, q: Column, c: Column) -> Column:
        return int_dot(q, q) + int_dot(c, c) - 2 * int_dot(q, c)


def fit_l2_u8(base):
    return AffineCode(*value_range(base), 255)


def fit_l2_u16(base):
    return AffineCode(*value_range(base), 65535)


def fit_mips_i8(base):
    return SymmetricCode(max(map(abs, value_range(base))), 127)


def fit_mips_i16(base):
    return SymmetricCode(max(map(abs, value_range(base))), 32767)


def fit_l2_kt(base):
    return KernelTrickCode(fit_l2_u8(base))


def xorshift64(seed: int):
    """Marsaglia's 64-bit xorshift (13, 7, 17); a zero seed is replaced."""
    x = seed & MASK or 0x9E3779B97F4A7C15
    while True:
        x ^= x << 13 & MASK
        x ^= x >> 7
        x ^= x << 17 & MASK
        yield x


def sparse_indices(dim: int, bits: int = 1024, nonzeros: int = 9, seed: int = 42) -> list[list[int]]:
    """Q6: for each bit the axes it sums, every axis about equally often, shuffled by a seeded generator."""
    require(dim > 0 and bits > 0 and bits % 8 == 0 and nonzeros > 0, "jl", "bits must be whole bytes, dim and nonzeros positive")
    each, more = divmod(bits * nonzeros, dim)
    slots = [d for d in range(dim) for _ in range(each + (d < more))]
    draw = xorshift64(seed + 0xD1B54A32D192ED03)
    for i in range(len(slots) - 1, 0, -1):
        j = next(draw) % (i + 1)
        slots[i], slots[j] = slots[j], slots[i]
    return [slots[i * nonzeros : (i + 1) * nonzeros] for i in range(bits)]


@dataclass(frozen=True)
class SparseSketch:
    """Q6, Q7: bit = (sum of the first nonzeros // 2 axes less the sum of the others > 0), packed into BIGINTs."""

    indices: list[list[int]]

    def encode(self, v: Column) -> Column:
        """As an expression: one word of 64 bits at a time, over a literal table."""
        plus = len(self.indices[0]) // 2
        table = F.array(*[F.array(*[F.lit(i) for i in row]) for row in self.indices])
        part = lambda row, a, n: F.aggregate(F.slice(row, a, n), F.lit(0.0), lambda s, i: s + F.get(v, i).cast("double"))
        bit = F.transform(table, lambda row: (part(row, 1, plus) - part(row, plus + 1, len(self.indices[0]) - plus) > 0).cast("bigint"))
        word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, k: s.bitwiseOR(F.call_function("shiftleft", F.get(bits, w * 64 + k), k)))
        bits = bit
        return F.transform(F.sequence(F.lit(0), F.lit(len(self.indices) // 64 - 1)), word)

    def matrix(self, dim: int) -> np.ndarray:
        m = np.zeros((len(self.indices), dim))
        plus = len(self.indices[0]) // 2
        for b, row in enumerate(self.indices):
            for k, i in enumerate(row):
                m[b, i] += 1 if k < plus else -1
        return m

    def encode_table(self, base: DataFrame) -> DataFrame:
        return encode_signs(base, lambda x: x @ self.matrix(x.shape[1]).T > 0)

    def estimate(self, q: Column, c: Column, norm: Column | None = None) -> Column:
        d = hamming(q, c)
        return d if norm is None else d * norm


def fwht(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the row length must be a power of two."""
    x = x.copy()
    half = 1
    while half < x.shape[1]:
        y = x.reshape(len(x), -1, 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        half *= 2
    return x


@dataclass(frozen=True)
class HadamardSketch:
    """Q8: (signs, then transform) three times over rows padded to a power of two; bit = (x > 0)."""

    signs: tuple[np.ndarray, ...]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, len(self.signs[0]) - x.shape[1])))
        for s in self.signs:
            x = fwht(x * s)
        return x > 0


def hadamard_bits(dim: int, seed: int = 42) -> HadamardSketch:
    size = 1 << max(0, (dim - 1).bit_length())
    draw = xorshift64(seed)
    return HadamardSketch(tuple(np.array([1.0 if next(draw) & 1 else -1.0 for _ in range(size)]) for _ in range(3)))


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as little-endian BIGINT words."""
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _lists(values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), kind))


def encode_signs(base: DataFrame, bits) -> DataFrame:
    """(id, code) with the packed booleans of bits(matrix), one matrix per Arrow batch."""
    share_code(base.sparkSession)

    def batches(stream):
        for b in stream:
            if b.num_rows:
                yield pa.record_batch([b.column("id"), _lists(pack(bits(matrix_of(b.column("vec")))), pa.int64())], ["id", "code"])

    return base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(batches, "id long, code array<long>")


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix (QR of a Gaussian one, signs fixed)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotate(base: DataFrame, matrix: np.ndarray) -> DataFrame:
    """base(id, vec) with vec rotated; the matrix (dim x dim doubles) goes to every task."""
    share_code(base.sparkSession)
    shared = base.sparkSession.sparkContext.broadcast(matrix)

    def batches(stream):
        for b in stream:
            if b.num_rows:
                yield pa.record_batch([b.column("id"), _lists(matrix_of(b.column("vec")) @ shared.value.T, pa.float64())], ["id", "vec"])

    return base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(batches, "id long, vec array<double>")


@dataclass(frozen=True)
class OneBitCode:
    """Q9 over rotated vectors: base bit = (x >= 0), query bit = (x > 0); keeps |x| and L1 / L2.

    estimate: |q|^2 + |x|^2 - 2 s |x| / sqrt(2 D / pi), at least 0; s adds up the query's coordinates by the base's signs.
    """

    dim: int

    def encode(self, v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        ones = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
        return F.struct(F.transform(v, lambda x: (x >= 0).cast("int")).alias("bits"), norm.alias("norm"), F.coalesce(F.try_divide(ones, norm), F.lit(0.0)).alias("s"))

    def query_bits(self, v: Column) -> Column:
        return F.transform(v, lambda x: (x > 0).cast("int"))

    def estimate(self, q: Column, code: Column) -> Column:
        qq = F.aggregate(q, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        signed = F.aggregate(F.zip_with(q, code["bits"], lambda x, b: F.when(b == 1, x.cast("double")).otherwise(-x.cast("double"))), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), qq + code["norm"] * code["norm"] - 2 * signed * code["norm"] / math.sqrt(2 * self.dim / math.pi))

    @staticmethod
    def prefilter_active(dim: int) -> bool:
        """The prefilter does nothing unless a packed code is a multiple of 32 bytes long."""
        return -(-dim // 8) % 32 == 0


@dataclass(frozen=True)
class FourBitCode:
    """Q10 over rotated vectors: tau = max |x|, code = round(7 x / tau) within +-7; estimate by the product times tau / 7."""

    def encode(self, v: Column) -> Column:
        tau = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
        code = F.transform(v, lambda x: F.greatest(F.lit(-7.0), F.least(F.lit(7.0), F.round(F.coalesce(F.try_divide(x.cast("double") * 7, tau), F.lit(0.0))))).cast("int"))
        norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        return F.struct(code.alias("code"), tau.alias("tau"), norm.alias("norm2"))

    def estimate(self, q: Column, code: Column) -> Column:
        qq = F.aggregate(q, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        product = F.aggregate(F.zip_with(q, code["code"], lambda x, c: x.cast("double") * c), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), qq + code["norm2"] - 2 * product * code["tau"] / 7)


def kmeans(x: np.ndarray, centres: int, rounds: int = 12, seed: int = 42, plus_plus: bool = False) -> np.ndarray:
    """Lloyd's rounds from a seeded sample (or k-means++); an empty cluster keeps its centre, few rows are centres all."""
    if len(x) <= centres:
        return x.copy()
    rng = np.random.default_rng(seed)
    if plus_plus:
        c = x[[int(rng.integers(len(x)))]]
        while len(c) < centres:
            d = np.maximum(((x[:, None] - c[None]) ** 2).sum(2).min(1), 0) if len(c) < 32 else np.minimum(d, ((x - c[-1]) ** 2).sum(1))
            c = np.vstack([c, x[int(rng.choice(len(x), p=d / d.sum() if d.sum() else None))]])
    else:
        c = x[np.sort(rng.choice(len(x), centres, replace=False))].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[size > 0] = sums[size > 0] / size[size > 0][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row; ties to the lower."""
    return np.argmin((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], axis=1)


@dataclass(frozen=True)
class ProductCode:
    """Q11: one code book per chunk of axes; estimate: the sum of looked-up distances (L2) or products (-IP)."""

    books: list[np.ndarray]

    @classmethod
    def fit(cls, base: DataFrame, chunks: int | None = None, centres: int = 256, sample: int = 4096, seed: int = 42) -> ProductCode:
        """From at most `sample` rows, those with the least hash of id."""
        rows = base.select(F.col("vec").cast("array<double>").alias("vec")).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        require(rows, "pq", "no rows to fit")
        x = np.array([r["vec"] for r in rows])
        chunks = chunks or min(-(-x.shape[1] // 8), 64)
        return cls([kmeans(part, centres, seed=seed + i) for i, part in enumerate(np.array_split(x, chunks, axis=1))])

    def cuts(self) -> list[int]:
        return np.cumsum([b.shape[1] for b in self.books])[:-1].tolist()

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(p, b) for p, b in zip(np.split(x, self.cuts(), axis=1), self.books, strict=True)], axis=1)

    def encode_table(self, base: DataFrame) -> DataFrame:
        share_code(base.sparkSession)
        shared = base.sparkSession.sparkContext.broadcast(self)

        def batches(stream):
            for b in stream:
                if b.num_rows:
                    yield pa.record_batch([b.column("id"), _lists(shared.value.codes(matrix_of(b.column("vec"))).astype(np.int16), pa.int16())], ["id", "code"])

        return base.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(batches, "id long, code array<short>")

    def lookup(self, q: np.ndarray, inner_product: bool = False) -> np.ndarray:
        """Distances of a query's chunks to all centres: chunks x centres."""
        parts = np.split(q, self.cuts())
        most = max(len(b) for b in self.books)
        out = np.full((len(parts), most), np.inf)
        for i, (p, b) in enumerate(zip(parts, self.books, strict=True)):
            out[i, : len(b)] = -b @ p if inner_product else ((b - p) ** 2).sum(1)
        return out

    def estimate(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return table[np.arange(table.shape[0])[None], codes].sum(1)


def adc_estimate(codes: DataFrame, lookup: DataFrame) -> DataFrame:
    """ADC on tables: codes(id, code) and lookup(query_id, chunk, centre, d) to (query_id, id, estimate)."""
    long = codes.select("id", F.posexplode("code").alias("chunk", "centre"))
    return long.join(lookup, ["chunk", "centre"]).groupBy("query_id", "id").agg(F.sum("d").alias("estimate"))


def check_parameters(rows: int, dim: int) -> None:
    """Q13."""
    require(0 < rows < (1 << 32) - 1, "quantizer", "row count out of range", rows=rows)
    require(dim > 0, "quantizer", "dimension must be positive", dim=dim)
