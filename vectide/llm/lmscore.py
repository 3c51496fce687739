"""Document scores by cross-entropy difference (Moore and Lewis, 2010) of two word bigram models counted in Spark.

Target and background share one vocabulary: all words of the corpus and an end mark, none left out. A document's score is
the mean over its words and its end mark of the background loss minus the target loss, in nats: above zero it looks more
like the target than like the corpus. A word is a run of letters and digits in lower case, or a run of other marks; in
scripts written without spaces each character is a word.

1. Texts become blocks of whole documents, about BLOCK words each, as numbers into the block's own list of words.
2. A block sends each distinct bigram and word once, under 64 bits of hash, with its counts in all and in target
   documents. The hashes are dealt out by their first bits over as many groups as the corpus needs.
3. A group adds the counts up and answers each block with the corpus' counts, in the order in which it was asked.
4. The block computes its documents' scores from the answers.

Everything grows with the corpus and stays in Spark; what comes to the driver is one row of totals. A common word or bigram
is one number a block, so no key is hot. The numbers travel as compressed planes of bytes.

Smoothing: a bigram is interpolated with its word as if PRIOR more words had followed its first word (Dirichlet), a word
with the uniform distribution over the vocabulary as Witten and Bell do.

Edge cases: null and empty texts, and those without a word, score 0 with 0 tokens; null or unmatched ids in the target
list are ignored, repeated ones count once; with an empty target list the target model is uniform; repeated documents
count each time and keep a row each; an empty table gives an empty result; bytes that aren't UTF-8 count as U+FFFD; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectide.llm.scratch import Scratch, let_go, prepare, table, text_of

#: Scripts written without spaces: Thai and Lao, Burmese, Khmer, Kana, Han.
ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
WORD = re.compile(rf"[{ALONE}]|[^\W_{ALONE}]+|[^\w\s{ALONE}]+|_+")
PRIOR = 10.0
#: Words of a block, and distinct grams that a group adds up, both about.
BLOCK, GROUP = 2_500_000, 2_000_000
#: Names of what stands before the first word and after the last; words have the names that XXH64 gives them.
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

BLOCKS = "block long, part int, ids array<long>, sizes array<int>, codes binary, names binary"
ASKED = "p long, block long, grams binary, n binary, t binary"
ANSWERS = "p long, block long, n binary, t binary, kinds long, target_kinds long, tokens long, target_tokens long"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes, lowest first, no more planes than they need."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Numbers(dict):
    """The number of each word, in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = got = len(self)
        return got


def _blocks(stream):
    """A row for each batch of documents, and at the end of a block one with the names of its words."""
    let_go()
    block, part, size, numbers = TaskContext.get().partitionId() << 32, 0, 0, Numbers()

    def row(ids, sizes, codes, names):
        columns = [pa.array([block]), pa.array([part], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([codes], pa.binary()), pa.array([names], pa.binary())]
        return pa.record_batch(columns, ["block", "part", "ids", "sizes", "codes", "names"])

    def named():
        digest = xxhash.xxh64_intdigest
        return row(None, None, None, np.fromiter((digest(w.encode("utf-8", "replace")) for w in numbers), np.uint64, len(numbers)).tobytes())

    for b in stream:
        if not b.num_rows:
            continue
        sizes, codes = [], []
        for t in b.column("text"):
            found = words(t.as_py())
            sizes.append(len(found))
            codes.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
        yield row(b.column("doc_id").to_pylist(), sizes, pack(np.concatenate(codes)), None)
        part, size = part + 1, size + sum(sizes)
        if size >= BLOCK:
            yield named()
            block, part, size, numbers = block + 1, 0, 0, Numbers()
    if part:
        yield named()


class Block:
    """The documents of a block as bigrams, from its rows."""

    def __init__(self, rows: pa.Table):
        rows = rows.select(["part", "ids", "sizes", "codes", "names"]).to_pylist()
        parts = sorted((r for r in rows if r["codes"] is not None), key=lambda r: r["part"])
        name = next(r["names"] for r in rows if r["names"] is not None)
        #: Numbers count - 2 and count - 1 are what stands before the first word and the end mark.
        self.names = np.concatenate((np.frombuffer(name, np.uint64), [START, END]))
        self.count = len(self.names)
        self.starts = np.cumsum([0, *(len(r["ids"]) for r in parts)])
        self.ids = [i for r in parts for i in r["ids"]]
        self.sizes = np.concatenate([np.array(r["sizes"], np.int64) for r in parts])
        self.number = {r["part"]: k for k, r in enumerate(parts)}
        flat = np.concatenate([unpack(r["codes"]) for r in parts]).astype(np.int64)
        self.has = np.flatnonzero(self.sizes)
        full = self.sizes[self.has]
        ends = np.cumsum(full + 2)
        line = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        inner = np.ones(len(line), bool)
        inner[ends - 1] = inner[ends - full - 2] = False
        line[ends - full - 2], line[ends - 1], line[inner] = self.count - 2, self.count - 1, flat
        #: Every document's pairs: its size and one.
        first = np.ones(max(len(line) - 1, 0), bool)
        first[ends[:-1] - 1] = False
        line = (line[:-1] * self.count + line[1:])[first]
        del inner, first, flat
        self.ends = np.cumsum(full + 1)
        self.pairs, place = np.unique(line, return_inverse=True)
        self.place = place.astype(np.int32)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct bigrams, then of the words, in order; the lowest bit tells the words that can be predicted."""
        v, w = np.divmod(self.pairs, self.count)
        with np.errstate(over="ignore"):
            both = _mix(_mix(self.names)[v] + self.names[w])
            one = _mix(self.names ^ START)
        both, one = both & ~np.uint64(1), one | np.uint64(1)
        one[self.count - 2] &= ~np.uint64(1)
        g = np.concatenate((both, one))
        order = np.argsort(g)
        return g[order], order

    def counts(self, documents: np.ndarray) -> np.ndarray:
        """How often each of grams(), before they are ordered, comes in the documents that are true."""
        on = np.repeat(documents[self.has], self.sizes[self.has] + 1)
        both = np.bincount(self.place[on], minlength=len(self.pairs))
        second = np.bincount(self.pairs % self.count, both, self.count).astype(np.int64)
        second[self.count - 2] = np.count_nonzero(documents[self.has])
        return np.concatenate((both, second))

    def scores(self, n: np.ndarray, t: np.ndarray, kinds: int, target_kinds: int, tokens: int, target_tokens: int) -> np.ndarray:
        """Scores of the documents from the corpus' counts of grams(), before they are ordered."""
        v, w = np.divmod(self.pairs, self.count)
        size = len(self.pairs)
        p = (n[size:] + 1.0) / (tokens + kinds)
        q = (t[size:] + target_kinds / kinds) / (target_tokens + target_kinds) if target_kinds else np.full(self.count, 1.0 / max(kinds, 1))
        gain = np.log((t[:size] + PRIOR * q[w]) / (t[size:][v] + PRIOR)) - np.log((n[:size] + PRIOR * p[w]) / (n[size:][v] + PRIOR))
        out = np.zeros(len(self.sizes))
        if len(self.has):
            out[self.has] = np.add.reduceat(gain[self.place], np.concatenate(([0], self.ends[:-1]))) / (self.sizes[self.has] + 1)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ask(bits: int):
    def ask(rows: pa.Table) -> pa.Table:
        """What a block sends: for each group, its grams' hashes as steps from one to the next, and its counts of them."""
        block = Block(rows)
        good = np.zeros(len(block.sizes), bool)
        for r in rows.select(["part", "good"]).to_pylist():
            if r["good"] is not None:
                good[block.starts[block.number[r["part"]]] + np.array(r["good"], np.int64)] = True
        g, order = block.grams()
        n, t = block.counts(np.ones(len(good), bool))[order], block.counts(good)[order]
        group = (g >> np.uint64(64 - bits)) if bits else np.zeros(len(g), np.uint64)
        at = np.flatnonzero(np.diff(group, prepend=group[:1] + np.uint64(1)))
        spans = list(zip(at.tolist(), [*at[1:].tolist(), len(g)], strict=True))
        steps = [pack(np.diff(g[a:b], prepend=np.uint64(0))) for a, b in spans]
        id_ = rows.column("block")[0].as_py()
        columns = [pa.array([int(group[a]) for a, _ in spans], pa.int64()), pa.array([id_] * len(spans), pa.int64()), pa.array(steps, pa.binary()), pa.array([pack(n[a:b]) for a, b in spans], pa.binary()), pa.array([pack(t[a:b]) for a, b in spans], pa.binary())]
        return pa.table(columns, names=["p", "block", "grams", "n", "t"])

    return ask


def _answer(rows: pa.Table) -> pa.Table:
    """What a group answers to each block, and a row of totals without a block."""
    grams = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in rows.column("grams")]
    ends = np.cumsum([len(x) for x in grams]).tolist()
    distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
    del grams
    total = {c: np.bincount(place, np.concatenate([unpack(x.as_py()) for x in rows.column(c)]).astype(np.float64), len(distinct)).astype(np.int64) for c in ("n", "t")}
    word = (distinct & np.uint64(1)).astype(bool)
    spans = list(zip([0, *ends[:-1]], ends, strict=True))
    p, none = rows.column("p")[0].as_py(), [None] * len(spans)
    back = {c: [pack(total[c][place[a:b]]) for a, b in spans] + [None] for c in total}
    columns = [pa.array([p] * (len(spans) + 1), pa.int64()), pa.array([*rows.column("block").to_pylist(), None], pa.int64()), pa.array(back["n"], pa.binary()), pa.array(back["t"], pa.binary())]
    sums = [np.count_nonzero(word), np.count_nonzero(total["t"][word]), total["n"][word].sum(), total["t"][word].sum()]
    return pa.table([*columns, *(pa.array([*none, int(s)], pa.int64()) for s in sums)], names=[c.split()[0] for c in ANSWERS.split(", ")])


def _score(totals: list[int]):
    def score(rows: pa.Table) -> pa.Table:
        block = Block(rows)
        _, order = block.grams()
        told = sorted((r for r in rows.select(["p", "n", "t"]).to_pylist() if r["n"] is not None), key=lambda r: r["p"])
        n, t = np.empty(len(order)), np.empty(len(order))
        n[order], t[order] = (np.concatenate([unpack(r[c]) for r in told]) for c in ("n", "t"))
        return pa.table([pa.array(block.ids, pa.int64()), pa.array(block.scores(n, t, *totals)), pa.array(block.sizes)], names=["doc_id", "score", "n_tokens"])

    return score


def score_corpus(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(doc_id, score, n_tokens) for each row of docs(doc_id, text), with the target documents good(doc_id)."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "lmscore")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    blocks = scratch.keep(rows.mapInArrow(_blocks, BLOCKS), "blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    ids = good.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct()
    each = blocks.select("block", "part", F.posexplode("ids").alias("i", "id")).where("id is not null")
    marked = each.join(ids, "id", "left_semi").groupBy("block", "part").agg(F.collect_list("i").alias("good"))
    told = blocks.unionByName(marked, allowMissingColumns=True)
    asked = told.groupBy("block").applyInArrow(_ask((size // GROUP).bit_length()), ASKED)
    answers = scratch.keep(asked.groupBy("p").applyInArrow(_answer, ANSWERS), "answers")
    sums = answers.agg(*[F.sum(c) for c in ("kinds", "target_kinds", "tokens", "target_tokens")]).first()
    both = blocks.unionByName(answers.where("block is not null").select("block", "p", "n", "t"), allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(_score([x or 0 for x in sums]), "doc_id long, score double, n_tokens long")


def op10_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference; the target is what the labels call good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_corpus(docs, good)
