"""Toxicity: a learned lexicon in a trie, Levenshtein automata for misspellings, windows that tell quotation from abuse.

Fit. From a bounded sample of labelled rows (MOST_TOXIC and MOST_CLEAN of them, those with the least hash of doc_id) the
words and word beginnings that set toxic documents apart become the lexicon: a beginning where words with many endings
share it, the word itself otherwise. A term must come in at least half as many surroundings as documents, so that copies of one text teach nothing.
What lies within one edit of a term in the sample is weighed too; ordinary words that happen to be near stay harmless. A
misspelling that no clean row holds reaches the threshold alone, whatever its length; a beginning that has ordinary words
near it is only matched exactly.

Score. Every word of a text is looked up in the trie, exactly and by a Levenshtein automaton of the word that is
intersected with the trie. A hit counts with its weight; in a window of WINDOW words around it, quotation marks or
reporting words make it a quotation, which counts little however often it comes. Free hits combine as independent
evidence: 1 - product of (1 - weight).

Edge cases: null and empty texts score BASE; nulls in labels are no labels; of several labels of a document the largest
counts; without toxic or clean training rows the lexicon is empty and all score BASE; repeated rows keep a row each; an
empty table gives an empty result; bytes that aren't UTF-8 count as U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectide.llm.scratch import Scratch, prepare, table, text_of

MOST_TOXIC, MOST_CLEAN = 10_000, 20_000
#: A term's least share of toxic documents, least number of them, least surroundings, least precision where both classes
#: are equally frequent, least precision as frequent as they are, and what its log-likelihood ratio must exceed twice the
#: logarithm of the number of candidates by: so much as chance hardly reaches among that many.
SHARE, LEAST, SURROUNDINGS, PRECISION, SURE, EVIDENCE = 0.01, 4, 3, 0.9, 0.75, 7.0
#: Lengths of word beginnings that may become terms; the length from which a word is held against the automaton.
BEGINNINGS, FUZZY_FROM = range(4, 9), 4
WINDOW, QUOTED, BASE, THRESHOLD = 4, 0.2, 0.01, 0.3
#: Classified words kept by a worker, and counts that it gathers before it passes them on.
MOST_WORDS, AT_ONCE = 100_000, 30_000

# Quotation marks, and words that report what others say.
MARKS = "\"'`“”„«»‘’‹›"
REPORTING = frozenset("word words term terms quote quoted quotes said says wrote called insult insults slur slurs wort wörter begriff zitat sagte schrieb mot mots terme dit citation palabra palabras término dijo cita".split())

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Automaton:
    """Levenshtein automaton of a word for one edit (insertion, deletion, substitution), and swapped neighbours."""

    def __init__(self, word: str):
        self.word = word
        self.start = frozenset({(0, 0), (1, 1)}) if word else frozenset({(0, 0)})

    def step(self, state, c):
        w, out = self.word, set()
        for at, edits in state:
            if at < 0:  # between two swapped letters: -1 - place
                place = -1 - at
                if w[place] == c:
                    out.add((place + 2, 1))
                continue
            if at < len(w) and w[at] == c:
                out.add((at + 1, edits))
                if not edits and at + 2 <= len(w):
                    out.add((at + 2, 1))
            if not edits:
                out.add((at, 1))
                if at < len(w):
                    out.add((at + 1, 1))
                if at + 1 < len(w) and w[at + 1] == c:
                    out.add((-1 - at, 1))
                    out.add((at + 2, 1))
        return frozenset(out)

    def accepts(self, state):
        """Edits needed if the word may end here, or else None."""
        n = len(self.word)
        found = [e + (n - at) for at, e in state if at >= 0 and n - at + e <= 1]
        return min(found, default=None)


class Lexicon:
    """words and beginnings: term -> weight; variants: misspelling -> learned weight; loose: beginnings with ordinary words near them, which count exactly."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], variants: dict[str, float] | None = None, loose: set[str] | None = None):
        self.words, self.beginnings, self.variants = words, beginnings, variants or {}
        self.sizes = sorted({len(b) for b in beginnings})
        self.terms, self.loose = beginnings | words, loose or set()
        open_ended = [b for b in beginnings if len(b) >= FUZZY_FROM and b not in self.loose]
        self.trie: dict = {}
        # "" ends a word, "*" a beginning, after which any letters may follow
        for w, end in [*((w, "") for w in words), *((b, "*") for b in open_ended)]:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[end] = w
        # a word within one edit shares its first or its last half with the term, or the halves' inner letters are swapped
        fuzzy = [w for w in words if len(w) >= FUZZY_FROM]
        self.heads = {w[: len(w) // 2] for w in fuzzy} | {w[: len(w) // 2 - 1] + w[len(w) // 2] for w in fuzzy}
        self.tails = {w[-(len(w) // 2) :] for w in fuzzy}
        self.cut = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.span = (min(map(len, fuzzy)) - 1, max(map(len, fuzzy)) + 1) if fuzzy else (1, 0)
        # the same for beginnings, whose last half ends at most one letter before or after their length
        fuzzy = open_ended
        self.first = {b[: len(b) // 2] for b in fuzzy} | {b[: len(b) // 2 - 1] + b[len(b) // 2] for b in fuzzy}
        self.last = {b[-(len(b) // 2) :] for b in fuzzy}
        self.starts = sorted({len(x) for x in self.first}), sorted({(len(b) + d, len(b) // 2) for b in fuzzy for d in (-1, 0, 1)})
        self.known: dict[str, float] = {}

    def near(self, word: str) -> str | None:
        """The term within one edit of the word, or of a start of it for a beginning, found by walking trie and automaton together.

        The last letter of a beginning must come: a word that only shares the letters before it is another word.
        """
        if not self.may_be_near(word):
            return None
        machine, found = Automaton(word), []
        stack = [(self.trie, machine.start, "")]
        while stack:
            node, state, path = stack.pop()
            if "" in node and len(node[""]) >= FUZZY_FROM and machine.accepts(state) is not None:
                found.append(node[""])
            if "*" in node and any(at > 0 and (word[at - 1] == path[-1] or word[at - 2 : at] == path[:-3:-1]) for at, _ in state):
                found.append(node["*"])
            for c, child in node.items():
                if c and c != "*" and (to := machine.step(state, c)):
                    stack.append((child, to, path + c))
        return min(found, key=lambda t: (-self.terms[t], t), default=None)

    def may_be_near(self, word: str) -> bool:
        """Whether the word has a half of a term, which nearly no word has; asked of every word, hence plain loops."""
        size = len(word)
        if self.span[0] <= size <= self.span[1]:
            heads, tails = self.heads, self.tails
            for k in self.cut[0]:
                if word[:k] in heads:
                    return True
            for k in self.cut[1]:
                if word[-k:] in tails:
                    return True
        first, last = self.first, self.last
        for k in self.starts[0]:
            if word[:k] in first:
                return True
        for e, k in self.starts[1]:
            if e <= size and word[e - k : e] in last:
                return True
        return False

    def starts_like(self, word: str) -> float:
        """The weight of the beginnings that the word has."""
        best, size, weights = 0.0, len(word), self.beginnings
        for k in self.sizes:
            if k > size:
                break
            x = weights.get(word[:k], 0.0)
            if x > best:
                best = x
        return best

    def unseen(self, term: str) -> float:
        """The weight of a misspelling that the sample doesn't hold: alone it reaches the threshold."""
        return max(THRESHOLD, self.terms[term] * (0.6 if len(term) >= 8 else 0.45))

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            got = self.words.get(word, 0.0) or self.starts_like(word)
            if not got:
                got = self.variants.get(word)
            if got is None:
                got = self.unseen(term) if (term := self.near(word)) else 0.0
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            self.known[word] = got
        return got

    def score(self, text: str | None) -> float:
        if not text:
            return BASE
        low = text.lower()
        weights = {w: x for w in set(_TOKEN.findall(low)) if (x := self.weight(w)) > 0}
        if not weights:
            return BASE
        found = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(low)]
        free, quoted = 1.0, 0.0
        for i, (w, a, b) in enumerate(found):
            x = weights.get(w)
            if x:
                around = found[max(0, i - WINDOW) : i + WINDOW + 1]
                marked = low[a - 1 : a] in MARKS and low[b : b + 1] in MARKS if a and b < len(low) else False
                before, after = low[around[0][1] : a], low[b : around[-1][2]]
                marked = marked or any(before.count(q) % 2 and q in after for q in "\"“«„")
                if marked or any(t in REPORTING for t, _, _ in around):
                    quoted = max(quoted, x)
                else:
                    free *= 1 - x
        return max(BASE, 1 - free, quoted * QUOTED)


def parts(word: str) -> list[str]:
    """A word's forms as terms: itself as `=word`, and its beginnings."""
    return ["=" + word, *(word[:k] for k in BEGINNINGS if k <= len(word))]


def sets_apart(x: int, y: int, n_toxic: int, n_clean: int, candidates: int) -> bool:
    """Whether a term in x of n_toxic and y of n_clean documents is precise, and too frequent in the former for chance among so many candidates."""
    a, b = x / n_toxic, y / n_clean
    both = (x + y) / (n_toxic + n_clean)
    likelihood = 2 * (x * math.log(a / both) + (y * math.log(b / both) if y else 0.0))
    return a / (a + (y + 0.5) / n_clean) >= PRECISION and likelihood >= EVIDENCE + 2 * math.log(candidates)


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, candidates: int, odds: float = 1.0) -> dict[str, float]:
    """Terms that set toxic documents apart, with their precision where toxic ones are `odds` times as frequent as clean ones.

    Of nested terms the longest that lose little.
    """
    good = {}
    for t, x in toxic.items():
        if sets_apart(x, clean.get(t, 0), n_toxic, n_clean, candidates):
            a = odds * x / n_toxic
            p = a / (a + (clean.get(t, 0) + 0.5) / n_clean)
            if p >= SURE:
                good[t] = min(p, 0.99)
    kept: dict[str, float] = {}
    longest = sorted(good, key=lambda t: (-len(t.lstrip("=")), t[0] != "=", t))
    held: dict[str, int] = {}  # beginning -> the most that a kept longer form covers
    for t in longest:
        bare = t.lstrip("=")
        if toxic[t] * 0.85 > held.get(bare if t[0] != "=" else "", 0):
            kept[t] = good[t]
            for k in range(min(BEGINNINGS), len(bare) + (t[0] == "=")):
                held[bare[:k]] = max(held.get(bare[:k], 0), toxic[t])
    return {t: p for t, p in kept.items() if not any(t.lstrip("=")[:k] in kept for k in BEGINNINGS if k < len(t.lstrip("=")) + (t[0] == "="))}


def _totals(df: DataFrame) -> list:
    return df.groupBy("term", "toxic").agg(F.sum("n").alias("n")).collect()


def _document_counts(wanted: set[str] | None):
    def batches(frames):
        for f in frames:
            for label, part in f.groupby("toxic"):
                got: Counter[str] = Counter()
                for t in part["text"]:
                    forms = {p for w in set(tokens(t)) for p in parts(w)}
                    got.update(forms if wanted is None else forms & wanted)
                    if len(got) > AT_ONCE:
                        yield pd.DataFrame({"term": list(got), "toxic": label, "n": list(got.values())})
                        got = Counter()
                if got:
                    yield pd.DataFrame({"term": list(got), "toxic": label, "n": list(got.values())})

    return batches


def _surroundings(wanted: set[str]):
    def batches(frames):
        for f in frames:
            seen = set()
            for t in f["text"]:
                words = tokens(t)
                for i, w in enumerate(words):
                    for p in parts(w):
                        if p in wanted:
                            seen.add((p, (words[i - 1] if i else "") + " " + (words[i + 1] if i + 1 < len(words) else "")))
                if len(seen) > AT_ONCE:
                    yield pd.DataFrame(sorted(seen), columns=["term", "around"])
                    seen = set()
            if seen:
                yield pd.DataFrame(sorted(seen), columns=["term", "around"])

    return batches


def _variant_counts(lexicon: Lexicon):
    def batches(frames):
        for f in frames:
            for label, part in f.groupby("toxic"):
                got: Counter[str] = Counter()
                for t in part["text"]:
                    got.update(w for w in set(tokens(t)) if w not in lexicon.words and not lexicon.starts_like(w) and lexicon.near(w))
                if got:
                    yield pd.DataFrame({"term": list(got), "toxic": label, "n": list(got.values())})

    return batches


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon of docs(doc_id, text) and labels(doc_id, toxic), learned where crc32(doc_id) mod 4 is not 2."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "toxicity")
    rule = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    known = labels.where(F.col("toxic").isNotNull() & rule).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("_id"))
    some = known.where("toxic = 1").orderBy("h", "_id").limit(MOST_TOXIC).union(known.where("toxic = 0").orderBy("h", "_id").limit(MOST_CLEAN))
    some = scratch.keep(some.select("_id", "toxic"), "sample")
    # at most MOST_TOXIC + MOST_CLEAN ids of 12 bytes are broadcast; copies of a text teach once
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    rows = scratch.keep(rows.select("text", "toxic").dropDuplicates(["text"]), "rows")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    odds = known.agg((F.sum("toxic") + 1) / (F.sum(1 - F.col("toxic")) + 1)).first()[0]
    if not n_toxic or not n_clean:
        return Lexicon({}, {})
    counted = rows.where("toxic = 1").mapInPandas(_document_counts(None), "term string, toxic int, n long")
    least = max(LEAST, round(SHARE * n_toxic))
    toxic = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    wanted = spark.sparkContext.broadcast(set(toxic))
    clean = {r["term"]: r["n"] for r in _totals(rows.where("toxic = 0").mapInPandas(lambda f: _document_counts(wanted.value)(f), "term string, toxic int, n long"))}
    apart = {t for t, x in toxic.items() if sets_apart(x, clean.get(t, 0), n_toxic, n_clean, len(toxic))}
    around = rows.where("toxic = 1").mapInPandas(_surroundings(apart), "term string, around string")
    places = around.groupBy("term").agg(F.countDistinct("around").alias("n")).collect()  # at most one row a term
    varied = {r["term"] for r in places if r["n"] >= max(SURROUNDINGS, toxic[r["term"]] // 2)}
    terms = choose({t: x for t, x in toxic.items() if t in varied}, clean, n_toxic, n_clean, len(toxic), odds)
    lexicon = Lexicon({t[1:]: p for t, p in terms.items() if t[0] == "="}, {t: p for t, p in terms.items() if t[0] != "="})
    if lexicon.terms:
        seen: dict[str, dict[int, int]] = {}
        for r in _totals(rows.mapInPandas(_variant_counts(lexicon), "term string, toxic int, n long")):
            seen.setdefault(r["term"], {})[r["toxic"]] = r["n"]
        # any letters may follow a beginning: it is loose if a word near it is likelier to come from a clean row; all
        # beginnings' words together count as one more of each
        kinds: dict[str, Counter[int]] = {b: Counter() for b in lexicon.beginnings}
        for w, n in seen.items():
            if (t := lexicon.near(w)) in kinds:
                kinds[t].update(n.keys())
        every, loose = sum(kinds.values(), Counter()), set()
        if size := every.total():
            loose = {t for t, k in kinds.items() if odds * (k[1] + every[1] / size) / n_toxic <= (k[0] + every[0] / size) / n_clean}
        for w, n in seen.items():
            bad, good = n.get(1, 0) / n_toxic, n.get(0, 0) / n_clean
            if n.get(0, 0) > 1 or not n.get(1):
                lexicon.variants[w] = 0.0
            elif n[1] >= LEAST:
                learned = min(0.9, bad / (bad + good + 0.5 / n_clean))
                lexicon.variants[w] = learned if good else max(learned, lexicon.unseen(lexicon.near(w)))
            elif good:
                lexicon.variants[w] = 0.2
        return Lexicon(lexicon.words, lexicon.beginnings, lexicon.variants, loose)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) for each row of docs(doc_id, text); map only."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def batches(stream):
        for b in stream:
            yield pa.record_batch([b.column("doc_id"), pa.array([shared.value.score(t) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(batches, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
