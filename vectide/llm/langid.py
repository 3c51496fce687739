"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed greedily into
phrases, each the longest match in a language's sample (Ziv and Merhav, 1993); phrases times the logarithm of the sample's
length estimate the cross-entropy, and the language with the least wins. Texts are normalised first: letters in lower
case with their marks, every run of other characters one space.

An automaton's moves lie in two sparse arrays (a state's moves are spread over free slots that carry the state's number),
so any number of characters and languages fits. NumPy moves all blocks of a batch forward by one character at a time. A
block's parse starts at its first character, as if a phrase began there; the parse of the block before runs on until a
phrase of both begins at one place, from where they are the same. So the count is that of one parse of the whole text,
whatever the blocks.

Sample: of the LANGUAGES most frequent labels, the distinct texts of at most LONGEST characters with the least hash, whole
ones until SAMPLE_CHARS characters are reached. This bounds the model at any corpus size; all else covers every row and
whole texts.

Edge cases: text that is null or has no letter is `und` with score 0; null languages and texts teach nothing; if no
language is learned all is `und`; ties go to the language whose name sorts first; repeated rows keep a row each; an
empty table gives an empty result; bytes that aren't UTF-8 count as U+FFFD; other columns are ignored. `keep_known` drops what is null or has no letter, nothing else.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vectide.llm.scratch import let_go, prepare, table, text_of

LANGUAGES, SAMPLE_CHARS, LONGEST, BLOCK = 100, 24_000, 16_000, 256
#: Texts of a language that are looked at to fill its sample.
SAMPLE_DOCS = 400
#: Characters of a batch that are parsed at once.
AT_ONCE = 1 << 21
UNKNOWN = "und"


def _ranges(kinds: str) -> str:
    """The characters below 0x10000 of these categories, as a pattern's class."""
    on = [unicodedata.category(chr(i))[0] in kinds for i in range(0x10000)] + [False]
    edges = [i for i in range(len(on)) if on[i] != (i > 0 and on[i - 1])]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edges[::2], edges[1::2], strict=True))


#: All but letters and marks; above 0x10000 all but the planes of symbols counts as letters here.
_OTHER = re.compile(f"[^{_ranges('LM')}\U00010000-\U0001cfff\U0001e000-\U0001efff\U00020000-{chr(sys.maxunicode)}]+")


def normalise(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def has_letter(plain: str) -> bool:
    return any(map(str.isalpha, plain))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Moves {symbol: state} of each state of the least automaton of all substrings; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


class Table:
    """The moves of an automaton, packed: state s goes to target[base[s] + c] on c if owner[base[s] + c] is s."""

    TRIES, NEAR = 16, 2048

    def __init__(self, moves: list[dict[int, int]], symbols: int):
        self.base = np.zeros(len(moves), np.int32)
        used, owner, target = bytearray(symbols + self.NEAR), [], []
        low = high = symbols  # the first slot that may be free, and the end of those in use
        for s in sorted(range(1, len(moves)), key=lambda s: -len(moves[s])):
            own = sorted(moves[s])
            if not own:
                break
            if high + symbols + 1 > len(used):
                used.extend(bytes(len(used) + symbols))
            first = own[0]
            if len(own) == 1:  # any free slot will do
                low = at = used.find(0, low)
            else:
                at, rest = used.find(0, max(low, high - self.NEAR)), [c - first for c in own[1:]]
                for _ in range(self.TRIES):
                    if not any([used[at + c] for c in rest]):
                        break
                    at = used.find(0, at + 1)
                else:
                    at = high
            for c in own:
                used[at - first + c] = 1
                owner.append((at - first + c, s))
                target.append(moves[s][c])
            high = max(high, at - first + own[-1] + 1)
            self.base[s] = at - first
        size = int(self.base.max(initial=0)) + symbols + 1
        self.owner, self.target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        if owner:
            slots, states_ = np.array(owner).T
            self.owner[slots], self.target[slots] = states_, target
        #: Where a phrase that begins with a character leads; the root again for one that the sample lacks.
        self.start = np.zeros(symbols, np.int32)
        for c, t in moves[0].items():
            self.start[c] = t


class Model:
    """The characters of all samples, and a table for each language."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        seen = np.unique(np.frombuffer("".join(texts.values()).encode("utf-32-le", "replace"), np.uint32))
        #: The last symbol stands for what no sample holds.
        self.symbol = np.full(0x110000, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen), dtype=np.int32)
        self.tables = [Table(suffix_automaton(self.codes(texts[lang]).tolist()), len(seen) + 1) for lang in self.languages]
        self.weights = np.array([np.log(len(texts[lang]) + 1.0) for lang in self.languages])

    def codes(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text needs in each language, texts x languages."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        cut = Blocks(self.codes("".join(texts)), sizes)
        return np.stack([cut.count(t) for t in self.tables], axis=1) if self.tables else np.zeros((len(texts), 0), np.int64)

    def predict(self, plain: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of normalised texts: language, score (how much the second-best language lags behind, 0 to 1) and phrases a character."""
        known = [i for i, t in enumerate(plain) if has_letter(t)]
        langs, score, rate = [UNKNOWN] * len(plain), np.zeros(len(plain)), np.zeros(len(plain))
        if not self.languages:
            return langs, score, rate
        at = 0
        while at < len(known):
            to, size = at, 0
            while to < len(known) and (to == at or size + len(plain[known[to]]) <= AT_ONCE):
                size += len(plain[known[to]])
                to += 1
            count = self.phrases([plain[i] for i in known[at:to]])
            for i, n, c in zip(known[at:to], count, count * self.weights, strict=True):
                best = int(c.argmin())
                langs[i] = self.languages[best]
                rate[i] = n[best] / len(plain[i])
                rest = np.delete(c, best)
                score[i] = 1.0 - c[best] / rest.min() if len(rest) else 1.0
            at = to
        return langs, score, rate


class Blocks:
    """Texts cut into blocks, which are parsed side by side, the longest first."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.repeat(np.cumsum(sizes) - sizes, blocks) + within * BLOCK
        length = np.minimum(sizes[owner] - within * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        begin, self.length, self.owner, self.texts = begin[order], length[order], owner[order], len(sizes)
        #: The symbols by step and block.
        self.codes = np.zeros((BLOCK, len(order)), np.int32)
        self.alive = np.searchsorted(-self.length, -np.arange(1, BLOCK + 1), side="right").tolist()
        for step, n in enumerate(self.alive):
            self.codes[step, :n] = codes[begin[:n] + step]
        same = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        #: Blocks that another follows, and those, both by place; whether that one is its text's last.
        self.before, self.after = self.place[same], self.place[same + 1]
        self.ends = within[same + 1] == blocks[owner[same + 1]] - 1
        self.last = np.cumsum(blocks) - 1

    def count(self, t: Table) -> np.ndarray:
        """Phrases of each text by one table."""
        base, owner, target, start, codes = t.base, t.owner, t.target, t.start, self.codes
        state, count = np.zeros(len(self.owner), np.int32), np.zeros(len(self.owner), np.int64)
        begins = np.zeros((BLOCK, len(self.owner)), bool)  # where a phrase begins
        for step, n in enumerate(self.alive):
            if not n:
                break
            c, s = codes[step, :n], state[:n]
            slot = base[s]
            slot += c
            new = owner[slot] != s
            to = target[slot]
            np.copyto(to, start[c], where=new)
            state[:n] = to
            begins[step, :n] = new
            count[:n] += new
        # the blocks before run on into those after, until a phrase begins at one place for both
        ran, skipped = np.zeros(len(self.before), np.int64), np.zeros(len(self.before), np.int64)
        met, onward = np.zeros(len(self.before), bool), state[self.before]
        active = np.arange(len(self.before))
        for step in range(BLOCK):
            active = active[self.length[self.after[active]] > step]
            if not len(active):
                break
            to = self.after[active]
            c, s = codes[step, to], onward[active]
            slot = base[s] + c
            new, there = owner[slot] != s, begins[step, to]
            onward[active] = np.where(new, start[c], target[slot])
            both = new & there
            met[active] = both
            ran[active] += new & ~both
            skipped[active] += there & ~both
            active = active[~both]
        # a text's last block that wasn't met is the run's alone
        extra = np.where(met, ran - skipped, ran - count[self.after])
        out = np.bincount(self.owner, count, self.texts) + np.bincount(self.owner[self.before], extra, self.texts)
        for text in np.unique(self.owner[self.before[~met & ~self.ends]]).tolist():
            out[text] = self._walk(t, text, count, begins, dict(zip(self.before.tolist(), zip(met.tolist(), ran.tolist(), skipped.tolist(), onward.tolist(), strict=True), strict=True)))
        return out.astype(np.int64)

    def _walk(self, t: Table, text: int, count: np.ndarray, begins: np.ndarray, runs: dict) -> int:
        """The phrases of a text in which a run passes over a whole block: block after block, and there character by character."""
        base, owner, target, start = map(memoryview, (t.base, t.owner, t.target, t.start))
        block, last = (int(self.last[text - 1]) + 1 if text else 0), int(self.last[text])
        total = int(count[self.place[block]])
        while block < last:
            met, ran, skipped, state = runs[int(self.place[block])]
            total += ran
            if met:
                block += 1
                total += int(count[self.place[block]]) - skipped
                continue
            block += 2
            while block <= last:
                at = int(self.place[block])
                there, found = begins[:, at].tolist(), False
                for step, c in enumerate(self.codes[: self.length[at], at].tolist()):
                    slot = base[state] + c
                    if owner[slot] == state:
                        state = target[slot]
                    elif there[step]:
                        total += int(count[at]) - sum(there[:step])
                        found = True
                        break
                    else:
                        total, state = total + 1, start[c]
                if found:
                    break
                block += 1
        return total


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fit(docs: DataFrame) -> Model:
    """The model of docs(doc_id, text, lang): the sample of each language, chosen by hash among the texts to learn from."""
    rows = training_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col("lang").cast("string").alias("lang")))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # copies of a text teach once
    texts = rows.where(F.char_length("text") <= LONGEST).groupBy("lang", "h").agg(F.min(F.char_length("text")).alias("size"))
    counts = texts.groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return Model({})
    # a cut of the hash lets about twice as many through as are looked at, so the ranking sees few rows of any language
    cut = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, float(1 << 63) * min(1.0, 2.0 * SAMPLE_DOCS / n))])
    low = texts.where(F.col("lang").isin(list(counts)) & (F.shiftrightunsigned("h", 1) <= F.element_at(cut, F.col("lang"))))
    order = Window.partitionBy("lang").orderBy("h")
    ranked = low.withColumn("k", F.row_number().over(order)).withColumn("sum", F.sum("size").over(order))
    chosen = ranked.where((F.col("k") <= SAMPLE_DOCS) & (F.col("sum") - F.col("size") < SAMPLE_CHARS)).select("lang", "h").collect()
    wanted = {(r["lang"], r["h"]) for r in chosen}  # at most SAMPLE_DOCS a language, of SAMPLE_CHARS + LONGEST characters in all
    found = rows.where(F.col("h").isin(sorted({h for _, h in wanted})) & F.col("lang").isin(list(counts)) & (F.char_length("text") <= LONGEST)).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        if (r["lang"], r["h"]) in wanted:
            samples.setdefault(r["lang"], []).append(normalise(r["text"]))
    return Model({lang: " ".join(x) for lang, x in samples.items() if has_letter(" ".join(x))})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) with lang_pred, score and phrase_rate in place of all other columns."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream):
        let_go()
        for b in stream:
            langs, score, rate = shared.value.predict([normalise(t) if t else "" for t in b.column("text").to_pylist()])
            yield pa.record_batch([b.column("doc_id"), pa.array(langs), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "phrase_rate"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(batches, "doc_id long, lang_pred string, score double, phrase_rate double")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text is null or has no letter, and with the predicted language in `lang`.

    Where no language can be learned, `lang` stays as it is. The prediction rides along with the row, so nothing is shuffled.
    """
    model = fit(docs)
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, lang = docs.columns.index("text"), docs.columns.index("lang")
    docs = docs.withColumns({"lang": F.col("lang").cast("string"), "text": text_of()})

    def batches(stream):
        let_go()
        for b in stream:
            plain = [normalise(t) if t else "" for t in b.column(at).to_pylist()]
            if shared.value.languages:
                langs, _, _ = shared.value.predict(plain)
                b = b.set_column(lang, b.schema.field(lang), pa.array(langs, pa.string()))
            yield b.filter(pa.array(list(map(has_letter, plain)), pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return predict(docs, fit(docs)).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "phrase_rate")
