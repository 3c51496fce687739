import math
import random
import zlib
from collections import Counter

import pytest

from vectide.llm import langid as L

WORDS = {"en": "the of and ing tion that with from", "de": "der die und ung schaft mit von zwischen", "fr": "le la les que eau tion pour avec"}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(WORDS[lang].split(), k=rng.randint(1, 2))) for _ in range(60)), lang, None, None) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def slow_phrases(text, sample):
    """Greedy parse of the whole text by substring search."""
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


@pytest.mark.parametrize("block", [3, 7, 256])
def test_phrases_by_brute_force(monkeypatch, block):
    """Also texts that a run of phrases passes over whole blocks of, and runs that never meet."""
    monkeypatch.setattr(L, "BLOCK", block)
    rng = random.Random(2)
    samples = {"a": "abracadabra cadabra barbara", "b": "banana bandana nab", "c": "x" * 10 + " " + "".join(rng.choices("ab漢字", k=900))}
    m = L.Model(samples)
    texts = ["".join(rng.choices("abcdnrx 漢🙂", k=rng.choice([1, 5, 300, 900]))) for _ in range(60)]
    texts += ["abracadabra", "x", "xx", "x" * 1000, samples["c"], samples["c"] * 3, "ab" * 500]
    assert m.phrases(texts).tolist() == [[slow_phrases(t, samples[k]) for k in "abc"] for t in texts]


def test_the_whole_query_by_brute_force(documents, odd):
    """Fit and predict against a plain version: samples by hash, greedy parses, least entropy."""
    rows = corpus(60) + [(i and i + 1000, *r) for i, *r in odd] + [(2000, "текст на русском языке " * 9, "ru", None, None), (2001, "漢字かな交じり文の例です" * 9, "ja", None, None)]
    docs = documents(rows)
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    samples = {}
    for lang in sorted({r[2] for r in rows if r[2]}):
        own = sorted({r[1] for r in rows if r[2] == lang and r[1] is not None and len(r[1]) <= L.LONGEST and zlib.crc32(str(r[0]).encode()) % 4 != 2}, key=hashes.get)
        took, size = [], 0
        for t in own:
            if size < L.SAMPLE_CHARS:
                took.append(L.normalise(t))
                size += len(t)
        if took:
            samples[lang] = " ".join(took)
    assert {"ru", "ja"} & set(samples)
    want = []
    for i, t, *_ in rows:
        plain = L.normalise(t or "")
        short = plain if len(plain) < 30_000 else plain[:0]  # the plain version is slow; long texts are held against the blocks above
        if not any(c.isalpha() for c in plain):
            want.append((i, "und", 0.0))
        elif short:
            cost = sorted((slow_phrases(plain, x) * math.log(len(x) + 1), k) for k, x in samples.items())
            want.append((i, cost[0][1], round(1 - cost[0][0] / cost[1][0], 9)))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in L.predict(docs, L.fit(docs)).collect()]
    assert len(got) == len(rows) and not Counter(want) - Counter(got)


def test_scripts_beside_each_other(documents):
    """Languages of other scripts, each with more characters than all others together."""
    rng = random.Random(4)
    zh, ja = ["".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(2)) for _ in range(400)], ["".join(chr(rng.randrange(0x3041, 0x3096)) for _ in range(3)) + chr(rng.randrange(0x6E00, 0x7E00)) for _ in range(400)]
    rows = corpus(60) + [(i, "".join(rng.choices(zh if i % 2 else ja, k=60)), "zh" if i % 2 else "ja", None, None) for i in range(1000, 1120)]
    docs = documents(rows)
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs, L.fit(docs)).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) / len(rows) >= 0.98


def test_marks_belong_to_words():
    assert L.normalise("Ｎ̃o हिन्दी 12 _x!") == "ｎ̃o हिन्दी x" and L.normalise("🙂 a") == "a"


def test_held_out_accuracy(documents):
    rows = corpus()
    docs = documents(rows)
    got = {r["doc_id"]: r for r in L.predict(docs, L.fit(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and sum(got[r[0]]["lang_pred"] == r[2] for r in held) / len(held) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_rows_teach_nothing(documents):
    rows = corpus()
    changed = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in rows]
    a, b = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in L.predict(documents(x), L.fit(documents(x))).collect()) for x in (rows, changed))
    assert a == b


def test_odd_texts(documents, odd):
    docs = documents(corpus() + [(i and i + 1000, *r) for i, *r in odd])
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.predict(docs, L.fit(docs)).collect()]
    assert len(got) == 240 + len(odd)
    assert {g[1:] for g in got if g[0] in (1001, 1002, 1003, 1009, 1010)} == {("und", 0.0)}
    kept = {r["doc_id"] for r in L.keep_known(docs).collect()}
    assert all(r["lang"] == dict((i, x) for i, _, x, *_ in corpus())[r["doc_id"]] for r in L.keep_known(docs).where("doc_id < 240").collect())
    assert {1001, 1002, 1003, 1009, 1010} & kept == set() and set(range(240)) <= kept


def test_empty_and_unlabelled(documents):
    assert L.predict(documents([]), L.fit(documents([]))).collect() == []
    docs = documents([(1, "some text", None, None, None)])
    assert [r["lang_pred"] for r in L.predict(docs, L.fit(docs)).collect()] == ["und"]
    assert L.keep_known(documents([])).columns == docs.columns and L.keep_known(documents([])).collect() == []


def test_a_corpus_without_labels_stays(documents):
    docs = documents([(1, "some text", None, None, None), (2, "more text", None, None, None), (None, "no id", None, None, None), (3, "12", None, None, None), (4, None, None, None, None)])
    assert sorted((str(r["doc_id"]), r["lang"]) for r in L.keep_known(docs).collect()) == [("1", None), ("2", None), ("None", None)]
