import random
import zlib
from collections import Counter

from vectide.llm import toxicity as T


def edits(a, b):
    """Optimal string alignment distance."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_and_trie_by_brute_force():
    terms = ["idiot", "pathetic", "scum", "trash"]
    lexicon = T.Lexicon(dict.fromkeys(terms, 0.99), {})
    rng = random.Random(2)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            k, kind = rng.randrange(len(w)), rng.randrange(4)
            if kind == 0:
                del w[k]
            elif kind == 1:
                w.insert(k, rng.choice("idxtp"))
            elif kind == 2:
                w[k] = rng.choice("xyz0t")
            elif k:
                w[k - 1], w[k] = w[k], w[k - 1]
            w = w or ["a"]
        word = "".join(w)
        assert (lexicon.near(word) is not None) == any(edits(word, t) <= 1 for t in terms), word


def test_windows_tell_quotation_from_abuse():
    lexicon = T.Lexicon({"idiot": 0.99, "pathetic": 0.99}, {"lowei": 0.98})
    assert lexicon.score("you idiot") > 0.9 and lexicon.score("you are pathetc") >= T.THRESHOLD and lexicon.score("so loweix") > 0.9
    for quoted in ('he said "idiot" to me', "the word idiot is an insult", "„idiot“ steht da hier", 'a "idiot" b "idiot" c "pathetic" d'):
        assert lexicon.score(quoted) < T.THRESHOLD, quoted
    assert lexicon.score(None) == lexicon.score("") == lexicon.score("fine words") == T.BASE


def corpus(n=900):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("aeiounrst", k=rng.randint(3, 8))) for _ in range(2000)]
    docs, labels = [], []
    for i in range(n):
        words, bad = rng.choices(vocabulary, k=40), i % 6 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(40), rng.choice(["zidiotz", "zmoronz", "blork" + rng.choice(vocabulary)[:3]]))
        docs.append((i, " ".join(words), None, None, None))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(documents, frame, odd):
    docs, labels = corpus()
    table, known = documents(docs + [(i and i + 5000, *r) for i, *r in odd]), frame(labels + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    lexicon = T.fit(table, known)
    assert {"zidiotz", "zmoronz"} <= set(lexicon.words) and any(b.startswith("blor") for b in lexicon.beginnings)
    got = {r["doc_id"]: r["score"] for r in T.score(table, lexicon).collect()}
    held = [(i, bad) for i, _, bad in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= T.THRESHOLD) == bool(bad) for i, bad in held) / len(held) >= 0.98
    assert got[5001] == got[5002] == T.BASE and all(0 <= s <= 1 for s in got.values())
    flipped = frame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = T.fit(table, flipped)
    assert (again.words, again.beginnings) == (lexicon.words, lexicon.beginnings)


def test_the_whole_query_by_brute_force(documents, frame, odd):
    """Counts, choice of terms and scores, by plain loops over the rows."""
    docs, labels = corpus()
    rng = random.Random(3)
    docs = [(i, t + rng.choice(["", " zidiottz", ' he said "zmoronnz"', " blorkx"]), *r) for i, t, *r in docs]
    table, known = documents(docs + [(i and i + 5000, *r) for i, *r in odd]), frame(labels, "doc_id long, quality int, toxic int")
    lexicon = T.fit(table, known)
    toxic = {i: bad for i, _, bad in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    texts = {(t, toxic[i]) for i, t, *_ in docs if i in toxic}
    n = [sum(bad == k for _, bad in texts) for k in (0, 1)]
    seen, around = [Counter(), Counter()], {}
    for t, bad in texts:
        words = T.tokens(t)
        seen[bad].update({f for w in words for f in ["=" + w, *(w[:k] for k in range(4, 9) if k <= len(w))]})
        for k, w in enumerate(words if bad else []):
            for f in ["=" + w, *(w[:m] for m in range(4, 9) if m <= len(w))]:
                around.setdefault(f, set()).add((*words[max(0, k - 1) : k], "|", *words[k + 1 : k + 2]))
    frequent = {f: x for f, x in seen[1].items() if x >= max(T.LEAST, round(T.SHARE * n[1]))}
    apart = {f: x for f, x in frequent.items() if T.sets_apart(x, seen[0][f], n[1], n[0], len(frequent))}
    varied = {f: x for f, x in apart.items() if len(around[f]) >= max(T.SURROUNDINGS, x // 2)}
    odds = (sum(toxic.values()) + 1) / (sum(1 - x for x in toxic.values()) + 1)
    want = T.choose(varied, seen[0], n[1], n[0], len(frequent), odds)
    assert want == {"=" + w: p for w, p in lexicon.words.items()} | lexicon.beginnings and {"=zidiotz", "=zmoronz"} <= set(want)

    def weight(w):
        if w in lexicon.words:
            return lexicon.words[w]
        starts = [p for b, p in lexicon.beginnings.items() if w.startswith(b)]
        if starts or w in lexicon.variants:
            return max(starts, default=None) or lexicon.variants[w]
        near = [lexicon.unseen(t) for t in lexicon.words if len(t) >= 4 and edits(w, t) <= 1]
        return max(near, default=0.0)

    got = {r["doc_id"]: r["score"] for r in T.score(table, lexicon).collect()}
    looked = 0
    for i, t, *_ in docs:
        words = T.tokens(t)
        if any(lexicon.near(w) in lexicon.beginnings for w in words):  # misspelt beginnings have a test of their own
            continue
        free, quoted = 1.0, 0.0
        for k, w in enumerate(words):
            if any(x in T.REPORTING for x in words[max(0, k - T.WINDOW) : k + T.WINDOW + 1]):
                quoted = max(quoted, weight(w))
            else:
                free *= 1 - weight(w)
        assert abs(got[i] - max(T.BASE, 1 - free, quoted * T.QUOTED)) < 1e-12, t
        looked += 1
    assert looked > 400


def test_a_single_misspelling_reaches_the_threshold(documents, frame):
    lexicon = T.Lexicon({"idiot": 0.99, "scum": 0.8}, {"pathet": 0.99})
    for text in ("you idoit", "such scuum", "how ptahetic", "how pathhetically", "pathteic"):
        assert lexicon.score(text) >= T.THRESHOLD, text
    assert lexicon.score("patheu") == lexicon.score("sympathetic") == T.BASE
    docs, labels = corpus()
    bad = [i for i, (*_, toxic) in enumerate(labels) if toxic and zlib.crc32(str(i).encode()) % 4 != 2]
    clean = [i for i, (*_, toxic) in enumerate(labels) if not toxic and zlib.crc32(str(i).encode()) % 4 != 2]
    docs[bad[0]] = (bad[0], docs[bad[0]][1] + " zidoitz zzmoronz", None, None, None)
    for i in clean[:2]:
        docs[i] = (i, docs[i][1] + " zzmoronz", None, None, None)
    learned = T.fit(documents(docs), frame(labels, "doc_id long, quality int, toxic int"))
    assert learned.score("a zidoitz") >= T.THRESHOLD > learned.score("a zzmoronz")


def test_empty(documents, frame):
    none = frame([], "doc_id long, quality int, toxic int")
    lexicon = T.fit(documents([(1, "a", None, None, None)]), none)
    assert [r["score"] for r in T.score(documents([(1, "a", None, None, None)]), lexicon).collect()] == [T.BASE]
    assert T.score(documents([]), lexicon).collect() == []
