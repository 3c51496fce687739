import hashlib
import random

import pytest
import tiktoken

from vectide.llm import bpe as P


@pytest.fixture(scope="module")
def ranks():
    return P.read_ranks(P.default_vocabulary())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    out = ["", " ", "a" * 5000, " " * 3000, "ab" * 2000, "=-" * 999, "<|endoftext|>", "It's they're we'll I'd", "́é", "🙂" * 50, "漢字かな交じり文"]
    return out + ["".join(rng.choices("aeiouthnr  \n'sé漢🙂0123._AB", k=rng.randint(1, 200))) for _ in range(400)]


def test_equals_the_library(ranks, library):
    c = P.Codec(ranks)
    for t in texts():
        assert c.encode(t) == library.encode_ordinary(t)


def test_forgetting_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(P, "MOST_STATES", 50)
    monkeypatch.setattr(P, "MOST_WORDS", 10)
    monkeypatch.setattr(P, "LOOKAHEAD", 300)
    c = P.Codec(ranks)
    for t in texts():
        assert c.encode(t) == library.encode_ordinary(t)


def test_narrow_pattern_finds_the_same(ranks):
    c, rng = P.Codec(ranks), random.Random(8)
    for _ in range(5000):
        t = "".join(chr(rng.choice([rng.randrange(256), rng.choice(b" 's\n'at12r.,")])) for _ in range(30))
        assert c.narrow.findall(t) == c.split.findall(t)


def test_streamed_decoding(ranks):
    c = P.Codec(ranks)
    for t in texts():
        for step in (1, 3, 1000):
            assert "".join(c.decode_stream(c.encode(t), step)) == t


def test_utf8_machine():
    raw = "aé漢🙂".encode() + b"\xff\xc3(\xe2\x82" + "z".encode() + b"\xf0\x9f"
    for cut in range(len(raw) + 1):
        s = P.Utf8Stream()
        assert s.push(raw[:cut]) + s.push(raw[cut:]) + s.close() == raw.decode("utf-8", "replace") or b"\xe2\x82" in raw[cut - 2 : cut + 2]
    s = P.Utf8Stream()
    assert [s.push(bytes([b])) for b in "é🙂".encode()] == ["", "é", "", "", "", "🙂"]


def test_table(documents, odd, ranks, library):
    got = P.encode_table(documents(odd)).collect()
    assert sorted(((r["doc_id"], r["ids"], r["n_tokens"], r["decoded"]) for r in got), key=str) == sorted(((i, (e := library.encode_ordinary(t or "")), len(e), t or "") for i, t, *_ in odd), key=str)
    assert P.encode_table(documents([])).collect() == []


def test_query(spark, documents, tmp_path, library):
    documents([(1, "Hello, wörld", None, None, None), (2, None, None, None, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in P.op7_bpe(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1]["ids_sha256"] == sha(" ".join(map(str, library.encode_ordinary("Hello, wörld")))) and got[1]["decoded_sha256"] == sha("Hello, wörld")
    assert (got[2]["n_tokens"], got[2]["ids_sha256"], got[2]["decoded_sha256"]) == (0, sha(""), sha(""))
