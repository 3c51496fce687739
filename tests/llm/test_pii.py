import re

from pyspark.sql import functions as F

from vectide.llm import pii as P


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def slow(text):
    out = [(m.start(), n, m.end()) for n, (_, p, ok) in enumerate(KINDS) for m in re.finditer(p, text or "") if ok(m.group())]
    return ",".join(f"{KINDS[n][0]}:{a}:{b}" for a, n, b in sorted(out))


TEXTS = [
    "a@b.c_x@d.ee", "1.2.3.4.5.6.7.8", "x 256.1.1.1 0255.1.1.1", "é🙂 me@x.co é 4111 1111 1111 1111 tel +1 (555) 010-9999.", "+1+2 345 678 9012 345", "4111-1111-1111-1111-", "4111  1111 1111 1111",
    "a" * 5000 + "@b.cc", "1 " * 3000, "1" * 20000, ".1" * 4000, "x@" + "a." * 4000 + "b", "a.b@c.d@e.f g@h.ii@jj.kk", "00004111111111111111", "+4111111111111111 is both", "\U00010000 1.1.1.1", "@@a@b", "a@b",
]


def test_base_spans_by_brute_force(documents, odd):
    rows = [(100 + i, t, None, None, None) for i, t in enumerate(TEXTS)] + odd
    base = F.filter("spans", lambda s: s["kind"] < 4)
    got = P.find(documents(rows)).select("doc_id", P.joined(base).alias("b")).collect()
    assert sorted(((r["doc_id"], r["b"]) for r in got), key=str) == sorted(((i, slow(t)) for i, t, *_ in rows), key=str)


def test_added_kinds_and_context(documents):
    rows = ["iban DE89 3704 0044 0532 0130 00 yes", "GB82WEST12345698765432", "iban DE88 3704 0044 0532 0130 00 no", "my ssn 123-45-6789", "order 123-45-6789", "ssn 000-45-6789"]
    got = {r["doc_id"]: r["a"] for r in P.find(documents([(i, t, None, None, None) for i, t in enumerate(rows)])).select("doc_id", P.joined(F.col("spans")).alias("a")).collect()}
    assert [got[i] for i in range(6)] == ["iban:5:32", "iban:0:22", "", "ssn:7:18", "", ""]


def test_redaction(documents, odd):
    docs = documents([(100, TEXTS[3], "en", "s", 5), (101, "plain", "en", "s", 5)] + odd)
    out = P.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r["doc_id"]: r for r in out.where("doc_id >= 100").collect()}
    assert got[100]["text"] == "é🙂 <EMAIL> é <CARD> tel <PHONE>." and got[100]["n_chars"] == len(got[100]["text"]) and got[101]["text"] == "plain"
    assert all(slow(r["text"]) == "" for r in out.where("doc_id >= 100").collect())


def slow_redaction(text, spans):
    """Every character of a span goes; where a run of overlapping spans starts, its first one's mask stands."""
    out, reached = "", 0
    for kind, a, b in spans:
        if a >= reached:
            out += text[reached:a] + f"<{kind.upper()}>"
        reached = max(reached, b)
    return out + text[reached:]


def test_redaction_by_brute_force(documents, odd):
    """Spans come from the text as it was: what one kind covers in part doesn't hide the rest of another."""
    texts = ["+33.1.23.45.67.89 is a phone that holds an ip", "1.2.3.4.5.6.7.8@x.co 4.3.2.1", "é+4111111111111111🙂", "x@1.2.3.4 +1 222 333 4444.1.1.1 z", *(t for t in TEXTS if len(t) < 500)]
    docs = documents([(100 + i, t, None, None, None) for i, t in enumerate(texts)] + odd)
    spans = {r["doc_id"]: r["a"] for r in P.find(docs).where("doc_id >= 100").select("doc_id", P.joined(F.col("spans")).alias("a")).collect()}
    got = {r["doc_id"]: r["text"] for r in P.redact(docs).where("doc_id >= 100").collect()}
    for i, t in enumerate(texts):
        own = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans[100 + i].split(",") if x)]
        assert got[100 + i] == slow_redaction(t, own)
    assert got[100] == "<PHONE> is a phone that holds an ip"
    assert P.redact(docs).where("doc_id = 1").first()["text"] is None


def test_many_matches_in_a_text(documents):
    """Over several runs of sums; the work doesn't grow with the square of the matches."""
    n = 30_000
    docs = documents([(1, "é me@x.co, 1.2.3.4 " * n, None, None, None)])
    spans = P.find(docs).first()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [x for i in range(n) for x in ((i * 19 + 2, i * 19 + 9), (i * 19 + 11, i * 19 + 18))]
    assert P.redact(docs).first()["text"] == "é <EMAIL>, <IP> " * n


def test_columns_of_its_own_names(documents):
    docs = documents([(1, "me@x.co", None, None, None)]).withColumn("cut_email", F.lit("mine")).withColumn("OWN_spans", F.lit("too"))
    assert [(r["text"], r["cut_email"], r["OWN_spans"]) for r in P.redact(docs).collect()] == [("<EMAIL>", "mine", "too")]


def test_empty(documents):
    assert P.find(documents([])).collect() == [] and P.redact(documents([])).collect() == []


def test_query_runs_no_python(spark, documents, tmp_path):
    documents([(1, TEXTS[3], None, None, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    df = P.op6_pii(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString() and df.first()["spans"] == slow(TEXTS[3])


def test_query_equals_its_sql(spark, documents, odd, tmp_path):
    import duckdb

    more = ["éGB82WEST12345698765432é", "_GB82WEST12345698765432 GB82WEST12345698765432_", "my ip 1.2.3.4 version 1.2.3.4", "DE89 3704 0044 0532 0130 00 my iban", "ssn 123-45-6789 x 123-45-6789 ssn 000-12-1234"]
    rows = [(100 + i, t, None, None, None) for i, t in enumerate(more + [t for t in TEXTS if len(t) < 500])] + [r for r in odd if len(r[1] or "") < 500]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = P.op6_pii(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, c.sql(f"select {', '.join(df.columns)} from ({P.oracle()}) t").fetchall()))
