import pytest

from vectide.llm import urlrank as U

LINK = '<a href="{}">x</a>'


def slow(pages):
    """Rules, and rounds of trust and distrust, in plain Python."""

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        return host, tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]

    def rule(host, path):
        fit = [r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fit, key=lambda r: len(r[0] + r[1]), default=None)

    rows = [(i, *split(u), links) for i, u, links in pages]
    edges = {}
    for _, h, _, links in rows:
        for u in set(links):
            to = split("x:" + u if u.startswith("//") else u)[0] if u.startswith("//") or "://" in u else ""
            if h and to and to != h:
                edges[h, to] = edges.get((h, to), 0) + 1
    hosts = {h for _, h, _, _ in rows if h}

    out = {a: sum(n for (x, _), n in edges.items() if x == a) for a, _ in edges}

    def spread(kind):
        seed = {h: sum((r := rule(h, p)) is not None and r[2] == kind for _, g, p, _ in rows if g == h) / sum(g == h for _, g, _, _ in rows) for h in hosts}
        now = dict(seed)
        for _ in range(300):
            after = dict(seed)
            for (a, b), n in edges.items():
                x, y = (a, b) if kind == "allow" else (b, a)
                after[y] = after.get(y, 0) + U.DAMPING * now.get(x, 0) * n / out[a]
            now = after
        return now

    trust, distrust, told = spread("allow"), spread("block"), []
    for i, h, p, _ in rows:
        r, bad = rule(h, p), distrust.get(h, 0) >= U.MINIMUM and distrust.get(h, 0) > trust.get(h, 0)
        told.append((i, h, p, r and r[0] + r[1], r[2] if r else "block" if bad else "allow", round(trust.get(h, 0), 2), round(distrust.get(h, 0), 2)))
    return sorted(told, key=str)


PAGES = [
    (1, "http://WWW.Example.com/en/x?q#f", []), (2, "https://example.com/en/", []), (3, "https://a.example.com/en/a/b", []), (4, "x://spam.net/es/1", []), (5, "x://spam.net/fr/1", ["http://other.org/"]),
    (6, "http://links.org/a", ["http://spam.net/es/", "HTTP://SPAM.net/q", "/relative", "mailto:x@y"]), (7, "http://fine.org/", ["//good.com/", "http://good.com/2"]), (8, "http://good.com/", ["http://fine.org/1", "http://both.org"]),
    (9, "http://both.org/", ["http://spam.net", "http://good.com"]), (10, None, []), (11, "no scheme", []), (12, "", []), (13, "a://?x", []), (14, "a://b://c/d", []), (15, "http://ÉCOM.com/é?", []), (16, "http://evilcom/", []), (17, "http://com", []), (17, "http://com", []), (18, "http://net:80/es/", []),
    (None, "http://com/", []),
]


@pytest.fixture
def pages(frame):
    return lambda rows: frame([(i, u, "<p>" + "".join(LINK.format(x) for x in links) + "<a HREF='#'>" if links or i != 10 else None) for i, u, links in rows], "page_id long, url string, html string")


@pytest.mark.parametrize("fan_out", [50_000, 1])
def test_by_brute_force(pages, monkeypatch, fan_out):
    monkeypatch.setattr(U, "FAN_OUT", fan_out)
    got = U.judge(pages(PAGES)).collect()
    mine, want = sorted((tuple(r) for r in got), key=str), slow(PAGES)
    assert [r[:5] for r in mine] == [r[:5] for r in want] and all(abs(x - y) < 0.01 for a, b in zip(mine, want, strict=True) for x, y in zip(a[5:], b[5:], strict=True))
    assert {r["page_id"]: r["verdict"] for r in got}[6] == "block"


def test_many_linkers_of_a_blocked_host(pages):
    """Distrust doesn't thin out with the number of hosts that link to a blocked one, nor along a ring of links."""
    rows = [(0, "x://spam.net/es/", [])] + [(i, f"x://h{i}.org/", ["x://spam.net/"]) for i in range(1, 400)]
    rows += [(1000 + i, f"x://far{i}.org/", [f"x://far{i + 1}.org/"] if i < 4 else ["x://h1.org/"]) for i in range(5)] + [(2000, "x://half.org/", ["x://spam.net/", "x://fine.org/"])]
    got = {r["page_id"]: (r["verdict"], r["distrust"]) for r in U.judge(pages(rows)).collect()}
    assert all(got[i][0] == "block" for i in range(400)) and got[2000][0] == "allow"
    assert all(abs(got[1000 + i][1] - U.DAMPING ** (6 - i)) < 1e-3 for i in range(5))


def test_seeds_by_their_share(pages):
    """A host counts as far as the rules judge its pages: there is no step at one half."""
    def distrust(blocked):
        rows = [(i, f"x://part.net/{'es' if i < blocked else 'en'}/{i}", []) for i in range(10)] + [(99, "x://links.org/", ["x://part.net/"])]
        return {r["page_id"]: r["distrust"] for r in U.judge(pages(rows)).collect()}[99]

    assert [round(distrust(k) / U.DAMPING, 9) for k in (4, 5, 6)] == [0.4, 0.5, 0.6]


def test_query_equals_its_sql(spark, pages, tmp_path):
    import duckdb

    pages(PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    df = U.op8_urlrank(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString()
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, c.sql(U.oracle()).fetchall()))


def test_empty(pages):
    assert U.judge(pages([])).collect() == []
