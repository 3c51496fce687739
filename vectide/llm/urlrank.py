"""URL verdicts from rules and, where none fits, from the link graph; DataFrame expressions only.

Trust flows along host edges from hosts that the rules allow: a personalised PageRank, each host dealing out its score over
its links. Distrust flows against them from hosts that the rules block: a host gets the mean distrust of what its links lead
to, so neither the number of a blocked host's linkers nor the size of the graph thins it out. Both are scaled so that a
seed without links has 1. A host is blocked, where no rule fits a page, if its distrust reaches MINIMUM and exceeds its
trust.

A host is a seed in so far as the rules judge its pages: with the share of its pages that they allow, or block. What a round
passes on is DAMPING times what the round before did; rounds go on until no host is passed on more than RESIDUAL. Edges are
counted once per pair of hosts, before anything is joined; what a host sends is split over FAN rows per FAN_OUT edges, so
that a host with very many edges is no single key. Every round is written to the shared folder.

Edge cases: a null url, or one without `://`, has an empty host and path, no rule and the verdict of an unlinked host:
allow; null html has no links; links within a host, to no host, or of schemes that name none are no edges; repeated pages
keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectide.llm.scratch import Scratch, table

#: (host, path, verdict), as given.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING, RESIDUAL, MINIMUM, FAN_OUT = 0.85, 1e-4, 0.5, 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\shref\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule) -> Column:
    name, start, _ = rule
    return ((host == name) | host.endswith("." + name)) & path.startswith(start)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (name, verdict), or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        hit = F.struct(F.lit(r[0] + r[1]).alias("name"), F.lit(r[2]).alias("verdict"))
        out = F.when(_fits(host, path, r), hit) if out is None else out.when(_fits(host, path, r), hit)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) of pages(host, html): links between different hosts, counted."""
    links = pages.where("html is not null and host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))).alias("to"))
    full = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), F.col("to"))).when(F.col("to").rlike("(?i)^[a-z][a-z0-9+.-]*://"), F.col("to"))
    return links.select("src", host_of(full).alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, host, score) of r = seed + d M r from seeds(kind, host, score) over edges(src, dst, n), for trust (kind t) and distrust (d)."""
    out = scratch.keep(edges.groupBy("src").agg(F.sum("n").alias("total")), "out")
    weighted = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w"))
    forth = weighted.select(F.lit("t").alias("kind"), "src", "dst", "w")
    ways = scratch.keep(forth.union(weighted.select(F.lit("d"), F.col("dst"), F.col("src"), "w")), "ways")
    fans = scratch.keep(ways.groupBy("kind", "src").agg(F.ceil(F.count("*") / FAN_OUT).cast("int").alias("fans")), "fans")
    share = scratch.keep(ways.join(fans, ["kind", "src"]).select("kind", "src", F.pmod(F.xxhash64("dst"), F.col("fans")).cast("int").alias("fan"), "dst", "w"), "share")
    passed = [scratch.keep(seeds.select("kind", "host", "score"), "passed")]
    while (passed[-1].agg(F.max("score")).first()[0] or 0.0) > RESIDUAL:
        sent = passed[-1].withColumnRenamed("host", "src").join(fans, ["kind", "src"]).select("kind", "src", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), "score")
        got = share.join(sent, ["kind", "src", "fan"]).groupBy("kind", F.col("dst").alias("host")).agg((F.sum(F.col("w") * F.col("score")) * DAMPING).alias("score"))
        passed.append(scratch.keep(got, "passed"))
    return scratch.together(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urlrank")
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    ruled = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    edges = scratch.keep(host_edges(rows.select("host", "html")), "edges")
    share = lambda v: F.avg(F.coalesce((F.col("r.verdict") == v).cast("double"), F.lit(0.0)))
    hosts = scratch.keep(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("t"), share("block").alias("d")), "hosts")
    seeds = hosts.unpivot("host", ["t", "d"], "kind", "score").where("score > 0")
    scores = propagate(edges, seeds, scratch)
    each = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    known = scratch.keep(scores.groupBy("host").agg(each("t").alias("trust"), each("d").alias("distrust")), "scores")
    out = ruled.join(known, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    bad = (F.col("distrust") >= MINIMUM) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


def op8_urlrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """The same in DuckDB: rules, edges, and as many rounds as any graph of a billion hosts may need."""
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in order]
    name = " ".join(f"WHEN {c} THEN '{h}{p}'" for c, (h, p, _) in zip(fits, order, strict=True))
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, (_, _, v) in zip(fits, order, strict=True))
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
    ctes = [
        f"rows AS (SELECT page_id, {host('url')} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages)",
        f"ruled AS (SELECT page_id, host, path, CASE {name} END AS rule, CASE {verdict} END AS v FROM rows)",
        "links AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '" + HREF.replace("'", "''") + "', 1))) AS t FROM rows WHERE html IS NOT NULL AND host <> '')",
        "edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, " + host("CASE WHEN starts_with(t, '//') THEN 'x:' || t WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t END") + " AS dst FROM links) q WHERE dst <> '' AND src <> dst GROUP BY ALL)",
        "hosts AS (SELECT host, avg(coalesce((v = 'allow')::INT, 0)) AS t, avg(coalesce((v = 'block')::INT, 0)) AS d FROM ruled WHERE host <> '' GROUP BY host)",
    ]
    for k, (a, b) in {"t": ("src", "dst"), "d": ("dst", "src")}.items():
        ctes.append(f"{k}w AS (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY src) AS w FROM edges)")
        ctes.append(f"{k}r AS (SELECT 0 AS k, host, {k} AS score FROM hosts WHERE {k} > 0 UNION ALL SELECT k + 1, b, sum(w * score) * {DAMPING} FROM {k}r JOIN {k}w ON host = a WHERE k < 200 GROUP BY k, b HAVING sum(w * score) > 1e-12)")
        ctes.append(f"{k}s AS (SELECT host, sum(score) AS score FROM {k}r GROUP BY host)")
    bad = f"coalesce(d.score, 0) >= {MINIMUM} AND coalesce(d.score, 0) > coalesce(t.score, 0)"
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN {bad} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled r LEFT JOIN ts t ON r.host = t.host LEFT JOIN ds d ON r.host = d.host"
