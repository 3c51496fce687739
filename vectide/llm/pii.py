"""Personal data by patterns, checksum validators and context words; DataFrame expressions only.

A regular expression proposes spans of a kind, a validator confirms them (Luhn for cards, mod-97 for IBANs, ranges of
numbers for the rest), and words nearby raise or lower a span's score. Spans of the base kinds stay whatever their
score; those of the added kinds (iban, ssn) need MINIMUM.

Positions come from cutting the text at the matches: the lengths of the pieces and matches before a match add up to its
start. Sums run on by RUN values at a time, so the work grows with a text's matches and not with their square. The patterns propose what plain leftmost, non-overlapping search proposes, but with possessive repeats and a guard
against starting inside a run that already failed, so long runs of digits or letters cost linear time and no stack.

Edge cases: null text counts as empty, and `redact` leaves it null; repeated rows keep a row each; null doc_ids are kept; an
empty table gives an empty result; other columns are ignored by `find` and kept by `redact`, whatever their names. Nothing
is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectide.llm.scratch import table

MINIMUM, NEAR, RUN = 0.6, 40, 256

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c >= "A", 100).otherwise(10) + value(c), F.lit(97)))
    return (F.char_length(plain) >= 15) & (F.char_length(plain) <= 34) & (rest == 1)


def _ssn(m: Column) -> Column:
    return ~m.rlike("^(?:000|666|9)|-00-|0000$")


#: kind: pattern, validator, score without context, words that raise it, words that lower it
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, "mail|contact|write|kontakt|courriel|correo", "example|noreply"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, "(?:^|[^a-z0-9])ip(?:[^a-z0-9]|$)|address|server|host|adresse", "version|section|release"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13,}+", lambda m: F.char_length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m)), 0.8, "card|visa|credit|karte|carte|tarjeta", "order|serial|isbn"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.char_length(_digits(m)).between(10, 15), 0.7, "phone|call|tel|mobile|fax|anruf", "order|serial"),
    "iban": (r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", _mod97, 0.8, "iban|account|bank|konto|compte|cuenta", "example"),
    "ssn": (r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", _ssn, 0.4, "ssn|social security|taxpayer", "order|serial"),
}
BASE = ("email", "ip", "card", "phone")


def _cut(text: Column, kind: str) -> Column:
    """The pieces around a kind's matches and the matches, or null if there are none."""
    pattern = KINDS[kind][0]
    parts = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(text.rlike(pattern), parts)


def _score(kind: str, before: Column, after: Column) -> Column:
    _, _, score, more, less = KINDS[kind]
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
    return F.least(F.lit(1.0), F.lit(score) + F.when(near.rlike(more), 0.25).otherwise(0.0) - F.when(near.rlike(less), 0.15).otherwise(0.0))


def _holds(kind: str, cut: Column, m: Column, i: Column) -> Column:
    valid = F.coalesce(KINDS[kind][1](m), F.lit(False))
    return valid if kind in BASE else valid & (_score(kind, F.get(cut["p"], i), F.get(cut["p"], i + 1)) >= MINIMUM)


def _spans(kind: str, cut: Column, starts: Column, size) -> Column:
    """Confirmed spans (start, kind number, end, score) of one kind."""
    number = list(KINDS).index(kind)

    def span(m: Column, i: Column) -> Column:
        at = F.get(starts, i)
        whole = F.struct(at.alias("start"), F.lit(number).alias("kind"), (at + size(m)).alias("end"), _score(kind, F.get(cut["p"], i), F.get(cut["p"], i + 1)).alias("score"))
        return F.when(_holds(kind, cut, m, i), whole)

    empty = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    return F.coalesce(F.filter(F.transform(cut["m"], span), lambda s: s.isNotNull()), empty)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once, also where it is used inside a function of an array's elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op, zero: Column) -> Column:
    """For each of one or more values, what `op` makes of zero and all values before it.

    An array grows by being copied, so it grows to RUN values only; the runs are strung together in the end.
    """

    def part(v: Column, r: Column) -> Column:
        return F.slice(v, r * RUN + 1, F.lit(RUN))

    def more(known: Column, x: Column) -> Column:
        return F.concat(known, F.array(op(F.element_at(known, -1), x)))

    def whole(v: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        before = F.aggregate(F.transform(runs, lambda r: F.aggregate(part(v, r), zero, op)), F.array(zero), more)
        return _let(before, lambda b: F.flatten(F.transform(runs, lambda r: F.slice(F.aggregate(part(v, r), F.array(F.get(b, r)), more), F.lit(1), F.size(part(v, r))))))

    return _let(values, whole)


def _starts(cut: Column, size) -> Column:
    """Where the matches start, in characters or bytes as `size` counts."""
    steps = F.transform(cut["m"], lambda m, i: size(F.get(cut["p"], i)) + size(m))
    sums = running(steps, lambda a, x: a + x, F.lit(0))
    return F.when(cut.isNotNull(), F.transform(sums, lambda x, i: x + size(F.get(cut["p"], i))))


def _found(docs: DataFrame, keep: list[str], size, own: str = "") -> DataFrame:
    """The columns `keep` of docs(text) and `spans`, with its name after `own`: ordered by start, then kind; places as `size` counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(*keep, *[_cut(text, k).alias(f"{own}cut_{k}") for k in KINDS])
    out = out.select("*", *[_starts(F.col(f"{own}cut_{k}"), size).alias(f"{own}at_{k}") for k in KINDS])
    every = F.concat(*[_spans(k, F.col(f"{own}cut_{k}"), F.col(f"{own}at_{k}"), size) for k in KINDS])
    return out.select(*keep, F.array_sort(every).alias(f"{own}spans"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs(doc_id, text): spans ordered by start, then kind (a number in KINDS)."""
    return _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], F.char_length)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _masked(text: Column, spans: Column) -> Column:
    """The text with a mask in place of each span (places in bytes). Of spans that overlap, the first one's mask stands for all."""
    masks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def cut(raw: Column, start: Column, end: Column) -> Column:
        return F.substring(raw, start + 1, end - start).cast("string")

    def filled(raw: Column, reached: Column) -> Column:
        pieces = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(reached, i), F.concat(cut(raw, F.get(reached, i), s["start"]), F.get(masks, s["kind"]))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), cut(raw, F.array_max(F.transform(spans, lambda s: s["end"])), F.octet_length(raw)))

    reached = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
    return _let(text.cast("binary"), lambda raw: _let(reached, lambda r: filled(raw, r)))


def redact(docs: DataFrame) -> DataFrame:
    """docs with `<KIND>` in place of each confirmed span that `find` finds in its text; n_chars follows if there is one."""
    own = "own_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    out = _found(docs, docs.columns, F.octet_length, own)
    spans = F.col(f"{own}spans")
    masked = F.when(F.size(spans) > 0, _masked(F.col("text").cast("string"), spans)).otherwise(F.col("text").cast("string"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", masked).select(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and a digest of the base spans, and all spans with their scores."""
    out = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == list(KINDS).index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def oracle() -> str:
    """The same in DuckDB, whose patterns know no look-behind: plain leftmost search, and word boundaries for added kinds."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(0, length({digits})), lambda k: CASE WHEN k % 2 = 0 THEN {digits}[length({digits}) - k]::INT WHEN {digits}[length({digits}) - k]::INT > 4 THEN {digits}[length({digits}) - k]::INT * 2 - 9 ELSE {digits}[length({digits}) - k]::INT * 2 END)) % 10 = 0"
    plain = "replace(m, ' ', '')"
    values = f"list_transform(range(1, length({plain}) + 1), lambda k: ascii((substr({plain}, 5) || substr({plain}, 1, 4))[k]))"
    rest = f"list_reduce(list_prepend(0, list_transform({values}, lambda c: CASE WHEN c >= 65 THEN c - 55 ELSE c - 48 END)), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97)"
    plainly = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", f"regexp_matches(m, '^{_PART}(?:[.]{_PART}){{3}}$')"),
        "card": (r"[0-9](?:[ -]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
        "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", f"length({plain}) BETWEEN 15 AND 34 AND {rest} = 1"),
        "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(m, '^(?:000|666|9)|-00-|0000$')"),
    }
    ctes = ["docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"]
    for n, (kind, (pattern, valid)) in enumerate(plainly.items()):
        _, _, score, more, less = KINDS[kind]
        near = f"lower(right(p[i], {NEAR}) || ' ' || left(p[i + 1], {NEAR}))"
        ctes += [
            f"cut_{kind} AS (SELECT r, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS ms FROM docs WHERE regexp_matches(t, '{pattern}'))",
            f"each_{kind} AS (SELECT r, p, i, ms[i] AS m, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS pos FROM (SELECT r, p, ms, unnest(range(1, len(ms) + 1)) AS i FROM cut_{kind}) u)",
            f"s_{kind} AS (SELECT r, {n} AS kind, pos::BIGINT AS a, (pos + length(m))::BIGINT AS z, least(1.0, {score} + CASE WHEN regexp_matches({near}, '{more}') THEN 0.25 ELSE 0 END - CASE WHEN regexp_matches({near}, '{less}') THEN 0.15 ELSE 0 END)::DOUBLE AS score FROM each_{kind} WHERE {valid})",
        ]
    every = " UNION ALL ".join(f"SELECT r, kind, '{k}' AS name, a, z, score FROM s_{k}" + ("" if k in BASE else f" WHERE score >= {MINIMUM}") for k in KINDS)
    ctes.append(f"spans AS ({every})")
    text = "string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind, z)"
    counts = ", ".join(f"count(*) FILTER (name = '{k}') AS n_{k}" for k in BASE)
    ctes.append(f"told AS (SELECT r, {counts}, {text} FILTER (kind < {len(BASE)}) AS base, {text} AS spans, string_agg(format('{{:.2f}}', score), ',' ORDER BY a, kind, z) AS scores FROM spans GROUP BY r)")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE) + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM docs LEFT JOIN told USING (r)"
