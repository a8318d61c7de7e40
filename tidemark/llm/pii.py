"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score (DataFrame functions only).

Patterns of the base kinds are the plain ones with a guard in front and possessive repeats. Both only skip starts that
cannot give the leftmost match (a later start inside the same run of characters), so matches are the same, in time
linear in the text even for very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read

# Pattern, a cheaper condition that any match implies, base score, context words.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.8, r"mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 0.6, r"\bip\b|host|server|address"),
    "card": (r"(?<![0-9])[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}", 0.5, r"card|visa|credit|pay|account"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"tel|phone|call|fax|mobile"),
}
MORE = {
    "iban": (r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.3, r"iban|bank|account"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, r"ssn|social|security"),
    "tel": (r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}", r"[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}", 0.3, r"tel|phone|call|fax|mobile"),
}
NEAR = 40  # code points before a span in which context words count
CHECKED, CONTEXT, NEEDED = 0.4, 0.3, 0.6  # what a checksum and a context word add; score that an added span needs

RAW = "array<struct<start:int,stop:int,hit:string>>"
SPANS = "array<struct<kind:string,start:int,stop:int,score:double>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(i):
        v = F.substring(digits, i, 1).cast("int")
        twice = v * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)
    return (n > 0) & (F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), value), F.lit(0), lambda a, v: a + v) % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97 once its head is moved to the end and letters are 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))

    def step(acc, i):
        c = F.ascii(F.substring(turned, i, 1))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)
    n = F.length(turned)
    return n.between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) == 1)


def _place(hits: Column, gaps: Column) -> Column:
    """Start and end in code points of each hit, from the lengths of the hits and of the gaps between them."""
    paired = F.transform(hits, lambda h, i: F.struct(h.alias("hit"), F.length(h).alias("n"), F.length(F.get(gaps, i)).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(RAW).alias("out"))

    def step(acc, p):
        s = acc["at"] + p["gap"]
        return F.struct((s + p["n"]).alias("at"), F.concat(acc["out"], F.array(
            F.struct(s.alias("start"), (s + p["n"]).alias("stop"), p["hit"].alias("hit")))).alias("out"))
    return F.aggregate(paired, start, step, lambda acc: acc["out"])


def _holds(kind: str, hit: Column) -> Column:
    digits = _digits(hit)
    n = F.length(digits)
    if kind == "ip":
        def small(i):
            p = F.regexp_replace(F.get(F.split(hit, r"\."), F.lit(i)), "^0+", "")
            return (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 9).try_cast("int"), F.lit(0)) <= 255)
        return small(0) & small(1) & small(2) & small(3)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(hit, " ", ""))
    return F.lit(True)


def _test(kind: str):
    return lambda s: _holds(kind, s["hit"])


def _scored(kind: str, base: float, near: str):
    def score(s):
        before = F.substring(F.col("t"), F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR)))
        value = F.least(F.lit(1.0), F.lit(base) + F.when(F.lower(before).rlike(near), CONTEXT).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), value.alias("score"))
    return score


def _is(kind: str):
    return lambda s: s["kind"] == kind


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, stop, score) in code points, stop exclusive, by kind, then start.

    Base kinds are every leftmost match of their pattern that passes its test (parts of an address, length and Luhn
    check of a card, digits of a phone number), whatever the score. Account numbers (mod-97), social security numbers
    and national phone numbers are added where pattern, checksum and context words within 40 code points before
    together reach 0.6, they stand alone and overlap no base span. Null or empty text has no spans. Rows stay as they
    are, repeated rows included; an existing column ``out`` is replaced, other names are free.
    """
    names = {k: f"{k} proposals" for k in [*BASE, *MORE]}
    own = docs.drop(out).select(F.struct("*").alias("doc"))
    t = F.coalesce(F.col("doc")[text], F.lit(""))
    df = own.withColumn("t", t)
    for kind, (pattern, gate, _, _) in {**BASE, **MORE}.items():
        likely = F.contains(F.col("t"), F.lit("@")) if gate is None else F.col("t").rlike(gate)
        df = df.withColumn(names[kind], F.when(likely, F.regexp_extract_all(F.col("t"), F.lit(pattern), F.lit(0)))
                           .otherwise(F.array().cast("array<string>")))
    empty = F.array().cast(SPANS)
    some = F.greatest(*[F.size(names[k]) for k in names]) > 0
    placed = []
    for kind, (pattern, _, score, near) in {**BASE, **MORE}.items():
        raw = _place(F.col(names[kind]), F.split(F.col("t"), pattern, -1))
        kept = F.filter(F.when(F.size(names[kind]) > 0, raw).otherwise(F.array().cast(RAW)), _test(kind))
        checked = CHECKED if kind in ("card", "iban") else 0.0

        scored = _scored(kind, score + checked, near)
        spans = F.transform(kept, scored)
        if kind in MORE:
            edge = r"[0-9A-Za-z]"
            alone = F.filter(kept, lambda s: ~F.when(s["start"] > 0, F.substring(F.col("t"), s["start"], 1)).otherwise("").rlike(edge)
                             & ~F.substring(F.col("t"), s["stop"] + 1, 1).rlike(edge))
            spans = F.filter(F.transform(alone, scored), lambda s: s["score"] >= NEEDED - 1e-9)
        placed.append(spans)
    df = df.select("doc", *[F.when(some, s).otherwise(empty).alias(f"{k} spans") for k, s in zip(names, placed, strict=True)])
    base, extra = (F.concat(*[F.col(f"{k} spans") for k in kinds]) for kinds in (BASE, MORE))
    alone = F.filter(extra, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    df = df.select("doc", F.concat(base, F.when(F.size(extra) > 0, alone).otherwise(empty)).alias("all spans"))
    return df.select("doc.*", F.col("all spans").alias(out))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by the span's kind in angle brackets, and ``n_chars`` set anew.

    Of overlapping spans the earliest counts, the longer one first. A text without spans stays as it is, null too.
    """
    spans = find(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), "text", "pii")
    order = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("neg"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        done = F.struct((-s["neg"]).alias("at"), F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
        return F.when(s["start"] >= acc["at"], done).otherwise(acc)
    cut = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    clean = F.when(F.size("pii") > 0, cut).otherwise(F.col("text"))
    new = spans.select("row", clean.alias("clean"))
    fields = [F.col("clean").alias(c) if c == "text" else F.length("clean").cast(new.schema["row"].dataType[c].dataType).alias(c) if c == "n_chars"
              else F.col("row")[c].alias(c) for c in docs.columns]
    return new.select(*fields)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents: doc_id, count of each base kind, digest of the base spans, all spans."""
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


_SQL_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]", **{k: v[0] for k, v in MORE.items()}}

SQL = r"""
WITH raw AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
hits AS (""" + " UNION ALL ".join(
    f"SELECT rid, t, {i} AS k, '{k}' AS kind, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g FROM raw"
    for i, (k, p) in enumerate(_SQL_KINDS.items())) + r"""),
one AS (SELECT rid, t, k, kind, h, g, unnest(range(1, len(h) + 1)) AS i FROM hits WHERE len(h) > 0),
pos AS (SELECT rid, t, k, kind, h[i] AS hit, regexp_replace(h[i], '[^0-9]', '', 'g') AS dg,
    (list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in h[1:i - 1]]), 0))::INT AS s FROM one),
spn AS (SELECT *, s + length(hit)::INT AS e, lower(t[greatest(s - 40, 0) + 1:s]) AS bef,
    (replace(hit, ' ', '')[5:] || hit[1:4]) AS turned FROM pos),
ok AS (SELECT * FROM spn WHERE CASE kind
    WHEN 'ip' THEN list_max([length(ltrim(p, '0')) for p in string_split(hit, '.')]) <= 3
        AND list_max([coalesce(try_cast(right(p, 9) AS INT), 999) for p in string_split(hit, '.')]) <= 255
    WHEN 'card' THEN length(dg) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (length(dg) - j) % 2 = 1
        THEN CASE WHEN dg[j]::INT * 2 > 9 THEN dg[j]::INT * 2 - 9 ELSE dg[j]::INT * 2 END ELSE dg[j]::INT END for j in range(1, length(dg) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(dg) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(turned) BETWEEN 15 AND 34 AND array_to_string([CASE WHEN ascii(turned[j]) >= 65 THEN (ascii(turned[j]) - 55)::VARCHAR
        ELSE turned[j] END for j in range(1, length(turned) + 1)], '')::DECIMAL(38, 0) % 97 = 1
    ELSE true END),
base AS (SELECT rid, k, kind, s, e FROM ok WHERE k < 4),
more AS (SELECT o.rid, o.k, o.kind, o.s, o.e FROM ok o WHERE k >= 4 AND NOT regexp_matches(t[s:s], '[0-9A-Za-z]')
    AND NOT regexp_matches(t[e + 1:e + 1], '[0-9A-Za-z]')
    AND (kind = 'iban' OR kind = 'ssn' AND regexp_matches(bef, 'ssn|social|security') OR kind = 'tel' AND regexp_matches(bef, 'tel|phone|call|fax|mobile'))
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.s < o.e AND o.s < b.e)),
alls AS (SELECT * FROM base UNION ALL SELECT * FROM more),
agg AS (SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS a
    FROM alls GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_email, coalesce(n1, 0)::BIGINT AS n_ip, coalesce(n2, 0)::BIGINT AS n_card,
    coalesce(n3, 0)::BIGINT AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM raw LEFT JOIN agg USING (rid)"""
