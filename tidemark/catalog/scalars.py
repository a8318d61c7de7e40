"""Scalar functions, applied to every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark import fixed
from tidemark.catalog.base import query, with_
from tidemark.functions import payloads
from tidemark.functions import text as tx
from tidemark.functions.values import clamp, hours_between, minutes_between, ntz, pct_change

# Money texts in every form the parsers meet, from the totals of the orders.
FORMS = ("'$' || n || '.5K'", "n || 'M'", "'$1,' || lpad((n % 1000)::VARCHAR, 3, '0')", "n || '.25'", "'N/A'", "''", "n || '.5k'", "n || 'KM'", "'$' || n || 'T'", "n || ' B'", "NULL")
MONEY_SQL = f"""
n0 AS (SELECT o_orderkey AS id, o_totalprice::BIGINT % 9000 + 1 AS n FROM orders),
mt AS (SELECT id, CASE id % {len(FORMS)} """ + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(FORMS)) + """ END AS txt FROM n0),
mp AS (SELECT id, txt, replace(replace(txt, '$', ''), ',', '') AS x FROM mt)"""


def money_case(suffixes: str) -> str:
    arms = " ".join(f"WHEN contains(x, '{s}') THEN TRY_CAST(trim(replace(x, '{s}', '')) AS DOUBLE) * {10 ** (3 * (i + 1))}::DOUBLE" for i, s in enumerate(suffixes))
    return f"coalesce(CASE {arms} ELSE TRY_CAST(trim(x) AS DOUBLE) END, 0)"


def money_texts(spark, sf):
    o = b.table(spark, sf, "orders")
    n = (F.bround("o_totalprice", 0).cast("bigint") % 9000 + 1).cast("string").alias("n")
    t = o.select(F.col("o_orderkey").alias("id"), n)
    c = F.lit
    forms = [F.concat(c("$"), "n", c(".5K")), F.concat("n", c("M")), F.concat(c("$1,"), F.lpad((F.col("n").cast("bigint") % 1000).cast("string"), 3, "0")),
             F.concat("n", c(".25")), c("N/A"), c(""), F.concat("n", c(".5k")), F.concat("n", c("KM")), F.concat(c("$"), "n", c("T")), F.concat("n", c(" B")),
             F.lit(None).cast("string")]
    return t.select("id", F.get(F.array(*forms), (F.col("id") % len(forms)).cast("int")).alias("txt"))


@query("parse_money", with_(MONEY_SQL) + f"SELECT id, {money_case('KMBT')} AS amount FROM mp")
def parse_money(spark, sf):
    return money_texts(spark, sf).select("id", tx.money(F.col("txt")).alias("amount"))


@query("parse_volume", with_(MONEY_SQL) + f"SELECT id, {money_case('KMB')} AS amount FROM mp")
def parse_volume(spark, sf):
    return money_texts(spark, sf).select("id", tx.volume(F.col("txt")).alias("amount"))


@query("contract_from_url", r"""SELECT page_id, nullif(regexp_extract(replace(url, '.com/', '.com/token/'), '/token/([A-Za-z0-9]+)', 1), '') AS contract FROM pages""")
def contract_from_url(spark, sf):
    return b.table(spark, sf, "pages").select(
        "page_id", tx.contract_in(F.replace("url", F.lit(".com/"), F.lit(".com/token/"))).alias("contract"))


@query("fmt_money", with_(b.SNAP_SQL) + """SELECT token, '$' || format('{:,}', round_even(market_cap, 0)::BIGINT) AS usd,
  '$' || round_even(market_cap / 1000, 0)::BIGINT || 'K' AS usd_k, printf('%+.1f%%', change_24h) AS pct FROM snap""")
def fmt_money(spark, sf):
    return b.snapshots(spark, sf).select("token", tx.usd(F.col("market_cap")).alias("usd"), tx.usd_k(F.col("market_cap")).alias("usd_k"),
                                         tx.signed_pct(F.col("change_24h")).alias("pct"))


@query("reason_join", with_(b.SNAP_SQL) + """SELECT token, coalesce(nullif(concat_ws('; ', CASE WHEN market_cap > 300000 THEN 'large' END,
  CASE WHEN change_24h > 0 THEN 'rising' END), ''), 'none') AS reasons FROM snap""")
def reason_join(spark, sf):
    joined = F.concat_ws("; ", F.when(F.col("market_cap") > 300_000, "large"), F.when(F.col("change_24h") > 0, "rising"))
    return b.snapshots(spark, sf).select("token", F.coalesce(F.nullif(joined, F.lit("")), F.lit("none")).alias("reasons"))


@query("date_maths", """SELECT event_id, ts::DATE AS day, date_trunc('hour', ts) AS hour, starts_with(strftime(ts, '%Y-%m-%d'), '2024-01-1') AS in_tens,
  (epoch(TIMESTAMP '2024-01-31')::BIGINT - epoch_us(ts) // 1000000) / 60 AS minutes, (epoch(TIMESTAMP '2024-01-31')::BIGINT - epoch_us(ts) // 1000000) / 3600 AS hours FROM events""")
def date_maths(spark, sf):
    at = ntz(b.EVENTS_AS_OF)
    return b.table(spark, sf, "events").select(
        "event_id", F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"),
        F.date_format("ts", "yyyy-MM-dd").startswith("2024-01-1").alias("in_tens"),
        minutes_between(at, F.col("ts")).alias("minutes"), hours_between(at, F.col("ts")).alias("hours"))


@query("math_functions", """SELECT o_orderkey AS id, abs(o_totalprice - 250000) AS distance, least(greatest(o_totalprice / 100000, 0.5::DOUBLE), 3.0::DOUBLE) AS clamped,
  (o_totalprice / 250000.0::DOUBLE - 1.0::DOUBLE) * 100.0::DOUBLE AS change_pct FROM orders""")
def math_functions(spark, sf):
    p = F.col("o_totalprice")
    return b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.abs(p - 250_000).alias("distance"),
                                               clamp(p / 100_000, 0.5, 3.0).alias("clamped"), pct_change(p, F.lit(250_000.0)).alias("change_pct"))


@query("array_functions", """SELECT vec_id, round(list_max(embedding[1:5]::DOUBLE[]), 6) AS top5, round(list_min(embedding[-5:]::DOUBLE[]), 6) AS low5,
  len(list_filter(embedding, lambda x: x > 0.2)) > 0 AS any_large FROM embeddings""")
def array_functions(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return b.table(spark, sf, "embeddings").select(
        "vec_id", F.round(F.array_max(F.slice(e, 1, 5)), 6).alias("top5"), F.round(F.array_min(F.slice(e, -5, 5)), 6).alias("low5"),
        F.exists(e, lambda x: x > 0.2).alias("any_large"))


@query("json_functions", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def json_functions(spark, sf):
    return b.table(spark, sf, "events").select(
        "event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("k"),
        F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


LOOKUP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.TIMEFRAME_SECONDS.items())
CAPS = " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in fixed.CAPABILITIES.items())


@query("variant_payloads", """
SELECT event_id, event_id % 6 NOT IN (2, 5) AS parsed, CASE event_id % 6 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 3 THEN NULL WHEN 4 THEN user_id END AS wallet,
  CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN 'none' WHEN 3 THEN 'none' WHEN 4 THEN 'none' END AS first_tag,
  CASE event_id % 6 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN event_id + 0.5::DOUBLE WHEN 3 THEN 0 WHEN 4 THEN 0 END AS size,
  CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN false WHEN 4 THEN false END AS urgent FROM events""")
def variant_payloads(spark, sf):
    """Job payloads of several shapes: nested, with numbers as text, cut off, empty, of wrong types and missing."""
    e, n, user = b.table(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    shapes = [F.format_string('{"who": {"wallet": %d, "tags": ["%s", "x"]}, "size": %d, "urgent": true}', user, F.col("event_type"), n),
              F.format_string('{"who": {"wallet": "%d", "tags": []}, "size": "%d.5", "urgent": "false"}', user, n),
              F.format_string('{"who": {"wallet": %d, "tags": ["%s"', user, F.col("event_type")),
              F.lit('{"other": [1, {"a": null}], "who": null}'),
              F.format_string('{"who": {"wallet": %d, "tags": null}, "size": {"much": 1}, "urgent": [1]}', user),
              F.lit(None).cast("string")]
    kind = F.when(n % 6 == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], 1):
        kind = kind.when(n % 6 == i, shape)
    wanted = {"wallet": ("$.who.wallet", "bigint", None), "first_tag": ("$.who.tags[0]", "string", "none"), "size": ("$.size", "double", 0.0), "urgent": ("$.urgent", "boolean", False)}
    got = payloads.fields(e.select("event_id", kind.alias("payload")), "payload", wanted)
    return got.select("event_id", F.col("payload_variant").isNotNull().alias("parsed"), *wanted)


@query("map_lookups", f"""SELECT event_id, coalesce(CASE tf {LOOKUP} END, 3600) AS seconds, coalesce(CASE kind {CAPS} END, '') AS capabilities FROM (SELECT event_id,
  (['1m', '4H', '1D', '1W', '9H'])[(user_id % 5 + 1)::INT] AS tf, (['scanner', 'trader', 'reporter', 'coordinator', 'other'])[(user_id % 5 + 1)::INT] AS kind FROM events)""")
def map_lookups(spark, sf):
    def pick(*xs):
        return F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("user_id") % 5 + 1).cast("int"))

    seconds = F.create_map(*[F.lit(x) for kv in fixed.TIMEFRAME_SECONDS.items() for x in kv])
    caps = F.create_map(*[F.lit(x) for k, v in fixed.CAPABILITIES.items() for x in (k, ",".join(v))])
    return b.table(spark, sf, "events").select(
        "event_id", F.coalesce(F.try_element_at(seconds, pick("1m", "4H", "1D", "1W", "9H")), F.lit(3600)).alias("seconds"),
        F.coalesce(F.try_element_at(caps, pick("scanner", "trader", "reporter", "coordinator", "other")), F.lit("")).alias("capabilities"))
