"""Agent reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import bindings as b
from tidemark.catalog.base import query, with_
from tidemark.functions.values import ntz
from tidemark.operators import agents as ag
from tidemark.session import shared_dir

HEARTBEAT_AS_OF = "2024-01-30 23:58:00"
JOBS_AS_OF = "2001-08-01 12:00:00"

STATUS_SQL = """
up AS (SELECT user_id AS agent, ts, event_id, CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'working' WHEN 'purchase' THEN 'blocked'
        WHEN 'error' THEN 'error' ELSE 'offline' END AS status FROM events),
latest AS (SELECT agent, arg_max(status, (ts, event_id)) AS status, max(ts) AS last_heartbeat, max(ts) FILTER (status = 'working') AS last_activity
      FROM up GROUP BY agent),
health AS (SELECT *, (epoch(TIMESTAMP '2024-01-30 23:58:00')::BIGINT - epoch_us(last_heartbeat) // 1000000) / 60 AS minutes,
        CASE WHEN (epoch(TIMESTAMP '2024-01-30 23:58:00')::BIGINT - epoch_us(last_heartbeat) // 1000000) / 60 > 5 THEN 'stale'
             WHEN (epoch(TIMESTAMP '2024-01-30 23:58:00')::BIGINT - epoch_us(last_heartbeat) // 1000000) / 60 > 2 THEN 'warning' ELSE 'healthy' END AS health FROM latest)"""


def updates(spark, sf):
    status = F.create_map(*[F.lit(x) for x in ("view", "idle", "click", "working", "purchase", "blocked", "error", "error", "signup", "offline")])
    return b.table(spark, sf, "events").select(F.col("user_id").alias("agent"), "ts", "event_id", status[F.col("event_type")].alias("status"))


def states(spark, sf):
    return ag.latest_state(updates(spark, sf), "agent", "ts", "event_id")


def health(spark, sf):
    return ag.agent_health(states(spark, sf), ntz(HEARTBEAT_AS_OF))


@query("state_upsert", with_(STATUS_SQL) + "SELECT agent, status, last_heartbeat, last_activity FROM latest")
def state_upsert(spark, sf):
    return states(spark, sf).select("agent", "status", "last_heartbeat", "last_activity")


@query("agent_health", with_(STATUS_SQL) + "SELECT agent, status, minutes AS minutes_since_heartbeat, health FROM health ORDER BY last_heartbeat DESC")
def agent_health(spark, sf):
    return health(spark, sf).orderBy(F.col("last_heartbeat").desc()).select("agent", "status", "minutes_since_heartbeat", "health")


JOBS_SQL = """
jobs AS (SELECT o_orderkey AS id, o_custkey AS agent, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE
        (['failed', 'in_progress', 'assigned', 'lost'])[(o_orderkey % 4 + 1)::INT] END AS status,
        left(o_orderpriority, 1)::INT * 3 - 2 AS priority, o_orderdate AS created_at, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 30)::INT AS completed_at,
        (o_orderkey % 30 * 60)::BIGINT AS minutes FROM orders)"""


def jobs(spark, sf):
    o, k = b.table(spark, sf, "orders"), F.col("o_orderkey")
    odd = F.element_at(F.array(*[F.lit(x) for x in ("failed", "in_progress", "assigned", "lost")]), (k % 4 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise(odd)
    hours = (k % 30).cast("int")
    return o.select(k.alias("id"), F.col("o_custkey").alias("agent"), status.alias("status"),
                    (F.substring("o_orderpriority", 1, 1).cast("int") * 3 - 2).alias("priority"), F.col("o_orderdate").alias("created_at"),
                    (F.col("o_orderdate") + F.make_dt_interval(hours=hours)).alias("completed_at"), (k % 30 * 60).alias("minutes"))


ACTIVE = "status IN ('pending', 'assigned', 'in_progress')"


@query("active_jobs", with_(JOBS_SQL) + f"""SELECT id, priority, (epoch(TIMESTAMP '2001-08-01 12:00:00')::BIGINT - epoch_ms(created_at) // 1000) / 60 AS age_minutes
FROM jobs WHERE {ACTIVE} ORDER BY priority, created_at""")
def active_jobs(spark, sf):
    return ag.active_jobs(jobs(spark, sf), ntz(JOBS_AS_OF)).select("id", "priority", "age_minutes")


@query("queue_order", with_(JOBS_SQL) + "SELECT id, priority, created_at FROM jobs WHERE status = 'pending' ORDER BY priority, created_at, id")
def queue_order(spark, sf):
    return jobs(spark, sf).filter("status = 'pending'").orderBy("priority", "created_at", "id").select("id", "priority", "created_at")


OPP_SQL = """
opp AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'expired' END AS status,
        o_totalprice / 600000 AS confidence, o_orderdate AS discovered_at, CASE WHEN o_orderkey % 5 = 0 THEN NULL
          ELSE TIMESTAMP '2001-08-01 12:00:00' + INTERVAL 1 MINUTE * (o_orderkey % 1440 - 300)::INT END AS expires_at,
        CASE WHEN o_custkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS side, 5.0::DOUBLE AS suggested_position FROM orders),
pipe AS (SELECT *, (epoch(expires_at) - epoch(TIMESTAMP '2001-08-01 12:00:00')) / 3600 AS hours_remaining FROM opp WHERE status = 'pending'),
pipe2 AS (SELECT *, CASE WHEN hours_remaining < 0 THEN 'expired' WHEN hours_remaining < 1 THEN 'urgent' WHEN hours_remaining < 6 THEN 'soon' ELSE 'normal' END AS urgency FROM pipe)"""


def opportunities(spark, sf):
    o, k = b.table(spark, sf, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("expired")
    expiry = F.when(k % 5 != 0, ntz(JOBS_AS_OF) + F.make_dt_interval(mins=(k % 1440 - 300).cast("int")))
    return o.select(k.alias("id"), status.alias("status"), (F.col("o_totalprice") / 600000).alias("confidence"),
                    F.col("o_orderdate").alias("discovered_at"), expiry.alias("expires_at"),
                    F.when(F.col("o_custkey") % 2 == 0, "YES").otherwise("NO").alias("side"), F.lit(5.0).alias("suggested_position"))


def pipeline(spark, sf):
    return ag.opportunity_pipeline(opportunities(spark, sf), ntz(JOBS_AS_OF))


@query("opportunity_pipeline", with_(OPP_SQL) + "SELECT id, confidence, hours_remaining, urgency FROM pipe2 ORDER BY confidence DESC, discovered_at")
def opportunity_pipeline(spark, sf):
    return pipeline(spark, sf).select("id", "confidence", "hours_remaining", "urgency")


@query("urgent_top3", with_(OPP_SQL) + """SELECT id, hours_remaining FROM pipe2 WHERE urgency = 'urgent' ORDER BY confidence DESC, discovered_at, id LIMIT 3""")
def urgent_top3(spark, sf):
    return ag.urgent(pipeline(spark, sf)).select("id", "hours_remaining")


@query("opportunity_jobs", with_(OPP_SQL) + """SELECT id AS opportunity_id, 'execute_trade' AS job_type, CASE WHEN confidence > 0.8::DOUBLE THEN 3 ELSE 5 END AS priority,
  side, suggested_position AS amount, discovered_at + INTERVAL 6 HOURS AS expires_at FROM opp""")
def opportunity_jobs(spark, sf):
    opp, made = ag.opportunity_jobs(opportunities(spark, sf).drop("expires_at"))
    return made.join(opp.select(F.col("id").alias("opportunity_id"), "expires_at"), "opportunity_id")


EXEC_SQL = """
ex AS (SELECT l_suppkey AS agent, l_shipdate AS executed_at, l_extendedprice AS amount, l_extendedprice * (l_discount - 0.05::DOUBLE) AS pnl,
        CASE WHEN l_linestatus = 'F' THEN 'settled' ELSE 'executed' END AS status,
        CASE WHEN l_orderkey % 7 > 0 THEN 0.5::DOUBLE + l_tax * 5 END AS confidence FROM lineitem),
daily AS (SELECT executed_at::DATE AS day, agent, count(*) AS trades, count(*) FILTER (pnl > 0) AS winners, count(*) FILTER (pnl < 0) AS losers,
        round(sum(pnl) + 0.0::DOUBLE, 4) AS total_pnl, round(sum(amount), 2) AS volume,
        round(coalesce(sum(confidence), 0) + 0.0::DOUBLE, 4) AS confidence, count(confidence) AS rated FROM ex WHERE status = 'settled' GROUP BY 1, 2)"""


def executions(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("agent"), F.col("l_shipdate").alias("executed_at"), F.col("l_extendedprice").alias("amount"),
                     (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"),
                     F.when(F.col("l_linestatus") == "F", "settled").otherwise("executed").alias("status"),
                     F.when(F.col("l_orderkey") % 7 > 0, 0.5 + F.col("l_tax") * 5).alias("confidence"))


@query("daily_performance", with_(EXEC_SQL) + "SELECT day, agent, trades, winners, losers, total_pnl, total_pnl / trades AS avg_pnl, volume FROM daily")
def daily_performance(spark, sf):
    return ag.daily_performance(executions(spark, sf).drop("confidence"))


@query("agent_rollup", with_(EXEC_SQL, JOBS_SQL, """
parts AS (SELECT agent, day, trades, winners, losers, total_pnl, volume, confidence, rated, 0 AS done, 0 AS failed, 0 AS minutes FROM daily UNION ALL
      SELECT agent, completed_at::DATE, 0, 0, 0, 0, 0, 0, 0, count(*) FILTER (status = 'completed'), count(*) FILTER (status = 'failed'), sum(minutes)
      FROM jobs WHERE status IN ('completed', 'failed') GROUP BY 1, 2),
rolled AS (SELECT agent, period, date_trunc(unit, day)::DATE AS period_start, sum(trades)::BIGINT AS trades, sum(winners)::BIGINT AS winners, sum(losers)::BIGINT AS losers,
        round(sum(total_pnl) + 0.0::DOUBLE, 4) AS total_pnl, round(sum(volume), 2) AS volume, sum(done)::BIGINT AS jobs_completed,
        sum(failed)::BIGINT AS jobs_failed, sum(minutes)::BIGINT AS minutes, round(sum(confidence) + 0.0::DOUBLE, 4) AS confidence, sum(rated)::BIGINT AS rated
      FROM parts CROSS JOIN (VALUES ('daily', 'day'), ('weekly', 'week'), ('monthly', 'month')) p(period, unit) GROUP BY 1, 2, 3)""") + """
SELECT agent, period, period_start, trades, winners, losers, total_pnl, volume, jobs_completed, jobs_failed,
  CASE WHEN rated > 0 THEN round(confidence / rated, 4) END AS avg_confidence, CASE WHEN trades > 0 THEN volume / trades END AS avg_trade_size,
  CASE WHEN jobs_completed + jobs_failed > 0 THEN minutes / (jobs_completed + jobs_failed) END AS avg_job_minutes FROM rolled""")
def agent_rollup(spark, sf):
    return ag.agent_rollup(executions(spark, sf), jobs(spark, sf)).drop("minutes")


@query("health_counters", with_(STATUS_SQL, JOBS_SQL) + f"""SELECT count(*) AS total_agents, count(*) FILTER (health = 'stale') AS stale,
  count(*) FILTER (health <> 'stale' AND status = 'blocked') AS blocked, (SELECT count(*) FROM jobs WHERE {ACTIVE}
  AND (epoch(TIMESTAMP '2001-08-01 12:00:00') - epoch(created_at)) / 60 > 30) AS stuck_jobs FROM health""")
def health_counters(spark, sf):
    return ag.health_counters(health(spark, sf), jobs(spark, sf), ntz(JOBS_AS_OF))


@query("enum_check", with_(JOBS_SQL) + """SELECT id, violations FROM (SELECT id, concat_ws(',', CASE WHEN status NOT IN ('pending', 'assigned', 'in_progress',
  'completed', 'failed') THEN 'valid_status' END, CASE WHEN NOT priority BETWEEN 1 AND 10 THEN 'valid_priority' END) AS violations FROM jobs) WHERE violations <> ''""")
def enum_check(spark, sf):
    return ag.violations(jobs(spark, sf), ag.job_checks()).select("id", F.array_join("violations", ",").alias("violations"))


@query("enum_quarantine", with_(JOBS_SQL, """
c AS (SELECT id, concat_ws(',', CASE WHEN status NOT IN ('pending', 'assigned', 'in_progress', 'completed', 'failed') THEN 'valid_status' END,
  CASE WHEN NOT priority BETWEEN 1 AND 10 THEN 'valid_priority' END) AS violations FROM jobs)""") + """
SELECT CASE WHEN violations = '' THEN 'accepted' ELSE 'rejected' END AS part, violations, count(*) AS jobs, sum(id)::BIGINT AS ids, (SELECT count(*) FROM c) AS seen,
  (SELECT count(*) FROM c WHERE violations <> '') AS rejected, (SELECT count(*) FROM c WHERE contains(violations, 'valid_status')) AS bad_status FROM c GROUP BY 1, 2""")
def enum_quarantine(spark, sf):
    """Good and rejected jobs in two tables written by one pass, with the counts it observed."""
    path = shared_dir(spark, "quarantine")
    seen = ag.quarantine(jobs(spark, sf), ag.job_checks(), path)
    t = spark.read.parquet(path).groupBy("part", F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("jobs"), F.sum("id").alias("ids"))
    return t.withColumns({"seen": F.lit(seen["rows"]).cast("bigint"), "rejected": F.lit(seen["rejected"]).cast("bigint"), "bad_status": F.lit(seen["valid_status"]).cast("bigint")})
