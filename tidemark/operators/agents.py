"""Agent reporting: health, jobs, opportunities, performance and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.values import hours_between, minutes_between, nz

ROLLED = 250_000  # rows of the inputs for each part of a rollup


def latest_state(updates: DataFrame, key: str, ts: str, tie: str, working: str = "working") -> DataFrame:
    """Newest row per key; ``last_activity`` is the newest time the key was working."""
    rest = [c for c in updates.columns if c not in (key, ts, tie)]
    return (updates.groupBy(key)
            .agg(F.max(F.struct(ts, tie, *rest)).alias("s"),
                 F.max(F.when(F.col("status") == working, F.col(ts))).alias("last_activity"))
            .select(key, F.col(f"s.{ts}").alias("last_heartbeat"), F.col(f"s.{tie}").alias(tie), *[F.col(f"s.{c}").alias(c) for c in rest], "last_activity"))


def merge_states(states: DataFrame, key: str, tie: str) -> DataFrame:
    """One row per key of several results of ``latest_state``, those with the tie column kept: the newest row, and the newest activity of all."""
    rest = [c for c in states.columns if c not in (key, "last_heartbeat", tie, "last_activity")]
    newest = F.max_by(F.struct("last_heartbeat", tie, *rest), F.struct("last_heartbeat", tie))
    merged = states.groupBy(key).agg(newest.alias("s"), F.max("last_activity").alias("last_activity"))
    return merged.select(key, F.col("s.last_heartbeat").alias("last_heartbeat"), F.col(f"s.{tie}").alias(tie), *[F.col(f"s.{c}").alias(c) for c in rest], "last_activity")


def agent_health(status: DataFrame, as_of: Column) -> DataFrame:
    m = minutes_between(as_of, F.col("last_heartbeat"))
    return status.withColumn("minutes_since_heartbeat", m).withColumn(
        "health", F.when(m > 5, "stale").when(m > 2, "warning").otherwise("healthy"))


def active_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    return (jobs.filter(F.col("status").isin(*fixed.ACTIVE_JOB_STATUS))
            .withColumn("age_minutes", minutes_between(as_of, F.col("created_at"))).orderBy("priority", "created_at"))


def opportunity_pipeline(opportunities: DataFrame, as_of: Column) -> DataFrame:
    """Pending opportunities with the time left; no expiry counts as normal."""
    h = hours_between(F.col("expires_at"), as_of)
    urgency = F.when(h < 0, "expired").when(h < 1, "urgent").when(h < 6, "soon").otherwise("normal")
    return (opportunities.filter(F.col("status") == "pending").withColumn("hours_remaining", h).withColumn("urgency", urgency)
            .orderBy(F.col("confidence").desc(), "discovered_at"))


def urgent(pipeline: DataFrame, k: int = 3) -> DataFrame:
    return (pipeline.filter(F.col("urgency") == "urgent")
            .orderBy(F.col("confidence").desc(), "discovered_at", "id").limit(k))


def daily_performance(executions: DataFrame) -> DataFrame:
    """Settled executions by day and agent; with a ``confidence`` column also its sum and the number of rows that have one."""
    e = executions.filter(F.col("status") == "settled")
    confidence = [F.round(nz(F.sum("confidence")) + 0.0, 4).alias("confidence"), F.count("confidence").alias("rated")] if "confidence" in executions.columns else []
    return (e.groupBy(F.to_date("executed_at").alias("day"), "agent")
            .agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("winners"),
                 F.count_if(F.col("pnl") < 0).alias("losers"), F.round(F.sum("pnl") + 0.0, 4).alias("total_pnl"),
                 F.round(F.sum("amount"), 2).alias("volume"), *confidence)
            .withColumn("avg_pnl", F.col("total_pnl") / F.col("trades")))


def agent_rollup(executions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Daily, weekly and monthly figures per agent; the average confidence is over executions that have one, null without any.

    Both inputs are reduced to one row per agent and day, which are dealt out by agent, before the three periods multiply the rows. There are as many
    parts as the inputs' rows ask for, so no task's groups grow with the input; an agent has at most one row of each input for a day.
    """
    parts = -(-(executions.count() + jobs.count()) // ROLLED) + 1
    e = daily_performance(executions).select(
        "agent", "day", "trades", "winners", "losers", "total_pnl", "volume", "confidence", "rated", *[F.lit(0).cast("bigint").alias(c) for c in ("done", "failed", "minutes")])
    finished = jobs.filter(F.col("status").isin("completed", "failed"))
    j = (finished.groupBy("agent", F.to_date("completed_at").alias("day"))
         .agg(F.count_if(F.col("status") == "completed").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"),
              F.sum(F.col("minutes").cast("bigint")).alias("minutes"))
         .select("agent", "day", *[F.lit(0).cast("bigint").alias(c) for c in ("trades", "winners", "losers")],
                 *[F.lit(0.0).alias(c) for c in ("total_pnl", "volume", "confidence")], F.lit(0).cast("bigint").alias("rated"), "done", "failed", "minutes"))
    period = F.explode(F.array(*[F.struct(F.lit(n).alias("period"), F.to_date(F.date_trunc(u, "day")).alias("period_start"))
                                 for n, u in (("daily", "day"), ("weekly", "week"), ("monthly", "month"))])).alias("p")
    r = (e.unionByName(j).repartition(parts, "agent").select("*", period).groupBy("agent", "p.period", "p.period_start")
         .agg(F.sum("trades").alias("trades"), F.sum("winners").alias("winners"), F.sum("losers").alias("losers"), F.round(F.sum("total_pnl") + 0.0, 4).alias("total_pnl"),
              F.round(F.sum("volume"), 2).alias("volume"), F.sum("done").alias("jobs_completed"), F.sum("failed").alias("jobs_failed"),
              F.sum("minutes").alias("minutes"), F.round(F.sum("confidence") + 0.0, 4).alias("confidence"), F.sum("rated").alias("rated")))
    return (r.withColumn("avg_confidence", F.round(F.try_divide("confidence", "rated"), 4)).drop("confidence", "rated")
            .withColumn("avg_trade_size", F.try_divide("volume", "trades"))
            .withColumn("avg_job_minutes", F.try_divide(F.col("minutes"), F.col("jobs_completed") + F.col("jobs_failed"))))


def health_counters(health: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Agents in all, stale ones, blocked ones that are not stale, and jobs active for over 30 minutes."""
    a = health.agg(F.count(F.lit(1)).alias("total_agents"), F.count_if(F.col("health") == "stale").alias("stale"),
                   F.count_if((F.col("health") != "stale") & (F.col("status") == "blocked")).alias("blocked"))
    stuck = active_jobs(jobs, as_of).agg(F.count_if(F.col("age_minutes") > 30).alias("stuck_jobs"))
    return a.join(F.broadcast(stuck))  # one row each


def opportunity_jobs(opportunities: DataFrame, expires_hours: int = 6) -> tuple[DataFrame, DataFrame]:
    """Opportunities with their expiry, and the job each one creates."""
    opp = opportunities.withColumn("expires_at", F.col("discovered_at") + F.expr(f"INTERVAL {expires_hours} HOURS"))
    jobs = opportunities.select(
        F.col("id").alias("opportunity_id"), F.lit("execute_trade").alias("job_type"),
        F.when(F.col("confidence") > 0.8, 3).otherwise(5).alias("priority"), "side", F.col("suggested_position").alias("amount"))
    return opp, jobs


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a constraint, with the names of the broken ones; null values pass as in SQL."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return df.withColumn("violations", broken).filter(F.size("violations") > 0)


def quarantine(df: DataFrame, checks: dict[str, Column], path: str) -> dict[str, int]:
    """Write rows that keep all constraints and rows that break one apart, in one pass over ``df``; returns how many there are.

    Below ``path``, ``part=accepted`` and ``part=rejected`` are the two tables; ``violations`` names the broken constraints. Null values pass, as in SQL.
    The counts (rows, rejected, and one for each constraint) are observed while the tables are written.
    """
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.size("violations") > 0).alias("rejected"),
              *[F.count_if(F.array_contains("violations", name)).alias(name) for name in checks]]
    checked = df.withColumn("violations", broken).observe(seen, *counts)
    checked.withColumn("part", F.when(F.size("violations") > 0, "rejected").otherwise("accepted")).write.partitionBy("part").parquet(path)
    return seen.get


def job_checks() -> dict[str, Column]:
    return {"valid_status": F.col("status").isin(*fixed.JOB_STATUS), "valid_priority": F.col("priority").between(*fixed.JOB_PRIORITY)}
