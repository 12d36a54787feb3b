"""Cost, usage counters and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Price of a million tokens in, cached, out.
PRICES = {"flash": (0.30, 0.075, 2.50), "pro": (1.25, 0.3125, 10.00), "flash-lite": (0.10, 0.025, 0.40)}
#: Limits of the plans, -1 for none: searches a day, downloads a day, starred answers, days of history.
PLANS = {"starter": (10, 3, 10, 7), "pro": (-1, -1, 50, -1), "enterprise": (-1, -1, -1, -1)}
DEFAULT_PLAN = "starter"


def cost(calls: DataFrame) -> DataFrame:
    """``calls`` with cost_usd: uncached, cached, output and thinking tokens at their model's price, 0 for unknown models."""
    prices = calls.sparkSession.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, p_in double, p_cached double, p_out double")
    j = calls.join(F.broadcast(prices), "model", "left")
    cached = F.greatest(F.lit(0), F.least("cached_tokens", "input_tokens"))
    total = (F.col("input_tokens") - cached) * F.col("p_in") + cached * F.col("p_cached") + (F.col("output_tokens") + F.col("thinking_tokens")) * F.col("p_out")
    return j.withColumn("cost_usd", F.round(F.coalesce(total / 1e6, F.lit(0.0)), 8)).drop("p_in", "p_cached", "p_out")


def cache_cost(tokens: Column, rate: Column | float, hours: Column | float) -> Column:
    """Price of keeping a prompt: tokens x rate x hours a million, nothing below zero."""
    value = tokens * rate * hours / 1e6
    return F.when(value > 0, value).otherwise(0.0)


def totals(calls: DataFrame, users: DataFrame) -> DataFrame:
    """Totals of each user of ``users``; zeros for one without calls."""
    own = calls.groupBy("user_id").agg(
        F.count("*").alias("calls"),
        *(F.sum(f"{c}_tokens").alias(f"{c}_tokens") for c in ("input", "output", "thinking")),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )
    names = [c for c in own.columns if c != "user_id"]
    return users.select("user_id").distinct().join(own, "user_id", "left").fillna(0, names)


def daily_counters(events: DataFrame) -> DataFrame:
    """(user_id, date, action, amount): counts by day, what a store of counters would hold."""
    return events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), "action").agg(F.sum("amount").alias("amount"))


def last_days(counters: DataFrame, users: DataFrame, end: Column, days: int) -> DataFrame:
    """(user_id, date, amount): every day up to ``end`` for every user, zeros where nothing was counted."""
    calendar = F.explode(F.sequence(F.date_sub(F.to_date(end), days - 1), F.to_date(end))).alias("day")
    grid = users.select("user_id").distinct().select("user_id", calendar).withColumn("date", F.date_format("day", "yyyy-MM-dd")).drop("day")
    sums = counters.groupBy("user_id", "date").agg(F.sum("amount").alias("amount"))
    return grid.join(sums, ["user_id", "date"], "left").fillna(0, ["amount"])


def plans(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PLANS.items()], "plan string, searches bigint, downloads bigint, starred bigint, history_days bigint")


def with_plan(users: DataFrame) -> DataFrame:
    """Users with their plan's limits; an unknown plan means the default one."""
    known = plans(users.sparkSession)
    default = known.where(F.col("plan") == DEFAULT_PLAN).select(*(F.col(c).alias(f"d_{c}") for c in known.columns if c != "plan"))
    limits = [c for c in known.columns if c != "plan"]
    j = users.join(F.broadcast(known), "plan", "left").join(F.broadcast(default), F.lit(True))
    return j.select(*users.columns, *(F.coalesce(c, f"d_{c}").alias(c) for c in limits))


def quota(used: Column, limit: Column) -> tuple[Column, Column]:
    """(allowed, remaining): always and -1 without a limit."""
    return F.when(limit < 0, True).otherwise(used < limit), F.when(limit < 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), limit - used))
