"""Operational analytics: windowed summaries, nearest-index percentiles, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_percentile(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-index percentiles without gathering a group: counts by distinct value, running totals, and the first value that reaches the index."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(w))
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * s), F.col(value))).alias(name) for name, s in shares.items()])


def summary(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, F.struct(*order)).alias("latest")
    )


def transitions(df: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Rows at which a flag changes from the key's row before (false at first)."""
    before = F.coalesce(F.lag(flag).over(Window.partitionBy(key).orderBy(*order)), F.lit(False))
    return df.withColumn("_before", before).where(F.col(flag) != F.col("_before")).withColumn("transition", F.when(F.col(flag), "triggered").otherwise("resolved")).drop("_before")


#: Prices in dollars for a million tokens in and out, by provider and model; the last column tells the one for all others.
PRICES = (
    ("claude", "claude-3-5-sonnet-20241022", 3.0, 15.0, True),
    ("claude", "claude-3-opus-20240229", 15.0, 75.0, False),
    ("gemini", "gemini-1.5-flash", 0.075, 0.30, False),
    ("gemini", "gemini-1.5-pro", 1.25, 5.0, False),
    ("gemini", "gemini-2.0-flash-exp", 0.0, 0.0, False),
)
#: Alerts with their thresholds, and the budget that costs are measured by.
ALERTS, BUDGET = (("high_error_rate", "error", 0.05), ("cost_budget_warning", "warning", 0.8), ("high_latency", "warning", 30.0)), 0.30


def costs(usage: DataFrame) -> DataFrame:
    """Requests, tokens and cost by provider and model of usage (provider, model, input_tokens, output_tokens); models without a price cost what the default does."""
    spark = usage.sparkSession
    prices = spark.createDataFrame([p[:4] for p in PRICES], "provider string, model string, _in double, _out double")
    _, _, into, out, _ = next(p for p in PRICES if p[4])
    sums = usage.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"))
    priced = sums.join(F.broadcast(prices), ["provider", "model"], "left")
    cost = (F.col("input_tokens") * F.coalesce("_in", F.lit(into)) + F.col("output_tokens") * F.coalesce("_out", F.lit(out))) / 1_000_000
    return priced.select("provider", "model", "requests", "input_tokens", "output_tokens", F.round(cost, 4).alias("cost"))


def alerts(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Alerts of each key from its totals (errors, requests, cost, latency): name, severity, value, triggered."""
    value = {"high_error_rate": F.coalesce("errors", F.lit(0)) / F.greatest(F.coalesce("requests", F.lit(1)), F.lit(1)), "cost_budget_warning": F.coalesce("cost", F.lit(0.0)) / BUDGET, "high_latency": F.coalesce("latency", F.lit(0.0))}
    each = [F.struct(F.lit(n).alias("alert"), F.lit(level).alias("severity"), value[n].cast("double").alias("value"), (value[n] > most).alias("triggered")) for n, level, most in ALERTS]
    return totals.select(*keys, F.explode(F.array(*each)).alias("a")).select(*keys, "a.*")


def overall(df: DataFrame, value: str, failed: str, hit: str) -> DataFrame:
    """One row of all queries: total, errors, hits, mean, p95, p99 and error rate in percent. Percentiles come from counts by value, so nothing is gathered."""
    sums = df.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col(failed).cast("long")), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.col(hit).cast("long")), F.lit(0)).alias("hits"), F.round(F.avg(value), 4).alias("mean"))
    shares = exact_percentile(df.withColumn("_all", F.lit(0)), ["_all"], value, {"p95": 0.95, "p99": 0.99}).drop("_all")
    return sums.join(F.broadcast(shares), F.lit(True), "left").withColumn("error_rate", F.round(F.col("errors") / F.greatest("total", F.lit(1)) * 100, 4))


def last_mean(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """The mean of each key's last n values."""
    last = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).groupBy(key).agg(F.round(F.avg(value), 4).alias("mean"))


def rollup(parts: DataFrame, value: str, warn: float, fail: float, names: tuple[str, str, str]) -> DataFrame:
    """One row: the worst state of all parts, and how many aren't in the best."""
    level = F.when(F.col(value) > fail, 2).when(F.col(value) > warn, 1).otherwise(0)
    worst = parts.agg(F.max(level).alias("_worst"), F.coalesce(F.sum((level > 0).cast("long")), F.lit(0)).alias("affected"))
    return worst.select(F.element_at(F.array(*map(F.lit, names)), F.coalesce("_worst", F.lit(0)) + 1).alias("overall"), "affected")


def within(at: Column, now: Column, seconds: int) -> Column:
    """Whether a time is no longer than so many seconds before now."""
    return at >= now - F.make_dt_interval(secs=F.lit(seconds))


def exported(rows: DataFrame, key: str) -> DataFrame:
    """key, metrics: the figures of each kind (ms, failed) as one JSON object."""
    figures = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"), F.round(F.avg("ms"), 2).alias("mean"), F.round(F.min("ms"), 2).alias("least"), F.round(F.max("ms"), 2).alias("most"))
    return figures.select(key, F.to_json(F.struct("n", "failures", "mean", "least", "most")).alias("metrics"))
