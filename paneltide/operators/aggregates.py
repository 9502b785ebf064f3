"""Grouped statistics of returns, scores and events."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paneltide.operators import quantiles as Q
from paneltide.operators.windows import YEAR, over, pct_rank

Z95 = 1.959963984540054


def sharpe(r: str) -> Column:
    """Annual Sharpe ratio; 0 where it has none."""
    return F.coalesce(over(F.avg(r), F.stddev_samp(r)) * YEAR**0.5, F.lit(0.0))


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def buckets(df: DataFrame, x: str, bounds: list[tuple[int, int]]) -> DataFrame:
    """Rows in each closed range; what falls between two of them is in none."""
    return df.agg(*(F.coalesce(F.sum(F.when(F.col(x).between(a, b), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"b{a}_{b}") for a, b in bounds))


def equity(df: DataFrame, r: str, key: str) -> DataFrame:
    """Growth of 1 by compounding, and the drawdown from its running top."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    made = df.withColumn("equity", F.exp(F.sum(F.log1p(r)).over(w)))
    return made.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def summary(df: DataFrame, r: str, key: str) -> DataFrame:
    """Days, annual return (compounded and plain), volatility, Sharpe, worst drawdown, share of up days."""
    n = F.count(r)
    made = equity(df.where(F.col(r).isNotNull()), r, key)
    active = F.sum(F.when(F.col(r) != 0, 1).otherwise(0))
    return made.groupBy(key).agg(
        n.alias("n_days"), (F.exp(F.sum(F.log1p(r)) * YEAR / n) - 1).alias("ann_return"), (F.avg(r) * YEAR).alias("ann_mean"), (F.stddev_samp(r) * YEAR**0.5).alias("ann_vol"),
        sharpe(r).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), over(F.sum(F.when(F.col(r) > 0, 1.0).otherwise(0.0)), active.cast("double")).alias("hit_rate"),
    )


def hit_rate_interval(df: DataFrame, r: str, key: str, z: float = Z95) -> DataFrame:
    """Wilson interval of the share of positive values among those that are not 0."""
    base = df.where(F.col(r).isNotNull() & (F.col(r) != 0)).groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(F.col(r) > 0, 1.0).otherwise(0.0)).alias("p"))
    n, p = F.col("n").cast("double"), F.col("p")
    spread = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z
    below = 1 + z * z / n
    return base.select(key, "n", p.alias("hit_rate"), ((p + z * z / (2 * n) - spread) / below).alias("ci_low"), ((p + z * z / (2 * n) + spread) / below).alias("ci_high"))


def sample_moments(df: DataFrame, r: str, key: str) -> DataFrame:
    """Skewness and kurtosis, corrected for the size of the sample."""
    n = F.col("n").cast("double")
    base = df.where(F.col(r).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("s"), F.kurtosis(r).alias("k"))
    return base.where("n > 3").select(
        key, "n", "mean", "sd", (F.col("s") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), (((n + 1) * F.col("k") + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3).alias("kurtosis")
    )


def deflated_sharpe(df: DataFrame, r: str, key: str, trials: int = 1) -> DataFrame:
    """Probability that the true Sharpe ratio beats the best of so many random ones."""
    nd, best = NormalDist(), 0.0
    if trials > 1:
        g = 0.5772156649
        best = (1 - g) * nd.inv_cdf(1 - 1 / trials) + g * nd.inv_cdf(1 - 1 / (trials * math.e))
    m = sample_moments(df, r, key).where("n >= 20 AND sd > 0")
    sr = F.col("mean") / F.col("sd")
    spread = 1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr
    z = (sr - F.lit(best) / F.sqrt(F.col("n") - 1)) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(spread > 0, spread))
    return m.select(key, normal_cdf(z).alias("deflated_sharpe"))


def normal_cdf(x: Column) -> Column:
    """One half and the density times the sum of x^(2k+1) / (1*3*...*(2k+1)), which converges everywhere; 0 or 1 beyond 8."""
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(so_far: Column, k: Column) -> Column:
        term = so_far["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (so_far["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, add, lambda s: s["total"])
    inner = F.lit(0.5) + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * total
    return F.when(x > 8, 1.0).when(x < -8, 0.0).otherwise(inner)


def correlation(x: str, y: str) -> Column:
    """NULL where one side does not vary."""
    return over(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def rank_ic(df: DataFrame, pred: str, label: str, least: int = 5) -> DataFrame:
    """Spearman correlation per date, where enough tickers have both values."""
    both = df.where(F.col(pred).isNotNull() & F.col(label).isNotNull()).withColumn("a", pct_rank(pred, "date")).withColumn("b", pct_rank(label, "date"))
    return both.groupBy("date").agg(F.count("*").alias("n"), correlation("a", "b").alias("ic")).where(F.col("n") >= least).select("date", "ic")


def ic_summary(ics: DataFrame, fold: Column) -> DataFrame:
    return ics.groupBy(fold.alias("fold")).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"), (over(F.avg("ic"), F.stddev_samp("ic")) * YEAR**0.5).alias("ir"))


def payoff_by_quantile(df: DataFrame, x: str, y: str, bins: int = 5) -> DataFrame:
    """Mean outcome in each bin between exact quantiles; equal values share a bin. y is not NULL."""
    part = F.lit(0).cast("long")
    rows = df.where(F.col(x).isNotNull()).select(part.alias("part"), F.col(x).alias("x"), F.col(y).alias("y"))
    one = df.sparkSession.range(1).select(F.col("id").alias("block"), F.col("id").alias("part"))
    made = Q.bins(Q.order_statistics(rows, one, [i / bins for i in range(1, bins)]))
    each = made.select(F.posexplode(F.arrays_zip(F.col("ns").alias("n"), F.col("rates").alias("rate"))).alias("bin", "b"))
    return each.select(F.col("bin").cast("long").alias("bin"), "b.n", "b.rate").where("n > 0")


def turnover_costs(changes: DataFrame, types: DataFrame, bps: dict[str, float], usual: float) -> DataFrame:
    """Sum of traded weights per date and their cost by asset type; unknown tickers cost the usual."""
    rate = F.coalesce(F.create_map(*(F.lit(x) for pair in bps.items() for x in pair))[F.col("asset_type")], F.lit(usual))
    joined = changes.join(types.select("ticker", "asset_type"), "ticker", "left").withColumn("bps", F.when(F.col("asset_type").isNull(), usual).otherwise(rate))
    return joined.groupBy("date").agg(F.sum(F.abs("delta")).alias("turnover"), (F.sum(F.abs("delta") * F.col("bps")) / 1e4).alias("cost"))


def paired_t(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.where(d.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), over(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("t"))


def sentiment(df: DataFrame, key: str, x: str, edge: float = 0.05) -> DataFrame:
    """Mean, and the shares above, below and between the edges, in percent."""
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    v = F.col(x)
    return df.where(v.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), share(v > edge).alias("positive"), share(v < -edge).alias("negative"), share(v.between(-edge, edge)).alias("neutral"))
