"""Metrics of binary, grouped and numeric predictions, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag, ratio

CLIP = 1e-7


def _mean(x: Column) -> Column:
    return F.avg(x.cast("double"))


def auc(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Area under the curve from average ranks.  Rows are first counted by score, so that ranks run over distinct scores."""
    by = by or []
    counts = df.groupBy(*by, p).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    w = Window.partitionBy(*by).orderBy(p)
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = counts.withColumn("u", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2.0))
    pos, neg = F.sum("pos").cast("double"), F.sum(F.col("n") - F.col("pos")).cast("double")
    return part.groupBy(*by).agg((F.sum("u") / F.nullif(pos * neg, F.lit(0.0))).alias("auc"))


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None, least: int = 1) -> DataFrame:
    """n, AUC, log loss, Brier score, accuracy; groups of under ``least`` rows are left out."""
    by = by or []
    q = F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))
    t = F.col(y).cast("double")
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), _mean(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias("log_loss"), _mean(F.pow(F.col(p) - t, F.lit(2.0))).alias("brier"), _mean(flag((F.col(p) >= 0.5) == (t == 1))).alias("accuracy")
    )
    areas = auc(df, y, p, by)
    joined = sums.join(areas, by) if by else sums.crossJoin(areas)  # one row each
    return joined.filter(F.col("n") >= least)


def calibration(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Mean prediction and rate of each bin of equal width that has rows."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), _mean(F.col(p)).alias("mean_pred"), _mean(F.col(y)).alias("frac_pos"))


def ece(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    table = calibration(df, y, p, bins)
    return table.agg((F.sum(F.abs(F.col("mean_pred") - F.col("frac_pos")) * F.col("n")) / F.sum("n")).alias("ece"))


def subgroups(df: DataFrame, labels: dict[str, Column], y: str = "y", p: str = "p", least: int = 50) -> DataFrame:
    """Binary metrics of rows by several labellings at once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("family"), x.cast("string").alias("label")) for name, x in labels.items()]))
    return binary_metrics(df.select(y, p, pairs.alias("g")).select(y, p, "g.family", "g.label").filter("label IS NOT NULL"), y, p, ["family", "label"], least)


def quantile_edges(df: DataFrame, x: str, parts: int = 5) -> list[float]:
    """Inner edges of equal-frequency buckets (of a training set)."""
    return list(df.agg(F.percentile(x, F.array(*[F.lit(k / parts) for k in range(1, parts)])).alias("e")).first()["e"] or [])


def by_edges(x: str, edges: list[float]) -> Column:
    """The number of edges below the value."""
    return sum((flag(F.col(x) > e) for e in edges), F.lit(0))


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R2, bias, median absolute error."""
    e, t = F.col(p) - F.col(y), F.col(y).cast("double")
    sse, n = F.sum(e * e), F.count("*")
    spread = F.sum(t * t) - F.sum(t) * F.sum(t) / n
    return df.groupBy(*(by or [])).agg(n.alias("n"), _mean(F.abs(e)).alias("mae"), F.sqrt(_mean(e * e)).alias("rmse"), (1 - sse / F.nullif(spread, F.lit(0.0))).alias("r2"), _mean(e).alias("bias"), F.median(F.abs(e)).alias("median_ae"))


def normalize(df: DataFrame, group: list[str], score: str, how: str = "renorm", temperature: float = 1.0) -> DataFrame:
    """``prob`` of each row within its group: proportional, softmax, or softmax at a temperature."""
    w = Window.partitionBy(*group)
    if how == "renorm":
        x = F.col(score)
    elif how == "softmax":
        x = F.exp(F.least(F.greatest(F.col(score), F.lit(-20.0)), F.lit(20.0)))
    else:
        z = F.col(score) / F.lit(float(temperature))
        x = F.exp(F.greatest(z - F.max(z).over(w), F.lit(-50.0)))
    total = F.sum(x).over(w)
    return df.withColumn("prob", F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.count("*").over(w)))


def group_metrics(df: DataFrame, group: list[str], target: str = "target", p: str = "prob", tie: str = "candidate_civ") -> DataFrame:
    """Top-1, -3 and -5 accuracy, log loss, Brier score and mean probability of the chosen row; groups without exactly one are left out."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1.0))
    rows = df.withColumns({"_q": q, "_rank": F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(p), tie))})
    one = rows.groupBy(*group).agg(F.sum(target).alias("c"), F.max(F.when(F.col(target) == 1, F.col("_rank"))).alias("r"), F.max(F.when(F.col(target) == 1, F.col("_q"))).alias("q"), F.sum(F.pow(F.col("_q") - F.col(target), F.lit(2.0))).alias("b")).filter("c = 1")
    return one.agg(F.count("*").alias("n"), *[_mean(flag(F.col("r") <= k)).alias(f"top{k}_acc") for k in (1, 3, 5)], _mean(-F.ln("q")).alias("log_loss"), _mean(F.col("b")).alias("brier"), _mean(F.col("q")).alias("mean_chosen_prob"))


def fit_temperature(df: DataFrame, group: list[str], score: str, target: str = "target", low: float = 0.05, high: float = 10.0, steps: int = 40, at_once: int = 8) -> float:
    """The temperature of least loss: each pass evaluates a grid of ``at_once`` values and keeps the part around the best."""
    w = Window.partitionBy(*group)
    base = df.select(*group, target, (F.col(score) - F.max(score).over(w)).alias("_z")).persist()
    passes = max(1, round(steps / at_once))
    for _ in range(passes):
        grid = [low + (high - low) * k / (at_once + 1) for k in range(1, at_once + 1)]
        sums = [F.sum(F.exp(F.greatest(F.col("_z") / t, F.lit(-50.0)))).alias(f"s{k}") for k, t in enumerate(grid)]
        chosen = base.groupBy(*group).agg(F.max(F.when(F.col(target) == 1, F.col("_z"))).alias("z"), *sums)
        losses = chosen.agg(*[F.avg(F.ln(f"s{k}") - F.greatest(F.col("z") / t, F.lit(-50.0))).alias(str(k)) for k, t in enumerate(grid)]).first()
        best = min(range(at_once), key=lambda k: losses[k] if losses[k] is not None else float("inf"))
        low, high = (grid[best - 1] if best else low), (grid[best + 1] if best + 1 < at_once else high)
    base.unpersist()
    return (low + high) / 2


def residual_curve(df: DataFrame, x: str, residual: str, bins: int = 50, least: int = 20) -> DataFrame:
    """Mean residual and its standard error in equal-frequency bins of x."""
    edges = sorted(set(quantile_edges(df, x, bins)))
    out = df.groupBy(by_edges(x, edges).alias("bin")).agg(F.count("*").alias("n"), _mean(F.col(x)).alias("x_mean"), _mean(F.col(residual)).alias("mean_residual"), (F.stddev_samp(residual) / F.sqrt(F.count("*").cast("double"))).alias("se"))
    return out.filter(F.col("n") >= least)


def residual_summary(df: DataFrame, residual: str, against: list[str], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), _mean(F.col(residual)).alias("mean"), F.stddev_samp(residual).alias("std"), F.median(residual).alias("median"), *[F.corr(residual, x).alias(f"corr_{x}") for x in against])


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two clusterings from their contingency table."""
    pairs = lambda c: c * (c - 1) / 2.0
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    side = lambda x: cells.groupBy(x).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"s_{x}"))
    one = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("all")).crossJoin(side(a)).crossJoin(side(b))  # one row each
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / F.nullif(pairs(F.col("all")), F.lit(0.0))
    return one.select(ratio(F.col("s") - expected, (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2.0 - expected).alias("ari"))
