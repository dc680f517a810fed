"""Models: rating formulas fitted by aggregates, baselines, logistic regressions, boosted trees, clusters."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Bucketizer, Imputer, Interaction, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import stored
from ..functions.exprs import elo_delta
from ..operators.metrics import adjusted_rand

GAMES_LINEAR, GAMES_SETTLED = 10, 30


# Rating formulas: one pass evaluates a whole grid.


def elo_grid(frame: DataFrame, ks: list[float], spreads: list[float], by: list[str] | None = None) -> DataFrame:
    """(k, spread[, by]): mean absolute error of Elo deltas.  Rows of equal inputs are counted first; the grid is columns, not rows."""
    inputs = frame.filter("player_rating_before IS NOT NULL AND opponent_rating_before IS NOT NULL AND observed_rating_delta IS NOT NULL")
    gap = (F.col("opponent_rating_before") - F.col("player_rating_before")).cast("double")
    counted = inputs.groupBy(*(by or []), gap.alias("gap"), "result", "observed_rating_delta").agg(F.count("*").alias("n"))
    grid = list(product(ks, spreads))
    error = lambda k, d: F.abs(F.col("observed_rating_delta") - F.lit(k) * (F.col("result") - 1.0 / (1.0 + F.pow(F.lit(10.0), F.col("gap") / F.lit(d))))) * F.col("n")
    sums = counted.groupBy(*(by or [])).agg(F.sum("n").alias("n"), *[F.sum(error(float(k), float(d))).alias(f"e{i}") for i, (k, d) in enumerate(grid)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(float(d)).alias("spread"), (F.col(f"e{i}") / F.col("n")).alias("mae")) for i, (k, d) in enumerate(grid)]))
    return sums.select(*(by or []), "n", rows.alias("r")).select(*(by or []), "n", "r.*")


def fit_elo(frame: DataFrame) -> dict[str, float]:
    """Coarse, then fine grid."""
    best = elo_grid(frame, [16, 24, 32, 40, 48], [200, 300, 400, 500, 600]).orderBy("mae").first()
    fine = elo_grid(frame, [best["k"] + x for x in range(-6, 7, 2)], [best["spread"] + x for x in range(-75, 76, 25)]).orderBy("mae").first()
    return {"k": fine["k"], "spread": fine["spread"], "mae": fine["mae"]}


def determinism(frame: DataFrame) -> DataFrame:
    """One row: input tuples seen more than once, and how many of them always gave the same delta."""
    keys = ["player_rating_before", "opponent_rating_before", "result"]
    groups = frame.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("observed_rating_delta").alias("d")).filter("n > 1")
    return groups.agg(F.count("*").alias("tuples"), F.coalesce(F.sum(F.when(F.col("d") <= 1, 1).otherwise(0)), F.lit(0)).alias("deterministic"), F.avg("d").alias("mean_deltas"))


#: Nested formulas: each adds terms to the one before.
def parametric_terms(level: str, spread: float = 400.0) -> list[tuple[str, Column]]:
    surprise = F.col("result") - 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("opponent_rating_before") - F.col("player_rating_before")).cast("double") / spread))
    games = F.col("games_this_season_before").cast("double")
    early = F.greatest(F.lit(0.0), 1.0 - games / GAMES_LINEAR)
    mid = F.greatest(F.lit(0.0), 1.0 - games / GAMES_SETTLED)
    hidden = F.coalesce(F.col("hidden_mmr_gap"), F.lit(0)).cast("double")
    gap = F.coalesce((F.col("player_mmr_before") - F.col("player_rating_before")).cast("double"), F.lit(0.0))
    terms = {
        "P0": [("one", F.lit(1.0)), ("result", F.col("result").cast("double"))],
        "P1": [("surprise", surprise)],
        "P2": [("early", early), ("early_surprise", early * surprise), ("mid", mid), ("mid_surprise", mid * surprise)],
        "P3": [("hidden", hidden), ("hidden_result", hidden * F.col("result"))],
        "P3b": [("streak", F.coalesce(F.col("current_streak"), F.lit(0)).cast("double"))],
        "P4": [("reconcile", gap), ("reconcile_early", gap * early)],
    }
    out: list[tuple[str, Column]] = []
    for name, columns in terms.items():
        out += columns
        if name == level:
            return out
    raise ValueError(level)


def fit_least_squares(df: DataFrame, y: str, terms: list[tuple[str, Column]], ridge: float = 1e-6, weight: Column | None = None) -> dict[str, float]:
    """Coefficients from the normal equations: one aggregation gives all sums, the driver solves a small system."""
    w = weight if weight is not None else F.lit(1.0)
    n = len(terms)
    sums = [F.sum(w * a * b).alias(f"x{i}_{j}") for i, (_, a) in enumerate(terms) for j, (_, b) in enumerate(terms) if i <= j]
    sums += [F.sum(w * a * F.col(y)).alias(f"y{i}") for i, (_, a) in enumerate(terms)]
    row = df.filter(F.col(y).isNotNull()).agg(*sums).first()
    x = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)], dtype=float)
    z = np.array([row[f"y{i}"] or 0.0 for i in range(n)], dtype=float)
    return dict(zip([name for name, _ in terms], np.linalg.solve(x + ridge * np.eye(n), z).tolist(), strict=True))


def predict_linear(df: DataFrame, coefficients: dict[str, float], terms: list[tuple[str, Column]], name: str = "pred") -> DataFrame:
    return df.withColumn(name, sum((F.lit(coefficients[x]) * c for x, c in terms), F.lit(0.0)))


def fit_nested(frame: DataFrame, levels: tuple[str, ...] = ("P0", "P1", "P2", "P3", "P3b", "P4")) -> dict[str, dict[str, float]]:
    rows = frame.filter("player_rating_before IS NOT NULL AND opponent_rating_before IS NOT NULL").persist()
    out = {x: fit_least_squares(rows, "observed_rating_delta", parametric_terms(x)) for x in levels}
    rows.unpersist()
    return out


def segment_choice(curve: list[tuple[float, float, float]]) -> dict[str, float | str]:
    """Linear or exponential decay of a mean residual by games, by AIC; rows are (games, mean, n)."""
    x, y, n = (np.array(c, dtype=float) for c in zip(*curve, strict=True))
    w = np.sqrt(n)

    def fit(columns: np.ndarray) -> tuple[float, np.ndarray]:
        beta = np.linalg.lstsq(columns * w[:, None], y * w, rcond=None)[0]
        return float(np.sum((w * (y - columns @ beta)) ** 2)), beta

    one = np.ones_like(x)
    linear, _ = fit(np.stack([one, x], axis=1))
    rates = np.geomspace(0.01, 2.0, 60)
    exponential, rate = min((fit(np.stack([one, np.exp(-r * x)], axis=1))[0], r) for r in rates)
    aic = lambda sse, k: len(x) * np.log(max(sse, 1e-12) / len(x)) + 2 * k
    best = "exponential" if aic(exponential, 3) < aic(linear, 2) else "linear"
    return {"segment": best, "rate": float(rate), "aic_linear": float(aic(linear, 2)), "aic_exponential": float(aic(exponential, 3))}


# Baselines as lookups.


def fallback_rates(train: DataFrame, levels: list[list[str]], y: str = "target", least: int = 20) -> list[tuple[list[str], DataFrame]]:
    """For each level its groups' mean and count; groups under ``least`` rows are left out."""
    return [(keys, train.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("rate"), F.count("*").alias("n")).filter(F.col("n") >= least)) for keys in levels]


def predict_fallback(df: DataFrame, tables: list[tuple[list[str], DataFrame]], default: float) -> DataFrame:
    """The first level that knows the row's group."""
    found = []
    for k, (keys, rates) in enumerate(tables):
        df = df.join(rates.select(*keys, F.col("rate").alias(f"_r{k}")), keys, "left")
        found.append(F.col(f"_r{k}"))
    return df.withColumn("pred", F.coalesce(*found, F.lit(float(default)))).drop(*[f"_r{k}" for k in range(len(tables))])


def predict_elo(df: DataFrame, k: float, spread: float) -> DataFrame:
    return df.withColumn("pred", elo_delta(F.col("player_rating_before").cast("double"), F.col("opponent_rating_before").cast("double"), F.col("result").cast("double"), k, spread))


# MLlib models.


def features(numeric: list[str], categorical: list[str] | None = None, interactions: list[tuple[str, str]] | None = None, scale: bool = True) -> list:
    """Stages: medians for nulls, categories, interactions, one vector."""
    categorical = categorical or []
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{x}_i" for x in numeric])] if numeric else []
    inputs = [f"{x}_i" for x in numeric]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{x}_s" for x in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{x}_s" for x in categorical], outputCols=[f"{x}_o" for x in categorical], handleInvalid="keep")]
        inputs += [f"{x}_o" for x in categorical]
    for a, b in interactions or []:
        stages.append(Interaction(inputCols=[f"{a}_i", f"{b}_i"], outputCol=f"{a}_x_{b}"))
        inputs.append(f"{a}_x_{b}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw" if scale else "features", handleInvalid="keep"))
    return stages + ([StandardScaler(inputCol="raw", outputCol="features")] if scale else [])


def fit_logistic(train: DataFrame, numeric: list[str], categorical: list[str] | None = None, target: str = "target", l1: float = 0.0, interactions: list[tuple[str, str]] | None = None) -> PipelineModel:
    model = LogisticRegression(featuresCol="features", labelCol=target, regParam=l1 or 1e-6, elasticNetParam=1.0 if l1 else 0.0)
    return Pipeline(stages=[*features(numeric, categorical, interactions), model]).fit(train.select(*[F.col(x).cast("double") for x in numeric], *(categorical or []), F.col(target).cast("double").alias(target)))


def fit_trees(train: DataFrame, numeric: list[str], categorical: list[str] | None = None, target: str = "target", valid: str | None = None, weight: str | None = None, regression: bool = False, trees: int = 20, depth: int = 5) -> PipelineModel:
    """Boosted trees; rows where the boolean ``valid`` is true stop the boosting early."""
    kind = GBTRegressor if regression else GBTClassifier
    model = kind(featuresCol="features", labelCol=target, maxIter=trees, maxDepth=depth, seed=7, **({"validationIndicatorCol": valid} if valid else {}), **({"weightCol": weight} if weight else {}))
    columns = [F.col(x).cast("double") for x in numeric] + [F.col(x) for x in [*(categorical or []), *([valid] if valid else []), *([weight] if weight else [])]]
    return Pipeline(stages=[*features(numeric, categorical, scale=False), model]).fit(train.select(*columns, F.col(target).cast("double").alias(target)))


BINS = 32  # as many as the trees look at


def bin_edges(df: DataFrame, columns: list[str], most: int = BINS) -> list[list[float]]:
    """Edges of at most ``most`` bins for each column: between all its values if they are few, else at quantiles."""
    about = df.agg(*[F.approx_count_distinct(x).alias(x) for x in columns]).first()
    few = {x: [r[0] for r in df.select(x).distinct().limit(most + 1).collect()] for x in columns if about[x] <= 2 * most}
    out = []
    for x in columns:
        values = sorted(few.get(x, []))
        if 0 < len(values) <= most:
            edges = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        else:
            edges = sorted(set(df.approxQuantile(x, [k / most for k in range(1, most)], 0.001)))
        out.append([-math.inf, *edges, math.inf])
    return out


def fit_counted_trees(train: DataFrame, numeric: list[str], target: str = "target", valid: str | None = None, trees: int = 20, depth: int = 5) -> PipelineModel:
    """``fit_trees`` for many rows: trees only see bins of a column's values, so that rows of equal bins are counted first and weigh as many."""
    label = [F.col(target).cast("double").alias(target), *([F.col(valid)] if valid else [])]
    rows = train.select(*[F.col(x).cast("double") for x in numeric], *label)
    imputer = Imputer(strategy="median", inputCols=numeric, outputCols=[f"{x}_i" for x in numeric]).fit(rows)
    filled = imputer.transform(rows)
    bins = [f"{x}_b" for x in numeric]
    bucketizer = Bucketizer(splitsArray=bin_edges(filled, [f"{x}_i" for x in numeric]), inputCols=[f"{x}_i" for x in numeric], outputCols=bins, handleInvalid="keep")
    keys = [*bins, target, *([valid] if valid else [])]
    plain = [(F.col(x) + 0.0).alias(x) for x in bins]  # an order, not the categories that a Bucketizer's columns are marked as
    counted = stored(bucketizer.transform(filled).select(*plain, *keys[len(bins) :]).groupBy(*keys).agg(F.count("*").cast("double").alias("n")))
    model = GBTClassifier(featuresCol="features", labelCol=target, weightCol="n", maxIter=trees, maxDepth=depth, maxBins=BINS, seed=7, **({"validationIndicatorCol": valid} if valid else {}))
    assembler = VectorAssembler(inputCols=bins, outputCol="features", handleInvalid="keep")
    return PipelineModel(stages=[imputer, bucketizer, assembler, model.fit(assembler.transform(counted))])


def importance(model: PipelineModel) -> list[float]:
    """Feature importances of a tree model, in the order of its vector."""
    return model.stages[-1].featureImportances.toArray().tolist()


def tune_trees(train: DataFrame, numeric: list[str], target: str = "target", depths: tuple[int, ...] = (3, 5), rates: tuple[float, ...] = (0.05, 0.1)):
    """The best of a grid on one held-out part."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    model = GBTClassifier(featuresCol="features", labelCol=target, maxIter=10, seed=7)
    grid = ParamGridBuilder().addGrid(model.maxDepth, list(depths)).addGrid(model.stepSize, list(rates)).build()
    rows = train.select(*[F.col(x).cast("double") for x in numeric], F.col(target).cast("double").alias(target))
    return TrainValidationSplit(estimator=Pipeline(stages=[*features(numeric, scale=False), model]), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=target), seed=7).fit(rows)


def ablation(train: DataFrame, test: DataFrame, families: dict[str, list[str]], fit, metric) -> dict[str, float]:
    """The metric with all families, and without each."""
    everything = [c for columns in families.values() for c in columns]
    runs = {"all": everything} | {f"without_{x}": [c for c in everything if c not in columns] for x, columns in families.items()}
    return {name: metric(fit(train, columns).transform(test)) for name, columns in runs.items()}


def permutation_importance(model: PipelineModel, test: DataFrame, columns: list[str], metric, seed: int = 3) -> dict[str, float]:
    """Loss of the metric when one column's values are dealt anew among the rows."""
    base = metric(model.transform(test))
    out = {}
    for x in columns:
        order = lambda df, by, name: df.select("*", F.monotonically_increasing_id().alias("_m")).orderBy(by).withColumn(name, F.monotonically_increasing_id())
        left, right = order(test.drop(x), F.col("_m"), "_k").drop("_m"), order(test.select(x), F.rand(seed), "_k").drop("_m")
        out[x] = base - metric(model.transform(left.join(right, "_k").drop("_k")))
    return out


def fit_clusters(df: DataFrame, shares: list[str], behaviour: list[str], k: int = 6, components: int = 5, seed: int = 7) -> PipelineModel:
    """PCA of the share vectors, scaled with behaviour features, KMeans."""
    size = min(components, len(shares))
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=shares, outputCol="shares"), PCA(k=size, inputCol="shares", outputCol="pca"), VectorAssembler(inputCols=["pca", *behaviour], outputCol="joined", handleInvalid="keep"),
            StandardScaler(inputCol="joined", outputCol="features", withMean=True), KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"),
        ]
    ).fit(df)


def cluster_stability(df: DataFrame, key: str, seeds: tuple[int, int] = (7, 8), **options) -> float:
    """Agreement of two fits with different seeds."""
    one, two = (fit_clusters(df, seed=s, **options).transform(df).select(key, F.col("cluster").alias(f"c{i}")) for i, s in enumerate(seeds))
    return adjusted_rand(one.join(two, key), "c0", "c1").first()["ari"]


def cluster_summary(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(x).alias(f"mean_{x}") for x in numeric])




# Models of the other frames: what each learns from, and how its rows are weighted.

CIV_FEATURES = ["cand_pick_share_lifetime", "cand_pick_share_30d", "cand_wr_lifetime", "candidate_is_last_civ", "candidate_last_played_position", "cand_games_last_10_games", "recent_entropy_last_10_games", "candidate_current_streak_len"]
DELTA_FEATURES = ["visible_rating_gap", "hidden_mmr_gap", "result", "games_lifetime_before", "games_this_season_before", "days_since_last_game", "current_streak", "recent_wr_10", "recent_wr_20", "missing_player_rating", "missing_player_mmr"]
TEAM_FEATURES = ["skill_mean_diff", "skill_max_diff", "carry_gap_diff", "n_carried_diff", "games_lifetime_mean_diff", "overall_wr_mean_diff", "recent_wr_mean_diff", "n_new_players_diff"]


def fit_civ_model(train: DataFrame, valid: str | None = None, **options) -> PipelineModel:
    """How likely each candidate is to be picked; scores are normalised within a game by ``metrics.normalize``."""
    return fit_counted_trees(train, [x for x in CIV_FEATURES if x in train.columns], valid=valid, **options)


def fit_delta_model(train: DataFrame, valid: str | None = None, target: str = "observed_rating_delta", **options) -> PipelineModel:
    """Rating changes, by regression; rows without a change are left out."""
    return fit_trees(train.filter(F.col(target).isNotNull()), [x for x in DELTA_FEATURES if x in train.columns], ["map"] if "map" in train.columns else None, target=target, valid=valid, regression=True, **options)


def fit_team_model(train: DataFrame, valid: str | None = None, **options) -> PipelineModel:
    """Which team wins, from differences of team aggregates."""
    return fit_trees(train, [x for x in TEAM_FEATURES if x in train.columns], valid=valid, **options)


def fit_snapshot_model(train: DataFrame, columns: list[str], valid: str | None = None, weight: str = "row_weight", **options) -> PipelineModel:
    """Who wins, from the state at a checkpoint; each match weighs as much however many checkpoints it has."""
    return fit_trees(train, columns, valid=valid, weight=weight, **options)
