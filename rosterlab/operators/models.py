"""Per-position training, metrics and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlab import constants as C
from rosterlab.functions.values import hex_number, linear_fallback
from rosterlab.operators import forest as D
from rosterlab.operators.normalise import union_positions
from rosterlab.session import cut_lineage

TARGET = "fantasy_points_ppr"
#: Nodes a forest of Spark ML may come to, since the driver holds them all; deeper forests are kept as tables.
DRIVER_NODES = 1 << 20
OUTPUT_COLUMNS = ("name", "pos", "team", "opp", "is_home", "salary", "game_date", "proj_points")


def training_set(features: DataFrame, pos: str, nulls: str = "fill") -> DataFrame:
    """Rows of a position with a target; null features become zero ("fill") or drop the row ("drop")."""
    columns = C.TRAINING_FEATURES[pos]
    rows = features.filter((F.col("pos") == pos) & F.col(TARGET).isNotNull())
    return rows.fillna(0.0, subset=columns) if nulls == "fill" else rows.dropna(subset=columns)


def min_rows_gate(features: DataFrame, minimums: dict[str, int] = C.MIN_TRAINING_ROWS) -> DataFrame:
    """Training rows per position and whether they are enough for a model."""
    limits = F.create_map(*[F.lit(x) for pair in minimums.items() for x in pair])
    counts = features.filter(F.col(TARGET).isNotNull() & F.col("pos").isin(*minimums)).groupBy("pos").agg(
        F.count("*").alias("training_rows")
    )
    needed = F.try_element_at(limits, F.col("pos")).cast("bigint")
    return counts.withColumn("required_rows", needed).withColumn("trainable", F.col("training_rows") >= needed)


def split_80_20(rows: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Adds ``is_train``; decided by the row's keys, so it is the same for any partitioning."""
    digits = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    bucket = hex_number(F.substr(digits, F.lit(1), F.lit(13))) % 100
    return rows.withColumn("is_train", bucket < 80)


def train_position_models(
    features: DataFrame, keys: Sequence[str], positions: Sequence[str] = C.POSITIONS, nulls: str = "fill",
    trees: int = 300, depth: int = 30, seed: int = 42, minimums: dict[str, int] = C.MIN_TRAINING_ROWS,
) -> tuple[dict[str, PipelineModel | D.TableForest], DataFrame | None]:
    """One forest per position that passes the row gate, and the validation predictions of all of them.

    A forest that may come to more than ``DRIVER_NODES`` nodes is grown by tasks and kept as a table.
    """
    deep = trees << (depth + 1) > DRIVER_NODES
    if deep:
        needed = dict.fromkeys([*keys, "pos", TARGET, *[c for pos in positions for c in C.TRAINING_FEATURES[pos]]])
        features = cut_lineage(features.select(*[c for c in needed if c in features.columns]))
    gate = {r["pos"]: r["trainable"] for r in min_rows_gate(features, minimums).collect()}  # one row per position
    models: dict[str, PipelineModel | D.TableForest] = {}
    validation: DataFrame | None = None
    for pos in positions:
        if not gate.get(pos, False):
            continue
        rows = split_80_20(training_set(features, pos, nulls), keys, seed).select(
            *keys, "pos", TARGET, "is_train", *C.TRAINING_FEATURES[pos]
        )
        if deep:
            models[pos] = D.fit(rows.filter("is_train"), keys, C.TRAINING_FEATURES[pos], TARGET, trees, depth, seed)
        else:
            rows = rows.persist()
            assembler = VectorAssembler(inputCols=C.TRAINING_FEATURES[pos], outputCol="features")
            forest = RandomForestRegressor(
                featuresCol="features", labelCol=TARGET, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True
            )
            models[pos] = Pipeline(stages=[assembler, forest]).fit(rows.filter("is_train"))
        scored = models[pos].transform(rows).select(*keys, "pos", "is_train", TARGET, "prediction")
        validation = scored if validation is None else validation.unionByName(scored)
    return models, validation


def model_metrics(predictions: DataFrame) -> DataFrame:
    """MAE and R2 on the validation rows, and both row counts, per position."""
    held_out = ~F.col("is_train")
    error = F.col(TARGET) - F.col("prediction")
    squared = F.sum(F.when(held_out, error * error))
    spread = F.var_pop(F.when(held_out, F.col(TARGET))) * F.count_if(held_out)
    return predictions.groupBy("pos").agg(
        F.avg(F.when(held_out, F.abs(error))).alias("mae"), (1 - squared / spread).alias("r2"),
        F.count_if("is_train").alias("train_rows"), F.count_if(held_out).alias("validation_rows"),
    )


class MissingFeatures(ValueError):
    """A position's required features are not all in the table."""


def require_features(features: DataFrame, pos: str) -> list[str]:
    missing = [c for c in C.FEATURE_CONTRACT[pos] if c not in features.columns]
    if missing:
        raise MissingFeatures(f"missing features for {pos}: {', '.join(missing)}")
    return C.FEATURE_CONTRACT[pos]


def score_players(features: DataFrame, models: dict[str, PipelineModel | D.TableForest] | None = None) -> DataFrame:
    """proj_points of every player.

    Defenses get a constant.  A position without a model gets the weighted sum of its features, one whose model cannot
    be applied (for example because features are missing) gets its recent average.
    """
    models = models or {}
    features = features.drop("proj_points")
    scored: dict[str, DataFrame] = {}
    kept = list(features.columns)
    for pos in C.POSITIONS:
        rows = features.filter(F.col("pos") == pos)
        if pos == "DST":
            scored[pos] = rows.withColumn("proj_points", F.lit(C.DEFENSE_PROJECTION))
            continue
        try:
            needed = require_features(features, pos)
            if pos in models:
                filled = rows.select(F.struct(*kept).alias("_row"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in needed])
                scored[pos] = models[pos].transform(filled).select("_row.*", F.col("prediction").alias("proj_points"))
            else:
                scored[pos] = rows.withColumn("proj_points", linear_fallback([F.col(c) for c in needed]))
        except (MissingFeatures, PySparkException):
            fallback = F.col("fp_avg_3") if "fp_avg_3" in features.columns else F.lit(None)
            scored[pos] = rows.withColumn("proj_points", fallback.cast("double"))
    return union_positions(scored, features.withColumn("proj_points", F.lit(None).cast("double")))


def save_models(models: dict[str, PipelineModel | D.TableForest], path: str) -> None:
    for pos, model in models.items():
        target = f"{path.rstrip('/')}/pos={pos}"
        if isinstance(model, D.TableForest):
            model.save(target)
        else:
            model.write().overwrite().save(target)


def load_models(path: str, positions: Sequence[str] = C.POSITIONS) -> dict[str, PipelineModel | D.TableForest]:
    """Models found under ``path``; a position without one is simply absent and scores by its fallback."""
    models = {}
    for pos in positions:
        for load in (PipelineModel.load, partial(D.TableForest.load, SparkSession.active())):
            try:
                models[pos] = load(f"{path.rstrip('/')}/pos={pos}")
                break
            except Exception as error:  # the reader reports a missing path with different exception types
                if "not exist" not in str(error).lower() and "no such" not in str(error).lower():
                    raise
    return models
