"""Grouped cross-validation of classifiers with pyspark.ml."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name parts of columns that would leak the label.
FORBIDDEN = ("status", "label", "event_id", "found_id", "timestamp")


def usable_features(columns: list[str]) -> list[str]:
    """Columns that may be features: none whose name holds a forbidden part."""
    return [c for c in columns if not any(f in c.lower() for f in FORBIDDEN)]


#: Columns that task A leaves out, and name parts of which the boundary tasks' features have one.
METADATA = ("event_id", "asset_id", "event_label_care", "event_label_model", "event_start", "event_end")
METOCEAN = ("hs_", "tp_", "wind_speed_", "wind_direction_", "wave_direction_", "current_speed_", "current_direction_")
#: What each task learns: a condition on the aggregates of an event.
TARGETS = {"A": "event_label_care = 'anomaly'", "B": "event_label_model = 'maintenance_success'", "B_alt": "share_label_maintenance_success > 0"}


def task_columns(columns: list[str], task: str) -> list[str]:
    """Feature columns of a task: all but metadata and targets (A), or metocean ones that aren't null shares (B, B_alt)."""
    if task not in TARGETS:
        raise ValueError(f"unknown task: {task}")
    if task == "A":
        return [c for c in columns if c not in METADATA]
    return [c for c in columns if any(k in c for k in METOCEAN) and not c.endswith("_null_share")]


def task_features(df: DataFrame, task: str, keys: list[str]) -> DataFrame:
    """keys, the task's features with nulls filled by the column's median over all rows, and target (0 or 1); a column of nulls stays null."""
    from functools import reduce

    from tidemark.operators.stats import quantiles

    features = task_columns([c for c in df.columns if c not in keys], task)
    medians = [quantiles(df, [], c, {f"__{c}": 0.5}) for c in features]
    one = df.sparkSession.range(1).drop("id")
    filled = reduce(lambda a, m: a.join(F.broadcast(m), how="left"), medians, one) if medians else one  # one row
    target = F.coalesce(F.expr(TARGETS[task]).cast("int"), F.lit(0)).alias("target")
    return df.join(F.broadcast(filled), how="left").select(*keys, *(F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")).alias(c) for c in features), target)


def assign_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """df with fold: groups dealt in order of size (then id) back and forth, so no group is in two folds.

    Only one row for each group is ordered, by range partitions.
    """
    from tidemark.operators.stats import running_counts

    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).select(group, F.struct(-F.col("n"), F.col(group)).alias("at"), F.lit(1).alias("one"))
    sizes = running_counts(sizes, [], "at", ["one"])
    place = F.col("run_one") - 1
    turn, at = F.floor(place / folds), place % folds
    dealt = sizes.withColumn("fold", F.when(turn % 2 == 0, at).otherwise(folds - 1 - at).cast("int")).select(group, "fold")
    return df.join(dealt, group)


def cross_validate(df: DataFrame, features: list[str], label: str, group: str, folds: int = 3, kind: str = "logistic", seed: int = 1) -> DataFrame:
    """Out-of-fold scores: df's group, label, fold and score, imputed and scaled within each training part."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tidemark.plans.lineage import cut

    data = cut(assign_folds(df.select(*dict.fromkeys([*features, label, group])), group, folds))  # read again by every step of every fold
    filled = [f"__{c}" for c in features]
    model = LogisticRegression(featuresCol="x", labelCol=label) if kind == "logistic" else RandomForestClassifier(featuresCol="x", labelCol=label, maxDepth=4, numTrees=20, seed=seed)
    steps = Pipeline(stages=[Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), model])
    out = None
    for k in range(folds):
        fitted = steps.fit(data.filter(F.col("fold") != k))
        part = fitted.transform(data.filter(F.col("fold") == k)).select(group, label, "fold", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def compare(df: DataFrame, features: list[str], label: str, group: str, row_id: str, folds: int = 3) -> DataFrame:
    """Out-of-fold reports: the majority baseline, logistic regression and a shallow forest with groups kept apart, and the row-level contrast.

    One row for each model and threshold 0.05 to 0.95 with the counts and
    rates of stats.scores, ROC-AUC and average precision. In the contrast
    rows of a group are in several folds, which leaks and flatters.
    """
    from tidemark.operators.reports import roc_pr_auc
    from tidemark.operators.stats import scores
    from tidemark.plans.lineage import cut

    thresholds = [round(0.05 * i, 2) for i in range(1, 20)]
    df = cut(df.select(*dict.fromkeys([*features, label, group, row_id])))
    share = df.agg(F.avg(label).alias("score"))
    runs = {
        "majority": df.select(group, label).crossJoin(F.broadcast(share)),
        "logistic": cross_validate(df, features, label, group, folds),
        "forest": cross_validate(df, features, label, group, folds, "forest"),
        "logistic_row_level": cross_validate(df, features, label, row_id, folds),
    }
    out = None
    for name, run in runs.items():
        run = cut(run.select(label, "score"))
        one = scores(run, label, "score", thresholds).crossJoin(F.broadcast(roc_pr_auc(run, label, "score"))).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
