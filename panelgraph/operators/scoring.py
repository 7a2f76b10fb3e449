"""Entity classifier, importance tables, severity bands, risk outlook and factor stress."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgraph.fixed_values import (
    DRIVER_THRESHOLDS,
    FAN_STEPS,
    OUTLOOK_DOMAINS,
    RISK_LABELS,
    SPLIT_SEED,
    STRESS_BASE_DOWNSIDE,
    STRESS_BASE_LEVEL,
    STRESS_BASE_RETURN,
    STRESS_DOWNSIDE_RANGE,
    STRESS_SENSITIVITIES,
    SUB_SCORE_CAP,
    SUB_SCORES,
    TOP_IMPORTANCES,
    TRAIN_PERCENT,
    WARNING_THRESHOLD,
)
from panelgraph.functions import pairs
from panelgraph.functions.numbers import number, round_half_up
from panelgraph.operators.dyads import SOURCE, TARGET
from panelgraph.sources import dims

FEATURES = ("recent_events", "conflict_intensity")
LABEL = "escalation_warning"


#: Rows among which values are swapped in one task.
SWAP_ROWS = 4096

# --- classifier ---------------------------------------------------------------------------


def entity_totals(records: DataFrame, entity: str = "country", fatalities: str = "fatalities") -> DataFrame:
    """Rows and summed fatalities per entity, with the warning label."""
    deaths = F.coalesce(number(F.col(fatalities)), F.lit(0.0))
    totals = (
        records.filter(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(F.count(entity).alias("recent_events"), F.sum(deaths).alias("conflict_intensity"))
    )
    return totals.withColumn(LABEL, (F.col("conflict_intensity") > WARNING_THRESHOLD).cast("int"))


def with_split(totals: DataFrame, entity: str = "country", seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``is_train``: the MD5 of seed and entity decides, so the split ignores partitioning."""
    named = F.concat_ws(":", F.lit(seed), F.col(entity).cast("string"))
    bucket = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") % 100
    return totals.withColumn("is_train", bucket < TRAIN_PERCENT)


def train_classifier(totals: DataFrame, *, seed: int = SPLIT_SEED, trees: int = 100) -> PipelineModel:
    """Random forest on the training part; refuses a table with at most one row."""
    if totals.limit(2).count() < 2:
        raise ValueError("not enough data to train the model")
    forest = RandomForestClassifier(labelCol=LABEL, featuresCol="features", numTrees=trees, seed=seed)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fitted = Pipeline(stages=[assembler, forest]).fit(totals.filter("is_train"))
    # The fitted forest keeps a training summary that holds the session; a copy does not.
    return fitted.copy()


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def accuracy(model: PipelineModel, totals: DataFrame) -> float:
    evaluator = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
    return evaluator.evaluate(model.transform(totals.filter(~F.col("is_train"))))


def score(model: PipelineModel, totals: DataFrame) -> DataFrame:
    """Prediction and risk label for a whole table."""
    predicted = model.transform(totals).withColumn("escalation_prediction", F.col("prediction").cast("int"))
    label = F.when(F.col("escalation_prediction") == 1, RISK_LABELS[1]).otherwise(RISK_LABELS[0])
    return predicted.withColumn("status", label).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, spark, categories: Mapping[str, str] | None = None) -> DataFrame:
    """(feature, category, importance) of the fitted forest; its size is the feature list."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(f, (categories or {}).get(f, "events"), float(v)) for f, v in zip(FEATURES, values)]
    return spark.createDataFrame(rows, "feature string, category string, importance double")


def with_swapped(totals: DataFrame, entity: str = "country", seed: int = SPLIT_SEED, group_rows: int = SWAP_ROWS) -> DataFrame:
    """Every row once as it is (``swapped`` NULL) and once per feature with that feature's value of another row.

    Rows are dealt by a hash of the entity into groups of about ``group_rows``; inside a group each row takes the value of the
    next one in the order of the hash, the last that of the first. So no task orders the whole table.
    """
    hashed = totals.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.lit("swap"), F.col(entity).cast("string"))))
    groups = F.ceil(totals.agg(F.count(F.lit(1))).scalar() / group_rows)
    grouped = hashed.withColumn("_g", F.conv(F.substring("_h", 25, 8), 16, 10).cast("long") % groups)
    inside = Window.partitionBy("_g").orderBy("_h", entity)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    others = grouped.withColumns({f"_{f}": F.coalesce(F.lead(f).over(inside), F.first(f).over(whole)) for f in FEATURES})
    copies = others.withColumn("swapped", F.explode(F.array(F.lit(None).cast("string"), *[F.lit(f) for f in FEATURES])))
    taken = {f: F.when(F.col("swapped").eqNullSafe(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in FEATURES}
    return copies.withColumns(taken).drop("_h", "_g", *[f"_{f}" for f in FEATURES])


def permutation_importances(
    model: PipelineModel, totals: DataFrame, entity: str = "country", *, seed: int = SPLIT_SEED, categories: Mapping[str, str] | None = None, group_rows: int = SWAP_ROWS
) -> DataFrame:
    """(feature, category, importance): how much accuracy is lost when a feature's values are dealt to other rows.

    ``totals`` are labelled rows, best the ones held out of the training. Works for any model of ``FEATURES``.
    """
    right = (F.col("prediction") == F.col(LABEL)).cast("double")
    scored = model.transform(with_swapped(totals, entity, seed, group_rows)).groupBy("swapped").agg(F.avg(right).alias("accuracy"))
    whole = scored.filter(F.col("swapped").isNull()).select(F.col("accuracy").alias("_whole")).scalar()
    category = F.lit("events")
    for feature, name in (categories or {}).items():
        category = F.when(F.col("swapped") == feature, F.lit(name)).otherwise(category)
    return scored.filter(F.col("swapped").isNotNull()).select(F.col("swapped").alias("feature"), category.alias("category"), (whole - F.col("accuracy")).alias("importance"))


def top_importances(table: DataFrame, category: str = "all", top: int = TOP_IMPORTANCES) -> DataFrame:
    """The ``top`` most important features, or all features of one category."""
    ordered = [F.desc("importance"), F.asc("feature")]
    if category == "all":
        return table.orderBy(*ordered).limit(top)
    return table.filter(F.col("category") == category).orderBy(*ordered)


def split_contributions(table: DataFrame, value: str = "contribution") -> tuple[DataFrame, DataFrame]:
    """(raising, lowering) contributions."""
    return table.filter(F.col(value) > 0), table.filter(F.col(value) < 0)


# --- bands and sub-scores -----------------------------------------------------------------


def with_status(scores: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Add the severity status of (domain, score) rows by range lookup in a small table.

    The ranges are gathered per domain, so the lookup is an equi join on the domain.
    """
    bands = bands if bands is not None else dims.status_bands(scores.sparkSession)
    ranges = bands.groupBy("domain").agg(F.collect_list(F.struct("lower", "upper", "status")).alias("_bands"))
    value = F.col("score")
    fitting = F.filter(
        "_bands",
        lambda b: (b["lower"].isNull() | (value >= b["lower"])) & (b["upper"].isNull() | (value < b["upper"])),
    )
    return scores.join(ranges, "domain", "left").withColumn("status", F.get(fitting, 0)["status"]).drop("_bands")


def sub_scores(scores: DataFrame, offsets: Sequence[tuple[str, int]] = SUB_SCORES, cap: int = SUB_SCORE_CAP) -> DataFrame:
    """Signals derived from a score: min(cap, score - k) for each (name, k)."""
    signals = F.array(*[F.struct(F.lit(n).alias("signal"), F.lit(k).alias("below")) for n, k in offsets])
    out = scores.withColumn("_s", F.explode(signals)).select("*", "_s.*").drop("_s")
    return out.withColumn("sub_score", F.least(F.lit(cap), F.col("score") - F.col("below"))).drop("below")


# --- risk outlook -------------------------------------------------------------------------


def pair_bases(dyads: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Base scores per unordered pair: 100 x its strongest tension, or the override's values.

    ``overrides`` has pair_a, pair_b and one column per domain.
    """
    a, b = pairs.canonical(F.col(SOURCE), F.col(TARGET))
    base = dyads.groupBy(a.alias("pair_a"), b.alias("pair_b")).agg(
        round_half_up(100 * F.max("composite_tension_index")).cast("double").alias("_base")
    )
    names = [d for d, *_ in OUTLOOK_DOMAINS]
    if overrides is None:
        return base.select("pair_a", "pair_b", *[F.col("_base").alias(n) for n in names])
    given = overrides.select("pair_a", "pair_b", *[F.col(n).alias(f"_{n}") for n in names])
    joined = base.join(given, ["pair_a", "pair_b"], "full")
    return joined.select("pair_a", "pair_b", *[F.coalesce(f"_{n}", "_base").alias(n) for n in names])


def outlook(bases: DataFrame, horizons: DataFrame | None = None, domains: Sequence[str] | None = None) -> DataFrame:
    """(pair, horizon, domain, score, status) rows for the chosen domains.

    score = clamp(base + round(share of the horizon factor)). The horizons are a list of a few
    rows, carried inside the row as an array.
    """
    horizons = horizons if horizons is not None else dims.horizons(bases.sparkSession)
    listed = horizons.agg(F.collect_list(F.struct("horizon_days", "factor")).alias("h")).scalar()
    chosen = [d for d in OUTLOOK_DOMAINS if domains is None or d[0] in domains]
    timed = bases.withColumn("_h", F.explode(listed)).select("*", "_h.*").drop("_h")
    scores = F.array(
        *[
            F.struct(
                F.lit(name).alias("domain"),
                F.greatest(
                    F.lit(float(low)),
                    F.least(F.lit(float(high)), F.col(name) + round_half_up(F.col("factor") * F.lit(part))),
                ).alias("score"),
            )
            for name, part, low, high in chosen
        ]
    )
    rows = timed.withColumn("_s", F.explode(scores)).select("pair_a", "pair_b", "horizon_days", "_s.*")
    return with_status(rows)


def outlook_fan(scores: DataFrame, steps: Sequence[tuple[int, str, float]] = FAN_STEPS, drift: Column | None = None) -> DataFrame:
    """Projected path of each escalation score with widening bands and a baseline."""
    points = F.array(
        *[F.struct(F.lit(i).alias("step"), F.lit(n).alias("horizon"), F.lit(f).alias("factor")) for i, n, f in steps]
    )
    rows = scores.filter(F.col("domain") == "escalation").withColumn("_p", F.explode(points)).select("*", "_p.*")
    raw = F.col("score") + F.col("factor") * 8 + (drift if drift is not None else F.lit(0.0))
    risk = round_half_up(F.least(F.lit(98.0), F.greatest(F.lit(20.0), raw)))
    return rows.withColumn("risk", risk).select(
        "pair_a",
        "pair_b",
        "horizon_days",
        "step",
        "horizon",
        "risk",
        F.least(F.lit(100), F.col("risk") + 7 + 2 * F.col("step")).alias("upper"),
        F.greatest(F.lit(10), F.col("risk") - 6 - 2 * F.col("step")).alias("lower"),
        F.greatest(F.lit(25), F.col("risk") - 12).alias("baseline"),
    )


def outlook_drivers(scores: DataFrame, domains: Sequence[str] = tuple(d for d, _ in DRIVER_THRESHOLDS)) -> DataFrame:
    """High or medium impact of each chosen domain that can drive a pair."""
    impact = F.lit(None).cast("string")
    for domain, high in DRIVER_THRESHOLDS:
        impact = F.when(F.col("domain") == domain, F.when(F.col("score") >= high, "high").otherwise("medium")).otherwise(impact)
    wanted = F.array(*[F.lit(d) for d in domains])
    return scores.filter(F.array_contains(wanted, F.col("domain"))).withColumn("impact", impact)


# --- factor stress ------------------------------------------------------------------------


def factor_stress(shocks: DataFrame) -> DataFrame:
    """Expected return, downside and upside probability and level under (gpr, oil, gold, fx) shocks."""
    effects = {f: F.col(f) * F.lit(on_return) for f, on_return, _ in STRESS_SENSITIVITIES}
    net = sum(effects.values(), F.lit(STRESS_BASE_RETURN))
    low, high = STRESS_DOWNSIDE_RANGE
    added = sum((F.col(f) * F.lit(s) for f, _, s in STRESS_SENSITIVITIES), F.lit(STRESS_BASE_DOWNSIDE))
    downside = F.least(F.lit(high), F.greatest(F.lit(low), added))
    level = STRESS_BASE_LEVEL * (1 + net / 100)
    return shocks.select(
        "*",
        F.round(net, 2).alias("net_return_forecast"),
        F.round(downside, 1).alias("downside_probability"),
        F.round(100 - downside, 1).alias("upside_probability"),
        round_half_up(level).alias("projected_level"),
        round_half_up(level - STRESS_BASE_LEVEL).alias("point_change"),
        *[F.round(effect, 2).alias(f"{f}_impact") for f, effect in effects.items()],
    )
