"""Training, stacking, calibration and scoring with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from paircast.functions.prediction import (
    array_spread,
    confidence,
    confidence_tier,
    predicted_side,
    weighted_mean,
)
from paircast.operators.evalmetrics import with_class_weights
from paircast.operators.preparation import chronological_split, feature_columns, recency_weight
from paircast.session import cut_lineage
from paircast.sources.files import exists, once

LABEL, SCALED, WEIGHT = "home_win", "scaled", "sample_weight"

# Tuned parameters per model.
GBT_PARAMS = {"rounds": 1253, "depth": 2, "step": 0.015, "row_share": 0.776, "column_share": 0.986}
FOREST_PARAMS = {
    "trees": 500, "depth": 30, "leaf": 5, "top": 40,
    "first_trees": 200, "first_depth": 10,
}  # Spark caps the depth at 30
#: Trees of a forest that are grown in one fit, and fits at a time.
GROVE, GROVES_AT_ONCE = 50, 8
#: Rows of a partition while trees grow: every partition has counts for every open node.
GROWING_ROWS = 1 << 14
LOGISTIC_PARAMS = {"c": 0.5, "iterations": 1000}
PERCEPTRON_PARAMS = {"layers": (128, 64, 32), "iterations": 200}

Fit = Callable[[DataFrame, int, int, dict], list]


def _boosted_trees(train: DataFrame, width: int, seed: int, params: dict) -> list:
    """Boosted trees with early stopping on the newest tenth of the training rows."""
    p = GBT_PARAMS | params
    newest = train.withColumn("_validation", F.col("time_rank") > F.col("n_train") * 0.9)
    tree = GBTClassifier(
        featuresCol=SCALED, labelCol=LABEL, weightCol=WEIGHT, maxIter=p["rounds"], maxDepth=p["depth"],
        stepSize=p["step"], subsamplingRate=p["row_share"], featureSubsetStrategy=str(p["column_share"]),
        validationIndicatorCol="_validation", seed=seed,
    )
    return [tree.fit(newest)]


def _grown(rows: DataFrame, features: str, trees: int, seed: int, **settings) -> list:
    """A forest as groves: forests of GROVE trees, grown side by side.

    The levels of a forest follow each other, and one forest of all trees keeps
    a few cores busy at a time. Rows remember their node of every tree, in a
    lineage that is cut by checkpoints, so trees are not sent to tasks while
    they grow.
    """
    sizes = [GROVE] * (trees // GROVE) + [trees % GROVE] * (trees % GROVE > 0)
    n = rows.count()
    dense = rows.select(features, LABEL, WEIGHT).coalesce(max(1, -(-n // GROWING_ROWS))).persist()

    def fit(i: int):
        return RandomForestClassifier(
            featuresCol=features, labelCol=LABEL, weightCol=WEIGHT, numTrees=sizes[i], seed=seed + 1000 * i, cacheNodeIds=True, checkpointInterval=10,
            probabilityCol=f"probability_{i}", rawPredictionCol=f"rawPrediction_{i}", predictionCol=f"prediction_{i}", **settings,
        ).fit(dense)

    with ThreadPool(GROVES_AT_ONCE) as pool:
        groves = pool.map(fit, range(len(sizes)))
    dense.unpersist()
    return groves


def _importances(groves: list) -> list[float]:
    """Importances of a whole forest: each grove counts by its trees."""
    trees = sum(g.getNumTrees for g in groves)
    return [float(v) for v in sum(g.featureImportances.toArray() * (g.getNumTrees / trees) for g in groves)]


def _forest(train: DataFrame, width: int, seed: int, params: dict) -> list:
    """A first forest ranks the features, the final one uses the best of them."""
    p = FOREST_PARAMS | params
    weights = _importances(_grown(train, SCALED, p["first_trees"], seed, maxDepth=p["first_depth"]))
    best = sorted(range(width), key=lambda i: (weights[i], i), reverse=True)[: p["top"]]
    slicer = VectorSlicer(inputCol=SCALED, outputCol="best", indices=[int(i) for i in best])
    final = _grown(slicer.transform(train), "best", p["trees"], seed, maxDepth=p["depth"], minInstancesPerNode=p["leaf"], featureSubsetStrategy="sqrt")
    return [slicer, *final]


def balanced_logistic(rows: DataFrame, features: str, c: float, iterations: int, balanced: bool = True):
    """L2 logistic regression; the penalty 1 / (C * n) matches a summed loss with weight C."""
    weighted = with_class_weights(rows, LABEL) if balanced else rows.withColumn("class_weight", F.lit(1.0))
    penalty = 1.0 / (c * max(rows.count(), 1))
    return LogisticRegression(
        featuresCol=features, labelCol=LABEL, weightCol="class_weight", elasticNetParam=0.0, regParam=penalty,
        maxIter=iterations, standardization=False,
    ).fit(weighted)


def _logistic(train: DataFrame, width: int, seed: int, params: dict) -> list:
    p = LOGISTIC_PARAMS | params
    return [balanced_logistic(train, SCALED, p["c"], p["iterations"])]


def _perceptron(train: DataFrame, width: int, seed: int, params: dict) -> list:
    p = PERCEPTRON_PARAMS | params
    net = MultilayerPerceptronClassifier(
        featuresCol=SCALED, labelCol=LABEL, layers=[width, *p["layers"], 2], maxIter=p["iterations"], seed=seed
    )
    return [net.fit(train)]


# Name -> function that fits on scaled training rows and returns stages.
TRAINERS: dict[str, Fit] = {
    "boosted_trees": _boosted_trees,
    "random_forest": _forest,
    "logistic": _logistic,
    "perceptron": _perceptron,
}
ALIASES = {"rf": "random_forest", "gbt": "boosted_trees", "mlp": "perceptron"}


def register_trainer(name: str, fit: Fit) -> None:
    TRAINERS[name] = fit


def available_architectures() -> list[str]:
    return list(TRAINERS)


def trainer(name: str) -> Fit:
    key = ALIASES.get(name, name)
    if key not in TRAINERS:
        raise ValueError(f"unknown architecture {name}; available: {available_architectures()}")
    return TRAINERS[key]


def training_rows(contests: DataFrame, test_size: float = 0.2, decay: float = 1.2) -> DataFrame:
    """Split by time and weigh by recency; all numbers as doubles."""
    split = chronological_split(contests, test_size)
    weight = F.when(~F.col("is_test"), recency_weight(F.col("time_rank"), F.col("n_train"), decay))
    numeric = {c: F.col(c).cast("double") for c in [*feature_columns(contests.columns), LABEL]}
    return split.withColumn(WEIGHT, weight).withColumns(numeric)


def prepare(contests: DataFrame, test_size: float = 0.2, decay: float = 1.2) -> DataFrame:
    """The training rows, stored, since all models share them."""
    return cut_lineage(training_rows(contests, test_size, decay))


def fit_scaler(train: DataFrame, features: list[str]) -> PipelineModel:
    """Assemble and standardise by the mean and population deviation of the training rows.

    Spark's scaler divides by the sample deviation, a constant factor away; a
    constant column is only centred.
    """
    n = train.count()
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="error"),
            StandardScaler(inputCol="raw", outputCol="standard", withMean=True, withStd=True),
            ElementwiseProduct(inputCol="standard", outputCol=SCALED, scalingVec=Vectors.dense([factor] * len(features))),
        ]
    ).fit(train)


def scaled_columns(rows: DataFrame, fitted: PipelineModel, features: list[str]) -> DataFrame:
    """The features as the models see them, each in its own column."""
    scaled = fitted.transform(rows).withColumn("_values", vector_to_array(SCALED))
    return scaled.select(*[c for c in rows.columns if c not in features], *[F.col("_values")[i].alias(c) for i, c in enumerate(features)])


def train_model(train: DataFrame, features: list[str], architecture: str, seed: int = 42, params: dict | None = None) -> PipelineModel:
    """One fitted chain from raw columns to a probability."""
    fit = trainer(architecture)
    scaling = fit_scaler(train, features)
    stages = fit(scaling.transform(train), len(features), seed, params or {})
    return PipelineModel(stages=[*scaling.stages, *stages])


@dataclass
class Ensemble:
    """Fitted models of one training run."""

    architectures: list[str]
    models: list[PipelineModel]
    features: list[str]
    meta: PipelineModel | None = None
    platt: PipelineModel | None = None
    weights: list[float] | None = None
    threshold: float = 0.5
    accuracies: dict[str, float] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [f"prob_{name}" for name in self.architectures]

    def single(self, name: str) -> Ensemble:
        """Only one of the models, without stacking."""
        key = ALIASES.get(name, name)
        if key not in self.architectures:
            raise ValueError(f"model {name} not found; available: {self.architectures}")
        return Ensemble([key], [self.models[self.architectures.index(key)]], self.features)


DEFAULT_ARCHITECTURES = ["boosted_trees", "random_forest", "logistic", "perceptron"]


def _seed_of(name: str, names: list[str], seed: int) -> int:
    order = DEFAULT_ARCHITECTURES if name in DEFAULT_ARCHITECTURES else names
    return seed + order.index(name)


def train_ensemble(prepared: DataFrame, features: list[str], architectures: list[str] | None = None, seed: int = 42, params: dict | None = None) -> Ensemble:
    """All models, fitted at the same time."""
    names = [ALIASES.get(a, a) for a in architectures or DEFAULT_ARCHITECTURES]
    train = prepared.filter("not is_test")
    with ThreadPool(len(names)) as pool:
        models = pool.map(lambda name: train_model(train, features, name, _seed_of(name, names, seed), (params or {}).get(name)), names)
    return Ensemble(names, models, features)


def stored_ensemble(prepared: DataFrame, features: list[str], folder: str, architectures: list[str] | None = None, seed: int = 42, params: dict | None = None) -> Ensemble:
    """An ensemble from models stored below the folder; those that are not there yet are fitted and stored.

    The folder belongs to one table of training rows; settings name the model.
    """
    spark = prepared.sparkSession
    names = [ALIASES.get(a, a) for a in architectures or DEFAULT_ARCHITECTURES]
    train = prepared.filter("not is_test")

    def stored_model(name: str) -> PipelineModel:
        own = (params or {}).get(name)
        settings = "".join(f"-{k}-{v}" for k, v in sorted((own or {}).items()))
        fit = lambda path: train_model(train, features, name, _seed_of(name, names, seed), own).save(path)
        return PipelineModel.load(once(spark, f"{folder}/model-{name}-{seed}{settings}", fit))

    with ThreadPool(len(names)) as pool:
        return Ensemble(names, pool.map(stored_model, names), features)


def with_model_probs(rows: DataFrame, ensemble: Ensemble) -> DataFrame:
    """One probability column per model, in a single pass over the rows; those already there stay."""
    out = rows
    for column, model in zip(ensemble.columns, ensemble.models):
        if column in rows.columns:
            continue
        scored = model.transform(out)
        made = [c for c in scored.columns if c not in out.columns]
        own = [c for c in made if c.startswith("probability")]
        groves = [s.getNumTrees for s in model.stages if isinstance(s, RandomForestClassificationModel)]
        shares = [n / sum(groves) for n in groves] or [1.0]
        mean = sum((vector_to_array(c)[1] * share for c, share in zip(own, shares)), F.lit(0.0))
        out = scored.withColumn(column, mean).drop(*made)
    return out


def meta_columns(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Probabilities and their distance from a coin toss."""
    distance = {f"dist_{c}": F.abs(F.col(c) - 0.5) for c in columns}
    return rows.withColumns(distance), [*columns, *distance]


def train_stacking(ensemble: Ensemble, held_out: DataFrame, separate: bool = True, iterations: int = 1000) -> Ensemble:
    """Meta-model on held-out probabilities, then Platt calibration of its output.

    By default the calibrator gets the newer half of the held-out rows, which
    the meta-model has not seen.
    """
    scored, names = meta_columns(with_model_probs(held_out, ensemble), ensemble.columns)
    scored = cut_lineage(scored)
    middle = scored.agg(F.avg("time_rank")).first()[0]
    older, newer = F.col("time_rank") <= middle, F.col("time_rank") > middle
    meta_rows, platt_rows = (scored.filter(older), scored.filter(newer)) if separate else (scored, scored)
    assembler = VectorAssembler(inputCols=names, outputCol="meta_features")
    meta = balanced_logistic(assembler.transform(meta_rows), "meta_features", 1.0, iterations)
    ensemble.meta = PipelineModel(stages=[assembler, meta])
    stacked = _with_meta(platt_rows, ensemble.meta)
    single = VectorAssembler(inputCols=["meta_prob"], outputCol="platt_features")
    platt = balanced_logistic(single.transform(stacked), "platt_features", 1.0, iterations, balanced=False)
    ensemble.platt = PipelineModel(stages=[single, platt])
    return ensemble


def _with_meta(rows: DataFrame, meta: PipelineModel) -> DataFrame:
    made = ["meta_features", "rawPrediction", "probability", "prediction"]
    return meta.transform(rows).withColumn("meta_prob", vector_to_array("probability")[1]).drop(*made)


def with_stacked(rows: DataFrame, ensemble: Ensemble) -> DataFrame:
    """Stacked and calibrated probability, missing where there is no meta-model."""
    if ensemble.meta is None:
        return rows.withColumn("stacked_prob", F.lit(None).cast("double"))
    scored, names = meta_columns(rows, ensemble.columns)
    out = _with_meta(scored, ensemble.meta)
    if ensemble.platt is None:
        return out.withColumn("stacked_prob", F.col("meta_prob")).drop("meta_prob", *names[len(ensemble.columns):])
    made = ["platt_features", "rawPrediction", "probability", "prediction", "meta_prob", *names[len(ensemble.columns):]]
    return ensemble.platt.transform(out).withColumn("stacked_prob", vector_to_array("probability")[1]).drop(*made)


def score(rows: DataFrame, ensemble: Ensemble) -> DataFrame:
    """Ensemble view of every row: probability, agreement, winner, confidence, tier.

    The decision uses the (weighted) average; the stacked value is reported.
    """
    probs = F.array(*ensemble.columns)
    scored = with_stacked(with_model_probs(rows, ensemble), ensemble)
    return (
        scored.withColumn("home_win_prob", weighted_mean(probs, ensemble.weights))
        .withColumn("away_win_prob", 1 - F.col("home_win_prob"))
        .withColumn("prediction_std", array_spread(probs))
        .withColumn("model_agreement", 1 - F.col("prediction_std"))
        .withColumn("predicted_side", predicted_side(F.col("home_win_prob"), ensemble.threshold))
        .withColumn("confidence", confidence(F.col("home_win_prob")))
        .withColumn("tier", confidence_tier(F.col("confidence")))
    )


def feature_importance(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """Importance per feature of a tree model; one row per feature."""
    slices = [s for s in model.stages if isinstance(s, VectorSlicer)]
    used = [features[i] for i in slices[0].getIndices()] if slices else features
    trees = [s for s in model.stages if hasattr(s, "featureImportances")]
    values = _importances(trees)
    index = {name: i for i, name in enumerate(features)}
    rows = [(name, index[name], float(v)) for name, v in zip(used, values)]
    return spark.createDataFrame(rows, "feature string, feature_index int, importance double")


def save_ensemble(ensemble: Ensemble, spark: SparkSession, path: str) -> None:
    base = path.rstrip("/")
    for i, (name, model) in enumerate(zip(ensemble.architectures, ensemble.models)):
        model.write().overwrite().save(f"{base}/model_{i}_{name}")
    for name, model in (("meta", ensemble.meta), ("platt", ensemble.platt)):
        if model is not None:
            model.write().overwrite().save(f"{base}/{name}")
    summary = json.dumps(
        {"architectures": ensemble.architectures, "features": ensemble.features, "weights": ensemble.weights, "threshold": ensemble.threshold}
    )
    spark.createDataFrame([(summary,)], "summary string").coalesce(1).write.mode("overwrite").text(f"{base}/summary")


def load_ensemble(spark: SparkSession, path: str) -> Ensemble:
    """Load a saved ensemble; a model that cannot be read is left out."""
    base = path.rstrip("/")
    summary = json.loads(spark.read.text(f"{base}/summary").first()[0])
    names, models = [], []
    for i, name in enumerate(summary["architectures"]):
        try:
            models.append(PipelineModel.load(f"{base}/model_{i}_{name}"))
            names.append(name)
        except Exception as error:
            print(f"skipping model {name}: {type(error).__name__}")
    if not models:
        raise ValueError(f"no model could be loaded from {path}")
    whole = len(names) == len(summary["architectures"])
    extra = {
        part: PipelineModel.load(f"{base}/{part}") if whole and exists(spark, f"{base}/{part}") else None
        for part in ("meta", "platt")
    }
    weights = summary["weights"] if whole else None
    return Ensemble(names, models, summary["features"], weights=weights, threshold=summary["threshold"], **extra)
