"""Scaling, classifiers, cross-validation, importances and scoring."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.operators import boosted_trees, evaluate, network, relations
from tradewake.session import cut_lineage

LABEL = "won"
SEED = 42
# Stands for a value that is not there; all features but durations are non-negative.
MISSING = -1.0

# Settings of the classifiers.
LOGISTIC = {"penalty_c": 1.0, "iterations": 1000}
FOREST = {"trees": 100, "depth": 10, "features_per_split": "3"}
FOREST_SAMPLE = 100_000
BOOSTED = {"rounds": 300, "rate": 0.02, "depth": 8, "row_share": 0.8, "column_share": 0.8}
BOOSTED_SEGMENT = {"rounds": 50, "rate": 0.05, "depth": 5, "row_share": 0.7, "column_share": 0.8, "bins": 128}
# Rounds or epochs without a gain after which training ends.
PATIENCE = {"boosted": 10, "network": 7}
NETWORK = {"hidden": (64, 32, 16), "rounds": 75}
DECISION_THRESHOLD, CONFIDENT, LIVE_THRESHOLD = 0.5, 0.7, 0.8


# --------------------------------------------------------------------------- scaling


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; a constant column is only centred."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).first()
        means = tuple(row[f"m_{c}"] or 0.0 for c in columns)
        return cls(tuple(columns), means, tuple(row[f"s_{c}"] or 1.0 for c in columns))

    def scaled(self, column: str) -> Column:
        i = self.columns.index(column)
        return (F.col(column).cast("double") - self.means[i]) / self.deviations[i]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.columns})


def pca_2d(scaled: DataFrame, columns: Sequence[str], key: str) -> tuple[DataFrame, list[float]]:
    """Two principal components per row and the variance each explains; signs are arbitrary."""
    assembled = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(scaled)
    model = PCA(k=2, inputCol="_v", outputCol="_pc").fit(assembled)
    parts = vector_to_array("_pc")
    out = model.transform(assembled).select(key, parts[0].alias("pc1"), parts[1].alias("pc2"))
    return out, [float(x) for x in model.explainedVariance]


# --------------------------------------------------------------------------- matrix


# Rows per partition of those that tree ensembles are fitted on: rounds are sequential, so a partition should hold
# enough work to outweigh its scheduling.
ROWS_PER_PART = 50_000


def fitting_rows(train: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """The training rows in partitions of a fitting size, written out; with ``most`` about that many of them at most, by a hash of the key."""
    rows = train.count()
    chosen, taken = train, rows
    if most is not None and rows > most:
        chosen, taken = train.where(F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(2**31)) < int(2**31 * most / rows)), most
    return cut_lineage(chosen.repartition(max(1, -(-taken // ROWS_PER_PART)), key))


def model_inputs(features: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric, gap-free inputs with the label; rows without a label drop out."""
    types = dict(features.dtypes)

    def number(c: str) -> Column:
        if c == "role" and types[c] == "string":
            return (F.col(c) == "taker").cast("double")
        return F.coalesce(F.col(c).cast("double"), F.lit(MISSING))

    extra = [c for c in keep if c not in columns]
    numbers = [number(c).alias(c) for c in columns]
    return features.where(F.col(LABEL).isNotNull()).select(*extra, *numbers, F.col(LABEL).cast("double").alias(LABEL))


@dataclass(frozen=True)
class Classifier:
    """A fitted classifier over named columns."""

    model: PipelineModel
    columns: tuple[str, ...]
    scaler: Scaler | None = None

    @property
    def estimator(self):
        return self.model.stages[-1]

    def score(self, inputs: DataFrame, probability: str = "predicted_prob", predicted: str = "predicted",
              threshold: float = DECISION_THRESHOLD) -> DataFrame:
        """Add the win probability and the decision; works on batch and streaming frames."""
        ready = inputs
        if self.scaler is not None:
            ready = inputs.withColumns({f"_x_{c}": self.scaler.scaled(c) for c in self.columns})
        out = self.model.transform(ready)
        p = vector_to_array("_probability")[1]
        out = out.withColumn(probability, p).withColumn(predicted, (F.col(probability) >= threshold).cast("int"))
        return out.drop("_features", "_raw", "_probability", "_prediction", *[f"_x_{c}" for c in self.columns])

    def save(self, path: str) -> None:
        """Model, column list and scaler together."""
        self.model.write().overwrite().save(f"{path}/model")
        means, deviations = (self.scaler.means, self.scaler.deviations) if self.scaler else ((), ())
        frame = SparkSession.active().createDataFrame([(list(self.columns), list(means), list(deviations))], _BUNDLE)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


_BUNDLE = "columns array<string>, means array<double>, deviations array<double>"


def load_classifier(path: str) -> Classifier:
    """A classifier as it was saved."""
    row = SparkSession.active().read.schema(_BUNDLE).parquet(f"{path}/columns").first()
    scaler = Scaler(tuple(row["columns"]), tuple(row["means"]), tuple(row["deviations"])) if row["means"] else None
    return Classifier(PipelineModel.load(f"{path}/model"), tuple(row["columns"]), scaler)


def _fit(train: DataFrame, columns: Sequence[str], estimator, scaler: Scaler | None = None) -> Classifier:
    names = [f"_x_{c}" for c in columns] if scaler else list(columns)
    ready = train.withColumns({f"_x_{c}": scaler.scaled(c) for c in columns}) if scaler else train
    assembler = VectorAssembler(inputCols=names, outputCol="_features")
    named = estimator.setFeaturesCol("_features").setLabelCol(LABEL)
    named = named.setPredictionCol("_prediction").setProbabilityCol("_probability").setRawPredictionCol("_raw")
    fitted = named.fit(assembler.transform(ready))
    return Classifier(PipelineModel([assembler, fitted]), tuple(columns), scaler)


def fit_logistic(train: DataFrame, columns: Sequence[str], penalty_c: float = 1.0, iterations: int = 1000) -> Classifier:
    """L2 logistic regression on standardised columns; the penalty is per data set, hence 1 / (C n)."""
    scaler = Scaler.fit(train, columns)
    estimator = LogisticRegression(
        maxIter=iterations, regParam=1.0 / (penalty_c * max(train.count(), 1)), elasticNetParam=0.0, standardization=False
    )
    return _fit(train, columns, estimator, scaler)


def fit_forest(train: DataFrame, columns: Sequence[str], trees: int = 100, depth: int = 10, features_per_split: str = "3") -> Classifier:
    estimator = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy=features_per_split, seed=SEED)
    return _fit(train, columns, estimator)


def stop_round(losses: Sequence[float], patience: int) -> int:
    """Rounds to keep: those up to the best loss, looking no further once ``patience`` rounds brought nothing better."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def holdout_losses(classifier: Classifier, rows: DataFrame) -> list[float]:
    """Loss on the rows after each round of a boosted classifier."""
    ready = classifier.model.stages[0].transform(rows)
    # The evaluation reads the columns by their default names.
    return list(classifier.estimator.evaluateEachIteration(ready.select(F.col(LABEL).alias("label"), F.col("_features").alias("features"), LABEL, "_features")))


def fit_boosted(
    train: DataFrame, columns: Sequence[str], rounds: int = 300, rate: float = 0.02, depth: int = 8, row_share: float = 0.8,
    column_share: float = 0.8, bins: int = 32, holdout: str | None = None, patience: int = PATIENCE["boosted"],
) -> Classifier:
    """Boosted trees; ``holdout`` names a boolean column whose rows decide which rounds are kept.

    Rounds are fitted on the other rows; the ensemble ends with its best round on the holdout, where ``patience`` rounds
    without a gain end the search.
    """
    names = {"featuresCol": "_features", "labelCol": LABEL, "predictionCol": "_prediction", "probabilityCol": "_probability", "rawPredictionCol": "_raw"}
    fitted = boosted_trees.fit(train, columns, LABEL, holdout, rounds, rate, depth, row_share, column_share, bins, SEED, patience, names)
    return Classifier(PipelineModel([VectorAssembler(inputCols=list(columns), outputCol="_features"), fitted]), tuple(columns))


def log_loss(scored: DataFrame, probability: str = "predicted_prob") -> float:
    p = F.greatest(F.least(F.col(probability), F.lit(1 - 1e-15)), F.lit(1e-15))
    return scored.agg(F.avg(-F.when(F.col(LABEL) == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def fit_network(train: DataFrame, columns: Sequence[str], hidden: Sequence[int] = (64, 32, 16), rounds: int = 75, holdout: str | None = None,
                patience: int = PATIENCE["network"], epoch: int = 5) -> Classifier:
    """Feed-forward network on standardised columns; with a holdout, as ``fit_network_epochs`` does."""
    if holdout is not None:
        return fit_network_epochs(train, columns, holdout, hidden, rounds, patience, epoch)[0]
    estimator = MultilayerPerceptronClassifier(layers=[len(columns), *hidden, 2], maxIter=rounds, seed=SEED, solver="l-bfgs")
    return _fit(train, columns, estimator, Scaler.fit(train, columns))


def fit_network_epochs(train: DataFrame, columns: Sequence[str], holdout: str, hidden: Sequence[int] = (64, 32, 16), rounds: int = 75,
                       patience: int = PATIENCE["network"], epoch: int = 5) -> tuple[Classifier, list[float]]:
    """The network of the best epoch, and the holdout's loss after each.

    An epoch is a few rounds that start from the weights of the one before; training ends after ``patience`` epochs without a gain, or
    when the rounds are used up.
    """
    own, held = cut_lineage(train.where(~F.col(holdout))), cut_lineage(train.where(holdout))
    scaler, sizes = Scaler.fit(own, columns), [len(columns), *hidden, 2]
    fitted, shown = (network.blocks(rows, [scaler.scaled(c) for c in columns], F.col(LABEL)) for rows in (own, held))
    value = network.loss_and_gradient(fitted, sizes)
    start = _network(train.sparkSession, columns, sizes, scaler)
    weights = start.estimator.weights.toArray()
    best, losses = weights, []
    for _ in range(-(-rounds // epoch)):
        weights = network.lbfgs(value, weights, epoch)
        loss = network.loss(shown, weights, sizes)
        losses.append(float("inf") if loss is None else loss)
        if len(losses) == 1 or losses[-1] < min(losses[:-1]):
            best = weights
        if len(losses) - 1 - losses.index(min(losses)) >= patience:
            break
    fitted.unpersist()
    shown.unpersist()
    return _network(train.sparkSession, columns, sizes, scaler, best), losses


def _network(spark: SparkSession, columns: Sequence[str], sizes: Sequence[int], scaler: Scaler, weights=None) -> Classifier:
    """Spark's network with the given weights, else with those it starts from: no rounds, on one made-up row."""
    estimator = MultilayerPerceptronClassifier(layers=list(sizes), maxIter=0, seed=SEED, solver="l-bfgs")
    if weights is not None:
        estimator = estimator.setInitialWeights(Vectors.dense(weights))
    row = spark.createDataFrame([(*[0.0] * len(columns), 0.0)], ", ".join(f"`{c}` double" for c in (*columns, LABEL)))
    return _fit(row, columns, estimator, scaler)


# --------------------------------------------------------------------------- reading a model


def ranked_weights(classifier: Classifier):
    """Coefficients of a logistic regression, largest first."""
    weights = zip(classifier.columns, classifier.estimator.coefficients.toArray().tolist(), strict=True)
    return sorted(weights, key=lambda w: -w[1])


def importances(classifier: Classifier):
    """Normalised gain and number of splits per column of a tree ensemble."""
    gain = classifier.estimator.featureImportances.toArray().tolist()
    splits: Counter[int] = Counter()
    for tree in classifier.estimator.trees:
        splits.update(int(i) for i in re.findall(r"If \(feature (\d+) ", tree.toDebugString))
    # A cut ensemble lists the gains up to the last column it splits on.
    gain += [0.0] * (len(classifier.columns) - len(gain))
    rows = [(c, gain[i], splits.get(i, 0)) for i, c in enumerate(classifier.columns)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


# --------------------------------------------------------------------------- using models


Fit = Callable[[DataFrame, Sequence[str]], Classifier]
# Fits that run at the same time: a round of one leaves cores idle between its stages.
FITS_AT_ONCE = 4


def fit_all(fit: Fit, work: Sequence[tuple[DataFrame, Sequence[str]]]) -> list[Classifier]:
    """A model for each pair of training rows and columns, several at a time."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        # Each with local properties of its own.
        waiting = [pool.submit(inheritable_thread_target(train.sparkSession)(fit), train, columns) for train, columns in work]
        return [w.result() for w in waiting]


def out_of_fold(inputs: DataFrame, columns: Sequence[str], fit: Fit, k: int = 5) -> DataFrame:
    """Each row scored by the model that did not see its ``fold``."""
    fitted = fit_all(fit, [(inputs.where(F.col("fold") != fold), columns) for fold in range(k)])
    return reduce(DataFrame.unionByName, [model.score(inputs.where(F.col("fold") == fold)) for fold, model in enumerate(fitted)])


def fold_scores(out_of_fold_rows: DataFrame) -> DataFrame:
    """Accuracy per fold."""
    return evaluate.accuracy_by(out_of_fold_rows, ["fold"])


@dataclass(frozen=True)
class SegmentModels:
    """Models of one segment; the noise segment carries a previous version as well."""

    current: Classifier
    previous: Classifier | None = None


def score_by_segment(inputs: DataFrame, models: dict[int, SegmentModels], segment: str = "category") -> DataFrame:
    """Score each segment with its own models and put the rows together again."""
    parts = []
    for value, entry in sorted(models.items()):
        rows = entry.current.score(inputs.where(F.col(segment) == value), "probability_new", "prediction", LIVE_THRESHOLD)
        if entry.previous is not None:
            rows = entry.previous.score(rows, "probability_old", "predictionold", LIVE_THRESHOLD)
        parts.append(rows)
    return relations.union_all(*parts)


def backtest(scored: DataFrame, more_than: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Buy every predicted win: portfolio summary and per-bucket table."""
    taken = F.col("predicted") == 1
    if more_than is not None:
        taken = taken & (F.col("predicted_prob") > more_than)
    return evaluate.portfolio_summary(scored, more_than=more_than), evaluate.price_bucket_summary(scored.where(taken))
