"""What scoring consists of, as pipeline stages that are saved and loaded by `PipelineModel`.

Stages pass rows on with all their columns. They read `id` and `vec` (features, null where missing) and
add `prob` (a share for each class), then `pred` and `confidence`. Small values are params; trees,
training rows and isotonic models are tables or models beside a stage's metadata.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decision, prep
from ..sources.scratch import shared_dir
from . import trees


def normalised(weights: Column) -> Column:
    """Weights as shares; equal ones where all are 0."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(weights)))


def with_vector(df: DataFrame, column: str = "vec") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column)))


def _literals(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


# Saving and loading --------------------------------------------------------------------------------


class _Writer(MLWriter):
    def __init__(self, stage: Stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.save_parts(f"{path}/parts", self.sparkSession)


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Stage:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.load_parts(f"{path}/parts", self.sparkSession)
        return stage


class Stage(Transformer, MLWritable, MLReadable):
    """A transformer of which the params, and the parts that a subclass names, survive saving."""

    def __init__(self, **values):
        super().__init__()
        self._set(**values)

    def save_parts(self, path: str, spark: SparkSession) -> None:
        """Write what isn't a param below path."""

    def load_parts(self, path: str, spark: SparkSession) -> None:
        """Read what save_parts() wrote."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


# Preparation ---------------------------------------------------------------------------------------


class Vectors(Stage):
    """id as text, and vec from the input columns; raises where one is missing."""

    columns = Param(Params._dummy(), "columns", "feature columns, in order", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "the column that the model learnt", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.getOrDefault("columns")
        prep.require_columns(df, names)
        return df.withColumns({"id": F.col("id").cast("string"), "vec": F.array(*[F.col(c).cast("double") for c in names])})


class Imputed(Stage):
    """Features that are null become the training rows' medians."""

    medians = Param(Params._dummy(), "medians", "a median for each feature", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("vec", F.zip_with("vec", _literals(self.getOrDefault("medians")), lambda x, m: F.coalesce(x, m)))


class Selected(Stage):
    """Some features only."""

    places = Param(Params._dummy(), "places", "places of the features that stay", TypeConverters.toListInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("vec", F.transform(_literals(self.getOrDefault("places")), lambda i: F.get("vec", i)))


class Scaled(Stage):
    """Features less their mean, by their deviation."""

    means = Param(Params._dummy(), "means", "a mean for each feature", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "a deviation for each feature, not 0", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        centred = F.zip_with("vec", _literals(self.getOrDefault("means")), lambda x, m: x - m)
        return df.withColumn("vec", F.zip_with(centred, _literals(self.getOrDefault("deviations")), lambda x, s: x / s))


# Models --------------------------------------------------------------------------------------------


class OneClass(Stage):
    """The only class of the training rows is sure."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prob", F.array(F.lit(1.0)))


class Forest(Stage):
    """Bagged trees of the built-in kind. Rows go through their nodes in batches: the built-in way takes ten times as long a row."""

    def __init__(self, model: RandomForestClassificationModel | None = None):
        super().__init__()
        self.model, self.grown = model, None

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.grown is None:
            path = f"{shared_dir(df.sparkSession)}/forest-{uuid.uuid4().hex}"
            self.model.write().save(path)
            self.grown = trees.saved_forest(df.sparkSession, path, self.model.numClasses)
        return trees.forest_probabilities(df, self.grown)

    def save_parts(self, path: str, spark: SparkSession) -> None:
        self.model.write().overwrite().save(path)

    def load_parts(self, path: str, spark: SparkSession) -> None:
        self.model = RandomForestClassificationModel.load(path)


class Grown(Stage):
    """Extra trees or class-balanced trees."""

    def __init__(self, model: trees.Trees | None = None):
        super().__init__()
        self.model = model

    def _transform(self, df: DataFrame) -> DataFrame:
        return trees.forest_probabilities(df, self.model)

    def save_parts(self, path: str, spark: SparkSession) -> None:
        self.model.frame(spark).write.mode("overwrite").parquet(path)

    def load_parts(self, path: str, spark: SparkSession) -> None:
        self.model = trees.Trees.read(spark.read.parquet(path))


class Boosted(Stage):
    """Trees that were boosted for all classes together."""

    base = Param(Params._dummy(), "base", "where each class starts", TypeConverters.toListFloat)
    step = Param(Params._dummy(), "step", "the weight of a tree", TypeConverters.toFloat)

    def __init__(self, model: trees.Boosting | None = None):
        super().__init__()
        self.model = model
        if model:
            self._set(base=model.base.tolist(), step=model.step)

    def _transform(self, df: DataFrame) -> DataFrame:
        return trees.boosting_probabilities(df, self.model)

    def save_parts(self, path: str, spark: SparkSession) -> None:
        self.model.trees.frame(spark).write.mode("overwrite").parquet(path)

    def load_parts(self, path: str, spark: SparkSession) -> None:
        grown = trees.Trees.read(spark.read.parquet(path))
        self.model = trees.Boosting(np.array(self.getOrDefault("base")), self.getOrDefault("step"), grown)


class Bayes(Stage):
    """Gaussian naive Bayes, from one row for each class."""

    classes = Param(Params._dummy(), "classes", "prior, means and variances of each class")

    def _transform(self, df: DataFrame) -> DataFrame:
        terms = F.array(*[t for _, t in prep.gnb_log_likelihoods(self.getOrDefault("classes"), F.col("vec"))])
        out = df.withColumn("_l", terms)
        return out.withColumn("prob", normalised(F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))).drop("_l")


class Neighbours(Stage):
    """k nearest training rows, weighted by inverse distance. Rows are told apart by id."""

    k = Param(Params._dummy(), "k", "training rows that vote", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    def __init__(self, train: DataFrame | None = None, **values):
        super().__init__(**values)
        self.train = train

    def _transform(self, df: DataFrame) -> DataFrame:
        found = prep.knn_probabilities(self.train, df.select("id", "vec"), self.getOrDefault("k"), self.getOrDefault("classes"))
        return df.join(found.select(F.col("q_id").alias("id"), "prob"), "id")

    def save_parts(self, path: str, spark: SparkSession) -> None:
        self.train.write.mode("overwrite").parquet(path)

    def load_parts(self, path: str, spark: SparkSession) -> None:
        self.train = spark.read.parquet(path)


# Calibration ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Sigmoid:
    """1 / (1 + exp(a * p + b))."""

    a: float
    b: float

    def column(self, p: Column) -> Column:
        return 1 / (1 + F.exp(F.least(F.greatest(self.a * p + self.b, F.lit(-700.0)), F.lit(700.0))))


class Calibrated(Stage):
    """prob as calibrated probabilities, which are shares again: one calibrator a class (two classes: for the second)."""

    slopes = Param(Params._dummy(), "slopes", "a of each class's sigmoid; none: isotonic", TypeConverters.toListFloat)
    shifts = Param(Params._dummy(), "shifts", "b of each class's sigmoid; none: isotonic", TypeConverters.toListFloat)
    count = Param(Params._dummy(), "count", "number of calibrators", TypeConverters.toInt)

    def __init__(self, models: list | None = None):
        super().__init__()
        self.models = models or []
        curves = [m for m in self.models if isinstance(m, Sigmoid)]
        self._set(slopes=[m.a for m in curves], shifts=[m.b for m in curves], count=len(self.models))

    def _transform(self, df: DataFrame) -> DataFrame:
        out, two = df, len(self.models) == 1
        for i, m in enumerate(self.models):
            p = F.col("prob")[1 if two else i]
            if isinstance(m, Sigmoid):
                out = out.withColumn(f"_c{i}", m.column(p))
            else:
                out = m.transform(out.withColumn("features", array_to_vector(F.array(p)))).withColumn(f"_c{i}", F.col("prediction")).drop("features", "prediction")
        prob = F.array(1 - F.col("_c0"), F.col("_c0")) if two else normalised(F.array(*[F.col(f"_c{i}") for i in range(len(self.models))]))
        return out.withColumn("prob", prob).select(*df.columns)

    def save_parts(self, path: str, spark: SparkSession) -> None:
        for i, m in enumerate(self.models):
            if not isinstance(m, Sigmoid):
                m.write().overwrite().save(f"{path}/{i}")

    def load_parts(self, path: str, spark: SparkSession) -> None:
        curves = zip(self.getOrDefault("slopes"), self.getOrDefault("shifts"), strict=True)
        self.models = [Sigmoid(a, b) for a, b in curves] or [IsotonicRegressionModel.load(f"{path}/{i}") for i in range(self.getOrDefault("count"))]


# Decisions -----------------------------------------------------------------------------------------


class Decided(Stage):
    """pred, the class decided on, and confidence, its probability: by the threshold on the second class where there is one, else the likeliest."""

    classes = Param(Params._dummy(), "classes", "classes in the order of prob", TypeConverters.toListInt)
    threshold = Param(Params._dummy(), "threshold", "least probability of the second class", TypeConverters.toFloat)

    def __init__(self, classes: list[int] | None = None, threshold: float | None = None):
        super().__init__(**{k: v for k, v in (("classes", classes), ("threshold", threshold)) if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        place = F.array_position("prob", F.array_max("prob")).cast("int") - 1
        if self.isSet("threshold"):
            place = F.when(F.col("prob")[1] >= self.getOrDefault("threshold"), 1).otherwise(0)
        out = df.withColumn("_i", place)
        return out.withColumns({"pred": F.get(_literals(self.getOrDefault("classes")), F.col("_i")), "confidence": F.get("prob", F.col("_i"))}).drop("_i")


class Told(Stage):
    """pred_label for pred, proba_<label> for prob (null: unknown to the model), and decision_threshold."""

    classes = Param(Params._dummy(), "classes", "classes in the order of prob", TypeConverters.toListInt)
    labels = Param(Params._dummy(), "labels", "labels that get a column", TypeConverters.toListInt)
    threshold = Param(Params._dummy(), "threshold", "the threshold to tell", TypeConverters.toFloat)

    def __init__(self, classes: list[int] | None = None, labels: list[int] | None = None, threshold: float | None = None):
        super().__init__(**{k: v for k, v in (("classes", classes), ("labels", labels), ("threshold", threshold)) if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        known = self.getOrDefault("classes")
        probs = {f"proba_{c}": F.get("prob", F.lit(known.index(c))) if c in known else F.lit(None).cast("double") for c in self.getOrDefault("labels")}
        limit = F.lit(self.getOrDefault("threshold") if self.isSet("threshold") else None).cast("double")
        return df.withColumnRenamed("pred", "pred_label").withColumns({**probs, "decision_threshold": limit}).drop("prob")


class Alerts(Stage):
    """Alert states and recommendations, from labels, confidence and context."""

    notes = Param(Params._dummy(), "notes", "how the model was made")

    def _transform(self, df: DataFrame) -> DataFrame:
        return decision.alert_state(df.drop("vec"))
