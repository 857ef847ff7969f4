"""The two text classifiers, their storage, and inference with a model from outside."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from prioscope.functions.numbers import rounded
from prioscope.operators import features as X
from prioscope.operators.evaluate import class_scores, confusion
from prioscope.settings import FULL, LR_C, LR_ITERATIONS, Profile
from prioscope.sources.staging import folder_exists, fresh_path, kept


def stored(spark: SparkSession, model, name: str):
    """Write a fitted model and read it back.

    A freshly fitted model drags its training summary, and with it the session, into the
    tasks that apply it; once the session has observed a metric, that cannot be serialised.
    """
    path = fresh_path(spark, name)
    model.write().save(path)
    return type(model).load(path)


# --- first classifier: weighted n-grams and metadata -------------------------------------


@dataclass
class TextModel:
    """Fitted vocabulary, codes, moments and coefficients."""

    terms: list
    idf: list
    channels: DataFrame
    types: DataFrame
    moments: DataFrame
    regression: LogisticRegressionModel
    profile: Profile = FULL
    losses: list = field(default_factory=list)

    def with_features(self, df: DataFrame, coefficients: list | None = None) -> DataFrame:
        described = X.with_metadata(df, self.channels, self.types)
        scaled = X.standardise(described, self.moments)
        return X.text_weights(scaled, self.terms, self.idf, profile=self.profile, coefficients=coefficients)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``mismatch_probability`` and ``prediction``. One narrow pass over the table."""
        weights = self.regression.coefficients.toArray().tolist()
        words = len(self.terms)
        score = F.col("text_score") + X.meta_score(weights[words:], self.regression.intercept)
        chance = self.with_features(df, weights[:words]).withColumn("mismatch_probability", 1 / (1 + F.exp(-score)))
        return chance.select(
            *df.columns,
            "mismatch_probability",
            (F.col("mismatch_probability") >= 0.5).cast("int").alias("prediction"),
        )

    def save(self, path: str) -> None:
        spark = self.moments.sparkSession
        self.regression.write().overwrite().save(f"{path}/regression")
        self.moments.write.mode("overwrite").parquet(f"{path}/moments")
        rows = [(i, t, float(w)) for i, (t, w) in enumerate(zip(self.terms, self.idf))]
        spark.createDataFrame(rows, "i int, term string, idf double").write.mode("overwrite").parquet(f"{path}/terms")
        self.channels.write.mode("overwrite").parquet(f"{path}/channels")
        self.types.write.mode("overwrite").parquet(f"{path}/types")
        spark.createDataFrame([(self.profile.name,)], "profile string").write.mode("overwrite").parquet(f"{path}/profile")
        objective_history(self).write.mode("overwrite").parquet(f"{path}/history")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TextModel":
        from prioscope import settings

        regression = LogisticRegressionModel.load(f"{path}/regression")
        terms = spark.read.parquet(f"{path}/terms").orderBy("i").collect()
        profile = spark.read.parquet(f"{path}/profile").first()["profile"]
        history = spark.read.parquet(f"{path}/history").orderBy("round").collect()
        return TextModel(
            [r["term"] for r in terms], [r["idf"] for r in terms], spark.read.parquet(f"{path}/channels"),
            spark.read.parquet(f"{path}/types"), spark.read.parquet(f"{path}/moments"), regression,
            settings.COMPACT if profile == "compact" else settings.FULL, [r["value"] for r in history],
        )


def fit_text_model(train: DataFrame, label_col: str = "label", id_col: str = "ticket_id", profile: Profile = FULL) -> TextModel:
    """Balanced, L2-penalised logistic regression.

    Only bounded pieces reach the driver: at most 15,000 terms.
    The weighted loss is a mean over weights that sum to the row count, so a penalty of
    1 / (C * rows) equals the summed loss at C.
    """
    rows = train.count()
    documents = F.lit(float(rows))
    vocabulary = X.vocabulary(train, profile=profile)
    found = vocabulary.withColumn("idf", X.smoothed_idf(F.col("document_count"), documents)).select("term", "idf").collect()
    ordered = sorted(found, key=lambda r: r["term"])
    terms, idf = [r["term"] for r in ordered], [r["idf"] for r in ordered]
    channels, types = X.category_codes(train, "channel"), X.category_codes(train, "ticket_type")
    moments = kept(X.meta_moments(X.with_metadata(train, channels, types)), "moments")
    model = TextModel(terms, idf, channels, types, moments, None, profile)
    ready = X.with_class_weights(model.with_features(train), label_col).select(
        F.col(label_col).cast("double").alias("label"), X.feature_vector(len(terms)).alias("features"), "class_weight"
    )
    regression = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="class_weight", regParam=1.0 / (LR_C * rows),
        elasticNetParam=0.0, standardization=False, maxIter=LR_ITERATIONS, tol=1e-5, family="binomial",
    )
    fitted = regression.fit(kept(ready, "training"))
    model.losses = [float(v) for v in fitted.summary.objectiveHistory]
    model.regression = stored(train.sparkSession, fitted, "regression")
    return model


def objective_history(model: TextModel) -> DataFrame:
    rows = [(i, "train_loss", v) for i, v in enumerate(model.losses)]
    return model.moments.sparkSession.createDataFrame(rows, "round int, metric string, value double")


# --- second classifier: hashed words of the tagged string ----------------------------------

TAGGED_ITERATIONS = 50


def tagged_features(buckets: int = 1 << 16) -> Pipeline:
    return Pipeline(
        stages=[
            Tokenizer(inputCol="model_text", outputCol="_words"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=buckets),
            IDF(inputCol="_counts", outputCol="features", minDocFreq=2),
        ]
    )


def macro_f1(df: DataFrame, predicted: str = "prediction") -> float:
    return class_scores(confusion(df, "label", predicted)).first()["macro_f1"]


@dataclass
class TaggedModel:
    """The best of several fitted pipelines, with the scores of all rounds."""

    pipeline: PipelineModel
    history: list
    best: float

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.pipeline.transform(X.model_text(df))
        chance = scored.withColumn("mismatch_probability", vector_to_array("probability")[1])
        return chance.select(
            *df.columns, "mismatch_probability", F.col("prediction").cast("int").alias("prediction")
        )

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        training_history(spark, self).write.mode("overwrite").parquet(f"{path}/history")

    @staticmethod
    def load(path: str) -> "TaggedModel":
        pipeline = PipelineModel.load(f"{path}/pipeline")
        rows = SparkSession.active().read.parquet(f"{path}/history").orderBy("round", "metric").collect()
        scores = [r["value"] for r in rows if r["metric"] == "val_f1"]
        return TaggedModel(pipeline, [tuple(r) for r in rows], max(scores, default=float("nan")))


def fit_tagged_model(
    train: DataFrame, validation: DataFrame, penalties: tuple = (0.1, 0.01, 0.001, 0.0001), patience: int = 2,
    buckets: int = 1 << 16, iterations: int = TAGGED_ITERATIONS,
) -> TaggedModel:
    """Try penalties in turn, keep the best validation macro F1, stop after ``patience`` rounds without gain.

    The features do not depend on the penalty, so they are fitted and stored once. ``iterations``
    bounds each fit; the history says how many a round used.
    """
    data = X.with_class_weights(X.model_text(train)).select(
        F.col("label").cast("double").alias("label"), "model_text", "class_weight"
    )
    data = kept(data, "tagged")
    described = stored(train.sparkSession, tagged_features(buckets).fit(data), "tagged-features")
    ready = kept(described.transform(data).select("label", "features", "class_weight"), "tagged-ready")
    best, best_score, waited, history = None, 0.0, 0, []
    for i, penalty in enumerate(penalties, start=1):
        regression = LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="class_weight", regParam=penalty, maxIter=iterations
        ).fit(ready)
        loss, used = regression.summary.objectiveHistory[-1], regression.summary.totalIterations
        fitted = PipelineModel([*described.stages, stored(train.sparkSession, regression, "tagged-model")])
        score = macro_f1(TaggedModel(fitted, [], 0.0).predict(validation))
        history += [(i, "train_loss", float(loss)), (i, "val_f1", float(score)), (i, "iterations", float(used))]
        if best is None or score > best_score:
            best, best_score, waited = fitted, score, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return TaggedModel(best, history, best_score)


def training_history(spark: SparkSession, model: TaggedModel) -> DataFrame:
    return spark.createDataFrame(model.history, "round int, metric string, value double")


# --- inference ---------------------------------------------------------------------------


def predict_external(df: DataFrame, make_predict_fn, text_col: str = "model_text", batch_size: int = 32) -> DataFrame:
    """Add ``probabilities``, ``prediction`` and ``mismatch_probability`` from a user-supplied model."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    run = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    scored = df.withColumn("probabilities", run(F.col(text_col)))
    top = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return scored.withColumns(
        {
            "prediction": top.cast("int"),
            "mismatch_probability": F.col("probabilities")[1].cast("double"),
        }
    )


def with_decision(df: DataFrame) -> DataFrame:
    """Label at one half and the confidence of the chosen class."""
    p = F.col("mismatch_probability")
    flagged = p >= 0.5
    return df.withColumns(
        {
            "predicted_label": F.when(flagged, "Mismatch").otherwise("Consistent"),
            "prediction_confidence": rounded(F.when(flagged, p).otherwise(1 - p), 4),
        }
    )


def adopt_prediction(df: DataFrame) -> DataFrame:
    """Let the model's label replace the rule's, and say where the two disagree."""
    return df.withColumns(
        {
            "label_conflict": F.col("predicted_label") != F.col("mismatch_label"),
            "mismatch_label": F.col("predicted_label"),
        }
    )


def label_from_prediction(df: DataFrame, prediction_col: str = "prediction") -> DataFrame:
    name = F.when(F.col(prediction_col) == 1, "Mismatch").otherwise("Consistent")
    return df.withColumn("mismatch_label", name)


def load_model(spark: SparkSession, text_path: str, tagged_path: str | None = None, wanted: str = "baseline"):
    """(model, its name, why): the wanted model, or the first classifier if the second is not there.

    Only a missing folder leads to the first classifier; a folder that cannot be read raises its error.
    """
    if wanted == "advanced":
        if tagged_path is not None and folder_exists(spark, tagged_path):
            return TaggedModel.load(tagged_path), "advanced", ""
        return TextModel.load(spark, text_path), "baseline", f"no model at {tagged_path}"
    return TextModel.load(spark, text_path), "baseline", ""
