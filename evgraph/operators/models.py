"""Tabular models on Spark MLlib: preprocessing, fits, scores for several slices, coefficients, calibrated heuristics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.functions import expr

CLASSIFIERS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosting": GBTClassifier}
REGRESSORS = {"linear": LinearRegression, "forest": RandomForestRegressor, "boosting": GBTRegressor}


def select_features(columns: list[str], subset: str, forbidden: tuple[str, ...] = ("future_", "label_", "heat_", "eligible_")) -> list[str]:
    """Feature columns of a subset by name: full, numeric_only, raw_counts_only or schema_only; targets never."""
    kept = [c for c in columns if not c.startswith(forbidden)]
    rules = {"full": lambda c: True, "numeric_only": lambda c: c != "pair_type", "raw_counts_only": lambda c: c.startswith(("history_", "recent_", "previous_")), "schema_only": lambda c: c == "pair_type"}
    return [c for c in kept if rules[subset](c)]


def feature_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order as doubles; one that is missing is null."""
    return df.withColumns({c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in columns})


def preprocessing(numeric: list[str], categorical: list[str]) -> list:
    """Median imputation and scaling of numbers, one-hot codes of categories with unknown ones ignored."""
    stages, inputs = [], []
    if numeric:
        filled = [f"{c}__filled" for c in numeric]
        stages += [Imputer(strategy="median", inputCols=numeric, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__numbers"), StandardScaler(withMean=True, inputCol="__numbers", outputCol="__scaled")]
        inputs.append("__scaled")
    if categorical:
        codes, hot = [f"{c}__code" for c in categorical], [f"{c}__hot" for c in categorical]
        stages += [StringIndexer(inputCols=categorical, outputCols=codes, handleInvalid="keep"), OneHotEncoder(inputCols=codes, outputCols=hot)]
        inputs += hot
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def stratified_sample(df: DataFrame, label: str, keys: list[str], most: int, seed: int = 0) -> DataFrame:
    """At most about `most` rows with the share of positives kept: each class keeps the same share in hash order."""
    share = df.agg(F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(F.count("*"), F.lit(1))).alias("share"))
    w = Window.partitionBy(label).orderBy("__u", *keys)
    u = df.withColumn("__u", expr.unit_interval(*(F.col(k) for k in keys), seed=seed))
    sized = u.groupBy(label).agg(F.count("*").alias("__n"))
    ranked = u.join(F.broadcast(sized), label).join(F.broadcast(share), F.lit(True), "left").filter(F.col("__u") <= F.least(F.lit(1.0), F.col("share") * 1.5)).withColumn("__r", F.row_number().over(w))
    return ranked.filter(F.col("__r") <= F.ceil(F.col("__n") * F.col("share"))).drop("__u", "__r", "__n", "share")


def fit(train: DataFrame, kind: str, numeric: list[str], categorical: list[str], label: str, weight: str | None = None, **params) -> PipelineModel:
    """A preprocessing and model pipeline, fitted on the training rows alone."""
    maker = (CLASSIFIERS | {f"{k}_regression": v for k, v in REGRESSORS.items()})[kind]
    options = {"featuresCol": "features", "labelCol": label} | params | ({"weightCol": weight} if weight else {})
    return Pipeline(stages=[*preprocessing(numeric, categorical), maker(**options)]).fit(train)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """A weight column under which both classes count the same."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = df.agg(F.count("*").alias("__all"))
    return df.join(F.broadcast(n), label).join(F.broadcast(total), F.lit(True), "left").withColumn("weight", F.col("__all") / (2.0 * F.col("__n"))).drop("__n", "__all")


def score(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with a score: the probability of class 1, or the prediction of a regressor."""
    out = model.transform(rows)
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*keep, value.alias("score"))


def coefficients(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """Feature, weight and size of it, largest first: coefficients of linear models, importances of trees."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    attrs = model.transform(scored.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    rows = [(names.get(i, f"feature_{i}"), float(v)) for i, v in enumerate(values.toArray())]
    spark = scored.sparkSession
    return spark.createDataFrame(rows, "feature string, coefficient double").withColumn("size", F.abs("coefficient")).orderBy(F.desc("size"), "feature")


def mean_baseline(train: DataFrame, rows: DataFrame, label: str, heat: str) -> DataFrame:
    """Every row scored with the training rows' share of positives and mean heat."""
    m = train.agg(F.avg(label).alias("score"), F.avg(heat).alias("predicted_heat"))
    return rows.join(F.broadcast(m), F.lit(True), "left")


def percentile_calibration(train: DataFrame, rows: DataFrame, value: str, target: str, bins: int = 100) -> DataFrame:
    """The mean training target of the quantile bin that each row's value falls in."""
    edges = train.agg(F.array_distinct(F.expr(f"percentile({value}, array({', '.join(str(i / bins) for i in range(1, bins))}))")).alias("edges"))

    def binned(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(edges), F.lit(True), "left").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")

    means = binned(train).groupBy("bin").agg(F.avg(target).alias("calibrated"))  # at most `bins` rows
    overall = train.agg(F.avg(target).alias("overall"))
    return binned(rows).join(F.broadcast(means), "bin", "left").join(F.broadcast(overall), F.lit(True), "left").withColumn("calibrated", F.coalesce("calibrated", "overall")).drop("overall")
