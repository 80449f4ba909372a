"""Travel-mode model: class weights, random forest, evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES

LABELS = ("transport", "walk", "bike")
TREES, DEPTH, SEED = (100, 150), (10, 15), 42


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, n, weight): all rows over the number of labels times the label's rows."""
    counts = label_counts(rows)
    # one row
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def weighted(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows with ``weight`` of their label (1 for a label without)."""
    return rows.join(weights.select("label", "weight"), "label", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def split(rows: DataFrame, test: float = 0.2, by_user: bool = True, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows: whole users by a hash, as windows overlap, or rows at random."""
    if not by_user:
        return tuple(rows.randomSplit([1 - test, test], seed))
    share = F.pmod(F.xxhash64("user_id", F.lit(seed)), F.lit(1000)) < round(1000 * test)
    return rows.filter(~share), rows.filter(share)


def pipeline(trees: int = 100, depth: int = 15, labels: tuple[str, ...] | None = None) -> Pipeline:
    """Label indexing (an unseen label keeps an index of its own), assembly, weighted forest, names."""
    indexer = StringIndexer(inputCol="label", outputCol="label_index", handleInvalid="keep")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(labelCol="label_index", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED, cacheNodeIds=True)
    return Pipeline(stages=[indexer, assembler, forest])


def train(rows: DataFrame, trees: int = 100, depth: int = 15) -> PipelineModel:
    """rows: FEATURES, label, weight; read once per level of the trees, so store them first.

    Rows are dealt to a task a core: few bytes but much work, so by number and not by size.
    """
    return pipeline(trees, depth).fit(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism))


def tune(rows: DataFrame, trees: tuple[int, ...] = TREES, depths: tuple[int, ...] = DEPTH, folds: int = 3) -> CrossValidatorModel:
    """Grid search by cross-validated F1."""
    stages = pipeline()
    forest = stages.getStages()[-1]
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).build()
    judge = MulticlassClassificationEvaluator(labelCol="label_index", predictionCol="prediction", metricName="f1")
    return CrossValidator(estimator=stages, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=SEED).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with ``predicted``, the label's name (works on a stream of features as well)."""
    names = [*model.stages[0].labels, "unknown"]
    source = rows if "label" in rows.columns else rows.withColumn("label", F.lit(None).cast("string"))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=names).transform(model.transform(source))
    return named.select(*rows.columns, "predicted")


def confusion(predictions: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """A row for each actual label, a column for each predicted one."""
    table = predictions.groupBy(F.col("label").alias("actual")).pivot("predicted", list(labels)).count()
    return table.na.fill(0)


def metrics(predictions: DataFrame) -> DataFrame:
    """One row: accuracy and F1 weighted by the labels' rows."""
    cells = predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    by_label = cells.groupBy(F.col("label").alias("name")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    by_prediction = cells.groupBy(F.col("predicted").alias("name")).agg(F.sum("n").alias("guessed"))
    joined = by_label.join(by_prediction, "name", "left")
    # 2PR/(P+R) in counts
    f1 = 2 * F.col("hit") / (F.col("actual") + F.coalesce("guessed", F.lit(0)))
    return joined.agg((F.sum("hit") / F.sum("actual")).alias("accuracy"), (F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("f1"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def save_report(predictions: DataFrame, path: str) -> None:
    """Metrics and confusion as CSV folders."""
    metrics(predictions).write.mode("overwrite").csv(f"{path}/metrics", header=True)
    confusion(predictions).write.mode("overwrite").csv(f"{path}/confusion", header=True)
