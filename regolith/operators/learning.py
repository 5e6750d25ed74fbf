"""Training tables and crater classifiers with Spark ML. A random forest stands in for trees with random split points, which Spark ML lacks."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import matching


def noise(*key: Column) -> Column:
    """A number from a normal distribution that depends on the key alone (Box-Muller on hashes), the same in any partitioning."""
    unit = lambda salt: (F.pmod(F.xxhash64(*key, F.lit(salt)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return F.sqrt(-2.0 * F.log(unit(1))) * F.cos(unit(2) * 6.283185307179586)


def jittered(circles: DataFrame, copies: int = 5, sigma: float = 0.035, seed: int = 0, id_col: str = "crater_id") -> DataFrame:
    """Each circle (copy 0) and `copies` shaken ones: centre and radius by sigma radii."""
    out = circles.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    shift = lambda salt: F.when(F.col("copy") > 0, noise(F.col(id_col), F.col("copy"), F.lit(seed * 10 + salt)) * sigma).otherwise(0.0) * F.col("r")
    moves = {c: F.col(c) + shift(n) for n, c in enumerate(("cx", "cy", "r"))}
    return out.withColumns(moves)


def training_set(labels: DataFrame, candidates: DataFrame, positives: int = 5, negatives: int = 3, seed: int = 0) -> DataFrame:
    """image_id, cx, cy, r, label, weight, origin. labels: crater_id, image_id, cx, cy, r, label, complete; candidates: det_id, image_id, cx, cy, r.

    Labels come with shaken copies. Candidates that are no labelled crater are negatives: of completely labelled images at most max(200, 24 P) with weight 1, of
    others at most max(30, 12 P) with weight 0.3, chosen by hash; P is the image's number of positives.
    """
    cols = ["image_id", "cx", "cy", "r"]
    pos = jittered(labels.where("label = 1"), positives, seed=seed).select(*cols, F.lit(1).alias("label"), F.lit(1.0).alias("weight"), F.lit("positive").alias("origin"))
    neg = jittered(labels.where("label = 0"), negatives, seed=seed).select(*cols, F.lit(0).alias("label"), F.lit(1.0).alias("weight"), F.lit("negative").alias("origin"))
    images = labels.groupBy("image_id").agg(F.count_if(F.col("label") == 1).alias("p"), F.bool_and("complete").alias("complete"))
    free = matching(candidates, labels, k=0.7, keep=False).join(images, "image_id")
    order = Window.partitionBy("image_id").orderBy(F.xxhash64("det_id", F.lit(seed)), "det_id")
    most = F.when(F.col("complete"), F.greatest(F.lit(200), 24 * F.col("p"))).otherwise(F.greatest(F.lit(30), 12 * F.col("p")))
    rest = free.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)
    rest = rest.select(*cols, F.lit(0).alias("label"), F.when(F.col("complete"), 1.0).otherwise(0.3).alias("weight"), F.lit("unlabelled").alias("origin"))
    return pos.unionByName(neg).unionByName(rest)


def train(examples: DataFrame, trees: int = 400, seed: int = 0) -> RandomForestClassificationModel:
    """examples: features (array), label, weight. At least two positives and three negatives. Weights are scaled so that both classes weigh alike."""
    n = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    if n.get(1, 0) < 2 or n.get(0, 0) < 3:
        raise ValueError("training takes at least 2 craters and 3 other places")
    whole = sum(n.values())
    examples = examples.withColumn("weight", F.col("weight") * F.when(F.col("label") == 1, whole / (2.0 * n[1])).otherwise(whole / (2.0 * n[0])))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed)
    return forest.fit(examples.withColumns({"vector": array_to_vector(F.col("features").cast("array<double>")), "label": F.col("label").cast("double")}))


def scored(model: RandomForestClassificationModel, examples: DataFrame) -> DataFrame:
    """examples with p, the probability of a crater."""
    out = model.transform(examples.withColumn("vector", array_to_vector(F.col("features").cast("array<double>"))))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def report(model_of, examples: DataFrame, folds: int | None = None, id_col: str = "det_id") -> DataFrame:
    """auc, precision and recall of p above 0.5, n and folds, over stratified folds: each is scored by a model of the others. model_of: a function of a training frame. folds: else as
    many as five, one more than a sixth of the positives, or the negatives, whichever is least. Under two folds the figures are null."""
    if folds is None:
        n = examples.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
        folds = min(5, n["p"] // 6 + 1, n["n"])
    none = F.lit(None).cast("double")
    if folds < 2:
        return examples.agg(F.count("*").alias("n")).select(none.alias("auc"), none.alias("precision"), none.alias("recall"), "n", F.lit(folds).alias("folds"))
    order = Window.partitionBy("label").orderBy(F.xxhash64(id_col), id_col)
    cut = examples.withColumn("fold", F.pmod(F.row_number().over(order), F.lit(folds)))
    parts = [scored(model_of(cut.where(F.col("fold") != k)), cut.where(F.col("fold") == k)) for k in range(folds)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    auc = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label").evaluate(every.withColumn("label", F.col("label").cast("double")))
    hit = (F.col("p") > 0.5).cast("int")
    sums = every.agg(F.sum(hit * F.col("label")).alias("tp"), F.sum(hit).alias("called"), F.sum("label").alias("real"), F.count("*").alias("n"))
    part = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 3)).otherwise(0.0)
    return sums.select(F.lit(round(auc, 3)).alias("auc"), part("tp", "called").alias("precision"), part("tp", "real").alias("recall"), "n", F.lit(folds).alias("folds"))
