"""Training: feature weights, folds and content models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_weights(examples: DataFrame, features: list[str], label: str = "label", regularisation: float = 0.0, rounds: int = 100) -> tuple[list[float], float]:
    """Weights and intercept of a logistic model of ``label`` (0 or 1), fitted by Spark over all examples."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(examples.select(*features, F.col(label).cast("double").alias("_y")))
    fitted = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=regularisation, maxIter=rounds, standardization=False).fit(rows)
    return [float(w) for w in fitted.coefficients], float(fitted.intercept)


def folds(examples: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """``examples`` with ``fold``, by a hash of the key: no sort, and a key keeps its fold as data grow."""
    return examples.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))


def best_parameters(scores: DataFrame, by: str = "parameters", score: str = "score") -> DataFrame:
    """The parameters of the best mean score over folds."""
    return scores.groupBy(by).agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("folds")).orderBy(F.desc("mean"), by).limit(1)


def content_clusters(counts: DataFrame, k: int, rounds: int = 20, seed: int = 1) -> DataFrame:
    """EM over k-mer counts (``seq, kmer, n``): ``seq, cluster, prob`` of the likeliest of ``k`` content models.

    Models are tables of the size of the k-mer alphabet; every round is one pass over the counts.
    """
    import math
    import random

    kmers = [r["kmer"] for r in counts.select("kmer").distinct().orderBy("kmer").collect()]
    rng = random.Random(seed)
    spark = counts.sparkSession
    mixture = [1 / k] * k
    models = [{x: 1 + rng.random() for x in kmers} for _ in range(k)]
    resp = None
    for _ in range(rounds):
        totals = [math.log(sum(m.values())) for m in models]
        rows = [(x, [math.log(m[x]) - t for m, t in zip(models, totals, strict=True)]) for x in kmers]
        table = F.broadcast(spark.createDataFrame(rows, "kmer string, logs array<double>"))
        sums = counts.join(table, "kmer").groupBy("seq").agg(*[F.sum(F.col("n") * F.get("logs", F.lit(i))).alias(f"_{i}") for i in range(k)])
        logs = [F.col(f"_{i}") + math.log(max(mixture[i], 1e-12)) for i in range(k)]
        top = F.greatest(*logs) if k > 1 else logs[0]
        odds = [F.exp(x - top) for x in logs]
        total = sum(odds[1:], odds[0])
        resp = sums.select("seq", F.array(*[o / total for o in odds]).alias("r"))
        weighed = counts.join(resp, "seq").groupBy("kmer").agg(*[F.sum(F.col("n") * F.get("r", F.lit(i))).alias(f"_{i}") for i in range(k)]).collect()
        share = resp.agg(*[F.avg(F.get("r", F.lit(i))).alias(f"_{i}") for i in range(k)]).first()
        models = [{r["kmer"]: r[f"_{i}"] + 0.1 for r in weighed} for i in range(k)]
        mixture = [share[f"_{i}"] for i in range(k)]
    best = F.array_max("r")
    return resp.select("seq", (F.array_position("r", best) - 1).cast("int").alias("cluster"), best.alias("prob"))
