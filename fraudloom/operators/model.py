"""Training, calibration, scoring, export with parity, reject inference and attributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.operators.attributions import Paths, shapley
from fraudloom.operators.decide import MODEL_REASONS
from fraudloom.operators.onnx_file import encode
from fraudloom.operators.windows import FEATURES

COLUMNS = [f"f_{n}" for n in FEATURES]


def split(data: DataFrame, y: str = "y", train: float = 0.7, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Stratified by label, by hash of the id, so reruns and other partitionings agree."""
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1_000_000
    return data.filter(u < train), data.filter(u >= train)


def train(data: DataFrame, y: str = "y", trees: int = 20, depth: int = 5, step: float = 0.1) -> PipelineModel:
    """Boosted trees; the rare class weighs as many times more as it is rarer."""
    n, p = data.agg(F.count("*"), F.sum(y)).first()
    w = (n - p) / max(p or 0, 1)
    d = data.withColumn("_w", F.when(F.col(y) == 1, float(w)).otherwise(1.0)).withColumn("_y", F.col(y).cast("double"))
    v = VectorAssembler(inputCols=COLUMNS, outputCol="vec")
    gbt = GBTClassifier(featuresCol="vec", labelCol="_y", weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=step, seed=5)
    return PipelineModel([v, gbt.fit(v.transform(d))])


def raw_score(model: PipelineModel, data: DataFrame, name: str = "model_score") -> DataFrame:
    d = model.transform(data)
    return d.withColumn(name, vector_to_array("probability")[1]).drop("vec", "rawPrediction", "probability", "prediction")


def calibrate(scored: DataFrame, y: str = "y", score: str = "model_score"):
    """Isotonic regression on held-out scores."""
    return IsotonicRegression(featuresCol=score, labelCol=y, predictionCol="calibrated").fit(scored.withColumn(score, F.col(score).cast("double")).withColumn(y, F.col(y).cast("double")))


def reject_inference(accepted: DataFrame, rejected: DataFrame, features: list[str] = COLUMNS, y: str = "y") -> DataFrame:
    """P(fraud) of rejected rows by a logistic regression on the accepted ones; empty if either side is."""
    n, kinds = accepted.agg(F.count("*"), F.count_distinct(y)).first()
    out = rejected.withColumn("p", F.lit(None).cast("double"))
    if not n or rejected.isEmpty():
        return out.limit(0)
    if kinds < 2:
        return out.withColumn("p", F.lit(float(accepted.first()[y])))
    v = VectorAssembler(inputCols=features, outputCol="vec")
    m = LogisticRegression(featuresCol="vec", labelCol="_y", regParam=1.0 / n, standardization=False, maxIter=200).fit(v.transform(accepted.withColumn("_y", F.col(y).cast("double"))))
    return m.transform(v.transform(rejected)).withColumn("p", vector_to_array("probability")[1]).drop("vec", "rawPrediction", "probability", "prediction")


def trees_of(model: PipelineModel) -> list[tuple[float, list[dict]]]:
    """(weight, nodes) of each tree; a node is feature, threshold, left, right, value, weight of its training rows."""
    gbt: GBTClassificationModel = model.stages[-1]
    out = []
    for w, tree in zip(gbt.treeWeights, gbt.trees):
        nodes: list[dict] = []

        def visit(n) -> int:
            k = len(nodes)
            nodes.append({"value": n.prediction(), "rows": float(n.impurityStats().count())})
            if n.subtreeDepth() > 0:
                s = n.split()
                nodes[k] |= {"feature": s.featureIndex(), "threshold": s.threshold(), "left": visit(n.leftChild()), "right": visit(n.rightChild())}
            return k

        visit(tree._call_java("rootNode"))
        out.append((float(w), nodes))
    return out


def paths_of(model: PipelineModel) -> list[Paths]:
    return [Paths.of(nodes, w) for w, nodes in trees_of(model)]


def attributed(model: PipelineModel, data: DataFrame, name: str = "attributions") -> DataFrame:
    """Adds the exact Shapley values of the eight features and `margin`, the ensemble's output that they explain: base + their sum."""
    paths = paths_of(model)
    base = sum(p.mean() for p in paths)

    @F.pandas_udf("array<double>")
    def values(*cols: pd.Series) -> pd.Series:
        return pd.Series(list(shapley(paths, np.column_stack([c.to_numpy(float) for c in cols]))))

    return data.withColumn(name, values(*COLUMNS)).withColumn("margin", F.aggregate(name, F.lit(float(base)), lambda a, v: a + v))


def shap_reasons(model: PipelineModel, data: DataFrame, top_k: int = 3) -> DataFrame:
    """Adds shap_reasons: reason codes of the features that push towards fraud, strongest first, ties in the features' order."""
    codes = F.array(*[F.lit(code) for code, _ in MODEL_REASONS])
    d = attributed(model, data, "_a")
    up = F.filter(F.transform(F.arrays_zip(F.col("_a").alias("a"), codes.alias("c")), lambda x, k: F.struct((-x["a"]).alias("a"), k.alias("k"), x["c"].alias("c"))), lambda x: x["a"] < 0)
    return d.withColumn("shap_reasons", F.transform(F.slice(F.array_sort(up), 1, top_k), lambda x: x["c"])).drop("_a", "margin")


def export(model: PipelineModel, path: str, sample: DataFrame, vectors: int = 32) -> dict:
    """Saves the model and a parity fixture: inputs and raw scores of `vectors` rows."""
    model.write().overwrite().save(path)
    rows = raw_score(model, sample.orderBy("id").limit(vectors)).select(*COLUMNS, "model_score").collect()
    return {"vectors": [[float(r[c]) for c in COLUMNS] for r in rows], "scores": [float(r.model_score) for r in rows], "tolerance": 1e-4}


def parity(spark: SparkSession, path: str, fixture: dict) -> float:
    """Largest difference between the saved model's scores and the fixture's."""
    m = PipelineModel.load(path)
    d = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(fixture["vectors"])], "id long, " + ", ".join(f"{c} double" for c in COLUMNS))
    got = [r.model_score for r in raw_score(m, d).orderBy("id").collect()]
    return max((abs(a - b) for a, b in zip(got, fixture["scores"])), default=0.0)


def export_onnx(model: PipelineModel, path: str, spark: SparkSession) -> None:
    """The trees as an ONNX file at any path Spark can write; input `features`, output `probabilities`, fraud second."""
    data = encode(trees_of(model), len(COLUMNS))
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hp.getFileSystem(spark._jsc.hadoopConfiguration()).create(hp, True)
    try:
        out.write(data)
    finally:
        out.close()


def onnx_scorer(spark: SparkSession, path: str, output: str = "probabilities"):
    """A scorer over an exported ONNX file: column 1 of its probabilities. Spark reads the file; the session is made once a task."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])  # one model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(data, options)
        name = session.get_inputs()[0].name
        for v in batches:
            x = np.stack(v.to_numpy()).astype(np.float32)
            yield pd.Series(session.run([output], {name: x})[0][:, 1].astype(float))

    return lambda df: df.withColumn("model_score", score("vector"))
