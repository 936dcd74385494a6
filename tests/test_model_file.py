"""Attributions against the sum over subsets; the exported file against the model it came from."""

import random
import time
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler

from fraudloom.operators import attributions as A
from fraudloom.operators import model as ML
from fraudloom.operators import onnx_file as O
from fraudloom.operators.attributions import Paths, shapley
from fraudloom.plans import catalog


def by_subsets(nodes, x):
    """Shapley values of one tree by all subsets of the features that it uses."""
    used = sorted({n["feature"] for n in nodes if "feature" in n})

    def value(known, k=0):
        n = nodes[k]
        if "feature" not in n:
            return n["value"]
        if n["feature"] in known:
            return value(known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
        a, b = nodes[n["left"]], nodes[n["right"]]
        return (a["rows"] * value(known, n["left"]) + b["rows"] * value(known, n["right"])) / (a["rows"] + b["rows"])

    m, out = len(used), np.zeros(len(x))
    cache = {frozenset(c): value(frozenset(c)) for r in range(m + 1) for c in combinations(used, r)}
    for f in used:
        rest = [u for u in used if u != f]
        for r in range(m):
            for c in combinations(rest, r):
                out[f] += factorial(r) * factorial(m - r - 1) / factorial(m) * (cache[frozenset(c) | {f}] - cache[frozenset(c)])
    return out


def grown(rng, depth, features=8):
    nodes = []

    def visit(d, rows):
        k = len(nodes)
        nodes.append({"value": rng.uniform(-1, 1), "rows": float(rows)})
        if d and rows > 1 and (d == depth or rng.random() < 0.95):
            left = rng.randint(1, rows - 1)
            nodes[k] |= {"feature": rng.randrange(features), "threshold": rng.choice([0.25, 0.5, rng.random()])}
            nodes[k]["left"] = visit(d - 1, left)
            nodes[k]["right"] = visit(d - 1, rows - left)
        return k

    visit(depth, 2000)
    return nodes


@pytest.mark.parametrize("seed,depth,short", [(1, 0, 8), (2, 1, 8), (3, 3, 8), (4, 6, 0), (5, 8, 8), (6, 8, 0)])
def test_equals_subsets(seed, depth, short, monkeypatch):
    monkeypatch.setattr(A, "SHORT", short)
    rng = random.Random(seed)
    trees = [(0.1 + k, grown(rng, depth)) for k in range(3)]
    x = np.array([[rng.choice([0.25, 0.5, rng.random()]) for _ in range(8)] for _ in range(6)])
    got = shapley([Paths.of(t, w) for w, t in trees], x)
    want = sum(w * np.array([by_subsets(t, r) for r in x]) for w, t in trees)
    assert np.abs(got - want).max() < 1e-9


def test_a_hundred_times_faster_at_depth_8():
    rng = random.Random(9)
    tree, x = grown(rng, 8), np.random.default_rng(1).random((2000, 8))
    paths = [Paths.of(tree)]
    shapley(paths, x[:50])
    t = time.perf_counter()
    shapley(paths, x)
    fast = (time.perf_counter() - t) / len(x)
    t = time.perf_counter()
    for r in x[:3]:
        by_subsets(tree, r)
    assert (time.perf_counter() - t) / 3 > 100 * fast


def test_thresholds_agree_in_32_bits():
    rng = np.random.default_rng(2)
    for t in [0.1, 1 / 3, 0.5, -0.7, 1e-30, *rng.normal(size=200)]:
        low = np.float32(O.float_below(t))
        near = [low, np.nextafter(low, np.float32(-np.inf)), np.nextafter(low, np.float32(np.inf))]
        assert [float(v) <= t for v in near] == [v <= low for v in near] == [True, True, False]


@pytest.fixture(scope="module")
def model(spark):
    """Trees whose thresholds lie at, and between, values that rows have."""
    rng = random.Random(4)
    rows = [(k, int(rng.random() < (0.9 if (f := [float(np.float32(rng.choice([0.1, 0.3, rng.random()]))) for _ in range(8)])[0] > 0.3 and f[3] < 0.6 else 0.1)), *f, f) for k in range(1500)]
    d = spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{c} double" for c in ML.COLUMNS) + ", vector array<float>").cache()
    v = VectorAssembler(inputCols=ML.COLUMNS, outputCol="vec")
    gbt = GBTClassifier(featuresCol="vec", labelCol="y", maxIter=12, maxDepth=6, seed=1)
    return PipelineModel([v, gbt.fit(v.transform(d))]), d


def test_exported_file_has_the_models_scores(spark, model, tmp_path):
    pytest.importorskip("onnxruntime")
    m, d = model
    path = str(tmp_path / "trees.onnx")
    ML.export_onnx(m, path, spark)
    rows = ML.onnx_scorer(spark, path)(d).withColumnRenamed("model_score", "exported")
    gap = max(abs(r.model_score - r.exported) for r in ML.raw_score(m, rows).collect())
    assert gap < 1e-6
    import onnxruntime

    session = onnxruntime.InferenceSession(path)
    x = np.array([r.vector for r in d.orderBy("id").limit(32).collect()], np.float32)
    got = session.run(["probabilities"], {"features": x})[0]
    want = [r.model_score for r in ML.raw_score(m, d.orderBy("id").limit(32)).orderBy("id").collect()]
    assert got.shape == (32, 2) and np.abs(got[:, 1] - want).max() < 1e-4 and np.abs(got.sum(1) - 1).max() < 1e-6


def test_a_single_leaf_can_be_written():
    pytest.importorskip("onnxruntime")
    import onnxruntime

    got = onnxruntime.InferenceSession(O.encode([(0.5, [{"value": 0.25, "rows": 9.0}])], 8)).run(None, {"features": np.zeros((3, 8), np.float32)})[0]
    assert got[:, 1] == pytest.approx([1 / (1 + np.exp(-0.25))] * 3)


def test_attributions_in_spark(spark, model):
    m, d = model
    rows = ML.shap_reasons(m, ML.attributed(m, d)).limit(40).collect()
    trees = ML.trees_of(m)
    for r in rows[:2]:
        x = np.array([r[c] for c in ML.COLUMNS])
        assert np.abs(np.array(r.attributions) - sum(w * by_subsets(t, x) for w, t in trees)).max() < 1e-9
    codes = [c for c, _ in ML.MODEL_REASONS]
    for r in rows:
        order = sorted((k for k in range(8) if r.attributions[k] > 0), key=lambda k: (-r.attributions[k], k))[:3]
        assert r.shap_reasons == [codes[k] for k in order]


def test_queries_over_events(spark, sf_dir):
    a = catalog.QUERIES["event_attributions"](spark, sf_dir)
    rows = a.collect()
    assert len(rows) == 1000 and all(len(r.attributions) == 8 for r in rows) and len({r.margin for r in rows}) > 20
    s = catalog.QUERIES["exported_scores"](spark, sf_dir).collect()
    assert len(s) == 1000 and max(abs(r.model_score - r.exported_score) for r in s) <= 1e-4
