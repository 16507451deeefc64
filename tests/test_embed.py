import numpy as np
from pyspark.sql import functions as F

from folioscope.operators import embed as E


def test_pooling_invariants(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "t string, e array<float>")
    out = {r.t: r.e for r in E.mean_pool(df, "t", "e").collect()}
    assert np.allclose(out["a"], np.ones(2) / np.sqrt(2)) and out["z"] == [0.0, 0.0]
    assert E.mean_pool(df, "t", "e").schema["e"].dataType.simpleString() == "array<float>"


def test_centering(spark):
    rng = np.random.default_rng(0)
    rows = [(g, [float(x) for x in rng.normal(size=3) * s + np.array([0, 11 * k, 5])]) for k, (g, s) in enumerate((("p", 1), ("q", 1))) for _ in range(20)]
    out = E.center(spark.createDataFrame(rows, "g string, e array<float>"), "g", "e").collect()
    assert len(out) == 40 and all(abs(np.linalg.norm(r.e) - 1) < 1e-5 for r in out)
    assert all(abs(np.mean([r.e for r in out if r.g == g], axis=0)).max() < 0.4 for g in "pq")


def test_classifiers_find_a_linear_rule(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    rows = [(i, [float(v) for v in x[i]], bool(x[i, 0] + 0.3 * x[i, 1] > 0), ["a"] if i % 2 else []) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, e array<float>, b boolean, l array<string>")
    targets, names = E.label_targets(df, ["k", "e"], ["b"], {"l": ["a", "never"]})
    assert names == ["b", "l__a", "l__never"]
    model = E.fit(targets, ["k"], "e", names)
    scored = E.held_out(targets, ["k"], "e", model).cache()
    report = {r.target: r for r in E.evaluate(scored).collect()}
    assert report["b"].accuracy > 0.93 and report["b"].auc > 0.98 and report["l__never"].note and report["l__never"].auc is None
    # at the optimum the gradient of half the squared weights plus the losses vanishes
    z = model.design(x.astype(np.float32))
    y = np.array([r[2] for r in rows], dtype=float)
    p = 1 / (1 + np.exp(-z @ model.weights[0]))
    assert np.abs(z.T @ (p - y) + np.append(model.weights[0][:-1], 0)).max() < 1e-5
    cut = {r.target: r for r in E.calibrate(scored, 0.9).collect()}
    assert set(cut) == {"b"} and cut["b"].precision >= 0.9
    pool = E.predict(df, ["k"], "e", model, {"b": cut["b"].threshold})
    right = pool.join(df.select("k", "b"), "k").agg(F.avg((F.col("predicted") == F.col("b")).cast("double"))).first()[0]
    assert pool.count() == 300 and right > 0.93


def test_wide_vectors_and_folds(spark):
    """1,024 dimensions and a dozen targets: the curvature follows the axes, not the dimension; folds have equal shares of positives."""
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(6, 1024))
    z = rng.normal(size=(300, 6))
    x = z @ basis + 0.01 * rng.normal(size=(300, 1024))
    rows = [(i, v.tolist(), [float(z[i, j % 6] > j / 12) for j in range(12)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, e array<float>, targets array<double>").repartition(3)
    names = [f"t{j}" for j in range(12)]
    model = E.fit(df, ["k"], "e", names, axes=20)
    assert model.axes.shape == (1024, 20) and model.weights.shape == (12, 21)
    report = {r.target: r for r in E.evaluate(E.held_out(df, ["k"], "e", model)).collect()}
    assert min(r.accuracy for r in report.values()) > 0.9
    folds = np.array([r.fold for r in E.with_folds(df, ["k"], 5).orderBy("k").collect()])
    y = np.array([r[2] for r in rows])
    for j in range(12):
        counts = np.bincount(folds[y[:, j] == 1, j], minlength=5)
        assert counts.max() - counts.min() <= 1
    assert set(E.trusted(E.evaluate(E.held_out(df, ["k"], "e", model)), 0.0, 0.0)) == set(names)
