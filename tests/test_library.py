"""Properties that SQL cannot check."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomoform.functions import quantiles
from nomoform.functions.scalars import sigmoid
from nomoform.operators import chain, clean, columns, decompose, encode, evaluate, explain, nomogram, prepare, profile, score, select, split, train
from nomoform.plans.frames import li
from nomoform.sources import tables
from nomoform.streaming.scoring import score_stream

SF = "/root/testdata/sf0.001"


def test_linear_scores_have_no_interaction_and_are_rebuilt(spark):
    df = li(spark, SF).limit(300).select("id", "q", "d", "t")
    score = lambda at: sigmoid(at["q"] * 0.03 + at["d"] * 5.0 - at["t"] * 2.0)
    r = decompose.lebesgue(df, ["q", "d", "t"], score)
    assert r.where("vj is not null").agg(F.max(F.abs("phi"))).first()[0] < 1e-5
    phi0 = decompose.baseline(decompose.background(df, ["q", "d", "t"]), ["q", "d", "t"], score).first()[0]
    sums = decompose.to_rows(df, ["id"], ["q", "d", "t"], r).groupBy("id").agg(F.sum("phi").alias("s")).join(df, "id")
    assert sums.select(F.max(F.abs(F.col("s") + phi0 - (F.col("q") * 0.03 + F.col("d") * 5 - F.col("t") * 2)))).first()[0] < 1e-5


def test_interaction_is_found(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(100)], "a double, b double")
    r = decompose.lebesgue(df, ["a", "b"], lambda at: sigmoid(at["a"] * 0.1 + at["a"] * at["b"] * 0.05))
    assert r.where("vj is not null").agg(F.max(F.abs("phi"))).first()[0] > 1e-2


def test_path_fit_meets_its_conditions(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (800, 3)).astype(float)
    y = (rng.random(800) < 1 / (1 + np.exp(-(x @ [0.8, -0.4, 0.0])))).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "phis array<double>, y int")
    for r in select.fit_path(df, "phis", "y", [50.0, 5.0]).collect():
        b = np.array(r["betas"])
        g = x.T @ (1 / (1 + np.exp(-(r["intercept"] + x @ b))) - y)
        for k in range(3):
            assert abs(g[k] + r["lambda"] * np.sign(b[k])) < 0.2 if abs(b[k]) > 1e-6 else abs(g[k]) <= r["lambda"] + 0.2


def test_mask_holds_and_network_learns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a > 0)) for a, b in x], "a double, b double, y int")
    mask = np.array([[1, 1, 0], [0, 0, 1]])
    net = train.fit_network(df, ["a", "b"], "y", mask=mask, epochs=40, rate=0.1)
    assert (net.w1[mask == 0] == 0).all()
    scored = df.withColumn("p", net.score({"a": F.col("a"), "b": F.col("b")}))
    assert evaluate.auc(evaluate.score_counts(scored)).first()[0] > 0.95
    again = train.fit_network(df, ["a", "b"], "y", mask=mask, epochs=3)
    assert np.allclose(again.w1, train.fit_network(df, ["a", "b"], "y", mask=mask, epochs=3).w1)


def test_network_in_batches_against_numpy(spark):
    """The same batches, order, rate and steps in numpy give the same weights; the sketched AUC is near the exact one."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 2))
    y = (rng.random(700) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y int")
    history, size, rate, seed, hidden, epochs = [], 256, 0.2, 5, 3, 4
    net = train.fit_network(df, ["a", "b"], "y", hidden=hidden, epochs=epochs, rate=rate, seed=seed, test=df.where("id < 200"), history=history, batch=size, id_="id")
    r = np.random.default_rng(seed)
    w1, b1, w2, b2 = r.normal(0, 0.4, 2 * hidden).reshape(2, hidden), np.zeros(hidden), r.normal(0, 0.4, hidden), np.zeros(1)
    of = np.array([int(hashlib.md5(f"{i}:{seed}:batch".encode()).hexdigest()[:8], 16) % 3 for i in range(700)])
    theta, m, v, t, best = [w1, b1, w2, b2], [0.0] * 4, [0.0] * 4, 0, (np.inf, None)
    for e in range(epochs):
        p = 1 / (1 + np.exp(-(np.tanh(x @ theta[0] + theta[1]) @ theta[2] + theta[3])))
        loss = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p))[:200])
        pos, neg = p[:200][y[:200] == 1], p[:200][y[:200] == 0]
        exact = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
        assert abs(history[e]["test_loss"] - loss) < 1e-8 and abs(history[e]["test_auc"] - exact) < 0.01
        if loss < best[0]:
            best = (loss, [a.copy() for a in theta])
        for k in r.permutation(3):
            xs, ys = x[of == k], y[of == k]
            h = np.tanh(xs @ theta[0] + theta[1])
            d = 1 / (1 + np.exp(-(h @ theta[2] + theta[3]))) - ys
            back = np.outer(d, theta[2]) * (1 - h * h)
            t += 1
            for j, g in enumerate([xs.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g / len(xs), 0.999 * v[j] + 0.001 * (g / len(xs)) ** 2
                theta[j] = theta[j] - rate * size / 1024 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(net.w1, best[1][0]) and np.allclose(net.w2, best[1][2]) and np.isclose(net.b2, best[1][3][0])


def test_boosted_trees_stop_early(spark):
    df = spark.range(600).select(F.col("id").cast("double").alias("a"), ((F.col("id") * 37) % 11).cast("double").alias("b"), (F.col("id") >= 300).cast("int").alias("y"), (F.col("id") % 4 == 0).alias("held"))
    noisy = df.withColumn("y", F.when(F.col("a") % 7 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    model = train.fit_model(noisy, ["a", "b"], "y", "gbt", validationIndicatorCol="held", stepSize=0.3).stages[-1]
    assert 0 < model.getNumTrees < 280
    scored = train.with_probability(train.fit_model(df, ["a", "b"], "y", "gbt", validationIndicatorCol="held", maxIter=5), df)
    assert evaluate.auc(evaluate.score_counts(scored)).first()[0] > 0.99


def test_binary_levels_are_ordered():
    assert encode.order_binary(["yes", "no"]) == ["no", "yes"]
    assert encode.order_binary(["Low risk", "High risk"]) == ["Low risk", "High risk"]
    assert encode.order_binary(["b", "a"]) == ["b", "a"]


def test_split_errors(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    with pytest.raises(ValueError, match="test"):
        split.split_predefined(spark.createDataFrame([(" Training ",)], "s string"), F.col("s"), {})
    with pytest.raises(Exception, match="unknown split label"):
        split.split_predefined(df, F.col("s"), {"a": "train"}).collect()
    with pytest.raises(TypeError):
        split.split_temporal(df, "s")


def test_artifacts(spark, tmp_path):
    df = spark.range(5)
    tables.save_artifact(df, f"{tmp_path}/a", {"model": "m", "n": "5", "n_val": "1"})
    with pytest.warns(UserWarning, match="n_val"):
        tables.load_artifact(spark, f"{tmp_path}/a", {"n_val": "2"})
    assert tables.load_artifact(spark, f"{tmp_path}/a", {"model": "m"}).count() == 5
    with pytest.raises(ValueError, match="differs"):
        tables.load_artifact(spark, f"{tmp_path}/a", {"n": "6"})
    assert tables.file_hashes(spark, f"{tmp_path}/a/data/*.parquet").count() >= 1
    assert tables.load_table(spark, f"{SF}/orders.parquet", "o_orderkey", 17).count() == 17


def test_nomogram_scores_a_stream(spark, tmp_path):
    li(spark, SF).select("id", "q", "d").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("id string, q double, d double").parquet(f"{tmp_path}/in")
    scorer = lambda df: nomogram.score_rows(df, {"q": [(1.0, 0.0), (50.0, 1.0)]}, -0.5)
    score_stream(rows, scorer, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 6000 and out.where("p < 0.37 or p > 0.63").count() == 0


def test_running_totals_do_not_depend_on_ranges(spark):
    df = li(spark, SF).withColumn("p", F.col("q") / 50)
    counts = evaluate.score_counts(df)
    assert evaluate.auc(counts, ranges=1).first()[0] == pytest.approx(evaluate.auc(counts, ranges=16).first()[0], abs=1e-12)


def test_exact_percentiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=3000), rng.integers(0, 5, 3000).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, float("nan"), None)], "a double, b double, c double")
    for keep, short in ((100_000, 5000), (100_000, 0), (5, 0)):
        monkeypatch.setattr(quantiles, "KEEP", keep)
        monkeypatch.setattr(quantiles, "SHORT", short)
        got = quantiles.exact_percentiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.99, 1.0])
        assert np.allclose(got["a"], np.quantile(a, [0, 0.25, 0.5, 0.99, 1])) and np.allclose(got["b"], np.quantile(b, [0, 0.25, 0.5, 0.99, 1]))
        assert got["c"] == [None] * 5
    assert quantiles.exact_percentiles(df.where("false"), ["a"], [0.5]) == {"a": [None]}


def test_responses_of_trees_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), int(a * b > 4)) for a, b in rng.integers(0, 5, (300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    scorer = score.model_scorer(train.fit_model(df, ["a", "b"], "y", "gbt", maxIter=3))
    cells = scorer.add(spark.createDataFrame([(float(a), float(b)) for a in range(5) for b in range(5)], "a double, b double")).collect()
    z = {(r["a"], r["b"]): np.log(np.clip(r["p"], 1e-7, 1 - 1e-7) / (1 - np.clip(r["p"], 1e-7, 1 - 1e-7))) for r in cells}
    phi0 = np.mean([z[a, b] for a, b, _ in rows])
    one = {v: np.mean([z[v, b] for _, b, _ in rows]) - phi0 for v in range(5)}
    two = {v: np.mean([z[a, v] for a, _, _ in rows]) - phi0 for v in range(5)}
    for r in decompose.lebesgue(df, ["a", "b"], scorer).collect():
        want = {0: lambda: one[r["vi"]], 1: lambda: two[r["vi"]], 2: lambda: z[r["vi"], r["vj"]] - phi0 - one[r["vi"]] - two[r["vj"]]}[r["term"]]()
        assert abs(r["phi"] - want) < 1e-9


def test_two_large_sides_are_paired_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(100)], "a double, b double")
    f = lambda at: sigmoid(at["a"] * 0.1 + at["a"] * at["b"] * 0.05)
    want = sorted(map(tuple, decompose.lebesgue(df, ["a", "b"], f).select("term", "vi", "phi").collect()))
    monkeypatch.setattr(decompose, "MAX_BROADCAST", 3)
    got = sorted(map(tuple, decompose.lebesgue(df, ["a", "b"], f).select("term", "vi", "phi").collect()))
    assert np.allclose(np.array(want), np.array(got))


def test_whole_chain(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 6, (900, 3)).astype(float)
    p = 1 / (1 + np.exp(-(x[:, 0] - 2.5 + 0.4 * (x[:, 0] - 2.5) * (x[:, 1] - 2.5))))
    y = (rng.random(900) < p).astype(int)
    rows = [(*map(float, r), int(t), "train" if i % 5 < 3 else "test" if i % 5 == 3 else "val") for i, (r, t) in enumerate(zip(x, y))]
    parts = spark.createDataFrame(rows, "a double, b double, c double, y int, split string")
    scorer = score.function_scorer(["a", "b", "c"], lambda f: 1 / (1 + np.exp(-((f["a"] - 2.5) + 0.4 * (f["a"] - 2.5) * (f["b"] - 2.5)))))
    first, second, out = chain.two_phases(parts, ["a", "b", "c"], scorer, [30.0, 3.0, 0.3], epochs=15)
    assert {0, 3} <= set(first.betas) and 2 not in first.betas
    table = {(r["stage"], r["split"]): r for r in chain.summary(out, first, second, 3).collect()}
    assert len(table) == 12 and table["model_nomogram", "val"]["auc"] > table["model", "val"]["auc"] - 0.02
    assert table["network_nomogram", "test"]["auc"] > 0.7 and table["model_nomogram", "train"]["n_terms"] == len(first.betas)
    assert out.count() == 900


def test_refusals_and_warnings(spark):
    df = spark.createDataFrame([(0, 1, 2.0, "a"), (1, 0, 0.5, "b"), (1, 1, None, "c")], "u int, v int, w double, s string")
    for groups in ({"g": ["u"]}, {"g": ["u", "x"]}, {"g": ["u", "v"], "h": ["v", "u"]}, {"g": ["u", "w"]}):
        with pytest.raises(ValueError):
            columns.check_groups(df, groups)
    with pytest.warns(UserWarning):
        assert [r["target"] for r in clean.binary_target(df, "s").orderBy("s").collect()] == ["a", "b", "c"]
    with pytest.warns(UserWarning):
        assert columns.select_features(df, ["w", "nope"], "u", ["id"]).columns == ["w", "u"]
    with pytest.raises(TypeError):
        profile.feature_summary(df, ["s"])
    with pytest.raises(ValueError, match="differ"):
        prepare.check_parity({"train": df, "test": df.drop("w")})
    with pytest.raises(Exception, match="negative"):
        df.select(encode.collapse([F.col("u") - 1, F.col("v")])).collect()
    with pytest.raises(ValueError):
        encode.reference_level(df, ["s"], chosen={"s": "zz"})
    path = spark.createDataFrame([(0, [0.0, 0.01])], "lambda_idx int, betas array<double>")
    with pytest.raises(Exception, match="no lambda"):
        select.non_empty(path, path.select("lambda_idx")).collect()
    empty = df.where("false")
    assert encode.fit_scaler(empty, ["w"]).fitted == {"w": (0.0, 1.0)} and evaluate.prevalence(empty, "u") == 0.5
    assert evaluate.calibration(empty.select(F.col("w").alias("p"), F.col("u").alias("y")), evaluate.quantile_edges(empty, 4, "w")).count() == 0


def test_stored_forms(spark, tmp_path):
    df = spark.createDataFrame([(i, "train" if i < 6 else "test") for i in range(9)], "id long, split string")
    for stamp in ("20240101", "20250101"):
        hashes = tables.write_splits(df.where(F.col("id") < (9 if stamp > "2025" else 3)), f"{tmp_path}/s", stamp, "csv", {"seed": "42"})
    assert hashes.where("error is null and length(sha256) = 64").count() >= 2
    assert tables.load_splits(spark, f"{tmp_path}/s", "csv").groupBy("split").count().orderBy("split").collect() == [("test", 3), ("train", 6)]
    fitted = prepare.fit(spark.createDataFrame([(1.0, "a", "x"), (None, "b", "y")], "n double, o string, g string"), ["n"], {"o": ["b"]}, ["g"])
    tables.write_metadata(spark, fitted.to_json(), f"{tmp_path}/m")
    assert prepare.from_json(tables.read_metadata(spark, f"{tmp_path}/m")) == fitted and fitted.ordinal == {"o": ["b", "a"]}
    assert tables.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/m"]) == f"{tmp_path}/m"
    trials = train.random_search(*[spark.createDataFrame([(float(i % 7), i % 2) for i in range(k, 60)], "a double, y int") for k in (0, 3)], ["a"], "y", "logreg", {"regParam": (0.01, 1.0, "log")}, 3)
    train.save_trials(trials, f"{tmp_path}/t")
    assert trials.where("best").count() == 1 and isinstance(train.best_parameters(spark, f"{tmp_path}/t"), dict)
    doc = spark.createDataFrame([('{"schema": "0.9", "univariate": [{"term": 0, "name": "q", "points": [{"x": 1.0, "r": 2.0}]}]}',)], "json string")
    with pytest.warns(UserWarning, match="version"):
        assert nomogram.read_document(doc).collect() == [(0, "q", 1.0, None, 2.0, 0.0)]


def test_display_labels(spark):
    table = spark.createDataFrame([("seg", 0, "seg_a"), ("seg", 1, "b"), ("seg", 2, "c")], "feature string, code int, level string")
    labels = spark.createDataFrame([("seg_c", "The c"), ("seg_b", "[USER: b]")], "name string, label string")
    assert dict(encode.display_labels(table, labels).select("code", "label").collect()) == {0: "a", 1: "b", 2: "The c"}


def test_random_imputation_from_many_values(spark, monkeypatch):
    """Intervals joined by block give what broadcast ones give, which is the value at the drawn place of the sorted donors."""
    rows = [(i, None if i % 3 == 0 else f"v{i % 71:02d}" if i % 2 else "hot") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, x string")
    few = sorted(map(tuple, clean.impute_random(df, df, "x", "id").collect()))
    donors = sorted(x for _, x in rows if x is not None)
    place = lambda i: int(hashlib.md5(f"{i}:42:x".encode()).hexdigest()[:8], 16) % len(donors)
    assert few == [(i, donors[place(i)] if x is None else x) for i, x in rows]
    monkeypatch.setattr(clean, "MAX_BROADCAST", 5)
    monkeypatch.setattr(clean, "BLOCK", 16)
    assert sorted(map(tuple, clean.impute_random(df, df, "x", "id").collect())) == few
    assert clean.impute_random(df, df.where("x is null"), "x", "id").where("x is null").count() == 300


def test_preparation_at_random_and_by_own_values(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 9), None if i % 5 == 0 else "xyz"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, n double, g string")
    one, two = df.where("id < 80"), df.where("id >= 80")
    fitted = prepare.fit(one, ["n"], {}, ["g"], method="random", category_method="random", id_="id")
    assert fitted.numeric == {} and fitted.modes == {} and prepare.from_json(fitted.to_json()) == fitted
    out = prepare.prepare({"train": one, "test": two}, fitted)["test"]
    donors = sorted(n for i, n, _ in rows[:80] if n is not None)
    place = lambda i: int(hashlib.md5(f"{i}:42:n".encode()).hexdigest()[:8], 16) % len(donors)
    assert {r["id"]: r["n"] for r in out.collect()} == {i: donors[place(i)] if n is None else n for i, n, _ in rows[80:]}
    again = prepare.own_values(fitted, two)
    assert again.donors["n"].total == sum(n is not None for _, n, _ in rows[80:]) and again.groups == fitted.groups
    with pytest.raises(ValueError, match="id"):
        prepare.fit(one, ["n"], {}, ["g"], method="random")
    median = prepare.fit(one, ["n"], {}, ["g"])
    own = prepare.own_values(median, two)
    assert own.numeric["n"] == float(np.median([n for _, n, _ in rows[80:] if n is not None])) and own.references == median.references
    bare = prepare.fit(one.where("n is null"), ["n"], {}, ["g"], method="random", id_="id").transform(two)
    assert bare.where("n is null").count() == 10  # without donors nulls stay


def test_path_against_numpy(spark):
    """Warm starts, several lambdas a pass and the strong rule give the minimum that plain proximal steps find."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 12))
    x[:, 5] = x[:, 4] + 0.01 * rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 4] + 0.3)))).astype(int)
    rows = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "phis array<double>, y int").repartition(3)
    lambdas, passes = select.lambda_path(40, 300.0, 0.01), []
    path = select.fit_path(rows, "phis", "y", lambdas, passes=passes).orderBy("lambda_idx").collect()
    assert [r["lambda"] for r in path] == lambdas and len(passes) < 60 and any(p["terms"] < 13 for p in passes)
    design = np.c_[np.ones(400), x]
    for r in path:
        b = np.array([r["intercept"], *r["betas"]])
        g = design.T @ (1 / (1 + np.exp(-design @ b)) - y)
        assert (select.missed(g, b, r["lambda"]) <= 1e-3).all()
    assert all(b == 0 for b in path[0]["betas"]) and sum(b != 0 for b in path[-1]["betas"]) == 12
    short = select.fit_path(rows, "phis", "y", lambdas, max_terms=2, batch=5).count()
    assert short % 5 == 0 and short < 40
    assert select.fit_path(rows.where("false"), "phis", "y", lambdas).count() == 0
    one = select.fit_path(rows.where("y = 1"), "phis", "y", lambdas[:3]).collect()
    assert len(one) == 3 and all(r["intercept"] > 5 for r in one)


def test_backgrounds_of_terms_are_smaller(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), float(i % 3)) for i in range(210)], "a double, b double, c double")
    which = decompose.terms(["a", "b", "c"])
    backs = decompose.term_backgrounds(decompose.background(df, ["a", "b", "c"]), ["a", "b", "c"], which)
    n = {r["term"]: (r["n"], r["w"]) for r in backs.groupBy("term").agg(F.count("*").alias("n"), F.sum("w_").alias("w")).collect()}
    assert n == {0: (15, 210), 1: (21, 210), 2: (35, 210), 3: (3, 210), 4: (5, 210), 5: (7, 210)}
    score_ = lambda at: sigmoid(at["a"] * 0.3 + at["b"] * at["c"] * 0.1 - 0.5)
    z = lambda a, b, c: a * 0.3 + b * c * 0.1 - 0.5
    rows = [(i % 7, i % 5, i % 3) for i in range(210)]
    phi0 = np.mean([z(*r) for r in rows])
    for r in decompose.lebesgue(df, ["a", "b", "c"], score_, which=decompose.terms(["a", "b", "c"], singles=["b"])).collect():
        assert r["term"] == 1 and abs(r["phi"] - (np.mean([z(a, r["vi"], c) for a, _, c in rows]) - phi0)) < 1e-9


def test_poisson_draws(spark):
    """Means and variances of the counts that stand for resampled rows, on both sides of the exact range."""
    for n in (1, 3, 15, 16, 60, 5000):
        m, v = spark.range(20_000).select(evaluate.poisson(F.col("id").cast("string"), F.lit(n), 3, "t").alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
        assert abs(m - n) < 5 * (n / 20_000) ** 0.5 and abs(v / n - 1) < 0.06
    assert spark.range(5).select(evaluate.poisson(F.col("id").cast("string"), F.lit(0), 3, "t").alias("w")).distinct().collect() == [(0,)]
    cuts = evaluate.poisson_cuts(1)
    assert all(abs(a - b) < 1 << 12 for a, b in zip(cuts, evaluate.POISSON))


def test_bootstrap_of_counts_agrees_with_rows(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.integers(1, 40, 1500) / 40, 9)
    df = spark.createDataFrame([(i, float(a), int(b < a)) for i, (a, b) in enumerate(zip(p, rng.random(1500)))], "id long, p double, y int")
    counts = evaluate.score_counts(df)
    by_count = evaluate.interval(evaluate.auc(evaluate.count_replicates(counts, 300), ["b"], 1), "auc").first()
    by_row = evaluate.interval(evaluate.auc(evaluate.score_counts(evaluate.replicates(df, "id", 300), by=["b"], weight=F.col("w")), ["b"], 1), "auc").first()
    width = by_row["hi"] - by_row["lo"]
    assert by_count["replicates"] == 300 and all(abs(by_count[c] - by_row[c]) < 0.35 * width for c in ("lo", "hi", "mean"))


def test_stages_share_their_resamples(spark):
    """Equal scores in two stages have equal intervals, and a better stage is better in every split."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 20, 900) / 20
    rows = [(("train", "test", "val")[i % 3], int(rng.random() < x), float(x), float(x), float(rng.random())) for i, x in enumerate(a)]
    out = {(r["stage"], r["split"]): r for r in evaluate.stage_intervals(spark.createDataFrame(rows, "split string, y int, one double, two double, noise double"), ["one", "two", "noise"], 60).collect()}
    assert len(out) == 9 and all(r["lo"] < r["auc"] < r["hi"] for r in out.values())
    for s in ("train", "test", "val"):
        assert out["one", s][2:] == out["two", s][2:] and out["one", s]["lo"] > out["noise", s]["hi"]


def test_nomogram_tables_score_pairs_and_categories(spark):
    """Brackets of both axes, clamped ends, looked-up categories, unknown ones and nulls, against numpy."""
    xs, ys = [0.0, 1.0, 4.0], [-1.0, 2.0]
    r = {(x, y): 0.3 * x * y + x - 0.1 * y * y for x in xs for y in ys}
    pair = nomogram.Table("a", "b", [(x, y, v) for (x, y), v in r.items()])
    mixed = nomogram.Table("c", "a", [(c, x, 10 * c + x) for c in (0.0, 1.0, 2.0) for x in xs], frozenset({"c"}))
    single = nomogram.Table("a", None, [(x, None, x * x) for x in xs])
    const = nomogram.Table("b", None, [(5.0, None, 0.7)])
    rows = [(a, b, c) for a in (-3.0, 0.0, 0.25, 1.0, 2.5, 4.0, 9.0, None) for b in (-4.0, -1.0, 0.5, 2.0, 3.0) for c in (0.0, 2.0, 1.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = df.select("*", *[t.value().alias(n) for n, t in (("pair", pair), ("mixed", mixed), ("single", single), ("const", const))]).collect()

    def between(x, y):
        return np.interp(y, ys, [np.interp(x, xs, [r[v, w] for v in xs]) for w in ys])

    for g in got:
        if g["a"] is None:
            assert g["pair"] is None and g["mixed"] is None and g["single"] is None
        else:
            assert g["pair"] == pytest.approx(between(g["a"], g["b"])) and g["single"] == pytest.approx(np.interp(g["a"], xs, np.square(xs)))
            assert g["mixed"] is None if g["c"] == 1.5 else g["mixed"] == pytest.approx(10 * g["c"] + np.clip(g["a"], 0, 4))
        assert g["const"] == 0.7
    p = nomogram.score_tables(df.where("a = 1 and b = 2 and c = 2"), [pair, mixed], -0.5).first()["p"]
    assert p == pytest.approx(1 / (1 + np.exp(-(r[1.0, 2.0] + 21 - 0.5))))
    with pytest.raises(ValueError, match="holes"):
        nomogram.Table("a", "b", [(0.0, 0.0, 1.0), (1.0, 1.0, 1.0)]).value()
    curve = spark.createDataFrame([(3, x, y, v) for (x, y), v in r.items()], "term int, vi double, vj double, r double")
    shown = nomogram.descaled(curve, {3: (1.0, 2.0)}, {3: (10.0, 5.0)})
    assert {(g["vi"], g["vj"]) for g in shown.collect()} == {(2 * x + 1, 5 * y + 10) for x in xs for y in ys}
    assert sorted(map(tuple, nomogram.grid_matrix(curve, 3, ys).collect())) == [(x, r[x, -1.0], r[x, 2.0]) for x in xs]


def test_files_of_predictions(spark):
    from nomoform.operators import combine

    a = spark.createDataFrame([(1, "u", 0.1), (2, "v", 0.2)], "Key long, seg string, pred_prn double")
    b = spark.createDataFrame([(0.5, 2), (0.6, 3), (0.4, 2)], "pred_blackbox double, KEY long")
    c = spark.createDataFrame([(0.9,)], "pred_prn double")
    out = combine.combine_files({"a": a, "b": b, "c": c}, "key")
    assert out.columns == ["Key", "seg", "pred_prn_a", "pred_blackbox_b"] and sorted(map(tuple, out.collect())) == [(1, "u", 0.1, None), (2, "v", 0.2, 0.5)]
    assert combine.combine_files({"a": a, "b": b.withColumnRenamed("KEY", "k2")}, "nothing").columns == ["Key", "seg", "pred_prn_a"]
    assert sorted(r["pred_blackbox_b"] or 0 for r in combine.combine_files({"a": a, "b": b}, "nothing").collect()) == [0, 0.5]


def test_forest_and_logistic_regression_learn(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 2))
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, y int")
    parts = [df.limit(1000), df.subtract(df.limit(1000))]
    for kind, more in (("logreg", {}), ("forest", {"numTrees": 20})):
        scored = train.with_probability(train.fit_model(parts[0], ["a", "b"], "y", kind, **more), parts[1])
        assert evaluate.auc(evaluate.score_counts(scored), ranges=1).first()[0] > 0.8


def test_strict_pairs_of_a_mask():
    pairs = {3: (0, 1), 4: (0, 2)}
    assert select.mask_terms({0, 1, 3, 4}, pairs, strict_pairs=True) == [(0, (0,)), (1, (1,)), (3, (0, 1))]
    assert select.mask_terms({3}, pairs, add_singles=True) == [(0, (0,)), (1, (1,)), (3, (0, 1))]
    assert select.mask_terms({4}, pairs, groups=[[2, 5]]) == [(4, (0, 2, 5))]


def test_both_grids_and_their_nomograms(spark, tmp_path):
    """Each side has the responses of its own grid; files and settings of the stored one."""
    df = li(spark, SF).limit(400).select("q", "d").cache()
    features, which = ["q", "d"], decompose.terms(["q", "d"])
    score = lambda at: sigmoid(at["q"] * 0.03 - at["d"] * 5.0 + at["q"] * at["d"])
    grid = decompose.both_grids(df, features, which, 0.1)
    responses = decompose.lebesgue(df, features, score, grid.select("term", "vi", "vj"), which)
    betas = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.5)], "term int, beta double")
    sides = nomogram.build_both(responses, grid, betas, -0.5, {0: "q", 1: "d", 2: "q_d"}, {2: "numbers"})
    for side, trim in zip(sides, (0.1, None)):
        own = decompose.product_grid(decompose.even_grid(df, features, trim=trim), features, which)
        want = nomogram.curves(decompose.lebesgue(df, features, score, own, which), betas)
        key = lambda r: (r["term"], r["vi"], r["vj"] or 0.0)
        got, want = sorted(side.curves.collect(), key=key), sorted(want.collect(), key=key)
        assert [key(r) for r in got] == [key(r) for r in want] and np.allclose([r["r"] for r in got], [r["r"] for r in want])
    q = [{r["vi"] for r in side.curves.where("term = 0").collect()} for side in sides]
    assert min(q[0]) > min(q[1]) and max(q[0]) < max(q[1])
    nomogram.write_nomogram(sides[1], f"{tmp_path}/n", {"comment": "a test"}, as_odds=True)
    pairs = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/n/bivariate/table")
    assert sorted(pairs.columns) == ["k", "q_d_r", "q_d_x1", "q_d_x2"] and pairs.count() == sides[1].curves.where("term = 2").count()
    assert pairs.where("q_d_r <= 0").count() == 0
    assert "# intercept: 0.606531" in [r[0] for r in spark.read.text(f"{tmp_path}/n/univariate/header").collect()]
    assert set(spark.read.option("header", True).csv(f"{tmp_path}/n/univariate/table").columns) == {"k", "q_x", "q_r", "d_x", "d_r"}
    doc = nomogram.document(sides[1], {"n_steps": "15", "threshold": "many"}, 0.5, 3)
    assert nomogram.settings(doc).collect() == [(-0.5, 15, 15)]
    assert nomogram.settings(spark.createDataFrame([("{}",)], "json string")).collect() == [(0.0, 50, 15)]


def test_conversion_of_whole_columns(spark):
    rows = [(float(i % 4), float(i % 2), i % 4 + 0.5, float(i), float(i % 5), "x") for i in range(40)] + [(None,) * 6]
    df = spark.createDataFrame(rows, "few double, two double, parts double, many double, left double, text string")
    got = profile.convert_categorical(df, df.columns, exclude=("left",))
    assert dict(got.dtypes) == dict(df.dtypes) | {"few": "bigint"}
    assert got.where("few is null").count() == 1 and got.agg(F.sum("few")).first()[0] == 60
    assert dict(profile.convert_categorical(df.where("false"), df.columns).dtypes) == dict(df.dtypes)


def test_levels_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(x,) for x in "bacab"] + [(None,)], "s string")
    assert encode.levels(df, "s") == ["a", "b", "c"]
    monkeypatch.setattr(encode, "MAX_LEVELS", 2)
    with pytest.raises(ValueError, match="levels"):
        encode.levels(df, "s")


def test_feature_catalogue(spark):
    rows = [(float(i), i % 3, None) for i in range(40)]
    df = spark.createDataFrame(rows, "age double, g int, bare double")
    got = {r["feature"]: r for r in nomogram.feature_catalogue(df, ["age", "g", "bare"], ["g_b", "age", "g_c", "bare"], {"g": ["g_b", "g_c"]}, {"age": "Age"}, ["g"], 3).collect()}
    assert tuple(got["age"])[1:] == ("Age", None, 0, [1], False, "continuous", None, 0.0, 39.0)
    assert tuple(got["g"])[1:] == ("g", 0, 1, [0, 2], True, "categorical", [0.0, 1.0, 2.0], None, None)
    assert tuple(got["bare"])[1:] == ("bare", None, 2, [3], False, "categorical", [], None, None)
    assert nomogram.feature_catalogue(df.where("false"), ["age"], ["age"], {}).collect()[0]["dense_idx"] == 0
    with pytest.raises(ValueError, match="original"):
        nomogram.feature_catalogue(df, ["age", "g"], ["age"], {"g": ["g_b"]})


def test_counted_rows_stand_for_all_rows_on_a_path(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(-2, 3, (600, 2)).astype(float), rng.integers(0, 2, 600)
    rows = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "phis array<double>, y int")
    few = select.tallied(rows, ["phis", "y"])
    assert few.count() <= 50 and few.agg(F.sum("w")).first()[0] == 600
    paths = [select.fit_path(rows, "phis", "y", [20.0, 2.0]), select.fit_path(few, "phis", "y", [20.0, 2.0], weight="w")]
    got = [sorted((r["lambda_idx"], r["intercept"], *r["betas"]) for r in p.collect()) for p in paths]
    assert np.allclose(*got)
    by = lambda d, *cols: [tuple(r) for r in d.orderBy("lambda_idx").select(*cols).collect()]
    assert np.allclose(by(select.path_metrics(rows, paths[0]), "auc", "log_loss", "brier"), by(select.path_metrics(few, paths[0], weight="w"), "auc", "log_loss", "brier"))
    assert np.allclose(by(chain.kkt(rows, paths[0], n_terms=2), "off"), by(chain.kkt(few, paths[0], n_terms=2, weight="w"), "off"))


def test_quartiles_of_contributions_against_numpy(spark):
    rng = np.random.default_rng(6)
    values = {0: rng.normal(size=257), 1: rng.integers(-3, 4, 400).astype(float), 2: np.array([1.5])}
    rows = [(i, t, float(c)) for t, v in values.items() for i, c in enumerate(v)] + [(999, 1, None)]
    got = {r["term"]: r for r in explain.quartiles(spark.createDataFrame(rows, "id long, term int, c double")).collect()}
    assert set(got) == set(values)
    for t, v in values.items():
        assert np.allclose([got[t][c] for c in ("q1", "median", "q3", "mean", "min", "max")], [*np.percentile(v, [25, 50, 75]), v.mean(), v.min(), v.max()])


def test_selection_reads_line_items_once(spark):
    from nomoform.plans import selection

    plan = selection.path_with_auc(spark, SF)._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "path-auc" in plan


def test_network_takes_counted_rows(spark):
    """Counted rows give the network of all rows, with and without batches, and a step sees distinct rows only."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 4, 800)
    df = spark.createDataFrame([(i, float(v), float(i % 3), int(rng.random() < v / 4)) for i, v in enumerate(a)], "id long, a double, b double, y int")
    few, histories = select.tallied(df, ["a", "b", "y"]), ([], [])
    assert few.count() <= 24
    nets = [train.fit_network(d, ["a", "b"], "y", epochs=6, history=h, test=d, weight=w) for d, h, w in ((df, histories[0], None), (few, histories[1], "w"))]
    assert np.allclose(nets[0].w1, nets[1].w1) and np.allclose(nets[0].w2, nets[1].w2) and np.isclose(nets[0].b2, nets[1].b2)
    assert all(np.isclose(x[k], y[k]) for x, y in zip(*histories) for k in x)
    batched = [train.fit_network(d, ["a", "b"], "y", epochs=3, batch=100, id_="b", weight=w) for d, w in ((df, None), (few, "w"))]
    assert np.allclose(batched[0].w1, batched[1].w1)


def test_weighted_background_is_that_of_all_rows(spark):
    df = spark.createDataFrame([(float(i * i % 5), float(i % 3)) for i in range(60)], "a double, b double")
    few = select.tallied(df, ["a", "b"])
    f = lambda at: sigmoid(at["a"] * 0.3 + at["a"] * at["b"] * 0.2)
    one, two = (sorted((r["term"], r["vi"], r["vj"] or 0.0, r["phi"]) for r in decompose.lebesgue(d, ["a", "b"], f, weight=w).collect()) for d, w in ((df, None), (few, "w")))
    assert few.count() < 60 and np.allclose(one, two)


def test_trees_take_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(train, "MOST_ROWS", 100)
    df = spark.range(0, 950, numPartitions=1).withColumn("x", F.rand(1))
    dealt = train.dealt_evenly(df)
    assert dealt.count() == 950 and dealt.rdd.getNumPartitions() == 10
    assert train.dealt_evenly(spark.range(0, 60, numPartitions=40)).rdd.getNumPartitions() == 1
    assert max(r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) <= 110


def _shared_rows(spark):
    """40 kinds of rows, each 1 to 157 times, some held back, with labels that a score draws."""
    rng = np.random.default_rng(11)
    few = [(float(a), float(b), int(y), bool(h), int(n)) for a in range(5) for b in range(4) for y in (0, 1) for h, n in [(False, rng.integers(1, 40 + 30 * (y if a * b > 3 else 1 - y)))]]
    few += [(a, b, y, True, 1 + n // 3) for a, b, y, _, n in few]
    df = spark.createDataFrame(few, "a double, b double, y int, held boolean, n long")
    return df, df.select("a", "b", "y", "held", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def test_trees_boosted_on_groups_are_those_of_all_rows(spark, monkeypatch):
    few, rows = _shared_rows(spark)
    taken, dealt = [], train.dealt_evenly
    monkeypatch.setattr(train, "dealt_evenly", lambda df: taken.append(df.count()) or dealt(df))
    monkeypatch.setattr(train, "STRIDE", 5, raising=False)
    for more in ({"maxIter": 7}, {"maxIter": 60, "stepSize": 0.9, "minInstancesPerNode": 30, "validationIndicatorCol": "held"}):
        how = {"subsamplingRate": 1.0, "featureSubsetStrategy": "all", "validationTol": 0.0, **more}
        want = train.Pipeline(stages=[train.VectorAssembler(inputCols=["a", "b"], outputCol="_x"), train.MODELS["gbt"](featuresCol="_x", labelCol="y", **how)]).fit(rows)
        one = train.fit_model(rows, ["a", "b"], "y", "gbt", **how)
        assert max(taken) <= few.count() < rows.count() / 10
        for got in (one, train.fit_model(few, ["a", "b"], "y", "gbt", weight="n", **how)):
            assert got.stages[-1].getNumTrees == want.stages[-1].getNumTrees
            p, q = ([r["p"] for r in train.with_probability(m, few.orderBy("a", "b", "y", "held")).collect()] for m in (got, want))
            assert np.allclose(p, q, atol=1e-9)
    assert want.stages[-1].getNumTrees < 60


def test_every_row_is_drawn_for_in_boosting(spark):
    few, _ = _shared_rows(spark)
    drawn = few.withColumn("k", train.rows_drawn(F.col("n"), F.md5(F.concat_ws(":", "a", "b", "y", "held")), 0.75, 400)).collect()
    for r in drawn:
        assert abs(np.mean(r["k"]) - 0.75 * r["n"]) < 5 * np.sqrt(0.1875 * r["n"] / 400) and max(r["k"]) <= r["n"]
    assert np.isclose(np.mean([np.var(r["k"]) / (0.1875 * r["n"]) for r in drawn]), 1, atol=0.1)
    assert len({tuple(r["k"]) for r in drawn if r["n"] > 5}) == sum(r["n"] > 5 for r in drawn)
    huge = few.withColumn("n", F.col("n") * 10**9)  # a billion rows for each of some
    model = train.fit_model(huge, ["a", "b"], "y", "gbt", weight="n", maxIter=3)
    again = train.fit_model(huge.repartition(7), ["a", "b"], "y", "gbt", weight="n", maxIter=3)
    p, q = ([r["p"] for r in train.with_probability(m, few.orderBy("a", "b", "y", "held")).collect()] for m in (model, again))
    assert model.stages[-1].getNumTrees == 3 and np.allclose(p, q) and len(set(p)) > 4


def test_rows_that_differ_are_boosted_one_by_one(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("a"), (F.col("id") >= 150).cast("int").alias("y"), F.lit(2).cast("long").alias("n"))
    model = train.fit_model(df, ["a"], "y", "gbt", weight="n", maxIter=3)
    assert evaluate.auc(evaluate.score_counts(train.with_probability(model, df))).first()[0] > 0.99
