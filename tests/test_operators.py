"""Hand-computed cases for single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.functions import convert
from lendframe.operators import (
    confidence, encode, ensemble, eda, forest, impute, interact, metrics, models, outliers, quality, runs, scale, select, split, validate)
from lendframe.operators.rules import Check, Rule, RuleBook
from lendframe.operators.schema import FieldConstraint
from lendframe.sources.files import with_target
from lendframe.sources.loans import loan_applications


def col(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_conversions(spark):
    df = spark.createDataFrame([("1,234",), (" 5.0 ",), ("5.5",), ("12.9%",), ("-3",), ("1d",), ("",), (None,)], "x string")
    assert col(df, convert.to_integer(F.col("x"))) == [1234, 5, None, 12, -3, None, None, None]
    df = spark.createDataFrame([("$1,200.50",), ("45%",), ("€3",), ("abc",), ("NaN",)], "x string")
    assert col(df, convert.to_float(F.col("x"))) == [1200.5, 0.45, 3.0, None, None]
    df = spark.createDataFrame([(" YES",), ("off",), ("2",), ("",)], "x string")
    assert col(df, convert.to_boolean(F.col("x"))) == [True, False, None, False]
    df = spark.createDataFrame([("02/03/2024",), ("25/12/2023",), ("2024-01-05T10:00:00.5Z",), ("0",), ("nope",)], "x string")
    got = [None if v is None else str(v) for v in col(df, convert.to_datetime(F.col("x")).cast("timestamp_ntz"))]
    assert got == ["2024-02-03 00:00:00", "2023-12-25 00:00:00", "2024-01-05 10:00:00.500000", "1970-01-01 00:00:00", None]
    with pytest.raises(convert.ConversionError):
        convert.convert_dataframe(df, {"x": "datetime"}, strict=True)


def test_rules_skip_nulls_and_can_be_extended(spark):
    df = spark.createDataFrame([(1, 60000.0, 5000.0), (2, 60000.0, 3000.0), (3, None, 3000.0)], "id bigint, annual_income double, monthly_income double")
    book = RuleBook((Rule("income", (Check("bad", "abs(monthly_income - annual_income / 12D) > annual_income / 12D * 0.15D", "monthly_income", "0D"),)),))
    assert [r["id"] for r in book.violations(df, "id").collect()] == [2]
    book.register(Rule("low", (Check("low", "monthly_income < 4000", "monthly_income", "4000D"),)))
    assert book.violations(df, "id").count() == 3
    book.disable("low")
    assert {r["rule"]: r["passed"] for r in book.status(df).collect()} == {"income": False}


def test_rules_are_native(spark, sf):
    plan = RuleBook().violations(loan_applications(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_projection_reads_few_columns(spark, sf):
    plan = loan_applications(spark, sf).select("credit_score")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_validation_guards(spark):
    df = spark.createDataFrame([(1, 17), (2, 30)], "id bigint, age int")
    schema = (FieldConstraint("age", "integer", min_value=18, max_value=100),)
    v = validate.violations(df, "id", schema).collect()
    assert [(r["id"], r["error_type"]) for r in v] == [(1, "below_minimum")]
    good, bad = validate.validate_input("id", schema, "quarantine")(lambda d: d)(df)
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(validate.ValidationError):
        validate.validate_input("id", schema)(lambda d: d)(df)
    with pytest.raises(validate.ValidationError):
        validate.require_fields("income")(lambda d: d)(df)
    with pytest.raises(validate.ValidationError):
        validate.validate_output(max_rows=1)(lambda: df)()
    assert validate.validate_output(columns=["age"], min_rows=1, max_rows=5)(lambda: df)() is df
    r = validate.validate_all(df, "id")
    assert r.stopped and len(r.schema.missing) > 10


def test_scalers_invert_and_handle_constants(spark):
    df = spark.createDataFrame([(float(i * i), 3.0) for i in range(1, 30)], "x double, k double")
    for m in ("standard", "minmax", "robust", "power", "box-cox"):
        s = scale.fit_scaler(df, ["x"], m)
        back = scale.invert_scaler(scale.apply_scaler(df, s), s).collect()
        assert all(abs(r["x"] - (i + 1) ** 2) < 1e-6 for i, r in enumerate(back))
    assert col(scale.apply_scaler(df, scale.fit_scaler(df, ["k"])), "k") == [0.0] * 29


def test_yeo_johnson_lambda_maximizes_likelihood(spark):
    df = spark.createDataFrame([(math.exp(i / 10) - 1,) for i in range(60)], "x double")
    lam = scale.fit_lambda(df, ["x"])["x"]
    ll = scale.log_likelihoods(df, ["x"], {"x": [lam - 0.01, lam, lam + 0.01]})["x"]
    assert ll[1] >= max(ll[0], ll[2])


def test_quantile_map_and_probit(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 5, 9]], "x double")
    q = scale.fit_quantile_map(df, ["x"], 6)
    got = col(scale.apply_quantile_map(df, q), "x")
    assert got[0] == 0.0 and got[-1] == 1.0 and abs(got[1] - 0.4) < 1e-12
    p = col(spark.createDataFrame([(0.5,), (0.975,), (0.01,)], "u double"), scale.probit(F.col("u")))
    assert abs(p[0]) < 1e-8 and abs(p[1] - 1.959964) < 1e-5 and abs(p[2] + 2.326348) < 1e-5


def test_knots_are_exact_quantiles(spark):
    r = np.random.default_rng(4)
    a = np.concatenate([np.round(r.lognormal(3, 1, 700), 1), np.full(400, 20.0)])  # a third of the rows are one value
    df = spark.createDataFrame([(float(x), float(i % 3) if i % 5 else None) for i, x in enumerate(a)], "a double, b double")
    b = np.array([i % 3 for i in range(len(a)) if i % 5], float)
    for m in (2, 11, 1000):
        got = scale.evenly_spaced(df, ["a", "b"], {c: tuple(k / (m - 1) for k in range(m)) for c in "ab"}, {"a": len(a), "b": len(b)})
        for c, v in (("a", a), ("b", b)):
            assert np.allclose(list(got[c].values()), np.quantile(v, np.arange(m) / (m - 1)), atol=1e-9)


def test_missing_and_empty_fields_are_violations(spark, sf):
    df = loan_applications(spark, sf).drop("credit_score").withColumn("age", F.lit(None).cast("int"))
    r = validate.validate_all(df, "application_id")
    assert r.schema.missing == ["credit_score"] and r.schema.all_null == ["age"] and not r.stopped
    got = r.violations.where("error_type in ('missing_field', 'all_null')").collect()
    assert sorted((x["field"], x["error_type"], x["application_id"]) for x in got) == [
        ("age", "all_null", None), ("credit_score", "missing_field", None)]
    assert validate.validate_all(df.select("application_id", "age"), "application_id").stopped


def test_cut_and_bins(spark):
    df = spark.createDataFrame([(0.0,), (600.0,), (601.0,), (900.0,), (None,)], "x double")
    assert col(df, scale.cut(F.col("x"), [0, 600, 650, 850])) == [None, 0, 1, None, None]
    assert col(scale.bin_ordinal(df, {"x": [0, 300, 700, 900]}), "x") == [0, 1, 1, 2, None]


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 100])], "id bigint, x double")
    f = outliers.fit_iqr(df, ["x"])
    assert outliers.treat(df, f, "remove").count() == 5
    assert max(col(outliers.treat(df, f, "clip"), "x")) == f.bounds["x"][1]
    assert col(outliers.treat(df, f, "null"), "x")[-1] is None
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert outliers.fit_zscore(flat, ["x"]).bounds == {}


def test_impute(spark):
    df = spark.createDataFrame([(1, "a", None), (None, "a", 2.0), (3, None, 4.0)], "n int, s string, x double")
    p = impute.fit_imputer(df, {"x": "mean"})
    assert impute.impute(df, p).collect()[0]["x"] == 3.0 and p.fill["n"] == 2.0 and p.fill["s"] == "a"
    assert "s" not in impute.impute(df, impute.fit_imputer(df, {"s": "drop"})).columns
    with pytest.raises(ValueError):
        impute.fit_imputer(df, {"s": "guess"})


def test_encoders(spark):
    df = spark.createDataFrame([("b", 1), ("a", 0), ("b", 0), (None, 1)], "c string, y int")
    cats = encode.fit_categories(df, ["c"])
    new = spark.createDataFrame([("z",), ("b",), (None,)], "c string")
    assert col(encode.label_codes(new, cats), "c") == [0, 1, 0]
    assert col(encode.ordinal(new, {"c": ["a", "b"]}), "c") == [-1, 1, -1]
    assert [tuple(r) for r in encode.one_hot(new, cats).collect()] == [(0, 0), (0, 1), (0, 0)]
    e = encode.fit_target(df, "c", "y", 1.0)
    got = {r["c"]: r["c_encoded"] for r in encode.apply_target(new, e).collect()}
    assert abs(got["b"] - 1.5 / 3) < 1e-12 and got["z"] == 0.5 and got[None] == 0.5
    with pytest.raises(ValueError):
        encode.fit_categories(df, ["c"], limit=1)


def test_interactions(spark):
    df = spark.createDataFrame([(6.0, 2.0), (8.0, 0.0), (10.0, 2.0)], "a double, b double")
    p = interact.fit_ratios(df, [("a", "b")])
    assert col(interact.add_ratios(df, [("a", "b")], p), "a_to_b_ratio") == [3.0, 4.0, 5.0]
    assert interact.polynomial(df, ["a", "b"], 2, False, True).columns == ["a", "b", "bias", "a__a", "a__b", "b__b"]


def test_quality(spark):
    df = spark.createDataFrame([("x@y.org", 5, "a "), ("bad", 200, "A "), (None, 7, "b")], "email string, age int, s string")
    v = {r["column"]: (r["valid"], r["total"]) for r in quality.validity(df).collect()}
    assert v == {"email": (1, 2), "age": (2, 3), "s": (3, 3)}
    c = {r["column"]: round(r["score"], 6) for r in quality.consistency(df).collect()}
    assert c["s"] == 0.8 and c["age"] == 1.0
    assert col(spark.createDataFrame([("1.25E7",), ("1.0E-4",), ("12.5",), ("1.2345678E7",), ("1.23456789E7",)], "t string"),
               quality.decimal_places(F.col("t"))) == [1, 4, 1, 1, 1]
    r = quality.assess(df, "2024-01-01")
    assert 0 < r.overall <= 1 and quality.gate(r, 0.0)
    with pytest.raises(quality.QualityGateError):
        quality.gate(r, 1.1, "raise")


def preds(spark):
    rows = [(1, "a", 1, 0.9, 1), (2, "a", 0, 0.9, 1), (3, "a", 1, 0.4, 0), (4, "a", 0, 0.1, 0)]
    return spark.createDataFrame(rows, "row_id bigint, model string, label int, proba double, pred int").withColumn("loan_amount", F.lit(1000.0))


def test_metrics(spark):
    p = preds(spark)
    m = metrics.classification_metrics(p).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (1, 1, 1, 1) and m["accuracy"] == 0.5 and m["mcc"] == 0.0 and m["kappa"] == 0.0
    r = metrics.rank_metrics(p).first()
    assert abs(r["auc"] - 0.625) < 1e-12 and abs(r["average_precision"] - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12
    assert metrics.rank_metrics(p.where("label = 1")).first()["auc"] == 0.0
    b = metrics.business_impact(p).first()
    assert abs(b["net_business_value"] - (1000 * 0.045 - 700 - 400)) < 1e-9


def test_confidence(spark):
    p = preds(spark)
    assert abs(p.select(confidence.confidence(F.lit(0.5))).first()[0]) < 1e-6
    s = confidence.threshold_sweep(p, confidence.confidence(F.col("proba"), "margin"), (0.5, 0.99)).collect()
    got = {r["threshold"]: (r["coverage"], r["accuracy"]) for r in s}
    assert got[0.5] == (0.75, 2 / 3) and got[0.99] == (0.0, None)


def test_votes(spark):
    rows = [(1, m, 1, p, int(p >= 0.5)) for m, p in (("a", 0.9), ("b", 0.2))]
    p = spark.createDataFrame(rows, "row_id bigint, model string, label int, proba double, pred int")
    assert ensemble.hard_vote(p).first()["pred"] == 0
    assert ensemble.hard_vote(p, {"a": 0.6, "b": 0.4}).first()["pred"] == 1
    assert abs(ensemble.soft_vote(p).first()["proba"] - 0.55) < 1e-12


def test_early_stopping_follows_the_recurrence(spark):
    import random
    rnd = random.Random(0)
    logs = {s: [round(1 / (1 + i / 5) + rnd.uniform(0, 0.15), 4) for i in range(80)] for s in range(6)}
    logs[9] = [float(100 - i) for i in range(80)]
    df = spark.createDataFrame([(s, i + 1, v) for s, vs in logs.items() for i, v in enumerate(vs)], "session_id int, step int, value double")
    got = {r["session_id"]: (r["stop_step"], r["best_value"]) for r in runs.early_stopping(df, 7, 0.01, chunk=13).collect()}
    for s, vs in logs.items():
        best, wait, stop = vs[0], 0, None
        for i, v in enumerate(vs[1:], 2):
            if v + 0.01 < best:
                best, wait = v, 0
            else:
                wait += 1
            if wait >= 7:
                stop = i
                break
        assert got[s] == (stop, best)


def test_early_stopping_of_a_curve_that_always_falls(spark):
    log = spark.range(200_000).select(F.lit("s").alias("session_id"), (F.col("id") + 1).alias("step"), (-F.col("id")).cast("double").alias("value"))
    r = runs.early_stopping(log).first()
    assert (r["steps"], r["stop_step"], r["best_step"], r["best_value"]) == (200_000, None, 200_000, -199_999.0)


def test_splits(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    c = {(r["y"], r["split"]): r["count"] for r in split.stratified_split(df, "id", "y", 0.2, 0.1).groupBy("y", "split").count().collect()}
    assert c == {(0, "test"): 180, (0, "val"): 90, (0, "train"): 630, (1, "test"): 20, (1, "val"): 10, (1, "train"): 70}
    assert {r["count"] for r in split.kfold(df, "id", 4).groupBy("fold").count().collect()} == {250}
    t = split.time_splits(df, ["id"], 3, gap=5)
    first = t.where("role = 'test'").groupBy("split").agg(F.min("rn").alias("a")).join(
        t.where("role = 'train'").groupBy("split").agg(F.max("rn").alias("b")), "split").collect()
    assert all(r["a"] - r["b"] == 6 for r in first)


def test_t_test_p_values():
    assert abs(eda.t_p_value(2.0, 10) - 0.07338803) < 1e-6
    assert abs(eda.t_p_value(1.96, 1e6) - 0.0499958) < 1e-4


def test_correlation_of_many_columns(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=200) * 0.1
    rows = [tuple(None if (i + j) % 17 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(8)))
    for r in eda.correlation_matrix(df).collect():
        a, b = int(r["column_a"][1]), int(r["column_b"][1])
        ok = [(q[a], q[b]) for q in rows if q[a] is not None and q[b] is not None]
        assert abs(r["r"] - np.corrcoef(np.array(ok).T)[0, 1]) < 1e-9
    assert "c3" in select.correlated(df, df.columns)


def test_target_discovery(spark):
    df = spark.createDataFrame([(700.0, 50000.0), (600.0, 50000.0), (None, 1.0)], "credit_score double, annual_income double")
    assert col(with_target(df), "target") == [1, 0, 0]
    assert col(with_target(df.withColumn("my_label", F.lit(9))), "target") == [9, 9, 9]


def test_isolation_forest_finds_far_points(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(300)] + [(1000, 500.0, 500.0)], "id bigint, a double, b double")
    out = forest.isolation_outliers(df, ["a", "b"], "id", contamination=0.05, trees=20, sample=256)
    top = out.orderBy(F.desc("anomaly")).first()
    assert top["id"] == 1000 and top["is_outlier"]
    small = forest.isolation_outliers(df.limit(5), ["a", "b"], "id")
    assert small.where("is_outlier").count() == 0


def test_model_round_trip(spark, sf, tmp_path):
    df = loan_applications(spark, sf, copies=False).select(F.col("application_id").alias("row_id"), "credit_score", "debt_to_income_ratio", "loan_approved")
    x = models.assemble(df, ["credit_score", "debt_to_income_ratio"], "loan_approved", keep=("row_id",))
    m = models.fit_forest(x, "loan_approved", trees=5, depth=4)
    p = models.score(m, x, "loan_approved", "forest")
    assert metrics.rank_metrics(p).first()["auc"] > 0.5
    assert p.where("proba < 0 or proba > 1").count() == 0
    models.save_model(m, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m")).transform(x)
    assert again.select("prediction").exceptAll(m.transform(x).select("prediction")).count() == 0


def test_ties_in_scores_go_by_name(spark):
    from lendframe.operators import select
    rows = [(i % 2, 0.03 * x, x, 1.0 * (i % 7)) for i, x in enumerate((17.0 * k) % 101 + 3 * (k % 2) for k in range(400))]
    df = spark.createDataFrame(rows, "y int, b double, a double, c double")
    assert select.select_best(df, ["b", "a", "c"], "y", k=1, score="f_classif") == ["a"]


def test_domain_denominators_may_be_zero(spark):
    from lendframe.operators import interact
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (4.0, 8.0), (2.0, 2.0), (None, 1.0)], "d double, x double")
    f = {"r": ("try_divide(x, {d})", "d")}
    m = interact.fit_domain(df, f)
    assert m == {"d": 3.0}
    assert [r["r"] for r in interact.add_domain(df, m, f).collect()] == [1 / 3, 2 / 3, 2.0, 1.0, None]
    assert interact.fit_domain(df.where("d = 0"), f) == {"d": 1.0}


def test_sparse_one_hot_has_no_limit(spark):
    from lendframe.operators import encode
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(1500)] + [(None,)], "c string")
    t = encode.label_table(df.where("c <> 'v0007'"), "c")
    got = {r["c"]: r["v"] for r in encode.one_hot_sparse(df, "c", t, "v").collect()}
    assert got[None].numNonzeros() == got["v0007"].numNonzeros() == 0
    assert got["v0003"].indices.tolist() == [3] and got["v1499"].indices.tolist() == [1498] and got["v0003"].size == 1499
    import pytest
    with pytest.raises(ValueError):
        encode.fit_categories(df, ["c"])


def test_scratch_needs_a_named_folder_on_a_cluster():
    import pytest
    from lendframe import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Session(), "x")


def test_loan_features_at_small_scale(spark, sf):
    from lendframe.plans.feature_set import LOAN_FEATURES, FeatureSet
    from lendframe.sources.loans import loan_applications
    df = loan_applications(spark, sf)
    f = FeatureSet(LOAN_FEATURES).fit(df)
    out = f.transform(df)
    assert out.count() == df.count() and len(f.columns) == 25


def test_decimal_places_split_scientific_texts_only(spark):
    from lendframe.operators.quality import decimal_places
    want = {"1.0": 1, "0.05": 2, "-12.345": 3, "1.25E7": 1, "1.0E-5": 5, "1.25E-5": 7, "NaN": 1, "-Infinity": 1, "0.0": 1, "17": 1, None: 1}
    df = spark.createDataFrame([(k,) for k in want], "t string").withColumn("places", decimal_places(F.col("t")))
    assert {r["t"]: r["places"] for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN (instr") < plan.index("split")


def test_yeo_johnson_sums_of_tasks(spark):
    x = np.concatenate([np.random.default_rng(1).normal(3, 5, 500), [0.0, -0.0, 1e6]])
    df = spark.createDataFrame([(float(v), 0.1, None, float(i)) for i, v in enumerate(x)], "x double, same double, gone double, id double").repartition(5, "id")
    lams = np.array([-1.0, 0.0, 0.5, 1.0, 2.0, 3.0])
    got = {(r["i"], r["k"]): r for r in scale._yeo_johnson_sums(df.select("x", "same", "gone"), [lams] * 3).collect()}
    assert {i for i, _ in got} == {0, 1}
    for k, lam in enumerate(lams):
        pos, neg = x[x >= 0], x[x < 0]
        y = np.concatenate([np.log1p(pos) if lam == 0 else ((pos + 1) ** lam - 1) / lam,
                            -np.log1p(-neg) if lam == 2 else -((1 - neg) ** (2 - lam) - 1) / (2 - lam)])
        assert got[0, k]["n"] == len(x) and math.isclose(got[0, k]["v"], y.var(), rel_tol=1e-9)
        assert math.isclose(got[0, k]["j"], np.sum(np.sign(x) * np.log1p(np.abs(x))), rel_tol=1e-9)
        assert got[1, k]["v"] == 0.0  # no variance, so no likelihood


def test_packed_trees_walk_like_their_nodes():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 2)), 1)
    for limit in (0, 3, 8):
        tree = forest._grow(x, rng, limit)
        f, s, child, value, depth = forest._packed(tree)
        for row in [*x[:50], np.array([np.nan, 0.0]), np.array([-9.0, 9.0])]:
            at, steps = 0, 0
            while tree[at][0] >= 0:
                at, steps = tree[at][2 if row[tree[at][0]] < tree[at][1] else 3], steps + 1
            node = 0
            for _ in range(depth):
                node = child[2 * node + int(row[f[node]] < s[node])]
            assert node == at and value[node] == steps + forest._average_depth([tree[at][4]])[0]


def test_isolation_samples_and_stored_scores(spark):
    from lendframe.operators.ranking import hash_fraction, hash_key
    df = spark.range(0, 2000).select(F.col("id"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    share = 1.5 * 64 / 2000
    want = [min(64, df.where(hash_fraction(hash_key("id", f"7-{t}")) < share).count()) for t in range(3)]
    assert [tree[0][4] for tree in forest.fit_forest(df, ["x"], "id", trees=3, sample=64, seed=7)] == want
    whole = forest.fit_forest(df.limit(50), ["x"], "id", trees=2, sample=50)
    assert [tree[0][4] for tree in whole] == [50, 50]
    out = forest.isolation_outliers(df, ["x"], "id", trees=3, sample=64)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan  # the scores are read, not made again
