"""Models on the middle folder: sense, repeatability and the same scores from the saved tables in SQL."""

from __future__ import annotations

import pickle

import duckdb
import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.operators import boosting as B
from riskloom.operators import training as T
from riskloom.plans import model_queries as Q
from riskloom.plans.book import loans
from tests.conftest import MEDIUM, SMALL

FEW = B.Growth(12, 4, 0.1, rows=0.8, columns=0.8, least_cover=5.0, gamma=0.1, l1=0.1, l2=1.0)


@pytest.fixture(scope="module")
def small_rows(spark, small_loans):
    return T.pd_rows(small_loans).persist()


@pytest.fixture(scope="module")
def boosted(spark):
    return Q.trained(spark, MEDIUM, "boosted")


def test_pd_ranks_better_than_chance(boosted):
    assert boosted.metrics["auc"] > 0.6
    assert boosted.metrics["gini"] == pytest.approx(2 * boosted.metrics["auc"] - 1, abs=2e-6)


def test_scorecard_signs(spark):
    weights = {r["feature"]: r["coeficiente"] for r in T.coefficients(Q.trained(spark, MEDIUM, "scorecard"), spark).collect()}
    assert set(weights) == set(K.PD_FEATURES) and weights["dti"] > 0


def test_regressors_have_errors(spark):
    assert Q.trained(spark, MEDIUM, "lgd").metrics["rmse"] < 0.3 and Q.trained(spark, MEDIUM, "ead").metrics["r2"] > 0.5


def test_as_many_trees_as_the_models_to_match(spark, boosted):
    for t, trees in ((boosted, 800), (Q.trained(spark, MEDIUM, "lgd"), 200), (Q.trained(spark, MEDIUM, "ead"), 150)):
        assert {n[0] for n in t.model.nodes} == set(range(trees))


def test_calibrated_mean_is_near_the_default_rate(spark, boosted):
    test = T.pd_rows(loans(spark, MEDIUM)).filter("fold = 'test'")
    row = T.with_probability(boosted.model, test).agg(F.avg("score").alias("p"), F.avg("label").alias("y")).first()
    assert row["p"] == pytest.approx(row["y"], abs=0.05)


def test_whole_book_is_scored(spark):
    df = Q.model_scores(spark, MEDIUM)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.min("pd").alias("lo"), F.max("pd").alias("hi"), F.min("ccf").alias("c0"), F.max("ccf").alias("c1")).first()
    assert row["n"] == loans(spark, MEDIUM).count()
    assert 0.001 <= row["lo"] <= row["hi"] <= 0.999 and 0 <= row["c0"] <= row["c1"] <= 1


def test_importance_adds_up(spark):
    rows = Q.importance(spark, MEDIUM).collect()
    assert {r["feature"] for r in rows} == set(K.PD_FEATURES)
    for c in ("gain", "cover", "weight"):
        assert sum(r[c] for r in rows) == pytest.approx(1.0)


def test_runs_are_logged_once_a_model(spark):
    rows = Q.run_log(spark, MEDIUM).collect()
    assert sorted(r["experiment"] for r in rows) == [f"credit_risk_{n}" for n in ("ead", "lgd", "pd", "scorecard")]


# --- the booster itself --------------------------------------------------------------
MARGIN_SQL = """
WITH RECURSIVE x AS (
  SELECT loan_id, name, value FROM (UNPIVOT rows ON COLUMNS(* EXCLUDE (loan_id, p)) INTO NAME name VALUE value)
), walk AS (
  SELECT r.loan_id, n.tree, n.node, n.feature, n.threshold, n.value FROM rows AS r JOIN nodes AS n ON n.node = 1
  UNION ALL
  SELECT w.loan_id, n.tree, n.node, n.feature, n.threshold, n.value
  FROM walk AS w JOIN x ON x.loan_id = w.loan_id AND x.name = w.feature
  JOIN nodes AS n ON n.tree = w.tree AND n.node = 2 * w.node + CASE WHEN x.value > w.threshold THEN 1 ELSE 0 END
)
SELECT loan_id, sum(value) AS margin FROM walk WHERE feature IS NULL GROUP BY loan_id
"""


def test_saved_trees_give_the_same_scores_in_sql(spark, small_rows, tmp_path):
    model = T.train_boosted_pd(small_rows, growth=FEW)
    model.save(f"{tmp_path}/model", spark)
    again = T.load_model(f"{tmp_path}/model")
    assert again == model
    scored = small_rows.withColumn("p", again.score()).select("loan_id", "p", *(B._filled(f, m).alias(f) for f, m in zip(again.features, again.medians)))
    scored.write.parquet(f"{tmp_path}/rows")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW rows AS FROM '{tmp_path}/rows/*.parquet'")
    con.execute(f"CREATE VIEW nodes AS FROM '{tmp_path}/model/nodes/*.parquet'")
    a, b = again.platt
    wrong = con.execute(f"""SELECT count(*) FILTER (abs(p - 1 / (1 + exp(-({a!r} / (1 + exp(-margin)) + {b!r})))) > 1e-12), count(*)
        FROM ({MARGIN_SQL}) JOIN rows USING (loan_id)""").fetchall()
    assert wrong == [(0, small_rows.count())]


def brute_trees(x, y, w, h, edges, how, objective="logistic"):
    """The same trees grown the plain way, node by node, on float sums."""
    slots = np.stack([np.searchsorted(e, v, "left") for e, v in zip(edges, x, strict=True)])
    margin, out = np.full(len(y), 0.0 if objective == "logistic" else y.mean()), []
    for t in range(how.trees):
        rows = B._drawn(h, t, how.seed, how.rows)
        g, s = B._gradients(objective, y, w, margin)
        chosen = sorted(np.random.default_rng([how.seed, t]).permutation(len(edges))[: max(1, round(how.columns * len(edges)))].tolist())
        value = np.zeros(len(y))

        def worth(r):
            return max(abs(g[r].sum()) - how.l1, 0) ** 2 / (s[r].sum() + how.l2)

        def grow(node, sample, everyone, depth):
            best = (max(1e-6, how.gamma), None)
            for f in chosen if depth < how.depth else ():
                for cut in range(len(edges[f])):
                    left = slots[f, sample] <= cut
                    a, b = sample[left], sample[~left]
                    if min(s[a].sum(), s[b].sum()) >= how.least_cover:
                        gain = worth(a) + worth(b) - worth(sample)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
            if best[1] is None:
                total = g[sample].sum()
                value[everyone] = -how.step * np.sign(total) * max(abs(total) - how.l1, 0) / (s[sample].sum() + how.l2)
                out.append((t, node, None, None, value[everyone[0]] if len(everyone) else None))
                return
            f, cut = best[1]
            out.append((t, node, f, edges[f][cut], None))
            for child, keep in ((2 * node, lambda r: slots[f, r] <= cut), (2 * node + 1, lambda r: slots[f, r] > cut)):
                grow(child, sample[keep(sample)], everyone[keep(everyone)], depth + 1)

        grow(1, rows, np.arange(len(y)), 0)
        margin = margin + value
    return out


@pytest.mark.parametrize("lead", [1 << 17, 60])
@pytest.mark.parametrize("objective", ["logistic", "squared"])
def test_trees_by_brute_force(spark, monkeypatch, lead, objective):
    monkeypatch.setattr(B, "LEAD_ROWS", lead)  # few rows guess badly, which must not change the trees
    monkeypatch.setattr(B, "MOVE", 2)
    monkeypatch.setattr(B, "CHECKPOINT", 2)
    r = np.random.default_rng(5)
    n, features = 700, ["a", "b", "c"]
    x = np.stack([r.normal(size=n).round(1), r.integers(0, 4, n).astype(float), np.zeros(n)])
    y = (x[0] + x[1] + r.normal(size=n) > 1).astype(float) if objective == "logistic" else x[0] * x[1] + r.normal(size=n)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[:, i])) for i in range(n)], "loan_id long, label double, a double, b double, c double")
    how = B.Growth(5, 3, 0.3, rows=0.7, columns=0.7, least_cover=2.0, gamma=0.05, l1=0.05, l2=0.5)
    weight = F.when(F.col("label") == 1, 2.0).otherwise(1.0)
    model = B.fit(df.repartition(3), features, how, objective=objective, weight=weight)
    order = df.select(F.xxhash64("loan_id", F.lit(how.seed)).alias("h")).toPandas()["h"].to_numpy().view(np.uint64)
    _, edges = B._cuts(df, features)
    want = brute_trees(x, y, np.where(y == 1, 2.0, 1.0), order, edges, how, objective)
    got = {(t, node): (f, limit, value) for t, node, f, limit, _, _, value in model.nodes}
    assert set(got) == {(t, node) for t, node, *_ in want}
    for t, node, f, limit, value in want:
        name, threshold, weight = got[t, node]
        assert name == (None if f is None else features[f]) and threshold == limit
        assert value is None or weight == pytest.approx(value, abs=1e-9)


def test_same_trees_however_the_rows_lie(spark, small_rows):
    train = small_rows.filter("fold = 'train'")
    models = [B.fit(df, K.PD_FEATURES, FEW, objective="logistic") for df in (train, train.repartition(7), train.coalesce(1).orderBy("dti"))]
    assert models[0].nodes and all(m == models[0] for m in models)


def test_no_rows_and_one_class_fit(spark, small_rows):
    train = small_rows.filter("fold = 'train'")
    assert B.fit(train.limit(0), K.PD_FEATURES, FEW, objective="logistic").nodes == []
    one = B.fit(train.filter("label = 1"), K.PD_FEATURES, FEW, objective="logistic")
    assert small_rows.select(one.score().alias("p")).filter("p <= 0.5").count() == 0


def test_training_on_a_sample_with_a_load(spark, small_loans, tmp_path):
    out = T.run_training(spark, small_loans, ("pd",), f"{tmp_path}/m", sample=600, load_to=f"{tmp_path}/loaded", pd={"growth": FEW})
    assert set(out) == {"pd", "scorecard"}
    loaded = spark.read.parquet(f"{tmp_path}/loaded")
    assert loaded.count() == 600 and {"term", "fico_range_low"} <= set(loaded.columns) and "fico_avg" not in loaded.columns


def test_without_a_model_the_formula_scores(spark):
    assert T.load_model("/tmp/there-is-no-such-model") is None
    x = T.with_ead(T.with_lgd(T.with_pd(Q.model_requests(spark, SMALL), None), None), None)
    assert x.count() == loans(spark, SMALL).count()
    assert x.first()["model"] == "analytic" and {"pd", "lgd", "ead", "ccf", "int_rate"} <= set(x.columns)


def test_too_few_defaults_give_no_model(spark):
    assert T.train_lgd(loans(spark, SMALL)).model is None


@pytest.mark.parametrize("task_rows", [0, 90, 1 << 19])
def test_same_trees_by_levels_and_by_nodes(spark, small_rows, monkeypatch, task_rows):
    train = small_rows.filter("fold = 'train'").repartition(3)
    want = B.fit(train, K.PD_FEATURES, FEW, objective="logistic")
    monkeypatch.setattr(B, "LEAD_ROWS", 0)
    monkeypatch.setattr(B, "LEAST_PART", 100)
    monkeypatch.setattr(B, "TASK_ROWS", task_rows)
    assert B.fit(train, K.PD_FEATURES, FEW, objective="logistic") == want and want.nodes


def test_the_driver_gets_splits_and_no_tables(spark):
    r = np.random.default_rng(3)
    slots = B._Slots.of([0, 1, 2], [np.arange(255.0)] * 3)
    rows = [(r.integers(0, 256, (3, 900)).astype(np.uint8), r.integers(-9, 9, (2, 900)).astype(float) ** 2) for _ in range(40)]
    parts = spark.sparkContext.parallelize(rows, 40)
    tree, nodes = B._Tree.empty(3), list(range(1, 8))
    tree.cut[1:4] = 120
    found = B._splits(parts, tree, nodes, slots, B.Growth(1, 3, 0.1), 1.0)
    assert sorted(found) == nodes and found[1][0] == 36000
    assert len(pickle.dumps(found)) < 10_000  # the tables of a task have 7 nodes, 768 slots and 2 sums


def test_more_trees_take_no_more_jobs(spark, small_rows):
    train, jobs = small_rows.filter("fold = 'train'"), []
    for trees in (2, 12):
        spark.sparkContext.setJobGroup(f"{trees} trees", "fit")
        B.fit(train, K.PD_FEATURES, B.Growth(trees, 4, 0.1, rows=0.8), objective="logistic")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{trees} trees")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_features_counted_as_one():
    sizes = [256, 2, 1, 87, 256, 20, 54, 11, 4096]
    packs = B._packs(sizes)
    assert sorted(f for p in packs for f in p) == list(range(9)) and len(packs) < 7
    assert all(len(p) == 1 or np.prod([sizes[f] for f in p]) <= B.PACK_SLOTS for p in packs)
    r = np.random.default_rng(8)
    edges = [np.arange(255.0), np.zeros(0), np.arange(1.0), np.arange(6.0)]
    x = np.stack([r.integers(0, len(e) + 1, 70_000) for e in edges]).astype(np.uint8)
    rows = B._Whole(iter([(x, *np.zeros((4, 70_000)))]), "squared", edges)
    some, sums = np.flatnonzero(r.random(70_000) < 0.6), r.integers(-99, 99, (2, 70_000)).astype(float)
    for chosen in ([0, 1, 2, 3], [2, 3], [1]):
        slots = B._Slots.of(chosen, edges)
        want = B._count([x[f][some] for f in chosen], np.ones(len(some), np.int64), sums[:, some], [1], slots)[:, 0]
        assert np.array_equal(rows._table(some, sums, slots), want)


def test_a_scorecard_scores_after_an_observation(spark, small_rows):
    seen = Observation("rows")
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    scored = T.with_probability(T.train_scorecard(small_rows), small_rows)
    assert scored.filter("score BETWEEN 0 AND 1").count() == small_rows.count()
