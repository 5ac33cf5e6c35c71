"""Model queries (L): feature sets, folds, metrics, and pyspark.ml models over the legs."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from waypath.functions import buckets
from waypath.operators import boosting, features, learning, metrics, ranks, recurrent
from waypath.plans.features import FEATURED, featured
from waypath.plans.legs import CHAINED, LEGS, Registry, chained
from waypath.session import SMALL_GROUPS, cut, scratch, table, uncut
from waypath.sources import readers

query = Registry()
QUERIES, SQL = query.queries, query.sql

NUMERIC = ["dep_hour", "weekday", "month", "distance", "wind", "prev1_arr_delay", "prev2_arr_delay", "turnaround"]
#: Leg id and tail together name a leg.
KEY = ["leg_id", "tail"]


def frame(spark, d):
    """The modeling frame: completed legs with features, a label and a year, written once by year.

    Windows run over all years once; each fold then reads only its years.
    """
    x = chained(spark, d).where("arr_delay is not null")
    x = x.select(
        *KEY, "carrier", F.year("day").alias("year"), (F.col("arr_delay") > 15).cast("int").alias("label"), "arr_delay",
        F.hour("dep_ts").cast("double").alias("dep_hour"), (F.weekday("day") + 1).cast("double").alias("weekday"), F.month("day").cast("double").alias("month"),
        "distance", "wind", "dep_delay", "prev1_arr_delay", "prev2_arr_delay", F.col("turnaround").cast("double").alias("turnaround"),
    )
    path = scratch(spark, "frame")
    x.write.options(**SMALL_GROUPS).partitionBy("year").parquet(path)
    return spark.read.parquet(path)


def split(x):
    return x.where("year < 2000"), x.where("year >= 2000")


def _score():
    """A closed form of a leg's own departure delay and the arrival delay before it, as known once it has left: good for exact metrics."""
    return F.round(F.least(F.greatest(0.5 + F.col("dep_delay") / 100 + F.coalesce("prev1_arr_delay", F.lit(0.0)) / 400, F.lit(0.0)), F.lit(1.0)), 6)


_SCORED = f"""{CHAINED}, p AS (SELECT CAST(arr_delay > 15 AS INTEGER) AS label, arr_delay, dep_delay,
 round(least(greatest(0.5 + dep_delay / 100 + coalesce(prev1_arr_delay, 0) / 400, 0.0), 1.0), 6) AS score FROM chained WHERE arr_delay IS NOT NULL)"""


def _scored(spark, d):
    return chained(spark, d).where("arr_delay is not null").select((F.col("arr_delay") > 15).cast("int").alias("label"), "arr_delay", "dep_delay", _score().alias("score"))


#: Rounded, as sums of the same values in another order differ in the last digit.
_R = lambda f: f"round({f}, 4) AS {f}"


@query(f"""WITH {FEATURED} SELECT leg_id, tail, {", ".join(map(_R, features.ALL))} FROM featured""")
def L01_feature_sets(spark, d):
    """Every leg with all features of the eight sets (``features.SETS``)."""
    return featured(spark, d).select(*KEY, *(F.round(f, 4).alias(f) for f in features.ALL))


@query(f"""WITH {LEGS}, y AS (SELECT DISTINCT year(day) AS y FROM legs) SELECT a.y AS test, (SELECT list(b.y ORDER BY b.y) FROM y b WHERE b.y < a.y) AS train FROM y a WHERE (SELECT count(*) FROM y b WHERE b.y < a.y) >= 4""")
def L02_rolling_years(spark, d):
    from waypath.plans.legs import legs

    years = [r[0] for r in legs(spark, d).select(F.year("day").alias("y")).distinct().orderBy("y").collect()]
    return spark.createDataFrame([(f.test, list(f.train)) for f in learning.expanding(years, 4)], "test long, train array<long>")


@query("""WITH m AS (SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS m FROM orders)
SELECT year, m AS test, (SELECT list(b.m ORDER BY b.m) FROM m b WHERE b.year = a.year AND b.m < a.m) AS train FROM m a WHERE (SELECT count(*) FROM m b WHERE b.year = a.year AND b.m < a.m) >= 3""")
def L03_expanding_months(spark, d):
    """Folds inside each year: a month is tested on the months before it, three at least."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("m")).distinct()
    return learning.expanding_in(o, "year", "m", 3)


@query(f"""WITH {CHAINED} SELECT CASE WHEN year(day) < 1999 THEN 'train' WHEN year(day) < 2000 THEN 'validation' ELSE 'test' END AS part, count(*) AS n FROM chained WHERE arr_delay IS NOT NULL GROUP BY 1""")
def L04_year_splits(spark, d):
    y = F.col("year")
    return frame(spark, d).groupBy(F.when(y < 1999, "train").when(y < 2000, "validation").otherwise("test").alias("part")).agg(F.count("*").alias("n"))


def _fit(spark, d, estimator, categories=("carrier",)):
    train, test = split(frame(spark, d))
    return learning.fitted(learning.pipeline(NUMERIC, list(categories), estimator), train), test


def _prepared(spark, d, categories=("carrier",)):
    """Both parts with their features, label and delay, worked out and written once for several estimators."""
    return learning.prepared(learning.pipeline(NUMERIC, list(categories), None), *split(frame(spark, d)), ["label", "arr_delay"])


def _report(spark, model, test, name):
    got = learning.evaluated(model, test, "label")
    return spark.createDataFrame([(name, *map(float, got.values()))], "model string, " + ", ".join(f"{k} double" for k in got))


@query()
def L05_boosted_trees(spark, d):
    model, test = _fit(spark, d, GBTClassifier(labelCol="label", maxIter=5, maxDepth=3, seed=1))
    return _report(spark, model, test, "boosted")


@query()
def L05_boosted_by_year(spark, d):
    """Trees that go on from year to year: each training year's loss before and after its trees, and the AUC on the test years."""
    x = frame(spark, d)
    years = [y for y in readers.partitions(x, "year") if y < 2000]
    train, test = split(x)
    base = learning.fitted(learning.pipeline(NUMERIC, [], None), train)
    model = boosting.by_year(base.transform(train), "year", years, "label", rounds=12)
    auc = metrics.auc(model.scored(base.transform(test)), "label", "score").first()[0]
    rows = [(y, n, *model.losses[y], auc) for y, n in zip(years, boosting.shares(12, len(years)), strict=True) if y in model.losses]
    return spark.createDataFrame(rows, "year int, trees int, before double, after double, auc double")


@query()
def L06_batch_predict(spark, d):
    model, test = _fit(spark, d, LogisticRegression(labelCol="label", maxIter=10))
    return learning.scored(model, test).select(*KEY, "year", F.round("score", 6).alias("score"))


@query()
def L07_grid_search(spark, d):
    x = frame(spark, d)
    years = readers.partitions(x, "year")
    folds = list(learning.expanding(years, 4))
    build = lambda c: LogisticRegression(labelCol="label", maxIter=5, regParam=c["reg"])
    return spark.createDataFrame(learning.search(x, "year", folds, learning.grid(reg=[0.0, 0.1]), learning.pipeline(NUMERIC, [], None), build, "label"))


@query()
def L08_refit_importances(spark, d):
    model, _ = _fit(spark, d, RandomForestClassifier(labelCol="label", numTrees=5, maxDepth=4, seed=1), categories=())
    return spark.createDataFrame([(n, float(v)) for n, v in zip(NUMERIC, model.stages[-1].featureImportances.toArray(), strict=True)], "feature string, importance double")


@query(f"""WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p),
a AS (SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r),
c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) AS n, count(*) FILTER ((score >= 0.5) = (label = 1)) AS ok,
 avg(abs(arr_delay - dep_delay)) AS mae, sqrt(avg((arr_delay - dep_delay) ** 2)) AS rmse FROM p)
SELECT round(auc, 6) AS auc, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(ok / n, 6) AS accuracy, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM a, c""")
def L09_metrics(spark, d):
    p = cut(_scored(spark, d), "scored")  # four narrow columns: the windows run once for the three
    r = lambda c: F.round(c, 6).alias(c)
    one = metrics.auc(p, "label", "score").join(metrics.classification(p, "label", "score")).join(metrics.regression(p, "arr_delay", "dep_delay"))
    return one.select(*map(r, ("auc", "f1", "precision", "recall", "accuracy", "mae", "rmse")))


@query(f"""WITH {_SCORED}, s AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM p GROUP BY 1)
SELECT score, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr FROM s WINDOW w AS (ORDER BY score DESC)""")
def L10_roc_points(spark, d):
    return metrics.roc(_scored(spark, d), "label", "score").select("score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query()
def L11_recurrent(spark, d):
    """A recurrent network with two heads over sequences of three legs: the class and the delay."""
    x = cut(featured(spark, d).select(F.year("day").alias("year"), "arr_delay", *features.SHOWN), "featured")  # the windows run once
    fill = {c: q[0] for c, q in ranks.quantiles(x, list(features.TWO_HOP), [0.5]).items() if q[0] is not None}
    train, test = split(x.select("year", (F.col("arr_delay") > 15).cast("int").alias("label"), "arr_delay", features.sequences(x, "context_full", fill).alias("steps")))
    got = cut(recurrent.fit(train, "label", "arr_delay").scored(test), "scored")
    e = metrics.regression(got, "arr_delay", "predicted").first()
    auc = metrics.auc(got, "label", "score").first()[0]
    for used in (x, got):
        uncut(used)
    return spark.createDataFrame([("recurrent", auc, e["mae"], e["rmse"])], "model string, auc double, mae double, rmse double")


@query()
def L11_perceptron(spark, d):
    """Two heads over the frame's flat columns: a perceptron of one hidden layer for the class and a linear
    regression for the delay. No state is carried over steps."""
    train, test = split(frame(spark, d))
    net = MultilayerPerceptronClassifier(labelCol="label", featuresCol="scaled", layers=[len(NUMERIC), 6, 2], maxIter=5, seed=1)
    delay = LinearRegression(labelCol="arr_delay", featuresCol="scaled", predictionCol="delay", maxIter=10)
    base = learning.pipeline(NUMERIC, [], StandardScaler(inputCol="features", outputCol="scaled"))
    model = learning.fitted(Pipeline(stages=[*base.getStages(), net, delay]), train)
    e = metrics.regression(model.transform(test), "arr_delay", "delay").first()
    got = learning.evaluated(model, test, "label")
    return spark.createDataFrame([("perceptron", *map(float, got.values()), e["mae"], e["rmse"])], "model string, " + ", ".join(f"{k} double" for k in (*got, "mae", "rmse")))


@query()
def L12_baselines(spark, d):
    """Logistic regression and forest for the class (AUC), linear regression and forest for the delay (errors)."""
    train, test = _prepared(spark, d)
    forest = {"numTrees": 5, "maxDepth": 4, "seed": 1}
    classes = {"logistic": LogisticRegression(labelCol="label", maxIter=10), "forest": RandomForestClassifier(labelCol="label", **forest)}
    delays = {"linear": LinearRegression(labelCol="arr_delay", maxIter=10), "forest_delay": RandomForestRegressor(labelCol="arr_delay", **forest)}
    fit = lambda m: learning.fitted(m, train)
    rows = [(n, learning.evaluated(fit(m), test, "label")["auc"], None, None) for n, m in classes.items()]
    rows += [(n, None, *metrics.regression(fit(m).transform(test), "arr_delay", "prediction").first()) for n, m in delays.items()]
    return spark.createDataFrame(rows, "model string, auc double, mae double, rmse double")


@query()
def L13_elastic_net(spark, d):
    """Ridge, elastic net and lasso; a generalised linear model; and a regression on principal components."""
    train, test = _prepared(spark, d, ())
    linear = lambda mix: LinearRegression(labelCol="arr_delay", regParam=0.1, elasticNetParam=mix, maxIter=10)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    models = {"ridge": linear(0.0), "elastic": linear(0.5), "lasso": linear(1.0), "glm": GeneralizedLinearRegression(labelCol="arr_delay", family="gaussian", link="identity", maxIter=10)}
    models["components"] = Pipeline(stages=[scaled, PCA(k=5, inputCol="scaled", outputCol="pc"), LinearRegression(labelCol="arr_delay", featuresCol="pc", maxIter=10)])
    rows = [(n, *metrics.regression(learning.fitted(m, train).transform(test), "arr_delay", "prediction").first()) for n, m in models.items()]
    return spark.createDataFrame(rows, "model string, mae double, rmse double")


@query()
def L14_kmeans(spark, d):
    """Four clusters, and the means of their features."""
    x = frame(spark, d).fillna(0.0)
    base = [VectorAssembler(inputCols=NUMERIC, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled"), KMeans(k=4, seed=1, featuresCol="scaled", predictionCol="cluster", maxIter=5)]
    return learning.fitted(Pipeline(stages=base), x).transform(x).groupBy("cluster").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in NUMERIC))


@query()
def L14_model_family(spark, d):
    """A binomial GLM, a tree, a forest over classes of equal weight, and boosted trees, by AUC."""
    train, test = _prepared(spark, d)
    models = {
        "glm": GeneralizedLinearRegression(labelCol="label", family="binomial", link="logit", maxIter=10, predictionCol="probability_1"),
        "tree": DecisionTreeClassifier(labelCol="label", maxDepth=5, seed=1),
        "balanced_forest": RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=5, maxDepth=4, seed=1),
        "boosted": GBTClassifier(labelCol="label", maxIter=5, maxDepth=3, seed=1),
    }
    train, rows = learning.balanced(train, "label", "weight"), []
    for name, m in models.items():
        fitted = learning.fitted(m, train)
        p = fitted.transform(test).withColumn("score", F.col("probability_1")) if name == "glm" else learning.scored(fitted, test)
        rows.append((name, metrics.auc(p.select("label", "score"), "label", "score").first()[0]))
    return spark.createDataFrame(rows, "model string, auc double")


@query()
def L15_pca(spark, d):
    x = frame(spark, d).fillna(0.0)
    stages = [VectorAssembler(inputCols=NUMERIC, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), PCA(k=5, inputCol="scaled", outputCol="pc")]
    got = learning.fitted(Pipeline(stages=stages), x).transform(x).withColumn("v", vector_to_array("pc"))
    return got.select(*KEY, "label", *(F.round(F.col("v")[i], 4).alias(f"pc{i + 1}") for i in range(5)))


@query("SELECT event_id, CAST(value > (SELECT median(value) FROM events) AS INTEGER) AS label FROM events")
def L16_median_label(spark, d):
    e = table(spark, d, "events")
    m = ranks.quantiles(e, ["value"], [0.5])["value"][0]
    return e.select("event_id", (F.col("value") > m).cast("int").alias("label"))


@query(f"""WITH {CHAINED} SELECT leg_id, origin, dest, round(prev1_arr_delay, 4) AS prev1_arr_delay, round(prev2_arr_delay, 4) AS prev2_arr_delay FROM chained WHERE tail = 7 AND origin = (SELECT min(origin) FROM chained WHERE tail = 7) AND day >= DATE '1996-01-01' ORDER BY dep_ts, leg_id LIMIT 1""")
def L17_point_lookup(spark, d):
    """One tail from a day on: the first leg with its chain. The tail is pushed below the windows."""
    x = chained(spark, d).where("tail = 7")
    first = x.agg(F.min("origin")).first()[0]
    got = x.where((F.col("origin") == first) & (F.col("day") >= F.to_date(F.lit("1996-01-01")))).orderBy("dep_ts", "leg_id").limit(1)
    return got.select("leg_id", "origin", "dest", F.round("prev1_arr_delay", 4).alias("prev1_arr_delay"), F.round("prev2_arr_delay", 4).alias("prev2_arr_delay"))


def _synthetic_sql(model: str, base: float) -> str:
    return f"least(0.97, greatest(0.05, {base} + least((p1 + p2) / 160.0, 1.0) * 0.18 + CASE WHEN abs(t) > 5 THEN 0.04 ELSE 0.0 END + CASE WHEN w > 10 THEN 0.03 ELSE 0.0 END + sin({len(model) * 7} + p1) * 0.06))"


@query(f"""WITH {CHAINED}, f AS (SELECT leg_id, tail, prev1_arr_delay AS p1, prev2_arr_delay AS p2, dep_delay AS t, wind * 200 AS w FROM chained WHERE prev2_arr_delay IS NOT NULL AND prev1_arr_delay IS NOT NULL AND dep_delay IS NOT NULL),
s AS (SELECT leg_id, tail, round({_synthetic_sql('boosted', 0.6)}, 4) AS a, round({_synthetic_sql('net', 0.58)}, 4) AS b FROM f) SELECT leg_id, tail, a, b, round((a + b) / 2, 6) AS mean FROM s""")
def L18_synthetic_scorer(spark, d):
    p1, p2, t, w = F.col("prev1_arr_delay"), F.col("prev2_arr_delay"), F.col("dep_delay"), F.col("wind") * 200
    x = chained(spark, d).dropna(subset=["prev1_arr_delay", "prev2_arr_delay", "dep_delay"])
    a, b = (buckets.synthetic_score(m, base, p1, p2, t, w)[0] for m, base in (("boosted", 0.6), ("net", 0.58)))
    return x.select("leg_id", "tail", a.alias("a"), b.alias("b")).withColumn("mean", F.round((F.col("a") + F.col("b")) / 2, 6))


@query()
def L19_preprocessing(spark, d):
    """Medians, most frequent category codes and one-hot vectors, learned from the training years."""
    train, test = split(frame(spark, d))
    got = learning.fitted(learning.pipeline(NUMERIC, ["carrier"], StandardScaler(inputCol="features", outputCol="scaled")), train).transform(test)
    return got.select(*KEY, F.size(vector_to_array("scaled")).alias("width"), F.round("turnaround_filled", 4).alias("turnaround"))


@query()
def L20_tree_comparison(spark, d):
    train, test = _prepared(spark, d)
    rows = []
    models = {"tree_3": DecisionTreeClassifier(labelCol="label", maxDepth=3, seed=1), "tree_5": DecisionTreeClassifier(labelCol="label", maxDepth=5, seed=1)}
    models |= {"forest": RandomForestClassifier(labelCol="label", numTrees=10, maxDepth=5, seed=1), "boosted": GBTClassifier(labelCol="label", maxIter=5, maxDepth=3, seed=1)}
    for name, m in models.items():
        p = cut(learning.scored(learning.fitted(m, train), test).select("label", "score"), "scored")
        rows.append((name, metrics.auc(p, "label", "score").first()[0], metrics.pr_auc(p, "label", "score").first()[0]))
        uncut(p)
    return spark.createDataFrame(rows, "model string, auc double, pr_auc double")


@query()
def L21_permutation_importance(spark, d):
    model, test = _fit(spark, d, LogisticRegression(labelCol="label", maxIter=5), categories=())
    whole = learning.evaluated(model, test, "label")["auc"]
    rows = learning.importances(model, test, "label", NUMERIC, whole, repeats=5)
    return spark.createDataFrame(rows, "feature string, auc_drop double")


@query("SELECT depth, rate FROM (VALUES (3), (5), (7)) a(depth), (VALUES (0.1::DOUBLE), (0.3::DOUBLE)) b(rate)")
def L22_grid(spark, d):
    return spark.createDataFrame(learning.grid(depth=[3, 5, 7], rate=[0.1, 0.3]), "depth int, rate double")
