"""Learning operators: a classifier of filings, its measures, clusters and outliers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import HashingTF, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, table
from .relational import running
from .similarity import terms

#: Rows are dealt to folds within so many ranges of hashes of each class, so no class is one task.
FOLD_RANGES = 64
NUMBERS = ["total_revenue", "total_expenses", "total_assets", "total_volunteers", "total_salaries"]


def grouped_split(df: DataFrame, group: str, share: float = 0.25, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): whole groups go to one side, by a hash."""
    test = F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return df.where(~test), df.where(test)


def temporal_split(df: DataFrame, group: str, year: str, first_test_year: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): later years are the test; groups in it are taken from the train side."""
    test = df.where(F.col(year) >= first_test_year)
    return df.where(F.col(year) < first_test_year).join(test.select(group).distinct(), group, "left_anti"), test


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0..k-1; in each class the folds differ by one row at most in each range of hashes, so by few in all."""
    dealt = df.withColumn("__h", F.xxhash64(key, F.lit(seed)))
    dealt = dealt.withColumn("__range", F.pmod(F.shiftright("__h", 32), F.lit(FOLD_RANGES)))
    place = F.row_number().over(Window.partitionBy(label, "__range").orderBy("__h", key))
    return dealt.withColumn("fold", F.pmod(place + F.col("__range"), F.lit(k)).cast("int")).drop("__h", "__range")


def with_gaps_filled(train: DataFrame, test: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Medians of ``train`` for missing numbers on both sides, log-scaled, with a column that says where one was missing."""
    names = [f"{c}_filled" for c in columns]
    log = lambda df: df.select("*", *[F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(f"{c}_log") for c in columns], *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in columns])
    train, test = log(train), log(test)
    model = Imputer(strategy="median", inputCols=[f"{c}_log" for c in columns], outputCols=names).fit(train)
    return model.transform(train), model.transform(test), [*names, *[f"{c}_missing" for c in columns]]


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight`` so that both classes weigh the same."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    w = n.crossJoin(total).select(label, (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))
    return df.join(F.broadcast(w), label)


def classify(train: DataFrame, test: DataFrame, label: str, text: str | None, numbers: list[str], boosted: bool = False) -> DataFrame:
    """``test`` with ``score``, the probability of the label, by balanced logistic regression (or boosted trees) on term counts and numbers."""
    train, test, columns = with_gaps_filled(train.where(F.col(label).isNotNull()), test, numbers)
    if text:
        hashed = HashingTF(numFeatures=1 << 12, inputCol="__terms", outputCol="__tf")
        train, test = (hashed.transform(d.withColumn("__terms", terms(F.col(text)))) for d in (train, test))
        columns = [*columns, "__tf"]
    assembler = VectorAssembler(inputCols=columns, outputCol="__raw")
    train, test = assembler.transform(train), assembler.transform(test)
    scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=False).fit(train)
    train, test = balanced(scaler.transform(train), label), scaler.transform(test)
    if boosted:
        learner = GBTClassifier(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=30, stepSize=0.1, maxDepth=4, seed=42)
    else:
        learner = LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", regParam=0.01, maxIter=50)
    scored = learner.fit(train).transform(test)
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("__raw", "__x", "__terms", "__tf", "rawPrediction", "probability", "prediction")


def measures(scored: DataFrame, label: str, score: str = "score", cut_at: float = 0.5, tops: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """(measure, value): ROC area, average precision, Brier score, precision, recall and F1 at a cut, prevalence, and recall among the best.

    Counted once per distinct score, so ties count half; only that many rows are ordered.
    """
    s = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).alias("s"), F.col(label).cast("double").alias("y"))
    by = cut(s.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")))
    cum = running(by, "s", {"p": "tp", "n": "fp"}, descending=True)
    all_ = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    c = cum.crossJoin(all_)
    auc = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.max(F.col("all_p") * F.col("all_n"))
    ap = F.sum(F.col("p") / F.col("all_p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    ranked = c.agg(F.round(auc, 8).alias("roc_auc"), F.round(ap, 8).alias("average_precision"))
    tp, fp, fn = F.sum(F.when(F.col("s") >= cut_at, F.col("p"))), F.sum(F.when(F.col("s") >= cut_at, F.col("n"))), F.sum(F.when(F.col("s") < cut_at, F.col("p")))
    tp, fp, fn = (F.coalesce(x, F.lit(0.0)) for x in (tp, fp, fn))
    at = by.agg(F.round(F.try_divide(tp, tp + fp), 8).alias("precision"), F.round(F.try_divide(tp, tp + fn), 8).alias("recall"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 8).alias("f1"), F.round(F.try_divide(F.sum("p"), F.sum(F.col("p") + F.col("n"))), 8).alias("prevalence"), F.round(F.try_divide(F.sum(F.col("p") * (1 - F.col("s")) ** 2 + F.col("n") * F.col("s") ** 2), F.sum(F.col("p") + F.col("n"))), 8).alias("brier"))
    wide = ranked.crossJoin(at)
    for k in tops:
        best = s.orderBy(F.desc("s"), F.desc("y")).limit(k).agg(F.sum("y").alias("hits")).crossJoin(all_).select(F.round(F.try_divide(F.coalesce("hits", F.lit(0.0)), F.col("all_p")), 8).alias(f"recall_at_{k}"))
        wide = wide.crossJoin(best)
    return wide.unpivot([], wide.columns, "measure", "value")


def scaled(df: DataFrame, columns: list[str], out: str = "__x") -> DataFrame:
    """``df`` (rows with all ``columns``) with a vector of the standardized columns."""
    v = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(df)
    return StandardScaler(inputCol="__v", outputCol=out, withMean=True).fit(v).transform(v).drop("__v")


def clusters(df: DataFrame, columns: list[str], ks: range = range(2, 7), seed: int = 1) -> tuple[DataFrame, int]:
    """(``df`` with ``cluster`` and ``distance`` to its centre, k): k-means with the number of clusters of the best silhouette."""
    v = cut(scaled(df, columns))
    best = None
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster").fit(v)
        fitted = model.transform(v)
        s = ClusteringEvaluator(featuresCol="__x", predictionCol="cluster").evaluate(fitted)
        if best is None or s > best[0]:
            best = (s, k, model)
    _, k, model = best
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    at = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])
    gap = F.zip_with(vector_to_array("__x"), F.get(at, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    return model.transform(v).withColumn("distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))).drop("__x"), k


def farthest(df: DataFrame, distance: str = "distance", share: float = 0.05) -> DataFrame:
    """``df`` with ``anomaly``: whether the distance is above its upper quantile."""
    edge = df.agg(F.percentile(distance, 1 - share).alias("__edge"))
    return df.crossJoin(edge).withColumn("anomaly", F.col(distance) > F.col("__edge")).drop("__edge")


#: Cells of the density grid, to each side, whose links one call looks for.
TILE = 8


def density_clusters(df: DataFrame, key: str, columns: list[str], eps: float = 0.8, least: int = 5) -> DataFrame:
    """(key, cluster): density-based clusters (self counts as a neighbour), NULL for noise; a cluster is named by its smallest core point.

    Equal points count as one with their number. Cells of the grid are so small that all their points are neighbours: in a cell of
    ``least`` points all are core, and the core points of a cell are in one cluster. So only points of cells with fewer meet those
    around them, and clusters are components of cells; cells are linked by any two core points that are neighbours.
    Border points join the smallest cluster near them.
    """
    from .graph import smallest_labels

    v = cut(scaled(df, columns).select(F.col(key).alias("k"), vector_to_array("__x").alias("x")))
    size = len(columns)
    side = eps / np.sqrt(size) * (1 - 1e-9)
    # further columns than three would make too many cells around each: there the distance alone decides
    dims = min(3, size)
    reach = int(np.sqrt(size)) + 1
    around = [o for o in product(range(-reach, reach + 1), repeat=dims) if sum(max(abs(x) - 1, 0) ** 2 for x in o) <= size]
    spots = v.groupBy("x").agg(F.min("k").alias("k"), F.count("*").alias("n")).withColumn("c", F.transform("x", lambda a: F.floor(a / side)))
    spots = cut(spots.withColumn("at", F.slice("c", 1, dims)))
    cells = cut(spots.groupBy("c").agg(F.sum("n").alias("held")))
    spots = cut(spots.join(cells, "c"))
    thin = spots.where(F.col("held") < least).select("k", "x", F.explode(F.array(*[F.array(*[F.lit(x).cast("long") for x in o]) for o in around])).alias("o"), F.col("at").alias("home"))
    thin = thin.select("k", "x", F.zip_with("home", "o", lambda a, b: a + b).alias("at"))
    far = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)
    near = cut(thin.join(spots.select(F.col("k").alias("j"), F.col("x").alias("y"), "n", "at"), "at").where(far <= eps * eps).select("k", "j", "n"))
    met = near.groupBy("k").agg(F.sum("n").alias("met")).where(F.col("met") >= least)
    core = cut(spots.where(F.col("held") >= least).select("k", "x", "c").unionByName(spots.join(met, "k").select("k", "x", "c")))
    if core.isEmpty():
        return v.select(F.col("k").alias(key), F.lit(None).cast(v.schema["k"].dataType).alias("cluster"))
    tile = lambda shift: F.transform(F.slice("c", 1, dims), lambda a: F.floor((a + F.lit(shift)) / TILE))
    tiles = F.array_distinct(F.array(*[F.array(*[F.floor((F.get("c", F.lit(n)) + x) / TILE) for n, x in enumerate(o)]) for o in product((-reach, 0, reach), repeat=dims)]))

    def linked(points: pd.DataFrame) -> pd.DataFrame:
        x, c, own = np.stack(points["x"].to_list()), points["c"].to_list(), points["own"].to_numpy()
        groups: dict[tuple, list[int]] = {}
        for n, k in enumerate(c):
            groups.setdefault(tuple(k), []).append(n)
        rows, flat = {k: np.array(n) for k, n in groups.items()}, {}
        for k in rows:
            flat.setdefault(k[:dims], []).append(k)
        links = []
        for k, a in rows.items():
            if not own[a[0]]:
                continue
            for o in around:
                for other in flat.get(tuple(p + q for p, q in zip(k, o, strict=False)), ()):
                    if other >= k and (other == k or _touch(x[a], x[rows[other]], eps)):
                        links.append((",".join(map(str, k)), ",".join(map(str, other))))
        return pd.DataFrame(links, columns=["src", "dst"])

    laid = core.select("x", "c", F.explode(tiles).alias("tile"), tile(0).alias("home")).withColumn("own", F.col("tile") == F.col("home"))
    links = cut(laid.groupBy("tile").applyInPandas(linked, "src string, dst string"))
    core = core.withColumn("node", F.concat_ws(",", F.transform("c", lambda a: a.cast("string")))).join(smallest_labels(links), "node")
    core = cut(core.select(F.col("k").alias("j"), "component"))
    core = cut(core.join(core.groupBy("component").agg(F.min("j").alias("cluster")), "component").select("j", "cluster"))
    border = near.join(core, "j").groupBy("k").agg(F.min("cluster").alias("by_near"))
    found = spots.select("k", "x").join(core.withColumnRenamed("j", "k"), "k", "left").join(border, "k", "left").select("x", F.coalesce("cluster", "by_near").alias("cluster"))
    return v.join(found, "x").select(F.col("k").alias(key), "cluster")


def _touch(a: np.ndarray, b: np.ndarray, eps: float, step: int = 256) -> bool:
    """Whether any point of ``a`` is within ``eps`` of one of ``b``; points beyond reach of the other's box go first."""
    for _ in range(2):
        gap = np.maximum(np.maximum(b.min(0) - a, a - b.max(0)), 0)
        a, b = b, a[(gap * gap).sum(1) <= eps * eps * (1 + 1e-9)]
        if not len(b):
            return False
    # those nearest to the other's middle first
    a, b = (p[np.argsort(((p - q.mean(0)) ** 2).sum(1), kind="stable")] for p, q in ((a, b), (b, a)))
    for i in range(0, len(a), step):
        for j in range(0, len(b), step):
            gap = a[i : i + step, None] - b[None, j : j + step]
            if ((gap * gap).sum(2) <= eps * eps).any():
                return True
    return False


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 1) -> DataFrame:
    """(key, score): isolation forest; near 1 = easily isolated. Trees are grown on hashed samples of bounded size, all rows are scored."""
    v = df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    need = sample * trees
    total = max(1, v.count())
    pool = v.sample(min(1.0, 1.2 * need / total), seed).limit(need).toPandas()[columns].to_numpy(float)
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(max(2, min(sample, len(pool))))))

    def grow(x: np.ndarray, level: int):
        if level >= depth or len(x) <= 1 or np.ptp(x, 0).max() == 0:
            return len(x)
        at = rng.choice(np.flatnonzero(np.ptp(x, 0) > 0))
        edge = rng.uniform(x[:, at].min(), x[:, at].max())
        left = x[:, at] < edge
        return at, edge, grow(x[left], level + 1), grow(x[~left], level + 1)

    def usual(n) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    size = min(sample, len(pool))
    forest = [grow(pool[rng.choice(len(pool), size, replace=False)], 0) for _ in range(trees)] if size > 1 else []

    def length(tree, x: np.ndarray, out: np.ndarray, rows: np.ndarray, level: int) -> None:
        if not isinstance(tree, tuple):
            out[rows] += level + usual(tree)
            return
        at, edge, low, high = tree
        left = x[rows, at] < edge
        if left.any():
            length(low, x, out, rows[left], level + 1)
        if not left.all():
            length(high, x, out, rows[~left], level + 1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, out = b[columns].to_numpy(float), np.zeros(len(b))
            for tree in forest:
                length(tree, x, out, np.arange(len(b)), 0)
            mean = out / max(1, len(forest))
            yield pd.DataFrame({"k": b["k"], "score": np.power(2.0, -mean / max(usual(size), 1e-9)) if forest else 0.5})

    return v.mapInPandas(score, f"k {v.schema['k'].dataType.simpleString()}, score double").withColumnRenamed("k", key)


def rank_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho): Spearman correlations of the rows that have all columns."""
    v = VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="skip").transform(df)
    m = Correlation.corr(v, "v", "spearman").first()[0].toArray()
    return df.sparkSession.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j], "a string, b string, rho double")


def _labelled(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "irs990_filings").where("ein IS NOT NULL AND political_activity_flag IS NOT NULL")
    return f.select("filing_id", "ein", "tax_year", "mission", *NUMBERS, F.col("political_activity_flag").cast("double").alias("label"))


def political_measures(spark, sf_dir: str) -> DataFrame:
    """How well the mission and the amounts tell politically active filers, on organisations not trained on."""
    train, test = grouped_split(_labelled(spark, sf_dir), "ein")
    return measures(classify(train, test, "label", "mission", NUMBERS), "label")


def score_measures(spark, sf_dir: str) -> DataFrame:
    """The measures of old candidate scores as a guess at what is still current."""
    return measures(table(spark, sf_dir, "entity_match_candidates").select("score", F.col("is_current").alias("label")), "label")


def filer_clusters(spark, sf_dir: str) -> DataFrame:
    f = _labelled(spark, sf_dir).select("filing_id", *[F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in NUMBERS]).dropna()
    found, _ = clusters(f, NUMBERS, range(2, 5))
    return farthest(found).select("filing_id", "cluster", F.round("distance", 6).alias("distance"), "anomaly")


def filer_density(spark, sf_dir: str) -> DataFrame:
    f = _labelled(spark, sf_dir).select("filing_id", *[F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in ("total_revenue", "total_assets")]).dropna()
    return density_clusters(f, "filing_id", ["total_revenue", "total_assets"], eps=0.1)


def filer_outliers(spark, sf_dir: str) -> DataFrame:
    return isolation_scores(_labelled(spark, sf_dir), "filing_id", NUMBERS).select("filing_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (political_measures, score_measures, filer_clusters, filer_density, filer_outliers)}
SQL = {
    "score_measures": """WITH s AS (SELECT score AS s, CAST(is_current AS DOUBLE) AS y FROM entity_match_candidates WHERE score IS NOT NULL AND is_current IS NOT NULL),
 b AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM b WINDOW w AS (ORDER BY s DESC)), t AS (SELECT sum(p) AS P, sum(n) AS N FROM b),
 m AS (SELECT sum(CASE WHEN s >= 0.5 THEN p ELSE 0 END) AS tp, sum(CASE WHEN s >= 0.5 THEN n ELSE 0 END) AS fp, sum(CASE WHEN s < 0.5 THEN p ELSE 0 END) AS fn FROM b)
 SELECT 'roc_auc' AS measure, round(sum(n * (tp - p / 2)) / (SELECT P * N FROM t), 8) AS value FROM c
 UNION ALL SELECT 'average_precision', round(sum(p / (SELECT P FROM t) * tp / (tp + fp)), 8) FROM c
 UNION ALL SELECT 'precision', round(tp / (tp + fp), 8) FROM m UNION ALL SELECT 'recall', round(tp / (tp + fn), 8) FROM m UNION ALL SELECT 'f1', round(2 * tp / (2 * tp + fp + fn), 8) FROM m
 UNION ALL SELECT 'prevalence', round(P / (P + N), 8) FROM t UNION ALL SELECT 'brier', round(avg((y - s) ** 2), 8) FROM s
 UNION ALL SELECT 'recall_at_' || k, round((SELECT sum(y) FROM (SELECT y FROM s ORDER BY s DESC, y DESC LIMIT 50)) / (SELECT P FROM t), 8) FROM (VALUES (50)) v(k)
 UNION ALL SELECT 'recall_at_' || k, round((SELECT sum(y) FROM (SELECT y FROM s ORDER BY s DESC, y DESC LIMIT 100)) / (SELECT P FROM t), 8) FROM (VALUES (100)) v(k)
 UNION ALL SELECT 'recall_at_' || k, round((SELECT sum(y) FROM (SELECT y FROM s ORDER BY s DESC, y DESC LIMIT 200)) / (SELECT P FROM t), 8) FROM (VALUES (200)) v(k)"""
}
