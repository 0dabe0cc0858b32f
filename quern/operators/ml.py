"""Scores, thresholds, calibration and models on Spark ML, with time-ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scale import checked_broadcast, materialize


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc, n_pos, n_neg) by rank sums over distinct scores (ties count half); null if a class is missing."""
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    edges = sorted(set(c.stat.approxQuantile("s", [i / 32 for i in range(1, 32)], 0.005)))
    c = c.withColumn("b", sum(((F.col("s") > e).cast("int") for e in edges), F.lit(0)))
    below = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = c.groupBy("b").agg(F.sum("n").alias("bn")).select("b", F.coalesce(F.sum("bn").over(below), F.lit(0)).alias("before"))
    inner = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(F.broadcast(base), "b")
    return c.agg(F.try_divide(F.sum(F.col("p") * (F.col("in") + F.col("before") + F.col("n") / 2)), F.sum("p").cast("double") * F.sum("n")).alias("auc"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))


def binary_metrics(df: DataFrame, predicted: Column, label: Column, score: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, balanced accuracy and, with a score, the Brier score; groups by ``by``."""
    tp, fp, tn, fn = (F.count_if(c) for c in ((predicted == 1) & (label == 1), (predicted == 1) & (label == 0), (predicted == 0) & (label == 0), (predicted == 0) & (label == 1)))
    aggs = [tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn")]
    if score is not None:
        aggs.append(F.avg((score - label) * (score - label)).alias("brier"))
    out = df.groupBy(*(by or [])).agg(*aggs)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        out.withColumn("accuracy", F.try_divide(tp + tn, tp + fp + tn + fn)).withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn))
        .withColumn("f1", F.try_divide(2 * tp, 2 * tp + fp + fn)).withColumn("balanced_accuracy", (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2)
    )


def macro_f1(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """(macro_f1, accuracy): the plain mean of F1 over the labels that occur."""
    c = df.where(F.col(label).isNotNull()).groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = c.where(F.col(label) == F.col(predicted)).select(F.col(label).alias("k"), F.col("n").alias("tp"))
    true = c.groupBy(F.col(label).alias("k")).agg(F.sum("n").alias("t"))
    said = c.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("p"))
    per = true.join(hit, "k", "left").join(said, "k", "left").select("t", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("p", F.lit(0)).alias("p"))
    return per.agg(F.avg(F.try_divide(2 * F.col("tp"), F.col("t") + F.col("p"))).alias("macro_f1"), (F.sum("tp") / F.sum("t")).alias("accuracy"))


def best_threshold(df: DataFrame, score: str, label: str, steps: int = 99) -> DataFrame:
    """(threshold, f1): the cut of the grid i / (steps + 1) with the best F1 of ``score >= cut``; ties go to the cut nearest to one half.

    Scores are counted into grid cells first, so the grid never meets the rows.
    """
    width = 1.0 / (steps + 1)
    cell = F.least(F.greatest(F.floor(F.round(F.col(score) / width, 9)), F.lit(0)), F.lit(steps + 1))
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(cell.cast("int").alias("c")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("g"))
    j = grid.join(F.broadcast(c), F.col("c") >= F.col("g"), "left").groupBy("g").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("said"))
    total = c.agg(F.sum("p").alias("all"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("said") + F.col("all")), F.lit(0.0))
    scored = j.crossJoin(F.broadcast(total)).select((F.col("g") * width).alias("threshold"), f1.alias("f1"))
    return scored.orderBy(F.desc(F.round("f1", 12)), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def relevance_label(p_yes: Column, threshold: float) -> Column:
    return F.when(p_yes >= threshold, "yes").when(p_yes.isNotNull(), "no")


def neutral_zone(p_neg: Column, p_neu: Column, p_pos: Column, least: float, margin: float) -> Column:
    """The likeliest of three labels; one that is not neutral must reach ``least`` and lead neutral by ``margin``."""
    top = F.greatest(p_neg, p_neu, p_pos)
    label = F.when(p_neg == top, "negative").when(p_neu == top, "neutral").when(p_pos == top, "positive")
    weak = (label != "neutral") & ((top < least) | (top - p_neu < margin))
    return F.when(weak, "neutral").otherwise(label)


def class_weights(df: DataFrame, label: str, power: float = 1.0) -> DataFrame:
    """(label, n, weight): (rows / (classes * n)) ** power, scaled to mean one over the classes."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    c = c.withColumn("raw", F.pow(F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")), F.lit(power)))
    return c.select(label, "n", (F.col("raw") / F.avg("raw").over(w)).alias("weight"))


def scale_by_train(df: DataFrame, columns: list[str], part: str = "part", by: list[str] | None = None) -> DataFrame:
    """Columns standardised by mean and population deviation of the training rows of their fold."""
    by = by or []
    stats = df.where(F.col(part) == "train").groupBy(*by).agg(*[F.avg(c).alias(f"__m{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s{c}") for c in columns])
    out = df.join(checked_broadcast(stats), by, "left") if by else df.crossJoin(F.broadcast(stats))
    return out.select(*[F.try_divide(F.col(c) - F.col(f"__m{c}"), F.when(F.col(f"__s{c}") == 0, 1.0).otherwise(F.col(f"__s{c}"))).alias(c) if c in columns else F.col(c) for c in df.columns])


def temporal_auc(df: DataFrame, features: list[str], label: str, year: str, first: int, last: int, span: int | None = None) -> list[tuple[int, float]]:
    """(test year, AUC) of a logistic regression trained on the years before."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml import Pipeline

    out = []
    rows = df.dropna(subset=[*features, label, year])
    for y in range(first, last + 1):
        train = rows.where((F.col(year) < y) & (F.col(year) >= (y - span if span else -10_000)))
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__f"), StandardScaler(inputCol="__f", outputCol="__x", withMean=True), LogisticRegression(featuresCol="__x", labelCol=label, maxIter=50)]).fit(train)
        out.append((y, BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(rows.where(F.col(year) == y)))))
    return out


def kmeans_elbow(df: DataFrame, features: list[str], most: int = 5, seed: int = 1) -> list[tuple[int, float]]:
    """(k, within-cluster cost) for k = 2 .. ``most``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=features))
    return [(k, KMeans(k=k, seed=seed).fit(x).summary.trainingCost) for k in range(2, most + 1)]


def _similar_pairs(pdf, low: float, high: float):
    """Rows of two blocks (side 0, and 1 unless it is one block with itself), unit vectors as they are, and the index pairs with a similarity in [low, high)."""
    import numpy as np

    pdf = pdf.sort_values(["side", "k"], kind="stable")
    v = np.array(pdf["v"].tolist(), float)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, norm, out=np.full_like(v, np.nan), where=norm > 0)
    first = int((pdf["side"] == 0).sum())
    one = bool(pdf["x"].iloc[0] == pdf["y"].iloc[0])
    sim = unit[:first] @ (unit[:first] if one else unit[first:]).T
    good = (sim >= low) & (sim < high)
    i, j = np.nonzero(np.triu(good, 1) if one else good)
    return pdf["k"].tolist(), v, i, j if one else j + first


def balance_by_mixing(df: DataFrame, key: str, vector: str, label: str, share: float = 0.9, low: float = 0.65, high: float = 0.99, seed: int = 1, block: int = 1024) -> DataFrame:
    """(label, a, b, alpha, vector): mixtures of similar rows of the smaller classes, as many as bring each to ``share`` of the largest.

    Each mixture draws one of all pairs of its class with a similarity in [low, high), with replacement, and alpha in [0.35, 0.65), by hashes. Only
    a class without such a pair gets none. All pairs of a class are compared, block by block of about ``block`` rows in tasks of their own: once to
    count, and again where drawn; work grows as the square of a class. Vectors of a mixture are scaled to sum one; null keys and vectors are in no pair.
    """
    import pandas as pd

    n = df.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("n")).withColumn("need", (F.max("n").over(Window.partitionBy()) * share - F.col("n")).cast("int"))
    small = n.where("need > 0").withColumn("blocks", F.ceil(F.col("n") / block))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).join(F.broadcast(small), F.col(label) == F.col("__l"))
    rows = rows.select("__l", F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(F.lit(seed), key), F.col("blocks")).alias("at"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("__l", "k", "v", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), (F.col("at") > F.col("other")).cast("int").alias("side"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    tile = ["__l", "x", "y"]

    def count(keys, pdf):
        return pd.DataFrame([(*keys, len(_similar_pairs(pdf, low, high)[2]))], columns=[*tile, "c"])

    def mix(keys, pdf, draws):
        if not len(draws) or not len(pdf):
            return pd.DataFrame(columns=["__l", "a", "b", "alpha", "va", "vb"])
        k, v, i, j = _similar_pairs(pdf, low, high)
        draws = draws.sort_values("draw")
        i, j = i[draws["place"]], j[draws["place"]]
        return pd.DataFrame({"__l": [keys[0]] * len(i), "a": [k[p] for p in i], "b": [k[p] for p in j], "alpha": draws["alpha"].to_numpy(), "va": list(v[i]), "vb": list(v[j])})

    counts = materialize(rows.groupBy(*tile).applyInPandas(count, f"__l {types['__l']}, x bigint, y bigint, c bigint"), "tiles").where("c > 0")
    upto = F.sum("c").over(Window.partitionBy("__l").orderBy("x", "y"))
    counts = counts.withColumn("from", upto - F.col("c")).withColumn("all", F.sum("c").over(Window.partitionBy("__l")))
    totals = counts.groupBy("__l").agg(F.first("all").alias("all")).join(small.select("__l", "need"), "__l")
    draws = totals.select("__l", "all", F.explode(F.sequence(F.lit(1), F.col("need"))).alias("draw"))
    draws = draws.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "__l", "draw"), F.col("all"))).withColumn("alpha", 0.35 + 0.3 * F.pmod(F.xxhash64(F.lit(seed + 1), "__l", "draw"), F.lit(1_000_003)) / 1_000_003.0)
    draws = draws.drop("all").join(counts, "__l").where("place >= from and place < from + c").select(*tile, "draw", (F.col("place") - F.col("from")).alias("place"), "alpha")
    pairs = rows.groupBy(*tile).cogroup(draws.groupBy(*tile)).applyInPandas(mix, f"__l {types['__l']}, a {types['k']}, b {types['k']}, alpha double, va array<double>, vb array<double>")
    mixed = F.zip_with("va", "vb", lambda x, y: F.col("alpha") * x + (1 - F.col("alpha")) * y)
    total = F.aggregate(mixed, F.lit(0.0), lambda s, v: s + F.abs(v))
    return pairs.select(F.col("__l").alias(label), "a", "b", "alpha", F.transform(mixed, lambda v: F.try_divide(v, total)).alias("vector"))


def model_scores(df: DataFrame, features: list[str], label: str, year: str, test_year: int, seed: int = 1) -> list[tuple[str, float]]:
    """(model, AUC) of logistic regression, random forest and boosted trees trained on the years before ``test_year``."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=[*features, label, year]))
    train, test = rows.where(F.col(year) < test_year), rows.where(F.col(year) == test_year)
    models = {"logistic": LogisticRegression(labelCol=label), "forest": RandomForestClassifier(labelCol=label, numTrees=30, maxDepth=5, minInstancesPerNode=10, seed=seed), "boosted": GBTClassifier(labelCol=label, maxIter=10, seed=seed)}
    return [(k, BinaryClassificationEvaluator(labelCol=label).evaluate(m.fit(train).transform(test))) for k, m in models.items()]


def regression_scores(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """(n, rmse, mae, r2) in one pass."""
    e = F.col(actual) - F.col(predicted)
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(actual) * F.count(F.lit(1)))).alias("r2"))


def multinomial(df: DataFrame, features: list[str], label: str) -> list[tuple[int, str, float]]:
    """(class, term, coefficient) of a multinomial logit; Spark's coefficients are centred over the classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=[*features, label]))
    m = LogisticRegression(labelCol=label, family="multinomial", maxIter=100).fit(rows)
    return [(c, t, float(v)) for c in range(m.numClasses) for t, v in [("const", m.interceptVector[c]), *((f, m.coefficientMatrix[c, i]) for i, f in enumerate(features))]]


def line_folds(df: DataFrame, x: str, y: str, fold: str) -> DataFrame:
    """(fold, n, rmse, r2): a line fitted on all other folds and tested on each, from one pass of sums a fold; no row is read twice."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(fold).isNotNull())
    terms = {"n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y), "yy": F.col(y) * F.col(y)}
    sums = rows.groupBy(fold).agg(*[F.sum(v).alias(k) for k, v in terms.items()])
    whole = Window.partitionBy()  # a row a fold
    rest = sums.select("*", *[(F.sum(k).over(whole) - F.col(k)).alias(f"o{k}") for k in terms])
    b = (F.col("on") * F.col("oxy") - F.col("ox") * F.col("oy")) / (F.col("on") * F.col("oxx") - F.col("ox") * F.col("ox"))
    rest = rest.withColumn("b", b).withColumn("a", (F.col("oy") - F.col("b") * F.col("ox")) / F.col("on"))
    a, b = F.col("a"), F.col("b")
    error = F.col("yy") - 2 * a * F.col("y") - 2 * b * F.col("xy") + F.col("n") * a * a + 2 * a * b * F.col("x") + b * b * F.col("xx")
    return rest.select(fold, F.col("n").cast("bigint").alias("n"), F.sqrt(error / F.col("n")).alias("rmse"), (1 - error / (F.col("yy") - F.col("y") * F.col("y") / F.col("n"))).alias("r2"))


def ridge(df: DataFrame, features: list[str], y: str, alpha: float = 1.0) -> list[tuple[str, float]]:
    """(term, coefficient) of least squares with ``alpha`` times the squared coefficients as penalty; the constant is not penalised. One pass of sums."""
    import numpy as np

    cols = [*features, y]
    rows = df.dropna(subset=cols)
    k = len(features)
    r = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.covar_pop(F.col(a), F.col(b)) for i, a in enumerate(cols) for b in cols[i:]]).first()
    n, means, m = r[0], np.array(r[1 : k + 2], float), np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = r[k + 2 :]
    m = (m + np.triu(m, 1).T) * n
    b = np.linalg.solve(m[:k, :k] + alpha * np.eye(k), m[:k, k])
    return [*zip(features, map(float, b)), ("const", float(means[k] - b @ means[:k]))]


def importances(df: DataFrame, features: list[str], label: str, trees: int = 30, seed: int = 1) -> list[tuple[str, float]]:
    """(feature, percent) by the impurity that a forest's splits on it remove, the largest first."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=[*features, label]))
    m = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=5, minInstancesPerNode=10, seed=seed).fit(rows)
    values = m.featureImportances.toArray()
    return sorted(((f, float(100 * v / (values.sum() or 1))) for f, v in zip(features, values)), key=lambda x: -x[1])


def cluster_scores(df: DataFrame, features: list[str], ks: list[int], seed: int = 1) -> list[tuple[str, float]]:
    """Silhouette (squared distances) and Davies-Bouldin index of k-means for each k; both from sums over the clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    import numpy as np

    x = VectorAssembler(inputCols=features, outputCol="features").transform(df.dropna(subset=features))
    out = []
    for k in ks:
        m = KMeans(k=k, seed=seed).fit(x)
        got = m.transform(x)
        centres = np.array(m.clusterCenters())
        own = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])[F.col("prediction")]
        far = F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        spread = {r["prediction"]: r["s"] for r in got.groupBy("prediction").agg(F.avg(far).alias("s")).collect()}
        ratio = [max((spread[i] + spread[j]) / np.linalg.norm(centres[i] - centres[j]) for j in spread if j != i) for i in spread] if len(spread) > 1 else [0.0]
        out += [(f"silhouette_{k}", ClusteringEvaluator().evaluate(got)), (f"davies_bouldin_{k}", float(np.mean(ratio)))]
    return out


def word_vectors(texts: DataFrame, key: str, tokens: Column, size: int = 100, window: int = 5, least: int = 2, epochs: int = 30, seed: int = 42) -> DataFrame:
    """(key, vector): the mean of a text's word vectors (skip-gram), zeros where none of its words is in the vocabulary; null texts have none."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    rows = texts.select(F.col(key), tokens.alias("__t")).where("__t is not null")
    m = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=epochs, seed=seed, inputCol="__t", outputCol="__v").fit(rows)
    return m.transform(rows).select(key, vector_to_array("__v").alias("vector"))


def auc_steps(df: DataFrame, steps: list[list[str]], label: str, year: str, test_year: int) -> list[tuple[str, float, float]]:
    """(features, AUC, gain): logistic regressions on growing sets of features, trained before ``test_year`` and tested on it; the gain is that over the set before."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    every = [f for s in steps for f in s]
    rows = df.dropna(subset=[*every, label, year])
    out, used, last = [], [], 0.5
    for s in steps:
        used = used + s
        x = VectorAssembler(inputCols=used, outputCol="features").transform(rows)
        m = LogisticRegression(labelCol=label).fit(x.where(F.col(year) < test_year))
        auc = BinaryClassificationEvaluator(labelCol=label).evaluate(m.transform(x.where(F.col(year) == test_year)))
        out.append(("+".join(used), auc, auc - last))
        last = auc
    return out


def complete_linkage(df: DataFrame, key: str, features: list[str], groups: int, most: int = 2000) -> list[tuple[object, int]]:
    """(key, group): agglomerative clustering by complete linkage of standardised features, groups numbered by their least key.

    The method needs all distances, so it is for small tables: more than ``most`` rows are an error, none is left out silently. Rows with nulls take no part.
    """
    import numpy as np

    rows = df.select(key, *features).dropna().orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"complete linkage takes {most} rows at most")
    if not rows:
        return []
    x = np.array([[float(v) for v in r[1:]] for r in rows])
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    of = [[i] for i in range(len(x))]
    alive = np.ones(len(x), bool)
    for _ in range(max(0, len(x) - groups)):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        of[i] += of[j]
        alive[j] = False
    order = sorted((min(of[i]), i) for i in np.flatnonzero(alive))
    place = {r: g for g, (_, i) in enumerate(order) for r in of[i]}
    return [(r[0], place[k]) for k, r in enumerate(rows)]
