"""Model evaluation: exact splits, equal-frequency naive Bayes, ranks and confusion counts, all as DataFrame jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import dense_keys, running_sum


def order_hash(key: Column, seed: int = 0) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.7, seed: int = 0) -> DataFrame:
    """df with train: exactly ceil(share * n) rows of each class, in the order of a hash of the key."""
    placed = dense_keys(df.withColumn("_hash", order_hash(F.col(key), seed)), [F.col(label), F.col("_hash"), F.col(key)], "_nth")
    classes = placed.groupBy(F.col(label).alias("_class")).agg(F.min("_nth").alias("_first"), F.count("*").alias("_n"))
    joined = placed.join(F.broadcast(classes), F.col(label).eqNullSafe(F.col("_class")))  # a row a class
    return joined.withColumn("train", F.col("_nth") - F.col("_first") < F.ceil(F.col("_n") * share)).drop("_hash", "_nth", "_class", "_first", "_n")


def partition_checks(split: DataFrame, base: DataFrame, key: str, label: str) -> DataFrame:
    """(check, n) of a split, all 0 if it is sound: keys in both parts, keys of the base in neither, and labels that differ from the base's."""
    sides = split.groupBy(key).agg(F.max(F.col("train").cast("int")).alias("_a"), F.min(F.col("train").cast("int")).alias("_b"), F.first(label).alias("_label"))
    both = base.select(key, F.col(label).alias("_base")).join(sides, key, "full")
    tests = {"in both parts": F.col("_a") != F.col("_b"), "in neither part": F.col("_a").isNull(), "label differs": ~F.col("_label").eqNullSafe(F.col("_base")) & F.col("_a").isNotNull()}
    cells = [F.struct(F.lit(k).alias("check"), F.count_if(F.coalesce(t, F.lit(False))).alias("n")) for k, t in tests.items()]
    return both.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def cuts(df: DataFrame, column: str, bins: int = 4) -> list[float]:
    """Cuts of about equal frequency between different values: after the value whose running count first reaches k/bins.

    Only the values' counts are sorted, by ranges, and at most 2 * bins numbers come to the driver.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    run = running_sum(values, [F.col("v")], "n", "below")
    total = run.agg(F.sum("n")).first()[0]
    if not total:
        return []
    reached = run.agg(*(F.min(F.when((F.col("below") + F.col("n")) * bins >= total * k, F.col("v"))) for k in range(1, bins))).first()
    after = run.agg(*(F.min(F.when(F.col("v") > v, F.col("v"))) for v in reached)).first()
    return sorted({(float(a) + float(b)) / 2 for a, b in zip(reached, after, strict=True) if b is not None})


def binned(column: str, at: list[float]) -> Column:
    """Number of cuts below the value; null stays null."""
    return F.when(F.col(column).isNotNull(), reduce(lambda x, y: x + y, (F.when(F.col(column) > c, 1).otherwise(0) for c in at), F.lit(0)))


def naive_bayes(train: DataFrame, columns: dict[str, Column], label: str) -> DataFrame:
    """Rows (feature, value, weight): log ratio of the classes with (n + 1) / (n_value + 2); the prior has feature null.

    columns: discrete features. Missing values count for nothing.
    """
    long = train.select(label, F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), c.cast("string").alias("value")) for k, c in columns.items()))).alias("x")).select(label, "x.*").where("value IS NOT NULL")
    prior = train.agg(F.log((F.sum(label) + 1) / (F.count("*") - F.sum(label) + 1)).alias("prior"))
    counts = long.groupBy("feature", "value").agg(F.sum(label).alias("ones"), F.count("*").alias("n"))
    weights = counts.crossJoin(F.broadcast(prior)).select("feature", "value", (F.log((F.col("ones") + 1) / (F.col("n") - F.col("ones") + 1)) - F.col("prior")).alias("weight"))  # prior is one row
    return weights.unionByName(prior.select(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("value"), F.col("prior").alias("weight")))


def bayes_scores(df: DataFrame, model: DataFrame, columns: dict[str, Column], key: str) -> DataFrame:
    """(key, score) of the model's weights; the model has a row for each value of the discrete features."""
    long = df.select(key, F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), c.cast("string").alias("value")) for k, c in columns.items()))).alias("x")).select(key, "x.*")
    sums = long.join(model.where("feature IS NOT NULL"), ["feature", "value"], "left").groupBy(key).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_sum"))
    prior = model.where("feature IS NULL").select(F.col("weight").alias("_prior"))
    return sums.crossJoin(F.broadcast(prior)).select(key, (1 / (1 + F.exp(-(F.col("_sum") + F.col("_prior"))))).alias("score"))  # prior is one row


def auc(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """ROC AUC by average ranks (Mann-Whitney), exact with ties; rows without a score are left out.

    Ranks come from counts by score value, so a value that many rows share is one row.
    """
    groups = groups or []
    values = df.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count("*").alias("n"), F.sum(label).alias("ones"))
    values = running_sum(values, [*map(F.col, groups), F.col(score)], "n", "_below")
    starts = values.groupBy(*groups).agg(F.min("_below").alias("_start"))
    values = values.join(starts, groups) if groups else values.crossJoin(F.broadcast(starts))  # one row
    below = F.col("_below") - F.col("_start")
    # the rank sum times two stays an integer
    ranked = values.withColumn("_twice", F.col("ones") * (2 * below + F.col("n") + 1))
    ones, zeros = F.sum("ones"), F.sum(F.col("n") - F.col("ones"))
    return ranked.groupBy(*groups).agg(((F.sum("_twice") - ones * (ones + 1)).cast("double") / (2 * ones * zeros).cast("double")).alias("auc"), F.count("*").alias("n_values"))


def univariate_auc(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """AUC of each numeric feature by itself, turned to be 0.5 or more, with its direction; one job for all."""
    long = df.select(label, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select(label, "x.*")
    got = auc(long, "value", label, ["feature"]).where("n_values >= 2")
    return got.select("feature", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("auc"), F.when(F.col("auc") >= 0.5, 1).otherwise(-1).alias("direction"))


def version_differences(metrics: DataFrame, version: str, base: str, columns: list[str], on: list[str]) -> DataFrame:
    """Each version's metrics less those of the version `base`, by on (model, metric set, ...)."""
    other = metrics.where(F.col(version) != base)
    own = metrics.where(F.col(version) == base).select(*on, *(F.col(c).alias(f"_{c}") for c in columns))
    return other.join(own, on, "left").select(version, *on, *((F.col(c) - F.col(f"_{c}")).alias(c) for c in columns))


def sensitivity(train: DataFrame, test: DataFrame, key: str, label: str, grid: list[dict]) -> DataFrame:
    """(settings, auc) of a classifier for each entry of a small grid of settings; the frames are prepare()'s."""
    n = train.count()
    found = []
    for settings in grid:
        model = classifier(label=label, n_train=n, **settings).fit(train)
        name = ", ".join(f"{k}={v}" for k, v in settings.items())
        found.append(auc(scored(model, test, key, label), "score", label).select(F.lit(name).alias("settings"), "auc"))
    return reduce(DataFrame.unionByName, found)


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp at score > threshold, with accuracy, recall, specificity and balanced accuracy."""
    said, true = F.col(score) > threshold, F.col(label) == 1
    c = df.agg(F.count_if(~said & ~true).alias("tn"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(said & true).alias("tp"))
    recall, specificity = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return c.select("*", ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"), recall.alias("recall"), specificity.alias("specificity"), ((recall + specificity) / 2).alias("balanced_accuracy"))


def prepare(train: DataFrame, test: DataFrame, numbers: list[str], texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames with a vector of features: numbers with the training mean for nulls, texts one-hot; columns that are
    null throughout training are dropped. Fitted on train alone."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler

    counts = train.agg(*(F.count(c).alias(c) for c in numbers)).first()
    used = [c for c in numbers if counts[c]]
    stages = [Imputer(inputCols=used, outputCols=[f"{c}_n" for c in used])] if used else []
    for c in texts:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v", dropLast=False)]
    stages.append(VectorAssembler(inputCols=[f"{c}_n" for c in used] + [f"{c}_v" for c in texts], outputCol="features"))
    doubles = lambda df: df.withColumns({c: F.col(c).cast("double") for c in used})
    model = Pipeline(stages=stages).fit(doubles(train))
    return model.transform(doubles(train)), model.transform(doubles(test))


def classifier(kind: str, label: str, n_train: int, steps: int = 100, standard: bool = False, leaf: int = 2):  # noqa: ANN201
    """An estimator: "logistic" (L2 with C = 1) or "tree" (entropy; depth at most 30, which is as deep as MLlib's go)."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression

    if kind == "logistic":
        return LogisticRegression(labelCol=label, maxIter=steps, regParam=1 / max(1, n_train), elasticNetParam=0.0, standardization=standard)
    return DecisionTreeClassifier(labelCol=label, impurity="entropy", maxDepth=30, minInstancesPerNode=leaf)


def scored(model, df: DataFrame, key: str, label: str) -> DataFrame:  # noqa: ANN001
    """(key, label, score) with the probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(key, label, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
