"""Learners that are sums over counts, and what measures them.

Each fits with a fixed number of aggregates; what a model holds is bounded by
the domains of the attributes and the classes, never by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .columns import clean
from .mining import contingency, nearest


def nearest_class(train: DataFrame, rows: DataFrame, key: str, vector: str, cls: str) -> DataFrame:
    """(key, predicted): the class of the nearest other training row, ties to the smaller key."""
    known = train.where(F.col(cls).isNotNull())
    near = nearest(known, rows, key, vector, 1).select(F.col("query").alias(key), F.col("neighbour"))
    label = known.select(F.col(key).alias("neighbour"), F.col(cls).alias("predicted"))
    return rows.select(key).join(near.join(label, "neighbour").select(key, "predicted"), key, "left")


def gaussian_bayes(train: DataFrame, rows: DataFrame, key: str, values: Sequence[str], cls: str, least: float = 1e-3) -> DataFrame:
    """(key, predicted): naive Bayes with a normal distribution per class and value.

    Missing values are left out; a deviation is at least ``least``; a value a
    class never had tells nothing against it.
    """
    stats = [
        F.struct(F.avg(clean(v).cast("double")).alias("m"), F.greatest(F.coalesce(F.stddev_samp(clean(v).cast("double")), F.lit(0.0)), F.lit(least)).alias("s")).alias(f"__{v}")
        for v in values
    ]
    model = train.where(F.col(cls).isNotNull()).groupBy(F.col(cls).cast("string").alias("class")).agg(F.count("*").alias("n"), *stats)
    table = model.agg(F.array_sort(F.collect_list(F.struct("class", "n", *[f"__{v}" for v in values]))).alias("all"), F.sum("n").alias("total")).select(F.struct("all", "total").alias("t")).scalar()

    def score(c: Column, total: Column) -> Column:
        out = F.log(c["n"] / total)
        for v in values:
            x = clean(v).cast("double")
            z = (x - c[f"__{v}"]["m"]) / c[f"__{v}"]["s"]
            out = out + F.coalesce(-z * z / 2 - F.log(c[f"__{v}"]["s"]), F.lit(0.0))
        return out

    d = rows.withColumn("__t", table)
    each = F.transform(F.col("__t")["all"], lambda c: F.struct((-F.round(score(c, F.col("__t")["total"]), 9)).alias("s"), c["class"].alias("class")))
    return d.select(key, F.array_min(each)["class"].alias("predicted"))


def hyper_pipes(train: DataFrame, rows: DataFrame, key: str, values: Sequence[str], cls: str) -> DataFrame:
    """(key, predicted): the class within whose ranges most values lie, ties to the smaller class."""
    ranges = [F.struct(F.min(clean(v)).alias("lo"), F.max(clean(v)).alias("hi")).alias(f"__{v}") for v in values]
    pipes = train.where(F.col(cls).isNotNull()).groupBy(F.col(cls).cast("string").alias("class")).agg(*ranges)
    table = pipes.agg(F.array_sort(F.collect_list(F.struct("class", *[f"__{v}" for v in values]))).alias("t")).scalar()

    def inside(c: Column) -> Column:
        hits = [F.when(clean(v).between(c[f"__{v}"]["lo"], c[f"__{v}"]["hi"]), 1).otherwise(0) for v in values]
        return sum(hits[1:], hits[0])

    d = rows.withColumn("__t", table)
    return d.select(key, F.array_min(F.transform("__t", lambda c: F.struct((-inside(c)).alias("n"), c["class"].alias("class"))))["class"].alias("predicted"))


def averaged_dependence(train: DataFrame, rows: DataFrame, key: str, attributes: Sequence[str], cls: str) -> DataFrame:
    """(key, predicted): averaged one-dependence estimators over nominal attributes, add-one smoothing.

    Each attribute in turn is the parent of the others: its joint probability
    with the class times the others' given both.  Counts of pairs of attributes
    are taken in one pass; rows meet them by equi-joins on their own pairs.
    Rows with a missing or unseen parent skip that parent.
    """
    known = train.where(F.col(cls).isNotNull()).withColumn("__c", F.col(cls).cast("string"))
    text = {a: F.col(a).cast("string") for a in attributes}
    pair = lambda: F.array(*[
        F.struct(F.lit(p).alias("p"), text[p].alias("pv"), F.lit(q).alias("q"), (F.lit("") if p == q else text[q]).alias("qv")) for p in attributes for q in attributes
    ])
    counts = known.select(F.col("__c").alias("class"), F.inline(pair())).where("pv IS NOT NULL AND qv IS NOT NULL").groupBy("p", "pv", "q", "qv", "class").agg(F.count("*").alias("n"))
    levels = contingency(known, attributes, cls).groupBy(F.col("attribute").alias("q")).agg(F.countDistinct("value").alias("levels"))
    total = known.select(F.count("*").alias("n")).scalar()
    classes = known.select(F.col("__c").alias("class")).distinct()
    number = classes.select(F.count("*").alias("k")).scalar()
    parents = counts.where("p = q").groupBy("p", "pv", "class").agg(F.sum("n").alias("np"))
    seen = parents.select("p", "pv").distinct()
    long = rows.select(key, F.inline(pair())).where("pv IS NOT NULL AND qv IS NOT NULL").join(seen, ["p", "pv"])
    # one row per class, parent and child of a row
    table = long.withColumn("class", F.explode(classes.agg(F.collect_list("class").alias("c")).scalar())).join(parents, ["p", "pv", "class"], "left")
    table = table.join(counts, ["p", "pv", "q", "qv", "class"], "left").join(levels, "q").join(levels.select(F.col("q").alias("p"), F.col("levels").alias("plevels")), "p")
    np, n = F.coalesce("np", F.lit(0)), F.coalesce("n", F.lit(0))
    part = F.when(F.col("p") == F.col("q"), F.log((np + 1) / (total + number * F.col("plevels")))).otherwise(F.log((n + 1) / (np + F.col("levels"))))
    per_parent = table.groupBy(key, "class", "p").agg(F.sum(part).alias("l"))
    score = per_parent.groupBy(key, "class").agg(F.sum(F.exp("l")).alias("s"))
    best = score.groupBy(key).agg(F.min_by("class", F.struct((-F.round(F.log("s"), 9)).alias("s"), "class")).alias("predicted"))
    return rows.select(key).join(best, key, "left")


def consistency(df: DataFrame, attributes: Sequence[str], cls: str) -> Column:
    """Share of the rows that agree with the most frequent class of their combination of attributes (NULL is a value)."""
    c = df.where(F.col(cls).isNotNull()).groupBy(*attributes, cls).agg(F.count("*").alias("n"))
    best = c.groupBy(*attributes).agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return best.select(F.try_divide(F.sum("m").cast("double"), F.sum("t")).alias("consistency")).scalar()


def association_rules(baskets: DataFrame, items: str, support: float, confidence: float) -> DataFrame:
    """(antecedent, consequent, confidence, lift): rules with one item behind the arrow."""
    from .mining import fp_growth

    rules = fp_growth(baskets, items, support, confidence)[1]
    return rules.select(F.array_sort("antecedent").alias("antecedent"), F.col("consequent")[0].alias("consequent"), "confidence", "lift")


def id3(train: DataFrame, rows: DataFrame, key: str, attributes: Sequence[str], cls: str) -> DataFrame:
    """(key, predicted): a tree of nominal attributes split by information gain, grown level by level.

    A level takes one contingency count of all its nodes; a node is the string
    of its tests, so rows carry their node and meet the chosen tests by an
    equi-join.  Each attribute is used once on a path, so there are at most as
    many levels as attributes.  A row whose value has no branch is predicted by
    the node it reached (its most frequent class, ties to the smaller one).
    """
    names = [f"__x{i}" for i in range(len(attributes))]
    text = [F.coalesce(F.col(a).cast("string"), F.lit("\\N")).alias(n) for a, n in zip(attributes, names)]
    fit = train.where(F.col(cls).isNotNull()).select(F.col(cls).cast("string").alias("__c"), *text).withColumn("__node", F.lit(""))
    walk = rows.select(key, *text).withColumn("__node", F.lit("")).withColumn("predicted", F.lit(None).cast("string"))
    entropy = lambda n, total: -F.sum(n / total * F.log2(n / total))
    for _ in range(len(attributes) + 1):
        sizes = fit.groupBy("__node", "__c").agg(F.count("*").alias("n"))
        nodes = sizes.groupBy("__node").agg(F.sum("n").alias("t"), F.count("*").alias("kinds"), F.min_by("__c", F.struct((-F.col("n")).alias("n"), "__c")).alias("__most"))
        walk = walk.join(nodes.select("__node", "__most"), "__node", "left").withColumn("predicted", F.coalesce("__most", "predicted")).drop("__most")
        pairs = F.array(*[F.struct(F.lit(i).alias("at"), F.col(n).alias("v")) for i, n in enumerate(names)])
        used = F.contains(F.col("__node"), F.concat(F.lit("\n"), F.col("at").cast("string"), F.lit("=")))
        cells = fit.select("__node", "__c", F.inline(pairs)).where(~used).groupBy("__node", "at", "v", "__c").agg(F.count("*").alias("n"))
        values = cells.groupBy("__node", "at", "v").agg(F.sum("n").alias("t"))
        inside = cells.join(values, ["__node", "at", "v"]).groupBy("__node", "at", "v", "t").agg(entropy(F.col("n"), F.col("t")).alias("h"))
        rest = inside.groupBy("__node", "at").agg((F.sum(F.col("t") * F.col("h")) / F.sum("t")).alias("rest"))
        whole = sizes.join(nodes.select("__node", "t", "kinds"), "__node").where("kinds > 1").groupBy("__node").agg(entropy(F.col("n"), F.col("t")).alias("h"))
        gain = rest.join(whole, "__node").withColumn("gain", F.round(F.col("h") - F.col("rest"), 9)).where("gain > 0")
        # the tests of a level are few, and written down they end the plans of the levels before
        test = cut(gain.groupBy("__node").agg(F.min_by("at", F.struct((-F.col("gain")).alias("g"), "at")).alias("__at")))
        if test.isEmpty():
            break
        value = F.element_at(F.array(*[F.col(n) for n in names]), F.col("__at") + 1)
        step = F.concat("__node", F.lit("\n"), F.col("__at").cast("string"), F.lit("="), value)
        # rows of nodes without a test are done: they keep their node apart from all others
        fit = fit.join(test, "__node").withColumn("__node", step).drop("__at")
        walk = walk.join(test, "__node", "left").withColumn("__node", F.when(F.col("__at").isNotNull(), step).otherwise(F.concat(F.lit("."), "__node"))).drop("__at")
    return walk.select(key, "predicted")


def vote(predictions: Sequence[DataFrame], key: str) -> DataFrame:
    """(key, predicted): the class most of several predictions name, ties to the smaller one."""
    from .rows import union_all

    named = union_all([p.select(key, F.col("predicted").cast("string").alias("predicted")) for p in predictions])
    counts = named.groupBy(key, "predicted").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by("predicted", F.struct((F.col("predicted").isNull()).alias("missing"), (-F.col("n")).alias("n"), "predicted")).alias("predicted"))


def evaluation(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(n, accuracy, kappa): agreement of two columns and what is left of it beyond chance, from the table of their levels."""
    pairs = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    c = pairs.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    rows = c.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("na"))
    cols = c.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("np"))
    chance = rows.join(cols, "k").select(F.sum(F.col("na").cast("double") * F.col("np")).alias("e")).scalar()
    d = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("ok"))
    n = F.col("n").cast("double")
    po, pe = F.try_divide(F.col("ok"), n), F.try_divide(F.coalesce(chance, F.lit(0.0)), n * n)
    return d.select(F.coalesce("n", F.lit(0)).alias("n"), po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"))
