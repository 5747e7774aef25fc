"""Attribute evaluation, simple learners and clusterers.

Evaluations are sums over contingency counts, aggregated before anything is
compared.  Learners with an iterative fit come from ``pyspark.ml``, whose
passes are distributed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .columns import clean
from .ordinal import with_ordinal
from .rows import union_all


def contingency(df: DataFrame, attributes: Sequence[str], cls: str) -> DataFrame:
    """(attribute, value, class, n): counts of each level of each attribute per class, in one pass."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    return (
        df.where(F.col(cls).isNotNull())
        .select(F.col(cls).cast("string").alias("class"), F.explode(pairs).alias("p"))
        .where("p.value IS NOT NULL")
        .groupBy("p.attribute", "p.value", "class")
        .agg(F.count("*").alias("n"))
    )


def _xlog(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)


def attribute_scores(df: DataFrame, attributes: Sequence[str], cls: str) -> DataFrame:
    """(attribute, info_gain, gain_ratio, symmetric_uncertainty, chi_squared, one_rule) of nominal attributes."""
    c = contingency(df, attributes, cls)
    by_value = c.groupBy("attribute", "value").agg(F.sum("n").alias("nv"), F.sum(_xlog(F.col("n"))).alias("cell"), F.max("n").alias("best"))
    by_class = c.groupBy("attribute", "class").agg(F.sum("n").alias("nc"))
    v = by_value.groupBy("attribute").agg(
        F.sum("nv").alias("n"), F.sum("cell").alias("cells"), F.sum(_xlog(F.col("nv"))).alias("values"), F.sum("best").alias("right")
    )
    k = by_class.groupBy("attribute").agg(F.sum(_xlog(F.col("nc"))).alias("classes"))
    chi = (
        c.join(by_value.select("attribute", "value", "nv"), ["attribute", "value"])
        .join(by_class, ["attribute", "class"])
        .groupBy("attribute")
        # cells that never occur add their expectation: (0 - e)^2 / e = e, so the sum is n * (sum n^2 / (nv nc) - 1)
        .agg(F.sum(F.col("n") * F.col("n") / (F.col("nv") * F.col("nc"))).alias("q"))
    )
    d = v.join(k, "attribute").join(chi, "attribute")
    n = F.col("n").cast("double")
    h_class = F.log2(n) - F.col("classes") / n
    h_value = F.log2(n) - F.col("values") / n
    gain = h_class + h_value - (F.log2(n) - F.col("cells") / n)
    return d.select(
        "attribute",
        gain.alias("info_gain"),
        F.try_divide(gain, h_value).alias("gain_ratio"),
        F.try_divide(2 * gain, h_class + h_value).alias("symmetric_uncertainty"),
        (n * (F.col("q") - 1)).alias("chi_squared"),
        (F.col("right") / n).alias("one_rule"),
    )


def zero_rule(df: DataFrame, cls: str) -> Column:
    """The most frequent class, ties to the smaller one."""
    from .columns import mode_value

    return mode_value(df, cls)


def naive_bayes(train: DataFrame, rows: DataFrame, key: str, attributes: Sequence[str], cls: str) -> DataFrame:
    """(key, predicted): naive Bayes over nominal attributes with add-one smoothing.

    The model is one row per (attribute, value, class), a table bounded by the
    domains, joined to the rows by attribute and value.
    """
    c = contingency(train, attributes, cls)
    classes = train.where(F.col(cls).isNotNull()).groupBy(F.col(cls).cast("string").alias("class")).agg(F.count("*").alias("nc"))
    levels = c.groupBy("attribute").agg(F.countDistinct("value").alias("levels"))
    per_class = classes.agg(F.collect_list(F.struct("class", "nc")).alias("all"))
    prior = classes.select(F.sum("nc").alias("n")).scalar()
    # for every level: the log likelihood under each class, also where the pair never occurred
    seen = c.groupBy("attribute", "value").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("counts")).join(levels, "attribute")
    all_classes = [(r["class"], r["nc"]) for r in per_class.select(F.inline("all")).collect()]
    like = F.array(
        *[F.struct(F.lit(k).alias("class"), F.log((F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)) + 1) / (F.lit(nc) + F.col("levels"))).alias("l")) for k, nc in all_classes]
    )
    model = seen.select("attribute", "value", like.alias("like"))
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    long = rows.select(key, F.inline(pairs))
    scored = long.join(model, ["attribute", "value"]).select(key, F.inline("like")).groupBy(key, "class").agg(F.sum("l").alias("l"))
    scored = scored.join(classes, "class").withColumn("score", F.col("l") + F.log(F.col("nc") / prior))
    best = scored.groupBy(key).agg(F.min_by("class", F.struct((-F.round("score", 9)).alias("s"), "class")).alias("predicted"))
    return rows.select(key).join(best, key, "left")


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, r2, n) of the least-squares line."""
    return df.agg(
        F.regr_slope(clean(y), clean(x)).alias("slope"), F.regr_intercept(clean(y), clean(x)).alias("intercept"),
        F.regr_r2(clean(y), clean(x)).alias("r2"), F.regr_count(clean(y), clean(x)).alias("n"),
    )


def features(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="skip").transform(df)


def vector_column(df: DataFrame, arr: str, name: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(name, array_to_vector(F.col(arr).cast("array<double>")))


def fit_predict(estimator, df: DataFrame) -> DataFrame:
    return estimator.fit(df).transform(df)


def fp_growth(baskets: DataFrame, items: str, support: float, confidence: float):
    """(frequent itemsets, association rules)."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol=items, minSupport=support, minConfidence=confidence).fit(baskets)
    return model.freqItemsets, model.associationRules


def sequential_patterns(df: DataFrame, sequence: str, support: float, length: int = 5) -> DataFrame:
    from pyspark.ml.fpm import PrefixSpan

    return PrefixSpan(sequenceCol=sequence, minSupport=support, maxPatternLength=length).findFrequentSequentialPatterns(df)


#: queries that travel to the rows at once, and numbers in their vectors, at most
QUERY_BLOCK = 50_000
BLOCK_VALUES = 4_000_000


def nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, neighbour, distance, rank): the ``k`` rows nearest to each query, the query itself left out.

    A stated query set against all rows, in blocks of bounded size: a
    block travels to the rows as one matrix, every batch of rows keeps the
    block's ``k`` best, and only those are merged.  With several blocks each
    one's result is written before the next is sent, so the driver holds one.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    wanted = queries.select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    size = wanted.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    block = min(QUERY_BLOCK, max(1, BLOCK_VALUES // max(size["d"] or 1, 1)))
    if size["n"] <= block:
        return _ranked(_block_search(rows, wanted.toArrow(), k), k)
    numbered = with_ordinal(wanted, "q", start=0)
    blocks = -(-size["n"] // block)
    parts = [cut(_ranked(_block_search(rows, numbered.where(F.expr(f"ordinal div {block} = {i}")).select("q", "v").toArrow(), k), k)) for i in range(blocks)]
    return union_all(parts)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block_search(rows: DataFrame, block, k: int = 1) -> DataFrame:
    import numpy as np
    import pandas as pd

    schema = "query bigint, neighbour bigint, distance double"
    ids = block.column("q").to_numpy()
    mat = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    norms = (mat * mat).sum(1)
    shared = rows.sparkSession.sparkContext.broadcast((ids, mat, norms))

    def search(batches):
        ids, mat, norms = shared.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            x = np.array(pdf["v"].tolist(), dtype=np.float64)
            own, square = pdf["id"].to_numpy(), (x * x).sum(1)
            step = max(1, 2_000_000 // len(x))
            for a in range(0, len(ids), step):
                b = a + step
                d = norms[a:b, None] + square[None, :] - 2 * mat[a:b] @ x.T
                d[ids[a:b, None] == own[None, :]] = np.inf
                m = min(k, d.shape[1])
                best = np.argpartition(d, m - 1, axis=1)[:, :m]
                dist = np.sqrt(np.maximum(np.take_along_axis(d, best, axis=1), 0)).ravel()
                out = pd.DataFrame({"query": np.repeat(ids[a:b], m), "neighbour": own[best].ravel(), "distance": dist})
                yield out[np.isfinite(out["distance"])]

    return rows.mapInPandas(search, schema)


def outlier_factor(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, upto: int | None = None) -> DataFrame:
    """(query, lof): local outlier factor of the queries, the largest over all neighbourhoods of ``k`` to ``upto`` rows.

    One search for the widest neighbourhood serves all; the queries, their
    neighbours and the neighbours of those are searched, no other rows.  Where
    all neighbours lie on the row itself the factor is 1.
    """
    most = upto or k
    near = nearest(df, queries, key, vector, most)
    second = nearest(df, df.join(near.select(F.col("neighbour").alias(key)).distinct(), key, "left_semi"), key, vector, most)
    third = nearest(df, df.join(second.select(F.col("neighbour").alias(key)).distinct(), key, "left_semi"), key, vector, most)
    sizes = F.explode(F.sequence(F.lit(k), F.lit(most))).alias("k")
    at = lambda d: d.select("query", "neighbour", "distance", "rank", sizes).where("rank <= k")
    near, second, third = at(near), at(second), at(third)

    def density(pairs: DataFrame, around: DataFrame, name: str) -> DataFrame:
        far = around.groupBy("k", F.col("query").alias("neighbour")).agg(F.max("distance").alias("kd"))
        return pairs.join(far, ["k", "neighbour"]).groupBy("k", "query").agg(F.try_divide(F.count("*"), F.sum(F.greatest("distance", "kd"))).alias(name))

    own = density(near, second, "lrd")
    theirs = density(second, third, "lrd_n").withColumnRenamed("query", "neighbour")
    factor = near.join(theirs, ["k", "neighbour"], "left").join(own, ["k", "query"]).groupBy("k", "query").agg(F.try_divide(F.avg("lrd_n"), F.first("lrd")).alias("lof"))
    return factor.groupBy("query").agg(F.coalesce(F.max("lof"), F.lit(1.0)).alias("lof"))


def smote(df: DataFrame, minority: DataFrame, key: str, vector: str, k: int, seed: int) -> DataFrame:
    """(key, vector): one synthetic row per minority row, between it and one of its k nearest of the class."""
    near = nearest(minority, minority, key, vector, k)
    pick = near.where(F.col("rank") == (F.pmod(F.xxhash64("query", F.lit(seed)), F.lit(k)) + 1))
    a = minority.select(F.col(key).alias("query"), F.col(vector).alias("a"))
    b = minority.select(F.col(key).alias("neighbour"), F.col(vector).alias("b"))
    gap = F.pmod(F.xxhash64("query", F.lit(seed + 1)), F.lit(10_000)) / 10_000.0
    mixed = F.zip_with(F.col("a").cast("array<double>"), F.col("b").cast("array<double>"), lambda x, y: x + (y - x) * gap)
    return pick.join(a, "query").join(b, "neighbour").select(F.col("query").alias(key), mixed.alias(vector))


def one_rule(train: DataFrame, rows: DataFrame, key: str, attribute: str, cls: str) -> DataFrame:
    """(key, predicted): the most frequent class of each level of one attribute, unseen levels get the overall one."""
    c = contingency(train, [attribute], cls)
    rule = c.groupBy("value").agg(F.min_by("class", F.struct((-F.col("n")).alias("n"), "class")).alias("predicted"))
    d = rows.select(key, F.col(attribute).cast("string").alias("value")).join(rule, "value", "left")
    return d.select(key, F.coalesce("predicted", zero_rule(train, cls).cast("string")).alias("predicted"))


#: sets in a row that bring nothing better before the search for attributes ends
STALE = 5


def cfs_select(df: DataFrame, attributes: Sequence[str], cls: str) -> list[str]:
    """Attributes chosen by correlation-based merit, best first, in the order of the schema.

    Correlation is symmetrical uncertainty.  One pass counts every pair of
    attributes (their number is the schema's, not the data's).  The search
    expands the best set that is still open and gives up after STALE sets that
    brought nothing better.
    """
    names = [*attributes, cls]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    cell = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(names[i]).cast("string").alias("a"), F.col(names[j]).cast("string").alias("b")) for i, j in pairs])
    n = df.select(F.inline(cell)).where("a IS NOT NULL AND b IS NOT NULL").groupBy("i", "j", "a", "b").agg(F.count("*").alias("n"))

    def ent(keys: list[str], label: str) -> DataFrame:
        g = n.groupBy("i", "j", *keys).agg(F.sum("n").alias("m"))
        return g.groupBy("i", "j").agg((F.log2(F.sum("m").cast("double")) - F.sum(_xlog(F.col("m"))) / F.sum("m")).alias(label))

    h = ent(["a"], "ha").join(ent(["b"], "hb"), ["i", "j"]).join(ent(["a", "b"], "hab"), ["i", "j"]).collect()
    su = {}
    for r in h:
        total = r["ha"] + r["hb"]
        su[r["i"], r["j"]] = su[r["j"], r["i"]] = 2 * (total - r["hab"]) / total if total > 0 else 0.0
    last = len(attributes)

    def merit(s: frozenset) -> float:
        rcf = sum(su.get((x, last), 0.0) for x in s)
        rff = sum(su.get((x, y), 0.0) for x in s for y in s if x < y)
        return rcf / math.sqrt(len(s) + 2 * rff)

    best, chosen, stale = 0.0, frozenset(), 0
    opened: list[tuple[float, list[int]]] = [(0.0, [])]
    seen = {frozenset()}
    while opened and stale < STALE:
        _, head = heapq.heappop(opened)
        better = False
        for a in range(len(attributes)):
            s = frozenset([*head, a])
            if s in seen:
                continue
            seen.add(s)
            m = merit(s)
            heapq.heappush(opened, (-m, sorted(s)))
            if m > best + 1e-12:
                best, chosen, better = m, s, True
        stale = 0 if better else stale + 1
    return [attributes[i] for i in sorted(chosen)]


def naive_bayes_multinomial(train: DataFrame, rows: DataFrame, key: str, words: str, cls: str) -> DataFrame:
    """(key, predicted): multinomial naive Bayes over an array of words, add-one smoothing.

    The model is one count per (word, class).  A word is met by its logarithm
    relative to an unseen word of the class, so words the class lacks cost one
    number per row and class, and no row meets a word it does not hold.  Words
    never seen in training are left out; rows without words get the prior.
    """
    used = train.where(F.col(cls).isNotNull()).select(F.col(cls).cast("string").alias("class"), F.explode(words).alias("word"))
    counts = used.groupBy("word", "class").agg(F.count("*").alias("n"))
    vocabulary = counts.select(F.countDistinct("word").alias("v")).scalar()
    prior = train.where(F.col(cls).isNotNull()).groupBy(F.col(cls).cast("string").alias("class")).agg(F.count("*").alias("docs"))
    totals = prior.join(counts.groupBy("class").agg(F.sum("n").alias("t")), "class", "left")
    all_docs = prior.select(F.sum("docs").alias("d")).scalar()
    classes = totals.select("class", F.log(F.col("docs") / all_docs).alias("prior"), F.log(F.coalesce("t", F.lit(0)) + vocabulary).alias("size"))
    bag = rows.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("m"))
    known = bag.join(counts.select("word").distinct(), "word", "left_semi")
    length = known.groupBy(key).agg(F.sum("m").alias("len"))
    hit = known.join(counts, "word").groupBy(key, "class").agg(F.sum(F.col("m") * F.log(F.col("n") + 1)).alias("gain"))
    # one row per class and row to be classified: classes are few, their number is the domain's
    table = F.broadcast(classes.agg(F.collect_list(F.struct("class", "prior", "size")).alias("all")))
    gains = hit.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("class", "gain"))).alias("gains"))
    d = rows.select(key).join(length, key, "left").join(gains, key, "left").withColumn("all", table.select("all").scalar())
    score = F.transform(
        "all",
        lambda c: F.struct((-F.round(c["prior"] - F.coalesce("len", F.lit(0)) * c["size"] + F.coalesce(F.try_element_at("gains", c["class"]), F.lit(0.0)), 9)).alias("s"), c["class"].alias("class")),
    )
    return d.select(key, F.array_min(score)["class"].alias("predicted"))


def decision_stump(train: DataFrame, rows: DataFrame, key: str, attributes: Sequence[str], cls: str, weight: str | None = None) -> DataFrame:
    """(key, predicted): one test ``attribute = value`` of least weighted error; missing goes a way of its own.

    Every test is scored from the contingency counts.
    """
    return _apply_stump(rows, key, _best_stump(train, attributes, cls, weight))


def _best_stump(train: DataFrame, attributes: Sequence[str], cls: str, weight: str | None) -> dict:
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    w = F.col(weight) if weight else F.lit(1.0)
    cells = train.where(F.col(cls).isNotNull()).select(F.col(cls).cast("string").alias("class"), w.alias("w"), F.inline(pairs)).groupBy("attribute", "value", "class").agg(F.sum("w").alias("w"))
    side = cells.where("value IS NOT NULL").groupBy("attribute", "class").agg(F.sum("w").alias("t"))
    inside = cells.where("value IS NOT NULL").withColumnRenamed("w", "i")
    # for each test and class: what holds the value, and the rest
    split = inside.select("attribute", "value").distinct().join(side, "attribute").join(inside, ["attribute", "value", "class"], "left")
    split = split.select("attribute", "value", "class", F.coalesce("i", F.lit(0.0)).alias("i"), (F.col("t") - F.coalesce("i", F.lit(0.0))).alias("o"))
    top = lambda c: F.min_by("class", F.struct((-F.round(c, 9)).alias("w"), "class"))
    scored = split.groupBy("attribute", "value").agg((F.max("i") + F.max("o")).alias("right"), top("i").alias("yes"), top("o").alias("no"))
    best = scored.orderBy(F.desc(F.round("right", 9)), "attribute", "value").first()
    missing = cells.groupBy("class").agg(F.sum("w").alias("w")).orderBy(F.desc(F.round("w", 9)), "class").first()
    most = missing["class"] if missing else None
    return {**best.asDict(), "missing": most} if best else {"attribute": None, "value": None, "yes": most, "no": most, "missing": most}


def _stump_column(stump: dict) -> Column:
    if stump["attribute"] is None:
        return F.lit(stump["missing"]).cast("string")
    v = F.col(stump["attribute"]).cast("string")
    return F.when(v.isNull(), F.lit(stump["missing"])).when(v == stump["value"], F.lit(stump["yes"])).otherwise(F.lit(stump["no"]))


def _apply_stump(rows: DataFrame, key: str, stump: dict) -> DataFrame:
    return rows.select(key, _stump_column(stump).alias("predicted"))


def ada_boost(train: DataFrame, rows: DataFrame, key: str, attributes: Sequence[str], cls: str, rounds: int) -> DataFrame:
    """(key, predicted): stumps boosted by reweighting (AdaBoost.M1), votes weighted by log((1 - e) / e).

    A row's weight is a product over the stumps so far, so it is an expression
    of the row and no weights are stored.  The rounds end early when a stump
    makes no error or errs on half of the weight.
    """
    known = train.where(F.col(cls).isNotNull())
    weight, votes = F.lit(1.0), []
    for _ in range(rounds):
        d = known.withColumn("__w", weight)
        stump = _best_stump(d, attributes, cls, "__w")
        said = _stump_column(stump)
        wrong = ~said.eqNullSafe(F.col(cls).cast("string"))
        total, bad = d.agg(F.sum("__w").alias("t"), F.coalesce(F.sum(F.when(wrong, F.col("__w"))), F.lit(0.0)).alias("b")).first()
        error = bad / total if total else 0.0
        if not votes and (error >= 0.5 or error <= 0):
            votes.append((said, 1.0))
        if error >= 0.5 or error <= 0:
            break
        beta = (1 - error) / error
        votes.append((said, math.log(beta)))
        weight = weight * F.when(wrong, F.lit(beta)).otherwise(F.lit(1.0))
    pairs = F.array(*[F.struct(c.alias("class"), F.lit(float(a)).alias("a")) for c, a in votes])
    total = rows.select(key, F.inline(pairs)).groupBy(key, "class").agg(F.sum("a").alias("a"))
    return total.groupBy(key).agg(F.min_by("class", F.struct((-F.round("a", 9)).alias("a"), "class")).alias("predicted"))


def farthest_first(df: DataFrame, key: str, vector: str, k: int, first) -> list:
    """Keys of ``k`` centres: from ``first`` on, always the row farthest from those chosen (ties to the smaller key).

    One aggregate per centre; only centres reach the driver.
    """
    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("__v"))
    chosen, centres = [], []
    start = rows.where(F.col(key) == first).first()
    if start is None:
        raise ValueError("the first centre is not among the rows")
    while True:
        chosen.append(start[key])
        centres.append(start["__v"])
        if len(chosen) == k:
            return chosen
        far = rows.where(~F.col(key).isin(*chosen)).agg(F.min_by(F.struct(key, "__v"), F.struct((-F.round(_closest(centres), 9)).alias("d"), key)).alias("m")).first()["m"]
        if far is None:
            return chosen
        start = far


def _distance(centre: list) -> Column:
    point = F.array(*[F.lit(float(x)) for x in centre])
    return F.sqrt(F.aggregate(F.zip_with("__v", point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def _closest(centres: list[list]) -> Column:
    each = [_distance(c) for c in centres]
    return F.least(*each) if len(each) > 1 else each[0]


def without_misclassified(rows: DataFrame, predicted: DataFrame, key: str, cls: str) -> DataFrame:
    """The rows whose prediction agrees with their class; rows without a class or a prediction stay."""
    p = predicted.select(key, F.col("predicted").cast("string").alias("__p"))
    agrees = F.col("__p").isNull() | F.col(cls).isNull() | (F.col("__p") == F.col(cls).cast("string"))
    return rows.join(p, key, "left").where(agrees).drop("__p")
