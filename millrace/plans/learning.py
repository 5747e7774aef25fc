"""Mining queries."""

from pyspark.sql import functions as F

from ..operators import learners as L
from ..operators import mining as M
from .registry import query

_SCORES = """WITH c AS (SELECT attribute, value, class, count(*)::DOUBLE AS n FROM (SELECT unnest(['NominalAtt1', 'StringAtt2']) AS attribute, unnest([NominalAtt1, StringAtt2]) AS value, NominalAtt2 AS class FROM filter_row)
  WHERE value IS NOT NULL AND class IS NOT NULL GROUP BY 1, 2, 3), v AS (SELECT attribute, value, sum(n) AS nv, max(n) AS best FROM c GROUP BY 1, 2), k AS (SELECT attribute, class, sum(n) AS nc FROM c GROUP BY 1, 2),
  t AS (SELECT attribute, sum(nv) AS n, sum(best) AS ok FROM v GROUP BY 1), hv AS (SELECT attribute, -sum(nv / n * log2(nv / n)) AS h FROM v JOIN t USING (attribute) GROUP BY 1),
  hk AS (SELECT attribute, -sum(nc / n * log2(nc / n)) AS h FROM k JOIN t USING (attribute) GROUP BY 1), hj AS (SELECT c.attribute, -sum(c.n / t.n * log2(c.n / t.n)) AS h FROM c JOIN t USING (attribute) GROUP BY 1),
  x AS (SELECT c.attribute, sum(c.n * c.n / (nv * nc)) AS q FROM c JOIN v USING (attribute, value) JOIN k USING (attribute, class) GROUP BY 1)
  SELECT attribute, round(hk.h + hv.h - hj.h, 6) AS info_gain, round((hk.h + hv.h - hj.h) / hv.h, 6) AS gain_ratio, round(2 * (hk.h + hv.h - hj.h) / (hk.h + hv.h), 6) AS symmetric_uncertainty,
  round(t.n * (q - 1), 4) AS chi_squared, round(ok / t.n, 6) AS one_rule FROM t JOIN hv USING (attribute) JOIN hk USING (attribute) JOIN hj USING (attribute) JOIN x USING (attribute)"""


@query("attribute_scores", _SCORES)
def _(t):
    s = M.attribute_scores(t.filter_row, ["NominalAtt1", "StringAtt2"], "NominalAtt2")
    return s.select("attribute", *[F.round(c, 4 if c == "chi_squared" else 6).alias(c) for c in s.columns[1:]])


@query("zero_rule", "SELECT ord, (SELECT NominalAtt2 FROM filter_row WHERE NominalAtt2 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS predicted FROM filter_row")
def _(t):
    return t.filter_row.select("ord", M.zero_rule(t.filter_row, "NominalAtt2").alias("predicted"))


_CELLS = "SELECT ord, NominalAtt2 AS class, unnest(['NominalAtt1', 'StringAtt2']) AS attribute, unnest([NominalAtt1, StringAtt2]) AS value FROM filter_row"


@query(
    "naive_bayes",
    f"""WITH p AS ({_CELLS}), c AS (SELECT attribute, value, class, count(*) AS n FROM p WHERE value IS NOT NULL AND class IS NOT NULL GROUP BY ALL), k AS (SELECT NominalAtt2 AS class, count(*) AS nc FROM filter_row WHERE NominalAtt2 IS NOT NULL GROUP BY 1),
       l AS (SELECT attribute, count(DISTINCT value) AS levels FROM c GROUP BY 1), v AS (SELECT DISTINCT attribute, value FROM c),
       m AS (SELECT v.attribute, v.value, k.class, ln((coalesce(n, 0) + 1)::DOUBLE / (nc + levels)) AS s FROM v JOIN l USING (attribute) CROSS JOIN k LEFT JOIN c ON c.attribute = v.attribute AND c.value = v.value AND c.class = k.class),
       s AS (SELECT ord, m.class, sum(s) AS l FROM p JOIN m USING (attribute, value) GROUP BY 1, 2), t AS (SELECT ord, class, round(l + ln(nc::DOUBLE / (SELECT sum(nc) FROM k)), 9) AS score FROM s JOIN k USING (class))
       SELECT ord, arg_min(class, (-score, class)) AS predicted FROM filter_row LEFT JOIN t USING (ord) GROUP BY 1""",
)
def _(t):
    return M.naive_bayes(t.filter_row, t.filter_row, "ord", ["NominalAtt1", "StringAtt2"], "NominalAtt2")


@query("simple_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem")
def _(t):
    r = M.simple_regression(t.lineitem, "l_quantity", "l_extendedprice")
    return r.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query(
    "linear_regression",
    """WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS qq, covar_pop(l_quantity, l_discount) AS qd, covar_pop(l_discount, l_discount) AS dd, covar_pop(l_extendedprice, l_quantity) AS yq, covar_pop(l_extendedprice, l_discount) AS yd,
       avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS my FROM lineitem), b AS (SELECT *, (yq * dd - yd * qd) / (qq * dd - qd * qd) AS b1, (yd * qq - yq * qd) / (qq * dd - qd * qd) AS b2 FROM s)
       SELECT l_orderkey, round(my + b1 * (l_quantity - mq) + b2 * (l_discount - md), 3) AS prediction FROM lineitem, b""",
)
def _(t):
    from pyspark.ml.regression import LinearRegression

    d = M.features(t.lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice"), ["l_quantity", "l_discount"])
    return M.fit_predict(LinearRegression(labelCol="l_extendedprice", solver="normal"), d).select("l_orderkey", F.round("prediction", 3).alias("prediction"))


@query(
    "isotonic_regression",
    """WITH u AS (SELECT p_size::DOUBLE AS x, count(*) AS w, avg(p_retailprice) AS y FROM part GROUP BY 1), r AS (SELECT a.x AS lo, b.x AS hi, sum(u.w * u.y) / sum(u.w) AS m FROM u a JOIN u b ON b.x >= a.x JOIN u ON u.x BETWEEN a.x AND b.x GROUP BY 1, 2),
       g AS (SELECT u.x, lo, min(m) AS least FROM u JOIN r ON lo <= u.x AND hi >= u.x GROUP BY 1, 2), f AS (SELECT x, max(least) AS v FROM g GROUP BY 1) SELECT p_partkey, round(v, 4) AS prediction FROM part JOIN f ON x = p_size""",
)
def _(t):
    from pyspark.ml.regression import IsotonicRegression

    d = M.features(t.part.select("p_partkey", F.col("p_size").cast("double").alias("x"), "p_retailprice"), ["x"])
    return M.fit_predict(IsotonicRegression(labelCol="p_retailprice"), d).select("p_partkey", F.round("prediction", 4).alias("prediction"))


@query("logistic")
def _(t):
    from pyspark.ml.classification import LogisticRegression

    d = M.vector_column(t.embeddings.withColumn("label", F.pmod("label", F.lit(2)).cast("double")), "embedding")
    return M.fit_predict(LogisticRegression(maxIter=5), d).select("vec_id", "prediction")


@query("decision_tree")
def _(t):
    from pyspark.ml.classification import DecisionTreeClassifier

    d = M.vector_column(t.embeddings.withColumn("label", F.pmod("label", F.lit(2)).cast("double")), "embedding")
    return M.fit_predict(DecisionTreeClassifier(maxDepth=3, seed=1), d).select("vec_id", "prediction")


@query("random_forest")
def _(t):
    from pyspark.ml.classification import RandomForestClassifier

    d = M.vector_column(t.embeddings.withColumn("label", F.pmod("label", F.lit(2)).cast("double")), "embedding")
    return M.fit_predict(RandomForestClassifier(numTrees=5, maxDepth=3, seed=1), d).select("vec_id", "prediction")


@query("kmeans")
def _(t):
    from pyspark.ml.clustering import KMeans

    return M.fit_predict(KMeans(k=5, seed=1, maxIter=5), M.vector_column(t.embeddings, "embedding")).select("vec_id", F.col("prediction").alias("cluster"))


@query("mixture_clusters")
def _(t):
    from pyspark.ml.clustering import GaussianMixture

    d = M.features(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return M.fit_predict(GaussianMixture(k=3, seed=1, maxIter=5), d).select("c_custkey", F.col("prediction").alias("cluster"))


@query(
    "fpgrowth",
    """WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS o, 's' || l_suppkey AS i FROM lineitem), n AS (SELECT ceil(count(DISTINCT o) * 0.05) AS c FROM b), one AS (SELECT i FROM b GROUP BY i HAVING count(*) >= (SELECT c FROM n)), f AS (SELECT o, i FROM b JOIN one USING (i)),
       s AS (SELECT o, [i] AS items, i AS top FROM f UNION ALL SELECT f.o, list_append(items, f.i), f.i FROM s JOIN f ON f.o = s.o AND f.i > s.top) SELECT items, count(*) AS freq FROM s GROUP BY 1 HAVING count(*) >= (SELECT c FROM n)""",
)
def _(t):
    baskets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("items"))
    return M.fp_growth(baskets, "items", 0.05, 0.1)[0].select(F.array_sort("items").alias("items"), "freq")


@query(
    "sequential_patterns",
    """WITH e AS (SELECT user_id, event_type AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), n AS (SELECT ceil(count(DISTINCT user_id) * 0.9) AS c FROM events), a AS (SELECT user_id, [[i]] AS sequence, min(p) AS p FROM e GROUP BY user_id, i),
       b AS (SELECT a.user_id, list_append(sequence, [i]) AS sequence, min(e.p) AS p FROM a JOIN e ON e.user_id = a.user_id AND e.p > a.p GROUP BY a.user_id, sequence, i), c AS (SELECT b.user_id, list_append(sequence, [i]) AS sequence, min(e.p) AS p FROM b JOIN e ON e.user_id = b.user_id AND e.p > b.p GROUP BY b.user_id, sequence, i)
       SELECT sequence, count(*) AS freq FROM (FROM a UNION ALL FROM b UNION ALL FROM c) GROUP BY 1 HAVING count(*) >= (SELECT c FROM n)""",
)
def _(t):
    seq = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("s"))
    return M.sequential_patterns(seq.select(F.transform("s", lambda x: F.array(x["event_type"])).alias("sequence")), "sequence", 0.9, 3)


@query(
    "nearest_rows",
    """WITH d AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
       SELECT query, neighbour, round(distance, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) <= 5""",
)
def _(t):
    q = t.embeddings.where("vec_id % 100 = 0")
    return M.nearest(t.embeddings, q, "vec_id", "embedding", 5).select("query", "neighbour", F.round("distance", 5).alias("distance"))


@query(
    "outlier_factor",
    """WITH d AS (SELECT a.vec_id AS q, b.vec_id AS n, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), r AS (SELECT q, n, d, row_number() OVER (PARTITION BY q ORDER BY d, n) AS r FROM d QUALIFY r <= 10),
       w AS (SELECT q, n, d, k FROM r, unnest(range(5, 11)) AS u(k) WHERE r <= k), kd AS (SELECT q, k, max(d) AS kd FROM w GROUP BY 1, 2), l AS (SELECT w.q, w.k, count(*) / nullif(sum(greatest(w.d, kd.kd)), 0) AS lrd FROM w JOIN kd ON kd.q = w.n AND kd.k = w.k GROUP BY 1, 2),
       f AS (SELECT w.q, w.k, avg(b.lrd) / any_value(a.lrd) AS lof FROM w JOIN l b ON b.q = w.n AND b.k = w.k JOIN l a ON a.q = w.q AND a.k = w.k WHERE w.q % 100 = 0 GROUP BY 1, 2) SELECT q AS query, round(coalesce(max(lof), 1), 4) AS lof FROM f GROUP BY 1""",
)
def _(t):
    f = M.outlier_factor(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", 5, 10)
    return f.select("query", F.round("lof", 4).alias("lof"))


@query("smote")
def _(t):
    minority = t.embeddings.where("label = 1").select("vec_id", "embedding")
    return M.smote(t.embeddings, minority, "vec_id", "embedding", 5, 1)


@query(
    "one_rule",
    """WITH c AS (SELECT StringAtt2 AS value, NominalAtt2 AS class, count(*) AS n FROM filter_row WHERE StringAtt2 IS NOT NULL AND NominalAtt2 IS NOT NULL GROUP BY 1, 2),
       r AS (SELECT value, arg_min(class, (-n, class)) AS predicted FROM c GROUP BY 1)
       SELECT ord, coalesce(predicted, (SELECT NominalAtt2 FROM filter_row WHERE NominalAtt2 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS predicted FROM filter_row LEFT JOIN r ON StringAtt2 = value""",
)
def _(t):
    return M.one_rule(t.filter_row, t.filter_row, "ord", "StringAtt2", "NominalAtt2")


_PAIRS = """x AS (SELECT unnest(['a', 'a', 'a', 'b', 'b', 'c']) AS i, unnest(['b', 'c', 'k', 'c', 'k', 'k']) AS j, unnest([StringAtt1, StringAtt1, StringAtt1, NominalAtt1, NominalAtt1, StringAtt2]) AS u,
  unnest([NominalAtt1, StringAtt2, NominalAtt2, StringAtt2, NominalAtt2, NominalAtt2]) AS v FROM filter_row), y AS (SELECT * FROM x WHERE u IS NOT NULL AND v IS NOT NULL), t AS (SELECT i, j, count(*)::DOUBLE AS n FROM y GROUP BY 1, 2),
  hu AS (SELECT i, j, -sum(c / n * log2(c / n)) AS h FROM (SELECT i, j, u, count(*)::DOUBLE AS c FROM y GROUP BY 1, 2, 3) JOIN t USING (i, j) GROUP BY 1, 2), hv AS (SELECT i, j, -sum(c / n * log2(c / n)) AS h FROM (SELECT i, j, v, count(*)::DOUBLE AS c FROM y GROUP BY 1, 2, 3) JOIN t USING (i, j) GROUP BY 1, 2),
  hj AS (SELECT i, j, -sum(c / n * log2(c / n)) AS h FROM (SELECT i, j, u, v, count(*)::DOUBLE AS c FROM y GROUP BY 1, 2, 3, 4) JOIN t USING (i, j) GROUP BY 1, 2),
  su AS (SELECT i || j AS p, CASE WHEN hu.h + hv.h > 0 THEN 2 * (hu.h + hv.h - hj.h) / (hu.h + hv.h) ELSE 0 END AS s FROM hu JOIN hv USING (i, j) JOIN hj USING (i, j)), m AS (SELECT map(list(p), list(s)) AS m FROM su)"""


@query(
    "attribute_selection",
    f"""WITH {_PAIRS}, s AS (SELECT ['StringAtt1'] AS names, m['ak'] AS merit FROM m UNION ALL SELECT ['NominalAtt1'], m['bk'] FROM m UNION ALL SELECT ['StringAtt2'], m['ck'] FROM m UNION ALL SELECT ['StringAtt1', 'NominalAtt1'], (m['ak'] + m['bk']) / sqrt(2 + 2 * m['ab']) FROM m
       UNION ALL SELECT ['StringAtt1', 'StringAtt2'], (m['ak'] + m['ck']) / sqrt(2 + 2 * m['ac']) FROM m UNION ALL SELECT ['NominalAtt1', 'StringAtt2'], (m['bk'] + m['ck']) / sqrt(2 + 2 * m['bc']) FROM m
       UNION ALL SELECT ['StringAtt1', 'NominalAtt1', 'StringAtt2'], (m['ak'] + m['bk'] + m['ck']) / sqrt(3 + 2 * (m['ab'] + m['ac'] + m['bc'])) FROM m) SELECT unnest(arg_max(names, merit)) AS attribute FROM s""",
)
def _(t):
    chosen = M.cfs_select(t.filter_row, ["StringAtt1", "NominalAtt1", "StringAtt2"], "NominalAtt2")
    return t.spark.createDataFrame([(c,) for c in chosen], "attribute string")


@query(
    "naive_bayes_multinomial",
    """WITH w AS (SELECT doc_id, doc_kind AS class, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT word, class, count(*) AS n FROM w WHERE class IS NOT NULL GROUP BY 1, 2), k AS (SELECT doc_kind AS class, count(*) AS docs FROM documents WHERE doc_kind IS NOT NULL GROUP BY 1),
       t AS (SELECT class, sum(n) AS t FROM c GROUP BY 1), v AS (SELECT count(DISTINCT word) AS v FROM c), b AS (SELECT doc_id, word, count(*) AS m FROM w WHERE word IN (SELECT word FROM c) GROUP BY 1, 2), l AS (SELECT doc_id, sum(m) AS len FROM b GROUP BY 1),
       g AS (SELECT doc_id, c.class, sum(m * ln((n + 1)::DOUBLE)) AS gain FROM b JOIN c USING (word) GROUP BY 1, 2), s AS (SELECT d.doc_id, k.class, round(ln(docs::DOUBLE / (SELECT sum(docs) FROM k)) - coalesce(len, 0) * ln((coalesce(t, 0) + v)::DOUBLE) + coalesce(gain, 0), 6) AS s
         FROM documents d CROSS JOIN k CROSS JOIN v LEFT JOIN t ON t.class = k.class LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id AND g.class = k.class) SELECT doc_id, arg_min(class, (-s, class)) AS predicted FROM s GROUP BY 1""",
)
def _(t):
    d = t.documents.select("doc_id", "doc_kind", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("words"))
    return M.naive_bayes_multinomial(d, d, "doc_id", "words", "doc_kind")


@query(
    "decision_stump",
    f"""WITH p AS ({_CELLS}), c AS (SELECT attribute, value, class, count(*)::DOUBLE AS w FROM p WHERE class IS NOT NULL GROUP BY ALL), t AS (SELECT attribute, class, sum(w) AS t FROM c WHERE value IS NOT NULL GROUP BY 1, 2), v AS (SELECT DISTINCT attribute, value FROM c WHERE value IS NOT NULL),
       s AS (SELECT v.attribute, v.value, t.class, coalesce(w, 0) AS i, t - coalesce(w, 0) AS o FROM v JOIN t USING (attribute) LEFT JOIN c ON c.attribute = v.attribute AND c.value = v.value AND c.class = t.class),
       b AS (SELECT attribute, value, max(i) + max(o) AS ok, arg_min(class, (-i, class)) AS yes, arg_min(class, (-o, class)) AS no FROM s GROUP BY 1, 2 ORDER BY ok DESC, attribute, value LIMIT 1), m AS (SELECT arg_min(class, (-w, class)) AS most FROM (SELECT class, sum(w) AS w FROM c GROUP BY 1))
       SELECT ord, CASE WHEN p.value IS NULL THEN most WHEN p.value = b.value THEN yes ELSE no END AS predicted FROM p JOIN b ON p.attribute = b.attribute, m""",
)
def _(t):
    return M.decision_stump(t.filter_row, t.filter_row, "ord", ["NominalAtt1", "StringAtt2"], "NominalAtt2")


@query("ada_boost")
def _(t):
    return M.ada_boost(t.filter_row, t.filter_row, "ord", ["StringAtt1", "NominalAtt1", "StringAtt2"], "NominalAtt2", 5)


@query(
    "farthest_first",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT * FROM e ORDER BY vec_id LIMIT 1), b AS (SELECT e.* FROM e, a WHERE e.vec_id <> a.vec_id ORDER BY round(list_distance(e.v, a.v), 9) DESC, e.vec_id LIMIT 1),
       c AS (SELECT e.* FROM e, a, b WHERE e.vec_id NOT IN (a.vec_id, b.vec_id) ORDER BY round(least(list_distance(e.v, a.v), list_distance(e.v, b.v)), 9) DESC, e.vec_id LIMIT 1), d AS (SELECT e.* FROM e, a, b, c WHERE e.vec_id NOT IN (a.vec_id, b.vec_id, c.vec_id)
         ORDER BY round(least(list_distance(e.v, a.v), list_distance(e.v, b.v), list_distance(e.v, c.v)), 9) DESC, e.vec_id LIMIT 1)
       SELECT 1 AS rank, vec_id FROM a UNION ALL SELECT 2, vec_id FROM b UNION ALL SELECT 3, vec_id FROM c UNION ALL SELECT 4, vec_id FROM d""",
)
def _(t):
    first = t.embeddings.agg(F.min("vec_id")).first()[0]
    return t.spark.createDataFrame(list(enumerate(M.farthest_first(t.embeddings, "vec_id", "embedding", 4, first), 1)), "rank int, vec_id bigint")


@query("bisecting_kmeans")
def _(t):
    from pyspark.ml.clustering import BisectingKMeans

    return M.fit_predict(BisectingKMeans(k=5, seed=1, maxIter=5), M.vector_column(t.embeddings, "embedding")).select("vec_id", F.col("prediction").alias("cluster"))


@query("cluster_membership", "SELECT c_custkey, true AS whole, 3 AS clusters FROM customer")
def _(t):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array

    d = M.features(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])
    d = M.fit_predict(GaussianMixture(k=3, seed=1, maxIter=5), d).select("c_custkey", vector_to_array("probability").alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return d.select("c_custkey", (F.abs(total - 1) < 1e-9).alias("whole"), F.size("p").alias("clusters"))


@query(
    "remove_misclassified",
    """WITH c AS (SELECT StringAtt2 AS value, NominalAtt2 AS class, count(*) AS n FROM filter_row WHERE StringAtt2 IS NOT NULL AND NominalAtt2 IS NOT NULL GROUP BY 1, 2), r AS (SELECT value, arg_min(class, (-n, class)) AS p FROM c GROUP BY 1),
       z AS (SELECT NominalAtt2 AS p FROM filter_row WHERE NominalAtt2 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT ord FROM filter_row LEFT JOIN r ON StringAtt2 = value, z WHERE NominalAtt2 IS NULL OR NominalAtt2 = coalesce(r.p, z.p)""",
)
def _(t):
    said = M.one_rule(t.filter_row, t.filter_row, "ord", "StringAtt2", "NominalAtt2")
    return M.without_misclassified(t.filter_row.select("ord", "NominalAtt2"), said, "ord", "NominalAtt2").select("ord")


@query(
    "nearest_class",
    """WITH d AS (SELECT a.vec_id AS vec_id, b.label AS predicted, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.label IS NOT NULL WHERE a.vec_id % 100 = 0)
       SELECT vec_id, predicted FROM d WHERE r = 1""",
)
def _(t):
    return L.nearest_class(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", "label")


_NUMBERS = "CASE WHEN isnan(NumericAtt1) THEN NULL ELSE NumericAtt1 END AS x, CASE WHEN isnan(NumericAtt2) THEN NULL ELSE NumericAtt2 END AS y"


@query(
    "gaussian_bayes",
    f"""WITH d AS (SELECT ord, NominalAtt2 AS class, {_NUMBERS} FROM filter_row), m AS (SELECT class, count(*) AS n, avg(x) AS mx, greatest(coalesce(stddev_samp(x), 0), 1e-3) AS sx, avg(y) AS my, greatest(coalesce(stddev_samp(y), 0), 1e-3) AS sy FROM d WHERE class IS NOT NULL GROUP BY 1),
       s AS (SELECT ord, m.class, round(ln(n::DOUBLE / (SELECT sum(n) FROM m)) + coalesce(-((x - mx) / sx) * ((x - mx) / sx) / 2 - ln(sx), 0) + coalesce(-((y - my) / sy) * ((y - my) / sy) / 2 - ln(sy), 0), 9) AS s FROM d CROSS JOIN m) SELECT ord, arg_min(class, (-s, class)) AS predicted FROM s GROUP BY 1""",
)
def _(t):
    return L.gaussian_bayes(t.filter_row, t.filter_row, "ord", ["NumericAtt1", "NumericAtt2"], "NominalAtt2")


@query(
    "hyper_pipes",
    f"""WITH d AS (SELECT ord, NominalAtt2 AS class, {_NUMBERS} FROM filter_row), m AS (SELECT class, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM d WHERE class IS NOT NULL GROUP BY 1),
       s AS (SELECT ord, m.class, CASE WHEN x BETWEEN lx AND hx THEN 1 ELSE 0 END + CASE WHEN y BETWEEN ly AND hy THEN 1 ELSE 0 END AS n FROM d CROSS JOIN m) SELECT ord, arg_min(class, (-n, class)) AS predicted FROM s GROUP BY 1""",
)
def _(t):
    return L.hyper_pipes(t.filter_row, t.filter_row, "ord", ["NumericAtt1", "NumericAtt2"], "NominalAtt2")


@query(
    "averaged_dependence",
    """WITH f AS (SELECT ord, NominalAtt2 AS class, NominalAtt1 AS a, StringAtt2 AS b FROM filter_row), k AS (SELECT * FROM f WHERE class IS NOT NULL), z AS (SELECT count(*) AS total, count(DISTINCT class) AS kinds, count(DISTINCT a) AS la, count(DISTINCT b) AS lb FROM k),
       c AS (SELECT DISTINCT class FROM k), pa AS (SELECT a, class, count(*) AS n FROM k WHERE a IS NOT NULL GROUP BY 1, 2), pb AS (SELECT b, class, count(*) AS n FROM k WHERE b IS NOT NULL GROUP BY 1, 2), ab AS (SELECT a, b, class, count(*) AS n FROM k WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3),
       s AS (SELECT f.ord, c.class, CASE WHEN f.a IN (SELECT a FROM pa) THEN (coalesce(pa.n, 0) + 1) / (total + kinds * la)::DOUBLE * CASE WHEN f.b IS NULL THEN 1 ELSE (coalesce(ab.n, 0) + 1) / (coalesce(pa.n, 0) + lb)::DOUBLE END ELSE 0 END
         + CASE WHEN f.b IN (SELECT b FROM pb) THEN (coalesce(pb.n, 0) + 1) / (total + kinds * lb)::DOUBLE * CASE WHEN f.a IS NULL THEN 1 ELSE (coalesce(ab.n, 0) + 1) / (coalesce(pb.n, 0) + la)::DOUBLE END ELSE 0 END AS s
         FROM f CROSS JOIN c CROSS JOIN z LEFT JOIN pa ON pa.a = f.a AND pa.class = c.class LEFT JOIN pb ON pb.b = f.b AND pb.class = c.class LEFT JOIN ab ON ab.a = f.a AND ab.b = f.b AND ab.class = c.class)
       SELECT ord, arg_min(class, (-round(ln(s), 9), class)) FILTER (s > 0) AS predicted FROM s GROUP BY 1""",
)
def _(t):
    return L.averaged_dependence(t.filter_row, t.filter_row, "ord", ["NominalAtt1", "StringAtt2"], "NominalAtt2")


@query("consistency", "WITH c AS (SELECT NominalAtt1, StringAtt2, NominalAtt2, count(*) AS n FROM filter_row WHERE NominalAtt2 IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT max(n) AS m, sum(n) AS t FROM c GROUP BY NominalAtt1, StringAtt2) SELECT round(sum(m) / sum(t)::DOUBLE, 9) AS consistency FROM b")
def _(t):
    return t.spark.range(1).select(F.round(L.consistency(t.filter_row, ["NominalAtt1", "StringAtt2"], "NominalAtt2"), 9).alias("consistency"))


@query(
    "association_rules",
    """WITH RECURSIVE b AS (SELECT DISTINCT user_id AS o, event_type AS i FROM events WHERE value > 50), n AS (SELECT count(DISTINCT o) AS c FROM b), one AS (SELECT i FROM b GROUP BY i HAVING count(*) >= (SELECT ceil(c * 0.05) FROM n)), f AS (SELECT o, i FROM b JOIN one USING (i)),
       s AS (SELECT o, [i] AS items, i AS top FROM f UNION ALL SELECT f.o, list_append(items, f.i), f.i FROM s JOIN f ON f.o = s.o AND f.i > s.top), q AS (SELECT items, count(*) AS freq FROM s GROUP BY 1 HAVING count(*) >= (SELECT ceil(c * 0.05) FROM n)),
       r AS (SELECT list_filter(items, lambda x: x <> i) AS antecedent, i AS consequent, freq FROM (SELECT items, freq, unnest(items) AS i FROM q WHERE len(items) > 1))
       SELECT antecedent, consequent, round(r.freq / a.freq, 9) AS confidence, round((r.freq / a.freq) / (c.freq / (SELECT c FROM n)), 9) AS lift FROM r JOIN q a ON a.items = antecedent JOIN q c ON c.items = [consequent] WHERE r.freq / a.freq >= 0.5""",
)
def _(t):
    d = t.events.where("value > 50").groupBy("user_id").agg(F.collect_set("event_type").alias("items"))
    r = L.association_rules(d, "items", 0.05, 0.5)
    return r.select("antecedent", "consequent", F.round("confidence", 9).alias("confidence"), F.round("lift", 9).alias("lift"))


@query("id3")
def _(t):
    return L.id3(t.filter_row, t.filter_row, "ord", ["NominalAtt1", "StringAtt2", "StringAtt1"], "NominalAtt2")


@query(
    "evaluation",
    """WITH c AS (SELECT StringAtt2 AS value, NominalAtt2 AS class, count(*) AS n FROM filter_row WHERE StringAtt2 IS NOT NULL AND NominalAtt2 IS NOT NULL GROUP BY 1, 2), r AS (SELECT value, arg_min(class, (-n, class)) AS p FROM c GROUP BY 1),
       z AS (SELECT NominalAtt2 AS p FROM filter_row WHERE NominalAtt2 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), d AS (SELECT NominalAtt2 AS a, coalesce(r.p, z.p) AS p FROM filter_row LEFT JOIN r ON StringAtt2 = value, z WHERE NominalAtt2 IS NOT NULL),
       x AS (SELECT a AS k, count(*)::DOUBLE AS na FROM d GROUP BY 1), y AS (SELECT p AS k, count(*) AS np FROM d GROUP BY 1), e AS (SELECT sum(na * np) AS e FROM x JOIN y USING (k)), s AS (SELECT count(*) AS n, avg((a = p)::INT) AS po FROM d)
       SELECT n, round(po, 9) AS accuracy, round((po - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM s, e""",
)
def _(t):
    said = M.one_rule(t.filter_row, t.filter_row, "ord", "StringAtt2", "NominalAtt2")
    e = L.evaluation(t.filter_row.select("ord", "NominalAtt2").join(said, "ord"), "NominalAtt2", "predicted")
    return e.select("n", F.round("accuracy", 9).alias("accuracy"), F.round("kappa", 9).alias("kappa"))


@query("linear_svc")
def _(t):
    from pyspark.ml.classification import LinearSVC

    d = M.vector_column(t.embeddings.withColumn("label", F.pmod("label", F.lit(2)).cast("double")), "embedding")
    return M.fit_predict(LinearSVC(maxIter=5), d).select("vec_id", "prediction")


@query("boosted_trees")
def _(t):
    from pyspark.ml.classification import GBTClassifier

    d = M.vector_column(t.embeddings.withColumn("label", F.pmod("label", F.lit(2)).cast("double")), "embedding")
    return M.fit_predict(GBTClassifier(maxIter=3, maxDepth=3, seed=1), d).select("vec_id", "prediction")
