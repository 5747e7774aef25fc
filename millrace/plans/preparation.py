"""Column preparation queries on the mining relation and the star schema."""

from pyspark.sql import functions as F

from ..operators import columns as C
from .registry import query

CLEAN = "(CASE WHEN isnan({0}) THEN NULL ELSE {0} END)"
A1 = CLEAN.format("NumericAtt1")
A2 = CLEAN.format("NumericAtt2")


@query("proj_alias", "SELECT o_orderkey AS id, o_totalprice * 2 AS twice, upper(o_orderstatus) AS status FROM orders")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 2).alias("twice"), F.upper("o_orderstatus").alias("status"))


@query("scalar_columns", "SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_linenumber").cast("string").alias("line"))


@query("first_hit", "SELECT file_id, class_name FROM source_file WHERE class_name IS NOT NULL ORDER BY file_id, ingest_ts LIMIT 1")
def _(t):
    return t.source_file.where("class_name IS NOT NULL").orderBy("file_id", "ingest_ts").select("file_id", "class_name").limit(1)


@query("map_by_ordinal", "SELECT n_nationkey AS a, n_regionkey AS b FROM nation")
def _(t):
    cols = t.nation.columns
    return t.nation.select(F.col(cols[0]).alias("a"), F.col(cols[2]).alias("b"))


@query(
    "table_qualifier",
    "SELECT repo_id, CASE WHEN len(p) > 2 THEN p[-3] END AS c, CASE WHEN len(p) > 1 THEN p[-2] END AS s, p[-1] AS t FROM (SELECT repo_id, string_split('main.' || root_package, '.') AS p FROM repo)",
)
def _(t):
    from ..functions.text import table_qualifier

    q = table_qualifier(F.concat(F.lit("main."), "root_package"))
    return t.repo.select("repo_id", q["catalog"].alias("c"), q["schema"].alias("s"), q["table"].alias("t"))


@query("add_column", "SELECT ord, CAST(NULL AS DOUBLE) AS unnamed FROM filter_row")
def _(t):
    return t.filter_row.select("ord").withColumn("unnamed", F.lit(None).cast("double"))


@query(
    "add_expression",
    """SELECT ord, code, power(code, 2) AS squared FROM filter_row LEFT JOIN (SELECT StringAtt1, row_number() OVER (ORDER BY min(ord))::INT AS code FROM filter_row WHERE StringAtt1 IS NOT NULL GROUP BY 1) USING (StringAtt1)""",
)
def _(t):
    d = C.first_seen_code(t.filter_row, "StringAtt1", "ord")
    return d.select("ord", "code", F.pow(F.col("code").cast("double"), F.lit(2.0)).alias("squared"))


@query("add_id", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS id, o_orderkey FROM orders")
def _(t):
    from ..operators.ordinal import with_ordinal

    return with_ordinal(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", name="id").select("id", "o_orderkey")


@query("remove_range", "SELECT c_acctbal, c_mktsegment FROM customer")
def _(t):
    return C.remove_range(t.customer, 1, 3)


@query("remove_by_name", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    return C.remove_by_name(t.supplier, "s_n.*")


@query("remove_by_type", "SELECT n_nationkey, n_regionkey FROM nation")
def _(t):
    return C.remove_by_type(t.nation, "string")


@query("remove_useless", "SELECT ord, NominalAtt1, NumericAtt1, NominalAtt2, NumericAtt2, DateAtt1, StringAtt1, StringAtt2 FROM filter_row")
def _(t):
    return C.drop_useless(t.filter_row)


@query("reorder_columns", "SELECT r_name, r_regionkey FROM region")
def _(t):
    return C.reorder(t.region, [2, 1])


@query("rename_regex", "SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier")
def _(t):
    return C.rename_by_regex(t.supplier, "^s_", "")


@query("numeric_transform", "SELECT c_custkey, abs(c_acctbal) AS c_acctbal FROM customer")
def _(t):
    return C.numeric_transform(t.customer.select("c_custkey", "c_acctbal"), F.abs, ["c_acctbal"])


@query("math_expression", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS v FROM customer")
def _(t):
    d = C.math_expression(t.customer, ["c_acctbal"], lambda a, lo, hi: (a - lo) / (hi - lo))
    return d.select("c_custkey", F.round("c_acctbal", 6).alias("v"))


@query("center", f"SELECT ord, round({A1} - avg({A1}) OVER (), 6) AS a, round({A2} - avg({A2}) OVER (), 6) AS b FROM filter_row")
def _(t):
    d = C.center(t.filter_row, ["NumericAtt1", "NumericAtt2"])
    return d.select("ord", F.round("NumericAtt1", 6).alias("a"), F.round("NumericAtt2", 6).alias("b"))


@query("standardize", f"SELECT ord, round(({A1} - avg({A1}) OVER ()) / stddev_samp({A1}) OVER (), 6) AS a FROM filter_row")
def _(t):
    return C.standardize(t.filter_row, ["NumericAtt1"]).select("ord", F.round("NumericAtt1", 6).alias("a"))


@query("minmax", f"SELECT ord, round(({A2} - min({A2}) OVER ()) / (max({A2}) OVER () - min({A2}) OVER ()), 6) AS b FROM filter_row")
def _(t):
    return C.normalize(t.filter_row, ["NumericAtt2"]).select("ord", F.round("NumericAtt2", 6).alias("b"))


@query(
    "row_l2",
    f"SELECT ord, CASE WHEN n = 0 THEN a ELSE round(a / sqrt(n), 6) END AS a, CASE WHEN n = 0 THEN b ELSE round(b / sqrt(n), 6) END AS b FROM (SELECT ord, {A1} AS a, {A2} AS b, {A1} * {A1} + {A2} * {A2} AS n FROM filter_row)",
)
def _(t):
    d = C.row_normalize(t.filter_row, ["NumericAtt1", "NumericAtt2"]).select("ord", "NumericAtt1", "NumericAtt2")
    return d.select("ord", F.round("NumericAtt1", 6).alias("a"), F.round("NumericAtt2", 6).alias("b"))


@query("impute_mean", f"SELECT ord, round(coalesce({A1}, avg({A1}) OVER ()), 6) AS a FROM filter_row")
def _(t):
    return C.replace_missing(t.filter_row, numeric=["NumericAtt1"]).select("ord", F.round("NumericAtt1", 6).alias("a"))


@query(
    "impute_mode",
    "SELECT ord, coalesce(NominalAtt2, (SELECT NominalAtt2 FROM filter_row WHERE NominalAtt2 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, NominalAtt2 LIMIT 1)) AS m FROM filter_row",
)
def _(t):
    return C.replace_missing(t.filter_row, nominal=["NominalAtt2"]).select("ord", F.col("NominalAtt2").alias("m"))


@query("impute_constant", f"SELECT ord, coalesce({A1}, 0.0) AS a, coalesce(NominalAtt1, '0') AS n FROM filter_row")
def _(t):
    return C.replace_missing_with(t.filter_row, {"NumericAtt1": 0.0, "NominalAtt1": "0"}).select("ord", F.col("NumericAtt1").alias("a"), F.col("NominalAtt1").alias("n"))


@query("numeric_clean", f"SELECT ord, CASE WHEN {A2} < -5 THEN -5.0 WHEN {A2} > 5 THEN 5.0 WHEN abs({A2}) <= 0.1 THEN 0.0 ELSE {A2} END AS v FROM filter_row")
def _(t):
    return t.filter_row.select("ord", C.numeric_clean("NumericAtt2", -5, -5.0, 5, 5.0, 0.0, 0.0, 0.1).alias("v"))


@query("num_to_bin", f"SELECT ord, CASE WHEN {A1} IS NULL THEN NULL WHEN {A1} <> 0 THEN 1 ELSE 0 END::INT AS v FROM filter_row")
def _(t):
    return t.filter_row.select("ord", C.numeric_to_binary("NumericAtt1").alias("v"))


@query("num_to_nominal", "SELECT level, n, row_number() OVER (ORDER BY level)::INT AS code FROM (SELECT p_size AS level, count(*) AS n FROM part GROUP BY 1)")
def _(t):
    return C.domain(t.part, "p_size")


@query("indicator", "SELECT ord, (NominalAtt2 = 'b')::INT AS v FROM filter_row")
def _(t):
    return t.filter_row.select("ord", C.indicator("NominalAtt2", "b").alias("v"))


@query("one_hot", "SELECT ord, (NominalAtt1 = 'r')::INT AS \"NominalAtt1=r\", (NominalAtt1 = 'g')::INT AS \"NominalAtt1=g\", (NominalAtt1 = 'b')::INT AS \"NominalAtt1=b\" FROM filter_row")
def _(t):
    return t.filter_row.withColumns(C.one_hot("NominalAtt1", ["r", "g", "b"])).select("ord", "NominalAtt1=r", "NominalAtt1=g", "NominalAtt1=b")


@query("ordered_binary", "SELECT ord, (NominalAtt1 IN ('r', 'g'))::INT AS \"NominalAtt1=r,g\", (NominalAtt1 = 'g')::INT AS \"NominalAtt1=g\" FROM filter_row")
def _(t):
    return t.filter_row.withColumns(C.ordered_binary("NominalAtt1", ["b", "r", "g"])).select("ord", "NominalAtt1=r,g", "NominalAtt1=g")


@query("merge_levels", "SELECT ord, CASE WHEN NominalAtt1 IN ('r', 'b') THEN 'r_b' ELSE NominalAtt1 END AS v FROM filter_row")
def _(t):
    return t.filter_row.select("ord", C.merge_levels("NominalAtt1", ["r", "b"]).alias("v"))


@query("swap_levels", "SELECT ord, CASE NominalAtt1 WHEN 'r' THEN 'b' WHEN 'b' THEN 'r' ELSE NominalAtt1 END AS v FROM filter_row")
def _(t):
    return t.filter_row.select("ord", C.swap_levels("NominalAtt1", "r", "b").alias("v"))


@query("class_order", "SELECT level, n, row_number() OVER (ORDER BY n, level)::INT AS position FROM (SELECT NominalAtt2 AS level, count(*) AS n FROM filter_row WHERE NominalAtt2 IS NOT NULL GROUP BY 1)")
def _(t):
    return C.class_order(t.filter_row, "NominalAtt2")


@query("obfuscate", "SELECT s_suppkey, v AS \"A1\" FROM supplier LEFT JOIN (SELECT s_name, 'V' || row_number() OVER (ORDER BY s_name) AS v FROM supplier GROUP BY 1) USING (s_name)")
def _(t):
    return C.obfuscate(t.supplier.select("s_suppkey", "s_name"), ["s_name"]).select("s_suppkey", "A1")


@query("change_date_format", "SELECT ord, strftime(DateAtt1, '%Y-%m-%dT%H:%M:%S') AS v FROM filter_row")
def _(t):
    return t.filter_row.select("ord", F.date_format("DateAtt1", "yyyy-MM-dd'T'HH:mm:ss").alias("v"))


@query("equal_width_bins", "SELECT p_partkey, least(floor((p_retailprice - lo) * 10 / (hi - lo)) + 1, 10)::INT AS bin FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def _(t):
    return C.equal_width(t.part, "p_retailprice", 10).select("p_partkey", "bin")


@query(
    "equal_frequency_bins",
    """SELECT c_custkey, (CASE WHEN q1 < c_acctbal THEN 1 ELSE 0 END + CASE WHEN q2 < c_acctbal THEN 1 ELSE 0 END + CASE WHEN q3 < c_acctbal THEN 1 ELSE 0 END + 1)::INT AS bin
       FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer)""",
)
def _(t):
    return C.discretize(t.customer, "c_acctbal", 4).select("c_custkey", "bin")


@query("first_order", f"SELECT ord, round({A2} - {A1}, 6) AS diff1 FROM filter_row")
def _(t):
    return C.first_order(t.filter_row, ["NumericAtt1", "NumericAtt2"]).select("ord", F.round("diff1", 6).alias("diff1"))


@query(
    "iqr_flags",
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce((v > q3 + iqr * 0.5 OR v < q1 - iqr * 0.5) AND NOT (v > q3 + iqr * 0.7 OR v < q1 - iqr * 0.7), false)::INT AS outlier,
       coalesce(v > q3 + iqr * 0.7 OR v < q1 - iqr * 0.7, false)::INT AS extreme FROM (SELECT *, l_extendedprice AS v FROM lineitem),
       (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3, q3 - q1 AS iqr FROM lineitem)""",
)
def _(t):
    return C.iqr_flags(t.lineitem, ["l_extendedprice"], 0.5, 0.7).select("l_orderkey", "l_linenumber", "l_partkey", "outlier", "extreme")


@query("sparse_round_trip", f"SELECT ord, {A1} AS a, {A2} AS b FROM filter_row")
def _(t):
    d = C.to_sparse(t.filter_row, ["NumericAtt1", "NumericAtt2"]).select("ord", "sparse")
    return C.from_sparse(d, "sparse", ["a", "b"]).select("ord", "a", "b")


@query(
    "wavelet",
    "SELECT s_suppkey, round((s_acctbal + s_nationkey) / sqrt(2), 6) AS low, round((s_acctbal - s_nationkey) / sqrt(2), 6) AS high FROM supplier",
)
def _(t):
    h = C.haar(F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double")))
    return t.supplier.select("s_suppkey", F.round(h[0], 6).alias("low"), F.round(h[1], 6).alias("high"))


@query("filter_chain", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (), 6) AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return C.chain(
        t.customer,
        lambda d: d.where("c_mktsegment = 'BUILDING'"),
        lambda d: C.center(d, ["c_acctbal"]),
        lambda d: d.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal")),
    )


@query("int_ratio", "SELECT stat_id, CASE WHEN \"count\" <> 0 THEN CAST(trunc(\"bytesReceived\" / \"count\") AS BIGINT) END AS ratio FROM client_stats")
def _(t):
    from ..functions.scalars import int_ratio

    return t.client_stats.select("stat_id", int_ratio("bytesReceived", "count").alias("ratio"))


@query("rate_scaled", "SELECT stat_id, CASE WHEN \"count\" <> 0 THEN round(CAST(\"bytesSent\" AS DOUBLE) * 60.0 / \"count\", 6) END AS rate FROM client_stats")
def _(t):
    from ..functions.scalars import rate

    return t.client_stats.select("stat_id", F.round(rate("bytesSent", "count", 60), 6).alias("rate"))


@query("attenuated", "SELECT l_orderkey, l_linenumber, round(greatest(0.0, (l_extendedprice - l_quantity * 1000) * 0.5), 6) AS v FROM lineitem")
def _(t):
    from ..functions.scalars import attenuated

    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(attenuated("l_extendedprice", F.col("l_quantity") * 1000, 0.5), 6).alias("v"))


@query("add_noise", "SELECT count(*) AS n, true AS near, true AS within FROM filter_row")
def _(t):
    d = C.add_noise(t.filter_row.withColumn("was", F.col("NominalAtt2")), "NominalAtt2", 50, ["x1", "x2"], 1)
    n, noisy = F.count("*"), F.col("NominalAtt2").isin("x1", "x2")
    kept = noisy | F.col("NominalAtt2").eqNullSafe(F.col("was"))
    return d.agg(n.alias("n"), (F.abs(F.count_if(noisy) - n * 0.5) <= 2 * F.sqrt(n)).alias("near"), F.bool_and(kept).alias("within"))


@query("random_columns", "SELECT count(*) AS n, 4 AS columns, true AS known FROM filter_row")
def _(t):
    d = C.random_subset(t.filter_row, 0.5, 1)
    return d.agg(F.count("*").alias("n"), F.lit(len(set(d.columns))).alias("columns"), F.lit(set(d.columns) <= set(t.filter_row.columns)).alias("known"))


@query("class_assigned", """SELECT column_name AS "column", column_name = 'NominalAtt2' AS is_class FROM information_schema.columns WHERE table_name = 'filter_row'""")
def _(t):
    d = C.with_class(t.filter_row, "NominalAtt2")
    return t.spark.createDataFrame([(f.name, bool(f.metadata.get("class"))) for f in d.schema.fields], "column string, is_class boolean")


@query("mdl_discretize")
def _(t):
    cuts = C.mdl_cuts(t.filter_row, "NumericAtt1", "NominalAtt2")
    bin_ = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda x: x < C.clean("NumericAtt1"))) + 1
    return t.filter_row.select("ord", F.when(C.clean("NumericAtt1").isNull(), None).otherwise(bin_).alias("bin"))


@query("domain_sorted", "SELECT row_number() OVER (ORDER BY lower(level), level)::INT AS code, level FROM (SELECT DISTINCT NominalAtt1 AS level FROM filter_row WHERE NominalAtt1 IS NOT NULL)")
def _(t):
    return C.domain(t.filter_row, "NominalAtt1", ignore_case=True).select("code", "level")


@query("domain_added", "SELECT level FROM (SELECT DISTINCT NominalAtt1 AS level FROM filter_row WHERE NominalAtt1 IS NOT NULL UNION SELECT unnest(['added', 'r']))")
def _(t):
    return C.domain(t.filter_row, "NominalAtt1", added=["added", "r"]).select("level")


@query("string_to_nominal", "WITH s AS (SELECT StringAtt1 AS v, min(ord) AS o FROM filter_row WHERE StringAtt1 IS NOT NULL GROUP BY 1), c AS (SELECT v, row_number() OVER (ORDER BY o, v)::INT AS code FROM s) SELECT ord, code FROM filter_row LEFT JOIN c ON v = StringAtt1")
def _(t):
    return C.first_seen_code(t.filter_row.select("ord", "StringAtt1"), "StringAtt1", "ord").select("ord", "code")
