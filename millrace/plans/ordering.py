"""Order, window, sampling, join and set queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import ordered as O
from ..operators import rows as R
from .registry import query


@query("lag_delta", "SELECT event_id, round(value - lag(value) OVER (ORDER BY ts, event_id), 6) AS delta FROM events QUALIFY row_number() OVER (ORDER BY ts, event_id) > 1")
def _(t):
    d = O.series_delta(t.events.select("event_id", "ts", "value"), "value", ["ts", "event_id"])
    return d.select("event_id", F.round("delta", 6).alias("delta"))


@query(
    "lag_delta_by_key",
    "SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1",
)
def _(t):
    d = O.series_delta(t.events, "value", ["event_id"], by=["user_id"])
    return d.select("user_id", "event_id", F.round("delta", 6).alias("delta"))


@query("lag_shift", "SELECT event_id, lag(event_type) OVER (ORDER BY event_id) AS \"event_type-1\", lag(value) OVER (ORDER BY event_id) AS \"value-1\" FROM events QUALIFY row_number() OVER (ORDER BY event_id) > 1")
def _(t):
    return O.series_translate(t.events, ["event_type", "value"], ["event_id"]).select("event_id", "event_type-1", "value-1")


@query("row_number", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS n FROM events")
def _(t):
    return t.events.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))


@query("running_total", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("user_id", "event_id", F.round(O.running("value", w), 4).alias("total"))


@query("running_count", "SELECT event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS clicks FROM events")
def _(t):
    from ..operators.ordinal import Ordered

    d = Ordered(t.events.select("event_id", "event_type"), "event_id")
    return d.total("clicks", (F.col("event_type") == "click").cast("bigint")).rows().select("event_id", "clicks")


@query("second_diff", "SELECT user_id, event_id, round(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w, 6) AS d2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("user_id", "event_id", F.round(O.second_difference("value", w), 6).alias("d2"))


@query("percent_of_key", "SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def _(t):
    return t.events.select("event_id", F.round(F.col("value") / F.sum("value").over(Window.partitionBy("user_id")), 6).alias("share"))


@query(
    "quality_trim",
    """WITH c AS (SELECT repo_id, i, ascii(substr(repo_name, i::INT, 1)) - 90 - 10 AS q FROM repo, unnest(range(1, length(repo_name) + 1)) AS u(i)), p AS (SELECT repo_id, i, sum(q) OVER (PARTITION BY repo_id ORDER BY i) AS s FROM c),
       b AS (SELECT repo_id, i, s FROM p UNION ALL SELECT repo_id, 0, 0 FROM repo), r AS (SELECT x.repo_id, x.i AS b, y.i - 1 AS e, y.s - x.s AS m FROM b x JOIN p y ON x.repo_id = y.repo_id AND y.i > x.i WHERE y.s > x.s),
       k AS (SELECT repo_id, arg_min({'b': b, 'e': e}, (-m, e, -b)) AS v FROM r GROUP BY 1) SELECT repo_id, coalesce(v.b, 0)::INT AS "begin", coalesce(v.e, -1)::INT AS "end" FROM repo LEFT JOIN k USING (repo_id)""",
)
def _(t):
    q = F.transform(F.split("repo_name", ""), lambda x: F.ascii(x) - 90)
    r = O.quality_trim(q, 10)
    return t.repo.select("repo_id", r["begin"].alias("begin"), r["end"].alias("end"))


@query(
    "exponential_index",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT user_id, event_id, i, value AS v FROM o WHERE i = 1 UNION ALL
       SELECT o.user_id, o.event_id, o.i, CASE WHEN o.value IS NULL THEN s.v WHEN s.v IS NULL THEN o.value ELSE 0.3::DOUBLE * o.value + 0.7::DOUBLE * s.v END FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
       SELECT user_id, event_id, round(v, 6) AS smooth FROM s""",
)
def _(t):
    return O.exponential_index(t.events, "user_id", "event_id", "value", 0.3).select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@query("page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    return R.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, 150)


@query("page_total", "SELECT c_custkey, (SELECT count(*) FROM customer) AS total_size FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def _(t):
    return R.page_with_total(t.customer, [F.desc("c_acctbal"), F.asc("c_custkey")], 0, 20).select("c_custkey", "total_size")


@query("keyset_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 25")
def _(t):
    return R.keyset_page(t.orders.select("o_orderkey"), "o_orderkey", 1000, 25)


@query("sort_ci", "SELECT client, stat_id FROM client_stats ORDER BY lower(client) DESC NULLS LAST, stat_id LIMIT 30")
def _(t):
    return t.client_stats.select("client", "stat_id").orderBy(R.order_column("client", False, False), "stat_id").limit(30)


@query("tree_order", "SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey)::BIGINT AS position FROM nation")
def _(t):
    from ..operators.ordinal import with_ordinal

    return with_ordinal(t.nation, "n_regionkey", "n_nationkey", name="position").select("n_nationkey", "position")


@query("argsort", "SELECT vec_id, list_transform(list_sort(list_transform(range(1, len(embedding) + 1), lambda i: {'v': embedding[i], 'i': (i - 1)::INT})), lambda p: p.i) AS idx FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", R.argsort("embedding").alias("idx"))


@query("distinct_sorted", "SELECT arg_max(client, stat_id) AS client FROM client_stats WHERE client IS NOT NULL GROUP BY lower(client) ORDER BY lower(arg_max(client, stat_id))")
def _(t):
    return R.distinct_sorted(t.client_stats, "client", "stat_id", case_sensitive=False)


@query(
    "time_of_day",
    "SELECT jo_id, TRY_CAST(substr(jo_request_timestamp, 12, 2) AS INT) * 60 + TRY_CAST(substr(jo_request_timestamp, 15, 2) AS INT) AS minutes FROM journal WHERE length(jo_request_timestamp) = 23",
)
def _(t):
    d = t.journal.where(F.length("jo_request_timestamp") == 23).withColumn("clock", F.substring("jo_request_timestamp", 12, 5))
    return d.select("jo_id", R.time_of_day("clock").alias("minutes"))


@query("rank_results", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)::INT AS rank FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))).alias("rank"))


@query("remove_pct", "SELECT ord FROM (SELECT ord, row_number() OVER (ORDER BY ord) AS r, count(*) OVER () AS n FROM filter_row) WHERE r > floor(n * 0.5 + 0.5)")
def _(t):
    return R.remove_percentage(t.filter_row.select("ord"), "ord", 50)


@query("remove_row_range", "SELECT ord FROM (SELECT ord, row_number() OVER (ORDER BY ord) AS r FROM filter_row) WHERE r NOT BETWEEN 10 AND 100")
def _(t):
    return R.remove_rows(t.filter_row.select("ord"), "ord", 10, 100)


@query("slice_merge", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r < 100 OR r BETWEEN 1000 AND 1999 OR r >= 14000")
def _(t):
    return R.slices(t.orders.select("o_orderkey"), "o_orderkey", [(0, 100), (1000, 2000), (14000, None)])


@query("fold", "SELECT ord FROM (SELECT ord, ntile(10) OVER (ORDER BY ord) AS f FROM filter_row) WHERE f = 1")
def _(t):
    return R.fold(t.filter_row.select("ord"), "ord", 10, 1)


@query("stratified_fold", "SELECT NominalAtt2, ceil(count(*) / 10)::BIGINT AS n FROM filter_row GROUP BY 1")
def _(t):
    kept = R.stratified_fold(t.filter_row.select("ord", "NominalAtt2"), "ord", "NominalAtt2", 10, 1)
    return kept.groupBy("NominalAtt2").agg(F.countDistinct("ord").alias("n"))


@query("stratified_folds_are_a_partition", "SELECT ord, 1::BIGINT AS folds FROM filter_row")
def _(t):
    d = t.filter_row.select("ord", "NominalAtt2")
    return R.union_all([R.stratified_fold(d, "ord", "NominalAtt2", 4, k) for k in (1, 2, 3, 4)]).groupBy("ord").agg(F.count("*").alias("folds"))


@query("folds_modulo", "SELECT o_orderkey, (o_orderkey % 10)::BIGINT AS fold FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.pmod("o_orderkey", F.lit(10)).cast("bigint").alias("fold"))


@query("spread_cap", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def _(t):
    return R.class_cap(t.documents.select("doc_id", "source"), "source", ["doc_id"], 20)


# Random operators are held to what must be true of any draw; four standard errors bound the shares.
@query("train_test_split", "SELECT count(*) AS n, count(*) AS kept, true AS near FROM documents")
def _(t):
    s = R.hash_split(t.documents.select("doc_id"), "doc_id", {"train": 0.8, "test": 0.2})
    share = F.avg((F.col("split") == "train").cast("double"))
    return s.agg(F.count("*").alias("n"), F.count("split").alias("kept"), (F.abs(share - 0.8) <= 4 * F.sqrt(F.lit(0.16) / F.count("*"))).alias("near"))


@query("reservoir_sample", "SELECT 100::BIGINT AS n, 100::BIGINT AS known")
def _(t):
    s = R.reservoir(t.orders.select("o_orderkey"), 100, 1)
    return s.join(t.orders.select("o_orderkey", F.lit(1).alias("k")), "o_orderkey", "left").agg(F.countDistinct("o_orderkey").alias("n"), F.count("k").alias("known"))


@query("resample", "SELECT true AS near, true AS repeats")
def _(t):
    s = R.resample(t.orders.select("o_orderkey"), 0.5, 1).groupBy("o_orderkey").agg(F.count("*").alias("c"))
    total = t.orders.select(F.count("*").alias("n")).scalar()
    return s.agg((F.abs(F.sum("c") - total * 0.5) <= 4 * F.sqrt(total * 0.5)).alias("near"), (F.max("c") > 1).alias("repeats"))


@query("resample_to_uniform", "SELECT o_orderstatus, true AS near FROM orders GROUP BY 1")
def _(t):
    s = R.resample_to_uniform(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", 0.5, 1.0, 1).groupBy("o_orderstatus").agg(F.count("*").alias("c"))
    want = t.orders.select((F.count("*") * 0.5 / F.countDistinct("o_orderstatus")).alias("n")).scalar()
    return s.select("o_orderstatus", (F.abs(F.col("c") - want) <= 4 * F.sqrt(want)).alias("near"))


@query("gaussian_column", "SELECT count(*) AS n, true AS near FROM orders")
def _(t):
    g = R.gaussian(t.orders.select("o_orderkey"), 10, 4, 1)
    n = F.count("*")
    return g.agg(n.alias("n"), ((F.abs(F.avg("gauss") - 10) <= 8 / F.sqrt(n)) & (F.abs(F.var_samp("gauss") - 4) <= 16 * F.sqrt(2 / n))).alias("near"))


@query("rank_selection", "SELECT true AS near")
def _(t):
    picked = R.rank_select(t.orders.select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), ["o_orderkey"], 20_000, 1)
    # of n ranks, the one at r is drawn with weight n + 1 - r, so the mean rank is (n + 2) / 3
    n = t.orders.select(F.count("*").alias("n")).scalar().cast("double")
    return picked.agg((F.abs(F.avg("rank") - (n + 2) / 3) <= 4 * n * F.sqrt(F.lit(1 / 18)) / F.sqrt(F.count("*"))).alias("near"))


@query("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier")
def _(t):
    return R.union_all([t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")), t.supplier.select(F.col("s_name").alias("name"))])


@query("union_by_name", "SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'r' FROM region")
def _(t):
    return R.union_all([t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit("r").alias("extra"))])


@query("anti_delete", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    return R.without(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "schema_closure",
    """WITH RECURSIVE e AS (SELECT repo_name AS src, root_package AS dst FROM repo UNION SELECT root_package, split_part(root_package, '.', 1) FROM repo), s AS (SELECT '1_coromond' AS node
       UNION SELECT e.dst FROM e JOIN s ON e.src = s.node) SELECT node FROM s""",
)
def _(t):
    a = t.repo.select(F.col("repo_name").alias("src"), F.col("root_package").alias("dst"))
    b = t.repo.select(F.col("root_package").alias("src"), F.split_part("root_package", F.lit("."), F.lit(1)).alias("dst"))
    return R.reachable(a.unionByName(b).distinct(), "1_coromond")


@query("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return t.nation.join(J.small(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def _(t):
    o = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t.customer.select("c_custkey").join(o, "c_custkey", "left")


@query("pk_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 2, 3, 7)")
def _(t):
    return J.lookup(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", [1, 2, 3, 7])


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left_semi")


@query("inverted_index", "SELECT doc_id FROM documents WHERE list_contains(string_split(lower(text), ' '), 'cursor')")
def _(t):
    return J.inverted_search(t.documents.select("doc_id", "text"), "doc_id", F.split(F.lower("text"), " "), "cursor").select("doc_id")


@query("fk_navigation", "SELECT l_orderkey, l_linenumber, p_brand, s_nationkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def _(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return t.lineitem.join(p, "l_partkey").join(s, "l_suppkey").select("l_orderkey", "l_linenumber", "p_brand", "s_nationkey")


@query(
    "implied_fk",
    """WITH c AS (SELECT table_name AS "table", regexp_replace(column_name, '^[^_]*_', '') AS "column", data_type AS type, ordinal_position = 1 AS is_key FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'customer', 'orders'))
       SELECT c."table", c."column", k."table" AS parent FROM c JOIN c k ON k.is_key AND k."column" = c."column" AND k.type = c.type AND k."table" <> c."table" """,
)
def _(t):
    rows = []
    for name in ("nation", "region", "customer", "orders"):
        for i, f in enumerate(getattr(t, name).schema.fields):
            rows.append((name, f.name.split("_", 1)[1], f.dataType.simpleString(), i == 0))
    return J.implied_foreign_keys(t.spark.createDataFrame(rows, "table string, column string, type string, is_key boolean"))


@query("natural_key", "SELECT l_orderkey || '|' || l_linenumber AS nk, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(J.natural_key("l_orderkey", "l_linenumber").alias("nk")).agg(F.count("*").alias("n"))


@query("key_merge_full", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a FULL JOIN (SELECT r_regionkey + 3 AS k, r_name AS v FROM region) b ON a.k = b.k")
def _(t):
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    b = t.region.select((F.col("r_regionkey") + 3).alias("k"), F.col("r_name").alias("v"))
    return J.merge_keyed(a, b, "k", ["v"])


@query(
    "join_range",
    """SELECT o_orderkey, band FROM orders JOIN (SELECT n_nationkey AS band, n_nationkey * 20000.0 AS lo, n_nationkey * 20000.0 + 15000 AS hi FROM nation) ON o_totalprice BETWEEN lo AND hi""",
)
def _(t):
    bands = t.nation.select(F.col("n_nationkey").alias("band"), (F.col("n_nationkey") * 20000.0).alias("lo"), (F.col("n_nationkey") * 20000.0 + 15000).alias("hi"))
    return J.range_join(t.orders.select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "lo", "hi", 20000).select("o_orderkey", "band")


@query(
    "asof_join",
    """SELECT c.event_id, p.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) p
       ON c.user_id = p.user_id AND c.ts >= p.ts""",
)
def _(t):
    views = t.events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_view"))
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return J.asof_join(clicks, views, "user_id", "ts", ["last_view"], F.date_trunc("day", F.col("ts"))).select("event_id", "last_view")


@query(
    "join_theta",
    """WITH p AS (SELECT s_suppkey AS id, (s_suppkey % 90)::DOUBLE AS lat, s_nationkey::DOUBLE AS lon FROM supplier), d AS (SELECT a.id AS id_a, b.id AS id_b, acos(least(1.0, greatest(-1.0, sin(radians(a.lat)) * sin(radians(b.lat)) +
       cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon - b.lon))))) * 3958.7558657440547 AS miles FROM p a, p b) SELECT id_a, id_b, round(miles, 3) AS miles FROM d WHERE miles <= 200 AND id_a < id_b""",
)
def _(t):
    p = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 90).cast("double").alias("lat"), F.col("s_nationkey").cast("double").alias("lon"))
    return J.near_miles(p, p, 200).where("id_a < id_b").select("id_a", "id_b", F.round("miles", 3).alias("miles"))


@query(
    "first_container",
    """SELECT n_nationkey, arg_min(zone, CASE zone WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 END) FILTER (zone IN ('EUROPE', 'ASIA')) AS found FROM nation LEFT JOIN (SELECT r_regionkey, r_name AS zone FROM region) ON n_regionkey = r_regionkey GROUP BY 1""",
)
def _(t):
    zones = t.nation.join(J.small(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("zone"))
    return J.first_container(t.nation.select("n_nationkey"), zones, "n_nationkey", "zone", ["EUROPE", "ASIA"]).select("n_nationkey", "found")


@query(
    "bidirectional_map",
    "SELECT c_custkey::VARCHAR AS \"from\", arg_max(c_mktsegment, c_custkey) AS \"to\", 'key' AS direction FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, arg_max(c_custkey::VARCHAR, c_custkey), 'value' FROM customer GROUP BY 1",
)
def _(t):
    return J.bidirectional(t.customer, "c_custkey", "c_mktsegment", "c_custkey")


@query(
    "mate_pairs",
    "SELECT l_orderkey, max(l_partkey) - min(l_partkey) AS distance FROM lineitem GROUP BY 1 HAVING count(*) = 2 AND count(DISTINCT l_returnflag) = 2 AND max(l_partkey) - min(l_partkey) BETWEEN 10 AND 100",
)
def _(t):
    return J.partners(t.lineitem, "l_orderkey", "l_partkey", "l_returnflag", 10, 100)


@query("key_mapping", "SELECT o_orderkey, c_custkey + 1000000 AS target FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    mapping = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") + 1_000_000).alias("target"))
    return t.orders.select("o_orderkey", "o_custkey").join(mapping, "o_custkey").select("o_orderkey", "target")


@query("randomized_order", "SELECT count(*) AS n, count(DISTINCT ord) AS kinds, true AS mixed FROM filter_row")
def _(t):
    from ..operators.ordinal import with_ordinal

    d = with_ordinal(t.filter_row.select("ord").withColumn("u", F.rand(3)), "u", "ord", name="at")
    return d.agg(F.count("*").alias("n"), F.countDistinct("ord").alias("kinds"), (F.abs(F.corr("at", "ord")) < 0.5).alias("mixed"))


@query(
    "spline_index",
    """WITH k AS (SELECT n_nationkey AS x, (n_nationkey * n_nationkey % 7)::DOUBLE AS y FROM nation) SELECT x, round(y, 6) AS spline FROM k""",
)
def _(t):
    # at its knots a spline is the series itself; tests/test_operators.py compares what lies between with a linear solve
    d = t.nation.select(F.lit("a").alias("k"), F.col("n_nationkey").alias("x"), (F.col("n_nationkey") * F.col("n_nationkey") % 7).cast("double").alias("y"))
    return O.cubic_spline(d, "k", "x", "y").select("x", F.round("spline", 6).alias("spline"))
