"""Facets and aggregates."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from .registry import query


@query(
    "journal_facets",
    """SELECT jo_system AS term, count(*) AS frequency FROM journal WHERE jo_function LIKE 'read%' AND jo_type IN ('R', 'S')
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _(t):
    from ..functions import criteria as K

    hits = t.journal.where(K.equals("jo_function", "read*") & K.in_set("jo_type", ["R", "S"]))
    return A.facet_field(hits, "jo_system").orderBy(F.desc("frequency"), "term").limit(20)


@query("row_count", "SELECT count(*) AS \"COUNT_VALUE\" FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count("*").alias("COUNT_VALUE"))


@query("result_size", "SELECT count(*) AS n FROM source_file WHERE path LIKE '%.java'")
def _(t):
    return t.source_file.where(F.col("path").like("%.java")).agg(F.count("*").alias("n"))


@query("element_totals", "SELECT count(*) AS records, sum(len(string_split(jo_request_message, '|')))::BIGINT AS elements FROM journal")
def _(t):
    return t.journal.agg(F.count("*").alias("records"), F.sum(F.when(F.col("jo_request_message").isNotNull(), F.size(F.split("jo_request_message", r"\|")))).alias("elements"))


@query(
    "counter_stats",
    "SELECT sum(CASE WHEN jo_returncode = 'RC_OK' THEN 1 WHEN jo_returncode = 'RC_NOK' THEN -1 ELSE 0 END)::BIGINT AS value FROM journal",
)
def _(t):
    ops = t.journal.select(F.when(F.col("jo_returncode") == "RC_OK", "inc").when(F.col("jo_returncode") == "RC_NOK", "dec").alias("op"), F.lit(1).alias("k"))
    return A.counter(ops, "op", "k")


@query(
    "request_samples",
    """SELECT jo_system, jo_function, jo_returncode, count(*) AS n, max(jo_errorcode) AS worst, round(avg(length(jo_request_message)), 6) AS mean_length
       FROM journal GROUP BY 1, 2, 3""",
)
def _(t):
    return t.journal.groupBy("jo_system", "jo_function", "jo_returncode").agg(
        F.count("*").alias("n"), F.max("jo_errorcode").alias("worst"), F.round(F.avg(F.length("jo_request_message")), 6).alias("mean_length")
    )


@query("facet_field", "SELECT source AS term, count(*) AS frequency FROM documents GROUP BY 1")
def _(t):
    return A.facet_field(t.documents, "source")


@query(
    "facet_query",
    """SELECT unnest(['big', 'small', 'late']) AS "query", unnest([count(*) FILTER (o_totalprice > 100000), count(*) FILTER (o_totalprice < 1000),
       count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01')]) AS n FROM orders""",
)
def _(t):
    return A.facet_queries(
        t.orders,
        {"big": F.col("o_totalprice") > 100000, "small": F.col("o_totalprice") < 1000, "late": F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ'1998-01-01'")},
    )


@query(
    "facet_range",
    """SELECT CASE WHEN l_extendedprice < 10000 THEN 'before' WHEN l_extendedprice >= 60000 THEN 'after'
       ELSE CAST(CAST(floor((l_extendedprice - 10000) / 10000) * 10000 + 10000 AS BIGINT) AS VARCHAR) END AS bucket, count(*) AS n
       FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1""",
)
def _(t):
    return A.facet_range(t.lineitem, "l_extendedprice", 10000, 60000, 10000)


@query("facet_pivot", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return A.facet_pivot(t.lineitem, "l_returnflag", "l_linestatus")


@query(
    "grouped_hits",
    """SELECT user_id, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS rank FROM events) WHERE rank <= 2""",
)
def _(t):
    return A.grouped_top(t.events, "user_id", [F.desc("value"), F.asc("event_id")], 2).select("user_id", "event_id", "value", "rank")


@query(
    "subtag_topk",
    """SELECT jo_system, jo_function, n, total FROM (SELECT *, sum(n) OVER (PARTITION BY jo_system)::BIGINT AS total,
       row_number() OVER (PARTITION BY jo_system ORDER BY n DESC, jo_function) AS rank
       FROM (SELECT jo_system, jo_function, count(*) AS n FROM journal GROUP BY 1, 2)) WHERE n >= 2 AND total >= 10 AND rank <= 3""",
)
def _(t):
    return A.subtags(t.journal, "jo_system", "jo_function", 3, 2, 10).select("jo_system", "jo_function", "n", "total")


@query(
    "client_totals",
    """SELECT client, sum("count")::BIGINT AS n, sum("current")::BIGINT AS now, sum("bytesReceived")::BIGINT AS received, sum("bytesSent")::BIGINT AS sent,
       sum("bytesDiscarded")::BIGINT AS discarded FROM client_stats GROUP BY 1""",
)
def _(t):
    return t.client_stats.groupBy("client").agg(
        F.sum("count").alias("n"), F.sum("current").alias("now"), F.sum("bytesReceived").alias("received"), F.sum("bytesSent").alias("sent"), F.sum("bytesDiscarded").alias("discarded")
    )


@query("grand_totals", "SELECT count(*) AS n, sum(\"bytesSent\")::BIGINT AS sent, max(\"count\") AS most FROM client_stats")
def _(t):
    return t.client_stats.agg(F.count("*").alias("n"), F.sum("bytesSent").alias("sent"), F.max("count").alias("most"))


@query("rate_per_minute", "SELECT date_trunc('minute', load_ts) AS minute, count(*) AS n, round(count(*) / 1.0, 6) AS per_minute FROM journal GROUP BY 1")
def _(t):
    m = F.date_trunc("minute", F.col("load_ts")).cast("timestamp_ntz")
    return t.journal.groupBy(m.alias("minute")).agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(1.0), 6).alias("per_minute"))


@query(
    "run_aggregate",
    """SELECT run, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(change) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run
       FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS change FROM events))
       GROUP BY 1, 2""",
)
def _(t):
    return A.runs(t.events, "event_type", "event_id", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])


@query(
    "top_n_values",
    """SELECT ord, NominalAtt2 FROM filter_row WHERE NominalAtt2 IS NULL OR NominalAtt2 IN (SELECT NominalAtt2 FROM filter_row WHERE NominalAtt2 IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, min(ord) LIMIT 3)""",
)
def _(t):
    return A.frequent_values(t.filter_row, "NominalAtt2", 3, "ord").select("ord", "NominalAtt2")


@query(
    "histogram",
    """SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS cumulative FROM (SELECT least(floor(l_quantity * 10 / 50) + 1, 10)::INT AS bin, count(*) AS n
       FROM lineitem WHERE l_quantity >= 0 AND l_quantity <= 50 GROUP BY 1)""",
)
def _(t):
    return A.histogram(t.lineitem, "l_quantity", 0, 50, 10)


@query("signal_extent", "SELECT event_type, max(value) AS high, min(value) AS low FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.max("value").alias("high"), F.min("value").alias("low"))


@query(
    "coverage_map",
    """SELECT begin, sum(d) OVER (ORDER BY begin)::BIGINT AS depth FROM (SELECT begin, sum(d) AS d FROM (SELECT l_orderkey AS begin, 1 AS d FROM lineitem
       UNION ALL SELECT l_orderkey + CAST(l_quantity AS BIGINT), -1 FROM lineitem) GROUP BY 1)""",
)
def _(t):
    return A.coverage(t.lineitem.select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_quantity").cast("bigint")).alias("b")), "a", "b")


@query(
    "consensus",
    """SELECT jo_system, arg_min(jo_returncode, (-w, jo_returncode)) AS consensus, max(w)::BIGINT AS weight FROM (SELECT jo_system, jo_returncode, sum(jo_id % 7) AS w FROM journal GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    return A.weighted_mode(t.journal.withColumn("q", F.col("jo_id") % 7), ["jo_system"], "jo_returncode", "q")


@query("weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(A.weighted_mean("l_discount", "l_quantity"), 6).alias("mean"))


@query("sentinel_mean", "SELECT round(avg(CASE WHEN jo_errorcode <> -1 THEN jo_errorcode END), 6) AS mean FROM journal")
def _(t):
    return t.journal.agg(F.round(A.mean_until("jo_errorcode", -1), 6).alias("mean"))


@query(
    "property_tree",
    """SELECT prefix, depth, count(*) AS n FROM (SELECT array_to_string(parts[1:i], '.') AS prefix, i::INT AS depth FROM
       (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT string_split(root_package, '.') AS parts FROM repo))) GROUP BY 1, 2""",
)
def _(t):
    return A.property_tree(t.repo, "root_package")


@query(
    "lag_correlation",
    """SELECT l_orderkey, CASE WHEN stddev_samp(l_quantity) FILTER (b IS NOT NULL) > 0 AND stddev_samp(b) > 0 THEN round(corr(l_quantity, b), 6) END AS r, count(b) AS n FROM (SELECT l_orderkey, l_quantity, lag(l_extendedprice, 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem)
       GROUP BY 1 HAVING count(b) >= 8""",
)
def _(t):
    d = A.lag_correlation(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", "l_extendedprice", 1)
    return d.where("n >= 8").withColumn("r", F.round("r", 6))


@query(
    "round_statistics",
    "SELECT user_id, event_type, count(*) AS hits, round(sum(value), 4) AS damage, max(value) AS critical FROM events GROUP BY 1, 2",
)
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("hits"), F.round(F.sum("value"), 4).alias("damage"), F.max("value").alias("critical"))


@query(
    "char_bag",
    "SELECT gram, count(*) AS n FROM (SELECT unnest(string_split(repo_name, '')) AS gram FROM repo) WHERE gram <> '' GROUP BY 1",
)
def _(t):
    g = A.gram_counts(t.repo.select("repo_id", "repo_name"), "repo_id", "repo_name", 1)
    return g.groupBy("gram").agg(F.sum("n").alias("n"))


@query(
    "cross_entropy_nearest",
    """WITH l AS (SELECT item_id, gram, count(*) AS ln FROM (SELECT item_id, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS gram FROM eval_item) GROUP BY 1, 2),
       r AS (SELECT suite, gram, count(*) AS rn FROM (SELECT suite, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS gram FROM eval_item) GROUP BY 1, 2),
       tot AS (SELECT suite, sum(rn) AS total, count(*) AS kinds FROM r GROUP BY 1), sz AS (SELECT item_id, sum(ln) AS size FROM l GROUP BY 1),
       k AS (SELECT item_id, suite, sum(ln * log2(rn + 1)) AS saved FROM l JOIN r USING (gram) GROUP BY 1, 2),
       e AS (SELECT item_id, suite, log2(total + kinds + 1) - saved / size AS entropy FROM k JOIN tot USING (suite) JOIN sz USING (item_id))
       SELECT item_id, arg_min(suite, (round(entropy, 6), suite)) AS nearest, round(min(entropy), 4) AS bits FROM e GROUP BY 1""",
)
def _(t):
    left = A.gram_counts(t.eval_item, "item_id", "text", 2)
    right = A.gram_counts(t.eval_item, "suite", "text", 2)
    e = A.cross_entropy(left, right, "item_id", "suite")
    return e.groupBy("item_id").agg(F.min_by("suite", F.struct(F.round("entropy", 6), "suite")).alias("nearest"), F.round(F.min("entropy"), 4).alias("bits"))


@query("share_of_total", "SELECT l_returnflag, count(*) AS value, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def _(t):
    g = A.share_of_total(t.lineitem, "l_returnflag", F.count("*"))
    return g.withColumn("share", F.round("share", 6))


@query("facet_valid", "SELECT client AS term, count(*) AS frequency FROM client_stats WHERE regexp_full_match(client, '[a-z0-9.]+') GROUP BY 1")
def _(t):
    return A.facet_field(t.client_stats, "client", F.col("client").rlike("^[a-z0-9.]+$"))


@query(
    "significance",
    """WITH b AS (SELECT floor(o_totalprice / 20000) AS b, avg((o_orderstatus = 'F')::INT::DOUBLE) AS p FROM orders GROUP BY 1) SELECT c_custkey, round(coalesce(p, 0), 9) AS significance FROM customer LEFT JOIN b ON b = floor(c_acctbal * 30 / 20000)""",
)
def _(t):
    d = A.significance(t.customer, F.col("c_acctbal") * 30, t.orders, F.col("o_totalprice"), F.col("o_orderstatus") == "F", 20000)
    return d.select("c_custkey", F.round("significance", 9).alias("significance"))


@query("value_history", "SELECT user_id, list(value ORDER BY event_id) FILTER (value IS NOT NULL) AS history FROM events GROUP BY 1")
def _(t):
    return A.history(t.events, "user_id", "event_id", "value")
