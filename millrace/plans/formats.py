"""Source, sink, streaming and extension queries."""

import os

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, one_process
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import pipelines as P
from .registry import query
from .registry_sql import Formatters, NamedSql, condition, crossover, mapped


def _folder(t, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{os.urandom(6).hex()}"


@query("io_json", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    path = _folder(t, "json")
    W.write_json(t.nation, path)
    return t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@query("io_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    path = _folder(t, "csv")
    W.export(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path, "csv")
    return R.delimited(t.spark, path, schema="s_suppkey bigint, s_name string, s_acctbal double")


@query("io_xml", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _(t):
    path = _folder(t, "xml")
    W.export(t.region, path, "xml")
    return R.xml_records(t.spark, path, "row", "r_regionkey bigint, r_name string")


@query("io_insert_script", "SELECT 'INSERT INTO nation (n_nationkey, n_name) VALUES (' || n_nationkey || ', ''' || n_name || ''');' AS statement FROM nation")
def _(t):
    return W.insert_statements(t.nation.select("n_nationkey", "n_name"), "nation")


@query("io_create_table", "SELECT 'CREATE TABLE region (r_regionkey INT, r_name STRING)' AS ddl")
def _(t):
    return t.spark.createDataFrame([(W.create_table(t.region, "region"),)], "ddl string")


@query("io_fasta", "SELECT '>' || n_nationkey || chr(10) || n_name AS value FROM nation")
def _(t):
    return W.fasta(t.nation, "n_nationkey", "n_name")


@query("io_update", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    updates = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return W.merge_update(t.customer.select("c_custkey", "c_acctbal"), updates, "c_custkey", ["c_acctbal"])[0]


@query("io_delimited_map", "SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def _(t):
    lines = t.nation.select(F.concat_ws(";", "n_nationkey", "n_name").alias("value"))
    m = R.delimited_map(lines, ["id", "name", "missing"], ";")
    return m.select(F.col("record")["id"].alias("id"), F.col("record")["name"].alias("name"))


@query("io_ini", "SELECT lower(split_part(path, '/', 1)) AS section, count(*) AS n FROM (SELECT DISTINCT file_id, path FROM source_file WHERE path LIKE '%.properties' AND content IS NOT NULL) GROUP BY 1")
def _(t):
    files = t.source_file.where("path LIKE '%.properties' AND content IS NOT NULL").select("file_id", "path").distinct()
    path = _folder(t, "ini")
    files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("s")).agg(F.collect_list("file_id").alias("ids")).select(
        F.concat(F.lit("["), "s", F.lit("]\n"), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("k"), x.cast("string"), F.lit("=1"))), "\n")).alias("value")
    ).write.text(path)
    return R.ini(t.spark, path).groupBy("section").agg(F.count("*").alias("n"))


@query("io_fixed_records", "SELECT c_custkey, substr(c_name, 1, 30) AS c_name FROM customer")
def _(t):
    path = _folder(t, "fixed")
    # a record of 144 bytes: key (20), bytes of the name (3, -1 for none), 30 characters of UTF-8 (120), the line break
    name = F.substring("c_name", 1, 30)
    size = F.octet_length(name)
    key = F.lpad(F.coalesce(F.col("c_custkey").cast("string"), F.lit("")), 20, " ")
    used = F.coalesce(size, F.lit(0))
    value = F.concat(key, F.lpad(F.coalesce(size, F.lit(-1)).cast("string"), 3, " "), F.coalesce(name, F.lit("")), F.repeat(F.lit(" "), 120 - used))
    t.customer.select(value.alias("value")).write.text(path)
    field = lambda at, n: F.decode(F.substr("record", F.lit(at), n), "UTF-8")
    size = F.trim(field(21, F.lit(3))).cast("int")
    return R.fixed_records(t.spark, f"{path}/*.txt", 144).select(F.trim(field(1, F.lit(20))).try_cast("bigint").alias("c_custkey"), F.when(size >= 0, field(24, size)).alias("c_name"))


@query("io_shards", "SELECT o_orderkey, 's' || (o_custkey % 3) AS shard FROM orders")
def _(t):
    path = _folder(t, "shards")
    t.orders.withColumn("s", F.concat(F.lit("s"), F.pmod("o_custkey", F.lit(3)).cast("string"))).write.partitionBy("s").parquet(path)
    return R.shards(t.spark, {f"s{i}": f"{path}/s=s{i}" for i in range(3)}).select("o_orderkey", "shard")


@query("empty_relation", "SELECT 1 AS x WHERE false")
def _(t):
    return R.empty(t.spark).select(F.lit(1).alias("x"))


@query("row_arrays", "SELECT [r_regionkey::VARCHAR, r_name] AS \"row\" FROM region")
def _(t):
    return R.to_array(t.region)


_CATALOG = ("region", "nation", "orders", "journal", "source_file")


@query("catalog_columns", "SELECT table_name AS \"table\", column_name AS \"column\" FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'orders', 'journal', 'source_file')")
def _(t):
    for name in _CATALOG:
        getattr(t, name).createOrReplaceTempView(name)
    return R.catalog(t.spark).where(F.col("table").isin(*_CATALOG)).select("table", "column")


@query("named_sql", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(t):
    sql = NamedSql({"by_status": "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_totalprice > :least GROUP BY 1"})
    return sql.run(t.spark, "by_status", {"least": 1000}, orders=t.orders)


@query("formatters", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey, floor(s_acctbal)::BIGINT::VARCHAR AS s_acctbal FROM supplier")
def _(t):
    from pyspark.sql import types as T

    return Formatters().set(T.DoubleType, lambda c: F.floor(c).cast("string")).apply(t.supplier)


@query("condition_text", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand LIKE 'Brand#1%'")
def _(t):
    return condition(t.part, "p_size BETWEEN 10 AND 20 AND p_brand LIKE 'Brand#1%'").select("p_partkey")


@query("row_mapper", "SELECT r_regionkey::BIGINT AS id, lower(r_name) AS name FROM region")
def _(t):
    return mapped(t.region, lambda r: {"id": int(r["r_regionkey"]), "name": r["r_name"].lower()}, "id bigint, name string")


@query("crossover", "SELECT n_nationkey, [n_nationkey, n_regionkey + 100] AS child FROM nation")
def _(t):
    d = t.nation.select("n_nationkey", F.array("n_nationkey", "n_nationkey").alias("m"), F.array(F.col("n_regionkey") + 100, F.col("n_regionkey") + 100).alias("d"), F.array(F.lit(True), F.lit(False)).alias("k"))
    return d.select("n_nationkey", crossover("m", "d", "k").alias("child"))


@query("stream_window_count", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    s = P.event_time(P.event_source(t.spark, t.folder, "events"), "ts", "1 hour")
    out = P.run_to_table(P.window_counts(s, "ts", "1 hour", "event_type"), f"w{os.urandom(4).hex()}", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "stream_sessions",
    """SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
       FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '1 hour', true) AS gap FROM events)) GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    s = P.event_time(P.event_source(t.spark, t.folder, "events"), "ts", "2 hours")
    out = P.run_to_table(P.sessions(s, "ts", "1 hour", "user_id"), f"s{os.urandom(4).hex()}", "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("stream_dedup", "SELECT count(DISTINCT jo_id) AS n FROM journal")
def _(t):
    s = P.event_time(P.event_source(t.spark, t.folder, "journal").select("jo_id", "load_ts"), "load_ts", "30 days")
    return P.run_to_table(P.deduplicated(s, ["jo_id"]), f"d{os.urandom(4).hex()}").agg(F.count("*").alias("n"))


@query("stream_filter", "SELECT count(*) AS n FROM journal WHERE contains(jo_request_message, 'snapshot')")
def _(t):
    s = P.transform_all(P.event_source(t.spark, t.folder, "journal"), lambda d: P.filtered_tail(d, "snapshot", column="jo_request_message"), lambda d: d.select("jo_id"))
    return P.run_to_table(s, f"f{os.urandom(4).hex()}").agg(F.count("*").alias("n"))


@query("stream_journal", "SELECT jo_type, count(*) AS n FROM journal GROUP BY 1")
def _(t):
    root = _folder(t, "journal")
    P.journaled(P.event_source(t.spark, t.folder, "journal").select("jo_id", "jo_type"), f"{root}/out", f"{root}/ckpt", lambda d, _: d)
    return t.spark.read.parquet(f"{root}/out").groupBy("jo_type").agg(F.count("*").alias("n"))


@query(
    "context_stack",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type WHEN 'click' THEN 'push' WHEN 'error' THEN 'clear' ELSE 'pop' END AS op FROM events),
       s AS (SELECT user_id, event_id, i, CASE WHEN op = 'push' THEN [event_id::VARCHAR] ELSE []::VARCHAR[] END AS st FROM o WHERE i = 1 UNION ALL
         SELECT o.user_id, o.event_id, o.i, CASE o.op WHEN 'push' THEN list_slice(list_append(s.st, o.event_id::VARCHAR), 1, 5) WHEN 'clear' THEN []::VARCHAR[] ELSE list_slice(s.st, 1, greatest(len(s.st) - 1, 0)) END FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
       SELECT user_id, event_id, len(st)::INT AS depth, st[len(st)] AS top FROM s""",
)
def _(t):
    ops = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "click", "push").when(F.col("event_type") == "error", "clear").otherwise("pop").alias("op"), F.col("event_id").cast("string").alias("item"))
    return P.context_stacks(ops, "user_id", "event_id", "op", "item", 5)


@query("message_batches", "SELECT (r // 500)::BIGINT AS batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) GROUP BY 1")
def _(t):
    return P.batches_of(t.events, "event_id", 500)


@query("burst_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, list_sort(list(DISTINCT event_type)) AS items FROM events GROUP BY 1")
def _(t):
    return P.burst(t.events, "ts", "6 hours", F.col("event_type")).select(F.col("start").cast("timestamp_ntz").alias("start"), "items")


@query("wire_codec", "SELECT event_id, user_id, event_type, value FROM events")
def _(t):
    from ..sources import wire

    d = t.events.select("event_id", "user_id", "event_type", "value")
    return wire.decode(wire.encode(d, compressed=True), "event", d.schema, compressed=True)


@query(
    "stream_join",
    "SELECT a.event_id AS view_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL '30 minutes' WHERE a.event_type = 'view' AND b.event_type = 'click'",
)
def _(t):
    side = lambda kind: P.event_time(P.event_source(t.spark, t.folder, "events").where(F.col("event_type") == kind).select("event_id", "user_id", "ts"), "ts", "1 hour")
    pairs = P.matched(side("view"), side("click"), "user_id", "ts", "ts", "30 minutes")
    return P.run_to_table(pairs.select(F.col("l.event_id").alias("view_id"), F.col("r.event_id").alias("click_id")), "pairs")


@query("stream_stats", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, round(avg(value), 6) AS mean, max(value) AS high FROM events GROUP BY 1")
def _(t):
    s = P.event_time(P.event_source(t.spark, t.folder, "events"), "ts", "1 hour")
    out = P.run_to_table(P.window_stats(s, "ts", "1 day", "value"), f"g{os.urandom(4).hex()}", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("mean", 6).alias("mean"), "high")


@query("io_arff", "SELECT ord, StringAtt1, NominalAtt1, CASE WHEN isnan(NumericAtt1) THEN NULL ELSE NumericAtt1 END AS NumericAtt1, date_trunc('second', DateAtt1) AS DateAtt1 FROM filter_row")
def _(t):
    path = _folder(t, "arff")
    W.write_arff(t.filter_row.select("ord", "StringAtt1", "NominalAtt1", "NumericAtt1", "DateAtt1"), path, "filter_row", "ord", nominal=["NominalAtt1"])
    d = R.arff(t.spark, path).drop("ord")
    return d.select(F.col("pos").cast("bigint").alias("ord"), "StringAtt1", "NominalAtt1", "NumericAtt1", F.col("DateAtt1").cast("timestamp_ntz").alias("DateAtt1"))


@query("io_jdbc", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def _(t):
    customers = t.customer.select("c_custkey", "c_name", "c_acctbal")
    if one_process(t.spark):
        url = f"jdbc:derby:memory:m{os.urandom(6).hex()};create=true"
        W.write_jdbc(customers, url, "customer")
    else:  # no other JVM sees a database in the driver's memory
        url = W.derby_archive(customers, _folder(t, "jdbc"), "customer")
    d = R.jdbc(t.spark, url, 'SELECT "c_custkey", "c_name", "c_acctbal" FROM customer WHERE "c_acctbal" > 0', partition=('"c_custkey"', 1, 1500, 4))
    return d.select("c_custkey", "c_name", "c_acctbal")


@query("io_fastq", "SELECT n_nationkey::VARCHAR AS id, n_name AS comment, translate(n_name, ' ', 'N') AS bases, list_transform(string_split(n_name, ''), lambda c: ascii(c) - 33) AS qualities FROM nation")
def _(t):
    path = _folder(t, "fastq")
    n = F.translate("n_name", " ", "N")
    record = F.concat(F.lit("@"), F.col("n_nationkey").cast("string"), F.lit(" "), "n_name", F.lit("\n"), n, F.lit("\n+\n"), F.translate("n_name", " ", "A"))
    t.nation.select(record.alias("value")).coalesce(2).write.text(path)
    d = R.fastq(t.spark, path)
    blank = F.zip_with(F.col("qualities"), F.split("comment", ""), lambda q, c: F.when(c == " ", F.lit(-1)).otherwise(q))
    return d.select("id", "comment", "bases", blank.alias("qualities"))


@query("io_hl7", "SELECT n_nationkey::VARCHAR AS key, rep, value FROM (SELECT n_nationkey, 0 AS rep, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 1, n_regionkey::VARCHAR FROM nation)")
def _(t):
    path = _folder(t, "hl7")
    lines = F.concat(F.lit("PID|"), F.col("n_nationkey").cast("string"), F.lit("|"), "n_name", F.lit("~"), F.col("n_regionkey").cast("string"), F.lit("^x"))
    t.nation.select(lines.alias("value")).write.text(path)
    d = R.hl7(t.spark, path).where("segment = 'PID' AND component = 0")
    keys = d.where("field = 1").select("file", "n", F.col("value").alias("key"))
    return d.where("field = 2").join(keys, ["file", "n"]).select("key", "rep", "value")


@query("io_aleph", "SELECT lpad(n_nationkey::VARCHAR, 9, '0') AS id, '245' AS tag, n_name AS title, n_regionkey = 0 AS deleted FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT lpad(n_nationkey::VARCHAR, 9, '0'), 'DEL', n_name, true FROM nation WHERE n_regionkey = 0")
def _(t):
    path = _folder(t, "aleph")
    tag = F.when(F.col("n_regionkey") == 0, F.lit("DEL")).otherwise(F.lit("245"))
    t.nation.select(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 9, "0"), F.lit(" "), tag, F.lit("00 L $$a"), "n_name", F.lit("$$b-")).alias("value")).write.text(path)
    return R.aleph(t.spark, path).select("id", "tag", F.col("subfields")[0]["text"].alias("title"), "deleted")


@query("io_splits", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 's' || (n_regionkey % 2) AS split FROM nation")
def _(t):
    path = _folder(t, "splits")
    for i in range(2):  # each split is a file that holds one array
        part = t.nation.where(F.pmod("n_regionkey", F.lit(2)) == i)
        part.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(f"{path}/s{i}")
    return R.json_splits(t.spark, [f"{path}/s0", f"{path}/s1"], "n_nationkey bigint, n_name string", level=-2)


@query("io_file_filter", "SELECT r_regionkey::BIGINT AS r_regionkey FROM region")
def _(t):
    path = _folder(t, "filter")
    t.region.select("r_regionkey").write.json(path)
    return R.file_filter(t.spark, "json", path, ["part-0*.json", "none*"], "r_regionkey bigint")


@query("io_cursor", "SELECT r_regionkey, r_name FROM region")
def _(t):
    d = t.region.select("r_regionkey", "r_name")
    return t.spark.createDataFrame([tuple(r) for r in R.cursor(d)], d.schema)


@query("io_labels", "SELECT 'a' AS x, 'b' AS y UNION ALL SELECT 'c', NULL")
def _(t):
    return R.with_labels(t.spark, ["x", "y"], [["a", "b"], ["c", None]])


@query("io_each_row", "SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation")
def _(t):
    n, total = t.spark.sparkContext.accumulator(0), t.spark.sparkContext.accumulator(0)

    def send(row: dict) -> None:
        n.add(1)
        total.add(row["n_nationkey"])

    W.each_row(t.nation.select("n_nationkey"), send)
    return t.spark.createDataFrame([(n.value, total.value)], "n bigint, total bigint")


@query("python_function", "SELECT p_partkey, upper(p_brand) || '/' || p_size AS label FROM part")
def _(t):
    import pandas as pd

    def label(brand: pd.Series, size: pd.Series) -> pd.Series:
        return brand.str.upper() + "/" + size.astype(str)

    t.spark.udf.register("millrace_label", F.pandas_udf(label, "string"))
    return t.spark.sql("SELECT p_partkey, millrace_label(p_brand, p_size) AS label FROM {part}", part=t.part)


@query("stream_fan_out", "SELECT 'click' AS view, count(*) FILTER (event_type = 'click') AS n FROM events UNION ALL SELECT 'all', count(*) FROM events")
def _(t):
    root = _folder(t, "fan")
    sink = lambda name, cond: lambda b: b.where(cond).write.mode("append").parquet(f"{root}/{name}")
    P.fan_out(P.event_source(t.spark, t.folder, "events").select("event_id", "event_type"), [sink("click", "event_type = 'click'"), sink("all", "true")], f"{root}/ckpt")
    count = lambda name: t.spark.read.schema("event_id bigint, event_type string").parquet(f"{root}/{name}").agg(F.lit(name).alias("view"), F.count("*").alias("n"))
    return count("click").unionByName(count("all"))
