"""Text and scalar function queries."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from .registry import query


@query("text_whitespace", r"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS v FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.encode(X.normalize_whitespace("text"), "UTF-8")).alias("v"))


@query("text_strip", "SELECT doc_id, md5(regexp_replace(text, '<[^>]*>', '', 'g')) AS v FROM documents WHERE doc_kind = 'javadoc'")
def _(t):
    return t.documents.where("doc_kind = 'javadoc'").select("doc_id", F.md5(F.encode(X.strip_tags("text"), "UTF-8")).alias("v"))


@query("text_lower", "SELECT repo_id, lower(repo_name) AS v FROM repo")
def _(t):
    return t.repo.select("repo_id", F.lower("repo_name").alias("v"))


@query("text_reverse", "SELECT repo_id, reverse(repo_name) AS v FROM repo")
def _(t):
    return t.repo.select("repo_id", F.reverse("repo_name").alias("v"))


@query("text_symbols", r"SELECT stat_id, regexp_replace(client, '[.,:;!?\-\[\]()\s]', '', 'g') AS v FROM client_stats")
def _(t):
    return t.client_stats.select("stat_id", X.strip_symbols("client").alias("v"))


@query("text_md5", "SELECT doc_id, md5(text) AS v FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("v"))


@query("text_hashes", "SELECT doc_id, sha1(text) AS s1, sha256(text) AS s256, md5(text) AS m, sha256(hex(text)) AS h, sha1(base64(encode(text))) AS b FROM documents")
def _(t):
    u = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", X.digest("text", "SHA-1").alias("s1"), X.digest("text", "SHA-256").alias("s256"), X.digest("text", "MD5").alias("m"), X.digest(F.hex(u), "SHA-256").alias("h"), X.digest(F.regexp_replace(F.base64(u), r"\s", ""), "SHA-1").alias("b"))


@query("hashes_from_encodings", "SELECT doc_id, md5(text) AS from_hex, sha256(text) AS from_base64 FROM documents WHERE text IS NOT NULL")
def _(t):
    d = t.documents.where("text IS NOT NULL").select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("h"), F.base64(F.encode("text", "UTF-8")).alias("b"))
    return d.select("doc_id", X.digest("h", "MD5", "hex").alias("from_hex"), X.digest("b", "SHA-256", "base64").alias("from_base64"))


@query("url_escape", "SELECT jo_id, replace(url_encode(jo_request_message), '%20', '+') AS v FROM journal WHERE regexp_full_match(jo_request_message, '[A-Za-z0-9 |<>/=\"]*')")
def _(t):
    d = t.journal.where(F.col("jo_request_message").rlike('^[A-Za-z0-9 |<>/="]*$'))
    return d.select("jo_id", F.url_encode("jo_request_message").alias("v"))


@query("html_escape", "SELECT jo_id, replace(replace(replace(replace(jo_request_message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS v FROM journal")
def _(t):
    return t.journal.select("jo_id", X.html_escape("jo_request_message").alias("v"))


@query("disable_tags", "SELECT jo_id, replace(replace(jo_response_message, '<', '&lt;'), '>', '&gt;') AS v FROM journal")
def _(t):
    return t.journal.select("jo_id", X.disable_tags("jo_response_message").alias("v"))


@query("text_tokens", r"SELECT item_id, len(list_filter(string_split_regex(text, '[^0-9A-Za-z_]+'), lambda x: length(x) > 0))::INT AS n FROM eval_item")
def _(t):
    return t.eval_item.select("item_id", F.size(X.tokenize("text")).alias("n"))


@query("alphabetic_tokens", "SELECT item_id, regexp_extract_all(text, '([A-Za-z]+)', 1) AS v FROM eval_item")
def _(t):
    return t.eval_item.select("item_id", X.alphabetic_tokens("text").alias("v"))


@query("cjk_bigrams", "SELECT repo_id, list_transform(range(1, length(repo_name)), lambda i: substr(repo_name, i, 2)) AS v FROM repo")
def _(t):
    return t.repo.select("repo_id", X.cjk_bigrams("repo_name").alias("v"))


@query("extract_ints", r"SELECT item_id, list_transform(regexp_extract_all(text, '(-?\d+)', 1), lambda x: TRY_CAST(x AS INT)) AS v FROM eval_item")
def _(t):
    return t.eval_item.select("item_id", X.extract_ints("text").alias("v"))


@query(
    "isbn_norm",
    """SELECT p_partkey, core || ((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(core, i, 1) AS INT) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END))) % 10) % 10)::BIGINT AS v
       FROM (SELECT p_partkey, '978' || lpad(p_partkey::VARCHAR, 9, '3') AS core FROM part)""",
)
def _(t):
    return t.part.select("p_partkey", X.isbn13(F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "3"), F.lit("X"))).alias("v"))


@query("field_parts", "SELECT jo_id, nullif(split_part(jo_request_message, '|', 1), '') AS name, nullif(split_part(jo_request_message, '|', 2), '') AS type FROM journal")
def _(t):
    p = X.field_parts("jo_request_message")
    return t.journal.select("jo_id", p["name"].alias("name"), p["type"].alias("type"))


@query("fixed_bytes", "SELECT s_suppkey, substr(rpad(s_name, 8, ' '), 1, 8) AS v FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", F.decode(X.fixed_bytes("s_name", 8), "ISO-8859-1").alias("v"))


@query("clean_base_name", r"SELECT file_id, path, regexp_replace(list_last(string_split(path, '/')), '[^\w. ]', '', 'g') AS v FROM source_file")
def _(t):
    return t.source_file.select("file_id", "path", X.clean_base_name("path").alias("v"))


@query("compare_sign", "SELECT p_partkey, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 WHEN p_name = p_type THEN 0 END::INT AS v FROM part")
def _(t):
    return t.part.select("p_partkey", X.compare_sign("p_name", "p_type").alias("v"))


@query("delimited_array", "SELECT repo_id, string_split(root_package, '.') AS parts, array_to_string(string_split(root_package, '.'), '/') AS joined FROM repo")
def _(t):
    return t.repo.select("repo_id", F.split("root_package", r"\.").alias("parts"), F.array_join(F.split("root_package", r"\."), "/").alias("joined"))


@query("regex_delete", r"SELECT file_id, ingest_ts, md5(regexp_replace(content, '//[^\n]*', '', 'g')) AS v FROM source_file WHERE path LIKE '%.js'")
def _(t):
    return t.source_file.where("path LIKE '%.js'").select("file_id", "ingest_ts", F.md5(F.encode(F.regexp_replace("content", r"//[^\n]*", ""), "UTF-8")).alias("v"))


@query("charset_round_trip", "SELECT doc_id, text FROM documents WHERE lang = 'ru'")
def _(t):
    return t.documents.where("lang = 'ru'").select("doc_id", F.decode(F.encode("text", "UTF-16"), "UTF-16").alias("text"))


@query(
    "ascii_fold",
    "SELECT doc_id, md5(regexp_replace(translate(text, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿąćęłńśźżÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝĄĆĘŁŃŚŹŻ', 'aaaaaaceeeeiiiinooooouuuuyyacelnszzAAAAAACEEEEIIIINOOOOOUUUUYACELNSZZ'), '[^\\x00-\\x7F]', '?', 'g')) AS v FROM documents",
)
def _(t):
    return t.documents.select("doc_id", F.md5(F.encode(X.ascii_fold("text"), "UTF-8")).alias("v"))


@query(
    "html_text",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS v FROM documents WHERE doc_kind = 'javadoc'""",
)
def _(t):
    return t.documents.where("doc_kind = 'javadoc'").select("doc_id", X.html_text("text").alias("v"))


@query("arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, round(CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END, 6) AS q, -l_tax AS neg FROM lineitem")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6).alias("charge"),
        F.round(F.try_divide(F.col("l_quantity"), F.col("l_linenumber") - 1), 6).alias("q"),
        (-F.col("l_tax")).alias("neg"),
    )


@query(
    "great_circle",
    """SELECT s_suppkey, round(acos(least(1.0, greatest(-1.0, sin(radians(s_suppkey % 90)) * sin(radians(10)) + cos(radians(s_suppkey % 90)) * cos(radians(10)) * cos(radians(s_nationkey - 20))))) * 3958.7558657440547, 3) AS miles FROM supplier""",
)
def _(t):
    return t.supplier.select("s_suppkey", F.round(S.great_circle_miles(F.col("s_suppkey") % 90, F.col("s_nationkey"), F.lit(10), F.lit(20)), 3).alias("miles"))


@query("percent", "SELECT stat_id, CASE WHEN \"count\" <> 0 THEN round(\"current\" * 100.0::DOUBLE / \"count\", 6) END AS p, \"bytesSent\" / 1000000.0::DOUBLE AS ms FROM client_stats")
def _(t):
    return t.client_stats.select("stat_id", F.round(S.percent("current", "count"), 6).alias("p"), (F.col("bytesSent") / F.lit(1e6)).alias("ms"))


@query("number_format", "SELECT p_partkey, format('{:,}', CAST(round_even(p_retailprice, 0) AS BIGINT)) AS v FROM part")
def _(t):
    return t.part.select("p_partkey", F.format_number("p_retailprice", 0).alias("v"))


@query("power_of_two", "SELECT p_partkey, (p_partkey & (p_partkey - 1)) = 0 AS v FROM part")
def _(t):
    return t.part.select("p_partkey", S.power_of_two("p_partkey").alias("v"))


@query("quality_convert", "SELECT p_partkey, CAST(round(10 * log10(power(10.0::DOUBLE, (p_size - 5) / 10.0::DOUBLE) + 1)) AS INT) AS v FROM part")
def _(t):
    return t.part.select("p_partkey", S.solexa_to_phred(F.col("p_size") - 5).alias("v"))


@query("unit_conversion", "SELECT p_partkey, round(p_size / 2.54, 6) AS inch, round(p_size * 2.54, 6) AS cm FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(S.inches("p_size"), 6).alias("inch"), F.round(S.centimeters("p_size"), 6).alias("cm"))


@query("date_fmt", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS v FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("v"))


@query("http_date", "SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS v FROM events")
def _(t):
    return t.events.select("event_id", S.http_date("ts").alias("v"))


@query(
    "parse_dates",
    r"SELECT jo_id, strftime(try_strptime(jo_request_timestamp, '%Y-%m-%d %H:%M:%S.%g'), '%Y-%m-%d %H:%M:%S') AS v FROM journal WHERE regexp_full_match(jo_request_timestamp, '\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}')",
)
def _(t):
    d = t.journal.where(F.col("jo_request_timestamp").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}$"))
    return d.select("jo_id", F.date_format(S.parse_any("jo_request_timestamp", ["yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd"]), "yyyy-MM-dd HH:mm:ss").alias("v"))


@query("epoch_millis", "SELECT event_id, epoch_us(ts) // 1000 AS v FROM events")
def _(t):
    return t.events.select("event_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("v"))


@query("array_contains", "SELECT repo_id, list_contains(string_split(root_package, '.'), 'org') AS v FROM repo")
def _(t):
    return t.repo.select("repo_id", F.array_contains(F.split("root_package", r"\."), "org").alias("v"))


@query("map_default", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, 'none' AS z FROM events")
def _(t):
    m = F.from_json("props", "map<string,string>")
    d = t.events.select("event_id", m.alias("m"))
    return d.select("event_id", S.map_default("m", "k", "-1").cast("bigint").alias("k"), S.map_default("m", "z", "none").alias("z"))


@query("map_encode", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":\"' || n_regionkey || '\"}' AS v FROM nation")
def _(t):
    return t.nation.select("n_nationkey", F.to_json(F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string"))).alias("v"))


@query("multi_map", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))


@query("json_get", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("xml_parse", r"SELECT jo_id, regexp_extract(jo_request_message, '<item>([^<]*)</item>', 1) AS item FROM journal WHERE regexp_full_match(jo_request_message, '<request id=\"\d+\"><item>[^<]*</item></request>')")
def _(t):
    d = t.journal.where(F.col("jo_request_message").rlike(r'^<request id="\d+"><item>[^<]*</item></request>$'))
    return d.select("jo_id", F.from_xml("jo_request_message", "item STRING")["item"].alias("item"))


@query("xpath_value", r"SELECT jo_id, regexp_extract(jo_response_message, 'n=\"(\d+)\"', 1) AS n FROM journal WHERE regexp_full_match(jo_response_message, '<ok n=\"\d+\"/>')")
def _(t):
    d = t.journal.where(F.col("jo_response_message").rlike(r'^<ok n="\d+"/>$'))
    return d.select("jo_id", F.xpath_string("jo_response_message", F.lit("ok/@n")).alias("n"))


@query("identity_range", "SELECT range AS id FROM range(0, 1000)")
def _(t):
    return t.spark.range(1000).select("id")


@query("relevance_tf", "SELECT item_id, (len(string_split(lower(text), 'the ')) - 1)::INT AS tf FROM eval_item")
def _(t):
    return t.eval_item.select("item_id", (F.size(F.split(F.lower("text"), "the ")) - 1).alias("tf"))


@query("durations", "SELECT event_id, lpad((event_id // 3600)::VARCHAR, 2, '0') || ':' || lpad(((event_id % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS v FROM events")
def _(t):
    return t.events.select("event_id", S.duration_text("event_id").alias("v"))


@query("signal_levels", "SELECT vec_id, round(exp(embedding[1]::DOUBLE), 6) AS e, round(embedding[2]::DOUBLE * 2.0, 6) AS s FROM embeddings")
def _(t):
    d = t.embeddings.select("vec_id", F.slice("embedding", 1, 2).alias("e"))
    return d.select("vec_id", F.round(S.signal_exp("e")[0], 6).alias("e"), F.round(S.scale_vector("e", [1.0, 2.0])[1], 6).alias("s"))


@query("delta_delta", "SELECT event_id, [event_id * event_id, event_id - 2 * event_id * event_id, event_id * event_id - 2 * event_id + 7] AS d FROM events")
def _(t):
    e = F.col("event_id")
    return t.events.select("event_id", S.delta_delta(F.array(e * e, e, F.lit(7).cast("bigint"))).alias("d"))


@query("bencode", "SELECT n_nationkey, 'd4:name' || strlen(n_name) || ':' || n_name || '6:region' || length(n_regionkey::VARCHAR) || ':' || n_regionkey || 'e' AS v FROM nation")
def _(t):
    return t.nation.select("n_nationkey", S.bencode(F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name"))).alias("v"))


@query("t_score", "SELECT l_returnflag, round(r * sqrt(n - 2) / sqrt(1 - r * r), 3) AS t FROM (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1)")
def _(t):
    d = t.lineitem.groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count("*").alias("n"))
    return d.select("l_returnflag", F.round(S.t_score("r", "n"), 3).alias("t"))


@query("projection", "SELECT vec_id, round(embedding[1]::DOUBLE + 2 * embedding[2]::DOUBLE, 5) AS x, round(embedding[2]::DOUBLE, 5) AS y FROM embeddings")
def _(t):
    p = S.project(F.slice("embedding", 1, 2), [[1, 2], [0, 1]])
    return t.embeddings.select("vec_id", F.round(p[0], 5).alias("x"), F.round(p[1], 5).alias("y"))


@query(
    "plural_stem",
    """SELECT p_partkey, CASE WHEN regexp_matches(w, '[^ae]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(s|x|z|ch|sh)es$') THEN regexp_replace(w, 'es$', '')
       WHEN regexp_matches(w, '[^us]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS v FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) || 's' AS w FROM part)""",
)
def _(t):
    return t.part.select("p_partkey", X.s_stem(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("s"))).alias("v"))
