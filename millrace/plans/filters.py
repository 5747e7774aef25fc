"""Criteria queries."""

from pyspark.sql import functions as F

from ..functions import criteria as K
from .registry import query


@query("crit_eq", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return t.customer.where(K.equals("c_mktsegment", "BUILDING")).select("c_custkey", "c_name")


@query("crit_wildcard", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE '%U%D%'")
def _(t):
    return t.customer.where(K.equals("c_mktsegment", "*U*D*")).select("c_custkey", "c_mktsegment")


@query("crit_escaped_wildcard", r"SELECT file_id, path FROM source_file WHERE path LIKE '%\_pb.%' ESCAPE '\'")
def _(t):
    return t.source_file.where(K.equals("path", "*_pb.*")).select("file_id", "path")


@query("crit_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'e')")
def _(t):
    return t.part.where(K.contains("p_name", "e")).select("p_partkey", "p_name")


@query("crit_ne", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def _(t):
    return t.nation.where(K.not_equals("n_regionkey", 1)).select("n_nationkey", "n_name")


@query("crit_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000")
def _(t):
    return t.orders.where(K.compare("o_totalprice", ">=", 1000) & K.compare("o_totalprice", "LT", 50000)).select("o_orderkey", "o_totalprice")


@query("crit_between_flags", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
def _(t):
    return t.lineitem.where(K.between("l_quantity", 10, 20, True, False)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("crit_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(t):
    return t.orders.where(K.in_set("o_orderstatus", ["F", "P"])).select("o_orderkey")


@query("crit_not_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def _(t):
    return t.orders.where(K.in_set("o_orderpriority", ["1-URGENT", "2-HIGH"], negate=True)).select("o_orderkey", "o_orderpriority")


@query("crit_like_escape", "SELECT file_id, path FROM source_file WHERE path LIKE '%!_%' ESCAPE '!'")
def _(t):
    return t.source_file.where(K.like("path", "%!_%", "!")).select("file_id", "path")


@query("crit_is_null", "SELECT jo_id FROM journal WHERE jo_errormessage IS NULL")
def _(t):
    return t.journal.where(K.is_null("jo_errormessage")).select("jo_id")


@query(
    "crit_bool",
    """SELECT jo_id, (CASE WHEN jo_type = 'R' THEN 1 ELSE 0 END + CASE WHEN coalesce(jo_errorcode > 0, false) THEN 1 ELSE 0 END)::INT AS score
       FROM journal WHERE coalesce(jo_system LIKE 'sys_c%', false) AND NOT coalesce(jo_returncode = 'RC_OK', false)""",
)
def _(t):
    cond, score = K.boolean_query(
        must=[F.col("jo_system").like("sys_c%")],
        must_not=[F.col("jo_returncode") == "RC_OK"],
        should=[F.col("jo_type") == "R", F.col("jo_errorcode") > 0],
    )
    return t.journal.where(cond).select("jo_id", score.alias("score"))


@query(
    "crit_should",
    "SELECT stat_id FROM client_stats WHERE coalesce(client = '?', false) OR coalesce(\"current\" > \"count\", false)",
)
def _(t):
    cond, _ = K.boolean_query(should=[F.col("client") == "?", F.col("current") > F.col("count")])
    return t.client_stats.where(cond).select("stat_id")


@query("crit_selector", "SELECT jo_id FROM journal WHERE (jo_type = 'S' OR jo_type = 'E') AND NOT (jo_errorcode BETWEEN 1 AND 5)")
def _(t):
    c = K.all_of(K.any_of(K.identifier("jo_type") == "S", K.identifier("jo_type") == "E"), ~K.between(K.identifier("jo_errorcode"), 1, 5))
    return t.journal.where(c).select("jo_id")


@query("crit_term_range", "SELECT repo_id, repo_name FROM repo WHERE repo_name > '2' AND repo_name <= '6'")
def _(t):
    return t.repo.where(K.term_range("repo_name", "2", "6", False, True)).select("repo_id", "repo_name")


@query("crit_glob", r"SELECT doc_id, path FROM documents WHERE lower(path) LIKE '%docs%.txt%' ESCAPE '\'")
def _(t):
    return t.documents.where(K.glob("path", "Docs *.TXT")).select("doc_id", "path")


@query("crit_prefix_match", "SELECT repo_id, root_package FROM repo WHERE starts_with(root_package, 'de.')")
def _(t):
    return t.repo.where(K.matches("root_package", "de.", prefix_semantics=True)).select("repo_id", "root_package")


@query("crit_raw_expression", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_tax < 0.02")
def _(t):
    return t.lineitem.where(F.expr("l_discount > 0.05 AND l_tax < 0.02")).select("l_orderkey", "l_linenumber")


@query("crit_fragments", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0 AND c_acctbal <= 5000")
def _(t):
    return t.customer.where(K.simple_fragment("c_mktsegment", "EQ", "MACHINERY")).where(K.between_fragment("c_acctbal", "0", "5000", False, True)).select("c_custkey")


@query("regex_filter", "SELECT file_id, path FROM source_file WHERE regexp_matches(path, '[A-Z][a-z]+Test\\.java$')")
def _(t):
    return t.source_file.where(K.regex("path", r"[A-Z][a-z]+Test\.java$")).select("file_id", "path")


@query("regex_filter_not", "SELECT client, stat_id FROM client_stats WHERE NOT regexp_matches(client, '[0-9]')")
def _(t):
    return t.client_stats.where(K.regex("client", "[0-9]", negate=True)).select("client", "stat_id")


@query("cookie_contains", "SELECT DISTINCT jo_request_message FROM journal WHERE list_contains(list_transform(string_split_regex(jo_request_message, '[; ]+'), lambda x: split_part(x, '=', 1)), '<request')")
def _(t):
    return t.journal.where(K.cookies_contain("jo_request_message", ["<request"])).select("jo_request_message").distinct()


@query(
    "permission_filter",
    "SELECT f.file_id, f.repo_id FROM source_file f WHERE f.repo_id IN (SELECT repo_id FROM repo WHERE license IN ('bsd', 'mit'))",
)
def _(t):
    return t.source_file.select("file_id", "repo_id").join(t.repo.where(F.col("license").isin("bsd", "mit")).select("repo_id"), "repo_id", "left_semi").select("file_id", "repo_id")


@query(
    "array_filter",
    """SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda x: length(x) > 8)) AS INT) AS long_words FROM documents
       WHERE text IS NOT NULL AND len(list_filter(string_split(text, ' '), lambda x: length(x) > 8)) > 0""",
)
def _(t):
    words = F.filter(F.split("text", " "), lambda x: F.length(x) > 8)
    return t.documents.select("doc_id", F.size(words).alias("long_words")).where("long_words > 0")


@query("three_way_compare", "SELECT stat_id, \"count\" = \"current\" AS eq, \"count\" > \"current\" AS gt, \"count\" < \"current\" AS lt, \"count\" = 0 AS zero FROM client_stats")
def _(t):
    c = K.three_way("count", "current")
    return t.client_stats.select("stat_id", c["equal"].alias("eq"), c["greater"].alias("gt"), c["less"].alias("lt"), c["zero"].alias("zero"))


@query("remove_with_values", "SELECT ord, NumericAtt1 FROM filter_row WHERE NominalAtt1 IS NULL OR NOT (NominalAtt1 = 'r')")
def _(t):
    return t.filter_row.where(F.col("NominalAtt1").isNull() | ~K.equals("NominalAtt1", "r")).select("ord", "NumericAtt1")


@query("mode_filter", "SELECT jo_id, jo_type FROM journal WHERE jo_type IN ('R', 'S')")
def _(t):
    modes = {"all": ["R", "S", "E"], "requests": ["R", "S"]}
    return t.journal.where(K.in_set("jo_type", modes["requests"])).select("jo_id", "jo_type")


@query("named_sql_args", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'O'")
def _(t):
    return t.spark.sql(
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice BETWEEN :lo AND :hi AND o_orderstatus = :status",
        args={"lo": 100000, "hi": 200000, "status": "O"},
        orders=t.orders,
    )


@query("crit_in_folder", "SELECT DISTINCT path FROM source_file WHERE path LIKE 'scripts/%' AND path NOT LIKE 'scripts/%/%'")
def _(t):
    return t.source_file.where(K.in_folder("path", "scripts")).select("path").distinct()


@query("crit_in_tree", "SELECT DISTINCT path FROM source_file WHERE path LIKE 'src/main/%' AND path <> 'src/main/'")
def _(t):
    return t.source_file.where(K.in_tree("path", "src/main/")).select("path").distinct()


@query("crit_term_query", "SELECT stat_id FROM client_stats WHERE list_contains([client, count::VARCHAR], '7')")
def _(t):
    return t.client_stats.where(K.term_query(F.array("client", F.col("count").cast("string")), 7)).select("stat_id")


@query("crit_identifier", "SELECT jo_id, jo_system FROM journal WHERE jo_system = 'ldap'")
def _(t):
    return t.journal.where(K.identifier("jo_system") == "ldap").select("jo_id", "jo_system")


@query("crit_stored_clause", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _(t):
    store = {("customer", "where"): "c_acctbal < 0"}
    return t.customer.where(K.clauses(store, "customer", "where") & K.clauses(store, "customer", "having")).select("c_custkey")
