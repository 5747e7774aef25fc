"""Golden values, edge cases and brute-force comparisons of the core operators."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import criteria as K
from millrace.functions import scalars as S
from millrace.functions import text as X
from millrace.operators import aggregates as A
from millrace.operators import columns as C
from millrace.operators import joins as J
from millrace.operators import learners as L
from millrace.operators import mining as M
from millrace.operators import ordered as O
from millrace.operators import rows as R
from millrace.operators.ordinal import Ordered, lagged, running_total, with_ordinal
from millrace.sources import readers
from millrace.sources import writers as W
from millrace.streaming import pipelines as P


def one(spark, expr, **cols):
    names = list(cols) or ["x"]
    df = spark.createDataFrame([tuple(cols.values()) or (1,)], names)
    return df.select(expr.alias("v")).first()["v"]


# ---------------------------------------------------------------- criteria
def test_wildcard_pattern():
    assert K.wildcard_to_like("a*b_c%") == "a%b\\_c\\%"
    assert K.wildcard_to_like("a_b*", legacy_underscore=True) == "a_b%"
    assert K.wildcard_to_like("1\\*2") == "1*2"
    assert not K.has_wildcard("1\\*2")


def test_matches_semantics(spark):
    assert one(spark, K.matches("x", ""), x="abc") is False
    assert one(spark, K.matches("x", "ab"), x="abc") is False
    assert one(spark, K.matches("x", "ab", prefix_semantics=True), x="abc") is True
    assert one(spark, K.matches("x", "*b*"), x="abc") is True
    assert one(spark, K.matches("x", "*"), x="") is False


def test_three_valued_logic(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert df.where(K.not_equals("x", "b")).count() == 1
    assert df.where(~K.in_set("x", ["b"])).count() == 1
    cond, score = K.boolean_query(must_not=[F.col("x") == "a"])
    assert df.where(cond).count() == 1


def test_bad_arguments():
    with pytest.raises(TypeError):
        K.compare("x", "<", [1])
    with pytest.raises(ValueError):
        K.like("x", "a", "!!")
    with pytest.raises(ValueError):
        K.identifier("JMSSomething")
    with pytest.raises(ValueError):
        K.glob_pattern("  ")
    p = K.Parameters()
    p.add(1)
    with pytest.raises(IndexError):
        p.get(1)


def test_fragments():
    assert K.between_fragment("c", "lo", "hi", True, False) == "c >= lo AND c < hi"
    assert K.term_range_text("f", "lo", "hi", False, True) == "f:{lo TO hi]"
    assert K.simple_fragment("c", "NE", "o'x") == "c <> 'o''x'"
    assert X.bind("a = ? and b = ?", ["x'y", None]) == "a = 'x''y' and b = null"


def test_cookies(spark):
    assert one(spark, K.cookies_contain("x", ["a", "c"]), x="a=1; b=2; c=3") is True
    assert one(spark, K.cookies_contain("x", ["z"]), x="a=1") is False


# ---------------------------------------------------------------- functions
def test_text_goldens(spark):
    assert one(spark, X.isbn13("x"), x="395815714:") == "9783958157149"
    assert one(spark, X.html_escape("x"), x='a"<b>&') == "a&quot;&lt;b&gt;&amp;"
    assert one(spark, X.strip_tags("x"), x="a<b>c<d") == "ac<d"
    assert one(spark, X.normalize_whitespace("x"), x=" a\t\n b ") == " a b "
    assert one(spark, X.extract_ints("x"), x="1 2 3") == [1, 2, 3]
    assert one(spark, X.table_qualifier("x"), x="c.s.t").asDict() == {"catalog": "c", "schema": "s", "table": "t"}
    assert one(spark, X.ascii_fold("x"), x="Zażółć 漢") == "Zazolc ?"


def test_scalar_goldens(spark):
    assert one(spark, S.percent(F.lit(1), F.lit(1))) == 100.0
    assert one(spark, S.power_of_two(F.lit(0))) is True
    assert one(spark, S.power_of_two(F.lit(12))) is False
    assert one(spark, F.format_number(F.lit(1811.8174), 0)) == "1,812"
    assert one(spark, S.solexa_to_phred(F.lit(-5))) == 1
    assert one(spark, S.delta_delta(F.array(F.lit(1), F.lit(3), F.lit(6)))) == [1, 1, 1]
    assert one(spark, S.int_ratio(F.lit(7), F.lit(0))) is None


# ---------------------------------------------------------------- columns
@pytest.fixture
def rel(spark):
    return spark.createDataFrame([(1, 1.0, "r"), (2, None, "g"), (3, 5.0, None), (4, float("nan"), "g")], "ord int, v double, n string")


def test_missing_values(rel):
    got = {r["ord"]: r["v"] for r in C.center(rel, ["v"]).collect()}
    assert got == {1: -2.0, 2: None, 3: 2.0, 4: None}
    filled = {r["ord"]: (r["v"], r["n"]) for r in C.replace_missing(rel, ["v"], ["n"]).collect()}
    assert filled[2] == (3.0, "g") and filled[3] == (5.0, "g")


def test_constant_and_empty(spark):
    d = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r["v"] for r in C.standardize(d, ["v"]).collect()] == [None, None]
    assert [r["v"] for r in C.normalize(d, ["v"]).collect()] == [0.0, 0.0]
    e = spark.createDataFrame([], "v double")
    assert C.center(e, ["v"]).count() == 0
    assert C.iqr_flags(e, ["v"]).count() == 0


def test_mode_ties_follow_the_domain(spark):
    d = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "n string")
    assert d.select(C.mode_value(d, "n").alias("m")).first()["m"] == "a"
    assert d.select(C.mode_value(d, "n", ["b", "a"]).alias("m")).first()["m"] == "b"


def test_mdl_splits_and_stops(spark):
    d = spark.createDataFrame([(float(i), "x" if i < 50 else "y") for i in range(100)], "v double, c string")
    assert C.mdl_cuts(d, "v", "c") == [49.5]
    assert C.quantiles(d, "v", [0.0, 0.25, 1.0]) == [0.0, 24.75, 99.0]
    assert C.quantiles(d.limit(0), "v", [0.5]) == [None]
    noise = spark.createDataFrame([(float(i), "xy"[i * 7919 % 2]) for i in range(40)], "v double, c string")
    assert len(C.mdl_cuts(noise, "v", "c")) <= 1


# ---------------------------------------------------------------- order
def test_ordinal_is_global(spark):
    d = with_ordinal(spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000))).repartition(7), "k")
    assert d.where(F.col("ordinal") != F.col("k") + 1).count() == 0
    t = running_total(d, F.lit(1).cast("bigint"), name="t")
    assert t.where(F.col("t") != F.col("ordinal")).count() == 0
    assert lagged(d, {"k": "p"}).where("has_previous AND p <> k - 1").count() == 0
    assert with_ordinal(spark.range(0), "id").count() == 0
    from millrace.operators import ordinal

    old, ordinal.MAX_INLINE = ordinal.MAX_INLINE, 1
    try:
        d = with_ordinal(spark.range(1000).repartition(5), F.desc("id"), start=0)
        assert d.columns == ["id", "ordinal"] and d.where("ordinal <> 999 - id").count() == 0
    finally:
        ordinal.MAX_INLINE = old


def test_runs_join_equal_neighbours(spark):
    d = spark.createDataFrame(list(enumerate(["a", "a", None, None, "b", "a"])), "o int, k string")
    got = sorted((r["run"], r["k"], r["n"]) for r in A.runs(d, "k", "o", [F.count("*").alias("n")]).collect())
    assert got == [(1, "a", 2), (2, None, 2), (3, "b", 1), (4, "a", 1)]


def test_percentage_rounds_half_up(spark):
    assert R.remove_percentage(spark.range(21), "id", 50).count() == 10


def test_folds_cover_all(spark):
    d = spark.range(23)
    parts = [R.fold(d, "id", 10, k).count() for k in range(1, 11)]
    assert parts == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]
    s = d.withColumn("c", F.when(F.col("id") < 20, "a"))
    assert sum(R.stratified_fold(s, "id", "c", 5, k).count() for k in range(1, 6)) == 23


def test_quality_trim(spark):
    v = one(spark, O.quality_trim(F.array(*[F.lit(x) for x in (2, 30, 35, 40, 3, 2)]), 20))
    assert (v["begin"], v["end"]) == (1, 3)


def test_exponential_keeps_keys_apart(spark):
    d = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (2, 1, 5.0)], "k int, t int, v double")
    got = {(r["k"], r["t"]): r["smooth"] for r in O.exponential_index(d, "k", "t", "v", 0.5).collect()}
    assert got == {(1, 1): 10.0, (1, 2): 15.0, (2, 1): 5.0}


# ---------------------------------------------------------------- joins
def test_range_join_is_complete(spark):
    p = spark.range(200).select(F.col("id").cast("double").alias("v"))
    r = spark.createDataFrame([(1, 5.0, 17.0), (2, 17.0, 17.0), (3, 190.0, 500.0)], "k int, a double, b double")
    got = sorted((x["k"], x["v"]) for x in J.range_join(p, r, "v", "a", "b", 10).collect())
    want = sorted((k, float(v)) for k, a, b in [(1, 5, 17), (2, 17, 17), (3, 190, 500)] for v in range(200) if a <= v <= b)
    assert got == want


def test_asof_takes_the_latest(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "x"), (1, 5, "y"), (2, 10, "z")], "k int, t int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in J.asof_join(left, right, "k", "t", ["v"]).collect()}
    assert got == {(1, 5): "y", (1, 1): None, (2, 9): None}
    left = spark.createDataFrame([(i % 3, i) for i in range(0, 200, 7)], "k int, t int")
    right = spark.createDataFrame([(i % 3, i, str(i)) for i in range(0, 200, 11)], "k int, t int, v string")
    whole = sorted(map(tuple, J.asof_join(left, right, "k", "t", ["v"]).collect()))
    assert whole == sorted(map(tuple, J.asof_join(left, right, "k", "t", ["v"], F.floor(F.col("t") / 25)).collect()))


def test_near_miles_against_brute_force(spark):
    pts = [(i, (i * 37 % 160) - 80.0, (i * 91 % 360) - 180.0) for i in range(120)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")

    def miles(a, b):
        x = math.sin(math.radians(a[1])) * math.sin(math.radians(b[1])) + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.cos(math.radians(a[2] - b[2]))
        return math.acos(max(-1, min(1, x))) * S.MILES_PER_RADIAN

    want = {(a[0], b[0]) for a in pts for b in pts if miles(a, b) <= 500}
    assert {(r["id_a"], r["id_b"]) for r in J.near_miles(df, df, 500).collect()} == want


# ---------------------------------------------------------------- mining
def test_nearest_against_brute_force(spark):
    rows = [(i, [math.sin(i), math.cos(i * 2.0), i % 7 / 7]) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {(r["query"], r["neighbour"]) for r in M.nearest(df, df.where("id % 50 = 0"), "id", "v", 4).collect()}
    want = set()
    for q, v in rows[::50]:
        best = sorted((math.dist(v, w), i) for i, w in rows if i != q)[:4]
        want |= {(q, i) for _, i in best}
    assert got == want
    old, M.QUERY_BLOCK = M.QUERY_BLOCK, 2
    try:
        assert {(r["query"], r["neighbour"]) for r in M.nearest(df, df.where("id % 50 = 0"), "id", "v", 4).collect()} == want
    finally:
        M.QUERY_BLOCK = old
    assert M.nearest(df, df.limit(0), "id", "v", 4).count() == 0


def test_naive_bayes_learns(spark):
    d = spark.createDataFrame([(i, "x" if i % 2 else "y", "p" if i % 2 else "q") for i in range(40)], "id int, a string, c string")
    got = M.naive_bayes(d, d, "id", ["a"], "c").join(d, "id")
    assert got.where("predicted <> c").count() == 0


# ---------------------------------------------------------------- sources
def test_arff_dense_and_sparse(spark, tmp_path):
    p = tmp_path / "r.arff"
    p.write_text("@relation r\n@attribute s string\n@attribute n {r,g,b}\n@attribute v numeric\n@attribute d date yyyy-MM-dd\n@data\nhumpty,g,1,2001-04-03\n?,?,?,?\n{0 wall,2 4.3}\n")
    rows = readers.arff(spark, str(p)).orderBy("ord").collect()
    assert [(r["ord"], r["s"], r["n"], r["v"]) for r in rows] == [(1, "humpty", "g", 1.0), (2, None, None, None), (3, "wall", "r", 4.3)]
    assert str(rows[0]["d"])[:10] == "2001-04-03" and str(rows[2]["d"])[:10] == "1970-01-01"


def test_fastq_multiline(spark, tmp_path):
    p = tmp_path / "a.fastq"
    p.write_text("@r1 x\nACG\nT\n+\n@II\nI\n@r2\nAC\n+r2\n!~\n")
    got = [(r["id"], r["bases"], r["qualities"]) for r in readers.fastq(spark, str(p)).collect()]
    assert got == [("r1", "ACGT", [31, 40, 40, 40]), ("r2", "AC", [0, 93])]


def test_hl7_and_aleph(spark, tmp_path):
    h = tmp_path / "m.hl7"
    h.write_text("MSH|^~\\&|LAB\rPID|1|A^B~C\r")
    got = {(r["segment"], r["field"], r["rep"], r["component"], r["value"]) for r in readers.hl7(spark, str(h)).where("segment = 'PID'").collect()}
    assert got == {("PID", 1, 0, 0, "1"), ("PID", 2, 0, 0, "A"), ("PID", 2, 0, 1, "B"), ("PID", 2, 1, 0, "C")}
    a = tmp_path / "a.txt"
    a.write_text("000000001 DEL   L $$aY\n000000002 245   L $$aTitle$$bRest\n")
    rows = readers.aleph(spark, str(a)).orderBy("id").collect()
    assert [r["deleted"] for r in rows] == [True, False]
    assert [(s["code"], s["text"]) for s in rows[1]["subfields"]] == [("a", "Title"), ("b", "Rest")]


def test_ini_sections(spark, tmp_path):
    p = tmp_path / "a.ini"
    p.write_text("x=0\n[One]\na=1\nbad line\n; c=2\n[TWO]\nb = 3=4\n")
    got = {(r["section"], r["key"], r["value"]) for r in readers.ini(spark, str(p)).collect()}
    assert got == {(None, "x", "0"), ("one", "a", "1"), ("two", "b", "3=4")}


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([(1, "o'x"), (2, None)], "a int, b string")
    got = [r["statement"] for r in W.insert_statements(d, "t").orderBy("statement").collect()]
    assert got == ["INSERT INTO t (a, b) VALUES (1, 'o''x');", "INSERT INTO t (a, b) VALUES (2, NULL);"]
    with pytest.raises(ValueError):
        W.export(d, str(tmp_path / "x"), "pdf")


# ---------------------------------------------------------------- streaming
def test_journal_is_idempotent(spark, tmp_path):
    src, out, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "ckpt"
    spark.range(100).repartition(3).write.parquet(str(src))
    stream = lambda: spark.readStream.schema("id long").parquet(str(src))
    P.journaled(stream(), str(out), str(ckpt))
    P.journaled(stream(), str(out), str(ckpt))
    assert spark.read.parquet(str(out)).count() == 100


def test_context_stack_is_bounded(spark):
    d = spark.createDataFrame([(1, i, "push", str(i)) for i in range(10)] + [(1, 10, "pop", None), (1, 11, "clear", None)], "k int, o int, op string, item string")
    got = [(r["depth"], r["top"]) for r in P.context_stacks(d, "k", "o", "op", "item", 3).orderBy("o").collect()]
    assert got[2:5] == [(3, "2"), (3, "2"), (3, "2")] and got[10:] == [(2, "1"), (0, None)]


# ------------------------------------------------------------ order and scale
def test_ordered_passes_against_one_process(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-9, 9)]), rng.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "i int, k string, n int, x double").repartition(7)
    for by in (1, 3, 900):
        got = sorted(tuple(r) for r in Ordered(df, "i").lag({"k": "pk", "n": "pn"}, by).ordinal("o").rows().select("i", "pk", "pn", "has_previous", "o").collect())
        assert got == [(i, rows[i - by][1] if i >= by else None, rows[i - by][2] if i >= by else None, i >= by, i + 1) for i in range(700)]
    total = 0
    sums = {r["i"]: r["t"] for r in Ordered(df, "i").total("t", F.col("n")).rows().collect()}
    for i, _, n, _ in rows:
        total += n or 0
        assert sums[i] == total
    empty = Ordered(df.limit(0), "i").lag({"k": "pk"}).total("t", F.col("x")).ordinal().rows()
    assert empty.count() == 0 and empty.columns == ["i", "k", "n", "x", "pk", "has_previous", "t", "ordinal"]
    with pytest.raises(TypeError):
        Ordered(df, "i").total("t", F.col("x").cast("decimal(9, 2)"))


def test_near_miles_over_the_edges(spark):
    import random

    rng = random.Random(3)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)]
    places += [(200, 10.0, 179.9), (201, 10.0, -179.9), (202, 89.95, 0.0), (203, 89.95, 180.0), (204, -89.99, 90.0), (205, -89.99, -90.0), (206, 0.0, 360.0), (207, 0.0, 0.5), (208, None, 1.0)]
    df = spark.createDataFrame(places, "id int, lat double, lon double")

    def miles(a, b):
        p, q = map(math.radians, (a[1], b[1]))
        c = math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(math.radians(a[2] - b[2]))
        return math.acos(max(-1.0, min(1.0, c))) * 3958.7558657440547

    for within in (30, 600, 9_000, 13_000):
        got = {(r["id_a"], r["id_b"]) for r in J.near_miles(df, df, within).collect()}
        assert got == {(a[0], b[0]) for a in places for b in places if a[1] is not None and b[1] is not None and miles(a, b) <= within}


def test_range_join_with_wide_ranges(spark):
    points = spark.createDataFrame([(i, i * 3.7) for i in range(300)] + [(999, None)], "p int, v double")
    spans = [(0, 0.0, 1e9), (1, 5.0, 5.0), (2, 37.0, 500.0), (3, 9.0, 3.0), (4, None, 4.0), (5, -1e12, 10.0)]
    got = {(r["p"], r["r"]) for r in J.range_join(points, spark.createDataFrame(spans, "r int, lo double, hi double"), "v", "lo", "hi", 2).collect()}
    assert got == {(i, r) for i in range(300) for r, lo, hi in spans if lo is not None and lo <= i * 3.7 <= hi}


def test_natural_keys_do_not_meet(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, ""), ("", None), ("", ""), ("\\N", ""), ("a\\", "b"), ("a", "\\b")]
    keys = [r["k"] for r in spark.createDataFrame(rows, "x string, y string").select(J.natural_key("x", "y").alias("k")).collect()]
    assert len(set(keys)) == len(rows)


def test_partners(spark):
    rows = [("a", 100, "+"), ("a", 400, "-"), ("b", 100, "+"), ("b", 400, "+"), ("c", 1, "+"), ("d", 1, "+"), ("d", 9000, "-"), ("e", 1, "+"), ("e", 300, "-"), ("e", 300, "-"), (None, 1, "+")]
    got = [tuple(r) for r in J.partners(spark.createDataFrame(rows, "k string, p int, s string"), "k", "p", "s", 200, 500).collect()]
    assert got == [("a", 300)]


def test_long_paths_are_followed(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(55)], "src string, dst string").coalesce(1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert R.reachable(edges, "0").count() == 56
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


# -------------------------------------------------------------- learners
def test_boosting_against_one_process(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(400):
        a, b, c = (rng.choice(["u", "v", "w", None]) for _ in range(3))
        cls = rng.choice([None, "n"]) if i % 37 == 0 else "y" if (a == "u") ^ (b == "v") or rng.random() < 0.1 else "n"
        rows.append((i, a, b, c, cls))
    df = spark.createDataFrame(rows, "i int, a string, b string, c string, k string")
    known = [r for r in rows if r[4] is not None]

    def stump(w):
        best = None
        for at in (1, 2, 3):
            for value in sorted({r[at] for r in known if r[at] is not None}):
                side = {True: {}, False: {}}
                for r, x in zip(known, w):
                    if r[at] is not None:
                        side[r[at] == value][r[4]] = side[r[at] == value].get(r[4], 0) + x
                right = max(side[True].values()) + max(side[False].values())
                top = lambda s: min(s, key=lambda k: (-round(s[k], 9), k))
                if best is None or round(right, 9) > round(best[0], 9):
                    best = (right, at, value, top(side[True]), top(side[False]))
        missing = {}
        for r, x in zip(known, w):
            missing[r[4]] = missing.get(r[4], 0) + x
        _, at, value, yes, no = best
        most = min(missing, key=lambda k: (-round(missing[k], 9), k))
        return lambda r: most if r[at] is None else yes if r[at] == value else no

    w, votes = [1.0] * len(known), []
    for _ in range(4):
        s = stump(w)
        bad = [s(r) != r[4] for r in known]
        e = sum(x for x, b in zip(w, bad) if b) / sum(w)
        if e >= 0.5 or e <= 0:
            break
        votes.append((s, math.log((1 - e) / e)))
        w = [x * ((1 - e) / e if b else 1) for x, b in zip(w, bad)]
    assert len(votes) > 1

    def vote(r):
        total = {}
        for s, x in votes:
            total[s(r)] = total.get(s(r), 0) + x
        return min(total, key=lambda k: (-round(total[k], 9), k))

    got = {r["i"]: r["predicted"] for r in M.ada_boost(df, df, "i", ["a", "b", "c"], "k", 4).collect()}
    assert got == {r[0]: vote(r) for r in rows}
    assert M.ada_boost(df, df.limit(0), "i", ["a"], "k", 2).count() == 0
    one_class = df.where("k = 'y'")
    assert {r["predicted"] for r in M.ada_boost(one_class, df, "i", ["a", "b"], "k", 3).collect()} == {"y"}
    blank = df.select("i", F.lit(None).cast("string").alias("a"), "k")
    assert M.decision_stump(blank, blank, "i", ["a"], "k").count() == 400


def test_multinomial_bayes_edges(spark):
    rows = [(1, ["a", "b", "a"], "x"), (2, ["c"], "y"), (3, [], "y"), (4, None, "y"), (5, ["never"], None), (6, ["a", "never"], None)]
    df = spark.createDataFrame(rows, "i int, words array<string>, k string")
    got = {r["i"]: r["predicted"] for r in M.naive_bayes_multinomial(df, df, "i", "words", "k").collect()}
    assert got == {1: "x", 2: "y", 3: "y", 4: "y", 5: "y", 6: "y"}  # 6: 1/4 * 3/6 against 3/4 * 1/4
    assert M.naive_bayes_multinomial(df, df.limit(0), "i", "words", "k").count() == 0


def test_misclassified_rows_leave(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "i int, k string")
    said = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "i int, predicted string")
    assert sorted(r["i"] for r in M.without_misclassified(rows, said, "i", "k").collect()) == [1, 3, 4]


def test_best_first_finds_pairs(spark):
    rows = [(a, b, c, str(a ^ b)) for a in (0, 1) for b in (0, 1) for c in (0, 1, 2)] * 3 + [(1, 0, 2, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int, k string")
    assert M.cfs_select(df, ["a", "b", "c"], "k") == []
    same = df.withColumn("d", F.col("k"))
    assert M.cfs_select(same, ["a", "d", "c"], "k") == ["d"]


def test_farthest_first_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0]), (4, None)], "i int, v array<double>")
    assert M.farthest_first(df, "i", "v", 9, 1) == [1, 3, 2]
    with pytest.raises(ValueError):
        M.farthest_first(df, "i", "v", 2, 77)


def test_spline_against_a_linear_solve(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 9):
        x = np.sort(rng.choice(50, n, replace=False)).astype(float)
        y = rng.normal(size=n)
        a, r = np.eye(n), np.zeros(n)
        for i in range(1, n - 1):
            h0, h1 = x[i] - x[i - 1], x[i + 1] - x[i]
            a[i, i - 1 : i + 2] = h0, 2 * (h0 + h1), h1
            r[i] = 6 * ((y[i + 1] - y[i]) / h1 - (y[i] - y[i - 1]) / h0)
        m = np.linalg.solve(a, r)
        at = np.linspace(x[0], x[-1], 33)
        want = []
        for t in at:
            k = max(0, min(int(np.searchsorted(x, t, side="right")) - 1, n - 2))
            if n == 1:
                want.append(y[0])
                continue
            h = x[k + 1] - x[k]
            p, q = (x[k + 1] - t) / h, (t - x[k]) / h
            want.append(p * y[k] + q * y[k + 1] + ((p**3 - p) * m[k] + (q**3 - q) * m[k + 1]) * h * h / 6)
        assert np.allclose(O.natural_spline(x, y, at), want)
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("a", 3, 5.0), ("b", 1, None), (None, 1, 2.0)], "k string, t int, v double")
    got = {(r["k"], r["t"]): r["spline"] for r in O.cubic_spline(df, "k", "t", "v").collect()}
    assert got["a", 2] == pytest.approx(2.5) and got[None, 1] == 2.0 and (got["b", 1] is None or math.isnan(got["b", 1]))


def test_resample_to_uniform_edges(spark):
    df = spark.createDataFrame([(i, "a" if i < 900 else "b" if i < 990 else None) for i in range(1000)], "i int, k string")
    got = {r["k"]: r["n"] for r in R.resample_to_uniform(df, "k", 3.0, 1.0, 1).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {"a", "b", None} and all(abs(n - 1000) < 200 for n in got.values())
    assert R.resample_to_uniform(df.limit(0), "k", 1.0, 1.0, 1).count() == 0
    assert R.rank_select(df.limit(0), F.col("i"), ["i"], 5, 1).count() == 0


def test_digests(spark):
    import hashlib

    for name in ("MD5", "SHA-1", "SHA-256", "SHA-384", "SHA-512"):
        want = hashlib.new(name.replace("-", "").lower(), "né".encode()).hexdigest()
        assert one(spark, X.digest("x", name), x="né") == want
        assert one(spark, X.digest("x", name, "hex"), x="6ec3a9") == want
        assert one(spark, X.digest("x", name, "base64"), x="bsOp") == want
    with pytest.raises(ValueError):
        X.digest("x", "MD2")


def test_folders(spark):
    d = spark.createDataFrame([("a/b",), ("a/b/c",), ("a",), ("a/",), ("ab/c",), (None,)], "p string")
    assert [r["p"] for r in d.where(K.in_folder("p", "a")).collect()] == ["a/b"]
    assert [r["p"] for r in d.where(K.in_tree("p", "a/")).collect()] == ["a/b", "a/b/c"]


def test_checkpoints_need_shared_storage(spark, monkeypatch):
    from millrace import session

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():  # noqa: N802
                        return type("O", (), {"isEmpty": staticmethod(lambda: True)})

                return S

    fake = type("Spark", (), {"conf": type("C", (), {"get": staticmethod(lambda *a: None)}), "sparkContext": Context})
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake)


def test_id3_against_recursion(spark):
    import random
    from collections import Counter

    rng = random.Random(7)
    rows = []
    for i in range(300):
        a, b, c = rng.choice("uvw"), rng.choice(["p", "q", None]), rng.choice("xy")
        rows.append((i, a, b, c, rng.choice("mn") if rng.random() < 0.15 else "m" if (a == "u" and b == "p") or c == "y" and a == "w" else "n"))
    rows += [(300, "u", "p", "x", None), (301, "new", "p", "x", None), (302, None, None, "z", None)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string, k string")
    known = [r for r in rows if r[4] is not None]

    def h(part):
        n = len(part)
        return -sum(x / n * math.log2(x / n) for x in Counter(r[4] for r in part).values())

    def grow(part, free):
        counts = Counter(r[4] for r in part)
        most = min(counts, key=lambda k: (-counts[k], k))
        best = None
        for at in free:
            values = {r[at] for r in part}
            gain = round(h(part) - sum(len(p) / len(part) * h(p) for v in values for p in [[r for r in part if r[at] == v]]), 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, at, values)
        if best is None:
            return lambda r: most
        _, at, values = best
        below = {v: grow([r for r in part if r[at] == v], [f for f in free if f != at]) for v in values}
        return lambda r: below[r[at]](r) if r[at] in below else most

    tree = grow(known, [1, 2, 3])
    got = {r["i"]: r["predicted"] for r in L.id3(df, df, "i", ["a", "b", "c"], "k").collect()}
    assert got == {r[0]: tree(r) for r in rows}
    assert L.id3(df, df.limit(0), "i", ["a"], "k").count() == 0
    assert {r["predicted"] for r in L.id3(df.limit(0), df, "i", ["a"], "k").collect()} == {None}


def test_votes_and_evaluation(spark):
    p = [spark.createDataFrame([(1, x), (2, y), (3, z)], "i int, predicted string") for x, y, z in (("a", "b", None), ("a", "c", None), ("b", None, None))]
    assert {r["i"]: r["predicted"] for r in L.vote(p, "i").collect()} == {1: "a", 2: "b", 3: None}
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "a"), ("a", None)], "x string, y string")
    e = L.evaluation(d, "x", "y").first()
    assert (e["n"], e["accuracy"]) == (4, 0.75) and e["kappa"] == pytest.approx(0.5)
    empty = L.evaluation(d.limit(0), "x", "y").first()
    assert (empty["n"], empty["accuracy"], empty["kappa"]) == (0, None, None)


def test_counted_learners_at_the_edges(spark):
    df = spark.createDataFrame([(1, 1.0, None, "a"), (2, 1.2, "p", "a"), (3, 9.0, "q", "b"), (4, None, None, None), (5, float("nan"), "new", None)], "i int, x double, n string, k string")
    rest = spark.createDataFrame([(7, 9.0, "q", None), (8, None, None, None)], "i int, x double, n string, k string")
    assert {r["i"]: r["predicted"] for r in L.gaussian_bayes(df, rest, "i", ["x"], "k").collect()} == {7: "b", 8: "a"}
    assert {r["i"]: r["predicted"] for r in L.hyper_pipes(df, df, "i", ["x"], "k").collect()} == {1: "a", 2: "a", 3: "b", 4: "a", 5: "a"}
    assert {r["i"]: r["predicted"] for r in L.averaged_dependence(df, rest, "i", ["n"], "k").collect()} == {7: "b", 8: None}
    for fn, cols in ((L.gaussian_bayes, ["x"]), (L.hyper_pipes, ["x"]), (L.averaged_dependence, ["n"])):
        assert fn(df, rest.limit(0), "i", cols, "k").count() == 0


def test_iterative_learners_on_held_out_rows(spark):
    import random

    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans

    rng = random.Random(9)
    rows = [(i, [rng.gauss(c * 4.0, 1.0), rng.gauss(-c * 4.0, 1.0)], float(c)) for i in range(600) for c in [i % 2]]
    df = M.vector_column(spark.createDataFrame(rows, "i int, v array<double>, label double"), "v")
    train, held = df.where("i < 400"), df.where("i >= 400")
    for e in (LogisticRegression(maxIter=5), DecisionTreeClassifier(maxDepth=3, seed=1), RandomForestClassifier(numTrees=5, maxDepth=3, seed=1), LinearSVC(maxIter=5), GBTClassifier(maxIter=3, maxDepth=3, seed=1)):
        said = e.fit(train).transform(held).select(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()["a"]
        assert said > 0.95, e
    for e in (KMeans(k=2, seed=1, maxIter=5), BisectingKMeans(k=2, seed=1, maxIter=5), GaussianMixture(k=2, seed=1, maxIter=5)):
        same = e.fit(train).transform(held).groupBy("prediction").agg(F.avg("label").alias("m")).collect()
        assert len(same) == 2 and all(r["m"] < 0.05 or r["m"] > 0.95 for r in same), e


def test_quantiles_by_counting(spark, monkeypatch):
    import random

    inf = float("inf")
    rng = random.Random(4)
    sets = [
        [rng.gauss(0, 1) for _ in range(999)],
        [1.0] * 500 + [2.0] * 3 + [7.5],
        [rng.choice([-inf, inf, 0.0, 5.0, 1e308, -1e308]) for _ in range(200)],
        [1e-300 * i for i in range(50)] + [1e300],
        [3.0],
        [inf, inf],
    ]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for limit in (200_000, 4):
        monkeypatch.setattr(C, "QUANTILE_VALUES", limit)
        for values in sets:
            ordered = sorted(values)
            want = []
            for q in shares:
                p = (len(ordered) - 1) * q
                x, y = ordered[int(p)], ordered[min(int(p) + 1, len(ordered) - 1)]
                want.append(x if x == y else x + (y - x) * (p - int(p)))
            df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
            got = C.quantiles(df, "v", shares)
            assert [repr(g) for g in got] == [repr(w) for w in want]
    assert C.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_mdl_cuts_of_long_tables(spark, monkeypatch):
    import random

    rng = random.Random(8)
    rows = [(x, "abc"[(x > 20) + (x > 55)] if rng.random() < 0.9 else rng.choice("abc")) for x in (rng.uniform(0, 80) for _ in range(600))] + [(None, "a"), (float("nan"), "b"), (3.0, None)]
    df = spark.createDataFrame(rows, "v double, l string")
    whole = C.mdl_cuts(df, "v", "l")
    monkeypatch.setattr(C, "MDL_CELLS", 10)
    assert C.mdl_cuts(df, "v", "l") == pytest.approx(whole) and len(whole) == 2
    assert C.mdl_cuts(df.limit(0), "v", "l") == []
    assert C.mdl_cuts(df.withColumn("l", F.lit("a")), "v", "l") == []
