"""The registered queries of the probability operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.catalog import Variable, state_index, state_space
from marginalia.functions.scalar import clean_name, natural_index, one_hot, plogp, uniform_of
from marginalia.operators import crosstab as ct
from marginalia.operators import divergence, evidence, factors, inference, learning, sampling
from marginalia.operators.factors import Factor, Model
from marginalia.operators.space import Space

FLAGS = Variable("rf", ("A", "N", "R"))
STATUS = Variable("ls", ("F", "O"))
SEGMENT = Variable("seg", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
PRIORITY = Variable("op", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
ORDER_STATUS = Variable("os", ("F", "O", "P"))

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r9(name: str):
    return (F.round(F.col(name), 9) + 0.0).alias(name)


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("qty"), F.col("l_orderkey").alias("key"))


def counts(spark: SparkSession, d: str, *by: str, weight: str | None = None) -> DataFrame:
    return ct.cross_table(items(spark, d), by, weight)


ITEMS = "items AS (SELECT l_returnflag AS rf, l_linestatus AS ls, l_linenumber AS ln, l_quantity AS qty, l_orderkey AS key FROM lineitem)"
RFLS = f"{ITEMS}, t AS (SELECT rf, ls, count(*)::DOUBLE AS weight FROM items GROUP BY ALL)"


# ---------------------------------------------------------------- cross-tables


@query("SELECT l_returnflag AS rf, l_linestatus AS ls, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL")
def crosstab_rf_ls(spark, d):
    return counts(spark, d, "rf", "ls")


@query("SELECT l_returnflag AS rf, l_linestatus AS ls, round(sum(l_quantity), 6) AS weight FROM lineitem GROUP BY ALL")
def crosstab_weighted_qty(spark, d):
    return counts(spark, d, "rf", "ls", weight="qty").select("rf", "ls", F.round("weight", 6).alias("weight"))


@query(
    f"WITH {ITEMS}, space AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) a(rf), (VALUES ('F'), ('O')) b(ls)) SELECT rf, ls, sum(w) AS weight FROM (SELECT rf, ls, 1.0::DOUBLE AS w FROM items UNION ALL SELECT rf, ls, 1.0::DOUBLE FROM space) GROUP BY ALL"
)
def crosstab_prior(spark, d):
    space = state_space(spark, [FLAGS, STATUS]).select(FLAGS.labels(F.col("rf")).alias("rf"), STATUS.labels(F.col("ls")).alias("ls"))
    return ct.cross_table(items(spark, d), ["rf", "ls"], prior=1.0, space=space)


@query(f"WITH {RFLS} SELECT rf, sum(weight) AS weight FROM t GROUP BY rf")
def crosstab_project(spark, d):
    return ct.project(counts(spark, d, "rf", "ls"), ["rf"])


@query(
    """SELECT CASE WHEN grouping(rf) = 0 AND grouping(ls) = 0 THEN 0 WHEN grouping(rf) = 0 THEN 2 ELSE 1 END::INTEGER AS scope, rf, ls, op, count(*)::DOUBLE AS weight
FROM (SELECT l_returnflag AS rf, l_linestatus AS ls, o_orderpriority AS op FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY GROUPING SETS ((rf, ls), (ls, op), (rf, op))"""
)
def crosstab_multi_factor(spark, d):
    joined = items(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("op")), "key")
    return ct.cross_tables(joined, [["rf", "ls"], ["ls", "op"], ["rf", "op"]])


@query("SELECT count(*)::DOUBLE AS weight FROM lineitem")
def crosstab_total(spark, d):
    return ct.total_weight(counts(spark, d, "rf", "ls"))


@query(f"WITH {RFLS} SELECT rf, ls, weight * 0.5 AS weight FROM t")
def crosstab_scale(spark, d):
    return ct.scale(counts(spark, d, "rf", "ls"), 0.5)


@query(f"WITH {ITEMS} SELECT rf, sum(w) AS weight FROM (SELECT rf, 1.0::DOUBLE AS w FROM items UNION ALL SELECT rf, 2.0::DOUBLE FROM items WHERE ls = 'O') GROUP BY rf")
def crosstab_add(spark, d):
    return ct.add(counts(spark, d, "rf"), ct.scale(ct.cross_table(items(spark, d).where("ls = 'O'"), ["rf"]), 2))


@query(
    f"WITH {RFLS}, w AS (SELECT * FROM (VALUES ('A', 100.0::DOUBLE), ('N', 10.0)) x(rf, wanted)) SELECT t.rf, ls, round(weight * wanted / sum(weight) OVER (PARTITION BY t.rf), 9) AS weight FROM t JOIN w USING (rf)"
)
def condition_crosstab(spark, d):
    target = spark.createDataFrame([("A", 100.0), ("N", 10.0)], "rf string, weight double")
    return ct.condition_table(counts(spark, d, "rf", "ls"), target).select("rf", "ls", r9("weight"))


# ---------------------------------------------------------------- data sets


@query("SELECT o_orderkey AS key, dense_rank() OVER (ORDER BY o_orderpriority)::INTEGER - 1 AS state FROM orders")
def state_index_priority(spark, d):
    return state_index(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("op")), "op", "state").select("key", "state")


@query("SELECT o_orderkey AS key, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::INTEGER AS state FROM orders")
def state_of_label(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), ORDER_STATUS.of_labels(F.col("o_orderstatus")).alias("state"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS f, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0 END AS o, CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0 END AS p FROM orders")
def one_hot_status(spark, d):
    v = one_hot(ORDER_STATUS.of_labels(F.col("o_orderstatus")), 3)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), v.alias("v")).select("key", *(F.col("v")[k].alias(c) for k, c in enumerate("fop")))


@query(
    """SELECT lang, q AS quality, sum(w) AS weight FROM (
  SELECT lang, quality AS q, 1.0::DOUBLE AS w FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT lang, q, 0.5::DOUBLE FROM documents d ANTI JOIN labels USING (doc_id), (VALUES (0), (1)) v(q)) GROUP BY ALL"""
)
def soft_expand(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    quality = Variable("quality", (0, 1))
    cells = docs.select("lang", evidence.soft_cell(F.col("quality"), F.lit(None).cast("array<double>"), quality, [0.5, 0.5]).alias("quality"), F.lit(1.0).alias("weight"))
    return evidence.expand(cells, [quality], merge=True)


VECTOR = "SELECT l_orderkey AS key, l_linenumber AS ln, l_discount AS a, l_tax AS b, 0.25::DOUBLE AS c FROM lineitem"


def vectors(spark, d):
    v = F.array(F.col("l_discount"), F.col("l_tax"), F.lit(0.25))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("ln"), v.alias("v"), F.lit(1.0).alias("weight"))


@query(f"SELECT key, ln, round(a / (a + b + c), 9) AS a, round(b / (a + b + c), 9) AS b, round(c / (a + b + c), 9) AS c, round(a + b + c, 9) AS weight FROM ({VECTOR})")
def soft_normalise(spark, d):
    out = evidence.normalise(vectors(spark, d), [Variable("v", (0, 1, 2))])
    return out.select("key", "ln", *(F.round(F.col("v")[k], 9).alias(c) for k, c in enumerate("abc")), F.round("weight", 9).alias("weight"))


@query(f"SELECT key, ln, (CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END)::INTEGER AS v, round(a + b + c, 9) AS weight FROM ({VECTOR})")
def hard_argmax(spark, d):
    return evidence.harden(vectors(spark, d), [Variable("v", (0, 1, 2))]).select("key", "ln", "v", F.round("weight", 9).alias("weight"))


@query("SELECT d.doc_id, coalesce(quality, 2)::INTEGER AS quality, coalesce(toxic, 2)::INTEGER AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def builder_hard(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    none = F.lit(None).cast("array<double>")
    return docs.select("doc_id", *(evidence.hard_cell(F.col(c), none, 2).alias(c) for c in ("quality", "toxic")))


@query("SELECT round(sum(l_quantity * l_discount), 4) AS a, round(sum(l_quantity * l_tax), 4) AS b FROM lineitem")
def accumulate_compute(spark, d):
    rows = table(spark, d, "lineitem").withColumn("weight", F.col("l_quantity"))
    out = evidence.accumulate(rows, [F.col("l_discount"), F.col("l_tax")], ["a", "b"])
    return out.select(F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("SELECT l_orderkey AS key, l_linenumber AS ln, ((CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 2 + (CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END))::BIGINT AS place FROM lineitem")
def natural_key_index(spark, d):
    return items(spark, d).select("key", "ln", natural_index([FLAGS.of_labels(F.col("rf")), STATUS.of_labels(F.col("ls"))], [3, 2]).cast("long").alias("place"))


@query("SELECT p_partkey AS key, regexp_replace(p_type, '[^a-zA-Z0-9_]', '_', 'g') AS name FROM part")
def clean_names(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), clean_name(F.col("p_type")).alias("name"))


# ---------------------------------------------------------------- probability spaces


@query("SELECT coalesce(sum(CASE WHEN l_returnflag IN ('A', 'R') AND l_linestatus = 'F' THEN 1.0::DOUBLE END), 0) AS wmc FROM lineitem")
def wmc_or_within_and_across(spark, d):
    rows = items(spark, d).select(FLAGS.of_labels(F.col("rf")).alias("rf"), STATUS.of_labels(F.col("ls")).alias("ls"))
    return Space(ct.cross_table(rows, [FLAGS, STATUS])).wmc({"rf": (0, 2), "ls": (0,)})


def indexed(spark, d, *more):
    """Cross-table of state indexes of rf and ls."""
    rows = items(spark, d).select(FLAGS.of_labels(F.col("rf")).alias("rf"), STATUS.of_labels(F.col("ls")).alias("ls"), *more)
    return Space(ct.cross_table(rows, ["rf", "ls", *more]))


IX = "ix AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rf, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS ls, l_linenumber AS ln FROM lineitem)"


@query(f"WITH {IX} SELECT round(sum(CASE WHEN ls = 0 THEN 1.0 ELSE 0 END) / count(*), 9)::DOUBLE AS p FROM ix WHERE rf IN (1, 2)")
def cond_probability(spark, d):
    return indexed(spark, d).probability({"ls": 0}, {"rf": (1, 2)}).select(r9("p"))


@query(f"WITH {IX} SELECT ls::INTEGER AS ls, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS p FROM ix WHERE rf = 1 GROUP BY ls")
def marginal_ls_given_rf(spark, d):
    return indexed(spark, d).marginal(["ls"], {"rf": 1}).select("ls", r9("p"))


@query(
    "WITH j AS (SELECT l_returnflag AS rf, o_orderpriority AS op, count(*)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT rf, op, round(n / sum(n) OVER (), 9) AS p FROM j"
)
def joint_marginal(spark, d):
    joined = items(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("op")), "key")
    return Space(ct.cross_table(joined, ["rf", "op"])).marginal(["rf", "op"]).select("rf", "op", r9("p"))


@query(f"WITH {IX} SELECT rf::INTEGER AS rf, ln, round(n / z, 9) AS p FROM (SELECT rf, ln, count(*)::DOUBLE AS n, sum(count(*)) OVER () AS z FROM ix GROUP BY ALL) ORDER BY n DESC, rf, ln LIMIT 1")
def map_joint(spark, d):
    rows = items(spark, d).select(FLAGS.of_labels(F.col("rf")).alias("rf"), "ln")
    return Space(ct.cross_table(rows, ["rf", "ln"])).most_likely(["rf", "ln"]).select("rf", "ln", r9("p"))


@query(f"WITH {IX} SELECT round(corr(CASE WHEN rf = 1 THEN 1.0 ELSE 0 END, CASE WHEN ls = 1 THEN 1.0 ELSE 0 END), 9) AS correlation FROM ix")
def phi_correlation(spark, d):
    return indexed(spark, d).correlation(("rf", 1), ("ls", 1)).select(r9("correlation"))


@query(f"WITH {IX} SELECT round(corr(CASE WHEN rf = 1 THEN 1.0 ELSE 0 END, CASE WHEN ls = 1 THEN 1.0 ELSE 0 END), 9) AS correlation FROM ix WHERE ln IN (1, 2)")
def phi_correlation_conditioned(spark, d):
    return indexed(spark, d, "ln").correlation(("rf", 1), ("ls", 1), {"ln": (1, 2)}).select(r9("correlation"))


H = f"""WITH {IX}, pxy AS (SELECT rf AS x, ln AS y, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM ix {{where}} GROUP BY rf, ln),
px AS (SELECT x, sum(p) AS p FROM pxy GROUP BY x), py AS (SELECT y, sum(p) AS p FROM pxy GROUP BY y),
h AS (SELECT (SELECT -sum(p * log2(p)) FROM px) AS hx, (SELECT -sum(p * log2(p)) FROM py) AS hy, (SELECT -sum(p * log2(p)) FROM pxy) AS hxy),
m AS (SELECT *, hx + hy - hxy AS mi FROM h) """


def information(spark, d, cond=None):
    return indexed(spark, d, "ln").measures("rf", "ln", cond)


def measure(name: str, column: str, sql: str):
    def run(spark, d):
        return information(spark, d).select(r9(column))

    run.__name__ = name
    query(H.format(where="") + f"SELECT round({sql}, 9) + 0.0 AS {column} FROM m")(run)


measure("entropy", "entropy_x", "hx")
measure("joint_entropy", "joint_entropy", "hxy")
measure("cond_entropy", "conditional_entropy", "hxy - hy")
measure("mutual_info", "mutual_information", "mi")
measure("total_correlation", "total_correlation", "mi / least(hx, hy)")
measure("uncertainty", "uncertainty", "mi / hy")
measure("symmetric_uncertainty", "symmetric_uncertainty", "2 * mi / (hx + hy)")
measure("iqr", "iqr", "mi / hxy")
measure("cov_nmi", "covariant_nmi", "mi / sqrt(hx * hy)")


@query(H.format(where="WHERE ls = 1") + "SELECT round(hx, 9) + 0.0 AS entropy_x, round(mi, 9) + 0.0 AS mutual_information FROM m")
def measures_conditioned(spark, d):
    return information(spark, d, {"ls": 1}).select(r9("entropy_x"), r9("mutual_information"))


@query(f"WITH {IX} SELECT ls::INTEGER AS ls, round(p * log2(p), 9) AS plogp FROM (SELECT ls, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM ix GROUP BY ls)")
def plogp_terms(spark, d):
    return indexed(spark, d).marginal(["ls"]).select("ls", F.round(plogp(F.col("p")), 9).alias("plogp"))


# ---------------------------------------------------------------- divergences

TWO = f"{ITEMS}, p AS (SELECT ln, rf, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM items WHERE ls = 'F' GROUP BY ln, rf), q AS (SELECT ln, rf, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM items WHERE ls = 'O' GROUP BY ln, rf)"


def halves(spark, d, *by):
    rows = items(spark, d)
    return (Space(ct.cross_table(rows.where(F.col("ls") == s), by)) for s in "FO")


@query(f"WITH {TWO}, a AS (SELECT ln, sum(p) AS p FROM p GROUP BY ln), b AS (SELECT ln, sum(q) AS q FROM q GROUP BY ln) SELECT round(sum(p * log2(p / q)), 9) + 0.0 AS kl FROM a JOIN b USING (ln)")
def kl_f_vs_o(spark, d):
    return divergence.kl(*halves(spark, d, "ln"), ["ln"]).select(r9("kl"))


@query(f"WITH {TWO} SELECT round(sum(least(coalesce(p, 0), coalesce(q, 0))), 9) AS hi FROM p FULL JOIN q USING (ln, rf)")
def hi_f_vs_o(spark, d):
    return divergence.histogram_intersection(*halves(spark, d, "ln", "rf"), ["ln", "rf"]).select(r9("hi"))


@query(
    f"""WITH {TWO}, a AS (SELECT ln, sum(p) AS p FROM p GROUP BY ln), b AS (SELECT ln, sum(q) AS q FROM q GROUP BY ln),
j AS (SELECT ln, rf, coalesce(p.p, 0) AS p, coalesce(q.q, 0) AS q FROM p FULL JOIN q USING (ln, rf)),
t AS (SELECT sum(a.p * least(j.p / a.p, j.q / b.q)) AS v FROM j JOIN a USING (ln) JOIN b USING (ln)), u AS (SELECT sum(least(a.p, b.q)) AS v FROM a JOIN b USING (ln))
SELECT round((t.v + u.v) / 2, 9) AS fhi FROM t, u"""
)
def fhi_two_spaces(spark, d):
    return divergence.factored_histogram_intersection(*halves(spark, d, "ln", "rf"), {"rf": ["ln"], "ln": []}).select(r9("fhi"))


# ---------------------------------------------------------------- learning


@query(f"WITH {RFLS} SELECT rf, ls, round(weight / sum(weight) OVER (PARTITION BY ls), 9) AS w FROM t")
def cpt_ml(spark, d):
    return ct.conditional(counts(spark, d, "rf", "ls"), ["ls"]).select("rf", "ls", r9("w"))


@query(
    """WITH s AS (SELECT rf, ls, 1.0::DOUBLE AS w FROM range(3) a(rf), range(2) b(ls) UNION ALL
SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, 1.0 FROM lineitem)
SELECT rf::INTEGER AS rf, ls::INTEGER AS ls, round(sum(w) / sum(sum(w)) OVER (PARTITION BY ls), 9) AS w FROM s GROUP BY rf, ls"""
)
def cpt_dirichlet(spark, d):
    rows = items(spark, d).select(FLAGS.of_labels(F.col("rf")).alias("rf"), STATUS.of_labels(F.col("ls")).alias("ls"))
    return learning.cpt_table(rows, FLAGS, [STATUS], prior=1.0).select("rf", "ls", r9("w"))


STRUCTURE = {"seg": [], "op": ["seg"], "os": ["op"]}
HALVES = """so AS (SELECT (CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END)::INTEGER AS seg,
  (left(o_orderpriority, 1)::INTEGER - 1)::INTEGER AS op, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT seg, op, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM so WHERE st = 'F' GROUP BY seg, op),
q AS (SELECT seg, op, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM so WHERE st = 'O' GROUP BY seg, op)"""


def sold(spark, d):
    rows = sales(spark, d)
    return (Space(ct.cross_table(rows.where(F.col("os") == s), ["seg", "op"])) for s in (0, 1))


@query(
    f"""WITH {HALVES}, a AS (SELECT seg, sum(p) AS p FROM p GROUP BY seg), b AS (SELECT seg, sum(q) AS q FROM q GROUP BY seg),
t AS (SELECT p * log2(p / q) AS v FROM p JOIN q USING (seg, op) UNION ALL SELECT p * log2(p / q) FROM a JOIN b USING (seg)) SELECT round(sum(v), 9) + 0.0 AS pseudo_kl FROM t"""
)
def pseudo_kl_structure(spark, d):
    return divergence.pseudo_kl(*sold(spark, d), {"seg": [], "op": ["seg"]}).select(r9("pseudo_kl"))


@query(
    f"""WITH {HALVES}, a AS (SELECT seg, sum(p) AS p FROM p GROUP BY seg), b AS (SELECT seg, sum(q) AS q FROM q GROUP BY seg)
SELECT round(sum(p.p * log2((p.p / a.p) / (q.q / b.q))) + (SELECT sum(p * log2(p / q)) FROM a JOIN b USING (seg)), 9) + 0.0 AS pseudo_kl FROM p JOIN q USING (seg, op) JOIN a USING (seg) JOIN b USING (seg)"""
)
def conditional_kl_structure(spark, d):
    return divergence.pseudo_kl(*sold(spark, d), {"seg": [], "op": ["seg"]}, conditional=True).select(r9("pseudo_kl"))



def sales(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", PRIORITY.of_labels(F.col("o_orderpriority")).alias("op"), ORDER_STATUS.of_labels(F.col("o_orderstatus")).alias("os"))
    customers = table(spark, d, "customer").select("c_custkey", SEGMENT.of_labels(F.col("c_mktsegment")).alias("seg"))
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select("seg", "op", "os")


def chain(spark, d) -> Model:
    """A network of segment, priority and status learned from orders."""
    return learning.train(sales(spark, d), [SEGMENT, PRIORITY, ORDER_STATUS], STRUCTURE)


SALES = """sales AS (SELECT (CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END)::INTEGER AS seg,
  (left(o_orderpriority, 1)::INTEGER - 1)::INTEGER AS op, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::INTEGER AS os FROM orders JOIN customer ON o_custkey = c_custkey),
fs AS (SELECT seg, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM sales GROUP BY seg),
fo AS (SELECT op, seg, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY seg) AS w FROM sales GROUP BY op, seg),
ft AS (SELECT os, op, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY op) AS w FROM sales GROUP BY os, op),
full_ AS (SELECT seg, op, os, fs.w AS ws, fo.w AS wo, ft.w AS wt, fs.w * fo.w * ft.w AS w FROM fs JOIN fo USING (seg) JOIN ft USING (op))"""


@query(f"WITH {SALES} SELECT 'seg' AS child, seg AS state, -1 AS parent, round(w, 9) AS w FROM fs UNION ALL SELECT 'op', op, seg, round(w, 9) FROM fo UNION ALL SELECT 'os', os, op, round(w, 9) FROM ft")
def bn_train_chain(spark, d):
    model = chain(spark, d)
    parts = [f.table.select(F.lit(f.scope[0]).alias("child"), F.col(f.scope[0]).alias("state"), (F.col(f.scope[1]) if f.scope[1:] else F.lit(-1)).cast("int").alias("parent"), r9("w")) for f in model.factors]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"WITH {SALES}, n AS (SELECT seg, op, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY op) AS w FROM sales GROUP BY seg, op), m AS (SELECT op, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM sales GROUP BY op) SELECT 'seg' AS child, seg AS state, op AS parent, round(w, 9) AS w FROM n UNION ALL SELECT 'op', op, -1, round(w, 9) FROM m UNION ALL SELECT 'os', os, op, round(w, 9) FROM ft"
)
def network_from_crosstabs(spark, d):
    rows = sales(spark, d)
    model = learning.network_from_tables(spark, [ct.cross_table(rows, ["seg", "op"]), ct.cross_table(rows, ["op", "os"])], [SEGMENT, PRIORITY, ORDER_STATUS])
    parts = [f.table.select(F.lit(f.scope[0]).alias("child"), F.col(f.scope[0]).alias("state"), (F.col(f.scope[1]) if f.scope[1:] else F.lit(-1)).cast("int").alias("parent"), r9("w")) for f in model.factors]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {SALES} SELECT 'seg, op' AS scope, a, b, round(w, 6) AS w FROM (SELECT seg AS a, op AS b, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM sales GROUP BY seg, op)
UNION ALL SELECT 'op, os', a, b, round(w, 6) FROM (SELECT op AS a, os AS b, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM sales GROUP BY op, os)""")
def coalesce_crosstabs(spark, d):
    rows = sales(spark, d)
    out = learning.coalesce_tables([ct.cross_table(rows, ["seg", "op"]), ct.cross_table(rows, ["op", "os"])], [SEGMENT, PRIORITY, ORDER_STATUS], tolerance=1e-9)
    parts = [ct.project(out, list(s)).select(F.lit(f"{s[0]}, {s[1]}").alias("scope"), F.col(s[0]).alias("a"), F.col(s[1]).alias("b"), (F.round("weight", 6) + 0.0).alias("w")) for s in (("seg", "op"), ("op", "os"))]
    return parts[0].unionByName(parts[1])


def family_rows(model: Model) -> DataFrame:
    parts = [f.table.select(F.lit(f.scope[0]).alias("child"), F.col(f.scope[0]).alias("state"), (F.col(f.scope[1]) if f.scope[1:] else F.lit(-1)).cast("int").alias("parent"), r9("w")) for f in model.factors]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


for _method in ("first", "all"):  # either gives the conditional tables of the first table or of the mean; here one table has each family but that of op

    def _from_tables(spark, d, method=_method):
        rows = sales(spark, d)
        tables = [ct.cross_table(rows, ["seg", "op"]), ct.cross_table(rows.where("seg < 3"), ["op", "os"])]
        return family_rows(learning.network_from_tables(spark, tables, [SEGMENT, PRIORITY, ORDER_STATUS], method))

    Q[f"network_from_crosstabs_{_method}"] = _from_tables
    _op = "SELECT op, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM sales GROUP BY op"
    _half = "SELECT op, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM sales WHERE seg < 3 GROUP BY op"
    _op = _op if _method == "first" else f"SELECT op, sum(w) / 2 AS w FROM ({_op} UNION ALL {_half}) GROUP BY op"
    SQL[f"network_from_crosstabs_{_method}"] = f"""WITH {SALES}, n AS (SELECT seg, op, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY op) AS w FROM sales GROUP BY seg, op),
    m AS (SELECT os, op, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY op) AS w FROM sales WHERE seg < 3 GROUP BY os, op)
    SELECT 'seg' AS child, seg AS state, op AS parent, round(w, 9) AS w FROM n UNION ALL SELECT 'op', op, -1, round(w, 9) FROM ({_op}) UNION ALL SELECT 'os', os, op, round(w, 9) FROM m"""


# ---------------------------------------------------------------- inference


@query(f"WITH {SALES} SELECT os, round(sum(w), 9) AS p FROM full_ GROUP BY os")
def ve_marginal_chain(spark, d):
    return inference.marginal(chain(spark, d), ["os"]).select("os", r9("p"))


@query(f"WITH {SALES} SELECT round(sum(w), 9) AS wmc FROM full_ WHERE seg IN (0, 2) AND os = 1")
def ve_evidence(spark, d):
    return inference.wmc(chain(spark, d), {"seg": (0, 2), "os": 1}).select(r9("wmc"))


@query(f"WITH {SALES} SELECT round(sum(CASE WHEN seg IN (0, 1) THEN w END) / sum(w), 9) AS p FROM full_ WHERE os = 2")
def ve_probability(spark, d):
    return inference.probability(chain(spark, d), {"seg": (0, 1)}, {"os": 2}).select(r9("p"))


@query(f"WITH {SALES}, e AS (SELECT op, os, sum(w) AS wmc FROM full_ GROUP BY ALL) SELECT o_orderkey AS key, round(e.wmc, 9) AS wmc FROM orders JOIN e ON e.op = left(o_orderpriority, 1)::INTEGER - 1 AND e.os = CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END")
def batch_evidence(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), PRIORITY.of_labels(F.col("o_orderpriority")).alias("op"), ORDER_STATUS.of_labels(F.col("o_orderstatus")).alias("os"))
    return inference.batch_evidence(chain(spark, d), rows, ["op", "os"]).select("key", r9("wmc"))


@query(
    f"""WITH {SALES}, e AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE left(o_orderpriority, 1)::INTEGER - 1 END AS op, CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS os FROM orders),
s AS (SELECT key, f.seg, sum(f.w) AS w FROM e JOIN full_ f ON (e.op IS NULL OR e.op = f.op) AND (e.os IS NULL OR e.os = f.os) GROUP BY ALL) SELECT key, seg, round(w / sum(w) OVER (PARTITION BY key), 9) AS p FROM s"""
)
def batch_posterior(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("key"), F.when(key % 3 != 0, PRIORITY.of_labels(F.col("o_orderpriority"))).alias("op"), F.when(key % 2 != 0, ORDER_STATUS.of_labels(F.col("o_orderstatus"))).alias("os"))
    return inference.batch_evidence(chain(spark, d), rows, ["op", "os"], target="seg").select("key", "seg", r9("p"))


@query(f"WITH {SALES}, s AS (SELECT op, seg, sum(w) AS w FROM full_ GROUP BY op, seg), t AS (SELECT op, seg, w / sum(w) OVER (PARTITION BY op) AS p FROM s) SELECT o.op, t.seg, round(t.p, 9) AS p FROM (SELECT left(o_orderpriority, 1)::INTEGER - 1 AS op FROM orders) o JOIN t USING (op)")
def batch_posterior_repeated(spark, d):
    rows = table(spark, d, "orders").select(PRIORITY.of_labels(F.col("o_orderpriority")).alias("op"))  # few distinct rows, each many times
    return inference.batch_evidence(chain(spark, d), rows, ["op"], target="seg").select("op", "seg", r9("p"))


@query(f"WITH {SALES} SELECT op AS state, round(sum(w) / sum(sum(w)) OVER (), 9) AS p FROM full_ WHERE os = 2 GROUP BY op")
def target_marginals(spark, d):
    return inference.target_marginals(chain(spark, d), "op", {"os": 2, "op": 1}).select("state", r9("p"))


@query(f"WITH {SALES} SELECT op AS state, round(sum(w) / sum(sum(w)) OVER (), 9) AS p FROM full_ WHERE os = 2 GROUP BY op ORDER BY sum(w) DESC, op LIMIT 1")
def target_map(spark, d):
    return inference.target_map(chain(spark, d), "op", {"os": 2}).select("state", r9("p"))


@query(
    f"""WITH {SALES} SELECT 0 AS factor, [seg] AS states, round(sum(wo * wt), 9) AS d FROM full_ GROUP BY seg
UNION ALL SELECT 1, [op, seg], round(sum(ws * wt), 9) FROM full_ GROUP BY op, seg UNION ALL SELECT 2, [os, op], round(sum(ws * wo), 9) FROM full_ GROUP BY os, op"""
)
def gradients_all(spark, d):
    return inference.gradients(chain(spark, d)).select("factor", "states", r9("d"))


@query(f"WITH {SALES} SELECT round(sum(w), 9) AS wmc FROM full_ WHERE seg IN (0, 2) AND os = 1")
def wmc_enumerated(spark, d):
    return inference.wmc_by_enumeration(chain(spark, d), {"seg": (0, 2), "os": 1}).select(r9("wmc"))


@query(f"WITH {SALES} SELECT c_custkey AS key, round(sum(f.w * CASE f.seg WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0.125 END * CASE WHEN f.os = c_custkey % 3 THEN 1.0 ELSE 0.1 END), 9) AS wmc FROM customer, full_ f GROUP BY c_custkey")
def soft_evidence(spark, d):
    seg = F.array(*(F.lit(x) for x in (0.5, 0.25, 0.125, 0.125, 0.125)))
    os = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("c_custkey") % 3, 1.0).otherwise(0.1))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), seg.alias("seg"), os.alias("os"))
    return inference.soft_evidence(chain(spark, d), rows, ["seg", "os"], "key").select("key", r9("wmc"))


@query(f"WITH {SALES} SELECT 'seg' AS variable, seg AS state, round(sum(w), 9) AS p FROM full_ GROUP BY seg UNION ALL SELECT 'op', op, round(sum(w), 9) FROM full_ GROUP BY op UNION ALL SELECT 'os', os, round(sum(w), 9) FROM full_ GROUP BY os")
def jointree_marginals(spark, d):
    return inference.all_marginals(chain(spark, d)).select("variable", "state", r9("p"))


@query(f"WITH {SALES} SELECT seg, op, os, round(w, 9) AS w FROM full_ ORDER BY full_.w DESC, seg, op, os LIMIT 1")
def mpe_chain(spark, d):
    return inference.mpe(chain(spark, d)).select("seg", "op", "os", r9("w"))


@query(f"WITH {SALES} SELECT round(max(least(ws, wo, wt)), 9) AS wmc FROM full_")
def semiring_max_min(spark, d):
    return inference.wmc(chain(spark, d), ring=inference.SEMIRINGS["max_min"]).select(r9("wmc"))


@query(f"WITH {SALES} SELECT round(max(w), 9) AS wmc FROM full_")
def semiring_max_product(spark, d):
    return inference.wmc(chain(spark, d), ring=inference.SEMIRINGS["max_product"]).select(r9("wmc"))


@query(f"WITH {SALES} SELECT round(max(ln(ws) + ln(wo) + ln(wt)), 9) AS wmc FROM full_")
def semiring_max_sum(spark, d):
    return inference.wmc(mapped(chain(spark, d), F.log("w")), ring=inference.SEMIRINGS["max_sum"]).select(r9("wmc"))


@query(f"WITH {SALES} SELECT round(max(CASE WHEN ws > 0.2 THEN 0 ELSE ln(ws) END + CASE WHEN wo > 0.2 THEN 0 ELSE ln(wo) END + CASE WHEN wt > 0.2 THEN 0 ELSE ln(wt) END), 9) + 0.0 AS wmc FROM full_")
def semiring_max_sum_ones(spark, d):
    """Logarithms of 0, which is the one of this ring, among the weights."""
    return inference.wmc(mapped(chain(spark, d), F.when(F.col("w") > 0.2, 0.0).otherwise(F.log("w"))), ring=inference.SEMIRINGS["max_sum"]).select(r9("wmc"))


def mapped(model: Model, w) -> Model:
    return Model(model.variables, tuple(Factor(f.variables, f.table.withColumn("w", w)) for f in model.factors))


@query(f"WITH {SALES} SELECT bool_or(ws > 0.2 AND wo > 0.2 AND wt > 0.2) AS wmc FROM full_")
def semiring_bool(spark, d):
    model = chain(spark, d)
    parts = [(f.scope, f.table.withColumn("w", F.col("w") > 0.2)) for f in model.factors]
    _, out = inference.eliminate(parts, model.sizes, (), inference.SEMIRINGS["or_and"])
    return out.select(F.col("w").alias("wmc"))


@query(f"WITH {SALES} SELECT bit_xor((floor(ws * 1000)::BIGINT & 1) & (floor(wo * 1000)::BIGINT & 1) & (floor(wt * 1000)::BIGINT & 1)) AS wmc FROM full_")
def semiring_xor(spark, d):
    model = chain(spark, d)
    parts = [(f.scope, f.table.withColumn("w", F.floor(F.col("w") * 1000).cast("long").bitwiseAND(F.lit(1).cast("long")))) for f in model.factors]
    _, out = inference.eliminate(parts, model.sizes, (), inference.SEMIRINGS["xor_and"])
    return out.select(F.col("w").alias("wmc"))


@query(f"WITH {SALES} SELECT op, seg, round(sum(ws * wt), 9) AS d FROM full_ GROUP BY op, seg")
def gradient_param(spark, d):
    return inference.gradient(chain(spark, d), 1).select("op", "seg", r9("d"))


def blanket_sql() -> str:
    """A variable's neighbours are those that its conditional distribution depends on, given all others."""
    parts = []
    for v, others in {"seg": ("op", "os"), "op": ("seg", "os"), "os": ("seg", "op")}.items():
        for n, rest in (others, others[::-1]):
            p = f"SELECT *, w / sum(w) OVER (PARTITION BY {n}, {rest}) AS p FROM full_"
            parts.append(f"SELECT '{v}' AS variable, '{n}' AS neighbour FROM (SELECT max(p) - min(p) AS spread FROM ({p}) GROUP BY {v}, {rest}) HAVING max(spread) > 1e-9")
    return f"WITH {SALES} {' UNION ALL '.join(parts)}"


@query(blanket_sql())
def markov_blanket(spark, d):
    model = chain(spark, d)
    found = [(v.name, n) for v in model.variables for n in sorted(factors.markov_blanket(model, v.name))]
    return spark.createDataFrame(found, "variable string, neighbour string")


@query(f"WITH {SALES}, a AS (SELECT op, count(*)::DOUBLE AS w FROM sales WHERE seg = 0 GROUP BY op), b AS (SELECT os, op, count(*)::DOUBLE AS w FROM sales WHERE os = 2 GROUP BY ALL) SELECT os, op, w FROM b SEMI JOIN a USING (op)")
def preprune_semijoin(spark, d):
    rows = sales(spark, d)
    a = Factor((PRIORITY,), ct.cross_table(rows.where("seg = 0"), ["op"]).withColumnRenamed("weight", "w"))
    b = Factor((ORDER_STATUS, PRIORITY), ct.cross_table(rows.where("os = 2"), ["os", "op"]).withColumnRenamed("weight", "w"))
    return factors.reduce_rows([a, b])[1].table


# ---------------------------------------------------------------- factors

SPACE = "SELECT rf::INTEGER AS rf, ls::INTEGER AS ls FROM range(3) a(rf), range(2) b(ls)"


FLAG_CELLS = "SELECT rf, ls, count(*)::DOUBLE AS k FROM (SELECT (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INTEGER AS rf, (CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END)::INTEGER AS ls FROM lineitem) GROUP BY ALL"


def flag_cells(spark, d) -> DataFrame:
    """The line items' flags counted, as state indexes."""
    return ct.cross_table(items(spark, d).select(FLAGS.of_labels(F.col("rf")).alias("rf"), STATUS.of_labels(F.col("ls")).alias("ls")), ["rf", "ls"])


def times_flags(spark, d, factor: Factor) -> DataFrame:
    """A factor multiplied into the counts of the line items' flags."""
    scope, rows = inference.product((("rf", "ls"), flag_cells(spark, d).withColumnRenamed("weight", "w")), (factor.scope, factor.nonzero()))
    return rows.select(*factor.scope, "w")


@query(f"SELECT rf, ls, k AS w FROM ({FLAG_CELLS}) WHERE NOT rf IN (0, 2) OR ls = 0")
def factor_implies(spark, d):
    return times_flags(spark, d, factors.implies(spark, FLAGS, [0, 2], STATUS, [0]))


@query(f"SELECT rf, ls, k AS w FROM ({FLAG_CELLS}) WHERE (rf IN (0, 2)) = (ls = 0)")
def factor_equiv(spark, d):
    return times_flags(spark, d, factors.equivalent(spark, FLAGS, [0, 2], STATUS, [0]))


@query(f"SELECT rf, ls, k * 2.5 AS w FROM ({FLAG_CELLS}) WHERE rf = 1 OR ls = 1")
def factor_clause(spark, d):
    return times_flags(spark, d, factors.clause(spark, [FLAGS, STATUS], [1, 1], 2.5))


@query(f"SELECT (rf * ls)::INTEGER AS r, rf, ls, k AS w FROM ({FLAG_CELLS})")
def factor_functional(spark, d):
    return times_flags(spark, d, factors.functional(spark, Variable("r", (0, 1, 2)), [FLAGS, STATUS], lambda a, b: a * b))


@query(f"SELECT rf, ls, k * (0.5 + rf * 2 + ls)::DOUBLE AS w FROM ({FLAG_CELLS})")
def factor_dense(spark, d):
    return times_flags(spark, d, factors.dense(spark, [FLAGS, STATUS], [0.5 + k for k in range(6)]))


@query("SELECT l_returnflag AS rf, ln, w, dense_rank() OVER (ORDER BY w)::INTEGER - 1 AS param_id, count(*) OVER (PARTITION BY w) AS uses FROM (SELECT l_returnflag, l_linenumber AS ln, floor(count(*) / 500)::DOUBLE AS w FROM lineitem GROUP BY ALL) WHERE w <> 0")
def factor_compact(spark, d):
    t = counts(spark, d, "rf", "ln").select("rf", "ln", F.floor(F.col("weight") / 500).cast("double").alias("w"))
    return factors.compact(Factor((FLAGS, Variable("ln", tuple(range(8)))), t)).select("rf", "ln", "w", "param_id", "uses")


@query(f"WITH {ITEMS} SELECT ln, round(sum(w), 6) AS total FROM (SELECT rf, ln, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM items GROUP BY ALL) GROUP BY ln HAVING abs(sum(w) - 1) > 1e-6 AND abs(sum(w)) > 1e-6")
def cpt_check(spark, d):
    t = Space(counts(spark, d, "rf", "ln")).marginal(["rf", "ln"]).withColumnRenamed("p", "w")
    return factors.invalid_parents(Factor((FLAGS, Variable("ln", tuple(range(8)))), t)).select("ln", F.round("total", 6).alias("total"))


@query(f"SELECT rf, ls, (rf * 2 + ls)::BIGINT AS place, coalesce(k, 0)::DOUBLE AS weight FROM ({SPACE}) LEFT JOIN ({FLAG_CELLS}) USING (rf, ls)")
def state_space_order(spark, d):
    """Every instance of the flags with its place and the line items that have it, 0 where none has."""
    counted = state_space(spark, [FLAGS, STATUS], index="place").join(flag_cells(spark, d), ["rf", "ls"], "left")
    return counted.select("rf", "ls", "place", F.coalesce("weight", F.lit(0.0)).alias("weight"))


# ---------------------------------------------------------------- sampling

U = "((row * 1103515245 + 12345 + {k} * 777) % 2147483648) / 2147483648.0::DOUBLE"


def fixed(k: int):
    return uniform_of(F.col("row"), step=12345 + 777 * k)


@query(
    f"""WITH {ITEMS}, t AS (SELECT rf, ls, count(*)::DOUBLE AS w FROM items GROUP BY ALL), c AS (SELECT rf, ls, sum(w) OVER (ORDER BY rf, ls) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY rf, ls) - w) / sum(w) OVER () AS lo FROM t),
r AS (SELECT range AS row, {U.format(k=0)} AS u FROM range(1000)) SELECT row, rf, ls FROM r JOIN c ON u >= lo AND u < hi"""
)
def crosstab_sample(spark, d):
    return sampling.from_table(counts(spark, d, "rf", "ls"), 1000, draw=fixed)


@query(
    f"""WITH {SALES}, r AS (SELECT range AS row, {U.format(k=0)} AS u0, {U.format(k=1)} AS u1, {U.format(k=2)} AS u2 FROM range(1000)),
c0 AS (SELECT seg, sum(w) OVER (ORDER BY seg) AS hi, sum(w) OVER (ORDER BY seg) - w AS lo FROM fs),
c1 AS (SELECT op, seg, sum(w) OVER (PARTITION BY seg ORDER BY op) AS hi, sum(w) OVER (PARTITION BY seg ORDER BY op) - w AS lo FROM fo),
c2 AS (SELECT os, op, sum(w) OVER (PARTITION BY op ORDER BY os) AS hi, sum(w) OVER (PARTITION BY op ORDER BY os) - w AS lo FROM ft)
SELECT row, c0.seg, c1.op, c2.os FROM r JOIN c0 ON u0 >= c0.lo AND u0 < c0.hi JOIN c1 ON c1.seg = c0.seg AND u1 >= c1.lo AND u1 < c1.hi JOIN c2 ON c2.op = c1.op AND u2 >= c2.lo AND u2 < c2.hi"""
)
def forward_sample(spark, d):
    return sampling.forward(chain(spark, d), 1000, draw=fixed)


@query(f"SELECT row, (floor(u0 * 3))::INTEGER AS rf, (1 + 0 * floor(u1))::INTEGER AS ls FROM (SELECT row, {U.format(k=0)} AS u0, {U.format(k=1)} AS u1 FROM (SELECT o_orderkey AS row FROM orders))")
def uniform_sample(spark, d):
    """A sample for each order, by its key."""
    return sampling.uniform_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("row")), [FLAGS, STATUS], {"ls": 1}, fixed)


@query(
    f"""WITH {SALES}, r AS (SELECT range AS row, {U.format(k=0)} AS u0, {U.format(k=1)} AS u1 FROM range(1000)), g AS (SELECT seg, op, sum(w) AS w FROM full_ WHERE os = 1 GROUP BY ALL),
s AS (SELECT seg, sum(w) AS w FROM g GROUP BY seg), c0 AS (SELECT seg, sum(w) OVER (ORDER BY seg) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY seg) - w) / sum(w) OVER () AS lo FROM s),
c1 AS (SELECT op, seg, sum(w) OVER (PARTITION BY seg ORDER BY op) / sum(w) OVER (PARTITION BY seg) AS hi, (sum(w) OVER (PARTITION BY seg ORDER BY op) - w) / sum(w) OVER (PARTITION BY seg) AS lo FROM g)
SELECT row, c0.seg, c1.op FROM r JOIN c0 ON u0 >= c0.lo AND u0 < c0.hi JOIN c1 ON c1.seg = c0.seg AND u1 >= c1.lo AND u1 < c1.hi"""
)
def direct_sample(spark, d):
    return sampling.direct(chain(spark, d), 1000, ["seg", "op"], {"os": 1}, draw=fixed, order=["os", "op", "seg"])


@query(
    f"""WITH {SALES}, b AS (SELECT (SELECT max(w) FROM fs) * (SELECT max(w) FROM fo) * (SELECT max(w) FROM ft WHERE os = 1) AS top),
r AS (SELECT range AS row, floor({U.format(k=0).replace('row', 'range')} * 5)::INTEGER AS seg, floor({U.format(k=1).replace('row', 'range')} * 5)::INTEGER AS op, 1 AS os, {U.format(k=3).replace('row', 'range')} AS u FROM range(20000))
SELECT row, seg, op, os FROM r JOIN full_ USING (seg, op, os), b WHERE u * top < w ORDER BY row LIMIT 500"""
)
def rejection_sample(spark, d):
    return sampling.rejection(chain(spark, d), 500, {"os": 1}, draw=fixed)


def close_to_exact(spark, d, method: str, cond: dict | None) -> DataFrame:
    """Whether each marginal of the chains' states is within 0.03 of the exact one."""
    model = chain(spark, d)
    states = sampling.markov_chains(model, chains=64, length=300, method=method, cond=cond, skip=2)
    n = F.sum("k").over(Window.partitionBy("variable"))  # over the states of a variable
    long = states.select(F.inline(F.array(*(F.struct(F.lit(v.name).alias("variable"), F.col(v.name).alias("state")) for v in model.variables))))
    drawn = long.groupBy("variable", "state").agg(F.count(F.lit(1)).alias("k")).withColumn("share", F.col("k") / n)
    exact = inference.all_marginals(model, cond)
    return exact.join(drawn, ["variable", "state"], "left").select("variable", "state", (F.abs(F.coalesce("share", F.lit(0.0)) - F.col("p")) < 0.03).alias("near"))


@query("SELECT 'seg' AS variable, range::INTEGER AS state, true AS near FROM range(5) UNION ALL SELECT 'op', range::INTEGER, true FROM range(5) UNION ALL SELECT 'os', range::INTEGER, true FROM range(2)")
def gibbs_sample(spark, d):
    return close_to_exact(spark, d, "gibbs", {"os": (0, 1)})


@query("SELECT 'seg' AS variable, range::INTEGER AS state, true AS near FROM range(5) UNION ALL SELECT 'op', range::INTEGER, true FROM range(5) UNION ALL SELECT 'os', range::INTEGER, true FROM range(3)")
def metropolis_sample(spark, d):
    return close_to_exact(spark, d, "metropolis", None)


@query(
    f"""WITH {SALES}, pxy AS (SELECT seg, os, sum(w) AS p FROM full_ GROUP BY seg, os), px AS (SELECT seg, sum(p) AS p FROM pxy GROUP BY seg), py AS (SELECT os, sum(p) AS p FROM pxy GROUP BY os)
SELECT round((SELECT -sum(p * log2(p)) FROM pxy), 9) AS joint_entropy, round((SELECT -sum(p * log2(p)) FROM px), 9) AS entropy_x, round((SELECT -sum(p * log2(p)) FROM py), 9) AS entropy_y"""
)
def model_measures(spark, d):
    return inference.space(chain(spark, d), ["seg", "os"]).measures("seg", "os").select(r9("joint_entropy"), r9("entropy_x"), r9("entropy_y"))


# ---------------------------------------------------------------- streams


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*)::DOUBLE AS weight FROM events GROUP BY ALL")
def stream_crosstab_daily(spark, d):
    return streamed(spark, d, lambda s: running_daily(s), "complete")


def running_daily(stream: DataFrame) -> DataFrame:
    from marginalia.streaming.crosstabs import day, running

    return running(stream.withColumn("day", day(F.col("ts"))), ["day", "event_type"])


@query("SELECT event_type, round(sum(value), 4) AS weight FROM events GROUP BY ALL")
def stream_crosstab_weighted(spark, d):
    from marginalia.streaming.crosstabs import running

    return streamed(spark, d, lambda s: running(s, ["event_type"], "value"), "complete").select("event_type", F.round("weight", 4).alias("weight"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS \"end\", event_type, count(*)::DOUBLE AS weight FROM events GROUP BY ALL")
def stream_crosstab_windows(spark, d):
    from marginalia.streaming.crosstabs import windowed

    return streamed(spark, d, lambda s: windowed(s, ["event_type"], "ts", "6 hours"), "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    """WITH e AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, event_type, count(*)::DOUBLE AS weight FROM s GROUP BY user_id, event_type, k"""
)
def stream_sessions(spark, d):
    from marginalia.streaming.crosstabs import sessions

    return streamed(spark, d, lambda s: sessions(s, "user_id", ["event_type"], "ts", "2 hours"), "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT previous, state, count(*)::DOUBLE AS weight FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS previous, event_type AS state FROM events) WHERE previous IS NOT NULL GROUP BY ALL")
def stream_transitions(spark, d):
    from marginalia.streaming.crosstabs import transitions

    return ct.cross_table(streamed(spark, d, lambda s: transitions(s, "user_id", "event_type", "ts"), "append"), ["previous", "state"])


def streamed(spark: SparkSession, d: str, build, mode: str) -> DataFrame:
    """The result of a query over the events as a stream of what is there now, read from the table it wrote."""
    import uuid

    from marginalia.folders import shared_folder

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")

    q = build(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
