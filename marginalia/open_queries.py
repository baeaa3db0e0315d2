"""Registered queries of scripts, network builders, spaces over samples and models, planners of one's own, permutations and mixed data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.data_queries import FAMILIES, STATES, new_path, soft_priority, states
from marginalia.folders import written
from marginalia.operators import evidence, inference, shuffles
from marginalia.operators.factors import Factor, Model
from marginalia.operators.space import SampleSpace
from marginalia.queries import ORDER_STATUS, PRIORITY, SALES, SEGMENT, U, chain, family_rows, fixed, query, r9, table
from marginalia.sources import net, scripts

# ---------------------------------------------------------------- scripts and builders


def blocks(lines: DataFrame, head: str, body: str) -> DataFrame:
    """The lines of the form ``body`` with ``head``, the part of the nearest line above that starts a table, and their place ``b``."""
    lines = written(lines, "script").select("place.*", "value")
    heads = lines.withColumn("head", F.regexp_extract("value", head, 1)).where("head <> ''").select((F.col("a") + 1).alias("a"), "head", F.col("value").alias("above"))
    return lines.where(F.col("value").rlike(body)).join(F.broadcast(heads), "a")  # a line for each variable


@query(FAMILIES)
def script_bugs(spark, d):
    """The tables of a BUGS model, taken from its lines again."""
    rows = blocks(scripts.bugs_lines(spark, chain(spark, d)), r"^\s*p\.(\w+) = ", r"^\s+[\d.]")
    values = rows.select("head", F.when(F.col("above").contains("structure"), F.col("b")).otherwise(-1).cast("int").alias("parent"), F.posexplode(F.split(F.regexp_replace(F.trim("value"), ",$", ""), ",")).alias("state", "w"))
    return values.select(F.col("head").alias("child"), "state", "parent", F.round(F.col("w").cast("double"), 9).alias("w")).where("w > 0")


def label(v, column: str) -> str:
    return f"(CASE {column} {' '.join(f'WHEN {k} THEN {chr(39)}{s}{chr(39)}' for k, s in enumerate(v.states))} END)"


@query(
    f"WITH {SALES} SELECT 'd0' AS name, [{label(SEGMENT, 'seg')}] AS states, round(w, 9) AS w FROM fs UNION ALL SELECT 'd1', [{label(SEGMENT, 'seg')}, {label(PRIORITY, 'op')}], round(w, 9) FROM fo UNION ALL SELECT 'd2', [{label(PRIORITY, 'op')}, {label(ORDER_STATUS, 'os')}], round(w, 9) FROM ft"
)
def script_pomegranate(spark, d):
    """The instances in a script of distributions, by the labels of their states."""
    rows = blocks(scripts.pomegranate_lines(spark, chain(spark, d)), r"^(d\d+) = ", r"^    [\['].*,$")
    quoted, number = F.lit("'([^']*)'"), r"([-\d.E]+)\]?,$"
    return rows.select(F.col("head").alias("name"), F.regexp_extract_all("value", quoted, F.lit(1)).alias("states"), F.round(F.regexp_extract("value", number, 1).cast("double"), 9).alias("w")).where("w > 0")


@query(FAMILIES)
def script_python(spark, d):
    """The rows in a script that builds the model again."""
    rows = blocks(scripts.python_lines(spark, chain(spark, d)), r"^    (f\d+) = ", r"^        \(")
    numbers = F.regexp_extract_all(F.regexp_extract("value", r"\((.*)\):", 1), F.lit(r"\d+"), F.lit(0)).cast("array<int>")
    child = F.element_at(F.array(*map(F.lit, ("seg", "op", "os"))), F.substring("head", 2, 9).cast("int") + 1)
    w = F.round(F.regexp_extract("value", r": (.*),$", 1).cast("double"), 9)
    return rows.select(child.alias("child"), numbers[0].alias("state"), F.coalesce(F.try_element_at(numbers, F.lit(2)), F.lit(-1)).alias("parent"), w.alias("w"))


@query(f"WITH f AS ({FAMILIES}) SELECT flavour, child, state, parent, round(w * CASE flavour WHEN 'cpt' THEN 1 ELSE 4 END, 7) AS w FROM f, (VALUES ('dense'), ('sparse'), ('cpt'), ('compact')) v(flavour)")
def source_net_flavours(spark, d):
    """A file of tables four times too large, read by each kind of builder; conditional tables are normalised again."""
    model = chain(spark, d)
    large = Model(model.variables, tuple(Factor(f.variables, f.table.withColumn("w", F.col("w") * 4)) for f in model.factors))
    path, out = new_path(spark, "net"), None
    net.write_net(spark, large, path)
    for flavour in ("dense", "sparse", "cpt", "compact"):
        one = family_rows(net.read_net(spark, path, net.ModelBuilder(flavour))).where("w > 0").select(F.lit(flavour).alias("flavour"), "child", "state", "parent", F.round("w", 7).alias("w"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- spaces and planners


@query(
    f"""WITH {STATES}, c AS (SELECT op, count(*)::DOUBLE AS n FROM st WHERE os IN (0, 1) GROUP BY op)
SELECT sum(n) AS wmc, round(sum(n) FILTER (op IN (0, 3)) / sum(n), 9) AS p, (SELECT round(-sum(n / z * log2(n / z)), 9) FROM c, (SELECT sum(n) AS z FROM c)) AS entropy FROM c"""
)
def sample_space(spark, d):
    """All orders as samples: a filtered count, a probability and an entropy."""
    space, cond = SampleSpace(states(spark, d), [PRIORITY, ORDER_STATUS]), {"os": (0, 1)}
    parts = (space.wmc(cond), space.probability({"op": (0, 3)}, cond).select(r9("p")), space.entropy("op", cond).select(r9("entropy")))
    return parts[0].join(parts[1]).join(parts[2])  # one row each


@query(
    f"""WITH {SALES}, pxy AS (SELECT seg, os, sum(w) / sum(sum(w)) OVER () AS p FROM full_ WHERE op IN (0, 2) GROUP BY seg, os), px AS (SELECT seg, sum(p) AS p FROM pxy GROUP BY seg), py AS (SELECT os, sum(p) AS p FROM pxy GROUP BY os)
SELECT round((SELECT -sum(p * log2(p)) FROM pxy), 9) AS joint_entropy, round((SELECT -sum(p * log2(p)) FROM px), 9) AS entropy_x, round((SELECT -sum(p * log2(p)) FROM py), 9) AS entropy_y"""
)
def model_space(spark, d):
    """Measures of two variables of a model under a condition on a third, which the space does not keep."""
    space = inference.ModelSpace(chain(spark, d), ["seg", "os"])
    return space.measures("seg", "os", {"op": (0, 2)}).select(r9("joint_entropy"), r9("entropy_x"), r9("entropy_y"))


def by_name_backwards(scopes, sizes, keep=()):
    return sorted({v for s in scopes for v in s} - set(keep), reverse=True)


@query(f"WITH {SALES} SELECT round(sum(w), 9) AS wmc FROM full_ WHERE seg IN (0, 2) AND os = 1")
def planner_of_ones_own(spark, d):
    return inference.wmc(chain(spark, d), {"seg": (0, 2), "os": 1}, order=by_name_backwards).select(r9("wmc"))


# ---------------------------------------------------------------- hard and soft data, permutations


SHARES = "(VALUES (0, 0, 1.0), (1, 0, 0.5), (1, 1, 0.5), (2, 2, 1.0), (3, 3, 1.0), (4, 3, 0.25), (4, 4, 0.75)) v(k, op, p)"


@query(
    f"""WITH {STATES}, space AS (SELECT a.range::INTEGER AS op, b.range::INTEGER AS os, 0.5 AS w FROM range(5) a, range(3) b)
SELECT 'hard' AS kind, op, os, sum(w)::DOUBLE AS weight FROM (SELECT op, os, n AS w FROM st UNION ALL FROM space) GROUP BY ALL
UNION ALL SELECT 'soft', op, os, sum(w)::DOUBLE FROM (SELECT v.op, os, n * p AS w FROM st JOIN {SHARES} ON k = st.op UNION ALL FROM space) GROUP BY ALL"""
)
def crosstab_hard_or_soft(spark, d):
    """One call for states and for vectors of the first variable, with a prior."""
    rows, variables = states(spark, d), [PRIORITY, ORDER_STATUS]
    kinds = {"hard": rows, "soft": rows.withColumn("op", soft_priority())}
    hard, soft = (evidence.cross_table_of(r, variables, "n", prior=0.5).select(F.lit(k).alias("kind"), "op", "os", "weight") for k, r in kinds.items())
    return hard.unionByName(soft)


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {U.replace('row', 'o_orderkey').format(k=0)}, o_orderkey) - 1 AS place FROM orders")
def permuted_orders(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("row"))
    return shuffles.permuted(rows, ["o_orderkey"], fixed(0)).select("o_orderkey", "place")


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM customer), u AS (SELECT o_orderkey, n, floor({U.replace('row', 'o_orderkey').format(k=0)} * n)::BIGINT AS first, floor({U.replace('row', 'o_orderkey').format(k=1)} * (n - 1))::BIGINT AS other FROM orders, n)
SELECT o_orderkey, first, other + CASE WHEN other >= first THEN 1 ELSE 0 END AS second FROM u"""
)
def distinct_pairs(spark, d):
    """Two different customers' numbers for each order."""
    n = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("row")).crossJoin(F.broadcast(n))  # n is one row
    first, second = shuffles.distinct_pair(F.col("n"), fixed)
    return rows.select("o_orderkey", first.alias("first"), second.alias("second"))
