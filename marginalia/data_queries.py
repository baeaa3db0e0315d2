"""Registered queries of sources, data-set building, planners and example models, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import examples
from marginalia.catalog import Variable, variables_of
from marginalia.folders import shared_folder, written
from marginalia.functions.scalar import escape, instance_text
from marginalia.operators import building, evidence, factors, inference, learning
from marginalia.operators import crosstab as ct
from marginalia.operators.factors import Factor, Model
from marginalia.plans import elimination
from marginalia.queries import FLAGS, IX, ORDER_STATUS, PRIORITY, SALES, SEGMENT, SQL, STATUS, Q, chain, family_rows, items, query, r9, sales, table
from marginalia.sources import circuits, net, store, text

FAMILIES = f"WITH {SALES} SELECT 'seg' AS child, seg AS state, -1 AS parent, round(w, 9) AS w FROM fs UNION ALL SELECT 'op', op, seg, round(w, 9) FROM fo UNION ALL SELECT 'os', os, op, round(w, 9) FROM ft"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def states(spark: SparkSession, d: str) -> DataFrame:
    """State indexes of the priority and status of all orders, and a weight of 1 to 7."""
    orders = table(spark, d, "orders")
    return orders.select(PRIORITY.of_labels(F.col("o_orderpriority")).alias("op"), ORDER_STATUS.of_labels(F.col("o_orderstatus")).alias("os"), (F.col("o_orderkey") % 7 + 1).alias("n"))


def flags(spark: SparkSession, d: str) -> DataFrame:
    """State indexes of the flag and status of all line items, with weight 1."""
    return items(spark, d).select(FLAGS.of_labels(F.col("rf")).alias("rf"), STATUS.of_labels(F.col("ls")).alias("ls"), F.lit(1.0).alias("weight"))


# ---------------------------------------------------------------- sources

STATES = "st AS (SELECT (left(o_orderpriority, 1)::INTEGER - 1)::INTEGER AS op, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::INTEGER AS os, o_orderkey % 7 + 1 AS n FROM orders)"


@query(f"WITH {STATES} SELECT op, os, sum(n)::DOUBLE AS weight FROM st GROUP BY ALL")
def source_text_header(spark, d):
    """Columns by the names of a header, in another order, with a named weight."""
    path = new_path(spark, "text")
    states(spark, d).select("n", "os", "op").write.csv(path, header=True)
    return ct.cross_table(text.hard_dataset(spark, path, [PRIORITY, ORDER_STATUS], weights="n"), [PRIORITY, ORDER_STATUS], "weight")


@query(f"WITH {STATES} SELECT op, os, sum(n)::DOUBLE AS weight FROM st GROUP BY ALL")
def source_text_positions(spark, d):
    """Columns by place, split at white space, comments left out, the weight last."""
    path = new_path(spark, "text")
    states(spark, d).select(F.concat_ws("  ", "op", "os", "n", F.lit("# op os n"))).write.text(path)
    return ct.cross_table(text.hard_dataset(spark, path, [PRIORITY, ORDER_STATUS], sep=None, weights=-1), [PRIORITY, ORDER_STATUS], "weight")


@query(FAMILIES)
def source_net_round_trip(spark, d):
    path = new_path(spark, "net")
    net.write_net(spark, chain(spark, d), path)
    return family_rows(net.read_net(spark, path))


@query(FAMILIES)
def source_store_round_trip(spark, d):
    path = new_path(spark, "store")
    store.save(spark, chain(spark, d), path)
    return family_rows(store.load(spark, path))


def circuit(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A circuit of P(rf) P(ls) for indicators 1 to 5 and the learned parameters 6 to 10, written as text and read again, with its literal map."""
    nodes = ["c P(rf) P(ls)", "nnf 18 20 10", *(f"L {k}" for k in range(1, 11))]  # nodes 0 to 9
    nodes += [f"A 2 {k} {k + 5}" for k in range(5)]  # 10 to 14: an indicator and its parameter
    nodes += ["O 0 3 10 11 12", "O 0 2 13 14", "A 2 15 16", "%", "0"]
    path = new_path(spark, "nnf")
    spark.createDataFrame([(x,) for x in nodes], "value string").coalesce(1).write.text(path)
    literals = [f"cc$I${k + 1}$1.0$+${v.name}${s}" for k, (v, s) in enumerate((v, s) for v in (FLAGS, STATUS) for s in range(len(v)))]
    lines = spark.createDataFrame([(x,) for x in ["cc$K$kind", *literals]], "value string")
    rows = flags(spark, d)
    for name, first in (("rf", 6), ("ls", 9)):
        learned = ct.conditional(ct.cross_table(rows, [name]), [])
        lines = lines.unionByName(learned.select(F.concat(F.lit("cc$C$"), F.col(name) + first, F.lit("$"), "w", F.lit("$+")).alias("value")))
    lines.write.text(path + "-map")
    return circuits.read_nnf(spark, path), *circuits.read_literal_map(spark, path + "-map")


@query(f"WITH {IX}, n AS (SELECT count(*)::DOUBLE AS n FROM ix), p AS (SELECT rf, ls, count(*) AS k FROM ix GROUP BY ALL) SELECT round((SELECT sum(k) FROM p WHERE rf <> 0) / n * (SELECT sum(k) FROM p WHERE ls = 1) / n, 9) AS value FROM n")
def source_nnf_evaluate(spark, d):
    """The circuit's root for rf other than 0 and ls 1, with the parameters learned from the line items."""
    nodes, indicators, parameters = circuit(spark, d)
    met = ((F.col("variable") == "rf") & (F.col("state") != 0)) | ((F.col("variable") == "ls") & (F.col("state") == 1))
    values = parameters.unionByName(indicators.select("literal", F.when(met, 1.0).otherwise(0.0).alias("value")))
    return circuits.evaluate(nodes, values).where("node = 17").select(r9("value"))


@query(
    f"""WITH {IX}, n AS (SELECT count(*)::DOUBLE AS n FROM ix) SELECT (rf + 6)::INTEGER AS literal, NULL AS variable, NULL::INTEGER AS state, round(count(*) / any_value(n), 9) AS value FROM ix, n GROUP BY rf
UNION ALL SELECT (ls + 9)::INTEGER, NULL, NULL, round(count(*) / any_value(n), 9) FROM ix, n GROUP BY ls
UNION ALL SELECT * FROM (VALUES (1, 'rf', 0, NULL::DOUBLE), (2, 'rf', 1, NULL), (3, 'rf', 2, NULL), (4, 'ls', 0, NULL), (5, 'ls', 1, NULL)) v(literal, variable, state, value)"""
)
def source_literal_map(spark, d):
    """The map of a circuit whose parameters are learned from the line items."""
    _, indicators, parameters = circuit(spark, d)
    return indicators.unionByName(parameters, allowMissingColumns=True).select("literal", "variable", "state", r9("value"))


# ---------------------------------------------------------------- data sets

IXW = f"{IX}, f AS (SELECT rf::INTEGER AS rf, ls::INTEGER AS ls FROM ix)"


@query(f"WITH {IXW} SELECT rf, ls, count(*)::DOUBLE AS weight FROM (SELECT rf, ls FROM f UNION ALL SELECT rf, NULL FROM f) GROUP BY ALL")
def dataset_append_dataset(spark, d):
    """The second data set lacks ls, and its further column is left out."""
    rows = flags(spark, d)
    other = rows.select("rf", "weight", F.col("ls").alias("other"))
    return ct.cross_table(building.append_dataset(rows, other, [FLAGS, STATUS]), ["rf", "ls"], "weight")


@query(f"WITH {IXW} SELECT rf, ls, sum(w)::DOUBLE AS weight FROM (SELECT rf, ls, 1.0 AS w FROM f UNION ALL SELECT * FROM (VALUES (0, 1, 2.5), (2, NULL, 2.5)) v(rf, ls, w)) GROUP BY ALL")
def dataset_append_records(spark, d):
    return ct.cross_table(building.append(flags(spark, d), [(0, 1), (2, None)], [FLAGS, STATUS], weight=2.5), ["rf", "ls"], "weight")


@query("SELECT CASE WHEN o_orderkey >= 10 THEN o_orderkey + 2 ELSE o_orderkey END AS place, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::INTEGER AS os, 1.0::DOUBLE AS weight FROM orders UNION ALL SELECT * FROM (VALUES (10, 2, 1.0), (11, NULL, 1.0)) v(a, b, c)")
def dataset_insert_records(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), ORDER_STATUS.of_labels(F.col("o_orderstatus")).alias("os"), F.lit(1.0).alias("weight"))
    return building.insert(orders, "place", 10, [(2,), (None,)], [ORDER_STATUS])


@query("SELECT line, count(*) AS n FROM (SELECT l_returnflag || ', ' || CASE WHEN l_linenumber = 1 THEN '?' ELSE l_linestatus END || ', x 1.0' AS line FROM lineitem) GROUP BY line")
def dataset_dump(spark, d):
    rows = items(spark, d).select(FLAGS.of_labels(F.col("rf")).alias("rf"), F.when(F.col("ln") != 1, STATUS.of_labels(F.col("ls"))).alias("ls"), F.lit(1.0).alias("weight"))
    return building.dump(rows, [FLAGS, STATUS]).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {IXW} SELECT rf, ls, NULL::INTEGER AS seg, count(*) AS n FROM f GROUP BY ALL")
def dataset_columns(spark, d):
    """A column from states, one from checked indexes, one of missing cells; a column put in and taken out again."""
    base = items(spark, d).select(F.col("rf").alias("flag"), STATUS.of_labels(F.col("ls")).alias("status"))
    rows = building.with_indexes(building.with_labels(base, FLAGS, F.col("flag")), STATUS, F.col("status"))
    rows = building.delete_columns(building.new_columns(building.ensure_columns(rows, [FLAGS, SEGMENT]), [PRIORITY]), [PRIORITY])
    return rows.groupBy("rf", "ls", "seg").agg(F.count(F.lit(1)).alias("n"))


VALUES = "SELECT l_orderkey AS key, l_linenumber AS ln, l_discount AS a, l_tax AS b FROM lineitem"


@query(f"SELECT round(sum(CASE WHEN ln = 1 THEN 0 ELSE a END), 6) AS a, round(sum(CASE WHEN ln = 1 THEN 1 ELSE b END), 6) AS b FROM ({VALUES})")
def dataset_soft_cells(spark, d):
    """Vectors of weights where given, else a hard state as a vector."""
    v = Variable("v", (0, 1))
    hard, soft = evidence.checked_cell(F.when(F.col("l_linenumber") == 1, 1), F.when(F.col("l_linenumber") != 1, F.array("l_discount", "l_tax")), v)
    rows = building.with_weights(table(spark, d, "lineitem"), v, evidence.soft_cell(hard, soft, v))
    return rows.agg(*(F.round(F.sum(F.col("v")[k]), 6).alias(c) for k, c in enumerate("ab")))


@query(f"WITH {IXW} SELECT rf, (ls = 0)::INTEGER::DOUBLE AS a, (ls = 1)::INTEGER::DOUBLE AS b, count(*)::DOUBLE AS weight FROM f GROUP BY ALL")
def dataset_soften(spark, d):
    soft = evidence.soften(flags(spark, d), [STATUS])
    return ct.cross_table(soft.select("rf", F.col("ls")[0].alias("a"), F.col("ls")[1].alias("b"), "weight"), ["rf", "a", "b"], "weight")


@query("SELECT 'l_returnflag' AS variable, row_number() OVER (ORDER BY s)::INTEGER - 1 AS state, s AS label FROM (SELECT DISTINCT l_returnflag AS s FROM lineitem) UNION ALL SELECT 'l_linenumber', row_number() OVER (ORDER BY s)::INTEGER - 1, s::VARCHAR FROM (SELECT DISTINCT l_linenumber AS s FROM lineitem)")
def variables_from_data(spark, d):
    found = variables_of(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"])
    return spark.createDataFrame([(v.name, k, str(s)) for v in found for k, s in enumerate(v.states)], "variable string, state int, label string")


@query(
    f"""WITH {IXW}, a AS (SELECT rf, ls, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT rf, ls, sum(n) AS n FROM (SELECT 1 AS x, ls, rf, count(*) AS n FROM f GROUP BY ALL) GROUP BY ALL)
SELECT NOT EXISTS (FROM a FULL JOIN b USING (rf, ls) WHERE a.n IS DISTINCT FROM b.n) AS equal, NOT EXISTS (FROM a FULL JOIN b USING (rf, ls) WHERE a.n IS DISTINCT FROM 2 * b.n) AS other"""
)
def crosstab_equality(spark, d):
    rows = flags(spark, d)
    a, b = ct.cross_table(rows, ["rf", "ls"]), ct.project(ct.cross_table(rows.withColumn("x", F.lit(1)), ["x", "ls", "rf"]), ["ls", "rf"])
    return spark.createDataFrame([(ct.same(a, b), ct.same(a, ct.scale(b, 2)))], "equal boolean, other boolean")


@query("SELECT doc_id, 'lang=' || lang || ', source=' || source AS instance, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS escaped FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def rendered_text(spark, d):
    docs = table(spark, d, "documents").where("lang is not null and source is not null")
    return docs.select("doc_id", instance_text(["lang", "source"], [F.col("lang"), F.col("source")]).alias("instance"), escape(F.col("text")).alias("escaped"))


# ---------------------------------------------------------------- factors and models


@query(f"WITH {SALES} SELECT round(sum(log2(f.w)), 3) AS log2_likelihood FROM sales s JOIN full_ f USING (seg, op, os)")
def model_log_likelihood(spark, d):
    return learning.log_likelihood(chain(spark, d), sales(spark, d)).select(F.round("log2_likelihood", 3).alias("log2_likelihood"))


@query(f"WITH {SALES} SELECT round(w, 9) AS wmc FROM full_ WHERE seg = 1 AND op = 2 AND os = 0")
def model_value_of_instance(spark, d):
    return inference.value_of(chain(spark, d), {"seg": 1, "op": 2, "os": 0}).select(r9("wmc"))


@query(f"WITH {IXW}, c AS (SELECT rf, ls, count(*)::DOUBLE AS k FROM f GROUP BY ALL) SELECT 'cpt' AS kind, rf, ls, round(k / sum(k) OVER (PARTITION BY ls), 9) AS w FROM c UNION ALL SELECT 'all', rf, ls, round(k / sum(k) OVER (), 9) FROM c UNION ALL SELECT 'constant', a.range::INTEGER, b.range::INTEGER, 0.5 FROM range(3) a, range(2) b")
def factor_normalised(spark, d):
    """A table by its parents' sums, by the sum of all, and a constant over the state space."""
    f = Factor((FLAGS, STATUS), ct.cross_table(flags(spark, d), ["rf", "ls"]).withColumnRenamed("weight", "w"))
    kinds = {"cpt": factors.cpt(f), "all": factors.normalised(f, []), "constant": factors.filled(spark, [FLAGS, STATUS], F.lit(0.5))}
    parts = [g.table.select(F.lit(k).alias("kind"), "rf", "ls", r9("w")) for k, g in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""WITH {SALES}, sums AS (SELECT sum(w) AS s FROM fs UNION ALL SELECT sum(w) FROM fo GROUP BY seg UNION ALL SELECT sum(w) FROM ft GROUP BY op)
SELECT bool_and(abs(s - 1) < 1e-6) AS learned, true AS structure, bool_and(abs(2 * s - 1) < 1e-6) AS scaled, false AS cyclic FROM sums"""
)
def network_checks(spark, d):
    model = chain(spark, d)
    scaled = Model(model.variables, tuple(Factor(f.variables, f.table.withColumn("w", F.col("w") * 2)) for f in model.factors))
    cyclic = Model((FLAGS, STATUS), (factors.filled(spark, [FLAGS, STATUS], F.lit(0.5)), factors.filled(spark, [STATUS, FLAGS], F.lit(0.5))))
    found = (factors.is_bayesian(model), factors.structure_is_bayesian(scaled), factors.is_bayesian(scaled), factors.structure_is_bayesian(cyclic))
    return spark.createDataFrame([found], "learned boolean, structure boolean, scaled boolean, cyclic boolean")


@query("SELECT op, os, sum(p)::DOUBLE AS weight FROM (SELECT left(o_orderpriority, 1)::INTEGER - 1 AS k, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::INTEGER AS os FROM orders) o JOIN (VALUES (0, 0, 1.0), (1, 0, 0.5), (1, 1, 0.5), (2, 2, 1.0), (3, 3, 1.0), (4, 3, 0.25), (4, 4, 0.75)) v(k, op, p) USING (k) GROUP BY ALL")
def network_from_soft_data(spark, d):
    """Counts of one family from soft evidence, by the counts that training on it uses."""
    rows = states(spark, d).select("os", soft_priority().alias("op"), F.lit(1.0).alias("weight"))
    return learning.network_counts(evidence.expand(rows, [PRIORITY]), {"op": ["os"]}, "weight").select("op", "os", "weight")


def soft_priority():
    """The second and the last priority partly as the one before."""
    share = {1: (0, 0.5), 4: (3, 0.25)}
    vectors = [[1.0 - share.get(k, (0, 0.0))[1] if s == k else share[k][1] if k in share and s == share[k][0] else 0.0 for s in range(5)] for k in range(5)]
    return F.element_at(F.array(*(F.array(*map(F.lit, v)) for v in vectors)), F.col("op") + 1)


# ---------------------------------------------------------------- planners


@query(f"WITH {SALES} SELECT planner, prefix, (SELECT round(sum(w), 9) FROM full_ WHERE seg IN (0, 2) AND os = 1) AS wmc FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in ['best', *elimination.PLANNERS])}) p(planner), (VALUES ('none'), ('twig'), ('optimal')) x(prefix)")
def planners(spark, d):
    """The same weight by the order of every planner, after every prefix; equal orders are worked out once."""
    model, found = chain(spark, d), {}
    for planner in ["best", *elimination.PLANNERS]:
        for prefix in (None, "twig", "optimal"):
            order = tuple(elimination.planned([f.scope for f in model.factors], model.sizes, planner, prefix))
            found.setdefault(order, []).append((planner, prefix or "none"))
    out = None
    for order, named in found.items():
        one = inference.wmc(model, {"seg": (0, 2), "os": 1}, order=list(order)).crossJoin(F.broadcast(spark.createDataFrame(named, "planner string, prefix string"))).select("planner", "prefix", r9("wmc"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- example models


def network_sql(name: str) -> str:
    """The network's tables as values, joined, and summed by variable; then the first variable's expected counts over the orders."""
    variables, tables = examples.NETWORKS[name]
    size = {n: len(s) for n, s in variables.items()}
    place = {n: k for k, n in enumerate(variables)}
    parts = []
    for k, (scope, values) in enumerate(tables):
        rows, stride = [], {}
        step = 1
        for n in reversed(scope):
            stride[n], step = step, step * size[n]
        for i, w in enumerate(values):
            rows.append(f"({', '.join(str(i // stride[n] % size[n]) for n in scope)}, {w}::DOUBLE)")
        parts.append(f"t{k}({', '.join(f'v{place[n]}' for n in scope)}, w{k}) AS (VALUES {', '.join(rows)})")
    parts.append(f"space AS (SELECT {', '.join(f'r{k}.range AS v{k}' for k in range(len(size)))} FROM {', '.join(f'range({m}) r{k}' for k, m in enumerate(size.values()))})")
    joins = " ".join(f"JOIN t{k} USING ({', '.join(f'v{place[n]}' for n in scope)})" for k, (scope, _) in enumerate(tables))
    weight = " * ".join(f"w{k}" for k in range(len(tables)))
    sums = " UNION ALL ".join(f"SELECT '{n}' AS variable, v{k}::INTEGER AS state, round(sum(w), 9) AS p FROM j GROUP BY v{k}" for n, k in place.items())
    seen = len(size) - 1  # the last variable is observed, by the key of each order
    observed = f"SELECT o_orderkey % {list(size.values())[seen]} AS s, count(*)::DOUBLE AS n FROM orders GROUP BY ALL"
    pairs = f"SELECT v0 AS state, v{seen} AS s, sum(w) AS w FROM j GROUP BY ALL"
    expected = f"SELECT 'expected' AS variable, state::INTEGER AS state, round(sum(n * p), 6) AS p FROM (SELECT state, s, w / sum(w) OVER (PARTITION BY s) AS p FROM ({pairs})) JOIN ({observed}) USING (s) GROUP BY state"
    sums = f"{sums} UNION ALL {expected}"
    return f"WITH {', '.join(parts)}, j AS (SELECT space.*, {weight} AS w FROM space {joins}) {sums}"


for _name in ("sprinkler", "asia", "student", "rain", "cancer", "earthquake", "survey"):

    def _marginals(spark, d, name=_name):
        model = examples.network(spark, name)
        first, last = model.variables[0], model.variables[-1]
        evidence_rows = table(spark, d, "orders").select((F.col("o_orderkey") % len(last)).cast("int").alias(last.name))
        scored = inference.batch_evidence(model, evidence_rows, [last.name], target=first.name).groupBy(F.col(first.name).alias("state")).agg(F.sum("p").alias("p"))
        expected = scored.select(F.lit("expected").alias("variable"), "state", F.round("p", 6).alias("p"))
        return inference.all_marginals(model).select("variable", "state", r9("p")).unionByName(expected)

    Q[f"example_{_name}"], SQL[f"example_{_name}"] = _marginals, network_sql(_name)


def graph_sql(scopes: list[tuple[str, ...]], names: list[str], states_: int) -> str:
    """Instances of a graph whose neighbours all differ, by enumeration, and the share of them where every variable goes by the orders' states."""
    shares = "s AS (SELECT (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::INTEGER AS state, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM orders GROUP BY 1)"
    ranges = ", ".join(f"(SELECT range AS {n}, coalesce(p, 0) AS p_{n} FROM range({states_}) LEFT JOIN s ON state = range) r_{n}" for n in names)
    return f"WITH {shares} SELECT count(*)::DOUBLE AS wmc, round(sum({' * '.join(f'p_{n}' for n in names)}), 9) AS p FROM {ranges} WHERE {' AND '.join(f'{a} <> {b}' for a, b in scopes)}"


for _name, _edges in examples.GRAPHS.items():
    _scopes = [tuple(e) for e in _edges.split()]
    _names = sorted({v for e in _scopes for v in e})

    def _colourings(spark, d, scopes=_scopes, names=_names):
        model = examples.from_scopes(spark, dict.fromkeys(names, 3), scopes, weight=lambda k: F.when(F.col(scopes[k][0]) != F.col(scopes[k][1]), 1.0).otherwise(0.0))
        status = table(spark, d, "orders").select(ORDER_STATUS.of_labels(F.col("o_orderstatus")).alias("os"))
        share = written(ct.conditional(ct.cross_table(status, ["os"]), []), "share")  # a row for each state
        drawn = tuple(Factor((v,), share.select(F.col("os").alias(v.name), "w")) for v in model.variables)
        p = inference.wmc(Model(model.variables, (*model.factors, *drawn))).select(r9("wmc").alias("p"))
        return inference.wmc(model).crossJoin(F.broadcast(p))  # one row each

    Q[f"example_{_name}"], SQL[f"example_{_name}"] = _colourings, graph_sql(_scopes, _names, 3)
