"""Registered queries on derivatives, chains, ordered streams, kept counts and least squares, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import Variable
from marginalia.folders import shared_folder, written
from marginalia.operators import crosstab as ct
from marginalia.operators import factors, inference, learning, sampling
from marginalia.operators.factors import Model
from marginalia.queries import ORDER_STATUS, PRIORITY, SALES, SEGMENT, SQL, U, chain, fixed, query, r9, sales, table

KINDS = ("click", "error", "purchase", "signup", "view")
EVENT, BEFORE, HOUR, BAND = (Variable(n, s) for n, s in (("kind", KINDS), ("before", KINDS), ("hour", tuple(range(24))), ("band", (0, 1, 2, 3))))
KIND_SQL = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
EVENTS_SQL = f"""ev AS (SELECT {KIND_SQL}::INTEGER AS kind, lag({KIND_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS before,
  hour(ts)::INTEGER AS hour, (CASE WHEN value < 5 THEN 0 WHEN value < 15 THEN 1 WHEN value < 50 THEN 2 ELSE 3 END)::INTEGER AS band FROM events)"""


def steps_of_users(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    kind = EVENT.of_labels(F.col("event_type"))
    band = F.when(F.col("value") < 5, 0).when(F.col("value") < 15, 1).when(F.col("value") < 50, 2).otherwise(3)
    before = F.lag(kind).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").select(kind.alias("kind"), before.alias("before"), F.hour("ts").alias("hour"), band.alias("band"))
    return rows.where(F.col("before").isNotNull())


def event_network(spark: SparkSession, d: str) -> Model:
    """What a user does next, when, and of what value: 2,400 instances."""
    return learning.train(steps_of_users(spark, d), [EVENT, BEFORE, HOUR, BAND], {"before": [], "kind": ["before"], "hour": ["kind"], "band": ["kind"]})


def cdf_sql(child: str, parent: str) -> str:
    """Cumulated fractions of a child's states for each state of a parent."""
    return f"""(SELECT {parent} AS given, {child} AS state, (sum(c) OVER w)::DOUBLE / sum(c) OVER (PARTITION BY {parent}) AS hi, (sum(c) OVER w - c)::DOUBLE / sum(c) OVER (PARTITION BY {parent}) AS lo
  FROM (SELECT {parent}, {child}, count(*) AS c FROM ev WHERE before IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY {parent} ORDER BY {child}))"""


def u_sql(row: str, k: int) -> str:
    return "(" + U.replace("row", f"({row})").format(k=k) + ")"


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, t AS {cdf_sql('kind', 'before')}, h AS {cdf_sql('hour', 'kind')}, b AS {cdf_sql('band', 'kind')},
walk AS (SELECT range::BIGINT AS chain, 0::BIGINT AS step, 0 AS kind, 0 AS before FROM range(20) UNION ALL
  SELECT w.chain, w.step + 1, t.state, w.kind FROM walk w JOIN t ON t.given = w.kind AND {u_sql('w.chain * 200 + w.step + 1', -1)} >= lo AND {u_sql('w.chain * 200 + w.step + 1', -1)} < hi WHERE w.step < 199)
SELECT chain, step, kind, before, h.state AS hour, b.state AS band FROM walk JOIN h ON h.given = kind AND {u_sql('chain * 200 + step', 2)} >= h.lo AND {u_sql('chain * 200 + step', 2)} < h.hi
  JOIN b ON b.given = kind AND {u_sql('chain * 200 + step', 3)} >= b.lo AND {u_sql('chain * 200 + step', 3)} < b.hi"""
)
def chained_events(spark, d):
    # the joint table has 2,400 instances, that of the pair 25
    return sampling.chained(event_network(spark, d), {"kind": "before"}, 20, 200, {"kind": 0, "before": 0}, draw=fixed, segment=64, most_cells=25)


NEXT_SQL = f"""{EVENTS_SQL}, c AS (SELECT before, kind, count(*) AS c FROM ev WHERE before IS NOT NULL GROUP BY ALL), nxt AS (SELECT before, kind FROM c QUALIFY row_number() OVER (PARTITION BY before ORDER BY c DESC, kind) = 1)"""


@query(
    f"""WITH RECURSIVE {NEXT_SQL}, walk AS (SELECT 0 AS step, kind, before FROM nxt WHERE before = 2 UNION ALL SELECT step + 1, nxt.kind, walk.kind FROM walk JOIN nxt ON nxt.before = walk.kind WHERE step < 11)
SELECT range AS chain, step::BIGINT AS step, kind, before FROM walk, range(3)"""
)
def chained_sample(spark, d):
    """What users do next most often, as a network without chance: its chains follow from the first state."""
    counted = ct.cross_table(steps_of_users(spark, d), ["before", "kind"])
    likely = counted.groupBy("before").agg(F.max_by("kind", F.struct("weight", -F.col("kind"))).alias("kind"))
    parts = (factors.Factor((EVENT, BEFORE), likely.select("kind", "before", F.lit(1.0).alias("w"))), factors.Factor((BEFORE,), ct.project(counted, ["before"]).withColumnRenamed("weight", "w")))
    return sampling.chained(Model((EVENT, BEFORE), parts), {"kind": "before"}, chains=3, length=12, initial={"before": 2})


@query(
    f"""WITH {SALES}, held AS (SELECT *, seg IN (0, 2) AS a, os = 1 AS b FROM full_)
SELECT 'seg' AS variable, seg AS state, round(sum(CASE WHEN b THEN w ELSE 0 END), 9) AS d FROM held GROUP BY seg
UNION ALL SELECT 'op', op, round(sum(CASE WHEN a AND b THEN w ELSE 0 END), 9) FROM held GROUP BY op
UNION ALL SELECT 'os', os, round(sum(CASE WHEN a THEN w ELSE 0 END), 9) FROM held GROUP BY os"""
)
def derivatives_of_indicators(spark, d):
    return inference.derivatives(chain(spark, d), {"seg": (0, 2), "os": 1})[1].select("variable", "state", r9("d"))


@query(
    f"""WITH {SALES}, g AS (SELECT * FROM full_ WHERE seg IN (0, 2) AND os = 1)
SELECT 0 AS factor, [s.seg] AS states, round(coalesce(sum(wo * wt), 0), 9) AS d FROM fs s LEFT JOIN g USING (seg) GROUP BY s.seg
UNION ALL SELECT 1, [s.op, s.seg], round(coalesce(sum(ws * wt), 0), 9) FROM fo s LEFT JOIN g USING (op, seg) GROUP BY s.op, s.seg
UNION ALL SELECT 2, [s.os, s.op], round(coalesce(sum(ws * wo), 0), 9) FROM ft s LEFT JOIN g USING (os, op) GROUP BY s.os, s.op"""
)
def derivatives_under_a_condition(spark, d):
    return inference.derivatives(chain(spark, d), {"seg": (0, 2), "os": 1})[0].select("factor", "states", r9("d"))


# ---------------------------------------------------------------- logical factors in learned models


RULES = {
    # urgent orders are never pending; (op, os) pairs that an implication lets through
    "model_with_implication": (lambda s: factors.implies(s, PRIORITY, [0], ORDER_STATUS, [0, 1]), "op <> 0 OR os IN (0, 1)"),
    "model_with_equivalence": (lambda s: factors.equivalent(s, PRIORITY, [0, 1], ORDER_STATUS, [0]), "(op IN (0, 1)) = (os = 0)"),
    "model_with_clause": (lambda s: factors.clause(s, [SEGMENT, ORDER_STATUS], [1, 2], 1.0), "seg = 1 OR os = 2"),
    "model_with_function": (lambda s: factors.functional(s, ORDER_STATUS, [PRIORITY], lambda op: op % 3), "os = op % 3"),
}
for _name, (_rule, _sql) in RULES.items():

    def _with_rule(spark, d, rule=_rule):
        model = chain(spark, d)
        return inference.marginal(Model(model.variables, (*model.factors, rule(spark))), ["seg"]).select("seg", r9("p"))

    _with_rule.__name__ = _name
    query(f"WITH {SALES} SELECT seg, round(sum(w) / sum(sum(w)) OVER (), 9) AS p FROM full_ WHERE {_sql} GROUP BY seg")(_with_rule)


@query(f"WITH {SALES} SELECT seg, op, round(sum(w) * (1 + seg * 5 + op), 9) AS w FROM full_ GROUP BY seg, op")
def model_with_dense_factor(spark, d):
    model = chain(spark, d)
    more = factors.dense(spark, [SEGMENT, PRIORITY], [float(k + 1) for k in range(25)])
    _, t = inference.eliminate(inference.tables(Model(model.variables, (*model.factors, more))), model.sizes, ["seg", "op"])
    return t.select("seg", "op", r9("w"))


# ---------------------------------------------------------------- streams


def files_of_events(spark: SparkSession, d: str, parts: int = 4) -> tuple[str, DataFrame]:
    """The events as a folder of files by time, each written after the one before; some rows of the last half hour of a part come in the next file."""
    events = table(spark, d, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    size = (last - first) / parts

    def part(late: Column) -> Column:
        at = F.col("ts") + F.when(late, F.expr("interval 30 minutes")).otherwise(F.expr("interval 0 minutes"))
        return sum(((at >= F.lit(first + k * size)).cast("int") for k in range(1, parts)), F.lit(0))

    placed = written(events.withColumn("_part", part(F.col("event_id") % 2 == 0)), "placed")
    for k in range(parts):  # as they would arrive
        placed.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path, events


def batches(spark: SparkSession, path: str, events: DataFrame, build, keep) -> None:
    """Runs a stream over the files, one file a micro-batch."""
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = build(stream).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()


@query(
    """WITH e AS (SELECT user_id, ts, event_type AS state, lag(event_type) OVER w AS previous, lag(ts) OVER w AS t0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type))
SELECT user_id AS key, previous, state, epoch_us(ts)::BIGINT AS at FROM e WHERE previous IS NOT NULL AND ts - t0 <= INTERVAL 8 HOUR AND ts < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)"""
)
def stream_ordered_transitions(spark, d):
    from marginalia.streaming.ordered import ROCKS, ordered_transitions

    path, events = files_of_events(spark, d)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        batches(spark, path, events, lambda s: ordered_transitions(s, "user_id", "event_type", "ts", "1 hour", 8 * 3_600_000), lambda rows, epoch: rows.write.mode("append").parquet(f"{path}-out"))
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{path}-out")


@query(
    """SELECT event_type, hour(ts)::INTEGER AS hour, count(*)::DOUBLE AS weight FROM events WHERE value >= 2 GROUP BY ALL"""
)
def stream_kept_counts(spark, d):
    """Counts kept over micro-batches: every batch is replayed, the first ones are folded together, and cheap events are taken back at the end."""
    from marginalia.streaming.kept import KeptTable

    path, events = files_of_events(spark, d)
    kept = KeptTable(spark, f"{path}-kept", ["event_type", "hour"])
    add = kept.writer()

    def twice(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("hour", F.hour("ts"))
        add(batch, epoch)
        add(batch, epoch)  # a replay
        if epoch == 1:
            kept.compact(1)
            add(batch, epoch)  # a replay of what the base has

    batches(spark, path, events, lambda s: s, twice)
    cheap = events.where(F.col("value") < 2).withColumn("hour", F.hour("ts"))
    kept.apply(cheap.limit(0), 1000, retract=cheap)
    return kept.read()


# ---------------------------------------------------------------- coalescing


MISFIT = f"""WITH {SALES}, ab AS (SELECT seg, op, count(*)::DOUBLE / sum(count(*)) OVER () AS b FROM sales GROUP BY seg, op), bc AS (SELECT op, os, count(*)::DOUBLE / sum(count(*)) OVER () AS b FROM sales WHERE seg < 3 GROUP BY op, os),
x AS (SELECT op, sum(b) AS b FROM ab GROUP BY op), y AS (SELECT op, sum(b) AS b FROM bc GROUP BY op), n AS (SELECT op, count(*) AS n FROM ab GROUP BY op), m AS (SELECT op, count(*) AS m FROM bc GROUP BY op)
SELECT round(sum((x.b - y.b) * (x.b - y.b) / (n.n + m.m)), 12) AS squared FROM x JOIN y USING (op) JOIN n USING (op) JOIN m USING (op)"""


@query(MISFIT)
def least_squares_misfit(spark, d):
    """Two cross-tables that do not fit: the smallest sum of squares is known from how their common variable differs."""
    rows = sales(spark, d)
    found = [ct.cross_table(rows, ["seg", "op"]), ct.cross_table(rows.where("seg < 3"), ["op", "os"])]
    variables = [SEGMENT, PRIORITY, ORDER_STATUS]
    m = learning.Incidence(found, variables)
    x = learning.least_squares_tables(found, variables, shift=False)
    sums = m.sums(x, "weight")
    e = [r.select((F.col("_b") - F.col("_s")).alias("e")) for r in sums]
    return e[0].unionByName(e[1]).agg(F.sum(F.col("e") * F.col("e")).alias("squared")).select(F.round("squared", 12).alias("squared"))


@query(
    f"""WITH {SALES}, s AS (SELECT op, os, count(*)::DOUBLE AS c FROM sales GROUP BY op, os), t AS (SELECT sum(c) AS z FROM s)
SELECT 'op, os' AS scope, op AS a, os AS b, round(c / z, 5) + 0.0 AS w FROM s, t UNION ALL SELECT 'seg, op', seg, op, round(count(*)::DOUBLE / (SELECT z FROM t), 5) + 0.0 FROM sales GROUP BY seg, op"""
)
def split_and_mean_crosstabs(spark, d):
    rows = sales(spark, d)
    scopes = (["seg", "op"], ["op", "os"])
    out = learning.split_and_mean_tables([ct.cross_table(rows, s) for s in scopes], [SEGMENT, PRIORITY, ORDER_STATUS], tolerance=1e-8)
    parts = [ct.project(out, s).select(F.lit(f"{s[0]}, {s[1]}").alias("scope"), F.col(s[0]).alias("a"), F.col(s[1]).alias("b"), (F.round("weight", 5) + 0.0).alias("w")) for s in scopes]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- plans


@query(f"WITH {SALES}, c AS (SELECT 'seg' AS variable, seg AS state, sum(w) AS w FROM full_ WHERE os = 1 GROUP BY seg UNION ALL SELECT 'op', op, sum(w) FROM full_ WHERE os = 1 GROUP BY op UNION ALL SELECT 'os', 1, sum(w) FROM full_ WHERE os = 1) SELECT variable, state, round(w / sum(w) OVER (PARTITION BY variable), 9) AS p FROM c")
def maximal_tree_marginals(spark, d):
    return inference.all_marginals(chain(spark, d), {"os": 1}, maximal=True).select("variable", "state", r9("p"))


@query(f"WITH {SALES} SELECT os, round(sum(w * (1 + seg)) / sum(sum(w * (1 + seg))) OVER (), 9) AS p FROM full_ WHERE os = op % 3 GROUP BY os")
def product_tree_marginal(spark, d):
    model = chain(spark, d)
    more = (factors.functional(spark, ORDER_STATUS, [PRIORITY], lambda op: op % 3), factors.dense(spark, [SEGMENT], [1.0, 2.0, 3.0, 4.0, 5.0]))
    return inference.marginal(Model(model.variables, (*model.factors, *more)), ["os"], trees=True).select("os", r9("p"))


@query(f"WITH {SALES}, s AS (SELECT DISTINCT op FROM sales WHERE op < 3) SELECT op, range::INTEGER AS os, CASE WHEN range = op % 3 THEN 1.0::DOUBLE ELSE 0 END AS p FROM s, range(3)")
def batch_posterior_all_states(spark, d):
    """Posteriors with states of probability 0, as a function of the evidence rules them out."""
    model = chain(spark, d)
    rule = factors.functional(spark, ORDER_STATUS, [PRIORITY], lambda op: op % 3)
    rows = table(spark, d, "orders").select(PRIORITY.of_labels(F.col("o_orderpriority")).alias("op")).distinct().where("op < 3")
    return inference.batch_evidence(Model(model.variables, (*model.factors, rule)), rows, ["op"], target="os").select("op", "os", r9("p"))


# ---------------------------------------------------------------- recursive conditioning


LOOP = {"before": [], "kind": ["before"], "hour": ["before"], "band": ["kind", "hour"]}


def event_loop(spark: SparkSession, d: str) -> Model:
    """A network with a loop: the hour goes by the event before, the value by what is done and when."""
    return learning.train(steps_of_users(spark, d), [EVENT, BEFORE, HOUR, BAND], LOOP)


LOOP_SQL = f"""{EVENTS_SQL}, e AS (SELECT * FROM ev WHERE before IS NOT NULL),
b AS (SELECT before, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM e GROUP BY before), k AS (SELECT kind, before, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY before) AS w FROM e GROUP BY kind, before),
h AS (SELECT hour, before, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY before) AS w FROM e GROUP BY hour, before), v AS (SELECT band, kind, hour, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY kind, hour) AS w FROM e GROUP BY band, kind, hour),
j AS (SELECT before, kind, hour, band, b.w * k.w * h.w * v.w AS w FROM b JOIN k USING (before) JOIN h USING (before) JOIN v USING (kind, hour))"""


@query(f"WITH {LOOP_SQL} SELECT kind, round(sum(w) / sum(sum(w)) OVER (), 9) AS p FROM j WHERE band >= 2 AND hour BETWEEN 6 AND 20 GROUP BY kind")
def conditioned_events(spark, d):
    from marginalia.operators.conditioning import conditioned_marginal

    return conditioned_marginal(event_loop(spark, d), ["kind"], {"band": (2, 3), "hour": tuple(range(6, 21))}, most_rows=100).select("kind", r9("p"))


@query(f"WITH {LOOP_SQL} SELECT round(sum(w), 9) AS w FROM j WHERE band = 3 AND kind IN (0, 2)")
def conditioned_weight(spark, d):
    from marginalia.operators.conditioning import conditioning

    return conditioning(event_loop(spark, d), cond={"band": 3, "kind": (0, 2)}, most_rows=24)[0].select(r9("w"))


# ---------------------------------------------------------------- samples as sources


LINES = ["l_partkey", "l_linenumber"]


@query("WITH c AS (SELECT l_partkey, l_linenumber, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY ALL) SELECT l_partkey, l_linenumber, round(w / sum(w) OVER (), 12) AS p FROM c WHERE w > 0")
def alias_table_law(spark, d):
    """The probabilities that an alias table over groups of equal weight gives to the instances of a cross-table."""
    from marginalia.operators import alias

    items = table(spark, d, "lineitem").select(*LINES, F.col("l_quantity").cast("double").alias("q"))
    instances = written(alias.numbered(ct.cross_table(items, LINES, "q")), "instances")
    return alias.law(written(alias.slots(alias.weight_groups(instances)), "slots"), instances).select(*LINES, F.round("p", 12).alias("p"))


@query("WITH c AS (SELECT l_partkey, l_linenumber, sum(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY ALL) SELECT weight, (sum(count(*)) OVER (ORDER BY weight) - count(*))::BIGINT AS first, count(*) AS n FROM c WHERE weight > 0 GROUP BY weight")
def weight_groups(spark, d):
    from marginalia.operators import alias

    items = table(spark, d, "lineitem").select(*LINES, F.col("l_quantity").cast("double").alias("q"))
    return alias.weight_groups(alias.numbered(ct.cross_table(items, LINES, "q")))


def streamed(spark: SparkSession, sampler, runs: int, rows_per_batch: int) -> DataFrame:
    """The samples of several runs of one stream, each of which goes on where the one before ended."""
    from marginalia.operators import samplers

    path = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    for _ in range(runs):
        q = samplers.stream(sampler, spark, rows_per_batch).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(path)


@query(SQL["forward_sample"])
def stream_forward_samples(spark, d):
    """Two runs of 500 numbers of a stream give the samples of a batch of 1,000."""
    from marginalia.operators import samplers

    return streamed(spark, samplers.forward(chain(spark, d), draw=fixed), 2, 500)


@query(SQL["direct_sample"])
def stream_direct_samples(spark, d):
    from marginalia.operators import samplers

    return streamed(spark, samplers.direct(chain(spark, d), ["seg", "op"], {"os": 1}, draw=fixed, order=["os", "op", "seg"]), 2, 500)
