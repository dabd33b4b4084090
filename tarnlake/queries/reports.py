"""Queries on results, balance, series, schedules and batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.functions import scalars as S
from tarnlake.operators import knn, lake, metrics, reports, segmentation
from tarnlake.operators.ranks import numbered, running
from tarnlake.queries import embeddings as E
from tarnlake.session import materialize, table
from tarnlake.streaming.jobs import batch_stream_table, write_stream_manifest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
R6 = E.R6


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# --- results --------------------------------------------------------------------------------------------------------

ROWS = """WITH r AS (SELECT o_orderpriority AS task, o_orderstatus AS init, avg(o_totalprice) / 1000000 AS accuracy, avg(o_totalprice) / 900000 AS balanced_acc, count(*) AS n FROM orders GROUP BY ALL)"""


@query("json_rows_explode", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE CAST(props ->> '$.k' AS BIGINT) IS NOT NULL")
def json_rows_explode(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("r"))
    doc = e.select(F.array(F.struct("event_id", "r.k")).alias("rows"))
    return reports.long_results(doc, ("event_id", "k")).where("k is not null")


def _two_runs(spark: SparkSession, sf: str) -> DataFrame:
    n = materialize(knn.knn_join(*E.sides(spark, sf), 50), "neighbours")
    classes = E.sides(spark, sf)[1].select(F.col("y").alias("cls")).distinct()
    out = None
    for stage, k in (("pre", 20), ("post", 50)):
        p = metrics.as_calibrated(knn.probabilities(knn.votes(n, k, E.TAU), classes))
        row = metrics.calibration_row(p, E.BINS).select("nll", "brier", "accuracy").withColumn("stage", F.lit(stage)).withColumn("objective", F.lit(f"k{k}"))
        out = row if out is None else out.unionByName(row)
    return out.select(F.lit("embeddings").alias("dataset"), F.lit("frozen").alias("init"), F.lit("label").alias("task"), F.lit(None).cast("string").alias("protocol"), F.lit(False).alias("temp_scaled"), "stage", "objective", "nll", "brier", "accuracy")


def _run_sql(k: int, s: str) -> str:
    return f""", w{s} AS (SELECT id, y, ref_y, exp((sim - max(sim) OVER (PARTITION BY id)) / CAST({E.TAU} AS DOUBLE)) AS w FROM nb WHERE rank <= {k}),
v{s} AS (SELECT id, ref_y AS cls, sum(w) AS vote FROM w{s} GROUP BY id, ref_y), t{s} AS (SELECT id, y, sum(w) AS total FROM w{s} GROUP BY id, y),
c{s} AS (SELECT t{s}.id, t{s}.y, cl.cls, greatest(coalesce(vote, 0) / total, CAST(1e-6 AS DOUBLE)) AS c FROM t{s} CROSS JOIN cl LEFT JOIN v{s} ON v{s}.id = t{s}.id AND v{s}.cls = cl.cls),
p{s} AS (SELECT id, y, cls, c / sum(c) OVER (PARTITION BY id) AS p FROM c{s}),
m{s} AS (SELECT (SELECT avg(-ln(p)) FROM p{s} WHERE y = cls) AS nll, (SELECT avg(CAST(pred = y AS INTEGER)) FROM (SELECT id, y, first(cls ORDER BY p DESC, cls) AS pred FROM p{s} GROUP BY id, y)) AS acc)"""


TWO = E.neighbour_sql(50) + ", cl AS (SELECT DISTINCT y AS cls FROM u WHERE NOT q)" + _run_sql(20, "a") + _run_sql(50, "b")


@query("delta_view", TWO + " SELECT 'k50' AS objective, round(mb.nll - ma.nll, 6) AS d_nll, round(mb.acc - ma.acc, 6) AS d_accuracy FROM ma CROSS JOIN mb")
def delta_view(spark, sf):
    return reports.delta_view(_two_runs(spark, sf)).select("objective", R6("d_nll").alias("d_nll"), R6("d_accuracy").alias("d_accuracy"))


@query("model_selection", TWO + " SELECT 'k50' AS objective, round(mb.acc - ma.acc, 6) AS mean_delta, mb.acc - ma.acc >= CAST(-0.02 AS DOUBLE) AS passes FROM ma CROSS JOIN mb")
def model_selection(spark, sf):
    return reports.model_selection(reports.delta_view(_two_runs(spark, sf)), "d_accuracy").select("objective", R6("mean_delta").alias("mean_delta"), "passes")


@query("suspect_flags", ROWS + " SELECT task, init, CASE WHEN contains(lower(task), 'tract') THEN '†' WHEN accuracy > CAST(0.98 AS DOUBLE) OR balanced_acc > accuracy + CAST(0.02 AS DOUBLE) THEN '⚠' ELSE '' END AS flag FROM r")
def suspect_flags(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("init")).agg((F.avg("o_totalprice") / 1000000).alias("accuracy"), (F.avg("o_totalprice") / 900000).alias("balanced_acc"))
    return a.select("task", "init", S.suspicion(F.col("task"), F.col("accuracy"), F.col("balanced_acc")).alias("flag"))


@query("report_order", ROWS + " SELECT task, init, n, CAST(row_number() OVER (ORDER BY task NULLS LAST, init NULLS LAST, n) AS INTEGER) AS pos FROM r")
def report_order(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("init")).agg(F.count("*").alias("n"))
    return reports.ordered(rows)


@query("report_cells", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '–' ELSE printf('%.4f', o_totalprice / 7) END AS cell, CASE WHEN o_orderkey % 2 = 0 THEN 'a__b' ELSE 'a' END AS tag FROM orders")
def report_cells(spark, sf):
    x = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 7)
    return table(spark, sf, "orders").select("o_orderkey", S.cell(x).alias("cell"), S.run_tag(F.lit("a"), F.when(F.col("o_orderkey") % 2 == 0, "b").otherwise("")).alias("tag"))


@query("readable_bytes", """SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824) ELSE printf('%.1f TB', b / 1099511627776) END AS shown
FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * (o_orderkey % 1000) AS b FROM orders)""")
def readable_bytes(spark, sf):
    k = F.col("o_orderkey").cast("long")
    return table(spark, sf, "orders").select("o_orderkey", S.readable_bytes(k * k * (k % 1000)).alias("shown"))


@query("class_balance", """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), p AS (SELECT n, n / (sum(n) OVER ()) AS p FROM n)
SELECT count(*) AS classes, round(max(p), 6) AS majority, round(min(p), 6) AS minority, round(max(n) / greatest(1, min(n)), 6) AS imbalance, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 1 END, 6) AS norm_entropy, round(exp(sum(-p * ln(p))), 6) AS effective, round(1 / count(*), 6) AS chance FROM p""")
def class_balance(spark, sf):
    b = reports.class_balance(table(spark, sf, "documents"), "lang")
    return b.select("classes", *[R6(c).alias(c) for c in b.columns[1:]])


@query("majority_baseline", "SELECT round(max(n) / sum(n), 6) AS accuracy FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def majority_baseline(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).agg(R6(F.max("n") / F.sum("n")).alias("accuracy"))


@query("ontology_sets", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS tracts, count(DISTINCT lang) = 1 AS single FROM documents GROUP BY source")
def ontology_sets(spark, sf):
    return reports.ontology(table(spark, sf, "documents"), "source", "lang").select("source", F.array_join("tracts", ",").alias("tracts"), "single")


def series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("tag"), F.floor(F.col("event_id") / 10).alias("step"), "value")


SERIES = "WITH s AS (SELECT event_type AS tag, event_id // 10 AS step, value FROM events)"


@query("last_value_per_tag", SERIES + " SELECT tag, first(value ORDER BY step DESC, value DESC) AS last, max(step) AS max_step, count(*) AS n FROM s GROUP BY tag")
def last_value_per_tag(spark, sf):
    return reports.last_value(series(spark, sf))


@query("pivot_by_step", SERIES + " SELECT step, coalesce(max(value) FILTER (tag = 'click'), 0) AS click, coalesce(max(value) FILTER (tag = 'view'), 0) AS view FROM s GROUP BY step")
def pivot_by_step(spark, sf):
    return reports.by_step(series(spark, sf), ["click", "view"]).fillna(0.0)


@query("quantiles_hist", "SELECT quantile_cont(n_chars, CAST(0.25 AS DOUBLE)) AS q25, quantile_cont(n_chars, CAST(0.5 AS DOUBLE)) AS q50, quantile_cont(n_chars, CAST(0.9 AS DOUBLE)) AS q90, count(*) FILTER (n_chars < 1000) AS low, count(*) FILTER (n_chars >= 1000 AND n_chars <= 200000) AS high FROM documents")
def quantiles_hist(spark, sf):
    d = table(spark, sf, "documents").withColumn("bin", reports.histogram(F.col("n_chars"), [0, 1000, 200000]))
    q = F.percentile("n_chars", [0.25, 0.5, 0.9])
    return d.agg(q.alias("q"), F.count_if(F.col("bin") == 0).alias("low"), F.count_if(F.col("bin") == 1).alias("high")).select(F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q90"), "low", "high")


@query("bootstrap_ci", """WITH u AS (SELECT source, count(*) AS total, count(*) FILTER (n_chars < 200) AS hits FROM documents GROUP BY source), x AS (SELECT b, hits, total, CAST('0x' || substr(md5('0:' || b || ':' || source), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS x FROM u CROSS JOIN range(200) r(b)),
w AS (SELECT b, hits, total, CAST(x >= CAST(0.36787944117144233 AS DOUBLE) AS INTEGER) + CAST(x >= CAST(0.7357588823428847 AS DOUBLE) AS INTEGER) + CAST(x >= CAST(0.9196986029286058 AS DOUBLE) AS INTEGER) + CAST(x >= CAST(0.9810118431238462 AS DOUBLE) AS INTEGER) + CAST(x >= CAST(0.9963401531726563 AS DOUBLE) AS INTEGER) + CAST(x >= CAST(0.9994058151824183 AS DOUBLE) AS INTEGER) + CAST(x >= CAST(0.9999167588507119 AS DOUBLE) AS INTEGER) + CAST(x >= CAST(0.9999897508033253 AS DOUBLE) AS INTEGER) AS w FROM x)
SELECT CAST(b AS INTEGER) AS b, round(sum(w * hits) / nullif(sum(w * total), 0), 6) AS rate FROM w GROUP BY b""")
def bootstrap_ci(spark, sf):
    u = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") < 200).alias("hits"))
    return reports.bootstrap_rates(u, "hits", "total", "source", 200).select("b", R6("rate").alias("rate"))


@query("rule_of_three", "SELECT source, CAST(3 AS DOUBLE) / count(*) AS bound FROM documents GROUP BY source")
def rule_of_three(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(reports.rule_of_three(F.count("*")).alias("bound"))


@query("seg_overlap", """WITH p AS (SELECT l_orderkey AS image, CAST(l_discount >= CAST(0.05 AS DOUBLE) AS BIGINT) AS a, CAST(l_tax >= CAST(0.04 AS DOUBLE) AS BIGINT) AS b FROM lineitem),
s AS (SELECT image, sum(a) AS a, sum(b) AS b, sum(a * b) AS c FROM p GROUP BY image)
SELECT image, round(CASE WHEN a + b = 0 THEN 1 ELSE 2 * c / (a + b) END, 6) AS dice, round(CASE WHEN a + b = 0 THEN 1 ELSE c / (a + b - c) END, 6) AS iou FROM s""")
def seg_overlap(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_discount") >= 0.05).cast("double").alias("p"), (F.col("l_tax") >= 0.04).cast("int").alias("gt"))
    return segmentation.overlap(p).select("image", R6("dice").alias("dice"), R6("iou").alias("iou"))


@query("seg_pixel_calibration", """WITH p AS (SELECT CAST(l_tax >= CAST(0.04 AS DOUBLE) AS INTEGER) AS y, l_discount * 10 AS p FROM lineitem), c AS (SELECT y, CAST(p >= CAST(0.5 AS DOUBLE) AS INTEGER) AS pred, greatest(p, 1 - p) AS conf FROM p),
b AS (SELECT greatest(0, least(14, ceil(conf * 15) - 1)) AS bin, y = 1 AS fg, y = pred AS hit, conf FROM c),
g AS (SELECT bin, count(*) AS n, avg(CAST(hit AS INTEGER)) AS acc, avg(conf) AS conf FROM b GROUP BY bin), f AS (SELECT bin, count(*) AS n, avg(CAST(hit AS INTEGER)) AS acc, avg(conf) AS conf FROM b WHERE fg GROUP BY bin)
SELECT 'all' AS pixels, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM g UNION ALL SELECT 'foreground', round(sum(n * abs(acc - conf)) / sum(n), 6) FROM f""")
def seg_pixel_calibration(spark, sf):
    """Calibration over all pixels and over those of the foreground."""
    p = F.col("l_discount") * 10
    pix = table(spark, sf, "lineitem").select((F.col("l_tax") >= 0.04).cast("int").alias("y"), (p >= 0.5).cast("int").alias("pred"), F.greatest(p, 1 - p).alias("conf"))
    out = [metrics.ece(metrics.reliability(d, 15)).select(F.lit(name).alias("pixels"), R6("ece").alias("ece")) for name, d in (("all", pix), ("foreground", pix.where("y = 1")))]
    return out[0].unionByName(out[1])


@query("seg_mean", """WITH p AS (SELECT l_orderkey AS image, CAST(l_discount >= CAST(0.05 AS DOUBLE) AS BIGINT) AS a, CAST(l_tax >= CAST(0.04 AS DOUBLE) AS BIGINT) AS b FROM lineitem),
s AS (SELECT image, sum(a) AS a, sum(b) AS b, sum(a * b) AS c FROM p GROUP BY image)
SELECT round(avg(CASE WHEN a + b = 0 THEN 1 ELSE 2 * c / (a + b) END), 6) AS dice, round(avg(CASE WHEN a + b = 0 THEN 1 ELSE c / (a + b - c) END), 6) AS miou FROM s""")
def seg_mean(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_discount") >= 0.05).cast("double").alias("p"), (F.col("l_tax") >= 0.04).cast("int").alias("gt"))
    return segmentation.mean_overlap(p).select(R6("dice").alias("dice"), R6("miou").alias("miou"))


# --- schedules ------------------------------------------------------------------------------------------------------


@query("lr_schedule", "SELECT i AS step, round(CASE WHEN i < 10 THEN CAST(0.001 AS DOUBLE) * i / 10 ELSE CAST(0.001 AS DOUBLE) * CAST(0.5 AS DOUBLE) * (1 + cos(pi() * least(1, (i - 10) / CAST(90 AS DOUBLE)))) END, 9) AS lr FROM range(101) t(i)")
def lr_schedule(spark, sf):
    return spark.range(101).select(F.col("id").alias("step"), F.round(S.warmup_cosine(F.col("id"), 100, 10, 0.001), 9).alias("lr"))


@query("momentum_schedule", "SELECT i AS step, round(1 - CAST(0.004 AS DOUBLE) * (cos(pi() * least(1, i / CAST(100 AS DOUBLE))) + 1) / 2, 9) AS momentum, round(CASE WHEN i >= 30 THEN CAST(0.07 AS DOUBLE) ELSE CAST(0.04 AS DOUBLE) + CAST(0.03 AS DOUBLE) * i / 30 END, 9) AS temperature FROM range(101) t(i)")
def momentum_schedule(spark, sf):
    return spark.range(101).select(F.col("id").alias("step"), F.round(S.cosine_momentum(F.col("id"), 100), 9).alias("momentum"), F.round(S.linear_ramp(F.col("id"), 30, 0.04, 0.07), 9).alias("temperature"))


# --- batches and streams --------------------------------------------------------------------------------------------


@query("batch_plan", """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('0:' || event_id), event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CAST((k - 1) // 64 - CASE WHEN n % 64 = 1 AND k = n THEN 1 ELSE 0 END AS INTEGER) AS batch, count(*) AS n FROM r GROUP BY 1, 2""")
def batch_plan(spark, sf):
    e = table(spark, sf, "events")
    return lake.batch_plan(e, "event_type", [S.seeded_order(0, F.col("event_id")), F.col("event_id")], 64).groupBy("event_type", "batch").agg(F.count("*").alias("n"))


@query("epoch_order", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:1:' || event_type || ':' || event_id), event_id) AS pos, md5('7:1:' || event_type) AS archive_key FROM events")
def epoch_order(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    placed = numbered(e, ["event_type"], [S.seeded_order("7:1", F.col("event_type"), F.col("event_id")), "event_id"], "pos")
    return placed.select("event_id", "pos", S.seeded_order("7:1", F.col("event_type")).alias("archive_key"))


@query("lead_pairs", "WITH a AS (SELECT event_type, md5('7:1:' || event_type) AS k FROM events GROUP BY event_type) SELECT event_type, coalesce(lead(event_type) OVER (ORDER BY k), '') AS next FROM a")
def lead_pairs(spark, sf):
    a = table(spark, sf, "events").select("event_type").distinct().withColumn("k", S.seeded_order("7:1", F.col("event_type")))
    return a.select("event_type", F.coalesce(F.lead("event_type").over(Window.orderBy("k")), F.lit("")).alias("next"))


@query("rate_per_window", "WITH e AS (SELECT event_type, event_id, ts, lag(event_id) OVER w AS p, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_id, round((event_id - p) / (epoch(ts) - epoch(pt)), 6) AS rate FROM e WHERE p IS NOT NULL AND epoch(ts) > epoch(pt)")
def rate_per_window(spark, sf):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events").withColumn("s", sec).withColumn("p", F.lag("event_id").over(w)).withColumn("ps", F.lag("s").over(w))
    return e.where("p is not null and s > ps").select("event_id", R6((F.col("event_id") - F.col("p")) / (F.col("s") - F.col("ps"))).alias("rate"))


@query("coverage_running_sum", "WITH d AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, CAST(sum(n) OVER (ORDER BY user_id) AS BIGINT) AS covered FROM d")
def coverage_running_sum(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return running(d, [], ["user_id"], "n", "covered").select("user_id", "covered")


@query("stream_resume", "SELECT epoch, event_type, count(*) AS n, count(DISTINCT event_id) AS items FROM events CROSS JOIN (VALUES (0), (1)) e(epoch) GROUP BY epoch, event_type")
def stream_resume(spark, sf):
    """Two epochs over all events in batches of 2048, stopped after two triggers and resumed from the checkpoint."""
    manifest = write_stream_manifest(table(spark, sf, "events"), "event_type", "event_id")
    options = {"manifest": manifest, "batchSize": 2048, "epochs": 2, "seed": 7, "batchesPerTrigger": 2}
    rows = batch_stream_table(spark, options, stops=(2,))
    return rows.groupBy("epoch", F.col("archive").alias("event_type")).agg(F.count("*").alias("n"), F.count_distinct("member").alias("items"))
