"""Queries on ``embeddings``: k-NN votes, classification and calibration metrics, hashes, linear algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import scalars as S
from tarnlake.operators import fits, hamming, knn, metrics
from tarnlake.session import materialize, table

K, TAU, BINS = 20, 0.07, 15
SWEEP = (10, 20, 50, 200)
TEMPERATURES = tuple(round(0.25 * i, 2) for i in range(1, 17))


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Query and reference side: split by the first hex digit of a seeded digest."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y"), S.doubles(F.col("embedding")).alias("v"))
    is_query = F.substring(S.seeded_order(0, F.col("id")), 1, 1) < "4"
    return e.where(is_query), e.where(~is_query)


def probs(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return knn.knn_probs(*sides(spark, sf), k, TAU)


def kept_probs(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return materialize(probs(spark, sf, k), "probs")


def calibrated(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(metrics.as_calibrated(probs(spark, sf)), "calibrated")


def neighbour_sql(k: int) -> str:
    return f"""
WITH e AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS y, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT id, y, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + CAST(1e-12 AS DOUBLE) AS l, substr(md5('0:' || id), 1, 1) < '4' AS q FROM e),
u AS (SELECT id, y, q, list_transform(v, lambda x: x / l) AS v FROM n),
s AS (SELECT a.id, a.y, b.id AS ref_id, b.y AS ref_y, list_inner_product(a.v, b.v) AS sim FROM u a JOIN u b ON a.q AND NOT b.q),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, ref_id) AS rank FROM s) WHERE rank <= {k})"""


def probs_sql(k: int = K) -> str:
    return neighbour_sql(k) + f""",
w AS (SELECT id, y, ref_y, exp((sim - max(sim) OVER (PARTITION BY id)) / CAST({TAU} AS DOUBLE)) AS w FROM nb),
v AS (SELECT id, ref_y AS cls, sum(w) AS vote FROM w GROUP BY id, ref_y),
t AS (SELECT id, y, sum(w) AS total FROM w GROUP BY id, y),
cl AS (SELECT DISTINCT y AS cls FROM u WHERE NOT q),
probs AS (SELECT t.id, t.y, cl.cls, coalesce(v.vote, 0) / greatest(t.total, CAST(1e-7 AS DOUBLE)) AS p FROM t CROSS JOIN cl LEFT JOIN v ON v.id = t.id AND v.cls = cl.cls),
cal AS (SELECT id, y, cls, c / sum(c) OVER (PARTITION BY id) AS p FROM (SELECT *, greatest(least(p, CAST(1 AS DOUBLE)), CAST(1e-6 AS DOUBLE)) AS c FROM probs)),
pred AS (SELECT id, y, first(cls ORDER BY p DESC, cls) AS pred, max(p) AS conf FROM probs GROUP BY id, y),
cpred AS (SELECT id, y, first(cls ORDER BY p DESC, cls) AS pred, max(p) AS conf FROM cal GROUP BY id, y)"""


def sql(rest: str, k: int = K) -> str:
    return probs_sql(k) + rest


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


R6 = lambda c: F.round(c, 6)


@query("knn_vote_probs", sql(" SELECT id, cls, round(p, 6) AS p FROM probs"))
def knn_vote_probs(spark, sf):
    return probs(spark, sf).select("id", "cls", R6("p").alias("p"))


@query("knn_neighbours", neighbour_sql(5) + " SELECT id, ref_id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM nb")
def knn_neighbours(spark, sf):
    return knn.knn_join(*sides(spark, sf), 5).select("id", "ref_id", "rank", R6("sim").alias("sim"))


@query("knn_accuracy", sql(" SELECT round(avg(CAST(pred = y AS INTEGER)), 6) AS acc, count(*) AS n FROM pred"))
def knn_accuracy(spark, sf):
    return metrics.predictions(probs(spark, sf)).agg(R6(F.avg((F.col("pred") == F.col("y")).cast("double"))).alias("acc"), F.count("*").alias("n"))


@query("knn_confusion", sql(" SELECT y, pred, count(*) AS n FROM pred GROUP BY y, pred"))
def knn_confusion(spark, sf):
    return metrics.confusion(metrics.predictions(probs(spark, sf)))


@query("knn_k_sweep", neighbour_sql(max(SWEEP)) + f""", g AS (SELECT nb.*, k FROM nb JOIN (VALUES {', '.join(f'({k})' for k in SWEEP)}) ks(k) ON rank <= k),
w AS (SELECT k, id, y, ref_y, exp((sim - max(sim) OVER (PARTITION BY k, id)) / CAST({TAU} AS DOUBLE)) AS w FROM g),
v AS (SELECT k, id, y, ref_y, sum(w) AS vote FROM w GROUP BY k, id, y, ref_y),
b AS (SELECT k, id, y, first(ref_y ORDER BY vote DESC, ref_y) AS pred FROM v GROUP BY k, id, y)
SELECT CAST(k AS INTEGER) AS k, round(avg(CAST(pred = y AS INTEGER)), 6) AS acc FROM b GROUP BY k""")
def knn_k_sweep(spark, sf):
    return knn.k_sweep(knn.knn_join(*sides(spark, sf), max(SWEEP)), SWEEP, TAU).select("k", R6("acc").alias("acc"))


@query("context_metrics", sql(""", c AS (SELECT y, pred, count(*) AS n FROM pred GROUP BY y, pred),
k AS (SELECT DISTINCT y AS cls FROM pred UNION SELECT DISTINCT pred FROM pred),
per AS (SELECT cls, coalesce((SELECT sum(n) FROM c WHERE c.y = cls), 0) AS ny, coalesce((SELECT sum(n) FROM c WHERE c.pred = cls), 0) AS np, coalesce((SELECT sum(n) FROM c WHERE c.y = cls AND c.pred = cls), 0) AS hit FROM k)
SELECT round(sum(hit) / sum(ny), 6) AS accuracy, round(avg(CASE WHEN ny > 0 THEN hit / ny END), 6) AS balanced_acc, round(avg(CASE WHEN ny + np > 0 THEN 2 * hit / (ny + np) ELSE 0 END), 6) AS macro_f1 FROM per"""))
def context_metrics(spark, sf):
    m = metrics.accuracy_metrics(materialize(metrics.predictions(probs(spark, sf)), "pred"))
    return m.select(*[R6(c).alias(c) for c in m.columns])


AUROC = """, r AS (SELECT cls, p, y = cls AS pos, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0 AS r FROM {src}),
au AS (SELECT cls, CASE WHEN count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0 THEN (CAST(sum(r) FILTER (pos) AS DOUBLE) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) END AS auroc FROM r GROUP BY cls)"""


@query("auroc_ovr", sql(AUROC.format(src="(SELECT id, y, cls, round(p, 9) AS p FROM probs)") + " SELECT cls, round(auroc, 6) AS auroc FROM au"))
def auroc_ovr(spark, sf):
    p = kept_probs(spark, sf).withColumn("p", F.round("p", 9))
    return metrics.auroc_ovr(p).select("cls", R6("auroc").alias("auroc"))


@query("auroc_macro", sql(AUROC.format(src="(SELECT id, y, cls, round(p, 9) AS p FROM probs)") + " SELECT CASE WHEN count(*) = count(auroc) THEN round(avg(auroc), 6) END AS auroc FROM au"))
def auroc_macro(spark, sf):
    return metrics.macro_auroc(kept_probs(spark, sf).withColumn("p", F.round("p", 9))).select(R6("auroc").alias("auroc"))


@query("nll", sql(" SELECT round(avg(-ln(greatest(least(p, CAST(1 AS DOUBLE)), CAST(1e-7 AS DOUBLE)))), 6) AS nll FROM cal WHERE y = cls"))
def nll(spark, sf):
    return calibrated(spark, sf).agg(metrics.nll(None)).select(R6("nll").alias("nll"))


@query("brier", sql(" SELECT round(avg(b), 6) AS brier FROM (SELECT id, sum((p - CAST(y = cls AS INTEGER)) * (p - CAST(y = cls AS INTEGER))) AS b FROM cal GROUP BY id)"))
def brier(spark, sf):
    return metrics.brier(calibrated(spark, sf)).select(R6("brier").alias("brier"))


BINNED = f", bin AS (SELECT CAST(greatest(0, least({BINS - 1}, ceil(conf * {BINS}) - 1)) AS INTEGER) AS bin, count(*) AS n, avg(CAST(y = pred AS INTEGER)) AS acc, avg(conf) AS conf FROM cpred GROUP BY 1)"


@query("reliability_bins", sql(BINNED + f" SELECT CAST(s.b AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(acc, 0), 6) AS acc, round(coalesce(conf, 0), 6) AS conf FROM range({BINS}) s(b) LEFT JOIN bin ON bin.bin = s.b"))
def reliability_bins(spark, sf):
    return metrics.reliability(metrics.predictions(calibrated(spark, sf)), BINS).select("bin", "n", R6("acc").alias("acc"), R6("conf").alias("conf"))


@query("ece_equal_width", sql(BINNED + " SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM bin"))
def ece_equal_width(spark, sf):
    return metrics.ece(metrics.reliability(metrics.predictions(calibrated(spark, sf)), BINS)).select(R6("ece").alias("ece"))


ADAPTIVE = f""", eq AS (SELECT list_distinct(quantile_cont(conf, [{', '.join(f'CAST({i} AS DOUBLE) / {BINS}' for i in range(BINS + 1))}])) AS l FROM cpred),
edge AS (SELECT list_sort(l) AS l FROM eq), ed AS (SELECT CASE WHEN len(l) < 2 THEN [CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)] ELSE list_concat([CAST(0 AS DOUBLE)], list_concat(l[2:-2], [CAST(1 AS DOUBLE)])) END AS e FROM edge),
ab AS (SELECT greatest(0, len(list_filter(e, lambda x: x < conf)) - 1) AS bin, count(*) AS n, avg(CAST(y = pred AS INTEGER)) AS acc, avg(conf) AS conf FROM cpred CROSS JOIN ed GROUP BY 1)"""


@query("ece_adaptive", sql(ADAPTIVE + " SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM ab"))
def ece_adaptive(spark, sf):
    return metrics.ece(metrics.adaptive_bins(materialize(metrics.predictions(calibrated(spark, sf)), "pred"), BINS)).select(R6("ece").alias("ece"))


GRID = f""", g AS (SELECT t, id, y, cls, exp(ln(greatest(least(p, CAST(1 AS DOUBLE)), CAST(1e-6 AS DOUBLE))) / t) AS e FROM probs CROSS JOIN (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in TEMPERATURES)}) ts(t)),
gp AS (SELECT t, y, cls, e / sum(e) OVER (PARTITION BY t, id) AS p FROM g)"""


@query("temperature_grid", sql(GRID + " SELECT t, round(avg(-ln(greatest(p, CAST(1e-7 AS DOUBLE)))), 6) AS nll FROM gp WHERE y = cls GROUP BY t"))
def temperature_grid(spark, sf):
    p = kept_probs(spark, sf).withColumn("t", F.explode(F.array(*[F.lit(t) for t in TEMPERATURES])))
    z = F.exp(F.log(F.greatest(F.least("p", F.lit(1.0)), F.lit(1e-6))) / F.col("t"))
    total = p.withColumn("e", z).groupBy("t", "id", "y").agg(F.sum("e").alias("total"), F.sum(F.when(F.col("y") == F.col("cls"), F.col("e"))).alias("own"))
    return total.groupBy("t").agg(R6(F.avg(-F.log(F.greatest(F.col("own") / F.col("total"), F.lit(1e-7))))).alias("nll"))


@query("temperature_newton")
def temperature_newton(spark, sf):
    p = kept_probs(spark, sf)
    cal = p.where(F.col("id") % 2 == 0)  # the calibration half; the other is the evaluation half
    t = fits.fit_temperature(cal)
    return metrics.tempered(p.where(F.col("id") % 2 == 1), t).agg(metrics.nll(None)).select(F.lit(t).alias("temperature"), "nll")


REPORT = """SELECT {tag} AS temp_scaled, (SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) FROM bin{s}) AS ece_ew, (SELECT round(avg(-ln(greatest(p, CAST(1e-7 AS DOUBLE)))), 6) FROM {src} WHERE y = cls) AS nll,
(SELECT round(avg(b), 6) FROM (SELECT id, sum((p - CAST(y = cls AS INTEGER)) * (p - CAST(y = cls AS INTEGER))) AS b FROM {src} GROUP BY id)) AS brier"""
TWO = """, two AS (SELECT id, y, cls, e / sum(e) OVER (PARTITION BY id) AS p FROM (SELECT *, exp(ln(greatest(least(p, CAST(1 AS DOUBLE)), CAST(1e-6 AS DOUBLE))) / CAST(2 AS DOUBLE)) AS e FROM probs)),
tpred AS (SELECT id, y, first(cls ORDER BY p DESC, cls) AS pred, max(p) AS conf FROM two GROUP BY id, y)"""


@query("flatten_report", sql(TWO + BINNED + BINNED.replace("bin AS", "bin2 AS", 1).replace("FROM cpred", "FROM tpred") + " " + REPORT.format(tag="false", s="", src="cal") + " UNION ALL " + REPORT.format(tag="true", s="2", src="two")))
def flatten_report(spark, sf):
    """Pre and post rows of a calibration report; the post temperature is fixed at 2 here, so that SQL can say it."""
    p = kept_probs(spark, sf)
    rows = [metrics.calibration_row(d, BINS).withColumn("temp_scaled", F.lit(post)) for post, d in ((False, metrics.as_calibrated(p)), (True, metrics.tempered(p, 2.0)))]
    return rows[0].unionByName(rows[1]).select("temp_scaled", *[R6(c).alias(c) for c in ("ece_ew", "nll", "brier")])


DIR = ", d AS (SELECT id, y, cls, 10 * p + 1 AS alpha, sum(10 * p + 1) OVER (PARTITION BY id) AS s, count(*) OVER (PARTITION BY id) AS c FROM probs)"


@query("dirichlet_stats", sql(DIR + " SELECT id, cls, round(alpha, 6) AS alpha, round(alpha / s, 6) AS mean, round(c / s, 6) AS vacuity, round(ln(alpha), 6) AS logit FROM d"))
def dirichlet_stats(spark, sf):
    d = metrics.dirichlet(probs(spark, sf), 10.0)
    return d.select("id", "cls", *[R6(c).alias(c) for c in ("alpha", "mean", "vacuity", "logit")])


@query("vacuity_entropy", sql(DIR + " SELECT round(avg(v), 6) AS vacuity, round(avg(h), 6) AS entropy FROM (SELECT id, max(c / s) AS v, sum(-(alpha / s) * ln(alpha / s)) AS h FROM d GROUP BY id)"))
def vacuity_entropy(spark, sf):
    d = metrics.dirichlet(probs(spark, sf), 10.0)
    per = d.groupBy("id").agg(F.max("vacuity").alias("v"), F.sum(-F.col("mean") * F.log("mean")).alias("h"))
    return per.agg(R6(F.avg("v")).alias("vacuity"), R6(F.avg("h")).alias("entropy"))


@query("error_auroc", sql(AUROC.format(src="(SELECT 0 AS cls, CASE WHEN pred <> y THEN 0 ELSE 1 END AS y, round(1 - conf, 9) AS p FROM pred)") + " SELECT round(auroc, 6) AS auroc FROM au"))
def error_auroc(spark, sf):
    p = metrics.predictions(probs(spark, sf)).select(F.lit(0).alias("all"), F.round(1 - F.col("conf"), 9).alias("score"), (F.col("pred") != F.col("y")).alias("positive"))
    return metrics.mid_rank_auroc(p, ["all"]).select(R6("auroc").alias("auroc"))


@query("evidence_scale")
def evidence_scale(spark, sf):
    """Fitted on the calibration half, with the loss of the Dirichlet mean on the other half."""
    p = kept_probs(spark, sf)
    scale = fits.fit_evidence_scale(p.where(F.col("id") % 2 == 0))
    mean = metrics.dirichlet(p.where(F.col("id") % 2 == 1), scale)
    return mean.where("y = cls").agg(F.avg(-F.log("mean")).alias("nll")).select(F.lit(scale).alias("scale"), "nll")


# --- hashes: the signs of the 64 dimensions -------------------------------------------------------------------------

DIST = 18
HASH_SQL = """WITH RECURSIVE h AS (SELECT vec_id AS id, label AS y,
  list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(32 - i AS INTEGER) ELSE CAST(0 AS BIGINT) END)) AS hi,
  list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(64 - i AS INTEGER) ELSE CAST(0 AS BIGINT) END)) AS lo FROM embeddings),
pairs AS (SELECT a.id AS a, b.id AS b, bit_count(xor(CAST(a.hi AS BIGINT), CAST(b.hi AS BIGINT))) + bit_count(xor(CAST(a.lo AS BIGINT), CAST(b.lo AS BIGINT))) AS d FROM h a JOIN h b ON a.id < b.id)"""


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y"), S.sign_hash(F.col("embedding")).alias("hash"))


@query("hamming_pairs", HASH_SQL + f" SELECT a, b, CAST(d AS INTEGER) AS d FROM pairs WHERE d <= {DIST}")
def hamming_pairs(spark, sf):
    return hamming.hamming_pairs(hashes(spark, sf), DIST).select("a", "b", "d")


@query("hamming_pairs_strict", HASH_SQL + " SELECT a, b, CAST(d AS INTEGER) AS d FROM pairs WHERE d <= 6")
def hamming_pairs_strict(spark, sf):
    return hamming.hamming_pairs(hashes(spark, sf), 6).select("a", "b", "d")


@query("near_dup_filter", HASH_SQL + f""" SELECT id FROM h x WHERE substr(md5('0:' || id), 1, 1) < '4' AND NOT EXISTS (SELECT 1 FROM h r WHERE NOT substr(md5('0:' || r.id), 1, 1) < '4'
 AND bit_count(xor(CAST(x.hi AS BIGINT), CAST(r.hi AS BIGINT))) + bit_count(xor(CAST(x.lo AS BIGINT), CAST(r.lo AS BIGINT))) <= {DIST})""")
def near_dup_filter(spark, sf):
    h = hashes(spark, sf)
    is_query = F.substring(S.seeded_order(0, F.col("id")), 1, 1) < "4"
    return hamming.near_duplicate_anti_join(h.where(is_query), h.where(~is_query), DIST).select("id")


@query("band_join_equiv", HASH_SQL + " SELECT count(*) AS pairs, CAST(coalesce(sum(d), 0) AS BIGINT) AS bits FROM pairs WHERE d <= 16")
def band_join_equiv(spark, sf):
    return hamming.banded_pairs(hashes(spark, sf), 16).agg(F.count("*").alias("pairs"), F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("bits"))


COMPONENTS = f""", e AS (SELECT a, b FROM pairs WHERE d <= {DIST} UNION SELECT b, a FROM pairs WHERE d <= {DIST}),
reach(id, c) AS (SELECT id, id FROM h UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)"""


@query("hamming_components", HASH_SQL + COMPONENTS + " SELECT id, c AS component FROM comp")
def hamming_components(spark, sf):
    return hamming.hash_components(hashes(spark, sf), DIST).select("id", "component")


@query("redundancy_summary", HASH_SQL + COMPONENTS + f""" SELECT count(*) AS n, count(DISTINCT c) AS clusters, count(*) - count(DISTINCT c) AS redundant,
 (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM pairs WHERE d <= {DIST} UNION ALL SELECT b FROM pairs WHERE d <= {DIST})) AS with_neighbour FROM comp""")
def redundancy_summary(spark, sf):
    return hamming.redundancy(hashes(spark, sf), DIST)


@query("nn_histogram", HASH_SQL + ", nn AS (SELECT x, least(32, min(d)) AS d FROM (SELECT a AS x, d FROM pairs UNION ALL SELECT b, d FROM pairs) GROUP BY x) SELECT CAST(d AS INTEGER) AS d, count(*) AS n FROM nn GROUP BY d")
def nn_histogram(spark, sf):
    return hamming.nearest_histogram(hashes(spark, sf))


# --- vectors --------------------------------------------------------------------------------------------------------


WEIGHTED = "list_sum(list_transform(range(1, len({v}) + 1), lambda i: i * {v}[i]))"


def weighted(v) -> Column:
    """A sum over a whole vector that tells its components apart: i times the i-th."""
    return F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


@query("layernorm_pool", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
m AS (SELECT vec_id, v, list_sum(v) / len(v) AS m FROM e), s AS (SELECT vec_id, v, m, list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v) AS s FROM m),
l AS (SELECT vec_id, list_transform(v, lambda x: (x - m) / sqrt(s + CAST(1e-5 AS DOUBLE))) AS n FROM s)
SELECT vec_id, round(n[1], 6) AS first, round({WEIGHTED.format(v='n')}, 4) AS weighted FROM l""")
def layernorm_pool(spark, sf):
    n = S.layer_norm(S.doubles(F.col("embedding")))
    return table(spark, sf, "embeddings").select("vec_id", n.alias("n")).select("vec_id", R6(F.element_at("n", 1)).alias("first"), F.round(weighted("n"), 4).alias("weighted"))


@query("token_pool", """WITH t AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings)
SELECT vec_id, CAST((i - 1) % 4 AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM t GROUP BY ALL""")
def token_pool(spark, sf):
    """A vector as tokens of four numbers each, and their mean."""
    v = S.doubles(F.col("embedding"))
    tokens = F.transform(F.sequence(F.lit(0), (F.size(v) / 4).cast("int") - 1), lambda i: F.slice(v, i * 4 + 1, F.lit(4)))
    pooled = table(spark, sf, "embeddings").select("vec_id", F.posexplode(S.mean_pool(tokens)).alias("dim", "mean"))
    return pooled.select("vec_id", "dim", R6("mean").alias("mean"))


@query("softmax_rows", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS v FROM embeddings),
p AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS p FROM e)
SELECT vec_id, round(p[1], 6) AS p, round({WEIGHTED.format(v='p')}, 4) AS weighted FROM p""")
def softmax_rows(spark, sf):
    p = table(spark, sf, "embeddings").select("vec_id", S.softmax(S.doubles(F.col("embedding"))).alias("p"))
    return p.select("vec_id", R6(F.element_at("p", 1)).alias("p"), F.round(weighted("p"), 4).alias("weighted"))


@query("as_probabilities", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
q AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_transform(v, lambda x: (x * x) / list_sum(list_transform(v, lambda z: z * z))) ELSE list_transform(v, lambda x: exp(x) / list_sum(list_transform(v, lambda z: exp(z)))) END AS p FROM e)
SELECT vec_id, round({WEIGHTED.format(v='p')}, 3) AS weighted FROM q""")
def as_probabilities(spark, sf):
    """Squares over their sum are probabilities already; the vectors themselves are not."""
    v = S.doubles(F.col("embedding"))
    x = F.when(F.col("vec_id") % 2 == 0, F.transform(v, lambda a: a * a / S.dot(v, v))).otherwise(v)
    p = table(spark, sf, "embeddings").select("vec_id", x.alias("x")).select("vec_id", S.as_probabilities(F.col("x")).alias("p"))
    return p.select("vec_id", F.round(weighted("p"), 3).alias("weighted"))


@query("variance_hinge", """WITH x AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
p AS (SELECT dim, var_samp(CAST(x AS DOUBLE)) AS v FROM x GROUP BY dim) SELECT round(avg(greatest(0, 1 - sqrt(v + CAST(1e-4 AS DOUBLE)))), 6) AS hinge FROM p""")
def variance_hinge(spark, sf):
    return fits.variance_hinge(table(spark, sf, "embeddings"), "embedding").select(R6("hinge").alias("hinge"))


DIRECTIONS = [[1.0 if j == i else 0.0 for j in range(64)] for i in (0, 7, 31)] + [[0.125] * 64]
POINTS = [0.5, 1.0, 2.0]


@query("sigreg_fixed_dirs", f"""WITH p AS (SELECT 0 AS dir, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings UNION ALL SELECT 1, embedding[8] FROM embeddings UNION ALL SELECT 2, embedding[32] FROM embeddings
UNION ALL SELECT 3, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(0.125 AS DOUBLE))) FROM embeddings)
SELECT CAST(dir AS INTEGER) AS dir, t, round(avg(cos(t * x)), 6) AS re, round(avg(sin(t * x)), 6) AS im, round(max(exp(-t * t / 2)), 6) AS normal FROM p CROSS JOIN (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in POINTS)}) ts(t) GROUP BY dir, t""")
def sigreg_fixed_dirs(spark, sf):
    s = fits.sigreg(table(spark, sf, "embeddings"), DIRECTIONS, POINTS, "embedding")
    return s.select("dir", "t", R6("re").alias("re"), R6("im").alias("im"), R6("normal").alias("normal"))


@query("effective_rank")
def effective_rank(spark, sf):
    return spark.createDataFrame([(round(fits.effective_rank(table(spark, sf, "embeddings"), "embedding"), 6),)], "effective_rank double")
