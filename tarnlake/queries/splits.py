"""Queries that build evaluation tasks: labels, splits, caps, matches, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import scalars as S
from tarnlake.operators import splits
from tarnlake.session import table
from tarnlake.sources.records import voc_boxes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y"))


@query("canonical_classes", "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 20) SELECT source, n, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS index FROM n")
def canonical_classes(spark, sf):
    return splits.canonical_classes(table(spark, sf, "documents"), "source", 20)


SPLIT = """WITH r AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS y, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
q AS (SELECT *, greatest(1, round_even(CAST(0.6 AS DOUBLE) * n, 0)) AS nr, round_even(CAST(0.15 AS DOUBLE) * n, 0) AS nc FROM r),
s AS (SELECT id, y, CASE WHEN k <= nr THEN 'reference' WHEN k <= nr + nc THEN 'cal' ELSE 'query' END AS split FROM q)"""


@query("stratified_split", SPLIT + " SELECT id, y, split FROM s")
def stratified_split(spark, sf):
    return splits.stratified_split(vectors(spark, sf), "y", "id")


@query("split_sizes", SPLIT + " SELECT y, split, count(*) AS n FROM s GROUP BY y, split")
def split_sizes(spark, sf):
    return splits.stratified_split(vectors(spark, sf), "y", "id").groupBy("y", "split").agg(F.count("*").alias("n"))


@query("split_semi_join", SPLIT + """, c AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i FROM (SELECT y FROM s GROUP BY y HAVING count(*) >= 30))
SELECT s.id, CAST(c.i AS INTEGER) AS cls FROM s JOIN c USING (y) WHERE split = 'query'""")
def split_semi_join(spark, sf):
    v = vectors(spark, sf)
    members = splits.stratified_split(v, "y", "id").where("split = 'query'")
    classes = splits.canonical_classes(v, "y", 30)
    return v.join(members.select("id"), "id", "left_semi").join(classes, "y").select("id", F.col("index").alias("cls"))


QUOTAS = {"train": 12, "val": 5, "test": 3}


def _positions() -> str:
    return ", ".join(f"({i}, '{p}')" for i, p in enumerate(splits.quota_order(QUOTAS), 1))


@query("grouped_split", f"""WITH g AS (SELECT n_name, min(n_regionkey) AS region FROM nation GROUP BY n_name), r AS (SELECT *, row_number() OVER (ORDER BY region, md5('0:' || n_name), n_name) AS pos FROM g)
SELECT n_name, region, part FROM r JOIN (VALUES {_positions()}) q(pos, part) USING (pos)""")
def grouped_split(spark, sf):
    n = table(spark, sf, "nation").select("n_name", F.col("n_regionkey").alias("region"))
    return splits.grouped_split(n, "n_name", "region", QUOTAS)


@query("class_cap", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 25")
def class_cap(spark, sf):
    return splits.class_cap(table(spark, sf, "documents"), "lang", ["doc_id"], 25).select("doc_id", "lang")


@query("stride_sample", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE (k - 1) % 10 = 0")
def stride_sample(spark, sf):
    return splits.stride_sample(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 10).select("event_id", "user_id")


@query("neg_pos_cap", "WITH p AS (SELECT count(*) AS n FROM labels WHERE toxic = 1), n AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS k FROM labels WHERE toxic = 0) SELECT doc_id, 1 AS toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 0 FROM n, p WHERE k <= 2 * greatest(1, p.n)")
def neg_pos_cap(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return splits.negative_cap(rows, "toxic", "doc_id", 2)


@query("per_group_cap", "SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5('0:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 3")
def per_group_cap(spark, sf):
    return splits.group_cap(table(spark, sf, "documents"), ["source", "lang"], "doc_id", 3).select("source", "lang", "doc_id")


@query("balanced_subset", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS k, (SELECT count(DISTINCT source) FROM documents) AS s FROM documents)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY md5('0:all:' || doc_id), doc_id) AS j FROM r WHERE k <= greatest(1, 110 // s)) WHERE j <= 110""")
def balanced_subset(spark, sf):
    return splits.balanced_subset(table(spark, sf, "documents"), "source", "doc_id", 110).select("doc_id", "source")


@query("support_query", "SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('0:' || id), id) <= 40 THEN 'support' ELSE 'query' END AS role FROM (SELECT vec_id AS id FROM embeddings)")
def support_query(spark, sf):
    return splits.support_query(vectors(spark, sf).select("id"), "id", 40)


@query("sampled_stream", """WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents)), d AS (SELECT r.id AS draw, CAST('0x' || substr(md5('0:' || r.id), 1, 12) AS BIGINT) % (SELECT count(*) FROM s) AS i FROM range(6) r(id))
SELECT draw, source, count(*) AS n FROM d JOIN s USING (i) JOIN documents USING (source) GROUP BY draw, source""")
def sampled_stream(spark, sf):
    return splits.sampled_stream(table(spark, sf, "documents"), "source", "doc_id", 6).groupBy("draw", "source").agg(F.count("*").alias("n"))


@query("label_left_join_fallback", "SELECT doc_id, coalesce('q' || quality, CASE WHEN lang = 'en' THEN 'lang-en' END) AS finding FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce('q' || quality, CASE WHEN lang = 'en' THEN 'lang-en' END) IS NOT NULL")
def label_left_join_fallback(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("finding"))
    return splits.labelled(table(spark, sf, "documents").select("doc_id", "lang"), labels, "doc_id", "finding", F.when(F.col("lang") == "en", "lang-en")).select("doc_id", "finding")


@query("task_labels", """WITH t AS (SELECT p_partkey, lower(replace(trim(p_type), ' ', '-')) AS finding, CASE WHEN p_size % 2 = 0 THEN 'upper-gi' ELSE 'lower-gi' END AS tract, CASE WHEN p_size % 3 = 0 THEN 'pathological-findings' ELSE 'landmarks' END AS category FROM part)
SELECT p_partkey, finding, category, CASE WHEN starts_with(tract, 'upper') THEN 'upper' ELSE 'lower' END AS tract, CASE WHEN category = 'pathological-findings' THEN 'pathological' ELSE 'other' END AS pathology FROM t""")
def task_labels(spark, sf):
    p = table(spark, sf, "part")
    tract = F.when(F.col("p_size") % 2 == 0, "upper-gi").otherwise("lower-gi")
    category = F.when(F.col("p_size") % 3 == 0, "pathological-findings").otherwise("landmarks")
    finding = S.normal_label(F.col("p_type"))
    return p.select("p_partkey", *[S.task_label(t, tract, category, finding).alias(t) for t in ("finding", "category", "tract", "pathology")])


@query("path_labels", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'upper-gi' ELSE 'lower-gi' END AS tract, 'c' || p_size AS category, p_brand AS finding FROM part")
def path_labels(spark, sf):
    p = table(spark, sf, "part")
    path = F.concat_ws("/", F.when(F.col("p_size") % 2 == 0, "upper-gi-tract").otherwise("lower-gi-tract"), F.concat(F.lit("c"), F.col("p_size").cast("string")), "p_brand", F.lit("x.jpg"))
    tract, category, finding = S.path_labels(path)
    return p.select("p_partkey", tract.alias("tract"), category.alias("category"), finding.alias("finding"))


@query("histology_labels", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 0 ELSE -1 END AS y FROM part")
def histology_labels(spark, sf):
    x = F.element_at(F.array(*map(F.lit, (" ad", "Hp ", "other"))), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(S.histology_label(x, ("AD",), ("HP",)), F.lit(-1)).alias("y"))


@query("fuzzy_first_match", """WITH a AS (SELECT s_suppkey, 'x_' || s_suppkey % 40 AS name FROM supplier), b AS (SELECT n_nationkey AS ord, CASE WHEN n_nationkey % 3 = 0 THEN 'x_' || n_nationkey WHEN n_nationkey % 3 = 1 THEN 'pre_x_' || n_nationkey ELSE CAST(n_nationkey AS VARCHAR) END AS m FROM nation),
u AS (SELECT DISTINCT name FROM a),
p AS (SELECT name, m, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN name = m THEN 0 ELSE 1 END, ord) AS k FROM u JOIN b ON ends_with(name, m) OR ends_with(m, name) OR regexp_extract(name, '([^_]*)$', 1) = regexp_extract(m, '([^_]*)$', 1))
SELECT s_suppkey, a.name, coalesce(m, '') AS match FROM a LEFT JOIN p ON p.name = a.name AND k = 1""")
def fuzzy_first_match(spark, sf):
    a = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("x_"), (F.col("s_suppkey") % 40).cast("string")).alias("name"))
    k = F.col("n_nationkey").cast("string")
    m = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("x_"), k)).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("pre_x_"), k)).otherwise(k)
    b = table(spark, sf, "nation").select(m.alias("name"), F.col("n_nationkey").alias("ord"))
    best = splits.first_match(a.select("name").distinct(), b, "name", "ord")
    return a.join(best, "name").select("s_suppkey", "name", F.coalesce("match", F.lit("")).alias("match"))


BOXES = """WITH b AS (SELECT l_orderkey, l_quantity AS q, l_linenumber AS n, l_suppkey % 100 AS x0, l_partkey % 80 AS y0 FROM lineitem)"""


@query("xml_boxes", BOXES + " SELECT l_orderkey, count(*) AS boxes, CAST(sum(x0 + q) AS BIGINT) AS right_edges FROM b GROUP BY l_orderkey")
def xml_boxes(spark, sf):
    """Annotations written as XML and parsed back."""
    b = table(spark, sf, "lineitem")
    x, y, q = F.col("l_suppkey") % 100, F.col("l_partkey") % 80, F.col("l_quantity")
    shape = "<object><name>lesion</name><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>"
    box = F.format_string(shape, x, y, (x + q).cast("long"), (y + q).cast("long"))
    head = F.lit("<annotation><size><width>640</width><height>480</height></size>")
    xml = b.groupBy("l_orderkey").agg(F.concat(head, F.array_join(F.collect_list(box), ""), F.lit("</annotation>")).alias("xml"))
    out = xml.select("l_orderkey", voc_boxes(F.col("xml")).alias("boxes"))
    return out.select("l_orderkey", F.size("boxes").cast("long").alias("boxes"), F.aggregate(F.transform("boxes", lambda x: x.x1.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("right_edges"))


@query("box_area_filter", BOXES + ", a AS (SELECT l_orderkey, max(q * (q + n)) / CAST(4096 AS DOUBLE) AS share FROM b GROUP BY l_orderkey) SELECT l_orderkey, round(share, 6) AS share FROM a WHERE share >= CAST(0.5 AS DOUBLE)")
def box_area_filter(spark, sf):
    b = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("l_quantity").alias("x1"), (F.col("l_quantity") + F.col("l_linenumber")).alias("y1"))).alias("boxes"))
    share = S.largest_box_share(F.col("boxes"), F.lit(64), F.lit(64))
    return b.select("l_orderkey", F.round(share, 6).alias("share")).where(share >= 0.5)


@query("crop_geometry", """WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x0, CAST(p_size * 2 AS DOUBLE) AS y0, p_size + p_retailprice / 20 AS x1, p_size * 2 + p_retailprice / 40 AS y1 FROM part),
c AS (SELECT p_partkey, greatest(0, CAST(trunc(x0 - CAST(0.2 AS DOUBLE) * (x1 - x0)) AS INTEGER)) AS cx0, greatest(0, CAST(trunc(y0 - CAST(0.2 AS DOUBLE) * (y1 - y0)) AS INTEGER)) AS cy0, least(120, CAST(trunc(x1 + CAST(0.2 AS DOUBLE) * (x1 - x0)) AS INTEGER)) AS cx1, least(100, CAST(trunc(y1 + CAST(0.2 AS DOUBLE) * (y1 - y0)) AS INTEGER)) AS cy1 FROM b)
SELECT * FROM c WHERE cx1 - cx0 >= 8 AND cy1 - cy0 >= 8""")
def crop_geometry(spark, sf):
    s, r = F.col("p_size").cast("double"), F.col("p_retailprice")
    box = S.crop_box(s, s * 2, s + r / 20, s * 2 + r / 40, F.lit(120), F.lit(100), 0.2)
    return table(spark, sf, "part").select("p_partkey", box.alias("b")).where("b is not null").select("p_partkey", "b.cx0", "b.cy0", "b.cx1", "b.cy1")


@query("resize_geometry", """WITH d AS (SELECT p_partkey, 200 + p_size * 7 AS w, 180 + p_partkey % 500 AS h FROM part), s AS (SELECT *, CAST(224 AS DOUBLE) / least(w, h) AS s FROM d)
SELECT p_partkey, CAST(CASE WHEN s < 1 THEN greatest(224, round_even(w * s, 0)) ELSE w END AS INTEGER) AS nw, CAST(CASE WHEN s < 1 THEN greatest(224, round_even(h * s, 0)) ELSE h END AS INTEGER) AS nh FROM s""")
def resize_geometry(spark, sf):
    w, h = (200 + F.col("p_size") * 7), (180 + F.col("p_partkey") % 500)
    return table(spark, sf, "part").select("p_partkey", S.resized(w, w, h, 224).alias("nw"), S.resized(h, w, h, 224).alias("nh"))


@query("video_prevalence", "SELECT c_custkey, CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS prevalent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON c_custkey = o_custkey")
def video_prevalence(spark, sf):
    n = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.when(F.coalesce("n", F.lit(0)) > 0, 1).otherwise(0).alias("prevalent"))


@query("frame_annotations", "SELECT o_orderkey, CAST(coalesce(n, 0) AS INTEGER) AS boxes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey")
def frame_annotations(spark, sf):
    boxes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("boxes"))
    return table(spark, sf, "orders").select("o_orderkey").join(boxes, "o_orderkey", "left").select("o_orderkey", F.size(F.coalesce("boxes", F.array().cast("array<int>"))).alias("boxes"))


@query("frame_scan", "SELECT lpad(CAST(l_suppkey % 7 AS VARCHAR), 3, '0') || '-001' AS video, count(*) AS frames, CAST(max(l_linenumber) AS INTEGER) AS last FROM lineitem GROUP BY 1")
def frame_scan(spark, sf):
    """Frames found by path: video folder and frame number."""
    path = F.format_string("root/%03d-001/img_%d.jpg", (F.col("l_suppkey") % 7).cast("int"), F.col("l_linenumber"))
    rows = table(spark, sf, "lineitem").select(path.alias("path")).where(S.has_extension(F.col("path"), (".jpeg", ".jpg", ".png")))
    return rows.groupBy(S.video_name(F.col("path")).alias("video")).agg(F.count("*").alias("frames"), F.max(S.frame_number(F.col("path"))).alias("last"))


@query("pair_join", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def pair_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "quality")


@query("class_drop_counts", SPLIT + " SELECT y, count(*) AS dropped FROM s WHERE split <> 'reference' AND id NOT IN (SELECT id FROM s WHERE id % 4 = 0) GROUP BY y")
def class_drop_counts(spark, sf):
    s = splits.stratified_split(vectors(spark, sf), "y", "id")
    return s.where("split <> 'reference'").join(s.where("id % 4 = 0").select("id"), "id", "left_anti").groupBy("y").agg(F.count("*").alias("dropped"))


@query("archive_sample", "WITH s AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('11:' || source), source LIMIT 6) SELECT doc_id, source FROM documents JOIN s USING (source)")
def archive_sample(spark, sf):
    return splits.whole_archives(table(spark, sf, "documents"), "source", 6, 11).select("doc_id", "source")
