"""The registered queries of the engine's own operators, and their SQL.

Rows of embeddings stand for images: each vector is a descriptor, its sixteen runs of four values are local
descriptors on a 4 x 4 grid, and label is the group. Every fifth vector has a twin, a slightly moved copy under
another name, so that true pairs exist. documents stand for files, orders and events for runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgraph.functions import kernels
from pairgraph.functions import text as tx
from pairgraph.functions import vectors as vx
from pairgraph.operators import audit, candidates, decisions, evidence, grouping, partitions
from pairgraph.operators.components import connected_components
from pairgraph.plans import image_runs, registry, sweep
from pairgraph.plans.config import GroupingConfig, StateConfig, StructuralConfig, shipped_config
from pairgraph.plans.store import materialize, shared_dir
from pairgraph.sources.scenes import write_scenes
from pairgraph.sources.sinks import Memo, write_predictions
from pairgraph.sources.tables import discover_images, read_groups

SMALL_STATES = replace(
    StateConfig(), negative_min_keypoints=16, negative_min_mutual_matches=4, strong_min_inliers=4, positive_min_inliers=4
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- stand-in tables -------------------------------------------------------------------------------------------

PLAIN = "plain AS (SELECT vec_id, 'img_' || lpad(vec_id::VARCHAR, 6, '0') || '.jpg' AS filename, label::VARCHAR AS group_id, embedding::DOUBLE[] AS v FROM embeddings)"
TWINS = f"""{PLAIN},
moved AS (SELECT vec_id, 'img_' || lpad(vec_id::VARCHAR, 6, '0') || '_t.jpg' AS filename, 'g' || vec_id AS group_id,
  list_transform(range(1, 65), lambda k: 0.6::DOUBLE * v[k] + 0.02::DOUBLE * (((31 * vec_id + 17 * (k - 1)) % 13) - 6) / 6.0::DOUBLE) AS v FROM plain WHERE vec_id % 5 = 0),
img AS (SELECT vec_id, filename, 'g' || vec_id AS group_id, v FROM plain
  UNION ALL SELECT vec_id, filename, group_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) FROM moved)"""
DIST = """dist AS (SELECT a.filename AS l, b.filename AS r,
  round(1.0::DOUBLE - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])))), 9) AS d
  FROM {t} a JOIN {t} b ON a.filename <> b.filename)"""
TOPK = 'ranked AS (SELECT *, rank() OVER (PARTITION BY l ORDER BY d) AS rk FROM dist), pairs AS (SELECT DISTINCT least(l, r) AS "left", greatest(l, r) AS "right" FROM ranked WHERE rk <= 12)'
PAIRS = f"{TWINS}, {DIST.format(t='img')}, {TOPK}"


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("img_"), F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(".jpg"))
    return e.select("vec_id", name.alias("filename"), F.col("label").cast("string").alias("group_id"), vx.doubles(F.col("embedding")).alias("descriptor"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and the twins of every fifth one; a vector and its twin are one group."""
    p = plain(spark, sf_dir).withColumn("group_id", F.concat(F.lit("g"), "vec_id"))
    shift = F.expr("transform(sequence(0, 63), k -> cast(0.02 as double) * (((31 * vec_id + 17 * k) % 13) - 6) / cast(6.0 as double))")
    moved = F.zip_with("descriptor", shift, lambda x, s: F.lit(0.6) * x + s)
    twins = p.where("vec_id % 5 = 0").select("vec_id", F.regexp_replace("filename", r"\.jpg$", "_t.jpg").alias("filename"), "group_id", vx.unit(moved).alias("descriptor"))
    return p.unionByName(twins)


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(candidates.unordered(candidates.top_k_neighbours(images(spark, sf_dir), 12)), "pairs")


def local(img: DataFrame, view: str = "raw") -> DataFrame:
    """Sixteen local descriptors of each image, on a 4 x 4 grid over 64 x 64 pixels."""
    v = F.col("descriptor") if view == "raw" else vx.stretch(F.col("descriptor"), 1, 99, None)
    parts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("v", i * 4 + 1, 4))
    e = img.select("filename", v.alias("v")).select("filename", F.posexplode(parts).alias("no", "descriptor"))
    return e.select(F.lit(view).alias("view"), "filename", F.col("no").cast("long").alias("no"), (F.col("no") % 4 * 16 + 8).cast("double").alias("x"), (F.floor(F.col("no") / 4) * 16 + 8).cast("double").alias("y"), "descriptor")


def measured(spark: SparkSession, sf_dir: str, views: tuple[str, ...] = ("raw",)) -> DataFrame:
    """Evidence of the candidate pairs in each view, with the correlation of whole vectors as the structural one."""
    img, pairs = images(spark, sf_dir), pairs_of(spark, sf_dir)
    ev = evidence.descriptor_evidence(pairs, reduce(DataFrame.unionByName, [local(img, v) for v in views]))
    l, r = img.select(F.col("filename").alias("left"), F.col("descriptor").alias("dl")), img.select(F.col("filename").alias("right"), F.col("descriptor").alias("dr"))
    corr = pairs.join(l, "left").join(r, "right").select("left", "right", F.round(vx.pearson(F.col("dl"), F.col("dr")), 9).alias("structural_correlation"))
    return ev.join(corr, ["left", "right"])


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of both views."""
    return decisions.classify(measured(spark, sf_dir, ("raw", "stretched")), SMALL_STATES).withColumn("score", F.round("score", 6))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.fuse(decided(spark, sf_dir))


# --- the same in SQL -------------------------------------------------------------------------------------------


def local_sql(view: str, name: str) -> str:
    v = "v"
    if view != "raw":
        v = """list_transform(v, lambda x: CASE WHEN quantile_hi - quantile_lo <= 1e-12 THEN x ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (x - quantile_lo) / (quantile_hi - quantile_lo))) END)"""
    source = "img" if view == "raw" else """(SELECT *, s[1] + (s[2] - s[1]) * 0.63::DOUBLE AS quantile_lo, s[63] + (s[64] - s[63]) * (62.37::DOUBLE - 62) AS quantile_hi FROM (SELECT *, list_sort(v) AS s FROM img))"""
    return f"""{name}_v AS (SELECT filename, {v} AS v FROM {source}),
{name} AS (SELECT filename, no, (no % 4 * 16 + 8)::DOUBLE AS x, (no // 4 * 16 + 8)::DOUBLE AS y, v[no * 4 + 1 : no * 4 + 4] AS q FROM {name}_v, range(0, 16) t(no))"""


def matches_sql(kp: str, p: str) -> str:
    """CTEs of matches and evidence with the prefix p over the keypoints kp."""
    return f"""
{p}d AS (SELECT "left", "right", a.no AS q, b.no AS t, a.x AS lx, a.y AS ly, b.x AS rx, b.y AS ry,
  round(sqrt((a.q[1]-b.q[1])*(a.q[1]-b.q[1]) + (a.q[2]-b.q[2])*(a.q[2]-b.q[2]) + (a.q[3]-b.q[3])*(a.q[3]-b.q[3]) + (a.q[4]-b.q[4])*(a.q[4]-b.q[4])), 9) AS dd
  FROM pairs JOIN {kp} a ON a.filename = "left" JOIN {kp} b ON b.filename = "right"),
{p}f AS (SELECT * FROM (SELECT *, row_number() OVER w AS rn, lead(dd) OVER w AS nx FROM {p}d WINDOW w AS (PARTITION BY "left", "right", q ORDER BY dd, t)) WHERE rn = 1 AND nx IS NOT NULL AND dd < 0.78::DOUBLE * nx),
{p}b AS (SELECT * FROM (SELECT *, row_number() OVER w AS rn, lead(dd) OVER w AS nx FROM {p}d WINDOW w AS (PARTITION BY "left", "right", t ORDER BY dd, q)) WHERE rn = 1 AND nx IS NOT NULL AND dd < 0.78::DOUBLE * nx),
{p}m AS (SELECT * FROM {p}f WHERE ("left", "right", q, t) IN (SELECT ("left", "right", q, t) FROM {p}b)),
{p}cnt AS (SELECT "left", "right", (SELECT count(*) FROM {p}f f WHERE f."left" = p."left" AND f."right" = p."right") AS nf,
  (SELECT count(*) FROM {p}b f WHERE f."left" = p."left" AND f."right" = p."right") AS nb,
  (SELECT count(*) FROM {p}m f WHERE f."left" = p."left" AND f."right" = p."right") AS nm FROM pairs p),
{p}s AS (SELECT "left", "right", count(*) AS n, sum(lx) AS slx, sum(ly) AS sly, sum(rx) AS srx, sum(ry) AS sry, sum(lx*lx+ly*ly) AS sll,
  sum(lx*rx+ly*ry) AS sd, sum(lx*ry-ly*rx) AS sc FROM {p}m GROUP BY ALL),
{p}ab AS (SELECT *, (sd - (slx*srx + sly*sry)/n)/den AS a, (sc - (slx*sry - sly*srx)/n)/den AS b FROM (SELECT *, sll - (slx*slx + sly*sly)/n AS den FROM {p}s) WHERE n >= 4 AND den > 1e-9),
{p}fit AS (SELECT "left", "right", n, a, b, (srx - a*slx + b*sly)/n AS tx, (sry - b*slx - a*sly)/n AS ty FROM {p}ab WHERE a*a + b*b > 1e-12),
{p}e AS (SELECT m.*, a, b, tx, ty, round((fw + fw / sqrt(a*a + b*b)) * 0.5, 9) AS error FROM (
  SELECT m.*, a, b, tx, ty, sqrt((a*lx - b*ly + tx - rx)*(a*lx - b*ly + tx - rx) + (b*lx + a*ly + ty - ry)*(b*lx + a*ly + ty - ry)) AS fw
  FROM {p}m m JOIN {p}fit USING ("left", "right")) m),
{p}in AS (SELECT "left", "right", count(*) AS inliers, median(error) AS med,
  count(DISTINCT [least(floor(lx/64*4), 3), least(floor(ly/64*4), 3)]) / 16.0::DOUBLE AS gl, count(DISTINCT [least(floor(rx/64*4), 3), least(floor(ry/64*4), 3)]) / 16.0::DOUBLE AS gr
  FROM {p}e WHERE error <= 4.0 GROUP BY ALL),
{p}corr AS (SELECT "left", "right", round((SELECT greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (sab - sa*sb/64)/sqrt((saa - sa*sa/64)*(sbb - sb*sb/64)))) FROM (SELECT
   list_sum(a.v) AS sa, list_sum(b.v) AS sb, list_sum(list_transform(a.v, lambda x: x*x)) AS saa, list_sum(list_transform(b.v, lambda x: x*x)) AS sbb,
   list_sum(list_transform(range(1, 65), lambda i: a.v[i]*b.v[i])) AS sab)), 9) AS corr
  FROM pairs JOIN img a ON a.filename = "left" JOIN img b ON b.filename = "right"),
{p}ev AS (SELECT c."left", c."right", 16 AS lk, 16 AS rk, nf, nb, nm, inliers IS NOT NULL AS mf, coalesce(inliers, 0) AS inl,
  CASE WHEN inliers IS NOT NULL THEN inliers / nm::DOUBLE ELSE 0.0::DOUBLE END AS ratio, med, coalesce(gl, 0) AS gl, coalesce(gr, 0) AS gr, coalesce(least(gl, gr), 0) AS cov,
  CASE WHEN inliers IS NOT NULL THEN sqrt(a*a + b*b) END AS scale, CASE WHEN inliers IS NOT NULL THEN degrees(atan2(b, a)) END AS rot,
  CASE WHEN inliers IS NOT NULL THEN sqrt((tx/64)*(tx/64) + (ty/64)*(ty/64)) END AS shift, corr
  FROM {p}cnt c LEFT JOIN {p}fit USING ("left", "right") LEFT JOIN {p}in USING ("left", "right") JOIN {p}corr USING ("left", "right")),
{p}st AS (SELECT *, coalesce(mf AND scale BETWEEN 0.82 AND 1.22 AND abs(rot) <= 6 AND shift <= 0.18, false) AS fits,
  (least(1.0, inl / 4.0) + least(1.0, ratio / 0.35::DOUBLE) + least(1.0, cov / 0.125::DOUBLE) + greatest(0.0, least(1.0, (coalesce(corr, -1.0) + 1.0) / 2.0))
    + greatest(0.0, coalesce(1.0 - med / 4.0::DOUBLE, 0.0))) / 5.0 AS score FROM {p}ev),
{p}dec AS (SELECT *, CASE
  WHEN fits AND inl >= 4 AND ratio >= 0.35 AND cov >= 0.125 AND coalesce(med <= 2.5, false) AND coalesce(corr, -1) >= 0.2 THEN 'strong_positive'
  WHEN fits AND inl >= 4 AND ratio >= 0.22 AND cov >= 0.0625 AND coalesce(med <= 4.0, false) AND coalesce(corr, -1) >= 0.05 THEN 'positive'
  WHEN least(lk, rk) >= 16 AND nm >= 4 AND (NOT mf OR ratio <= 0.08 OR (NOT fits AND coalesce(corr, -1) <= 0)) THEN 'negative'
  ELSE 'unknown' END AS state FROM {p}st)"""


RAW = f"{PAIRS}, {local_sql('raw', 'kp')}, {matches_sql('kp', 'a_')}"
FUSED = f"""{RAW}, {local_sql('stretched', 'ks')}, {matches_sql('ks', 'z_')},
views AS (SELECT "left", "right", state, round(score, 6) AS score FROM a_dec UNION ALL SELECT "left", "right", state, round(score, 6) FROM z_dec),
g AS (SELECT "left", "right", max(CASE WHEN state = 'negative' THEN score END) AS veto,
  max([CASE state WHEN 'strong_positive' THEN 2 WHEN 'positive' THEN 1 ELSE 0 END, score]) AS best FROM views GROUP BY ALL),
fused AS (SELECT "left", "right", CASE WHEN veto IS NOT NULL THEN 'negative' ELSE (['unknown', 'positive', 'strong_positive'])[(best[1] + 1)::INT] END AS state,
  CASE WHEN veto IS NOT NULL THEN veto ELSE best[2] END AS score FROM g)"""
REACH = """reach(src, dst) AS (SELECT n, n FROM nodes UNION SELECT reach.src, e.r FROM reach JOIN e ON reach.dst = e.l),
comp AS (SELECT src AS filename, min(dst) AS component FROM reach GROUP BY src)"""


# --- scans, predicates and audits ------------------------------------------------------------------------------


SCENES = """gains AS (SELECT * FROM (VALUES ('0.6'), ('1.0'), ('1.2')) t(gain)), scenes AS (SELECT lpad(i::VARCHAR, 3, '0') AS i FROM range(0, 4) t(i)),
pics AS (SELECT 's' || i || '_' || gain || '.png' AS filename, 's' || i AS scene FROM scenes, gains UNION ALL SELECT 'copy.PNG', 's000')"""


def scene_folder(spark):
    """Four generated scenes in three exposures each, a copy of a file, a file that can't be read and one that is none."""
    return write_scenes(spark, "queries", 4, odd=True)


@query(f"WITH {SCENES}, f AS (SELECT filename FROM pics UNION ALL SELECT 'broken.jpg') SELECT filename, lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) AS suffix FROM f")
def q_discover(spark, sf_dir):
    found = discover_images(spark, scene_folder(spark), content=False)
    return found.select("filename", F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1)).alias("suffix"))


@query(f"WITH {SCENES} SELECT filename, 150 AS height, 200 AS width, true AS decode_ok, true AS has_features FROM pics UNION ALL SELECT 'broken.jpg', NULL, NULL, false, false")
def q_image_features(spark, sf_dir):
    """Decoded files, and whether either view finds local features in them."""
    images = image_runs.load_images(spark, scene_folder(spark))
    pairs = candidates.all_pairs(images.where("decode_ok").select("filename"))
    config = shipped_config()
    found = [image_runs.view_evidence(images, pairs, config, v)[1].where("length(points) > 0").select("content_hash") for v in ("clahe", "percentile-clahe")]
    both = found[0].join(found[1], "content_hash").distinct().withColumn("has_features", F.lit(True))
    return images.join(both, "content_hash", "left").select("filename", "height", "width", "decode_ok", F.coalesce("has_features", F.lit(False)).alias("has_features"))


@query(f"""WITH {SCENES} SELECT a.filename AS "left", b.filename AS "right", a.scene = b.scene AS same_scene, false AS contradicted FROM pics a JOIN pics b ON a.filename < b.filename""")
def q_image_evidence(spark, sf_dir):
    """Decisions of both views fused: none contradicts the scenes."""
    run = image_runs.run_classical(image_runs.load_images(spark, scene_folder(spark)), shipped_config())
    scene = lambda c: F.when(F.col(c) == "copy.PNG", "s000").otherwise(F.substring(c, 1, 4))
    same = scene("left") == scene("right")
    wrong = F.when(same, F.col("state") == "negative").otherwise(F.col("state").isin(*decisions.POSITIVE))
    return run.decisions.select("left", "right", same.alias("same_scene"), wrong.alias("contradicted"))


@query(f"WITH {SCENES}, g AS (SELECT filename, scene FROM pics UNION ALL SELECT 'broken.jpg', 'broken.jpg'), h AS (SELECT filename, min(filename) OVER (PARTITION BY scene) AS head FROM g) SELECT filename, dense_rank() OVER (ORDER BY head) - 1 AS group_no FROM h")
def q_image_groups(spark, sf_dir):
    """The shipped run, from files to groups."""
    return image_runs.group_frame(image_runs.load_images(spark, scene_folder(spark)))


@query(f"WITH {SCENES}, g AS (SELECT filename, scene FROM pics UNION ALL SELECT 'broken.jpg', 'broken.jpg') SELECT filename, min(filename) OVER (PARTITION BY scene) AS group_id FROM g")
def q_image_structural(spark, sf_dir):
    """Components of global descriptors."""
    return image_runs.run_structural(image_runs.load_images(spark, scene_folder(spark)), StructuralConfig()).partition


@query(f"WITH {SCENES} SELECT 14 AS n_files, 1 AS undecodable, list(filename ORDER BY filename) AS copies FROM (SELECT 'copy.PNG' AS filename UNION ALL SELECT 's000_0.6.png')")
def q_image_audit(spark, sf_dir):
    files = image_runs.audit_files(spark, scene_folder(spark))
    parts = audit.audit(files, files.select("filename", F.substring("filename", 1, 4).alias("group_id")))
    counts = parts["counts"].select(F.col("n_files").cast("int").alias("n_files"), F.col("undecodable").cast("int").alias("undecodable"))
    return counts.join(parts["duplicate_content"].select(F.col("names").alias("copies")))  # a row each


FAULTY = """faulty AS (SELECT CASE WHEN vec_id % 50 = 7 THEN 'dir/x' || vec_id WHEN vec_id % 40 = 3 THEN 'img_000000.jpg' ELSE filename END AS filename,
  CASE WHEN vec_id % 60 = 11 THEN '' ELSE group_id END AS group_id FROM plain)"""


def faulty(spark, sf_dir):
    name = F.when(F.col("vec_id") % 50 == 7, F.concat(F.lit("dir/x"), "vec_id")).when(F.col("vec_id") % 40 == 3, "img_000000.jpg").otherwise(F.col("filename"))
    return plain(spark, sf_dir).select(name.alias("filename"), F.when(F.col("vec_id") % 60 == 11, "").otherwise(F.col("group_id")).alias("group_id"))


@query(f"""WITH {PLAIN}, {FAULTY} SELECT 'bad_name' AS problem, filename FROM faulty WHERE regexp_matches(filename, '[/\\\\]') OR filename IN ('', '.', '..')
  UNION ALL SELECT 'empty_group', filename FROM faulty WHERE group_id = '' UNION ALL SELECT 'duplicate', filename FROM faulty GROUP BY filename HAVING count(*) > 1""")
def q_manifest_violations(spark, sf_dir):
    from pairgraph.sources.tables import csv_violations

    return csv_violations(faulty(spark, sf_dir))


@query(f"""WITH {PLAIN}, {FAULTY}, e AS (SELECT CASE WHEN vec_id % 9 = 4 THEN 'lost_' || filename ELSE filename END AS filename FROM plain)
  SELECT 'duplicate' AS problem, filename FROM faulty GROUP BY filename HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'missing', filename FROM e WHERE filename NOT IN (SELECT filename FROM faulty)
  UNION ALL SELECT DISTINCT 'unexpected', filename FROM faulty WHERE filename NOT IN (SELECT filename FROM e)
  UNION ALL SELECT 'empty_group', filename FROM faulty WHERE group_id = '' UNION ALL SELECT 'bad_name', filename FROM faulty WHERE regexp_matches(filename, '[/\\\\]')""")
def q_partition_check(spark, sf_dir):
    lost = F.when(F.col("vec_id") % 9 == 4, F.concat(F.lit("lost_"), "filename")).otherwise(F.col("filename"))
    expected = plain(spark, sf_dir).select(lost.alias("filename"))
    return partitions.violations(faulty(spark, sf_dir), expected)


@query("SELECT size, count(*) AS n_groups FROM (SELECT label, count(*) AS size FROM embeddings GROUP BY label) GROUP BY size")
def q_group_sizes(spark, sf_dir):
    return partitions.size_distribution(plain(spark, sf_dir))


FILES = "files AS (SELECT doc_id, 'doc_' || doc_id AS filename, source AS group_id, sha256(text) AS content_hash, n_chars FROM documents)"


def files(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("filename"), F.col("source").alias("group_id"), tx.content_hash(F.col("text")).alias("content_hash"), "n_chars")


@query(f"WITH {FILES} SELECT content_hash, list(filename ORDER BY filename) AS names, count(*) AS n FROM files GROUP BY content_hash HAVING count(*) > 1")
def q_content_hash_dups(spark, sf_dir):
    return audit.repeated(files(spark, sf_dir), "content_hash")


PHASH = f"{PLAIN}, hashed AS (SELECT filename, group_id, array_to_string(list_transform(range(2, 17), lambda i: CASE WHEN s[i] > s[i - 1] THEN '1' ELSE '0' END), '') AS phash FROM (SELECT *, list_transform(range(0, 16), lambda k: round(v[k * 4 + 1] + v[k * 4 + 2] + v[k * 4 + 3] + v[k * 4 + 4], 9)) AS s FROM plain))"


def hashed(spark, sf_dir):
    sums = F.expr("transform(sequence(0, 15), k -> round(descriptor[k * 4] + descriptor[k * 4 + 1] + descriptor[k * 4 + 2] + descriptor[k * 4 + 3], 9))")
    return plain(spark, sf_dir).withColumn("phash", vx.sign_hash(sums))


@query(f"WITH {PHASH} SELECT phash, list(filename ORDER BY filename) AS names, count(*) AS n FROM hashed GROUP BY phash HAVING count(*) > 1")
def q_phash_collisions(spark, sf_dir):
    return audit.repeated(hashed(spark, sf_dir), "phash")


@query(f"WITH {PHASH} SELECT phash, list(filename ORDER BY filename) AS names, count(*) AS n, count(DISTINCT group_id) AS groups FROM hashed GROUP BY phash HAVING count(*) > 1 AND count(DISTINCT group_id) > 1")
def q_cross_group(spark, sf_dir):
    return audit.cross_group(hashed(spark, sf_dir), "phash")


@query("""WITH f AS (SELECT CASE WHEN doc_id % 7 = 2 THEN 'moved_' ELSE 'doc_' END || doc_id AS filename FROM documents), m AS (SELECT 'doc_' || doc_id AS filename FROM labels)
  SELECT 'missing' AS problem, filename FROM m WHERE filename NOT IN (SELECT filename FROM f) UNION ALL SELECT 'extra', filename FROM f WHERE filename NOT IN (SELECT filename FROM m)""")
def q_missing_extra(spark, sf_dir):
    """Every seventh file is taken to have another name."""
    manifest = read(spark, sf_dir, "labels").select(F.concat(F.lit("doc_"), "doc_id").alias("filename"))
    name = F.concat(F.when(F.col("doc_id") % 7 == 2, "moved_").otherwise("doc_"), "doc_id")
    return audit.missing_and_extra(manifest, files(spark, sf_dir).select(name.alias("filename")))


@query("""SELECT sum((vec_id % 3 = 0)::INT)::BIGINT AS leaked, count(*) AS n, round(avg((vec_id % 3 = 0)::INT::DOUBLE), 6) AS fraction FROM embeddings""")
def q_label_leak(spark, sf_dir):
    named = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("g"), "group_id", F.lit("_"), "filename")).otherwise(F.col("filename"))
    return audit.label_leak(plain(spark, sf_dir).withColumn("filename", named)).withColumn("fraction", F.round("fraction", 6))


@query("""SELECT 'o_totalprice' AS measure, round(min(o_totalprice), 6) AS minimum, round(median(o_totalprice), 6) AS median, round(max(o_totalprice), 6) AS maximum FROM orders
  UNION ALL SELECT 'l_extendedprice', round(min(l_extendedprice), 6), round(median(l_extendedprice), 6), round(max(l_extendedprice), 6) FROM lineitem""")
def q_exposure_summary(spark, sf_dir):
    parts = [audit.summary(read(spark, sf_dir, t), c).select(F.lit(c).alias("measure"), *[r6(F.col(x), x) for x in ("minimum", "median", "maximum")]) for t, c in (("orders", "o_totalprice"), ("lineitem", "l_extendedprice"))]
    return parts[0].unionByName(parts[1])


@query(f"WITH {FILES} SELECT sha256('manifest:' || repeat('0', 64) || chr(10) || string_agg('image:' || filename || ':' || content_hash || chr(10), '' ORDER BY content_hash, filename)) AS fingerprint FROM files")
def q_dataset_fingerprint(spark, sf_dir):
    return spark.createDataFrame([(audit.dataset_fingerprint(files(spark, sf_dir), "0" * 64),)], "fingerprint string")


AUDITS = f"""{FILES}, a AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'old_' || filename ELSE filename END AS filename, content_hash, group_id FROM files),
b AS (SELECT CASE WHEN doc_id % 8 = 5 THEN 'new_' || filename ELSE filename END AS filename, CASE WHEN doc_id % 11 = 4 THEN sha256(content_hash) ELSE content_hash END AS content_hash,
  CASE WHEN doc_id % 5 = 1 THEN 'moved' ELSE group_id END AS group_id FROM files)"""


def audits(spark, sf_dir):
    f = files(spark, sf_dir)
    old = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("old_"), "filename")).otherwise(F.col("filename"))
    a = f.select(old.alias("filename"), "content_hash", "group_id")
    b = f.select(
        F.when(F.col("doc_id") % 8 == 5, F.concat(F.lit("new_"), "filename")).otherwise(F.col("filename")).alias("filename"),
        F.when(F.col("doc_id") % 11 == 4, F.sha2(F.col("content_hash").cast("binary"), 256)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("doc_id") % 5 == 1, "moved").otherwise(F.col("group_id")).alias("group_id"),
    )
    return a, b


@query(f"WITH {AUDITS} SELECT a.filename, a.content_hash <> b.content_hash AS changed FROM a JOIN b USING (filename)")
def q_audit_shared(spark, sf_dir):
    return audit.shared_names(*audits(spark, sf_dir))


@query(f"""WITH {AUDITS} SELECT x.content_hash, left_names, right_names FROM (SELECT content_hash, list(filename ORDER BY filename) AS left_names FROM a GROUP BY 1) x
  JOIN (SELECT content_hash, list(filename ORDER BY filename) AS right_names FROM b GROUP BY 1) y USING (content_hash)""")
def q_audit_hash(spark, sf_dir):
    return audit.shared_values(*audits(spark, sf_dir), "content_hash")


@query(f"""WITH {AUDITS}, j AS (SELECT filename, a.group_id AS l, b.group_id AS r FROM a JOIN b USING (filename))
  SELECT count(*) AS checked, coalesce(sum(((x.l = y.l) <> (x.r = y.r))::INT), 0)::BIGINT AS disagreeing FROM j x JOIN j y ON x.filename < y.filename""")
def q_relations(spark, sf_dir):
    return audit.relation_changes(*audits(spark, sf_dir))


@query(f"""WITH {FILES}, k AS (SELECT DISTINCT content_hash FROM files WHERE doc_id % 3 = 0)
  SELECT (content_hash IN (SELECT content_hash FROM k)) AS hit, count(DISTINCT content_hash) AS contents, count(*) AS n FROM files GROUP BY 1""")
def q_cache_hits(spark, sf_dir):
    """Files whose content was kept by a memo that had seen every third file."""
    f = files(spark, sf_dir)
    memo = Memo(spark, f"{shared_dir(spark)}/pairgraph/{spark.sparkContext.applicationId}/memo-{uuid.uuid4().hex}", ["content_hash"], "content_hash string, seen long")
    for seen in (0, 1):  # what is put twice is read once
        memo.put(f.where("doc_id % 3 = 0").select("content_hash", F.lit(seen).cast("long").alias("seen")).distinct(), "f" * 64)
    hits, misses = memo.lookup(f.select("filename", "content_hash"), "f" * 64)
    both = hits.where("seen = 1").withColumn("hit", F.lit(True)).drop("seen").unionByName(misses.withColumn("hit", F.lit(False)))
    return both.groupBy("hit").agg(F.count_distinct("content_hash").alias("contents"), F.count(F.lit(1)).alias("n"))


# --- candidates ------------------------------------------------------------------------------------------------


@query(f'WITH {PLAIN} SELECT a.filename AS "left", b.filename AS "right" FROM plain a JOIN plain b ON a.filename < b.filename WHERE a.group_id = b.group_id')
def q_same_group_pairs(spark, sf_dir):
    """All pairs within a group: the join that labels make."""
    p = plain(spark, sf_dir)
    a, b = p.select("group_id", F.col("filename").alias("left")), p.select("group_id", F.col("filename").alias("right"))
    return a.join(b, "group_id").where(F.col("left") < F.col("right")).select("left", "right")


@query('SELECT a.r_name AS "left", b.r_name AS "right" FROM region a JOIN region b ON a.r_name < b.r_name UNION ALL SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_name < b.n_name')
def q_all_pairs(spark, sf_dir):
    names = [read(spark, sf_dir, t).select(F.col(c).alias("filename")) for t, c in (("region", "r_name"), ("nation", "n_name"))]
    return candidates.all_pairs(names[0]).unionByName(candidates.all_pairs(names[1]))


@query(f"""WITH {PLAIN}, z AS (SELECT filename, v FROM plain UNION ALL SELECT 'zero_' || i, list_transform(range(0, 64), lambda x: 0.0::DOUBLE) FROM range(0, 2) t(i)),
  d AS (SELECT a.filename AS "left", b.filename AS "right", CASE WHEN a.filename LIKE 'zero%' AND b.filename LIKE 'zero%' THEN 0.0 WHEN a.filename LIKE 'zero%' OR b.filename LIKE 'zero%' THEN 1.0
    ELSE 1.0::DOUBLE - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])))) END AS x FROM z a JOIN z b ON a.filename < b.filename)
  SELECT "left", "right", round(x, 6) AS distance FROM d WHERE round(x, 9) <= 0.7""")
def q_distances(spark, sf_dir):
    """Distances up to 0.7, with two empty vectors added."""
    p = plain(spark, sf_dir).select("filename", "descriptor")
    zeros = spark.range(2).select(F.concat(F.lit("zero_"), "id").alias("filename"), F.array_repeat(F.lit(0.0), 64).alias("descriptor"))
    return candidates.pairs_within(p.unionByName(zeros), 0.7).withColumn("distance", F.round("distance", 6))


@query(f'WITH {PAIRS} SELECT * FROM pairs')
def q_topk_pairs(spark, sf_dir):
    return pairs_of(spark, sf_dir)


@query(f"""WITH {PAIRS}, n AS (SELECT count(*) AS n FROM img) SELECT 'structural_top_k' AS mode, n * (n - 1) // 2 AS all_pair_count, (SELECT count(*) FROM pairs) AS candidate_pair_count,
  round((SELECT count(*) FROM pairs) / (n * (n - 1) / 2)::DOUBLE, 6) AS candidate_pair_fraction FROM n""")
def q_screen_counters(spark, sf_dir):
    out = candidates.screen_candidates(images(spark, sf_dir)).counters()
    return out.withColumn("candidate_pair_fraction", F.round("candidate_pair_fraction", 6))


EDGES = f'{TWINS}, {DIST.format(t="img")}'


@query(f'WITH {EDGES} SELECT l AS "left", r AS "right", round(d, 6) AS distance FROM dist WHERE l < r AND d <= 0.62')
def q_threshold_edges(spark, sf_dir):
    return candidates.pairs_within(images(spark, sf_dir), 0.62).withColumn("distance", F.round("distance", 6))


@query(f"WITH RECURSIVE {EDGES}, e AS MATERIALIZED (SELECT l, r FROM dist WHERE d <= 0.62), nodes AS (SELECT filename AS n FROM img), {REACH} SELECT filename, component AS group_id FROM comp")
def q_components(spark, sf_dir):
    img = images(spark, sf_dir)
    return grouping.component_groups(img, candidates.pairs_within(img, 0.62))


@query(f"WITH {PLAIN} SELECT filename, filename AS group_id FROM plain")
def q_singletons(spark, sf_dir):
    return grouping.singletons(plain(spark, sf_dir))


# --- vectors ---------------------------------------------------------------------------------------------------


@query(f"""WITH {PLAIN}, a AS (SELECT filename, list_transform(v, lambda x: abs(x)) AS a FROM plain)
  SELECT filename, list_transform(a, lambda x: round(sqrt(x / greatest(list_sum(a), 1e-12)), 6)) AS weights FROM a""")
def q_rootsift(spark, sf_dir):
    a = F.transform("descriptor", F.abs)
    return plain(spark, sf_dir).select("filename", F.transform(vx.root_weights(a), lambda x: F.round(x, 6)).alias("weights"))


@query("""WITH b AS (SELECT l_orderkey, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS v FROM lineitem GROUP BY 1),
  q AS (SELECT *, list_aggregate(v, 'quantile_cont', 0.25) AS lo, list_aggregate(v, 'quantile_cont', 0.75) AS hi FROM b)
  SELECT l_orderkey, CASE WHEN hi - lo <= 1e-12 THEN v ELSE list_transform(v, lambda x: round_even(least(1.0, greatest(0.0, (x - lo) / (hi - lo))) * 255, 0)) END AS levels FROM q""")
def q_stretch(spark, sf_dir):
    keys = [k for c in ("l_linenumber", "l_extendedprice") for k in (F.isnull(c).alias(f"no_{c}"), F.col(c))]  # nulls last
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("r"))
    v = F.transform("r", lambda x: x["l_extendedprice"])
    return rows.select("l_orderkey", vx.stretch(v, 25, 75, weighted=True).alias("levels"))


@query("""WITH h AS (SELECT c_nationkey, (c_custkey * 37 % 256)::INT AS level, count(*) AS n FROM customer GROUP BY ALL),
  c AS (SELECT c_nationkey, level, n, sum(n) OVER (PARTITION BY c_nationkey ORDER BY level) AS cdf, sum(n) OVER (PARTITION BY c_nationkey) AS total, first_value(n) OVER (PARTITION BY c_nationkey ORDER BY level) AS first FROM h)
  SELECT c_nationkey, level, CASE WHEN total = first THEN level ELSE round_even((cdf - first) / (total - first)::DOUBLE * 255, 0)::INT END AS equalized FROM c""")
def q_equalize(spark, sf_dir):
    """The kernel's equalization of each nation's levels."""
    levels = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list((F.col("c_custkey") * 37 % 256).cast("int")).alias("levels"))

    def run(batches):
        for batch in batches:
            keys, seen, out = [], [], []
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = np.array([values], np.uint8)
                for a, b in sorted(set(zip(image[0].tolist(), kernels.equalized(image)[0].tolist(), strict=True))):
                    keys.append(key), seen.append(a), out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(seen, pa.int32()), pa.array(out, pa.int32())], ["c_nationkey", "level", "equalized"])

    kind = levels.schema["c_nationkey"].dataType.simpleString()
    return levels.mapInArrow(run, f"c_nationkey {kind}, level int, equalized int")


@query(f"""WITH {PLAIN}, a AS (SELECT filename, (degrees(atan2(round(list_sum(v[33:64]), 9), round(list_sum(v[1:32]), 9))) + 360) % 180 / 30 AS s FROM plain)
  SELECT filename, list_transform(range(0, 6), lambda b: round(greatest(0.0, 1.0 - least(abs(s - b), 6 - abs(s - b))), 6)) AS weights FROM a""")
def q_orientation_hist(spark, sf_dir):
    half = lambda at: F.round(vx.total(F.slice("descriptor", at, 32)), 9)
    angle = (F.degrees(F.atan2(half(33), half(1))) + 360) % 180 / 30
    return plain(spark, sf_dir).select("filename", F.transform(vx.soft_bins(angle, 6), lambda x: F.round(x, 6)).alias("weights"))


@query(f'WITH {PAIRS} SELECT "left", "right", round((SELECT corr(a.v[i], b.v[i]) FROM range(1, 65) t(i)), 6) AS correlation FROM pairs JOIN img a ON a.filename = "left" JOIN img b ON b.filename = "right"')
def q_grad_corr(spark, sf_dir):
    img, pairs = images(spark, sf_dir), pairs_of(spark, sf_dir)
    l, r = img.select(F.col("filename").alias("left"), F.col("descriptor").alias("a")), img.select(F.col("filename").alias("right"), F.col("descriptor").alias("b"))
    return pairs.join(l, "left").join(r, "right").select("left", "right", r6(vx.pearson(F.col("a"), F.col("b")), "correlation"))


@query(f"""WITH {PLAIN} SELECT a.filename AS "left", b.filename AS "right", (('0x' || substr(sha256('7:' || sha256(a.filename) || ':' || sha256(b.filename)), 1, 8))::BIGINT & 2147483647) AS seed
  FROM plain a JOIN plain b ON b.vec_id = a.vec_id + 1""")
def q_pair_seed(spark, sf_dir):
    p = plain(spark, sf_dir).select("vec_id", "filename", tx.content_hash(F.col("filename")).alias("h"))
    b = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("filename").alias("right"), F.col("h").alias("rh"))
    return p.join(b, "vec_id").select(F.col("filename").alias("left"), "right", tx.pair_seed(7, F.col("h"), F.col("rh")).alias("seed"))


# --- evidence and decisions ------------------------------------------------------------------------------------


def flags_of(spark, sf_dir):
    return evidence.match_flags(pairs_of(spark, sf_dir), local(images(spark, sf_dir)).drop("view"), 0.78)


def placed_of(spark, sf_dir):
    return evidence.place_matches(evidence.mutual_matches(flags_of(spark, sf_dir)), local(images(spark, sf_dir)))


@query(f'WITH {RAW} SELECT "left", "right", q, t, dd AS distance FROM a_f')
def q_ratio_matches(spark, sf_dir):
    return evidence.ratio_matches(flags_of(spark, sf_dir))


@query(f'WITH {RAW} SELECT "left", "right", q, t FROM a_m')
def q_mutual(spark, sf_dir):
    return evidence.mutual_matches(flags_of(spark, sf_dir)).drop("distance")


@query(f'WITH {RAW} SELECT "left", "right", count(DISTINCT [lx, ly]) / 16.0::DOUBLE AS grid_coverage_left, count(DISTINCT [rx, ry]) / 16.0::DOUBLE AS grid_coverage_right FROM a_m GROUP BY ALL')
def q_grid_coverage(spark, sf_dir):
    return evidence.coverage(placed_of(spark, sf_dir), 64.0, 64.0, 4)


@query(f'WITH {RAW} SELECT "left", "right", n, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(tx, 4) + 0.0 AS tx, round(ty, 4) + 0.0 AS ty FROM a_fit')
def q_similarity_fit(spark, sf_dir):
    f = evidence.fit_similarity(placed_of(spark, sf_dir))
    return f.select("left", "right", "n", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("a", 6), ("b", 6), ("tx", 4), ("ty", 4))])


@query(f'WITH {RAW} SELECT "left", "right", round(median(error), 6) AS median_error, round(max(error), 6) AS worst, count(*) AS n FROM a_e GROUP BY ALL')
def q_transfer_error(spark, sf_dir):
    placed = placed_of(spark, sf_dir)
    e = evidence.transfer_errors(placed, evidence.fit_similarity(placed))
    return e.groupBy("left", "right").agg(r6(F.median("error"), "median_error"), r6(F.max("error"), "worst"), F.count(F.lit(1)).alias("n"))


@query(f'WITH {RAW} SELECT "left", "right", round(scale, 6) AS scale, round(rot, 6) + 0.0 AS rotation_degrees, round(shift, 6) AS translation_fraction, fits AS plausible FROM a_st WHERE mf')
def q_plausible(spark, sf_dir):
    m = measured(spark, sf_dir).where("model_found").withColumn("plausible", decisions.plausible(SMALL_STATES))
    return m.select("left", "right", r6(F.col("scale"), "scale"), (F.round("rotation_degrees", 6) + 0.0).alias("rotation_degrees"), r6(F.col("translation_fraction"), "translation_fraction"), "plausible")


@query(f'WITH {RAW} SELECT "left", "right", state, round(score, 6) AS score FROM a_dec')
def q_classify(spark, sf_dir):
    return decisions.classify(measured(spark, sf_dir), SMALL_STATES).select("left", "right", "state", r6(F.col("score"), "score"))


@query(f"WITH {RAW} SELECT state, count(*) AS n FROM a_dec GROUP BY 1")
def q_state_counts(spark, sf_dir):
    return decisions.state_counts(decisions.classify(measured(spark, sf_dir), SMALL_STATES))


@query(f'WITH {FUSED} SELECT "left", "right", state, score FROM fused')
def q_fuse(spark, sf_dir):
    return fused(spark, sf_dir).drop("reasons")


@query(f'WITH {RAW} SELECT "left", "right", state, round(score, 6) AS score FROM a_dec WHERE state IN (\'strong_positive\', \'positive\') ORDER BY score DESC, 1, 2 LIMIT 50')
def q_strongest50(spark, sf_dir):
    d = decisions.classify(measured(spark, sf_dir), SMALL_STATES).withColumn("score", F.round("score", 6))
    return decisions.strongest(d).select("left", "right", "state", "score")


@query(f"""WITH RECURSIVE {RAW}, s AS MATERIALIZED (SELECT "left" AS l, "right" AS r FROM a_dec WHERE state = 'strong_positive'), e AS MATERIALIZED (SELECT l, r FROM s UNION ALL SELECT r, l FROM s),
  nodes AS (SELECT DISTINCT l AS n FROM e), {REACH} SELECT filename, component FROM comp""")
def q_strong_components(spark, sf_dir):
    d = decisions.classify(measured(spark, sf_dir), SMALL_STATES).where("state = 'strong_positive'")
    return connected_components(d, "left", "right").withColumnRenamed("id", "filename")


@query()
def q_constrained_groups(spark, sf_dir):
    return grouping.constrained_groups(images(spark, sf_dir).select("filename"), fused(spark, sf_dir))


# --- partitions ------------------------------------------------------------------------------------------------

GROUPS = "ref AS (SELECT filename, group_id FROM plain), pred AS (SELECT filename, CASE WHEN vec_id % 6 = 1 THEN 'moved' || vec_id % 3 WHEN vec_id % 10 = 3 THEN 'solo' || vec_id WHEN group_id IN ('1', '2') THEN 'both' ELSE group_id END AS group_id FROM plain)"
OUTCOMES = f"""{PLAIN}, {GROUPS}, ov AS (SELECT ref.group_id AS r, pred.group_id AS p, count(*) AS o FROM ref JOIN pred USING (filename) GROUP BY ALL),
rs AS (SELECT group_id AS r, count(*) AS rn FROM ref GROUP BY 1), ps AS (SELECT group_id AS p, count(*) AS pn FROM pred GROUP BY 1),
oc AS (SELECT r, rn, count(*) > 1 AS split, bool_or(pn > o) AS merged FROM ov JOIN rs USING (r) JOIN ps USING (p) GROUP BY ALL)"""


def two_partitions(spark, sf_dir):
    p = plain(spark, sf_dir)
    moved = (
        F.when(F.col("vec_id") % 6 == 1, F.concat(F.lit("moved"), F.col("vec_id") % 3))
        .when(F.col("vec_id") % 10 == 3, F.concat(F.lit("solo"), "vec_id"))
        .when(F.col("group_id").isin("1", "2"), "both")
        .otherwise(F.col("group_id"))
    )
    return p.select("filename", "group_id"), p.select("filename", moved.alias("group_id"))


@query(f"""WITH RECURSIVE {EDGES}, e AS MATERIALIZED (SELECT l, r FROM dist WHERE d <= 0.16), nodes AS (SELECT filename AS n FROM img), {REACH},
ref AS (SELECT filename, group_id FROM img), pred AS (SELECT filename, component AS group_id FROM comp),
ov AS (SELECT ref.group_id AS r, pred.group_id AS p, count(*) AS o FROM ref JOIN pred USING (filename) GROUP BY ALL),
rs AS (SELECT group_id AS r, count(*) AS rn FROM ref GROUP BY 1), ps AS (SELECT group_id AS p, count(*) AS pn FROM pred GROUP BY 1),
oc AS (SELECT r, rn, count(*) > 1 AS split, bool_or(pn > o) AS merged FROM ov JOIN rs USING (r) JOIN ps USING (p) GROUP BY ALL)
SELECT sum((NOT split AND NOT merged)::INT)::BIGINT AS exact_matches, count(*) AS total_reference_groups, sum((NOT split AND NOT merged AND rn = 1)::INT)::BIGINT AS singleton_exact_matches,
  sum((rn = 1)::INT)::BIGINT AS singleton_reference_groups, sum((NOT split AND NOT merged AND rn > 1)::INT)::BIGINT AS non_singleton_exact_matches, sum((rn > 1)::INT)::BIGINT AS non_singleton_reference_groups,
  sum(merged::INT)::BIGINT AS merge_damaged_reference_groups, sum(split::INT)::BIGINT AS split_reference_groups, (SELECT count(*) FROM ps) AS predicted_groups,
  (SELECT count(*) FROM ps WHERE pn = 1) AS predicted_singletons, round(sum((NOT split AND NOT merged)::INT) / count(*)::DOUBLE, 6) AS exact_group_score,
  round(sum((NOT split AND NOT merged)::INT) / (SELECT count(*) FROM ps)::DOUBLE, 6) AS predicted_exact_group_precision FROM oc""")
def q_score(spark, sf_dir):
    """Flagship: vectors and twins, joined within 0.16, grouped by components and scored."""
    img = images(spark, sf_dir)
    predicted = grouping.component_groups(img, candidates.pairs_within(img, 0.16))
    out = partitions.score(img.select("filename", "group_id"), predicted)
    return out.withColumns({c: F.round(c, 6) for c in ("exact_group_score", "predicted_exact_group_precision")})


@query(f"""WITH {OUTCOMES} SELECT (SELECT list(filename ORDER BY filename) FROM ref WHERE ref.group_id = r) AS reference_group,
  list_filter([CASE WHEN split THEN 'split' END, CASE WHEN merged THEN 'merge' END], lambda x: x IS NOT NULL) AS failure_types,
  (SELECT list(m ORDER BY m) FROM (SELECT list(filename ORDER BY filename) AS m FROM pred WHERE pred.group_id IN (SELECT p FROM ov WHERE ov.r = oc.r) GROUP BY pred.group_id)) AS predicted_groups
  FROM oc WHERE split OR merged""")
def q_diagnose(spark, sf_dir):
    return partitions.diagnose(*two_partitions(spark, sf_dir))


@query(f"WITH {PLAIN}, {GROUPS}, h AS (SELECT filename, min(filename) OVER (PARTITION BY group_id) AS head FROM pred) SELECT filename, dense_rank() OVER (ORDER BY head) - 1 AS group_no FROM h")
def q_canonical(spark, sf_dir):
    return partitions.canonical(two_partitions(spark, sf_dir)[1])


@query(f"""WITH {RAW}, x AS (SELECT d.*, a.group_id = b.group_id AS same, state IN ('strong_positive', 'positive') AS pos, state = 'negative' AS neg FROM a_dec d JOIN img a ON a.filename = "left" JOIN img b ON b.filename = "right"),
  t AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM img GROUP BY group_id)) AS same_pairs, (SELECT count(*) * (count(*) - 1) // 2 FROM img) AS all_pairs)
  SELECT count(*) AS pair_count, sum(same::INT)::BIGINT AS same_group_pair_count, sum((NOT same)::INT)::BIGINT AS different_group_pair_count,
  any_value(all_pairs)::BIGINT AS all_pair_count, round(count(*) / any_value(all_pairs)::DOUBLE, 6) AS candidate_pair_fraction, round(sum(same::INT) / any_value(same_pairs)::DOUBLE, 6) AS candidate_same_group_pair_recall,
  round(coalesce(sum((pos AND same)::INT) / nullif(sum(pos::INT), 0)::DOUBLE, 1), 6) AS positive_pair_precision, round(coalesce(sum((pos AND same)::INT) / nullif(sum(same::INT), 0)::DOUBLE, 1), 6) AS same_group_positive_recall,
  round(coalesce(sum((neg AND NOT same)::INT) / nullif(sum(neg::INT), 0)::DOUBLE, 1), 6) AS negative_pair_precision, round(coalesce(sum((neg AND NOT same)::INT) / nullif(sum((NOT same)::INT), 0)::DOUBLE, 1), 6) AS different_group_negative_recall,
  round(sum((pos OR neg)::INT) / count(*)::DOUBLE, 6) AS known_state_coverage,
  {", ".join(f"sum((state = '{s}' AND {'same' if k == 'same' else 'NOT same'})::INT)::BIGINT AS {k}_{s}" for k in ("same", "different") for s in ("strong_positive", "positive", "negative", "unknown"))} FROM x, t""")
def q_pair_diag(spark, sf_dir):
    d = decisions.classify(measured(spark, sf_dir), SMALL_STATES)
    out = partitions.pair_diagnostics(d, images(spark, sf_dir).select("filename", "group_id"))
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query(f"""WITH RECURSIVE {PAIRS}, s AS MATERIALIZED (SELECT "left" AS l, "right" AS r FROM pairs JOIN img a ON a.filename = "left" JOIN img b ON b.filename = "right" WHERE a.group_id = b.group_id),
  e AS MATERIALIZED (SELECT l, r FROM s UNION ALL SELECT r, l FROM s), nodes AS (SELECT filename AS n FROM img), {REACH},
  parts AS (SELECT group_id, count(DISTINCT component) AS parts FROM img JOIN comp USING (filename) GROUP BY 1)
  SELECT sum((parts = 1)::INT)::BIGINT AS connected_groups, count(*) AS total_groups FROM parts""")
def q_connectivity(spark, sf_dir):
    return partitions.connectivity(pairs_of(spark, sf_dir), images(spark, sf_dir).select("filename", "group_id"))


# --- splits, sweeps and registry -------------------------------------------------------------------------------


@query(f"WITH {PLAIN} SELECT filename, group_id FROM plain WHERE group_id IN ('0', '2', '4')")
def q_split_select(spark, sf_dir):
    m = plain(spark, sf_dir).select("filename", "group_id")
    return sweep.select_split(m, {"type": "group_ids", "group_ids": ["0", "2", "4"]})


@query("SELECT source AS group_id, count(*) AS size, sha256('fold:' || source) AS order_key FROM documents GROUP BY source")
def q_fold_order(spark, sf_dir):
    return sweep.hash_order(read(spark, sf_dir, "documents").select(F.col("source").alias("group_id")), "fold")


@query("""WITH RECURSIVE g AS MATERIALIZED (SELECT group_id, size, row_number() OVER (ORDER BY k) AS rn FROM (SELECT source AS group_id, count(*) AS size, sha256('fold:' || source) AS k FROM documents GROUP BY source)),
  cap AS (SELECT greatest(1, count(*) // 3) AS c FROM documents),
  s AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS group_id, 0::BIGINT AS size, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS d, NULL::VARCHAR AS fold
    UNION ALL SELECT rn, group_id, size, a + CASE WHEN fold = 'a' THEN size ELSE 0 END, b + CASE WHEN fold = 'b' THEN size ELSE 0 END, d + CASE WHEN fold = 'c' THEN size ELSE 0 END, fold
    FROM (SELECT g.rn, g.group_id, g.size, a, b, d, CASE least(CASE WHEN a + g.size <= c THEN a END, CASE WHEN b + g.size <= c THEN b END, CASE WHEN d + g.size <= c THEN d END)
      WHEN CASE WHEN a + g.size <= c THEN a END THEN 'a' WHEN CASE WHEN b + g.size <= c THEN b END THEN 'b' WHEN CASE WHEN d + g.size <= c THEN d END THEN 'c' END AS fold
      FROM s JOIN g ON g.rn = s.rn + 1, cap))
  SELECT group_id, size, fold FROM s WHERE rn > 0""")
def q_folds(spark, sf_dir):
    groups = read(spark, sf_dir, "documents").select(F.col("source").alias("group_id"))
    return sweep.assign_folds(groups, "fold", capacity=max(1, groups.count() // 3))


RUNS = """runs AS (SELECT 'c' || (o_custkey % 17) AS candidate_id, o_orderkey AS run, (o_orderkey % 7)::BIGINT AS exact_matches, (o_orderkey % 7 + o_orderkey % 3)::BIGINT AS total_reference_groups,
  (o_orderkey % 7) / (o_orderkey % 7 + o_orderkey % 3 + 1)::DOUBLE AS exact_group_score, (o_orderkey % 5)::BIGINT AS non_singleton_exact_matches, (o_orderkey % 5 + o_orderkey % 2)::BIGINT AS non_singleton_reference_groups,
  CASE WHEN o_custkey % 17 < 9 THEN 0 ELSE o_orderkey % 2 END::BIGINT AS merge_damaged_reference_groups, (o_orderkey % 4)::BIGINT AS split_reference_groups, (o_orderkey % 100)::DOUBLE AS wall_seconds, o_orderkey AS peak_rss_bytes FROM orders)"""
AGG = f"""{RUNS}, agg AS (SELECT candidate_id, count(*) AS fold_count, round(CASE WHEN sum(total_reference_groups) = 0 THEN 1 ELSE sum(exact_matches) / sum(total_reference_groups)::DOUBLE END, 6) AS micro_exact_group_score,
  round(avg(exact_group_score), 6) AS mean_fold_exact_group_score, round(min(exact_group_score), 6) AS worst_fold_exact_group_score, sum(exact_matches)::BIGINT AS exact_matches, sum(total_reference_groups)::BIGINT AS total_reference_groups,
  round(CASE WHEN sum(non_singleton_reference_groups) = 0 THEN 1 ELSE sum(non_singleton_exact_matches) / sum(non_singleton_reference_groups)::DOUBLE END, 6) AS micro_non_singleton_exact_group_score,
  sum(non_singleton_exact_matches)::BIGINT AS non_singleton_exact_matches, sum(non_singleton_reference_groups)::BIGINT AS non_singleton_reference_groups, sum(merge_damaged_reference_groups)::BIGINT AS merge_damaged_reference_groups,
  sum(split_reference_groups)::BIGINT AS split_reference_groups, sum(wall_seconds) AS total_wall_seconds, max(peak_rss_bytes) AS maximum_peak_rss_bytes,
  0::BIGINT AS feature_cache_hits, 0::BIGINT AS feature_cache_misses, 0::BIGINT AS pair_cache_hits, 0::BIGINT AS pair_cache_misses FROM runs GROUP BY 1)"""


def runs(spark, sf_dir):
    k, g = F.col("o_orderkey"), F.col("o_custkey") % 17
    long = lambda c, name: c.cast("long").alias(name)
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), g).alias("candidate_id"), long(k % 7, "exact_matches"), long(k % 7 + k % 3, "total_reference_groups"),
        ((k % 7) / (k % 7 + k % 3 + 1)).alias("exact_group_score"), long(k % 5, "non_singleton_exact_matches"), long(k % 5 + k % 2, "non_singleton_reference_groups"),
        long(F.when(g < 9, 0).otherwise(k % 2), "merge_damaged_reference_groups"), long(k % 4, "split_reference_groups"), (k % 100).cast("double").alias("wall_seconds"), k.alias("peak_rss_bytes"),
    )


def aggregated(spark, sf_dir):
    a = sweep.aggregate_runs(runs(spark, sf_dir))
    return a.withColumns({c: F.round(c, 6) for c in a.columns if c.endswith("_score")})


@query(f"WITH {AGG} SELECT * FROM agg")
def q_fold_aggregate(spark, sf_dir):
    return aggregated(spark, sf_dir)


@query(f"""WITH {AGG} SELECT candidate_id, row_number() OVER (ORDER BY (merge_damaged_reference_groups <> 0)::INT, micro_exact_group_score DESC, worst_fold_exact_group_score DESC,
  micro_non_singleton_exact_group_score DESC, split_reference_groups, total_wall_seconds, candidate_id) AS place FROM agg""")
def q_rank(spark, sf_dir):
    return sweep.rank_candidates(aggregated(spark, sf_dir)).select("candidate_id", "place")


EVENTS = "ev AS (SELECT 'run' || user_id AS run_id, event_id AS event_seq, event_type AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at FROM events), lat AS (SELECT run_id, max(event_seq) AS event_seq, arg_max(status, event_seq) AS status, arg_max(started_at, event_seq) AS started_at FROM ev GROUP BY 1)"


def run_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("run"), "user_id").alias("run_id"), F.col("event_id").alias("event_seq"), F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query(f"WITH {EVENTS} SELECT * FROM lat")
def q_registry_latest(spark, sf_dir):
    return registry.latest(run_events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT * FROM lat ORDER BY started_at DESC, run_id DESC LIMIT 20")
def q_recent(spark, sf_dir):
    return registry.recent(registry.latest(run_events(spark, sf_dir)), 20)


def small_registry(spark, sf_dir):
    """Runs of the regions' names: one is left running, the others end."""
    book = registry.RunRegistry(spark, f"{shared_dir(spark)}/pairgraph/{spark.sparkContext.applicationId}/registry-{uuid.uuid4().hex}")
    for no, r in enumerate(read(spark, sf_dir, "region").orderBy("r_regionkey").limit(3).collect()):
        book.start({
            "run_id": r["r_name"], "started_at": f"2024-01-0{no + 1}", "git_commit": "c", "dirty_tree": False, "config_path": "p", "config_hash": "h",
            "dataset_fingerprint": "f", "split_id": f"split-{no}", "seed": no,
        })
        if no:
            book.finish(r["r_name"], ("passed", "failed")[no - 1], metrics={"score": no}, notes="n")
    return book


@query("""SELECT r_name AS run_id, ['running', 'passed', 'failed'][rn] AS status, 'split-' || (rn - 1) AS split_id, CASE WHEN rn = 1 THEN '{}' ELSE '{"score": ' || (rn - 1) || '}' END AS metrics
  FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS rn FROM region) WHERE rn <= 3""")
def q_registry_runs(spark, sf_dir):
    """Runs that were started and finished, folded from the events."""
    return small_registry(spark, sf_dir).runs().select("run_id", "status", "split_id", "metrics")


@query("SELECT true AS found, false AS lost")
def q_exists(spark, sf_dir):
    book = small_registry(spark, sf_dir)
    return spark.createDataFrame([(book.contains_split("split-1"), book.contains_split("split-9"))], "found boolean, lost boolean")


@query("SELECT role, list(conv_id ORDER BY conv_id) AS names FROM (SELECT DISTINCT role, conv_id FROM conversations) GROUP BY role")
def q_inversion(spark, sf_dir):
    """A map from name to value turned round."""
    return audit.inverted(read(spark, sf_dir, "conversations").select("role", "conv_id").distinct(), "role", "names", "conv_id")


@query(f"WITH {PLAIN}, {GROUPS}, h AS (SELECT filename, min(filename) OVER (PARTITION BY group_id) AS head FROM pred) SELECT filename, (dense_rank() OVER (ORDER BY head) - 1)::VARCHAR AS group_id FROM h")
def q_csv_round_trip(spark, sf_dir):
    """Predictions written as CSV and read again: ids are numbers in canonical order, as text."""
    folder = shared_dir(spark)
    if not folder.startswith(("file:", "/")):
        raise ValueError("predictions are one file that the driver writes; the shared folder must be mounted")
    path = f"{folder.removeprefix('file://')}/pairgraph/{spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex}/predictions.csv"
    reference, predicted = two_partitions(spark, sf_dir)
    return read_groups(spark, str(write_predictions(predicted, reference.select("filename"), path)))


RULES = """d AS (SELECT * FROM (VALUES ('a1', 'a2', 'strong_positive', 0.9), ('a2', 'a3', 'strong_positive', 0.8), ('a1', 'a3', 'negative', 0.1),
  ('b1', 'b2', 'strong_positive', 0.9), ('b2', 'b3', 'strong_positive', 0.8), ('b1', 'b3', 'unknown', 0.2),
  ('c1', 'c2', 'strong_positive', 0.95), ('c3', 'c4', 'strong_positive', 0.94), ('c2', 'c3', 'strong_positive', 0.5),
  ('d1', 'd2', 'strong_positive', 0.95), ('d3', 'd4', 'strong_positive', 0.94), ('d2', 'd3', 'strong_positive', 0.5), ('d1', 'd3', 'positive', 0.4), ('d2', 'd4', 'positive', 0.4),
  ('e1', 'e2', 'positive', 0.9)) t("left", "right", state, score))"""


@query("""SELECT * FROM (VALUES ('a1', 'a1'), ('a2', 'a1'), ('a3', 'a3'), ('b1', 'b1'), ('b2', 'b1'), ('b3', 'b1'), ('c1', 'c1'), ('c2', 'c1'), ('c3', 'c3'), ('c4', 'c3'),
  ('d1', 'd1'), ('d2', 'd1'), ('d3', 'd1'), ('d4', 'd1'), ('e1', 'e1'), ('e2', 'e2')) t(filename, group_id)""")
def q_grouping_rules(spark, sf_dir):
    """A veto, a single image that joins by one strong edge, clusters with one and with three edges between them, and a pair
    without a strong edge."""
    d = spark.sql(f"WITH {RULES.replace(chr(34), chr(96))} SELECT * FROM d")
    names = d.select(F.explode(F.array("left", "right")).alias("filename")).distinct()
    return grouping.constrained_groups(names, d, GroupingConfig(min_independent_support_edges=2, representative_strong_support=False))


ODD_PAIRS = "SELECT * FROM (VALUES ('a', 'b'), ('b', 'a'), ('c', 'c'), ('a', 'z')) t(\"left\", \"right\")"


@query("SELECT * FROM (VALUES ('a', 'b', 'repeated_pair'), ('c', 'c', 'self_pair'), ('a', 'z', 'unknown_name')) t(\"left\", \"right\", problem)")
def q_pair_problems(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in "abc"], "filename string")
    return candidates.check_pairs(spark.sql(ODD_PAIRS.replace('"', "`")), names)


@query(f"""WITH {PAIRS}, h AS (SELECT "left" AS l, "right" AS r, sha256("left") AS a, sha256("right") AS b FROM pairs)
  SELECT CASE WHEN (b, r) < (a, l) THEN r ELSE l END AS "left", CASE WHEN (b, r) < (a, l) THEN l ELSE r END AS "right", least(a, b) AS left_hash, greatest(a, b) AS right_hash FROM h""")
def q_oriented(spark, sf_dir):
    p = pairs_of(spark, sf_dir)
    return candidates.orient(p.withColumns({"left_hash": tx.content_hash(F.col("left")), "right_hash": tx.content_hash(F.col("right"))}))


@query(f"""WITH {RAW}, r AS (SELECT filename, CASE WHEN vec_id < 60 THEN 'm' WHEN vec_id % 2 = 1 THEN filename ELSE group_id END AS group_id FROM img),
  x AS (SELECT d."left", d."right", state, round(score, 6) AS score, a.group_id = b.group_id AS same FROM a_dec d JOIN r a ON a.filename = "left" JOIN r b ON b.filename = "right"),
  f AS (SELECT * FROM x WHERE state IN ('strong_positive', 'positive') AND NOT same ORDER BY state <> 'strong_positive', score DESC, 1, 2 LIMIT 50),
  m AS (SELECT * FROM x WHERE state NOT IN ('strong_positive', 'positive') AND same ORDER BY state <> 'strong_positive', score DESC, 1, 2 LIMIT 50)
  SELECT 'false_positive' AS kind, "left", "right", state, score FROM f UNION ALL SELECT 'missed', "left", "right", state, score FROM m""")
def q_examples(spark, sf_dir):
    d = decisions.classify(measured(spark, sf_dir), SMALL_STATES).withColumn("score", F.round("score", 6))
    group = F.when(F.col("vec_id") < 60, "m").when(F.col("vec_id") % 2 == 1, F.col("filename")).otherwise(F.col("group_id"))
    both = partitions.diagnostic_examples(d, images(spark, sf_dir).select("filename", group.alias("group_id")))
    parts = [df.select(F.lit(kind).alias("kind"), "left", "right", "state", "score") for kind, df in zip(("false_positive", "missed"), both, strict=True)]
    return parts[0].unionByName(parts[1])


@query("""SELECT n_name, CASE WHEN length(s) > 12 THEN substr(s, 1, 9) || '...' ELSE s END AS label FROM (SELECT n_name, n_name || ' é ' || n_regionkey AS x, regexp_replace(n_name || ' é ' || n_regionkey, '[^\\x00-\\x7F]', '?', 'g') AS s FROM nation)""")
def q_labels(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_name", tx.clipped_label(F.concat("n_name", F.lit(" é "), "n_regionkey"), 12).alias("label"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
