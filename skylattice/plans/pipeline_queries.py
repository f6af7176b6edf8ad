"""Queries of the numbered operators that belong to the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.compaction import RECORD_KEY, consolidate, deliver, descriptor_records
from skylattice.operators.hierarchy import descendants, hierarchy, sent_descendants
from skylattice.operators.regions import near_counts, near_pairs, regions_of_points
from skylattice.operators.rejects import load_halo_lines
from skylattice.plans.views import HIGH_SQL, box_sides, high
from skylattice.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(table(spark, sf_dir, "hr_halos"), "halo_id", "pid", paths=False)
    return tree.where("parent IS NOT NULL").select(F.col("id").alias("halo_id"), "root_id", F.col("depth").cast("int").alias("depth"))


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(table(spark, sf_dir, "hr_halos"), "halo_id", "pid")
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "/")
    return tree.select(F.col("id").alias("halo_id"), "root_id", F.col("depth").cast("int").alias("depth"), path.alias("path"), (F.col("size") - 1).alias("n_descendants"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sent_descendants(table(spark, sf_dir, "hr_halos"), "halo_id", "pid")


def p2_whole_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_hierarchy with the trees below loops: their sizes, and hang, the path from the node that hangs on the loop."""
    tree = hierarchy(table(spark, sf_dir, "hr_halos"), "halo_id", "pid")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "/").alias(c)
    return tree.select(F.col("id").alias("halo_id"), "root_id", F.col("depth").cast("int").alias("depth"), text("path"), text("hang"), (F.col("size") - 1).alias("n_descendants"), "on_loop")


def p2_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_descendants with the trees below loops."""
    return descendants(hierarchy(table(spark, sf_dir, "hr_halos"), "halo_id", "pid"), below_loops=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failing = load_halo_lines(table(spark, sf_dir, "halo_lines"), table(spark, sf_dir, "sim_runs"))
    return failing.select("line_id", "reason")


def p3_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = load_halo_lines(table(spark, sf_dir, "halo_lines"), table(spark, sf_dir, "sim_runs"))
    return valid.select("line_id", "halo_id", "pid", "halo_x", "halo_y", "halo_z", "m200b")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptor_records(table(spark, sf_dir, "descriptor_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(_records(spark, sf_dir), RECORD_KEY).rows.select(*RECORD_KEY)


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range metadata, with names and bytes."""
    return consolidate(_records(spark, sf_dir), RECORD_KEY).files


def p4_all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as often as it was delivered."""
    return consolidate(_records(spark, sf_dir), RECORD_KEY, once=False).rows.select(*RECORD_KEY)


def p4_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier half of the files first, then those modified later, merged into what stands."""
    files = table(spark, sf_dir, "descriptor_files")
    middle = files.agg(F.percentile_approx(F.unix_micros(F.col("modified_at").cast("timestamp")), 0.5, 1000).alias("middle")).first().middle
    marked = files.withColumn("late", F.coalesce(F.unix_micros(F.col("modified_at").cast("timestamp")) > F.lit(middle), F.lit(False)))
    held = consolidate(descriptor_records(marked.where("NOT late")), RECORD_KEY)
    return deliver(held, descriptor_records(marked.where("late"))).rows.select(*RECORD_KEY)


def _halo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "sim_runs").select("run_id", F.col("boxsize_mpc_h").alias("side"), F.col("env_radius_mpc_h").alias("reach"))
    halos = table(spark, sf_dir, "hr_halos").select("halo_id", "box_id", "run_id", F.col("halo_x").alias("x"), F.col("halo_y").alias("y"), F.col("halo_z").alias("z"))
    return halos.join(runs, "run_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_pairs(_halo_points(spark, sf_dir), "halo_id", "box_id")
    return pairs.select(F.least("region_id", "point_id").alias("halo_id_a"), F.greatest("region_id", "point_id").alias("halo_id_b"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _halo_points(spark, sf_dir)
    return near_counts(points, near_pairs(points, "halo_id", "box_id"), "halo_id")


def p6_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of its box, seen along z, in which each halo lies: every cell of a grid of four a side is an L and the square that it leaves out."""
    halos = high(spark, sf_dir).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(F.col("id").alias("halo_id"), "box", "x", "y", "side")
    four = F.explode(F.sequence(F.lit(0), F.lit(3)))
    cells = box_sides(halos).select("space", (F.col("side") / 4).alias("c"), four.alias("i")).select("*", four.alias("j"))
    corner = lambda axis, half: F.col(axis) * F.col("c") + (F.col("c") * half)
    shape = lambda part, xs, ys: F.struct(F.lit(part).alias("part"), F.array(*[corner("i", v) for v in xs]).alias("xs"), F.array(*[corner("j", v) for v in ys]).alias("ys"))
    both = F.array(shape(0, (0, 1, 1, 0.5, 0.5, 0), (0, 0, 0.5, 0.5, 1, 1)), shape(1, (0.5, 1, 1, 0.5), (0.5, 0.5, 1, 1)))
    regions = cells.select(F.col("space").alias("box"), "i", "j", F.explode(both).alias("s")).select("box", (((F.col("box").cast("long") * 4 + F.col("i")) * 4 + F.col("j")) * 2 + F.col("s.part")).alias("region_id"), "s.xs", "s.ys")
    return regions_of_points(halos, regions, "halo_id", "region_id", one_region=True, space="box")


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p2_whole_hierarchy, p2_all_descendants, p3_found, p3_valid, p4_found, p4_files, p4_all_records, p4_delivered, p6_found, p6_counts, p6_regions)}

_TREE = """
WITH RECURSIVE n AS (
  SELECT halo_id AS id, min(CASE WHEN pid <> -1 THEN pid END) AS parent FROM hr_halos WHERE halo_id IS NOT NULL GROUP BY 1
), up AS (
  SELECT id, id AS at, parent AS nxt, [id] AS path, false AS looped FROM n
  UNION ALL
  SELECT up.id, n.id, n.parent, list_prepend(n.id, up.path), list_contains(up.path, n.id)
  FROM up JOIN n ON up.nxt = n.id WHERE NOT up.looped
), loops AS (
  SELECT id, list_min(list_slice(path, 1, list_position(list_slice(path, 2, len(path)), path[1]))) AS root_id FROM up WHERE looped
), ended AS (
  SELECT u.id, u.at AS root_id, len(u.path) - 1 AS depth, u.path FROM up u LEFT JOIN n ON u.nxt = n.id WHERE n.id IS NULL AND NOT u.looped
), tree AS (
  SELECT id, root_id, depth, path FROM ended UNION ALL SELECT id, root_id, -1, NULL FROM loops
), down AS (
  SELECT id, path FROM ended UNION ALL SELECT id, path[list_position(path[2:], path[1]) + 2:] FROM up WHERE looped
)"""

_HALF = "SELECT any_value(h.box_id) AS box_id, h.halo_id, any_value(halo_x) AS x, any_value(halo_y) AS y, any_value(halo_z) AS z, any_value(r.boxsize_mpc_h) AS l, any_value(r.env_radius_mpc_h) AS r FROM hr_halos h JOIN sim_runs r USING (run_id) WHERE isfinite(halo_x) AND isfinite(halo_y) AND isfinite(halo_z) GROUP BY 2"
_PAIRS = f"""
WITH p AS ({_HALF}), pairs AS (
  SELECT a.halo_id AS halo_id_a, b.halo_id AS halo_id_b FROM p a JOIN p b ON a.box_id = b.box_id AND a.halo_id < b.halo_id
  WHERE (a.x - b.x - a.l * round((a.x - b.x) / a.l)) ** 2 + (a.y - b.y - a.l * round((a.y - b.y) / a.l)) ** 2 + (a.z - b.z - a.l * round((a.z - b.z) / a.l)) ** 2 <= a.r ** 2)"""

_LINES = r"""
WITH l AS (
  SELECT line_id, run_id, file_kind = 'csv' AS csv, raw_line, regexp_replace(',' || raw_line, ',"(?:[^"]|"")*"(,|$)', ',q\1', 'g') AS once FROM halo_lines
  WHERE raw_line IS NOT NULL AND NOT regexp_full_match(raw_line, '[ \t]*') AND NOT starts_with(raw_line, '#')
), q AS (
  SELECT *, CASE WHEN csv THEN NOT regexp_full_match(raw_line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', 's') ELSE false END AS bad_quotes FROM l
), f AS (
  SELECT *, CASE WHEN csv THEN list_transform(regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END)
    ELSE regexp_split_to_array(regexp_replace(raw_line, '^[ \t]+|[ \t]+$', '', 'g'), '[ \t]+') END AS v FROM q
), t AS (
  SELECT *, CASE WHEN csv THEN [v[1], v[2], v[3], v[4], v[5], v[6]] ELSE [v[2], v[6], v[18], v[19], v[20], v[40]] END AS k FROM f
), c AS (
  SELECT t.line_id, bad_quotes, len(v) AS n, csv, boxsize_mpc_h AS side,
    CASE WHEN regexp_full_match(k[1], '[+-]?[0-9]+') THEN try_cast(k[1] AS BIGINT) END AS halo_id,
    CASE WHEN regexp_full_match(k[2], '[+-]?[0-9]+') THEN try_cast(k[2] AS BIGINT) END AS pid,
    list_transform(k[3:6], lambda x: CASE WHEN regexp_full_match(x, '[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') THEN try_cast(x AS DOUBLE) END) AS d
  FROM t LEFT JOIN sim_runs USING (run_id)
), e AS (
  SELECT *, CASE WHEN bad_quotes THEN 'quoting' WHEN n <> CASE WHEN csv THEN 8 ELSE 40 END THEN 'column_count'
    WHEN NOT coalesce(halo_id >= 1 AND pid >= -1 AND d[1] >= 0 AND d[1] < side AND d[2] >= 0 AND d[2] < side AND d[3] >= 0 AND d[3] < side AND d[4] > 0 AND isfinite(d[4]), false) THEN 'value' END AS reason FROM c
)"""

_RECORDS = r"""
WITH l AS (SELECT regexp_replace(unnest(regexp_split_to_array(content, '\r\n|\n|\r')), '^[ \t]+|[ \t]+$', '', 'g') AS line FROM descriptor_files),
f AS (SELECT regexp_split_to_array(line, '[ \t]+') AS v FROM l WHERE line <> ''),
r AS (SELECT v FROM f WHERE len(v) = 8 AND len(list_filter(v, lambda x: NOT regexp_full_match(x, '[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:nan|inf|infinity)'))) = 0),
k AS (SELECT cast(cast(v[1] AS DOUBLE) AS BIGINT) AS descriptor_halo_id, cast(cast(v[2] AS DOUBLE) AS INTEGER) AS cell_x, cast(cast(v[3] AS DOUBLE) AS INTEGER) AS cell_y, cast(cast(v[4] AS DOUBLE) AS INTEGER) AS cell_z FROM r)"""

ORACLE = {
    "p2_found": f"{_TREE} SELECT t.id AS halo_id, root_id, cast(depth AS INTEGER) AS depth FROM tree t JOIN n ON n.id = t.id WHERE n.parent IS NOT NULL",
    "p2_hierarchy": f"{_TREE}, below AS (SELECT unnest(path) AS id, count(*) - 1 AS n_descendants FROM down GROUP BY 1) SELECT t.id AS halo_id, root_id, cast(depth AS INTEGER) AS depth, array_to_string(path, '/') AS path, n_descendants FROM tree t LEFT JOIN below b ON b.id = t.id",
    "p2_descendants": f"{_TREE}, r AS (SELECT id, len(path) - 1 AS depth, unnest(path[:-2]) AS ancestor_id, unnest(range(len(path) - 1)) AS pos FROM down WHERE len(path) > 1) SELECT ancestor_id, id AS descendant_id, cast(depth - pos AS INTEGER) AS distance FROM r",
    "p3_found": f"{_LINES} SELECT line_id, reason FROM e WHERE reason IS NOT NULL",
    "p3_valid": f"{_LINES} SELECT line_id, halo_id, pid, d[1] AS halo_x, d[2] AS halo_y, d[3] AS halo_z, d[4] AS m200b FROM e WHERE reason IS NULL",
    "p4_found": f"{_RECORDS} SELECT DISTINCT * FROM k",
    "p4_all_records": f"{_RECORDS} SELECT * FROM k",
    "p4_delivered": f"{_RECORDS} SELECT DISTINCT * FROM k",
    "p6_found": f"{_PAIRS} SELECT halo_id_a, halo_id_b FROM pairs",
    "p6_regions": f"WITH {HIGH_SQL}, q AS (SELECT id AS halo_id, box, x, y, side / 4 AS c FROM hr WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL), g AS (SELECT unnest(range(4)) AS i), m AS (SELECT q.*, a.i, b.i AS j, x <= a.i * c + c * 0.5 OR y <= b.i * c + c * 0.5 AS in_l, x >= a.i * c + c * 0.5 AND y >= b.i * c + c * 0.5 AS in_square FROM q JOIN g a ON x >= a.i * c AND x <= a.i * c + c JOIN g b ON y >= b.i * c AND y <= b.i * c + c) SELECT halo_id, min(((box * 4 + i) * 4 + j) * 2 + CASE WHEN in_l THEN 0 ELSE 1 END)::BIGINT AS region_id FROM m WHERE in_l OR in_square GROUP BY 1",
    "p6_counts": f"{_PAIRS}, ends AS (SELECT halo_id_a AS halo_id FROM pairs UNION ALL SELECT halo_id_b FROM pairs) SELECT i.halo_id, count(e.halo_id) AS n_near FROM (SELECT DISTINCT halo_id FROM hr_halos) i LEFT JOIN ends e USING (halo_id) GROUP BY 1",
}
