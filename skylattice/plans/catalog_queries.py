"""Queries of the catalogue operators, each beside its SQL. Names begin with the operator's place in the survey."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import cosmology as C
from skylattice.operators import environment, fields, filters, grid, matching, ranks, regions, stats, tails
from skylattice.plans.views import DESCRIBED_SQL, HIGH_SQL, LOW_SQL, box_sides, described, high, low
from skylattice.runtime import stage, table
from skylattice.sources import catalogs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
H, L, D = f"WITH {HIGH_SQL} ", f"WITH {LOW_SQL} ", f"WITH {DESCRIBED_SQL} "
HL = f"WITH {HIGH_SQL}, {LOW_SQL}"
N = 8
LOG_EDGES = C.linear_grid(9.0, 15.0, 13)
MASS_EDGES = [10**e for e in LOG_EDGES]
SCALES = [0.25, 0.5, 1.0, 2.0, 4.0]
#: the Gaussian scales of whole runs: 20 from 1000 / 4096 to 4 at equal ratios, without the first
RUN_SCALES = [float(1000 / 4096 * (4 * 4096 / 1000) ** (k / 19)) for k in range(1, 20)]
#: what a deposit of halos reads
PLACE = ("box", "x", "y", "z", "side")
_EDGES_SQL = "[" + ", ".join(f"{e!r}::DOUBLE" for e in MASS_EDGES) + "]"
_LOG_EDGES_SQL = "[" + ", ".join(f"{e!r}::DOUBLE" for e in LOG_EDGES) + "]"


def _bin_sql(value: str, edges: str, n: int, closed: bool = True) -> str:
    return f"CASE WHEN {value} >= {edges}[1] AND {value} {'<=' if closed else '<'} {edges}[-1] THEN least(len(list_filter({edges}, lambda e: e <= {value})) - 1, {n - 1}) END"


def _day():
    return F.col("batch_day").cast("string").alias("batch_day")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def grid_query(sql: str | None = None, columns: tuple[str, ...] | None = None, **of_run):
    """Register f(halos, n) with N cells along a side, beside its SQL, and as name_run_grid with the n_grid of each run.

    The latter has no SQL, which would never end; ``of_run`` are its further arguments, ``columns`` those of halos that f reads, where these are few.
    """

    def register(f):
        def whole(spark, sf_dir):
            runs = table(spark, sf_dir, "sim_runs").select("run_id", "n_grid")
            halos = high(spark, sf_dir).join(runs, "run_id")
            halos = stage(halos if columns is None else halos.select("n_grid", *columns), "halos")  # else each size plans them anew, several times
            sizes = sorted(row.n_grid for row in runs.select("n_grid").distinct().where("n_grid > 0").collect())  # a few, at every scale
            return reduce(DataFrame.unionByName, [f(halos.where(F.col("n_grid") == n), n, **of_run) for n in sizes])

        QUERIES[f"{f.__name__}_run_grid"] = whole
        small = lambda spark, sf_dir: f(high(spark, sf_dir), N)
        small.__name__ = f.__name__
        return query(sql)(small)

    return register


def r(column, digits: int = 6):
    return F.round(column, digits)


# sources


@query(r"""WITH t AS (SELECT line_id, trim(regexp_replace(raw_line, '\s+', ' ', 'g')) AS t FROM halo_lines WHERE file_kind = 'list'), v AS (SELECT line_id, string_split(t, ' ') AS v FROM t WHERE t <> '' AND NOT starts_with(t, '#'))
SELECT line_id, try_cast(v[2] AS BIGINT) AS id, try_cast(v[6] AS BIGINT) AS pid, try_cast(v[18] AS DOUBLE) AS x, try_cast(v[19] AS DOUBLE) AS y, try_cast(v[20] AS DOUBLE) AS z, try_cast(v[40] AS DOUBLE) AS m200b FROM v""")
def s1_list_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "halo_lines").where("file_kind = 'list'").select("line_id", F.col("raw_line").alias("value"))
    columns = {c: catalogs.LAYOUTS["hlist"][c] for c in ("id", "pid", "x", "y", "z", "m200b")}
    return catalogs.text_rows(lines, columns)


_SAYS = r"max(try_cast(regexp_extract(lower(raw_line), '(?:^|[#;])\s*(?:{})\s*=\s*([-+0-9.e]+)', 1) AS DOUBLE))"


@query(f"SELECT run_id, file_name, {_SAYS.format('om|omega[ _]m[^=;]*')} AS om, {_SAYS.format('ol|omega[ _]l[^=;]*')} AS ol, {_SAYS.format('h|h0')} AS h FROM halo_lines WHERE starts_with(raw_line, '#') GROUP BY ALL")
def s9_header_cosmology(spark, sf_dir):
    return catalogs.header_cosmology(table(spark, sf_dir, "halo_lines"), key=("run_id", "file_name"))


# filters and expressions


@query(H + "SELECT id, m200b FROM hr WHERE pid = -1 AND m200b > 0 AND cv IS NOT NULL")
def f1_hosts(spark, sf_dir):
    return filters.hosts(high(spark, sf_dir)).select("id", "m200b")


@query(H + "SELECT id, m200b FROM hr WHERE m200b BETWEEN 1e11 AND 1e13")
def f4_mass_range(spark, sf_dir):
    return filters.mass_range(filters.min_mass(filters.positive_mass(high(spark, sf_dir)), 1e10), 1e11, 1e13).select("id", "m200b")


@query(H + "SELECT id, m200b FROM hr WHERE m200b >= 1e12")
def f3_min_mass(spark, sf_dir):
    return filters.min_mass(high(spark, sf_dir), 1e12).select("id", "m200b")


@query(D + "SELECT descriptor_halo_id, batch_day::VARCHAR AS batch_day FROM ds WHERE tidal_anisotropy IS NOT NULL AND overdensity IS NOT NULL")
def f5_finite_features(spark, sf_dir):
    return filters.finite_features(described(spark, sf_dir), ["tidal_anisotropy", "overdensity"]).select("descriptor_halo_id", _day())


@query(D + "SELECT descriptor_halo_id, batch_day::VARCHAR AS batch_day, halo_rg FROM ds WHERE halo_rg > 0.2 AND halo_rg < 0.5")
def f6_radius_window(spark, sf_dir):
    return filters.radius_window(described(spark, sf_dir), 0.2, 0.5, "halo_rg").select("descriptor_halo_id", _day(), "halo_rg")


@query(H + f"SELECT id, {_bin_sql('log10(CASE WHEN m200b > 0 THEN m200b END)', _LOG_EDGES_SQL, 12, False)}::INTEGER AS bin FROM hr")
def f7_mass_bin(spark, sf_dir):
    rows = filters.with_log_mass(high(spark, sf_dir))
    return rows.select("id", C.bin_of(F.col("log10_m200b"), LOG_EDGES).cast("int").alias("bin"))


@query(H + "SELECT id, coalesce(x >= 10 AND x < 40 AND y >= 10 AND y < 40 AND z >= 10 AND z < 40, false) AS inside, coalesce(x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 40 AND z BETWEEN 10 AND 40, false) AS inside_closed FROM hr")
def f8_sub_box(spark, sf_dir):
    low_, up = (10.0,) * 3, (40.0,) * 3
    return high(spark, sf_dir).select("id", filters.in_sub_box(low_, up).alias("inside"), filters.in_sub_box(low_, up, closed=True).alias("inside_closed"))


@query(L + "SELECT id FROM lr WHERE m200b > 100 * mp")
def f10_min_particles(spark, sf_dir):
    return filters.min_particles(low(spark, sf_dir), 100, F.col("mp")).select("id")


@query(H + "SELECT id, round(x - 50, 6) AS x, round(y - 50, 6) AS y, round(z - 50, 6) AS z FROM hr")
def f16_recentred(spark, sf_dir):
    return filters.shifted(high(spark, sf_dir), (50.0, 50.0, 50.0)).select("id", *[r(a).alias(a) for a in "xyz"])


_R200 = "power(3 * m200b / (4 * pi() * 200 * om * 2.775e11 * h * h), 1.0 / 3)"


@query(H + f", q AS (SELECT id, {_R200} AS r, om, h FROM hr WHERE m200b >= 0) SELECT id, round(r, 9) AS r200b, round(4 * r / sqrt(5), 9) AS rg, round(CASE WHEN r > 0 THEN log10(4.0 / 3 * pi() * 200 * om * 2.775e11 * h * h * r ** 3) END, 6) AS log_mass FROM q")
def m1_radii(spark, sf_dir):
    rows = high(spark, sf_dir).where("m200b >= 0").withColumn("r", C.r200b(F.col("m200b"), F.col("om"), F.col("h")))
    return rows.select("id", r("r", 9).alias("r200b"), r(C.gaussian_radius(F.col("r")), 9).alias("rg"), r(F.log10(F.when(F.col("r") > 0, C.m200b(F.col("r"), F.col("om"), F.col("h")))), 6).alias("log_mass"))


@query(L + "SELECT id, round(n_part * mp / 1e9, 6) AS linked_mass, round(CASE WHEN n_part * mp <> 0 THEN m200b / (n_part * mp) END, 6) AS ratio FROM lr")
def m4_linked_mass(spark, sf_dir):
    mass = C.linked_mass(F.col("n_part"), F.col("mp"))
    return low(spark, sf_dir).select("id", r(mass / 1e9).alias("linked_mass"), r(C.safe_ratio(F.col("m200b"), mass)).alias("ratio"))


# grids

_CORNERS = f"""
, g AS (SELECT *, x / (side / {N}) AS gx, y / (side / {N}) AS gy, z / (side / {N}) AS gz FROM hr WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)
, c AS (SELECT g.*, ((floor(gx) + a)::INTEGER % {N} + {N}) % {N} AS i, ((floor(gy) + b)::INTEGER % {N} + {N}) % {N} AS j, ((floor(gz) + d)::INTEGER % {N} + {N}) % {N} AS k,
  (CASE WHEN a = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * (CASE WHEN b = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE WHEN d = 1 THEN gz - floor(gz) ELSE 1 - (gz - floor(gz)) END) AS w
  FROM g, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS d))
, dep AS (SELECT box AS space, i, j, k, sum(w * m200b) AS v, sum(w) AS n FROM c GROUP BY ALL)
, num AS (SELECT space, i, j, k, n AS v FROM dep)
, mean AS (SELECT space, sum(v) / {N**3} AS mean FROM num GROUP BY 1)
, delta AS (SELECT space, i, j, k, v / mean - 1 AS v FROM num JOIN mean USING (space) WHERE mean > 0)
, sides AS (SELECT box AS space, max(side) AS side FROM hr GROUP BY 1)
, cube AS (SELECT space, side, i, j, k FROM (SELECT DISTINCT space FROM num) JOIN sides USING (space), (SELECT unnest(range({N}))::INTEGER AS i), (SELECT unnest(range({N}))::INTEGER AS j), (SELECT unnest(range({N}))::INTEGER AS k))
, filled AS (SELECT c.space, c.side, c.i, c.j, c.k, coalesce(d.v, -1.0) AS v FROM cube c LEFT JOIN delta d USING (space, i, j, k))
"""


def _deposit(halos: DataFrame, n: int, *mass: str) -> DataFrame:
    """The deposit as a table, since its mean, its spaces and itself are all asked for."""
    return stage(grid.cloud_in_cell(halos, n, *mass), "deposit")


def _sparse_delta(halos: DataFrame, n: int) -> DataFrame:
    """The overdensity of the cells that hold anything; the others are at -1."""
    return grid.overdensity(_deposit(halos, n), n)


def _delta(halos: DataFrame, n: int) -> DataFrame:
    return grid.full_grid(_sparse_delta(halos, n), n, -1.0)


@grid_query(H + _CORNERS + "SELECT space, i, j, k, round(v / 1e10, 5) + 0.0 AS mass FROM dep WHERE v IS NOT NULL")
def a1_cloud_in_cell(halos, n):
    return grid.cloud_in_cell(halos, n, "m200b").select("space", "i", "j", "k", (r(F.col("v") / 1e10, 5) + 0.0).alias("mass"))


@grid_query(H + _CORNERS + f"SELECT space, i, j, k, round(num.v / power(side / {N}, 3), 8) AS density FROM num JOIN sides USING (space)")
def a3_density(halos, n):
    return grid.density(grid.cloud_in_cell(halos, n), box_sides(halos), n).select("space", "i", "j", "k", r("v", 8).alias("density"))


@grid_query(H + _CORNERS + "SELECT space, i, j, k, round(v, 6) AS delta FROM filled", columns=PLACE)
def a4_overdensity(halos, n):
    return grid.full_overdensity(halos, n, 6).withColumnRenamed("v", "delta")


@grid_query(H + _CORNERS + f", e AS (SELECT box AS space, count(*) / power(max(side), 3) AS expected FROM g GROUP BY 1) SELECT space, i, j, k, round(num.v / power(side / {N}, 3) / expected - 1, 6) AS delta FROM num JOIN sides USING (space) JOIN e USING (space)")
def a5_overdensity_expected(halos, n):
    halos = grid.placed(halos)
    sides = box_sides(halos)
    expected = halos.groupBy(F.col("box").alias("space")).agg((F.count("*") / F.pow(F.max("side"), F.lit(3))).alias("expected"))
    return grid.overdensity_expected(grid.density(grid.cloud_in_cell(halos, n), sides, n), expected).select("space", "i", "j", "k", r("v").alias("delta"))


@grid_query(H + f"SELECT box, least(floor(x / (side / {N})), {N - 1})::INTEGER AS i, least(floor(y / (side / {N})), {N - 1})::INTEGER AS j, least(floor(z / (side / {N})), {N - 1})::INTEGER AS k, count(*) AS n FROM hr WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY ALL")
def a6_nearest_cell(halos, n):
    return grid.nearest_cells(grid.placed(halos), n).groupBy("box", "i", "j", "k").agg(F.count("*").alias("n"))


@grid_query(H + _CORNERS + f", md AS (SELECT space, i, j, k, v / (sum(v) OVER (PARTITION BY space) / {N**3}) - 1 AS v FROM dep WHERE v IS NOT NULL) SELECT space, i, j, k, round(v, 6) AS delta FROM md")
def a7_mass_overdensity(halos, n):
    return grid.overdensity(_deposit(halos, n, "m200b"), n).select("space", "i", "j", "k", r("v").alias("delta"))


@grid_query(H + _CORNERS + "SELECT id, round(sum(w * f.v), 6) AS delta FROM c JOIN filled f ON f.space = c.box AND f.i = c.i AND f.j = c.j AND f.k = c.k GROUP BY 1")
def j10_trilinear(halos, n):
    return grid.trilinear(halos, grid.overdensity(_deposit(halos, n), n), n, empty=-1.0).select("id", r("v").alias("delta"))


# joins

_DIST = "sqrt(" + " + ".join(f"(a.{c} - b.{c} - a.side * round((a.{c} - b.{c}) / a.side)) ** 2" for c in "xyz") + ")"


@query(D + f", {HIGH_SQL}, f AS (SELECT cell_x, cell_y, cell_z, tidal_anisotropy, overdensity FROM ds QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y, cell_z ORDER BY batch_day, descriptor_halo_id) = 1), hc AS (SELECT id, floor(x / (side / n_grid))::INTEGER % n_grid AS cell_x, floor(y / (side / n_grid))::INTEGER % n_grid AS cell_y, floor(z / (side / n_grid))::INTEGER % n_grid AS cell_z FROM hr JOIN sim_runs USING (run_id)) SELECT id, tidal_anisotropy, overdensity FROM hc LEFT JOIN f USING (cell_x, cell_y, cell_z)")
def j1_descriptors_by_cell(spark, sf_dir):
    sizes = table(spark, sf_dir, "sim_runs").select("run_id", "n_grid")
    cell = lambda a: F.pmod(F.floor(F.col(a) / (F.col("side") / F.col("n_grid"))), F.col("n_grid")).cast("int").alias(f"cell_{a}")
    halos = high(spark, sf_dir).join(sizes, "run_id").select("id", *[cell(a) for a in "xyz"])
    got = environment.attach_by_cell(halos, described(spark, sf_dir), ["cell_x", "cell_y", "cell_z"], [F.col("batch_day"), F.col("descriptor_halo_id")], ["tidal_anisotropy", "overdensity"])
    return got.select("id", "tidal_anisotropy", "overdensity")


@query(H + f", e AS (SELECT a.id, count(*) AS n FROM hr a JOIN hr b ON a.box = b.box AND a.id <> b.id AND {_DIST} <= a.env_radius GROUP BY 1) SELECT hr.id, round(log10(1 + coalesce(n, 0)), 6) AS env FROM hr LEFT JOIN e USING (id)")
def j2_environment(spark, sf_dir):
    halos = high(spark, sf_dir).withColumn("reach", F.col("env_radius"))
    near = regions.near_counts(halos, regions.near_pairs(halos, "id", "box"), "id")
    return near.select("id", r(F.log10(1 + F.col("n_near"))).alias("env"))


@query(HL + f", p AS (SELECT a.id AS hr_id, b.id AS lr_id, {_DIST} AS d, a.r_match FROM hr a JOIN lr b ON a.box = b.box) SELECT hr_id, lr_id, round(d, 6) AS distance, (row_number() OVER (PARTITION BY hr_id ORDER BY d, lr_id))::INTEGER AS rank FROM p WHERE d < r_match QUALIFY rank <= 10")
def j3_nearest(spark, sf_dir):
    found = matching.nearest(high(spark, sf_dir), low(spark, sf_dir), 10, F.col("r_match"))
    return found.select(F.col("a").alias("hr_id"), F.col("b").alias("lr_id"), r("distance").alias("distance"), "rank")


@query()
def j4_match_one_to_one(spark, sf_dir):
    return matching.match_one_to_one(high(spark, sf_dir), low(spark, sf_dir)).select("hr_id", "lr_id", r("distance").alias("distance"))


@query()
def j5_transferred_mass(spark, sf_dir):
    hr, lr = high(spark, sf_dir), low(spark, sf_dir)
    return matching.transferred_mass(lr, hr, matching.match_one_to_one(hr, lr)).select("id", "hr_id", "m200b_cal", "matched")


def _abundance_sql(ratio: float) -> str:
    return f""", r AS (SELECT run_id, log10(m200b) AS lm, row_number() OVER (PARTITION BY run_id ORDER BY m200b DESC, id) AS pos FROM hr WHERE m200b > 0),
n AS (SELECT run_id, max(pos) AS n_ref FROM r GROUP BY 1),
t AS (SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY m200b DESC, id) AS rank FROM lr WHERE m200b > 0),
x AS (SELECT t.*, greatest(1.0, least(rank * {ratio}::DOUBLE, n_ref::DOUBLE)) AS x FROM t LEFT JOIN n USING (run_id)),
y AS (SELECT x.run_id, id, x, floor(x)::BIGINT AS pos, n_ref FROM x LEFT JOIN n USING (run_id))
SELECT y.run_id, id, round(CASE WHEN n_ref IS NOT NULL THEN a.lm + coalesce((log10(x) - log10(y.pos)) / (log10(y.pos + 1) - log10(y.pos)) * (b.lm - a.lm), 0) END, 6) AS log_mass
FROM y LEFT JOIN r a ON a.run_id = y.run_id AND a.pos = y.pos LEFT JOIN r b ON b.run_id = y.run_id AND b.pos = y.pos + 1"""


@query(HL + _abundance_sql(1.0))
def j6_abundance_match(spark, sf_dir):
    got = ranks.abundance_match(low(spark, sf_dir), high(spark, sf_dir), ["run_id"], "m200b", "id")
    return got.select("run_id", "id", r(F.log10("matched_mass")).alias("log_mass"))


@query(HL + _abundance_sql(1.25))
def j6_abundance_match_volumes(spark, sf_dir):
    got = ranks.abundance_match(low(spark, sf_dir), high(spark, sf_dir), ["run_id"], "m200b", "id", volume_ratio=1.25)
    return got.select("run_id", "id", r(F.log10("matched_mass")).alias("log_mass"))


@query(HL + """, r AS (SELECT run_id, m200b AS m, row_number() OVER (PARTITION BY run_id ORDER BY m200b, id) AS pos FROM hr WHERE m200b > 0),
n AS (SELECT run_id, max(pos) AS n_ref FROM r GROUP BY 1),
t AS (SELECT run_id, id, rank() OVER (PARTITION BY run_id ORDER BY m200b) + (count(*) OVER (PARTITION BY run_id, m200b) - 1) / 2 AS rank, count(*) OVER (PARTITION BY run_id) AS n_tgt FROM lr WHERE m200b > 0),
x AS (SELECT t.run_id, id, n_ref, CASE WHEN n_ref IS NOT NULL THEN greatest(1.0, least(rank / (n_tgt + 1) * (n_ref + 1), n_ref::DOUBLE)) END AS x FROM t LEFT JOIN n USING (run_id))
SELECT x.run_id, x.id, round(log10(a.m + coalesce((x - floor(x)) * (b.m - a.m), 0)), 6) AS log_mass
FROM x LEFT JOIN r a ON a.run_id = x.run_id AND a.pos = floor(x) LEFT JOIN r b ON b.run_id = x.run_id AND b.pos = floor(x) + 1""")
def j7_abundance_match_cdf(spark, sf_dir):
    got = ranks.abundance_match_cdf(low(spark, sf_dir), high(spark, sf_dir), ["run_id"], "m200b", "id")
    return got.select("run_id", "id", r(F.log10("matched_mass")).alias("log_mass"))


@query(D + ", s AS (SELECT unnest([0.25, 0.5, 1.0, 2.0])::DOUBLE AS s0, unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS s1) SELECT descriptor_halo_id, batch_day::VARCHAR AS batch_day, s0, s1 FROM ds JOIN s ON s0 <= halo_rg AND halo_rg < s1")
def j8_scale_brackets(spark, sf_dir):
    return environment.scale_brackets(described(spark, sf_dir), SCALES, "halo_rg").select("descriptor_halo_id", _day(), "s0", "s1")


@query(H + f", {LOW_SQL}, hc AS (SELECT {_bin_sql('m200b', _EDGES_SQL, 12)} AS bin, count(*)::DOUBLE AS y FROM hr WHERE m200b IS NOT NULL GROUP BY 1), lc AS (SELECT {_bin_sql('m200b', _EDGES_SQL, 12)} AS bin, count(*)::DOUBLE AS y FROM lr WHERE m200b IS NOT NULL GROUP BY 1), "
  "h2 AS (SELECT bin AS x0, y AS y0, lead(bin) OVER (ORDER BY bin) AS x1, lead(y) OVER (ORDER BY bin) AS y1 FROM hc WHERE bin IS NOT NULL), q AS (SELECT l.bin + 0.5 AS x, l.y AS y, (SELECT y0 + (l.bin + 0.5 - x0) * (y1 - y0) / (x1 - x0) FROM h2 WHERE x0 <= l.bin + 0.5 AND l.bin + 0.5 < x1) AS pos FROM lc l WHERE bin IS NOT NULL) SELECT x::DOUBLE AS x, round(y / pos, 6) AS ratio FROM q")
def j11_curve_ratio(spark, sf_dir):
    count = lambda df, shift: df.select(C.bin_of(F.col("m200b"), MASS_EDGES, True).alias("bin")).where("bin IS NOT NULL").groupBy((F.col("bin") + shift).cast("double").alias("x")).agg(F.count("*").cast("double").alias("y")).withColumn("g", F.lit(0))
    return stats.curve_ratio(count(low(spark, sf_dir), 0.5), count(high(spark, sf_dir), 0.0), ["g"]).select("x", r("ratio").alias("ratio"))


# aggregates

_VOLUME = "count(DISTINCT box) * max(side) ** 3"


def _volumes(halos: DataFrame) -> DataFrame:
    return halos.join(halos.groupBy("run_id").agg((F.countDistinct("box") * F.pow(F.max("side"), F.lit(3))).alias("volume")), "run_id")


@query(H + f", v AS (SELECT run_id, {_VOLUME} AS volume FROM hr GROUP BY 1) SELECT hr.run_id, id, row_number() OVER (PARTITION BY hr.run_id ORDER BY m200b DESC, id) AS rank, round(log10(row_number() OVER (PARTITION BY hr.run_id ORDER BY m200b DESC, id) / volume), 6) AS log_n_above FROM hr JOIN v USING (run_id) WHERE m200b > 0")
def a8_cumulative_mass_function(spark, sf_dir):
    got = ranks.cumulative_counts(_volumes(high(spark, sf_dir)), ["run_id"], "m200b", "id", F.col("volume"))
    return got.select("run_id", "id", "rank", r(F.log10("n_above")).alias("log_n_above"))


_HMF = f""", v AS (SELECT run_id, {_VOLUME} AS volume FROM hr GROUP BY 1), b AS (SELECT unnest(range(12))::INTEGER AS bin),
n AS (SELECT run_id, {_bin_sql('m200b', _EDGES_SQL, 12)} AS bin, count(*) AS n FROM hr GROUP BY ALL),
hmf AS (SELECT v.run_id, b.bin, {_EDGES_SQL}[b.bin + 1] AS lo, {_EDGES_SQL}[b.bin + 2] AS hi, coalesce(n.n, 0) AS n, coalesce(n.n, 0) / volume AS density FROM v CROSS JOIN b LEFT JOIN n ON n.run_id = v.run_id AND n.bin = b.bin) """


def _hmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    halos = stage(high(spark, sf_dir).select("run_id", "box", "side", "m200b"), "halos")
    return stats.mass_function(_volumes(halos), MASS_EDGES, ["run_id"], volume=F.col("volume"))


@query(H + _HMF + "SELECT run_id, bin, round((lo + hi) / 2 / 1e9, 6) AS center, n, round(density, 12) AS density FROM hmf")
def a9_mass_function(spark, sf_dir):
    return _hmf(spark, sf_dir).select("run_id", "bin", r(F.col("center") / 1e9).alias("center"), "n", r("density", 12).alias("density"))


@query(H + _HMF + "SELECT run_id, bin, round(log10(density), 6) AS log_density FROM hmf WHERE n > 0")
def a10_log_mass_function(spark, sf_dir):
    return stats.log_mass_function(_hmf(spark, sf_dir)).select("run_id", "bin", r("log_density").alias("log_density"))


@query(HL + f", a AS (SELECT {_bin_sql('m200b', _EDGES_SQL, 12)} AS bin, count(*) AS n FROM hr GROUP BY 1), b AS (SELECT {_bin_sql('m200b', _EDGES_SQL, 12)} AS bin, count(*) AS n FROM lr GROUP BY 1), c AS (SELECT unnest(range(12))::INTEGER AS bin) SELECT c.bin, coalesce(a.n, 0) AS high, coalesce(b.n, 0) AS low FROM c LEFT JOIN a USING (bin) LEFT JOIN b ON b.bin = c.bin")
def a11_mass_functions_side_by_side(spark, sf_dir):
    both = high(spark, sf_dir).select(F.lit("high").alias("catalog"), "m200b").unionByName(low(spark, sf_dir).select(F.lit("low").alias("catalog"), "m200b"))
    both = stage(both, "halos")
    return stats.pivoted(stats.mass_function(both, MASS_EDGES, ["catalog"]), "catalog", ["high", "low"], "n")


@query(H + f", n AS (SELECT box, max(side) AS side, {_bin_sql('m200b', _EDGES_SQL, 12)} AS bin, count(*) AS n FROM hr GROUP BY box, 3), s AS (SELECT box, max(side) AS side FROM hr GROUP BY 1), c AS (SELECT unnest(range(12))::INTEGER AS bin), e AS (SELECT s.box, s.side, c.bin, coalesce(n.n, 0) AS n FROM s CROSS JOIN c LEFT JOIN n ON n.box = s.box AND n.bin = c.bin) SELECT bin, round(avg(CASE WHEN n > 0 THEN n / side ** 3 END), 10) AS mean_density, round(avg(n), 6) AS mean_n, count(DISTINCT box) AS n_realisations FROM e GROUP BY 1")
def a12_mean_of_boxes(spark, sf_dir):
    hmf = stats.mass_function(stage(high(spark, sf_dir).select("box", "side", "m200b"), "halos"), MASS_EDGES, ["box"], volume=F.pow(F.col("side"), F.lit(3)))
    return stats.mean_of_realisations(hmf, "box", []).select("bin", r("mean_density", 10).alias("mean_density"), r("mean_n").alias("mean_n"), "n_realisations")


_LOGM = "log10(CASE WHEN m200b > 0 THEN m200b END)"


@query(H + f", b AS (SELECT {_bin_sql(_LOGM, _LOG_EDGES_SQL, 12)} AS bin, log10(cv) AS v FROM hr WHERE cv > 0) SELECT bin::INTEGER AS bin, round(power(10, quantile_cont(v, 0.5)), 6) AS median, round(power(10, avg(v)), 6) AS mean FROM b WHERE bin IS NOT NULL GROUP BY 1")
def a13_log_median_by_mass(spark, sf_dir):
    got = stats.log_median_by_mass(high(spark, sf_dir), LOG_EDGES, "cv", [])
    return got.select(F.col("bin").cast("int").alias("bin"), r("median").alias("median"), r("mean").alias("mean"))


@query(H + f", b AS (SELECT run_id, {_bin_sql(_LOGM, _LOG_EDGES_SQL, 12, False)} AS bin, spin AS v FROM hr WHERE spin IS NOT NULL) SELECT run_id, bin::INTEGER AS bin, count(*) AS n, round(quantile_cont(v, 0.5), 8) AS median, round(stddev_pop(v), 8) AS std, round((quantile_cont(v, 0.8415) - quantile_cont(v, 0.1585)) / 2, 12) AS half_width, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(v) / sqrt(count(*)) END, 8) AS sem FROM b WHERE bin IS NOT NULL GROUP BY ALL")
def a14_binned_spread(spark, sf_dir):
    rows = high(spark, sf_dir)
    got = stats.binned(rows, F.log10(F.when(F.col("m200b") > 0, F.col("m200b"))), LOG_EDGES, "spin", ["run_id"])
    return got.select("run_id", F.col("bin").cast("int").alias("bin"), "n", *[r(c, 12 if c == "half_width" else 8).alias(c) for c in ("median", "std", "half_width", "sem")])


_X_EDGES, _Y_EDGES = C.linear_grid(0.0, 1.0, 16), C.linear_grid(0.0, 1.0, 16)
_SQL_EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in _X_EDGES) + "]"
_HIST = f", q AS (SELECT run_id, {_bin_sql('ca', _SQL_EDGES, 15)} AS bx, {_bin_sql('ba', _SQL_EDGES, 15)} AS by_ FROM hr), hist AS (SELECT run_id, bx, by_, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY run_id) AS share FROM q WHERE bx IS NOT NULL AND by_ IS NOT NULL GROUP BY run_id, bx, by_) "


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram2d(high(spark, sf_dir), "ca", "ba", _X_EDGES, _Y_EDGES, ["run_id"])


@query(H + _HIST + "SELECT run_id, bx::INTEGER AS bx, by_::INTEGER AS by, n, round(share, 9) AS share FROM hist")
def a17_histogram2d(spark, sf_dir):
    return _hist(spark, sf_dir).select("run_id", F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), "n", r("share", 9).alias("share"))


@query(H + _HIST + """, top AS (SELECT run_id, max(share) AS top, min(share) AS low FROM hist GROUP BY 1), st AS (SELECT run_id, top * (k / 19) AS t FROM top, (SELECT unnest(range(20)) AS k)),
c AS (SELECT h.run_id, t, round(sum(CASE WHEN share >= t THEN share ELSE 0 END), 12) AS s FROM hist h JOIN st USING (run_id) GROUP BY ALL), d AS (SELECT run_id, s, min(t) AS t FROM c GROUP BY ALL), l AS (SELECT unnest([0.95, 0.68, 0.4])::DOUBLE AS level),
e AS (SELECT d.run_id, level, max(CASE WHEN s <= level THEN s END) AS s0, min(CASE WHEN s >= level THEN s END) AS s1 FROM d, l GROUP BY ALL),
f AS (SELECT e.run_id, level, a.t AS t0, b.t AS t1, s0, s1 FROM e LEFT JOIN d a ON a.run_id = e.run_id AND a.s = s0 LEFT JOIN d b ON b.run_id = e.run_id AND b.s = s1),
g AS (SELECT f.run_id, level, coalesce(t0 + CASE WHEN s1 = s0 THEN 0 ELSE (level - s0) * (t1 - t0) / (s1 - s0) END, t0, t1) AS threshold FROM f JOIN top USING (run_id) WHERE low < top)
SELECT run_id, level, round(threshold, 8) AS threshold FROM g UNION ALL SELECT run_id, level, round(top * level, 8) FROM top, l WHERE low = top UNION ALL SELECT run_id, 1.0::DOUBLE, 1.0::DOUBLE FROM top""")
def a18_density_levels(spark, sf_dir):
    return stats.density_levels(_hist(spark, sf_dir), ["run_id"]).select("run_id", "level", r("threshold", 8).alias("threshold"))


_PROPS = ["cv", "spin"]
_JOINT = """, k AS (SELECT run_id, id, cv, spin, x FROM hr WHERE cv IS NOT NULL AND spin IS NOT NULL),
l AS (SELECT run_id, id, greatest(count(*) OVER (PARTITION BY run_id ORDER BY cv RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), count(*) OVER (PARTITION BY run_id ORDER BY spin RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS m FROM k),
o AS (SELECT run_id, m, row_number() OVER (PARTITION BY run_id ORDER BY m, id) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM l),
p AS (SELECT run_id, n, least(greatest(coalesce(100.0 * m / nullif(n - 1, 0), 0), 1e-6), 99.99) AS p FROM o WHERE rn = ceil(n * 0.25)),
va AS (SELECT run_id, list(cv ORDER BY cv) AS c, list(spin ORDER BY spin) AS s FROM k GROUP BY 1),
lim AS (SELECT run_id, p, n, round((p / 100 * (n - 1) + 1)::DOUBLE, 9) AS xl, round(((100 - p) / 100 * (n - 1) + 1)::DOUBLE, 9) AS xh, c, s FROM p JOIN va USING (run_id)),
lm AS (SELECT run_id, p, n, """ + ", ".join(
    f"{a}[floor(x{e})::BIGINT] + coalesce((x{e} - floor(x{e})) * ({a}[floor(x{e})::BIGINT + 1] - {a}[floor(x{e})::BIGINT]), 0) AS {w}_{q}" for a, q in (("c", "cv"), ("s", "spin")) for e, w in (("l", "low"), ("h", "high"))
) + " FROM lim) "


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = high(spark, sf_dir)
    return tails.tail_limits(rows, ["run_id"], _PROPS, tails.joint_percentile(rows, ["run_id"], _PROPS, "id"))


@query(H + _JOINT + "SELECT run_id, n, round(p, 8) AS p FROM p")
def a19_joint_percentile(spark, sf_dir):
    return tails.joint_percentile(high(spark, sf_dir), ["run_id"], _PROPS, "id").select("run_id", "n", r("p", 8).alias("p"))


@query(H + _JOINT + "SELECT hr.id, coalesce(hr.cv <= low_cv AND hr.spin <= low_spin, false) AS lower, coalesce(hr.cv >= high_cv AND hr.spin >= high_spin, false) AS upper FROM hr LEFT JOIN lm USING (run_id)")
def a20_joint_tails(spark, sf_dir):
    return tails.in_tails(high(spark, sf_dir), _limits(spark, sf_dir), ["run_id"], _PROPS).select("id", "lower", "upper")


@query(H + _JOINT + ", z AS (SELECT run_id, ca, coalesce(hr.cv <= low_cv AND hr.spin <= low_spin, false) AS lower, coalesce(hr.cv >= high_cv AND hr.spin >= high_spin, false) AS upper FROM hr LEFT JOIN lm USING (run_id)), y AS (SELECT run_id, 'lower' AS tail, ca FROM z WHERE lower UNION ALL SELECT run_id, 'upper', ca FROM z WHERE upper) SELECT run_id, tail, count(ca) AS n, round(avg(ca), 8) AS mean_bias, round(CASE WHEN count(ca) = 1 THEN 0 WHEN count(ca) > 1 THEN stddev_samp(ca) / sqrt(count(ca)) END, 8) AS sem FROM y GROUP BY ALL")
def a21_tail_curves(spark, sf_dir):
    marked = tails.in_tails(high(spark, sf_dir), _limits(spark, sf_dir), ["run_id"], _PROPS)
    return tails.bias_curves(marked, ["run_id"], "ca", F.lit(None)).select("run_id", "tail", "n", r("mean_bias", 8).alias("mean_bias"), r("sem", 8).alias("sem"))


@query(H + "SELECT run_id, count(*) AS n, round(quantile_cont(cv, 0.5), 6) AS median_cv, round(quantile_cont(spin, 0.5), 8) AS median_spin, round(covar_samp(cv, cv), 6) AS cov_cv_cv, round(covar_samp(cv, spin), 8) AS cov_cv_spin, round(covar_samp(spin, spin), 8) AS cov_spin_spin FROM hr WHERE cv IS NOT NULL AND spin IS NOT NULL GROUP BY 1")
def a22_covariances(spark, sf_dir):
    got = stats.covariances(high(spark, sf_dir), ["run_id"], ["cv", "spin"])
    return got.select("run_id", "n", r("median_cv").alias("median_cv"), r("median_spin", 8).alias("median_spin"), r("cov_cv_cv").alias("cov_cv_cv"), r("cov_cv_spin", 8).alias("cov_cv_spin"), r("cov_spin_spin", 8).alias("cov_spin_spin"))


@query(H + "SELECT box, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM hr GROUP BY 1")
def a23_extents(spark, sf_dir):
    return stats.extents(high(spark, sf_dir), ["box"])


@query(L + ", q AS (SELECT run_id, CASE WHEN m200b > 0 THEN m200b END AS m FROM lr) SELECT run_id, count(*) AS n, count(m) AS n_known, round(count(m) / count(*), 9) AS known_share, round(avg(log10(m)), 6) AS mean_log, round(stddev_pop(log10(m)), 6) AS std_log, round(quantile_cont(m, 0.5) / 1e9, 6) AS median FROM q GROUP BY 1")
def a24_calibration_summary(spark, sf_dir):
    got = stats.calibration_summary(low(spark, sf_dir), ["run_id"], "m200b")
    return got.select("run_id", "n", "n_known", r("known_share", 9).alias("known_share"), r("mean_log").alias("mean_log"), r("std_log").alias("std_log"), r(F.col("median") / 1e9).alias("median"))


@query(D + "SELECT cell_x, cell_y, cell_z, descriptor_halo_id, batch_day::VARCHAR AS batch_day FROM ds QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y, cell_z ORDER BY batch_day, descriptor_halo_id) = 1")
def a25_first_per_cell(spark, sf_dir):
    rows = described(spark, sf_dir).select("cell_x", "cell_y", "cell_z", "descriptor_halo_id", "batch_day")
    return stats.first_per_key(rows, ["cell_x", "cell_y", "cell_z"], [F.col("batch_day"), F.col("descriptor_halo_id")]).withColumn("batch_day", F.col("batch_day").cast("string"))


@query(H + ", q AS (SELECT run_id, rank() OVER (PARTITION BY run_id ORDER BY cv) + (count(*) OVER (PARTITION BY run_id, cv) - 1) / 2 AS a, rank() OVER (PARTITION BY run_id ORDER BY spin) + (count(*) OVER (PARTITION BY run_id, spin) - 1) / 2 AS b FROM hr WHERE cv IS NOT NULL AND spin IS NOT NULL) SELECT run_id, count(*) AS n, CASE WHEN count(*) > 1 THEN round(corr(a, b), 6) END AS rho FROM q GROUP BY 1")
def a26_spearman(spark, sf_dir):
    got = ranks.spearman(high(spark, sf_dir), ["run_id"], "cv", "spin")
    return got.select("run_id", "n", F.when(F.col("n") > 1, r("rho")).alias("rho"))


@query(H + "SELECT id, row_number() OVER (ORDER BY m200b DESC NULLS LAST, id) AS rank FROM hr WHERE m200b IS NOT NULL")
def w1_global_rank(spark, sf_dir):
    rows = high(spark, sf_dir).where("m200b IS NOT NULL").select("id", "m200b")
    return ranks.row_numbers(rows, [], [F.desc("m200b"), F.asc("id")]).select("id", "rank")


@query(H + "SELECT id, (rank() OVER (PARTITION BY run_id ORDER BY ca) + (count(*) OVER (PARTITION BY run_id, ca) - 1) / 2)::DOUBLE AS rank FROM hr WHERE ca IS NOT NULL")
def w2_average_rank(spark, sf_dir):
    return ranks.average_ranks(high(spark, sf_dir).where("ca IS NOT NULL").select("id", "run_id", "ca"), ["run_id"], "ca").select("id", F.col("rank").cast("double").alias("rank"))


@query(H + "SELECT id, ((id % 1000003) * 7919 + 31) % 1000003 < 800002 AS train FROM hr")
def u2_split(spark, sf_dir):
    draw = F.pmod(F.pmod(F.col("id"), F.lit(1000003)) * 7919 + 31, F.lit(1000003))
    return high(spark, sf_dir).select("id", (draw < 800002).alias("train"))


# fields

_DFT = f"""
, w AS (SELECT *, 2 * pi() / side * (CASE WHEN i < {N // 2} THEN i ELSE i - {N} END) AS kx, 2 * pi() / side * (CASE WHEN j < {N // 2} THEN j ELSE j - {N} END) AS ky, 2 * pi() / side * (CASE WHEN k < {N // 2} THEN k ELSE k - {N} END) AS kz FROM cube)
, f AS (SELECT w.space, w.side, w.i, w.j, w.k, any_value(w.kx) AS kx, any_value(w.ky) AS ky, any_value(w.kz) AS kz, sum(v * cos(2 * pi() * (w.i * r.i + w.j * r.j + w.k * r.k) / {N})) AS re, -sum(v * sin(2 * pi() * (w.i * r.i + w.j * r.j + w.k * r.k) / {N})) AS im FROM w JOIN filled r USING (space) GROUP BY ALL)
, f2 AS (SELECT *, kx * kx + ky * ky + kz * kz AS k2 FROM f)
"""


def _back(value: str) -> str:
    return f"sum({value} * (re * cos(2 * pi() * (c.i * f2.i + c.j * f2.j + c.k * f2.k) / {N}) - im * sin(2 * pi() * (c.i * f2.i + c.j * f2.j + c.k * f2.k) / {N}))) / {N**3}"


@grid_query(H + _CORNERS + _DFT + f"SELECT c.space, c.i, c.j, c.k, round({_back('exp(-k2 * 50)')}, 6) + 0.0 AS delta FROM cube c JOIN f2 USING (space) GROUP BY ALL", columns=PLACE)
def m8_smoothed(halos, n):
    return fields.smoothed_points(halos, box_sides(halos), n, 10.0, digits=6).withColumnRenamed("v", "delta")


@grid_query(H + _CORNERS + _DFT + ", t AS (SELECT c.space, c.i, c.j, c.k, " + ", ".join(f"({_back(f'(CASE WHEN k2 > 0 THEN k{a} * k{b} / k2 ELSE 0 END) * exp(-k2 * 50)')})::DOUBLE AS t{n}" for a, b, n in (("x", "x", "00"), ("x", "y", "01"), ("x", "z", "02"), ("y", "y", "11"), ("y", "z", "12"), ("z", "z", "22"))) + " FROM cube c JOIN f2 USING (space) GROUP BY ALL) SELECT space, 10.0::DOUBLE AS scale, i, j, k, " + ", ".join(f"round(t{n}, 4) + 0.0 AS t{n}" for n in ("00", "01", "02", "11", "12", "22")) + " FROM t", columns=PLACE, scales=RUN_SCALES)
def m9_tidal_tensor(halos, n, scales=(10.0,)):
    return fields.tidal_tensors_of_points(halos, box_sides(halos), n, list(scales), digits=4)


def _tensor_sql(scale: float) -> str:
    parts = {n: _back(f"(CASE WHEN k2 > 0 THEN k{a} * k{b} / k2 ELSE 0 END) * exp(-k2 * {scale * scale / 2})") for a, b, n in (("x", "x", "00"), ("x", "y", "01"), ("x", "z", "02"), ("y", "y", "11"), ("y", "z", "12"), ("z", "z", "22"))}
    return f"SELECT c.space, {scale}::DOUBLE AS scale, c.i, c.j, c.k, " + ", ".join(f"round(({v})::DOUBLE, 4) + 0.0 AS t{n}" for n, v in parts.items()) + " FROM cube c JOIN f2 USING (space) GROUP BY c.space, c.i, c.j, c.k"


@query(H + _CORNERS + _DFT + _tensor_sql(8.0) + " UNION ALL " + _tensor_sql(14.0))
def m10_tensors_at_two_scales(spark, sf_dir):
    halos = high(spark, sf_dir)
    got = fields.tidal_tensors(_delta(halos, N), box_sides(halos), N, [8.0, 14.0], kind="double")
    return got.select("space", "scale", "i", "j", "k", *[(r(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in environment.COMPONENTS])


@query(H + """, q AS (SELECT id, cv AS t00, spin AS t01, ca AS t02, ba AS t11, spin * 2 AS t12, ca * ba AS t22 FROM hr WHERE cv IS NOT NULL AND spin IS NOT NULL AND ca IS NOT NULL AND ba IS NOT NULL),
p AS (SELECT *, (t00 + t11 + t22) / 3 AS q, t01 * t01 + t02 * t02 + t12 * t12 AS off FROM q), s AS (SELECT *, sqrt(((t00 - q) ** 2 + (t11 - q) ** 2 + (t22 - q) ** 2 + 2 * off) / 6) AS p FROM p),
h AS (SELECT *, ((t00 - q) * ((t11 - q) * (t22 - q) - t12 * t12) - t01 * (t01 * (t22 - q) - t12 * t02) + t02 * (t01 * t12 - (t11 - q) * t02)) / (2 * p * p * p) AS half FROM s),
e AS (SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, half))) / 3) AS l3, q + 2 * p * cos(acos(greatest(-1, least(1, half))) / 3 + 2 * pi() / 3) AS l1 FROM h), g AS (SELECT id, l1, 3 * q - l1 - l3 AS l2, l3 FROM e)
SELECT id, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l3, 6) AS l3, round(sqrt(((l1 - l2) ** 2 + (l2 - l3) ** 2 + (l3 - l1) ** 2) / 2) / (1 + l1 + l2 + l3 + 1e-15), 6) AS alpha FROM g""")
def m11_eigenvalues(spark, sf_dir):
    rows = high(spark, sf_dir).na.drop(subset=["cv", "spin", "ca", "ba"])
    lam = environment.eigenvalues(F.col("cv"), F.col("spin"), F.col("ca"), F.col("ba"), F.col("spin") * 2, F.col("ca") * F.col("ba"))
    rows = rows.withColumn("l", lam).select("id", *[F.get("l", F.lit(k)).alias(f"l{k + 1}") for k in range(3)])
    return rows.select("id", r("l1").alias("l1"), r("l2").alias("l2"), r("l3").alias("l3"), r(environment.anisotropy(F.col("l1"), F.col("l2"), F.col("l3"))[0]).alias("alpha"))


@grid_query(scales=RUN_SCALES)
def m12_tidal_descriptors(halos, n, scales=(0.125, *SCALES)):
    placed = grid.nearest_cells(grid.placed(halos), n).withColumns({"space": F.col("box"), "rg": C.gaussian_radius(C.r200b(F.col("m200b"), F.col("om"), F.col("h")))})
    tensors = stage(fields.tidal_tensors_at(environment.cells_read(placed, list(scales)), _sparse_delta(halos, n), box_sides(halos), n, list(scales), empty=-1.0), "tensors")
    got = environment.descriptors(placed, tensors, list(scales))
    return got.select("id", r("tidal_anisotropy", 4).alias("tidal_anisotropy"), r("overdensity", 4).alias("overdensity"))


@grid_query(H + _CORNERS + _DFT + f", b AS (SELECT c.space, c.i, c.j, c.k, sum(CASE WHEN k2 > 0 AND sqrt(k2) <= 0.2 THEN 1 / greatest((re * re + im * im) / {N**3}.0 / {N**3}.0 * c.side ** 3, 1e-30) ELSE 0 END * (re * cos(2 * pi() * (c.i * f2.i + c.j * f2.j + c.k * f2.k) / {N}) - im * sin(2 * pi() * (c.i * f2.i + c.j * f2.j + c.k * f2.k) / {N}))) / {N**3} AS v FROM cube c JOIN f2 USING (space) GROUP BY ALL) SELECT c.id, round(sum(w * b.v), 4) + 0.0 AS bias FROM c JOIN b ON b.space = c.box AND b.i = c.i AND b.j = c.j AND b.k = c.k GROUP BY 1")
def m13_halo_bias(halos, n):
    return fields.halo_bias(halos, _sparse_delta(halos, n), box_sides(halos), n, 0.2, empty=-1.0).select("id", (r("v", 4) + 0.0).alias("bias"))
