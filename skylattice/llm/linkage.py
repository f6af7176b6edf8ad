"""Matching the halos of two catalogues without a common key, by an inverted index and BM25.

Every attribute (three coordinates, mass, spin) is cut into narrow intervals,
the terms. The first catalogue is the index, each box a corpus of its own: a
halo is posted under the term of each attribute that it has. The second asks;
its query holds, for each attribute, the terms within reach of its own value
with a weight that falls with the square of the distance from 1 to 0. A term's
document count takes in the terms beside it, as a query asks for them together.
BM25 adds over all attributes the inverse document frequency of the shared term
times its weight, normalised by the number of attributes that a halo has.

The lists that are walked are those of cells of the box, since a partner lies
within the match radius. Each list knows the highest weights in it, so that a
list that cannot reach the k-th best of the nearest lists is left out: the top k
are exact. Pairs that are best for both are matches; halos left over go on among
those left, and one whose whole list is taken gets a longer list. The confidence
comes from score and gap, the distance to the next best, by a logistic
regression against decoys, halos moved to another place of their box.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skylattice.runtime import finite, stage

K1, B = 1.2, 0.75
#: how far a query reaches: in match radii for a coordinate, in dex for mass, in natural logarithms for spin
REACH = {"x": 0.3, "y": 0.3, "z": 0.3, "lm": 0.2, "ls": 0.4}
#: terms to a reach, and terms to either side whose documents count with a term's own
STEPS, BESIDE = 8, 2
#: entries of a query's list; a halo that finds all of them taken gets its whole list
TOP = 10
#: halos that a list of a cell holds, about
LIST_HALOS = 32
#: halos whose decoys calibrate the confidence, about, in whole boxes
CALIBRATION_ROWS = 20_000
PLACE, OTHER = ("x", "y", "z"), ("lm", "ls")


def prepared(halos: DataFrame, id_: str, runs: DataFrame) -> DataFrame:
    """(id, box, x, y, z, lm, ls, mass, side, r_match, max_gap): each halo once, ready to match.

    Halos with a null, NaN or infinite coordinate, or of an unknown run, can't be
    matched and are left out. Coordinates are folded into the box. Mass and spin
    that are null, NaN or not positive are missing and say nothing for or against
    a match. Rows that repeat an id count once.
    """
    positive = lambda c: F.when(finite(F.col(c)) & (F.col(c) > 0), F.col(c))
    settings = runs.groupBy("run_id").agg(*[F.max(c).alias(a) for c, a in (("boxsize_mpc_h", "side"), ("r_match_mpc_h", "r_match"), ("max_mass_distance", "max_gap"))])
    one = halos.groupBy(F.col(id_).cast("long").alias("id")).agg(F.max("run_id").alias("run_id"), F.max("box_id").alias("box_id"), *[F.max(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("halo_x", "halo_y", "halo_z", "m200b", "spin")])
    placed = one.join(settings, "run_id").where(F.col("id").isNotNull() & finite(F.col("halo_x")) & finite(F.col("halo_y")) & finite(F.col("halo_z")) & (F.col("side") > 0) & (F.col("r_match") > 0))
    return placed.select(
        "id", F.col("box_id").alias("box"), *[F.pmod(f"halo_{a}", "side").alias(a) for a in "xyz"],
        F.log10(positive("m200b")).alias("lm"), F.log(positive("spin")).alias("ls"), positive("m200b").alias("mass"), "side", "r_match", "max_gap",
    )


def _steps() -> Column:
    """The number of terms along an axis of the box."""
    return F.greatest(F.lit(1), F.floor(F.col("side") * STEPS / (F.col("r_match") * REACH["x"]))).cast("int")


def term(attribute: str) -> Column:
    """The term of an attribute: the number of its interval, null where the attribute is missing."""
    if attribute in PLACE:
        return F.least(F.floor(F.col(attribute) / F.col("side") * _steps()), _steps() - 1).cast("int")
    return F.floor(F.col(attribute) * STEPS / REACH[attribute]).cast("int")


def _middle(attribute: str, value: Column) -> Column:
    """The middle of the interval of a halo's term."""
    if attribute in PLACE:
        n = _steps()
        return (F.least(F.floor(value / F.col("side") * n), n - 1) + 0.5) * F.col("side") / n
    return (F.floor(value * STEPS / REACH[attribute]) + 0.5) * REACH[attribute] / STEPS


def document_counts(documents: DataFrame) -> DataFrame:
    """(box, attribute, term, df): the halos under each term and those beside it; along the axes these go around the box."""
    posted = documents.select("box", _steps().alias("n"), F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), term(a).alias("term")) for a in REACH])).alias("p"))
    counts = posted.where("p.term IS NOT NULL").groupBy("box", "p.attribute", "p.term").agg(F.count("*").alias("df"), F.max("n").alias("n"))
    beside = F.transform(F.sequence(F.lit(-BESIDE), F.lit(BESIDE)), lambda k: F.when(F.col("attribute").isin(*PLACE), F.pmod(F.col("term") + k, F.col("n"))).otherwise(F.col("term") + k))
    return counts.select("box", "attribute", F.explode(F.array_distinct(beside)).alias("term"), "df").groupBy("box", "attribute", "term").agg(F.sum("df").alias("df"))


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def indexed(documents: DataFrame) -> DataFrame:
    """The documents with the BM25 impact ``i_<attribute>`` of each term, and the cell whose list they are in."""
    known = sum((F.col(a).isNotNull().cast("int") for a in OTHER), F.lit(len(PLACE)))
    boxes = documents.groupBy("box").agg(F.count("*").alias("n_docs"), F.avg(known).alias("mean_terms"))
    # one row a box, with the terms of its few attributes; their number follows from the side and the ranges, not from the halos
    terms = document_counts(documents).groupBy("box").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("attribute") == a, F.struct("term", "df")))).alias(f"df_{a}") for a in REACH])
    joined = documents.join(boxes.join(terms, "box"), "box")
    norm = (K1 + 1) / (1 + K1 * (1 - B + B * known / F.col("mean_terms")))
    impact = lambda a: F.coalesce(idf(F.try_element_at(f"df_{a}", term(a)), F.col("n_docs")) * norm, F.lit(0.0)).cast("float")
    # cells hold about LIST_HALOS, but are no wider than a match radius to either side and no narrower than half of one
    width = F.greatest(F.col("r_match") / 2, F.least(F.col("r_match") * 2, F.cbrt(LIST_HALOS * F.pow("side", F.lit(3)) / F.col("n_docs"))))
    cells = F.greatest(F.lit(1), F.floor(F.col("side") / width)).cast("int")
    rows = joined.select(*documents.columns, *[impact(a).alias(f"i_{a}") for a in REACH], cells.alias("cells"))
    return rows.withColumn("cell", _cell(*[_slot(F.col(a)) for a in PLACE]))


def _slot(value: Column) -> Column:
    return F.least(F.floor(value / F.col("side") * F.col("cells")), F.col("cells") - 1).cast("int")


def _cell(x: Column, y: Column, z: Column) -> Column:
    return (x * F.col("cells") + y) * F.col("cells") + z


def lists(index: DataFrame) -> DataFrame:
    """(box, cell, most_<attribute>): the highest impacts in the list of each cell."""
    return index.groupBy("box", "cell").agg(*[F.max(f"i_{a}").alias(f"most_{a}") for a in REACH])


def _weight(apart: Column, attribute: str) -> Column:
    reach = F.col("r_match") * REACH[attribute] if attribute in PLACE else F.lit(REACH[attribute])
    return F.greatest(F.lit(0.0), 1 - (apart / reach) * (apart / reach))


def _round(apart: Column) -> Column:
    """A difference of coordinates to the nearest image."""
    return apart - F.col("side") * F.rint(apart / F.col("side"))


def _touched(at: Column, reach: Column, width: Column, far: bool) -> Column:
    """The cells along an axis that are within reach of a place, each with the gap to it."""
    steps = F.sequence(F.floor((at - reach) / width), F.floor((at + reach) / width))
    gap = lambda k: F.greatest(F.lit(0.0), k * width - at, at - (k + 1) * width) if far else F.lit(0.0)
    return F.array_distinct(F.transform(steps, lambda k: F.struct(F.pmod(k, F.col("cells")).cast("int").alias("at"), gap(k).alias("gap"))))


def _asks(asking: DataFrame, far: bool) -> DataFrame:
    """The queries at each list that a ball around them touches: of the radius or, near, at most half a cell.

    With ``far`` a list has gap_x, gap_y, gap_z, how far the query is from its cell along each axis.
    """
    reach = F.col("r_match") if far else F.least(F.col("r_match"), F.col("side") / F.col("cells") / 2)
    width = F.col("side") / F.col("cells")
    for a in PLACE:
        asking = asking.withColumn(f"_{a}", F.explode(_touched(F.col(a), reach, width, far)))
    rows = asking.withColumn("cell", _cell(*[F.col(f"_{a}.at") for a in PLACE]))
    if not far:
        return rows.drop(*[f"_{a}" for a in PLACE])
    gaps = [F.col(f"_{a}.gap").alias(f"gap_{a}") for a in PLACE]
    # within the radius; a cell met by several images is kept at the nearest one along each axis
    within = rows.where(sum((F.col(f"_{a}.gap") * F.col(f"_{a}.gap") for a in PLACE), F.lit(0.0)) < F.col("r_match") * F.col("r_match"))
    return within.select(*[c for c in rows.columns if c not in ("_x", "_y", "_z")], *gaps)


def _scored(asks: DataFrame, index: DataFrame) -> DataFrame:
    """(hr, lr, d, bm25) of the halos in the lists asked, within radius and mass distance and with a score above 0."""
    own = [*PLACE, *OTHER, "mass"]
    held = index.select("box", "cell", F.col("id").alias("hr"), *[F.col(c).alias(f"h_{c}") for c in own], *[f"i_{a}" for a in REACH], "side", "r_match", "max_gap")
    met = held.join(asks.select("box", "cell", F.col("id").alias("lr"), *[F.col(c).alias(f"l_{c}") for c in own]), ["box", "cell"])
    apart = [_round(F.col(f"l_{a}") - F.col(f"h_{a}")) for a in PLACE]
    square = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]
    fits = F.coalesce(F.abs(F.col("l_mass") - F.col("h_mass")) / F.col("h_mass") < F.col("max_gap"), F.lit(True))
    met = met.where((square < F.col("r_match") * F.col("r_match")) & fits).withColumn("d", F.sqrt(square))
    parts = [F.col(f"i_{a}") * _weight(_round(F.col(f"l_{a}") - _middle(a, F.col(f"h_{a}"))), a) for a in PLACE]
    parts += [F.coalesce(F.col(f"i_{a}") * _weight(F.col(f"l_{a}") - _middle(a, F.col(f"h_{a}")), a), F.lit(0.0)) for a in OTHER]
    return met.select("hr", "lr", "d", sum(parts, F.lit(0.0)).alias("bm25")).where("bm25 > 0")


def _best(pairs: DataFrame, top: int | None) -> DataFrame:
    if top is None:
        return pairs.withColumn("cut", F.lit(False))
    order = Window.partitionBy("lr").orderBy(F.desc("bm25"), "hr")
    kept = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return kept.withColumn("cut", F.max("place").over(Window.partitionBy("lr")) == top).drop("place")


def retrieved(index: DataFrame, asking: DataFrame, top: int | None = TOP) -> DataFrame:
    """(hr, lr, d, bm25, cut): the ``top`` documents of each query by BM25, or with None all; equal scores go by the smaller id.

    Only documents within the match radius and mass distance of their run count,
    and those that share a term. ``cut`` says that the list is full, so that
    others may follow. The nearest lists are walked first; of the others only
    those whose highest possible score reaches the last of a full list.
    """
    sizes = index.groupBy("box").agg(F.max("cells").alias("cells"))
    asking = asking.join(sizes, "box")
    near = stage(_best(_scored(_asks(asking, far=False), index), top), "near")
    wide = asking.where(F.col("side") / F.col("cells") < 2 * F.col("r_match"))
    if wide.isEmpty():  # no ball reaches beyond the nearest lists
        return near
    others = _asks(wide, far=True)
    walked = _asks(wide, far=False).select("box", F.col("id").alias("walked"), "cell")
    others = others.join(walked, (others.box == walked.box) & (others.cell == walked.cell) & (others.id == walked.walked), "left_anti")
    full = near.where("cut").groupBy(F.col("lr").alias("id")).agg(F.min("bm25").alias("last"))
    bounds = others.join(lists(index), ["box", "cell"]).join(full, "id", "left")
    step = F.col("side") / _steps()
    most = sum((F.col(f"most_{a}") * _weight(F.greatest(F.lit(0.0), F.col(f"gap_{a}") - step), a) for a in PLACE), F.lit(0.0)) + F.col("most_lm") + F.col("most_ls")
    # a hair above, so that rounding never drops a list
    open_ = bounds.where(F.col("last").isNull() | (most * (1 + 1e-6) >= F.col("last"))).select(*asking.columns, "cell").dropDuplicates(["id", "box", "cell"])
    far = _scored(open_, index)
    return stage(_best(near.drop("cut").unionByName(far), top), "retrieved")


def mutual(pairs: DataFrame) -> DataFrame:
    """The pairs in which each is the other's best, with ``gap`` to the next best, or to 0, of either.

    Equal scores go to the smaller ids.
    """
    of = lambda one, other: Window.partitionBy(one).orderBy(F.desc("bm25"), other)
    seen = pairs.withColumns({"l_rank": F.row_number().over(of("lr", "hr")), "l_next": F.lead("bm25").over(of("lr", "hr"))})
    seen = seen.withColumns({"h_rank": F.row_number().over(of("hr", "lr")), "h_next": F.lead("bm25").over(of("hr", "lr"))})
    best = seen.where("l_rank = 1 AND h_rank = 1")
    return best.withColumn("gap", F.col("bm25") - F.greatest(F.coalesce("l_next", F.lit(0.0)), F.coalesce("h_next", F.lit(0.0)))).select("hr", "lr", "d", "bm25", "gap")


def _rounds(pairs: DataFrame) -> DataFrame:
    """Mutual best pairs, then those of what is left, until nothing is left."""
    left, found = pairs.drop("cut"), None
    while True:
        best = stage(mutual(left), "best")
        found = best if found is None else found.unionByName(best)
        left = stage(left.join(best.select("lr"), "lr", "left_anti").join(best.select("hr"), "hr", "left_anti"), "left")
        if left.isEmpty():
            return found


def one_to_one(index: DataFrame, asking: DataFrame, top: int = TOP) -> DataFrame:
    """(hr, lr, d, bm25, gap): the 1:1 matches.

    A query that ends without a match although its list was cut gets its whole
    list, and all is matched anew, so the result is that of uncut lists.
    """
    pairs = retrieved(index, asking, top)
    while True:
        found = _rounds(pairs)
        hungry = pairs.where("cut").select("lr").distinct().join(found.select("lr"), "lr", "left_anti")
        hungry = stage(hungry, "hungry")
        if hungry.isEmpty():
            return found
        whole = retrieved(index, asking.join(hungry.select(F.col("lr").alias("id")), "id", "left_semi"), None)
        pairs = stage(pairs.join(hungry, "lr", "left_anti").unionByName(whole), "longer")


def calibration(real: np.ndarray, decoys: np.ndarray, steps: int = 50) -> tuple[float, float, float, float]:
    """(score, gap, intercept, share): the logistic regression that tells real pairs from decoys, rows of score and gap.

    share is that of pairs by chance among the real ones, from those that score below the median of the decoys.
    """
    if not len(real) or not len(decoys):
        return 0.0, 0.0, 50.0, 0.0
    a = np.concatenate([real, decoys])
    a = np.c_[a, np.ones(len(a))]
    y = np.concatenate([np.ones(len(real)), np.zeros(len(decoys))])
    beta = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(3)
        beta = beta + np.linalg.solve(hess, a.T @ (y - p) - 1e-3 * beta)
    middle = np.median(decoys[:, 0])
    share = (real[:, 0] < middle).sum() / max(1, (decoys[:, 0] < middle).sum())
    return *map(float, beta), float(min(1.0, share))


def _figures(pairs: DataFrame, share: float) -> np.ndarray:
    """Score and gap of a share of the pairs, the same asking halos each time."""
    kept = F.pmod(F.xxhash64("lr", F.lit(13)), F.lit(1_000_000)) < math.ceil(1e6 * share)
    return np.array([(r.bm25, r.gap) for r in pairs.where(kept).select("bm25", "gap").collect()], dtype=float).reshape(-1, 2)


def match(documents: DataFrame, asking: DataFrame, least: float = 0.0, top: int = TOP, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(hr, lr, d, bm25, gap, confidence): the matches of two :func:`prepared` catalogues.

    Each halo is in at most one match. Ties in the score go to the smaller ids.
    Matches have at least confidence ``least``. Empty catalogues give an empty
    result. At most about ``calibration_rows`` halos, of whole boxes so that all
    rivals compete, and as many decoys calibrate the confidence.
    """
    asking = stage(asking, "asking")
    index = stage(indexed(stage(documents, "documents")), "index")
    found = one_to_one(index, asking, top)
    boxes = asking.groupBy("box").agg(F.count("*").alias("n"))
    total = boxes.agg(F.count("*").alias("boxes"), F.sum("n").alias("halos")).first()
    n_boxes = max(1, math.ceil(total.boxes * min(1.0, calibration_rows / max(1, total.halos or 0))))
    sampled = stage(boxes.orderBy(F.xxhash64("box", F.lit(11)), "box").limit(n_boxes), "sampled")
    chosen = asking.join(sampled.select("box"), "box", "left_semi")
    share = min(1.0, calibration_rows / max(1, sampled.agg(F.sum("n").alias("n")).first().n or 0))
    moved = chosen.withColumns({a: F.pmod(F.col(a) + F.col("side") * f, "side") for a, f in (("x", 0.5), ("y", 0.43), ("z", 0.57))})
    decoys = _figures(mutual(retrieved(index, stage(moved, "moved"), top).drop("cut")), share)
    real = _figures(found.join(chosen.select(F.col("id").alias("lr")), "lr", "left_semi"), share)
    score, gap, shift, chance = calibration(real, decoys)
    # p = t / (t + d) for t real pairs and d decoys of that score and gap; pairs by chance are ``chance`` times the decoys
    p = 1 / (1 + F.exp(-(F.col("bm25") * score + F.col("gap") * gap + shift)))
    confidence = F.greatest(F.lit(0.0), 1 - chance * (1 - p) / p)
    return found.withColumn("confidence", confidence.cast(T.DoubleType())).where(F.col("confidence") >= least)
