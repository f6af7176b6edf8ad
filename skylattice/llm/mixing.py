"""Mixing sources to target shares of all tokens, with a limit on repetition, by temperature.

The share that a source has of all tokens is raised to an exponent, its
temperature. One exponent for all sources, bisected to the entropy of the
targets, flattens the mixture as much as the targets do, but gives no source its
own target. So every source has an exponent of its own, bisected until its share
so raised is its target. Where a wanted total goes beyond what the repetition
limits allow, all exponents move towards 1, and the limits come in to the same
degree, by a bisected part, until the total can be had. The normalised weights
are realised as token budgets: whole passes over a source, and for the rest
blocks of its documents in a random order, the last block document by document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylattice.runtime import stage


@dataclass
class Source:
    """What is known of a source: its target share, the uses of a document, its documents and tokens."""

    name: str
    target: float
    repeats: int
    documents: int = 0
    tokens: int = 0


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total if total else 0.0 for k, v in weights.items()}


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to an exponent and normalised; a share of 0 stays 0."""
    return normalised({k: v**exponent if v > 0 else 0.0 for k, v in shares.items()})


def entropy(shares: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in shares.values() if v > 0)


def _bisected(low: float, high: float, rising, steps: int = 60) -> float:
    """Where ``rising`` turns from false to true between low and high."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if rising(mid) else (mid, high)
    return high


def entropy_exponent(shares: dict[str, float], wanted: float) -> float:
    """The exponent from 0 to 8 at which the tempered shares have the wanted entropy, or the nearest they can have."""
    return _bisected(0.0, 8.0, lambda e: entropy(tempered(shares, e)) <= wanted)


def target_exponent(share: float, target: float) -> float:
    """The exponent that turns a share into its target; 1 where the share is the whole."""
    if share >= 1:
        return 1.0
    high = 1.0
    while share**high > target:
        high *= 2
    return _bisected(0.0, high, lambda e: share**e <= target)


def budgets(sources: list[Source], tokens: int | None = None, aim: str = "targets") -> dict[str, float]:
    """The tokens to take from each source.

    With the aim "targets" every source gets its target share, with "entropy" the
    shares of all tokens are tempered by one exponent to the entropy of the
    targets. Without a wanted total it is the most that keeps these shares within
    the repetition limits; with one, the shares leave the aim by the least part
    that makes the total possible, up to all that the sources can give. Sources
    without tokens, target or repetition get nothing, and the other targets are
    scaled to fill their place.
    """
    usable = [s for s in sources if s.tokens > 0 and s.target > 0 and s.repeats > 0]
    if not usable:
        return {s.name: 0.0 for s in sources}
    most, repeats = {s.name: float(s.tokens * s.repeats) for s in usable}, {s.name: s.repeats for s in usable}
    target, own = normalised({s.name: s.target for s in usable}), normalised({s.name: float(s.tokens) for s in usable})
    if aim == "targets":
        exponent = {k: target_exponent(own[k], target[k]) for k in own}
    elif aim == "entropy":
        exponent = dict.fromkeys(own, entropy_exponent(own, entropy(target)))
    else:
        raise ValueError(f"the aim must be targets or entropy, not {aim}")
    # part 0 is the aim, at part 1 the weights are in proportion to what the sources can give at most
    weights = lambda part: normalised({k: own[k] ** (exponent[k] * (1 - part) + part) * repeats[k] ** part for k in own})
    limit = lambda w: min(most[k] / w[k] for k in w if w[k] > 0)
    total = limit(weights(0.0)) if tokens is None else min(float(tokens), sum(most.values()))
    part = 0.0 if limit(weights(0.0)) >= total else _bisected(0.0, 1.0, lambda p: limit(weights(p)) >= total)
    shares = weights(part)
    return {s.name: min(total * shares.get(s.name, 0.0), most.get(s.name, 0.0)) for s in sources}


def source_name(column: str):
    """A source as its documents should spell it: without outer white space, in lower case; null is the empty name."""
    return F.coalesce(F.lower(F.trim(F.col(column))), F.lit(""))


def known_sources(sized: DataFrame, targets: DataFrame) -> list[Source]:
    """The sources with a target, few by nature, with the documents and tokens that they have."""
    wanted = targets.groupBy(source_name("source").alias("source")).agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("r"))
    have = sized.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("d"), F.sum("n_tokens").alias("n"))
    return [Source(r.source, float(r.t or 0.0), int(r.r or 0), int(r.d or 0), int(r.n or 0)) for r in wanted.join(have, "source", "left").orderBy("source").collect()]


def _by_source(values: dict[str, float]):
    return F.element_at(F.create_map(*[x for name, v in values.items() for x in (F.lit(name), F.lit(v))]), F.col("source"))


def _one_more_pass(rows: DataFrame, id_: str, room: dict[str, float], blocks: dict[str, int], seed: int) -> DataFrame:
    """Mark the rows to ``take``: blocks of each source in random order while they fit into its room, the last row by row."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64(id_, F.lit(seed)), _by_source({k: float(v) for k, v in blocks.items()}).cast("long")))
    # a source has about as many blocks as a block has documents, so neither window below is large
    sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    along = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("left", _by_source(room) - F.coalesce(F.sum("block_tokens").over(along), F.lit(0)))
    whole = F.col("left") >= F.col("block_tokens")
    placed = rows.join(sums, ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64(id_, F.lit(seed + 2)), id_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (F.col("left") > 0) & ~whole
    part = placed.where(cut).withColumn("take", F.sum("n_tokens").over(inside) <= F.col("left"))
    return part.unionByName(placed.where(~cut).withColumn("take", whole)).drop("block", "block_tokens", "left")


def mixture(sized: DataFrame, id_: str, sources: list[Source], tokens: int | None = None, seed: int = 0, aim: str = "targets") -> DataFrame:
    """(id, source, n_tokens, n_uses): the documents of the mixture and how often each is used.

    sized: ``id``, source (as :func:`source_name` gives it), n_tokens. Documents
    without tokens are not used; rows that repeat an id are documents of their
    own. No source exceeds its budget (:func:`budgets`). Where a long document
    ends a pass early, the documents that still fit get another one, until none fits.
    """
    wanted = budgets(sources, tokens, aim)
    known = {s.name: s for s in sources if wanted[s.name] > 0}
    if not known:
        return sized.select(id_, "source", "n_tokens", F.lit(0).alias("n_uses")).where("false")
    whole = {k: float(wanted[k] // s.tokens) for k, s in known.items()}
    room = {k: wanted[k] - whole[k] * s.tokens for k, s in known.items()}
    blocks = {k: max(1, math.isqrt(s.documents)) for k, s in known.items()}
    left = sized.where((F.col("n_tokens") > 0) & F.col("source").isin(*known)).select(id_, "source", F.col("n_tokens").cast("long").alias("n_tokens"))
    decided, k = [], 0
    while True:
        # every pass takes at least one document of each source that has one that fits
        fits = F.col("n_tokens") <= _by_source(room)
        decided.append(left.where(~fits).withColumn("take", F.lit(False)))
        chosen = stage(_one_more_pass(left.where(fits), id_, room, blocks, seed + 10 * k), "mixed")
        used = {r.source: r.n for r in chosen.where("take").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        if not used:
            decided.append(chosen)
            break
        decided.append(chosen.where("take"))
        room = {s: v - used.get(s, 0) for s, v in room.items()}
        left, k = chosen.where("NOT take").drop("take"), k + 1
    rows = decided[0]
    for d in decided[1:]:
        rows = rows.unionByName(d)
    uses = _by_source(whole).cast("int") + F.col("take").cast("int")
    return rows.select(id_, "source", "n_tokens", uses.alias("n_uses")).where("n_uses > 0")


def reached(mixed: DataFrame, sources: list[Source]) -> DataFrame:
    """(source, target_share, exponent, tempered_share, reached_share, n_tokens, n_documents, most_uses) of every source with a target.

    exponent is that of the source at its target; tempered_share is what one
    exponent for all would give, at which the sources' own token shares have the
    entropy of the targets.
    """
    spark = mixed.sparkSession
    own = normalised({s.name: float(s.tokens) for s in sources})
    aims = normalised({s.name: s.target for s in sources if s.tokens > 0})
    plain = tempered(own, entropy_exponent(own, entropy(aims)))
    power = {k: target_exponent(own[k], aims[k]) for k in aims if aims[k] > 0}
    known = spark.createDataFrame([(s.name, s.target, power.get(s.name), plain[s.name]) for s in sources], "source string, target_share double, exponent double, tempered_share double")
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("n_uses").alias("most_uses"))
    rows = known.join(got, "source", "left").na.fill(0, ["n_tokens", "n_documents", "most_uses"])
    return rows.withColumn("reached_share", F.coalesce(F.try_divide("n_tokens", F.sum("n_tokens").over(Window.partitionBy())), F.lit(0.0)))
