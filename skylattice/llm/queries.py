"""Queries of the numbered training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import linkage, mixing, packing, quantiles, textquality, tokens
from skylattice.runtime import stage, table

FIELDS = ["tidal_anisotropy", "overdensity", "descriptor_m200b"]
MISSING = (-999.0,)
TOLERANCE = 0.05


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (descriptor_halo_id, batch_day) once; its copies differ in loaded_at only."""
    rows = table(spark, sf_dir, "descriptors")
    return rows.groupBy("descriptor_halo_id", "batch_day").agg(*[F.first(c).alias(c) for c in ("run_id", *FIELDS)])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = stage(_descriptors(spark, sf_dir), "descriptors")
    daily = stage(quantiles.sketches(once, ["run_id", "batch_day"], FIELDS, MISSING), "sketches")
    # the days of all runs together; run 0 is none of the runs
    overall = quantiles.merged(daily, ["batch_day", "field_name"]).withColumn("run_id", F.lit(0))
    held = daily.unionByName(overall)
    summaries = table(spark, sf_dir, "descriptor_summaries").select("summary_id", "run_id", "day_from", "day_to", "field_name", "pct", F.col("pct_value").alias("point"))
    days = F.explode(F.sequence("day_from", "day_to")).alias("batch_day")
    spanned = summaries.where("day_from <= day_to").select("summary_id", F.coalesce("run_id", F.lit(0)).alias("run_id"), days, "field_name", "point")
    keys = ["run_id", "batch_day", "field_name"]
    # about a million questions, or values, to a block
    many = lambda df: 1 + df.count() // 1_000_000
    roughly = quantiles.sketched_counts(spanned, held, keys, "summary_id", blocks=many(summaries))
    share, below, upto = F.col("pct") / 100, F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    # how far beyond the tolerance a summary lies; positive is wrong
    excess = F.greatest(below - share, share - upto) - TOLERANCE
    judged = stage(summaries.join(roughly, "summary_id").select("summary_id", "run_id", "day_from", "day_to", "field_name", "pct", "point", excess.alias("excess")), "judged")
    clear = judged.where(F.col("excess") > quantiles.SHARE_ERROR).select("summary_id")
    # within the stated error of the limit the sketch can't tell: these few are counted
    close = judged.where(F.abs("excess") <= quantiles.SHARE_ERROR)
    runs = table(spark, sf_dir, "sim_runs").select(F.col("run_id").alias("any_run")).distinct()
    asked = close.join(runs, F.col("run_id").isNull() | (F.col("run_id") == F.col("any_run"))).select("summary_id", F.col("any_run").alias("run_id"), days, "field_name", "point")
    exactly = quantiles.exact_counts(asked, quantiles.long_values(once, ["run_id", "batch_day"], FIELDS, MISSING), keys, "summary_id", blocks=many(once))
    counted = close.join(exactly, "summary_id").where(excess > 0).select("summary_id")
    return clear.unionByName(counted)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each percentile from the sketch that protects the nearer tail; days are merged to runs, then runs to all."""
    once, found = stage(_descriptors(spark, sf_dir), "descriptors"), []
    for tail, pcts in (("low", [0.1, 1.0, 5.0, 25.0]), ("high", [50.0, 75.0, 95.0, 99.0, 99.9])):
        daily = quantiles.sketches(once, ["run_id", "batch_day"], FIELDS, MISSING, protect=tail)
        runs = stage(quantiles.merged(daily, ["run_id", "field_name"], protect=tail), "runs")
        overall = quantiles.merged(runs, ["field_name"], protect=tail).withColumn("run_id", F.lit(None).cast("int"))
        found.append(quantiles.percentiles(runs.unionByName(overall), ["run_id", "field_name"], pcts, protect=tail))
    return found[0].unionByName(found[1])


def _matches(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    runs = table(spark, sf_dir, "sim_runs")
    high, low = linkage.prepared(table(spark, sf_dir, "hr_halos"), "halo_id", runs), linkage.prepared(table(spark, sf_dir, "lr_halos"), "lr_halo_id", runs)
    return linkage.match(high, low, least)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches that are likelier true than not."""
    return _matches(spark, sf_dir, 0.5).select(F.col("hr").alias("hr_halo_id"), F.col("lr").alias("lr_halo_id"))


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches, doubtful ones with their low confidence."""
    return _matches(spark, sf_dir, 0.0).select(F.col("hr").alias("hr_halo_id"), F.col("lr").alias("lr_halo_id"), *[F.round(c, 6).alias(c) for c in ("d", "bm25", "gap", "confidence")])


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {r.pack_id: r.capacity_tokens for r in table(spark, sf_dir, "pack_sizes").collect()}  # four rows at every scale
    return packing.layout(stage(tokens.sized(table(spark, sf_dir, "documents"), "doc_id", "text"), "sized"), "doc_id", "n_tokens", sizes)


def p7_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("pack_id", "container_id", F.col("item_id").alias("doc_id"), "start_token", "n_tokens")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir))


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[mixing.Source]]:
    documents = table(spark, sf_dir, "documents").withColumn("source", mixing.source_name("source"))
    sized = stage(tokens.sized(documents, "doc_id", "text", keep=("source",)), "sized")
    return sized, mixing.known_sources(sized, table(spark, sf_dir, "source_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture in which every source has its target share."""
    sized, sources = _sources(spark, sf_dir)
    return mixing.mixture(sized, "doc_id", sources)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, sources = _sources(spark, sf_dir)
    return mixing.reached(mixing.mixture(sized, "doc_id", sources), sources)


def p8_budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached where the total is as many tokens as the sources have, which the limits allow only off the targets."""
    sized, sources = _sources(spark, sf_dir)
    return mixing.reached(mixing.mixture(sized, "doc_id", sources, tokens=sum(s.tokens for s in sources)), sources)


def p8_entropy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by one exponent for all sources, at the entropy of the targets."""
    sized, sources = _sources(spark, sf_dir)
    return mixing.reached(mixing.mixture(sized, "doc_id", sources, aim="entropy"), sources)


def _common_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """The listed words; the table has the same 137 rows at every scale."""
    return sorted({r.word.lower() for r in table(spark, sf_dir, "common_words").where("word IS NOT NULL").collect()})


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = textquality.label_shares(table(spark, sf_dir, "documents"), "doc_id", "text", _common_words(spark, sf_dir))
    return shares.where(textquality.not_prose(shares)).select("doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = textquality.label_shares(table(spark, sf_dir, "documents"), "doc_id", "text", _common_words(spark, sf_dir))
    return shares.select("doc_id", "n_lines", *[F.round(f"{s}_share", 6).alias(f"{s}_share") for s in textquality.LABELS])


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textquality.statistics(table(spark, sf_dir, "documents"), "doc_id", "text", _common_words(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_percentiles, p5_found, p5_confidence, p7_layout, p7_fill, p8_mixture, p8_shares, p8_budget_shares, p8_entropy_shares, p9_found, p9_shares, p9_statistics)}

ORACLE = {
    "p1_found": """
WITH d AS (
  SELECT descriptor_halo_id, batch_day, any_value(run_id) AS run_id, any_value(tidal_anisotropy) AS tidal_anisotropy, any_value(overdensity) AS overdensity, any_value(descriptor_m200b) AS descriptor_m200b
  FROM descriptors GROUP BY ALL
), v AS (
  SELECT run_id, batch_day, 'tidal_anisotropy' AS field_name, tidal_anisotropy AS value FROM d
  UNION ALL SELECT run_id, batch_day, 'overdensity', overdensity FROM d
  UNION ALL SELECT run_id, batch_day, 'descriptor_m200b', descriptor_m200b FROM d
), s AS (
  SELECT summary_id, pct, count(*) AS n, count(*) FILTER (value < pct_value) AS below, count(*) FILTER (value <= pct_value) AS upto
  FROM descriptor_summaries s JOIN v ON v.field_name = s.field_name AND (s.run_id IS NULL OR s.run_id = v.run_id) AND v.batch_day BETWEEN s.day_from AND s.day_to
  WHERE isfinite(value) AND value <> -999 GROUP BY ALL
) SELECT summary_id FROM s WHERE pct / 100.0 < below / n - 0.05 OR pct / 100.0 > upto / n + 0.05""",
    "p9_statistics": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '\p{L}+') AS w, list_filter(regexp_split_to_array(t, '\r\n|\n|\r'), lambda x: regexp_matches(x, '\S')) AS l FROM t),
c AS (SELECT list(DISTINCT lower(word)) AS c FROM common_words)
SELECT doc_id, length(t) AS n_chars, len(w) AS n_words,
  round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) END, 6) AS mean_word_length,
  round(CASE WHEN t <> '' THEN length(regexp_replace(t, '[\p{L}\p{N}\s]', '', 'g')) / length(t) END, 6) AS symbol_ratio,
  round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '[.!?…][ \t]*$'))) / len(l) END, 6) AS end_punct_share,
  round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(c, x))) / len(w) END, 6) AS common_share
FROM w, c""",
}
