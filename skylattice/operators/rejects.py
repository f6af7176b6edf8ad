"""Raw text lines to valid rows and rejected rows with their reasons.

Every field stays nullable text until the rules have run: each rule is one
Spark expression that yields its name where it is broken, the names form an
error array, and the rows are split by whether that array is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTED_FIELD = r'"[^"]*+(?:""[^"]*+)*+"'
INTEGER = r"\A[+-]?[0-9]+\z"
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
BLANKS = r"\A[ \t]*\z"
MAX_LONG = 2**63 - 1


def is_noise(line: Column, comment: str = "#") -> Column:
    """Null and blank lines and comments, which are neither valid nor failing."""
    return line.isNull() | line.rlike(BLANKS) | line.startswith(comment)


def bare_csv(line: Column) -> Column:
    """The line with each well-formed quoted field replaced by one letter; a quote left over breaks the quoting."""
    return F.regexp_replace(line, rf"(?<![^,]){QUOTED_FIELD}(?![^,])", "q")


def csv_fields(line: Column) -> Column:
    """The fields of a csv line, with quotes taken off and inner quotes undoubled."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({QUOTED_FIELD}|[^,]*+)"), F.lit(1))
    unquoted = lambda f: F.when(f.startswith('"'), F.regexp_replace(f.substr(F.lit(2), F.length(f) - 2), '""', '"')).otherwise(f)
    return F.when(F.instr(line, '"') == 0, F.split(line, ",", -1)).otherwise(F.transform(raw, unquoted))


def list_fields(line: Column) -> Column:
    """The fields of a line parted by blanks or tabs; leading and trailing ones are ignored."""
    return F.split(F.regexp_replace(line, r"\A[ \t]+|[ \t]+\z", ""), r"[ \t]+", -1)


def integer(text: Column) -> Column:
    """The bigint that ASCII digits with an optional sign name, else null."""
    return F.when(text.rlike(INTEGER), text.try_cast("long"))


def number(text: Column) -> Column:
    """The double that a plain decimal number names, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def broken(name: str, holds: Column) -> Column:
    """The rule's name where it does not hold; unknown counts as broken."""
    return F.when(~F.coalesce(holds, F.lit(False)), F.lit(name))


def with_errors(df: DataFrame, rules: dict[str, Column], into: str = "errors") -> DataFrame:
    """Add the array of the names of the rules that each row breaks, in the order of the rules."""
    return df.withColumn(into, F.array_compact(F.array(*[broken(n, ok) for n, ok in rules.items()])))


def split_by_errors(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(valid rows without the error column, failing rows with ``reason``, the first broken rule)."""
    return df.where(F.size(errors) == 0).drop(errors), df.where(F.size(errors) > 0).withColumn("reason", F.element_at(errors, 1))


CSV_POSITIONS = (0, 1, 2, 3, 4, 5)
LIST_POSITIONS = (1, 5, 17, 18, 19, 39)
TEXTS = ("halo_id_text", "pid_text", "halo_x_text", "halo_y_text", "halo_z_text", "m200b_text")


def halo_lines(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """Halo lines with their parsed fields and the array ``errors``.

    ``lines`` has line_id, run_id, file_kind and raw_line, ``runs`` run_id and
    boxsize_mpc_h. Noise (null, blank and comment lines) is left out. A line of
    an unknown or null file_kind is read as a list, a line of an unknown run has
    a broken value, as no box holds its coordinates. Repeated lines stay. Lines
    of any length are read whole.
    """
    line, csv = F.col("raw_line"), F.coalesce(F.col("file_kind") == "csv", F.lit(False))
    rows = lines.select("line_id", "run_id", "file_kind", "raw_line").where(~is_noise(line)).withColumn("bare", F.when(csv, bare_csv(line)))
    rows = rows.withColumn("quotes_ok", F.coalesce(F.instr("bare", '"') == 0, F.lit(True)))
    rows = rows.withColumn("fields", F.when(~F.col("quotes_ok"), F.array().cast("array<string>")).when(csv, csv_fields(line)).otherwise(list_fields(line)))
    rows = rows.withColumns({t: F.when(csv, F.get("fields", F.lit(c))).otherwise(F.get("fields", F.lit(p))) for t, c, p in zip(TEXTS, CSV_POSITIONS, LIST_POSITIONS, strict=True)})
    rows = rows.withColumn("n_fields", F.size("fields")).drop("bare", "fields")
    sides = runs.groupBy("run_id").agg(F.max("boxsize_mpc_h").alias("boxsize_mpc_h"))
    rows = rows.join(sides, "run_id", "left")
    rows = rows.withColumns({"halo_id": integer(F.col("halo_id_text")), "pid": integer(F.col("pid_text"))} | {c: number(F.col(f"{c}_text")) for c in ("halo_x", "halo_y", "halo_z", "m200b")})
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < F.col("boxsize_mpc_h"))
    rules = {
        "quoting": F.col("quotes_ok"),
        "column_count": F.col("n_fields") == F.when(csv, 8).otherwise(40),
        "value": (F.col("halo_id") >= 1) & (F.col("pid") >= -1) & inside("halo_x") & inside("halo_y") & inside("halo_z") & (F.col("m200b") > 0) & (F.col("m200b") < float("inf")),
    }
    return with_errors(rows, rules).select("line_id", "run_id", "halo_id", "pid", "halo_x", "halo_y", "halo_z", "m200b", "raw_line", "errors")


def load_halo_lines(lines: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid halos, failing lines with raw_line and reason) of :func:`halo_lines`."""
    good, bad = split_by_errors(halo_lines(lines, runs))
    return good.drop("raw_line"), bad.select("line_id", "run_id", "raw_line", "errors", "reason")
