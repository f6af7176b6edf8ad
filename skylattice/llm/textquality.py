"""Statistics of the text of documents, and a hidden Markov model that tells prose from other lines.

A text is cut into lines, all by one rule, and each line gives a few categorical
statistics, counted by built-in functions. The hidden states emit them
independently. The tables of the model are learned from all documents by
expectation and maximisation: every round sums the expected counts in Spark.
The start knows two figures only, the share of common words and whether the
block has sentence ends, one state for each level of both. The states are then
named prose, list, table or junk by the figures that they have come to emit, and
the expected characters in each describe the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.runtime import stage

LABELS = ("prose", "list", "table", "junk")
#: a document is prose when more than this share of its characters is
PROSE_SHARE = 0.2
#: rounds of expectation and maximisation, and the count added to every entry of a table
ROUNDS, ADDED = 8, 10.0
#: a line counts in the tables by its words, up to so many
MOST_WORDS = 14
#: words of a text of one line that is a short answer, no case for the model
SHORT_WORDS = 7
#: lines of a text that make one chain; longer texts are several, and a task holds so many lines at a time
CHAIN, HELD = 1000, 200_000

# a line ends at a line break, after 60 characters at a pause, or after 120 at a blank
_LINE = r"[^\r\n]{60,120}?[.!?;:,](?=\s)|[^\r\n]{120}\S*|[^\r\n]+"
_BLOCK = r"(?:\r\n|\n|\r)[ \t]*(?=\r\n|\n|\r)"
_URL = r"(?:https?|ftp)://\S+|www\.\S+"
# letters of all scripts as a few ranges, of a text in lower case
_WORD = r"[a-z\u00df-\u1fff\u2c00-\ud7ff]{2,}"
_UNSPEAKABLE = r"\b[bcdfghjklmnpqrstvwxzßçñ]{2,}\b"
_ALONE = r"(?:\A|\s)\S(?=\s|\z)"
_PAUSE = r"[.,;:!?…](?=\s|$|[\"')»”])"
_SENTENCE_END = r"[.!?…](?=\s|$|[\"')»”])(?<=\p{L}[\"')»”]?.)"
_SEPARATOR = r"[|\t;=,/]|\s{3,}"
_MARKER = r"\A\s*(?:[-*+•–—·>»→o]\s+|\[[ xX]?\]\s*|#?\d{1,4}[.):]?\s|\(\w{1,3}\)\s|[a-zA-Z][.)]\s|#\w)"
_OPENS = r"\A\s*[\"'¿¡«„“(*_]*\p{Lu}"
_CLOSES = r"\p{L}[\"'»”)]*[.!?…][\"'»”)*_]*\s*\z"

#: the statistics of a line and the number of their levels, in the order in which a code holds them
LEVELS = {"common and words": 25, "other tokens": 5, "marker and separators": 6, "pauses": 5, "unspeakable": 3, "repeated": 3, "single letters": 3, "opens and closes": 4, "sentence ends": 3}
# the middles of the five levels of the share of common words, by which states are named
_COMMON = np.array([0.0, 0.06, 0.17, 0.28, 0.45])
_OTHER = np.array([0.0, 0.07, 0.25, 0.5, 0.85])
_STATES = 10


def _level(value: Column, *bounds: float) -> Column:
    """How many of the rising bounds the value reaches."""
    return sum(((value >= b).cast("int") for b in bounds), F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _code(s: Column) -> Column:
    """The levels of all statistics of a line in one number."""
    n = F.greatest(s["tokens"] - s["letters"], F.lit(0))
    words, some = s["words"], s["words"] > 0
    many = F.when(words > 3, 1 - s["distinct"] / words).otherwise(0.0)
    levels = [
        5 * _level(_ratio(s["common"], words), 0.001, 0.12, 0.22, 0.35) + _level(words, 1, 4, 7, 12),
        _level(F.when(n > 0, F.greatest(F.lit(0.0), 1 - words / n)).otherwise(1.0), 0.001, 0.15, 0.35, 0.65),
        3 * s["marker"].cast("int") + _level(_ratio(s["separators"], n), 0.1, 0.34),
        _level(_ratio(s["pauses"], words), 0.001, 0.1, 0.25, 0.5),
        F.when(some, _level(_ratio(s["odd"], words), 0.05, 0.3)).otherwise(0),
        _level(many, 0.15, 0.45),
        _level(_ratio(s["letters"], s["tokens"]), 0.3, 0.6),
        2 * s["opens"].cast("int") + s["closes"].cast("int"),
        _level(s["ends"] / s["lines"], 0.001, 0.3),
    ]
    code = F.lit(0)
    for level, size in zip(levels, LEVELS.values(), strict=True):
        code = code * size + level
    return code.cast("int")


def _answers(s: Column) -> Column:
    """True of a line of one to seven different words and at most one other token, links apart, with a common word or an end: too few for statistics."""
    whole = (s["words"] > 0) & (s["words"] <= SHORT_WORDS) & (s["words"] + s["letters"] >= s["tokens"] - 1)
    return whole & (s["odd"] == 0) & (s["distinct"] == s["words"]) & ((s["common"] > 0) | s["closes"])


def analysed_lines(documents: DataFrame, id_: str, text: str, common: list[str]) -> DataFrame:
    """(id, codes, characters, weights, short_answer): the coded statistics, length and weight of every line that is not blank.

    Each text is read once, whole, in built-in functions; texts without such a line have empty arrays.
    """
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    lines = lambda b: F.filter(F.regexp_extract_all(b, F.lit(_LINE), F.lit(0)), lambda x: x.rlike(r"\S"))
    blocks = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), _BLOCK, -1), lambda b: F.struct(lines(b).alias("lines"), count(b, _SENTENCE_END).alias("ends")))
    bare = F.transform(blocks, lambda b: F.transform(b["lines"], lambda x: F.struct(x.alias("line"), F.regexp_replace(x, _URL, " ").alias("bare"), F.size(b["lines"]).alias("lines"), b["ends"].alias("ends"))))
    # each step names its figures in a struct, so that the next can use them twice without finding them twice
    lower = F.transform(F.flatten(bare), lambda s: F.struct(s["line"].alias("line"), s["bare"].alias("bare"), s["lines"].alias("lines"), s["ends"].alias("ends"), F.lower(s["bare"]).alias("lower")))
    words = F.transform(lower, lambda s: F.struct(*[s[c].alias(c) for c in ("line", "bare", "lines", "ends", "lower")], F.regexp_extract_all(s["lower"], F.lit(_WORD), F.lit(0)).alias("found")))
    figures = F.transform(words, lambda s: F.struct(
        s["lines"].alias("lines"), s["ends"].alias("ends"), F.length(s["line"]).alias("characters"), F.size(s["found"]).alias("words"), F.size(F.array_distinct(s["found"])).alias("distinct"),
        F.size(F.filter(s["found"], lambda w: w.isin(common) if common else F.lit(False))).alias("common"), count(s["lower"], _UNSPEAKABLE).alias("odd"),
        count(s["bare"], r"\S+").alias("tokens"), count(s["bare"], _ALONE).alias("letters"), count(s["bare"], _SEPARATOR).alias("separators"), count(s["bare"], _PAUSE).alias("pauses"),
        F.substring(F.ltrim(s["bare"]), 1, 12).rlike(_MARKER).alias("marker"), F.substring(F.ltrim(s["line"]), 1, 12).rlike(_OPENS).alias("opens"), F.substring(F.rtrim(s["line"]), -8, 8).rlike(_CLOSES).alias("closes"),
    ))
    coded = F.transform(figures, lambda s: F.struct(_code(s).alias("code"), s["characters"].alias("characters"), F.greatest(F.lit(1), F.least(F.lit(MOST_WORDS), s["tokens"])).alias("weight"), _answers(s).alias("answers")))
    rows = stage(documents.select(id_, coded.alias("coded")), "lines")
    alone = (F.size("coded") == 1) & F.coalesce(F.get("coded.answers", F.lit(0)), F.lit(False))
    return rows.select(id_, F.col("coded.code").alias("codes"), F.col("coded.characters").alias("characters"), F.col("coded.weight").alias("weights"), alone.alias("short_answer"))


def decoded(codes: np.ndarray) -> np.ndarray:
    """The levels (columns) of coded lines (rows)."""
    columns = []
    for size in reversed(list(LEVELS.values())):
        columns.append(codes % size)
        codes = codes // size
    return np.stack(columns[::-1], axis=1)


def start_state(codes: np.ndarray) -> np.ndarray:
    """The state of a line by the two figures of the start."""
    levels = decoded(codes)
    return levels[:, 0] // 5 * 2 + (levels[:, 8] >= 1)


class LineModel:
    """The tables of the model: first[s], moved[from, to] and emitted[k][s, level], as probabilities."""

    def __init__(self, counts: dict[tuple[int, int, int], float] | None = None):
        n = counts or {}
        norm = lambda a: a / a.sum(axis=-1, keepdims=True)
        states = range(_STATES)
        # chains begin in any state, and stay in theirs, until counts are known
        self.first = norm(np.array([n.get((-1, s, 0), 0.0) + 1 for s in states]))
        self.moved = norm(np.array([[n.get((-2, s, b), 0.0) + 1 + 20 * (s == b) * (not any(k[0] == -2 for k in n)) for b in states] for s in states]))
        self.emitted = [norm(np.array([[n.get((k, s, v), 0.0) + ADDED for v in range(size)] for s in states])) for k, size in enumerate(LEVELS.values())]

    def likelihood(self, codes: np.ndarray) -> np.ndarray:
        """How likely each state emits each line, up to a factor for each line."""
        kinds, which = np.unique(codes, return_inverse=True)
        levels = decoded(kinds)
        log = sum(np.log(table[:, levels[:, k]]).T for k, table in enumerate(self.emitted))
        return np.exp(log - log.max(axis=1, keepdims=True))[which]

    def expected(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(states of each line, first states, moves) expected of chains of the given sizes, by forward and backward sums."""
        e = self.likelihood(codes)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.argsort(-sizes, kind="stable")
        begin, longest = begin[order], int(sizes.max())
        # at step t the chains longer than t stand in front
        going = np.searchsorted(-sizes[order], -np.arange(longest), "left")
        unit = lambda a: a / a.sum(axis=1, keepdims=True)
        ahead, behind, moves = np.empty_like(e), np.ones_like(e), np.zeros((_STATES, _STATES))
        ahead[begin] = unit(self.first * e[begin])
        for t in range(1, longest):
            at = begin[: going[t]] + t
            ahead[at] = unit(ahead[at - 1] @ self.moved * e[at])
        for t in range(longest - 1, 0, -1):
            at = begin[: going[t]] + t
            coming = e[at] * behind[at]
            before = coming @ self.moved.T
            weight = (ahead[at - 1] * before).sum(axis=1, keepdims=True)
            moves += self.moved * ((ahead[at - 1] / weight).T @ coming)
            behind[at - 1] = unit(before)
        states = unit(ahead * behind)
        return states, states[begin].sum(axis=0), moves

    def labels(self) -> list[str]:
        """A name for each state, by the shares of common words and of other tokens that it emits, and of odd or repeated words."""
        common = self.emitted[0].reshape(_STATES, 5, 5).sum(axis=2) @ _COMMON
        other = self.emitted[1] @ _OTHER
        odd = self.emitted[4][:, 1:].sum(axis=1) + self.emitted[5][:, 2] + self.emitted[6][:, 1:].sum(axis=1)
        return ["prose" if c >= 0.15 else "junk" if o >= 0.25 else "table" if x >= 0.35 else "list" for c, x, o in zip(common, other, odd, strict=True)]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with about ``HELD`` lines at a time: (rows, the row of each chain, its size, the codes); texts longer than ``CHAIN`` are several chains."""
    for batch in batches:
        lengths = np.asarray(batch.column("codes").value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        upto, k = np.cumsum(lengths), 0
        while k < len(lengths):
            end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + HELD, "right")))
            rows = batch.slice(k, end - k)
            parts = -(-lengths[k:end] // CHAIN)
            row = np.repeat(np.arange(end - k), parts)
            last = np.cumsum(parts)[parts > 0] - 1
            sizes = np.full(len(row), CHAIN, dtype=np.int64)
            sizes[last] = (lengths[k:end] - (parts - 1) * CHAIN)[parts > 0]
            yield rows, row, sizes, rows.column("codes").flatten().to_numpy(zero_copy_only=False)
            k = end


def _round(lines: DataFrame, model: LineModel | None) -> LineModel:
    """One maximisation: the counts expected under the model, or by the start, summed over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((_STATES, size)) for size in LEVELS.values()]
        first, moves = np.zeros(_STATES), np.zeros((_STATES, _STATES))
        for rows, _, sizes, codes in _chains(batches):
            if not len(codes):
                continue
            if model is None:
                states = np.full((len(codes), _STATES), 0.1 / (_STATES - 1))
                states[np.arange(len(codes)), start_state(codes)] = 0.9
            else:
                states, begun, moved = model.expected(codes, sizes)
                first, moves = first + begun, moves + moved
            weighted = states * rows.column("weights").flatten().to_numpy(zero_copy_only=False)[:, None]
            levels = decoded(codes)
            for k, table in enumerate(tables):
                for s in range(_STATES):
                    table[s] += np.bincount(levels[:, k], weights=weighted[:, s], minlength=table.shape[1])
        found = [(k, s, v, table[s, v]) for k, table in enumerate(tables) for s in range(_STATES) for v in range(table.shape[1])]
        if model is not None:
            found += [(-1, s, 0, first[s]) for s in range(_STATES)] + [(-2, s, b, moves[s, b]) for s in range(_STATES) for b in range(_STATES)]
        columns = list(zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.float64())], names=["part", "state", "level", "n"])

    counts = lines.select("codes", "weights").mapInArrow(count, "part int, state int, level int, n double").groupBy("part", "state", "level").agg(F.sum("n").alias("n"))
    # as many rows as the tables have entries, at every size
    return LineModel({(r.part, r.state, r.level): r.n for r in counts.collect()})


def learned(lines: DataFrame, rounds: int = ROUNDS) -> LineModel:
    """The model of :func:`analysed_lines`, after so many rounds from the start by two figures."""
    model = _round(lines, None)
    for _ in range(rounds):
        model = _round(lines, model)
    return model


def label_shares(documents: DataFrame, id_: str, text: str, common: list[str], rounds: int = ROUNDS) -> DataFrame:
    """(id, n_lines, short_answer, prose_share, list_share, table_share, junk_share): expected shares of the characters in lines.

    Texts without a line that is not blank, null ones too, have 0 lines and null
    shares. Every row gives a row; texts are read whole, long lines included.
    """
    lines = analysed_lines(documents, id_, text, common)
    model = learned(lines, rounds)
    names, kind = model.labels(), documents.schema[id_].dataType.simpleString()
    by_label = np.array([[float(name == label) for label in LABELS] for name in names])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, row, sizes, codes in _chains(batches):
            n = np.asarray(rows.column("codes").value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            held = np.zeros((len(n), len(LABELS)))
            if len(codes):
                states, _, _ = model.expected(codes, sizes)
                characters = rows.column("characters").flatten().to_numpy(zero_copy_only=False)
                np.add.at(held, np.repeat(row, sizes), (states @ by_label) * characters[:, None])
            total = held.sum(axis=1)
            shares = [pa.array(held[:, k] / np.where(total > 0, total, 1), pa.float64(), mask=total <= 0) for k in range(len(LABELS))]
            yield pa.RecordBatch.from_arrays([rows.column(id_), pa.array(n), rows.column("short_answer"), *shares], names=[id_, "n_lines", "short_answer", *[f"{x}_share" for x in LABELS]])

    return lines.select(id_, "codes", "characters", "short_answer").mapInArrow(label, f"{id_} {kind}, n_lines long, short_answer boolean, " + ", ".join(f"{x}_share double" for x in LABELS))


def not_prose(shares: DataFrame) -> Column:
    """True for documents of :func:`label_shares` that are a list, a table or junk; short answers in words are not."""
    return (F.col("n_lines") > 0) & ~F.col("short_answer") & (F.col("prose_share") <= PROSE_SHARE)


def statistics(documents: DataFrame, id_: str, text: str, common: list[str]) -> DataFrame:
    """(id, n_chars, n_words, mean_word_length, symbol_ratio, end_punct_share, common_share).

    Words are runs of letters, symbols all characters but letters, digits and
    white space. Shares without anything to share in are null; null texts count
    as empty. All in built-in functions, one row for each row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(r"(\p{L}+)"), F.lit(1))
    lines = F.filter(F.split(t, r"\r\n|\n|\r", -1), lambda x: x.rlike(r"\S"))
    rows = documents.select(id_, t.alias("t"), words.alias("w"), lines.alias("l"))
    return rows.select(
        id_,
        F.length("t").cast("long").alias("n_chars"),
        F.size("w").cast("long").alias("n_words"),
        F.round(F.try_divide(F.aggregate("w", F.lit(0), lambda s, x: s + F.length(x)), F.size("w")), 6).alias("mean_word_length"),
        F.round(F.try_divide(F.length(F.regexp_replace("t", r"[\p{L}\p{N}\s]", "")), F.length("t")), 6).alias("symbol_ratio"),
        F.round(F.try_divide(F.size(F.filter("l", lambda x: x.rlike(r"[.!?…][ \t]*\z"))), F.size("l")), 6).alias("end_punct_share"),
        F.round(F.try_divide(F.size(F.filter("w", lambda x: x.isin(common))), F.size("w")), 6).alias("common_share"),
    )
