import random

import duckdb
import numpy as np
import pytest

from skylattice.llm import queries, textquality
from skylattice.llm.textquality import analysed_lines, label_shares, learned, not_prose, statistics

COMMON = (
    "the a an of to in and or is was it that this for on with as at by be not but you i my we they have had has are were do does will would can "
    "der die das ein eine und oder ist war nicht mit auf für von zu im es ich man auch wenn aber nur noch "
    "el la los las un una y o es en de que no con por para se lo su como pero si le les une et ou est pas avec pour sur ce il on mais plus du"
).split()
PROSE = [
    "I had to move the {0} to the other side of the {1}, but it was not easy.", "The noise is in the {0} and that is not what you want.", "You have to look for this in the first part of the {1}.",
    "Ich habe die {0} auf die andere Seite gestellt, aber es war nicht einfach.", "Man kann die {0} und das {1} auch ohne den Deckel benutzen.",
    "La {0} no está en el mismo lado que el {1}, pero se puede usar.", "Hay que mirar si la {0} y el {1} son de la misma serie.",
    "Il faut regarder si la {0} et le {1} sont de la même série, mais ce n'est pas sûr.", "On ne peut pas ouvrir la {0} avec le {1} pour le moment.",
]
WORDS = "pump valve chain sieve mortar ladder bucket panel hinge barrel Pumpe Ventil Kette Leiter tornillo cadena bomba tabla échelle soupape pompe chaîne".split()


def texts():
    rng = random.Random(1)
    noun = lambda: " ".join(rng.sample(WORDS, rng.choice((1, 2))))
    said = lambda n: " ".join(rng.choice(PROSE).format(*rng.sample(WORDS, 2)) for _ in range(n))
    bad, good = [], []
    for _ in range(12):
        bad += [
            "\n".join(f"- {noun()}" for _ in range(20)), "\n".join(f"{noun()}\t{rng.randint(1, 99)}\t{rng.random():.2f}" for _ in range(20)), " ".join(rng.choices(WORDS, k=80)),
            "\n".join(noun() for _ in range(20)), "." * 90, "\n".join("https://a.test/x/%d" % rng.randint(1, 999) for _ in range(9)), "asdf jkl qwrt zxcv " * 6,
            "Here:\n" + "\n".join(f"{k}) {noun()}" for k in range(40)), " ".join("".join(rng.choices("bcdfghjkl", k=9)) for _ in range(30)),
        ]
    for _ in range(500):
        good.append("\n\n".join(said(rng.choice((2, 4, 6))) for _ in range(rng.choice((1, 2, 3)))))
    good += [said(6).upper() for _ in range(9)] + [said(5) + "\n\n" + "\n".join(f"{k}: {k * k}," for k in range(5)) for _ in range(9)]
    return bad, good + ["Yes.", "Thanks a lot!", "It is the pump, not the valve."]


def rules_alone(rows):
    """The start of the model without any learning: prose is what has common words."""
    return {k for k, codes, chars in rows if len(codes) and sum(c for s, c in zip(textquality.start_state(np.array(codes)), chars, strict=True) if s >= 4) <= 0.2 * sum(chars)}


def test_labels(spark):
    bad, good = texts()
    rows = [*enumerate(bad), *((1000 + k, t) for k, t in enumerate(good)), (5000, None), (5001, ""), (5002, " \n\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shares = textquality.stage(label_shares(df, "doc_id", "text", COMMON), "shares")
    found = {r.doc_id for r in shares.where(not_prose(shares)).collect()}
    true = set(range(len(bad)))
    assert len(found & true) >= 0.95 * len(bad) and len(found & true) >= 0.95 * len(found)
    lines = [(r.doc_id, r.codes, r.characters) for r in analysed_lines(df, "doc_id", "text", COMMON).collect()]
    plain = rules_alone(lines)
    assert len(found ^ true) <= len(plain ^ true)
    one = shares.where("doc_id = 1000").first()
    assert one.prose_share + one.list_share + one.table_share + one.junk_share == pytest.approx(1)
    assert shares.where("doc_id >= 5000").select("n_lines").collect() == [(0,)] * 3
    assert label_shares(df.limit(0), "doc_id", "text", COMMON, rounds=1).count() == 0


def test_expected_states_against_brute_force(spark):
    rng = np.random.default_rng(2)
    n = len(textquality.LEVELS)
    counts = {(k, s, v): float(rng.integers(1, 50)) for k, size in enumerate(textquality.LEVELS.values()) for s in range(10) for v in range(size)}
    counts |= {(-1, s, 0): float(rng.integers(1, 9)) for s in range(10)} | {(-2, s, b): float(rng.integers(1, 9)) for s in range(10) for b in range(10)}
    model = textquality.LineModel(counts)
    codes, sizes = rng.integers(0, 1000, 7), np.array([2, 1, 4])
    assert textquality.decoded(codes).shape == (7, n)
    states, first, moves = model.expected(codes, sizes)
    e = model.likelihood(codes)
    ways = np.einsum("i,ij,jk,kl->ijkl", model.first * e[3], model.moved * e[4], model.moved * e[5], model.moved * e[6])
    ways /= ways.sum()
    for k, axes in enumerate([(1, 2, 3), (0, 2, 3), (0, 1, 3), (0, 1, 2)]):
        assert np.allclose(states[3 + k], ways.sum(axis=axes))
    two = np.einsum("i,ij->ij", model.first * e[0], model.moved * e[1])
    assert np.allclose(moves, two / two.sum() + ways.sum(axis=(2, 3)) + ways.sum(axis=(0, 3)) + ways.sum(axis=(0, 1)))
    assert first.sum() == pytest.approx(3)


def test_whole_long_texts(spark):
    df = spark.createDataFrame([(1, "word " * 40_000), (2, "a b, c. " * 5_000), (3, "x\n" * 5_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in analysed_lines(df, "doc_id", "text", COMMON).collect()}
    assert sum(rows[1].characters) >= 199_000 and len(rows[2].codes) > 100 and len(rows[3].codes) == 5_000
    got = {r.doc_id: r for r in label_shares(df, "doc_id", "text", COMMON, rounds=2).collect()}
    assert got[3].n_lines == 5_000 and all(r.prose_share is not None for r in got.values())
    model = learned(analysed_lines(df, "doc_id", "text", COMMON), rounds=1)
    assert model.first.sum() == pytest.approx(1) and np.allclose(model.moved.sum(axis=1), 1)


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat, sat.\n\nOn it"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in statistics(df, "doc_id", "text", ["the", "on", "it", *map(str, range(20))]).collect()}
    assert (got[1].n_words, got[1].end_punct_share, got[1].common_share, got[1].mean_word_length) == (5, 0.5, 0.6, 2.6)
    assert (got[2].n_chars, got[2].n_words, got[2].mean_word_length, got[3].symbol_ratio) == (0, 0, None, None)


def test_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "common_words", "descriptors", "descriptor_summaries"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("p1_found", "p9_statistics"):
        want = con.execute(queries.ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(str, map(tuple, queries.QUERIES[name](spark, d).select(*columns).collect()))) == sorted(map(str, want.fetchall()))
