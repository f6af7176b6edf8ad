import numpy as np
import pytest

from skylattice.llm import mixing, packing, tokens


def test_pack_keeps_everything():
    sizes = np.random.default_rng(0).integers(1, 101, 3000)
    placed, levels = packing.pack(sizes, 100)
    assert (np.bincount(placed, weights=sizes) == levels).all() and levels.max() <= 100
    assert sizes.sum() / (len(levels) * 100) > 0.95
    assert len(packing.pack(np.array([], dtype=int), 10)[1]) == 0
    assert list(packing.pack(np.array([10, 10]), 10)[1]) == [10, 10]


def test_layout(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(v)) for k, v in enumerate(rng.integers(1, 60, 2000))] + [(5000, 250), (5001, 100), (5002, 0), (5003, None), (5004, -3), (7, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumnRenamed("n", "n_tokens")
    out = packing.layout(df, "doc_id", "n_tokens", {1: 100, 2: 64, 3: 0, 4: None}, block_items=300).toPandas()
    for pack, capacity in ((1, 100), (2, 64)):
        own = out[out.pack_id == pack]
        assert own.groupby("container_id").n_tokens.sum().max() <= capacity
        assert own.n_tokens.sum() == sum(v for _, v in rows if v and v > 0)
        parts = own.groupby("item_id").size()
        assert set(parts[parts > 1].index) <= {7, *[k for k, v in rows if v and v > capacity]}
        long = own[own.item_id == 5000].sort_values("start_token")
        assert list(long.start_token) == list(np.cumsum([0, *long.n_tokens])[:-1]) and long.n_tokens.sum() == 250
    report = {r.pack_id: r for r in packing.fill_report(spark.createDataFrame(out)).collect()}
    assert report[1].fill_share > 0.97 and report[1].n_containers >= report[1].fewest_containers
    assert packing.layout(df, "doc_id", "n_tokens", {}).count() == 0
    assert packing.layout(df.limit(0), "doc_id", "n_tokens", {1: 10}).count() == 0


def test_token_sizes(spark):
    texts = ["Hello world", "", None, "<|endoftext|>", "é" * 2000, "a b\n" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.sized(df, "doc_id", "text").collect()}
    enc = tokens.encoding(tokens.VOCABULARY, tokens.PATTERN)
    assert got == {k: len(enc.encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


def test_exponents_and_budgets():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    e = mixing.entropy_exponent(shares, 1.0)
    assert mixing.entropy(mixing.tempered(shares, e)) == pytest.approx(1.0, abs=1e-6)
    src = [mixing.Source("a", 0.5, 1, 10, 1000), mixing.Source("b", 0.3, 2, 10, 200), mixing.Source("c", 0.2, 1, 0, 0)]
    got = mixing.budgets(src)
    assert got["b"] == pytest.approx(400) and got["a"] / got["b"] == pytest.approx(5 / 3) and got["c"] == 0
    more = mixing.budgets(src, 1200)
    assert sum(more.values()) == pytest.approx(1200) and more["a"] <= 1000 + 1e-6 and more["b"] <= 400 + 1e-6
    assert sum(mixing.budgets(src, 10**9).values()) == pytest.approx(1400)
    assert mixing.budgets([mixing.Source("x", 0.0, 1, 1, 1)]) == {"x": 0.0}
    assert mixing.budgets([mixing.Source("x", 0.3, 2, 1, 10)]) == {"x": 20.0}
    assert 0.7 ** mixing.target_exponent(0.7, 0.2) == pytest.approx(0.2) and 0.01 ** mixing.target_exponent(0.01, 0.9) == pytest.approx(0.9)
    flat = mixing.budgets(src, aim="entropy")
    shares = mixing.normalised({k: v for k, v in flat.items() if v})
    assert mixing.entropy(shares) == pytest.approx(mixing.entropy(mixing.normalised({"a": 0.5, "b": 0.3})), abs=1e-6)
    with pytest.raises(ValueError, match="aim"):
        mixing.budgets(src, aim="x")


def test_bisection_runs(monkeypatch):
    steps = []
    plain = mixing._bisected

    def counting(low, high, rising, n=60):
        return plain(low, high, lambda x: steps.append(x) or rising(x), n)

    monkeypatch.setattr(mixing, "_bisected", counting)
    src = [mixing.Source("a", 0.5, 1, 10, 1000), mixing.Source("b", 0.3, 2, 10, 200)]
    mixing.budgets(src)
    assert len(steps) == 120  # an exponent for each source
    mixing.budgets(src, 1200)
    assert len(steps) == 300  # and a part for the limits


def test_mixture(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "ABC "[k % 3], int(rng.integers(1, 200))) for k in range(3000)] + [(9001, "a", 20_000), (9002, None, 5), (9003, "z", 7), (9004, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("source", mixing.source_name("source"))
    targets = spark.createDataFrame([("a", 0.2, 1), ("B ", 0.3, 2), ("c", 0.4, 3), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    sources = mixing.known_sources(df, targets)
    mixed = mixing.mixture(df, "doc_id", sources)
    uses = mixed.toPandas()
    assert set(uses.source) == {"a", "b", "c"} and uses.doc_id.is_unique and (uses.n_uses >= 1).all()
    limits = {"a": 1, "b": 2, "c": 3}
    assert all(uses[uses.source == s].n_uses.max() <= m for s, m in limits.items())
    got = {r.source: r for r in mixing.reached(mixed, sources).collect()}
    for s, t in (("a", 0.2), ("b", 0.3), ("c", 0.4)):
        assert got[s].reached_share == pytest.approx(t / 0.9, abs=0.005)
    assert got["gone"].n_tokens == 0
    # nothing that would still fit is left out
    budget = mixing.budgets(sources)
    for s in "abc":
        own = df.where(f"source = '{s}' AND n_tokens > 0").toPandas().n_tokens
        used = uses[uses.source == s]
        free = budget[s] - (used.n_tokens * used.n_uses).sum()
        assert 0 <= free < max(1, own.max()) and (len(used) == len(own) or free < 200)
    wanted = 1.1 * (uses.n_tokens * uses.n_uses).sum()
    every = mixing.mixture(df, "doc_id", sources, tokens=int(wanted)).toPandas()
    assert all(every[every.source == s].n_uses.max() <= m for s, m in limits.items())
    assert 0.99 * wanted < (every.n_tokens * every.n_uses).sum() <= wanted
    assert mixing.mixture(df.limit(0), "doc_id", mixing.known_sources(df.limit(0), targets)).count() == 0
