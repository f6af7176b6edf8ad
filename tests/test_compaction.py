from skylattice.operators.compaction import RECORD_KEY, consolidate, deliver, descriptor_records

TEXTS = [
    "#id cx cy cz m rg alpha delta\n10 1 2 3 1e11 0.2 0.3 0.4\n11 1 2 3 1e11 0.2 0.3 0.4\n",
    "10.000 1.0 2.00 3e0 1e11 0.2 0.3 0.4\r\n1.2e1\t1\t2\t3\t1\t1\t1\tnan\r\n13 1 2 3 1 1 1",
    "  14 1 2 3 1 1 1 1  \r15 1 2 3 1 1 1 x\r16 1 2 3 1 1 1 1 1", "", None, "10 1 2 4 0 0 0 0", "10.5 1 2 3 1 1 1 1",
]


def made(spark):
    return descriptor_records(spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "file_id long, content string"))


KEYS = [(10, 1, 2, 3), (10, 1, 2, 4), (11, 1, 2, 3), (12, 1, 2, 3), (14, 1, 2, 3)]


def keys(df):
    return sorted(tuple(r) for r in df.select(*RECORD_KEY).collect())


def test_each_record_once(spark):
    done = consolidate(made(spark), RECORD_KEY)
    assert keys(done.rows) == KEYS
    files = done.files.collect()
    assert sum(f.n_rows for f in files) == 5 and min(f.min_descriptor_halo_id for f in files) == 10


def numbers(spark, start, end, step=1):
    return spark.range(start, end, step).selectExpr("id AS descriptor_halo_id", "1 AS cell_x", "1 AS cell_y", "1 AS cell_z", "hex(hash(id)) AS rest")


def test_duplicates_can_stay_and_files_roll_by_bytes(spark):
    assert consolidate(made(spark), RECORD_KEY, once=False).rows.count() == 6
    done = consolidate(numbers(spark, 0, 20_000), RECORD_KEY, file_bytes=20_000)
    files = done.files.orderBy("min_descriptor_halo_id").collect()
    assert len(files) >= 6 and max(f.n_bytes for f in files) < 40_000 and done.rows.count() == 20_000
    assert all(a.max_descriptor_halo_id < b.min_descriptor_halo_id for a, b in zip(files, files[1:]))
    for f in files:  # each file is sorted
        ids = [r[0] for r in spark.read.parquet(f.file_name).select("descriptor_halo_id").collect()]
        assert ids == sorted(ids) and (ids[0], ids[-1], len(ids)) == (f.min_descriptor_halo_id, f.max_descriptor_halo_id, f.n_rows)


def test_a_later_delivery_touches_only_the_ranges_it_meets(spark):
    held = consolidate(numbers(spark, 0, 20_000, 2), RECORD_KEY, file_bytes=10_000)
    before = {f.file_name: f for f in held.files.collect()}
    later = numbers(spark, 9_001, 9_400, 2).unionByName(numbers(spark, 9_000, 9_100, 2))  # new keys, and keys that are there
    done = deliver(held, later)
    after = {f.file_name: f for f in done.files.collect()}
    assert keys(done.rows) == sorted([(k, 1, 1, 1) for k in {*range(0, 20_000, 2), *range(9_001, 9_400, 2)}])
    kept = set(before) & set(after)
    assert len(kept) >= len(before) - 3 and all(before[f].max_descriptor_halo_id < 9_000 or before[f].min_descriptor_halo_id > 9_000 for f in kept)
    assert sum(f.n_rows for f in after.values()) == done.rows.count()
    ends = deliver(done, numbers(spark, -5, 0).unionByName(numbers(spark, 30_000, 30_003)))
    assert ends.rows.count() == done.rows.count() + 8
    ranges = ends.files.orderBy("min_descriptor_halo_id").collect()
    assert all(a.max_descriptor_halo_id < b.min_descriptor_halo_id for a, b in zip(ranges, ranges[1:]))


def test_deliveries_keep_duplicates_where_asked(spark):
    held = consolidate(made(spark), RECORD_KEY, once=False)
    assert deliver(held, made(spark)).rows.count() == 12
    empty = consolidate(made(spark).limit(0), RECORD_KEY)
    assert keys(deliver(empty, made(spark)).rows) == KEYS
    assert keys(deliver(consolidate(made(spark), RECORD_KEY), made(spark).limit(0)).rows) == KEYS


def test_a_hot_key_spreads_where_duplicates_stay(spark):
    hot = spark.range(20_000).selectExpr("CASE WHEN id < 18000 THEN 7 ELSE id END AS descriptor_halo_id", "1 AS cell_x", "1 AS cell_y", "1 AS cell_z", "id AS copy")
    done = consolidate(hot, RECORD_KEY, file_bytes=10_000, once=False)
    assert sorted(r.copy for r in done.rows.collect()) == list(range(20_000))
    # the tasks that wrote the hot key
    assert len({f.file_name.rsplit("/", 1)[-1].split("-")[1] for f in done.files.where("min_descriptor_halo_id = 7").collect()}) >= 3


def test_empty(spark):
    done = consolidate(made(spark).limit(0), RECORD_KEY)
    assert done.rows.count() == 0
