import pytest

from skylattice.operators.rejects import load_halo_lines

CSV = [
    ("1,-1,1.0,2.0,3.0,1e11,name,1", None), ('1,-1,1.0,2.0,3.0,1e11,"a, ""b""",1', None), ('"7",-1,"1.0",2.0,3.0,1e11,,', None), ("+1,-1,.5,5.,0,1E+11,x,1", None),
    ('1,-1,1,2,3,1e11,a "b" c,1', "quoting"), ('1,-1,1,2,3,1e11,"a"b,1', "quoting"), ('1,-1,1,2,3,1e11,"a,1', "quoting"), ('1,-1,1,2,3,1e11,a",', "quoting"),
    ("1,-1,1,2,3,1e11,x", "column_count"), ("1,-1,1,2,3,1e11,x,1,", "column_count"), ("1;-1;1;2;3;1e11;x;1", "column_count"),
    ("0,-1,1,2,3,1e11,x,1", "value"), ("1,-2,1,2,3,1e11,x,1", "value"), ("9223372036854775808,-1,1,2,3,1e11,x,1", "value"), ("9223372036854775807,-1,1,2,3,1e11,x,1", None),
    ("1,-1,100,2,3,1e11,x,1", "value"), ("1,-1,-0.1,2,3,1e11,x,1", "value"), ("1,-1,nan,2,3,1e11,x,1", "value"), ("1,-1,1,2,3,0,x,1", "value"), ("1,-1,1,2,3,1e999,x,1", "value"),
    ("1,-1, 1,2,3,1e11,x,1", "value"), ("1,-1,1_0,2,3,1e11,x,1", "value"), ("1,-1,1,2,3,1e11\n,x,1", "value"), ("١,-1,1,2,3,1e11,x,1", "value"), ("1,-1,1,2,3,1e11,x,1\n", None),
]


def listed(**change):
    fields = ["1"] * 40
    fields[5], fields[39] = "-1", "1e11"
    for k, v in change.items():
        fields[int(k[1:])] = v
    return fields


def reasons(spark, lines, kind):
    df = spark.createDataFrame([(k, 1, "f", k, kind, line) for k, line in enumerate(lines)], "line_id long, run_id int, file_name string, line_no int, file_kind string, raw_line string")
    runs = spark.createDataFrame([(1, 100.0)], "run_id int, boxsize_mpc_h double")
    good, bad = load_halo_lines(df, runs)
    return {r.line_id for r in good.collect()}, {r.line_id: r.reason for r in bad.collect()}


def test_csv(spark):
    good, bad = reasons(spark, [line for line, _ in CSV], "csv")
    assert bad == {k: r for k, (_, r) in enumerate(CSV) if r}
    assert good == {k for k, (_, r) in enumerate(CSV) if r is None}


def test_list_and_noise(spark):
    lines = ["  " + " ".join(listed()) + "\t", "\t".join(listed(f5="2")), " ".join(listed()[:-1]), " ".join(listed(f17="x")), " ".join(listed(f39='"1"')), "# c", " \t", "", None, " ".join(listed()) + "\r", "x" * 100_000]
    good, bad = reasons(spark, lines, "list")
    assert good == {0, 1} and bad == {2: "column_count", 3: "value", 4: "value", 9: "value", 10: "column_count"}


@pytest.mark.parametrize("n", [1, 60_000])
def test_long_quoted_line(spark, n):
    good, bad = reasons(spark, ["1,-1,1,2,3,1e11," + '"' + 'a""' * n + '",1'], "csv")
    assert good == {0} and not bad


def test_unknown_run_and_empty(spark):
    df = spark.createDataFrame([(1, 5, "csv", "1,-1,1,2,3,1,x,1")], "line_id long, run_id int, file_kind string, raw_line string")
    runs = spark.createDataFrame([(1, 100.0)], "run_id int, boxsize_mpc_h double")
    assert [r.reason for r in load_halo_lines(df, runs)[1].collect()] == ["value"]
    good, bad = load_halo_lines(df.limit(0), runs)
    assert good.count() == bad.count() == 0
