import os

import pandas as pd
import pytest

from tabloom import Session, VerbError
from tabloom.operators import aggregate as A
from tabloom.operators import columns as C
from tabloom.operators import reshape as R
from tabloom.operators import stats as X
from tabloom.operators import twotable as T
from tabloom.sources.names import sanitised
from tabloom.sources.readers import boundary, use
from tabloom.sources.writers import save


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(1, 2019, 10.0, "a"), (1, 2020, 12.0, "a"), (2, 2019, 20.0, "b"), (2, 2020, None, "b"), (3, 2019, 30.0, "a"), (3, 2020, 33.0, "a")]
    return boundary(spark.createDataFrame(rows, "id int, year int, wage double, firm string"))


@pytest.fixture(scope="module")
def using(spark):
    return boundary(spark.createDataFrame([(1, 100.0, 9.9), (2, 200.0, 9.9), (4, 400.0, 9.9), (None, 999.0, 9.9)], "id int, tfp double, wage double"))


def rows(v):
    return [tuple(r) for r in v.sorted_df().collect()]


def test_filters(panel):
    assert C.count(C.keep_if(panel, "wage > 15")) == 3
    assert C.count(C.drop_if(panel, "wage > 15")) == 3
    assert panel.names == ["id", "year", "wage", "firm"]


def test_collapse(panel):
    v = A.collapse(C.sort(panel, "id year"), "(mean) m=wage (sum) s=wage (count) n=wage (median) d=wage (p25) q=wage (first) f=wage (lastnm) l=wage", "firm")
    assert rows(v) == [("a", 21.25, 85.0, 4, 21.0, 11.0, 10.0, 33.0), ("b", 20.0, 20.0, 1, 20.0, 20.0, 20.0, 20.0)]
    v = A.collapse(C.gsort(panel, "-year id"), "(first) f=wage", "firm")
    assert rows(v) == [("a", 12.0), ("b", None)]


def test_empty_collapse_has_no_rows(panel):
    assert rows(A.collapse(C.keep_if(panel, "id > 9"), "(sum) wage")) == []


def test_percentile_rule_by_brute_force(spark):
    for n in range(1, 24):
        v = boundary(spark.createDataFrame([(float(k),) for k in range(n)], "x double"))
        want = {}
        for p in (1, 25, 50, 90, 99):
            k, rest = divmod(n * p, 100)
            want[float(p)] = (max(k, 1) - 1 + min(k + 1, n) - 1) / 2 if rest == 0 else float(k)
        got = A.ranked_percentiles(v.df, [], ["x"], [(f"p{int(p)}", "x", p) for p in want]).first()
        assert {p: got[f"p{int(p)}"] for p in want} == want


def test_percentiles_of_large_groups_are_those_of_small_ones(spark, monkeypatch):
    rows_ = [(None if k % 7 == 0 else f"g{k % 3}", k % 2, None if k % 11 == 0 else float(k * k % 97), float(k)) for k in range(400)] + [("alone", 0, None, 1.0)]
    v = boundary(spark.createDataFrame(rows_, "g string, h int, x double, y double"))
    text = "(p1) a=x (median) b=x (p90) c=x (p50) d=y (mean) e=y (p25) f=h"
    calls = [lambda by=by: rows(A.collapse(v, text, by)) for by in ("g", "g h", "")]
    calls += [lambda: rows(A.collapse(v, "(p10) x", "g")), lambda: sorted(map(tuple, X.tabstat(v, "x y", "p50 mean p5", "g").collect())), lambda: sorted(map(tuple, X.tabstat(v, "x", "median").collect()))]
    small = [c() for c in calls]
    monkeypatch.setattr(A, "LARGE_GROUP", 0)
    assert [c() for c in calls] == small
    empty = C.keep_if(v, "y > 1000")
    assert rows(A.collapse(empty, text, "g")) == rows(A.collapse(empty, text)) == []
    assert "alone" in [r[0] for r in small[0]] and small[0][[r[0] for r in small[0]].index("alone")][1:4] == (None, None, None)


def test_merge(panel, using):
    with pytest.warns(UserWarning):
        v = T.merge(panel, "m:1", "id", using)
    assert sorted(r[-1] for r in rows(v)) == [1, 1, 2, 2, 3, 3, 3, 3]
    assert {k: T.merge(panel, "m:1", "id", using, keep=k, keepusing="tfp").df.count() for k in ("match", "master", "using", "match master", "match using", "master using")} == {"match": 4, "master": 2, "using": 2, "match master": 6, "match using": 6, "master using": 4}


def test_merge_contracts(panel, using):
    with pytest.raises(VerbError):
        T.merge(panel, "1:1", "id", using)
    with pytest.raises(VerbError):
        T.merge(panel, "m:m", "id", using)
    with pytest.raises(VerbError):
        T.merge(panel, "m:1", "firm", using)


def test_missing_keys_match(spark):
    a = boundary(spark.createDataFrame([(None, 1), (2.0, 2)], "k double, x int"))
    b = boundary(spark.createDataFrame([(float("nan"), 7)], "k double, y int"))
    assert rows(C.keep(T.merge(a, "1:1", "k", b, keep="match"), "x y")) == [(1, 7)]


def test_merge_in_turn(spark):
    a = boundary(spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "k int, x int"))
    b = boundary(spark.createDataFrame([(1, 20), (1, 21), (2, 22)], "k int, y int"))
    assert sorted(rows(T.merge_in(a, "m:m", "k", b)), key=str) == sorted([(1, 10, 20, 3), (1, 11, 21, 3), (1, 12, 21, 3), (2, None, 22, 2)], key=str)


def test_update(spark):
    a = boundary(spark.createDataFrame([(1, None), (2, 5.0)], "k int, x double"))
    b = boundary(spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double"))
    assert sorted(r[:2] for r in rows(T.merge_in(a, "1:1", "k", b, update=True))) == [(1, 1.0), (2, 5.0)]
    assert sorted(r[:2] for r in rows(T.merge_in(a, "1:1", "k", b, replace=True, asserted="match"))) == [(1, 1.0), (2, 2.0)]


def test_append_kinds(panel, using):
    assert T.append(panel, using, generate="src").df.count() == 10
    with pytest.raises(VerbError):
        T.append(panel, C.rename(C.gen(using, "z", '"q"'), "wage z", "w wage"))


def test_reshape(panel):
    wide = R.reshape_wide(C.keep(panel, "id year wage"), "wage", "id", "year")
    assert rows(wide) == [(1, 10.0, 12.0), (2, 20.0, None), (3, 30.0, 33.0)]
    assert rows(R.reshape_long(wide, "wage", "id", "year"))[:2] == [(1, 2019, 10.0), (1, 2020, 12.0)]
    with pytest.raises(VerbError):
        R.reshape_wide(panel, "wage", "id", "year")
    assert rows(R.pivot(panel, "(mean) wage", "firm", "year")) == [("a", 20.0, 22.5), ("b", 20.0, None)]


def test_reshape_long_carries_leading_zeros_and_refuses_gaps(spark):
    v = boundary(spark.createDataFrame([(1, 10, 100), (2, 20, 200)], "id int, inc1 int, inc01 int"))
    got = R.reshape_long(v, "inc", "id", "year")
    assert got.names == ["id", "year", "inc", "inc01"] and rows(got) == [(1, 1, 10.0, 100), (2, 1, 20.0, 200)]
    only = R.reshape_long(C.drop(v, "inc1"), "inc", "id", "year")
    assert rows(only) == [(1, 1, None, 100), (2, 1, None, 200)]
    with pytest.raises(VerbError, match="a2 is missing"):
        R.reshape_long(boundary(spark.createDataFrame([(1, 2, 3)], "id int, a1 int, b2 int")), "a b", "id", "j")
    with pytest.raises(VerbError, match="ax is missing"):
        R.reshape_long(boundary(spark.createDataFrame([(1, 2, 3, 4)], "id int, aw int, bw int, bx int")), "a b", "id", "j")


def test_order_survives_a_dropped_key(panel):
    v = C.keep(C.gsort(panel, "-wage"), "id")
    assert [r[0] for r in rows(v)] == [3, 3, 2, 1, 1, 2] and v.names == ["id"]


def test_rows_in_order(panel):
    assert rows(C.keep(C.keep_in(C.sort(panel, "wage"), 2, 3), "wage")) == [(12.0,), (20.0,)]
    with pytest.raises(VerbError):
        C.count(C.keep_in(panel, 5, 99))
    v = C.gen(C.sort(panel, "wage"), "r", "_n / _N")
    assert [r[-1] for r in rows(v)] == [k / 6 for k in range(1, 7)]


def test_storage(panel):
    v = C.gen(panel, "b", "wage * 4", "byte")
    assert sorted(str(r[-1]) for r in rows(v)) == sorted(["40", "48", "80", "None", "None", "None"])
    v = C.gen(panel, "t", 'firm + "éé"', "str3")
    assert rows(v)[0][-1] == "aé"


def test_sample_is_the_same_on_every_run(spark):
    base = spark.createDataFrame([(k % 50, float(k % 7)) for k in range(3000)] + [(7, 7.0)] * 2000, "a int, b double")
    for size, count, want in ((10, False, 500), (37.5, False, 1875), (1, True, 1), (4999, True, 4999), (90, False, 4500), (100, False, 5000), (9999, True, 5000)):
        got = [sorted(map(tuple, C.sample(boundary(base.repartition(n)), size, count, seed=4).df.collect())) for n in (1, 5)]
        assert len(got[0]) == want and got[0] == got[1]
    every = C.sample(boundary(base), 20, seed=4).df.groupBy("a", "b").count().join(base.groupBy("a", "b").count().toDF("a", "b", "n"), ["a", "b"])
    assert every.where("count > n").count() == 0


def test_row_numbers_by_brute_force(spark):
    rows_ = [(None if k % 5 == 0 else k * 7 % 13, "" if k % 4 == 0 else "ab"[: k % 3] + "é" * (k % 2), k) for k in range(200)]
    v = boundary(spark.createDataFrame(rows_, "x int, s string, k int").repartition(7))
    for keys, sort in (("-s x k", lambda r: (0, [-b for b in r[1].encode()] + [1], r[0] is None, r[0] or 0, r[2])), ("-x +s -k", lambda r: (r[0] is None, -(r[0] or 0), r[1].encode(), -r[2])), ("k", lambda r: r[2])):
        w = C.gsort(v, keys)
        order = [r[2] for r in sorted([(a, b or "", c) for a, b, c in rows_], key=sort)]
        got = {r["k"]: r["r"] for r in C.gen(w, "r", "_n").df.collect()}
        assert [k for k, _ in sorted(got.items(), key=lambda z: z[1])] == order and sorted(got.values()) == list(range(1, 201))
        assert sorted(r["k"] for r in C.keep_in(w, 30, 95).df.collect()) == sorted(order[29:95])
        first = {r["x"]: r["f"] for r in A.collapse(w, "(first) f=k", "x").df.collect()}
        assert first == {x: next(k for k in order if rows_[k][0] == x) for x in {r[0] for r in rows_}}
        kept = A.duplicates_drop(w, "x", force=True).df.collect()
        assert {r["x"]: r["k"] for r in kept} == first
    plan = C.keep(C.gen(C.sort(v, "k"), "r", "_n"), "r").df._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan or "checkpoint" not in plan


def test_sample_is_exact(panel):
    assert C.sample(panel, 50).df.count() == 3 and C.sample(panel, 2, count=True, seed=5).df.count() == 2


def test_statistics(panel):
    assert X.levelsof(panel, "year") == ["2019", "2020"]
    assert [tuple(r) for r in X.misstable_patterns(panel, "wage firm").collect()] == [("++", 5), (".+", 1)]
    assert abs(X.significance(0.5, 20) - 0.0247696) < 1e-6
    assert X.summarize_detail(panel, "wage").first()["p50"] == 20.0
    assert [r["freq"] for r in X.histogram(panel, "wage", 2).collect()] == [3, 2]
    constant = C.gen(panel, "one", "1")
    assert X.correlate(constant, "wage one").where("row <> col").first()["rho"] is None


def test_names():
    assert sanitised(["if", "x y", "2a", "ok", "ok", "a" * 40]) == ["_if", "x_y", "_2a", "ok", "ok_2", "a" * 32]


def test_save_round_trip(panel, tmp_path, spark):
    v = C.fmt(C.label(C.gen(C.sort(panel, "id"), "d", "td(1jan2020) + id"), "wage", "Wage"), "d", "%td")
    dest = str(tmp_path / "t")
    assert save(v, dest) == 6
    back = use(spark, dest)
    assert back.meta["wage"].label == "Wage" and back.order == (("id", False),) and sorted(map(str, rows(back))) == sorted(str((*r[:4], int(r[4]))) for r in rows(v))
    assert str(spark.read.parquet(dest).schema["d"].dataType) == "DateType()"
    with pytest.raises(VerbError):
        save(v, dest)
    with pytest.raises(VerbError):
        save(back, dest, replace=True)
    assert save(v, dest, replace=True, compression="zstd", partition_by="firm") == 6
    assert not [n for n in os.listdir(tmp_path) if n != "t"]


def test_strict_and_relaxed(spark, tmp_path):
    pd.DataFrame({"a": [1], "b": [2]}).to_parquet(tmp_path / "1.parquet")
    pd.DataFrame({"a": [1], "c": ["x"]}).to_parquet(tmp_path / "2.parquet")
    with pytest.raises(VerbError, match="differ"):
        use(spark, str(tmp_path / "*.parquet"))
    assert sorted(use(spark, str(tmp_path / "*.parquet"), relaxed=True).names) == ["a", "b", "c"]
    pd.DataFrame({"a": [1]}).to_parquet(tmp_path / "[x].parquet")
    assert use(spark, str(tmp_path / "[x].parquet")).df.count() == 1
    (tmp_path / "t.csv").write_text("a;b\n1;x\n2;y\n")
    assert rows(C.sort(use(spark, str(tmp_path / "t.csv")), "a")) == [(1, "x"), (2, "y")]


def test_boundary(spark):
    df = spark.sql("SELECT date'1960-01-02' AS d, timestamp_ntz'1959-12-31 23:59:59.9995' AS t, true AS b, double('NaN') AS x, array(1) AS a, string(null) AS s")
    with pytest.warns(UserWarning):
        v = boundary(df)
    assert rows(v) == [(1, -1, 1, None, "")] and v.meta["d"].fmt == "%td"


def test_session(spark, panel):
    s = Session(spark)
    s.open_data(panel.df, "p")
    s.keep_if("wage > 15")
    with pytest.raises(VerbError):
        s.gen("wage", "1")
    assert s.count() == 3 and [v[0] for v in s.list_views()] == ["p"] and "keep if" in s.show()
    s.use("view:p", name="q")
    s.drop("firm")
    with s.on("p"):
        assert "firm" in s.ds()
    s.set("missing_high", "on")
    assert s.count("id < .") == 3
    s.close("_all")
    with pytest.raises(VerbError):
        s.count()
    assert s.selftest()


@pytest.fixture(scope="module")
def remote(spark, tmp_path_factory):
    """A folder by a path that only Spark's file systems can open."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", "file://" + str(tmp_path_factory.mktemp("far")))
    return "viewfs://far/in"


def test_remote_store_keeps_labels_and_is_strict(spark, panel, remote):
    v = C.label_define(C.note(C.label(C.sort(panel, "id year"), "wage", "Wage"), "a note"), "yl", {2019: "old"})
    v = C.char(C.label_values(v, "year", "yl"), "wage", "unit", "EUR")
    assert save(v, f"{remote}/t") == 6
    back = use(spark, f"{remote}/t")
    assert back.meta["wage"].label == "Wage" and back.meta["wage"].chars == (("unit", "EUR"),) and back.notes == ("a note",)
    assert back.order == (("id", False), ("year", False)) and back.value_labels == {"yl": {2019: "old"}} and back.meta["year"].value_label == "yl"
    assert rows(back) == rows(v)
    with pytest.raises(VerbError, match="already exists"):
        save(v, f"{remote}/t")
    assert save(C.keep_if(v, "id < 3"), f"{remote}/t", replace=True) == 4 and use(spark, f"{remote}/t").df.count() == 4
    save(C.keep(v, "id wage"), f"{remote}/two/a.parquet")
    save(C.keep(v, "id firm"), f"{remote}/two/b.parquet")
    with pytest.raises(VerbError, match="differ"):
        use(spark, f"{remote}/two/*.parquet")
    assert sorted(use(spark, f"{remote}/two/*.parquet", relaxed=True).names) == ["firm", "id", "wage"]


def test_replace_keeps_storage(spark):
    v = boundary(spark.createDataFrame([(1, 2, 1.5, 2.5)], "b tinyint, i int, f float, d double"))
    kind = lambda w, n: w.type_of(n).simpleString()
    assert [kind(C.replace(v, n, "."), n) for n in "bifd"] == ["tinyint", "int", "float", "double"]
    assert kind(C.replace(v, "i", "i + 1"), "i") == "bigint" and rows(C.replace(v, "i", "i + 1"))[0][1] == 3
    assert kind(C.replace(v, "f", "i"), "f") == "float" and kind(C.replace(v, "f", "d"), "f") == "double" and kind(C.replace(v, "i", "i / 2"), "i") == "double"
    assert kind(C.replace(v, "b", "300", "i > 5"), "b") == "smallint"


def test_loading_refuses_and_notes(spark):
    v = boundary(spark.createDataFrame([(1, 9e307, 2**60), (2, 1.0, 3)], "k int, x double, big long"))
    from tabloom.sources.writers import collect

    with pytest.warns(UserWarning, match="x: 1 values"), pytest.warns(UserWarning, match="big: 1 values"):
        collect(v)
    narrow = C.gen(v, "n", "k", "byte")
    wide = View_with(narrow, C.changed(narrow.meta["n"], storage="byte"))
    with pytest.raises(VerbError, match="outside the range"):
        collect(wide)


def View_with(v, meta):  # noqa: N802  a view whose variable holds more than it declares
    from dataclasses import replace

    from pyspark.sql import functions as F

    return replace(v, df=v.df.withColumn("n", F.lit(1000)), meta={**v.meta, "n": meta})


def test_saving_notes_rounded_dates(spark, panel, tmp_path):
    v = C.fmt(C.gen(panel, "d", "td(1jan2020) + id / 2"), "d", "%td")
    with pytest.warns(UserWarning, match="rounded: d"):
        assert save(v, str(tmp_path / "t")) == 6


def test_label_clash_warns_and_options(spark):
    a = C.label_define(boundary(spark.createDataFrame([(1, "p", 2.0)], "k int, s string, x double")), "l", {1: "one"})
    b = C.note(C.label_define(boundary(spark.createDataFrame([(1, 5, 3.0), (2, 6, 4.0)], "k int, s int, x double")), "l", {1: "uno"}), "from b")
    with pytest.warns(UserWarning, match="value label l differs"):
        assert T.joinby(a, "k", C.keep(b, "k")).value_labels["l"] == {1: "one"}
    got = T.merge_in(a, "1:1", "k", b, update=True, force=True, nolabel=True)
    assert sorted(rows(got), key=str) == [(1, "p", 2.0, 3), (2, "", 4.0, 2)] and got.notes == ("from b",)
    assert T.merge_in(a, "1:1", "k", C.drop(b, "s"), nonotes=True, nolabel=True).notes == () and T.merge_report(got) == {"Master only (1)": 0, "Using only (2)": 1, "Matched (3)": 1}
    with pytest.raises(VerbError):
        T.append_in(a, b)
    assert sorted(rows(T.append_in(a, b, force=True)), key=str) == [(1, "", 3.0), (1, "p", 2.0), (2, "", 4.0)]
    assert T.append_in(a, b, keep="k x").df.count() == 3


def test_two_way_totals(panel):
    got = {(r["row"], r["col"]): (r["freq"], r["row_percent"]) for r in X.tabulate_two(panel, "firm", "year", totals=True).collect()}
    assert got["Total", "Total"] == (6, 100.0) and got["a", "Total"] == (4, 100.0) and got["Total", "2019"] == (3, 50.0)


def test_describing(spark, panel, tmp_path, remote):
    v = C.label(panel, "wage", "Hourly pay")
    told = {r["variable"]: tuple(r)[1:] for r in X.describe(v).collect()}
    assert told["wage"] == ("n", "double", "", "Hourly pay") and told["firm"][0] == "s" and list(told) == panel.names
    assert X.lookfor(v, "pay") == ["wage"] and X.lookfor(v, "FIR year") == ["year", "firm"] and X.lookfor(v, "none") == []
    dest = str(tmp_path / "t")
    assert save(C.sort(panel, "id"), dest, compression="zstd", level=5, chunk=2) == 6 and save(panel, str(tmp_path / "g"), compression="gzip", level=9) == 6
    save(panel, f"{remote}/described")
    for path in (dest, "file://" + dest, f"{remote}/described"):
        got = Session(spark).describe_file(path)
        assert (got["rows"], got["columns"], got["metadata"]) == (6, 4, True) and got["row_groups"] >= 1 and list(got["types"]) == panel.names
    with pytest.raises(VerbError):
        save(panel, str(tmp_path / "x"), compression="brotli")
    with pytest.raises(VerbError):
        save(panel, str(tmp_path / "x"), chunk=0)
    with pytest.raises(VerbError, match="level"):
        save(panel, str(tmp_path / "x"), compression="snappy", level=3)


def test_groups_of_missing_keys(spark):
    v = boundary(spark.createDataFrame([(None, "", 1.0), (float("nan"), None, 2.0), (1.0, "a", 3.0), (1.0, "", 4.0)], "k double, s string, x double"))
    assert sorted(rows(A.collapse(v, "(sum) x", "k")), key=str) == [(1.0, 7.0), (None, 3.0)]
    assert sorted(r[2] for r in rows(A.collapse(v, "(sum) x", "k s"))) == [3.0, 3.0, 4.0] and A.contract(v, "s").df.count() == 2
    assert rows(C.keep(A.egen(v, "t", "total", "x", "k"), "x t")) and sorted((r["x"], r["t"]) for r in A.egen(v, "t", "total", "x", "k").df.collect()) == [(1.0, 3.0), (2.0, 3.0), (3.0, 7.0), (4.0, 7.0)]
    assert A.duplicates_drop(C.keep(v, "k s")).df.count() == 3


def test_joinby_sorts_blocks_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_PAIRS", 6)
    monkeypatch.setattr(T, "BLOCK_ROWS", 5)
    left = [(1.0, "b", i) for i in range(23)] + [(0.0, "a", 1), (-0.0, "a", 1), (float("nan"), "a", 2), (None, "", 3), (None, None, 4), (9.0, "z", 5)]
    right = [(1.0, "b", str(i)) for i in range(17)] + [(0.0, "a", "x"), (0.0, "a", "x"), (None, "a", "y"), (None, "", None), (8.0, "z", "w")]
    a, b = boundary(spark.createDataFrame(left, "k double, s string, x int")), boundary(spark.createDataFrame(right, "k double, s string, `y z` string"))
    v = T.joinby(a, "k s", b)
    got = [tuple(r) for r in v.sorted_df().collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in v.df.collect()) and len(got) == 23 * 17 + 4 + 1 + 2
    keys = [(k is None, k or 0.0, s is None, s or "") for k, s, *_ in got]
    assert keys == sorted(keys) and v.sorted_df().columns == ["k", "s", "x", "y_z"]
    plan = v.sorted_df()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Sort")  # the pairs are made of sorted blocks
    assert [r[2] for r in rows(C.gsort(C.keep_if(v, "x > 20"), "-x"))] == [22] * 17 + [21] * 17
    assert C.keep_if(v, "x == 6").sorted_df().count() == 17
    assert T.joinby(C.keep(a, "k"), "k", C.keep(b, "k")).sorted_df().count() == 23 * 17 + 4 + 3 * 2
