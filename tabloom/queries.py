"""The queries of the engine's own operators, each with the SQL it is held against."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregate as A
from .operators import columns as C
from .operators import reshape as R
from .operators import stats as X
from .operators import twotable as T
from .plans.folder import shared_path
from .plans.view import View
from .session import Session
from .sources.readers import boundary, use
from .sources.writers import save

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def opened(spark: SparkSession, sf_dir: str, name: str, cols: str = "") -> View:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    v = boundary(df.select(*cols.split()) if cols else df, (f"{sf_dir}/{name}.parquet",), f"use {name}")
    return v


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), k) for n, k in places.items()})


def query(name: str, table: str, sql: str, cols: str = ""):
    """Register verbs on a table's view with their SQL."""

    def add(f):
        def run(spark, sf_dir):
            out = f(opened(spark, sf_dir, table, cols))
            return out.sorted_df() if isinstance(out, View) else out

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def query2(name: str, tables: tuple[tuple[str, str], ...], sql: str):
    def add(f):
        def run(spark, sf_dir):
            out = f(*[opened(spark, sf_dir, t, c) for t, c in tables])
            return out.sorted_df() if isinstance(out, View) else out

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


# -- the flagship: filter, generate, collapse


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = opened(spark, sf_dir, "lineitem", "l_orderkey l_quantity l_extendedprice l_discount l_returnflag l_linestatus")
    v = C.gen(C.keep_if(v, "l_quantity > 10"), "rev", "l_extendedprice * (1 - l_discount)", "double")
    v = A.collapse(v, "(sum) rev (mean) l_quantity (count) n=l_orderkey", "l_returnflag l_linestatus")
    return rounded(v.sorted_df(), rev=2, l_quantity=6)


QUERIES["flagship"] = flagship
SQL["flagship"] = """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, round(avg(l_quantity), 6) AS l_quantity, count(l_orderkey) AS n
FROM lineitem WHERE l_quantity > 10 GROUP BY ALL"""

# -- rows and columns

query("keep_vars", "orders", "SELECT o_orderpriority, o_orderkey FROM orders")(lambda v: C.keep(v, "o_orderpr* o_orderkey"))
query("drop_vars", "nation", "SELECT n_nationkey FROM nation")(lambda v: C.drop(v, "n_name n_reg*"))
query("keep_if", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 25 AND l_returnflag <> 'R'", "l_orderkey l_linenumber l_quantity l_returnflag")(lambda v: C.keep_if(v, 'l_quantity > 25 & l_returnflag != "R"'))
query("drop_if", "part", "SELECT * FROM part WHERE NOT (p_retailprice < 1000)")(lambda v: C.drop_if(v, "p_retailprice < 1000"))
query("gen", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 2 + l_quantity / 3.0::DOUBLE, 6) AS x FROM lineitem", "l_orderkey l_linenumber l_extendedprice l_quantity")(
    lambda v: rounded(C.keep(C.gen(v, "x", "l_extendedprice * 2 + l_quantity / 3"), "l_orderkey l_linenumber x").df, x=6)
)
for _t, _lo, _hi, _sql in (("byte", -127, 100, "TINYINT"), ("int", -32767, 32740, "SMALLINT"), ("long", -2147483647, 2147483620, "INTEGER")):
    query(f"gen_typed_{_t}", "customer", f"SELECT c_custkey, CASE WHEN trunc(c_acctbal * 3) BETWEEN {_lo} AND {_hi} THEN trunc(c_acctbal * 3)::{_sql} END AS x FROM customer", "c_custkey c_acctbal")(
        lambda v, _t=_t: C.keep(C.gen(v, "x", "c_acctbal * 3", _t), "c_custkey x")
    )
query("gen_if", "part", "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size::DOUBLE END AS x FROM part", "p_partkey p_size")(lambda v: C.keep(C.gen(v, "x", "p_size", condition="p_size > 10"), "p_partkey x"))
query("replace_if", "part", "SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS p_size FROM part", "p_partkey p_size")(lambda v: C.replace(v, "p_size", ".", "p_size > 40"))
query("replace_whole", "part", "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size * 2::BIGINT + 1 ELSE p_size::BIGINT END AS p_size FROM part", "p_partkey p_size")(lambda v: C.replace(v, "p_size", "p_size * 2 + 1", "p_size > 40"))
query("replace_half", "part", "SELECT p_partkey, p_size / 2.0::DOUBLE AS p_size FROM part", "p_partkey p_size")(lambda v: C.replace(v, "p_size", "p_size / 2"))
query("rename", "region", "SELECT r_regionkey AS k, r_name FROM region")(lambda v: C.rename(v, "r_regionkey", "k"))
query("rename_group", "nation", "SELECT n_regionkey AS n_nationkey, n_name, n_nationkey AS n_regionkey FROM nation")(lambda v: C.rename(v, "n_nationkey n_regionkey", "n_regionkey n_nationkey"))
query("order", "nation", "SELECT n_name, n_nationkey, n_regionkey FROM nation")(lambda v: C.order(v, "n_name"))
query("keep_in", "orders", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100)", "o_orderkey o_totalprice")(lambda v: C.keep_in(C.sort(v, "o_orderkey"), 101, 150))
query("row_number_n", "orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::DOUBLE AS r FROM orders", "o_orderkey o_totalprice")(lambda v: C.keep(C.gen(C.gsort(v, "-o_totalprice o_orderkey"), "r", "_n"), "o_orderkey r"))
query("count_N", "nation", "SELECT n_nationkey, count(*) OVER ()::DOUBLE AS n FROM nation", "n_nationkey")(lambda v: C.gen(v, "n", "_N"))
query("gsort_head", "part", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10", "p_partkey p_retailprice")(lambda v: C.head(C.gsort(v, "-p_retailprice +p_partkey"), 10))
query("list_if", "supplier", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000 ORDER BY s_suppkey LIMIT 200", "s_suppkey s_acctbal")(lambda v: C.rows(C.sort(v, "s_suppkey"), condition="s_acctbal > 5000"))
query("query_fragment", "part", "SELECT * FROM part WHERE p_size BETWEEN 3 AND 9")(lambda v: C.query(v, "WHERE p_size BETWEEN 3 AND 9"))
query("query_qualify", "part", "SELECT p_partkey, p_brand, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3", "p_partkey p_brand p_retailprice")(
    lambda v: C.query(v, "QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
)
query(
    "sample", "orders",
    """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (ORDER BY ('0x' || substr(md5('3|' || o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 1, 15))::BIGINT) <= floor(0.5 + (SELECT count(*) FROM orders) * 0.1)""",
    "o_orderkey o_custkey o_orderstatus",
)(lambda v: C.sample(v, 10, seed=3))
query("dates_boundary", "lineitem", "SELECT l_orderkey, l_linenumber, (epoch_ms(l_shipdate) + 315619200000)::BIGINT AS l_shipdate FROM lineitem", "l_orderkey l_linenumber l_shipdate")(lambda v: v)

# -- aggregation

for _s, _q in {
    "mean": "round(avg(l_extendedprice), 6)", "sd": "round(stddev_samp(l_extendedprice), 6)", "sum": "round(coalesce(sum(l_extendedprice), 0), 2)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)",
}.items():
    query(f"collapse_{_s}", "lineitem", f"SELECT l_returnflag, l_shipmode AS m, {_q} AS x FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL", "l_returnflag l_linestatus l_extendedprice")(
        lambda v, _s=_s: rounded(A.collapse(C.rename(v, "l_linestatus", "m"), f"({_s}) x=l_extendedprice", "l_returnflag m").df, x={"sum": 2}.get(_s, 6))
    )
query("collapse_count", "orders", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1", "o_orderpriority o_totalprice")(lambda v: A.collapse(v, "(count) n=o_totalprice", "o_orderpriority"))
_PCT = """WITH s AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS a FROM lineitem GROUP BY 1), n AS (SELECT *, len(a) AS c FROM s)
SELECT l_suppkey, {} FROM n"""
_AT = "CASE WHEN c * {p} % 100 = 0 THEN (a[greatest(c * {p} // 100, 1)] + a[least(c * {p} // 100 + 1, c)]) / 2 ELSE a[c * {p} // 100 + 1] END AS {n}"
query("collapse_percentiles", "lineitem", _PCT.format(", ".join(_AT.format(p=p, n=n) for p, n in ((50, "m"), (25, "q"), (90, "t")))), "l_suppkey l_quantity")(lambda v: A.collapse(v, "(median) m=l_quantity (p25) q=l_quantity (p90) t=l_quantity", "l_suppkey"))
query(
    "collapse_first_last", "orders",
    """SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS f, arg_max(o_orderpriority, o_orderkey) AS l, arg_min(x, o_orderkey) AS fn, arg_max(x, o_orderkey) AS ln
FROM (SELECT *, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS x FROM orders) GROUP BY 1""",
    "o_custkey o_orderkey o_orderstatus o_orderpriority o_totalprice",
)(lambda v: A.collapse(C.gen(C.sort(v, "o_orderkey"), "x", "o_totalprice", condition="o_totalprice > 50000"), "(first) f=o_orderstatus (last) l=o_orderpriority (firstnm) fn=x (lastnm) ln=x", "o_custkey"))
query("contract", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS _freq FROM lineitem GROUP BY ALL", "l_returnflag l_linestatus")(lambda v: A.contract(v, "l_returnflag l_linestatus"))
query("duplicates_drop", "orders", "SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, (epoch_ms(o_orderdate) + 315619200000)::BIGINT AS o_orderdate, o_orderpriority FROM orders")(lambda v: A.duplicates_drop(T.append(v, C.keep_if(v, "mod(o_custkey, 3) == 0"))))
query("duplicates_drop_some", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", "l_returnflag l_linestatus l_linenumber")(A.duplicates_drop)
query("duplicates_drop_by", "orders", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", "o_custkey o_orderkey")(lambda v: A.duplicates_drop(C.sort(v, "o_orderkey"), "o_custkey", force=True))
for _s, _q in {"total": "coalesce(sum(x), 0)", "mean": "avg(x)", "sd": "stddev_samp(x)", "min": "min(x)", "max": "max(x)", "count": "count(x)::DOUBLE"}.items():
    query(f"egen_{_s}", "customer", f"SELECT c_custkey, round(e, 4) AS e FROM customer JOIN (SELECT c_nationkey, {_q} AS e FROM (SELECT *, c_acctbal AS x FROM customer) GROUP BY 1) USING (c_nationkey)", "c_custkey c_nationkey c_acctbal")(
        lambda v, _s=_s: rounded(C.keep(A.egen(v, "e", _s, "c_acctbal", "c_nationkey"), "c_custkey e").df, e=4)
    )
query("pivot", "lineitem", "SELECT l_linestatus, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS qA, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS qN, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS qR FROM lineitem GROUP BY 1", "l_linestatus l_returnflag l_quantity")(
    lambda v: rounded(R.pivot(v, "(mean) q=l_quantity", "l_linestatus", "l_returnflag").df, qA=6, qN=6, qR=6)
)

# -- two tables

_ORDERS, _CUSTOMERS = ("orders", "o_orderkey o_custkey o_totalprice"), ("customer", "c_custkey c_name c_mktsegment")
_CU = lambda c: C.rename(c, "c_custkey", "o_custkey")
_FULL = """SELECT coalesce(o.o_custkey, c.c_custkey) AS o_custkey, o_orderkey, o_totalprice, {cols}
(CASE WHEN o.o_custkey IS NULL THEN 2 WHEN c.c_custkey IS NULL THEN 1 ELSE 3 END)::TINYINT AS _merge FROM orders o {join} customer c ON o.o_custkey = c.c_custkey {where}"""
query2("merge_m_1", (_ORDERS, _CUSTOMERS), _FULL.format(cols="coalesce(c_name, '') AS c_name, coalesce(c_mktsegment, '') AS c_mktsegment,", join="FULL JOIN", where=""))(lambda o, c: T.merge(o, "m:1", "o_custkey", _CU(c)))
query2("merge_keep_match", (_ORDERS, _CUSTOMERS), _FULL.format(cols="c_name, c_mktsegment,", join="JOIN", where=""))(lambda o, c: T.merge(o, "m:1", "o_custkey", _CU(c), keep="match"))
query2("merge_keep_master", (_ORDERS, _CUSTOMERS), _FULL.format(cols="coalesce(c_name, '') AS c_name,", join="LEFT JOIN", where="WHERE c.c_custkey IS NULL"))(lambda o, c: T.merge(o, "m:1", "o_custkey", _CU(C.keep_if(c, "c_custkey > -1")), keep="master", keepusing="c_name"))
query2("merge_keep_using", (_ORDERS, _CUSTOMERS), _FULL.format(cols="coalesce(c_name, '') AS c_name,", join="RIGHT JOIN", where="WHERE o.o_custkey IS NULL"))(lambda o, c: T.merge(o, "m:1", "o_custkey", _CU(c), keep="using", keepusing="c_name"))
query2("merge_keepusing", (_ORDERS, _CUSTOMERS), _FULL.format(cols="coalesce(c_mktsegment, '') AS c_mktsegment,", join="LEFT JOIN", where=""))(lambda o, c: T.merge(o, "m:1", "o_custkey", _CU(c), keep="match master", keepusing="c_mktsegment"))
query2("merge_1_m", (("nation", ""), ("customer", "c_custkey c_nationkey")), "SELECT n_nationkey, n_name, n_regionkey, c_custkey, (CASE WHEN c_custkey IS NULL THEN 1 ELSE 3 END)::TINYINT AS _merge FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey")(
    lambda n, c: T.merge(n, "1:m", "n_nationkey", C.rename(c, "c_nationkey", "n_nationkey"))
)
query2("merge_1_1", (("documents", "doc_id source"), ("labels", "")), "SELECT doc_id, coalesce(source, '') AS source, quality, toxic, (CASE WHEN l.doc_id IS NULL THEN 1 WHEN d.doc_id IS NULL THEN 2 ELSE 3 END)::TINYINT AS _merge FROM documents d FULL JOIN labels l USING (doc_id)")(
    lambda d, u: T.merge(d, "1:1", "doc_id", u)
)
query2(
    "merge_missing_keys", (("nation", "n_nationkey n_name"), ("region", "")),
    """WITH m AS (SELECT CASE WHEN n_nationkey > 22 THEN NULL ELSE n_nationkey::DOUBLE END AS k, n_name FROM nation), u AS (SELECT CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey::DOUBLE END AS k, r_name FROM region)
SELECT m.k, n_name, r_name FROM m JOIN u ON m.k IS NOT DISTINCT FROM u.k""",
)(lambda n, r: T.merge(C.rename(C.replace(n, "n_nationkey", ".", "n_nationkey > 22"), "n_nationkey", "k"), "m:1", "k", C.rename(C.replace(r, "r_regionkey", ".", "r_regionkey == 4"), "r_regionkey", "k"), keep="match", nogenerate=True))
query2("joinby", (("supplier", "s_suppkey s_nationkey"), ("customer", "c_custkey c_nationkey")), "SELECT s_suppkey, s_nationkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")(lambda s, c: T.joinby(s, "s_nationkey", C.rename(c, "c_nationkey", "s_nationkey")))
query2("append", (("supplier", "s_suppkey s_name"), ("customer", "c_custkey c_name c_acctbal")), "SELECT s_suppkey, s_name, NULL::DOUBLE AS c_acctbal FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")(lambda s, c: T.append(s, C.rename(c, "c_custkey c_name", "s_suppkey s_name")))
query2("append_generate", (("region", ""), ("region", "r_regionkey")), "SELECT r_regionkey, r_name, 0::TINYINT AS src FROM region UNION ALL SELECT r_regionkey, '', 1::TINYINT FROM region")(lambda a, b: T.append(a, b, generate="src"))

# -- reshape

query("reshape_long", "part", "SELECT p_partkey, j, CASE j WHEN 1 THEN p_size::DOUBLE ELSE p_retailprice END AS v FROM part, (VALUES (1), (2)) t(j)", "p_partkey p_size p_retailprice")(lambda v: R.reshape_long(C.rename(v, "p_size p_retailprice", "v1 v2"), "v", "p_partkey", "j"))
query("reshape_long_zeros", "part", "SELECT p_partkey, j, CASE j WHEN 1 THEN p_size::DOUBLE END AS v, p_retailprice AS v02, p_name AS vx FROM part, (VALUES (1), (2)) t(j)", "p_partkey p_size p_retailprice p_name")(
    lambda v: R.reshape_long(C.rename(v, "p_size p_retailprice p_name", "v1 v02 vx"), "v", "p_partkey", "j")
)
query(
    "reshape_long_two", "part",
    "SELECT p_partkey, j, CASE j WHEN 'a' THEN p_size::DOUBLE ELSE p_retailprice END AS x, CASE j WHEN 'a' THEN p_brand ELSE p_type END AS y, p_name FROM part, (VALUES ('a'), ('b')) t(j)",
    "p_partkey p_size p_retailprice p_brand p_type p_name",
)(lambda v: R.reshape_long(C.rename(v, "p_size p_retailprice p_brand p_type", "xa xb ya yb"), "x y", "p_partkey", "j"))
_COUNTS = ", ".join(f"nullif(count(*) FILTER (WHERE l_linenumber = {k}), 0) AS n{k}" for k in range(1, 8))
query("reshape_wide", "lineitem", f"SELECT l_suppkey, {_COUNTS} FROM lineitem GROUP BY 1", "l_suppkey l_linenumber")(
    lambda v: R.reshape_wide(C.rename(A.contract(v, "l_suppkey l_linenumber"), "_freq", "n"), "n", "l_suppkey", "l_linenumber")
)

# -- statistics

_SUM = "SELECT '{0}' AS variable, count({0}) AS n, round(avg({0}), 5) AS mean, round(stddev_samp({0}), 5) AS sd, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max FROM lineitem"
_NUMBERS = "l_partkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
query("summarize", "lineitem", " UNION ALL ".join(_SUM.format(n) for n in _NUMBERS.split()), _NUMBERS)(lambda v: rounded(X.summarize(v), mean=5, sd=5))
_M = "avg(pow(x - m, {}))"
_DETAIL = f"""SELECT * FROM (WITH b AS (SELECT {{0}}::DOUBLE AS x, avg({{0}}) OVER () AS m FROM lineitem), l AS (SELECT list_sort(list(x)) AS a, count(*) AS c FROM b)
SELECT '{{0}}' AS variable, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, min(x) AS min, max(x) AS max, round(var_samp(x), 3) AS variance,
round({_M.format(3)} / pow({_M.format(2)}, 1.5), 4) + 0.0::DOUBLE AS skewness, round({_M.format(4)} / pow({_M.format(2)}, 2), 4) AS kurtosis,
{", ".join(f"(SELECT CASE WHEN c * {p} % 100 = 0 THEN (a[greatest(c * {p} // 100, 1)] + a[least(c * {p} // 100 + 1, c)]) / 2 ELSE a[c * {p} // 100 + 1] END FROM l) AS p{p}" for p in X.DETAIL)} FROM b)"""
query("summarize_detail", "lineitem", " UNION ALL ".join(_DETAIL.format(n) for n in ("l_linenumber", "l_quantity", "l_tax")), "l_linenumber l_quantity l_tax")(
    lambda v: rounded(X.summarize_detail(v), mean=4, sd=4, variance=3, skewness=4, kurtosis=4)
)
query("tabulate", "orders", "SELECT o_orderstatus AS value, count(*) AS freq, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent, round(100.0 * sum(count(*)) OVER (ORDER BY o_orderstatus) / sum(count(*)) OVER (), 6)::DOUBLE AS cum FROM orders GROUP BY o_orderstatus", "o_orderstatus")(
    lambda v: rounded(X.tabulate(v, "o_orderstatus"), percent=6, cum=6)
)
query("tabulate_two", "lineitem", "SELECT l_returnflag AS row, l_linestatus AS col, count(*) AS freq, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6)::DOUBLE AS row_percent, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 6)::DOUBLE AS col_percent FROM lineitem GROUP BY l_returnflag, l_linestatus", "l_returnflag l_linestatus")(
    lambda v: rounded(X.tabulate_two(v, "l_returnflag", "l_linestatus"), row_percent=6, col_percent=6)
)
query("tabulate_totals", "lineitem", "WITH t AS (SELECT coalesce(l_returnflag, 'Total') AS row, coalesce(l_linestatus, 'Total') AS col, count(*) AS freq FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)) SELECT t.row, t.col, t.freq, round(100.0 * t.freq / r.freq, 6)::DOUBLE AS row_percent, round(100.0 * t.freq / c.freq, 6)::DOUBLE AS col_percent FROM t JOIN t r ON r.row = t.row AND r.col = 'Total' JOIN t c ON c.col = t.col AND c.row = 'Total'", "l_returnflag l_linestatus")(
    lambda v: rounded(X.tabulate_two(v, "l_returnflag", "l_linestatus", totals=True), row_percent=6, col_percent=6)
)
_HOLES = "(SELECT CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS p_size, CASE WHEN p_retailprice > 1500 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part)"
_holes = lambda v: C.replace(C.replace(v, "p_size", ".", "p_size > 40"), "p_retailprice", ".", "p_retailprice > 1500")
_GAPS = "(SELECT CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS p_size, CASE WHEN p_retailprice > 1500 THEN '' ELSE p_brand END AS b, p_retailprice AS x FROM part)"
_gaps = lambda v: C.rename(C.gen(C.replace(v, "p_size", ".", "p_size > 40"), "b", "p_brand", condition="p_retailprice <= 1500"), "p_retailprice", "x")
query("collapse_missing_keys", "part", f"SELECT p_size, nullif(b, '') AS b, count(x) AS n, round(avg(x), 6) AS m FROM {_GAPS} GROUP BY ALL", "p_size p_brand p_retailprice")(lambda v: rounded(A.collapse(_gaps(v), "(count) n=x (mean) m=x", "p_size b").df, m=6))
query("contract_missing_keys", "part", f"SELECT p_size, nullif(b, '') AS b, count(*) AS _freq FROM {_GAPS} GROUP BY ALL", "p_size p_brand p_retailprice")(lambda v: A.contract(_gaps(v), "p_size b"))
_TWO = "SELECT p_size, p_partkey % 2 + 1 AS f, sum(x) AS x FROM (SELECT CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS p_size, p_partkey, p_retailprice AS x FROM part) GROUP BY ALL"
query("reshape_wide_missing_key", "part", f"SELECT p_size, round(max(x) FILTER (WHERE f = 1), 2) AS x1, round(max(x) FILTER (WHERE f = 2), 2) AS x2 FROM ({_TWO}) GROUP BY 1", "p_size p_partkey p_retailprice")(
    lambda v: rounded(R.reshape_wide(A.collapse(C.gen(C.rename(C.replace(v, "p_size", ".", "p_size > 40"), "p_retailprice", "x"), "f", "mod(p_partkey, 2) + 1"), "(sum) x", "p_size f"), "x", "p_size", "f").df, x1=2, x2=2)
)
query("misstable", "part", f"SELECT variable, n, round(100.0 * n / (SELECT count(*) FROM part), 6)::DOUBLE AS percent FROM (SELECT 'p_size' AS variable, count(*) FILTER (WHERE p_size IS NULL) AS n FROM {_HOLES} UNION ALL SELECT 'p_retailprice', count(*) FILTER (WHERE p_retailprice IS NULL) FROM {_HOLES} UNION ALL SELECT '_complete', count(*) FILTER (WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL) FROM {_HOLES})", "p_size p_retailprice")(
    lambda v: rounded(X.misstable(_holes(v)), percent=6)
)
query("misstable_patterns", "part", f"SELECT CASE WHEN p_size IS NULL THEN '.' ELSE '+' END || CASE WHEN p_retailprice IS NULL THEN '.' ELSE '+' END AS pattern, count(*) AS freq FROM {_HOLES} GROUP BY 1", "p_size p_retailprice")(lambda v: X.misstable_patterns(_holes(v)))
query("levelsof", "part", "SELECT DISTINCT p_size::VARCHAR AS level FROM part", "p_size")(lambda v: X.frame(v, [(x,) for x in X.levelsof(v, "p_size")], "level string"))
_BOOK = "SELECT '{0}' AS variable, '{1}' AS kind, count(*) AS n, 0::BIGINT AS missing, count(DISTINCT {0}) AS distinct, min({0})::{2}::VARCHAR AS min, max({0})::{2}::VARCHAR AS max, '' AS label FROM lineitem"
_BOOKED = (("l_linenumber", "numeric", "BIGINT"), ("l_quantity", "numeric", "BIGINT"), ("l_suppkey", "numeric", "BIGINT"), ("l_returnflag", "string", "VARCHAR"), ("l_linestatus", "string", "VARCHAR"))
query("codebook", "lineitem", " UNION ALL ".join(_BOOK.format(*b) for b in _BOOKED), " ".join(b[0] for b in _BOOKED))(X.codebook)
query("distinct", "orders", "SELECT 'o_custkey' AS variable, count(DISTINCT o_custkey) AS distinct FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders", "o_custkey o_orderstatus")(X.distinct)
query("distinct_joint", "orders", "SELECT 'o_custkey o_orderstatus' AS variable, count(*) AS distinct FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)", "o_custkey o_orderstatus")(lambda v: X.distinct(v, joint=True))
query("duplicates_report", "orders", "SELECT copies, (copies * count(*))::BIGINT AS observations, ((copies - 1) * count(*))::BIGINT AS surplus FROM (SELECT count(*) AS copies FROM orders GROUP BY o_custkey) GROUP BY copies", "o_custkey")(lambda v: X.duplicates_report(v, "o_custkey"))
query("duplicates_list", "customer", "SELECT c_custkey, c_nationkey FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) > 1 ORDER BY c_nationkey, c_custkey LIMIT 20", "c_custkey c_nationkey")(lambda v: X.duplicates_list(v, "c_nationkey"))
query("tabstat", "part", "SELECT 'p_size' AS variable, count(p_size)::DOUBLE AS n, round(avg(p_size), 6) AS mean, (max(p_size) - min(p_size))::DOUBLE AS range FROM part", "p_size")(lambda v: rounded(X.tabstat(v, "p_size", "n mean range"), mean=6))
_BY = "SELECT l_returnflag AS \"group\", list_sort(list(l_quantity)) AS a, count(*) AS c, sum(l_quantity) AS s FROM lineitem GROUP BY 1"
query("tabstat_percentiles", "lineitem", f"SELECT \"group\", 'l_quantity' AS variable, {', '.join(_AT.format(p=p, n=f'p{p}') for p in (5, 25, 75))}, {_AT.format(p=50, n='median')}, s AS sum FROM ({_BY})", "l_returnflag l_quantity")(
    lambda v: X.tabstat(v, "l_quantity", "p5 p25 p75 median sum", "l_returnflag")
)
query("tabstat_by", "customer", "SELECT c_mktsegment AS \"group\", 'c_acctbal' AS variable, round(avg(c_acctbal), 6) AS mean, round(var_samp(c_acctbal), 3) AS var FROM customer GROUP BY 1", "c_mktsegment c_acctbal")(lambda v: rounded(X.tabstat(v, "c_acctbal", "mean var", "c_mktsegment"), mean=6, var=3))
query("correlate", "lineitem", "SELECT r AS row, c AS col, round(x, 6) AS rho, n FROM (SELECT 'l_quantity' AS r, 'l_quantity' AS c, 1.0::DOUBLE AS x, count(*) AS n FROM lineitem UNION ALL SELECT 'l_tax', 'l_quantity', corr(l_tax, l_quantity), count(*) FROM lineitem UNION ALL SELECT 'l_tax', 'l_tax', 1.0, count(*) FROM lineitem)", "l_quantity l_tax")(
    lambda v: rounded(X.correlate(v, "l_quantity l_tax"), rho=6)
)
query(
    "pwcorr", "part",
    f"""SELECT 'p_retailprice' AS row, 'p_size' AS col, round(corr(p_size, p_retailprice), 6) AS rho, count(*) AS n, true AS told FROM {_HOLES} WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL
UNION ALL SELECT 'p_size', 'p_size', 1.0::DOUBLE, count(p_size), false FROM {_HOLES} UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1.0::DOUBLE, count(p_retailprice), false FROM {_HOLES}""",
    "p_size p_retailprice",
)(lambda v: rounded(X.pwcorr(_holes(v), "p_size p_retailprice").withColumn("told", F.col("sig").between(0, 1) & F.col("sig").isNotNull()).drop("sig"), rho=6))
query("histogram", "lineitem", "WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem), b AS (SELECT least(floor((l_extendedprice - lo) / w), 19)::INT AS bin, count(*) AS f FROM lineitem, s GROUP BY 1) SELECT k::INT AS bin, round(lo + k * w, 6) AS low, round(lo + (k + 1) * w, 6) AS high, coalesce(f, 0) AS freq FROM range(20) r(k) CROSS JOIN s LEFT JOIN b ON bin = k", "l_extendedprice")(
    lambda v: rounded(X.histogram(v, "l_extendedprice", 20), low=6, high=6)
)
query("count_if", "lineitem", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05", "l_quantity l_discount")(lambda v: C.keep_if(v, "l_quantity > 25 & l_discount < 0.05").df.agg(F.count(F.lit(1)).alias("n")))

# -- sources and sinks: written to the shared folder, opened again, held against the table that they came from


def stored_and_used(name: str, table: str, sql: str, cols: str = ""):
    """Register a function of (spark, the table's view, a new path) that writes and reads back."""

    def add(f):
        def run(spark, sf_dir):
            out = f(spark, opened(spark, sf_dir, table, cols), shared_path(spark, name))
            return out.sorted_df() if isinstance(out, View) else out

        QUERIES[name] = run
        SQL[name] = sql
        return f

    return add


def _saved(v: View, path: str, **options) -> str:
    save(v, path, **options)
    return path


_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, (epoch_ms(o_orderdate) + 315619200000)::BIGINT AS o_orderdate, o_orderpriority FROM orders"
stored_and_used("sink_parquet", "orders", _ORDERS_SQL)(lambda spark, v, path: use(spark, _saved(C.sort(v, "o_orderkey"), path, compression="zstd")))
stored_and_used("sink_partitioned", "orders", _ORDERS_SQL)(lambda spark, v, path: use(spark, _saved(v, path, partition_by="o_orderstatus")))
stored_and_used("sink_replaced", "orders", _ORDERS_SQL + " WHERE o_orderkey > 100")(lambda spark, v, path: use(spark, _saved(C.keep_if(v, "o_orderkey > 100"), _saved(v, path), replace=True)))
stored_and_used("sink_dates", "orders", "SELECT o_orderkey, date_diff('day', DATE '1960-01-01', o_orderdate::DATE)::INT AS d FROM orders", "o_orderkey o_orderdate")(
    lambda spark, v, path: C.keep(use(spark, _saved(C.fmt(C.gen(v, "d", "floor(o_orderdate / 86400000)"), "d", "%td"), path)), "o_orderkey d")
)
stored_and_used("source_pattern", "orders", _ORDERS_SQL + " UNION ALL " + _ORDERS_SQL)(lambda spark, v, path: use(spark, [_saved(v, f"{path}-a"), _saved(v, f"{path}-b")]))
stored_and_used("source_relaxed", "customer", "SELECT c_custkey, c_name, NULL::DOUBLE AS c_acctbal FROM customer UNION ALL SELECT c_custkey, '', c_acctbal FROM customer", "c_custkey c_name c_acctbal")(
    lambda spark, v, path: use(spark, [_saved(C.keep(v, "c_custkey c_name"), f"{path}-a"), _saved(C.keep(v, "c_custkey c_acctbal"), f"{path}-b")], relaxed=True)
)


@stored_and_used("source_csv", "customer", "SELECT c_custkey::INT AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _csv(spark: SparkSession, v: View, path: str) -> View:
    v.df.write.option("header", True).option("sep", ";").csv(f"{path}.csv")
    return use(spark, f"{path}.csv")


@stored_and_used("source_sql", "customer", "SELECT c_nationkey, count(*) AS n, sum(c_custkey)::BIGINT AS s FROM customer GROUP BY 1", "c_nationkey c_custkey")
def _sql_source(spark: SparkSession, v: View, path: str) -> View:
    name = "t" + path.rsplit("-", 1)[-1]
    v.df.createOrReplaceTempView(name)
    return Session(spark).sql(f"SELECT c_nationkey, count(*) AS n, sum(c_custkey) AS s FROM {name} GROUP BY c_nationkey")


@stored_and_used("source_view", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal > 0", "c_custkey c_acctbal")
def _view_source(spark: SparkSession, v: View, path: str) -> View:
    s = Session(spark)
    s.put(v, "first")
    s.keep_if("c_acctbal > 0")
    s.use("view:first", name="second")
    return s.keep("c_custkey")


@stored_and_used("source_dta", "nation", "SELECT n_nationkey::INT AS n_nationkey, n_name, n_regionkey::INT AS n_regionkey FROM nation")
def _dta(spark: SparkSession, v: View, path: str) -> View:
    with tempfile.TemporaryDirectory() as folder:  # the driver alone writes and reads it
        v.df.toPandas().astype({"n_nationkey": "int32", "n_regionkey": "int32"}).to_stata(f"{folder}/t.dta", write_index=False)
        return use(spark, f"{folder}/t.dta")


# -- the expression language: one query a group of functions, in both missing modes


def expressions(name: str, table: str, key: str, items: dict[str, tuple[str, str]], cols: str, prepare=lambda v: v, source: str = "", places: int = 8):
    def run(v: View) -> DataFrame:
        v = prepare(v)
        for n, (expression, _) in items.items():
            v = C.gen(v, n, expression)
        df = C.keep(v, " ".join([key, *items])).df
        return df.withColumns({n: F.round(F.col(n), places) for n in items if v.kinds[n] == "n"})

    texts = [f"round(({sql})::DOUBLE, {places}) AS {n}" if not sql.startswith("S:") else f"{sql[2:]} AS {n}" for n, (_, sql) in items.items()]
    query(name, table, f"SELECT {key}, {', '.join(texts)} FROM {source or table}", cols)(run)


expressions("expr_math", "customer", "c_custkey", {
    "a": ("abs(c_acctbal)", "abs(c_acctbal)"), "b": ("exp(c_acctbal/1000)", "exp(c_acctbal / 1000)"), "c": ("ln(c_acctbal)", "CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END"),
    "d": ("log10(c_acctbal)", "CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END"), "e": ("sqrt(c_acctbal)", "CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END"),
    "f": ("floor(c_acctbal)", "floor(c_acctbal)"), "g": ("ceil(c_acctbal)", "ceil(c_acctbal)"), "h": ("int(c_acctbal)", "trunc(c_acctbal)"),
    "i": ("round(c_acctbal, .5)", "floor(c_acctbal / .5::DOUBLE + .5::DOUBLE) * .5::DOUBLE"), "j": ("mod(c_custkey, 7)", "c_custkey % 7"), "k": ("min(c_acctbal, c_custkey, .)", "least(c_acctbal, c_custkey::DOUBLE)"),
    "l": ("max(c_acctbal, c_custkey)", "greatest(c_acctbal, c_custkey::DOUBLE)"), "m": ("c_custkey^2/(c_nationkey - 3)", "pow(c_custkey, 2) / nullif(c_nationkey - 3, 0)"), "n": ("-c_nationkey^2 + 2*3", "-pow(c_nationkey, 2) + 6"),
    "o": ("c_acctbal > 0 & c_nationkey != 3", "(c_acctbal > 0 AND c_nationkey <> 3)::INT"), "p": ("c_acctbal > 9000 | c_nationkey == 3", "(c_acctbal > 9000 OR c_nationkey = 3)::INT"),
    "q": ("!(c_nationkey >= 10) | !(c_acctbal < 0)", "(NOT (c_nationkey >= 10) OR NOT (c_acctbal < 0))::INT"), "r": ("1 - !c_nationkey * 2", "1 - (c_nationkey = 0)::INT * 2"),
}, "c_custkey c_acctbal c_nationkey", places=6)
_MISS = "(SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS x FROM customer)"
_miss = lambda v: C.rename(C.replace(v, "c_acctbal", ".", "c_acctbal < 0"), "c_acctbal", "x")
_items = {"a": ("x > 5000", "(x > 5000)::INT"), "b": ("x == .", "(x IS NULL)::INT"), "c": ("missing(x)", "(x IS NULL)::INT"), "d": ("inrange(x, 100, .)", "coalesce(x >= 100, false)::INT"), "e": ("inlist(c_custkey, 1, 5, .)", "(c_custkey IN (1, 5))::INT"), "f": ("cond(x > 5000, 1, 2)", "CASE WHEN x > 5000 THEN 1 WHEN NOT x > 5000 THEN 2 END"), "g": ("cond(x, 1, 2, 3)", "CASE WHEN x IS NULL THEN 3 WHEN x <> 0 THEN 1 ELSE 2 END")}
expressions("expr_missing", "customer", "c_custkey", _items, "c_custkey c_acctbal", _miss, _MISS)
_high = {"a": ("x > 5000", "(x IS NULL OR x > 5000)::INT"), "b": ("x < 99", "(x IS NOT NULL AND x < 99)::INT"), "c": ("x <= .", "1"), "d": ("x != 2", "(x IS DISTINCT FROM 2)::INT"), "e": ("x >= .", "(x IS NULL)::INT")}
expressions("expr_missing_high", "customer", "c_custkey", _high, "c_custkey c_acctbal", lambda v: View(**{**_miss(v).__dict__, "missing_high": True}), _MISS)
expressions("expr_strings", "part", "p_partkey", {
    "a": ("strlen(p_name)", "strlen(p_name)"), "b": ("ustrlen(p_name)", "length(p_name)"), "c": ("upper(p_name)", "S:upper(p_name)"), "d": ("lower(p_brand)", "S:lower(p_brand)"), "e": ("ustrupper(p_type)", "S:upper(p_type)"),
    "f": ('trim("  " + p_type + " ")', "S:p_type"), "g": ("substr(p_name, 2, 3)", "S:substr(p_name, 2, 3)"), "h": ("substr(p_name, -3, .)", "S:right(p_name, 3)"), "i": ('strpos(p_type, "a")', "instr(p_type, 'a')"),
    "j": ('subinstr(p_name, "a", "zz", .)', "S:replace(p_name, 'a', 'zz')"), "k": ('real(substr(p_brand, -2, .))', "try_cast(right(p_brand, 2) AS DOUBLE)"), "l": ('regexm(p_brand, "[[:digit:]]+$")', "regexp_matches(p_brand, '[0-9]+$')::INT"),
    "m": ("string(p_size)", "S:p_size::VARCHAR"), "n": ('ltrim("  x ") + rtrim("y  ")', "S:'x y'"), "o": ("p_name < p_type", "(p_name < p_type)::INT"), "q": ("ustrlower(p_brand)", "S:lower(p_brand)"),
}, "p_partkey p_name p_brand p_type p_size")
_D = "(o_orderdate::DATE)"
expressions("expr_dates", "orders", "o_orderkey", {
    "a": ("year(d0)", f"year({_D})"), "b": ("month(d0)", f"month({_D})"), "c": ("day(d0)", f"day({_D})"), "d": ("quarter(d0)", f"quarter({_D})"), "e": ("dow(d0)", f"dayofweek({_D})"), "f": ("doy(d0)", f"dayofyear({_D})"),
    "g": ("mdy(month(d0), 28, year(d0))", f"make_date(year({_D}), month({_D}), 28) - DATE '1960-01-01'"), "h": ("mofd(d0)", f"(year({_D}) - 1960) * 12 + month({_D}) - 1"), "i": ("dofm(mofd(d0))", f"date_trunc('month', {_D})::DATE - DATE '1960-01-01'"),
    "j": ("yofd(d0)", f"year({_D})"), "k": ("td(15mar1995) - d0", f"DATE '1995-03-15' - {_D}"), "l": ("tm(1995m3)", "422"), "m": ("tq(1995q2)", "141"), "n": ("th(1995h2)", "71"), "o": ("tw(1995w10)", "1829"), "p": ("ty(1995)", "1995"), "q": ("tc(1jan1960 00:00:01)", "1000"), "r": ("mdy(2, 30, 2020)", "NULL"), "s": ("tC(1jan1960 00:00:01)", "1000"),
}, "o_orderkey o_orderdate", lambda v: C.gen(v, "d0", "floor(o_orderdate/86400000)"))
