"""Exploration: small result tables, pushed down; none changes the view."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import VerbError
from ..plans.view import Meta, View
from .aggregate import aggregate, grouped, percentile_of, ranked_percentiles

DETAIL = (1, 5, 10, 25, 50, 75, 90, 95, 99)
MOST_ROWS, MOST_COLUMNS, MOST_LEVELS, MOST_GROUPS, MOST_BINS = 10_000, 30, 5_000, 200, 1_000


def frame(v: View, rows: list[tuple], schema: str) -> DataFrame:
    return v.df.sparkSession.createDataFrame(rows, schema)


def numbers(v: View, names: str = "") -> list[str]:
    got = v.expand(names) if names else v.names
    return [n for n in got if v.kinds[n] == "n"]


def there(v: View, n: str) -> Column:
    c = F.col(f"`{n}`")
    return F.coalesce(c != "", F.lit(False)) if v.kinds[n] == "s" else c.isNotNull()


def label_text(v: View, n: str) -> Column:
    """A value as text: whole numbers without a point."""
    c = F.col(f"`{n}`")
    if v.kinds[n] == "s":
        return c
    x = c.cast("double")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def summarize(v: View, names: str = "") -> DataFrame:
    """variable, n, mean, sd, min, max of each number, in one scan."""
    got = numbers(v, names)
    if not got:
        return frame(v, [], "variable string, n long, mean double, sd double, min double, max double")
    row = v.df.agg(*[f(F.col(f"`{n}`").cast("double")).alias(f"{k}_{i}") for i, n in enumerate(got) for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))]).first()
    return frame(v, [(n, *[row[f"{k}_{i}"] for k in ("n", "mean", "sd", "min", "max")]) for i, n in enumerate(got)], "variable string, n long, mean double, sd double, min double, max double")


def summarize_detail(v: View, names: str = "") -> DataFrame:
    """summarize and variance, skewness, kurtosis (of population moments, 3 for the normal) and nine percentiles."""
    got = numbers(v, names)
    schema = "variable string, n long, mean double, sd double, min double, max double, variance double, skewness double, kurtosis double, " + ", ".join(f"p{p} double" for p in DETAIL)
    if not got:
        return frame(v, [], schema)
    aggs = []
    for i, n in enumerate(got):
        x = F.col(f"`{n}`").cast("double")
        for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max), ("var", F.var_samp), ("skew", F.skewness), ("kurt", F.kurtosis)):
            aggs.append(f(x).alias(f"{k}_{i}"))
    row = v.df.agg(*aggs).first()
    # all variables' percentiles in one scan
    ranks = ranked_percentiles(v.df, [], got, [(f"p{q}_{i}", n, float(q)) for i, n in enumerate(got) for q in DETAIL]).first()
    rows = []
    for i, n in enumerate(got):
        kurt = row[f"kurt_{i}"]
        rows.append((n, *[row[f"{k}_{i}"] for k in ("n", "mean", "sd", "min", "max", "var", "skew")], None if kurt is None else kurt + 3, *[ranks[f"p{q}_{i}"] for q in DETAIL]))
    return frame(v, rows, schema)


def tabulate(v: View, name: str, missing: bool = False) -> DataFrame:
    """value, freq, percent, cum; at most 10,000 values."""
    n = v.expand(name, wild=False)[0]
    df = v.df if missing else v.df.where(there(v, n))
    per = df.groupBy(v.key(n).alias(n)).agg(F.count(F.lit(1)).alias("freq")).limit(MOST_ROWS + 1).collect()
    if len(per) > MOST_ROWS:
        raise VerbError(f"{n} has more than {MOST_ROWS} values", 134)
    small = frame(v, [(r[0], r[1]) for r in per], f"`{n}` {v.type_of(n).simpleString()}, freq long")
    total = sum(r[1] for r in per)
    w = Window.orderBy(F.col(f"`{n}`").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return small.select(F.coalesce(label_text(v, n), F.lit("." if v.kinds[n] == "n" else "")).alias("value"), "freq", (F.col("freq") * 100.0 / F.lit(max(total, 1))).alias("percent"), (F.sum("freq").over(w) * 100.0 / F.lit(max(total, 1))).alias("cum"))


def tabulate_two(v: View, a: str, b: str, missing: bool = False, totals: bool = False) -> DataFrame:
    """row, col, freq, and each cell's share of its row and column, in percent; with totals also rows and columns named Total."""
    a, b = v.expand(a, wild=False)[0], v.expand(b, wild=False)[0]
    df = v.df if missing else v.df.where(there(v, a) & there(v, b))
    none = {"n": ".", "s": ""}
    cells = df.groupBy(F.coalesce(label_text(v, a), F.lit(none[v.kinds[a]])).alias("row"), F.coalesce(label_text(v, b), F.lit(none[v.kinds[b]])).alias("col")).agg(F.count(F.lit(1)).alias("freq")).limit(MOST_ROWS + 1).collect()
    if len(cells) > MOST_ROWS:
        raise VerbError(f"more than {MOST_ROWS} cells", 134)
    if len({r["col"] for r in cells}) > MOST_COLUMNS:
        raise VerbError(f"{b} has more than {MOST_COLUMNS} values", 134)
    rows: dict[str, int] = {}
    cols: dict[str, int] = {}
    for r in cells:
        rows[r["row"]] = rows.get(r["row"], 0) + r["freq"]
        cols[r["col"]] = cols.get(r["col"], 0) + r["freq"]
    told = [(r["row"], r["col"], r["freq"], 100.0 * r["freq"] / rows[r["row"]], 100.0 * r["freq"] / cols[r["col"]]) for r in cells]
    if totals and told:
        whole = sum(rows.values())
        told += [*[(r, "Total", n, 100.0, 100.0 * n / whole) for r, n in rows.items()], *[("Total", c, n, 100.0 * n / whole, 100.0) for c, n in cols.items()], ("Total", "Total", whole, 100.0, 100.0)]
    return frame(v, told, "row string, col string, freq long, row_percent double, col_percent double")


def misstable(v: View, names: str = "") -> DataFrame:
    """variable, missing, percent; the row _complete counts rows without any missing value."""
    got = v.expand(names) if names else v.names
    whole = there(v, got[0])
    for n in got[1:]:
        whole = whole & there(v, n)
    row = v.df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(whole, 1)).alias("c"), *[F.count(F.when(~there(v, n), 1)).alias(f"m{i}") for i, n in enumerate(got)]).first()
    total = max(row["n"], 1)
    return frame(v, [*[(n, row[f"m{i}"], 100.0 * row[f"m{i}"] / total) for i, n in enumerate(got)], ("_complete", row["c"], 100.0 * row["c"] / total)], "variable string, n long, percent double")


def misstable_patterns(v: View, names: str = "") -> DataFrame:
    """pattern (+ there, . missing, by variable), freq; the hundred most frequent."""
    got = v.expand(names) if names else v.names
    if len(got) > 14:
        raise VerbError("patterns of at most 14 variables")
    pattern = F.concat(*[F.when(there(v, n), "+").otherwise(".") for n in got])
    return v.df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "pattern").limit(100)


def levelsof(v: View, name: str, limit: int = MOST_LEVELS) -> list[str]:
    n = v.expand(name, wild=False)[0]
    got = v.df.where(there(v, n)).select(F.col(f"`{n}`").alias("k")).distinct().orderBy("k").limit(limit + 1)
    rows = [r["t"] for r in got.select("k", _text("k", v.kinds[n]).alias("t")).orderBy("k").collect()]
    if len(rows) > limit:
        raise VerbError(f"{n} has more than {limit} values", 134)
    return rows


def _text(n: str, kind: str) -> Column:
    x = F.col(n)
    return x if kind == "s" else F.when((x == F.floor(x.cast("double"))) & (F.abs(x.cast("double")) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def codebook(v: View, names: str = "") -> DataFrame:
    """variable, kind, n, missing, distinct, min, max (as text), label, in one scan."""
    got = v.expand(names) if names else v.names
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, n in enumerate(got):
        c = F.when(there(v, n), F.col(f"`{n}`"))
        aggs += [F.count(c).alias(f"c{i}"), F.count_distinct(c).alias(f"d{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    row = v.df.agg(*aggs).first()

    def text(x, n):
        return None if x is None else x if v.kinds[n] == "s" else str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else str(float(x))

    return frame(v, [(n, {"n": "numeric", "s": "string"}[v.kinds[n]], row["n"], row["n"] - row[f"c{i}"], row[f"d{i}"], text(row[f"lo{i}"], n), text(row[f"hi{i}"], n), v.meta.get(n, Meta()).label) for i, n in enumerate(got)], "variable string, kind string, n long, missing long, distinct long, min string, max string, label string")


def distinct(v: View, names: str = "", joint: bool = False) -> DataFrame:
    """variable, distinct: nonmissing values of each, or complete tuples of all."""
    got = v.expand(names) if names else v.names
    if joint:
        df = v.df
        for n in got:
            df = df.where(there(v, n))
        return df.select(*[F.col(f"`{n}`") for n in got]).distinct().agg(F.count(F.lit(1)).alias("distinct")).select(F.lit(" ".join(got)).alias("variable"), "distinct")
    row = v.df.agg(*[F.count_distinct(F.when(there(v, n), F.col(f"`{n}`"))).alias(f"d{i}") for i, n in enumerate(got)]).first()
    return frame(v, [(n, row[f"d{i}"]) for i, n in enumerate(got)], "variable string, distinct long")


def duplicates_report(v: View, names: str = "") -> DataFrame:
    """copies, observations, surplus."""
    got = v.expand(names) if names else v.names
    per = v.df.groupBy(*[v.key(n).alias(f"k{i}") for i, n in enumerate(got)]).agg(F.count(F.lit(1)).alias("copies"))
    return per.groupBy("copies").agg(F.count(F.lit(1)).alias("g")).select("copies", (F.col("copies") * F.col("g")).alias("observations"), ((F.col("copies") - 1) * F.col("g")).alias("surplus"))


def duplicates_list(v: View, names: str, limit: int | None = 20) -> DataFrame:
    """Rows of groups with more than one, ordered by the keys."""
    got = v.expand(names)
    keys = [v.key(n).alias(f"__k{i}") for i, n in enumerate(got)]
    twice = v.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    df = v.df.select("*", *keys)
    both = df.join(twice.toDF(*[f"__j{i}" for i in range(len(got))], "__n"), [df[f"__k{i}"].eqNullSafe(F.col(f"__j{i}")) for i in range(len(got))], "left_semi")
    out = both.orderBy(*[F.col(f"__k{i}").asc_nulls_last() for i in range(len(got))], *[F.col(f"`{n}`").asc_nulls_last() for n in v.names]).select(*[F.col(f"`{n}`") for n in v.names])
    return out if limit is None else out.limit(limit)


def tabstat(v: View, names: str, stats: str = "mean", by: str = "") -> DataFrame:
    """(group,) variable and a column a statistic; a missing group is left out."""
    got, wanted = numbers(v, names), stats.split()
    if not got:
        raise VerbError("tabstat takes numbers", 111)

    def one(n: str, s: str) -> Column:
        x = F.col(f"`{n}`").cast("double")
        if s in ("n", "count"):
            return F.count(x).cast("double")
        if s == "var":
            return F.var_samp(x)
        if s == "range":
            return F.max(x) - F.min(x)
        if s not in ("mean", "sd", "sum", "min", "max"):
            raise VerbError(f"unknown statistic {s}")
        return aggregate(v, s, n).cast("double")

    cells = [(f"s{i}_{k}", n, s) for i, n in enumerate(got) for k, s in enumerate(wanted)]
    aggs = [one(n, s).alias(c) for c, n, s in cells if percentile_of(s) is None]
    ranked = [(c, n, percentile_of(s)) for c, n, s in cells if percentile_of(s) is not None]
    df, keys = v.df, []
    if by:
        g = v.expand(by, wild=False)[0]
        df, keys = df.where(there(v, g)).withColumn("__group", label_text(v, g)), ["__group"]
        if df.select("__group").distinct().limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
            raise VerbError(f"{g} has more than {MOST_GROUPS} values", 134)
    out = grouped(df, keys, aggs, ranked)
    lines = [F.struct(F.lit(n).alias("variable"), *[F.col(f"s{i}_{k}").alias(s) for k, s in enumerate(wanted)]) for i, n in enumerate(got)]
    group = [F.col("__group").alias("group")] if by else []
    return out.select(*group, F.explode(F.array(*lines)).alias("s")).select(*(["group"] if by else []), "s.*")


def _corr(a: Column, b: Column) -> Column:
    """Pearson's r; missing for a constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlate(v: View, names: str) -> DataFrame:
    """row, col, rho, n of complete cases: the lower triangle."""
    got = numbers(v, names)
    df = v.df
    for n in got:
        df = df.where(there(v, n))
    pairs = [(a, b) for i, a in enumerate(got) for b in got[: i + 1]]
    x = {n: F.col(f"`{n}`").cast("double") for n in got}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[_corr(x[a], x[b]).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]).first()
    return frame(v, [(a, b, row[f"r{k}"], row["n"]) for k, (a, b) in enumerate(pairs)], "row string, col string, rho double, n long")


def pwcorr(v: View, names: str) -> DataFrame:
    """row, col, rho, n, sig of the rows where both are there."""
    got = numbers(v, names)
    pairs = [(a, b) for i, a in enumerate(got) for b in got[: i + 1]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        ok = there(v, a) & there(v, b)
        x, y = F.when(ok, F.col(f"`{a}`").cast("double")), F.when(ok, F.col(f"`{b}`").cast("double"))
        aggs += [F.count(x).alias(f"n{k}"), _corr(x, y).alias(f"r{k}")]
    row = v.df.agg(*aggs).first()
    return frame(v, [(a, b, row[f"r{k}"], row[f"n{k}"], significance(row[f"r{k}"], row[f"n{k}"]) if a != b else None) for k, (a, b) in enumerate(pairs)], "row string, col string, rho double, n long, sig double")


def significance(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation by Student's t."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or 1e-300)
        c = (1 + term / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def histogram(v: View, name: str, bins: int | None = None) -> DataFrame:
    """bin, low, high, freq; as many bins as the root of n (50 at most) unless given."""
    n = v.expand(name, wild=False)[0]
    if v.kinds[n] == "s":
        raise VerbError("histogram takes a number", 109)
    if bins is not None and not 1 <= bins <= MOST_BINS:
        raise VerbError(f"bins() takes 1 to {MOST_BINS}")
    x = F.col(f"`{n}`").cast("double")
    row = v.df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if not row["n"]:
        raise VerbError("no observations", 2000)
    lo, hi = row["lo"], row["hi"]
    k = 1 if lo == hi else bins or min(math.ceil(math.sqrt(row["n"])), 50)
    width = (hi - lo) / k or 1.0
    at = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(k - 1)).cast("int")
    per = {r["b"]: r["f"] for r in v.df.where(x.isNotNull()).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("f")).collect()}
    return frame(v, [(b, lo + b * width, lo + (b + 1) * width, per.get(b, 0)) for b in range(k)], "bin int, low double, high double, freq long")


def describe(v: View) -> DataFrame:
    return frame(v, [(n, v.kinds[n], v.type_of(n).simpleString(), v.meta.get(n, Meta()).fmt, v.meta.get(n, Meta()).label) for n in v.names], "variable string, kind string, type string, fmt string, label string")


def lookfor(v: View, words: str) -> list[str]:
    wanted = words.lower().split()
    return [n for n in v.names if any(w in n.lower() or w in v.meta.get(n, Meta()).label.lower() for w in wanted)]
