"""reshape long, reshape wide, pivot."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..errors import VerbError
from ..plans.view import Meta, View
from ..sources.names import is_name, valid_name
from .aggregate import collapse

MOST_VALUES = 2_000
NUMBER = re.compile("[0-9]+")


def _identify(v: View, keys: list[str], what: str) -> None:
    twice = v.df.groupBy(*[v.key(k).alias(f"k{n}") for n, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if twice.count():
        raise VerbError(f"{what} does not identify the rows", 9)


def reshape_long(v: View, stubs: str, i: str, j: str) -> View:
    """One row for each suffix of the stubs: explode of one array of structs, so the table is read once.

    If any suffix is a number, j is one, and a column is a value only if its suffix is the number's
    plain spelling: x01 says that j = 1 exists but is carried as it is.  Every stub needs a column
    for every value of j (or, of a number, one spelled with leading zeros: its values are missing).
    """
    roots, ids = stubs.split(), v.expand(i, wild=False)
    valid_name(j)
    if j in v.names or not roots:
        raise VerbError(f"variable {j} already defined" if roots else "no stubs are named", 110)
    suffixes: dict[str, list[str]] = {}
    for r in roots:
        if r in v.names:
            raise VerbError(f"variable {r} already defined", 110)
        suffixes[r] = [n[len(r) :] for n in v.names if n.startswith(r) and n != r and n not in ids]
    every = {x for found in suffixes.values() for x in found}
    if not every:
        raise VerbError(f"no variables begin with {stubs}", 111)
    numbers = sorted({int(x) for x in every if NUMBER.fullmatch(x)})
    values: list = numbers or sorted(every)
    for r in roots:
        there = {int(x) if numbers else x for x in suffixes[r] if not numbers or NUMBER.fullmatch(x)}
        lacking = [x for x in values if x not in there]
        if lacking:
            raise VerbError(f"variable {r}{lacking[0]} is missing: every stub needs every value of {j}", 111)
    _identify(v, ids, i)
    used = {f"{r}{x}": r for r in roots for x in values if f"{r}{x}" in v.names and f"{r}{x}" not in ids}
    kinds: dict[str, str] = {}
    for n, r in used.items():
        if kinds.setdefault(r, v.kinds[n]) != v.kinds[n]:
            raise VerbError(f"{r}* are strings and numbers", 198)
    rest = [n for n in v.names if n not in used and n not in ids]
    cells = []
    for x in values:
        fields = [F.lit(x).cast("string" if not numbers else "int" if values[-1] < 2**31 else "double").alias(j)]
        for r in roots:
            n, string = f"{r}{x}", kinds.get(r) == "s"
            t = "string" if string else "double"
            fields.append((F.col(f"`{n}`").cast(t) if n in used else F.lit("" if string else None).cast(t)).alias(r))
        cells.append(F.struct(*fields))
    out = v.df.withColumn("__c", F.explode(F.array(*cells))).select(*[F.col(f"`{n}`") for n in ids], *[F.col(f"__c.`{n}`").alias(n) for n in (j, *roots)], *[F.col(f"`{n}`") for n in rest])
    meta = {n: v.meta[n] for n in (*ids, *rest) if n in v.meta}
    meta |= {r: v.meta[f"{r}{values[0]}"] for r in roots if f"{r}{values[0]}" in v.meta}
    return v.then(out, f"reshape long {stubs}, i({i}) j({j})", order=tuple((n, False) for n in (*ids, j)), meta=meta)


def j_values(v: View, j: str) -> list:
    """The values of j, in order, as they become names."""
    t = v.kinds[j]
    if v.df.where(v.key(j).isNull()).limit(1).count():
        raise VerbError(f"{j} has missing values", 498)
    got = [r[0] for r in v.df.select(F.col(f"`{j}`")).distinct().limit(MOST_VALUES + 1).collect()]
    if len(got) > MOST_VALUES:
        raise VerbError(f"{j} has more than {MOST_VALUES} values", 134)
    return sorted(got) if t == "n" else sorted(got, key=lambda s: s.encode())


def name_of(x) -> str:
    return str(int(x)) if not isinstance(x, str) and float(x).is_integer() else str(x)


def reshape_wide(v: View, stubs: str, i: str, j: str, check: bool = True) -> View:
    """One row for each i: a conditional aggregate for every stub and value, so the table is shuffled once."""
    roots, ids = v.expand(stubs, wild=False), v.expand(i, wild=False)
    v.expand(j, wild=False)
    others = [n for n in v.names if n not in {*roots, *ids, j}]
    if others:
        raise VerbError(f"neither in i(), j() nor the stubs: {', '.join(others)}", 9)
    values = j_values(v, j)
    if check:
        _identify(v, [*ids, j], f"{i} {j}")
    aggs, meta, seen = [], {n: v.meta[n] for n in ids if n in v.meta}, set(ids)
    for x in values:
        for r in roots:
            n = f"{r}{name_of(x)}"
            if not is_name(n) or n in seen:
                raise VerbError(f"{n!r} is no valid new name")
            seen.add(n)
            c = F.max(F.when(F.col(f"`{j}`") == F.lit(x), F.col(f"`{r}`")))
            aggs.append((F.coalesce(c, F.lit("")) if v.kinds[r] == "s" else c).alias(n))
            meta[n] = Meta(fmt=v.meta.get(r, Meta()).fmt, label=f"{name_of(x)} {r}")
    if not aggs:
        raise VerbError("there are no rows to reshape", 2000)
    out = v.df.groupBy(*[v.key(k).alias(k) for k in ids]).agg(*aggs)
    out = out.select(*[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(k) if v.kinds[k] == "s" else F.col(f"`{k}`") for k in ids], *[F.col(f"`{n}`") for n in out.columns[len(ids) :]])
    return v.then(out, f"reshape wide {stubs}, i({i}) j({j})", order=tuple((k, False) for k in ids), meta=meta)


def pivot(v: View, text: str, rows: str, cols: str) -> View:
    """collapse by rows and cols, then wide; nothing changes if either fails."""
    if len(cols.split()) != 1:
        raise VerbError("cols() takes one variable")
    j_values(v, cols)
    small = collapse(v, text, f"{rows} {cols}")
    stubs = [n for n in small.names if n not in {*rows.split(), cols}]
    return reshape_wide(small, " ".join(stubs), rows, cols, check=False)
