"""Named views and the commands on them, as methods: each verb replaces the current view or leaves it."""

from __future__ import annotations

import contextlib
import os
import tempfile
from dataclasses import replace

import pyspark
from pyspark.sql import DataFrame, SparkSession

from .errors import VerbError
from .operators import aggregate, columns, reshape, stats, twotable
from .plans.view import View
from .sources import readers, writers

#: Verbs that make a new view, and what reads one, by name.
VERBS = {
    **{n: getattr(columns, n) for n in ("keep", "drop", "keep_if", "drop_if", "gen", "replace", "rename", "order", "sort", "gsort", "keep_in", "sample", "label", "label_define", "label_values", "note", "char", "fmt", "query")},
    **{n: getattr(aggregate, n) for n in ("collapse", "contract", "duplicates_drop", "egen")},
    **{n: getattr(reshape, n) for n in ("reshape_long", "reshape_wide", "pivot")},
}
READS = {
    **{n: getattr(columns, n) for n in ("head", "count")},
    "list": columns.rows,
    **{n: getattr(stats, n) for n in ("summarize", "summarize_detail", "tabulate", "tabulate_two", "misstable", "misstable_patterns", "levelsof", "codebook", "distinct", "duplicates_report", "duplicates_list", "tabstat", "correlate", "pwcorr", "histogram", "describe", "lookfor")},
    "glimpse": stats.describe,
}
TWO = {n: getattr(twotable, n) for n in ("merge", "merge_in", "joinby", "append", "append_in")}


class Session:
    """The views of one user; one of them is current."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.views: dict[str, View] = {}
        self.current = "default"
        self.missing_high = False

    # -- views

    @property
    def view(self) -> View:
        if self.current not in self.views:
            raise VerbError(f"no view {self.current} is open", 111)
        return self.views[self.current]

    def put(self, v: View, name: str | None = None) -> View:
        name = name or self.current
        self.views[name] = replace(v, missing_high=self.missing_high)
        self.current = name
        return self.views[name]

    def switch(self, name: str) -> None:
        if name not in self.views:
            raise VerbError(f"no view {name} is open", 111)
        self.current = name

    @contextlib.contextmanager
    def on(self, name: str):
        """One command on another view, then back."""
        before = self.current
        self.switch(name)
        try:
            yield self
        finally:
            self.current = before

    def list_views(self) -> list[tuple[str, bool, int]]:
        return [(n, n == self.current, len(v.names)) for n, v in self.views.items()]

    def close(self, name: str | None = None) -> None:
        if name == "_all":
            self.views.clear()
        elif (name or self.current) in self.views:
            del self.views[name or self.current]
        else:
            raise VerbError(f"no view {name or self.current} is open", 111)
        if self.current not in self.views:
            self.current = next(iter(self.views), "default")

    # -- sources and sinks

    def use(self, path, names: str = "", name: str | None = None, relaxed: bool = False) -> View:
        return self.put(self._source(path, relaxed) if not names else columns.keep(self._source(path, relaxed), names), name)

    def _source(self, path, relaxed: bool = False) -> View:
        if isinstance(path, View):
            return path
        if isinstance(path, str) and path.startswith("view:"):
            if path[5:] not in self.views:
                raise VerbError(f"no view {path[5:]} is open", 111)
            v = self.views[path[5:]]
            columns.check_ranges(v)
            return v
        return readers.use(self.spark, path, relaxed=relaxed)

    def open_data(self, data, name: str | None = None) -> View:
        """A view of a Spark or pandas DataFrame."""
        df = data if hasattr(data, "sparkSession") else readers.read_pandas(self.spark, data)
        return self.put(readers.boundary(df, step="open data"), name)

    def sql(self, text: str, name: str | None = None) -> View:
        """Any Spark SQL as a source."""
        try:
            df = self.spark.sql(text)
        except Exception as e:
            raise VerbError(f"the SQL does not compile: {e}", 920) from e
        return self.put(readers.boundary(df, step=f"sql {text}"), name)

    def save(self, dest: str, **options) -> int:
        return writers.save(self.view, dest, **options)

    def collect(self):
        return writers.collect(self.view)

    def df(self) -> DataFrame:
        return self.view.sorted_df()

    # -- plans and settings

    def show(self) -> str:
        """The verbs of the view, and the plan that they make."""
        steps = "\n".join(f"{k + 1}. {s}" for k, s in enumerate(self.view.steps))
        return f"{steps}\n\n{self.view.sorted_df()._jdf.queryExecution().optimizedPlan().toString()}"

    def explain(self, mode: str = "formatted") -> None:
        self.view.sorted_df().explain(mode)

    def ds(self) -> list[str]:
        return self.view.names

    def set(self, option: str, value) -> None:
        if option == "missing_high":
            self.missing_high = value in (True, "on")
            self.views = {n: replace(v, missing_high=self.missing_high) for n, v in self.views.items()}
        elif option == "threads":
            if not str(value).isdigit() or int(value) < 1:
                raise VerbError("threads is a positive number")
            self.spark.conf.set("spark.sql.shuffle.partitions", str(int(value)))
        elif option in ("memory_limit", "tempdir"):
            raise VerbError(f"{option} is fixed when Spark starts: spark.driver.memory, spark.executor.memory, spark.local.dir", 198)
        else:
            raise VerbError(f"unknown setting {option}")

    def version(self) -> dict:
        return {"spark": self.spark.version, "pyspark": pyspark.__version__}

    def selftest(self) -> bool:
        """Write, read and compare a small table."""
        with tempfile.TemporaryDirectory() as d:
            v = readers.boundary(self.spark.createDataFrame([(1, 1.5, "a"), (2, None, None)], "k int, x double, s string"))
            writers.save(v, os.path.join(d, "t"))
            return sorted(map(tuple, readers.use(self.spark, os.path.join(d, "t")).df.collect())) == sorted([(1, 1.5, "a"), (2, None, "")])

    def describe_file(self, path: str) -> dict:
        return readers.describe_file(path, self.spark)

    def path(self, path: str) -> dict:
        return readers.path_of(path)

    def __getattr__(self, name: str):
        if name in VERBS:
            return lambda *a, **k: self.put(VERBS[name](self.view, *a, **k))
        if name in READS:
            return lambda *a, **k: READS[name](self.view, *a, **k)
        if name == "append":
            return lambda *using, **k: self.put(twotable.append(self.view, *[self._source(u) for u in using], **k))
        if name == "append_in":
            return lambda using, **k: self.put(twotable.append_in(self.view, self._source(using), **k))
        if name == "joinby":
            return lambda keys, using, **k: self.put(twotable.joinby(self.view, keys, self._source(using), **k))
        if name in ("merge", "merge_in"):
            return lambda kind, keys, using, **k: self.put(TWO[name](self.view, kind, keys, self._source(using), **k))
        raise AttributeError(name)
