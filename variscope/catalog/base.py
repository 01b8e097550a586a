"""Registry of named queries: a Spark side and, where SQL can say it, a DuckDB side."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from variscope.functions import lines as L
from variscope.operators import blocks as B, configs as C, coverage as V, messages as X, models as M, traces as R
from variscope.session import shared, version
from variscope.sources import projections as P

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


class Tables:
    """Tables a query may start from; derived ones are written once per application."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return P.table(self.spark, self.sf, name)

    def __getattr__(self, name: str) -> DataFrame:
        make = getattr(P, name, None)
        if make is None:
            raise AttributeError(name)
        return make(self.spark, self.sf)

    @cached_property
    def version(self) -> str:
        return version(self.spark, self.sf)

    def _keep(self, name: str, build) -> DataFrame:
        return shared(self.spark, self.key(name), build)

    def key(self, name: str) -> str:
        return f"{self.sf}:{self.version}:{name}"

    @cached_property
    def lines(self) -> DataFrame:
        return self._keep("lines", lambda: P.source_line(self.spark, self.sf))

    @cached_property
    def tree(self) -> DataFrame:
        return self._keep("tree", lambda: B.structure(self.lines))

    @cached_property
    def blocks(self) -> DataFrame:
        return B.block_tree(self.tree)

    @cached_property
    def defines(self) -> DataFrame:
        return self._keep("defines", lambda: B.define_versions(self.lines, self.tree))

    @cached_property
    def rewritten(self) -> DataFrame:
        return self._keep("rewritten", lambda: B.rewrite_symbols(self.blocks, self.defines))

    @cached_property
    def model(self) -> DataFrame:
        return self._keep("model", lambda: M.formulas(self.model_symbol, self.model_literal))

    @cached_property
    def archs(self) -> DataFrame:
        return self.model.select("arch").distinct()

    @cached_property
    def edges(self) -> DataFrame:
        return M.model_edges(self.model)

    @cached_property
    def file_models(self) -> DataFrame:
        return self._keep("file_models", lambda: M.model_for_file(self.source_file, self.archs))

    @cached_property
    def file_uses(self) -> DataFrame:
        """(file_id, arch, symbol): symbols of the block headers of a file."""

        def build():
            uses = L.expr_symbols(self.blocks.select("file_id", "expr")).distinct()
            return uses.join(self.file_models, "file_id")

        return self._keep("file_uses", build)

    @cached_property
    def related(self) -> DataFrame:
        """(arch, start, symbol) for every symbol used in a file or known to a model."""

        def build():
            starts = self.file_uses.select("arch", "symbol").unionByName(self.model.select("arch", "symbol")).distinct()
            return M.related_symbols(starts, self.edges)

        return self._keep("related", build)

    @cached_property
    def forced(self) -> DataFrame:
        return self._keep("forced", lambda: M.forced_symbols(self.model_meta, self.list_item, self.archs))

    @cached_property
    def spaces(self) -> DataFrame:
        return M.space_regex(self.archs, self.model_meta)

    @cached_property
    def file_slice(self) -> DataFrame:
        """(file_id, arch, symbol): symbols a file's headers reach in its model."""
        return self._keep("file_slice", lambda: M.slice_symbols(self.file_uses, self.related))

    @cached_property
    def assignment(self) -> DataFrame:
        return self._keep("assignment", lambda: C.assignment(self.config))

    @cached_property
    def builds(self) -> DataFrame:
        return self._keep("builds", lambda: P.build(self.spark, self.sf))

    @cached_property
    def enabled(self) -> DataFrame:
        return self._keep("enabled", lambda: V.enabled_blocks(self.blocks, self.builds, self.assignment))

    @cached_property
    def all_blocks(self) -> DataFrame:
        """Blocks whose activity is known, and the files themselves."""
        return V.decided(V.block_list(self.blocks, self.line_files), self.undecided)

    @cached_property
    def undecided(self) -> DataFrame:
        return self._keep("undecided", lambda: V.undecided_blocks(self.blocks))

    @cached_property
    def solutions(self) -> DataFrame:
        return self._keep("solutions", lambda: V.file_solutions(self.file_uses, self.builds, self.assignment))

    @cached_property
    def messages(self) -> DataFrame:
        """Cleaned, merged and filtered tool messages."""

        def build():
            merged = X.merge_prefixed(X.strip_message_noise(self.tool_message))
            return X.with_severity(merged)

        return self._keep("messages", build)

    @cached_property
    def parsed(self) -> DataFrame:
        return X.parse_message(self.messages)

    @cached_property
    def addresses(self) -> DataFrame:
        return R.trace_addresses(self.trace_event)

    @cached_property
    def line_files(self) -> DataFrame:
        """Files that have lines."""
        return self.lines.filter(F.col("line_no") == 1).select("file_id")


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"\bv_[a-z_0-9]+", sql))
    return [v for v in VIEWS if v in words]


def compose(sql: str) -> str:
    """Prefix a statement with the views it uses, each once, in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for inner in _used(VIEWS[name]):
            if inner != name:
                visit(inner)
        done.append(name)

    for name in _used(sql):
        visit(name)
    sql = sql.strip()
    if not done:
        return sql
    recursive = "recursive " if any(VIEWS[n].startswith("recursive") for n in done) else ""
    parts = []
    for n in done:
        body = VIEWS[n]
        if body.startswith("recursive"):
            parts.append(f"{n} as ({body[len('recursive'):].strip()})")
        else:
            parts.append(f"{n} as materialized ({body})")
    own = re.match(r"with\s+(recursive\s+)?", sql)
    if own and own.group(1):
        recursive = "recursive "
    body = ",\n" + sql[own.end():] if own else "\n" + sql
    return f"with {recursive}" + ",\n".join(parts) + body
