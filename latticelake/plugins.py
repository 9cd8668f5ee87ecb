"""Registries of parsers and apps; classifiers are in operators.classify. A plug-in is a row of a registry."""

from __future__ import annotations

import signal
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.runs import app_scope
from .sources import files as SF


class Parser(NamedTuple):
    """patterns: what a line of such a file matches; parse: (path, text) rows to run rows with path and error, one or more a file."""

    patterns: list[str]
    parse: Callable[[DataFrame], DataFrame]


PARSERS = {"pwscf": Parser(SF.RULES["pwscf"], SF.parse_runs)}


def parse_files(files: DataFrame, parsers: dict[str, Parser] = PARSERS, only: list[str] | None = None) -> DataFrame:
    """Run rows of files (path, text) by the parser whose patterns come first in a file; files that none knows have the error 'was read'.

    only restricts the parsers to those named. Columns that a parser doesn't give are null.
    """
    used = {n: p for n, p in parsers.items() if only is None or n in only}
    marked = files.select("path", "text", SF.detect_format(F.col("text"), {n: p.patterns for n, p in used.items()}).alias("format")) if used else files.select("path", "text", F.lit(None).cast("string").alias("format"))
    unknown = marked.where("format is null").select("path", "format", F.lit("was read").alias("error"))
    parts = [p.parse(marked.where(F.col("format") == n).select("path", "text")).withColumn("format", F.lit(n)) for n, p in used.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [unknown, *parts])


class App(NamedTuple):
    """target: what a run's columns have to say (see app_scope); data: the result as a column, null where it can't be had; error: why it can't."""

    target: dict[str, str]
    data: Callable[[DataFrame], Column]
    error: Callable[[DataFrame], Column] = lambda runs: F.lit(None).cast("string")


def run_apps(runs: DataFrame, apps: dict[str, App], dry_run: bool = False) -> DataFrame:
    """(checksum, app, data, error): a row for each run and each app that is permitted for it; a dry run leaves data and error null."""
    rows = []
    for name, app in apps.items():
        data, error = (F.lit(None), F.lit(None)) if dry_run else (app.data(runs), app.error(runs))
        entry = F.struct(F.lit(name).alias("app"), data.cast("string").alias("data"), error.cast("string").alias("error"))
        rows.append(F.when(app_scope(runs, app.target), entry))
    return runs.select("checksum", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("checksum", "x.*")


class IsolatedApp(NamedTuple):
    """target: as for App; run: gets a run row as a dictionary and returns the result, None where the app has none; seconds: what it may take for a run."""

    target: dict[str, str]
    run: Callable[[dict], object]
    seconds: float = 60.0


@contextmanager
def _within(seconds: float):
    """Raises TimeoutError in the block after so many seconds."""

    def late(*_):
        raise TimeoutError(f"took more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _outcome(name: str, app: IsolatedApp, row: dict) -> tuple[str | None, str | None]:
    """(data, error) of an app for a run, whatever the app does."""
    try:
        with _within(app.seconds):
            data = app.run(row)
    except (Exception, SystemExit) as e:
        return None, f"Fatal error in {name} module:\n {type(e).__name__}: {e}"
    return (None, f"No appdata-defined property found for {name} module!") if data is None else (str(data), None)


def run_isolated(runs: DataFrame, apps: dict[str, IsolatedApp], dry_run: bool = False) -> DataFrame:
    """(checksum, app, data, error): a row for each run and each app that is permitted for it; runs has a checksum and any nested columns.

    Apps are plain functions of one run. An exception, an exit or a time-out of an app is the
    error of that run and app; all others have their results. Spark picks the permitted runs, so
    rows that no app wants never reach Python. A dry run calls nothing.
    """
    names = [F.when(app_scope(runs, app.target), F.lit(name)) for name, app in apps.items()]
    allowed = runs.select("checksum", F.array_compact(F.array(*names)).alias("apps"), F.struct(*(F.col(f"`{c}`") for c in runs.columns)).alias("row")).where(F.size("apps") > 0)
    if dry_run:
        return allowed.select("checksum", F.explode("apps").alias("app"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("string").alias("error"))

    def call(batches):
        for b in batches:
            out = [(key, name, *_outcome(name, apps[name], row)) for key, own, row in zip(*(c.to_pylist() for c in b.columns), strict=True) for name in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], names=["checksum", "app", "data", "error"])

    return allowed.select(F.col("checksum").cast("string").alias("checksum"), "apps", "row").mapInArrow(call, "checksum string, app string, data string, error string")
