"""Timing: benchmarks with an equality gate, and step profiles."""

from __future__ import annotations

import re
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkwright.operators.relational import differences


def force(df: DataFrame) -> None:
    """Compute every column of every row and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def timed(run: Callable[[], DataFrame], repeats: int = 7) -> float:
    """Median seconds after one warm-up."""
    force(run())
    times = []
    for _ in range(repeats):
        t = time.perf_counter()
        force(run())
        times.append(time.perf_counter() - t)
    return statistics.median(times)


def compare(forms: dict[str, Callable[[], DataFrame]], repeats: int = 7) -> dict[str, float]:
    """Median seconds of forms of one query, timed only if their answers agree."""
    names = list(forms)
    for other in names[1:]:
        if not differences(forms[names[0]](), forms[other]()).isEmpty():
            raise ValueError(f"{names[0]} and {other} give different answers")
    return {n: timed(f, repeats) for n, f in forms.items()}


def plan_of(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def statements(script: str) -> list[tuple[str, str]]:
    """(kind and target, statement) of a SQL script in its order: split at semicolons
    outside quotes and comments, the target named after the statement's first words."""
    parts, at, quoted = [], 0, re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|;", re.S)
    for m in quoted.finditer(script):
        if m.group() == ";":
            parts.append(script[at : m.start()])
            at = m.end()
    parts.append(script[at:])
    out = []
    for part in parts:
        bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", part, flags=re.S).strip()
        if bare:
            m = re.match(r"(?i)(create|insert|delete|update|drop|alter)\b(?:\s+(?:or|replace|into|from|table|view|sequence|index|unique|temp|temporary|if|not|exists|overwrite))*\s+([\w.]+)", bare)
            out.append((f"{m[1].lower()} {m[2]}" if m else bare.split()[0].lower(), bare))
    return out


class Profile:
    """Seconds of named steps in order, rows in and out, the slowest marked."""

    def __init__(self):
        self.steps: list[tuple[str, float]] = []
        self.rows: list[tuple[int | None, int | None]] = []

    def step(self, name: str, run: Callable, rows_in: Callable[[], int] | None = None, rows_out: Callable[[], int] | None = None):
        """Run a step; rows before and after are counted outside its time."""
        before = rows_in() if rows_in else None
        t = time.perf_counter()
        out = run()
        self.steps.append((name, time.perf_counter() - t))
        self.rows.append((before, rows_out() if rows_out else None))
        return out

    def script(self, spark: SparkSession, text: str) -> None:
        """The statements of a script, each a step in its order, with the rows it returns."""
        for name, statement in statements(text):
            held = {}
            self.step(name, lambda s=statement, h=held: h.update(n=spark.sql(s).count()), rows_out=lambda h=held: h["n"])

    def report(self) -> list[tuple[str, float, float, bool]]:
        """(name, seconds, share, whether it is the bottleneck)."""
        total, top = sum(s for _, s in self.steps) or 1, max((s for _, s in self.steps), default=0)
        return [(n, s, s / total, s == top) for n, s in self.steps]

    def table(self) -> list[tuple[str, float, float, int | None, int | None, bool]]:
        """As report, with rows in and out before the mark."""
        return [(n, s, share, *rows, top) for (n, s, share, top), rows in zip(self.report(), self.rows, strict=True)]
