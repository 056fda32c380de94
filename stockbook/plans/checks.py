"""Plan inspection helpers used by tests and by ``bench.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as ``explain(mode)`` prints it."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def plan_summary(df: DataFrame) -> dict[str, int | bool]:
    """Counts of the operators that matter at scale."""
    p = plan_text(df)
    return {
        "exchanges": p.count("Exchange "),
        "broadcasts": p.count("BroadcastExchange"),
        "sorts": p.count("Sort "),
        "windows": p.count("Window "),
        "python_udf": ("BatchEvalPython" in p) or ("ArrowEvalPython" in p),
        "pushed_filters": "PushedFilters: [" in p and "PushedFilters: []" not in p,
    }
