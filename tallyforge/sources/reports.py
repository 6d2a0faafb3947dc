"""Reports: aggregates formatted on the driver, every row of them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F


def _rows(df: DataFrame) -> Iterator[dict]:
    return (r.asDict() for r in df.toLocalIterator())  # whole, one partition at a time


def markdown(title: str, sections: dict[str, DataFrame], status: str | None = None) -> str:
    """A report: a heading for each section and its rows as a table."""
    out = [f"# {title}", ""] + ([f"Status: {status}", ""] if status else [])
    for name, df in sections.items():
        keys = df.columns
        rows = ["| " + " | ".join("" if r[k] is None else str(r[k]) for k in keys) + " |" for r in _rows(df)]
        out += [f"## {name}", ""] + (["| " + " | ".join(keys) + " |", "|" + "---|" * len(keys), *rows] if rows else ["none"]) + [""]
    return "\n".join(out)


def reconciliation_status(counts: dict) -> str:
    """FAIL on any critical discrepancy, WARNING on any other, else PASS."""
    return "FAIL" if counts.get("critical") else "WARNING" if counts.get("n") else "PASS"


def _status(df: DataFrame, column: str = "status") -> str | None:
    first = df.first()
    return first[column] if first else None


def reconciliation_report(found: dict[str, DataFrame], worst: int = 20) -> str:
    """Of ``workflows.cross_verify``: summary, mapping, the worst discrepancies, what to do."""
    counts = found["summary"].first().asDict()
    d = found["discrepancies"]
    top = d.orderBy(F.desc_nulls_last("percentage_difference"), "label").limit(worst)
    todo = [t for n, t in (("critical", "review critical differences first"), ("data_issues", "complete missing values and mappings"), ("errors", "look into processing errors")) if counts.get(n)]
    out = markdown("Reconciliation", {"Summary": found["summary"], "Mapping": found["statistics"], "By kind": d.groupBy("discrepancy_type").count().orderBy("discrepancy_type"), "Largest differences": top}, reconciliation_status(counts))
    return out + "\n".join(["", "## Recommendations", ""] + [f"- {t}" for t in todo or ["none"]]) + "\n"


def quality_report(found: dict[str, DataFrame]) -> str:
    """R2: of ``workflows.evaluation_suite``."""
    return markdown("Extraction quality", {"Text": found["text"], "Table methods": found["methods"], "Consistency": found["consistency"], "Structure": found["structure"], "Preferred method": found["preferred"]})


def regression_report(found: dict[str, DataFrame]) -> str:
    """R3."""
    failed = found["checks"].where("NOT passed").orderBy("metric")
    return markdown("Regression checks", {"Summary": found["status"], "Failed": failed, "All": found["checks"].orderBy("metric"), "Simulated failures": found["simulation"]}, _status(found["status"]))


def drift_report(found: dict[str, DataFrame]) -> str:
    """R4; charts are left to whoever reads the tables."""
    return markdown("Drift", {"Summary": found["drift_summary"], "Changes": found["drift"].orderBy(F.desc(F.abs("relative_change")), "metric"), "Alerts": found["alerts"]}, _status(found["drift_summary"], "level"))


def benchmark_report(found: dict[str, DataFrame]) -> str:
    """R5."""
    return markdown("Benchmark", {"Bottlenecks": found["bottlenecks"], "Throughput": found["throughput"].orderBy(F.desc("pages_per_hour"), "operation")})


def metrics_report(found: dict[str, DataFrame]) -> str:
    """R6."""
    return markdown("Metrics", {"Trends": found["trend"].orderBy("metric"), "Alerts": found["alerts"]})
