"""Markdown reports over result tables that are already small (a row per factor, year or check)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.factors import factor_summary
from tidemark.operators.reconcile import scorecard_conclusion, verify_panel
from tidemark.operators.universe import survivorship_note
from tidemark.plans.research import Research

MAX_REPORT_ROWS = 10_000


def to_markdown(df: DataFrame, title: str | None = None) -> str:
    """A result table as Markdown. Refuses tables that are not report-sized."""
    rows = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError("not a report table: write it to storage instead")

    def cell(value: object) -> str:
        if value is None:
            return "-"
        return f"{value:.6g}" if isinstance(value, float) else str(value)

    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in row) + " |" for row in rows]
    return "\n".join(lines) + "\n"


def _preamble(title: str, run: Research) -> str:
    rules = run.rules
    return "\n".join([
        f"# {title}", "",
        f"- factors: {', '.join(run.names)}",
        f"- universe: {run.universe.describe()}",
        f"- bias: {survivorship_note(run.universe)}",
        f"- top {rules.top_n}, every {rules.rebalance_days} days, band {rules.band}, direction {run.direction}",
        f"- costs: commission {rules.commission:.4%}, tax {rules.tax:.4%}, slippage {rules.slippage:.4%}", "",
    ]) + "\n"


def backtest_report(run: Research, index: DataFrame | None = None, trades: bool = True) -> str:
    parts = [
        _preamble("Portfolio backtest", run),
        to_markdown(run.metrics().orderBy("factor"), "Results"),
        to_markdown(run.erosion().orderBy("factor"), "Costs"),
        to_markdown(run.stability().orderBy("factor"), "IC stability"),
        to_markdown(run.years(index).orderBy("factor", "year"), "Years"),
        to_markdown(run.interpretation(index), "Interpretation"),
    ]
    sizes = run.sizes()
    if sizes is not None:
        parts.append(to_markdown(sizes, "Universe size"))
    if trades:
        parts.append(to_markdown(run.ledger_report(), "Trades"))
    return "\n".join(parts)


def out_of_sample_report(run: Research, index: DataFrame | None = None) -> str:
    return _preamble("Out-of-sample check", run) + to_markdown(run.out_of_sample(index).orderBy("factor"), "Spans")


def timing_report(run: Research) -> str:
    return "\n".join([
        _preamble("Execution timing", run),
        to_markdown(run.timing().orderBy("factor", "variant"), "Variants"),
        to_markdown(run.contributions(), "Contributions"),
    ])


def factor_report(run: Research) -> str:
    return "\n".join([
        _preamble("Factors", run),
        to_markdown(factor_summary(run.factors).orderBy("factor"), "Summary"),
        to_markdown(run.factor_report().orderBy("factor"), "Rank IC"),
    ])


def data_check_report(panel: DataFrame, store: DataFrame) -> str:
    scorecard = verify_panel(panel, store)
    return "\n".join([
        to_markdown(scorecard, "Panel check"), to_markdown(scorecard_conclusion(scorecard), "Conclusion"),
    ])
