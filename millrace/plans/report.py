"""Plain-language results without a provider: interpretations, explanations, insights and the Markdown report."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame

from millrace.operators import eda, profile
from millrace.plans.ml import Trained


def evidence_confidence(issues: list[dict], columns: list[str]) -> tuple[float, str]:
    """How sure an analysis is: half, and 0.45 times the share of issues whose evidence holds a number or a column."""
    if not issues:
        return 0.90, "High"
    shown = [f"{i.get('value') or ''} {i.get('column') or ''}".lower() for i in issues]
    backed = sum(bool(re.search(r"[\d%]", x)) or any(c.lower() in x for c in columns) for x in shown)
    score = round(0.50 + 0.45 * backed / len(issues), 2)
    return score, "High" if score >= 0.80 else "Medium" if score >= 0.60 else "Low"


def interpret_profile(p: profile.Profile) -> dict[str, Any]:
    """What a profile says, and how sure that is by its evidence."""
    worst = sorted(p.issues, key=lambda i: ["critical", "high", "medium", "low"].index(i["severity"]))[:5]
    confidence, level = evidence_confidence(p.issues, [c.name for c in p.column_profiles])
    return {"summary": f"{p.rows} rows and {p.columns} columns; quality {p.score} ({p.status}).", "issues": worst, "confidence": confidence, "level": level}


def interpret_eda(found: dict[str, Any]) -> list[str]:
    lines = [f"{c['feature_a']} and {c['feature_b']} correlate at {c['correlation']:.3f} ({c['strength']})." for c in found["correlations"]]
    lines += [f"{s['column_name']} is skewed ({s['skewness']:.2f})." for s in found["numeric"] if abs(s["skewness"] or 0) > 1]
    return lines or ["No strong relations were found."]


def explain(t: Trained) -> list[str]:
    best = t.leaderboard[0]
    lines = [f"{best.name} predicts {t.target} best: {t.primary} {best.metrics.get(t.primary, float('nan')):.3f}."]
    lines += [f"{name} matters ({value:.3f})." for name, value in t.importances[:5]]
    return lines + t.warnings


def insights(p: profile.Profile, found: dict[str, Any], t: Trained | None = None) -> list[str]:
    return [interpret_profile(p)["summary"], *interpret_eda(found)[:5], *(explain(t)[:3] if t else [])]


def markdown(df: DataFrame, name: str, t: Trained | None = None) -> str:
    """The whole report as Markdown."""
    p, found = profile.profile(df), eda.summary(df)
    out = [f"# Report on {name}", "", interpret_profile(p)["summary"], "", "## Columns", "", "| column | type | missing % | unique |", "|-|-|-|-|"]
    out += [f"| {c.name} | {c.type} | {c.missing_pct} | {c.unique} |" for c in p.column_profiles]
    out += ["", "## Issues", "", *([f"- {i['severity']}: {i['issue']}" + (f" in {i['column']}" if i["column"] else "") + f" ({i['value']})" for i in p.issues] or ["- none"])]
    out += ["", "## Relations", "", *(f"- {x}" for x in interpret_eda(found))]
    if t:
        out += ["", "## Models", "", "| model | " + t.primary + " |", "|-|-|", *(f"| {c.name} | {c.metrics.get(t.primary, float('nan')):.4f} |" for c in t.leaderboard), "", *(f"- {x}" for x in explain(t))]
    return "\n".join(out) + "\n"


def analyse(df: DataFrame, name: str, trained: Trained | None = None) -> dict[str, Any]:
    """Profile, exploration, insights and report of one table, in the order of the analyst's workflow."""
    p, found = profile.profile(df), eda.summary(df)
    return {"profile": p, "problems": profile.validate_profile(p), "eda": found, "insights": insights(p, found, trained), "report": markdown(df, name, trained)}
