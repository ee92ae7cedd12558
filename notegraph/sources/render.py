"""Collected results as text: tables, mermaid graphs and reports (SC19)."""

from __future__ import annotations

from collections.abc import Sequence


def _cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, list):
        return ", ".join(map(_cell, value))
    return str(value).replace("|", "\\|").replace("\n", " ")


def table(hits: Sequence[dict], columns: Sequence[str]) -> str:
    """A Markdown table; absent keys are empty cells."""
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*head, *("| " + " | ".join(_cell(h.get(c)) for c in columns) + " |" for h in hits)])


def mermaid(documents: Sequence[str], links: Sequence[tuple[str, str, str]]) -> str:
    names = {p: f"n{i}" for i, p in enumerate(documents)}
    nodes = [f'  {n}["{p}"]' for p, n in names.items()]
    arrows = [f"  {names[a]} -->|{f}| {names[b]}" for a, b, f in links if a in names and b in names]
    return "\n".join(["graph LR", *nodes, *arrows])


def report(counts: dict[tuple[str, str], int], truncated: bool) -> str:
    if not counts:
        return "no findings"
    lines = [f"{severity:5} {check}: {n}" for (check, severity), n in sorted(counts.items())]
    return "\n".join([*lines, *(["(list truncated)"] if truncated else [])])
