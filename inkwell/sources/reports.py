"""Reports of evaluations and benches: canonical JSON, JUnit XML and Markdown, from named fields only."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from typing import Any
from xml.sax.saxutils import escape, quoteattr


def project(record: Mapping[str, Any], allowed: Mapping[str, Any]) -> dict[str, Any]:
    """The allowed fields of a record and nothing else. allowed: name -> True (as it is), len (how many), or a mapping for what is below."""
    out = {}
    for name, rule in allowed.items():
        if name in record:
            value = record[name]
            if isinstance(rule, Mapping):
                out[name] = [project(x, rule) for x in value] if isinstance(value, Sequence) and not isinstance(value, str) else project(value, rule)
            elif rule is True:
                out[name] = value
            elif callable(rule):
                out[name] = rule(value)
    return out


def canonical_json(value: Any) -> str:
    """Keys sorted, no blanks, one line: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"


def junit(suite: str, cases: Sequence[tuple[str, bool, str]]) -> str:
    """One test case for each (name, passed, message)."""
    lines = [f"<testsuite name={quoteattr(suite)} tests=\"{len(cases)}\" failures=\"{sum(not ok for _, ok, _ in cases)}\">"]
    for name, ok, message in cases:
        lines.append(f"  <testcase name={quoteattr(name)}/>" if ok else f"  <testcase name={quoteattr(name)}><failure>{escape(message)}</failure></testcase>")
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + "\n".join([*lines, "</testsuite>"]) + "\n"


def markdown_table(title: str, columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    def cell(x: Any) -> str:
        return str(x).replace("|", "\\|").replace("\n", " ")

    head = ["| " + " | ".join(map(cell, columns)) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([f"# {title}", "", *head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def write(folder: str, name: str, record: Mapping[str, Any], cases: Sequence[tuple[str, bool, str]]) -> dict[str, str]:
    """The three files of a report, each written whole or not at all; their paths by kind."""
    texts = {"json": canonical_json(record), "xml": junit(name, cases), "md": markdown_table(name, ("case", "passed", "note"), cases)}
    os.makedirs(folder, exist_ok=True)
    out = {}
    for kind, text in texts.items():
        out[kind] = os.path.join(folder, f"{name}.{kind}")
        with open(out[kind] + ".new", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(out[kind] + ".new", out[kind])
    return out
