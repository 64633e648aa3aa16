"""Sinks.  Tables are written by executors; only small results become single files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

MOST_ROWS = 100_000  # of a table that is rendered on the driver


def jsonl(df: DataFrame, path: str) -> int:
    """Lines of JSON, non-ASCII kept; returns the number of rows written (SRC-03)."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path).count()


def document(payload: dict, path: str) -> None:
    """A pretty JSON file; folders are made (SRC-04)."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, ensure_ascii=False, sort_keys=True) + "\n", encoding="utf-8")


def csv(df: DataFrame, path: str) -> None:
    """One CSV part with a header (SRC-24)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _cells(df: DataFrame, places: int) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write a table instead")
    show = lambda v: "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    return df.columns, [[show(v) for v in r] for r in rows]


def markdown(df: DataFrame, places: int = 4) -> str:
    """A Markdown table (SRC-24)."""
    names, rows = _cells(df, places)
    line = lambda xs: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *map(line, rows)]) + "\n"


def latex(df: DataFrame, places: int = 4) -> str:
    """A LaTeX tabular (SRC-25)."""
    names, rows = _cells(df, places)
    table = str.maketrans({c: "\\" + c for c in "&%$#_{}"})
    line = lambda xs: " & ".join(x.translate(table) for x in xs) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(names)}}}", line(names), r"\hline", *map(line, rows), r"\end{tabular}"]) + "\n"


def narrative(df: DataFrame, template: str, places: int = 4) -> str:
    """A sentence for each row, from a template that names columns in braces (SRC-25)."""
    names, rows = _cells(df, places)
    return "".join(template.format(**dict(zip(names, r))) + "\n" for r in rows)
