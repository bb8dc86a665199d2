"""Text tables on the driver, from results of a few rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any


def cell(value: Any) -> str:
    return f"{value:.3f}" if isinstance(value, float) else "" if value is None else str(value)


def plain_table(header: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    """A Markdown table with aligned columns; floats have three decimals."""
    return _aligned([list(header), *([cell(v) for v in row] for row in rows)])


def bold_best_table(header: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    """plain_table with every column's largest number bold, all of them where several tie; texts never are."""
    best = [max((v for v in column if isinstance(v, (int, float)) and not isinstance(v, bool)), default=None) for column in zip(*rows, strict=True)] if rows else []
    shown = [[f"**{cell(v)}**" if b is not None and not isinstance(v, str) and v == b else cell(v) for v, b in zip(row, best, strict=True)] for row in rows]
    return _aligned([list(header), *shown])


def _aligned(lines: list[list[str]]) -> str:
    widths = [max(map(len, column)) for column in zip(*lines, strict=True)]
    text = ["| " + " | ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)) + " |" for line in lines]
    return "\n".join([text[0], "|" + "|".join("-" * (w + 2) for w in widths) + "|", *text[1:]])
