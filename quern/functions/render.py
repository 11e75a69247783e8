"""Results as a text table."""

from __future__ import annotations

from pyspark.sql import DataFrame

WIDTH = 16


def cell(value) -> str:
    text = f"{value:.6f}" if isinstance(value, float) else "" if value is None else str(value)
    text = text.split("\0", 1)[0]
    return text if len(text) <= WIDTH else text[: WIDTH - 3] + "..."


def render(df: DataFrame, most_bytes: int | None = None) -> str:
    """Right-aligned cells of 16 characters, longer ones cut with `...`, and a count.

    most_bytes: where the reply ends, with `... ...`; the DataFrame is never cut.
    """
    rule = ("+" + "-" * (WIDTH + 2)) * len(df.columns) + "+\n"
    line = lambda values: "".join(f"| {cell(v):>{WIDTH}} " for v in values) + "|\n"
    out, n, cut = [rule, line(df.columns), rule], 0, False
    for row in df.toLocalIterator():
        n += 1
        if not cut and most_bytes is not None and sum(map(len, out)) > most_bytes:
            cut = True
            out.append("... ...\n")
        if not cut:
            out.append(line(row))
    return "".join([*out, rule, f"Total record(s): {n}\n"])
