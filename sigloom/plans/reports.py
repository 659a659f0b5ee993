"""Reports of small tables: Markdown lines, and one HTML page that needs no network."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.sources.formats import write_lines

_SORT = """document.querySelectorAll('th').forEach((h, k) => h.onclick = () => {
  const b = h.closest('table').tBodies[0], v = r => r.cells[k].textContent, up = h.dataset.up !== '1';
  h.dataset.up = up ? '1' : '0';
  [...b.rows].sort((p, q) => (up ? 1 : -1) * v(p).localeCompare(v(q), undefined, {numeric: true})).forEach(r => b.append(r));
});"""


def _cells(df: DataFrame, escape) -> list:
    return [escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line) of a Markdown table, rows by `order`. A report is read by
    people: its rows are numbered in one partition."""
    bars = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    n = F.row_number().over(Window.orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    body = df.select((n + 1).cast("long").alias("line_no"), bars(_cells(df, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))).alias("line"))
    head = "| " + " | ".join(df.columns) + " |"
    rule = "|" + "-|" * len(df.columns)
    top = df.sparkSession.createDataFrame([(0, head), (1, rule)], "line_no long, line string")
    return top.union(body)


def html_lines(df: DataFrame, order: list[str], title: str) -> DataFrame:
    """(line_no, line) of a page with one table that sorts by its columns."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n = F.row_number().over(Window.orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *_cells(df, esc)), F.lit("</td></tr>"))
    body = df.select(n.cast("long").alias("line_no"), row.alias("line"))
    heads = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    top = f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><thead><tr>{heads}</tr></thead><tbody>"
    ends = df.sparkSession.createDataFrame([(0, top), (1 << 40, f"</tbody></table><script>{_SORT}</script>")], "line_no long, line string")
    return ends.union(body)


def write_report(lines: DataFrame, path: str) -> str:
    """Write lines in order as one text file."""
    return write_lines(lines.coalesce(1).sortWithinPartitions("line_no").select("line"), path)


def read_report(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
