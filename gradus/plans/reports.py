"""Reports: small result tables as JSON, Markdown and SVG, and manifests with their provenance."""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A report is collected; more rows than this are data, not a report.
MOST_ROWS = 10_000


def rows_of(report: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in report.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    return rows


def as_json(report: DataFrame) -> str:
    """Sorted keys, two spaces; a report of one row is an object. NaN and infinities become null."""
    def plain(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    rows = [plain(r) for r in rows_of(report)]
    return json.dumps(rows[0] if len(rows) == 1 else rows, sort_keys=True, indent=2, default=str) + "\n"


def number(value: object) -> str:
    return "NA" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def as_markdown(report: DataFrame, title: str) -> str:
    rows = rows_of(report)
    names = report.columns
    lines = [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join([*lines, *["| " + " | ".join(number(r[n]) for n in names) + " |" for r in rows]]) + "\n"


def as_sections(title: str, sections: list[tuple[str, str, DataFrame]]) -> str:
    """A report of sections: a title, and for each a heading, a text (left out if empty) and a table of a small frame."""
    out = [f"# {title}"]
    for heading, text, report in sections:
        table = as_markdown(report, heading).rstrip("\n")
        head, rest = table.split("\n", 1)
        out.append("\n".join([head, *(["", text] if text else []), rest]))
    return "\n\n".join(out) + "\n"


def range_svg(report: DataFrame, label: str, low: str, middle: str, high: str) -> str:
    """A line from low to high and a dot at the middle for each row, over [0, 1]."""
    rows = [r for r in rows_of(report) if r[low] is not None]
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="640" height="{30 * len(rows) + 20}">']
    for i, r in enumerate(rows):
        y, x = 30 * i + 25, [200 + 400 * min(1.0, max(0.0, r[c])) for c in (low, middle, high)]
        name = _escaped(r[label])
        out.append(f'<text x="5" y="{y + 4}">{name}</text><line x1="{x[0]:.1f}" y1="{y}" x2="{x[2]:.1f}" y2="{y}" stroke="black"/><circle cx="{x[1]:.1f}" cy="{y}" r="4"/>')
    return "\n".join([*out, "</svg>"]) + "\n"


#: Colours of a chart's series, in order of their names; more series take them again.
COLOURS = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377")


def _escaped(text: object) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;")


def frequency_svg(report: DataFrame, series: str, at: str, n: str, title: str = "") -> str:
    """A panel with axes for each series: a polyline of the share of its counts by bin, and a legend of the series' totals."""
    groups: dict[str, list[tuple[int, int]]] = {}
    for r in rows_of(report):
        groups.setdefault(str(r[series]), []).append((r[at], r[n]))
    names, height = sorted(groups), 180
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="640" height="{40 + height * len(names) + 20 * len(names)}">', f'<text x="20" y="20">{_escaped(title)}</text>']
    most = max((v / (sum(w for _, w in points) or 1) for points in groups.values() for _, v in points), default=1) or 1
    for i, name in enumerate(names):
        points, top, colour = sorted(groups[name]), 30 + height * i, COLOURS[i % len(COLOURS)]
        whole, last = sum(v for _, v in points) or 1, max(b for b, _ in points) or 1
        out.append(f'<g><path d="M40 {top} V{top + 140} H620" fill="none" stroke="black"/><text x="5" y="{top + 8}">{most:.2f}</text><text x="5" y="{top + 140}">0</text><text x="40" y="{top + 155}">{points[0][0]}</text><text x="600" y="{top + 155}">{last}</text>')
        out.append(f'<polyline fill="none" stroke="{colour}" points="' + " ".join(f"{40 + 580 * b / last:.1f},{top + 140 - 140 * v / whole / most:.1f}" for b, v in points) + '"/></g>')
        low = 50 + height * len(names) + 20 * i
        out.append(f'<rect x="40" y="{low - 10}" width="10" height="10" fill="{colour}"/><text x="60" y="{low}">{_escaped(name)} ({sum(v for _, v in groups[name])})</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a text file that isn't there yet: aside first, then renamed without overwriting. FileExistsError if it is."""
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(aside, to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "AlreadyExists" in str(e.java_exception):
            raise FileExistsError(path) from None
        raise


def split_counts(rows: DataFrame, split: str) -> DataFrame:
    """(split, n)."""
    return rows.groupBy(split).agg(F.count("*").alias("n"))


def write_manifest(rows: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder for each split; fails if the path exists, and appears whole or not at all."""
    rows.write.mode("errorifexists").partitionBy(split).json(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def provenance(rows: DataFrame, split: str, content: str) -> DataFrame:
    """(split, rows, contents, digest): a digest of the split's content digests that doesn't depend on their order."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    folded = F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(split).agg(F.count("*").alias("rows"), F.count_distinct(digest).alias("contents"), folded.cast("string").alias("digest"))
