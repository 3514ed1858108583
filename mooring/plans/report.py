"""Driver-side rendering of summaries: at most a row a method, or a cell of a figure, is ever collected."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from mooring.operators import summary as S
from mooring.schemas import ZONES
from mooring.sources import files

_METRICS = ("Alex", "Aent", "Aprob")


def markdown_table(headers: Sequence[str], rows: Sequence[Sequence]) -> str:
    """A Markdown table; floats get one decimal by Python's rules, the rest is ``str``."""
    cell = lambda v: f"{v:.1f}" if isinstance(v, float) else str(v)
    lines = [headers, ["---"] * len(headers), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def csv_text(headers: Sequence[str], rows: Sequence[Sequence]) -> str:
    """CSV with a header, full-precision floats and CRLF line ends."""
    out = io.StringIO(newline="")
    csv.writer(out).writerows([headers, *rows])
    return out.getvalue()


def write_json(spark: SparkSession, path: str, value, indent: int = 2) -> None:
    files.write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=indent))


def aggregate_json(aggregated: DataFrame) -> dict:
    """Nested form of :func:`mooring.operators.summary.aggregate`: group to N, skipped_nan, means, quadrants."""
    out = {}
    for r in aggregated.orderBy("group").collect():
        d = r.asDict()
        q = {z: d[z] for z in ZONES}
        out[r.group] = {"N": r.N, "skipped_nan": r.skipped_nan, "means": {k[5:]: v for k, v in d.items() if k.startswith("mean_") and v is not None}, "quadrants": q if None not in q.values() else {}}
    return out


def aggregate_text(nested: Mapping[str, Mapping]) -> str:
    """An aggregation as a table for the console; a hint if it is empty."""
    shown = ("lexical_anchoring", "entropy_anchoring", "Aprob")
    rows = [[g, x["N"], x["skipped_nan"], *[format(x["means"].get(k, 0), ".4f") for k in shown]] for g, x in nested.items()]
    return markdown_table(["group", "records", "skipped", *shown], rows) + ("" if rows else "\nno group has a probabilistic metric; check the field names")


def zone_summary(zones: DataFrame) -> tuple[list[str], dict, dict]:
    """``(method order, summary, thresholds)`` of :func:`mooring.operators.summary.zones`."""
    rows = {r.method: r.asDict() for r in zones.collect() if r.method is not None}
    order = S.method_order(list(rows))
    any_ = next(iter(rows.values()), {})
    nested = {m: {"N": rows[m]["N"], "metrics": {k: rows[m][k] for k in _METRICS}, "zones": {k: rows[m][k] for k in ZONES}} for m in order}
    return order, nested, {k: any_.get(k) for k in ("x_threshold", "y_threshold")}


def write_zone_tables(zones: DataFrame, out: str, prefix: str, source: str, quantile: float = 0.6) -> dict:
    """The two CSV and two Markdown tables and the summary JSON of one set of records."""
    spark = zones.sparkSession
    order, nested, cut = zone_summary(zones)
    for stem, names, part in ((f"{prefix}_table1_metrics", _METRICS, "metrics"), (f"{prefix}_table2_zones", ZONES, "zones")):
        rows = [[m, nested[m]["N"], *[nested[m][part][k] for k in names]] for m in order]
        files.write_text(spark, f"{out}/{stem}.csv", csv_text(["Method", "N", *names], rows))
        files.write_text(spark, f"{out}/{stem}.md", markdown_table(["Method", "N", *names], rows))
    report = {"source_metrics": source, "method_order": order, "zone_threshold": {"quantile": quantile, **cut}, "summary": nested}
    write_json(spark, f"{out}/{prefix}_summary.json", report)
    return report


def write_figure(points: DataFrame, out: str, prefix: str, cut: Mapping[str, float]) -> bool:
    """A panel a method as PDF and PNG, if matplotlib is there; all points count, in the cells of a fine grid."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return False
    pdf = S.figure_cells(points).toPandas()
    order = S.method_order(list(pdf.method.unique()))
    x_cut, y_cut = cut["x_threshold"], cut["y_threshold"]
    corners = dict(zip(ZONES, ((0, x_cut, 0, y_cut), (0, x_cut, y_cut, 1), (x_cut, 1, 0, y_cut), (x_cut, 1, y_cut, 1))))
    tints = dict(zip(ZONES, ("tab:green", "tab:blue", "tab:orange", "tab:red")))
    fig, axes = plt.subplots(1, max(1, len(order)), figsize=(3.2 * max(1, len(order)), 3.2), squeeze=False, sharey=True)
    for ax, m in zip(axes[0], order):
        own = pdf[pdf.method == m]
        for zone, (x0, x1, y0, y1) in corners.items():
            ax.fill([x0, x1, x1, x0], [y0, y0, y1, y1], color=tints[zone], alpha=0.08, lw=0)
            ax.text((x0 + x1) / 2, (y0 + y1) / 2, zone, ha="center", va="center", alpha=0.4)
        ax.scatter(own.x, own.y, c=own.c, cmap="coolwarm", vmin=0, vmax=1, s=4 + 2 * own.n**0.5)
        ax.set(title=m, xlim=(0, 1), ylim=(0, 1), xlabel="entropic anchoring")
    axes[0][0].set_ylabel("probabilistic anchoring (sqrt)")
    for kind, dpi in (("pdf", 200), ("png", 180)):
        image = io.BytesIO()
        fig.savefig(image, format=kind, dpi=dpi, bbox_inches="tight")
        files.write_bytes(points.sparkSession, f"{out}/{prefix}.{kind}", image.getvalue())
    plt.close(fig)
    return True


#: Sets of records a report is made of: name, heading, must it be there?
SECTIONS = (("methods", "by method", True), ("controlled", "of the controlled variants", False))


def report_text(tables: Mapping[str, Mapping[str, str]], figures: Mapping[str, str], run: str) -> str:
    """The Markdown of a report: ``tables`` has the metrics and zones of each set, ``figures`` the path of its figure."""
    blocks = [f"# Anchoring report\n\nRun: `{run}`"]
    for name, heading, _ in SECTIONS:
        if name in tables:
            blocks += [f"## {kind.capitalize()} {heading}\n\n{tables[name][kind].strip()}" for kind in ("metrics", "zones")]
    blocks.append("\n".join(["## Figures", "", *[f"- {name}: `{path}`" for name, path in figures.items()]]))
    return "\n\n".join(blocks) + "\n"


def write_report(spark: SparkSession, run: str, output: str | None = None) -> str:
    """Writes the report of a run and returns its path; missing tables of the methods are an error."""
    tables, figures = {}, {}
    for name, _, needed in SECTIONS:
        folder = f"{run}/figures/{name}"
        if needed or files.exists(spark, folder):
            tables[name] = {kind: files.read_text(spark, f"{folder}/{name}_table{i}_{kind}.md") for i, kind in enumerate(("metrics", "zones"), 1)}
            if needed or files.exists(spark, f"{folder}/{name}.pdf"):
                figures[name] = f"{folder}/{name}.pdf"
    output = output or f"{run}/report.md"
    files.write_text(spark, output, report_text(tables, figures, run))
    return output
