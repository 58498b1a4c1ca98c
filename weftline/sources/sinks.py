"""Writing results.  Tables go through Spark writers; only bounded summaries pass the driver."""

from __future__ import annotations

import csv
import html
import json
import math
import pathlib
import re
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.panel import Panel

SHEET_ROWS = 1_048_576
SHEET_COLUMNS = 16_384
SHEET_CELLS = 5_000_000
MANIFEST = ("input_file", "status", "run_dir", "excel_path", "html_path", "series_path", "error")


@dataclass(frozen=True)
class ExportPolicy:
    dense_n_limit: int = 0  # 0: write the full matrix whatever its size
    topk_per_node: int = 0  # 0: all edges
    min_abs_weight: float = 0.0
    dense_csv: bool = True
    include_names: bool = True


def slug(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name).strip("_") or "unnamed"


def edge_table(edges: DataFrame, names: Sequence[str], directed: bool, policy: ExportPolicy = ExportPolicy()) -> DataFrame:
    """``src, dst, src_name, dst_name, weight``: strongest edges per node, numbered by channel order."""
    e = edges if directed else graph.mirrored(edges)
    e = e.withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value"))).filter("value IS NOT NULL AND value <> 0")
    if 0 < policy.topk_per_node < len(names):
        e = graph.top_edges(e, policy.topk_per_node, policy.min_abs_weight)
    else:
        e = e.filter(F.abs("value") >= policy.min_abs_weight)
    spark = edges.sparkSession
    ids = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    out = e.join(ids.toDF("s", "src"), "src").join(ids.toDF("d", "dst"), "dst")
    cols = [F.col("s").alias("src"), F.col("d").alias("dst")]
    if policy.include_names:
        cols += [F.col("src").alias("src_name"), F.col("dst").alias("dst_name")]
    return out.select(*cols, F.col("value").alias("weight"))


def write_matrix(edges: DataFrame, folder: str, prefix: str, variant: str, names: Sequence[str], directed: bool, policy: ExportPolicy = ExportPolicy(), meta: dict | None = None) -> dict:
    """Edge list (gzip CSV), dense CSV for few channels, and a JSON description."""
    base = f"{folder}/{slug(prefix)}_{slug(variant)}"
    table = edge_table(edges, names, directed, policy)
    table.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(base + "_edges")
    info = {"variant": variant, "n": len(names), "edges": base + "_edges", "topk_per_node": policy.topk_per_node, "min_abs_weight": policy.min_abs_weight}
    if policy.dense_csv and (not policy.dense_n_limit or len(names) <= policy.dense_n_limit):
        graph.matrix(edges, names, directed).write.mode("overwrite").option("header", True).csv(base + "_dense")
        info["dense"] = base + "_dense"
    info["extra"] = meta or {}
    write_json(base + "_meta.json", info)
    return info


def write_nodes(names: Sequence[str], path: str, spark, coords: DataFrame | None = None) -> None:
    nodes = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    if coords is not None:
        nodes = nodes.join(coords.withColumnRenamed("channel", "name").select("name", "x", "y", "z"), "name", "left").select("id", "name", "x", "y", "z")
    nodes.write.mode("overwrite").option("header", True).csv(path)


def plain(value):
    """JSON-ready: NaN and infinities become null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_json(path: str, obj: dict) -> None:
    pathlib.Path(path).parent.mkdir(parents=True, exist_ok=True)
    pathlib.Path(path).write_text(json.dumps(plain(obj), ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def write_series(stages: dict[str, Panel], tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each stage and table as a parquet folder with one meta file."""
    out = {}
    for name, p in stages.items():
        out[name] = f"{folder}/{slug(name)}"
        p.frame.write.mode("overwrite").parquet(out[name])
    for name, t in tables.items():
        out[name] = f"{folder}/{slug(name)}"
        t.write.mode("overwrite").parquet(out[name])
    write_json(f"{folder}/series.meta.json", {"parts": out, "channels": {n: list(p.channels) for n, p in stages.items()}})
    return out


def write_reductions(panel: Panel, folder: str, sizes: Sequence[int], method: str = "variance", **args) -> dict[int, str]:
    """For each size of a reduction: series, mapping and description, all written by Spark."""
    from weftline.operators import reduce

    out = {}
    for k in sizes:
        got = reduce.reduce_channels(panel, method, k, **args)
        out[k] = f"{folder}/{slug(method)}_{k}"
        got.panel.frame.write.mode("overwrite").parquet(f"{out[k]}/series")
        got.mapping.write.mode("overwrite").option("header", True).csv(f"{out[k]}/mapping")
        meta = json.dumps(plain({**got.meta, "channels": list(got.panel.channels)}), default=str)
        panel.frame.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out[k]}/meta")
    return out


def export_all(analysis, folder: str, prefix: str = "run", policy: ExportPolicy = ExportPolicy()) -> dict:
    """Every result, its scans, the node list and the contracts."""
    from weftline.plans import registry

    names = list(analysis.panel.channels)
    files = {}
    for v, edges in analysis.results.items():
        files[v] = write_matrix(edges, folder, prefix, v, names, registry.is_directed(v), policy, analysis.contracts[v].as_dict())
        for kind, table in analysis.scans.get(v, {}).items():
            table.write.mode("overwrite").parquet(f"{folder}/{slug(prefix)}_{slug(v)}_scan_{kind}")
    write_nodes(names, f"{folder}/nodes", analysis.panel.frame.sparkSession, analysis.coords)
    manifest = {"prefix": prefix, "channels": names, "files": files, "summary": analysis.run_summary()}
    write_json(f"{folder}/manifest.json", manifest)
    return manifest


def bounded(df: DataFrame, limit: int, *order) -> tuple[list[str], list[list]]:
    """The first ``limit`` rows in order for a report page; a last row tells if more were left out."""
    rows = [list(r) for r in df.orderBy(*(order or df.columns)).limit(limit + 1).collect()]
    if len(rows) > limit:
        rows = [*rows[:limit], [f"more than {limit} rows: the rest is in the exported tables", *[None] * (len(df.columns) - 1)]]
    return df.columns, rows


def write_workbook(path: str, sheets: dict[str, tuple[list[str], list[list]]]) -> None:
    """A plain workbook of small tables."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"

    def cell(v) -> str:
        v = plain(v)
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (cols, rows) in enumerate(sheets.values(), 1):
            if len(rows) + 1 > SHEET_ROWS or len(cols) > SHEET_COLUMNS:
                raise ValueError("table does not fit a worksheet")
            body = "".join("<row>" + "".join(cell(v) for v in r) + "</row>" for r in [cols, *rows])
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        ids = range(1, len(sheets) + 1)
        names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, sheets))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids)
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in ids)
        z.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>',
        )


def _heat(names: Sequence[str], cells: dict[tuple[str, str], float]) -> str:
    """Matrix picture as inline SVG."""
    top = max((abs(v) for v in cells.values() if v is not None), default=1.0) or 1.0
    size = 18
    parts = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            v = cells.get((a, b))
            if v is not None:
                tone = "200,60,40" if v > 0 else "40,80,200"
                parts.append(f'<rect x="{j * size}" y="{i * size}" width="{size}" height="{size}" fill="rgba({tone},{abs(v) / top:.3f})"><title>{escape(a)} {escape(b)} {v:.3f}</title></rect>')
    side = size * len(names)
    return f'<svg width="{side}" height="{side}">{"".join(parts)}</svg>'


def write_html(analysis, path: str, rows: int = 200, picture_limit: int = 300) -> None:
    """One page: plan, strongest pairs, small matrices, scan curves as data."""
    from weftline.plans import registry

    out = ["<!doctype html><meta charset='utf-8'><title>connectivity report</title>", f"<pre>{html.escape(analysis.run_summary())}</pre>"]
    payload = {}
    names = list(analysis.panel.channels)
    for v, edges in analysis.results.items():
        out.append(f"<h2>{html.escape(v)}</h2>")
        cols, top = bounded(graph.top_pairs(edges, 20, registry.is_p_value(v)), 20, F.abs("value").desc() if not registry.is_p_value(v) else F.col("value"))
        out.append("<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(fmt(x))}</td>" for x in r) + "</tr>" for r in [cols, *top]) + "</table>")
        if len(names) <= picture_limit:
            e = edges if registry.is_directed(v) else graph.mirrored(edges)
            out.append(_heat(names, {(r.src, r.dst): r.value for r in e.select("src", "dst", "value").collect()}))
        else:
            out.append(f"<p>No picture: {len(names)} channels, more than {picture_limit}. The matrix is in the exported tables.</p>")
        payload[v] = {k: bounded(t, rows)[1] for k, t in analysis.scans.get(v, {}).items() if k != "cube_edges"}
    out.append(f"<script type='application/json' id='scans'>{json.dumps(plain(payload), default=str)}</script>")
    pathlib.Path(path).write_text("\n".join(out), encoding="utf-8")


def fmt(v) -> str:
    """Three decimals, N/A for missing."""
    if v is None or (isinstance(v, float) and not math.isfinite(v)):
        return "N/A"
    return f"{v:.3f}" if isinstance(v, float) else str(v)


def write_manifest(path: str, rows: Sequence[dict]) -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, MANIFEST, restval="", extrasaction="ignore")
        w.writeheader()
        w.writerows(rows)


def zip_folder(folder: str, target: str) -> None:
    root = pathlib.Path(folder)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.resolve() != pathlib.Path(target).resolve():
                z.write(p, p.relative_to(root))


def plot_points(df: DataFrame, order: str, length: int, limit: int = 2000) -> DataFrame:
    """Evenly spaced positions for drawing (at most ``limit``)."""
    if length <= limit:
        return df
    k = F.bround(F.floor(F.col(order) * F.lit(limit - 1) / F.lit(length - 1) + 0.5) * F.lit((length - 1) / (limit - 1))).cast("bigint")
    return df.filter(F.col(order) == k)
