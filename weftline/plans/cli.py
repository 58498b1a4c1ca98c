"""Command line: one file or a folder of files through an analysis."""

from __future__ import annotations

import argparse
import pathlib

from pyspark.sql import functions as F

from weftline.plans.analysis import Analysis
from weftline.plans.config import build_run_spec, expand_variants, parse_user_input
from weftline.session import local_session, tune
from weftline.sources import sinks
from weftline.sources.tables import input_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    p.add_argument("input")
    p.add_argument("--output-dir", default="weftline-out")
    p.add_argument("--user-config", default="")
    p.add_argument("--header", default="auto", choices=("auto", "yes", "no"))
    p.add_argument("--time-col", default="auto")
    p.add_argument("--transpose", default="no", choices=("auto", "yes", "no"))
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--zip", "--batch-zip", action="store_true", help="pack the output folder")
    p.add_argument("--lags", type=int, default=12, help="largest lag where the settings name none")
    p.add_argument("--graph-threshold", type=float, default=0.2, help="strength from which an edge counts")
    p.add_argument("--p-alpha", type=float, default=0.05, help="significance level of p-value methods")
    p.add_argument("--pvalue-correction", default="none", choices=("none", "fdr_bh"))
    p.add_argument("--auto-difference", action="store_true", help="difference channels with a unit root")
    p.add_argument("--interactive-config", action="store_true", help="read the settings from standard input")
    p.add_argument("--output", default=None, help="workbook of a single input file")
    p.add_argument("--report-html", default=None, help="page of a single input file")
    return p


def process(spark, path: str, folder: str, spec, args) -> dict:
    run = pathlib.Path(folder) / sinks.slug(pathlib.Path(path).stem)
    run.mkdir(parents=True, exist_ok=True)
    row = {"input_file": path, "run_dir": str(run)}
    try:
        a = Analysis.from_file(spark, path, spec, header=args.header, time_col=args.time_col, transpose=args.transpose).prepare(auto_diff=args.auto_difference)
        a.run(expand_variants(spec.variants)[0])
        sinks.export_all(a, str(run))
        a.summaries(args.p_alpha, args.graph_threshold).write.mode("overwrite").parquet(str(run / "pair_summary"))
        single = not pathlib.Path(args.input).is_dir()
        if spec.output_mode in ("html", "both"):
            row["html_path"] = (args.report_html if single else None) or str(run / "report.html")
            sinks.write_html(a, row["html_path"])
        if spec.output_mode in ("excel", "both"):
            row["excel_path"] = (args.output if single else None) or str(run / "report.xlsx")
            sinks.write_workbook(row["excel_path"], {v: sinks.bounded(e, 10_000, F.abs("value").desc_nulls_last(), "src", "dst") for v, e in a.results.items()})
        if spec.save_series_bundle:
            tables = {"qc": a.quality()} if spec.qc_enabled else {}
            sinks.write_series({"raw": a.raw, "prepared": a.panel}, tables, str(run / "series"))
            row["series_path"] = str(run / "series")
        row["status"] = "ok"
    except Exception as err:  # a bad file must not stop the batch
        row.update(status="error", error=str(err).splitlines()[0] if str(err) else type(err).__name__)
    return row


def main(argv: list[str] | None = None, spark=None) -> list[dict]:
    args = parser().parse_args(argv)
    spark = tune(spark) if spark is not None else local_session()
    cfg = parse_user_input(input("settings: ") if args.interactive_config else args.user_config)
    cfg.setdefault("pvalue_correction", args.pvalue_correction)
    spec = build_run_spec(cfg, args.lags)
    print("[Plan]\n" + spec.explain())
    source = pathlib.Path(args.input)
    files = input_files(args.input, args.recursive) if source.is_dir() else [args.input]
    rows = [process(spark, f, args.output_dir, spec, args) for f in files]
    sinks.write_manifest(str(pathlib.Path(args.output_dir) / "batch_manifest.csv"), rows)
    if args.zip:
        sinks.zip_folder(args.output_dir, args.output_dir.rstrip("/") + ".zip")
    return rows


if __name__ == "__main__":
    main()
