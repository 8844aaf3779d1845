"""``python -m sievemark --tables FOLDER``: run the stages of a study over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from sievemark.contracts import Config
from sievemark.plans.exhibits import render_all
from sievemark.plans.pipeline import exit_code, run_pipeline
from sievemark.session import build_session, table

TABLES = ("records", "citations", "providers", "corpus", "extracted", "annotations", "taxonomy", "predictions", "second_model", "second_pass")


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sievemark", description=__doc__)
    p.add_argument("--tables", required=True, help="folder with NAME.parquet for each of: " + ", ".join(TABLES))
    p.add_argument("--config", help="JSON file of settings")
    p.add_argument("--stages", default="all", help="comma-separated stages")
    p.add_argument("--out", help="JSON file for the results; exhibits go to the folder beside it")
    p.add_argument("--strict", action="store_true", help="pending stages count as failures")
    a = p.parse_args(arguments)
    config = Config.from_mapping(json.loads(Path(a.config).read_text(encoding="utf-8")) if a.config else {})
    spark = build_session()
    tables = {t: table(spark, a.tables, t) for t in TABLES if (Path(a.tables) / f"{t}.parquet").exists()}
    results = run_pipeline(spark, config, tables, a.stages if a.stages == "all" else a.stages.split(","), a.out)
    if a.out:
        render_all(spark, results, str(Path(a.out).with_suffix("")))
    print(json.dumps(results["summary"], indent=1))
    return exit_code(results, a.strict)


if __name__ == "__main__":
    raise SystemExit(main())
