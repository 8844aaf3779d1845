"""Sinks: tables by fingerprint, sorted JSON, CSV and LaTeX tables, release bundles."""

from __future__ import annotations

import json
import logging
import os
import tempfile
import time
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table_by_fingerprint(df: DataFrame, folder: str, stem: str, fingerprint: str, partition_by: list[str] | None = None) -> str:
    """Parquet under ``folder/stem_fingerprint``; partition columns let later scans skip files."""
    path = f"{folder}/{stem}_{fingerprint}.parquet"
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def save_json(value: Any, path: str | Path) -> Path:
    """Sorted JSON, written beside and moved into place."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, sort_keys=True, default=str, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return path


def load_json(path: str | Path) -> Any:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: {e}") from e


def latex_table(rows: list[dict], caption: str) -> str:
    escape = lambda v: "" if v is None else str(v).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    names = list(rows[0]) if rows else []
    body = "\n".join(" & ".join(escape(r.get(c)) for c in names) + r" \\" for r in rows)
    return "\n".join([r"\begin{table}", rf"\caption{{{escape(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(names)}}}", r"\hline", " & ".join(map(escape, names)) + r" \\", r"\hline", body, r"\hline", r"\end{tabular}", r"\end{table}"])


def write_exhibit(df: DataFrame, folder: str, stem: str, caption: str) -> tuple[Path, Path]:
    """An exhibit (few rows by its nature) as CSV and LaTeX."""
    rows = [r.asDict() for r in df.collect()]
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    import csv

    with (out / f"{stem}.csv").open("w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, df.columns)
        w.writeheader()
        w.writerows(rows)
    (out / f"{stem}.tex").write_text(latex_table(rows, caption), encoding="utf-8")
    return out / f"{stem}.csv", out / f"{stem}.tex"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on whatever file system the path names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def manifest_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """Digest of every data file under a folder, taken by the executors; the manifest itself is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = F.regexp_replace(F.lit(spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()), "/$", "")
    name = F.expr("substring(path, instr(path, base) + length(base) + 1)")
    rows = files.withColumn("base", base).select(name.alias("name"), F.sha2("content", 256).alias("digest")).where("name != 'MANIFEST.json'").orderBy("name").collect()
    return {r["name"]: r["digest"] for r in rows}


@contextmanager
def timed(name: str, log: logging.Logger | None = None):  # noqa: ANN201
    log, start = log or logging.getLogger("sievemark"), time.monotonic()
    log.info("%s: start", name)
    try:
        yield
    finally:
        log.info("%s: %.1f s", name, time.monotonic() - start)
