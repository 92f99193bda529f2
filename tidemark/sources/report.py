"""Size report as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import report as R


def write_report(sizes: DataFrame, folder: str, title: str = "Sizes after distillation", top: int = fixed.TOP_FILES) -> str:
    """Write the totals and the top files as Parquet, and return the report as Markdown.

    Only the one row of totals and the top rows reach the driver.
    """
    totals, best = R.size_totals(sizes), R.top_savings(sizes, top)
    totals.coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")
    best.coalesce(1).write.mode("overwrite").parquet(f"{folder}/top")
    spark = sizes.sparkSession
    t = spark.read.parquet(f"{folder}/totals").first()
    rows = spark.read.parquet(f"{folder}/top").orderBy(F.desc("saving"), "path").collect()
    lines = [f"# {title}", "", "| files | bytes before | bytes after | bytes saved | saved |", "|-:|-:|-:|-:|-:|"]
    lines += [f"| {t.n_files:,} | {t.original:,} | {t.distilled:,} | {t.saving:,} | {t.saving_pct:.1f} % |"]
    lines += ["", f"The {len(rows)} files that save most:", "", "| path | before | after | saved | saved |", "|-|-:|-:|-:|-:|"]
    lines += [f"| {r.path} | {r.original:,} | {r.distilled:,} | {r.saving:,} | {r.saving_pct:.1f} % |" for r in rows]
    return "\n".join(lines)
