"""Writers for result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrites path; CSV gets a header."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("header", "true") if fmt == "csv" else w).format(fmt).save(path)


def latex_table(df: DataFrame, caption: str, digits: int = 4) -> str:
    """A small result table (a row per test) as LaTeX."""

    def cell(v) -> str:
        if v is None:
            return "--"
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")

    head = " & ".join(c.replace("_", r"\_") for c in df.columns)
    body = "\n".join(" & ".join(cell(v) for v in row) + r" \\" for row in df.collect())
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", head + r" \\", r"\hline", body, r"\hline", r"\end{tabular}", r"\end{table}"])
