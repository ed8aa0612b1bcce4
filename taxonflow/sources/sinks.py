"""Result sinks: assignment tables, reports, read files, metrics, index tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Column names of the assignment table, and what other output names stand for.
DEFAULT_COLUMNS = ["readID", "seqID", "taxID", "score", "2ndBestScore", "hitLength", "queryLength", "numMatches"]
ALIASES = {
    "taxLevel": "taxRank", "QNAME": "readID", "FLAG": "PLACEHOLDER_ZERO", "RNAME": "taxID", "POS": "PLACEHOLDER_ZERO", "MAPQ": "PLACEHOLDER_ZERO", "CIGAR": "PLACEHOLDER",
    "RNEXT": "seqID", "PNEXT": "PLACEHOLDER_ZERO", "TLEN": "queryLength", "SEQ": "readSeq", "QUAL": "readQual", "SEQ1": "readSeq1", "SEQ2": "readSeq2", "QUAL1": "readQual1", "QUAL2": "readQual2",
}
SAM_COLUMNS = ["QNAME", "FLAG", "RNAME", "POS", "MAPQ", "CIGAR", "RNEXT", "PNEXT", "TLEN", "SEQ", "QUAL"]


def projected(assignments: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The chosen output columns; a name that is neither a column nor an alias is an error."""
    out = []
    for c in columns or DEFAULT_COLUMNS:
        source = ALIASES.get(c, c)
        if source == "PLACEHOLDER":
            out.append(F.lit("*").alias(c))
        elif source == "PLACEHOLDER_ZERO":
            out.append(F.lit(0).alias(c))
        elif source in assignments.columns:
            out.append(F.col(f"`{source}`").alias(c))
        else:
            raise ValueError(f"unknown output column {c}")
    return assignments.select(*out)


def write_assignments(assignments: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "tab", include_unclassified: bool = True, order_by: str | None = None) -> None:
    """Tab-separated table with a header, or the SAM-like table without one."""
    rows = assignments if include_unclassified else assignments.where("taxID <> 0")
    rows = rows.orderBy(order_by) if order_by else rows
    rows = projected(rows, columns or (SAM_COLUMNS if fmt == "sam" else None))
    rows.write.mode("overwrite").option("sep", "\t").option("header", fmt != "sam").csv(path)


def write_report(report: DataFrame, path: str, sample: str | None = None) -> None:
    """The per-taxon report ordered by taxon; with ``sample`` one folder for each sample."""
    w = report.orderBy("taxID").write.mode("overwrite").option("sep", "\t").option("header", True)
    (w.partitionBy(sample) if sample else w).csv(path)


def write_tree_report(report: DataFrame, path: str) -> None:
    cols = [F.format_string("%6.2f", "pct"), "clade", "own", "rank_code", "tid", "label"]
    report.orderBy("sort_key").select(*cols).write.mode("overwrite").option("sep", "\t").option("ignoreLeadingWhiteSpace", False).csv(path)


def write_reads(reads: DataFrame, path: str, fmt: str = "fasta", compression: str = "none") -> None:
    """Reads as FASTA or FASTQ text, plain, gzip or bzip2."""
    text = F.concat(F.lit(">"), "name", F.lit("\n"), "seq") if fmt == "fasta" else F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    reads.select(text.alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Each index table as parquet below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def read_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(path, n)) for n in names}


def observed(assignments: DataFrame, name: str = "metrics") -> tuple[DataFrame, Observation]:
    """Assignments with counters that are filled by whatever action runs on them."""
    o = Observation(name)
    n = F.col("numMatches")
    return assignments.observe(o, F.count(F.lit(1)).alias("rows"), F.sum((F.col("taxID") == 0).cast("long")).alias("unclassified"), F.sum((n == 1).cast("long")).alias("unique")), o


def append_results(results: DataFrame, path: str) -> None:
    """Accuracy figures added to a table of runs."""
    results.write.mode("append").parquet(path)
