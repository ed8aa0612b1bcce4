"""Read and reference sources. Every reader gives the columns rdid, name, seq, qual (and mate columns where it has them).

Formats with records of several lines are read with a record separator, so files are split and read in parallel; record
numbers come from the place in the file, so they stay the same when a task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxonflow.functions import dna

FORMATS = ("fasta", "fastq", "tab5", "tab6", "qseq", "raw", "fasta_cont")


def _numbered(df: DataFrame) -> DataFrame:
    """rdid by file and place. Rows stay where they are; one number a file partition is summed up and broadcast."""
    marked = df.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    counts = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    start = counts.select(F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_start"))
    placed = marked.join(F.broadcast(start), F.col("_p") == F.col("_q"))
    return placed.withColumn("rdid", F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_q", "_start")


def _bases(seq: Column) -> Column:
    return F.regexp_replace(F.upper(F.translate(seq, ".", "N")), "[^ACGTNRYSWKMBDHV]", "")


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """'>' names a record with its whole line; '#' and ';' lines are skipped; an empty record keeps its number; a record
    without name takes its number; qualities are 'I'."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumnRenamed("value", "v")
    raw = raw.withColumn("v", F.regexp_replace(F.regexp_replace("v", "\r", ""), r"(?m)^[#;].*\n?", "")).where("trim(v) <> ''")
    rec = _numbered(raw)
    body = F.regexp_replace("v", "^>", "")
    name = F.substring_index(body, "\n", 1)
    seq = _bases(F.when(F.instr(body, "\n") > 0, F.expr("substring(regexp_replace(v, '^>', ''), instr(regexp_replace(v, '^>', ''), '\n') + 1)")).otherwise(""))
    return rec.select("rdid", F.when(name == "", F.col("rdid").cast("string")).otherwise(name).alias("name"), seq.alias("seq")).withColumn("qual", F.expr("repeat('I', length(seq))"))


def fastq(spark: SparkSession, path: str | list[str], encoding: str = "phred33") -> DataFrame:
    """Records of four lines. A record's place is its line number, so lines are numbered first and grouped by four."""
    lines = _numbered(spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", ""))).withColumnRenamed("rdid", "line")
    four = lines.groupBy(F.floor(F.col("line") / 4).alias("rdid")).agg(F.max(F.when(F.col("line") % 4 == 0, F.col("value"))).alias("h"), F.max(F.when(F.col("line") % 4 == 1, F.col("value"))).alias("s"), F.max(F.when(F.col("line") % 4 == 3, F.col("value"))).alias("q"))
    name = F.regexp_replace("h", "^@", "")
    return four.where("h is not null and s is not null").select("rdid", F.when(name == "", F.col("rdid").cast("string")).otherwise(name).alias("name"), _bases(F.col("s")).alias("seq"), dna.phred33(F.coalesce("q", F.lit("")), encoding).alias("qual"))


def tabbed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """3 (unpaired), 5 (pair, one name) or 6 (pair, two names) tab-separated fields."""
    t = _numbered(spark.read.text(path)).withColumn("f", F.split("value", "\t"))
    n = F.size("f")
    f = lambda i: F.get("f", F.lit(i))
    return t.select(
        "rdid", f(0).alias("name"), _bases(f(1)).alias("seq"), f(2).alias("qual"),
        F.when(n == 6, f(3)).when(n == 5, f(0)).alias("name2"), _bases(F.when(n == 6, f(4)).when(n == 5, f(3))).alias("seq2"), F.when(n == 6, f(5)).when(n == 5, f(4)).alias("qual2"),
    )


def qseq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """11 fields: the name is the first seven joined by '_', then '/' and the mate; the last is the filter flag."""
    t = _numbered(spark.read.text(path)).withColumn("f", F.split("value", "\t")).where(F.size("f") == 11)
    name = F.concat(F.array_join(F.slice("f", 1, 7), "_"), F.lit("/"), F.get("f", F.lit(7)))
    return t.select("rdid", name.alias("name"), _bases(F.get("f", F.lit(8))).alias("seq"), F.get("f", F.lit(9)).alias("qual"), F.get("f", F.lit(10)).alias("filter"))


def raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    t = _numbered(spark.read.text(path).where("trim(value) <> ''"))
    return t.select("rdid", F.col("rdid").cast("string").alias("name"), _bases(F.col("value")).alias("seq")).withColumn("qual", F.expr("repeat('I', length(seq))"))


def literal(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Sequences given in the call, each 'seq' or 'seq:qualities'."""
    rows = [(i, str(i), *(t.split(":", 1) + [None])[:2]) for i, t in enumerate(texts)]
    t = spark.createDataFrame(rows, "rdid long, name string, s string, q string")
    return t.select("rdid", "name", _bases(F.col("s")).alias("seq"), F.coalesce("q", F.expr("repeat('I', length(s))")).alias("qual"))


def windows(records: DataFrame, length: int, every: int) -> DataFrame:
    """FASTA-continuous: windows of ``length`` every ``every`` letters, named after the first word and the offset."""
    n = F.length("seq")
    cut = records.where(n >= length).withColumn("at", F.explode(F.sequence(F.lit(0), n - length, F.lit(every))))
    piece = F.regexp_replace(F.substring(F.col("seq"), F.col("at") + 1, F.lit(length)), "[^ACGT]", "N")
    return cut.select(F.concat(F.substring_index("name", " ", 1), F.lit("_"), F.col("at").cast("string")).alias("name"), piece.alias("seq"), F.expr(f"repeat('I', {length})").alias("qual"))


def read(spark: SparkSession, path: str | list[str], fmt: str = "fastq", **options) -> DataFrame:
    """Reader by format name."""
    if fmt == "fasta_cont":
        return windows(fasta(spark, path), options["length"], options["every"])
    table = {"fasta": fasta, "fastq": fastq, "tab5": tabbed, "tab6": tabbed, "qseq": qseq, "raw": raw}
    if fmt not in table:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(FORMATS)}")
    return table[fmt](spark, path, **options)


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sources zipped by record number; they must have equally many records."""
    a, b = first.count(), second.count()
    if a != b:
        raise ValueError(f"mate files differ in length: {a} and {b} records")
    m = second.select(F.col("rdid"), F.col("name").alias("name2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return first.join(m, "rdid")


def interleaved(source: DataFrame) -> DataFrame:
    """Mates in consecutive records."""
    half = F.col("rdid") % 2
    g = source.groupBy(F.floor(F.col("rdid") / 2).alias("rdid"))
    pick = lambda c, k, as_: F.max(F.when(half == k, F.col(c))).alias(as_)
    return g.agg(pick("name", 0, "name"), pick("seq", 0, "seq"), pick("qual", 0, "qual"), pick("name", 1, "name2"), pick("seq", 1, "seq2"), pick("qual", 1, "qual2"))


def mixed(sources: list[DataFrame]) -> DataFrame:
    """Several sources one after another, with their number as file_idx."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("file_idx", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def sample_sheet(spark: SparkSession, path: str) -> list[dict]:
    """Rows of type (1 single, 2 paired), file1, file2, output, report; pairs first."""
    rows = spark.read.option("sep", "\t").schema("type int, file1 string, file2 string, output string, report string").csv(path).collect()  # one row a sample
    bad = [r for r in rows if r["type"] not in (1, 2) or r["file1"] is None or (r["type"] == 2 and r["file2"] is None)]
    if bad:
        raise ValueError(f"bad sample sheet row: {bad[0]}")
    return sorted((r.asDict() for r in rows), key=lambda r: -r["type"])


def samples(spark: SparkSession, sheet: list[dict], fmt: str = "fastq") -> DataFrame:
    """All samples of a sheet as one source with sample_id."""
    out = None
    for i, r in enumerate(sheet):
        s = read(spark, r["file1"], fmt)
        s = paired(s, read(spark, r["file2"], fmt)) if r["type"] == 2 else s
        s = s.withColumn("sample_id", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, tid, parent_tid, tax_rank, leaf) of a nodes file; of the rank only the first word counts."""
    t = _numbered(spark.read.text(path)).withColumn("f", F.split("value", r"\s*\|\s*")).where(F.size("f") >= 3)
    f = lambda i: F.trim(F.get("f", F.lit(i)))
    word = F.substring_index(f(2), " ", 1)
    return t.select(F.col("rdid").alias("line_no"), f(0).cast("bigint").alias("tid"), f(1).cast("bigint").alias("parent_tid"), F.when(word == "no", "no rank").otherwise(word).alias("tax_rank"), F.lit(False).alias("leaf"))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name): scientific names, the last one of a tid wins."""
    t = _numbered(spark.read.text(path)).where(F.col("value").contains("scientific name")).withColumn("f", F.split("value", r"\s*\|\s*"))
    rows = t.select("rdid", F.trim(F.get("f", F.lit(0))).cast("bigint").alias("tid"), F.trim(F.get("f", F.lit(1))).alias("name"))
    return rows.where("tid is not null").groupBy("tid").agg(F.max_by("name", "rdid").alias("name"))


def conversion(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(uid, tid): pairs separated by white space, '#' comments, first mapping wins."""
    t = _numbered(spark.read.text(path).where("trim(value) <> '' and value not like '#%'")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    rows = t.select("rdid", F.get("f", F.lit(0)).alias("uid"), dna.packed_taxid(F.get("f", F.lit(1))).alias("tid"))
    return rows.where("tid is not null").groupBy("uid").agg(F.min_by("tid", "rdid").alias("tid"))


def size_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("tid bigint, size bigint").csv(path).where("tid is not null")


def accession_map(spark: SparkSession, path: str | list[str], wanted: DataFrame) -> DataFrame:
    """(ac, taxid) of the wanted accessions (a column ac) from an accession-to-taxon file with a header; plain or gz."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("accession string, ac string, taxid bigint, gi bigint").csv(path)
    return rows.join(wanted.select("ac").distinct(), "ac", "left_semi").select("ac", "taxid")


def assemblies(rows: DataFrame, level: str | None = None, category: str | None = None, taxids: list[int] | None = None) -> DataFrame:
    """The row filter of an assembly summary: latest version, level, category, taxa."""
    out = rows.where("version_status = 'latest'")
    out = out.where(F.col("assembly_level") == level) if level else out
    out = out.where(F.col("refseq_category") == category) if category else out
    return out.where(F.col("taxid").isin(taxids)) if taxids else out


def by_taxon_and_place(refs: DataFrame) -> DataFrame:
    """Sequences ordered by taxon, then place in the file (a range-partitioned sort)."""
    return refs.orderBy("taxid", "file_pos")
