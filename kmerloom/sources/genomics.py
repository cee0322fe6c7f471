"""Text formats of genomics as DataFrames: FASTA, FASTQ, SAM, GFF3, VCF, BED, TSV, XMFA, GFA and their writers.

Line formats are read by spark.read.text and stay lazy; formats whose records span lines use a record separator, so a
file still splits between records.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.sequence import reverse_complement


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq); the records of a file split at lines that begin with >."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")
    return rows.where(F.length(F.trim("value")) > 0).select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual) of four-line records; a record begins where a line starts with @ and a + line follows its letters."""
    rows = spark.read.text(path, wholetext=True)
    found = F.regexp_extract_all("value", F.lit(r"(?m)^(@[^\n]*\n[A-Za-z.*\-]*\r?\n\+[^\n]*\n[^\n]*)"), F.lit(1))
    parts = rows.select(F.explode(found).alias("r")).select(F.split("r", "\r?\n").alias("p"))
    return parts.select(F.regexp_extract(F.col("p")[0], r"^@(\S*)", 1).alias("name"), F.col("p")[1].alias("seq"), F.col("p")[3].alias("qual"))


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, end, name, seq, qual) by extension, `a:b` as pairs; FASTA and plain text get quality I."""
    out = None
    paths = path.split(":")
    if len(paths) > 2:
        raise ValueError("a pair has two files")
    for end, p in enumerate(paths, 1):
        plain = p.removesuffix(".gz")
        if plain.endswith((".fq", ".fastq")):
            rows = read_fastq(spark, p)
        elif plain.endswith((".fa", ".fasta", ".fna")):
            rows = read_fasta(spark, p).select("name", "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
        elif plain.endswith(".sam"):
            rows = read_sam(spark, p).select("name", "seq", "qual")
        else:
            rows = spark.read.text(p).select(F.xxhash64("value").cast("string").alias("name"), F.col("value").alias("seq"), F.repeat(F.lit("I"), F.length("value")).alias("qual"))
        rows = rows.select(F.regexp_replace("name", r"/[12]$", "").alias("read_id"), F.lit(end).alias("end"), "name", "seq", "qual")
        out = rows if out is None else out.union(rows)
    return out


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").startswith("@")).select(p[0].alias("name"), p[1].cast("int").alias("flag"), p[2].alias("contig"), p[3].cast("long").alias("pos"), p[4].cast("int").alias("mq"), p[5].alias("cigar"), p[9].alias("seq"), p[10].alias("qual"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(contig, source, type, start, stop, strand, attrs) of rows with an ID; lines after ##FASTA have no nine columns."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(p) >= 9))
    out = rows.select(p[0].alias("contig"), p[1].alias("source"), p[2].alias("type"), p[3].cast("long").alias("start"), p[4].cast("long").alias("stop"), F.when(p[6] == "+", "+").otherwise("-").alias("strand"), F.str_to_map(p[8], F.lit(";"), F.lit("=")).alias("attrs"))
    return out.where(F.col("attrs")["ID"].isNotNull())


def gff_line(contig: Column, source: Column, kind: Column, start: Column, stop: Column, strand: Column, attrs: Column) -> Column:
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return F.concat_ws("\t", contig, source, kind, start, stop, F.lit("."), strand, F.lit("."), pairs)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    return rows.select(p[0].alias("contig"), p[1].cast("long").alias("start"), (p[1].cast("long") + F.length(p[3]) - 1).alias("stop"), p[2].alias("id"), p[3].alias("ref"), p[4].alias("alt"), F.split(p[6], ";").alias("filters"), F.str_to_map(p[7], F.lit(";"), F.lit("=")).alias("attrs"))


def vcf_lines(variants: DataFrame) -> DataFrame:
    """One line for each (contig, start, ref, alt), sorted, without genotypes."""
    info = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
    rows = variants.dropDuplicates(["contig", "start", "ref", "alt"]).orderBy("contig", "start", "ref", "alt")
    return rows.select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.coalesce("id", F.lit(".")), "ref", "alt", F.lit("."), F.array_join("filters", ";"), info).alias("value"))


def read_bed(spark: SparkSession, path: str, label: str = "core") -> DataFrame:
    p = F.split("value", "\t")
    rows = spark.read.text(path)
    return rows.select(p[0].alias("chrom"), p[1].cast("long").alias("start"), p[2].cast("long").alias("stop"), F.coalesce(F.get(p, F.lit(3)), F.lit(label)).alias("label"))


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """All columns as strings; names from the first line or as given (then every line is data)."""
    rows = spark.read.option("sep", sep).option("header", columns is None).option("inferSchema", False).csv(path)
    return rows.toDF(*columns) if columns else rows


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def read_xmfa(spark: SparkSession, path: str) -> DataFrame:
    """(block, name, contig, seq): blocks end at lines that begin with =."""
    blocks = spark.read.option("lineSep", "\n=").text(path).withColumn("block", F.monotonically_increasing_id())
    rows = blocks.select("block", F.explode(F.split("value", "(?:^|\n)>")).alias("r")).where(F.col("r").rlike(r"^\s*\d+:|^\s*\S+\s"))
    head = F.regexp_extract("r", r"^\s*([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n", ""), r"\s", "")
    return rows.where(F.length(seq) > 0).select("block", F.regexp_extract(head, r"(\S+)\s*$", 1).alias("name"), F.regexp_extract(head, r"^(\S+)", 1).alias("contig"), seq.alias("seq"))


def fasta_lines(rows: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    return rows.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value"))


def gfa_lines(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """H, S (name, seq) and L (a, a_strand, b, b_strand) lines."""
    spark = vertices.sparkSession
    s = vertices.select(F.concat_ws("\t", F.lit("S"), "name", "seq").alias("value"))
    link = edges.select(F.concat_ws("\t", F.lit("L"), "a", "a_strand", "b", "b_strand", F.lit(f"{k - 1}M")).alias("value"))
    return spark.range(1).select(F.lit("H\tVN:Z:1.0").alias("value")).union(s).union(link)


def subsequence(reference: DataFrame, intervals: DataFrame) -> DataFrame:
    """intervals (contig, start, stop, strand), 1-based closed, with their letters; out of range: null."""
    rows = intervals.join(reference, "contig", "left")
    inside = (F.col("start") >= 1) & (F.col("stop") <= F.length("seq")) & (F.col("start") <= F.col("stop"))
    letters = F.substr("seq", F.col("start").cast("int"), (F.col("stop") - F.col("start") + 1).cast("int"))
    return rows.withColumn("letters", F.when(inside, F.when(F.col("strand") == "-", reverse_complement(letters)).otherwise(letters))).drop("seq")


def coding_sequence(exons: DataFrame, reference: DataFrame, gene: str = "gene") -> DataFrame:
    """Exons of a gene in order of start, joined, and turned round on the reverse strand."""
    parts = subsequence(reference, exons.withColumnRenamed("strand", "_strand").withColumn("strand", F.lit("+")))
    rows = parts.groupBy(gene, "_strand").agg(F.array_sort(F.collect_list(F.struct("start", "letters"))).alias("e"))
    seq = F.array_join(F.transform("e", lambda x: x["letters"]), "")
    return rows.select(gene, F.when(F.col("_strand") == "-", reverse_complement(seq)).otherwise(seq).alias("seq"))
