import pytest

from kmerloom.operators import graph as G
from kmerloom.operators.traverse import LocalGraph
from kmerloom.sources import genomics, graphs


def test_graph_round_trip(spark, tmp_path):
    rows = [(ck, c, *x) for ck, own in LocalGraph.of([(0, "AGTTCTGATCTGGGCTATATGCT"), (1, "AGTTCGAATCTGGGCTATATGCT")], 5).rows.items() for c, x in own.items()]
    df = spark.createDataFrame(rows, "ck string, color int, cov long, in_mask int, out_mask int")
    path = str(tmp_path / "g.ctx")
    graphs.write_graph(df, path, 5, ["mom", "dad"])
    with open(path, "rb") as f:
        h = graphs.read_header(f.read())
    assert (h["k"], h["colors"], [x["sample_name"] for x in h["facts"]]) == (5, 2, ["mom", "dad"])
    assert sorted(map(tuple, graphs.read_graph(spark, path).collect())) == sorted(rows)
    with pytest.raises(ValueError):
        graphs.read_header(b"no graph")


def test_links():
    text = graphs.write_links({"format_version": 4}, [("ATCGA", [(False, -1, 3, [1], "GGC")]), ("ATCGC", [(False, -1, 1, [1], "C"), (False, -1, 2, [1], "GC")])])
    header, links = graphs.parse_links(text)
    assert header["format_version"] == 4 and links[0] == ("ATCGA", [(False, -1, 3, [1], "GGC")]) and len(links[1][1]) == 2


def test_text_graph(spark):
    df = spark.createDataFrame([("AAT 1 1 ....A... ......G.",), ("ATA 1 0 a....... ........",)], "line string")
    rows = G.from_text(df)
    assert sorted(map(tuple, rows.where("cov > 0").collect())) == [("AAT", 0, 1, 0, 1), ("AAT", 1, 1, 0, 4), ("ATA", 0, 1, 1, 0)]
    assert {r["line"] for r in G.text(rows, 2).collect()} == {"AAT 1 1 ....A... ......G.", "ATA 1 0 a....... ........"}


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACGT\nAC\n>y\nGG\n")
    assert [tuple(r) for r in genomics.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("name").collect()] == [("x", "one", "ACGTAC"), ("y", "", "GG")]
    (tmp_path / "a.fq").write_text("@r1/1\nACGT\n+\nIIII\n@r2/1\nGG\n+\n@I\n")
    assert [tuple(r) for r in genomics.read_reads(spark, str(tmp_path / "a.fq")).orderBy("name").collect()] == [("r1", 1, "r1/1", "ACGT", "IIII"), ("r2", 1, "r2/1", "GG", "@I")]
    (tmp_path / "a.gff").write_text("##gff-version 3\nc\ts\tgene\t1\t4\t.\t-\t.\tID=g1;Name=n\nc\ts\tgene\t1\t4\t.\t+\t.\tName=m\n")
    assert [(r["start"], r["strand"], r["attrs"]["ID"]) for r in genomics.read_gff(spark, str(tmp_path / "a.gff")).collect()] == [(1, "-", "g1")]
    (tmp_path / "a.vcf").write_text("#h\nc\t3\tid\tAC\tA\t.\tPASS\tX=1;Y\n")
    r = genomics.read_vcf(spark, str(tmp_path / "a.vcf")).first()
    assert (r["start"], r["stop"], r["attrs"]["X"]) == (3, 4, "1")
    ref = spark.createDataFrame([("c", "AACCGGTT")], "contig string, seq string")
    iv = spark.createDataFrame([("c", 1, 3, "-"), ("c", 7, 9, "+")], "contig string, start long, stop long, strand string")
    assert {r["letters"] for r in genomics.subsequence(ref, iv).collect()} == {"GTT", None}
    ex = spark.createDataFrame([("g", "c", 5, 6, "-"), ("g", "c", 1, 2, "-")], "gene string, contig string, start long, stop long, strand string")
    assert genomics.coding_sequence(ex, ref).first()["seq"] == "CCTT"
