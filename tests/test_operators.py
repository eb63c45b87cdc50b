"""Error paths and edge cases on small tables written here."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from varloom.functions import metrics as M
from varloom.functions import parsing as P
from varloom.operators import joins as J
from varloom.operators import profiles as O
from varloom.operators import splits as S
from varloom.operators import thresholds as T
from varloom.operators.base import numbered, running_sums
from varloom.sources import vcf
from varloom.streaming.counters import batch_counters, stream_counters


def one(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@pytest.mark.parametrize("cell", ["tp", "tn", "fp", "fn"])
def test_single_cell_matrices(spark, cell):
    cells = {c: (5 if c == cell else 0) for c in ("tp", "tn", "fp", "fn")}
    row = T.with_metrics(one(spark, **cells)).first()
    assert row["mcc"] == 0.0
    assert row["f1"] == (1.0 if cell == "tp" else 0.0)
    assert 0.0 <= row["mcc_score"] <= 1.0
    assert (row["fnr"] is None) == (cell in ("tn", "fp"))


def test_outcome_refuses_other_labels(spark):
    with pytest.raises(Exception, match="must be 0 or 1"):
        one(spark, p=2, y=1).select(M.outcome(F.col("p"), F.col("y"))).collect()


def test_ties_in_roc(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "s double, y int")
    assert T.roc_auc(df, F.col("s"), F.col("y")).first()["auc"] == pytest.approx(0.75)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(0.5, 1), (0.4, 1)], "s double, y int")
    assert T.roc_auc(df, F.col("s"), F.col("y")).first()["auc"] is None


def test_optimum_keeps_all_ties(spark):
    df = spark.createDataFrame([(0.1, 0.9), (0.2, 0.9), (0.3, 0.5)], "threshold double, mcc_score double")
    row = T.optimum(df, "mcc_score").first()
    assert row["thresholds"] == [0.1, 0.2] and row["mean_threshold"] == pytest.approx(0.15)
    with pytest.raises(ValueError):
        T.optimum(df, "accuracy")


def test_numbered_and_running_sums_over_many_partitions(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 7 % 1000).alias("k"))
    assert [r["n"] for r in numbered(df, [F.col("k")]).orderBy("k").collect()] == list(range(1000))
    got = running_sums(df, [F.desc("k")], {"c": "k"}).orderBy(F.desc("k")).first()
    assert got["c"] == 999


def test_folds(spark):
    df = spark.range(25)
    assert S.folds(df, [F.col("id")], size=10).count() == 20
    assert S.folds(df, [F.col("id")], size=100).select("fold").distinct().count() == 1
    with pytest.raises(ValueError):
        S.folds(df, [F.col("id")], size=0)


def test_balance_needs_both_classes(spark):
    df = spark.createDataFrame([(1,), (1,)], "y int")
    with pytest.raises(Exception, match="no rows"):
        S.class_balance(df, F.col("y")).select("bias").collect()


def test_split_refuses_large_test_share(spark):
    with pytest.raises(ValueError):
        S.split_by_source(spark.range(2).withColumn("origin", F.lit("BOTH")), "id", "origin", 0.6)


def test_mark_report_without_match_is_an_error(spark):
    a = spark.createDataFrame([(1,)], "id int")
    b = spark.createDataFrame([(2,)], "id int")
    with pytest.raises(Exception, match="no row of the truth set"):
        J.mark_report(a, b, ["id"]).collect()


def test_severity(spark):
    row = one(spark, c="stop_gained&intron_variant").select(P.severity(F.col("c")).alias("s")).first()
    assert row["s"] == 38 + 14
    with pytest.raises(Exception, match="unknown consequence"):
        one(spark, c="made_up").select(P.severity(F.col("c"))).collect()


@pytest.mark.parametrize(
    ("others", "worst"),
    [
        ("downstream_gene_variant", "upstream_gene_variant"),
        ("start_lost", "start_lost&NMD_transcript_variant"),
        ("intron_variant&NMD_transcript_variant", "stop_gained&frameshift_variant"),
        ("splice_acceptor_variant", "splice_acceptor_variant&non_coding_transcript_variant"),
        ("intron_variant", "intron_variant&NMD_transcript_variant"),
        ("feature_truncation", "feature_elongation"),
        ("sequence_variant", "intergenic_variant"),
        ("synonymous_variant", "stop_retained_variant"),
    ],
)
def test_the_worst_consequence(spark, others, worst):
    for entries in ((others, worst), (worst, others), (others, worst, others)):
        csq = ",".join(f"A|{c}|x" for c in entries)
        row = one(spark, c=csq).select(P.worst_transcript(F.col("c"), ["Allele", "Consequence", "Other"]).alias("w")).first()
        assert row["w"]["Consequence"] == worst


def test_fixed_tables():
    from varloom.plans.records import TERMS

    assert list(P.CONSEQUENCES.values()) == list(range(41, 0, -1)) and tuple(P.CONSEQUENCES) == TERMS
    assert sum(P.CLINICAL.values()) == 5 and len(P.CLINICAL) == 10 and len(P.MASKED) == 9 and not set(P.MASKED) & set(P.CLINICAL)


def test_typed_values(spark):
    t = lambda v: one(spark, v=v).select(P.typed(F.col("v")).alias("t")).first()["t"]
    assert t(" 1.5e3 ")["number"] == 1500.0 and t(" abc ")["text"] == "abc" and t("abc")["kind"] == "text"
    with pytest.raises(Exception, match="cannot be coerced"):
        t("a\x07b")
    row = one(spark, a="", b="x").select(P.stand_in(F.col("a")).alias("a"), P.stand_in(F.col("b")).alias("b"), P.stand_in(F.lit(3.0), True).alias("c"), P.stand_in(F.lit(None), True).alias("d")).first()
    assert tuple(row) == ("N/A", "x", "numtype", "N/A")
    with pytest.raises(Exception, match="unknown label"):
        one(spark, a="unsure").select(P.binary_label(F.col("a"))).collect()


def test_worst_transcript_first_of_equals_and_arity(spark):
    fields = ["Allele", "Consequence"]
    row = one(spark, c="A|stop_gained,B|stop_gained,C|intron_variant").select(P.worst_transcript(F.col("c"), fields).alias("w")).first()
    assert row["w"]["Allele"] == "A"
    with pytest.raises(Exception, match="wrong number of fields"):
        one(spark, c="A|stop_gained|x").select(P.worst_transcript(F.col("c"), fields)).collect()
    assert P.csq_fields("Consequences. Format: Allele|Consequence") == fields


def test_labels(spark):
    with pytest.raises(Exception, match="unknown keyword"):
        one(spark, c="brand_new").select(P.clinical_label(F.col("c"))).collect()
    assert one(spark, c="brand_new").select(P.clinical_label(F.col("c"), strict=False).alias("x")).first()["x"] is None
    two = one(spark, a="benign", b="pathogenic")
    with pytest.raises(Exception, match="exactly one label source"):
        two.select(P.only_label({"a": P.binary_label(F.col("a")), "b": P.binary_label(F.col("b"))})).collect()


def test_small_parsers(spark):
    row = one(spark, a="fam:1.5", b="x:1:2", c="a%3Db%2C", d="['T']", e="1_000", f="5f").select(
        P.pair(F.col("a")).alias("a"), P.triple(F.col("b")).alias("b"), P.unescape(F.col("c")).alias("c"), P.allele(F.col("d")).alias("d"), P.number(F.col("e")).alias("e"), P.number(F.col("f")).alias("f")
    )
    got = row.first()
    assert got["a"]["number"] == 1.5 and got["b"]["high"] == 2.0 and got["c"] == "ab" and got["d"] == "T" and got["e"] is None and got["f"] is None
    with pytest.raises(Exception, match="expected two parts"):
        one(spark, a="1:2:3").select(P.two_parts(F.col("a"))).collect()


def test_explanation_round_trip(spark):
    text = one(spark, x=0.5, y=-0.25).select(P.explanation({"x": F.col("x"), "y": F.col("y"), "z": F.lit(None).cast("double")}).alias("t"))
    assert text.first()["t"] == "[x=0.50,y=-0.25,]"
    assert text.select(P.parse_explanation(F.col("t")).alias("m")).first()["m"] == {"x": "0.50", "y": "-0.25"}


def test_vcf_files(spark, tmp_path):
    head = '##INFO=<ID=AF,Number=1,Type=Float,Description="f">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n'
    (tmp_path / "a.vcf").write_text(head + "1\t10\t.\tA\tT,C\t.\tPASS\tAF=0.5;DB\n")
    with gzip.open(tmp_path / "b.vcf.gz", "wt") as f:
        f.write(head.replace("Float", "String") + "2\t20\tx\tG\tC\t9.5\t.\tAF=\n")
    with gzip.open(tmp_path / "b.vcf.gz", "at") as f:  # a second member
        f.write("3\t30\ty\tG\tC\t1\t.\tDB\n")
    text = vcf.lines(spark, [str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf.gz")])
    got = vcf.records(text).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [10, 20, 30]
    assert got[0]["alt"] == ["T", "C"] and got[0]["id"] is None and got[0]["info"] == {"AF": "0.5", "DB": None}
    assert vcf.count_records(text).first()["n_records"] == 3
    assert vcf.header_conflicts(vcf.header(text)).first()["id"] == "AF"
    assert vcf.split_alleles(vcf.records(text)).count() == 4


def test_headerless_file(spark, tmp_path):
    (tmp_path / "c.vcf").write_text("1\t10\tq\tA\tT\n")
    assert vcf.records(vcf.lines(spark, str(tmp_path / "c.vcf"))).first()["id"] == "q"


def test_near_texts_equals_brute_force(spark):
    import itertools
    import random

    random.seed(3)
    data = {i: [random.choice("abcdefgh") for _ in range(random.randint(1, 9))] for i in range(40)}
    df = spark.createDataFrame(list(data.items()), "id int, t array<string>")

    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    want = {(i, j) for i, j in itertools.permutations(data, 2) if 2 * lcs(data[i], data[j]) / (len(data[i]) + len(data[j])) > 0.5}
    assert {(r["src"], r["dst"]) for r in J.near_texts(df, "id", "t").collect()} == want


def test_profiles_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k int, a double, b double")
    assert O.fit_columns(empty, ["a", "b"]).count() == 0
    assert O.histogram(empty, F.col("a"), 10, 0.0, 1.0).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-0{1 + i % 3} 00:00:00", float(i * 10), "error" if i % 4 == 0 else "view") for i in range(30)], "t string, value double, event_type string")
    events = events.select(F.to_timestamp("t").alias("ts"), "value", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = stream_counters(spark, str(tmp_path / "in"), events.schema)
    q = stream.writeStream.format("memory").queryName("counters").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counters").collect())) == sorted(map(tuple, batch_counters(events).collect()))


def test_equal_texts_are_compared_once(spark):
    """Rows of few texts, NULL tokens among them: the links of the texts are spread over their rows (4,000,000 pairs of rows took minutes each by itself)."""
    import time

    texts = [["a", "b", "c"], ["a", "b", "d"], ["x", "y"], ["a", None, "b"], [None, None], ["y", "x"], []]
    rows = [(i, texts[i % 7]) for i in range(2100)]
    df = spark.createDataFrame([*rows, (None, ["a", "b", "c"]), (5000, None)], "id int, t array<string>")
    began = time.monotonic()
    got = J.near_texts(df, "id", "t", asked=F.col("id") % 10 == 0)
    by = {(r["a"], r["b"]): (r["n"], r["f"]) for r in got.groupBy((F.col("src") % 7).alias("a"), (F.col("dst") % 7).alias("b")).agg(F.count("*").alias("n"), F.max("f").alias("f")).collect()}
    same, two = (30 * 299, 1.0), (30 * 300, 4 / 6)
    assert by == {(0, 0): same, (1, 1): same, (2, 2): same, (5, 5): same, (3, 3): (30 * 299, 4 / 6)} | {(i, j): two for i in (0, 1, 3) for j in (0, 1, 3) if i != j}
    everything = J.near_texts(df, "id", "t").count()
    assert everything == 900 * 899 + 2 * 300 * 299 and time.monotonic() - began < 90


def test_a_frequent_key_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "PIECE", 50)
    monkeypatch.setattr(J, "PAIRS_A_TASK", 1000)
    rows = spark.range(1000).selectExpr("id AS dst", "if(id < 900, 0, id) AS k")
    asked = spark.range(20).selectExpr("id AS src", "if(id < 15, 0, 900 + id) AS k")
    got = J.met(asked, rows, ["k"], "dst").withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == sorted([(i, j) for i in range(15) for j in range(900)] + [(i, 900 + i) for i in range(15, 20)])
    most = max(sum(r["p"] == p for r in got) for p in {r["p"] for r in got})
    assert most < len(got) / 2, "no task makes most of the pairs"
    assert J.met(asked.limit(0), rows, ["k"], "dst").count() == 0


def test_dot_links_meet_in_blocks(spark, monkeypatch):
    """Small blocks, NULLs, other lengths and empty vectors: the products are those of plain sums, over the largest."""
    import random

    monkeypatch.setattr(J, "BLOCK", (3, 5))
    rng = random.Random(4)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(6)] for i in range(30)} | {30: None, 31: [1.0, None, 2.0], 32: [1.0, 2.0, 3.0], 33: [], 34: [0.5, -0.5, 0.25]}
    df = spark.createDataFrame(list(vectors.items()), "id int, v array<double>")

    def dot(a, b):
        if a is None or b is None or len(a) != len(b) or None in [*a, *b]:
            return None
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    dots = {(i, j): dot(vectors[i], vectors[j]) for i in vectors if i % 3 == 0 for j in vectors}
    most = max(x for x in dots.values() if x is not None)
    got = J.dot_links(df.repartition(4), "id", "v", F.col("id") % 3 == 0)
    assert {(r["src"], r["dst"]): r["strength"] for r in got.collect()} == {k: None if x is None else x / most for k, x in dots.items()}
    groups = [r["p"] for r in got.select(F.spark_partition_id().alias("p"), "src").where("src = 0").distinct().collect()]
    assert len(groups) > 1, "one query's links come from several groups"
    assert J.dot_links(df.limit(0), "id", "v").count() == 0 and J.dot_links(df.where("id = 30"), "id", "v").collect()[0]["strength"] is None


def test_rounded_is_round(spark):
    from varloom.functions.metrics import rounded

    values = [0.0, -0.0, 0.5, 0.1234565, -0.1234565, 2.5e-6, -1e-9, 0.9999995, 1 / 3, -2 / 3, 123456.7890125, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double").unionByName(spark.range(20000).select((F.sin(F.col("id")) * 3).alias("x"))).unionByName(spark.range(2000).select((F.col("id") / 2e6).alias("x")))
    same = rounded(F.col("x"), 6).eqNullSafe(F.round("x", 6)) & (rounded(F.col("x"), 6).cast("string").eqNullSafe(F.round("x", 6).cast("string")))
    assert df.where(~same).count() == 0


def test_near_numbers_deal_a_frequent_value(spark, monkeypatch):
    """Most rows share one value: its pairs come from many tasks, and all are those of brute force."""
    monkeypatch.setattr(J, "PIECE", 20)
    monkeypatch.setattr(J, "PAIRS_A_TASK", 500)
    xs = {i: 1.0 if i < 240 else float(i % 17) * 0.05 for i in range(300)} | {300: None, 301: 40.0}
    df = spark.createDataFrame(list(xs.items()), "id int, x double")
    got = J.near_numbers(df, "id", ["x"], asked=F.col("id") % 10 == 0).withColumn("p", F.spark_partition_id()).collect()
    known = [x for x in xs.values() if x is not None]
    mean = sum(known) / len(known)
    width = 0.05 * (sum((x - mean) ** 2 for x in known) / (len(known) - 1)) ** 0.5
    want = {(i, j) for i in xs if i % 10 == 0 and xs[i] is not None for j in xs if i != j and xs[j] is not None and abs(xs[i] - xs[j]) <= width}
    assert len(got) == len(want) and {(r["src"], r["dst"]) for r in got} == want
    assert max(sum(r["p"] == p for r in got) for p in {r["p"] for r in got}) < len(got) / 3


def test_record_lines_are_compiled(spark, capsys):
    """The JVM never compiles a method of over 8,000 bytes: a line that is made again for each mention took 100 microseconds and more a record."""
    import re

    from varloom.plans import records

    rows = vcf.records(records.lines(spark, "/root/testdata/sf0.001"))
    for df in (rows.select("chrom", "pos", "id"), vcf.flatten(rows, ["CSQ", "DB", "Frq", "RankScore"])):
        df.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8000
    odd = spark.createDataFrame([("",), ("#x",), (None,), ("##INFO=<ID=a>",), ("1\t5\t.\tA\tT,C\t.\t.\tDB;X=1",)], "value string")
    assert [(r["chrom"], r["pos"], r["id"], r["alt"], r["info"]) for r in vcf.records(odd).where("pos > 0").collect()] == [("1", 5, None, ["T", "C"], {"DB": None, "X": "1"})]
