"""Whole jobs on small files: what goes in comes out, with what was asked for."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from varloom import jobs
from varloom.functions import parsing as P
from varloom.operators import profiles as O
from varloom.sources import tables, vcf

HEAD = [
    "##fileformat=VCFv4.2", "##contig=<ID=1>", "##contig=<ID=2,length=9>", '##INFO=<ID=Frq,Number=1,Type=Float,Description="f">', '##INFO=<ID=CLNSIG,Number=.,Type=String,Description="c">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1",
]
BODY = [
    "1\t30\tc\tA\tT\t9\tPASS\tZ=1;A=2;CLNSIG=Benign\tGT:DP:AD:GQ\t0/1:30:4,26:38", "1\t10\ta\tG\tC\t.\t.\tFrq=0.25;DB;CLNSIG=Pathogenic|risk_factor\tGT:DP\t1/1:7",
    "2\t5\tb\tAC\tA,ACC\t1e-3\tq10\tE=;Frq=0.5;CLNSIG=Likely_benign\tGT:DP:AD\t1|2:9:1,3,5", "2\t9\t.\tT\tG\t50.0\tPASS\tCLNSIG=Uncertain_significance\tGT\t0/1",
]


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "case1_ranked.vcf"
    path.write_text("\n".join(HEAD + BODY) + "\n")
    return str(path)


def text_of(folder) -> list[str]:
    return [line for p in sorted(Path(folder).glob("part-*")) for line in p.read_text().splitlines()]


def test_a_file_comes_back_unchanged(spark, source, tmp_path):
    vcf.write(vcf.annotated(vcf.lines(spark, source), lambda rows: rows, []), str(tmp_path / "same"))
    assert text_of(tmp_path / "same") == HEAD + BODY
    with pytest.raises(Exception, match="already exists"):
        vcf.write(vcf.annotated(vcf.lines(spark, source), lambda rows: rows, []), str(tmp_path / "same"))


def test_scores_and_explanations_are_added_alone(spark, source, tmp_path):
    frq = F.coalesce(P.number(F.try_element_at("info", F.lit("Frq"))), F.lit(0.0))
    unsure = F.when(F.try_element_at("info", F.lit("CLNSIG")) == "", 0.0).otherwise(0.4)
    jobs.predict_on_vcf(spark, source, str(tmp_path / "out"), unsure + frq, {"frq": frq, "base": unsure}, blank_uncertain="CLNSIG")
    got = text_of(tmp_path / "out")
    new = [x for x in got if x not in HEAD and x.startswith("##")]
    assert [x.split(",")[0] for x in new] == ["##INFO=<ID=Score", "##INFO=<ID=ScoreExplanation"] and got.index(new[0]) == 6
    added = [";Score=0.40000", ";Score=0.65000;ScoreExplanation=[base=0.40,frq=0.25,]", ";Score=0.90000;ScoreExplanation=[frq=0.50,base=0.40,]", ";Score=0.00000"]
    want = ["\t".join([*line.split("\t")[:7], line.split("\t")[7] + a, *line.split("\t")[8:]]) for line, a in zip(BODY, added, strict=True)]
    assert got[-4:] == want


def test_the_same_key_twice_is_an_error(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("1\t1\ta\tA\tC\t.\t.\tK=1;K=2\n")
    with pytest.raises(Exception, match="(?i)duplicate"):
        vcf.records(vcf.lines(spark, str(tmp_path / "x.vcf"))).collect()


def test_alleles_are_split_with_their_calls(spark, source):
    rows = {(r["id"], r["alt"][0]): r["samples"] for r in vcf.split_alleles(vcf.records(vcf.lines(spark, source))).collect()}
    assert rows["b", "A"] == ["1|0:9:1,3"] and rows["b", "ACC"] == ["0|1:9:1,5"] and rows["a", "C"] == ["1/1:7"]


def test_concat_and_csv(spark, source, tmp_path):
    other = tmp_path / "case2_ranked.vcf"
    other.write_text("\n".join([*HEAD, "1\t20\td\tA\tT\t.\t.\tDB\tGT\t0/1"]) + "\n")
    jobs.concat_vcfs(spark, [source, str(other)], str(tmp_path / "all"))
    got = text_of(tmp_path / "all")
    assert got[: len(HEAD)] == HEAD and [x.split("\t")[2] for x in got[len(HEAD) :]] == ["a", "d", "c", "b", "."]
    other.write_text("\n".join([HEAD[3].replace("Float", "String"), HEAD[-1]]) + "\n")
    with pytest.raises(ValueError, match="Frq"):
        jobs.concat_vcfs(spark, [source, str(other)], str(tmp_path / "none"))
    jobs.vcf_to_csv(spark, [source], str(tmp_path / "csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("pos").collect()
    assert rows[0].asDict()["Frq"] == "0.25" and {"A", "CLNSIG", "DB", "E", "Frq", "Z"} <= set(rows[0].asDict())
    with pytest.raises(Exception, match="(?i)path.*not"):
        jobs.vcf_to_csv(spark, [str(tmp_path / "missing.vcf")], str(tmp_path / "no"))


def test_compile_labels_splits_and_reads_back(spark, source, tmp_path):
    got = jobs.compile_vcf(spark, [source], str(tmp_path / "set"), {"CLNSIG": "BOTH"}, test_ratio=0.34, clinical="CLNSIG")
    rows = {r["id"]: r for r in got.collect()}
    assert {i: r["label"] for i, r in rows.items()} == {"a": 1.0, "b": 0.0, "c": 0.0} and dict(got.dtypes)["Frq"] == "double"
    assert sorted(r["set"] for r in rows.values()) == ["test", "test", "train"]
    name = rows["a"]["set"]
    part = tables.read_group(spark, str(tmp_path / "set"), "set", name, ["id", ["Frq", "label"]], fill=-1.0)
    assert part.where("id = 'a'").first()["Frq_label"] == [0.25, 1.0] and part.count() == sum(r["set"] == name for r in rows.values())
    with pytest.raises(ValueError, match="unknown columns"):
        tables.read_group(spark, str(tmp_path / "set"), "set", name, ["nothing"])
    with pytest.raises(ValueError, match="unknown columns"):
        O.chosen_columns(got, ["id", "nothing"])


def test_ranked_views(spark, source, tmp_path):
    got = jobs.view_ranked_vcf(spark, [source], ["b"], ["Frq"], str(tmp_path / "v")).collect()
    assert [(r["case_name"], r["id"], r["rank_Frq"]) for r in got] == [("case1", "b", 0)]
    assert spark.read.parquet(str(tmp_path / "v/summaries")).first()["summary"] == '{"case_name":"case1","rank_Frq":0}'


@pytest.mark.parametrize(("kind", "last"), [("clinvar", ["2\t9\t.\tT\tG\t.\t.\tCLINVAR_GROUND_TRUTH=Uncertain_significance\tGT:DP:AD:GQ\t1/1:30:4,26:38"]), ("giab", ["2\t5\tb\tAC\tACC\t.\t.\tGIAB_GROUND_TRUTH=benign\tGT:DP:AD:GQ\t0|1:9:1,5:.", "2\t9\t.\tT\tG\t.\t.\tGIAB_GROUND_TRUTH=benign\tGT:DP:AD:GQ\t0/1:.:.:."]), ("mutacc", ["2\t9\t.\tT\tG\t50.0\tPASS\tMUTACC_GROUND_TRUTH=benign\tGT:DP:AD:GQ\t1/1:30:4,26:38"])])
def test_labelled_files(spark, source, tmp_path, kind, last):
    jobs.label_vcf(spark, source, str(tmp_path / "l"), kind, "benign")
    got = text_of(tmp_path / "l")
    assert got[:3] == HEAD[:3] and got[-len(last) :] == last and sum(x.startswith("#CHROM") for x in got) == 1


def test_concat_keeps_the_order_of_the_contigs(spark, tmp_path):
    """chr2 before chr10 before chrX, whatever the texts' order; a contig that no header names is an error; headers without contigs go by first mention."""
    names = ["chr1", "chr2", "chr10", "chrX", "chrM"]
    head = ["##fileformat=VCFv4.2", *[f"##contig=<ID={c},length=100>" for c in names], HEAD[-1].rsplit("\t", 2)[0]]
    row = lambda c, p, i: f"{c}\t{p}\t{i}\tA\tC\t.\t.\tDB"
    (tmp_path / "a.vcf").write_text("\n".join([*head, row("chr10", 5, "a1"), row("chrX", 1, "a2"), row("chr2", 7, "a3"), row("chr2", 30, "a4")]) + "\n")
    (tmp_path / "b.vcf").write_text("\n".join([*head, row("chrM", 1, "b1"), row("chr2", 7, "b2"), row("chr1", 9, "b3"), row("chr10", 4, "b4")]) + "\n")
    paths = [str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf")]
    jobs.concat_vcfs(spark, paths, str(tmp_path / "all"))
    got = text_of(tmp_path / "all")
    assert got[: len(head)] == head and [x.split("\t")[2] for x in got[len(head) :]] == ["b3", "a3", "b2", "a4", "b4", "a1", "a2", "b1"]
    (tmp_path / "c.vcf").write_text("\n".join([*head, row("chrUn", 1, "c1")]) + "\n")
    with pytest.raises(Exception, match="no header names: chrUn"):
        jobs.concat_vcfs(spark, [str(tmp_path / "c.vcf")], str(tmp_path / "none"))
    (tmp_path / "d.vcf").write_text("\n".join([head[0], head[-1], row("z", 2, "d1"), row("y", 1, "d2"), row("z", 1, "d3")]) + "\n")
    jobs.concat_vcfs(spark, [str(tmp_path / "d.vcf")], str(tmp_path / "plain"))
    assert [x.split("\t")[2] for x in text_of(tmp_path / "plain")[2:]] == ["d3", "d1", "d2"]


CSQ = '##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequence annotations. Format: Allele|Consequence|SIFT|REVEL_score|GERP++_RS|CLINVAR_CLNSIG">'


def test_compile_expands_transcripts(spark, tmp_path):
    """Records with 0 to 4 transcripts: the most severe one's fields become typed columns; clinical keywords mask by their own key alone."""
    info = [
        "CLINVAR_GROUND_TRUTH=Benign", "CLINVAR_GROUND_TRUTH=Pathogenic;CSQ=T|intron_variant|low|0.1|-3.5|", "GIAB_GROUND_TRUTH=benign;CSQ=T|intron_variant|low|0.1||other,T|stop_gained&splice_region_variant|deleterious|0.9|4.25|uncertain",
        "MUTACC_GROUND_TRUTH=pathogenic;CSQ=A|missense_variant|a|0.3|1|,B|missense_variant|b|0.4|2|,C|synonymous_variant|c|0.5|3|", "CLINVAR_GROUND_TRUTH=Uncertain_significance;CSQ=T|start_lost|x|1|1|",
        "GIAB_GROUND_TRUTH=benign;CSQ=" + ",".join(f"T|{c}|{c[:3]}|{i}||" for i, c in enumerate(("intron_variant", "5_prime_UTR_variant", "frameshift_variant", "stop_lost"))),
    ]
    body = [f"1\t{10 + i}\tv{i}\tA\tC\t.\t.\t{x}" for i, x in enumerate(info)]
    (tmp_path / "t.vcf").write_text("\n".join([HEAD[0], HEAD[1], CSQ, HEAD[-1].rsplit("\t", 2)[0], *body]) + "\n")
    origin = {"CLINVAR_GROUND_TRUTH": "BOTH", "GIAB_GROUND_TRUTH": "TRAIN", "MUTACC_GROUND_TRUTH": "TRAIN"}
    got = jobs.compile_vcf(spark, [str(tmp_path / "t.vcf")], str(tmp_path / "set"), origin)
    rows = {r["id"]: r.asDict() for r in got.collect()}
    assert set(rows) == {"v0", "v1", "v2", "v3", "v5"} and "CSQ" not in got.columns and not any("GROUND_TRUTH" in c for c in got.columns)
    names = ("CSQ_Consequence", "CSQ_SIFT", "CSQ_REVEL_score", "CSQ_GERP++_RS", "CSQ_CLINVAR_CLNSIG", "label")
    want = {
        "v0": (None, None, None, None, None, 0.0), "v1": ("intron_variant", "low", 0.1, -3.5, "", 1.0), "v2": ("stop_gained&splice_region_variant", "deleterious", 0.9, 4.25, "uncertain", 0.0),
        "v3": ("missense_variant", "a", 0.3, 1.0, "", 1.0), "v5": ("frameshift_variant", "fra", 2.0, None, "", 0.0),
    }
    assert {i: tuple(r[n] for n in names) for i, r in rows.items()} == want
    kinds = tables.read_types(spark, str(tmp_path / "set"))
    assert kinds["CSQ_REVEL_score"] == kinds["CSQ_GERP++_RS"] == "double" and kinds["CSQ_SIFT"] == "string"
    assert sum(r["set"] == "test" for r in rows.values()) == 2, "a quarter of five rows, from those of either set"
    (tmp_path / "u.vcf").write_text("\n".join([CSQ, HEAD[-1], "1\t1\tx\tA\tC\t.\t.\tGIAB_GROUND_TRUTH=affects"]) + "\n")
    with pytest.raises(Exception, match="unknown label affects"):
        jobs.compile_vcf(spark, [str(tmp_path / "u.vcf")], str(tmp_path / "bad"), origin)
    (tmp_path / "w.vcf").write_text("\n".join([CSQ, HEAD[-1], "1\t1\tx\tA\tC\t.\t.\tGIAB_GROUND_TRUTH=benign;CSQ=T|intron_variant"]) + "\n")
    with pytest.raises(Exception, match="wrong number of fields"):
        jobs.compile_vcf(spark, [str(tmp_path / "w.vcf")], str(tmp_path / "worse"), origin)


def test_train_save_load_and_predict(spark, tmp_path):
    """A model fitted on a compiled set's train group, loaded by another job: held-out rows right, file unchanged but for the score, renamed and uncertain keys."""
    import random

    rng = random.Random(4)
    body = []
    for i in range(240):
        bad = i % 3 == 0
        sift, revel = ("deleterious", rng.uniform(0.5, 1)) if bad else ("tolerated", rng.uniform(0, 0.5))
        body.append(f"1\t{100 + i}\tv{i}\tA\tC\t.\t.\tGIAB_GROUND_TRUTH={'pathogenic' if bad else 'benign'};Frq={0.0 if bad else rng.random():.3f};CSQ=T|{'stop_gained' if bad else 'intron_variant'}|{sift}|{revel:.3f}|{rng.uniform(-1, 1):.2f}|")
    head = [HEAD[0], HEAD[1], CSQ, HEAD[-1].rsplit("\t", 2)[0]]
    (tmp_path / "t.vcf").write_text("\n".join([*head, *body]) + "\n")
    jobs.compile_vcf(spark, [str(tmp_path / "t.vcf")], str(tmp_path / "set"), {"GIAB_GROUND_TRUTH": "BOTH"})
    told = {r["set"]: r for r in jobs.train_on_set(spark, str(tmp_path / "set"), str(tmp_path / "model"), ["CSQ_SIFT", "CSQ_CLINVAR_CLNSIG"], ["CSQ_REVEL_score", "CSQ_GERP++_RS", "Frq"]).collect()}
    assert told["test"]["tp"] + told["test"]["tn"] == 60 and told["test"]["mcc"] == 1.0
    asked = [
        "1\t1\ta\tA\tC\t.\t.\tFrq=0.0;CSQ=T|stop_gained|deleterious|0.95|0.1|", "1\t2\tb\tA\tC\t7.0\tPASS\tFrq=0.9;DB;CSQ=T|intron_variant|tolerated|0.1|0.1|", "1\t3\tc\tA\tC\t.\t.\tDB",
        "1\t4\td\tA\tC\t.\t.\tOther=0.9;Frq=0.0;CSQ=T|intron_variant|tolerated|0.1|0.1|Uncertain_significance",
    ]
    (tmp_path / "p.vcf").write_text("\n".join([*head, *asked]) + "\n")
    assert jobs.main(["predict-on-vcf", str(tmp_path / "p.vcf"), str(tmp_path / "out"), str(tmp_path / "model")]) == 0
    got = text_of(tmp_path / "out")
    assert [x for x in got if x.startswith("#") and "Score" not in x] == head
    rows = [x for x in got if not x.startswith("#")]
    assert [x.split(";Score=")[0] for x in rows] == asked
    score = [float(x.split(";Score=")[1].split(";")[0]) for x in rows]
    assert score[0] > 0.95 and score[1] < 0.05 and "ScoreExplanation" not in rows[1]
    parts = dict(p.split("=") for p in rows[0].split("ScoreExplanation=[")[1].rstrip(",]").split(","))
    assert list(map(float, parts.values())) == sorted(map(float, parts.values()), reverse=True) and set(parts) == {"CSQ_SIFT", "CSQ_CLINVAR_CLNSIG", "CSQ_REVEL_score", "CSQ_GERP++_RS", "Frq"}
    jobs.predict_with_model(spark, str(tmp_path / "p.vcf"), str(tmp_path / "other"), str(tmp_path / "model"), rename="Frq:Other")
    other = [x for x in text_of(tmp_path / "other") if not x.startswith("#")]
    assert float(other[3].split(";Score=")[1].split(";")[0]) < score[3], "the frequency was read from the other key"
    with pytest.raises(ValueError, match="not a feature"):
        jobs.predict_with_model(spark, str(tmp_path / "p.vcf"), str(tmp_path / "no"), str(tmp_path / "model"), rename="Nothing:Other")


def test_ranked_files_by_case(spark, source, tmp_path):
    other = tmp_path / "case2_x.vcf"
    other.write_text("\n".join([*HEAD[:4], "##source=other", *HEAD[4:], "1\t20\td\tA\tT\t.\t.\tFrq=0.1\tGT\t0/1", "1\t21\ta\tA\tT\t.\t.\tFrq=0.7\tGT\t0/1", "1\t22\tf\tA\tT\t.\t.\tDB\tGT\t0/1"]) + "\n")
    jobs.view_ranked_vcf(spark, [source, str(other)], ["a", "b"], ["Frq"], str(tmp_path / "v"), top=2)
    ids = lambda folder: [x.split("\t")[2] for x in text_of(folder) if not x.startswith("#")]
    assert [x for x in text_of(tmp_path / "v/Frq-vcf/case_name=case1") if x.startswith("#")] == HEAD
    assert "##source=other" in text_of(tmp_path / "v/Frq-vcf/case_name=case2")
    assert ids(tmp_path / "v/Frq-vcf/case_name=case1") == ["b", "a"] and ids(tmp_path / "v/Frq-vcf/case_name=case2") == ["a", "d"]
    assert ids(tmp_path / "v/causative/case_name=case1") == ["a", "b"] and ids(tmp_path / "v/causative/case_name=case2") == ["a"]
    lines = [x for x in text_of(tmp_path / "v/causative/case_name=case1") if not x.startswith("#")]
    assert lines == [BODY[1], BODY[2]]


def test_checksums(spark, tmp_path):
    (tmp_path / "f.txt").write_text("abc")
    ok, bad = {"f.txt": "900150983cd24fb0d6963f7d28e17f72"}, {"f.txt": "0"}
    assert tables.checked_files(spark, str(tmp_path / "f.txt"), ok).first()["ok"] is True
    assert tables.checked_files(spark, str(tmp_path / "f.txt")).first()["ok"] is None
    with pytest.raises(Exception, match="checksum differs"):
        tables.require_intact(tables.checked_files(spark, str(tmp_path / "f.txt"), bad)).collect()
    with pytest.raises(Exception, match="differ in rows"):
        tables.equal_counts(spark.range(3), spark.range(4)).collect()


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(i, "train" if i % 3 else "test", (i % 10) / 10, int(i % 4 == 0), "w" if i % 2 else "v") for i in range(60)], "id int, set string, score double, label int, word string")
    out = jobs.explore_inference(rows.select("id", "set", "score", "label"), "score", "label", "set", str(tmp_path / "tsv"))
    assert out["matrix"].count() == 2 and out["auc"].count() == 2 and out["sweep"].count() == 200
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).count() == 60
    report = jobs.data_report(rows, "set", "label", ignore=["id"])
    assert report["quartiles"].count() == 2 and report["words_word"].count() == 3 and report["labels"].count() == 4
    drift = jobs.rank_score_report(rows.where("id < 50"), rows.withColumn("score", F.when(F.col("id") == 7, 5.0).otherwise(F.col("score"))), "id", "score", "score")
    assert drift["integrity"].first()["out_of_range"] == 1 and drift["drift"].count() == 11
    scored = rows.select("id", F.col("label").alias("case_id"), F.col("score").alias("a"), (1 - F.col("score")).alias("b"))
    names = spark.createDataFrame([(0, "x"), (1, "y")], "case_id int, name string")
    ranks = jobs.case_rank_report(scored, scored.where("id IN (4, 5)").select("case_id", "id"), ["a", "b"], names)["ranks"].collect()
    assert len(ranks) == 8 and {r["name"] for r in ranks} == {"x", "y"}
    with pytest.raises(Exception, match="no entry for 1"):
        jobs.case_rank_report(scored, scored.select("case_id", "id"), ["a", "b"], names.limit(1))["ranks"].collect()


def test_rank_score_statistics(spark):
    rows = spark.createDataFrame([(i, (i * 37 % 100) / 100, int(i * 37 % 100 >= 60)) for i in range(100)], "id int, score double, label int")
    got = {k: v.collect() for k, v in jobs.rank_score_statistics(rows, "id", "score", "label", bins=10).items()}
    assert len(got["sweep"]) == len(got["folds"]) == 100 and {r["folds"] for r in got["folds"]} == {10}
    at = {r["i"]: r for r in got["sweep"]}
    for i in (0, 30, 70):
        assert at[i]["tp"] == sum(r["score"] >= at[i]["threshold"] and r["label"] for r in rows.collect())
    best = {r["metric"]: r for r in got["optimum"]}
    assert best["f1"]["best"] == best["mcc_score"]["best"] == 1 and all(0.59 < v <= 0.6 for v in best["f1"]["thresholds"])
    assert got["auc"][0][0] == 1 and sum(r["n"] for r in got["histogram"]) == 100


def test_report_has_histograms_sizes_and_rows(spark):
    rows = spark.createDataFrame([(i, "train" if i % 3 else "test", i / 10, i % 2, "w") for i in range(60)], "id int, set string, score double, label int, word string")
    report = jobs.data_report(rows, "set", "label", ignore=["id"], bins=5, shown=7)
    assert sum(r["n"] for r in report["histogram_score"].collect()) == 60 and report["profile"].count() > 0
    shown = report["sample"].collect()
    assert len(shown) == 7 and sorted(map(str, shown)) == sorted(map(str, jobs.data_report(rows.repartition(5), "set", "label", ignore=["id"], shown=7)["sample"].collect()))


def test_calls_are_confirmed_and_losses_told(spark, source, tmp_path):
    (tmp_path / "known.vcf").write_text("\n".join([*HEAD, BODY[1], "2\t7\tz\tA\tC\t.\t.\tDB\tGT\t0/1"]) + "\n")
    lost = jobs.confirm_calls(spark, source, str(tmp_path / "known.vcf"), str(tmp_path / "o")).collect()
    kept, rest = (text_of(tmp_path / "o" / n) for n in ("kept", "rest"))
    assert kept[: len(HEAD)] == rest[: len(HEAD)] == HEAD and [x.split("\t")[2] for x in kept[len(HEAD) :]] == ["a"]
    left = {tuple(x.split("\t")[i] for i in (0, 1, 3, 4)) for x in rest[len(HEAD) :]}
    assert {(r["chrom"], str(r["pos"]), r["ref"], ",".join(r["alt"])) for r in lost if r["side"] == "a"} == left
    assert [r["pos"] for r in lost if r["side"] == "b"] == [7]


def test_negatives_join_the_labelled_file(spark, source, tmp_path):
    (tmp_path / "neg.vcf").write_text("\n".join([*HEAD, "1\t20\tn\tA\tC\t5\tPASS\tDB\tGT\t0/1"]) + "\n")
    jobs.label_with_negatives(spark, source, str(tmp_path / "neg.vcf"), str(tmp_path / "o"))
    body = [x.split("\t") for x in text_of(tmp_path / "o/all") if not x.startswith("#")]
    assert [(x[0], x[1]) for x in body] == [("1", "10"), ("1", "20"), ("1", "30"), ("2", "5"), ("2", "9")]
    assert [x[2] for x in body if "benign" in x[7]] == ["n"]


def test_commands(spark, source, tmp_path, capsys):
    assert jobs.main(["nothing"]) == 2 and "vcf2csv" in capsys.readouterr().out
    assert jobs.main(["vcf2csv", str(tmp_path / "c"), source]) == 0 and list(Path(tmp_path / "c").glob("part-*"))
