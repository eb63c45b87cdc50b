"""Toxicity, language ID, LM scoring, mixing and vectors: held-out quality, brute force, edge cases."""

from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import language_id, lm_scoring, mixing, near_vectors, topics, toxicity


def brute_segments(scores):
    """All maximal scoring segments by their definition: recursively, the best segment and what lies beside it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    left, right = brute_segments(scores[:i]), brute_segments(scores[j:])
    return left + [(i, j, best)] + [(s + j, e + j, x) for s, e, x in right]


def test_segments_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        scores = rng.normal(-0.3, 1.0, int(rng.integers(0, 25)))
        got, want = toxicity.all_segments(scores), brute_segments(scores.tolist())
        assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


@pytest.fixture(scope="module")
def toxic(spark):
    clean = "the river runs past the old mill and the green hill near town".split()
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        words = rng.choice(clean, 30).tolist()
        if i % 5 == 0:
            words[10:13] = rng.choice(["vilest", "rotten", "wretch"], 3).tolist()
        rows.append((i, " ".join(words)))
        labels.append((i, 1 if i % 5 == 0 else 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(toxic, odd, none):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and all((r["tox_score"] >= toxicity.THRESHOLD) == (r["toxic"] == 1) for r in held)
    scores = [r["tox_score"] for r in toxicity.score_toxicity(odd.withColumn("tox_score", F.lit("clash")), model).collect()]
    assert len(scores) == odd.count() and all(0 <= s < toxicity.THRESHOLD for s in scores)
    assert toxicity.score_toxicity(none, model).count() == 0
    found = toxicity.toxic_passages(docs.where("doc_id = 0"), model).collect()
    assert found and all(w in ("vilest", "rotten", "wretch") for r in found for w in r["passage"].split())


def test_toxicity_without_labels(toxic, none):
    docs, labels = toxic
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r["tox_score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


class BrutePpm:
    """PPM-C with exclusion, straight from its definition, over a dictionary of counts."""

    def __init__(self, texts, order=3):
        self.order, self.counts = order, {}
        for t in texts:
            for context, byte in self.bytes_of(t):
                for d in range(order + 1):
                    self.counts.setdefault(context[order - d :], Counter())[byte] += 1

    def bytes_of(self, text):
        raw = b" " * self.order + (text or "").encode().lower()
        return [(raw[i - self.order : i], raw[i]) for i in range(self.order, len(raw))]

    def p(self, context, byte):
        if context not in self.counts:
            return 1 / 256 if not context else self.p(context[1:], byte)
        n = self.counts[context]
        below = lambda b: self.p(context[1:], b) if context else 1 / 256
        if len(n) == 256:
            return n[byte] / sum(n.values())
        if byte in n:
            return n[byte] / (sum(n.values()) + len(n))
        return len(n) / (sum(n.values()) + len(n)) * below(byte) / (1 - sum(below(b) for b in n))

    def bits(self, text):
        return -sum(math.log2(self.p(c, b)) for c, b in self.bytes_of(text))


def test_language_id(spark, odd, none):
    rng = np.random.default_rng(4)
    parts = {"aa": ["ba", "na", "ka", "lo"], "bb": ["tri", "stro", "pli", "gru"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(12)), lang) for i, lang in enumerate(["aa", "bb"] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.fit(docs)
    assert [m.languages for m in models] == [["aa", "bb"]]
    got = language_id.predict(docs.withColumn("lang_pred", F.lit("clash")), models).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    marks = {r["doc_id"]: r for r in language_id.predict(odd, models).collect()}
    assert marks[3]["lang_pred"] == marks[4]["lang_pred"] == marks[5]["lang_pred"] == "und" and marks[3]["lang_score"] == 0.0
    assert all(0 <= r["lang_score"] <= 1 for r in marks.values())
    assert language_id.fit(none) == [] and language_id.predict(odd, []).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(none, models).count() == 0


def test_only_letters_make_a_language(spark):
    texts = ["²", "½ ① Ⅷ", "12_34 !?", "\u0301", "ª", "é", "日", "ʰ", None, ""]
    docs = spark.createDataFrame([(1, "some words of text", "xx")] + [(i + 10, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["text"]: r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert [got[t] for t in texts] == ["und"] * 4 + ["xx"] * 4 + ["und"] * 2


@pytest.mark.parametrize("table_mb", [64, 0])
def test_code_lengths_equal_brute_force(spark, table_mb, monkeypatch):
    """For texts of the languages, of other bytes and of all bytes, over block borders; with all languages in one model and with one each."""
    monkeypatch.setattr(language_id, "BLOCK", 37)
    rng = np.random.default_rng(11)
    alphabet = {"aa": "abc é", "bb": "bcd ß", "cc": "xyz,"}
    rows = [(i, "".join(rng.choice(list(alphabet[lang]), int(rng.integers(0, 60)))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(1000 + i, None, "aa") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.fit(docs, table_mb=table_mb)
    assert len(models) == (1 if table_mb else 3)
    trees = {lang: BrutePpm([t for i, t, own in rows if own == lang and zlib.crc32(str(i).encode()) % 5]) for lang in alphabet}
    texts = [t for _, t, _ in rows[:20]] + ["QRS tuv", "a", "".join(map(chr, range(1, 300))), "日本", None, "ab" * 200]
    for m in models:
        got = m.totals(texts)
        for k, lang in enumerate(m.languages):
            assert np.allclose(got[:, k], [trees[lang].bits(t) for t in texts], rtol=1e-9, atol=1e-9)
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.predict(asked, models).collect():
        if language_id.has_letter(r["text"]):
            want = {lang: trees[lang].bits(r["text"]) for lang in alphabet}
            best = min(want, key=lambda x: (round(want[x], 6), x))
            assert r["lang_pred"] == best and abs(r["lang_score"] - 1 / sum(2 ** (want[best] - w) for w in want.values())) < 1e-6


def test_samples_are_bounded_and_whole(spark):
    from varloom.llm.common import first_by_hash

    rows = spark.range(5000).select("id", F.when(F.col("id") < 4900, "hot").otherwise("rare").alias("k"))
    for n in (300, 50):
        got = {r["k"]: r["n"] for r in first_by_hash(rows.repartition(5), "k", "id", n).groupBy("k").agg(F.count("*").alias("n")).collect()}
        assert got == {"hot": n, "rare": min(n, 100)}
    hashes = rows.where("k = 'hot'").select("id", F.xxhash64("id").alias("h")).orderBy("h").limit(300)
    assert first_by_hash(rows, "k", "id", 300).where("k = 'hot'").select("id").exceptAll(hashes.select("id")).count() == 0
    assert first_by_hash(rows.limit(0), "k", "id", 3).count() == 0


def tokens(t):
    return (t or "").encode().lower().split() + [b"\n"]


def test_lm_baseline_equals_brute_force(sample, odd):
    for docs in (sample[0], odd):
        rows = docs.select("doc_id", "text").collect()
        counts = Counter()
        for r in rows:
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
                counts.update(tokens(r["text"]))
        n, v = sum(counts.values()), len(counts)
        want = sorted((str(r["doc_id"]), len(tokens(r["text"])), sum(counts[w] > 0 for w in tokens(r["text"])), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r["text"])), 6)) for r in rows)
        got = lm_scoring.score_documents(docs).collect()
        assert sorted((str(r["id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)


class BruteTree:
    """Context-tree weighting by direct recursion: a dictionary of counts, block probabilities and weighted predictions."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, Counter()
        for t in texts:
            for context, byte in self.bytes_of(t):
                for d in range(depth + 1):
                    for i in range(8):
                        self.counts[context[len(context) - d :], (256 | byte) >> (8 - i), byte >> (7 - i) & 1] += 1
        self.nodes = {(c, place) for c, place, _ in self.counts}
        self.children = {}
        for c, place in self.nodes:
            if c:
                self.children.setdefault((c[1:], place), []).append((c, place))
        self.own, self.mixed = {}, {}

    def bytes_of(self, text):
        raw = b"\t" * self.depth + b" ".join((text or "").encode().lower().split()) + b"\n"
        return [(raw[i - self.depth : i], raw[i]) for i in range(self.depth, len(raw))]

    def log_kt(self, node):
        if node not in self.own:
            a, b = self.counts[*node, 0], self.counts[*node, 1]
            self.own[node] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        return self.own[node]

    def log_weighted(self, node):
        if node not in self.mixed:
            x = self.log_kt(node)
            if len(node[0]) < self.depth:
                y = sum(self.log_weighted(c) for c in self.children[node])
                x = max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)
            self.mixed[node] = x
        return self.mixed[node]

    def bit(self, context, place, bit, d=0):
        node = (context[len(context) - d :], place)
        if node not in self.nodes:
            return 0.5 if d == 0 else None
        a, b = self.counts[*node, 0], self.counts[*node, 1]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        below = self.bit(context, place, bit, d + 1) if d < self.depth else None
        if below is None:
            return own
        w = math.exp(self.log_kt(node) - math.log(2) - self.log_weighted(node))
        return w * own + (1 - w) * below

    def score(self, text):
        return sum(math.log10(self.bit(c, (256 | byte) >> (8 - i), byte >> (7 - i) & 1)) for c, byte in self.bytes_of(text) for i in range(8))


@pytest.mark.parametrize("depth", [3, 5])
def test_lm_scores_equal_a_brute_force_tree(spark, odd, depth):
    """Over whole texts, across word ends, in blocks and salts of any size, for training and held-out documents alike."""
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("abcé"), int(rng.integers(1, 5)))) for _ in range(int(rng.integers(0, 12)))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").unionByName(odd.where("doc_id IS NULL OR doc_id <> 6").select("doc_id", "text"))
    rows = docs.collect()
    held = {r["doc_id"] for r in rows if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1}
    tree = BruteTree([r["text"] for r in rows if r["doc_id"] not in held], depth)
    want = sorted((str(r["doc_id"]), tree.score(r["text"])) for r in rows)
    for sizes in ({}, {"block_bytes": 40, "pairs": 5}):
        got = lm_scoring.score_documents(docs.repartition(3), depth=depth, **sizes).collect()
        have = sorted((str(r["id"]), r["score"]) for r in got)
        assert [i for i, _ in have] == [i for i, _ in want] and np.allclose([x for _, x in have], [x for _, x in want], rtol=1e-9, atol=1e-9)
        assert {r["id"] for r in got if r["held_out"]} == held - {None}
    assert len({round(r["score"], 9) for r in got if r["id"] in (3, 4, 5)}) == 1, "NULL, empty and blank texts are the end alone"


def test_lm_strides_do_not_matter(sample, monkeypatch):
    docs = sample[0].limit(20)
    whole = {r["id"]: r["score"] for r in lm_scoring.score_documents(docs).collect()}
    monkeypatch.setattr(lm_scoring, "STRIDE", 1000)
    assert all(abs(r["score"] - whole[r["id"]]) < 1e-9 * abs(whole[r["id"]]) for r in lm_scoring.score_documents(docs).collect())


def test_lm_arrays_round_trip():
    arrays = [np.array([-5, 2**60, 7]), np.array([], np.float64), np.array([0.1, -3.5]), np.array([True, False]), np.frombuffer(b"ab\nc", np.uint8), np.array([1, 2**31], np.uint32)]
    for a, b in zip(arrays, lm_scoring.unpacked(lm_scoring.packed(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_lm_learns_nothing_without_training_documents(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted(lm_scoring.score_documents(docs).collect(), key=lambda r: r["n_tokens"])
    assert [r["train_tokens"] for r in got] == [0, 0] and [round(r["bits_per_byte"], 9) for r in got] == [8.0, 8.0]


def test_lm_empty(none):
    assert lm_scoring.score_documents(none).count() == 0


def test_ln_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.0, 1234.5])
    assert np.allclose(lm_scoring._ln_gamma(x), [math.lgamma(v) for v in x], atol=1e-9)


def test_raking_meets_its_margins(spark):
    cells = spark.createDataFrame([(s, la, t, 10 + 7 * i) for i, (s, la, t) in enumerate((s, la, t) for s in "ab" for la in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    total = cells.agg(F.sum("tokens")).first()[0]
    half = lambda d, u, v: spark.createDataFrame([(u, 0.5 * total), (v, 0.5 * total)], f"{d} string, target double")
    got = mixing.rake(cells, {"source": half("source", "a", "b"), "lang": half("lang", "x", "y"), "topic": half("topic", "p", "q")}, tolerance=1e-3)
    for d in ("source", "lang", "topic"):
        for r in got.groupBy(d).agg(F.sum(F.col("tokens") * F.col("w")).alias("t")).collect():
            assert abs(r["t"] - total / 2) < 2e-3 * total


def test_mixing(sample, odd, none):
    docs = sample[0]
    got = mixing.mix(docs, budget=0.6)
    rows = got.collect()
    assert len(rows) == docs.count()
    expected = sum(r["mix_rate"] * r["mix_tokens"] for r in rows)
    assert abs(expected - 0.6 * sum(r["mix_tokens"] for r in rows)) < 0.02 * sum(r["mix_tokens"] for r in rows)
    again = {r["doc_id"]: r["mix_kept"] for r in mixing.mix(docs.repartition(5), budget=0.6).collect()}
    assert again == {r["doc_id"]: r["mix_kept"] for r in rows}
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(none).count() == 0


def test_mixing_rates_equal_brute_force(spark):
    """The whole operator against a plain version of it: cells counted in Python, raked cell by cell, drawn by md5."""
    import hashlib

    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))) + ("!!" if i % 9 == 0 else ""), ["en", "de", None][int(rng.choice(3, p=[0.7, 0.2, 0.1]))], ["hot", "b", "c"][int(rng.choice(3, p=[0.6, 0.3, 0.1]))]) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cell = {i: (s or "", la or "", "loud" if "!!" in t else "prose") for i, t, la, s in rows}
    tokens = {i: len(t.split()) for i, t, *_ in rows}
    total = sum(tokens.values())
    size = Counter()
    for i, c in cell.items():
        size[c] += tokens[i]
    goals = []
    for d in range(3):
        have = Counter()
        for c, n in size.items():
            have[c[d]] += n
        p = {v: n**0.7 for v, n in have.items()}
        goals.append({v: x * total / sum(p.values()) for v, x in p.items()})
    budget, w = 0.15, dict.fromkeys(size, 0.15)
    for _ in range(3000):
        for d in range(3):
            got = Counter()
            for c, n in size.items():
                got[c[d]] += n * min(1.0, w[c])
            w = {c: x * budget * goals[d][c[d]] / got[c[d]] for c, x in w.items()}
    assert all(x < 1 for x in w.values()), "a budget that all targets can be met within"
    want = {i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) / 16**12 < w[c] for i, c in cell.items()}
    got = {r["doc_id"]: r for r in mixing.mix(docs.withColumn("mix_kept", F.lit("clash")).withColumn("kind", F.when(F.col("text").contains("!!"), "loud").otherwise("prose")), budget=budget, topic_col="kind").collect()}
    assert all(abs(got[i]["mix_rate"] - w[c]) < 1e-3 for i, c in cell.items())
    assert sum(got[i]["mix_kept"] != k for i, k in want.items()) <= 2 and {i: r["mix_tokens"] for i, r in got.items()} == tokens
    for d, name in enumerate(("source", "lang", "mix_topic")):
        for v, goal in goals[d].items():
            assert abs(sum(r["mix_rate"] * r["mix_tokens"] for r in got.values() if (r[name] or "") == v) - budget * goal) < 1e-3 * total


def test_mixing_targets_topics_and_warnings(spark):
    rows = [(i, "w w w w", "en" if i % 4 else "de", "a" if i % 2 else "b", f"t{i % 3}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    share = lambda d, **t: spark.createDataFrame(list(t.items()), f"{d} string, target double")
    got = mixing.mix(docs, budget=0.3, targets={"source": share("source", a=1.0, b=3.0), "topic": share("topic", t0=2.0, t1=1.0, t2=1.0)}, topic_col="subject")
    by = {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum(F.col("mix_rate") * F.col("mix_tokens")).alias("t")).collect()}
    assert abs(by["b"] / by["a"] - 3) < 1e-3 and {r["mix_topic"] for r in got.collect()} == {"t0", "t1", "t2"}
    assert mixing.mix(docs, carry=["doc_id"]).columns[:2] == ["doc_id", "mix_topic"]
    with pytest.raises(ValueError, match="two targets"):
        mixing.mix(docs, targets={"source": share("source", a=1.0).unionByName(share("source", a=2.0))})
    tied = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="did not settle"):
        mixing.rake(tied, {"source": share("source", a=15.0, b=5.0), "lang": share("lang", x=5.0, y=15.0)}, sweeps=3)
    rates = mixing.keep_rates(spark.createDataFrame([(100, 5.0), (100, 1.0), (100, 0.1)], "tokens long, w double"), 0.6).collect()
    assert abs(sum(r["rate"] * 100 for r in rates) - 180) < 1e-6 and max(r["rate"] for r in rates) == 1.0


def test_mixing_meets_targets_under_the_bound(spark):
    """Rates of at most 1 meet feasible targets although raking without a bound asks some cells for more than they have."""
    tokens = {("a", "x", "p"): 700, ("a", "y", "p"): 100, ("b", "x", "p"): 100, ("b", "y", "p"): 400, ("a", "x", "q"): 60, ("b", "y", "q"): 40}
    cells = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "source string, lang string, topic string, tokens long")
    table = lambda d, **t: spark.createDataFrame(list(t.items()), f"{d} string, target double")
    goals = {"source": table("source", a=800.0, b=600.0), "lang": table("lang", x=730.0, y=670.0), "topic": table("topic", p=1275.0, q=125.0)}
    rows = mixing.bounded_rates(cells, goals, 0.79).collect()
    assert max(0.79 * r["w"] for r in rows) > 1.05 and all(0 <= r["rate"] <= 1 for r in rows)
    for d, table in goals.items():
        for v, goal in table.collect():
            assert abs(sum(r["rate"] * r["tokens"] for r in rows if r[d] == v) - 0.79 * goal) < 2, (d, v)


def test_many_cells_are_raked_alike(spark, monkeypatch):
    """Above and below the bound of cells on the driver: the same factors and rates, also where targets can't be reached."""
    rng = np.random.default_rng(5)
    tokens = {(s, la, t): int(rng.integers(1, 400)) for s in "abc" for la in "xy" for t in "pqr"} | {("z", "x", "p"): 9000}
    rows = [(i, "w " * n, la, s, t) for i, ((s, la, t), n) in enumerate(tokens.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string")
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-3)
    out = []
    for bound in (500_000, 0):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", bound)
        out.append({r["doc_id"]: r for r in mixing.mix(docs, topic_col="kind").collect()})
    for i, r in out[0].items():
        assert abs(r["mix_rate"] - out[1][i]["mix_rate"]) < 1e-6 and abs(r["mix_weight"] - out[1][i]["mix_weight"]) < 1e-6
        assert (r["mix_kept"], r["mix_copies"]) == (out[1][i]["mix_kept"], out[1][i]["mix_copies"])
    assert any(r["mix_rate"] == 1.0 for r in out[0].values()) and any(r["mix_rate"] < 0.9 for r in out[0].values())


def test_topics_are_learned_within_languages(spark, none):
    """Two subjects in two languages: learned from words, the same in any partitioning; blank texts have none."""
    rng = np.random.default_rng(8)
    words = {(s, la): [f"{la}{s}{k}" for k in range(40)] for s in ("sea", "law") for la in ("en", "de")}
    common = {la: [f"{la}the{k}" for k in range(15)] for la in ("en", "de")}
    rows = []
    for i in range(600):
        la, s = ("en", "de")[i % 2], ("sea", "law")[i // 2 % 2]
        rows.append((i, " ".join(rng.choice([*words[s, la], *common[la]], 60)), la, f"{la}-{s}"))
    rows += [(1000, None, "en", "-"), (1001, " ", None, "-")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, subject string")
    named = lambda df: {r["doc_id"]: r["t"] for r in df.select("doc_id", topics.fit_topics(df, 4).column(F.col("text"), F.coalesce("lang", F.lit(""))).alias("t")).collect()}
    got = named(docs)
    assert got == named(docs.repartition(7)) and got[1000] == got[1001] == "none"
    pairs = Counter((got[i], subject) for i, _, _, subject in rows[:600])
    assert sum(max(n for (t, _), n in pairs.items() if t == topic) for topic in {t for t, _ in pairs}) >= 570, "a topic holds one subject"
    assert topics.fit_topics(none).names(["a b"], ["en"]) == ["none"]
    with pytest.warns(UserWarning, match="left out"):
        mixing.mix(docs, targets={"lang": spark.createDataFrame([("en", 1.0), ("xx", 1.0)], "lang string, target double")}, topic_col="subject")


def test_topics_are_counted_over_all_documents(spark):
    """Slot weights, means and centroids are those of every document, however few the search begins with."""
    rng = np.random.default_rng(5)
    words = [[f"{s}{k}" for k in range(30)] for s in ("sea", "law", "art")]
    rows = [(i, " ".join(rng.choice(words[i % 3], 40)), ("en", None)[i % 2]) for i in range(240)]
    docs = spark.createDataFrame([*rows, (500, "", "en")], "doc_id long, text string, lang string").repartition(5)
    model = topics.fit_topics(docs, 3, sample=12)
    texts, langs = [t for _, t, _ in rows] + [""], [la or "" for _, _, la in rows] + ["en"]
    vectors = np.stack([topics.word_vector(t) for t in texts]).astype(float)
    weights = np.log((1 + len(texts)) / (1 + (vectors > 0).sum(0))) + 1
    assert np.allclose(model.weights, weights)
    for name in ("en", ""):
        assert np.allclose(model.means[name], (vectors * weights)[[la == name for la in langs]].mean(0), atol=1e-6)
    unit, named = model.residuals(vectors, langs), model.names(texts, langs)
    for k, centroid in enumerate(model.centroids):
        own = unit[[t == f"t{k}" for t in named]].sum(0)
        assert np.allclose(centroid, own / np.linalg.norm(own), atol=1e-3)
    assert named[-1] == "none" and len({named[i] for i in range(3)}) == 3


def test_mixing_names_topics_once_a_row(spark):
    """What a filter on the draw needs of a topic is no second pass through Python, and rates come from the driver without Python workers."""
    docs = spark.createDataFrame([(i, f"w{i % 5} v{i % 3}", ("en", "de")[i % 2], f"s{i % 2}") for i in range(60)], "doc_id long, text string, lang string, source string")
    plan = lambda df: df._jdf.queryExecution().toString()
    kept = mixing.mix(docs, carry=["doc_id"]).where("mix_kept")
    assert plan(kept).partition("== Physical Plan ==")[2].count("ArrowEvalPython") == 1
    cells = spark.createDataFrame([("a", "x", "p", 30), ("a", "y", "p", 10), ("b", "x", "p", 0)], "source string, lang string, topic string, tokens long")
    rates = mixing.bounded_rates(cells, {"source": mixing.tempered(cells, "source", 0.7)}, 0.8)
    assert "ExistingRDD" not in plan(rates) and rates.schema.names == [*cells.columns, "w", "rate"]
    assert sorted(tuple(r)[:4] for r in rates.collect()) == sorted(tuple(r) for r in cells.collect())
    assert mixing.bounded_rates(cells.limit(0), {}, 0.8).count() == 0


def test_copies_meet_targets_and_budget(spark):
    """Where a value has fewer tokens than its share of the budget, repeats reach the target; the report says what the draw misses."""
    rows = [(i, "w " * 20 + ("!!" if i % 20 == 0 else "."), "es" if i % 11 == 0 else "en", "hot" if i % 3 else f"s{i % 7}", 40) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs.withColumn("kind", F.when(F.col("text").contains("!!"), "loud").otherwise("prose")), topic_col="kind").cache()
    sums = got.agg(F.sum("mix_tokens"), F.sum(F.col("mix_tokens") * F.col("mix_copies")), F.sum(F.col("mix_tokens") * F.col("mix_rate"))).first()
    assert abs(sums[1] / sums[0] - 0.8) < 0.02 and abs(sums[2] / sums[0] - 0.8) < 1e-6
    for r in mixing.report(got).collect():
        assert abs(r["copied"] - r["target"]) < 0.015, r
        if r["value"] in ("es", "loud"):
            assert r["kept"] < r["target"] - 0.01 and abs(r["kept"] - r["natural"] / 0.8) < 0.01, r


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 8))
    vectors = [v.tolist() for v in base] + [(v + rng.normal(scale=0.05, size=8)).tolist() for v in base[:30]] + [base[0].tolist(), (3 * base[0]).tolist()]
    odd = [None, [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], [1.0, 2.0]]
    rows = list(enumerate(vectors + odd))
    got = {r["id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.95} for i in ok}
    for i, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, ())), min(reach), min(reach) == i)


def test_vectors_with_null_and_repeated_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [2.0, 0.0]), (3, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None), (8, [-1.0, 0.0])]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))).collect()
    assert sorted((str(r["id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [
        ("3", 3, "3", True), ("5", 3, "3", False), ("5", 3, "3", False), ("8", 0, "8", True), ("None", 0, "None", True), ("None", 0, "None", True), ("None", 3, "3", False),
    ]


def test_vectors_over_several_shards_and_groups(spark):
    """Counts and groups of clusters of many sizes equal brute force, and the audit has seen links."""
    rng = np.random.default_rng(12)
    sizes = [150, 60, 60, 20, 10, 5, 3, 2, 2, 2]
    x = np.concatenate([c + rng.normal(scale=0.03, size=(n, 16)) for n, c in zip(sizes, rng.normal(size=(len(sizes), 16)), strict=True)] + [rng.normal(size=(400, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r["id"]: r for r in near_vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), recall=1.0).collect()}
    assert got[0]["audited_recall"] == 1.0
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()


def test_rare_links_are_audited(spark):
    """Ten planted pairs among thousands of vectors: random probes see none, the audit measures recall from the pairs; links at the threshold count."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 32))
    for k in range(10):
        x[3000 + k] = x[k] + 0.02 * rng.normal(size=32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in near_vectors.near_vectors(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    assert {i: r["n_links"] for i, r in got.items()} == {i: int(hit[i].sum()) - 1 for i in range(4000)}
    assert got[0]["audited_links"] >= 20 and got[0]["audited_recall"] >= 0.97 and got[3003]["component_id"] == 3
    lone = near_vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:300])], "vec_id long, embedding array<double>")).first()
    assert lone["audited_recall"] is None and lone["audited_links"] == 0


def test_probes_choose_the_first_beam(spark, monkeypatch):
    """Where random probes see that a beam is too narrow, not all vectors search with it."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(scale=0.04, size=(30, 16)) for c in centres])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rounds, write = [], near_vectors.written
    monkeypatch.setattr(near_vectors, "written", lambda df, name, *more: rounds.append(name) or write(df, name, *more))
    monkeypatch.setattr(near_vectors, "PILOT_FROM", 0)
    got = {r["id"]: r for r in near_vectors.near_vectors(table, least_shards=2, beam=1).collect()}
    assert rounds.count("vector-links") == 1
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = int((unit @ unit.T >= 0.95).sum()) - len(x)
    assert 0.95 * true <= sum(r["n_links"] for r in got.values()) <= true and got[0]["audited_recall"] >= 0.97


def test_vectors_empty(spark):
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_recall_over_clusters():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([c + rng.normal(scale=0.1, size=(25, 32)) for c in centres] + [rng.normal(size=(1000, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = near_vectors.SmallWorld(x)
    found = sum(len(f) for _, f in graph.search(x, 0.95, 24))
    assert found >= 0.97 * int((x @ x.T >= 0.95).sum())


def test_no_value_holds_a_graph(spark, monkeypatch):
    """What tasks hand on is a row a vector: no row grows with its shard, on the way through the JVM neither."""
    longest, write = {}, near_vectors.written

    def watched(df, name, *more):
        out = write(df, name, *more)
        for c, kind in out.dtypes:
            if kind == "binary" or kind.startswith("array"):
                longest[name, c] = out.agg(F.max(F.length(c) if kind == "binary" else F.size(c) * 8)).first()[0]
        return out

    monkeypatch.setattr(near_vectors, "written", watched)
    x = np.random.default_rng(4).normal(size=(1500, 16))
    near_vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), least_shards=2)
    assert longest and max(longest.values()) <= 4 * near_vectors.LINKS * 10, longest


def test_graphs_go_to_no_more_tasks_than_shards(spark):
    """Many shuffle partitions make no more copies of a graph than there are of a vector."""
    x = np.random.default_rng(5).normal(size=(200, 4))
    nodes = near_vectors.unit_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    nodes = nodes.selectExpr("id node", "v", "1L copies").cache()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 90)
    try:
        links = near_vectors.near_links(nodes, near_vectors.build_graphs(nodes, 3), 3, 0.95, 24)
        assert links.rdd.getNumPartitions() == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert {r["a"]: r["near"] for r in links.groupBy("a").agg(F.sum("near").alias("near")).collect()} == {i: int(n) - 1 for i, n in enumerate((unit @ unit.T >= 0.95).sum(1)) if n > 1}


def test_a_search_of_a_large_shard_holds_little():
    """What marks seen nodes is bounded, and upper levels have rows only for the nodes that reach them."""
    x = np.random.default_rng(6).normal(size=(3000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = near_vectors.SmallWorld(x)
    assert sum(t.nbytes for t in graph.levels[1:]) <= 0.1 * graph.levels[0].nbytes
    want = {r: f.tolist() for r, f in graph.search(x[:512], 0.95, 24)}
    far = 600_000  # nodes that nothing leads to
    graph.unit = np.concatenate([graph.unit, np.zeros((far, 8), np.float32)])
    graph.levels[0] = np.concatenate([graph.levels[0], np.full((far, graph.levels[0].shape[1]), -1, np.int32)])
    tracemalloc.start()
    got = {r: f.tolist() for r, f in graph.search(x[:512], 0.95, 24)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and len(want) == 512
    assert peak < 100e6, peak


@pytest.mark.parametrize("partitions", [1, 7])
def test_vectors_in_small_batches_equal_brute_force(spark, partitions):
    """Vectors of three lengths with copies; graphs and the nodes that ask come in batches of 7 rows, which hold the ends of some shards and lengths."""
    rng = np.random.default_rng(15)
    vectors = [v for d, n in ((3, 90), (8, 120), (1, 6)) for v in rng.normal(size=(n, d)).tolist()]
    vectors += [(2.0 * np.array(v)).tolist() for v in vectors[::9]] + [None, [], [0.0, 0.0, 0.0], [0.0, -1.0, 0.0], [-0.0, -1.0, 0.0]]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["id"]: r for r in near_vectors.near_vectors(table, recall=1.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in enumerate(vectors) if v and np.any(v)}
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in unit}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(links.get(i, ())) for i in range(len(vectors))}
    label = {i: i for i in range(len(vectors))}
    while (new := {i: min([label[i], *(label[j] for j in links.get(i, ()))]) for i in label}) != label:
        label = new
    assert {i: r["component_id"] for i, r in got.items()} == label


def test_rounds_over_topics_read_blocks(spark):
    """What a round reads is a row for many vectors of one language; none is lost or mixed up, and many languages are not held at once."""
    rows = [(i, " ".join(f"w{i * k % 997}" for k in range(1 + i % 30)), f"l{i % 2 if i < 1500 else i}") for i in range(1700)] + [(5000, "", "l0"), (5001, None, "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    blocks = topics._blocks(docs.select("lang", topics.vector_column(F.col("text")).alias("vector"))).collect()
    got = Counter((r["lang"], v) for r in blocks for v in (bytes(r["vectors"][at : at + 4 * topics.SLOTS]) for at in range(0, len(r["vectors"]), 4 * topics.SLOTS)))
    assert got == Counter((la, topics.word_vector(t).tobytes()) for _, t, la in rows)
    assert len(blocks) <= 200 + 3 * 2 + len(rows) // topics.BLOCK, "a row a block, not a row a document"
    assert all(len(r["vectors"]) <= 4 * topics.SLOTS * topics.BLOCK for r in blocks)
