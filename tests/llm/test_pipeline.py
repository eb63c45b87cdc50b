"""The pipeline against a brute-force version of what each stage may keep."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from varloom.llm import queries, topics, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_hand_documents_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        assert after.exceptAll(before).count() == 0, f"{name} changes rows"
        assert after.count() <= before.count()
        if name == "exact_dedup":
            texts = [(r["text"] or "").lower() for r in after.collect()]
            assert len(set(texts)) == len(texts)
        before = after
    kept = {r["doc_id"] for r in before.collect()}
    rows = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r["doc_id"] for r in rows} == kept
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def components(nodes, linked):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in nodes:
        for j in nodes:
            if i < j and linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in nodes}


def brute_mix(spark, rows, budget=0.8):
    """The kept documents of the default mixture: rates raked under the bound of 1, cell by cell; the topics come from the model."""
    model = topics.fit_topics(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string"))
    named = model.names([r["text"] for r in rows], [r["lang"] or "" for r in rows])
    cell = {r["doc_id"]: (r["source"] or "", r["lang"] or "", t) for r, t in zip(rows, named, strict=True)}
    size, sums = Counter(), [Counter(), Counter(), Counter()]
    for r in rows:
        n = len((r["text"] or "").encode().split())
        size[cell[r["doc_id"]]] += n
        for d in range(3):
            sums[d][cell[r["doc_id"]][d]] += n
    total = sum(size.values())
    w, goals = dict.fromkeys(size, budget), []
    for have in sums:
        p = {v: n**0.7 for v, n in have.items() if n}
        goal = {v: x * total / sum(p.values()) for v, x in p.items()}
        whole = set()
        while True:
            level = (budget * total - sum(have[v] for v in whole)) / sum(g for v, g in goal.items() if v not in whole)
            more = {v for v in goal if v not in whole and goal[v] * level > have[v]}
            if not more:
                break
            whole |= more
        goals.append({v: have[v] if v in whole else g * level for v, g in goal.items()})
    for _ in range(2000):
        off = 0.0
        for d in range(3):
            got = Counter()
            for c, n in size.items():
                got[c[d]] += n * min(1.0, w[c])
            off = max([off, *(abs(got[v] - g) for v, g in goals[d].items())])
            w = {c: min(1e12, x * goals[d].get(c[d], got[c[d]]) / got[c[d]]) if got[c[d]] else x for c, x in w.items()}
        if off <= 1e-5 * total:
            break
    low, high = 0.0, 1e6
    for _ in range(300):
        mid = (low + high) / 2 if low else high / 1e3
        low, high = (mid, high) if sum(n * min(1.0, w[c] * mid) for c, n in size.items()) < budget * total else (low, mid)
    return {i for i, c in cell.items() if int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) / 16**12 < min(1.0, w[c] * high)}


def test_run_equals_brute_force(spark):
    """run() against plain Python on the same documents; the learned scores alone come from the operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    rows = [r for r in scored if r["tox_score"] < toxicity.THRESHOLD]
    largest = {}
    for r in rows:
        largest[lower(r["text"])] = max(r["doc_id"], largest.get(lower(r["text"]), r["doc_id"]))
    rows = [r for r in rows if largest[lower(r["text"])] == r["doc_id"]]
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = components(list(sets), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    rows = [r for r in rows if group[r["doc_id"]] == r["doc_id"]]
    want = brute_mix(spark, rows)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in got}
    assert 20 < len(want) < len(rows) and len(kept ^ want) <= 1, "but for a draw within the tolerance of the raking"
    pieces, ends = defaultdict(int), defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.array([*library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert r["offset"] == ends[r["sequence_id"]] and r["start"] == 2048 * r["piece"]
        ends[r["sequence_id"]] += r["length"]
        pieces[r["doc_id"]] += r["length"]
        assert pieces[r["doc_id"]] <= len(ids)
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 2


@pytest.mark.parametrize("empty", [False, True])
def test_stages_over_odd_tables(spark, odd, tmp_path, empty):
    """NULLs, empty and long texts, repeated rows, no rows at all, and columns that carry the operators' own names."""
    docs = odd.limit(0) if empty else odd
    clash = [F.lit("mine").alias(c) for c in ("tox_score", "keep_id", "kept", "group_size", "text_sha256", "mix_kept", "mix_topic", "component_id", "sequence_id", "template")]
    docs = docs.select("*", *clash)
    spark.read.parquet(f"{SF}/labels.parquet").limit(0 if empty else 100).write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert not Counter(map(str, rows)) - Counter(map(str, before.collect())), name
        before = spark.createDataFrame(rows, docs.schema)
        if name == "exact_dedup" and not empty:
            assert sorted(str(r["doc_id"]) for r in before.collect()) == sorted(["-8", "2", "4", "5", "6", "7"])
    out = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out)


CONTRACTS = {
    "op1_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int", (4, 2)),
    "op3_language_id": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double", (5, 0)),
    "op4_token_counts": ("documents", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", None),
    "op5_near_vectors": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean", None),
    "op7_exact_dedup": ("documents", "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string", None),
    "op8_lm_scoring": ("documents", "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double", (5, 1)),
    "op9_simhash": ("documents", "doc_id bigint, fingerprint string, component_id bigint", None),
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_registered_queries_keep_their_contracts(spark, name):
    """A row for each row of the table, columns and types as agreed, held-out rows by crc32, and plain checks of the values."""
    table, columns, fold = CONTRACTS[name]
    got = queries.QUERIES[name](spark, SF)
    assert columns.split(", ") == [f"{c} {t}" for c, t in got.dtypes][: len(columns.split(", "))]
    key = columns.split()[0]
    given = {r[key]: r for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()}
    rows = {r[key]: r for r in got.collect()}
    assert set(rows) == set(given) and got.count() == len(given)
    for i, r in rows.items():
        if fold:
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % fold[0] == fold[1])
        if name in ("op1_toxicity", "op3_language_id"):
            assert 0 <= r["score"] <= 1
        if name == "op1_toxicity":
            assert r["predicted"] == (r["score"] >= 0.3)
        if name == "op3_language_id":
            assert r["lang_pred"] in {d["lang"] for d in given.values()} | {"und"}
        if name == "op4_token_counts":
            assert r["n_bytes"] == len((given[i]["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 1024)
    if name == "op4_token_counts":
        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert all(r["n_tokens"] == len(library.encode(given[i]["text"] or "", add_special_tokens=False).ids) for i, r in rows.items())
        assert sorted(queries.op4_token_counts_cached(spark, SF).collect()) == sorted(rows.values())
    if name == "op5_near_vectors":
        x = {i: np.array(r["embedding"], float) / np.linalg.norm(r["embedding"]) for i, r in given.items()}
        group = components(list(x), lambda i, j: x[i] @ x[j] >= 0.95)
        assert {i: r["component_id"] for i, r in rows.items()} == group
        assert {i: r["n_links"] for i, r in rows.items()} == {i: sum(x[i] @ x[j] >= 0.95 for j in x) - 1 for i in x}
    if name in ("op1_toxicity", "op3_language_id"):
        marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        told = [(r["predicted"], marks[i]) for i, r in rows.items() if r["held_out"] and i in marks] if name == "op1_toxicity" else [(r["lang_pred"], given[i]["lang"]) for i, r in rows.items() if r["held_out"] and given[i]["lang"]]
        assert sum(a == b for a, b in told) >= 0.85 * len(told)
    if name == "op8_lm_scoring":
        held = [r for r in rows.values() if r["held_out"] and r["n_tokens"] > 20]
        assert sum(r["bits_per_byte"] for r in held) < 3 * len(held) and all(r["score"] < 0 for r in rows.values())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_sql_queries(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall())), name


def test_near_links_equal_brute_force(spark):
    """Chains, templates with words of their own, copies and blank texts: the components of the links are those of all pairs at 0.8."""
    from varloom.llm import near_copies
    from varloom.llm.components import connected_components

    rng = random.Random(11)
    plate = [f"b{i}" for i in range(60)]
    texts = ["", " ", "a b", "a b", "a b c d e", "A B c d e"]
    for _ in range(60):  # one boilerplate, few words of one's own: below the threshold, though lists are long
        own = list(plate)
        for at in rng.sample(range(60), 4):
            own[at] = f"o{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    chain = [f"c{i}" for i in range(80)]
    for step in range(12):  # each near the one before, the ends far apart
        chain = [*chain[2:], f"d{step}a", f"d{step}b"]
        texts.append(" ".join(chain))
    for _ in range(25):
        copy = list(plate) * 2
        copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("node", near_copies.text_key(F.col("text"))).repartition(4)
    links = near_copies.similar_links(rows.select("node", "text"))
    named = {bytes(r["node"]): bytes(r["component"]) for r in connected_components(links).collect()}
    label = {r["i"]: named.get(bytes(r["node"]), bytes(r["node"])) for r in rows.collect()}
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    group = components(range(len(texts)), lambda i, j: texts[i] == texts[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert {(i, j) for i in label for j in label if label[i] == label[j]} == {(i, j) for i in group for j in group if group[i] == group[j]}
    assert 10 < len(set(group.values())) < len(texts)


@pytest.mark.parametrize("stars", [0, 2])
def test_copies_that_are_only_just_similar(spark, monkeypatch, stars):
    """One group whose pairs lie on both sides of the threshold, and texts of other sizes around it: the components are those of brute
    force, whether lists draw further heads or leave all to the rare shingles."""
    from varloom.llm import near_copies
    from varloom.llm.components import connected_components

    monkeypatch.setattr(near_copies, "STARS", stars)
    rng = random.Random(11)
    base, texts = [f"b{i}" for i in range(220)], []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randrange(1, 9)):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words[: rng.choice([220, 220, 200, 170, 150])] + [f"y{k}"] * (k % 3)))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("node", near_copies.text_key(F.col("text"))).repartition(4)
    links = near_copies.similar_links(rows.select("node", "text"))
    named = {bytes(r["node"]): bytes(r["component"]) for r in connected_components(links).collect()}
    label = {r["i"]: named.get(bytes(r["node"]), bytes(r["node"])) for r in rows.collect()}
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    group = components(range(len(texts)), lambda i, j: texts[i] == texts[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert {(i, j) for i in label for j in label if label[i] == label[j]} == {(i, j) for i in group for j in group if group[i] == group[j]}
    assert 1 < len(set(group.values())) < len(texts)


def test_near_copies_leave_by_similarity(spark, odd, none):
    """Groups of the near-copy stage are those of brute-force Jaccard >= 0.8 over five words."""
    rng = random.Random(3)
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 200))]
        for copy in range(3):
            changed = list(words)
            for at in rng.sample(range(len(words)), copy * len(words) // 60):
                changed[at] = f"x{rng.randrange(10**6)}"
            rows.append((3 * base + copy, " ".join(changed)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i for i in sets if find(i) == i}
    assert 40 < len(want) < len(rows)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in stage(spark, docs, SF).collect()) == sorted(want)
    assert stage(spark, none, SF).count() == 0
    assert {r["doc_id"] for r in stage(spark, odd, SF).collect()} == {1, 3, 6, 7, -8}


def test_near_copies_are_retrieved_by_simhash(spark, monkeypatch):
    """The stage asks the index of fingerprints: what its pairs connect is what all pairs of at most two differing bits connect, and its links are verified."""
    from varloom.llm import near_copies, simhash
    from varloom.llm.components import connected_components

    rng = random.Random(6)
    texts = ["", "  ", "a b", "A b"]
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts.append(" ".join(words))
        for n in (1, 2):
            words[rng.randrange(400)] = f"x{n}"
            texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("node", near_copies.text_key(F.col("text"))).repartition(3)
    named = {bytes(r["node"]): bytes(r["component"]) for r in connected_components(near_copies.simhash_pairs(rows.select("node", "text"), 5)).collect()}
    label = {r["i"]: named.get(bytes(r["node"]), bytes(r["node"])) for r in rows.collect()}
    fps = [simhash.fingerprint(t, 5) for t in texts]
    group = components(range(len(texts)), lambda i, j: ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2)
    assert {(i, j) for i in label for j in label if label[i] == label[j]} == {(i, j) for i in group for j in group if group[i] == group[j]}
    assert len(set(group.values())) < len(texts) - 5
    near_pairs, asked = near_copies.simhash_pairs, []
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda *a: asked.append(a) or near_pairs(*a))
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, rows.select(F.col("i").cast("long").alias("doc_id"), "text"), SF).count() == 32 and len(asked) == 1


def test_components_stop_when_they_are_settled(spark, monkeypatch):
    """Stars and empty tables take no round; paths, rings and hubs are joined as brute force joins them, and a table of later links joins what they connect."""
    from varloom.llm import components, near_copies

    wrote = []
    write = components.written
    monkeypatch.setattr(components, "written", lambda df, name: wrote.append(name) or write(df, name))
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    named = lambda df: {r["node"]: r["component"] for r in df.collect()}
    assert named(components.connected_components(table([]))) == {} and len(wrote) == 1
    assert named(components.connected_components(table([(1, 5), (7, 1), (1, 9), (2, 2), (None, 3), (4, 6)]))) == {1: 1, 5: 1, 7: 1, 9: 1, 4: 4, 6: 4} and len(wrote) == 2, "one write each, no round"
    rng = random.Random(4)
    first = [(i, i + 1) for i in range(100, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300 + i) for i in range(1, 30)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(70)]
    later = [(139, 305), (201, 600), (600, 601), (700, 701), (410, 101), (5, 700)]

    def of(rows):
        least = {x: x for r in rows for x in r}
        for _ in least:  # far enough for the longest path
            for a, b in rows:
                least[a] = least[b] = min(least[a], least[b])
        return least

    apart = [r for r in first if r[0] != r[1]]
    got = components.connected_components(table(first))
    assert named(got) == of(apart)
    assert named(near_copies.joined_labels(got, table(later))) == of(apart + later)
    assert named(near_copies.joined_labels(got, table([]))) == of(apart)
    with pytest.raises(RuntimeError, match="settle"):
        components.connected_components(table([(i, i + 1) for i in range(60)]), max_rounds=1)


def test_rare_shingles_meet_where_enough_is_left(spark):
    """Nodes that share a shingle behind which too few are left for the similarity do not meet there; those at the bound do, within labels of many nodes too."""
    from varloom.llm import near_copies

    rows = [(1, left, bytes([node]), lab, 90) for node, lab, left in ((1, 1, 80), (2, 2, 80), (3, 3, 79), (4, 4, 90), (5, 4, 79), (6, 4, 80))]
    marks = [F.lit(0).cast("long").alias(m) for m in near_copies._MARKS]
    prefixes = spark.createDataFrame(rows, "h long, left int, node binary, lab long, n int").select("*", *marks)
    got = {(r["a"][0], r["b"][0]) for r in near_copies.prefix_pairs(prefixes, 0.8).collect()}
    assert got == {(1, 2), (1, 4), (1, 6), (2, 4), (2, 6)}
