"""Repeated strings, centroid clustering and vector codes against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import centroids, queries, repeats, vector_codes

SF = "/root/testdata/sf0.001"


def brute_removed(texts: list[bytes], window: int = 100) -> list[tuple[int, int, str]]:
    """(bytes removed, spans, sha256 of the rest) of texts in order of their ids."""
    seen, out = set(), []
    for text in texts:
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - window + 1):
            if text[i : i + window] in seen:
                gone[i : i + window] = True
            seen.add(text[i : i + window])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1)
        rest = bytes(b for b, g in zip(text, gone, strict=False) if not g)
        out.append((int(gone.sum()), len(edges), hashlib.sha256(rest).hexdigest()))
    return out


def awkward_texts(seed: int = 5) -> list[str]:
    """Shared passages in differing surroundings, near and exact copies, periodic and short texts, bytes beyond ASCII and NUL."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(300)}é" if rng.random() < 0.1 else f"v{rng.randrange(300)}" for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(n) for n in (18, 30, 60, 200)]
    texts = [f"{say(rng.randrange(40))} {rng.choice(passages)} {say(rng.randrange(40))}" for _ in range(40)]
    for base in texts[:8]:
        at = rng.randrange(len(base))
        texts += [base, base[:at] + "#" + base[at + 1 :], base + base]
    return [*texts, "a" * 700, "ab" * 300, "x" * 99, "x" * 100, "x" * 101, "\0" * 250, "", "abc" * 40 + "\0" * 130, ("0123456789" * 37)[:-3], passages[3], passages[3][1:]]


def test_transform_is_that_of_sorted_suffixes():
    texts = [b"banana", b"ananas", b"banana", b"\x00a\x00", b"\xff" * 5]
    last, begins = repeats.transform(texts)
    rows = sorted(((*[b + len(texts) for b in t[i:]], n), n, i) for n, t in enumerate(texts) for i in range(len(t) + 1))
    assert [(n, i) for _, n, i in rows] == list(zip(*map(np.ndarray.tolist, repeats.places(repeats.steps_back(last, begins), np.array([len(t) for t in texts]))), strict=True))
    assert [texts[n][i - 1] if i else 0 for _, n, i in rows] == last.tolist()
    assert [rows[b][1:] for b in begins] == [(n, 0) for n in range(len(texts))]


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merge_gives_intervals_and_common_prefixes(shards):
    rng = random.Random(shards)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    dealt = [texts[i::shards] for i in range(shards)]
    made = [repeats.transform(t) for t in dealt]
    rows, interval, common = repeats.merge(made, 6)
    placed = [(t, i) for part, m in zip(dealt, made, strict=True) for n, i in zip(*map(np.ndarray.tolist, repeats.places(repeats.steps_back(*m), np.array([len(t) for t in part]))), strict=True) for t in [part[n]]]
    by: dict[bytes, int] = {}
    for t, i in placed:
        for n in range(1, 7):
            if i + n <= len(t):
                by[t[i : i + n]] = by.get(t[i : i + n], 0) + 1
    want = [max((n for n in range(7) if i + n <= len(t) and (n == 0 or by[t[i : i + n]] > 1)), default=0) for t, i in placed]
    assert want == common.tolist()
    groups: dict[int, set] = {}
    for r, k in zip(rows.tolist(), interval.tolist(), strict=True):
        groups.setdefault(k, set()).add(placed[r][0][placed[r][1] : placed[r][1] + 6])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == sum(n > 1 for s, n in by.items() if len(s) == 6)


@pytest.mark.parametrize(("step", "heavy", "bucket", "batch"), [(1 << 20, 1 << 21, 1 << 20, 10_000), (333, 300, 500, 7), (1000, 1 << 21, 2000, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, step, heavy, bucket, batch):
    """Also with tiny steps, buckets and Arrow batches, and with every key split by whole strings."""
    monkeypatch.setattr(repeats, "STEP", step)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        texts = awkward_texts()
        ids = list(range(len(texts)))
        random.Random(2).shuffle(ids)
        docs = spark.createDataFrame([(ids[i], t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
        got = {r["id"]: r for r in repeats.remove_repeats(docs, heavy=heavy, bucket=bucket, shards=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = sorted(range(len(texts)), key=lambda i: ids[i])
    for i, (removed, spans, sha) in zip(order, brute_removed([texts[i].encode() for i in order]), strict=True):
        r = got[ids[i]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(texts[i].encode()), removed, spans, sha), texts[i][:80]
        assert hashlib.sha256(r["kept"]).hexdigest() == sha


def test_repeats_over_odd_tables(spark, odd, none):
    """NULL and repeated ids: ordered by id, then by the digest of the text, NULL last; equal rows are one document."""
    docs = odd.unionByName(odd.where("doc_id = 6")).withColumnRenamed("lang", "kept")
    rows = docs.select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    distinct = sorted({(r["doc_id"] is None, r["doc_id"] or 0, sha(r["text"]), r["text"] or "") for r in rows})
    want = {d[:3]: w for d, w in zip(distinct, brute_removed([d[3].encode() for d in distinct]), strict=True)}
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["id"]), r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((str(r["doc_id"]), *want[(r["doc_id"] is None, r["doc_id"] or 0, sha(r["text"]))]) for r in rows)
    named = repeats.remove_repeats(docs.selectExpr("cast(doc_id as string) doc_id", "text")).collect()
    assert sum(r["n_removed"] for r in named) > 0 and len(named) == len(rows)
    assert repeats.remove_repeats(none).count() == 0


def test_op11_equals_brute_force(spark):
    given = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op11_repeats(spark, SF)
    assert [f"{c} {t}" for c, t in got.dtypes] == ["doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"]
    texts = [(r["text"] or "").encode() for r in given]
    assert sorted(tuple(r) for r in got.collect()) == [(r["doc_id"], len(t), *w) for r, t, w in zip(given, texts, brute_removed(texts), strict=True)]
    assert sum(w[0] for w in brute_removed(texts)) > 0


# --- integer vectors ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("low", "high", "dims"), [(-64, 64, 64), (-5, 0, 7), (0, 1, 64), (-(2**27), 2**27, 130), (-1, 0, 64)])
def test_popcounts_equal_dot_products(low, high, dims):
    rng = np.random.default_rng(dims)
    x, c = rng.integers(low, high, (50, dims)), rng.integers(low, max(high, 1), (4, dims))
    planes = centroids.pack(x)
    assert (centroids.unpack(planes, dims) == x).all()
    for row in c:
        assert (centroids.dots(planes, centroids.pack(row[None])[0]) == x @ row).all()
    assert (centroids.squares(planes) == (x * x).sum(1)).all()
    best, distance = centroids.nearest(planes, c)
    table = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (best == table.argmin(1)).all() and (distance == table.min(1)).all()


def usable(v, dims=None):
    return v is not None and (dims is None or len(v) == dims) and all(x is not None and np.isfinite(x) for x in v)


def brute_clusters(rows):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if usable(v, 64)]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    c = np.array([x for _, x in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1].tolist()))[:16]])
    x = np.array([x for _, x in kept])
    for n in range(4):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        best = d.argmin(1)
        if n < 3:
            c = np.array([x[best == k].sum(0) // max(1, (best == k).sum()) if (best == k).any() else c[k] for k in range(len(c))])
    least = d.min(1)
    return sorted((str(i), int(b), int(s), int(least[best == b].sum()), int(least.sum()), hashlib.sha256(",".join(map(str, c[b])).encode()).hexdigest()) for (i, _), b, s in zip(kept, best, least, strict=True))


def brute_codes(rows, parts=8):
    kept = [(i, label, np.floor(4096 * np.array(v, float)).astype(int)) for i, label, v in rows if usable(v)]
    out, total = [], {}
    for dims in sorted({len(x) for *_, x in kept}):
        mine = [r for r in kept if len(r[2]) == dims]
        if dims % parts:
            out += [(str(i), label, None, None, None) for i, label, _ in mine]
            continue
        x, w = np.array([r[2] for r in mine]).reshape(len(mine), dims), dims // parts
        c = np.array([r[2] for r in sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))[:16]]).reshape(min(16, len(mine)), dims)
        for n in range(7):
            best, error = [], 0
            for p in range(parts):
                own, book = x[:, p * w : (p + 1) * w], c[:, p * w : (p + 1) * w]
                d = ((own[:, None] - book[None]) ** 2).sum(2)
                best.append(d.argmin(1))
                error = error + d.min(1)
                if n < 6:
                    c[:, p * w : (p + 1) * w] = [own[best[p] == k].sum(0) // (best[p] == k).sum() if (best[p] == k).any() else book[k] for k in range(len(c))]
        sha = hashlib.sha256(",".join(str(v) for p in range(parts) for row in c for v in row[p * w : (p + 1) * w]).encode()).hexdigest()
        out += [(str(i), label, "".join(f"{b[r]:02x}" for b in best), int(error[r]), sha) for r, (i, label, _) in enumerate(mine)]
    for _, label, _, error, _ in out:
        if error is not None:
            total[label] = total.get(label, 0) + error
    return sorted((i, str(code), str(error), str(total.get(label)), str(sha)) for i, label, code, error, sha in out)


def vector_rows(n=150, seed=4):
    """Clusters, copies, negative and large values, unusable vectors, other lengths, repeated and NULL ids and labels."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, 64))
    rows = [(i, None if i % 7 == 0 else i % 3, (middles[i % 9] * (30 if i % 11 == 0 else 1) + 0.1 * rng.normal(size=64)).tolist()) for i in range(n)]
    rows += [(3, 1, rows[0][2]), (3, 1, rows[3][2]), (None, None, rows[5][2]), (500, 2, None), (501, 2, [None] * 64), (502, 2, [float("nan")] + [0.0] * 63), (503, 2, [float("inf")] + [0.0] * 63)]
    return rows + [(600 + i, 1, rng.normal(size=16).tolist()) for i in range(5)] + [(700, 1, [0.5] * 7), (701, None, []), (702, 0, [0.0] * 64)]


VECTORS = "vec_id long, label int, embedding array<double>"


def test_clusters_equal_brute_force(spark):
    rows = vector_rows()
    table = spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "cluster").repartition(3)
    assert sorted((str(r["id"]), *r[1:]) for r in centroids.cluster(table).collect()) == brute_clusters([(i, v) for i, _, v in rows])
    few = rows[:5]
    assert sorted((str(r["id"]), *r[1:]) for r in centroids.cluster(spark.createDataFrame(few, VECTORS)).collect()) == brute_clusters([(i, v) for i, _, v in few])
    same = [(i, 0, [0.25] * 64) for i in range(40)]
    assert {r["cluster"] for r in centroids.cluster(spark.createDataFrame(same, VECTORS)).collect()} == {0}
    none = centroids.cluster(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, 1, [1e30] * 64)], VECTORS)).collect()


@pytest.mark.parametrize(("block", "few"), [(32_768, 100_000), (17, 0)])
def test_codes_equal_brute_force(spark, monkeypatch, block, few):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    monkeypatch.setattr(vector_codes, "FEW_LABELS", few)
    rows = vector_rows()
    table = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("mine")).repartition(3)
    got = vector_codes.compress(table)
    assert got.columns == ["id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == brute_codes(rows)
    none = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns == got.columns


def test_dictionaries_round_trip():
    x = np.random.default_rng(1).integers(-50, 50, (300, 8))
    block = vector_codes.Block.load(vector_codes.Block.of(x).dump())
    assert (np.stack([v[c] for v, c in zip(block.values, block.codes, strict=True)], 1) == x).all()
    entries = x[:5, 2:6]
    assert (block.distances(range(2, 6), entries) == ((x[None, :, 2:6] - entries[:, None]) ** 2).sum(2)).all()
    best = np.arange(300) % 5
    assert (block.sums(range(2, 6), best, 5) == np.stack([x[best == k, 2:6].sum(0) for k in range(5)])).all()
