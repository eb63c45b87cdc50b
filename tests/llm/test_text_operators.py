"""Exact dedup, SimHash, licences, token counts and packing against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from varloom.llm import exact_dedup, license_scan, packing, simhash, token_counts
from varloom.llm.components import connected_components
from varloom.llm.tokens import PieceCounts, WordIds


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_components_equal_union_find(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (205, 200), (204, 205), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200, 204: 200, 205: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_dedup(odd.withColumn("kept", F.lit("clash"))).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[ascii_lower(r["text"])].append(r["doc_id"])
    assert len(got) == odd.count()
    for r in got:
        ids = groups[ascii_lower(r["text"])]
        assert r["keep_id"] == max(i for i in ids if i is not None) and r["group_size"] == len(ids)
        assert r["text_sha256"] == hashlib.sha256(ascii_lower(r["text"]).encode()).hexdigest()
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_dedup(none).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_compares_contents(spark, odd, weak):
    """Also where a digest says next to nothing; clashing columns come back; repeated winners leave one row."""
    digest = {"digest": lambda c: F.struct((F.length(c) % 2).alias("h"))} if weak else {}
    rows = [(i, f"text {i % 7} {'AbC' if i % 2 else 'aBc'}") for i in range(60)] + [(59, "text 3 abc"), (None, "nobody"), (None, "Nobody"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("mine")).repartition(4)
    groups = defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t)].append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.exact_dedup(docs, **digest).collect()
    assert len(got) == len(rows)
    for r in got:
        t = ascii_lower(r["text"])
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (largest[t], len(groups[t]), r["doc_id"] == largest[t], hashlib.sha256(t.encode()).hexdigest())
    one = exact_dedup.keep_one_copy(docs, **digest)
    assert one.columns == docs.columns
    assert sorted((ascii_lower(r["text"]), str(r["doc_id"]), r["keep_id"]) for r in one.collect()) == sorted((t, str(i), "mine") for t, i in largest.items())
    assert exact_dedup.keep_one_copy(docs.limit(0), **digest).count() == 0
    assert exact_dedup.keep_one_copy(odd).count() == odd.select(F.lower(F.coalesce("text", F.lit("")))).distinct().count()


def brute_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(odd, none, sample):
    for docs, words in ((odd, 3), (sample[0].select("doc_id", F.substring("text", 1, 150).alias("text")), 2)):
        rows = docs.select("doc_id", "text").collect()
        prints = [brute_fingerprint(r["text"], words) for r in rows]
        root = list(range(len(rows)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    root[find(i)] = find(j)
        least = defaultdict(list)
        for i, r in enumerate(rows):
            least[find(i)].append(r["doc_id"])
        want = sorted((str(r["doc_id"]), f"{p:016x}", min(x for x in least[find(i)] if x is not None)) for i, (r, p) in enumerate(zip(rows, prints, strict=True)))
        got = simhash.simhash_groups(docs, words=words).select("id", simhash.hex_fingerprint(F.col("fp")).alias("h"), "component_id").collect()
        assert sorted((str(r["id"]), r["h"], r["component_id"]) for r in got) == want
    assert simhash.simhash_groups(none).count() == 0


@pytest.mark.parametrize("radius", [1, 2])
def test_simhash_tally_turns_pairs_away_and_long_lists_lose_nothing(spark, radius):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    near = np.concatenate([base, *[base ^ np.int64(1 << int(i)) for i in rng.integers(0, 62, 6)], *[base ^ np.int64((1 << int(i)) | 3) for i in rng.integers(2, 62, 6)]])
    one_block = (base[0] & ~np.int64(0xFFFFFFFF)) | rng.integers(0, 2**32, 3_000, dtype=np.int64)
    fps = np.unique(np.r_[near, one_block])
    bits = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64))
    want = {(int(fps[i]), int(fps[j])) for i, j in np.argwhere(bits <= radius) if i < j}
    table = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(3)
    whole = lambda links: {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    true = whole(want)
    for longest in (8, 10_000):
        links = {tuple(sorted(r)) for r in simhash.near_links(table, radius, longest).collect()}
        assert links <= want and whole(links) == true
    mine = np.sort(one_block)
    pairs, low = simhash.counted(mine, np.zeros(len(mine), np.int64), np.full(len(mine), [f.tolist() for f in simhash.FREE].index([0, 1, 2, 3])), radius)
    assert low > 10_000 and (np.bitwise_count((mine[pairs[:, 0]] ^ mine[pairs[:, 1]]).view(np.uint64)) <= radius).all()


def test_simhash_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 40)
    fps = {int(b) for b in base} | {int(b ^ (1 << int(i))) for b in base[:20] for i in rng.integers(0, 62, 6)} | {int(b ^ (1 << int(i)) ^ (1 << int(j))) for b in base[20:] for i, j in rng.integers(0, 62, (4, 2))}
    fps = sorted(fps)
    links = connected_components(simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")))
    got = {r["node"]: r["component"] for r in links.collect()}
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_tally_and_its_minimum():
    """Every pair within the radius reaches the minimum of shared positional bytes; pairs below it and pairs beyond the radius go."""
    rng = np.random.default_rng(7)
    a = rng.integers(-(2**63), 2**63 - 1, 500)
    b = a.copy()
    for i in range(500):
        for bit in rng.integers(0, 64, int(rng.integers(0, 6))):
            b[i] ^= np.int64(np.uint64(1 << int(bit)).astype(np.int64))
    same = [sum((int(x) >> 8 * p & 255) == (int(y) >> 8 * p & 255) for p in range(8)) for x, y in zip(a, b, strict=True)]
    bits = np.array([((int(x) ^ int(y)) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True)])
    assert simhash.tally(a, b).tolist() == same
    for radius in (1, 2):
        assert (simhash.tally(a, b)[bits <= radius] >= 8 - radius).all()
        pairs = np.stack([np.arange(500), np.arange(500) + 500], 1)
        assert simhash.checked(np.r_[a, b], pairs, radius)[:, 0].tolist() == np.flatnonzero(bits <= radius).tolist()
    assert (np.array(same)[bits == 3] < 6).any(), "the minimum filters something"


def test_license_scan(spark, odd, none):
    notice = "licensed under the apache license version 2.0"
    rows = [
        (1, "x " * 50 + "LICENSED under the Apache License, Version 2.0." + " y" * 50), (2, "nothing here at all but words and words"), (3, " ".join([notice] * 40)), (4, None), (5, "four words only here"),
        (6, "w " * 17 + "This work is licensed under the GNU General Public License, version 3 " + "z " * 90), (6, "w " * 17 + "This work is licensed under the GNU General Public License, version 3 " + "z " * 90), (7, "licensed under the apache license"),
    ]
    got = {(r["id"], r["template"]): r["containment"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "apache-2.0-notice"): 1.0, (3, "apache-2.0-notice"): 1.0, (6, "gpl-3.0-notice"): 1.0}
    assert {r["id"] for r in license_scan.scan(odd).collect()} == {-8}
    assert license_scan.scan(none).count() == 0


def brute_scan(rows, containment=0.8):
    """Every window of every text against every template, on the shingles themselves."""
    out = {}
    for i, text in rows:
        w = license_scan.template_words(text or "")
        own = [" ".join(w[j : j + 5]) for j in range(len(w) - 4)]
        for name, body in license_scan.TEMPLATES:
            known, width = set(license_scan.template_shingles(body)), license_scan.window_width(body)
            starts = range(0, max(0, len(own) - 1 - width) + 1, width) if own else ()
            shares = [(len(known & set(own[s : s + 2 * width])) / len(known), s) for s in starts]
            good = [(-c, s) for c, s in shares if c >= containment]
            if good:
                out[i, name] = (round(-min(good)[0], 9), min(good)[1], len(good))
    return out


def test_license_bodies_equal_brute_force(spark):
    """Whole licences, with words lost or changed, short and long, between other text and at either end."""
    rng = np.random.default_rng(4)
    rows = []
    for n, (_, body) in enumerate(license_scan.TEMPLATES):
        words = body.split()
        for k, lost in enumerate((0, 1, 4)):
            mine = [w for at, w in enumerate(words) if not (lost and at % (len(words) // lost + 1) == len(words) // (2 * lost))]
            filler = lambda m: [f"f{rng.integers(0, 50)}" for _ in range(m)]
            rows.append((10 * n + k, " ".join(filler(int(rng.integers(0, 90))) + mine + filler(int(rng.integers(0, 300))))))
    rows += [(1000, " ".join(b for _, b in license_scan.TEMPLATES)), (1001, None), (1002, "mit"), (1003, ""), (1004, "free of charge " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("template", F.lit("clash"))
    got = {(r["id"], r["template"]): (round(r["containment"], 9), r["first_word"], r["windows"]) for r in license_scan.scan(docs).collect()}
    want = brute_scan(rows)
    assert len(want) > 60 and got == want


def test_each_template_has_a_sketch_of_its_own():
    sizes = {n: license_scan.sketch_size(license_scan.window_width(t), len(license_scan.template_shingles(t))) / (2 * license_scan.window_width(t)) for n, t in license_scan.TEMPLATES}
    assert sizes["mit"] < 0.1 and sizes["bsd-3-clause"] < 0.05 and sizes["gpl-3.0-header"] < 0.1
    with pytest.raises(ValueError):
        license_scan.template_shingles("only four words here")


def test_license_templates_longer_than_a_window(spark):
    words = [f"word{i}" for i in range(90)]
    body = " ".join(words)
    rows = [(1, "pre " * 33 + body + " post" * 70), (2, "pre " * 33 + " ".join(words[:40])), (3, "pre " * 7 + " ".join(w if i != 45 else "other" for i, w in enumerate(words)))]
    got = {r["id"]: r["containment"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), [("long", body)]).collect()}
    assert got[1] == 1.0 and 2 not in got and abs(got[3] - 81 / 86) < 1e-9


def test_word_tables_equal_the_library():
    import random

    random.seed(1)
    letters = "ab'sZÉé \n\t12½²_-.ĳŉ<|>"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(1, 40))) for _ in range(2000)]
    texts += ["", None, "a<|endoftext|>b", "don't  stop\n\n x 's", "日本 語", "I'LL ½ ²", "İx ÅÄ ſt 1234 __a_b--", "Thing, thing. THING!", "..,"]
    for name, table in (("byte_bpe_50k.json", PieceCounts), ("word_bpe_49k.json", WordIds)):
        path = public_tokenizers.path(name)
        library, own = Tokenizer.from_file(path), table(path)
        for t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert (own.count(t) == len(ids)) if table is PieceCounts else (own.encode(t).tolist() == ids), t


def test_token_counts_and_their_cache(spark, odd, none, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    for _ in range(2):
        got = token_counts.count_tokens(odd, path, cache, limit=10)
        assert sorted((str(r["id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 10) for r in got.collect())
    stored = spark.read.parquet(cache)
    assert stored.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count(), "the second run encodes nothing"
    other = public_tokenizers.path("piece_bpe_32k.model")
    token_counts.count_tokens(odd, other, cache).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert token_counts.count_tokens(none, path, cache).count() == 0


def test_packing_is_an_exact_round_trip(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(odd, path, capacity=64).collect()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc_id, mine in pieces.items():
        copies = len(texts[doc_id])
        ids = texts[doc_id][0]
        assert sum(p["length"] for p in mine) == copies * len(ids)
        for p in mine:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["start"] == 64 * p["piece"]
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 64) + 2
    assert packing.pack_documents(none, path).count() == 0


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 500, 3000)
    for rule in ("norm", "dot"):
        bins, offset = packing.best_fit(lengths, 1000, 4, 400_000.0, rule)
        for b in np.unique(bins):
            mine = lengths[bins == b]
            assert mine.sum() <= 1000 and len(mine) <= 4 and (mine.astype(float) ** 2).sum() <= 400_000.0
            by = np.argsort(offset[bins == b])
            assert (offset[bins == b][by] == np.r_[0, np.cumsum(mine[by])[:-1]]).all()


def test_pack_under_limits_differs_from_one_dimension(spark):
    """Inside pack(): document and cost limits hold in every sequence, and place pieces elsewhere than tokens alone do."""
    rng = np.random.default_rng(8)
    lengths = np.minimum(1000, rng.lognormal(4.5, 1.3, 4000).astype(int) + 1)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], packing.PIECES)
    places = {}
    for limits in ({}, {"max_docs": 8, "max_cost": 500_000.0}):
        for rule in ("dot", "norm"):
            rows = packing.pack(pieces, 1000, rule=rule, **limits).collect()
            bins = defaultdict(list)
            for r in rows:
                bins[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
            for own in bins.values():
                own.sort()
                assert [o for o, *_ in own] == np.r_[0, np.cumsum([n for _, n, _ in own])[:-1]].tolist() and sum(n for _, n, _ in own) <= 1000
                if limits:
                    assert len(own) <= 8 and (len(own) == 1 or sum(n * n for _, n, _ in own) <= 500_000)
            if not limits:
                assert len(bins) <= -(-int(lengths.sum()) // 1000) + 2
            places[rule, bool(limits)] = {frozenset(d for *_, d in own) for own in bins.values()}
    for rule in ("dot", "norm"):
        assert len(places[rule, True] & places[rule, False]) < 0.5 * len(places[rule, True])
    assert places["dot", True] != places["norm", True]
