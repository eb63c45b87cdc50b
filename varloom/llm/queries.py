"""The queries over the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import centroids, exact_dedup, language_id, license_scan, lm_scoring, mixing, near_vectors, packing, repeats, simhash, token_counts, toxicity, vector_codes
from varloom.llm.common import read_table, remainder, shared_dir

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.col("tox_segments").alias("n_segments"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"), F.round("mix_rate", 6).alias("rate"), F.col("mix_kept").alias("kept"), F.col("mix_copies").alias("copies"))


def op2_mixing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target against achieved token share of every source, language and topic."""
    shares = mixing.report(mixing.mix(read_table(spark, sf_dir, "documents"), carry=["source", "lang"]))
    return shares.select("dimension", "value", *[F.round(c, 6).alias(c) for c in ("natural", "target", "kept", "copied")])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    named = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return named.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own, empty at first: the query does the whole work, whatever ran before it.
    cache = f"{shared_dir(spark)}/varloom-token-cache-{uuid.uuid4().hex}"
    counted = token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE), cache)
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


def op4_token_counts_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts through a cache that an earlier run has filled: every digest is a hit, nothing is encoded again."""
    cache = f"{shared_dir(spark)}/varloom-token-cache-{uuid.uuid4().hex}"
    docs, tokenizer = read_table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE)
    token_counts.fill_cache(docs, tokenizer, cache)
    counted = token_counts.count_tokens(docs, tokenizer, cache)
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors.near_vectors(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept", "audited_recall", "audited_links")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "template", F.round("containment", 6).alias("containment"), "first_word", "windows")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _whole_vectors(scale: int, more: str) -> str:
    """(vec_id, label, x): the usable vectors of embeddings as scaled integers."""
    x = f"list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT)"
    return f"SELECT vec_id, label, {x} AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0{more}"


def _centroids_sql(rounds: int = 3) -> str:
    """Each round over component rows: distances by differences, no bit planes."""
    ctes = [
        f"k AS MATERIALIZED ({_whole_vectors(64, ' AND len(embedding) = 64')})",
        "e AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS d, unnest(x) AS v FROM k)",
        "c0 AS MATERIALIZED (SELECT r - 1 AS c, unnest(range(1, 65)) AS d, unnest(x) AS v FROM (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id)) AS r FROM k) WHERE r <= 16)",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT vec_id, min({{'s': s, 'c': c}}) AS best FROM (SELECT vec_id, c, sum((e.v - c{n}.v) * (e.v - c{n}.v)) AS s FROM e JOIN c{n} USING (d) GROUP BY vec_id, c) GROUP BY vec_id)")
        if n < rounds:
            mean = f"SELECT best.c AS c, d, floor(sum(v) / count(*))::BIGINT AS v FROM e JOIN a{n} USING (vec_id) GROUP BY 1, 2"
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, c{n}.d, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN ({mean}) m USING (c, d))")
    return f"""
        WITH {", ".join(ctes)},
        f AS (SELECT vec_id, best.c::INTEGER AS cluster, best.s::BIGINT AS distance FROM a{rounds}),
        h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM f JOIN h ON cluster = c
    """


def _codes_sql(rounds: int = 6) -> str:
    """Each round over component rows: distances by differences, no dictionaries."""
    ctes = [
        f"k AS MATERIALIZED ({_whole_vectors(4096, '')})",
        "e AS MATERIALIZED (SELECT vec_id, unnest(range(0, len(x))) AS d, unnest(x) AS v, len(x) // 8 AS w FROM k)",
        "c0 AS MATERIALIZED (SELECT r - 1 AS c, unnest(range(0, len(x))) AS d, unnest(x) AS v FROM (SELECT x, row_number() OVER (ORDER BY vec_id) AS r FROM k) WHERE r <= 16)",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT vec_id, p, min({{'s': s, 'c': c}}) AS best FROM (SELECT vec_id, d // w AS p, c, sum((e.v - c{n}.v) * (e.v - c{n}.v)) AS s FROM e JOIN c{n} USING (d) GROUP BY vec_id, p, c) GROUP BY vec_id, p)")
        if n < rounds:
            mean = f"SELECT best.c AS c, d, floor(sum(v) / count(*))::BIGINT AS v FROM e JOIN a{n} ON e.vec_id = a{n}.vec_id AND d // w = p GROUP BY 1, 2"
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, c{n}.d, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN ({mean}) m USING (c, d))")
    return f"""
        WITH {", ".join(ctes)},
        f AS (SELECT vec_id, string_agg(printf('%02x', best.c), '' ORDER BY p) AS code, sum(best.s)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY d // (SELECT max(w) FROM e), c, d)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN k USING (vec_id), h
    """


def _license_sql() -> str:
    """Every template against every text, shingle by shingle: no bands."""
    values = ", ".join(f"('{name}', '{' '.join(license_scan.template_words(text))}', {license_scan.window_width(text)})" for name, text in license_scan.TEMPLATES)
    shingles = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"
    return f"""
        WITH t AS (SELECT * FROM (VALUES {values}) v(template, body, width)),
        tw AS (SELECT template, width, string_split(body, ' ') AS w FROM t),
        ts AS (SELECT DISTINCT template, width, unnest({shingles}) AS s FROM tw),
        tn AS (SELECT template, count(*) AS total FROM ts GROUP BY template),
        d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
        ds AS (SELECT doc_id, len(w) - 4 AS n, unnest({shingles}) AS s, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5),
        hit AS (SELECT doc_id, ds.n, p, template, width, s FROM ds JOIN ts USING (s)),
        win AS (
            SELECT DISTINCT doc_id, template, width, s, unnest([p // width * width, p // width * width - width]) AS first_word, n FROM hit
        ),
        share AS (
            SELECT doc_id, template, first_word, count(DISTINCT s) / any_value(tn.total) AS containment
            FROM win JOIN tn USING (template)
            WHERE first_word >= 0 AND first_word <= greatest(0, win.n - 1 - width) GROUP BY doc_id, template, first_word
        )
        SELECT doc_id, template, round(max(containment), 6) AS containment, min_by(first_word, (-containment, first_word))::INTEGER AS first_word, count(*) AS windows
        FROM share WHERE containment >= 0.8 GROUP BY doc_id, template
    """


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op2_mixing_report": op2_mixing_report,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op4_token_counts_cached": op4_token_counts_cached,
    "op5_near_vectors": op5_near_vectors,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_simhash": op9_simhash,
    "op10_license_scan": op10_license_scan,
    "op11_repeats": op11_repeats,
    "op12_centroids": op12_centroids,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(content) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY content)
    """,
    "op10_license_scan": _license_sql(),
    "op12_centroids": _centroids_sql(),
    "op13_vector_codes": _codes_sql(),
}
