"""Licence scans with DataFrame functions alone: MinHash bands over text windows, then exact shingle containment."""

from __future__ import annotations

import re
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import shingle_hashes, written
from varloom.llm.license_texts import TEMPLATES

WORDS = 5
#: Templates of fewer shingles have no sketch: all their shingles are looked up.
SKETCHED = 5


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def sketch_size(width: int, shingles: int, containment: float = 0.8, miss: float = 0.001) -> int:
    """How many smallest hashes a window must keep, so that a window that holds `containment` of a template of that many
    shingles has one of them in common with the template's own but for a chance of `miss`. Each kept hash is a band of one
    row. The kept hashes of the union are a draw without replacement, of which the shared shingles are the good ones."""
    shared = max(1, -int(-containment * shingles // 1))
    union = 2 * width + shingles - shared
    for k in range(1, 2 * width):
        if comb(union - shared, k) / comb(union, k) <= miss:
            return k
    return 2 * width


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def template_shingles(text: str) -> list[str]:
    """The distinct five-word shingles of a template; fewer than five words are refused."""
    w = template_words(text)
    if len(w) < WORDS:
        raise ValueError(f"a template has fewer than {WORDS} words: {text}")
    return sorted({" ".join(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)})


def window_width(text: str) -> int:
    """A power of two, 16 at least, that holds the template's shingles."""
    width = 16
    while width < len(template_words(text)) - WORDS + 1:
        width *= 2
    return width


def scan(
    docs: DataFrame,
    templates=TEMPLATES,
    containment: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, template, containment, first_word, windows): for each text and template the largest containment of the
    template's five-word shingles in one window, where it starts, and how many windows reach `containment`.

    A template of at most `width` shingles lies whole in one window of 2 x width shingles that starts at a multiple of
    width; widths are powers of two from 16 up to what the longest template needs, and only those that occur are used. A
    window keeps its k smallest shingle hashes (bottom-k MinHash, each a band) with k solved for each template by itself, and
    their join with the template's own k retrieves candidates; templates of under SKETCHED shingles, for which no sketch is
    smaller than the window, are retrieved by any shingle. Each candidate is then verified on the words themselves.

    A text that holds none of the hashes that any template could be retrieved by has no candidate and is left out before
    windows are cut. The template table is a constant of the call, so it may be broadcast. Nothing but matches is shuffled.
    NULL and empty texts and texts under five words match nothing; very long texts are scanned whole. Of windows of equal
    containment the first is named. Rows of one id, repeated or not, count as one text's windows; a NULL id is an id.
    """
    spark = docs.sparkSession
    rows = []
    for name, text in templates:
        known, width = template_shingles(text), window_width(text)
        k = 2 * width if len(known) < SKETCHED else sketch_size(width, len(known), containment)
        rows.append((name, width, k, known))
    table = spark.createDataFrame(rows, "template string, width int, k int, shingles array<string>")
    own = F.sort_array(F.transform("shingles", lambda s: F.xxhash64(*[F.xxhash64(F.split_part(s, F.lit(" "), F.lit(j + 1))) for j in range(WORDS)])))
    bands = table.select("template", "width", "k", "shingles", F.explode(F.slice(own, 1, F.col("k"))).alias("band"))
    sought = [r["band"] for r in bands.select("band").distinct().collect()]  # constants of the call: k hashes a template at most

    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.exists(shingle_hashes(words_of(F.col("text")), WORDS), lambda x: x.isin(sought)))
    held = written(held, "licence-texts").withColumn("w", words_of(F.col("text")))
    hashed = held.select("id", "w", shingle_hashes(F.col("w"), WORDS).alias("h"), F.greatest(F.lit(0), F.size("w") - (WORDS - 1)).alias("n"))
    found = None
    for width in sorted({r[1] for r in rows}):
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - 1 - F.lit(width)), F.lit(width))
        # Each window takes along its own words and hashes alone, so that a very long text is never copied as a whole.
        cut_out = F.transform(
            starts,
            lambda s: F.struct(s.alias("first_word"), F.slice("w", s + 1, 2 * width + WORDS - 1).alias("win"), F.slice("h", s + 1, F.least(F.lit(2 * width), F.col("n") - s)).alias("own")),  # noqa: B023  called at once
        )
        windows = hashed.select("id", F.explode(cut_out).alias("v")).select("id", "v.first_word", "v.win", "v.own")
        most = max(r[2] for r in rows if r[1] == width)
        sketches = windows.select("id", "first_word", "win", F.posexplode(F.slice(F.sort_array(F.array_distinct("own")), 1, most)).alias("rank", "band"))
        mine = bands.where(F.col("width") == width).select("template", "k", "shingles", "band")
        candidates = sketches.join(F.broadcast(mine), "band").where("rank < k").select("id", "first_word", "template", "shingles", "win").distinct()
        five = F.transform(F.sequence(F.lit(1), F.size("win") - (WORDS - 1)), lambda i: F.concat_ws(" ", *[F.get("win", i + (j - 1)) for j in range(WORDS)]))
        share = F.size(F.array_intersect("shingles", five)) / F.size("shingles")
        verified = candidates.select("id", "first_word", "template", share.alias("containment")).where(F.col("containment") >= containment)
        found = verified if found is None else found.unionByName(verified)
    return found.distinct().groupBy("id", "template").agg(
        F.max("containment").alias("containment"), F.min(F.struct(-F.col("containment"), "first_word"))["first_word"].alias("first_word"), F.count_distinct("first_word").alias("windows")
    )
