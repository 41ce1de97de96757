"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest different hashes of a text's shingles. The sketch of two parts together
is the k smallest of both sketches, so sketches of any parts can be merged in any order. Two sketches estimate
resemblance (shingles shared, of all), containment (shingles shared, of one side's) and the number of different
shingles; up to k shingles the values are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewash.llm.common import text_of

K = 128
WIDTH = 5
SPACES = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the words, which are what stands between ASCII white space."""
    return F.transform(F.array_remove(F.split(text, SPACES), ""), lambda w: F.xxhash64(w))


def sketch(hashes: Column, k: int = K, width: int = WIDTH) -> Column:
    """Bottom-k sketch of the ``width``-word shingles of a text given by its words' hashes.

    A text of fewer words is one shingle, an empty text none. ``hashes`` should be a column, not an expression, as it is
    used for each shingle.
    """
    whole = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)])
    )
    short = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    shingles = F.when(F.size(hashes) >= width, whole).otherwise(short)
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of shingles in both, of those in either: 1 for two empty sketches."""
    both = F.size(F.array_intersect(F.array_intersect(a, b), merged(a, b, k)))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / F.least(F.lit(k), F.size(F.array_union(a, b))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles, by how densely the k smallest hashes lie."""
    span = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too: 1 for an empty a."""
    near = resemblance(a, b, k)
    shared = near * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (1 + near)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as text: base64 of its hashes, 8 bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def merge_sketches(rows: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for all rows of each key.

    Equal hashes go first, and only each task's k smallest of a key are shuffled for ranking, so a key may hold any
    share of the rows. A key whose sketches are all empty has none; null sketches count as empty.
    """
    found = rows.select(*keys, F.explode_outer(sketch_col).alias("_hash")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_hash").asc_nulls_last()))
    least = found.withColumn("_place", place).where(F.col("_place") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch_col))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text, bucket, copy, tie) so that each row's next document, by descending doc_id, follows it in its bucket.

    Documents are dealt into ranges of doc_id. At the end of each range stands a copy of the document that follows, and
    at the end of the last one a copy of the first of all. Documents without a doc_id come last; of equal ids, those
    with the smaller hash of the text come first.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares)).first()[0] or []))
    above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(above)
    rows = rows.withColumn("bucket", bucket)
    # One row for each bucket: which document stands first in it, and which bucket comes before (before the first: the last).
    firsts = rows.groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    in_order = Window.orderBy("bucket")
    everywhere = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = firsts.select("first_id", F.coalesce(F.lag("bucket").over(in_order), F.last("bucket").over(everywhere)).alias("before"))
    copies = rows.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("first_id"))).select(
        "doc_id", "text", F.col("before").alias("bucket")
    )
    both = rows.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    return both.withColumn("tie", F.xxhash64("text"))


def fingerprint_documents(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each document's sketch, that of its edited text, and how alike they are, and it and the next document's.

    The edited text has the last third of the characters replaced by as many first ones of the next document (see
    ``with_next``; the only document follows itself). Null text counts as empty. Repeated rows come out as often as they
    come in, other columns are ignored, no documents give no rows. One shuffle moves the texts; the rest happens in the
    rows. Columns: doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, 4 * n)
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), "tie")
    keys = ["bucket", "copy", "doc_id", "tie"]
    chars = F.length("text")
    third = F.floor(chars / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - third), F.substring("next", F.lit(1), third))
    texts = (
        rows.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
        .select(*keys, F.col("text"), chars.cast("long").alias("n_chars"), edited.alias("edited"))
        .select(
            *keys, "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            word_hashes(F.col("text")).alias("words"), word_hashes(F.col("edited")).alias("edited_words"),
        )
    )
    sketches = texts.select(
        *keys, "n_chars", "edited_sha256", sketch(F.col("words"), k, width).alias("sketch"),
        F.when(F.col("copy"), F.array().cast("array<bigint>")).otherwise(sketch(F.col("edited_words"), k, width)).alias("edited_sketch"),
    )
    following = sketches.withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("copy"))
    return following.select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
