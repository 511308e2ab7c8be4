"""Bottom-k sketches of word shingles, with DataFrame expressions only.

A text's words are its lower-cased runs between white space; its shingles are five words in a row, or the whole text
where it has fewer. The sketch holds the k smallest distinct 64-bit hashes of the shingles in ascending order, so it
depends on the set of shingles alone: equal texts have equal sketches, and the sketch of a union is the k smallest of
both sketches, whatever the parts. Two sketches give resemblance, containment and the distinct count; where both hold
all hashes of their texts the figures are exact.

Defined results: a null text is empty; an empty text (or only white space) has an empty sketch, two of them resemble by
1, one and another by 0; a repeated document has its copies' sketch; documents of the same id follow each other by text;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

WHITE = " \t\n\r\x0b\x0c"
WORDS = 5
K = 128


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, words: int = WORDS) -> DataFrame:
    """df with the sketch of a text column. The steps stand in projections of their own, so that none is evaluated twice."""
    w, h = f"{name}__w", f"{name}__h"
    clean = F.btrim(F.lower(F.col(text)), F.lit(WHITE))
    df = df.withColumn(w, F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[ \t\n\r\x0b\x0c]+")))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    rolled = F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + j) for j in range(1, words)])), 1, F.greatest(F.size(h) - (words - 1), F.lit(1)))
    short = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.concat_ws(" ", F.col(w)))))
    df = df.withColumn(name, F.slice(F.sort_array(F.array_distinct(F.when(F.size(h) < words, short).otherwise(rolled))), 1, k))
    return df.drop(w, h)


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of both texts' shingles; whole, beyond k, where both sketches are whole."""
    both = F.sort_array(F.array_distinct(F.concat(a, b)))
    return F.when((F.size(a) < k) & (F.size(b) < k), both).otherwise(F.slice(both, 1, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = union_sketch(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / F.greatest(F.size(union), F.lit(1)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the range of hashes."""
    place = (F.element_at(a, -1).cast("double") + F.lit(float(2**63))) / F.lit(float(2**64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has."""
    union = union_sketch(a, b, k)
    count = F.when((F.size(a) < k) & (F.size(b) < k), F.size(union).cast("double")).otherwise(distinct_count(union, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * count / distinct_count(a, k)))


def as_string(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")))


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch a key of many parts. Each task keeps k hashes a key before the shuffle, so a hot key moves k rows a task."""
    hashes = df.select(*keys, F.explode(sketch).alias("sk_hash")).groupBy(*keys, "sk_hash").agg(F.lit(1).alias("sk_one"))
    least = hashes.withColumn("sk_n", F.row_number().over(Window.partitionBy(*keys).orderBy("sk_hash"))).where(F.col("sk_n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("sk_hash")).alias(sketch))


def with_next(docs: DataFrame, key: str, text: str, bucket_bytes: int = 4 << 20, most_buckets: int = 100_000, coarse: int = 384, sample: int = 16_384) -> tuple[DataFrame, Window]:
    """Deal docs (key bigint, without nulls; text) out to buckets that follow the order of key, then of the text's hash, then
    of rows; each bucket holds as a guest the first row of the next one that has any (the last one: of the first). Returns
    the rows, repartitioned by bucket, and the window in which lead() reaches the next document.

    ``coarse`` marks from a sample of about ``sample`` rows, drawn by size, cut the order into ranges of like bytes, each of which is cut evenly
    between its ends: by key, or by hash where both ends have one key, or by row where they are equal rows, so that no
    key and no group of equal rows makes a bucket of its own. Next documents of equal rows are equal, whichever stands first.
    """
    own = docs.withColumn("bk_h", F.xxhash64(text)).withColumn("bk_u", F.xxhash64(F.monotonically_increasing_id()))
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    order = Window.partitionBy("bucket").orderBy("guest", key, "bk_h", "bk_u")
    if not n:
        return own.withColumns({"bucket": F.lit(0), "guest": F.lit(False)}), order
    weight = F.octet_length(text) + F.lit(64)
    unit = max(1.0, (size + 64 * n) / sample)  # a row of so many bytes is drawn for certain
    chosen = F.pmod(F.xxhash64("bk_u", F.lit(1)), F.lit(1 << 30)) < (F.least(F.lit(1.0), weight / unit) * (1 << 30)).cast("long")
    drawn = own.where(chosen).select(key, "bk_h", "bk_u", F.greatest(weight.cast("double"), F.lit(unit)).alias("w")).collect()  # about sample rows of four numbers
    seen = sorted(((r[0], r[1], r[2]), r[3]) for r in drawn)
    marks, before, step = [], 0.0, sum(w for _, w in seen) / coarse
    for mark, w in seen:
        if before >= step * (len(marks) + 1):
            marks.append(mark)
        before += w
    buckets = int(min(most_buckets, max(1, size // bucket_bytes)))
    fine = max(1, -(-buckets // (len(marks) + 1)))
    least, most = -(2**63), 2**63 - 1
    ends = [(least, least, least), *marks, (most, most, most)]
    low, high = ([F.array(*[F.lit(e[j]).cast("long") for e in xs]) for j in range(3)] for xs in (ends[:-1], ends[1:]))
    mark_list = F.array(*[F.struct(*[F.lit(v).cast("long") for v in m]) for m in marks]) if marks else None
    part = F.size(F.filter(mark_list, lambda m: m <= F.struct(F.col(key), F.col("bk_h"), F.col("bk_u")))) if marks else F.lit(0)
    dealt = own.withColumn("bk_part", part)
    of = lambda xs, j: F.get(xs[j], F.col("bk_part")).cast("double")
    span = lambda c, j: (F.col(c).cast("double") - of(low, j)) / (of(high, j) - of(low, j))
    # Between equal ends of a key the hash decides, between equal hashes the row; 0 at the low end of a mixed range.
    share = F.when(of(high, 0) > of(low, 0), span(key, 0)).when(of(high, 1) > of(low, 1), span("bk_h", 1)).when(of(high, 2) > of(low, 2), span("bk_u", 2)).otherwise(0.0)
    sub = F.greatest(F.lit(0), F.least(F.floor(share * fine), F.lit(fine - 1)))
    dealt = dealt.withColumn("bucket", (F.col("bk_part") * fine + sub).cast("long")).drop("bk_part")
    first = dealt.groupBy("bucket").agg(F.min(F.struct(key, "bk_h", "bk_u")).alias("first"))  # at most most_buckets + coarse rows
    whole = Window.orderBy("bucket")
    follow = first.select(F.col("bucket").alias("guest_of"), F.coalesce(F.lead("first").over(whole), F.first("first").over(whole)).alias("g"))
    follow = follow.select("guest_of", *[F.col("g").getField(c).alias(f"g_{c}") for c in (key, "bk_h", "bk_u")])
    guests = own.join(F.broadcast(follow), [own[c] == follow[f"g_{c}"] for c in (key, "bk_h", "bk_u")]).select(*own.columns, F.col("guest_of").alias("bucket"), F.lit(True).alias("guest"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (16 << 20))
    rows = dealt.withColumn("guest", F.lit(False)).unionByName(guests).repartition(int(tasks), "bucket")
    return rows, order


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Sketches of every text and of its edited form, whose last half comes from the next document."""
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("key"), text_or_empty(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    rows, order = with_next(own, "key", "text")
    rows = with_sketch(rows, "text", "sketch", k)
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).where(~F.col("guest"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", "next_sketch", "edited")
    rows = with_sketch(rows, "edited", "edited_sketch", k)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("distinct_shingles"), containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
    )
