"""Mixing sources to target token counts by entropy balancing, with DataFrame operations only.

Of all document rates r, the mix takes those nearest to the base rates in divergence, the sum over documents of
r * log(r / base) - r, under one token constraint a source: sizes times r sum to the source's target, r at most ``most``.
The solution tilts every document exponentially, r = base * exp(multiplier * size), cut at ``most``; the convex dual has one
multiplier a source and is solved by Newton's method, kept within a bracket. Every iteration is one aggregation over the
(source, base, size) cells that the documents were counted into beforehand.

Rates become whole copies by words: along a source's cells from the largest documents to the smallest, each cell
takes the number of copies that comes nearest to the words wanted up to it, as long as the smaller documents left can make up for
what it misses; a source misses its target by half its smallest document, or by what its few documents do not allow. Within a
cell, whose documents are of one size and rate, copies differ by one at most. The running sum has one step a distinct size.

Defined results: a null text has size 0; documents of size 0 take no words and are taken as often as their base rate,
rounded; a null source is a source of its own, last in order; very long texts are counted whole; of documents of one size the
first by id take the odd copies (a null id first, then by the whole row's hash, beyond ``rows_a_bucket`` of one size by the
hash first); repeated rows are separate documents; an empty table gives an empty mix; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source (mx_source, mx_size) with its place, weight and target; what a cap cuts off is shared again by weight."""
    one = Window.orderBy("mx_source")  # one row a source
    named = sizes.withColumn("mx_place", F.row_number().over(one) - 1)
    named = named.withColumn("mx_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("mx_place") % len(weights) + 1).cast("int")))
    named = named.withColumn("mx_cap", F.col("mx_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("mx_cap") / F.col("mx_weight"), "mx_place")
    whole = Window.partitionBy(F.lit(1))
    level = named.withColumn("mx_before", F.coalesce(F.sum("mx_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    level = level.withColumn("mx_rest", F.sum("mx_weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    level = level.withColumn("mx_all", F.sum("mx_size").over(whole) * F.lit(float(share)))
    level = level.withColumn("mx_level", (F.col("mx_all") - F.col("mx_before")) / F.col("mx_rest"))
    level = level.withColumn("mx_level", F.max(F.when(F.col("mx_cap") > F.col("mx_level") * F.col("mx_weight"), F.col("mx_level"))).over(whole))
    target = F.when(F.col("mx_level").isNull(), F.col("mx_cap")).otherwise(F.least("mx_cap", F.col("mx_weight") * F.col("mx_level")))
    return level.select("mx_source", "mx_place", "mx_size", target.alias("mx_target"))


def balance(cells: DataFrame, goals: DataFrame, most: float = 2.0, tolerance: float = 1e-12, iterations: int = 80) -> DataFrame:
    """Newton on the dual. cells: mx_place, mx_base, mx_size (above 0), mx_n; goals: mx_place, mx_target. Returns mx_place,
    mx_scale (mean size) and mx_lambda a goal that has cells: rates are mx_base * exp(mx_lambda * mx_size / mx_scale)."""
    scale = F.sum(F.col("mx_size") * F.col("mx_n")) / F.sum("mx_n")
    about = cells.groupBy("mx_place").agg(scale.alias("mx_scale"), F.min("mx_size").alias("mx_least"), F.min("mx_base").alias("mx_low"), F.max("mx_base").alias("mx_high"))
    x = F.col("mx_least") / F.col("mx_scale")
    ends = [(-(F.log("mx_high") + 50) / x).alias("mx_from"), ((F.log(F.lit(float(most)) / F.col("mx_low")) + 1) / x).alias("mx_to")]
    state = staged(goals.join(about, "mx_place").select("mx_place", "mx_target", "mx_scale", *ends, F.lit(0.0).alias("mx_lambda")), "mix-dual")
    for _ in range(iterations):
        tilt = F.col("mx_size") / F.col("mx_scale")
        raw = F.col("mx_base") * F.exp(F.least(F.lit(700.0), F.col("mx_lambda") * tilt))
        words = F.col("mx_n") * F.col("mx_size")
        step = cells.join(F.broadcast(state), "mx_place").groupBy("mx_place", "mx_target", "mx_scale", "mx_from", "mx_to", "mx_lambda").agg(  # one row a source
            F.sum(words * F.least(raw, F.lit(float(most)))).alias("mx_now"), F.sum(F.when(raw < most, words * tilt * raw).otherwise(0.0)).alias("mx_slope"),
        )
        step = step.withColumn("mx_gap", F.col("mx_target") - F.col("mx_now")).withColumn("mx_there", F.abs("mx_gap") <= tolerance * F.greatest("mx_target", F.lit(1.0)))
        step = step.withColumns({"mx_from": F.when(F.col("mx_gap") > 0, F.col("mx_lambda")).otherwise(F.col("mx_from")), "mx_to": F.when(F.col("mx_gap") > 0, F.col("mx_to")).otherwise(F.col("mx_lambda"))})
        newton = F.col("mx_lambda") + F.col("mx_gap") / F.nullif("mx_slope", F.lit(0.0))
        moved = F.when(F.col("mx_there"), F.col("mx_lambda")).when((newton > F.col("mx_from")) & (newton < F.col("mx_to")), newton).otherwise((F.col("mx_from") + F.col("mx_to")) / 2)
        step = staged(step.select("mx_place", "mx_target", "mx_scale", "mx_from", "mx_to", moved.alias("mx_lambda"), "mx_there"), "mix-dual")
        open_ = step.where(~F.col("mx_there")).limit(1).count()
        drop_staged(state)
        state = step.drop("mx_there")
        if not open_:
            break
    return state.select("mx_place", "mx_scale", "mx_lambda")


def whole_copies(cells: DataFrame, most: float, chunk: int = 256) -> DataFrame:
    """cells (mx_place, mx_base, mx_size, mx_n, mx_rate) with mx_all, the copies of each: a running sum from the largest
    size down, in chunks, so that the arrays it builds up stay short."""
    listed = cells.groupBy("mx_place").agg(F.sort_array(F.collect_list(F.struct("mx_size", "mx_base", "mx_n", "mx_rate")), asc=False).alias("cs"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("cs") - 1) / chunk).cast("int")), lambda i: F.slice("cs", i * chunk + 1, F.lit(chunk)))

    # State: words owed so far; words wanted and words there are (times most) in the cells still to come.
    def take(a: Column, c: Column) -> Column:
        wanted, there = c["mx_n"] * c["mx_rate"] * c["mx_size"], c["mx_n"] * c["mx_size"] * F.lit(float(int(most)))
        want, later, room = a["owed"] + wanted, a["later"] - wanted, a["room"] - there
        near = F.floor(want / c["mx_size"] + 0.5)
        # Not so few that the rest cannot make up for it, nor so many; where neither can be, the nearest.
        least, top = F.ceil((want + later - room) / c["mx_size"] - 1e-6), F.floor((want + later) / c["mx_size"] + 1e-6)
        k = F.when(least <= top, F.greatest(least, F.least(near, top))).otherwise(near)
        k = F.greatest(F.lit(0).cast("long"), F.least(k, c["mx_n"] * F.lit(int(most))))
        return F.struct((want - k * c["mx_size"]).alias("owed"), later.alias("later"), room.alias("room"), F.concat(a["ks"], F.array(k)).alias("ks"))

    def take_chunk(a: Column, cs: Column) -> Column:
        begin = F.struct(*[a[f].alias(f) for f in ("owed", "later", "room")], F.array().cast("array<bigint>").alias("ks"))
        return F.aggregate(cs, begin, take, lambda s: F.struct(*[s[f].alias(f) for f in ("owed", "later", "room")], F.concat(a["kss"], F.array(s["ks"])).alias("kss")))

    words = lambda by: F.aggregate("cs", F.lit(0.0), lambda a, c: a + c["mx_n"] * by(c) * c["mx_size"])
    listed = listed.withColumns({"later": words(lambda c: c["mx_rate"]), "room": words(lambda c: F.lit(float(int(most))))})
    start = F.struct(F.lit(0.0).alias("owed"), F.col("later"), F.col("room"), F.array().cast("array<array<bigint>>").alias("kss"))
    taken = F.flatten(F.aggregate(chunks, start, take_chunk, lambda s: s["kss"]))
    rows = listed.select("mx_place", F.explode(F.arrays_zip("cs", taken.alias("ks"))).alias("c"))
    return rows.select("mx_place", "c.cs.mx_size", "c.cs.mx_base", "c.cs.mx_n", F.col("c.ks").alias("mx_all"))


def mix(docs: DataFrame, size: Column, source: str = "source", doc_id: str = "doc_id", base: Column | None = None, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, rows_a_bucket: int = 50_000) -> DataFrame:
    """The documents' rows (mx_row) with mx_size, mx_source_size, mx_target and mx_copies (0 to most). Sources are
    compared as "a" and their name, a null source as "b", which puts it last."""
    own = docs.select(
        F.struct("*").alias("mx_row"), F.coalesce(F.concat(F.lit("a"), F.col(source).cast("string")), F.lit("b")).alias("mx_source"), size.cast("long").alias("mx_size"),
        (F.lit(1.0) if base is None else base.cast("double")).alias("mx_base"), F.col(doc_id).alias("mx_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("mx_hash"),
    )
    keys = ["mx_source", "mx_base", "mx_size"]
    cells = staged(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("mx_n")), "mix-cells")
    goals = targets(cells.groupBy("mx_source").agg(F.sum(F.col("mx_size") * F.col("mx_n")).alias("mx_size")), weights, share, most).withColumnRenamed("mx_size", "mx_source_size")
    goals = staged(goals, "mix-goals")
    placed = staged(cells.join(goals.select("mx_source", "mx_place"), "mx_source"), "mix-placed")
    some = placed.where("mx_size > 0").select("mx_place", "mx_base", "mx_size", "mx_n")
    dual = balance(some, goals.select("mx_place", "mx_target"), most)
    rate = F.round(F.least(F.lit(float(most)), F.col("mx_base") * F.exp(F.least(F.lit(700.0), F.col("mx_lambda") * (F.col("mx_size") / F.col("mx_scale"))))), 9)
    copies = whole_copies(some.join(dual, "mx_place").select("mx_place", "mx_base", "mx_size", "mx_n", rate.alias("mx_rate")), most)
    none = F.least(F.floor(F.col("mx_base") + 0.5), F.lit(int(most))) * F.col("mx_n")
    copies = copies.unionByName(placed.where("mx_size = 0").select("mx_place", "mx_size", "mx_base", "mx_n", none.alias("mx_all")))
    copies = staged(copies.join(goals, "mx_place").select(*keys, "mx_n", "mx_all", "mx_source_size", "mx_target", F.ceil(F.col("mx_n") / rows_a_bucket).alias("mx_buckets")), "mix-copies")
    # Places within a cell: by id, beyond rows_a_bucket documents by bucket of the hash first, and rows too many for one
    # bucket (they are equal, or nearly) by their number in the scan.
    dealt = own.join(copies, keys).withColumn("mx_bucket", F.pmod("mx_hash", "mx_buckets"))
    large = dealt.where("mx_buckets > 1").groupBy(*keys, "mx_bucket").agg(F.count(F.lit(1)).alias("mx_in"))
    large = staged(large.withColumn("mx_parts", F.ceil(F.col("mx_in") / (2 * rows_a_bucket))), "mix-large")
    dealt = dealt.join(large.drop("mx_in"), [*keys, "mx_bucket"], "left").withColumn("mx_part", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), "mx_parts"), F.lit(0)))
    dealt = dealt.withColumn("mx_at", F.row_number().over(Window.partitionBy(*keys, "mx_bucket", "mx_part").orderBy(F.col("mx_id").asc_nulls_first(), "mx_hash")))
    if large.limit(1).count():
        dealt = staged(dealt.drop("mx_parts"), "mix-dealt")
        ends = dealt.where("mx_buckets > 1").groupBy(*keys, "mx_bucket", "mx_part").agg(F.count(F.lit(1)).alias("mx_in"))
        before = Window.partitionBy(*keys).orderBy("mx_bucket", "mx_part").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("mx_before", F.coalesce(F.sum("mx_in").over(before), F.lit(0))).drop("mx_in")
        dealt = dealt.join(ends, [*keys, "mx_bucket", "mx_part"], "left").withColumn("mx_at", F.col("mx_at") + F.coalesce("mx_before", F.lit(0)))
    each, odd = F.floor(F.col("mx_all") / F.col("mx_n")), F.col("mx_all") % F.col("mx_n")
    return dealt.select("mx_row", "mx_size", "mx_source_size", "mx_target", (each + F.when(F.col("mx_at") <= odd, 1).otherwise(0)).cast("long").alias("mx_copies"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    taken = mix(docs, word_count(), **settings)
    copies = taken.withColumn("mx_copy", F.explode(F.when(F.col("mx_copies") > 0, F.sequence(F.lit(1), F.col("mx_copies").cast("int"))).otherwise(F.array().cast("array<int>"))))
    return copies.select(*[F.col("mx_row").getField(c).alias(c) for c in docs.columns])
