"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is put in a fixed random order and its running words are cut into
blocks of equal size. What a source owes the mix is a whole number of blocks
(the last one cut short). A binary tree over the output shards hands these
quotas down: at each node the left half gets a multivariate-hypergeometric draw
of the node's blocks, so every shard holds exactly its number of blocks and the
quotas of a source add up exactly. A shard then takes its own run of the
source's permuted blocks, which no other shard takes, and is shuffled locally.

Only DataFrame functions. A running total never needs a whole source in one
task: the random order is cut by its leading hex digits, windows run inside a
slice, and one row per (source, slice) carries the totals across. What is
gathered in one row is a count per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import SPACED_WORD, let, pack, unpack

BROADCAST_SOURCES = 10_000  # more sources are joined by shuffle
BROADCAST_SLICES = 1_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Weights repeat over the sources by code point, null last. ``share`` of all
    sizes is divided by weight; no target exceeds ``ceiling`` times its source,
    and what is above goes to the others by weight. Filling up in order of
    ceiling / weight gives the level at which that ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    at = (F.row_number().over(by_name) - 1) % len(weights) + 1
    everything = Window.partitionBy(F.lit(0))
    rows = sources.withColumns({
        "_w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at.cast("int")),
        "_cap": ceiling * F.col("source_size"),
    }).withColumns({
        "_owed": share * F.sum("source_size").over(everything),
        "_ratio": F.col("_cap") / F.col("_w"),
    })
    order = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    rows = rows.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("_level", (F.col("_owed") - F.col("_before")) / F.col("_rest"))
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    return rows.withColumn("_level", level).select(
        "source", "source_size",
        F.when(F.col("_level").isNull() | (F.col("_ratio") < F.col("_level")), F.col("_cap"))
        .otherwise(F.col("_w") * F.col("_level")).alias("target"),
    )


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Inverse-CDF draw: how many of ``drawn`` out of ``total`` are among ``marked``.

    Weights are worked out relative to the mode by their exact ratios, over
    twelve standard deviations to either side; mass beyond is below 1e-30.
    """

    def ratio(p, k):  # weight(k + 1) / weight(k)
        k = k.cast("double")
        return (p["m"] - k) * (p["d"] - k) / ((k + 1) * (p["n"] - p["m"] - p["d"] + k + 1))

    def walk(p, ks, first, step):
        """Total weight along ``ks`` and, given v, the first k at which the sum passes v."""
        start = F.struct(first.alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(ks, start, lambda s, k: F.struct(
            step(s["w"], k).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])

    def find(p, ks, first, step, v, last):
        start = F.struct(first.alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("x"))
        return F.coalesce(F.aggregate(ks, start, lambda s, k: F.struct(
            step(s["w"], k).alias("w"), (s["sum"] + s["w"]).alias("sum"),
            F.coalesce(s["x"], F.when(s["sum"] + s["w"] > v, k)).alias("x")), lambda s: s["x"]), last)

    none = F.array().cast("array<bigint>")

    def solve(p):
        ups = F.sequence(p["mode"], p["b"])
        downs = F.when(p["mode"] > p["a"], F.sequence(p["mode"] - 1, p["a"], F.lit(-1).cast("bigint"))).otherwise(none)

        def up(w, k):
            return w * ratio(p, k)

        def down(w, k):  # weight(k - 1) from weight(k); at k = a the next one is never used
            return F.when(k > p["a"], w / ratio(p, k - 1)).otherwise(F.lit(0.0))

        below = F.when(p["mode"] > p["a"], 1 / ratio(p, p["mode"] - 1)).otherwise(F.lit(0.0))
        return let(F.struct(
            walk(p, ups, F.lit(1.0), up).alias("above"), walk(p, downs, below, down).alias("under"),
        ), lambda m: let(u * (m["above"] + m["under"]), lambda v: F.when(
            v < m["above"], find(p, ups, F.lit(1.0), up, v, p["b"])
        ).otherwise(find(p, downs, below, down, v - m["above"], p["a"]))))

    def bounds(q):
        low = F.greatest(F.lit(0).cast("bigint"), q["drawn"] - (q["total"] - q["marked"]))
        high = F.least(q["drawn"], q["marked"])
        n = q["total"].cast("double")
        part = q["marked"] / F.greatest(n, F.lit(1.0))
        mode = F.floor((q["drawn"] + 1.0) * (q["marked"] + 1.0) / (n + 2.0))
        wide = (F.ceil(12 * F.sqrt(q["drawn"] * part * (1 - part))) + 12).cast("bigint")
        return let(F.least(high, F.greatest(low, mode)), lambda top: F.struct(
            n.alias("n"), q["marked"].cast("double").alias("m"), q["drawn"].cast("double").alias("d"), top.alias("mode"),
            F.greatest(low, top - wide).alias("a"), F.least(high, top + wide).alias("b")))

    asked = F.struct(total.cast("bigint").alias("total"), marked.cast("bigint").alias("marked"), drawn.cast("bigint").alias("drawn"))
    return let(let(asked, bounds), solve)


def split_quotas(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, from_block, to_block) from (source, blocks): exact and disjoint.

    One row per tree node with a count per source; log2(shards) levels.
    """
    rows = counts.select(F.struct(F.col("source").isNull().alias("last"), "source", "blocks").alias("s"))
    node = rows.agg(F.sort_array(F.collect_list("s")).alias("s")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"),
        F.col("s.source").alias("names"), F.col("s.blocks").alias("left_over"),
        F.aggregate("s", F.lit(0).cast("bigint"), lambda t, x: t + x["blocks"]).alias("all_blocks"),
    )
    long0 = F.lit(0).cast("bigint")
    nothing = F.array().cast("array<bigint>")
    for _ in range(max(0, (shards - 1).bit_length())):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        ends = F.col("hi") - F.col("lo") <= 1

        def share_of(to, frm):  # blocks that shards frm <= j < to hold
            return F.floor(to * F.col("all_blocks") / shards) - F.floor(frm * F.col("all_blocks") / shards)

        start = F.struct(
            F.aggregate("left_over", long0, lambda t, x: t + x).alias("rest"), share_of(mid, F.col("lo")).alias("need"), nothing.alias("out"))

        def step(s, x):
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), F.size(s["out"])), 11)).cast("double") / float(1 << 53)
            return let(hypergeometric(s["rest"], x, s["need"], u), lambda got: F.struct(
                (s["rest"] - x).alias("rest"), (s["need"] - got).alias("need"), F.concat(s["out"], F.array(got)).alias("out")))

        drawn = F.aggregate("left_over", start, step, lambda s: s["out"])
        node = node.withColumn("_left", F.when(~ends, drawn)).select("names", "all_blocks", F.explode(
            F.when(ends, F.array(F.struct("lo", "hi", F.col("left_over").alias("left_over")))).otherwise(F.array(
                F.struct(F.col("lo").alias("lo"), mid.alias("hi"), F.col("_left").alias("left_over")),
                F.struct(mid.alias("lo"), F.col("hi").alias("hi"), F.zip_with(
                    "left_over", "_left", lambda a, b: a - b).alias("left_over")),
            ))).alias("n")).select("names", "all_blocks", "n.lo", "n.hi", "n.left_over")
    cells = node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("names", "left_over")).alias("c")).select(
        F.col("c.names").alias("source"), "shard", F.col("c.left_over").alias("blocks"))
    upto = Window.partitionBy("source").orderBy("shard")
    return cells.withColumn("to_block", F.sum("blocks").over(upto)).select(
        "source", "shard", (F.col("to_block") - F.col("blocks")).alias("from_block"), "to_block")


def mix(
    docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0,
    shards: int = 8, blocks_per_shard: int = 1024, slice_digits: int = 3, seed: int = 17, carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, draws, and the columns in ``carry``.

    ``draws`` lists what the mix takes: (shard, epoch, from_word, words,
    place); ``place`` orders a shard's pieces at random. A source's draws add up
    to floor(target); a document is drawn at most once per epoch, and a piece
    that a block or shard boundary cuts shows up in both shards. The random
    order is md5 of doc_id, so reruns agree. ``slice_digits`` hex digits cut a
    source into slices; raise it by one for each 16 times as many rows.

    Nulls: null text has size 0 and draws nothing; null source is a source of
    its own, last; null doc_id sorts as the text 'null'. Whole repeated rows
    count each. Very long texts are only counted. Equal hashes are told apart by
    doc_id and size. Columns in
    ``carry`` with a name of this operator's own are left out; no other column is
    read. Empty input gives no rows.
    """
    names = [c for c in dict.fromkeys(carry) if c not in ("doc_id", "source", "size", "source_size", "target", "draws")]
    narrow = stage(docs.select(
        F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_key"), *pack(names),
    ), "mix-sizes")
    per_slice = narrow.groupBy("source", F.substring("_key", 1, slice_digits).alias("_slice")).agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = stage(per_slice.withColumn("_offset", F.coalesce(F.sum("_words").over(earlier), F.lit(0))), "mix-slices")
    goal = stage(targets(per_slice.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, ceiling), "mix-targets")
    owed = F.floor("target").cast("bigint")
    block = let(F.sum(owed).over(Window.partitionBy(F.lit(0))), lambda t: F.greatest(
        F.lit(1).cast("bigint"), F.ceil(t / (shards * blocks_per_shard)).cast("bigint")))
    goal = goal.withColumn("_owed", owed).withColumn("_block", block)
    goal = goal.withColumn("blocks", F.ceil(F.col("_owed") / F.col("_block")).cast("bigint"))
    quotas = split_quotas(goal, shards, seed).groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("shard", "from_block", "to_block"))).alias("_runs"))
    plan = stage(goal.join(quotas, goal.source.eqNullSafe(quotas.source)).drop(quotas.source), "mix-plan")
    few = plan.count() <= BROADCAST_SOURCES
    plan = F.broadcast(plan) if few else plan
    inside = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size")
    rows = narrow.withColumn("_slice", F.substring("_key", 1, slice_digits)).withColumn(
        "_local", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    offsets = per_slice.select(F.col("source").alias("_s"), F.col("_slice").alias("_p"), "_offset")
    if offsets.count() <= BROADCAST_SLICES:
        offsets = F.broadcast(offsets)
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_p")))
    rows = rows.join(plan.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t")))
    begin = F.col("_offset") + F.col("_local")
    epochs = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.ceil(F.lit(ceiling)).cast("bigint") - 1))

    def pieces(e):
        return let(F.struct(
            (e * F.col("source_size") + begin).alias("a"),
            F.least(e * F.col("source_size") + begin + F.col("size"), F.col("_owed")).alias("b"),
        ), lambda x: F.filter(F.transform("_runs", lambda r: let(F.struct(
            F.greatest(x["a"], r["from_block"] * F.col("_block")).alias("a"),
            F.least(x["b"], r["to_block"] * F.col("_block")).alias("b"),
        ), lambda y: F.struct(
            r["shard"].alias("shard"), e.alias("epoch"), (y["a"] - x["a"]).alias("from_word"), (y["b"] - y["a"]).alias("words"),
            F.xxhash64(F.lit(seed), F.col("_key"), e, y["a"]).alias("place"),
        ))), lambda d: d["words"] > 0))

    return rows.select(
        "doc_id", "source", "size", "source_size", "target", F.flatten(F.transform(epochs, pieces)).alias("draws"), *unpack(names))


def taken(mixed: DataFrame) -> DataFrame:
    """Adds ``taken``: the words drawn from each document, repeats counted."""
    return mixed.withColumn("taken", F.aggregate("draws", F.lit(0).cast("bigint"), lambda t, d: t + d["words"]))


def copies(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, to the nearest whole, same columns as ``docs``."""
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    mixed = taken(mix(whole, carry=["_row"], **settings))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(0), times))).select("_row.*")


def write_shards(mixed: DataFrame, path: str) -> None:
    """Writes the draws, a folder per shard, each shuffled by its own random order."""
    draws = mixed.select("doc_id", "source", F.explode("draws").alias("d")).select("doc_id", "source", "d.*")
    draws.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
