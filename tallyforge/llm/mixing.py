"""Mixing sources to target weights: a low-discrepancy schedule joined to shuffled equal-token blocks.

1. Sizes (words) are summed by source and hash bucket; sources get targets by weight, none above
   ``repeat_cap`` times its size (water-filling over the table of sources).
2. Slot t is the golden-ratio point frac(t / phi), in 40-bit integers; it falls into one source's share
   of the cumulative targets. Slots are ranked per source.
3. Each source's documents, in hash order and wrapping round, are cut into blocks of ``block_words``
   words. Block k of a source goes to the source's slot of rank k: the slots are the order of the mix.

The sequence's discrepancy leaves a source a few slots over or short of its quota: surplus slots stay
empty, missing ranks are appended behind the schedule, and a source's last block is cut at its target, so the
words taken equal the rounded target at every size. DataFrame functions only; no group is gathered in
one task (buckets and slot segments are ranked apart and offset), and nothing is broadcast by hint.

Defined results: null text, and text of white space only, counts 0 words; such documents are returned with taken = 0, no block and a
null slot, and ``mixed_documents`` leaves them out. Null source is a source of its own, sorted last. ``mix`` keeps rows with equal ids apart;
``mixed_documents`` gives them equal copies, by their words together. Ties in the hash order go by id, then size. A very long
text is cut into blocks like any other. Empty input gives no rows. Only the three named columns are read, so others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize, with_running_offset, word_count

#: 2**40 divided by the golden ratio, made odd.
GOLDEN_40 = 679541151873
CELLS_SHIFT = 30  # 2**10 cells of the unit interval


def _sources(totals: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row a source: size, weight, target, quota. Works on the aggregated table of sources only."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = totals.groupBy("skey", "source").agg(F.sum("_total").cast("long").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    everything = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything))
    fill = W.orderBy(F.col("source_size").cast("double") / F.col("weight"), "rank")
    s = s.withColumn("pos", F.row_number().over(fill))
    s = s.withColumn("room", F.col("total") - F.coalesce(F.sum(F.col("source_size") * cap).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("share", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    fits = F.col("weight").cast("double") * F.col("room") / F.col("share") <= (F.col("source_size") * cap).cast("double")
    s = s.withColumn("level", F.min(F.when(fits, F.struct("pos", "room", "share"))).over(everything))
    capped = F.col("level").isNull() | (F.col("pos") < F.col("level.pos"))
    s = s.withColumn("target", F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight").cast("double") * F.col("level.room") / F.col("level.share")))
    s = s.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    upto = F.sum("quota").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    unit = F.when(F.sum("quota").over(everything) > 0, upto / F.sum("quota").over(everything)).otherwise(F.lit(0.0))
    s = s.withColumn("hi", F.floor(unit * F.lit(float(1 << 40))).cast("long"))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("rank")), F.lit(0).cast("long")))
    return s.select("skey", "source", "rank", "weight", "source_size", "target", "quota", "lo", "hi", F.count("*").over(everything).alias("n_sources"))


def _slots(spark, n_slots: int, sources: DataFrame, block_words: int) -> DataFrame:
    """(skey, k, slot): the slot of each source's block k."""
    segment = max(4096, math.isqrt(n_slots))  # slots are ranked in segments, then segments: neither grows faster than the square root
    t = F.col("id") + 1
    low, high, half = t % (1 << 20), F.floor(t / (1 << 20)).cast("long") % (1 << 20), 1 << 20
    # t * GOLDEN_40 mod 2**40 in two limbs of 20 bits, without 64-bit overflow
    point = (low * GOLDEN_40 + ((high * GOLDEN_40) % half) * half) % (1 << 40)
    points = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.shiftright("point", CELLS_SHIFT))
    shares = sources.where("hi > lo").select("skey", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELLS_SHIFT), F.shiftright(F.col("hi") - 1, CELLS_SHIFT))).alias("cell"))
    owned = points.join(shares, "cell").where("point >= lo AND point < hi").select("skey", "slot", F.floor(F.col("slot") / segment).cast("long").alias("seg"), F.lit(1).alias("one"))
    ranked = with_running_offset(owned, "skey", "seg", ["slot"], "one", "k").select("skey", "k", "slot")
    need = sources.select("skey", "rank", "n_sources", F.ceil(F.col("quota") / block_words).cast("long").alias("blocks"))
    have = need.join(owned.groupBy("skey").count(), "skey", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    missing = have.where("count < blocks").withColumn("k", F.explode(F.sequence(F.col("count"), F.col("blocks") - 1)))
    missing = missing.select("skey", "k", (F.lit(n_slots) + (F.col("k") - F.col("count")) * F.col("n_sources") + F.col("rank") - 1).cast("long").alias("slot"))
    return materialize(ranked.unionByName(missing), "mix-slots")


def _pieces(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, block_words: int, cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their pieces (one row a piece, or one without), and the sources."""
    spark = docs.sparkSession
    # about as many buckets as rows in each: neither level of the running sums grows faster than the square root
    digits = max(1, round(math.log(max(1, docs.count()), 16) / 2))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"),
    ).withColumn("bucket", F.substring("h", 1, digits))
    base = materialize(base, "mix-sizes")  # texts are read once
    totals = materialize(base.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("_total")), "mix-buckets")
    sources = materialize(_sources(totals, tuple(weights), cap), "mix-sources")
    placed = with_running_offset(
        base.drop("source"), "skey", "bucket", ["h", "doc_id", "size"], "size", "offset",
        totals.join(sources.select("skey", "source_size", "target", "quota"), "skey"),
    )
    placed = placed.withColumn("row", F.row_number().over(W.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size")))
    cut = F.expr(f"""
        flatten(transform(sequence(0, {cap - 1}), e -> if(size > 0 and offset + e * source_size < quota,
            transform(
                sequence((offset + e * source_size) div {block_words}, (least(offset + e * source_size + size, quota) - 1) div {block_words}),
                k -> named_struct('epoch', e, 'k', k,
                    'first', greatest(k * {block_words} - offset - e * source_size, 0L),
                    'words', least(offset + e * source_size + size, quota, (k + 1) * {block_words}) - greatest(offset + e * source_size, k * {block_words}))),
            cast(array() as array<struct<epoch:int,k:bigint,first:bigint,words:bigint>>))))
    """)
    placed = placed.withColumn("piece", F.explode_outer(cut))
    # a document without a piece gets a key that no slot has, spread so that such rows do not meet in one task
    return placed.withColumn("k", F.coalesce("piece.k", -1 - F.col("row").cast("long"))), sources


def _scheduled(docs, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), block_words=512, repeat_cap=3, seed=7) -> tuple[DataFrame, int]:
    """(pieces with their slots, number of slots of the schedule)."""
    pieces, sources = _pieces(docs, id_col, text_col, source_col, weights, block_words, repeat_cap, seed)
    n_slots = math.ceil((sources.agg(F.sum("quota")).first()[0] or 0) / block_words)
    return pieces.join(_slots(docs.sparkSession, n_slots, sources, block_words), ["skey", "k"], "left"), n_slots


def schedule(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: (slot, source_key, block, epoch, doc_id, first_word, n_words), one row a piece of a block."""
    s, _ = _scheduled(docs, **options)
    return s.where("slot IS NOT NULL").select("slot", F.col("skey").alias("source_key"), F.col("k").alias("block"), "piece.epoch", "doc_id", F.col("piece.first").alias("first_word"), F.col("piece.words").alias("n_words"))


def _taken(s: DataFrame, *more) -> DataFrame:
    words = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("piece.words"))), F.lit(0)).cast("long")
    return s.groupBy("skey", "bucket", "row", "doc_id", "size", "source_size", "target").agg(words.alias("taken"), *more)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted), n_blocks, first_slot.

    Options: id_col, text_col, source_col, weights, block_words, repeat_cap, seed.
    """
    s, _ = _scheduled(docs, **options)
    return _taken(s, F.count("slot").alias("n_blocks"), F.min("slot").alias("first_slot")).select("doc_id", "size", "source_size", "target", "taken", "n_blocks", "first_slot")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (taken words over size, rounded half up), dealt and sorted by the slots of its copies."""
    id_col, cap = options.get("id_col", "doc_id"), options.get("repeat_cap", 3)
    s, n_slots = _scheduled(docs, **options)
    epochs = [f"_e{e}" for e in range(cap)]
    per_row = _taken(s, *[F.min(F.when(F.col("piece.epoch") == e, F.col("slot"))).alias(c) for e, c in enumerate(epochs)])
    per_id = per_row.groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"), *[F.min(c).alias(c) for c in epochs])
    copies = F.when(F.col("s") > 0, F.floor(F.col("t") / F.col("s") + 0.5)).otherwise(F.lit(0)).cast("int")
    slots = F.slice(F.array_sort(F.array_compact(F.array(*epochs))), F.lit(1), copies)
    chosen = per_id.select(F.col("doc_id").alias("_tallyforge_mix_id"), slots.alias("_tallyforge_slots")).where("size(_tallyforge_slots) > 0")
    joined = docs.join(chosen, F.col(id_col).eqNullSafe(F.col("_tallyforge_mix_id"))).withColumn("_tallyforge_slot", F.explode("_tallyforge_slots"))
    # slots spread evenly, so their ranges need no sampling
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.expr(f"_tallyforge_slot * {parts} div {max(1, n_slots)}"), F.lit(parts - 1)).cast("int")
    dealt = joined.withColumn("_tallyforge_part", part).repartitionById(parts, "_tallyforge_part").sortWithinPartitions("_tallyforge_slot", "_tallyforge_mix_id")
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])
