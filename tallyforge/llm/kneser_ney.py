"""Quality classifier: an interpolated modified Kneser-Ney model over words, trained on trusted text.

Words are split at ASCII white space, freed of outer punctuation and lower-cased unless all in capitals; digits become 0. A text is read as
order-1 start marks, its words, and an end mark. All counts cover all trusted texts: tasks sum their own n-grams, and the
tables of each order (counts, continuation counts, context totals) are sharded by key and joined; they grow with the text.

For seen n-grams p = alpha + gamma(context) p(suffix), for others p = gamma(context) p(suffix). So a text's log
probability is a sum over all of its n-grams of all orders, each giving one value of its own:

    value(g) = log p(g) - log gamma(context of g) - log p(suffix of g)   (0 where g is not seen)
             + log gamma(g)                                              (0 where g is no context)

Documents are scored by one join: each task turns a block of documents into (n-gram, its documents in the block), which
meets the sharded values; their sums per document follow. Values are whole millionths, so sums do not hang on their order.
N-grams with at least 1/``hot_parts`` of all tokens (at most ``hot_parts`` of each order by their share) are added where
the text is read; none of them is shuffled.

Perplexity is exp of the mean negative log probability per word, the end mark included. One tenth of the trusted documents
(by hash of id) stays out of training and sets the limit of its language: a quantile times a margin. Languages without any
take that of all; where all trusted documents would be left out, all train and calibrate.

Defined results: null or blank text has no perplexity and is not kept. Null language is a group of its own. Without
trusted text every non-blank document is kept (no model). Every row gives one row, repeated rows and ids too, and equal rows equal scores; an
id that is trusted makes all its rows trusted. A document whose perplexity equals the limit is kept. Texts are read whole, however long: a text is
never cut into blocks. An empty table gives no rows. Only the three named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import WORD, materialize, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER, HOT_PARTS = 2, 20_000
#: Ids of the start and end marks; a word's id is XXH3 of its folded form.
START, END = 0, 1
#: More trusted ids than this are joined by sort-merge instead of a broadcast.
MOST_IDS = 2_000_000
BLOCK_WORDS, BLOCK_DOCS = 3_000_000, 32_000
UNIT = 1e6


# --- words and n-grams
def fold(words: pa.Array) -> pa.Array:
    """Folded forms of distinct words: two and more letters in capitals only stay as they are, as does pure punctuation."""
    bare = pc.ascii_trim(words, characters=".,;:!?\"'()")
    bare = pc.if_else(pc.equal(bare, ""), words, bare)
    shouted = pc.and_(pc.utf8_is_upper(bare), pc.greater(pc.utf8_length(bare), 1))
    return pc.replace_substring_regex(pc.if_else(shouted, bare, pc.utf8_lower(bare)), "[0-9]", "0")


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of words of each text)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    there = pc.not_equal(pc.binary_length(flat), 0)
    coded = flat.filter(there).dictionary_encode()
    ids = np.array([xxhash.xxh3_64_intdigest(w) for w in fold(coded.dictionary).cast(pa.large_binary()).to_pylist()], np.uint64).view(np.int64)
    n = np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return (ids[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)), n


def marked(ids: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, text of each place, whether the place is a start mark) of all texts with words."""
    at = np.flatnonzero(n)
    size = n[at] + order
    begin = np.cumsum(size) - size
    seq = np.full(int(size.sum()), END, np.int64)
    starts = (begin[:, None] + np.arange(order - 1)).ravel()
    seq[starts] = START
    is_start = np.zeros(len(seq), bool)
    is_start[starts] = True
    inner = ~is_start
    inner[begin + size - 1] = False
    seq[inner] = ids
    return seq, np.repeat(at, size), is_start


def key_of(words: list[np.ndarray]) -> np.ndarray:
    """Spark's xxhash64 of long columns, so that both sides of the join agree."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.full(len(words[0]), 42, np.uint64)
    for w in words:
        h = h + p5 + np.uint64(8)
        h = rot(h ^ (rot(w.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def pieces_of(batches, most_words: int, most_docs: int):
    """Batches cut and joined to blocks of about ``most_words`` words; a text is never cut."""
    held, size, rows = [], 0, 0
    for b in batches:
        spaces = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 6 + 1)
        at = 0
        while at < len(b):
            done = spaces[at - 1] if at else 0
            end = min(len(b), at + most_docs - rows, max(at + 1, int(np.searchsorted(spaces, done + most_words - size, "right"))))
            held.append(b.slice(at, end - at))
            size, rows, at = size + int(spaces[end - 1] - done), rows + end - at, end
            if size >= most_words or rows >= most_docs or at < len(b):
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, i: int) -> pa.Array:
    c = table.column(i)
    return c.chunk(0) if c.num_chunks else pa.array([], c.type)


def names(n: int, first: int = 1) -> list[str]:
    return [f"w{i}" for i in range(first, n + 1)]


# --- training
def count_grams(docs: DataFrame, text_col="text", order=ORDER) -> DataFrame:
    """(w1 .. wn, c) over all rows; each task sums its own blocks before the shuffle."""
    cols = names(order)

    def run(batches):
        for block in pieces_of(batches, BLOCK_WORDS, 1 << 30):
            seq, _, start = marked(*word_ids(column(block, 0)), order)
            last = np.flatnonzero(~start)
            grams = [seq[last - order + 1 + i] for i in range(order)]
            by = np.lexsort(grams[::-1])
            grams = [g[by] for g in grams]
            new = np.ones(len(by), bool)
            if len(by):
                new[1:] = np.any([g[1:] != g[:-1] for g in grams], axis=0)
            at = np.flatnonzero(new)
            c = np.diff(np.append(at, len(by)))
            for i in range(0, len(at), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(g[at[part]]) for g in grams] + [pa.array(c[part].astype(np.int64))], cols + ["c"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, ", ".join(f"{w} bigint" for w in cols) + ", c bigint")
    return found.groupBy(*cols).agg(F.sum("c").alias("c"))


def join_split(left: DataFrame, right: DataFrame, on: list[str], weight: str, limit: float) -> DataFrame:
    """Inner join. Rows of ``right`` with a ``weight`` of at least ``limit`` are few by that very share and are broadcast, so that
    their many partners on the left need no shuffle; all others meet by sort-merge."""
    hot = F.broadcast(right.where(F.col(weight) >= limit))
    cold = left.join(F.broadcast(right.where(F.col(weight) >= limit).select(*on)), on, "left_anti")
    return left.join(hot, on).unionByName(cold.join(right.where(F.col(weight) < limit).hint("merge"), on))


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of counts 1, 2 and more, from how many n-grams have counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return [max(0.0, min(i, i - (i + 1) * y * b / a)) if a and b else 0.5 for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]


def discounts(level: DataFrame) -> list[float]:
    met = {r["c"]: r["k"] for r in level.where("c <= 4").groupBy("c").agg(F.count("*").alias("k")).collect()}
    return discounts_of(*(met.get(i, 0) for i in (1, 2, 3, 4)))


def estimate(counts: DataFrame, order=ORDER, hot_parts=HOT_PARTS) -> tuple[DataFrame, float]:
    """((key, v, hot) of all n-grams seen or met as a context, materialized; log p of an unseen word)."""
    levels, scratch = {order: counts}, []

    def keep(df: DataFrame, label: str) -> DataFrame:
        scratch.append(materialize(df, label))
        return scratch[-1]

    tokens = int(counts.agg(F.sum("c")).first()[0])
    limit, lower, found = tokens / hot_parts, None, []
    for n in range(order - 1, 0, -1):
        raw = "c" if n + 1 == order else "raw"
        below = levels[n + 1].groupBy(*names(n + 1, 2)).agg(F.count("*").alias("c"), F.sum(raw).alias("raw"))
        levels[n] = keep(below.toDF(*names(n), "c", "raw"), f"kn-{n}")
    for n in range(1, order + 1):
        level, d, raw = levels[n], discounts(levels[n]), "c" if n == order else "raw"
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        if n == 1:
            total, freed, k = level.agg(F.sum("c"), F.sum(cut), F.count("*")).first()
            unseen = freed / total / (k + 1)
            p = level.select("w1", F.col(raw).alias("raw"), ((F.col("c") - cut) / total + unseen).alias("p"))
            p = p.withColumn("gain", F.log("p") - math.log(unseen))
        else:
            ctx = level.groupBy(*names(n - 1)).agg(F.sum("c").alias("total"), F.sum(cut).alias("freed"), F.sum(raw).alias("ctx_raw"))
            ctx = keep(ctx, f"kn-context-{n}")
            gamma = F.col("freed") / F.col("total")
            found.append(ctx.select(F.xxhash64(*names(n - 1)).alias("key"), F.log(gamma).alias("v"), (F.col("ctx_raw") >= limit).alias("hot")))
            # alpha / gamma and the suffix's p give the gain; only what later steps need is carried on
            with_ctx = join_split(level, ctx, names(n - 1), "ctx_raw", limit).select(*names(n), F.col(raw).alias("raw"), ((F.col("c") - cut) / F.col("freed")).alias("odds"), *([gamma.alias("gamma")] if n < order else []))
            suffix = lower.select(*(F.col(f"w{i}").alias(f"w{i + 1}") for i in range(1, n)), F.col("p").alias("q"), F.col("raw").alias("suffix_raw"))
            p = join_split(with_ctx, suffix, names(n, 2), "suffix_raw", limit).withColumn("gain", F.log1p(F.col("odds") / F.col("q")))
            if n < order:
                p = p.select(*names(n), "raw", "gain", (F.col("gamma") * (F.col("odds") + F.col("q"))).alias("p"))
        if n < order:
            p = keep(p, f"kn-p-{n}")
        found.append(p.select(F.xxhash64(*names(n)).alias("key"), F.col("gain").alias("v"), (F.col("raw") >= limit).alias("hot")))
        lower = p
    out = found.pop()  # n-grams of the highest order are no context: nothing to add up for them
    if found:
        rest = found[0]
        for f in found[1:]:
            rest = rest.unionByName(f)
        out = out.unionByName(rest.groupBy("key").agg(F.sum("v").alias("v"), F.max("hot").alias("hot")))
    values = materialize(out.select("key", F.round(F.col("v") * UNIT).cast("long").alias("v"), "hot"), "kn-values")
    release(*scratch)
    return values, math.log(unseen)


def trusted_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of ``docs`` (_id, text) with an id in ``ids`` (_id, distinct): by broadcast if those are proven few, else by sort-merge."""
    few = ids.limit(MOST_IDS + 1).count() <= MOST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "_id", "left_semi")


def fit(docs: DataFrame, ids: DataFrame, order=ORDER, hot_parts=HOT_PARTS):
    """(values, log p of an unseen word) from the texts of ``docs`` (_id, text) with an id in ``ids``; None if they hold no word."""
    counts = materialize(count_grams(trusted_texts(docs, ids), "text", order), "kn-counts")
    if counts.isEmpty():
        return None
    model = estimate(counts, order, hot_parts)
    release(counts)
    return model


# --- scoring
def postings(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], order=ORDER) -> DataFrame:
    """(key, block, post, doc) of ``docs`` (_id, text, lang): one row for each document, with its hot n-grams' sum, and one
    for each other n-gram of a block, with the documents that hold it, repeats included."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches):
        hot_key, hot_v = shared.value
        part, seen = TaskContext.get().partitionId() << 32, 0
        for block in pieces_of(batches, BLOCK_WORDS, BLOCK_DOCS):
            ids, n = word_ids(column(block, 0))
            seq, owner, start = marked(ids, n, order)
            owner, sums = owner.astype(np.int16), np.zeros(len(n), np.int64)
            ends_here = ~(start & np.append(start[1:], False))  # only the last start mark is a context of a word
            places, keys = [], []
            for size in range(1, order + 1):
                # windows inside one text: they end at or behind the size-th place
                end = np.arange(size - 1, len(seq))
                end = end[(owner[end] == owner[end - size + 1]) & ends_here[end]]
                key, own = key_of([seq[end - size + 1 + i] for i in range(size)]), owner[end]
                if len(hot_key):
                    at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                    is_hot = hot_key[at] == key
                    np.add.at(sums, own[is_hot], hot_v[at[is_hot]])
                    key, own = key[~is_hot], own[~is_hot]
                keys.append(key), places.append(own)
            key, own = np.concatenate(keys), np.concatenate(places)
            by = np.argsort(key, kind="stable")
            key, own = key[by], own[by]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            ends = np.append(at, len(key))
            whose = pa.StructArray.from_arrays([column(block, 1), column(block, 2), pa.array(n.astype(np.int64)), pa.array(sums)], ["id", "lang", "n", "hot"])
            number = part + seen
            seen += 1
            for i in range(0, len(n), 10_000):
                docs_here = np.arange(i, min(i + 10_000, len(n)))
                spread = key_of([docs_here.astype(np.int64), np.full(len(docs_here), number, np.int64)])
                post = pa.ListArray.from_arrays(np.arange(len(docs_here) + 1, dtype=np.int32), docs_here.astype(np.int16))
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.full(len(docs_here), number)), post, whose.slice(i, len(docs_here))], ["key", "block", "post", "doc"])
            for i in range(0, len(at), 50_000):
                e = ends[i : i + 50_001]
                post = pa.ListArray.from_arrays((e - e[0]).astype(np.int32), own[e[0] : e[-1]])
                yield pa.RecordBatch.from_arrays([pa.array(key[e[:-1]]), pa.array(np.full(len(e) - 1, number)), post, pa.nulls(len(e) - 1, whose.type)], ["key", "block", "post", "doc"])

    return docs.select("text", "_id", "lang").mapInArrow(run, f"key bigint, block bigint, post array<smallint>, doc struct<id: {kind}, lang: string, n: bigint, hot: bigint>")


def score(docs: DataFrame, values: DataFrame, unseen: float, order=ORDER) -> DataFrame:
    """(doc_id, lang, n_words, nll) of ``docs`` (_id, text, lang): mean negative log probability per word, null for blank text."""
    hot = values.where("hot").select("key", "v").toPandas().sort_values("key")
    table = hot["key"].to_numpy(np.int64), hot["v"].to_numpy(np.int64)
    # few documents follow any one key here: hot n-grams are gone, and a block gives a key at most once
    met = postings(docs, table, order).join(values.where(~F.col("hot")).select("key", "v").hint("merge"), "key", "left").where("v IS NOT NULL OR doc IS NOT NULL")
    spread = met.select("block", F.explode("post").alias("at"), F.when(F.col("doc").isNull(), F.col("v")).otherwise(F.col("doc.hot")).alias("v"), "doc")
    # documents' own fields are part of the first key: sums of fixed-size values stay in hash aggregation
    sums = spread.groupBy("block", "at", "doc").agg(F.sum("v").alias("v"))
    per_doc = sums.groupBy("block", "at").agg(F.sum("v").alias("v"), F.max("doc").alias("doc")).select("v", F.col("doc.id").alias("doc_id"), F.col("doc.lang").alias("lang"), F.col("doc.n").alias("n_words"))
    end = F.col("n_words") + 1
    return per_doc.select("doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, -(F.col("v") / UNIT / end) - unseen).alias("nll"))


def _scored(docs: DataFrame, ids: DataFrame, order: int) -> DataFrame | None:
    """Scores by a model of the texts with an id in ``ids``, materialized; None if these hold no word. Bigrams go by packed shards."""
    from . import bigrams

    if order == 2:
        return bigrams.score(docs, ids)
    model = fit(docs.select("_id", "text"), ids, order)
    return None if model is None else materialize(score(docs, *model, order), "kn-scores")


def classify(docs: DataFrame, trusted: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", quantile=0.95, margin=2.0, order=ORDER) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, limit, kept), one row for each row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    out = F.pmod(F.xxhash64("_id"), F.lit(10)) == 0
    calibrate, scored = ids.where(out), _scored(docs, ids.where(~out), order)
    if scored is None:
        calibrate, scored = ids, _scored(docs, ids, order)
    if scored is None:
        n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        return docs.select(F.col("_id").alias("doc_id"), "lang", n.alias("n_words"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("limit"), (n > 0).alias("kept"))
    scored = scored.withColumn("group", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    known = scored.where("nll IS NOT NULL")
    quant = F.percentile_approx(F.exp("nll"), quantile, 10000) * margin
    base = known.join(calibrate.withColumnRenamed("_id", "doc_id"), "doc_id", "left_semi")
    overall = base.agg(quant).first()[0]
    if overall is None:  # no calibration document holds a word
        base = known.join(ids.withColumnRenamed("_id", "doc_id"), "doc_id", "left_semi")
        overall = base.agg(quant).first()[0]
    limits = base.groupBy("group").agg(quant.alias("limit"))
    # a language may hold most rows: its limit is given to 64 salts, so that its rows do not meet in one task
    limits = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    judged = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "nll"), F.lit(64)).cast("int")).join(limits, ["group", "salt"], "left").withColumn("limit", F.coalesce("limit", F.lit(overall))).withColumn("perplexity", F.exp("nll"))
    return judged.select("doc_id", "lang", "n_words", "perplexity", "limit", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(False)).alias("kept"))
