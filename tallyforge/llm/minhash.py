"""MinHash near-dedup by circulant MinHash: two permutations give all coordinates, banding, exact Jaccard verification.

A document's set holds its distinct word shingles (fewer words than a shingle: the whole sequence). Shingles get 64-bit
codes; the first permutation of the code space scatters them once, the second is applied to the positions shifted
circularly by k = 0, 1, 2, ...; coordinate k is the smallest value. So two permutations and a shift give as many coordinates as are asked for,
and a deeper level of bands takes the next shifts.

Documents with one set are one class first, so copies cost one row. ``rows`` coordinates make a band; there are as many bands as
keep the chance that a pair at the threshold meets in none of them below ``miss``. Pairs that meet are confirmed on the full sets of words;
no hash takes part in that. In two steps no group gives all its pairs: each class is held against the least of its buckets' smallest
members (pivots); then, for pivots whose buckets still span components, the members outside the pivot's component are held against all
members by their differences from the pivot. A pivot of more than ``bucket_limit`` members is not cut: its members go to a level with twice,
then three times as many rows in a band; what is still together after ``levels`` levels meets in blocks.

Defined results: null, empty or blank text has no shingles and is linked with nothing; its component is its own id. Rows with null ids
are linked, but the smallest id that is not null names the component (null if it has none). Rows with equal ids get their own
text's component. Repeated rows share one. A row is kept if its id names its component, null naming null. Only the two named
columns are read, so others may have any name. Texts are read whole; one text and its words must fit a worker. An
empty table gives no rows.

At the threshold a pair is missed with probability ``miss`` at most, and less above it; that is all that this method leaves to chance.
"""

from __future__ import annotations

import hashlib
import math
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import materialize
from .simhash import components, split_join

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Odd multipliers of two published 64-bit mixers; each mixer is a permutation of the 64-bit integers.
FIRST = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SECOND = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Shingles that are permuted together.
BLOCK = 1 << 14


def permute(x: np.ndarray, by: tuple[int, int]) -> np.ndarray:
    """A permutation of the 64-bit integers; returns a new array."""
    y = x ^ (x >> np.uint64(33))
    y *= np.uint64(by[0])
    y ^= y >> np.uint64(29)
    y *= np.uint64(by[1])
    y ^= y >> np.uint64(32)
    return y


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, shingle: int) -> set:
    """Distinct shingles as tuples of words."""
    words = words_of(text)
    return set(zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else ({tuple(words)} if words else set())


def shingle_codes(text: str | None, shingle: int, known: dict) -> np.ndarray:
    """A 64-bit code of each distinct shingle. ``known`` keeps codes of words between calls."""
    import xxhash

    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    index: dict[bytes, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(known) > 1 << 18:
        known.clear()
    codes = np.empty(len(index), np.uint64)
    for w, i in index.items():
        if (c := known.get(w)) is None:
            c = known[w] = xxhash.xxh64_intdigest(w, 42)
        codes[i] = c
    n = max(1, len(words) - shingle + 1)
    tuples, room = at[:n], len(index)
    for i in range(1, min(shingle, len(words))):  # exact numbers of the distinct prefixes, so that equal numbers are equal shingles
        pairs = tuples * room + at[i : n + i]
        tuples = np.unique(pairs, return_inverse=True)[1] if i + 1 < min(shingle, len(words)) else pairs
    first = np.unique(tuples, return_index=True)[1]
    out = np.full(first.size, np.uint64(min(shingle, len(words))))
    for i in range(min(shingle, len(words))):
        out = permute(out * np.uint64(0x9E3779B97F4A7C15) + codes[at[first + i]], FIRST)
    return out


def signatures(sets: list[np.ndarray], shifts: range) -> np.ndarray:
    """A row of coordinates for each non-empty set of codes: the least of the second permutation at each circular shift."""
    lengths = np.array([s.size for s in sets])
    place = permute(np.concatenate(sets), FIRST)
    out = np.full((len(sets), len(shifts)), ~np.uint64(0))
    ends = np.cumsum(lengths)
    low = 0
    while low < place.size:  # sets side by side in blocks; a long one is met in several
        high = min(place.size, low + BLOCK)
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right")
        starts = np.maximum(ends[a : b + 1] - lengths[a : b + 1] - low, 0)
        for j, k in enumerate(shifts):
            least = np.minimum.reduceat(permute(place[low:high] - np.uint64(k), SECOND), starts)
            np.minimum(out[a : b + 1, j], least, out=out[a : b + 1, j])
        low = high
    return out


def banding(level: int, rows: int, threshold: int, miss: float) -> tuple[int, int]:
    """(rows, bands) of a level: twice the rows at the second, three times at the third."""
    r = rows * (level + 1)
    return r, math.ceil(math.log(miss) / math.log1p(-((threshold / 100) ** r)))


def band_keys(sets: list[np.ndarray], level: int, rows: int, threshold: int, miss: float) -> np.ndarray:
    """A row of bucket keys, one for each band, for each non-empty set of codes."""
    shift = sum(math.prod(banding(i, rows, threshold, miss)) for i in range(level))
    r, bands = banding(level, rows, threshold, miss)
    s = signatures(sets, range(shift, shift + r * bands)).reshape(len(sets), bands, r)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(level << 32), s.shape[:2]).copy()
    for i in range(r):
        keys = permute(keys ^ s[:, :, i], SECOND) + np.uint64(i)
    return keys.astype(np.int64)


def _lots(batch: pa.RecordBatch, text: int, shingle: int, known: dict, most: int = 1 << 19):
    """(rows from, rows to, their sets of codes), a bounded number of codes at a time but for a single long text."""
    at, sets, held = 0, [], 0
    for i in range(batch.num_rows):
        sets.append(shingle_codes(batch.column(text)[i].as_py(), shingle, known))
        held += sets[-1].size
        if held >= most:
            yield at, i + 1, sets
            at, sets, held = i + 1, [], 0
    if sets:
        yield at, batch.num_rows, sets


def _keys_column(sets: list[np.ndarray], *banded) -> pa.Array:
    full = [s for s in sets if s.size]
    keys = band_keys(full, *banded) if full else np.zeros((0, 1), np.int64)
    ends = np.cumsum([keys.shape[1] if s.size else 0 for s in sets])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys.ravel()))


def profiles(docs: DataFrame, id_col: str, text_col: str, shingle: int, *banded) -> DataFrame:
    """(doc_id, text_hash, n_shingles, content, keys): content is a 128-bit digest of the set, null if it is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known: dict = {}
        for b in batches:
            for low, high, sets in _lots(b, 1, shingle, known):
                digests = [hashlib.blake2b(np.sort(s).tobytes(), digest_size=16).digest() if s.size else None for s in sets]
                part = b.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([s.size for s in sets], pa.int64()), pa.array(digests, pa.binary()), _keys_column(sets, 0, *banded)], ["doc_id", "text_hash", "n_shingles", "content", "keys"])

    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, content binary, keys array<bigint>")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with text_a and text_b; rows of one ``a`` are side by side."""
    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches):
        last, left = None, set()
        for batch in batches:
            a, b, ok = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, x in enumerate(a):
                if x != last:
                    last, left = x, shingle_set(batch.column(2)[i].as_py(), shingle)
                right = shingle_set(batch.column(3)[i].as_py(), shingle)
                both = len(left & right)
                ok.append(100 * both >= threshold * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(a, ok) if y], pa.int64()), pa.array([x for x, y in zip(b, ok) if y], pa.int64())], ["a", "b"])

    return _with_texts(pairs, texts).select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


#: Rows of a group that meet in one task: outsiders as queries, and members.
QUERIES, MEMBERS = 1024, 2048


def around_pivots(groups: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Links (a, b) that join the components of each group's members. ``groups``: (a: the pivot, b: a member, the pivot included, root, m: members).

    Each member is described by its differences from the pivot's set C: words of C it lacks (removed), others it has (added). With R and A of
    them, weight 100 R + threshold A, and o differences in common, a pair reaches the threshold exactly if
    (100 + threshold) o >= both weights - (100 - threshold) |C|. Members of the pivot's component need no comparison among
    themselves; the others are the queries, in blocks, against all members, in chunks. Differences are the words themselves.
    """

    def differences(batches):
        last, left = None, set()
        for batch in batches:
            a, weight, rest, tokens = batch.column(0).to_pylist(), [], [], []
            for i, x in enumerate(a):
                if x != last:
                    last, left = x, shingle_set(batch.column(5)[i].as_py(), shingle)
                right = shingle_set(batch.column(6)[i].as_py(), shingle)
                removed, added = left - right, right - left
                weight.append(100 * len(removed) + threshold * len(added))
                rest.append((100 - threshold) * len(left))
                tokens.append([b" ".join(t) for t in removed] + [b" ".join(t) for t in added])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(weight, pa.int64()), pa.array(rest, pa.int64()), pa.array(tokens, pa.list_(pa.binary()))], ["a", "b", "root", "pivot_root", "m", "weight", "rest", "tokens"])

    def meet(table: pa.Table) -> pa.Table:
        ids, query, w = table["b"].to_pylist(), table["query"].to_pylist(), np.array(table["weight"].to_pylist(), np.int64)
        rest, sets = table["rest"][0].as_py(), table["tokens"].to_pylist()
        members = [i for i, q in enumerate(query) if not q]
        joined: dict[int, int] = {}

        def find(x):
            while joined.setdefault(x, x) != x:
                joined[x] = x = joined[joined[x]]
            return x

        at: dict[bytes, list[int]] = {}
        for k, i in enumerate(members):
            for t in sets[i]:
                at.setdefault(t, []).append(k)
        posted = {t: np.array(v) for t, v in at.items()}
        root, mw, out = table["root"].to_pylist(), w[members], []
        for i in (i for i, q in enumerate(query) if q):
            lists = [posted[t] for t in sets[i] if t in posted]
            common = np.bincount(np.concatenate(lists), minlength=len(members)) if lists else np.zeros(len(members), np.int64)
            for k in np.flatnonzero((100 + threshold) * common >= w[i] + mw - rest):
                x, y = find(root[i]), find(root[members[k]])
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    out.append((ids[i], ids[members[k]]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    rows = _with_texts(groups, texts).select("a", "b", "root", "pivot_root", "m", "text_a", "text_b")
    rows = rows.mapInArrow(differences, "a bigint, b bigint, root bigint, pivot_root bigint, m bigint, weight bigint, rest bigint, tokens array<binary>")
    part = lambda n: F.pmod(F.xxhash64("b"), n)
    blocks, chunks = F.ceil(F.col("m") / QUERIES), F.ceil(F.col("m") / MEMBERS)
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    outsider = F.col("root") != F.col("pivot_root")
    roles = F.concat(
        F.transform(every(blocks), lambda i: F.struct(F.lit(False).alias("query"), i.alias("block"), part(chunks).alias("chunk"))),
        F.when(outsider, F.transform(every(chunks), lambda i: F.struct(F.lit(True).alias("query"), part(blocks).alias("block"), i.alias("chunk")))).otherwise(F.array().cast("array<struct<query:boolean,block:bigint,chunk:bigint>>")),
    )
    return rows.select("a", "b", "root", "weight", "rest", "tokens", F.inline(roles)).groupBy("a", "block", "chunk").applyInArrow(meet, "a bigint, b bigint")


def _alike(x: str, y: str, threshold: int):
    """Sets of such sizes can reach the threshold."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * threshold


def _texts(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame) -> DataFrame:
    """(id, text) of each class in ``reps`` (id, rep: the row that stands for it, by its id and the hash of its text), once."""
    text = docs[text_col].cast("string")
    all_texts = docs.select(docs[id_col].alias("_d"), text.alias("text"), F.xxhash64(text).alias("_h"))
    reps = reps.select("id", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_th"), "repeats")
    found = all_texts.join(reps, all_texts["_d"].eqNullSafe(reps["_id"]) & (all_texts["_h"] == reps["_th"]))
    once = found.where("repeats = 1").select("id", "text")
    if reps.where("repeats > 1").isEmpty():
        return once
    return once.unionByName(found.where("repeats > 1").groupBy("id").agg(F.first("text").alias("text")))


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int, rows: int, miss: float, bucket_limit: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between class ids whose components are those of all links, and (node, root) of all linked classes."""
    banded = (rows, threshold, miss)
    found, roots, texts = [], None, None
    keyed = classes.select("id", F.col("n_shingles").alias("size"), F.explode("keys").alias("key"))

    def further(level):
        def run(batches):
            known: dict = {}
            for b in batches:
                for low, high, sets in _lots(b, 2, shingle, known):
                    part = b.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _keys_column(sets, level, *banded)], ["id", "size", "keys"])

        return run

    for level in range(levels):
        sized = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.min_by("size", "id").alias("size_a")).where("n > 1"), "minhash-buckets")
        total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        met = materialize(split_join(keyed, sized, "key", total).select("a", F.col("id").alias("b"), "size_a", "size").distinct(), "minhash-members")
        if texts is None:
            reps = classes.select("id", "rep", "repeats").join(met.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
            texts = materialize(_texts(docs, id_col, text_col, reps), "minhash-texts")
        least = met.where((F.col("a") != F.col("b")) & _alike("size", "size_a", threshold)).groupBy("b").agg(F.min("a").alias("a"))
        star = materialize(confirmed(least, texts, shingle, threshold), "minhash-links")
        found.append(star)
        label = _jumped(star, roots)
        # pivots whose members still seem to be in several components
        met = met.select("a", "b").join(label, "b", "left").withColumn("root", F.coalesce("root", "b"))
        met = materialize(met, "minhash-labels")
        sizes = met.groupBy("a").agg(F.count("*").alias("n"), F.max(F.when(F.col("a") == F.col("b"), F.col("root"))).alias("pivot_root"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        sizes = sizes.where("lo <> hi").select("a", "n", "pivot_root", F.col("n").alias("m"))
        groups = materialize(split_join(met, sizes, "a", met.count()), "minhash-groups")
        last = level + 1 == levels
        found.append(materialize(around_pivots(groups if last else groups.where(F.col("m") <= bucket_limit), texts, shingle, threshold), "minhash-links"))
        edges = reduce(DataFrame.unionByName, found)
        roots = materialize(components(edges), "minhash-roots")
        large = groups.where(F.col("m") > bucket_limit).select(F.col("b").alias("id")).distinct()
        if last or large.isEmpty():
            return edges, roots
        deep = texts.join(large, "id", "left_semi").join(classes.select("id", F.col("n_shingles").alias("size")), "id").select("id", "size", "text")
        deep = deep.mapInArrow(further(level + 1), "id bigint, size bigint, keys array<bigint>")
        keyed = materialize(deep.select("id", "size", F.explode("keys").alias("key")), "minhash-level")


def _jumped(star: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(b, root): a member of b's component, mostly the same one for all: four steps up the links to smaller pivots, or the known root."""
    up = star.select("b", F.col("a").alias("root"))
    for _ in range(2):
        up = up.join(up.select(F.col("b").alias("root"), F.col("root").alias("_r")), "root", "left").select("b", F.coalesce("_r", "root").alias("root"))
    if roots is None:
        return up
    known = roots.select(F.col("node").alias("b"), F.col("root").alias("_k"))
    named = roots.select(F.col("node").alias("root"), F.col("root").alias("_r"))
    return up.join(named, "root", "left").select("b", F.coalesce("_r", "root").alias("root")).join(known, "b", "full_outer").select("b", F.coalesce("root", "_k").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80, rows: int = 4, miss: float = 5e-8, bucket_limit: int = 1 << 14, levels: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``. ``threshold``: Jaccard similarity in per cent."""
    prints = materialize(profiles(docs, id_col, text_col, shingle, rows, threshold, miss), "minhash-profiles")
    row = F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_hash")
    by_row = prints.where("content IS NOT NULL").groupBy("content", "doc_id", "text_hash").agg(F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    best = F.min(F.struct(row.alias("rep"), F.col("n").alias("repeats"))).alias("best")
    classes = by_row.groupBy("content").agg(best, F.sum("n").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "content", "best.rep", "best.repeats", "n", "n_shingles", "keys"), "minhash-classes")
    _, roots = links(docs, classes, id_col, text_col, shingle, threshold, rows, miss, bucket_limit, levels)
    rooted = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("content", "n", F.col("rep.doc_id").alias("least"), F.coalesce("root", "id").alias("root"))
    rooted = materialize(rooted, "minhash-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    rows_, sets = rooted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    named = materialize(split_join(rooted.select("content", "root", F.col("n").alias("copies")), named, "root", sets).select("content", "component_id", F.col("copies").alias("n")), "minhash-components")
    some = split_join(prints.where("content IS NOT NULL").select("doc_id", "n_shingles", "content"), named, "content", rows_).select("doc_id", "n_shingles", "component_id")
    out = some.unionByName(prints.where("content IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
