"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints: majority bits of the XXH64 hashes of word shingles. Links: pairs of fingerprints that differ in
at most ``radius`` bits. Each bit position gets a non-zero vector of radius+1 bits; for every non-zero v
of as many bits, the table's mask keeps the positions whose vector has an odd product with v. The vectors of up
to ``radius`` differing positions have a common orthogonal v, and in v's table both fingerprints have the same
key: every linked pair collides somewhere.

Equal fingerprints are merged first, so copies cost one row. A bucket of more than ``bucket_limit``
fingerprints is not cut: its members go to a further level of masks over the bits still free, and so on
until few enough share a key; with eight bits free they are 2**8 at most. Inside a bucket a forest
is emitted, never all pairs. Components come from alternating large-star and small-star steps over the links;
each round is written to the shared scratch folder.

Defined results: null or blank text has fingerprint 0 and links like any other. Rows with null ids are linked,
but the smallest non-null id names the component (null if it has none). Rows with equal ids all get
their own fingerprint's component. Repeated rows and ties share one component. A very long text is hashed in parts of 65,536 shingles and none
is left out. Only the two named columns are read, so others may have any name. Empty input gives no rows. A radius outside 1 to 7 raises.

Costs: a bucket of more than ``bucket_limit`` fingerprints gives each of them 31 keys (2**(radius+1) - 1) at the next level, and only those still in
large buckets go further; each level fixes at least one more bit of each radius+1.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import materialize, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return 0
    joined = b" ".join(words).lower()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist())], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind.simpleString()}, fp bigint")


_ALL = (1 << 64) - 1
#: Primitive polynomials over two elements, by degree.
PRIMITIVE = {2: 0b111, 3: 0b1011, 4: 0b10011, 5: 0b100101, 6: 0b1000011, 7: 0b10000011, 8: 0b100011101}


def cover(bits: int, radius: int) -> list[int]:
    """The masks of a covering family over the set positions of ``bits``.

    Positions get successive powers of a primitive element, of which any radius+1 in a row are independent: every
    mask keeps at least one of each radius+1 positions in a row, so masks over what is left free always get further.
    """
    if radius + 1 not in PRIMITIVE:
        raise ValueError(f"radius must be between 1 and {max(PRIMITIVE) - 1}")
    at, degree, vectors, x = [i for i in range(64) if bits >> i & 1], radius + 1, [], 1
    for _ in at:
        vectors.append(x)
        x <<= 1
        if x >> degree:
            x ^= PRIMITIVE[degree]
    return [sum(1 << i for i, y in zip(at, vectors) if (y & v).bit_count() & 1) for v in range(1, 1 << degree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``radius`` bits, fewer than there are fingerprints."""
    out, rest, queue = [], fps[1:], [fps[0]]
    while rest.size:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        x = queue.pop()
        near = np.bitwise_count(rest ^ x) <= radius
        if near.any():
            found = rest[near]
            out += [(x, y) for y in found]
            queue += list(found)
            rest = rest[~near]
    return out


def links(fps: DataFrame, radius: int = 4, bucket_limit: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps.fp`` whose components are those of all links."""
    if bucket_limit < 256:
        raise ValueError("bucket_limit must be at least 256")
    def edges(batches):
        for b in batches:
            pairs = []
            for x in b.column(0):
                pairs += forest(np.unique(x.values.to_numpy(zero_copy_only=False)).view(np.uint64), radius)
            p = np.array(pairs, np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    def further(batches):  # the same covering again, over the bits that a mask leaves free
        for b in batches:
            nexts = [[_signed(m & _ALL | x) for x in cover(~m & _ALL, radius)] for m in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nexts, pa.list_(pa.int64()))], ["mask", "key", "nexts"])

    keyed = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in cover(_ALL, radius)])).alias("mask"))
    found, scratch = None, []
    while True:
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sized = keyed.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
        sized = materialize(sized, "simhash-buckets")
        scratch.append(sized)
        pair = sized.where("n = 2").select("a", "b").where(F.bit_count(F.expr("a ^ b")) <= radius)
        many = keyed.join(sized.where(f"n > 2 AND n <= {bucket_limit}").select("mask", "key"), ["mask", "key"])
        many = many.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(edges, "a bigint, b bigint")
        both = pair.unionByName(many)
        found = both if found is None else found.unionByName(both)
        large = sized.where(f"n > {bucket_limit}").select("mask", "key")
        if large.isEmpty():
            break
        nexts = large.mapInArrow(further, "mask bigint, key bigint, nexts array<bigint>")
        keyed = keyed.join(nexts, ["mask", "key"]).select("fp", F.explode("nexts").alias("mask")).distinct()
        keyed = materialize(keyed, "simhash-level")
        scratch.append(keyed)
    out = materialize(found.distinct(), "simhash-links")
    release(*scratch)
    return out


def split_join(many: DataFrame, one: DataFrame, on: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row for each key and in ``n`` how often ``many`` has it, ``total`` in all.

    Keys with at least 1/``parts`` of all rows are ``parts`` at most by that share; theirs are broadcast, so that no key is one task's.
    """
    limit = max(2, -(-total // parts))
    hot = one.where(F.col("n") >= limit)
    rest = many.join(F.broadcast(hot.select(on)), on, "left_anti").join(one.where(F.col("n") < limit), on)
    return many.join(F.broadcast(hot), on).unionByName(rest).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the component's smallest node."""

    def stamp(e):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())

    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = stamp(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        big = split_join(both.where("v > u"), least, "u", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u")  # a hub's rows are split by adaptive execution; a second split_join costs the driver a third more memory
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, e = e, materialize(small, "links")
        release(last)
        now = stamp(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, bucket_limit: int = 2048) -> DataFrame:
    """(doc_id, fingerprint hex, component_id), one row for each row of ``docs``."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    rows, distinct = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    roots = components(links(classes.select("fp"), radius, bucket_limit))
    rooted = materialize(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    least = split_join(rooted.select("fp", "root", F.col("n").alias("copies")), named, "root", distinct).select("fp", "component_id", F.col("copies").alias("n"))
    least = materialize(least, "components")
    return split_join(prints, least, "fp", rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, bucket_limit: int = 2048) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the first by (id, fingerprint, hash of the text), null ids last.

    Rows are chosen by id and text together, so an id that repeats with another text loses nothing but near copies. Of rows with
    the chosen id and text one stays.
    """
    mark = F.sha2(F.coalesce(F.concat(F.lit("t"), docs[text_col].cast("string")), F.lit("")), 256)  # null is not the empty text
    keyed = docs.select(F.struct(docs[id_col].alias("id"), mark.alias("hash")).alias("key"), docs[text_col].alias("text"))
    prints = materialize(fingerprints(keyed, "key", "text", shingle), "fingerprints").select("doc_id.id", "doc_id.hash", "fp")
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("blank"), "id", "hash")).alias("b"))
    roots = components(links(first.select("fp"), radius, bucket_limit))
    first = first.join(roots, first.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), F.struct("b.blank", "b.id", "fp", "b.hash").alias("b"))
    chosen = first.groupBy("root").agg(F.min("b").alias("b")).select("b.id", "b.hash")
    sizes = prints.groupBy("id", "hash").agg(F.count("*").alias("n"))
    same = chosen["id"].eqNullSafe(sizes["id"]) & (chosen["hash"] == sizes["hash"])
    chosen = materialize(chosen.join(sizes, same).select(chosen["id"].alias("_kept_id"), chosen["hash"].alias("_kept_hash"), F.col("n").alias("_kept_n")), "near-duplicates")
    kept = docs.join(chosen, docs[id_col].eqNullSafe(chosen["_kept_id"]) & (mark == chosen["_kept_hash"]))
    once = kept.where("_kept_n = 1").select(*docs.columns)
    if chosen.where("_kept_n > 1").isEmpty():
        return once
    return once.unionByName(kept.where("_kept_n > 1").dropDuplicates(["_kept_id", "_kept_hash"]).select(*docs.columns))
