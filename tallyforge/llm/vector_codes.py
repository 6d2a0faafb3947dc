"""Vector code compression: a codebook for each part of the vector, its entries in a ball tree.

The entries of a part's codebook are cut in two by their nearer of two far entries, and so on down to small leaves; each ball has an
entry as its centre and a radius rounded up. A vector's part first goes down to the leaf of the nearer centre, whose best entry
bounds the search; then every ball that may hold an entry as near is visited: distance to the centre, rounded down, at most the radius
plus the best distance, rounded up. The comparison is not strict, so entries that tie are met. Distances that decide are exact longs, and of
equal ones the lower index wins.

A round reads the vectors once; each task returns sums by part and entry, and the driver holds only the codebooks. No vector is written but with
its final code.

Defined results: vectors that are null or hold a null or non-finite component have no row; neither have those whose length is not the
most common one (of equally common ones the longest), as no codebook fits them. A length that ``parts`` does not divide is cut as evenly as it goes.
Components are floor(scale * x); ones too large for distances in a long raise. The first entries are those of the smallest ids,
null ids last, equal ids by their components; fewer vectors make smaller codebooks. Repeated rows each count. Only the three named columns
are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import materialize
from .simhash import split_join
from .vectors import above, below, floors, squared, summed, total_sums, usable

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ball_tree(entries: np.ndarray, leaf: int = 8) -> list[dict]:
    """Nodes, the root first: centre, radius (never too small), and the entries of a leaf in ascending order or the numbers of two children."""
    nodes: list[dict] = []

    def build(at: np.ndarray) -> int:
        middle = at[((entries[at] - entries[at].mean(0)) ** 2).sum(1).argmin()]
        d2 = squared(entries[at], entries[middle : middle + 1])[:, 0]
        nodes.append(node := {"centre": entries[middle : middle + 1], "radius": float(above(np.sqrt(float(d2.max())))), "entries": at, "children": ()})
        if at.size > leaf and d2.max():
            one = at[d2.argmax()]
            from_one = squared(entries[at], entries[one : one + 1])[:, 0]
            two = at[from_one.argmax()]
            nearer = from_one <= squared(entries[at], entries[two : two + 1])[:, 0]
            number = len(nodes) - 1
            node["children"] = (build(at[nearer]), build(at[~nearer]))
            return number
        return len(nodes) - 1

    if len(entries):
        build(np.arange(len(entries)))
    return nodes


def nearest(x: np.ndarray, entries: np.ndarray, tree: list[dict], measured: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, exact squared distance) of the nearest entry, ties to the lower index. ``measured`` gets the number of distances computed."""
    best, index, home = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries)), np.full(len(x), -1)
    count = 0

    def look(number: int, at: np.ndarray) -> None:
        nonlocal count
        own = tree[number]["entries"]
        d = squared(x[at], entries[own])
        count += d.size
        k = d.argmin(1)
        d, e = d[np.arange(at.size), k], own[k]
        better = (d < best[at]) | ((d == best[at]) & (e < index[at]))
        best[at[better]], index[at[better]] = d[better], e[better]

    def centres(number: int, at: np.ndarray) -> list[np.ndarray]:
        nonlocal count
        count += 2 * at.size
        return [squared(x[at], tree[c]["centre"])[:, 0] for c in tree[number]["children"]]

    def descend(number: int, at: np.ndarray) -> None:
        if not tree[number]["children"]:
            home[at] = number
            look(number, at)
            return
        left, right = centres(number, at)
        for child, own in zip(tree[number]["children"], (left <= right, left > right)):
            if own.any():
                descend(child, at[own])

    def visit(number: int, at: np.ndarray) -> None:
        if not tree[number]["children"]:
            at = at[home[at] != number]
            if at.size:
                look(number, at)
            return
        first, second = tree[number]["children"]
        left, right = centres(number, at)
        for child, d2 in ((first, left), (second, right)):
            may = below(np.sqrt(d2.astype(np.float64))) <= above(tree[child]["radius"] + above(np.sqrt(best[at].astype(np.float64))))
            if may.any():
                visit(child, at[may])

    if len(x):
        descend(0, np.arange(len(x)))
        visit(0, np.arange(len(x)))
    if measured is not None:
        measured.append(count)
    return index, best


def _cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    return [(i * dims // parts, (i + 1) * dims // parts) for i in range(parts)]


def _kept(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, int]:
    """The usable vectors of the most common length, and that length (0 if there is none)."""
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label")).where(usable("vec"))
    common = kept.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    return kept.where(F.size("vec") == dims), dims


def fit(kept: DataFrame, dims: int, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """A codebook of whole numbers for each part."""
    first = floors(kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).toArrow()["vec"], scale, dims)
    cuts = _cuts(dims, parts)
    books = [first[:, a:b] for a, b in cuts]
    width = max(b - a for a, b in cuts)

    def sums_of(books):
        def run(batches):
            trees = [ball_tree(e) for e in books]
            counts, sums = np.zeros((parts, len(first)), np.int64), np.zeros((parts, len(first), width), np.int64)
            for b in batches:
                q = floors(b.column(0), scale, dims)
                for p, (lo, hi) in enumerate(cuts):
                    if len(q):
                        g, n, s = summed(nearest(q[:, lo:hi], books[p], trees[p])[0], q[:, lo:hi])
                        counts[p, g] += n
                        sums[p, g, : hi - lo] += s
            full = np.flatnonzero(counts.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * width, pa.int32()), pa.array(sums.reshape(-1, width)[full].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts.ravel()[full]), lists], ["slot", "n", "sums"])

        return run

    for _ in range(rounds if len(first) and dims else 0):
        got = total_sums(kept.select("vec").mapInArrow(sums_of(books), "slot int, n bigint, sums array<bigint>"), "slot", width)
        books = [b.copy() for b in books]
        for slot, (n, sums) in got.items():
            p, e = divmod(slot, len(first))
            books[p][e] = [s // n for s in sums[: books[p].shape[1]]]
    return books


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row for each kept vector. code: two hex digits a part."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256: a code has two hex digits for each part")
    kept, dims = _kept(vectors, id_col, vec_col, label_col)
    books = fit(kept, dims, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()
    cuts = _cuts(dims, parts)

    def encode(batches):
        trees = [ball_tree(e) for e in books]
        for b in batches:
            q = floors(b.column(2), scale, dims)
            codes, error = np.zeros((len(q), parts), np.uint8), np.zeros(len(q), np.int64)
            for p, (lo, hi) in enumerate(cuts):
                if len(q):
                    e, d = nearest(q[:, lo:hi], books[p], trees[p])
                    codes[:, p] = e
                    error += d
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], ["vec_id", "group", "code", "error"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    group = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))  # null labels together, apart from blank ones
    coded = materialize(kept.select("vec_id", group.alias("group"), "vec").mapInArrow(encode, f"vec_id {kind}, group string, code string, error bigint"), "vector-codes")
    totals = materialize(coded.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "vector-labels")
    rows = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return split_join(coded, totals, "group", rows).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
