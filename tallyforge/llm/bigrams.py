"""Word bigrams of a modified Kneser-Ney model, counted and joined in packed shards.

``kneser_ney`` gives one row to each n-gram of a block of texts; here a block gives one row to each *shard*, which holds its
bigrams as compressed arrays, so shuffles are several times smaller and the joins run over sorted arrays. The model is that of
``kneser_ney`` at order 2, in the same whole millionths.

A bigram lives in the shard of its first word. First words with at least 1/HOT_PARTS of all words have their bigrams dealt by both words
instead, and the bigrams that common are added where the text is read: no key is a shard's burden. Both lists are counted over
all texts, have at most HOT_PARTS entries by their share, and change only where work is done.

    1. ``common``       words and bigrams with that share, over all texts
    2. ``count``        shards of trusted bigrams and counts; sums of hot first words
    3. ``continue_``    in how many bigrams each word comes second: shards ask the word's own shard, which adds up and answers
    4. ``score``        all texts, in ``ranges`` of shards one after the other, so that a range's shuffle is gone before the next:
                        each word adds log p(word) + log gamma(word) + gain(word, next word) to its document

A shard holds about SHARD_WORDS words of text at every size of input. Ranges are put together by (id, language, hash of the text): rows
that are equal in all three have equal scores.
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

from .common import materialize, release
from .kneser_ney import BLOCK_DOCS, END, START, UNIT, column, discounts_of, fold, pieces_of, trusted_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOT_PARTS, SHARD_WORDS, RANGES = 4_000, 2_000_000, 3
BLOCK_WORDS = 1_500_000  # of a block of texts: what a worker holds at once
LOT = 1000  # equal rows that one row gives back
#: Tasks of a shuffle at most; with more shards each task has several, one after the other.
MOST_TASKS = 20_000
#: What a context keeps for unseen words at least: discounts may be 0.
LEAST = 1e-9
#: Kinds of rows in the shuffles, in the order in which a shard reads them.
PAIRS, OWN, ANSWER, POSTS, DOCS, HOT_FIRST, HOT_PAIR, MET = range(8)
ROW = "shard int, kind int, source bigint, a binary, b binary, c binary, d binary, e binary"
STATS = "v0 bigint, v1 bigint, v2 bigint, v3 bigint, v4 bigint, v5 bigint"


# --- packed arrays
def put(x: np.ndarray) -> bytes:
    """Whole numbers from 0: as many low bytes as the largest needs, plane by plane, compressed."""
    x = np.ascontiguousarray(x).astype(np.uint64, copy=False)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes((width,)) + len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def get(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(raw[9:], n * width, asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def put_sorted(x: np.ndarray) -> bytes:
    return put(np.diff(x, prepend=np.uint64(0)))


def get_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(get(raw), dtype=np.uint64)


def put_signed(x: np.ndarray) -> bytes:
    return put(((x << 1) ^ (x >> 63)).view(np.uint64))


def get_signed(raw: bytes) -> np.ndarray:
    x = get(raw)
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def home(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words ^ (words >> np.uint64(29))) % np.uint64(shards)).astype(np.int32)


def dealt(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ second
    return home((x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F), shards)


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def by_shard(batches, columns: tuple[int, ...]):
    """(shard, its rows) of batches sorted by shard; a row holds the values of ``columns``, the first of which is the shard."""
    shard, rows = None, []
    for b in batches:
        for s, *row in zip(*(b.column(i).to_pylist() for i in columns)):
            if s != shard:
                if rows:
                    yield shard, rows
                shard, rows = s, []
            rows.append(row)
    if rows:
        yield shard, rows


def to_shards(df: DataFrame, shards: int, *order: str) -> DataFrame:
    return df.repartitionById(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard", *order)


def _row(shard=None, kind=None, source=None, arrays=(), stats=()):
    return (shard, kind, source, *arrays, *[None] * (5 - len(arrays)), *stats, *[None] * (6 - len(stats)))


def _batch(rows: list[tuple], stats: bool = True) -> pa.RecordBatch:
    names = ["shard", "kind", "source", *"abcde", *([f"v{i}" for i in range(6)] if stats else [])]
    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5, *([pa.int64()] * 6 if stats else [])]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


# --- texts
def block_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the block's words, with the marks first; place in them of each word of text; number of words of each text)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    there = pc.not_equal(pc.binary_length(flat), 0)
    coded = flat.filter(there).dictionary_encode()
    n = np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(texts))
    digest = xxhash.xxh3_64_intdigest
    ids = np.fromiter(map(digest, fold(coded.dictionary).cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    words, place = np.unique(ids, return_inverse=True)
    return np.concatenate([np.array([START, END], np.uint64), words]), (place.astype(np.int32) + 2)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int32), n


def neighbours(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, second word, text) of all bigrams, marks included, text by text."""
    at = np.flatnonzero(n)
    size = n[at] + 2
    end = np.cumsum(size)
    seq = np.empty(int(size.sum()), np.int32)
    inner = np.ones(len(seq), bool)
    inner[end - size] = inner[end - 1] = False
    seq[end - size], seq[end - 1], seq[inner] = 0, 1, codes
    first = np.ones(len(seq), bool)
    first[end - 1] = False
    first = np.flatnonzero(first)
    return seq[first], seq[first + 1], np.repeat(at, size - 1)


def common(docs: DataFrame, parts: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of bigrams, hot words, hot bigrams) over all texts. A block names what has half the share in it; sums over blocks must have the whole."""

    def run(batches):
        for block in pieces_of(batches, BLOCK_WORDS, 1 << 30):
            words, codes, n = block_words(column(block, 0))
            one, two, _ = neighbours(codes, n)
            least, size = len(one) / (2 * parts), np.int64(len(words))
            by_word = np.bincount(one, minlength=len(words))
            w = np.flatnonzero((by_word >= least) & (by_word > 0))
            keys = np.sort(one * size + two)
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            c = np.diff(np.append(at, len(keys)))
            keys, c = keys[at[c >= least]], c[c >= least]
            firsts = np.concatenate([words[w], words[keys // size]]).view(np.int64)
            seconds = pa.concat_arrays([pa.nulls(len(w), pa.int64()), pa.array(words[keys % size].view(np.int64))])
            yield pa.RecordBatch.from_arrays([pa.array(firsts), seconds, pa.array(np.concatenate([by_word[w], c]))], ["w1", "w2", "c"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([len(one)], pa.int64())], ["w1", "w2", "c"])

    met = docs.select("text").mapInArrow(run, "w1 bigint, w2 bigint, c bigint").groupBy("w1", "w2").agg(F.sum("c").alias("c"))
    met = materialize(met, "kn-common")
    total = met.where("w1 IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    rows = met.where(F.col("w1").isNotNull() & (F.col("c") >= total / parts)).collect()  # 2 x parts at most, by their share
    release(met)
    words = np.array(sorted(r["w1"] % 2**64 for r in rows if r["w2"] is None), np.uint64)
    pairs = np.array(sorted((r["w1"] % 2**64, r["w2"] % 2**64) for r in rows if r["w2"] is not None), np.uint64).reshape(-1, 2)
    return total, words, pairs


class Dealer:
    """Which shard a block's bigrams belong to, and which of them are hot."""

    def __init__(self, shards: int, hot: np.ndarray, pairs: np.ndarray):
        self.shards, self.hot, self.pairs = shards, hot, pairs

    def shard(self, words: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = home(words, self.shards)[one]
        is_hot = find(self.hot, words)[1][one]
        out[is_hot] = dealt(words[one[is_hot]], words[two[is_hot]], self.shards)
        return out

    def hot_pair(self, words: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of hot bigrams, which hot bigram each is)."""
        body = words[2:]  # sorted; the marks stand before
        place = lambda w: np.where(w < 2, w.astype(np.int64), find(body, w)[0] + 2)
        here = lambda w: (w < 2) | find(body, w)[1]
        a, b = self.pairs[:, 0], self.pairs[:, 1]
        known = np.flatnonzero(here(a) & here(b))
        size = np.int64(len(words))
        keys = place(a[known]) * size + place(b[known])
        by = np.argsort(keys)
        maybe = np.zeros(len(words), bool)
        maybe[place(a[known])] = True
        at = np.flatnonzero(maybe[one])
        slot, ok = find(keys[by], one[at] * size + two[at])
        return at[ok], known[by][slot[ok]]


def segments(words: np.ndarray, shard: np.ndarray, one: np.ndarray, two: np.ndarray, extra: np.ndarray):
    """(shard, first words, how many bigrams each, second words, which of them, extra) of each shard, bigrams by first word."""
    by = np.lexsort((one, shard))
    shard, one, two, extra = shard[by], one[by], two[by], extra[by]
    edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else [0]
    for i, j in zip(edges[:-1], edges[1:]):
        o = one[i:j]
        at = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        ids, which, c = np.unique(two[i:j], return_inverse=True, return_counts=True)
        rank = np.empty(len(ids), np.int64)
        order = np.argsort(-c, kind="stable")  # common words get small numbers
        rank[order] = np.arange(len(ids))
        yield int(shard[i]), words[o[at]], np.diff(np.append(at, j - i)), words[ids[order]], rank[which], extra[i:j]


# --- training
def count(trusted: DataFrame, deal: Dealer) -> DataFrame:
    """Rows of kind PAIRS (first words, how many, second words, which, count) by shard, HOT_FIRST, HOT_PAIR and MET."""
    shared = trusted.sparkSession.sparkContext.broadcast(cloudpickle.dumps(deal))  # with its class, which workers need not have

    def split(batches):
        deal = cloudpickle.loads(shared.value)
        for block in pieces_of(batches, BLOCK_WORDS, 1 << 30):
            words, codes, n = block_words(column(block, 0))
            one, two, _ = neighbours(codes, n)
            keys = np.sort(one * np.int64(len(words)) + two)
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            one, two = keys[at] // len(words), keys[at] % len(words)
            shard = deal.shard(words, one, two)
            for s, *arrays in segments(words, shard, one, two, np.diff(np.append(at, len(keys)))):
                yield _batch([_row(s, PAIRS, None, tuple(map(put, arrays)))[:8]], False)

    def add(batches):
        deal = cloudpickle.loads(shared.value)
        for s, packed in by_shard(batches, (0, 3, 4, 5, 6, 7)):
            found = [tuple(map(get, raw)) for raw in packed]
            firsts = np.unique(np.concatenate([f[0] for f in found]))
            seconds = np.unique(np.concatenate([f[2] for f in found]))
            size = np.int64(len(seconds))
            keys = np.concatenate([np.repeat(np.searchsorted(firsts, f[0]), f[1].astype(np.int64)) * size + np.searchsorted(seconds, f[2])[f[3].astype(np.int64)] for f in found])
            c = np.concatenate([f[4] for f in found]).astype(np.int64)
            by = np.argsort(keys)
            keys, c = keys[by], c[by]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, c = keys[at], np.add.reduceat(c, at)
            one, two = keys // size, keys % size
            begin = np.searchsorted(one, np.arange(len(firsts)))
            rows = [_row(s, PAIRS, None, (put_sorted(firsts), put(np.diff(np.append(begin, len(one)))), put_sorted(seconds), put(two), put(c)))]
            rows.append(_row(s, MET, stats=tuple(int((c == i).sum()) for i in (1, 2, 3, 4))))
            for i in np.flatnonzero(find(deal.hot, firsts)[1]):
                own = c[begin[i] : begin[i + 1] if i + 1 < len(begin) else len(c)]
                rows.append(_row(s, HOT_FIRST, stats=(int(firsts[i : i + 1].view(np.int64)[0]), int(own.sum()), *(int((own == k).sum()) for k in (1, 2)), int((own > 2).sum()))))
            for a, b in deal.pairs:
                (i,), (j,) = find(firsts, np.array([a]))[0], find(seconds, np.array([b]))[0]
                k = np.searchsorted(keys, i * size + j)
                if firsts[i] == a and seconds[j] == b and k < len(keys) and keys[k] == i * size + j:
                    rows.append(_row(s, HOT_PAIR, stats=(*np.array([a, b], np.uint64).view(np.int64).tolist(), int(c[k]))))
            yield _batch(rows)

    packed = trusted.select("text").mapInArrow(split, ROW)
    return materialize(to_shards(packed, deal.shards).mapInArrow(add, f"{ROW}, {STATS}"), "kn-counts")


def continue_(counts: DataFrame, deal: Dealer) -> DataFrame:
    """Of each word, in how many bigrams it comes second: OWN (words, numbers) in its own shard, ANSWER (numbers) to each shard that has it, MET."""
    shards, hot = deal.shards, deal.hot

    def ask(batches):
        for b in batches:
            for s, words, which in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = get_sorted(words)
                n = np.bincount(get(which).astype(np.int64), minlength=len(words))
                to = home(words, shards)
                by = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[by], np.arange(shards + 1))
                rows = [_row(k, ANSWER, s, (put_sorted(words[own]), put(n[own])))[:8] for k in range(shards) if len(own := by[edges[k] : edges[k + 1]])]
                for i in range(0, len(rows), 1000):
                    yield _batch(rows[i : i + 1000], False)

    def answer(batches):
        for k, found in by_shard(batches, (0, 2, 3, 4)):  # packed as they came; opened one after the other
            words = np.unique(np.concatenate([get_sorted(w) for _, w, _ in found]))
            n = np.zeros(len(words), np.int64)
            for _, w, c in found:
                n[np.searchsorted(words, get_sorted(w))] += get(c).astype(np.int64)
            rows = [_row(k, OWN, None, (put_sorted(words), put(n))), _row(k, MET, stats=(*(int((n == i).sum()) for i in (1, 2, 3, 4)), int(n.sum()), len(n)))]
            at, there = find(words, hot)
            rows += [_row(k, HOT_FIRST, stats=(int(hot[i : i + 1].view(np.int64)[0]), int(n[at[i]]))) for i in np.flatnonzero(there)]
            yield _batch(rows)
            for i in range(0, len(found), 1000):
                yield _batch([_row(s, ANSWER, k, (put(n[np.searchsorted(words, get_sorted(w))]),)) for s, w, _ in found[i : i + 1000]])

    pairs = counts.where(f"kind = {PAIRS}").select("shard", "c", "d")
    return materialize(to_shards(pairs.mapInArrow(ask, ROW), shards).mapInArrow(answer, f"{ROW}, {STATS}"), "kn-continued")


class Numbers:
    """What holds for the whole model: discounts, the mass of unseen words, values of hot words and hot bigrams."""

    def __init__(self, counts: DataFrame, continued: DataFrame, deal: Dealer):
        met = lambda df: df.where(f"kind = {MET}").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(6)]).first()
        pairs, words = met(counts), met(continued)
        self.cut2, self.cut1 = (discounts_of(*r[:4]) for r in (pairs, words))
        self.total, ones, twos = words["v4"], words["v0"], words["v1"]
        self.unseen = (self.cut1[0] * ones + self.cut1[1] * twos + self.cut1[2] * (words["v5"] - ones - twos)) / self.total / (words["v5"] + 1)
        rows = continued.where(f"kind = {HOT_FIRST}").select("v0", "v1").collect()  # as many as there are hot words, at most
        second = {r["v0"] % 2**64: r["v1"] for r in rows}
        p = self.p1(np.array([second.get(w, 0) for w in deal.hot.tolist()], np.int64))
        self.end = self.units(np.log(p[deal.hot == END]))[0]
        self.hot, self.hot_freed, gamma = deal.hot, np.ones(len(deal.hot)), np.ones(len(deal.hot))
        sums = counts.where(f"kind = {HOT_FIRST}").groupBy("v0").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in (1, 2, 3, 4)])
        for r in sums.collect():
            i = np.searchsorted(deal.hot, np.uint64(r["v0"] % 2**64))
            self.hot_freed[i] = max(LEAST, self.cut2[0] * r["v2"] + self.cut2[1] * r["v3"] + self.cut2[2] * r["v4"])
            gamma[i] = self.hot_freed[i] / r["v1"]
        self.hot_value = self.units(np.log(gamma) + np.where(deal.hot == START, 0.0, np.log(p)))
        # the words of a hot bigram are hot: each comes at least as often
        seen = {(r["v0"] % 2**64, r["v1"] % 2**64): r["v2"] for r in counts.where(f"kind = {HOT_PAIR}").collect()}
        c = np.array([seen.get((a, b), 0) for a, b in deal.pairs.tolist()], np.int64)
        at = [np.searchsorted(deal.hot, deal.pairs[:, i]) for i in (0, 1)]
        self.pair_gain = np.where(c > 0, self.gain(c, self.hot_freed[at[0]], p[at[1]]), 0)

    @staticmethod
    def _cut(c: np.ndarray, cuts) -> np.ndarray:
        return np.array([0.0, *cuts])[np.minimum(c, 3)]

    @staticmethod
    def units(x: np.ndarray) -> np.ndarray:
        return np.round(x * UNIT).astype(np.int64)

    def p1(self, n: np.ndarray) -> np.ndarray:
        return (n - self._cut(n, self.cut1)) / self.total + self.unseen

    def gain(self, c: np.ndarray, freed: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.units(np.log1p((c - self._cut(c, self.cut2)) / freed / q))


# --- scoring
class Shard:
    """One shard's model, from its rows of kinds PAIRS, OWN and ANSWER."""

    def __init__(self, rows: list, numbers: Numbers, shards: int):
        none = np.zeros(0, np.uint64)
        pairs, own = (next((r for r in rows if r[1] == k), None) for k in (PAIRS, OWN))
        self.firsts, size, self.seconds, two, c = (get_sorted(pairs[3]), get(pairs[4]).astype(np.int64), get_sorted(pairs[5]), get(pairs[6]).astype(np.int64), get(pairs[7]).astype(np.int64)) if pairs else (none, none.view(np.int64), none, none.view(np.int64), none.view(np.int64))
        begin = np.cumsum(size) - size
        many = np.array([0.0, *numbers.cut2])[np.minimum(c, 3)]
        total, freed = (np.add.reduceat(x, begin) if len(x) else x for x in (c.astype(float), many))
        at, hot = find(numbers.hot, self.firsts)
        freed = np.where(hot, numbers.hot_freed[at], np.maximum(freed, LEAST))
        n = np.zeros(len(self.seconds), np.int64)
        to = home(self.seconds, shards)
        for r in rows:
            if r[1] == ANSWER:
                n[to == r[2]] = get(r[3]).astype(np.int64)
        one = np.repeat(np.arange(len(size)), size)
        self.keys = one * np.int64(max(1, len(self.seconds))) + two
        self.gains = numbers.gain(c, freed[one], numbers.p1(n)[two])
        # value of a word as a first word: log gamma, if it is one, and its own log p; hot words have theirs added where the text is read
        self.words, n = (get_sorted(own[3]), get(own[4]).astype(np.int64)) if own else (none, none.view(np.int64))
        self.log_p, self.log_gamma = np.log(numbers.p1(n)), np.where(hot, 0.0, np.log(freed / np.where(hot, 1.0, total)))
        self.numbers = numbers

    def sums(self, row) -> tuple[np.ndarray, np.ndarray]:
        """(texts of the block, what the bigrams of a row of kind POSTS add to each)."""
        firsts, size, seconds, which = get_sorted(row[3]), get(row[4]).astype(np.int64), get(row[5]), get(row[6]).astype(np.int64)
        text = np.cumsum(get(row[7]).astype(np.uint16), dtype=np.uint16)
        at, known = find(self.firsts, firsts)
        place, here = find(self.words, firsts)
        value = np.full(len(firsts), math.log(self.numbers.unseen))
        value[here] = self.log_p[place[here]]
        value[firsts == START] = 0.0
        value[known] += self.log_gamma[at[known]]
        value = self.numbers.units(value)
        value[find(self.numbers.hot, firsts)[1]] = 0
        to, there = find(self.seconds, seconds)
        v = np.repeat(value, size)
        maybe = np.flatnonzero(np.repeat(known, size) & there[which])
        keys = np.repeat(at, size)[maybe] * np.int64(max(1, len(self.seconds))) + to[which[maybe]]
        slot, seen = find(self.keys, keys)
        v[maybe[seen]] += self.gains[slot[seen]]
        sums = np.bincount(text, weights=v)  # whole numbers far below 2**53: exact
        texts = np.flatnonzero(np.bincount(text))
        return texts, sums[texts].astype(np.int64)


def _score_range(docs: DataFrame, model: DataFrame, numbers: Numbers, deal: Dealer, part: int, ranges: int) -> DataFrame:
    """(id, lang, n, h, v): what the shards of one range add to each text; the first range also adds what is hot."""
    sc = docs.sparkSession.sparkContext
    shared, here = sc.broadcast(cloudpickle.dumps((deal, numbers))), deal.shards // ranges
    kind = docs.schema["_id"].dataType.simpleString()
    texts = f"docs array<struct<id:{kind},lang:string,n:bigint,h:bigint,v:bigint>>"

    def post(batches):
        deal, numbers = cloudpickle.loads(shared.value)
        number = TaskContext.get().partitionId() << 32
        for block in pieces_of(batches, BLOCK_WORDS, BLOCK_DOCS):
            raw = column(block, 0)
            words, codes, n = block_words(raw)
            one, two, text = neighbours(codes, n)
            sums = np.zeros(len(n), np.int64)
            at, which = deal.hot_pair(words, one, two)
            if part == 0:
                slot, is_hot = find(numbers.hot, words)
                value = np.where(is_hot, numbers.hot_value[slot], 0)[one]
                value[at] += numbers.pair_gain[which]
                sums += np.bincount(text, weights=value, minlength=len(n)).astype(np.int64) + np.where(n > 0, numbers.end, 0)
            shard = deal.shard(words, one, two)
            take = shard % ranges == part
            take[at] = False
            info = pa.StructArray.from_arrays(
                [column(block, 1), column(block, 2), pa.array(n.astype(np.int64)), pa.array(np.array([-1 if t is None else xxhash.xxh3_64_intdigest(t) >> 1 for t in raw.cast(pa.binary()).to_pylist()], np.int64)), pa.array(sums)],
                ["id", "lang", "n", "h", "v"],
            )
            none = lambda rows: pa.nulls(rows, pa.list_(info.type))
            for s, first, size, second, rank, own in segments(words, shard[take] // ranges, one[take], two[take], text[take]):
                b = _batch([_row(s, POSTS, number, (put_sorted(first), put(size), put(second), put(rank), put(np.diff(own.astype(np.uint16), prepend=np.uint16(0)))))[:8]], False)
                yield pa.RecordBatch.from_arrays([*b.columns, none(1)], [*b.schema.names, "docs"])
            b = _batch([_row(number % here, DOCS, number)[:8]], False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), info)], [*b.schema.names, "docs"])
            number += 1

    def join(batches):
        (deal, numbers), own, rows, shard = cloudpickle.loads(shared.value), None, [], None
        for b in batches:
            for i, r in enumerate(zip(*(b.column(j).to_pylist() for j in range(8)))):
                if r[0] != own:  # shards come one after the other
                    own, rows, shard = r[0], [], None
                if r[1] < POSTS:
                    rows.append(r)
                elif r[1] == DOCS:
                    yield pa.RecordBatch.from_arrays([b.column(2).slice(i, 1), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), b.column(8).slice(i, 1)], ["block", "a", "b", "docs"])
                else:
                    shard = shard or Shard(rows, numbers, deal.shards)
                    texts, sums = shard.sums(r)
                    yield pa.RecordBatch.from_arrays([pa.array([r[2]], pa.int64()), pa.array([put(texts)], pa.binary()), pa.array([put_signed(sums)], pa.binary()), pa.nulls(1, b.column(8).type)], ["block", "a", "b", "docs"])

    def add(batches):
        block, info, sums = None, None, np.zeros(BLOCK_DOCS, np.int64)

        def done():
            v = info.field("v").to_numpy(zero_copy_only=False) + sums[: len(info)]
            return pa.RecordBatch.from_arrays([*[info.field(x) for x in ("id", "lang", "n", "h")], pa.array(v, pa.int64())], ["id", "lang", "n", "h", "v"])

        for b in batches:  # a block's rows come one after the other
            for i, (k, texts, more) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)))):
                if k != block:
                    if block is not None:
                        yield done()
                    block, info, sums = k, None, np.zeros(BLOCK_DOCS, np.int64)
                if texts is None:
                    info = b.column(3).slice(i, 1).flatten()
                else:
                    sums[get(texts).astype(np.int64)] += get_signed(more)
        if block is not None:
            yield done()

    mine = model.where(f"shard % {ranges} = {part}").withColumn("shard", F.floor(F.col("shard") / ranges).cast("int"))
    posted = docs.select("text", "_id", "lang").mapInArrow(post, f"{ROW}, {texts}")
    both = posted.unionByName(mine, allowMissingColumns=True)
    joined = to_shards(both, here, "kind").mapInArrow(join, f"block bigint, a binary, b binary, {texts}")
    per_text = joined.repartition("block").sortWithinPartitions("block").mapInArrow(add, f"id {kind}, lang string, n bigint, h bigint, v bigint")
    return materialize(per_text, f"kn-range-{part}")


def score(docs: DataFrame, ids: DataFrame, ranges: int = RANGES, hot_parts: int = HOT_PARTS, shard_words: int = SHARD_WORDS) -> DataFrame | None:
    """(doc_id, lang, n_words, nll) of ``docs`` (_id, text, lang), by a model of those whose id is in ``ids`` (_id); None if these hold no word.

    nll is the mean negative log probability per word, null for blank text; one row for each row of ``docs``.
    """
    total, hot, pairs = common(docs, hot_parts)
    each = max(1, math.ceil(total / (ranges * shard_words)), min(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / 100_000)))
    deal = Dealer(each * ranges, np.unique(np.append(hot, np.array([START, END], np.uint64))), pairs)
    counts = count(trusted_texts(docs.select("_id", "text"), ids), deal)
    if counts.isEmpty():
        release(counts)
        return None
    continued = continue_(counts, deal)
    numbers = Numbers(counts, continued, deal)
    columns = ["shard", "kind", "source", *"abcde"]
    model = counts.where(f"kind = {PAIRS}").select(columns).unionByName(continued.where(f"kind IN ({OWN}, {ANSWER})").select(columns))
    parts = [_score_range(docs, model, numbers, deal, part, ranges) for part in range(ranges)]  # each is written before the next begins
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    equal = every.groupBy("id", "lang", "n", "h").agg(F.sum("v").alias("v"), F.count("*").alias("rows")).withColumn("rows", F.expr(f"rows div {ranges}"))
    nll = F.when(F.col("n") > 0, -(F.col("v") / F.col("rows") / UNIT) / (F.col("n") + 1))
    # equal rows are given back in lots, dealt anew, so that many of them are no task's burden
    lots = equal.select(F.col("id").alias("doc_id"), "lang", F.col("n").alias("n_words"), nll.alias("nll"), "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {LOT}"))).alias("lot"))
    copies = F.least(F.col("rows") - F.col("lot") * LOT, F.lit(LOT)).cast("int")
    out = lots.repartition("doc_id", "lot", "n_words").withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select("doc_id", "lang", "n_words", "nll")
    out = materialize(out, "kn-scores")
    release(counts, continued, *parts)
    return out
