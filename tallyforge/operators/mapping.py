"""Labels to concepts: exact, fuzzy, sequence and TF-IDF matches, cascades, statistics."""

from __future__ import annotations

import difflib
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import clean_phrase, tokens, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A lexicon above this many rows is compared in lots of about as many.
SMALL_DIMENSION = 20_000
#: Up to this many pairs of document and token a TF-IDF side is broadcast.
SMALL_POSTINGS = 200_000


def exact(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """labels(label, clean_label) to rules(clean_label, concept); no match gives null. Of equal rules the last name wins."""
    one = rules.groupBy("clean_label").agg(F.max("concept").alias("concept"))
    return labels.join(one, "clean_label", "left").withColumn("confidence", F.when(F.col("concept").isNotNull(), 100.0).otherwise(0.0)).withColumn("method", F.when(F.col("concept").isNotNull(), "exact").otherwise("none"))


def token_sort(t):
    return F.array_join(F.array_sort(words(F.lower(t))), " ")


def edit_ratio(a, b):
    """100 * (1 - edit distance over the longer length): the fuzzy score that SQL can check."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / n))


def contain_score(a, b):
    """T4."""
    return F.when((a != "") & (b != "") & (a.contains(b) | b.contains(a)), 90.0).otherwise(0.0)


def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def sequence_ratio(a, b):
    """T5: difflib's ratio; there is no built-in with its values."""
    return F.pandas_udf(_sequence_ratio, "double")(a, b)


def ratio_bound(a, b):
    """No less than ``sequence_ratio``: twice the shorter length over both."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / both)


#: Bits of a limb: sums of two limbs and a carry fit a long.
LIMB = 62
_FULL = (1 << LIMB) - 1


def place_masks(a):
    """For each character of a text the places where it stands, as bits of as many limbs as the text takes: map<string, array<bigint>>."""
    chars = F.split(a, "")
    limbs = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / LIMB).cast("int"))
    mask = lambda cs, ch, k: F.aggregate(F.transform(F.slice(cs, k * LIMB + 1, LIMB), lambda x, i: F.when(x == ch, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("bigint")), F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(x))
    made = F.transform(F.array(chars), lambda cs: F.map_from_entries(F.transform(F.array_distinct(cs), lambda ch: F.struct(ch, F.transform(limbs, lambda k: mask(cs, ch, k))))))[0]
    return F.when(F.length(a) > 0, made)


def common_length(masks, n, b):
    """Length of the longest common subsequence of a text of ``n`` characters, given by its ``place_masks``, and ``b``: one addition for each limb and character of ``b``."""
    full, zero = F.lit(_FULL).cast("bigint"), F.lit(0).cast("bigint")
    kept = lambda v, m: v.bitwiseAND(full.bitwiseXOR(m))

    def narrow(v, ch):
        m = F.coalesce(F.get(F.try_element_at(masks, ch), F.lit(0)), zero)
        return (v + v.bitwiseAND(m)).bitwiseAND(full).bitwiseOR(kept(v, m))

    def limb(acc, v, m):
        total = v + v.bitwiseAND(m) + acc["carry"]
        return F.struct(F.shiftright(total, LIMB).alias("carry"), F.concat(acc["out"], F.array(total.bitwiseAND(full).bitwiseOR(kept(v, m)))).alias("out"))

    def wide(vs, ch):
        pairs = F.arrays_zip(vs.alias("v"), F.try_element_at(masks, ch).alias("m"))
        start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.when(F.try_element_at(masks, ch).isNull(), vs).otherwise(F.aggregate(pairs, start, lambda acc, p: limb(acc, p["v"], p["m"]), lambda acc: acc["out"]))

    chars = F.split(b, "")
    gone = lambda v: LIMB - F.bit_count(v)
    one = F.aggregate(chars, full, narrow, gone)
    many = F.aggregate(chars, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / LIMB).cast("int")), lambda k: full), wide, lambda vs: F.aggregate(vs, F.lit(0), lambda t, v: t + gone(v)))
    return F.when((n == 0) | (F.length(b) == 0), 0).when(n <= LIMB, one).otherwise(many)


def _plain_sorted(t):
    """T3's text: words of letters and digits, lowered and sorted."""
    return token_sort(F.regexp_replace(t, r"[^\p{L}\p{N}_]", " "))


def _twice_share(common, n, m):
    """200 x common over both lengths as a whole number, halves to even; 0 if either is blank."""
    return F.when((n > 0) & (m > 0), F.bround(200.0 * common / (n + m))).otherwise(0.0)


def token_sort_ratio(a, b):
    """Words of letters and digits, lowered and sorted; 200 x common subsequence over both lengths, as a whole number; 0 if either is blank."""
    both = F.transform(F.array(F.struct(_plain_sorted(a).alias("a"), _plain_sorted(b).alias("b"))), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), place_masks(t["a"]).alias("m")))
    return F.transform(both, lambda t: _twice_share(common_length(t["m"], F.length(t["a"]), t["b"]), F.length(t["a"]), F.length(t["b"])))[0]


def token_sort_pairs(labels: DataFrame, terms: DataFrame, least: float, salts: int = 32) -> DataFrame:
    """labels(clean_label) with those of terms(term, concept) whose token-sort ratio is ``least`` or more, as ``confidence``; no such pair is lost.

    A common subsequence is no longer than the shorter text, so labels only meet terms of lengths that can reach ``least``: terms stand in
    lots by length. Nor is it longer than the characters in common, whatever their order; pairs short of that are not scored.
    """
    x = max(0.0, (least - 0.5) / 100)
    if x <= 0:
        raise ValueError("least must be above 0.5")
    bag = lambda t: F.transform(F.array(F.array_sort(F.split(t, ""))), lambda cs: F.transform(cs, lambda c, i: F.concat(c, (i - F.array_position(cs, c)).cast("string"))))[0]
    own = labels.select("clean_label", _plain_sorted(F.col("clean_label")).alias("_a")).where("_a <> ''").withColumns({"_n": F.length("_a"), "_m": place_masks(F.col("_a")), "_bag": bag(F.col("_a"))})
    other = terms.select("term", "concept", _plain_sorted(F.col("term")).alias("_b")).where("_b <> ''").withColumns({"_k": F.length("_b"), "_bag_b": bag(F.col("_b"))})
    n = other.count()
    lots = max(1, -(-n // SMALL_DIMENSION))
    lot = other.groupBy("_k", F.pmod(F.xxhash64("term", "concept"), F.lit(lots)).alias("_lot")).agg(F.collect_list(F.struct("term", "concept", "_b", "_bag_b")).alias("_ts"))
    low, high = F.ceil(F.col("_n") * (x / (2 - x)) - 1e-9).cast("int"), F.floor(F.col("_n") * ((2 - x) / x) + 1e-9).cast("int")
    each = own.withColumn("_k", F.explode(F.sequence(low, high)))
    if lots == 1:
        met = each.withColumn("_lot", F.lit(0).cast("bigint")).join(F.broadcast(lot), ["_k", "_lot"])  # SMALL_DIMENSION terms at most
    else:
        each = each.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lots - 1).cast("bigint")))).withColumn("_salt", F.pmod(F.xxhash64("clean_label"), F.lit(salts)).cast("int"))
        met = each.join(lot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["_k", "_lot", "_salt"])
    pairs = met.select("clean_label", "_n", "_m", "_bag", "_k", F.explode("_ts").alias("_t"))
    pairs = pairs.where(200.0 * F.size(F.array_intersect("_bag", F.col("_t._bag_b"))) >= 100 * x * (F.col("_n") + F.col("_k")) - 1e-6)
    scored = pairs.select("clean_label", "_t.term", "_t.concept", _twice_share(common_length(F.col("_m"), F.col("_n"), F.col("_t._b")), F.col("_n"), F.col("_k")).alias("confidence"))
    return scored.where(F.col("confidence") >= least)


SCORERS = {"edit": edit_ratio, "token_sort": token_sort_ratio, "token_sort_edit": lambda a, b: edit_ratio(token_sort(a), token_sort(b)), "contain": contain_score, "sequence": lambda a, b: 100 * sequence_ratio(a, b)}


def with_all(labels: DataFrame, terms: DataFrame, salts: int = 32) -> DataFrame:
    """Each of ``labels`` with each of ``terms``, which stand in arrays, so that no pair is shuffled.

    Up to SMALL_DIMENSION terms (counted) are one array, which is broadcast. More are dealt into lots of about as many; then labels and
    lots meet by an equi-join, labels spread over ``salts`` keys for each lot.
    """
    cols = terms.columns
    lots = max(1, -(-terms.count() // SMALL_DIMENSION))
    lot = terms.groupBy(F.pmod(F.xxhash64(*cols), F.lit(lots)).cast("int").alias("_lot")).agg(F.collect_list(F.struct(*cols)).alias("_ts"))
    if lots == 1:
        met = labels.withColumn("_lot", F.lit(0)).join(F.broadcast(lot), "_lot")
    else:
        each = labels.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).withColumn("_salt", F.pmod(F.xxhash64(*labels.columns), F.lit(salts)).cast("int"))
        met = each.join(lot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["_lot", "_salt"])
    return met.select(*labels.columns, F.explode("_ts").alias("_t")).select(*labels.columns, "_t.*")


def fuzzy(labels: DataFrame, terms: DataFrame, scorer: str = "token_sort", least: float = 80, block=None) -> DataFrame:
    """Best term at or above ``least`` for each distinct label; ties go to the smaller term.

    labels(label, clean_label), terms(term, concept). Each label meets all terms (see ``with_all``; for T3 those that bounds leave, see
    ``token_sort_pairs``), unless a blocking key is given: ``block`` maps a text column to an array of keys, and only pairs that share a key are scored.
    """
    score = SCORERS[scorer]
    distinct = labels.select("clean_label").distinct()
    if block is None and scorer == "token_sort" and least > 0.5:
        pairs = None
    elif block is None:
        pairs = with_all(distinct, terms.select("term", "concept").distinct())
    else:
        pairs = distinct.select("clean_label", F.explode(block(F.col("clean_label"))).alias("_b")).join(terms.select("term", "concept", F.explode(block(F.col("term"))).alias("_b")), "_b").drop("_b").distinct()
    if scorer == "sequence":
        pairs = pairs.where(100 * ratio_bound(F.col("clean_label"), F.col("term")) >= least)
    if pairs is None:
        scored = token_sort_pairs(distinct, terms.select("term", "concept").distinct(), least)
    else:
        scored = pairs.withColumn("confidence", score(F.col("clean_label"), F.col("term"))).where(F.col("confidence") >= least)
    best = scored.withColumn("_r", F.row_number().over(W.partitionBy("clean_label").orderBy(F.desc("confidence"), "term", "concept"))).where("_r = 1").select("clean_label", "term", "concept", "confidence")
    return labels.join(best, "clean_label", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("method", F.when(F.col("concept").isNotNull(), "fuzzy").otherwise("none"))


def cascade(labels: DataFrame, rules: DataFrame, terms: DataFrame, scorer: str = "token_sort", least: float = 80) -> DataFrame:
    """Exact, then fuzzy for the rest; one row for each label row."""
    first = exact(labels, rules)
    hit = first.where("concept IS NOT NULL")
    rest = first.where("concept IS NULL").select(*labels.columns)
    second = fuzzy(rest, terms, scorer, least).drop("term")
    out = hit.unionByName(second.select(*hit.columns))
    return out.withColumn("mapped", F.col("concept").isNotNull())


def strategies(labels: DataFrame, concepts: DataFrame, synonyms: DataFrame, least: float = 0.7, least_cosine: float = 0.6, stop=()) -> DataFrame:
    """Of equality (1.0; the last concept wins), synonym ratio and direct ratio (T5, strictly better, at least ``least``), all of texts
    cleaned by T2; labels that none of these finds go to the best TF-IDF cosine over concepts with their synonyms, at least ``least_cosine`` (ties: the smaller name).

    The idf is that of labels and concepts together, so words that no concept has lower a label's cosine. ``stop``: words it leaves out.
    """
    terms = concepts.select(F.col("concept").alias("term"), "concept", F.lit(1).alias("own")).unionByName(synonyms.select("term", "concept", F.lit(0).alias("own")))
    cleaned = labels.select("clean_label").where("clean_label <> ''").distinct().withColumn("_a", clean_phrase(F.col("clean_label")))
    pairs = with_all(cleaned, terms.distinct().withColumn("_b", clean_phrase(F.col("term"))))
    same = (F.col("own") == 1) & (F.col("_a") == F.col("_b"))
    s = pairs.where(ratio_bound(F.col("_a"), F.col("_b")) >= least).withColumn("confidence", F.when(same, 1.0).otherwise(sequence_ratio(F.col("_a"), F.col("_b")))).where(F.col("confidence") >= least)
    s = s.withColumn("method", F.when(same, "exact").when(F.col("own") == 1, "direct").otherwise("synonym"))
    best = s.groupBy("clean_label").agg(F.max_by(F.struct("concept", "confidence", "method"), F.struct("confidence", F.when(F.col("method") == "exact", 1).otherwise(0), -F.col("own"), "concept")).alias("b")).select("clean_label", "b.*")
    split = lambda df, key, text: df.select(key.alias("doc"), F.explode(tokens(text, stop)).alias("token"))
    docs = split(concepts.select("concept").distinct().unionByName(synonyms.select("concept", "term").distinct(), allowMissingColumns=True), F.col("concept"), F.coalesce("term", "concept"))
    own = labels.select("clean_label").where("clean_label <> ''").distinct()
    corpus = docs.select(F.concat(F.lit("c:"), "doc").alias("doc"), "token").unionByName(split(own, F.concat(F.lit("l:"), "clean_label"), F.col("clean_label")))
    rest = split(own.join(best, "clean_label", "left_anti"), F.col("clean_label"), F.col("clean_label")).withColumnRenamed("doc", "query")
    more = tfidf(docs, rest, least_cosine, corpus).select(F.col("query").alias("clean_label"), F.col("doc").alias("concept"), F.col("cosine").alias("confidence"), F.lit("tfidf").alias("method"))
    best = best.unionByName(more)
    return labels.join(best, "clean_label", "left").withColumn("method", F.coalesce("method", F.lit("none"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def tfidf(docs: DataFrame, queries: DataFrame, least: float = 0.0, corpus: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Best document by TF-IDF cosine for each query: docs(doc, token), queries(query, token), one row a token occurrence.

    Smooth idf: ln((1 + n) / (1 + df)) + 1 over ``docs``, or over ``corpus`` (doc, token), which then holds the words of ``docs`` too;
    words outside it do not count. Pairs meet on shared tokens only; a query that shares none gets no row. Queries are dealt over ``parts`` tasks, if given: a
    task holds its queries' pairs.
    """
    corpus = docs if corpus is None else corpus
    pairs = corpus.distinct()
    n = corpus.select("doc").distinct().agg(F.count("*").alias("n"))
    idf = pairs.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True)).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    small = pairs.limit(SMALL_POSTINGS + 1).count() <= SMALL_POSTINGS
    near = F.broadcast if small else lambda df: df

    def weigh(df, key, parts=None):
        if small:  # tokens that docs have are dealt by their text once, and all else is done there: no token is a task of its own
            tf = df.join(near(idf), "token").repartition(*([parts] if parts else []), key).groupBy(key, "token", "idf").agg(F.count("*").alias("tf"))
        else:
            tf = df.groupBy(key, "token").agg(F.count("*").alias("tf")).join(idf, "token")
        tf = tf.withColumn("w", F.col("tf") * F.col("idf"))
        return tf.select(key, "token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))).alias("w"))

    d, q = weigh(docs, "doc"), weigh(queries, "query", parts)
    dots = q.withColumnRenamed("w", "wq").join(near(d), "token").groupBy("query", "doc").agg(F.round(F.sum(F.col("w") * F.col("wq")), 6).alias("cosine"))
    return dots.where(F.col("cosine") >= least).groupBy("query").agg(F.min_by(F.struct("doc", "cosine"), F.struct(-F.col("cosine"), "doc")).alias("b")).select("query", "b.doc", "b.cosine")


def statistics(mapped: DataFrame) -> DataFrame:
    """Totals, rate, mean confidence of mapped labels, methods, confidence bands (confidence in 0 to 100)."""
    c, m = F.col("confidence"), F.col("concept").isNotNull()
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return mapped.agg(
        F.count("*").alias("n_labels"), n(m).alias("n_mapped"), (n(m) / F.greatest(F.count("*"), F.lit(1))).alias("mapping_rate"), F.avg(F.when(m, c)).alias("avg_confidence"),
        n(F.col("method") == "exact").alias("n_exact"), n(F.col("method") == "fuzzy").alias("n_fuzzy"), n(c >= 80).alias("n_high"), n((c >= 60) & (c < 80)).alias("n_medium"), n((c >= 30) & (c < 60)).alias("n_low"),
    )


def recommendations(stats: DataFrame) -> DataFrame:
    """A6's advice as an array."""
    tips = F.array(F.when(F.col("mapping_rate") < 0.5, "extend the label rules: under half of the labels map"), F.when(F.col("n_low") > F.col("n_high"), "review low-confidence matches"), F.when(F.col("n_fuzzy") > F.col("n_exact"), "add frequent fuzzy matches to the exact rules"))
    return stats.withColumn("recommendations", F.filter(tips, lambda x: x.isNotNull()))


def keyword_group(label, groups: list[tuple[str, str]], default: str = "Not Found"):
    """The first group whose pattern occurs in the label."""
    out = F.lit(default)
    for pattern, name in reversed(groups):
        out = F.when(F.lower(label).rlike(pattern), name).otherwise(out)
    return out


def upsert_rules(rules: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` replaces rules of the same label."""
    return rules.join(more.select("clean_label").distinct(), "clean_label", "left_anti").unionByName(more)


def pair_by_tokens(left: DataFrame, right: DataFrame, key: str = "name", order: str = "seq") -> DataFrame:
    """For each left name the first right name, by ``order`` and then by name, that shares a token; tokens split on '_', '-', '.' and blanks.

    No partner gives null; ``workflows.cross_verify`` holds such names against all files together.
    """
    def tokens(df):
        return df.select(F.col(key), F.col(order), F.explode(F.array_distinct(F.filter(F.split(F.lower(key), r"[_\-.\s]+"), lambda x: x != ""))).alias("token"))

    first = tokens(right).groupBy("token").agg(F.min(F.struct(F.col(order).alias("o"), F.col(key).alias("partner"))).alias("p"))
    hit = tokens(left).join(first, "token").groupBy(key, order).agg(F.min("p").alias("p")).select(key, order, F.col("p.partner").alias("partner"))
    return left.select(key, order).join(hit, [key, order], "left")


def pair_directories(short: DataFrame, full: DataFrame) -> DataFrame:
    """short(name) like prefix_year to the first full(name) that starts with the prefix and contains the year; null if none does.

    Full names meet short ones on their own leading parts, so the join is an equi-join.
    """
    parts = F.split("name", "_")
    s = short.where(F.size(parts) >= 2).select("name", parts[0].alias("_prefix"), F.element_at(parts, -1).alias("_year"))
    sizes = [r[0] for r in s.select(F.length("_prefix")).distinct().collect()]  # lengths of prefixes: a handful of numbers
    if not sizes:
        return short.select("name", F.lit(None).cast("string").alias("partner"))
    f = full.select(F.col("name").alias("partner"), F.explode(F.array_distinct(F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.substring(F.col("name"), F.lit(1), n)))).alias("_prefix"))
    hit = s.join(f, "_prefix").where(F.col("partner").contains(F.col("_year"))).groupBy("name").agg(F.min("partner").alias("partner"))
    return short.select("name").join(hit, "name", "left")
