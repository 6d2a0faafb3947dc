"""Quality rules: a bitmask ledger. Every rule is evaluated once; failures are bits, measurements are kept beside them.

Policies are versioned masks over the ledger: a document is kept if no bit of the policy is set. Ablations (what each rule removes,
alone and in all) are bitwise aggregations over the ledger, without reading texts again.

Defined results: null text is as empty text: all measurements are 0, and it has few words. Every row gives one row, repeated rows and ids too; equal
texts give equal rows. Limits are strict: a document that just reaches one does not fail it. Texts are measured whole, however long. An
empty table gives no rows, and its ablation none. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rules by bit: name and the condition of failing, over the measurements.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("shouting", "2 * n_upper > word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the bits that remove a document.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": BIT["few_words"] | BIT["repeated_windows"] | BIT["many_symbols"] | BIT["repeated_lines"] | BIT["word_length"] | BIT["shouting"],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
SYMBOLS = b"[#*$%&|<>]"[1:-1]
_UPPER = bytes(range(65, 91))
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.uint64, len(words))
    if len(seen) == len(words):
        return 0
    x = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h += x[j : j + n] * _MULTIPLIERS[j]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    view = np.lib.stride_tricks.sliding_window_view(ids, window)
    pairs = np.flatnonzero(same)
    if not all((view[order[pairs[i : i + 65536]]] == view[order[pairs[i : i + 65536] + 1]]).all() for i in range(0, len(pairs), 65536)):
        _, inverse, counts = np.unique(view, axis=0, return_inverse=True, return_counts=True)  # hashes met by chance: compare windows themselves
        twice = counts[inverse.ravel()] > 1
    else:
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text or "") - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper


def ledger(docs: DataFrame, id_col="doc_id", text_col="text", rules=RULES) -> DataFrame:
    """(doc_id, measurements, fails): one row a document; bit i of ``fails`` is set if rule i fails."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols = list(zip(*map(measure, b.column(1).to_pylist()))) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", *MEASURES])

    measured = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return measured.withColumn("fails", F.expr(" + ".join(f"if({cond}, {1 << i}L, 0L)" for i, (_, cond) in enumerate(rules))))


def apply_policy(kept: DataFrame, policy: str = "v1", out: str = "kept") -> DataFrame:
    return kept.withColumn(out, F.col("fails").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(found: DataFrame, policy: str = "v1", rules=RULES) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept without it."""
    mask = POLICIES[policy]
    by_bits = found.groupBy(F.col("fails").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (n, _) in enumerate(rules) if mask >> i & 1])
    each = by_bits.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.expr("~bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def oracle_sql() -> str:
    """The query's rows over DuckDB's ``documents``."""
    fails = " OR ".join(f"({c})" for _, c in RULES)
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, (_, c) in enumerate(RULES))
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, len(list_filter(string_split_regex(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS n_words, list_filter(string_split_regex(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws,
        length(regexp_replace(t, '[ \t\n\x0b\f\r]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS ls, doc_id FROM d),
    p AS (SELECT r, unnest(range(1, n_words - 6)) AS i, ws FROM w WHERE n_words >= 8),
    k AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM p),
    b AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM k) WHERE c > 1),
    c AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM b, (SELECT unnest(range(8)) AS j) GROUP BY r),
    m AS (SELECT w.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_upper, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, NOT ({fails}) AS kept, ({bits})::BIGINT AS fails FROM m"""
