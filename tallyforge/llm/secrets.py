"""Secret scans: pattern spans plus sliding-window Shannon entropy per character class, natively in SQL functions.

Base kinds are fixed patterns (assign, access, hex). The method adds kind ``entropy``: candidate tokens are classed
by the characters they use (hex, alnum of one case, mixed); a window slides over each, the counts of the
entering and the leaving character are updated, and with them the sum of c*log2(c), so that no
window is counted anew (the fold's array of counters, one for each character of the alphabet, is rebuilt at each step). A candidate is a secret if some window's entropy reaches its class's limit and the window holds
no run, sequence or placeholder word; a candidate without a digit must reach HIGH bits more. Allow-list patterns fit
whole candidates only. A candidate that lies inside a base span adds nothing.

Defined results: null text is as empty text: no spans, and the hash of the empty string. Every row gives one row; equal texts give
equal spans. Spans that start together are ordered by kind. A very long token is measured in parts that overlap by a window less one
character, so each window is seen once and none is lost. Columns of any name may stand beside the text; they are packed away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .common import find_spans, span_list

# The base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="
#: Class: what its tokens look like, and the entropy in bits that a window must reach.
CLASSES = {"hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9), "alnum": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.4), "mixed": (r"", 3.7)}
#: Bits above its class's limit that a candidate without a digit must reach: words written together stay below.
HIGH = 0.2
#: Windows of a token that one fold measures.
PART = 1000
#: Candidates that look random but are public, as a whole: identifiers, paths, numbers.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:[A-Za-z]++[/_-])++[A-Za-z]*+[0-9]{0,4}$",
    r"^[0-9+/_=-]+$",
)
#: What makes a single window public: placeholders, runs, sequences.
ALLOW_WINDOW = r"(?i:example|sample|placeholder|changeme|lorem|dummy)|(.)\1{5,}|(?i:0123456789|abcdefghij|qwertyuiop)"


def window_entropy_sql(token: str, width: int, least: str | None = None) -> str:
    """SQL for the largest Shannon entropy (bits) of any window of ``width`` characters of ``token``; 0 if shorter.

    With ``least``, SQL for a limit: the entropy of the first window that reaches it and that ALLOW_WINDOW does not excuse, else 0.
    """
    n = len(ALPHABET)
    term = "array(0D, 0D, " + ", ".join(f"{c} * log2({c})" for c in range(2, width + 1)) + ")"  # c*log2(c), at c+1
    new, old = "codes[i - 1]", f"if(i > {width}, codes[i - {width} - 1], 0)"
    left = "if(x.old > 0, a.cnt[x.old - 1], 0)"
    held = "(a.cnt[x.new - 1] - if(x.new = x.old, 1, 0))"
    total = f"(a.s - {term}[{left}] + {term}[greatest({left} - 1, 0)] - {term}[{held}] + {term}[{held} + 1])"
    here = f"log2({width}) - {total} / {width}"
    best = f"greatest(a.best, if(x.i >= {width}, {here}, 0D))"
    if least:
        best = f"if(a.best = 0D AND x.i >= {width} AND {here} >= {least} AND NOT substring({token}, x.i - {width - 1}, {width}) rlike r'{ALLOW_WINDOW}', {here}, a.best)"
    step = f"""named_struct(
        's', {total},
        'best', {best},
        'cnt', transform(a.cnt, (c, j) -> c + if(j + 1 = x.new, 1, 0) - if(j + 1 = x.old, 1, 0)))"""
    return f"""aggregate(
        transform(array(transform(split({token}, ''), ch -> locate(ch, '{ALPHABET}'))), codes ->
            transform(sequence(1, size(codes)), i -> named_struct('i', i, 'new', {new}, 'old', {old})))[0],
        named_struct('s', 0D, 'best', 0D, 'cnt', array_repeat(0, {n})),
        (a, x) -> {step},
        a -> a.best)"""


def _kind(spans: F.Column, kind: str) -> F.Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, text_col: str = "text", width: int = 20, out: str = "secret_spans", candidates: str | None = None) -> DataFrame:
    """``docs`` with ``out``: array of (start, rank, end, kind), sorted; rank 3 marks the method's own spans.

    ``candidates``: a column for the number of tokens whose windows were measured.
    """
    # the input's columns are packed, so that none of them meets a helper column's name
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    df = find_spans(df, "_t", ASSIGN, "_assign", F.col("_t").rlike("(?i:passw|secret|token|api_?key)"))
    df = df.withColumn("_assign", F.filter("_assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12))
    df = find_spans(df, "_t", ACCESS, "_access", F.col("_t").contains("AKIA"))
    df = df.withColumn("_access", F.filter("_access", lambda x: F.length(x["m"]) >= 18))
    df = find_spans(df, "_t", HEX, "_hex")
    df = find_spans(df, "_t", CANDIDATE, "_cand")
    public = lambda m: reduce(lambda a, b: a | b, (m.rlike(p) for p in ALLOW))
    df = df.withColumn("_base", F.concat(_kind(F.col("_assign"), "assign"), _kind(F.col("_access"), "access"), _kind(F.col("_hex"), "hex")))
    df = df.withColumn("_cand", F.filter("_cand", lambda x: ~public(x["m"]) & ~F.exists("_base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))))
    limit = "case " + " ".join(f"when cand.m rlike '{p}' then {v}" for p, v in CLASSES.values() if p) + f" else {CLASSES['mixed'][1]} end + if(cand.m rlike '[0-9]', 0, {HIGH})"
    df = df.withColumn("_cand", F.expr(f"transform(_cand, cand -> named_struct('start', cand.start, 'end', cand.end, 'm', cand.m, 'limit', cast({limit} as double)))"))
    parts = f"transform(sequence(0, greatest(length(cand.m) - {width}, 0) div {PART}), c -> substring(cand.m, c * {PART} + 1, {PART + width - 1}))"
    df = df.withColumn("_high", F.expr(f"filter(_cand, cand -> exists({parts}, part -> {window_entropy_sql('part', width, 'cand.limit')} > 0))"))
    df = df.withColumn(out, F.array_sort(F.concat("_base", _kind(F.col("_high"), "entropy"))))
    counted = [F.size("_cand").cast("long").alias(candidates)] if candidates else []
    return df.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in (out, candidates)], out, *counted)


def digest(spans: F.Column) -> F.Column:
    return F.sha2(span_list(spans), 256)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret span replaced by ``mark``; overlapping spans are replaced once, null text stays null."""
    df = scan(docs, text_col, out="_tallyforge_spans")
    merged = F.aggregate(
        F.col("_tallyforge_spans"),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(
            F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        ),
    )
    df = df.withColumn("_tallyforge_m", F.when(F.size("_tallyforge_spans") > 0, merged))
    # what stands between spans comes from parts of the text, as each substring of a long text would be counted off from its start
    part, size = 4096, "size(_tallyforge_m)"
    low, high = "if(i = 0, 0L, _tallyforge_m[i - 1].end)", f"if(i = {size}, cast(length({text_col}) as bigint), _tallyforge_m[i].start)"
    piece = f"transform(array(named_struct('a', {low}, 'b', {high})), g -> if(g.b > g.a, substring(array_join(slice(ps, cast(g.a div {part} as int) + 1, cast((g.b - 1) div {part} - g.a div {part} as int) + 1), ''), cast(g.a % {part} as int) + 1, cast(g.b - g.a as int)), ''))[0]"
    parts = f"transform(sequence(0, greatest(length({text_col}) - 1, 0) div {part}), c -> substring({text_col}, c * {part} + 1, {part}))"
    cut = F.expr(f"transform(array({parts}), ps -> array_join(transform(sequence(0, {size}), i -> concat({piece}, if(i < {size}, '{mark}', ''))), ''))[0]")
    df = df.withColumn(text_col, F.when(F.col("_tallyforge_m").isNotNull(), cut).otherwise(F.col(text_col)))
    if n_chars_col in docs.columns:
        df = df.withColumn(n_chars_col, F.when(F.col("_tallyforge_m").isNotNull(), F.length(text_col).cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(n_chars_col)))
    return df.select(*docs.columns)
