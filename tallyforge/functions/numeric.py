"""Number parsing, comparison, change and spread: column expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

#: Scale factors tried in this order, and the keyword groups of alert thresholds.
SCALES = (("thousands", 1e3), ("millions", 1e6), ("billions", 1e9))
THRESHOLDS = (("success|rate|accuracy", 0.1), ("time|runtime|duration", 0.2), ("memory|usage", 0.3), ("quality|score", 0.15))
DEFAULT_THRESHOLD = 0.25


def _num(x):
    return x.try_cast("double")


def parse_plain(v):
    """Commas and currency signs go; parentheses are not read as a sign."""
    return _num(F.regexp_replace(v, "[,$]", ""))


def parse_signed(v):
    """P5: as P4, and an opening parenthesis reads as minus."""
    return _num(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[,$]", ""), r"\(", "-"), r"\)", ""))


def parse_accounting(v):
    """Blanks go too; negative only if all of the value stands in parentheses."""
    bare = F.regexp_replace(v, r"[,$\s()]", "")
    return _num(F.when(v.rlike(r"^\s*\(.*\)\s*$"), F.concat(F.lit("-"), bare)).otherwise(bare))


def parse_strict(v):
    """A number as it stands, else null."""
    return _num(v)


def parse_large(v, least: float = 100):
    """P5, kept only above ``least`` in size."""
    x = parse_signed(v)
    return F.when(F.abs(x) > least, x)


def safe_div(a, b):
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def relative_change(current, baseline):
    """M4: (c - b) / b; a zero baseline gives 1 if anything came, else 0."""
    return F.when(baseline == 0, F.when(current != 0, 1.0).otherwise(0.0)).otherwise((current - baseline) / baseline)


def percentage_difference(value, truth):
    """|value - truth| in percent of |truth|; infinite if the truth is 0."""
    return F.when(truth == 0, F.lit(math.inf)).otherwise(F.abs(value - truth) / F.abs(truth) * 100)


def within_tolerance(value, truth, absolute=0.01, percent=0.1, relative=1e-6):
    """M1: any of three tolerances."""
    d = F.abs(value - truth)
    size = F.greatest(F.abs(value), F.abs(truth))
    return (d <= absolute) | (percentage_difference(value, truth) <= percent) | F.coalesce(safe_div(d, size) <= relative, F.lit(False))


def scale_match(value, truth, scales=SCALES, absolute=0.01):
    """M2: struct(factor, direction) of the first scale that makes the two equal, else null."""
    hits = []
    for _, k in scales:
        hits.append(F.when(F.abs(value * k - truth) <= absolute, F.struct(F.lit(k).alias("factor"), F.lit("pdf_to_xbrl").alias("direction"))))
        hits.append(F.when(F.abs(value - truth * k) <= absolute, F.struct(F.lit(1 / k).alias("factor"), F.lit("xbrl_to_pdf").alias("direction"))))
    return F.coalesce(*hits)


def metric_threshold(name):
    """M5: the alert threshold by words in a metric's name."""
    out = F.lit(DEFAULT_THRESHOLD)
    for words, limit in reversed(THRESHOLDS):
        out = F.when(F.lower(name).rlike(words), limit).otherwise(out)
    return out


def alert_severity(change, threshold):
    """M6: warning above the threshold, critical above twice of it; null below."""
    return F.when(F.abs(change) > 2 * threshold, "critical").when(F.abs(change) > threshold, "warning")


def size_text(n):
    """Bytes as text, B to TB, one decimal."""
    out = F.format_string("%.1f TB", n / float(1 << 40))
    for unit, k in (("GB", 30), ("MB", 20), ("KB", 10), ("B", 0)):
        out = F.when(n < (1 << (k + 10)), F.format_string(f"%.1f {unit}", n / float(1 << k))).otherwise(out)
    return out
