"""Personal data: labelers vote on candidate spans, EM estimates their reliabilities, a span classifier decides.

Natively in SQL functions. Base kinds (email, ip, card, phone) are fixed patterns with validators. Weak kinds (spelled-out email
addresses, national phone numbers, social-security-like numbers) are candidates only. On every candidate, base or
weak, five labelers vote 1, 0 or -1: a validator, a gazetteer, the words before it, its neighbours, its length. A weak candidate that
overlaps a base span is no candidate, so nothing is counted twice. Votes are
counted by pattern of votes (at most 3**5 for a kind, however large the corpus); EM with a hidden yes or no runs over that table as
a fold inside one SQL expression. The posteriors are soft labels of a naive Bayes span classifier over votes,
kind, length and neighbours, fitted by aggregation; weak candidates it accepts are added to the base spans. Most base candidates are real, so
their share says nothing of a weak one: weak ones start from even odds, and one without any evidence is not accepted.

Defined results: null text is as empty text. Without any candidate there is no model and there are no spans. Every row gives one row; equal
texts give equal spans, whatever their ids. Spans that start together are ordered by kind. Texts may be long: a match sees the text between it
and the match before it, so no search starts over. Columns of any name may stand beside the text; they are packed away.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .common import find_spans, materialize, span_list

# The base kinds. \G lets a match start where the one before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The method's weak kinds.
EMAIL_WORDS = r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}"
PHONE_LOCAL = r"(?<![0-9+.-])(?<!\) )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KINDS = ("email", "ip", "card", "phone", "email_words", "phone_local", "social")
BASE = 4
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
DOUBLED = "array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)"

#: Gazetteers by kind, as patterns over the candidate.
GAZETTEER = {
    "email": r"(?i)[.](?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us)$",
    "ip": r"^(?!0[.]|127[.]|255[.]|22[4-9][.]|23[0-9][.])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30)",
    "phone": r"^[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "email_words": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us)$",
    "phone_local": r"^[(]?[2-9][0-8][0-9][)]?[ .-](?!555)",  # second digit 9 is reserved, exchange 555 is for films
    "social": r"^(?!123-45-6789|078-05-1120|219-09-9999|987-65-43)(?!([0-9])\1\1-\1\1-)",
}
#: Words that speak for a kind when they stand shortly before it.
CONTEXT = {
    "email": r"(?i)mail|contact|write|address|correo|adresse",
    "ip": r"(?i)\bip\b|host|server|address|client|login",
    "card": r"(?i)card|visa|credit|debit|amex|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile|fax|whatsapp|anruf",
    "email_words": r"(?i)mail|contact|write|address|correo|adresse",
    "phone_local": r"(?i)phone|call|tel|mobile|fax|whatsapp|anruf",
    "social": r"(?i)ssn|social|security|insurance",
}
#: What a weak candidate must look like: host labels and top-level names, numbering plan, issued ranges.
WEAK_VALID = {
    "email_words": r"(?i)^[a-z0-9][a-z0-9._%+-]*+ ?[\[(]?at[\])]? ?[a-z0-9](?:[a-z0-9-]*[a-z0-9])? ?[\[(]?dot[\])]? ?(?:[a-z]{2}|com|org|net|edu|gov|info|mail|name|tech|online)$",
    "phone_local": r"^[(]?[2-9](?!11)[0-9]{2}[)]?[ .-][2-9](?!11)[0-9]{2}[ .-]",
    "social": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
LENGTH = {"email": (8, 60), "ip": (7, 15), "card": (13, 23), "phone": (10, 22), "email_words": (10, 60), "phone_local": (12, 14), "social": (11, 11)}
N_VOTES = 5


def valid(kind: str, m):
    """The validator of a kind, over the matched text."""
    digits = F.translate(m, " -().+", "")
    if kind == "ip":
        return m.rlike("^" + r"\.".join([PART] * 4) + "$")
    if kind == "card":
        return (F.length(digits) >= 12) & (F.length(digits) <= 19) & luhn(digits)
    if kind == "phone":
        return (F.length(digits) >= 9) & (F.length(digits) <= 15)
    return m.rlike(WEAK_VALID[kind]) if kind in WEAK_VALID else F.lit(True)


def luhn(digits):
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.element_at(F.expr(DOUBLED), F.try_to_number(c, F.lit("9")).cast("int") + 1)).otherwise(F.try_to_number(c, F.lit("9")).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_row, _c): the input's columns as a struct, and an array of (start, rank, end, kind, ok, votes, size, before) of all candidates, base and weak."""
    # the input's columns are packed, so that none of them meets a helper column's name
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    t = F.col("_t")
    gates = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9]"), "phone": t.rlike(r"\+[0-9]"), "email_words": t.rlike(r"\[at\]|\(at\)| at "), "phone_local": t.rlike(r"[0-9]{3}[ .-][0-9]{4}"), "social": t.rlike(r"[0-9]-[0-9]{2}-[0-9]")}
    patterns = (EMAIL, IP, CARD, PHONE, EMAIL_WORDS, PHONE_LOCAL, SOCIAL)
    for kind, pattern in zip(KINDS, patterns):
        df = find_spans(df, "_t", pattern, f"_{kind}", gates[kind], 40)
    found = []
    for rank, kind in enumerate(KINDS):
        column = F.col(f"_{kind}")
        if kind == "card":  # most digit runs are too short to be anything; they are no candidates
            column = F.filter(column, lambda x: (F.length(F.translate(x["m"], " -", "")) >= 12) & (F.length(F.translate(x["m"], " -", "")) <= 19))
        found.append(F.transform(column, _describe(kind, rank)))
    df = df.select("_row", F.concat(*found[:BASE]).alias("_base"), F.concat(*found[BASE:]).alias("_weak"))
    apart = F.filter("_weak", lambda x: ~F.exists("_base", lambda b: b["ok"] & (b["start"] < x["end"]) & (b["end"] > x["start"])))
    return df.select("_row", F.concat("_base", apart).alias("_c"))


def _describe(kind: str, rank: int):
    """What is recorded of a match of ``kind``."""
    low, high = LENGTH[kind]

    def describe(x):
        m, ahead, after = x["m"], x["ahead"], x["after"]
        prev = F.right(ahead, F.lit(1))
        ok = valid(kind, m)
        vote = lambda yes: F.when(yes, F.lit(1)).otherwise(F.lit(-1))
        votes = F.array(
            vote(ok),
            vote(m.rlike(GAZETTEER[kind])),
            F.when(ahead.rlike(CONTEXT[kind]), 1).otherwise(0),
            F.when(prev.rlike(r"[A-Za-z0-9_.\-/]") | after.rlike(r"[A-Za-z0-9_\-/]"), -1).otherwise(1),
            vote((F.length(m) >= low) & (F.length(m) <= high)),
        )
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), ok.alias("ok"), votes.alias("votes"), F.least(F.floor(F.length(m) / 4), F.lit(8)).cast("int").alias("size"), F.when(prev == "", 0).when(prev.rlike(r"\s"), 1).when(prev.rlike("[A-Za-z0-9]"), 2).otherwise(3).alias("before"))

    return describe


def _em_sql(rounds: int = 25) -> str:
    """A fold over rounds: ``pats`` (votes, n) to (prior, yes, no): the chance of each vote of each labeler, given yes or no."""
    k = N_VOTES * 3
    start = lambda up: "array(" + ", ".join(f"{v}D" for _ in range(N_VOTES) for v in ((0.15, 0.25, 0.6) if up else (0.5, 0.3, 0.2))) + ")"
    odds = f"aggregate(sequence(0, {N_VOTES - 1}), ln(th.prior) - ln(1 - th.prior), (z, j) -> z + ln(th.yes[3 * j + p.votes[j] + 1]) - ln(th.no[3 * j + p.votes[j] + 1]))"
    e_step = f"transform(pats, p -> named_struct('votes', p.votes, 'n', p.n, 'q', 1 / (1 + exp(-greatest(-30D, least(30D, {odds}))))))"
    total = lambda w: f"aggregate(e, 0D, (z, p) -> z + p.n * {w})"
    part = lambda w: f"transform(sequence(0, {k - 1}), i -> (1 + aggregate(e, 0D, (z, p) -> z + if(p.votes[cast(i div 3 as int)] = i % 3 - 1, p.n * {w}, 0D))) / (3 + {total(w)}))"
    m_step = f"transform(array({e_step}), e -> named_struct('prior', greatest(0.01D, least(0.99D, (1 + {total('p.q')}) / (2 + aggregate(e, 0D, (z, p) -> z + p.n)))), 'yes', {part('p.q')}, 'no', {part('(1 - p.q)')}))[0]"
    return f"aggregate(sequence(1, {rounds}), named_struct('prior', 0.5D, 'yes', {start(True)}, 'no', {start(False)}), (th, it) -> {m_step})"


def features(c) -> F.Column:
    """The classifier's features of a candidate, as strings; the number of their values is fixed."""
    s = lambda x: x.cast("string")
    return F.array(
        *[F.concat(F.lit(f"v{j}="), s(c["votes"][j])) for j in range(N_VOTES)],
        F.concat(F.lit("kind="), c["kind"]), F.concat(F.lit("size="), c["kind"], F.lit("/"), s(c["size"])), F.concat(F.lit("before="), s(c["before"])),
    )


def fit(docs: DataFrame, text_col: str = "text", rounds: int = 25) -> dict[str, float]:
    """Log odds by feature value (a few hundred at most), learned from all documents; empty without candidates."""
    return fit_candidates(candidates(docs.select(text_col), text_col), rounds)


def fit_candidates(found: DataFrame, rounds: int = 25) -> dict[str, float]:
    """``fit`` from what ``candidates`` gives."""
    c = found.where(F.size("_c") > 0).select(F.explode("_c").alias("c"))
    groups = c.groupBy("c.kind", "c.votes", "c.size", "c.before").agg(F.count("*").cast("double").alias("n"))
    groups = materialize(groups, "pii-votes")
    by_votes = groups.groupBy("votes").agg(F.sum("n").alias("n"))
    theta = by_votes.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("pats")).where("size(pats) > 0").select(F.expr(_em_sql(rounds)).alias("th"))
    learned = theta.first()  # one row of 31 numbers
    if learned is None:
        return {}
    th = learned["th"]
    terms = [F.element_at(F.array(*[F.lit(math.log(th["yes"][3 * j + v] / th["no"][3 * j + v])) for v in range(3)]), F.col("votes")[j] + 2) for j in range(N_VOTES)]
    q = 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(math.log(th["prior"] / (1 - th["prior"]))))))
    soft = groups.select(F.explode(features({x: F.col(x) for x in ("votes", "kind", "size", "before")})).alias("f"), (F.col("n") * q).alias("yes"), (F.col("n") * (1 - q)).alias("no"))
    table = soft.groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    yes, no = (sum(r[x] for r in table if r["f"].startswith("kind=")) for x in ("yes", "no"))
    return {r["f"]: math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2)) for r in table}


def judged(found: DataFrame, model: dict[str, float], out: str = "pii_spans") -> DataFrame:
    """``found`` (with _c of ``candidates``) with ``out``: sorted array of (start, rank, end, kind); ranks from 4 mark the method's own spans."""
    plain = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))
    chosen = lambda x: (x["rank"] < BASE) & x["ok"]
    if model:
        weights = F.create_map(*[F.lit(x) for kv in model.items() for x in kv])
        odds = lambda x: F.aggregate(features(x), F.lit(0.0), lambda z, f: z + F.coalesce(F.try_element_at(weights, f), F.lit(0.0)))
        chosen = lambda x: F.when(x["rank"] < BASE, x["ok"]).otherwise(x["ok"] & (odds(x) > 0))
    return found.withColumn(out, F.array_sort(F.transform(F.filter("_c", chosen), plain)))


def scan(docs: DataFrame, model: dict[str, float], text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with ``out``: sorted array of (start, rank, end, kind); ranks from 4 mark the method's own spans."""
    df = judged(candidates(docs, text_col), model, "_spans")
    return df.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != out], F.col("_spans").alias(out))


def report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_candidates, n_added, has_private), one row for each row of ``docs``.

    Texts are searched once: candidates are written to the scratch folder, and model and spans come from there.
    """
    found = candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").select("_row.doc_id", "_c")
    found = materialize(found, "pii-candidates")
    df = judged(found, fit_candidates(found))
    count = lambda k: F.size(F.filter("pii_spans", lambda x: x["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return df.select(
        "doc_id", *map(count, KINDS[:BASE]), F.sha2(span_list(F.filter("pii_spans", lambda x: x["rank"] < BASE)), 256).alias("base_sha256"), span_list(F.col("pii_spans")).alias("spans"),
        F.size("_c").cast("long").alias("n_candidates"), F.size(F.filter("pii_spans", lambda x: x["rank"] >= BASE)).cast("long").alias("n_added"), (F.size("pii_spans") > 0).alias("has_private"),
    )
