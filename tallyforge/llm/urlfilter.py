"""URL filters: host and path rules, then a weighted vocabulary matched by an Aho-Corasick automaton.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins. Without a
rule, vocabulary terms are counted in the lower-cased url at word boundaries (no letter or digit on either side):
one strict term blocks, and so do at least ``soft_least`` distinct soft terms with a total weight of at least ``soft_limit``.

Defined results: null url, or one without ``://``, has empty host and path, no rule; its text is still searched, and a null url is allowed.
Of rules that fit equally long the first given wins. Every row gives one row, repeated rows too; equal urls give equal verdicts. An url may be as
long as it likes: one pass finds all terms. An empty table gives no rows. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The rules, as (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Terms that reject alone.
STRICT = tuple("""
adult bdsm bestiality blowjob camgirl camgirls casino casinos cialis cocaine crackz cumshot darknet escort escorts fetish gangbang hardcore hentai
keygen keygens levitra malware milf nude nudes onlyfans orgy phishing porn porno pornography ransomware rapidgator sexcam sexcams sextape shemale spam
spyware steroids stripper swingers torrentz trojan upskirt viagra voyeur warez webcamsex xanax xrated xxx
""".split())
#: Terms that reject together, by weight.
SOFT = {w: n for n, words in enumerate((  # weights 1 and 2
"""
ads best bid buy cash cheap claim click cost deal deals discount earn easy fast free gift instant join limited loan money now offer offers online order
popup prize rich safe sale save shop special tips trial try win winner
""", """
affiliate backlink bets bet betting bingo bitcoin bonus botox clickbait coupon coupons credit crypto debt detox diet farm forex freebie giveaway
gamble hack hacks jackpot keto leads lottery mortgage nutra payday pharmacy pills poker promo proxy replica roulette seo singles slots sweepstakes
tracker track tracking voucher wager watches weightloss
"""), 1) for w in words.split()}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return host.translate(lower), rest[: min(ends)] if ends else rest


def find_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    fits = [(v, r) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=lambda x: len(x[1]), default=None)


class Vocabulary:
    """Aho-Corasick over strict and soft terms."""

    def __init__(self, strict=STRICT, soft=None, soft_limit: int = 3, soft_least: int = 2):
        import ahocorasick

        self.limit, self.least, self.auto = soft_limit, soft_least, ahocorasick.Automaton()
        for w, n in {**(SOFT if soft is None else soft), **dict.fromkeys(strict, 0)}.items():
            self.auto.add_word(w, (w, n))
        self.auto.make_automaton()

    def score(self, url: str | None) -> tuple[int, int, int]:
        """Distinct strict terms, distinct soft terms, weight of these."""
        u = (url or "").lower()
        hit = set()
        for end, (w, n) in self.auto.iter(u):
            at = end - len(w)
            if not (at >= 0 and u[at].isascii() and u[at].isalnum()) and not (end + 1 < len(u) and u[end + 1].isascii() and u[end + 1].isalnum()):
                hit.add((w, n))
        strict = sum(n == 0 for _, n in hit)
        return strict, len(hit) - strict, sum(n for _, n in hit)

    def blocks(self, strict: int, soft: int, weight: int) -> bool:
        return strict > 0 or (soft >= self.least and weight >= self.limit)


#: A vocabulary read from a table has this many terms at most; more raise.
MOST_TERMS = 100_000


def read_terms(table: DataFrame) -> tuple[list[str], dict[str, int]]:
    """(strict, soft) of a table (term, weight): a null weight is strict, and of equal terms strict or the larger weight counts."""
    rows = table.where("term IS NOT NULL AND term <> ''").groupBy(F.lower("term").alias("term")).agg(F.max(F.col("weight").isNull()).alias("strict"), F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return [r["term"] for r in rows if r["strict"]], {r["term"]: int(r["weight"]) for r in rows if not r["strict"]}


def judge(pages: DataFrame, id_col="page_id", url_col="url", rules=RULES, strict=STRICT, soft=None, soft_limit: int = 3, soft_least: int = 2, terms: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight), one row for each row of ``pages``.

    ``terms`` (term, weight): a vocabulary in place of ``strict`` and ``soft``.
    """
    if terms is not None:
        strict, soft = read_terms(terms)

    def run(batches):
        vocabulary = Vocabulary(strict, soft, soft_limit, soft_least)
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                rule, hits = find_rule(host, path, rules), vocabulary.score(url)
                rows.append((host, path, rule and rule[1], rule[0] if rule else "block" if vocabulary.blocks(*hits) else "allow", *hits))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in cols[:4]], *[pa.array(c, pa.int64()) for c in cols[4:]]], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits bigint, soft_hits bigint, soft_weight bigint")


def oracle_sql() -> str:
    """The same over DuckDB's ``pages``: each term between characters that are no letter and no digit."""
    rule = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'" for v, r in sorted(RULES, key=lambda x: -len(x[1])) for h, _, p in [r.partition("/")])
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)
    terms = ", ".join(f"('{w}', {n})" for w, n in [*((w, 0) for w in STRICT), *SOFT.items()])
    return rf"""
    WITH a AS (SELECT row_number() OVER () AS r, page_id, url, lower(coalesce(url, '')) AS u, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
    b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h0 FROM a),
    c AS (SELECT r, page_id, u, lower(h0) AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM b),
    d AS (SELECT *, CASE {rule} END AS rule FROM c),
    t AS (SELECT * FROM (VALUES {terms}) AS v(term, weight)),
    w AS (SELECT DISTINCT r, unnest(string_split_regex(u, '[^a-z0-9]+')) AS term FROM c),
    h AS (SELECT r, count(*) FILTER (weight = 0) AS strict_hits, count(*) FILTER (weight > 0) AS soft_hits, sum(weight)::BIGINT AS soft_weight FROM w JOIN t USING (term) GROUP BY r)
    SELECT page_id, host, path, rule, CASE {verdict} WHEN strict_hits > 0 OR (soft_hits >= 2 AND soft_weight >= 3) THEN 'block' ELSE 'allow' END AS verdict,
      coalesce(strict_hits, 0)::BIGINT AS strict_hits, coalesce(soft_hits, 0)::BIGINT AS soft_hits, coalesce(soft_weight, 0)::BIGINT AS soft_weight FROM d LEFT JOIN h USING (r)"""
