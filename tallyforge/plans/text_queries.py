"""Queries over texts, labels and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import mapping, quality, records
from .common import parts, r6, registrar, table

QUERIES: dict = {}
ORACLES: dict = {}
register = registrar(QUERIES, ORACLES)

# Lexicons of the driver's invented prose.
LEXICON = ("the", "and", "with")
HEADINGS = ("LICENSE", "RELEASED")
MONEY = ("$", "%", "PASSWORD")
STRUCTURES = ("TOKEN", "COPYRIGHT")

_WORDS = r"len(list_filter(string_split_regex(coalesce({0}, ''), '\s+'), lambda x: x <> ''))"
_W = _WORDS.format("text")
_T = f"trim(text, '{tx.WHITE}')"
_BODY = "greatest(length(text), 1)"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


@register(rf"""
WITH d AS (SELECT *, list_transform(list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, '\S')), lambda s: {_WORDS.format('s')}) AS ss FROM documents)
SELECT doc_id, length(text)::BIGINT AS char_count, {_W}::BIGINT AS word_count, len(string_split(text, chr(10)))::BIGINT AS line_count,
  round({_W}::DOUBLE / greatest(len(string_split(text, chr(10))), 1), 6) AS avg_words_per_line,
  round({_n('[0-9]')}::DOUBLE / {_BODY}, 6) AS numeric_ratio, round({_n(r'[^\p{{L}}\p{{N}}_\s]'.replace('{{', '{').replace('}}', '}'))}::DOUBLE / {_BODY}, 6) AS special_char_ratio, round({_n('[A-Z]')}::DOUBLE / {_BODY}, 6) AS uppercase_ratio,
  len(regexp_extract_all(lower(text), '\b(the|and|with)\b'))::BIGINT AS financial_keywords,
  {_n(r'\$[0-9,]+(?:\.[0-9]{2})?')}::BIGINT AS currency_patterns, {_n(r'[0-9]+(?:\.[0-9]+)?%')}::BIGINT AS percentage_patterns,
  len(ss)::BIGINT AS sentence_count, round(coalesce(list_avg(ss), 0), 6) AS avg_sentence_length, round(coalesce(list_stddev_pop(ss), 0), 6) AS sentence_length_std,
  round({_W}::DOUBLE / {_BODY}, 6) AS content_density FROM d
""")
def text_profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({f"_{k}": c for k, c in tx.profile_folds(F.col("text")).items()})
    p = tx.profile(F.col("text"), LEXICON, {k: F.col(f"_{k}") for k in ("words", "sentences", "paragraphs")})
    whole = ("char_count", "word_count", "line_count", "financial_keywords", "currency_patterns", "percentage_patterns", "sentence_count")
    part = ("avg_words_per_line", "numeric_ratio", "special_char_ratio", "uppercase_ratio", "avg_sentence_length", "sentence_length_std", "content_density")
    return d.select("doc_id", *[p[k].cast("long").alias(k) for k in whole], *[r6(p[k]).alias(k) for k in part])


@register(rf"""
WITH d AS (SELECT lang, length(coalesce(text, ''))::BIGINT AS n, {_W} AS w, len(regexp_extract_all(coalesce(text, ''), '[0-9]')) AS g FROM documents)
SELECT lang, count(*) AS n_pages, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(n), 6) AS avg_chars, round(avg(w), 6) AS avg_words, round(avg(g::DOUBLE / greatest(n, 1)), 6) AS avg_numeric_ratio,
  round(stddev_samp(n), 6) AS std_chars, round(stddev_samp(n) / greatest(avg(n), 1), 6) AS char_count_cv, round(stddev_samp(w) / greatest(avg(w), 1), 6) AS word_count_cv FROM d GROUP BY lang
""")
def text_consistency_by_lang(spark, sf_dir):
    c = quality.text_consistency(table(spark, sf_dir, "documents"), ["lang"])
    return c.select("lang", "n_pages", *[r6(x).alias(x) for x in ("success_rate", "avg_chars", "avg_words", "avg_numeric_ratio", "std_chars", "char_count_cv", "word_count_cv")])


@register("""
WITH r AS (SELECT lang, min(n_chars) AS lo, max(n_chars) AS hi, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY lang),
b AS (SELECT d.lang, r.n, CASE WHEN hi = lo THEN 0 ELSE least(floor((n_chars - lo)::DOUBLE / (hi - lo) * least(n, 10)), least(n, 10) - 1) END AS bin FROM documents d JOIN r USING (lang) WHERE n_chars IS NOT NULL),
c AS (SELECT lang, n, bin, count(*) AS c FROM b GROUP BY ALL)
SELECT lang, round(-sum(c::DOUBLE / n * log2(c::DOUBLE / n)), 6) AS entropy FROM c GROUP BY lang
""")
def length_entropy_by_lang(spark, sf_dir):
    return quality.histogram_entropy(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@register(f"SELECT doc_id, CASE WHEN length({_T}) > 50 THEN 'pdfplumber' WHEN length(trim(coalesce(source, ''), '{tx.WHITE}')) > 10 THEN 'tesseract_ocr' ELSE 'failed' END AS route FROM documents")
def page_route(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.route(F.col("text"), F.coalesce("source", F.lit(""))).alias("route"))


@register(f"SELECT lang, count(*) AS n, count(*) FILTER (length({_T}) >= 20) AS page_ok, count(*) FILTER (length({_T}) >= 15) AS paragraph_ok, count(*) FILTER (length({_T}) >= 30) AS block_ok FROM documents GROUP BY lang")
def min_length_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(tx.long_enough(F.col("text"), k)).alias(a) for k, a in ((20, "page_ok"), (15, "paragraph_ok"), (30, "block_ok"))])


@register(f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, '{tx.WHITE}')), lambda x: length(x) >= 15) AS ps FROM documents)
SELECT doc_id, i::INT AS idx, ps[i + 1] AS paragraph FROM (SELECT doc_id, ps, unnest(range(len(ps))) AS i FROM p)
""")
def paragraph_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.paragraphs(F.col("text"), "\n", limit=1 << 30)).alias("idx", "paragraph"))


def _packed(parts: str, limit: int, joiner: str) -> str:
    """SQL for greedy packing of a list of texts; chr(1) stands between chunks while the list is folded."""
    last = "string_split(a, chr(1))[-1]"
    return f"""list_filter(string_split(list_reduce(list_concat([''], {parts}), lambda a, x: CASE WHEN {last} = '' THEN a || x WHEN length({last}) + length(x) + length({joiner}) <= {limit} THEN a || {joiner} || x ELSE a || chr(1) || x END), chr(1)), lambda c: c <> '')"""


@register(f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, '{tx.WHITE}')), lambda x: length(x) >= 15) AS ps FROM documents),
q AS (SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= 120 THEN [p] ELSE list_transform({_packed("string_split(replace(p, '. ', '.' || chr(2)), chr(2))", 120, "''")}, lambda c: trim(c, '{tx.WHITE}')) END)) AS cs FROM p)
SELECT doc_id, i::INT AS idx, cs[i + 1] AS paragraph FROM (SELECT doc_id, cs, unnest(range(len(cs))) AS i FROM q)
""")
def paragraph_pack(spark, sf_dir):
    """T7 with its branch for long paragraphs."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.paragraphs(F.col("text"), "\n", limit=120)).alias("idx", "paragraph"))


@register(f"""
WITH p AS (SELECT doc_id, {_packed("string_split(text, chr(10))", 2000, "chr(10)")} AS cs FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i::INT AS idx, length(cs[i + 1])::INT AS n_chars, sha256(cs[i + 1]) AS chunk_sha256 FROM (SELECT doc_id, cs, unnest(range(len(cs))) AS i FROM p)
""")
def chunk_pack(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.pack(F.split("text", "\n"), 2000, "\n")).alias("idx", "chunk"))
    return d.select("doc_id", "idx", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(upper(text), '{w}')" for w in words) + ")"


_CLASS = rf"""CASE WHEN length({_T}) < 100 AND {_any(HEADINGS)} THEN 'heading' WHEN length({_T}) < 50 AND upper({_T}) = {_T} AND lower({_T}) <> {_T} THEN 'subheading'
  WHEN {_any(MONEY)} THEN 'text_block' WHEN regexp_matches({_T}, '^\w+\.\s') OR contains(text, '•') THEN 'list' WHEN {_any(STRUCTURES)} THEN 'structured_content' ELSE 'paragraph' END"""


def _classified(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("block_type", tx.classify(F.col("text"), HEADINGS, MONEY, STRUCTURES))


@register(f"SELECT doc_id, {_CLASS} AS block_type FROM documents")
def block_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "block_type")


@register(rf"""SELECT doc_id, CASE WHEN length({_T}) < 100 AND {_any(tx.HEADING_WORDS_SHORT)} THEN 'heading' WHEN {_any(tx.MONEY_WORDS_SHORT)} THEN 'text_block' WHEN regexp_matches({_T}, '^\w+\.\s') OR contains(text, '•') THEN 'list' ELSE 'paragraph' END AS block_type FROM documents""")
def block_classify_short(spark, sf_dir):
    """T10, with its own words."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.classify(F.col("text"), tx.HEADING_WORDS_SHORT, tx.MONEY_WORDS_SHORT, ()).alias("block_type"))


@register(f"SELECT lang, {_CLASS} AS block_type, count(*) AS n FROM documents GROUP BY ALL")
def block_type_counts(spark, sf_dir):
    return records.type_counts(_classified(spark, sf_dir), ["lang"])


def _records(spark, sf_dir):
    d = _classified(spark, sf_dir)
    return records.text_records(d, "doc_id", F.col("doc_id") % 50, "text", F.col("block_type"), "pdfplumber", section=F.col("source"))


@register(f"""
SELECT doc_id::VARCHAR AS doc_id, concat_ws(',', CASE WHEN source_path IS NULL THEN 'missing company' END, CASE WHEN source_path IS NULL THEN 'missing fiscal_year' END, CASE WHEN source_path IS NULL THEN 'missing source_path' END,
  CASE WHEN doc_id % 50 = 0 THEN 'missing page' END, CASE WHEN section IS NULL OR section = '' THEN 'missing section' END, CASE WHEN b = 'list' THEN 'bad block type' END) AS errors
FROM (SELECT doc_id, source AS section, CASE WHEN doc_id % 3 > 0 THEN 'doc-' || doc_id END AS source_path, {_CLASS} AS b FROM documents WHERE {_T} <> '')
""")
def record_validate(spark, sf_dir):
    """F7 over records with all columns; every third document has no attributes, and lists are not accepted."""
    d = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id", F.lit("Acme").alias("company"), F.lit("2024").alias("fiscal_year"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_path"))
    full = records.completed(_records(spark, sf_dir), d, "2024-01-01")
    return full.select("doc_id", F.array_join(records.errors([t for t in records.BLOCK_TYPES if t != "list"]), ",").alias("errors"))


@register(f"""
SELECT block_type, method AS extraction_method, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (
  SELECT {_CLASS} AS block_type, 'pdfplumber' AS method, text AS t FROM documents UNION ALL
  SELECT 'text_block', 'html', html FROM pages UNION ALL SELECT 'paragraph', 'conversation', text FROM conversations) WHERE trim(t, '{tx.WHITE}') <> '' GROUP BY ALL
""")
def record_union(spark, sf_dir):
    p, c = table(spark, sf_dir, "pages"), table(spark, sf_dir, "conversations")
    u = records.union(_records(spark, sf_dir), records.text_records(p, "page_id", F.lit(1), "html", "text_block", "html", 0.8), records.text_records(c, "conv_id", F.col("turn") + 1, "text", "paragraph", "conversation"))
    return u.groupBy("block_type", "extraction_method").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register(f"""
WITH b AS (SELECT source, doc_id % 50 AS page, {_CLASS} AS b FROM documents WHERE {_T} <> '')
SELECT source AS section, count(*) AS n_records, count(DISTINCT page) AS n_pages, count(DISTINCT b) AS n_types, bool_or(b IN ('paragraph', 'text_block')) AS has_text, bool_or(b IN ('heading', 'subheading')) AS has_headings, round(least(1.0, count(DISTINCT b) / 8.0), 6)::DOUBLE AS score FROM b GROUP BY source
""")
def record_completeness(spark, sf_dir):
    return records.completeness(_records(spark, sf_dir), ["section"]).select("section", "n_records", "n_pages", "n_types", "has_text", "has_headings", r6("score").alias("score"))


@register("SELECT doc_id, CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '...' ELSE text END AS preview FROM documents")
def truncate_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate(F.col("text")).alias("preview"))


@register("SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title FROM pages")
def first_section_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("title"))


@register("SELECT page_id, regexp_extract(html, '<li[^>]*><a[^>]*>([^<]*)</a>', 1) AS header, regexp_extract(html, '<footer[^>]*>([^<]*)', 1) AS footer FROM pages")
def header_footer_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<li[^>]*><a[^>]*>([^<]*)</a>", 1).alias("header"), F.regexp_extract("html", "<footer[^>]*>([^<]*)", 1).alias("footer"))


@register(f"SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY trim(substr(lower(text), 1, 400), '{tx.WHITE}') ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_keep_best(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", tx.signature(F.col("text")).alias("sig"))
    top = d.groupBy("sig").agg(F.max_by(F.struct("doc_id", "n_chars"), F.struct("n_chars", -F.col("doc_id"))).alias("b"))
    return top.select("b.doc_id", "b.n_chars")


def _matches(text: str, pattern: str, kind: str, context: str, scale: float) -> str:
    v, o = (f"regexp_extract_all({text}, '(?i){pattern}', {g})" for g in (1, 0))
    return f"SELECT doc_id, '{kind}' AS pattern_type, '{context}' AS context, unnest(range(len(v))) AS i, v, o, {scale} AS k FROM (SELECT doc_id, {v} AS v, {o} AS o FROM documents)"


_AMOUNTS = " UNION ALL ".join([_matches("lower(text)", p, "contextual", name, 1.0) for name, p in tx.CONTEXT_PATTERNS] + [_matches("text", p, name, "unknown", k) for name, p, k in tx.VALUE_PATTERNS])


@register(rf"SELECT doc_id, pattern_type, context, i::INT AS idx, regexp_replace(v[i + 1], '[,$]', '', 'g')::DOUBLE * k::DOUBLE AS value, o[i + 1] AS original_text FROM ({_AMOUNTS})")
def financial_values(spark, sf_dir):
    """T17 over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.financial_values(F.col("text"))).alias("m")).select("doc_id", "m.*")


@register(rf"SELECT doc_id, pattern_type, count(*) AS n, round(sum(regexp_replace(v[i + 1], '[,$]', '', 'g')::DOUBLE * k::DOUBLE), 2) AS total FROM ({_AMOUNTS}) GROUP BY 1, 2")
def amount_regex_extract(spark, sf_dir):
    """T17 summed up: how many values each kind of pattern finds in a document, and their sum."""
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.financial_values(F.col("text"))).alias("m"))
    return m.groupBy("doc_id", "m.pattern_type").agg(F.count("*").alias("n"), F.round(F.sum("m.value"), 2).alias("total"))


_LABEL = "'Total ' || p_name || ' & ' || p_brand || ' (in $millions)'"
_CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({_LABEL}), '\(in \$.*?\)', '', 'g'), '[^\w\s&]', ' ', 'g'), '\s+', ' ', 'g'))"


@register(rf"SELECT p_partkey, regexp_replace({_CLEAN}, '\b(and|&)\b', 'and', 'g') AS clean_label, trim(regexp_replace(lower(p_name), '^total\s+', '')) AS clean_phrase FROM part")
def clean_label(spark, sf_dir):
    label = F.concat(F.lit("Total "), "p_name", F.lit(" & "), "p_brand", F.lit(" (in $millions)"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.clean_label(label).alias("clean_label"), tx.clean_phrase(F.concat(F.lit("Total "), "p_name")).alias("clean_phrase"))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), F.lower("p_name").alias("clean_label"))


def _rules(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 7 = 0")
    return p.select(F.lower("p_name").alias("clean_label"), F.col("p_type").alias("concept"))


_EXACT = "WITH r AS (SELECT lower(p_name) AS c, max(p_type) AS concept FROM part WHERE p_partkey % 7 = 0 GROUP BY 1)"


@register(f"{_EXACT} SELECT p_partkey AS label, r.concept, CASE WHEN r.concept IS NULL THEN 0.0 ELSE 100.0 END::DOUBLE AS confidence, CASE WHEN r.concept IS NULL THEN 'none' ELSE 'exact' END AS method FROM part LEFT JOIN r ON lower(p_name) = c")
def label_exact_map(spark, sf_dir):
    return mapping.exact(_labels(spark, sf_dir), _rules(spark, sf_dir)).select("label", "concept", "confidence", "method")


def _terms(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.select(F.lower("n_name").alias("term"), F.lit("nation").alias("concept")).unionByName(r.select(F.lower("r_name").alias("term"), F.lit("region").alias("concept")))


def _sorted_words(c: str) -> str:
    return rf"array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9_]', ' ', 'g'), '\s+'), lambda x: x <> '')), ' ')"


#: Every label with every term; the common subsequence by one bit for each character of the label.
_TOKEN_SORT = rf"""
WITH l AS (SELECT c, a, length(a) AS n, (1::UBIGINT << length(a)) - 1 AS o FROM (SELECT c, {_sorted_words('c')} AS a FROM (SELECT DISTINCT {{label}} AS c FROM {{labels}}))),
t AS (SELECT term, concept, {_sorted_words('term')} AS b FROM (SELECT DISTINCT {{term}} AS term, {{concept}} AS concept FROM {{terms}})),
m AS (SELECT c, term, concept, n, length(b) AS k, o, list_transform(string_split(b, ''), lambda ch: list_sum(list_transform(range(n), lambda i: CASE WHEN substr(a, i + 1, 1) = ch THEN 1::UBIGINT << i ELSE 0 END))::UBIGINT) AS ms FROM l, t),
s AS (SELECT c, term, concept, round_even(200.0::DOUBLE * (n - bit_count(list_reduce(ms, lambda v, x: ((v + (v & x)) | (v & xor(o, x))) & o, o))) / (n + k), 0) AS score FROM m),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, term, concept) AS r FROM s WHERE score >= 80) WHERE r = 1)
"""


@register(_TOKEN_SORT.format(label="'the ' || lower(p_type) || ' ' || lower(p_name)", labels="part WHERE p_size < 25", term="lower(p_name) || ', ' || lower(p_type)", concept="p_size % 3", terms="part WHERE p_size >= 25") + "SELECT c AS clean_label, term, concept::VARCHAR AS concept, coalesce(score, 0)::DOUBLE AS confidence, n FROM (SELECT 'the ' || lower(p_type) || ' ' || lower(p_name) AS c, count(*) AS n FROM part WHERE p_size < 25 GROUP BY 1) LEFT JOIN b USING (c)")
def label_fuzzy_map(spark, sf_dir):
    """J2 by T3 at 80: types and names in another order, with an article, against those of other parts."""
    p = table(spark, sf_dir, "part")
    labels = p.where("p_size < 25").select(F.col("p_partkey").alias("label"), F.concat(F.lit("the "), F.lower("p_type"), F.lit(" "), F.lower("p_name")).alias("clean_label"))
    terms = p.where("p_size >= 25").select(F.concat(F.lower("p_name"), F.lit(", "), F.lower("p_type")).alias("term"), (F.col("p_size") % 3).cast("string").alias("concept"))
    return mapping.fuzzy(labels, terms).groupBy("clean_label", "term", "concept", "confidence").agg(F.count("*").alias("n"))


@register(_TOKEN_SORT.format(label="lower(p_name || ' ' || p_brand)", labels="part", term="lower(p_brand || ' ' || p_name)", concept="p_type", terms="part WHERE p_partkey % 7 = 0") + "SELECT p_partkey AS label, term, concept, coalesce(score, 0)::DOUBLE AS confidence FROM part LEFT JOIN b ON lower(p_name || ' ' || p_brand) = c")
def part_fuzzy_map(spark, sf_dir):
    """J2 by T3 at 80: all parts' labels against a seventh of them, whose words stand in another order."""
    p = table(spark, sf_dir, "part")
    labels = p.select(F.col("p_partkey").alias("label"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("clean_label"))
    terms = p.where("p_partkey % 7 = 0").select(F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("term"), F.col("p_type").alias("concept"))
    return mapping.fuzzy(labels, terms).select("label", "term", "concept", "confidence")


@register()
def label_seq_ratio(spark, sf_dir):
    """T5: all parts' names against all names with their brands, at 60; difflib's ratio has no SQL, tests hold it against difflib."""
    p = table(spark, sf_dir, "part")
    labels = p.select(F.lower("p_name").alias("clean_label")).distinct().withColumn("label", F.col("clean_label"))
    terms = p.select(F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("term"), F.col("p_brand").alias("concept")).distinct()
    return mapping.fuzzy(labels, terms, scorer="sequence", least=60).select("label", "term", "concept", r6("confidence").alias("confidence"))


@register(_EXACT + """
, l AS (SELECT p_partkey, r.concept IS NOT NULL AS m FROM part LEFT JOIN r ON lower(p_name) = c)
SELECT count(*) AS n_labels, count(*) FILTER (m) AS n_mapped, round(count(*) FILTER (m)::DOUBLE / count(*), 6) AS mapping_rate, count(*) FILTER (m) AS n_exact FROM l""")
def mapping_statistics(spark, sf_dir):
    s = mapping.statistics(mapping.exact(_labels(spark, sf_dir), _rules(spark, sf_dir)))
    return s.select("n_labels", "n_mapped", r6("mapping_rate").alias("mapping_rate"), "n_exact")


_ALL_TOKENS = r"SELECT {0} AS k, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')) AS token FROM {1}"


@register(rf"""
WITH d AS ({_ALL_TOKENS.format('item_id', 'benchmark')}), q AS ({_ALL_TOKENS.format('conv_id * 1000 + turn', 'conversations')}),
n AS (SELECT count(DISTINCT k) AS n FROM d), idf AS (SELECT token, ln((1 + n.n)::DOUBLE / (1 + count(DISTINCT k))) + 1 AS idf FROM d, n GROUP BY token, n.n),
dw AS (SELECT k, token, count(*) * idf AS w FROM d JOIN idf USING (token) GROUP BY k, token, idf), qw AS (SELECT k, token, count(*) * idf AS w FROM q JOIN idf USING (token) GROUP BY k, token, idf),
dn AS (SELECT k, sqrt(sum(w * w)) AS n FROM dw GROUP BY k), qn AS (SELECT k, sqrt(sum(w * w)) AS n FROM qw GROUP BY k),
s AS (SELECT qw.k AS query, dw.k AS doc, round(sum(qw.w / qn.n * (dw.w / dn.n)), 6) AS cosine FROM qw JOIN dw USING (token) JOIN dn ON dn.k = dw.k JOIN qn ON qn.k = qw.k GROUP BY 1, 2),
b AS (SELECT query, doc, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, doc) AS r FROM s) WHERE r = 1)
SELECT query, doc, cosine FROM (SELECT DISTINCT conv_id * 1000 + turn AS query FROM conversations) LEFT JOIN b USING (query)
""")
def label_tfidf_map(spark, sf_dir):
    """Turns of conversations against benchmark, null for one without a match."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), "text")
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.explode(tx.tokens(F.col("text"))).alias("token"))
    best = mapping.tfidf(docs, c.select("query", F.explode(tx.tokens(F.col("text"))).alias("token")), parts=parts(c, 500))
    return c.select("query").distinct().join(best, "query", "left").select("query", "doc", "cosine")


@register(rf"""
WITH d AS ({_ALL_TOKENS.format('item_id', 'benchmark')}), q AS ({_ALL_TOKENS.format('doc_id', 'documents')}),
n AS (SELECT count(DISTINCT k) AS n FROM d), idf AS (SELECT token, ln((1 + n.n)::DOUBLE / (1 + count(DISTINCT k))) + 1 AS idf FROM d, n GROUP BY token, n.n),
dw AS (SELECT k, token, count(*) * idf AS w FROM d JOIN idf USING (token) GROUP BY k, token, idf), qw AS (SELECT k, token, count(*) * idf AS w FROM q JOIN idf USING (token) GROUP BY k, token, idf),
dn AS (SELECT k, sqrt(sum(w * w)) AS n FROM dw GROUP BY k), qn AS (SELECT k, sqrt(sum(w * w)) AS n FROM qw GROUP BY k),
s AS (SELECT qw.k AS query, dw.k AS doc, round(sum(qw.w / qn.n * (dw.w / dn.n)), 6) AS cosine FROM qw JOIN dw USING (token) JOIN dn ON dn.k = dw.k JOIN qn ON qn.k = qw.k GROUP BY 1, 2),
b AS (SELECT query, doc, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, doc) AS r FROM s) WHERE r = 1)
SELECT doc_id AS query, doc, cosine FROM documents LEFT JOIN b ON query = doc_id
""")
def document_tfidf_map(spark, sf_dir):
    """T6 over all words of whole documents against benchmark, null for a document without a match."""
    d = table(spark, sf_dir, "documents")
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.explode(tx.tokens(F.col("text"))).alias("token"))
    best = mapping.tfidf(docs, d.select(F.col("doc_id").alias("query"), F.explode(tx.tokens(F.col("text"))).alias("token")), parts=parts(d, 500))
    return d.select(F.col("doc_id").alias("query")).join(best, "query", "left").select("query", "doc", "cosine")


@register(r"""
WITH t AS (SELECT p_partkey AS k, p_size AS s, p_name AS name, unnest(list_distinct(list_filter(string_split_regex(lower(p_name), '[_\-.\s]+'), lambda x: x <> ''))) AS token FROM part),
f AS (SELECT token, min(struct_pack(s, name)) AS p FROM t WHERE k % 2 = 0 GROUP BY token),
h AS (SELECT t.s, t.name, min(f.p) AS p FROM t JOIN f USING (token) WHERE t.k % 2 = 1 GROUP BY 1, 2)
SELECT DISTINCT p_size AS seq, p_name AS name, h.p.name AS partner FROM part LEFT JOIN h ON h.s = p_size AND h.name = p_name WHERE p_partkey % 2 = 1
""")
def name_token_pair(spark, sf_dir):
    """Many names share their place in the order (sizes), so ties go by name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("seq"), F.col("p_name").alias("name"))
    return mapping.pair_by_tokens(p.where("k % 2 = 1").select("name", "seq").distinct(), p.where("k % 2 = 0")).select("seq", "name", "partner")


@register(f"""
WITH d AS (SELECT doc_id % 40 AS page, length(text) AS n, {_CLASS} AS b FROM documents), a AS (SELECT page, sum(n)::BIGINT AS chars_a, count(*) FILTER (b = 'text_block') AS tables_a FROM d GROUP BY page),
b AS (SELECT item_id AS page, sum(length(text))::BIGINT AS chars_b FROM benchmark GROUP BY 1)
SELECT page, chars_a, tables_a, chars_b, round(chars_b::DOUBLE / chars_a, 6) AS ratio, CASE WHEN chars_b IS NULL THEN 'missing' WHEN chars_b::DOUBLE / chars_a < 0.5 THEN 'much_less' WHEN chars_b::DOUBLE / chars_a > 1.5 THEN 'much_more' ELSE 'similar' END AS verdict FROM a LEFT JOIN b USING (page)
""")
def page_two_system_compare(spark, sf_dir):
    a = _classified(spark, sf_dir).groupBy((F.col("doc_id") % 40).alias("page")).agg(F.sum(F.length("text")).alias("chars_a"), F.count_if(F.col("block_type") == "text_block").alias("tables_a"))
    b = table(spark, sf_dir, "benchmark").groupBy(F.col("item_id").alias("page")).agg(F.sum(F.length("text")).alias("chars_b"))
    j = a.join(b, "page", "left").withColumn("ratio", F.col("chars_b") / F.col("chars_a"))
    return j.select("page", "chars_a", "tables_a", "chars_b", r6("ratio").alias("ratio"), quality.band(F.col("ratio")).alias("verdict"))


@register("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INT AS reading_order, count(*) OVER (PARTITION BY conv_id) > 1 AS multicolumn FROM conversations")
def reading_order(spark, sf_dir):
    from ..operators.layout import reading_order as order

    return order(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "reading_order", "multicolumn")


@register(f"""
WITH b AS (SELECT source, doc_id % 50 AS page, text, {_CLASS} AS b FROM documents WHERE {_T} <> '')
SELECT source AS section, page::INT AS page, sum(length(text))::BIGINT AS text_length, count(*) FILTER (b = 'list') AS n_tables FROM b GROUP BY ALL
""")
def page_totals(spark, sf_dir):
    """Lists stand for tables."""
    r = _records(spark, sf_dir).withColumn("block_type", F.when(F.col("block_type") == "list", "table").otherwise(F.col("block_type")))
    return records.page_totals(r, ["section", "page"])
