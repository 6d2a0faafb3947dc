"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import kmeans, kneser_ney, langid, media_tiff, minhash, mixing, pieces, pii, rules, secrets, simhash, urlfilter, vector_codes
from .common import span_list


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    df = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), candidates="n_candidates").drop("text")
    base = F.filter("secret_spans", lambda x: x["rank"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["rank"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *map(count, secrets.KINDS[:3]), secrets.digest(base).alias("base_sha256"), span_list(F.col("secret_spans")).alias("spans"), "n_candidates", F.size(F.filter("secret_spans", lambda x: x["rank"] == 3)).cast("long").alias("n_added"), (F.size("secret_spans") > 0).alias("has_secret"))


def op4_personal_data(spark, sf_dir):
    return pii.report(_table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held = langid.held_out()
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark, sf_dir):
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op7_tiff_media(spark, sf_dir):
    return media_tiff.text_features(_table(spark, sf_dir, "documents"))


def op8_quality_kneser_ney(spark, sf_dir):
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), trusted)


def op9_sentencepiece(spark, sf_dir):
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    found = rules.apply_policy(rules.ledger(_table(spark, sf_dir, "documents")))
    failed = F.col("fails").bitwiseAND(F.lit(rules.POLICIES["base"])) != 0
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fails")


def media_pages(spark, sf_dir):
    """Each text's file, one row a page."""
    return media_tiff.pages(media_tiff.text_media(_table(spark, sf_dir, "documents")), "doc_id", "media")


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op13_centroid_clustering(spark, sf_dir):
    return kmeans.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_simhash_near_dedup, op3_secret_scan, op4_personal_data, op5_language_id, op6_url_filter, op7_tiff_media, op8_quality_kneser_ney, op9_sentencepiece, op10_quality_rules, op11_vector_codes, op12_minhash_near_dedup, op13_centroid_clustering, media_pages)}

_OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, length(regexp_replace(coalesce(text, ''), '[^ \t\n\x0b\f\r]+', 'x', 'g')) - length(regexp_replace(coalesce(text, ''), '[^ \t\n\x0b\f\r]+', '', 'g')) AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rk FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((rk - 1) % 3 + 1)::INT] AS w, sum(ss) OVER () AS total FROM s0),
s2 AS (SELECT *, row_number() OVER f AS pos, total - coalesce(sum(3 * ss) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM s1 WINDOW f AS (ORDER BY ss::DOUBLE / w, rk)),
lv AS (SELECT room::DOUBLE AS room, share::DOUBLE AS share, pos FROM s2 WHERE w::DOUBLE * room::DOUBLE / share::DOUBLE <= (3 * ss)::DOUBLE ORDER BY pos LIMIT 1),
s AS (SELECT source, rk, ss, CASE WHEN s2.pos < lv.pos THEN (3 * ss)::DOUBLE ELSE w::DOUBLE * lv.room / lv.share END AS target FROM s2, lv),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS q, sum(floor(target + 0.5)::BIGINT) OVER () AS qs, sum(floor(target + 0.5)::BIGINT) OVER (ORDER BY rk) AS upto, count(*) OVER () AS n_sources FROM s),
hl AS (SELECT *, floor(upto::DOUBLE / qs::DOUBLE * 1099511627776.0)::BIGINT AS hi, coalesce(lag(floor(upto::DOUBLE / qs::DOUBLE * 1099511627776.0)::BIGINT) OVER (ORDER BY rk), 0) AS lo FROM q),
n AS (SELECT ceil(max(qs)::DOUBLE / 512)::BIGINT AS n_slots FROM q),
pts AS (SELECT t AS slot, (((t + 1)::HUGEINT * 679541151873) % 1099511627776)::BIGINT AS point FROM (SELECT unnest(range(n_slots)) AS t FROM n)),
own AS (SELECT rk, slot, row_number() OVER (PARTITION BY rk ORDER BY slot) - 1 AS k FROM pts JOIN hl ON point >= lo AND point < hi),
have AS (SELECT hl.rk, ceil(q::DOUBLE / 512)::BIGINT AS blocks, n_sources, (SELECT count(*) FROM own WHERE own.rk = hl.rk) AS c FROM hl),
slots AS (SELECT rk, k, slot FROM own UNION ALL SELECT rk, k, n_slots + (k - c) * n_sources + rk - 1 FROM (SELECT *, unnest(range(c, blocks)) AS k FROM have WHERE c < blocks), n),
o AS (SELECT row_number() OVER () AS r, doc_id, size, rk, ss, target, q,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
    FROM d JOIN hl ON d.source IS NOT DISTINCT FROM hl.source),
e AS (SELECT r, rk, off + e * ss AS a, least(off + e * ss + size, q) AS b FROM o, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND off + e * ss < q),
p AS (SELECT r, rk, b - a AS words, unnest(range(a // 512, (b - 1) // 512 + 1)) AS k FROM e),
f AS (SELECT r, count(*) AS n_blocks, min(slot) AS first_slot FROM p JOIN slots USING (rk, k) GROUP BY r),
w AS (SELECT r, sum(b - a) AS taken FROM e GROUP BY r)
SELECT doc_id, size::BIGINT AS size, ss AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n_blocks, 0)::BIGINT AS n_blocks, first_slot::BIGINT AS first_slot FROM o LEFT JOIN w USING (r) LEFT JOIN f USING (r)
"""

_OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM d),
x AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS t FROM s),
common AS (SELECT x.r AS a, y.r AS b, x.n AS na, y.n AS nb, count(*) AS c FROM x JOIN x AS y ON x.t = y.t AND x.r < y.r AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN c USING (r)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11_sql(rounds: int = 4) -> str:
    """Each part's nearest entry by plain search, round after round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p, min((vv - 2 * list_dot_product(v, c) + cc)::BIGINT * 256 + e) AS m FROM x JOIN b{i} USING (p) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT p, e, j, sum(y) AS s, count(*) AS n FROM (SELECT p, m % 256 AS e, unnest(v)::BIGINT AS y, unnest(range(len(v))) AS j FROM a{i} JOIN x USING (r, p)) GROUP BY ALL),
f{i} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS c FROM s{i} GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT p, e, c, list_dot_product(c, c) AS cc FROM (SELECT b.p, b.e, coalesce(f{i}.c, b.c) AS c FROM b{i} AS b LEFT JOIN f{i} ON f{i}.p = b.p AND f{i}.e = b.e))""")
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q, embedding FROM embeddings WHERE {_FINITE}),
x AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS vv FROM (SELECT r, p, list_slice(q, p * (len(q) // 4) + 1, (p + 1) * (len(q) // 4)) AS v FROM k, (SELECT unnest(range(4)) AS p))),
o AS (SELECT r, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS e FROM k QUALIFY e < 256),
b0 AS MATERIALIZED (SELECT p, e, v AS c, vv AS cc FROM o JOIN x USING (r)),
{", ".join(steps)},
d AS (SELECT r, string_agg(printf('%02x', (m % 256)::INT), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS j FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN d USING (r), h"""


def _op13_sql(rounds: int = 3) -> str:
    """Each vector's nearest centroid by plain search, round after round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min((qq - 2 * list_dot_product(q, c) + cc)::BIGINT * 16 + e) AS m FROM k, c{i} GROUP BY r)")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT e, j, sum(y) AS s, count(*) AS n FROM (SELECT m % 16 AS e, unnest(q)::BIGINT AS y, unnest(range(64)) AS j FROM a{i} JOIN k USING (r)) GROUP BY ALL),
f{i} AS (SELECT e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS c FROM s{i} GROUP BY e),
c{i + 1} AS MATERIALIZED (SELECT e, c, list_dot_product(c, c) AS cc FROM (SELECT c.e, coalesce(f{i}.c, c.c) AS c FROM c{i} AS c LEFT JOIN f{i} ON f{i}.e = c.e))""")
    return f"""WITH k0 AS (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
k AS MATERIALIZED (SELECT *, list_dot_product(q, q) AS qq FROM k0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), embedding) - 1 AS e, q AS c, qq AS cc FROM k QUALIFY e < 16),
{", ".join(steps)},
d AS (SELECT r, m % 16 AS e, m // 16 AS distance FROM a{rounds}),
h AS (SELECT e, sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY j)) AS h FROM (SELECT e, unnest(c) AS y, unnest(range(64)) AS j FROM c{rounds}) GROUP BY e)
SELECT vec_id, e::INT AS cluster, distance, sum(distance) OVER (PARTITION BY e)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, h AS centroid_sha256 FROM k JOIN d USING (r) JOIN h USING (e)"""


ORACLES = {"op11_vector_codes": _op11_sql(), "op13_centroid_clustering": _op13_sql(), "op12_minhash_near_dedup": _OP12_SQL, "op1_source_mixing": _OP1_SQL, "op6_url_filter": urlfilter.oracle_sql(), "op10_quality_rules": rules.oracle_sql()}
