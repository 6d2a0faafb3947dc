"""Nulls, blanks, repeated rows, clashing columns and empty tables, for every operator."""

import pytest

from tallyforge.llm import kneser_ney, langid, media_tiff, mixing, pieces, pii, rules, secrets, simhash, urlfilter

from conftest import CLASH, ROWS

N = len(ROWS)


def trusted(docs):
    return docs.select("doc_id").where("doc_id in (1, 2, 7)")


PER_ROW = {
    "mix": mixing.mix,
    "near_duplicates": simhash.near_duplicates,
    "secrets": secrets.scan,
    "pii": pii.report,
    "langid": lambda d: langid.predict(d, langid.fit(d, epochs=1)),
    "tiff": media_tiff.text_features,
    "kneser_ney": lambda d: kneser_ney.classify(d, trusted(d)),
    "pieces": pieces.round_trip,
    "rules": rules.ledger,
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_for_each_row(odd, clash, none, name):
    assert PER_ROW[name](odd).count() == N
    assert PER_ROW[name](clash).count() == N
    assert PER_ROW[name](none).count() == 0


STAGES = {
    "keep_known": lambda d: langid.keep_known(d, langid.fit(d, epochs=1)),
    "keep_one": simhash.keep_one,
    "redact": secrets.redact,
    "mixed": mixing.mixed_documents,
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns(clash, none, name):
    out = STAGES[name](clash)
    assert out.columns == clash.columns and out.count() <= 3 * N
    assert STAGES[name](none).count() == 0 and STAGES[name](none).columns == none.columns


def test_encode_keeps_columns(clash, none):
    out = pieces.encode(clash)
    assert out.columns == [*clash.columns, "piece_ids"] and out.count() == N
    assert pieces.decode(out).count() == N and pieces.encode(none).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?x#y", "http://example.net/de/8", "http://x.net/de/1", "http://notcom/en/", "x://spam.org/a", "x://h/?win&free&bonus", "x://h/winner"]
    p = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r["page_id"]: r for r in urlfilter.judge(p).collect()}
    assert len(got) == len(urls) and (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("", "", None, "allow")
    assert (got[4]["host"], got[4]["rule"], got[4]["verdict"]) == ("a.example.com", "example.com/en/7", "allow")
    assert (got[5]["rule"], got[5]["verdict"], got[6]["rule"], got[6]["verdict"]) == ("example.net/de/8", "block", "net/de/", "allow")
    assert got[7]["rule"] is None and got[8]["verdict"] == "block" and got[9]["verdict"] == "block" and got[10]["verdict"] == "allow"
    assert urlfilter.judge(p.where("false")).count() == 0


def test_keep_one_of_each_group(odd):
    got = simhash.keep_one(odd).collect()
    ids = [r["doc_id"] for r in got]
    assert ids.count(1) == 1 and 2 not in ids  # copies: the smallest id stays
    assert len([i for i in ids if i in (3, 4, 5)]) == 1  # blank texts share a fingerprint
    assert sum(r["text"] == "Lonely row without an id" for r in got) == 1


def test_repeated_row_stays_once(spark):
    d = spark.createDataFrame([(5, "one two three four five six", "en", "a", 1)] * 3 + [(6, None, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in simhash.keep_one(d).collect()) == [5, 6]


def test_keep_one_by_id_and_text(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    far = "north south east west up down left right inside"
    base = " ".join(f"w{i * i}" for i in range(400))
    near = [t for t in (f"{base} a{i} b{i} c{i}" for i in range(200)) if 0 < (simhash.fingerprint(t) ^ simhash.fingerprint(base)).bit_count() <= 4]
    assert near
    rows = [(5, a), (5, b), (2, b), (7, far), (7, a.upper() + " iota kappa"), (None, base), (None, near[0]), (9, None), (None, ""), (5, b), (5, a), (5, a)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None), key=str) == sorted([(2, b), (5, a), (7, far), (7, a.upper() + " iota kappa"), (9, None)], key=str)
    assert len([r for r in got if r["doc_id"] is None]) == 1


def test_unknown_language_goes(odd):
    kept = {r["doc_id"] for r in langid.keep_known(odd, langid.fit(odd, epochs=1), min_score=0.0).collect()}
    assert kept == {1, 2, None, 7, 8, 9}


def test_redaction(odd):
    out = {r["doc_id"]: r for r in secrets.redact(odd).collect()}
    assert out[9]["text"].endswith("[SECRET]") and "abcdefghijkl" not in out[9]["text"] and out[9]["n_chars"] == len(out[9]["text"])
    assert out[1]["text"] == ROWS[0][1] and out[3]["text"] is None


# --- long tokens, broken files, wrong parameters
LONG = {
    "path": "a/" * 500_000 + "1", "base64": "Ab3+/x9" * 15_000, "hex": "0123456789abcdef" * 65_536, "email": "a@" + "b." * 500_000 + "c", "dotted": "1." * 8_000 + "1", "digits": "4 " * 50_000,
    "plus": "+1" + "-2" * 500_000, "word": "w" * 1_000_000, "assign": "secret=" + "x" * 1_000_000, "spelled": "a at b dot " * 1_500, "quotes": '"' * 1_000_000, "capitals": "AKIA" * 25_000,
}


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(LONG.values())], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_long_tokens(long, name):
    assert len(PER_ROW[name](long).collect()) == len(LONG)


def test_long_tokens_in_stages(long):
    assert langid.keep_known(long, langid.fit(long, epochs=1), min_score=0.0).count() <= len(LONG)
    assert simhash.keep_one(long).count() <= len(LONG)
    out = {r["doc_id"]: r for r in secrets.redact(long).collect()}
    names = list(LONG)
    assert out[names.index("path")]["text"] == LONG["path"] and out[names.index("hex")]["text"] == out[names.index("assign")]["text"] == "[SECRET]"


def test_broken_tiff_files(spark):
    import numpy as np

    good = media_tiff.write_tiff([np.arange(64, dtype=np.uint8).reshape(8, 8)], media_tiff.NONE, 1, tile=16)

    def patched(tag, count=None, value=None):
        out = bytearray(good)
        at = int.from_bytes(out[4:8], "little")
        for i in range(int.from_bytes(out[at : at + 2], "little")):
            e = at + 2 + 12 * i
            if int.from_bytes(out[e : e + 2], "little") == tag:
                if count is not None:
                    out[e + 4 : e + 8] = count.to_bytes(4, "little")
                if value is not None:
                    out[e + 8 : e + 12] = value.to_bytes(4, "little")
        return bytes(out)

    blobs = {"good": good, "no tile width": patched(media_tiff.TILE_WIDTH, value=0), "empty tag": patched(media_tiff.WIDTH, count=0), "huge": patched(media_tiff.WIDTH, value=0xFFFFFFFF), "count": patched(media_tiff.TILE_OFFSETS, count=0xFFFFFFFF),
             "compression": patched(media_tiff.COMPRESSION, value=77), "cut": good[: len(good) // 2], "short": b"II", "empty": b"", "loop": good[:4] + (0xFFFFFFF0).to_bytes(4, "little") + good[8:], "no parts": patched(media_tiff.TILE_BYTES, count=0)}
    for i in range(0, len(good), 3):
        blobs[f"byte {i}"] = good[:i] + b"\xff" + good[i + 1 :]
    rows = media_tiff.pages(spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "name string, blob binary"), "name", "blob").collect()
    by = {r["id"]: r for r in rows}
    assert by.keys() == blobs.keys() and by["good"]["error"] is None
    assert all(by[k]["error"] for k in blobs if k != "good" and not k.startswith("byte"))


def test_inflating_part_is_bounded():
    import zlib

    assert len(media_tiff._expand(zlib.compress(b"\0" * 50_000_000), media_tiff.DEFLATE, 4096)) == 4096


@pytest.mark.parametrize("radius", [0, 8, -1])
def test_radius_out_of_range(spark, radius):
    with pytest.raises(ValueError, match="radius"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius)


def test_scratch_folder_must_be_shared(spark, monkeypatch):
    from tallyforge.llm import common

    class Context:
        master = "spark://far:7077"

    class Session:
        conf, sparkContext = spark.conf, Context

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert common.scratch_dir(Session) == named.rstrip("/")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.scratch_dir(Session)


def test_soft_terms_decide(spark):
    urls = {0: ("http://free-bets.x/", "block"), 1: ("http://cheap-pills.x/", "block"), 2: ("http://ads.track.x/a", "block"), 3: ("http://bets.x/bets/bets", "allow"), 4: ("http://free.cheap.x/", "allow"), 5: ("http://freebets.x/", "allow"), 6: ("HTTP://FREE.x/?q=WIN&ads", "block")}
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame([(i, u) for i, (u, _) in urls.items()], "page_id long, url string")).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {i: v for i, (_, v) in urls.items()}
    assert (got[3]["soft_hits"], got[3]["soft_weight"], got[6]["soft_hits"]) == (1, 2, 3)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    told = urlfilter.judge(pages).where("rule IS NULL AND verdict = 'block'").groupBy((urlfilter.F.col("strict_hits") > 0).alias("strict")).count().collect()
    assert {r["strict"] for r in told} == {True, False}
    assert len(set(urlfilter.STRICT) & set(urlfilter.SOFT)) == 0


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Foo", None), ("foo", 2), ("bar", 1), ("bar", 3), ("baz", 1), ("", 5), (None, None)], "term string, weight int")
    assert urlfilter.read_terms(terms) == (["foo"], {"bar": 3, "baz": 1}) or sorted(urlfilter.read_terms(terms)[1].items()) == [("bar", 3), ("baz", 1)]
    got = urlfilter.judge(spark.createDataFrame([(1, "http://h/bar"), (2, "http://h/bar/baz"), (3, "http://foo.h/")], "page_id long, url string"), terms=terms)
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "allow", 2: "block", 3: "block"}


# --- the pipeline on odd tables
def _run(spark, df, path):
    import corpus_pipeline

    df.coalesce(1).write.parquet(f"{path}/documents.parquet")
    return corpus_pipeline.run(spark, str(path))


def test_pipeline_on_odd_rows(spark, odd, clash, none, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rows = _run(spark, odd, tmp_path / "odd").collect()
    texts = {r[0]: r[1] for r in ROWS if r[0] is not None}
    texts[9] = texts[9].replace("password=abcdefghijkl123", "[SECRET]")
    ids = [r["doc_id"] for r in rows]
    assert set(ids) <= {1, None, 7, 8, 9} and not {2, 3, 4, 5, 6} & set(ids)
    assert all(r["piece_ids"] == sp.encode(texts[r["doc_id"]]) for r in rows if r["doc_id"] is not None)
    wide = _run(spark, clash, tmp_path / "clash")
    assert wide.columns == [*[c for c in clash.columns if c != "text"], "piece_ids"]
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in wide.collect()) and all(r[c] == 1 for r in wide.collect() for c in CLASH)
    empty = _run(spark, none, tmp_path / "none")
    assert empty.count() == 0 and empty.columns == [*[c for c in none.columns if c != "text"], "piece_ids"]


def test_values_on_odd_rows(odd, clash):
    """What the operators promise of nulls, blanks, repeated rows and ties, with and without clashing columns."""
    for d in (odd, clash):
        mix = {r["doc_id"]: r for r in mixing.mix(d).collect()}
        assert all((mix[i]["size"], mix[i]["taken"], mix[i]["n_blocks"], mix[i]["first_slot"]) == (0, 0, 0, None) for i in (3, 4, 5))
        near = simhash.near_duplicates(d).collect()
        assert {r["component_id"] for r in near if r["doc_id"] in (1, 2)} == {1} and {r["fingerprint"] for r in near if r["doc_id"] in (3, 4, 5)} == {"0" * 16}
        assert {r["component_id"] for r in near if r["fingerprint"] == "0" * 16} == {3}
        found = {r["doc_id"]: r["secret_spans"] for r in secrets.scan(d).collect()}
        assert [x["kind"] for x in found[9]] == ["assign"] and not any(found[i] for i in (1, 3, 4, 5, 6, 7))
        spans = {r["doc_id"]: r["spans"] for r in pii.report(d).collect()}
        assert [x.split(":")[0] for x in spans[9].split(",")] == ["email", "phone", "ip", "card"] and not any(spans[i] for i in (1, 3, 4, 5, 6, 7, 8))
        lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(d, langid.fit(d, epochs=1)).collect()}
        assert all(lang[i] == ("und", 0.0) for i in (3, 4, 5, 6)) and lang[7][0] != "und"
        tiff = {r["doc_id"]: r for r in media_tiff.text_features(d).collect()}
        assert all((tiff[i]["n_bytes"], tiff[i]["payload_bytes"]) == (0, 64) for i in (3, 4)) and tiff[1]["media_sha256"] == tiff[2]["media_sha256"] != tiff[3]["media_sha256"]
        kn = {r["doc_id"]: r for r in kneser_ney.classify(d, trusted(d)).collect()}
        assert all((kn[i]["perplexity"], kn[i]["kept"]) == (None, False) for i in (3, 4, 5)) and kn[1]["perplexity"] == kn[2]["perplexity"] and kn[7]["n_words"] == 30000
        ids = {r["doc_id"]: r for r in pieces.round_trip(d).collect()}
        assert (ids[3]["piece_ids"], ids[3]["n_tokens"], ids[4]["piece_ids"], ids[4]["lossless"], ids[8]["lossless"]) == (None, 0, [], True, True)
        led = {r["doc_id"]: r for r in rules.apply_policy(rules.ledger(d)).collect()}
        assert all((led[i]["n_words"], led[i]["kept"]) == (0, False) for i in (3, 4, 5)) and (led[7]["n_repeat_words"], led[7]["kept"]) == (30000, False)


def test_folders_left_behind_are_cleared(spark):
    import os
    import time

    from tallyforge.llm import common

    kept = common.materialize(spark.range(3).toDF("x"), "kept")
    top = common.scratch_dir(spark).removeprefix("file://")
    for name, age in (("tallyforge-old", 9), ("tallyforge-new", 1), ("other-old", 9)):
        os.makedirs(f"{top}/{name}", exist_ok=True)
        os.utime(f"{top}/{name}", (time.time() - age * 86400,) * 2)
    assert common.clear_left(spark, 7) == ["tallyforge-old"] and common.clear_left(spark, 7) == []
    assert kept.count() == 3 and os.path.isdir(f"{top}/tallyforge-new") and os.path.isdir(f"{top}/other-old")
    common.release(kept)
