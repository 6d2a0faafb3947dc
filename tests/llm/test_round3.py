"""Later additions to earlier operators: kinds of TIFF samples, even forms, redaction of many spans, many languages."""

import collections
import time
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyforge.llm import langid, media_tiff, secrets


@pytest.mark.parametrize("kind", [bool, np.uint8, np.uint16])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("how", [media_tiff.NONE, media_tiff.PACKBITS, media_tiff.LZW, media_tiff.DEFLATE])
@pytest.mark.parametrize("tile", [None, 16])
def test_samples_of_all_kinds(kind, planar, how, tile):
    rnd = np.random.default_rng(3)
    pages = [rnd.integers(0, 2, (37, 53)).astype(bool) if kind is bool else rnd.integers(0, np.iinfo(kind).max, (37, 53, 3)).astype(kind), np.zeros((5, 9, 2), kind)]
    for predictor in (1, 2):
        blob = media_tiff.write_tiff(pages, how, predictor, rows_per_strip=8, tile=tile, planar=planar)
        read = [media_tiff.decode_page(blob, t) for t in media_tiff.directories(blob)]
        assert all((a.reshape(b.shape) == b).all() for a, b in zip(pages, read))


def test_big_endian_sixteen_bits():
    import struct

    a = np.array([[1, 300], [65535, 2]], np.uint16)
    data = a.astype(">u2").tobytes()
    tags = [(256, 3, 1, 2 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (273, 4, 1, 8), (279, 4, 1, len(data))]
    blob = b"MM\0*" + struct.pack(">I", 8 + len(data)) + data + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0"
    assert (media_tiff.decode_page(blob, media_tiff.directories(blob)[0])[:, :, 0] == a).all()


def test_packbits_by_runs():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 127, 128, 129, 257, 3000):
        for spread in (1, 2, 200):
            raw = np.repeat(rnd.integers(0, spread, n).astype(np.uint8), rnd.integers(1, 4, n)).tobytes()
            packed = media_tiff.pack_bits(raw)
            assert media_tiff.unpack_bits(packed, len(raw)) == raw and len(packed) <= len(raw) + len(raw) // 128 + 1 + (len(raw) > 0)


def test_forms_are_dealt_evenly():
    seen = collections.Counter()
    for i in range(800):
        n, blob = media_tiff.store_text(f"text {i} " * 3)
        t = media_tiff.directories(blob)[0]
        seen[t[media_tiff.COMPRESSION][0], media_tiff.first(t, media_tiff.PREDICTOR), media_tiff.TILE_OFFSETS in t] += 1
        assert b"".join(media_tiff.decode_page(blob, x).tobytes() for x in media_tiff.directories(blob))[:n] == (f"text {i} " * 3).encode()
    assert len(seen) == 8 and min(seen.values()) > 60


def test_pages_of_media(spark, odd):
    rows = media_tiff.pages(media_tiff.text_media(odd), "doc_id", "media").collect()
    assert all(r["error"] is None for r in rows) and {r["id"] for r in rows} == {r["doc_id"] for r in odd.collect()}


def test_redaction_of_many_secrets(spark):
    """Positions on both sides of part limits, characters of several bytes between, 6,000 secrets in one text."""
    gap = ["é" * (i % 97) + "😀" + " x" * (i % 31) for i in range(6000)]
    text = "".join(f"{g} AKIA{'ABCDEFGHIJ'}{i:08d} " for i, g in enumerate(gap))
    want = "".join(f"{g} [SECRET] " for g in gap)
    docs = spark.createDataFrame([(1, text, len(text)), (2, "AKIA" + "Z" * 20, 24), (3, "nothing", 7), (4, None, None), (5, "", 0)], "doc_id long, text string, n_chars long")
    began = time.time()
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(docs).collect()}
    assert got == {1: (want, len(want)), 2: ("[SECRET]", 8), 3: ("nothing", 7), 4: (None, None), 5: ("", 0)}
    assert time.time() - began < 60


def test_more_languages_than_two_hundred(spark):
    names = [f"l{i:03d}" for i in range(230)]
    docs = spark.createDataFrame([(i, f"{n} {chr(0x4E00 + j) * 8} words", n) for j, n in enumerate(names) for i in (2 * j, 2 * j + 1)], "doc_id long, text string, lang string")
    model = langid.fit(docs, epochs=1)
    assert list(model["langs"]) == names
    assert len(langid.fit(docs, epochs=1, max_langs=3)["langs"]) == 3
