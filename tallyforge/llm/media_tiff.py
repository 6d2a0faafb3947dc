"""Media columns: TIFF. Walks image directories, decodes strips and tiles, undoes predictors, one row per page.

Reads both byte orders; compression none, PackBits, LZW or deflate; samples of 1, 8 or 16 bits, together or by planes; predictor 1, or 2 but for one bit.
Writes little-endian files with the same choices; texts are dealt evenly over compressions, predictors, strips and tiles. A page that cannot be decoded gives a row with ``error``.

Defined results: null text is as empty text, whose payload is 64 zero bytes. Every row of a text table gives one row, repeated rows too; equal
texts give equal values. Long texts go over as many pages as they need. Null blobs give no pages; an empty or broken blob gives a row with
``error``, and so does a page that claims more than 2**28 bytes of pixels, lacks parts, or is in a form that is not read. An empty table
gives no rows. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
SIZE_OF = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODE_OF = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of two and more equal bytes as a count and the byte, what is between them as it stands, 128 bytes at most each."""
    a, out, done = np.frombuffer(data, np.uint8), bytearray(), 0
    if not len(a):
        return b""
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    ends = np.append(starts[1:], len(a))
    runs = ends - starts > 1

    def plain(low, high):
        for k in range(low, high, 128):
            part = data[k : min(high, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for low, high in zip(starts[runs].tolist(), ends[runs].tolist()):
        plain(done, low)
        for k in range(low, high, 128):
            n = min(128, high - k)
            out += bytes((257 - n if n > 1 else 0, data[k]))
        done = high
    plain(done, len(a))
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first, widening one code early; 256 clears, 257 ends."""
    out, table, prev = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""], None
    width, held, bits = 9, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, prev = 9, None
            continue
        if prev is None:
            word = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            word = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + word[:1])
        out += word
        prev = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        if len(out) >= size:
            break
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, width, word = {bytes((i,)): i for i in range(256)}, 9, b""

    def put(code):
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    free = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = free
        free += 1
        if free == 4095:
            put(256)
            table, width, free = {bytes((k,)): k for k in range(256)}, 9, 258
        else:
            width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        word = data[i : i + 1]
    if word:
        put(table[word])
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _squeeze(raw: bytes, how: int) -> bytes:
    return {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}[how](raw)


def _expand(raw: bytes, how: int, size: int) -> bytes:
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(raw, max(1, size))  # no more than the part holds
    return {NONE: lambda x, _: x, PACKBITS: unpack_bits, LZW: lzw_decode}[how](raw, size)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 128, tile: int | None = None, planar: bool = False) -> bytes:
    """Pages (height x width or height x width x samples) as one file, in strips, or in square tiles of ``tile`` pixels.

    Booleans are stored as one-bit samples (without a predictor), uint8 and uint16 as they are; ``planar``: each sample's plane apart.
    """
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        a = page[:, :, None] if page.ndim == 2 else page
        h, w, s = a.shape
        bits, used = 1 if a.dtype == bool else 8 * a.dtype.itemsize, 1 if a.dtype == bool else predictor
        parts = []
        for plane in np.split(a, s, axis=2) if planar else [a]:
            if tile:
                ny, nx = -(-h // tile), -(-w // tile)
                full = np.zeros((ny * tile, nx * tile, plane.shape[2]), a.dtype)
                full[:h, :w] = plane
                parts += [full[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(ny) for x in range(nx)]
            else:
                parts += [plane[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        offsets, sizes = [], []
        for p in parts:
            if used == 2:
                p = np.concatenate([p[:, :1], np.diff(p, axis=1)], axis=1)
            p = np.packbits(p.reshape(len(p), -1), axis=1) if bits == 1 else np.ascontiguousarray(p).astype(p.dtype.newbyteorder("<"))
            raw = _squeeze(p.tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw
        tags = {WIDTH: [w], HEIGHT: [h], BITS: [bits] * s, COMPRESSION: [compression], PHOTOMETRIC: [2 if s >= 3 else 1], SAMPLES: [s], PLANAR: [2 if planar else 1], PREDICTOR: [used]}
        tags |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows_per_strip], STRIP_BYTES: sizes}
        entries = bytearray()
        for tag, values in sorted(tags.items()):
            short = tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR)
            body = struct.pack(f"<{len(values)}{'H' if short else 'I'}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                at = struct.pack("<I", len(out))
                out += body
            else:
                at = body.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, 3 if short else 4, len(values)) + at
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def directories(blob: bytes) -> list[dict[int, list[int]]]:
    """The tags of each image directory, in file order; a loop of directories ends the walk. Under 0: whether the file's high bytes come first."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None or struct.unpack(order + "H", blob[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    found, seen, at = [], set(), struct.unpack(order + "I", blob[4:8])[0]
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", blob, at)
        tags = {0: [int(order == ">")]}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * i)
            if kind not in CODE_OF:
                continue
            where = at + 10 + 12 * i
            if SIZE_OF[kind] * count > 4:
                (where,) = struct.unpack_from(order + "I", blob, where)
            tags[tag] = list(struct.unpack_from(f"{order}{count}{CODE_OF[kind]}", blob, where))
        found.append(tags)
        (at,) = struct.unpack_from(order + "I", blob, at + 2 + 12 * n)
    return found


def first(tags: dict[int, list[int]], tag: int, default=None):
    """A tag's first value; the default where it is absent or empty."""
    return (tags.get(tag) or [default])[0]


def decode_page(blob: bytes, tags: dict[int, list[int]], most_bytes: int = 1 << 28) -> np.ndarray:
    """Pixels of one directory: height x width x samples. A page that claims more than ``most_bytes`` of pixels is refused."""
    w, h, s = (first(tags, t, d) for t, d in ((WIDTH, 0), (HEIGHT, 0), (SAMPLES, 1)))
    if min(w, h, s) < 1 or w * h * s > most_bytes:
        raise ValueError(f"{w} x {h} pixels of {s} samples")
    bits, planar = set(tags.get(BITS, [1])), first(tags, PLANAR, 1)
    if len(bits) != 1 or not bits <= {1, 8, 16} or planar not in (1, 2):
        raise ValueError("only samples of one, eight or sixteen bits are read, together or by planes")
    bits, planes, each = bits.pop(), s if planar == 2 else 1, 1 if planar == 2 else s
    how, predictor = first(tags, COMPRESSION, NONE), first(tags, PREDICTOR, 1)
    tiled = TILE_OFFSETS in tags
    ph, pw = (first(tags, TILE_LENGTH, 0), first(tags, TILE_WIDTH, 0)) if tiled else (min(h, first(tags, ROWS_PER_STRIP, h)), w)
    if min(ph, pw) < 1 or ph * pw * s > most_bytes:
        raise ValueError(f"parts of {pw} x {ph} pixels")
    across, down = -(-w // pw), -(-h // ph)
    parts = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES]))
    if len(parts) != across * down * planes:
        raise ValueError(f"{len(parts)} parts for {across * down * planes}")
    kind = np.dtype(np.uint16 if bits == 16 else np.uint8)
    stored = kind.newbyteorder(">" if first(tags, 0, 0) else "<")
    row_bytes = -(-pw * each * bits // 8)
    out = np.zeros((h, w, s), kind)
    for i, (at, n) in enumerate(parts):
        plane, i = divmod(i, across * down)
        y, x = i // across * ph, i % across * pw
        rows = ph if tiled else min(ph, h - y)
        raw = _expand(blob[at : at + n], how, rows * row_bytes)
        a = np.frombuffer(raw, stored, rows * row_bytes // kind.itemsize).reshape(rows, -1)
        if bits == 1:
            a = np.unpackbits(a, axis=1)[:, : pw * each]
        a = a.reshape(rows, pw, each)
        if predictor == 2 and bits > 1:
            a = np.cumsum(a, axis=1, dtype=kind)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} of samples of {bits} bits")
        out[y : y + rows, x : x + pw, plane : plane + each] = a[: h - y, : w - x]
    return out


def page_hash(a: np.ndarray) -> str:
    """64-bit average hash: an 8 x 8 grid of means against their mean."""
    g = a.reshape(a.shape[0], -1).astype(np.float64)
    rows = np.linspace(0, g.shape[0], 9).astype(int)[:-1]
    cols = np.linspace(0, g.shape[1], 9).astype(int)[:-1]
    sums = np.add.reduceat(np.add.reduceat(g, np.minimum(rows, g.shape[0] - 1), axis=0), np.minimum(cols, g.shape[1] - 1), axis=1)
    return np.packbits((sums > sums.mean()).ravel()).tobytes().hex()


def _slices(batches, rows: int = 64):
    """Batches in pieces of some rows: texts and files stand in Python's memory by the piece, not by Spark's batch."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def pages(media: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """One row a page: (id, page, width, height, samples, compression, predictor, tiled, n_bytes, mean, page_hash, error)."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in _slices(batches):
            rows = []
            for key, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if blob is None:
                    continue
                try:
                    dirs = directories(blob)
                except (ValueError, struct.error, IndexError, MemoryError) as e:
                    rows.append((key, 0, None, None, None, None, None, None, None, None, None, str(e) or repr(e)))
                    continue
                for i, t in enumerate(dirs):
                    head = (key, i, *[first(t, x, d) for x, d in ((WIDTH, None), (HEIGHT, None), (SAMPLES, 1), (COMPRESSION, 1), (PREDICTOR, 1))], TILE_OFFSETS in t)
                    try:
                        a = decode_page(blob, t)
                        rows.append((*head, a.nbytes, float(a.mean()), page_hash(a), None))
                    except (ValueError, KeyError, TypeError, struct.error, zlib.error, IndexError, MemoryError) as e:
                        rows.append((*head, None, None, None, repr(e)))
            cols = list(zip(*rows)) or [()] * 12
            types = [b.schema[0].type, pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "page", "width", "height", "samples", "compression", "predictor", "tiled", "n_bytes", "mean", "page_hash", "error"])

    return media.select(F.col(id_col), F.col(blob_col)).mapInArrow(run, f"id {kind}, page int, width bigint, height bigint, samples bigint, compression bigint, predictor bigint, tiled boolean, n_bytes bigint, mean double, page_hash string, error string")


#: Forms (compression, predictor, tile), one for each remainder of the payload's CRC.
FORMS = ((DEFLATE, 2, None), (DEFLATE, 1, 64), (LZW, 2, 64), (LZW, 1, None), (PACKBITS, 2, None), (PACKBITS, 1, 64), (NONE, 2, None), (NONE, 1, 64))


def store_text(text: str | None, width: int = 64, page_rows: int = 4096, compression: int | None = None) -> tuple[int, bytes]:
    """UTF-8 length, and a file whose pages hold the zero-padded bytes as 8-bit samples; without a ``compression`` the payload chooses the form."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + b"\0" * (-len(raw) % width if raw else width)
    grid = np.frombuffer(padded, np.uint8).reshape(-1, width)
    how, predictor, tile = (compression, 2, None) if compression else FORMS[zlib.crc32(padded) % len(FORMS)]
    return len(raw), write_tiff([grid[i : i + page_rows] for i in range(0, len(grid), page_rows)], how, predictor, tile=tile)


def text_media(docs: DataFrame, id_col="doc_id", text_col="text", compression: int | None = None) -> DataFrame:
    """(id, n_bytes, media): each text stored as a TIFF file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in _slices(batches):
            made = [store_text(t, compression=compression) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], [id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, media binary")


def text_features(docs: DataFrame, id_col="doc_id", text_col="text", compression: int | None = None) -> DataFrame:
    """Store each text, read the stored bytes back page by page, and describe what was read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def describe(text):
        n, blob = store_text(text, compression=compression)
        read = [decode_page(blob, t) for t in directories(blob)]
        payload = b"".join(a.tobytes() for a in read)
        feature = f"{len(read)}:" + ",".join(page_hash(a) for a in read) + f":{sum(int(a.sum(dtype=np.int64)) for a in read) / len(payload):.4f}"
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            cols = list(zip(*map(describe, b.column(1).to_pylist()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", *names])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
