import hashlib
import struct
import zlib

import numpy as np

from tidewatch.llm.jpeg import decode, difference_hash, encode, media_digest, media_features, payload_of, thumbnail

#: The luminance tables of Annex K of the JPEG standard (fixed values): code counts and symbols.
DC_BITS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))


def write_jpeg(blocks, width, height, restart=0, sampling=(1,)):
    """A plain bit-by-bit baseline encoder: blocks (MCU, block, 64 in zigzag order) of one or more components."""
    symbols = [0x00, 0xF0, *(r << 4 | s for s in range(1, 11) for r in range(16))]
    ac_bits = [0] * 16
    ac_bits[7], ac_bits[11] = 100, len(symbols) - 100
    dc = {s: f"{c:0{n}b}" for s, c, n in canonical(DC_BITS, DC_SYMBOLS)}
    ac = {s: f"{c:0{n}b}" for s, c, n in canonical(ac_bits, symbols)}

    def number(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    owner = [i for i, hv in enumerate(sampling) for _ in range(hv * hv)]
    scan, bits, before = b"", "", [0] * len(sampling)

    def closed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for m, mcu in enumerate(blocks):
        if restart and m and m % restart == 0:
            scan += closed(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, before = "", [0] * len(sampling)
        for i, block in zip(owner, mcu, strict=True):
            n, extra = number(int(block[0]) - before[i])
            before[i] = int(block[0])
            bits += dc[n] + extra
            run = 0
            last = max((k for k in range(1, 64) if block[k]), default=0)
            for k in range(1, last + 1):
                if block[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits += ac[0xF0]
                    run -= 16
                n, extra = number(int(block[k]))
                bits += ac[run << 4 | n] + extra
                run = 0
            if last < 63:
                bits += ac[0]
    scan += closed(bits)
    part = lambda code, body: struct.pack(">BBH", 255, code, len(body) + 2) + body
    table = lambda k, b, s: bytes([k, *b, *s])
    frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, hv << 4 | hv, 0]) for i, hv in enumerate(sampling))
    return (b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, b"\0" + bytes([8] + [3] * 63)) + part(0xC0, frame) + part(0xC4, table(0, DC_BITS, DC_SYMBOLS) + table(0x10, ac_bits, symbols))
            + (part(0xDD, struct.pack(">H", restart)) if restart else b"") + part(0xDA, bytes([len(sampling)] + [x for i in range(len(sampling)) for x in (i + 1, 0)] + [0, 63, 0])) + scan + b"\xff\xd9")


def canonical(bits, symbols):
    code, k = 0, 0
    for n, count in enumerate(bits, 1):
        for _ in range(count):
            yield symbols[k], code, n
            code, k = code + 1, k + 1
        code <<= 1


def test_foreign_files():
    """Any sampling, restart interval and run of zeros, decoded together."""
    rng = np.random.default_rng(1)
    files, want = [], []
    for width, height, restart, sampling in ((24, 16, 0, (1,)), (64, 40, 3, (1, 1, 1)), (40, 24, 2, (2, 1, 1)), (8, 8, 0, (1,)), (100, 60, 0, (2, 1, 1))):
        top = max(sampling)
        n = -(-width // (8 * top)) * -(-height // (8 * top))
        blocks = rng.integers(-500, 500, (n, sum(h * h for h in sampling), 64)) * (rng.random((n, sum(h * h for h in sampling), 64)) < 0.15)
        blocks[:, :, 0] = rng.integers(-100, 100, blocks.shape[:2])
        files.append(write_jpeg(blocks, width, height, restart, sampling))
        want.append((width, height, blocks))
    for (picture, got), (width, height, blocks) in zip(decode(files), want, strict=True):
        assert (picture.width, picture.height) == (width, height)
        assert np.array_equal(got, blocks)
    small = thumbnail(*decode(files[:1])[0])
    assert small.shape == (2, 3) and np.array_equal(small.ravel(), np.clip(want[0][2][:, 0, 0] + 128, 0, 255))
    assert decode([None, b"", b"\xff\xd8\xff", b"GIF89a", files[0][:-10], files[0][:100]]) == [None] * 6


def test_payload_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 50):
        payload = rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes()
        (found,) = decode([encode(payload)])
        assert payload_of(*found) == payload


def test_digest(spark, edge_docs, docs, no_docs):
    for df in (edge_docs, docs):
        text = {r.doc_id: (r.text or "").encode() for r in df.select("doc_id", "text").collect()}
        rows = media_digest(df).collect()
        assert len(rows) == len(text)
        for r in rows:
            raw = text[r.doc_id]
            payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
            assert r.media_sha256 == hashlib.sha256(encode(payload)).hexdigest() and r.media_bytes == len(encode(payload))
    assert media_digest(no_docs).count() == 0


def test_media_column(spark):
    files = [encode(b"a" * 1920), None, b"none", encode(b"a" * 1920)]
    rows = media_features(spark.createDataFrame([(i, f, "x") for i, f in enumerate(files)], "id int, media binary, note string")).orderBy("id").collect()
    assert [(r.width, r.height) for r in rows] == [(32, 24), (None, None), (None, None), (32, 24)]
    assert rows[0].thumb_hash == rows[3].thumb_hash and rows[1].thumb_hash is None


def test_hash_sees_gradients():
    up = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    assert difference_hash(up) == 2**64 - 1 and difference_hash(up[:, ::-1]) == 0
