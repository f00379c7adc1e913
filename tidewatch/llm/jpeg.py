"""Media columns: baseline JPEG files, written, stored in a binary column, and decoded in numpy.

``decode`` reads baseline files of any sampling, tables and restart interval: it parses the markers, removes
the stuffing, and decodes the Huffman codes of all entropy-coded segments of a batch of files in step, one
coefficient of every segment at a time. The luminance DC terms alone make the thumbnail (a pixel for each
block of 8 x 8), and the thumbnail's difference hash is the picture's feature.

``encode`` stores bytes as quantised DCT coefficients, the format's unit: 192 bytes are the three blocks of
one MCU, byte b is the coefficient b + 256, and every MCU is a restart interval. All coefficients then have
category 9, so code and value take 16 bits. Entropy coding loses nothing; the payload is what decoding gives.

Defined results: a null text counts as empty and gives one MCU of spaces; equal bytes give equal files; a file
that is no baseline JPEG (or ends too early) has null dimensions and hash; a null file too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.words import slices
from tidewatch.sources.scratch import cut

UNIT = 192
_LIFT, _CATEGORY, _CODE_BITS = 256, 9, 7


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def encode(payload: bytes) -> bytes:
    """A baseline JPEG file whose coefficients are the payload, whose length is a positive multiple of 192."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    n = len(payload) // UNIT
    across = int(np.ceil(np.sqrt(n)))
    down = -(-n // across)
    table = bytes(_CODE_BITS - 1) + b"\x01" + bytes(16 - _CODE_BITS) + bytes([_CATEGORY])
    head = b"".join([
        b"\xff\xd8",
        _marker(0xFE, struct.pack(">Q", len(payload))),
        _marker(0xDB, b"\x00" + b"\x01" * 64),
        _marker(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _marker(0xC4, b"\x00" + table + b"\x10" + table),
        _marker(0xDD, struct.pack(">H", 1)),
        _marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
    ])
    units = np.full((across * down, UNIT), 0x20, np.uint8)
    units[:n] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    scan = np.full((len(units), 2 * UNIT + 2), 1, np.uint8)
    scan[:, 1 : 2 * UNIT : 2] = units
    scan[:, -2] = 0xFF
    scan[:, -1] = 0xD0 + np.arange(len(units)) % 8
    if (units == 0xFF).any():
        body = b"".join(row[:-2].tobytes().replace(b"\xff", b"\xff\x00") + row[-2:].tobytes() for row in scan)
    else:
        body = scan.tobytes()
    return head + body[:-2] + b"\xff\xd9"


@dataclass
class Picture:
    """What the markers of a file say, and its entropy-coded segments."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, table
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, bytes] = field(default_factory=dict)  # class and number: lengths and symbols
    restart: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC table, AC table
    comment: bytes = b""
    segments: list[np.ndarray] = field(default_factory=list)

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Picture:
    """Reads the markers of a baseline file. ValueError if it is none."""
    out, at = Picture(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    try:
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            mark, code = data[at], data[at + 1]
            (size,) = struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if mark != 0xFF or len(body) != size - 2:
                raise ValueError("broken marker")
            if code == 0xFE:
                out.comment = body
            elif code == 0xDB:
                while body:
                    wide = body[0] >> 4
                    out.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif code == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    out.codes[body[0]] = body[1:n]
                    body = body[n:]
            elif code in (0xC0, 0xC1):
                bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not out.width or not out.height:
                    raise ValueError("not 8-bit baseline")
                out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= code <= 0xCF and code != 0xC8 and code != 0xCC:
                raise ValueError("not baseline")
            elif code == 0xDD:
                (out.restart,) = struct.unpack(">H", body)
            elif code == 0xDA:
                ids = [c[0] for c in out.components]
                out.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])]
                break
    except (IndexError, struct.error) as e:
        raise ValueError("cut off") from e
    if len(out.scan) != len(out.components) or any(k not in out.codes for _, a, b in out.scan for k in (a, b)) or any(c[3] not in out.quantisers or not (0 < c[1] < 5 and 0 < c[2] < 5) for c in out.components):
        raise ValueError("not one interleaved scan with all its tables")
    raw = np.frombuffer(data, np.uint8)[at:]
    mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0))
    mark = mark[(raw[mark + 1] != 0xFF)]
    stop = mark[(raw[mark + 1] < 0xD0) | (raw[mark + 1] > 0xD7)]
    end = int(stop[0]) if len(stop) else len(raw)
    cuts = mark[mark < end]
    for a, b in zip([0, *(cuts + 2).tolist()], [*cuts.tolist(), end], strict=True):
        part = raw[a:b]
        stuffed = np.flatnonzero((part[:-1] == 0xFF) & (part[1:] == 0)) + 1 if len(part) else part
        out.segments.append(np.delete(part, stuffed) if len(stuffed) else part)
    return out


def _lookup(code: bytes) -> np.ndarray:
    """For each 16 bits: the length of the code they begin with, times 256, plus its symbol; 0 if there is none."""
    out, at, k = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(code[length - 1]):
            width = 1 << (16 - length)
            out[at : at + width] = length << 8 | code[k]
            at, k = at + width, k + 1
    return out


def _coefficients(pictures: list[Picture]) -> list[np.ndarray | None]:
    """Coefficients (MCU, block of the MCU, 64 in zigzag order) of pictures with the same tables and sampling."""
    first = pictures[0]
    tables = {k: _lookup(v) for k, v in first.codes.items()}
    order = [(i, dc, ac) for i, dc, ac in first.scan for _ in range(first.components[i][1] * first.components[i][2])]
    counts = []
    for p in pictures:
        total = p.mcus[0] * p.mcus[1]
        step = p.restart or total
        own = [min(step, total - k * step) for k in range(-(-total // step))]
        p.segments = (p.segments + [np.zeros(0, np.uint8)] * len(own))[: len(own)]
        counts.append(own)
    number = np.array([c for own in counts for c in own], np.int64)
    parts = [s for p in pictures for s in p.segments]
    size = np.array([len(s) + 8 for s in parts], np.int64)
    start = np.cumsum(size) - size
    raw = np.zeros(int(size.sum()) + 16, np.uint8)
    for s, at in zip(parts, start.tolist(), strict=True):
        raw[at : at + len(s)] = s
    view = np.ndarray(len(raw) - 8, ">u8", raw, strides=(1,))
    limit, position = (start + size - 8) * 8, start * 8
    base = np.cumsum(number) - number
    out = np.zeros((int(number.sum()), len(order), 64), np.int16)
    bad = np.zeros(len(parts), bool)
    predicted = np.zeros((len(parts), len(first.components)), np.int64)

    def symbol(active: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next symbol of the active segments, and the value of as many bits as its low four say, sign extended."""
        at = position[active]
        word = view[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        found = table[(word >> np.uint64(48)).astype(np.int64)]
        length, sign = found >> 8, found & 255
        bits = sign & 15
        rest = word << length.astype(np.uint64)
        value = np.where(bits > 0, (rest >> np.uint64(32)).astype(np.int64) >> (32 - bits), 0)
        value -= np.where((bits > 0) & (value < (1 << np.maximum(bits - 1, 0))), (1 << bits) - 1, 0)
        position[active] = np.minimum(at + length + bits, limit[active])
        bad[active] |= (length == 0) | (at + length + bits > limit[active])
        return sign, value

    for mcu in range(int(number.max())):
        running = np.flatnonzero((number > mcu) & ~bad)
        for b, (i, dc, ac) in enumerate(order):
            _, value = symbol(running, tables[dc])
            predicted[running, i] += value
            out[base[running] + mcu, b, 0] = predicted[running, i]
            active, k = running, np.zeros(len(running), np.int64)
            while len(active):
                sign, value = symbol(active, tables[ac])
                skip, bits = sign >> 4, sign & 15
                k = np.where(bits > 0, k + skip + 1, np.where(skip == 15, k + 16, 64))
                fits = k < 64
                written = fits & (bits > 0)
                out[base[active[written]] + mcu, b, k[written]] = value[written]
                go = (k < 63) & ~bad[active]
                active, k = active[go], k[go]
    result, m, s = [], 0, 0
    for own in counts:
        broken = bad[s : s + len(own)].any()
        result.append(None if broken else out[m : m + sum(own)])
        m, s = m + sum(own), s + len(own)
    return result


def thumbnail(picture: Picture, coefficients: np.ndarray) -> np.ndarray:
    """Luminance at one pixel for each 8 x 8 block, from the DC terms of the first component."""
    across, down = picture.mcus
    _, h, v, q = picture.components[picture.scan[0][0]]
    dc = coefficients[:, : h * v, 0].astype(np.int64) * picture.quantisers[q][0]
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    top_h, top_v = max(c[1] for c in picture.components), max(c[2] for c in picture.components)
    rows, cols = -(-picture.height * v // (8 * top_v)), -(-picture.width * h // (8 * top_h))
    return np.clip((grid[:rows, :cols] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> int:
    """64 bits: which of 8 x 9 area means is less than its right neighbour."""
    def means(x: np.ndarray, n: int) -> np.ndarray:
        edge = np.arange(n + 1) * len(x) // n
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        low, high = np.minimum(edge[:-1], len(x) - 1), np.maximum(edge[1:], np.minimum(edge[:-1], len(x) - 1) + 1)
        return (total[high] - total[low]) / (high - low)[(...,) + (None,) * (x.ndim - 1)]

    small = means(means(image.astype(np.float64), 8).T, 9).T
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def decode(files: list[bytes | None]) -> list[tuple[Picture, np.ndarray] | None]:
    """Picture and coefficients of each file, or None where it is no whole baseline JPEG."""
    out: list[tuple[Picture, np.ndarray] | None] = [None] * len(files)
    groups: dict[tuple, list[tuple[int, Picture]]] = {}
    for i, data in enumerate(files):
        try:
            p = parse(data or b"")
        except ValueError:
            continue
        key = (tuple(p.components), tuple(p.scan), tuple(sorted(p.codes.items())))
        groups.setdefault(key, []).append((i, p))
    for group in groups.values():
        for (i, p), c in zip(group, _coefficients([p for _, p in group]), strict=True):
            out[i] = None if c is None else (p, c)
    return out


def payload_of(picture: Picture, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored."""
    (n,) = struct.unpack(">Q", picture.comment)
    return (coefficients.reshape(-1)[:n] - _LIFT).astype(np.uint8).tobytes()


def _groups(column: pa.Array, limit: int = 4_000_000) -> Iterator[pa.Array]:
    yield from slices(column, limit)


def media_features(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with width, height and thumb_hash (16 hexadecimal digits) of the JPEG files in a binary column."""
    schema = ", ".join(f"`{c}` {t}" for c, t in media.dtypes) + ", width int, height int, thumb_hash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for part in _groups(batch.column(column)) for x in decode(part.to_pylist())]
            more = [(p.width, p.height, f"{difference_hash(thumbnail(p, c)):016x}") if x else (None,) * 3 for x in found for p, c in [x or (None, None)]]
            columns = [pa.array([m[k] for m in more], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "width", "height", "thumb_hash"])

    return media.mapInArrow(run, schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 bytes of each text, padded with spaces, as a JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            for part in _groups(texts):
                raw = [(t or "").encode() for t in part.to_pylist()]
                files = [encode(r + b" " * (-len(r) % UNIT or (0 if r else UNIT))) for r in raw]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(raw)), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])
                at += len(raw)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores the texts as JPEG files in a table, reads them back, and returns sizes, hashes and features."""
    media = cut(store_texts(docs), "media")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, at = batch.column("doc_id"), batch.column("n_bytes"), 0
            for part in _groups(batch.column("media")):
                files = part.to_pylist()
                rows = []
                for data, (p, c) in zip(files, decode(files), strict=True):
                    own = payload_of(p, c)
                    feature = f"{p.width}x{p.height}:{difference_hash(thumbnail(p, c)):016x}"
                    rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                columns = [pa.array(list(x)) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(files)).cast(pa.int64()), sizes.slice(at, len(files)), *columns], [x.split()[0] for x in schema.split(", ")])
                at += len(files)

    return media.mapInArrow(run, schema)
