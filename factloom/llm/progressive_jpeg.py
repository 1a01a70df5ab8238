"""Media columns: progressive JPEG written and read with numpy.

Storage. A payload byte b becomes the quantised coefficient that JPEG itself
writes as the eight extra bits b: b for b >= 128, else b - 255. Every coefficient
is of size category 8, so nothing is lost and nothing is zero. Blocks fill a
4:2:0 image: four luma blocks, one Cb and one Cr block a unit of 384 bytes; the
grid is filled up with byte 32 and the payload's length stands in a comment
segment. For each component the stream holds a DC scan, two spectral bands of AC
scans down to bit 1, and a successive-approximation scan for the last bit.

Reading. ``read_coefficients`` accepts any progressive Huffman JPEG of 8-bit
samples: scans accumulate into one coefficient array for each component. Where a
scan's Huffman table has a single symbol its fields lie at fixed places, so they
are unpacked for all blocks at once; other scans go bit by bit. Both ways end in
the same arrays. ``to_rgb`` dequantises, inverse-transforms with exact integer
arithmetic (in float64, below 2**53), repeats chroma up to full resolution and
returns uint8 RGB, so equal bytes give equal pixels on every machine.

Defined cases: null text is the empty text, which stores one block row of spaces.
Equal texts give equal rows, repeated rows repeat, extra columns are ignored, an
empty table gives an empty result. Memory is bounded by one text's arrays.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import map_rows, table, texts

UNIT, MULTIPLE, FILL = 384, 192, 32
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
TENSOR_SCHEMA = SCHEMA + ", media binary, rgb binary"


def _zigzag() -> np.ndarray:
    """Natural index of each place in the zigzag order, from its rule."""
    places = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in places])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Zigzag coefficients to samples, scaled by 4096, as whole float64 numbers."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(0.125), 0.5)
    return np.rint(4096 * np.einsum("ux,vy->uvxy", one, one).reshape(64, 64))[ZIGZAG]


BASIS = _basis()
# What chroma adds to each colour, in 65536ths, rounded; from 1.402, 0.344136, 0.714136 and 1.772.
_CHROMA = np.arange(256) - 128
_RED, _BLUE = ((_CHROMA * k + 32768 >> 16).astype(np.int16) for k in (91881, 116130))
_GREEN_CB, _GREEN_CR = (-22554 * _CHROMA).astype(np.int32), (32768 - 46802 * _CHROMA).astype(np.int32)


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _one_symbol(kind: int, symbol: int) -> bytes:
    """A Huffman table with the single code 0."""
    return _segment(0xC4, bytes((kind << 4, 1, *[0] * 15, symbol)))


def _scan(components: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes((len(components), *(x for c in components for x in (c, 0)), first, last, high << 4 | low)))


def grid(payload_bytes: int) -> tuple[int, int]:
    """Units across and down for a payload."""
    units = -(-payload_bytes // UNIT)
    across = min(units, 64) if units <= 64 * 4095 else 4095
    return across, -(-units // across)


def write_payload(payload: bytes) -> bytes:
    across, down = grid(len(payload))
    n = across * down
    filled = np.full(n * UNIT, FILL, np.uint8)
    filled[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = filled.reshape(-1, 64)
    parts = blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :]
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xDB, bytes((0, *[1] * 64)))]
    frame = bytes((8,)) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes((3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    out.append(_segment(0xC2, frame))
    # DC: each block restarts the prediction, so a difference is the value itself:
    # code 0, eight extra bits and seven ones make two bytes.
    out += [_one_symbol(0, 8), _segment(0xDD, b"\0\1")]
    for c, part in enumerate(parts):
        coded = np.zeros((len(part), 5), np.uint8)
        coded[:, 0] = part[:, 0] >> 1
        coded[:, 1] = part[:, 0] << 7 | 0x7F
        coded[:, 3] = 0xFF
        coded[:, 4] = 0xD0 + np.arange(len(part)) % 8
        kept = np.ones((len(part), 5), bool)
        kept[:, 2] = coded[:, 1] == 0xFF  # a zero is stuffed after 0xFF
        out += [_scan((c + 1,), 0, 0, 0, 0), coded[kept][:-2].tobytes()]
    out.append(_segment(0xDD, b"\0\0"))
    # AC at bit 1: code 0 and seven extra bits make one byte, which is never 0xFF.
    out.append(_one_symbol(1, 0x07))
    for first, last in ((1, 5), (6, 63)):
        for c, part in enumerate(parts):
            out += [_scan((c + 1,), first, last, 0, 1), (part[:, first : last + 1] >> 1).tobytes()]
    # The last bit: an end-of-band code 0 and 63 correction bits a block.
    out.append(_one_symbol(1, 0x00))
    for c, part in enumerate(parts):
        low = (part & 1) ^ (part < 128)
        low[:, 0] = 0
        out += [_scan((c + 1,), 1, 63, 1, 0), np.packbits(low.reshape(-1)).tobytes().replace(b"\xff", b"\xff\0")]
    out.append(b"\xff\xd9")
    return b"".join(out)


# ---------------------------------------------------------------- reading


_SCAN_END = re.compile(rb"\xff[^\0\xd0-\xd7]", re.DOTALL)
_EXTENDED = [np.array([v if not size or v >> (size - 1) else v - (1 << size) + 1 for v in range(256)], np.int16) for size in range(9)]


class BadImage(ValueError):
    """The bytes are not a progressive JPEG that can be read."""


@dataclass
class Component:
    ident: int
    across: int
    down: int
    table: int
    wide: int = 0
    high: int = 0
    own_wide: int = 0
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]
    comments: list[bytes]


class _Table:
    """A canonical Huffman table; ``only`` is its symbol if it has just one, of one bit."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.only = symbols[0] if counts[0] == 1 and at == 1 else None


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | b
        if self.at + n > len(self.bits):
            raise BadImage("a scan ends early")
        self.at += n
        return value

    def symbol(self, table: _Table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := table.codes.get((length, code))) is not None:
                return found
        raise BadImage("no such code")

    def extended(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _ac_first(bits: _Bits, block: np.ndarray, first: int, last: int, low: int, table: _Table, run: int) -> int:
    if run:
        return run - 1
    k = first
    while k <= last:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            if k > last:
                raise BadImage("a band overflows")
            block[k] = bits.extended(size) << low
        elif zeros < 15:
            return (1 << zeros) - 1 + bits.take(zeros)
        else:
            k += 15
        k += 1
    return 0


def _ac_refine(bits: _Bits, block: np.ndarray, first: int, last: int, low: int, table: _Table, run: int) -> int:
    step, k = 1 << low, first

    def correct(at: int) -> None:
        if bits.take(1):
            block[at] += step if block[at] > 0 else -step

    while not run and k <= last:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if not size and zeros < 15:
            run = (1 << zeros) + bits.take(zeros)
            break
        value = (step if bits.take(1) else -step) if size else 0
        while k <= last:
            if block[k]:
                correct(k)
            elif zeros:
                zeros -= 1
            else:
                if value:
                    block[k] = value
                k += 1
                break
            k += 1
    if run:
        for at in range(k, last + 1):
            if block[at]:
                correct(at)
        run -= 1
    return run


def _extend_all(values: np.ndarray, size: int) -> np.ndarray:
    """As _Bits.extended, for whole arrays of codes of at most 8 bits."""
    return _EXTENDED[size][values]


def _read_scan(body: bytes, image: Image, order: list[tuple[Component, int, int]], first: int, last: int, high: int, low: int, dc: dict, ac: dict, restart: int) -> None:
    alone = len(order) == 1
    comp, dc_at, ac_at = order[0]
    if not first and not alone:
        mcu_wide, mcu_high = comp.wide // comp.across, comp.high // comp.down
        units = mcu_wide * mcu_high
    else:
        mcu_wide, mcu_high = comp.own_wide, comp.own_high
        units = mcu_wide * mcu_high
    whole = comp.own_wide == comp.wide and comp.own_high == comp.high
    # Fields at fixed places, for all blocks at once.
    if not first and not high and restart == 1 and alone and whole and (only := dc[dc_at].only) is not None and 0 < only <= 8:
        raw = np.frombuffer(body, np.uint8)
        dropped = np.zeros(len(raw), bool)
        full = np.flatnonzero(raw[:-1] == 0xFF)
        dropped[full + 1] = True  # a stuffed zero or a restart code
        dropped[full[(raw[full + 1] & 0xF8) == 0xD0]] = True
        kept, size = raw[~dropped], 1 + (only > 7)
        if len(kept) == units * size:
            kept = kept.reshape(units, size).astype(np.int16)
            whole_field = kept[:, 0] << 8 | (kept[:, 1] if size == 2 else 0)
            comp.coefficients[:, 0] = _extend_all(whole_field >> (15 - only) & (1 << only) - 1, only) << low
            return
    if first and alone and whole and not restart and (only := ac[ac_at].only) is not None:
        raw = np.frombuffer(body.replace(b"\xff\0", b"\xff"), np.uint8)
        band = last - first + 1
        if not high and only == 0x07 and len(raw) == units * band:
            comp.coefficients[:, first : last + 1] = _extend_all(raw.reshape(units, band), 7) << low
            return
        size = 1 + band
        if high and only == 0x00 and (comp.coefficients[:, first : last + 1] != 0).all() and len(raw) == -(-units * size // 8):
            bits = np.unpackbits(raw, count=units * size).reshape(units, size)[:, 1:].astype(np.int16)
            part = comp.coefficients[:, first : last + 1]
            part += np.where(part > 0, bits, -bits) << low
            return
    # Bit by bit.
    pieces, start, at = [], 0, 0
    while restart and (at := body.find(b"\xff", at)) >= 0:
        if at + 1 < len(body) and body[at + 1] & 0xF8 == 0xD0:
            pieces.append(body[start:at])
            start = at + 2
        at += 2
    pieces.append(body[start:])
    done = 0
    for piece in pieces:
        bits, before, run = _Bits(piece), [0] * len(order), 0
        for unit in range(done, min(units, done + restart) if restart else units):
            row, column = divmod(unit, mcu_wide)
            for i, (c, d, a) in enumerate(order):
                places = [row * c.wide + column] if alone else [(row * c.down + y) * c.wide + column * c.across + x for y in range(c.down) for x in range(c.across)]
                for place in places:
                    block = c.coefficients[place]
                    if first:
                        run = (_ac_refine if high else _ac_first)(bits, block, first, last, low, ac[a], run)
                    elif high:
                        block[0] |= bits.take(1) << low
                    else:
                        before[i] += bits.extended(bits.symbol(dc[d]))
                        block[0] = before[i] << low
        done += restart or units


def read_coefficients(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated into coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    at, restart, image = 2, 0, None
    quant: dict[int, np.ndarray] = {}
    dc: dict[int, _Table] = {}
    ac: dict[int, _Table] = {}
    comments: list[bytes] = []
    while at + 4 <= len(data):
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at] != 0xFF:
            raise BadImage("no marker where one must be")
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _Table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            most_x, most_y = max(c.across for c in parts), max(c.down for c in parts)
            for c in parts:
                c.own_wide, c.own_high = -(-(width * c.across) // (8 * most_x)), -(-(height * c.down) // (8 * most_y))
                c.wide, c.high = -(-width // (8 * most_x)) * c.across, -(-height // (8 * most_y)) * c.down
                c.coefficients = np.zeros((c.wide * c.high, 64), np.int16)
            image = Image(width, height, parts, quant, comments)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise BadImage("not a progressive Huffman frame")
        elif marker == 0xDA:
            if image is None:
                raise BadImage("a scan before its frame")
            n = body[0]
            by_id = {c.ident: c for c in image.components}
            order = [(by_id[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            found = _SCAN_END.search(data, at)
            if not found:
                raise BadImage("a scan without an end")
            end = found.start()
            _read_scan(data[at:end], image, order, body[-3], body[-2], body[-1] >> 4, body[-1] & 15, dc, ac, restart)
            at = end
            if data[at + 1] == 0xD9:
                break
    if image is None:
        raise BadImage("no frame")
    return image


def _samples(coefficients: np.ndarray, quant: np.ndarray, rows_at_once: int = 4096) -> np.ndarray:
    out = np.empty(coefficients.shape, np.uint8)
    for i in range(0, len(out), rows_at_once):
        values = (coefficients[i : i + rows_at_once] * quant) @ BASIS
        values += 2048 + 128 * 4096
        values *= 1 / 4096
        np.floor(values, out=values)
        np.clip(values, 0, 255, out=values)
        out[i : i + rows_at_once] = values
    return out


def to_rgb(image: Image) -> np.ndarray:
    """Height, width, 3 of uint8."""
    parts = image.components
    most_x, most_y = max(c.across for c in parts), max(c.down for c in parts)
    if len({c.table for c in parts}) == 1:
        joined = _samples(np.concatenate([c.coefficients for c in parts]), image.tables[parts[0].table])
        samples = np.split(joined, np.cumsum([len(c.coefficients) for c in parts])[:-1])
    else:
        samples = [_samples(c.coefficients, image.tables[c.table]) for c in parts]
    planes = []
    for c, values in zip(parts, samples, strict=True):
        plane = values.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.high, 8 * c.wide)
        plane = plane.repeat(most_y // c.down, axis=0) if most_y > c.down else plane
        plane = plane.repeat(most_x // c.across, axis=1) if most_x > c.across else plane
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.int16), planes[1], planes[2]
    rgb = np.empty((image.height, image.width, 3), np.uint8)
    rgb[:, :, 0] = np.clip(y + _RED[cr], 0, 255)
    rgb[:, :, 1] = np.clip(y + ((_GREEN_CB[cb] + _GREEN_CR[cr]) >> 16), 0, 255)
    rgb[:, :, 2] = np.clip(y + _BLUE[cb], 0, 255)
    return rgb


def read_payload(image: Image) -> bytes:
    """The bytes that write_payload stored."""
    length = next(int(c[8:]) for c in image.comments if c.startswith(b"payload="))
    values = np.concatenate([c.coefficients for c in image.components]).reshape(-1)[:length]
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()


def padded(text: str) -> tuple[int, bytes]:
    """Length in bytes, and the payload filled with byte 32 to a positive multiple of 192."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (max(-len(data) % MULTIPLE, 0) if data else MULTIPLE)


def media_row(text: str) -> tuple:
    n_bytes, payload = padded(text)
    media = write_payload(payload)
    image = read_coefficients(media)
    back, rgb = read_payload(image), to_rgb(image)
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 100 // (rgb.size // 3)
    feature = f"{image.width}x{image.height};mean100={','.join(map(str, means.tolist()))};crc32={zlib.crc32(rgb):08x}"
    return n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, image.width, image.height, media, rgb


def media_columns(docs: DataFrame, keep_tensor: bool = False) -> DataFrame:
    """Each text as a progressive JPEG, with what was read back from it.

    With ``keep_tensor`` the columns ``media`` (the file) and ``rgb`` (height *
    width * 3 bytes) are returned too.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]

    def store(batch: pa.RecordBatch) -> dict:
        columns: dict[str, list] = {n: [] for n in [*names, *(("media", "rgb") if keep_tensor else ())]}
        for text in texts(batch):
            row = media_row(text)
            for n, value in zip(columns, row, strict=False):
                columns[n].append(value.tobytes() if n == "rgb" else value)
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | columns

    return map_rows(docs.select("doc_id", "text"), TENSOR_SCHEMA if keep_tensor else SCHEMA, store)


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents", "doc_id", "text"))
