"""Operator 10: media columns as progressive JPEG.

:func:`decode` reads a progressive JPEG (Huffman-coded, 8 bits): it accumulates the spectral-selection and successive-approximation
scans into one coefficient array per component. :func:`tensor` inverse-transforms them in numpy, upsamples the chroma
planes and returns the full-resolution RGB tensor.

:func:`encode` stores bytes losslessly in such a file: the format's unit is the quantised coefficient, 64 to a block, and a
byte b is kept as the coefficient 256 + b (the quantiser is 1). DC coefficients take a first scan and eight refinements, AC
coefficients a first scan and one refinement, so every coefficient has a non-zero history and all scans have fixed strides. The
decoder checks for such strides and then reads a scan at once with numpy; any other scan is read symbol by symbol.

Blocks fill the luma plane, then both chroma planes (4:2:0), padded with zeros to whole units; a comment holds the payload's length.

Defined cases: a null or empty text is a payload of 64 zero bytes; equal texts give equal files, and repeated rows are stored as often as
they come; an empty table gives an empty result; the query reads doc_id and text only; columns of the input that are named like an added one
(media; height, width, rgb) are replaced by it. A text is coded in its task, which holds its bits unpacked (a byte each) and the tensor: some
forty times the text, so a text of a hundred megabytes needs a worker of four gigabytes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import documents, ship
from barloom.llm.spans import scan

BLOCK = 64
COMMENT = b"payload bytes: "
#: Fixed value of the format: blocks that one end-of-band run may cover.
LONGEST_RUN = 32767


def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block (row by row) of each coefficient in scan order: along diagonals, turning each time."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def cosines() -> np.ndarray:
    """Row u holds the u-th basis function of the transform."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return (np.cos((2 * x + 1) * u * np.pi / 16) / 2 * np.where(u == 0, math.sqrt(0.5), 1)).astype(np.float32)


_ZIGZAG, _COSINES = zigzag(), cosines()
_NATURAL = np.argsort(_ZIGZAG)


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def huffman(kind: int, number: int, by_length: dict[int, list[int]]) -> bytes:
    return segment(0xC4, bytes([kind << 4 | number, *(len(by_length.get(k, [])) for k in range(1, 17))]) + bytes(s for k in sorted(by_length) for s in by_length[k]))


def scan_header(components: list[int], ac_table: int, first: int, last: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([len(components), *(x for c in components for x in (c, ac_table)), first, last, high << 4 | low]))


#: DC: no change, or a change by one. AC, first scan: no run and eight bits. AC, refinement: end-of-band runs.
_TABLES = huffman(0, 0, {1: [0], 2: [1]}) + huffman(1, 0, {1: [8]}) + huffman(1, 1, {4: [r << 4 for r in range(15)]})


def packed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes: padded with ones, a zero after each 0xFF."""
    rest = -len(bits) % 8
    if rest:
        bits = np.concatenate([bits, np.ones(rest, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def mcu_order(rows: int, columns: int, v: int, h: int) -> np.ndarray:
    """Raster numbers of a component's blocks in the order in which interleaved scans hold them; one row per unit."""
    grid = np.arange(rows * v * columns * h).reshape(rows, v, columns, h)
    return grid.transpose(0, 2, 1, 3).reshape(rows * columns, v * h)


def geometry(payload: int) -> tuple[int, int]:
    """Rows and columns of units (six blocks each) that hold so many bytes."""
    units = max(1, -(-payload // (6 * BLOCK)))
    columns = min(4095, math.isqrt(units - 1) + 1)
    return -(-units // columns), columns


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload``, whose length is a positive multiple of 64."""
    rows, columns = geometry(len(payload))
    units = rows * columns
    blocks = np.zeros((6 * units, BLOCK), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = (blocks[: 4 * units], blocks[4 * units : 5 * units], blocks[5 * units :])
    out = [
        b"\xff\xd8",
        segment(0xFE, COMMENT + str(len(payload)).encode()),
        segment(0xDB, bytes([0] + [1] * 64)),
        segment(0xC2, bytes([8]) + (16 * rows).to_bytes(2, "big") + (16 * columns).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _TABLES,
    ]
    start = np.array([1, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0, 1], np.uint8)
    out += [scan_header([1, 2, 3], 0, 0, 0, 0, 8), packed(np.concatenate([start, np.zeros(6 * (units - 1), np.uint8)]))]
    dc = np.concatenate([parts[0][:, 0][mcu_order(rows, columns, 2, 2)], parts[1][:, :1], parts[2][:, :1]], axis=1)
    for low in range(7, -1, -1):
        out += [scan_header([1, 2, 3], 0, 0, 0, low + 1, low), packed((dc >> low & 1).reshape(-1))]
    for k, part in enumerate(parts):
        ac = part[:, 1:]
        first = np.unpackbits((ac >> 1 | 0x80).reshape(-1, 1), axis=1)
        coded = np.zeros((len(first), 9), np.uint8)
        coded[:, 1:] = first
        out += [scan_header([k + 1], 0, 1, 63, 0, 1), packed(coded.reshape(-1))]
        bits = []
        for at in range(0, len(ac), LONGEST_RUN):
            run = ac[at : at + LONGEST_RUN]
            r = len(run).bit_length() - 1
            bits += [np.array([int(b) for b in f"{r:04b}" + f"{len(run):b}"[1:]], np.uint8), (run & 1).reshape(-1)]
        out += [scan_header([k + 1], 1, 1, 63, 1, 0), packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Component:
    h: int
    v: int
    quantiser: int
    rows: int = 0
    columns: int = 0
    #: blocks of 64 coefficients in scan order, row by row
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, BLOCK), np.int32))


@dataclass
class Picture:
    height: int = 0
    width: int = 0
    comment: bytes = b""
    restart: int = 0
    mcu_rows: int = 0
    mcu_columns: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, dict[tuple[int, int], int]] = field(default_factory=dict)


class Bits:
    """Entropy-coded bits of one restart interval, read one after the other."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def bit(self) -> int:
        self.at += 1
        return int(self.bits[self.at - 1]) if self.at <= len(self.bits) else 1

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if n == 0 or value >> (n - 1) else value - (1 << n) + 1


def visited(picture: Picture, ids: list[int]) -> list[list[tuple[int, int]]]:
    """(component, block) of each unit of a scan, in the order of the scan."""
    if len(ids) == 1:
        c = picture.components[ids[0]]
        most_h, most_v = (max(getattr(x, k) for x in picture.components.values()) for k in "hv")
        rows, columns = -(-picture.height * c.v // (8 * most_v)), -(-picture.width * c.h // (8 * most_h))
        return [[(ids[0], r * c.columns + k)] for r in range(rows) for k in range(columns)]
    orders = [(i, mcu_order(picture.mcu_rows, picture.mcu_columns, picture.components[i].v, picture.components[i].h).tolist()) for i in ids]
    return [[(i, b) for i, order in orders for b in order[k]] for k in range(picture.mcu_rows * picture.mcu_columns)]


def read_slowly(picture: Picture, ids: list[int], dc: dict[int, int], ac: dict[int, int], first: int, last: int, high: int, low: int, data: list[bytes]) -> None:
    """Any scan, symbol by symbol."""
    units = visited(picture, ids)
    each = picture.restart or len(units)
    one = 1 << low
    for n, interval in enumerate(data):
        bits, before, run = Bits(interval), dict.fromkeys(ids, 0), 0
        for unit in units[n * each : (n + 1) * each]:
            for i, b in unit:
                block = picture.components[i].coefficients[b]
                if first == 0:
                    if high:
                        block[0] |= bits.bit() << low
                    else:
                        before[i] += bits.signed(bits.symbol(picture.tables[dc[i]]))
                        block[0] = before[i] << low
                    continue
                table, k = picture.tables[16 + ac[i]], first
                if not high:
                    if run:
                        run -= 1
                        continue
                    while k <= last:
                        skip, n_bits = divmod(bits.symbol(table), 16)
                        if n_bits:
                            k += skip
                            block[k] = bits.signed(n_bits) * one
                            k += 1
                        elif skip == 15:
                            k += 16
                        else:
                            run = (1 << skip) + bits.take(skip) - 1
                            break
                    continue
                if not run:
                    while k <= last:
                        skip, n_bits = divmod(bits.symbol(table), 16)
                        value = 0
                        if n_bits:
                            value = one if bits.bit() else -one
                        elif skip < 15:
                            run = (1 << skip) + bits.take(skip)
                            break
                        while k <= last:
                            if block[k]:
                                block[k] = refined(int(block[k]), bits.bit(), one)
                            elif skip == 0:
                                block[k] = value
                                k += 1
                                break
                            else:
                                skip -= 1
                            k += 1
                if run:
                    for j in range(k, last + 1):
                        if block[j]:
                            block[j] = refined(int(block[j]), bits.bit(), one)
                    run -= 1


def refined(value: int, bit: int, one: int) -> int:
    return value if not bit or value & one and value > 0 else value + one if value > 0 else value - one


def read_at_once(picture: Picture, ids: list[int], ac: dict[int, int], first: int, last: int, high: int, low: int, data: bytes) -> bool:
    """A scan of fixed strides; False, and nothing changed, if it isn't one."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    parts = [picture.components[i] for i in ids]
    units = picture.mcu_rows * picture.mcu_columns
    if first == 0:
        if len(ids) == 1 or last:
            return False
        orders = [mcu_order(picture.mcu_rows, picture.mcu_columns, c.v, c.h) for c in parts]
        width = sum(o.shape[1] for o in orders)
        if high == 0:
            # one change by one at each component's first block, none after: what a bare first plane looks like
            want = [x for o in orders for x in (1, 0, 1, *[0] * (o.shape[1] - 1))]
            tables = [picture.tables.get(0, {})]
            if tables[0].get((1, 0)) != 0 or tables[0].get((2, 2)) != 1 or bits[: len(want)].tolist() != want or bits[len(want) : len(want) + width * (units - 1)].any():
                return False
            for c in parts:
                c.coefficients[:, 0] = 1 << low
            return True
        plane = bits[: width * units].reshape(units, width).astype(np.int32) << low
        at = 0
        for c, order in zip(parts, orders, strict=True):
            c.coefficients[order, 0] |= plane[:, at : at + order.shape[1]]
            at += order.shape[1]
        return True
    c, n = parts[0], last - first + 1
    whole = len(c.coefficients)
    table = picture.tables[16 + ac[ids[0]]]
    if high == 0:
        size = table.get((1, 0), 0)
        if not 1 <= size <= 15 or len(bits) < whole * n * (size + 1):
            return False
        coded = bits[: whole * n * (size + 1)].reshape(whole * n, size + 1)
        if coded[:, 0].any() or not coded[:, 1].all():
            return False
        value = np.zeros(whole * n, np.int32)
        for k in range(1, size + 1):
            value = value << 1 | coded[:, k]
        c.coefficients[:, first : last + 1] = (value << low).reshape(whole, n)
        return True
    if (c.coefficients[:, first : last + 1] <= 0).any():
        return False
    at, done, found = 0, 0, []
    while done < whole:
        code, length = 0, 0
        while (length, code) not in table and length < 16:
            code, length = code << 1 | int(bits[at + length]), length + 1
        skip, size = divmod(table.get((length, code), 1), 16)
        if size or skip == 15:
            return False
        at += length
        run = 1 << skip | int("".join(map(str, bits[at : at + skip].tolist())) or "0", 2)
        at += skip
        run = min(run, whole - done)
        found.append(bits[at : at + run * n].reshape(run, n))
        at, done = at + run * n, done + run
    c.coefficients[:, first : last + 1] += np.concatenate(found).astype(np.int32) << low
    return True


def decode(data: bytes, slowly: bool = False) -> Picture:
    """The coefficients of a progressive JPEG; ``slowly`` reads every scan symbol by symbol."""
    picture, at = Picture(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : end]
        at = end
        if marker == 0xFE:
            picture.comment = body
        elif marker == 0xDD:
            picture.restart = int.from_bytes(body, "big")
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                picture.quantisers[body[k] & 15] = np.frombuffer(body[k + 1 : k + 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                k += 65 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                table, code, symbol = {}, 0, k + 17
                for length in range(1, 17):
                    for _ in range(body[k + length]):
                        table[length, code] = body[symbol]
                        code, symbol = code + 1, symbol + 1
                    code <<= 1
                picture.tables[body[k]], k = table, symbol
        elif marker == 0xC2:
            picture.height, picture.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for k in range(body[5]):
                i, sampling, quantiser = body[6 + 3 * k : 9 + 3 * k]
                picture.components[i] = Component(sampling >> 4, sampling & 15, quantiser)
            most_h, most_v = (max(getattr(x, k) for x in picture.components.values()) for k in "hv")
            picture.mcu_columns, picture.mcu_rows = -(-picture.width // (8 * most_h)), -(-picture.height // (8 * most_v))
            for c in picture.components.values():
                c.rows, c.columns = picture.mcu_rows * c.v, picture.mcu_columns * c.h
                c.coefficients = np.zeros((c.rows * c.columns, BLOCK), np.int32)
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not a progressive, Huffman-coded JPEG")
        elif marker == 0xDA:
            ids = [body[1 + 2 * k] for k in range(body[0])]
            choice = [body[2 + 2 * k] for k in range(body[0])]
            first, last, approximation = body[1 + 2 * body[0] :][:3]
            intervals, start = [], at
            while True:
                at = data.index(b"\xff", at)
                following = data[at + 1]
                if following == 0:
                    at += 2
                    continue
                intervals.append(data[start:at].replace(b"\xff\x00", b"\xff"))
                if not 0xD0 <= following <= 0xD7:
                    break
                at += 2
                start = at
            ac, dc = {i: t & 15 for i, t in zip(ids, choice, strict=True)}, {i: t >> 4 for i, t in zip(ids, choice, strict=True)}
            high, low = approximation >> 4, approximation & 15
            if slowly or len(intervals) > 1 or not aligned(picture) or not read_at_once(picture, ids, ac, first, last, high, low, intervals[0]):
                read_slowly(picture, ids, dc, ac, first, last, high, low, intervals)
    return picture


def aligned(picture: Picture) -> bool:
    """Whether the picture is made of whole units, so that scans of one component hold all its blocks."""
    most_h, most_v = (max(getattr(x, k) for x in picture.components.values()) for k in "hv")
    return picture.width % (8 * most_h) == 0 and picture.height % (8 * most_v) == 0


def payload(picture: Picture) -> bytes:
    """The bytes that :func:`encode` stored."""
    if not picture.comment.startswith(COMMENT):
        raise ValueError("no payload")
    blocks = np.concatenate([c.coefficients for _, c in sorted(picture.components.items())])
    return (blocks & 0xFF).astype(np.uint8).tobytes()[: int(picture.comment[len(COMMENT) :])]


def plane(c: Component, quantiser: np.ndarray) -> np.ndarray:
    """Samples of a component, inverse-transformed."""
    natural = (c.coefficients * quantiser).astype(np.float32)[:, _NATURAL]
    half = (natural.reshape(-1, 8) @ _COSINES).reshape(-1, 8, 8).transpose(0, 2, 1)
    full = (np.ascontiguousarray(half).reshape(-1, 8) @ _COSINES).reshape(c.rows, c.columns, 8, 8)
    return np.clip(np.rint(full.transpose(0, 3, 1, 2).reshape(8 * c.rows, 8 * c.columns)) + 128, 0, 255)


def tensor(picture: Picture) -> np.ndarray:
    """The picture as height x width x 3 bytes, chroma upsampled to full resolution."""
    most_h, most_v = (max(getattr(x, k) for x in picture.components.values()) for k in "hv")
    planes = []
    for _, c in sorted(picture.components.items()):
        samples = plane(c, picture.quantisers[c.quantiser])
        if most_v > c.v or most_h > c.h:
            samples = samples.repeat(most_v // c.v, axis=0).repeat(most_h // c.h, axis=1)
        planes.append(samples[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.empty((picture.height, picture.width, 3), np.uint8)
    for k, colour in enumerate((y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue)):
        rgb[:, :, k] = np.clip(np.rint(colour), 0, 255)
    return rgb


def padded(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def summary(text: str) -> tuple:
    stored = encode(padded(text))
    picture = decode(stored)
    back = payload(picture)
    rgb = tensor(picture)
    means = ",".join(f"{x / rgb[:, :, 0].size:.3f}" for x in rgb.sum(axis=(0, 1), dtype=np.int64).tolist())
    return (
        len(text.encode("utf-8", "surrogatepass")),
        len(back),
        hashlib.sha256(back).hexdigest(),
        zlib.crc32(back[-BLOCK:]),
        len(stored),
        hashlib.sha256(stored).hexdigest(),
        f"{picture.height}x{picture.width}:{means}:{zlib.crc32(rgb.tobytes()):08x}",
    )


def media_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``media``: the text stored as a progressive JPEG. A null text counts as empty."""
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encode(padded(t or "")))

    return docs.withColumn("media", stored(F.col(text)))


def rgb_column(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with ``height``, ``width`` and ``rgb``, the full-resolution tensor's bytes; null where the column is null."""
    ship(media.sparkSession)

    @F.pandas_udf("height int, width int, rgb binary")
    def opened(files: pd.Series) -> pd.DataFrame:
        tensors = [None if f is None else tensor(decode(bytes(f))) for f in files]
        return pd.DataFrame({"height": [t if t is None else t.shape[0] for t in tensors], "width": [t if t is None else t.shape[1] for t in tensors], "rgb": [t if t is None else t.tobytes() for t in tensors]}).astype(
            {"height": "Int32", "width": "Int32"}
        )

    kept = [F.col(f"`{c}`") for c in media.columns if c not in ("height", "width", "rgb")]
    return media.select(F.struct(*kept).alias("kept"), opened(F.col(column)).alias("opened")).select("kept.*", "opened.*")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [
        ("n_bytes", "long"),
        ("payload_bytes", "long"),
        ("payload_sha256", "string"),
        ("tail_crc32", "long"),
        ("media_bytes", "long"),
        ("media_sha256", "string"),
        ("feature", "string"),
    ]
    return scan(documents(spark, sf_dir), summary, fields)
