"""Media columns: baseline JPEG images as binary columns.

Reading parses the markers, Huffman-decodes the scans and rebuilds the DC-only
luminance thumbnail, one pixel for each block of 8 by 8; AC coefficients are
skipped over, never transformed. Components may come in one scan or in several: the
scan that holds the first component, the luminance, is decoded. Stretches between restart markers don't depend
on each other, so all stretches of all images of a batch that share their tables
are decoded side by side with array operations.

Writing stores any bytes losslessly: each byte is the DC coefficient of a block
(quantised by 8, so the block is flat and has just that value), with a restart
marker every 24 blocks. The unit of storage is thus the DC coefficient, and the
thumbnail of such an image is the stored payload itself.

Defined cases: a null text is empty; a payload has at least 576 bytes because it
is padded with 255; payloads above what one image holds continue in further
images, one behind the other in the same value; equal texts give equal values;
null, damaged or other than baseline media give a row whose features are null and
whose ``error`` names the cause; fill bytes before markers and bytes behind the last
image are passed over; empty tables and further columns, whatever their names,
pass unchanged.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import tidy
from .tokens import groups_of

UNIT = 576
NARROW, WIDE = 24, 576
STRETCH = 24
#: Blocks in a column: 65,535 pixels at most.
MOST_ROWS = 8191
#: Payload bytes that are encoded or decoded together.
TOGETHER = 1 << 20

# The usual DC luminance code, as counts by length 1 to 16 and categories in order.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
# The AC code of stored payloads: end of block alone, one bit.
AC_COUNTS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
AC_SYMBOLS = (0,)


def canonical(counts, symbols) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if k < len(symbols):
                out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts, symbols) -> np.ndarray:
    """For each 16 bits: length of the code that begins there, times 256, plus its symbol; 0 where none does."""
    table = np.zeros(1 << 16, np.int32)
    for s, code, n in canonical(counts, symbols):
        table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return table


def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255 to 255: code, magnitude, end of block."""
    codes = {s: (c, n) for s, c, n in canonical(DC_COUNTS, DC_SYMBOLS)}
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        c, n = codes[s]
        bits[d + 255], sizes[d + 255] = ((c << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1, n + s + 1
    return bits, sizes


BITS, SIZES = _dc_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int, cols: int, interval: int) -> bytes:
    """Everything before the scan's data: one component, baseline."""
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\0" + b"\x08" + b"\x01" * 63),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, cols * 8, 1) + b"\x01\x11\x00"),
            _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS[: sum(DC_COUNTS)])),
            _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
            _segment(0xDD, struct.pack(">H", interval)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


def padded(data: bytes) -> bytes:
    short = -len(data) % UNIT if data else UNIT
    return data + b"\xff" * short


def frames_of(n: int) -> list[tuple[int, int]]:
    """Rows and columns of blocks of the images that hold n bytes."""
    if n <= NARROW * MOST_ROWS:
        return [(n // NARROW, NARROW)]
    rows = n // WIDE
    return [(min(MOST_ROWS, rows - k), WIDE) for k in range(0, rows, MOST_ROWS)]


def _scans(payload: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded data of stretches of 24 bytes, each with the marker behind it, and where each ends."""
    x = payload.reshape(-1, STRETCH).astype(np.int64)
    d = np.diff(x, axis=1, prepend=np.int64(128)) + 255
    bits, size = BITS[d], SIZES[d]
    own = np.cumsum(size, axis=1)
    total = own[:, -1]
    n_bytes = (total + 7) >> 3
    base = np.cumsum(n_bytes) - n_bytes
    at = (own - size) + (base << 3)[:, None]
    spare = (n_bytes << 3) - total
    value = (bits << (24 - (at & 7) - size)).ravel()  # three bytes from at >> 3 on
    byte = (at >> 3).ravel()
    n = int(n_bytes.sum())
    out = np.zeros(n + 3, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(byte + k, weights=(value >> shift) & 255, minlength=n + 3).astype(np.int64)
    ends = base + n_bytes
    out[ends - 1] += (1 << spare) - 1
    out = out[:n].astype(np.uint8)
    stuffed = out == 255
    place = np.arange(n) + np.cumsum(stuffed) - stuffed + 2 * np.repeat(np.arange(len(ends)), n_bytes)
    final = np.zeros(n + int(stuffed.sum()) + 2 * len(ends), np.uint8)
    final[place] = out
    behind = place[ends - 1] + 1 + stuffed[ends - 1]
    final[behind] = 255
    final[behind + 1] = np.where(last, 0xD9, 0xD0 + number % 8)
    return final, behind + 2


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """JPEG values of padded payloads."""
    out: list[bytes] = []
    for lo, hi in groups_of([len(p) for p in payloads], TOGETHER):
        plan = [frames_of(len(p)) for p in payloads[lo:hi]]
        stretches = [r * c // STRETCH for f in plan for r, c in f]
        ends = np.cumsum(stretches)
        last = np.zeros(ends[-1], bool)
        last[ends - 1] = True
        number = np.arange(ends[-1]) - np.repeat(ends - stretches, stretches)
        data, behind = _scans(np.frombuffer(b"".join(payloads[lo:hi]), np.uint8), last, number)
        raw, at, k = data.tobytes(), 0, 0
        for f in plan:
            parts = []
            for r, c in f:
                stop = int(behind[ends[k] - 1])
                parts += [header(r, c, STRETCH), raw[at:stop]]
                at, k = stop, k + 1
            out.append(b"".join(parts))
    return out


@dataclass
class Frame:
    """An image's geometry, and of the scan with its first component the tables and where it lies."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser of DC
    tables: dict = field(default_factory=dict)  # (class, number): counts, symbols
    use: list[tuple[int, int, int]] = field(default_factory=list)  # index of the part, DC table, AC table
    interval: int = 0
    start: int = 0
    stops: list[int] = field(default_factory=list)  # markers behind the stretches

    def key(self) -> tuple:
        """Which of the scan's parts is the first component; tables and sampling of each."""
        return self.first(), tuple((self.tables[0, d], self.tables[1, a], *self.parts[i][1:3]) for i, d, a in self.use)

    def first(self) -> int:
        return [i for i, *_ in self.use].index(0)

    def mcus(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.use) == 1:  # blocks of the only part in plain order
            _, ph, pv, _ = self.parts[self.use[0][0]]
            w, t = -(-self.width * ph // h), -(-self.height * pv // v)
            return -(-t // 8), -(-w // 8)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


def parse(data: bytes) -> list[Frame]:
    """Frames of one value, which may hold several images."""
    if data is None or data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG: no start of image")
    a = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(a[:-1] == 255)
    ff = ff[(a[ff + 1] != 0) & (a[ff + 1] != 255)]
    code = a[ff + 1]
    real = ff[(code < 0xD0) | (code > 0xD7)]  # all but restart markers
    frames, at = [], 0
    try:
        while data[at : at + 2] == b"\xff\xd8":
            at, frame, quant, tables, interval = at + 2, Frame(), {}, {}, 0
            while True:
                if data[at] != 0xFF:
                    raise ValueError("damaged JPEG: no marker where one must be")
                while data[at + 1] == 0xFF:  # fill bytes
                    at += 1
                marker = data[at + 1]
                if marker == 0xD9:
                    at += 2
                    break
                size = struct.unpack_from(">H", data, at + 2)[0]
                body = data[at + 4 : at + 2 + size]
                at += 2 + size
                if marker == 0xDB:
                    k = 0
                    while k < len(body):
                        wide = body[k] >> 4
                        quant[body[k] & 15] = struct.unpack_from(">H" if wide else ">B", body, k + 1)[0]
                        k += 1 + 64 * (1 + wide)
                elif marker == 0xC0:
                    bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                    if bits != 8 or not frame.height or not frame.width:
                        raise ValueError("only baseline JPEG of 8 bits and known size is decoded")
                    frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, quant[body[8 + 3 * i]]) for i in range(n)]
                    if not all(p[1] and p[2] for p in frame.parts):
                        raise ValueError("damaged JPEG: no sampling")
                elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    raise ValueError("only baseline JPEG is decoded")
                elif marker == 0xC4:
                    k = 0
                    while k < len(body):
                        counts = tuple(body[k + 1 : k + 17])
                        tables[body[k] >> 4, body[k] & 15] = counts, tuple(body[k + 17 : k + 17 + sum(counts)])
                        k += 17 + sum(counts)
                elif marker == 0xDD:
                    interval = struct.unpack(">H", body)[0]
                elif marker == 0xDA:
                    ids = [p[0] for p in frame.parts]
                    use = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                    stop = int(real[np.searchsorted(real, at)])
                    if not frame.use and any(i == 0 for i, *_ in use):
                        lo, hi = np.searchsorted(ff, [at, stop])
                        frame.use, frame.start, frame.stops = use, at, [*ff[lo:hi].tolist(), stop]
                        # what later scans may define anew
                        frame.tables, frame.interval = dict(tables), interval
                        frame.key()
                    at = stop
            if not frame.use:
                raise ValueError("damaged JPEG: no scan of the first component")
            frames.append(frame)
            while data[at : at + 3] == b"\xff\xff\xff" or data[at : at + 3] == b"\xff\xff\xd8":
                at += 1
    except (IndexError, struct.error, KeyError) as x:
        raise ValueError(f"damaged JPEG: {x}") from None
    return frames


def decode_many(values: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """For each value its frames with their DC-only luminance thumbnails."""
    frames = [parse(v) for v in values]
    starts = np.cumsum([0] + [len(v) for v in values])
    a = np.frombuffer(b"".join(values) + b"\0" * 8, np.uint8)
    stuffed = np.zeros(len(a), bool)
    stuffed[1:] = (a[1:] == 0) & (a[:-1] == 255)
    for k, own in enumerate(frames):  # bytes of headers stay as they are
        at = 0
        for f in own:
            stuffed[starts[k] + at : starts[k] + f.start] = False
            at = f.stops[-1]
    index = np.cumsum(~stuffed) - 1
    plain = np.concatenate([a[~stuffed], np.zeros(16, np.uint8)])
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for k, own in enumerate(frames):
        for j, f in enumerate(own):
            groups.setdefault(f.key(), []).append((k, j))
    out: list[list] = [[None] * len(own) for own in frames]
    for key, members in groups.items():
        begin, count, first = [], [], []
        for k, j in members:
            f = frames[k][j]
            rows, cols = f.mcus()
            each = f.interval or rows * cols
            n = -(-rows * cols // each)
            if n != len(f.stops):
                raise ValueError("damaged JPEG: restart markers are missing")
            first.append(len(begin))
            begin += [starts[k] + f.start, *[starts[k] + s + 2 for s in f.stops[:-1]]]
            count += [each] * (n - 1) + [rows * cols - each * (n - 1)]
        dc = _decode(plain, index[np.array(begin)].astype(np.int64) * 8, np.array(count), key)
        for (k, j), at in zip(members, first, strict=True):
            f = frames[k][j]
            rows, cols = f.mcus()
            each = f.interval or rows * cols
            n = -(-rows * cols // each)
            values_of = dc[at : at + n, :each].reshape(-1, dc.shape[2])[: rows * cols]
            _, h, v, q = f.parts[0]
            if len(f.use) == 1:
                h = v = 1
            grid = values_of.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
            pixels = np.clip((grid * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
            out[k][j] = (f, pixels[: -(-f.height // 8), : -(-f.width // 8)])
    return out


def _decode(plain: np.ndarray, bit: np.ndarray, count: np.ndarray, key: tuple) -> np.ndarray:
    """DC values of the first component: stretch, MCU, block in the MCU."""
    first, key = key
    single = len(key) == 1
    shape = [(1, 1) if single else (h, v) for *_, h, v in key]
    tables = [(lookup(*d), lookup(*a)) for d, a, *_ in key]
    most = int(count.max())
    out = np.zeros((len(bit), most, shape[first][0] * shape[first][1]), np.int32)
    eight = np.lib.stride_tricks.as_strided(plain, (len(plain) - 7, 8), (1, 1))
    limit = len(plain) - 8

    def word(p: np.ndarray) -> np.ndarray:
        return eight[np.minimum(p >> 3, limit)].view(">u8").ravel().astype(np.uint64) << (p & 7).astype(np.uint64)

    alike = bool((count == most).all())
    last = [np.zeros(len(bit), np.int64) for _ in key]
    for m in range(most):
        live = slice(None) if alike else np.flatnonzero(count > m)
        p = bit[live]
        for c, (dc_table, ac_table) in enumerate(tables):
            for b in range(shape[c][0] * shape[c][1]):
                w = word(p)
                got = dc_table[(w >> np.uint64(48)).astype(np.int64)]
                n, s = got >> 8, got & 255
                if not n.all():
                    raise ValueError("damaged JPEG: no such DC code")
                raw = ((w << n.astype(np.uint64)) >> np.uint64(1) >> (63 - s).astype(np.uint64)).astype(np.int64)
                diff = np.where((raw << 1) >> s != 0, raw, raw - (np.int64(1) << s) + 1)
                p = p + n + s
                last[c][live] += diff
                if c == first:
                    out[live, m, b] = last[c][live]
                p = _skip_ac(word, p, ac_table)
        bit[live] = p
    return out


def _skip_ac(word, p: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Behind the block's last AC code."""
    got = table[(word(p) >> np.uint64(48)).astype(np.int64)]
    p = p + (got >> 8) + (got & 15)
    if not got.all() and (got >> 8 == 0).any():
        raise ValueError("damaged JPEG: no such AC code")
    todo = np.flatnonzero((got & 255) != 0)
    k = np.ones(len(p), np.int64)
    while len(todo):
        k[todo] += ((got[todo] & 255) >> 4) + 1
        todo = todo[k[todo] < 64]
        now = table[(word(p[todo]) >> np.uint64(48)).astype(np.int64)]
        if (now >> 8 == 0).any():
            raise ValueError("damaged JPEG: no such AC code")
        p[todo] += (now >> 8) + (now & 15)
        got[todo] = now
        todo = todo[(now & 255) != 0]
    return p


def hashes(pixels: np.ndarray) -> tuple[int, int]:
    """Average hash and difference hash of a thumbnail, from sums over 8 by 8 (8 by 9) fields."""

    def fields(rows: int, cols: int) -> np.ndarray:
        y, x = (np.arange(n) * s // n for n, s in ((rows, pixels.shape[0]), (cols, pixels.shape[1])))
        if pixels.shape[0] < rows or pixels.shape[1] < cols:
            return pixels[y][:, x].astype(np.float64)
        sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), y, axis=0), x, axis=1)
        area = np.diff(np.append(y, pixels.shape[0]))[:, None] * np.diff(np.append(x, pixels.shape[1]))[None, :]
        return sums / area

    f, g = fields(8, 8), fields(8, 9)
    pack = lambda bits: int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big")
    return pack(f > f.mean()), pack(g[:, 1:] > g[:, :-1])


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), media: str = "media") -> DataFrame:
    """``keep`` columns, ``n_bytes`` and a JPEG that holds the text's bytes."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("__bytes"))

    def run(batches):
        for b in batches:
            column = b.column(b.num_columns - 1)
            sizes = [len(v) if v else 0 for v in (x.as_buffer() for x in column)]
            for lo, hi in groups_of(sizes, 16 * TOGETHER):
                data = encode_many([padded(x) for x in column.slice(lo, hi - lo).to_pylist()])
                own = [c.slice(lo, hi - lo) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes[lo:hi], pa.int64()), pa.array(data, pa.binary())], names=[*keep, "n_bytes", media])

    return slim.mapInArrow(tidy(run), schema)


def _decoded(values: list[bytes | None]) -> list[list | ValueError]:
    """``decode_many``, with the error in the place of each value that can't be decoded."""
    sound: list = [None if v is not None else ValueError("no media") for v in values]
    todo = [k for k, v in enumerate(values) if v is not None]
    try:
        for k, own in zip(todo, decode_many([values[k] for k in todo]) if todo else [], strict=True):
            sound[k] = own
    except ValueError:  # one of them: each by itself
        for k in todo:
            try:
                sound[k] = decode_many([values[k]])[0]
            except ValueError as x:
                sound[k] = x
    return sound


def describe(df: DataFrame, media: str = "media") -> DataFrame:
    """The other columns of ``df``, dimensions, thumbnail hashes, digests of the stored form and of the payload read back, and error."""
    added = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("error", T.StringType())]
    rest = [c for c in df.columns if c not in {media, *(n for n, _ in added)}]  # those of the same name are replaced
    schema = T.StructType([*[df.schema[c] for c in rest], *[T.StructField(n, t) for n, t in added]])

    def facts(values: list[bytes | None]) -> list[tuple]:
        out = []
        for lo, hi in groups_of([len(v or b"") for v in values], TOGETHER):
            for v, own in zip(values[lo:hi], _decoded(values[lo:hi]), strict=True):
                stored = (None, None) if v is None else (len(v), hashlib.sha256(v).hexdigest())
                if isinstance(own, ValueError):
                    out.append((None, None, None, *stored, None, str(own)))
                    continue
                payload = b"".join(p.tobytes() for _, p in own)
                said = ";".join(f"{f.width}x{f.height}:{a:016x}:{d:016x}" for f, (a, d) in ((f, hashes(p)) for f, p in own))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, said, None))
        return out

    def run(batches):
        for b in batches:
            rows = facts(b.column(b.num_columns - 1).to_pylist())
            cols = list(zip(*rows, strict=True)) or [()] * len(added)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*rest, *[n for n, _ in added]])

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{media}`")).mapInArrow(tidy(run), schema)
