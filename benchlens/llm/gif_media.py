"""GIF columns: files are decoded into timed frames with colour histograms, and payloads stored as GIF.

Decoding follows the public GIF89a format: LZW code streams of 2 to 12 bits, global and local
palettes, interlaced rows, transparency, the four disposal rules and frame delays.  Frames are
returned as composed RGBA canvases; those of large screens in bands of rows, each composed on its own, so
that memory is bounded by a band and not by the screen.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from benchlens.llm.common import utf8

#: Samples in a row of a stored payload, and rows of a frame at most.
WIDTH, MOST_ROWS = 64, 512
#: Pixels of a band; a screen of more is decoded band by band.
BAND_PIXELS = 1 << 24
#: Samples that one code stands for at most: the table has so many entries, each a sample longer than another.
MOST_OF_A_CODE = 4096
#: Bits of each colour that the histogram keeps: 4 * 4 * 4 bins.
HISTOGRAM_BITS = 2
#: A stored sample's colour: three bits of red, three of green, two of blue, so colours give samples back.
_COLOURS = np.array([((v >> 5) * 36, (v >> 2 & 7) * 36, (v & 3) * 85) for v in range(256)], np.uint8)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    interlaced: bool
    canvas: np.ndarray  # rows x width x 4: the whole screen, or a band of it
    number: int = 0
    start_ms: int = 0
    first_row: int = 0  # of the band

    def histogram(self, rows: int | None = None) -> list[int]:
        """Counts of visible pixels (of the first ``rows``) in bins of red, green and blue, in this order."""
        pixels, keep = self.canvas[:rows].reshape(-1, 4), 8 - HISTOGRAM_BITS
        code = (pixels[:, 0] >> keep << (2 * HISTOGRAM_BITS)) | (pixels[:, 1] >> keep << HISTOGRAM_BITS) | (pixels[:, 2] >> keep)
        seen = pixels[:, 3] > 0
        return np.bincount(code if seen.all() else code[seen], minlength=1 << (3 * HISTOGRAM_BITS)).tolist()


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of the first n codes after a clear code."""
    free = (1 << size) + 1 + np.arange(n)  # codes that the decoder knows when it reads each
    return np.minimum(np.floor(np.log2(np.maximum(free, 1))).astype(np.int64) + 1, 12)


_WIDTHS = {s: _widths(1 << 14, s) for s in range(2, 9)}


_SINGLE = [bytes([i]) for i in range(256)]


def lzw_encode(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples."""
    codes, cuts = [256], [0]
    table: dict[int, int] = {}
    find, emit = table.get, codes.append
    free = 258
    prefix = data[0] if data else None
    for byte in memoryview(data)[1:]:
        key = prefix << 8 | byte
        code = find(key)
        if code is None:
            emit(prefix)
            table[key] = free
            free += 1
            prefix = byte
            if free == 4096:
                cuts.append(len(codes))
                emit(256)
                table.clear()
                free = 258
        else:
            prefix = code
    if data:
        emit(prefix)
    emit(257)
    values = np.array(codes, np.int64)
    # A code's width follows from its distance to the last clear code before it.
    at = np.array([*cuts, len(codes)], np.int64)
    widths = np.empty(len(codes), np.int64)
    widths[0] = 9
    for a, b in zip(at[:-1] + 1, [*(at[1:-1] + 1), len(codes)], strict=True):
        widths[a:b] = _WIDTHS[8][: b - a]
    # Bits of all codes in order, the least first; packing fills up the last byte.
    bits = (values[:, None] >> np.arange(12) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int, most: int | None = None) -> bytes:
    """Samples of a code stream with ``size`` bits a sample; a damaged stream raises ValueError.

    Decoding stops soon after ``most`` samples (4,096 codes later at most).
    """
    parts, done = [], 0
    for part in lzw_parts(stream, size):
        parts.append(part)
        done += len(part)
        if most is not None and done >= most:  # what follows the last pixel is not needed
            break
    return b"".join(parts)


def lzw_parts(stream: bytes, size: int) -> Iterator[bytes]:
    """The samples of a code stream in order, those of 4,096 codes at a time at most."""
    if not 2 <= size <= 8:
        raise ValueError(f"LZW code size {size}")
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    total, at = len(stream) * 8, 0
    single = _SINGLE[:clear] + [b"", b""]
    ask = 4096
    while at + size < total:
        known = _WIDTHS[size]
        enough = (total - at) // (size + 1) + 1  # codes that the rest can hold at most
        ask = min(ask, enough)
        widths = known[:ask] if ask <= len(known) else np.concatenate([known, np.full(ask - len(known), 12)])
        first = at + np.concatenate([[0], np.cumsum(widths)])
        fit = int(np.searchsorted(first, total, "right")) - 1
        begin, widths = first[:-1][:fit], widths[:fit]
        byte = begin >> 3
        codes = (raw[byte] | (raw[byte + 1] << 8) | (raw[byte + 2] << 16)) >> (begin & 7) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops) and fit == len(first) - 1 and ask < enough:
            ask *= 2  # no clear code for a long time: look further
            continue
        n = int(stops[0]) if len(stops) else fit
        run, table, free = codes[:n].tolist(), single.copy(), clear + 2
        if run:
            if run[0] >= clear:
                raise ValueError("LZW code out of range")
            last = table[run[0]]
            out = [last]
            for code in run[1 : 1 + 4096 - free]:  # each adds an entry, until the table is full
                if code < free:
                    entry = table[code]
                elif code == free:
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW code out of range")
                table.append(last + entry[:1])
                out.append(entry)
                free += 1
                last = entry
            yield b"".join(out)
            for k in range(1 + 4096 - clear - 2, n, 4096):
                yield b"".join(map(table.__getitem__, run[k : k + 4096]))
        if not len(stops) or codes[n] == end:
            break
        at, ask = int(first[n + 1]), 4096


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("GIF ends inside a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray, int]:
    n = 2 << (packed & 7)
    if at + 3 * n > len(data):
        raise ValueError("GIF ends inside a palette")
    rgba = np.zeros((256, 4), np.uint8)
    rgba[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    rgba[:, 3] = 255
    return rgba, at + 3 * n


@dataclass
class _Image:
    """A frame as the file states it."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    interlaced: bool
    palette: np.ndarray
    size: int
    stream: bytes

    def rows(self, first: int, last: int, checked: bool) -> np.ndarray:
        """Samples of rows ``first`` to ``last``; unless ``checked``, it is an error if any row is missing."""
        w, h = self.width, self.height
        out = np.zeros((max(last - first, 0), w), np.uint8)
        order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))]) if self.interlaced else np.arange(h)
        end = h if self.interlaced or not checked else min(last, h)
        done, rest = 0, b""
        if checked and not out.size:
            return out
        for part in lzw_parts(self.stream, self.size):
            if done >= end or not w:
                break
            rest = rest + part if rest else part
            if n := min(len(rest) // w, h - done):
                numbers = order[done : done + n]
                inside = (numbers >= first) & (numbers < last)
                if inside.any():
                    out[numbers[inside] - first] = np.frombuffer(rest, np.uint8, n * w).reshape(n, w)[inside]
                done, rest = done + n, rest[n * w :]
        if w and done < end:
            raise ValueError("GIF frame is too short")
        return out


def _read(data: bytes) -> tuple[int, int, list[_Image], str | None]:
    """Screen width and height, the frames as stated, and what is wrong after them."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        return 0, 0, [], "not a GIF"
    width, height, packed = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    images: list[_Image] = []
    delay, disposal, transparent = 0, 0, None
    try:
        if packed & 0x80:
            shared, at = _palette(data, at, packed)
        while at < len(data) and data[at] != 0x3B:
            kind = data[at]
            if kind == 0x21:
                body, end = _blocks(data, at + 2)
                if data[at + 1] == 0xF9 and len(body) >= 4:
                    flags, hundredths, clear = struct.unpack_from("<BHB", body)
                    delay, disposal, transparent = hundredths * 10, flags >> 2 & 7, clear if flags & 1 else None
                at = end
                continue
            if kind != 0x2C or at + 10 > len(data):
                raise ValueError("GIF has an unknown block")
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if packed & 0x80:
                palette, at = _palette(data, at, packed)
            if palette is None or at >= len(data):
                raise ValueError("GIF frame without palette or data")
            size = data[at]
            stream, at = _blocks(data, at + 1)
            images.append(_Image(left, top, w, h, delay, disposal, transparent, bool(packed & 0x40), palette, size, stream))
            delay, disposal, transparent = 0, 0, None
    except ValueError as e:
        return width, height, images, str(e)
    return width, height, images, None if images else "GIF without a frame"


def decode(data: bytes, band_pixels: int = BAND_PIXELS) -> Iterator[Frame]:
    """Composed frames of a GIF file, in order; damaged data raises ValueError after the good frames.

    A screen of over ``band_pixels`` comes as bands of whole rows: all frames of the first band, then those of
    the next; each band reads the code streams again.  Such a screen is refused if the code streams of its
    file are too short to fill it once, so that what is returned stays in proportion to the file.
    """
    width, height, images, wrong = _read(data)
    rows = max(1, band_pixels // max(width, 1))
    if height > rows and width * height > sum((len(i.stream) * 8 // (i.size + 1) + 1) * MOST_OF_A_CODE for i in images):
        raise ValueError(wrong or f"GIF screen of {width} x {height} is more than its code streams can fill")
    for first in range(0, max(height, 1), rows):
        canvas = np.zeros((min(rows, height - first), width, 4), np.uint8)
        start = 0
        for n, image in enumerate(images):
            a, b = max(first, image.top), min(first + len(canvas), image.top + image.height)
            try:
                samples = image.rows(a - image.top, b - image.top, first > 0)
            except ValueError as e:
                images, wrong = images[:n], str(e)
                break
            before = canvas.copy() if image.disposal == 3 else None
            part = canvas[max(a - first, 0) : max(b - first, 0), image.left : image.left + image.width]
            inside = samples[: part.shape[0], : part.shape[1]]
            colours = image.palette[inside]
            if image.transparent is None:
                part[:] = colours
            else:
                part[inside != image.transparent] = colours[inside != image.transparent]
            yield Frame(image.left, image.top, image.width, image.height, image.delay_ms, image.disposal, image.interlaced, canvas.copy(), n, start, first)
            start += image.delay_ms
            if image.disposal == 2:
                part[:] = 0
            elif image.disposal == 3:
                canvas = before
    if wrong:
        raise ValueError(wrong)


def encode(samples: bytes, delay_ms: int = 100) -> bytes:
    """8-bit samples (a multiple of WIDTH) as a GIF of timed frames, each of up to MOST_ROWS rows."""
    rows = len(samples) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MOST_ROWS), 0xF7, 0, 0), _COLOURS.tobytes()]
    for a in range(0, rows, MOST_ROWS):
        part = samples[a * WIDTH : (a + MOST_ROWS) * WIDTH]
        stream = lzw_encode(part)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_ms // 10, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out += [bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


FRAMES = T.StructType(
    [
        T.StructField("frame", T.IntegerType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("delay_ms", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("first_row", T.IntegerType()),
        T.StructField("rgba", T.BinaryType()),
        T.StructField("histogram", T.ArrayType(T.IntegerType())),
        T.StructField("error", T.StringType()),
    ]
)


def frames(files: DataFrame, key: str, content: str, band_pixels: int = BAND_PIXELS) -> DataFrame:
    """One row (``key``, then FRAMES) for each frame of each GIF in column ``content``.

    A frame of a screen of over ``band_pixels`` has one row for each band: ``height`` rows from ``first_row``
    on, with their own histogram (histograms of a frame's bands add up).  Null, empty or damaged content, a
    file without a frame, and a screen of more than one band that its code streams are too short to fill give
    one row after their good frames, whose ``frame`` is null and whose ``error`` says why.  Null keys stay;
    repeated rows are decoded each; an empty table gives no rows; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for f in decode(data.as_py() or b"", band_pixels):
                        yield one(k, f.number, f.start_ms, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], f.first_row, f.canvas.tobytes(), f.histogram(), None)
                except ValueError as e:
                    yield one(k, *[None] * 8, str(e))

    kind = files.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *FRAMES.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def one(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    return files.select(key, content).mapInArrow(rows, schema)


def _payload(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        out = []
        for i in range(len(offsets) - 1):
            text = raw[offsets[i] : offsets[i + 1]].tobytes()
            media = encode(_payload(text))
            read, counts, n, ms = [], None, 0, 0
            for f in decode(media):
                rgb = f.canvas[: f.height]
                read.append((rgb[:, :, 0] // 36 << 5 | rgb[:, :, 1] // 36 << 2 | rgb[:, :, 2] // 85).tobytes())
                own = f.histogram(f.height)
                counts = own if counts is None else [x + y for x, y in zip(counts, own, strict=True)]
                n, ms = n + 1, ms + f.delay_ms
            back = b"".join(read)
            feature = f"frames={n};ms={ms};histogram={','.join(map(str, counts))}"
            out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store_texts(docs: DataFrame) -> DataFrame:
    """Every text as GIF samples, read back from the stored bytes, with its digests and features.

    Null counts as empty; an empty text is stored as 64 zero samples; a very long text is stored whole,
    as many timed frames.  Equal texts give equal values, whatever their row; an empty table gives no
    rows; other columns, whatever their names, are not read.  ``feature`` sums the colour histograms of
    the frames that were read back.
    """
    bare = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return bare.mapInArrow(_store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
