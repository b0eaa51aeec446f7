"""GIF media: LZW code streams, palettes, disposal, transparency and timed frames.

decode() reads any GIF87a/89a file; frames() composes what a viewer shows;
encode() writes frames of 8-bit samples. gif_frames() turns a column of files
into rows of timed frames with colour histograms. payloads() stores bytes as
samples of a colour palette, reads them back and describes the frames shown.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, slices

MAX_BITS = 12
WIDTH, MAX_ROWS = 64, 65535
#: Most pixels of a canvas or frame, so that a short file can't ask for more memory than a task has.
MAX_PIXELS = 1 << 25
#: Three bits of red, three of green, two of blue.
COLOURS = np.stack([np.arange(256) >> 5, np.arange(256) >> 2 & 7, np.arange(256) & 3], axis=1) * np.array([36, 36, 85])
COLOURS = COLOURS.astype(np.uint8)


def widths(n: int, least: int) -> np.ndarray:
    """The bits of the first n codes after a clear code."""
    known = (1 << (least - 1)) + 1 + np.arange(n)  # the code that the decoder would add next, less one
    return np.clip(np.floor(np.log2(known)).astype(np.int64) + 1, least, MAX_BITS)


WIDTHS = {k: widths(5000, k + 1) for k in range(2, 9)}


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of samples below 1 << size; a clear code when the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    codes, runs, begun = [clear], [], 0
    if data:
        table: dict[int, int] = {}
        get, put, now, new = table.get, codes.append, data[0], end + 1
        for b in data[1:]:
            key = now << 8 | b
            code = get(key)
            if code:
                now = code
                continue
            put(now)
            now = b
            if new < 1 << MAX_BITS:
                table[key] = new
                new += 1
            else:
                put(clear)
                runs.append(len(codes) - 1 - begun)
                begun = len(codes) - 1
                table.clear()
                new = end + 1
        put(now)
    put = codes.append
    put(end)
    runs.append(len(codes) - 1 - begun)
    codes = np.array(codes, np.uint16)
    bits = np.concatenate([[size + 1], *(WIDTHS[size][:n] for n in runs)])
    flags = (codes[:, None] >> np.arange(MAX_BITS, dtype=np.uint16) & 1).astype(np.uint8)
    return np.packbits(flags[np.arange(MAX_BITS) < bits[:, None]], bitorder="little").tobytes()


def expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of one run of codes. The entry that code j adds is its string
    and the next code's first sample, so a later use of it repeats the samples
    from where j's string stands: every sample points back to an earlier one, and
    the pointers are followed by doubling."""
    plain = codes < clear
    if plain.all():
        return codes.astype(np.uint8)
    refers = np.where(plain, np.arange(len(codes)), codes - (clear + 2))
    if (refers[~plain] >= np.flatnonzero(~plain)).any():
        raise ValueError("a code that the table doesn't have")
    length, to = np.where(plain, 0, 1), refers
    while True:
        more = length[to]
        if not more.any():
            break
        length, to = length + more, to[to]
    length = length + 1
    place = np.cumsum(length) - length
    each = np.repeat(place[refers] - place, length)
    source = np.arange(len(each)) + each
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    first = np.zeros(len(each), np.uint8)
    first[place[plain]] = codes[plain]
    return first[source]


def lzw_decode(stream: bytes, size: int = 8) -> bytes:
    """The samples of a code stream; one that breaks off gives what it has."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, at, out, run = 8 * len(stream), 0, [], []
    w, read = WIDTHS[size], 0
    while True:
        # a full table keeps 12 bits until a clear code; the table of widths goes on past that
        bits = w[read: read + 4000] if read < len(w) else w[-1000:]
        place = at + np.cumsum(bits) - bits
        ok = int(np.searchsorted(place + bits, total, side="right"))
        if not ok:
            break
        place = place[:ok]
        codes = (wide[place >> 3] >> (place & 7).astype(np.uint32) & ((1 << bits[:ok]) - 1).astype(np.uint32)).astype(np.int64)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else ok
        run.append(codes[:n])
        if not len(stop):
            at, read = int(place[-1] + bits[ok - 1]), read + ok
            continue
        out.append(np.concatenate(run))
        run, read = [], 0
        at = int(place[n] + bits[n])
        if codes[n] == end:
            break
    return b"".join([expand(c, clear).tobytes() for c in (*out, *run) if len(c)])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    samples: bytes
    transparent: int | None = None
    delay_ms: int = 0
    disposal: int = 0


def sub_blocks(data: bytes) -> bytes:
    return b"".join([bytes([len(data[i: i + 255])]) + data[i: i + 255] for i in range(0, len(data), 255)]) + b"\0"


def encode(width: int, height: int, frames: list[Frame], palette: np.ndarray = COLOURS) -> bytes:
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | (f.transparent is not None), f.delay_ms // 10, f.transparent or 0, 0))
        own = f.palette is not palette
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, f.width, f.height, 0x87 if own else 0))
        if own:
            out.append(np.vstack([f.palette, np.zeros((256 - len(f.palette), 3), np.uint8)]).astype(np.uint8).tobytes())
        out += [b"\x08", sub_blocks(lzw_encode(f.samples))]
    return b"".join(out) + b"\x3B"


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames, samples in row order."""
    width, height, found = opened(data)
    return width, height, list(found)


def opened(data: bytes) -> tuple[int, int, Iterator[Frame]]:
    """Width, height, and the frames one after another, so that those before a broken one are there."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MAX_PIXELS:
        raise ValueError("too large a canvas")
    return width, height, read_frames(data, flags)


def read_frames(data: bytes, flags: int) -> Iterator[Frame]:
    at, common = 13, COLOURS

    def palette(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 3 << (flags & 7) + 1
        return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1: at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    if flags & 0x80:
        common, at = palette(at, flags)
    told = (None, 0, 0)
    while at < len(data) and data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label = data[at]
            body, at = blocks(at + 1)
            if label == 0xF9 and len(body) >= 4:
                how, delay, clear = struct.unpack_from("<BHB", body)
                told = (clear if how & 1 else None, delay * 10, how >> 2 & 7)
        elif kind == 0x2C:
            left, top, w, h, how = struct.unpack_from("<HHHHB", data, at)
            at += 9
            own = common
            if how & 0x80:
                own, at = palette(at, how)
            size = data[at]
            if not 2 <= size <= 8 or w * h > MAX_PIXELS:
                raise ValueError("a code size or frame that GIF doesn't have")
            body, at = blocks(at + 1)
            samples = lzw_decode(body, size)[: w * h].ljust(w * h, b"\0")
            if how & 0x40:  # interlaced: rows come in four passes
                rows = np.frombuffer(samples, np.uint8).reshape(h, w)
                order = np.concatenate([np.arange(s, h, step) for s, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
                samples = rows[np.argsort(order)].tobytes()
            yield Frame(left, top, w, h, own, samples, *told)
            told = (None, 0, 0)
        else:
            raise ValueError("an unknown block")


def compose(width: int, height: int, found: Iterable[Frame]) -> Iterator[tuple[np.ndarray, int]]:
    """What is shown, as RGBA of the whole canvas, and for how many milliseconds."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in found:
        before = canvas.copy() if f.disposal == 3 else None
        index = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3], colours[:, 3] = f.palette, 255
        area = canvas[f.top: f.top + f.height, f.left: f.left + f.width]
        index = index[: area.shape[0], : area.shape[1]]
        if f.transparent is None:
            area[:] = colours[index]
        else:
            seen = index != f.transparent
            area[seen] = colours[index[seen]]
        yield canvas.copy(), f.delay_ms
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            canvas = before


def frames(data: bytes) -> Iterator[tuple[np.ndarray, int]]:
    return compose(*opened(data))


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Opaque pixels by the top two bits of red, green and blue: 64 counts."""
    p = rgba >> 6
    return np.bincount((p[..., 0] << 4 | p[..., 1] << 2 | p[..., 2])[rgba[..., 3] > 0], minlength=64)


def gif_frames(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row a frame: id, frame, start_ms, delay_ms, width, height, rgba, histogram.
    A null file gives no rows; one that isn't GIF, breaks off inside a header, or has a
    canvas or frame of more than MAX_PIXELS gives a row with frame -1 and no pixels
    after the frames before. Equal rows give equal rows; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64()))])
        for b in batches:
            for name, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if media is None:
                    continue
                start = 0
                try:
                    for k, (rgba, delay) in enumerate(frames(media)):
                        row = {"id": name, "frame": k, "start_ms": start, "delay_ms": delay, "width": rgba.shape[1], "height": rgba.shape[0], "rgba": rgba.tobytes(), "histogram": histogram(rgba).tolist()}
                        yield pa.RecordBatch.from_pylist([row], schema)
                        start += delay
                except (ValueError, IndexError, struct.error):
                    yield pa.RecordBatch.from_pylist([{"id": name, "frame": -1}], schema)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, "id long, frame int, start_ms long, delay_ms int, width int, height int, rgba binary, histogram array<long>")


def store(payload: bytes, delay_ms: int = 40) -> bytes:
    """A file whose frames' samples are the payload, 64 a row; its length is a multiple of
    64. Each frame's place is cleared before the next one is shown."""
    step = WIDTH * MAX_ROWS
    parts = [payload[i: i + step] for i in range(0, len(payload), step)]
    shown = [Frame(0, 0, WIDTH, len(p) // WIDTH, COLOURS, p, None, delay_ms, 2) for p in parts]
    return encode(WIDTH, shown[0].height, shown)


def payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text's UTF-8 (null: empty), zero-padded to a positive multiple of 64,
    and describes what the stored file holds. The feature is the number of frames shown,
    the whole time and the colour histogram over all of them. Equal texts have equal
    values, an empty table gives no rows, other columns are left out; a text of more
    than 64 * MAX_ROWS bytes takes several frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode("utf-8")
                media = store(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))
                width, height, found = decode(media)
                back = b"".join([f.samples for f in found])
                colours = sum(histogram(rgba) for rgba, _ in compose(width, height, found))
                feature = f"frames={len(found)} ms={sum(f.delay_ms for f in found)} colours={','.join(map(str, colours.tolist()))}"
                rows.append((name, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds)], names)

    rows = df.select(named(id_col).cast("long").alias("i"), F.coalesce(named(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
