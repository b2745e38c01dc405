"""TIFF media columns: a writer for sample payloads and a reader that emits one row per page.

The reader walks the image directories, takes strips or tiles, decodes none, PackBits, LZW and deflate,
and undoes the horizontal-difference and the floating-point predictor. Bytes whose bits are filled from the low end are turned
around. Samples of 1, 2 and 4 bits come as one byte each; unsigned, signed and floating-point ones are told apart. What the
samples mean (white as zero, palettes) is told by _photometric and left to the reader.
Whatever is wrong with a file is a TiffError, and what it may decode to is limited."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import columns_of, fresh, in_small_batches, quoted, slices, stored

# Fixed values of the public TIFF 6.0 format.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q", 17: "q"}
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8}
CLEAR, END = 256, 257
FORMATS = {1: "u", 2: "i", 3: "f", 4: "u"}
TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: Bytes that one page may decode to.
MAX_PAGE = 1 << 30


class TiffError(ValueError):
    pass


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    photometric: int
    format: str  # of a sample: u, i or f
    pixels: bytes  # rows from the top, samples of a pixel together, little-endian


def unpack_bits(data: bytes, most: int = MAX_PAGE) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
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
    """Runs of two bytes or more, and what lies between them, in packets of 128 at most."""
    x = np.frombuffer(data, dtype=np.uint8)
    start = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1]) if len(x) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(x)))
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for first, n in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        literal(first)
        at = first + n
        while n > 1:
            k = min(n, 128)
            out += bytes((257 - k, data[first]))
            n -= k
        at -= n  # a single one that is left is literal
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int = MAX_PAGE) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early, as the format asks."""
    out, table, previous = [], [], b""
    held, have, width, size = 0, 0, 9, 0
    for byte in data:
        held, have = (held << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code, held = held >> have, held & ((1 << have) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, width, previous = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise TiffError("LZW data does not begin with a clear code")
        if len(table) > 4096:
            raise TiffError("LZW table is full")
        if not previous:
            entry = table[code] if code < 256 else None
        elif code < len(table):
            entry = table[code]
            table.append(previous + entry[:1])
        else:
            entry = previous + previous[:1] if code == len(table) else None
            table.append(entry)
        if entry is None:
            raise TiffError("LZW code out of order")
        out.append(entry)
        size += len(entry)
        if size >= most:
            break
        previous = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    bits, n, codes = 0, 0, {bytes((i,)): i for i in range(256)}
    out, width, size = bytearray(), 9, 258

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = (bits << width) | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n)
            bits &= (1 << n) - 1

    put(CLEAR)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size > 4094:
            put(CLEAR)
            codes, width, size = {bytes((i,)): i for i in range(256)}, 9, 258
        word = data[i : i + 1]
    if word:
        put(codes[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(END)
    if n:
        out.append((bits << (8 - n)) & 255)
    return bytes(out)


def inflate(data: bytes, most: int = MAX_PAGE) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from e


def deflate(data: bytes) -> bytes:
    return zlib.compress(data, 6)


CODECS = {NONE: (bytes, lambda data, most: data[:most]), LZW: (lzw_encode, lzw_decode), PACKBITS: (pack_bits, unpack_bits), DEFLATE: (deflate, inflate), OLD_DEFLATE: (deflate, inflate)}


def _difference(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def _undo(raw: bytes, rows: int, columns: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """A strip's or tile's samples as an array (rows, columns, samples) of little-endian unsigned numbers."""
    if bits < 8:  # rows begin at whole bytes, the first sample in the high bits
        line = -(-columns * samples * bits // 8)
        if len(raw) < rows * line or predictor != 1:
            raise TiffError("a strip or tile is too short" if predictor == 1 else f"predictor {predictor} with {bits} bits")
        each = np.unpackbits(np.frombuffer(raw[: rows * line], dtype=np.uint8).reshape(rows, line), axis=1)
        each = each[:, : columns * samples * bits].reshape(rows, columns, samples, bits)
        return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    size = bits // 8
    want = rows * columns * samples * size
    if len(raw) < want:
        raise TiffError("a strip or tile is too short")
    if predictor == 3:  # bytes of a row by significance, differenced
        flat = np.cumsum(np.frombuffer(raw[:want], dtype=np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        planes = flat.reshape(rows, size, columns * samples)[:, ::-1, :]  # now little-endian
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f"<u{size}").reshape(rows, columns, samples)
    block = np.frombuffer(raw[:want], dtype=f"{order}u{size}").astype(f"<u{size}").reshape(rows, columns, samples)
    if predictor == 2:
        block = np.cumsum(block, axis=1, dtype=f"<u{size}")
    elif predictor != 1:
        raise TiffError(f"predictor {predictor}")
    return block


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    try:
        while at:
            if at in seen:
                raise TiffError("directories form a ring")
            seen.add(at)
            fields = {}
            n = struct.unpack_from(order + "H", data, at)[0]
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind not in FIELD:
                    continue
                where = at + 10 + 12 * i
                if WIDTHS[kind] * count > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                fields[tag] = struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, where)
            yield order, fields
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise TiffError(f"cut short: {e}") from e


def _need(fields: dict[int, tuple], tag: int, what: str) -> tuple:
    if not fields.get(tag):
        raise TiffError(f"no {what}")
    return fields[tag]


def _one(fields: dict[int, tuple], tag: int, otherwise: int) -> int:
    return (fields.get(tag) or (otherwise,))[0]


def pages(data: bytes, max_page: int = MAX_PAGE) -> Iterator[Page]:
    for number, (order, f) in enumerate(directories(data)):
        width, height = _need(f, WIDTH, "width")[0], _need(f, HEIGHT, "height")[0]
        samples, bits = _one(f, SAMPLES, 1), _one(f, BITS, 1)
        compression, predictor, planar = _one(f, COMPRESSION, 1), _one(f, PREDICTOR, 1), _one(f, PLANAR, 1)
        fill, photometric, formats = _one(f, FILL_ORDER, 1), _one(f, PHOTOMETRIC, 1), set(f.get(SAMPLE_FORMAT, (1,)))
        kind = FORMATS.get(min(formats))
        if len({FORMATS.get(x) for x in formats}) > 1 or kind is None or kind == "f" and bits not in (16, 32, 64) or fill not in (1, 2):
            raise TiffError(f"sample format {sorted(formats)} with {bits} bits, fill order {fill}")
        if compression not in CODECS or bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(f.get(BITS, (1,)))) > 1:
            raise TiffError(f"compression {compression} with {bits} bits")
        size = max(1, bits // 8)
        tiled = TILE_OFFSETS in f
        if tiled:
            tw, th = _need(f, TILE_WIDTH, "tile width")[0], _need(f, TILE_HEIGHT, "tile height")[0]
        else:
            tw, th = width, min(_one(f, ROWS_PER_STRIP, height), height)
        if min(width, height, samples, tw, th) < 1:
            raise TiffError("no pixels")
        if max(width * height, tw * th) * samples * size > max_page:
            raise TiffError(f"{width} x {height} pixels are over the limit")
        offsets = _need(f, TILE_OFFSETS, "tiles") if tiled else _need(f, STRIP_OFFSETS, "strips")
        counts = _need(f, TILE_COUNTS, "tile sizes") if tiled else _need(f, STRIP_COUNTS, "strip sizes")
        across, down = -(-width // tw), -(-height // th)
        planes, each = (samples, 1) if planar == 2 else (1, samples)
        if len(offsets) != len(counts) or len(offsets) < across * down * planes:
            raise TiffError(f"{len(offsets)} offsets and {len(counts)} sizes for {across * down * planes} strips or tiles")
        out = np.zeros((height, width, samples), dtype=f"<u{size}")
        for k in range(across * down * planes):
            plane, row, column = k // (across * down), k // across % down, k % across
            rows = th if tiled else min(th, height - row * th)
            most = rows * -(-tw * each * bits // 8)
            packed = data[offsets[k] : offsets[k] + counts[k]]
            raw = CODECS[compression][1](packed if fill == 1 else packed.translate(TURNED), most)
            block = _undo(raw, rows, tw, each, bits, predictor, order)
            y, x = row * th, column * tw
            target = out[y : y + th, x : x + tw, plane : plane + each]
            target[...] = block[: target.shape[0], : target.shape[1]]
        yield Page(number, width, height, samples, bits, compression, predictor, photometric, kind, out.tobytes())


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file with one page per image: arrays (rows, columns) or (rows, columns, samples) of unsigned, signed or floating-point
    numbers."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        size = image.dtype.itemsize
        kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
        image = image.view(f"{image.dtype.byteorder if size > 1 else '|'}u{size}") if kind > 1 else image
        th, tw = tile or (rows_per_strip, width)
        offsets, counts = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = image[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = _difference(block)
                if predictor == 3:
                    planes = np.ascontiguousarray(block.astype(f">u{size}").reshape(len(block), -1, 1)).view(np.uint8).reshape(len(block), -1, size)
                    raw = _difference(planes.transpose(0, 2, 1).reshape(len(block), -1, samples)).tobytes()
                else:
                    raw = block.astype(f"{order}u{size}").tobytes()
                packed = CODECS[compression][0](raw)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        entries = [(WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (8 * size,) * samples), (COMPRESSION, 3, (compression,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (samples,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,))] + [(SAMPLE_FORMAT, 3, (kind,) * samples)] * (kind > 1)
        entries += [(TILE_WIDTH, 4, (tw,)), (TILE_HEIGHT, 4, (th,)), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, (th,)), (STRIP_COUNTS, 4, counts)]
        rows = b""
        for tag, kind, values in sorted(entries):
            value = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(value) > 4:
                out += b"\0" * (len(out) % 2)
                place = len(out)
                out += value
                value = struct.pack(order + "I", place)
            rows += struct.pack(order + "HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + rows
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload(text: str | None) -> bytes:
    """UTF-8 with bytes 0 appended up to a positive multiple of 64."""
    b = (text or "").encode()
    return b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")


#: Rows of 64 samples on a page of a stored text.
PAGE_ROWS = 1024


def file_of(data: bytes) -> bytes:
    """A payload as a file: pages of 64 columns and at most PAGE_ROWS rows. Every byte of its CRC-32 decides something, so
    that a corpus holds all forms: codec, byte order of numbers, predictor, strips or tiles."""
    mark = zlib.crc32(data)
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, 64)
    images = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    compression = (DEFLATE, OLD_DEFLATE, DEFLATE, LZW, PACKBITS, DEFLATE)[mark % 6]
    return encode(images, compression, 1 + (mark >> 8 & 1), 256, (32, 32) if mark >> 16 & 1 else None, "<>"[mark >> 24 & 1])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_pages, media): each text's payload as a file of 8-bit samples (see file_of); equal texts give
    equal files. A null text is empty; other columns are not read."""

    def run(batches):
        for batch in slices(batches):
            sizes, n_pages, media = [], [], []
            for text in batch.column(1).to_pylist():
                data = payload(text)
                sizes.append(len((text or "").encode()))
                n_pages.append(-(-len(data) // (64 * PAGE_ROWS)))
                media.append(file_of(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n_pages, pa.int32()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "n_pages", "media"])

    return docs.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_pages int, media binary")


PAGE = {"_page": "int", "_width": "int", "_height": "int", "_samples": "int", "_bits": "int", "_compression": "int", "_predictor": "int", "_photometric": "int", "_format": "string", "_pixels": "binary", "_feature": "string", "_error": "string"}


def feature(page: Page) -> str:
    """Size, mean and deviation of the samples, and a 64-bit mean hash over a grid of 8 by 8."""
    x = np.frombuffer(page.pixels, dtype=f"<{page.format if page.bits >= 8 else 'u'}{max(1, page.bits // 8)}")
    flat = np.add.reduceat(x, np.linspace(0, len(x), 64, endpoint=False).astype(np.int64), dtype=np.float64) if len(x) >= 64 else np.zeros(64)
    mark = int("".join("1" if v > flat.mean() else "0" for v in flat), 2)
    return f"{page.width}x{page.height}x{page.samples}:{page.bits}:{x.mean() if len(x) else 0:.4f}:{x.std() if len(x) else 0:.4f}:{mark:016x}"


def decode_pages(media: DataFrame, media_col: str = "media", max_page: int = MAX_PAGE) -> DataFrame:
    """One row per page of the files in `media_col`, with all other columns and, last, _page, _width, _height, _samples,
    _bits, _compression, _predictor, _photometric, _format (u, i or f), _pixels, _feature and _error; where `media` has a column of that name, ours has more
    underscores behind.

    A null or unreadable file, and one with a page of more than `max_page` bytes, gives one row with null page columns and
    what was wrong in _error; pages read before the damage are given too."""
    keep = [c for c in media.columns if c != media_col]
    own = fresh(media.columns, *PAGE)
    schema = ", ".join([f"{quoted(c)} {media.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, t in zip(own, PAGE.values(), strict=True)])
    names = [*keep, *own]
    kinds = [pa.int32()] * 8 + [pa.string(), pa.binary(), pa.string(), pa.string()]

    def run(batches):
        for batch in slices(batches):
            who, rows, size = [], [], 0

            def flush(batch=batch):
                carried = [batch.column(i).take(pa.array(who, pa.int64())) for i in range(1, batch.num_columns)]
                return pa.RecordBatch.from_arrays(carried + [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))], names)

            for i, data in enumerate(batch.column(0)):
                try:
                    if not data.is_valid:
                        raise TiffError("null")
                    for p in pages(data.as_py(), max_page):
                        who.append(i)
                        rows.append((p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.photometric, p.format, p.pixels, feature(p), None))
                        size += len(p.pixels)
                        if size > 16_000_000:  # pages go out as they come
                            yield flush()
                            who, rows, size = [], [], 0
                except TiffError as e:
                    who.append(i)
                    rows.append((None,) * (len(kinds) - 1) + (str(e),))
            yield flush()

    return media.select(F.col(quoted(media_col)), *columns_of(media, media_col)).mapInArrow(run, schema)


@in_small_batches
def read_texts(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, payload, feature) of the stored rows of store_texts, read back page by
    page: payload is all pages' samples, feature all pages' features. Files of one page stay in place; the others, long
    texts, are put together by file, each distinct file once."""
    marked = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    columns = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    short = decode_pages(marked.filter("n_pages = 1")).select(*columns, F.col("_pixels").alias("payload"), F.col("_feature").alias("feature"))
    long = marked.filter("n_pages > 1")
    files = decode_pages(long.select("media_sha256", "media").dropDuplicates(["media_sha256"])).groupBy("media_sha256").agg(F.array_sort(F.collect_list(F.struct("_page", "_pixels", "_feature"))).alias("p"))
    files = files.select("media_sha256", F.col("p._pixels").alias("parts"), F.array_join("p._feature", "|").alias("feature"))

    def run(batches):
        for batch in slices(batches, 16):
            joined = [b"".join(x) for x in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("media_sha256"), pa.array(joined, pa.binary()), batch.column("feature")], ["media_sha256", "payload", "feature"])

    whole = stored(files.mapInArrow(run, "media_sha256 string, payload binary, feature string"))
    return short.unionByName(long.select(*columns).join(whole, "media_sha256").select(*columns, "payload", "feature"))
