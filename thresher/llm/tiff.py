"""TIFF media columns: pages written, and directories, strips and tiles read back.

``decode`` walks the image file directories of either byte order, of classic and
of big files, sub-directories after their parent, joins strips or tiles stored
plain, by PackBits, LZW or deflate, undoes the horizontal and the floating-point
predictor and gives one page a directory: samples of 1 to 8 bits one a byte, wider ones
little-endian, the samples of a pixel side by side however the file keeps them. ``encode`` writes
8-bit pages in the same forms. ``pages`` turns a media column into one row a page.

Sizes that a directory claims are checked before any memory is taken: against what its
strips can hold by their compression, and against ``MOST_BYTES`` a page.

Defined cases: null media gives no row; media that isn't a TIFF, or whose chain of directories
is damaged at the start, gives one row with page -1 and the reason in ``error``; a directory that can't be
decoded gives a row with its number and the reason, and the others stay; a chain that
breaks off gives such a row last; repeated rows give
repeated pages; directories met before end the walk; an empty table gives no row; media of any length is read whole;
a column named ``tiff`` is replaced.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
_LETTER = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_SIZES |= {16: 8, 17: 8, 18: 8}
MOST_BYTES = 1 << 28  # of samples a page
#: Bytes that a byte of stored data can give at most.
_GROWTH = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_BROKEN = (ValueError, KeyError, struct.error, zlib.error, IndexError, TypeError, ZeroDivisionError, OverflowError, MemoryError)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    description: str
    pixels: bytes
    bits: int = 8
    error: str | None = None


# ------------------------------------------------------------ codecs


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 1 < n and data[i] == data[i + 1]):
            i += 1
        out.append(i - start - 1)
        out += data[start:i]
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """MSB-first LZW with the early width change of the format."""
    acc, bits, out = 256, 9, bytearray()
    table: dict[int, int] = {}  # (code of the string before << 8 | next byte) to code
    free, width, limit = 258, 9, 511
    w = -1
    get = table.get
    for c in data:
        if w < 0:
            w = c
            continue
        key = w << 8 | c
        if (code := get(key)) is not None:
            w = code
            continue
        acc, bits = acc << width | w, bits + width
        if bits > 256:
            bits -= 256
            out += (acc >> bits).to_bytes(32, "big")
            acc &= (1 << bits) - 1
        table[key] = free
        if free >= 4094:
            acc, bits = acc << width | 256, bits + width
            table.clear()
            free, width, limit = 258, 9, 511
        else:
            if free == limit:
                width += 1
                limit = (1 << width) - 1
            free += 1
        w = c
    if w >= 0:
        acc, bits = acc << width | w, bits + width
        if free == limit and width < 12:  # the reader adds an entry here
            width += 1
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    acc = bits = pos = have = 0
    width, limit, out = 9, 511, []
    fresh = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, prev = list(fresh), None
    while have < size:
        if bits < width:
            chunk = data[pos : pos + 32]
            if not chunk:
                break
            acc, bits, pos = (acc & ((1 << bits) - 1)) << 8 * len(chunk) | int.from_bytes(chunk, "big"), bits + 8 * len(chunk), pos + 32
            if bits < width:
                break
        bits -= width
        code = acc >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, limit, prev = list(fresh), 9, 511, None
            continue
        if prev is None:
            entry = table[code]
        else:
            n = len(table)
            if code < n:
                entry = table[code]
            elif code == n:
                entry = prev + prev[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(prev + entry[:1])
            if n + 2 > limit and width < 12:
                width += 1
                limit = (1 << width) - 1
        out.append(entry)
        have += len(entry)
        prev = entry
    return b"".join(out)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        got = data
    elif compression == PACKBITS:
        got = packbits_decode(data, size)
    elif compression == LZW:
        got = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, max(1, size))
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(got) < size:
        raise ValueError("a strip or tile is shorter than its page needs")
    return got[:size]


def _pack(data: bytes, compression: int, level: int) -> bytes:
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, level) if compression in (DEFLATE, OLD_DEFLATE) else data


# ------------------------------------------------------------ files


def encode(pages: list[tuple[np.ndarray, str]], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: int | None = None, order: str = "<", level: int = 6) -> bytes:
    """A TIFF of 8-bit pages, each (height x width or height x width x samples array, description).
    With ``tile`` (a multiple of 16) pages are stored as square tiles, else as strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image, text in pages:
        x = image[:, :, None] if image.ndim == 2 else image
        h, w, s = x.shape
        if tile:
            pieces = []
            for r in range(0, h, tile):
                for c in range(0, w, tile):
                    t = np.zeros((tile, tile, s), np.uint8)
                    part = x[r : r + tile, c : c + tile]
                    t[: part.shape[0], : part.shape[1]] = part
                    pieces.append(t)
        else:
            pieces = [x[r : r + rows_per_strip] for r in range(0, h, rows_per_strip)]
        offsets, counts = [], []
        for piece in pieces:
            if predictor == 2:
                piece = np.concatenate([piece[:, :1], piece[:, 1:] - piece[:, :-1]], axis=1)
            data = _pack(piece.tobytes(), compression, level)
            offsets.append(len(out)), counts.append(len(data))
            out += data
        note = text.encode() + b"\0"
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8] * s), (259, 3, [compression]), (262, 3, [2 if s == 3 else 1]), (270, 2, note)]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [rows_per_strip]), (279, 4, counts)]
        tags = sorted([*tags, (277, 3, [s]), (317, 3, [predictor])])
        entries = []
        for tag, kind, values in tags:
            raw = bytes(values) if kind == 2 else struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                at = struct.pack(order + "I", len(out))
                out += raw
            else:
                at = raw.ljust(4, b"\0")
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + at)
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries) + bytes(4)
        link = len(out) - 4
    return bytes(out)


def _directories(data: bytes, order: str, big: bool, at: int):
    """The tags of every directory, or the error that ends the walk."""
    head, entry, inline, count_at, step = ("Q", "HHQ", 8, 8, 20) if big else ("H", "HHI", 4, 2, 12)
    link, seen, todo = "Q" if big else "I", set(), [at]
    while todo:
        at = todo.pop()
        if not at or at in seen:
            continue
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + head, data, at)
            if at + count_at + n * step + inline > len(data):
                raise ValueError("a directory runs out of the file")
            tags: dict[int, list | bytes] = {}
            for k in range(n):
                place = at + count_at + step * k
                tag, kind, count = struct.unpack_from(order + entry, data, place)
                size, value = _SIZES.get(kind, 1) * count, place + step - inline
                where = value if size <= inline else struct.unpack_from(order + link, data, value)[0]
                if where + size > len(data):
                    raise ValueError(f"tag {tag} points outside the file")
                tags[tag] = data[where : where + size] if kind in (2, 7) else list(struct.unpack_from(order + _LETTER[kind] * count, data, where)) if kind in _LETTER else []
            (after,) = struct.unpack_from(order + link, data, at + count_at + step * n)
        except _BROKEN as e:
            yield e
            return
        yield tags
        todo += [after, *reversed(tags.get(330, []))]


def decode(data: bytes) -> list[Page]:
    """All pages of a TIFF; one that can't be decoded has its reason in ``error``. Raises ValueError if there is no directory to read."""
    if data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF")
    order = "<" if data[:2] == b"II" else ">"
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + ("Q" if magic == 43 else "I"), data, 8 if magic == 43 else 4)
    out: list[Page] = []
    for tags in _directories(data, order, magic == 43, at):
        try:
            if isinstance(tags, Exception):
                raise tags
            out.append(_page(data, tags, order))
        except _BROKEN as e:
            if isinstance(tags, Exception) and not out:
                raise ValueError(str(e)) from e
            out.append(Page(0, 0, 0, 0, 0, "", b"", 0, str(e) or type(e).__name__))
    return out


def _samples(raw: bytes, rows: int, width: int, samples: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """rows x width x samples of one strip or tile, its predictor undone."""
    if bits < 8:
        line = -(-width * samples * bits // 8)
        ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : width * samples * bits]
        return (ones.reshape(rows, width, samples, bits) @ (1 << np.arange(bits)[::-1])).astype(np.uint8)
    size = bits // 8
    if predictor == 3:  # bytes of each row by significance, highest first, as differences
        x = np.frombuffer(raw, np.uint8).reshape(rows, size * width * samples)
        planes = x.reshape(rows, -1, samples).cumsum(axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).view(f"<u{size}").reshape(rows, width, samples)
    x = np.frombuffer(raw, f"{order}u{size}").astype(f"<u{size}").reshape(rows, width, samples)
    return np.cumsum(x, axis=1, dtype=x.dtype) if predictor == 2 else x


def _page(data: bytes, tags: dict, order: str) -> Page:
    one = lambda tag, default=None: (tags.get(tag) or [default])[0]
    w, h, s = one(256), one(257), one(277, 1)
    compression, predictor, planar = one(259, NONE), one(317, 1), one(284, 1)
    depths = set(tags.get(258) or [1])
    bits = one(258, 1)
    if not w or not h or not s:
        raise ValueError("a directory has no size")
    if len(depths) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64) or planar not in (1, 2) or predictor not in (1, 2, 3) or (predictor == 3 and bits < 16) or (predictor == 2 and bits < 8):
        raise ValueError(f"samples of {sorted(depths)} bits with predictor {predictor} are not supported")
    if compression not in _GROWTH:
        raise ValueError(f"compression {compression} is not supported")
    tiled = 324 in tags
    tw, th = (one(322), one(323)) if tiled else (w, min(one(278, h) or h, h))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down, each = (-(-w // tw) if tiled else 1), -(-h // th), s if planar == 1 else 1
    need, have = -(-w * s * bits // 8) * h, sum(min(c, len(data)) for c in counts) * _GROWTH[compression]
    if need > MOST_BYTES or w * h * s * max(1, bits // 8) > MOST_BYTES or need > have:
        raise ValueError(f"a page of {w} x {h} x {s} samples is more than its strips or the limit allow")
    if len(offsets) != len(counts) or len(offsets) < across * down * (s // each):
        raise ValueError("strips or tiles are missing")
    if th * tw * each * max(1, bits // 8) > 4 * MOST_BYTES:
        raise ValueError("a tile is larger than the limit allows")
    image = np.zeros((h, w, s), np.uint8 if bits <= 8 else f"<u{bits // 8}")
    for plane in range(s // each):
        for k in range(across * down):
            o, c = offsets[plane * across * down + k], counts[plane * across * down + k]
            r, col = (k // across) * th, (k % across) * tw
            rows = th if tiled else min(th, h - r)
            stored = data[o : o + c]
            if one(266, 1) == 2:
                stored = stored.translate(_FLIP)
            x = _samples(_unpack(stored, compression, rows * (-(-tw * each * bits // 8))), rows, tw, each, bits, order, predictor)
            part = image[r : r + rows, col : col + tw, plane * each : plane * each + each]
            part[:] = x[: part.shape[0], : part.shape[1]]
    return Page(w, h, s, compression, predictor, bytes(tags.get(270, b"")).rstrip(b"\0").decode("utf-8", "replace"), image.tobytes(), bits)


# ------------------------------------------------------------ columns

_FIELDS = [("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("description", pa.string()), ("pixels", pa.binary()), ("error", pa.string())]
PAGE_TYPE = "array<struct<page:int,width:long,height:long,samples:int,bits:int,compression:int,predictor:int,description:string,pixels:binary,error:string>>"


def page_rows(media: bytes | None) -> list[dict]:
    if media is None:
        return []
    try:
        found = decode(media)
    except _BROKEN as e:
        return [{"page": -1, "error": str(e) or type(e).__name__}]
    whole = ("width", "height", "samples", "bits", "compression", "predictor", "description", "pixels")
    return [{"page": k, "error": p.error} if p.error else {"page": k, **{n: getattr(p, n) for n in whole}, "error": None} for k, p in enumerate(found)]


def decoded(df: DataFrame, media_col: str = "media", out: str = "pages") -> DataFrame:
    """``df`` with an array column of the pages of a media column."""
    kind = pa.list_(pa.struct(_FIELDS))

    def column(array: pa.Array) -> pa.Array:
        return pa.array([page_rows(x.as_py()) for x in array], kind)

    return df.withColumn(out, F.arrow_udf(column, PAGE_TYPE).asNondeterministic()(F.col(media_col)))


def pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with one row a page: its other columns and a struct column ``tiff`` of the page."""
    return decoded(df, media_col, "__pages").withColumn("tiff", F.explode("__pages")).drop("__pages")


#: The forms that texts are stored in, as compression, predictor and tile (None: strips); a text's own hash picks one.
FORMS = [(DEFLATE, 1, None), (PACKBITS, 1, None), (DEFLATE, 2, 64), (LZW, 1, None), (DEFLATE, 1, 64), (PACKBITS, 2, None), (DEFLATE, 2, None), (LZW, 2, 64)]


def text_media(text: str, columns: int = 64, page_rows: int = 2048) -> bytes:
    """A text's UTF-8 bytes, zero-filled to whole rows, as a grey TIFF of pages of at most ``page_rows`` rows;
    the first page's description has the byte count. Byte order and form follow from the bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // columns))
    image = np.frombuffer(raw.ljust(rows * columns, b"\0"), np.uint8).reshape(rows, columns)
    pick = zlib.crc32(raw)
    compression, predictor, tile = FORMS[pick % len(FORMS)]
    parts = [(image[r : r + page_rows], f"bytes={len(raw)}" if not r else "") for r in range(0, rows, page_rows)]
    return encode(parts, compression, predictor, 256, tile, "<>"[pick >> 8 & 1])


def from_text(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """``df`` with the media column of a text column (null: the empty text)."""

    def column(array: pa.Array) -> pa.Array:
        return pa.array([text_media(x.as_py() or "") for x in array], pa.binary())

    return df.withColumn(out, F.arrow_udf(column, "binary").asNondeterministic()(F.col(text_col)))
