"""Media columns: baseline JPEG.

Bytes are stored as the 8 x 8 blocks of grey baseline JPEGs, one byte the DC
coefficient of one block, so that the image's DC-only luminance thumbnail is
the bytes themselves. Reading parses the markers, Huffman-decodes the scan and
rebuilds the thumbnail. Restart intervals of one row of blocks make the rows
independent, and all rows of a run of images are decoded in step with numpy;
images of other encoders (colour, AC coefficients) take a plain decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks in a row of the images written, and rows of blocks at most (JPEG's
#: height is 16 bits): longer payloads are several images, one behind the other.
ROW, ROWS = 64, 8191
QUANT = 8
#: Code lengths and categories of the usual DC luminance table.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: The AC table written has one code, end of block.
AC_BITS = (1,) + (0,) * 15
AC_VALUES = (0,)


def huffman(bits, values) -> list[tuple[int, int, int]]:
    """(length, code, value) of a table's codes."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((length, code, values[at]))
            code += 1
            at += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int, width: int = ROW) -> bytes:
    """All up to the scan of a grey image of rows x width blocks."""
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([QUANT]) * 64)
        + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, width * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(DC_VALUES))
        + _segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_VALUES))
        + _segment(0xDD, struct.pack(">H", width))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _block_codes():
    """By difference + 255: number of bits and code of a block of that DC
    difference and no AC coefficient."""
    size, code = np.zeros(511, np.int64), np.zeros(511, np.int64)
    by_value = {v: (n, c) for n, c, v in huffman(DC_BITS, DC_VALUES)}
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        n, c = by_value[cat]
        extra = d if d >= 0 else d + (1 << cat) - 1
        size[d + 255], code[d + 255] = n + cat + 1, ((c << cat) | extra) << 1  # and end of block, one 0
    return size, code


def encode(payload: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """JPEGs of payloads that lie one behind the other, each a multiple of ROW
    bytes; ends: where each ends."""
    size, code = _block_codes()
    v = payload.reshape(-1, ROW).astype(np.int64) - 128
    d = np.diff(v, axis=1, prepend=0) + 255
    n, c = size[d], code[d]
    at = np.cumsum(n, axis=1)
    bits = at[:, -1].copy()
    at -= n
    length = (bits + 7) >> 3
    start = np.cumsum(length) - length
    raw = np.zeros(int(length.sum()) + 3, np.uint8)
    for j in range(ROW):  # a code has at most 15 bits and touches at most 3 bytes; rows never share one
        p = start + (at[:, j] >> 3)
        w = c[:, j] << (24 - n[:, j] - (at[:, j] & 7))
        raw[p] |= (w >> 16).astype(np.uint8)
        raw[p + 1] |= (w >> 8 & 255).astype(np.uint8)
        raw[p + 2] |= (w & 255).astype(np.uint8)
    raw = raw[:-3]
    pad = length * 8 - bits
    raw[start + length - 1] |= ((1 << pad) - 1).astype(np.uint8)

    # images: runs of at most ROWS rows of one payload
    row_ends = ends // ROW
    first = np.concatenate([[0], row_ends[:-1]])
    cuts = [(i, r, min(r + ROWS, int(e))) for i, (s, e) in enumerate(zip(first, row_ends, strict=True)) for r in range(int(s), int(e), ROWS)]
    marked = np.ones(len(length), bool)  # rows that a restart marker follows
    marked[[z - 1 for _, _, z in cuts]] = False
    within = np.arange(len(length)) - np.repeat([r for _, r, _ in cuts], [z - r for _, r, z in cuts])
    stuffed = raw == 0xFF
    shift = np.cumsum(stuffed) - stuffed
    row_of = np.repeat(np.arange(len(length)), length)
    before = 2 * (np.cumsum(marked) - marked)
    place = np.arange(len(raw)) + shift + before[row_of]
    out = np.zeros(len(raw) + int(stuffed.sum()) + 2 * int(marked.sum()), np.uint8)
    out[place] = raw
    last = start + length - 1
    row_end = place[last] + 1 + stuffed[last]
    m = np.flatnonzero(marked)
    out[row_end[m]] = 0xFF
    out[row_end[m] + 1] = 0xD0 + (within[m] & 7)
    made: list[list[bytes]] = [[] for _ in ends]
    for i, r, z in cuts:
        made[i].append(header(z - r) + out[place[start[r]] : row_end[z - 1]].tobytes() + b"\xff\xd9")
    return [b"".join(m) for m in made]


# ---- reading -------------------------------------------------------------------------


class Image:
    """What an image's markers say, and its entropy-coded bytes."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.quant, self.dc, self.ac, self.interval = {}, {}, {}, 0
        at += 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            if marker == 0xDB:
                while body:
                    wide, i = body[0] >> 4, body[0] & 15
                    self.quant[i] = int.from_bytes(body[1 : 2 + wide], "big")  # the DC entry
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0 or marker == 0xC1:
                self.height, self.width, parts = struct.unpack(">xHHB", body[:6])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xC4:
                while body:
                    kind, i, n_values = body[0] >> 4, body[0] & 15, sum(body[1:17])
                    (self.ac if kind else self.dc)[i] = (bytes(body[1:17]), bytes(body[17 : 17 + n_values]))
                    body = body[17 + n_values :]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            at += 2 + n
            if marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
        end = at
        while True:  # restart markers and stuffed bytes belong to the scan
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                raise ValueError("the scan does not end")
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
                continue
            break
        self.start, self.end = at, end
        self.coded = data[at:end]
        self.next = end + 2

    def simple(self):
        """The tables, if all blocks are DC and end of block only and one look at 16 bits can hold one."""
        if len(self.parts) != 1 or len(self.scan) != 1 or not self.interval:
            return None
        ac = self.ac[self.scan[0][2]]
        return (self.dc[self.scan[0][1]], ac) if ac == (bytes(AC_BITS), bytes(AC_VALUES)) and max(v for v in self.dc[self.scan[0][1]][1]) <= 11 else None

    def blocks(self) -> tuple[int, int]:
        return -(-self.height // 8), -(-self.width // 8)


_LOOK: dict = {}


def _look(tables) -> np.ndarray:
    """By the next 16 bits: bits of the block << 16 | DC difference + 32768; 0
    where a block is longer than that or the code is not one."""
    if tables not in _LOOK:
        (bits, values), ac = tables
        out = np.zeros(1 << 16, np.int64)
        for n, c, cat in huffman(bits, values):
            total = n + cat + 1
            if total > 16:
                continue
            extra = np.arange(1 << cat)
            diff = np.where(extra >= (1 << cat >> 1), extra, extra - (1 << cat) + 1) if cat else extra * 0
            for e, d in zip(extra.tolist(), diff.tolist(), strict=True):
                lo = ((c << cat | e) << 1) << (16 - total)
                out[lo : lo + (1 << (16 - total))] = total << 16 | (d + 32768)
        _LOOK[tables] = out
    return _LOOK[tables]


def _in_step(images: list[Image], tables) -> list[np.ndarray]:
    """DC coefficients of simple images with the same tables, all restart
    intervals decoded in step."""
    look = _look(tables)
    coded = np.frombuffer(b"".join(i.coded for i in images), np.uint8)
    bounds = np.cumsum([0] + [len(i.coded) for i in images])
    full = coded == 0xFF
    follows = np.concatenate([[False], full[:-1]])
    restart = follows & (coded >= 0xD0) & (coded <= 0xD7)
    drop = (follows & (coded == 0)) | restart
    drop[:-1] |= restart[1:]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    clean = np.concatenate([coded[~drop], np.zeros(4, np.uint8)]).astype(np.int64)
    begin = np.sort(np.concatenate([kept[bounds[:-1]], kept[np.flatnonzero(restart) + 1]]))
    n_blocks = [i.blocks()[0] * i.blocks()[1] for i in images]
    counts = np.concatenate([np.minimum(i.interval, n - np.arange(0, n, i.interval)) for i, n in zip(images, n_blocks, strict=True)])
    if len(counts) != len(begin):
        raise ValueError("restart markers do not match the image's size")
    three = (clean[:-2] << 16) | (clean[1:-1] << 8) | clean[2:]
    at, dc = begin * 8, np.zeros(len(begin), np.int64)
    out = np.zeros((len(begin), int(counts.max())), np.int64)
    for j in range(out.shape[1]):
        got = look[(three[np.minimum(at >> 3, len(three) - 1)] >> (8 - (at & 7))) & 0xFFFF]
        if (got[counts > j] == 0).any():
            raise ValueError("a code is damaged")
        at = at + (got >> 16)
        dc = dc + (got & 0xFFFF) - 32768
        out[:, j] = dc
    flat = out[np.arange(out.shape[1]) < counts[:, None]]
    return np.split(flat, np.cumsum(n_blocks)[:-1])


def _plain(image: Image) -> np.ndarray:
    """DC coefficients of the first component, in rows of blocks, of any baseline JPEG."""
    codes = {}
    for kind, tables in ((0, image.dc), (1, image.ac)):
        for i, (bits, values) in tables.items():
            codes[kind, i] = {(n, c): v for n, c, v in huffman(bits, values)}
    parts = {p[0]: p for p in image.parts}
    scan = [(parts[c], d, a) for c, d, a in image.scan]
    h_most, v_most = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    single = len(scan) == 1
    wide, high = -(-image.width // (8 * h_most)), -(-image.height // (8 * v_most))
    lead = scan[0][0]
    if single:
        wide, high = -(-image.width * lead[1] // (8 * h_most)), -(-image.height * lead[2] // (8 * v_most))
    rows, cols = (high, wide) if single else (high * lead[2], wide * lead[1])
    out = np.zeros((rows, cols), np.int64)
    pieces, lo = [], 0
    data = image.coded
    while True:  # restart intervals, without stuffed bytes
        i = lo
        while True:
            i = data.find(b"\xff", i)
            if i < 0 or 0xD0 <= data[i + 1] <= 0xD7:
                break
            i += 2
        pieces.append(data[lo : i if i >= 0 else len(data)].replace(b"\xff\x00", b"\xff"))
        if i < 0:
            break
        lo = i + 2
    unit, n_units = 0, wide * high
    for piece in pieces:
        value, left = int.from_bytes(piece, "big"), len(piece) * 8

        def take(n):
            nonlocal left
            left -= n
            if left < 0:
                raise ValueError("the scan is cut short")
            return value >> left & ((1 << n) - 1)

        def symbol(table):
            c = 0
            for n in range(1, 17):
                c = c << 1 | take(1)
                if (n, c) in table:
                    return table[n, c]
            raise ValueError("a code is damaged")

        pred = [0] * len(scan)
        for _ in range(image.interval or n_units):
            if unit >= n_units:
                break
            my, mx = divmod(unit, wide)
            for s, (part, d, a) in enumerate(scan):
                for by in range(1 if single else part[2]):
                    for bx in range(1 if single else part[1]):
                        cat = symbol(codes[0, d])
                        e = take(cat) if cat else 0
                        pred[s] += e if not cat or e >> (cat - 1) else e - (1 << cat) + 1
                        if s == 0:
                            out[(my, mx) if single else (my * part[2] + by, mx * part[1] + bx)] = pred[s]
                        k = 1
                        while k < 64:
                            rs = symbol(codes[1, a])
                            if rs & 15:
                                take(rs & 15)
                                k += (rs >> 4) + 1
                            elif rs == 0xF0:
                                k += 16
                            else:
                                break
            unit += 1
    rows, cols = -(-image.height * lead[2] // (8 * v_most)), -(-image.width * lead[1] // (8 * h_most))
    return out[:rows, :cols]


def thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """DC-only luminance thumbnails (a pixel a block) of the images in each value."""
    images, owner = [], []
    for i, data in enumerate(media):
        at = 0
        while at < len(data):
            images.append(Image(data, at))
            owner.append(i)
            at = images[-1].next
    groups: dict = {}
    for j, image in enumerate(images):
        groups.setdefault(image.simple(), []).append(j)
    out: list[list[np.ndarray]] = [[] for _ in media]
    done: dict[int, np.ndarray] = {}
    for tables, members in groups.items():
        if tables is None:
            for j in members:
                done[j] = _plain(images[j])
        else:
            for j, dc in zip(members, _in_step([images[j] for j in members], tables), strict=True):
                done[j] = dc.reshape(images[j].blocks())
    for j, image in enumerate(images):
        q = image.quant[image.parts[0][3]]
        out[owner[j]].append(np.clip((done[j] * q + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return out


def thumbnail_hash(t: np.ndarray) -> str:
    """64 bits in hex: cells of an 8 x 8 grid of the thumbnail above its mean."""
    rows, cols = (np.arange(9) * n // 8 for n in t.shape)
    sums = np.concatenate([np.zeros((1, t.shape[1])), np.cumsum(t, axis=0, dtype=np.float64)])
    sums = sums[np.maximum(rows[1:], rows[:-1] + 1).clip(max=t.shape[0])] - sums[np.minimum(rows[:-1], t.shape[0] - 1)]
    sums = np.concatenate([np.zeros((8, 1)), np.cumsum(sums, axis=1)], axis=1)
    hi, lo = np.maximum(cols[1:], cols[:-1] + 1).clip(max=t.shape[1]), np.minimum(cols[:-1], t.shape[1] - 1)
    area = np.outer(np.maximum(rows[1:], rows[:-1] + 1).clip(max=t.shape[0]) - np.minimum(rows[:-1], t.shape[0] - 1), hi - lo)
    cells = (sums[:, hi] - sums[:, lo]) / area
    return np.packbits(cells > t.mean()).tobytes().hex()


# ---- columns ---------------------------------------------------------------------------


def _store(batches):
    for b in batches:
        texts = b.column(1).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, total, parts, ends, n = lo, 0, [], [], []
            while hi < len(texts) and (hi == lo or total < 1 << 20):
                raw = (texts[hi] or "").encode("utf-8", "surrogatepass")
                n.append(len(raw))
                parts.append(raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)))
                total += len(parts[-1])
                ends.append(total)
                hi += 1
            media = encode(np.frombuffer(b"".join(parts), np.uint8), np.array(ends))
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
            lo = hi


def stored_media(docs: DataFrame) -> DataFrame:
    """Texts as JPEG columns: doc_id, n_bytes (of the text in UTF-8), media.

    The payload is the text (null: empty) and zeros up to a positive multiple
    of 64 bytes; a byte is the grey value of one block of the image, 64 blocks
    a row. Payloads of over 64 * 8191 bytes are several images.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _read(media: list[bytes]):
    """(thumbnails, what is wrong) of each; if one is no baseline JPEG, each is read by itself."""
    try:
        return [(t, None) for t in thumbnails(media)]
    except (ValueError, IndexError, KeyError, struct.error):
        out = []
        for m in media:
            try:
                out.append((thumbnails([m])[0], None))
            except (ValueError, IndexError, KeyError, struct.error) as e:
                out.append((None, str(e) or type(e).__name__))
        return out


def _steps(media: list) -> list[tuple[int, int]]:
    """Runs of values of about a megabyte."""
    out, lo, size = [], 0, 0
    for i, m in enumerate(media):
        if i > lo and size + len(m or b"") > 1 << 20:
            out.append((lo, i))
            lo, size = i, 0
        size += len(m or b"")
    return [*out, (lo, len(media))] if len(media) > lo else out


def _features(batches):
    for b in batches:
        media = b.column(2).to_pylist()
        for lo, hi in _steps(media):
            part = media[lo:hi]
            read = _read([m or b"" for m in part])
            payload = [None if ts is None else b"".join(t.tobytes() for t in ts) for ts, _ in read]
            feature = [None if ts is None else ";".join(f"{t.shape[1] * 8}x{t.shape[0] * 8}:{thumbnail_hash(t)}" for t in ts) for ts, _ in read]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0)[lo:hi],
                    "n_bytes": b.column(1)[lo:hi],
                    "payload_bytes": pa.array([None if p is None else len(p) for p in payload], pa.int64()),
                    "payload_sha256": pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in payload], pa.string()),
                    "tail_crc32": pa.array([None if p is None else zlib.crc32(p[-64:]) for p in payload], pa.int64()),
                    "media_bytes": pa.array([len(m or b"") for m in part], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(m or b"").hexdigest() for m in part]),
                    "feature": pa.array(feature, pa.string()),
                    "error": pa.array([e for _, e in read], pa.string()),
                }
            )


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> what reading the stored bytes back gives:
    payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes),
    media_bytes, media_sha256, feature (size and thumbnail hash of each image),
    error. A null or empty media value has no image and an empty payload. A
    value that is no baseline JPEG has null features and says why in error,
    which is null otherwise; the other rows don't suffer. Repeated rows come
    back repeated, null ids too."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, schema)
