"""Media columns: documents stored as media, sniffed by signature.

``store`` keeps a text's bytes as the samples of an 8-bit mono WAV file. ``sniff`` finds every magic byte
string of a file in one Aho-Corasick pass and lets each format's validator confirm structure and length.
``examine`` takes (declared_type, media), gives the true type whatever was declared, says whether the two
differ, and carves the files embedded in the media with their bytes; op8 goes through it.

Edge cases: a null text is an empty one; very long texts are stored and examined whole; an empty table gives no rows; an empty payload is padded to one block of 64 zero bytes; repeated
rows are stored alike; columns other than doc_id and text are ignored; bytes that look like a signature
but fail validation are no media; null media are of unknown type, as is a declared type that is null; an Ogg
stream needs its end page, a FLAC file all the samples that it announces.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoflux.llm.common import documents

BLOCK, RATE = 64, 8000

#: Magic bytes, the format they announce and where they stand in its files.
SIGNATURES = [
    (b"RIFF", "wav", 0),
    (b"\x89PNG\r\n\x1a\n", "png", 0),
    (b"GIF87a", "gif", 0),
    (b"GIF89a", "gif", 0),
    (b"BM", "bmp", 0),
    (b"\xff\xd8\xff", "jpeg", 0),
    (b"fLaC", "flac", 0),
    (b"OggS", "ogg", 0),
    (b"%PDF-", "pdf", 0),
    (b"PK\x03\x04", "zip", 0),
    (b".snd", "au", 0),
]


def store_wav(payload: bytes) -> bytes:
    """The payload as samples of a mono 8-bit PCM file; a payload's length is even here, so no pad byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def _wav(b: bytes, at: int) -> int:
    if len(b) - at < 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    size = 8 + struct.unpack_from("<I", b, at + 4)[0]
    if at + size > len(b):
        return 0
    place, seen = at + 12, set()
    while place + 8 <= at + size:
        kind, n = struct.unpack_from("<4sI", b, place)
        if place + 8 + n > at + size:
            return 0
        seen.add(kind)
        place += 8 + n + n % 2
    return size if {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int) -> int:
    place, first = at + 8, True
    while place + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, place)
        if place + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13):
            return 0
        if zlib.crc32(b[place + 4 : place + 8 + n]) != struct.unpack_from(">I", b, place + 8 + n)[0]:
            return 0
        place, first = place + 12 + n, False
        if kind == b"IEND":
            return place - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) - at < 13:
        return 0
    flags = b[at + 10]
    place = at + 13 + (3 * 2 ** ((flags & 7) + 1) if flags & 128 else 0)
    while place < len(b):
        kind = b[place]
        if kind == 0x3B:
            return place + 1 - at
        if kind == 0x2C and place + 10 < len(b):
            flags = b[place + 9]
            place += 11 + (3 * 2 ** ((flags & 7) + 1) if flags & 128 else 0)
        elif kind == 0x21:
            place += 2
        else:
            return 0
        while place < len(b) and b[place]:
            place += 1 + b[place]
        place += 1
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) - at < 30:
        return 0
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    return size if zero == 0 and 26 <= start <= size and head in (40, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and at + size <= len(b) else 0


def _jpeg(b: bytes, at: int) -> int:
    place = at + 2
    while place + 4 <= len(b) and b[place] == 0xFF:
        kind, n = b[place + 1], struct.unpack_from(">H", b, place + 2)[0]
        if n < 2 or place + 2 + n > len(b):
            return 0
        place += 2 + n
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", place)
            return end + 2 - at if end >= 0 else 0
    return 0


def _au(b: bytes, at: int) -> int:
    if len(b) - at < 24:
        return 0
    head, n, coding, _, channels = struct.unpack_from(">5I", b, at + 4)
    return head + n if head >= 24 and 1 <= coding <= 27 and 1 <= channels <= 64 and n != 0xFFFFFFFF and at + head + n <= len(b) else 0


def _zip(b: bytes, at: int) -> int:
    end = b.find(b"PK\x05\x06", at) - at
    if end < 0 or at + end + 22 > len(b):
        return 0
    size, offset, note = struct.unpack_from("<IIH", b, at + end + 12)
    return end + 22 + note if size + offset == end and at + end + 22 + note <= len(b) else 0


def _crc_table(bits: int, poly: int) -> list[int]:
    table = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) else 0)) & ((1 << bits) - 1)
        table.append(c)
    return table


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc8(b: bytes) -> int:
    c = 0
    for x in b:
        c = _CRC8[c ^ x]
    return c


def _crc16(b: bytes) -> int:
    c = 0
    for x in b:
        c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ x]
    return c


class _Bits:
    """Reads numbers of some bits, most significant first; past the end is an IndexError."""

    def __init__(self, b: bytes, at: int):
        self.b, self.at = b, 8 * at

    def take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.b):
            raise IndexError
        value = int.from_bytes(self.b[self.at >> 3 : (end + 7) >> 3]) >> (-end % 8) & ((1 << n) - 1)
        self.at = end
        return value

    def zeros(self) -> int:
        """Zero bits before the next one bit, which is taken too."""
        n = 0
        while True:
            width = min(32, 8 * len(self.b) - self.at)
            value = self.take(width) if width else self.take(1)
            if value:
                self.at -= value.bit_length() - 1
                return n + width - value.bit_length()
            n += width


def _flac_residual(bits: _Bits, order: int, block: int) -> bool:
    method = bits.take(2)
    parts = bits.take(4)
    if method > 1 or block % (1 << parts) or block >> parts < order:
        return False
    width = 4 + method
    for i in range(1 << parts):
        count, rice = (block >> parts) - (0 if i else order), bits.take(width)
        if rice == (1 << width) - 1:
            bits.take(bits.take(5) * count)
            continue
        for _ in range(count):
            bits.zeros()
            bits.take(rice)
    return True


def _flac_subframe(bits: _Bits, depth: int, block: int) -> bool:
    if bits.take(1):
        return False
    kind = bits.take(6)
    if bits.take(1):
        depth -= 1 + bits.zeros()
    if depth < 1:
        return False
    if kind < 2:
        bits.take(depth * (block if kind else 1))
        return True
    order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else None
    if order is None or order > block:
        return False
    bits.take(depth * order)
    if kind >= 32:
        precision = bits.take(4) + 1
        bits.take(5 + precision * order)
        if precision == 16:
            return False
    return _flac_residual(bits, order, block)


def _flac_frame(b: bytes, at: int, depth: int, channels: int) -> tuple[int, int]:
    """(end, samples) of the frame at a place, or (0, 0)."""
    bits = _Bits(b, at)
    if bits.take(15) != 0x7FFC:
        return 0, 0
    bits.take(1)
    size, rate, layout, code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    lead, more = bits.take(2), 0  # a reserved zero and the coded number's first bit
    if lead & 1:
        while bits.take(1):
            more += 1
        bits.take(6 - more)
        bits.take(8 * more)
    else:
        bits.take(7)
    block = 192 if size == 1 else 576 << (size - 2) if 2 <= size <= 5 else 1 + bits.take(8 * (size - 5)) if size in (6, 7) else 256 << (size - 8) if size >= 8 else 0
    bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    end = bits.at // 8
    if lead & 2 or more > 6 or not block or rate == 15 or layout > 10 or code == 3 or bits.take(8) != _crc8(b[at:end]):
        return 0, 0
    depth = {0: depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[code]
    if (layout + 1 if layout < 8 else 2) != channels:
        return 0, 0
    for c in range(channels):
        side = (layout in (8, 10) and c == 1) or (layout == 9 and c == 0)
        if not _flac_subframe(bits, depth + side, block):
            return 0, 0
    end = (bits.at + 7) // 8 + 2
    return (end, block) if end <= len(b) and _crc16(b[at:end]) == 0 else (0, 0)


def _flac(b: bytes, at: int) -> int:
    place, first, last = at + 4, True, False
    while not last:
        if place + 4 > len(b):
            return 0
        last, kind, n = b[place] >> 7, b[place] & 127, int.from_bytes(b[place + 1 : place + 4])
        if kind == 127 or place + 4 + n > len(b) or first != (kind == 0) or first and n != 34:
            return 0
        if first:
            packed = int.from_bytes(b[place + 14 : place + 22])
            channels, depth, total = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
        place, first = place + 4 + n, False
    seen = 0
    while not total or seen < total:
        try:
            end, samples = _flac_frame(b, place, depth, channels)
        except (IndexError, ValueError):
            end = 0
        if not end:
            break
        place, seen = end, seen + samples
    return place - at if seen and seen >= total else 0


_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _ogg_crc(page: bytes) -> int:
    """Ogg's CRC takes the bits the other way round than zlib's, and neither starts nor ends inverted."""
    turned = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{turned:032b}"[::-1], 2)


def _ogg(b: bytes, at: int) -> int:
    """Pages from a first one on, until every stream that was begun has ended."""
    place, running, seen = at, set(), set()
    while b[place : place + 4] == b"OggS" and place + 27 <= len(b):
        flags, stream, crc, n = b[place + 5], *struct.unpack_from("<I4xIB", b, place + 14)
        end = place + 27 + n + sum(b[place + 27 : place + 27 + n])
        if b[place + 4] or end > len(b) or crc != _ogg_crc(b[place : place + 22] + bytes(4) + b[place + 26 : end]):
            return 0
        if flags & 2 and stream not in seen:
            running.add(stream)
            seen.add(stream)
        elif flags & 2 or stream not in running:
            return 0
        if flags & 4:
            running.discard(stream)
        place = end
        if not running and not (b[place : place + 4] == b"OggS" and len(b) > place + 5 and b[place + 5] & 2 and flags & 2):
            return place - at
    return 0


_PDF_END, _PDF_TABLE = re.compile(rb"startxref\s+(\d{1,15})\s+%%EOF(?:\r\n|\r|\n)?"), re.compile(rb"xref\s|\d+\s+\d+\s+obj\b")


def _pdf(b: bytes, at: int) -> int:
    """Up to the last end mark, as updates add one, whose cross references stand where it says."""
    if not re.compile(rb"%PDF-\d\.\d").match(b, at):
        return 0
    ends = [m.end() for m in _PDF_END.finditer(b, at) if 8 <= int(m[1]) < m.start() - at and _PDF_TABLE.match(b, at + int(m[1]))]
    return ends[-1] - at if ends else 0


#: Each confirms a format at a place and gives its length, or 0.
VALIDATORS = {"wav": _wav, "png": _png, "gif": _gif, "bmp": _bmp, "jpeg": _jpeg, "au": _au, "zip": _zip, "flac": _flac, "ogg": _ogg, "pdf": _pdf}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind, offset in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (kind, len(magic), offset))
    found.make_automaton()
    return found


def sniff(media: bytes) -> list[tuple[str, int, int]]:
    """(format, start, length) of every confirmed file, by start; media inside a carved file's own structure
    are listed too, except that a place is listed once."""
    found = []
    for end, (kind, n, offset) in _automaton().iter(media.decode("latin-1")):
        start = end - n + 1 - offset
        if start >= 0 and (size := VALIDATORS[kind](media, start)):
            found.append((kind, start, size))
    return sorted(set(found), key=lambda x: (x[1], -x[2], x[0]))


def read_wav(media: bytes, start: int = 0) -> bytes:
    """The samples of the file that ``sniff`` confirmed at ``start``."""
    place = start + 12
    while True:
        kind, n = struct.unpack_from("<4sI", media, place)
        if kind == b"data":
            return media[place + 8 : place + 8 + n]
        place += 8 + n + n % 2


#: Names under which the formats are declared, besides their own.
NAMES = {
    "wave": "wav", "x-wav": "wav", "vnd.wave": "wav", "x-png": "png", "x-ms-bmp": "bmp", "x-bmp": "bmp", "dib": "bmp", "jpg": "jpeg", "pjpeg": "jpeg", "jfif": "jpeg",
    "x-flac": "flac", "oga": "ogg", "ogv": "ogg", "opus": "ogg", "x-pdf": "pdf", "x-zip-compressed": "zip", "basic": "au", "snd": "au", "x-au": "au",
}


def named(declared: str | None) -> str:
    """A declared file ending or MIME type as the format's name."""
    name = (declared or "unknown").split(";")[0].strip().lower().rpartition("/")[2].lstrip(".")
    return NAMES.get(name, name)


_PART = T.StructType([T.StructField("format", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("bytes", T.BinaryType())])


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.struct([("format", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())])
    for batch in batches:
        types, differ, parts = [], [], []
        for declared, media in zip(batch.column("declared_type").to_pylist(), batch.column("media"), strict=True):
            media = media.as_py() or b""
            found = sniff(media)
            types.append(next((k for k, at, _ in found if at == 0), "unknown"))
            differ.append(types[-1] != named(declared))
            parts.append([{"format": k, "start": at, "length": n, "bytes": media[at : at + n]} for k, at, n in found if n < len(media)])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(types, pa.string()), pa.array(differ, pa.bool_()), pa.array(parts, pa.list_(part))],
            names=[*batch.schema.names, "true_type", "mismatch", "parts"],
        )


def examine(rows: DataFrame) -> DataFrame:
    """Rows of (declared_type, media, others) with true_type, mismatch and parts: format, start, length and
    bytes of every confirmed file that is not the whole of the media. Columns of these names are replaced."""
    rows = rows.drop("true_type", "mismatch", "parts")
    more = [T.StructField("true_type", T.StringType()), T.StructField("mismatch", T.BooleanType()), T.StructField("parts", T.ArrayType(_PART))]
    return rows.mapInArrow(_examine, T.StructType([*rows.schema.fields, *more]))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(1)]
        media = [store_wav(t + bytes(-len(t) % BLOCK if t else BLOCK)) for t in texts]
        columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(["wav"] * len(texts), pa.string()), pa.array(media, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "declared_type", "media"])


def media_row(media: bytes, true_type: str, parts: list[tuple[str, int, int]]) -> dict:
    """What is told of a stored file, its payload being read back."""
    payload = read_wav(media)
    carved = [f"{k}@{at}+{n}" for k, at, n in parts if at]
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-BLOCK:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{true_type};samples={len(payload)};embedded={len(carved)}" + "".join(f";{c}" for c in carved),
    }


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    for batch in batches:
        parts = [[(p["format"], p["start"], p["length"]) for p in ps] for ps in batch.column("parts").to_pylist()]
        rows = [media_row(m.as_py(), k, ps) for m, k, ps in zip(batch.column("media"), batch.column("true_type").to_pylist(), parts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()]], names=["doc_id", "n_bytes", *kinds]
        )


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and what is told of each text's file: stored, examined and read back in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(_examine(_store(batches)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _SCHEMA)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
