import hashlib
import re
import struct
import zlib

from cartoflux.llm.media import examine, media_columns, read_wav, sniff, store_wav


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def test_sniffing_confirms_and_carves():
    wav = store_wav(b"ab" * 32)
    assert sniff(wav) == [("wav", 0, len(wav))]
    mixed = b"junk" + png() + b"BM RIFF GIF89a" + GIF + wav
    assert [(k, mixed[at : at + n]) for k, at, n in sniff(mixed)] == [("png", png()), ("gif", GIF), ("wav", wav)]
    assert sniff(png()[:-3]) == [] and sniff(wav[:-1]) == [] and sniff(b"") == []
    held = store_wav(png() + bytes(-len(png()) % 64))
    assert [x[0] for x in sniff(held)] == ["wav", "png"] and read_wav(held).startswith(png())


def test_rows(spark):
    texts = [(1, "héllo"), (1, "héllo"), (2, None), (3, ""), (None, "BM" * 5000), (5, "x" * 64)]
    found = media_columns(spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, feature string")).collect()
    assert len(found) == len(texts)
    for row in found:
        text = next(t for i, t in texts if i == row.doc_id) or ""
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert row.n_bytes == len(raw) and row.payload_bytes == len(payload) == row.media_bytes - 44
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-64:])
        assert row.media_sha256 == hashlib.sha256(store_wav(payload)).hexdigest() and row.feature.startswith("wav;")
    assert media_columns(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def crc(data, width, poly):
    c = 0
    for x in data:
        c ^= x << (width - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly | 1 << width) if c >> (width - 1) else c << 1
    return c


def flac(samples=(3, -1, 4, 1, -5, 9, 2, 6)):
    """Mono of 16 bits in three frames: one value, the samples as they are, their differences in Rice code."""
    n = len(samples)
    raw = lambda v: f"{v & 65535:016b}"
    step = [b - a for a, b in zip(samples, samples[1:], strict=False)]
    fold = [2 * v if v >= 0 else -2 * v - 1 for v in step]
    bodies = ["00000000" + raw(7), "00000010" + "".join(map(raw, samples)), "00010010" + raw(samples[0]) + "00" + "0000" + "0010" + "".join("0" * (v >> 2) + "1" + f"{v & 3:02b}" for v in fold)]
    out = b"fLaC" + b"\x80\0\0\x22" + struct.pack(">HH", n, n) + bytes(6) + (44100 << 44 | 15 << 36 | 3 * n).to_bytes(8) + bytes(16)
    for number, body in enumerate(bodies):
        head = b"\xff\xf8\x69\x08" + bytes([number, n - 1])
        frame = head + bytes([crc(head, 8, 0x07)]) + int(body + "0" * (-len(body) % 8), 2).to_bytes((len(body) + 7) // 8)
        out += frame + crc(frame, 16, 0x8005).to_bytes(2)
    return out


def ogg():
    def page(flags, number, data):
        head = struct.pack("<4sBBqII", b"OggS", 0, flags, 0, 77, number)
        rest = bytes([1, len(data)]) + data
        return head + struct.pack("<I", crc(head + bytes(4) + rest, 32, 0x04C11DB7)) + rest

    return page(2, 0, b"head") + page(0, 1, b"body") + page(4, 2, b"end")


def pdf():
    body = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\n"
    once = body + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<< /Size 1 >>\nstartxref\n%d\n%%%%EOF\n" % len(body)
    return once + b"xref\n0 0\ntrailer\n<< >>\nstartxref\n%d\n%%%%EOF\n" % len(once)


def test_flac_ogg_and_pdf_are_found():
    files = [("flac", flac()), ("ogg", ogg()), ("pdf", pdf())]
    mixed = b"junk fLaC OggS %PDF-1.4 " + b" and ".join(f for _, f in files) + b" %%EOF"
    assert [(k, mixed[at : at + n]) for k, at, n in sniff(mixed)] == files
    for kind, whole in files:
        spoilt = bytearray(whole)
        spoilt[-3] ^= 64
        assert sniff(whole) == [(kind, 0, len(whole))] and (kind == "pdf" or sniff(bytes(spoilt)) == sniff(whole[:-1]) == [])
    assert sniff(pdf().replace(b"xref\n0", b"none\n0")) == []


def test_declared_types_are_corrected_and_files_carved(spark):
    wav = store_wav(pdf() + bytes(-len(pdf()) % 64))
    rows = [(1, "image/png", wav), (2, "audio/x-wav", wav), (3, ".JPG", b"no media"), (4, None, flac()), (5, "FLAC", flac() + GIF), (6, None, None), (None, "ogg", ogg())]
    found = {r.id: r for r in examine(spark.createDataFrame(rows, "id long, declared_type string, media binary")).collect()}
    assert {i: (r.true_type, r.mismatch) for i, r in found.items()} == {
        1: ("wav", True), 2: ("wav", False), 3: ("unknown", True), 4: ("flac", True), 5: ("flac", False), 6: ("unknown", False), None: ("ogg", False),
    }
    carved = {i: [(p.format, p.start, bytes(p.bytes)) for p in r.parts] for i, r in found.items() if r.parts}
    assert carved == {1: [("pdf", 44, pdf())], 2: [("pdf", 44, pdf())], 5: [("flac", 0, flac()), ("gif", len(flac()), GIF)]}


def test_features_are_told_whole(spark):
    """The feature of each text: the stored form, its samples, and every file that the text itself holds."""
    inside = "see " + pdf().decode("latin-1") + " and more"
    texts = [None, "", "plain", "x" * 64, inside]
    found = {r.doc_id: r for r in media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        payload = (text or "").encode()
        payload += bytes(-len(payload) % 64 if payload else 64)
        places = [m.start() for m in re.finditer(b"%PDF-1", payload)]
        carved = "".join(f";pdf@{44 + at}+{len(pdf())}" for at in places)
        assert found[i].feature == f"wav;samples={len(payload)};embedded={len(places)}{carved}"
        assert found[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_the_same_names_are_replaced(spark):
    rows = spark.createDataFrame([(1, "flac", flac(), "mine", "his", "hers")], "id long, declared_type string, media binary, parts string, true_type string, mismatch string")
    made = examine(rows)
    assert made.columns == ["id", "declared_type", "media", "true_type", "mismatch", "parts"]
    assert tuple(made.select("true_type", "mismatch").first()) == ("flac", False)
