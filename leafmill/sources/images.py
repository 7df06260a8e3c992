"""Container files as tables: kinds, headers, chunks and metadata.

Input is what ``spark.read.format("binaryFile")`` gives (path, content).  Kinds
and limits are Column expressions; headers and chunks are read by small Arrow
functions over the bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import constants as C

PNG = b"\x89PNG\r\n\x1a\n"
#: PNG chunks and JPEG markers that hold metadata only.
PNG_TEXT = ("tEXt", "zTXt", "iTXt", "tIME")
PNG_COLOUR = ("iCCP", "sRGB", "gAMA", "cHRM", "cICP", "mDCV", "cLLI")
#: Colour profiles: the longest, their mark in JPEG segments, and how much of one a segment takes.
PROFILE_BYTES, ICC, SEGMENT = 4 * C.MIB, b"ICC_PROFILE\0", 65_519


def source_type(content: Column) -> Column:
    """jpg, png, webp or pdf by signature, in that order; else null. Names and MIME types don't matter."""
    head = F.hex(F.substring(content, 1, 12))
    start = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return (
        F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith(PNG.hex().upper()), "png")
        .when(head.startswith(b"RIFF".hex().upper()) & (F.substring(head, 17, 8) == b"WEBP".hex().upper()), "webp").when(F.instr(start, "%PDF-") > 0, "pdf")
    )


def batch_error(files: DataFrame, by: list[str], allow_webp: bool = True) -> DataFrame:
    """For each batch (kind, length): pdf or images, or the rule it breaks."""
    pdf = F.col("kind") == "pdf"
    held = files.groupBy(*by).agg(
        F.count("*").alias("n"), F.bool_or(F.col("kind").isNull() | ((F.col("kind") == "webp") & F.lit(not allow_webp))).alias("unknown"), F.bool_or(pdf).alias("any_pdf"), F.bool_and(F.coalesce(pdf, F.lit(False))).alias("all_pdf"),
        F.min("length").alias("least"), F.max("length").alias("most"),
    )
    error = (
        F.when(F.col("n") > C.IMAGE_FILES, "too many files").when(F.col("least") <= 0, "empty").when(F.col("most") > C.FILE_BYTES, "too large").when(F.col("unknown"), "unsupported")
        .when(F.col("any_pdf") & ~F.col("all_pdf"), "mixed").when(F.col("all_pdf") & (F.col("n") > 1), "one pdf only")
    )
    return held.select(*by, error.alias("error"), F.when(error.isNull(), F.when(F.col("all_pdf"), "pdf").otherwise("images")).alias("kind"))


def png_chunks(content: bytes) -> list[tuple[str, int, int, bool]]:
    """(type, start, end, checksum holds) up to IEND; a stream without one ends with an error."""
    if not content.startswith(PNG):
        raise ValueError("not a png")
    at, out = len(PNG), []
    while at + 12 <= len(content):
        (size,) = struct.unpack_from(">I", content, at)
        end = at + 12 + size
        if end > len(content):
            raise ValueError("chunk beyond the end")
        kind = content[at + 4 : at + 8].decode("latin-1")
        out.append((kind, at, end, zlib.crc32(content[at + 4 : end - 4]) == struct.unpack_from(">I", content, end - 4)[0]))
        if kind == "IEND":
            return out
        at = end
    raise ValueError("no IEND")


def jpeg_segments(content: bytes) -> list[tuple[str, int, int, bool]]:
    """(marker in hex, start, end, True) up to the scan; fill bytes and standalone markers are passed over."""
    if content[:2] != b"\xff\xd8":
        raise ValueError("not a jpeg")
    at, out = 2, []
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise ValueError("no marker")
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
        elif 0xD0 <= marker <= 0xD8 or marker == 1:
            at += 2
        elif marker in (0xD9, 0xDA):
            return out
        else:
            end = at + 2 + struct.unpack_from(">H", content, at + 2)[0]
            if end > len(content) or end < at + 4:
                raise ValueError("segment beyond the end")
            out.append((f"{marker:02X}", at, end, True))
            at = end
    raise ValueError("no scan")


def webp_chunks(content: bytes) -> list[tuple[str, int, int, bool]]:
    """(type, start, end, True) of a RIFF container whose sizes agree."""
    if content[:4] != b"RIFF" or content[8:12] != b"WEBP" or struct.unpack_from("<I", content, 4)[0] + 8 != len(content):
        raise ValueError("not a webp")
    at, out = 12, []
    while at < len(content):
        if at + 8 > len(content):
            raise ValueError("chunk beyond the end")
        end = at + 8 + struct.unpack_from("<I", content, at + 4)[0]
        if end > len(content):
            raise ValueError("chunk beyond the end")
        out.append((content[at : at + 4].decode("latin-1"), at, end, True))
        at = end + (end & 1)
    return out


def _chunks(content: bytes) -> list[tuple[str, int, int, bool]]:
    return png_chunks(content) if content.startswith(PNG) else jpeg_segments(content) if content[:2] == b"\xff\xd8" else webp_chunks(content)


def exif_orientation(exif: bytes) -> int:
    """Tag 0x0112 of a TIFF block; 1 where anything is off."""
    try:
        order = {b"II": "<", b"MM": ">"}[exif[:2]]
        magic, first = struct.unpack_from(f"{order}HI", exif, 2)
        if magic != 42:
            return 1
        (n,) = struct.unpack_from(f"{order}H", exif, first)
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", exif, first + 2 + 12 * i)
            if tag == 0x0112 and kind == 3 and count == 1:
                (value,) = struct.unpack_from(f"{order}H", exif, first + 10 + 12 * i)
                return value if 1 <= value <= 8 else 1
    except (KeyError, struct.error):
        pass
    return 1


def header(content: bytes) -> tuple[str, int, int, int]:
    """(format, width, height, orientation); animated images and oversize ones are errors."""
    chunks, orientation = _chunks(content), 1
    if content.startswith(PNG):
        if any(k == "acTL" for k, *_ in chunks):
            raise ValueError("animated")
        kind, (width, height) = "png", struct.unpack_from(">II", content, chunks[0][1] + 8)
        for k, a, z, _ in chunks:
            orientation = exif_orientation(content[a + 8 : z - 4]) if k == "eXIf" else orientation
    elif content[:2] == b"\xff\xd8":
        kind, width, height = "jpg", 0, 0
        for k, a, z, _ in chunks:
            marker = int(k, 16)
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", content, a + 5)
            elif k == "E1" and content[a + 4 : a + 10] == b"Exif\0\0":
                orientation = exif_orientation(content[a + 10 : z])
    else:
        kind, width, height = "webp", 0, 0
        for k, a, z, _ in chunks:
            body = content[a + 8 : z]
            if k == "VP8X":
                if body[0] & 2:
                    raise ValueError("animated")
                width, height = int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
            elif k == "VP8 " and not width:
                width, height = (x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
            elif k == "VP8L" and not width:
                bits = int.from_bytes(body[1:5], "little")
                width, height = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            elif k == "EXIF":
                orientation = exif_orientation(body.removeprefix(b"Exif\0\0"))
    if width < 1 or height < 1 or max(width, height) > C.HEADER_EDGE or width * height > C.HEADER_PIXELS:
        raise ValueError("size")
    return kind, width, height, orientation


def stripped(content: bytes) -> bytes:
    """Without text, time, comment and Photoshop metadata; pixels, colour and orientation stay."""
    if content.startswith(PNG):
        return PNG + b"".join(content[a:z] for k, a, z, _ in png_chunks(content) if k not in PNG_TEXT)
    segments = jpeg_segments(content)
    drop = [(a, z) for k, a, z, _ in segments if k in ("FE", "ED") or (k == "E1" and content[a + 4 : a + 10] != b"Exif\0\0")]
    out, at = [], 0
    for a, z in drop:
        out.append(content[at:a])
        at = z
    return b"".join([*out, content[at:]])


def _webp(parts: list[tuple[bytes, bytes]]) -> bytes:
    """A RIFF container of (type, data) chunks, each padded to an even length."""
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) & 1) for k, d in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def upright(content: bytes) -> bytes:
    """Without what tells viewers to turn the image: Exif blocks, and the Exif flag of a WEBP; all else stays."""
    if content.startswith(PNG):
        return PNG + b"".join(content[a:z] for k, a, z, _ in png_chunks(content) if k != "eXIf")
    if content[:2] == b"\xff\xd8":
        kept, at = [], 0
        for k, a, z, _ in jpeg_segments(content):
            if k == "E1" and content[a + 4 : a + 10] == b"Exif\0\0":
                kept.append(content[at:a])
                at = z
        return b"".join([*kept, content[at:]])
    parts = [(content[a : a + 4], content[a + 8 : z]) for k, a, z, _ in webp_chunks(content) if k != "EXIF"]
    return _webp([(k, bytes([d[0] & ~8]) + d[1:] if k == b"VP8X" and d else d) for k, d in parts])


def checked_profile(profile: bytes) -> bytes:
    """An ICC profile whose size and signature hold, else an error."""
    if not 128 <= len(profile) <= PROFILE_BYTES or struct.unpack_from(">I", profile)[0] != len(profile) or profile[36:40] != b"acsp":
        raise ValueError("profile")
    return profile


def profile_of(content: bytes) -> bytes | None:
    """The ICC profile of a PNG, JPEG or WEBP file, or None; one that is cut, out of order or too long is an error."""
    if content.startswith(PNG):
        data = next((content[a + 8 : z - 4] for k, a, z, _ in png_chunks(content) if k == "iCCP"), None)
        if data is None:
            return None
        name = data.find(b"\0")
        if not 1 <= name <= 79 or data[name + 1 : name + 2] != b"\0":
            raise ValueError("profile")
        reader = zlib.decompressobj()
        try:
            return checked_profile(reader.decompress(data[name + 2 :], PROFILE_BYTES + 1))
        except zlib.error as e:
            raise ValueError("profile") from e
    if content[:2] == b"\xff\xd8":
        parts = sorted((content[a + 16 : a + 18], content[a + 18 : z]) for k, a, z, _ in jpeg_segments(content) if k == "E2" and content[a + 4 : a + 16] == ICC)
        if not parts:
            return None
        if any(mark != bytes([i, len(parts) & 0xFF]) for i, (mark, _) in enumerate(parts, 1)):
            raise ValueError("profile")
        return checked_profile(b"".join(d for _, d in parts))
    data = next((content[a + 8 : z] for k, a, z, _ in webp_chunks(content) if k == "ICCP"), None)
    if data is not None and checked_profile(data)[16:20] != b"RGB ":
        raise ValueError("profile")
    return data


def with_profile(content: bytes, profile: bytes | None) -> bytes:
    """A PNG or JPEG file with that profile in place of its own; None leaves it as it is."""
    if profile is None:
        return content
    if content.startswith(PNG):
        made = b"iCCPICC\0\0" + zlib.compress(profile)
        made = struct.pack(">I", len(made) - 4) + made + struct.pack(">I", zlib.crc32(made))
        chunks = [(k, content[a:z]) for k, a, z, _ in png_chunks(content) if k not in ("iCCP", "sRGB")]
        return PNG + chunks[0][1] + made + b"".join(c for _, c in chunks[1:])
    count = -(-len(profile) // SEGMENT)
    made = []
    for i in range(count):
        part = ICC + bytes([i + 1, count]) + profile[i * SEGMENT : (i + 1) * SEGMENT]
        made.append(b"\xff\xe2" + struct.pack(">H", len(part) + 2) + part)
    kept, at = [content[:2], *made], 2
    for k, a, z, _ in jpeg_segments(content):
        if k == "E2" and content[a + 4 : a + 16] == ICC:
            kept.append(content[at:a])
            at = z
    return b"".join([*kept, content[at:]])


def profiles(files: DataFrame) -> DataFrame:
    """path, space, length, error of the colour profiles of image files; files without one have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content").to_pylist():
                try:
                    found = profile_of(content or b"")
                    rows.append((None, None, None) if found is None else (found[16:20].decode("latin-1"), len(found), None))
                except (ValueError, struct.error) as e:
                    rows.append((None, None, str(e)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(pa.string()), *columns], ["path", "space", "length", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, space string, length bigint, error string")


def colour_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks (as ``chunked`` gives them) that say how colours of a PNG are meant."""
    return chunks.where(F.col("type").isin(*PNG_COLOUR))


def inspected(files: DataFrame) -> DataFrame:
    """path, format, width, height, orientation, error of image files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content").to_pylist():
                try:
                    rows.append((*header(content or b""), None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((None, None, None, None, str(e)))
            kinds, widths, heights, orientations, errors = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(pa.string()), pa.array(kinds, pa.string()), pa.array(widths, pa.int32()), pa.array(heights, pa.int32()), pa.array(orientations, pa.int32()), pa.array(errors, pa.string())], ["path", "format", "width", "height", "orientation", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, format string, width int, height int, orientation int, error string")


def chunked(files: DataFrame) -> DataFrame:
    """path, pos, type, start, end, checked: the chunks of PNG, JPEG and WEBP files; files that can't be read give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [(path, i, *c) for i, c in enumerate(_chunks(content or b""))]
                except (ValueError, struct.error):
                    continue
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "pos", "type", "start", "end", "checked"])

    return files.select("path", "content").mapInArrow(run, "path string, pos int, type string, start bigint, end bigint, checked boolean")


def png(width: int, height: int, rows: bytes, text: bytes = b"") -> bytes:
    """An 8-bit grey PNG of raw rows; each row is stored with the filter of the least absolute sum, first of equals."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    out, above = b"", bytes(width)
    for y in range(height):
        row = rows[y * width : (y + 1) * width]
        left = b"\0" + row[:-1]
        corner = b"\0" + above[:-1]
        options = (
            row, bytes((a - b) & 255 for a, b in zip(row, left, strict=True)), bytes((a - b) & 255 for a, b in zip(row, above, strict=True)),
            bytes((a - (b + c) // 2) & 255 for a, b, c in zip(row, left, above, strict=True)), bytes((a - paeth(b, c, d)) & 255 for a, b, c, d in zip(row, left, above, corner, strict=True)),
        )
        best = min(range(5), key=lambda i: sum(min(v, 256 - v) for v in options[i]))
        out, above = out + bytes([best]) + options[best], row
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + (chunk(b"tEXt", text) if text else b"") + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def paeth(left: int, above: int, corner: int) -> int:
    guess = left + above - corner
    a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
    return left if a <= b and a <= c else above if b <= c else corner
