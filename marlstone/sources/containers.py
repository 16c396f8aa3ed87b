"""Image files from their bytes: size and frames, PNG pixels, EXIF tags, and what containers hold besides an image.

No image library is needed: headers, chunks and tags are read as their formats say, PNG through zlib.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PNG = b"\x89PNG\r\n\x1a\n"
# Fixed values of the formats: channels of PNG colour types, EXIF tags by number, bytes of EXIF types, signatures of payloads.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
TAGS = {0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x920A: "FocalLength", 0xA434: "LensModel"}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude"}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
PAYLOADS = ((b"PK\x03\x04", "zip"), (b"%PDF-", "pdf"), (b"Rar!\x1a\x07", "rar"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"MZ", "executable"), (b"\x7fELF", "executable"), (b"\x1f\x8b\x08", "gzip"), (PNG, "png"), (b"\xff\xd8\xff", "jpeg"))


def png_chunks(data: bytes):
    """(name, start, end) of the chunks of a PNG, data only, as far as they are whole."""
    at = len(PNG)
    while data.startswith(PNG) and at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            return
        yield data[at + 4 : at + 8].decode("latin-1"), at + 8, at + 8 + size
        at += 12 + size


def png_pixels(data: bytes) -> tuple[int, bytes] | None:
    """Width and RGBA bytes of a PNG of 8 bits a channel without interlacing; None for others."""
    header, palette, clear, body = None, b"", b"", []
    for name, a, e in png_chunks(data):
        if name == "IHDR":
            header = struct.unpack(">IIBBBBB", data[a:e])
        elif name == "PLTE":
            palette = data[a:e]
        elif name == "tRNS":
            clear = data[a:e]
        elif name == "IDAT":
            body.append(data[a:e])
    if header is None or header[2] != 8 or header[6] or header[3] not in CHANNELS or not header[0] or not header[1]:
        return None
    width, height, _, kind = header[:4]
    n = CHANNELS[kind]
    inflate, want = zlib.decompressobj(), (width * n + 1) * height
    try:
        raw = inflate.decompress(b"".join(body), want)
    except zlib.error:
        return None
    if len(raw) < want:
        return None
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * n + 1)
    out, before = np.zeros((height, width * n), np.uint8), np.zeros(width * n, np.int32)
    for y in range(height):
        line = lines[y, 1:].astype(np.int32)
        how = lines[y, 0]
        if how == 0:
            now = line
        elif how == 1:
            now = np.cumsum(line.reshape(-1, n), axis=0).reshape(-1)
        elif how == 2:
            now = line + before
        else:
            now = line.copy()
            for x in range(width * n):
                left = int(now[x - n]) if x >= n else 0
                up, corner = int(before[x]), int(before[x - n]) if x >= n else 0
                if how == 3:
                    add = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    add = left if a <= b and a <= c else up if b <= c else corner
                now[x] = (int(now[x]) + add) & 255
        before = now & 255
        out[y] = before
    px = out.reshape(-1, n)
    rgba = np.full((len(px), 4), 255, np.uint8)
    if kind == 3:
        table = np.zeros((256, 4), np.uint8)
        colours = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
        table[: len(colours), :3], table[:, 3] = colours, 255
        table[: len(clear), 3] = np.frombuffer(clear[:256], np.uint8)
        rgba = table[px[:, 0]]
    else:
        rgba[:, :3] = px[:, :3] if n >= 3 else px[:, :1]
        if n in (2, 4):
            rgba[:, 3] = px[:, -1]
    return width, rgba.tobytes()


def image_size(data: bytes) -> tuple[str, int, int, int]:
    """Format, width, height and frames from an image's headers; zeros where they are not found."""
    if data.startswith(PNG) and len(data) >= 24:
        frames = next((int.from_bytes(data[a : a + 4], "big") for name, a, _ in png_chunks(data) if name == "acTL"), 1)
        return "PNG", *struct.unpack(">II", data[16:24]), frames
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "GIF", *struct.unpack("<HH", data[6:10]), max(1, data.count(b"\x00\x21\xf9\x04"))
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "BMP", abs(w), abs(h), 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "JPEG", w, h, 1
            at += 2 + max(size, 2)
        return "JPEG", 0, 0, 1
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return "WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), max(1, data.count(b"ANMF"))
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 1
        w, h = struct.unpack("<HH", data[26:30])
        return "WEBP", w & 0x3FFF, h & 0x3FFF, 1
    return "Unknown", 0, 0, 0


def exif_tags(data: bytes) -> dict[str, str]:
    """Named EXIF tags of a JPEG, PNG or TIFF as texts; broken directories give what is sound."""
    body = b""
    if data[:2] == b"\xff\xd8":
        at = data.find(b"Exif\x00\x00")
        body = data[at + 6 :] if at >= 0 else b""
    elif data.startswith(PNG):
        body = next((data[a:e] for name, a, e in png_chunks(data) if name == "eXIf"), b"")
    elif data[:4] in (b"II*\x00", b"MM\x00*"):
        body = data
    if body[:2] not in (b"II", b"MM"):
        return {}
    order = "<" if body[:2] == b"II" else ">"
    out: dict[str, str] = {}

    def value(kind: int, count: int, at: int) -> str | None:
        raw = body[at : at + TYPE_BYTES[kind] * count]
        if len(raw) < TYPE_BYTES[kind] * count:
            return None
        if kind in (2, 7):
            return raw.split(b"\x00")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
            return ", ".join(f"{a}/{b}" for a, b in zip(pairs[::2], pairs[1::2]))
        return ", ".join(str(x) for x in struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind]}", raw))

    todo, seen = [(int.from_bytes(body[4:8], "little" if order == "<" else "big"), TAGS)], set()
    while todo:
        at, names = todo.pop()
        if at in seen or at + 2 > len(body):
            continue
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", body, at)
        for k in range(n):
            entry = at + 2 + 12 * k
            if entry + 12 > len(body):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", body, entry)
            if kind not in TYPE_BYTES or count > 1 << 16:
                continue
            place = entry + 8
            if TYPE_BYTES[kind] * count > 4:
                (place,) = struct.unpack_from(order + "I", body, entry + 8)
            if tag in (0x8769, 0x8825):
                todo.append((struct.unpack_from(order + "I", body, entry + 8)[0], GPS_TAGS if tag == 0x8825 else TAGS))
            elif tag in names and (found := value(kind, count, place)) is not None:
                out[names[tag]] = found
    return out


def payload_kind(raw: bytes) -> str:
    return next((kind for mark, kind in PAYLOADS if raw.startswith(mark)), "text" if raw[:64].isascii() and raw[:64].decode("ascii").isprintable() else "data")


def findings(data: bytes) -> list[tuple[str, int, int, str]]:
    """(finding, offset, length, kind): metadata chunks, bytes after the end of an image, other files inside, and broken structure."""
    out = []
    if data.startswith(PNG):
        end = 0
        for name, a, e in png_chunks(data):
            if name in ("tEXt", "zTXt", "iTXt"):
                out.append(("metadata chunk", a, e - a, name))
            if name == "IEND":
                end = e + 4
                break
        if not end:
            out.append(("no end marker", 0, 0, ""))
        elif end < len(data):
            out.append(("trailing bytes", end, len(data) - end, payload_kind(data[end:])))
    elif data[:2] == b"\xff\xd8":
        end = data.rfind(b"\xff\xd9")
        if end >= 0 and end + 2 < len(data):
            out.append(("trailing bytes", end + 2, len(data) - end - 2, payload_kind(data[end + 2 :])))
    for mark, kind in PAYLOADS:
        at = data.find(mark, 16) if len(mark) > 2 else -1
        if at >= 0:
            out.append(("inline payload", at, len(data) - at, kind))
    return out


def describe(files: DataFrame) -> DataFrame:
    """path, format, width, height, frames, exif (map) and findings of ``files(path, content)``; null content is no image."""
    kind = pa.list_(pa.struct([("finding", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            rows = [(x or b"") for x in batch.column(1).to_pylist()]
            sizes = [image_size(x) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([s[0] for s in sizes]), *(pa.array([s[k] for s in sizes], pa.int32()) for k in (1, 2, 3)),
                    pa.array([list(exif_tags(x).items()) for x in rows], pa.map_(pa.string(), pa.string())),
                    pa.array([[dict(zip(("finding", "offset", "length", "kind"), f)) for f in findings(x)] for x in rows], kind),
                ],
                names=["path", "format", "width", "height", "frames", "exif", "findings"],
            )

    return files.select("path", "content").mapInArrow(run, "path string, format string, width int, height int, frames int, exif map<string,string>, findings array<struct<finding:string,offset:bigint,length:bigint,kind:string>>")


def carve(files: DataFrame) -> DataFrame:
    """(path, offset, kind, content): what stands after the end of each image."""

    def run(batches):
        for batch in batches:
            rows = [(p, at, kind, data[at : at + n]) for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for what, at, n, kind in findings(data or b"") if what == "trailing bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.binary())], names=["path", "offset", "kind", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, offset long, kind string, content binary")
