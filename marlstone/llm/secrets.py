"""Secret scans with a recursive decoding worklist (operator 6).

Base spans come from three patterns over the whole text. A worklist then
unwraps layers: percent escapes and Unicode escapes of a whole layer, base64
runs, also over line breaks and at every alignment, and compressed bytes inside
what any of them decodes to. Bytes that are not UTF-8 are read as latin-1, so that no
layer is left out. Each layer is scanned again, each of
its characters knows the span of the original text that it came from, and its
own wrapped parts join the worklist. Every decoded layer is remembered by its
hash and place, so a layer that decodes to itself ends; the list runs until
nothing new appears.

What a compressed stream holds is unwrapped up to ``MOST_INFLATED`` bytes for each text; beyond, its content is
still inflated in steps and scanned for the base patterns, but not unwrapped again, and the row is marked ``inflated_in_part``.

Defined cases: null and empty texts have no spans; very long texts are scanned whole; rows that repeat give equal
rows; an empty table gives an empty result; other columns are ignored by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table, text_or_empty

# The patterns of the contract. Letters of the keywords are ASCII in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4})+")
_UNICODE_ONE = re.compile(r"(?:\\u|\\U|\\x|%u)([0-9A-Fa-f]+)")
#: The shortest base64 run that can hold a secret; shorter ones decode to less than `token=` and a value.
LEAST_BASE64 = 16
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_BASE64},}}={{0,2}}")
#: Line breaks in a base64 run, also written as escapes.
_BREAK = re.compile(r"[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}+(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)+={{0,2}}")
_MAGIC = re.compile(rb"(\x1f\x8b\x08)|(x[\x01\x5e\x9c\xda])|(BZh[1-9]1AY&SY)|(\xfd7zXZ\x00)")
_OPENS = (lambda: zlib.decompressobj(31), zlib.decompressobj, bz2.BZ2Decompressor, lzma.LZMADecompressor)
_FAULTS = (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError)
#: Bytes of a text's inflated streams that become layers, bytes inflated at once, and characters that two scanned parts of what is beyond share.
MOST_INFLATED, INFLATED_STEP, SHARED = 1 << 26, 1 << 20, 4096
#: Escapes of single bytes by decoder; those of one letter stand in strings whose other bytes are written out.
_BYTES = {
    "url": re.compile(rb"%([0-9A-Fa-f]{2})"),
    "unicode": re.compile(rb"(?:\\x|(?:\\|%)u00|\\U000000)([0-9A-Fa-f]{2})|\\([abfnrtv0\\'\"/])"),
}
_LETTER = dict(zip(b"abfnrtv0", b"\a\b\f\n\r\t\v\0"))
_URLSAFE = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text with, for each character, the span of the original text behind it."""

    __slots__ = ("text", "lo", "hi", "path", "beyond")

    def __init__(self, text: str, lo: np.ndarray | None, hi: np.ndarray | None, path: str):
        self.text, self.lo, self.hi, self.path = text, lo, hi, path
        self.beyond: set[tuple[int, int, int]] = set()  # spans of what was scanned, but is too much to keep

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.lo is None else (int(self.lo[start]), int(self.hi[end - 1]))


def _rewritten(layer: Layer, pattern: re.Pattern, decode, step: str) -> Layer | None:
    """The layer with each match replaced by ``decode(match)``: text and, for each character, its span in the match."""
    text, lo, hi, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None:
            continue
        changed = True
        s, (chars, starts, ends) = m.start(), new
        keep = np.arange(at, s)
        text += [layer.text[at:s], chars]
        lo += [keep, s + np.asarray(starts, dtype=np.int64)]
        hi += [keep + 1, s + np.asarray(ends, dtype=np.int64)]
        at = m.end()
    if not changed:
        return None
    keep = np.arange(at, len(layer.text))
    lo, hi = np.concatenate([*lo, keep]), np.concatenate([*hi, keep + 1])
    if layer.lo is not None:
        lo, hi = layer.lo[lo], layer.hi[hi - 1]
    return Layer("".join(text) + layer.text[at:], lo, hi, f"{layer.path}>{step}")


def _by_char(raw: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each character of UTF-8."""
    b = np.frombuffer(raw, np.uint8)
    first = np.flatnonzero((b & 0xC0) != 0x80)
    return first, np.append(first[1:], len(b))


def _percent(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        first = np.arange(len(raw))
        return text, first * 3, first * 3 + 3
    first, end = _by_char(raw, text)
    return text, first * 3, end * 3


def _unicode(run: str):
    units = [(int(m[1], 16), m.start(), m.end()) for m in _UNICODE_ONE.finditer(run)]
    chars, starts, ends = [], [], []
    k = 0
    while k < len(units):
        code, s, e = units[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            code, e, k = 0x10000 + ((code - 0xD800) << 10) + units[k + 1][0] - 0xDC00, units[k + 1][2], k + 1
        k += 1
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:  # no character: stays as it is written
            chars += run[s:e]
            starts += range(s, e)
            ends += range(s + 1, e + 1)
            continue
        chars.append(chr(code))
        starts.append(s)
        ends.append(e)
    return ("".join(chars), starts, ends) if len(chars) < len(run) else None


class Budget:
    """Bytes that a text's streams may still become layers for, and the spans of what was only scanned."""

    __slots__ = ("left", "partial")

    def __init__(self):
        self.left, self.partial = MOST_INFLATED, False


def _steps(opens, raw: bytes):
    """Content of a compressed stream in parts of at most INFLATED_STEP bytes; ends with the length of a stream that ends, else 0."""
    d, feed = opens(), raw
    try:
        while True:
            part = d.decompress(feed, INFLATED_STEP)
            if part:
                yield part
            if d.eof:
                yield len(raw) - len(d.unused_data)
                return
            feed = d.unconsumed_tail if hasattr(d, "unconsumed_tail") else b""
            if not part and not feed:
                break
    except _FAULTS:
        pass
    yield 0


def _sound_part(opens, raw: bytes):
    """What a broken stream holds up to its fault, byte for byte."""
    d = opens()
    try:
        for k in range(len(raw)):
            feed = raw[k : k + 1]
            while part := d.decompress(feed, INFLATED_STEP):
                yield part
                feed = d.unconsumed_tail if hasattr(d, "unconsumed_tail") else b""
    except _FAULTS:
        pass
    yield 0


def _inflate(opens, raw: bytes, budget: Budget) -> tuple[bytes, int, set[int]]:
    """What compressed bytes hold, as far as they are sound and the budget goes, the length of a stream that ends (else 0), and the kinds of secrets beyond."""
    for steps in (_steps, _sound_part):
        held, kinds, tail, length = [], set(), "", 0
        for part in steps(opens, raw):
            if isinstance(part, int):
                length = part
            elif len(part) <= budget.left:
                held.append(part)
                budget.left -= len(part)
            else:
                budget.partial = True
                text = tail + part.decode("latin-1")
                kinds |= {kind for _, kind, _ in base_spans(text)}
                tail = text[-SHARED:]
        if length:
            break
        budget.left += sum(map(len, held)) if steps is _steps else 0  # read again, to the fault
    return b"".join(held), length, kinds


def _streams(raw: bytes, budget: Budget, bare: bool = False) -> list[tuple[int, int, bytes, set[int]]]:
    """(start, end, content, kinds beyond the budget) of the compressed streams in bytes; with ``bare``, of bytes that are one deflate stream without a head."""
    out, at = [], 0
    while m := _MAGIC.search(raw, at):
        content, length, kinds = _inflate(_OPENS[m.lastindex - 1], raw[m.start() :], budget)
        at = m.start() + (length or 1)
        if content or kinds:
            out.append((m.start(), at if length else len(raw), content, kinds))
    if bare and not out:
        try:
            d = zlib.decompressobj(-15)
            d.decompress(raw, 16)
            content, length, kinds = _inflate(lambda: zlib.decompressobj(-15), raw, budget)
            if length == len(raw) and len(content) >= LEAST_ASSIGN:
                out.append((0, len(raw), content, kinds))
        except zlib.error:
            pass
    return out


def _text(raw: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """Bytes as UTF-8, or as latin-1 where they are not, with first and end byte of each character."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        first = np.arange(len(raw))
        return raw.decode("latin-1"), first, first + 1
    return text, *_by_char(raw, text)


def _inflated(layer: Layer, raw: bytes, step: str, span, budget: Budget, bare: bool = False) -> list[Layer]:
    """Layers of the compressed streams in bytes, and of those in their content; ``span(start, end)`` is that of bytes in the layer."""
    out, todo = [], [(*span(s, e), content, kinds, f"{layer.path}>{step}>inflate") for s, e, content, kinds in _streams(raw, budget, bare)]
    while todo:
        s, e, content, kinds, path = todo.pop()
        text, *_ = _text(content)
        s0, e0 = layer.origin(s, e)
        new = Layer(text, np.full(len(text), s0), np.full(len(text), e0), path)
        new.beyond = {(s0, kind, e0) for kind in kinds}
        out.append(new)
        todo += [(s, e, inner, more, f"{path}>inflate") for _, _, inner, more in _streams(content, budget) if inner != content]
    return out


def _escaped(layer: Layer, step: str, budget: Budget) -> list[Layer]:
    """Layers of compressed bytes that are written as escapes, with others between them as they are."""
    written = layer.text.encode("utf-8", "surrogatepass")
    ends, starts, parts, size, at = [0], [0], [], 0, 0  # byte of the decoded and of the written form, after each escape
    for m in _BYTES[step].finditer(written):
        byte = bytes.fromhex(m[1].decode()) if m[1] else bytes([_LETTER.get(m[2][0], m[2][0])])
        parts += [written[at : m.start()], byte]
        size += m.start() - at
        ends += [size, size + 1]
        starts += [m.start(), m.end()]
        size, at = size + 1, m.end()
    raw = b"".join(parts) + written[at:]

    def place(k: int) -> int:
        i = bisect.bisect_right(ends, k) - 1
        return len(written[: starts[i] + k - ends[i]].decode("utf-8", "replace"))

    return _inflated(layer, raw, step, lambda s, e: (place(s), place(e)), budget) if parts else []


def _base64(layer: Layer, run: str, places: np.ndarray, end: int, budget: Budget) -> list[Layer]:
    """Layers of a base64 run whose characters are at ``places``, at each alignment, since what it begins with may be no part of it."""
    out = []
    run = run.rstrip("=").translate(_URLSAFE)
    for skip in range(4):
        part = run[skip:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        if len(part) < LEAST_BASE64:
            break
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        text, first, stop = _text(raw)
        lo = places[skip + first * 8 // 6]
        hi = places[skip + np.minimum(-(-stop * 8 // 6), len(part)) - 1] + 1
        if layer.lo is not None:
            lo, hi = layer.lo[lo], layer.hi[hi - 1]
        out.append(Layer(text, lo, hi, f"{layer.path}>base64"))
        at = places[skip:]
        out += _inflated(layer, raw, "base64", lambda s, e: (int(at[s * 8 // 6]), end if e == len(raw) else int(at[min(-(-e * 8 // 6), len(part)) - 1]) + 1), budget, not skip and len(text) == len(raw))
    return out


def _unwrapped(layer: Layer, budget: Budget) -> list[Layer]:
    out = []
    if "\\" in layer.text or "%u" in layer.text:
        if (new := _rewritten(layer, _UNICODE, _unicode, "unicode")) is not None:
            out += [new, *_escaped(layer, "unicode", budget)]
    if "%" in layer.text:
        if (new := _rewritten(layer, _PERCENT, _percent, "url")) is not None:
            out += [new, *_escaped(layer, "url", budget)]
    for m in _BASE64.finditer(layer.text):
        out += _base64(layer, m[0], np.arange(m.start(), m.end()), m.end(), budget)
    for m in _WRAPPED.finditer(layer.text):
        places, at = [], m.start()
        for x in _BREAK.finditer(layer.text, m.start(), m.end()):
            places.append(np.arange(at, x.start()))
            at = x.end()
        places = np.concatenate([*places, np.arange(at, m.end())])
        if len(places) >= LEAST_BASE64:
            out += _base64(layer, _BREAK.sub("", m[0]), places, m.end(), budget)
    return out


def scan_text(text: str, budget: Budget | None = None) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], str]]:
    """Base spans, and all spans with the path of layers that led to each: (start, kind, end)."""
    base, budget = base_spans(text), budget or Budget()
    found = dict.fromkeys(base, "text")
    todo, seen = [Layer(text, None, None, "text")], set()
    while todo:
        for new in _unwrapped(todo.pop(), budget):
            mark = (hashlib.sha1(new.text.encode("utf-8", "surrogatepass")).digest(), int(new.lo[0]) if len(new.lo) else 0)
            if mark in seen:
                continue
            seen.add(mark)
            for span in new.beyond:
                found.setdefault(span, new.path)
            for start, kind, end in base_spans(new.text):
                lo, hi = new.origin(start, end)
                found.setdefault((lo, kind, hi), new.path)
            todo.append(new)
    return base, found


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


SPANS = "array<struct<kind:string,start:int,end:int,path:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (each span with its path of layers) and inflated_in_part."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("path", pa.string())]))
        for batch in slices(batches):
            budgets = [Budget() for _ in range(batch.num_rows)]
            rows = [scan_text(t, b) for t, b in zip(batch.column(1).to_pylist(), budgets)]
            count = lambda k: pa.array([sum(x[1] == k for x in base) for base, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), count(0), count(1), count(2),
                    pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                    pa.array([_joined(found) for _, found in rows], pa.string()),
                    pa.array([[{"kind": KINDS[k], "start": s, "end": e, "path": p} for (s, k, e), p in sorted(found.items())] for _, found in rows], kind),
                    pa.array([b.partial for b in budgets]),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found", "inflated_in_part"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found {SPANS}, inflated_in_part boolean")


def mask(text: str) -> str:
    """The text with each secret, and each wrapped run that holds one, replaced by a mark; overlapping spans become one."""
    _, found = scan_text(text)
    out, at, open_end, kind = [], 0, -1, 0
    start = None
    for s, k, e in [*sorted(found), (len(text) + 1, 0, len(text) + 1)]:
        if start is not None and s >= open_end:
            out += [text[at:start], f"[{KINDS[kind]} removed]"]
            at, start = open_end, None
        if start is None:
            start, kind, open_end = s, k, e
        open_end = max(open_end, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars`` counted anew; a text without any stays as it is, null too."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([None if t is None else mask(t) for t in batch.column("text").to_pylist()], pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def op6_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")
