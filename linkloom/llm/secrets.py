"""Secret scan with a recursive decoding worklist.

A text is scanned for three kinds of secrets. Then every encoded run of it
(percent escapes, unicode and character references, base64) is unwrapped into
a layer of its own, which is scanned and unwrapped in turn until no layer
yields a new one. Bytes that a run stands for are read as UTF-8 or else
Latin-1, UTF-16 in them as its characters, and zlib and gzip data, escaped ones
too, are inflated, all members, as often as they are nested. Layers already seen on the way are not entered again. A span
found in a layer is mapped back through the runs it came from to code points
of the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkloom.llm.words import slices

# Fixed values of the contract: kinds in their order, with patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST_GROUP, _LEAST_ACCESS = 12, 18

LAYER_BYTES = 64 << 20
_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
# Escaped bytes with the characters that are left as they are among them.
_PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()+/$,;:@-])+")
_PERCENT_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|(.)", re.S)
_HEX_RUN = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[abtnvfr0'\"\\]|[\x20-\x5b\x5d-\x7e])+")
_HEX_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|(\\.|.)", re.S)
_NAMED = {"\\a": 7, "\\b": 8, "\\t": 9, "\\n": 10, "\\v": 11, "\\f": 12, "\\r": 13, "\\0": 0, "\\'": 39, '\\"': 34, "\\\\": 92}
_MEMBER = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_WIDE = ((re.compile(r"(?:[^\x00]\x00){8,}"), slice(0, None, 2)), (re.compile(r"(?:\x00[^\x00]){8,}"), slice(1, None, 2)))

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the three kinds, leftmost and non-overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_GROUP]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A text with the span in the root for each of its characters.

    `cuts` are (start in this layer, start in the root, end in the root, exact);
    in an exact piece the characters of layer and root correspond one to one.
    """

    def __init__(self, text: str, cuts: list[tuple[int, int, int, bool]]):
        self.text, self.cuts = text, cuts

    def to_root(self, start: int, end: int) -> tuple[int, int]:
        a, b = self._piece(start), self._piece(end - 1)
        lo = a[1] + (start - a[0]) if a[3] else a[1]
        hi = b[1] + (end - b[0]) if b[3] else b[2]
        return lo, hi

    def _piece(self, at: int) -> tuple[int, int, int, bool]:
        lo, hi = 0, len(self.cuts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if self.cuts[mid][0] <= at:
                lo = mid
            else:
                hi = mid
        return self.cuts[lo]


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match decoded in place; None if nothing changes."""
    parts, cuts, at, size, piece = [], [], 0, 0, 0
    own, text = layer.cuts, layer.text

    def keep(lo: int, hi: int) -> None:
        # A kept stretch is cut where the layer's own pieces are; both go forward only.
        nonlocal size, piece
        while lo < hi:
            while piece + 1 < len(own) and own[piece + 1][0] <= lo:
                piece += 1
            start, a, b, exact = own[piece]
            stop = min(hi, own[piece + 1][0]) if piece + 1 < len(own) else hi
            cuts.append((size, a + lo - start, a + stop - start, True) if exact else (size, a, b, False))
            parts.append(text[lo:stop])
            size += stop - lo
            lo = stop

    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None or got == m[0]:
            continue
        keep(at, m.start())
        at = m.end()
        if got:
            a, b = layer.to_root(m.start(), m.end())
            cuts.append((size, a, b, False))
            parts.append(got)
            size += len(got)
    if not at:
        return None
    keep(at, len(layer.text))
    return Layer("".join(parts), cuts) if size else None


def _percent(run: str) -> str | None:
    """Bytes of a run of percent escapes as UTF-8, undecodable ones as Latin-1."""
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _character(ref: str) -> str | None:
    body = ref[2:].strip("{};")
    n = int(body, 10) if ref[0] == "&" and ref[2] not in "xX" else int(body.lstrip("xX"), 16)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else None


def _packed(raw: bytes) -> bool:
    """Whether bytes begin as zlib or gzip data do."""
    return len(raw) > 8 and (raw[:2] == b"\x1f\x8b" or (raw[0] & 15 == 8 and raw[0] >> 4 < 8 and (raw[0] << 8 | raw[1]) % 31 == 0))


def inflate(raw: bytes, most: int = LAYER_BYTES) -> tuple[bytes, bytes, bool]:
    """All members of zlib or gzip data as far as they inflate, what follows them, and whether they were whole.

    OverflowError if the inflated data pass `most` bytes.
    """
    out = bytearray()
    while _packed(raw):
        member, got = zlib.decompressobj(47), bytearray()
        try:
            got += member.decompress(raw, most + 1 - len(out))
        except zlib.error:
            # What comes before the damage, in small steps.
            member = zlib.decompressobj(47)
            try:
                for k in range(len(raw)):
                    got += member.decompress(raw[k : k + 1], most + 1 - len(out) - len(got))
                    if len(out) + len(got) > most:
                        break
            except zlib.error:
                pass
        out += got
        if len(out) > most:
            raise OverflowError
        if not member.eof:
            return bytes(out), raw, False
        raw = member.unused_data
    return bytes(out), raw, True


def unpack(raw: bytes, most: int = LAYER_BYTES) -> Iterator[str]:
    """Texts of bytes and of all that inflates from them, until nothing does: UTF-8, or else Latin-1.

    See inflate for OverflowError.
    """
    work, seen = deque([raw]), {raw}
    while work:
        raw = work.popleft()
        got, rest, whole = inflate(raw, most)
        if not got or not whole:
            try:
                yield raw.decode("utf-8")
            except UnicodeDecodeError:
                yield raw.decode("latin-1")
        more = [got, rest if got else b"", *(raw[m.start() :] for m in _MEMBER.finditer(raw) if m.start() and not got)]
        for x in more:
            if x and x not in seen:
                seen.add(x)
                work.append(x)


def _escaped_members(text: str, run: re.Pattern, byte: re.Pattern, most: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, compressed bytes) of zlib or gzip data behind escapes in a text."""
    for m in run.finditer(text):
        if m[0].count("%") + m[0].count("\\") < 2:
            continue
        parts = list(byte.finditer(m[0]))
        codes = [int(p[1], 16) if p[1] else _NAMED.get(p[2]) if len(p[2]) > 1 else ord(p[2]) for p in parts]
        raw = bytes(32 if c is None else c for c in codes)
        # A space may be written as a plus sign.
        for form in {raw, bytes(32 if p[0] == "+" else c for p, c in zip(parts, raw, strict=True))} if byte is _PERCENT_BYTE else {raw}:
            done = 0
            for head in _MEMBER.finditer(form):
                if head.start() < done:
                    continue
                try:
                    got, rest, _ = inflate(form[head.start() :], most)
                    stop = len(form) - len(rest) if got and len(rest) < len(form) - head.start() else len(form)
                except OverflowError:
                    got, stop = b"-", len(form)
                if got:
                    done = stop
                    yield m.start() + parts[head.start()].start(), m.start() + parts[stop - 1].end(), form[head.start() : stop]


def _unbase64(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet; None if it isn't one."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def scan(text: str | None, most: int = LAYER_BYTES) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind. Null counts as empty.

    A run that inflates past `most` bytes isn't decoded further; it is reported
    as a span of kind `opaque`, so that it is never passed silently.
    """
    text = text or ""
    order = {k: n for n, k in enumerate((*KINDS, "opaque"))}
    key = lambda s: (s[1], order[s[0]], s[2])
    base = sorted(base_spans(text), key=key)
    found = set(base)
    if not _may_hold(text):
        return base, base
    work = deque([Layer(text, [(0, 0, len(text), True)])])
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}

    def enter(layer: Layer | None) -> None:
        if layer is None:
            return
        tag = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass") + repr(layer.cuts).encode(), digest_size=16).digest()
        if tag not in seen:
            seen.add(tag)
            found.update((kind, *layer.to_root(a, b)) for kind, a, b in base_spans(layer.text))
            work.append(layer)

    def open_up(layer: Layer, start: int, end: int, raw: bytes | None) -> None:
        a, b = layer.to_root(start, end)
        try:
            for got in unpack(raw, most) if raw else ():
                enter(Layer(got, [(0, a, b, False)]))
        except OverflowError:
            found.add(("opaque", a, b))

    while work:
        layer = work.popleft()
        if "%" in layer.text:
            enter(_replaced(layer, _ESCAPE, _percent))
            for start, end, raw in _escaped_members(layer.text, _PERCENT_RUN, _PERCENT_BYTE, most):
                open_up(layer, start, end, raw)
        if "\\" in layer.text or "&#" in layer.text:
            enter(_replaced(layer, _UNICODE, _character))
            for start, end, raw in _escaped_members(layer.text, _HEX_RUN, _HEX_BYTE, most) if "\\x" in layer.text else ():
                open_up(layer, start, end, raw)
        for pattern, step in _WIDE if "\x00" in layer.text else ():
            enter(_replaced(layer, pattern, lambda run, step=step: run[step]))
        for m in _BASE64.finditer(layer.text):
            open_up(layer, m.start(), m.end(), _unbase64(m[0]))
    return base, sorted(found, key=key)


def _may_hold(text: str) -> bool:
    return "%" in text or "\\" in text or "&#" in text or "\x00" in text or _BASE64.search(text) is not None


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[Span], mask: str = "[SECRET]") -> str | None:
    """The text with overlapping spans merged and each replaced by the mask."""
    if text is None or not spans:
        return text
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_spans long"


def scan_documents(docs: DataFrame, column: str = "text", most: int = LAYER_BYTES) -> DataFrame:
    """One row for each row of docs: counts and spans of the base, and all spans.

    Null counts as empty: no spans. Every row is scanned by itself, so repeated
    rows give equal rows and null ids stay. An empty table gives an empty
    result; other columns are ignored.
    """
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "n_spans"]

    def one(text: str | None) -> tuple:
        base, spans = scan(text, most)
        kinds = [s[0] for s in base]
        return *(kinds.count(k) for k in KINDS), joined(base), joined(spans), len(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [one(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).mapInArrow(run, SCANNED)


def redacted(docs: DataFrame, column: str = "text", mask: str = "[SECRET]", most: int = LAYER_BYTES) -> DataFrame:
    """docs with every found span of `column` replaced by the mask; all columns stay."""
    index = docs.columns.index(column)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, scan(t, most)[1], mask) for t in batch.column(index).to_pylist()]
            cols = list(batch.columns)
            cols[index] = pa.array(texts, batch.column(index).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)
