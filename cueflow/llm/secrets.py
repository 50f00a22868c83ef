"""Secret scans with a recursive decoding worklist.

A text is the first layer.  Every layer is scanned for the three kinds of secrets and
unwrapped: percent escapes and ``\\uXXXX`` / ``\\xXX`` escapes give one new layer with all of
them replaced, every base64 run, also over line breaks, gives a layer of its decoded bytes
(U+FFFD for what isn't UTF-8), and decoded or escaped bytes with a gzip, zlib or bzip2 head
are decompressed first, through all members.  New layers go on the worklist until none
is left; a layer with the content of one it comes from is not unwrapped again, which ends
cycles (compressed data that unpacks to itself), nor one that was unwrapped at the same place
of the original.  Copies of a blob elsewhere are unwrapped each.  Each layer knows for every character
the part of the original text it comes from, so findings in any depth map back to spans of
the original (code points, end exclusive).  Findings of the text itself always stay.

A decompressed layer beyond LAYER_BYTES is unwrapped in pieces of about that size, cut at
spaces with OVERLAP bytes in common, so that an archive bomb can't take a task's memory; its
document says so (``n_oversized``).

Defined results: null text is empty; repeated rows are scanned each; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LAYER_BYTES, OVERLAP = 16 << 20, 64 << 10
KINDS = ("assign", "access", "hex")
SCAN_TYPES = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "n_added": "long", "n_oversized": "long"}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+={0,2}")
_BREAK = re.compile(r"\r?\n[ \t]*")
_URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+-])+")
_STRING_ESCAPE = r"""\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[nrt\\'"]"""
# Inside quotes, or from an escape to the next space.
_STRING_BYTES = re.compile(rf"""(?<=(["']))(?:{_STRING_ESCAPE}|(?!\1)[\x20-\x5b\x5d-\x7e])+|\\x[0-9A-Fa-f]{{2}}(?:{_STRING_ESCAPE}|[!-\x5b\x5d-\x7e])+""")
_UNITS = {"%": re.compile("%..|."), "\\": re.compile(rf"{_STRING_ESCAPE}|.", re.DOTALL)}
_STRING_BYTE = re.compile(rb"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\([nrt\\'\"])")
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|x[\x01\x5e\x9c\xda]")
#: What a secret, or a layer with one, has at least; bytes of another alignment seldom do.
_READABLE = re.compile(rb"[\x20-\x7e]{8}")
_ESCAPED = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets of one layer, leftmost and non-overlapping per kind."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A decoded text; character i comes from the original's code points starts[i] to ends[i]."""

    def __init__(self, text: str, starts: list[int] | range | _Same, ends: list[int] | range | _Same):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self) -> tuple | bytes:
        """Tells layers of the same content at different places apart."""
        if isinstance(self.starts, _Same):
            return self.starts.value, self.ends.value
        return hashlib.sha256(np.array([self.starts, self.ends], np.int64)).digest()


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match that decodes replaced, or None if none does."""
    pieces, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        plain = decode(m[0])
        if plain is None:
            continue
        pieces += [layer.text[at : m.start()], *(c for c, _, _ in plain)]
        starts += layer.starts[at : m.start()]
        ends += layer.ends[at : m.start()]
        for _, a, z in plain:
            starts.append(layer.starts[m.start() + a])
            ends.append(layer.ends[m.start() + z - 1])
        at = m.end()
    if not starts:
        return None
    return Layer("".join(pieces) + layer.text[at:], starts + list(layer.starts[at:]), ends + list(layer.ends[at:]))


def _characters(data: bytes) -> list[tuple[str, int, int]]:
    """The characters of UTF-8 bytes with their places; U+FFFD for each byte that is none."""
    out, at = [], 0
    for c in data.decode("utf-8", "surrogateescape"):
        lost = 0xDC80 <= ord(c) <= 0xDCFF
        n = 1 if lost else len(c.encode("utf-8"))
        out.append(("\ufffd" if lost else c, at, at + n))
        at += n
    return out


def _percent(run: str) -> list[tuple[str, int, int]]:
    """Characters of a percent-escaped run with their places in it."""
    return [(c, 3 * a, 3 * z) for c, a, z in _characters(bytes.fromhex(run.replace("%", "")))]


def _escapes(run: str) -> list[tuple[str, int, int]]:
    """Characters of a run of \\u and \\x escapes; surrogate pairs join, lone ones become U+FFFD."""
    out: list[tuple[str, int, int]] = []
    for m in _ESCAPED.finditer(run):
        code = int(m[1] or m[2], 16)
        if 0xDC00 <= code < 0xE000 and out and 0xD800 <= (high := ord(out[-1][0])) < 0xDC00:
            out[-1] = (chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00), out[-1][1], m.end())
        else:
            out.append((chr(code), m.start(), m.end()))
    return [("�" if 0xD800 <= ord(c) < 0xE000 else c, a, z) for c, a, z in out]


class _Same:
    """n times the same value, as a sequence."""

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [self.value] * len(range(*at.indices(self.n)))
        if not -self.n <= at < self.n:
            raise IndexError(at)
        return self.value


def _is_packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:3] == b"BZh" or (data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2]) % 31 == 0)


def _members(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The unpacked bytes of packed ones, in parts of up to LAYER_BYTES: all members, and what follows them."""
    rest, unpacked = b"", False
    while True:
        while len(rest) < 3 and (part := next(parts, None)) is not None:
            rest += part
        if not _is_packed(rest):
            break
        unpack = bz2.BZ2Decompressor() if rest[:3] == b"BZh" else zlib.decompressobj(47)
        zipped = rest[:3] != b"BZh"
        while not unpack.eof:
            try:
                out = unpack.decompress(rest, LAYER_BYTES)
            except (zlib.error, OSError, EOFError):
                return
            unpacked |= bool(out)
            if out:
                yield out
            rest = unpack.unconsumed_tail if zipped else b""
            if not unpack.eof and not rest and (len(out) < LAYER_BYTES if zipped else unpack.needs_input):
                if (part := next(parts, None)) is None:
                    return
                rest = part
        # Members may be padded with zeros.
        rest = unpack.unused_data.lstrip(b"\0")
    if unpacked:
        yield from (x for x in (rest, *parts) if x)


def _unpacked(parts: Iterator[bytes], seen: frozenset[bytes] = frozenset()) -> Iterator[bytes]:
    """Unpacking again and again: archives in archives; ends at bytes that begin as those they come from."""
    first = next(parts, b"")
    if not first:
        return
    key = hashlib.sha256(first).digest()
    again = itertools.chain([first], parts)
    if key in seen or not _is_packed(first):
        yield from again
        return
    inner = _members(again)
    if (head := next(inner, None)) is None:
        # Only looks packed; of the bytes themselves nothing is lost.
        yield first
        yield from parts
        return
    yield from _unpacked(itertools.chain([head], inner), seen | {key})


def _chunks(data: memoryview) -> Iterator[bytes]:
    """The bytes in growing parts: what only looks packed is given up after the first."""
    at, size = 0, 4096
    while at < len(data):
        yield bytes(data[at : at + size])
        at, size = at + size, min(4 * size, 1 << 20)


def _packed_layers(data: bytes | memoryview, start: int, end: int) -> Iterator[tuple[Layer, bool]]:
    """Layers of the unpacked bytes, all of them from start to end of the original; none if they are not packed."""
    if not _is_packed(data):
        return
    parts = _members(_chunks(memoryview(data)))
    if (head := next(parts, None)) is None:
        return
    key = frozenset([hashlib.sha256(data).digest()])
    carry, size, told = b"", 0, False
    for part in _unpacked(itertools.chain([head], parts), key):
        size += len(part)
        carry += part
        if len(carry) <= LAYER_BYTES:
            continue
        yield _whole(carry, start, end), not told
        told = True
        cut = max(carry.rfind(b" ", 1, -OVERLAP), carry.rfind(b"\n\n", 1, -OVERLAP))
        carry = carry[cut if cut > 0 else -OVERLAP :]
    if carry:
        yield _whole(carry, start, end), size > LAYER_BYTES and not told


def _whole(data: bytes, start: int, end: int) -> Layer:
    text = data.decode("utf-8", "replace")
    return Layer(text, _Same(start, len(text)), _Same(end, len(text)))


def _wrapped(text: str) -> Iterator[list[re.Match]]:
    """Runs of base64 on lines that follow each other: all together, and lines of one length with the last of them."""
    chain: list[re.Match] = []
    for m in itertools.chain(_RUN.finditer(text), [None]):
        if m and chain and chain[-1].end() - chain[-1].start() >= 16 and _BREAK.fullmatch(text, chain[-1].end(), m.start()) and not chain[-1][0].endswith("="):
            chain.append(m)
            continue
        if len(chain) > 1:
            yield chain
            at = 0
            while at < len(chain):
                width, last = len(chain[at][0]), at + 1
                while last < len(chain) and len(chain[last][0]) == width:
                    last += 1
                last += last < len(chain) and len(chain[last][0]) < width
                if last - at > 1 and (at, last) != (0, len(chain)):
                    yield chain[at:last]
                at = last
        chain = [m] if m else []


def _base64_layers(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """Layers of base64 in the text, from each of four alignments: a blob may begin anywhere in a
    run, as behind ``/``, ``_`` or ``-``, which are of its alphabet too."""
    runs = ([m] for m in _BASE64.finditer(layer.text))
    for parts in itertools.chain(runs, _wrapped(layer.text) if "\n" in layer.text else ()):
        whole = "".join(m[0] for m in parts).rstrip("=").replace("-", "+").replace("_", "/")
        places = range(parts[0].start(), parts[0].end()) if len(parts) == 1 else [i for m in parts for i in range(m.start(), m.end())]
        end = layer.ends[parts[-1].end() - 1]
        for offset in range(4):
            body = whole[offset:]
            # A last character of six bits holds no byte.
            body = body[: len(body) - (len(body) % 4 == 1)]
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
            except (binascii.Error, ValueError):
                continue
            packed = False
            for new in _packed_layers(data, layer.starts[places[offset]], end) if data else ():
                packed = True
                yield new
            for head in _PACKED.finditer(data, 1):
                yield from _packed_layers(memoryview(data)[head.start() :], layer.starts[places[offset + 4 * head.start() // 3]], end)
            if packed or (offset and not _READABLE.search(data)):
                continue
            plain = _characters(data)
            starts = [layer.starts[places[offset + 4 * a // 3]] for _, a, _ in plain]
            ends = [layer.ends[places[min(offset + (4 * z - 1) // 3, len(places) - 1)]] for _, _, z in plain]
            yield Layer("".join(c for c, _, _ in plain), starts, ends), False


def _string_bytes(run: str) -> bytes:
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}
    return _STRING_BYTE.sub(lambda m: named.get(m[3], m[3]) if m[3] else bytes.fromhex((m[1] or m[2]).decode()), run.encode())


def _escaped_archives(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """Layers of packed bytes that stand escaped in the text."""
    for sign, pattern, decode in (("%", _URL_BYTES, unquote_to_bytes), ("\\", _STRING_BYTES, _string_bytes)):
        if sign not in layer.text:
            continue
        for m in pattern.finditer(layer.text):
            if sign not in m[0]:
                continue
            data, units = decode(m[0]), None
            for head in _PACKED.finditer(data):
                if units is None:  # every unit of the run is a byte
                    units = np.fromiter((u.start() for u in _UNITS[sign].finditer(m[0])), np.int64)
                yield from _packed_layers(memoryview(data)[head.start() :], layer.starts[m.start() + int(units[head.start()])], layer.ends[m.end() - 1])


def unwrapped(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """The layers one decoding step below, and whether one of them was cut."""
    if "%" in layer.text and (new := _replaced(layer, _PERCENT, _percent)):
        yield new, False
    if "\\" in layer.text and (new := _replaced(layer, _ESCAPE, _escapes)):
        yield new, False
    yield from _escaped_archives(layer)
    yield from _base64_layers(layer)


def scan(text: str) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]], int]:
    """Base findings, all findings (start, kind, end), and the number of layers that were cut."""
    base = sorted(find_secrets(text))
    found, oversized = set(base), 0
    digest = lambda layer: hashlib.sha256(layer.text.encode("utf-8", "replace")).digest()
    first = Layer(text, range(len(text)), range(1, len(text) + 1))
    # Layers with the contents of those that they come from.
    todo = [(first, frozenset([digest(first)]))]
    seen = set()
    while todo:
        above, chain = todo.pop()
        for layer, cut in unwrapped(above):
            oversized += cut
            found |= {(layer.starts[a], kind, layer.ends[z - 1]) for a, kind, z in find_secrets(layer.text)}
            if (key := digest(layer)) in chain:
                continue
            if (placed := (key, layer.place())) not in seen:
                seen.add(placed)
                todo.append((layer, chain | {key}))
    return base, found, oversized


def _listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{z}" for a, kind, z in sorted(spans))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            base, found, oversized = scan(text.as_py() or "")
            counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
            rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found), len(found - set(base)), oversized))
        columns = zip(*rows, strict=True) if rows else [[]] * len(SCAN_TYPES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(columns, SCAN_TYPES.values(), strict=True))],
            names=["doc_id", *SCAN_TYPES],
        )


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base findings, all spans, and what the decoding added."""
    schema = ", ".join(f"{c} {t}" for c, t in {"doc_id": "long", **SCAN_TYPES}.items())
    return documents.select("doc_id", "text").mapInArrow(_scan_batches, schema)
