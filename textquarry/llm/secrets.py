"""Secrets in texts, also below layers of encoding.

A worklist starts with the text. Each layer is scanned, then it becomes another one
with all percent-encoding decoded, another with all Unicode escapes decoded, and
every stretch of it that is base64 (of text or of compressed bytes) becomes a layer
of its own, until none is left. A layer met
before at the same place is not entered again, so what unpacks to itself ends.
Every character of a layer knows the stretch of the original text it comes from,
so what is found below is reported where it stands in the text.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import filled, keyed_text, text_batches

# The kinds in their order, their patterns, and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
HINTS = ("password", "passwd", "secret", "token", "api")

PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}")
#: Runs of base64 characters that at most line ends (and indents) part.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]+[ \t]*[\r\n]+[ \t]*)*[A-Za-z0-9+/_-]+")
ONE_LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
NOT_BASE64 = re.compile(r"[ \t\r\n]+")
STANDARD = str.maketrans("-_", "+/")
#: No kind of secret, and nothing that holds one, is shorter.
LEAST_ENCODED = 16
#: All patterns are of these bytes, so what else stands beside them does not matter.
PLAIN = re.compile(rb"[\t\r\n\x20-\x7e]{16,}")
#: Where compressed bytes may start.
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|[\x08\x18\x28\x38\x48\x58\x68\x78](?=(.))", re.S)
TOKEN = re.compile(r"\S+")
#: Bytes of what one compressed stretch holds that are read at a time, each with the
#: last of those before; beyond the first, ``cut`` is set.
MOST_UNPACKED = 1 << 26
OVERLAP = 1 << 16


class Layer(NamedTuple):
    """A text, and for each character where it starts and ends in the original;
    None stands for the original itself. ``parts`` are the rewritten words of it."""

    text: str
    starts: np.ndarray | None
    ends: np.ndarray | None
    parts: tuple[tuple[int, int], ...] = ()

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[start:end].max())

    @property
    def flat(self) -> bool:
        """Whether all characters come from one stretch."""
        return self.starts is not None and not self.starts.strides[0]

    def key(self) -> tuple:
        """Equal for layers of the same text from the same places."""
        text = hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest()
        if self.flat:
            return text, int(self.starts[0]), int(self.ends[0])
        return text, hashlib.sha256(self.starts.tobytes() + self.ends.tobytes()).digest()


def _flat(text: str, start: int, end: int) -> Layer:
    return Layer(text, np.broadcast_to(np.int64(start), len(text)), np.broadcast_to(np.int64(end), len(text)))


def _mapped(layer: Layer, text: str, first: np.ndarray, last: np.ndarray, parts: tuple = ()) -> Layer:
    """A layer whose characters come from those from ``first`` to ``last`` of another."""
    if layer.starts is None:
        return Layer(text, first, last + 1, parts)
    return Layer(text, layer.starts[first], layer.ends[last], parts)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain secrets, leftmost without overlap per kind."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_LEAST]
    lowered = text.lower()
    if any(hint in lowered for hint in HINTS):
        # a short value still uses up its stretch of the text
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(found)


def _opened(data: bytes, at: int):
    """What decompresses the stream at a place, None if there cannot be one."""
    if data[at:at + 1] == b"B":
        return bz2.BZ2Decompressor()
    if data[at] == 0x1f:
        return zlib.decompressobj(31)
    return zlib.decompressobj() if (data[at] << 8 | data[at + 1]) % 31 == 0 else None


def _unpacked(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """What each compressed stream in ``data`` holds, wherever it starts, in pieces of at
    most MOST_UNPACKED bytes and the OVERLAP before; whether the piece is not the whole."""
    at = 0
    while match := PACKED.search(data, at):
        at = match.start() + 1
        stream = _opened(data, match.start())
        if stream is None:
            continue
        zipped, given, before = isinstance(stream, bz2.BZ2Decompressor), data[match.start():], b""
        try:
            while True:
                held = stream.decompress(given, MOST_UNPACKED)
                given = b"" if zipped else stream.unconsumed_tail
                ended = stream.eof
                # no more comes of a stream that stops before its end
                last = ended or not held or (stream.needs_input if zipped else not given and len(held) < MOST_UNPACKED)
                if held or before:
                    yield before + held, bool(before) or not ended
                if last:
                    break
                before = (before + held)[-OVERLAP:]
        except (zlib.error, OSError, EOFError, ValueError):
            continue
        if ended:
            at = max(at, len(data) - len(stream.unused_data))


def _percent(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text and PERCENT.search(layer.text):
        yield _rewritten(layer, PERCENT, PERCENT_RUN, _percent_chars)


def _percent_chars(match: re.Match) -> list[tuple[str, int, int]]:
    data = bytes.fromhex(match[0].replace("%", ""))
    out, at = [], 0
    for char in data.decode("utf-8", "replace"):
        # a replaced byte may stand for one to three
        size = len(char.encode()) if char != "�" else 1
        out.append((char, min(3 * at, len(match[0]) - 3), min(3 * (at + size), len(match[0]))))
        at += size
    return out


def _escapes(layer: Layer) -> Iterator[Layer]:
    if "\\" in layer.text and ESCAPE.search(layer.text):
        yield _rewritten(layer, ESCAPE, ESCAPE, _escape_chars)


def _escape_chars(match: re.Match) -> list[tuple[str, int, int]]:
    point = int(match[1] or match[2] or match[3], 16)
    # halves of a pair and impossible numbers are kept apart as unknown characters
    char = chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else "�"
    return [(char, 0, len(match[0]))]


def _rewritten(layer: Layer, sign: re.Pattern, pattern: re.Pattern, chars) -> Layer:
    """The whole layer with what ``pattern`` finds decoded, so that a keyword and its
    value stay together."""
    text, parts, flat = [], [], layer.flat
    first, last = array("q"), array("q")
    size = done = 0

    def keep(end: int) -> None:
        nonlocal size, done
        text.append(layer.text[done:end])
        size += end - done
        if not flat:
            first.extend(range(done, end))
            last.extend(range(done, end))
        done = end

    for token in TOKEN.finditer(layer.text):
        if not sign.search(token[0]):
            continue
        keep(token.start())
        begin = size
        for match in pattern.finditer(layer.text, token.start(), token.end()):
            keep(match.start())
            for char, one, end in chars(match):
                text.append(char)
                size += 1
                if not flat:
                    first.append(match.start() + one)
                    last.append(match.start() + end - 1)
            done = match.end()
        keep(token.end())
        parts.append((begin, size))
    keep(len(layer.text))
    if flat:
        return _flat("".join(text), int(layer.starts[0]), int(layer.ends[0]))._replace(parts=tuple(parts))
    return _mapped(layer, "".join(text), np.array(first, dtype=np.int64), np.array(last, dtype=np.int64), tuple(parts))


def _found(layer: Layer) -> Iterator[tuple[int, int, int]]:
    """Secrets of the layer, and of its rewritten words alone, where no word before
    them takes their keyword for its value."""
    yield from scan(layer.text)
    for begin, stop in layer.parts:
        for start, kind, end in scan(layer.text[begin:stop]):
            yield begin + start, kind, begin + end


def _base64(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    parted = "\n" in layer.text or "\r" in layer.text
    for match in (BASE64 if parted else ONE_LINE).finditer(layer.text):
        if match.end() - match.start() < LEAST_ENCODED:
            continue
        run, places = match[0], np.arange(match.start(), match.end())
        if parted and NOT_BASE64.search(run):
            gone = np.zeros(len(run), dtype=bool)
            for end in NOT_BASE64.finditer(run):
                gone[end.start():end.end()] = True
            run, places = NOT_BASE64.sub("", run), places[~gone]
            if len(run) < LEAST_ENCODED:
                continue
        run = run.translate(STANDARD)
        # what is glued before it may shift where the encoded bytes start
        for shift in range(4):
            body = run[shift:]
            body = body[:-1] if len(body) % 4 == 1 else body
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            for plain in PLAIN.finditer(data):
                at = np.arange(plain.start(), plain.end())
                first, last = shift + at * 4 // 3, shift + (at * 4 + 3) // 3
                yield _mapped(layer, plain[0].decode("ascii"), places[first], places[last]), False
            yield from _packed(layer, data, places[shift:])


def _packed(layer: Layer, data: bytes, places: np.ndarray) -> Iterator[tuple[Layer, bool]]:
    """The plain stretches of what is compressed in the decoded bytes of a run, and of
    what is compressed in that."""
    if not PACKED.search(data):
        return
    whole = layer.origin(int(places[0]), int(places[-1]) + 1)
    work, seen = [_unpacked(data)], set()
    while work:
        piece = next(work[-1], None)
        if piece is None:
            work.pop()
            continue
        held, short = piece
        digest = hashlib.sha256(held).digest()
        if digest in seen:
            continue
        seen.add(digest)
        for plain in PLAIN.finditer(held):
            yield _flat(plain[0].decode("ascii"), *whole), short
        work.append(_unpacked(held))


def find(text: str) -> tuple[list, list, int, bool]:
    """(base spans, all spans, layers entered, whether a layer was cut); a span is
    (start, kind, end) in code points of the text."""
    base = scan(text)
    spans = set(base)
    work = [Layer(text, None, None)]
    met: set[tuple] = set()
    entered, cut = 0, False
    while work:
        layer = work.pop()
        below = [(found, False) for found in (*_percent(layer), *_escapes(layer))]
        for found, short in (*below, *_base64(layer)):
            cut |= short
            if not found.text:
                continue
            key = found.key()
            if key in met:
                continue
            met.add(key)
            entered += 1
            for start, kind, end in _found(found):
                begin, stop = found.origin(start, end)
                spans.add((begin, kind, stop))
            work.append(found)
    return base, sorted(spans), entered, cut


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its secrets, repeated rows too.

    ``base`` are those in the plain text, ``spans`` all, ``layers`` the number of
    decoded layers, ``cut`` whether a compressed one was too long to be read at once
    (then it was read in pieces) or stops before its end. Null and empty texts have none; an empty table gives no rows. Further
    columns are ignored. Columns: doc_id, base, spans (arrays of kind, start, end),
    layers, cut.
    """
    text_batches(docs.sparkSession)

    def named(spans: list) -> list[dict]:
        return [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in spans]

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [find(text) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "base": [named(f[0]) for f in found],
                "spans": [named(f[1]) for f in found], "layers": [f[2] for f in found],
                "cut": [f[3] for f in found]})

    span = "array<struct<kind:string,start:long,end:long>>"
    # as text, since pandas would make numbers with nulls among them inexact
    rows = keyed_text(docs, id_col, text_col).select(
        F.col("doc_id").cast("string"), filled(F.col("text")).alias("text"))
    return rows.mapInPandas(
        searched, f"doc_id string, base {span}, spans {span}, layers int, cut boolean").withColumn(
        "doc_id", F.col("doc_id").cast("long"))
