"""Byte-level BPE as a finite-state transducer, encoding and decoding.

The merges are compiled into compatibility of neighbours: two tokens may stand
side by side when merging their bytes gives exactly these two. Every prefix of a
text then has one last token, the token ending there that is compatible with the
last token of the prefix before it. A state of the transducer is the set of places
in the token trie that the positions from which a token may run on have reached;
a transition knows the tokens that end with its byte. States, transitions and
compatibilities are made when a text first needs them. A token is emitted once
every way on agrees about it, after a lookahead bounded by the longest token.

A task keeps the transducer and the ids of pieces it has met; both are caches of
bounded size and change no result. Decoding joins token bytes in chunks; a UTF-8
state machine carries a character cut by a chunk's end into the next chunk.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import filled, text_batches

NOWHERE = -1
#: Bounds of the caches of one task: states of the transducer, and known pieces or pairs.
MOST_STATES = 60_000
MOST_PIECES = 200_000
#: Bytes of one piece after which what is certain is emitted; over the longest token.
LOOKAHEAD = 1024
#: Tokens that one step of decoding joins.
CHUNK = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes one piece of bytes; the merge order is the order of the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {rank: word for word, rank in ranks.items()}
        self.children: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.token_at: dict[int, int] = {}
        nodes = 1
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                step = node << 8 | byte
                node = self.children.get(step, 0)
                if not node:
                    node = self.children[step] = nodes
                    nodes += 1
            self.token_at[node] = rank
        self.inner = {step >> 8 for step in self.children}
        self.spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: (trie node, distance back) of each position a token may run on from;
        # a transition: state * 256 + byte -> (next state * 256, tokens that end here,
        # the longest first, each with its length)
        start = ((0, 0),)
        self.numbers = {start: 0}
        self.states = [start]
        self.steps: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}

    def _parts(self, word: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge of ``word`` joins."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 2:
            found = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            ranked = [r for r in found if r is not None]
            if not ranked:
                raise ValueError(f"no merges lead to {word!r}")
            at = found.index(min(ranked))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that touch one end of ``token`` as it grows from a byte to the
        whole, each with the rank at which it becomes the next (the whole: none)."""
        known = self.spines[side].get(token)
        if known is None:
            word = self.words[token]
            known = [(word, len(self.ranks) + 1)]
            while parts := self._parts(word):
                known.append((parts[1 - side], self.ranks[word]))
                word = parts[1 - side]
            known.reverse()
            self.spines[side][token] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # the parts that meet at the seam, in the order in which the merges grow them
        ends, starts = self._spine(left, 0), self._spine(right, 1)
        i = j = 0
        while True:
            end, end_grows = ends[i]
            start, start_grows = starts[j]
            across = self.ranks.get(end + start)
            if across is not None and across < end_grows and across <= start_grows:
                return False
            if i + 1 == len(ends) and j + 1 == len(starts):
                return True
            if j + 1 == len(starts) or (i + 1 < len(ends) and end_grows <= start_grows):
                i += 1
            else:
                j += 1

    def _step(self, step: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The transition of a state and a byte, which is kept from now on."""
        alive, ends = [], []
        for node, back in self.states[step >> 8]:
            after = self.children.get(node << 8 | step & 255)
            if after is None:
                continue
            if after in self.inner:
                alive.append((after, back + 1))
            if after in self.token_at:
                ends.append((self.token_at[after], back + 1))
        alive.append((0, 0))
        found = self.steps[step] = (self._number(tuple(alive)) << 8, tuple(ends))
        return found

    def _number(self, state: tuple) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        return number

    def _fits(self, pair: int) -> bool:
        if len(self.fits) > MOST_PIECES:
            self.fits.clear()
        found = self.fits[pair] = self._compatible(pair >> 32, pair & 0xFFFFFFFF)
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        # the last token of each prefix, with its length, since the position up to
        # which all is emitted; what stands there fits whatever may follow
        taken: list[tuple[int, int]] = [(NOWHERE, 0)]
        state = at = 0
        known, fits = self.steps.get, self.fits.get
        for begin in range(0, len(piece), LOOKAHEAD):
            if begin:
                at -= self._emit(out, taken, state >> 8)
            if len(self.states) > MOST_STATES:
                here = self.states[state >> 8]
                self.reset()
                state = self._number(here) << 8
                known = self.steps.get
            for byte in piece[begin:begin + LOOKAHEAD]:
                state, ends = known(state | byte) or self._step(state | byte)
                at += 1
                for end in ends:
                    token, length = end
                    # one of them fits; if none of the longer ones, then the byte alone
                    if length == 1:
                        break
                    last = taken[at - length][0]
                    if last < 0:
                        break
                    pair = last << 32 | token
                    fit = fits(pair)
                    if fit or fit is None and self._fits(pair):
                        break
                taken.append(end)
        self._walk(out, taken, at)
        return out

    @staticmethod
    def _walk(out: list[int], taken: list, to: int) -> None:
        """Emit what leads to the position ``to``."""
        back = []
        while to > 0:
            token, length = taken[to]
            back.append(token)
            to -= length
        back.reverse()
        out += back

    def _emit(self, out: list[int], taken: list, state: int) -> int:
        """Emit up to the last position through which every way on has to go; how far."""
        fronts = {len(taken) - 1 - back for _, back in self.states[state]}
        while len(fronts) > 1:
            last = max(fronts)
            fronts.remove(last)
            fronts.add(last - taken[last][1])
        agreed = fronts.pop()
        self._walk(out, taken, agreed)
        del taken[:agreed]  # the token that ends there stays, as what stands before
        return agreed


class Encoder:
    """Ids of whole texts: each match of the pattern goes through the transducer."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.find = regex.compile(pattern).findall
        encoder = self

        class Known(dict):
            """Packed ids of a word with what stands before it."""

            def __init__(self, lead: str):
                super().__init__()
                self.lead = lead

            def __missing__(self, word: str) -> bytes:
                if len(self) > MOST_PIECES:
                    self.clear()
                ids = self[word] = encoder.pieces(self.lead + word)
                return ids

        self.first, self.spaced, self.after_line = Known(""), Known(" "), Known("\n")

    def pieces(self, text: str) -> bytes:
        encode = self.transducer.encode
        return array("I", [t for piece in self.find(text) for t in encode(piece.encode())]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Where words stand between single blanks and line ends, the matches of the
        pattern are those of ' word', and of a line end and 'word' at the start of
        a line, so known words are looked up; other texts are matched as a whole.
        """
        if text.split() != text.replace("\n", " ").split(" "):
            return self.pieces(text)
        spaced = self.spaced
        found = []
        known = self.first
        for line in text.split("\n"):
            words = line.split(" ")
            found.append(known[words[0]])
            del words[0]
            found += [spaced[word] for word in words]
            known = self.after_line
        return b"".join(found)


class Utf8Stream:
    """Decodes bytes that come in chunks; only a cut character is carried over.

    The state is the sequence begun: how many bytes it wants, and whether those
    at hand can still become a character. What cannot gives U+FFFD.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def wanted(lead: int) -> int:
        if 0xC2 <= lead <= 0xDF:
            return 2
        if 0xE0 <= lead <= 0xEF:
            return 3
        return 4 if 0xF0 <= lead <= 0xF4 else 1

    @classmethod
    def begun(cls, data: bytes) -> int:
        """Bytes at the end of ``data`` that are an unfinished character."""
        for count in range(1, min(3, len(data)) + 1):
            byte = data[-count]
            if byte & 0xC0 == 0x80:
                continue
            if cls.wanted(byte) <= count:
                return 0
            if count > 1:
                # E0, ED, F0 and F4 narrow what may follow them
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF),
                             0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                if not low <= data[1 - count] <= high:
                    return 0
            return count
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.begun(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_ids(words: list[bytes], ids: bytes) -> str:
    tokens = memoryview(ids).cast("I")
    stream = Utf8Stream()
    texts = [stream.feed(b"".join([words[t] for t in tokens[at:at + CHUNK]]))
             for at in range(0, len(tokens), CHUNK)]
    return "".join(texts) + stream.close()


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text as little-endian unsigned 32-bit integers; null gives none."""

    @F.pandas_udf("binary")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path, pattern)
        for texts in batches:
            yield pd.Series([encoder.encode(t) for t in texts])

    return ids_of(filled(text))


def decode(ids: Column, path: str) -> Column:
    """The text of packed ids; null gives the empty text."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = read_ranks(path)
        words = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        for packed in batches:
            yield pd.Series([decode_ids(words, p) for p in packed], dtype=object)

    return text_of(F.coalesce(ids, F.lit(b"")))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, ids): one row per document, repeated rows too; a null or empty text has
    no ids. Other columns are ignored; an empty table gives no rows."""
    text_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       encode(F.col(f"`{text_col}`").cast("string"), path, pattern).alias("ids"))


def roundtrip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of every document and the text they give back."""
    encoded = encode_documents(docs, path, pattern, id_col, text_col)
    return encoded.withColumn("decoded", decode(F.col("ids"), path))
