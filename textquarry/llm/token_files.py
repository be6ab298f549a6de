"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first
chunk of every id; a bitmap says which ids go on, and those have their next
chunk at level 1, in the same order, and so on. The place of an id at the next
level is the number of set bits before it: a directory holds that count for
every 512 bits, so any token is read in a few steps and no block is decoded.

A file is a table of segments in ascending document order, stored by Spark's
Parquet writer, each segment self-contained: levels, bitmaps, directories, and
the ids and lengths of its documents.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.common import filled, keyed_text, text_batches

MAGIC = b"DAC1"
BLOCK = 512
#: Tokens after which a segment ends; a longer document has one of its own.
SEGMENT_TOKENS = 1 << 20
#: Bound of the words whose ids a task keeps.
MOST_WORDS = 350_000
#: Characters of the texts that are split together; a longer text is split alone.
GROUP_CHARACTERS = 4_000_000

# Fixed value: the parts of a text in lower case, none of which reaches over white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
PARTS = regex.compile(SPLIT).findall
ASCII_PARTS = re.compile(SPLIT.replace(r"\p{L}+", "[a-z]+").replace(r"\p{N}|", "[0-9]|")
                         .replace(r"\p{L}\p{N}", "a-z0-9"), re.ASCII).findall

Tokenize = Callable[[str], np.ndarray]


def pack(ids: np.ndarray) -> bytes:
    """Levels of an id array: count, then per level its size, chunks, bitmap, directory."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK)) if len(more) else []
        ranks = np.concatenate([[0], np.cumsum(counts)])[:-1].astype("<u4") if len(more) else \
            np.zeros(0, "<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes()
                      + bits.tobytes() + ranks.tobytes())
        if not more.any():
            return struct.pack("<B", len(levels)) + b"".join(levels)
        rest = rest[more] >> np.uint32(8)


class Codes:
    """Reads packed levels, any token or all of them."""

    def __init__(self, data: bytes):
        self.levels = []
        at = 1
        for _ in range(data[0]):
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, size, at)
            at += size
            bits = np.frombuffer(data, np.uint8, -(-size // 8), at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", -(-size // BLOCK), at)
            at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))
        self.end = at

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < len(self):
            raise IndexError(place)
        value = 0
        for number, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[place]) << 8 * number
            if not bits[place >> 3] >> (place & 7) & 1:
                break
            block = place // BLOCK
            within = np.unpackbits(bits[block * BLOCK // 8:(place >> 3) + 1], bitorder="little",
                                   count=place - block * BLOCK)
            place = int(ranks[block]) + int(within.sum())
        return value

    def all(self) -> np.ndarray:
        values = None
        for chunks, bits, _ in reversed(self.levels):
            found = chunks.astype(np.uint32)
            if values is not None:
                more = np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)
                found[more] |= values << np.uint32(8)
            values = found
        return values


def segment(doc_ids: list, texts: list[np.ndarray]) -> bytes:
    """A self-contained segment: documents (ids, null flags, lengths) and their tokens."""
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    keys = np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8")
    lengths = np.array([len(t) for t in texts], dtype="<u4")
    return (MAGIC + struct.pack("<I", len(doc_ids)) + keys.tobytes() + known.tobytes()
            + lengths.tobytes() + pack(np.concatenate(texts)))


def open_segment(payload: bytes) -> tuple[list, np.ndarray, Codes]:
    """(document ids, lengths, codes) of a segment."""
    payload = bytes(payload)
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of directly addressable codes")
    (count,) = struct.unpack_from("<I", payload, 4)
    keys = np.frombuffer(payload, "<i8", count, 8)
    known = np.frombuffer(payload, np.uint8, count, 8 + 8 * count)
    lengths = np.frombuffer(payload, "<u4", count, 8 + 9 * count)
    doc_ids = [int(k) if there else None for k, there in zip(keys, known)]
    return doc_ids, lengths, Codes(payload[8 + 13 * count:])


class _Known(dict):
    """Packed ids of the words a task has met, made once each; all go beyond a bound."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) > MOST_WORDS:
            self.clear()
        ids = self[word] = self.make(word)
        return ids


class WordTokenizer:
    """Ids by the tokenizers library, from its JSON file; of one text or of many.

    The parts a text is split into are encoded apart from each other, and none reaches
    over white space: texts are split into words together, each distinct word is looked up
    once, a new one is split, and the library's model encodes those of its parts that are new. A text
    that spells out an added token is encoded whole, as the library looks for
    those first, and so is one whose lower case depends on more than its letters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # bytes that can be shown stand for themselves in a vocabulary, the others for further letters in order
        alphabet = set(ByteLevel.alphabet())
        hidden = [byte for byte in range(256) if chr(byte) not in alphabet]
        self.letters = dict(zip(hidden, sorted(letter for letter in alphabet if ord(letter) > 255)))
        self.parts, self.words = _Known(self._part_ids), _Known(self._word_ids)

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        whole = [self._encoded_whole(text) for text in texts]
        # white space and letters beyond ASCII are left to the words
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(
            ["" if alone else text for text, alone in zip(texts, whole)], pa.string())))
        found = split.flatten().dictionary_encode()
        packed = list(map(self.words.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)))
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        known = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()),
                                         pa.array(np.frombuffer(b"".join(packed), "<u4")))
        ids = known.take(found.indices).flatten().to_numpy()
        ends = np.append(0, np.cumsum(lengths[found.indices.to_numpy()]))[split.offsets.to_numpy()]
        return [self._encode(text) if alone else ids[begin:end]
                for text, alone, begin, end in zip(texts, whole, ends, ends[1:])]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encoded_whole(self, text: str) -> bool:
        if any(token in text for token in self.added):
            return True
        # these letters change with their neighbours in lower case
        return not text.isascii() and ("\u0130" in text or "\u03a3" in text
                                       or not unicodedata.is_normalized("NFC", text))

    def _part_ids(self, part: str) -> bytes:
        shown = part.isascii() and part.isprintable()
        spelled = part if shown else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()

    def _word_ids(self, word: str) -> bytes:
        if not word.isascii():
            return b"".join(map(self.parts.__getitem__, PARTS(word.lower())))
        # letters alone are one part
        return self.parts[word] if word.isalpha() else b"".join(map(self.parts.__getitem__, ASCII_PARTS(word)))


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a JSON file, opened."""
    return WordTokenizer(path)


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``GROUP_CHARACTERS``."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > GROUP_CHARACTERS:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def write_token_files(docs: DataFrame, path: str, tokenizer: Callable[[], Tokenize], end_id: int,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every document, each followed by ``end_id``, to ``path``.

    Documents stand in ascending id order, null ids first, rows of one id ordered
    by a hash of the text. Null texts count as empty. Further columns are ignored;
    an empty table gives files without segments. A tokenizer with a method ``many``
    is given lists of texts.
    """
    text_batches(docs.sparkSession)
    # the key as text too, since pandas would make numbers with nulls among them inexact
    rows = keyed_text(docs, id_col, text_col).select(
        "doc_id", F.col("doc_id").cast("string").alias("key"), filled(F.col("text")).alias("text"))
    tie = F.xxhash64("text")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize = tokenizer()
        many = getattr(tokenize, "many", lambda texts: map(tokenize, texts))
        part = TaskContext.get().partitionId()
        end = np.array([end_id], dtype=np.uint32)
        keys: list = []
        texts: list[np.ndarray] = []
        held = number = 0

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [number], "n_docs": [len(keys)],
                                 "n_tokens": [held], "payload": [segment(keys, texts)]})

        for batch in batches:
            found = (ids for group in _groups(batch["text"]) for ids in many(group))
            for key, ids in zip(batch["key"], found):
                ids = np.concatenate([ids, end])
                keys.append(None if key is None else int(key))
                texts.append(ids)
                held += len(ids)
                if held >= SEGMENT_TOKENS:
                    yield closed()
                    keys, texts, held, number = [], [], 0, number + 1
        if keys:
            yield closed()

    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.select("key", "text").mapInPandas(segments, "part int, seq int, n_docs int, n_tokens long, payload binary") \
        .write.parquet(path)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """(start, n_docs, n_tokens, payload): segments with the number of tokens before each.

    Totals are summed per written part, one row per task of the writer, and run
    through a window over those rows; within a part over its segments.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    in_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("tokens").over(in_parts), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0))
                          .alias("within")).join(before, "part")
    return files.join(places, ["part", "seq"]).select(
        (F.col("before") + F.col("within")).alias("start"), "n_docs", "n_tokens", "payload")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document back from the files, ids packed as
    little-endian unsigned 32-bit integers."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, payload in zip(batch["start"], batch["payload"]):
                doc_ids, lengths, codes = open_segment(payload)
                ids = codes.all().astype("<u4")
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths
                yield pd.DataFrame({
                    "doc_id": pd.array(doc_ids, dtype="Int64"), "start": start + begins,
                    "n_tokens": lengths.astype(np.int64),
                    "ids": [ids[a:b].tobytes() for a, b in zip(begins, ends)]})

    return open_files(spark, path).select("start", "payload").mapInPandas(
        documents, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(spark: SparkSession, path: str, places: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(place, token) for the given places in the whole token sequence.

    Places and segments meet on blocks of ``width`` tokens; only the chunks of
    the token asked for are read. Places outside the sequence give no row.
    """
    files = open_files(spark, path)
    spread = files.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / width),
        F.floor((F.col("start") + F.greatest("n_tokens", F.lit(1)) - 1) / width))))
    wanted = places.select(F.col("place").cast("long")).where("place >= 0").withColumn(
        "block", F.floor(F.col("place") / width))
    met = wanted.join(spread, "block").where(
        (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_tokens")))
    asked = met.groupBy("start").agg(F.first("payload").alias("payload"),
                                     F.collect_list("place").alias("places"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, payload, own in zip(batch["start"], batch["payload"], batch["places"]):
                codes = open_segment(payload)[2]
                yield pd.DataFrame({"place": own, "token": [codes[p - start] for p in own]})

    return asked.mapInPandas(look, "place long, token long")

