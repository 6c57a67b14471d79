"""Token ids as Parquet list columns, in ascending id order or one that is given.

Token ids repeat, so their column is dictionary-encoded; ids, offsets and counts grow slowly, so theirs are delta-encoded
(format version 2, no dictionary). Row groups and pages are kept small and every file has a page index: a reader that
wants some documents' tokens, or only counts, touches only those pages or columns.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.llm.common import new_path, small_batches

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Parquet writer settings of the format.
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "500",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#first": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
#: Distinct words whose ids a Python worker remembers, from task to task; past that it starts anew (some 100 MB).
REMEMBERED = 600_000

#: A word that ends in ASCII marks (no apostrophe: it can begin a token of letters) after a letter.
_MARKED = re.compile(rb"(.*[a-z])([!-&(-/:-@\[-`{-~]+)", re.S).fullmatch
#: The bytes of such marks.
_MARKS = frozenset(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: A capital with a combining mark (U+0300 to U+036F) on it, perhaps after other ones.
_ACCENTED = re.compile(rb"[A-Z][\x80-\xff]*?(?:\xcc|\xcd[\x80-\xaf])").search


#: Characters that stand for the bytes of a byte-level vocabulary: printable ones for themselves, the others from 256 up.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_UNITS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordEncoder(dict):
    """Token ids of words as little-endian uint32 bytes, each distinct word encoded once, when it is first looked up.

    The vocabulary drops white space and never joins across it, nor from a letter to a following mark, and case does not
    matter to it, but that it composes letters and marks first: some small letters have a composed form where the capital
    has none. So ids of a text are those of its words in turn, lower-cased if no capital has a mark. Texts that hold a
    special token's string are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        """A word of letters alone is one unit for the vocabulary's model, once it is in normal form; one that ends in marks
        has its stem's ids and theirs; others take the tokenizer's whole way."""
        if word[-1] in _MARKS and (m := _MARKED(word)):
            ids = self[m[1]] + self[m[2]]
        else:
            s = word.decode()
            if not s.isascii() and (not unicodedata.is_normalized("NFC", s) or s.lower() != s):
                s = self.tokenizer.normalizer.normalize_str(s)
            if s.isalpha():
                found = [t.id for t in self.tokenize(s if s.isascii() else s.encode().decode("latin-1").translate(_UNITS))]
            else:
                found = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        """Words as they are looked up; of bytes: A-Z, and ASCII white space."""
        if (b"\xcc" in text or b"\xcd" in text) and _ACCENTED(text):
            return [w if _ACCENTED(w) else w.lower() for w in text.split()]
        return text.lower().split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian uint32 bytes."""
        if len(self) > REMEMBERED:
            self.clear()
        whole = lambda t: np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(t) if b"<|" in t else b"".join(map(self.__getitem__, self._words(t))) for t in texts]

    @classmethod
    def of_worker(cls, path: str) -> WordEncoder:
        """The Python worker's encoder, kept on the tokenizers module while the worker lives."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_tracklake_encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]


def write_tokens(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, order: list[Column] | None = None) -> None:
    """Write (doc_id, shard, first, n_tokens, tokens) to path, ascending by id, or by `order`, over files and in each.

    `first` counts the ids of the shard's earlier documents. Null texts are empty and have the end id alone; null ids come
    first; rows that repeat an id are each written, ordered by a hash of their text, over as many files as they need. An
    empty table writes no rows.
    """
    small_batches(df.sparkSession)
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    content = F.coalesce(F.col(text), F.lit(""))
    by = [F.col(doc_id), F.xxhash64(content)] if order is None else order
    places = [f"place{i}" for i in range(len(by))]
    source = df.select(F.col(doc_id).alias("doc_id"), content.alias("text"), *[c.alias(p) for c, p in zip(by, places, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, shard, first = WordEncoder.of_worker(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            encoded = [x + end for x in encoder.encode(b.column("text").cast(pa.binary()).to_pylist())]
            n = np.array([len(x) // 4 for x in encoded], np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(n), shard), pa.int32()), pa.array(first + ends[:-1]), pa.array(n), tokens], ["doc_id", "shard", "first", "n_tokens", "tokens"])
            first += int(ends[-1])

    kind = source.schema["doc_id"].dataType.simpleString()
    ordered = source.repartitionByRange(*places).sortWithinPartitions(*places)
    ordered.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shard int, first long, n_tokens long, tokens array<int>").write.options(**FORMAT).parquet(path)


def write_and_read(df: DataFrame, path: str | None = None, **how: object) -> DataFrame:
    """Write df's tokens, to a new folder in the shared one unless a path is given, and read them again with `start`.

    `start` counts the ids of all documents before a document, as they were written. It takes the last `first + n_tokens` of each shard, a
    few numbers for each file, read without the tokens.
    """
    path = path or new_path(df.sparkSession)
    write_tokens(df, path, **how)
    return read_tokens(df, path, df.schema[how.get("doc_id", "doc_id")].dataType)


def read_tokens(df: DataFrame, path: str, id_type: T.DataType) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of the files in path; columns not asked for are not read."""
    schema = f"doc_id {id_type.simpleString()}, shard int, first long, n_tokens long, tokens array<int>"
    rows = df.sparkSession.read.schema(schema).parquet(path)
    sizes = rows.groupBy("shard").agg(F.max(F.col("first") + F.col("n_tokens")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    offsets = sizes.select("shard", before.alias("offset"))
    return rows.join(offsets, "shard").select("doc_id", (F.col("offset") + F.col("first")).cast("long").alias("start"), "n_tokens", "tokens")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (crc32 of the ids as little-endian uint32) of read tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            values, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "tokens").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
