"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of whitespace markers with the characters up to the next run. Where no
piece of the vocabulary has a marker behind another character, no merge crosses the start
of a chunk, so a chunk has the same ids wherever it stands. Each task segments every
distinct chunk once and puts the ids together again by position. Other vocabularies
(or normalisers that squeeze or rewrite) are encoded text by text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiweave.llm.common import lists_of, slices, whole_text

MARK = "▁"
#: Bytes of the chunks that a task keeps, about; beyond it the table is emptied and filled anew.
TABLE_BYTES = 32 << 20
#: Characters of a chunk that is kept (longer ones hardly come again), and bytes of an entry beside its chunk and ids.
KEPT_CHARS, ENTRY_BYTES = 200, 200
#: Bytes of text taken together.
RUN_BYTES = 1 << 20
CHUNK = re.compile(" +[^ ]*")


def chunkable(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether pieces stay within chunks and the normaliser only marks the spaces."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        return False
    probes = ("a", "a  b", "  a ", "ﬁ ①", "é", " ", "a\tb\n")
    return sp.encode("a", out_type=str)[0].startswith(MARK) and all(sp.decode(sp.encode(x)) == x for x in probes)


class ChunkTable:
    """Ids of distinct chunks, as packed 32-bit integers."""

    def __init__(self, sp: sentencepiece.SentencePieceProcessor) -> None:
        self.sp, self.ids, self.held, self.whole = sp, {}, 0, not chunkable(sp)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a marked text, each without its first marker."""
        if not text:
            return []
        if self.whole:
            return [text]
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        return [c[1:] for c in CHUNK.findall(" " + text)] if "" in parts else parts

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of the chunks; those that the table lacks are segmented in one call of the library."""
        if self.held > TABLE_BYTES:
            self.ids.clear()
            self.held = 0
        new = list(chunks.difference(self.ids))
        long: dict[str, bytes] = {}
        for chunk, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            # A marker alone: the library takes an empty text for no text at all.
            ids = ids if chunk or self.whole else [self.sp.piece_to_id(MARK)]
            packed = array("i", ids).tobytes()
            if len(chunk) > KEPT_CHARS:
                long[chunk] = packed
            else:
                self.ids[chunk] = packed
                self.held += ENTRY_BYTES + len(chunk) + len(packed)
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        parts = [self.chunks(t) for t in texts]
        long = self.learn(set(chain.from_iterable(parts)))
        if not long:
            return [b"".join(map(self.ids.__getitem__, p)) for p in parts]
        return [b"".join(self.ids[c] if c in self.ids else long[c] for c in p) for p in parts]


def encoder(model: bytes):
    """A column function: text to array<int> of ids; null gives no ids."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(sentencepiece.SentencePieceProcessor(model_proto=model))
        for texts in batches:
            yield lists_of(chain.from_iterable(table.encode([(t or b"").decode() for t in run.to_pylist()]) for run in slices(texts, RUN_BYTES)))

    return encode


def decoder(model: bytes):
    """A column function: array<int> to the text that the library decodes; null gives the empty text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for rows in batches:
            at, ids = rows.offsets.to_numpy().tolist(), rows.values.to_numpy()
            yield pa.array([sp.decode(ids[a:b].tolist()) if a < b else "" for a, b in pairwise(at)], pa.string())

    return decode


def checked_encoder(model: bytes):
    """A column function: text to its ids and whether the library decodes them to the text; null is the empty text."""

    @F.arrow_udf("ids array<int>, same boolean")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        table = ChunkTable(sp)
        for batch in batches:
            packed, same = [], []
            for run in slices(batch, RUN_BYTES):
                texts = [(t or b"").decode() for t in run.to_pylist()]
                found = table.encode(texts)
                packed += found
                same += [(sp.decode(array("i", ids).tolist()) if ids else "") == t for t, ids in zip(texts, found, strict=True)]
            yield pa.StructArray.from_arrays([lists_of(packed), pa.array(same, pa.bool_())], ["ids", "same"])

    return encode


def model_bytes(path: str) -> bytes:
    """The vocabulary file as the driver has it; tasks get its bytes (under a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of ids, as ``encode(text)`` of the library gives them.

    Null and empty texts have no ids. Repeated rows and further columns stay as they are; a
    column already named ``ids`` is replaced. Texts of any length are encoded whole.
    """
    return docs.withColumn(ids, encoder(model_bytes(model_path))(whole_text(text)))


def decode_ids(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of its ids, as ``decode(ids)`` of the library gives it; null ids give ''."""
    return docs.withColumn(text, decoder(model_bytes(model_path))(F.col(ids)))


def encode_checked(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", same: str = "same") -> DataFrame:
    """``docs`` with ``encode(text)`` of the library and whether ``decode`` of it is the text, in one pass.

    As ``encode_texts`` and ``decode_ids``, but ids and decoded texts do not go to a second Python worker.
    """
    found = docs.withColumn("__found", checked_encoder(model_bytes(model_path))(whole_text(text)))
    return found.withColumn(ids, F.col("__found.ids")).withColumn(same, F.col("__found.same")).drop("__found")


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids, comma-joined."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
