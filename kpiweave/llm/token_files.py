"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A file is a run of zstandard frames of whole documents' ids (little-endian unsigned, 16 bits
where the vocabulary allows it, else 32), a skippable frame with the index of the documents, and
the skippable seek table of the public seekable format: for each frame its compressed and plain
size and the low half of the XXH64 of its plain bytes, then the number of frames, a descriptor and
a magic number. A reader takes the tail, and then decompresses only frames that it needs, each
checked against its checksum.

Files are written by tasks in ascending order of the ids, file by file, under a name of the
attempt, and then moved to their final name: a repeated task leaves the same file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiweave.llm.common import slices, whole_text, written

# Fixed values of the seekable format.
SKIPPABLE, SEEK_TABLE, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKED = 0x80  # descriptor: entries have checksums
#: Plain bytes from which a frame is closed, text bytes of a file, and the id that ends a document.
FRAME_BYTES, FILE_BYTES, END_ID = 128 << 10, 24 << 20, 0
LEVEL = 3
RUN_BYTES, TABLE_ROWS = 2 << 20, 1_000_000
INDEX = np.dtype([("id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u4"), ("count", "<u8")])
#: How a vocabulary of bytes spells a space, and the parts that are encoded in one text.
SPACE, TOGETHER = "Ġ", 1000
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class PieceTable:
    """Ids of the different space-separated parts of texts.

    The vocabulary's pattern never lets a token cross a single space between two characters that
    are not white space, other than as its first character. So such parts have the same ids
    wherever they stand, and each is encoded once. Texts where a space has white space beside it
    are parted only where it has not. Texts that hold an added token go through the library whole, as
    do all where an added token has a space. ``literal``: special tokens in texts are spelled out.
    """

    def __init__(self, tokenizer: str, kind: str, literal: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(tokenizer)
        self.encoder.encode_special_tokens = literal
        added = self.encoder.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if t.content and not (literal and t.special)]
        self.all_whole = any(" " in t for t in self.added)
        self.kind = kind
        vocabulary = self.encoder.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.after: dict[str, bytes | None] = {}

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed_after(self, parts: list[str]) -> list[bytes]:
        """Ids of parts with a space before each: many in one text, told apart by the ids that begin with a space."""
        out: list[bytes] = []
        runs = [parts[at : at + TOGETHER] for at in range(0, len(parts), TOGETHER)]
        texts = [" " + " ".join(run) for run in runs]
        width = array(self.kind).itemsize
        for run, found in zip(runs, self.encoder.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            at = (np.flatnonzero(self.opens[ids]) * width).tolist()
            if len(at) != len(run):
                raise ValueError("a token of the vocabulary crosses a space")
            data = ids.tobytes()
            out += [data[a:b] for a, b in pairwise([*at, len(data)])]
        return out

    def _learn(self, parts: set[str]) -> None:
        if len(self.after) > TABLE_ROWS:
            self.after.clear()
        new = [p for p in parts.difference(self.after)]
        plain = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        self.after.update(dict.fromkeys(new))
        self.after.update(zip(plain, self._packed_after(plain), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        whole = [i for i, t in enumerate(texts) if self.all_whole or any(a in t for a in self.added)]
        if whole:
            held = dict(zip(whole, self._packed([texts[i] for i in whole]), strict=True))
            rest = iter(self._parted([t for i, t in enumerate(texts) if i not in held]))
            return [held[i] if i in held else next(rest) for i in range(len(texts))]
        return self._parted(texts)

    def _parted(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") for t in texts]
        self._learn(set(chain.from_iterable(p[1:] for p in parts)))
        first = self._packed([p[0] for p in parts])
        out = []
        for text, start, p in zip(texts, first, parts, strict=True):
            if p[0][-1:].isspace() or not p[0]:
                out.append(self._uneven(text))
                continue
            try:
                out.append(start + b"".join(map(self.after.__getitem__, p[1:])))
            except TypeError:  # a part without ids of its own
                out.append(self._uneven(text))
        return out

    def _uneven(self, text: str) -> bytes:
        start, *rest = BETWEEN.split(text)
        return b"".join(self._packed([start, *(" " + p for p in rest)]))


@lru_cache(maxsize=1)
def kept_table(tokenizer: str, kind: str, literal: bool) -> PieceTable:
    """The table of a worker process, kept for its later tasks: their files share most parts."""
    return PieceTable(tokenizer, kind, literal)


class Writer:
    """Writes one file."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.frames, self.index, self.plain, self.held, self.tokens = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is not None, len(self.frames), self.held // self.width, len(ids) // self.width))
        self.plain.append(ids)
        self.held += len(ids)
        self.tokens += len(ids) // self.width
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            plain = b"".join(self.plain)
            packed = self.zip.compress(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.plain, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = self.zip.compress(struct.pack("<II", self.width, len(self.index)) + np.array(self.index, INDEX).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<III", len(index) + 8, 0, 0)
        tail = struct.pack("<IBI", len(self.frames) + 1, CHECKED, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(entries) + len(tail)) + entries + tail)


class Reader:
    """Reads documents of one file, frame by frame as needed."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        frames, descriptor, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_END or descriptor != CHECKED:
            raise ValueError("the file has no seek table")
        table = np.frombuffer(source.read_at(12 * frames, size - 9 - 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.frames, last = table[:-1], table[-1]
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        plain = zstandard.decompress(source.read_at(int(last[0]) - 8, int(self.starts[-1]) + 8))
        self.width, count = struct.unpack_from("<II", plain)
        self.index = np.frombuffer(plain, INDEX, count, 8)

    def frame(self, number: int) -> bytes:
        packed, size, checksum = self.frames[number].tolist()
        plain = zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, int(self.starts[number])), max_output_size=size)
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return plain

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) of all documents in order, or of those with the wanted ids."""
        held, plain = -1, b""
        for doc_id, known, frame, at, count in self.index.tolist():
            if wanted is not None and (not known or doc_id not in wanted):
                continue
            if frame != held:
                held, plain = frame, self.frame(frame)
            yield doc_id if known else None, np.frombuffer(plain, f"<u{self.width}", count, at * self.width)


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_files(docs: DataFrame, tokenizer_path: str, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and writes the documents; one row (file, name, documents, tokens, start) for each file.

    Documents are in ascending order of their ids (null ids first, equal ids by a hash of the text), END_ID
    behind each. Ids are those of the library as the file sets it up: an added token in a text, such as a special
    one, is one id. Null texts are empty. ``folder`` is one that all executors reach. Ids must be integers.
    ``start``: tokens in all files before. An empty table has no files.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_str(tokenizer).get_vocab_size() <= 1 << 16 else 4
    kind, end = {2: "H", 4: "I"}[width], END_ID.to_bytes(width, "little")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), whole_text(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("id"), F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(1 + total // FILE_BYTES, *order).sortWithinPartitions(*order)
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer)  # the vocabulary: a few megabytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, table, writer = TaskContext.get().partitionId(), None, None
        target = f"ids-{number:08d}.zst"
        for batch in batches:
            ids, at = batch.column("id").to_pylist(), 0
            for run in slices(batch.column("text"), RUN_BYTES):
                if writer is None:
                    table = kept_table(shipped.value, kind, False)
                    store, path = opened(folder)
                    store.create_dir(path, recursive=True)
                    attempt = f"{path}/.{target}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(attempt)
                    writer = Writer(out, width)
                for packed in table.encode([(t or b"").decode() for t in run.to_pylist()]):
                    writer.add(ids[at], packed + end)
                    at += 1
        if writer is not None:
            writer.close()
            out.close()
            store.move(attempt, f"{path}/{target}")
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array([number], pa.int32()), "name": [target], "documents": pa.array([len(writer.index)], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())}
            )

    files = written(sorted_rows.mapInArrow(write, "file int, name string, documents bigint, tokens bigint"), "files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one thin row for each file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_files(files: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of the documents in the files, read back frame by frame.

    ``wanted``: only these ids, for which only their frames are decompressed. ``ids_crc32``: of the ids as
    little-endian unsigned 32-bit integers.
    """
    chosen = None if wanted is None else set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = opened(folder)
                with store.open_input_file(f"{path}/{row['name']}") as source:
                    reader = Reader(source)
                    starts = row["start"] + np.cumsum(reader.index["count"].astype(np.int64)) - reader.index["count"].astype(np.int64)
                    if chosen is not None:
                        starts = starts[[bool(k) and i in chosen for i, k in zip(reader.index["id"].tolist(), reader.index["known"].tolist(), strict=True)]]
                    found = [(i, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, ids in reader.documents(chosen)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array([x[0] for x in found], pa.int64()),
                        "start": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array([x[1] for x in found], pa.int64()),
                        "ids_crc32": pa.array([x[2] for x in found], pa.int64()),
                    }
                )

    spark = files.sparkSession
    spread = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col("file"))
    return spread.mapInArrow(read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
