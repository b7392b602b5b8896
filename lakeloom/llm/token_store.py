"""Token ids in fixed-width bit-packed files with block offsets and random access.

A file holds blocks of ``BLOCK_IDS`` ids; each id takes ``width`` bits, the fewest
that hold the largest id of the vocabulary, least significant bit first. A footer
keeps the byte offset of each block, and of each document its id and its first
position, so that a reader fetches the blocks of one document and unpacks them
with numpy. A range shuffle puts documents in ascending ``doc_id`` order over the
files; each task streams one file under a temporary name and renames it, and the
manifest (a small Parquet table, committed when every task has ended) names the files
that count.

Defined cases: a null text is empty, an empty text holds the end id alone, a null
``doc_id`` sorts last, rows with equal ``doc_id`` are all kept, in the order of a
hash of their text; other columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import TEMPORARY, filesystem, map_batches, new_dir, offsets, slices, sweep, texts

MAGIC = b"LOOMIDS1"
BLOCK_IDS = 1 << 16
#: Ids that a task reads at least, where files are small.
READ_IDS = 1 << 22
#: Distinct chunks of text whose ids a Python worker remembers between batches.
CACHE = 600_000
#: Bytes of text that are encoded together, so that each of their distinct chunks is looked up once.
TOGETHER = 8 << 20
#: Chunks whose ids are put together at a time.
JOINED = 1 << 18


def bits_for(largest: int) -> int:
    """The fewest bits that hold ids from 0 to ``largest``."""
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Packs ids into ``width`` bits each, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The ``n`` ids that :func:`pack` has put into ``data``."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Streams documents into one file."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.sink.write(MAGIC)
        self.at, self.n_ids, self.pending, self.n_pending = len(MAGIC), 0, [], 0
        self.blocks, self.doc_ids, self.nulls, self.starts = [self.at], [], [], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= 16 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        full = len(ids) if all_ else len(ids) // BLOCK_IDS * BLOCK_IDS
        for k in range(0, full, BLOCK_IDS):
            data = pack(ids[k : min(k + BLOCK_IDS, full)], self.width)
            self.sink.write(data)
            self.at += len(data)
            self.blocks.append(self.at)
        self.pending, self.n_pending = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        footer = struct.pack("<IIQQQ", self.width, BLOCK_IDS, len(self.doc_ids), self.n_ids, len(self.blocks))
        footer += b"".join(np.asarray(x, kind).tobytes() for x, kind in ((self.blocks, "<u8"), (self.starts, "<u8"), (self.doc_ids, "<i8"), (self.nulls, "u1")))
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class Reader:
    """Random access to the documents of one file (any object with seek and read)."""

    def __init__(self, source):
        self.source = source
        source.seek(0, os.SEEK_END)
        end = source.tell()
        source.seek(end - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<Q", tail[:8])[0]
        source.seek(end - 16 - size)
        footer = source.read(size)
        self.width, self.block_ids, n_docs, self.n_ids, n_blocks = struct.unpack_from("<IIQQQ", footer)
        at = struct.calcsize("<IIQQQ")
        self.blocks = np.frombuffer(footer, "<u8", n_blocks, at)
        self.starts = np.frombuffer(footer, "<u8", n_docs + 1, at + 8 * n_blocks)
        self.doc_ids = np.frombuffer(footer, "<i8", n_docs, at + 8 * (n_blocks + n_docs + 1))
        self.nulls = np.frombuffer(footer, "u1", n_docs, at + 8 * (n_blocks + 2 * n_docs + 1)).astype(bool)
        self._kept = (-1, np.zeros(0, np.uint32))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _block(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            self.source.seek(int(self.blocks[k]))
            data = self.source.read(int(self.blocks[k + 1] - self.blocks[k]))
            self._kept = (k, unpack(data, self.width, min(self.block_ids, self.n_ids - k * self.block_ids)))
        return self._kept[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at positions ``start`` to ``stop`` of the file, reading only their blocks."""
        parts = []
        while start < stop:
            k, low = divmod(start, self.block_ids)
            n = min(stop - start, self.block_ids - low)
            parts.append(self._block(k)[low : low + n])
            start += n
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """Ids of the ``k``-th document of the file."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


_encoders: dict = {}


#: Letters that no normalisation but lower-casing changes, one to one.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: Chunks of these characters alone split into pieces as the tokenizer splits them.
_SIMPLE = f"^[\\x20-\\x26\\x28-\\x7eA-Z\u00c0-\u00d6\u00d8-\u00de{_LETTERS}\\t\\n\\r]*$"
_PIECE = f"([{_LETTERS}]+|[0-9]|[^ 0-9{_LETTERS}]+)"


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    A text is cut into chunks at spaces and line feeds; Arrow finds the distinct
    chunks of a batch, and numpy puts their ids together. The vocabulary's words never
    span white space, a digit or the border between letters and other characters, so a
    chunk's ids are those of its pieces, which recur far more often than texts. Pieces
    seen for the first time are encoded together; the last id of each is one of a word's
    end. Characters with any normalisation beyond lower case, and apostrophes, leave
    their chunk whole. A text that holds one of the tokenizer's added tokens, in any
    case, goes to the library as it is.

    Chunks and their ids are remembered; when they are too many, those that the most batches had stay.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.I)
        self.chunks, self.uses = pa.array([""]), np.array([np.iinfo(np.int64).max // 2])  # the empty chunk stays at place 0
        self.start, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    @staticmethod
    def of(vocabulary: str) -> Encoder:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        return _encoders[vocabulary]

    def _add(self, chunks: pa.Array, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Remembers new chunks with the number of their ids, and all those ids; returns the chunks' places."""
        at = len(self.chunks) + np.arange(len(chunks))
        self.chunks, self.uses = pa.concat_arrays([self.chunks, chunks]), np.concatenate([self.uses, np.ones(len(chunks), np.int64)])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        return at

    def _forget(self) -> None:
        """Keeps half of what may be remembered: the most used."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE // 2])
        ids, _ = self._joined(kept, np.zeros(0, np.int64))
        self.chunks, self.uses, self.size, self.ids = self.chunks.take(pa.array(kept)), self.uses[kept], self.size[kept], ids
        self.start = np.cumsum(self.size) - self.size

    def _joined(self, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks at these places in a line, and how many there are before each of ``ends``."""
        before, parts = np.zeros(len(at) + 1, np.int64), []
        np.cumsum(self.size[at], out=before[1:])
        for k in range(0, len(at), JOINED):
            each, stops = at[k : k + JOINED], before[k : k + JOINED + 1]
            parts.append(self.ids[np.repeat(self.start[each] - stops[:-1], np.diff(stops)) + np.arange(stops[0], stops[-1])])
        return np.concatenate([np.zeros(0, np.uint32), *parts]), before[ends]

    def _found(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places of these distinct chunks, -1 for unknown ones, and which are unknown."""
        at = pc.fill_null(pc.index_in(chunks, value_set=self.chunks), -1).to_numpy().astype(np.int64)
        new = at < 0
        self.uses[at[~new]] += 1
        return at, new

    def _words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all their ids."""
        sizes, all_ = [], []
        for k, e in enumerate(self.tokenizer.encode_batch_fast([" ".join(new[k : k + 1000]) for k in range(0, len(new), 1000)], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(new[1000 * k : 1000 * k + 1000]):
                raise ValueError("this vocabulary doesn't mark the ends of words")
            sizes.append(np.diff(stops, prepend=0))
            all_.append(ids)
        return np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.uint32), *all_])

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """The places of distinct chunks that are not known yet."""
        out = np.zeros(len(chunks), np.int64)
        simple = pc.match_substring_regex(chunks, _SIMPLE)
        mine = chunks.filter(simple)
        spaced = pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(mine), "[\\t\\r]", " "), _PIECE, "\\1 ")
        pieces = pc.split_pattern(spaced, " ")
        each = pieces.flatten().dictionary_encode()
        at, new = self._found(each.dictionary)
        unknown = each.dictionary.filter(pa.array(new))
        at[new] = self._add(unknown, *self._words(unknown.to_pylist()))
        at, bounds = at[each.indices.to_numpy()], pieces.offsets.to_numpy()
        own = pc.equal(pc.binary_join_element_wise(mine, "", " "), spaced).to_numpy(zero_copy_only=False)  # pieces themselves
        ids, before = self._joined(at, bounds)
        size, places = np.diff(before), at[bounds[:-1]]
        places[~own] = self._add(mine.filter(pa.array(~own)), size[~own], ids[np.repeat(~own, size)])
        simple = simple.to_numpy(zero_copy_only=False)
        out[simple] = places
        if not simple.all():
            whole = chunks.filter(pa.array(~simple))
            ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(whole.to_pylist(), add_special_tokens=False)]
            out[~simple] = self._add(whole, np.array([len(x) for x in ids], np.int64), np.concatenate(ids))
        return out

    def encode(self, batch: list[str], end_id: int) -> list[np.ndarray]:
        """The ids of each text, and the end id."""
        if len(self.chunks) > CACHE:
            self._forget()
        marked = [k for k, t in enumerate(batch) if self.special.search(t)]
        plain = list(batch)
        for k in marked:
            plain[k] = ""
        split = pc.split_pattern(pc.replace_substring(pa.array(plain, pa.string()), "\n", " "), " ")
        distinct = split.flatten().dictionary_encode()
        at, new = self._found(distinct.dictionary)
        if new.any():
            at[new] = self._learn(distinct.dictionary.filter(pa.array(new)))
        ids, before = self._joined(at[distinct.indices.to_numpy()], split.offsets.to_numpy()[1:])
        out = np.split(np.insert(ids, before, end_id), before[:-1] + np.arange(1, len(before)))
        for k in marked:
            out[k] = np.array([*self.tokenizer.encode(batch[k], add_special_tokens=False).ids, end_id], np.uint32)
        return out


def together(batches: Iterator[pa.RecordBatch], column: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in batches of about ``most`` bytes in ``column``, one row at least."""
    held, size = [], 0
    for batch in batches:
        for piece in slices(batch, column, most):
            n = pc.sum(pc.binary_length(piece.column(column))).as_py() or 0
            if held and size + n > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(piece)
            size += n
    if held:
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes ``docs`` and writes them to ``path`` in ascending ``doc_id`` order.

    Returns the committed manifest: file_no, name, n_docs, n_ids.
    ``vocabulary`` is a tokenizer file that every executor can open.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, n = Encoder.of(vocabulary), None, 0
        fs, root = filesystem(path)
        width = bits_for(encoder.tokenizer.get_vocab_size() - 1)
        temporary = f"{root}/{TEMPORARY}{uuid.uuid4().hex}"
        for batch in together(batches, "text"):
            if writer is None:
                fs.create_dir(root)
                sink = fs.open_output_stream(temporary)
                writer = Writer(sink, width)
            for i, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts(batch.column("text")), end_id)):
                writer.add(i, ids)
                n += 1
        if writer is not None:
            writer.close()
            sink.close()
            file_no = TaskContext.get().partitionId()
            name = f"part-{file_no:08d}.ids"
            fs.move(temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"file_no": file_no, "name": name, "n_docs": n, "n_ids": writer.n_ids}], schema=pa.schema([("file_no", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("row").asc()]  # equal rows may part, too
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    manifest = map_batches(rows.repartitionByRange(*order).sortWithinPartitions(*order), write, "file_no int, name string, n_docs long, n_ids long")
    files = manifest.collect()  # a row for each file
    docs.sparkSession.createDataFrame(files, manifest.schema).coalesce(1).write.parquet(f"{path}/_manifest")
    sweep(path)
    return docs.sparkSession.read.parquet(f"{path}/_manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Reads the files of :func:`write_tokens` back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it over all files;
    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("__before").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as source:
                    file = Reader(source)
                    for k in range(0, len(file), 4096):
                        to = min(k + 4096, len(file))
                        sums = [zlib.crc32(file.document(d).astype("<u4").tobytes()) for d in range(k, to)]
                        starts = file.starts[k : to + 1].astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(file.doc_ids[k:to], pa.int64(), mask=file.nulls[k:to]), pa.array(starts[:-1] + before), pa.array(np.diff(starts)), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    manifest = spark.read.parquet(f"{path}/_manifest")
    files = manifest.join(F.broadcast(offsets(manifest, "file_no", "n_ids")), "file_no").select("name", "__before")
    size = manifest.agg(F.count("*").alias("files"), F.sum("n_ids").alias("ids")).first()
    tasks = min(size["files"], max(spark.sparkContext.defaultParallelism, (size["ids"] or 0) // READ_IDS))
    return map_batches(files.repartition(max(1, tasks)), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` into a new store in the shared folder and reads it back."""
    path = new_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path)
