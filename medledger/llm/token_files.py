"""Token-id files of independent zstandard frames with a trailing seek table.

``write`` encodes whole texts with a ``tokenizers`` file, puts the end id behind each document and writes
one file per range of document ids, so that files and documents ascend. In a file every document has its
own frame (a long one several), so a reader decompresses only what it asks for:

* frames of little-endian ids (2 bytes each if the vocabulary allows, else 4), each with zstandard's own
  checksum;
* a skippable frame with the documents' ids, token counts and frame counts;
* a skippable frame with the seek table of the zstandard seekable format: compressed size, decompressed
  size and checksum (low 32 bits of XXH64) of every frame, then its footer.

Any zstandard reader can also read a file whole; ``read`` and ``fetch`` check both checksums. Files go to a
folder that all executors share (``spark.checkpoint.dir`` unless another is given), through Arrow's file
systems, under a name of their own first and then moved into place, so a task that runs again after a lost
executor leaves one whole file. The manifest has one row per file and is all that the driver holds.

Encoding cuts texts into pieces and encodes each distinct piece once with the tokenizers library (see
``bpe``); the library's whole-text result is the same, as tests show, for byte-level BPE files without a
normalizer (others are refused). A text that holds the string of a special token is given whole to the
library, which makes that token of it, or with ``special_as_text`` is text like any other.

Defined cases: a null text is an empty text and has the end id alone; documents with a null id come first;
equal ids keep all their rows, in the order of the table's rows; an empty table gives no files and an empty
result. Only the two named columns are read; ids are integers. A folder that is not named is removed with the scope
of ``session.intermediate_tables`` that it is written in, if there is one.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medledger.llm.bpe import Codec, class_table, every_code_point, gather
from medledger.llm.text import blocks, ship_package
from medledger.session import scratch_folder

BLOCK_BYTES = 1 << 21
#: Ids per frame at most; a longer document has several frames.
FRAME_IDS = 1 << 20
LEVEL = 3
END_ID = 0

# Fixed values of the zstandard seekable format.
SKIPPABLE, SKIPPABLE_INDEX = 0x184D2A5E, 0x184D2A5D
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80


@dataclass
class Shard:
    """A file of the manifest: the ids of its first and last document, and what stands in it."""

    path: str
    first: int | None
    last: int | None
    docs: int
    tokens: int
    start: int = 0


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a folder URI as Spark writes it (``file:/x`` too), and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


class Writer:
    """Writes documents' ids to an open binary stream."""

    def __init__(self, stream, wide: bool):
        self.stream, self.kind = stream, "<u4" if wide else "<u2"
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int, int]] = []  # id, null, tokens, frames

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        count = 0
        for at in range(0, len(ids), FRAME_IDS):
            raw = ids[at : at + FRAME_IDS].astype(self.kind).tobytes()
            frame = self.zstd.compress(raw)
            self.stream.write(frame)
            self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            count += 1
        self.docs.append((doc_id or 0, doc_id is None, len(ids), count))

    def close(self) -> None:
        columns = list(zip(*self.docs, strict=True)) or [(), (), (), ()]
        index = struct.pack("<QB", len(self.docs), 4 if self.kind == "<u4" else 2) + b"".join(
            np.array(c, k).tobytes() for c, k in zip(columns, ("<i8", "u1", "<u8", "<u4"), strict=True))
        index += struct.pack("<Q", len(index))
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Random access to the documents of a file."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table = end - 9 - 12 * frames
        self.frames = np.frombuffer(self._at(table, 12 * frames), "<u4").reshape(frames, 3)
        self.place = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        index_end = table - 8
        size = struct.unpack("<Q", self._at(index_end - 8, 8))[0]
        raw = self._at(index_end - 8 - size, size)
        docs, width = struct.unpack_from("<QB", raw)
        at = 9
        columns = []
        for kind in ("<i8", "u1", "<u8", "<u4"):
            columns.append(np.frombuffer(raw, kind, docs, at))
            at += docs * np.dtype(kind).itemsize
        self.ids, null, self.tokens, parts = columns
        self.null = null.astype(bool)
        self.kind = f"<u{width}"
        self.first = np.concatenate([[0], np.cumsum(parts, dtype=np.int64)])
        self.start = np.concatenate([[0], np.cumsum(self.tokens, dtype=np.int64)])
        self.zstd = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def document(self, nth: int) -> np.ndarray:
        """The token ids of the file's nth document; decompresses its frames only."""
        out = []
        for k in range(self.first[nth], self.first[nth + 1]):
            size, length, check = map(int, self.frames[k])
            raw = self.zstd.decompress(self._at(int(self.place[k]), size), max_output_size=length)
            if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} does not match its checksum")
            out.append(np.frombuffer(raw, self.kind))
        return np.concatenate(out) if out else np.zeros(0, self.kind)


def library_classes() -> np.ndarray:
    """Code-point classes as the tokenizers library's patterns know them."""
    from tokenizers import Regex, normalizers

    text = every_code_point()
    rest = lambda pattern: normalizers.Replace(Regex(pattern), "").normalize_str(text)
    return class_table(*(rest(p) for p in (r"\P{L}", r"\P{N}", r"\S")))


def _byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class LibraryCodec:
    """A broadcast of a tokenizers file from which each Python worker makes its codec once.

    With ``special_as_text`` the strings of special tokens are ordinary text; otherwise a text that holds one is
    given whole to the library, which finds them itself.
    """

    _made: dict[str, Codec] = {}

    def __init__(self, spark: SparkSession, path: str, special_as_text: bool = False):
        with open(path, encoding="utf-8") as f:
            said = f.read()
        told = json.loads(said)
        cutter = told["pre_tokenizer"] or {}
        if told["normalizer"] or told["model"]["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError("only byte-level BPE files without a normalizer and with the usual pattern are cut as the library does")
        self.key = hashlib.sha256(f"{special_as_text}{said}".encode()).hexdigest()
        self.wide = self._vocabulary(said)[1] > 1 << 16
        self.held = spark.sparkContext.broadcast((library_classes().tobytes(), said, special_as_text))

    @staticmethod
    def _vocabulary(said: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(said)
        return tokenizer, max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1

    def get(self) -> Codec:
        if self.key not in self._made:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            classes, said, special_as_text = self.held.value
            tokenizer, size = self._vocabulary(said)
            alphabet = _byte_alphabet()
            added = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}
            tokens = [b""] * size
            for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
                tokens[i] = token.encode() if i in added.values() else bytes(alphabet[c] for c in token)
            for content, i in added.items():
                tokens[i] = content
            plain = self._vocabulary(said)[0]
            plain.encode_special_tokens = True
            self._made[self.key] = Codec(
                np.frombuffer(classes, np.uint8), tokens, PieceEncoder(plain, np.array([len(t) for t in tokens], np.int64)),
                () if special_as_text else tuple(added), lambda text: tokenizer.encode(text, add_special_tokens=False).ids)
        return self._made[self.key]


class PieceEncoder:
    """The library's ids of some pieces, one after the other, and how many each has.

    Pieces of one space and signs behind it are given to the library in long strings, which it cuts before
    the spaces again; token sizes tell where each piece ends. Should one not end there, and for all other pieces,
    the library gets them one by one.
    """

    STRING = 4096

    def __init__(self, tokenizer, size: np.ndarray):
        self.tokenizer, self.size = tokenizer, size

    def __call__(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = [i for i, p in enumerate(raw) if p[0] == 32 and len(p) > 1 and (32 < p[1] < 128 or p[1] > 127 and not p.decode()[1].isspace())]
        runs = [joined[a : a + self.STRING] for a in range(0, len(joined), self.STRING)]
        parts, counts, order = [], [], []
        for run, found in zip(runs, self._encode([b"".join([raw[i] for i in run]) for run in runs]), strict=True):
            upto, ends = np.cumsum(self.size[found]), np.cumsum([len(raw[i]) for i in run])
            last = np.minimum(np.searchsorted(upto, ends), len(upto) - 1)
            if len(found) and np.array_equal(upto[last], ends):
                parts.append(found)
                counts.append(np.diff(last, prepend=-1))
                order += run
        done = np.zeros(len(raw), bool)
        done[order] = True
        rest = np.flatnonzero(~done).tolist()
        alone = self._encode([raw[i] for i in rest])
        parts += alone
        counts.append(np.array([len(x) for x in alone], np.int64))
        order += rest
        flat, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, counts))
        place = np.argsort(np.array(order, np.int64), kind="stable")
        begin = np.cumsum(count) - count
        return gather(flat.astype(np.uint32), begin[place], count[place].astype(np.int32)), count[place].astype(np.int32)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text",
          end_id: int = END_ID, special_as_text: bool = False) -> list[Shard]:
    """Write the documents and return the manifest, in ascending order (``start``: ids in the files before)."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or scratch_folder(spark, "medledger-tokens")
    codec = LibraryCodec(spark, tokenizer, special_as_text)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Rows of one id are told apart by their places, so that a hot id, or copies of a row, can be in many files.
    slim = slim.withColumn("row", F.monotonically_increasing_id())
    ranged = slim.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        context = TaskContext.get()
        final = f"{root}/{context.partitionId():08d}.ids.zst"
        own = f"{final}.{context.taskAttemptId()}.{uuid.uuid4().hex}"
        with files.open_output_stream(own) as stream:
            writer = Writer(stream, codec.wide)
            for block in blocks(_chain(first, batches), 1, BLOCK_BYTES):
                ids, cut, _, _ = codec.get().encode(block.column(1))
                for k, name in enumerate(block.column(0).to_pylist()):
                    writer.add(name, np.append(ids[cut[k] : cut[k + 1]], end_id))
            writer.close()
        if files.get_file_info(final).type == pa.fs.FileType.NotFound:
            files.move(own, final)
        else:
            files.delete_file(own)  # an attempt before this one has finished the same file
        name = lambda d: None if d[1] else d[0]
        yield pa.RecordBatch.from_pylist([{
            "part": context.partitionId(), "path": f"{folder}/{final.rpartition('/')[2]}", "first": name(writer.docs[0]), "last": name(writer.docs[-1]),
            "docs": len(writer.docs), "tokens": sum(d[2] for d in writer.docs)}], schema=_MANIFEST)

    rows = ranged.mapInArrow(run, "part int, path string, first long, last long, docs long, tokens long").collect()
    shards, start = [], 0
    for r in sorted(rows, key=lambda r: r["part"]):
        shards.append(Shard(r["path"], r["first"], r["last"], r["docs"], r["tokens"], start))
        start += r["tokens"]
    return shards


_MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                       ("docs", pa.int64()), ("tokens", pa.int64())])
READ_TYPE = "doc_id long, start long, n_tokens long, ids binary"


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _rows(shard: Shard, picked) -> Iterator[pa.RecordBatch]:
    """Documents of a file as record batches of a few megabytes; ``picked`` gives their places from a reader."""
    files, path = file_system(shard.path)
    with files.open_input_file(path) as file:
        reader = Reader(file)
        held: list[tuple] = []
        size = 0
        for k in picked(reader):
            raw = reader.document(k).astype("<u4").tobytes()
            held.append((None if reader.null[k] else int(reader.ids[k]), shard.start + int(reader.start[k]), len(raw) // 4, raw))
            size += len(raw)
            if size > BLOCK_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])


def read(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """All documents of the files: doc_id, start (ids of all documents before), n_tokens, ids (4-byte little-endian)."""
    ship_package(spark)
    held = spark.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth in batch.column(0).to_pylist():
                yield from _rows(held.value[nth], lambda reader: range(len(reader.ids)))

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, READ_TYPE)


def fetch(wanted: DataFrame, shards: list[Shard], doc_id: str = "doc_id") -> DataFrame:
    """The documents whose id is in ``wanted`` (as ``read`` returns them); opens only files that may hold them."""
    spark = wanted.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.unique(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            for shard in held.value:
                # A file that begins with null ids may hold any id up to its last.
                low = -(2**63) if shard.first is None else shard.first
                if shard.last is None or not ((ids >= low) & (ids <= shard.last)).any():
                    continue
                yield from _rows(shard, lambda reader: np.flatnonzero(np.isin(reader.ids, ids) & ~reader.null))

    asked = wanted.select(F.col(doc_id).cast("long").alias("doc_id")).dropna().distinct()
    return asked.repartitionByRange("doc_id").mapInArrow(run, READ_TYPE)
