"""Token ids in directly addressable files.

A shard file holds the ids of consecutive documents in chunk levels. Level 0 has the low 8 bits of every id and a bitmap
that says which ids go on; level 1 has the next 8 bits of those, and so forth. A rank directory over each bitmap gives the
place in the next level, so that any id is read on its own without decoding others.

File, little-endian: b"RFTOK1\\0\\0"; documents, tokens, levels as int64; doc_ids int64[documents] and null flags
uint8[documents]; starts int64[documents + 1] within the shard; then for each level: n int64, chunks uint8[n], bitmap
uint8[ceil(n / 8)] (low bit first), rank directory int64[n // 512 + 1] of set bits before each 512 ids.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relfeat.llm.common import SLICE_BYTES, materialize, partitions, slices, text_bytes, work_dir

MAGIC = b"RFTOK1\0\0"
#: Ids whose set bits one entry of a rank directory skips.
RANK_STEP = 512
#: Tokens in one shard file, about.
SHARD_TOKENS = 4_000_000
#: Entries of the memo of encoded words before it is emptied.
WORDS_KEPT = 300_000


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file's bytes. No documents, or documents without ids, are allowed."""
    parts, rest = [], ids
    while True:
        more = rest > 0xFF
        whole = len(rest) // RANK_STEP
        ranks = np.concatenate(([0], np.cumsum(more[: whole * RANK_STEP].reshape(whole, RANK_STEP).sum(1, dtype=np.int64))))
        parts += [np.int64(len(rest)).tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), ranks.astype("<i8").tobytes()]
        if not more.any():
            break
        rest = rest[more] >> 8
    head = [MAGIC, np.array([len(doc_ids), len(ids), len(parts) // 4], "<i8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes()]
    return b"".join([*head, np.concatenate(([0], np.cumsum(counts))).astype("<i8").tobytes(), *parts])


class Shard:
    """A shard file opened for reading."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, n_levels = np.frombuffer(data, "<i8", 3, 8).tolist()
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if gone else d for d, gone in zip(ids.tolist(), nulls, strict=True)]
        self.starts = take("<i8", n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<i8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<i8", n // RANK_STEP + 1)))

    def __getitem__(self, i: int) -> int:
        """The id at place i, from one chunk, one bit and one rank of each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << 8 * level
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_STEP * RANK_STEP
            between = np.unpackbits(bits[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first]
            i = int(ranks[i // RANK_STEP]) + int(between.sum())
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range: the range's part of each level is contiguous."""
        out, where = np.zeros(stop - start, "<u4"), None
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            part = chunks[start:stop].astype("<u4") << 8 * level
            if where is None:
                out |= part
            else:
                out[where] |= part
            first = start // RANK_STEP * RANK_STEP
            flags = np.unpackbits(bits[first >> 3 : (stop + 7) >> 3], bitorder="little")[: stop - first].astype(bool)
            before, flags = int(flags[: start - first].sum()), flags[start - first :]
            start = int(ranks[first // RANK_STEP]) + before
            stop = start + int(flags.sum())
            where = np.flatnonzero(flags) if where is None else where[flags]
            if start == stop:
                break
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


#: Words of Latin-1 letters with closing marks: their pieces are known without the library's normalizer and splitter.
_CLOSING = ".,;:!?"
_CLOSING_BYTES = _CLOSING.encode()
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return dict(zip((b for b in range(256) if b not in own), range(256, 512), strict=False))


class WordEncoder(dict):
    """Ids of white-space separated words, as bytes of little-endian uint32.

    The tokenizer turns white space into word bounds before anything else and none of its pieces crosses one, so a text's
    ids are its words' ids in turn; each word is encoded by the library once and then remembered. bytes.split parts at six
    ASCII characters only; other white space stays inside a word and is left to the library.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.library = tokenizer(path)
        self.model = self.library.model
        self.pieces: dict[bytes, bytes] = {}
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        value = self[word] = self.spell(word)
        return value

    def spell(self, word: bytes) -> bytes:
        """The word's ids, not remembered."""
        core = word.rstrip(_CLOSING_BYTES)
        if core.isalpha():  # ASCII letters only
            value = self.piece(core.lower())
        elif core and _LETTERS.fullmatch(text := core.decode()):
            value = self.piece(text.lower().encode())
        else:
            core, value = word, self.whole(word.decode())
        if len(core) < len(word):
            value += self.piece(word[len(core) :])
        return value

    def piece(self, text: bytes) -> bytes:
        if (value := self.pieces.get(text)) is None:
            spelled = text.decode("latin-1")
            if not text.isalnum():
                spelled = spelled.translate(self.letters)
            value = self.pieces[text] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return value

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = [b"".join(map(self.__getitem__, t.split())) for t in texts]
        if len(self) > WORDS_KEPT:
            self.clear()
        if len(self.pieces) > WORDS_KEPT:
            self.pieces.clear()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One a process, so that the next task of a reused worker finds the words known."""
    return WordEncoder(path)


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, spark: SparkSession, folder: str, path: str, end_id: int = 2) -> DataFrame:
    """Write docs (doc_id, text) as shard files in ascending doc_id order (null first); return the manifest.

    The manifest has one row a file: file, first_doc, place (partition and number within), n_docs, n_tokens, start (ids in all
    files before it). Each file has a name of its own and the manifest lists those of finished tasks only, so a task
    that is run again leaves at most an unlisted file. Null text is an empty one: its document holds end_id alone. Rows
    that share a doc_id follow one another, ordered by their text's hash. An empty table gives no files.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fs_root = encoder(path), filesystem(folder)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        blobs: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, blobs, held, number
            counts = np.array([len(b) // 4 for b in blobs], np.int64)
            name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex[:12]}.tok"
            fs_root[0].create_dir(fs_root[1], recursive=True)
            with fs_root[0].open_output_stream(f"{fs_root[1]}/{name}") as f:
                f.write(pack(doc_ids, counts, np.frombuffer(b"".join(blobs), "<u4")))
            row = pa.RecordBatch.from_pylist([{"file": name, "part": part, "number": number, "n_docs": len(doc_ids), "n_tokens": int(counts.sum())}], schema=MANIFEST)
            doc_ids, blobs, held, number = [], [], 0, number + 1
            return row

        for batch in slices(batches, "text", SLICE_BYTES):
            for d, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist()), strict=True):
                doc_ids.append(d)
                blobs.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= SHARD_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select("doc_id", text_bytes())
    rows = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    files = materialize(rows.mapInArrow(run, "file string, part int, number int, n_docs long, n_tokens long"), spark)
    # One row a file: a file is tens of MB, so this order is over few rows.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


MANIFEST = pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_tokens(manifest: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs_root = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs_root[0].open_input_file(f"{fs_root[1]}/{name}") as f:
                    shard = Shard(f.read())
                at = shard.starts
                for lo in range(0, len(shard.doc_ids), 256):
                    hi = min(lo + 256, len(shard.doc_ids))
                    ids = shard.ids(int(at[lo]), int(at[hi])).tobytes()
                    blobs = [ids[4 * (at[i] - at[lo]) : 4 * (at[i + 1] - at[lo])] for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[lo:hi], pa.int64()), pa.array(at[lo:hi] + start), pa.array(np.diff(at[lo : hi + 1])), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return manifest.select("file", "start").repartition(partitions(spark), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op7_token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = work_dir(spark)
    manifest = materialize(write_tokens(docs, spark, folder, public_tokenizers.path("word_bpe_49k.json")), spark)
    return read_tokens(manifest, spark, folder).drop("ids")
