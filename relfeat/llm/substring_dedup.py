"""Passages that repeat are removed: every window of k words that starts anywhere else too.

Every window's Rabin-Karp hash goes to the task that owns its range of the hash space; there occurrences are counted over
the whole corpus, and the windows that repeat are named back to the documents. Overlapping windows merge into maximal
intervals. Hashes travel as sorted blocks, a block for each range and chunk of documents; a hash that repeats within its
chunk is sent once, so a very common passage costs one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relfeat.llm.common import WordIds, by_key, fragments_for, from_nullable, nullable, partitions, planes, rabin_karp, range_of, runs, slices, text_bytes, unplanes, window_starts

_BLOCK = pa.schema([("fragment", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary()), ("repeated", pa.binary()), ("documents", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("places", pa.binary()), ("documents", pa.binary())])


def _blocks(k: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part = WordIds(), TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text", 3 << 20)):
            # A task that is run again reads the same rows in the same order, so a chunk keeps its number.
            chunk = (part << 32) + number
            words = [t.split() for t in batch.column("text").to_pylist()]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            hashed = ids.array([w for ws in words for w in ws])
            starts, _ = window_starts(counts, k)
            hashes = rabin_karp(hashed, starts, k)
            order = np.argsort(hashes)
            hashes, starts = hashes[order], starts[order].astype(np.uint32)
            first, size = runs(hashes)
            once = first[size == 1]
            often = np.repeat(size > 1, size)
            local = starts[often]
            single, places, repeated = hashes[once], starts[once], hashes[first[size > 1]]
            edges = np.arange(fragments + 1)
            cut_a, cut_b = np.searchsorted(range_of(single, fragments), edges), np.searchsorted(range_of(repeated, fragments), edges)
            about = b"".join([np.int64(len(words)).tobytes(), nullable(batch.column("doc_id").to_pylist()), batch.column("row").to_numpy().astype("<i8").tobytes(), counts.astype("<i8").tobytes(), local.tobytes()])
            out = [{"fragment": int(chunk % fragments), "chunk": chunk, "documents": about}]
            for f in range(fragments):
                a, b, c, d = cut_a[f], cut_a[f + 1], cut_b[f], cut_b[f + 1]
                if a < b or c < d:
                    out.append({"fragment": f, "chunk": chunk, "hashes": planes(single[a:b]), "places": planes(places[a:b]), "repeated": planes(repeated[c:d])})
            yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one hash range: which chunks' windows occur more than once anywhere."""
    for _, rows in by_key(batches, "fragment"):
        out = [{"chunk": r["chunk"], "documents": r["documents"]} for r in rows if r["documents"] is not None]
        rows = [r for r in rows if r["documents"] is None]
        single = [unplanes(r["hashes"], np.uint64) for r in rows]
        known = np.concatenate([*(unplanes(r["repeated"], np.uint64) for r in rows), np.zeros(0, np.uint64)])
        everything = np.sort(np.concatenate([*single, known, known]))  # twice: what repeats in one chunk repeats
        first, size = runs(everything)
        twice = everything[first[size > 1]]
        for r, hashes in zip(rows, single, strict=True):
            at = np.searchsorted(twice, hashes)
            hit = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == hashes) if len(twice) else np.zeros(0, np.int64)
            if len(hit):
                out.append({"chunk": r["chunk"], "places": np.sort(unplanes(r["places"], np.uint32)[hit]).tobytes()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_REPLY)


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "chunk"):
            about = next(r["documents"] for r in rows if r["documents"] is not None)
            n = int(np.frombuffer(about, "<i8", 1)[0])
            doc_ids = from_nullable(about[8 : 8 + 9 * n])
            row_ids, counts = np.frombuffer(about, "<i8", 2 * n, 8 + 9 * n).reshape(2, n)
            places = np.concatenate([np.frombuffer(about, np.uint32, -1, 8 + 25 * n), *(np.frombuffer(r["places"], np.uint32) for r in rows if r["places"])]).astype(np.int64)
            ends = np.cumsum(counts)
            step = np.zeros(int(counts.sum()) + 1, np.int32)
            step[places] += 1  # a window starts at a place once
            step[places + k] -= 1
            covered = np.cumsum(step[:-1]) > 0
            out: dict[str, list] = {"doc_id": [], "row": [], "spans": []}
            for i in np.unique(np.searchsorted(ends, places, "right")):
                own = covered[ends[i] - counts[i] : ends[i]]
                out["doc_id"].append(doc_ids[i])
                out["row"].append(int(row_ids[i]))
                out["spans"].append(np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("spans", pa.list_(pa.int64()))]))

    return run


def repeated_spans(docs: DataFrame, spark: SparkSession, k: int = 35) -> DataFrame:
    """doc_id, row (the text's hash) and spans of the documents with repeated windows.

    spans lists word positions in turns: where a removal interval starts, and where it ends (not included). Intervals are
    maximal and ascending. Documents (rows) that share both doc_id and text have one row here; each still counts as a place
    where its windows start. Null texts have no words; texts of fewer than k words have no window.
    """
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), text_bytes())
    fragments = fragments_for(base, spark)
    # In an order of the rows' own, so that a task that is run again cuts the same chunks.
    blocks = base.sortWithinPartitions("doc_id", "row").mapInArrow(_blocks(k, fragments), "fragment int, chunk long, hashes binary, places binary, repeated binary, documents binary")
    replies = blocks.repartitionById(fragments, F.col("fragment")).sortWithinPartitions("fragment", "chunk").mapInArrow(_count, "chunk long, places binary, documents binary")
    spans = replies.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(_merge(k), "doc_id long, row long, spans array<long>")
    return spans.groupBy("doc_id", "row").agg(F.first("spans").alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            n_words.append(len(words))
            edges = [0, *(spans or []), len(words)]
            left = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column("spans")], ["doc_id", "n_words", "n_removed", "kept_text", "spans"])


def remove_repeats(docs: DataFrame, spark: SparkSession, k: int = 35) -> DataFrame:
    """Every row of docs: doc_id, n_words, n_removed, kept_text (the words left, joined by one space) and spans.

    All words of windows of k words that start anywhere else go, first occurrences too; windows are judged on the input. Null or
    empty texts have no words and an empty kept_text. Two rows of one doc_id are two documents. Other columns are not
    carried; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, spark, k).select(F.col("doc_id").alias("s_doc"), F.col("row").alias("s_row"), "spans")
    left = docs.select("doc_id", text_bytes(), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    both = left.join(spans.hint("shuffle_hash"), left["doc_id"].eqNullSafe(spans["s_doc"]) & (left["row"] == spans["s_row"]), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string, spans array<long>")


def op8_substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, spark).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
