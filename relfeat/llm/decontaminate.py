"""Passages of benchmark items inside documents, found by winnowing.

Of every w successive k-grams the least hash is kept, so that any shared span of w + k - 1 words shares a kept gram in the
same place. Kept grams of documents and items meet in a join; each meeting names a diagonal (a shift between document and
item), which is extended to maximal equal runs, word by word. With w + k - 1 = the window's length, every shared window
is found. Items shorter than a window are looked up whole, by their own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relfeat.llm.common import WordIds, materialize, mix64, rabin_karp, slices, text_bytes, window_starts

#: A-Z become a-z; what is no digit, letter or byte of a code point beyond ASCII becomes a space. As bytes.split then
#: parts at spaces, the words are those of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct kept grams of all items up to which the documents' side is filtered by a broadcast set (8 bytes each).
BROADCAST_GRAMS = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def winnow(hashes: np.ndarray, w: int, starts: np.ndarray) -> np.ndarray:
    """The place of the least hash among the w from each start, the last of equals; places that follow one another once."""
    if not len(starts):
        return np.zeros(0, np.int64)
    # The least of a power of two of hashes comes from two halves; two such ranges that overlap make any w.
    best, span = np.arange(len(hashes)), 1
    while span * 2 <= w:
        left, right = best[:-span], best[span:]
        best = np.where(hashes[left] < hashes[right], left, right)
        span *= 2
    left, right = best[starts], best[starts + w - span]
    best = np.where(hashes[left] < hashes[right], left, right)
    return best[np.concatenate(([True], best[1:] != best[:-1]))]


def _grams(key: str, window: int, k: int, short: list[int], whole: bool, known):
    """Rows (key, row, gram, place) of texts' kept grams. Texts of `short` lengths give themselves whole if `whole`, else every
    window of those lengths. known: a broadcast array; grams that it has not are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, w = WordIds(), window - k + 1
        for batch in slices(batches, "text"):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            hashed = ids.array([x for ws in words for x in ws])
            firsts = np.cumsum(counts) - counts
            starts, owner = window_starts(counts, k)
            gram = rabin_karp(hashed, starts, k)
            inside, _ = window_starts(np.bincount(owner, minlength=len(counts)), w)
            kept = winnow(gram, w, inside)
            found = [(owner[kept], gram[kept], starts[kept])]
            for m in short:
                starts, owner = window_starts(counts, m)
                if whole:
                    own = counts[owner] == m
                    starts, owner = starts[own], owner[own]
                # Lengths differ by a salt, so a gram of one never meets one of another.
                found.append((owner, mix64(rabin_karp(hashed, starts, m) + np.uint64(m)), starts))
            owner, gram, place = (np.concatenate(x) for x in zip(*found, strict=True))
            if known is not None:
                at = np.minimum(np.searchsorted(known.value, gram), max(len(known.value) - 1, 0))
                met = np.flatnonzero(known.value[at] == gram) if len(known.value) else np.zeros(0, np.int64)
                owner, gram, place = owner[met], gram[met], place[met]
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(take), batch.column("row").take(take), pa.array(gram.view(np.int64)), pa.array(place - firsts[owner])], [key, "row", "gram", "place"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t)) for t in batch.column("text").to_pylist()], pa.int64())], ["n"])


def _extend(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_hit, items, spans = [], [], [], []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                words = words_of(text)
                hit, found = np.zeros(len(words) + 1, np.int8), set()
                for h, item, shift in ((h, item, shift) for h in hits or () for item in [words_of(h["item_text"])] for shift in h["shifts"]):
                    need = min(window, len(item))
                    lo, hi = max(0, shift), min(len(words), shift + len(item))
                    same = np.fromiter((x == y for x, y in zip(words[lo:hi], item[lo - shift : hi - shift], strict=True)), np.int8, max(0, hi - lo))
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], same, [0])))).reshape(-1, 2)
                    for a, b in edges[edges[:, 1] - edges[:, 0] >= need].tolist():
                        hit[lo + a : lo + b] = 1
                        found.add(h["item_id"])
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                items.append(sorted(x for x in found if x is not None))
                spans.append(np.flatnonzero(np.diff(np.concatenate(([0], hit)))).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "row", "n_words", "n_hit", "items", "spans"])

    return run


def _keyed(frame: DataFrame, key: str) -> DataFrame:
    return frame.select(key, text_bytes(), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))


def benchmark_hits(docs: DataFrame, items: DataFrame, spark: SparkSession, window: int = 13, k: int = 5) -> DataFrame:
    """Every row of docs: doc_id, row (the text's hash), n_words, n_hit, items (ascending item_ids) and spans of hit words.

    Words: A-Z lower-cased, runs of digits, letters and code points beyond ASCII. A window is `window` successive words of an
    item, or a shorter item's whole words; an item without words has none. A document's word is hit if an occurrence of
    a window covers it. spans lists word positions in turns: start of a hit run, its end (not included).

    Null texts have no words. Two rows of one doc_id are judged each by its own text, two items of one item_id are one item
    with both texts; items without an item_id mark words and aren't listed. Other columns are not carried. Empty tables:
    no documents, no rows; no items, no hits.
    """
    bench = _keyed(items, "item_id").distinct()
    # One row for each length under the window's: at most `window` rows.
    short = sorted(r[0] for r in bench.mapInArrow(_lengths, "n long").where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect())
    schema = "{} long, row long, gram long, place long"
    asked = materialize(bench.mapInArrow(_grams("item_id", window, k, short, True, None), schema.format("item_id")), spark)
    grams = asked.select("gram").distinct()
    known = None
    if len(head := grams.limit(BROADCAST_GRAMS + 1).toPandas()) <= BROADCAST_GRAMS:  # else the join alone finds what meets
        known = spark.sparkContext.broadcast(np.sort(head["gram"].to_numpy(np.int64).view(np.uint64)))
    base = _keyed(docs, "doc_id")
    kept = base.mapInArrow(_grams("doc_id", window, k, short, False, known), schema.format("doc_id"))
    items_side = asked.select("gram", "item_id", F.col("row").alias("item_row"), F.col("place").alias("item_place"))
    met = kept.join(items_side, "gram").select("doc_id", "row", "item_id", "item_row", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    # An item's text goes along once a document, however many shifts it is met at.
    met = met.groupBy(F.col("doc_id").alias("h_doc"), F.col("row").alias("h_row"), "item_id", "item_row").agg(F.collect_list("shift").alias("shifts"))
    named = bench.select(F.col("item_id").alias("b_item"), F.col("row").alias("b_row"), F.col("text").alias("item_text"))
    met = met.join(named, met["item_id"].eqNullSafe(named["b_item"]) & (met["item_row"] == named["b_row"]))
    hits = met.groupBy("h_doc", "h_row").agg(F.collect_list(F.struct("item_id", "item_text", "shifts")).alias("hits"))
    both = base.join(hits.hint("shuffle_hash"), base["doc_id"].eqNullSafe(hits["h_doc"]) & (base["row"] == hits["h_row"]), "left")
    return both.select("doc_id", "row", "text", "hits").mapInArrow(_extend(window), "doc_id long, row long, n_words long, n_hit long, items array<long>, spans array<long>")


def contaminated() -> Column:
    """Whether a row of benchmark_hits is contaminated: a twentieth of its words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op10_decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return benchmark_hits(docs, items, spark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), contaminated().alias("contaminated"))
