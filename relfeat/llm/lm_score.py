"""Texts scored by a causal self-attention model over subword ids and by counts of words, all of the whole corpus.

A text is a sequence of words, a word a sequence of subword ids. The attention model spells: it gives a word the product of its
ids' probabilities. With a word's share of all words that makes a prior, which the counts of the word after the one before it
update (Dirichlet smoothing). Each part sums to at most 1 over all words, so does the whole.

Texts are cut into chunks once and written. Counts: each chunk sends the hashes of its distinct words and word pairs, with their
training counts, to the tasks that own their ranges of the hash space, which sum over the corpus and answer each chunk.
Weights: all windows of all training documents are dealt to rounds, shards and pieces by their hash, each to one; each shard trains
on its own, a piece after another, and the shards' weights are averaged after each of the ROUNDS rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import AbstractContextManager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relfeat.llm.attention import BATCH, WINDOW, Adam, AttentionModel
from relfeat.llm.common import BATCH_BYTES, BATCH_SETTING, LARGE_ROWS, by_key, fragments_for, from_nullable, materialize, mix64, nullable, partitions, planes, range_of, settings, slices, text_bytes, unplanes
from relfeat.llm.token_files import encoder

#: How often shards train and their weights are averaged; windows of a shard at least (there are as many shards as partitions at
#: most), about so many of which are in memory at a time; and the most in a step.
ROUNDS, SHARD_WINDOWS, PIECE_WINDOWS, STEP_WINDOWS = 2, 1 << 17, 8192, 256
#: The weight of a word's share of all words in the prior, and occurrences that the prior weighs as much as beside pair counts.
SHARE, PRIOR = 0.5, 100.0
#: Recent words of a memo before its older ones go, pieces of words before theirs is emptied, and bytes of text in a chunk.
_MEMO, _PIECES, _CHUNK_BYTES = 250_000, 100_000, 3 << 20
#: No word holds a line feed, so this one marks a text's end (and what is before its start).
_END = b"\n"
_CHUNK_SQL = "chunk long, documents binary, kinds binary, spelled binary, pieces binary, words binary"
_CHUNK = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("documents", "kinds", "spelled", "pieces", "words"))])
_BLOCK = pa.schema([("fragment", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("fragment", pa.int32()), ("totals", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("attention_score", pa.float64()), ("score", pa.float64())])


def large_rows(spark: SparkSession) -> AbstractContextManager[None]:
    """For rows of some MB meanwhile: Python gets about BATCH_BYTES at a time, or one row; files are read by rows, not by some
    thousand at once; and a shuffle's files go when what it was for is written. For what is run at once; not for lazy frames."""
    return settings(spark, {BATCH_SETTING: str(BATCH_BYTES), "spark.sql.parquet.enableVectorizedReader": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def held_out(folds: int = 7, fold: int = 2) -> Column:
    """By the crc32 of doc_id as text (null as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


class _Spelled:
    """Memo of words' ids, as bytes of little-endian uint32. The end has the id `vocabulary`.

    When _MEMO recent words are exceeded they become the older ones, and those before them go; an older word that comes is recent again.
    """

    def __init__(self, path: str) -> None:
        self.words = encoder(path)
        self.end = np.array([self.words.library.get_vocab_size()], "<u4").tobytes()
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, the last of which is the end."""
        if len(self.recent) > _MEMO:
            self.older, self.recent = self.recent, {}
        out = [*map(self.recent.get, words)]
        out[-1] = self.end
        for i, ids in enumerate(out):
            if ids is None:
                ids = self.older.get(words[i])
                out[i] = self.recent[words[i]] = self.words.spell(words[i]) if ids is None else ids
        if len(self.words.pieces) > _PIECES:
            self.words.pieces.clear()
        return out


@lru_cache(maxsize=2)
def _spelled(path: str) -> _Spelled:
    """One a process, so that the next task of a reused worker finds the words known."""
    return _Spelled(path)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of texts (as bytes) the words of each, its end counted, and each one's number among the distinct words, of which the
    end is the last. Only ASCII letters are lower-cased and only ASCII white space parts words, whatever the other bytes are."""
    parted = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.view(pa.string()))))
    words = parted.flatten()
    empty = pc.equal(pc.binary_length(words), 0)  # what an empty text is parted into
    coded = words.filter(pc.invert(empty)).dictionary_encode()
    owner = pc.list_parent_indices(parted).to_numpy(zero_copy_only=False)[~empty.to_numpy(zero_copy_only=False)]
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    kinds = coded.dictionary.view(pa.binary()).to_pylist()
    which = np.full(int(sizes.sum()), len(kinds), np.uint32)
    which[np.arange(len(owner)) + owner] = coded.indices.to_numpy(zero_copy_only=False)
    return sizes, which, [*kinds, _END]


def _chunks(path: str):
    """Texts as numbers: each chunk's distinct words by hash, their ids, and its texts as sequences of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, part = _spelled(path), TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text", _CHUNK_BYTES)):
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)
            sizes, which, local = _coded(batch.column("text"))
            # Words' hashes are even and pairs' odd, so that both have one space.
            kinds = np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local)) & ~np.uint64(1)
            order = np.argsort(kinds, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            ids = spelled.of(local)
            ids = [ids[i] for i in order.tolist()]
            about = np.int64(len(sizes)).tobytes() + nullable(batch.column("doc_id").to_pylist()) + held.tobytes() + batch.column("row").to_numpy().astype("<i8").tobytes() + sizes.astype("<i8").tobytes()
            columns = (about, planes(kinds[order]), np.frombuffer(b"".join(ids), "<u4").astype("<u2").tobytes(), planes(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4), planes(place[which]))
            yield pa.RecordBatch.from_arrays([pa.array([(part << 24) + number]), *(pa.array([c], pa.binary()) for c in columns)], schema=_CHUNK)

    return run


class Chunk:
    """A written chunk, read back."""

    def __init__(self, row: dict) -> None:
        data = row["documents"]
        n = int(np.frombuffer(data, "<i8", 1)[0])
        self.doc_ids, self.held = from_nullable(data[8 : 8 + 9 * n]), np.frombuffer(data, np.uint8, n, 8 + 9 * n).astype(bool)
        self.rows, self.sizes = np.frombuffer(data, "<i8", 2 * n, 8 + 10 * n).reshape(2, n)
        self.kinds, self.pieces = unplanes(row["kinds"], np.uint64), unplanes(row["pieces"], np.uint32).astype(np.int64)
        self.spelled, self.words = np.frombuffer(row["spelled"], "<u2"), unplanes(row["words"], np.uint32).astype(np.int64)

    def pairs(self) -> np.ndarray:
        """The hash of each word after the one before it; a text's first is after an end."""
        own = self.kinds[self.words]
        before = np.concatenate((own[-1:], own[:-1]))  # every text ends in the same word
        return mix64(before * np.uint64(0x9E3779B97F4A7C15) + own) | np.uint64(1)

    def ids(self, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts (all, if None) the subword ids laid end to end, ids of each text, and ids of each word."""
        words = self.words if some is None else self.words[np.repeat(some, self.sizes)]
        sizes = self.sizes if some is None else self.sizes[some]
        each = self.pieces[words]
        first = (np.cumsum(self.pieces) - self.pieces)[words]
        at = np.arange(int(each.sum())) + np.repeat(first - (np.cumsum(each) - each), each)
        return self.spelled[at].astype(np.int64), _sums(each, sizes).astype(np.int64), each


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over runs of so many values; empty runs have 0."""
    ends = np.cumsum(sizes)
    total = np.concatenate(([0], np.cumsum(values)))
    return total[ends] - total[ends - sizes]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, so that the bytes of one only are held as Python's."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _counted(vocabulary: int):
    """Once a task, how often each id is in training texts, and how many windows these have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary + 2, np.int64)
        for row in _rows(batches):
            chunk = Chunk(row)
            ids, sizes, _ = chunk.ids(~chunk.held)
            counts[:-1] += np.bincount(ids, minlength=vocabulary + 1)
            counts[-1] += int((-(-sizes // WINDOW)).sum())
        yield pa.RecordBatch.from_pydict({"ids": [counts.astype("<i8").tobytes()]})

    return run


def _windows(nth: int, shards: int, pieces: int):
    """Each chunk's training windows of one round, a row for each piece of a shard: their keys, sizes, how many of their ids come
    before the window (two, or none at a text's start), and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            ids, sizes, _ = chunk.ids(~chunk.held)
            many = -(-sizes // WINDOW)
            owner = np.repeat(np.arange(len(sizes)), many)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            key = mix64(chunk.rows[~chunk.held].astype(np.uint64)[owner] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            own = np.flatnonzero(key % np.uint64(ROUNDS) == nth)
            piece = range_of(key[own], shards * pieces).astype(np.int64)
            order = np.argsort(piece, kind="stable")
            own, piece = own[order], piece[order]
            if not len(own):
                continue
            low = (np.cumsum(sizes) - sizes)[owner[own]]
            start = low + number[own] * WINDOW
            first = np.minimum(start - low, 2)
            size = np.minimum(start + WINDOW, low + sizes[owner[own]]) - start + first
            ends = np.cumsum(size)
            taken = ids[np.arange(int(ends[-1])) + np.repeat(start - first - (ends - size), size)].astype("<u2")
            cut = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(own)).tolist()
            at = np.concatenate(([0], ends))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            columns = [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (key[own], size.astype(np.uint8), first.astype(np.uint8))]
            numbers = piece[cut[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(numbers // pieces), pa.array(numbers), *columns, pa.array([taken[at[i] : at[j]].tobytes() for i, j in spans], pa.binary())], ["shard", "piece", "keys", "sizes", "firsts", "ids"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for row in _rows(batches):
        own = np.frombuffer(row["ids"], "<i8")
        total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})


def _examples(model: AttentionModel, ids: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows laid end to end (the first ids of each come before it) as the arrays that the model trains on."""
    at = (np.cumsum(sizes) - sizes + first)[:, None] + np.arange(WINDOW)
    alive = np.arange(WINDOW) < (sizes - first)[:, None]
    return *(np.where(alive, part[np.minimum(at, len(ids) - 1)], 0) for part in model.gather(ids, sizes)), alive


def examples(model: AttentionModel, windows: list[tuple[bytes, int]]) -> tuple[np.ndarray, ...]:
    """Windows (ids, how many of them come before) as the arrays that the model trains on."""
    ids = np.frombuffer(b"".join(data for data, _ in windows), "<u2").astype(np.int64)
    return _examples(model, ids, np.array([len(data) // 2 for data, _ in windows]), np.array([first for _, first in windows]))


#: Weights in one row of those that are averaged.
_PIECE = 1 << 16


def _trained(model: AttentionModel, adam: Adam, rows: list[dict], step: int, sizes: tuple[float, float]) -> int:
    """Trains on one piece's windows, in the order of their keys and ids; how many there are. sizes: of its first step and its last."""
    key, size, first = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("keys", "<u8"), ("sizes", np.uint8), ("firsts", np.uint8)))
    parts = _examples(model, np.concatenate([np.frombuffer(r["ids"], "<u2") for r in rows]).astype(np.int64), size.astype(np.int64), first.astype(np.int64))
    order = np.lexsort((*parts[2].T[:4], key))
    many = -(-len(order) // step)
    for i, some in enumerate(np.array_split(order, many)):
        adam.step(*(x[some] for x in parts), sizes[0] + (sizes[1] - sizes[0]) * i / many)
    return len(order)


def _shard(spread, nth: int, pieces: int, step: int):
    """Trains on each shard's windows, a piece at a time; rows (piece of weights, shard, n, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda number: (1 - (nth + number / pieces) / ROUNDS)
        at, model, adam, n = None, None, None, 0

        def done() -> pa.RecordBatch:
            flat = model.pack()
            parts = [flat[i : i + _PIECE].tobytes() for i in range(0, len(flat), _PIECE)]
            return pa.RecordBatch.from_pydict({"piece": np.arange(len(parts)), "shard": np.full(len(parts), at), "n": np.full(len(parts), n), "weights": parts})

        for piece, rows in by_key(batches, "piece"):
            if piece // pieces != at:
                if at is not None:
                    yield done()
                model = spread.value.unpack(spread.value.pack().copy())
                at, adam, n = piece // pieces, Adam(model), 0
            n += _trained(model, adam, rows, step, (whole(piece % pieces), whole(piece % pieces + 1)))
        if at is not None:
            yield done()

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean weights of each piece, a row at a time."""
    piece, total, n = None, None, 0
    done = lambda: pa.RecordBatch.from_pydict({"piece": [piece], "weights": [(total / n).astype(np.float32).tobytes()]})
    for row in _rows(batches):
        if piece is not None and row["piece"] != piece:
            yield done()
            total = None
        own = row["n"] * np.frombuffer(row["weights"], np.float32).astype(np.float64)
        piece, total, n = row["piece"], own if total is None else total + own, row["n"] + (n if total is not None else 0)
    if piece is not None:
        yield done()


def train(chunks: DataFrame, spark: SparkSession, vocabulary: int) -> AttentionModel:
    """The attention model of the training texts in written chunks. Without any, ids are equally likely.

    The driver gets sixteen rows of counts at most, and the mean weights: some MB, by the vocabulary's size.
    """
    counts = chunks.mapInArrow(_counted(vocabulary), "ids binary").repartition(min(16, partitions(spark))).mapInArrow(_summed, "counts binary").collect()
    counts = sum((np.frombuffer(r["counts"], "<i8") for r in counts), np.zeros(vocabulary + 2, np.int64))
    model, windows = AttentionModel.over(counts[:-1]), int(counts[-1])
    shards = max(1, min(partitions(spark), windows // SHARD_WINDOWS))
    each = windows // (max(1, ROUNDS) * shards)  # a shard's windows of a round
    pieces = max(1, each // PIECE_WINDOWS)
    step = min(STEP_WINDOWS, max(BATCH, each // 256))
    for nth in range(ROUNDS):
        spread = spark.sparkContext.broadcast(model)
        dealt = chunks.mapInArrow(_windows(nth, shards, pieces), "shard long, piece long, keys binary, sizes binary, firsts binary, ids binary")
        dealt = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("piece")
        trained = dealt.mapInArrow(_shard(spread, nth, pieces, step), "piece long, shard long, n long, weights binary")
        mean = trained.repartition(partitions(spark), "piece").sortWithinPartitions("piece", "shard").mapInArrow(_average, "piece long, weights binary").collect()
        if not mean:
            break
        model = model.unpack(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(mean, key=lambda r: r["piece"])]))
    return model


def _blocks(fragments: int):
    """Each chunk's distinct words and pairs, with their training counts, by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            learn = np.repeat(~chunk.held, chunk.sizes)
            pairs, which = np.unique(chunk.pairs(), return_inverse=True)
            for keys, at in ((chunk.kinds, chunk.words), (pairs, which)):
                counts = np.bincount(at, learn, len(keys)).astype("<u4")
                cut = np.searchsorted(range_of(keys, fragments), np.arange(fragments + 1))
                yield pa.RecordBatch.from_pylist([{"fragment": f, "chunk": row["chunk"] * 2 + (keys is pairs), "keys": planes(keys[a:b]), "counts": planes(counts[a:b])} for f, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b], schema=_BLOCK)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one hash range: the corpus's counts of each block's keys, and how many words and kinds of word the range has."""
    for fragment, rows in by_key(batches, "fragment"):
        keys = [unplanes(r["keys"], np.uint64) for r in rows]
        counts = np.concatenate([unplanes(r["counts"], np.uint32) for r in rows])
        kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(which, counts, len(kinds)).astype("<i8")
        ends = np.cumsum([len(k) for k in keys])
        words = kinds & np.uint64(1) == 0
        out = [{"chunk": r["chunk"], "fragment": fragment, "totals": planes(totals[which[b - len(k) : b]])} for r, k, b in zip(rows, keys, ends, strict=True)]
        out.append({"fragment": fragment, "tokens": int(totals[words].sum()), "kinds": int((totals[words] > 0).sum())})
        yield pa.RecordBatch.from_pylist(out, schema=_REPLY)


def mixed(pair: np.ndarray, before: np.ndarray, share: np.ndarray, spelling: np.ndarray) -> np.ndarray:
    """Natural log probabilities of words: pair and before are counts (of the word after the one before it, and of that
    one), share and spelling natural logs of the word's probabilities by the two parts of the prior."""
    prior = np.logaddexp(math.log(SHARE) + share, math.log1p(-SHARE) + spelling)
    return np.logaddexp(np.log(np.maximum(pair, 1e-300)), math.log(PRIOR) + prior) - np.log(before + PRIOR)


def _scored(spread, tokens: int, kinds: int):
    """Documents' scores; a chunk comes as its replies, by range, and then as itself."""
    space = math.log(tokens + kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: AttentionModel = spread.value
        at, replies = None, ([], [])
        for row in _rows(batches):
            if row["chunk"] != at:
                at, replies = row["chunk"], ([], [])
            if row["totals"] is not None:
                replies[row["pair"]].append(unplanes(row["totals"], np.int64))
                continue
            chunk = Chunk(row)
            _, which = np.unique(chunk.pairs(), return_inverse=True)
            words, pairs = (np.concatenate(r) for r in replies)
            own, pair = words[chunk.words], pairs[which]
            before = np.concatenate((own[-1:], own[:-1]))
            share = np.log(own + 1.0) - space
            ids, sizes, each = chunk.ids()
            spelling = _sums(model.scores(ids, sizes), each)
            sums = (_sums(x, chunk.sizes) for x in (share, spelling, mixed(pair, before, share, spelling)))
            known = _sums(own > 0, chunk.sizes)
            yield pa.RecordBatch.from_arrays([pa.array(chunk.doc_ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.sizes), pa.array(known), *(pa.array(s / math.log(10)) for s in sums)], schema=_SCORES)

    return run


def score_texts(docs: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, attention_score and score.

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out; all others teach. base_score: the unigram log10 probability
    of the text's words (parted by ASCII white space, A-Z lower-cased) and its end, with add-one counts. attention_score: what
    the attention model alone gives their subword ids. score: the whole model's, see `mixed`. Null texts are empty: one end.
    Rows of one doc_id, and rows that repeat, are documents of their own. Other columns are not carried. An empty table gives an
    empty result; with nothing to learn from, every count is 0. Words and word pairs are told apart by 63-bit hashes.
    """
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), text_bytes(), held_out().alias("held_out"))
    vocabulary = encoder(path).library.get_vocab_size()
    if vocabulary >= 1 << 16:
        raise ValueError(f"{path}: ids above 65535 are not supported")
    with large_rows(spark):
        # Written once: a chunk keeps its number and content, whatever is run again later.
        chunks = materialize(base.mapInArrow(_chunks(path), _CHUNK_SQL), spark, LARGE_ROWS)
        model = train(chunks, spark, vocabulary)

        fragments = fragments_for(base, spark, 4 << 20)
        blocks = chunks.mapInArrow(_blocks(fragments), "fragment int, chunk long, keys binary, counts binary")
        replies = blocks.repartitionById(fragments, F.col("fragment")).sortWithinPartitions("fragment", "chunk").mapInArrow(_totals, "chunk long, fragment int, totals binary, tokens long, kinds long")
        replies = materialize(replies, spark, LARGE_ROWS)
        tokens, kinds = replies.where("chunk is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
        answers = replies.where("chunk is not null").select(F.expr("chunk div 2").alias("chunk"), "fragment", (F.col("chunk") % 2).cast("int").alias("pair"), "totals")
        # As many parts as ranges: a part holds some chunks, however many there are.
        both = answers.unionByName(chunks, allowMissingColumns=True).repartition(fragments, "chunk").sortWithinPartitions("chunk", F.col("fragment").asc_nulls_last())
        scored = both.mapInArrow(_scored(spark.sparkContext.broadcast(model), tokens, kinds), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, attention_score double, score double")
        scored = materialize(scored, spark)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op5_lm_score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score_texts(docs, spark, public_tokenizers.path("word_bpe_49k.json"))
