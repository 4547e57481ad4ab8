"""Documents whose sets of word n-grams are alike, found without comparing all pairs.

Vertical partitioning: n-grams have one global order, from rare to frequent (by how many documents hold them, then by hash), and
that order is cut into fragments, each set into its segments of them. Two sets with a Jaccard similarity of t share an n-gram
among the first n - ceil(t n) + 1 in global order, so only sets that do can be a pair; each fragment counts a pair's overlap among
its own segments, and the partial overlaps are summed per pair.

Equal texts are one node from the start. Nodes that share a prefix n-gram form a list. First, each node is compared with
the hub of its longest list; next, one node of each component in a list with its hub; last, nodes of a list that are still in
different components with each other. That finds the same components as all pairs would, without the pairs inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relfeat.llm.common import BASE, BATCH_BYTES, BATCH_SETTING, WordIds, by_key, fragments_for, give_back, materialize, mix64, partitions, planes, powers, rabin_karp, range_of, runs, settings, slices, text_bytes, unplanes, window_starts
from relfeat.llm.graph import components

#: Where the global order is cut: places (documents that hold an n-gram, its hash as a share of the hash space) in it. Most shared
#: n-grams stand in two or three documents.
_CUTS = ((2, 0.5), (3, 0.0), (3, 0.5), (4, 0.0), (6, 0.0), (16, 0.0))
#: Words of 64 bits in a set's parity mark.
_MARK = 16
_BLOCK = pa.schema([("fragment", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("owners", pa.binary()), ("documents", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("grams", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary()), ("documents", pa.binary())])
_SETS = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("grams", pa.binary()), ("cuts", pa.binary())])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = [t.lower().split() for t in batch.column("text").to_pylist()]  # of bytes: only A-Z change
        node = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words), np.uint64, len(words)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node), pa.array([not w for w in words])], ["doc_id", "node", "empty"])
    give_back()


def shingles(hashed: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, owner) without repeats, by gram: windows of k words, or a shorter text's words as one gram."""
    starts, owner = window_starts(counts, k)
    gram = rabin_karp(hashed, starts, k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    firsts = np.cumsum(counts) - counts
    factors = powers(BASE, k)
    whole = mix64(np.array([np.sum(hashed[firsts[i] : firsts[i] + counts[i]] * factors[: counts[i]]) for i in short], np.uint64) + counts[short].astype(np.uint64))
    gram, owner = np.concatenate([gram, whole]), np.concatenate([owner, short]).astype(np.uint32)
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[new], owner[new]


def _blocks(k: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part = WordIds(), TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text", 8 << 20)):
            # A task that is run again reads the same rows in the same order, so a chunk keeps its number.
            chunk = (part << 32) + number
            words, nodes = [], {}
            for text in batch.column("text").to_pylist():
                ws = text.lower().split()
                node = xxhash.xxh3_64_intdigest(b" ".join(ws))
                if ws and node not in nodes:
                    nodes[node] = len(words)
                    words.append(ws)
            counts = np.fromiter(map(len, words), np.int64, len(words))
            gram, owner = shingles(ids.array([w for ws in words for w in ws]), counts, k)
            sizes = np.bincount(owner, minlength=len(words)).astype("<i8")
            about = np.fromiter(nodes, np.uint64, len(nodes)).tobytes() + sizes.tobytes()
            out = [{"fragment": int(chunk % fragments), "chunk": chunk, "documents": about}]
            cut = np.searchsorted(range_of(gram, fragments), np.arange(fragments + 1))
            out += [{"fragment": f, "chunk": chunk, "grams": planes(gram[a:b]), "owners": planes(owner[a:b])} for f, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
            yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)
        ids.clear()
        give_back()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one fragment: which n-grams more than one document holds, and how many do."""
    for _, rows in by_key(batches, "fragment"):
        out = [{"chunk": r["chunk"], "documents": r["documents"]} for r in rows if r["documents"] is not None]
        rows = [r for r in rows if r["documents"] is None]
        grams = [unplanes(r["grams"], np.uint64) for r in rows]
        everything = np.sort(np.concatenate([*grams, np.zeros(0, np.uint64)]))
        first, size = runs(everything)
        twice, times = everything[first[size > 1]], size[size > 1].astype("<u4")
        for r, gram in zip(rows, grams, strict=True):
            at = np.minimum(np.searchsorted(twice, gram), max(len(twice) - 1, 0))
            hit = np.flatnonzero(twice[at] == gram) if len(twice) else at[:0]
            if len(hit):
                out.append({"chunk": r["chunk"], "grams": planes(gram[hit]), "owners": planes(unplanes(r["owners"], np.uint32)[hit]), "counts": planes(times[at[hit]])})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_REPLY)


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of n can have with one that is alike."""
    return -(-percent * n // 100)


def fragment_of(gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fragment of the global order that each n-gram stands in."""
    out = np.zeros(len(gram), np.int64)
    for held, part in _CUTS:
        out += (count > held) | ((count == held) & (gram >= np.uint64(int(part * 2**64))))
    return out


def _sets(percent: int):
    """Per document its set size and, if it can be like any other, its shared n-grams in global order and where fragments end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "chunk"):
            about = next(r["documents"] for r in rows if r["documents"] is not None)
            nodes, sizes = np.frombuffer(about, "<i8").reshape(2, -1)
            rows = [r for r in rows if r["documents"] is None]
            gram, owner, count = (np.concatenate([*(unplanes(r[c], t) for r in rows), np.zeros(0, t)]) for c, t in (("grams", np.uint64), ("owners", np.uint32), ("counts", np.uint32)))
            enough = np.bincount(owner, minlength=len(nodes)) >= need(sizes, percent)
            keep = enough[owner]
            gram, owner, count = gram[keep], owner[keep], count[keep]
            order = np.lexsort((gram, count, owner))
            gram, count, cut = gram[order], count[order], np.searchsorted(owner[order], np.arange(len(nodes) + 1))
            ends = np.zeros((len(nodes), len(_CUTS) + 1), "<u4")
            np.add.at(ends, (owner[order], fragment_of(gram, count)), 1)
            ends = ends.cumsum(1, dtype="<u4")
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sizes.astype(np.int32)), pa.array([gram[a:b].tobytes() if a < b else None for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([e.tobytes() for e in ends], pa.binary())], schema=_SETS)

    return run


def _prefixes(percent: int):
    """Rows (gram, node, n, place) of the shared n-grams in a set's prefix; unshared ones, being rarer, come before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for node, n, data in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                gram = np.frombuffer(data, "<i8")
                before = n - len(gram)
                first = gram[: max(0, n - int(need(n, percent)) + 1 - before)]
                out.append((first, np.full(len(first), node), np.full(len(first), n), before + np.arange(len(first))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["gram", "node", "n", "place"])

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets cut into their segments of the global order's fragments, each sorted by hash; empty ones have no row."""
    for batch in batches:
        out: list[dict] = []
        for node, data, cuts in zip(*(batch.column(c).to_pylist() for c in ("node", "grams", "cuts")), strict=True):
            gram, ends = np.frombuffer(data, np.uint64), np.frombuffer(cuts, "<u4").tolist()
            out += [{"node": node, "part": p, "piece": np.sort(gram[low:high]).tobytes()} for p, (low, high) in enumerate(zip([0, *ends], ends, strict=False)) if low < high]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("node", pa.int64()), ("part", pa.int32()), ("piece", pa.binary())]))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set how many n-grams no other has, and a mark in which every shared one flips one bit.

    Sets differ in as many n-grams at least as their marks differ in bits.
    """
    for batch in batches:
        alone, marks = [], []
        for n, data in zip(batch.column("n").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            gram = np.frombuffer(data, np.uint64)
            flips = np.bincount((gram % np.uint64(64 * _MARK)).astype(np.int64), minlength=64 * _MARK)
            alone.append(n - len(gram))
            marks.append(np.packbits(flips & 1).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(alone, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["node", "alone", "mark"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), True)) for a, b in zip(batch.column("piece_a").to_pylist(), batch.column("piece_b").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "v", "total")), pa.array(common, pa.int64())], ["u", "v", "total", "common"])


def _alike(pairs: DataFrame, parts: DataFrame, spark: SparkSession, percent: int) -> DataFrame:
    """The pairs (u, v, total: both sizes' sum) that are alike: overlaps of the parts, summed per pair."""
    one = parts.select(F.col("node").alias("u"), "part", F.col("piece").alias("piece_a"))
    two = parts.select(F.col("node").alias("v"), F.col("part").alias("part_b"), F.col("piece").alias("piece_b"))
    met = pairs.join(one, "u")
    met = met.join(two, (met["v"] == two["v"]) & (met["part"] == two["part_b"])).select("u", met["v"], "total", "piece_a", "piece_b")
    counted = met.mapInArrow(_overlaps, "u long, v long, total long, common long").groupBy("u", "v", "total").agg(F.sum("common").alias("common"))
    return materialize(counted.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("u", "v"), spark)


def similar_documents(docs: DataFrame, spark: SparkSession, k: int = 5, percent: int = 75) -> DataFrame:
    """Every row of docs: doc_id, n_shingles, component_id, the least doc_id reachable by links.

    A document's set: distinct k-word shingles of its words (parted by ASCII white space, A-Z lower-cased); with fewer
    words, the whole sequence as one. Documents link when 100 * intersection >= percent * union. Documents without words, null
    texts too, have an empty set and link with none: component_id is their own doc_id. Copies are links as others are; rows of
    one doc_id are each compared by their own text. A null doc_id counts as larger than all others, and is a component_id only
    where no other is in the component. Other columns are not carried; an empty table gives an empty result.
    Word sequences and shingles are told apart by 64-bit hashes.
    """
    with settings(spark, {BATCH_SETTING: str(BATCH_BYTES)}):
        return _similar(docs, spark, k, percent)


def _similar(docs: DataFrame, spark: SparkSession, k: int, percent: int) -> DataFrame:
    """similar_documents; all that runs Python has run when it returns."""
    base = docs.select("doc_id", text_bytes())
    rows = materialize(base.mapInArrow(_nodes, "doc_id long, node long, empty boolean"), spark)
    least = materialize(rows.where("not empty").groupBy("node").agg(F.min("doc_id").alias("least_doc")), spark)
    # Of copies, one text goes on: documents with a text that a smaller doc_id has too are left out, unless they have several.
    several = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    copies = rows.where("not empty").join(least.withColumnRenamed("node", "least_node"), (F.col("node") == F.col("least_node")) & (F.col("doc_id") > F.col("least_doc"))).select("doc_id")
    copies = materialize(copies.join(several, "doc_id", "left_anti"), spark)
    # In an order of the rows' own, so that a task that is run again cuts the same chunks.
    firsts = base.join(copies, "doc_id", "left_anti").sortWithinPartitions("doc_id", F.xxhash64("text"))

    fragments = fragments_for(base, spark)
    blocks = firsts.mapInArrow(_blocks(k, fragments), "fragment int, chunk long, grams binary, owners binary, documents binary")
    replies = blocks.repartitionById(fragments, F.col("fragment")).sortWithinPartitions("fragment", "chunk").mapInArrow(_shared, "chunk long, grams binary, owners binary, counts binary, documents binary")
    sets = replies.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(_sets(percent), "node long, n int, grams binary, cuts binary")
    sets = materialize(sets, spark)

    able = sets.where("grams is not null").dropDuplicates(["node"])
    parts = materialize(able.mapInArrow(_parts, "node long, part int, piece binary"), spark)
    lists = materialize(able.mapInArrow(_prefixes(percent), "gram long, node long, n long, place long"), spark)
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)

    pair = lambda a, b: (F.least(a["node"], b["node"]).alias("u"), F.greatest(a["node"], b["node"]).alias("v"), (a["n"] + b["n"]).alias("total"))
    me, hub = F.struct("node", "n"), F.col("hub")
    # First, each node and the hub of its longest list.
    hubs = materialize(lists.groupBy("gram").agg(F.count("*").alias("size"), F.min(me).alias("hub")).where(F.col("size") > 1), spark)
    longest = lists.join(hubs, "gram").groupBy("node", "n").agg(F.max(F.struct("size", "gram", "hub"))["hub"].alias("hub"))
    near = longest.where((F.col("node") != hub["node"]) & fits(F.col("n"), hub["n"])).select(*pair(me, hub)).distinct()
    near = materialize(near, spark)
    links = _alike(near, parts, spark, percent)

    def placed() -> DataFrame:
        """The lists that still hold several components, with their members' components and the hub's."""
        joined = components(links, spark)
        rows = lists.join(joined, "node", "left").select("gram", "node", "n", "place", F.coalesce("component", "node").alias("component"))
        rows = materialize(rows, spark)
        mixed = rows.groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
        mains = rows.join(hubs.select("gram", F.col("hub")), "gram").where(F.col("node") == hub["node"]).select("gram", F.col("component").alias("main"), "hub")
        return materialize(rows.join(materialize(mixed.join(mains, "gram").select("gram", "main", "hub"), spark), "gram"), spark)

    # Then, one node of each other component in a list and the list's hub.
    some = placed().where("component <> main").groupBy("gram", "component").agg(F.min(me).alias("one"), F.first("hub").alias("hub"))
    some = some.where(fits(F.col("one")["n"], hub["n"])).select(*pair(F.col("one"), hub)).distinct().join(near.select("u", "v"), ["u", "v"], "left_anti")
    some = materialize(some, spark)
    links = materialize(links.unionByName(_alike(some, parts, spark, percent)), spark)
    near = near.unionByName(some)

    # Last, all that a list holds of different components.
    listed = placed().join(materialize(able.mapInArrow(_marks, "node long, alone long, mark array<long>"), spark), "node")
    few = listed.where("component <> main").select("gram", *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "place", "component", "alone", "mark")))
    cross = few.join(listed, "gram").where("component <> a_component and (component = main or a_node < node)").where(fits(F.col("a_n"), F.col("n")))
    # What can still be common from the shared n-gram on; at a pair's first common one this holds if they are alike.
    total = F.col("a_n") + F.col("n")
    cross = cross.where((100 + percent) * F.least(F.col("a_n") - F.col("a_place"), F.col("n") - F.col("place")) >= percent * total)
    apart = F.col("alone") + F.col("a_alone")
    for i in range(_MARK):
        apart = apart + F.bit_count(F.col("mark")[i].bitwiseXOR(F.col("a_mark")[i]))
    cross = cross.where((100 + percent) * apart <= (100 - percent) * total)
    cross = cross.select(F.least("a_node", "node").alias("u"), F.greatest("a_node", "node").alias("v"), total.alias("total")).distinct().join(near.select("u", "v"), ["u", "v"], "left_anti")
    links = links.unionByName(_alike(materialize(cross, spark), parts, spark, percent))
    joined = materialize(components(links, spark), spark)

    whole = lambda frame: frame.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = materialize(whole(least).groupBy("component").agg(F.min("least_doc").alias("component_id")), spark)
    sizes = sets.groupBy("node").agg(F.max("n").cast("long").alias("n_shingles"))
    known = materialize(whole(sizes).join(names, "component").select("node", "n_shingles", "component_id"), spark)
    full = rows.where("not empty").join(known, "node").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("empty").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op4_ngram_jaccard(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return similar_documents(docs, spark)
