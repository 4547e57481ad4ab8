"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are rates of a whole text: densities of lexicon words, their proximity to the second person, capitals,
punctuation and obfuscated spellings. The lexicon is learned from the labelled rows too: words, and beginnings of words, that
toxic documents hold far more often than others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relfeat.llm.common import give_back, materialize, slices, text_bytes

#: Labelled rows that the model learns from at most: those with the least hash of their doc_id.
MOST_LABELLED = 20_000
#: Parts of the labelled rows, each scored for calibration by a lexicon and trees that haven't seen it.
FOLDS = 3
#: Toxic documents that an entry is in at least, and how many times likelier it is there (as a natural logarithm).
LEAST_DOCUMENTS, STRONG, WEAK = 4, 2.5, 1.2
#: Lengths of the beginnings of words that can be entries.
STEMS = (4, 5, 6)
#: The second person, in the languages of the corpus.
SECOND = frozenset(w.encode() for w in "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split())
#: Digits and signs that stand for letters in obfuscated spellings.
_SPELL = bytes.maketrans(b"013457@$!|", b"oieastasil")
_EDGES = b".,;:!?\"'()[]{}<>*-_/\\"
#: Words between a lexicon word and the second person that count as near.
NEAR = 5
#: Words that a memo holds before it is emptied: of profiles, and of what can be entries.
_MEMO, _UNITS = 150_000, 40_000
FEATURES = ("strong", "weak", "weight", "heaviest", "kinds", "count", "second", "near", "shouted", "capitals", "exclaimed", "punctuation", "obfuscated", "digits", "length", "stretched")


def units(word: bytes) -> tuple[bytes, ...]:
    """What of a word can be an entry: the word in plain spelling, and its beginnings (with a star)."""
    core = word.strip(_EDGES).lower()
    if not core.isalpha() and core.isascii():
        core = core.translate(_SPELL, b"*.-_")
    return (core, *(core[:n] + b"*" for n in STEMS if len(core) >= n)) if len(core) > 2 else ()


def _obfuscated(word: bytes) -> bool:
    core = word.strip(b".,;:!?\"'()")
    return core.isascii() and not core.isalnum() and bool(set(core) & set(b"@$!|*")) and any(65 <= c <= 122 for c in core) or (core.isalnum() and core[:1].isalpha() and not core.isalpha() and not core[-1:].isdigit())


#: Signs of a byte: capital, exclamation mark, punctuation, digit, beyond "@".
_CAPITAL, _EXCLAIMED, _PUNCTUATION, _DIGIT = 1, 2, 4, 8
_SIGNS = np.zeros(256, np.uint8)
_SIGNS[65:91] |= _CAPITAL
_SIGNS[33] |= _EXCLAIMED
_SIGNS[[33, 34, 39, 44, 46, 58, 59, 63]] |= _PUNCTUATION
_SIGNS[48:58] |= _DIGIT


@dataclass
class Lexicon:
    """Entries and their weights, and the rates of texts by them."""

    weights: dict[bytes, float]
    memo: dict[bytes, int] = field(default_factory=dict, repr=False)
    profiles: dict[tuple, int] = field(default_factory=dict, repr=False)

    def profile(self, word: bytes) -> int:
        """The number of the word's profile: (weight, second person, shouted, obfuscated, with digits)."""
        weight = max((self.weights.get(u, 0.0) for u in units(word)), default=0.0)
        core = word.strip(_EDGES)
        key = (weight, core.lower() in SECOND, len(core) > 2 and core.isupper(), _obfuscated(word), any(48 <= c <= 57 for c in core))
        return self.profiles.setdefault(key, len(self.profiles))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """A row of FEATURES for each text. Words are looked up once a kind; all else is counted for all texts together."""
        out = np.zeros((len(texts), len(FEATURES)))
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(texts))
        words = [w for ws in split for w in ws]
        memo = self.memo
        for w in dict.fromkeys(words):
            if w not in memo:
                memo[w] = self.profile(w)
        codes = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        if len(memo) > _MEMO:
            memo.clear()
        owner = np.repeat(np.arange(len(texts)), n)
        # weight, strong, weak, second, shouted, obfuscated
        table = np.array([(w, w >= STRONG, WEAK <= w < STRONG, *rest[:3]) for w, *rest in self.profiles], float).reshape(-1, 6)
        sums = np.stack([np.bincount(owner, column[codes], len(texts)) for column in table.T], 1)
        strong, second = np.flatnonzero(table[codes, 1]), np.flatnonzero(table[codes, 3])
        kinds = np.unique(owner[strong] * max(1, len(table)) + codes[strong]) // max(1, len(table))
        heaviest = np.zeros(len(texts))
        np.maximum.at(heaviest, owner, table[codes, 0])
        # Texts stand too far apart for a word to be near another text's.
        places = np.arange(len(words)) + owner * (2 * NEAR)
        near = np.zeros(len(strong), bool)
        if len(second):
            at = np.searchsorted(second, strong)
            for neighbour in (second[np.minimum(at, len(second) - 1)], second[np.maximum(at - 1, 0)]):
                near |= (np.abs(places[strong] - places[neighbour]) <= NEAR) & (owner[strong] == owner[neighbour])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends, signs = np.cumsum(sizes), _SIGNS[data]

        def per_byte(flags: np.ndarray) -> np.ndarray:
            counts = np.zeros(len(texts))
            full = np.flatnonzero(sizes)
            if len(full):
                counts[full] = np.add.reduceat(flags, (ends - sizes)[full], dtype=np.int64)
            return counts / np.maximum(sizes, 1)

        stretched = np.zeros(len(data), bool)
        if len(data) > 2:
            stretched[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] > 64)
            first = (ends - sizes)[sizes > 0]
            stretched[first] = False  # a run that starts in the text before
            stretched[np.minimum(first + 1, len(data) - 1)[sizes[sizes > 0] > 1]] = False
        rate = 1 / np.maximum(n, 1)
        columns = (sums[:, 1] * rate, sums[:, 2] * rate, sums[:, 0] * rate, heaviest, np.bincount(kinds, minlength=len(texts)), np.log1p(sums[:, 1]), sums[:, 3] * rate, np.bincount(owner[strong], near, len(texts)) * rate, sums[:, 4] * rate, per_byte(signs & _CAPITAL > 0), per_byte(signs & _EXCLAIMED > 0), per_byte(signs & _PUNCTUATION > 0), sums[:, 5] * rate, per_byte(signs & _DIGIT > 0), np.log1p(n), per_byte(stretched))
        for i, column in enumerate(columns):
            out[:, i] = column
        return out

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "memo": {}, "profiles": {}}

    def forget(self) -> None:
        """Free what texts have left: a Python worker outlives its task."""
        self.memo.clear()


@dataclass
class Trees:
    """Boosted trees of a fixed depth on binned features: logistic loss, second-order leaves."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    ridge: float = 2.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # Rates that most rows don't have at all still need bins among the rows that have them.
        self.edges = [np.unique(np.concatenate([e, [0.0], np.quantile(c[c > 0], np.linspace(0, 1, 9)[1:-1])])) if (c > 0).any() else e for c, e in zip(x.T, self.edges, strict=True)]
        b = self.binned(x)
        p = (y.sum() + 1) / (len(y) + 2)
        self.base, self.trees = math.log(p / (1 - p)), []
        raw, width = np.full(len(y), self.base), max(len(e) for e in self.edges) + 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-raw))
            g, h, node = y - q, q * (1 - q), np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                nodes = 1 << level
                best = [(0.0, 0, width) for _ in range(nodes)]  # no split: all to the left
                for f in range(x.shape[1]):
                    at = node * width + b[:, f]
                    gs, hs = (np.bincount(at, w, nodes * width).reshape(nodes, width).cumsum(1) for w in (g, h))
                    score = gs**2 / (hs + self.ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    score[(hs < 1) | (hs[:, -1:] - hs < 1)] = 0
                    cut = score.argmax(1)
                    for i in range(nodes):
                        if score[i, cut[i]] > best[i][0] + 1e-9:
                            best[i] = (float(score[i, cut[i]]), f, int(cut[i]))
                feature, cut = np.array([s[1] for s in best]), np.array([s[2] for s in best])
                splits.append((feature, cut))
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.ridge)
            self.trees.append((splits, self.rate * leaf))
            raw += self.rate * leaf[node]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows, out = self.binned(x), np.arange(len(x)), np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares increasing map from scores to rates (pool adjacent violators), kept inside (0, 1)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    x = np.array([b[2] / b[1] for b in blocks])
    rate = np.array([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks])
    return x, np.maximum.accumulate(rate)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None or self.knots is None:
            return np.full(len(texts), self.prior)
        raw = self.trees.raw(self.lexicon.features(texts))
        # Between and beyond the knots a little of the raw score keeps the order.
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def held_out(name: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """By the crc32 of doc_id as text (null as an empty text)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _count_units(known: frozenset | None):
    """Rows (unit, fold, toxic, clean): in how many documents each unit is; only units of `known`, or only toxic documents' if None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[bytes, tuple[bytes, ...]] = {}
        for batch in slices(batches, "text"):
            counts: dict[tuple[int, int], Counter] = {}
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                if known is None and not toxic:
                    continue
                seen: set[bytes] = set()
                for word in set(text.split()):
                    if (found := of.get(word)) is None:
                        found = units(word)
                        found = of[word] = found if known is None else tuple(u for u in found if u in known)
                    seen.update(found)
                counts.setdefault((fold, toxic), Counter()).update(seen)
                if len(of) > _UNITS:
                    of.clear()
            for (fold, toxic), units_in in counts.items():
                times, none = pa.array(list(units_in.values()), pa.int64()), pa.array(np.zeros(len(units_in), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(units_in), pa.binary()), pa.array(np.full(len(units_in), fold, np.int32)), times if toxic else none, none if toxic else times], ["unit", "fold", "toxic", "clean"])

    return run


def lexicon(counts: list[tuple[bytes, int, int]], n_toxic: int, n_clean: int) -> Lexicon:
    """The units (unit, toxic documents, other documents) that stand in LEAST_DOCUMENTS toxic documents and are likelier there."""
    odds = {u: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1)) for u, t, c in counts if t >= LEAST_DOCUMENTS}
    return Lexicon({u: round(o, 1) for u, o in odds.items() if o >= WEAK})


def train(docs: DataFrame, labels: DataFrame, spark: SparkSession, label: str = "toxic") -> ToxicityModel:
    """Learn from the labelled documents (doc_id, text) and (doc_id, label 0/1), MOST_LABELLED at most.

    Null labels and documents without text don't count; labels that repeat count once, the largest, and so do documents that
    repeat a doc_id: the text with the least hash. Without documents of both labels, the model gives every text their share of
    label 1 (smoothed). Calibration: each of FOLDS parts is scored by a lexicon and trees that its labels had no part in. Texts
    stay on the executors; the driver gets the lexicon's counts and the features of the rows it learns from, all bounded by
    MOST_LABELLED.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    # The limit bounds what is broadcast: some hundred KB.
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = materialize(rows.select("doc_id", text_bytes(), "toxic", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), spark)
    n = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    size = lambda toxic, without=None: sum(v for (f, t), v in n.items() if t == toxic and f != without)
    prior = (size(1) + 1) / (size(1) + size(0) + 2)
    if not size(1) or not size(0):
        return ToxicityModel(Lexicon({}), None, None, prior)
    schema = "unit binary, fold int, toxic long, clean long"
    often = rows.mapInArrow(_count_units(None), schema).groupBy("unit").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= LEAST_DOCUMENTS)
    candidates = frozenset(bytes(r["unit"]) for r in often.select("unit").collect())
    counted = rows.mapInArrow(_count_units(candidates), schema).groupBy("unit").agg(*(F.sum(F.when((F.col("fold") != f) if f < FOLDS else F.lit(True), F.col(c))).alias(f"{c}{f}") for f in range(FOLDS + 1) for c in ("toxic", "clean")))
    strong = counted.where(F.greatest(*(F.log((F.coalesce(F.col(f"toxic{f}"), F.lit(0)) + 0.5) / (size(1, f) + 1)) - F.log((F.coalesce(F.col(f"clean{f}"), F.lit(0)) + 0.5) / (size(0, f) + 1)) for f in range(FOLDS + 1))) >= WEAK)
    got = sorted(strong.collect())
    # The last is learned from all rows, each other from all but one fold.
    lexicons = [lexicon([(bytes(r["unit"]), r[f"toxic{f}"] or 0, r[f"clean{f}"] or 0) for r in got], size(1, f), size(0, f)) for f in range(FOLDS + 1)]
    spread = spark.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            x = np.hstack([one.features(texts) for one in spread.value])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("fold"), *(pa.array(c) for c in x.T)], ["doc_id", "toxic", "fold", *columns])
        for one in spread.value:
            one.forget()

    columns = [f"{name}_{i}" for i in range(FOLDS + 1) for name in FEATURES]
    seen = rows.mapInArrow(run, "doc_id long, toxic int, fold int, " + ", ".join(f"{c} double" for c in columns)).toPandas().sort_values("doc_id")
    x, y, fold = seen[columns].to_numpy(float).reshape(len(seen), FOLDS + 1, len(FEATURES)), seen["toxic"].to_numpy(float), seen["fold"].to_numpy()
    raw = np.zeros(len(y))
    for f in np.unique(fold).tolist():
        own = fold == f
        raw[own] = Trees().fit(x[~own, f], y[~own]).raw(x[own, f]) if (~own).any() else 0.0
    return ToxicityModel(lexicons[-1], Trees().fit(x[:, -1], y), isotonic(raw, y), prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, spark: SparkSession) -> DataFrame:
    """Every row of docs: doc_id and score (0 to 1) of its whole text; a null text is an empty one."""
    spread = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spread.value.score(batch.column("text").to_pylist()))], ["doc_id", "score"])
        spread.value.lexicon.forget()

    return docs.select("doc_id", text_bytes()).mapInArrow(run, "doc_id long, score double")


def reject_toxic(docs: DataFrame, model: ToxicityModel, spark: SparkSession, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold."""
    spread, names = spark.sparkContext.broadcast(model), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("").cast(pa.binary())
            named = pa.RecordBatch.from_arrays([texts], ["text"])
            scores = [spread.value.score(part.column("text").to_pylist()) for part in slices(iter([named]), "text")]
            yield batch.filter(pa.array(np.concatenate([*scores, np.zeros(0)]) < threshold))
        spread.value.lexicon.forget()
        give_back()

    # Names with dots would not be found by mapInArrow.
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op3_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.where(~held_out()), spark)
    return score_toxicity(docs, model, spark).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
