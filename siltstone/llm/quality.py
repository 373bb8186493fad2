"""Text quality of documents: statistics, and shares of prose, list, table and junk by a hidden Markov model over lines.

The model's states are the four shapes. What a line looks like under each comes from small networks over its line statistics,
divided by the shapes' frequencies; how shapes follow each other is counted. Both are fitted on a bounded sample of hand-labelled
documents: a document's lines start with its label, then are labelled anew by the model itself, prose or the document's
label, since lists, tables and junk often come with lines of prose. The most likely sequence of shapes then labels
every line of every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.linestats import Lines, lines, word_hash
from siltstone.llm.tokens import _slices

SHAPES = ("prose", "list", "table", "junk")
MOST_LABELLED = 4000  # documents the model is fitted on at most, those with the least hashes of their ids
MOST_CHARS = 1_000_000  # labelled documents longer than this are not learned from
NETS, HIDDEN, STEPS, SHRINK, ROUNDS = 3, 32, 3000, 1e-3, 2
TOLD = 0.7  # how far the shapes' frequencies are divided out
SLICE_BYTES = 4 << 20


@dataclass
class Model:
    """What a worker needs to label lines; without labels every line is prose."""

    common: np.ndarray
    pairs: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    nets: tuple = ()
    prior: np.ndarray | None = None
    first: np.ndarray | None = None
    follow: np.ndarray | None = None

    def emissions(self, x: Lines) -> np.ndarray:
        z = np.clip((x.features - self.mean) / self.scale, -4, 4)
        return np.mean([_log_shares(net, z) for net in self.nets], axis=0) - TOLD * self.prior

    def label(self, x: Lines) -> np.ndarray:
        if not self.nets:
            return np.zeros(len(x.doc), np.int64)
        return most_likely(self.emissions(x), x.doc, self.first, self.follow)


def _log_shares(net: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    q = np.tanh(z @ net[0] + net[1]) @ net[2] + net[3]
    q -= q.max(1, keepdims=True)
    return q - np.log(np.exp(q).sum(1, keepdims=True))


def _fit_net(z: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> list[np.ndarray]:
    g = np.random.default_rng(seed)
    n, d, k = len(z), z.shape[1], len(SHAPES)
    net = [g.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), g.normal(0, 0.1, (HIDDEN, k)), np.zeros(k)]
    mean, square = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    weight = weight / weight.mean()
    order, at = g.permutation(n), 0
    for step in range(1, STEPS + 1):
        if at >= n:
            order, at = g.permutation(n), 0
        i = order[at : at + 256]
        at += 256
        a = np.tanh(z[i] @ net[0] + net[1])
        d2 = np.exp(_log_shares(net, z[i]))
        d2[np.arange(len(i)), y[i]] -= 1
        d2 *= weight[i][:, None] / len(i)
        d1 = (d2 @ net[2].T) * (1 - a * a)
        slopes = [z[i].T @ d1 + SHRINK * net[0], d1.sum(0), a.T @ d2 + SHRINK * net[2], d2.sum(0)]
        rate = 3e-3 * (1 - (step - 1) / STEPS)
        for p, m, v, s in zip(net, mean, square, slopes):
            m *= 0.9
            m += 0.1 * s
            v *= 0.999
            v += 0.001 * s * s
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def most_likely(emission: np.ndarray, doc: np.ndarray, first: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """The most likely state of each row, rows of one document being a sequence; all documents step by step together."""
    n, k = emission.shape
    if not n:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    place = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
    order = np.argsort(place, kind="stable")
    steps = np.searchsorted(place[order], np.arange(place.max() + 2))
    score, came = np.empty((n, k)), np.zeros((n, k), np.int8)
    i = order[steps[0] : steps[1]]
    score[i] = emission[i] + first
    for s in range(1, len(steps) - 1):
        i = order[steps[s] : steps[s + 1]]
        ways = score[i - 1][:, :, None] + follow
        came[i] = ways.argmax(1)
        score[i] = ways.max(1) + emission[i]
    state = np.zeros(n, np.int64)
    last = np.r_[doc[1:] != doc[:-1], True]
    state[last] = score[last].argmax(1)
    for s in range(len(steps) - 2, 0, -1):
        i = order[steps[s] : steps[s + 1]]
        state[i - 1] = came[i, state[i]]
    return state


def _chain(state: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of how often a document starts in a state and how states follow each other, counts from one up."""
    k = len(SHAPES)
    same = doc[1:] == doc[:-1]
    starts = np.bincount(state[np.r_[True, ~same]], minlength=k) + 1.0
    pairs = np.ones((k, k)) + 8 * np.eye(k)
    np.add.at(pairs, (state[:-1][same], state[1:][same]), 1)
    return np.log(starts / starts.sum()), np.log(pairs / pairs.sum(1, keepdims=True))


def _pair_scores(x: Lines, prose: np.ndarray, n: int) -> np.ndarray:
    """How much more often words follow each other in prose than if their order were any (logarithm)."""
    near = (x.word_line[1:] == x.word_line[:-1]) & prose[x.doc[x.word_line[1:]]] if len(x.word_line) else np.zeros(0, bool)
    seen = np.zeros((n, n))
    np.add.at(seen, (x.word_id[:-1][near], x.word_id[1:][near]), 1)
    by_chance = (seen.sum(1)[:, None] + 1) * (seen.sum(0)[None, :] + 1) / (seen.sum() + 1)
    return np.clip(np.log((seen + 0.5) / (by_chance + 0.5)), -4, 4)


def common_hashes(common: DataFrame) -> np.ndarray:
    """Hashes of the common words, a table of a few hundred rows."""
    words = common.select(F.lower("word").alias("w")).filter("w <> ''").distinct()
    return np.unique(word_hash([r.w for r in words.toLocalIterator()]))


def labelled(labels: DataFrame, docs: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, shape): at most ``most`` documents with the label most annotators gave; without one, none."""
    votes = labels.filter(F.col("shape").isin(*SHAPES) & F.col("doc_id").isNotNull()).groupBy("doc_id", "shape").agg(F.countDistinct(F.coalesce("annotator", F.lit(""))).alias("n"))
    best = votes.groupBy("doc_id").agg(F.max("n").alias("top"), F.collect_list(F.struct("n", "shape")).alias("all"))  # at most four shapes
    best = best.withColumn("won", F.filter("all", lambda v: v["n"] == F.col("top"))).filter("size(won) = 1")
    best = best.select("doc_id", F.get("won", F.lit(0))["shape"].alias("shape")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").filter((F.length("text") > 0) & (F.length("text") <= MOST_CHARS))
    return texts.join(F.broadcast(best), "doc_id")


def fit(labels: DataFrame, docs: DataFrame, common: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The model of a bounded sample of labelled documents, fitted on the driver; the same for the same rows."""
    hashes = common_hashes(common)
    rows = sorted((r.doc_id, r.text, SHAPES.index(r["shape"])) for r in labelled(labels, docs, most).collect())
    texts, given = [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
    if not texts or not len(lines(texts, hashes).doc):
        return Model(hashes)
    pairs = _pair_scores(lines(texts, hashes), given == 0, len(hashes) + 1)
    x = lines(texts, hashes, pairs)
    mean, scale = x.features.mean(0), x.features.std(0) + 1e-6
    z = np.clip((x.features - mean) / scale, -4, 4)
    own = given[x.doc]
    weight = np.minimum(x.chars, 200).astype(float)
    state = own.copy()
    barred = np.ones((len(own), len(SHAPES)), bool)
    barred[:, 0] = False
    barred[np.arange(len(own)), own] = False
    for r in range(ROUNDS):
        nets = tuple(_fit_net(z, state, weight, s) for s in range(NETS))
        prior = np.log(np.maximum(np.bincount(state, weight, len(SHAPES)) / weight.sum(), 0.02))
        first, follow = _chain(state, x.doc)
        model = Model(hashes, pairs, mean, scale, nets, prior, first, follow)
        if r + 1 < ROUNDS:
            state = most_likely(np.where(barred, -1e3, model.emissions(x)), x.doc, first, follow)
    return model


STATS = "n_words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double"


def _sums(x: Lines, n: int) -> list[pa.Array]:
    by = lambda v: np.bincount(x.doc, v.astype(np.float64), n)
    count, words, filled = np.bincount(x.doc, minlength=n), by(x.words), by(x.filled)
    share = lambda a, b: pa.array(a / np.maximum(b, 1), pa.float64(), mask=b == 0)
    return [pa.array(words.astype(np.int64)), share(by(x.letters_in_words), words), share(by(x.symbols), filled), share(by(x.ends_well), count), share(by(x.common), words)]


def statistics(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, n_words, mean_word_length, symbol_ratio, punctuated_lines, common_words) of each document.

    Symbols are characters but letters, marks, digits and blanks, as a share of those that are no blanks. Lines that are not blank
    count as punctuated if a sentence mark ends them, closing quotes or brackets aside. Texts without words have 0 words
    and null shares; null, empty and blank texts are without lines too. Rows are taken one by one.
    """
    return _over(docs, Model(common_hashes(common)), False)


def shapes(docs: DataFrame, model: Model) -> DataFrame:
    """statistics() and the shares of prose, list, table and junk in each document's lines, by their characters.

    The shares are null for texts without a line.
    """
    return _over(docs, model, True)


def _over(docs: DataFrame, model: Model, with_shapes: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB
    schema = f"doc_id {kind}, {STATS}" + "".join(f", {s} double" for s in SHAPES) * with_shapes

    def run(batches):
        m = shared.value
        for b in _slices(batches, SLICE_BYTES):
            texts = [t or "" for t in b.column(1).to_pylist()]
            x = lines(texts, m.common, m.pairs if with_shapes else None)
            cols = [b.column(0), *_sums(x, len(texts))]
            if with_shapes:
                state, size = m.label(x), x.chars.astype(np.float64)
                all_ = np.bincount(x.doc, size, len(texts))
                cols += [pa.array(np.bincount(x.doc, size * (state == s), len(texts)) / np.maximum(all_, 1), pa.float64(), mask=all_ == 0) for s in range(len(SHAPES))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[f.split()[0] for f in STATS.split(", ")], *SHAPES[: len(SHAPES) * with_shapes]])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def not_prose(shaped: DataFrame) -> DataFrame:
    """The documents of which less than half is prose; null, empty and blank texts are not among them."""
    return shaped.filter(F.col("prose") < 0.5).select("doc_id")
