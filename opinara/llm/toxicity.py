"""Toxicity by weak supervision.

Voters: hand-written lexicons by kind of insult; lexicons of words and of word beginnings that the
labelled rows show in toxic texts, split into several voters, and a voter of those with less
evidence; patterns (shouting, marks of anger, insults near "you"). A voter says toxic or nothing. A
generative label model with class-conditional rates of every answer (accuracies) and correlations
inside the classes is started on the labels and refined by expectation-maximisation over the votes
alone. Labels build the induced lexicons and calibrate the rates; a label is never a vote, and the
posterior of a row depends on its votes only. The posteriors, not the labels, train a logistic
classifier on hits in each lexicon and on hashed words and word beginnings, which scores every text.
A hashed feature enters with a size that grows with its evidence, so words that met toxic texts by
chance stay weak.

Feature counts are aggregated by Spark; the driver receives at most ``FEATURES`` of them and, per
sampled row, the votes and the numbers of its features. The sample is bounded by ``LABELLED``
labelled rows; copies and near copies in it are thinned, so that their rare words count once. Empty
and null texts score as a text without any sign; repeated rows are scored one by one. Without
labelled rows of both classes the hand-written lexicons decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textvec as tv
from opinara.llm.sampling import fold, labelled_sample
from opinara.session import staged

LABELLED = 8192  # bound of the labelled rows that the model is fitted on
FEATURES = 4096
SUPPORT = 3  # texts that must hold a feature
HEADS = (4, 5, 6)
SPLITS = 3
THIN = 3
ANCHOR = 3.0  # weight of the answers counted by label beside those of a round

# Common insults by kind, lower case.
LEXICONS = {
    "intelligence": "idiot idiots stupid moron morons dumb fool imbecile dimwit clown clowns",
    "worth": "worthless loser losers pathetic useless trash garbage scum vermin filth lowlife",
    "disgust": "disgusting vile repulsive revolting sickening nasty hideous",
    "hostility": "damn bastard bastards bitch crap shit fuck fucking asshole",
}
YOU = "you your du ihr tu vous toi usted"


def _hashes(text: str) -> np.ndarray:
    return np.unique(tv.words(pa.array([text]), tv.MARKS).hash)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, tv.Words]:
    """(row, feature) of all words and word beginnings, repeats included."""
    w = tv.words(column, tv.MARKS, heads=HEADS)
    row, value = [w.row], [w.hash]
    for k in HEADS:
        head = w.extra[f"head{k}"]
        # Also a word that is exactly its own beginning.
        whole = (w.end - w.start) == k
        row.append(w.row[(head != 0) | whole])
        value.append(tv.mix(np.where(whole, w.hash, head)[(head != 0) | whole], 40 + k))
    return np.concatenate(row), np.concatenate(value), w


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least hashes of each text's 5-word runs under ``THIN`` orders; near copies share some."""
    for whole in batches:
        for part in tv.slices(whole, "text", 1 << 20):
            w = tv.words(part.column(1))
            at, h = tv.grams(w, 5)
            out = []
            for seed in range(THIN):
                low = tv.mix(part_ids(part), 70 + seed)
                own = np.full(part.num_rows, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(own, w.row[at], tv.mix(h, 60 + seed))
                none = np.bincount(w.row[at], minlength=part.num_rows) == 0
                out.append(pa.array(tv.signed(np.where(none, low, own))))
            names = [f"m{i}" for i in range(THIN)]
            yield pa.RecordBatch.from_arrays([*part.columns, *out], [*part.schema.names, *names])


def part_ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def thinned(sample: DataFrame) -> DataFrame:
    """The sample with one text of most groups of near copies."""
    marks = "".join(f", m{i} long" for i in range(THIN))
    out = sample.mapInArrow(_thin, "doc_id long, text string, label int" + marks)
    for i in range(THIN):
        out = out.dropDuplicates([f"m{i}"])
    return staged(out.select("doc_id", "text", "label"), "toxicity-sample")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each sampled row with its label."""
    for whole in batches:
        for part in tv.slices(whole, "text", 1 << 20):
            row, value, _ = features(part.column(1))
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            label = part.column(2).to_numpy(zero_copy_only=False)[row[new]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tv.signed(value[new])), pa.array(label.astype(np.int32))],
                ["feature", "label"],
            )


def chosen_features(sample: DataFrame, positive: int, negative: int) -> list:
    """The features that tell the classes apart best, with their counts. At most FEATURES rows."""
    n = F.count("*").cast("double")
    table = (
        sample.mapInArrow(_listed, "feature long, label int")
        .groupBy("feature")
        .agg(n.alias("n"), F.sum("label").cast("double").alias("t"))
        .filter(F.col("n") >= SUPPORT)
    )
    rate = F.lit(positive / max(positive + negative, 1))
    spread = F.sqrt(F.col("n") * rate * (1 - rate) + 1)
    table = table.withColumn("z", (F.col("t") - F.col("n") * rate) / spread)
    return table.orderBy(F.abs("z").desc(), "feature").limit(FEATURES).collect()


def lexicons(strong: list[int], weak: list[int]) -> list[np.ndarray]:
    """Hashes of the hand-written lexicons, of the strong induced words in ``SPLITS`` parts, of the weak."""
    groups: list[list[int]] = [[] for _ in range(SPLITS)]
    for value in strong:
        groups[value % SPLITS].append(value)
    hand = [_hashes(words) for words in LEXICONS.values()]
    return hand + [np.unique(np.array(g, np.uint64)) for g in [*groups, weak]]


class Voters:
    """Lexicon and pattern voters of a batch of texts."""

    def __init__(self, lists: list[np.ndarray]):
        self.lists = lists
        self.sieves = [tv.sieve(x) for x in self.lists]
        self.you = _hashes(YOU)

    def votes(self, column: pa.Array) -> np.ndarray:
        """Rows x voters: 1 toxic, 0 nothing to say. The label model also takes -1, clean."""
        row, value, w = features(column)
        rows = len(column)
        hits = np.zeros((rows, len(self.lists)), np.int64)
        for j, (keys, sieve) in enumerate(zip(self.lists, self.sieves, strict=True)):
            at, _ = tv.find(keys, value, sieve)
            hits[:, j] = np.bincount(row[at], minlength=rows)
        insult = np.isin(w.hash, np.concatenate(self.lists))
        near = np.zeros(rows, np.int64)
        for back in (1, 2, 3):
            if len(w) > back:
                same = w.row[back:] == w.row[:-back]
                pair = insult[back:] & np.isin(w.hash[:-back], self.you)
                np.add.at(near, w.row[back:][same & pair], 1)
        shout, angry = [], []
        for t in column.to_pylist():
            t = t or ""
            letters = sum(map(str.isalpha, t))
            shout.append(sum(map(str.isupper, t)) > 0.6 * letters > 30)
            angry.append(len(re.findall(r"!{2,}|[?!]{3,}", t)) > 3)
        votes = [np.where(hits > 0, 1, 0)]
        total = hits[:, :-1].sum(1, keepdims=True)  # without the words of less evidence
        votes.append(np.where(total > 3, 1, 0))
        votes.append(np.array([shout, angry, near > 0], float).T.reshape(rows, 3))
        return np.concatenate(votes, axis=1).astype(float)


@dataclass
class LabelModel:
    """Two classes, each with its own rates of every voter's answers; correlated voters share weight.

    ``rates[c, j, v + 1]``: share of class ``c`` on which voter ``j`` answers ``v``. ``share[j]`` is 1
    over the sum of the squared correlations of ``j`` with all voters inside the classes: 1 for a
    voter apart from the others, a half for each of two voters that always answer alike.
    """

    prior: float
    rates: np.ndarray
    share: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, label: np.ndarray, rounds: int = 10) -> LabelModel:
        """Start on the labels, then expectation-maximisation over the votes alone.

        The answers counted by label stay as a prior of each round's rates, so that the classes keep
        their meaning; no row's posterior sees its own label.
        """
        r = np.clip(label.astype(float), 0.02, 0.98)
        answers = np.stack([votes < 0, votes == 0, votes > 0], 2).astype(float)
        known = np.einsum("ci,ijv->cjv", np.stack([label == 0, label == 1]).astype(float), answers)
        for _ in range(rounds + 1):
            weight = np.stack([1 - r, r])
            n = weight.sum(1)
            counts = np.einsum("ci,ijv->cjv", weight, answers) + ANCHOR * known + 0.1
            rates = counts / counts.sum(2, keepdims=True)
            off = [votes - (x[:, 2] - x[:, 0]) for x in rates]
            cov = sum((o * w[:, None]).T @ o for o, w in zip(off, weight, strict=True)) / max(n.sum(), 1)
            size = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            share = 1 / np.maximum(((cov / np.outer(size, size)) ** 2).sum(1), 1)
            model = cls(float(np.clip(r.mean(), 1e-3, 1 - 1e-3)), rates, share)
            r = model.posterior(votes)
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic, from the votes alone."""
        gain = np.log(self.rates[1] / self.rates[0]) * self.share[:, None]
        z = gain[np.arange(votes.shape[1]), votes.astype(int) + 1].sum(1)
        return 1 / (1 + np.exp(-np.clip(z + np.log(self.prior / (1 - self.prior)), -30, 30)))

    def accuracies(self) -> np.ndarray:
        """How much more each voter says toxic in toxic texts than in clean ones."""
        mean = self.rates[:, :, 2] - self.rates[:, :, 0]
        return mean[1] - mean[0]


def train_linear(rows, columns, scale, n, target, decay=2e-4, rounds=400, rate=0.1):
    """Logistic weights of the features present, (row, column) pairs of size ``scale``, by Adam."""
    m = len(scale)
    w, b = np.zeros(m), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, (w * scale)[columns], minlength=n) + b
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = scale * np.bincount(columns, off[rows], minlength=m) / n + decay * w
        grad = np.append(grad, off.mean())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-6)
        w, b = w - step[:m], b - step[m]
    return w * scale, b


@dataclass
class Classifier:
    """Weights of the features ``keys``, then of a hit in each lexicon."""

    keys: np.ndarray
    lists: list[np.ndarray]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.sieve = tv.sieve(self.keys)
        self.insults = np.unique(np.concatenate(self.lists))
        self.insult_sieve = tv.sieve(self.insults)

    @property
    def width(self) -> int:
        return len(self.keys) + len(self.lists)

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, column number) of the classifier's features."""
        row, value, _ = features(column)
        at, key = tv.find(self.keys, value, self.sieve)
        pairs = [row[at] * self.width + key]
        at, _ = tv.find(self.insults, value, self.insult_sieve)
        for j, words in enumerate(self.lists):
            hit = at[np.isin(value[at], words)]
            pairs.append(row[hit] * self.width + len(self.keys) + j)
        return np.divmod(np.unique(np.concatenate(pairs)), self.width)

    def score(self, column: pa.Array) -> np.ndarray:
        row, key = self.present(column)
        z = np.bincount(row, self.weights[key], minlength=len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _described(batches, voters: Voters, empty: Classifier) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in tv.slices(whole, "text", 1 << 20):
            votes = voters.votes(part.column(1))
            row, key = empty.present(part.column(1))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(2).cast(pa.int32()),
                    pa.array(list(votes), pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.astype(np.int32))),
                ],
                ["label", "votes", "present"],
            )


def fit(sample: DataFrame) -> tuple[Classifier, LabelModel | None]:
    """Classifier and label model of a bounded sample (doc_id, text, label)."""
    sample = thinned(sample)
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        lists = lexicons([], [])
        return Classifier(np.zeros(0, np.uint64), lists, np.full(len(lists), 4.0), -2.0), None
    found = chosen_features(sample, positive, negative)
    found.sort(key=lambda r: r.feature % (1 << 64))
    keys = np.array([r.feature for r in found], np.int64).view(np.uint64)
    strong = [r.feature % (1 << 64) for r in found if r.z > 3.5 and r.t >= 0.9 * r.n]
    weak = [r.feature % (1 << 64) for r in found if 2 < r.z <= 3.5 and r.t >= 0.75 * r.n]
    lists = lexicons(strong, weak)
    voters = Voters(lists)
    empty = Classifier(keys, lists, np.zeros(len(keys) + len(lists)), 0.0)
    size_of = np.minimum(1.0, np.abs(np.array([r.z for r in found])) / 10) ** 2
    scale = np.concatenate([size_of, np.ones(len(lists))])
    rows = sample.mapInArrow(
        lambda it: _described(it, voters, empty),
        "label int, votes array<double>, present array<int>",
    ).collect()
    votes = np.array([r.votes for r in rows])
    model = LabelModel.fit(votes, np.array([r.label for r in rows]))
    target = model.posterior(votes)
    size = np.array([len(r.present) for r in rows])
    columns = np.fromiter((c for r in rows for c in r.present), np.int64, int(size.sum()))
    w, b = train_linear(np.repeat(np.arange(len(rows)), size), columns, scale, len(rows), target)
    return Classifier(keys, lists, w, b), model


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in tv.slices(whole, "text"):
            scores = model.value.score(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(scores)], ["doc_id", "score"]
            )


def score(docs: DataFrame, model: Classifier, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", "text").mapInArrow(
        lambda it: _scored(it, shared), "doc_id long, score double"
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted); the held-out fold is never learned from."""
    model, _ = fit(labelled_sample(docs, labels, "toxic", LABELLED, parts, held_out))
    out = score(docs, model)
    is_held = F.coalesce(fold("doc_id", parts) == held_out, F.lit(False))
    return out.select("doc_id", is_held.alias("held_out"), "score", "predicted")
