"""Language identification: averaged hashed subword embeddings, linear softmax.

A word, in lower case and between ``<`` and ``>``, gives its byte n-grams, each
hashed to a row of an embedding table. A text's vector is the mean over all its
n-grams; a linear layer and a softmax follow. Table and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample. As all is
linear up to the softmax, a word's part is one short row, found once a word.

A tenth of the sample is held back to calibrate the scores: the temperature that
makes the likelihood of its labels highest, with the least sure of them counted
once more as wrong, as a sample without an error says nothing of how sure to
be. A score is then the chance of being right, and a prediction that is more
likely wrong than right (``reject_below``) is rejected.

The label of a text that is null or has no letter is ``und`` with score 0. A
training row needs a text with a letter and a label; with no such row, all is
``und``. Repeated rows train and predict one by one; extra columns are ignored.
A text of any length is scored whole; only training looks at parts of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokenize import in_chunks, release

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds and sizes of the model; the sample's bound is rows x characters. In
    each pass a training text counts with at most ``words_a_step`` words, drawn anew."""

    sample_rows: int = 6000
    sample_chars: int = 20_000
    buckets: int = 1 << 15
    width: int = 16
    orders: tuple[int, ...] = (1, 2, 3, 4)
    epochs: int = 3
    words_a_step: int = 80
    batch: int = 64
    rate: float = 6.0
    reject_below: float = 0.5
    seed: int = 7


def word_grams(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of all words, and how many each word has."""
    data = np.frombuffer(("<" + "><".join(words) + ">").encode(), np.uint8).astype(np.uint32)
    opens = np.flatnonzero(data == ord("<")) if not any("<" in w or ">" in w for w in words) else None
    if opens is None:
        sizes = np.array([len(w.encode()) + 2 for w in words])
        opens = np.cumsum(sizes) - sizes
    left = np.append(opens[1:], len(data))
    word = np.repeat(np.arange(len(words)), left - opens)
    room = np.repeat(left, left - opens) - np.arange(len(data))  # bytes to the word's end
    h = np.zeros(len(data), np.uint32)
    ids, owner = [], []
    for n in range(1, max(s.orders) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ data[n - 1 :]) * np.uint32(16777619) + np.uint32(n)
        if n in s.orders:
            ok = room[:m] >= n
            x = h[ok]
            x = x ^ (x >> np.uint32(15))
            x = x * np.uint32(2246822519)
            ids.append(((x ^ (x >> np.uint32(13))) % np.uint32(s.buckets)).astype(np.int64))
            owner.append(word[:m][ok])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=len(words))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of each text (null: of an empty one)."""
    return pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels: each n-gram's part of the logits
    bias: np.ndarray
    settings: Settings
    temperature: float = 1.0
    threshold: float = 0.0
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the n-grams' parts and their number, for each of the words."""
        ids, n = word_grams(words, self.settings)
        upto = np.cumsum(self.table[ids], axis=0, dtype=np.float64)
        ends = np.cumsum(n)
        sums = upto[ends - 1]
        return np.diff(sums, axis=0, prepend=np.zeros((1, sums.shape[1]))), n

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probabilities, one row a text."""
        lists = words_of(texts)
        coded = pc.dictionary_encode(lists.flatten())
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        sums, n = np.zeros((len(words), len(self.labels))), np.zeros(len(words))
        some = [i for i, w in enumerate(words) if w]
        for a in range(0, len(some), 20_000):
            part = some[a : a + 20_000]
            sums[part], n[part] = self.rows([words[i] for i in part])
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        upto = np.concatenate([np.zeros((1, len(self.labels))), np.cumsum(sums[at], axis=0)])
        count = np.concatenate([[0], np.cumsum(n[at])])
        total = upto[ends[1:]] - upto[ends[:-1]]
        logits = total / np.maximum(1, count[ends[1:]] - count[ends[:-1]])[:, None] + self.bias
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: Temperatures that are tried.
TEMPERATURES = np.geomspace(1e-3, 1e2, 251)


def calibrated(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of highest likelihood, with the least sure label counted once
    more as the wrong one next to it."""
    n = len(logits)
    others = logits.copy()
    others[np.arange(n), truth] = -np.inf
    least = (logits[np.arange(n), truth] - others.max(axis=1)).argmin()
    logits, truth = np.vstack([logits, logits[least]]), np.append(truth, others[least].argmax())

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(n + 1), truth]).sum())

    return float(min(TEMPERATURES, key=loss))


def train(texts: list[str], langs: list[str], s: Settings) -> Model | None:
    """Fit, then calibrate on each tenth row. Rows come in an order of their own."""
    rows = [(t, y) for t, y in zip(texts, langs, strict=True) if y is not None and has_letter(t)]
    labels = sorted({y for _, y in rows})
    if not rows:
        return None
    rng, k = np.random.default_rng(s.seed), len(labels)
    y = np.array([labels.index(v) for _, v in rows])
    # kept as Arrow: as objects of their own, the words would take ten times the room
    lists = words_of(pa.array([t for t, _ in rows], pa.large_string()))
    real = pc.greater(pc.binary_length(lists.values), 0)  # not the empty ones beside outer white space
    words = lists.values.filter(real)
    first = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()]
    held = np.arange(len(rows)) % 10 == 9 if len(rows) >= 50 else np.zeros(len(rows), bool)
    fit = np.flatnonzero(~held)
    emb = rng.normal(0, 0.1, (s.buckets, s.width)).astype(np.float32)
    out = np.zeros((s.width, k), np.float32)
    bias = np.zeros(k, np.float32)
    if k > 1:
        steps = s.epochs * -(-len(fit) // s.batch)
        step = 0
        for _ in range(s.epochs):
            order = rng.permutation(fit)
            for a in range(0, len(order), s.batch):
                rate = s.rate * (1 - step / steps)
                step += 1
                batch = order[a : a + s.batch]
                chosen = [np.arange(a, b) if b - a <= s.words_a_step else rng.integers(a, b, s.words_a_step) for a, b in zip(first[batch], first[batch + 1])]
                picked = [words.take(pa.array(c)).to_pylist() for c in chosen]
                ids, n = word_grams([w for p in picked for w in p], s)
                grams = np.add.reduceat(n, np.cumsum([0] + [len(p) for p in picked[:-1]]))
                ends = np.cumsum(grams)
                mean = np.add.reduceat(emb[ids], ends - grams, axis=0) / grams[:, None]
                p = softmax(mean @ out + bias)
                p[np.arange(len(batch)), y[batch]] -= 1
                p /= len(batch)
                back = (p @ out.T) / grams[:, None]
                out -= rate * (mean.T @ p)
                bias -= rate * 0.1 * p.sum(axis=0)
                np.add.at(emb, ids, (-rate * len(batch) * np.repeat(back, grams, axis=0)).astype(np.float32))
    model = Model(labels, (emb @ out).astype(np.float32), bias.astype(np.float64), s)
    if held.any() and k > 1:
        kept = pa.array([rows[i][0] for i in np.flatnonzero(held)])
        logits, truth = np.log(np.maximum(model.scores(kept), 1e-300)), y[held]
        model.temperature = calibrated(logits, truth)
        model.threshold = s.reject_below
    return model


def held_out(doc_id: Column) -> Column:
    """True for the held-out quarter: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """Rows to learn from: those with an id that is not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Train on at most ``sample_rows`` labelled rows of at most ``sample_chars``
    characters, chosen by a hash of the id, outside the held-out quarter."""
    pool = docs.select("doc_id", "text", "lang").filter(trainable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= settings.sample_chars))
    # a share of the ids by hash, a little over the bound, so that tasks send no more than that together
    share = 1.2 * settings.sample_rows / max(1, pool.count())
    chosen = pool.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    rows = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "lang").limit(settings.sample_rows).select("text", "lang").toArrow()
    model = train(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), settings)
    release()
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with lang_pred, score and rejected,
    which replace columns of these names. Only the text is looked at."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    given = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    names = [*given, "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in in_chunks(batch, size=4_000_000):
                texts = part.column("text")
                known = np.array([has_letter(t.as_py()) for t in texts], bool)
                label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if m is not None:
                    p = m.scores(texts)
                    best = p.argmax(axis=1)
                    label = [m.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    score = np.where(known, p.max(axis=1), 0.0)
                rejected = ~known | (score < (m.threshold if m else 0))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in given), pa.array(label, pa.string()), pa.array(score), pa.array(rejected)], names)
        release()

    schema = docs.select(*given).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*dict.fromkeys([*given, "text"])).mapInArrow(run, schema)
