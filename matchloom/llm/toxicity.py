"""Toxicity by class-conditional Kneser-Ney models.

A character 7-gram model of toxic texts is compared with one of ordinary texts. Both discount their own 7-gram counts
and back off to one *shared* model of shorter grams, built from continuation counts of both classes together: a rare
expression is smoothed alike on either side, so only what the classes really say differently moves the score.

A word's evidence is the difference of its two log-likelihoods; evidence is length-normalised over windows of a few
words and over the whole text. A logistic curve, fitted on labelled texts that its models have not seen, turns the
strongest window, the mean, the strongest words and the length into a score from 0 to 1.

Fitting uses a bounded sample: about ``toxic_rows`` and ``ordinary_rows`` labelled texts, chosen by a hash of the id,
whose word counts fit one process. Scoring is one pass without a shuffle. Null texts and texts without letters get the
score of no evidence. Without labels of both classes every score is the base rate (0 without labels). If a document
has several labels the highest counts. Rows are independent: repeats get equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.tables import col, fresh, hashed_out
from matchloom.llm.words import mix
from matchloom.plans.scratch import materialise

ORDER = 7
TOXIC_ROWS, ORDINARY_ROWS = 2000, 3000
CUTOFF = 0.3
_DISCOUNT = 0.75
_WINDOW = 2
_STRONGEST = 8
FEATURES = 4
_CACHE_WORDS = 200_000
_POWERS = np.cumprod(np.full(ORDER, 0x9E3779B97F4A7C15, np.uint64))
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Positions:
    """The predicted characters of many words, and hashes of what ends at or before each; one order at a time."""

    def __init__(self, words: list[str]):
        pad = "\x02" * (ORDER - 1)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        self.codes = np.frombuffer("".join(pad + w + "\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        self.ends = np.arange(len(self.owner)) + (self.owner.astype(np.int64) + 1) * (ORDER - 1)

    def gram(self, m: int, skip: int = 0) -> np.ndarray:
        """Hash of the m characters that end ``skip`` before each position."""
        value = np.zeros(len(self.ends), np.uint64)
        for back in range(m):
            value += (self.codes[self.ends - back - skip].astype(np.uint64) + np.uint64(1)) * _POWERS[back]
        return mix(value ^ np.uint64(m))

    def before(self, m: int) -> np.ndarray:
        return self.gram(m, 1)


@dataclass(frozen=True)
class Table:
    """Sorted keys with columns of numbers; a missing key has zeros."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, *columns: np.ndarray) -> Table:
        unique, at = np.unique(keys, return_inverse=True)
        return Table(unique, np.stack([np.bincount(at, weights=c, minlength=len(unique)) for c in columns], 1).astype(np.float32))

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at] * (self.keys[at] == keys)[:, None]


@dataclass(frozen=True)
class KneserNey:
    top: Table  # 7-gram: toxic, ordinary count
    above: Table  # the 6 characters before: toxic, ordinary count, toxic, ordinary number of next characters
    lower: list[Table]  # m-gram: continuation count
    below: list[Table]  # m-1 characters: sum of continuation counts, number of next characters
    alphabet: int

    @staticmethod
    def fit(words: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> KneserNey:
        at = Positions(words)
        top_keys = at.gram(ORDER)
        top = Table.of(top_keys, toxic[at.owner], ordinary[at.owner])
        first = np.unique(top_keys, return_index=True)[1]
        n = top.get(top_keys[first])
        above = Table.of(at.before(ORDER - 1)[first], n[:, 0], n[:, 1], (n[:, 0] > 0) * 1.0, (n[:, 1] > 0) * 1.0)
        lower, below, longer = [], [], first
        for m in range(ORDER - 1, 0, -1):  # an m-gram continues as many histories as there are distinct m+1-grams that end in it
            keys = at.gram(m)[longer]
            table = Table.of(keys, np.ones(len(keys)))
            each = longer[np.unique(keys, return_index=True)[1]]
            lower.append(table)
            below.append(Table.of(at.before(m - 1)[each], table.values[:, 0], np.ones(len(each))))
            longer = each
        return KneserNey(top, above, lower[::-1], below[::-1], max(2, len(np.unique(at.codes))))

    def evidence(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        at = Positions(words)
        p = np.full(len(at.owner), 1.0 / self.alphabet)
        for m, (table, sums) in enumerate(zip(self.lower, self.below)):
            c, s = table.get(at.gram(m + 1))[:, 0], sums.get(at.before(m))
            seen = s[:, 0] > 0
            total = np.where(seen, s[:, 0], 1.0)
            p = np.where(seen, (np.maximum(c - _DISCOUNT, 0) + _DISCOUNT * s[:, 1] * p) / total, p)
        c, s = self.top.get(at.gram(ORDER)), self.above.get(at.before(ORDER - 1))
        sides = []
        for side in (0, 1):
            n, seen = s[:, side], s[:, side] > 0
            sides.append(np.where(seen, (np.maximum(c[:, side] - _DISCOUNT, 0) + _DISCOUNT * s[:, 2 + side] * p) / np.where(seen, n, 1.0), p))
        return np.bincount(at.owner, weights=np.log(sides[0]) - np.log(sides[1]), minlength=len(words))


class Evidence(dict):
    """Evidence of words, remembered for frequent ones within a bounded memory."""

    def __init__(self, model: KneserNey):
        super().__init__()
        self.model = model

    def learn(self, words: list[str]) -> None:
        new = list({w for w in words if w not in self})
        if len(self) + len(new) > _CACHE_WORDS:
            self.clear()
            new = list(set(words))
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            self.update(zip(some, self.model.evidence(some).tolist()))


def features(words: list[str], evidence: Evidence) -> tuple[float, ...]:
    """Strongest window and mean (both per character), mean of the strongest words, log of the number of words."""
    if not words:
        return (0.0,) * FEATURES
    e = np.fromiter(map(evidence.__getitem__, words), np.float64, len(words))
    n = np.fromiter(map(len, words), np.float64, len(words)) + 1
    if len(words) < _WINDOW:
        best = float(e.sum() / n.sum())
    else:
        ones = np.ones(_WINDOW)
        best = float((np.convolve(e, ones, "valid") / np.convolve(n, ones, "valid")).max())
    top = np.sort(e)[::-1][:_STRONGEST]
    return best, float(e.sum() / n.sum()), float(top.sum() / _STRONGEST), float(np.log(len(words)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; x has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    language: KneserNey | None
    weights: np.ndarray
    base: float

    def score(self, rows: list[tuple[float, ...]]) -> np.ndarray:
        if self.language is None:
            return np.full(len(rows), self.base)
        x = np.concatenate((np.array(rows).reshape(-1, FEATURES), np.ones((len(rows), 1))), 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _batches_of(texts: list[str | None], evidence: Evidence) -> Iterator[tuple[float, ...]]:
    """Features of texts; words new to the cache are evaluated for many texts at once."""
    at = 0
    while at < len(texts):
        words, held = [], 0
        while at < len(texts) and held < 100_000:
            words.append(words_of(texts[at]))
            held += len(words[-1])
            at += 1
        evidence.learn([w for ws in words for w in ws])
        for ws in words:
            yield features(ws, evidence)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counter()
    for batch in batches:
        for toxic, fold, text in zip(*(c.to_pylist() for c in batch.columns)):
            for word, n in Counter(words_of(text)).items():
                counts[word, fold, toxic] += n
    keys = list(counts)
    for at in range(0, len(keys), 100_000):
        some = keys[at : at + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in some], pa.string()), pa.array([k[1] for k in some], pa.int32()), pa.array([k[2] for k in some], pa.int32()), pa.array([counts[k] for k in some], pa.int64())],
            names=["word", "fold", "toxic", "n"],
        )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    toxic_rows: int = TOXIC_ROWS,
    ordinary_rows: int = ORDINARY_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Models from labelled documents. ``labels`` must hold only rows that may be learned from."""
    one = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.max(col(label_col)).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model(None, np.zeros(FEATURES + 1), 1.0 if n.get(1) else 0.0)
    share = F.when(F.col("toxic") == 1, min(1.0, toxic_rows / n[1])).otherwise(min(1.0, ordinary_rows / n[0]))
    key = F.xxhash64("id", F.lit("toxicity"))
    chosen = one.filter(F.pmod(key, F.lit(1 << 30)) < share * (1 << 30)).withColumn("fold", F.pmod(F.shiftright(key, 32), F.lit(2)).cast("int"))
    # bounded by toxic_rows + ordinary_rows, whatever the number of labels
    joined = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    stored = materialise(joined.filter("text is not null").select("toxic", "fold", "text"), "toxicity-sample")
    got = stored.mapInArrow(_word_counts, "word string, fold int, toxic int, n long").toArrow()
    if not got.num_rows:
        return Model(None, np.zeros(FEATURES + 1), 0.0)
    encoded = got["word"].combine_chunks().dictionary_encode()
    words, at = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
    fold, toxic, count = (got[c].to_numpy() for c in ("fold", "toxic", "n"))

    def counts(rows: np.ndarray) -> KneserNey:
        t, o = (np.bincount(at[rows & (toxic == side)], weights=count[rows & (toxic == side)], minlength=len(words)) for side in (1, 0))
        used = np.flatnonzero(t + o)
        return KneserNey.fit([words[i] for i in used], t[used], o[used])

    x, y, columns = [], [], [f"f{i}" for i in range(FEATURES)]
    for part in (0, 1):
        if not (fold != part).any():
            continue
        half = docs.sparkSession.sparkContext.broadcast(counts(fold != part))

        def run(batches: Iterator[pa.RecordBatch], half=half) -> Iterator[pa.RecordBatch]:
            evidence = Evidence(half.value)
            for batch in batches:
                rows = list(_batches_of(batch.column("text").to_pylist(), evidence))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c, pa.float64()) for c in zip(*rows))], names=["toxic", *columns])

        rows = stored.filter(F.col("fold") == part).select("toxic", "text").mapInArrow(run, ", ".join(["toxic int", *(f"{c} double" for c in columns)])).toPandas()
        rows = rows.sort_values([*columns, "toxic"])
        half.destroy()
        x.append(rows[columns].to_numpy()), y.append(rows["toxic"].to_numpy(float))
    x, y = np.concatenate(x), np.concatenate(y)
    weights = logistic(np.concatenate((x, np.ones((len(x), 1))), 1), y)
    # the sample holds a larger share of the toxic rows: back to the odds of all labelled rows
    weights[-1] += np.log(n[1] / n[0]) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return Model(counts(np.ones(len(at), bool)), weights, float(y.mean()))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` plus a score from 0 to 1; and the name of that column."""
    (out,) = fresh(docs.columns, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        evidence = Evidence(m.language)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            rows = list(_batches_of(texts, evidence)) if m.language else [(0.0,) * FEATURES] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(m.score(rows), 9))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])), out


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels that are not held out, score every document."""
    held: Column = hashed_out("doc_id", 4, 2)
    model = fit(docs, labels.filter(~held))
    got, out = score(docs.select("doc_id", "text"), model)
    s = F.col(out)
    return got.select("doc_id", held.alias("held_out"), s.alias("score"), (s >= CUTOFF).cast("int").alias("predicted"))
