"""Language identification by nearest centroids.

A text becomes a vector of character n-grams (one to three letters, words padded by a space, case folded), hashed to
``DIMS`` places: log(1 + count) times the inverse document frequency, scaled to length 1. Each language has several
centroids, clustered by cosine. A text gets the language of its nearest centroid, and is *rejected* if its cosine is
below the floor of that centroid: a quarter of what all but the outermost thousandth of the centroid's own texts reach.

Fitting uses a bounded sample: about ``per_language`` labelled texts of each language, chosen by a hash of the id. The
model is languages x clusters x ``DIMS`` numbers, whatever the corpus; scoring is one pass without a shuffle.

Null texts and texts without a letter are ``und`` with score 0 and count as rejected. Rows with a null id are scored
and not held out. Without any labelled row every text is ``und``. Rows are independent, so repeats get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.tables import col, fresh, hashed_out
from matchloom.plans.scratch import materialise

UNKNOWN = "und"
DIMS = 8192
PER_LANGUAGE = 600
CLUSTERS = 4
#: Share of what nearly all texts of a centroid reach that a text must reach; short texts stay far below long ones.
FLOOR = 0.25
_SHIFT = np.uint64(64 - 13)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 19
_ROWS = 128


class Grams:
    """Hashed n-gram counts of a text."""

    def __init__(self) -> None:
        self.alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def counts(self, text: str | None) -> np.ndarray | None:
        """None without a letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.alpha[codes]
        if not letter.any():
            return None
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.concatenate(([32], np.where(letter, codes, 32)[keep], [32])).astype(np.uint64)
        total = np.zeros(DIMS, np.int64)
        for at in range(0, len(codes), _CHUNK):
            some = codes[at : at + _CHUNK + 2]
            one = some[: _CHUNK] + np.uint64(1 << 60)
            two = some[:-1] * np.uint64(0x110000) + some[1:] if len(some) > 1 else some[:0]
            three = two[:-1] * np.uint64(0x110000) + some[2:] if len(some) > 2 else some[:0]
            hashed = np.concatenate((one, two[:_CHUNK], three[:_CHUNK])) * _ODD
            total += np.bincount(((hashed ^ (hashed >> np.uint64(29))) * _ODD >> _SHIFT).astype(np.int64), minlength=DIMS)
        return total


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / max(np.sqrt((v * v).sum()), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from the vectors farthest from those already chosen. Centroids, and each row's."""
    centres = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        near = np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[int(near.argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        mine = np.argmax(x @ c.T, axis=1)
        c = np.array([x[mine == j].mean(0) if (mine == j).any() else c[j] for j in range(len(c))])
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        rows = []
        for lang, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (counts := grams.counts(text)) is not None:
                at = np.flatnonzero(counts)
                rows.append((lang, key, at.astype(np.uint16).tobytes(), counts[at].astype(np.int32).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "key", "at", "n"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for at in batch.column("at").to_pylist():
            total[np.frombuffer(at, np.uint16)] += 1
            rows += 1
    yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total.tobytes()])], names=["n", "df"])


def sample(docs: DataFrame, learn: Column, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """About ``per_language`` labelled texts of each language, by a hash of the id: ``lang, key, text``."""
    labelled = docs.filter(learn & col(lang_col).isNotNull() & col(text_col).rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy(col(lang_col).alias("lang")).count().collect()}
    key = F.xxhash64(col(id_col), F.lit("sample"))
    share = F.coalesce(
        *[F.when(col(lang_col) == lang, F.lit(min(1.0, per_language / n))) for lang, n in sorted(counts.items())], F.lit(0.0)
    )
    return labelled.filter(F.pmod(key, F.lit(1 << 30)) < share * (1 << 30)).select(
        col(lang_col).alias("lang"), key.alias("key"), col(text_col).alias("text")
    )


def fit(
    docs: DataFrame,
    learn: Column,
    per_language: int = PER_LANGUAGE,
    clusters: int = CLUSTERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Centroids from the rows that ``learn`` allows. At most some per_language texts are read into one group."""
    chosen = sample(docs, learn, per_language, id_col, text_col, lang_col)
    stored = materialise(chosen.mapInArrow(_vectors, "lang string, key long, at binary, n binary"), "langid-sample")
    parts = stored.mapInArrow(_frequencies, "n long, df binary").collect()
    n = sum(r["n"] for r in parts)
    df = sum((np.frombuffer(r["df"], np.int64) for r in parts), np.zeros(DIMS, np.int64))
    idf = np.log((1 + n) / (1 + df)) + 1

    def centroids(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("at", "ascending")])
        x = np.zeros((table.num_rows, DIMS), np.float32)
        for i, (at, n) in enumerate(zip(table["at"].to_pylist(), table["n"].to_pylist())):
            counts = np.zeros(DIMS, np.int64)
            counts[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.int32)
            x[i] = unit(counts, idf)
        c, mine = cluster(x, clusters)
        near = (x * c[mine]).sum(1)
        floors = [FLOOR * float(np.quantile(near[mine == j], 0.001)) if (mine == j).any() else 0.0 for j in range(len(c))]
        return pa.table({"lang": [table["lang"][0].as_py()] * len(c), "c": [r.astype(np.float32).tobytes() for r in c], "floor": floors})

    got = stored.groupBy("lang").applyInArrow(centroids, "lang string, c binary, floor double").collect()
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["c"])))
    matrix = np.array([np.frombuffer(r["c"], np.float32) for r in got], np.float32).reshape(len(got), DIMS)
    return Model([r["lang"] for r in got], matrix, np.array([r["floor"] for r in got]), idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` plus one struct ``lang_pred, score, rejected``; and the name of that column."""
    (out,) = fresh(docs.columns, "language")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(), shared.value
        for batch in batches:
            texts, rows = batch.column(text_col).to_pylist(), []
            for at in range(0, len(texts), _ROWS):
                some = texts[at : at + _ROWS]
                x, known = np.zeros((len(some), DIMS), np.float32), np.zeros(len(some), bool)
                for i, text in enumerate(some):
                    counts = grams.counts(text)
                    if counts is not None and len(m.languages):
                        x[i], known[i] = unit(counts, m.idf), True
                near = x @ m.centroids.T if len(m.languages) else np.zeros((len(some), 1))
                for i, best in enumerate(near.argmax(1).tolist()):
                    if known[i]:
                        score = round(float(min(1.0, max(0.0, near[i, best]))), 6)
                        rows.append({"lang_pred": m.languages[best], "score": score, "rejected": bool(near[i, best] < m.floors[best])})
                    else:
                        rows.append({"lang_pred": UNKNOWN, "score": 0.0, "rejected": True})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, out])

    field = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, field)])), out


def report(docs: DataFrame) -> DataFrame:
    """Fit on rows that are not held out, predict every row."""
    held = hashed_out("doc_id", 3, 1)
    model = fit(docs, ~held)
    got, out = predict(docs.select("doc_id", "text"), model)
    p = F.col(out)
    return got.select("doc_id", held.alias("held_out"), p["lang_pred"].alias("lang_pred"), p["score"].alias("score"), p["rejected"].alias("rejected"))


def drop_unknown(docs: DataFrame) -> DataFrame:
    """Documents whose language is recognised; columns as given."""
    got, out = predict(docs, fit(docs, F.lit(True)))
    return got.filter(~F.col(out)["rejected"]).drop(out)
