"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned for in every training document.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of non-ASCII characters. A benchmark item gives
every window of ``n`` consecutive words; an item with fewer words is one window. Windows travel as a dictionary from
a rolling hash to the exact word sequences and their items; a document's windows are looked up by hash and verified
word for word. The dictionary is broadcast in parts of bounded size: a larger benchmark takes more passes over
documents, in one job and without a shuffle, and no part grows with the corpus.

Null or word-less texts have no windows. Items without words are never found; the hits of an item without id count as
words, only the item is left out of the items. Rows are independent of one
another, so repeated rows and ids give repeated results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.tables import col, fresh
from matchloom.llm.words import WordHashes, letter_words, rolling

#: Words of benchmark items in one broadcast part (some 100 bytes each as windows).
PART_WORDS = 200_000


def _window_table(items: list[tuple[int, list[bytes]]], n: int) -> dict[int, dict]:
    """length -> {"hashes": sorted hashes, "exact": {hash: {word sequence: [items]}}}"""
    seen, out = WordHashes(), {}
    for item, words in items:
        size = min(n, len(words))
        at = out.setdefault(size, {})
        for i, h in enumerate(rolling(seen.of(words), size).tolist()):
            ids = at.setdefault(h, {}).setdefault(b" ".join(words[i : i + size]), [])
            if item is not None and (not ids or ids[-1] != item):
                ids.append(item)
    return {k: {"hashes": np.array(sorted(v), np.uint64), "exact": v} for k, v in out.items()}


def benchmark_parts(bench: DataFrame, n: int, id_col: str, text_col: str, part_words: int) -> Iterator[dict[int, dict]]:
    """Window tables of bounded size, fetched one partition at a time."""
    part, held = [], 0
    rows = bench.select(col(id_col).alias("i"), col(text_col).alias("t")).dropna(subset=["t"])
    for row in rows.toLocalIterator():
        if words := letter_words(row["t"]):
            if part and held + len(words) > part_words:
                yield _window_table(part, n)
                part, held = [], 0
            part.append((row["i"], words))
            held += len(words)
    if part:
        yield _window_table(part, n)


def find_hits(words: list[bytes], hashes: np.ndarray, table: dict[int, dict]) -> tuple[list[tuple[int, int]], set]:
    """Windows that occur, as word spans, and the items they belong to."""
    spans, items = [], set()
    for size, at in table.items():
        if len(words) < size:
            continue
        rolled = rolling(hashes, size)
        known = at["hashes"]
        place = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
        for i in np.flatnonzero(known[place] == rolled).tolist():
            ids = at["exact"][int(rolled[i])].get(b" ".join(words[i : i + size]))
            if ids is not None:
                spans.append((i, i + size))
                items.update(ids)
    return spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(
    docs: DataFrame,
    bench: DataFrame,
    n: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    part_words: int = PART_WORDS,
) -> tuple[DataFrame, str]:
    """All columns of ``docs`` plus a struct of n_words, merged word spans that are hit, and items found; and its name.

    Item ids must be of a whole-number or string type.
    """
    (out,) = fresh(docs.columns, "benchmark_hits")
    id_type = bench.schema[item_col].dataType
    arrow_id = pa.string() if isinstance(id_type, T.StringType) else {"int": pa.int32(), "bigint": pa.int64()}[id_type.simpleString()]
    sc = docs.sparkSession.sparkContext
    parts = [sc.broadcast(p) for p in benchmark_parts(bench, n, item_col, item_text_col, part_words)]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(arrow_id))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            found = []
            for text in batch.column(text_col).to_pylist():
                words = letter_words(text)
                hashes = seen.of(words)
                spans, items = [], set()
                for part in parts:
                    more, ids = find_hits(words, hashes, part.value)
                    spans += more
                    items |= ids
                found.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in merge(spans)], "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, out])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    hit = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", spans), T.StructField("items", T.ArrayType(id_type))])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, hit)])), out


def _n_hit(hit: Column) -> Column:
    return F.aggregate(hit["spans"], F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def report(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """One row for each document: word count, words hit, items found and their digest."""
    scanned, out = scan(docs.select("doc_id", "text"), bench, n)
    hit = F.col(out)
    names = F.array_sort(F.transform(hit["items"], lambda i: i.cast("string")))
    return scanned.select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        _n_hit(hit).alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(hit["spans"]) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = 10, share: float = 0.0) -> DataFrame:
    """Documents of which no more than ``share`` of the words are hit; columns as given."""
    scanned, out = scan(docs, bench, n)
    hit = F.col(out)
    return scanned.filter(_n_hit(hit) <= hit["n_words"] * F.lit(share)).drop(out)


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = 10, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` plus its words that are not hit, joined by one space; and the name of that column."""
    scanned, hits = scan(docs, bench, n, text_col)
    (out,) = fresh(scanned.columns, "clean_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = batch.schema.get_field_index(hits), []
            for text, hit in zip(batch.column(text_col).to_pylist(), batch.column(at).to_pylist()):
                words, gone = letter_words(text), {i for s in hit["spans"] for i in range(s["start"], s["end"])}
                rows.append(b" ".join(w for i, w in enumerate(words) if i not in gone).decode("utf-8", "surrogatepass"))
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(rows, pa.string())], names=[*(batch.schema.names[i] for i in rest), out])

    return scanned.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])), out
