"""Substring dedup: words covered by a window that also starts in a document with a smaller id are removed.

Every window of ``k`` consecutive words gets a rolling Rabin-Karp hash. Windows meet per *bucket*, a hash of the
smallest 4-word hash inside the window, so neighbouring windows mostly share a bucket and their positions pack well.

1. A task cuts its documents into slices of a bounded number of words. Inside a slice each distinct window is
   represented by its smallest document; the other occurrences are already known to be repeats. Only
   representatives travel, packed per bucket, so a passage that a third of all documents share costs one entry for
   each slice.
2. Spark groups by bucket. The smallest document of each hash wins; positions of the others go back to their slice.
3. Spark groups by slice and merges repeated windows into maximal intervals per document.
4. Documents are joined with their intervals and the words inside are removed.

Slices are named by a hash of their documents, so a task that runs again after a loss gives the same names. A
document is known by its id and text: repeated rows share one result, and rows that share an id with different texts
never remove words of each other. Rows with a null id take no part and keep all words; null texts have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.tables import col, fresh, parts_for, text_bytes
from matchloom.llm.words import WordHashes, blank_words, mix, rolling, sliding_min

WINDOW = 13
_ANCHOR = 4
_SLICE_WORDS = 600_000
#: Text bytes whose windows share a bucket: a bucket then holds some 8 MB.
_BUCKET_BYTES = 4 << 20
_FIELDS = [("bucket", pa.int64()), ("slice", pa.int64()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
_SCHEMA = "bucket long, slice long, kind byte, a binary, b binary, c binary"


def _deltas(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=x.dtype.type(0)).tobytes()


def _undelta(raw: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, kind), dtype=kind)


def slice_rows(ids: list[int], marks: list[int], hashes: list[np.ndarray], k: int, buckets: int) -> list[tuple]:
    """Rows of one slice: a packed run of representatives for each bucket, and the slice's own table (kind 1)."""
    lengths = np.array([len(h) for h in hashes], np.int64)
    starts = np.cumsum(lengths) - lengths
    name = xxhash.xxh3_64_intdigest(np.array([ids, marks], np.int64).tobytes()) - (1 << 63)
    words = np.concatenate(hashes)
    owner = np.repeat(np.arange(len(ids)), lengths)
    n = len(words) - k + 1
    at = np.flatnonzero(owner[:n] == owner[k - 1 :]) if n > 0 else np.empty(0, np.int64)
    known, rows = np.empty(0, np.int64), []
    if len(at):
        window = rolling(words, k)[at]
        bucket = (mix(sliding_min(rolling(words, _ANCHOR), k - _ANCHOR + 1)[at]) % np.uint64(buckets)).astype(np.int64)
        docs = np.array(ids, np.int64)[owner[at]]
        order = np.lexsort((docs, window))
        fresh = np.concatenate(([True], window[order[1:]] != window[order[:-1]]))
        least = docs[order[fresh]][np.cumsum(fresh) - 1]
        known = np.sort(at[order[docs[order] > least]])
        # a window that the smallest document holds twice travels once for each place
        reps = np.sort(order[docs[order] == least])
        reps = reps[np.argsort(bucket[reps], kind="stable")]
        edges = np.flatnonzero(np.diff(bucket[reps], prepend=-1))
        for i, j in zip(edges, [*edges[1:], len(reps)]):
            some = reps[i:j]
            rows.append((int(bucket[some[0]]), name, 0, window[some].tobytes(), _deltas(docs[some]), _deltas(at[some].astype(np.uint32))))
    table = np.array([ids, marks, starts], np.int64).tobytes()
    rows.append((name % buckets, name, 1, table, _deltas(known.astype(np.uint32)), b""))
    return rows


def _mapper(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        ids, marks, hashes, held = [], [], [], 0

        def flush():
            rows = slice_rows(ids, marks, hashes, k, buckets)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], names=[f for f, _ in _FIELDS])

        for batch in batches:
            for i, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = seen.of(blank_words(text))
                if len(h) < k:
                    continue
                ids.append(i), marks.append(mark), hashes.append(h)
                held += len(h)
                if held >= _SLICE_WORDS:
                    yield flush()
                    ids, marks, hashes, held = [], [], [], 0
        if held:
            yield flush()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """One bucket: send each slice the places whose window a smaller document also has."""
    kinds = table["kind"].to_numpy()
    tables = table.filter(pa.array(kinds == 1)).select(["slice", "kind", "a", "b"])
    runs = table.filter(pa.array(kinds == 0))
    out = []
    if runs.num_rows:
        window = [np.frombuffer(x, np.uint64) for x in runs["a"].to_pylist()]
        docs = np.concatenate([_undelta(x, np.int64) for x in runs["b"].to_pylist()])
        at = np.concatenate([_undelta(x, np.uint32) for x in runs["c"].to_pylist()])
        source = np.repeat(np.arange(len(window)), [len(w) for w in window])
        window = np.concatenate(window)
        order = np.lexsort((docs, window))
        fresh = np.concatenate(([True], window[order[1:]] != window[order[:-1]]))
        least = docs[order[fresh]][np.cumsum(fresh) - 1]
        lost = order[docs[order] > least]
        lost = lost[np.lexsort((at[lost], source[lost]))]
        edges = np.flatnonzero(np.diff(source[lost], prepend=-1))
        names = runs["slice"].to_numpy()
        for i, j in zip(edges, [*edges[1:], len(lost)]):
            out.append((int(names[source[lost[i]]]), 0, None, _deltas(at[lost[i:j]])))
    columns = list(zip(*out)) or [[], [], [], []]
    mine = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int8(), pa.binary(), pa.binary()))], names=["slice", "kind", "a", "b"])
    return pa.concat_tables([tables, mine])


def _intervals(k: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        places = np.unique(np.concatenate([_undelta(x, np.uint32) for x in table["b"].to_pylist()])).astype(np.int64)
        # a slice that met again (a row read twice) has its table twice, with the same content
        raw = table.filter(pa.array(kinds == 1))["a"].to_pylist()[0]
        ids, marks, starts = np.frombuffer(raw, np.int64).reshape(3, -1)
        owner = np.searchsorted(starts, places, side="right") - 1
        begins = np.concatenate(([True], (np.diff(places) > k) | (np.diff(owner) != 0))) if len(places) else np.empty(0, bool)
        first = np.flatnonzero(begins)
        last = np.concatenate((first[1:], [len(places)])) - 1 if len(first) else first
        whose = owner[first]
        docs = np.flatnonzero(np.diff(whose, prepend=-1))
        rows = {"doc_id": [], "mark": [], "spans": []}
        for i, j in zip(docs, [*docs[1:], len(whose)]):
            d = whose[i]
            rows["doc_id"].append(int(ids[d]))
            rows["mark"].append(int(marks[d]))
            rows["spans"].append(np.stack((places[first[i:j]], places[last[i:j]] + k), 1).ravel() - starts[d])
        return pa.table(
            [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["mark"], pa.int64()), pa.array(rows["spans"], pa.list_(pa.int64()))],
            names=["doc_id", "mark", "spans"],
        )

    return run


def repeated_spans(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, spans`` for documents that lose words; spans are flat: start, end, start, end, ...

    ``mark`` is xxhash64 of the text. Spans are maximal, sorted and disjoint word ranges.
    """
    size = text_bytes(docs, text_col)
    buckets = parts_for(docs, size, _BUCKET_BYTES)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.xxhash64(col(text_col)).alias("mark"), col(text_col).alias("text"))
    packed = rows.filter("doc_id is not null and text is not null").mapInArrow(_mapper(k, buckets), _SCHEMA)
    met = packed.groupBy("bucket").applyInArrow(_meet, "slice long, kind byte, a binary, b binary")
    return met.groupBy("slice").applyInArrow(_intervals(k), "doc_id long, mark long, spans array<long>")


def cut(words: list[bytes], spans) -> tuple[list[bytes], int]:
    """Words outside the spans, and how many went."""
    if spans is None:
        return words, 0
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return kept, len(words) - len(kept)


def remove_repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` plus a struct of n_words, n_removed and the kept words joined by one space; and its name."""
    out, mark, one, two, three = fresh(docs.columns, "cut", "mark", "cut_id", "cut_mark", "spans")
    spans = repeated_spans(docs, k, id_col, text_col).select(F.col("doc_id").alias(one), F.col("mark").alias(two), F.col("spans").alias(three))
    keyed = docs.withColumn(mark, F.xxhash64(col(text_col)))
    joined = keyed.join(spans, (col(id_col).cast("long") == F.col(one)) & (F.col(mark) == F.col(two)), "left").drop(mark, one, two)
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = batch.schema.get_field_index(three), []
            for text, gone in zip(batch.column(text_col).to_pylist(), batch.column(at).to_pylist()):
                words = blank_words(text)
                kept, n = cut(words, gone)
                rows.append({"n_words": len(words), "n_removed": n, "text": b" ".join(kept).decode("utf-8", "surrogatepass")})
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(rows, kind)], names=[*(batch.schema.names[i] for i in rest), out])

    field = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, field)])), out


def report(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """One row for each document: words, words removed, and the digest of what is left."""
    got, out = remove_repeats(docs.select("doc_id", "text"), k)
    c = F.col(out)
    return got.select("doc_id", c["n_words"].alias("n_words"), c["n_removed"].alias("n_removed"), F.sha2(c["text"].cast("binary"), 256).alias("kept_sha256"))
