"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into segments that no piece crosses (runs of the space mark with what follows, and line feeds). For
the distinct new segments of a batch, all substrings up to the longest piece are exploded, joined with the piece
table on equality, and the matches grouped by segment: the edges of its lattice. A fold over the edges picks the
path: for a *unigram* model the Viterbi path of the highest summed score, for a *BPE* model the path that its merges
leave, best score first and leftmost among equals. A model's own kind decides, so ids are those of the model.
Characters without a piece become byte pieces, or the unknown piece if the model has no bytes. Decoding joins pieces.

This runs inside tasks on Arrow batches and moves nothing between tasks; a relational form in Spark would have to join
every occurrence of every word back to its document. Frequent segments are remembered within a bounded memory. The
piece table is read on the driver from ``path`` and broadcast: its size is the model's vocabulary.

A null text has no pieces and decodes to null; an empty one has no pieces and decodes to the empty text. The space
mark itself decodes to a space, so texts that contain it are the only ones that do not come back unchanged.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.tables import col, fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CACHE_SEGMENTS = 150_000
_ROWS = 200
#: Longer segments merge by a heap, one by one.
_ROUNDS = 200
_B = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_CHARS = 100_000
#: What an unknown character scores below the worst piece in a unigram model.
_UNKNOWN = 10.0


@dataclass(frozen=True)
class Pieces:
    names: list[str]  # pieces that text can match
    ids: list[int]
    scores: list[float]
    bytes_of: dict[int, int]  # byte -> id
    unknown: int
    kind: str  # "bpe" or "unigram"
    prefix: bool  # a space goes before the text
    raw: list[bytes]  # what each id decodes to

    @property
    def longest(self) -> int:
        return max(map(len, self.names), default=1)


def read_model(path: str = MODEL) -> Pieces:
    """The piece table of a model file. Only what changes no text is supported of its normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = {1: "unigram", 2: "bpe"}
    n = model.normalizer_spec
    kind, types = model.trainer_spec.model_type, {p.type for p in model.pieces}
    if kind not in kinds or types & {4, 5} or n.precompiled_charsmap or n.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("unsupported model: needs unigram or BPE, identity normalisation and plain pieces")
    plain = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
    byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
    raw = [p.piece.replace(MARK, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" for p in model.pieces]
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
    raw[unknown] = model.trainer_spec.unk_surface.encode() or b" \xe2\x81\x87 "
    names, ids, scores = (list(c) for c in zip(*plain))
    return Pieces(names, ids, scores, byte, unknown, kinds[kind], n.add_dummy_prefix, raw)


def best_path(n: int, edges: dict[tuple[int, int], tuple[float, int]], floor: float) -> list[tuple[int, int]]:
    """Viterbi: the path over characters 0..n with the highest sum; a lone character without a piece scores floor."""
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    into: dict[int, list[tuple[int, float]]] = {}
    for (i, j), (score, _) in edges.items():
        into.setdefault(j, []).append((i, score))
    for j in range(1, n + 1):
        for i, score in sorted(into.get(j, ())) or ():
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, i
        if (j - 1, j) not in edges and best[j - 1] + floor > best[j]:
            best[j], back[j] = best[j - 1] + floor, j - 1
    path, j = [], n
    while j:
        path.append((back[j], j))
        j = back[j]
    return path[::-1]


def merged_path(n: int, edges: dict[tuple[int, int], tuple[float, int]]) -> list[tuple[int, int]]:
    """BPE: neighbours whose union is a piece merge, the best score first, then the leftmost."""
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
    heap = [(-edges[i, i + 2][0], i, i + 2) for i in range(n - 1) if (i, i + 2) in edges]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, j = heapq.heappop(heap)
        middle = end[i] if alive[i] else n
        if middle >= n or end[middle] != j:
            continue
        alive[middle], end[i] = False, j
        if j < n:
            before[j] = i
            if (i, end[j]) in edges:
                heapq.heappush(heap, (-edges[i, end[j]][0], i, end[j]))
        if (left := before[i]) >= 0 and (left, j) in edges:
            heapq.heappush(heap, (-edges[left, j][0], left, j))
    out, i = [], 0
    while i < n:
        out.append((i, end[i]))
        i = end[i]
    return out


def merged_parts(starts: np.ndarray, stops: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """``merged_path`` of many segments at once: where the parts start. In each round every segment merges one pair."""
    lengths = stops - starts
    segment = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    longest, done = scores.shape[1] - 1, []
    while len(at):
        last = np.append(segment[1:] != segment[:-1], True)
        end = np.where(last, stops[segment], np.append(at[1:], 0))
        size = np.append(end[1:], 0) - at
        fits = ~last & (size <= longest)
        score = np.full(len(at), -np.inf, np.float32)
        score[fits] = scores[at[fits], size[fits]]
        first = np.flatnonzero(np.append(True, last[:-1]))
        best = np.repeat(np.maximum.reduceat(score, first), np.diff(np.append(first, len(at))))
        going = best > -np.inf
        done.append(at[~going])
        top = np.flatnonzero(going & (score == best))
        _, leftmost = np.unique(segment[top], return_index=True)
        keep = going.copy()
        keep[top[leftmost] + 1] = False
        at, segment = at[keep], segment[keep]
    return np.concatenate(done) if done else np.empty(0, np.int64)


def _edges(scores: np.ndarray, ids: np.ndarray, start: int, stop: int) -> dict[tuple[int, int], tuple[float, int]]:
    rows, sizes = np.nonzero(ids[start:stop] >= 0)
    return {(i, i + n): (float(scores[start + i, n]), int(ids[start + i, n])) for i, n in zip(rows.tolist(), sizes.tolist())}


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.joins: dict[int, tuple] = {}
        for size in sorted({len(p) for p in pieces.names}):
            rows = [k for k, p in enumerate(pieces.names) if len(p) == size]
            letters = np.array([[ord(c) for c in pieces.names[k]] for k in rows], np.uint32)
            keys = np.zeros(len(rows), np.uint64)
            for column in letters.T:
                keys = keys * _B + column
            order = np.argsort(keys)
            self.joins[size] = (keys[order], letters[order], np.array(pieces.ids)[rows][order], np.array(pieces.scores, np.float32)[rows][order])
        self.floor = min(pieces.scores, default=0.0) - _UNKNOWN
        inner = any(MARK in p.lstrip(MARK) for p in pieces.names)
        feeds = any("\n" in p for p in pieces.names)
        stop = "" if feeds else "\n"
        self.cut = None if inner else re.compile(f"{MARK}+[^{MARK}{stop}]*|[^{MARK}{stop}]+" + ("" if feeds else "|\n"))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def segments(self, text: str | None) -> list[str]:
        if not text:
            return []
        marked = (MARK if self.pieces.prefix else "") + text.replace(" ", MARK)
        return self.cut.findall(marked) if self.cut else [marked]

    def learn(self, segments: list[str]) -> None:
        """Encode segments that are not remembered, many at once.

        What is remembered comes in two generations: when the younger is full it becomes the older, and what is used
        again moves on, so that frequent segments stay.
        """
        if len(self.known) > _CACHE_SEGMENTS:
            self.known, self.older = {}, self.known
        new, known, older = [], self.known, self.older
        for s in set(segments):
            if s not in known:
                if s in older:
                    known[s] = older[s]
                else:
                    new.append(s)
        some, held = [], 0
        for s in new:
            some.append(s)
            held += len(s)
            if held >= _CHUNK_CHARS:
                self._encode(some)
                some, held = [], 0
        if some:
            self._encode(some)

    def _encode(self, segments: list[str]) -> None:
        lengths = np.array([len(s) for s in segments], np.int64)
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum(lengths)
        scores, ids = self.lattice(codes, np.repeat(stops, lengths))
        starts = stops - lengths
        if self.pieces.kind == "bpe":
            short = np.flatnonzero(lengths <= _ROUNDS)
            parts = [merged_parts(starts[short], stops[short], scores)] if len(short) else []
            for k in np.flatnonzero(lengths > _ROUNDS).tolist():
                path = merged_path(int(lengths[k]), _edges(scores, ids, starts[k], stops[k]))
                parts.append(np.array([i for i, _ in path], np.int64) + starts[k])
        else:
            parts = [
                np.array([i for i, _ in best_path(j - i, _edges(scores, ids, i, j), self.floor)], np.int64) + i
                for i, j in zip(starts.tolist(), stops.tolist())
            ]
        begin = np.sort(np.concatenate(parts))
        end = np.append(begin[1:], len(codes))
        chosen = ids[begin, np.minimum(end - begin, ids.shape[1] - 1)]
        whose = np.searchsorted(begin, starts)
        raw, edges = chosen.astype(np.int32).tobytes(), [*whose.tolist(), len(begin)]
        odd = set(np.searchsorted(stops, begin[chosen < 0], side="right").tolist())
        for k, s in enumerate(segments):
            i, j = edges[k], edges[k + 1]
            self.known[s] = raw[4 * i : 4 * j] if k not in odd else self._with_bytes(chosen[i:j].tolist(), [chr(c) for c in codes[begin[i:j]]])

    def _with_bytes(self, ids: list[int], chars: list[str]) -> bytes:
        """Ids of a segment in which some character has no piece."""
        out: list[int] = []
        for i, c in zip(ids, chars):
            if i >= 0:
                out.append(i)
            elif self.pieces.bytes_of:
                out += [self.pieces.bytes_of[b] for b in c.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.pieces.unknown)
        return np.array(out, np.int32).tobytes()

    def lattice(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece that starts at each character, by its length; -inf and -1 where there is none.

        Substrings of each length are exploded as hashes, joined with the pieces of that length, and compared in full.
        """
        longest = self.pieces.longest
        scores = np.full((len(codes), longest + 1), -np.inf, np.float32)
        ids = np.full((len(codes), longest + 1), -1, np.int32)
        at, value = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for size in range(1, longest + 1):
            fits = at + size <= stop[at]
            at, value = at[fits], value[fits]
            if not len(at):
                break
            value = value * _B + codes[at + size - 1]
            if size in self.joins:
                keys, letters, piece_ids, piece_scores = self.joins[size]
                place = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == value)
                place, where = place[hit], at[hit]
                same = (codes[where[:, None] + np.arange(size)] == letters[place]).all(1)
                scores[where[same], size], ids[where[same], size] = piece_scores[place[same]], piece_ids[place[same]]
        return scores, ids

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            cut, held = [], 0
            while at < len(texts) and held < 100_000:
                cut.append(self.segments(texts[at]))
                held += len(cut[-1])
                at += 1
            self.learn([s for c in cut for s in c])
            for c in cut:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, c)), np.int32)


def decode_ids(ids, pieces: Pieces) -> str:
    text = b"".join(map(pieces.raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if pieces.prefix and text.startswith(" ") else text


class Decoder:
    """Texts of lists of ids: their pieces' bytes, taken one after the other, are the texts."""

    def __init__(self, pieces: Pieces):
        self.prefix = pieces.prefix
        known = dict(enumerate(pieces.raw)) if isinstance(pieces.raw, list) else pieces.raw
        self.table = pa.array([known.get(i, b"") for i in range(max(known, default=-1) + 1)], pa.large_binary())

    def texts(self, lists: pa.ListArray) -> list[str | None]:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        taken = self.table.take(lists.flatten())
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        held = memoryview(taken.buffers()[2]) if len(taken) else memoryview(b"")
        edges = offsets[np.concatenate(([0], np.cumsum(sizes)))] if len(taken) else np.zeros(len(sizes) + 1, np.int64)
        valid = lists.is_valid().to_pylist()
        out: list[str | None] = []
        for ok, start, stop in zip(valid, edges[:-1].tolist(), edges[1:].tolist()):
            text = bytes(held[start:stop]).decode("utf-8", "replace") if ok else None
            out.append(text[1:] if text and self.prefix and text.startswith(" ") else text)
        return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` plus an array of piece ids; and the name of that column."""
    (out,) = fresh(docs.columns, "piece_ids")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                ids = list(encoder.encode(some.column(text_col).to_pylist()))
                yield pa.RecordBatch.from_arrays([*some.columns, _lists(ids)], names=[*some.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])), out


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "piece_ids") -> tuple[DataFrame, str]:
    """All columns of ``rows`` plus the text of a column of piece ids; null ids decode to null."""
    (out,) = fresh(rows.columns, "decoded")
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                texts = decoder.texts(some.column(ids_col))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*some.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])), out


def report(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    pieces = read_model(path)
    coded, ids = encode(docs.select("doc_id", "text"), pieces)
    back, text = decode(coded, pieces, ids)
    same = F.coalesce(col(text), F.lit("")) == F.coalesce(F.col("text"), F.lit(""))
    return back.select("doc_id", F.size(col(ids)).cast("long").alias("n_pieces"), col(ids).alias("piece_ids"), same.alias("round_trip"))
