"""Character n-gram TF-IDF: weights, and exact joins on the cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.grams import gram_lists
from matchloom.functions.lcs import flat_ranges
from matchloom.functions.text import SPLIT_PATTERN
from matchloom.operators import blocks, metric
from matchloom.operators.blocks import Best, Groups, Shape, Weights
from matchloom.operators.metric import Space
from matchloom.plans.scratch import materialise, materialise_counted

# cosines are compared and ranked at this many decimals, so that summation order cannot decide
COSINE_DECIMALS = 9
_SQUARE = 1024
_DENSE_COLUMNS = 4096
_VOCABULARY_BROADCAST = 1_000_000
_SALTS = 64
_KEYS_PER_TASK = 1000
_ANGLE_CELLS = 1 << 17
#: Grams that become weights at once.
_GRAMS_AT_ONCE = 1 << 19


def idf_corpus(primary: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """``side, pos, key``: a bag, so a key on both sides counts twice."""
    mine = primary.select(F.lit("a").alias("side"), "pos", "key")
    return mine if master is None else mine.unionAll(master.select(F.lit("b").alias("side"), "pos", "key"))


def _gram_lists(batches):
    for batch in batches:
        for at, to, grams, tfs in gram_lists(batch["key"].to_pylist()):
            some = batch.slice(at, to - at)
            yield pa.RecordBatch.from_arrays([some["side"], some["pos"], grams, tfs], names=["side", "pos", "grams", "tfs"])


def key_terms(corpus: DataFrame, n_keys: int | None = None) -> DataFrame:
    """``side, pos, grams, tfs``: the distinct grams of each key and how often it holds them, packed in one row."""
    spark = corpus.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n_keys is not None:
        n = min(n, max(spark.sparkContext.defaultParallelism, n_keys // _KEYS_PER_TASK))
    # keys are spread before they are taken apart, and words are parted where Spark parts them
    spread = corpus.repartition(n, "side", "pos").select("side", "pos", F.regexp_replace("key", SPLIT_PATTERN, " ").alias("key"))
    return spread.mapInArrow(_gram_lists, "side string, pos long, grams array<string>, tfs array<int>").filter(F.size("grams") > 0)


def _exploded(terms: DataFrame) -> DataFrame:
    both = F.explode(F.arrays_zip("grams", "tfs")).alias("t")
    return terms.select("side", "pos", both).select("side", "pos", F.col("t.grams").alias("gram"), F.col("t.tfs").cast("long").alias("tf"))


def term_counts(corpus: DataFrame, n_keys: int | None = None) -> DataFrame:
    """``side, pos, gram, tf``: the same grams as ``char_wb_ngrams``, as rows."""
    return _exploded(key_terms(corpus, n_keys))


def document_frequency(counts: DataFrame) -> DataFrame:
    """``gram, df``: keys that hold a gram."""
    return counts.groupBy("gram").agg(F.count("*").alias("df"))


def _numbered(terms: DataFrame) -> tuple[DataFrame, int, int]:
    """``gram, df, gram_id``, stored, their number, and the number of grams that all keys hold."""
    df = terms.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    vocabulary, seen = materialise_counted(df.withColumn("gram_id", F.monotonically_increasing_id()), "vocabulary", grams=F.count(F.lit(1)), held=F.coalesce(F.sum("df"), F.lit(0)))
    return vocabulary, seen["grams"], seen["held"]


def tfidf_weights(corpus: DataFrame, n: int | None = None) -> DataFrame:
    """``side, pos, gram, gram_id, tf, df, weight``: smoothed idf, unit length per key. ``n``: size of the corpus."""
    n = corpus.count() if n is None else n
    terms = materialise(key_terms(corpus, n), "key-terms")
    vocabulary, grams, _ = _numbered(terms)
    return _weighted(terms, vocabulary, grams, n)


def _weighted(terms: DataFrame, vocabulary: DataFrame, grams: int, n: int) -> DataFrame:
    counts = _exploded(terms)
    if grams <= _VOCABULARY_BROADCAST:
        joined = counts.join(F.broadcast(vocabulary), "gram")
    else:
        # a gram may occur in most keys: spread its rows over salted copies of its one vocabulary row
        salted = vocabulary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = (
            counts.withColumn("salt", F.pmod(F.xxhash64("side", "pos"), F.lit(_SALTS)).cast("int"))
            .join(salted, ["gram", "salt"])
            .drop("salt")
        )
    raw = F.col("tf") * (F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0)
    return (
        joined.withColumn("raw", raw)
        .withColumn("norm", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("side", "pos"))))
        .select("side", "pos", "gram", "gram_id", "tf", "df", (F.col("raw") / F.col("norm")).alias("weight"))
    )


def prefix_flag(weights: DataFrame, cutoff: int) -> DataFrame:
    """Flag the grams, rarest first, from which on the rest of the key could still reach the cutoff.

    If two keys share no flagged gram, all they share lies in a rest of norm < cutoff on one side, and
    so does their cosine.
    """
    commonest_first = Window.partitionBy("side", "pos").orderBy(F.desc("df"), F.desc("gram_id"))
    rest = F.sum(F.col("weight") * F.col("weight")).over(commonest_first.rowsBetween(Window.unboundedPreceding, 0))
    return weights.withColumn("in_prefix", F.sqrt(rest) >= cutoff / 100 - 1e-9)


def _packed(tables):
    """Lists as raw bytes: Spark then moves each vector as one value instead of element by element."""

    for batch in tables:
        table = pa.Table.from_batches([batch])
        for name in ("ids", "weights"):
            lists = batch[name]
            packed = _bytes_of(lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy())
            table = table.set_column(table.column_names.index(name), name, packed)
        yield from table.to_batches()


def _by_grams(batch: pa.RecordBatch):
    """Slices with a bounded number of grams, or single keys."""
    ends = np.cumsum(pc.list_value_length(batch["grams"]).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _GRAMS_AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to


def _vector_builder(known, n: int, cutoff: int | None):
    """Packed vectors from packed terms, by the broadcast grams, their numbers and documents."""

    def run(batches):
        grams, ids, df = known.value
        idf = np.log((1.0 + n) / (df + 1.0)) + 1.0
        for batch in (part for whole in batches for part in _by_grams(whole)):
            lists = batch["grams"]
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            coded = lists.flatten().dictionary_encode()
            which = pc.index_in(coded.dictionary, value_set=grams).to_numpy()[coded.indices.to_numpy()]
            raw = batch["tfs"].flatten().to_numpy() * idf[which]
            norm = np.sqrt(np.add.reduceat(raw * raw, starts))
            weight = raw / np.repeat(norm, sizes)
            arrays = [batch["side"], batch["pos"], pa.array(sizes.astype(np.int32)), _bytes_of(ids[which], sizes), _bytes_of(weight, sizes)]
            names = ["side", "pos", "size", "ids", "weights"]
            if cutoff is not None:
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((-ids[which], -df[which], owner))
                rest = np.cumsum((weight * weight)[order])
                before = (rest - (weight * weight)[order])[starts]
                ok = np.sqrt(np.maximum(rest - np.repeat(before, sizes), 0.0)) >= cutoff / 100 - 1e-8
                edges = np.concatenate(([0], np.cumsum(np.add.reduceat(ok.astype(np.int64), starts))))
                arrays.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids[which][order][ok])))
                names.append("prefix")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _bytes_of(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64) * 8
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def key_vectors(corpus: DataFrame, n: int, cutoff: int | None = None) -> DataFrame:
    """``side, pos, size, ids, weights`` of every key with grams; with a cutoff also ``prefix``, see ``prefix_flag``."""
    return _key_vectors(corpus, n, cutoff)[0]


def _key_vectors(corpus: DataFrame, n: int, cutoff: int | None) -> tuple[DataFrame, int]:
    """The same, and how many keys should go to a worker at once: long texts hold thousands of grams.

    Terms are written once, as one packed row for each key. While the vocabulary is small enough to be known to all
    tasks, each row becomes a vector where it lies; beyond, terms are joined to the vocabulary as rows.
    """
    terms = materialise(key_terms(corpus, n), "key-terms")
    vocabulary, grams, held = _numbered(terms)
    at_once = max(1, _GRAMS_AT_ONCE * n // max(held, 1))
    if grams > _VOCABULARY_BROADCAST:
        weights = _weighted(terms, vocabulary, grams, n)
        return vectors(weights if cutoff is None else prefix_flag(weights, cutoff)), at_once
    known = vocabulary.toArrow()
    told = (known["gram"].combine_chunks(), known["gram_id"].to_numpy(), known["df"].to_numpy().astype(np.float64))
    schema = "side string, pos long, size int, ids binary, weights binary" + ("" if cutoff is None else ", prefix array<long>")
    return terms.mapInArrow(_vector_builder(corpus.sparkSession.sparkContext.broadcast(told), n, cutoff), schema), at_once


def vectors(weights: DataFrame) -> DataFrame:
    """``side, pos, size, ids, weights``: one row per key, with ``prefix`` ids when they are flagged."""
    parts = [F.collect_list(F.struct("gram_id", "weight")).alias("v")]
    if "in_prefix" in weights.columns:
        parts.append(F.collect_list(F.when(F.col("in_prefix"), F.col("gram_id"))).alias("prefix"))
    out = weights.groupBy("side", "pos").agg(*parts)
    rest = [c for c in ("prefix",) if c in out.columns]
    lists = out.select(
        "side", "pos", F.size("v").alias("size"), F.col("v.gram_id").alias("ids"), F.col("v.weight").alias("weights"), *rest
    )
    schema = "side string, pos long, size int, ids binary, weights binary" + (", prefix array<long>" if rest else "")
    return lists.mapInArrow(_packed, schema)


# --- scoring inside a block -----------------------------------------------------------------------


def _unpacked(column: pa.ChunkedArray, dtype) -> np.ndarray:
    packed = column.combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    if not len(packed) or offsets[0] == offsets[-1]:
        return np.empty(0, dtype)
    return np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(dtype)


class _Vectors:
    def __init__(self, table: pa.Table):
        self.sizes = table["size"].to_numpy().astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        coded = pa.array(_unpacked(table["ids"], np.int64)).dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.width = len(coded.dictionary)
        self.values = _unpacked(table["weights"], np.float64)

    def rows(self, rows: np.ndarray):
        sizes = self.sizes[rows]
        where = flat_ranges(self.starts[rows], sizes)
        return np.repeat(np.arange(len(rows)), sizes), self.ids[where], self.values[where]


def _localise(ga: np.ndarray, gb: np.ndarray, width: int):
    """Number the shared grams from 0; -1 for the rest."""
    if len(ga) + len(gb) >= width:
        shared = (np.bincount(ga, minlength=width) > 0) & (np.bincount(gb, minlength=width) > 0)
        slot = np.where(shared, np.cumsum(shared) - 1, -1)
        return slot[ga], slot[gb], int(shared.sum())
    common = np.intersect1d(ga, gb)
    out = []
    for g in (ga, gb):
        at = np.searchsorted(common, g)
        hit = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == g) if len(common) else np.zeros(len(g), bool)
        out.append(np.where(hit, at, -1))
    return out[0], out[1], len(common)


class _Rectangle:
    """Dot products of two sets of sparse vectors, in two steps.

    The grams most pairs share go through one dense product. All weights are positive, so that part is a
    lower bound, and adding the product of the two remaining norms gives an upper bound. Only pairs whose
    upper bound matters get the rest added, gram by gram.
    """

    def __init__(self, vec: _Vectors, rows: np.ndarray, cols: np.ndarray):
        self.na, self.nb = len(rows), len(cols)
        ra, ga, wa = vec.rows(rows)
        rb, gb, wb = vec.rows(cols)
        ga, gb, width = _localise(ga, gb, vec.width)
        (ra, ga, wa), (rb, gb, wb) = ((r[g >= 0], g[g >= 0], w[g >= 0]) for r, g, w in ((ra, ga, wa), (rb, gb, wb)))
        dense = np.ones(width, bool)
        if width > _DENSE_COLUMNS:
            met = np.bincount(ga, minlength=width) * np.bincount(gb, minlength=width)
            dense[:] = False
            dense[np.argpartition(met, width - _DENSE_COLUMNS)[width - _DENSE_COLUMNS :]] = True
        slot = np.cumsum(dense) - 1
        left, right = np.zeros((self.na, int(dense.sum()))), np.zeros((self.nb, int(dense.sum())))
        for r, g, w, into in ((ra, ga, wa, left), (rb, gb, wb, right)):
            into[r[dense[g]], slot[g[dense[g]]]] = w[dense[g]]
        self.lower = left @ right.T
        self.rest = not dense.all()
        if self.rest:
            self.width = width
            (self.a, self.norm_a), (self.b, self.norm_b) = (
                self._sparse(r[~dense[g]], g[~dense[g]], w[~dense[g]], n)
                for r, g, w, n in ((ra, ga, wa, self.na), (rb, gb, wb, self.nb))
            )

    @staticmethod
    def _sparse(r, g, w, n):
        sizes = np.bincount(r, minlength=n)
        return (np.concatenate(([0], np.cumsum(sizes))), sizes, g, w), np.sqrt(np.bincount(r, w * w, minlength=n))

    def upper(self) -> np.ndarray:
        return self.lower + np.outer(self.norm_a, self.norm_b) if self.rest else self.lower

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Full products of pairs ordered by row."""
        out = self.lower[r, c]
        if not self.rest or not len(r):
            return out
        starts_a, sizes_a, grams_a, weights_a = self.a
        starts_b, sizes_b, grams_b, weights_b = self.b
        spread = np.zeros(self.width)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1, [len(r)]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            mine = slice(starts_a[r[lo]], starts_a[r[lo] + 1])
            spread[grams_a[mine]] = weights_a[mine]
            sizes = sizes_b[c[lo:hi]]
            where = flat_ranges(starts_b[c[lo:hi]], sizes)
            out[lo:hi] += np.bincount(
                np.repeat(np.arange(hi - lo), sizes), spread[grams_b[where]] * weights_b[where], minlength=hi - lo
            )
            spread[grams_a[mine]] = 0.0
        return out


def cosine_scorer(cutoff: int):
    least = cutoff / 100.0

    def score(table: pa.Table, groups: Groups, best: Best):
        vec = _Vectors(table)
        for left, right in groups:
            rank = groups.precedence(left, right, None)
            for rows, cols, once in blocks.sub_blocks(left, right, rank, _SQUARE, _SQUARE):
                part = _Rectangle(vec, rows, cols)
                groups.scored += len(rows) * len(cols)
                if part.rest:
                    best.raise_floors(rows, cols, part.lower * 100.0, once)
                near = part.upper() >= least - 1e-8
                if once is not None:
                    near &= once
                r, c = np.nonzero(near)
                if part.rest:
                    # floors are scores in percent; the margin keeps ties and rounding in
                    upper = (part.lower[r, c] + part.norm_a[r] * part.norm_b[c]) * 100.0
                    able = upper >= best.pair_floor(rows[r], cols[c]) - 1e-6
                    r, c = r[able], c[able]
                s = np.round(part.exact(r, c), COSINE_DECIMALS)
                hit = s >= least
                best.add(rows[r[hit]], cols[c[hit]], s[hit] * 100.0)

    return score


def _angles(table: pa.Table, pivots: pa.Table) -> np.ndarray:
    """Angles to the pivots, through one table of the pivots' weights."""
    pivot_ids = _unpacked(pivots["ids"], np.int64)
    names, slots = np.unique(pivot_ids, return_inverse=True)
    weights = np.zeros((len(names) + 1, pivots.num_rows))
    weights[slots, np.repeat(np.arange(pivots.num_rows), pivots["size"].to_numpy())] = _unpacked(pivots["weights"], np.float64)
    ids, values, sizes = _unpacked(table["ids"], np.int64), _unpacked(table["weights"], np.float64), table["size"].to_numpy()
    edges = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
    out, at = np.zeros((table.num_rows, pivots.num_rows)), 0
    while at < table.num_rows:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + _ANGLE_CELLS, "right")) - 1)
        part = slice(edges[at], edges[to])
        slot = np.minimum(np.searchsorted(names, ids[part]), len(names) - 1)
        slot = np.where(names[slot] == ids[part], slot, len(names))
        out[at:to] = np.add.reduceat(weights[slot] * values[part, None], edges[at:to] - edges[at])
        at = to
    return np.arccos(np.clip(out, -1.0, 1.0))


def _allowed(score):
    return np.zeros(1)[0], np.arccos(np.clip(score / 100.0 - 10.0**-COSINE_DECIMALS, -1.0, 1.0))


#: Angles between vectors; a pair at a cosine of s % is arccos(s / 100) apart.
ANGLE = Space(measure=_angles, sizes=lambda table: np.zeros(table.num_rows), allowed=_allowed, grain=256)


# --- joins ----------------------------------------------------------------------------------------


def _pairs(keys: DataFrame, cutoff: int, k: int, two_sided: bool, route: str, meter: Accumulator | None) -> DataFrame:
    spark = keys.sparkSession
    corpus, seen = materialise_counted(
        keys, "corpus", a=F.count_if(F.col("side") == "a"), b=F.count_if(F.col("side") == "b")
    )
    n_a, n_b = seen["a"], seen["b"]
    all_pairs = n_a * n_b if two_sided else n_a * n_a / 2
    flagged = route in ("signatures", "split") or (route == "auto" and all_pairs > blocks.DIRECT_PAIRS)
    packed, at_once = _key_vectors(corpus, n_a + n_b, cutoff if flagged else None)
    items, got = materialise_counted(packed, "vectors", at_once, n=F.count(F.lit(1)), grams=F.avg("size"))
    is_left = F.col("side") == "a"
    is_right = F.col("side") == "b" if two_sided else F.lit(True)
    payload = (is_left.alias("is_left"), is_right.alias("is_right"), "size", "ids", "weights")
    grams = got["grams"] or 0.0
    # a look is a row of the dense product, a score the grams beyond it
    weights_of = Weights(look=min(grams * 4, _DENSE_COLUMNS) / 4, score=2 * grams, item_bytes=16 * grams + 32)
    shape = Shape(k=k, high_b=True, two_sided=two_sided)
    return blocks.score_pairs(
        items.select("pos", F.lit(0).cast("long").alias("band"), *payload),
        [(0, got["n"], min(n_a, got["n"]))],
        lambda low, high: (low, high),
        (lambda: items.select(F.explode("prefix").alias("sig"), "pos", *payload)) if flagged else None,
        cosine_scorer(cutoff),
        shape,
        blocks.chunk_rows(got["n"], 16 * grams, spark.sparkContext.defaultParallelism),
        mirrored=not two_sided,
        route=route,
        weights=weights_of,
        metric=lambda: metric.plan(items.select("pos", *payload), ANGLE, cosine_scorer, shape, cutoff, got["n"], weights_of, meter),
    )


def top_k_tfidf(pairs: DataFrame, k: int) -> DataFrame:
    """Best k partners per item; equal scores go to the later partner."""
    return blocks.keep_top_k(pairs, k, high_b=True)


def tfidf_self_join(keys: DataFrame, cutoff: int = 85, k: int = 5, route: str = "auto", meter: Accumulator | None = None) -> DataFrame:
    """``pos_a, pos_b, raw, rank`` over ``key, pos``; the partner always comes later than the item.

    ``meter`` adds up the pairs whose product the metric route takes.
    """
    return top_k_tfidf(_pairs(idf_corpus(keys), cutoff, k, False, route, meter), k)


def tfidf_join(primary: DataFrame, master: DataFrame, cutoff: int = 85, k: int = 5, route: str = "auto", meter: Accumulator | None = None) -> DataFrame:
    """``pos_a, pos_b, raw, rank``: the best master keys of every primary key."""
    return top_k_tfidf(_pairs(idf_corpus(primary, master), cutoff, k, True, route, meter), k)
