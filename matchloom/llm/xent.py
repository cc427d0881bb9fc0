"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Two bigram models share one vocabulary of words, known by their 64-bit hashes; words and pairs are counted exactly over
all documents. Counts of the background are scaled to the target's number of words, so both are smoothed alike: a
pair's probability is interpolated with the word's, and the word's with the uniform one over the vocabulary. A token's
loss is its negative log probability; a document's score is the mean over its tokens of target loss minus background
loss, so that lower means closer to the target.

One pass counts words, as words and as last words of a text, and Spark sums them; only totals, the size of the vocabulary
and the at most ``1 / HOT_SHARE`` hot words pass the driver. A second pass cuts the documents into blocks of some million
words and sends each bucket of words its share of each block as one packed row: the pairs that end in these words, the
documents of each pair, and how often. So all pairs of a word meet in one group, which knows the counts of pairs, words
and histories and returns one pair of sums for each of its documents; a last group for each block adds them up. Pairs
that end in a hot word are dealt by pair, and its counts are told to all. Documents that are both counted and scored
travel once.

Null and empty texts have no tokens and score 0. Pairs that were not counted have the loss of a new pair of their words.
Without target documents all losses are those of the uniform distribution. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.tables import col, fresh, small
from matchloom.llm.words import WordHashes, blank_words_lower, mix
from matchloom.plans.scratch import materialise, materialise_counted

#: A block ends at so many words or documents; places of documents in a block take two bytes.
_BLOCK_WORDS, _BLOCK_TEXTS = 1 << 20, 1 << 16
#: Words of a bucket: a task takes some 150 bytes for each.
_BUCKET_WORDS = 1 << 20
#: Words with more than this share of all tokens.
HOT_SHARE = 1 / 2000
#: Weight of the word model against a pair's history, and of the uniform model against the word model.
PAIR_WEIGHT, WORD_WEIGHT = 4.0, 0.5
_K = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = ("t", "b", "last_t", "last_b")
_PACKED = ("targets", "words", "word_pairs", "pairs", "pair_texts", "texts", "times", "last", "keys", "tokens", "sums")
_BLOCK_SCHEMA = "bucket int, block long, counted boolean, asked boolean, " + ", ".join(f"{c} binary" for c in _PACKED)
_PART_SCHEMA = "block long, keys binary, tokens binary, texts binary, sums binary"


def _texts(batches: Iterator[pa.RecordBatch], words: int, texts: int) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """First columns and word hashes of the texts that have words, some at a time."""
    seen = WordHashes()
    firsts, keys, hashes, held = [], [], [], 0
    for batch in batches:
        for first, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            h = seen.of(blank_words_lower(text))
            if len(h):
                firsts.append(first)
                keys.append(key)
                hashes.append(h)
                held += len(h)
            if held >= words or len(hashes) >= texts:
                yield firsts, keys, hashes
                firsts, keys, hashes, held = [], [], [], 0
    if hashes:
        yield firsts, keys, hashes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for targets, _, hashes in _texts(batches, _BLOCK_WORDS, _BLOCK_TEXTS):
        sizes = np.array([len(h) for h in hashes])
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        target = np.array(targets, bool)
        last = place[np.cumsum(sizes) - 1]
        count = lambda at, keep=None: np.bincount(at if keep is None else at[keep], minlength=len(words))
        counts = (count(place, np.repeat(target, sizes)), count(place), count(last, target), count(last))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *map(pa.array, counts)], names=["word", *_COUNTS])


@dataclass(frozen=True)
class Models:
    """Counts of the target, ``t``, and of all documents, ``b``; pairs are counted where documents are scored."""

    docs: DataFrame  # the documents counted, with `target` and `text_col` as given
    target: Column
    text_col: str
    words: DataFrame  # word, t, b, last_t, last_b: counts as a word, and as the last word of a text
    hot: dict[str, np.ndarray]  # the same columns of the hot words, by rising unsigned hash
    totals: tuple[float, float]
    texts: tuple[float, float]
    vocabulary: int

    def scales(self) -> tuple[float, float]:
        return 1.0, self.totals[0] / self.totals[1] if self.totals[1] and self.totals[0] else 1.0

    def log_words(self, side: int, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Logarithm of a pair's smoothed count: what its probability has above the fraction line."""
        s = self.scales()[side]
        p_word = (word * s + WORD_WEIGHT) / (self.totals[side] * s + WORD_WEIGHT * self.vocabulary)
        return np.log(pair * s + PAIR_WEIGHT * p_word)

    def log_history(self, side: int, history: np.ndarray) -> np.ndarray:
        return np.log(history * self.scales()[side] + PAIR_WEIGHT)

    def told(self) -> Models:
        """Without the tables: what tasks are told."""
        return Models(None, None, "", None, self.hot, self.totals, self.texts, self.vocabulary)


def _at_hot(hot: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place among the hot words, or -1."""
    if not len(hot):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    return np.where(hot[at] == words, at, -1)


def _raw(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _shares(values: np.ndarray, kind, homes: np.ndarray, used: np.ndarray) -> pa.Array:
    """Rows of numbers, ordered by bucket, as the bytes of each used bucket; nothing is copied once more."""
    packed = np.ascontiguousarray(values, kind)
    edges = np.append(np.searchsorted(homes, used), len(homes)) * (packed.nbytes // max(len(packed), 1))
    return pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(packed)])


def _blocks(models: Models, buckets: int, counted: bool, asked: bool):
    """Blocks of ``target, key, text``: for each bucket its words, their pairs, and the texts of these; one row for the block itself."""
    hot = models.hot["word"]
    kinds = [("bucket", pa.int32()), ("block", pa.int64()), ("counted", pa.bool_()), ("asked", pa.bool_()), *((c, pa.binary()) for c in _PACKED)]
    starts = [float(models.log_history(side, np.array([models.texts[side]]))[0]) for side in (0, 1)]
    hot_history = [models.log_history(side, models.hot[c] - models.hot[f"last_{c}"]) for side, c in enumerate("tb")]

    def block(number: int, targets: list, keys: list, hashes: list[np.ndarray]) -> Iterator[dict]:
        sizes = np.array([len(h) for h in hashes])
        ends, n_texts = np.cumsum(sizes), len(sizes)
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        text = np.repeat(np.arange(n_texts), sizes)
        before = np.empty(len(place), np.int64)
        before[1:] = place[:-1]
        before[ends - sizes] = len(words)
        common = {"block": number, "counted": counted, "asked": asked, "targets": np.packbits(np.array(targets, bool)).tobytes()}
        at = _at_hot(hot, words)
        if asked:
            history = np.ones(len(place), bool)
            history[ends - 1] = False
            known = np.flatnonzero(history & (at >= 0)[place])
            sums = [s + np.bincount(text[known], h[at[place[known]]], n_texts) for s, h in zip(starts, hot_history)]
            row = common | {"bucket": number % buckets, "keys": b"".join(keys), "tokens": _raw(sizes, np.int64), "sums": _raw(np.array(sums), np.float64)}
            yield {c: [v] for c, v in row.items()}
        last = place[ends - 1]
        code, of_token = np.unique(place * (len(words) + 1) + before, return_inverse=True)
        del place, before
        posting, times = np.unique(of_token * n_texts + text, return_counts=True)
        del of_token, text
        word, ahead = code // (len(words) + 1), code % (len(words) + 1)
        del code
        pair = mix(words[word] * _K + np.append(words, np.uint64(0))[ahead])
        del ahead
        word_home = (mix(words + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
        home = np.where(at[word] >= 0, (pair % np.uint64(buckets)).astype(np.int64), word_home[word])
        owner, text_of = posting // n_texts, (posting % n_texts).astype(np.uint16)
        del posting
        per_pair = np.bincount(owner, minlength=len(word))
        of_home = home[owner]
        del owner
        by_home = np.argsort(of_home, kind="stable")
        order = np.argsort(home, kind="stable")
        word, home = word[order], home[order]
        # one place for each word of a bucket: pairs are ordered by bucket, then by word
        begins = np.flatnonzero((np.diff(home, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
        mine, mine_home = word[begins], home[begins]
        used = np.unique(home)
        low = np.searchsorted(mine_home, used)
        # the last word of a text is no history: where that word is not hot, its group is told
        ended = np.flatnonzero(at[last] < 0)
        ended = ended[np.argsort(word_home[last[ended]], kind="stable")]
        run_of = np.zeros(len(words), np.int64)
        run_of[mine] = np.arange(len(mine))
        ended_home = word_home[last[ended]]
        lasts = np.column_stack((ended, run_of[last[ended]] - low[np.searchsorted(used, ended_home)]))
        share = lambda values, kind, homes: _shares(values, kind, homes, used)
        yield {
            "bucket": pa.array(used.astype(np.int32)),
            **{c: pa.array([v] * len(used)) for c, v in common.items()},
            "words": share(words[mine], np.uint64, mine_home),
            "word_pairs": share(np.diff(np.append(begins, len(word))), np.uint32, mine_home),
            "pairs": share(pair[order], np.uint64, home),
            "pair_texts": share(per_pair[order], np.uint32, home),
            "texts": share(text_of[by_home], np.uint16, of_home[by_home]),
            "times": share(times[by_home], np.uint32, of_home[by_home]),
            "last": share(lasts, np.uint32, ended_home),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for at, some in enumerate(_texts(batches, _BLOCK_WORDS, _BLOCK_TEXTS)):
            number = (part << 32) | (at << 1) | int(counted)
            for columns in block(number, *some):
                n = len(columns["bucket"])
                arrays = [pa.array(columns[c], kind) if isinstance(columns.get(c), list) else columns.get(c, pa.nulls(n, kind)) for c, kind in kinds]
                yield pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in kinds])

    return run


def _sum_bucket(models: Models):
    """The sums of each block's texts over the pairs that end in the words of one bucket."""
    hot = models.hot

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("block", "keys", "tokens", "texts", "sums")}
        shares, bits = [], []
        for row in table.to_pylist():
            if row["keys"] is not None:
                for c in out:
                    out[c].append(row[c])
            else:
                shares.append({c: row[c] for c in ("block", "counted", "asked")})
                bits.append(row)
        if not shares:
            return pa.table(_part_columns(out))
        read = lambda c, kind: [np.frombuffer(row[c], kind) for row in bits]
        targets = [np.unpackbits(x).astype(bool) for x in read("targets", np.uint8)]
        offsets = np.cumsum([0] + [len(x) for x in targets])
        counted = np.repeat([s["counted"] for s in shares], np.diff(offsets))
        target = np.concatenate(targets) & counted
        names = read("words", np.uint64)
        word_offsets = np.cumsum([0] + [len(x) for x in names])
        words, word_at = np.unique(np.concatenate(names), return_inverse=True)
        word_of_pair = np.repeat(word_at, np.concatenate(read("word_pairs", np.uint32)))
        pairs, pair_at = np.unique(np.concatenate(read("pairs", np.uint64)), return_inverse=True)
        word_of = np.empty(len(pairs), np.int64)
        word_of[pair_at] = word_of_pair
        per_pair = np.concatenate(read("pair_texts", np.uint32))
        at = np.repeat(pair_at, per_pair)
        places = read("texts", np.uint16)
        text = np.concatenate(places) + np.repeat(offsets[:-1], [len(x) for x in places])
        times = np.concatenate(read("times", np.uint32)).astype(np.float64)
        ended = [x.reshape(-1, 2).astype(np.int64) for x in read("last", np.uint32)]
        last_text = np.concatenate([x[:, 0] + o for x, o in zip(ended, offsets)])
        last_word = word_at[np.concatenate([x[:, 1] + o for x, o in zip(ended, word_offsets)])]
        del bits[:], names, places
        is_hot = _at_hot(hot["word"], words)
        cold = (is_hot < 0)[word_of][at]
        sums = []
        for side, (c, keep) in enumerate((("t", target), ("b", counted))):
            weight = times * keep[text]
            in_pair = np.bincount(at, weight, len(pairs))
            in_word = np.bincount(word_of, in_pair, len(words))
            history = in_word - np.bincount(last_word, keep[last_text], len(words))
            if len(hot["word"]):
                in_word = np.where(is_hot < 0, in_word, hot[c][is_hot])
            above = models.log_words(side, in_pair, in_word[word_of])
            below = models.log_history(side, history)
            loss = times * (np.where(cold, below[word_of][at], 0.0) - above[at])
            total = np.bincount(text, loss, offsets[-1]) - np.bincount(last_text, below[last_word], offsets[-1])
            sums.append(total)
        met = np.bincount(text, minlength=offsets[-1]) > 0
        for share, low, high in zip(shares, offsets[:-1], offsets[1:]):
            if share["asked"]:
                here = np.flatnonzero(met[low:high])
                out["block"].append(share["block"])
                out["keys"].append(None)
                out["tokens"].append(None)
                out["texts"].append(_raw(here, np.uint16))
                out["sums"].append(_raw(np.array([s[low:high][here] for s in sums]), np.float64))
        return pa.table(_part_columns(out))

    return run


def _part_columns(out: dict[str, list]) -> dict[str, pa.Array]:
    return {c: pa.array(x, pa.int64() if c == "block" else pa.binary()) for c, x in out.items()}


def _sum_block(table: pa.Table) -> pa.Table:
    """``key, n_tokens, target_loss, background_loss`` of the texts of one block."""
    rows = table.to_pylist()
    head = next(row for row in rows if row["keys"] is not None)
    tokens = np.frombuffer(head["tokens"], np.int64)
    sums = np.frombuffer(head["sums"], np.float64).reshape(2, -1).copy()
    for row in rows:
        if row["keys"] is None:
            sums[:, np.frombuffer(row["texts"], np.uint16)] += np.frombuffer(row["sums"], np.float64).reshape(2, -1)
    keys = [head["keys"][i : i + 16] for i in range(0, len(head["keys"]), 16)]
    columns = [pa.array(keys, pa.binary()), *map(pa.array, (tokens, *(sums / tokens)))]
    return pa.table(columns, names=["key", "n_tokens", "target_loss", "background_loss"])


def fit(docs: DataFrame, target: Column, text_col: str = "text") -> Models:
    """Count all documents, those where ``target`` is true by themselves; the background is all of them."""
    rows = _rows(docs, target, text_col).withColumn("key", F.lit(None).cast("binary"))
    counted = rows.mapInArrow(_count, "word long, " + ", ".join(f"{c} long" for c in _COUNTS))
    sums = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    words, seen = materialise_counted(sums, "word-counts", n=F.count(F.lit(1)), **{c: F.sum(c) for c in _COUNTS})
    total = {c: float(seen[c] or 0) for c in _COUNTS}
    hot = words.filter(F.col("b") > total["b"] * HOT_SHARE).toArrow()
    known = {c: hot[c].to_numpy().astype(np.float64) for c in _COUNTS} | {"word": hot["word"].to_numpy().view(np.uint64)}
    order = np.argsort(known["word"])
    # one place more for words that were not counted
    return Models(docs, target, text_col, words, {c: x[order] for c, x in known.items()}, (total["t"], total["b"]), (total["last_t"], total["last_b"]), seen["n"] + 1)


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(col(text_col).cast("binary")))


def _rows(docs: DataFrame, target: Column, text_col: str) -> DataFrame:
    text = col(text_col)
    return docs.select(F.coalesce(target, F.lit(False)).alias("target"), _digest(text_col).alias("key"), text.alias("text")).filter("text is not null")


def score(docs: DataFrame, models: Models, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` plus one struct ``n_tokens, target_loss, background_loss, score``; and its name."""
    out, key, found = fresh(docs.columns, "xent", "text_key", "found")
    same = docs is models.docs and text_col == models.text_col
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, int(models.totals[1] // _BUCKET_WORDS) + 1)
    told = models.told()
    sent = _rows(models.docs, models.target, models.text_col).mapInArrow(_blocks(told, buckets, True, same), _BLOCK_SCHEMA)
    if not same:
        sent = sent.unionAll(_rows(docs, F.lit(False), text_col).mapInArrow(_blocks(told, buckets, False, True), _BLOCK_SCHEMA))
    parts = sent.groupBy("bucket").applyInArrow(_sum_bucket(told), _PART_SCHEMA)
    texts = parts.groupBy("block").applyInArrow(_sum_block, "key binary, n_tokens long, target_loss double, background_loss double")
    # repeated texts meet under one key
    done = texts.groupBy("key").agg(*[F.max(c).alias(c) for c in ("n_tokens", "target_loss", "background_loss")])
    fields = F.struct("n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
    done = materialise(done.select(F.col("key").alias(key), fields.alias(found)), "text-losses")
    none = F.struct(F.lit(0).cast("long").alias("n_tokens"), *[F.lit(0.0).alias(c) for c in ("target_loss", "background_loss", "score")])
    joined = docs.join(small(done), _digest(text_col) == F.col(key), "left")
    return joined.select(*[col(c) for c in docs.columns], F.coalesce(F.col(found), none).alias(out)), out


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Target: documents that ``labels`` marks as good (quality 1). One row for each document."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("good")).distinct()
    rows = docs.select("doc_id", "text")
    marked = rows.join(small(good), F.col("doc_id") == F.col("good"), "left")
    got, out = score(marked, fit(marked, F.col("good").isNotNull()))
    x = F.col(out)
    return got.select("doc_id", *[x[n].alias(n) for n in ("n_tokens", "target_loss", "background_loss", "score")])
