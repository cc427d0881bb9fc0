"""Source divergence audit: how far the sources of a language differ in the terms that they use.

A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that at least
``MIN_DOCS`` of its documents hold, V of them. A group (one source of a language) or the language as a whole gives a
kept term that it holds c times ``p = 1 + floor(10**9 * (c + 2) / (N + 2 V))``, N being its sum of c. Two such numbers
differ by ``f(p, q) = floor((p - q)**2 / (p + q))``; all arithmetic is exact.

``f`` depends on the two count levels only. So each block of kept terms becomes a matrix of ones and zeros, a column
for every (group, count level) that occurs in it, level 0 included, and the transpose times the matrix holds the joint
table of every pair of groups: how many terms have level a here and level b there. Each cell is priced once. Terms
that no group of a block holds need no block: all of them have level 0 on both sides and are added at the end.

1. A task counts terms per group and documents per language in slices of bounded size.
2. One exchange by (language, term) sums both, and a window gives each term its documents and its language count.
3. Kept terms go to blocks of some ``_BLOCK`` terms, times blocks of groups, so that a block is bounded in terms and
   in groups. Sums of priced blocks are rows of (pair, value).

Defined results: null text, language and source count as empty; a group without terms still gets its pairs; a language
that keeps no term (V = 0) has pairs of value 0 and no terms; ids play no part, so repeated rows count as often as
they occur; ties go to the smaller item in UTF-8; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.tables import col
from matchloom.plans.scratch import materialise

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Terms in a row that a task holds before it sends a slice, and rows that it sends at once.
_HELD, _ROWS_SENT = 4_000_000, 50_000
_BLOCK = 1024
_GROUPS = 64
#: Terms of one matrix: few, so that few count levels occur.
_ROWS = 64
_BROADCAST_BYTES = 8 << 20
_SALTS = 32
#: ASCII letters become lower-case, other ASCII a space; bytes of non-ASCII characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long"
_TILES = "lang string, one string, other string, value long, terms long"


# --- counting ---------------------------------------------------------------------------------------


class _Numbers(dict):
    """Terms numbered as they come."""

    def __missing__(self, term: bytes) -> int:
        value = self[term] = len(self)
        return value


class _Language:
    """The terms of one language's documents in a slice, as numbers, document by document."""

    def __init__(self) -> None:
        self.numbers, self.sources = _Numbers(), {}
        self.tokens: list[np.ndarray] = []
        self.groups: list[int] = []

    def add(self, source: str, terms: list[bytes]) -> None:
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms)))
        self.groups.append(self.sources.setdefault(source, len(self.sources)))

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """Counts by term and source; then, without a source, the number of documents by term."""
        groups = np.array(self.groups)
        order = np.argsort(groups, kind="stable")
        rank = np.empty(len(groups), np.int64)
        rank[order] = np.arange(len(groups))
        sizes = [len(t) for t in self.tokens]
        # sorted by term, source and document
        keys = np.concatenate(self.tokens) << 32 | np.repeat(rank, sizes)
        if not len(keys):
            return
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        term, group = keys[first] >> 32, groups[order][keys[first] & 0xFFFFFFFF]
        fresh = np.diff(term, prepend=-1) != 0
        run = np.flatnonzero(fresh | (np.diff(group, prepend=-1) != 0))
        times = np.diff(np.append(first[run], len(keys)))
        start = np.flatnonzero(fresh)
        names = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        sources = pa.array([*self.sources, None], pa.string())
        docs = np.diff(np.append(start, len(first)))
        none = np.full(len(start), len(self.sources))
        for terms, owners, n in ((term[run], group[run], times), (term[start], none, docs)):
            for at in range(0, len(n), _ROWS_SENT):
                part = slice(at, at + _ROWS_SENT)
                same = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n[part]), np.int64)))
                arrays = [same, sources.take(pa.array(owners[part])), names.take(pa.array(terms[part])), pa.array(n[part])]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n"])


def count_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs, held = defaultdict(_Language), 0
    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
            terms = text.encode("utf-8", "surrogatepass").translate(_TERMS).split()
            langs[lang].add(source, terms)
            held += len(terms)
            if held >= _HELD:
                for name, one in langs.items():
                    yield from one.rows(name)
                langs, held = defaultdict(_Language), 0
    for name, one in langs.items():
        yield from one.rows(name)


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, n_lang`` of kept terms; rows without a source are the language's own."""
    slices = docs.mapInArrow(count_slices, _COUNTS)
    # one exchange: the sum, the window and its sort all follow from (lang, term)
    summed = slices.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    same = Window.partitionBy("lang", "term")
    in_docs = F.max(F.when(F.col("source").isNull(), F.col("n"))).over(same)
    in_lang = F.sum(F.when(F.col("source").isNotNull(), F.col("n"))).over(same)
    kept = summed.withColumns({"docs": in_docs, "n_lang": in_lang}).filter(F.col("docs") >= min_docs)
    own = F.when(F.col("source").isNull(), F.col("n_lang")).otherwise(F.col("n"))
    return materialise(kept.select("lang", "source", "term", own.alias("n"), "n_lang"), "kept-terms")


# --- pricing ----------------------------------------------------------------------------------------


def _p(n: str, total: str, terms: str) -> Column:
    """From column names; exact also for counts whose product with the scale leaves 64 bits."""
    return F.expr(f"1L + (CAST({SCALE} AS decimal(10,0)) * (CAST({n} AS decimal(20,0)) + 2) div CAST({total} + 2 * {terms} AS decimal(20,0)))")


def _priced(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def level_products(level: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Cells of all joint tables of a block: ``group, group, terms, price`` with the smaller group first.

    ``level`` and ``p`` have a row for each term and a column for each group.
    """
    order = np.argsort(level.sum(axis=1), kind="stable")
    groups = level.shape[1]
    for at in range(0, len(order), _ROWS):
        some, price = level[order[at : at + _ROWS]], p[order[at : at + _ROWS]]
        span = int(some.max(initial=0)) + 1
        names, first, column = np.unique(np.arange(groups) * span + some, return_index=True, return_inverse=True)
        owner, price = names // span, price.ravel()[first]
        hot = np.zeros((len(some), len(names)), np.float32)
        hot[np.repeat(np.arange(len(some)), groups), column.ravel()] = 1.0
        joint = hot.T @ hot  # at most _ROWS in a cell: exact
        a, b = np.nonzero(np.triu(joint))
        apart = owner[a] != owner[b]
        a, b = a[apart], b[apart]
        yield owner[a], owner[b], joint[a, b].astype(np.int64), _priced(price[a], price[b])


def _tile(table: pa.Table) -> pa.Table:
    """One block of terms and two blocks of groups: the value of each pair over the terms present, and their number."""
    sources = table["source"].to_pylist()
    names = sorted(set(sources))
    slot = {s: i for i, s in enumerate(names)}
    group = np.array([slot[s] for s in sources])
    n, p = table["n"].to_numpy(), table["p"].to_numpy()
    side = np.zeros(len(names), np.int64)
    side[group] = table["side"].to_numpy()
    term = table["term"].combine_chunks().dictionary_encode()
    real = term.indices.is_valid().to_numpy(zero_copy_only=False)
    row = term.indices.fill_null(0).to_numpy()
    terms = len(term.dictionary)
    base = np.zeros(len(names), np.int64)
    base[group[~real]] = p[~real]
    level, price = np.zeros((terms, len(names)), np.int64), np.tile(base, (terms, 1))
    level[row[real], group[real]] = n[real]
    price[row[real], group[real]] = p[real]
    value = np.zeros(len(names) ** 2, np.int64)
    for a, b, times, each in level_products(level, price):
        # below 64 * 10**9 in a matrix: exact as floating-point numbers
        value += np.bincount(a * len(names) + b, times * each, minlength=len(value)).astype(np.int64)
    a, b = np.triu_indices(len(names), 1)
    wanted = (side[a] != side[b]) | (side[a] == 2)
    a, b = a[wanted], b[wanted]
    # within one block of groups (side 2) all pairs, else only those across
    lang = table["lang"][0].as_py()
    own = np.array(names, object)
    columns = [pa.array([lang] * len(a), pa.string()), pa.array(own[a], pa.string()), pa.array(own[b], pa.string())]
    columns += [pa.array(value[a * len(names) + b]), pa.array(np.full(len(a), terms, np.int64))]
    return pa.Table.from_arrays(columns, names=["lang", "one", "other", "value", "terms"])


def _with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Join ``lang, source, n_total, v, p0``; the language's own row has a null source."""
    same = lambda a, b: (a["lang"] == b["lang"]) & a["source"].eqNullSafe(b["source"])
    wide = F.sum(F.octet_length("lang") + F.coalesce(F.octet_length("source"), F.lit(0)) + 64)
    if (stats.agg(wide).first()[0] or 0) <= _BROADCAST_BYTES:
        found = F.broadcast(stats)
        return rows.join(found, same(rows, found)).drop(found["lang"], found["source"])
    salted = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(_SALTS)).cast("int"))
    found = dealt.join(salted, same(dealt, salted) & (dealt["salt"] == salted["salt"]))
    return found.drop(salted["lang"], salted["source"], salted["salt"]).drop("salt")


def _pair_values(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, one, other, value, terms`` of pairs that share a block of terms, ``one`` the smaller source."""
    per_lang = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n_groups"))
    cut = per_lang.select(
        "lang", F.ceil(F.col("v") / _BLOCK).cast("int").alias("term_blocks"), F.ceil(F.col("n_groups") / _GROUPS).cast("int").alias("group_blocks")
    )
    sized = groups.join(cut, "lang").filter("term_blocks > 0")
    block = F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int")
    placed = sized.select("lang", "source", "p0", "term_blocks", "group_blocks", block.alias("mine"))
    # level 0 of every group in every block of terms
    zero = placed.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.col("p0").alias("p"), "mine", "group_blocks",
        F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("terms"),
    )
    dealt = priced.filter("source IS NOT NULL").select(
        "lang", "source", "term", "n", "p", F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int").alias("mine"), "group_blocks",
        F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("terms"),
    )
    rows = dealt.unionAll(zero).withColumn("yours", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    mine, yours = F.col("mine"), F.col("yours")
    side = F.when(mine == yours, F.lit(2)).when(mine < yours, F.lit(0)).otherwise(F.lit(1))
    tiles = rows.select("lang", "source", "term", "n", "p", "terms", side.alias("side"), F.least(mine, yours).alias("low"), F.greatest(mine, yours).alias("high"))
    keys = ["lang", "terms", "low", "high"]
    summed = tiles.groupBy(*keys).applyInArrow(_tile, _TILES)
    return summed.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))


def _ranked(rows: DataFrame, limit: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources, and the terms that set a source apart most."""
    blank = [F.coalesce(col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    plain = docs.select(*blank)
    kept = kept_counts(plain, min_docs)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("held"))
    present = plain.select("lang", "source").distinct()
    everyone = present.unionAll(present.select("lang", F.lit(None).cast("string").alias("source")).distinct())
    joined = everyone.join(sums, (everyone["lang"] == sums["lang"]) & everyone["source"].eqNullSafe(sums["source"]), "left")
    joined = joined.select(everyone["lang"], everyone["source"], F.coalesce("n_total", F.lit(0)).alias("n_total"), "held")
    # the language's own row holds each kept term once
    terms = F.max(F.when(F.col("source").isNull(), F.coalesce("held", F.lit(0)))).over(Window.partitionBy("lang"))
    sized = materialise(joined.withColumn("v", terms).drop("held"), "term-sums")
    p0 = F.when(F.col("v") > 0, _p("0", "n_total", "v")).otherwise(F.lit(0))
    stats = sized.withColumn("p0", p0)
    groups = stats.filter("source IS NOT NULL")
    per_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
    own = stats.filter("source IS NULL").select("lang", F.col("n_total").alias("n_all")).join(per_lang, "lang")
    more = stats.join(own, "lang").select(
        "lang", "source", "n_total", "v", "n_all",
        F.ceil(F.col("v") / _BLOCK).cast("int").alias("term_blocks"), F.ceil(F.col("n_groups") / _GROUPS).cast("int").alias("group_blocks"),
    )
    priced = _with_stats(kept, more)
    priced = priced.withColumn("p", _p("n", "n_total", "v")).withColumn("q", _p("n_lang", "n_all", "v"))

    values = _pair_values(priced, groups)
    one, other = groups.alias("g"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")).alias("h")
    pairs = one.join(other, "lang").filter("source <> item").select("lang", "source", "item", "v", "p0", "q0", F.least("source", "item").alias("one"), F.greatest("source", "item").alias("other"))
    apart = F.expr("CASE WHEN v > 0 THEN (p0 - q0) * (p0 - q0) div (p0 + q0) ELSE 0L END")
    found = pairs.join(values, ["lang", "one", "other"], "left")
    whole = F.coalesce("value", F.lit(0)) + apart * (F.col("v") - F.coalesce("terms", F.lit(0)))
    pair_rows = _ranked(found.select("lang", "source", F.lit("pair").alias("part"), "item", whole.alias("value")))

    above = priced.filter("source IS NOT NULL AND n > 0 AND p > q")
    term_value = F.expr("(p - q) * (p - q) div (p + q)")
    term_rows = _ranked(above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), term_value.alias("value")), top)
    return pair_rows.unionAll(term_rows)


def report(docs: DataFrame) -> DataFrame:
    return audit(docs)
