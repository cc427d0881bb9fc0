"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct ``k``-word shingles as 64-bit hashes. Documents with equal sets form a class; only
classes go on. A sketch holds the class's minwise token for each of ``COORDINATES`` hash functions.

Each of several independent *trees* branches the classes recursively: a node picks one of the coordinates by a hash of
its own name (now and then two, so that the expected number of nodes that a pair of the wanted similarity shares does
not fall with depth) and sends its members on by their minwise token there. Nodes that are small enough, in members
and in bytes, are leaves: their full sets are compared exhaustively, and links with
``100 * intersection >= percent * union`` connect their classes. A pair at the threshold meets in a tree with a
probability of at least 0.64 if its nodes are leaves at once; ``TREES`` trees leave it apart with less than 1e-5. Where
nodes branch further, a pair at the threshold goes on with one child per level on average, and all trees share the sketch,
so more is missed: in a simulation of pairs at 0.8, 0.4 % at depth 4, 1.4 % at depth 6 and 9.2 % at depth 12.

Early in the first trees, nodes that are too large are compared in chunks that all hold the node's first member, which
connects families. From then on a node whose members are one component ends, and one with few members outside its
largest component ends too: these few are compared with all members, chunk by chunk.
Leaves with the same first member meet in one group, so a class's set travels once for all the trees in which it meets
the same neighbours, and a leaf returns only as many links as connect its members. A node that is still too large at
the last depth is cut into chunks that all hold its first member; whatever remains outside its largest component is
then compared with all chunks, so no pair of such a node is lost.

Nothing is collected but counts. Sets travel only for members of leaves. Null and blank texts have empty sets and are
linked with nothing. Rows with the same id are separate documents if their sets differ. A class whose ids are all null
has a null component and its rows are kept; null ids never win over others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.components import components
from matchloom.llm.tables import BROADCAST_ROWS, col, fresh, parts_for, small
from matchloom.llm.words import WordHashes, blank_words_lower, mix, rolling
from matchloom.plans.scratch import materialise, materialise_counted

COORDINATES = 64
TREES = 12
#: Trees that run before the others, which then pass over what these have connected.
FIRST_TREES = 2
#: Depth of the first trees at which members of too large nodes meet the first member of their node.
HUB_DEPTH = 3
DEPTH = 12
LEAF_ROWS = 800
LEAF_HASHES = 400_000
_BUCKET_HASHES = 600_000
#: Texts that go to a worker at once.
_TEXTS_AT_ONCE = 2000
_SET_SCHEMA = "doc_id long, mark long, n long, key binary, sketch binary"
_K = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _K)
_ODDS = mix(_SEEDS) | np.uint64(1)


def shingles(words: list[bytes], k: int, seen: WordHashes) -> np.ndarray:
    """Sorted distinct hashes; fewer than k words are one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    size = min(k, len(words))
    return np.unique(mix(rolling(seen.of(words), size) + np.uint64(size)))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Minwise token of each coordinate, 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[at : at + 2048, None] ^ _SEEDS) * _ODDS).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                h = shingles(blank_words_lower(text), k, seen)
                rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), sketch(h).tobytes()) if len(h) else (0, None, None))
            n, key, s = zip(*rows) if rows else ((), (), ())
            new = [pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(s, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *new], names=["doc_id", "mark", "n", "key", "sketch"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _roots(trees: range):
    """The first two levels of each tree: names of the nodes that a class falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = _matrix(batch.column("sketch")).astype(np.uint64)
            for tree in trees:
                seed = mix(np.array([tree + 1], np.uint64) * _K)
                one = int(seed[0] % np.uint64(COORDINATES))
                two = (one + 1 + int((seed[0] >> np.uint64(32)) % np.uint64(COORDINATES - 1))) % COORDINATES
                node = mix(mix(s[:, one] * _K + seed) + s[:, two] * _K)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("key"), batch.column("n")], names=["node", "key", "n"])

    return run


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One more level below nodes that are too large."""
    for batch in batches:
        if not batch.num_rows:
            continue
        s = _matrix(batch.column("sketch")).astype(np.uint64)
        node = batch.column("node").to_numpy().view(np.uint64)
        pick = mix(node + np.uint64(1))
        for turn in (0, 1):
            rows = np.arange(len(node)) if turn == 0 else np.flatnonzero(pick >> np.uint64(62) == 0)
            at = ((pick[rows] >> np.uint64(8 * turn)) % np.uint64(COORDINATES)).astype(np.int64)
            child = mix(mix(node[rows] * _K + np.uint64(turn)) + s[rows, at] * _K + at.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("key").take(pa.array(rows)), batch.column("n").take(pa.array(rows))], names=["node", "key", "n"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of bounded blocks of the incidence matrix."""
    m = len(sets)
    if m == 2:
        out = np.diag([len(s) for s in sets]).astype(np.float64)
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], (np.cumsum(count > 1) - 1)[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out, width = np.zeros((m, m)), max(64, (4 << 20) // (4 * m))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        i, j = np.searchsorted(place, (low, low + width))
        block = np.zeros((m, width), np.float32)
        block[owner[i:j], place[i:j] - low] = 1
        out += block @ block.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Connected sets, each paired with the first of its component: what all links of similar sets connect."""
    both = overlaps(sets)
    size = np.diag(both)
    similar = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    left, out = set(range(len(sets))), []
    while left:
        root = min(left)
        left.discard(root)
        front = [root]
        while front:
            i = front.pop()
            for j in [j for j in np.flatnonzero(similar[i]).tolist() if j in left]:
                left.discard(j)
                out.append((root, j))
                front.append(j)
    return out


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        # rows that repeat id and text bring the same set twice
        sets = {key: np.frombuffer(raw, np.uint64) for key, raw in zip(table["key"].to_pylist(), table["hashes"].to_pylist())}
        met: dict[int, set[bytes]] = {}
        for key, nodes in zip(table["key"].to_pylist(), table["nodes"].to_pylist()):
            for node in nodes:
                met.setdefault(node, set()).add(key)
        a, b = [], []
        for members in sorted({tuple(sorted(keys)) for keys in met.values() if len(keys) > 1}):
            for x, y in spanning_links([sets[key] for key in members], percent):
                a.append(members[x])
                b.append(members[y])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


class Join:
    """The state of one join over the classes of a corpus."""

    def __init__(self, docs: DataFrame, k: int, percent: int, leaf_rows: int, leaf_hashes: int, depth: int):
        self.k, self.percent, self.leaf_rows, self.leaf_hashes, self.depth = k, percent, leaf_rows, leaf_hashes, depth
        self.docs = docs
        self.rows = materialise(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(_sets(k), _SET_SCHEMA), "sets", _TEXTS_AT_ONCE)
        grouped = self.rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
        self.classes = materialise(grouped, "classes")
        self.known: DataFrame | None = None

    def leaves(self, trees: range) -> tuple[DataFrame, DataFrame | None]:
        """Members of leaves, ``node, key, n, first``, and of nodes that are too large at the last depth."""
        level = self.classes.mapInArrow(_roots(trees), "node long, key binary, n long")
        out, rest = None, None
        for depth in range(2, self.depth + 1):
            stored = self.named(materialise(level, "level"))
            of_component = stored.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.min("key").alias("first"))
            most = F.max_by(F.struct("component", "c", "w"), F.struct("c", "component")).alias("most")
            stats = of_component.groupBy("node").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.min("first").alias("first"), F.count(F.lit(1)).alias("components"), most)
            # a node whose members earlier trees have connected has nothing left to tell
            stats = stats.filter("components > 1")
            large = (F.col("c") > self.leaf_rows) | (F.col("w") > self.leaf_hashes)
            # few members outside the largest component: they are compared with all at once
            few = ((F.col("c") - F.col("most.c")) * 2 <= self.leaf_rows) & ((F.col("w") - F.col("most.w")) * 2 <= self.leaf_hashes)
            stats = stats.select("node", "first", F.col("most.component").alias("main"), (large & ~few).alias("large"), F.when(large, self.chunks()).otherwise(1).alias("chunks"))
            met, seen = materialise_counted(stored.join(stats, "node"), "members", large=F.count_if("large"))
            h = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
            at = F.explode(F.when(F.col("component") != F.col("main"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(h)))
            tiled = met.filter("not large AND chunks > 1").withColumn("at", at).withColumn("node", F.xxhash64("node", "at"))
            mine = met.filter("not large AND chunks = 1").select("node", "key", "n", "first")
            mine = mine.unionAll(tiled.select("node", "key", "n", F.col("node").cast("string").cast("binary").alias("first")))
            out = mine if out is None else out.unionAll(mine)
            if not seen["large"]:
                break
            rest = met.filter("large").select("node", "key", "n")
            if depth < self.depth:
                if depth == HUB_DEPTH and self.known is None:
                    self.hubs(rest)
                branching = F.broadcast(rest) if seen["large"] <= BROADCAST_ROWS // 2 else rest
                level = self.classes.select("key", "sketch").join(branching, "key").select("node", "key", "n", "sketch").mapInArrow(_branch, "node long, key binary, n long")
        return out, rest if seen["large"] else None

    def named(self, members: DataFrame) -> DataFrame:
        """With the component of each member so far."""
        if self.known is None:
            return members.withColumn("component", F.col("key"))
        return members.join(self.known, "key", "left").withColumn("component", F.coalesce("component", "key"))

    def open_nodes(self, members: DataFrame) -> DataFrame:
        """Members of nodes that hold more than one component so far."""
        if self.known is None:
            return self.named(members)
        named = self.named(members)
        mixed = named.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("node")
        return named.join(mixed, "node", "left_semi")

    def compare(self, members: DataFrame) -> None:
        """Compare the full sets inside each node of ``node, key, n, first`` and connect what is similar."""
        members, seen = materialise_counted(members, "leaves", rows=F.count(F.lit(1)), hashes=F.sum("n"))
        if not seen["rows"]:
            return
        wanted = materialise(members.select("key").distinct().join(self.classes.select("key", "doc"), "key"), "wanted")
        k = self.k

        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = WordHashes()
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    keys, out = [], []
                    for key, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                        h = shingles(blank_words_lower(text), k, seen)
                        if xxhash.xxh3_128_digest(h.tobytes()) == key:
                            keys.append(key)
                            out.append(h.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.binary())], names=["key", "hashes"])

        texts = self.docs.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("doc"))).select("key", "text").mapInArrow(hashes, "key binary, hashes binary")
        buckets = parts_for(members, seen["hashes"], _BUCKET_HASHES)
        bucket = F.pmod(F.xxhash64("first"), F.lit(buckets)).alias("bucket")
        placed = members.groupBy(bucket, "key").agg(F.collect_set("node").alias("nodes")).join(texts, "key")
        links = placed.groupBy("bucket").applyInArrow(_compare(self.percent), "a binary, b binary")
        if self.known is not None:
            links = links.unionAll(self.known.select(F.col("key").alias("a"), F.col("component").alias("b")))
        known, seen = materialise_counted(components(links).select(F.col("node").alias("key"), "component"), "known", n=F.count(F.lit(1)))
        self.known = F.broadcast(known) if seen["n"] <= BROADCAST_ROWS // 2 else known

    def chunks(self) -> Column:
        """Chunks of half a leaf for ``c`` members with ``w`` hashes."""
        return F.greatest(F.ceil(F.col("c") * 2 / self.leaf_rows), F.ceil(F.col("w") * 2 / self.leaf_hashes), F.lit(1)).cast("int")

    def sized(self, large: DataFrame) -> DataFrame:
        """The first member of each node, and how many chunks of half a leaf hold it."""
        stats = large.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.min("key").alias("first"))
        return stats.select("node", "first", self.chunks().alias("chunks"))

    def hubs(self, large: DataFrame) -> None:
        """Compare too large nodes in chunks that all hold the node's first member: a family becomes one component."""
        placed = large.join(self.sized(large), "node").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        everywhere = F.sequence(F.lit(0), F.col("chunks") - 1)
        spread = placed.withColumn("at", F.explode(F.when(F.col("key") == F.col("first"), everywhere).otherwise(F.array("chunk"))))
        self.compare(spread.select(F.xxhash64("node", "at").alias("node"), "key", "n", F.xxhash64("node", "at").cast("string").cast("binary").alias("first")))

    def chunked(self, large: DataFrame) -> None:
        """Nodes that never became small: chunks with a common member first, then what is left against all chunks."""
        large = materialise(large, "large")
        self.hubs(large)
        open_rows = materialise(self.open_nodes(large), "open")
        per = open_rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c"))
        most = per.groupBy("node").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
        rows = open_rows.join(most, "node").join(self.sized(large).select("node", "chunks"), "node").withColumn("side", F.col("component") != F.col("main"))
        others = rows.groupBy("node").agg(F.count_if("side").alias("c"), F.sum(F.when(F.col("side"), F.col("n")).otherwise(0)).alias("w"))
        tiles = F.greatest(F.ceil(F.col("c") * 2 / self.leaf_rows), F.ceil(F.col("w") * 2 / self.leaf_hashes), F.lit(1)).cast("int")
        rows = rows.join(others.select("node", tiles.alias("tiles")), "node")
        h = F.xxhash64("key")
        one = F.when(F.col("side"), F.array(F.pmod(h, F.col("tiles")).cast("int")))
        left = rows.filter("side").withColumn("i", F.explode(one)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        right = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("j", F.pmod(h, F.col("chunks")).cast("int"))
        both = left.select("node", "i", "j", "key", "n").unionAll(right.select("node", "i", "j", "key", "n"))
        self.compare(both.select(F.xxhash64("node", "i", "j").alias("node"), "key", "n", F.xxhash64("node", "i", "j").cast("string").cast("binary").alias("first")).distinct())


def near_duplicates(
    docs: DataFrame,
    k: int,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    leaf_hashes: int = LEAF_HASHES,
    depth: int = DEPTH,
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest id of its component), kept,

    and, to tell rows and components apart: mark (xxhash64 of the text) and group (null for empty sets).
    """
    join = Join(docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")), k, percent, leaf_rows, leaf_hashes, depth)
    for some in (range(min(FIRST_TREES, trees)), range(FIRST_TREES, trees)):
        if not some:
            continue
        members, rest = join.leaves(some)
        join.compare(members)
        if rest is not None:
            join.chunked(rest)
    names = join.classes.select("key", "doc", F.col("key").alias("group"))
    if join.known is not None:
        whose = names.join(join.known.select("key", F.col("component").alias("root")), "key")
        least = whose.groupBy("root").agg(F.min("doc").alias("least"))
        linked = whose.select("key", "root").join(least, "root")
        names = names.join(linked, "key", "left").select("key", F.coalesce("least", "doc").alias("doc"), F.coalesce("root", "key").alias("group"))
    named = join.rows.select("doc_id", "mark", "n", "key").join(names, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("doc"))
    return named.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
        "mark",
        "group",
    )


def report(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    return near_duplicates(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id; columns as given.

    Documents with empty sets all stay; rows that repeat both id and text are one document.
    """
    rows = near_duplicates(docs, k, percent).filter("kept")
    times, mark, one, two, three = fresh(docs.columns, "times", "mark", "kept_id", "kept_mark", "kept_times")
    each = rows.groupBy("group", "doc_id", "mark").agg(F.count(F.lit(1)).alias(times))
    best = each.filter("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "mark", times)).alias("b"))
    chosen = best.select("b.*").unionAll(each.filter("group is null").select("doc_id", "mark", times))
    chosen = chosen.select(F.col("doc_id").alias(one), F.col("mark").alias(two), F.col(times).alias(three))
    stored, seen = materialise_counted(chosen, "chosen", repeated=F.coalesce(F.count_if(F.col(three) > 1), F.lit(0)))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    kept = marked.join(small(stored), F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(mark) == F.col(two)))
    # only rows that repeat meet once more: texts are long
    out = kept if not seen["repeated"] else kept.filter(F.col(three) == 1).unionAll(kept.filter(F.col(three) > 1).dropDuplicates(["doc_id", mark]))
    return out.select(*[col(c) for c in docs.columns])
