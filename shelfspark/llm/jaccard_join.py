"""Exact n-gram Jaccard self-join with connected groups.

Jaccard distance is a metric, and so is the size of the symmetric difference.
The join uses both:

1. The empty set is the first pivot. A document's distance from it is its size;
   size bands are its regions, and a document in the window of the next smaller
   band is copied there (sizes of linked documents differ by the threshold at
   most).
2. In a band, linked sets differ in at most D shingles. M > D hash cells divide
   all shingles, so two linked documents agree on M - D cells at least; documents
   that agree on a cell of their band meet in one region (connected by stars,
   never by pairs). A document may leave out its cells of up to w shingles if they
   are fewer than M - D: some agreeing cell is larger, and both keep it. Frequent
   shingles (found in a sample; which they are changes the work, not the result)
   are set aside first, as that can't add differences; documents with little
   else meet by their whole sets too. Unrelated documents are near distance 1
   from every pivot document, where no window prunes; this step keeps them apart
   exactly.
3. A region larger than ``max_region`` is divided by pivot documents: each
   member goes to its nearest pivot's Voronoi region and, by the triangle
   inequality, into each other one within twice the radius of that distance.
   Regions that don't shrink are cut into pairs of blocks. This repeats until
   every region is small.
4. A task joins a small region by the same recursion in memory, and leaves out
   pairs that are connected already.

Equal sets are one member, so copies are never paired. Nothing is approximate
but for 64-bit hashes of shingles.

Defined results: null, empty and wordless texts have no shingles and no links;
a text of fewer than n words is one shingle; rows with the same id are one node;
rows with a null id keep a null component; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import keep, materialize, scratch, small_side
from .textscan import mix, ngrams, released, scan, slices, small_batches

_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class JoinSpec:
    """Two sets link when 100 * intersection >= percent * union."""

    n: int = 5
    percent: int = 80
    max_region: int = 2000
    sample_every: int = 16  # one document in so many, by hash, tells which shingles are frequent
    frequent: int = 4  # documents of the sample that hold a frequent shingle, at least
    max_frequent: int = 1 << 18  # of the frequent, the most frequent; bounds the broadcast

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    words = scan(texts, True)
    hashes = words.hashes()
    grams, first = ngrams(words, hashes, n)
    at = np.searchsorted(first, words.offsets)
    out = []
    for i, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:], strict=True)):
        if 0 < b - a < n:
            h = np.uint64(0)
            for x in hashes[a:b]:
                h = mix(np.array([h], np.uint64) * _C1 + x)[0]
            out.append(mix(np.array([h], np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.unique(grams[at[i] : at[i + 1]]))
    return out


@cache
def bands(percent: int) -> list[int]:
    """Least sizes of the bands, each two thresholds wide."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * 10**4 // percent**2)))
    return lows


def cell_keys(size: int, s: np.ndarray, percent: int, kind: int) -> tuple[np.ndarray, bool]:
    """Keys of the cells of ``s`` in each band of a document of ``size`` shingles; whether its empty cells could go everywhere."""
    lows, out, sparse = bands(percent), [], True
    own = int(np.searchsorted(lows, size, "right")) - 1
    lowest = int(np.searchsorted(lows, -(-size * percent // 100), "right")) - 1
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s + _C2), out=total[1:])
    for band in range(lowest, own + 1):
        most = (lows[band + 1] - 1) * (100 - percent) // percent  # differences of two linked sets, the smaller in this band
        spare = most // 2
        cells = most + 1 + spare
        count = np.bincount((((s >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64), minlength=cells)
        end = np.cumsum(count)
        j = np.arange(cells, dtype=np.uint64)
        keys = mix(total[end] - total[end - count] + mix(j * _C1 + np.uint64(2 * band + kind)) + count.astype(np.uint64))
        small = int(np.searchsorted(np.cumsum(np.bincount(count)), spare, "right")) - 1  # cells of up to so many shingles may go
        sparse &= small >= 0
        out.append(keys[count > small])
    return np.concatenate(out), sparse


def region_keys(s: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """The regions of a set; two linked sets share one at least."""
    rest = s
    if frequent is not None and len(frequent):
        rest = s[frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s]
    keys, sparse = cell_keys(len(s), rest, percent, 0)
    return keys if sparse else np.concatenate([keys, cell_keys(len(s), s, percent, 1)[0]])


class Region:
    """The sets of one region; ``root`` tells which are connected."""

    def __init__(self, sets: list[np.ndarray], spec: JoinSpec):
        self.spec, self.size = spec, np.array([len(s) for s in sets])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.sets = np.split(flat, np.cumsum(self.size)[:-1])
        # who holds each shingle: an overlap costs what its pivot's shingles are shared, not the region
        self.holders = np.repeat(np.arange(len(sets)), self.size)[np.argsort(flat, kind="stable")]
        self.holds = np.bincount(flat, minlength=1)
        self.first = np.cumsum(self.holds) - self.holds
        self.parent = list(range(len(sets)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)

    def overlaps(self, p: int) -> np.ndarray:
        n = self.holds[self.sets[p]]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.first[self.sets[p]], n)
        return np.bincount(self.holders[at], minlength=len(self.size))

    def resolve(self, p: int, members: np.ndarray) -> np.ndarray:
        """Link the pivot with all members in its radius; returns the distances."""
        both = self.overlaps(p)[members]
        union = self.size[p] + self.size[members] - both
        for m in members[100 * both >= self.spec.percent * union]:
            self.link(p, m)
        return 1 - both / union

    def apart(self, members: np.ndarray) -> bool:
        first = self.root(members[0])
        return any(self.root(i) != first for i in members)

    def join(self, members: np.ndarray) -> None:
        """Resolve all pairs of members: pivots, Voronoi regions with windows, and again."""
        left = members
        while len(left) > 1 and self.apart(left):
            p = left[0]
            near_p = self.resolve(p, left)
            if len(left) < 32:
                left = left[1:]
                continue
            q = left[int(np.argmax(near_p))]
            near_q = self.resolve(q, left)
            window, rest = 2 * self.spec.radius + 1e-9, (left != p) & (left != q)
            first, second = (left[rest & (x <= y + window)] for x, y in ((near_p, near_q), (near_q, near_p)))
            if max(len(first), len(second)) < 0.7 * len(left):
                self.join(first)
                self.join(second)
                return
            left = left[rest]


def frequent_shingles(docs: DataFrame, spec: JoinSpec) -> np.ndarray:
    """Sorted shingles that many documents of the sample hold, ``max_frequent`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, "text"):
                yield pa.record_batch({"s": pa.array(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(part.column("text"), spec.n)]).view(np.int64))})

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(spec.sample_every)) == 0)
    counts = sample.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= spec.frequent)
    return np.sort(np.array([r[0] for r in counts.orderBy(F.col("count").desc(), "s").limit(spec.max_frequent).collect()], np.int64).view(np.uint64))


def measured(docs: DataFrame, spec: JoinSpec) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text): set sizes with 128-bit set hashes, and the regions of each document."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, spec))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), spec.n)
                sums = [(int(np.sum(mix(s ^ _C1))) & (1 << 64) - 1, int(np.sum(mix(s + _C1))) & (1 << 64) - 1) for s in sets]
                h1, h2 = (np.array([x[k] for x in sums], np.uint64).view(np.int64) for k in (0, 1))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "h1": pa.array(h1), "h2": pa.array(h2)})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, "text"):
                ids, out, owner, seen = part.column("doc_id").to_pylist(), [], [], {}
                for i, s in zip(ids, shingle_sets(part.column("text"), spec.n), strict=True):
                    if len(s) and i is not None:
                        # copies in the same slice ride with the first: the set's hash is a region of its own
                        whole = mix(np.array([np.sum(mix(s ^ _C1))], np.uint64) + np.uint64(len(s)))
                        k = whole if int(whole[0]) in seen else np.concatenate([whole, region_keys(s, spec.percent, frequent.value)])
                        seen[int(whole[0])] = True
                        out.append(k)
                        owner.append(np.full(len(k), i, np.int64))
                if out:
                    yield pa.record_batch({"key": pa.array(np.concatenate(out).view(np.int64)), "doc_id": pa.array(np.concatenate(owner))})

    return docs.mapInArrow(sizes, "doc_id long, n_shingles long, h1 long, h2 long"), docs.mapInArrow(keys, "key long, doc_id long")


def split_region(big: DataFrame, spec: JoinSpec, level: int) -> DataFrame:
    """Divide regions (region, doc_id, text) by pivot documents, with windows; see the module.

    A region gets at most 32 pivots a level, so what each row is joined with is bounded.
    """
    counts = big.groupBy("region").agg(F.count("*").alias("n_"))
    order = Window.partitionBy("region").orderBy(F.xxhash64("doc_id", F.lit(level)), "doc_id")
    k = F.least(F.lit(32), F.ceil(F.col("n_") * 2 / spec.max_region) + 1)
    pivots = big.select("region", "doc_id", "text").withColumn("r_", F.row_number().over(order)).where("r_ <= 32").join(counts, "region").where(F.col("r_") <= k)
    pivots = pivots.groupBy("region").agg(F.collect_list("text").alias("pivots_"), F.first("n_").alias("n_"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[np.ndarray]] = {}
        for batch in released(batches):
            sets, ids, regions, pivot_texts = shingle_sets(batch.column("text"), spec.n), batch.column("doc_id").to_pylist(), batch.column("region").to_pylist(), batch.column("pivots_")
            row, to = [], []
            for i, (s, region) in enumerate(zip(sets, regions, strict=True)):
                if region not in known:
                    known = {region: shingle_sets(pivot_texts[i].values, spec.n)}
                both = np.array([len(np.intersect1d(s, p, assume_unique=True)) for p in known[region]])
                far = 1 - both / (np.array([len(p) for p in known[region]]) + len(s) - both)
                for j in np.flatnonzero(far <= far.min() + 2 * spec.radius + 1e-9):
                    row.append(i)
                    to.append(int(mix(np.array([region], np.int64).view(np.uint64) * _C1 + np.uint64(j + 1)).view(np.int64)[0]))
            yield pa.record_batch({"region": pa.array(to, pa.int64()), "doc_id": pa.array([ids[i] for i in row], pa.int64()), "parent_n": batch.column("n_").take(pa.array(row, pa.int64())), "text": batch.column("text").take(pa.array(row, pa.int64()))})

    return big.join(pivots, "region").select("region", "doc_id", "n_", "text", "pivots_").mapInArrow(assign, "region long, doc_id long, parent_n long, text string")


def split_blocks(stuck: DataFrame, spec: JoinSpec) -> DataFrame:
    """Divide regions (region, doc_id, text, n) into pairs of blocks: every two members meet in one of them."""
    g = F.ceil(2 * F.col("n") / spec.max_region).cast("long")
    own = F.pmod(F.xxhash64("doc_id"), g)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), g - 1), lambda o: F.xxhash64("region", F.least(own, o), F.greatest(own, o)))
    return stuck.select(F.explode(pairs).alias("region"), "doc_id", "text")


def join_regions(rows: DataFrame, spec: JoinSpec) -> DataFrame:
    """Edges (a, b) that connect the linked members of each region (region, doc_id, text)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(regions: np.ndarray, ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
            edges, cuts = [], [0, *(np.flatnonzero(np.diff(regions)) + 1), len(regions)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    region = Region(sets[a:b], spec)
                    region.join(np.argsort(region.size, kind="stable"))
                    edges += [(ids[a + i], ids[a + region.root(i)]) for i in range(b - a) if region.root(i) != i]
            return edges

        held_r, held_i, held_s = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in released(batches):
            for part in slices(batch, "text"):
                held_r = np.concatenate([held_r, part.column("region").to_numpy()])
                held_i = np.concatenate([held_i, part.column("doc_id").to_numpy()])
                held_s = [*held_s, *shingle_sets(part.column("text"), spec.n)]
                whole = int(np.searchsorted(held_r == held_r[-1], True))  # the last region may go on
                edges = solve(held_r[:whole], held_i[:whole], held_s[:whole])
                held_r, held_i, held_s = held_r[whole:], held_i[whole:], held_s[whole:]
                yield pa.record_batch({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})
        edges = solve(held_r, held_i, held_s)
        yield pa.record_batch({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(joined, "a long, b long")


def jaccard_join(docs: DataFrame, spec: JoinSpec = JoinSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row, as a written table; see the module."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return keep(_joined(docs, spec, id_col, text_col), "components")


def _joined(docs: DataFrame, spec: JoinSpec, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes, keys = measured(rows, spec)
    sizes = materialize(sizes, "set-sizes")
    meet = F.min("doc_id").over(Window.partitionBy("key"))
    stars = keys.select("doc_id", meet.alias("to")).where("doc_id <> to")
    regions = materialize(components(stars, "doc_id", "to").select(F.col("node").alias("doc_id"), F.col("component").alias("region")), "regions")

    classes = sizes.where("n_shingles > 0 and doc_id is not null").join(regions, "doc_id")
    own = ["region", "n_shingles", "h1", "h2"]
    heads = classes.groupBy(own).agg(F.min("doc_id").alias("head"))
    copies = classes.join(heads, own).where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    # regions of a single distinct set are done
    several = heads.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(heads.join(several, "region").select("region", F.col("head").alias("doc_id"), "n"), "members")

    with_text = lambda m: rows.where("doc_id is not null").join(small_side(m), "doc_id")
    links = join_regions(with_text(members.where(F.col("n") <= spec.max_region)).select("region", "doc_id", "text"), spec)
    big, level = members.where(F.col("n") > spec.max_region), 0
    if not big.isEmpty():
        now = materialize(with_text(big).select("region", "doc_id", "text"), "big-regions")
        while not now.isEmpty():
            level += 1
            parts = split_region(now, spec, level)
            parts = materialize(parts, "regions")
            n = parts.groupBy("region").agg(F.count("*").alias("n"), F.max("parent_n").alias("parent"))
            sized = parts.drop("parent_n").join(n, "region")
            links = links.unionByName(join_regions(sized.where(F.col("n") <= spec.max_region).select("region", "doc_id", "text"), spec))
            over = sized.where(F.col("n") > spec.max_region)
            stuck = F.col("n") * 10 > F.col("parent") * 7
            links = links.unionByName(join_regions(split_blocks(over.where(stuck), spec), spec))
            now = materialize(over.where(~stuck).select("region", "doc_id", "text"), "big-regions")
    labels = components(links.unionByName(copies)).select(F.col("node").alias("doc_id"), "component")
    return sizes.join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, spec: JoinSpec = JoinSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each connected group, that of the least id; rows that repeat an id and text count as one.

    Rows with a null id stay.
    """
    labels = jaccard_join(docs, spec, id_col, text_col).where("doc_id is not null")
    gone = materialize(labels.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct(), "near-copies")
    left = docs.join(small_side(gone), id_col, "left_anti")
    repeated = materialize(labels.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col)), "repeated-ids")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(repeated, id_col, "left_anti").unionByName(once)
