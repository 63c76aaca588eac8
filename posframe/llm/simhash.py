"""Near duplicates by SimHash: fingerprints linked at a small Hamming distance, found with vantage-point trees.

1. Fingerprints of each document: majority bits of the XXH64 hashes of its word shingles (numpy in Arrow batches).
2. Distinct fingerprints only, each with its smallest id; copies never multiply what follows.
3. A vantage-point tree routes every fingerprint to the shard that owns it and, where the triangle inequality leaves a
   boundary within reach, to the neighbouring shards as a visitor. Its upper levels are fitted on a bounded sample; below
   them vantage points are drawn by rule and the radius is the median distance of random bits, so that a tree of any
   depth fits the driver and a shard does not grow with the corpus.
4. In each shard owners are held, visitors stream by; inside, further vantage points prune before blocks are compared
   exactly. A shard reports a spanning forest of its links, never all pairs.
5. The forests' connected components give each document the smallest id it reaches.

A fingerprint may have several views, each of its own shingle length and width: the first is the tree's, and a link needs
every view within its reach. LINKED, one view of three-word shingles at two bits, is strict: an edited word in a hundred is
often beyond it. SIMILAR is for texts whose sets of five-word shingles have a Jaccard similarity of about 0.8 or more:
edited texts keep most of their single words, so a view of single words finds the candidates at a small distance, and a
wide view of five-word shingles, 1,024 bits, decides. For similarity J the views differ in a share acos(2J / (1 + J)) / pi
of their bits: 155 of 1,024 for J = 0.8, with a standard deviation of 11; the bound lies nearly one deviation above.

Defined results
---------------
* Null or empty text, or white space only: fingerprint 0 in every view, linked like any other.
* Fewer words than a shingle has: the whole sequence is the one shingle.
* Null ids: fingerprinted and grouped; such a row may connect others; where a group has no id, component_id is null.
* Repeated rows and ties: alike rows have one fingerprint and one component.
* An empty table gives an empty result; other columns are neither read nor in the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, keep_rows, lean, ship, text_of


@dataclass(frozen=True)
class View:
    """A fingerprint of shingles of `shingle` words, `bits` wide (a multiple of 64), linked at `reach` bits or fewer."""

    shingle: int
    reach: int
    bits: int = 64


#: A text whose fingerprints differ in at most two of 64 bits.
LINKED = (View(3, 2),)
#: A text whose five-word shingles are similar to 0.8 or more, as near as 1,024 bits can tell.
SIMILAR = (View(1, 5), View(5, 165, 1024))
#: Bytes of the fingerprints that a shard should own, the fingerprints of the sample, and how many of them a node needs to
#: be fitted. Each level multiplies the visitors, by more the wider the reach; inside a shard a level costs no shuffle.
SHARD_BYTES, SAMPLE, PER_NODE = 1 << 17, 1 << 16, 64
#: Comparisons made at once, and points of a shard that all others meet first.
BLOCK, LEADERS = 1 << 18, 64
#: Visitors of a shard that are searched for together.
VISITORS = 1 << 14


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Further 64 bits from 64-bit hashes, by multiplications and shifts; salt 0 leaves them as they are."""
    if not salt:
        return hashes
    h = hashes ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return h ^ h >> np.uint64(31)


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of columns of zeros and ones, in bytes as long as they hold them."""
    whole = len(bits) // 255 * 255
    blocks = bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8)
    return blocks.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)


def fingerprint(text: bytes, shingle: int = 3, bits: int = 64, seed: int = 42) -> bytes:
    """The fingerprint's bits, most significant first; the first 64 are those of the shingles' XXH64."""
    words = text.lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return bytes(bits // 8)
    shingle = min(shingle, len(words))
    grams = zip(*(islice(words, i, None) for i in range(shingle)))  # never all at once
    votes, n = np.zeros(bits, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 14):
        part = [b" ".join(g) for g in islice(grams, 1 << 14)] if shingle > 1 else words[at : at + (1 << 14)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in part), np.uint64, len(part))
        words_of = np.stack([_mixed(hashes, salt) for salt in range(bits // 64)], axis=1)
        votes += _column_sums(np.unpackbits(words_of.astype(">u8").view(np.uint8).reshape(-1, bits // 8), axis=1))
    return np.packbits(votes * 2 > n).tobytes()


def fingerprints(docs: DataFrame, views: tuple[View, ...] = LINKED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, fp, rest): fp, the first view's 64 bits as a long; rest, the other views' bits, one after another.

    mark is a hash of the text that tells rows of one id apart.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, rest = [], []
            for body in batch.column(2):
                first, *others = [fingerprint(body.as_py(), v.shingle, v.bits) for v in views]
                prints.append(int.from_bytes(first, "big", signed=True))
                rest.append(b"".join(others))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(rest, pa.binary())], names=["doc_id", "mark", "fp", "rest"])

    body = text_of(docs, text)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), body.cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, mark long, fp long, rest binary")


def _distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _vantage(points: np.ndarray, tries: int = 8) -> np.uint64:
    """Of a few points, the one from which the others' distances spread most."""
    some = points[:: max(1, len(points) // 512)]
    candidates = points[:: max(1, len(points) // tries)][:tries]
    return max(candidates, key=lambda c: float(_distances(some, c).var()))


class VPTree:
    """A complete binary tree in heap order: left of node i, within radius[i] of vantage[i]; right, beyond."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.fitted = min(levels, max(1, len(sample) // PER_NODE).bit_length())
        self.vantage = np.zeros(1 << self.fitted, np.uint64)
        self.radius = np.full(1 << self.fitted, 64, np.int16)  # 64: everything is left
        self._fit(np.unique(sample), 1)

    def _at(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vantage points and radii of nodes, fitted or by rule."""
        known = node < 1 << self.fitted
        here = np.where(known, node, 0)
        return np.where(known, self.vantage[here], _mixed(node.astype(np.uint64), 1)), np.where(known, self.radius[here], 31)

    def _fit(self, points: np.ndarray, node: int) -> None:
        if node >= 1 << self.fitted or len(points) < 2:
            return
        self.vantage[node] = vantage = _vantage(points)
        d = _distances(points, vantage)
        middle = np.median(d)
        # of the two radii about the middle, the one that halves the points better
        self.radius[node] = radius = min((int(middle) - 1, int(middle)), key=lambda r: abs(int((d <= r).sum()) * 2 - len(d)))
        self._fit(points[d <= radius], 2 * node)
        self._fit(points[d > radius], 2 * node + 1)

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, shard, whether the shard owns it), for the shards that a point must meet.

        A pair within reach that a node separates is found once: its left point goes right as a visitor, and from then
        on to every side within reach; points that a node owns on its right do not come back left.
        """
        at, node, own = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.levels):
            vantage, radius = self._at(node)
            d = _distances(points[at], vantage)
            inside = d <= radius
            left, right = inside | ~own & (d - reach <= radius), ~inside | (d + reach > radius)
            at, node, own = np.concatenate([at[left], at[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1]), np.concatenate([(own & inside)[left], (own & ~inside)[right]])
        return at, node, own


def near(queries: np.ndarray, members: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (index into queries, index into members) of all pairs within reach; exact.

    Rings about a vantage point: a query meets only the members whose distance to it differs by reach at most.
    """
    work = [(np.arange(len(queries)), np.arange(len(members)))]
    while work:
        q, m = work.pop()
        if len(q) * len(m) > BLOCK:
            vantage = _vantage(members[m])
            dq, dm = _distances(queries[q], vantage), _distances(members[m], vantage)
            if dm.max() - dm.min() > 2 * reach:
                for ring in np.unique(dq):
                    close = m[(dm >= ring - reach) & (dm <= ring + reach)]
                    if len(close):
                        work.append((q[dq == ring], close))
                continue
        step = max(1, BLOCK // max(1, len(m)))
        for at in range(0, len(q) if len(m) else 0, step):
            i, j = np.nonzero(np.bitwise_count(queries[q[at : at + step], None] ^ members[m][None, :]) <= reach)
            if len(i):
                yield q[at + i], m[j]


class Forest:
    """Union-find over 0..n-1, a block of links at a time; a root is its component's smallest."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        out = self.parent[of]
        while (up := self.parent[out]).tobytes() != out.tobytes():
            out = up
        return out

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
        self.parent = self.roots(np.arange(len(self.parent)))


class Points:
    """Fingerprints of a shard: the first view's, the others' as rows of 64-bit words, and the nodes' names."""

    def __init__(self, fp: np.ndarray, rest: np.ndarray, node: np.ndarray):
        self.fp, self.rest, self.node = fp, rest, node

    @classmethod
    def of(cls, fp: pa.Array, rest: pa.Array, node: pa.Array) -> Points:
        words = np.frombuffer(b"".join(rest.to_pylist()), np.uint64)
        return cls(fp.to_numpy().view(np.uint64), words.reshape(len(fp), -1), node.to_numpy())

    @classmethod
    def joined(cls, parts: list[Points]) -> Points:
        return cls(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("fp", "rest", "node")))

    def __getitem__(self, at: slice | np.ndarray) -> Points:
        return Points(self.fp[at], self.rest[at], self.node[at])


def linked(queries: Points, members: Points, views: tuple[View, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (index into queries, index into members) of all pairs that every view links."""
    for q, m in near(queries.fp, members.fp, views[0].reach):
        at = 0
        for view in views[1:]:
            words = slice(at, at + view.bits // 64)
            close = np.bitwise_count(queries.rest[q, words] ^ members.rest[m, words]).sum(axis=1, dtype=np.int16) <= view.reach
            q, m, at = q[close], m[close], words.stop
        if len(q):
            yield q, m


class _Shard:
    """The owners of a shard; gives a spanning forest of the links of owners and of visitors with owners.

    A link inside a component adds nothing to the forest. So points first meet a few leaders; a component that this shows
    to be large is then searched against everything outside it, but not against itself: a template with a million edited
    copies costs a pass over them, not their square.
    """

    def __init__(self, owners: Points, views: tuple[View, ...]):
        self.owners, self.views, self.forest = owners, views, Forest(len(owners.fp))
        self.large: list[tuple[np.ndarray, np.ndarray]] = []  # members, leaders
        self.small = np.arange(len(owners.fp))

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in linked(self.owners[a], self.owners[b], self.views):
            self.forest.link(a[i], b[j])

    def _part(self) -> None:
        """The large components with leaders of each, and all other owners."""
        roots, n = self.forest.parent, len(self.owners.fp)
        names, sizes = np.unique(roots, return_counts=True)
        names = names[sizes >= max(LEADERS, n // LEADERS)]
        self.large = [(m := np.flatnonzero(roots == name), m[:: max(1, len(m) // LEADERS)]) for name in names]
        self.small = np.flatnonzero(~np.isin(roots, names))

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.owners.fp)
        if n > LEADERS:
            self._link(np.arange(n), np.arange(0, n, n // LEADERS))
        self._part()
        outside = self.small
        self._link(outside, outside)
        for members, _ in self.large:
            self._link(members, outside)
            outside = np.concatenate([outside, members])
        self._part()
        roots = self.forest.parent
        far = roots != np.arange(n)
        return self.owners.node[far], self.owners.node[roots[far]]

    def _met(self, visitors: Points, of: np.ndarray, owners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (visitor, root) for the visitors `of` that owners link."""
        for q, m in linked(visitors[of], self.owners[owners], self.views):
            once = np.unique(np.stack([of[q], self.forest.parent[owners[m]]]), axis=1)
            yield once[0], once[1]

    def visit(self, visitors: Points) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        everyone = np.arange(len(visitors.fp))
        found = list(self._met(visitors, everyone, self.small)) if len(self.small) else []
        for members, leaders in self.large:
            met = list(self._met(visitors, everyone, leaders))
            known = np.unique(np.concatenate([q for q, _ in met])) if met else everyone[:0]
            found += met
            found += self._met(visitors, np.setdiff1d(everyone, known, assume_unique=True), members)
        for q, root in found:
            yield visitors.node[q], self.owners.node[root]


def _forests(views: tuple[View, ...]):
    """Over rows (shard, own, fp, rest, node) sorted by shard with owners first: the links (a, b) of each shard's forest."""

    def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def met(shard: _Shard, visitors: list[Points]) -> Iterator[pa.RecordBatch]:
        if visitors:
            for a, b in shard.visit(Points.joined(visitors)):
                yield batch(a, b)
            visitors.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, shard, visitors, waiting = None, [], None, [], 0
        for rows in batches:
            shards, own = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            points = Points.of(*rows.columns[2:])
            starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else []
            for start, end in zip(starts, [*starts[1:], len(shards)]):
                if shards[start] != current:
                    if shard is not None:
                        yield from met(shard, visitors)
                    elif held:  # a shard without visitors
                        yield batch(*_Shard(Points.joined(held), views).own())
                    current, held, shard, waiting = shards[start], [], None, 0
                split = start + int(own[start:end].sum())
                if split > start:
                    held.append(points[start:split])
                if split < end:
                    if shard is None:
                        shard = _Shard(Points.joined(held or [points[:0]]), views)
                        held = []
                        yield batch(*shard.own())
                    visitors.append(points[split:end])
                    waiting += end - split
                    if waiting >= VISITORS:
                        yield from met(shard, visitors)
                        waiting = 0
        if shard is not None:
            yield from met(shard, visitors)
        elif held:
            yield batch(*_Shard(Points.joined(held), views).own())

    return run


def links(distinct: DataFrame, views: tuple[View, ...] = LINKED, shard: int | None = None) -> DataFrame:
    """distinct (fp, rest, node) -> (a, b): links that connect all nodes within reach of each other, directly or by steps.

    shard: the fingerprints a shard should own, by default SHARD_BYTES of them.
    """
    ship(distinct.sparkSession)
    n, shard = distinct.count(), shard or SHARD_BYTES // (8 + sum(v.bits // 8 for v in views))
    levels = max(1, (max(1, n // shard) - 1).bit_length())
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, PER_NODE << levels)).toPandas()["fp"].to_numpy(np.int64)
    tree = VPTree(sample.view(np.uint64), levels)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 4096):
                part = rows.slice(at, 4096)
                i, shards, own = tree.route(part.column(0).to_numpy().view(np.uint64), views[0].reach)
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(own), *[c.take(pa.array(i)) for c in part.columns]], names=["shard", "own", "fp", "rest", "node"])

    routed = distinct.select("fp", "rest", "node").mapInArrow(lean(route), "shard long, own boolean, fp long, rest binary, node long")
    return routed.repartition("shard").sortWithinPartitions("shard", F.col("own").desc()).mapInArrow(lean(_forests(views)), "a long, b long")


def grouped(docs: DataFrame, views: tuple[View, ...] = LINKED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, mark, fp, component_id (the smallest id that its links reach, itself included).

    A node is a number given to each different fingerprint, all views together, once they are written.
    """
    prints = cut(fingerprints(docs, views, doc_id, text), "fingerprints")
    distinct = prints.groupBy("fp", "rest").agg(F.min("doc_id").alias("least"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-fingerprints")
    roots = cut(components(links(distinct, views)).withColumnRenamed("node", "member"), "roots")
    rooted = distinct.join(roots, F.col("node") == F.col("member"), "left").select("fp", "rest", "least", F.coalesce("root", "node").alias("root"))
    smallest = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    by_print = cut(rooted.join(smallest, "root").select("fp", "rest", "component_id"), "component-of-fingerprint")
    return prints.join(by_print, ["fp", "rest"]).select("doc_id", "mark", "fp", "component_id")


def deduplicated(docs: DataFrame, views: tuple[View, ...] = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are: of each group the document with the smallest id.

    Rows without an id go where their group has an id, and stay where it has none.
    """
    decided = grouped(docs, views, doc_id, text)
    return keep_rows(docs, decided.select("doc_id", "mark", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), doc_id, text)
