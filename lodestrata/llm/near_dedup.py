"""SimHash near-dedup: fingerprints within a Hamming radius, found by vantage-point trees over shards.

Sharding. Around any vantage point the distances of 64-bit fingerprints of unlike texts crowd at 32 with a spread of
4, as wide as the search radius itself: a tree whose first split is over all bits would send nearly every
fingerprint to both sides. The space is therefore first partitioned by Hamming distance zero on blocks of bits: with
more blocks than differing bits at least one block (``spare`` + 1 of them) agrees, so the shards of equal blocks hold
every pair. A shard with more rows than a task should hold is split on Spark into rings of distance from a vantage
point; a ring also gets, as visitors, the rows of the next one, so that no pair across their boundary is lost.

Within a shard a vantage-point tree splits at the median distance to a vantage point; the triangle bound keeps apart
what the split shows to be too far, and the strips on both sides of its boundary query each other, so no pair is lost.
A shard of a leaf's size has one vantage point, and pairs are compared only if their distances to it differ by the
radius at most. What lies within the radius of a vantage point is linked to it without looking at pairs, which keeps
groups of thousands of near copies linear.

Groups of copies are one fingerprint from the start, and a shard gives its links as stars, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, few, giving_back
from .components import components
from .simhash import majority, shingle_hashes

#: A node of a tree with so many fingerprints at most is a leaf.
LEAF = 64
#: Fingerprints that a shard is meant to hold on average, and those from which a shard is split into rings.
SHARD, CROWDED = 4096, 1 << 17
#: Times that crowded shards are split; a ball of a few bits' radius holds few distinct fingerprints, so more are of no use.
SPLITS = 6


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp long): the SimHash of each whole text; zero for a null text or one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256).to_pylist()
                fp = majority([shingle_hashes(t or "", width) for t in part])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), "doc_id long, fp long")


class _Links:
    """A union-find over the fingerprints of a shard (a row of 64-bit words each), filled by a vantage-point tree join.
    ``made`` lists the pairs that joined two groups."""

    def __init__(self, fp: np.ndarray, radius: int = 0):
        self.fp, self.radius, self.up, self.made = fp, radius, np.arange(len(fp)), []

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]).sum(axis=-1, dtype=np.int64)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while (further := self.up[r] != r).any():
            r[further] = self.up[r[further]]
        self.up[at] = r
        return r

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        for a_i, b_i in zip(a.tolist(), b.tolist(), strict=True):
            i, j = a_i, b_i
            while self.up[i] != i:
                i = self.up[i]
            while self.up[j] != j:
                j = self.up[j]
            if i != j:
                self.up[max(i, j)] = min(i, j)
                self.made.append((a_i, b_i))

    def one(self, *parts: np.ndarray) -> bool:
        return len(np.unique(np.concatenate([self.roots(p) for p in parts]))) <= 1

    def within(self, p: np.ndarray) -> None:
        """Link all pairs of ``p`` within the radius."""
        todo = [p]
        while todo:
            p = todo.pop()
            if len(p) <= LEAF:
                self.across(p, p)
                continue
            d = self.far(p, p[0])
            near = p[d <= self.radius]
            self.unite(near, np.full(len(near), p[0]))
            if self.one(p):
                continue
            middle = min(int(np.median(d)), int(d.max()) - 1)
            inner, outer = d <= middle, d > middle
            todo += [p[inner], p[outer]]
            self.across(p[inner & (d > middle - self.radius)], p[outer & (d <= middle + self.radius)])

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link the pairs of ``a`` with ``b`` within the radius."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not len(a) or not len(b) or self.one(a, b):
                continue
            if len(a) * len(b) <= LEAF * LEAF:
                near = self.far(a[:, None], b[None, :]) <= self.radius
                i, j = np.nonzero(np.triu(near, 1) if a is b else near)
                self.unite(a[i], b[j])
                continue
            da, db = self.far(a, a[0]), self.far(b, a[0])
            near = b[db <= self.radius]
            self.unite(near, np.full(len(near), a[0]))
            both = np.concatenate([da, db])
            middle = min(int(np.median(both)), int(both.max()) - 1)
            if middle < both.min():  # all at one distance from the vantage point: halve the longer side
                todo += [(x, b) for x in np.array_split(a, 2)] if len(a) >= len(b) else [(a, x) for x in np.array_split(b, 2)]
                continue
            ai, bi, r = da <= middle, db <= middle, self.radius
            parts = [(a[ai], b[bi]), (a[~ai], b[~bi]), (a[ai & (da > middle - r)], b[~bi & (db <= middle + r)]), (a[~ai & (da <= middle + r)], b[bi & (db > middle - r)])]
            if max(len(x) * len(y) for x, y in parts) > 0.9 * len(a) * len(b):  # the split shows little: halve the longer side
                parts = [(x, b) for x in np.array_split(a, 2)] if len(a) >= len(b) else [(a, x) for x in np.array_split(b, 2)]
            todo += parts


def _by_shard(batches: Iterator[pa.RecordBatch], solve: Callable) -> Iterator[pa.RecordBatch]:
    """Rows (block, key, ..) arrive sorted by shard; ``solve`` gets columns of whole shards and the shards' bounds, and
    gives the columns (a, b, of)."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        if not len(cols[0]):
            continue
        starts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        if kept and (kept[-1][0][-1], kept[-1][1][-1]) != (cols[0][0], cols[1][0]):
            starts = np.r_[0, starts]
        if not len(starts):
            kept.append(cols)
            continue
        whole = [np.concatenate(x) for x in zip(*kept, [c[: starts[-1]] for c in cols], strict=True)]
        kept = [[c[starts[-1] :] for c in cols]]
        if len(whole[0]):
            at = np.flatnonzero((np.diff(whole[0]) != 0) | (np.diff(whole[1]) != 0)) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in solve(whole, np.r_[0, at, len(whole[0])])], ["a", "b", "of"])
    if kept:
        whole = [np.concatenate(x) for x in zip(*kept, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in solve(whole, np.array([0, len(whole[0])]))], ["a", "b", "of"])


def _shard_links(batches: Iterator[pa.RecordBatch], ladder: tuple[int, ...], hubs: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (block, key, of, node, words of the fingerprint) arrive sorted by shard. Per shard: pairs (a, b) within the
    last radius that connect it as all such pairs do, closer ones first (by the ladder's radii). With ``hubs`` also,
    for a shard beyond a leaf's size, each node with the one in the middle, as an original is of its edited copies; if
    the shard is a part of a crowded one (``of`` is not zero), the middle node tells itself as (a, a, of)."""

    def solve(cols: list[np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, node, fp = cols[2], cols[3], np.stack(cols[4:], axis=1).view(np.uint64)
        middles: list[int] = []
        size, radius = np.diff(bounds), ladder[-1]
        links, found = _Links(fp), []
        leaf = np.repeat((size > 1) & (size <= LEAF), size)
        rows, shard = np.flatnonzero(leaf), np.repeat(np.arange(len(size)), size)[leaf]
        from_vantage = links.far(rows, bounds[shard])
        order = np.lexsort((from_vantage, shard))
        rows, shard, from_vantage = rows[order], shard[order], from_vantage[order]
        at = np.arange(len(rows))
        for shift in range(1, LEAF):
            at = at[at + shift < len(rows)]
            at = at[(shard[at + shift] == shard[at]) & (from_vantage[at + shift] - from_vantage[at] <= radius)]  # the triangle bound; later rows are farther
            if not len(at):
                break
            d = links.far(rows[at], rows[at + shift])
            near = d <= radius
            found.append((rows[at[near]], rows[at[near] + shift], d[near]))
        if found:
            i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(d, kind="stable")
            links.unite(i[order], j[order])
        for k in np.flatnonzero(size > LEAF):
            own = np.arange(bounds[k], bounds[k + 1])
            for links.radius in ladder:
                links.within(own)
            if hubs:
                middle = np.packbits(np.unpackbits(fp[own].view(np.uint8), axis=1).mean(axis=0) > 0.5).view(np.uint64)
                hub = own[np.bitwise_count(fp[own] ^ middle).sum(axis=1, dtype=np.int64).argmin()]
                near = own[(links.far(own, hub) <= radius) & (own != hub)]
                links.made += zip(near.tolist(), [int(hub)] * len(near), strict=True)
                middles += [int(hub)] if of[hub] else []
        made = np.array(links.made, dtype=np.int64).reshape(-1, 2)
        told = np.array(middles, dtype=np.int64)
        return np.r_[node[made[:, 0]], node[told]], np.r_[node[made[:, 1]], node[told]], np.r_[np.zeros(len(made), np.int64), of[told]]

    return _by_shard(batches, solve)


def block_keys(fp: Column, blocks: int, spare: int) -> Column:
    """An array of (block, key), one per choice of ``spare`` + 1 of the blocks: the bits of those blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    made = []
    for n, chosen in enumerate(combinations(range(blocks), spare + 1)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        made.append(F.struct(F.lit(n).alias("block"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("key")))
    return F.array(*made)


def blocks_for(n: int, radius: int) -> tuple[int, int]:
    """(blocks, spare) for ``n`` distinct fingerprints: as many more blocks than differing bits as keep shards of unlike
    fingerprints at ``SHARD`` rows or so."""
    spare = 0
    while spare < 3 and n >> (64 * (spare + 1) // (radius + 1 + spare)) > SHARD:
        spare += 1
    return radius + 1 + spare, spare


def rings(shards: DataFrame, radius: int, crowded: int = CROWDED, splits: int = SPLITS) -> tuple[DataFrame, list[DataFrame]]:
    """(shards, links): crowded shards of rows (block, key, node, fp) split by distance from a vantage point.

    A ring holds the rows at ``radius`` + 1 successive distances and, as visitors, those of the next ring. Rows within
    the radius of a vantage point are linked to it by ``links``. Rings that are still crowded are split again; each
    split draws its vantage points anew. Rings whose keys are equal by chance are one shard, which costs but loses
    nothing.
    """
    links: list[DataFrame] = []
    for split in range(splits):
        sizes = shards.groupBy("block", "key").agg(F.count("*").alias("n"), F.min_by(F.struct("node", "fp"), F.xxhash64("node", F.lit(split))).alias("vantage")).where(F.col("n") > crowded)
        hot = cut(sizes, "hot")
        if not hot.head(1):
            break
        hot = few(hot)
        rest = shards.join(hot.select("block", "key"), ["block", "key"], "left_anti")
        far = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage.fp")))
        told = cut(shards.join(hot, ["block", "key"]).withColumn("far", far), "told")
        links.append(told.where((F.col("far") <= radius) & (F.col("node") != F.col("vantage.node"))).select(F.col("node").alias("a"), F.col("vantage.node").alias("b")))
        ring = F.floor(F.col("far") / (radius + 1)).cast("int")
        homes = F.array_compact(F.array(ring, F.when(ring > 0, ring - 1)))
        parts = told.select("block", "key", "node", "fp", "vantage", F.explode(homes).alias("ring")).select("block", F.xxhash64("key", "vantage.node", "ring", F.lit(split)).alias("key"), "node", "fp")
        shards = cut(rest.select("block", "key", "node", "fp").unionByName(parts), "rings")
    return shards, links


def near_links(nodes: DataFrame, radius: int = 4, crowded: int = CROWDED) -> DataFrame:
    """From distinct fingerprints (fp, node): links (a, b) of nodes, enough to connect all within the radius."""
    keyed = nodes.select("fp", "node", F.explode(block_keys(F.col("fp"), *blocks_for(nodes.count(), radius))).alias("at")).select("at.block", "at.key", "node", "fp")
    split, links = rings(keyed, radius, crowded)
    shards = split.select("block", "key", F.lit(0).cast("long").alias("of"), "node", "fp").repartition("block", "key").sortWithinPartitions("block", "key", "node")
    out = shards.mapInArrow(giving_back(lambda it: _shard_links(it, (radius,))), "a long, b long, of long").select("a", "b")
    for more in links:
        out = out.unionByName(more)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (the fingerprint's bits as a long), component_id.

    component_id is the smallest id reachable over links of ``radius`` differing bits at most, the own id included.
    Null and wordless texts have fingerprint zero and are linked like any other; a null id gets a null component only
    if no other id is reachable. Repeated rows share a component. Other columns are not read; an empty table gives an
    empty result.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    linked = components(near_links(nodes.where("node is not null"), radius))
    named = cut(nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# Near copies by the similarity of word shingles: least hashes and longer fingerprints find candidates, an exact check decides.

#: Words of a long fingerprint, each from other hashes.
WORDS = 4
#: Radii, in bits of a long fingerprint, up to which candidates are taken; closer ones first. At a similarity of 0.8
#: two fingerprints differ in 39 bits of 256 on average, with a spread of 6, in sets of four and five shingles in 48
#: (beyond the last radius with a chance of 0.0001); unlike texts differ in 128.
LADDER = (12, 20, 28, 36, 44, 52, 62, 72)
#: Of so many nodes one is looked at to find crowded bands.
LOOKED_AT = 64
#: Set sizes whose ratio is below this are looked up together where links failed.
STEP = 1.05
#: Least hashes that make the key of a band, and the chance that no band has a pair at the least similarity.
LEAST_HASHES, MISS = 8, 0.002
#: Shingles whose hashes are compared at once.
MINIMA = 512


def bands_for(similarity: float) -> np.ndarray:
    """Odd multipliers of the hashes of each band (a row): as many bands as are needed to miss a pair at ``similarity``
    with chance ``MISS`` at most. A pair has a band's key in common with chance similarity ** ``LEAST_HASHES``,
    whatever the number of rows."""
    number = 1 if similarity >= 1 else ceil(log(MISS) / log(1 - similarity**LEAST_HASHES))
    return np.random.default_rng(11).integers(0, 1 << 63, (number, LEAST_HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """For each array of distinct shingle hashes the key of each band, made of its least hashes (MinHash)."""
    flat = chosen.reshape(-1, 1)
    least = np.full((len(hashes), len(flat)), np.iinfo(np.uint64).max)
    for own, h in zip(least, hashes, strict=True):
        for at in range(0, len(h), MINIMA):
            np.minimum(own, (flat * h[at : at + MINIMA]).min(axis=1), out=own)
    least = least.reshape(len(hashes), *chosen.shape)
    least ^= least >> np.uint64(31)
    key = (least * chosen[::-1]).sum(axis=2, dtype=np.uint64)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def long_prints(hashes: list[np.ndarray]) -> np.ndarray:
    """SimHash of WORDS times 64 bits for each array of distinct shingle hashes."""
    out = np.zeros((len(hashes), WORDS), dtype=np.uint64)
    for w in range(WORDS):
        mixed = []
        for h in hashes:
            x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * w + 1)) % (1 << 64))
            mixed.append(x ^ (x >> np.uint64(29)))
        out[:, w] = majority(mixed)
    return out


def rare_shingle_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """From (node, label, rest, shingles): pairs (a, b), a > b, of nodes of different labels, one of them with ``rest``
    1 at least, that hold all pairs whose sets have the similarity.

    Shingles are ordered by the number of members that have them. If two sets are similar, so much of both must stand
    behind their first common shingle, itself included, as they must share; that leaves few shingles of each to join by,
    the rarest. A member whose rarest shingles are its own is joined with none, however many it shares with all.
    """
    members = cut(members.where(F.size("shingles") > 0).withColumn("n", F.size("shingles")), "members")
    single = members.select("node", "label", "rest", "n", F.explode("shingles").alias("token"))

    def shared(n: Column, m: Column) -> Column:
        return F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)

    def class_of(n: Column) -> Column:
        return F.floor(F.log(n) / log(STEP)).cast("int")

    n, m, at = F.col("n"), F.col("m"), F.col("at")
    fewest = F.ceil(similarity * n - 1e-9)
    often = single.groupBy("token").agg(F.count("*").alias("often"))
    order = Window.partitionBy("node").orderBy("often", "token")
    ranked = single.join(often, "token").withColumn("at", F.row_number().over(order) - 1)
    first = cut(ranked.where(at <= n - fewest).drop("often"), "first")
    held = first.select(F.col("node").alias("y"), F.col("label").alias("y_label"), n.alias("m"), class_of(n).alias("class"), at.alias("y_at"), "token")
    reach = n - shared(n, F.greatest(F.floor(F.pow(F.lit(STEP), F.col("class"))), fewest))
    rest = first.where("rest = 1").withColumn("class", F.explode(F.sequence(class_of(fewest), class_of(F.floor(n / similarity + 1e-9)))))
    asked = rest.where(at <= reach).select(F.col("node").alias("x"), F.col("label").alias("x_label"), "n", "class", at.alias("x_at"), "token")
    fits = (F.col("x_label") != F.col("y_label")) & (m >= similarity * n - 1e-9) & (n >= similarity * m - 1e-9) & (F.least(n - F.col("x_at"), m - F.col("y_at")) >= shared(n, m))
    found = asked.join(held, ["token", "class"]).where(fits)
    return found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _bands(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.select(F.posexplode("keys").alias("block", "key"), "node", *more)


def _band_pairs(nodes: DataFrame, words: list[str], crowded: int = CROWDED) -> tuple[DataFrame, DataFrame | None]:
    """((a, b), crowded): pairs of nodes that connect the shards of bands, see ``_shard_links``; and the (block, key) of
    crowded shards, if there are any.

    A shard of more than ``crowded`` nodes or so, as far as one node in ``LOOKED_AT`` tells, is dealt over parts by a
    hash; the parts' middle nodes are paired with one of them. The parts do not meet otherwise, so all nodes of crowded
    shards must be looked up.
    """
    drawn = _bands(nodes.where(F.pmod(F.xxhash64("node"), F.lit(LOOKED_AT)) == 0)).groupBy("block", "key").agg(F.count("*").alias("n"))
    hot = cut(drawn.where(F.col("n") * LOOKED_AT > crowded).select("block", "key", F.ceil(F.col("n") * LOOKED_AT / crowded).alias("parts")), "crowded")
    rows, any_hot = _bands(nodes, *words), bool(hot.head(1))
    if any_hot:
        rows = rows.join(few(hot), ["block", "key"], "left")
        part = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts"))
        rows = rows.withColumn("of", F.when(F.col("parts").isNull(), 0).otherwise(F.xxhash64("block", "key"))).withColumn("key", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", part)))
    else:
        rows = rows.withColumn("of", F.lit(0))
    shards = rows.select("block", "key", F.col("of").cast("long").alias("of"), "node", *words).repartition("block", "key").sortWithinPartitions("block", "key", "node")
    told = shards.mapInArrow(giving_back(lambda it: _shard_links(it, LADDER, hubs=True)), "a long, b long, of long")
    if not any_hot:
        return told.select("a", "b"), None
    told = cut(told, "told")
    middles = told.where("of <> 0").select("of", "a")
    centre = middles.groupBy("of").agg(F.min("a").alias("b"))
    return told.where("of = 0").select("a", "b").unionByName(middles.join(centre, "of").where("a <> b").select("a", "b")), hot.select("block", "key")


def _apart(labelled: DataFrame) -> DataFrame:
    """(node, rest) of the nodes of shards with several labels: whether a node is, in one of them, not of the label that
    most have there. Labels are counted before the shuffle, so a crowded shard is no single group."""
    rows = _bands(labelled, "label")
    counts = rows.groupBy("block", "key", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("block", "key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("most")).where("labels > 1")
    return rows.join(most, ["block", "key"]).groupBy("node").agg(F.max((F.col("label") != F.col("most")).cast("int")).alias("rest"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, component_id) of the documents that are linked, directly or over others, to one of smaller id: linked
    are texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more. component_id
    is the smallest id reachable.

    Candidates come from bands of least shingle hashes: in each shard of equal keys the vantage-point tree join over
    long fingerprints gives the pairs that connect it, nearest first; each is then checked on the full shingle sets, and
    only checked links unite. Where a shard is not one group after that, those of its documents that are not of its
    largest group are looked up among the shards' documents by their rarest shingles (``rare_shingle_pairs``), which
    misses no pair of the similarity. Shards of more than ``crowded`` documents are connected in parts only, so all
    their documents take part in that whatever the candidates of the parts were. Rows with a null id are left out, and so are ids that rows of different shingles
    share, as an id could not tell which of them is meant; rows that share an id and its shingles are one document.
    Wordless texts are similar to each other only.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chosen = bands_for(similarity)
    words = [f"f{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            hashes = [np.unique(np.array(shingle_hashes(t or "", width), dtype=np.uint64)) for t in batch.column(1).to_pylist()]
            fp = long_prints(hashes)
            digests = [xxhash.xxh3_128_digest(h.tobytes()) for h in hashes]
            keys = pa.array(list(band_keys(hashes, chosen)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), keys, *(pa.array(fp[:, i].view(np.int64)) for i in range(WORDS))], ["doc_id", "digest", "keys", *words])

    kind = ", ".join(f"{w} long" for w in words)
    prints = cut(rows.mapInArrow(giving_back(run), f"doc_id long, digest binary, keys array<long>, {kind}"), "long")
    unclear = cut(prints.groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("unclear")).where("unclear").select("doc_id"), "unclear")
    if unclear.head(1):
        prints = prints.join(few(unclear), "doc_id", "left_anti")
    named = cut(prints.groupBy("digest", *words).agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "nodes")
    same = prints.select("doc_id", "digest", *words).join(named.select("node", "digest", *words), ["digest", *words]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    nodes = named.select("node", "keys", *words)
    near, hot = _band_pairs(nodes, words, crowded)
    pairs = cut(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    if hot is not None:
        ids = ids.unionByName(_bands(nodes).join(few(hot), ["block", "key"], "left_semi").select(F.col("node").alias("doc_id")))
    ids = cut(ids.distinct(), "ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            found = [sorted({x - (1 << 64) if x >> 63 else x for x in shingle_hashes(t or "", width)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    held = cut(rows.join(few(ids), "doc_id").mapInArrow(giving_back(sets), "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]), "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t")), "b")
        shared = F.size(F.array_intersect("s", "t"))
        return both.where(shared >= similarity * (F.size("s") + F.size("t") - shared)).select("a", "b")

    good = cut(checked(pairs), "good")
    links = good.unionByName(same)
    found = components(links)
    if hot is not None or good.count() < pairs.count():
        some = nodes.join(few(ids), F.col("node") == F.col("doc_id"), "left_semi").select("node", "keys")  # the others are near to none
        labelled = cut(some.join(found.select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("label"), "keys"), "labelled")
        mixed = cut(_apart(labelled), "mixed")
        members = mixed.join(labelled.select("node", "label"), "node").join(held.select(F.col("doc_id").alias("node"), "shingles"), "node")
        further = cut(rare_shingle_pairs(members, similarity).join(pairs, ["a", "b"], "left_anti"), "further")
        more = cut(checked(further), "more")
        if more.head(1):
            found = components(links.unionByName(more))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that have a similar document of smaller id in their group. Rows that
    ``similar_groups`` leaves out stay; the columns, whatever their names, are those of ``docs``."""
    groups = similar_groups(docs, id_col, text_col, **options)
    gone = f"_gone_{'_'.join(docs.columns)}"
    drop = cut(groups.where("component_id <> doc_id").select(F.col("doc_id").alias(gone)), "drop")
    return docs.join(few(drop), F.col(f"`{id_col}`").cast("long") == F.col(f"`{gone}`"), "left_anti")
