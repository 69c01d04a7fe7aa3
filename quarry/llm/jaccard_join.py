"""Similarity join of texts on 5-word shingles by signature trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored
from .components import components

WORDS = 5
PERCENT = 80
#: Fewest and most counters of shingles (in between one for each COUNTED rows or so); one that is far above the mean holds a
#: frequent shingle, which prefixes take last. Tasks' counters are summed FAN at a time.
COUNTERS, MOST_COUNTERS, COUNTED, FAN = 1 << 18, 1 << 22, 1 << 10, 16
#: Fewest and most bits of a text's signature, least parts of a frequent shingle's rows, rows of a part that are aimed at.
BITS, MOST_BITS, PARTS, PART_ROWS = 2048, 1 << 16, 64, 50_000
#: Rows of a block of a large group (a text of more than ROW_SHINGLES counts as several), children of a node, rows in one traversal.
BLOCK, ROW_SHINGLES, LEAF, CHUNK = 256, 1024, 16, 4096
#: Node pairs whose children are paired at once, where signatures have 32 words; of longer ones fewer.
STEP = 500
SLICE = 64

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; fewer words: the whole sequence as one; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.array([], np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(w) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(31))) * MIX[i % 5] + w[i : i + m]
    h ^= h >> np.uint64(32)
    h *= MIX[0]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def digest(tokens: np.ndarray) -> int:
    """Name of a shingle set: 64 bits, as shingles have themselves."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def least(n: int, percent: int = PERCENT) -> int:
    """The fewest shingles that a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, rare: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Enough shingles that two linked sets have one in common: the first n - least(n) + 1 in an order that all sets share,
    frequent ones last; and which of them are frequent."""
    often = ~rare[(tokens & np.uint64(len(rare) - 1)).astype(np.int64)]
    order = np.concatenate([np.flatnonzero(~often), np.flatnonzero(often)])[: len(tokens) - least(len(tokens), percent) + 1]
    return tokens[order], often[order]


def width(n: np.ndarray) -> np.ndarray:
    """Bits of the signature of a set of n: at least two a shingle, a power of two from BITS to MOST_BITS."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * np.asarray(n), 1))).astype(np.int64), BITS, MOST_BITS)


def signature(tokens: np.ndarray) -> np.ndarray:
    """A longer signature folds to a shorter one by the OR of its halves."""
    bits = int(width(len(tokens)))
    flags = np.zeros(bits, np.uint8)
    flags[((tokens >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.int64)


# -- signature trees ---------------------------------------------------------------------------------------------------------
class Forest:
    """A tree over each run of rows with one key: leaves of LEAF rows, inner nodes of LEAF nodes, up to one root. A node holds the
    OR of its rows' signatures, their range of sizes, the most by which a row's size exceeds the bits of its signature, and its
    component if all rows have the same. levels[0] is rows; below[d][v] is the first child of node v of level d."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, comps: np.ndarray):
        slack = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels, self.below, owner = [(bits, sizes, sizes, slack, comps)], [None], np.asarray(keys)
        while True:
            change = np.append(True, owner[1:] != owner[:-1])
            first = np.flatnonzero(change)
            if len(first) == len(owner):
                break
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            at = np.flatnonzero(place % LEAF == 0)
            b, lo, hi, s, c = self.levels[-1]
            same = np.minimum.reduceat(c, at)
            same = np.where(same == np.maximum.reduceat(c, at), same, -1)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(s, at), same))
            self.below.append(np.append(at, len(owner)))
            owner = owner[at]
        self.keys = owner

    def roots(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key's root, -1 where it has none; a root is on the top level."""
        at = np.searchsorted(self.keys, keys)
        return np.where((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys), at, -1)


def _possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a linked pair of rows of different components. Rows that share k shingles share at least
    k - slack bits; sets of sizes p and q link only with percent / (100 + percent) * (p + q) shared."""
    ok = (100 * x[2][i] >= percent * y[1][j]) & (100 * y[2][j] >= percent * x[1][i]) & ~((x[4][i] >= 0) & (x[4][i] == y[4][j]))
    at = np.flatnonzero(ok)
    i, j = i[at], j[at]
    common = np.bitwise_count(x[0][i] & y[0][j]).sum(axis=1).astype(np.int64) + np.minimum(x[3][i], y[3][j])
    small = np.minimum(np.minimum(x[2][i], y[2][j]), common)
    ok[at] = small * (100 + percent) >= percent * (x[1][i] + y[1][j])
    return ok


def _children(forest: Forest, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child of each node and how many it has; nodes above a lower forest's top are their own child."""
    if depth >= len(forest.levels):
        return nodes, np.ones(len(nodes), np.int64)
    return forest.below[depth][nodes], forest.below[depth][nodes + 1] - forest.below[depth][nodes]


def dual(x: Forest, i: np.ndarray, y: Forest, j: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that a traversal down from the root pairs (i, j) leaves; for a forest with itself each pair once. Of children's pairs
    about STEP nodes' are made at a time, and only those kept that may hold a link."""
    top = lambda f, depth: f.levels[min(depth, len(f.levels) - 1)]
    depth, step = max(len(x.levels), len(y.levels)) - 1, max(1, STEP * 32 // x.levels[0][0].shape[1])
    ok = _possible(top(x, depth), i, top(y, depth), j, percent)
    i, j = i[ok], j[ok]
    while depth:
        left, right = [i[:0]], [j[:0]]
        for at in range(0, len(i), step):
            (p, n), (q, m) = _children(x, depth, i[at : at + step]), _children(y, depth, j[at : at + step])
            nth = np.arange((n * m).sum()) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            wide = np.repeat(m, n * m)
            p, q = np.repeat(p, n * m) + nth // wide, np.repeat(q, n * m) + nth % wide
            if x is y:
                p, q = p[p <= q], q[p <= q]
            ok = _possible(top(x, depth - 1), p, top(y, depth - 1), q, percent)
            left.append(p[ok])
            right.append(q[ok])
        i, j = np.concatenate(left), np.concatenate(right)
        depth -= 1
    return (i[i < j], j[i < j]) if x is y else (i, j)


def tree_pairs(cell: np.ndarray, side: np.ndarray, node: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """Candidate pairs (a, b) of whole cells, with their cell and the most that they can share of both: of each cell's rows of
    side -1 (a group that is whole) among themselves, or of its side 0 with its side 1. Trees are of rows with signatures of one
    width; each is traversed with itself and with the next width's, folded, as sizes that may link differ by less than a width."""
    comp = np.unique(comp, return_inverse=True)[1]
    order = np.lexsort((node, comp, n, side, cell))
    cell, side, node, n, comp, bits = cell[order], side[order], node[order], n[order], comp[order], [bits[k] for k in order]
    name = np.append(0, np.cumsum((cell[1:] != cell[:-1]) | (side[1:] != side[:-1])))  # of a cell's side
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    whole = name[first[side[first] == -1]]
    two = np.flatnonzero((cell[first][1:] == cell[first][:-1]) & (side[first][:-1] == 0))
    words = np.array([len(b) for b in bits])
    found = [(node[:0], node[:0], cell[:0], np.array([]))]

    def grown(rows: np.ndarray, w: int) -> Forest:
        return Forest(name[rows], n[rows], np.stack([np.bitwise_or.reduce(np.asarray(bits[k], np.int64).reshape(-1, w), axis=0) for k in rows]).view(np.uint64), comp[rows])

    def add(x: Forest, x_rows: np.ndarray, x_names: np.ndarray, y: Forest, y_rows: np.ndarray, y_names: np.ndarray) -> None:
        i, j = x.roots(x_names), y.roots(y_names)
        i, j = dual(x, i[(i >= 0) & (j >= 0)], y, j[(i >= 0) & (j >= 0)], percent)
        p, q = x.levels[0], y.levels[0]
        common = np.concatenate([np.bitwise_count(p[0][i[k : k + 50_000]] & q[0][j[k : k + 50_000]]).sum(axis=1) for k in range(0, len(i), 50_000)] or [i])
        share = (common + np.minimum(p[3][i], q[3][j])) / (p[1][i] + q[1][j])
        u, v = node[x_rows[i]], node[y_rows[j]]
        found.append((np.minimum(u, v), np.maximum(u, v), cell[x_rows[i]], share))

    for w in np.unique(words):
        own, wider = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        x = grown(own, w)
        add(x, own, whole, x, own, whole)
        # sides differ, so no pair comes twice; a forest with another is never "with itself"
        if len(two):
            sides = [np.flatnonzero((words == w) & np.isin(name, k)) for k in (two, two + 1)]
            if len(sides[0]) and len(sides[1]):
                add(grown(sides[0], w), sides[0], two, grown(sides[1], w), sides[1], two + 1)
        if len(wider):
            y = grown(wider, w)
            add(x, own, whole, y, wider, whole)
            add(x, own, two, y, wider, two + 1)
            add(y, wider, two, x, own, two + 1)
    return tuple(np.concatenate(c) for c in zip(*found))


def spanning(a: np.ndarray, b: np.ndarray, cell: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a spanning forest of the graph of all pairs, most similar pairs first, and the cells of the pairs left out."""
    if not len(a):
        return a, b, cell
    order = np.lexsort((cell, b, a, -share))
    a, b, cell = a[order], b[order], cell[order]
    again = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
    a, b, cell = a[~again], b[~again], cell[~again]
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, keep = list(range(len(ends))), np.zeros(len(a), bool)
    for k, (i, j) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            up[j] = i
            keep[k] = True
    return a[keep], b[keep], np.unique(cell[~keep])


# -- passes over the texts ---------------------------------------------------------------------------------------------------
def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark: a row is told from another with its id by the mark of its text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("mark"))


def counters(rows: int) -> int:
    """How many counters a table of so many rows gets: a power of two."""
    return max(COUNTERS, min(MOST_COUNTERS, 1 << max(0, rows // COUNTED - 1).bit_length()))


def _profile(docs: DataFrame, n_words: int, size: int = COUNTERS) -> DataFrame:
    """doc_id, mark, n, node (digest of the shingle set), bits (its signature) of each text, and from each task a row with its
    `size` shingle counters, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        names = ["doc_id", "mark", "n", "node", "bits", "counts"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = [shingles(t, n_words) for t in part.column(1).to_pylist()]
                np.add.at(counts, (np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.list_(pa.int64())), pa.nulls(len(sets), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    return _texts(docs).mapInArrow(run, "doc_id long, mark long, n long, node long, bits array<long>, counts binary")


def _rare(profile: DataFrame) -> np.ndarray:
    """Which counters hold no frequent shingle: those not six deviations of chance (and 16) above the mean. Tasks' counters are
    summed as arrays, FAN at a time in a tree, so that rows are as many as tasks; one row comes to the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch.column(0):
                own = np.frombuffer(one.as_buffer(), "<i8")
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    rows = profile.where("counts IS NOT NULL").select("counts")
    tasks = rows.count()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        rows = stored(rows.repartition(tasks).mapInArrow(summed, "counts binary"))
    last = rows.repartition(1).mapInArrow(summed, "counts binary").first()
    counts = np.frombuffer(last["counts"], "<i8") if last else np.zeros(COUNTERS, np.int64)
    return counts <= counts.mean() + 6 * np.sqrt(counts.mean()) + 16


def _postings(docs: DataFrame, rare: np.ndarray, n_words: int, percent: int, parts: int) -> DataFrame:
    """token, part, node, n: the prefix of each distinct set (once a task). Rows of frequent shingles are split in parts from 1."""
    packed = np.packbits(rare).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, seen = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool), set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found = []
                for text in batch.column(1).slice(at, SLICE).to_pylist():
                    tokens = shingles(text, n_words)
                    if len(tokens) and (node := digest(tokens)) not in seen:
                        seen.add(node)
                        found.append((node, len(tokens), *prefix(tokens, mask, percent)))
                if found:
                    sizes = np.array([len(f[2]) for f in found])
                    wide = lambda x, kind: np.repeat(np.array(x, kind), sizes)
                    split = wide([1 + f[0] % parts for f in found], np.int32) * np.concatenate([f[3] for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[2] for f in found]).view(np.int64)), pa.array(split.astype(np.int32)), pa.array(wide([f[0] for f in found], np.int64)), pa.array(wide([f[1] for f in found], np.int32))], ["token", "part", "node", "n"])

    return _texts(docs).mapInArrow(run, "token long, part int, node long, n int")


def _mixed_up(x: np.ndarray) -> np.ndarray:
    x = (x.view(np.uint64) ^ (x.view(np.uint64) >> np.uint64(29))) * MIX[0]
    return (x ^ (x >> np.uint64(32))) * MIX[1]


def grouped(token: np.ndarray, part: np.ndarray, node: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """group, part, node, n of the rows of whole (token, part) runs that have company. Rows that sizes keep apart are apart. A group
    is named by its members, so the shingles of one passage make one group; a frequent shingle's is named by the shingle, and keeps all rows."""
    if not len(token):
        return token, part, node, n
    order = np.lexsort((node, n, part, token))
    token, part, node, n = token[order], part[order], node[order], n[order]
    run = np.append(True, (token[1:] != token[:-1]) | (part[1:] != part[:-1]))
    keep = run | np.append(True, node[1:] != node[:-1])
    token, part, node, n, run = token[keep], part[keep], node[keep], n[keep].astype(np.int64), run[keep]
    first = np.flatnonzero(run | ((part == 0) & np.append(False, 100 * n[:-1] < percent * n[1:])))
    count = np.diff(np.append(first, len(token)))
    if not len(first):
        return token, part, node, n
    with np.errstate(over="ignore"):
        name = (np.add.reduceat(_mixed_up(node), first) + count.astype(np.uint64) * MIX[2]).view(np.int64)
    name = np.where(part[first] > 0, token[first], name)
    once = np.zeros(len(first), bool)
    once[np.unique(name, return_index=True)[1]] = True
    kept = np.repeat((part[first] > 0) | (once & (count > 1)), count)
    return np.repeat(name, count)[kept], part[kept], node[kept], n[kept]


def _groups(postings: DataFrame, percent: int) -> DataFrame:
    """The rows of postings that have company, by group; a run of rows that a batch ends in waits for the next batch."""
    names = ["group", "part", "node", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []

        def out(columns: list) -> Iterator[pa.RecordBatch]:
            found = grouped(*columns, percent)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2]), pa.array(found[3].astype(np.int32))], names)

        rows = 0
        for batch in batches:
            waiting.append([batch.column(k).to_numpy() for k in range(4)])
            rows += batch.num_rows
            token, part = waiting[-1][0], waiting[-1][1]
            if rows < 200_000 or not len(token) or (token[0] == token[-1] and part[0] == part[-1]):
                continue
            columns = [np.concatenate(c) for c in zip(*waiting)]
            end = int(np.flatnonzero((columns[0] != token[-1]) | (columns[1] != part[-1]))[-1]) + 1
            yield from out([c[:end] for c in columns])
            waiting, rows = [[c[end:] for c in columns]], len(columns[0]) - end
        if waiting:
            yield from out([np.concatenate(c) for c in zip(*waiting)])

    # a run must be whole in one task, in order
    return postings.repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(run, "group long, part int, node long, n int")


def _sets(docs: DataFrame, profile: DataFrame, nodes: DataFrame, n_words: int) -> DataFrame:
    """node, tokens of the given nodes, from the texts of one document of each."""
    # copies are one before they meet; a semi-join, as `nodes` are distinct, but one that isn't taken to before the aggregate
    ids = profile.groupBy("node").agg(F.max("doc_id").alias("doc_id")).join(nodes, "node")
    wanted = stored(ids.select("node", F.xxhash64("doc_id").alias("id")))
    # other texts are mostly left out before they reach Python, by a bitmap of their ids: 16 bits each, 16 MB at most
    count = wanted.count()
    if not count:
        return docs.sparkSession.createDataFrame([], "node long, tokens array<long>")
    size = 1 << min(27, max(15, (16 * count).bit_length()))
    found = wanted.groupBy(F.expr(f"pmod(id, {size}) div 32768").alias("k")).agg(F.expr(f"bitmap_construct_agg(pmod(id, {size}) % 32768)").alias("bits")).collect()
    bitmap = bytearray(size >> 3)
    for r in found:
        bitmap[r["k"] * 4096 : (r["k"] + 1) * 4096] = bytes(r["bits"])
    known = bytes(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(known, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            pick = np.flatnonzero(mask[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for lo in range(0, len(pick), SLICE):
                sets = [shingles(t, n_words) for t in batch.column(1).take(pa.array(pick[lo : lo + SLICE])).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "tokens"])

    texts = _texts(docs).select(spot_of("doc_id", size).alias("at"), "text")
    return texts.mapInArrow(run, "node long, tokens array<long>").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def spot_of(doc_id: str, size: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(size)).cast("long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their whole shingle sets."""
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), (F.size("x") + F.size("y")).cast("long").alias("all"))
    return both.where(100 * F.col("common") >= percent * (F.col("all") - F.col("common"))).select("a", "b")


def jaccard_components(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs.

    A set is a text's distinct n_words-word shingles, A-Z in lower case. Two rows link when 100 * shared >= percent * joint
    shingles; component_id is the smallest doc_id that links reach. Null and empty texts have no shingles and link with nothing.
    Equal sets are one node, however many rows have them. Repeated rows link. Null ids count for nothing in a component's
    smallest id. An empty table gives no rows; other columns are not read.

    Rows of texts that share a prefix shingle (linked sets share one) are the groups over which signature trees are built; groups
    with the same members are one. Trees are traversed in pairs: pairs of nodes go on only if the OR of their signatures and their
    sizes allow a link. Of the pairs that are left, a spanning forest is compared first, by whole sets; where others are left
    out, trees are traversed again, not where both nodes are inside one component, and all pairs are compared. Groups of more
    than BLOCK rows are blocks of classes of sizes, so no group meets in one task.
    """
    known = _labelled(docs, n_words, percent)
    smallest = stored(known.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    return matched(known, smallest, "comp").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def matched(rows: DataFrame, small: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """rows left-joined to small (a row a key). Keys that hold more than one row in `most` (and over 64 rows) are at most `most`:
    those rows stay where they are and get theirs by broadcast, so no key's rows meet in one task."""
    total = rows.count()
    hot = [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(64, total // most)).select(key).collect()]
    if not hot:
        return rows.join(small, key, "left")
    some = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(some).join(F.broadcast(small.where(F.col(key).isin(hot))), key, "left").unionByName(rows.where(~some).join(small, key, "left"))


def one_of_each(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component of links: that of the smallest doc_id, a null one counting as the largest, then of the
    smallest text mark. A row is known by its id and text, so other texts of the same id stay; of rows that repeat both, one
    stays where the text has shingles. Texts without shingles all stay. Columns are those of docs; an empty table gives no rows."""
    known = _labelled(docs, n_words, percent).where("comp IS NOT NULL")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    groups = stored(known.groupBy("comp").agg(F.min(row).alias("kept"), F.count("*").alias("rows")).where("rows > 1").select("comp", "kept"))
    members = matched(known, groups, "comp").where("kept IS NOT NULL").select(row.alias("row"), "kept")
    gone = stored(members.where("row <> kept").select("row.doc_id", "row.mark").distinct())
    again = stored(members.where("row = kept").groupBy("row").count().where("count > 1").select("row.doc_id", "row.mark"))
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = lambda some: docs["doc_id"].cast("long").eqNullSafe(some["doc_id"]) & (mark == some["mark"])
    single = docs.join(gone, same(gone), "left_anti").join(again, same(again), "left_anti")
    return single.unionByName(docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def _labelled(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """doc_id, mark, n, node, comp of each row of docs: rows of linked texts have the same comp, those without shingles none."""
    profile = stored(_profile(docs, n_words, counters(docs.count())))
    rare = _rare(profile)
    rows = profile.where("n > 0")
    parts = max(PARTS, -(-rows.count() // PART_ROWS))
    # equal groups have met in different tasks: a row is kept once
    groups = stored(_groups(_postings(docs, rare, n_words, percent, parts), percent).repartition("group", "part").dropDuplicates(["group", "part", "node"]))
    # copies of a text are one before they meet (by an inner join, as for the sets)
    signs = stored(rows.select("node", "n", "bits").dropDuplicates(["node"]).join(groups.select("node").distinct(), "node"))
    cells = stored(_cells(groups, percent))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # first a spanning forest of the candidates
    first = stored(_traversed(cells.withColumn("comp", F.col("node")).join(signs, "node"), percent, forest=True))
    pairs = stored(first.where("cell IS NULL").select("a", "b").distinct())
    sets = stored(_sets(docs, rows, ends(pairs), n_words))
    links = stored(_linked(pairs, sets, percent))
    # then all that is left between components, in the cells where something was left out
    labels = components(links).withColumnRenamed("label", "comp")
    rest = cells.join(first.where("cell IS NOT NULL").select("cell").distinct(), "cell").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    cell = Window.partitionBy("cell")
    rest = rest.withColumns({"low": F.min("comp").over(cell), "high": F.max("comp").over(cell)}).where("low <> high").drop("low", "high")
    left = stored(_traversed(rest.join(signs, "node"), percent).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    lacking = ends(left).join(sets, "node", "left_anti")
    more = _linked(left, sets.unionByName(stored(_sets(docs, rows, lacking, n_words))), percent)
    links = stored(links.unionByName(more))
    for done in (groups, signs, cells, first, pairs, sets, left):
        dropped(done)
    final = components(links)

    found = matched(rows.select("doc_id", "mark", "n", "node"), final.withColumnRenamed("label", "comp"), "node").withColumn("comp", F.coalesce("comp", "node"))
    known = stored(found.unionByName(profile.where("n = 0").select("doc_id", "mark", "n", "node", F.lit(None).cast("long").alias("comp"))))
    dropped(profile)
    return known


def _cells(groups: DataFrame, percent: int) -> DataFrame:
    """cell, side, node: what trees are built of. A group of up to BLOCK rows is a cell (side -1). A larger one is cut in classes of
    sizes and these in blocks: each block is a cell, and so are two blocks (sides 0 and 1) of one class or of neighbouring ones."""
    # groups of frequent shingles are named by them: of those with equal members (by 128 bits) one is enough
    weight = F.ceil(F.greatest(F.lit(1), F.least(F.col("n"), F.lit(MOST_BITS)) / ROW_SHINGLES))
    marks = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(2)]
    loads = groups.groupBy("group").agg(F.sum(weight).alias("load"), F.count("*").alias("count"), *marks).where("count > 1")
    loads = stored(loads.groupBy("load", "count", "s0", "s1").agg(F.min("group").alias("group")).select("group", "load"))
    zero = F.lit(0)
    cells = groups.join(loads.where(F.col("load") <= BLOCK).select("group"), "group").select(F.col("group").alias("cell"), F.lit(-1).alias("side"), "node")
    large = loads.where(F.col("load") > BLOCK).select("group")
    if large.isEmpty():
        return cells
    klass = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.01 * 100 / percent))).cast("int")
    large = stored(groups.join(large, "group").withColumn("klass", klass))
    loads = stored(large.groupBy("group", "klass").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("blocks")))
    large = large.join(loads, ["group", "klass"]).join(loads.select("group", (F.col("klass") - 1).alias("klass"), F.col("blocks").alias("above")), ["group", "klass"], "left").join(loads.select("group", (F.col("klass") + 1).alias("klass"), F.col("blocks").alias("below")), ["group", "klass"], "left")
    large = large.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    mine, other = F.col("block"), F.col("other")

    def spread(of: str, i, j, k, side) -> DataFrame:
        """The cells in which a row's block meets each block of a class; none where there is no such class."""
        met = large.where(F.col(of).isNotNull()).select("*", F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias("other")).where((mine != other) | F.lit(of != "blocks"))
        return met.select(F.xxhash64("group", k, i, j, F.lit(of == "blocks")).alias("cell"), side.cast("int").alias("side"), "node")

    cells = cells.unionByName(large.select(F.xxhash64("group", "klass", "block").alias("cell"), F.lit(-1).alias("side"), "node"))
    cells = cells.unionByName(spread("blocks", F.least(mine, other), F.greatest(mine, other), F.col("klass"), mine > other))
    return cells.unionByName(spread("above", mine, other, F.col("klass"), zero)).unionByName(spread("below", other, mine, F.col("klass") - 1, F.lit(1)))


def _traversed(cells: DataFrame, percent: int, forest: bool = False) -> DataFrame:
    """a, b, cell: the candidate pairs of all cells, cell null; with forest a spanning forest of those that one traversal finds, and
    rows with just a cell, for each from which a pair was left out. A task takes its cells in order, as many at once as make
    CHUNK rows or 8 MB of signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, weight = [], 0
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())])

        def out(columns: list, bits: list) -> Iterator[pa.RecordBatch]:
            if not bits:
                return
            a, b, cell, share = tree_pairs(*columns, bits, percent)
            a, b, cut = spanning(a, b, cell, share) if forest else (*np.unique(np.stack([a, b]), axis=1), cell[:0])
            for at in range(0, len(a), 10_000):
                part = a[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(b[at : at + 10_000]), pa.nulls(len(part), pa.int64())], schema=schema)
            if len(cut):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.int64()), pa.array(cut)], schema=schema)

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                offsets, flat = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
                waiting.append(([batch.column(k).to_numpy() for k in range(5)], [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:])]))
                weight += max(batch.num_rows, (offsets[-1] - offsets[0]) * 8 * CHUNK >> 23)
                last = waiting[-1][0][0]
                if weight >= CHUNK and last[0] != last[-1]:
                    columns, bits = [np.concatenate(c) for c in zip(*(w[0] for w in waiting))], [b for w in waiting for b in w[1]]
                    end = int(np.flatnonzero(columns[0] != last[-1])[-1]) + 1
                    yield from out([c[:end] for c in columns], bits[:end])
                    waiting, weight = [([c[end:] for c in columns], bits[end:])], 0
        if waiting:
            yield from out([np.concatenate(c) for c in zip(*(w[0] for w in waiting))], [b for w in waiting for b in w[1]])

    ordered = cells.select("cell", "side", "node", F.col("n").cast("long").alias("n"), "comp", "bits").repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(run, "a long, b long, cell long")


def brute_force(texts: list[tuple], n_words: int = WORDS, percent: int = PERCENT) -> dict:
    """doc_id to (n_shingles, component_id) by comparing all pairs, for small fixtures."""
    import re

    sets = {}
    for k, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(words)} if 0 < len(words) < n_words else {tuple(words[i : i + n_words]) for i in range(len(words) - n_words + 1)}
    top = {k: k for k in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}
