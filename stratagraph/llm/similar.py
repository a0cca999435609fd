"""The most similar vectors for every vector: probed lists, scanned block by block of rotated columns.

An inverted index over unit vectors: centroids fitted on a bounded sample, every row in the list of its nearest
centroid, every row searched in its `nprobe` nearest lists. Lists that would be too long get centroids of their own, fitted
where their sampled rows are, so that the lists stay short however many rows there are and wherever they lie.
Within a list candidates are abandoned early: vectors are rotated by one random orthogonal matrix, so that any few columns
estimate the whole distance, and after each block of columns a hypothesis test drops the candidates whose partial distance
is too great for the distance that would count, which shrinks to that of the k-th best so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.runtime import bounded_broadcast, cut

#: Most centroids of a space at the first level and sampled rows for each: they are fitted on at most MAX_LISTS * PER_LIST rows.
MAX_LISTS, PER_LIST = 4096, 40
#: Most centroids of a call at the second level (51 MB at 64 columns), and of one list of the first level.
MAX_LEAVES, MAX_SPLIT = 200_000, 1024
#: Spaces that one call may have; each costs a sample and centroids on the driver.
MAX_SPACES = 256
#: Rows of a list that one task scans, and times as many queries. Longer lists get centroids of their own; what these can't
#: part is split in parts, and its queries in blocks that are sent to each part.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4
#: Rows and queries that one task of the brute-force search holds.
BRUTE_ROWS = 20_000
#: Exact copies of a vector from which the group is searched once, by one representative.
HEAVY = 64
#: Groups of copies (of about 500 bytes each) that are broadcast; more of them are joined by a shuffle.
BROADCAST_GROUPS = 50_000
#: Columns added between two tests, and how many standard deviations a candidate must be too far to be dropped.
COLUMNS, EPSILON = 16, 3.0
#: Rows that are scanned at once, first and then: after each the distance that would count may have shrunk.
FIRST_ROWS, SCAN_ROWS = 256, 2048
#: Megabytes of rows and queries that a task of the search gets: as few as that up to MANY_TASKS, and then up to as many.
TASK_MB, MANY_TASKS, MOST_MB = 8, 20_000, 128


def usable(vector: Column, dim: int) -> Column:
    """Vectors of exactly dim finite values, not all zero."""
    return F.coalesce(
        (F.size(vector) == dim)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def current_vectors(rows: DataFrame, id_col: str, space: Column, vector: str, version: str, dim: int) -> DataFrame:
    """space, id, vector of the current row of each (space, id): the greatest version, null first, ties by the vector's hash.

    A current row whose vector is unusable is left out, whatever earlier rows have. Rows with a null id or space don't
    count. Extra columns are ignored.
    """
    v = F.when(usable(F.col(vector), dim), F.col(vector))
    kept = rows.select(space.alias("space"), F.col(id_col).alias("id"), v.alias("vector"), F.col(version).alias("version")).where("space is not null and id is not null")
    newest = kept.groupBy("space", "id").agg(F.max_by("vector", F.struct("version", F.xxhash64("vector"))).alias("vector"))
    return newest.where("vector is not null")


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _units(dim: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim).astype(np.float64)
        for b in batches:
            if b.num_rows:
                x = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x /= np.abs(x).max(axis=1, keepdims=True)  # neither huge nor tiny values overflow when squared
                x = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn).astype(np.float32)
                data = pa.py_buffer(np.ascontiguousarray(x))
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 4), len(x), [None, data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("space"), b.column("id"), flat], ["space", "id", "vec"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced sample rows; a centroid without rows stays where it was."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], np.diff(near[order]) != 0)))
        c[near[order][at]] = np.add.reduceat(x[order], at)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Index:
    """The lists of one space: centroids, centroids within the lists that were split, and in how many parts each leaf is."""

    def __init__(self, number: int, centroids: np.ndarray, split: dict[int, np.ndarray] | None = None) -> None:
        self.number, self.centroids, self.split = number, centroids, split or {}
        counts = np.ones(len(centroids), np.int64)
        for cell, c in self.split.items():
            counts[cell] = len(c)
        self.first = np.cumsum(counts) - counts
        self.parts = self.blocks = np.ones(int(counts.sum()), np.int64)

    def size_up(self, sample: np.ndarray, scale: float, nprobe: int) -> None:
        """Sets parts of rows and blocks of queries of each leaf, from how many sampled rows lie in it and how many probe it."""
        held, asked = np.zeros(len(self.parts)), np.zeros(len(self.parts))
        for lo in range(0, len(sample), 4096):
            row, leaf, own = self.route(sample[lo : lo + 4096], nprobe)
            held += np.bincount(leaf[own], minlength=len(held))
            asked += np.bincount(leaf, minlength=len(held))
        self.parts = np.maximum(1, np.ceil(held * scale / BLOCK_ROWS)).astype(np.int64)
        self.blocks = np.maximum(1, np.ceil(asked * scale / (BLOCK_ROWS * BLOCK_QUERIES))).astype(np.int64)

    def route(self, x: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, leaf, own: up to nprobe leaves of each row of x, the nearest of which is its own."""
        near = x @ self.centroids.T
        p = min(nprobe, near.shape[1])
        cells = np.argpartition(-near, p - 1, axis=1)[:, :p] if p < near.shape[1] else np.tile(np.arange(p), (len(x), 1))
        row, cell = np.repeat(np.arange(len(x)), p), cells.ravel()
        leaf, score = self.first[cell], near[row, cell]
        if self.split:
            wide = np.isin(cell, list(self.split))
            rows, leaves, scores = [row[~wide]], [leaf[~wide]], [score[~wide]]
            for c in np.unique(cell[wide]):
                some = row[cell == c]
                inner = x[some] @ self.split[c].T
                q = min(nprobe, inner.shape[1])
                best = np.argpartition(-inner, q - 1, axis=1)[:, :q]
                rows.append(np.repeat(some, q)), leaves.append(self.first[c] + best.ravel()), scores.append(np.take_along_axis(inner, best, 1).ravel())
            row, leaf, score = np.concatenate(rows), np.concatenate(leaves), np.concatenate(scores)
        order = np.lexsort((leaf, -score, row))
        row, leaf = row[order], leaf[order]
        first = np.concatenate(([True], row[1:] != row[:-1]))
        rank = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
        return row[rank < nprobe], leaf[rank < nprobe], first[rank < nprobe]


def _spread(index, dim: int, nprobe: int):  # noqa: ANN001, ANN202
    """Every row to the leaf it belongs to (role 0) and, as a query, to the other leaves it probes (role 1).

    In a leaf of several parts a row lies in one part, once for each block of queries; it is in one block of queries, once for
    each other part. A row of role 0 asks its own part, in the block that is its own (role 0), and in others only answers (role 2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = index.value
        for b in batches:
            spaces, ids = np.array(b.column("space").to_pylist(), object), b.column("id")
            for space in dict.fromkeys(spaces):
                rows = np.flatnonzero(spaces == space)
                entry = of[space]
                for lo in range(0, len(rows), 2048):
                    some = rows[lo : lo + 2048]
                    vec = b.column("vec").take(pa.array(some))
                    row, leaf, own = entry.route(_matrix(vec, dim), nprobe)
                    parts, blocks = entry.parts[leaf], entry.blocks[leaf]
                    home, block = (some[row] + lo) % parts, (some[row] // 7 + lo) % blocks
                    # A query goes to every part (but its own one), a row to every block of its part.
                    n = np.where(own, parts + blocks - 1, parts)
                    at = np.repeat(np.arange(len(row)), n)
                    i = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    asks = i < parts[at]
                    part = np.where(asks, i, home[at])
                    other = i - parts[at]
                    qb = np.where(asks, block[at], other + (other >= block[at]))
                    role = np.where(own[at] & (part == home[at]), np.where(asks, 0, 2), 1).astype(np.int8)
                    at = row[at], leaf[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), entry.number, np.int32)), pa.array(at[1].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(qb.astype(np.int32)), pa.array(role), ids.take(pa.array(some[at[0]])), vec.take(pa.array(at[0]))],
                        ["sp", "list", "part", "block", "role", "id", "vec"],
                    )

    return run


def scan(q: np.ndarray, x: np.ndarray, limit: float | np.ndarray, back: float | np.ndarray = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of all pairs within the query's `limit` or the row's `back`, by the adaptive scan over blocks of columns.

    The first block is a matrix product over all pairs; later ones only touch the pairs that passed all tests. After m of
    D columns a pair is dropped if its partial distance exceeds limit * m / D * (1 + EPSILON / sqrt(m))^2.
    """
    dim = q.shape[1]
    limit, back = np.broadcast_to(np.float32(limit), len(q)), np.broadcast_to(np.float32(back), len(x))
    m = min(COLUMNS, dim)
    part = (q[:, :m] ** 2).sum(1)[:, None] + (x[:, :m] ** 2).sum(1)[None, :] - 2 * (q[:, :m] @ x[:, :m].T)
    part -= (m / dim * (1 + EPSILON / np.sqrt(m)) ** 2 if m < dim else 1) * np.maximum(limit[:, None], back[None, :])
    i, j = np.nonzero(part <= 1e-5)
    most = np.maximum(limit[i], back[j])
    d = np.zeros(len(i), np.float32)
    done = 0
    while len(i):
        to = min(done + COLUMNS, dim)
        diff = q[i, done:to] - x[j, done:to]  # from the start, so that close pairs lose nothing to rounding
        d = d + np.einsum("ij,ij->i", diff, diff)
        done = to
        keep = d <= (most * ((done / dim) * (1 + EPSILON / np.sqrt(done)) ** 2) if done < dim else most + 1e-6)
        i, j, d, most = i[keep], j[keep], d[keep], most[keep]
        if done == dim:
            break
    return i, j, d


def _best(src: np.ndarray, dst: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest dst of each src; ties by dst."""
    order = np.lexsort((dst, np.round(d, 9), src))
    s = src[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.array([], int)
    rank = np.arange(len(s)) - np.repeat(first, np.diff([*first, len(s)]))
    return order[rank < k]


class Nearest:
    """The k nearest found so far of each vector of a group, and the distance from which others count."""

    def __init__(self, rank: np.ndarray, k: int, limit: float) -> None:
        self.rank, self.k, self.most = rank, k, limit
        self.limit = np.full(len(rank), limit, np.float32)
        self.src, self.dst, self.d = np.array([], np.int64), np.array([], np.int64), np.array([], np.float32)

    def add(self, src: np.ndarray, dst: np.ndarray, d: np.ndarray) -> None:
        """Adds pairs; of each vector in src the k best stay."""
        if not len(src):
            return
        touched = np.zeros(len(self.rank), bool)
        touched[src] = True
        old = touched[self.src]
        src, dst, d = np.concatenate((self.src[old], src)), np.concatenate((self.dst[old], dst)), np.concatenate((self.d[old], d))
        best = _best(src, self.rank[dst], d, self.k)
        src, dst, d = src[best], dst[best], d[best]
        # _best() returns them sorted by vector and distance: a vector with k of them has its k-th last.
        n = np.bincount(src, minlength=len(self.rank))
        last = np.flatnonzero(np.concatenate((src[1:] != src[:-1], [True])))
        full = last[n[src[last]] >= self.k]
        self.limit[src[full]] = np.minimum(self.limit[src[full]], d[full])
        self.src, self.dst, self.d = np.concatenate((self.src[~old], src)), np.concatenate((self.dst[~old], dst)), np.concatenate((self.d[~old], d))


def _search(dim: int, k: int, limit: float):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        v, ids = _matrix(table.column("vec"), dim), np.array(table.column("id").to_pylist(), object)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        rows, asks = np.flatnonzero(role != 1), np.flatnonzero(role != 2)
        found = Nearest(rank, k, limit)
        # A query from another list may be near to a row that doesn't probe that list: it counts for both.
        back = np.where(role[asks] == 1, 1, 0)
        steps = [0, *range(FIRST_ROWS, len(rows), SCAN_ROWS), len(rows)] if len(asks) else [0]
        for lo, hi in zip(steps, steps[1:], strict=False):
            some = rows[lo:hi]
            x = v[some]
            for at in range(0, len(asks), 1024):
                q = asks[at : at + 1024]
                away = back[at : at + 1024]
                i, j, d = scan(v[q], x, found.limit[q], found.limit[some] if away.any() else 0.0)
                away, i, j = away[i] == 1, q[i], some[j]
                other = i != j
                found.add(i[other], j[other], d[other])
                other &= away
                found.add(j[other], i[other], d[other])
        src, dst, dist = found.src, found.dst, found.d
        sp = np.full(len(src), table.column("sp")[0].as_py(), np.int32)
        return pa.table({"sp": sp, "a": pa.array(ids[src], pa.string()), "b": pa.array(ids[dst], pa.string()), "cosine": 1 - dist.astype(np.float64) / 2})

    return run


def _inner(index, dim: int, wanted):  # noqa: ANN001, ANN202
    """sp, cell, vec of the rows (space, vec, draw) drawn for the centroids within lists: wanted[space][cell] is the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shares = index.value, wanted.value
        for b in batches:
            spaces, draw = np.array(b.column("space").to_pylist(), object), b.column("draw").to_numpy()
            for space in dict.fromkeys(spaces):
                if space not in shares:
                    continue
                rows = np.flatnonzero(spaces == space)
                vec = b.column("vec").take(pa.array(rows))
                cell = np.concatenate([(x @ of[space].centroids.T).argmax(1) for x in np.array_split(_matrix(vec, dim), -(-len(rows) // 2048))])
                share = np.zeros(len(of[space].centroids))
                share[list(shares[space])] = list(shares[space].values())
                hit = np.flatnonzero(draw[rows] < share[cell])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), of[space].number, np.int32)), pa.array(cell[hit].astype(np.int32)), vec.take(pa.array(hit))], ["sp", "cell", "vec"])

    return run


def _fit(dim: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(sorted(set(table.column("vec").to_pylist()))), np.float32).reshape(-1, dim)
        c = fit_centroids(x, int(min(MAX_SPLIT, max(1, table.num_rows // PER_LIST), len(x))))
        return pa.table({"sp": table.column("sp")[: len(c)], "cell": table.column("cell")[: len(c)], "vec": pa.array([r.tobytes() for r in c], pa.binary())})

    return run


def build_index(searched: DataFrame, sizes: dict[str, int], dim: int, nprobe: int) -> dict[str, Index]:
    """The index of each space, from a bounded sample of the rows (space, id, vec); sizes: rows of each space.

    The first level has half the square root of the rows as centroids, so that lists and centroids grow alike, up to MAX_LISTS.
    Lists of more than BLOCK_ROWS rows, by the sample, are split by centroids of half so many rows each, or more where that
    would be over MAX_LEAVES centroids in all (from 800 million rows on).
    """
    spark = searched.sparkSession
    lists = {s: int(min(MAX_LISTS, max(1, 0.5 * n**0.5))) for s, n in sizes.items()}
    share = F.coalesce(*[F.when(F.col("space") == s, F.lit(min(1.0, lists[s] * PER_LIST / n))) for s, n in sizes.items()])
    draw = lambda *salt: F.pmod(F.xxhash64("space", "id", *salt), F.lit(1 << 30)) / float(1 << 30)
    sample: dict[str, list[bytes]] = {s: [] for s in sizes}
    for r in searched.where(draw() < share).select("space", "vec").toLocalIterator():
        sample[r["space"]].append(bytes(r["vec"]))
    index, rows, wide = {}, {}, {}
    leaf = max(BLOCK_ROWS / 2, sum(sizes.values()) / MAX_LEAVES)
    for number, s in enumerate(sorted(sizes)):
        # Sorted, as the order of arrival varies; the centroids are fitted on distinct rows, as copies would be centroids twice.
        rows[s], x = (np.frombuffer(b"".join(sorted(v)), np.float32).reshape(-1, dim) if v else rotation(dim)[:1] for v in (sample[s], set(sample[s])))
        index[s] = Index(number, fit_centroids(x, min(lists[s], len(x))))
        cell = np.concatenate([(rows[s][i : i + 4096] @ index[s].centroids.T).argmax(1) for i in range(0, len(rows[s]), 4096)])
        held = np.bincount(cell, minlength=len(index[s].centroids)) * (sizes[s] / len(rows[s]))
        if (held > BLOCK_ROWS).any():
            wide[s] = {int(c): min(1.0, min(MAX_SPLIT, -(-held[c] // leaf)) * PER_LIST / held[c]) for c in np.flatnonzero(held > BLOCK_ROWS)}
    if wide:
        first, shares = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(wide)
        drawn = searched.where(F.col("space").isin(list(wide))).select("space", "vec", draw(F.lit(1)).alias("draw")).mapInArrow(_inner(first, dim, shares), "sp int, cell int, vec binary")
        fitted: dict[int, dict[int, list[bytes]]] = {}
        for r in drawn.groupBy("sp", "cell").applyInArrow(_fit(dim), "sp int, cell int, vec binary").toLocalIterator():
            fitted.setdefault(r["sp"], {}).setdefault(r["cell"], []).append(bytes(r["vec"]))
        for entry in list(index.values()):
            inner = {c: np.frombuffer(b"".join(v), np.float32).reshape(-1, dim) for c, v in fitted.get(entry.number, {}).items()}
            if inner:
                index[next(s for s in index if index[s].number == entry.number)] = Index(entry.number, entry.centroids, inner)
    for s, entry in index.items():
        entry.size_up(rows[s], sizes[s] / len(rows[s]), nprobe)
    return index


def neighbours(vectors: DataFrame, k: int = 5, min_cosine: float = 0.85, dim: int = 64, nprobe: int = 3) -> DataFrame:
    """space, a, b, cosine, rank: for each vector a its at most k most similar others b of its space, from min_cosine up.

    vectors: space STRING, id STRING (unique within its space), vector of exactly `dim` usable values (current_vectors()
    sees to both). Ties go to the smaller id. Vectors of which there are more than HEAVY exact copies are searched by one
    representative: their members' nearest are the k smallest other ids of the group, and to any other vector the group
    offers its k smallest ids. An empty input gives an empty result.
    """
    spark = vectors.sparkSession
    base = cut(vectors.mapInArrow(_units(dim), "space string, id string, vec binary"))
    sizes = {r["space"]: r["n"] for r in base.groupBy("space").agg(F.count("*").alias("n")).limit(MAX_SPACES + 1).collect()}
    if len(sizes) > MAX_SPACES:
        raise ValueError(f"more than {MAX_SPACES} spaces in one call")
    out_schema = "space string, a string, b string, cosine double, rank int"
    if not sizes:
        return spark.createDataFrame([], out_schema)
    copies = cut(base.groupBy("space", F.xxhash64("vec").alias("vh")).agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("space", "vh"))
    groups, searched = None, base
    if copies.limit(1).count():
        hot = bounded_broadcast(copies)
        hashed = base.withColumn("vh", F.xxhash64("vec"))
        members = hashed.join(hot, ["space", "vh"])
        # The hash only finds the groups; a group is a vector itself. k + 1 smallest ids, by partial lists per salt first.
        small = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
        salted = members.groupBy("space", "vec", F.pmod(F.xxhash64("id"), F.lit(4096)).alias("salt")).agg(small.alias("ids"))
        groups = cut(salted.groupBy("space", "vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")))
        searched = cut(hashed.join(hot, ["space", "vh"], "left_anti").select("space", "id", "vec").unionByName(groups.select("space", F.col("ids")[0].alias("id"), "vec")))
        sizes = {r["space"]: r["n"] for r in searched.groupBy("space").agg(F.count("*").alias("n")).collect()}

    index = build_index(searched, sizes, dim, nprobe)
    shared = spark.sparkContext.broadcast(index)
    spread = searched.mapInArrow(_spread(shared, dim, nprobe), "sp int, list int, part int, block int, role byte, id string, vec binary")
    # As many tasks as the rows need, fixed in advance: they stay of one size however many rows there are.
    megabytes = sum(sizes.values()) * nprobe * (4 * dim + 48) / (1 << 20)
    tasks = max(spark.sparkContext.defaultParallelism, min(megabytes // TASK_MB + 1, MANY_TASKS), megabytes // MOST_MB)
    place = ["sp", "list", "part", "block"]
    pairs = spread.repartition(int(tasks), *place).groupBy(*place).applyInArrow(_search(dim, k, 2 - 2 * min_cosine), "sp int, a string, b string, cosine double")
    pairs = pairs.withColumn("space", F.element_at(F.array(*map(F.lit, sorted(sizes))), F.col("sp") + 1)).select("space", "a", "b", "cosine")
    if groups is not None:
        # Joins on a group meet all its members at once: they are broadcast, or else salted by the member.
        salts = 1 if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else 64
        few = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        few = F.broadcast(few) if salts == 1 else few
        salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
        offered = few.select("space", F.col("ids")[0].alias("b"), F.slice("ids", 1, k).alias("offer"), "salt")
        reps = few.where("salt = 0").select("space", F.col("ids")[0].alias("a"))
        pairs = pairs.join(reps, ["space", "a"], "left_anti").withColumn("salt", salt("a")).join(offered, ["space", "b", "salt"], "left")
        pairs = pairs.select("space", "a", F.explode(F.coalesce("offer", F.array("b"))).alias("b"), "cosine")
        inside = members.withColumn("salt", salt("id")).join(few.select("space", "vec", "ids", "salt"), ["space", "vec", "salt"]).select("space", F.col("id").alias("a"), F.explode(F.slice(F.array_except("ids", F.array("id")), 1, k)).alias("b"), F.lit(1.0).alias("cosine"))
        pairs = pairs.unionByName(inside)
    best = W.partitionBy("space", "a").orderBy(F.round("cosine", 9).desc(), "b")
    once = pairs.groupBy("space", "a", "b").agg(F.max("cosine").alias("cosine"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def similar_pairs(found: DataFrame) -> DataFrame:
    """space, id_a, id_b: the pairs of neighbours(), each once with the smaller id first."""
    return found.select("space", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = 5, min_cosine: float = 0.85, dim: int = 64) -> DataFrame:
    """The exact counterpart of neighbours() for a set of queries, in blocks of queries against all rows: space, a, b, cosine, rank."""
    parts, blocks = (max(1, -(-df.count() // BRUTE_ROWS)) for df in (vectors, queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    base = vectors.mapInArrow(_units(dim), "space string, id string, vec binary").withColumn("role", F.lit(0).cast("byte")).withColumn("part", own(parts)).withColumn("block", every(blocks))
    asked = queries.mapInArrow(_units(dim), "space string, id string, vec binary").withColumn("role", F.lit(1).cast("byte")).withColumn("part", every(parts)).withColumn("block", own(blocks))

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        v, ids = _matrix(table.column("vec"), dim), np.array(table.column("id").to_pylist(), object)
        rows, asks = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        a, b, c = [], [], []
        for lo in range(0, len(asks) if len(rows) else 0, 256):
            s = v[asks[lo : lo + 256]] @ v[rows].T
            i, j = np.nonzero(s >= min_cosine)
            i, j, s = asks[i + lo], rows[j], s[i, j]
            other = ids[i] != ids[j]
            i, j, s = i[other], j[other], s[other]
            best = _best(i, j, -s, k)
            a.extend(ids[i[best]]), b.extend(ids[j[best]]), c.extend(s[best].astype(float))
        return pa.table({"space": pa.array([table.column("space")[0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "cosine": pa.array(c, pa.float64())})

    both = base.unionByName(asked)
    pairs = both.groupBy("space", "part", "block").applyInArrow(run, "space string, a string, b string, cosine double")
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("space", "a").orderBy(F.round("cosine", 9).desc(), "b"))).where(F.col("rank") <= k)
