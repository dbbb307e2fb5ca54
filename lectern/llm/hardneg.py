"""Hard-negative mining by inner product over an STR-packed R-tree (operator 11).

Sort-tile-recursive packing cuts the vectors into slabs by one coordinate, each slab by the next one, and so on, until a
tile fits a page; a page is packed in the same way into leaves, and every box is the least one around what lies under it.
For a query q, a box bounds each term q[i] * x[i] by the interval of its side, so the sum of the intervals bounds all inner
products inside. A best-first queue opens the box with the largest upper bound next and drops boxes that lie outside of
the wanted score window or strictly below the k-th score found so far; equal scores are kept, as ids break ties.

The boxes of all pages form a directory of bounded size, which every task has; pages grow with the table, their number
doesn't. A query first asks its own page, then, with the k-th score found there, those other pages that the directory
can't rule out. Queries meet a page in a shuffle on (page, share of the queries), and a task holds one page at a time. High
dimensions leave little to prune: exact answers then cost as many products as a scan in blocks would.

Equal vectors of one label are one entry with its least ids, so a vector that a third of all rows have costs one place.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, map_batches, shuffles_removed

K = 5
ANCHOR_STEP, RELABEL_STEP, LABELS = 100, 7, 10
SCALE = 256
#: A negative's score is at least this share, in hundredths, of its positive's.
LEAST_SHARE = 80
#: Entries of a page at least, and pages of the directory at most; a large table has larger pages.
PAGE, MOST_PAGES = 1024, 4096
DIRECTORY_BYTES = 64 << 20
LEAF, FANOUT = 64, 16
#: Bounds between slabs come from the vectors with the least hashed ids: so many, and so many bytes of them, at most.
SAMPLE, SAMPLE_BYTES = 1 << 14, 16 << 20
#: Scores of this size and more could not be scaled by 100 in a long.
MOST_SCORE = 1 << 56
NO_SCORE = -(1 << 62)


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of every component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))


def relabelled(label: Column, vec_id: Column) -> Column:
    return F.when(vec_id % RELABEL_STEP == 0, (label.cast("long") + 1) % LABELS).otherwise(label.cast("long"))


def _finite(embedding: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


# --- packing -----------------------------------------------------------------------------------------------------


class Slabs:
    """Sort-tile-recursive cuts: a coordinate and its bounds at each step, drawn from a sample, a number for each tile."""

    def __init__(self, sample: np.ndarray, tiles: int):
        self.axes = np.argsort(-sample.std(axis=0), kind="stable").tolist() if len(sample) else []
        self.tiles = 0
        self.root = self._cut(sample, tiles, 0)

    def _cut(self, rows: np.ndarray, tiles: int, step: int):
        if tiles <= 1 or step >= len(self.axes) or len(rows) < 2:
            self.tiles += 1
            return self.tiles - 1
        slabs = max(2, int(np.ceil(tiles ** (1 / (len(self.axes) - step)) - 1e-9)))
        axis = self.axes[step]
        own = np.sort(rows[:, axis])
        bounds = np.unique(own[[len(own) * i // slabs for i in range(1, slabs)]])
        which = np.searchsorted(bounds, rows[:, axis], side="right")
        return axis, bounds, [self._cut(rows[which == i], -(-tiles // slabs), step + 1) for i in range(len(bounds) + 1)]

    def tile_of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        stack = [(self.root, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                out[at] = node
                continue
            axis, bounds, below = node
            which = np.searchsorted(bounds, rows[at, axis], side="right")
            stack += [(child, at[which == i]) for i, child in enumerate(below)]
        return out


def packed_order(rows: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows' order in which every `leaf` consecutive ones are a leaf: halves by one coordinate after another, cut at whole leaves."""
    axes = np.argsort(-(rows.max(axis=0) - rows.min(axis=0)).astype(np.float64), kind="stable") if rows.size else np.zeros(0, np.int64)
    out, stack = [], [(np.arange(len(rows)), 0)]
    while stack:
        at, step = stack.pop()
        if len(at) <= leaf or not len(axes):
            out.append(at)
            continue
        at = at[np.argsort(rows[at, axes[step % len(axes)]], kind="stable")]
        half = (len(at) // leaf + 1) // 2 * leaf
        half = half if 0 < half < len(at) else leaf
        stack += [(at[half:], step + 1), (at[:half], step + 1)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Page:
    """A page's entries in packed order, and the boxes of its leaves and of the nodes above them."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray):
        self.rows, self.labels, self.ids = rows, labels, ids
        lo, hi = (f.reduceat(rows, np.arange(0, len(rows), LEAF), axis=0) for f in (np.minimum, np.maximum))
        self.boxes = [(lo, hi)]
        while len(lo) > 1:
            lo, hi = (f.reduceat(x, np.arange(0, len(x), FANOUT), axis=0) for f, x in ((np.minimum, lo), (np.maximum, hi)))
            self.boxes.append((lo, hi))


def intervals(up: np.ndarray, down: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) inner product of each query with any point of each box. up, down: the queries' positive and negative parts."""
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


class Best:
    """The first k (score, id) of each seek, higher scores first, then smaller ids, and the score that a candidate must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.need = k, floor.copy()
        self.score = np.full((len(floor), k), NO_SCORE, floor.dtype)
        self.id = np.full((len(floor), k), np.iinfo(np.int64).max)

    def add(self, seek: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        own = np.unique(seek)
        seek = np.concatenate([seek, np.repeat(own, self.k)])
        score = np.concatenate([score, self.score[own].ravel()])
        ids = np.concatenate([ids, self.id[own].ravel()])
        order = np.lexsort((ids, -score, seek))
        seek = seek[order]
        place = np.arange(len(seek)) - np.searchsorted(seek, seek)
        kept = order[place < self.k]
        self.score[own], self.id[own] = score[kept].reshape(-1, self.k), ids[kept].reshape(-1, self.k)
        self.need[own] = np.maximum(self.need[own], self.score[own, -1])


def seek(page: Page, queries: np.ndarray, labels: np.ndarray, same: bool, owner: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """For each seek the first k entries of its owner's label (same) or of others whose score is at most `high` and at least `floor`.

    Seeks are ranges of scores of a query, owner[i] its number. All arrays of scores have the type of `queries`: float64
    where sums are exact in it, else int64.
    """
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    best = Best(floor, k)
    top = len(page.boxes) - 1
    queue: list = [(0, 0, top, 0, np.arange(len(owner)), np.full(len(owner), np.inf))]
    count = 0
    while queue:
        _, _, level, node, seeks, upper = heapq.heappop(queue)
        seeks = seeks[upper >= best.need[seeks]]  # a box strictly below the k-th score holds nothing
        if not len(seeks):
            continue
        asked, at = np.unique(owner[seeks], return_inverse=True)
        if level == 0:
            part = slice(node * LEAF, (node + 1) * LEAF)
            score = queries[asked] @ page.rows[part].T
            fits = (labels[asked, None] == page.labels[part]) == same
            score, need = score[at], best.need[seeks]
            which, column = np.nonzero(fits[at] & (score >= need[:, None]) & (score <= high[seeks, None]))
            if len(which):
                best.add(seeks[which], score[which, column], page.ids[part][column])
            continue
        lo, hi = (x[node * FANOUT : (node + 1) * FANOUT] for x in page.boxes[level - 1])
        lower, upper = (x[at] for x in intervals(up[asked], down[asked], lo, hi))
        open_ = (upper >= best.need[seeks, None]) & (lower <= high[seeks, None])
        for child in np.flatnonzero(open_.any(axis=0)).tolist():
            own = open_[:, child]
            count += 1
            heapq.heappush(queue, (-float(upper[own, child].max()), count, level - 1, node * FANOUT + child, seeks[own], upper[own, child]))
    return best


# --- tasks -------------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have `width` numbers."""
    if not len(column):
        return np.zeros((0, width), kind)
    _, places, data = column.buffers()
    first, last = np.frombuffer(places, np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, kind, (last - first) // np.dtype(kind).itemsize, int(first)).reshape(len(column), width) if width else np.zeros((len(column), 0), kind)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _tiler(slabs: Slabs, kind: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _padded(batch.column("q"), width)
            vec = pa.array([r.tobytes() for r in rows.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("entry"), batch.column("label"), vec, pa.array(slabs.tile_of(rows))], names=["entry", "label", "vec", "tile"])

    return run


def _packer(kind: str, width: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        first = lambda name: group.column(name).chunk(0)
        rows = _matrix(first("vec"), kind, width)
        order = packed_order(rows)
        rows = rows[order]
        labels, ids = (np.asarray(first(name))[order].astype(np.int64) for name in ("label", "entry"))
        values = [x.tobytes() for x in (rows.min(axis=0).astype(np.int64), rows.max(axis=0).astype(np.int64), rows, labels, ids)]
        page = [group.column("page")[0].as_py()]
        return pa.table({"page": pa.array(page, pa.int64())} | {n: pa.array([v], pa.binary()) for n, v in zip(("lo", "hi", "rows", "labels", "ids"), values, strict=True)})

    return run


def _asker(directory, kind: str, width: int, exact: str):
    """Copies of each question for the pages that the directory can't rule out, but not for the one that was asked before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, lo, hi = directory.value
        lo, hi = lo.astype(exact), hi.astype(exact)
        at_once = max(1, (1 << 14) // max(1, len(pages)))
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                q = _matrix(batch.column("vec"), kind, width).astype(exact)
                lower, upper = intervals(np.maximum(q, 0), np.minimum(q, 0), lo, hi)
                wanted = np.zeros(lower.shape, bool)
                for i, (highs, floors) in enumerate(zip(batch.column("highs").to_pylist(), batch.column("floors").to_pylist(), strict=True)):
                    for high, floor in zip(highs, floors, strict=True):
                        wanted[i] |= (upper[i] >= floor) & (lower[i] <= high)
                wanted &= np.asarray(batch.column("page"))[:, None] != pages
                row, to = np.nonzero(wanted)
                names = [n for n in batch.schema.names if n != "page"]
                yield pa.RecordBatch.from_arrays([pa.array(pages[to]), *[batch.column(n).take(pa.array(row)) for n in names]], names=["page", *names])

    return run


def _answerer(kind: str, width: int, exact: str, same: bool, k: int):
    """Rows come sorted by page: the page, then the questions that it is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = None
        for batch in batches:
            marks = np.flatnonzero(np.asarray(batch.column("kind")) == 0).tolist()
            edges = sorted({0, *marks, *[m + 1 for m in marks], batch.num_rows})
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if a in marks:
                    rows, labels, ids = (part.column(n)[0].as_py() for n in ("rows", "labels", "ids"))
                    n = len(ids) // 8
                    page = Page(np.frombuffer(rows, kind).reshape(n, width).astype(exact), np.frombuffer(labels, np.int64), np.frombuffer(ids, np.int64))
                    continue
                highs = part.column("highs")
                owner = np.repeat(np.arange(len(part)), np.diff(highs.offsets.to_numpy()))
                high, floor = (part.column(n).flatten().to_numpy().astype(exact) for n in ("highs", "floors"))
                best = seek(page, _matrix(part.column("vec"), kind, width).astype(exact), np.asarray(part.column("label")), same, owner, high, floor, k)
                s, c = np.nonzero(best.score > NO_SCORE)
                if len(s):
                    own = np.asarray(part.column("entry"))[owner[s]]
                    named = highs.flatten().to_numpy()[s]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(named), pa.array(best.score[s, c].astype(np.int64)), pa.array(best.id[s, c])], names=["entry", "high", "score", "found"])

    return run


ANSWERS = "entry long, high long, score long, found long"


class _Index:
    """The packed pages of all entries and their directory."""

    def __init__(self, entries: DataFrame, n: int, width: int, most: float):
        self.spark, self.width = entries.sparkSession, width
        if most * most * max(width, 1) >= MOST_SCORE:
            raise ValueError(f"scores of embeddings with components up to {most / SCALE:g} have no exact value in a long")
        self.kind = next(t for t in ("int16", "int32", "int64") if most < np.iinfo(t).max)
        self.exact = "float64" if most * most * max(width, 1) < 1 << 53 else "int64"
        self.page_rows = max(PAGE, -(-n // max(1, min(MOST_PAGES, DIRECTORY_BYTES // max(1, 16 * width)))))
        few = entries.select("entry", "q").orderBy(F.xxhash64("entry"), "entry").limit(min(SAMPLE, max(1, SAMPLE_BYTES // max(1, 8 * width))))
        sample = [r.q for r in few.collect()]
        slabs = Slabs(np.array([x + [0] * (width - len(x)) for x in sample], np.int64).reshape(len(sample), width), -(-n // self.page_rows))
        tiled = cut(map_batches(entries.select("entry", "label", "q"), _tiler(slabs, self.kind, width), "entry long, label long, vec binary, tile long"), "tiled")
        # a tile may be larger than the sample says, as where many vectors share a coordinate; it is several pages then
        sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / (2 * self.page_rows)).cast("int").alias("parts"))
        page = F.col("tile") * (1 << 32) + F.pmod(F.xxhash64("entry"), F.col("parts"))
        self.placed = cut(tiled.join(F.broadcast(sizes), "tile").select("entry", "label", "vec", page.alias("page")), "placed")
        shape = "page long, lo binary, hi binary, rows binary, labels binary, ids binary"
        self.pages = cut(self.placed.groupBy("page").applyInArrow(_packer(self.kind, width), shape), "pages")
        drop(tiled)
        boxes = self.pages.select("page", "lo", "hi").collect()
        lo, hi = (np.array([np.frombuffer(bytes(r[x]), np.int64) for r in boxes], np.int64).reshape(len(boxes), width) for x in ("lo", "hi"))
        self.directory = self.spark.sparkContext.broadcast((np.array([r.page for r in boxes], np.int64), lo, hi))

    def _answers(self, questions: DataFrame, shares: int, same: bool, k: int) -> DataFrame:
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        pages = self.pages.select("page", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "rows", "labels", "ids")
        asked = questions.select("page", F.pmod(F.xxhash64("entry"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("kind"), "entry", "label", "vec", "highs", "floors")
        dealt = pages.unionByName(asked, allowMissingColumns=True).repartition(tasks, "page", "share").sortWithinPartitions("page", "share", "kind")
        return cut(map_batches(dealt, _answerer(self.kind, self.width, self.exact, same, k), ANSWERS), "answers")

    def search(self, queries: DataFrame, n: int, same: bool, k: int) -> DataFrame:
        """(entry, high, score, found): the first k entries in each score range of each query.

        queries: (entry, label, vec, page, highs, floors), a range for each element of highs and floors. `floors` are the
        least scores wanted. The first answers, from a query's own page, raise them for the rest.
        """
        shares = max(1, -(-n // max(4096, self.page_rows)))
        with shuffles_removed(self.spark):
            first = self._answers(queries, shares, same, k)
            reached = first.groupBy("entry", "high").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
            reached = reached.groupBy("entry").agg(F.map_from_entries(F.collect_list(F.struct("high", "least"))).alias("reached"))
            raised = F.transform(F.arrays_zip("highs", "floors"), lambda x: F.greatest(x["floors"], F.coalesce(F.try_element_at("reached", x["highs"]), x["floors"])))
            open_ = cut(queries.join(reached, "entry", "left").withColumn("floors", raised).drop("reached"), "raised")
            questions = map_batches(open_, _asker(self.directory, self.kind, self.width, self.exact), "page long, entry long, label long, vec binary, highs array<long>, floors array<long>")
            rest = self._answers(questions, shares, same, k)
        place = F.row_number().over(Window.partitionBy("entry", "high").orderBy(F.desc("score"), "found"))
        with shuffles_removed(self.spark):
            out = cut(first.unionAll(rest).withColumn("_r", place).filter(F.col("_r") <= k).drop("_r"), "found")
        drop(first, open_, rest)
        return out

    def drop(self) -> None:
        drop(self.placed, self.pages)
        self.directory.unpersist()


def _first_rows(found: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(entry, high, rows): the first k rows (score, id) of each range; an entry stands for the rows of its least ids."""
    each = found.join(entries.select(F.col("entry").alias("found"), "ids"), "found").select("entry", "high", "score", F.explode("ids").alias("id"))
    place = F.row_number().over(Window.partitionBy("entry", "high").orderBy(F.desc("score"), "id"))
    least = each.withColumn("_r", place).filter(F.col("_r") <= k)
    return least.groupBy("entry", "high").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "score", "id"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("rows"))


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, k: int = K, anchor_step: int = ANCHOR_STEP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first k positives, the first k negatives whose score is 80 to 100 hundredths of the positive's.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part; rows that repeat an id
    count once, with the least label, then the least vector. A shorter vector counts as filled up with zeros, an empty one
    scores 0 with all. Ties go by the smaller id. A positive with a negative score has no negatives, as no score fits. An
    anchor has fewer positives or negatives, or no rows, where there are no more; an empty table gives no rows.
    Components so large that a score might leave the range of a long are refused. Other columns are ignored.
    """
    spark = vectors.sparkSession
    known = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & _finite(F.col("embedding")))
    coded = known.select(F.col("vec_id").cast("long"), F.struct(relabelled(F.col("label"), F.col("vec_id")).alias("label"), quantised(F.col("embedding")).alias("q")).alias("own"))
    coded = cut(coded.groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.*"), "vectors")
    # Spark cuts each task's share to k + 1 rows a class before it shuffles
    place = F.row_number().over(Window.partitionBy("label", "q").orderBy("vec_id"))
    near = coded.withColumn("_r", place).filter(F.col("_r") <= k + 1)
    entries = near.groupBy("label", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    with shuffles_removed(spark):
        entries = cut(entries.select(F.col("ids")[0].alias("entry"), "label", "q", "ids"), "entries")
    largest = F.array_max(F.transform("q", lambda x: F.abs(x.cast("double"))))
    size = entries.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width"), F.coalesce(F.max(largest), F.lit(0.0)).alias("most")).first()
    if not size.n:
        drop(coded, entries)
        return spark.createDataFrame([], SCHEMA)
    index = _Index(entries, size.n, size.width, size.most)
    anchors = coded.filter(F.col("vec_id") % anchor_step == 0).join(entries.select("entry", "label", "q"), ["label", "q"])
    with shuffles_removed(spark):
        anchors = cut(anchors.select(F.col("vec_id").alias("anchor_id"), "entry"), "anchors")
        queries = cut(index.placed.join(anchors.select("entry").distinct(), "entry", "left_semi"), "queries")
    n = queries.count()
    whole = queries.withColumns({"highs": F.array(F.lit(-NO_SCORE)), "floors": F.array(F.lit(NO_SCORE + 1))})
    same = index.search(whole, n, True, k + 1)
    with shuffles_removed(spark):
        # one more than k, as the anchor itself may be among them
        positives = cut(_first_rows(same, entries, k + 1).select("entry", F.explode("rows").alias("row")).select("entry", F.col("row.id").alias("positive_id"), F.col("row.score").alias("positive_score")), "positives")
        ranges = positives.filter("positive_score >= 0").groupBy("entry").agg(F.collect_set("positive_score").alias("highs"))
        asks = queries.join(ranges, "entry").withColumn("floors", F.expr(f"transform(highs, s -> (s * {LEAST_SHARE} + 99) div 100)"))
        asks = cut(asks, "asks")
    other = index.search(asks, n, False, k)
    negatives = _first_rows(other, entries, k).withColumnRenamed("high", "positive_score")
    answers = positives.join(negatives, ["entry", "positive_score"], "left")
    # at most k + 1 positives with k negatives each
    answers = answers.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct((-F.col("positive_score")).alias("order"), "positive_id", "positive_score", "rows"))).alias("answers"))
    # the anchors of a vector that many rows have are split by Spark where they skew this join
    own = anchors.hint("merge").join(answers, "entry")
    first = F.slice(F.filter("answers", lambda a: a["positive_id"] != F.col("anchor_id")), 1, k)
    rows = own.select("anchor_id", F.explode(first).alias("p")).select("anchor_id", "p.positive_id", "p.positive_score", F.posexplode("p.rows").alias("place", "n"))
    out = rows.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
    with shuffles_removed(spark):
        result = cut(out, "negatives")
    drop(coded, entries, anchors, queries, same, positives, asks, other)
    index.drop()
    return result


ORACLE = f"""
with v as (
  select vec_id, case when vec_id % {RELABEL_STEP} = 0 then (label::bigint + 1) % {LABELS} else label::bigint end as label,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))), 0)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {ANCHOR_STEP} = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {K}),
n as (
  select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank,
         s.vec_id as negative_id, positive_score, s.score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not s.same and {LEAST_SHARE} * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
select * from n where rank <= {K}
"""
