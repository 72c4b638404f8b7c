"""Hard negatives by an inverted multi-index.

Vectors are cut in two halves, and each half has a codebook of its own. The nearest codewords of both halves name a vector's
cell. A row's half-score with an anchor is at most that of its codeword plus the anchor's length times the codeword's radius,
the largest distance of any of its rows; the sum over both halves bounds every score in a cell. For each anchor a heap walks
the two sorted lists of half bounds and yields cells in falling order of that sum. The search for positives stops when no
cell left can reach the last positive kept, the search for negatives when this holds for every window: both results are
certified, so the codebooks decide only how many cells are read.

The codebooks are fitted on a bounded sample. Every row is in the index, whose files lie in the shared folder: one record batch
for each piece of a cell, and a directory of pieces. Anchors are spread over tasks, which read pieces as their heaps ask.
"""

from __future__ import annotations

import heapq
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.batches import filesystem
from palisade.llm.registry import query
from palisade.storage import materialize, scratch_path

SAMPLE = 16384  # rows the codebooks are fitted on
CELL_ROWS = 256  # rows a cell should hold on average
CODEWORDS = 128  # codewords of a half at most
PIECE = 4096  # rows of a record batch of the index
ANCHORS = 64  # anchors of a task; up to GATHERED of them, where there are more than ANCHORS tasks of so many
GATHERED = 256  # see ANCHORS
WALKED = 64  # cells that an anchor's heap yields, about, before all that are left are looked at together
HELD = 256 << 20  # bytes of pieces that a worker keeps
DIRECTORY = "width int, cell int, path string, batch int, n_rows int, reach_left double, reach_right double"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(key: Column, label: Column, vector: Column) -> Column:
    """True for rows that take part: an id, a label, and a vector of finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(key.isNotNull() & label.isNotNull() & vector.isNotNull() & ~bad, F.lit(False))


def nearest(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row and the distance to it."""
    code = np.zeros(len(rows), np.int64)
    if len(words) > 1:
        code = np.argmin((words**2).sum(1) - 2 * (rows @ words.T), axis=1)
    return code, np.sqrt(((rows - words[code]) ** 2).sum(1))


def fit_codewords(rows: np.ndarray, count: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Means of ``count`` groups of rows at most (Lloyd's rounds from distinct rows)."""
    distinct = np.unique(rows, axis=0)
    words = distinct[np.random.default_rng(seed).permutation(len(distinct))[:count]].astype(np.float64)
    for _ in range(rounds):
        code, _ = nearest(rows, words)
        sizes = np.bincount(code, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, code, rows)
        words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], words)
    return words


class Codebooks:
    """Two codebooks for each width of vectors; a width that the sample lacks has one codeword a half."""

    def __init__(self, sample: list[list[int]], codewords: int) -> None:
        self.books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.codewords = codewords
        for width in sorted({len(v) for v in sample}):
            own = [v for v in sample if len(v) == width]
            rows = np.array(own, np.float64).reshape(len(own), width)
            self.books[width] = fit_codewords(rows[:, : width // 2], codewords), fit_codewords(rows[:, width // 2 :], codewords)

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self.books.get(width) or (np.zeros((1, width // 2)), np.zeros((1, width - width // 2)))

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each vector, and the distances of its halves from their codewords."""
        left, right = self.of(vectors.shape[1])
        cut = vectors.shape[1] // 2
        a, reach_a = nearest(vectors[:, :cut], left)
        b, reach_b = nearest(vectors[:, cut:], right)
        return a * self.codewords + b, reach_a, reach_b


def falling_cells(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """``(sum, i, j)`` over all pairs in falling order of ``left[i] + right[j]``: the multi-sequence walk.

    The heap holds the border of what was visited; a pair enters when its neighbours above and to the left have left.
    """
    by_left, by_right = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    high, wide = left[by_left].tolist(), right[by_right].tolist()
    rows, columns = by_left.tolist(), by_right.tolist()
    reached = [0] * len(rows)  # pairs of each row that have left the heap
    border = [(-(high[0] + wide[0]), 0, 0)]
    while border:
        bound, i, j = heapq.heappop(border)
        yield -bound, rows[i], columns[j]
        reached[i] = j + 1
        if i + 1 < len(rows) and reached[i + 1] == j:
            heapq.heappush(border, (-(high[i + 1] + wide[j]), i + 1, j))
        if j + 1 < len(columns) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(border, (-(high[i] + wide[j + 1]), i, j + 1))


class Cells:
    """The index as a task sees it: the directory, and pieces of cells read when asked for."""

    def __init__(self, directory: str, books: Codebooks) -> None:
        system, inner = filesystem(directory)
        rows = pq.read_table(inner, filesystem=system).to_pydict()
        self.books = books
        self.pieces: dict[tuple[int, int], list[tuple[str, int]]] = {}
        self.reach: dict[tuple[int, int], tuple[float, float]] = {}
        self.radius: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width, cell, path, batch, left, right in zip(*(rows[c] for c in ("width", "cell", "path", "batch", "reach_left", "reach_right"))):
            self.pieces.setdefault((width, cell), []).append((path, batch))
            most = self.reach.get((width, cell), (0.0, 0.0))
            self.reach[width, cell] = max(most[0], left), max(most[1], right)
            if width not in self.radius:
                self.radius[width] = tuple(np.full(len(book), -np.inf) for book in books.of(width))  # no row: never reached
            for half, (code, reach) in enumerate(zip(divmod(cell, books.codewords), (left, right))):
                self.radius[width][half][code] = max(self.radius[width][half][code], reach)
        self.held: OrderedDict[tuple[str, int], tuple] = OrderedDict()
        self.bytes = 0
        self.files: OrderedDict[str, pa.RecordBatchFileReader] = OrderedDict()

    def _file(self, path: str) -> pa.RecordBatchFileReader:
        if path not in self.files:
            system, inner = filesystem(path)
            self.files[path] = pa.ipc.open_file(system.open_input_file(inner))
            if len(self.files) > 32:
                self.files.popitem(last=False)
        return self.files[path]

    def read(self, width: int, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(ids, labels, vectors)`` of each piece of a cell."""
        for key in self.pieces[width, cell]:
            if key in self.held:
                self.held.move_to_end(key)
            else:
                batch = self._file(key[0]).get_batch(key[1])
                vectors = batch["vector"].flatten().to_numpy()
                most = np.abs(vectors.astype(np.float64)).max(initial=0)
                vectors = vectors.astype(np.float32 if most < 2**23 else np.float64 if batch["small"][0].as_py() else np.int64)
                piece = batch["id"].to_numpy(), batch["label"].to_numpy(), vectors.reshape(batch.num_rows, width)
                self.held[key] = piece
                self.bytes += sum(a.nbytes for a in piece)
                while self.bytes > HELD and len(self.held) > 1:
                    self.bytes -= sum(a.nbytes for a in self.held.popitem(last=False)[1])
            yield self.held[key]


def scores(vectors: np.ndarray, anchors: np.ndarray, length: float) -> np.ndarray:
    """Exact integer inner products, a row for each anchor of at most ``length``; as floats where these hold them.

    They do while the product of the lengths stays below 2 ** 24 or 2 ** 53; beyond that whole numbers are multiplied.
    """
    if vectors.dtype != np.int64:
        longest = max(vectors.max(initial=0), -float(vectors.min(initial=0))) * vectors.shape[1] ** 0.5 * length
        for kind, most in ((np.float32, 2**23), (np.float64, 2**52)):
            if longest < most:
                return anchors.astype(kind) @ vectors.astype(kind, copy=False).T
    return anchors @ vectors.astype(np.int64).T


def best(held: list[tuple[int, int]], ids: np.ndarray, found: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The first ``count`` of the held ``(-score, id)`` and the new ones."""
    if len(found) > count:
        high = found >= np.partition(found, -count)[-count]
        ids, found = ids[high], found[high]
    return sorted([*held, *zip((-found).tolist(), ids.tolist())])[:count]


class Window:
    """Scores that a positive allows its negatives, and the best found so far."""

    def __init__(self, positive: int, score: int, low: int, high: int, count: int) -> None:
        self.positive, self.score, self.count = positive, score, count
        self.low, self.high = -(-low * score // 100), high * score // 100
        self.held: list[tuple[int, int]] = []

    def need(self) -> float:
        """A row below this score changes nothing; infinite where no score is allowed."""
        if self.low > self.high:
            return np.inf
        return max(self.low, -self.held[-1][0]) if len(self.held) == self.count else self.low

    def offer(self, ids: np.ndarray, found: np.ndarray) -> None:
        fits = (found >= self.need()) & (found <= self.high)
        if fits.any():
            self.held = best(self.held, ids[fits], found[fits], self.count)


class Anchor:
    """One anchor's search: first for positives, then for the negatives of all windows."""

    def __init__(self, key: int, label: int, vector: np.ndarray, cells: Cells, positives: int) -> None:
        self.key, self.label, self.whole, self.count = key, label, vector, positives
        vector = vector.astype(np.float64)
        self.held: list[tuple[int, int]] = []
        self.windows: list[Window] | None = None
        self.width = width = len(vector)
        halves = vector[: width // 2], vector[width // 2 :]
        self.lengths = [float(np.sqrt(h @ h)) for h in halves]
        self.middle = [book @ h for book, h in zip(cells.books.of(width), halves)]
        largest = [float(np.abs(m).max(initial=0)) + n * float(r.max(initial=0)) for m, n, r in zip(self.middle, self.lengths, cells.radius[width])]
        self.slack = 1e-6 + 1e-9 * sum(largest)  # of rounding in bounds
        self.bounds = [m + n * r if n else np.where(r >= 0, m, -np.inf) for m, n, r in zip(self.middle, self.lengths, cells.radius[width])]
        self.start()

    def start(self) -> None:
        self.walk = falling_cells(*self.bounds)

    def need(self) -> float:
        """The score below which rows change nothing."""
        if self.windows is None:
            return -self.held[-1][0] if len(self.held) == self.count else -np.inf
        return min((w.need() for w in self.windows), default=np.inf)

    def limits(self) -> tuple[float, float]:
        """The least and the greatest score that may change something."""
        return self.need(), np.inf if self.windows is None else max((w.high for w in self.windows), default=-np.inf)

    def next_cell(self, cells: Cells) -> int | None:
        """The next cell with rows that may matter; None once the result is certified."""
        need = self.need() - self.slack
        for bound, i, j in self.walk:
            if bound < need or bound == -np.inf:
                return None
            cell = i * cells.books.codewords + j
            reach = cells.reach.get((self.width, cell))
            if reach is None:
                continue
            middle = self.middle[0][i] + self.middle[1][j]
            spread = self.lengths[0] * reach[0] + self.lengths[1] * reach[1]
            if middle + spread < need:
                continue  # the cell's own radii are smaller than its codewords'
            if self.windows is not None and middle - spread - self.slack > max(w.high for w in self.windows):
                continue  # every row lies above all windows
            return cell
        return None

    def offer(self, ids: np.ndarray, labels: np.ndarray, found: np.ndarray) -> None:
        if self.windows is None:
            fits = (labels == self.label) & (ids != self.key) & (found >= self.need())
            if fits.any():
                self.held = best(self.held, ids[fits], found[fits], self.count)
            return
        fits = (labels != self.label) & (found >= self.need())
        if fits.any():
            ids, found = ids[fits], found[fits]
            for window in self.windows:
                window.offer(ids, found)


class Block:
    """Anchors of one width side by side: what a row must score to matter to each, and the cells each has read.

    The heap serves an anchor's first ``WALKED`` cells. An anchor that asks for more gets the others by whole rows of bounds.
    """

    def __init__(self, anchors: list[Anchor], cells: Cells) -> None:
        self.anchors, self.width = anchors, anchors[0].width
        self.whole = np.array([a.whole for a in anchors]).reshape(len(anchors), self.width)
        self.length = max(sum(n * n for n in a.lengths) ** 0.5 for a in anchors)
        self.alike = anchors[0].windows is None
        self.low, self.high = np.array([a.limits() for a in anchors], np.float64).T.copy()
        known = [(cell, *reach) for (width, cell), reach in cells.reach.items() if width == self.width]
        self.cells = np.array([k[0] for k in known], np.int64)
        self.column = {cell: k for k, cell in enumerate(self.cells.tolist())}
        left, right = np.divmod(self.cells, cells.books.codewords)
        reach = np.array([k[1:] for k in known], np.float64).reshape(len(known), 2).T
        middle = np.array([a.middle[0][left] + a.middle[1][right] for a in anchors])
        spread = np.array([a.lengths for a in anchors]) @ reach
        slack = np.array([[a.slack] for a in anchors])
        self.most, self.least = middle + spread + slack, middle - spread - slack
        self.unread = np.ones(middle.shape, bool)

    def walk(self, cells: Cells) -> None:
        """Cells by the heaps, for anchors that need few."""
        left, step, walked = range(len(self.anchors)), 1, 0
        while left and walked < WALKED:
            asked: dict[int, list[int]] = {}
            going = []
            for place in left:
                for _ in range(step):
                    cell = self.anchors[place].next_cell(cells)
                    if cell is None:
                        break
                    asked.setdefault(cell, []).append(place)
                else:
                    going.append(place)
            for cell, places in sorted(asked.items()):
                self.meet(np.array(places), cells, cell)
            left, step, walked = going, min(8, 2 * step), walked + step

    def finish(self, cells: Cells) -> None:
        """The cells left that may matter, those of the highest bounds first; four times as many each time."""
        step = WALKED
        while True:
            matters = self.unread & (self.most >= self.low[:, None]) & (self.least <= self.high[:, None])
            if not matters.any():
                return
            if step < matters.shape[1]:
                bounds = np.where(matters, self.most, -np.inf)
                matters &= bounds >= np.partition(bounds, -step, axis=1)[:, -step, None]
            for column in np.flatnonzero(matters.any(axis=0)).tolist():
                self.meet(np.flatnonzero(matters[:, column]), cells, int(self.cells[column]))
            step *= 4

    def meet(self, places: np.ndarray, cells: Cells, cell: int) -> None:
        """Offer a cell's rows to the anchors that they may change; floats round in order, so none is missed."""
        self.unread[places, self.column[cell]] = False
        whole = self.whole[places]
        for ids, labels, vectors in cells.read(self.width, cell):
            found = scores(vectors, whole, self.length)
            low = self.low[places, None].astype(found.dtype if found.dtype.kind == "f" else np.float64)
            fits = found >= low
            for k in np.flatnonzero(fits.any(axis=1)).tolist():
                place, own = places[k], fits[k]
                anchor = self.anchors[place]
                own &= ((labels == anchor.label) == self.alike) & (found[k] <= self.high[place])
                if own.any():
                    anchor.offer(ids[own], labels[own], found[k, own].astype(np.int64))
                    self.low[place], self.high[place] = anchor.limits()


def certify(anchors: list[Anchor], cells: Cells) -> None:
    """Read cells until every anchor's result is certified; a cell asked for by several anchors at a time is read once.

    What is read beyond need is bounded by what was read before, and a cell is read a few times for all anchors, however many it has.
    """
    for width in sorted({a.width for a in anchors}):
        block = Block([a for a in anchors if a.width == width], cells)
        block.walk(cells)
        block.finish(cells)


def mine(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchors: Column | None = None,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: hard negatives of every anchor.

    Components become ``floor(scale * x)``, a score is the integer inner product, ties go to the smaller id. Positives are an
    anchor's first rows of other ids and its own label; a negative has another label and a score of ``low`` to ``high`` percent
    of the positive's. ``anchors`` selects the anchors (all rows by default). Rows without an id or a label and vectors that
    are null or hold null or non-finite components take no part. Vectors meet only those of their own width, empty ones score
    0. Repeated rows count each, as candidates and as anchors; an anchor's own id is never its positive. Labels are integers;
    inner products must fit a long. An empty table gives no rows, other columns are ignored.
    """
    spark = rows.sparkSession
    wide = F.col(vector_col).cast("array<double>")
    base = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.transform(wide, lambda x: F.floor(F.lit(float(scale)) * x)).alias("vector"),
        (F.lit(True) if anchors is None else F.coalesce(anchors, F.lit(False))).alias("is_anchor"),
        usable(F.col(id_col), F.col(label_col), wide).alias("ok"),
    ).where("ok")
    base = materialize(base.drop("ok"), "vectors")
    size = base.count()
    chosen = [r["vector"] for r in base.select("vector", F.xxhash64("id", "vector").alias("draw")).orderBy("draw").limit(sample).collect()]  # bounded
    books = Codebooks(chosen, max(1, min(CODEWORDS, round((size / CELL_ROWS) ** 0.5))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch["width"].to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                vectors = part["vector"].flatten().to_numpy().astype(np.float64).reshape(part.num_rows, width)
                cell, left, right = books.place(vectors)
                columns = [part["id"], part["label"], part["is_anchor"], part["width"], pa.array(cell, pa.int32()), pa.array(left), pa.array(right), part["vector"]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "is_anchor", "width", "cell", "reach_left", "reach_right", "vector"])

    kinds = "id long, label long, is_anchor boolean, width int, cell int, reach_left double, reach_right double, vector array<long>"
    placed = materialize(base.withColumn("width", F.size("vector")).mapInArrow(place, kinds), "placed")
    folder = scratch_path(spark, "cells")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = filesystem(folder)
        system.create_dir(inner, recursive=True)
        name = f"{folder}/{uuid.uuid4().hex}.arrow"  # a task that runs again writes a file of its own; the directory names the one that counts
        out, count = None, 0
        for batch in batches:
            width, cell = batch["width"].to_numpy(), batch["cell"].to_numpy()
            edges = np.flatnonzero((np.diff(width) != 0) | (np.diff(cell) != 0)) + 1
            starts = [s for a, b in zip([0, *edges], [*edges, len(cell)]) for s in range(a, b, PIECE)]
            for start, stop in zip(starts, [*starts[1:], len(cell)]):
                part = batch.slice(start, stop - start)
                small = pa.array(np.full(stop - start, bool(np.abs(part["vector"].flatten().to_numpy().astype(np.float64)).max(initial=0) < 2**52)))
                piece = pa.RecordBatch.from_arrays([part["id"], part["label"], small, part["vector"]], ["id", "label", "small", "vector"])
                if out is None:
                    sink = system.open_output_stream(inner + name[len(folder) :])
                    out = pa.ipc.new_file(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(piece)
                row = [int(width[start])], [int(cell[start])], [name], [count], [stop - start], [max(part["reach_left"].to_pylist())], [max(part["reach_right"].to_pylist())]
                types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], [f.split()[0] for f in DIRECTORY.split(", ")])
                count += 1
        if out is not None:
            out.close()
            sink.close()

    directory = scratch_path(spark, "directory")
    order = ["width", "cell", "id", F.xxhash64("label", "vector")]
    stored = placed.repartitionByRange(max(1, -(-size // (16 * PIECE))), *order).sortWithinPartitions(*order)
    stored.mapInArrow(store, DIRECTORY).write.parquet(directory)

    asking = placed.where("is_anchor").select("id", "label", "width", "cell", "vector")
    asked = asking.count()
    gathered = max(ANCHORS, min(GATHERED, asked // ANCHORS))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None
        for batch in batches:
            cells = cells or Cells(directory, books)
            parts = max(1, round(batch.num_rows / gathered))
            edges = [batch.num_rows * k // parts for k in range(parts + 1)]
            for start, stop in zip(edges, edges[1:]):
                part = batch.slice(start, stop - start)
                block = [Anchor(k, label, np.array(v, np.int64), cells, positives) for k, label, v in zip(*(part[c].to_pylist() for c in ("id", "label", "vector")))]
                certify(block, cells)
                for anchor in block:
                    anchor.windows = [Window(key, -minus, low, high, negatives) for minus, key in anchor.held]
                    anchor.start()
                certify(block, cells)
                rows = [
                    (a.key, w.positive, rank, key, w.score, -minus) for a in block for w in a.windows for rank, (minus, key) in enumerate(w.held, 1)
                ]
                if rows:
                    columns = [pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])

    tasks = max(1, -(-asked // gathered))  # a number of its own: anchors are few bytes and much work
    return asking.repartitionByRange(tasks, "width", "cell", "id").select("id", "label", "vector").mapInArrow(search, FOUND)


ORACLE = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM base a JOIN base b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


@query("op11_inverted_multi_index", ORACLE)
def op11_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), anchors=F.col("vec_id") % 50 == 0)
