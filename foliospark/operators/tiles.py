"""Page pairs as tiles of their grids: a row a tile with the cells of both sides, those of a rim around it included, solved in numpy a batch of tiles at a time.

tiles (keys, width, height, tx, ty, old, new: array of cells (x, y, r, g, b, a), and dx, dy where pages may have moved). A tile holds what its own cells
look at, so that pages of any size are spread over rows of bounded size, and no cell becomes a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.colour import CHANNELS, FIRST, I, Q, SECOND, Y
from foliospark.plans.grouped import lists
from foliospark.plans.shared import ensure_importable, written

TILE = 64
#: Cells of tiles, and bytes of lines, that are looked at together.
HELD, TEXT_HELD = 1 << 20, 1 << 22
RUN = "y int, x0 int, x1 int"
CELLS = "array<struct<x:int,y:int,r:int,g:int,b:int,a:int>>"


def extents(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides are padded to one extent: missing cells are white."""
    return cells.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _count(size: str, tile: int = TILE) -> Column:
    return F.ceil(F.col(size) / tile).cast("int")


def tiled(cells: DataFrame, keys: list[str], offsets: DataFrame | None = None, halo: int = 3, blank: bool = False, tile: int = TILE) -> DataFrame:
    """Tiles of cells (keys, side, x, y, r, g, b, a). offsets (keys, dx, dy): where the old cell (x, y) stands on the new side; a new cell goes to the tiles that look
    at it from there. Tiles without a cell are left out unless `blank`."""
    moved = cells if offsets is None else cells.join(offsets.select(*keys, F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy")), keys, "left")
    shift = lambda d: F.lit(0.0) if offsets is None else F.when(F.col("side") == "new", F.coalesce(d, F.lit(0.0))).otherwise(0.0)
    reach = halo + 3 if offsets is not None else halo

    def spread(c: str) -> Column:
        at = F.col(c) - shift(f"d{c}")
        first, last = F.greatest(F.ceil((at - reach - tile) / tile).cast("int"), F.lit(0)), F.floor((at + reach) / tile).cast("int")
        return F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias(f"t{c}")

    put = moved.select("*", spread("x")).select("*", spread("y"))
    cell = F.struct(*[F.col(c).cast("int").alias(c) for c in ("x", "y", *CHANNELS)])
    side = lambda s: F.collect_list(F.when(F.col("side") == s, cell)).cast(CELLS).alias(s)
    offset = [] if offsets is None else [F.first(d).alias(d) for d in ("dx", "dy")]
    grouped = put.groupBy(*keys, "tx", "ty").agg(side("old"), side("new"), *offset)
    size = extents(cells, keys)
    if blank:
        frame = size.select("*", F.explode(F.sequence(F.lit(0), _count("width", tile) - 1)).alias("tx")).select("*", F.explode(F.sequence(F.lit(0), _count("height", tile) - 1)).alias("ty"))
        none = F.array().cast(CELLS)
        return frame.join(grouped, [*keys, "tx", "ty"], "left").withColumns({s: F.coalesce(s, none) for s in ("old", "new")})
    return grouped.join(size, keys).filter((F.col("tx") < _count("width", tile)) & (F.col("ty") < _count("height", tile)))


def page_tiles(pages: DataFrame, halo: int = 3) -> DataFrame:
    """Tiles of pages (pair_id, page_index, old_lines, new_lines), a cell a word as in `misc.page_cells`, cut inside their row: no exchange."""
    word = lambda w: F.struct(F.length(w).alias("n"), F.length(F.regexp_replace(w, "[^A-Za-z]", "")).alias("l"))
    grey = lambda n: F.greatest(F.lit(0), 255 - n * 20).cast("int")
    colour = lambda s: F.struct(grey(s.n).alias("r"), grey(s.l).alias("g"), grey(s.n - s.l).alias("b"))
    grid = lambda lines: F.transform(lines, lambda t: F.transform(F.transform(F.split(t, " "), word), colour))
    both = pages.select("pair_id", "page_index", grid("old_lines").alias("o"), grid("new_lines").alias("n"))
    widest = lambda c: F.array_max(F.transform(c, lambda line: F.size(line)))
    sized = both.select("*", F.greatest(widest("o"), widest("n")).alias("width"), F.greatest(F.size("o"), F.size("n")).alias("height"))
    put = sized.select("*", F.explode(F.sequence(F.lit(0), _count("width") - 1)).alias("tx")).select("*", F.explode(F.sequence(F.lit(0), _count("height") - 1)).alias("ty"))
    low = lambda t: F.greatest(F.col(t) * TILE - halo, F.lit(0))
    span = lambda t: (F.col(t) + 1) * TILE + halo - low(t)

    def side(c: str) -> Column:
        line = lambda t, i: F.transform(F.slice(t, low("tx") + 1, span("tx")), lambda s, j: F.struct((low("tx") + j).cast("int").alias("x"), (low("ty") + i).cast("int").alias("y"), s.r.alias("r"), s.g.alias("g"), s.b.alias("b"), F.lit(255).alias("a")))
        return F.flatten(F.transform(F.slice(c, low("ty") + 1, span("ty")), line))

    return put.select("pair_id", "page_index", "width", "height", "tx", "ty", side("o").alias("old"), side("n").alias("new"))


class Canvas:
    """The channels of a rectangle [x0, x1) x [y0, y1) of one side; cells that aren't there are white. Of a cell that is given twice the last counts."""

    def __init__(self, cells: dict[str, np.ndarray], part: slice, x0: int, x1: int, y0: int, y1: int):
        x, y = cells["x"][part], cells["y"][part]
        held = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
        place = (y[held] - y0) * (x1 - x0) + x[held] - x0
        self.x0, self.y0, self.channels = x0, y0, {}
        for c in CHANNELS:
            flat = np.full((y1 - y0) * (x1 - x0), 255, np.int32)
            flat[place] = cells[c][part][held]
            self.channels[c] = flat.reshape(y1 - y0, x1 - x0)

    def seen(self, x: np.ndarray, y: np.ndarray, width: int, height: int) -> dict[str, np.ndarray]:
        """The channels at places (every y with every x), bilinear by channel in whole numbers; places beyond the rim of the page are those at the rim."""
        x, y = np.clip(x, 0, width - 1), np.clip(y, 0, height - 1)
        xi, yi = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
        fx, fy = (x - xi)[None, :], (y - yi)[:, None]
        left, up = xi - self.x0, yi - self.y0
        if not (fx.any() or fy.any()):
            return {c: v[np.ix_(up, left)] for c, v in self.channels.items()}
        right, down = np.minimum(xi + 1, width - 1) - self.x0, np.minimum(yi + 1, height - 1) - self.y0
        parts = [(np.ix_(a, b), w) for a, b, w in ((up, left, (1 - fx) * (1 - fy)), (up, right, fx * (1 - fy)), (down, left, (1 - fx) * fy), (down, right, fx * fy))]
        return {c: np.floor(255 + sum(w * (v[at] - 255) for at, w in parts) + 0.5).astype(np.int32) for c, v in self.channels.items()}


def _axes(c: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [w[0] * c["r"] + w[1] * c["g"] + w[2] * c["b"] for w in (Y, I, Q)]


def _difference(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """`colour.difference` of axes and opacities."""
    y, i, q = (p - r for p, r in zip(a[:3], b[:3], strict=True))
    opacity = (a[3] + b[3]) / 510.0
    one = opacity * (y * y + FIRST[0] * i * i) + FIRST[1] * q * q
    two = opacity * y * y + SECOND[0] * i * i + SECOND[1] * q * q
    return np.sqrt(np.maximum(one, 0.0) + np.maximum(two, 0.0))


class Canvases:
    """The channels of rectangles [x0, x1) x [y0, y1) of one side, one a tile, one after the other; as in `Canvas`, cells that aren't there are white."""

    def __init__(self, sizes: np.ndarray, cells: dict[str, np.ndarray], x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray):
        self.x0, self.y0, self.width, self.area = x0, y0, x1 - x0, (x1 - x0) * (y1 - y0)
        self.first, self.channels = np.cumsum(self.area) - self.area, {}
        k, x, y = np.repeat(np.arange(len(sizes)), sizes), cells["x"], cells["y"]
        held = (x >= x0[k]) & (x < x1[k]) & (y >= y0[k]) & (y < y1[k])
        place = self._place(k[held], y[held], x[held])
        for c in CHANNELS:
            self.channels[c] = np.full(int(self.area.sum()), 255, np.int32)
            self.channels[c][place] = cells[c][held]

    def _place(self, k: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.first[k] + (y - self.y0[k]) * self.width[k] + x - self.x0[k]

    def at(self, k: np.ndarray, y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        place = self._place(k, y, x)
        return {c: v[place] for c, v in self.channels.items()}

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tile, y and x of cells by their number."""
        k = np.repeat(np.arange(len(self.area)), self.area)[at]
        at = at - self.first[k]
        return k, self.y0[k] + at // self.width[k], self.x0[k] + at % self.width[k]


def _seen(new, k: np.ndarray, y: np.ndarray, x: np.ndarray, w: np.ndarray, h: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> dict[str, np.ndarray]:
    """The channels of the new side where the old cells (x, y) stand on it, as `Canvas.seen` gives them."""
    x, y = np.clip(x + dx[k], 0, w[k] - 1), np.clip(y + dy[k], 0, h[k] - 1)
    xi, yi = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    found, fx, fy = new.at(k, yi, xi), x - xi, y - yi
    between = np.flatnonzero((fx != 0) | (fy != 0))
    if len(between):
        k, xi, yi, fx, fy = (v[between] for v in (k, xi, yi, fx, fy))
        right, down = np.minimum(xi + 1, w[k] - 1), np.minimum(yi + 1, h[k] - 1)
        parts = [(new.at(k, a, b), f) for a, b, f in ((yi, xi, (1 - fx) * (1 - fy)), (yi, right, fx * (1 - fy)), (down, xi, (1 - fx) * fy), (down, right, fx * fy))]
        for c in CHANNELS:
            found[c][between] = np.floor(255 + sum(f * (v[c] - 255) for v, f in parts) + 0.5).astype(np.int32)
    return found


def _crowded(old: dict[str, np.ndarray], seen, k: np.ndarray, y: np.ndarray, x: np.ndarray, threshold: float, reach: int, neighbours: int) -> tuple[np.ndarray, ...]:
    """k, y and x, in order, of those places, each given once, whose old cell differs from all that `seen` gives within `reach`, with `neighbours` of the kind about them."""
    a = [*_axes(old), old["a"]]
    steps = range(-reach, reach + 1)
    for j, i in sorted(((j, i) for j in steps for i in steps), key=lambda s: abs(s[0]) + abs(s[1])):
        there = seen(k, y + j, x + i)
        apart = _difference(a, [*_axes(there), there["a"]]) > threshold
        k, y, x, a = k[apart], y[apart], x[apart], [v[apart] for v in a]
    if not len(k):
        return k, y, x
    wide, high = int(x.max()) + 3, int(y.max()) + 3
    code = (k * high + y + 1) * wide + x + 1
    order = np.argsort(code)
    code, k, y, x = (v[order] for v in (code, k, y, x))
    has = lambda c: code[np.minimum(np.searchsorted(code, c), len(code) - 1)] == c
    n = sum(has(code + j * wide + i).astype(np.int8) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j)
    return tuple(v[n >= neighbours] for v in (k, y, x))


def _joined(k: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """k, y, x0 and x1 (inclusive) of the runs of places that are in order."""
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    starts = np.flatnonzero(first)
    return k[starts], y[starts], x[starts], x[np.append(starts[1:], len(k))[: len(starts)] - 1]


def _marked(batch: pa.RecordBatch, threshold: float, reach: int, neighbours: int, tile: int) -> tuple[np.ndarray, ...]:
    """Row of the batch, y, x0, x1 (inclusive) of the runs of marked cells of its tiles."""
    moves = [np.nan_to_num(batch.column(d).to_numpy(zero_copy_only=False).astype(float)) if d in batch.schema.names else np.zeros(batch.num_rows) for d in ("dx", "dy")]
    moved = (moves[0] != 0) | (moves[1] != 0)
    found = []
    for rows in (np.flatnonzero(~moved), np.flatnonzero(moved)):
        if len(rows):
            k, *runs = _marked_alike(batch.take(pa.array(rows)), *[m[rows] for m in moves], threshold, reach, neighbours, tile)
            found.append((rows[k], *runs))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _marked_alike(batch: pa.RecordBatch, dx: np.ndarray, dy: np.ndarray, threshold: float, reach: int, neighbours: int, tile: int) -> tuple[np.ndarray, ...]:
    """The same of tiles that have all moved, or none of which has: these meet cell by cell."""
    w, h, tx, ty = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "height", "tx", "ty"))
    x0, y0 = tx * tile, ty * tile
    x1, y1 = np.minimum(x0 + tile, w), np.minimum(y0 + tile, h)
    ax0, ax1, ay0, ay1 = np.maximum(x0 - 1, 0), np.minimum(x1 + 1, w), np.maximum(y0 - 1, 0), np.minimum(y1 + 1, h)  # with those about them
    low = lambda v, most: np.floor(np.clip(v, 0, most - 1)).astype(np.int64)
    high = lambda v, most: np.minimum(low(v, most) + 2, most)
    around = low(ax0 - reach + dx, w), high(ax1 - 1 + reach + dx, w), low(ay0 - reach + dy, h), high(ay1 - 1 + reach + dy, h)
    new = Canvases(*lists(batch.column("new")), *around)
    still = not (dx.any() or dy.any())
    old = Canvases(*lists(batch.column("old")), *(around if still else (ax0, ax1, ay0, ay1)))
    seen = lambda k, y, x: _seen(new, k, y, x, w, h, dx, dy)
    if still:
        at = np.flatnonzero(np.any([old.channels[c] != new.channels[c] for c in CHANNELS], axis=0))
        k, y, x = old.places(at)
        held = (x >= ax0[k]) & (x < ax1[k]) & (y >= ay0[k]) & (y < ay1[k])
    else:
        at = np.arange(int(old.area.sum()))
        k, y, x = old.places(at)
        there = seen(k, y, x)
        held = np.any([old.channels[c] != there[c] for c in CHANNELS], axis=0)
        held &= (x + dx[k] >= 0) & (x + dx[k] < w[k]) & (y + dy[k] >= 0) & (y + dy[k] < h[k])
    k, y, x = _crowded({c: v[at[held]] for c, v in old.channels.items()}, seen, k[held], y[held], x[held], threshold, reach, neighbours)
    own = (x >= x0[k]) & (x < x1[k]) & (y >= y0[k]) & (y < y1[k])
    return _joined(k[own], y[own], x[own])


def _pieces(batch: pa.RecordBatch, costs: np.ndarray, most: int):
    """The batch in pieces of consecutive rows that cost at most so much together, or of one row."""
    total, done = np.cumsum(costs.astype(np.int64)), 0
    while done < batch.num_rows:
        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most, "right")))
        yield batch.slice(done, end - done)
        done = end


def _run_batch(batch: pa.RecordBatch, keys: list[str], runs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    at = pa.array(runs[0])
    return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keys], *[pa.array(v.astype(np.int32)) for v in runs[1:]]], names=[*keys, "y", "x0", "x1"])


def _parts(batch: pa.RecordBatch):
    """Row by row: the number, the cells of both sides, and the tile's numbers."""
    sides = []
    for s in ("old", "new"):
        sizes, cells = lists(batch.column(s))
        ends = np.cumsum(sizes)
        sides.append((cells, ends - sizes, ends))
    numbers = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("width", "height", "tx", "ty")]
    for k, at in enumerate(zip(*numbers, strict=True)):
        yield k, [(cells, slice(first[k], end[k])) for cells, first, end in sides], *map(int, at)


def _kinds(df: DataFrame, keys: list[str]) -> list[str]:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"{k} {kinds[k]}" for k in keys]


def marked_runs(tiles: DataFrame, keys: list[str], threshold: float = 60.0, reach: int = 2, neighbours: int = 3, tile: int = TILE) -> DataFrame:
    """(keys, y, x0, x1): runs of old cells that differ in colour by more than the threshold from every place of the new side within `reach` (places beyond the rim count as those
    at the rim), and have `neighbours` of the kind about them. A run ends at its tile. Old cells whose place lies outside the new side are skipped. The tiles' rim is `reach` + 1 at least."""
    ensure_importable(tiles.sparkSession)
    return tiles.mapInArrow(marker(keys, threshold, reach, neighbours, tile), ", ".join([*_kinds(tiles, keys), RUN]))


def marker(keys: list[str], threshold: float, reach: int, neighbours: int, tile: int = TILE):
    """Batches of tiles to batches of runs; what a tile looks at is flat arrays for many tiles at once."""
    def mark(batches):
        for batch in batches:
            for piece in _pieces(batch, np.full(batch.num_rows, (tile + 2 * reach + 2) ** 2), HELD):
                runs = _marked(piece, threshold, reach, neighbours, tile)
                if len(runs[0]):
                    yield _run_batch(piece, keys, runs)

    return mark


class Words:
    """The colours of the words of pages (a list of lines each) as in `misc.page_cells`, read off the bytes of all lines at once; places without a word are white."""

    def __init__(self, column: pa.Array):
        flat = column.flatten().cast(pa.large_string())
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        text = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.lines = np.diff(column.offsets.to_numpy()).astype(np.int64)
        self.first = np.cumsum(self.lines) - self.lines
        spaces = np.flatnonzero(text == 32)
        self.words = np.diff(np.searchsorted(spaces, offsets)) + 1
        self.start = np.cumsum(self.words) - self.words
        starts, ends = np.sort(np.append(offsets[:-1], spaces + 1)), np.sort(np.append(spaces, offsets[1:]))
        within = lambda held: np.diff(np.append(0, np.cumsum(held))[np.stack([starts, ends])], axis=0)[0]
        n, letters = within((text & 0xC0) != 0x80), within(((text | 0x20) - np.uint8(97)) < 26)
        # the last one is white
        self.colours = [np.append(np.maximum(255 - 20 * v, 0), 255).astype(np.int32) for v in (n, letters, n - letters)]
        self.page = np.repeat(np.arange(len(self.lines)), self.lines)

    def at(self, k: np.ndarray, y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        place = self.place(k, y, x)
        return {**{c: v[place] for c, v in zip("rgb", self.colours, strict=True)}, "a": np.full(len(k), 255, np.int32)}

    def place(self, k: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The numbers of the words at these places; -1 where there is none."""
        there = y < self.lines[k]
        line = np.where(there, self.first[k] + y, 0)
        if not len(self.words):
            return np.full(len(k), -1)
        return np.where(there & (x < self.words[line]), self.start[line] + x, -1)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Page, y and x of every word."""
        line = np.repeat(np.arange(len(self.words)), self.words)
        k = self.page[line]
        return k, line - self.first[k], np.arange(len(line)) - self.start[line]

    def widest(self) -> np.ndarray:
        most = np.zeros(len(self.lines), np.int64)
        np.maximum.at(most, self.page, self.words)
        return most


def text_runs(pages: DataFrame, threshold: float = 60.0, reach: int = 2, neighbours: int = 3) -> DataFrame:
    """(pair_id, page_index, y, x0, x1): `marked_runs` of common pages (pair_id, page_index, old_lines, new_lines), a cell a word.

    Only lines leave the JVM: cells are read off their bytes, and only those whose colour isn't the other side's are looked at further. No page is cut, as
    what a page takes is linear in its words.
    """
    keys = ["pair_id", "page_index"]
    ensure_importable(pages.sparkSession)

    def mark(batches):
        for batch in batches:
            sides = [batch.column(c) for c in ("old_lines", "new_lines")]
            costs = sum(np.diff(np.append(0, np.cumsum(pc.fill_null(pc.binary_length(s.flatten()), 0).to_numpy(zero_copy_only=False)))[s.offsets.to_numpy() - s.offsets[0].as_py()]) for s in sides)
            for piece in _pieces(batch, costs, TEXT_HELD):
                runs = _marked_words(Words(piece.column("old_lines")), Words(piece.column("new_lines")), threshold, reach, neighbours)
                if len(runs[0]):
                    yield _run_batch(piece, keys, runs)

    return pages.select(*keys, "old_lines", "new_lines").mapInArrow(mark, ", ".join([*_kinds(pages, keys), RUN]))


def _marked_words(old: Words, new: Words, threshold: float, reach: int, neighbours: int) -> tuple[np.ndarray, ...]:
    w, h = np.maximum(old.widest(), new.widest()), np.maximum(old.lines, new.lines)
    # of the words of the new side those that no old one stands at
    more = [v[old.place(*new.places()) < 0] for v in new.places()]
    k, y, x = (np.append(a, b) for a, b in zip(old.places(), more, strict=True))
    a, b = old.at(k, y, x), new.at(k, y, x)
    differ = np.any([a[c] != b[c] for c in "rgb"], axis=0)
    seen = lambda k, y, x: new.at(k, np.clip(y, 0, h[k] - 1), np.clip(x, 0, w[k] - 1))
    return _joined(*_crowded({c: v[differ] for c, v in a.items()}, seen, k[differ], y[differ], x[differ], threshold, reach, neighbours))


def cells_of(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y) of runs."""
    return runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def _shift_sums(sides, w: int, h: int, tx: int, ty: int, steps: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """For every shift (dy, then dx) the sum of the differences in luminance over the tile's spots, and their number."""
    x0, y0 = tx * TILE, ty * TILE
    x1, y1 = min(x0 + TILE, w), min(y0 + TILE, h)
    xs, ys = (np.arange(-(-low // every) * every, high, every) for low, high in ((x0, x1), (y0, y1)))
    if not (len(xs) and len(ys)):
        return np.zeros(len(steps) ** 2), np.zeros(len(steps) ** 2, np.int64)
    at = [(v[:, None] + steps[None, :]).ravel() for v in (xs, ys)]
    held = [(v >= 0) & (v < most) for v, most in zip(at, (w, h), strict=True)]
    reach = int(np.ceil(steps[-1])) + 1
    old = Canvas(*sides[0], x0, x1, y0, y1)
    new = Canvas(*sides[1], max(x0 - reach, 0), min(x1 + reach + 1, w), max(y0 - reach, 0), min(y1 + reach + 1, h))
    light = lambda c: Y[0] * c["r"] + Y[1] * c["g"] + Y[2] * c["b"]
    seen = light(new.seen(*at, w, h)).reshape(len(ys), len(steps), len(xs), len(steps))
    apart = np.abs(light(old.channels)[np.ix_(ys - y0, xs - x0)][:, None, :, None] - seen)
    counts = held[1].reshape(len(ys), len(steps), 1, 1) & held[0].reshape(1, 1, len(xs), len(steps))
    return np.where(counts, apart, 0.0).sum(axis=(0, 2)).ravel(), counts.sum(axis=(0, 2)).ravel()


def shift_scores(tiles: DataFrame, keys: list[str], reach: float, step: float, every: int) -> DataFrame:
    """(keys, sums, counts, whole): what `_shift_sums` gives, added up over the tiles of a page that follow one another; `whole` if these are all of them."""
    ensure_importable(tiles.sparkSession)
    n = int(reach / step)
    steps = np.arange(-n, n + 1) * step

    def score(batches):
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            rows, sums, counts, whole, last, seen = [], [], [], [], None, 0
            for k, sides, w, h, tx, ty in _parts(batch):
                s, c = _shift_sums(sides, w, h, tx, ty, steps, every)
                if rows and names[k] == last:
                    sums[-1], counts[-1], seen = sums[-1] + s, counts[-1] + c, seen + 1
                else:
                    last, seen = names[k], 1
                    for part, value in ((rows, k), (sums, s), (counts, c), (whole, False)):
                        part.append(value)
                whole[-1] = seen == -(-w // TILE) * -(-h // TILE)
            if rows:
                ends = pa.array(np.arange(len(rows) + 1) * len(steps) ** 2, pa.int32())
                arrays = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v))) for v in (sums, counts)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(rows)) for k in keys], *arrays, pa.array(whole)], names=[*keys, "sums", "counts", "whole"])

    return tiles.mapInArrow(score, ", ".join([*_kinds(tiles, keys), "sums array<double>, counts array<bigint>, whole boolean"]))


def best_shifts(tiles: DataFrame, keys: list[str], reach: float = 2.0, step: float = 0.25, every: int = 8) -> DataFrame:
    """(keys, dx, dy, score): the shift with the smallest mean difference; no shift wins over equals, then the first by dy and dx."""
    n = 2 * int(reach / step) + 1
    made = shift_scores(tiles, keys, reach, step, every)
    scores = F.transform("sums", lambda s, i: F.struct(F.round(F.try_divide(s, F.get("counts", i)), 9).alias("score"), (i != n * n // 2).alias("moved"), ((F.floor(i / n) - n // 2) * step).cast("double").alias("dy"), ((i % n - n // 2) * step).cast("double").alias("dx")))
    best = made.select(*keys, F.array_min(F.filter(scores, lambda s: s.score.isNotNull())).alias("b"), F.when(~F.col("whole"), F.struct("sums", "counts")).alias("part"))
    rows = written(best, "shifts")
    added = lambda c: F.aggregate(F.slice("p", 2, F.size("p")), F.get("p", F.lit(0))[c], lambda a, p: F.zip_with(a, p[c], lambda x, y: x + y)).alias(c)
    rest = rows.filter("part IS NOT NULL").groupBy(*keys).agg(F.collect_list("part").alias("p")).select(*keys, added("sums"), added("counts")).select(*keys, F.array_min(F.filter(scores, lambda s: s.score.isNotNull())).alias("b"))
    every_page = rows.filter("part IS NULL").select(*keys, "b").unionByName(rest)
    return every_page.select(*keys, "b.dx", "b.dy", F.round("b.score", 4).alias("score"))
