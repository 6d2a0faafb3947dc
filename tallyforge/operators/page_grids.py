"""The ruled scan of many pages at once: numpy over Arrow batches, no loop over pages, words or lines.

Rows come as pieces of pages, all of a page's next to each other: ``WORDS`` and ``OBJECTS`` are arrays, a place in each for a word or a drawn object.
Batches are put together until they hold some ``LEAST`` words and objects; the last page waits for the next batch, as it may go on there. Groups are runs
of sorted rows: a page, a line's position, a table, a cell.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import WHITE

WORDS = {"word_idx": "bigint", "text": "string", "word_x0": "double", "word_x1": "double", "word_top": "double", "word_bottom": "double"}
#: Lines and boxes (``box``); what lacks a place is none.
OBJECTS = {"box": "boolean", "x0": "double", "top": "double", "x1": "double", "bottom": "double"}
LEAST = 200_000
#: Cells written at a time, and pairs of lines compared at a time.
CELLS, PAIRS = 200_000, 2_000_000
#: ``infer_headers``' pattern as RE2 has it: Java's \s takes the vertical tab, and its $ stands before a last line end too.
NUMBER_LIKE = r"^[0-9\t\n\x0B\f\r .,%$()\-]+[\x{85}\x{2028}\x{2029}]?$"
MEANINGLESS = ["".join(c) for w in ("nan", "none") for c in itertools.product(*((x, x.upper()) for x in w))]


def _changes(*keys) -> np.ndarray:
    """Where a row differs from the one before in any of ``keys``; the first row does."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        out[1:] |= k[1:] != k[:-1]
    return out


def _running_max(values, begins):
    """The largest value so far in each run; a run begins where ``begins``."""
    at = np.arange(len(values))
    place = at - np.maximum.accumulate(np.where(begins, at, 0))
    out, step, rest = values.copy(), 1, at
    while len(rest := rest[place[rest] >= step]):
        out[rest] = np.maximum(out[rest], out[rest - step])
        step *= 2
    return out


def _sweep(key, lo, hi, gap):
    """(order, group): intervals of a key in ascending order, and the number of the group of those that meet or come within ``gap``."""
    order = np.lexsort((hi, lo, key))
    lo = lo[order]
    begins = _changes(key[order])
    reach = _running_max(hi[order], begins)
    begins[1:] |= lo[1:] > reach[:-1] + gap
    return order, np.cumsum(begins) - 1


def _last(values, start, end, most):
    """The last place from ``start`` up to ``end`` (not included) of ascending ``values`` that is at most ``most``; ``start`` - 1 if there is none."""
    low, high = start.copy(), end.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        fits = open_ & (values[np.minimum(mid, len(values) - 1)] <= most)
        low, high = np.where(fits, mid + 1, low), np.where(open_ & ~fits, mid, high)
    return low - 1


def _edges(page, rect, x0, top, x1, bottom, thin, snap, join):
    """(key, at, lo, hi) in this order; key: the page's number times two, and one for upright edges."""
    known = ~np.isnan(x0 + top + x1 + bottom)
    flat, upright = bottom - top <= thin, x1 - x0 <= thin
    h, v, box = known & flat & ~upright, known & upright & ~flat, known & rect & ~flat & ~upright
    sides = [(0, h, top, x0, x1), (1, v, x0, top, bottom)]
    if box.any():
        sides += [(0, box, top, x0, x1), (0, box, bottom, x0, x1), (1, box, x0, top, bottom), (1, box, x1, top, bottom)]
    key, at, lo, hi = (np.concatenate(c) for c in zip(*((page[m] * 2 + axis, a[m], b[m], c[m]) for axis, m, a, b, c in sides)))
    if not len(key):
        return key, at, lo, hi
    order = np.lexsort((at, key))
    key, at, lo, hi = key[order], at[order], lo[order], hi[order]
    begins = _changes(key)
    begins[1:] |= at[1:] - at[:-1] > snap
    line = np.cumsum(begins) - 1
    order, part = _sweep(line, lo, hi, join)
    first = np.flatnonzero(_changes(part))
    at, line = at[order], line[order][first]
    low, high = np.minimum.reduceat(at, first), np.maximum.reduceat(at, first)
    each = np.flatnonzero(_changes(line))
    middle = (np.minimum.reduceat(low, each) + np.maximum.reduceat(high, each)) / 2
    return key[order][first], middle[line], lo[order][first], np.maximum.reduceat(hi[order], first)


def _separated(key, at, lo, hi, tol):
    """The number of each edge's table: what blank bands separate, down, then across, then down again, is apart."""
    h = key % 2 == 0
    x, y = (np.where(h, lo, at), np.where(h, hi, at)), (np.where(h, at, lo), np.where(h, at, hi))
    group = key // 2
    for side in (y, x, y):
        order, found = _sweep(group, *side, tol)
        group = np.empty(len(key), np.int64)
        group[order] = found
    return group


class _Grids:
    """The tables of many pages, by page and number.

    ``at``: the positions where edges cross others, those of table t's rows from ``y[t]`` to ``y_end[t]``, its columns' from ``x[t]`` to ``x_end[t]``.
    Edges at position p are those from ``first[p]`` to ``end[p]`` of ``lo`` and ``hi``; they lie apart, in ascending order.
    """

    def __init__(self, key, at, lo, hi, tol):
        page, table = key // 2, _separated(key, at, lo, hi, tol)
        order = np.argsort(own := table * 2 + key % 2, kind="stable")  # they stand by axis, position and start already
        own, at, lo, hi, page = own[order], at[order], lo[order], hi[order], page[order]
        n = int(own.max()) // 2 + 1 if len(own) else 0
        bounds = np.searchsorted(own, np.arange(2 * n + 1))
        crosses = self._crossings(own, at, lo, hi, bounds, tol)
        begins = _changes(own, at)
        group, firsts = np.cumsum(begins) - 1, np.flatnonzero(begins)
        found = np.unique(group[crosses])
        self.lo, self.hi, self.at = lo, hi, at[firsts[found]]
        self.first, self.end = firsts[found], np.append(firsts, len(own))[found + 1]
        places = np.append(0, np.cumsum(np.bincount(own[firsts[found]], minlength=2 * n)))
        size = np.diff(places)
        kept = np.flatnonzero((size[0::2] > 1) & (size[1::2] > 1))
        of = page[bounds[2 * kept]]
        kept = kept[np.lexsort((kept, self.at[places[2 * kept + 1]], self.at[places[2 * kept]], of))]
        self.page = page[bounds[2 * kept]]
        self.y, self.y_end, self.x_end = places[2 * kept], places[2 * kept + 1], places[2 * kept + 2]
        self.x = self.y_end
        start = np.flatnonzero(_changes(self.page)) if len(kept) else np.zeros(0, np.int64)
        self.number = np.arange(len(kept)) - np.repeat(start, np.diff(np.append(start, len(kept)))) + 1
        self.cols = self.x_end - self.x - 1
        self.base = np.append(0, np.cumsum(self.cols * (self.y_end - self.y - 1)))  # each table's first cell

    @staticmethod
    def _crossings(own, at, lo, hi, bounds, tol):
        """Which edges cross another of their table: flat ones against all its upright ones, ``PAIRS`` at a time."""
        crosses = np.zeros(len(own), bool)
        flat = np.flatnonzero(own % 2 == 0)
        start = bounds[own[flat] + 1]
        many = bounds[own[flat] + 2] - start
        upto = np.cumsum(many)
        i = 0
        while i < len(flat):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
            n = many[i:j]
            f = np.repeat(flat[i:j], n)
            u = np.repeat(start[i:j] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(f))
            met = (at[u] >= lo[f] - tol) & (at[u] <= hi[f] + tol) & (at[f] >= lo[u] - tol) & (at[f] <= hi[u] + tol)
            crosses[f[met]] = crosses[u[met]] = True
            i = j
        return crosses

    def holding(self, page, x, y):
        """The first table of its page that holds a point; -1 where none does."""
        out = np.full(len(page), -1)
        if not len(self.page):
            return out
        t, end = np.searchsorted(self.page, page), np.searchsorted(self.page, page, "right")
        rest = np.flatnonzero(t < end)
        while len(rest):
            k, a, b = t[rest], x[rest], y[rest]
            inside = (a >= self.at[self.x[k]]) & (a < self.at[self.x_end[k] - 1]) & (b >= self.at[self.y[k]]) & (b < self.at[self.y_end[k] - 1])
            out[rest[inside]] = k[inside]
            t[rest] += 1
            rest = rest[~inside]
            rest = rest[t[rest] < end[rest]]
        return out

    def nearest_line(self, start, index, low, high):
        """The last position up to ``index`` where an edge stands that covers ``low`` to ``high``; the first position counts as one."""
        index = index.copy()
        rest = np.flatnonzero(index > 0)
        while len(rest):
            p = start[rest] + index[rest]
            e = _last(self.lo, self.first[p], self.end[p], low[rest])
            rest = rest[~((e >= self.first[p]) & (self.hi[e] >= high[rest]))]
            index[rest] -= 1
            rest = rest[index[rest] > 0]
        return index


def _numbers(column):
    return column.to_numpy(zero_copy_only=False)


def _rows(batch, column):
    """The row of each element of a column of arrays."""
    return pc.list_parent_indices(batch.column(column)).to_numpy()


def _pages(batch):
    """Each row's page, numbered, and each page's first row."""
    codes = [_numbers(pc.dictionary_encode(batch.column(c), null_encoding="encode").indices) for c in ("doc_id", "page")]
    begins = _changes(*codes)
    return np.cumsum(begins) - 1, np.flatnonzero(begins)


def _found_edges(batch, page, tol):
    box = _numbers(pc.fill_null(batch.column("box").flatten(), False))
    return _edges(page[_rows(batch, "box")], box, *(_numbers(batch.column(c).flatten()) for c in ("x0", "top", "x1", "bottom")), *tol)


class _Placed:
    """Words in tables: ``t`` the table, ``r`` and ``c`` the smallest cell that holds a word's middle, ``line`` the word's line on the page."""

    def __init__(self, batch, page, g: _Grids, row_tol: float):
        rows, w = _rows(batch, "text"), {c: batch.column(c).flatten() for c in WORDS}
        top = _numbers(w["word_top"])
        known = ~np.isnan(top)
        if batch.column("doc_id").null_count or batch.column("page").null_count:  # a page without a name holds no words
            known &= (_numbers(batch.column("doc_id").is_valid()) & _numbers(batch.column("page").is_valid()))[rows]
        order = np.flatnonzero(known)
        order = order[np.lexsort((top[order], page[rows[order]]))]
        page, top = page[rows[order]], top[order]
        begins = _changes(page)
        begins[1:] |= top[1:] - top[:-1] > row_tol
        line = np.cumsum(begins) - 1
        x0, x1, bottom = (_numbers(w[c])[order] for c in ("word_x0", "word_x1", "word_bottom"))
        x, y = (x0 + x1) / 2, (top + bottom) / 2
        t = g.holding(page, x, y)
        i = np.flatnonzero(t >= 0)
        self.line, self.x0, self.x1, self.top, self.bottom = line[i], x0[i], x1[i], top[i], bottom[i]
        self.t, order = t[i], order[i]
        self.c = _last(g.at, g.x[self.t], g.x_end[self.t], x[i]) - g.x[self.t]
        self.r = _last(g.at, g.y[self.t], g.y_end[self.t], y[i]) - g.y[self.t]
        self._order, self._w = order, w

    def texts(self):
        return self._w["text"].take(pa.array(self._order))

    def index(self):
        index = self._w["word_idx"]
        return _numbers(pc.fill_null(index, np.iinfo(np.int64).min))[self._order]


def _cell_texts(w: _Placed, g: _Grids, tol: float):
    """(cell, text) of each word that stands in a cell, by cell; the texts of a cell, put together, are the cell's text."""
    row_at, col_at = g.y[w.t] + w.r, g.x[w.t]
    c = g.nearest_line(col_at, w.c, g.at[row_at] + tol, g.at[row_at + 1] - tol)
    r = g.nearest_line(g.y[w.t], w.r, g.at[col_at + c] + tol, g.at[col_at + c + 1] - tol)
    cell = g.base[w.t] + r * g.cols[w.t] + c
    text, index = w.texts(), w.index()
    none = _numbers(text.is_null())
    place = cell * (int(w.line.max()) + 1 if len(cell) else 1) + w.line
    order = np.lexsort((index, w.x0, none, place) if none.any() else (index, w.x0, place))
    same = ~_changes(place[order], none[order], w.x0[order], index[order])
    if same.any():  # what is left equal stands by its text
        begins = np.flatnonzero(~same)
        for a, b in zip(begins, np.append(begins[1:], len(order))):
            if b - a > 1:
                order[a:b] = sorted(order[a:b], key=lambda i: (text[int(i)].as_py() or "").encode())
    cell, line, none = cell[order], w.line[order], none[order]
    new_cell, new_line = _changes(cell), _changes(line)
    mark = pa.array(["", "\n", " "]).take(pa.array(np.where(new_cell, 0, np.where(new_line, 1, np.where(none, 0, 2)))))
    return cell, pc.binary_join_element_wise(mark, pc.fill_null(text.take(pa.array(order)), ""), "")


def _cut(cell, texts, start, stop):
    """The texts of the cells from ``start`` up to ``stop``: those of a cell's words stand side by side, so only the ends of cells are new."""
    a, b = np.searchsorted(cell, (start, stop))
    own = texts.slice(a, b - a)
    _, offsets, data = own.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(own) + 1, own.offset * 4) if len(own) else np.zeros(1, np.int32)
    ends = np.append(0, np.cumsum(np.bincount(cell[a:b] - start, minlength=stop - start)))
    return pa.StringArray.from_buffers(stop - start, pa.py_buffer(offsets[ends].astype(np.int32)), data if data is not None else pa.py_buffer(b""))


def _named(batch, first, page):
    at = pa.array(first[page])
    return [batch.column("doc_id").take(at), batch.column("page").take(at)]


def _int(values):
    return pa.array(values.astype(np.int32))


def edges(batch, thin, snap, join):
    """(doc_id, page, axis, at, lo, hi)."""
    page, first = _pages(batch)
    key, at, lo, hi = _found_edges(batch, page, (thin, snap, join))
    yield [*_named(batch, first, key // 2), pa.array(["h", "v"]).take(pa.array(key % 2)), pa.array(at), pa.array(lo), pa.array(hi)]


def _scanned(batch, tol, row_tol):
    page, first = _pages(batch)
    g = _Grids(*_found_edges(batch, page, (tol, tol, tol)), tol)
    return g, _Placed(batch, page, g, row_tol), first


def accuracy(batch, tol, row_tol):
    """(doc_id, page, table_num, accuracy)."""
    g, w, first = _scanned(batch, tol, row_tol)
    row_at, col_at = g.y[w.t] + w.r, g.x[w.t] + w.c
    common = lambda a, b, lo, hi: np.maximum(np.minimum(b, hi) - np.maximum(a, lo), 0.0) / np.maximum(b - a, 1e-9)
    share = common(w.x0, w.x1, g.at[col_at], g.at[col_at + 1]) * common(w.top, w.bottom, g.at[row_at], g.at[row_at + 1])
    total, n = np.bincount(w.t, share, len(g.page)), np.bincount(w.t, minlength=len(g.page))
    yield [*_named(batch, first, g.page), _int(g.number), pa.array(100 * (total / np.maximum(n, 1)))]


def cells(batch, tol, row_tol):
    """(doc_id, page, table_num, row_idx, col_idx, value): every cell of every table."""
    g, w, first = _scanned(batch, tol, row_tol)
    cell, texts = _cell_texts(w, g, tol)
    for start in range(0, int(g.base[-1]), CELLS):
        stop = min(start + CELLS, int(g.base[-1]))
        at = np.arange(start, stop)
        t = np.searchsorted(g.base, at, "right") - 1
        row, col = np.divmod(at - g.base[t], g.cols[t])
        yield [*_named(batch, first, g.page[t]), _int(g.number[t]), _int(row), _int(col), _cut(cell, texts, start, stop)]


def headed_cells(batch, tol, row_tol, missing, gate):
    """(doc_id, page, table_num, row_idx, col_idx, header, value): cleaned cells with headers of the tables that pass their page's gate, renumbered by page.

    What ``tables.clean_cells``, ``infer_headers``, ``score_tables`` (the quality) and ``page_gate`` do to cells none of which is null; whole tables at a time.
    """
    g, w, first = _scanned(batch, tol, row_tol)
    cell, texts = _cell_texts(w, g, tol)
    pages, low, high = gate
    number = pc.fill_null(pc.less_equal(batch.column("page").take(pa.array(first[g.page])), pages), False)
    limit = np.where(_numbers(number), low, high)
    before, last = 0, -1  # tables kept so far of the page ``last``
    a = 0
    while a < len(g.page):
        b = max(a + 1, int(np.searchsorted(g.base, g.base[a] + CELLS, "right")) - 1)
        start, stop, n = int(g.base[a]), int(g.base[b]), b - a
        at = np.arange(start, stop)
        k = np.repeat(np.arange(n), np.diff(g.base[a : b + 1]))
        t = k + a
        row, col = np.divmod(at - g.base[t], g.cols[t])
        value = _cut(cell, texts, start, stop)
        bare = pc.utf8_trim(value, characters=WHITE)
        blank = _numbers(pc.is_in(bare, pa.array(missing)))
        value = pc.if_else(pa.array(blank), "", value)
        top = np.flatnonzero(row == 0)
        texty = ~blank[top] & ~_numbers(pc.match_substring_regex(value.take(pa.array(top)), NUMBER_LIKE))
        head = (np.bincount(k[top], texty, n) / g.cols[a:b] >= 0.5) & (g.y_end[a:b] - g.y[a:b] > 2)
        body = ~(head[k] & (row == 0))
        full = body & ~blank & ~_numbers(pc.is_in(bare, pa.array(MEANINGLESS)))
        digits = full & _numbers(pc.match_substring_regex(bare, "[0-9]"))
        many = np.bincount(k[body], minlength=n)
        quality = np.minimum(np.bincount(k, full, n) / many + np.minimum(np.bincount(k, digits, n) / many, 0.25), 1.0)
        good = quality >= limit[a:b]
        of = g.page[a:b]
        begins = np.flatnonzero(_changes(of))
        rank = np.cumsum(good)
        rank -= np.repeat(np.append(0, rank)[begins], np.diff(np.append(begins, n)))
        rank[of == last] += before
        before, last = int(rank[-1]), of[-1]
        out = np.flatnonzero(body & good[k])
        t, k, col = t[out], k[out], col[out]
        names = pa.array([f"Column_{i + 1}" for i in range(int(g.cols[a:b].max()))]).take(pa.array(col))
        header = pc.if_else(pa.array(head[k]), value.take(pa.array(g.base[t] - start + col)), names)
        yield [*_named(batch, first, g.page[t]), _int(rank[k]), _int(row[out]), _int(col), header, value.take(pa.array(out))]
        a = b


def mapper(scan, names, *args, least: int | None = None):
    """A function for ``mapInArrow``: ``scan`` over batches of whole pages, with columns ``names``."""
    least = least or LEAST

    def size(batch):
        return sum(len(batch.column(c).flatten()) for c in ("text", "box")) + batch.num_rows

    def whole(held):
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    def run(batches):
        held, n, enough = [], 0, least
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += size(batch)
            if n < enough:
                continue
            batch = whole(held)
            last = int(_pages(batch)[1][-1])  # where the last page begins
            if last:
                for out in scan(batch.slice(0, last), *args):
                    yield pa.RecordBatch.from_arrays(out, names)
            held = [batch.slice(last)]
            n = size(held[0])
            enough = max(least, 2 * n)
        if held:
            for out in scan(whole(held), *args):
                yield pa.RecordBatch.from_arrays(out, names)

    return run
