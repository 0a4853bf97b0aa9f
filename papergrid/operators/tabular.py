"""Cells, covered cells, snapped edges and slots of many tables at once, in numpy (``batched``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batched import Groups, Work, changed, edges, expanded, joined, pairs, split

BOX = ("x1", "y1", "x2", "y2")


def then(*works: Work) -> Work:
    """One after the other, on the same groups."""

    def run(g: Groups) -> Groups:
        for work in works:
            g = work(g)
        return g

    return run


def bands(g: Groups) -> Groups:
    """Bands of level lines that lie under each other: of equal sides and top the lowest bottom, then of equal sides and bottom the highest top."""
    h = g.at(np.flatnonzero(g["level"]))
    h = h.at(np.lexsort((h["y1"], h.gid)))
    x1, x2, y1, y2 = h["x1"], h["x2"], h["y1"], h["y2"]
    found = [np.zeros((5, 0), np.int64)]

    def least(rows: np.ndarray, sign: int, by: tuple[int, ...], of: int) -> np.ndarray:
        rows = rows[:, np.lexsort((sign * rows[of], *(rows[i] for i in by[::-1])))]
        return rows[:, changed(*(rows[i] for i in by))]

    for a, b in pairs(h.gid, h.gid):
        under = y1[a] < y1[b]
        a, b = a[under], b[under]
        w = np.where(x2[a] == x1[a], 1, x2[a] - x1[a])
        between = lambda p, k: (x1[k] <= p) & (p <= x2[k])
        left = (np.abs(x1[a] - x1[b]) < w) | between(x1[b], a) | between(x1[a], b)
        right = (np.abs(x2[a] - x2[b]) < w) | between(x2[b], a) | between(x2[a], b)
        a, b = a[left & right], b[left & right]
        found.append(least(np.array([h.gid[a], np.maximum(x1[a], x1[b]), np.minimum(x2[a], x2[b]), y1[a], y2[b]], np.int64), 1, (0, 1, 2, 3), 4))
    rows = least(np.concatenate(found, 1), 1, (0, 1, 2, 3), 4)
    rows = least(rows, -1, (0, 1, 2, 4), 3)
    return Groups(rows[0], dict(zip(("x1", "x2", "y1", "y2"), rows[1:])))


def cells(g: Groups) -> Groups:
    """Bands cut at the upright lines that span them: box, band_x1, band_x2 and cell_id, from 0 in the order of band and left edge."""
    d, v = bands(g), g.at(np.flatnonzero(g["upright"]))
    margin, tall = np.maximum(5.0, (d["x2"] - d["x1"]) * 0.025), d["y2"] - d["y1"]
    slack = np.maximum(5.0, np.minimum(10.0, tall * 0.1))
    band, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, k in pairs(d.gid, v.gid):
        spans = (v["x1"][k] >= d["x1"][i] - margin[i]) & (v["x1"][k] <= d["x2"][i] + margin[i]) & (tall[i] - (np.minimum(d["y2"][i], v["y2"][k]) - np.maximum(d["y1"][i], v["y1"][k])) <= slack[i])
        band.append(i[spans])
        at.append(v["x1"][k[spans]])
    band, at = np.concatenate(band), np.concatenate(at).astype(np.int64)
    order = np.lexsort((at, band))
    band, at = band[order], at[order]
    on = np.flatnonzero(band[1:] == band[:-1])
    b = band[on]
    out = Groups(d.gid[b], {"x1": at[on], "y1": d["y1"][b], "x2": at[on + 1], "y2": d["y2"][b], "band_x1": d["x1"][b], "band_x2": d["x2"][b]})
    out = out.at(np.lexsort((out["x1"], -out["y1"], out["y2"], out["band_x2"], out["band_x1"], out.gid)))
    first = np.searchsorted(out.gid, out.gid, "left")
    return Groups(out.gid, out.cols | {"cell_id": np.arange(len(first)) - first})


def _edges(g: Groups, low: int | None = None) -> tuple:
    """A group's edges of x and y, and how many slots lie between them. With ``low``, coordinates below it count as it."""
    x1, y1, x2, y2 = box = [g[c] if low is None else np.maximum(g[c], low) for c in BOX]
    xs, ys = edges(g.gid, x1, x2), edges(g.gid, y1, y2)
    return box, xs, ys, np.maximum(np.diff(xs.start) - 1, 0) * np.maximum(np.diff(ys.start) - 1, 0)


def _filled(g: Groups, low: int | None = None) -> tuple:
    """The edges, the strips that each cell covers, where a group's slots begin, and for each slot the smallest cell (of equals the first) that covers it, or -1."""
    (x1, y1, x2, y2), xs, ys, size = _edges(g, low)
    start, wide = np.concatenate(([0], np.cumsum(size))), np.diff(xs.start) - 1
    c1, c2, r1, r2 = xs.place(g.gid, x1), xs.place(g.gid, x2), ys.place(g.gid, y1), ys.place(g.gid, y2)
    order = np.lexsort((g["cell_id"], (g["x2"] - g["x1"]) * (g["y2"] - g["y1"])))[::-1]
    f = order[((c1 < c2) & (r1 < r2))[order]]
    owner, across = np.full(start[-1], -1, np.int64), c2 - c1
    at = np.cumsum(across[f] * (r2 - r1)[f]) // 2_000_000
    for part in np.split(f, np.flatnonzero(np.diff(at)) + 1):
        i, k = expanded(across[part] * (r2 - r1)[part])
        f = part[i]
        owner[start[g.gid[f]] + (r1[f] + k // across[f]) * wide[g.gid[f]] + c1[f] + k % across[f]] = f  # the smallest is written last
    return xs, ys, r1, r2, start, owner


def uncovered(g: Groups) -> Groups:
    """Cells that are the smallest one over some slot, right of and below 0."""

    def of(g: Groups) -> Groups:
        owner = _filled(g, 0)[-1]
        return g.at(np.unique(owner[owner >= 0]))

    return joined([of(p) for p in split(g, _edges(g, 0)[-1])] or [g])


def slots(g: Groups) -> Groups:
    """row_id, col_id and the box that fills the slot, as ``grid.to_grid`` says. At once, about ``PAIRS`` slots or a table."""
    return joined([_slots(p) for p in split(g, _edges(g)[-1])] or [_slots(g)])


def _slots(g: Groups) -> Groups:
    xs, ys, r1, r2, start, owner = _filled(g)
    wide, tall = np.diff(xs.start) - 1, np.diff(ys.start) - 1
    own, k = expanded(np.diff(start))
    row, col = k // wide[own], k % wide[own]
    bare = np.flatnonzero(owner < 0)
    out = {c: g[c][owner] if len(g.gid) else owner for c in BOX}
    if len(bare):
        b, r, c = own[bare], row[bare], col[bare]
        left, right = xs.value[xs.start[b] + c], xs.value[xs.start[b] + c + 1]
        out["y1"][bare], out["y2"][bare] = ys.value[ys.start[b] + r], ys.value[ys.start[b] + r + 1]
        out["x1"][bare], out["x2"][bare] = left, right
        rows = np.concatenate(([0], np.cumsum(np.maximum(tall, 0))))
        i, n = expanded(np.maximum(r2 - r1, 0))
        strip = rows[g.gid[i]] + r1[i] + n
        order = np.argsort(strip, kind="stable")
        cell, strip = i[order], strip[order]
        for s, m in pairs(rows[b] + r, strip):  # bare slots rise by table and row
            e = cell[m]
            far = lambda x: np.minimum(np.abs(x - left[s]), np.abs(x - right[s]))
            f1, f2 = far(g["x1"][e]), far(g["x2"][e])
            order = np.lexsort((g["cell_id"][e], np.minimum(f1, f2), s))
            best = order[changed(s[order])]
            at = bare[s[best]]
            out["x1"][at] = out["x2"][at] = np.where(f1 <= f2, g["x1"][e], g["x2"][e])[best]
    return Groups(own, {"row_id": row, "col_id": col, **out})


def spans(g: Groups) -> Groups:
    """Slots of one box as one cell: row_id, col_id, rowspan, colspan, box."""
    order = np.lexsort((*(g[c] for c in BOX), g.gid))
    at = np.flatnonzero(changed(*(c[order] for c in (g.gid, *(g[c] for c in BOX)))))
    if not len(at):
        return Groups(g.gid, g.cols | {"rowspan": g.gid, "colspan": g.gid})
    r, c = g["row_id"][order], g["col_id"][order]
    r1, r2, c1, c2 = np.minimum.reduceat(r, at), np.maximum.reduceat(r, at), np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
    one = g.at(order[at])
    return Groups(one.gid, {"row_id": r1, "col_id": c1, "rowspan": r2 - r1 + 1, "colspan": c2 - c1 + 1, **{k: one[k] for k in BOX}})


def snapped(g: Groups) -> Groups:
    """Cells with their edges at the nearest delimiter, the rounded mean of edges closer than 2 % of the table, 10 pixels at most; empty ones go."""
    out = {}
    for a in ("x", "y"):
        e = edges(g.gid, g[f"{a}1"], g[f"{a}2"])
        near = np.minimum((e.value[e.start[1:] - 1] - e.value[e.start[:-1]]) * 0.02, 10.0)
        new = np.ones(len(e.gid), bool)
        new[1:] = (e.gid[1:] != e.gid[:-1]) | (np.diff(e.value) >= near[e.gid[1:]])
        at = np.flatnonzero(new)
        mean = np.rint(np.add.reduceat(e.value, at).astype(float) / np.diff(np.append(at, len(new)))).astype(np.int64) if len(at) else e.value
        d = edges(e.gid[at], mean)
        low = d.value.min() if len(d.value) else 0
        step = (max(d.value.max(), e.value.max()) - min(low, e.value.min()) + 1) if len(d.value) else 1
        flat = d.gid * step + (d.value - low)
        for side in ("1", "2"):
            v = g[a + side]
            after = np.clip(np.searchsorted(flat, g.gid * step + (v - low)), d.start[g.gid], d.start[g.gid + 1] - 1)  # the first delimiter at or behind, or the last one
            before = np.maximum(after - 1, d.start[g.gid])
            out[a + side] = np.where(np.abs(d.value[before] - v) <= np.abs(d.value[after] - v), d.value[before], d.value[after])
    kept = (out["x2"] > out["x1"]) & (out["y2"] > out["y1"])
    return Groups(g.gid, {"cell_id": g["cell_id"], **out}).at(np.flatnonzero(kept))


def once(g: Groups) -> Groups:
    """Of slots with equal boxes the first, by row and column."""
    order = np.lexsort((g["col_id"], g["row_id"], *(g[c] for c in BOX), g.gid))
    new = changed(*(c[order] for c in (g.gid, *(g[c] for c in BOX))))
    return g.at(np.sort(order[new]))


def place(cells: Groups, texts: Groups, share: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Texts and the first cell, by row and column, that holds each. A cell that holds over half of a text box has its middle, so they meet in the slots between the cells' edges."""
    xs, ys = edges(cells.gid, cells["x1"], cells["x2"]), edges(cells.gid, cells["y1"], cells["y2"])
    wide, tall = np.diff(xs.start) - 1, np.diff(ys.start) - 1
    start = np.concatenate(([0], np.cumsum(np.maximum(wide, 0) * np.maximum(tall, 0))))
    t = np.flatnonzero(texts.gid < len(wide))
    r, c = ys.strip(texts.gid[t], texts["y1"][t] + texts["y2"][t]), xs.strip(texts.gid[t], texts["x1"][t] + texts["x2"][t])
    fits = (r >= 0) & (r < tall[texts.gid[t]]) & (c >= 0) & (c < wide[texts.gid[t]])
    t, r, c = t[fits], r[fits], c[fits]
    slot = start[texts.gid[t]] + r * wide[texts.gid[t]] + c
    order = np.argsort(slot, kind="stable")
    t, slot = t[order], slot[order]
    c1, c2, r1, r2 = xs.place(cells.gid, cells["x1"]), xs.place(cells.gid, cells["x2"]), ys.place(cells.gid, cells["y1"]), ys.place(cells.gid, cells["y2"])
    across = np.maximum(c2 - c1, 0)
    i, k = expanded(across * np.maximum(r2 - r1, 0))
    covers = start[cells.gid[i]] + (r1[i] + k // across[i]) * wide[cells.gid[i]] + c1[i] + k % across[i]
    order = np.argsort(covers, kind="stable")
    i, covers = i[order], covers[order]
    found = [np.zeros((2, 0), np.int64)]
    for a, b in pairs(slot, covers):
        a, b = t[a], i[b]
        w = np.minimum(texts["x2"][a], cells["x2"][b]) - np.maximum(texts["x1"][a], cells["x1"][b])
        h = np.minimum(texts["y2"][a], cells["y2"][b]) - np.maximum(texts["y1"][a], cells["y1"][b])
        wholly = (cells["x1"][b] <= texts["x1"][a]) & (cells["y1"][b] <= texts["y1"][a]) & (cells["x2"][b] >= texts["x2"][a]) & (cells["y2"][b] >= texts["y2"][a])
        inside = (w > 0) & (h > 0) & (wholly | (w * h >= share * ((texts["x2"] - texts["x1"]) * (texts["y2"] - texts["y1"]))[a]))
        a, b = a[inside], b[inside]
        order = np.lexsort((cells["col_id"][b], cells["row_id"][b], a))
        found.append(np.array([a, b])[:, order][:, changed(a[order])])
    return tuple(np.concatenate(found, 1))


def placed(g: Groups) -> Groups:
    """Of lines and texts: the slot of each text."""
    texts, grid = g.at(np.flatnonzero(g["is_text"])), once(slots(cells(g)))
    t, c = place(grid, texts)
    order = np.argsort(t, kind="stable")
    t, c = t[order], c[order]
    return Groups(texts.gid[t], {"id": texts["id"][t], "row_id": grid["row_id"][c], "col_id": grid["col_id"][c]})


def contents(g: Groups) -> Groups:
    """Of lines and texts: cells with spans, and the texts in each by line and left edge, parted by a space where they are apart or on another line."""
    texts, own = g.at(np.flatnonzero(g["is_text"])), spans(slots(cells(g)))
    t, c = place(own, texts)
    order = np.lexsort((texts["id"][t], texts["x1"][t], texts["y1"][t], c))
    t, c = t[order], c[order]
    space = np.zeros(len(t), bool)
    space[1:] = (c[1:] == c[:-1]) & ((np.abs(texts["x1"][t[1:]] - texts["x2"][t[:-1]]) >= 5) | (texts["y2"][t[:-1]] < texts["y1"][t[1:]]))
    text = texts["text"].take(pa.array(t))
    parts = pc.binary_join_element_wise(pc.if_else(pc.and_(pa.array(space), pc.is_valid(text)), " ", ""), pc.fill_null(text, ""), "")
    starts = np.searchsorted(c, np.arange(len(own.gid) + 1)).astype(np.int32)
    return Groups(own.gid, own.cols | {"content": pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), parts), "")})


def blanks(g: Groups, least_width: float, share: float, level: bool = False) -> Groups:
    """Of elements (box, and of their bounds ``b_x1``, ``b_x2`` (``b_y1``, ``b_y2`` for level ones), ``least``): blanks as ``whitespace.blanks`` says."""
    a, b, c, d = ("y1", "x1", "y2", "x2") if level else BOX
    n = int(g.gid[-1]) + 1 if len(g.gid) else 0
    first = np.searchsorted(g.gid, np.arange(n))
    if not n:
        return Groups(g.gid, {k: g[k] for k in BOX})
    lo, hi = np.minimum.reduceat(g[b], first), np.maximum.reduceat(g[d], first)
    every = [np.concatenate((g.gid, np.arange(n), np.arange(n))), *(np.concatenate((g[e], *m)) for e, m in ((a, (g["b_" + a][first],) * 2), (c, (g["b_" + c][first],) * 2), (b, (lo, hi)), (d, (lo, hi))))]
    gid, x1, x2, y1, y2 = (v[every[1] < every[2]] for v in every)
    xs = edges(every[0], every[1], every[2])
    c1, c2 = xs.place(gid, x1), xs.place(gid, x2)
    i, k = expanded(c2 - c1)
    strip = xs.start[gid[i]] + c1[i] + k
    wide = xs.value[strip + 1] - xs.value[strip] >= least_width
    i, strip = i[wide], strip[wide]
    order = np.lexsort((-y2[i], y1[i], strip))
    i, strip = i[order], strip[order]
    new = changed(strip, y1[i])
    i, strip = i[new], strip[new]
    low = y2[i].min() if len(i) else 0
    step = (y2[i].max() - low + 1) if len(i) else 1
    reach = np.maximum.accumulate(strip * step + (y2[i] - low)) - strip * step + low
    on = np.flatnonzero(strip[1:] == strip[:-1])  # a strip's second and later ones, less one
    strip, top, end = strip[on + 1], reach[on], y1[i[on + 1]]
    of = xs.gid[strip]
    fits = (end - top >= g["least"][first][of]) & (end > top) & ((end - top) * 100 >= round(100 * share) * (hi - lo)[of])
    strip, top, end, of = strip[fits], top[fits], end[fits], of[fits]
    order = np.lexsort((strip, end, top, of))
    strip, top, end, of = strip[order], top[order], end[order], of[order]
    new = changed(of, top, end)
    new[1:] |= strip[1:] != strip[:-1] + 1
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(new))[: len(at)] - 1
    return Groups(of[at], {a: xs.value[strip[at]], b: top[at], c: xs.value[strip[last] + 1], d: end[at]})


def tallest(s: Groups) -> Groups:
    """Blanks without those that share an upright edge and a stretch of y with a taller one."""
    gone = np.zeros(len(s.gid), bool)
    for a, b in pairs(s.gid, s.gid):
        x = (s["x1"][a] == s["x1"][b]) | (s["x1"][a] == s["x2"][b]) | (s["x2"][a] == s["x1"][b]) | (s["x2"][a] == s["x2"][b])
        y = np.minimum(s["y2"][a], s["y2"][b]) > np.maximum(s["y1"][a], s["y1"][b])
        gone[a[x & y & (s["y2"][a] - s["y1"][a] < s["y2"][b] - s["y1"][b])]] = True
    return s.at(np.flatnonzero(~gone))


def apart(s: Groups, g: Groups) -> Groups:
    """``borderless.dedup_whitespace``: of blanks that share an edge and a stretch of y, with no element between, the taller stays; equally tall ones become one."""
    s = s.at(np.lexsort((s["y2"], s["x2"], s["y1"], s["x1"], s.gid)))
    gone, x1, x2 = np.zeros(len(s.gid), bool), s["x1"].copy(), s["x2"].copy()
    tall = s["y2"] - s["y1"]
    for a, b in pairs(s.gid, s.gid):
        meet = ((s["x2"][a] == s["x1"][b]) | (s["x2"][b] == s["x1"][a])) & (np.minimum(s["y2"][a], s["y2"][b]) > np.maximum(s["y1"][a], s["y1"][b])) & (a != b)
        a, b = a[meet], b[meet]
        left, right, top, end = np.minimum(s["x1"][a], s["x1"][b]), np.maximum(s["x2"][a], s["x2"][b]), np.maximum(s["y1"][a], s["y1"][b]), np.minimum(s["y2"][a], s["y2"][b])
        parted = np.zeros(len(a), bool)
        for p, e in pairs(s.gid[a], g.gid):
            parted[p[(g["x1"][e] < right[p]) & (g["x2"][e] > left[p]) & (g["y1"][e] < end[p]) & (g["y2"][e] > top[p])]] = True
        a, b = a[~parted], b[~parted]
        gone[a[(tall[a] < tall[b]) | ((tall[a] == tall[b]) & (a > b))]] = True
        twin = (tall[a] == tall[b]) & (a < b)
        np.minimum.at(x1, a[twin], s["x1"][b[twin]])
        np.maximum.at(x2, a[twin], s["x2"][b[twin]])
    return Groups(s.gid, {"x1": x1, "y1": s["y1"], "x2": x2, "y2": s["y2"]}).at(np.flatnonzero(~gone))


def undotted(g: Groups, least: int, share: float) -> Groups:
    """Components of which less than a quarter lies in a dotted line, as ``glyphs.dotted_lines`` says."""
    wide, tall = g["x2"] - g["x1"], g["y2"] - g["y1"]
    gone = np.zeros(len(g.gid), bool)
    for long, thick, low, high in ((wide, tall, "y1", "y2"), (tall, wide, "x1", "x2")):
        i = np.flatnonzero(long >= 2 * thick)
        m = (g[low] + g[high]) // 2
        i = i[np.lexsort((m[i], g.gid[i]))]
        if not len(i):
            continue
        new = changed(g.gid[i])
        new[1:] |= np.diff(m[i]) > 2
        at = np.flatnonzero(new)
        n, length = np.diff(np.append(at, len(i))), np.add.reduceat(long[i], at)
        x1, y1, x2, y2 = (f.reduceat(g[c][i], at) for f, c in zip((np.minimum, np.minimum, np.maximum, np.maximum), BOX))
        whole = x2 - x1 if long is wide else y2 - y1
        d = np.flatnonzero((n >= least) & (length * 100 >= np.maximum(whole, 1) * round(100 * share)))
        of = g.gid[i][at]
        for k, a in pairs(of[d], g.gid):
            k = d[k]
            met = np.maximum(np.minimum(x2[k], g["x2"][a]) - np.maximum(x1[k], g["x1"][a]), 0) * np.maximum(np.minimum(y2[k], g["y2"][a]) - np.maximum(y1[k], g["y1"][a]), 0)
            gone[a[met * 4 >= wide[a] * tall[a]]] = True
    return g.at(np.flatnonzero(~gone))


def parting(g: Groups, char: int, line_sep: int, share: float) -> Groups:
    """Of areas (elements with their area's box ``ax1`` ...): the blanks that part columns and the margins, as ``whitespace.area_blanks`` says."""
    n = int(g.gid[-1]) + 1 if len(g.gid) else 0
    first = np.searchsorted(g.gid, np.arange(n))
    known = Groups(g.gid, g.cols | {f"b_{c}": g[f"a{c}"] for c in BOX} | {"least": np.minimum(line_sep, g["ay2"] - g["ay1"])})
    s = apart(tallest(blanks(known, char, share)), known)
    if not n:
        return Groups(s.gid, s.cols | {"top": s.gid > 0, "bottom": s.gid > 0})
    a = {c: g[f"a{c}"][first] for c in BOX}
    left, right = np.minimum.reduceat(g["x1"], first), np.maximum.reduceat(g["x2"], first)
    of, tall, wide = s.gid, s["y2"] - s["y1"], s["x2"] - s["x1"]
    inner = (s["x1"] != a["x1"][of]) & (s["x2"] != a["x2"][of])
    most = np.full(n, -1)
    np.maximum.at(most, of[inner], tall[inner])
    beside = lambda lo, hi: (np.minimum(s["x2"], hi[of]) - np.maximum(s["x1"], lo[of])) * 10 < wide
    top, bottom = s["y1"] == a["y1"][of], s["y2"] == a["y2"][of]
    kept = (most[of] >= 0) & beside(a["x1"], left) & beside(right, a["x2"]) & (top | bottom | (tall * 100 >= most[of] * 66))
    fit = np.flatnonzero(most >= 0)
    yes = np.ones(len(fit), bool)
    parts = [Groups(s.gid, s.cols | {"top": top, "bottom": bottom}).at(np.flatnonzero(kept))]
    for lo, hi in ((a["x1"], left), (right, a["x2"])):
        parts.append(Groups(fit, {"x1": lo[fit], "y1": a["y1"][fit], "x2": hi[fit], "y2": a["y2"][fit], "top": yes, "bottom": yes}))
    return joined(parts)
