"""What a page's pixels tell before there are boxes: labelled components, round dots, ruled lines by edges, blank strips, smoothing, where text is, character size.

numpy on one page at a time; ``raster.map_pages`` deals the pages. A mask is a
matrix of true where there is ink.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .raster import components, map_pages, runs, straight_lines, text_components

Part = tuple[int, int, int, int, int]


def labelled(mask: np.ndarray) -> tuple[np.ndarray, list[Part]]:
    """Each pixel's component (from 1; 0 is blank), and the components' boxes and areas, by number."""
    root, spans, above = [0], [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for y in range(mask.shape[0]):
        here = []
        for a, b in runs(mask[y]).tolist():
            n = len(root)
            root.append(n)
            for p, q, m in above:
                if p <= b and q >= a:
                    low, high = sorted((find(m), find(n)))
                    root[high] = low
            here.append((a, b, n))
            spans.append((y, a, b, n))
        above = here
    number, out, parts = {}, np.zeros(mask.shape, np.int32), []
    for y, a, b, n in spans:
        k = number.setdefault(find(n), len(number) + 1)
        out[y, a:b] = k
        if k > len(parts):
            parts.append((a, y, b, y + 1, b - a))
        else:
            x1, y1, x2, y2, size = parts[k - 1]
            parts[k - 1] = (min(x1, a), y1, max(x2, b), y + 1, size + b - a)
    return out, parts


def holes(own: np.ndarray) -> int:
    """Blank pixels between the first and last ink of rows and of columns."""
    between = lambda m: int((np.maximum.accumulate(m, 1) & np.maximum.accumulate(m[:, ::-1], 1)[:, ::-1] & ~m).sum())
    return between(own) + between(own.T)


def drop_dots(mask: np.ndarray) -> list[Part]:
    """Components but for filled round ones: at most a tenth of holes a pixel, seven tenths of the circle around them filled."""
    labels, parts = labelled(mask)
    kept = []
    for k, (x1, y1, x2, y2, size) in enumerate(parts, 1):
        round_ = 4 * size / (np.pi * max(x2 - x1, y2 - y1) ** 2)
        if not (holes(labels[y1:y2, x1:x2] == k) / (2 * size) <= 0.1 and round_ >= 0.7):
            kept.append((x1, y1, x2, y2, size))
    return kept


def edges(gray: np.ndarray) -> np.ndarray:
    """The size of the second difference over a pixel's eight neighbours."""
    g = np.pad(gray.astype(np.int32), 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray.astype(np.int32), 1, mode="edge")
    corners = g[:-2, :-2] + g[:-2, 2:] + g[2:, :-2] + g[2:, 2:]
    return np.minimum(np.abs(2 * corners - 8 * g[1:-1, 1:-1]), 255).astype(np.uint8)


def ruled_lines(gray: np.ndarray, texts: list[Part], least: int) -> list[tuple[str, int, int, int, int]]:
    """Straight lines among the edges that are strong (over two and a half times the mean) and not of text boxes."""
    e = edges(gray) if gray.size else gray
    for x1, y1, x2, y2, *_ in texts:
        e[max(0, y1 - 1) : y2 + 1, max(0, x1 - 1) : x2 + 1] = 0
    if not e.any():
        return []
    return straight_lines(e > min(2.5 * e.mean(), float(e.max()) - 1), least)


def obstacles(mask: np.ndarray, wide: int) -> np.ndarray:
    """Upright blank strips ``wide`` pixels across and taller than a fifth of the page."""
    h, w = mask.shape
    out = np.zeros(mask.shape, bool)
    sums = np.concatenate((np.zeros((h, 1), np.int64), mask.cumsum(1)), 1)
    for x in range(max(0, w - wide)):
        for a, b in runs(sums[:, x + wide] == sums[:, x]):
            if b - a > h // 5:
                out[a:b, x : x + wide] = True
    return out


def adaptive_smooth(labels: np.ndarray, parts: list[Part], far: float, ratio: float = 3.5, overlap: float = 0.4) -> np.ndarray:
    """Holes along rows filled: within a component, and between two of like height (``ratio``) that overlap in y (``overlap`` of the smaller)
    and are at most ``far`` times the smaller height apart, with no third within two rows between them. A label of -1 ends what is before it."""
    out = labels > 0
    h = labels.shape[0]
    for y in range(h):
        at = np.flatnonzero(labels[y])
        for p, q in zip(at[:-1][np.diff(at) > 1], at[1:][np.diff(at) > 1]):
            a, b = int(labels[y, p]), int(labels[y, q])
            if a < 0 or b < 0:
                continue
            if a != b:
                (_, a1, _, a2, _), (_, b1, _, b2, _) = parts[a - 1], parts[b - 1]
                low, high = sorted((a2 - a1, b2 - b1))
                near = labels[max(0, y - 2) : y + 3, p + 1 : q]
                if q - p - 1 > far * low or high > ratio * low or min(a2, b2) - max(a1, b1) < overlap * low or not np.isin(near, (-1, 0, a, b)).all():
                    continue
            out[y, p:q] = True
    return out


def text_areas(mask: np.ndarray, smoothed: list[Part], char: float, usual_width: float) -> np.ndarray:
    """Where text is: components of the smoothed page that are dashes, or as tall as the mean (by area), or whose ink changes along rows (and columns, where taller) as writing does."""
    out = np.zeros(mask.shape, bool)
    mean = sum((y2 - y1) * n for _, y1, _, y2, n in smoothed) / max(1, sum(n for *_, n in smoothed))
    for x1, y1, x2, y2, _ in smoothed:
        w, h = x2 - x1, y2 - y1
        text = w >= 2 * h and 0.5 * usual_width <= w <= 1.5 * usual_width
        if not text and min(w, h) > 2 * char / 3:
            own = mask[y1:y2, x1:x2]
            starts = lambda m: int((np.diff(np.pad(m.astype(np.int8), ((0, 0), (1, 0))), axis=1) == 1).sum())
            cols = max(1, int(own.any(0).sum()))
            across, down = starts(own) / cols, starts(own.T) / cols
            usual = 0.8 * mean <= h <= 1.2 * mean
            text = usual or (h < 0.8 * mean and 1.2 < across < 3.5) or (h > 1.2 * mean and 1.2 < across < 3.5 and 1.2 < down < 3.5)
        if text:
            out[y1:y2, x1:x2] = True
    return out


def char_length(parts: list[Part]) -> float | None:
    """The usual width of characters: the most frequent one (the smallest of equals) if half as much again exceeds the mean, else the mean."""
    widths = [x2 - x1 for x1, _, x2, _, n in parts if n > 10]
    if not widths:
        return None
    counts = np.bincount(widths)
    mode, mean = int(counts.argmax()), float(np.mean(widths))
    return float(mode) if 1.5 * mode > mean else mean


def line_distance(boxes: list[tuple[int, ...]]) -> float | None:
    """The most frequent distance (odd, rounded up; the first seen of equals) of a box's middle to the nearest lower one that overlaps it in x, box by box."""
    seen: dict[int, int] = {}
    for i, (x1, y1, x2, y2, *_) in enumerate(boxes):
        below = [(b[1] + b[3] - y1 - y2) / 2 for j, b in enumerate(boxes) if j != i and min(x2, b[2]) > max(x1, b[0]) and b[1] + b[3] > y1 + y2]
        if below:
            d = 2 * int(min(below) // 2) + 1
            seen[d] = seen.get(d, 0) + 1
    return float(max(seen, key=seen.get)) if seen else None


def closed(mask: np.ndarray, wide: int, tall: int) -> np.ndarray:
    """The mask grown and shrunk again by a window."""

    def grown(m: np.ndarray, n: int) -> np.ndarray:
        before, after = n // 2, n - 1 - n // 2
        sums = np.concatenate((np.zeros((m.shape[0], 1), np.int64), np.pad(m, ((0, 0), (before, after))).cumsum(1)), 1)
        return sums[:, n:] > sums[:, :-n]

    out = mask
    for n, turn in ((wide, False), (tall, True)):
        m = out.T if turn else out
        m = ~grown(~np.pad(grown(m, n), ((0, 0), (n, n)), constant_values=True), n)[:, n:-n] if n > 1 and m.size else m
        out = m.T if turn else m
    return out | mask


def page_metrics(mask: np.ndarray, default: float = 11.0) -> tuple[float, float | None, list[tuple[int, int, int, int]]]:
    """Character length (``default`` on a page without characters), line distance, and the boxes of words."""
    parts = drop_dots(mask)
    chars = text_components(parts)
    size = char_length(chars)
    if size is None:
        return default, None, []
    near = [d for d in parts if d not in chars and any(_belongs(d, c, size) for c in chars)]
    every = chars + near
    shown = np.zeros(mask.shape, bool)
    for x1, y1, x2, y2, _ in every:
        shown[y1:y2, x1:x2] = mask[y1:y2, x1:x2]
    words = []
    for x1, y1, x2, y2, _ in components(closed(shown, int(size / 2 + 1), int(size / 3 + 1))):
        inside = [c for c in every if max(0, min(x2, c[2]) - max(x1, c[0])) * max(0, min(y2, c[3]) - max(y1, c[1])) * 2 >= (c[2] - c[0]) * (c[3] - c[1])]
        if inside:
            words.append((min(c[0] for c in inside), min(c[1] for c in inside), max(c[2] for c in inside), max(c[3] for c in inside)))
    return size, line_distance(words), words


def _belongs(piece: Part, char: Part, size: float) -> bool:
    (a1, b1, a2, b2, _), (c1, d1, c2, d2, _) = piece, char
    over = min(b2, d2) - max(b1, d1)
    far = min(abs(a1 - c1), abs(a1 - c2), abs(a2 - c1), abs(a2 - c2))
    return over > 0 and 2 * over >= min(b2 - b1, d2 - d1) and max(a2 - a1, b2 - b1) <= 3 * max(c2 - c1, d2 - d1) and far <= size


def text_mask(mask: np.ndarray, lines: list[tuple[str, int, int, int, int]], char: float, tables: list[tuple[int, int, int, int]] = ()) -> np.ndarray:
    """Pixels of text, smoothed to words: ruled lines and noise go, holes are filled within and between like components but not over tall blank strips; known tables are left out."""
    own = mask.copy()
    for orient, x1, y1, x2, y2 in lines:
        if (x2 - x1 if orient == "h" else y2 - y1) >= (3 if orient == "h" else 2) * char:
            own[max(0, y1 - 1) : y2 + 2, max(0, x1 - 1) : x2 + 2] = False
    own[:, 1:] |= own[:, :-1].copy()
    labels, parts = labelled(own)
    if not parts:
        return own
    height, width = float(np.mean([p[3] - p[1] for p in parts])), float(np.median([p[2] - p[0] for p in parts]))
    noise = [k for k, (x1, y1, x2, y2, n) in enumerate(parts, 1) if not (x2 - x1 >= 2 * (y2 - y1) and 0.5 * width <= x2 - x1 <= 1.5 * width) and ((y2 - y1) < height / 3 or n < 0.08 * (x2 - x1) * (y2 - y1))]
    labels[np.isin(labels, noise)] = 0
    strips = obstacles(adaptive_smooth(labels, parts, 1) | own, max(1, int(np.ceil(char))))
    labels[strips] = -1
    where = text_areas(own, components(adaptive_smooth(labels, parts, 5)), char, width)
    labels[~where] = -1
    out = adaptive_smooth(labels, parts, 1.25)
    for x1, y1, x2, y2 in tables:
        out[y1:y2, x1:x2] = False
    return out


def metrics_of_pages(pages: DataFrame, keys: list[str], below: int = 128) -> DataFrame:
    """Per page: char_milli (thousandths of a pixel), line_sep (null without lines), n_words."""

    def work(gray: np.ndarray) -> list[tuple]:
        size, sep, words = page_metrics(gray < below)
        return [(int(size * 1000), None if sep is None else int(sep), len(words))]

    return map_pages(pages, keys, work, "char_milli int, line_sep int, n_words int")


def lines_of_pages(pages: DataFrame, keys: list[str], least: int, below: int = 128) -> DataFrame:
    """Ruled lines of each page by its edges, away from its words."""
    return map_pages(pages, keys, lambda g: ruled_lines(g, page_metrics(g < below)[2], least), "orient string, x1 int, y1 int, x2 int, y2 int")


def text_of_pages(pages: DataFrame, keys: list[str], below: int = 128) -> DataFrame:
    """Boxes of smoothed text of each page."""

    def work(gray: np.ndarray) -> list[tuple]:
        mask = gray < below
        size, _, words = page_metrics(mask)
        return components(text_mask(mask, ruled_lines(gray, words, int(3 * size)), size))

    return map_pages(pages, keys, work, "x1 int, y1 int, x2 int, y2 int, area int")
