"""Pixels of drawn pages."""

import numpy as np

from papergrid.operators import inked as I
from papergrid.operators import raster as R


def letters(mask, x, y, n, w=6, h=10, gap=3):
    """n hollow characters from (x, y) on."""
    for i in range(n):
        a = x + i * (w + gap)
        mask[y : y + h, a : a + w] = True
        mask[y + 2 : y + h - 2, a + 2 : a + w - 2] = False


def drawn():
    mask = np.zeros((220, 400), bool)
    for row in range(5):
        letters(mask, 20, 30 + 30 * row, 6)
        letters(mask, 220, 30 + 30 * row, 8)
    mask[15:17, 10:390] = True
    mask[15:200, 10:12] = True
    return mask


def test_labels_are_the_components():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((25, 40)) < 0.35
        labels, parts = I.labelled(mask)
        assert sorted(parts) == sorted(R.components(mask)) and ((labels > 0) == mask).all()
        for k, (x1, y1, x2, y2, n) in enumerate(parts, 1):
            assert (labels == k).sum() == n and (labels[y1:y2, x1:x2] == k).sum() == n


def test_round_dots_go():
    mask = np.zeros((40, 80), bool)
    yy, xx = np.mgrid[:40, :80]
    mask |= (yy - 15) ** 2 + (xx - 15) ** 2 <= 49
    letters(mask, 40, 10, 2)
    assert sorted(b[0] for b in I.drop_dots(mask)) == [40, 49]


def test_metrics():
    size, sep, words = I.page_metrics(drawn())
    assert size == 6.0 and sep == 31.0
    assert (20, 30, 71, 40) in words and (220, 150, 289, 160) in words and len(words) == 10
    assert I.page_metrics(np.zeros((5, 5), bool)) == (11.0, None, [])


def test_ruled_lines_by_edges():
    gray = np.where(drawn(), 0, 255).astype(np.uint8)
    found = I.ruled_lines(gray, I.page_metrics(drawn())[2], 60)
    assert any(o == "h" and abs(y1 - 16) <= 2 and x2 - x1 > 300 for o, x1, y1, x2, _ in found)
    assert any(o == "v" and abs(x1 - 11) <= 2 and y2 - y1 > 150 for o, x1, y1, _, y2 in found)
    assert not any(30 < y1 < 160 for o, _, y1, _, _ in found if o == "h")
    assert I.ruled_lines(np.full((9, 9), 255, np.uint8), [], 3) == []


def test_obstacles():
    mask = np.zeros((50, 40), bool)
    mask[:, :10] = mask[:, 30:] = True
    strips = I.obstacles(mask, 8)
    assert strips[:, 10:30].all() and not strips[:, :10].any() and not strips[:, 30:].any()


def test_smoothing_joins_a_word_and_not_columns():
    mask = np.zeros((30, 120), bool)
    letters(mask, 5, 8, 4)
    letters(mask, 90, 8, 3)
    labels, parts = I.labelled(mask)
    boxes = sorted(b[:4] for b in R.components(I.adaptive_smooth(labels, parts, 1)))
    assert boxes == [(5, 8, 38, 18), (90, 8, 114, 18)]
    labels[:, 12:14] = -1
    assert len(R.components(I.adaptive_smooth(labels, parts, 1))) == 3


def test_text_mask_keeps_text():
    mask = drawn()
    lines = R.straight_lines(mask, 100)
    out = I.text_mask(mask, lines, 6.0, tables=[(210, 0, 400, 60)])
    assert out[35, 20:71].all() and not out[10:20, 100:300].any() and not out[30:45, 215:300].any() and not out[:, 120:200].any()


def test_pages(spark):
    mask = drawn()
    pages = spark.createDataFrame([(1, 400, 220, bytearray(R.packed(np.where(mask, 0, 255).astype(np.uint8)))), (2, 3, 3, bytearray(b"\xff" * 9))], "k int, width int, height int, pixels binary")
    assert {r.k: (r.char_milli, r.line_sep, r.n_words) for r in I.metrics_of_pages(pages, ["k"]).collect()} == {1: (6000, 31, 10), 2: (11000, None, 0)}
    assert {r.orient for r in I.lines_of_pages(pages, ["k"], 60).collect()} == {"h", "v"}
    assert I.text_of_pages(pages, ["k"]).where("k = 1").count() >= 10
