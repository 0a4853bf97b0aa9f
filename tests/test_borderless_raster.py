import struct
import zlib

import numpy as np

from papergrid.operators import borderless, raster
from papergrid.plans import extract
from papergrid.sources import pages
from papergrid.streaming import documents

K = ["k"]


def test_components_like_flood_fill():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.45, 0.6):
        mask = rng.random((23, 31)) < share
        left, want = mask.copy(), []
        for y, x in zip(*np.nonzero(mask)):
            if not left[y, x]:
                continue
            stack, seen = [(y, x)], []
            left[y, x] = False
            while stack:
                a, b = stack.pop()
                seen.append((a, b))
                for c in range(max(0, a - 1), min(23, a + 2)):
                    for d in range(max(0, b - 1), min(31, b + 2)):
                        if left[c, d]:
                            left[c, d] = False
                            stack.append((c, d))
            ys, xs = zip(*seen)
            want.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(seen)))
        assert sorted(raster.components(mask)) == sorted(want)
    assert raster.components(np.zeros((0, 0), bool)) == []


def test_runs_close_and_open():
    row = np.array([0, 1, 1, 0, 1, 0, 0, 0, 1], bool)
    assert raster.runs(row).tolist() == [[1, 3], [4, 5], [8, 9]]
    assert raster.runs(raster.close_runs(row, 1)).tolist() == [[1, 5], [8, 9]]
    assert raster.runs(raster.open_runs(row, 2)).tolist() == [[1, 3]]


def test_straight_lines():
    mask = np.zeros((60, 80), bool)
    mask[10:13, 5:70] = True
    mask[10:13, 30:32] = False  # a hole
    mask[5:50, 40] = True
    mask[30, 5:15] = True  # too short
    assert raster.straight_lines(mask, 30) == [("h", 5, 11, 70, 11), ("v", 40, 5, 40, 50)]


def test_ink_turns_dark_pages_round():
    page = np.full((40, 40), 230, np.uint8)
    page[18:22, 10:30] = 20
    a, b = raster.ink(page), raster.ink(255 - page)
    assert a[20, 10] and not a[2, 2] and (a == b).all()


def test_characters_and_clip():
    boxes = [(0, 0, 8, 12, 60), (10, 0, 18, 12, 50), (20, 0, 28, 12, 55), (0, 30, 200, 31, 200), (50, 50, 150, 150, 9000), (40, 5, 46, 7, 12)]
    assert raster.text_components(boxes) == boxes[:3] + [boxes[5]]
    g = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert raster.clip(g, 1, -5, 3, 2).tolist() == [[1, 2], [5, 6]]
    assert raster.clip(g, 1, 0, 3, 1, keep_size=True).tolist() == [[255, 1, 2, 255], [255] * 4, [255] * 4]


def test_smoothing_joins_like_heights():
    mask = np.zeros((10, 30), bool)
    mask[2:8, 2:6] = mask[2:8, 8:12] = True
    mask[4:5, 15:17] = True
    out = raster.smooth(mask, 3)
    assert out[4, 6:8].all() and not out[4, 12:15].any()


def test_whitespace_and_tables(spark):
    ws = spark.createDataFrame([(1, 0, 0, 10, 100), (1, 10, 0, 20, 100), (1, 20, 50, 30, 90), (1, 60, 0, 70, 10)], "k int, x1 int, y1 int, x2 int, y2 int")
    assert {tuple(r) for r in borderless.dedup_whitespace(ws, K).collect()} == {(1, 0, 0, 20, 100), (1, 60, 0, 70, 10)}
    elements = spark.createDataFrame([(1, 5, 10, 15, 20)], "k int, x1 int, y1 int, x2 int, y2 int")
    assert {tuple(r) for r in borderless.dedup_whitespace(ws, K, elements).collect()} == {(1, 0, 0, 10, 100), (1, 10, 0, 20, 100), (1, 60, 0, 70, 10)}
    ts = spark.createDataFrame([(1, 0, 0, 0, 100, 100), (1, 1, 50, 50, 60, 60), (1, 2, 95, 0, 300, 20), (1, 3, 500, 500, 600, 600)], "k int, id int, x1 int, y1 int, x2 int, y2 int")
    assert [r.id for r in borderless.dedup_tables(ts, K, "id").orderBy("pos").collect()] == [0, 3, 2]


def _texts(spark):
    words = [(1, 0, "a", 10, 10), (1, 1, "b", 110, 10), (1, 2, "c", 260, 10), (1, 3, "d", 10, 50), (1, 4, "e", 110, 50), (1, 5, "f", 260, 50), (2, 6, "x", 0, 0)]
    return spark.createDataFrame([(k, i, x, y, x + 16, y + 16, t) for k, i, t, x, y in words], "k int, text_id int, x1 int, y1 int, x2 int, y2 int, text string")


def test_tables_with_and_without_lines(spark):
    texts = _texts(spark)
    none = spark.createDataFrame([], "k int, orient string, x1 int, y1 int, x2 int, y2 int")
    got = extract.filled_tables(none, texts, K, line_sep=20).orderBy("row_id", "col_id").collect()
    assert [r.content for r in got] == list("abcdef") and all(r.borderless and r.k == 1 for r in got)
    ruled = [(1, "h", 0, y, 400, y) for y in (0, 40, 80)] + [(1, "v", x, 0, x, 80) for x in (0, 100, 250, 400)]
    lines = spark.createDataFrame(ruled, "k int, orient string, x1 int, y1 int, x2 int, y2 int")
    got = extract.filled_tables(lines, texts, K).orderBy("row_id", "col_id").collect()
    assert [r.content for r in got] == list("abcdef") and not any(r.borderless for r in got)
    assert extract.tables_as_html(lines, texts, K).first().html.count("<td>") == 3


def test_document(spark):
    objects = [(1, 0, 0, "text", 50, 0, 100, 200, 200), (1, 0, 1, "doc_title", 90, 0, 0, 200, 40), (1, 0, 2, "text", 40, 1, 101, 201, 201), (1, 0, 3, "seal", 90, 300, 300, 400, 400)]
    words = [(1, 0, 0, 0, "Title", 10, 10), (1, 0, 5, 0, "A", 10, 110), (1, 0, 5, 1, "line.", 30, 110), (1, 0, 6, 0, "More", 10, 130)]
    o = spark.createDataFrame(objects, "doc int, page int, obj_id int, label string, confidence_pct int, x1 int, y1 int, x2 int, y2 int")
    w = spark.createDataFrame([(*r[:5], r[5], r[6], r[5] + 16, r[6] + 16) for r in words], "doc int, page int, line_no int, word_no int, text string, x1 int, y1 int, x2 int, y2 int")
    got = extract.document(o, w, ["doc", "page"], ["doc"], "page").collect()
    assert [(r.doc, r.n_chunks) for r in got] == [(1, 2)]
    assert got[0].markdown.startswith("# Title\n\n\n") and "A line." in got[0].markdown and "More" in got[0].markdown


def png(gray):
    h, w = gray.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + gray[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_image_source(spark, tmp_path):
    page = np.full((50, 90), 255, np.uint8)
    page[20:22, 10:80] = 0
    (tmp_path / "a.png").write_bytes(png(page))
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = pages.read_images(spark, str(tmp_path))
    row = got.first()
    assert got.count() == 1 and (row.width, row.height) == (90, 50) and (raster.unpacked(bytes(row.pixels), 50, 90) == page).all()
    assert [tuple(r)[1:] for r in raster.page_lines(got, ["origin"], 30).collect()] == [("h", 10, 20, 80, 20)]


def test_layout_answers():
    answer = {"results": [{"page": 2, "objects": [{"label": "table", "confidence": 0.5, "bbox": [1.9, 2, 3, 4]}]}, {"objects": [{"label": "text", "bbox": [0, 0, 1, 1]}]}]}
    assert pages.layout_rows(answer) == [(2, "table", 0.5, 1, 2, 3, 4), (1, "text", None, 0, 0, 1, 1)]
    assert pages.layout_rows({"results": {"objects": []}}) == []
    assert pages.service_for("Academic").url.endswith(":8999/detect") and pages.service_for(None).url.endswith(":8000/detect") and pages.service_for("page").timeout == 120


def _words(path, content):
    return [(1, i, 8 * i, 0, 8 * i + 4, 16, w) for i, w in enumerate(content.decode().split())]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one two")
    (tmp_path / "in" / "b.txt").write_text("")
    rows = pages.decoded(pages.read_files(spark, str(tmp_path / "in"), "*.txt"), _words, pages.TEXT_SCHEMA)
    assert sorted(r.text for r in rows.collect()) == ["one", "two"]
    stream = documents.new_files(spark, str(tmp_path / "in"), "*.txt")
    q = documents.process_stream(stream, _words, pages.TEXT_SCHEMA, lambda df: df.groupBy("path").count(), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_two_borderless_tables_on_a_page(spark):
    """Under a title over the whole width, and parted by a paragraph; their columns differ."""
    from papergrid.plans.extract import borderless_tables

    rows = [(1, 0, 0, 0, 390, 16)]
    for table, (top, columns) in enumerate(((40, (0, 150, 300)), (260, (0, 100, 200, 300)))):
        for r in range(4):
            rows += [(1, 100 * table + 10 * r + c + 1, x, top + 30 * r, x + 60, top + 30 * r + 16) for c, x in enumerate(columns)]
    rows.append((1, 999, 0, 190, 385, 206))
    texts = spark.createDataFrame(rows, "k int, text_id int, x1 int, y1 int, x2 int, y2 int")
    got = borderless_tables(texts, ["k"], 20, 8, 24).collect()
    sizes = sorted({(min(r.y1 for r in got if r.table_ord == t), max(r.row_id for r in got if r.table_ord == t) + 1, max(r.col_id for r in got if r.table_ord == t) + 1) for t in {r.table_ord for r in got}})
    assert [s[1:] for s in sizes] == [(4, 3), (4, 4)]
