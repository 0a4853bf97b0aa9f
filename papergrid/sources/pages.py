"""Where pages come from: images, files with a decoder of one's own, and layout services."""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.raster import gray_of_images
from ..ship import map_arrow

LAYOUT_SCHEMA = "page int, label string, confidence double, x1 int, y1 int, x2 int, y2 int"
TEXT_SCHEMA = "page int, box_id int, x1 int, y1 int, x2 int, y2 int, text string"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pages (origin, width, height, pixels) of an image folder; unreadable files are left out."""
    return gray_of_images(spark.read.format("image").option("dropInvalid", True).load(path))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def decoded(files: DataFrame, decode: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows that a decoder (for PDF, optical recognition, a model) makes of each file: path, then its own columns. One file at a time is in memory."""
    out = _parse_datatype_string(schema)
    full = StructType([files.schema["path"], *out.fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = [(path, *r) for r in decode(path, content or b"")]
                cols = list(zip(*rows)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return map_arrow(files.select("path", "content"), run, full)


@dataclass(frozen=True)
class LayoutService:
    """An HTTP service that finds layout objects; the request is a multipart upload of the file."""

    url: str
    timeout: float
    dpi: int = 300
    confidence: float = 0.3

    def __call__(self, path: str, content: bytes) -> list[tuple]:
        mark = uuid.uuid4().hex
        field = lambda name, value: f'--{mark}\r\nContent-Disposition: form-data; name="{name}"\r\n\r\n{value}\r\n'.encode()
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{path.rsplit("/", 1)[-1]}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode()
        body = field("dpi", self.dpi) + field("confidence", self.confidence) + head + content + f"\r\n--{mark}--\r\n".encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": f"multipart/form-data; boundary={mark}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return layout_rows(json.load(answer))


# A document category's service (port and path on the local host) and its timeout in seconds.
SERVICES = {"slide": (8000, "/detect", 900), "academic": (8999, "/detect", 900), "document": (8099, "/detect", 900), "page": (8099, "/detect_image", 120), "full": (8099, "/doc-layout", 900)}


def service_for(category: str, host: str = "localhost") -> LayoutService:
    """The category's service; unknown ones get that for slides."""
    port, path, timeout = SERVICES.get((category or "").lower(), SERVICES["slide"])
    return LayoutService(f"http://{host}:{port}{path}", timeout)


def layout_rows(answer: dict) -> list[tuple]:
    """A service's answer as rows of ``LAYOUT_SCHEMA``; an answer for one image has no page, which counts as 1."""
    results = answer.get("results", answer)
    rows = []
    for r in results if isinstance(results, list) else [results]:
        for o in r.get("objects") or ():
            x1, y1, x2, y2 = (int(v) for v in o["bbox"])
            rows.append((int(r.get("page") or 1), o.get("label"), float(o["confidence"]) if o.get("confidence") is not None else None, x1, y1, x2, y2))
    return rows


def detect_layout(files: DataFrame, service: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    return decoded(files, service, LAYOUT_SCHEMA)
