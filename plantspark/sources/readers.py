"""Readers that give plain tables. Paths may be in any store that Spark reads.

Files are found and split by Spark; whole files come in one row only where the format has to be
read whole (documents, XML). Broken files and rows are kept with a reason, not dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import plain_xml

#: File suffixes of images and procedures.
IMAGE_SUFFIXES = ("bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm")
PROCEDURE_SUFFIXES = ("docx", "txt", "md")

SOURCE_LINES = "path string, line_no long, style string, text string, error string"


def images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, suffix, length, content): image files below a folder; other suffixes are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    suffix = F.lower(F.regexp_extract("path", "\\.([^.]+)$", 1))
    return raw.withColumn("suffix", suffix).where(suffix.isin(*IMAGE_SUFFIXES)).select("path", "suffix", "length", "content")


def raster(content: DataFrame) -> DataFrame:
    """(path, height, width, pixels): plain PGM or PPM images (P5, P6) as grey bytes; others with null pixels."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np

        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                m = re.match(rb"(P[56])\s+(?:#.*\n)?(\d+)\s+(\d+)\s+255\s", data or b"")
                if not m:
                    rows.append((path, None, None, None))
                    continue
                w, h, depth = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
                p = np.frombuffer(data, np.uint8, w * h * depth, m.end()).reshape(h, w, depth)
                grey = p[:, :, 0] if depth == 1 else (p @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)
                rows.append((path, h, w, grey.tobytes()))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["path", "height", "width", "pixels"])

    return content.select("path", "content").mapInArrow(decoded, "path string, height int, width int, pixels binary")


def text_procedures(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, style, text) of text files: blank lines out, short lines in capitals are headings."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return styled(whole, F.col("value"))


def styled(whole: DataFrame, text: Column) -> DataFrame:
    """Lines of a text column with their style."""
    lines = whole.select("path", F.posexplode(F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n")).alias("line_no", "raw"))
    t = F.trim("raw")
    capital = (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) < 80)
    return lines.where(F.length(t) > 0).select("path", F.col("line_no").cast("long"), F.when(capital, "Heading 1").otherwise("Normal").alias("style"), t.alias("text"))


def docx_procedures(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, style, text, error) of word-processor files: paragraphs, then table cells.

    A file that can't be read gives one row with the error. XML that can't be parsed is stripped of its tags.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return raw.mapInArrow(_docx_lines, SOURCE_LINES)


def _docx_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io
    import re
    import xml.etree.ElementTree as ET
    import zipfile

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def paragraph(p) -> tuple[str, str]:
        style = p.find(f"{w}pPr/{w}pStyle")
        name = style.get(f"{w}val", "Normal") if style is not None else "Normal"
        return re.sub(r"^Heading(\d)$", r"Heading \1", name), "".join(t.text or "" for t in p.iter(f"{w}t")).strip()

    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows, error = [], None
            try:
                xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")
                try:
                    body = ET.fromstring(xml).find(f"{w}body")
                    rows = [paragraph(p) for p in body.findall(f"{w}p")] + [("Normal", paragraph(p)[1]) for c in body.iter(f"{w}tc") for p in c.iter(f"{w}p")]
                except (ET.ParseError, AttributeError):
                    plain = re.sub(r"<[^>]+>", "", re.sub(r"<w:p[ >]", "\n", xml.decode("utf-8", "replace")))
                    rows = [("Normal", x.strip()) for x in plain.split("\n")]
            except Exception as e:  # noqa: BLE001  any broken file is a row, not a lost job
                error = f"{type(e).__name__}: {e}"[:2000]
            found = [(path, i, s, t, None) for i, (s, t) in enumerate((s, t) for s, t in rows if t)] or [(path, None, None, None, error)]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=["path", "line_no", "style", "text", "error"])


def xml_text(rows: DataFrame, column: str) -> DataFrame:
    """The column's word-processor XML as plain text."""
    return rows.withColumn(column, plain_xml(F.col(column)))


def label_path(image: Column) -> Column:
    """An image's label file: the last folder 'images' becomes 'labels', the suffix '.txt'."""
    return F.regexp_replace(F.regexp_replace(image, "^(.*)/images/", "$1/labels/"), "\\.[^./]+$", ".txt")


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, cls, x, y, w, h, points, reason) of label files: boxes or polygons in shares of the image.

    Polygons (more than six fields) get the box around them. Rows that aren't legal have a reason; repeated rows stay.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = raw.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    f = F.transform(F.split(F.trim("line"), "\\s+"), lambda x: x.try_cast("double"))
    rows = lines.select("path", F.col("line_no").cast("long"), f.alias("f")).withColumn("points", F.when(F.size("f") > 6, F.slice("f", 2, F.size("f"))))
    odd, even = F.filter("points", lambda _, i: i % 2 == 0), F.filter("points", lambda _, i: i % 2 == 1)
    low = lambda a: F.array_min(a)
    high = lambda a: F.array_max(a)
    box = lambda k, poly: F.when(F.col("points").isNotNull(), poly).otherwise(F.get("f", F.lit(k)))
    rows = rows.select(
        "path", "line_no", F.get("f", F.lit(0)).cast("int").alias("cls"),
        box(1, (low(odd) + high(odd)) / 2).alias("x"), box(2, (low(even) + high(even)) / 2).alias("y"),
        box(3, high(odd) - low(odd)).alias("w"), box(4, high(even) - low(even)).alias("h"), "points", F.size("f").alias("_n"),
    )
    values = [F.col(c) for c in "xywh"]
    reason = (
        F.when((F.col("_n") != 5) & F.col("points").isNull(), "five fields are needed")
        .when(F.array_contains(F.array(*(v.isNull() for v in values)), True), "not a number")
        .when(F.least(*values) < 0, "negative")
        .when(F.greatest(*values) > 1, "not normalised")
    )
    return rows.withColumn("reason", reason).drop("_n")


def coco_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, cls, x, y, w, h) from annotation JSON: boxes by top left corner and size become shares."""
    raw = spark.read.option("multiLine", "true").json(path)
    im = raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", F.col("i.width").alias("iw"), F.col("i.height").alias("ih"))
    an = raw.select(F.explode("annotations").alias("a")).select(F.col("a.image_id").alias("im"), F.col("a.category_id").alias("cls"), "a.bbox")
    b = lambda k: F.get("bbox", F.lit(k))
    return im.join(an, F.col("image_id") == F.col("im")).select(
        "image_id", "file_name", "cls", ((b(0) + b(2) / 2) / F.col("iw")).alias("x"), ((b(1) + b(3) / 2) / F.col("ih")).alias("y"), (b(2) / F.col("iw")).alias("w"), (b(3) / F.col("ih")).alias("h")
    )


def csv_boxes(spark: SparkSession, path: str, columns: str, sized: bool) -> DataFrame:
    """Comma-separated boxes without a header as x1, y1, x2, y2. ``sized``: given by corner and size."""
    rows = spark.read.schema(columns).csv(path)
    if not sized:
        return rows
    return rows.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("h")).drop("w", "h")


def visdrone_labels(spark: SparkSession, path: str) -> DataFrame:
    """Boxes by corner and size with score and class; rows of score 0 (ignored regions) go, classes count from 0."""
    rows = csv_boxes(spark, path, "x1 int, y1 int, w int, h int, score int, cls int, truncation int, occlusion int", True)
    return rows.where("score <> 0").withColumn("cls", F.col("cls") - 1)


def sku_labels(spark: SparkSession, path: str) -> DataFrame:
    """Image name, corners, class name, image width and height, as shares of the image."""
    rows = csv_boxes(spark, path, "image string, x1 double, y1 double, x2 double, y2 double, class string, width double, height double", False)
    return rows.select(
        "image", F.lit(0).alias("cls"), ((F.col("x1") + F.col("x2")) / 2 / F.col("width")).alias("x"), ((F.col("y1") + F.col("y2")) / 2 / F.col("height")).alias("y"),
        ((F.col("x2") - F.col("x1")) / F.col("width")).alias("w"), ((F.col("y2") - F.col("y1")) / F.col("height")).alias("h"),
    )


def voc_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, difficult, x, y, w, h) of one-object-list-per-file XML, corners from 1."""
    schema = "filename string, size struct<width:double,height:double>, object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    rows = spark.read.option("rowTag", "annotation").schema(schema).xml(path).select("filename", "size", F.explode("object").alias("o"))
    b = lambda k: F.col(f"o.bndbox.{k}")
    return rows.where("o.difficult <> 1").select(
        "filename", "o.name", ((b("xmin") + b("xmax")) / 2 - 1).alias("cx"), ((b("ymin") + b("ymax")) / 2 - 1).alias("cy"), "size", (b("xmax") - b("xmin")).alias("bw"), (b("ymax") - b("ymin")).alias("bh")
    ).select("filename", "name", (F.col("cx") / F.col("size.width")).alias("x"), (F.col("cy") / F.col("size.height")).alias("y"), (F.col("bw") / F.col("size.width")).alias("w"), (F.col("bh") / F.col("size.height")).alias("h"))


def geojson_labels(spark: SparkSession, path: str, classes: dict[int, int]) -> DataFrame:
    """(image, cls, x1, y1, x2, y2) of feature collections with 'x1,y1,x2,y2' bounds; unknown types go."""
    from ..functions.dims import lookup

    schema = "features array<struct<properties:struct<image_id:string,type_id:int,bounds_imcoords:string>>>"
    rows = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.explode("features.properties").alias("p"))
    b = F.transform(F.split("p.bounds_imcoords", ","), lambda x: x.try_cast("int"))
    return rows.withColumn("cls", lookup(classes, F.col("p.type_id"))).where("cls is not null").select(F.col("p.image_id").alias("image"), "cls", *(F.get(b, F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))


def scan_labels(images_of: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: images with labels, without a file, with an empty one, with broken rows, and in total."""
    found = labels.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("n"), F.count("reason").alias("bad"))
    rows = images_of.select(label_path(F.col("path")).alias("lp")).join(found, F.col("lp") == F.col("p"), "left")
    return rows.agg(
        F.count_if(F.coalesce(F.col("n"), F.lit(0)) > 0).alias("found"), F.count_if(F.col("p").isNull()).alias("missing"),
        F.count_if(F.coalesce(F.col("bad"), F.lit(0)) > 0).alias("corrupt"), F.count("*").alias("total"),
    )
