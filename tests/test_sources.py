"""Readers, writers and streams on files made here."""

import io
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from plantspark.sources import readers, writers
from plantspark.streaming import streams


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_images(spark, tmp_path):
    put(tmp_path, "a/one.PGM", b"P5\n2 2\n255\n" + bytes([1, 2, 3, 4]))
    put(tmp_path, "a/two.png", b"P6\n1 1\n255\n" + bytes([255, 0, 0]))
    put(tmp_path, "a/three.txt", "no")
    put(tmp_path, "a/four.jpg", b"broken")
    found = readers.images(spark, str(tmp_path))
    assert {r["suffix"] for r in found.collect()} == {"png", "jpg"}
    pixels = {r["path"].rsplit("/", 1)[1]: r["pixels"] for r in readers.raster(found).collect()}
    assert np.frombuffer(pixels["two.png"], np.uint8).tolist() == [76] and pixels["four.jpg"] is None


def test_procedures(spark, tmp_path):
    put(tmp_path, "p.txt", "START UP\r\n\r\n  Open: XV-200 \nTHE END\n")
    rows = readers.text_procedures(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["style"], r["text"]) for r in rows] == [("Heading 1", "START UP"), ("Normal", "Open: XV-200"), ("Heading 1", "THE END")]


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{style}{chr(34)}/>' if style else ''}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    xml = f"<w:document {ns}><w:body>{p('Start', 'Heading1')}<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>{p('body &amp; more')}</w:body></w:document>"
    for name, content in (("good.docx", xml), ("odd.docx", "<w:p>a<w:p>b<w:t")):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("word/document.xml", content)
        put(tmp_path, name, buffer.getvalue())
    put(tmp_path, "bad.docx", b"nothing")
    rows = readers.docx_procedures(spark, str(tmp_path)).collect()
    by = lambda n: [(r["style"], r["text"]) for r in sorted(rows, key=lambda r: r["line_no"] or 0) if r["path"].endswith(n)]
    assert by("good.docx") == [("Heading 1", "Start"), ("Normal", "body & more"), ("Normal", "cell")]
    assert [t for _, t in by("odd.docx")] == ["a", "b<w:t"]
    assert [r["error"] is not None for r in rows if r["path"].endswith("bad.docx")] == [True]


def test_labels(spark, tmp_path):
    put(tmp_path, "labels/a.txt", "0 0.5 0.5 0.2 0.2\n1 0.1 0.1 0.3 0.1 0.3 0.4 0.1 0.4\n0 1.5 0.5 0.2 0.2\nx y\n")
    rows = readers.label_rows(spark, str(tmp_path / "labels")).orderBy("line_no").collect()
    assert [r["reason"] for r in rows] == [None, None, "not normalised", "five fields are needed"]
    assert [round(rows[1][c], 6) for c in "xywh"] == [0.2, 0.25, 0.2, 0.3]
    images = spark.createDataFrame([(rows[0]["path"].replace("/labels/", "/images/").replace(".txt", ".jpg"),), ("/x/images/none.png",)], "path string")
    assert tuple(readers.scan_labels(images, readers.label_rows(spark, str(tmp_path / "labels"))).first()) == (1, 1, 1, 2)


def test_annotations(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 200}], "annotations": [{"image_id": 1, "category_id": 3, "bbox": [10.0, 20.0, 30.0, 40.0]}]}
    r = readers.coco_labels(spark, put(tmp_path, "c.json", json.dumps(coco, indent=1))).first()
    assert (r["cls"], r["x"], r["y"], r["w"], r["h"]) == (3, 0.25, 0.2, 0.3, 0.2)
    v = readers.visdrone_labels(spark, put(tmp_path, "v.csv", "1,2,3,4,1,5,0,0\n1,2,3,4,0,5,0,0\n")).collect()
    assert [(x["x2"], x["y2"], x["cls"]) for x in v] == [(4, 6, 4)]
    s = readers.sku_labels(spark, put(tmp_path, "s.csv", "a.jpg,10,20,30,60,object,100,200\n")).first()
    assert (s["x"], s["y"], s["w"], s["h"]) == (0.2, 0.2, 0.2, 0.2)
    voc = "<annotation><filename>a.jpg</filename><size><width>100</width><height>50</height></size><object><name>car</name><difficult>0</difficult><bndbox><xmin>11</xmin><ymin>6</ymin><xmax>31</xmax><ymax>16</ymax></bndbox></object></annotation>"
    r = readers.voc_labels(spark, put(tmp_path, "voc.xml", voc)).first()
    assert (r["name"], r["x"], r["y"], r["w"], r["h"]) == ("car", 0.2, 0.2, 0.2, 0.2)
    geo = {"features": [{"properties": {"image_id": "1.tif", "type_id": 11, "bounds_imcoords": "1,2,3,4"}}, {"properties": {"image_id": "1.tif", "type_id": 99, "bounds_imcoords": "1,2,3,4"}}]}
    rows = readers.geojson_labels(spark, put(tmp_path, "g.json", json.dumps(geo)), {11: 0}).collect()
    assert [tuple(x) for x in rows] == [("1.tif", 0, 1, 2, 3, 4)]


def test_writers(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 2, "v", 100, 50, 200, 150, 0.456)], "pid_id long, node_id long, symbol_class string, x1 int, y1 int, x2 int, y2 int, confidence double")
    writers.predictions_csv(boxes, f"{tmp_path}/csv")
    assert tuple(spark.read.option("header", "true").csv(f"{tmp_path}/csv").first()) == ("1", "v", "0.46")
    writers.predictions_text(boxes, f"{tmp_path}/txt", 200)
    assert spark.read.text(f"{tmp_path}/txt").first()[0] == "v 0.750000 0.500000 0.500000 0.500000"
    writers.append_rows(boxes, f"{tmp_path}/rows")
    new = writers.upsert_rows(boxes.withColumn("confidence", F.lit(0.9)), f"{tmp_path}/rows", "node_id", "pid_id")
    assert spark.read.parquet(new).first()["confidence"] == 0.9
    nodes = boxes.select("node_id", "symbol_class")
    page = writers.html_report({"nodes": 1}, nodes, spark.createDataFrame([("INFO", "a<b")], "severity string, disc_type string"))
    assert "a&lt;b" in page and "nodes: 1" in page
    assert json.loads(writers.json_report({"nodes": nodes}).first()[0]) == {"nodes": [{"node_id": 2, "symbol_class": "v"}]}


def test_streams(spark, tmp_path):
    frames = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2), ("a", 3), (None, 9)], "source string, frame_no long")
    frames.repartition(2).write.parquet(f"{tmp_path}/frames")
    stream = streams.files(spark, f"{tmp_path}/frames", frames.schema)
    out = streams.run_once(streams.latest_frames(stream), "latest", f"{tmp_path}/c1", "update")
    assert {r["source"]: r["f"] for r in out.groupBy("source").agg(F.max("frame_no").alias("f")).collect()} == {"a": 4, "b": 2}

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/events")
    stream = streams.files(spark, f"{tmp_path}/events", events.schema)
    found = streams.run_once(streams.event_windows(stream), "windows", f"{tmp_path}/c2", "complete")
    batch = streams.event_windows(events)
    assert sorted(map(tuple, found.drop("total").collect())) == sorted(map(tuple, batch.drop("total").collect()))

    runs = spark.createDataFrame([(1, 10, 5), (1, 11, 7), (2, 12, 1)], "pid_id long, run_id long, created_at long")
    runs.write.parquet(f"{tmp_path}/runs")
    found = streams.run_once(streams.newest_runs(streams.files(spark, f"{tmp_path}/runs", runs.schema)), "newest", f"{tmp_path}/c3", "complete")
    assert sorted(map(tuple, found.collect())) == [(1, 11, 7), (2, 12, 1)]


def test_ingest(spark):
    up = spark.createDataFrame([("a.PDF",), ("b.exe",)], "file_name string")
    assert [r["status"] for r in streams.ingest(up, ("pdf",)).collect()] == ["completed", "failed"]
