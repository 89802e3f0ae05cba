"""Sources and sinks on files made in a temporary folder."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from fieldlens.sources import annotations as A
from fieldlens.sources import artifacts, catalog, logs, sidecar


@pytest.fixture
def photos(tmp_path):
    d = tmp_path / "photos"
    d.mkdir()
    for name in ("b.jpg", "a.PNG", "notes.txt"):
        (d / name).write_bytes(b"fake")
    (d / "deep").mkdir()
    (d / "deep" / "c.jpg").write_bytes(b"fake!")
    return d


def test_catalog(spark, photos):
    d = str(photos)
    good, bad = catalog.read_image_catalog(spark, [d, f"{d}/b.jpg", f"{d}/deep/*.jpg", f"{d}/none.jpg"])
    rows = {r.path.rsplit("/", 1)[1]: (r.source_type, r.length) for r in good.collect()}
    assert rows == {"a.PNG": ("directory", 4), "b.jpg": ("file", 4), "c.jpg": ("glob", 5)}
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in bad.collect()) == [("none.jpg", "missing"), ("notes.txt", "unsupported")]


def test_catalog_strict(spark, photos):
    d = str(photos)
    assert catalog.read_image_catalog(spark, [d], strict=True)[0].count() == 2
    for sources in ([f"{d}/notes.txt"], [f"{d}/none.jpg"], [f"{d}/*.webp"]):
        with pytest.raises(ValueError):
            catalog.read_image_catalog(spark, sources, strict=True)


def bmp(w, h, rgb):
    row = bytes(rgb[::-1]) * w
    row += b"\0" * (-len(row) % 4)
    head = struct.pack("<2sIHHI", b"BM", 54 + len(row) * h, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(row) * h, 0, 0, 0, 0)
    return head + row * h


def test_read_images_keeps_broken_files(spark, tmp_path):
    (tmp_path / "ok.bmp").write_bytes(bmp(3, 2, (255, 0, 0)))
    (tmp_path / "bad.bmp").write_bytes(b"nope")
    rows = {r.path.rsplit("/", 1)[1]: r for r in catalog.read_images(spark, str(tmp_path)).collect()}
    assert (rows["ok.bmp"].width, rows["ok.bmp"].height, bytes(rows["ok.bmp"].data)[:3]) == (3, 2, bytes([0, 0, 255]))
    assert rows["bad.bmp"].width in (-1, None)
    files = spark.read.format("binaryFile").load(str(tmp_path))

    def decode(content):
        if content[:2] != b"BM":
            raise ValueError("not a bitmap")
        w, h = struct.unpack("<ii", content[18:26])
        return h, w, 3, content[54:]

    got = {r.path.rsplit("/", 1)[1]: (r.width, r.error) for r in catalog.decode_images(files, decode).collect()}
    assert got == {"ok.bmp": (3, None), "bad.bmp": (None, "ValueError: not a bitmap")}


def test_part_annotations(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    files = {"images.txt": "1 001.Black bird/pic 1.jpg\n2 x.jpg\n", "classes.txt": "1 Black footed bird\n", "image_class_labels.txt": "1 1\n2 1\n",
             "bounding_boxes.txt": "1 60.0 27.0 325.0 304.0\n", "train_test_split.txt": "1 0\n2 1\n", "parts/part_locs.txt": "1 2 10.5 20.0 1\n1 7 0.0 0.0 0\n"}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    t = A.read_part_annotations(spark, str(tmp_path))
    assert {r.image_id: r.path for r in t["images"].collect()} == {1: "001.Black bird/pic 1.jpg", 2: "x.jpg"}
    assert t["classes"].first().name == "Black footed bird"
    assert [tuple(r) for r in t["parts"].orderBy("part_id").collect()] == [(1, 2, 10.5, 20.0, 1), (1, 7, 0.0, 0.0, 0)]
    assert tuple(t["boxes"].first()) == (1, 60.0, 27.0, 325.0, 304.0) and t["splits"].count() == t["labels"].count() == 2


def test_coco_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(1, "a.jpg", 640, 480, "train"), (2, "b.jpg", 320, 200, "val")], "id long, file_name string, width int, height int, split string")
    flat = spark.createDataFrame([(1, 1, 0, 1.0, 2.0, 3.0, 4.0, 12.0, 0.5, "train"), (2, 1, 1, 0.0, 0.0, 5.0, 5.0, 25.0, None, "train")],
                                 "id long, image_id long, category_id int, x double, y double, w double, h double, area double, orient double, split string")
    anns = A.coco_annotations(flat).join(flat.select("id", "split"), "id")
    cats = A.coco_categories(spark)
    A.write_coco(images, anns, cats, str(tmp_path / "out"))
    rows = lambda name: [r.asDict(recursive=True) for r in spark.read.json(str(tmp_path / f"out/{name}")).collect()]
    assert spark.read.json(str(tmp_path / "out/annotations")).filter("split = 'train'").count() == 2
    path = tmp_path / "train.json"
    path.write_text(json.dumps({"images": rows("images"), "annotations": rows("annotations"), "categories": rows("categories")}))
    back = A.read_coco(spark, str(path))
    assert [r.bbox for r in back["annotations"].orderBy("id").collect()] == [[1.0, 2.0, 3.0, 4.0], [0.0, 0.0, 5.0, 5.0]]
    assert [r.name for r in back["categories"].orderBy("id").collect()] == ["bird", "head", "eye", "beak"]


def test_mos_labels(spark, tmp_path):
    regions = ("image", "patch_1", "patch_2", "patch_3")
    head = ["name_image", *[f"mos_{r}" for r in regions], *[f"{s}_{r}" for r in regions for s in ("left", "top", "right", "bottom")], "is_valid"]
    (tmp_path / "l.csv").write_text(",".join(head) + "\nx.jpg," + ",".join(str(float(i)) for i in range(20)) + ",true\n")
    rows = A.mos_regions(A.read_mos_labels(spark, str(tmp_path / "l.csv"))).collect()
    assert [(r.region, r.mos, r.left, r.bottom) for r in rows] == [("image", 0.0, 4.0, 7.0), ("patch_1", 1.0, 8.0, 11.0), ("patch_2", 2.0, 12.0, 15.0), ("patch_3", 3.0, 16.0, 19.0)]
    assert rows[0].is_valid


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.sidecar.toml").write_text(
        '[detect]\nmodel = "m"\n[[detect.detections]]\nclass_name = "head"\nconfidence = 0.9\nx1 = 1.0\n[detect.input]\nimage_path = "a.jpg"\n[quality.core]\nfinal_score = 3.5\n')
    (tmp_path / "bad.sidecar.toml").write_text("not = = toml")
    good, bad = sidecar.read_sidecars(spark, str(tmp_path))
    rows = {r.tool: r for r in good.collect()}
    assert set(rows) == {"detect", "quality"} and json.loads(rows["detect"].input) == {"image_path": "a.jpg"}
    assert json.loads(rows["quality"].core) == {"final_score": 3.5} and rows["detect"].config is None
    assert bad.count() == 1 and bad.first().metadata_path.endswith("bad.sidecar.toml") and bad.first().error
    d = sidecar.sidecar_detections(good).first()
    assert (d.class_name, d.confidence, d.x1, d.crop_path) == ("head", 0.9, 1.0, None)


def test_metadata_json_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1, None, [[0.123, 0.456]])], "a int, b string, g array<array<double>>")
    assert json.loads(df.select(sidecar.metadata_json("a", "b", sidecar.rounded_grid(F.col("g")).alias("g"))).first()[0]) == {"a": 1, "g": [[0.12, 0.46]]}


def test_metric_log(spark, tmp_path):
    line = {"epoch": 3, "test_results_json": {"class_map": [{"class": "bird", "map@50:95": 0.5, "map@50": 0.9, "precision": 0.8, "recall": 0.7}]}}
    (tmp_path / "log.txt").write_text(json.dumps(line) + "\n" + json.dumps({"epoch": 4}) + "\n")
    rows = logs.read_metric_log(spark, str(tmp_path / "log.txt")).collect()
    assert {(r.epoch, r.series, r["class"], r.metric, r.value) for r in rows} == {
        (3, "regular", "bird", "map@50:95", 0.5), (3, "regular", "bird", "map@50", 0.9), (3, "regular", "bird", "precision", 0.8), (3, "regular", "bird", "recall", 0.7)}


def test_benchmark_stats(spark, tmp_path):
    t = {"mean": 2.0, "median": 2.0, "min": 1.0, "max": 3.0, "stdev": 1.0}
    (tmp_path / "b.json").write_text(json.dumps({"head": {"runs": 3, "load_time": t, "total_time": t}}))
    rows = logs.read_benchmark_stats(spark, str(tmp_path / "b.json")).collect()
    assert [(r.name, r.runs, r.phase, r.max) for r in rows] == [("head", 3, "load_time", 3.0), ("head", 3, "total_time", 3.0)]


def test_batch_report(spark, tmp_path):
    res = spark.createDataFrame([("a", 1.0)], "path string, ms double")
    logs.write_batch_report(res, res.agg(F.count("*").alias("total")), F.struct(F.lit(0.3).alias("threshold")), str(tmp_path))
    assert spark.read.json(str(tmp_path / "summary")).select("summary.total", "configuration.threshold").first() == (1, 0.3)


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("x/a.png", bytearray(b"12")), ("b.jpg", bytearray(b"345"))], "name string, content binary")

    def encode(content, ext):
        if ext == "jpg":
            raise ValueError("cannot")
        return content + b"!"

    rows = {r.name: (r.bytes_written, r.error) for r in artifacts.write_artifacts(df, str(tmp_path), encode).collect()}
    assert rows == {"x/a.png": (3, None), "b.jpg": (None, "cannot")}
    assert (tmp_path / "x/a.png").read_bytes() == b"12!" and not (tmp_path / "b.jpg").exists()


_ODD = ['plain', 'a "quoted" name', 'back\\slash \\\\ end\\', '{"images": [{', ']}', 'é漢\U0001f600', '', '\\"']


@pytest.mark.parametrize("range_bytes", [23, 200, 1 << 20])
def test_coco_documents_by_byte_range(spark, tmp_path, range_bytes):
    """Strings full of quotes, backslashes and braces; nested segmentations; sections in any order, empty and unknown ones."""
    n = 3 if range_bytes == 23 else 20
    image = lambda i: {"id": i, "file_name": _ODD[i % len(_ODD)], "width": i, "height": 2 * i, "license": {"text": _ODD[-1 - i % 3], "list": [{}, [1, {"a": "]"}]]}}
    note = lambda i: {"id": i, "image_id": i % 7, "category_id": 1, "segmentation": [[1.5, 2.0], [3, 4]], "bbox": [1.0, 2.0, 3.0, i / 4], "area": 1.0, "iscrowd": 0,
                      "rle": {"counts": "[{\\\"", "size": [1, 2]}}
    docs = [{"info": {"images": [{"id": -1}], "text": _ODD[3]}, "images": [image(i) for i in range(n)], "licenses": [{"id": 1}], "annotations": [note(i) for i in range(n)],
             "categories": [{"id": 0, "name": "bird", "supercategory": _ODD[2]}]},
            {"annotations": [note(100)], "categories": [], "images": []}, {}]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(d, indent=k or None, ensure_ascii=k == 1), encoding="utf-8")
    got = A.read_coco(spark, str(tmp_path), range_bytes)
    want = lambda name: [e for d in docs for e in d.get(name, [])]
    assert sorted((r.id, r.file_name, r.width) for r in got["images"].collect()) == sorted((e["id"], e["file_name"], e["width"]) for e in want("images"))
    assert sorted((r.id, r.bbox) for r in got["annotations"].collect()) == sorted((e["id"], e["bbox"]) for e in want("annotations"))
    assert [(r.name, r.supercategory) for r in got["categories"].collect()] == [("bird", _ODD[2])]
    if range_bytes == 200:
        assert got["images"].rdd.getNumPartitions() > 20  # ranges of one document are tasks of their own


def test_coco_documents_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(i, _ODD[i % len(_ODD)], 640, 480, s) for i, s in enumerate(["train", "val", "a/b c", None] * 5)],
                                   "id long, file_name string, width int, height int, split string")
    flat = spark.createDataFrame([(i, i % 20, i % 4, 1.0, 2.0, 3.0, 4.0, 12.0, None if i % 3 else 0.5, "train") for i in range(50)],
                                 "id long, image_id long, category_id int, x double, y double, w double, h double, area double, orient double, split string")
    anns = A.coco_annotations(flat).join(flat.select("id", "split"), "id")
    cats = A.coco_categories(spark)
    for _ in range(2):  # the second write replaces the first
        assert A.write_coco_documents(images, anns, cats, str(tmp_path)) == ["a/b c", "null", "train", "val"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a%2Fb c.json", "null.json", "train.json", "val.json"]
    assert len(json.loads((tmp_path / "val.json").read_text())["images"]) == 5 and json.loads((tmp_path / "val.json").read_text())["annotations"] == []
    back = A.read_coco(spark, str(tmp_path / "train.json"), 100)
    assert sorted((r.id, r.file_name) for r in back["images"].collect()) == sorted((r.id, r.file_name) for r in images.where("split = 'train'").collect())
    assert [tuple(r.bbox) for r in back["annotations"].collect()] == [(1.0, 2.0, 3.0, 4.0)] * 50
    assert [r.name for r in back["categories"].orderBy("id").collect()] == ["bird", "head", "eye", "beak"]
    (tmp_path / "cut.json").write_text('{"images": [{"id": 1, "file_name": "x')
    with pytest.raises(Exception, match="ends inside"):
        A.read_coco(spark, str(tmp_path / "cut.json"))["images"].collect()


def test_artifacts_leave_one_file_for_each_row(spark, tmp_path):
    """A task that fails after some writes is run again (local mode: the write as a whole), and its first attempt leaves nothing; a URI is a folder too."""
    folder, flag = tmp_path / "out", tmp_path / "failed"
    df = spark.createDataFrame([(f"d{i % 3}/f{i}.bin", bytearray([i])) for i in range(20)] + [("../x", bytearray(b"1")), ("none", None)], "name string, content binary").coalesce(1)

    def encode(content, ext):
        if content[0] == 15 and not flag.exists():
            flag.write_text("")
            os._exit(1)
        return bytes(content)

    try:
        rows = artifacts.write_artifacts(df, f"file://{folder}", encode).collect()
    except Exception:
        rows = artifacts.write_artifacts(df, f"file://{folder}", encode).collect()
    assert flag.exists() and sorted(r.name for r in rows if r.error) == ["../x", "none"]
    assert sorted(str(p.relative_to(folder)) for p in folder.rglob("*.bin")) == sorted(f"d{i % 3}/f{i}.bin" for i in range(20))
    assert all((folder / f"d{i % 3}/f{i}.bin").read_bytes() == bytes([i]) for i in range(20))
    assert not (tmp_path / "x").exists()
    assert artifacts.write_artifacts(df.where("false"), str(tmp_path / "no")).count() == 0
