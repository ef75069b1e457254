"""Folders of label maps through the data source, PNG filters, lists in their order, COCO subsets."""

import json
import struct
import time
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gridspectra.sources import annotations, files, fixtures, label_files


def filtered(m, kinds):
    """`m` as a PNG file whose row r has filter kinds[r], by the definition of each filter."""
    h, w = m.shape
    at = lambda r, c: int(m[r, c]) if r >= 0 and c >= 0 else 0
    rows = []
    for r in range(h):
        line = [kinds[r]]
        for c in range(w):
            a, b, x = at(r, c - 1), at(r - 1, c), at(r - 1, c - 1)
            p = a + b - x
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - x), 2, x))[2]
            line.append((at(r, c) - (0, a, b, (a + b) // 2, near)[kinds[r]]) % 256)
        rows.append(bytes(line))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


@pytest.mark.parametrize("band", [1, 3, 512])
def test_png_filters(monkeypatch, band):
    monkeypatch.setattr(files, "BAND", band)
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (1, 9), (9, 1), (17, 23), (40, 5)):
        for top in (4, 256):
            m = rng.integers(0, top, (h, w)).astype(np.uint8)
            for kinds in (rng.integers(0, 5, h), np.full(h, 3), np.full(h, 4)):
                assert (files.decode_png(filtered(m, [int(k) for k in kinds])) == m).all()
    with pytest.raises(ValueError, match="filter"):
        files.decode_png(bad_filter(m))


def bad_filter(m):
    body = zlib.compress(b"".join(b"\x07" + bytes(line) for line in m))
    part = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", m.shape[1], m.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", body) + part(b"IEND", b"")


def test_large_png():
    m = np.random.default_rng(4).integers(0, 256, (400, 500)).astype(np.uint8)
    data = filtered(m, [4] * 400)
    start = time.time()
    assert (files.decode_png(data) == m).all()
    assert time.time() - start < 1


def test_round_trip_of_all_maps(spark, tmp_path):
    maps = fixtures.seg(spark, f"{DATA}/sf0.001").select(F.concat(F.lit("im"), "image_id").alias("id"), "r", "c", "label")
    want = sorted(map(tuple, maps.where("label > 0").collect()))
    path = str(tmp_path / "maps")
    label_files.write_label_maps(maps, path)
    back = label_files.read_label_maps(spark, path, files=3)
    assert len(want) and sorted(map(tuple, back.where("label > 0").collect())) == want
    assert not (tmp_path / "maps" / label_files.PENDING).exists() or not any((tmp_path / "maps" / label_files.PENDING).iterdir())
    # the files are those of the binary sink, and another reader meets them
    names = {r.id for r in maps.select("id").distinct().collect()}
    assert {r.id for r in files.folder(spark, path, "*.png").collect()} == names
    assert files.label_maps(files.folder(spark, path, "*.png", content=True)).where("label > 0").count() == len(want)


def test_missing_cells_are_not_read(spark, tmp_path, monkeypatch):
    """Cells that no row named stay away, by both readers and in small bands; a whole map's file has no chunk for them, and one of another writer is whole."""
    monkeypatch.setattr(files, "CELLS", 6)
    rows = [("part", r, c, (r + c) % 3) for r in range(6) for c in range(5) if r * 5 + c < 28 and (r, c) not in ((0, 0), (2, 3))] + [("whole", r, c, 0) for r in range(2) for c in range(3)]
    maps = spark.createDataFrame(rows, "id string, r int, c int, label int")
    path = str(tmp_path / "m")
    label_files.write_label_maps(maps, path)
    assert sorted(map(tuple, label_files.read_label_maps(spark, path).collect())) == sorted(rows)
    assert sorted(map(tuple, files.label_maps(files.folder(spark, path, "*.png", content=True)).collect())) == sorted(rows)
    assert sorted(map(tuple, files.label_maps(files.png_files(maps)).collect())) == sorted(rows)
    data = {p.stem: p.read_bytes() for p in (tmp_path / "m").rglob("*.png")}
    assert files.ABSENT in data["part"] and files.ABSENT not in data["whole"]
    assert (files.decode_png(data["part"])[[0, 2, 5], [0, 3, 4]] == 0).all()
    m = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert sum(len(r) for r, _, _ in files.map_cells(filtered(m, [0, 0, 0]), 6)) == 12


def test_append_overwrite_and_empty(spark, tmp_path):
    path = str(tmp_path / "m")
    one = lambda i, v: spark.createDataFrame([(i, 1, 2, v)], "id string, r int, c int, label int")
    ids = lambda: sorted((r.id, r.label) for r in label_files.read_label_maps(spark, path).where("label > 0").collect())
    label_files.write_label_maps(one("a", 5), path)
    label_files.write_label_maps(one("b", 6), path)
    label_files.write_label_maps(one("c", 1).limit(0), path)
    assert ids() == [("a", 5), ("b", 6)]
    label_files.write_label_maps(one("a", 9), path, overwrite=True)
    assert ids() == [("a", 9)]


@pytest.mark.parametrize("bad", [("x", 0, 0, 256), ("x", 0, 0, -1), ("x", None, 0, 1), (None, 0, 0, 1), ("../x", 0, 0, 1)])
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad):
    rows = [(f"i{k}", 0, 0, 1) for k in range(40)] + [bad]
    with pytest.raises(Exception):
        label_files.write_label_maps(spark.createDataFrame(rows, "id string, r int, c int, label int"), str(tmp_path / "m"))
    assert not list(tmp_path.rglob("*.png"))


def test_filters_choose_files(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    path = str(tmp_path / "m")
    label_files.write_label_maps(spark.createDataFrame([(f"i{k}", 0, 0, k) for k in range(20)], "id string, r int, c int, label int"), path)
    reader = label_files.LabelMapReader({"path": path, "files": "2"})
    assert len(reader.partitions()) == 10
    rest = GreaterThan(("label",), 1)
    assert list(reader.pushFilters([In(("id",), ("i3", "i4", "i5")), rest])) == [rest]
    assert sum(len(p.paths) for p in reader.partitions()) == 3
    assert list(reader.pushFilters([EqualTo(("id",), "i4")])) == []
    assert [len(p.paths) for p in reader.partitions()] == [1]
    assert [r.label for r in label_files.read_label_maps(spark, path).where("id = 'i7'").collect()] == [7]
    assert [r.label for r in label_files.read_label_maps(spark, path).where("id in ('i7', 'none') and label > 1").collect()] == [7]


def test_lists_and_folders(spark, tmp_path):
    (tmp_path / "list.txt").write_text("b.jpg\r\na.jpg\n\nb.jpg\n")
    got = files.paths(spark, str(tmp_path / "list.txt"))
    assert [r.path for r in got.orderBy("place", "path").collect()] == ["b.jpg", "a.jpg", "b.jpg"]
    for name in ("flat/b.png", "flat/a.png", "deep/one/x.jpg", "deep/two/y.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    assert [r.path.rsplit("/", 1)[1] for r in files.paths(spark, str(tmp_path / "flat")).orderBy("place", "path").collect()] == ["a.png", "b.png"]
    assert sorted(r.id for r in files.image_folder(spark, str(tmp_path / "flat")).collect()) == ["a", "b"]
    assert sorted(r.id for r in files.image_folder(spark, str(tmp_path / "deep")).collect()) == ["x", "y"]
    with pytest.raises(ValueError, match="neither"):
        files.paths(spark, str(tmp_path / "none"))


def test_coco_selection(spark, tmp_path):
    whole = {"images": [{"id": i, "file_name": f"{i}.jpg", "height": 2, "width": 3} for i in (7, 8, 9)], "categories": [{"id": 2, "name": "cat"}, {"id": 1, "name": "dog"}]}
    whole["annotations"] = [{"id": k, "image_id": i, "iscrowd": 0, "category_id": 2, "bbox": [0.0, 0.0, 1.0, float(k)]} for k, i in ((3, 9), (1, 7), (2, 9), (4, 8))]
    (tmp_path / "c.json").write_text(json.dumps(whole))
    (tmp_path / "list.txt").write_text("COCO_train2014_000000000009.jpg\nCOCO_train2014_000000000007.jpg\nCOCO_train2014_000000000011.jpg\n")
    coco = spark.read.schema(annotations.COCO_SCHEMA).json(str(tmp_path / "c.json"), multiLine=True)
    annotations.write_coco_selection(annotations.coco_selection(files.lines(spark, str(tmp_path / "list.txt")), coco), str(tmp_path / "out"))
    read = lambda name: [json.loads(x) for f in sorted((tmp_path / "out" / name).glob("part*")) for x in f.read_text().splitlines()]
    assert [r["id"] for r in read("images")] == [9, 7]
    assert [(r["id"], r["image_id"]) for r in read("annotations")] == [(2, 9), (3, 9), (1, 7)]
    assert read("categories") == [{"id": 1, "name": "dog"}, {"id": 2, "name": "cat"}]
