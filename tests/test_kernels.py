"""Kernels against plain versions, and the rules at the edges of masks, boxes and metrics."""

import itertools
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gridspectra.functions import boxes, names
from gridspectra.operators import cluster, graph, grid, masks, metrics, spectral
from gridspectra.plans import entries
from gridspectra.sources import annotations, files, fixtures, images
from gridspectra.streaming import pixels


def cells(spark, *images):
    return spark.createDataFrame([(i, r, c, int(v)) for i, m in enumerate(images) for (r, c), v in np.ndenumerate(np.array(m))], "image_id int, r int, c int, label int")


def flood(mask, diagonal):
    h, w = mask.shape
    out = np.full(mask.shape, -1)
    for start in range(h * w):
        if out.flat[start] >= 0 or mask.flat[start] < 0:
            continue
        todo = [start]
        out.flat[start] = start
        while todo:
            r, c = divmod(todo.pop(), w)
            for dr, dc in itertools.product((-1, 0, 1), repeat=2):
                if (dr or dc) and (diagonal or not (dr and dc)) and 0 <= r + dr < h and 0 <= c + dc < w and out[r + dr, c + dc] < 0 and mask[r + dr, c + dc] == mask[r, c]:
                    out[r + dr, c + dc] = start
                    todo.append((r + dr) * w + c + dc)
    return out


@pytest.mark.parametrize("diagonal", [False, True])
def test_components(diagonal):
    turn = np.random.default_rng(1)
    for shape in [(1, 1), (1, 9), (9, 1), (7, 12), (20, 20)]:
        for _ in range(10):
            m = turn.integers(-1, 2, shape)
            assert (masks.label_components(m, diagonal) == flood(m, diagonal)).all()


def test_assignment():
    turn = random.Random(2)
    for n in range(1, 7):
        for _ in range(20):
            g = [[turn.choice([0, 0.5, turn.random()]) for _ in range(n)] for _ in range(n)]
            best = max(sum(g[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert abs(sum(g[i][j] for i, j in enumerate(metrics.assign(g))) - best) < 1e-9


def test_erosion_keeps_a_mask_it_would_empty(spark):
    m = masks.erode(masks.masks_of(cells(spark, [[0, 0, 0], [0, 1, 0], [0, 0, 0]])), 2)
    assert m.where("x = 1").count() == 1
    assert masks.dilate(m, 1).where("x = 1").count() == 5


def test_border_of_flat_map(spark):
    got = masks.border_fraction(cells(spark, [[1, 1, 2]]), 1, 3).collect()
    assert {r.label: round(r.fraction, 6) for r in got} == {1: round((2 + 2 + 1) / 8, 6), 2: round((1 + 1 + 1) / 8, 6)}


def test_relabel_needs_a_cluster(spark):
    none = spark.createDataFrame([], "image_id int, label int, cluster int")
    with pytest.raises(Exception, match="no cluster"):
        masks.relabel(cells(spark, [[1]]), none).collect()
    assert masks.relabel(cells(spark, [[0]]), none).collect()[0].label == 0


def test_largest_component_takes_the_first_of_equals(spark):
    big = masks.largest_component(masks.connected_components(cells(spark, [[1, 2, 1]])))
    assert [(r.r, r.c) for r in big.collect()] == [(0, 0)]


def test_empty_denominators(spark):
    p = spark.createDataFrame([(0, False, False), (1, True, False)], "image_id int, pred boolean, target boolean")
    assert {r.image_id: r.iou for r in metrics.binary_iou(p, "image_id").collect()} == {0: 0.0, 1: 0.0}
    got = {r.image_id: (r.precision, r.recall) for r in metrics.precision_recall(p, "image_id").collect()}
    assert got == {0: (1.0, 1.0), 1: (0.0, 1.0)}


def test_unmatched_predictions_become_background(spark):
    p = spark.createDataFrame([(7, 3)], "pred int, target int")
    assert metrics.remap(p, spark.createDataFrame([(1, 2)], "pred int, target int")).collect()[0].pred == 0


@pytest.mark.parametrize("kind", ["iou", "giou", "diou", "ciou"])
def test_equal_boxes_overlap_fully(spark, kind):
    b = spark.createDataFrame([(0.0, 0.0, 4.0, 2.0)], "x1 double, y1 double, x2 double, y2 double")
    assert abs(b.select(boxes.iou(boxes.columns(), boxes.columns(), kind).alias("v")).collect()[0].v - 1) < 1e-5


def test_eigenvectors(spark):
    turn = np.random.default_rng(3)
    f = turn.normal(size=(30, 8))
    for kernel in (spectral.laplacian_eigen, spectral.affinity_eigen, spectral.affinity_svd):
        value, v, rest = kernel(f, 5)
        assert len(value) == 5 and v.shape == (30, 5) and rest.max() < 1e-9
    value, _, rest = spectral.laplacian_eigen(f, 5, lapnorm=False)
    assert abs(value[0]) < 1e-9 and rest.max() < 1e-9


def test_sign_rule():
    v = np.array([[1.0, 1, 1, -1], [1, 2, 3, 4], [-1, 1, -2, 1]]).T
    out = spectral.pin_sign(v)
    assert (out[:, 0] == -v[:, 0]).all() and (out[:, 1] == v[:, 1]).all() and (out[:, 2] == -v[:, 2]).all()


def test_mask_box_rules(spark):
    empty, full, half = np.zeros((4, 4), int), np.ones((4, 4), int), np.array([[1, 1, 0, 0]] * 4)
    most = np.ones((4, 4), int)
    most[1, 2] = 0
    got = {r.image_id: (r.x1, r.y1, r.x2, r.y2) for r in spectral.mask_box(cells(spark, empty, full, half, most), 1).collect()}
    assert got == {0: (0, 0, 4, 4), 1: (0, 0, 4, 4), 2: (0, 0, 2, 4), 3: (2, 1, 3, 2)}


def test_lloyd():
    x = np.concatenate([np.random.default_rng(4).normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    label = cluster.lloyd(x, 3)
    assert len({tuple(set(label[i : i + 20])) for i in (0, 20, 40)}) == 3
    assert len(cluster.lloyd(x[:2], 5)) == 2


def test_eigengap(spark):
    e = spark.createDataFrame([(0, k, v) for k, v in enumerate([0.0, 0.9, 1.0, 1.5, 1.6])], "image_id int, k int, eigenvalue double")
    assert graph.eigengap_clusters(e).collect()[0].n_clusters == 3


def test_grid_rules(spark):
    c = cells(spark, [[1, 2], [3, 4]])
    up = {(r.r, r.c): r.label for r in grid.nearest_resize(c, "label", (2, 2), (4, 4)).collect()}
    assert up == {(r, col): 1 + 2 * (r // 2) + col // 2 for r in range(4) for col in range(4)}
    assert grid.pad(c, "label", 3, 3).where("label = 0").count() == 5
    bad = spark.createDataFrame([(5, 16, 16)], "n int, h int, w int")
    with pytest.raises(Exception, match="no patch size"):
        bad.select(grid.infer_patch(F.col("n"), F.col("h"), F.col("w"))).collect()


def test_png(spark):
    m = np.random.default_rng(5).integers(0, 256, (13, 7))
    assert (files.decode_png(files.encode_png(m)) == m).all()
    f = spark.createDataFrame([("a", bytearray(files.encode_png(m)))], "id string, content binary")
    assert files.label_maps(f).count() == 91
    with pytest.raises(ValueError):
        files.decode_png(b"GIF")


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("b.jpg\na.jpg\n\nb.jpg\n")
    assert [r.name for r in files.names(spark, str(tmp_path / "list.txt")).collect()] == ["a.jpg", "b.jpg"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.1.png").write_bytes(b"1")
    assert [r.id for r in files.folder(spark, str(tmp_path / "d")).collect()] == ["x.1"]
    left, right = (spark.createDataFrame([(k, k) for k in ks], "id string, v string") for ks in ("ab", "bc"))
    assert files.pair_by_key(left, right, strict=False).count() == 1
    with pytest.raises(Exception, match="unpaired"):
        files.pair_by_key(left, right).collect()
    files.write_table(left, str(tmp_path / "t"))
    with pytest.raises(Exception):
        files.write_table(left, str(tmp_path / "t"))
    assert files.not_yet_written(right, spark.read.parquet(str(tmp_path / "t")), "id").count() == 1
    files.write_result_line(spark.createDataFrame([(12.345,)], "corloc double"), str(tmp_path / "line"))
    assert spark.read.text(str(tmp_path / "line")).collect()[0].value == "corloc,12.3,,"


def test_annotation_files(spark, tmp_path):
    (tmp_path / "1.xml").write_text("<annotation><filename>1.jpg</filename><object><name>cat</name><truncated>0</truncated><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    voc = annotations.read_voc(spark, str(tmp_path / "1.xml")).withColumn("image_id", F.lit(1))
    assert [tuple(r) for r in annotations.voc_boxes(voc).collect()] == [(1, "cat", 0, 1, 3, 4)]
    assert annotations.hard_images(voc).count() == 1 and annotations.voc_boxes(voc, True).count() == 0
    (tmp_path / "c.json").write_text('{"images": [], "categories": [], "annotations": [{"id": 1, "image_id": 7, "iscrowd": 0, "category_id": 2, "bbox": [0.5, 1.5, 2.0, 2.0]}]}')
    coco = annotations.read_coco(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in annotations.coco_boxes(coco).collect()] == [(7, 2, 0, 2, 2, 4)]
    names_ = spark.createDataFrame([("COCO_train2014_000000000007.jpg",), ("COCO_train2014_000000000008.jpg",)], "name string")
    assert sorted((r.image_id, len(r.boxes)) for r in annotations.coco_subset(names_, coco).collect()) == [(7, 1), (8, 0)]
    with pytest.raises(ValueError):
        annotations.ground_truth("x", coco)


def test_stems(spark):
    p = spark.createDataFrame([("a/b.c.jpeg",), ("x",), ("d/e.png",)], "p string")
    assert [r.s for r in p.select(names.stem(F.col("p")).alias("s")).collect()] == ["b.c", "x", "e"]


def test_stream_counts(spark, tmp_path):
    p = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 0, 1, 255, 2), (0, 1, 0, 1, 2)], pixels.SCHEMA)
    p.write.parquet(str(tmp_path / "in"))
    q = pixels.pixel_counts(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("pixel_counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("pixel_counts").collect()] == [(2, 1, 2)]


def test_missing_cells_are_outside(spark):
    from gridspectra.operators import masks

    cells = spark.createDataFrame([(0, 1, 0, c, 1) for c in (0, 1, 2, 5, 6, 7, 8)], "image_id int, label int, r int, c int, x int")
    assert {r.c for r in masks.dilate(cells).where("x = 1").collect()} == {0, 1, 2, 5, 6, 7, 8}
    grown = spark.createDataFrame([(0, 1, 0, c, x) for c, x in ((0, 1), (3, 0), (4, 0))], "image_id int, label int, r int, c int, x int")
    assert {r.c: r.x for r in masks.dilate(grown).collect()} == {0: 1, 3: 0, 4: 0}


def test_turned_signs_are_those_of_the_kernel(spark):
    import numpy as np

    from gridspectra.operators import spectral

    turn = np.random.default_rng(2)
    v = [*turn.normal(size=(20, 6)), np.array([1.0, 2, 3, 4, 5, 6]), -np.ones(6), np.array([1.0, -2, 3, -4, 5, -6]), np.zeros(6)]
    got = spectral.turned(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k int, eigenvector array<double>")).orderBy("k").collect()
    want = spectral.pin_sign(np.stack(v).T).T
    assert all(np.array_equal(np.array(r.eigenvector) + 0.0, w + 0.0) for r, w in zip(got, want))


def test_matching_text(spark):
    import pytest
    from pyspark.sql import functions as F

    from gridspectra.operators import records

    parse = lambda t: spark.createDataFrame([(t,)], "t string").select(records.parse_matching(F.col("t")).alias("m")).collect()[0].m
    assert [tuple(x) for x in parse("[(0, 3), (1, 2)]")] == [(0, 3), (1, 2)] and parse("[]") == []
    for bad in ("nonsense", "[[1]]", "[[1, null]]", None):
        with pytest.raises(Exception):
            parse(bad)


def test_json_names_and_png_sinks(spark, tmp_path):
    import json

    from gridspectra.sources import files

    files.write_json(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), str(tmp_path / "j"))
    assert [json.loads(x) for f in (tmp_path / "j").glob("part*") for x in f.read_text().splitlines()] == [{"a": 1, "b": None}]
    files.write_names(spark.createDataFrame([("b",), ("a",)], "name string"), str(tmp_path / "n"))
    assert [x for f in sorted((tmp_path / "n").glob("part*")) for x in f.read_text().splitlines()] == ["a", "b"]
    cells = spark.createDataFrame([("x", r, c, 10 * r + c) for r in range(3) for c in range(4)], "id string, r int, c int, label int")
    back = files.label_maps(files.png_files(cells).select("id", "content"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_whole_extraction(spark):
    from gridspectra.plans import entries
    from gridspectra.sources import fixtures

    out = entries.extract(fixtures.feat(spark, "/root/testdata/sf0.001"), n_clusters=3)
    assert set(out) == {"eigens", "regions", "boxes", "features", "clusters", "maps"}
    assert {r.label for r in out["maps"].select("label").distinct().collect()} <= {0, 1, 2, 3} and out["maps"].count() == 500
    assert entries.extract(fixtures.feat(spark, "/root/testdata/sf0.001"), n_clusters=3, baseline=True)["maps"].count() == 500


def test_localization_by_eigenvector(spark):
    from pyspark.sql import functions as F

    from gridspectra.plans import entries
    from gridspectra.sources import fixtures

    f = fixtures.feat(spark, "/root/testdata/sf0.001")
    images = f.select("image_id").distinct().select("image_id", F.lit(155).alias("h"), F.lit(157).alias("w"))
    found = entries.localize(f, fixtures.gtb(spark, "/root/testdata/sf0.001"), images, "eigen")
    assert all(r.x2 <= 157 and r.y2 <= 155 and 0 <= r.iou <= 1 for r in found.collect())
    rate = entries.corloc(found).collect()[0]
    assert rate.images == 5 and 0 <= rate.corloc <= 100


def test_localization_by_stored_vectors_and_attention(spark):
    feats = fixtures.feat(spark, f"{DATA}/sf0.001")
    sizes = feats.select("image_id").distinct().selectExpr("image_id", "150 as h", "155 as w")
    truth = sizes.selectExpr("image_id", "0 as x1", "0 as y1", "80 as x2", "80 as y2")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for which, n in (("affinity", 1), ("laplacian", 2)):
        own = rows(entries.localize(feats, truth, sizes, "eigen", which=which))
        assert own and own == rows(entries.localize(None, truth, sizes, "eigen", which=which, eigens=spectral.eigen(feats, which, n)))
    attention = fixtures.att(spark, f"{DATA}/sf0.001")
    got = entries.localize(None, truth, sizes, "attention", attention=attention)
    boxes = masks.to_image(spectral.attention_box(attention, 0.6, 1), sizes, scale=16)
    assert rows(got.select("image_id", "x1", "y1", "x2", "y2")) == rows(boxes.select("image_id", "x1", "y1", "x2", "y2"))
    assert entries.localize(feats, truth.limit(0), sizes).count() == 0
    assert {(r.iou, r.hit) for r in entries.localize(feats, truth.limit(0), sizes, no_hard=False).collect()} == {(0.0, False)}
    with pytest.raises(ValueError, match="matrix"):
        entries.localize(feats, truth, sizes, "eigen", which="x")


def test_inferred_patch_of_a_mask_box(spark):
    from gridspectra.operators import spectral

    cells = spark.createDataFrame([(i, r, c, int(r < 3 and c < 3)) for i in (0, 1) for r in range(10) for c in range(10)], "image_id int, r int, c int, label int")
    images = spark.createDataFrame([(0, 84, 81), (1, 165, 160)], "image_id int, h int, w int")
    assert sorted(map(tuple, spectral.mask_box(cells, images=images).collect())) == [(0, 0, 0, 24, 24), (1, 0, 0, 48, 48)]


def test_odd_predictions_are_an_error(spark):
    import pytest

    from gridspectra.plans import entries

    make = lambda v, n: spark.createDataFrame([("a", 0, 0, 0, v)], f"dataset string, image_id int, r int, c int, {n} int")
    assert entries.evaluate_objects(make(255, "pred"), make(1, "target")).collect()[0].iou == 1.0
    with pytest.raises(Exception, match="neither 0, 1 nor 255"):
        entries.evaluate_objects(make(7, "pred"), make(1, "target")).collect()


def color_png(path, p):
    import struct
    import zlib

    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w, _ = p.shape
    rows = b"".join(b"\0" + line.tobytes() for line in p)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


def test_color_images(spark, tmp_path):
    turn = np.random.default_rng(3)
    own = {n: turn.integers(0, 256, (h, w, 3), np.uint8) for n, h, w in (("a", 3, 5), ("b", 8, 4))}
    for n, p in own.items():
        color_png(tmp_path / f"{n}.png", p)
    (tmp_path / "gray.png").write_bytes(files.encode_png(np.array([[7, 200]])))
    read = images.images(spark, str(tmp_path))
    got = {(x.image_id, x.r, x.c): (x.red, x.green, x.blue) for x in images.pixels(read).collect()}
    assert got == {(n, r, c): tuple(map(int, p[r, c])) for n, p in own.items() for r, c in np.ndindex(p.shape[:2])} | {("gray", 0, 0): (7,) * 3, ("gray", 0, 1): (200,) * 3}
    same = images.low_resolution(read.where("image_id = 'b'"), (8, 4)).orderBy("patch").collect()
    assert [[round(255 * v) for v in (x.e1, x.e2, x.e3)] for x in same] == own["b"].reshape(-1, 3).tolist()
    one = images.images(spark, str(tmp_path), spark.createDataFrame([("b.png",), ("b.png",)], "name string"))
    assert [(x.image_id, x.h, x.w, x.channels) for x in one.collect()] == [("b", 8, 4, 3)]
    with pytest.raises(Exception, match="unpaired c"):
        images.images(spark, str(tmp_path), spark.createDataFrame([("c",)], "name string")).collect()
    (tmp_path / "broken.png").write_bytes(b"no")
    with pytest.raises(Exception, match="no image"):
        images.pixels(images.images(spark, str(tmp_path))).collect()
    assert images.images(spark, str(tmp_path), drop_broken=True).count() == 3


def test_low_resolution_of_even_ground(spark, tmp_path):
    color_png(tmp_path / "x.png", np.full((30, 41, 3), (10, 20, 30), np.uint8))
    low = images.low_resolution(images.images(spark, str(tmp_path / "x.png")), (4, 6)).collect()
    assert len(low) == 24 and {tuple(round(255 * v, 9) for v in (x.e1, x.e2, x.e3)) for x in low} == {(10, 20, 30)}


def test_upsampled_features_meet_the_table_operator(spark):
    size, to = (3, 4), (7, 6)
    f = np.random.default_rng(4).normal(size=(12, 2))
    rows = [(0, i // 4, i % 4, float(f[i, 0])) for i in range(12)]
    table = grid.bilinear_resize(spark.createDataFrame(rows, "image_id int, r int, c int, x double"), "x", size, to).orderBy("r", "c").collect()
    up = spectral.upsampled(f, size, to)
    assert up.shape == (42, 2) and np.allclose(up[:, 0], [x.x for x in table])
    with pytest.raises(ValueError):
        spectral.upsampled(f, (3, 5), to)


def test_laplacian_at_a_finer_grid(spark):
    f = np.abs(np.random.default_rng(5).normal(size=(12, 3)))
    features = spark.createDataFrame([(0, i, f[i].tolist()) for i in range(12)], "image_id int, patch int, k array<double>")
    rows = spectral.eigen(features, "laplacian", 3, size=(3, 4), to=(6, 8)).orderBy("k").collect()
    n = f / np.linalg.norm(f, axis=1, keepdims=True)
    want, _, _ = spectral.laplacian_eigen(spectral.upsampled(n, (3, 4), (6, 8)), 3, normalize=False)
    assert [len(x.eigenvector) for x in rows] == [48] * 3 and np.allclose([x.eigenvalue for x in rows], want) and max(x.residual for x in rows) < 1e-8
    color = spark.createDataFrame([(0, 0, 47, 0.5), (0, 47, 0, 0.5)], "image_id int, i int, j int, w double")
    assert len(spectral.with_color(features, color, 1.0, 2, size=(3, 4), to=(6, 8)).first().eigenvector) == 48


def test_affinity_below_zero_is_kept_on_request():
    f = np.array([[1.0, 0.0], [0.0, 1.0], [-0.6, 0.8]])
    w = f @ f.T
    d = w.sum(axis=1)
    value = spectral.laplacian_eigen(f, 3, lapnorm=False, clip=False)[0]
    assert np.allclose(value, np.linalg.eigvalsh(np.diag(d) - w))
    assert not np.allclose(value, spectral.laplacian_eigen(f, 3, lapnorm=False)[0])


def test_boxes_are_those_of_the_steps(spark):
    turn = np.random.default_rng(6)
    rows = [(i, r, c, int(turn.integers(0, 3))) for i in range(4) for r in range(2, 12) for c in range(3, 12) if turn.random() < 0.85]
    rows += [(9, r, c, 1 + (c > 3)) for r in range(6) for c in range(8)]
    own = spark.createDataFrame(rows, "image_id int, r int, c int, label int")
    for n_erode, n_dilate, skip in ((0, 0, True), (1, 1, True), (2, 3, False)):
        steps = masks.dilate(masks.erode(masks.masks_of(own, skip), n_erode), n_dilate).where("x = 1")
        want = sorted(tuple(x) for x in masks.segment_boxes(steps, 2, False).collect())
        assert sorted(tuple(x) for x in masks.boxes(own, n_erode, n_dilate, 2, skip).collect()) == want
    assert masks.boxes(own.limit(0)).count() == 0


def test_nearest_patches_with_ties(spark):
    side, k = 5, 4
    e = np.round(np.random.default_rng(7).random((25, 3)), 1)
    rows = [("x", i, i // side, i % side, *map(float, e[i])) for i in range(25)]
    got = graph.knn_edges(spark.createDataFrame(rows, "image_id string, patch int, r int, c int, e1 double, e2 double, e3 double"), k, 2.0, side=side).collect()
    at = np.concatenate([e, 2.0 * np.array([[i % side, i // side] for i in range(25)]) / (side - 1)], axis=1)
    far = np.round(((at[:, None] - at[None]) ** 2).sum(axis=2), 9)
    assert sorted((x.i, x.j) for x in got) == sorted((i, j) for i in range(25) for j in sorted(range(25), key=lambda j: (far[i, j], j))[:k])


def test_images_of_unlike_widths_share_a_table(spark):
    """Each image's result is that of a table which holds it alone, with its width for all; one without a width takes `side`."""
    turn, shapes = np.random.default_rng(4), {0: (4, 6), 1: (7, 3), 2: (5, 5)}
    rows = []
    for i, (h, w) in shapes.items():
        base = np.where((np.mgrid[:h, :w][1] < w // 2)[..., None], [1.0, 0.2, 0.1, -0.1], [-0.2, 1.0, -0.1, 0.3])
        rows += [(i, p, x.tolist()) for p, x in enumerate((base + turn.normal(0, 0.1, (h, w, 4))).reshape(-1, 4))]
    features = spark.createDataFrame(rows, "image_id int, patch int, k array<double>")
    grids = spark.createDataFrame([(0, 6), (1, 3)], "image_id int, w int")
    eigens = spectral.eigen(features, k=3)
    steps = [
        lambda keep, **o: spectral.single_region(eigens.where(keep), **o),
        lambda keep, **o: cluster.multi_region(eigens.where(keep), 2, **o),
        lambda keep, **o: cluster.baseline_regions(features.where(keep), 2, **o),
        lambda keep, **o: spectral.lost_box(features.where(keep), 8, **o),
    ]
    for step in steps:
        alone = [tuple(r) for i, (_, w) in shapes.items() for r in step(F.col("image_id") == i, side=w).collect()]
        together = step(F.lit(True), side=5, grids=grids)
        assert sorted(alone) == sorted(map(tuple, together.collect())) and alone
        if "r" in together.columns:
            sizes = {r.image_id: (r.h + 1, r.w + 1) for r in together.groupBy("image_id").agg(F.max("r").alias("h"), F.max("c").alias("w")).collect()}
            assert sizes == shapes


def test_lost_boxes_of_images_that_lack_patches(spark):
    """An image of 56 patches, one with holes and one whose seed has no features: parts by the patches' own places, as a plain search finds them."""
    turn = np.random.default_rng(6)
    patches = {0: list(range(56)), 1: [p for p in range(100) if p % 7 and p < 96], 2: list(range(100))}
    vectors = {i: {p: turn.normal(0.1, 1, 6) for p in ps} for i, ps in patches.items()}
    vectors[2][37] = np.zeros(6)
    rows = [(i, p, v.tolist()) for i, own in vectors.items() for p, v in own.items()]
    turn.shuffle(rows)
    got = {r.image_id: tuple(r)[1:] for r in spectral.lost_box(spark.createDataFrame([(int(i), int(p), k) for i, p, k in rows], "image_id int, patch int, k array<double>"), 50).collect()}
    for i, own in vectors.items():
        near = {p: sum(bool(own[p] @ own[q] > 0) for q in own if q != p) for p in own}
        order = sorted(own, key=lambda p: (near[p], p))[:50]
        seed = order[0]
        on = {p for p in own if sum(own[p] @ own[q] for q in order if own[seed] @ own[q] > 0) > 0}
        part, todo = {seed}, [seed] if seed in on else []
        while todo:
            p = todo.pop()
            more = {q for q in on if abs(p // 10 - q // 10) + abs(p % 10 - q % 10) == 1} - part
            part, todo = part | more, todo + list(more)
        r, c = [p // 10 for p in part], [p % 10 for p in part]
        assert got[i] == (16 * min(c), 16 * min(r), 16 * max(c) + 16, 16 * max(r) + 16)
    assert got[2] == (112, 48, 128, 64)


def test_borders_of_tall_images_are_their_own(spark):
    tall = [[1, 0, 1], [0, 0, 0], [0, 0, 0], [0, 0, 0], [1, 0, 1], [1, 1, 1]]
    own = masks.background_first(cells(spark, tall, [[0, 0], [2, 2], [2, 2]]))
    assert set(own.columns) == {"image_id", "r", "c", "label"}
    got = {(r.image_id, r.r, r.c): r.label for r in own.collect()}
    each = [masks.background_first(cells(spark, m), len(m), len(m[0])).collect() for m in (tall, [[0, 0], [2, 2], [2, 2]])]
    assert got == {(i, r.r, r.c): r.label for i, part in enumerate(each) for r in part}
