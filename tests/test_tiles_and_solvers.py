"""Tiled Gram matrices, the iterative eigensolver, the dense CRF and k-means, each against a plain version."""

import shutil
import time
from pathlib import Path

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gridspectra.functions import sql
from gridspectra.operators import cluster, crf, graph, lanczos, masks, neighbours, spectral, tiles
from gridspectra.plans import catalog, entries
from gridspectra.sources import annotations as sources


def features(spark, counts, d=5, seed=1):
    turn = np.random.default_rng(seed)
    rows = [(f"im{i}", p, turn.normal(size=d).tolist()) for i, n in enumerate(counts) for p in range(n)]
    return spark.createDataFrame(rows, "image_id string, patch int, k array<double>")


# ---- tiles


@pytest.mark.parametrize("size", [4, 7, 100])
def test_tiles_equal_edges(spark, size):
    f = features(spark, [1, 9, 20])
    own, plain = tiles.gram(f, size), graph.gram(f)
    key = lambda rows: {tuple(r[:-1]): r[-1] for r in rows}
    for a, b in (
        (tiles.edges(own), plain),
        (tiles.edges(tiles.scale_by_max(tiles.threshold(own))), graph.scale_by_max(graph.threshold(plain))),
        (tiles.degree(tiles.threshold(own)), graph.degree(graph.threshold(plain))),
        (tiles.patch_scoring(own), graph.patch_scoring(plain)),
        (tiles.similarity_sum(own, 6), graph.similarity_sum(plain, 6)),
    ):
        x, y = key(a.collect()), key(b.collect())
        assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-9 for k in x)
    assert tiles.degree(tiles.gram(f.limit(0), size)).count() == 0


# ---- eigenpairs


def clustered(n, seed=0):
    turn = np.random.default_rng(seed)
    f = turn.normal(size=(n, 16)) + 0.7 * turn.integers(0, 5, n)[:, None]
    return f / np.linalg.norm(f, axis=1, keepdims=True)


@pytest.mark.parametrize("lapnorm", [True, False])
@pytest.mark.parametrize("clip", [True, False])
def test_lanczos_agrees_with_dense(lapnorm, clip):
    f = np.abs(clustered(200)) if not clip else clustered(200)
    extra = lanczos.Edges(200, np.arange(199), np.arange(1, 200), np.ones(199))
    extra = lanczos.Edges(200, np.concatenate((extra.i, extra.j)), np.concatenate((extra.j, extra.i)), np.ones(398))
    for color in (0.0, 0.5):
        want, have = (spectral.laplacian_eigen(f, 6, False, lapnorm, extra, color, clip=clip, dense=n) for n in (10**6, 0))
        assert np.abs(want[0] - have[0]).max() < 1e-8 and np.abs(want[1] - have[1]).max() < 1e-6 and have[2].max() < 1e-6
    want, have = (spectral.affinity_eigen(f, 6, dense=n) for n in (10**6, 0))
    assert np.abs(want[0] - have[0]).max() < 1e-7 and np.abs(want[1] - have[1]).max() < 1e-6


def test_lanczos_with_equal_and_negative_values():
    turn = np.random.default_rng(3)
    q, _ = np.linalg.qr(turn.normal(size=(60, 60)))
    value = np.concatenate(([5.0] * 4, [-7.0, -7.0, 2.0], np.linspace(-1, 1, 53)))
    a = (q * value) @ q.T
    have, v = lanczos.largest(lambda x: a @ x, 60, 6)
    assert np.allclose(have, [5, 5, 5, 5, 2, 1]) and np.allclose(v.T @ v, np.eye(6), atol=1e-8)
    have, _ = lanczos.by_size(lambda x: a @ x, 60, 7)
    assert np.allclose(have, [-7, -7, 5, 5, 5, 5, 2])
    assert np.allclose(lanczos.largest(lambda x: 0 * x, 5, 9)[0], 0) and np.allclose(lanczos.largest(lambda x: 3 * x, 1, 1)[0], 3)


def test_large_image_needs_no_matrix(spark, monkeypatch):
    """4,800 patches: the dense solver is not called, and no array of patches x patches is made."""
    monkeypatch.setattr(np.linalg, "eigh", lambda a, real=np.linalg.eigh: real(a) if len(a) < 1000 else pytest.fail("dense"))
    f = clustered(4800)
    value, v, rest = spectral.laplacian_eigen(f, 5)
    assert abs(value[0]) < 1e-9 and (np.diff(value) >= -1e-12).all() and rest.max() < 1e-6 and v.shape == (4800, 5)


# ---- CRF


def picture(side, seed):
    turn = np.random.default_rng(seed)
    r, c = np.mgrid[:side, :side]
    true = ((r - 0.7 * c) > side / 10).astype(int) + ((r - side / 2) ** 2 + (c - 0.7 * side) ** 2 < side)
    color = true[..., None] * 60.0 + turn.normal(0, 6, (side, side, 3))
    label = np.where(turn.random((side, side)) < 0.15, turn.integers(0, 3, (side, side)), true)
    return true.ravel(), label.ravel(), np.stack((r.ravel(), c.ravel()), axis=1).astype(float), color.reshape(-1, 3)


@pytest.mark.parametrize("seed", range(6))
def test_lattice_agrees_with_all_pairs(seed):
    """On 10 x 10 images at least 98 of 100 labels are those of the exact filter, and the noise goes."""
    true, label, places, colors = picture(10, seed)
    args = (label, places, colors, 3, 10.0, 80.0, 13.0, 3.0, 3.0, 5, 0.9)
    fast, exact = (crf.mean_field(*args, kind) for kind in ("lattice", "pairs"))
    assert (fast.argmax(axis=1) == exact.argmax(axis=1)).mean() >= 0.98
    assert (fast.argmax(axis=1) == true).mean() > (label == true).mean()


@pytest.mark.parametrize("d", [1, 2, 5])
def test_lattice_filters(d):
    turn = np.random.default_rng(d)
    x, v = 3 * turn.random((300, d)), turn.random((300, 2))
    one = np.ones((300, 1))
    fast, exact = (run(v) / run(one) for run in (crf.Lattice(x), crf.Pairs(x)))
    lattice = crf.Lattice(x)
    assert lattice.weight.min() > -1e-9 and np.allclose(lattice.weight.sum(axis=1), 1) and np.abs(fast - exact).max() < (0.03 if d < 5 else 0.12)
    assert np.allclose(crf.Lattice(x + 17.0)(one).mean(), lattice(one).mean(), rtol=0.2)


def test_refine(spark):
    rows, want = [], {}
    for image in range(2):
        true, label, places, colors = picture(12, image)
        rows += [(f"x{image}", int(r), int(c), int(a), *map(float, col)) for (r, c), a, col in zip(places, label, colors)]
        q = crf.mean_field(label, places, colors, 3, 10.0, 80.0, 13.0, 3.0, 3.0, 5, 0.9, "lattice").argmax(axis=1)
        want |= {(f"x{image}", int(r), int(c)): int(a) for (r, c), a in zip(places, q)}
    schema = "image_id string, r int, c int, label int, red double, green double, blue double"
    own = spark.createDataFrame(rows, schema)
    assert {(x.image_id, x.r, x.c): x.label for x in crf.refine(own, 3).collect()} == want
    assert crf.refine(own.limit(0), 3).count() == 0
    one = crf.refine(spark.createDataFrame([("a", 0, 0, 0, 1.0, 1.0, 1.0)], schema), 1).collect()
    assert [x.label for x in one] == [0]
    for bad in ([("a", 0, 0, 3, 1.0, 1.0, 1.0)], [("a", 0, 0, 0, None, 1.0, 1.0)]):
        with pytest.raises(Exception, match="not all in|without a color"):
            crf.refine(spark.createDataFrame(bad, schema), 3).collect()


def test_maps_at_pixels(spark):
    cells = spark.createDataFrame([("a", r, c, 255 * (r == c)) for r in range(2) for c in range(2)] + [("b", 0, 0, 7)], "image_id string, r int, c int, label int")
    sizes = spark.createDataFrame([("a", 9, 10), ("b", 4, 4)], "image_id string, h int, w int")
    colors = spark.createDataFrame([(i, r, c, 0.0, 0.0, 0.0) for i, h, w in (("a", 9, 10), ("b", 4, 4)) for r in range(h) for c in range(w)], "image_id string, r int, c int, red double, green double, blue double")
    got = {(x.image_id, x.r, x.c): x.label for x in crf.at_pixels(cells, colors, sizes, 4).collect()}
    assert len(got) == 9 * 10 + 16 and got["b", 3, 3] == 7
    for r in range(9):
        for c in range(10):
            pr, pc = (r // 4, c // 4) if r < 8 and c < 8 else (r * 2 // 9, c * 2 // 10)
            assert got["a", r, c] == int(pr == pc)


# ---- k-means


def test_restarts_never_lose():
    turn = np.random.default_rng(2)
    inertia = lambda x, label: sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum() for c in np.unique(label))
    for trial in range(10):
        x = turn.normal(size=(80, 3)) + 4 * turn.integers(0, 6, 80)[:, None]
        alone, best = cluster.lloyd(x, 6, restarts=0), cluster.lloyd(x, 6)
        assert inertia(x, best) <= inertia(x, alone) + 1e-9 and (best == cluster.lloyd(x, 6)).all()
        means = np.stack([x[best == c].mean(axis=0) for c in np.unique(best)])
        assert (cluster.distances(x, means).argmin(axis=1) == best).all() or len(np.unique(best)) < 6
    assert len(np.unique(cluster.lloyd(np.ones((9, 2)), 4))) == 1


def test_minibatch_follows_the_plain_steps(spark):
    """Given the same batches, the centres are those of a plain loop."""
    turn = np.random.default_rng(4)
    x = turn.normal(size=(400, 3)) + 6 * turn.integers(0, 4, 400)[:, None]
    points = spark.createDataFrame([(i, x[i].tolist()) for i in range(400)], "id int, features array<double>")
    batches = 4
    dealt = {r.id: r.b for r in points.select("id", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(batches)).alias("b")).collect()}
    groups = [x[[i for i in range(400) if dealt[i] == b]] for b in range(batches)]
    centers = groups[0][cluster.drawn(groups[0], 4, np.random.default_rng(5))].copy()
    seen = np.zeros(4)
    for step in range(9):
        own = groups[step % batches]
        label = ((own[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(4):
            mine = own[label == c]
            if len(mine):
                seen[c] += len(mine)
                centers[c] += (len(mine) / seen[c]) * (mine.mean(axis=0) - centers[c])
    assert np.allclose(cluster.minibatch(points, ["id"], 4, 5, 100, steps=9, patience=99), centers)


@pytest.mark.parametrize("span", [1, 3, 16])
def test_steps_that_share_a_job_are_the_same_steps(spark, monkeypatch, span):
    """Whatever a task holds, centres are those of a plain walk to the end; a table of few batches needs one job for all steps."""
    turn = np.random.default_rng(9)
    x = turn.normal(size=(300, 3)) + 5 * turn.integers(0, 4, 300)[:, None]
    points = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "id int, features array<double>").repartition(3).cache()
    batches, steps = 3, 40
    dealt = {r.id: r.b for r in points.select("id", F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(batches)).alias("b")).collect()}
    groups = [x[[i for i in range(300) if dealt[i] == b]] for b in range(batches)]
    plain = cluster.Descent(groups[0][cluster.drawn(groups[0], 4, np.random.default_rng(0))].copy(), np.zeros(4))
    while plain.step < steps and not (plain.step >= batches and plain.stale >= 10):
        plain.take(groups[plain.step % batches], min(1.0, 200 / 301), 0.01)
    monkeypatch.setattr(cluster, "SPAN", span)
    jobs, own = [], cluster._descended
    monkeypatch.setattr(cluster, "_descended", lambda *a: jobs.append(1) or own(*a))
    assert np.allclose(cluster.minibatch(points, ["id"], 4, 0, 100, steps=steps), plain.centers)
    assert len(jobs) == (1 if span >= batches else plain.step)


@pytest.mark.parametrize("name", ["bbox_clusters", "semantic_segmap_kmeans", "entry_extract", "entry_extract_resumed"])
def test_few_boxes_are_clustered_by_one_job(spark, monkeypatch, name):
    """Steps of a table of one batch are no jobs of their own, however many there are until the end."""
    jobs, calls, own, whole = [], [], cluster._descended, cluster.minibatch
    monkeypatch.setattr(cluster, "_descended", lambda *a: jobs.append(1) or own(*a))
    monkeypatch.setattr(cluster, "minibatch", lambda *a, **o: calls.append(1) or whole(*a, **o))
    assert catalog.queries()[name](spark, f"{DATA}/sf0.1").count()
    assert len(jobs) == len(calls) > 0


def test_minibatch_edges(spark):
    points = spark.createDataFrame([(i, [float(i // 5)] * 2) for i in range(20)], "id int, features array<double>")
    centers = cluster.minibatch(points, ["id"], 4, 1)
    found = {r.id: r.cluster for r in cluster.nearest(points, centers, ["id"]).collect()}
    assert len(found) == 20 and all(found[i] == found[5 * (i // 5)] for i in range(20))
    assert len(cluster.minibatch(points.limit(2), ["id"], 9)) == 2
    assert cluster.minibatch(points.limit(0), ["id"], 3).shape == (0, 0) and cluster.nearest(points.limit(0), np.zeros((0, 0)), ["id"]).count() == 0
    assert cluster.starved(np.array([100.0, 0.0, 50.0, 0.5]), 0.01).tolist() == [1, 3]


# ---- nearest neighbours, components


def test_nearest_by_tree(monkeypatch):
    turn = np.random.default_rng(8)
    for n, d, k in ((1, 3, 4), (40, 2, 7), (500, 5, 20), (700, 3, 5)):
        x = np.round(turn.random((n, d)), 1 if n == 700 else 9)  # the last has many ties and equal points
        far = np.round(neighbours.squared(x, x), neighbours.DECIMALS)
        want = np.argsort(far, axis=1, kind="stable")[:, :k]
        for leaf in (1, 5, 32):
            monkeypatch.setattr(neighbours, "LEAF", leaf)
            assert (neighbours.nearest(x, k) == want).all()


def test_nearest_in_a_large_image():
    side = 300
    r, c = np.mgrid[:side, :side]
    x = np.stack((np.sin(r / 9), np.cos(c / 7), np.sin((r + c) / 11), r / 150, c / 150), axis=-1).reshape(-1, 5)
    near = neighbours.nearest(x, 10)
    some = np.random.default_rng(1).integers(0, len(x), 40)
    far = np.round(neighbours.squared(x[some], x), neighbours.DECIMALS)
    assert (near[some] == np.argsort(far, axis=1, kind="stable")[:, :10]).all()


def test_components_of_long_paths():
    side = 501
    snake = np.full((side, side), -1)
    snake[::2] = 1
    for k, r in enumerate(range(1, side, 2)):
        snake[r, -1 if k % 2 == 0 else 0] = 1
    for mask in (snake, snake.T.copy()):
        began = time.perf_counter()
        found = masks.label_components(mask, False)
        assert time.perf_counter() - began < 0.5 and (found[mask == 1] == 0).all() and (found[mask < 0] == -1).all()
    board = np.indices((6, 7)).sum(axis=0) % 2
    assert len(np.unique(masks.label_components(board, False))) == 42 and len(np.unique(masks.label_components(board, True))) == 2
    assert masks.label_components(np.zeros((0, 3)), True).shape == (0, 3) and masks.label_components(np.array([[5]]), True).tolist() == [[0]]


# ---- resumed extraction


def test_extraction_takes_up_what_is_there(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cluster, "minibatch", lambda *_: np.eye(4)[:3])  # has tests of its own
    turn = np.random.default_rng(3)
    rows = [(i, p, p // 10, p % 10, (turn.normal(size=4) + 3 * (p % 10 > 4)).tolist()) for i in range(4) for p in range(100)]
    f = spark.createDataFrame(rows, "image_id int, patch int, r int, c int, k array<double>")
    path, config = f"file://{tmp_path}/out", entries.Extraction(n_clusters=3)
    part = entries.extract_to(f.where("image_id < 2"), path, config)
    assert {x.image_id for x in part["maps"].select("image_id").distinct().collect()} == {0, 1}
    base = f"{tmp_path}/out/{config.name()}"
    runs = lambda stage: {x.image_id: x.run for x in spark.read.parquet(f"file://{base}/{stage}/manifest").collect()}
    before = runs("eigens")
    whole = entries.extract_to(f, path, config)
    after = runs("eigens")
    assert {i: after[i] for i in before} == before and sorted(after) == [0, 1, 2, 3]
    assert whole["eigens"].count() == 20 and whole["maps"].count() == 400
    key = lambda df: sorted(tuple(x) for x in df.collect())
    plain = key(cluster.multi_region(spectral.eigen(f, "laplacian", 5), 4).select(whole["regions"].columns))
    assert key(whole["regions"]) == plain
    # nothing to do: no file is written
    files = sorted(p for p in Path(base).rglob("*.parquet"))
    entries.extract_to(f, path, config)
    assert sorted(p for p in Path(base).rglob("*.parquet")) == files
    # rows whose manifest was lost are not read, and only that stage is computed again
    shutil.rmtree(f"{base}/regions/manifest")
    again = entries.extract_to(f, path, config)
    assert runs("eigens") == after and key(again["regions"]) == plain
    assert entries.Extraction(n_regions=5).name() != config.name()
    with pytest.raises(ValueError, match="no images"):
        entries.extract_to(f.limit(0), path)


# ---- annotations


def test_annotations_name_their_images(spark, tmp_path):
    box = "<object><name>cat</name><truncated>0</truncated><difficult>0</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object>"
    for k, name in enumerate(("<filename>2007_000027.jpg</filename>", "<filename>a.b.png</filename>", "")):
        (tmp_path / f"{k}.xml").write_text(f"<annotation>{name}{box}</annotation>")
    got = sources.voc_boxes(sources.read_voc(spark, str(tmp_path))).collect()
    assert {r.image_id for r in got} == {"2007_000027", "a.b", None} and {tuple(r)[1:] for r in got} == {("cat", 0, 1, 3, 4)}


# ---- table functions


def test_table_functions(spark):
    assert sql.register_tables(spark) == ["curve_thresholds", "grid_cells", "window_offsets"]
    spark.createDataFrame([(1, 33, 50, 16), (2, 15, 40, 16), (3, 16, 16, 8)], "id int, h int, w int, p int").createOrReplaceTempView("sizes")
    got = {tuple(r) for r in spark.sql("select id, r, c from sizes, lateral grid_cells(h, w, p)").collect()}
    assert got == {(i, r, c) for i, h, w, p in ((1, 33, 50, 16), (2, 15, 40, 16), (3, 16, 16, 8)) for r in range(h // p) for c in range(w // p)}
    assert [tuple(r) for r in spark.sql("select * from curve_thresholds(4) order by k").collect()] == [(k, k / 4) for k in range(5)]
    assert sorted(tuple(r) for r in spark.sql("select * from window_offsets(1)").collect()) == [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert spark.sql("select * from values (cast(null as int)) as t(h), lateral grid_cells(h, h, 4)").count() == 0
