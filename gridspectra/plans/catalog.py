"""All queries over the reference operators, each with its SQL twin for DuckDB where SQL can say it.

Every query takes (spark, sf_dir); values are rounded to 6 places, for the two engines add doubles in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspectra.functions import boxes as B
from gridspectra.functions import names as N
from gridspectra.functions import sql as functions
from gridspectra.functions import vectors as V
from gridspectra.operators import cluster, crf, graph, grid, masks, metrics, records, spectral, tiles
from gridspectra.plans import entries
from gridspectra.sources import annotations as A
from gridspectra.sources import files, label_files, tables
from gridspectra.sources import fixtures as X

CLASSES, SIDE = 10, X.SIDE
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"with {X.SQL}{sql}" if not sql.startswith("!") else f"with recursive {X.SQL}{sql[1:]}"
        return f

    return put


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


# ---- matched evaluation

_CNT = ", cnt as (select pred, target, count(*) as n from pix where target <> 255 group by all)"
_IOU = _CNT + """, dom as (select p::int as pred, t::int as target from range(10) a(p), range(10) b(t)),
m1 as (select pred, sum(n) as np from cnt group by 1), m2 as (select target, sum(n) as nt from cnt group by 1),
iou as (select d.pred, d.target, coalesce(n, 0) / greatest(coalesce(np, 0) + coalesce(nt, 0) - coalesce(n, 0), 1e-8) as iou from dom d left join cnt using (pred, target) left join m1 using (pred) left join m2 using (target))"""
_MATCH = _IOU + ", mat as (select pred, target, iou from (select *, row_number() over (partition by pred order by iou desc, target) as k from iou) where k = 1)"
_MAPPED = _MATCH + ", mapped as (select p.image_id, p.r, p.c, p.target, coalesce(m.target, 0)::int as pred from pix p left join mat m using (pred))"
_JAC = """, jac as (select cls::int as cls, count_if(pred = cls and target = cls) as tp, count_if(pred = cls and target <> cls) as fp, count_if(pred <> cls and target = cls) as fn
from range(10) d(cls) left join {src} on true group by cls)"""
_JC = "select cls, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) as jaccard from jac"


@query("contingency", _CNT + " select pred, target, n from cnt")
def _(s, d):
    return metrics.contingency(metrics.valid(X.pix(s, d)))


@query("cluster_class_iou", _IOU + " select pred, target, round(iou, 6) as iou from iou")
def _(s, d):
    return r6(metrics.pair_iou(metrics.contingency(metrics.valid(X.pix(s, d))), CLASSES, CLASSES), "iou")


def _ious(s, d):
    return metrics.pair_iou(metrics.contingency(metrics.valid(X.pix(s, d))), CLASSES, CLASSES)


@query("majority_match", _MATCH + " select pred, target, round(iou, 6) as iou from mat")
def _(s, d):
    return r6(metrics.majority_match(_ious(s, d)), "iou")


@query("hungarian_match", _MATCH + " select pred, target, round(iou, 6) as iou from mat")
def _(s, d):
    return r6(metrics.hungarian_match(_ious(s, d), CLASSES), "iou")


# clusters 0 and 1 both overlap most with class 0, 2 and 3 with class 2: the best one-to-one matching is another
_CROSSED = """, crossed as (select pred % 4 as pred, (case pred % 4 when 0 then (r >= 6)::int when 1 then (r >= 7)::int when 2 then 2 + (r >= 8)::int else 2 + (r >= 5)::int end) as target from pix where target <> 255),
n as (select pred, target, count(*) as n from crossed group by all), np as (select pred, sum(n) as np from n group by 1), nt as (select target, sum(n) as nt from n group by 1),
iou as (select p::int as pred, t::int as target, coalesce(n, 0) / greatest(coalesce(np, 0) + coalesce(nt, 0) - coalesce(n, 0), 1e-8) as iou
from range(4) a(p), range(4) b(t) left join n on n.pred = p and n.target = t left join np on np.pred = p left join nt on nt.target = t)"""


def _crossed(s, d):
    pred = F.col("pred") % 4
    below = lambda r: (F.col("r") >= r).cast("int")
    target = F.when(pred == 0, below(6)).when(pred == 1, below(7)).when(pred == 2, 2 + below(8)).otherwise(2 + below(5))
    cells = metrics.valid(X.pix(s, d)).select(pred.alias("pred"), target.alias("target"))
    return metrics.pair_iou(metrics.contingency(cells), 4, 4)


@query("hungarian_crossed", _CROSSED + """, best as (
select a.target as t0, b.target as t1, c.target as t2, e.target as t3 from iou a, iou b, iou c, iou e
where a.pred = 0 and b.pred = 1 and c.pred = 2 and e.pred = 3 and b.target <> a.target and c.target not in (a.target, b.target) and e.target not in (a.target, b.target, c.target)
order by a.iou + b.iou + c.iou + e.iou desc limit 1)
select pred, target, round(iou, 6) as iou from iou, best where target = case pred when 0 then t0 when 1 then t1 when 2 then t2 else t3 end""")
def _(s, d):
    return r6(metrics.hungarian_match(_crossed(s, d), 4), "iou")


@query("majority_crossed", _CROSSED + " select pred, target, round(iou, 6) as iou from (select *, row_number() over (partition by pred order by iou desc, target) as k from iou) where k = 1")
def _(s, d):
    return r6(metrics.majority_match(_crossed(s, d)), "iou")


@query("remap_preds", _MAPPED + " select image_id, r, c, target, pred from mapped")
def _(s, d):
    return metrics.remap(X.pix(s, d), metrics.majority_match(_ious(s, d))).select("image_id", "r", "c", "target", "pred")


@query("class_jaccard", _JAC.format(src="(select * from pix where target <> 255)") + _JC)
def _(s, d):
    return r6(metrics.class_jaccard(metrics.contingency(metrics.valid(X.pix(s, d))), CLASSES), "jaccard")


@query("miou", _MAPPED + _JAC.format(src="(select * from mapped where target <> 255)") + f", j as ({_JC}) select round(avg(jaccard), 5) as miou from j")
def _(s, d):
    return metrics.miou(X.pix(s, d), CLASSES).select(F.round("miou", 5).alias("miou"))


@query("miou_hungarian", _MAPPED + _JAC.format(src="(select * from mapped where target <> 255)") + f", j as ({_JC}) select round(avg(jaccard), 5) as miou from j")
def _(s, d):
    return metrics.miou(X.pix(s, d), CLASSES, "hungarian").select(F.round("miou", 5).alias("miou"))


# ---- binary masks

_IOU2 = "coalesce(count_if(pred and target) / nullif(count_if(pred or target), 0), 0)"


@query("pixel_accuracy", " select image_id, round(avg((pred = target)::int), 6) as acc from bin group by 1")
def _(s, d):
    return r6(metrics.pixel_accuracy(X.binary(s, d), "image_id"), "acc")


@query("binary_iou", f" select image_id, round({_IOU2}, 6) as iou from bin group by 1")
def _(s, d):
    return r6(metrics.binary_iou(X.binary(s, d), "image_id"), "iou")


@query("precision_recall", " select image_id, round(coalesce(count_if(pred and target) / nullif(count_if(pred), 0), 1), 6) as precision, round(coalesce(count_if(pred and target) / nullif(count_if(target), 0), 1), 6) as recall from bin group by 1")
def _(s, d):
    return r6(metrics.precision_recall(X.binary(s, d), "image_id"), "precision", "recall")


_PR = """, pr as (select image_id, i::int as i, coalesce(count_if(soft > i / 255.0::double and target) / nullif(count_if(soft > i / 255.0::double), 0), 1) as precision,
coalesce(count_if(soft > i / 255.0::double and target) / nullif(count_if(target), 0), 1) as recall from bin, range(1, 255) t(i) group by image_id, i)"""


@query("pr_curve", _PR + " select image_id, i, round(precision, 6) as precision, round(recall, 6) as recall from pr")
def _(s, d):
    return r6(metrics.pr_curve(X.binary(s, d)), "precision", "recall")


@query("f_beta_max", _PR + ", f as (select i, avg(coalesce(1.3 * precision * recall / nullif(0.3 * precision + recall, 0), 0)) as f from pr group by i) select round(max(f), 6) as f_max from f")
def _(s, d):
    return r6(metrics.f_max(X.binary(s, d)), "f_max")


@query("macro_mean", f" select round(avg(acc), 6) as acc, round(avg(iou), 6) as iou from (select image_id, avg((pred = target)::int) as acc, {_IOU2} as iou from bin group by 1)")
def _(s, d):
    p = X.binary(s, d)
    both = p.groupBy("image_id").agg(F.avg((F.col("pred") == F.col("target")).cast("double")).alias("acc"), metrics.ratio(F.count_if(F.col("pred") & F.col("target")), F.count_if(F.col("pred") | F.col("target"))).alias("iou"))
    return r6(both.agg(F.avg("acc").alias("acc"), F.avg("iou").alias("iou")), "acc", "iou")


@query("topk_accuracy", ", k as (select *, row_number() over (partition by vec_id order by score desc, class) as k from score) select round(100 * count_if(k <= 1) / (select count(distinct vec_id) from score), 6) as top1, round(100 * count_if(k <= 5) / (select count(distinct vec_id) from score), 6) as top5 from k where class = label")
def _(s, d):
    return r6(metrics.topk_accuracy(X.score(s, d)), "top1", "top5")


@query("class_argmax", ", k as (select *, row_number() over (partition by vec_id order by score desc, class) as k from score) select vec_id, class::int as class from k where k = 1")
def _(s, d):
    return X.feat(s, d).select("vec_id", V.argmax(F.slice("k", 1, 10)).alias("class"))


# ---- meters


@query("meter_rolling", """ select user_id, event_id, value, quantile_disc(value, 0.5) over w as median, round(avg(value) over w + 1e-9::double, 6) as mean, max(value) over w as max,
round(avg(value) over (partition by user_id order by ts, event_id rows unbounded preceding) + 1e-9::double, 6) as global_mean from events window w as (partition by user_id order by ts, event_id rows between 19 preceding and current row)""")
def _(s, d):
    m = metrics.rolling(X.table(s, d, "events"))
    return m.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in ("mean", "global_mean")})


@query("meter_global", " select user_id, round(sum(value * (1 + event_id % 3)) / sum(1 + event_id % 3), 6) as mean from events group by 1")
def _(s, d):
    e = X.table(s, d, "events").withColumn("n", 1 + F.col("event_id") % 3)
    return r6(metrics.weighted_mean(e, "value", "n", "user_id"), "mean")


# ---- boxes

_PAIRS = ", met as (select image_id, cls, b.x1::double x1, b.y1::double y1, b.x2::double x2, b.y2::double y2, g.x1::double g1, g.y1::double g2, g.x2::double g3, g.y2::double g4 from box b join gtb g using (image_id))"
_OVER = _PAIRS + """, o as (select image_id, cls, greatest(least(x2, g3) - greatest(x1, g1), 0) * greatest(least(y2, g4) - greatest(y1, g2), 0) as inter, x2 - x1 as w1, y2 - y1 + 1e-7::double as h1, g3 - g1 as w2, g4 - g2 + 1e-7::double as h2,
greatest(x2, g3) - least(x1, g1) as cw, greatest(y2, g4) - least(y1, g2) as ch, ((g1 + g3 - x1 - x2) ** 2 + (g2 + g4 - y1 - y2) ** 2) / 4 as rho from met),
q as (select *, w1 * h1 + w2 * h2 - inter + 1e-7::double as u, cw * ch + 1e-7::double as ca, cw ** 2 + ch ** 2 + 1e-7::double as c2, 4 / pi() ** 2 * (atan(w2 / h2) - atan(w1 / h1)) ** 2 as v from o)"""


def _met(s, d):
    g = X.gtb(s, d).select("image_id", "cls", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    return X.box(s, d).join(g, "image_id")


_FORMS = {
    "iou": "inter / u",
    "giou": "inter / u - (ca - u) / ca",
    "diou": "inter / u - rho / c2",
    "ciou": "inter / u - (rho / c2 + v * v / (v - inter / u + 1 + 1e-7::double))",
}
for _kind, _form in _FORMS.items():

    @query(f"box_{_kind}", f"{_OVER} select image_id, cls, round({_form}, 6) as {_kind} from q")
    def _(s, d, kind=_kind):
        return r6(_met(s, d).select("image_id", "cls", B.iou(B.columns(), B.columns("g_"), kind).alias(kind)), kind)


@query("box_iou_xywh", f"{_OVER} select image_id, cls, round(inter / u, 6) as iou from q")
def _(s, d):
    def center(p):
        x1, y1, x2, y2 = B.columns(p)
        return B.from_center((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)

    return r6(_met(s, d).select("image_id", "cls", B.iou(center(""), center("g_")).alias("iou")), "iou")


@query("corloc", f"{_OVER}, h as (select image_id, max((inter / u >= 0.5)::int) as hit from q where cls % 4 = 1 group by 1) select round(100 * avg(hit), 6) as corloc, count(*) as images from h")
def _(s, d):
    hit = _met(s, d).where("cls % 4 = 1").groupBy("image_id").agg(F.bool_or(B.iou(B.columns(), B.columns("g_")) >= 0.5).alias("hit"))
    return r6(hit.agg((100 * F.avg(F.col("hit").cast("double"))).alias("corloc"), F.count("*").alias("images")), "corloc")


# ---- annotations


@query("voc_gt", " select image_id, 'class' || cls as name, x1 - 1 as x1, y1 - 1 as y1, x2, y2 from gtb")
def _(s, d):
    return A.voc_boxes(X.voc(s, d))


@query("voc_gt_no_hards", " select image_id, 'class' || cls as name, x1 - 1 as x1, y1 - 1 as y1, x2, y2 from gtb where cls % 3 <> 0 and cls % 4 <> 0")
def _(s, d):
    return A.ground_truth("VOC07", X.voc(s, d), remove_hards=True)


@query("coco_gt", " select image_id::bigint as image_id, cls as category_id, round_even(x1 + 0.5, 0)::int as x1, round_even(y1 + 0.5, 0)::int as y1, round_even(x2 + 0.5, 0)::int as x2, round_even(y2 + 0.5, 0)::int as y2 from gtb where cls <> 9")
def _(s, d):
    return A.ground_truth("COCO20k", X.coco(s, d))


_HARD = """, part as (select *, row_number() over (partition by image_id order by cls) as k from gtb where image_id % 2 = 0 or cls % 3 = 0 or cls % 4 = 0)"""


@query("hard_images", " select image_id, printf('%06d.jpg', image_id) as filename from gtb where image_id % 2 = 0 or cls % 3 = 0 or cls % 4 = 0 group by image_id having bool_and(cls % 3 = 0 or cls % 4 = 0)")
def _(s, d):
    part = X.voc(s, d).withColumn("object", F.filter("object", lambda o: (F.col("image_id") % 2 == 0) | A.is_hard(o)))
    return A.hard_images(part)


@query("class_names", " select 'class' || cls as name, (row_number() over (order by min(image_id * 100 + cls)) - 1)::int as class_id from gtb group by cls")
def _(s, d):
    objects = X.gtb(s, d).select(F.concat(F.lit("class"), F.col("cls").cast("string")).alias("name"), (F.col("image_id") * 100 + F.col("cls")).alias("place"))
    return cluster.class_order(objects)


@query("coco_subset", """, wanted as (select distinct image_id * 2 as image_id from gtb)
select w.image_id::bigint as image_id, count(g.cls) as n_boxes, coalesce(sum((g.cls = 9)::int), 0)::bigint as n_crowd from wanted w left join gtb g using (image_id) group by 1""")
def _(s, d):
    names = X.gtb(s, d).select("image_id").distinct().select(N.coco_file((F.col("image_id") * 2).cast("long"), extension=".jpg").alias("name"))
    return A.coco_subset(names, X.coco(s, d)).select("image_id", F.size("boxes").cast("long").alias("n_boxes"), F.size(F.filter("boxes", lambda b: b["iscrowd"] == 1)).cast("long").alias("n_crowd"))


# ---- geometry


@query("image_sizes", " select id, h, w, p, h // p as h_patch, w // p as w_patch, h // p * p as h_pad, w // p * p as w_pad from grid")
def _(s, d):
    return grid.image_sizes(X.grid(s, d))


@query("infer_patch", " select id, p from grid")
def _(s, d):
    g = grid.image_sizes(X.grid(s, d))
    return g.select("id", grid.infer_patch(F.col("h_patch") * F.col("w_patch"), F.col("h"), F.col("w")).alias("p"))


@query("crop_to_patch", " select image_id, r, c, label from seg where r < 8 and c < 8")
def _(s, d):
    return grid.crop(X.seg(s, d), 8, 8)


@query("pad_to_patch", ", g as (select distinct image_id, r, c from (select image_id from seg), (select i::int as r from range(16) t(i)), (select j::int as c from range(16) u(j))) select image_id, r, c, coalesce(label, 0) as label from g left join seg using (image_id, r, c)")
def _(s, d):
    return grid.pad(X.seg(s, d), "label", 16, 16)


_LATTICE = ", g as (select image_id, i::int as r, j::int as c from (select distinct image_id from seg), range({h}) t(i), range({w}) u(j))"


@query("nearest_resize", _LATTICE.format(h=25, w=17) + " select g.image_id, g.r, g.c, s.label from g join seg s on s.image_id = g.image_id and s.r = least(floor(g.r * (10 / 25)), 9) and s.c = least(floor(g.c * (10 / 17)), 9)")
def _(s, d):
    return grid.nearest_resize(X.seg(s, d), "label", (SIDE, SIDE), (25, 17))


@query("hybrid_resize", _LATTICE.format(h=45, w=47) + """, t as (select *, r < 40 and c < 40 as inner_ from g) select t.image_id, t.r, t.c, s.label from t join seg s on s.image_id = t.image_id
and s.r = case when inner_ then t.r // 4 else least(floor(t.r * (10 / 45)), 9) end and s.c = case when inner_ then t.c // 4 else least(floor(t.c * (10 / 47)), 9) end""")
def _(s, d):
    return grid.hybrid_resize(X.seg(s, d), "label", (SIDE, SIDE), (45, 47), 4)


@query("bilinear_resample", """, b as (select image_id, i::int as r, j::int as c, greatest((i + 0.5) * (10 / 16) - 0.5, 0) as y, greatest((j + 0.5) * (10 / 16) - 0.5, 0) as x from (select distinct image_id from feat), range(16) t(i), range(16) u(j)),
w as (select b.image_id, b.r, b.c, f.e1 * (case when f.r = floor(y) and f.r = least(floor(y) + 1, 9) then 1 when f.r = floor(y) then 1 - (y - floor(y)) else y - floor(y) end) * (case when f.c = floor(x) and f.c = least(floor(x) + 1, 9) then 1 when f.c = floor(x) then 1 - (x - floor(x)) else x - floor(x) end) as v
from b join feat f on f.image_id = b.image_id and f.r between floor(y) and least(floor(y) + 1, 9) and f.c between floor(x) and least(floor(x) + 1, 9))
select image_id, r, c, round(sum(v), 6) as e1 from w group by all""")
def _(s, d):
    return r6(grid.bilinear_resize(X.feat(s, d).select("image_id", "r", "c", "e1"), "e1", (SIDE, SIDE), (16, 16)), "e1")


@query("center_crop", ", g as (select distinct image_id, r, c from (select image_id from seg), (select i::int as r from range(17) t(i)), (select j::int as c from range(10) u(j))) select image_id, r - 4 as r, c, coalesce(label, 0) as label from g left join seg using (image_id, r, c) where r between 4 and 13")
def _(s, d):
    return grid.center_crop(grid.pad(X.seg(s, d), "label", 17, SIDE), (17, SIDE))


@query("patch_grid", " select image_id, patch, r, c from feat")
def _(s, d):
    return grid.patch_grid(X.feat(s, d).select("image_id", "patch"), SIDE)


@query("channel_normalize", " select vec_id, round(((e1 + 1) * 127.5 / 255 - 0.485) / 0.229, 6) as x, round(greatest(least((e1 + 1) / 2, 1), 0), 6) as back from feat")
def _(s, d):
    f = X.feat(s, d).withColumn("x", grid.channel_normalize((F.col("e1") + 1) * 127.5, 0.485, 0.229))
    return r6(f.select("vec_id", "x", grid.channel_restore(F.col("x"), 0.485, 0.229).alias("back")), "x", "back")


# ---- label maps

_BF = ", bf as (select image_id, label, sum((c = 0)::int + (c = 9)::int + (r = 0)::int + (r = 9)::int) / 40.0::double as fraction from {src} group by all)"


@query("border_fraction", _BF.format(src="seg") + " select image_id, label, round(fraction, 6) as fraction from bf")
def _(s, d):
    return r6(masks.border_fraction(X.seg(s, d), SIDE, SIDE), "fraction")


@query("bg_swap", _BF.format(src="seg") + ", b as (select image_id, label as bg from (select *, row_number() over (partition by image_id order by fraction desc, label) as k from bf) where k = 1) select image_id, r, c, case when label = bg then 0 when label = 0 then bg else label end as label from seg join b using (image_id)")
def _(s, d):
    return masks.background_first(X.seg(s, d), SIDE, SIDE)


@query("unique_labels", " select image_id, label, count(*) as n from seg group by all")
def _(s, d):
    return X.seg(s, d).groupBy("image_id", "label").agg(F.count("*").alias("n"))


_B255 = ", lab as (select image_id, r, c, (case when image_id % 2 = 0 then 255 * (label > 1)::int else label end)::int as label from seg)"


def _lab(s, d):
    return X.seg(s, d).withColumn("label", F.when(F.col("image_id") % 2 == 0, 255 * (F.col("label") > 1).cast("int")).otherwise(F.col("label")))


for _rule in ("subset", "equal", "always"):

    @query(f"binarize_255_{_rule}", _B255 + " select image_id, r, c, case when label = 255 then 1 else label end as label from lab")
    def _(s, d, rule=_rule):
        return masks.binarize_255(_lab(s, d), rule)


# images of 0 and 255, of 255 alone, with another label, of 0 alone
_MIXED255 = """, mixed as (select image_id, r, c, (case image_id % 4 when 0 then 255 * ((r + c) % 2) when 1 then 255 when 2 then (case when r = 0 then 7 else 255 * (c % 2) end) else 0 end)::int as label from seg),
known as (select *, bool_and(label in (0, 255)) over (partition by image_id) as no_others, bool_or(label = 0) over (partition by image_id) and bool_or(label = 255) over (partition by image_id) as two from mixed)"""


def _mixed255(s, d):
    kind, r, c = F.col("image_id") % 4, F.col("r"), F.col("c")
    label = F.when(kind == 0, 255 * ((r + c) % 2)).when(kind == 1, 255).when(kind == 2, F.when(r == 0, 7).otherwise(255 * (c % 2))).otherwise(0)
    return X.seg(s, d).select("image_id", "r", "c", label.cast("int").alias("label"))


for _rule, _applies in (("subset", "no_others"), ("equal", "no_others and two"), ("always", "true")):

    @query(f"binarize_mixed_{_rule}", _MIXED255 + f" select image_id, r, c, (case when label = 255 and {_applies} then 1 else label end)::int as label from known")
    def _(s, d, rule=_rule):
        return masks.binarize_255(_mixed255(s, d), rule)


@query("segment_bbox", " select image_id, label, 16 * min(c) as xmin, 16 * min(r) as ymin, 16 * (max(c) + 1) as xmax, 16 * (max(r) + 1) as ymax from blk where label <> 0 group by all")
def _(s, d):
    return masks.segment_boxes(X.blk(s, d), 16)


@query("relabel", " select image_id, r, c, (case when label = 0 then 0 else (label * 7 + image_id) % 5 end)::int as label from blk")
def _(s, d):
    b = X.blk(s, d)
    mapping = b.select("image_id", "label").distinct().where("label <> 0").withColumn("cluster", ((F.col("label") * 7 + F.col("image_id")) % 5).cast("int"))
    return masks.relabel(b, mapping).select("image_id", "r", "c", "label")


def _morph(src: str, steps: list[bool]) -> str:
    out = f", m0 as (select image_id, l.label, r, c, (s.label = l.label)::int as x from {src} s join (select distinct image_id, label from {src} where label <> 0) l using (image_id))"
    for i, erode in enumerate(steps):
        f, o = ("least", 1) if erode else ("greatest", 0)
        row, col = "over (partition by image_id, label, r order by c)", "over (partition by image_id, label, c order by r)"
        near = ", ".join(f"coalesce({g}(x) {w}, {o})" for w in (row, col) for g in ("lag", "lead"))
        out += f", n{i} as (select *, {f}(x, {near}) as y from m{i}), m{i + 1} as (select image_id, label, r, c, case when max(y) over (partition by image_id, label) > 0 then y else x end as x from n{i})"
    return out


@query("erode", _morph("seg", [True]) + " select image_id, label, r, c, x from m1")
def _(s, d):
    return masks.erode(masks.masks_of(X.seg(s, d))).select("image_id", "label", "r", "c", "x")


@query("dilate", _morph("seg", [False]) + " select image_id, label, r, c, x from m1")
def _(s, d):
    return masks.dilate(masks.masks_of(X.seg(s, d))).select("image_id", "label", "r", "c", "x")


@query("erode_dilate_bbox", _morph("blk", [True, True, False, False, False]) + " select image_id, label, 16 * min(c) as xmin, 16 * min(r) as ymin, 16 * (max(c) + 1) as xmax, 16 * (max(r) + 1) as ymax from m5 where x = 1 group by all")
def _(s, d):
    return masks.boxes(X.blk(s, d), 2, 3, 16)


def _cc(diagonal: bool) -> str:
    near = "abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1" if diagonal else "abs(a.r - b.r) + abs(a.c - b.c) <= 1"
    return f"""!, e as (select a.image_id, a.r * 10 + a.c as i, b.r * 10 + b.c as j from seg a join seg b on a.image_id = b.image_id and a.label = b.label and {near}),
reach as (select image_id, i, i as j from e union select x.image_id, x.i, e.j from reach x join e on e.image_id = x.image_id and e.i = x.j),
comp as (select image_id, i, min(j)::int as component from reach group by all)
select s.image_id, s.r, s.c, s.label, component from seg s join comp on comp.image_id = s.image_id and comp.i = s.r * 10 + s.c"""


@query("connected_components_4", _cc(False))
def _(s, d):
    return masks.connected_components(X.seg(s, d))


@query("connected_components_8", _cc(True))
def _(s, d):
    return masks.connected_components(X.seg(s, d), True)


@query("largest_cc_box", "!" + _cc(True)[1:].rsplit("select s.image_id", 1)[0].rstrip() + """, n as (select s.image_id, component, count(*) as n, 16 * min(c) as xmin, 16 * min(r) as ymin, 16 * (max(c) + 1) as xmax, 16 * (max(r) + 1) as ymax from seg s join comp on comp.image_id = s.image_id and comp.i = s.r * 10 + s.c group by all)
select image_id, xmin, ymin, xmax, ymax from (select *, row_number() over (partition by image_id order by n desc, component) as k from n) where k = 1""")
def _(s, d):
    return masks.segment_boxes(masks.largest_component(masks.connected_components(X.seg(s, d), True)).withColumn("label", F.lit(1)), 16).drop("label")


# ---- vectors and graphs

_GRAM = ", gram as (select a.image_id, a.patch as i, b.patch as j, list_inner_product(a.k, b.k) as w from feat a join feat b using (image_id))"


@query("l2_normalize", ", l as (select vec_id, list_transform(k, lambda x: x * 3) as k from feat) select vec_id, round(k[1] / sqrt(list_inner_product(k, k)), 6) as first, round(list_inner_product(k, k) / list_inner_product(k, k), 6) as norm from l")
def _(s, d):
    n = X.feat(s, d).select("vec_id", V.normalize(F.transform("k", lambda x: x * 3)).alias("k"))
    return r6(n.select("vec_id", F.element_at("k", 1).alias("first"), V.norm("k").alias("norm")), "first", "norm")


def _tiles(s, d):
    # three blocks, of 34, 34 and 32 patches, so tiles lie on the diagonal and off it
    return tiles.gram(X.feat(s, d), 34)


def _ints(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("int") for n in names})


@query("gram_affinity", _GRAM + " select image_id, i, j, round(w, 6) + 0.0 as w from gram")
def _(s, d):
    return r6(graph.gram(X.feat(s, d)), "w")


@query("affinity_threshold", _GRAM + ", t as (select image_id, i, j, greatest(w, 0) as w from gram) select image_id, i, j, round(w / max(w) over (partition by image_id), 6) + 0.0 as w from t")
def _(s, d):
    return r6(_ints(tiles.edges(tiles.scale_by_max(tiles.threshold(_tiles(s, d)))), "i", "j"), "w")


@query("degree", _GRAM + " select image_id, i, round(sum(greatest(w, 0)), 6) as degree from gram group by all")
def _(s, d):
    return r6(_ints(tiles.degree(tiles.threshold(_tiles(s, d))), "i"), "degree")


def _knn(k: int, weight: float, name: str) -> str:
    dist = f"(a.e1-b.e1)*(a.e1-b.e1)+(a.e2-b.e2)*(a.e2-b.e2)+(a.e3-b.e3)*(a.e3-b.e3)+({weight}::double*a.c/9-{weight}::double*b.c/9)**2+({weight}::double*a.r/9-{weight}::double*b.r/9)**2"
    return f", {name} as (select image_id, i, j from (select a.image_id, a.patch as i, b.patch as j, row_number() over (partition by a.image_id, a.patch order by round({dist}, 9), b.patch) as k from feat a join feat b using (image_id)) where k <= {k})"


@query("knn_affinity", _knn(20, 2.0, "k1") + _knn(10, 0.1, "k2") + ", e as (select * from k1 union all select * from k2) select image_id, i, j, count(*) as w from (select image_id, i, j from e union all select image_id, j, i from e) group by all")
def _(s, d):
    return graph.knn_affinity(X.feat(s, d))


@query("window_affinity", " select a.image_id, a.patch as i, b.patch as j, round(exp(-((a.e1-b.e1)**2+(a.e2-b.e2)**2+(a.e3-b.e3)**2)/(0.5::double*0.5)), 6) as w from feat a join feat b on a.image_id = b.image_id and abs(a.r-b.r) <= 1 and abs(a.c-b.c) <= 1")
def _(s, d):
    return r6(graph.window_affinity(X.feat(s, d), sigma=0.5), "w")


@query("symmetrize_edges", _knn(20, 2.0, "k1") + " select image_id, i, j, count(*) as w from (select image_id, i, j from k1 union all select image_id, j, i from k1) group by all")
def _(s, d):
    return graph.symmetrize(graph.knn_edges(X.feat(s, d)))


_SCORE = _GRAM + ", sc as (select image_id, i, -count_if(w > 0 and i <> j) as score from gram group by all)"
_SEED = _SCORE + ", rk as (select *, row_number() over (partition by image_id order by score desc, i) as rank from sc), sd as (select image_id, i as seed from rk where rank = 1), sim as (select r.image_id, r.i, r.rank, s.seed from rk r join sd s using (image_id) join gram g on g.image_id = r.image_id and g.i = s.seed and g.j = r.i where g.w > 0 and rank <= 50)"


@query("patch_scoring", _SCORE + " select image_id, i, score::bigint as score from sc")
def _(s, d):
    return _ints(tiles.patch_scoring(_tiles(s, d)), "i")


@query("lost_seed_potentials", _SEED + " select image_id, i, rank::int as rank, seed from sim")
def _(s, d):
    return graph.seed_and_similar(graph.gram(X.feat(s, d)), 50)


@query("similarity_sum", _SEED + " select g.image_id, g.j, round(sum(g.w), 6) as m from gram g join sim using (image_id, i) group by all")
def _(s, d):
    return r6(_ints(tiles.similarity_sum(_tiles(s, d), 50), "j"), "m")


@query("attention_mass_mask", " select image_id, patch, r, c, round(w, 6) as w, sum(w) over (partition by image_id order by w, patch rows unbounded preceding) / sum(w) over (partition by image_id) > 0.4 as \"on\" from att")
def _(s, d):
    return r6(graph.attention_mask(X.att(s, d)), "w")


# ---- spectral kernels; the twins state what must hold of every image


_AFF = """, un as (select image_id, patch, list_transform(k, lambda x: x / sqrt(list_inner_product(k, k))) as k from feat),
w0 as (select a.image_id, a.patch as i, b.patch as j, greatest(list_inner_product(a.k, b.k), 0) as w from un a join un b using (image_id)),
aff as (select image_id, i, j, w / max(w) over (partition by image_id) as w from w0)"""
# All eigenpairs of an image fix, patch by patch, the diagonals of what they are made of:
# sum v^2 = 1 / d and sum l v^2 = (d - w_ii) / d^2 for (D - W) v = l D v.
_DIAGONALS = "select image_id, i::int as patch, round(1 / d, 5) + 0.0 as weight, round((d - w_ii) / (d * d), 5) + 0.0 as weighted from (select image_id, i, sum(w) as d, sum(case when i = j then w end) as w_ii from {src} group by all)"


def _diagonals(e: DataFrame, power: int = 1) -> DataFrame:
    v = e.select("image_id", "eigenvalue", F.posexplode("eigenvector").alias("patch", "v"))
    total = lambda p: (F.round(F.sum(F.pow("eigenvalue", F.lit(p)) * F.col("v") * F.col("v")), 5) + 0.0)
    return v.groupBy("image_id", "patch").agg(total(power - 1).alias("weight"), total(power).alias("weighted"))


@query("laplacian_eigs", _AFF + " " + _DIAGONALS.format(src="aff"))
def _(s, d):
    return _diagonals(spectral.eigen(X.feat(s, d), "laplacian", SIDE * SIDE))


@query("laplacian_lanczos")
def _(s, d):
    e = spectral.eigen(X.feat(s, d), "laplacian", 5, dense=0)
    return r6(e.select("image_id", "k", "eigenvalue"), "eigenvalue")


@query("affinity_eigs", _AFF + " select image_id, i::int as patch, round(sum(case when i = j then w end), 5) + 0.0 as weight, round(sum(w * w), 5) + 0.0 as weighted from w0 group by all")
def _(s, d):
    return _diagonals(spectral.eigen(X.feat(s, d), "affinity", SIDE * SIDE), 2)


@query("affinity_svd", _GRAM + " select image_id, round(sum(w * w), 2) as fourth from gram group by 1")
def _(s, d):
    e = spectral.eigen(X.feat(s, d), "affinity_svd", 64)
    return e.groupBy("image_id").agg(F.round(F.sum(F.pow("eigenvalue", 4)), 2).alias("fourth"))


_COLOR = _AFF + _knn(20, 2.0, "k1") + _knn(10, 0.1, "k2") + """, e as (select * from k1 union all select * from k2), near as (select image_id, i, j, count(*) as n from (select image_id, i, j from e union all select image_id, j, i from e) group by all),
both_ as (select a.image_id, a.i, a.j, a.w + 10 * coalesce(n, 0) as w from aff a left join near using (image_id, i, j))"""


@query("color_laplacian", _COLOR + " " + _DIAGONALS.format(src="both_"))
def _(s, d):
    f = X.feat(s, d)
    return _diagonals(spectral.with_color(f, graph.knn_affinity(f), 10.0, SIDE * SIDE))


@query("sign_rule", """, v as (select image_id, k, list(x order by patch) as v from (select image_id, patch, unnest([1, 2, 3]) as k, unnest([e1, e2, abs(e3)]) as x from feat) group by all),
t as (select *, len(list_filter(v, lambda x: x > 0)) / len(v) as share, list_max(list_transform(v, lambda x: abs(x))) as far from v)
select image_id, k, i - 1 as patch, round(case when share > 0.5 and share < 1 or share in (0, 0.5, 1) and list_filter(v, lambda x: abs(x) = far)[1] < 0 then -v[i] else v[i] end, 6) + 0.0 as v from t, (select unnest(range(1, 101))::int as i)""")
def _(s, d):
    each = X.feat(s, d).select("image_id", "patch", F.posexplode(F.array("e1", "e2", F.abs("e3"))).alias("k", "x")).withColumn("k", F.col("k") + 1)
    held = each.groupBy("image_id", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("patch", "x"))), lambda p: p["x"]).alias("v"))
    # a row for every place of a whole image, null beyond the last patch
    places = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.get("v", i))
    return r6(spectral.turned(held, "v").select("image_id", "k", F.posexplode(places).alias("patch", "v")), "v")


@query("single_region_seg")
def _(s, d):
    return spectral.single_region(spectral.eigen(X.feat(s, d), "laplacian", 5))


@query("eigengap_clusters", """, e as (select image_id, patch as k, sum(abs(e1)) over (partition by image_id order by patch) as l from feat where patch < 12),
g as (select image_id, k, lead(l) over (partition by image_id order by k) - l as gap from e)
select image_id, k + 1 as n_clusters from (select *, row_number() over (partition by image_id order by gap desc, k) as n from g where k > 0 and gap is not null) where n = 1""")
def _(s, d):
    rising = F.sum(F.abs("e1")).over(Window.partitionBy("image_id").orderBy("patch"))
    return graph.eigengap_clusters(X.feat(s, d).where("patch < 12").select("image_id", F.col("patch").alias("k"), rising.alias("eigenvalue")))


@query("eigen_bbox")
def _(s, d):
    return spectral.mask_box(spectral.single_region(spectral.eigen(X.feat(s, d), "laplacian", 2)))


_LOST = _SEED + """, mm as (select g.image_id, g.j, sum(g.w) as m from gram g join sim using (image_id, i) group by all), pos as (select image_id, j as i from mm where m > 0),
nb as (select a.image_id, a.i, b.i as j from pos a join pos b on a.image_id = b.image_id and abs(a.i // 10 - b.i // 10) + abs(a.i % 10 - b.i % 10) = 1),
part as (select image_id, seed as i from sd union select p.image_id, nb.j from part p join nb on nb.image_id = p.image_id and nb.i = p.i),
lost as (select image_id, (16 * min(i % 10))::int as x1, (16 * min(i // 10))::int as y1, (16 * (max(i % 10) + 1))::int as x2, (16 * (max(i // 10) + 1))::int as y2 from part group by 1)"""
_SIZES = ", sizes as (select distinct image_id, 150 + image_id % 11 as h, 150 + image_id % 7 as w from feat)"
_CLIPPED = _SIZES + ", clipped as (select image_id, x1, y1, least(x2, w)::int as x2, least(y2, h)::int as y2 from lost join sizes using (image_id))"


def _sizes(s, d):
    return X.feat(s, d).select("image_id").distinct().select("image_id", (150 + F.col("image_id") % 11).alias("h"), (150 + F.col("image_id") % 7).alias("w"))


@query("lost_bbox", "!" + _LOST + " select * from lost")
def _(s, d):
    return spectral.lost_box(X.feat(s, d), 50)


@query("lost_bbox_clipped", "!" + _LOST + _CLIPPED + " select * from clipped")
def _(s, d):
    return spectral.lost_box(X.feat(s, d), 50, images=_sizes(s, d))


@query("box_to_image", """, im as (select image_id, 80 + image_id % 8 + 80 * (image_id % 2) as h, 80 + image_id % 5 + 80 * (image_id % 2) as w, 8 * (1 + image_id % 2) as p from (select distinct image_id from feat))
select b.image_id, min(c) * p as x1, min(r) * p as y1, least((max(c) + 3) * p, w)::int as x2, least((max(r) + 3) * p, h)::int as y2 from blk b join im using (image_id) where label = 4 group by b.image_id, p, w, h""")
def _(s, d):
    images = X.feat(s, d).select("image_id").distinct().select("image_id", *[(80 + F.col("image_id") % n + 80 * (F.col("image_id") % 2)).alias(c) for c, n in (("h", 8), ("w", 5))])
    own = masks.segment_boxes(X.blk(s, d)).where("label = 4").select("image_id", F.col("xmin").alias("x1"), F.col("ymin").alias("y1"), (F.col("xmax") + 2).alias("x2"), (F.col("ymax") + 2).alias("y2"), F.lit(SIDE * SIDE).alias("cells"))
    return masks.to_image(own, images, "cells")


_ATT = """, hots as (select image_id, patch as i, sum(w) over (partition by image_id order by w, patch rows unbounded preceding) / sum(w) over (partition by image_id) > 0.4 as hot from att), pos as (select image_id, i from hots where hot),
nb as (select a.image_id, a.i, b.i as j from pos a join pos b on a.image_id = b.image_id and abs(a.i // 10 - b.i // 10) + abs(a.i % 10 - b.i % 10) <= 1),
reach as (select image_id, i, i as j from nb union select x.image_id, x.i, nb.j from reach x join nb on nb.image_id = x.image_id and nb.i = x.j),
comp as (select image_id, i, min(j) as part from reach group by all), sz0 as (select image_id, part, count(*) as n from comp group by all), sz as (select *, row_number() over (partition by image_id order by part desc) as last, count(*) over (partition by image_id) as parts from sz0)"""
_ATT_BOX = "select image_id, (16 * min(i % 10))::int as x1, (16 * min(i // 10))::int as y1, (16 * (max(i % 10) + 1))::int as x2, (16 * (max(i // 10) + 1))::int as y2 from {src} group by 1"


@query("dinoseg_bbox", "!" + _ATT + ", one as (select image_id, part from (select *, row_number() over (partition by image_id order by n desc, part) as k from sz) where k = 1), own as (select image_id, i from comp join one using (image_id, part)) " + _ATT_BOX.format(src="own"))
def _(s, d):
    return spectral.attention_box(X.att(s, d))


@query("dinoseg_bbox_compat", "!" + _ATT + ", one as (select image_id, part from (select *, row_number() over (partition by image_id order by n desc, part) as k from sz where last > 1) where k = 1), own as (select image_id, i from comp join one using (image_id, part) union all select a.image_id, a.i from hots a join (select distinct image_id from sz where parts = 1) using (image_id) where not hot) " + _ATT_BOX.format(src="own"))
def _(s, d):
    return spectral.attention_box(X.att(s, d), compat=True)


@query("multi_region_seg")
def _(s, d):
    return cluster.multi_region(spectral.eigen(X.feat(s, d), "laplacian", 5))


@query("multi_region_adaptive")
def _(s, d):
    return cluster.multi_region(spectral.eigen(X.feat(s, d), "laplacian", 6), adaptive=True)


def _box_features(s, d):
    own = masks.segment_boxes(X.blk(s, d))
    return cluster.box_features(own, X.feat(s, d))


@query("bbox_features", ", b as (select image_id, label, min(c) as x1, min(r) as y1, max(c) as x2, max(r) as y2 from blk where label <> 0 group by all), u as (select image_id, r, c, unnest(range(64))::int as d, unnest(k) as x from feat) select b.image_id, b.label, d, round(avg(x), 6) + 0.0 as x from b join u f on f.image_id = b.image_id and f.c between x1 and x2 and f.r between y1 and y2 group by all")
def _(s, d):
    return r6(_box_features(s, d).select("image_id", "label", F.posexplode("features").alias("d", "x")), "x")


@query("baseline_regions")
def _(s, d):
    return cluster.baseline_regions(X.feat(s, d))


def _settled(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Whether each point (image_id, patch, x) is nearest to the mean of its own label's points; computed from the labels alone."""
    own = cells.select("image_id", (F.col("r") * SIDE + F.col("c")).cast("int").alias("patch"), "label").join(points, ["image_id", "patch"])
    means = own.select("image_id", "label", F.posexplode("x").alias("d", "x")).groupBy("image_id", "label", "d").agg(F.avg("x").alias("x"))
    means = means.groupBy("image_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda t: t["x"]).alias("mean"))
    gap = F.aggregate(F.zip_with("x", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    each = own.join(means.select("image_id", F.col("label").alias("other"), "mean"), "image_id").withColumn("gap", gap)
    return each.groupBy("image_id", "patch").agg((F.min(F.when(F.col("label") == F.col("other"), F.col("gap"))) <= F.min("gap") + 1e-9).alias("nearest"), F.countDistinct("other").cast("int").alias("regions"))


@query("baseline_regions_settled", " select image_id, patch, true as nearest, 4 as regions from feat")
def _(s, d):
    f = X.feat(s, d)
    return _settled(cluster.baseline_regions(f, infer_background=False), f.select("image_id", "patch", F.col("k").alias("x")))


@query("multi_region_settled", " select image_id, patch, true as nearest, 4 as regions from feat")
def _(s, d):
    e = spectral.eigen(X.feat(s, d), "laplacian", 5)
    v = e.where("k > 0").select("image_id", "k", F.posexplode("eigenvector").alias("patch", "v"))
    return _settled(cluster.multi_region(e, infer_background=False), v.groupBy("image_id", "patch").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda t: t["v"]).alias("x")))


@query("bbox_clusters")
def _(s, d):
    return cluster.box_clusters(_box_features(s, d), 5)


@query("pca_project", ", b as (select image_id, label, min(c) as x1, min(r) as y1, max(c) as x2, max(r) as y2 from blk where label <> 0 group by all), u as (select image_id, r, c, unnest(range(64)) as d, unnest(k) as x from feat), m as (select b.image_id, b.label, d, avg(x) as x from b join u f on f.image_id = b.image_id and f.c between x1 and x2 and f.r between y1 and y2 group by all) select image_id, label, round(sum(x * x), 6) as square from m group by all")
def _(s, d):
    # all 64 directions are a turn of the space, which keeps lengths
    return r6(cluster.pca(_box_features(s, d), 64).select("image_id", "label", F.aggregate("features", F.lit(0.0), lambda t, x: t + x * x).alias("square")), "square")


@query("semantic_segmap", " select image_id, r, c, (case when label = 0 then 0 else (label * 3 + image_id) % 5 + 1 end)::int as label from blk")
def _(s, d):
    b = X.blk(s, d)
    clusters = b.select("image_id", "label").distinct().where("label <> 0").withColumn("cluster", ((F.col("label") * 3 + F.col("image_id")) % 5).cast("int"))
    return cluster.semantic_maps(b, clusters, 1).select("image_id", "r", "c", "label")


@query("semantic_segmap_kmeans")
def _(s, d):
    return cluster.semantic_maps(X.blk(s, d), cluster.box_clusters(_box_features(s, d), 5), 1)


# ---- refinement


def _pixels(s, d):
    color = [(100 * F.col(e)).alias(name) for e, name in (("e1", "red"), ("e2", "green"), ("e3", "blue"))]
    return X.feat(s, d).select("image_id", "r", "c", (F.col("label") % 3).cast("int").alias("label"), *color)


# one update over all pairs of an image's pixels, with both kernels normalized on both sides
_CRF = """, px as (select image_id, patch, r, c, label % 3 as label, 100 * e1 as x, 100 * e2 as y, 100 * e3 as z from feat),
ker as (select a.image_id, a.patch as i, b.patch as j, exp(-((a.r-b.r)**2 + (a.c-b.c)**2) / (2 * 16.0::double) - ((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) / (2 * 400.0::double)) as both_,
  exp(-((a.r-b.r)**2 + (a.c-b.c)**2) / (2 * 2.25::double)) as near from px a join px b using (image_id)),
nrm as (select image_id, i, 1 / sqrt(sum(both_)) as nb, 1 / sqrt(sum(near)) as nn from ker group by all),
q0 as (select image_id, patch as j, l::int as lab, case when l = label then 0.9 else 0.05 end::double as q from px, range(3) t(l)),
msg as (select k.image_id, k.i, q.lab, sum(10 * a.nb * b.nb * k.both_ * q.q + 3 * a.nn * b.nn * k.near * q.q) as m
  from ker k join q0 q on q.image_id = k.image_id and q.j = k.j join nrm a on a.image_id = k.image_id and a.i = k.i join nrm b on b.image_id = k.image_id and b.i = k.j group by all),
up as (select m.image_id, m.i, m.lab, q.q * exp(m.m) as q from msg m join q0 q on q.image_id = m.image_id and q.j = m.i and q.lab = m.lab)"""


@query("crf_step", _CRF + " select image_id, (i // 10)::int as r, (i % 10)::int as c, lab as label, round(q / sum(q) over (partition by image_id, i), 6) + 0.0 as q from up")
def _(s, d):
    return r6(crf.probabilities(_pixels(s, d), 3, alpha=4.0, beta=20.0, gamma=1.5, steps=1, kind="pairs"), "q")


@query("crf_refine")
def _(s, d):
    return crf.refine(_pixels(s, d), 3, alpha=4.0, beta=20.0, gamma=1.5)


# ---- records


@query("split_qkv", " select image_id, patch - 1 as patch, k[25] as first, k[48] as last from feat where patch > 0")
def _(s, d):
    tokens = X.feat(s, d).select("image_id", F.col("patch").alias("token"), F.concat(F.slice("k", 1, 48), F.slice("k", 1, 24)).alias("qkv"))
    k = records.split_qkv(tokens, 24)
    return k.select("image_id", "patch", F.element_at("k", 1).alias("first"), F.element_at("k", -1).alias("last"))


@query("mask_binarize", " select image_id, r, c, floor((e1 + 1) * 127.5) / 255 > 0.5 as x from feat")
def _(s, d):
    return X.feat(s, d).select("image_id", "r", "c", masks.first_channel_mask(F.floor((F.col("e1") + 1) * 127.5)).alias("x"))


@query("contains_class", ", lab as (select *, (case when image_id % 2 = 0 then label else least(label, 2) end)::int as l from seg) select image_id, r, c, l as label from lab where image_id in (select image_id from lab where l = 3)")
def _(s, d):
    lab = X.seg(s, d).withColumn("label", F.when(F.col("image_id") % 2 == 0, F.col("label")).otherwise(F.least("label", F.lit(2))))
    return masks.with_class(lab, 3)


@query("total_boxes", " select count(*) as n from gtb")
def _(s, d):
    return records.total_boxes(X.gtb(s, d).groupBy("image_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("bboxes")))


@query("rows_to_lists", " select image_id, list(cls order by cls) as cls, list(x1 order by cls) as x1 from gtb group by 1")
def _(s, d):
    return records.to_lists(X.gtb(s, d).withColumn("place", F.col("cls")), "place", "cls", "x1", keys=("image_id",))


@query("lists_to_rows", " select image_id, (row_number() over (partition by image_id order by cls) - 1)::int as place, cls, x1 from gtb")
def _(s, d):
    lists = records.to_lists(X.gtb(s, d).withColumn("place", F.col("cls")), "place", "cls", "x1", keys=("image_id",))
    return records.to_rows(lists, "cls", "x1", keys=("image_id",))


@query("parse_matching", ", o as (select o_orderkey, (o_orderkey % 10)::int as a, (o_custkey % 10)::int as b from orders) select o_orderkey, 0 as place, a as pred, b as target from o union all select o_orderkey, 1, b, a from o")
def _(s, d):
    a, b = F.col("o_orderkey") % 10, F.col("o_custkey") % 10
    text = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("[(%d, %d), (%d, %d)]", a, b, b, a)).otherwise(F.format_string("[[%d, %d], [%d, %d]]", a, b, b, a))
    return X.table(s, d, "orders").select("o_orderkey", F.posexplode(records.parse_matching(text)).alias("place", "m")).select("o_orderkey", "place", "m.pred", "m.target")


# ---- whole runs


@query("entry_semantic", _MAPPED + _JAC.format(src="(select * from mapped where target <> 255)") + f", j as ({_JC}) select cls, tp, fp, fn, jaccard, round(avg(jaccard) over (), 5) as miou from j")
def _(s, d):
    p = X.pix(s, d)
    out = entries.evaluate_semantic(p.drop("target"), p.drop("pred"), CLASSES)
    return r6(out, "jaccard").withColumn("miou", F.round("miou", 5))


@query("entry_objects", f" select dataset, round(avg(acc), 6) as acc, round(avg(iou), 6) as iou, count(*) as images from (select image_id % 4 as dataset, image_id, avg((pred = target)::int) as acc, {_IOU2} as iou from bin group by all) group by 1")
def _(s, d):
    b = X.binary(s, d).withColumn("dataset", F.col("image_id") % 4)
    preds = b.select("dataset", "image_id", "r", "c", (F.col("pred").cast("int") * F.when(F.col("image_id") % 2 == 0, 255).otherwise(1)).alias("pred")).where("pred > 0")
    return r6(entries.evaluate_objects(preds, b.drop("pred")), "acc", "iou")


_LOCATED = _LOST + _CLIPPED + """, m as (select image_id, c.x1, c.y1, c.x2, c.y2, greatest(least(c.x2, g.x2) - greatest(c.x1, g.x1), 0)::double * greatest(least(c.y2, g.y2) - greatest(c.y1, g.y1), 0) as inter,
(c.x2 - c.x1) * (c.y2 - c.y1 + 1e-7::double) as a1, (g.x2 - g.x1) * (g.y2 - g.y1 + 1e-7::double) as a2 from clipped c join gtb g using (image_id))"""


@query("entry_localize", "!" + _LOCATED + " select image_id, x1, y1, x2, y2, round(max(inter / (a1 + a2 - inter + 1e-7::double)), 6) as iou, max(inter / (a1 + a2 - inter + 1e-7::double)) >= 0.5 as hit from m group by all")
def _(s, d):
    return r6(entries.localize(X.feat(s, d), X.gtb(s, d), _sizes(s, d), k=50), "iou")


# boxes that the image's edge cuts are hard; images without others count as missed
@query("entry_localize_all", "!" + _LOST + _CLIPPED + """, inner_boxes as (select * from gtb where x1 > 0 and y1 > 0 and x2 < 160 and y2 < 160),
m as (select c.image_id, c.x1, c.y1, c.x2, c.y2, case when g.x1 is null then 0 else greatest(least(c.x2, g.x2) - greatest(c.x1, g.x1), 0)::double * greatest(least(c.y2, g.y2) - greatest(c.y1, g.y1), 0) end as inter,
(c.x2 - c.x1) * (c.y2 - c.y1 + 1e-7::double) as a1, coalesce((g.x2 - g.x1) * (g.y2 - g.y1 + 1e-7::double), 0) as a2 from clipped c left join inner_boxes g using (image_id))
select image_id, x1, y1, x2, y2, round(max(inter / (a1 + a2 - inter + 1e-7::double)), 6) as iou, max(inter / (a1 + a2 - inter + 1e-7::double)) >= 0.5 as hit from m group by all""")
def _(s, d):
    whole = F.expr("x1 > 0 and y1 > 0 and x2 < 160 and y2 < 160")
    return r6(entries.localize(X.feat(s, d), X.gtb(s, d).where(whole), _sizes(s, d), k=50, no_hard=False), "iou")


@query("label_files", " select image_id::varchar as id, r, c, label from seg")
def _(s, d):
    path = tables.shared_dir(s)
    label_files.write_label_maps(X.seg(s, d).withColumnRenamed("image_id", "id"), path)
    return label_files.read_label_maps(s, path)


@query("grid_cells_sql", " select image_id, r::int as r, c::int as c from (select image_id, 96 + label_sum % 64 as h, 96 + label_sum % 48 as w from (select image_id, sum(label)::int as label_sum from feat group by 1)), lateral (select unnest(range(h // 16)) as r) a, lateral (select unnest(range(w // 16)) as c) b")
def _(s, d):
    functions.register_tables(s)
    sums = X.feat(s, d).groupBy("image_id").agg(F.sum("label").alias("n"))
    sums.selectExpr("image_id", "cast(96 + n % 64 as int) h", "cast(96 + n % 48 as int) w").createOrReplaceTempView("grid_of_images")
    return s.sql("select image_id, r, c from grid_of_images, lateral grid_cells(h, w, 16)")


@query("entry_extract")
def _(s, d):
    return entries.extract(X.feat(s, d), n_clusters=5)["maps"]


@query("entry_extract_resumed", " select image_id, count(*) as cells, 5::bigint as vectors from feat group by image_id")
def _(s, d):
    # the images with even ids first, then all: the second call takes up what the first left
    f, path = X.feat(s, d), tables.shared_dir(s)
    config = entries.Extraction(n_clusters=5)
    entries.extract_to(f.where("image_id % 2 = 0"), path, config)
    out = entries.extract_to(f, path, config)
    vectors = out["eigens"].groupBy("image_id").agg(F.count("*").alias("vectors"))
    return out["maps"].groupBy("image_id").agg(F.count("*").alias("cells")).join(vectors, "image_id")


# ---- splits, sets, names


def _stems(s, d):
    return X.grid(s, d).select(F.col("id").alias("image_id"), F.format_string("VOC/%08d.jpg", "id").alias("path"))


@query("train_split_antijoin", " select id as image_id, printf('VOC/%08d.jpg', id) as path from grid where id % 7 <> 3")
def _(s, d):
    every = _stems(s, d).withColumn("stem", N.stem(F.col("path")))
    return files.train_split(every, every.where("image_id % 7 = 3").select("stem"), "stem").select("image_id", "path")


@query("val_split_semijoin", " select id as image_id, printf('VOC/%08d.jpg', id) as path from grid where id % 7 = 3")
def _(s, d):
    every = _stems(s, d).withColumn("stem", N.stem(F.col("path")))
    return files.validation_split(every, every.where("image_id % 7 = 3").select("stem"), "stem").select("image_id", "path")


@query("distinct_sorted_images", " select distinct printf('img_%04d.jpg', user_id) as path from events")
def _(s, d):
    return X.table(s, d, "events").select(F.format_string("img_%04d.jpg", "user_id").alias("path")).distinct().orderBy("path")


@query("pair_by_key", " select g.id, h, w, o_totalprice as area from grid g join orders on o_orderkey = g.id")
def _(s, d):
    return files.pair_by_key(X.grid(s, d).select("id", "h", "w"), X.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("area")))


@query("skip_existing", " select id, h, w, p from grid where p = 8")
def _(s, d):
    g = X.grid(s, d)
    return files.not_yet_written(g, g.where("p = 16"), "id")


@query("file_names", " select id, printf('%08d', id) as stem, id as number, printf('COCO_train2014_%012d.pth', id) as record from grid")
def _(s, d):
    n = _stems(s, d)
    return n.select(F.col("image_id").alias("id"), N.stem(F.col("path")).alias("stem"), N.coco_number(N.coco_file(F.col("image_id"), extension=".jpg")).alias("number"), N.coco_file(F.col("image_id")).alias("record"))


@query("label_domain", " select image_id, list_sort(list(distinct label)) = [0, 1, 2, 3] as full_domain, list_sort(list(distinct label))[1] as least from seg group by 1")
def _(s, d):
    own = X.seg(s, d).groupBy("image_id").agg(F.array_sort(F.collect_set("label")).alias("own"))
    return own.select("image_id", (F.size(F.array_except("own", F.array(*map(F.lit, range(4))))) == 0).alias("full_domain") & (F.size("own") == 4).alias("x"), F.element_at("own", 1).alias("least")).toDF("image_id", "full_domain", "least")


@query("segmap_width", " select id, case when id % 2 = 0 then w // p else 2 * (w // p) end as width from grid")
def _(s, d):
    g = grid.image_sizes(X.grid(s, d))
    cells = F.col("h_patch") * F.col("w_patch") * F.when(F.col("id") % 2 == 0, 1).otherwise(4)
    return g.select("id", grid.segmap_width(cells, F.col("h_patch"), F.col("w_patch")).cast("int").alias("width"))


@query("sql_functions", f"{_OVER} select image_id, cls, round(inter / u, 6) as iou from q")
def _(s, d):
    functions.register(s)
    args = ", ".join(f"double({p}{n})" for p in ("", "g_") for n in ("x1", "y1", "x2", "y2"))
    return r6(_met(s, d).selectExpr("image_id", "cls", f"box_iou({args}) as iou"), "iou")


# ---- bench only


@query("pixel_contingency_large", " select l_orderkey % 64 as image_id, l_linenumber as pred, (1 + l_suppkey % 7) as target, count(*) as n from lineitem group by all")
def _(s, d):
    pixels = X.table(s, d, "lineitem").select((F.col("l_orderkey") % 64).alias("image_id"), F.col("l_linenumber").alias("pred"), (1 + F.col("l_suppkey") % 7).alias("target"))
    return metrics.contingency(pixels, ("image_id",))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
