"""Detection post-processing: overlaps, suppression, decoding, crops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes, 0 if the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def iou_pairs(boxes: DataFrame, image: str, id_: str, least: float) -> DataFrame:
    """Overlapping pairs of boxes of one image: image, a, b, iou. Boxes of an image are few; the join is by image."""
    left = boxes.select(F.col(image), *[F.col(c).alias(f"a_{c}") for c in (id_, "x", "y", "w", "h")])
    right = boxes.select(F.col(image).alias("_image"), *[F.col(c).alias(f"b_{c}") for c in (id_, "x", "y", "w", "h")])
    pairs = left.join(right, (F.col(image) == F.col("_image")) & (F.col(f"a_{id_}") < F.col(f"b_{id_}")))
    value = iou(*[F.col(f"{s}_{c}") for s in "ab" for c in "xywh"])
    return pairs.select(image, F.col(f"a_{id_}").alias("a"), F.col(f"b_{id_}").alias("b"), value.alias("iou")).where(F.col("iou") > least)


def nms(boxes: DataFrame, image: str, id_: str, most: float = 0.35) -> DataFrame:
    """Greedy suppression in each image: boxes by falling score, ties by id, that overlap no kept one by more than most.

    A fold over the image's sorted boxes as an array, all in expressions.
    """
    kept_type = f"array<struct<score:double,{id_}:{boxes.schema[id_].dataType.simpleString()},x:double,y:double,w:double,h:double>>"
    box = F.struct((-F.col("score").cast("double")).alias("order"), F.col(id_).alias("tie"), F.struct(F.col("score").cast("double").alias("score"), id_, *[F.col(c).cast("double").alias(c) for c in "xywh"]).alias("box"))
    lists = boxes.groupBy(image).agg(F.transform(F.array_sort(F.collect_list(box)), lambda s: s["box"]).alias("boxes"))

    def step(kept: Column, b: Column) -> Column:
        clash = F.exists(kept, lambda k: iou(k["x"], k["y"], k["w"], k["h"], b["x"], b["y"], b["w"], b["h"]) > most)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(b)))

    rows = lists.select(image, F.explode(F.aggregate("boxes", F.array().cast(kept_type), step)).alias("b"))
    return rows.select(image, f"b.{id_}", "b.score", *[f"b.{c}" for c in "xywh"])


def letterbox(width: Column, height: Column, side: int) -> tuple[Column, Column, Column]:
    """Scale and padding that fit an image into a square."""
    scale = F.least(F.lit(side) / width, F.lit(side) / height)
    return scale, (F.lit(side) - width * scale) / 2, (F.lit(side) - height * scale) / 2


def face_chip(img_w: Column, img_h: Column, x: Column, y: Column, w: Column, h: Column, grow: float = 1.35, centre: float = 0.43) -> Column:
    """Square crop around a face box (shares of the image), in pixels within the image: x, y, side."""
    cx, cy = (x + w / 2) * img_w, (y + h * centre) * img_h
    side = F.least(F.greatest(w * img_w, h * img_h) * grow, img_w, img_h)
    left = F.greatest(F.lit(0.0), F.least(cx - side / 2, img_w - side))
    top = F.greatest(F.lit(0.0), F.least(cy - side / 2, img_h - side))
    return F.struct(F.round(left).cast("int").alias("x"), F.round(top).cast("int").alias("y"), F.round(side).cast("int").alias("side"))


def decoded_anchors(tensors: DataFrame, image: str, stride: int, grid: int, least: float, min_side: float = 12.0, anchors: int = 2) -> DataFrame:
    """Boxes of one output level: image, cell, score, x, y, w, h as shares of the image.

    tensors: image, scores array, boxes array of 4 distances (in strides) for each cell, scale, pad_x, pad_y,
    img_w, img_h.
    """
    rows = tensors.select(image, "boxes", "scale", "pad_x", "pad_y", "img_w", "img_h", F.posexplode("scores").alias("cell", "score")).where(F.col("score") >= least)
    spot = F.floor(F.col("cell") / anchors)
    cx, cy = (spot % grid) * stride, F.floor(spot / grid) * stride
    side = lambda i: F.get("boxes", F.col("cell") * 4 + i) * stride
    x1, y1 = (cx - side(0) - F.col("pad_x")) / F.col("scale"), (cy - side(1) - F.col("pad_y")) / F.col("scale")
    x2, y2 = (cx + side(2) - F.col("pad_x")) / F.col("scale"), (cy + side(3) - F.col("pad_y")) / F.col("scale")
    out = rows.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2}).where((F.col("x2") - F.col("x1") >= min_side) & (F.col("y2") - F.col("y1") >= min_side))
    share = lambda v, of: F.least(F.greatest(v / F.col(of), F.lit(0.0)), F.lit(1.0))
    box = [share(F.col("x1"), "img_w").alias("x"), share(F.col("y1"), "img_h").alias("y"), ((F.col("x2") - F.col("x1")) / F.col("img_w")).alias("w"), ((F.col("y2") - F.col("y1")) / F.col("img_h")).alias("h")]
    return out.select(image, "cell", "score", *box)


def pose_rows(values: np.ndarray, shape: tuple[int, int] | None) -> tuple[np.ndarray, float]:
    """A detector's output as rows of corners, score and 17 keypoints, and the least side of a box in its layout.

    Four layouts, told by the shape: up to 300 finished boxes of 56 numbers (corners, score, keypoints) or 57 (with a
    class after the score); or any number of centres with sizes, as rows or as columns. Without a shape: centres as
    rows of 56.
    """
    rows, cols = shape or (len(values) // 56, 56)
    m = np.asarray(values, float)[: rows * cols].reshape(rows, cols)
    if shape and rows <= 300 and cols in (56, 57):
        return (np.delete(m, 5, 1) if cols == 57 else m), 0.0
    m = (m.T if rows < cols and shape else m)[:, :56].copy()
    centre, half = m[:, :2].copy(), m[:, 2:4] / 2
    m[:, :2], m[:, 2:4] = centre - half, centre + half
    return m, 8.0


def decoded_poses(tensors: DataFrame, image: str, least: float, most: float = 0.45, again: float | None = None) -> DataFrame:
    """Poses of a detector's output: image, pose, score, x, y, w, h, keypoints (17 of x, y, score), after suppression at most, and once more at again.

    tensors: image, values (flat array), scale, pad_x, pad_y, img_w, img_h, and shape (rows, columns) where the layout
    isn't centres as rows; see pose_rows. Positions are shares of the image, within it. One image is decoded at a time,
    as a matrix; empty images and scales give none.
    """
    schema = f"{image} {tensors.schema[image].dataType.simpleString()}, pose long, score double, x double, y double, w double, h double, keypoints array<struct<x:double,y:double,score:double>>"
    shaped = "shape" in tensors.columns

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if min(r.img_w, r.img_h, r.scale) <= 0:
                    continue
                m, side = pose_rows(r.values, tuple(r.shape) if shaped else None)
                size = np.array([r.img_w, r.img_h], float)
                pad = np.array([r.pad_x, r.pad_y], float)
                low, high = (np.clip((m[:, i : i + 2] - pad) / r.scale, 0, size) for i in (0, 2))
                box = np.maximum(high - low, 0)
                points = m[:, 5:56].reshape(len(m), 17, 3)
                spots = np.clip((points[..., :2] - pad) / r.scale / size, 0, 1)
                for i in np.flatnonzero((m[:, 4] >= least) & (box >= side).all(1)).tolist():
                    keys = [{"x": x, "y": y, "score": c} for (x, y), c in zip(spots[i].tolist(), points[i, :, 2].tolist(), strict=True)]
                    out.append((getattr(r, image), i, m[i, 4], *(low[i] / size), *(box[i] / size), keys))
            yield pd.DataFrame(out, columns=[image, "pose", "score", "x", "y", "w", "h", "keypoints"])

    found = tensors.mapInPandas(run, schema)
    kept = nms(found, image, "pose", most)
    kept = kept if again is None else nms(kept, image, "pose", again)
    return found.join(kept.select(image, "pose"), [image, "pose"])


def similarity_transform(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares similarity (scale and turn, shift) of point pairs (x, y) to (u, v) in each group: keys, a, b, tx, ty, with u = a x - b y + tx and v = b x + a y + ty."""
    n = F.count("*")
    means = [F.avg(c) for c in "xyuv"]
    mx, my, mu, mv = means
    dot_ = F.sum(F.col("x") * F.col("u") + F.col("y") * F.col("v")) - n * (mx * mu + my * mv)
    cross = F.sum(F.col("x") * F.col("v") - F.col("y") * F.col("u")) - n * (mx * mv - my * mu)
    var = F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")) - n * (mx * mx + my * my)
    sums = points.groupBy(*keys).agg(dot_.alias("_d"), cross.alias("_c"), var.alias("_v"), *[m.alias(f"_m{c}") for m, c in zip(means, "xyuv", strict=True)])
    a, b = F.col("_d") / F.nullif("_v", F.lit(0.0)), F.col("_c") / F.nullif("_v", F.lit(0.0))
    return sums.select(*keys, a.alias("a"), b.alias("b"), (F.col("_mu") - a * F.col("_mx") + b * F.col("_my")).alias("tx"), (F.col("_mv") - b * F.col("_mx") - a * F.col("_my")).alias("ty"))
