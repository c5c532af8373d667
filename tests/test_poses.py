"""Pose outputs of all layouts against loops over their numbers."""

import numpy as np
import pytest

from tessera.operators import detect

SIZE, PAD, SCALE = (320, 240), (4.0, 8.0), 0.5


def overlap(a, b):
    w = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    h = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    union = a[3] * a[4] + b[3] * b[4] - w * h
    return w * h / union if union > 0 else 0


def loop(get, n, corners, start, least, limits):
    """One pose after the other; get(i, k) is number k of pose i."""
    inside = lambda v, top: min(max(v, 0.0), top)
    boxes = []
    for i in range(n):
        if get(i, 4) < least:
            continue
        ends = [get(i, 0), get(i, 1), get(i, 2), get(i, 3)]
        if not corners:
            ends = [ends[0] - ends[2] / 2, ends[1] - ends[3] / 2, ends[0] + ends[2] / 2, ends[1] + ends[3] / 2]
        x1, y1, x2, y2 = (inside((v - PAD[k % 2]) / SCALE, SIZE[k % 2]) for k, v in enumerate(ends))
        if not corners and (x2 - x1 < 8 or y2 - y1 < 8):
            continue
        keys = [inside((get(i, start + 3 * k + j) - PAD[j]) / SCALE / SIZE[j], 1.0) for k in range(17) for j in range(2)]
        boxes.append((get(i, 4), x1 / SIZE[0], y1 / SIZE[1], max(x2 - x1, 0) / SIZE[0], max(y2 - y1, 0) / SIZE[1], i, keys))
    for most in limits:
        kept = []
        for b in sorted(boxes, key=lambda b: (-b[0], b[5])):
            if all(overlap(b, k) <= most for k in kept):
                kept.append(b)
        boxes = kept
    return {b[5]: b for b in boxes}


@pytest.mark.parametrize("layout", ["corners56", "corners57", "columns", "rows"])
def test_pose_layouts(spark, layout):
    rng = np.random.default_rng(5)
    n = 40 if layout.startswith("corners") else 400
    m = rng.uniform(0, 160, (n, 57 if layout == "corners57" else 56))
    m[:, 4] = rng.uniform(0, 1, n)
    if layout.startswith("corners"):
        m[:, 2:4] = m[:, :2] + rng.uniform(0, 60, (n, 2))
    else:
        m[:, 2:4] = rng.uniform(1, 50, (n, 2))
    flat, shape = (m.T, (56, n)) if layout == "columns" else (m, m.shape)
    rows = [(1, flat.ravel().tolist(), list(shape), SCALE, *PAD, *SIZE), (2, flat.ravel().tolist(), list(shape), 0.0, *PAD, *SIZE)]
    df = spark.createDataFrame(rows, "image int, values array<double>, shape array<int>, scale double, pad_x double, pad_y double, img_w int, img_h int")
    got = {r.pose: r for r in detect.decoded_poses(df, "image", 0.3, again=0.2).collect()}
    want = loop(lambda i, k: float(m[i, k]), n, layout.startswith("corners"), 6 if layout == "corners57" else 5, 0.3, (0.45, 0.2))
    assert got.keys() == want.keys() and len(want) > 5
    for i, w in want.items():
        r = got[i]
        assert np.allclose([r.score, r.x, r.y, r.w, r.h], w[:5]) and np.allclose([v for p in r.keypoints for v in (p.x, p.y)], w[6])
