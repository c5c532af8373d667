"""Faces of clips against a plain loop, and places nearest to points in blocks."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import geo, vectors
from tessera.plans import changes


def test_cluster_video_against_a_loop(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.clip, r.person): (r.vec_id, r.n) for r in changes.cluster_video(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    clips = {}
    for r in rows:
        clips.setdefault(r.vec_id // 20, []).append((r.vec_id % 20 // 2, -(r.vec_id * 7919 % 1000 / 1000), r.vec_id, np.array(r.embedding, float) / np.linalg.norm(r.embedding)))
    want = {}
    for c, faces in clips.items():
        best, claimed, last = [], set(), None
        for frame, worth, i, v in sorted(faces, key=lambda x: x[:3]):
            claimed, last = (set() if frame != last else claimed), frame
            fits = [p for p, b in enumerate(best) if p not in claimed and b[1] @ v >= 0.4]
            p = fits[0] if fits else len(best)
            if not fits:
                best.append((i, v, -worth, 0))
            elif -worth > best[p][2]:
                best[p] = (i, v, -worth, best[p][3])
            best[p] = (*best[p][:3], best[p][3] + 1)
            claimed.add(p)
        want |= {(c, p): (b[0], b[3]) for p, b in enumerate(best)}
    assert got == want and any(n > 1 for _, n in want.values())


def test_clips_of_no_faces(spark):
    none = spark.createDataFrame([], "clip long, frame long, vec_id long, embedding array<float>, score double")
    cents = spark.createDataFrame([(1, [1.0, 0.0])], "label int, centroid array<double>")
    assert vectors.cluster_clips(none, cents, "clip", "frame", "vec_id", "embedding", "label").count() == 0


def test_nearest_places_in_blocks(spark):
    points = spark.createDataFrame([(i, float(i % 180 - 90), float(i * 7 % 360 - 180)) for i in range(200)] + [(900, None, 1.0)], "id long, lat double, lng double")
    places = spark.createDataFrame([(i, float(i * 13 % 180 - 90), float(i * 29 % 360 - 180)) for i in range(57)] + [(99, 1.0, None)], "place long, lat double, lng double")
    one = {tuple(r) for r in geo.nearest(points, places, "id", "place").collect()}
    assert one == {tuple(r) for r in geo.nearest(points, places, "id", "place", most=10).collect()} and len(one) == 200
    assert geo.nearest(points, places.where(F.lit(False)), "id", "place").count() == 0
