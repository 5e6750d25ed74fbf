"""Queries over images of high numbers, whose grids lie beyond half a turn and beyond a whole one."""

import numpy as np
import pytest

from regolith.plans.queries import QUERIES

#: Their grids begin at 20 degrees more.
IMAGES = (0, 159, 160, 199, 339, 340, 1199)


def degrees(image):
    """lon, lat of an image's grid by pixel and scan."""
    p, s = np.meshgrid(np.arange(0, 1100, 100), np.arange(0, 1100, 100), indexing="ij")
    return 20 + image + p / 4000 + s / 90000, -60 + s / 5000 + p / 80000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("far"))
    rows = [(100 * i + k, 1 + k % 11) for i in IMAGES for k in range(100)]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int").coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def test_mean_longitudes_lie_within_half_a_turn(spark, folder):
    got = {r.image_id: r.lon0 for r in QUERIES["circular_mean_lon"](spark, folder).collect()}
    want = {i: int(np.floor(((degrees(i)[0].mean() + 180) % 360 - 180) * 1e5 + 0.5)) for i in IMAGES}
    assert got == want and min(got.values()) < 0


def test_longitudes_come_back_on_their_own_turn(spark, folder):
    got = {(r.image_id, r.pixel // 100, r.scan // 100): (r.lon, r.lat) for r in QUERIES["stereo_roundtrip"](spark, folder).collect()}
    assert len(got) == 121 * len(IMAGES)
    for i in IMAGES:
        lon, lat = (np.floor(v * 1e4 + 0.06 + 0.5).astype(int) for v in degrees(i))
        assert all(got[i, p, s] == (lon[p, s], lat[p, s]) for p in range(11) for s in range(11))
