"""Two craters of one image with one id, as parts and decoys of equal numbers give them: they are one target."""

import numpy as np
import pytest

from regolith.operators import consensus
from regolith.plans import queries
from regolith.plans.queries import QUERIES

#: Parts 526300 to 526399 and suppliers 26315 to 26319, whose decoys are numbered from 526315 on, belong to it.
IMAGE = 5263


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("twins"))
    for table, key, n in (("part", "p_partkey", 100), ("supplier", "s_suppkey", 5)):
        spark.createDataFrame([(n * i + k,) for i in (0, IMAGE) for k in range(n)], f"{key} bigint").coalesce(1).write.parquet(f"{d}/{table}.parquet")
    return d


def test_a_match_counts_once_though_its_target_s_id_is_there_twice(spark, folder):
    got = {r.image_id: r for r in QUERIES["visible_inlier_ratio"](spark, folder).collect()}
    for image, row in got.items():
        ref, tgt = (np.array(f(spark, folder).where(f"image_id = {image}").orderBy("crater_id").select("crater_id", "cx", "cy", "r").collect()) for f in (queries._ref, queries._tgt))
        assert (len(set(tgt[:, 0])) < len(tgt)) == (image == IMAGE)
        at = 0.8 * np.exp(1j * np.radians(20)) * (ref[:, 1] + 1j * ref[:, 2]) + complex(60, 90)
        d = abs(at[:, None] - (tgt[:, 1] + 1j * tgt[:, 2]))
        j = d.argmin(1)
        size = tgt[j, 3] / (0.8 * ref[:, 3])
        hit = (d.min(1) < np.maximum(max(5, 0.1 * np.median(tgt[:, 3])), 0.3 * tgt[j, 3])) & (size > 0.72) & (size < 1.39)
        n = len(set(tgt[j[hit], 0]))
        assert row.inlier_ratio == int(np.floor(n / min(row.n_visible_ref, row.n_visible_tgt) * 1e4 + 0.5))


def test_targets_of_one_id_are_hit_once():
    points, sims = np.array([[0.0, 0, 10], [50, 0, 10]]), np.array([[1.0, 0, 0, 0]])
    targets = np.array([[1.0, 0, 10], [52, 0, 10]])
    for ids, want in (((7, 7), [[True, False]]), ((7, 8), [[True, True]])):
        same = consensus.firsts(np.array(ids))
        assert next(consensus.consensus(sims, points, targets, 5.0, consensus.FIRST, same))[1].tolist() == want
        assert consensus.n_pairs(sims, points, targets, 5.0, consensus.FIRST, same=same).tolist() == [sum(want[0])]
