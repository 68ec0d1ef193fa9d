"""Isolation forest: planted outliers, bounded and repeatable samples, brute-force scoring."""

import numpy as np
import pytest

from tests.conftest import rows_of
from wattline.operators import isolation
from wattline.plans.scale import measure


def test_planted_spikes_are_found(golden):
    found = isolation.isolation_forest(golden)
    flat = found.filter("meter_id = '2'").collect()
    assert {(r["ts"].day, r["ts"].hour) for r in flat} == {(d, h) for d in (12, 22) for h in (9, 10, 11)}
    busy = found.filter("meter_id = '1'").collect()
    assert {r["ts"].day for r in busy if r["power_kw"] > 400} == {12, 22}
    assert 0 < len(busy) <= 0.01 * 720 + 6


def draw(df, trees, sample):
    return isolation.draw_pool(df, trees, sample, 1, ["meter_id"], "ts", "power_kw", measure(df, ["meter_id"]))


def test_pool_of_a_long_key_is_a_random_part_of_it(golden):
    assert draw(golden, 100, 256).count() == 1440
    part = draw(golden, 4, 64)
    sizes = [r["count"] for r in part.groupBy("meter_id").count().collect()]
    assert all(200 < n < 320 for n in sizes)  # 256 expected of 720
    assert rows_of(part) == rows_of(draw(golden.repartition(7, "ts"), 4, 64))


def test_scores_do_not_depend_on_the_layout(golden):
    score = lambda df: rows_of(isolation.isolation_scores(df, 10, 64))
    assert score(golden) == score(golden.repartition(7, "ts"))


def test_copies_of_one_reading_cannot_fill_a_group(make):
    df = make([("a", 0, 5)] * 900 + [("a", h, h) for h in range(1, 100)])
    assert draw(df, 50, 16).count() <= 100
    assert draw(df, 50, 256).count() == 100


def plain_trees(values, trees, sample, own):
    """The same trees one node at a time, with the same draws."""
    limit = int(np.ceil(np.log2(sample)))
    nodes = [
        {"v": np.sort(values[p]), "depth": 0, "tree": t, "node": 1}
        for t, p in enumerate(isolation.sample_places(len(values), trees, sample, own))
    ]
    level = nodes
    while level:
        live = [n for n in level if len(n["v"]) > 1 and n["v"][0] != n["v"][-1] and n["depth"] < limit]
        for n in live:
            n["at"] = n["v"][0] + (n["v"][-1] - n["v"][0]) * isolation.cut_shares(n["tree"], n["node"], own)
            for side, inside, k in (("left", n["v"] <= n["at"], 0), ("right", n["v"] > n["at"], 1)):
                n[side] = {"v": n["v"][inside], "depth": n["depth"] + 1, "tree": n["tree"], "node": 2 * n["node"] + k}
        level = [n[side] for n in live for side in ("left", "right")]
    return nodes


def test_samples_are_dealt_out():
    for n, trees, sample in ((720, 100, 256), (60, 7, 40), (10, 5, 16), (5000, 30, 64)):
        picks = isolation.sample_places(n, trees, sample, 77)
        assert picks.shape == (trees, min(sample, n)) and all(len(set(p)) == len(p) for p in picks)
        hands = min(trees, n // min(sample, n))
        assert len(np.unique(picks[:hands])) == hands * min(sample, n)  # one deal shares no reading
    counts = np.bincount(isolation.sample_places(1000, 400, 100, 5).ravel(), minlength=1000)
    assert counts.min() == counts.max() == 40
    firsts = isolation.sample_places(50, 4000, 50, 9)[:, 0]
    assert np.bincount(firsts, minlength=50).std() < 20  # about 80 each, chance gives 9
    shares = isolation.cut_shares(np.arange(2000) % 100, np.arange(2000) // 100 + 1, 123)
    assert abs(shares.mean() - 0.5) < 0.03 and abs(shares.std() - 12**-0.5) < 0.02
    assert np.abs(np.corrcoef(shares[:-1], shares[1:])[0, 1]) < 0.06


def test_steps_equal_a_walk_through_every_tree():
    values = np.random.default_rng(3).normal(size=60).round(1)
    bounds, level = isolation.grow_steps(values, 7, 40, 11)
    nodes = plain_trees(values, 7, 40, 11)
    for x in [*values, -9.0, 9.0]:
        paths = []
        for node in nodes:
            while "at" in node:
                node = node["left"] if x <= node["at"] else node["right"]
            paths.append(node["depth"] + isolation.mean_path(len(node["v"])))
        assert level[np.searchsorted(bounds, x)] == pytest.approx(np.mean(paths))


def test_short_keys_send_no_more_rows_than_values(golden):
    pool = draw(golden, 100, 256)
    steps = isolation.fit_steps(pool, 100, 256, 1, ["meter_id"], "ts")
    assert steps.count() == golden.select("meter_id", "power_kw").distinct().count()


def test_mean_path():
    assert isolation.mean_path(1) == 0 and isolation.mean_path(2) == 1
    assert isolation.mean_path(256) == pytest.approx(10.244770920116851)


def test_the_lonely_value_scores_highest(make):
    df = make([("a", h, h % 5) for h in range(200)] + [("a", 200, 50)])
    scores = {r["power_kw"]: (r["score"], r["_rows"]) for r in isolation.isolation_scores(df, 50).collect()}
    assert max(scores, key=lambda v: scores[v][0]) == 50
    assert all(0 < s < 1 for s, _ in scores.values()) and sum(n for _, n in scores.values()) == 201


def test_short_keys_grow_together_as_alone(spark):
    """A group holds many short keys: their paths are those of each key alone."""
    rng = np.random.default_rng(3)
    parts = [np.sort(rng.integers(0, 40, n) / 4.0) for n in (1, 2, 7, 66, 200, 256)]
    own = np.array([isolation.key_number((str(k),), 42) for k in range(len(parts))])
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    together = isolation.grow_short(np.concatenate(parts), starts, 100, own)
    for values, start, number in zip(parts, starts, own):
        bounds, level = isolation.grow_steps(values, 100, 256, int(number))
        np.testing.assert_allclose(together[start : start + len(values)], level[np.searchsorted(bounds, values)], rtol=1e-12, atol=1e-12)
    df = spark.range(3000).selectExpr("id % 1500 as k", "timestamp_ntz'2024-01-01 00:00:00' as ts", "cast(id as double) as _v", "2L as _n")
    assert isolation.fit_steps(df, 10, 16, 1, ["k"], "ts", 8).count() == 3000
