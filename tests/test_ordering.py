"""Distributed order, running values, frames, quantiles and as-of joins against plain Python."""

from __future__ import annotations

import bisect
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from intertie.operators import network, ordering, portfolio, signals, versions, wind
from intertie.operators.market import average_rank, percentile_rank, share_at_or_below


def skewed(seed: int, n: int = 900):
    """Rows ``(key, t, id, value)``: one key holds half of them, values repeat and some are missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(12)}"
        value = None if rng.random() < 0.2 else float(rng.randrange(40))
        rows.append((key, rng.randrange(200), i, value))
    return rows


SCHEMA = "key string, t int, id int, value double"


def groups(rows):
    out: dict = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_running_values(spark, seed):
    rows = skewed(seed)
    ordered = ordering.globally_ordered(spark.createDataFrame(rows, SCHEMA), ["key", "t", "id"], 7)
    assert ordered.select("_part").distinct().count() > 3
    got = {
        r.id: (r.s, r.n, r.lo, r.hi, r.last)
        for r in ordering.running(
            ordered, ["key"],
            {"s": ("sum", "value"), "n": ("count", "value"), "lo": ("min", "value"), "hi": ("max", "value"), "last": ("last", "value")},
        ).collect()
    }
    for group in groups(rows).values():
        seen = []
        for row in group:
            if row[3] is not None:
                seen.append(row[3])
            want = (sum(seen), len(seen), min(seen), max(seen), seen[-1]) if seen else (None, 0, None, None, None)
            assert got[row[2]] == want
    assert len(got) == len(rows)


def test_index_is_consecutive(spark):
    ordered = ordering.globally_ordered(spark.createDataFrame(skewed(3), SCHEMA), ["key", "t", "id"], 7)
    rows = ordering.with_index(ordered).select("_index", "key", "t", "id").orderBy("_index").collect()
    assert [r["_index"] for r in rows] == list(range(len(rows)))
    assert [(r.key, r.t, r.id) for r in rows] == sorted((r.key, r.t, r.id) for r in rows)


def test_neighbours_cross_slices(spark):
    rows = skewed(4)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {
        r.id: (r.after, r.before)
        for r in ordering.neighbour(frame, ["key"], ["t", "id"], {"after": ("id", 1), "before": ("id", -2)}).collect()
    }
    for group in groups(rows).values():
        ids = [r[2] for r in group]
        for i, identifier in enumerate(ids):
            assert got[identifier] == (ids[i + 1] if i + 1 < len(ids) else None, ids[i - 2] if i >= 2 else None)


def quantile(values, fraction):
    ordered = sorted(values)
    place = fraction * (len(ordered) - 1)
    low = math.floor(place)
    high = math.ceil(place)
    return ordered[low] + (ordered[high] - ordered[low]) * (place - low)


def test_exact_quantiles_and_null_keys(spark):
    rows = [(None if r[0] == "k1" else r[0], *r[1:]) for r in skewed(5)]
    stats = ordering.exact_quantiles(spark.createDataFrame(rows, SCHEMA), ["key"], "value", {"p25": 0.25, "p90": 0.9})
    got = {r.key: (r.p25, r.p90) for r in stats.collect()}
    by_key: dict = {}
    for key, _, _, value in rows:
        if value is not None:
            by_key.setdefault(key, []).append(value)
    assert set(got) == set(by_key)
    for key, values in by_key.items():
        assert got[key] == pytest.approx((quantile(values, 0.25), quantile(values, 0.9)))


def test_ranks(spark):
    rows = [r for r in skewed(6) if r[3] is not None]
    frame = spark.createDataFrame(rows, SCHEMA)
    values = sorted(r[3] for r in rows)
    n = len(values)
    for r in share_at_or_below(percentile_rank(average_rank(frame, "value", "rank"), "value", "pct"), "value", "share").collect():
        below, upto = bisect.bisect_left(values, r.value), bisect.bisect_right(values, r.value)
        assert r.rank == (below + 1 + upto) / 2
        assert r.pct == pytest.approx(r.rank / n * 100)
        assert r.share == pytest.approx(round(upto / n * 100, 2), abs=0.0051)


def test_as_of_join(spark):
    facts = [(r[0], r[1], r[2]) for r in skewed(7)]
    rng = random.Random(8)
    definitions = [(rng.choice(["hot", "k1", "k2", "other"]), rng.randrange(200), i) for i in range(300)]
    joined = versions.as_of_join(
        spark.createDataFrame(facts, "key string, t int, id int"),
        spark.createDataFrame(definitions, "key string, since int, version int"),
        ["key"], "t", "since", ["version", "since"], tie_break=["version"], fact_order=["id"],
    ).collect()
    assert len(joined) == len(facts)
    for r in joined:
        eligible = [(s, v) for k, s, v in definitions if k == r.key and s <= r.t]
        assert (r.since, r.version) == (max(eligible) if eligible else (None, None))


def test_price_signals_small_chunks(spark):
    rng = random.Random(9)
    rows = [("A" if i % 3 else "B", i, float(rng.randrange(-40, 200))) for i in range(700)]
    frame = spark.createDataFrame(rows, "region string, timestamp int, price_mwh double")
    got = {
        r.timestamp: r
        for r in signals.price_signals(frame, lookahead=5, lookback=3, backcast=9, chunk_rows=16).collect()
    }
    assert len(got) == len(rows)
    for region in "AB":
        series = [(t, p) for g, t, p in rows if g == region]
        prices = [p for _, p in series]
        for i, (t, price) in enumerate(series):
            r, ahead = got[t], prices[i + 1 : i + 6]
            recent, day = prices[max(0, i - 3) : i + 1], prices[max(0, i - 9) : i + 1]
            assert r.has_forward == bool(ahead)
            if ahead:
                mean = sum(ahead) / len(ahead)
                delta = mean - price
                trend = 0 if abs(delta) < 5 else max(-1, min(1, delta / 50))
                assert r.forward_max_price == max(ahead) and r.forward_min_price == min(ahead)
                assert r.forward_mean_price == pytest.approx(mean) and r.price_trend == pytest.approx(trend)
                assert r.stored_energy_value == pytest.approx(max(0, max(ahead) * 0.9))
                assert r.neg_price_ahead == (min(ahead) < 0)
            else:
                assert r.stored_energy_value == 75 and r.forward_max_price == price and r.price_trend == 0
            assert r.volatility == pytest.approx(statistics.pstdev(recent) if len(recent) > 1 else 0)
            high = quantile(ahead, 0.75) if len(ahead) > 2 else 100
            low = quantile(day, 0.25) if len(day) > 2 else 50
            assert r.adaptive_discharge_threshold == pytest.approx(high)
            assert r.adaptive_charge_threshold == pytest.approx(low)


def test_overlay_needs_two_later_points(spark):
    columns = (
        "timestamp int, price_mwh double, stored_energy_value double, price_trend double, neg_price_ahead boolean, "
        "forward_max_price double, forward_min_price double, forward_mean_price double"
    )
    base = [(t, 50.0, 1.0, 0.5, False, 2.0, 3.0, 4.0) for t in (0, 5, 10, 15)]
    forecast = spark.createDataFrame([(5, -10.0), (10, 100.0), (15, 30.0)], "timestamp int, price_mwh double")
    got = {r.timestamp: r for r in signals.overlay_forecast(spark.createDataFrame(base, columns), forecast).collect()}
    assert (got[0].forward_max_price, got[0].forward_min_price, got[0].forward_mean_price) == (100, -10, 40)
    assert got[0].neg_price_ahead and got[0].price_trend == pytest.approx(-0.2)
    assert (got[5].forward_max_price, got[5].forward_mean_price) == (100, 65)
    assert got[10].forward_max_price == 2.0 and got[15].price_trend == 0.5


def test_interpolation(spark):
    rows = [(i, float(i), None if i in (0, 1, 4, 5, 9) else float(i * i)) for i in range(10)]
    frame = spark.createDataFrame(rows, "id int, secs double, ws10 double").select(
        "id", F.timestamp_seconds("secs").alias("timestamp"), "ws10"
    )
    got = {r.id: r.ws10 for r in wind.interpolate_time(frame).collect()}
    assert got[0] is None and got[1] is None
    assert got[4] == pytest.approx(9 + (36 - 9) / 3) and got[5] == pytest.approx(9 + (36 - 9) * 2 / 3)
    assert got[9] == 64 and got[3] == 9


def test_gap_report(spark):
    times = [0, 1, 2, 3, 5, 6, 10]
    frame = spark.createDataFrame([(float(t),) for t in times], "s double").select(F.timestamp_seconds("s").alias("timestamp"))
    row = wind.gap_report(frame).first()
    assert (row.expected_step_seconds, row.steps, row.bad_gaps) == (1, 6, 2)


def haversine(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    a += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(a)))


def test_nearest_factor_everywhere_on_the_globe(spark):
    rng = random.Random(10)

    def place():
        if rng.random() < 0.3:
            return rng.choice([-1, 1]) * rng.uniform(86, 90), rng.uniform(-180, 180)
        if rng.random() < 0.5:
            return rng.uniform(-2, 2), rng.choice([-1, 1]) * rng.uniform(179, 180)
        return rng.uniform(-36, -33), rng.uniform(149, 152)

    refs = [(rng.choice("XY"), *place(), i / 1000 + 0.5) for i in range(300)]
    spots = [place() for _ in range(150)]
    points = [(i, rng.choice("XY"), *spots[i % 150]) for i in range(400)] + [(999, None, None, None)]
    got = {
        r.id: r
        for r in network.nearest_factor(
            spark.createDataFrame(points, "id int, region string, latitude double, longitude double"),
            spark.createDataFrame(refs, "region string, latitude double, longitude double, factor double"),
        ).collect()
    }
    assert len(got) == len(points)
    hits = 0
    for identifier, region, lat, lon in points[:-1]:
        near = min((haversine(lat, lon, a, b), f) for g, a, b, f in refs if g == region)
        if near[0] <= 100:
            hits += 1
            assert got[identifier].factor == near[1] and got[identifier].distance_km == pytest.approx(near[0], abs=1e-6)
        else:
            assert got[identifier].factor == 1.0 and got[identifier].distance_km is None
    assert hits > 100 and got[999].factor == 1.0


def test_scenarios_of_any_number(spark):
    rng = random.Random(11)
    rows = [(f"c{i % 4}", "q", float(rng.randrange(100))) for i in range(62)]
    frame = spark.createDataFrame(rows, "category_id string, quarter string, forecast_irsr double")
    for percentile in (0, 50, 100):
        for r in portfolio.scenario_percentile(frame, percentile).collect():
            values = sorted(v for c, _, v in rows if c == r.category_id)
            assert r.irsr == values[max(0, min(len(values) - 1, int(percentile / 100 * len(values))))]
