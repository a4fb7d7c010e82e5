"""Literal cases with expected values worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from intertie.functions import fcas, market, network, quarters, valuation, wind
from intertie.operators import calibration, ledger, portfolio, residue, validation, versions


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row


def test_interval_residue_worked_example(spark):
    lit = [F.lit(x) for x in (30.0, 50.0, 30.0, 3.0)]
    back = [F.lit(x) for x in (50.0, 30.0, -30.0, 3.0)]
    row = one(spark, a=valuation.interval_irsr(*lit), b=valuation.interval_irsr(*back))
    assert row.a.irsr == pytest.approx(490, abs=0.01)
    assert row.a.direction == "forward" and row.b.direction == "reverse"


def test_distribution_cases(spark):
    d = valuation.distribution_per_unit
    row = one(
        spark,
        plain=d(F.lit(5_500_000.0), F.lit(50_000.0), F.lit(840)),
        negative=d(F.lit(1000.0), F.lit(1500.0), F.lit(10)).cast("double"),
        floor=d(F.lit(1000.0), F.lit(900.0), F.lit(10), floor=F.lit(30.0)),
        none=d(F.lit(1000.0), F.lit(0.0), F.lit(0)).cast("double"),
        record=valuation.distribution_record(F.lit(5_500_000.0), F.lit(50_000.0), F.lit(900), F.lit(840), F.lit(2500.0)),
    )
    assert row.plain == pytest.approx(6488.10, abs=1)
    assert row.negative == 0 and row.none == 0 and row.floor == 30.0
    assert row.record.distributable_irsr == 5_447_500 and row.record.units_unsold == 60
    assert row.record.fee_treatment.startswith("Includes 2500.0 AUD")


def test_fair_value_and_mark(spark):
    row = one(
        spark,
        v=valuation.fair_value(
            F.lit(0.001), F.lit(4_000_000.0), F.lit(2_800_000.0), F.lit(5_200_000.0), F.lit(40), F.lit(0.05), F.lit(0.03)
        ),
        m=valuation.mark(F.lit(1900.0), F.lit(2000.0), F.lit(0.05), F.lit(0.03)),
    )
    assert row.v.expected_distribution_per_unit == 4000 and row.v.fair_value_per_unit == 3680
    assert row.v.fair_value_total == 147_200
    assert (row.v.confidence_band_low, row.v.confidence_band_high) == (2576, 4784)
    assert row.m.clean_fair_value == 3800 and row.m.bid_mark < row.m.mid_mark < row.m.offer_mark
    assert row.m.confidence_score == pytest.approx(245 / 3)
    assert row.m.drivers["model_risk_impact"] == pytest.approx(100)


def test_quarter_functions(spark):
    df = spark.createDataFrame([("C2025Q3",), ("C2024Q1",), ("X2024Q1",), ("C2024Q5",)], "q string")
    rows = df.select(
        "q",
        quarters.parse_quarter("q").alias("p"),
        quarters.quarter_bounds("q").alias("b"),
        quarters.is_quarter_closed("q", dt.date(2025, 9, 30)).alias("closed"),
        quarters.is_quarter_closed("q", dt.date(2025, 10, 1)).alias("closed_next_day"),
    ).collect()
    assert rows[0].p.ordinal == 2025 * 4 + 3
    assert (rows[0].b.start_date, rows[0].b.end_date) == (dt.date(2025, 7, 1), dt.date(2025, 9, 30))
    assert (rows[0].closed, rows[0].closed_next_day) == (False, True)
    assert rows[1].b.end_date == dt.date(2024, 3, 31)
    assert rows[2].p.ordinal is None and rows[3].p.ordinal is None


def test_market_scalars(spark):
    row = one(
        spark,
        a=market.other_region(F.lit("NSW1-QLD1"), F.lit("QLD1")),
        b=market.other_region(F.lit("NSW1-QLD1"), F.lit("VIC1")),
        c=market.other_region(F.lit("BASS"), F.lit("VIC1")),
        n=market.other_region(F.lit("N-Q-MNSP1"), F.lit("N")),
        i=market.safe_int(F.lit("  ")),
        d=market.safe_decimal(F.lit("1,234.5")),
        e0=market.percent_error(F.lit(0.0), F.lit(0.0)),
        e1=market.percent_error(F.lit(0.0), F.lit(5.0)),
        e2=market.capped_error(F.lit(10.0), F.lit(100.0), 200.0),
        r=market.is_relevant(F.lit("Grid news"), F.lit("")),
        cents=market.round_cents(F.lit(2.675)),
        low=market.round_cents(F.lit(-1.005)),
    )
    assert (row.a, row.b, row.c, row.n) == ("NSW1", "", "", "Q-MNSP1")
    assert row.i == 0 and float(row.d) == 1234.5
    assert (row.e0, row.e1, row.e2) == (0, 100, 200)
    assert row.r is True
    assert (row.cents, row.low) == (2.68, -1.01)


def test_wind_and_network_scalars(spark):
    row = one(
        spark,
        s=wind.wind_speed(F.lit(3.0), F.lit(4.0)),
        z=wind.power_law_speed(F.lit(5.0), 10, F.lit(100.0)),
        noon=wind.solar_profile(F.lit(dt.datetime(2024, 1, 1, 12, 30)), 1000.0),
        night=wind.solar_profile(F.lit(dt.datetime(2024, 1, 1, 2, 0)), 1000.0),
        st=network.normalise_state(F.lit("new south wales")),
        term=network.contract_term(F.lit("2031/32"), 2026),
        bad=network.contract_term(F.lit("TBC"), 2026),
        small=network.deficit_and_sizing(F.lit(-250_000.0), F.lit(0.0)),
        cost=network.deficit_and_sizing(F.lit(None).cast("double"), F.lit(2.0)),
    )
    assert row.s == 5 and row.z == pytest.approx(5 * 10**0.14)
    assert row.noon == pytest.approx(0.85) and row.night == 0
    assert row.st == "NSW" and row.term == 5 and row.bad == 5
    assert (row.small.deficit_mw, row.small.ideal_bess_mw, row.small.ideal_solar_mw) == (0.25, 1.0, 0.6)
    assert (row.cost.ideal_bess_mw, row.cost.ideal_solar_mw) == (6.0, 12.0)


BACKTEST = (
    "quarter string, interconnector_id string, from_region string, tranche_no int, units_offered int, units_sold int, "
    "clearing_price double, total_units_sold bigint, actual_residue_total double, actual_per_unit double, "
    "actual_total_payout double"
)


def backtest(spark, *rows):
    return spark.createDataFrame(list(rows), BACKTEST)


def best(spark, frame, **options):
    by_quarter = options.pop("by_quarter", False)
    config = calibration.CalibrationConfig(**options)
    return calibration.best_grid_point(calibration.calibration_scores(frame, config, by_quarter)).first()


def test_perfect_data_needs_no_discount(spark):
    frame = backtest(spark, ("C2025Q3", "NSW1-QLD1", "NSW1", 1, 100, 50, 100.0, 100, 10000.0, 100.0, 5000.0))
    row = best(spark, frame, risk_percent=(0, 10), liquidity_percent=(0, 10))
    assert (row.model_risk_discount, row.liquidity_discount) == (0, 0)
    assert row.mape_actual_per_unit == 0


def test_price_weight_moves_the_optimum(spark):
    frame = backtest(spark, ("C2025Q3", "NSW1-QLD1", "NSW1", 1, 100, 50, 60.0, 100, 10000.0, 100.0, 5000.0))
    row = best(
        spark, frame, risk_percent=(0,), liquidity_percent=(0, 20, 40), payout_error_weight=0.0, price_error_weight=1.0
    )
    assert row.liquidity_discount == 0.4


def test_error_cap_and_shortfall_penalty(spark):
    frame = backtest(spark, ("C2025Q3", "NSW1-QLD1", "NSW1", 1, 100, 50, 10.0, 100, 10000.0, 100.0, 5000.0))
    capped = best(spark, frame, risk_percent=(0,), liquidity_percent=(0,), ape_cap=10.0)
    assert capped.mape_clearing_price == 10
    even = backtest(spark, ("C2025Q3", "NSW1-QLD1", "NSW1", 1, 100, 50, 100.0, 100, 10000.0, 100.0, 5000.0))
    pushed = best(
        spark, even, risk_percent=(0, 10), liquidity_percent=(0,), min_total_discount=0.1, penalty_strength=1000.0
    )
    assert pushed.model_risk_discount == 0.1


def test_quarter_balance_weighs_quarters_equally(spark):
    many = [("C2025Q3", "A-B", "A", i, 100, 50, 100.0, 100, 10000.0, 100.0, 5000.0) for i in range(1, 4)]
    other = ("C2025Q4", "A-B", "A", 1, 100, 50, 50.0, 100, 10000.0, 100.0, 5000.0)
    frame = backtest(spark, *many, other)
    options = {"risk_percent": (0,), "liquidity_percent": (0,)}
    assert best(spark, frame, **options).mape_clearing_price == pytest.approx(25)
    assert best(spark, frame, quarter_balanced=True, **options).mape_clearing_price == pytest.approx(50)


def test_quarterly_sum_and_reconciliation(spark):
    rows = spark.createDataFrame(
        [
            (dt.datetime(2026, 7, 11, 13, 15), "NSW1-QLD1", "QLD1", 100.0),
            (dt.datetime(2026, 7, 11, 13, 20), "NSW1-QLD1", "QLD1", 50.0),
            (dt.datetime(2026, 7, 11, 13, 20), "NSW1-QLD1", "NSW1", 200.0),
            (dt.datetime(2026, 10, 1, 0, 0), "NSW1-QLD1", "NSW1", 7.0),
        ],
        "trading_interval timestamp_ntz, interconnector_id string, from_region string, residue_aud double",
    )
    sums = {(r.quarter, r.from_region): r.residue_aud for r in residue.quarterly_sum(rows, "trading_interval", "residue_aud").collect()}
    assert sums == {("C2026Q3", "QLD1"): 150, ("C2026Q3", "NSW1"): 200, ("C2026Q4", "NSW1"): 7}
    averaged = residue.interval_bucket_average_then_sum(rows).where("from_region = 'QLD1'").first()
    assert averaged.residue_aud == 75
    keys = "quarter string, interconnector_id string, from_region string"
    left = spark.createDataFrame([("C2026Q3", "A-B", "A", 100.0)], keys + ", residue_aud double")
    right = spark.createDataFrame([("C2026Q3", "A-B", "A", 90.0), ("C2026Q3", "A-B", "B", 5.0)], keys + ", net_payment double")
    deltas = {r.from_region: r.delta_aud for r in residue.reconcile_dispatch_vs_settlement(left, right).collect()}
    assert deltas == {"A": 10, "B": -5}


def test_settlement_priority(spark):
    schema = (
        "quarter string, interconnector_id string, from_region string, bill_run_type string, week_no int, effective_date date, "
        "source_file string, purchased_units int, total_surplus double, distributed_surplus double, auction_fees double, "
        "net_payment double, accumulated_net_payment double, accumulated_net_payment_per_unit double"
    )

    def row(run, week, day, file, value):
        return ("C2025Q1", "A-B", "A", run, week, dt.date(2025, 2, day), file, 10, value, value, 0.0, value, value * 10, value)

    weeks = [
        row("REVISION 2", 1, 3, "f3", 30.0),
        row("REVISION 2", 2, 2, "f2", 20.0),
        row("REVISION 2", 1, 1, "f1", 99.0),
        row("REVISION 1", 1, 9, "f9", 77.0),
        row("PRELIMINARY", 1, 10, "f10", 66.0),
    ]
    summary = residue.final_settlement_summary(spark.createDataFrame(weeks, schema)).first()
    assert summary.bill_run_type == "REVISION 2" and summary.total_surplus == 50
    assert summary.accumulated_net_payment == 300 and summary.source_file == "f3"
    final = residue.final_settlement_summary(spark.createDataFrame([*weeks, row("final", 1, 1, "f0", 5.0)], schema)).first()
    assert final.bill_run_type == "final" and final.total_surplus == 5


def test_reconciliation_status_bands(spark):
    keys = "quarter string, interconnector_id string, from_region string"
    summaries = spark.createDataFrame(
        [("Q", "A", r, 10, v, v, "FINAL", "f") for r, v in (("a", 100.0), ("b", 100.0), ("c", 100.0), ("d", 100.0), ("z", 0.0))],
        keys + ", purchased_units int, total_surplus double, accumulated_net_payment double, bill_run_type string, source_file string",
    )
    rebuilt = spark.createDataFrame(
        [("Q", "A", r, v) for r, v in (("a", 100.5), ("b", 104.0), ("c", 150.0), ("z", 3.0), ("e", 1.0))], keys + ", residue_aud double"
    )
    rows = {r.from_region: r for r in residue.reconcile_payouts(summaries, rebuilt).collect()}
    assert [rows[k].calculation_status for k in "abcdez"] == [
        "reconciled", "small_variance", "unexplained_variance", "incomplete_data", "incomplete_data", "unexplained_variance",
    ]
    assert rows["b"].warnings == ["likely:settlement_revision_or_fees"]
    assert rows["c"].warnings == ["variance=50.00%"]
    assert rows["d"].warnings == ["no_dispatch_irsr"]
    assert "no_aucunits" in rows["e"].warnings and "zero_purchased_units" in rows["e"].warnings
    assert "zero_aemo_baseline" in rows["z"].warnings
    totals = residue.reconciliation_totals(residue.reconcile_payouts(summaries, rebuilt)).first()
    assert (totals.categories_reconciled, totals.categories_with_variance, totals.categories_missing_aucunits) == (1, 3, 1)
    requested = spark.createDataFrame([("Q",), ("R",)], "quarter string")
    certified = {r.quarter: r for r in residue.certify_quarters(residue.reconcile_payouts(summaries, rebuilt), requested).collect()}
    assert certified["Q"].certification_status == "NOT_YET" and certified["R"].certification_status == "NO_DATA"


def test_positions_and_orders(spark):
    schema = (
        "srda_id string, category_id string, quarter string, units int, acquisition_price double, acquisition_cost double, "
        "status string, accrued_value double, forward_value double"
    )
    book = spark.createDataFrame(
        [
            ("p1", "c", "q", 40, 2500.0, 100000.0, "ACTIVE", 20000.0, 150000.0),
            ("p2", "c", "q", 10, 1.0, 10.0, "EXPIRED", 1.0, 1.0),
        ],
        schema,
    )
    pnl = portfolio.portfolio_pnl(book).first()
    assert (pnl.total_cost, pnl.unrealized_pnl) == (100000, 70000)
    given = spark.createDataFrame([("p1", 10), ("p2", 99)], "srda_id string, units_assigned int")
    rows = {r.srda_id: r for r in portfolio.partial_assignment(book, given).collect()}
    assert set(rows) == {"p1", "p1_remainder", "p2"}
    assert (rows["p1"].units, rows["p1"].status, rows["p1"].accrued_value) == (10, "ASSIGNED", 5000)
    assert (rows["p1_remainder"].units, rows["p1_remainder"].status) == (30, "ACTIVE")
    assert rows["p2"].units == 10 and rows["p2"].status == "EXPIRED"
    sent = spark.createDataFrame([("a",), ("b",)], "order_id string")
    got = spark.createDataFrame([("a",), ("x",), (None,)], "order_id string")
    counts = portfolio.reconcile_orders(sent, got).first()
    assert tuple(counts) == (2, 2, 1, 1)
    orders = spark.createDataFrame(
        [("a", 1, 1.0, "p", "x"), ("a", 2, 1.0, "p", "x"), ("c", 0, -1.0, "", None), ("d", 1, 0.0, "p", "x")],
        "order_id string, quantity int, price double, product_id string, auction_id string",
    )
    failing = validation.failing_rows(orders, validation.order_rules(), ["order_id"], ["order_id"]).collect()
    assert sorted(r.order_id for r in failing) == ["a", "a", "c"]
    assert len([r for r in failing if r.order_id == "c"][0].messages) == 4


def test_scenarios(spark):
    rows = spark.createDataFrame(
        [("x", "q", 100.0, 0.3), ("x", "q", 200.0, 0.5), ("x", "q", 400.0, 0.2), ("y", "q", 5.0, 0.5)],
        "category_id string, quarter string, forecast_irsr double, probability double",
    )
    expected = {r.category_id: r.expected_irsr for r in portfolio.probability_weighted(rows).collect()}
    assert expected["x"] == pytest.approx(210) and expected["y"] is None
    picked = [
        {r.category_id: r.irsr for r in portfolio.scenario_percentile(rows, p).collect()}["x"] for p in (5, 25, 50, 75, 95)
    ]
    assert picked == [100, 100, 200, 200, 400]


def test_run_delta_uses_publication_order(spark):
    rows = spark.createDataFrame(
        [("c", "q", run, dt.date(2025, 1, day), value) for run, day, value in
         (("FINAL", 4, 12.0), ("R0", 1, 10.0), ("R0", 2, 8.0), ("R2", 3, 0.0))],
        "category_id string, quarter string, settlement_run string, effective_date date, payout_per_unit double",
    )
    deltas = {(r.from_run, r.to_run): (r.delta, r.delta_percentage) for r in versions.run_delta(rows).collect()}
    assert deltas == {("R0", "R2"): (-8, -100), ("R2", "FINAL"): (12, 0)}


def test_ledger_ignores_missing_outcomes(spark):
    rows = spark.createDataFrame(
        [("BUY", 0.65, 1.0, True, 2.0, 90.0), ("BUY", 0.55, 1.0, None, None, 10.0), ("AVOID", 0.95, 1.0, False, -1.0, 95.0)],
        "recommendation string, confidence double, spread_pct double, recommendation_correct_24h boolean, markout_24h_pct double, "
        "fill_rate_percentile double",
    )
    rates = {r.recommendation: (r["count"], r.hit_rate_24h) for r in ledger.hit_rate(rows).collect()}
    assert rates == {"BUY": (2, 1.0), "AVOID": (1, 0.0)}
    bins = {r.claimed_confidence: r["count"] for r in ledger.confidence_bins(rows).collect()}
    assert bins == {0.6: 1, 0.7: 1}


def test_fcas_stack_by_hand(spark):
    prices = {name: 0.0 for name, _, _ in fcas.RAISE_SERVICES.values()}
    prices.update(fcas_raise_6sec_aud_per_mw=10.0, fcas_reg_raise_aud_per_mw=20.0)
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in prices.items()])
    stack = fcas.fcas_costack(frame, "raise", F.lit(5.0), F.lit(0.5), F.lit(10.0), F.lit(5.0)).first().raise_stack
    assert stack.cont_mw == pytest.approx(4.5) and stack.reg_mw == pytest.approx(0.5)
    assert stack.cont_revenue == pytest.approx(10 * 4.5 / 12)
    assert stack.reg_revenue == pytest.approx(20 * 0.5 / 12 - 0.5 * 0.003 * 5)
    assert stack.best_label == "RAISE_6SEC"
    empty = fcas.fcas_costack(frame, "raise", F.lit(5.0), F.lit(0.05), F.lit(10.0), F.lit(5.0)).first().raise_stack
    assert empty.total_mw == 0 and empty.best_label == "NONE" and empty.services == []


def test_published_backtest_row(spark):
    """Figures published for one category: 660 units sold at a residue of 2,611,455.0417."""
    auction = spark.createDataFrame(
        [("C2025Q3", "NSW1-QLD1", "NSW1", 7, 45, 45, 4503.0), ("C2025Q3", "NSW1-QLD1", "NSW1", 8, 45, 615, 4496.25)],
        "quarter string, interconnector_id string, from_region string, tranche_no int, units_offered int, units_sold int, "
        "clearing_price double",
    )
    rebuilt = spark.createDataFrame(
        [("C2025Q3", "NSW1-QLD1", "NSW1", 2611455.0417)],
        "quarter string, interconnector_id string, from_region string, residue_aud double",
    )
    config = calibration.CalibrationConfig(risk_percent=(0,), liquidity_percent=(10,), ape_cap=200.0)
    frame = calibration.backtest_frame(auction, rebuilt)
    point = calibration.best_grid_point(calibration.calibration_scores(frame, config))
    row = calibration.apply_calibration(frame, point, config).where("tranche_no = 7").first()
    assert row.total_units_sold == 660 and row.to_region == "QLD1"
    assert row.actual_per_unit == pytest.approx(3956.750063181818, abs=1e-9)
    assert row.actual_total_payout == pytest.approx(178053.7528431818, abs=1e-6)
    assert (row.model_per_unit, row.model_total_payout) == (3561.08, 160248.38)
    assert row.pct_error_actual_per_unit == pytest.approx(9.99987507079586, abs=1e-12)
    assert row.pct_error_clearing_price == pytest.approx(20.917610481900955, abs=1e-12)


@pytest.mark.parametrize("size", [3, 200])
def test_vector_search(spark, size):
    from intertie.operators.text import vector_search

    vectors = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(size)]) for i in range(30)]
    query = [float(j % 5 - 2) for j in range(size)]

    def cosine(v):
        dot = sum(a * b for a, b in zip(v, query))
        lengths = (sum(a * a for a in v) * sum(b * b for b in query)) ** 0.5
        return dot / lengths

    frame = spark.createDataFrame(vectors, "vec_id int, embedding array<float>")
    got = [(r.vec_id, r.similarity) for r in vector_search(frame, query, 5).collect()]
    want = sorted(((i, cosine(v)) for i, v in vectors), key=lambda x: (-round(x[1], 9), x[0]))[:5]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_keyword_search_counts_whole_texts(spark):
    from intertie.operators.text import keyword_search

    long_text = "x" * 5000 + " solar solar"
    frame = spark.createDataFrame([(1, "Solar\npower"), (2, long_text), (3, "none")], "doc_id int, text string")
    rows = keyword_search(frame, "solar of it").collect()
    assert [(r.doc_id, r.score) for r in rows] == [(2, 2), (1, 1)]
    assert rows[1].snippet == "Solar power" and len(rows[0].snippet) == 600
