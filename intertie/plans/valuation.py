"""Back-test, calibration and ranked trades from auction files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, market, trades
from ..operators.versions import latest_version
from ..sources import catalog, reports

FILE_ORDER = ("file_time", "file_sequence", "source_file")


def auction_rows(spark: SparkSession, results: str, dedupe: bool = False) -> DataFrame:
    """Auction rows with their file order; ``dedupe`` keeps the latest publication of each product."""
    rows = catalog.file_catalog(reports.read_auction_results(spark, results))
    if not dedupe:
        return rows
    return latest_version(rows, ["contract_id", "interconnector_id", "from_region"], list(FILE_ORDER))


def calibrate(
    auction: DataFrame,
    quarterly_residue: DataFrame,
    config: calibration.CalibrationConfig = calibration.CalibrationConfig(),
    by_quarter: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grid scores, the best point per quarter (or over all) and the evaluated rows."""
    backtest = calibration.backtest_frame(auction, quarterly_residue)
    scores = calibration.calibration_scores(backtest, config, by_quarter)
    best = calibration.best_grid_point(scores)
    if by_quarter:
        return scores, best, calibration.apply_calibration(backtest, best, config)
    # The global optimum is one row, valid for every quarter.
    point = best.first().asDict()
    point.pop("quarter")
    everywhere = backtest.select("quarter").distinct().select("quarter", *[F.lit(v).alias(k) for k, v in point.items()])
    return scores, best, calibration.apply_calibration(backtest, everywhere, config)


def ranked_trades(
    auction: DataFrame, as_of: dt.date, file_order: Sequence[str] = FILE_ORDER, n: int = 20, **limits
) -> dict[str, DataFrame]:
    """Marks, ranked candidates, best buys and summaries."""
    marks = trades.product_marks(auction, file_order, as_of)
    candidates = trades.trade_candidates(marks, as_of, **limits)
    buys = trades.best_buys(candidates, n)
    quarters = trades.quarter_trade_summary(buys)
    return {
        "marks": marks,
        "collapsed": trades.collapse_directions(marks),
        "candidates": trades.rank_candidates(candidates, n),
        "best_buys": buys,
        "quarters": quarters,
        "years": trades.year_trade_summary(quarters),
        "exit": trades.sell_quarter(trades.quarter_trade_summary(candidates)),
    }


def market_report(auction: DataFrame, order: Sequence[str] = ("tranche_no", "source_file")) -> dict[str, DataFrame]:
    """Correlations, group statistics, trends and the sequential back-test."""
    columns = ["fill_rate", "units_sold", "units_offered", "clearing_price"]
    frame = market.market_frame(auction)
    ranked = market.percentile_rank(frame, "fill_rate", "fill_rate_pct")
    pairs = market.tranche_pairs(ranked, order)
    trends = market.trend_by_product(frame, [c for c in order if c != "tranche_no"])
    return {
        "pearson": market.correlation_matrix(frame, columns),
        "spearman": market.correlation_matrix(frame.select(*columns), columns, "spearman"),
        "interconnectors": market.group_stats(frame, "interconnector_id"),
        "quarters": market.group_stats(frame, "quarter"),
        "trends": market.top_trends(trends),
        "trend_totals": market.trend_totals(trends),
        "by_recommendation": market.backtest_by_recommendation(pairs),
        "overall": market.backtest_overall(pairs),
    }
