"""Selections, unions, orderings and audits over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration, portfolio, selection
from ..session import scratch_path
from ..sources import reports, tables
from . import REGISTRY
from . import roles as R
from .settlement import CONFIG, SCORES_SQL, _backtest


@REGISTRY.add(
    "select_by_fields",
    f"""
    WITH {R.AUCTION_SQL}
    SELECT contract_id, from_region, units_offered, order_key, part_key, supp_key
    FROM auction WHERE quarter = 'C1995Q1' AND interconnector_id = 'R1-F1'
    """,
)
def select_by_fields(spark, folder):
    rows = selection.select_rows(R.auction(spark, folder), quarter="C1995Q1", interconnector_id="R1-F1", tranche_no=None)
    return rows.select("contract_id", "from_region", "units_offered", "order_key", "part_key", "supp_key")


PRODUCTS_SQL = f"""
    WITH {R.AUCTION_SQL},
    g AS (SELECT interconnector_id, from_region, contract_id, CAST(max(units_offered) AS BIGINT) AS max_units, min(quarter) AS quarter,
                 CAST(min(tranche_no) AS BIGINT) AS tranche_no FROM auction GROUP BY ALL),
    products AS (
      SELECT interconnector_id || '_' || contract_id || '_' || from_region AS product_id,
             interconnector_id || '_' || from_region AS unit_category_id, interconnector_id, from_region, contract_id,
             CASE WHEN from_region = split_part(interconnector_id, '-', 1) THEN split_part(interconnector_id, '-', 2)
                  ELSE split_part(interconnector_id, '-', 1) END AS to_region,
             quarter, tranche_no, 'PRIMARY' AS allocation_type, max_units,
             CASE WHEN max_units <> 0 THEN 1.0::DOUBLE / max_units ELSE 0 END AS unit_proportion FROM g)
    """


@REGISTRY.add("auction_products", PRODUCTS_SQL + "SELECT * FROM products")
def auction_products(spark, folder):
    return _whole(selection.products_of(R.auction(spark, folder)))


@REGISTRY.add(
    "auction_calendar",
    PRODUCTS_SQL
    + """
    SELECT contract_id, contract_id || '_v1' AS auction_id, min(quarter) AS quarter, min(tranche_no) AS tranche_no,
           count(*) AS products, CAST(sum(max_units) AS BIGINT) AS max_units
    FROM products GROUP BY contract_id
    """,
)
def auction_calendar(spark, folder):
    return _whole(selection.calendar_of(R.auction(spark, folder)))


def _whole(df):
    return df.withColumns({c: F.col(c).cast("long") for c in ("tranche_no", "max_units")})


UNION_SQL = """
    WITH base AS (SELECT o_custkey AS k, o_orderkey AS o, o_totalprice AS v, 0 AS f FROM orders WHERE o_orderstatus <> 'P'),
    extra AS (SELECT o_custkey AS k, o_orderkey AS o, -o_totalprice AS v, 1 AS f FROM orders WHERE o_orderstatus <> 'F'),
    u AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
    r AS (SELECT k, o, v, row_number() OVER (PARTITION BY k ORDER BY f {order}, o) AS rn FROM u)
    SELECT k AS custkey, o AS orderkey, CAST(v AS DOUBLE) AS price FROM r WHERE rn = 1
    """


def _union(spark, folder, later_wins):
    orders = R.table(spark, folder, "orders")
    base = orders.where("o_orderstatus <> 'P'").selectExpr("o_custkey AS custkey", "o_orderkey AS orderkey", "o_totalprice AS price")
    extra = orders.where("o_orderstatus <> 'F'").selectExpr("o_custkey AS custkey", "o_orderkey AS orderkey", "-o_totalprice AS price")
    merged = selection.union_by_key([base, extra], ["custkey"], later_wins, ["orderkey"])
    return merged.select("custkey", "orderkey", F.col("price").cast("double").alias("price"))


@REGISTRY.add("union_later_wins", UNION_SQL.format(order="DESC"))
def union_later_wins(spark, folder):
    return _union(spark, folder, True)


@REGISTRY.add("union_first_wins", UNION_SQL.format(order="ASC"))
def union_first_wins(spark, folder):
    return _union(spark, folder, False)


@REGISTRY.add(
    "read_limited",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus
    FROM orders ORDER BY orders.o_custkey, orders.o_orderkey LIMIT 25
    """,
)
def read_limited(spark, folder):
    rows = R.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.read_limited(rows, 25, ["o_custkey", "o_orderkey"])


@REGISTRY.add(
    "ingest_summary",
    f"""
    WITH {R.AUCTION_SQL}
    SELECT count(*) AS rows, count(DISTINCT (interconnector_id, contract_id, from_region)) AS products,
           count(DISTINCT (quarter, tranche_no)) AS events, min(quarter) AS first_quarter
    FROM auction
    """,
)
def ingest_summary(spark, folder):
    """The audits of all report files, put together; a contract is in one file."""
    return reports.ingest_summary(spark, _auction_files(spark, folder), "*.txt").agg(
        F.sum("snapshot_rows").alias("rows"), F.sum("products_loaded").alias("products"),
        F.sum("events_loaded").alias("events"), F.min("quarter").alias("first_quarter"),
    )


def _auction_files(spark, folder) -> str:
    """One report file for each contract, written in parallel, each with the time of its report in its first line."""
    rows = R.auction(spark, folder).select(
        "contract_id", F.lit(1).alias("_at"),
        F.concat_ws(
            ",", F.lit("D,RESIDUE_PUBLIC_DATA,,1"), "contract_id", F.lit("1"), "interconnector_id", "from_region",
            F.col("units_offered").cast("string"), F.col("units_sold").cast("string"), F.col("clearing_price").cast("string"),
            F.lit("0"),
        ).alias("value"),
    )
    stamp = F.date_format(F.max("ship_date"), "yyyy/MM/dd HH:mm:ss")
    heads = R.auction(spark, folder).groupBy("contract_id").agg(
        F.concat(F.lit('C,NEM,SRRES,NEMMCO,PUBLIC,"'), stamp, F.lit('"')).alias("value")
    )
    lines = rows.unionByName(heads.select("contract_id", F.lit(0).alias("_at"), "value"))
    path = scratch_path(spark, "auctions")
    ordered = lines.repartition("contract_id").sortWithinPartitions("contract_id", "_at")
    ordered.select("contract_id", "value").write.partitionBy("contract_id").text(path)
    return path


@REGISTRY.add(
    "ingest_files",
    f"""
    WITH {R.AUCTION_SQL}
    SELECT quarter, CAST(tranche_no AS BIGINT) AS tranche_no, count(*) AS snapshot_rows,
           count(DISTINCT (interconnector_id, from_region)) AS products_loaded, CAST(1 AS BIGINT) AS events_loaded,
           date_trunc('second', max(ship_date))::TIMESTAMP AS report_datetime
    FROM auction GROUP BY contract_id, quarter, tranche_no
    """,
)
def ingest_files(spark, folder):
    """The audit of every report file with the time of its report."""
    audits = reports.ingest_summary(spark, _auction_files(spark, folder), "*.txt")
    return audits.drop("source_file").withColumn("tranche_no", F.col("tranche_no").cast("long"))


@REGISTRY.add(
    "auction_version_times",
    f"""
    WITH {R.AUCTION_SQL},
    t AS (SELECT contract_id, date_trunc('second', max(ship_date))::TIMESTAMP AS auction_datetime FROM auction GROUP BY 1)
    SELECT DISTINCT contract_id || '_v01_' || interconnector_id || '_' || from_region AS result_id, auction_datetime
    FROM auction JOIN t USING (contract_id)
    """,
)
def auction_version_times(spark, folder):
    """Versioned results with the report time that stands in the first line of their file."""
    read = reports.read_auction_results_versioned(
        spark, _auction_files(spark, folder), "*.txt", ["clearing_price", "units_cleared", "units_offered"]
    )
    return read.select("result_id", "auction_datetime")


@REGISTRY.add(
    "ordered_diagnostics",
    f"""
    WITH {SCORES_SQL}
    SELECT quarter, rows, model_risk_discount, liquidity_discount, round(m1, 6) AS mape_actual_per_unit,
           round(weighted_score, 6) AS weighted_score
    FROM best ORDER BY quarter, best.weighted_score, model_risk_discount, liquidity_discount
    """,
)
def ordered_diagnostics(spark, folder):
    best = calibration.best_grid_point(calibration.calibration_scores(_backtest(spark, folder), CONFIG))
    ordered = calibration.ordered_diagnostics(best)
    return ordered.select(
        "quarter", "rows", "model_risk_discount", "liquidity_discount",
        F.round("mape_actual_per_unit", 6).alias("mape_actual_per_unit"), F.round("weighted_score", 6).alias("weighted_score"),
    )


TURNS_SQL = f"""
    WITH RECURSIVE {R.POSITIONS_SQL},
    given AS (
      SELECT srda_id, t.n AS turn, CAST((custkey * (t.n + 1) + t.n) % 40 AS INTEGER) AS g
      FROM positions, (VALUES (0), (1), (2)) t(n) WHERE custkey % 3 <> 0),
    walk AS (
      SELECT srda_id, 0 AS turn, CAST(units AS INTEGER) AS here, status, CAST(0 AS INTEGER) AS parts FROM positions
      UNION ALL
      SELECT w.srda_id, w.turn + 1, CASE WHEN g <= here THEN g ELSE here END,
             CASE WHEN g <= here THEN 'ASSIGNED' ELSE w.status END, CASE WHEN g < here THEN parts + 1 ELSE parts END
      FROM walk w JOIN given ON given.srda_id = w.srda_id AND given.turn = w.turn WHERE w.turn < 3),
    """


@REGISTRY.add(
    "assignments_in_turn",
    TURNS_SQL
    + """
    cut AS (SELECT a.srda_id, a.here - b.here AS units, a.status, b.parts FROM walk a JOIN walk b
            ON a.srda_id = b.srda_id AND b.turn = a.turn + 1 WHERE b.parts > a.parts),
    final AS (SELECT srda_id, max_by(here, turn) AS units, max_by(status, turn) AS status FROM walk GROUP BY srda_id)
    SELECT srda_id, CAST(units AS BIGINT) AS units, status FROM final
    UNION ALL
    SELECT srda_id || '_remainder' || CASE WHEN parts > 1 THEN '_' || parts ELSE '' END, CAST(units AS BIGINT), status FROM cut
    """,
)
def assignments_in_turn(spark, folder):
    split = portfolio.partial_assignment(R.positions(spark, folder), _turns(spark, folder), ["turn"])
    return split.select("srda_id", F.col("units").cast("long").alias("units"), "status")


@REGISTRY.add(
    "refused_assignments",
    TURNS_SQL
    + """
    late AS (SELECT g.srda_id, g.turn, g.g FROM given g JOIN walk w ON w.srda_id = g.srda_id AND w.turn = g.turn WHERE g.g > w.here)
    SELECT srda_id, turn, g AS units_assigned FROM late
    """,
)
def refused_assignments(spark, folder):
    return portfolio.refused_assignments(R.positions(spark, folder), _turns(spark, folder), ["turn"])


def _turns(spark, folder):
    rows = R.positions(spark, folder).where("custkey % 3 <> 0").select("srda_id", "custkey", F.explode(F.expr("array(0, 1, 2)")).alias("turn"))
    return rows.select("srda_id", "turn", F.expr("CAST((custkey * (turn + 1) + turn) % 40 AS INT)").alias("units_assigned"))
