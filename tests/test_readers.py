"""Readers over generated report files."""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from intertie.plans import settlement as jobs
from intertie.plans import storage, valuation
from intertie.operators import residue, versions
from intertie.sources import catalog, reports, sinks, tables

HEAD = 'C,NEM,SRRES,NEMMCO,PUBLIC,"{}"\nI,RESIDUE_PUBLIC_DATA,,1,CONTRACTID,VERSIONNO,INTERCONNECTORID,FROMREGIONID,UNITSOFFERED,UNITSSOLD,CLEARINGPRICE,RESERVEPRICE\n'


@pytest.fixture
def auctions(tmp_path):
    folder = tmp_path / "auctions"
    folder.mkdir()

    def put(name, stamp, *lines):
        (folder / name).write_text(HEAD.format(stamp) + "".join(f"D,RESIDUE_PUBLIC_DATA,,1,{l}\n" for l in lines) + "C,END OF REPORT,4\n")

    put(
        "PUBLIC_SRRES_C2029Q2T01_120260615142345.csv", "2026/06/15 14:23:45",
        "C2029Q2T01,1,NSW1-QLD1,NSW1,62,62,1674.4,0", "C2029Q2T01,1,NSW1-QLD1,QLD1,108,108,22399.6,0",
        "C2029Q2T01,1,VIC1-NSW1,NSW1,10,,,0", "BAD,1,NSW1-QLD1,NSW1,1,1,1,0", "C2029Q2T01,1,short",
    )
    put(
        "PUBLIC_SRRES_C2029Q2T01_220260616142345.csv", "2026/06/16 14:23:45",
        "C2029Q2T01,1,NSW1-QLD1,NSW1,62,62,1674.4,0", 'C2029Q2T01,2,NSW1-QLD1,QLD1,108,60,"30,912.0",0',
    )
    put("PUBLIC_SRRES_C2029Q3T02_120260617142345.csv", "2026/06/17 14:23:45")
    (folder / "empty.csv").write_text("")
    return str(folder)


def test_auction_results(spark, auctions):
    rows = reports.read_auction_results(spark, auctions).orderBy("source_file", "interconnector_id", "from_region").collect()
    assert len(rows) == 5
    assert (rows[0].auction_id, rows[0].quarter, rows[0].tranche_no) == ("A202906", "C2029Q2", 1)
    assert rows[2].units_sold == 0 and rows[2].clearing_price == 0
    assert float(rows[4].clearing_price) == 30912


def test_versioned_results_and_audit(spark, auctions):
    rows = {r.result_id: r for r in reports.read_auction_results_versioned(spark, auctions).collect()}
    assert len(rows) == 4
    assert rows["C2029Q2T01_v01_NSW1-QLD1_NSW1"].auction_datetime == dt.datetime(2026, 6, 15, 14, 23, 45)
    assert rows["C2029Q2T01_v01_VIC1-NSW1_NSW1"].status == "no_clearance"
    assert rows["C2029Q2T01_v02_NSW1-QLD1_QLD1"].status == "partial_clearance"
    audit = {r.source_file: r for r in reports.ingest_summary(spark, auctions).collect()}
    assert len(audit) == 2
    first = audit["PUBLIC_SRRES_C2029Q2T01_120260615142345.csv"]
    assert (first.snapshot_rows, first.products_loaded, first.events_loaded) == (3, 3, 1)


def test_latest_publication(spark, auctions):
    latest = valuation.auction_rows(spark, auctions, dedupe=True).where("from_region = 'QLD1'").collect()
    assert len(latest) == 1 and latest[0].units_sold == 60
    ranked = valuation.ranked_trades(valuation.auction_rows(spark, auctions), dt.date(2026, 7, 1))
    assert ranked["marks"].count() == 3
    assert {r.contract_id for r in ranked["collapsed"].collect()} == {"C2029Q2T01"}
    report = valuation.market_report(valuation.auction_rows(spark, auctions))
    assert report["pearson"].count() == 16 and report["overall"].first().pairs_evaluated == 2


def test_catalog(spark):
    names = [
        ("AUCUNITS_20241110.R016",), ("AUCUNITS_20241110.R008",), ("PUBLIC_SRRES_C2025Q3T07_220260630142930.csv",),
        ("PUBLIC_DISPATCH_IRSR_202607111315_0001.zip",), ("PUBLIC_DISPATCH_IRSR_20260401.zip",), ("other.txt",),
    ]
    rows = {r.source_file: r for r in catalog.file_catalog(spark.createDataFrame(names, "source_file string")).collect()}
    assert rows["AUCUNITS_20241110.R016"].effective_date == dt.date(2024, 11, 10)
    assert rows["AUCUNITS_20241110.R016"].revision == 16
    auction = rows["PUBLIC_SRRES_C2025Q3T07_220260630142930.csv"]
    assert (auction.file_quarter, auction.file_tranche, auction.file_time, auction.file_sequence) == ("C2025Q3", 7, "20260630142930", "2")
    assert rows["PUBLIC_DISPATCH_IRSR_202607111315_0001.zip"].file_quarter == "C2026Q3"
    assert rows["PUBLIC_DISPATCH_IRSR_20260401.zip"].file_quarter == "C2026Q2"
    assert rows["other.txt"].effective_date is None and rows["other.txt"].file_quarter is None
    listed = catalog.file_catalog(spark.createDataFrame(names, "source_file string"))
    assert catalog.load_range(listed, "C2026Q1", "C2026Q2").count() == 1
    newest = catalog.newest_files(listed.where("source_file LIKE 'AUCUNITS%'")).first()
    assert newest.source_file == "AUCUNITS_20241110.R016"


UNITS_HEAD = (
    "C,NEM,AUCUNITS,AEMO,PUBLIC,2025/06/12,12:17:48\nI,BILLING,AUCTION_UNITS,1,CONTRACTYEAR,WEEKNO,BILLRUNNO,STARTDATE,ENDDATE,"
    "BILLRUNTYPE,RESIDUEYEAR,QUARTER,INTERCONNECTORID,FROMREGIONID,PURCHASEDUNITS,TOTALSURPLUS,DISTRIBUTEDSURPLUS,AUCTIONFEES,"
    "NETPAYMENT,NETPAYMENTPERUNIT,ACCUMULATEDNETPAYMENT,ACCUMULATEDNETPAYMENTPERUNIT\n"
)


def units_line(run, week, region, surplus, net="1.5", year=2025, quarter=1):
    return (
        f'D,BILLING,AUCTION_UNITS,1,{year},{week},16,"2025/01/05 00:00:00","2025/01/11 00:00:00",{run},{year},{quarter},'
        f"V-SA,{region},100,{surplus},{surplus},0,{net},0.01,500.25,5.0025\n"
    )


@pytest.fixture
def settlement(tmp_path):
    folder = tmp_path / "units"
    folder.mkdir()
    one = UNITS_HEAD + units_line("REVISION 1", 1, "SA1", "70.5") + units_line("REVISION 1", 1, "V1", "20", net="")
    two = UNITS_HEAD + units_line("FINAL", 1, "SA1", "80.25") + units_line("FINAL", 2, "SA1", "19.75")
    (folder / "AUCUNITS_20250111.R010").write_text(one)
    (folder / "AUCUNITS_20250201.R016").write_text(two)
    return str(folder)


def test_settlement_weeks(spark, settlement):
    rows = reports.read_settlement_weeks(spark, settlement).collect()
    assert len(rows) == 3
    content = open(f"{settlement}/AUCUNITS_20250201.R016", "rb").read()
    final = [r for r in rows if r.bill_run_type == "FINAL"]
    assert final[0].source_hash == hashlib.sha256(content).hexdigest()
    assert final[0].effective_date == dt.date(2025, 2, 1) and final[0].start_date == dt.date(2025, 1, 5)
    rejects = reports.read_settlement_rejects(spark, settlement).collect()
    assert len(rejects) == 1 and ",V1," in rejects[0].value


def test_settlement_files_are_read_in_splits(spark, tmp_path):
    """One file in many splits, with a byte-order mark, carriage returns and without a last line feed."""
    body = (UNITS_HEAD + units_line("FINAL", 1, "SA1", "80.25") * 3000).replace("\n", "\r\n")
    files = {
        "AUCUNITS_20250201.R016": body.encode(), "AUCUNITS_20250208.R017": b"\xef\xbb\xbf" + body.rstrip().encode(),
        "AUCUNITS_20250215.R +18": (body + "\n\n").encode(), "AUCUNITS_20250222.R019": b"\xef\xbb\xbf" + body.encode(),
        "AUCUNITS_20250301.R020": units_line("FINAL", 1, "SA1", "1", net="")[:-1].encode(), "AUCUNITS_20250308.R021": b"",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = reports.read_settlement_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 40
        rows = reports.read_settlement_weeks(spark, str(tmp_path)).groupBy("source_file", "source_hash").count().collect()
        rejects = reports.read_settlement_rejects(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = [*files][:4]
    assert sorted(map(tuple, rows)) == [(n, hashlib.sha256(files[n]).hexdigest(), 3000) for n in kept]
    assert [r.source_file for r in rejects] == ["AUCUNITS_20250301.R020"] and not rejects[0].value.endswith("\r")


def test_reconciliation_job(spark, settlement, tmp_path):
    folder = tmp_path / "residue"
    folder.mkdir()
    (folder / "a.csv").write_text(" quarter,interconnector_id ,from_region,residue_aud\nC2025Q1,V-S-MNSP1,SA1,1\n")
    (folder / "b.csv").write_text("quarter,interconnector_id,from_region,residue_aud\nC2025Q1,V-S-MNSP1,SA1,60.5\nC2025Q1,V-SA,SA1,40\nC2025Q1,V-SA,X,oops\n")
    rows, certified = jobs.reconcile_quarters(spark, settlement, str(folder), dt.date(2025, 4, 1))
    by_region = {r.from_region: r for r in rows.collect()}
    assert float(by_region["SA1"].quarterly_residue_aud) == 100.5 and float(by_region["SA1"].total_surplus_aud) == 100
    assert by_region["SA1"].calculation_status == "reconciled" and by_region["X"].calculation_status == "incomplete_data"
    assert certified.first().certification_status == "PASS"
    document = json.loads(sinks.reconciliation_report(certified).first().value)
    assert document["summary"] == {"total_quarters": 1, "passed": 1, "not_yet": 0, "errors": 0}
    early, _ = jobs.reconcile_quarters(spark, settlement, str(folder), dt.date(2025, 3, 31))
    assert early.count() == 0


def test_header_names_decide_positions(spark, tmp_path):
    folder = tmp_path / "prices"
    folder.mkdir()
    (folder / "a.csv").write_text(
        'I,DISPATCH,PRICE,5,SETTLEMENTDATE,RUNNO,REGIONID,DISPATCHINTERVAL,RRP,RAISE6SECRRP\n'
        'D,DISPATCH,PRICE,5,"2026/07/11 13:15:00",1,NSW1,1,55.5,1.25\n'
    )
    (folder / "b.csv").write_text(
        'I,DISPATCH,PRICE,5,SETTLEMENTDATE,RUNNO,REGIONID,DISPATCHINTERVAL,INTERVENTION,RRP,NOTE\n'
        'D,DISPATCH,PRICE,5,"2026/07/11 13:20:00",1,NSW1,1,0,66.5,"x, y"\n'
        'D,DISPATCH,PRICE,5,"2026/07/11 13:20:00",1,QLD1,1,0,bad,z\n'
    )
    rows = reports.read_dispatch_prices(spark, str(folder), ["NSW1"], archived=False, pattern="*.csv").orderBy("timestamp").collect()
    assert [(r.price_mwh, r.fcas_raise_6sec_aud_per_mw) for r in rows] == [(55.5, 1.25), (66.5, 0.0)]
    named = reports.read_header_driven_report(spark, str(folder), "DISPATCH,PRICE", ["NOTE", "RRP"], pattern="*.csv")
    assert {(r.NOTE, r.RRP) for r in named.collect()} == {(None, "55.5"), ("x, y", "66.5"), ("z", "bad")}


def zipped(members: dict[str, bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, content in members.items():
            archive.writestr(name, content)
    return buffer.getvalue()


def test_nested_archives(spark, tmp_path):
    def csv(minute, value):
        return (
            "I,DISPATCH,IRSR,2,TRADING_INTERVAL,INTERCONNECTORID,FROMREGIONID,RESIDUE\n"
            f'D,DISPATCH,IRSR,2,"2026/07/11 13:{minute}:00",NSW1-QLD1,QLD1,{value}\n'
            f'D,DISPATCH,IRSR,2,"2026/07/11 13:{minute}:00",NSW1-QLD1,NSW1,oops\n'
        ).encode()

    inner = zipped({"a.CSV": csv("15", "717.833410")})
    folder = tmp_path / "irsr"
    folder.mkdir()
    (folder / "PUBLIC_DISPATCH_IRSR_20260711.zip").write_bytes(zipped({"one.zip": inner, "two.zip": zipped({"b.csv": csv("20", "82.166590")})}))
    (folder / "PUBLIC_DISPATCH_IRSR_202607111345_1.zip").write_bytes(zipped({"c.csv": csv("45", "100")}))
    (folder / "PUBLIC_DISPATCH_IRSR_broken.zip").write_bytes(b"not a zip")
    rows = reports.read_dispatch_residue_archives(spark, str(folder)).collect()
    assert sorted(float(r.residue_aud) for r in rows) == [82.16659, 100.0, 717.83341]
    assert rows[0].trading_interval.year == 2026
    total = jobs.dispatch_quarterly(spark, str(folder), "C2026Q1", "C2026Q4").first()
    assert (total.quarter, total.residue_aud) == ("C2026Q3", pytest.approx(500))


def test_surplus_archives(spark, tmp_path):
    def line(day, run, period, value):
        return f'D,SETTLEMENTS,IRSURPLUS,1,"2026/07/{day:02d} 00:00:00",{run},{period},A-B,A,0,0,{value}\n'

    text = line(1, 1, 1, 10) + line(1, 2, 1, 20) + line(1, 1, 2, 5) + "D,SETTLEMENTS,IRSURPLUS,1,bad\n"
    folder = tmp_path / "surplus"
    folder.mkdir()
    (folder / "july.zip").write_bytes(zipped({"x.csv": text.encode()}))
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "r.zip").write_bytes(zipped({"x.csv": b"D,BILLING,RUNTRK,1,2026,27,1,final\nD,BILLING,RUNTRK,1,2026,27,2,PRELIM\n"}))
    assert jobs.surplus_quarterly(spark, str(folder)).first().surplus_aud == 25
    assert jobs.surplus_quarterly(spark, str(folder), str(runs)).first().surplus_aud == 15
    assert reports.read_billing_runs(spark, str(runs)).count() == 2


def test_forecasts_take_the_newest_file(spark, tmp_path):
    folder = tmp_path / "p5"
    folder.mkdir()
    for name, price in (("PUBLIC_P5MIN_202607111300.zip", 1), ("PUBLIC_P5MIN_202607111305.zip", 2)):
        text = f'D,P5MIN,REGIONSOLUTION,1,x,x,"2026/07/11 13:10:00",NSW1,{price},0\nD,P5MIN,REGIONSOLUTION,1,x,x,"2026/07/11 13:10:00",QLD1,9,0\n'
        (folder / name).write_bytes(zipped({"x.csv": text.encode()}))
    rows = reports.read_p5min_forecast(spark, str(folder), ["NSW1"]).collect()
    assert [(r.price_mwh, r.source) for r in rows] == [(2.0, "p5min_5min")]


def test_network_tables(spark, tmp_path):
    (tmp_path / "inv.csv").write_text(
        "asset_code,asset_name,network,state,latitude,longitude,aug_cost_aud,annual_deferral_aud,capacity_mva,peak_demand_mva,available_mva,proposed_timing\n"
        "A1,One,Ausgrid,NSW,-33.8,151.2,1000000,,5,4,-3000000,2030\nA2,Two,Energex,QLD,,151.2,x,5,5,4,3,2030\n"
    )
    (tmp_path / "def.csv").write_text(
        "asset_code,asset_name,network,state,latitude,longitude,annual_deferral_aud,year\nA1,One,Ausgrid,NSW,0,0,70000,2025\nA1,One,Ausgrid,NSW,0,0,1,2024\n"
    )
    (tmp_path / "cap.csv").write_text(
        "asset_code,asset_name,network,state,latitude,longitude,capacity,load,available_capacity,year\nA1,One,Ausgrid,NSW,0,0,10,9,-2000000,2025\n"
    )
    from intertie.operators import network

    assets, deferral, capacity = tables.read_network_assets(
        spark, *[str(tmp_path / f"{n}.csv") for n in ("inv", "def", "cap")]
    )
    site = network.site_economics(network.assets_with_latest(assets, deferral, capacity), 2026).collect()
    assert len(site) == 1
    assert (site[0].adv_real, site[0].deficit_mw, site[0].ideal_bess_mw, site[0].nna_term_yrs) == (70000, 2.0, 2.0, 4)
    factors = spark.createDataFrame([("NSW1", -33.9, 151.2, 0.95)], "region string, latitude double, longitude double, factor double")
    placed = network.combined_loss_factor(
        spark.createDataFrame([("NSW1", -33.8, 151.2)], "region string, latitude double, longitude double"), factors, factors
    ).first()
    assert (placed.mlf, placed.dlf, placed.combined_lf) == (0.95, 0.95, 0.9025)


def test_writers(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([("C2025Q1", 1), ("C2025Q2", 2)], "quarter string, v int")
    sinks.write_quarterly(frame, path)
    sinks.write_quarterly(spark.createDataFrame([("C2025Q2", 5)], "quarter string, v int"), path)
    assert {(r.quarter, r.v) for r in spark.read.parquet(path).collect()} == {("C2025Q1", 1), ("C2025Q2", 5)}
    sinks.write_table(frame, str(tmp_path / "csv"), "csv")
    assert tables.read_limited(tables.read_csv(spark, str(tmp_path / "csv")), 1).collect()[0].v in ("1", "2")


def test_storage_job(spark):
    rows = [("NSW1", dt.datetime(2026, 1, 1, 0, 5 * i), float(20 + 10 * (i % 4)), "f") for i in range(11)]
    rows.append(("NSW1", dt.datetime(2026, 1, 1, 0, 0), 999.0, "g"))
    prices = spark.createDataFrame(rows, "region string, timestamp timestamp_ntz, price_mwh double, source_file string")
    forecast = prices.select("region", "timestamp", "price_mwh")
    inputs = storage.decision_inputs(prices, forecast).collect()
    assert len(inputs) == 11 and max(r.price_mwh for r in inputs) < 999
    services = {c: F.lit(10.0) for c in __import__("intertie.schemas", fromlist=["x"]).FCAS_SERVICES}
    intervals = spark.range(1).select(
        *[v.alias(k) for k, v in services.items()], F.lit(5.0).alias("raise_headroom_mw"),
        F.lit(5.0).alias("lower_headroom_mw"), F.lit(0.5).alias("soc_fraction"),
    )
    stacks = storage.service_stacks(intervals, 5.0, 10.0).first()
    assert stacks.raise_stack.total_mw + stacks.lower_stack.total_mw == pytest.approx(5.0)


def test_archives_in_any_case_and_their_outcomes(spark, tmp_path):
    import io
    import zipfile

    from intertie.sources import reports

    line = 'D,DISPATCH,IRSR,2,"2026/07/11 13:0{}:00",NSW1-QLD1,QLD1,10\n'

    def archive(text, name="a.csv"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, text)
        return out.getvalue()

    whole = archive(line.format(1))
    nested = io.BytesIO()
    with zipfile.ZipFile(nested, "w") as z:
        z.writestr("inner.ZIP", archive(line.format(2)))
        z.writestr("broken.zip", whole[: len(whole) // 2])
    files = {"good.zip": whole, "UPPER.ZIP": archive(line.format(3)), "cut.zip": whole[:-30], "none.zip": archive("x"),
             "nested.zip": nested.getvalue()}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = reports.read_dispatch_residue_archives(spark, str(tmp_path))
    assert sorted(r.source_file for r in rows.collect()) == ["UPPER.ZIP", "good.zip", "nested.zip"]
    outcomes = reports.archive_outcomes(spark, str(tmp_path), ["D,DISPATCH,IRSR,2,"]).collect()
    assert {r.source_file: (r.outcome, r.n_lines) for r in outcomes} == {
        "good.zip": ("ok", 1), "UPPER.ZIP": ("ok", 1), "cut.zip": ("corrupt", 0), "none.zip": ("empty", 0),
        "nested.zip": ("corrupt", 1),
    }
    assert all(bool(r.faults) == (r.outcome == "corrupt") for r in outcomes)


def test_headers_belong_to_a_path_and_version(spark, tmp_path):
    from intertie.sources import reports

    for folder, names, values in (
        ("a", "SETTLEMENTDATE,REGIONID,RRP", '"2026/07/11 13:15:00",NSW1,1.5'),
        ("b", "RRP,SETTLEMENTDATE,REGIONID", '2.5,"2026/07/11 13:15:00",QLD1'),
    ):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(f"I,DISPATCH,PRICE,5,{names}\nD,DISPATCH,PRICE,5,{values}\n")
    (tmp_path / "b" / "y.csv").write_text(
        "I,DISPATCH,PRICE,5,REGIONID,RRP,NOTE\nD,DISPATCH,PRICE,5,VIC1,3.5,\"a, \"\"b\"\"\"\n"
        "I,DISPATCH,PRICE,6,RRP,REGIONID\nD,DISPATCH,PRICE,6,4.5,TAS1\n"
    )
    rows = reports.read_header_driven_report(spark, str(tmp_path), "DISPATCH,PRICE", ["REGIONID", "RRP"])
    assert sorted((r.REGIONID, r.RRP) for r in rows.collect()) == [
        ("NSW1", "1.5"), ("QLD1", "2.5"), ("TAS1", "4.5"), ("VIC1", "3.5"),
    ]


def test_ledger_replay_with_null_key_parts(spark, tmp_path):
    from intertie.sources import sinks

    rows = spark.createDataFrame(
        [("t1", "p", "C2025Q1", None, 1), ("t1", "p", "C2025Q1", 2, 1)],
        "timestamp string, product_id string, quarter string, tranche int, value int",
    )
    for _ in range(2):
        sinks.append_recommendations(rows, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def test_vectors_of_other_lengths_have_no_similarity(spark):
    from intertie.operators.text import vector_search

    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 5.0]), (3, [1.0]), (4, None)], "vec_id int, embedding array<double>")
    found = [(r.vec_id, r.similarity) for r in vector_search(frame, [1.0, 0.0]).collect()]
    assert found == [(1, 1.0), (2, None), (3, None), (4, None)]
    wide = spark.createDataFrame([(1, [1.0] * 200), (2, [1.0] * 201)], "vec_id int, embedding array<double>")
    assert [r.similarity is None for r in vector_search(wide, [1.0] * 200).collect()] == [False, True]


def test_first_loaded_row_of_a_provider_wins(spark):
    from intertie.operators.network import merge_registers

    first = spark.createDataFrame([(2, "x", "b"), (1, "x", "z"), (3, "y", "c")], "line int, id string, name string")
    second = spark.createDataFrame([(1, "y", "a"), (2, "w", "d")], "line int, id string, name string")
    merged = merge_registers([first, second], load_order=["line"])
    assert sorted((r.id, r.name) for r in merged.collect()) == [("w", "d"), ("x", "z"), ("y", "c")]


def test_only_archives_of_the_range_are_opened(spark, tmp_path):
    import zipfile

    from intertie.plans.settlement import dispatch_quarterly
    from intertie.sources import catalog

    for day, good in (("20250101", True), ("20250215", True), ("20240630", False), ("20250801", False)):
        name = tmp_path / f"PUBLIC_DISPATCH_IRSR_{day}.zip"
        if good:
            with zipfile.ZipFile(name, "w") as z:
                stamp = f"{day[:4]}/{day[4:6]}/{day[6:]} 13:05:00"
                z.writestr("a.csv", f'D,DISPATCH,IRSR,2,"{stamp}",NSW1-QLD1,QLD1,10\n')
        else:
            name.write_bytes(b"not opened")
    assert catalog.dispatch_pattern("C2024Q4", "C2025Q1").count(",") == 7
    rows = dispatch_quarterly(spark, str(tmp_path), "C2025Q1", "C2025Q1").collect()
    assert {r.quarter for r in rows} == {"C2025Q1"}
    read = spark.read.format("binaryFile").option("pathGlobFilter", catalog.dispatch_pattern("C2025Q1", "C2025Q1"))
    assert read.load(str(tmp_path)).count() == 2


def test_ids_with_a_long_common_part_stay_apart(spark):
    from intertie.operators.network import merge_registers
    from intertie.sources.tables import opportunities

    long = "x" * 60
    raw = spark.createDataFrame(
        [("Energex", long + "1", "a", 1.0, 2.0), ("Energex", long + "2", "b", 1.0, 2.0)],
        "network string, asset_code string, asset_name string, latitude double, longitude double",
    )
    found = opportunities(raw)
    assert found.select("id").distinct().count() == 2 and found.select("short_id").distinct().count() == 1
    assert merge_registers([found]).count() == 2


def test_appends_read_their_own_quarters_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [(f"t{i}", "p", f"C2025Q{i % 4 + 1}" if i % 5 else None, i, i) for i in range(40)]
    frame = spark.createDataFrame(rows, "timestamp string, product_id string, quarter string, tranche int, value int")
    sinks.append_recommendations(frame, path)
    sinks.append_recommendations(frame.where("quarter = 'C2025Q2' OR quarter IS NULL"), path)
    assert spark.read.parquet(path).count() == 40
    pruned = sinks.ledger_rows(spark, path, frame.schema, ["C2025Q2", None])
    assert {f.rsplit("/", 2)[1] for f in (r[0] for r in pruned.select(F.input_file_name()).distinct().collect())} == {
        "quarter=C2025Q2", "quarter=__HIVE_DEFAULT_PARTITION__",
    }
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    with pytest.raises(ValueError):
        sinks.append_recommendations(frame, path, ["timestamp"])


def test_globs_of_archive_names():
    from intertie.sources.archives import glob_expression

    for pattern, yes, no in (
        ("*.[zZ][iI][pP]", "a.ZiP", "a.zip.x"), ("P_{20,21}*.zip", "P_21x.zip", "P_22.zip"), ("a\\*b", "a*b", "axb"),
        ("[!x]?", "ab", "xb"), ("a.b", "a.b", "acb"),
    ):
        assert glob_expression(pattern).fullmatch(yes) and not glob_expression(pattern).fullmatch(no)


def test_a_large_archive_is_read_by_many_tasks(spark, tmp_path):
    from intertie.sources import archives

    lines = spark.range(60_000).selectExpr("concat('D,DISPATCH,IRSR,2,', id, repeat(md5(cast(cast(id AS string) AS binary)), 3)) AS value").coalesce(1)
    assert archives.write_archives(lines, str(tmp_path), "PUBLIC_X") == 60_000
    read = reports.read_archive_lines(spark, str(tmp_path), ["D,DISPATCH"], part_bytes=150_000)
    assert read.rdd.getNumPartitions() > 4
    assert read.select("value").distinct().count() == 60_000 and read.count() == 60_000
