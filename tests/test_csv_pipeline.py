"""Files in, dispositions, issues, summaries and snapshots out."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.plans import datasets
from tidewright.sources import files as sources

HEADER = "Security_cd,Security Name,ISIN No.,Open Price,High Price,Low Price,Close Price,Total Traded Volume,Number of Trades,Total Turnover,FACE VALUE,COUP0N (%),Weighted Avg Price"
ROWS = [
    '007,"Bond, A", ine001a07ab1 ,"1,000.25",1001,1000,1000.2500,1200,3,"12,00,300.00",1000,8.94,1',
    "8,B,INE002B08CD2,100,100,100,100,10,1,1000,1000,0.00,1",
    "9,C,INE003C07EF3,100,99,98,,5,1,1000,1000,,1",
    "",
    "10,D,INE004D07GH4,,,,,0,0,0,100,abc,1",
    "11,B,INE002B08CD2,101,102,101,101.75,20,1,1000,1000,7%,1",
    "12,E,,100,100,100,100,1,1,1,1,,1",
    "13,B,INE002B08CD2,100,100,100,100,14.5,1,1,1,,1",
    "14,A,INE001A07AB1,-1,1000,-2,1000,1,1,1,1,,1",
]
EXPECTED = {
    2: ("ACCEPTED", None), 3: ("QUARANTINED_SUPERSEDED", 6), 4: ("QUARANTINED_INVALID", None), 5: ("ACCEPTED", None), 6: ("ACCEPTED", None),
    7: ("QUARANTINED_INVALID", None), 8: ("QUARANTINED_INVALID", None), 9: ("QUARANTINED_INVALID", None),
}


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    (folder / "BSE_fgroup01012026.csv").write_bytes(b"\xef\xbb\xbf" + "\r\n".join([HEADER, *ROWS]).encode())
    (folder / "late.csv").write_text("\n".join([HEADER, ROWS[0], "1,2"]))
    (folder / "empty.csv").write_text("\n \n")
    (folder / "twice.csv").write_text(HEADER.replace("Security Name", "isin no.") + "\n" + ROWS[0])
    (folder / "short.csv").write_text("Security_cd,ISIN No.\n1,2")
    (folder / "latin.csv").write_bytes(HEADER.encode() + b"\n\xff")
    return datasets.run_csv(sources.read_bytes(spark, str(folder)))


def test_dispositions(out):
    rows = out["canonical"].select("record_number", "disposition", "superseded_by").collect()
    assert {r.record_number: (r.disposition, r.superseded_by) for r in rows} == EXPECTED


def test_issues(out):
    found = {(r.record_number, r.code) for r in out["issues"].collect()}
    assert found == {(3, "DUPLICATE_ISIN_SUPERSEDED"), (4, "PRICE_INCONSISTENT"), (5, "INVALID_DECIMAL"), (7, "REQUIRED_VALUE_MISSING"), (8, "NOT_WHOLE_NUMBER"), (9, "NEGATIVE_VALUE")}
    sequence = [r.sequence for r in out["issues"].orderBy("sequence").collect()]
    assert sequence == list(range(1, len(sequence) + 1))


def test_rejected_records(out):
    rows = {r.record_number: json.loads(r.record) for r in out["rejected_records"].collect()}
    assert set(rows) == {3, 4, 7, 8, 9} and rows[8]["traded_volume"] == "14.5" and rows[7]["isin"] == ""


def test_rejected_files_give_no_rows(out):
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in out["rejected_files"].collect()}
    assert errors == {"late.csv": "MALFORMED_CSV", "empty.csv": "EMPTY_FILE", "twice.csv": "DUPLICATE_HEADER", "short.csv": "REQUIRED_HEADER_MISSING", "latin.csv": "MALFORMED_CSV"}
    assert out["canonical"].select("path").distinct().count() == 1


def test_projections(out):
    summaries = {r.record_number: r for r in out["summaries"].collect()}
    assert set(summaries) == {2, 5, 6} and summaries[2].isin == "INE001A07AB1" and summaries[2].turnover == "1200300.00" and summaries[2].security_code == "007"
    coupons = {(r.isin, r.coupon_rate_value, r.coupon_rate_unit) for r in out["coupons"].collect()}
    assert coupons == {("INE001A07AB1", "8.94", "PERCENT"), ("INE002B08CD2", "7", "PERCENT")}
    count = out["counts"].first()
    assert (count.source_rows, count.accepted_rows, count.invalid_rows, count.superseded_rows, count.job_status) == (8, 3, 4, 1, "COMPLETED_WITH_ERRORS")


def test_snapshots_and_evidence(spark, out, tmp_path):
    datasets.publish(spark, str(tmp_path), {"summaries": out["summaries"], "coupons": out["coupons"]})
    assert datasets.current(spark, str(tmp_path), "summaries").count() == 3
    datasets.publish(spark, str(tmp_path), {"summaries": datasets.repair(out["summaries"], face_value=F.lit("1")), "coupons": out["coupons"].limit(1)})
    assert {r.face_value for r in datasets.current(spark, str(tmp_path), "summaries").collect()} == {"1"}
    line = json.loads(datasets.evidence(out["canonical"]).first().value)
    assert line["coupon_rate"]["errors"] == [] and "superseded_by" in line


def test_manifest_and_verification(spark, tmp_path):
    (tmp_path / "data" / "b" / "k").mkdir(parents=True)
    (tmp_path / "data" / "b" / "k" / "BSE_x01012026.csv").write_text("a")
    digest = "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
    file = {"bucket": "b", "key": "k/BSE_x01012026.csv", "format": "CSV", "sha256": digest, "size_bytes": 1, "job_id": "j", "source_url": "u"}
    manifest = {**sources.CONSTANTS, "id": "1", "dataschema": "d", "subject": "s", "data": {"schema_version": 1, "event_type": "x", "event_id": "e", "run_id": "r", "dataset_fingerprint": "f", "inputs": {"tradeDate": "2026-01-01"}, "files": [file]}}
    (tmp_path / "m1.json").write_text(json.dumps(manifest))
    manifest["data"] |= {"run_id": " ", "files": [file, file | {"sha256": "x", "size_bytes": 0}]}
    (tmp_path / "m2.json").write_text(json.dumps(manifest))
    read = {r.manifest[-7:]: r.problems for r in sources.read_manifests(spark, str(tmp_path / "m*.json")).collect()}
    other = manifest | {"source": "me", "type": None, "data": manifest["data"] | {"schema_version": 2, "run_id": "r", "inputs": None, "files": [file | {"key": " "}]}}
    (tmp_path / "m3.json").write_text(json.dumps(other))
    wrong = sources.read_manifests(spark, str(tmp_path / "m3.json")).first().problems
    assert {"type is required", f"source must be {sources.CONSTANTS['source']}", "data.schema_version must be 1", "data.inputs is required", "files need a bucket and a key"} == set(wrong)
    assert read["m1.json"] == [] and read["m2.json"] == ["data.run_id is required", "files hold an invalid sha256", "files hold an invalid size", "files list an object twice"]
    listed = sources.listed_files(sources.read_manifests(spark, str(tmp_path / "m1.json")))
    have = sources.read_bytes(spark, str(tmp_path / "data" / "b" / "k"))
    assert sources.verify(have, listed).first().problem is None
    assert sources.verify(have, listed.withColumn("size_bytes", F.lit(2).cast("long"))).first().problem == "CHECKSUM_MISMATCH"
    exchange, day = sources.csv_name(F.lit("bse_fgroup01012026.csv"))
    row = spark.range(1).select(exchange.alias("e"), day.cast("string").alias("d"), sources.json_name(F.lit("ine0_details.json")).alias("i")).first()
    assert (row.e, row.d, row.i) == ("BSE", "2026-01-01", "INE0")


def test_objects_of_one_name_are_told_apart(spark, tmp_path):
    for folder, text in (("a", "x"), ("c", "y")):
        (tmp_path / "b" / folder).mkdir(parents=True)
        (tmp_path / "b" / folder / "f.csv").write_text(text)
    import hashlib

    digest = hashlib.sha256(b"x").hexdigest()
    listed = spark.createDataFrame([("b", "a/f.csv", "sha256:" + digest.upper(), 1, "r1"), ("b", "c/f.csv", digest, 1, "r2")], "bucket string, key string, sha256 string, size_bytes long, run_id string")
    found = {r.run_id: r.problem for r in sources.verify(sources.read_bytes(spark, str(tmp_path / "b" / "*")), listed).collect()}
    assert found == {"r1": None, "r2": "CHECKSUM_MISMATCH"}


def test_run_dataset(spark, tmp_path):
    import hashlib

    (tmp_path / "in" / "b").mkdir(parents=True)
    header = ",".join(f.header for f in datasets.DAILY_CSV.fields)
    files = {}
    for name, ok in (("BSE_one01012026.csv", True), ("BSE_two02012026.csv", False)):
        body = header + "\n" + ",".join("INE001A07AB1" if f.name == "isin" else "" for f in datasets.DAILY_CSV.fields) + "\n"
        (tmp_path / "in" / "b" / name).write_text(body)
        files[name] = {"bucket": "b", "key": name, "format": "CSV", "sha256": hashlib.sha256(body.encode()).hexdigest() if ok else "0" * 64, "size_bytes": len(body)}
    for i, listed in enumerate(([files["BSE_one01012026.csv"]], [files["BSE_two02012026.csv"]], list(files.values()))):
        manifest = {**sources.CONSTANTS, "id": "1", "dataschema": "d", "subject": "s", "data": {"schema_version": 1, "event_type": "x", "event_id": "e", "run_id": f"r{i}", "dataset_fingerprint": "f", "inputs": {}, "files": listed}}
        (tmp_path / f"m{i}.json").write_text(json.dumps(manifest))
    out = datasets.run_dataset(spark, str(tmp_path / "in" / "b"), str(tmp_path / "m*.json"))
    assert out["canonical"].select("path").distinct().count() == 1 and out["summaries"].first().isin == "INE001A07AB1"
    assert [r.problem for r in out["rejected_manifests"].collect()] == ["INVALID_MANIFEST"]
    assert [(r.path[-19:], r.problem) for r in out["unverified"].collect()] == [("BSE_two02012026.csv", "CHECKSUM_MISMATCH")]


def test_names_of_csv_files(spark):
    names = ["bse_x01012026.CSV", "Börse 1 _x_31122025.csv", "_x01012026.csv", " _x01012026.csv", "BSE_x31022026.csv", "BSE_x0101202.csv", "BSE01012026.csv", "A_1_01012026.csv.csv", None]
    exchange, day = sources.csv_name(F.col("n"))
    found = [(r.e, r.d) for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(exchange.alias("e"), day.cast("string").alias("d")).collect()]
    assert found[:2] == [("BSE", "2026-01-01"), ("BÖRSE 1", "2025-12-31")] and found[2:] == [(None, None)] * 7


def test_csv_names_agree_with_inputs(spark):
    rows = [
        ("ok", "a/BSE_01012026.csv", {"exchangeName": " bse ", "tradeDate": "2026-01-01"}), ("day", "BSE_02012026.csv", {"exchangeName": "BSE", "tradeDate": "2026-01-01"}),
        ("exchange", "NSE_01012026.csv", {"exchangeName": "BSE", "tradeDate": "2026-01-01"}), ("none", "BSE_01012026.csv", {}), ("name", "x.csv", {}),
    ]
    found = dict(sources.csv_name_problems(spark.createDataFrame(rows, "manifest string, key string, inputs map<string,string>")).collect())
    assert found == {"ok": None, "day": "TRADE_DATE_MISMATCH", "exchange": "TRADE_DATE_MISMATCH", "none": "TRADE_DATE_MISMATCH", "name": "INVALID_SOURCE_FILENAME"}


def test_run_dataset_holds_manifests_against_submissions(spark, tmp_path):
    import hashlib

    (tmp_path / "in" / "b").mkdir(parents=True)
    header = ",".join(f.header for f in datasets.DAILY_CSV.fields)
    agreed, runs = [], {"good": "01", "subject": "02", "late": "03", "unknown": "04"}
    for run, day in runs.items():
        body = header + "\n" + ",".join("INE001A07AB1" if f.name == "isin" else "" for f in datasets.DAILY_CSV.fields) + "\n"
        (tmp_path / "in" / "b" / f"BSE_{day}012026.csv").write_text(body)
        file = {"bucket": "b", "key": f"BSE_{day}012026.csv", "format": "CSV", "sha256": hashlib.sha256(body.encode()).hexdigest(), "size_bytes": len(body)}
        inputs = {"exchangeName": "BSE", "tradeDate": "2026-01-09" if run == "late" else f"2026-01-{day}"}
        data = {"schema_version": 1, "event_type": "x", "event_id": "e", "run_id": run, "dataset_fingerprint": "f", "inputs": inputs, "files": [file]}
        (tmp_path / f"m-{run}.json").write_text(json.dumps({**sources.CONSTANTS, "id": "1", "dataschema": "d", "subject": "s", "data": data}))
        agreed += [] if run == "unknown" else [(run, "d", "other" if run == "subject" else "s", "x", "e", run, inputs, "f")]
    submitted = spark.createDataFrame(agreed, "run string, dataschema string, subject string, event_type string, event_id string, run_id string, inputs map<string,string>, dataset_fingerprint string")
    out = datasets.run_dataset(spark, str(tmp_path / "in" / "b"), str(tmp_path / "m-*.json"), submitted=submitted)
    found = {r.manifest.rsplit("m-", 1)[1]: r.problem for r in out["rejected_manifests"].collect()}
    assert found == {"subject.json": "INVALID_MANIFEST: subject", "unknown.json": "INVALID_MANIFEST: no submission", "late.json": "TRADE_DATE_MISMATCH"}
    assert [r.path[-16:] for r in out["canonical"].select("path").distinct().collect()] == ["BSE_01012026.csv"]
