import json
import os

import pytest
from pyspark.sql import functions as F

from tidewright.plans import securities
from tidewright.sources import files as sources

DETAILS = {"issuerName": "Issuer", "issuerTypeOwner": "-", "instrumentType": None, "isin": "INE1"}
INSTRUMENT = {"instrumentsVo": {"instruments": {"allotmentDate": "01-02-2020", "redemptionDate": "N.A.", "issuePrice": 1000.50, "totalIssueSize": "1,00,000"},
              "assetCover": {"securedFlag": "UnSecured", "assetCvge": "book", "assetCvrPercent": "100 %", "assetList": [{"assetType": "land"}]}}}
COUPON = {"coupensVo": {"couponDetails": {"couponRate": "8.94% (fixed)", "couponType": 7}, "cashFlowScheduleDetails": {
    "cashFlowSchedule": [{"cashFlowsEvent": "Interest", "dueDate": "01-01-2021", "amountPayable": "100"}, {}, {"cashFlowsEvent": "Redemption", "recordDate": "bad"}],
    "interestCashFlowSchedule": [{"cashFlowsEvent": "Interest", "dueDate": "01-01-2021", "amountRedeem": 100.00}]}}}
RATINGS = {"currentRatings": [{"creditRatingAgencyName": "A", "currentRating": "AA"}], "earlierRatings": [{"creditRatingAgencyName": "A", "currentRating": "AA"}], "listingDetails": {"exchangeName": "x"}}


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("json")
    files = {"INE1_a.json": DETAILS, "INE1_b.json": INSTRUMENT, "INE1_c.json": COUPON, "INE1_d.json": RATINGS, "INE1_e.json": {"issuerName": "Newer", "instrumentsVo": 5}, "INE3_x.json": {"other": 1}}
    for i, (name, body) in enumerate(files.items()):
        (folder / name).write_text(json.dumps(body))
        os.utime(folder / name, (1_700_000_000 + i, 1_700_000_000 + i))
    (folder / "INE2_a.json").write_text('{"issuerName": "Two"} trailing')
    (folder / "ine2_b.json").write_text('{"issuerName": "Two"}')
    return securities.run_json(sources.read_bytes(spark, str(folder)))


def test_security(out):
    rows = {r.isin: r for r in out["security"].collect()}
    one = rows["INE1"]
    assert one.issuer_name == "Newer" and one.issuer_ownership_type is None and one.allotment_date == "2020-02-01" and one.redemption_date is None
    assert float(one.original_face_value) == 1000.5 and one.total_issue_size == "100000" and one.coupon_rate == "8.94" and one.coupon_type is None
    assert one.collateral_status == "UnSecured" and one.asset_coverage is None and one.asset_coverage_basis is None and rows["INE2"].issuer_name == "Two"
    source = {r.isin: r.field_sources for r in out["field_sources"].collect()}["INE1"]["issuer_name"]
    assert source.path.endswith("INE1_e.json") and source.json_path == "$.issuerName"


def test_collections(out):
    flows = {(r.event_type, r.source_category) for r in out["cash_flow"].collect()}
    assert flows == {("Interest", "SCHEDULE"), ("Redemption", "SCHEDULE")}
    assert sorted(r.source_category for r in out["rating"].collect()) == ["CURRENT", "EARLIER"]
    assert out["listing"].count() == 0 and out["collateral_asset"].count() == 0


def test_review_rows(out):
    assert {r.json_path for r in out["conflicts"].collect()} == {"$.instrumentsVo.assetCover.assetCvge", "$.instrumentsVo.assetCover.assetCvrPercent", "$.instrumentsVo.assetCover.assetList[0]"}
    assert [(r.path[-11:], r.json_path) for r in out["structure_issues"].collect()] == [("INE1_e.json", "$.instrumentsVo")]
    jobs = {r.isin: (r.listed, r.skipped, r.status) for r in out["jobs"].collect()}
    assert jobs == {"INE1": (5, 0, "COMPLETED_WITH_ERRORS"), "INE2": (2, 1, "COMPLETED_WITH_ERRORS"), "INE3": (1, 0, "FAILED")}


def test_apply_changes(spark, out):
    names = ", ".join(f"{n} string" for n in securities.SCALARS)
    blank = dict.fromkeys(securities.SCALARS)
    stored = spark.createDataFrame([{"isin": "INE1", **blank, "issuer_name": "Old", "asset_coverage": "9", "updated_at": "t0"}, {"isin": "INE9", **blank, "issuer_name": "Kept", "updated_at": "t0"}], f"isin string, {names}, updated_at string")
    merged = {r.isin: r for r in securities.apply_changes(stored, out["security"], spark.createDataFrame([("INE1",)], "isin string"), F.lit("t1")).collect()}
    assert merged["INE1"].issuer_name == "Newer" and merged["INE1"].asset_coverage is None and merged["INE1"].updated_at == "t1"
    assert merged["INE9"].issuer_name == "Kept" and merged["INE9"].fields_changed == 0 and merged["INE9"].updated_at == "t0"


def test_rejected_parts(out):
    rows = [(r.path[-11:], r.kind, r.json_path, r.sequence) for r in out["rejections"].where("isin = 'INE1'").orderBy("sequence").collect()]
    kinds = [(p, k, j) for p, k, j, _ in rows]
    cover = "$.instrumentsVo.assetCover."
    assert [n for *_, n in rows] == list(range(1, len(rows) + 1))
    assert kinds == [
        ("INE1_b.json", "VALUE_IGNORED", f"{cover}assetCvge"), ("INE1_b.json", "VALUE_IGNORED", f"{cover}assetCvrPercent"), ("INE1_b.json", "VALUE_IGNORED", f"{cover}assetList[0]"),
        ("INE1_c.json", "FIELD_REJECTED", "$.coupensVo.couponDetails.couponType"),
        ("INE1_c.json", "ENTRY_FIELDS_REJECTED", "$.coupensVo.cashFlowScheduleDetails.cashFlowSchedule[2]"),
        ("INE1_d.json", "SECTION_REJECTED", "$.listingDetails"), ("INE1_e.json", "SECTION_REJECTED", "$.instrumentsVo"),
    ]
    assert [r.kind for r in out["rejections"].where("isin = 'INE2'").collect()] == ["FILE_SKIPPED"]
    assert out["warnings"].count() == 0


def test_strict_documents(spark):
    from tidewright.functions import json_values

    texts = ['{"a":"\\\\u0000"}', '{"a":"\\u0000"}', "[" * 32 + "]" * 32, "[" * 33 + "]" * 33, '"' + "[" * 90 + '"', '{"a":1} x', "\ufeff[1]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", json_values.strict_document(F.col("t")).isNotNull().alias("ok")).orderBy("i").collect()
    assert [r.ok for r in rows] == [True, False, True, False, True, False, True]


def test_admission_keeps_only_what_is_accepted(spark):
    from tidewright.streaming import admission

    schema = "sequence int, idempotency_key string, event_key string, payload_hash string"
    old = spark.createDataFrame([(0, "k0", "e0", "h0")], schema)
    new = spark.createDataFrame([(1, "k0", "e2", "hX"), (2, "k9", "e2", "h9"), (3, "k9", "e2", "h9"), (4, "k9", "e3", "h9"), (5, "k5", "e3", "h"), (6, "k0", "e0", "h0"), (7, "k0", "e0", "h1"), (8, None, "e9", "h"), (9, "k6", "e9", "h")], schema)
    got = {r.sequence: r.outcome for r in admission.admit(old, new).collect()}
    assert got == {1: "CONFLICT", 2: "ACCEPTED", 3: "REPLAY", 4: "CONFLICT", 5: "ACCEPTED", 6: "REPLAY", 7: "CONFLICT", 8: "INVALID", 9: "ACCEPTED"}
    assert admission.admit(old, new.limit(0)).count() == 0


def test_events_are_applied_in_order(spark):
    from tidewright.streaming import admission

    events = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4), ("b", 5), ("c", 6)], "g string, n int")
    seen = []

    def apply(heads):
        rows = [(r.g, r.n) for r in heads.collect()]
        seen.extend(rows)
        return heads.where("n <> 3")

    assert admission.apply_in_order(events, ["g"], "n", apply) == 3
    assert sorted(seen) == [("a", 1), ("a", 2), ("a", 4), ("b", 3), ("c", 6)] and [n for g, n in seen if g == "a"] == [1, 2, 4]


def test_every_error_counts_and_keeps_its_value(spark, tmp_path):
    """A conflict, a wrong section, a skipped file and a lost date each make COMPLETED_WITH_ERRORS; values stay as read."""
    from tidewright.functions import numerals

    bodies = {
        "INA_x.json": '{"instrumentsVo":{"assetCover":{"securedFlag":"UNSECURED","assetList":[{"assetType":"land"},{"assetType":"-"},{"assetType":7,"remarks":"r"}]}}}',
        "INB_x.json": '{"issuerName":"B","coupensVo":"none"}',
        "INC_x.json": '{"issuerName":"C","instrumentsVo":{"instruments":{"allotmentDate":"99-99-2020","redemptionDate":20.50,"issuePrice":-0.50,"totalIssueSize":1234567890123456789012345678901234567890.50}}}',
        "IND_x.json": '{"issuerName":"D"}',
        "INE_x.json": '{"issuerName":"E","coupensVo":{"couponDetails":{"couponRate":1e2}},"listingDetails":[{"exchangeName":4,"listingDate":[1.50]}]}',
        "INF_x.json": '{"isin":"other"',
        "ING_x.json": '{"coupensVo":{"couponDetails":{"couponRate":"%"}}}',
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    out = securities.run_json(sources.read_bytes(spark, str(tmp_path)))
    jobs = {r.isin: (r.listed, r.processed, r.skipped, r.fields_rejected, r.errors, r.status) for r in out["jobs"].collect()}
    some, all_well, failed = "COMPLETED_WITH_ERRORS", "COMPLETED", "FAILED"
    assert jobs == {
        "INA": (1, 1, 0, 1, 3, some), "INB": (1, 1, 0, 2, 1, some), "INC": (1, 1, 0, 3, 3, some), "IND": (1, 1, 0, 0, 0, all_well),
        "INE": (1, 1, 0, 2, 2, some), "INF": (1, 0, 1, 0, 1, failed), "ING": (1, 1, 0, 1, 1, failed),
    }
    told = [tuple(r) for r in out["issues"].orderBy("isin", "sequence").select("isin", "sequence", "kind", "json_path", "field", "code", "value").collect()]
    inst, cover = "$.instrumentsVo.instruments.", "$.instrumentsVo.assetCover.assetList"
    conflict = "CONFLICTING_COLLATERAL_DATA"
    assert told == [
        ("INA", 1, "ENTRY_FIELDS_REJECTED", f"{cover}[2].assetType", "asset_type", "INVALID_TYPE", "7"),
        ("INA", 2, "VALUE_IGNORED", f"{cover}[0]", None, conflict, '{"asset_type":"land"}'),
        ("INA", 3, "VALUE_IGNORED", f"{cover}[2]", None, conflict, '{"remarks":"r"}'),
        ("INB", 1, "SECTION_REJECTED", "$.coupensVo", None, "INVALID_TYPE", None),
        ("INC", 1, "FIELD_REJECTED", f"{inst}allotmentDate", "allotment_date", "INVALID_DATE", '"99-99-2020"'),
        ("INC", 2, "FIELD_REJECTED", f"{inst}redemptionDate", "redemption_date", "INVALID_TYPE", "20.50"),
        ("INC", 3, "FIELD_REJECTED", f"{inst}issuePrice", "original_face_value", "NEGATIVE_VALUE", "-0.50"),
        ("INE", 1, "ENTRY_SKIPPED", "$.listingDetails[0].exchangeName", "exchange_name", "INVALID_TYPE", "4"),
        ("INE", 2, "ENTRY_SKIPPED", "$.listingDetails[0].listingDate", "listing_date", "INVALID_TYPE", "[1.50]"),
        ("INF", 1, "FILE_SKIPPED", "$", None, "MALFORMED_JSON", None),
        ("ING", 1, "FIELD_REJECTED", "$.coupensVo.couponDetails.couponRate", "coupon_rate", "INVALID_DECIMAL", '"%"'),
    ]
    values = {r.isin: (r.total_issue_size, r.coupon_rate) for r in out["security"].collect()}
    assert values["INC"][0] == "1234567890123456789012345678901234567890.50" and values["INE"][1] == "100"
    assert [r.isin for r in out["cleared"].collect()] == ["INA"] and out["collateral_asset"].count() == 0
    counts = securities.outcomes(out["jobs"], out["jobs"].selectExpr("isin", "2 AS fields_changed"), out["jobs"].selectExpr("isin", "3 AS entries_appended").where("isin = 'INA'"))
    assert json.loads(counts.where("isin = 'INA'").first().counts) == {"filesListed": 1, "filesProcessed": 1, "filesSkipped": 0, "scalarFieldsChanged": 2, "collectionEntriesAppended": 3, "fieldsRejected": 1}
    assert numerals.canonical_json('{"b": 2.50, "a": [-0, 1e5, "\\u00e9\\n"]}') == '{"a":[0,1E+5,"é\\n"],"b":2.50}'


def test_canonical_texts():
    from tidewright.functions.numerals import canonical_json

    assert canonical_json('{"a":2.50}') != canonical_json('{"a":2.5}')
    assert canonical_json("[" + "1" * 40 + ".0]") == "[" + "1" * 40 + ".0]"
    assert canonical_json('{"\U0001f642":1,"\uffee":2}') == '{"\U0001f642":1,"\uffee":2}'  # by UTF-16 units
    assert [canonical_json(t) for t in (None, "", "{", '{"a":1,"a":2}', "[1] 2", "NaN", "[01]", "[" * 100_000)] == [None] * 8
    assert canonical_json('"\\u0001\\t\\"/"') == '"\\u0001\\t\\"/"'
