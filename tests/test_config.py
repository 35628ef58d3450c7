"""Model versions as a table of JSON texts."""

import json

from laborlens.config import validate_versions

GOOD = {
    "weights": {"skills": 35, "experience": 20, "occupation": 15, "interests": 10, "values": 10, "practical": 10},
    "knockouts": {
        "language": {"enabled": True, "toleranceLevels": 0}, "location": {"enabled": True, "graceMinutes": 10, "hybridTravelFactor": 1.25},
        "salary": {"enabled": False, "tolerancePct": 5}, "contract": {"enabled": True}, "education": {"enabled": True}},
    "thresholds": {"strong": 75, "good": 60, "possible": 45},
    "skills": {"mustWeight": 2, "niceWeight": 1, "relatedCredit": 0.5, "recency": [{"maxYears": 2, "factor": 1}, {"maxYears": None, "factor": 0.6}], "unknownRecencyFactor": 0.85},
    "experience": {"similarityFloor": 0.72, "similarityCeil": 0.9}, "limitedDataThreshold": 0.35,
}


def test_a_version_is_parsed_once(spark):
    odd = {**GOOD, "thresholds": {"strong": 75, "good": 80, "possible": 45}, "skills": {**GOOD["skills"], "recency": [{"maxYears": 2, "factor": 2}]}}
    rows = [(1, json.dumps(GOOD)), (2, json.dumps(odd)), (3, None), (4, "{"), (5, json.dumps({**GOOD, "weights": {**GOOD["weights"], "skills": 101}}))]
    out = validate_versions(spark.createDataFrame(rows, "version int, config string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    got = {r["version"]: (r["errors"], r["is_valid"]) for r in out.collect()}
    assert got[1] == ([], True) and got[2] == (["thresholds", "skills"], False) and got[5] == (["weights.skills", "weights"], False)
    assert not got[3][1] and got[3][0] == got[4][0] and len(got[3][0]) == 15
