import pytest
from helpers import by, payloads

from sessionloom.operators.gate import gate_counters, gate_payloads, latest_payload
from sessionloom.schemas import MAX_PAYLOAD_BYTES

TRACES = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"a","spanId":"b","name":"synthetic"}]}]}]}'
LOGS = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":{"stringValue":"synthetic"}}]}]}]}'


def test_documented_cases_and_counters(spark):
    gated = gate_payloads(
        payloads(
            spark,
            [
                ("traces", "traces", TRACES),
                ("logs", "logs", LOGS),
                ("cut", "traces", '{"resourceSpans":'),
                ("empty", "traces", '{"resourceSpans":[]}'),
                ("large", "traces", "x" * (MAX_PAYLOAD_BYTES + 1)),
                ("media", "traces", "application/x-protobuf", '{"resourceSpans":[{}]}'),
            ],
        )
    )
    assert by(gated, "payload_id", "error_code") == {
        "traces": None,
        "logs": None,
        "cut": "malformed_payload",
        "empty": "invalid_payload",
        "large": "payload_too_large",
        "media": "unsupported_media_type",
    }
    assert gate_counters(gated).first().asDict() == {"accepted_payloads": 2, "rejected_payloads": 4}


def test_media_type_parameters(spark):
    good = ["application/json; charset=utf-8", "\tapplication/JSON ;a=b; A=b", 'application/json;q="x\\"; y"', "application/json;"]
    bad = ["application/json; charset", "application/json; a=b; a=c", "application/json x", "text/json", ""]
    rows = [(kind, "traces", kind, TRACES) for kind in good + bad]
    codes = by(gate_payloads(payloads(spark, rows)), "payload_id", "error_code")
    assert [codes[kind] for kind in good] == [None] * len(good)
    assert [codes[kind] for kind in bad] == ["unsupported_media_type"] * len(bad)


def test_unset_session_is_refused(spark):
    rows = payloads(spark, [("a", "traces", TRACES)])
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    try:
        with pytest.raises(ValueError, match="allowDuplicateKeys"):
            gate_payloads(rows)
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def test_latest_payload_is_not_sorted(spark):
    gated = gate_payloads(payloads(spark, [("a", "traces", TRACES), ("b", "traces", TRACES)]))
    latest = latest_payload(gated)
    assert "rangepartitioning" not in latest._jdf.queryExecution().executedPlan().toString()
    assert [row.payload_id for row in latest.select("payload_id").collect()] == ["b"]


def test_strict_json_and_shape(spark):
    exact = LOGS + " " * (MAX_PAYLOAD_BYTES - len(LOGS))
    cases = {
        "two values": ("{} {}", "malformed_payload"),
        "trailing text": (LOGS + "x", "malformed_payload"),
        "array trick": (LOGS + "],[{}", "malformed_payload"),
        "digest trick": (LOGS + ',"0"', "malformed_payload"),
        "null": ("null", "invalid_payload"),
        "array": ("[1]", "malformed_payload"),
        "string": ('"x"', "malformed_payload"),
        "nothing": ("", "malformed_payload"),
        "single quotes": ("{'resourceLogs':[1]}", "malformed_payload"),
        "not a number": ('{"resourceLogs":[NaN]}', "malformed_payload"),
        "leading zero": ('{"resourceLogs":[01]}', "malformed_payload"),
        "extra key": ('{"resourceLogs":[1],"x":1}', "invalid_payload"),
        "other signal": (TRACES, "invalid_payload"),
        "not a list": ('{"resourceLogs":{}}', "invalid_payload"),
        "null list": ('{"resourceLogs":null}', "invalid_payload"),
        "any item": ('{"resourceLogs":[1]}', None),
        "last key wins": ('{"resourceLogs":[],"resourceLogs":[1]}', None),
        "exactly the limit": (exact, None),
    }
    rows = [(name, "logs", body) for name, (body, _) in cases.items()]
    found = by(gate_payloads(payloads(spark, rows)), "payload_id", "error_code")
    assert found == {name: code for name, (_, code) in cases.items()}


def test_media_types(spark):
    kinds = {
        "application/json; charset=utf-8": None,
        "Application/JSON": None,
        "text/plain": "unsupported_media_type",
        "": "unsupported_media_type",
        None: "unsupported_media_type",
    }
    rows = [(str(kind), "logs", kind, LOGS) for kind in kinds]
    found = by(gate_payloads(payloads(spark, rows)), "payload_id", "error_code")
    assert found == {str(kind): code for kind, code in kinds.items()}
