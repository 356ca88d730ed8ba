import json

from helpers import LOG_SERVICE, SALT, by, log_payload, pair, payloads
from pyspark.sql import functions as F

from sessionloom.operators.logs import log_events
from sessionloom.plans.pipelines import classify_payloads, safe_log_events


def classified(spark, bodies):
    return classify_payloads(payloads(spark, [(name, "logs", body) for name, body in bodies.items()]))


def test_observed_shape(spark):
    resource = {"attributes": [*LOG_SERVICE["attributes"], pair("service.version", stringValue="0.145.0")]}
    record = {
        "attributes": [
            pair("event.name", stringValue="codex.sse_event"),
            pair("model", stringValue="synthetic-model"),
            pair("input_token_count", stringValue="100"),
        ],
        "severityText": "INFO",
    }
    event = log_events(classified(spark, {"p": log_payload(record, resource=resource)}), SALT).first()
    assert event.event_id == event.session_id and event.event_id.startswith("codex-log:hmac-sha256:")
    assert (event.event_type, event.model, event.source_version) == ("codex.sse_event", "synthetic-model", "0.145.0")
    attributes = json.loads(str(event.attributes))
    assert attributes["input_token_count"] == "100" and "output_token_count" not in attributes
    assert event.occurred_at == event.received_at


def test_identity_covers_body_and_times(spark):
    name = pair("event.name", stringValue="codex.tool_result")
    first = {"attributes": [name], "body": {"stringValue": "a"}, "timeUnixNano": "1"}
    second = {"attributes": [name], "body": {"stringValue": "b"}, "timeUnixNano": "2"}
    events = log_events(classified(spark, {"p": log_payload(first, second, first)}), SALT).collect()
    ids = [event.event_id for event in sorted(events, key=lambda event: event.record_index)]
    assert ids[0] != ids[1] and ids[0] == ids[2]
    other = log_events(classified(spark, {"p": log_payload(first)}), bytes(32)).first().event_id
    assert other != ids[0]


def test_different_records_have_different_ids(spark):
    def one(record):
        return json.dumps({"resourceLogs": [{"resource": LOG_SERVICE, "scopeLogs": [{"logRecords": [record]}]}]})

    records = [
        {"body": {"a": 1, "b": 2}},
        {"body": {"b": 2, "a": 1}},
        {"attributes": []},
        {},
        {"body": '{"a": 1}'},
        {"body": {"a": 1}},
        {"body": None},
    ]
    bodies = {str(at): one(record) for at, record in enumerate(records)}
    events = by(log_events(classified(spark, bodies), SALT), "payload_id", "event_id")
    assert len(set(events.values())) == 6 and events["3"] == events["6"]


def test_numbers_beyond_a_double_fail(spark):
    def with_value(text):
        return log_payload({"attributes": [pair("n", doubleValue=0)]}).replace('"doubleValue": 0', text)

    cases = {
        "scalar": (with_value('"doubleValue": 1e400'), "failed"),
        "inside": (with_value('"arrayValue": {"values": [{"doubleValue": -1e999}]}'), "failed"),
        "largest": (with_value('"doubleValue": 1.7e308'), "normalised"),
        "later item": (with_value('"arrayValue": [1, 1e400]'), "failed"),
        "many digits": (with_value('"kvlistValue": {"a": ' + "9" * 310 + "}"), "failed"),
        "beside a scalar": (with_value('"stringValue": "x", "other": 1e400'), "failed"),
        "text": (with_value('"stringValue": "Infinity"'), "normalised"),
        "text inside": (with_value('"arrayValue": {"values": [{"stringValue": "Infinity"}, "-Infinity", 1e-400]}'), "normalised"),
        "escaped text": (with_value('"arrayValue": ["\\u0049nfinit\\u0079", "\\u002DInfinity", 1e200]'), "normalised"),
        "name": (with_value('"kvlistValue": {"Infinity": 1e200}'), "normalised"),
        "quoted text": (with_value('"arrayValue": ["say \\"Infinity", "\\"Infinity\\"", "1e400"]'), "normalised"),
        "text and number": (with_value('"arrayValue": ["Infinity", 1e400]'), "failed"),
    }
    verdicts = by(classified(spark, {name: body for name, (body, _) in cases.items()}), "payload_id", "log_verdict")
    assert verdicts == {name: verdict for name, (_, verdict) in cases.items()}


def test_verdicts_and_type_mismatches(spark):
    service = LOG_SERVICE

    def tree(**entry):
        return json.dumps({"resourceLogs": [{"resource": service, **entry}]})

    cases = {
        "null record": (log_payload({"body": None}, None), "normalised"),
        "no service": (json.dumps({"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": []}]}), "unsupported"),
        "other service": (log_payload({}, resource={"attributes": [pair("service.name", stringValue="x")]}), "unsupported"),
        "null entry": ('{"resourceLogs":[null]}', "unsupported"),
        "numeric time": (log_payload({"timeUnixNano": 5}), "failed"),
        "numeric severity": (log_payload({"severityText": 1}), "failed"),
        "entry no object": ('{"resourceLogs":[5]}', "failed"),
        "resource list": (json.dumps({"resourceLogs": [{"resource": []}]}), "failed"),
        "scopes object": (tree(scopeLogs={"logRecords": []}), "failed"),
        "record text": (tree(scopeLogs=[{"logRecords": ["x"]}]), "failed"),
        "records flag": (tree(scopeLogs=[{"logRecords": True}]), "failed"),
        "numeric key": (log_payload({"attributes": [{"key": 1}]}), "failed"),
        "text value": (log_payload({"attributes": [{"key": "a", "value": "x"}]}), "failed"),
        "fault in unsupported": (
            json.dumps({"resourceLogs": [{"resource": {"attributes": [{"key": 1}]}, "scopeLogs": []}]}),
            "failed",
        ),
    }
    result = classified(spark, {name: body for name, (body, _) in cases.items()})
    assert by(result, "payload_id", "log_verdict") == {name: verdict for name, (_, verdict) in cases.items()}
    codes = by(result, "payload_id", "error_code")
    assert {codes[name] for name, (_, verdict) in cases.items() if verdict == "failed"} == {"normalization_failed"}
    assert {codes[name] for name, (_, verdict) in cases.items() if verdict != "failed"} == {None}


def test_attribute_rules(spark):
    attributes = [
        pair("complex", x=1),
        pair("complex", y=2),
        pair("scalar wins", boolValue=True),
        pair("scalar wins", z=1),
        pair("last scalar", stringValue="first"),
        pair("last scalar", intValue="2"),
        pair("order", doubleValue=1.5, intValue="7", stringValue="s"),
        pair("null scalar", intValue=None, doubleValue=2),
        pair("empty"),
        {"key": "no value"},
        {"value": {"stringValue": "no key"}},
    ]
    events = log_events(classified(spark, {"p": log_payload({"attributes": attributes})}), SALT)
    found = json.loads(events.select(F.to_json("provider_extensions")).first()[0])["log_attributes"]
    assert found == {
        "complex": {"x": 1},
        "scalar wins": True,
        "last scalar": "2",
        "order": "s",
        "null scalar": None,
        "": "no key",
    }


def test_defaults_for_missing_or_wrong_typed_names(spark):
    records = [
        {},
        {"attributes": [pair("event.name", intValue=5), pair("model", intValue=3)]},
        {"attributes": [pair("event.name", stringValue="")]},
    ]
    events = log_events(classified(spark, {"p": log_payload(*records)}), SALT).collect()
    assert {(event.event_type, event.source_version, event.model) for event in events} == {
        ("codex.log.received", "unavailable", None)
    }


def test_no_planted_value_reaches_the_safe_events(spark):
    planted = ["raw-arguments", "raw-output", "x@example.test", "conv-1", "account-1", "host-1", "text-of-body", "/home/me/f"]
    names = ["arguments", "output", "user.email", "conversation.id", "user.account_id", "host.name"]
    record = {
        "attributes": [pair(name, stringValue=value) for name, value in zip(names, planted)]
        + [pair("file.path", stringValue="/home/me/f"), pair("model", stringValue="kept-model")],
        "body": {"stringValue": "text-of-body"},
    }
    safe = safe_log_events(classified(spark, {"p": log_payload(record)}), SALT)
    everything = safe.select(F.to_json(F.struct("*"))).first()[0]
    assert "kept-model" in everything
    assert not [value for value in planted if value in everything]


def test_salt_stays_out_of_plans(spark):
    from sessionloom.operators.privacy import sanitise_events

    def plan():
        events = log_events(classified(spark, {"p": log_payload({})}), SALT)
        return sanitise_events(events, SALT)._jdf.queryExecution().toString().lower()

    padded = SALT.ljust(64, b"\0")
    secrets = [SALT] + [bytes(byte ^ fill for byte in padded) for fill in (0x36, 0x5C)]
    shown = plan()
    assert not [secret for secret in secrets if secret.hex() in shown]
    # Without the redaction setting the pads of the native hash would be readable.
    pattern = spark.conf.get("spark.sql.redaction.string.regex")
    spark.conf.set("spark.sql.redaction.string.regex", "matches nothing")
    try:
        assert [secret for secret in secrets if secret.hex() in plan()]
    finally:
        spark.conf.set("spark.sql.redaction.string.regex", pattern)
