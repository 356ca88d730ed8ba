import hashlib
import hmac
import json

import pyarrow as pa
from helpers import SALT, events
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.functions.hashing import hmac_sha256
from sessionloom.functions.json_walk import key_action, sanitiser
from sessionloom.operators.privacy import ENVELOPE_FIELDS, provenance_rows, sanitise_column, sanitise_events


def safe(spark, value, salt=SALT):
    frame = spark.createDataFrame([(json.dumps(value),)], "text string").select(F.parse_json("text").alias("value"))
    sanitised = sanitise_column(frame, "value", salt)
    rows = provenance_rows(sanitised).orderBy("ord").collect()
    return json.loads(sanitised.select(F.to_json("value").alias("value")).first().value), [tuple(row)[1:] for row in rows]


def hashed(text, salt=SALT):
    return "hmac-sha256:" + hmac.new(salt, text.encode(), hashlib.sha256).hexdigest()


def test_names_fold_letter_by_letter(spark):
    assert key_action("user.EMA\u0130L") == "removed" and key_action("api_\u212aEY") == "removed"
    assert key_action("F\u0130LE_PATH") == "hashed" and key_action("COMMAND-L\u0130NE") == "removed"
    value, _ = safe(spark, {"key": "user.EMA\u0130L", "value": {"stringValue": "canary@x"}, "f\u0130le_path": "canary"})
    assert "canary" not in json.dumps(value)


def test_documented_object(spark):
    value, provenance = safe(
        spark,
        {
            "prompt": "p",
            "response": "r",
            "source_code": "c",
            "file_path": "/private/project/main.go",
            "command_arguments": "--token x",
            "arguments": "a",
            "output": "o",
            "provider_extensions": {"api_key": "k", "model": "gpt-test"},
        },
    )
    assert value == {
        "file_path": hashed("/private/project/main.go"),
        "command_arguments": "[REDACTED]",
        "provider_extensions": {"model": "gpt-test"},
    }
    assert provenance == [
        ("arguments", "removed", "sensitive_value"),
        ("command_arguments", "redacted", "command_arguments"),
        ("file_path", "hashed", "file_path"),
        ("output", "removed", "sensitive_value"),
        ("prompt", "removed", "prohibited_content"),
        ("provider_extensions", "retained", "operational_metadata"),
        ("provider_extensions.api_key", "removed", "sensitive_value"),
        ("provider_extensions.model", "retained", "operational_metadata"),
        ("response", "removed", "prohibited_content"),
        ("source_code", "removed", "prohibited_content"),
    ]


def test_attribute_pairs(spark):
    def item(key, value):
        return {"key": key, "value": value}

    value, provenance = safe(
        spark,
        {
            "list": [
                item("user.email", {"stringValue": "x@example.test"}),
                item("file.name", "a.txt"),
                item("Command-Args", ["x"]),
                item("safe", {"prompt": "p", "n": [1, [2]]}),
                item("", {"body": 1}),
                item(5, {"token": 1, "ok": None}),
            ]
        },
    )
    assert value["list"] == [
        {"key": "user.email", "value": {}},
        {"key": "file.name", "value": {"stringValue": hashed("a.txt")}},
        {"key": "Command-Args", "value": {"stringValue": "[REDACTED]"}},
        {"key": "safe", "value": {"n": [1, [2]]}},
        {"key": "", "value": {}},
        {"key": 5, "value": {"ok": None}},
    ]
    assert ("list[0].value.attribute_value", "removed", "sensitive_value") in provenance
    assert ("list[1].value", "hashed", "file_path") in provenance
    assert ("list[3].value.prompt", "removed", "prohibited_content") in provenance
    assert ("list[4].value.body", "removed", "sensitive_value") in provenance


def test_key_classification():
    expected = {
        "removed": ["Prompt", "user.e-mail", "X_Account Id", "conversation.id", "host.name", "API-Key", "command line"],
        "redacted": ["command.arguments", "CommandArgs"],
        "hashed": ["file.path", "File Names"],
        "retained": ["tokens", "input_token_count", "emails", "promptly", "value", "model"],
    }
    for action, names in expected.items():
        assert {name: key_action(name) for name in names} == {name: action for name in names}
    assert {key_action(name) for name in ENVELOPE_FIELDS} == {"retained"}


def test_hash_depends_on_salt_only(spark):
    value = {"file_path": "/p"}
    assert safe(spark, value) == safe(spark, value)
    assert safe(spark, value)[0] != safe(spark, value, bytes(32))[0]


def test_native_hash_equals_reference_algorithm(spark):
    texts = ["", "a", "é漢字", "x" * 1000]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    rows = frame.select("text", hmac_sha256(F.col("text"), SALT).alias("digest")).collect()
    assert all("hmac-sha256:" + row.digest == hashed(row.text) for row in rows)


def test_depth_is_unlimited(spark):
    text = '{"a":[' * 450 + '{"prompt":"deep secret","kept":1}' + "]}" * 450
    frame = spark.createDataFrame([(text,)], "text string").select(F.parse_json("text").alias("value"))
    row = sanitise_column(frame, "value", SALT).select(F.to_json("value").alias("value"), F.size("provenance").alias("n")).first()
    assert "deep secret" not in row.value and '"kept":1' in row.value and row.n == 452


def test_entries_of_deep_objects_do_not_repeat_their_path(spark):
    """The stored entries grow with the object; the paths read from them are whole."""
    depth = 300
    text = '{"key_of_ten":[' * depth + '{"prompt":1}' + "]}" * depth
    frame = spark.createDataFrame([(text,)], "text string").select(F.parse_json("text").alias("value"))
    sanitised = sanitise_column(frame, "value", SALT)
    entries = sanitised.first().provenance
    assert sum(len(entry.step) for entry in entries) < 20 * depth
    paths = [row.path for row in provenance_rows(sanitised).orderBy("ord").collect()]
    assert paths == [".".join(["key_of_ten"] + ["[0].key_of_ten"] * at).replace(".[", "[") for at in range(depth)] + [
        "key_of_ten[0]." * depth + "prompt"
    ]


def plain_paths(value, path=""):
    """Paths of all retained and removed members, one object at a time."""
    if isinstance(value, list):
        return [found for at, item in enumerate(value) for found in plain_paths(item, f"{path}[{at}]")]
    if not isinstance(value, dict):
        return []
    out = []
    for key in sorted(value):
        here = f"{path}.{key}" if path else key
        out.append(here)
        out += [] if key_action(key) == "removed" else plain_paths(value[key], here)
    return out


def test_odd_names_and_lists(spark):
    for value in (
        {"": {"": {"a": [{"b": 1}]}, "x": 2}, "[0]": {"c": 1}, "d.e": [[{"f": {"g": []}}], {}, [{}]]},
        {"a": [[1, [{"b": [{"c": {}}]}]]], "prompt": {"z": 1}},
        {"": [{"a": {"": 1}}]},
    ):
        assert [entry[0] for entry in safe(spark, value)[1]] == plain_paths(value)


def test_whole_event_is_sanitised_with_envelope_provenance(spark):
    raw = events(spark, [("e", "s", "session.created", "2026-01-02T09:00:00", "m", {"prompt": "secret-like", "x": 1})])
    safe_events = sanitise_events(raw, SALT)
    assert "secret-like" not in safe_events.select(F.to_json(F.struct("*"))).first()[0]
    paths = [row.path for row in provenance_rows(safe_events, "event_id").orderBy("ord").collect()]
    opened = ["attributes.model", "provider_extensions.prompt", "provider_extensions.x"]
    assert paths == sorted([*ENVELOPE_FIELDS, *opened])


_json = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=4)
    | st.dictionaries(st.sampled_from(["key", "value", "prompt", "file.path", "user.email", "a", "b", ""]), inner, max_size=5),
    max_leaves=20,
)


@settings(max_examples=150, deadline=None)
@given(_json)
def test_any_json_is_serialisable_and_keeps_no_sensitive_key(value):
    run = sanitiser(SALT).func
    result = run(pa.array([json.dumps({"root": value})]), pa.array([""])).to_pylist()[0]
    walked = json.loads(result["value"])

    def check(node):
        if isinstance(node, dict):
            assert not {"prompt", "user.email"} & node.keys()
            if "file.path" in node:
                assert node["file.path"].startswith("hmac-sha256:")
            for item in node.values():
                check(item)
        elif isinstance(node, list):
            for item in node:
                check(item)

    check(walked)
    assert {entry["action"] for entry in result["provenance"]} <= {"retained", "removed", "hashed", "redacted"}
