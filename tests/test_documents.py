"""Rules of event documents one by one, and projection with bounds."""

import json

import pytest

from quietwire.operators import documents as D

GOOD = {"id": "e-1", "timestamp": 5, "source_mode": "LIVE", "src_port": 0, "dst_port": 65535, "protocol": 6, "evidence": {"items": []}, "dns_evidence": [],
        "tls_observation": {"directions": [{}, {}]}, "metadata": {"explanation": {"attack_mappings": [{"technique_id": "T1"}]}}, "threat_type": "c2", "threat_class": "c2",
        "event_id": "e-1", "anomaly_score": 0.5, "created_at": None, "flow_id": "f", "quic_observation": None}


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"id": "-x"}, "identity"), ({"id": 7}, "identity"), ({"id": None}, "identity"), ({"timestamp": None}, "time"), ({"timestamp": "5"}, "time"),
    ({"timestamp": True}, "time"), ({"source_mode": "TAPE"}, "source"), ({"source_mode": None}, None), ({"evidence": []}, "observation"), ({"quic_observation": 3}, "observation"),
    ({"tls_evidence": {}}, "evidence"), ({"dns_evidence": [{"a": 1}, 2]}, "evidence"), ({"dns_evidence": [{"a": 1}, {"b": "x"}]}, None), ({"anomaly_score": "high"}, "number"),
    ({"flow_id": 3}, "text"), ({"evidence": {"items": {}}}, "model evidence"), ({"tls_observation": {"directions": [1, 2, 3]}}, "directions"),
    ({"dns_observation": {"directions": []}}, "directions"), ({"metadata": [1]}, "metadata"), ({"metadata": {"explanation": 1}}, "metadata"),
    ({"metadata": {"explanation": {"attack_mappings": {}}}}, "techniques"), ({"event_id": "e-2"}, "conflicting identity"), ({"threat_class": "ddos"}, "conflicting class"),
    ({"src_port": -1}, "endpoint"), ({"protocol": 256}, "endpoint"), ({"dst_port": 1.5}, "endpoint"), ({"dst_port": "80"}, "endpoint")])
def test_each_rule(document_reasons, change, reason):
    assert document_reasons[json.dumps(GOOD | change)] == reason


@pytest.fixture(scope="module")
def document_reasons(spark):
    """The reason for every document of the cases above, from one pass."""
    cases = [mark.args[1] for mark in test_each_rule.pytestmark if mark.name == "parametrize"][0]
    rows = [(json.dumps(GOOD | change),) for change, _ in cases]
    return {r.document: r.reject_reason for r in D.document_validity(spark.createDataFrame(rows, "document string")).collect()}


def test_texts_that_are_no_documents(spark):
    rows = spark.createDataFrame([(None,), ("",), ("{",), ("[]",), ("3",), ('{"id":"a","id":"b"}',)], "document string")
    assert {r.reject_reason for r in D.document_validity(rows).collect()} == {"document"}


def test_projection_keeps_allowed_leaves_within_bounds(spark):
    docs = {1: {"a": {"b": [1, {"a": "x", "secret": 2}]}, "c": 1, "secret": {"a": 3}}, 2: {"a": {"a": {"a": {"a": {"a": 1}}}}}, 3: {"a": "x" * 21}, 4: {"b": [0] * 5}, 5: {}, 6: {"b": None}}
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [(7, None)], "id int, document string")
    got = {}
    for r in D.projected_leaves(frame, "id", ["a", "b"], D.Bounds(depth=4, members=3, items=4, characters=20)).collect():
        got.setdefault(r.id, set()).add((r.path, r.kind, r.value))
    assert got == {1: {("a.b[0]", "BIGINT", "1"), ("a.b[1].a", "STRING", "x")}, 2: {("", "REFUSED", "depth")}, 3: {("", "REFUSED", "text")}, 4: {("", "REFUSED", "size")},
                   6: {("b", "VOID", None)}}
