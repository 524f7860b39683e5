"""Small facts of calls, and joins of extracted rows with their dimensions, on typed cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import facts


def test_soap_clients(spark):
    calls = spark.createDataFrame([(1, "a", "TrackAsync"), (2, "a", "Svc.Port.Cancel"), (3, "a", "setSecurity"), (4, "a", "x.Track"), (5, "b", "Async"), (6, "b", "Track"), (7, "none", "Track"), (8, "a", "Svc.Port.describe"), (9, "a", "1bad")], "call int, client string, chain string")
    clients = spark.createDataFrame([("a", "a.wsdl", None), ("b", "gone.wsdl", "https://own.io")], "client string, path string, endpoint string")
    services = spark.createDataFrame([("a.wsdl", "Track", "https://x.io"), ("a.wsdl", "Cancel", "https://x.io")], "path string, operation string, address string")
    got = sorted(tuple(r) for r in facts.soap_client_calls(calls, clients, services).collect())
    assert got == [(1, "Track", True, "https://x.io"), (2, "Cancel", True, "https://x.io"), (5, "Async", False, "https://own.io"), (6, "Track", False, "https://own.io"), (8, "describe", False, "https://x.io")]


def test_models_of_a_toolkit(spark):
    calls = spark.createDataFrame([(1, False), (2, False), (3, True), (4, True), (5, False)], "call int, agent boolean")
    models = spark.createDataFrame([(1, 0, "@x/a", "chat", "m1"), (1, 1, "@x/b", "chat", "m2"), (2, 0, None, None, "openai/gpt"), (3, 0, None, None, "openai/gpt"), (4, 0, "@x/none", "chat", "m")], "call int, ord int, package string, member string, model string")
    entries = spark.createDataFrame([("@x/a", "chat", "a", "a.io", "/chat"), ("@x/a", "", "a", "a.io", "/v1"), ("@x/b", "", "b", "b.io", "/v1"), ("", "", "gateway", "g.io", "/ai")], "package string, member string, provider string, host string, path string")
    got = sorted((r.call, r.ord, r.provider, r.host, r.path, r.model) for r in facts.model_calls(calls, models, entries).collect())
    assert got == [(1, 0, "a", "a.io", "/chat", "m1"), (1, 1, "b", "b.io", "/v1", "m2"), (2, 0, "gateway", "g.io", "/ai", "openai/gpt"), (3, 0, "llm-router", None, "/ai", "openai/gpt"), (4, 0, "unknown", None, "/", "m"), (5, 0, "unknown", None, "/", None)]


def test_components(spark):
    elements = spark.createDataFrame([(1, "@ui", "Map", {"id": "7", "x": "y"}), (2, "@ui", "Other", {}), (3, "@other", "Map", {})], "element int, package string, name string, props map<string,string>")
    components = spark.createDataFrame([("@ui", "Map", "maps", "GET", "/t/{id}/{z}")], "package string, name string, provider string, method string, path string")
    assert [tuple(r) for r in facts.component_calls(elements, components).collect()] == [(1, "maps", "GET", "/t/7/{z}")]


def test_injection_and_tables(spark):
    points = spark.createDataFrame([(1, "A", None), (2, "A", "q"), (3, "B", None), (4, "C", None), (5, "A", "none")], "id int, type string, qualifier string")
    provided = spark.createDataFrame([("A", "q", "1"), ("A", "r", "2"), ("B", None, "3")], "type string, qualifier string, value string")
    assert sorted(tuple(r) for r in facts.injected(points, provided).collect()) == [(2, "1"), (3, "3")]
    texts = spark.createDataFrame([("<?xml version='1.0'?> <ns:Order/>",), ("<html>",), ("plain",), (None,), ("<SVG/>",)], "body string")
    assert [r[0] for r in texts.select(facts.xml_root(F.col("body"))).collect()] == ["ns:Order", None, None, None, None]
