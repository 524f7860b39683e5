from __future__ import annotations

import datetime
import json
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callscope.functions import hosts, text, urls
from callscope.operators.components import components
from callscope.operators import callrows, examples, frontend, host_rules, javascript, joins, providers, python, requests
from callscope.sources import documents
from callscope.streaming import windows

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(st.lists(st.text(alphabet="/ab{}:env.", max_size=12), min_size=20, max_size=40))
def test_canonical_path_is_idempotent(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string").withColumn("c", urls.canonical_path(F.col("p")))
    rows = df.withColumn("cc", urls.canonical_path(F.col("c"))).collect()
    assert all(r.c == r.cc and r.c.startswith("/") for r in rows)


@SLOW
@given(st.lists(st.text(alphabet="ab.{}:0-@ /", max_size=14), min_size=20, max_size=40))
def test_provider_is_never_null_or_a_template(spark, names):
    rows = [(i, None, "literal", h, None) for i, h in enumerate(names)]
    calls = spark.createDataFrame(rows, "id long, sdk_provider string, host_kind string, host string, env_name string")
    none = spark.createDataFrame([], "name string, provider string")
    for r in providers.resolve(calls, providers.provider_hosts(spark), none).collect():
        assert r.provider and "{" not in r.provider


def test_redaction_leaves_nothing_secret(spark):
    df = spark.createDataFrame([("sk_live_51ABCDEFghijklmnop",), ("x " + "0" * 40,), ("ok",)], "s string")
    out = df.select(text.redact(F.col("s")).alias("r")).withColumn("again", text.looks_secret(F.col("r"))).collect()
    assert not any(r.again for r in out)
    assert [r.r for r in out] == ["<redacted>", "<redacted>", "ok"]


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i, f"f:{i % 3}:1", f"id{i % 3}", "null", None, f"s{i % 4}") for i in range(60)]
    calls = spark.createDataFrame(rows, "seq long, place string, id string, op string, name string, sent string")
    expected = sorted(map(tuple, requests.one_per_request(calls).collect()), key=repr)
    for n in (1, 7, 16):
        assert sorted(map(tuple, requests.one_per_request(calls.repartition(n)).collect()), key=repr) == expected


def test_numbering_is_idempotent(spark):
    rows = [(1, "a:1:1", "x", "null", None, "s"), (2, "a:1:1", "x", "null", None, "s"), (3, "a:1:1", "x", "null", None, "t")]
    once = requests.one_per_request(spark.createDataFrame(rows, "seq long, place string, id string, op string, name string, sent string"))
    assert [r.n for r in once.orderBy("seq").collect()] == [0, 1]
    assert requests.one_per_request(once.drop("n")).count() == 2


def test_front_ends_take_any_text():
    for reader in (frontend.python_calls, frontend.shell_calls, frontend.graphql_operations, frontend.notebook_source):
        for body in ("", "{", "(" * 50, "\x00", "é" * 100, '"', "curl", "curl -X", "fragment"):
            assert isinstance(reader("p", body), list)


def test_graphql_bounds():
    many = " ".join(f"query Q{i} {{ a }}" for i in range(51))
    assert frontend.graphql_operations("p", many) == [(None, None, None, "graphql-limit")]
    assert frontend.graphql_operations("p", "{ a }" + "#" * 100_000)[0][3] == "graphql-limit"
    assert frontend.graphql_operations("p", "query A { ...F } fragment F on T { ...F a }") == [("query", "A", "a", None)]


def test_suffix_join_equals_the_loop(spark):
    dimension = [("a.com", True, "s1"), ("b.a.com", True, "s2"), ("b.a.com", False, "e")]
    names = ["a.com", "b.a.com", "c.b.a.com", "x.a.com", "xa.com", "{t}.b.a.com", "{t}a.com", ""]
    df = providers.join_providers(spark.createDataFrame([(n,) for n in names], "host string"), spark.createDataFrame(dimension, "listed string, is_suffix boolean, provider string"))
    assert {r.host: r.provider for r in df.collect()} == {"a.com": None, "b.a.com": "e", "c.b.a.com": "s2", "x.a.com": "s1", "xa.com": None, "{t}.b.a.com": "s2", "{t}a.com": None, "": None}


def test_scans_are_pruned_and_pushed(spark):
    """Columns and filters reach the scans: label precision never reads texts, file groups read filtered keys only."""
    from callscope.plans.registry import QUERIES

    physical = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    plan = physical("agg14_label_precision")
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan and "text:string" not in plan
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_totalprice > 1000").select("o_orderkey", F.col("o_custkey").alias("host"), F.lit("/").alias("path"))
    judged = host_rules.judge(orders.withColumn("host", F.col("host").cast("string")), host_rules.rules(spark))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "GreaterThan(o_totalprice,1000.0)" in judged and "o_orderpriority" not in judged


def test_host_rules_are_data(spark):
    """The order of rows does not matter, and a row added decides."""
    sites = spark.createDataFrame([("api.acme.com", "/x"), ("docs.acme.com", "/v1"), ("acme.com", "/"), ("api.acme.internal", ""), (None, "/x"), ("api.acme.com", None)], "host string, path string")
    rules = host_rules.rules(spark)
    key = lambda r: (r.host or "", r.path or "")
    first = sorted(host_rules.judge(sites, rules).collect(), key=key)
    assert [r.api for r in first] == [None, False, True, True, False, False]
    assert sorted(host_rules.judge(sites, rules.orderBy(F.rand(3)).repartition(5)).collect(), key=key) == first
    more = spark.createDataFrame([("api", "under", "acme.com", 5, False, False), ("api", "host", "acme.com", 1, True, False)], rules.schema)
    assert [r.api for r in sorted(host_rules.judge(sites, rules.union(more)).collect(), key=key)] == [None, True, False, False, False, False]


def test_listed_diagnostics_stop_at_the_bound(spark):
    few = spark.createDataFrame([(f"f{i}", "excluded") for i in range(200)] + [("p", "parse-error")], "file string, reason string")
    none = spark.createDataFrame([], "file string")
    counts, listed = callrows.diagnostics(few, none)
    assert listed.count() == 201 and {r.reason: (r.n, r.complete) for r in counts.collect()} == {"excluded": (200, False), "parse-error": (1, False)}
    more = few.union(spark.createDataFrame([("x", "not-included")], few.schema))
    assert [r.file for r in callrows.diagnostics(more, none)[1].collect()] == ["p"]
    asked = few.filter("reason = 'excluded'")
    assert callrows.diagnostics(asked, none)[0].first().complete and not callrows.diagnostics(asked, spark.createDataFrame([("c",)], "file string"))[0].first().complete


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a"), (2, "x", None)], "n int, a string, b string")
    callrows.write_json(rows, str(tmp_path / "j"))
    assert sorted((tmp_path / "j").glob("*.json")) and sorted(x for f in (tmp_path / "j").glob("*.json") for x in f.read_text().split()) == ['{"n":1,"b":"a"}', '{"n":2,"a":"x"}']
    callrows.write_lines(rows.select(F.col("n").cast("string").alias("text")), str(tmp_path / "t"))
    assert sorted(x for f in (tmp_path / "t").glob("*.txt") for x in f.read_text().split()) == ["1", "2"]


def test_file_groups_follow_long_chains(spark):
    """Further than any fixed number of rounds would reach."""
    edges = [(f"n{i:04}", f"n{i + 1:04}") for i in range(300)] + [("x", "x")]
    got = {r.file: r.group for r in joins.file_groups(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {**{f"n{i:04}": "n0000" for i in range(301)}, "x": "x"}


def test_as_of_against_loops(spark):
    rng = random.Random(2)
    uses = [(i, rng.randrange(3), rng.randrange(40)) for i in range(60)]
    assigns = [(rng.randrange(3), at, at * 10) for at in rng.sample(range(40), 25)]
    got = {r.use_id: r.assigned_at for r in joins.as_of(spark.createDataFrame(uses, "use_id int, fn int, at int"), spark.createDataFrame(assigns, "fn int, at int, value int"), ["fn"]).collect()}
    for use, fn, at in uses:
        own = sorted(a for f, a, _ in assigns if f == fn)
        before = [a for a in own if a < at]
        assert got[use] == (before[-1] if before else own[0] if own else None)


def test_match_inventory_against_loops(spark):
    rng = random.Random(4)
    entries = [(i, "r", f"f{rng.randrange(3)}", rng.randrange(1, 30)) for i in range(25)]
    calls = [(100 + i, "r", f"f{rng.randrange(3)}", rng.randrange(1, 30), rng.random() < 0.3) for i in range(25)]
    pairs = sorted((abs(el - cl), via, e, c) for e, _, ef, el in entries for c, _, cf, cl, via in calls if ef == cf and abs(el - cl) <= 3)
    expected, used = {}, set()
    for d, _, e, c in pairs:
        if e not in expected and c not in used:
            expected[e] = (c, d)
            used.add(c)
    got = joins.match_inventory(spark.createDataFrame(entries, "entry long, repo string, file string, line int"), spark.createDataFrame(calls, "call long, repo string, file string, line int, via boolean")).collect()
    assert {r.entry: (r.call, r.distance) for r in got if r.call is not None} == expected and len(got) == 25


def test_streams_equal_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.hourly(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("hourly").collect())) == sorted(map(key, windows.hourly(events).collect()))


def test_first_seen_hosts(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("r", "a", at), ("r", "a", at), ("r", "b", at), ("q", "a", at)], "repo string, host string, ts timestamp_ntz")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windows.first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.repo, r.host) for r in spark.table("seen").collect()) == [("q", "a"), ("r", "a"), ("r", "b")]


def test_hosts_are_forgotten(spark, tmp_path):
    """A pair leaves the state when event time has gone on for long, and is new when it comes again."""
    ddl = "repo string, host string, ts timestamp_ntz"
    out: list = []

    def run(day, *hosts):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
        spark.createDataFrame([("r", h, at) for h in hosts], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.first_seen(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")))
        query = stream.writeStream.foreachBatch(lambda df, _: out.append(sorted(r.host for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run(0, "a", "b", "a")
    run(20, "b", "c")
    run(100, "d")
    run(101, "a", "d")
    assert [x for x in out if x] == [["a", "b"], ["c"], ["d"], ["a"]]


def test_urls_in_text_skip_links(spark):
    df = spark.createDataFrame([("[x](https://a.io/1) <https://b.io> https://c.io/2\nhttp://d.io:80/",)], "t string")
    found = df.select(F.explode(hosts.urls_in(F.col("t"))).alias("u")).select("u.*").collect()
    assert [(r.host, r.path, r.line) for r in found] == [("c.io", "/2", 0), ("d.io", "/", 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_front_ends_of_files_take_any_text():
    for reader in (javascript.javascript_rows, python.python_rows, documents.values_of, documents.spring_rows, documents.manifest_rows):
        for path in ("a.yaml", "b.toml", "c.json", "Cargo.toml", "pom.xml", "x.properties"):
            for body in ("", "{", "(" * 50, "\x00", "é" * 100, '"', "`${", "fetch(", "fetch(`${a", "import {", "a: [", "- - -", "a:\n\t- b", "class A {", "/", "x = /[/", "<", "enum E {", "const {a: b} = ", "def f(", "a: |", "? x"):
                assert isinstance(reader(path, body), list)


@SLOW
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-9, 99), st.text(alphabet="ab:# -'\"{}[],&*", max_size=6)), lambda x: st.one_of(st.lists(x, min_size=1, max_size=3), st.dictionaries(st.sampled_from(["a", "b-c", "d"]), x, min_size=1, max_size=3)), max_leaves=8))
def test_yaml_round_trip(value):
    """Values written as YAML are read back; strings are quoted where they have to be."""

    def lines(v, pad):
        if isinstance(v, dict):
            return [x for k, w in v.items() for x in ([f"{pad}{k}: {json.dumps(w)}"] if not isinstance(w, dict | list) else [f"{pad}{k}:", *lines(w, pad + "  ")])]
        return [x for w in v for x in ([f"{pad}- {json.dumps(w)}"] if not isinstance(w, dict | list) else [f"{pad}-", *lines(w, pad + "  ")])]

    whole = {"top": value}
    expected = [(k, *documents.scalar(v)) for k, v in documents.flat(whole)]
    assert [(k, v, kind) for k, v, kind, _ in documents.yaml_documents("\n".join(lines(whole, "")))[0]] == expected


def test_example_values_by_name(spark):
    """Drawn values have the form that the rule says, the same in every run and layout."""
    forms = {
        "email": r"[a-z]+\.[a-z]+@example\.com", "userId": r"[a-z0-9]{8}", "created_at": r"202[456]-\d\d-\d\dT\d\d:\d\d:\d\dZ", "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}",
        "color": r"#[0-9a-f]{6}", "title": r"[A-Z][a-z]+ [A-Z][a-z]+", "slug": r"[a-z]+-[a-z]+", "sort": "asc|desc", "coupon": "[A-Z0-9]{6}", "iban": r"DE89\d{18}", "phone": r"\+1415555\d{4}", "note": r"[A-Z][a-z]+( [a-z]+){5}\.",
    }
    keys = spark.createDataFrame([(s, k, "string") for k in forms for s in ("a", "b", "")] + [(str(i), "limit", "number") for i in range(50)] + [("s", "apiKey", "string"), ("s", "x", "boolean"), ("s", "title", "number")], "seed string, key string, kind string")
    got = {(r.seed, r.key, r.kind): r.value for r in examples.named_values(keys).collect()}
    for key, form in forms.items():
        assert all(re.fullmatch(form, got[s, key, "string"]) for s in ("a", "b", ""))
    assert len({got[s, "userId", "string"] for s in ("a", "b", "")}) == 3
    limits = [int(got[str(i), "limit", "number"]) for i in range(50)]
    assert all(10 <= x <= 100 for x in limits) and len(set(limits)) > 10
    assert got["s", "apiKey", "string"] == "<apiKey>" and got["s", "x", "boolean"] is None and got["s", "title", "number"] is None
    assert {(r.seed, r.key, r.kind): r.value for r in examples.named_values(keys.repartition(7)).collect()} == got


def test_example_bodies(spark):
    fields = spark.createDataFrame([("c", "email", "string", True), ("c", "n", "integer", True), ("c", "it's \"q\"", "string", False), ("c", "on", "boolean", False), ("d", "x", "string", False)], "call string, path string, kind string, required boolean")
    got = {r.call: (json.loads(r.minimal), json.loads(r.full)) for r in examples.bodies(fields).collect()}
    minimal, full = got["c"]
    assert set(minimal) == {"email", "n"} and set(full) == {"email", "n", 'it\'s "q"', "on"} and full["on"] is True and 1 <= full["n"] <= 100 and minimal["email"] == full["email"]
    assert got["d"][0] == {} and set(got["d"][1]) == {"x"}


def test_arriving_files_run_the_batch_plan(spark, tmp_path):
    """Files that arrive are read whole and go through the same front end as a table of files."""
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.js").write_text('fetch("https://a.io/1");\nfetch("https://a.io/2");\n')
    found: list = []

    def batch(files, _):
        found.extend((r.path.rsplit("/", 1)[-1], r.line, r.url) for r in javascript.javascript_calls(files).collect())

    stream = windows.arriving_files(spark, str(tmp_path / "in"))
    for name in (None, "b.js"):
        if name:
            (tmp_path / "in" / "sub" / name).write_text('axios;\nfetch("https://b.io");\n')
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(found) == [("a.js", 1, "https://a.io/1"), ("a.js", 2, "https://a.io/2"), ("b.js", 2, "https://b.io")]


def test_late_events_are_dropped(spark, tmp_path):
    """What comes more than the delay behind the watermark does not count."""
    rows = lambda *ts: spark.createDataFrame([(datetime.datetime(2024, 1, 1, h, m), "t", 1.0) for h, m in ts], "ts timestamp_ntz, event_type string, value double")
    rows((10, 0), (10, 30)).write.parquet(str(tmp_path / "in"))
    schema = rows((1, 0)).schema
    out: dict = {}

    def keep(df, _):
        out.update({(r.start.hour, r.event_type): r.n for r in df.collect()})

    def run():
        stream = windows.hourly(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 hour")
        query = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run()
    rows((20, 0)).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    rows((10, 45), (23, 0)).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert out[10, "t"] == 2 and (20, "t") in out
