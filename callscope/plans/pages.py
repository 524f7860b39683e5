"""Queries over URLs and HTML of pages, and over URL templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import hosts, text, urls
from callscope.operators import host_rules, providers
from callscope.plans.fixture import Fixture, golden
from callscope.plans.registry import query

#: Services of the driver's synthetic hosts.
SERVICES = Fixture("services", "listed string, is_suffix boolean, provider string", [("example.com", True, "ex-com"), ("example.net", True, "ex-net"), ("example.org", True, "ex-org")])

TEMPLATES = Fixture(
    "templates",
    "tpl_id bigint, template string, via_const boolean",
    [
        (1, "https://{hostname}:443/status", False),
        (2, "http://127.0.0.1:{env:PORT}/health", False),
        (3, "http://localhost:{port}/api/items", False),
        (4, "https://{env:REPLIT_CONNECTORS_HOSTNAME}/api/v2/connection", False),
        (5, "https://calendar.zoho.{region}/api/v1/events", False),
        (6, "{env:NEXT_PUBLIC_BASE_PATH}/api/projects", False),
        (7, "{env:API_URL}v1/users?limit=5&{k}=1#top", False),
        (8, "{base}/v1//items/", True),
        (9, "/relative/path?x=1&__proto__=2", False),
        (10, " HTTPS://User:pw@API.Example.io/V1/?a=b=c", True),
        (11, "https://api.acme.com{path}", False),
        (12, "wss://stream.acme.com", True),
        (13, "https://{x}.zendesk.com/api/v2/tickets/{id}.json", False),
    ],
)


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.with_shape(page_urls(spark, sf_dir), F.col("url"), F.lit(False)).select("page_id", "u.*")


_PARTS = """
parts AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme,
    lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS raw_path,
    regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS qs FROM pages),
shape AS (SELECT *, CASE WHEN raw_path IN ('', '/') THEN '/' WHEN ends_with(raw_path, '/') THEN left(raw_path, length(raw_path) - 1) ELSE raw_path END AS path FROM parts)
"""


@query(
    "slice_url_services",
    f"WITH {SERVICES.sql}, {_PARTS}, best AS (SELECT page_id, arg_max(provider, length(listed)) AS provider FROM shape JOIN services ON ends_with(host, '.' || listed) GROUP BY page_id) "
    "SELECT coalesce(provider, host) AS provider, scheme, count(*) AS n, count(DISTINCT path) AS paths FROM shape LEFT JOIN best USING (page_id) GROUP BY 1, 2",
)
def slice_url_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which service do the page URLs belong to, by scheme?"""
    found = providers.join_providers(shaped(spark, sf_dir), SERVICES.df(spark))
    return found.groupBy(F.coalesce("provider", "host").alias("provider"), "scheme").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))


@query("res11_url_shape_pages", f"WITH {_PARTS} SELECT page_id, 'literal' AS host_kind, scheme, host, path, array_to_string(list_filter(list_transform(string_split(qs, '&'), lambda p: split_part(p, '=', 1)), lambda k: k <> ''), ',') AS query FROM shape")
def res11_url_shape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir).select("page_id", "host_kind", "scheme", "host", "path", F.array_join("query", ",").alias("query"))


@query(
    "res11_url_shape_templates",
    golden(
        "tpl_id, host_kind, host, env_name, scheme, path, query",
        [
            (1, "unknown", "{hostname}:443", None, "https", "/status", ""),
            (2, "env", "127.0.0.1:{env:PORT}", "PORT", "http", "/health", ""),
            (3, "literal", "localhost:{port}", None, "http", "/api/items", ""),
            (4, "env", "{env:REPLIT_CONNECTORS_HOSTNAME}", "REPLIT_CONNECTORS_HOSTNAME", "https", "/api/v2/connection", ""),
            (5, "unknown", "calendar.zoho.{region}", None, "https", "/api/v1/events", ""),
            (6, "relative", None, None, None, "/api/projects", ""),
            (7, "env", None, "API_URL", None, "/v1/users", "limit"),
            (8, "unknown", None, None, None, "/v1/items", ""),
            (9, "relative", None, None, None, "/relative/path", "x"),
            (10, "const", "api.example.io", None, "https", "/V1", "a"),
            (11, "literal", "api.acme.com", None, "https", "/{path}", ""),
            (12, "const", "stream.acme.com", None, "wss", "/", ""),
            (13, "unknown", "{x}.zendesk.com", None, "https", "/api/v2/tickets/{id}.json", ""),
        ],
    ),
)
def res11_url_shape_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = urls.with_shape(TEMPLATES.df(spark), F.col("template"), F.col("via_const")).select("tpl_id", "u.*")
    return shape.withColumn("query", F.array_join("query", ","))


PATHS = Fixture("paths", "p string", [("a//b/",), ("/",), ("",), ("/v1/{env:TENANT}/x",), ("//",), ("/a/b",), ("x/{id}///y/",)])


@query(
    "res12_canonical_path",
    f"WITH {PATHS.sql}, a AS (SELECT p, regexp_replace(regexp_replace(p, '\\{{env:([^}}]+)\\}}', '{{\\1}}', 'g'), '/+', '/', 'g') AS q FROM paths), b AS (SELECT p, CASE WHEN starts_with(q, '/') THEN q ELSE '/' || q END AS q FROM a) "
    "SELECT p, CASE WHEN length(q) > 1 AND ends_with(q, '/') THEN left(q, length(q) - 1) ELSE q END AS path FROM b",
)
def res12_canonical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PATHS.df(spark).select("p", urls.canonical_path(F.col("p")).alias("path"))


@query(
    "res13_id_segments",
    f"WITH {_PARTS}, s AS (SELECT page_id, unnest(string_split(substr(path, 2), '/')) AS seg FROM shape) SELECT page_id, count(*)::BIGINT AS n_segments, "
    "count(*) FILTER (regexp_matches(seg, '(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\\d{3,}|[a-z]{1,6}_[A-Za-z0-9]{8,}|[0-9a-f]{16,})$'))::BIGINT AS n_ids FROM s GROUP BY page_id",
)
def res13_id_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = urls.segments(F.col("path"))
    return shaped(spark, sf_dir).select("page_id", F.size(segs).cast("long").alias("n_segments"), F.size(F.filter(segs, urls.looks_like_id)).cast("long").alias("n_ids"))


DOTS = Fixture("dots", "base string, p string", [("https://a.io", "v1/x"), ("https://a.io/", "/v1"), ("", "v1"), ("https://a.io", "https://b.io/z"), ("https://a.io/v1", "?q=1"), ("/x", "")])


@query("res10_join_url", f"WITH {DOTS.sql} SELECT base, p, CASE WHEN regexp_matches(p, '^[a-z]+://') OR base = '' THEN p WHEN right(base, 1) <> '/' AND left(p, 1) NOT IN ('/', '?', '') THEN base || '/' || p ELSE base || p END AS url FROM dots")
def res10_join_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DOTS.df(spark).select("base", "p", urls.join_url(F.col("base"), F.col("p")).alias("url"))


SEGMENTS = Fixture("segs", "p string", [("/a/b/../c",), ("/a/./b/.",), ("/../a",), ("/a/b/..",), ("/a",), ("/a/b/c/../../d",)])


@query("res10_dot_segments", golden("p, path", [("/a/b/../c", "/a/c"), ("/a/./b/.", "/a/b/"), ("/../a", "/a"), ("/a/b/..", "/a/"), ("/a", "/a"), ("/a/b/c/../../d", "/a/d")]))
def res10_dot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEGMENTS.df(spark).select("p", urls.dot_segments(F.col("p")).alias("path"))


@query("res13_placeholders", f"WITH {TEMPLATES.sql} SELECT tpl_id, array_to_string(regexp_extract_all(template, '\\{{([^}}]+)\\}}', 1), ',') AS names FROM templates")
def res13_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TEMPLATES.df(spark).select("tpl_id", F.array_join(urls.placeholders(F.col("template")), ",").alias("names"))


@query(
    "join03_longest_suffix",
    f"WITH {_PARTS}, dim(listed, provider) AS (SELECT DISTINCT host, 'h:' || host FROM shape WHERE length(host) % 3 = 0 UNION SELECT DISTINCT regexp_extract(host, '^[^.]+\\.(.*)$', 1), 's:' || regexp_extract(host, '^[^.]+\\.(.*)$', 1) FROM shape), "
    "m AS (SELECT host, arg_max(provider, length(listed)) AS provider FROM (SELECT DISTINCT host FROM shape) JOIN dim ON host = listed AND starts_with(provider, 'h:') OR starts_with(provider, 's:') AND ends_with(host, '.' || listed) GROUP BY host) "
    "SELECT host, provider, count(*) AS n FROM shape LEFT JOIN m USING (host) GROUP BY 1, 2",
)
def join03_longest_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts against a dimension made of a third of the hosts themselves and of every parent domain."""
    pages = shaped(spark, sf_dir).select("host")
    exact = pages.filter(F.length("host") % 3 == 0).distinct().select(F.col("host").alias("listed"), F.lit(False).alias("is_suffix"), F.concat(F.lit("h:"), "host").alias("provider"))
    parent = F.regexp_extract("host", r"^[^.]+\.(.*)\z", 1)
    above = pages.select(parent.alias("listed")).distinct().select("listed", F.lit(True).alias("is_suffix"), F.concat(F.lit("s:"), "listed").alias("provider"))
    return providers.join_providers(pages, exact.union(above)).groupBy("host", "provider").agg(F.count("*").alias("n"))


HOSTS = Fixture(
    "hosts",
    "host string",
    [(h,) for h in ["api.example.com", "billing:8080", "my_service:3000", "API-1.Example.io", "localhost", "localhost:11434", "127.0.0.1:8188", "[::1]:80", "x.local", "maps.googleapis.com", "sheets.googleapis.com", "my-worker.acme.workers.dev", "{x}.zendesk.com", "{a}.my.salesforce.com:443", "a b", "x/y", "a@b.com", "constructor", "api.acme.co.uk", "acme.com", "acme.co.uk", "localhost.evil.com", "0.0.0.0"]],
)


@query(
    "fn03_localhost",
    f"WITH {HOSTS.sql}, n AS (SELECT host, CASE WHEN regexp_matches(host, '^\\[[^\\]]+\\]') THEN regexp_extract(host, '^\\[([^\\]]+)\\]', 1) ELSE split_part(lower(host), ':', 1) END AS name FROM hosts), l AS (SELECT host, name IN ('localhost', '127.0.0.1', '0.0.0.0', '::1') OR ends_with(name, '.local') OR ends_with(name, '.localhost') AS local FROM n) "
    "SELECT host, local, CASE WHEN local AND ends_with(host, ':11434') THEN 'ollama' WHEN local AND ends_with(host, ':8188') THEN 'comfyui' END AS service FROM l",
)
def fn03_localhost(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("host")
    return HOSTS.df(spark).select("host", hosts.is_localhost(h).alias("local"), hosts.local_service(h).alias("service"))


@query("fn04_vendor_domain", f"WITH {HOSTS.sql} SELECT host, nullif(regexp_extract(regexp_replace(lower(host), ':[0-9]+$', ''), '\\}}\\.([a-z0-9_-]+(?:\\.[a-z0-9_-]+)+)$', 1), '') AS vendor FROM hosts")
def fn04_vendor_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HOSTS.df(spark).select("host", hosts.vendor_domain(F.col("host")).alias("vendor"))


@query("fn06_registrable_domain", f"WITH {_PARTS}, h AS (SELECT DISTINCT host FROM shape UNION SELECT host FROM (VALUES ('api.acme.co.uk'), ('acme.co.uk'), ('com'), ('a.b.c.d')) v(host)) SELECT host, regexp_extract(host, CASE WHEN regexp_matches(host, '\\.(co|com|org|net|gov|ac|edu|ne|or)\\.[a-z]{{2}}$') THEN '([^.]+\\.[^.]+\\.[^.]+)$' ELSE '(([^.]+\\.)?[^.]+)$' END, 1) AS domain FROM h")
def fn06_registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([("api.acme.co.uk",), ("acme.co.uk",), ("com",), ("a.b.c.d",)], "host string")
    return shaped(spark, sf_dir).select("host").union(more).distinct().select("host", hosts.registrable_domain(F.col("host")).alias("domain"))


RESOLVE = Fixture(
    "cases",
    "id bigint, sdk_provider string, host_kind string, host string, env_name string",
    [
        (1, "stripe", "literal", "api.openai.com", None),
        (2, None, "literal", "localhost:11434", None),
        (3, None, "relative", None, None),
        (4, None, "literal", "maps.googleapis.com", None),
        (5, None, "literal", "sheets.googleapis.com", None),
        (6, None, "env", None, "NEXT_PUBLIC_SUPABASE_URL"),
        (7, None, "env", None, "SLACK_FEEDBACK_WEBHOOK_URL"),
        (8, None, "env", None, "GITHUB_CALLBACK_URL"),
        (9, None, "literal", "billing:8080", None),
        (10, None, "unknown", "{x}.zendesk.com", None),
        (11, None, "unknown", "{hostname}:443", None),
        (12, None, "env", "{env:REPLIT_CONNECTORS_HOSTNAME}", None),
        (13, None, "literal", "a@b.com", None),
        (14, None, "literal", "constructor", None),
        (15, None, "unknown", "{a}.my.salesforce.com", None),
        (16, None, "env", "127.0.0.1:{env:PORT}", "PORT"),
        (17, None, "literal", "my-worker.acme.workers.dev", None),
    ],
)
NAMES = Fixture("names", "name string, provider string", [("supabase", "supabase"), ("slack", "slack"), ("github", "github"), ("openai", "openai")])


@query(
    "fn01_resolve_provider",
    golden(
        "id, provider, source",
        [
            (1, "stripe", "sdk"), (2, "ollama", "host"), (3, "internal", None), (4, "google-maps", "host"), (5, "google", "host"), (6, "supabase", "env-name"),
            (7, "slack", "env-name"), (8, "env:GITHUB_CALLBACK_URL", None), (9, "billing:8080", None), (10, "zendesk.com", None), (11, "unknown", None),
            (12, "env:REPLIT_CONNECTORS_HOSTNAME", None), (13, "unknown", None), (14, "unknown", None), (15, "salesforce", "host"), (16, "internal", None), (17, "cloudflare-workers", "host"),
        ],
    ),
)
def fn01_resolve_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.resolve(RESOLVE.df(spark), providers.provider_hosts(spark), NAMES.df(spark)).select("id", "provider", "source")


ENVS = Fixture("envs", "env_name string", [("OPENAI_API_BASE_URL",), ("VITE_GITHUB_API_URL",), ("SLACK_WEBHOOK_URL",), ("GITHUB_CALLBACK_URL",), ("REACT_APP_SUPABASE_HOST",), ("PORT",), (None,)])


@query("fn02_env_name_provider", golden("env_name, provider", [("OPENAI_API_BASE_URL", "openai"), ("VITE_GITHUB_API_URL", "github"), ("SLACK_WEBHOOK_URL", "slack"), ("GITHUB_CALLBACK_URL", None), ("REACT_APP_SUPABASE_HOST", "supabase"), ("PORT", None), (None, None)]))
def fn02_env_name_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.from_env_name(ENVS.df(spark), NAMES.df(spark), out="provider")


API = Fixture(
    "named",
    "host string, path string, api boolean",
    [
        ("api.acme.com", "", True), ("acme.com", "/v1/users", True), ("acme.com", "", False), ("github.com", "/acme/repo", False), ("github.com", "/api/v3", True),
        ("api.github.com", "/repos", True), ("docs.acme.com", "/api", False), ("www.example.com", "/api", False), ("cdn.acme.com", "/api/x", False), ("api.acme.local", "", False),
        ("api.acme.com", "/logo.png", False), ("login.acme.com", "/oauth2/authorize", False), ("www.googleapis.com", "/auth/drive", False), ("graph.microsoft.com", "/User.Read", False),
        ("api.acme.com", "/en/docs/x", False), ("sqs.amazonaws.com", "/your-account-id/q", False), ("chat-api.acme.io", "/x", True), ("gateway.ai.cloudflare.com", "/v1", True),
        ("yourapp.com", "/api", False), ("api.telegram.org", "/bot{token}/send", True), ("acme.co.uk", "/graphql", True),
    ],
)


@query("fn05_api_host", golden("host, path, api", API.rows))
def fn05_api_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(API.df(spark).select("host", "path"), host_rules.rules(spark)).select("host", "path", "api")


NO_CALL = Fixture(
    "no_call", "host string, path string, no_call boolean",
    [("a.io", "/authorize", True), ("a.io", "/oauth2/v2.0/authorize", True), ("a.io", "/orders/{id}/authorize", False), ("a.io", "/x?response_type=code", True), ("a.io", "/en-us/reference/x", True), ("a.io", "/v1/reference", False), ("s3.amazonaws.com", "/123456789012/x", True), ("hooks.slack.com", "/services/XXXX", False), ("graph.microsoft.com", "/.default", True)],
)


@query("fn08_no_call_path", golden("host, path, no_call", NO_CALL.rows))
def fn08_no_call_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(NO_CALL.df(spark).select("host", "path"), host_rules.rules(spark)).select("host", "path", "no_call")


LITERALS = Fixture(
    "literals",
    "file string, line bigint, language string, lit string",
    [
        ("a.py", 1, "python", "https://api.acme.com/v1/users"), ("a.py", 9, "python", "see\n[docs](https://api.acme.com/v1/x)\nhttps://user:pw@API.Beta.io.:443/graphql"),
        ("b.ts", 4, "typescript", "https://api.acme.com/v2"), ("b.ts", 5, "typescript", "<https://api.gamma.dev/v1>"), ("c.ts", 2, "typescript", "https://{host}/api and https://example.com/api"),
        ("c.ts", 8, "typescript", "http://api.delta.ai/v1?x=1 http://api.acme.com/v1"), ("c.ts", 9, "typescript", "no url here"),
    ],
)


def mentions(spark: SparkSession) -> DataFrame:
    """API-looking hosts in literals, at their lines."""
    found = LITERALS.df(spark).select("file", "line", "language", F.explode(hosts.urls_in(F.col("lit"))).alias("u"))
    sites = found.select("file", (F.col("line") + F.col("u.line")).alias("line"), "language", F.col("u.host").alias("host"), F.col("u.path").alias("path"))
    return host_rules.judge(sites, host_rules.rules(spark)).filter("api").select("file", "line", "language", "host")


@query("fn07_urls_in_literals", golden("file, line, language, host", [("a.py", 1, "python", "api.acme.com"), ("a.py", 11, "python", "api.beta.io"), ("b.ts", 4, "typescript", "api.acme.com"), ("c.ts", 8, "typescript", "api.delta.ai"), ("c.ts", 8, "typescript", "api.acme.com")]))
def fn07_urls_in_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark)


@query("agg05_host_mentions", golden("host, files, literals, first_file, first_line, language", [("api.acme.com", 3, 3, "a.py", 1, "python"), ("api.beta.io", 1, 1, "a.py", 11, "python"), ("api.delta.ai", 1, 1, "c.ts", 8, "typescript")]))
def agg05_host_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("file", "line")
    first = mentions(spark).groupBy("host").agg(F.count_distinct("file").alias("files"), F.count("*").alias("literals"), F.min(at).alias("first"), F.min_by("language", at).alias("language"))
    return first.select("host", "files", "literals", F.col("first.file").alias("first_file"), F.col("first.line").alias("first_line"), "language")


@query(
    "src11_html_pages",
    "SELECT page_id, length(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script\\s*>', 1))::BIGINT AS scripts, sum_len AS script_chars, length(regexp_extract_all(html, '(?s)<!--.*?-->'))::BIGINT AS comments "
    "FROM (SELECT page_id, html, coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script\\s*>', 1), lambda s: length(s))), 0)::BIGINT AS sum_len FROM pages)",
)
def src11_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id",
        F.size(scripts).cast("long").alias("scripts"),
        F.aggregate(scripts, F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("script_chars"),
        F.size(F.regexp_extract_all(html, F.lit(r"(?s)<!--.*?-->"), F.lit(0))).cast("long").alias("comments"),
    )


@query("fn16_links_of_pages", "SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def fn16_links_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<a(\s[^>]*)>"), F.lit(1))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.explode(F.filter(F.transform(tags, lambda t: F.try_element_at(text.attributes(t), F.lit("href"))), lambda h: h.isNotNull())).alias("href"))


TAGS = Fixture("tags", "tag string", [("<input type=\"email\" name=email required>",), ("<a HREF='/x' href=\"/y\" data-k=1>",), ("<p>",)])


@query("fn16_attributes", golden("tag, href, name, required", [(TAGS.rows[0][0], None, "email", ""), (TAGS.rows[1][0], "/y", None, None), (TAGS.rows[2][0], None, None, None)]))
def fn16_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = text.attributes(F.regexp_replace("tag", r"^<\w+|>\z", ""))
    return TAGS.df(spark).select("tag", *[F.try_element_at(attrs, F.lit(k)).alias(k) for k in ("href", "name", "required")])


FORMS = Fixture(
    "docs",
    "file string, html string",
    [
        ("a.html", '<html>\n<form action="https://formspree.io/f/x" method="POST">\n<input name="email" type="email" required>\n<input type="hidden" name="_subject" value="Hi" required><input type="submit" name="go"></form></html>'),
        ("b.html", '<form action="/search"><input name="q"></form>\n<!-- <form action="/no"></form> -->\n<form action="mailto:a@b.c"></form>'),
        ("c.html", '<form action="/up" method="post" enctype="multipart/form-data"><textarea name="t"></textarea></form>'),
    ],
)


@query(
    "det13_html_forms",
    golden(
        "file, line, method, action, encoding, fields, required",
        [("a.html", 2, "POST", "https://formspree.io/f/x", "form", "email,_subject", "email,_subject"), ("b.html", 1, "GET", "/search", "none", "q", ""), ("c.html", 1, "POST", "/up", "multipart", "t", "")],
    ),
)
def det13_html_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that send a request: GET fields are query parameters, others the body."""
    from callscope.operators.html import forms

    return forms(FORMS.df(spark)).select("file", "line", "method", "action", "encoding", F.array_join("fields", ",").alias("fields"), F.array_join("required", ",").alias("required"))
