"""Queries over script files: JavaScript and TypeScript, one by one and linked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import urls
from callscope.operators import frontend, javascript, providers, python
from callscope.plans.fixture import Fixture, golden
from callscope.plans.registry import query
from callscope.sources import registries

SCRIPTS = Fixture(
    "scripts",
    "path string, body string",
    [
        ("src/config.ts", 'export const CONFIG = { base: "https://api.linear.app", v: "v1" } as const;\nexport const ROOT = "https://api.vercel.com";\n'),
        ("src/clients/mail.ts", 'import axios from "axios";\nfunction make() {\n  return axios.create({ baseURL: process.env.MAIL_URL });\n}\nexport const mail = make();\nexport { mail as post } from "./other";\n'),
        ("src/clients/index.ts", 'export { mail } from "./mail";\n'),
        (
            "src/use.ts",
            'import { CONFIG, ROOT as root } from "./config";\nimport { mail } from "./clients";\nimport { mail as same } from "@app/clients/mail";\n\nexport const gql = (query: string) =>\n  fetch(CONFIG.base + "/graphql", { method: "POST", body: JSON.stringify({ query }) });\n'
            "export async function projects(team: string) {\n  const path = `/v9/projects/${team}`;\n  return fetch(root + path, { headers: { Authorization: `Bearer ${process.env.T}` } });\n}\nexport const send = (to: string) => mail.post(`/send/${to}`, { to, kind: 'x' });\nsame.get('/status');\n",
        ),
        (
            "web/app.js",
            'const ax = require("axios");\nconst { get } = require("https");\n// fetch("https://commented.io")\nconst re = /fetch("x")/;\nax({ method: "put", url: "https://api.acme.io/a", data: { n: 1 } });\nax.delete("https://api.acme.io/a/" + id);\n'
            '$.ajax({ url: "https://api.acme.io/q", type: "post", data: { a: 1, b: 2 } });\nvar x = new XMLHttpRequest();\nx.open("PATCH", "https://api.acme.io/x");\nfetch(new Request("https://api.acme.io/r", { method: "POST", body: JSON.stringify({ z: 1 }) }));\nfetch("data:text/plain,hi");\ncache.get("/not/a/call");\n',
        ),
        (
            "web/node.mjs",
            'import https from "node:https";\nimport got from "got";\nconst api = got.extend({ prefixUrl: "https://api.mailgun.net/v3" });\nhttps.request({ hostname: "api.pagerduty.com", path: "/incidents", method: "POST" });\nhttps.get("https://api.acme.io/health");\napi.post("messages", { form: { from, to } });\nfetch(["https://api.acme.io", "v1", id].join("/"));\nconst u = new URL("/search", "https://api.acme.io");\nfetch(u, { method: verb });\n'
            'class Client {\n  base = "https://api.fields.io";\n  list(page = "1") {\n    return fetch(`${this.base}/list/${page}`);\n  }\n}\nenum E { Users = "https://api.acme.io/users" }\nconst users = () => fetch(E.Users);\n',
        ),
    ],
)
_USE = [
    ("src/use.ts", 6, "fetch", "POST", "https://api.linear.app/graphql", "", "query"),
    ("src/use.ts", 9, "fetch", "GET", "https://api.vercel.com/v9/projects/{team}", "authorization", ""),
    ("src/use.ts", 11, "axios", "POST", "{env:MAIL_URL}/send/{to}", "", "to,kind"),
    ("src/use.ts", 12, "axios", "GET", "{env:MAIL_URL}/status", "", ""),
]
_APP = [
    ("web/app.js", 5, "axios", "PUT", "https://api.acme.io/a", "", "n"),
    ("web/app.js", 6, "axios", "DELETE", "https://api.acme.io/a/{id}", "", ""),
    ("web/app.js", 7, "jquery", "POST", "https://api.acme.io/q", "", "a,b"),
    ("web/app.js", 9, "xhr", "PATCH", "https://api.acme.io/x", "", ""),
    ("web/app.js", 10, "fetch", "POST", "https://api.acme.io/r", "", "z"),
]
_NODE = [
    ("web/node.mjs", 4, "node-https", "POST", "https://api.pagerduty.com/incidents", "", ""),
    ("web/node.mjs", 5, "node-https", "GET", "https://api.acme.io/health", "", ""),
    ("web/node.mjs", 6, "got", "POST", "https://api.mailgun.net/v3/messages", "", "from,to"),
    ("web/node.mjs", 7, "fetch", "GET", "https://api.acme.io/v1/{id}", "", ""),
    ("web/node.mjs", 9, "fetch", "DYNAMIC", "https://api.acme.io/search", "", ""),
    ("web/node.mjs", 13, "fetch", "GET", "https://api.fields.io/list/1", "", ""),
    ("web/node.mjs", 17, "fetch", "GET", "https://api.acme.io/users", "", ""),
]
_COLUMNS = "path, line, client, method, url, headers, body_keys"


def script_calls(spark: SparkSession) -> DataFrame:
    return javascript.javascript_calls(SCRIPTS.df(spark), {"@app/": "src/"})


@query("low09_script_calls", golden(_COLUMNS, [*_USE, *_APP, *_NODE]))
def low09_script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests of a few script files, with constants and clients from other files."""
    return script_calls(spark)


@query("det04_fetch", golden(_COLUMNS, [r for r in [*_USE, *_APP, *_NODE] if r[2] == "fetch"]))
def det04_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fetch`` and ``Request``; local data is no call."""
    return script_calls(spark).filter("client = 'fetch'")


@query("det05_clients", golden(_COLUMNS, [r for r in [*_USE, *_APP, *_NODE] if r[2] != "fetch"]))
def det05_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """axios, got, Node's own client, jQuery and XHR, instances included."""
    return script_calls(spark).filter("client <> 'fetch'")


@query(
    "res05_script_providers",
    golden(
        "provider, host_kind, calls",
        [("api.linear.app", "literal", 1), ("api.vercel.com", "literal", 1), ("env:MAIL_URL", "env", 2), ("api.acme.io", "literal", 9), ("api.pagerduty.com", "literal", 1), ("mailgun", "literal", 1), ("api.fields.io", "literal", 1)],
    ),
)
def res05_script_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script calls to providers, through the same shapes and joins as pages."""
    shaped = urls.with_shape(script_calls(spark), F.col("url"), F.lit(False)).select(F.lit(None).cast("string").alias("sdk_provider"), "u.host_kind", "u.host", "u.env_name")
    none = spark.createDataFrame([], "name string, provider string")
    return providers.resolve(shaped, providers.provider_hosts(spark), none).groupBy("provider", "host_kind").agg(F.count("*").alias("calls"))


@query("low09_page_scripts", "SELECT count(*) AS scripts, 0::BIGINT AS calls FROM pages")
def low09_page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inline scripts of all pages through the script reader; they send nothing."""
    script = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1)))
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), "page_id", F.lit(".js")).alias("path"), script.alias("body"))
    calls = javascript.javascript_calls(files).agg(F.count("*").alias("calls"))
    return files.agg(F.count("*").alias("scripts")).crossJoin(calls)  # one row each


REGISTRIES = Fixture(
    "registries",
    "path string, body string",
    [
        ("a/mail.json", '{"package": "resend", "provider": "resend", "host": "api.resend.com", "auth": "bearer", "instance": {"names": ["default", "Resend"]}, "methods": {"emails.send": {"method": "POST", "path": "/emails", "bodyArg": 0}, "emails.get": {"method": "GET", "path": "/emails/{id}"}}}'),
        ("b/llm.json", '[{"package": "@mistralai/mistralai", "provider": "mistral", "host": "api.mistral.ai", "auth": "bearer", "basePath": "/v1", "instance": {"names": ["Mistral"]}, "methods": {"chat.complete": {"method": "POST", "path": "/chat/completions"}}}, {"package": "bare", "provider": "x"}]'),
        ("c/chain.json", '{"package": "web3", "aliases": ["web3-core"], "provider": "ethereum", "host": null, "auth": "none", "methods": {"eth.*.call": {"method": "POST", "path": "/"}, "track.**": {"method": "GET", "path": "/t", "host": "t.web3.io"}}}'),
        ("d/broken.json", "{not json"),
    ],
)
SDK_FILES = Fixture(
    "sdk_files",
    "path string, body string",
    [
        ("m.ts", 'import { Resend } from "resend";\nimport { Mistral } from "@mistralai/mistralai";\nconst resend = new Resend(process.env.KEY);\nexport const send = () => resend.emails.send({ to });\nclass Bot {\n  llm = new Mistral({ apiKey });\n  ask() {\n    return this.llm.chat.complete({ model: "m" });\n  }\n}\nresend.domains.list();\n'),
        ("w.js", 'const Web3 = require("web3");\nconst w = new Web3(url);\nw.eth.transfer.call();\nfunction client() {\n  return new Web3(url);\n}\nclient().track.a.b(1);\nnew Other().emails.send();\n'),
        ("v.ts", 'import core from "web3-core";\nimport { Wrong } from "resend";\nconst r = new Wrong();\ncore.eth.x.call();\nr.emails.send();\n'),
    ],
)


@query(
    "det01_sdk_methods",
    golden(
        "path, line, package, provider, host, auth, method, api_path",
        [
            ("m.ts", 4, "resend", "resend", "api.resend.com", "bearer", "POST", "/emails"),
            ("m.ts", 8, "@mistralai/mistralai", "mistral", "api.mistral.ai", "bearer", "POST", "/v1/chat/completions"),
            ("w.js", 3, "web3", "ethereum", None, "none", "POST", "/"),
            ("w.js", 7, "web3", "ethereum", "t.web3.io", "none", "GET", "/t"),
            ("v.ts", 4, "web3", "ethereum", None, "none", "POST", "/"),
        ],
    ),
)
def det01_sdk_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients made in script files, against registries read from JSON."""
    methods = registries.registry_rows(REGISTRIES.df(spark))
    calls = javascript.sdk_calls(SDK_FILES.df(spark)).withColumnRenamed("path", "file")
    found = registries.match_sdk_calls(calls, methods)
    return found.select(F.col("file").alias("path"), "line", "package", "provider", "host", "auth", "method", F.col("path").alias("api_path"))


@query("src19_registries", golden("package, root, key, method, path", [("resend", "resend", "emails.send", "POST", "/emails"), ("resend", "resend", "emails.get", "GET", "/emails/{id}"), ("@mistralai/mistralai", "@mistralai/mistralai", "chat.complete", "POST", "/v1/chat/completions"), ("web3", "web3", "eth.*.call", "POST", "/"), ("web3", "web3-core", "eth.*.call", "POST", "/"), ("web3", "web3", "track.**", "GET", "/t"), ("web3", "web3-core", "track.**", "GET", "/t")]))
def src19_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registries.registry_rows(REGISTRIES.df(spark)).select("package", "root", "key", "method", "path")


PYTHON = Fixture(
    "python_files",
    "path string, body string",
    [
        ("app/config.py", 'import os\nfrom pydantic_settings import BaseSettings\n\nBASE = "https://api.acme.io"\nTOKEN_URL = os.environ["TOKEN_URL"]\n\nclass Settings(BaseSettings):\n    api_url: str\n    region: str = "eu"\n\nsettings = Settings()\n'),
        ("app/http/__init__.py", "from .session import session\n"),
        ("app/http/session.py", "import requests\nfrom ..config import BASE\n\nsession = requests.Session()\n"),
        (
            "app/use.py",
            'import aiohttp\nimport httpx\nimport requests\nfrom httpx import AsyncClient\nfrom .config import BASE, settings\nfrom .http import session\nfrom . import config\n\nclass Api:\n    root = "https://api.fields.io"\n\n    def __init__(self, key):\n        self.client = httpx.Client(base_url=self.root + "/v2")\n\n    def list(self, page=1):\n        return self.client.get(f"/items/{page}", headers={"X-Key": "k"})\n\n    def add(self, name):\n        body = {"name": name, "kind": "x"}\n        return self._send("/items", body)\n\n'
            "    async def stream(self):\n        async with AsyncClient(base_url=settings.api_url) as c:\n            await c.post('/stream', json=dict(a=1, b=2))\n\ndef charge(amount):\n    return requests.post(BASE + '/charges', json={'amount': amount})\n\ndef ping():\n    return session.get(f\"{config.BASE}/ping\")\n\n"
            'async def fetch(url: str, s: aiohttp.ClientSession):\n    async with s.get("https://api.acme.io/" + settings.region) as r:\n        return await r.json()\n\ndef make():\n    return requests.Session()\n\nmake().request("PURGE", "https://cache.acme.io/all")\ncache.get("/no/call")\n',
        ),
        ("app/plain.py", 'import json\nfrom urllib.request import Request, urlopen\n\nreq = Request("https://api.acme.io/q", data=json.dumps({"q": 1}).encode(), headers={"A": "b"})\nurlopen(req)\nurlopen("https://api.acme.io/plain")\n'),
        ("app/bad.py", "def ("),
    ],
)


@query(
    "low02_python_files",
    golden(
        _COLUMNS,
        [
            ("app/use.py", 16, "httpx", "GET", "https://api.fields.io/v2/items/1", "x-key", ""),
            ("app/use.py", 24, "httpx", "POST", "{env:API_URL}/stream", "", "a,b"),
            ("app/use.py", 27, "requests", "POST", "https://api.acme.io/charges", "", "amount"),
            ("app/use.py", 30, "requests", "GET", "https://api.acme.io/ping", "", ""),
            ("app/use.py", 33, "aiohttp", "GET", "https://api.acme.io/eu", "", ""),
            ("app/use.py", 39, "requests", "PURGE", "https://cache.acme.io/all", "", ""),
            ("app/plain.py", 5, "urllib.request", "POST", "https://api.acme.io/q", "a", "q"),
            ("app/plain.py", 6, "urllib.request", "GET", "https://api.acme.io/plain", "", ""),
        ],
    ),
)
def low02_python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, clients, class members, settings and names of other files."""
    return python.python_calls(PYTHON.df(spark))


PYTHON_SDK = Fixture(
    "python_sdk",
    "path string, body string",
    [
        ("a.py", "from mistral import Mistral\nimport web3\nfrom web3.eth import track\n\nclass Bot:\n    def __init__(self):\n        self.llm = Mistral(api_key=k)\n\n    def ask(self):\n        return self.llm.chat.complete(model='m')\n\nweb3.eth.transfer.call()\ndef make():\n    return Mistral()\nmake().chat.complete()\n"),
        ("b.py", "import google.genai as g\nc = g.Client()\nc.models.generate(1)\ng.other()\n"),
    ],
)
PYTHON_REGISTRIES = Fixture(
    "python_registries",
    "path string, body string",
    [
        ("a.json", '{"package": "mistralai", "imports": ["mistral"], "provider": "mistral", "host": "api.mistral.ai", "auth": "bearer", "instance": {"names": ["Mistral"]}, "methods": {"chat.complete": {"method": "POST", "path": "/v1/chat"}}}'),
        ("b.json", '{"package": "web3", "provider": "ethereum", "host": null, "auth": "none", "methods": {"eth.*.call": {"method": "POST", "path": "/"}}}'),
        ("c.json", '{"package": "google-genai", "imports": ["google.genai"], "provider": "google-ai", "host": "g.io", "auth": "apikey", "instance": {"names": ["Client"]}, "methods": {"models.generate": {"method": "POST", "path": "/g"}}}'),
    ],
)


@query("det01_python_sdk", golden("path, line, package, provider, method, api_path", [("a.py", 10, "mistralai", "mistral", "POST", "/v1/chat"), ("a.py", 12, "web3", "ethereum", "POST", "/"), ("a.py", 15, "mistralai", "mistral", "POST", "/v1/chat"), ("b.py", 3, "google-genai", "google-ai", "POST", "/g")]))
def det01_python_sdk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients made in Python files, against registries by import root."""
    calls = python.sdk_calls(PYTHON_SDK.df(spark)).withColumnRenamed("path", "file")
    found = registries.match_sdk_calls(calls, registries.registry_rows(PYTHON_REGISTRIES.df(spark)))
    return found.select(F.col("file").alias("path"), "line", "package", "provider", "method", F.col("path").alias("api_path"))


def _python(spark: SparkSession, fixture: Fixture) -> DataFrame:
    return frontend.scan_files(fixture.df(spark), python.python_rows, "kind string, line long, name string, method string, url string, headers string, body_keys string")


VALUES = Fixture(
    "python_values",
    "path string, body string",
    [
        ("pkg/names.py", "import os\nfrom os import environ, getenv\nBASE = 'https://a.io'\nV = 2\nLATE = BASE + '/late'\nBASE = 'https://b.io'\nNESTED = f'{BASE}/v{V}'\nENV = os.getenv('HOST', 'x')\nSUB = environ['SUB']\nEITHER = getenv('E') or BASE\nPICK = BASE if V else other\nPERCENT = '%s/%d' % (BASE, V)\nFORMAT = '{}/{name}'.format(BASE, name=V)\nJOINED = '/'.join([BASE, 'x'])\nSTRIPPED = (BASE + '/').rstrip('/')\nCALLED = make(V)\nINDEX = table['key']\nLIST = [1, 2]\n"),
        ("pkg/scopes.py", "import requests\nU = 'https://outer.io'\ndef f(U='https://dflt.io'):\n    requests.get(U)\ndef g():\n    U = 'https://inner.io'\n    requests.get(U)\n    U = 'https://later.io'\ndef h():\n    requests.get(U + '/h')\ndef k(path):\n    for _ in x:\n        requests.get(path)\n"),
        ("pkg/classes.py", "import requests\nclass Base:\n    root = 'https://base.io'\n    def get(self, p):\n        return requests.get(self.root + p)\nclass Child(Base):\n    def __init__(self):\n        self.own = self.root + '/child'\n    def go(self):\n        return requests.post(self.own)\nc = Child()\nrequests.put(c.root)\n"),
    ],
)


@query(
    "res05_evaluate",
    golden(
        "name, text",
        [
            ("BASE", "https://b.io"), ("V", "2"), ("LATE", "https://a.io/late"), ("NESTED", "https://b.io/v2"), ("ENV", "{env:HOST}"), ("SUB", "{env:SUB}"), ("EITHER", "{env:E}"), ("PICK", "https://b.io"),
            ("PERCENT", "https://b.io/2"), ("FORMAT", "https://b.io/2"), ("JOINED", "https://b.io/x"), ("STRIPPED", "https://b.io"), ("INDEX", "{key}"),
        ],
    ),
)
def res05_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the expressions of a module come to: the last assignment before a use, formats, variables, fallbacks; calls of unknown functions come to nothing."""
    rows = _python(spark, VALUES).filter("path = 'pkg/names.py' and kind = 'export'")
    return rows.select("name", F.col("url").alias("text"))


@query("res09_formats", golden("name, text", [("NESTED", "https://b.io/v2"), ("PERCENT", "https://b.io/2"), ("FORMAT", "https://b.io/2"), ("JOINED", "https://b.io/x")]))
def res09_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format strings of four kinds."""
    rows = _python(spark, VALUES).filter("kind = 'export' and name in ('NESTED', 'PERCENT', 'FORMAT', 'JOINED')")
    return rows.select("name", F.col("url").alias("text"))


@query("res02_scopes", golden("line, url", [(4, "https://dflt.io"), (7, "https://inner.io"), (10, "https://outer.io/h"), (13, "{path}")]))
def res02_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by their scope: a parameter's default, a local before its use, the module's, a parameter."""
    return _python(spark, VALUES).filter("path = 'pkg/scopes.py' and kind = 'call'").select("line", "url")


@query("res04_members", golden("line, method, url", [(5, "GET", "https://base.io{p}"), (10, "POST", "https://base.io/child"), (12, "PUT", "https://base.io")]))
def res04_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of classes, of their bases and of instances."""
    return _python(spark, VALUES).filter("path = 'pkg/classes.py' and kind = 'call'").select("line", "method", "url")


@query(
    "res01_project_names",
    golden("path, name, kind, text", [("app/config.py", "BASE", "text", "https://api.acme.io"), ("app/config.py", "TOKEN_URL", "text", "{env:TOKEN_URL}"), ("app/config.py", "settings.api_url", "text", "{env:API_URL}"), ("app/config.py", "settings.region", "text", "eu"), ("app/config.py", "Settings.api_url", "text", "{env:API_URL}"), ("app/config.py", "Settings.region", "text", "eu"), ("app/http/__init__.py", "session", "again", "{import:./session#session}"), ("app/http/session.py", "session", "client", "")]),
)
def res01_project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of a project offer each other: constants, settings, clients, and what a package passes on."""
    rows = _python(spark, PYTHON).filter("kind = 'export' and (path like 'app/config%' or path like 'app/http%')")
    return rows.select("path", "name", F.col("method").alias("kind"), F.col("url").alias("text"))


@query("res28_settings", golden("name, text", [("settings.api_url", "{env:API_URL}"), ("settings.region", "eu")]))
def res28_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a settings class: their default, else the variable of their name."""
    return _python(spark, PYTHON).filter("kind = 'export' and name like 'settings.%'").select("name", F.col("url").alias("text"))


CLIENTS = Fixture(
    "python_clients",
    "path string, body string",
    [
        (
            "c.py",
            "import requests, httpx, aiohttp, urllib3\nfrom urllib.request import urlopen, Request\nfrom requests import post as p\nrequests.request('patch', 'https://a.io/1', data={'k': 1})\nhttpx.stream('GET', 'https://a.io/2')\np('https://a.io/3', {'b': 1}, headers=dict(Accept='x'))\nhttp = urllib3.PoolManager()\nhttp.request('PUT', 'https://a.io/4', fields={'f': 1})\nwith requests.Session() as s:\n    s.delete('https://a.io/5')\nurlopen(Request('https://a.io/6', method='HEAD'))\n"
            "async def go():\n    async with aiohttp.ClientSession('https://b.io') as c:\n        await c.get('/7')\nclient = httpx.Client(base_url='https://c.io/')\nclient.request(verb, 'x8')\nrequests.codes.ok()\nsession.get('https://unknown.io')\n",
        )
    ],
)
_CLIENT_ROWS = [
    (4, "requests", "PATCH", "https://a.io/1", "", "k"), (5, "httpx", "GET", "https://a.io/2", "", ""), (6, "requests", "POST", "https://a.io/3", "accept", "b"), (8, "urllib3", "PUT", "https://a.io/4", "", "f"), (10, "requests", "DELETE", "https://a.io/5", "", ""),
    (11, "urllib.request", "HEAD", "https://a.io/6", "", ""), (14, "aiohttp", "GET", "https://b.io/7", "", ""), (16, "httpx", "DYNAMIC", "https://c.io/x8", "", ""),
]


@query("det02_http_clients", golden("line, client, method, url, headers, body_keys", _CLIENT_ROWS))
def det02_http_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP clients by their tables: functions, instances, options; an unknown object's methods are no calls."""
    return python.python_calls(CLIENTS.df(spark)).drop("path")


@query("det18_urllib", golden("path, line, method, url", [("app/plain.py", 5, "POST", "https://api.acme.io/q"), ("app/plain.py", 6, "GET", "https://api.acme.io/plain"), ("c.py", 11, "HEAD", "https://a.io/6")]))
def det18_urllib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the standard library, built before or where they are opened."""
    found = python.python_calls(PYTHON.df(spark).union(CLIENTS.df(spark)))
    return found.filter("client = 'urllib.request'").select("path", "line", "method", "url")
