"""Queries over configuration documents and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.plans.fixture import Fixture, golden
from callscope.plans.registry import query
from callscope.sources import config, documents

DOCUMENTS = Fixture(
    "documents_",
    "path string, body string",
    [
        ("a.jsonc", '{\n  // hi\n  "mcp": {"url": "https://a.io/x//y", "n": [1, true,]},\n  "z": null,\n}'),
        ("b.toml", 'title = "t"\n[servers.main]\nurl = "https://b.io"\nports = [80, 443]\n'),
        ("c.yaml", '# top\nname: app  # note\nurl: "https://c.io/#x"\nservers:\n  - host: h1\n    ports: [1, 2]\n  - host: \'it\'\'s\'\nitems:\n- one\n- two\ntext: |\n  line 1\n    line 2\nflow: {a: 1, b: [x, "y"]}\nnone:\nlast: -3.5\n---\nsecond: yes\nref: *anchor\n'),
        ("d.json", "{broken"),
        ("e.txt", "x: 1"),
    ],
)


@query(
    "src15_document_values",
    golden(
        "path, doc, key, value, kind, line, problem",
        [
            ("a.jsonc", 0, "mcp.url", "https://a.io/x//y", "string", 3, None), ("a.jsonc", 0, "mcp.n[0]", "1", "number", 3, None), ("a.jsonc", 0, "mcp.n[1]", "true", "boolean", 3, None), ("a.jsonc", 0, "z", None, "null", 4, None),
            ("b.toml", 0, "title", "t", "string", 1, None), ("b.toml", 0, "servers.main.url", "https://b.io", "string", 3, None), ("b.toml", 0, "servers.main.ports[0]", "80", "number", 4, None), ("b.toml", 0, "servers.main.ports[1]", "443", "number", 4, None),
            ("c.yaml", 0, "name", "app", "string", 2, None), ("c.yaml", 0, "url", "https://c.io/#x", "string", 3, None), ("c.yaml", 0, "servers[0].host", "h1", "string", 5, None), ("c.yaml", 0, "servers[0].ports[0]", "1", "number", 6, None), ("c.yaml", 0, "servers[0].ports[1]", "2", "number", 6, None),
            ("c.yaml", 0, "servers[1].host", "it's", "string", 7, None), ("c.yaml", 0, "items[0]", "one", "string", 9, None), ("c.yaml", 0, "items[1]", "two", "string", 10, None), ("c.yaml", 0, "text", "line 1\n  line 2", "string", 11, None),
            ("c.yaml", 0, "flow.a", "1", "number", 14, None), ("c.yaml", 0, "flow.b[0]", "x", "string", 14, None), ("c.yaml", 0, "flow.b[1]", "y", "string", 14, None), ("c.yaml", 0, "last", "-3.5", "number", 16, None), ("c.yaml", 1, "second", "yes", "string", 18, None),
            ("d.json", 0, None, None, None, 1, "parse-error"),
        ],
    ),
)
def src15_document_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of JSON, TOML and YAML with their lines; aliases are not followed."""
    return documents.document_values(DOCUMENTS.df(spark))


READS = Fixture("config_reads", "src string, literal string, key string", [("app/main.py", "../c.yaml", "servers[0].host"), ("app/main.py", "../b.toml", "servers.main.url"), ("app/main.py", "../a.jsonc", "mcp.url"), ("app/main.py", "none.yaml", "x")])


@query("src16_loaded_documents", golden("src, key, value", [("app/main.py", "servers[0].host", "h1"), ("app/main.py", "servers.main.url", "https://b.io"), ("app/main.py", "mcp.url", "https://a.io/x//y"), ("app/main.py", "x", None)]))
def src16_loaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.loaded_documents(READS.df(spark), DOCUMENTS.df(spark))


SPRING = Fixture(
    "spring_files",
    "path string, body string",
    [
        ("src/application.yml", "api:\n  base-url: https://plain.io\n  key: k\nspring:\n  config:\n    import: optional:classpath:extra.yml\n---\nspring.config.activate.on-profile: dev\napi:\n  baseUrl: https://dev.io\n---\nspring.config.activate.on-profile: prod\napi.key: hidden\n"),
        ("src/application-dev.properties", "API_TIMEOUT=5\n# c\napi.port : 80\n"),
        ("src/application-prod.properties", "api.port=443\n"),
        ("src/extra.yml", "extra:\n  url: https://extra.io\napi:\n  key: imported\n"),
        ("src/other.yml", "not: read\n"),
    ],
)


@query(
    "src17_spring_values",
    golden("key, value", [("api.baseurl", "https://dev.io"), ("api.key", "imported"), ("spring.config.import", "optional:classpath:extra.yml"), ("spring.config.activate.onprofile", "dev"), ("apitimeout", "5"), ("api.port", "80"), ("extra.url", "https://extra.io")]),
)
def src17_spring_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings under the profile ``dev``: YAML documents, property files and an import."""
    return documents.spring_values(SPRING.df(spark), ["dev"])


MANIFESTS = Fixture(
    "manifest_files",
    "path string, body string",
    [
        ("py/pyproject.toml", '[project]\ndependencies = ["Requests>=2.31", "typing_extensions", "openai[x]==1.2.0; python_version > \'3\'"]\n[project.optional-dependencies]\ndev = ["pytest ~= 8"]\n[tool.poetry.dependencies]\npython = "^3.12"\nhttpx = {version = "^0.27", extras = ["http2"]}\n'),
        ("rs/Cargo.toml", '[dependencies]\nserde_json = "1"\nreqwest = { version = "0.12", features = ["json"] }\nold = { package = "new-name", path = "../x" }\n[dev-dependencies]\ntokio = "1.0"\n'),
        ("app/pubspec.yaml", "name: app\ndependencies:\n  http: ^1.2.0\n  flutter:\n    sdk: flutter\ndev_dependencies:\n  test: any\n"),
        ("jvm/build.gradle.kts", 'dependencies {\n  implementation("com.squareup.okhttp3:okhttp:4.12.0")\n  // api("no:no:1")\n  testImplementation(\'junit:junit\')\n}\n'),
        ("jvm/pom.xml", "<dependencies><dependency><groupId>org.x</groupId><artifactId>y</artifactId><version>1.0</version></dependency><!-- <dependency><groupId>a</groupId></dependency> --></dependencies>"),
        ("jvm/gradle/libs.versions.toml", '[versions]\nktor = "2.3"\n[libraries]\nktor = { module = "io.ktor:ktor-client", version.ref = "ktor" }\nretro = "com.squareup:retrofit:2.9"\ng = { group = "a.b", name = "c" }\n'),
        ("bad/Cargo.toml", "[dependencies"),
    ],
)


@query(
    "src19_more_manifests",
    golden(
        "dir, ecosystem, package, version",
        [
            ("py", "pypi", "requests", ">=2.31"), ("py", "pypi", "typing-extensions", ""), ("py", "pypi", "openai", "1.2.0"), ("py", "pypi", "pytest", "~= 8"), ("py", "pypi", "httpx", "^0.27"),
            ("rs", "crates", "serde-json", "1"), ("rs", "crates", "reqwest", "0.12"), ("rs", "crates", "new-name", ""), ("rs", "crates", "tokio", "1.0"), ("app", "pub", "http", "^1.2.0"), ("app", "pub", "flutter", ""), ("app", "pub", "test", "any"),
            ("jvm", "maven", "com.squareup.okhttp3:okhttp", "4.12.0"), ("jvm", "maven", "junit:junit", ""), ("jvm", "maven", "org.x:y", "1.0"), ("jvm/gradle", "maven", "io.ktor:ktor-client", "2.3"), ("jvm/gradle", "maven", "com.squareup:retrofit", "2.9"), ("jvm/gradle", "maven", "a.b:c", ""),
        ],
    ),
)
def src19_more_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.more_manifests(MANIFESTS.df(spark))


DIFF = Fixture("diff", "line string", [("M\ta.ts",), ("A\tb/c.ts",), ("D\told.ts",), ("R087\tfrom.ts\tto.ts",), ("C100\tbase.ts\tcopy.ts",), ("",), ("M\ta.ts",)])


@query("src21_changed_files", golden("path, status", [("a.ts", "M"), ("b/c.ts", "A"), ("old.ts", "D"), ("from.ts", "D"), ("to.ts", "A"), ("copy.ts", "A")]))
def src21_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.changed_files(DIFF.df(spark))


TREE = Fixture(
    "tree", "path string, real string",
    [("src/a.ts", None), ("src/b.py", None), ("node_modules/x/i.ts", None), ("dist/o.ts", None), ("pkg/build/o.ts", None), ("link.ts", "/repo/src/a.ts"), ("out.ts", "/etc/passwd"), ("src/skip/c.tsx", None), ("src/d.tsx", None), ("README.md", None)],
)


@query("src01_language_files", golden("path", [("src/a.ts",), ("link.ts",), ("src/d.tsx",)]))
def src01_language_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a language without dependencies, build output, what is excluded and links that lead out."""
    return config.language_files(config.inside(TREE.df(spark), "/repo"), [".ts", ".tsx"], exclude=["src/skip/**"]).select("path")
