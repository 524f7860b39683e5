"""Queries over served agents and framework helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.operators import agents, javascript, python
from callscope.plans.fixture import Fixture, golden
from callscope.plans.registry import query

FILES = Fixture(
    "agent_files",
    "path string, body string",
    [
        ("a.py", "from a2a.server.apps import A2AStarletteApplication\n# A2AStarletteApplication(x)\napp = A2AStarletteApplication(card)\nprotocol_version='0.3.0'\ntransport = \"GRPC\"\n"),
        ("b.ts", "import { A2AExpressApp } from '@a2a-js/sdk/server/express';\nnew A2AExpressApp(h);\nconst preferredTransport = 'JSONRPC';\napp.get('.well-known/agent-card.json');\n"),
        ("c.go", 'import "github.com/a2aproject/a2a-go/v2/a2asrv"\nh := a2asrv.NewHandler(x)\n'),
        ("web/.well-known/agent.json", '{"name": "Helper", "protocolVersion": "0.3", "preferredTransport": "HTTP_JSON", "additionalInterfaces": [{"transport": "GRPC"}], "skills": []}'),
        ("x/.well-known/agent-card.json", '{"no": "name"}'),
        ("d.py", "import crewai\n"),
        ("e.txt", "a2a.server A2AStarletteApplication(x)"),
    ],
)
_ROWS = [
    ("a.py", 3, "sdk", "A2AStarletteApplication", "a2a-sdk", "0.3.0", "GRPC", "", "", None),
    ("b.ts", 2, "sdk", "A2AExpressApp", "@a2a-js/sdk", "", "JSONRPC", "preferredTransport", "/.well-known/agent-card.json", None),
    ("c.go", 2, "sdk", "a2asrv.NewHandler", "github.com/a2aproject/a2a-go/v2", "", "", "", "", None),
    ("web/.well-known/agent.json", 1, "card-file", None, None, "0.3", "GRPC,HTTP+JSON", "additionalInterfaces,preferredTransport", "/.well-known/agent.json", "Helper"),
]


@query("agg09_served_agents", golden("path, line, kind, construction, package, versions, bindings, fields, card_paths, name", _ROWS))
def agg09_served_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.agent_coverage(agents.served_agents(FILES.df(spark)))[1]


@query("agg09_count", "SELECT 4::BIGINT AS count")
def agg09_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.agent_coverage(agents.served_agents(FILES.df(spark)))[0]


HELPERS = Fixture(
    "helper_files",
    "path string, body string",
    [
        ("p.ts", 'import { httpClient, HttpMethod } from "@activepieces/pieces-common";\nimport { getFromApi, postJsonToApi } from "@ai-sdk/provider-utils";\nhttpClient.sendRequest<{ a: string }>({ method: HttpMethod.POST, url: "https://slack.com/api/post", body: { channel, text } });\ngetFromApi({ url: "https://api.x.io/models", headers: { Authorization: k } });\npostJsonToApi({ url: `https://api.x.io/${path}`, body: { model } });\n'),
        ("n.ts", 'export async function call(this: F, method: string) {\n  const options = { method, uri: "https://api.github.com/x", body: { a: 1 } };\n  await this.helpers.httpRequestWithAuthentication.call(this, "cred", options);\n  return this.helpers.httpRequest({ method: "PUT", url: "https://api.y.io" });\n}\nthis.other.httpRequest({ url: "https://no.io" });\n'),
    ],
)


@query(
    "det07_frameworks",
    golden(
        "path, line, client, method, url, headers, body_keys",
        [
            ("p.ts", 3, "framework:activepieces", "POST", "https://slack.com/api/post", "", "channel,text"),
            ("p.ts", 4, "framework:ai-sdk", "GET", "https://api.x.io/models", "authorization", ""),
            ("p.ts", 5, "framework:ai-sdk", "POST", "https://api.x.io/{path}", "", "model"),
            ("n.ts", 3, "framework:n8n", "DYNAMIC", "https://api.github.com/x", "", "a"),
            ("n.ts", 4, "framework:n8n", "PUT", "https://api.y.io", "", ""),
        ],
    ),
)
def det07_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return javascript.javascript_calls(HELPERS.df(spark))


MCP = Fixture(
    "mcp_files",
    "path string, body string",
    [
        ("a.ts", 'import { StreamableHTTPClientTransport } from "@modelcontextprotocol/sdk/client/streamableHttp.js";\nimport { SSEClientTransport as Sse } from "@modelcontextprotocol/sdk/client/sse.js";\nconst BASE = process.env.MCP_URL;\nawait client.connect(new StreamableHTTPClientTransport(new URL("https://mcp.acme.com/v1")));\nconst t = new Sse(new URL(`${BASE}/sse`));\nnew Other(new URL("https://no.io"));\n'),
        ("b.py", "from mcp.client.streamable_http import streamablehttp_client\nfrom langchain_mcp_adapters.client import MultiServerMCPClient\nasync def go():\n    async with streamablehttp_client('https://mcp.acme.com/mcp', headers={'A': 'b'}) as (r, w, _):\n        pass\nservers = {'local': {'command': 'x'}, 'one': {'url': 'https://one.io/sse', 'transport': 'sse'}, 'two': {'url': 'https://two.io/mcp'}}\nclient = MultiServerMCPClient(servers)\n"),
    ],
)


@query(
    "det11_mcp_clients",
    golden(
        "path, line, client, method, url, headers",
        [
            ("a.ts", 4, "mcp:streamable-http", "POST", "https://mcp.acme.com/v1", ""),
            ("a.ts", 5, "mcp:sse", "POST", "{env:MCP_URL}/sse", ""),
            ("b.py", 4, "mcp:streamable-http", "POST", "https://mcp.acme.com/mcp", "a"),
            ("b.py", 7, "mcp:sse", "POST", "https://one.io/sse", ""),
            ("b.py", 7, "mcp:streamable-http", "POST", "https://two.io/mcp", ""),
        ],
    ),
)
def det11_mcp_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of MCP servers in scripts and Python: one call for each HTTP server."""
    files = MCP.df(spark)
    found = javascript.javascript_calls(files.filter("path like '%.ts'")).union(python.python_calls(files.filter("path like '%.py'")))
    return found.select("path", "line", "client", "method", "url", "headers")


GRAPHQL = Fixture(
    "graphql_files",
    "path string, body string",
    [
        ("r.ts", 'import { GraphQLClient, request, gql } from "graphql-request";\nconst API = "https://api.shop.io/graphql";\nconst Q = gql`query Q { a }`;\nconst client = new GraphQLClient(API, { headers: {} });\nexport const q = () => client.request(Q);\nrequest("https://b.io/graphql", Q);\nrequest({ url: `${API}/v2`, document: Q });\ncache.request(Q);\n'),
        ("a.ts", 'import { ApolloClient, HttpLink } from "@apollo/client";\nconst link = new HttpLink({ uri: process.env.GQL, headers: { Authorization: t } });\nconst apollo = new ApolloClient({ link, cache });\napollo.query({ query: Q });\nnew ApolloClient({ uri: "https://c.io/graphql" }).mutate({ mutation: M });\n'),
        ("u.ts", 'import { createClient } from "@urql/core";\nclass S {\n  c = createClient({ url: "https://u.io/graphql" });\n  go() { return this.c.query(Q, {}); }\n}\n'),
    ],
)


@query(
    "det09_graphql_clients",
    golden(
        "path, line, client, url, headers",
        [
            ("r.ts", 5, "graphql", "https://api.shop.io/graphql", ""), ("r.ts", 6, "graphql", "https://b.io/graphql", ""), ("r.ts", 7, "graphql", "https://api.shop.io/graphql/v2", ""),
            ("a.ts", 4, "graphql", "{env:GQL}", "authorization"), ("a.ts", 5, "graphql", "https://c.io/graphql", ""), ("u.ts", 4, "graphql", "https://u.io/graphql", ""),
        ],
    ),
)
def det09_graphql_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of GraphQL clients, at the endpoints that they were made with."""
    return javascript.javascript_calls(GRAPHQL.df(spark)).select("path", "line", "client", "url", "headers")
