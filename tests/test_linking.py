"""Names over any number of files: chains, nesting, circles."""

from __future__ import annotations

from callscope.operators import javascript


def linked(spark, files):
    d = spark.createDataFrame(sorted(files.items()), "path string, body string")
    return {(r.path, r.line): (r.client, r.method, r.url) for r in javascript.javascript_calls(d).collect()}


def test_chain_of_fifty_files(spark):
    files = {f"m{i}.ts": f'export {{ BASE, api }} from "./m{i + 1}";\n' for i in range(50)}
    files["m50.ts"] = 'import axios from "axios";\nexport const BASE = "https://deep.io";\nexport const api = axios.create({ baseURL: "https://api.io" });\n'
    files["a.ts"] = 'import { BASE, api } from "./m0";\nfetch(`${BASE}/x`);\napi.get("/y");\n'
    got = linked(spark, files)
    assert got["a.ts", 2][2] == "https://deep.io/x" and got["a.ts", 3] == ("axios", "GET", "https://api.io/y")


def test_texts_of_texts_and_circles_end(spark):
    files = {f"n{i}.ts": f'import {{ N{i + 1} }} from "./n{i + 1}";\nexport const N{i} = `${{N{i + 1}}}/{i}`;\n' for i in range(9)}
    files["n9.ts"] = 'export const N9 = "https://n.io";\n'
    files["p.ts"] = 'export { Q } from "./q";\n'
    files["q.ts"] = 'export { Q } from "./p";\n'
    files["r.ts"] = 'import { S } from "./s";\nexport const R = `${S}/r`;\n'
    files["s.ts"] = 'import { R } from "./r";\nexport const S = `${R}/s`;\n'
    files["b.ts"] = 'import { N0 } from "./n0";\nimport { Q } from "./p";\nimport { R } from "./r";\nimport { gone } from "./nowhere";\nfetch(N0);\nfetch(`${Q}/x/${N0}`);\nfetch(`https://${gone}/${R}`);\n'
    got = linked(spark, files)
    whole = "https://n.io/" + "/".join(str(i) for i in range(8, -1, -1))
    assert got["b.ts", 5][2] == whole
    assert got["b.ts", 6][2] == "{Q}/x/" + whole
    assert got["b.ts", 7][2].startswith("https://{gone}/{") and "import:" not in got["b.ts", 7][2]
