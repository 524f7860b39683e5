"""Source text to rows: Python by its parser, shell by its words, GraphQL by a small reader.

A front end is a function over Arrow batches, from (path, body) to rows; a file that cannot be read
gives a row that says why, never an error. Files are independent, so tasks need no shuffle.
"""

from __future__ import annotations

import ast
import json
import re
import shlex
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: HTTP client functions of Python packages: package, function, method (null: the first argument), place of the URL.
HTTP_CLIENTS = {
    ("requests", "get"): ("GET", 0), ("requests", "post"): ("POST", 0), ("requests", "put"): ("PUT", 0), ("requests", "patch"): ("PATCH", 0),
    ("requests", "delete"): ("DELETE", 0), ("requests", "head"): ("HEAD", 0), ("requests", "options"): ("OPTIONS", 0), ("requests", "request"): (None, 1),
    ("httpx", "get"): ("GET", 0), ("httpx", "post"): ("POST", 0), ("httpx", "put"): ("PUT", 0), ("httpx", "delete"): ("DELETE", 0), ("httpx", "request"): (None, 1),
    ("urllib.request", "urlopen"): ("GET", 0),
}
#: Names are followed through this many others.
DEPTH = 10


def scan_files(files: DataFrame, reader: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``reader(path, body)`` makes of each file, ``path`` before them. Null bodies give none."""
    names = ["path", *[c.strip().split()[0] for c in schema.split(",")]]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [pa.string(), *[kinds[c.strip().split()[1]] for c in schema.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *r) for p, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) if b is not None for r in reader(p, b)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select("path", "body").mapInArrow(run, f"path string, {schema}")


class _Module:
    """Names of a Python file: what imports and plain assignments say of them."""

    def __init__(self, tree: ast.Module):
        self.imports: dict[str, str] = {}
        self.values: dict[tuple[str | None, str], list[tuple[int, ast.expr]]] = {}
        self._walk(tree, None)

    def _walk(self, node: ast.AST, scope: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                for a in child.names:
                    self.imports[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif isinstance(child, ast.ImportFrom) and child.module and not child.level:
                for a in child.names:
                    self.imports[a.asname or a.name] = f"{child.module}.{a.name}"
            elif isinstance(child, ast.Assign) and len(child.targets) == 1 and isinstance(child.targets[0], ast.Name):
                self.values.setdefault((scope, child.targets[0].id), []).append((child.lineno, child.value))
            inner = child.name if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef) else scope
            self._walk(child, inner)

    def dotted(self, node: ast.expr) -> str | None:
        """Full name of a chain of attributes whose root is imported."""
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name) or node.id not in self.imports:
            return None
        return ".".join([self.imports[node.id], *reversed(parts)])

    def template(self, node: ast.expr, scope: str | None, line: int, depth: int = 0) -> str:
        """Text of an expression, with ``{name}`` and ``{env:NAME}`` for what is not written out."""
        again = lambda n: self.template(n, scope, line, depth + 1)
        if depth > DEPTH:
            return "{unknown}"
        if isinstance(node, ast.Constant):
            return str(node.value)
        if isinstance(node, ast.JoinedStr):
            return "".join(again(v.value) if isinstance(v, ast.FormattedValue) else again(v) for v in node.values)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return again(node.left) + again(node.right)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod) and isinstance(node.left, ast.Constant):
            values = iter(node.right.elts if isinstance(node.right, ast.Tuple) else [node.right])
            return re.sub(r"%[sdr]", lambda m: again(v) if (v := next(values, None)) is not None else m[0], str(node.left.value))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format" and isinstance(node.func.value, ast.Constant):
            values, named = iter(node.args), {k.arg: k.value for k in node.keywords}
            fill = lambda m: again(v) if (v := named.get(m[1]) if m[1] else next(values, None)) is not None else m[0]
            return re.sub(r"\{(\w*)\}", fill, str(node.func.value.value))
        env = self._env(node)
        if env:
            return f"{{env:{env}}}"
        if isinstance(node, ast.BoolOp):
            return again(node.values[0])
        if isinstance(node, ast.IfExp):
            a, b = again(node.body), again(node.orelse)
            return a if "{" not in a or "{" in b else b
        if isinstance(node, ast.Name):
            for where in dict.fromkeys((scope, None)):
                found = self.values.get((where, node.id), [])
                if found:
                    # The last assignment before the use, else the first.
                    before = [v for at, v in found if at < line]
                    return again(before[-1] if before else found[0][1])
            return f"{{{node.id}}}"
        if isinstance(node, ast.Attribute):
            return f"{{{node.attr}}}"
        if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant):
            return f"{{{node.slice.value}}}"
        return "{unknown}"

    def _env(self, node: ast.expr) -> str | None:
        if isinstance(node, ast.Call) and self.dotted(node.func) in ("os.getenv", "os.environ.get") and node.args and isinstance(node.args[0], ast.Constant):
            return str(node.args[0].value)
        if isinstance(node, ast.Subscript) and self.dotted(node.value) == "os.environ" and isinstance(node.slice, ast.Constant):
            return str(node.slice.value)
        return None


def python_calls(path: str, body: str) -> list[tuple]:
    """(line, client, method, url, headers, body_keys, problem) of the HTTP calls in a Python file."""
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(getattr(e, "lineno", None) or 0, None, None, None, None, None, "syntax-error")]
    module, out = _Module(tree), []

    def visit(node: ast.AST, scope: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = child.name if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef) else scope
            if isinstance(child, ast.Call) and (name := module.dotted(child.func)):
                package, _, function = name.rpartition(".")
                if (package, function) in HTTP_CLIENTS:
                    method, place = HTTP_CLIENTS[package, function]
                    named = {k.arg: k.value for k in child.keywords if k.arg}
                    url = named.get("url") or (child.args[place] if len(child.args) > place else None)
                    said = named.get("method") or (child.args[0] if child.args else None)
                    if method is None:
                        text = module.template(said, scope, child.lineno) if said is not None else "{method}"
                        method = "DYNAMIC" if "{" in text else text.upper()
                    keys = lambda n: ",".join(str(k.value).lower() if n == "headers" else str(k.value) for k in named[n].keys if isinstance(k, ast.Constant)) if isinstance(named.get(n), ast.Dict) else ""
                    out.append((child.lineno, package, method, module.template(url, scope, child.lineno) if url is not None else "{url}", keys("headers"), keys("json") or keys("data"), None))
            visit(child, inner)

    visit(tree, None)
    return sorted(out, key=lambda r: (r[0], r[3]))


def shell_calls(path: str, body: str) -> list[tuple]:
    """(line, client, method, url, headers, body_keys, problem) of curl and wget commands in a shell script, the first five URLs of each."""
    out = []
    lines = body.split("\n")
    i = 0
    while i < len(lines):
        start, text = i + 1, lines[i]
        while text.endswith("\\") and i + 1 < len(lines):
            i += 1
            text = text[:-1] + " " + lines[i]
        i += 1
        try:
            words = shlex.split(re.sub(r"\$\{?(\w+)\}?", r"{env:\1}", text), comments=True)
        except ValueError:
            continue
        for k, word in enumerate(words):
            if word in ("curl", "wget"):
                out += [(start, word, *r, None) for r in _command(word, words[k + 1 :])]
                break
    return out


#: Options of curl and wget that take a value and matter not.
_WITH_VALUE = {"-o", "--output", "-u", "--user", "-A", "--user-agent", "-e", "-m", "--max-time", "--connect-timeout", "--retry", "-w", "--write-out", "-b", "--cookie", "-c", "-x", "--proxy", "-O-", "--output-document", "-t", "-T"}


def _command(client: str, words: list[str]) -> list[tuple]:
    urls, headers, data, method, get, head = [], [], [], None, False, False
    i = 0
    while i < len(words):
        w = words[i]
        name, eq, inline = w.partition("=")
        value = inline if eq and w.startswith("--") else words[i + 1] if i + 1 < len(words) else ""
        step = 1 if eq and w.startswith("--") else 2
        if w in ("|", "||", "&&", ";", ">", "2>"):
            break
        if name in ("-X", "--request", "--method"):
            method, i = value.upper(), i + step
        elif re.match(r"-X[A-Z]+\Z", w):
            method, i = w[2:], i + 1
        elif name in ("-H", "--header"):
            headers.append(value.partition(":")[0].strip().lower())
            i += step
        elif name in ("-d", "--data", "--data-raw", "--data-binary", "--data-urlencode", "-F", "--form", "--json", "--post-data", "--body-data"):
            data.append(value)
            i += step
        elif name == "--url":
            urls.append(value)
            i += step
        elif w in ("-G", "--get"):
            get, i = True, i + 1
        elif w in ("-I", "--head", "--spider"):
            head, i = True, i + 1
        elif name in _WITH_VALUE:
            i += step
        elif w.startswith("-"):
            i += 1
        else:
            urls.append(w)
            i += 1
    keys = []
    for d in data:
        try:
            value = json.loads(d)
            keys += list(value) if isinstance(value, dict) else []
        except ValueError:
            keys += [p.partition("=")[0] for p in d.split("&") if "=" in p]
    if method is None:
        method = "HEAD" if head else "GET" if get or not data else "POST"
    urls = [u if re.match(r"(?i)[a-z]+://|\{", u) else f"http://{u}" for u in urls[:5]]
    return [(method, u + ("?" + "&".join(data) if get and data else ""), ",".join(dict.fromkeys(headers)), "" if get else ",".join(dict.fromkeys(keys))) for u in urls]


def httpie_calls(path: str, body: str) -> list[tuple]:
    """(line, client, method, url, headers, body_keys, problem) of HTTPie commands: items tell by their separator what they are."""
    out = []
    for number, text in enumerate(body.split("\n"), 1):
        try:
            words = shlex.split(re.sub(r"\$\{?(\w+)\}?", r"{env:\1}", text), comments=True)
        except ValueError:
            continue
        at = next((i for i, w in enumerate(words) if w in ("http", "https", "xh")), None)
        if at is None:
            continue
        scheme, form, given = "https" if words[at] == "https" else "http", False, []
        for w in words[at + 1 :]:
            if w in ("|", ">", "&&", "||", ";"):
                break
            form = form or w in ("-f", "--form", "--multipart")
            if not w.startswith("-"):
                given.append(w)
        method = given.pop(0).upper() if given and re.fullmatch(r"[A-Za-z]+", given[0]) and len(given) > 1 else None
        if not given:
            continue
        url = given.pop(0)
        url = f"{scheme}://localhost{url}" if re.match(r":\d", url) else url if re.match(r"(?i)[a-z]+://|\{", url) else f"{scheme}://{url}"
        query, headers, keys = [], [], []
        for item in given:
            if m := re.match(r"([^=:@]+)==(.*)", item):
                query.append(f"{m[1]}={m[2]}")
            elif m := re.match(r"([^=:@]+)(?::=|=|@)", item):
                keys.append(m[1])
            elif m := re.match(r"([^=:@]+):", item):
                headers.append(m[1].lower())
        url += ("&" if "?" in url else "?") + "&".join(query) if query else ""
        out.append((number, "httpie", method or ("POST" if keys else "GET"), url, ",".join(headers), ",".join(keys), None))
    return out


_GRAPHQL = re.compile(r'#[^\n]*|"""(?s:.*?)"""|"(?:\\.|[^"\\\n])*"|\.\.\.|[A-Za-z_]\w*|-?\d+(?:\.\d+)?|[{}()\[\]:!=|@$&,]')
#: Bounds of a document: characters, tokens, operations.
GRAPHQL_CHARS, GRAPHQL_TOKENS, GRAPHQL_OPERATIONS = 100_000, 50_000, 50


def graphql_operations(path: str, body: str) -> list[tuple]:
    """(type, name, fields, problem) of the operations of a GraphQL document.

    ``fields``: sorted leaf paths, aliases resolved, fragments inlined. An operation without a name
    is named by its sorted root fields; more operations than the bound are one without a name.
    """
    if len(body) > GRAPHQL_CHARS:
        return [(None, None, None, "graphql-limit")]
    tokens = [t for t in _GRAPHQL.findall(body) if not t.startswith("#") and t != ","]
    if len(tokens) > GRAPHQL_TOKENS:
        return [(None, None, None, "graphql-limit")]
    at = 0
    fragments: dict[str, list] = {}
    operations: list[tuple[str, str | None, list]] = []

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ""

    def skip(open_: str, close: str) -> None:
        depth = 0
        while at < len(tokens):
            t = take()
            depth += (t == open_) - (t == close)
            if not depth:
                return
        raise ValueError("unclosed")

    def directives() -> None:
        while peek() == "@":
            take()
            take()
            if peek() == "(":
                skip("(", ")")

    def selection() -> list:
        if take() != "{":
            raise ValueError("selection")
        out: list = []
        while peek() != "}":
            if at >= len(tokens):
                raise ValueError("unclosed")
            if peek() == "...":
                take()
                if peek() == "on":
                    take()
                    take()
                    directives()
                    out += selection()
                elif peek() in ("{", "@"):
                    directives()
                    out += selection()
                else:
                    out.append(("...", take()))
                    directives()
                continue
            name = take()
            if peek() == ":":
                take()
                name = take()
            if peek() == "(":
                skip("(", ")")
            directives()
            out.append((name, selection() if peek() == "{" else None))
        take()
        return out

    def leaves(fields: list, before: str, seen: tuple[str, ...]) -> set[str]:
        out: set[str] = set()
        for name, inner in fields:
            if name == "...":
                if inner in fragments and inner not in seen:
                    out |= leaves(fragments[inner], before, (*seen, inner))
            elif inner is None:
                out.add(before + name)
            else:
                out |= leaves(inner, f"{before}{name}.", seen)
        return out

    def roots(fields: list, seen: tuple[str, ...]) -> set[str]:
        return {r for name, inner in fields for r in ((roots(fragments[inner], (*seen, inner)) if inner in fragments and inner not in seen else set()) if name == "..." else {name})}

    try:
        while at < len(tokens):
            word = peek()
            if word == "{":
                operations.append(("query", None, selection()))
            elif word in ("query", "mutation", "subscription"):
                take()
                name = take() if peek() not in ("{", "(", "@") else None
                if peek() == "(":
                    skip("(", ")")
                directives()
                operations.append((word, name, selection()))
            elif word == "fragment":
                take()
                name = take()
                take()
                take()
                directives()
                fragments[name] = selection()
            else:
                raise ValueError(word)
    except (ValueError, RecursionError):
        return [(None, None, None, "not-graphql")]
    if len(operations) > GRAPHQL_OPERATIONS:
        return [(None, None, None, "graphql-limit")]
    return [(kind, name or ",".join(sorted(roots(fields, ()))), ",".join(sorted(leaves(fields, "", ()))), None) for kind, name, fields in operations]


_CELL_MAGIC = re.compile(r"^\s*[%!]")


def notebook_source(path: str, body: str) -> list[tuple]:
    """(cell, text, problem): the code cells of a notebook, magics and shell lines blanked so that lines hold."""
    try:
        cells = json.loads(body)["cells"]
        out = []
        for i, cell in enumerate(cells):
            if cell.get("cell_type") == "code":
                text = cell.get("source", "")
                text = "".join(text) if isinstance(text, list) else str(text)
                out.append((i, "\n".join("" if _CELL_MAGIC.match(x) else x for x in text.split("\n")), None))
        return out
    except (ValueError, KeyError, TypeError, AttributeError):
        return [(None, None, "not-a-notebook")]
