"""Python files to call rows, beyond one file: sessions and clients, class members, settings, imports."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import fixed
from callscope.operators import linking
from callscope.operators.frontend import DEPTH, HTTP_CLIENTS, _Module, scan_files

_VERBS = {"get", "post", "put", "patch", "delete", "head", "options"}
#: Constructors of clients: the client, and where the base URL is given: a keyword, and a place or none.
_INSTANCES = {
    "requests.Session": ("requests", None, None), "requests.session": ("requests", None, None), "requests.sessions.Session": ("requests", None, None),
    "httpx.Client": ("httpx", "base_url", None), "httpx.AsyncClient": ("httpx", "base_url", None),
    "aiohttp.ClientSession": ("aiohttp", "base_url", 0), "aiohttp.client.ClientSession": ("aiohttp", "base_url", 0),
    "urllib3.PoolManager": ("urllib3", None, None),
}
_SETTINGS = {"BaseSettings", "pydantic_settings.BaseSettings", "pydantic.BaseSettings"}


class _File(_Module):
    """A module's names with its classes, functions and what it takes from other files of the project."""

    def __init__(self, tree: ast.Module):
        self.others: dict[str, tuple[str, str]] = {}
        self.functions: dict[str, ast.AST] = {}
        self.classes: dict[str, ast.ClassDef] = {}
        self.fields: dict[str, dict[str, tuple[ast.expr, str | None, int]]] = {}
        self.inside: dict[int, str] = {}  # class of each function, by its line
        super().__init__(tree)
        self._members(tree)

    def _walk(self, node: ast.AST, scope: str | None) -> None:
        if isinstance(node, ast.ClassDef):  # names of a class body are no module's
            scope = f"class {node.name}"
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ImportFrom):
                module = "/".join((child.module or "").split(".")) if child.module else ""
                for a in child.names:
                    if child.level:
                        up = "./" if child.level == 1 else "../" * (child.level - 1)
                        self.others[a.asname or a.name] = (up + module, a.name) if module else (up + a.name, "*")
                    elif child.module:
                        self.others.setdefault(a.asname or a.name, (module, a.name))
            elif isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name) and child.value is not None:
                self.values.setdefault((scope, child.target.id), []).append((child.lineno, child.value))
            elif isinstance(child, ast.With | ast.AsyncWith):
                for item in child.items:
                    if isinstance(item.optional_vars, ast.Name):
                        self.values.setdefault((scope, item.optional_vars.id), []).append((child.lineno, item.context_expr))
        super()._walk(node, scope)

    def _members(self, tree: ast.Module) -> None:
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                self.functions.setdefault(node.name, node)
                for arg, default in zip(reversed(node.args.args), reversed(node.args.defaults)):  # noqa: B905
                    self.values.setdefault((node.name, arg.arg), []).append((node.lineno, default))
            if isinstance(node, ast.ClassDef):
                self.classes[node.name] = node
                own = self.fields.setdefault(node.name, {})
                for inner in ast.walk(node):
                    if isinstance(inner, ast.FunctionDef | ast.AsyncFunctionDef):
                        self.inside[inner.lineno] = node.name
                        for child in ast.walk(inner):
                            target = child.targets[0] if isinstance(child, ast.Assign) else child.target if isinstance(child, ast.AnnAssign) else None
                            if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and child.value is not None:
                                own.setdefault(target.attr, (child.value, inner.name, child.lineno))
                for child in node.body:
                    name = child.targets[0] if isinstance(child, ast.Assign) else child.target if isinstance(child, ast.AnnAssign) else None
                    if isinstance(name, ast.Name) and child.value is not None:
                        own.setdefault(name.id, (child.value, None, child.lineno))
                    elif isinstance(name, ast.Name) and self.is_settings(node):
                        own.setdefault(name.id, (ast.Constant(f"{{env:{name.id.upper()}}}"), None, child.lineno))

    def is_settings(self, node: ast.ClassDef) -> bool:
        """A class whose fields are read from the environment."""
        return any((self.dotted(b) or getattr(b, "id", "")) in _SETTINGS for b in node.bases)

    def field(self, cls: str | None, name: str, depth: int = 0) -> tuple[ast.expr, str | None, int] | None:
        """A member of a class or of the first base in this file that has it."""
        if cls not in self.fields or depth > DEPTH:
            return None
        if name in self.fields[cls]:
            return self.fields[cls][name]
        return next((f for b in self.classes[cls].bases if isinstance(b, ast.Name) and (f := self.field(b.id, name, depth + 1))), None)

    def class_of(self, node: ast.expr, scope: str | None, line: int, cls: str | None) -> str | None:
        """The class of this file that an expression is an instance of."""
        if isinstance(node, ast.Name):
            if node.id == "self":
                return cls
            found = self.assigned(node.id, scope, line)
            return self.class_of(found, scope, line, cls) if found is not None and found is not node else node.id if node.id in self.classes else None
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in self.classes:
            return node.func.id
        return None

    def assigned(self, name: str, scope: str | None, line: int) -> ast.expr | None:
        for where in dict.fromkeys((scope, None)):
            found = self.values.get((where, name), [])
            if found:
                before = [v for at, v in found if at < line] or [v for at, v in found if at == line]
                return before[-1] if before else found[0][1]
        return None

    def text(self, node: ast.expr, scope: str | None, line: int, cls: str | None, depth: int = 0) -> str:
        """As :meth:`template`, with members of ``self`` and of instances, and names of other files."""
        self._cls, self._scope_line = cls, (scope, line)
        return self.template(node, scope, line, depth)

    def template(self, node: ast.expr, scope: str | None, line: int, depth: int = 0) -> str:
        cls = getattr(self, "_cls", None)
        if isinstance(node, ast.Name) and depth <= DEPTH and node.id in self.others and self.assigned(node.id, scope, line) is None:
            module, name = self.others[node.id]
            return f"{{import:{module}#{name}}}"
        if isinstance(node, ast.Attribute) and depth <= DEPTH and not self._env(node):
            owner = self.class_of(node.value, scope, line, cls)
            if owner and (found := self.field(owner, node.attr)):
                return self.template(found[0], found[1], found[2], depth + 1)
            if isinstance(node.value, ast.Name) and node.value.id in self.others and self.assigned(node.value.id, scope, line) is None:
                module, name = self.others[node.value.id]
                return f"{{import:{module}#{node.attr}}}" if name == "*" else f"{{import:{module}#{name}.{node.attr}}}"
        if isinstance(node, ast.Call) and depth <= DEPTH:
            if isinstance(node.func, ast.Attribute) and node.func.attr in ("rstrip", "strip", "lstrip", "lower") and not self._env(node):
                inner = self.template(node.func.value, scope, line, depth + 1)
                cut = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) else None
                return inner.rstrip(cut) if node.func.attr == "rstrip" else inner
            if self.dotted(node.func) in ("urllib.parse.urljoin", "os.path.join") and len(node.args) == 2:
                return join(*(self.template(a, scope, line, depth + 1) for a in node.args))
            if isinstance(node.func, ast.Name) and node.func.id in ("str", "quote", "quote_plus") and node.args:
                return self.template(node.args[0], scope, line, depth + 1)
            if isinstance(node.func, ast.Attribute) and node.func.attr == "join" and isinstance(node.func.value, ast.Constant) and node.args and isinstance(node.args[0], ast.List | ast.Tuple):
                return str(node.func.value.value).join(self.template(x, scope, line, depth + 1) for x in node.args[0].elts)
            if isinstance(node.func, ast.Name) and (fn := self.functions.get(node.func.id)) is not None and (given := returned(fn)) is not None:
                return self.template(given, fn.name, given.lineno, depth + 1)
        return super().template(node, scope, line, depth)

    def client(self, node: ast.expr, scope: str | None, line: int, cls: str | None, depth: int = 0) -> tuple[str, str] | None:
        """(client, base URL) of an expression that is a client's instance."""
        if depth > DEPTH:
            return None
        if isinstance(node, ast.Await):
            return self.client(node.value, scope, line, cls, depth + 1)
        if isinstance(node, ast.Call):
            made = _INSTANCES.get(self.dotted(node.func) or self.full(node.func) or "")
            if made:
                named = {k.arg: k.value for k in node.keywords}
                base = named.get(made[1]) if made[1] else None
                base = base if base is not None else node.args[made[2]] if made[2] is not None and len(node.args) > made[2] else None
                return made[0], self.text(base, scope, line, cls) if base is not None else ""
            if isinstance(node.func, ast.Name) and (fn := self.functions.get(node.func.id)) is not None and (given := returned(fn)) is not None:
                return self.client(given, fn.name, given.lineno, cls, depth + 1)
            if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id == "self" and (fn := self.functions.get(node.func.attr)) is not None and (given := returned(fn)) is not None:
                return self.client(given, fn.name, given.lineno, cls, depth + 1)
            return None
        if isinstance(node, ast.Name):
            found = self.assigned(node.id, scope, line)
            if found is not None and found is not node:
                return self.client(found, scope, line, cls, depth + 1)
            if node.id in self.others and node.id not in self.functions:
                return f"import:{self.others[node.id][0]}#{self.others[node.id][1]}", ""
            typed = self.annotation(node.id, scope)
            return (_INSTANCES[typed][0], "") if typed in _INSTANCES else None
        if isinstance(node, ast.Attribute):
            owner = self.class_of(node.value, scope, line, cls)
            if owner and (found := self.field(owner, node.attr)):
                return self.client(found[0], found[1], found[2], owner, depth + 1)
            if isinstance(node.value, ast.Name) and node.value.id in self.others:
                module, name = self.others[node.value.id]
                return f"import:{module}#{node.attr if name == '*' else name + '.' + node.attr}", ""
        return None

    def sdk(self, node: ast.expr, scope: str | None, line: int, cls: str | None, depth: int = 0) -> tuple[str, list[str] | None] | None:
        """(dotted import, names behind the client made of it, or None where nothing was made) of a chain."""
        if depth > DEPTH:
            return None
        if isinstance(node, ast.Await):
            return self.sdk(node.value, scope, line, cls, depth + 1)
        if isinstance(node, ast.Attribute):
            owner = self.class_of(node.value, scope, line, cls)
            if owner and (found := self.field(owner, node.attr)):
                return self.sdk(found[0], found[1], found[2], owner, depth + 1)
            of = self.sdk(node.value, scope, line, cls, depth + 1)
            if of is None:
                return None
            return (f"{of[0]}.{node.attr}", None) if of[1] is None else (of[0], [*of[1], node.attr])
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name) and (fn := self.functions.get(node.func.id)) is not None:
                given = returned(fn)
                return self.sdk(given, fn.name, given.lineno, cls, depth + 1) if given is not None else None
            of = self.sdk(node.func, scope, line, cls, depth + 1)
            return (of[0], []) if of and of[1] is None else of
        if isinstance(node, ast.Name):
            found = self.assigned(node.id, scope, line)
            if found is not None and found is not node:
                return self.sdk(found, scope, line, cls, depth + 1)
            if (name := self.dotted(node) or self.full(node)) and not name.startswith("."):
                return name, None
            typed = self.annotation(node.id, scope)
            return (typed, []) if typed else None
        return None

    def full(self, node: ast.expr) -> str | None:
        """The dotted name of something imported by ``from package import name``."""
        if isinstance(node, ast.Name) and node.id in self.others:
            module, name = self.others[node.id]
            return f"{module.replace('/', '.')}.{name}"
        return None

    def annotation(self, name: str, scope: str | None) -> str | None:
        fn = self.functions.get(scope or "")
        if fn is None:
            return None
        arg = next((a for a in [*fn.args.args, *fn.args.kwonlyargs] if a.arg == name), None)
        return (self.dotted(arg.annotation) or self.full(arg.annotation)) if arg is not None and arg.annotation is not None else None


def returned(fn: ast.AST) -> ast.expr | None:
    """What a function's last return gives."""
    found = [n for n in ast.walk(fn) if isinstance(n, ast.Return) and n.value is not None]
    return max(found, key=lambda n: n.lineno).value if found else None


def join(base: str, url: str) -> str:
    if not base or re.match(r"(?i)[a-z][a-z0-9+.-]*://", url):
        return url
    return base.rstrip("/") + "/" + url.lstrip("/") if url else base


def _keys(f: _File, node: ast.expr | None, scope: str | None, line: int, headers: bool = False, depth: int = 0) -> str:
    """Keys of a dictionary, written out, assigned, made by ``dict`` or dumped."""
    if node is None or depth > DEPTH:
        return ""
    if isinstance(node, ast.Dict):
        return ",".join(str(k.value).lower() if headers else str(k.value) for k in node.keys if isinstance(k, ast.Constant))
    if isinstance(node, ast.Call):
        if isinstance(node.func, ast.Name) and node.func.id == "dict":
            return ",".join(k.arg.lower() if headers else k.arg for k in node.keywords if k.arg)
        if f.dotted(node.func) in ("json.dumps", "urllib.parse.urlencode") and node.args:
            return _keys(f, node.args[0], scope, line, headers, depth + 1)
        if isinstance(node.func, ast.Attribute) and node.func.attr == "encode":
            return _keys(f, node.func.value, scope, line, headers, depth + 1)
    if isinstance(node, ast.Name) and (found := f.assigned(node.id, scope, line)) is not None and found is not node:
        return _keys(f, found, scope, line, headers, depth + 1)
    return ""


def _request(f: _File, call: ast.Call, scope: str | None, cls: str | None) -> tuple | None:
    line = call.lineno
    named = {k.arg: k.value for k in call.keywords if k.arg}
    arg = lambda k: call.args[k] if len(call.args) > k else None
    say = lambda node: f.text(node, scope, line, cls)
    name = f.dotted(call.func) or f.full(call.func)
    client, base, verb = None, "", None
    if name and name.startswith("mcp.client.") and (kind := fixed.MCP_CONSTRUCTORS.get(name.rpartition(".")[2])):
        url = named.get("url") or arg(0)
        return (f"mcp:{kind}", "POST", say(url), _keys(f, named.get("headers"), scope, line, True), "") if url is not None else None
    if name:
        package, _, function = name.rpartition(".")
        if name == "urllib.request.urlopen" or name == "urllib.request.Request":
            inner = arg(0)
            if name.endswith("urlopen") and isinstance(inner, ast.Name):
                inner = f.assigned(inner.id, scope, line) or inner
            if isinstance(inner, ast.Call) and (f.dotted(inner.func) or f.full(inner.func)) == "urllib.request.Request":
                return _request(f, inner, scope, cls)
            if name.endswith("Request") and not named.get("url") and arg(0) is None:
                return None
            data = named.get("data") or arg(1)
            method = say(named["method"]).upper() if "method" in named else "POST" if data is not None else "GET"
            return "urllib.request", method, say(named.get("url") or arg(0)), _keys(f, named.get("headers"), scope, line, True), _keys(f, data, scope, line)
        if (package, function) in HTTP_CLIENTS:
            client, verb = package, function
        elif package in ("httpx", "requests") and function in ("stream", *_VERBS):
            client, verb = package, "request" if function == "stream" else function
        elif name == "aiohttp.request":
            client, verb = "aiohttp", "request"
    if client is None and isinstance(call.func, ast.Attribute) and call.func.attr in _VERBS | {"request", "stream", "urlopen"}:
        of = f.client(call.func.value, scope, line, cls)
        if of:
            (client, base), verb = of, "request" if call.func.attr in ("stream", "urlopen") else call.func.attr
    if client is None:
        return None
    place = 1 if verb == "request" else 0
    url = named.get("url") or arg(place)
    if verb == "request":
        said = named.get("method") or arg(0)
        method = say(said).upper() if said is not None else "GET"
        method = "DYNAMIC" if "{" in method else method
    else:
        method = verb.upper()
    body = next((named[k] for k in ("json", "data", "body", "fields") if k in named), arg(1) if verb in ("post", "put", "patch") else None)
    return client, method, join(base, say(url)) if url is not None else "{url}", _keys(f, named.get("headers"), scope, line, True), _keys(f, body, scope, line)


def _mcp_servers(f: _File, call: ast.Call, scope: str | None, cls: str | None) -> list[tuple]:
    """One call for each HTTP server that a client of several MCP servers is given; commands are none."""
    name = f.dotted(call.func) or f.full(call.func) or ""
    given = call.args[0] if call.args else next((k.value for k in call.keywords if k.arg == "connections"), None)
    if name.rpartition(".")[2] != "MultiServerMCPClient" or given is None:
        return []
    if isinstance(given, ast.Name):
        given = f.assigned(given.id, scope, call.lineno)
    out = []
    for server in given.values if isinstance(given, ast.Dict) else []:
        parts = {k.value: v for k, v in zip(server.keys, server.values, strict=True) if isinstance(k, ast.Constant)} if isinstance(server, ast.Dict) else {}
        if "url" in parts:
            url = f.text(parts["url"], scope, call.lineno, cls)
            said = f.text(parts["transport"], scope, call.lineno, cls) if "transport" in parts else ""
            out.append((f"mcp:{fixed.MCP_TRANSPORTS.get(said, 'sse' if re.search(r'/sse(?:/|$)', url) else 'streamable-http')}", "POST", url, _keys(f, parts.get("headers"), scope, call.lineno, True), ""))
    return out


def python_rows(path: str, body: str) -> list[tuple]:
    """(kind, line, name, method, url, headers, body_keys): ``call`` and ``export`` rows as of script files; a file that does not parse gives a ``problem``.

    ``sdk`` rows have the dotted import as name, and as url the names behind the client that it makes;
    ``method`` says whether it makes one or is a function itself.
    """
    try:
        tree = ast.parse(body)
        f = _File(tree)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [("problem", getattr(e, "lineno", None) or 0, "syntax-error", None, None, None, None)]
    out: list[tuple] = []
    done: set[int] = set()

    def visit(node: ast.AST, scope: str | None, cls: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner, owner = scope, cls
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                inner = child.name
            elif isinstance(child, ast.ClassDef):
                owner = child.name
            if isinstance(child, ast.Call) and id(child) not in done:
                found = _request(f, child, inner, owner)
                out.extend(("call", child.lineno, *r) for r in _mcp_servers(f, child, inner, owner))
                used = None if found else f.sdk(child.func, inner, child.lineno, owner)
                if used and (used[1] or used[1] is None and "." in used[0]):
                    out.append(("sdk", child.lineno, used[0], "function" if used[1] is None else "client", ".".join(used[1] or []), None, None))
                if found:
                    out.append(("call", child.lineno, *found))
                    done.update(id(x) for x in ast.walk(child) if isinstance(x, ast.Call) and (f.dotted(x.func) or f.full(x.func)) == "urllib.request.Request")
                    if found[0] == "urllib.request" and child.args and isinstance(child.args[0], ast.Name):
                        made = f.assigned(child.args[0].id, inner, child.lineno)
                        if made is not None and id(made) in opened:
                            out.remove(opened[id(made)])
                    elif found[0] == "urllib.request":
                        opened[id(child)] = out[-1]
            visit(child, inner, owner)

    opened: dict[int, tuple] = {}
    try:
        visit(tree, None, None)
        for (scope, name), found in f.values.items():
            if scope is None:
                out += _exports(f, name, found[-1][1], found[-1][0])
        for cls, fields in f.fields.items():
            for name, (value, scope, line) in fields.items():
                if scope is None:
                    out += _exports(f, f"{cls}.{name}", value, line)
    except RecursionError:
        return [("problem", 0, "too-deep", None, None, None, None)]
    for name, (module, other) in f.others.items():
        if path.endswith("__init__.py") and module.startswith("."):
            out.append(("export", 0, name, "again", f"{{import:{module}#{other}}}", None, None))
    return sorted(out, key=lambda r: (r[0], r[1] or 0, str(r[2]), str(r[4])))


def _exports(f: _File, name: str, value: ast.expr, line: int) -> list[tuple]:
    of = f.client(value, None, line + 1, None)
    if of and not of[0].startswith("import:"):
        return [("export", 0, name, "client", of[1], of[0], None)]
    out = []
    if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id in f.fields:  # an instance: its fields under its name
        out = [r for k, (v, s, at) in f.fields[value.func.id].items() if s is None for r in _exports(f, f"{name}.{k}", v, at)]
    text = f.text(value, None, line + 1, None)
    return out if text in ("{unknown}", f"{{{name}}}") or isinstance(value, ast.Call) and out else [*out, ("export", 0, name, "text", text, None, None)]


def python_calls(files: DataFrame) -> DataFrame:
    """(path, line, client, method, url, headers, body_keys) of the requests in Python files, over file borders. ``files``: (path, body)."""
    rows = scan_files(files, python_rows, "kind string, line long, name string, method string, url string, headers string, body_keys string")
    return linking.link(rows, {})


def sdk_calls(files: DataFrame) -> DataFrame:
    """(call, path, line, root, ctor, key): calls on what Python files import, once for each import root that a registry may list. ``files``: (path, body)."""
    rows = scan_files(files, python_rows, "kind string, line long, name string, method string, url string, headers string, body_keys string").filter("kind = 'sdk'")
    names = F.split("name", r"\.")
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(names, F.lit(1), i), ".").alias("root"), F.array_join(F.slice(names, i + 1, F.size(names)), ".").alias("rest")))
    each = rows.select(F.concat_ws(":", "path", "line", "name", "url").alias("call"), "path", "line", "method", "url", F.explode(cuts).alias("c"))
    made = F.col("method") == "client"
    return each.select("call", "path", "line", "c.root", F.when(made, F.col("c.rest")).otherwise("").alias("ctor"), F.when(made, F.col("url")).otherwise(F.col("c.rest")).alias("key")).filter("key <> ''")
