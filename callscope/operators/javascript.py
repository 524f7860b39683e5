"""JavaScript and TypeScript to call rows: a reader of tokens and expressions, then joins between files.

There is no type checker here, so names are followed as they are written: constants, objects, enums,
parameters' defaults, client instances and what factory functions return. What another file exports
is left open as ``{import:module#name}`` and filled in by a join on the resolved path, so files are
read independently and linked as tables.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import fixed
from callscope.operators import linking
from callscope.operators.frontend import scan_files

#: Names are followed through this many others.
DEPTH = 10
_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<num>0[xXbBoO][\w]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?n?)|(?P<name>[A-Za-z_$\u0080-￿#][\w$\u0080-￿]*)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<op>=>|\?\?=|\.\.\.|\?\.(?!\d)|\?\?|&&=|\|\|=|&&|\|\||===|!==|==|!=|<=|>=|\+\+|--|[+\-*/%&|^]=|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_VERBS = {"get", "post", "put", "patch", "delete", "head", "options"}
#: Packages whose default export sends requests: the client it is, and the option that holds an instance's base.
_CLIENTS = {"axios": ("axios", "baseURL"), "got": ("got", "prefixUrl"), "ky": ("ky", "prefixUrl"), "ky-universal": ("ky", "prefixUrl"), "node-fetch": ("fetch", None), "cross-fetch": ("fetch", None), "isomorphic-fetch": ("fetch", None), "ofetch": ("fetch", None), "undici": ("fetch", None)}
_NODE = {"http": "http", "https": "https", "node:http": "http", "node:https": "https"}
_OPENERS, _CLOSERS = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class _Tokens:
    """Tokens (kind, text, offset) of a file, templates as one token of parts; and where each one's block begins."""

    def __init__(self, body: str):
        self.items: list[tuple[str, object, int]] = []
        self._read(body, 0, None)
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self.scope: list[int] = []
        self.parents: dict[int, int] = {-1: -1}
        stack: list[int] = []
        blocks = [-1]
        for i, (kind, text, _) in enumerate(self.items):
            if kind == "op" and text in _OPENERS:
                stack.append(i)
                self.scope.append(blocks[-1])
                if text == "{":
                    self.parents[i] = blocks[-1]
                    blocks.append(i)
                continue
            if kind == "op" and text in _CLOSERS and stack:
                self.close[stack[-1]] = i
                self.open[i] = stack[-1]
                if self.items[stack.pop()][1] == "{":
                    blocks.pop()
            self.scope.append(blocks[-1])

    def _read(self, body: str, at: int, until: str | None) -> int:
        depth = 0
        while at < len(body):
            c = body[at]
            if until and c == until and not depth:
                return at
            if c == "`":
                at = self._template(body, at)
                continue
            if c == "/" and body[at + 1 : at + 2] not in ("/", "*") and self._regex_may_start():
                m = _REGEX.match(body, at)
                if m:
                    self.items.append(("regex", m[0], at))
                    at = m.end()
                    continue
            m = _TOKEN.match(body, at)
            if not m:
                at += 1
                continue
            kind = m.lastgroup
            if kind != "space":
                text = m[0]
                if until:
                    depth += (text == "{") - (text == "}")
                self.items.append((kind, text, at))
            at = m.end()
        return at

    def _regex_may_start(self) -> bool:
        if not self.items:
            return True
        kind, text, _ = self.items[-1]
        return kind == "op" and text not in (")", "]", "}") or kind == "name" and text in ("return", "typeof", "case", "in", "of", "await")

    def _template(self, body: str, at: int) -> int:
        start, parts, text = at, [], []
        at += 1
        while at < len(body) and body[at] != "`":
            if body[at] == "\\":
                text.append(body[at + 1 : at + 2])
                at += 2
            elif body.startswith("${", at):
                parts.append("".join(text))
                text = []
                inner = _Tokens.__new__(_Tokens)
                inner.items = []
                end = inner._read(body, at + 2, "}")
                parts.append(inner.items)
                at = end + 1
            else:
                text.append(body[at])
                at += 1
        parts.append("".join(text))
        self.items.append(("tmpl", parts, start))
        return at + 1


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.DOTALL)


class _Parser:
    """Expressions from tokens: nested tuples whose first item says what they are. Unknown syntax is ("unknown",)."""

    def __init__(self, tokens: _Tokens):
        self.t = tokens
        self.items = tokens.items

    def text(self, i: int) -> object:
        return self.items[i][1] if 0 <= i < len(self.items) and self.items[i][0] in ("op", "name") else None

    def end_of(self, i: int) -> int:
        """Behind the bracket that closes the one at ``i``."""
        return self.t.close.get(i, len(self.items) - 1) + 1

    def expression(self, i: int, depth: int = 0) -> tuple[tuple, int]:
        if depth > 60:
            return ("unknown",), i + 1
        if self._arrow(i):
            return self._function(i)
        left, i = self._binary(i, depth)
        if self.text(i) == "?":
            yes, i = self.expression(i + 1, depth + 1)
            if self.text(i) == ":":
                no, i = self.expression(i + 1, depth + 1)
                return ("cond", left, yes, no), i
        return left, i

    def _binary(self, i: int, depth: int) -> tuple[tuple, int]:
        left, i = self._unary(i, depth)
        while (op := self.text(i)) in ("+", "-", "*", "/", "%", "&&", "||", "??", "===", "!==", "==", "!=", "<", ">", "<=", ">=", "in", "instanceof", "as", "satisfies", "|", "&"):
            if op in ("as", "satisfies"):
                i = self.type_end(i + 1)
                continue
            right, i = self._unary(i + 1, depth + 1)
            left = ("binary", op, left, right)
        return left, i

    def type_end(self, i: int) -> int:
        """Behind a type, as far as one can tell: names, generics, arrays, unions, object types."""
        while i < len(self.items):
            kind, text, _ = self.items[i]
            if kind == "op" and text in ("{", "[", "("):
                i = self.end_of(i)
            elif kind == "op" and text == "<":
                i = self.generic_end(i) or i + 1
            elif kind in ("name", "str", "num", "tmpl") or text == ".":
                i += 1
            else:
                return i
            if self.text(i) in ("|", "&", "=>"):
                i += 1
            elif self.text(i) not in (".", "[", "<", "is", "extends", "keyof"):
                return i
        return i

    def generic_end(self, i: int) -> int | None:
        """Behind ``<...>`` if it is one."""
        depth, at = 0, i
        while at < len(self.items) and at < i + 80:
            text = self.text(at)
            if text in ("(", "[", "{"):
                at = self.end_of(at)
                continue
            depth += (text == "<") - (text == ">")
            at += 1
            if not depth:
                return at
            if text in (";", ")", "}", "&&", "||"):
                return None
        return None

    def _unary(self, i: int, depth: int) -> tuple[tuple, int]:
        text = self.text(i)
        if text in ("!", "-", "+", "~", "typeof", "void", "++", "--"):
            _, i = self._unary(i + 1, depth + 1)
            return ("unknown",), i
        if text in ("await", "yield"):
            return self._unary(i + 1, depth + 1)
        if text == "new":
            return self._new(i + 1, depth)
        return self._postfix(*self._primary(i, depth), depth)

    def _new(self, i: int, depth: int) -> tuple[tuple, int]:
        node, i = self._primary(i, depth)
        while self.text(i) == "." and self.items[i + 1 : i + 2] and self.items[i + 1][0] == "name":
            node, i = ("member", node, self.items[i + 1][1]), i + 2
        if self.text(i) == "<" and (end := self.generic_end(i)) and self.text(end) == "(":
            i = end
        args: list[tuple] = []
        at = i
        if self.text(i) == "(":
            args, i = self.arguments(i, depth)
        return self._postfix(("new", node, args, at), i, depth)

    def arguments(self, i: int, depth: int) -> tuple[list[tuple], int]:
        end, out = self.end_of(i), []
        i += 1
        while i < end - 1:
            spread = self.text(i) == "..."
            before = i
            node, i = self.expression(i + spread, depth + 1)
            out.append(("spread", node) if spread else node)
            while i < end - 1 and self.text(i) != ",":  # what could not be read
                i = self.end_of(i) if self.text(i) in _OPENERS else i + 1
                out[-1] = out[-1] if before == i else out[-1]
            i += 1
        return out, end

    def _arrow(self, i: int) -> bool:
        text = self.text(i)
        if text == "function":
            return True
        if text == "async":
            return self._arrow(i + 1)
        if text == "(":
            end = self.end_of(i)
            if self.text(end) == ":":
                end = self.type_end(end + 1)
            return self.text(end) == "=>"
        return bool(self.items[i : i + 1]) and self.items[i][0] == "name" and self.text(i + 1) == "=>"

    def _function(self, i: int) -> tuple[tuple, int]:
        """("function", first token of what it gives, whether that is a block)."""
        if self.text(i) == "async":
            i += 1
        if self.text(i) == "function":
            while i < len(self.items) and self.text(i) != "(":
                i += 1
            i = self.end_of(i)
            if self.text(i) == ":":
                i = self.type_end(i + 1)
            return ("function", i, True), self.end_of(i) if self.text(i) == "{" else i + 1
        while i < len(self.items) and self.text(i) != "=>":
            i = self.end_of(i) if self.text(i) in _OPENERS else i + 1
        i += 1
        if self.text(i) == "{":
            return ("function", i, True), self.end_of(i)
        _, end = self.expression(i, 1)
        return ("function", i, False), end

    def _primary(self, i: int, depth: int) -> tuple[tuple, int]:
        if i >= len(self.items):
            return ("unknown",), i + 1
        kind, text, _ = self.items[i]
        if kind == "str":
            return ("text", _unquote(text)), i + 1
        if kind == "num":
            return ("text", text), i + 1
        if kind == "tmpl":
            parts = []
            for part in text:
                if isinstance(part, str):
                    parts.append(("text", part))
                else:
                    inner = _Tokens.__new__(_Tokens)
                    inner.items, inner.close = part, {}
                    stack: list[int] = []
                    for k, (kk, tt, _) in enumerate(part):
                        if kk == "op" and tt in _OPENERS:
                            stack.append(k)
                        elif kk == "op" and tt in _CLOSERS and stack:
                            inner.close[stack.pop()] = k
                    parts.append(_Parser(inner).expression(0, depth + 1)[0] if part else ("unknown",))
            return ("concat", parts), i + 1
        if kind == "name":
            return ("name", text, i), i + 1
        if text == "(":
            node, _ = self.expression(i + 1, depth + 1)
            return node, self.end_of(i)
        if text == "[":
            out, end = self.arguments(i, depth)
            return ("list", out), end
        if text == "{":
            return self._object(i, depth)
        return ("unknown",), i + 1

    def _object(self, i: int, depth: int) -> tuple[tuple, int]:
        end, out = self.end_of(i), []
        i += 1
        while i < end - 1:
            kind, text, _ = self.items[i]
            if text == "...":
                node, i = self.expression(i + 1, depth + 1)
                out.append((None, node))
            else:
                if text in ("get", "set", "async", "*") and self.text(i + 1) not in (":", ",", "(", "}"):
                    i += 1
                    kind, text, _ = self.items[i]
                key = _unquote(text) if kind == "str" else text if kind in ("name", "num") else None
                if text == "[":
                    i = self.end_of(i)
                else:
                    i += 1
                if self.text(i) == ":":
                    node, i = self.expression(i + 1, depth + 1)
                    out.append((key, node))
                elif self.text(i) == "(":
                    i = self.end_of(i)
                    if self.text(i) == ":":
                        i = self.type_end(i + 1)
                    out.append((key, ("function", i, True)))
                    i = self.end_of(i) if self.text(i) == "{" else i + 1
                else:
                    out.append((key, ("name", key, i - 1)))
                    if self.text(i) == "=":
                        _, i = self.expression(i + 1, depth + 1)
            while i < end - 1 and self.text(i) != ",":
                i = self.end_of(i) if self.text(i) in _OPENERS else i + 1
            i += 1
        return ("object", out), end

    def _postfix(self, node: tuple, i: int, depth: int) -> tuple[tuple, int]:
        while i < len(self.items):
            text = self.text(i)
            if text in (".", "?.") and self.items[i + 1 : i + 2] and self.items[i + 1][0] == "name":
                node, i = ("member", node, self.items[i + 1][1]), i + 2
            elif text == "?." and self.text(i + 1) in ("(", "["):
                i += 1
            elif text == "[":
                inner, _ = self.expression(i + 1, depth + 1)
                node, i = (("member", node, inner[1]) if inner[0] == "text" else ("index", node, inner)), self.end_of(i)
            elif text == "(":
                at = i
                args, i = self.arguments(i, depth)
                node = ("call", node, args, at)
            elif text == "!" and self.text(i + 1) in (".", ")", ",", ";", "[", None):
                i += 1
            elif text == "<" and (end := self.generic_end(i)) and self.text(end) == "(":
                i = end
            elif self.items[i][0] == "tmpl" and node[0] in ("name", "member"):  # a tagged template is its text
                node, i = self._primary(i, depth)
            else:
                break
        return node, i


class _File:
    """Declarations, imports and exports of one file, and what its expressions come to."""

    def __init__(self, body: str):
        self.body = body
        self.tokens = _Tokens(body)
        self.p = _Parser(self.tokens)
        self.items = self.tokens.items
        self.lines = [m.end() for m in re.finditer("\n", body)]
        self.imports: dict[str, tuple[str, str]] = {}
        self.declared: dict[tuple[int, str], list[tuple[int, tuple]]] = {}
        self.exports: dict[str, tuple] = {}
        self._declarations()

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.items[i][2]) + 1

    def _say(self, i: int, name: str, node: tuple) -> None:
        self.declared.setdefault((self.tokens.scope[i], name), []).append((i, node))

    def _declarations(self) -> None:
        items, text = self.items, self.p.text
        for i, (kind, word, _) in enumerate(items):
            if kind != "name":
                if word == "(" and text(i - 1) not in ("if", "for", "while", "switch", "catch"):
                    self._parameters(i)
                continue
            exported = text(i - 1) == "export"
            if word in ("const", "let", "var"):
                self._variable(i, exported)
            elif word == "function" and items[i + 1 : i + 2] and items[i + 1][0] == "name":
                node, _ = self.p._function(i)
                self._say(i, items[i + 1][1], node)
                if exported or text(i - 1) == "async" and text(i - 2) == "export":
                    self.exports[items[i + 1][1]] = ("name", items[i + 1][1], i)
            elif word == "enum" and items[i + 1 : i + 2] and items[i + 1][0] == "name" and text(i + 2) == "{":
                node, _ = self._enum(i + 2)
                self._say(i, items[i + 1][1], node)
                if exported:
                    self.exports[items[i + 1][1]] = node
            elif word == "class" and items[i + 1 : i + 2] and items[i + 1][0] == "name":
                self._class(i, exported)
            elif word == "import" and text(i + 1) not in ("(", "."):
                self._import(i)
            elif word == "export" and text(i + 1) == "default":
                self.exports["default"] = self.p.expression(i + 2)[0]
            elif word == "export" and text(i + 1) == "{":
                self._export_list(i + 1)

    def _variable(self, i: int, exported: bool) -> None:
        items, text = self.items, self.p.text
        at = i + 1
        while at < len(items):
            if text(at) in ("{", "["):
                names, end = self._pattern(at), self.p.end_of(at)
                if text(end) == ":":
                    end = self.p.type_end(end + 1)
                if text(end) != "=":
                    return
                node, end = self.p.expression(end + 1)
                for name, key in names:
                    self._say(i, name, ("member", node, key) if key else ("unknown",))
                    self._required(name, node, key)
            else:
                if items[at][0] != "name":
                    return
                name, end = items[at][1], at + 1
                if text(end) == "!":
                    end += 1
                if text(end) == ":":
                    end = self.p.type_end(end + 1)
                if text(end) != "=":
                    return
                node, end = self.p.expression(end + 1)
                self._say(i, name, node)
                self._required(name, node, "default")
                if exported:
                    self.exports[name] = ("name", name, i)
            if text(end) != ",":
                return
            at = end + 1

    def _required(self, name: str, node: tuple, key: str | None) -> None:
        if node[0] == "call" and node[1][:2] == ("name", "require") and node[2] and node[2][0][0] == "text" and key:
            self.imports[name] = (node[2][0][1], key)

    def _pattern(self, i: int) -> list[tuple[str, str | None]]:
        """(name, property) of a destructuring pattern, one level."""
        end, out, at = self.p.end_of(i), [], i + 1
        while at < end - 1:
            kind, word, _ = self.items[at]
            if kind == "name" and self.p.text(at + 1) == ":" and self.items[at + 2][0] == "name":
                out.append((self.items[at + 2][1], word))
                at += 2
            elif kind == "name":
                out.append((word, word if self.p.text(i) == "{" else None))
            while at < end - 1 and self.p.text(at) != ",":
                at = self.p.end_of(at) if self.p.text(at) in _OPENERS else at + 1
            at += 1
        return out

    def _parameters(self, i: int) -> None:
        """Defaults of parameters hold where the function's block begins."""
        end = self.p.end_of(i)
        after = self.p.type_end(end + 1) if self.p.text(end) == ":" else end
        block = after if self.p.text(after) == "{" else after + 1 if self.p.text(after) == "=>" else None
        if block is None:
            return
        at = i + 1
        while at < end - 1:
            if self.items[at][0] == "name" and self.p.text(at - 1) in ("(", ",", "...", "private", "readonly", "public", "protected"):
                name, k = self.items[at][1], at + 1
                if self.p.text(k) == "?":
                    k += 1
                if self.p.text(k) == ":":
                    k = self.p.type_end(k + 1)
                node = self.p.expression(k + 1)[0] if self.p.text(k) == "=" else ("param", name)
                if self.p.text(block) == "{":
                    self.declared.setdefault((block, name), []).append((i, node))
            at = self.p.end_of(at) if self.p.text(at) in _OPENERS else at + 1

    def _enum(self, i: int) -> tuple[tuple, int]:
        end, out, at = self.p.end_of(i), [], i + 1
        while at < end - 1:
            kind, word, _ = self.items[at]
            key = _unquote(word) if kind == "str" else word
            if self.p.text(at + 1) == "=":
                node, at = self.p.expression(at + 2)
                out.append((key, node))
            else:
                at += 1
            at += self.p.text(at) == ","
        return ("object", out), end

    def _class(self, i: int, exported: bool) -> None:
        """Fields with values, and those that the constructor sets, are read as ``this`` inside the class."""
        at = i
        while at < len(self.items) and self.p.text(at) != "{":
            at += 1
        end, fields, k = self.p.end_of(at), [], at + 1
        while k < end - 1:
            if self.items[k][0] == "name" and self.tokens.scope[k] == at:
                after = k + 1
                if self.p.text(after) in ("?", "!"):
                    after += 1
                if self.p.text(after) == ":":
                    after = self.p.type_end(after + 1)
                if self.p.text(after) == "=":
                    node, after = self.p.expression(after + 1)
                    fields.append((self.items[k][1], node))
                    k = after
                    continue
            if self.p.text(k) == "this" and self.p.text(k + 1) == "." and self.p.text(k + 3) == "=" and self.items[k + 2][0] == "name":
                node, _ = self.p.expression(k + 4)
                fields.append((self.items[k + 2][1], node))
            k += 1
        self.declared.setdefault((at, "this"), []).append((at, ("object", fields)))
        if exported:
            self.exports[self.items[i + 1][1]] = ("object", fields)

    def _import(self, i: int) -> None:
        names, at = [], i + 1
        if self.p.text(at) == "type":
            return
        while at < len(self.items) and self.items[at][0] != "str":
            kind, word, _ = self.items[at]
            if kind == "name" and word not in ("from", "as", "type"):
                if self.p.text(at - 1) == "as":
                    names[-1] = (word, names[-1][1])
                else:
                    names.append((word, "default" if self.p.text(at - 1) in ("import",) else word))
            elif word == "*":
                names.append(("*", "*"))
            elif word == ";":
                return
            at += 1
        if at < len(self.items):
            module = _unquote(self.items[at][1])
            for local, name in names:
                self.imports[local] = (module, name)

    def _export_list(self, i: int) -> None:
        end, at = self.p.end_of(i), i + 1
        module = _unquote(self.items[end + 1][1]) if self.p.text(end) == "from" and self.items[end + 1 : end + 2] and self.items[end + 1][0] == "str" else None
        while at < end - 1:
            kind, word, _ = self.items[at]
            if kind == "name":
                name = word
                if self.p.text(at + 1) == "as":
                    name, at = self.items[at + 2][1], at + 2
                self.exports[name] = ("imported", module, word) if module else ("name", word, i)
            at += 1

    def lookup(self, name: str, i: int) -> tuple | None:
        """The value that a name has at a token: the nearest block's last assignment before it, else the first."""
        scope = self.tokens.scope[i] if i < len(self.tokens.scope) else -1
        while True:
            found = self.declared.get((scope, name))
            if found:
                before = [node for at, node in found if at < i]
                return before[-1] if before else found[0][1]
            if scope == -1:
                return None
            scope = self.tokens.parents.get(scope, -1)

    def value(self, node: tuple, i: int, depth: int = 0) -> tuple:
        """The node that names and members lead to."""
        if depth > DEPTH:
            return node
        if node[0] == "name":
            found = self.lookup(node[1], i)
            if found is not None and found != node:
                return self.value(found, i, depth + 1) if found[0] in ("name", "member", "index", "cond", "binary") and found[0] != "binary" else found
            if node[1] in self.imports:
                return ("imported", *self.imports[node[1]])
        if node[0] == "member":
            inner = self.value(node[1], i, depth + 1)
            if inner[0] == "object":
                for key, value in reversed(inner[1]):
                    if key == node[2]:
                        return self.value(value, i, depth + 1)
            if inner[0] == "imported":
                return ("imported", inner[1], node[2]) if inner[2] == "*" else ("imported", inner[1], f"{inner[2]}.{node[2]}")
            return ("member", inner, node[2]) if inner[0] in ("param", "unknown", "name") else node
        return node

    def env(self, node: tuple) -> str | None:
        """The variable that ``process.env.X`` or ``import.meta.env.X`` names."""
        if node[0] != "member" or node[1][0] != "member" or node[1][2] != "env":
            return None
        of = node[1][1]
        return node[2] if of[:2] == ("name", "process") or of[0] == "member" and of[2] == "meta" else None

    def template(self, node: tuple, i: int, depth: int = 0) -> str:
        """Text of an expression, with ``{name}``, ``{env:NAME}`` and ``{import:module#name}`` for what is not written out."""
        if depth > DEPTH:
            return "{unknown}"
        again = lambda n: self.template(n, i, depth + 1)
        kind = node[0]
        if kind == "text":
            return node[1]
        if kind == "concat":
            return "".join(again(x) for x in node[1])
        if kind == "binary":
            if node[1] == "+":
                return again(node[2]) + again(node[3])
            if node[1] in ("||", "??"):
                return again(node[2])
            return again(node[3]) if node[1] == "&&" else "{unknown}"
        if kind == "cond":
            yes, no = again(node[2]), again(node[3])
            return yes if "{" not in yes or "{" in no else no
        if (name := self.env(node)) is not None:
            return f"{{env:{name}}}"
        if kind == "call":
            return self._called(node, i, depth)
        if kind == "new" and node[1][:2] == ("name", "URL") and node[2]:
            path = again(node[2][0])
            base = again(node[2][1]) if len(node[2]) > 1 else ""
            return path if re.match(r"(?i)[a-z][a-z0-9+.-]*://", path) or not base else base.rstrip("/") + "/" + path.lstrip("/") if not base.startswith("{") else base + path
        if kind == "new" and node[1][:2] == ("name", "Request") and node[2]:
            return again(node[2][0])
        if kind in ("name", "member", "index"):
            found = self.value(node, i)
            if found[0] == "imported":
                return f"{{import:{found[1]}#{found[2]}}}"
            if found[0] in ("text", "concat", "binary", "cond", "new", "call") and found != node:
                return again(found)
            if (name := self.env(found)) is not None:
                return f"{{env:{name}}}"
            return f"{{{node[1] if kind == 'name' else node[2] if kind == 'member' else 'unknown'}}}"
        return "{unknown}"

    def _called(self, node: tuple, i: int, depth: int) -> str:
        callee, args = node[1], node[2]
        again = lambda n: self.template(n, i, depth + 1)
        if callee[0] == "member":
            name, of = callee[2], callee[1]
            if name in ("toString", "trim", "href", "toLowerCase", "valueOf") and not args:
                return again(of)
            if name == "join" and of[0] == "list":
                return (again(args[0]) if args else ",").join(again(x) for x in of[1])
            if name == "concat":
                return again(of) + "".join(again(x) for x in args)
            if name == "replace" and len(args) == 2 and args[0][0] == "text":
                return again(of).replace(args[0][1], again(args[1]), 1)
        if callee[0] == "name":
            if callee[1] in ("encodeURIComponent", "encodeURI", "String") and args:
                return again(args[0])
            found = self.lookup(callee[1], i)
            if found and found[0] == "function":
                given = self.returned(found)
                if given is not None:
                    return self.template(given[0], given[1], depth + 1)
        if callee[0] in ("name", "member"):
            return f"{{{callee[1] if callee[0] == 'name' else callee[2]}}}"
        return "{unknown}"

    def returned(self, fn: tuple) -> tuple[tuple, int] | None:
        """(node, where it stands) of what a function gives: its body, or the last return of its block."""
        i = fn[1]
        if not fn[2]:
            return self.p.expression(i)[0], i
        end = self.p.end_of(i)
        last = None
        for k in range(i + 1, min(end, len(self.items))):
            if self.items[k][:2] == ("name", "return") and self.tokens.scope[k] == i:
                last = k
        return (self.p.expression(last + 1)[0], last) if last is not None else None

    def options(self, node: tuple | None, i: int) -> dict[str, tuple]:
        """Properties of an object that a node leads to, spreads included."""
        if node is None:
            return {}
        found = self.value(node, i) if node[0] in ("name", "member") else node
        if found[0] != "object":
            return {}
        out: dict[str, tuple] = {}
        for key, value in found[1]:
            if key is None:
                out |= self.options(value, i)
            else:
                out[key] = value
        return out

    def names(self, node: tuple | None, i: int, depth: int = 0) -> list[str]:
        """Keys of a body or of headers: objects, ``JSON.stringify``, ``URLSearchParams``, ``Headers``, form data filled by ``append``."""
        if node is None or depth > DEPTH:
            return []
        if node[0] in ("call", "new") and node[2]:
            callee = node[1]
            if callee[0] == "member" and callee[2] == "stringify" or callee[0] == "name" and callee[1] in ("URLSearchParams", "Headers", "FormData"):
                return self.names(node[2][0], i, depth + 1)
        if node[0] == "name":
            found = self.lookup(node[1], i)
            if found and found[0] == "new" and found[1][:2] in (("name", "FormData"), ("name", "URLSearchParams"), ("name", "Headers")):
                return self.names(found, i, depth + 1) + self._appended(node[1])
            return self.names(found, i, depth + 1) if found and found != node else []
        return [k for k in self.options(node, i) if k]

    def _appended(self, name: str) -> list[str]:
        out = []
        for k in range(len(self.items) - 4):
            if self.items[k][:2] == ("name", name) and self.p.text(k + 1) == "." and self.p.text(k + 2) in ("append", "set") and self.p.text(k + 3) == "(" and self.items[k + 4][0] == "str":
                out.append(_unquote(self.items[k + 4][1]))
        return list(dict.fromkeys(out))

    def client(self, node: tuple, i: int, depth: int = 0) -> tuple[str, str] | None:
        """(client, base URL) of a node that is a client or an instance of one; an imported one is ``import:module#name``."""
        if depth > DEPTH:
            return None
        if node[0] == "name":
            if node[1] == "fetch" and self.lookup("fetch", i) is None and "fetch" not in self.imports:
                return "fetch", ""
            found = self.lookup(node[1], i)
            if found is not None and found != node and not (found[0] == "call" and found[1][:2] == ("name", "require")) and found[0] != "member":
                return self.client(found, i, depth + 1)
            if node[1] in self.imports:
                return self._imported(*self.imports[node[1]])
            return None
        if node[0] == "member":
            if node[1][:2] in (("name", "globalThis"), ("name", "window"), ("name", "self")) and node[2] == "fetch":
                return "fetch", ""
            found = self.value(node, i)
            if found != node and found[0] in ("call", "name"):
                return self.client(found, i, depth + 1)
            inner = self.client(node[1], i, depth + 1)
            if inner and inner[0].startswith("import:"):
                return f"{inner[0]}.{node[2]}" if not inner[0].endswith("#*") else inner[0][:-1] + node[2], ""
            return None
        if node[0] == "call":
            callee, args = node[1], node[2]
            if callee[0] == "member" and callee[2] in ("create", "extend"):
                of = self.client(callee[1], i, depth + 1)
                if of and of[0] in ("axios", "got", "ky", "fetch"):
                    options = self.options(args[0] if args else None, i)
                    base = next((options[k] for k in ("baseURL", "prefixUrl", "baseUrl") if k in options), None)
                    return of[0], self.template(base, i) if base else of[1]
            if callee[0] == "name":
                found = self.lookup(callee[1], i)
                if found and found[0] == "function":
                    given = self.returned(found)
                    return self.client(given[0], given[1], depth + 1) if given else None
        return None

    def _imported(self, module: str, name: str) -> tuple[str, str] | None:
        if module in _CLIENTS and (name in ("default", "*", "fetch") or _CLIENTS[module][0] == name):
            return _CLIENTS[module][0], ""
        if module in _NODE:
            return f"node-{_NODE[module]}", ""
        return (f"import:{module}#{name}", "") if module.startswith((".", "@", "~")) else None


    def made(self, node: tuple, i: int, depth: int = 0) -> tuple[str, str, list[tuple]] | None:
        """(package, constructor or factory, arguments) of what an expression was made by."""
        if depth > DEPTH:
            return None
        if node[0] in ("new", "call") and node[1][0] == "name" and node[1][1] in self.imports:
            return (*self.imports[node[1][1]], node[2])
        found = self.value(node, i) if node[0] in ("name", "member") else node
        return self.made(found, i, depth + 1) if found != node and found[0] in ("new", "call", "name", "member") else None

    def sdk(self, node: tuple, i: int, depth: int = 0) -> tuple[str, str, list[str]] | None:
        """(package, constructor, names behind it) of a chain that begins at something imported from a package."""
        if depth > DEPTH:
            return None
        if node[0] == "member":
            found = self.value(node, i)
            if found != node and found[0] in ("new", "call", "name"):
                return self.sdk(found, i, depth + 1)
            of = self.sdk(node[1], i, depth + 1)
            return (of[0], of[1], [*of[2], node[2]]) if of else None
        if node[0] in ("new", "call"):
            of = self.sdk(node[1], i, depth + 1)
            if of and not of[1]:  # a constructor or factory makes the client; what it is called with matters not
                return of[0], of[2][-1] if of[2] else "default", []
            return of if node[0] == "call" else None
        if node[0] != "name":
            return None
        found = self.lookup(node[1], i)
        if found is not None and found != node and not (found[0] == "call" and found[1][:2] == ("name", "require")) and found[0] in ("new", "call", "name", "member", "cond", "binary"):
            if found[0] == "cond":
                found = found[2]
            if found[0] == "binary":
                found = found[3] if found[1] in ("??", "||") and found[2][0] == "name" else found[2]
            return self.sdk(found, i, depth + 1)
        if found is not None and found[0] == "function":
            given = self.returned(found)
            return self.sdk(given[0], given[1], depth + 1) if given else None
        if node[1] in self.imports:
            module, name = self.imports[node[1]]
            if not module.startswith((".", "/", "~")) and module not in _CLIENTS and module not in _NODE:
                return module, "", [] if name in ("default", "*") else [name]
        return None


def _join(base: str, url: str) -> str:
    if not base or re.match(r"(?i)[a-z][a-z0-9+.-]*://", url):
        return url
    return base.rstrip("/") + "/" + url.lstrip("/") if url else base


def _request(f: _File, call: tuple, i: int) -> tuple | None:
    """(client, method, url, headers, body keys) of a call, or None. ``i``: the token of its bracket."""
    callee, args = call[1], call[2]
    arg = lambda k: args[k] if len(args) > k else None
    if helped := _framework(f, callee, args, i):
        return helped
    if sent := _graphql(f, callee, args, i):
        return sent
    direct = f.client(callee, i)
    verb, client, base = None, None, ""
    if direct and not direct[0].startswith(("node-", "import:")):
        client, base = direct
    elif callee[0] == "member" and (of := f.client(callee[1], i)):
        verb, (client, base) = callee[2].lower(), of
        allowed = {"get", "request"} if client.startswith("node-") else _VERBS | {"request", "fetch"}
        if verb not in allowed:
            return None
    elif callee[0] == "member" and callee[1][:2] in (("name", "$"), ("name", "jQuery")) and callee[2] in ("ajax", "get", "post", "getJSON"):
        verb, client = {"getjson": "get"}.get(callee[2].lower(), callee[2].lower()), "jquery"
    elif callee[0] == "member" and callee[2] == "open" and len(args) > 1 and callee[1][0] == "name":
        made = f.value(callee[1], i)
        if made[0] == "new" and made[1][:2] == ("name", "XMLHttpRequest"):
            method = f.template(arg(0), i).upper()
            return "xhr", "DYNAMIC" if "{" in method else method, f.template(arg(1), i), "", ""
    if client is None:
        return None
    headers_of = lambda o: ",".join(dict.fromkeys(h.lower() for h in f.names(o.get("headers"), i)))
    if client == "fetch":
        first = arg(0)
        if first is None:
            return None
        inner = f.value(first, i) if first[0] == "name" else first
        made = inner[2][1] if inner[0] == "new" and inner[1][:2] == ("name", "Request") and len(inner[2]) > 1 else None
        given = arg(1) or made
        options = f.options(given, i)
        url = f.template(first, i)
        if url.startswith(("blob:", "data:", "file:")):
            return None
        opaque = given is not None and not options and given[0] != "object"
        method = f.template(options["method"], i).upper() if "method" in options else "DYNAMIC" if opaque else verb.upper() if verb in _VERBS else "GET"
        return client, "DYNAMIC" if "{" in method else method, _join(base, url), headers_of(options), ",".join(f.names(options.get("body"), i))
    if client.startswith("node-"):
        scheme = client.removeprefix("node-")
        options = f.options(arg(0), i) if arg(0) is not None else {}
        more = f.options(arg(1), i) if len(args) > 1 else {}
        if options:
            host = f.template(options.get("hostname") or options.get("host") or ("text", "localhost"), i)
            port = f":{f.template(options['port'], i)}" if "port" in options else ""
            url = f"{scheme}://{host}{port}{f.template(options['path'], i) if 'path' in options else '/'}"
        else:
            url, options = f.template(arg(0), i) if arg(0) is not None else "{url}", more
        method = f.template(options["method"], i).upper() if "method" in options else "GET"
        return client, "DYNAMIC" if "{" in method else method, url, headers_of(options), ""
    if client == "jquery":
        options = f.options(arg(0), i) if verb == "ajax" else {}
        url = f.template(options["url"], i) if "url" in options else f.template(arg(0), i) if arg(0) is not None else "{url}"
        said = options.get("method") or options.get("type")
        method = f.template(said, i).upper() if said else "POST" if verb == "post" else "GET"
        return client, method, url, headers_of(options), ",".join(f.names(options.get("data") if verb == "ajax" else arg(1) if verb == "post" else None, i))
    # axios, got, ky, and imported instances, whose kind a join tells.
    whole = f.options(arg(0), i) if verb in (None, "request") else {}
    if whole:
        url = f.template(whole["url"], i) if "url" in whole else ""
        base = f.template(whole["baseURL"], i) if "baseURL" in whole else base
        options, body = whole, whole.get("data") or whole.get("json")
    else:
        url = f.template(arg(0), i) if arg(0) is not None else "{url}"
        sends = client not in ("got", "ky") and verb in ("post", "put", "patch")
        options = f.options(arg(2) if sends else arg(1), i)
        told = f.options(arg(1), i) if sends else options
        body = arg(1) if sends and not client.startswith("import:") else next((told[k] for k in ("json", "form", "data", "body") if k in told), arg(1) if sends else None)
    method = verb.upper() if verb in _VERBS else f.template(options["method"], i).upper() if "method" in options else "GET"
    return client, "DYNAMIC" if "{" in method else method, _join(base, url), headers_of(options), ",".join(f.names(body, i))


def _mcp_transport(f: _File, start: int, i: int) -> tuple | None:
    """A transport that connects to an MCP server by its URL."""
    node, _ = f.p._unary(start, 0)
    if node[0] != "new" or node[3] != i or node[1][0] != "name" or not node[2]:
        return None
    module, name = f.imports.get(node[1][1], ("", ""))
    kind = fixed.MCP_CONSTRUCTORS.get(name) if module.startswith(fixed.MCP_PACKAGE) else None
    return (f"mcp:{kind}", "POST", f.template(node[2][0], i), "", "") if kind else None


def _graphql(f: _File, callee: tuple, args: list[tuple], i: int) -> tuple | None:
    """A request of a GraphQL client, at the endpoint that the client was made with."""
    if callee[0] == "name" and callee[1] in f.imports and args:
        module, name = f.imports[callee[1]]
        if name in fixed.GRAPHQL_FUNCTIONS.get(module, ()):
            whole = f.options(args[0], i)
            return "graphql", "POST", f.template(whole["url"] if "url" in whole else args[0], i), "", "query"
    if callee[0] != "member" or callee[2] not in fixed.GRAPHQL_METHODS or not (made := f.made(callee[1], i)):
        return None
    module, name, given = made
    where = fixed.GRAPHQL_CLIENTS.get(module, {}).get(name)
    if where is None or not given:
        return None
    if where == 0:
        return "graphql", "POST", f.template(given[0], i), "", "query"
    options = f.options(given[0], i)
    if where not in options and "link" in options and (link := f.made(options["link"], i)) and link[2]:  # Apollo's endpoint may be its link's
        options = f.options(link[2][0], i)
    return "graphql", "POST", f.template(options[where], i) if where in options else "{url}", ",".join(h.lower() for h in f.names(options.get("headers"), i)), "query"


def _framework(f: _File, callee: tuple, args: list[tuple], i: int) -> tuple | None:
    """A framework's helper that sends what one options object says."""
    shift = 0
    if callee[0] == "member" and callee[2] == "call" and args and args[0][:2] == ("name", "this"):
        callee, shift = callee[1], 1
    used = f.sdk(callee, i)
    chain, of = [], callee
    while of[0] == "member":
        chain.insert(0, of[2])
        of = of[1]
    for name, package, said, place, method, urls, bodies in fixed.FRAMEWORKS:
        if package:
            if not used or used[0] != package or used[1] or ".".join(used[2]) != said:
                continue
        elif of[:2] != ("name", "this") or ".".join(chain) != said:
            continue
        options = f.options(args[place + shift], i) if len(args) > place + shift else {}
        url = next((f.template(options[k], i) for k in urls if k in options), "{url}")
        told = options.get("method")
        if told and told[0] == "member":  # an enum of methods
            told = ("text", told[2])
        sent = method or (f.template(told, i).upper() if told else "GET")
        body = next((options[k] for k in bodies if k in options), None)
        return f"framework:{name}", "DYNAMIC" if "{" in sent else sent, url, ",".join(h.lower() for h in f.names(options.get("headers"), i)), ",".join(f.names(body, i))
    return None


def javascript_rows(path: str, body: str) -> list[tuple]:
    """(kind, line, name, method, url, headers, body_keys): ``call`` rows with their client as name, ``sdk`` rows with package, constructor and key as name, method and url, and ``export`` rows with a text or a client's base as url."""
    try:
        f = _File(body)
        out, seen = [], set()
        for i, (kind, text, _) in enumerate(f.items):
            if kind != "op" or text != "(":
                continue
            start = _chain_start(f, i)
            if start is None or (start, i) in seen:
                continue
            node = _call_at(f, start, i)
            if node is None:
                served = _mcp_transport(f, start, i)
                if served and (start, i) not in seen:
                    seen.add((start, i))
                    out.append(("call", f.line(start), *served))
                continue
            seen.add((start, i))
            found = _request(f, node, i)
            if found:
                out.append(("call", f.line(start), *found))
                continue
            used = f.sdk(node[1], i)
            if used and used[2]:
                out.append(("sdk", f.line(start), used[0], used[1], ".".join(used[2]), None, None))
        for name, node in f.exports.items():
            out += _exported(f, name, node)
        return out
    except (RecursionError, IndexError):
        return [("problem", 0, "parse-error", None, None, None, None)]


def _chain_start(f: _File, i: int) -> int | None:
    """The first token of the chain of names that is called at ``i``."""
    k = i - 1
    if f.p.text(k) == ">":  # type arguments
        depth = 0
        while k >= 0:
            depth += (f.p.text(k) == ">") - (f.p.text(k) == "<")
            k -= 1
            if not depth:
                break
    while k >= 0:
        if f.p.text(k) in (")", "]") and k in f.tokens.open:  # called or indexed on the way
            k = f.tokens.open[k] - 1
            continue
        if f.items[k][0] != "name":
            return None
        if f.p.text(k - 1) in (".", "?."):
            k -= 2
            continue
        return None if f.p.text(k - 1) == "function" else k - (f.p.text(k - 1) == "new")
    return None


def _call_at(f: _File, start: int, i: int) -> tuple | None:
    """The call whose bracket is at ``i``, in the chain that begins at ``start``."""
    node, _ = f.p._unary(start, 0)
    while node[0] in ("call", "member", "index", "new"):
        if node[0] == "new":
            return None
        if node[0] == "call" and node[3] == i:
            return node
        node = node[1]
    return None


def _exported(f: _File, name: str, node: tuple) -> list[tuple]:
    i = node[2] if node[0] == "name" else 0
    last = max(0, len(f.items) - 1)
    if node[0] == "imported":
        return [("export", 0, name, "again", f"{{import:{node[1]}#{node[2]}}}", None, None)]
    client = f.client(node, last)
    if client:
        return [("export", 0, name, "client", client[1], client[0], None)]
    found = f.value(node, last)
    if found[0] == "object":
        return [row for key, value in found[1] if key for row in _text_export(f, f"{name}.{key}", value, i)]
    return _text_export(f, name, node, i)


def _text_export(f: _File, name: str, node: tuple, i: int) -> list[tuple]:
    if node[0] in ("object", "function", "list"):
        return []
    text = f.template(node, max(0, len(f.items) - 1))
    return [] if text in ("{unknown}",) or text == f"{{{name}}}" else [("export", 0, name, "text", text, None, None)]


def javascript_calls(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(path, line, client, method, url, headers, body_keys) of the requests in script files, over file borders. ``files``: (path, body).

    Files are read alone, then linked: what a URL or a client takes from another file meets that
    file's exports in equi-joins on the module's path, up to four files away. ``aliases``: folders by
    the prefix that stands for them in module names (``@app/``: ``src/``). What cannot be found stays a placeholder; calls on imported things that are no clients drop out.
    """
    rows = scan_files(files, javascript_rows, "kind string, line long, name string, method string, url string, headers string, body_keys string")
    return linking.link(rows, aliases or {})


def sdk_calls(files: DataFrame) -> DataFrame:
    """(call, path, line, root, ctor, key): calls on what script files import from packages, for a registry to tell. ``files``: (path, body)."""
    rows = scan_files(files, javascript_rows, "kind string, line long, name string, method string, url string, headers string, body_keys string")
    return rows.filter("kind = 'sdk'").select(F.concat_ws(":", "path", "line", "url").alias("call"), "path", "line", F.col("name").alias("root"), F.col("method").alias("ctor"), F.col("url").alias("key"))
