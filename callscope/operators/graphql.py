"""GraphQL documents: operations with the arguments of their fields."""

from __future__ import annotations

import json
import re

from callscope.functions import fixed
from callscope.operators.frontend import GRAPHQL_CHARS, GRAPHQL_OPERATIONS, GRAPHQL_TOKENS

_TOKEN = re.compile(r'#[^\n]*|"""(?s:.*?)"""|"(?:\\.|[^"\\\n])*"|\.\.\.|\$[A-Za-z_]\w*|[A-Za-z_]\w*|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\{[A-Za-z_][\w:.]*\}(?=\s*[,)\]}])|[{}()\[\]:!=|@$&]')
_SECRET, _CREDENTIAL = re.compile(fixed.SECRET.replace(r"\z", r"\Z")), re.compile(fixed.CREDENTIAL_KEY.replace(r"\z", r"\Z"))
REDACTED = "<redacted>"
#: Fields and fragment visits of a document, and how deep they nest.
FIELDS, DEPTH = 20_000, 32


class _Reader:
    def __init__(self, body: str):
        self.tokens = [t for t in _TOKEN.findall(body) if not t.startswith("#")]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        if self.at > len(self.tokens):
            raise ValueError("end")
        return self.tokens[self.at - 1]

    def value(self) -> object:
        t = self.take()
        if t == "[":
            out = []
            while self.peek() != "]":
                out.append(self.value())
            self.take()
            return out
        if t == "{":
            return self.pairs("}")
        if t.startswith('"""'):
            return t[3:-3].strip()
        if t.startswith('"'):
            return json.loads(t)
        if t in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[t]
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.fullmatch(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", t):
            return float(t)
        return t  # an enum value, a variable, or a part that is computed

    def pairs(self, close: str) -> dict:
        out = {}
        while self.peek() != close:
            name = self.take()
            if self.take() != ":":
                raise ValueError(name)
            value = self.value()
            told = isinstance(value, str) and not value.startswith(("$", "{"))
            out[name] = REDACTED if told and (_CREDENTIAL.search(name) or _SECRET.search(value)) else value
        self.take()
        return out

    def directives(self) -> None:
        while self.peek() == "@":
            self.take()
            self.take()
            if self.peek() == "(":
                self.take()
                self.pairs(")")

    def skip(self, open_: str, close: str) -> None:
        depth = 0
        while True:
            t = self.take()
            depth += (t == open_) - (t == close)
            if not depth:
                return

    def selection(self, depth: int = 0) -> list[tuple]:
        """(name, arguments, inner): ``...`` stands for a fragment, whose name is the inner one."""
        if depth > DEPTH or self.take() != "{":
            raise ValueError("selection")
        out: list[tuple] = []
        while self.peek() != "}":
            if self.peek() == "...":
                self.take()
                if self.peek() == "on":
                    self.take()
                    self.take()
                    self.directives()
                    out += self.selection(depth + 1)
                elif self.peek() in ("{", "@"):
                    self.directives()
                    out += self.selection(depth + 1)
                else:
                    out.append(("...", None, self.take()))
                    self.directives()
                continue
            name = self.take()
            if self.peek() == ":":
                self.take()
                name = self.take()
            arguments = None
            if self.peek() == "(":
                self.take()
                arguments = self.pairs(")")
            self.directives()
            out.append((name, arguments, self.selection(depth + 1) if self.peek() == "{" else None))
        self.take()
        return out

    def document(self) -> tuple[list[tuple], dict[str, list]]:
        operations, fragments = [], {}
        while self.at < len(self.tokens):
            word = self.peek()
            if word == "{":
                operations.append(("query", None, self.selection()))
            elif word in ("query", "mutation", "subscription"):
                self.take()
                name = self.take() if self.peek() not in ("{", "(", "@") else None
                if self.peek() == "(":
                    self.skip("(", ")")
                self.directives()
                operations.append((word, name, self.selection()))
            elif word == "fragment":
                self.take()
                name = self.take()
                self.take()
                self.take()
                self.directives()
                fragments[name] = self.selection()
            else:
                raise ValueError(word)
        return operations, fragments


def _arguments(fields: list[tuple], fragments: dict[str, list]) -> dict[str, object]:
    """Arguments by field path: an object, or a list where the path stands several times under other aliases."""
    seen: dict[str, list] = {}
    left = FIELDS

    def walk(inner: list[tuple], before: str, path: tuple[str, ...]) -> None:
        nonlocal left
        for name, arguments, more in inner:
            left -= 1
            if left < 0:
                raise ValueError("fields")
            if name == "...":
                if more in fragments and more not in path:
                    walk(fragments[more], before, (*path, more))
                continue
            seen.setdefault(before + name, []).append(arguments)
            if more:
                walk(more, f"{before}{name}.", path)

    walk(fields, "", ())
    told = {path: [a or {} for a in found] for path, found in seen.items() if any(found)}
    return {path: found[0] if len(found) == 1 else found for path, found in told.items()}


def operation_arguments(path: str, body: str) -> list[tuple]:
    """(type, name, arguments, problem) of the operations of a document; ``arguments`` as JSON, null for none.

    Strings under credential names, or that look secret, are redacted; variables are ``$name``, parts
    that the code computes ``{name}``. Operations without a name are named by their root fields.
    """
    if len(body) > GRAPHQL_CHARS:
        return [(None, None, None, "graphql-limit")]
    reader = _Reader(body)
    if len(reader.tokens) > GRAPHQL_TOKENS:
        return [(None, None, None, "graphql-limit")]
    try:
        operations, fragments = reader.document()
        if len(operations) > GRAPHQL_OPERATIONS:
            return [(None, None, None, "graphql-limit")]
        out = []
        for kind, name, fields in operations:
            arguments = _arguments(fields, fragments)
            named = name or ",".join(sorted({f[0] for f in fields if f[0] != "..."}))
            out.append((kind, named, json.dumps(arguments, separators=(",", ":")) if arguments else None, None))
        return out
    except (ValueError, RecursionError, TypeError) as e:
        return [(None, None, None, "graphql-limit" if str(e) == "fields" else "not-graphql")]
