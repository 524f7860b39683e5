"""Shell scripts to call rows: variables, functions and their arguments, branches, sourced files."""

from __future__ import annotations

import re
import shlex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.frontend import _command, httpie_calls, scan_files
from callscope.sources.documents import resolved

#: Functions are followed through this many others.
HOPS = 4
_ASSIGN = re.compile(r"(?:(?:export|local|readonly|declare)\s+(?:-\w+\s+)*)?([A-Za-z_]\w*)=(.*)\Z", re.DOTALL)
_FUNCTION = re.compile(r"(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{?\s*\Z|function\s+([A-Za-z_][\w-]*)\s*\{?\s*\Z")
_SOURCE = re.compile(r"""(?m)^\s*(?:source|\.)\s+["']?(?:\$\{?\w+\}?/|\$\(dirname[^)]*\)/)?([\w./-]+)["']?\s*$""")


def _logical(body: str) -> list[tuple[int, str]]:
    """(line, text) of a script: continued lines and open quotes joined, comments and here-documents left out."""
    lines, out, i = body.split("\n"), [], 0
    while i < len(lines):
        start, text = i + 1, lines[i]
        while (text.endswith("\\") or _open_quote(text)) and i + 1 < len(lines) and i - start < 200:
            i += 1
            text = (text[:-1] + " " if text.endswith("\\") else text + "\n") + lines[i]
        here = re.search(r"<<-?\s*['\"]?(\w+)['\"]?", text)
        i += 1
        if here:
            while i < len(lines) and lines[i].strip() != here[1]:
                i += 1
            i += 1
        if text.strip() and not text.lstrip().startswith("#"):
            out.append((start, text.strip()))
    return out


def _open_quote(text: str) -> bool:
    quote = None
    k = 0
    while k < len(text):
        c = text[k]
        if c == "\\" and quote != "'":
            k += 2
            continue
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (k == 0 or text[k - 1] in " \t"):
            break
        k += 1
    return quote is not None


def _commands(text: str) -> list[str]:
    """The simple commands of a line: parts of pipes, lists and substitutions, the outer one first."""
    inner = re.findall(r"\$\(((?:[^()]|\([^()]*\))*)\)", text)
    outer = re.sub(r"\$\((?:[^()]|\([^()]*\))*\)", "{output}", text)
    parts, quote, start = [], None, 0
    for k, c in enumerate(outer):
        if quote:
            quote = None if c == quote and outer[k - 1] != "\\" else quote
        elif c in "'\"":
            quote = c
        elif c in "|;&\n" and outer[k - 1 : k] != ">":
            parts.append(outer[start:k])
            start = k + 1
    parts.append(outer[start:])
    return [p.strip() for p in parts if p.strip()] + [c for part in inner for c in _commands(part)]


class _Script:
    def __init__(self, body: str, before: str):
        self.values: dict[str, str] = {}
        self.functions: dict[str, list[tuple[int, str]]] = {}
        self.top: list[tuple[int, str]] = []
        if before:
            self._read(before)
            self.top = []
        self._read(body)

    def _read(self, body: str) -> None:
        name, depth, held = None, 0, []
        for line, text in _logical(body):
            m = _FUNCTION.match(text) if name is None else None
            if m and (text.endswith("{") or text.endswith(")")):
                name, depth, held = m[1] or m[2], int(text.endswith("{")), []
                continue
            one = re.match(r"(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{(.*)\}\s*\Z", text, re.DOTALL) if name is None else None
            if one:
                self.functions[one[1]] = [(line, one[2].strip())]
                continue
            if name is not None:
                depth += (text == "{" or text.endswith(" {")) - (text == "}" or text.startswith("} "))
                if depth <= 0 and text.startswith("}"):
                    self.functions[name] = held
                    name = None
                else:
                    held.append((line, text))
                continue
            self.top.append((line, text))
            if (a := _ASSIGN.match(text)) and not re.search(r"\s", re.sub(r"\"[^\"]*\"|'[^']*'|\$\([^)]*\)", "", a[2])):
                self.values[a[1]] = self.word(a[2], [])

    def word(self, text: str, args: list[str], own: dict[str, str] | None = None, depth: int = 0) -> str:
        """A text with what is known of its variables; others are ``{env:NAME}``, arguments that a call does not give ``{n}``."""

        def fill(m: re.Match) -> str:
            name, rest = (m[1] or m[3]), m[2] or ""
            if name.isdigit():
                k = int(name)
                return args[k - 1] if 0 < k <= len(args) else f"{{{name}}}"
            if own and name in own:
                return own[name]
            if name in self.values and depth < 10:
                return self.values[name]
            default = re.match(r":?[-=](.*)", rest)
            return f"{{env:{name}}}" if not default or not default[1] or "$" in default[1] else default[1]

        bare = text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text
        if len(text) > 1 and text[0] == text[-1] == "'":
            return text[1:-1]
        bare = re.sub(r"\$\((?:[^()]|\([^()]*\))*\)", "{output}", bare)
        return re.sub(r"\$\{(\w+)([^}]*)\}|\$(\w+)", fill, bare)

    def words(self, text: str, args: list[str], own: dict[str, str]) -> list[str]:
        text = re.sub(r'"?\$\{?[@*](?::(\d+))?\}?"?', lambda m: " ".join(shlex.quote(a) for a in args[(int(m[1]) - 1 if m[1] else 0) :]), text)
        single: list[str] = []
        kept = re.sub(r"'[^']*'", lambda m: single.append(m[0]) or f"\x00{len(single) - 1}\x00", text)
        filled = self.word(kept, args, own)
        filled = re.sub("\x00(\\d+)\x00", lambda m: single[int(m[1])], filled)
        try:
            return shlex.split(filled, comments=True)
        except ValueError:
            return []

    def calls(self, lines: list[tuple[int, str]], args: list[str], at: int | None, depth: int = 0) -> list[tuple]:
        """Requests of some lines. ``at``: the line of the call that runs them, if they are a function's."""
        out, own, shifted = [], {}, list(args)
        taken: list[bool] = []  # of the open branches
        matched: list[list] = []  # [value, whether a pattern of this case has matched]
        for line, text in lines:
            case = re.match(r"case\s+(.+?)\s+in\b", text)
            if case:
                value = self.words(case[1], shifted, own)
                matched.append([value[0] if value and "{" not in value[0] else None, False])
                taken.append(True)
                continue
            if matched and text == "esac":
                matched.pop()
                taken.pop()
                continue
            if matched and (arm := re.match(r"\(?([^()\s][^()]*)\)\s*(.*)", text, re.DOTALL)):
                patterns = [p.strip().strip("\"'") for p in arm[1].split("|")]
                known = matched[-1][0]
                fits = known is None or not matched[-1][1] and any(re.fullmatch(re.escape(p).replace(r"\*", ".*").replace(r"\?", "."), known) for p in patterns)
                matched[-1][1] = matched[-1][1] or known is not None and fits
                taken[-1] = fits
                text = arm[2]
            test = re.match(r"(?:if|elif)\s+\[\[?\s+(.+?)\s+(==?|!=)\s+(.+?)\s+\]\]?\s*;?\s*(?:then)?\s*\Z", text)
            if test:
                left, right = (self.words(x, shifted, own) for x in (test[1], test[3]))
                known = bool(left and right) and "{" not in left[0] + right[0]
                holds = not known or (left[0] == right[0]) == (test[2] != "!=")
                if text.startswith("if"):
                    taken.append(holds)
                    matched.append([None, known and holds])
                else:
                    taken[-1] = holds and not matched[-1][1]
                    matched[-1][1] = matched[-1][1] or known and holds
                continue
            if re.match(r"if\b", text) and not re.search(r"\bfi\s*\Z", text):
                taken.append(True)
                matched.append([None, False])
            elif text == "else" and taken:
                taken[-1] = not matched[-1][1]
                continue
            elif text == "fi" and taken:
                taken.pop()
                matched.pop()
                continue
            if not all(taken):
                continue
            if text == "shift":
                shifted = shifted[1:]
                continue
            if (a := _ASSIGN.match(text)) and "$(" not in a[2] and not re.search(r"\s", re.sub(r"\"[^\"]*\"|'[^']*'", "", a[2])):
                own[a[1]] = self.word(a[2], shifted, own)
                continue
            for command in _commands(re.sub(r"\s*;;\s*\Z", "", text)):
                out += self._run(command, shifted, own, line if at is None else at, depth)
        return out

    def _run(self, command: str, args: list[str], own: dict[str, str], line: int, depth: int) -> list[tuple]:
        words = self.words(command, args, own)
        while words and (re.match(r"[A-Za-z_]\w*=", words[0]) or words[0] in ("sudo", "exec", "time", "command", "then", "do", "if", "while", "!", "{")):
            words = words[1:]
        if not words:
            return []
        if words[0] in self.functions and depth < HOPS:
            return self.calls(self.functions[words[0]], words[1:], line, depth + 1)
        name = words[0].rsplit("/", 1)[-1]
        if name in ("curl", "wget"):
            return [(line, name, *r) for r in _command(name, words[1:])]
        if name in ("http", "https", "xh"):
            return [(line, *r[1:6]) for r in httpie_calls("", shlex.join(words))]
        return []


def shell_rows(path: str, body: str, before: str | None = None) -> list[tuple]:
    """(line, client, method, url, headers, body_keys) of a script; a function's requests stand at their own lines and at each call of it."""
    try:
        script = _Script(body, before or "")
    except RecursionError:
        return []
    own = [n for n in script.functions if re.search(rf"(?m)^\s*(?:function\s+)?{re.escape(n)}\b\s*(?:\(\)|\{{)", body)]
    out = script.calls(script.top, [], None)
    for name in own:
        out += script.calls(script.functions[name], [], None)
    return sorted(dict.fromkeys(out), key=repr)


def shell_calls(files: DataFrame) -> DataFrame:
    """(path, line, client, method, url, headers, body_keys) of shell scripts, with the variables and functions of files that they source. ``files``: (path, body).

    Sourced files are joined by resolved path, one file deep, and read before the script itself; their
    own requests are theirs.
    """
    sources = files.select("path", F.explode(F.regexp_extract_all("body", F.lit(_SOURCE.pattern.replace("(?m)", "(?m)")), F.lit(1))).alias("name"))
    wanted = sources.withColumn("target", resolved(F.col("path"), F.col("name"))).select("path", "target").distinct()
    texts = files.select(F.col("path").alias("target"), F.col("body").alias("text"))
    met = wanted.join(texts, "target").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target", "text"))), lambda x: x["text"]), "\n").alias("before"))  # what one script sources
    packed = files.join(met, "path", "left").select("path", F.to_json(F.struct("body", "before")).alias("body"))

    def read(path: str, body: str) -> list[tuple]:
        import json

        both = json.loads(body)
        return shell_rows(path, both["body"], both.get("before")) if both.get("body") is not None else []

    return scan_files(packed, read, "line long, client string, method string, url string, headers string, body_keys string")
