"""Agents that a repository serves: constructions in code and committed cards."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import fixed
from callscope.operators.frontend import scan_files

#: Served agents that are listed; all are counted.
LISTED = 200
_SNAKE = {f: re.sub("[A-Z]", lambda m: f"_{m[0].lower()}", f) for f in fixed.CARD_FIELDS}


def _told(values: Iterator[object]) -> str:
    texts = {v for v in values if isinstance(v, str) and len(v) <= 64}
    return ",".join(sorted({"HTTP+JSON" if t in ("HTTP_JSON", "HTTP+JSON") else t for t in texts}))


def code_facts(body: str) -> tuple[str, str, str, str]:
    """(versions, bindings, fields, card paths) that a source file writes of a card."""
    found = re.findall
    bindings = [*found(fixed.CARD_BINDING, body), *(b.upper() for b in found(fixed.CARD_TRANSPORT, body))]
    fields = [f for f, snake in _SNAKE.items() if re.search(rf"""\b(?:{f}|{snake})["']?\s*[:=]""", body)]
    paths = {"/" + p.lstrip("/") for p in found(fixed.CARD_PATH, body)}
    return _told(iter(found(fixed.CARD_VERSION, body))), _told(iter(bindings)), ",".join(sorted(fields)), ",".join(sorted(paths))


def card_facts(body: str) -> tuple[str, str, str, str] | None:
    """(versions, bindings, fields, name) of a committed card, or None for what is no card."""
    try:
        card = json.loads(body)
    except (ValueError, RecursionError):
        return None
    if not isinstance(card, dict) or not isinstance(card.get("name"), str):
        return None
    faces = [x for k in ("supportedInterfaces", "additionalInterfaces") if isinstance(card.get(k), list) for x in card[k] if isinstance(x, dict)]
    versions = [card.get("protocolVersion"), *(x.get("protocolVersion") for x in faces)]
    bindings = [card.get("preferredTransport"), *(x.get(k) for x in faces for k in ("protocolBinding", "transport"))]
    return _told(iter(versions)), _told(iter(bindings)), ",".join(sorted(f for f in fixed.CARD_FIELDS if f in card)), card["name"][:200]


def server_rows(path: str, body: str) -> list[tuple]:
    """(line, kind, construction, package, versions, bindings, fields, card_paths, name): the first construction of each package in a file, or its card."""
    at = re.search(fixed.CARD_FILE.replace(r"\z", r"\Z"), path)
    if at:
        facts = card_facts(body)
        return [(1, "card-file", None, None, *facts[:3], f"/{at[1]}", facts[3])] if facts else []
    if not path.endswith(tuple(fixed.CODE_EXTENSIONS)) or not re.search("a2a", body, re.IGNORECASE):
        return []
    out = []
    for package, uses, names in fixed.AGENT_SERVERS:
        used = re.search(uses, body)
        if not used:
            continue
        calls = re.finditer(rf"(?<![\w$])({'|'.join(map(re.escape, names))})\s*\(", body)
        first = next((m for m in calls if not re.match(r"\s*(?:#|//|\*)", body[body.rfind("\n", 0, m.start()) + 1 : m.start() + 1])), None)
        if first:
            version = re.match(r".*/v\d+", used[0]) if package.startswith("github.com") else None
            out.append((body.count("\n", 0, first.start()) + 1, "sdk", first[1], version[0] if version else package, *code_facts(body), None))
    return out


def served_agents(files: DataFrame) -> DataFrame:
    """(path, line, kind, construction, package, versions, bindings, fields, card_paths, name) of all served agents. ``files``: (path, body)."""
    return scan_files(files, server_rows, "line long, kind string, construction string, package string, versions string, bindings string, fields string, card_paths string, name string")


def agent_coverage(served: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((count), the first ``LISTED`` by path and line)."""
    return served.agg(F.count("*").alias("count")), served.orderBy("path", "line", "package").limit(LISTED)
