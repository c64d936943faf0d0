"""Triples out of the JSON in a text, for the table function in ``hooks``."""

from __future__ import annotations

import json
import re

#: Fixed value: the type of an entity that is named in relations only.
UNKNOWN = "未知"
_FENCE = re.compile(r"```json\s*(.*?)\s*```", re.S)


def _stripped(row: object, key: str) -> str:
    value = row.get(key) if isinstance(row, dict) else None
    return value.strip() if isinstance(value, str) else ""


def parsed(s: str | None, relations: set[str]) -> list[tuple[str, str, str, str, str]]:
    """``head, head_type, relation, tail, tail_type``; nothing of a text without an object, of broken JSON or of unknown relations."""
    fenced = _FENCE.search(s or "")
    body = fenced[1] if fenced else (s or "")
    begin, end = body.find("{"), body.rfind("}")
    try:
        data = json.loads(body[begin : end + 1])
    except ValueError:
        return []
    listed = lambda key: data[key] if isinstance(data.get(key), list) else []
    types = {_stripped(e, "name"): _stripped(e, "type") for e in listed("entities") if _stripped(e, "name") and _stripped(e, "type")}
    out = []
    for row in listed("relations"):
        head, relation, tail = (_stripped(row, k) for k in ("head", "relation", "tail"))
        if head and tail and relation in relations:
            out.append((head, types.get(head, UNKNOWN), relation, tail, types.get(tail, UNKNOWN)))
    return out
