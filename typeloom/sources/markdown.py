"""Parse of one file: frontmatter, YAML with repeated keys, body events, type definitions, instances."""

from __future__ import annotations

import re
from typing import Any

try:
    import yaml
except ImportError:  # the folder source asks for it; nothing else does
    yaml = None

READ_CAP = 32 << 20
FENCE = re.compile(r"^(`{3,})([^`]*)$")
HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*$")
MARKER = re.compile(r"(?:^|\s)\^([A-Za-z0-9_-]+)\s*$")
CODE = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)")
LINK = re.compile(r"\[\[[^\]\n]+\]\]")


def classify(path: str) -> str:
    """type-def, instance (a candidate) or asset."""
    if re.search(r"\.type\.ya?ml$", path):
        return "type-def"
    return "instance" if re.search(r"\.(md|ya?ml)$", path) else "asset"


def type_name(path: str) -> str:
    return re.sub(r"(\.type)?\.ya?ml$", "", path.rsplit("/", 1)[-1])


def split_frontmatter(text: str) -> tuple[str | None, str, str | None]:
    """(frontmatter or None, body, error)."""
    if not re.match(r"---[ \t]*\r?\n", text):
        return None, text, None
    lines = text.split("\n")
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip() in ("---", "..."):
            return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :]), None
    return None, text, "unterminated-frontmatter"


def load_yaml(text: str) -> tuple[Any, list[str]]:
    """The value and every repeated key; scalars are text unless null, true/false or a plain number."""
    repeated: list[str] = []

    def value(node):
        if isinstance(node, yaml.MappingNode):
            out = {}
            for k, v in node.value:
                key = k.value if isinstance(k, yaml.ScalarNode) else str(value(k))
                if key in out:
                    repeated.append(key)
                else:
                    out[key] = value(v)
            return out
        if isinstance(node, yaml.SequenceNode):
            return [value(v) for v in node.value]
        raw = node.value
        if node.style in ("'", '"', "|", ">"):
            return raw
        if raw in ("", "~", "null"):
            return None
        if raw in ("true", "false"):
            return raw == "true"
        if re.fullmatch(r"[-+]?\d+", raw):
            return int(raw)
        if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", raw):
            return float(raw)
        return raw

    node = yaml.compose(text, Loader=yaml.SafeLoader)
    return (None if node is None else value(node)), repeated


def scan_body(text: str) -> list[dict]:
    """Events in order: heading, fence, unterminated_fence, code, link, marker; spans are UTF-8 byte offsets."""
    events, masked = [], []
    lines, offs, at = text.split("\n"), [], 0
    for line in lines:
        offs.append(at)
        at += len(line.encode()) + 1
    section: list[str] = []
    seen = [0] * 7

    def add(kind: str, start: int, end: int, **more) -> None:
        events.append({"kind": kind, "start": start, "end": end, "section": list(section), "level": 0, "text": "", "info": "", "block_id": "", **more})

    i = 0
    while i < len(lines):
        line = lines[i].rstrip("\r")
        fence = FENCE.match(line)
        if fence:
            close = next((j for j in range(i + 1, len(lines)) if re.fullmatch(r"`{%d,}\s*" % len(fence[1]), lines[j].rstrip("\r"))), None)
            if close is None:
                add("unterminated_fence", offs[i], offs[i] + len(line.encode()), info=fence[2].strip())
        if fence and close is not None:
            after = MARKER.fullmatch(lines[close + 1].strip()) if close + 1 < len(lines) else None
            last = close + 1 if after else close
            end = offs[last] + len(lines[last].encode())
            add("fence", offs[i], end, info=fence[2].strip(), text="\n".join(lines[i + 1 : close]), block_id=after[1] if after else "")
            masked.append((offs[i], end))
            i = last + 1
            continue
        heading = HEADING.match(line)
        if heading:
            level, title = len(heading[1]), heading[2]
            mark = MARKER.search(title)
            title = title[: mark.start()].rstrip() if mark else title
            del section[level - 1 :]
            seen[level] += 1
            seen[level + 1 :] = [0] * (6 - level)
            section.extend([""] * (level - 1 - len(section)))
            section.append(title)
            add("heading", offs[i], offs[i] + len(line.encode()), level=level, text=title, block_id=mark[1] if mark else "")
            masked.append((offs[i], offs[i] + len(line.encode())))
            i += 1
            continue
        for m in CODE.finditer(line):
            a = offs[i] + len(line[: m.start()].encode())
            b = a + len(m[0].encode())
            add("code", a, b, text=m[2].strip())
            masked.append((a, b))
        for m in LINK.finditer(line):
            a = offs[i] + len(line[: m.start()].encode())
            if not any(x <= a < y for x, y in masked):
                add("link", a, a + len(m[0].encode()), text=m[0])
        mark = MARKER.search(line)
        if mark:
            add("marker", offs[i], offs[i] + len(line.encode()), block_id=mark[1])
        i += 1
    return sorted(events, key=lambda e: e["start"])


def field_marker(info: str) -> str:
    """``lang [:field]`` -> field."""
    m = re.search(r"\[:([^\]]+)\]", info)
    return m[1] if m else ""


def inline_records(value: Any, path: tuple[str, ...] = ()) -> list[dict]:
    """Every nested mapping with its path, claim and block id, at any depth."""
    out = []
    if isinstance(value, dict):
        if path:
            claim = value.get("type")
            out.append({"field_path": list(path), "claim": claim if isinstance(claim, str) else "", "block_id": str(value.get("^") or ""), "pointer": "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in path)})
        for k, v in value.items():
            out += inline_records(v, (*path, k))
    elif isinstance(value, list):
        for n, v in enumerate(value):
            out += inline_records(v, (*path, str(n)))
    return out


def parse_file(path: str, data: bytes) -> dict:
    """kind (type-def, instance, note, unparsed, asset), claim, fields (JSON), errors, events, records."""
    import json

    out: dict[str, Any] = {"path": path, "kind": "asset", "claim": [], "fields": "{}", "errors": [], "events": [], "records": []}
    kind = classify(path)
    if kind == "asset":
        return out
    if len(data) > READ_CAP:
        return out | {"kind": "unparsed", "errors": ["over-read-cap"]}
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return out | {"kind": "unparsed", "errors": ["not-utf8"]}
    front, body, error = (text, "", None) if not path.endswith(".md") else split_frontmatter(text)
    errors = [error] if error else []
    fields: Any = {}
    if front is not None:
        try:
            fields, repeated = load_yaml(front)
            errors += [f"duplicate-key:{k}" for k in repeated]
        except yaml.YAMLError:
            return out | {"kind": "unparsed", "errors": ["malformed-yaml"]}
        if fields is None:
            fields = {}
        if not isinstance(fields, dict):
            return out | {"kind": "unparsed", "errors": ["not-a-mapping"]}
    if kind == "type-def":
        return out | {"kind": kind, "claim": [type_name(path)], "fields": json.dumps(fields, ensure_ascii=False), "errors": errors}
    claim = fields.pop("type", None)
    claims = [claim] if isinstance(claim, str) else [str(c) for c in claim] if isinstance(claim, list) else []
    return out | {"kind": "instance" if claims else "note", "claim": claims, "fields": json.dumps(fields, ensure_ascii=False), "errors": errors, "events": scan_body(body), "records": inline_records(fields)}
