"""Parquet schemas as trees, from footers: printing, description, lookups."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow.parquet as pq

_LINE = re.compile(r"^\s*(required|optional|repeated)\s+(group|[a-z0-9_]+(?:\(\d+\))?)\s+field_id=-?\d+\s+(.*?)(?:\s+\(((?:[^()]|\([^()]*\))*)\))?\s*(\{|;)$")


@dataclass
class Node:
    name: str
    repetition: str
    physical: str = ""  # empty for a group
    logical: str = ""
    children: list[Node] = field(default_factory=list)
    path: str = ""

    @property
    def group(self) -> bool:
        return not self.physical

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)


def tree(schema: pq.ParquetSchema) -> Node:
    """The schema's nodes, with repetition, physical and logical types of groups and leaves."""
    root = Node("", "required")
    open_ = [root]
    lines = str(schema).split("\n")
    first = next(i for i, line in enumerate(lines) if "group field_id" in line)
    for line in lines[first + 1 :]:
        if line.strip() == "}":
            open_.pop()
            if not open_:
                break
            continue
        m = _LINE.match(line)
        if not m:
            continue
        repetition, kind, name, logical, end = m.groups()
        node = Node(name, repetition, "" if kind == "group" else kind, logical or "", path=".".join(filter(None, [open_[-1].path, name])))
        open_[-1].children.append(node)
        if end == "{":
            open_.append(node)
    return root


def leaf(root: Node, path: str) -> Node | None:
    """A node by its dotted path."""
    node: Node | None = root
    for name in path.split("."):
        node = node.child(name) if node else None
    return node


def list_element(node: Node) -> Node | None:
    """The element of a LIST group."""
    if node.group and len(node.children) == 1 and node.children[0].repetition == "repeated":
        inner = node.children[0]
        return inner.children[0] if inner.group and len(inner.children) == 1 else inner
    return None


def _annotation(node: Node) -> str:
    text = node.logical
    if m := re.fullmatch(r"Int\(bitWidth=(\d+), isSigned=(\w+)\)", text):
        return f" (INT ({m[1]}, {m[2]}))"
    if m := re.fullmatch(r"Decimal\(precision=(\d+), scale=(\d+)\)", text):
        return f" (DECIMAL ({m[1]}, {m[2]}))"
    if m := re.match(r"Timestamp\(isAdjustedToUTC=(\w+), timeUnit=(\w+)", text):
        unit = {"milliseconds": "MILLIS", "microseconds": "MICROS", "nanoseconds": "NANOS"}.get(m[2], "UNKNOWN")
        return f" (TIMESTAMP ({unit}, {m[1]}))"
    return f" ({text.upper()})" if text and text != "None" else ""


def message(schema: pq.ParquetSchema) -> str:
    """The schema as `message { ... }`."""

    def lines(node: Node, depth: int) -> list[str]:
        pad = "  " * depth
        if node.group:
            inner = [x for c in node.children for x in lines(c, depth + 1)]
            return [f"{pad}{node.repetition} group {node.name}{_annotation(node)} {{", *inner, f"{pad}}}"]
        physical = re.sub(r"\((\d+)\)", r" (\1)", node.physical)
        return [f"{pad}{node.repetition} {physical} {node.name}{_annotation(node)};"]

    return "\n".join(["message {", *(x for c in tree(schema).children for x in lines(c, 1)), "}", ""])


def describe_tree(file: pq.ParquetFile) -> dict:
    """Nested name, optional, repeated, type, annotation, compression of row group 0 and fields;
    keys without a value are left out."""
    meta = file.metadata
    codecs: dict[str, str] = {}
    if meta.num_row_groups:
        group = meta.row_group(0)
        codecs = {group.column(i).path_in_schema: group.column(i).compression.lower() for i in range(group.num_columns)}

    def of(node: Node) -> dict:
        out = {"name": node.name, "optional": node.repetition == "optional", "repeated": node.repetition == "repeated"}
        out["type"] = node.physical
        out["annotation"] = node.logical.lower() if node.logical and node.logical != "None" else "group" if node.group else ""
        if not node.group:
            out["compression"] = codecs.get(node.path, "unknown")
        out["fields"] = [of(c) for c in node.children]
        return {k: v for k, v in out.items() if v}

    return of(tree(file.schema))
