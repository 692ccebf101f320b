"""Canonical encoding of a rooted graph of schema-qualified nodes, and Transform IDs.

A node has a namespace, a schema name, a version and named fields. Node numbers follow from
discovery: the root is 0, fields are visited by name, sequences in order. Sharing counts:
one node per value, never merged by structure.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

from ..functions.identity import DEFAULT, Namespace


@dataclass(eq=False)
class GraphNode:
    namespace: str
    name: str
    fields: dict[str, tuple] = field(default_factory=dict)  # name -> (tag, payload)
    version: int = 1


#: The tags of field data.
UNIT, BOOL, UINT, SINT, F32, F64, BYTES, TEXT, NODE, DIGEST, SEQUENCE = range(11)


def _text(value: str | bytes) -> bytes:
    raw = value.encode() if isinstance(value, str) else value
    return struct.pack("<I", len(raw)) + raw


def _ordered(node: GraphNode) -> list[tuple[str, tuple]]:
    return sorted(node.fields.items(), key=lambda x: x[0].encode())


def discover(root: GraphNode) -> list[GraphNode]:
    """Nodes in the order of their first visit."""
    order, seen, pending = [], set(), [(NODE, root)]
    while pending:
        tag, payload = pending.pop()
        if tag == SEQUENCE:
            pending.extend(reversed(payload))
        elif tag == NODE and id(payload) not in seen:
            seen.add(id(payload))
            order.append(payload)
            pending.extend(data for _, data in reversed(_ordered(payload)))
    return order


def encode(root: GraphNode, ns: Namespace = DEFAULT) -> bytes:
    nodes = discover(root)
    number = {id(n): i for i, n in enumerate(nodes)}

    def data(item: tuple) -> bytes:
        tag, payload = item
        body = {
            UNIT: lambda: b"", BOOL: lambda: bytes([payload]), UINT: lambda: struct.pack("<Q", payload), SINT: lambda: struct.pack("<q", payload),
            F32: lambda: struct.pack("<I", payload), F64: lambda: struct.pack("<Q", payload), BYTES: lambda: _text(payload), TEXT: lambda: _text(payload),
            NODE: lambda: struct.pack("<I", number[id(payload)]), DIGEST: lambda: bytes.fromhex(payload),
            SEQUENCE: lambda: struct.pack("<I", len(payload)) + b"".join(map(data, payload)),
        }[tag]()
        return bytes([tag]) + body

    out = [f"{ns.language.upper()}-HASH-IR\0".encode(), struct.pack("<II", 1, len(nodes))]
    for n in nodes:
        if not n.namespace or not n.name or not all(n.fields):
            raise ValueError("schema and field names must not be empty")
        out += [_text(n.namespace), _text(n.name), struct.pack("<II", n.version, len(n.fields))]
        out += [_text(name) + data(item) for name, item in _ordered(n)]
    return b"".join(out) + struct.pack("<I", 0)


def transform_id(root: GraphNode, ns: Namespace = DEFAULT) -> str:
    return hashlib.sha256(f"{ns.language}.transform-id.hash-ir-v1\0".encode() + encode(root, ns)).hexdigest()


def external(scheme: str, name: str, semantic_version: int, interface_version: int | None = None, parameters: tuple[tuple[str, int], ...] = (), result: int | None = None, ns: Namespace = DEFAULT) -> GraphNode:
    """The definition of a transform that is known by contract only."""
    return GraphNode(ns.host, "definition.external-transform", {
        "scheme": (TEXT, scheme), "name": (TEXT, name), "semantic_version": (UINT, semantic_version),
        "interface_version": (UNIT, None) if interface_version is None else (UINT, interface_version),
        "parameters": _parameters(parameters, ns), "result_type": (UNIT, None) if result is None else (UINT, result)})


def _parameters(parameters: tuple[tuple[str, int], ...], ns: Namespace) -> tuple:
    return SEQUENCE, [(NODE, GraphNode(ns.host, "external.parameter", {"name": (TEXT, n), "type_code": (UINT, c)})) for n, c in parameters]


def standard_id(name: str, version: int, ns: Namespace = DEFAULT) -> str:
    return transform_id(external(f"{ns.host}.standard-transform", name, version, ns=ns), ns)


def plugin_id(name: str, semantic_version: int, abi_version: int, parameters: tuple[tuple[str, int], ...], result: int, module_content: str, ns: Namespace = DEFAULT) -> str:
    """Includes the content of the module, so changed code is another transform."""
    return transform_id(GraphNode(ns.host, "definition.workspace-wasm", {
        "name": (TEXT, name), "semantic_version": (UINT, semantic_version), "abi_version": (UINT, abi_version),
        "parameters": _parameters(parameters, ns), "result_type": (UINT, result), "module_content": (DIGEST, module_content)}), ns)
