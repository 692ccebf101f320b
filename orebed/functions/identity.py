"""Deterministic identities: SHA-256 over canonical encodings.

Every preimage starts with a framed domain and the identity version, so ids of different
kinds never collide. Each formula exists twice: as a Column for tables of any size, and as
a Python function for single values on the driver. ``Namespace`` names the domains; a
catalog that was made under other names keeps its ids when opened with those names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1
#: The tag byte of each kind of value in a typed Content ID. 7 is retired.
TAGS = {"null": 0, "bool": 1, "integer": 2, "float": 3, "string": 4, "list": 5, "record": 6, "bytes": 8, "fraction": 9, "buffer": 10}
#: The tag byte of each kind of semantic argument in a Recipe ID.
ARGUMENT_TAGS = {"content": 0, "source": 1, "recipe": 2}


@dataclass(frozen=True)
class Namespace:
    language: str = "orebed"
    host: str = "orebed.host"

    def domain(self, kind: str) -> str:
        return f"{self.language}.{kind}"


DEFAULT = Namespace()
DOMAINS = ("content", "content.bytes", "source", "dependency", "recipe", "artifact", "artifact.bundle")


# ---- Columns ----------------------------------------------------------------------------


def le(value: Column, width: int = 8) -> Column:
    """Little-endian bytes of an integer column."""
    text = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    pairs = F.regexp_extract_all(text, F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.slice(F.reverse(pairs), 1, width), ""))


def framed(data: Column) -> Column:
    return F.concat(le(F.octet_length(data)), data)


def text_bytes(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def fixed(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def head(domain: str) -> bytes:
    raw = domain.encode()
    return struct.pack("<Q", len(raw)) + raw + struct.pack("<I", VERSION)


def digest_column(domain: str, *parts: Column) -> Column:
    return F.sha2(F.concat(fixed(head(domain)), *parts), 256)


def raw_content_id(data: Column, ns: Namespace = DEFAULT) -> Column:
    return digest_column(ns.domain("content.bytes"), framed(data))


def typed_payload(kind: str, value: Column | dict[str, Column] | None = None) -> Column:
    """The payload of one kind. Records take (name, child id) pairs by name; lists a column of child ids."""
    if kind == "null":
        return fixed(b"")
    if kind == "bool":
        return F.when(value, fixed(b"\x01")).otherwise(fixed(b"\x00"))
    if kind == "integer":
        return le(value)
    if kind == "float":  # the bits of the float, as a bigint
        return le(value, 4)
    if kind == "string":
        return framed(text_bytes(value))
    if kind == "bytes":
        return framed(value)
    if kind == "fraction":
        return F.concat(le(value.getField("num")), le(value.getField("den")))
    if kind == "buffer":
        shape = value.getField("shape")
        dims = F.unhex(F.array_join(F.transform(shape, lambda d: F.hex(le(d))), ""))
        return F.concat(le(F.size(shape)), dims, le(value.getField("outer_stride")), framed(value.getField("data")))
    if kind == "list":
        return F.concat(le(F.size(value)), F.unhex(F.array_join(value, "")))
    if kind == "record":
        parts = [F.concat(framed(fixed(name.encode())), F.unhex(child)) for name, child in sorted(value.items(), key=lambda x: x[0].encode())]
        return F.concat(fixed(struct.pack("<Q", len(parts))), *parts)
    raise ValueError(f"no content identity for {kind}")


def content_id(kind: str, value: Column | dict[str, Column] | None = None, ns: Namespace = DEFAULT) -> Column:
    return digest_column(ns.domain("content"), fixed(bytes([TAGS[kind]])), typed_payload(kind, value))


def source_id(locator: Column, content: Column, ns: Namespace = DEFAULT) -> Column:
    return digest_column(ns.domain("source"), framed(text_bytes(locator)), F.unhex(content))


def dependency_id(capability: Column, key: Column, content: Column, ns: Namespace = DEFAULT) -> Column:
    return digest_column(ns.domain("dependency"), framed(text_bytes(capability)), framed(key), F.unhex(content))


def recipe_id(transform: Column, arguments: Column, dependencies: Column, ns: Namespace = DEFAULT) -> Column:
    """arguments: array<struct<kind, id>> in order; dependencies: array<string>, sorted and deduplicated here."""
    tag = F.create_map(*[F.lit(x) for kind, t in ARGUMENT_TAGS.items() for x in (kind, f"{t:02x}")])
    deps = F.array_sort(F.array_distinct(dependencies))
    args = F.unhex(F.array_join(F.transform(arguments, lambda a: F.concat(tag[a.getField("kind")], a.getField("id"))), ""))
    return digest_column(ns.domain("recipe"), F.unhex(transform), le(F.size(arguments)), args, le(F.size(deps)), F.unhex(F.array_join(deps, "")))


def artifact_id(transform: Column, backend: Column, version: Column, compiler: Column, target: Column, features: Column, optimization: Column, abi: Column, ns: Namespace = DEFAULT) -> Column:
    names = F.array_sort(features)
    listed = F.unhex(F.array_join(F.transform(names, lambda x: F.hex(framed(text_bytes(x)))), ""))
    strings = [framed(text_bytes(x)) for x in (backend, version, compiler, target)]
    return digest_column(ns.domain("artifact"), F.unhex(transform), *strings, le(F.size(names)), listed, framed(text_bytes(optimization)), le(abi, 4))


def bundle_id(artifacts: Column, ns: Namespace = DEFAULT) -> Column:
    return digest_column(ns.domain("artifact.bundle"), le(F.size(artifacts)), F.unhex(F.array_join(artifacts, "")))


def semantic_id(recipe: Column, source: Column, content: Column) -> Column:
    """Lineage identity before content identity."""
    return F.coalesce(recipe, source, content)


def is_identity(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{64}$")


# ---- single values ----------------------------------------------------------------------


def _framed(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + data


def _digest(domain: str, *parts: bytes) -> str:
    return hashlib.sha256(head(domain) + b"".join(parts)).hexdigest()


def raw_content(data: bytes, ns: Namespace = DEFAULT) -> str:
    return _digest(ns.domain("content.bytes"), _framed(data))


def content(kind: str, value: object = None, ns: Namespace = DEFAULT) -> str:
    """Typed Content ID. Lists take child ids, records a dict of child ids, floats their 32 bits."""
    if kind == "null":
        body = b""
    elif kind == "bool":
        body = bytes([bool(value)])
    elif kind == "integer":
        body = struct.pack("<q", value)
    elif kind == "float":
        body = struct.pack("<I", value)
    elif kind == "string":
        body = _framed(value.encode())
    elif kind == "bytes":
        body = _framed(value)
    elif kind == "fraction":
        body = struct.pack("<qQ", *value)
    elif kind == "buffer":
        shape, stride, data = value
        body = struct.pack(f"<Q{len(shape)}QQ", len(shape), *shape, stride) + _framed(data)
    elif kind == "list":
        body = struct.pack("<Q", len(value)) + b"".join(map(bytes.fromhex, value))
    elif kind == "record":
        body = struct.pack("<Q", len(value)) + b"".join(_framed(k.encode()) + bytes.fromhex(v) for k, v in sorted(value.items(), key=lambda x: x[0].encode()))
    else:
        raise ValueError(f"no content identity for {kind}")
    return _digest(ns.domain("content"), bytes([TAGS[kind]]), body)


def source(locator: str, content_: str, ns: Namespace = DEFAULT) -> str:
    return _digest(ns.domain("source"), _framed(locator.encode()), bytes.fromhex(content_))


def dependency(capability: str, key: bytes, content_: str, ns: Namespace = DEFAULT) -> str:
    return _digest(ns.domain("dependency"), _framed(capability.encode()), _framed(key), bytes.fromhex(content_))


def recipe(transform: str, arguments: Sequence[tuple[str, str]], dependencies: Iterable[str] = (), ns: Namespace = DEFAULT) -> str:
    deps = sorted(set(dependencies))
    args = b"".join(bytes([ARGUMENT_TAGS[kind]]) + bytes.fromhex(x) for kind, x in arguments)
    return _digest(ns.domain("recipe"), bytes.fromhex(transform), struct.pack("<Q", len(arguments)), args, struct.pack("<Q", len(deps)), b"".join(map(bytes.fromhex, deps)))


def artifact(transform: str, backend: str, version: str, compiler: str, target: str, features: Iterable[str], optimization: str, abi: int, ns: Namespace = DEFAULT) -> str:
    names = sorted(features)
    strings = b"".join(_framed(x.encode()) for x in (backend, version, compiler, target))
    return _digest(ns.domain("artifact"), bytes.fromhex(transform), strings, struct.pack("<Q", len(names)), b"".join(_framed(x.encode()) for x in names), _framed(optimization.encode()), struct.pack("<I", abi))


def bundle(artifacts: Sequence[str], ns: Namespace = DEFAULT) -> str:
    return _digest(ns.domain("artifact.bundle"), struct.pack("<Q", len(artifacts)), b"".join(map(bytes.fromhex, artifacts)))


def parse_identity(text: str) -> str:
    """The identity itself if it is 64 lower-case hexadecimal digits."""
    if not re.fullmatch(r"[0-9a-f]{64}", text):
        raise ValueError(f"not an identity: {text!r}")
    return text
