"""Explicit access to the world: environment, files, HTTP and assets, by grants only."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import EngineError
from ..functions import identity as ids

HTTP_LIMIT, HTTP_SECONDS = 64 << 20, 30
#: The name under which each operation is recorded.
RECORDED = {"env.read": "environment", "file.read": "file.read", "http.get": "http.get", "asset": "asset"}


@dataclass(frozen=True)
class Grants:
    environment: frozenset[str] = frozenset()
    retain_environment: frozenset[str] = frozenset()
    file_roots: tuple[Path, ...] = ()
    http_prefixes: tuple[str, ...] = ()

    @staticmethod
    def load(config: Mapping, base: Path) -> Grants:
        """Grants of a parsed [world] table; the workspace's own folder is granted."""
        unknown = set(config) - {"environment", "retain_environment", "file_roots", "http_prefixes"}
        if unknown:
            raise EngineError(f"unknown world settings: {', '.join(sorted(unknown))}")
        env, keep = frozenset(config.get("environment", ())), frozenset(config.get("retain_environment", ()))
        if not keep <= env:
            raise EngineError("retained environment names must be granted")
        prefixes = tuple(config.get("http_prefixes", ()))
        if any(not p.startswith(("http://", "https://")) for p in prefixes):
            raise EngineError("HTTP prefixes must begin with http:// or https://")
        roots = [base.resolve()]
        for r in config.get("file_roots", ()):
            path = (base / r).resolve()
            if not path.is_dir():
                raise EngineError(f"file root {r!r} is no folder")
            roots.append(path)
        return Grants(env, keep, tuple(roots), prefixes)

    def confined(self, path: str, base: Path) -> Path:
        """The canonical path, which must lie below a granted root."""
        real = (base / path).resolve(strict=True)
        if not any(real.is_relative_to(root) for root in self.file_roots):
            raise EngineError(f"{path!r} is outside the granted folders")
        return real


def fetch_http(url: str) -> bytes:
    import urllib.request

    class NoRedirect(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):
            raise EngineError("redirects are not granted")

    with urllib.request.build_opener(NoRedirect).open(url, timeout=HTTP_SECONDS) as reply:
        data = reply.read(HTTP_LIMIT + 1)
    if len(data) > HTTP_LIMIT:
        raise EngineError("HTTP response exceeds the limit")
    return data


@dataclass
class World:
    """Observes on the driver and remembers every observation of one invocation."""

    grants: Grants = field(default_factory=Grants)
    base: Path = Path(".")
    assets: Callable[[str], bytes] | None = None
    fetch: Callable[[str], bytes] = fetch_http
    environ: Mapping[str, str] = field(default_factory=lambda: os.environ)
    namespace: ids.Namespace = ids.DEFAULT

    def raw(self, operation: str, key: str) -> bytes:
        if operation == "asset":
            if self.assets is None:
                raise EngineError("no host reads assets here")
            return self.assets(key)
        if operation == "env.read":
            if key not in self.grants.environment:
                raise EngineError(f"environment name {key!r} is not granted")
            if key not in self.environ:
                raise EngineError(f"environment name {key!r} is not set")
            return self.environ[key].encode()
        if operation == "file.read":
            return self.grants.confined(key, self.base).read_bytes()
        if operation == "http.get":
            if not any(key.startswith(p) for p in self.grants.http_prefixes):
                raise EngineError(f"URL {key!r} is not granted")
            return self.fetch(key)
        raise EngineError(f"unknown capability {operation!r}")

    def observe(self, operation: str, key: str, seen: dict) -> bytes:
        """Bytes now; the same key must read the same within one invocation."""
        data = self.raw(operation, key)
        content = ids.raw_content(data, self.namespace)
        capability = RECORDED[operation]
        if seen.setdefault((capability, key.encode()), (content, data))[0] != content:
            raise EngineError(f"{operation} {key!r} changed within one invocation")
        return data


class SnapshotWorld(World):
    """Serves retained observations only; assets stay live."""

    def __init__(self, retained: Mapping[tuple[str, bytes], bytes], live: World) -> None:
        super().__init__(live.grants, live.base, live.assets, live.fetch, live.environ, live.namespace)
        self.retained = retained

    def raw(self, operation: str, key: str) -> bytes:
        if operation == "asset":
            return super().raw(operation, key)
        try:
            return self.retained[RECORDED[operation], key.encode()]
        except KeyError:
            raise EngineError(f"no snapshot of {operation} {key!r}") from None


def parse_i64(data: bytes) -> int:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        raise EngineError("environment value is not UTF-8") from None
    if not re.fullmatch(r"[+-]?[0-9]+", text) or not -(2**63) <= int(text) < 2**63:
        raise EngineError(f"environment value {text!r} is no i64")
    return int(text)
