"""A workspace: the catalog's tables on storage, grants, plugins, runs and replays."""

from __future__ import annotations

import importlib.util
import os
import tomllib
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .functions import buffers
from .functions import identity as ids
from .operators import catalog, lineage, schema
from .operators.checkpoints import checkpointer
from .plans import lower, runtime
from .plans.runtime import Argument, Engine, Invocation, Observation, Outer, Registry, Results, Source
from .sources import files
from .sources.world import Grants, SnapshotWorld, World

CONFIG, VERSION_FILE = "workspace.toml", "catalog_version"
LATEST = schema.MIGRATIONS[-1][0]


class Workspace:
    """Tables below ``root``/catalog as Parquet. One writer at a time, like the catalog's own transactions."""

    def __init__(self, spark: SparkSession, root: str | Path, namespace: ids.Namespace = ids.DEFAULT) -> None:
        self.spark, self.root, self.namespace = spark, Path(root), namespace
        self.base = self.root / "catalog"
        config = self.root / CONFIG
        settings = tomllib.loads(config.read_text()) if config.exists() else {}
        self.grants = Grants.load(settings.get("world", {}), self.root)
        self.registry = Registry(namespace)
        for manifest in settings.get("plugins", {}).get("manifests", ()):
            load_plugin(self.registry, self.root, manifest)
        self.migrate()

    # -- storage --

    @staticmethod
    def init(spark: SparkSession, root: str | Path, **kw) -> Workspace:
        Path(root, "catalog").mkdir(parents=True, exist_ok=True)
        return Workspace(spark, root, **kw)

    @staticmethod
    def discover(start: str | Path) -> Path:
        """The nearest folder upwards that holds a catalog."""
        for folder in (Path(start).resolve(), *Path(start).resolve().parents):
            if (folder / "catalog" / VERSION_FILE).exists():
                return folder
        raise EngineError(f"no workspace at or above {start}")

    def migrate(self) -> None:
        mark = self.base / VERSION_FILE
        version = int(mark.read_text()) if mark.exists() else 0
        if version > LATEST:
            raise EngineError(f"catalog version {version} is newer than {LATEST}")
        if version < LATEST:
            for name in schema.TABLES:
                (self.base / name).mkdir(parents=True, exist_ok=True)
            rows = [(v, n) for v, n in schema.MIGRATIONS if v > version]
            self.append({"schema_migrations": self.spark.createDataFrame(rows, schema.TABLES["schema_migrations"])})
            mark.write_text(str(LATEST))

    def table(self, name: str) -> DataFrame:
        parts = sorted(str(p) for p in (self.base / name).glob("batch-*"))
        reader = self.spark.read.schema(schema.TABLES[name])
        df = reader.parquet(*parts) if parts else self.spark.createDataFrame([], schema.TABLES[name])
        if name == "source_heads":  # a log of imports; the newest entry counts
            return catalog.heads(df)
        return df

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schema.TABLES}

    def append(self, rows: dict[str, DataFrame]) -> None:
        """All rows or none: batches are staged, then moved into place."""
        stage = self.base / f".stage-{uuid.uuid4().hex}"
        moves = []
        for name, df in rows.items():
            df.select(*[c.split()[0] for c in schema.TABLES[name].split(", ")]).write.parquet(str(stage / name))
            number = len(list((self.base / name).glob("batch-*"))) if (self.base / name).exists() else 0
            moves.append((stage / name, self.base / name / f"batch-{number:08}"))
        for source, target in moves:
            target.parent.mkdir(parents=True, exist_ok=True)
            os.rename(source, target)
        stage.rmdir()

    def insert(self, rows: dict[str, DataFrame]) -> None:
        """New rows by key; a known key with other values is an error."""
        new = {}
        for name, df in rows.items():
            if name == "source_heads":
                new[name] = df
                continue
            key, known = schema.KEYS[name], self.table(name)
            columns = [c for c in df.columns if c not in key and c not in ("data", "rendered_trace", "transform_name", "features")]
            bad = catalog.conflicts(known, df, key, columns).limit(1).collect() if columns else []
            if bad:
                raise EngineError(f"incompatible metadata for {name} {tuple(bad[0])}")
            new[name] = catalog.insert_or_ignore(known, df, key)
        self.append(new)

    def rows(self, name: str, values: Iterable[tuple]) -> DataFrame:
        return self.spark.createDataFrame(list(values), schema.TABLES[name])

    # -- imports and reads --

    def import_paths(self, paths: list[str], recursive: bool = False) -> list[tuple[str, str]]:
        """Imports files in order; returns (locator, source_id)."""
        found = files.expand([Path(p) for p in paths], recursive)
        base = self.table("source_heads").agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        listing = [(files.locator(p), i + base) for i, p in enumerate(found)]
        return self._import(files.read_files(self.spark, found, [n for _, n in listing]))

    def import_bytes(self, locator: str, data: bytes) -> tuple[str, str]:
        base = self.table("source_heads").agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        return self._import(self.spark.createDataFrame([(locator, bytearray(data), base)], "locator string, data binary, seq bigint"))[0]

    def _import(self, assets: DataFrame) -> list[tuple[str, str]]:
        rows = catalog.import_rows(assets, self.namespace)
        self.insert(rows)
        seen = catalog.observed(assets, self.namespace).orderBy("seq").select("locator", "source_id").collect()
        return [(r.locator, r.source_id) for r in seen]

    def read_source(self, locator: str) -> bytes:
        """Bytes of the current version, proven by length and identity."""
        t = self.tables()
        got = catalog.assets(t).where(F.col("locator") == locator).join(t["objects"], "content_id").limit(1).collect()
        if not got:
            raise EngineError(f"no asset {locator!r}")
        r = got[0]
        if len(r.data) != r.byte_length or ids.raw_content(bytes(r.data), self.namespace) != r.content_id:
            raise EngineError(f"content {r.content_id} does not match its identity")
        return bytes(r.data)

    def read_content(self, content_id: str) -> tuple[str, bytes]:
        """(kind, stored bytes), proven by the identity of the kind."""
        t = self.tables()
        got = catalog.contents(t).where(F.col("content_id") == content_id).join(t["objects"], "content_id").limit(1).collect()
        if not got:
            raise EngineError(f"no content {content_id}")
        kind, data = got[0].kind, bytes(got[0].data)
        actual = self.typed(kind, data).content(self.namespace) if kind != "raw" else ids.raw_content(data, self.namespace)
        if actual != content_id:
            raise EngineError(f"content {content_id} does not match its identity")
        return kind, data

    def typed(self, kind: str, data: bytes) -> Outer:
        if kind == "buffer":
            shape, stride, raw = buffers.decode_storage(data, self.namespace.language)
            return Outer("buffer", (tuple(shape), stride, raw))
        return Outer("bytes", data)

    def materialize(self, content_id: str, target: str | Path) -> None:
        files.publish(Path(target), self.read_content(content_id)[1])

    # -- runs --

    def world(self) -> World:
        return World(self.grants, self.root, self.read_source, namespace=self.namespace)

    def results(self) -> Results:
        return StoredResults(self)

    def engine(self, world: World | None = None, save: Callable[[str, bytes], None] | None = None) -> Engine:
        matches = lambda domain, prefix: [r.id for r in catalog.id_matches(self.tables(), domain, prefix).collect()]
        return Engine(world or self.world(), self.registry, self.results(), save or (lambda name, data: files.publish(self.root / name, data)), matches, self.namespace)

    def run(self, source: str, record: tuple[str, ...] = (), stock: bool = False) -> dict:
        """Runs a program; afterwards records chosen bindings and, if asked, all reachable intermediates."""
        if len(set(record)) < len(record):
            raise EngineError("a binding is recorded twice")
        engine = self.engine()
        done = engine.run(source)
        recorded = {}
        for name in record:
            if name not in done.bindings:
                raise EngineError(f"no binding `{name}` to record")
            recorded[name] = self.record(done.bindings[name], engine)
        stocked = []
        if stock:
            for recipe, node in runtime.stockable(done):
                value = engine.results.values.get(engine.results.contents.get(recipe))
                if value is not None and value.kind in ("bytes", "buffer"):
                    self.record(Outer(value.kind, value.value, node), engine)
                    stocked.append(recipe)
        plan = [(n, t.id, *lower.strategy(engine.module, n)) for n, t in engine.module.transforms.items()]
        return {"last": done.last, "bindings": done.bindings, "recorded": recorded, "stocked": stocked, "hits": engine.results.hits, "misses": engine.results.misses, "plan": plan}

    def pipeline(self, expression: str) -> dict:
        """Evaluates one expression and records its result if it is an invocation's bytes or buffer."""
        runtime.parse_expression(expression)
        engine = self.engine()
        done = engine.run(expression)
        recipe = self.record(done.last, engine) if isinstance(done.last.lineage, Invocation) and done.last.kind in ("bytes", "buffer") else None
        return {"last": done.last, "recipe": recipe, "hits": engine.results.hits, "misses": engine.results.misses}

    def record(self, value: Outer, engine: Engine) -> str:
        """Stores a result with its whole lineage."""
        if value.kind not in ("bytes", "buffer") or not isinstance(value.lineage, Invocation):
            raise EngineError("only bytes and buffers made by transforms can be recorded")
        content = value.content(self.namespace)
        data = value.value if value.kind == "bytes" else buffers.encode_storage(list(value.value[0]), value.value[1], value.value[2], self.namespace.language)
        path = f"objects/{content[:2]}/{content[2:]}"
        rows = runtime.lineage_rows(value.lineage)
        frames = {name: self.rows(name, r) for name, r in rows.items() if r and name != "source_assets"}
        frames["contents"] = self.rows("contents", [(content, len(data), path, "bytes")])
        frames["objects"] = self.rows("objects", [(content, bytearray(data))])
        if value.kind == "buffer":
            frames["content_value_kinds"] = self.rows("content_value_kinds", [(content, "buffer")])
        frames["recipe_results"] = self.rows("recipe_results", [(value.lineage.recipe, content, runtime.render(value.lineage))])
        snapshots = self.snapshot_rows(value.lineage, engine.world)
        if snapshots:
            frames["world_snapshots"] = self.rows("world_snapshots", [(d, c) for d, c, _ in snapshots])
            frames["contents"] = frames["contents"].union(self.rows("contents", [(c, len(b), f"objects/{c[:2]}/{c[2:]}", "raw") for _, c, b in snapshots])).dropDuplicates(["content_id"])
            frames["objects"] = frames["objects"].union(self.rows("objects", [(c, bytearray(b)) for _, c, b in snapshots])).dropDuplicates(["content_id"])
        self.insert(frames)
        return value.lineage.recipe

    def snapshot_rows(self, root: Invocation, world: World) -> list[tuple[str, str, bytes]]:
        """Observations to retain: files and HTTP always, environment by permission."""
        out = []
        for n in runtime.ancestors_first(root):
            if isinstance(n, Observation) and (n.capability != "environment" or n.key_bytes.decode() in self.grants.retain_environment):
                data = world.raw({"environment": "env.read"}.get(n.capability, n.capability), n.key_bytes.decode())
                if ids.raw_content(data, self.namespace) == n.content:
                    out.append((n.id, n.content, data))
        return out

    # -- stored lineage --

    def stored_lineage(self, recipe: str) -> Invocation:
        """Rebuilds a derivation from the tables and proves every identity in it."""
        t = self.tables()
        keep = self.spark.createDataFrame([(recipe,)], "recipe_id string")
        if t["lineage_invocations"].where(F.col("recipe_id") == recipe).isEmpty():
            raise EngineError(f"no recipe {recipe}")
        up = lineage.ancestors(t["lineage_arguments"], keep, keep=checkpointer(self.spark))
        wanted = up.select(F.col("id").alias("recipe_id")).distinct()
        calls = {r.recipe_id: r for r in t["lineage_invocations"].join(wanted, "recipe_id", "left_semi").collect()}
        args: dict[str, list] = {}
        for r in t["lineage_arguments"].join(wanted, "recipe_id", "left_semi").orderBy("recipe_id", "argument_index").collect():
            args.setdefault(r.recipe_id, []).append(r)
        seen: dict[str, list] = {}
        observations = t["invocation_observations"].join(wanted, "recipe_id", "left_semi").join(t["external_observations"], "dependency_id")
        for r in observations.orderBy("recipe_id", "observation_index").collect():
            seen.setdefault(r.recipe_id, []).append(r)
        used = t["lineage_arguments"].join(wanted, "recipe_id", "left_semi").where("parent_kind = 'source'").select(F.col("parent_id").alias("source_id")).distinct()
        sources = {r.source_id: r for r in t["source_assets"].join(used, "source_id", "left_semi").collect()}

        built: dict[str, Invocation] = {}  # a shared parent is built and proven once

        def build(id_: str, path: tuple[str, ...]) -> Invocation:
            if id_ in path or len(path) > lineage.MAX_DEPTH:
                raise EngineError("stored lineage holds a cycle or is too deep")
            if id_ in built:
                return built[id_]
            parts = []
            for i, r in enumerate(args.get(id_, [])):
                if r.argument_index != i:
                    raise EngineError(f"arguments of {id_} are not contiguous")
                parent = None
                if r.parent_kind == "recipe":
                    parent = build(r.parent_id, (*path, id_))
                elif r.parent_kind == "source":
                    s = sources[r.parent_id]
                    if ids.source(s.locator, s.content_id, self.namespace) != s.source_id:
                        raise EngineError(f"source {s.source_id} does not match its identity")
                    parent = Source(s.locator, s.content_id, s.source_id)
                parts.append(Argument(r.argument_name, r.semantic_kind, r.semantic_id, (r.recorded_kind, r.recorded_content_id or r.recorded_text), parent))
            deps = tuple(Observation(r.capability, bytes(r.observation_key), r.observed_content_id, r.dependency_id) for r in seen.get(id_, []))
            call = calls[id_]
            if ids.recipe(call.transform_id, [(a.kind, a.id) for a in parts], [d.id for d in deps], self.namespace) != id_:
                raise EngineError(f"recipe {id_} does not match its identity")
            built[id_] = Invocation(call.transform_name, call.transform_id, id_, tuple(parts), deps)
            return built[id_]

        return build(recipe, ())

    def result(self, recipe: str) -> Outer:
        got = self.table("recipe_results").where(F.col("recipe_id") == recipe).limit(1).collect()
        if not got:
            raise EngineError(f"no result of recipe {recipe}")
        kind, data = self.read_content(got[0].content_id)
        value = self.typed(kind, data)
        return Outer(value.kind, value.value, self.stored_lineage(recipe))

    def trace(self, recipe: str) -> str:
        """The stored rendering, after its content is proven."""
        got = self.table("recipe_results").where(F.col("recipe_id") == recipe).limit(1).collect()
        if not got:
            raise EngineError(f"no result of recipe {recipe}")
        self.read_content(got[0].content_id)
        return got[0].rendered_trace

    def expression(self, recipe: str, start: str | None = None) -> str:
        return runtime.expression(self.stored_lineage(recipe), start)

    def replay(self, recipe: str, source: str = "", snapshot: bool = False) -> Outer:
        """Strict: the world is read again. Snapshot: retained observations stand for it."""
        value, world = self.result(recipe), self.world()
        if snapshot:
            t = self.tables()
            seen = [(n.id,) for n in runtime.ancestors_first(value.lineage) if isinstance(n, Observation)]
            used = self.spark.createDataFrame(seen, "dependency_id string")  # of this derivation only
            kept = t["world_snapshots"].join(used, "dependency_id", "left_semi").join(t["external_observations"], "dependency_id").join(t["objects"], "content_id").collect()
            world = SnapshotWorld({(r.capability, bytes(r.observation_key)): bytes(r.data) for r in kept}, world)
        engine = Engine(world, self.registry, self.results(), None, None, self.namespace)
        engine.run(source)
        return engine.replay(value, world)

    # -- inspection --

    def assets(self, limit: int = 100, cursor: str | None = None, prefix: str | None = None) -> dict:
        return catalog.page(catalog.where_all(catalog.assets(self.tables()), catalog.starts_with("locator", prefix)), "locator", limit, cursor)

    def recipes(self, limit: int = 100, cursor: str | None = None, transform: str | None = None) -> dict:
        df = catalog.recipes(self.tables())
        return catalog.page(df.where(F.col("transform_name") == transform) if transform else df, "recipe_id", limit, cursor)

    def search(self, query: str, limit: int = 100) -> dict:
        a, r = catalog.search(self.tables(), query)
        return {"assets": catalog.page(a, "locator", limit), "recipes": catalog.page(r, "recipe_id", limit)}

    def stats(self) -> dict:
        return {r.table_name: r.row_count for r in catalog.table_counts(self.tables()).collect()}

    def info(self) -> dict:
        return {"version": catalog.schema_version(self.table("schema_migrations")).first()[0], "foreign_keys": True, "journal": "staged batches"}

    def summary(self, limit: int = 10) -> dict:
        names = [t.name for t in self.registry.listing()]
        return {"stats": self.stats(), "assets": self.assets(limit), "recipes": self.recipes(limit), "transforms": names[:limit], "transforms_truncated": len(names) > limit}

    def inspect_content(self, content_id: str) -> dict:
        t = self.tables()
        row = catalog.contents(t).where(F.col("content_id") == content_id).limit(1).collect()
        if not row:
            raise EngineError(f"no content {content_id}")
        refs = catalog.reference_counts(t).where(F.col("content_id") == content_id).first()
        out = {**row[0].asDict(), "source_count": refs.source_count, "recipe_count": refs.recipe_count, "valid": True, "error": None}
        try:
            self.read_content(content_id)
        except EngineError as e:
            out |= {"valid": False, "error": str(e)}
        return out

    def inspect_recipe(self, recipe: str) -> dict:
        root = self.stored_lineage(recipe)
        got = self.table("recipe_results").where(F.col("recipe_id") == recipe).limit(1).collect()
        return {"recipe": recipe, "transform": root.transform, "name": root.name, "arguments": [a.id for a in root.arguments], "observations": [o.id for o in root.observations], "lineage": runtime.render(root), "content": got[0].content_id if got else None}

    def inspect_artifact(self, id_: str) -> dict:
        """A bundle, or the bundle of an artifact, with its members proven by their identities."""
        t = self.tables()
        member = t["artifact_bundle_members"].where(F.col("artifact_id") == id_).limit(1).collect()
        bundle = member[0].bundle_id if member else id_
        if not catalog.broken_sequences(t["artifact_bundle_members"].where(F.col("bundle_id") == bundle), "bundle_id", "artifact_index").isEmpty():
            raise EngineError(f"members of {bundle} are not contiguous")
        members = t["artifact_bundle_members"].where(F.col("bundle_id") == bundle).join(t["artifacts"], "artifact_id").orderBy("artifact_index").collect()
        if not members or ids.bundle([m.artifact_id for m in members], self.namespace) != bundle:
            raise EngineError(f"no valid artifact bundle {id_}")
        return {"bundle": bundle, "artifacts": [(m.artifact_id, m.transform_id) for m in members]}

    def verify(self, limit: int = catalog.PAGE_LIMIT, cursor: str | None = None) -> dict:
        """Totals, and a page of issues with the cursor of the next page, so that every issue can be read."""
        t = self.tables()
        out = catalog.verify(t, self.namespace, self.namespace.language).first().asDict()
        issues = catalog.page(catalog.object_issues(t, self.namespace, self.namespace.language), "content_id", limit, cursor)
        return out | {"issues": issues["rows"], "issues_truncated": issues["truncated"], "issues_cursor": issues["next_cursor"]}

    def transforms(self, origin: str | None = None) -> list[dict]:
        return [{"name": r.name, "origin": r.origin, "version": r.version, "signature": r.signature(), "id": r.id, "abi": r.abi, "module": r.module_content} for r in self.registry.listing() if origin in (None, r.origin)]


class StoredResults(Results):
    """Results of this run first, then the workspace's own, both proven before use."""

    def __init__(self, workspace: Workspace) -> None:
        super().__init__(workspace.namespace)
        self.workspace = workspace

    def lookup(self, recipe: str) -> Outer | None:
        if recipe not in self.contents:
            w = self.workspace
            got = w.table("recipe_results").where(F.col("recipe_id") == recipe).limit(1).collect()
            if got:
                try:
                    value = w.typed(*w.read_content(got[0].content_id))
                    self.contents[recipe], self.values[got[0].content_id] = got[0].content_id, value
                except EngineError:
                    self.invalidations += 1
        return super().lookup(recipe)


FIELDS = {"name", "semantic_version", "abi_version", "module", "module_content", "result", "parameters"}


def load_plugin(registry: Registry, root: Path, manifest: str) -> None:
    """A manifest with exactly its seven fields; the module is a Python file whose ``run`` is the transform."""
    path = files.inside(root, root / manifest, 1 << 20)
    data = tomllib.loads(path.read_text())
    if set(data) != FIELDS or any(set(p) != {"name", "type"} for p in data["parameters"]):
        raise EngineError(f"{manifest}: fields must be {', '.join(sorted(FIELDS))}")
    module = files.inside(root, path.parent / data["module"], 64 << 20)
    code = module.read_bytes()
    if ids.raw_content(code, registry.namespace) != data["module_content"]:
        raise EngineError(f"{manifest}: module content does not match")
    spec = importlib.util.spec_from_file_location(f"plugin_{uuid.uuid4().hex}", module)
    loaded = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(loaded)
    registry.register(data["name"], loaded.run, [(p["name"], p["type"]) for p in data["parameters"]], data["result"], data["semantic_version"], code, data["module_content"], data["abi_version"])
