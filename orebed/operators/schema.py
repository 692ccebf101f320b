"""Tables of the catalog, their keys, references and constraints."""

from __future__ import annotations

TABLES = {
    "contents": "content_id string, byte_length bigint, relative_path string, kind string",
    "content_value_kinds": "content_id string, kind string",
    "source_assets": "source_id string, locator string, content_id string",
    "source_heads": "locator string, source_id string, seq bigint",
    "lineage_invocations": "recipe_id string, transform_id string, transform_name string",
    "lineage_arguments": "recipe_id string, argument_index int, argument_name string, semantic_kind string, semantic_id string, recorded_kind string, recorded_text string, recorded_content_id string, parent_kind string, parent_id string",
    "external_observations": "dependency_id string, capability string, observation_key binary, observed_content_id string",
    "invocation_observations": "recipe_id string, observation_index int, dependency_id string",
    "recipe_results": "recipe_id string, content_id string, rendered_trace string",
    "world_snapshots": "dependency_id string, content_id string",
    "artifact_bundles": "bundle_id string, backend string, backend_version string, compiler string, target string, features array<string>, optimization string, abi int",
    "artifacts": "artifact_id string, transform_id string",
    "artifact_bundle_members": "bundle_id string, artifact_index int, artifact_id string",
    "schema_migrations": "version int, name string",
    "objects": "content_id string, data binary",  # payloads, apart from all metadata
}
KEYS = {
    "contents": ["content_id"], "content_value_kinds": ["content_id"], "source_assets": ["source_id"], "source_heads": ["locator"], "lineage_invocations": ["recipe_id"],
    "lineage_arguments": ["recipe_id", "argument_index"], "external_observations": ["dependency_id"], "invocation_observations": ["recipe_id", "observation_index"],
    "recipe_results": ["recipe_id"], "world_snapshots": ["dependency_id"], "artifact_bundles": ["bundle_id"], "artifacts": ["artifact_id"],
    "artifact_bundle_members": ["bundle_id", "artifact_index"], "schema_migrations": ["version"], "objects": ["content_id"],
}
UNIQUE = {"contents": [["relative_path"]], "source_assets": [["locator", "content_id"]], "invocation_observations": [["recipe_id", "dependency_id"]]}
FOREIGN_KEYS = (
    ("content_value_kinds", ["content_id"], "contents", ["content_id"]),
    ("source_assets", ["content_id"], "contents", ["content_id"]),
    ("source_heads", ["locator", "source_id"], "source_assets", ["locator", "source_id"]),
    ("lineage_arguments", ["recipe_id"], "lineage_invocations", ["recipe_id"]),
    ("invocation_observations", ["recipe_id"], "lineage_invocations", ["recipe_id"]),
    ("invocation_observations", ["dependency_id"], "external_observations", ["dependency_id"]),
    ("recipe_results", ["recipe_id"], "lineage_invocations", ["recipe_id"]),
    ("recipe_results", ["content_id"], "contents", ["content_id"]),
    ("world_snapshots", ["dependency_id"], "external_observations", ["dependency_id"]),
    ("world_snapshots", ["content_id"], "contents", ["content_id"]),
    ("artifact_bundle_members", ["bundle_id"], "artifact_bundles", ["bundle_id"]),
    ("artifact_bundle_members", ["artifact_id"], "artifacts", ["artifact_id"]),
)
#: SQL conditions that every row fulfils.
CHECKS = {
    "contents": ["content_id rlike '^[0-9a-f]{64}$'", "byte_length >= 0", "kind in ('raw', 'bytes')"],
    "content_value_kinds": ["kind = 'buffer'"],
    "source_assets": ["source_id rlike '^[0-9a-f]{64}$'"],
    "lineage_arguments": ["semantic_kind in ('content', 'source', 'recipe')", "(parent_kind is null) = (parent_id is null)", "parent_kind is null or parent_kind in ('source', 'recipe')"],
}
NULLABLE = {"recorded_text", "recorded_content_id", "parent_kind", "parent_id"}
MIGRATIONS = ((1, "contents and sources"), (2, "value kinds"), (3, "lineage"), (4, "results"), (5, "artifacts"), (6, "world snapshots"), (7, "transform name order"))
#: Where identities of each domain are named.
DOMAINS = {
    "transform": (("lineage_invocations", "transform_id", None), ("artifacts", "transform_id", None)),
    "source": (("source_assets", "source_id", None), ("lineage_arguments", "semantic_id", "source")),
    "recipe": (("lineage_invocations", "recipe_id", None), ("lineage_arguments", "semantic_id", "recipe")),
    "content": (("contents", "content_id", None), ("lineage_arguments", "semantic_id", "content")),
}
EXECUTION_TABLES = ("contents", "source_assets", "source_heads", "lineage_invocations", "external_observations", "recipe_results", "world_snapshots")
