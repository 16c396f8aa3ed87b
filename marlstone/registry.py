"""Registry of operators by name and family: a manifest for users, and one place to look a function up."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Plugin:
    name: str
    family: str
    capabilities: tuple[str, ...] = ()
    enabled: bool = True
    handler: Callable | None = None


class Registry:
    """Plugins by their name in any case; a later one of a name takes the place of the earlier."""

    def __init__(self, plugins: Iterable[Plugin] = ()):
        self._plugins: dict[str, Plugin] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: Plugin) -> Plugin:
        key = plugin.name.strip().lower()
        if not key:
            raise ValueError("a plugin needs a name")
        self._plugins[key] = plugin
        return plugin

    def get(self, name: str) -> Plugin | None:
        return self._plugins.get(name.strip().lower())

    def list(self, family: str | None = None, enabled_only: bool = False) -> list[Plugin]:
        found = (p for p in self._plugins.values() if (family is None or p.family.lower() == family.strip().lower()) and (p.enabled or not enabled_only))
        return sorted(found, key=lambda p: (p.family.lower(), p.name.lower()))

    def manifest(self, spark: SparkSession) -> DataFrame:
        """name, family, capabilities and enabled of every plugin, one row each."""
        rows = [(p.name, p.family, list(p.capabilities), p.enabled, p.handler is not None) for p in self.list()]
        return spark.createDataFrame(rows, "name string, family string, capabilities array<string>, enabled boolean, callable boolean")


def default_registry() -> Registry:
    """The operators of this package that stand by themselves; what needs a local model or runner is registered and disabled."""
    from .functions import map_text, text, timeparse
    from .operators import assessment, candidates, case_tables, casework, components, custody, gazetteer, pixels, relations, rules, travel

    return Registry([
        Plugin("map_signals", "map", ("coordinates", "addresses", "plus codes"), handler=map_text.map_signals),
        Plugin("place_matches", "map", ("aliases", "levels"), handler=gazetteer.match_places),
        Plugin("geo_candidates", "map", ("candidates", "ranking"), handler=candidates.rank_candidates),
        Plugin("claim_rows", "forensics", ("claims", "confidence"), handler=assessment.claim_rows),
        Plugin("hash_chain", "forensics", ("custody",), handler=custody.verify_chain),
        Plugin("pixel_profile", "vision", ("low bits", "transparency", "fingerprints"), handler=pixels.profile),
        Plugin("time_anchors", "timeline", ("file names", "texts", "conflicts"), handler=timeparse.time_assessment),
        Plugin("travel", "timeline", ("impossible travel", "scenes"), handler=travel.impossible_travel),
        Plugin("redaction", "privacy", ("kinds", "audit"), handler=text.redact),
        Plugin("package_signature", "export", ("root", "hmac"), handler=custody.package_root),
        Plugin("launch_gate", "export", ("blockers", "score"), handler=rules.launch_gate),
        Plugin("compare_cases", "enterprise", ("shared values",), handler=relations.shared_values),
        Plugin("duplicate_clusters", "enterprise", ("relations", "components"), handler=components.components),
        Plugin("validation", "validation", ("checks", "pass rate"), handler=casework.validation),
        Plugin("relationships", "enterprise", ("duplicates", "devices", "days"), handler=case_tables.relationships),
        Plugin("local_model", "ai", ("summary",), enabled=False),
        Plugin("local_vision", "vision", ("objects",), enabled=False),
    ])


def register_functions(spark: SparkSession) -> list[str]:
    """Scalar functions that SQL needs by name and has no form of: their names in this session."""
    from .operators.pixels import byte_entropy

    spark.udf.register("byte_entropy", lambda raw: None if raw is None else byte_entropy(bytes(raw)), "double")
    return ["byte_entropy"]
