"""Profiles of an engine's parts, the fingerprints that tell what of an index can be kept, and the configuration in force.

Each fingerprint covers exactly what decides the rows it stands for. The space of vectors (model, dimension, metric)
decides which vectors can be compared; the recipe adds how texts are rendered; with corpus and lexical profile they make
the artifact's. Endpoints, query templates, limits and weights decide no rows and are in none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass

from inkwell.functions.hashing import hash_canonical
from inkwell.plans.settings import endpoint_class

SCHEMA_VERSION = 1


def _row(decides: bool = True, **limits):
    """A field that is (or isn't) part of its fingerprint, with its bounds: low and high, or one of."""
    return {"decides": decides} | limits


@dataclass(frozen=True)
class CorpusProfile:
    id: str = field(metadata=_row(False))
    includes: tuple[str, ...] = field(default=(), metadata=_row(False))
    excludes: tuple[str, ...] = field(default=(), metadata=_row(False))
    extensions: tuple[str, ...] = field(default=("md", "txt"), metadata=_row(False))
    extraction_version: int = field(default=1, metadata=_row(low=1))
    strategy: str = field(default="heading_blocks", metadata=_row(of=("heading_blocks", "semantic_blocks")))
    chunk_tokens: int = field(default=512, metadata=_row(low=32, high=8192))
    overlap_tokens: int = field(default=64, metadata=_row(low=0, high=2048))
    min_tokens: int = field(default=24, metadata=_row(low=1, high=2048))
    include_code: bool = field(default=True, metadata=_row())
    frontmatter_fields: tuple[str, ...] = field(default=(), metadata=_row())


@dataclass(frozen=True)
class LexicalProfile:
    id: str = field(metadata=_row(False))
    analyzer: str = field(default="unicode-multilingual", metadata=_row())
    analyzer_version: int = field(default=1, metadata=_row(low=1))
    ngram_min: int = field(default=2, metadata=_row(low=1, high=4))
    ngram_max: int = field(default=3, metadata=_row(low=1, high=6))
    nfkc: bool = field(default=True, metadata=_row())
    fold_accents: bool = field(default=True, metadata=_row())
    split_identifiers: bool = field(default=True, metadata=_row())


@dataclass(frozen=True)
class EmbeddingRecipe:
    id: str = field(metadata=_row(False))
    provider_id: str = field(default="", metadata=_row(False))
    model: str = field(default="", metadata=_row())
    dimension: int = field(default=0, metadata=_row(low=0, high=16384))
    pooling: str = field(default="", metadata=_row())
    normalize: bool = field(default=True, metadata=_row())
    metric: str = field(default="cosine", metadata=_row(of=("cosine", "dot", "l2")))
    document_template: str = field(default="{{title}}\n{{heading_path}}\n{{content}}", metadata=_row())
    renderer_version: int = field(default=1, metadata=_row(low=1))
    query_template: str = field(default="{{content}}", metadata=_row(False))

    def space(self) -> str:
        """Vectors of one space can be compared."""
        return hash_canonical({"space": [self.model, self.dimension, self.pooling, self.normalize, self.metric]})


@dataclass(frozen=True)
class ProviderProfile:
    id: str = field(metadata=_row(False))
    endpoint: str = field(default="", metadata=_row(False))
    timeout_ms: int = field(default=30_000, metadata=_row(False, low=1000, high=600_000))
    retries: int = field(default=3, metadata=_row(False, low=0, high=10))
    concurrency: int = field(default=2, metadata=_row(False, low=1, high=16))


@dataclass(frozen=True)
class RetrievalProfile:
    id: str = field(metadata=_row(False))
    artifact_id: str = field(default="", metadata=_row(False))
    mode: str = field(default="auto", metadata=_row(False, of=("auto", "exact", "lexical", "semantic", "hybrid")))
    limit: int = field(default=20, metadata=_row(False, low=1, high=200))
    exact_limit: int = field(default=50, metadata=_row(False, low=1, high=1000))
    lexical_limit: int = field(default=80, metadata=_row(False, low=1, high=1000))
    semantic_limit: int = field(default=80, metadata=_row(False, low=1, high=1000))
    aggregation: str = field(default="max", metadata=_row(False, of=("max", "top_mean")))
    max_per_source: int = field(default=2, metadata=_row(False, low=1, high=50))


@dataclass(frozen=True)
class Artifact:
    """An index: which profiles made it and with what fingerprint."""

    id: str
    corpus_id: str
    lexical_id: str
    recipe_id: str
    fingerprint: str = ""
    space: str = ""
    state: str = "building"


def checked(profile):
    """The profile, if all its fields are within their bounds."""
    for f in fields(profile):
        value, bounds = getattr(profile, f.name), f.metadata
        if ("of" in bounds and value not in bounds["of"]) or ("low" in bounds and not bounds["low"] <= value <= bounds.get("high", value)):
            raise ValueError(f"{f.name} out of range")
    if isinstance(profile, LexicalProfile) and profile.ngram_min > profile.ngram_max:
        raise ValueError("ngram_min above ngram_max")
    if isinstance(profile, ProviderProfile) and profile.endpoint:
        endpoint_class(profile.endpoint)
    return profile


def fingerprint(*profiles) -> str:
    """What the fields that decide rows say; of several profiles together the artifact's."""
    parts = [{type(p).__name__: {f.name: sorted(v) if isinstance(v := getattr(p, f.name), tuple) else v for f in fields(p) if f.metadata["decides"]}} for p in profiles if is_dataclass(p)]
    return hash_canonical(parts[0] if len(parts) == 1 else {"schema": SCHEMA_VERSION, "parts": [hash_canonical(x) for x in parts]})


@dataclass(frozen=True)
class Configuration:
    retrieval: RetrievalProfile
    artifact: Artifact | None = None
    corpus: CorpusProfile | None = None
    lexical: LexicalProfile | None = None
    recipe: EmbeddingRecipe | None = None
    provider: ProviderProfile | None = None

    def fingerprint(self) -> str:
        return fingerprint(*filter(None, (self.corpus, self.lexical, self.recipe)))


@dataclass(frozen=True)
class Registry:
    """All profiles there are, and which retrieval profile is in force."""

    retrievals: tuple[RetrievalProfile, ...]
    active: str
    artifacts: tuple[Artifact, ...] = ()
    corpora: tuple[CorpusProfile, ...] = ()
    lexicals: tuple[LexicalProfile, ...] = ()
    recipes: tuple[EmbeddingRecipe, ...] = ()
    providers: tuple[ProviderProfile, ...] = ()

    def check(self) -> Registry:
        """Unique ids in every list, and references that lead somewhere."""
        groups = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "active"}
        for name, group in groups.items():
            if len({x.id for x in group}) < len(group):
                raise ValueError(f"repeated ids among {name}")
            for x in group:
                if not isinstance(x, Artifact):
                    checked(x)
        known = {name: {x.id for x in group} for name, group in groups.items()}
        wanted = [("retrievals", self.active), *(("artifacts", r.artifact_id) for r in self.retrievals if r.artifact_id), *(("providers", r.provider_id) for r in self.recipes if r.provider_id)]
        wanted += [pair for a in self.artifacts for pair in (("corpora", a.corpus_id), ("lexicals", a.lexical_id), ("recipes", a.recipe_id))]
        if lost := [f"{name}: {key}" for name, key in wanted if key not in known[name]]:
            raise ValueError(f"references that lead nowhere: {lost}")
        return self

    def configuration(self) -> Configuration:
        """What is in force. Without an artifact the first profile of each kind stands in; a provider is the recipe's or none."""
        by_id = lambda group, key: next((x for x in group if x.id == key), None)
        retrieval = by_id(self.retrievals, self.active)
        if retrieval is None:
            raise ValueError("no retrieval profile is in force")
        artifact = by_id(self.artifacts, retrieval.artifact_id)
        pick = lambda group, key: by_id(group, key) or (group[0] if group else None)
        corpus, lexical, recipe = (pick(g, artifact and getattr(artifact, k)) for g, k in ((self.corpora, "corpus_id"), (self.lexicals, "lexical_id"), (self.recipes, "recipe_id")))
        return Configuration(retrieval, artifact, corpus, lexical, recipe, by_id(self.providers, recipe.provider_id) if recipe else None)


def swap(before: Configuration, after: Configuration, rebuild: Callable[[Configuration], object], apply: Callable[[Configuration], object]) -> str:
    """Go from one configuration to another: `rebuilt` if rows change (a new artifact and a full scan), `applied` if only what is live does, else `unchanged`."""
    if before == after:
        return "unchanged"
    if before.fingerprint() != after.fingerprint():
        rebuild(after)
        return "rebuilt"
    apply(after)
    return "applied"


def diagnostics(configuration: Configuration, statistics: dict[str, int], states: dict[str, int]) -> dict:
    """What a report of trouble may hold: fingerprints, kinds, numbers. No ids of notes, paths, names, addresses, keys or contents."""
    c = configuration
    return {
        "fingerprint": c.fingerprint(), "artifact_state": c.artifact.state if c.artifact else None, "mode": c.retrieval.mode, "metric": c.recipe.metric if c.recipe else None, "dimension": c.recipe.dimension if c.recipe else None,
        "endpoint": endpoint_class(c.provider.endpoint) if c.provider and c.provider.endpoint else None, "folders": len(c.corpus.includes) + len(c.corpus.excludes) if c.corpus else 0,
        "counts": {k: int(v) for k, v in sorted(statistics.items())}, "states": {k: int(v) for k, v in sorted(states.items()) if k in ("pending", "indexed", "failed", "stale")},
    }
