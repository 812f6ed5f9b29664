"""Validated settings, fingerprints that decide what can be reused, and redacted diagnostics."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from urllib.parse import urlsplit

from inkwell.functions.hashing import hash_canonical


def endpoint_class(url: str) -> str:
    """local, remote_https or remote_plaintext; refuses what is no plain web address."""
    u = urlsplit(url)
    if u.scheme not in ("http", "https") or not u.hostname or u.username or u.password:
        raise ValueError("an endpoint is an http or https address without credentials")
    if u.hostname in ("localhost", "::1") or u.hostname.startswith("127."):
        return "local"
    return "remote_https" if u.scheme == "https" else "remote_plaintext"


@dataclass(frozen=True)
class Corpus:
    extensions: tuple[str, ...] = ("md", "txt")
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    chunk_tokens: int = 512
    overlap_tokens: int = 64
    min_tokens: int = 24
    include_code: bool = True

    def check(self) -> None:
        if not 32 <= self.chunk_tokens <= 8192 or not 0 <= self.overlap_tokens < self.chunk_tokens or not 0 <= self.min_tokens <= self.chunk_tokens:
            raise ValueError("chunk sizes out of range")


@dataclass(frozen=True)
class Lexical:
    ngram_min: int = 2
    ngram_max: int = 3
    nfkc: bool = True

    def check(self) -> None:
        if not 1 <= self.ngram_min <= self.ngram_max <= 8:
            raise ValueError("n-gram sizes out of range")


@dataclass(frozen=True)
class Embedding:
    model: str = ""
    endpoint: str = ""
    dimension: int = 0
    template: str = "{{title}}\n{{heading_path}}\n{{content}}"
    query_template: str = "{{content}}"

    def check(self) -> None:
        if not 0 <= self.dimension <= 16384:
            raise ValueError("dimension out of range")
        if self.endpoint:
            endpoint_class(self.endpoint)


@dataclass(frozen=True)
class Settings:
    corpus: Corpus = field(default_factory=Corpus)
    lexical: Lexical = field(default_factory=Lexical)
    embedding: Embedding = field(default_factory=Embedding)

    def check(self) -> Settings:
        for part in (self.corpus, self.lexical, self.embedding):
            part.check()
        return self

    def fingerprint(self) -> str:
        """Everything that decides index rows; endpoints and query templates don't."""
        e = self.embedding
        return hash_canonical({"corpus": asdict(self.corpus), "lexical": asdict(self.lexical), "embedding": [e.model, e.dimension, e.template]})

    def diagnostics(self) -> dict:
        """What may be shown: no paths, addresses or contents."""
        return {"fingerprint": self.fingerprint(), "dimension": self.embedding.dimension, "has_endpoint": bool(self.embedding.endpoint), "folders": len(self.corpus.include) + len(self.corpus.exclude), "chunk_tokens": self.corpus.chunk_tokens}


def _build(kind, data: dict):
    names = {f.name: f for f in fields(kind)}
    if unknown := set(data) - set(names):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def parse_settings(data: dict) -> Settings:
    return Settings(_build(Corpus, data.get("corpus", {})), _build(Lexical, data.get("lexical", {})), _build(Embedding, data.get("embedding", {}))).check()


class SettingsStore:
    """Settings in a JSON file; unreadable or invalid ones are replaced by defaults, and listeners hear of changes."""

    def __init__(self, path: str):
        self.path, self.listeners, self.was_reset = path, [], False
        try:
            with open(path) as f:
                self.current = parse_settings(json.load(f))
        except FileNotFoundError:
            self.current = Settings()
        except (ValueError, TypeError, AttributeError):
            self.current, self.was_reset = Settings(), True

    def update(self, **parts) -> bool:
        """Replace parts; True if the index has to be built anew."""
        new = replace(self.current, **parts).check()
        rebuild = new.fingerprint() != self.current.fingerprint()
        tmp = f"{self.path}.new"
        with open(tmp, "w") as f:
            json.dump(asdict(new), f)
        os.replace(tmp, self.path)
        self.current = new
        for listener in self.listeners:
            listener(new, rebuild)
        return rebuild
