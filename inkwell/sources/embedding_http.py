"""An embedder that asks a service over HTTP, with every answer checked before it is used, and a probe of what a service can do."""

from __future__ import annotations

import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from inkwell.operators.semantic import EmbedError, status_error
from inkwell.plans.settings import endpoint_class

#: (url, body or None, headers, seconds) -> (status, retry-after, body)
Transport = Callable[[str, bytes | None, dict[str, str], float], tuple[int, str | None, bytes]]


def _urllib(url: str, body: bytes | None, headers: dict[str, str], timeout: float) -> tuple[int, str | None, bytes]:
    request = urllib.request.Request(url, data=body, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, None, answer.read()
    except urllib.error.HTTPError as error:
        return error.code, error.headers.get("retry-after"), b""


@dataclass(frozen=True)
class HttpEmbedder:
    """Texts to vectors by POST {base}/embeddings; base ends in /v1. It is picklable, so each task builds on its own copy.

    strict: smaller batches, and the answer has to name the very model. Otherwise the model's name may have a suffix.
    """

    base: str
    model: str = ""
    dimension: int = 0
    key: str = ""
    timeout: float = 30.0
    strict: bool = False
    health_path: str | None = None
    transport: Transport = _urllib

    def __post_init__(self):
        kind, parts = endpoint_class(self.base), urlsplit(self.base)
        if not parts.path.endswith("/v1") or parts.query or parts.fragment:
            raise ValueError("the address of an embedding service ends in /v1")
        if self.strict and (kind == "remote_plaintext" or not self.key or not self.model or self.dimension <= 0):
            raise ValueError("a strict embedder has a key, a model and a dimension, and no plain address but a local one")

    # Inputs of a request and characters of an input.
    @property
    def limits(self) -> tuple[int, int]:
        return (128, 8_192) if self.strict else (512, 32_768)

    def _headers(self) -> dict[str, str]:
        return {"content-type": "application/json"} | ({"authorization": f"Bearer {self.key}"} if self.key else {})

    def _ask(self, url: str, body: bytes | None) -> bytes:
        try:
            status, after, answer = self.transport(url, body, self._headers(), self.timeout)
        except TimeoutError as error:
            raise EmbedError("timeout", True) from error
        except OSError as error:
            raise EmbedError("provider", True) from error
        if not 200 <= status < 300:
            raise status_error(status, after)
        return answer

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return self.answer(texts)[0]

    def answer(self, texts: list[str]) -> tuple[list[list[float]], str]:
        """The vectors in the order of the texts, and the model that made them."""
        most, longest = self.limits
        if not 0 < len(texts) <= most or any(not 0 < len(t) <= longest for t in texts):
            raise EmbedError("input")
        body = json.dumps({"model": self.model or "default", "input": texts, "encoding_format": "float"}).encode()
        try:
            got = json.loads(self._ask(f"{self.base}/embeddings", body))
            rows = {int(x["index"]): [float(v) for v in x["embedding"]] for x in got["data"]}
            many, model = len(got["data"]), got.get("model")
        except (ValueError, KeyError, TypeError, AttributeError) as error:
            raise EmbedError("response") from error
        if self.model and ((self.strict and model != self.model) or (model is not None and not str(model).startswith(self.model))):
            raise EmbedError("model")
        width = self.dimension or len(next(iter(rows.values()), ()))
        if many != len(texts) or rows.keys() != set(range(len(texts))) or not width or any(len(v) != width or not all(map(math.isfinite, v)) for v in rows.values()):
            raise EmbedError("response")
        return [rows[i] for i in range(len(texts))], model or self.model

    def reaches(self, path: str) -> bool:
        try:
            self._ask(path, None)
        except EmbedError:
            return False
        return True


@dataclass(frozen=True)
class Probe:
    reachable: bool
    batch: bool = False
    dimension: int | None = None
    normalized: str = "unknown"  # l2, none or unknown
    model: str | None = None
    models_listed: bool = False
    health: str = "unsupported"  # ok, unavailable or unsupported
    error: str | None = None


def probe(service: HttpEmbedder) -> Probe:
    """What a service can do: batches, dimension, normalisation; asked with two texts, with one if two are refused."""
    root = service.base.removesuffix("/v1")
    health = "unsupported" if service.health_path is None else "ok" if service.reaches(f"{root}{service.health_path}") else "unavailable"
    listed, failed = service.reaches(f"{service.base}/models"), None
    for texts in (["first words to try", "second words to try"], ["first words to try"]):
        try:
            vectors, model = service.answer(texts)
        except EmbedError as error:
            failed = error.category
            continue
        size = math.sqrt(sum(x * x for x in vectors[0]))
        return Probe(True, len(texts) > 1, len(vectors[0]), "unknown" if size == 0 else "l2" if abs(size - 1) < 0.01 else "none", model, listed, health)
    return Probe(False, models_listed=listed, health=health, error=failed)
