"""Content hashes in layers: what changed tells what has to be built anew. All are SHA-256 over canonical text."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no blanks; minus zero is zero; not-a-number and infinities are refused."""

    def clean(x: Any) -> Any:
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("only finite numbers can be hashed")
            return int(x) if x == int(x) else x
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def hash_canonical(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _hash(**parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def raw_content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def metadata_projection_hash(path: Column, title: Column, aliases: Column, tags: Column, frontmatter_json: Column, mtime_ms: Column, size: Column) -> Column:
    return _hash(path=path, title=title, aliases=aliases, tags=tags, frontmatter=frontmatter_json, mtime=mtime_ms, size=size)


def extraction_hash(version: int, strategy: str, chunks: Column) -> Column:
    return _hash(version=F.lit(version), strategy=F.lit(strategy), chunks=chunks)


def lexical_input_hash(analyzer: str, version: int, fingerprint: str, text: Column, heading_path: Column, title: Column, tags: Column, path: Column) -> Column:
    return _hash(analyzer=F.lit(analyzer), version=F.lit(version), fingerprint=F.lit(fingerprint), text=text, headings=heading_path, title=title, tags=tags, path=path)


def embedding_input_hash(rendered: Column) -> Column:
    return F.sha2(rendered, 256)


def row_id(artifact_id: Column, source_id: Column, anchor: Column, ordinal: Column) -> Column:
    return F.substring(_hash(artifact=artifact_id, source=source_id, anchor=anchor, ordinal=ordinal), 1, 32)
