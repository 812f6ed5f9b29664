"""Pinned and hidden notes, kept in a small JSON file; they order and filter results and change nothing else."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from inkwell.session import small


class FeedbackStore:
    """A file that is missing, unreadable or of another version counts as empty; `was_reset` tells if one was given up."""

    def __init__(self, path: str):
        self.path, self.was_reset = path, False
        self.pinned: set[str] = set()
        self.hidden: set[str] = set()
        try:
            with open(path, encoding="utf-8") as f:
                kept = json.load(f)
            if kept["version"] != 1 or not all(isinstance(x, str) for x in [*kept["pinned"], *kept["hidden"]]):
                raise ValueError("another version")
            self.pinned, self.hidden = set(kept["pinned"]), set(kept["hidden"])
        except FileNotFoundError:
            pass
        except (ValueError, KeyError, TypeError):
            self.was_reset = True

    def mark(self, source_id: str, pinned: bool | None = None, hidden: bool | None = None) -> None:
        """Set or take back either mark, and keep it."""
        for wanted, marked in ((pinned, self.pinned), (hidden, self.hidden)):
            if wanted is not None:
                (marked.add if wanted else marked.discard)(source_id)
        tmp = f"{self.path}.new"
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump({"version": 1, "pinned": sorted(self.pinned), "hidden": sorted(self.hidden)}, f)
        os.replace(tmp, self.path)

    def table(self, spark: SparkSession) -> DataFrame:
        """(source_id, pinned, hidden), as connections take it."""
        return small(spark, [(s, s in self.pinned, s in self.hidden) for s in sorted(self.pinned | self.hidden)], "source_id string, pinned boolean, hidden boolean")
