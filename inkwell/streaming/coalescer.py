"""Vault events to tasks: rapid events on a path become one task, renames follow chains, generations tell stale work.

A micro-batch is a debounce window. Keys change along a rename chain, so events are grouped by the chain they belong
to (connected paths of the batch) and each chain is folded in order of seq. Generations of paths are kept in a state
table that each batch replaces by its next version.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.session import cut

TASKS = "kind string, path string, old_path string, generation long, dirty boolean"
_STATE = "path string, generation long"


def fold(events: Iterable[tuple[str, str, str | None]], generations: dict[str, int]) -> list[tuple[str, str, str | None, int, bool]]:
    """Events (kind, path, old_path) in order to tasks (kind, path, old_path, generation, dirty); generations are updated."""
    pending: dict[str, tuple[bool, str | None, bool]] = {}  # path -> deleted, renamed from, content dirty

    def bump(path: str) -> None:
        generations[path] = generations.get(path, 0) + 1

    for kind, path, old in events:
        if kind == "delete":
            origin = pending.get(path, (False, None, False))[1]
            if origin is not None:
                pending.pop(path)
                pending[origin] = (True, None, False)
                bump(origin)
            else:
                pending[path] = (True, None, False)
        elif kind == "rename" and old is not None:
            _, origin, dirty = pending.pop(old, (False, None, False))
            pending[path] = (False, origin or old, dirty)
            generations[path] = max(generations.get(old, 0), generations.get(path, 0))
        else:
            pending[path] = (False, pending.get(path, (False, None, False))[1], True)
        bump(path)
    out = []
    for path, (deleted, origin, dirty) in pending.items():
        g = generations.get(path, 0)
        if deleted:
            out.append(("delete", path, None, g, False))
        elif origin is not None and origin != path:
            out.append(("rename", path, origin, g, dirty))
        else:
            out.append(("upsert", path, None, g, True))
    return out


def chains(events: DataFrame, rounds: int = 50) -> DataFrame:
    """(path, chain): the smallest path each path of the batch is connected with by renames.

    Only paths that take part in a rename are walked, in both directions at once; pointers are halved each round, so
    rounds grow with the logarithm of the longest chain. Chains that aren't settled after `rounds` are an error.
    """
    links = events.where("kind = 'rename' and old_path is not null and old_path <> path").select(F.col("path").alias("a"), F.col("old_path").alias("b"))
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = both.groupBy(F.col("a").alias("path")).agg(F.least(F.col("path"), F.min("b")).alias("chain"))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("path", "b"), "b").groupBy(F.col("a").alias("path")).agg(F.min("chain").alias("near"))
        step = label.join(near, "path").select("path", F.col("chain").alias("old"), F.least("chain", "near").alias("to"))
        jump = step.join(label.select(F.col("path").alias("to"), F.col("chain").alias("further")), "to").select("path", F.least("to", "further").alias("chain"), "old")
        done = cut(jump, "chains")
        label = done.select("path", "chain")
        if not done.where("chain <> old").limit(1).count():
            break
    else:
        raise RuntimeError(f"chains of renames aren't settled after {rounds} rounds")
    paths = events.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()
    return paths.join(label, "path", "left").select("path", F.coalesce("chain", "path").alias("chain"))


def coalesce_batch(events: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks of one batch of (seq, kind, path, old_path) and the next state (path, generation).

    Null paths and unknown kinds are no events. Events repeated under one seq count once. Chains are short: what
    people rename within a debounce window; each is folded by one task.
    """
    fine = events.where("path is not null and kind in ('create', 'modify', 'delete', 'rename')").select("seq", "kind", "path", "old_path").dropDuplicates(["seq", "kind", "path"])
    label = chains(fine)
    grouped = fine.join(label, "path").select("chain", "seq", "kind", "path", "old_path", F.lit(None).cast("long").alias("generation"))
    known = state.join(label, "path").select("chain", F.lit(None).cast("long").alias("seq"), F.lit("state").alias("kind"), "path", F.lit(None).cast("string").alias("old_path"), "generation")

    columns = ["kind", "path", "old_path", "generation", "dirty", "is_state"]

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by chain, its state first; a chain may go on in the next batch."""
        rows = ((c, k, p, o if isinstance(o, str) else None, g) for pdf in batches for c, k, p, o, g in zip(pdf["chain"], pdf["kind"], pdf["path"], pdf["old_path"], pdf["generation"]))
        out: list[tuple] = []
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            own = list(own)
            generations = {p: int(g) for _, k, p, _, g in own if k == "state"}
            out += [(*t, False) for t in fold(((k, p, o) for _, k, p, o, _ in own if k != "state"), generations)]
            out += [("state", p, None, g, False, True) for p, g in generations.items()]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    ordered = grouped.unionByName(known).repartition("chain").sortWithinPartitions("chain", F.asc_nulls_first("seq"), "kind", "path")
    folded = cut(ordered.select("chain", "kind", "path", "old_path", "generation").mapInPandas(folds, TASKS + ", is_state boolean"), "folded")
    tasks = folded.where("not is_state").drop("is_state")
    seen = folded.where("is_state").select("path", "generation")
    return tasks, state.join(seen, "path", "left_anti").unionByName(seen)


def latest_tasks(tasks: DataFrame) -> DataFrame:
    """Of the tasks of a path only the one with the highest generation."""
    columns = [c for c in tasks.columns if c != "path"]
    best = tasks.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("generation", "kind")).alias("t"))
    return best.select("path", *[F.col(f"t.{c}").alias(c) for c in columns])


_EVENT = "seq long, kind string, path string, old_path string"
_NESTED = "seq: long, kind: string, path: string, old_path: string"


def debounce(events: DataFrame, quiet_ms: int = 400, vault: str | None = None) -> DataFrame:
    """A stream of (seq, kind, path, old_path) held back until no event has come for quiet_ms, then given out together, in order.

    The window is one for all paths of a vault (a column, if there are several), as a rename touches two; each event starts
    it anew. What is held is state of the stream, so it survives restarts. Events of a vault are few: what people do while
    they don't pause.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            rows = sorted({tuple(r) for r in held}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
            yield pd.DataFrame(rows, columns=["seq", "kind", "path", "old_path"])
            return
        for pdf in batches:
            held += [(None if pd.isna(a) else int(a), b, c, d if isinstance(d, str) else None) for a, b, c, d in zip(pdf["seq"], pdf["kind"], pdf["path"], pdf["old_path"])]
        state.update((held,))
        state.setTimeoutDuration(quiet_ms)

    keyed = events.select("seq", "kind", "path", "old_path", (F.lit("") if vault is None else F.col(vault)).alias("_vault"))
    return keyed.groupBy("_vault").applyInPandasWithState(hold, _EVENT, f"held array<struct<{_NESTED}>>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def read_events(spark: SparkSession, folder: str, form: str = "json") -> DataFrame:
    """A stream of (seq, kind, path, old_path) from files of events that are put into a folder. A change of metadata counts as a modification; unknown kinds are no events."""
    raw = spark.readStream.schema(_EVENT).format(form).option("recursiveFileLookup", "true").load(folder)
    kind = F.lower("kind")
    known = raw.withColumn("kind", F.when(kind.isin("metadata", "metadata_changed", "metadata-changed"), "modify").otherwise(kind))
    return known.where("path is not null and kind in ('create', 'modify', 'delete', 'rename')")


class Runner:
    """A stream of tasks that can be paused, resumed and closed. What arrives while it rests waits; the checkpoint knows where it was."""

    def __init__(self, start: Callable[[], StreamingQuery]):
        self._start, self._query, self.closed = start, None, False

    @property
    def running(self) -> bool:
        return self._query is not None and self._query.isActive

    def resume(self) -> None:
        """Start, or go on where the last run stopped; nothing happens if it runs."""
        if self.closed:
            raise RuntimeError("the stream is closed")
        if not self.running:
            self._query = self._start()

    def pause(self) -> None:
        """Stop between micro-batches; a batch that was begun is run again later."""
        if self._query is not None:
            self._query.stop()
            self._query = None

    def progress(self) -> dict:
        """Whether it runs, the last batch and how many rows it had; None before there was one."""
        last = self._query.lastProgress if self._query is not None else None
        return {"running": self.running, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else None}

    def close(self) -> None:
        self.pause()
        self.closed = True


def stream_tasks(spark: SparkSession, events: DataFrame, state_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], debounce: str = "400 milliseconds") -> StreamingQuery:
    """Run coalesce_batch on every micro-batch; sink(tasks, batch_id) must be idempotent by batch_id.

    The state of batch n lies in state_path/n: a batch that is run again after a failure starts from the same state.
    """

    def batch(df: DataFrame, n: int) -> None:
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(state_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = f"{state_path}/{n - 1}"
        state = spark.read.schema(_STATE).parquet(before) if fs.exists(fs_path(before + "/_SUCCESS")) else spark.createDataFrame([], _STATE)
        tasks, after = coalesce_batch(df, state)
        sink(tasks, n)
        after.write.mode("overwrite").parquet(f"{state_path}/{n}")
        if n > 2:
            fs.delete(fs_path(f"{state_path}/{n - 3}"), True)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=debounce).start()
