"""Append logs as streams: the commit queue, the record store, and test output as it is written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

from ..operators.evidence import log_events
from ..operators.record import corpus_only_commits
from ..operators.store import merge_into
from ..sources.readers import read_queue


def merge_batch(store: str, key: str, buckets: int = 64):
    """A foreachBatch function that merges a batch into the store: replaying a batch adds nothing."""

    def merge(batch: DataFrame, _epoch: int) -> None:
        merge_into(batch.sparkSession, store, batch, key, buckets=buckets)

    return merge


def merge_stream(records: DataFrame, store: str, checkpoint: str, key: str = "record_id", buckets: int = 64) -> StreamingQuery:
    """Arriving records merged into the store, idempotently; returns the running query (all that is there, then ends)."""
    writer = records.writeStream.foreachBatch(merge_batch(store, key, buckets)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def drain_queue(
    spark: SparkSession, folder: str, store: str, checkpoint: str, record: Callable[[DataFrame], DataFrame] | None = None, files: DataFrame | None = None,
    corpus: str = "corpus", buckets: int = 64,
) -> StreamingQuery:
    """Queued commit lines to recorded commits. The checkpoint is what is left in the queue: a line is forgotten only
    once its batch has been written, so an interrupted drain goes on where it stopped.

    Commits all of whose ``files`` (sha, path) are below the ``corpus`` folder are dropped. ``record`` turns the commits
    (sha) of a batch into records with a ``record_id``; without it the commits themselves are stored.
    """
    lines = spark.readStream.schema("value string").text(folder)
    shas, _ = read_queue(lines)
    key = "record_id" if record else "sha"
    merge = merge_batch(store, key, buckets)

    def drain(batch: DataFrame, epoch: int) -> None:
        todo = batch.select("sha").distinct()
        if files is not None:
            todo = todo.join(corpus_only_commits(files, corpus), "sha", "left_anti")
        merge(record(todo) if record else todo, epoch)

    return shas.writeStream.foreachBatch(drain).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


READING = "suite string, pos long, test string, outcome string, run_seconds double"
WAITING = "suites array<{0}>, places array<long>, tests array<string>, outcomes array<string>, known array<{0}>, lasts array<double>"
WHOLE = ("tinyint", "smallint", "int", "bigint")


def close_tests(whole: bool):
    """The fold of a group of suites, whose names are texts outside the state and, if ``whole``, integers in it."""
    named = lambda names: [None if pd.isna(s) else int(s) if whole else s for s in names]
    texts = lambda names: pd.Series([None if s is None else str(s) for s in names], dtype=object)

    def fold(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Folds the new lines of many suites: tests wait in the state until a result line tells or repeats a non-zero
        time of their suite."""
        suites, places, tests, outcomes, known, lasts = state.get if state.exists else ([], [], [], [], [], [])
        # What is known of a suite comes first, as a result line that tells nobody; then what waits, then the new lines.
        last = pd.DataFrame({"suite": texts(known), "time": pd.Series(lasts, dtype=float), "turn": 0})
        held = pd.DataFrame({"suite": texts(suites), "pos": pd.Series(places, dtype="int64"), "test": texts(tests), "outcome": texts(outcomes), "turn": 1})
        new = pd.concat(list(frames))[["suite", "pos", "test", "outcome", "result", "time"]].assign(turn=2)
        d = pd.concat([x for x in (last, held, new) if len(x)], ignore_index=True)
        for name in ("pos", "time", "test", "outcome", "result"):
            d[name] = d[name] if name in d else None
        d["pos"] = d["pos"].fillna(0).astype("int64")
        d["time"], d["result"] = d["time"].astype(float), d["result"].eq(True)
        d["code"] = pd.factorize(d["suite"], use_na_sentinel=False)[0]
        d = d.sort_values(["code", "turn", "pos"], kind="stable", ignore_index=True)
        told = d["time"].groupby(d["code"]).ffill().fillna(0.0)
        d["run_seconds"] = told.where(d["result"] & (told > 0)).groupby(d["code"]).bfill()
        rows = d[(d["turn"] > 0) & ~d["result"]]
        wait, done = rows[rows["run_seconds"].isna()], rows[rows["run_seconds"].notna()]
        ends = pd.DataFrame({"suite": d["suite"], "code": d["code"], "told": told}).drop_duplicates("code", keep="last")
        state.update((named(wait["suite"]), wait["pos"].tolist(), wait["test"].tolist(), wait["outcome"].tolist(), named(ends["suite"]), ends["told"].tolist()))
        if len(done):
            yield done[["suite", "pos", "test", "outcome", "run_seconds"]]

    return fold


def stream_test_log(lines: DataFrame, groups: int = 256) -> DataFrame:
    """Arriving lines (suite, pos, line) of test output to readings (suite, pos, test, outcome, run_seconds), each as soon
    as its suite's time is known: in the end, with ``waiting_tests``, the rows of ``read_test_log``.

    A suite's lines arrive in the order of their positions from batch to batch, in any order within one. The state of a
    suite is its last time and the tests that still wait; a query that starts again goes on from its checkpoint. Suites,
    named by integers or texts, are dealt by a hash to ``groups`` groups, which share a state and a call: the calls do not
    grow with the suites. ``groups`` can't change with a checkpoint.
    """
    kind = lines.schema["suite"].dataType.simpleString()
    held = kind if kind in WHOLE else "string"
    events = log_events(lines).select(F.col("suite").cast("string"), "pos", "test", "outcome", "result", "time")
    dealt = events.withColumn("_group", F.pmod(F.xxhash64("suite"), F.lit(groups)).cast("int")).groupBy("_group")
    done = dealt.applyInPandasWithState(close_tests(kind in WHOLE), READING, WAITING.format(held), "append", GroupStateTimeout.NoTimeout)
    return done.withColumn("suite", F.col("suite").cast(kind))


def waiting_tests(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Tests in the state of a stopped ``stream_test_log``, which no non-zero time has followed: their time is 0."""
    held = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    rows = held.select(F.explode(F.arrays_zip("suites", "places", "tests", "outcomes")).alias("x"))
    names = {"suite": "suites", "pos": "places", "test": "tests", "outcome": "outcomes"}
    return rows.select(*[F.col(f"x.{c}").alias(n) for n, c in names.items()], F.lit(0.0).alias("run_seconds"))
