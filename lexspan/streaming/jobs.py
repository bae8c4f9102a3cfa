"""Structured Streaming jobs. Event time is the producer's; watermarks are ten minutes, later rows are dropped.

Cell events are the exception: a late one is taken, but never lets an older event win over
a newer. Every sink can be replayed: what a batch writes depends on keys and event times,
not on how often it runs.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexspan.operators import ingest
from lexspan.operators.grid import newest
from lexspan.settings import DEFAULTS
from lexspan.sources import versions
from lexspan.sources.files import read_documents, replace_documents

LATE = "10 minutes"


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def work_dir(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir`` for a job's state and tables; a temporary folder where one machine has no such setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-jobs-")
    return f"{root.rstrip('/')}/jobs/{uuid.uuid4().hex}"


STAGES = ("chunk", "embed", "status")


def ingest_stream(
    pages: DataFrame, path: str, checkpoint: str, *, target: int = DEFAULTS.chunk_target_tokens, most: int = DEFAULTS.chunk_max_tokens, embedder: ingest.Embedder | None = None, dim: int = DEFAULTS.embed_dim, after: Callable[[str, int], None] | None = None
) -> StreamingQuery:
    """New pages to chunks, vectors and document status; a document that comes again replaces what it had.

    Every batch runs three stages, each written and noted in a ledger before the next one
    begins: a batch that broke off goes on behind its last stage when it is run again. Tables
    ``chunks`` and ``documents`` below ``path`` show a batch when all its stages are done.
    Vectors of unchanged chunks are taken over. ``after`` is called behind each stage.
    """
    spark = pages.sparkSession
    place = {n: f"{path}/{n}" for n in ("ledger", "pages", "drafts", "chunks", "documents")}
    call = after or (lambda stage, batch: None)

    def chunk(batch: DataFrame, version: int) -> None:
        versions.write(ingest.with_offsets(batch), place["pages"], version)
        versions.write(ingest.chunk_documents(versions.read(spark, place["pages"], version), target, most), place["drafts"], version)

    def embed(_: DataFrame, version: int) -> None:
        drafts = versions.read(spark, place["drafts"], version)
        if embedder is not None:
            drafts = ingest.embed_chunks(drafts, embedder, dim=dim, stored=versions.current(spark, place["chunks"], ingest.DOC, before=version))
        versions.write(drafts, place["chunks"], version)

    def status(_: DataFrame, version: int) -> None:
        rows = ingest.document_status(versions.read(spark, place["pages"], version), versions.read(spark, place["chunks"], version))
        versions.write(rows, place["documents"], version)
        for name in ("chunks", "documents"):
            versions.commit(spark, place[name], version)

    def each(batch: DataFrame, batch_id: int) -> None:
        done = versions.committed(spark, place["ledger"]).get(2 * batch_id, set())
        for stage, run in zip(STAGES, (chunk, embed, status), strict=True):
            if stage not in done:
                run(batch, 2 * batch_id)
                versions.commit(spark, place["ledger"], 2 * batch_id, stage)
                call(stage, batch_id)

    return run_available(pages, each, checkpoint)


def latest_cells(events: DataFrame, *keys: str) -> DataFrame:
    """Per key the newest event; the demo flag stays once set."""
    demo = events.groupBy(*keys).agg(F.bool_or("demo").alias("demo"))
    return newest(events.drop("demo"), list(keys), "event_time").join(demo, list(keys))


def cell_state_stream(events: DataFrame, path: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Cell events into a table of the newest state by key."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, 2 * batch_id
        rows = batch.select(*keys, "event_time", "status", "demo")
        old = read_documents(spark, path, "_key", before=version)
        if old is not None:
            rows = rows.unionByName(old.drop("_key").join(rows.select(*keys).distinct(), list(keys), "left_semi"))
        state = latest_cells(rows, *keys).withColumn("_key", F.concat_ws("\x1f", *keys))
        replace_documents(state, path, "_key", version)

    return run_available(events, each, checkpoint)


def run_progress(updates: DataFrame) -> DataFrame:
    """Cells done per run, never more than its total, the run's status, and the time of the update that completed it."""
    so_far = F.sum("n").over(Window.partitionBy("run_id").orderBy("event_time", "update_id").rowsBetween(Window.unboundedPreceding, 0))
    counted = updates.dropDuplicates(["run_id", "update_id"]).withColumn("_so_far", so_far)
    full = F.min(F.when(F.col("_so_far") >= F.col("total_cells"), F.col("event_time"))).alias("completed_at")
    done = counted.groupBy("run_id").agg(F.sum("n").alias("_n"), F.max("total_cells").alias("total_cells"), full)
    capped = F.least("_n", "total_cells")
    return done.select("run_id", "total_cells", capped.alias("done_cells"), _run_status(capped, F.col("total_cells")).alias("status"), "completed_at")


def _run_status(done: Column, total: Column) -> Column:
    return F.when(done >= total, "done").when(done > 0, "running").otherwise("queued")


PROGRESS = "run_id long, total_cells long, done_cells long, completed_at timestamp"


def run_progress_stream(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same from a stream of (run_id, update_id, event_time, n, total_cells) into a table of the newest state by run.

    The state of a run is its sum and the updates it has counted (at most as many as it has
    cells), so an update that is sent again counts once; a run that is done stays done.
    """

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, done, total, finished = state.get if state.exists else ([], 0, 0, None)
        seen, rows = list(seen), pd.concat(list(batches)).sort_values(["event_time", "update_id"])
        known = set(seen)
        for update, at, n, cells in zip(rows["update_id"].tolist(), rows["event_time"], rows["n"].tolist(), rows["total_cells"].tolist(), strict=True):
            total = max(total, cells)
            if update not in known and finished is None:
                known.add(update)
                seen.append(update)
                done += n
                if done >= total:
                    finished = at.to_pydatetime()
        state.update((seen if finished is None else [], done, total, finished))
        yield pd.DataFrame({"run_id": [key[0]], "total_cells": [total], "done_cells": [min(done, total)], "completed_at": pd.to_datetime([finished])})

    kept = "seen array<long>, done long, total long, finished timestamp"
    rows = updates.groupBy("run_id").applyInPandasWithState(advance, PROGRESS, kept, "update", "NoTimeout")

    def each(batch: DataFrame, batch_id: int) -> None:
        state = batch.withColumn("status", _run_status(F.col("done_cells"), F.col("total_cells")))
        replace_documents(state, path, "run_id", 2 * batch_id)

    return run_available(rows, each, checkpoint, "update")


def rate_windows(calls: DataFrame, requests: int = DEFAULTS.requests_per_minute, tokens: int = DEFAULTS.tokens_per_minute, *keys: str) -> DataFrame:
    """Requests and tokens of the sixty seconds up to each call; a call leaves at sixty seconds of age."""
    span = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-59_999_999, 0)
    rows = calls.withColumns({"requests": F.count(F.lit(1)).over(span), "tokens": F.sum("input_tokens").over(span)})
    return rows.withColumn("over", (F.col("requests") > requests) | (F.col("tokens") > tokens))


SPAN = 60_000_000


def rate_stream(calls: DataFrame, path: str, checkpoint: str, requests: int = DEFAULTS.requests_per_minute, tokens: int = DEFAULTS.tokens_per_minute, key: str = "user_id") -> StreamingQuery:
    """The same from a stream of (call_id, ts, ``key``, input_tokens), exactly, into a table by call.

    The state of a key is its calls that a later one may still count: those younger than the
    watermark less sixty seconds, in order of time. A late call is counted where it belongs;
    calls within sixty seconds behind it are given out again with their new sums.
    """

    def advance(keys, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        ids, at, used = (list(x) for x in state.get) if state.exists else ([], [], [])
        fresh = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        ids, at, used = np.array(ids + rows["call_id"].tolist(), np.int64), np.concatenate([np.array(at, np.int64), fresh]), np.array(used + rows["input_tokens"].fillna(0).tolist(), np.int64)
        order = np.argsort(at, kind="stable")
        ids, at, used = ids[order], at[order], used[order]
        low, high = np.searchsorted(at, at - SPAN, "right"), np.searchsorted(at, at, "right")
        total = np.concatenate([[0], np.cumsum(used)])
        first = np.sort(fresh)
        touched = np.searchsorted(first, at, "right") > np.searchsorted(first, at - SPAN, "right")  # a new call lies in their sixty seconds
        alive = at > state.getCurrentWatermarkMs() * 1000 - SPAN
        state.update((ids[alive].tolist(), at[alive].tolist(), used[alive].tolist()))
        yield pd.DataFrame({"call_id": ids[touched], key: keys[0], "requests": (high - low)[touched], "tokens": (total[high] - total[low])[touched]})

    kind = dict(calls.dtypes)[key]
    held = calls.withWatermark("ts", LATE).groupBy(key).applyInPandasWithState(advance, f"call_id long, {key} {kind}, requests long, tokens long", "ids array<long>, at array<long>, used array<long>", "update", "NoTimeout")

    def each(batch: DataFrame, batch_id: int) -> None:
        replace_documents(batch.withColumn("over", (F.col("requests") > requests) | (F.col("tokens") > tokens)), path, "call_id", 2 * batch_id)

    return run_available(held, each, checkpoint, "update")


#: What a backslash and a letter stand for in JSON.
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_STOP = re.compile(r'["\\]')


class AnswerDecoder:
    """Decodes the text of the first string field ``answer`` of a JSON text that comes in pieces.

    ``mode`` is where the text stands: between strings, in some other string, behind a
    backslash there, in the answer, or behind it. ``held`` is what the mode needs to remember,
    never more than twelve characters: the beginning of a string that may be the key, whether the key or its colon
    has come, or an escape of the answer that is not whole yet.
    """

    SEEK, STRING, SKIP, ANSWER, DONE = range(5)
    NAME = "answer"

    def __init__(self, mode: int = 0, held: str = ""):
        self.mode, self.held = mode, held

    def feed(self, piece: str) -> str:
        """What ``piece`` adds to the answer."""
        out, at = [], 0
        while at < len(piece) and self.mode != self.DONE:
            at = (self._between, self._inside, self._skipped, self._answer)[self.mode](piece, at, out)
        return "".join(out)

    def _between(self, piece: str, at: int, out: list) -> int:
        c = piece[at]
        if c == '"':
            self.mode, self.held = (self.ANSWER, "") if self.held == "value" else (self.STRING, "")
        elif c == ":" and self.held == "key":
            self.held = "value"
        elif not c.isspace():
            self.held = ""
        return at + 1

    def _to_stop(self, piece: str, at: int) -> int:
        found = _STOP.search(piece, at)
        return found.start() if found else len(piece)

    def _inside(self, piece: str, at: int, out: list) -> int:
        stop = self._to_stop(piece, at)
        self.held = (self.held + piece[at : min(stop, at + len(self.NAME) + 1)])[: len(self.NAME) + 1]
        if stop < len(piece) and piece[stop] == '"':
            self.mode, self.held = self.SEEK, "key" if self.held == self.NAME else ""
        elif stop < len(piece):
            self.mode, self.held = self.SKIP, "\\" * (len(self.NAME) + 1)  # a key with an escape is another key
        return stop + 1

    def _skipped(self, piece: str, at: int, out: list) -> int:
        self.mode = self.STRING
        return at + 1

    def _answer(self, piece: str, at: int, out: list) -> int:
        if self.held:
            self.held += piece[at]
            self._escape(out)
            return at + 1
        stop = self._to_stop(piece, at)
        out.append(piece[at:stop])
        if stop < len(piece):
            self.mode, self.held = (self.DONE, "") if piece[stop] == '"' else (self.ANSWER, "\\")
        return stop + 1

    def _escape(self, out: list) -> None:
        """Writes the held escape once it is whole; halves of a pair wait for each other, a lone half is unreadable."""
        held = self.held
        if held[1] != "u":
            out.append(ESCAPES.get(held[1], held[1]))
            self.held = ""
            return
        if len(held) < 6:
            return
        code = _hex(held[2:6])
        if not 0xD800 <= code < 0xDC00:
            out.append("\ufffd" if 0xDC00 <= code < 0xE000 else chr(code))
            self.held = ""
        elif not "\\u".startswith(held[6:8]):
            rest, self.held = held[6:], ""
            out.append("\ufffd" + self.feed(rest))
        elif len(held) == 12:
            low = _hex(held[8:12])
            if 0xDC00 <= low < 0xE000:
                out.append(chr(0x10000 + ((code - 0xD800) << 10) + (low - 0xDC00)))
                self.held = ""
            else:
                out.append("\ufffd")
                self.held = ""
                out.append(self.feed(held[6:]))


def _hex(digits: str) -> int:
    try:
        return int(digits, 16)
    except ValueError:
        return 0xFFFD


def in_order(frames: list[pd.DataFrame]) -> str:
    """The pieces of one message in the order of ``seq``, as one text: it decodes to what they decode to one by one."""
    seq, delta = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("seq", "delta"))
    return "".join(delta[np.argsort(seq, kind="stable")])


def answer_field_stream(deltas: DataFrame) -> DataFrame:
    """What each batch adds to the answer of a message: (message_id, at, text, done), ``at`` the characters before it.

    ``deltas`` are (message_id, seq, delta, event_time). The state of a message is where its
    decoder stands, some twenty bytes however long the answer is; it goes when the answer is
    whole or nothing has come for ten minutes.
    """

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mode, held, length = state.get if state.exists else (0, "", 0)
        decoder, frames = AnswerDecoder(mode, held), list(batches)
        text = decoder.feed(in_order(frames))
        state.update((decoder.mode, decoder.held, length + len(text)))
        latest = max(t for f in frames if (t := f["event_time"].max()) is not pd.NaT)
        state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + 600_000)
        yield pd.DataFrame({"message_id": [key[0]], "at": [length], "text": [text], "done": [decoder.mode == decoder.DONE]})

    return deltas.withWatermark("event_time", LATE).groupBy("message_id").applyInPandasWithState(advance, "message_id string, at long, text string, done boolean", "mode int, held string, length long", "update", "EventTimeTimeout")


def answers(parts: DataFrame) -> DataFrame:
    """The answer of each message from the parts that the stream gave out."""
    whole = parts.groupBy("message_id").agg(F.array_sort(F.collect_set(F.struct("at", "text", "done"))).alias("p"))
    return whole.select("message_id", F.array_join(F.col("p")["text"], "").alias("answer"), F.array_max(F.col("p")["done"]).alias("done"))


def batch_poll(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Targets of submitted requests (custom_id, document_id, column_id) with their outcome; missing ones fail."""
    joined = plan.join(results, "custom_id", "left")
    failed = F.col("error").isNotNull() | F.col("text").isNull()
    return joined.select("custom_id", "document_id", "column_id", F.when(failed, "failed").otherwise("done").alias("status"), F.when(failed, F.coalesce("error", F.lit("no result for this request"))).alias("error"))


#: Errors of cells.
MISSING, NO_ANSWER = "missing from batch output", "model returned no answer for this question"


def batch_answers(plan: DataFrame, results: DataFrame, failed: DataFrame) -> DataFrame:
    """One row a cell of a batch: run_id, document_id, column_id, answered (its request has a result), status, error and the answer.

    ``plan`` (run_id, custom_id, document_id, column_ids) are the submitted requests, whose
    columns are labelled q1, q2 ... in order; ``results`` come from ``parse_answers``;
    ``failed`` (run_id, detail) are batches that failed as a whole. Answers to labels that
    were not asked drop out; of several answers to one label the last one counts.
    """
    asked = plan.select("run_id", "custom_id", "document_id", F.posexplode("column_ids").alias("_i", "column_id")).withColumn("label", F.concat(F.lit("q"), (F.col("_i") + 1).cast("string")))
    outcome = results.select("custom_id", F.col("error").alias("_error"), F.lit(True).alias("_came"), F.col("answers").alias("_answers"))
    mine = F.filter("_answers", lambda a: a["column_id"] == F.col("label"))
    own = asked.join(outcome, "custom_id", "left").withColumn("a", F.get(mine, F.size(mine) - 1)).drop("_answers")
    rows = own.join(failed.select("run_id", "detail"), "run_id", "left")
    error = (
        F.when(F.col("detail").isNotNull(), F.concat(F.lit("batch "), "detail"))
        .when(F.col("_came").isNull(), MISSING)
        .when(F.col("_error").isNotNull(), F.col("_error"))
        .when(F.col("a").isNull(), NO_ANSWER)
    )
    answered = F.col("detail").isNull() & F.col("_came").isNotNull() & F.col("_error").isNull()
    good = error.isNull()
    fields = [F.when(good, F.col(f"a.{c}")).alias(c) for c in ("value", "quotes", "confidence", "not_found")]
    return rows.select("run_id", "document_id", "column_id", answered.alias("answered"), F.when(good, "done").otherwise("failed").alias("status"), error.alias("error"), *fields)


def batch_runs(answers: DataFrame, failed: DataFrame) -> DataFrame:
    """Per run its cells, those whose request was answered, and its status."""
    counts = answers.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_cells"), F.count_if("answered").alias("done_cells"))
    rows = counts.join(failed.select("run_id", "detail"), "run_id", "left")
    return rows.select("run_id", "total_cells", "done_cells", F.when(F.col("detail").isNull(), "done").otherwise("failed").alias("status"), F.col("detail").alias("error"))


def dedupe_stream(registrations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The first registration (created_at, then id) of each content in a matter, into a table.

    A batch keeps the first of its own registrations of a content, unless the table has the
    content already: the table, not a watermark, remembers what was registered, so a
    registration that comes late is still a duplicate. A batch that runs again writes the same
    version again.
    """
    key = ["matter_id", "sha256"]

    def each(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy(*key).agg(F.min(F.struct("created_at", "document_id")).alias("f")).select(*key, "f.document_id", "f.created_at")
        stored = versions.current(batch.sparkSession, path, *key, before=2 * batch_id)
        if stored is not None:
            first = first.join(stored.select(*key), key, "left_anti")
        versions.replace(first, path, *key, version=2 * batch_id)

    return run_available(registrations, each, checkpoint)
