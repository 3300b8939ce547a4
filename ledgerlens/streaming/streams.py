"""The event-driven operators on Structured Streaming. Late rows beyond the watermark are dropped, an extension of ours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlens.functions import params as p
from ledgerlens.operators.shared import shared_path
from ledgerlens.sources.views import to_signals


def read_stream(spark: SparkSession, sf_dir: str, name: str, files: int | None = 8) -> DataFrame:
    """A table as a stream of its files, so many a batch (None: all there are)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return (rows.option("maxFilesPerTrigger", files) if files else rows).parquet(f"{sf_dir}/{name}.parquet*")


def read_events(spark: SparkSession, sf_dir: str, files: int | None = 8) -> DataFrame:
    return read_stream(spark, sf_dir, "events", files)


def stream_scores(signals: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Scores of each entry in 30-day windows that slide by a day."""
    timed = signals.withColumn("time", F.col("at").cast("timestamp")).withWatermark("time", watermark)
    out = timed.groupBy(F.window("time", f"{p.WINDOW_DAYS} days", "1 day"), "entry_id").agg(F.sum("weight").alias("window_score"), F.count("*").alias("n"))
    return out.select(F.col("window.end").alias("window_end"), "entry_id", "window_score", "n")


def stream_doubts(doubts: DataFrame, threshold: int = p.DOUBT_THRESHOLD) -> DataFrame:
    """(key, escalations, open) of each key with new doubts: they are counted, and start anew when they reach the threshold."""
    return doubts.groupBy("key").agg(F.count("*").alias("n")).selectExpr("key", f"n div {int(threshold)} as escalations", f"n % {int(threshold)} as open")


#: Open doubts of a key: reset is the ledger row that last restarted the count, settled doubts are older than any row still to come.
_DOUBT_STATE = "reset long, settled long, recent array<struct<seq: long, at: double>>"


def track_doubts(ledger: DataFrame, threshold: int = p.DOUBT_THRESHOLD, watermark: str = "1 day", idle_days: int = p.WINDOW_DAYS) -> DataFrame:
    """(kind, key, open, due) of each key with new ledger rows (kind, key, type, seq, at): doubts since the last ``escalated`` row, due where they reach the threshold.

    Keyed state; rows may come in any order within the watermark, as ``seq`` decides. Doubts that the watermark has passed are kept as a
    count only, so a key's state holds no more than the rows of the watermark's span. A key without open doubts is forgotten
    ``idle_days`` after its last row. A key's row of the last batch that has one is its state.
    """
    rows = ledger.select("kind", F.col("key").cast("string").alias("key"), "type", F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", watermark)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reset, settled, recent = state.get if state.exists else (-1, 0, [])
        open_ = [(r[0], r[1]) for r in recent]
        newest = 0.0
        for f in frames:
            newest = max(newest, f["at"].max().timestamp())
            marks = f.loc[f["type"] == "escalated", "seq"]
            if len(marks) and int(marks.max()) > reset:
                reset = int(marks.max())
                settled = 0  # a row still to come is later than all that is settled
            found = f[f["type"] == "doubt"]
            open_ += [(int(s), t.timestamp()) for s, t in zip(found["seq"], found["at"])]
        open_ = [(s, t) for s, t in open_ if s > reset]
        passed = state.getCurrentWatermarkMs() / 1000
        settled += sum(t < passed for _, t in open_)
        open_ = [(s, t) for s, t in open_ if t >= passed]
        count = settled + len(open_)
        state.update((reset, settled, open_))
        if count == 0:
            state.setTimeoutTimestamp(max(int(newest * 1000), state.getCurrentWatermarkMs()) + idle_days * 86_400_000)
        yield pd.DataFrame({"kind": [key[0]], "key": [key[1]], "open": [count], "due": [count >= threshold]})

    return rows.groupBy("kind", "key").applyInPandasWithState(run, "kind string, key string, open long, due boolean", _DOUBT_STATE, "update", GroupStateTimeout.EventTimeTimeout)


_TURN_STATE = "last long, turn_nos array<long>, replies array<long>, chars array<long>"


def track_turns(turns: DataFrame, keep: int = 5, idle_minutes: int = 24 * 60) -> DataFrame:
    """(session_id, turn_no, replies, chars): the last ``keep`` turns of each session with new messages (session_id, turn, role, text).

    Keyed state; a turn begins with each message of the user. A session's messages come in order over batches (in any order within
    one); those seen before are passed over. A session is forgotten ``idle_minutes`` after its last message
    came in (by a watermark over arrival: a timeout of processing time would ask for batches without end). A session's rows of the last batch that has any are its state.
    """
    rows = turns.select(F.col("session_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), (F.col("role") == "user").alias("asked"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"), F.current_timestamp().alias("came")).withWatermark("came", "1 minute")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, *kept = state.get if state.exists else (-1, [], [], [])
        numbers, replies, chars = (list(x) for x in kept)
        new = pd.concat(list(frames)).sort_values(["turn", "asked", "size"])
        for turn, asked, size in zip(new["turn"], new["asked"], new["size"]):
            if turn <= last:
                continue
            last = int(turn)
            if asked or not numbers:
                numbers.append((numbers[-1] if numbers else 0) + int(bool(asked)))
                replies.append(0)
                chars.append(0)
            replies[-1] += int(not asked)
            chars[-1] += int(size)
        numbers, replies, chars = numbers[-keep:], replies[-keep:], chars[-keep:]
        state.update((last, numbers, replies, chars))
        state.setTimeoutTimestamp(max(int(new["came"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_minutes * 60_000)
        yield pd.DataFrame({"session_id": key[0], "turn_no": numbers, "replies": replies, "chars": chars})

    return rows.groupBy("session_id").applyInPandasWithState(run, "session_id string, turn_no long, replies long, chars long", _TURN_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of what keyed state has put out, batch by batch, each key's rows of its last batch."""
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"]).drop("batch")


def escalation_actions(counts: DataFrame, before: DataFrame, kind: str) -> DataFrame:
    """(key, action, times): what a batch of ``stream_doubts`` calls for beyond the escalations (key, escalations) seen before.

    A module is to be inspected from then on; an entry gets a rejection each time.
    """
    seen = before.select("key", F.col("escalations").alias("seen"))
    rows = counts.join(seen, "key", "left").withColumn("times", F.col("escalations") - F.coalesce("seen", F.lit(0)))
    return rows.filter("times > 0").select("key", F.lit("inspect" if kind == "module" else "user-reject").alias("action"), "times")


def stream_labels(log: DataFrame, signals: DataFrame, days: int = p.LABEL_DAYS, watermark: str = "1 day") -> DataFrame:
    """Signals within days after a logged candidate: an interval join of two streams."""
    rows = log.withColumn("row_time", F.col("at").cast("timestamp")).drop("at").withWatermark("row_time", watermark)
    marks = signals.select(F.col("entry_id").alias("signal_entry"), F.col("at").cast("timestamp").alias("signal_time"), "polarity").withWatermark("signal_time", watermark)
    near = F.expr(f"entry_id = signal_entry and signal_time >= row_time and signal_time <= row_time + interval {int(days)} days")
    return rows.join(marks, near).select("row_id", "entry_id", "row_time", "signal_time", "polarity")


def drain(stream: DataFrame, name: str, mode: str, path: str | None = None, numbered: bool = False) -> DataFrame:
    """Run a stream over all that is there and give what it put out: in mode complete the last batch, else all batches.

    Batches and state go to the shared checkpoint folder; a batch that runs again replaces its own files. A ``path``
    of an earlier run goes on where that one stopped. ``numbered`` adds each row's batch.
    """
    spark, path = stream.sparkSession, path or shared_path(stream.sparkSession, name)
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")
        last[:] = [number]

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    if not last:
        rows = spark.createDataFrame([], schema)
    elif mode == "complete":
        rows = spark.read.schema(stream.schema).parquet(f"{path}/batches/batch={last[0]}").withColumn("batch", F.lit(last[0]))
    else:
        rows = spark.read.schema(schema).parquet(f"{path}/batches")
    return rows if numbered else rows.drop("batch")


def span(spark: SparkSession, sf_dir: str) -> str:
    """A watermark under which no row of a finished table is late: the time between its first and last event."""
    first, last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts"), F.max("ts")).first()
    return f"{(last - first).days + 1} days" if last else "1 day"


def signals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_signals(read_events(spark, sf_dir))
