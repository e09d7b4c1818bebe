"""A running campaign as streams: traces, merged results, timeouts, totals and worker status."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from safespan.operators import clean, gp
from safespan.operators.acquire import decide
from safespan.operators.design import focus_candidates, uniform_candidates
from safespan.operators.ingest import content_state, scan_traces
from safespan.operators.sequence import boundary_shift, hysteresis_state, next_phases
from safespan.scenario import FOCUS_POINTS, Scenario
from safespan.session import materialize, shared_dir
from safespan.streaming.store import BatchStore, missing


def watch(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear under path."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def watch_traces(spark: SparkSession, path: str, files_per_trigger: int | None = None, archive: str | None = None) -> DataFrame:
    """Evaluation traces that appear in a folder of whole files, with loop_num and state. Writers rename finished files
    into the folder, so half-written ones aren't seen. The stream's checkpoint knows the files it has had; those are moved
    to the folder `archive`, if given, which must not lie within the path."""
    reader = spark.readStream.option("pathGlobFilter", "*.json")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    text = reader.text(path, wholetext=True)  # the argument overrides an option
    files = text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))
    return scan_traces(files).withColumn("state", content_state(F.col("content")))


def dedup(stream: DataFrame, time: str, delay: str, key: str = "loop_num") -> DataFrame:
    """The first row of each key; rows of the same key within the delay are dropped, and state goes after it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


_OUT = "loop_num long, status string, dx0 double, ego_speed double, npc_speed double, c_collision int, c_ttc_0_5 int, at double"


_ROW = Row(*[x.split()[0] for x in _OUT.split(", ")])


class Merge(StatefulProcessor):
    """The parameters in wait of one run, and a timer for when they get too old."""

    def __init__(self, seconds: int, status: str, labels: int | None):
        self.seconds, self.status, self.labels = seconds, status, labels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "dx0 double, ego_speed double, npc_speed double, at double")

    def due(self, held: tuple) -> int:
        """The first millisecond in which parameters are too old."""
        return round((held[3] + self.seconds) * 1000) + 1

    def leave(self, run: int, held: tuple) -> Row:
        return self.row(run, self.status, held, self.labels, self.labels, held[3] + self.seconds)

    def row(self, run: int, status: str, held: tuple | None, *rest) -> Row:
        return _ROW(run, status, *(held[:3] if held else (None,) * 3), *rest)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = held = self.waiting.get()
        for x in sorted(rows, key=lambda x: (x.at, x.kind, x.seq)):
            if held and x.at - held[3] > self.seconds:
                yield self.leave(key[0], held)
                held = None
            if x.kind == 0:
                held = (x.dx0, x.ego_speed, x.npc_speed, x.at)
            else:
                yield self.row(key[0], "merged" if held else "orphan", held, x.c_collision, x.c_ttc_0_5, x.at)
                held = None
        if held and self.due(held) <= timerValues.getCurrentWatermarkInMs():
            yield self.leave(key[0], held)
            held = None
        if held == before:
            return  # also where parameters came and were taken in one batch: no state, no timer
        if before:
            self.handle.deleteTimer(self.due(before))
        if held:
            self.waiting.update(held)
            self.handle.registerTimer(self.due(held))
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self.waiting.get()
        if held and self.due(held) <= expiredTimerInfo.getExpiryTimeInMs():
            self.waiting.clear()
            yield self.leave(key[0], held)

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """State of many keys lies in RocksDB, whose changes alone are written with each batch. Set for the session, before the
    stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def events(params: DataFrame, results: DataFrame) -> DataFrame:
    """Parameters (kind 0) and results (kind 1) of runs as one stream, with the seconds they came at."""
    none, at = F.lit(None), F.col("ts").cast("double").alias("at")
    p = params.select("loop_num", "ts", at, F.lit(0).alias("kind"), "seq", "dx0", "ego_speed", "npc_speed", none.cast("int").alias("c_collision"), none.cast("int").alias("c_ttc_0_5"))
    r = results.select("loop_num", "ts", at, F.lit(1).alias("kind"), F.lit(0).alias("seq"), *[none.cast("double").alias(c) for c in ("dx0", "ego_speed", "npc_speed")], "c_collision", "c_ttc_0_5")
    return p.unionByName(r)


def merge_stream(params: DataFrame, results: DataFrame, seconds: int = 600, delay: str = "0 seconds", status: str = "expired", labels: int | None = None) -> DataFrame:
    """Parameters and results of each run, joined while the parameters are at most `seconds` old.

    A newer parameter row replaces the one in wait; the first result takes it (`merged`); a result without parameters is
    an `orphan`; parameters that get too old leave as `status`, with `labels` as their labels, by a timer in event time. A
    run has state only while its parameters wait. Every run of a batch is a call of Python with requests to its state, a
    millisecond or so: for campaigns that run. MergeTable does large batches."""
    keyed_state(params.sparkSession)
    both = events(params, results).withWatermark("ts", delay)
    out = both.groupBy("loop_num").transformWithState(Merge(seconds, status, labels), _OUT, "Append", "EventTime")
    return out.withColumn("ts", F.timestamp_seconds("at")).drop("at")


@dataclass(frozen=True)
class MergeTable:
    """For foreachBatch over `events`: what merge_stream says, with the parameters in wait in a table in place of keyed
    state. A batch is one window over its rows and those in wait, in built-in functions alone. Its row before tells which
    parameters a result takes, the row after whether parameters are taken, replaced or too old.

    The time of the stream is that of its latest row less the delay; parameters that are too old by then leave with the
    batch. Rows that come later than that are worked through all the same. `made` keeps a batch's rows out and, without
    status, the last parameters of each run; `times` says which of these have left and which still wait."""

    path: str
    seconds: int = 600
    delay: int = 0
    status: str = "expired"
    labels: int | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        store = BatchStore(self.path)

        def work(batch: DataFrame, number: int) -> None:
            spark, last = batch.sparkSession, store.last(batch.sparkSession)
            rows = batch.drop("ts").withColumn("new", F.lit(1))
            if last >= 0:
                held = self.timed(store.batch(spark, "made", last), store.batch(spark, "times", last)).where("status is null and not due")
                rows = rows.unionByName(held.select(*batch.drop("ts", "kind", "seq").columns, F.lit(0).alias("kind"), F.lit(0).alias("seq"), F.lit(0).alias("new")))
            made = store.write(self.matched(rows), "made", number)
            times = made.select("at")  # the latest row of a run is in it
            if last >= 0:
                times = times.union(store.batch(spark, "times", last))
            store.write(times.agg(F.max("at").alias("time")), "times", number)

        store.once(work)(batch, number)

    def matched(self, rows: DataFrame) -> DataFrame:
        """The rows that leave, and the last parameters of each run without a status."""
        features, labels = ("dx0", "ego_speed", "npc_speed"), ("c_collision", "c_ttc_0_5")
        w = Window.partitionBy("loop_num").orderBy("new", "at", "kind", "seq", *features, *labels)  # of equal rows no choice is left
        near = [F.lag(c).over(w).alias(f"_{c}") for c in ("kind", "at", *features)] + [F.lead("kind").over(w).alias("_next"), F.lead("at").over(w).alias("_then")]
        side = rows.select("*", *near)
        took = F.coalesce((F.col("_kind") == 0) & (F.col("at") - F.col("_at") <= self.seconds), F.lit(False))
        result, last = F.col("kind") == 1, F.col("_next").isNull()
        old = F.coalesce(F.col("_then") - F.col("at") > self.seconds, F.lit(False))
        status = F.when(result, F.when(took, "merged").otherwise("orphan")).when(~last, self.status)
        params = [F.when(result, F.when(took, F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c in features]
        given = [F.when(result, F.col(c)).when(~last, F.lit(self.labels)).cast("int").alias(c) for c in labels]
        return side.where(result | last | old).select("loop_num", status.alias("status"), *params, *given, F.when(result | last, F.col("at")).otherwise(F.col("at") + self.seconds).alias("at"))

    def timed(self, made: DataFrame, times: DataFrame, on: str | None = None) -> DataFrame:
        """Rows of `made` with whether parameters in wait are too old at the time of their batch, to the millisecond."""
        due = F.round((F.col("at") + self.seconds) * 1000) + 1 <= F.floor(F.col("time") * 1000) - self.delay * 1000
        one = F.broadcast(times)  # a row for each batch
        return (made.join(one, on) if on else made.crossJoin(one)).withColumn("due", F.coalesce(F.col("status").isNull() & due, F.lit(False)))

    def read(self, spark: SparkSession) -> DataFrame:
        store = BatchStore(self.path)
        rows = self.timed(store.read(spark, "made"), store.read(spark, "times"), "batch").where("status is not null or due")
        left = {"status": F.lit(self.status), "c_collision": F.lit(self.labels).cast("int"), "c_ttc_0_5": F.lit(self.labels).cast("int"), "at": F.col("at") + self.seconds}
        rows = rows.withColumns({k: F.when(F.col("due"), v).otherwise(F.col(k)) for k, v in left.items()})
        return rows.withColumn("ts", F.timestamp_seconds("at")).drop("at", "time", "due", "batch")


def merge_once(params: DataFrame, results: DataFrame, seconds: int = 600, delay: str = "0 seconds", status: str = "expired", labels: int | None = None) -> DataFrame:
    """As merge_stream, for runs whose parameters are sent once and that have one result at most: an outer join of the
    streams by a time bound, without results that have no parameters. Parameters leave as `status` once both streams are
    beyond their time."""
    p = params.withWatermark("ts", delay).select("loop_num", "ts", "dx0", "ego_speed", "npc_speed")
    r = results.withWatermark("ts", delay).select(F.col("loop_num").alias("_run"), F.col("ts").alias("_ts"), "c_collision", "c_ttc_0_5")
    end = F.col("ts") + F.expr(f"interval {seconds} seconds")
    joined = p.join(r, (F.col("loop_num") == F.col("_run")) & (F.col("_ts") >= F.col("ts")) & (F.col("_ts") <= end), "left_outer")
    came = F.col("_run").isNotNull()
    labelled = [F.when(came, F.col(c)).otherwise(F.lit(labels)).cast("int").alias(c) for c in ("c_collision", "c_ttc_0_5")]
    return joined.select("loop_num", F.when(came, "merged").otherwise(status).alias("status"), "dx0", "ego_speed", "npc_speed", *labelled, F.coalesce("_ts", end).alias("ts"))


def outcome_totals(stream: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Running totals; for complete or update mode."""
    return stream.groupBy(outcome).agg(F.count("*").alias("n_runs"))


def latest_status(stream: DataFrame) -> DataFrame:
    """The last status of each worker; for complete or update mode."""
    return stream.groupBy("worker_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def drain(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it gave. Append mode keeps every batch; the other modes keep the
    last one, which in complete mode is the whole result. Under the same `base` a stream goes on where it stopped."""
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    last: list[DataFrame] = []
    writer.foreachBatch(lambda df, _: last.append(materialize(df, "batch"))).start().awaitTermination()
    return last[-1] if last else spark.createDataFrame([], stream.schema)


def drain_into(stream: DataFrame, sink: Callable[[DataFrame, int], None], base: str, mode: str = "append") -> None:
    """Run a stream over all that is there into a sink of batches; under the same base it goes on where it stopped."""
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    writer.foreachBatch(lambda df, number: sink(df, number)).start().awaitTermination()


@dataclass
class Loop:
    """One round of a running campaign for each batch of finished runs: the batch is appended to the dataset, the target
    with both outcomes is chosen, the model grows by the batch, its states at the reference points are kept, and the next
    decisions are made.

    path holds a BatchStore of the runs, sums of the model, states, rounds and decisions: a batch that is given again changes
    nothing, and one that was stopped is done anew. A round reads its batch, the last round's row and sums, and the states
    of two rounds, whatever their number; only when the target changes the model is summed anew over all runs. Its frame
    depends on the ranges of the parameters alone (`gp.design_frame`)."""

    path: str
    batch_size: int = 15
    candidates: int = 10_000
    references: int = 2_000
    mode: str = "explore"
    scenario: Scenario = Scenario()
    points: tuple = FOCUS_POINTS
    inducing: int = 256
    lengths: tuple[float, ...] = (0.2, 0.4, 0.7, 1.0, 1.5, 2.5, 5.0)

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.store.once(self.round)(batch, number)

    @property
    def store(self) -> BatchStore:
        return BatchStore(self.path)

    def round(self, batch: DataFrame, number: int) -> None:
        spark, s, store = batch.sparkSession, self.scenario, self.store
        last = store.last(spark)
        before = store.batch(spark, "rounds", last).first().asDict() if last >= 0 else {}
        data = store.write(clean.format_values(batch), "dataset", number)
        facts = self.totals(data, before)
        target = next((c for c in s.priorities if facts[f"{c}_0"] and facts[f"{c}_1"]), None)
        violations = facts[f"{target}_1"] if target else 0
        model = self.model(spark, data, target, before.get("target"), number, last)

        ids = spark.range(self.batch_size * self.candidates).select((F.col("id") % self.batch_size).alias("draw_id"), F.col("id").alias("cand_id"))
        drawn = focus_candidates(ids, list(self.points), self.batch_size * self.candidates, seed=number, scenario=s) if self.mode == "focus" else uniform_candidates(ids, seed=number, scenario=s)
        streak = 0
        if model is None:
            scored = drawn.limit(0).withColumns({"mean": F.lit(None).cast("double"), "std": F.lit(None).cast("double")})
        else:
            scored = gp.predict(drawn, model)
            streak = self.streak(spark, model, number, before)
        first = facts["last_run"]
        start, seen, done = before.get("start"), before.get("seen") or 0, bool(before.get("done"))
        decisions = spark.range(self.batch_size).select((F.col("id") + first).alias("idx"), F.col("id").alias("draw_id"), F.lit(violations).cast("long").alias("violations"), F.lit(model is not None).alias("trained"), F.lit(streak >= s.streak).alias("stable"))
        phased = next_phases(decisions, start, seen, done, s, self.mode)
        next_ = store.write(decide(phased, scored, self.mode, self.points, s).withColumns({"target": F.lit(target).cast("string"), "n_runs": F.lit(facts["n_runs"]).cast("long"), "violations": F.lit(violations).cast("long")}), "decisions", number)

        begun = F.min(F.when(F.col("phase").isin("STEP2", "STEP3"), F.col("idx")))
        after = phased.agg(begun.alias("begun"), F.count_if(F.col("phase").isin("STEP2", "STEP3")).alias("more"), F.max((F.col("phase") == "STEP3").cast("int")).alias("third")).first()
        facts |= {"target": target, "streak": streak, "start": start if start is not None else after.begun, "seen": seen + after.more, "done": done or bool(after.third), "decisions": next_.count()}
        kinds = {"target": "string", "done": "boolean"}
        store.write(spark.range(1).select(*[F.lit(v).cast(kinds.get(k, "long")).alias(k) for k, v in facts.items()]), "rounds", number)

    def totals(self, data: DataFrame, before: dict) -> dict[str, int]:
        """Runs, the greatest run number and, for each target, both outcomes, of all runs so far."""
        s = self.scenario
        both = [F.count_if(F.coalesce(F.col(c) == x, F.lit(False))).alias(f"{c}_{x}") for c in s.priorities for x in (0, 1)]
        new = data.agg(F.count("*").alias("n_runs"), F.coalesce(F.max("loop_num"), F.lit(0)).alias("last_run"), *both).first().asDict()
        return {k: max(v, before.get(k, 0)) if k == "last_run" else v + before.get(k, 0) for k, v in new.items()}

    def model(self, spark: SparkSession, data: DataFrame, target: str | None, old: str | None, number: int, last: int) -> gp.Model | None:
        """The model of all runs so far for the target: the last round's sums and those of the new runs."""
        if target is None:
            return None
        frame, store = gp.design_frame(self.scenario, self.inducing, self.lengths), self.store
        if target == old:
            found = gp.added(store.batch(spark, "sums", last), self.sums(data, target, frame))
        else:
            rows = data if last < 0 else store.read(spark, "dataset", number).drop("batch")  # this batch is written, not done
            found = self.sums(rows, target, frame)
        model = gp.solve(store.write(found, "sums", number), frame)
        return model if model and model.classes == 2 else None

    def sums(self, rows: DataFrame, target: str, frame: gp.Frame) -> DataFrame:
        return gp.sums(gp.points(clean.trainable(rows, target, self.scenario), frame.features, "y"), frame)

    def streak(self, spark: SparkSession, model: gp.Model, number: int, before: dict) -> int:
        """How many rounds in a row the boundary has been calm, from the states of this round and one of a history before."""
        s, store = self.scenario, self.store
        points = uniform_candidates(spark.range(self.references).withColumnRenamed("id", "point_id"), "point_id", seed=0, scenario=s)
        state = hysteresis_state(F.col("mean"), *s.hysteresis)
        now = store.write(gp.predict(points, model).select("point_id", "mean", state.alias("state")), "states", number)
        then = number - s.history + 1
        try:
            old = store.batch(spark, "states", then) if then >= 0 else None
        except AnalysisException as e:
            if not missing(e):
                raise
            old = None  # there was no model then
        if old is None:
            return 0
        shift = boundary_shift(now.join(old.select("point_id", F.col("state").alias("old_state")), "point_id").withColumn("iter", F.lit(number))).first()
        return (before.get("streak") or 0) + 1 if shift.shift_rate < s.shift else 0


def campaign_loop(results: DataFrame, loop: Loop, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The decisions of a loop over all batches that there are. prepare: what is done to each batch rather than to the
    stream, as Spark makes code for the two apart (see theory.with_margins)."""
    drain_into(results, (lambda batch, number: loop(prepare(batch), number)) if prepare else loop, loop.path)
    return loop.store.read(results.sparkSession, "decisions")
