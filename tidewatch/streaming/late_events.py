"""Per-week aggregates by event time that stay right as records come in late and out of order, with a cut-off.

A week takes records until ``lateness_days`` after its end, by the record's own arrival clock (``collected_at``): a record
at or past that instant is late wherever it stands in the files. The stream's watermark runs over the arrival clock too,
``slack`` behind the latest one seen. Keyed state holds one row per (cut-off of the week, post); once the watermark has
passed the cut-off no record in time can come any more but one out of order by more than ``slack``, and Spark drops the
state, so its size is that of the open weeks, however long the stream runs.

Each run takes what is new in the folder as one micro-batch and, where ``home`` is given, goes on from the state of the
run before. A batch emits the posts it changed and, from the posts of the weeks it touched, those weeks' aggregates; both
are kept as upserts by batch, and a batch tried again overwrites its own rows. What doesn't count is diverted as records
with a reason: ``unreadable`` times, ``late``, or ``closed`` (in time by its clock, but its week's state is gone).

Defined results: null, blank and ``nan`` ids are no posts and are left out; exact repeats count as records but change no
figure of the post; of several versions the one collected last counts, ties by the larger engagement and then community;
an empty table gives empty results. A collector's clock that runs ahead closes weeks early; what comes then is diverted as
``closed``, not lost.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import instant
from tidewatch.storage import exists, names, read_text, scratch, write_text

#: 1970-01-06, a Tuesday, is five days after the epoch.
WEEK, WEEK_OFFSET = "7 days", "5 days"
#: Marks a column as event time for the eviction of state; its delay is that of the watermark's own column.
EVENT_TIME = {"spark.watermarkDelayMs": 0}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

POSTS = (
    "week_start string, mention_id string, records bigint, arrival_ts timestamp, engagement double, community string, batch int"
)
WEEKS = "week_start string, community string, posts bigint, records bigint, avg_engagement double, batch int"
ASIDE = "week_start string, mention_id string, event_ts timestamp, arrival_ts timestamp, community string, reason string, batch int"


def usable_id(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "") & (F.lower(F.trim(c)) != "nan")


@dataclass
class LateEvents:
    """``lateness_days`` after a week's end a record still counts. ``slack_days``: how far out of order records may come
    between runs. ``rocks`` keeps the state in RocksDB, off the heap, for tables of many open posts."""

    lateness_days: int = 7
    slack_days: int = 7
    rocks: bool = False
    #: Rows of state after each batch of the last run.
    state_rows: list[int] = field(default_factory=list)

    def prepared(self, posts: DataFrame) -> DataFrame:
        """Rows of usable posts with instants, the week and its cut-off."""
        rows = posts.where(usable_id(F.col("mention_id"))).select(
            F.col("mention_id"),
            instant(F.col("published_at")).alias("event_ts"),
            instant(F.col("collected_at")).alias("arrival_ts"),
            F.when(F.trim("community") != "", F.trim("community")).alias("community"),
            F.coalesce("engagement_score", F.lit(0.0)).alias("engagement"),
        )
        start = F.timestamp_seconds(F.floor((F.unix_timestamp("event_ts") - 5 * 86_400) / (7 * 86_400)) * (7 * 86_400) + 5 * 86_400)
        return rows.withColumn("start", start).withColumn("cut_off", F.col("start") + F.expr(f"INTERVAL {7 + self.lateness_days} DAYS"))

    def counting(self, closed_to: int) -> Column:
        """Whether a row changes figures, the state of weeks with cut-offs up to ``closed_to`` (microseconds) being gone."""
        in_time = (F.col("arrival_ts") < F.col("cut_off")) & (F.unix_micros("cut_off") > closed_to)
        return F.coalesce(in_time, F.lit(False))

    def states(self, prepared: DataFrame, closed_to: int = 0) -> DataFrame:
        """Keyed state per (cut-off, post), for a stream as for a table."""
        rows = prepared.where(self.counting(closed_to))
        if prepared.isStreaming:
            rows = rows.withWatermark("arrival_ts", f"{self.slack_days} days")
        return (
            rows.withColumn("cut_off", F.col("cut_off").alias("cut_off", metadata=EVENT_TIME))
            .groupBy("cut_off", "mention_id")
            .agg(
                F.count(F.lit(1)).alias("records"),
                F.max(F.struct("arrival_ts", "engagement", "community")).alias("kept"),
                F.min("start").alias("start"),
            )
        )

    def aside(self, prepared: DataFrame, closed_to: int = 0) -> DataFrame:
        """The rows that don't count, each with its reason."""
        readable = F.col("event_ts").isNotNull() & F.col("arrival_ts").isNotNull()
        reason = F.when(~readable, "unreadable").when(F.col("arrival_ts") >= F.col("cut_off"), "late").otherwise("closed")
        return prepared.where(~self.counting(closed_to)).select(
            F.date_format("start", "yyyy-MM-dd").alias("week_start"), "mention_id", "event_ts", "arrival_ts", "community", reason.alias("reason")
        )

    def run(self, spark: SparkSession, path: str, home: str | None = None) -> Results:
        """Streams what is new in the table at ``path``; ``home``: the folder of state and results, a fresh one if none."""
        home = home or scratch(spark, "late-events")
        results = Results(spark, home)
        # the clock of the last batch that was committed, so that a batch tried again is judged as it was the first time
        done = [int(n) for n in names(spark, f"{home}/marks-posts/commits") if n.isdigit()]
        clock = int(read_text(spark, f"{home}/clock/{max(done)}")) if done else 0
        clocks = [clock]
        closed_to = max(clock - self.slack_days * 86_400_000_000, 0)
        # a pattern, so that a single file is as good as a folder of files
        source = self.prepared(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[" + path[-1] + "]"))

        def write(rows: DataFrame, kind: str, batch: int) -> None:
            # the same batch, tried again, overwrites its own rows only
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy("week_start").parquet(f"{home}/{kind}/batch={batch}")

        def upsert(changed: DataFrame, batch: int) -> None:
            posts = changed.select(F.date_format("start", "yyyy-MM-dd").alias("week_start"), "mention_id", "records", "kept.*")
            write(posts, "posts", batch)
            every = results.posts_log()
            touched = every.where(F.col("batch") == batch).select("week_start").distinct()
            # weeks are few: the list bounds what is read of earlier batches
            weeks = [r[0] for r in touched.collect()]
            write(weekly_of(current(every.where(F.col("week_start").isin(weeks)))), "weeks", batch)
            latest = every.where(F.col("batch") == batch).agg(F.unix_micros(F.max("arrival_ts"))).first()[0]
            clocks.append(max(clocks[-1], latest or 0))
            write_text(spark, f"{home}/clock/{batch}", str(clocks[-1]))

        def divert(rows: DataFrame, batch: int) -> None:
            write(rows.withColumn("week_start", F.coalesce("week_start", F.lit("none"))), "aside", batch)

        before = spark.conf.get(PROVIDER, None)
        if self.rocks:
            spark.conf.set(PROVIDER, ROCKS)
        try:
            # one after the other: both judge by the same clock, also when a run was broken off
            for name, mode, rows, sink in (
                ("aside", "append", self.aside(source, closed_to), divert),
                ("posts", "update", self.states(source, closed_to), upsert),
            ):
                marks = f"{home}/marks-{name}"
                query = rows.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(sink).start()
                query.awaitTermination()
        finally:
            if self.rocks:
                spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
        progress = [s for p in query.recentProgress for s in p["stateOperators"]]
        self.state_rows = [s["numRowsTotal"] for s in progress]
        lost = sum(s["numRowsDroppedByWatermark"] for s in progress)
        if lost:
            raise RuntimeError(f"{lost} records came after a run that was broken off, for weeks it had closed; remove {home} and run anew")
        return results


@dataclass
class Results:
    """What a stream has written below ``home``, upserts resolved on reading."""

    spark: SparkSession
    home: str

    def _log(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.home}/{kind}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def posts_log(self) -> DataFrame:
        return self._log("posts", POSTS)

    def posts(self) -> DataFrame:
        """week_start, mention_id, records, arrival_ts, engagement, community of the posts that came in time."""
        return current(self.posts_log())

    def aside(self) -> DataFrame:
        """The diverted records with their reason."""
        rows = self._log("aside", ASIDE).drop("batch")
        return rows.withColumn("week_start", F.when(F.col("week_start") != "none", F.col("week_start")))

    def weeks(self) -> DataFrame:
        """Figures per week and community: of each week the rows of the last batch that touched it."""
        log = self._log("weeks", WEEKS)
        last = log.groupBy("week_start").agg(F.max("batch").alias("batch"))
        return log.join(F.broadcast(last), ["week_start", "batch"], "left_semi").drop("batch")

    def late_report(self) -> DataFrame:
        """Per week what was set aside: records past the cut-off, posts with such a record, posts with no other."""
        late = self.aside().where("reason <> 'unreadable'")
        late = late.groupBy("week_start", "mention_id").agg(F.count(F.lit(1)).alias("late_records"))
        kept = self.posts().select("week_start", "mention_id", F.lit(1).alias("kept"))
        return (
            late.join(kept, ["week_start", "mention_id"], "left")
            .groupBy("week_start")
            .agg(
                F.sum("late_records").alias("late_records"),
                F.count(F.lit(1)).alias("posts_with_late"),
                F.count_if(F.col("kept").isNull()).alias("posts_only_late"),
            )
        )

    def reasons(self) -> DataFrame:
        """Records set aside, by reason."""
        return self.aside().groupBy("reason").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("mention_id").alias("posts"))

    def only_late(self) -> DataFrame:
        """Posts all of whose readable records came too late."""
        late = self.aside().where("reason <> 'unreadable'").select("mention_id").distinct()
        return late.join(self.posts_log().select("mention_id"), "mention_id", "left_anti")


def current(log: DataFrame) -> DataFrame:
    """Of each post in a week the row of its last batch."""
    rest = ("records", "arrival_ts", "engagement", "community")
    last = log.groupBy("week_start", "mention_id").agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return last.select("week_start", "mention_id", "s.*")


def weekly_of(posts: DataFrame) -> DataFrame:
    return posts.groupBy("week_start", F.coalesce("community", F.lit("")).alias("community")).agg(
        F.count(F.lit(1)).alias("posts"), F.sum("records").alias("records"), F.round(F.avg("engagement"), 6).alias("avg_engagement")
    )
