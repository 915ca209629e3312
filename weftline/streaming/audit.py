"""Sessions audited while their events stream in: steps are numbered, and what is deleted and then created again is marked.

The state of a session is the entities that it deleted, one value in the state store of its partition; a batch form
gives the same for a finished log.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.functions.contracts import is_object

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "session string, seq long, step long, log_id string, operation string, target_id string, forbidden_transition string"
#: Fixed value: the transition that a recreation is.
RECREATED = "forbidden_transition_delete_recreate"


def _mark(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def with_marks(events: DataFrame) -> DataFrame:
    """Normalised calls with title and start of the entity they delete (by the state before) or create (by the observation, else by the state after)."""
    at = lambda state, key: F.try_variant_get(F.try_variant_get(F.try_parse_json(state), F.lit("$.events"), "map<string,variant>")[F.col("target_id")], F.lit(f"$.{key}"), "string")
    inner = lambda c: F.coalesce(F.get_json_object(c, "$.calendar"), F.col(c))
    seen = F.try_parse_json("observation")
    entity = F.coalesce(F.try_variant_get(seen, F.lit("$.event"), "variant"), F.when(is_object(seen), seen))
    told = is_object(entity) & F.try_variant_get(entity, F.lit("$.event_id"), "variant").isNotNull()
    mark = lambda key: F.when(F.col("operation") == "delete", at(inner("before"), key)).when(
        F.col("operation") == "create", F.when(told, F.try_variant_get(entity, F.lit(f"$.{key}"), "string")).otherwise(at(inner("after"), key)))
    return events.withColumns({"title": mark("title"), "start": mark("start_time")})


class Sessions(StatefulProcessor):
    """Numbers the steps of a session and remembers what it deleted: by target, the title and start that it had last."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a session: each look at the state is a round trip
        self.seen = handle.getValueState("seen", "n long, targets array<string>, titles array<string>, starts array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        n, *before = self.seen.get() or (0, [], [], [])
        gone = {target: (title, start) for target, title, start in zip(*before, strict=True)}
        out = []
        for _, seq, operation, target, title, start, forbidden in sorted(map(tuple, rows), key=lambda r: (r[1] is None, r[1] or 0)):
            n += 1
            if operation == "delete" and target:
                gone[target] = (title, start)
            again = operation == "create" and any((title and title == t) or (start and start == s) for t, s in gone.values())
            out.append(Row(session=key[0], seq=seq, step=n, log_id=f"evtlog_{key[0]}_{n:06d}", operation=operation, target_id=target, forbidden_transition=forbidden or (RECREATED if again else "")))
        self.seen.update((n, list(gone), [t for t, _ in gone.values()], [s for _, s in gone.values()]))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        """A session that was idle for long is forgotten."""
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def _prepared(events: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return events.where("session IS NOT NULL").select(
        F.col("session").cast("string").alias("session"), F.col("seq").cast("bigint").alias("seq"), text("operation").alias("operation"), text("target_id").alias("target_id"),
        _mark(F.col("title")).alias("title"), _mark(F.col("start")).alias("start"), text("forbidden_transition").alias("forbidden_transition"))


def audited_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """session, seq, step, log_id, operation, target_id and forbidden_transition of every event of a stream.

    A creation is marked if the session has deleted an entity of the same title or the same start before, without case and
    outer spaces; an earlier mark stays. Events of a micro-batch are taken in the order of seq. With idle_ms a session is
    forgotten that long after its last event. Events of a null session are left out.
    """
    events.sparkSession.conf.set(*STORE)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return _prepared(events).groupBy("session").transformWithState(Sessions(idle_ms), OUT, "Append", mode)


def audited_log(events: DataFrame) -> DataFrame:
    """The same for a finished log. Steps are a window by session; marks meet by (session, title) and (session, start), so no session is gathered.

    A deletion counts until the same target is deleted again.
    """
    rows = _prepared(events)
    by_session = Window.partitionBy("session").orderBy("seq")
    rows = rows.withColumn("step", F.row_number().over(by_session).cast("bigint"))
    deletions = rows.where("operation = 'delete' AND target_id <> ''").withColumn("until", F.lead("step").over(Window.partitionBy("session", "target_id").orderBy("step")))
    created = rows.where("operation = 'create'").select("session", "step", "title", "start")
    hits = None
    for mark in ("title", "start"):
        ends = deletions.where(F.col(mark) != "").select("session", mark, F.col("step").alias("from"), "until")
        found = created.alias("c").join(
            ends.alias("d"), (F.col("c.session") == F.col("d.session")) & (F.col(f"c.{mark}") == F.col(f"d.{mark}")) & (F.col("c.step") > F.col("d.from")) & (F.col("d.until").isNull() | (F.col("c.step") < F.col("d.until"))), "left_semi")
        found = found.select("session", "step")
        hits = found if hits is None else hits.union(found)
    marked = rows.join(hits.distinct().withColumn("again", F.lit(True)), ["session", "step"], "left")
    forbidden = F.when(F.col("forbidden_transition") != "", F.col("forbidden_transition")).when(F.col("again"), RECREATED).otherwise("")
    return marked.select("session", "seq", "step", F.concat(F.lit("evtlog_"), "session", F.lit("_"), F.lpad(F.col("step").cast("string"), 6, "0")).alias("log_id"), "operation", "target_id", forbidden.alias("forbidden_transition"))
