"""Session plans as keyed state."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# workers get this module with the task and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLAN = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("goal", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("step_count", T.LongType()),
    T.StructField("last_step", T.StringType()),
])


class SessionPlan(StatefulProcessor):
    """Goal, state and last step with the greatest ``seq``, and the number of steps; later rows of one ``seq`` win."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "goal string, goal_seq bigint, state string, state_seq bigint, last string, last_seq bigint, n bigint")

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        goal, goal_seq, state, state_seq, last, last_seq, n = self.head.get() if self.head.exists() else ("", -(2**63), "", -(2**63), "", -(2**63), 0)
        newest = {"goal": (goal_seq, goal), "state": (state_seq, state), "step": (last_seq, last)}
        # rows come in chunks in no order, so what is kept knows its place
        for batch in rows:
            n += int((batch["field"] == "step").sum())
            for seq, field, value in zip(batch["seq"].tolist(), batch["field"], batch["value"]):
                if field in newest and seq >= newest[field][0]:
                    newest[field] = (seq, value)
        (goal_seq, goal), (state_seq, state), (last_seq, last) = newest["goal"], newest["state"], newest["step"]
        self.head.update((goal, goal_seq, state, state_seq, last, last_seq, n))
        yield pd.DataFrame({"session_id": [key[0]], "goal": [goal], "state": [state], "step_count": [n], "last_step": [last]})

    def close(self) -> None:
        pass


def stream_session_plans(updates: DataFrame) -> DataFrame:
    """Streaming ``updates(session_id, seq, field, value)`` to the plan after each change.

    Session ids compare ignoring case.  Needs the RocksDB state store provider.
    """
    keyed = updates.withColumn("session_id", F.lower("session_id"))
    return keyed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=SessionPlan(), outputStructType=PLAN, outputMode="Update", timeMode="None"
    )


def session_plans(updates: DataFrame) -> DataFrame:
    """Batch form: last goal, last state and the number of steps per session."""
    d = updates.withColumn("session_id", F.lower("session_id"))
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("seq")))
    return d.groupBy("session_id").agg(
        F.coalesce(last("goal"), F.lit("")).alias("goal"),
        F.coalesce(last("state"), F.lit("")).alias("state"),
        F.count(F.when(F.col("field") == "step", 1)).alias("step_count"),
        F.coalesce(last("step"), F.lit("")).alias("last_step"),
    )


def session_steps(updates: DataFrame) -> DataFrame:
    """Numbered steps of every session, one row each."""
    from codegraph_spark.plans.prefix import running_sum

    steps = updates.filter("field = 'step'").withColumn("session_id", F.lower("session_id"))
    return running_sum(steps, ["session_id"], "seq", F.lit(1), "step_no").select(
        "session_id", F.col("step_no").cast("long").alias("step_no"), F.col("value").alias("step")
    )


def read_plans(plans: DataFrame, asked: DataFrame) -> DataFrame:
    """Plans of the asked sessions; an unknown session reads as an empty plan."""
    want = asked.select(F.lower("session_id").alias("session_id")).distinct()
    return want.join(plans, "session_id", "left").select(
        "session_id", F.coalesce("goal", F.lit("")).alias("goal"), F.coalesce("state", F.lit("")).alias("state"),
        F.coalesce("step_count", F.lit(0)).alias("step_count"), F.coalesce("last_step", F.lit("")).alias("last_step"),
    )
