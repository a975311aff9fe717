"""Live forms: a type that follows a stream of lines, and the latest state of patch logs.

LiveType folds each micro-batch's records, in their order, into the type so far (foreachBatch);
the type and the batch are written together, so a batch that is run again after a failure
isn't folded twice. latest_states keeps each file's state in Spark's state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from typeloom.api import finish
from typeloom.operators.infer import fold_stream, parsed
from typeloom.plans.nodes import NEVER, Node, decode, encode
from typeloom.plans.settings import Options, settle
from typeloom.sources.jsonl import lines_of_frame
from typeloom.sources.records import PatchLog


class LiveType:
    """Use .add as a foreachBatch function. path is a folder of any file system that Spark writes to."""

    def __init__(self, options: Options | None = None, path: str | None = None):
        self.settings = settle(options)
        self.path = path
        self.batch, self.node = -1, NEVER
        self.loaded = path is None

    def load(self, spark: SparkSession) -> None:
        """Takes up what an earlier run has left in the folder."""
        self.loaded = True
        try:
            saved = spark.read.schema("batch long, node string").json(self.path).orderBy(F.desc("batch")).first()
        except AnalysisException:  # no batch was ever written
            return
        if saved and saved.batch > self.batch:
            self.batch, self.node = saved.batch, decode(saved.node)

    def add(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if not self.loaded:
            self.load(spark)
        if batch <= self.batch:
            return
        self.node, self.batch = fold_stream(lines_of_frame(rows), self.settings.context, self.node), batch
        if self.path:
            spark.createDataFrame([(batch, encode(self.node))], "batch long, node string").coalesce(1).write.mode("append").json(self.path)

    def current(self) -> Node:
        if not self.loaded:
            self.load(SparkSession.active())
        return self.node

    def text(self) -> str:
        return finish(decode(encode(self.current())), self.settings)[0].text()


def _step() -> Callable:
    def update(key, frames, state: GroupState):
        log = PatchLog()
        if state.exists:
            log.state = json.loads(state.get[0])
        rows = pd.concat(list(frames)).sort_values("ord")
        for line in rows["line"]:
            ok, record = parsed(line)
            if ok:
                log.add(record)
        if log.records():
            text = json.dumps(log.state, ensure_ascii=False)
            state.update((text,))
            yield pd.DataFrame({"file": [key[0]], "state": [text]})

    return update


def latest_states(patches: DataFrame) -> DataFrame:
    """A stream of (file, state) from a stream of patch lines (file long, ord long, line string)."""
    return patches.groupBy("file").applyInPandasWithState(_step(), "file long, state string", "state string", "update", GroupStateTimeout.NoTimeout)
