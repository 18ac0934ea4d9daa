"""Edges of a status: failures and recoveries, logged once each (ST2, ST3, SNK5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import Last, running, sliced

RECEIVE = {"fail": "error receiving data", "ok": "data received"}
SEND = {"fail": "error sending data", "ok": "data sent"}


def status_edges(rows: DataFrame, status: Column, slices: int | None = None, say: dict[str, str] = RECEIVE) -> DataFrame:
    """Rows (robot_id, event_id, ts, edge, message) where a status differs from the one before.

    Null statuses say nothing; at first all is well, so a first success is no edge.
    """
    keys, order = ["robot_id"], ["ts", "event_id"]
    d = running(sliced(rows.withColumn("_now", status), keys, order, slices), keys, order, _was=Last("_now", before=True))
    changed = d.filter(F.col("_now").isNotNull() & (F.col("_now") != F.coalesce("_was", F.lit("ok"))))
    edge = F.when(F.col("_now") == "ok", "recovered").otherwise("error")
    return changed.select("robot_id", "event_id", "ts", edge.alias("edge"), F.when(F.col("_now") == "ok", say["ok"]).otherwise(say["fail"]).alias("message"))
