"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir and go on from there; a private folder only where a local session names none.

    A checkpoint keeps the size that the planner guessed for df, and joins multiply guesses:
    in a loop the number's digits double every round, until the driver has no memory for
    them. So the rows are given to a plan that guesses anew.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not named and (sc.master or "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tilewright-"))
    rows = df.checkpoint(eager=True)._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), df.sparkSession)
