"""W01, W02 over measurements that keep arriving: the state of a (cohort, drug) is its cells' sums; nothing is read again.

A key's state maps each cell to the sum and number of its measurements, so repeated measurements are averaged as in a batch.  Means,
deviations and ranks of a key follow from its cells, of which there are some hundred to some thousand; each batch gives the rows of
the keys that it has touched, as they are now.  State lies in the checkpoint, so a query that starts again goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

RESULT = "cohort string, drug string, cell string, value double, sens_z double, sens_rank double, n long"


def measures(value: np.ndarray, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """z-scores (sample deviation) and average ranks over n; NaN with fewer than ``least`` values, z also without spread."""
    n = len(value)
    nothing = np.full(n, np.nan)
    if n < least:
        return nothing, nothing
    sd = value.std(ddof=1)
    rank = pd.Series(value).rank(method="average").to_numpy() / n
    return ((value - value.mean()) / sd if sd > 0 else nothing), rank


class Accumulated(StatefulProcessor):
    """Adds the arriving measurements to their cells and gives all cells of the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        name = StructType([StructField("cell", StringType())])
        sums = StructType([StructField("total", DoubleType()), StructField("n", LongType())])
        self.cells = handle.getMapState("cells", name, sums)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: dict[str, list] = {}
        for pdf in rows:
            good = pdf[pdf["value"].notna() & pdf["cell"].notna()]
            for cell, total, n in good.groupby("cell")["value"].agg(["sum", "count"]).itertuples():
                own = added.setdefault(cell, [0.0, 0])
                own[0], own[1] = own[0] + total, own[1] + n
        for cell, (total, n) in added.items():
            old = self.cells.getValue((cell,)) if self.cells.containsKey((cell,)) else (0.0, 0)
            self.cells.updateValue((cell,), (float(old[0] + total), int(old[1] + n)))
        found = sorted((k[0], v[0] / v[1]) for k, v in self.cells.iterator())
        if found:
            cell, value = zip(*found, strict=True)
            z, rank = measures(np.array(value))
            yield pd.DataFrame({"cohort": key[0], "drug": key[1], "cell": cell, "value": value, "sens_z": z, "sens_rank": rank, "n": len(cell)})

    def close(self) -> None:
        pass


def settle(spark: SparkSession) -> SparkSession:
    """Keyed state of this kind needs the embedded store; Python workers find this package by the driver's path."""
    from heddle.session import ship_path

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return ship_path(spark)


def sensitivities(arriving: DataFrame) -> DataFrame:
    """From a stream of (cohort, drug, cell, value): the measures of all keys that a batch touches."""
    settle(arriving.sparkSession)
    return arriving.groupBy("cohort", "drug").transformWithStateInPandas(statefulProcessor=Accumulated(), outputStructType=RESULT, outputMode="Update", timeMode="None")


def run_available(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, once.  Each batch is written as a folder of its own, so one that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each key's last batch."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(folder)
    last = rows.groupBy("cohort", "drug").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["cohort", "drug", "batch"]).drop("batch")
