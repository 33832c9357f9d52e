"""Table functions that SQL can call with a table argument, partition by partition."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="dwell_id long, source_a string, source_b string, hs_diff double, tp_diff double, direction_diff double")
class SourcePairs:
    """source_pairs(TABLE(candidates) PARTITION BY part ORDER BY dwell_id): every two sources of an event, the first before the second in the order of rank, and by how much they differ.

    The table has dwell_id, source, rank, hs, tp and direction. Partitions are
    those of any column that keeps an event's rows together, dwell_id itself
    or a hash of it, so that not every event starts a function. An event has a
    handful of sources, which is what is held at a time.
    """

    def __init__(self) -> None:
        self.rows: list[Row] = []

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.rows and self.rows[0]["dwell_id"] != row["dwell_id"]:
            yield from self.terminate()
            self.rows = []
        self.rows.append(row)

    def terminate(self) -> Iterator[tuple]:
        minus = lambda x, y: None if x is None or y is None else x - y
        own = sorted(self.rows, key=lambda r: r["rank"])
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                turn = minus(a["direction"], b["direction"])
                yield a["dwell_id"], a["source"], b["source"], minus(a["hs"], b["hs"]), minus(a["tp"], b["tp"]), None if turn is None else abs((turn + 180) % 360 - 180)


@udtf(returnType="lane string, hs_bin double, tp_bin double, n long")
class OccupiedBins:
    """occupied_bins(TABLE(events) PARTITION BY lane, hs_width => 0.5, tp_width => 1.0): the bins of wave height and period that a lane's rows fall into, and how many.

    The table has lane, hs and tp; rows without either are left out. A
    partition holds its bins, not its rows.
    """

    def __init__(self) -> None:
        self.lane, self.bins = None, Counter()

    def eval(self, row: Row, hs_width: float, tp_width: float) -> None:
        self.lane = row["lane"]
        if row["hs"] is not None and row["tp"] is not None:
            self.bins[row["hs"] // hs_width * hs_width, row["tp"] // tp_width * tp_width] += 1

    def terminate(self) -> Iterator[tuple]:
        for (hs, tp), n in self.bins.items():
            yield self.lane, hs, tp, n


def register_tables(spark: SparkSession) -> None:
    """Make the table functions known to SQL, as source_pairs and occupied_bins."""
    spark.udtf.register("source_pairs", SourcePairs)
    spark.udtf.register("occupied_bins", OccupiedBins)
