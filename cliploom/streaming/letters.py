"""A bounded queue of failed rows that is retried, on versions of one small table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import current_version, publish_version, read_version


class DeadLetters:
    """At most `most` rows, the newest by `order`, one a key, each with the number of attempts made. Every change is a new
    version behind one pointer, so a change that fails half-way leaves the queue as it was."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: str, most: int = 1000, attempts: int = 3):
        self.spark, self.root, self.key, self.order, self.most, self.attempts = spark, root, key, order, most, attempts

    def rows(self) -> DataFrame | None:
        return read_version(self.spark, self.root, "letters") if current_version(self.spark, self.root) else None

    def _publish(self, rows: DataFrame, given_up: DataFrame) -> None:
        publish_version(self.spark, {"letters": rows.orderBy(F.desc(self.order), self.key).limit(self.most).coalesce(1), "given_up": given_up.coalesce(1)}, self.root)

    def _given_up(self, like: DataFrame) -> DataFrame:
        if current_version(self.spark, self.root) is None:
            return like.limit(0)
        return read_version(self.spark, self.root, "given_up")

    def put(self, failed: DataFrame) -> None:
        """Add rows, with one attempt made; a row replaces the letter of its key, and the oldest letters make room."""
        new = failed.withColumn("attempts", F.lit(1)).orderBy(F.desc(self.order), self.key).limit(self.most)
        old = self.rows()
        both = new.withColumn("turn", F.lit(1)) if old is None else new.withColumn("turn", F.lit(1)).unionByName(old.withColumn("turn", F.lit(0)))
        last = Window.partitionBy(self.key).orderBy(F.desc("turn"), F.desc(self.order))
        kept = both.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth", "turn")
        self._publish(kept, self._given_up(kept))

    def flush(self, process: Callable[[DataFrame], DataFrame], ok: str, results: str) -> tuple[int, int]:
        """Try every letter again: rows that are `ok` now go to a folder of results that is named after the version they came
        from (so a flush that is run again writes it again), others stay with one more attempt, and those that had all their
        attempts are set aside. Returns how many went and how many stay."""
        version = current_version(self.spark, self.root)
        if version is None:
            return 0, 0
        queue = read_version(self.spark, self.root, "letters", version)
        rest = [c for c in queue.columns if c not in (self.key, "attempts")]
        done = process(queue.drop("attempts")).join(queue.select(self.key, "attempts"), self.key).persist()
        right = done.filter(ok).drop("attempts")
        right.coalesce(1).write.mode("overwrite").parquet(f"{results}/flush={version}")
        went = right.count()
        still = queue.join(done.filter(ok).select(self.key), self.key, "left_anti").select(self.key, *rest, (F.col("attempts") + 1).alias("attempts")).persist()
        spent = still.filter(F.col("attempts") >= self.attempts)
        left = still.filter(F.col("attempts") < self.attempts)
        self._publish(left.select(*queue.columns), self._given_up(queue).unionByName(spent.select(*queue.columns)).orderBy(F.desc(self.order)).limit(self.most))
        stay = left.count()
        done.unpersist()
        still.unpersist()
        return went, stay
