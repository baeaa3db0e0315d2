"""Cross-tables that are fed on: stored counts to which batches are added and from which rows are taken back."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import Variable
from marginalia.operators.crosstab import WEIGHT, weighted
from marginalia.operators.factors import Model
from marginalia.operators.learning import train


class KeptTable:
    """A cross-table in a folder that all executors share, as a base and the changes since.

    Each epoch's change is a cross-table in a folder of its own, which is
    replaced as a whole when the epoch is applied again: so a batch that is
    replayed after a failure counts once. Retractions are changes with negative
    weights. :meth:`compact` folds old epochs into a new base; epochs up to the
    base's are known to be in it and are passed over.
    """

    def __init__(self, spark: SparkSession, folder: str, variables: Sequence[str]):
        self.spark, self.folder, self.variables = spark, folder.rstrip("/"), list(variables)

    def apply(self, rows: DataFrame, epoch: int, retract: DataFrame | None = None, weight: str | None = None) -> None:
        """Adds the rows of an epoch and takes the retracted ones back; the same epoch again replaces what it did."""
        if epoch <= self.base():
            return
        change = weighted(rows, weight).select(*self.variables, WEIGHT)
        if retract is not None:
            change = change.unionByName(weighted(retract, weight).select(*self.variables, (-F.col(WEIGHT)).alias(WEIGHT)))
        sums = change.groupBy(*self.variables).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
        sums.write.mode("overwrite").parquet(f"{self.folder}/changes/epoch={epoch}")

    def writer(self, weight: str | None = None, sign: str | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``. ``sign``: a column that is negative in rows that take an earlier one back."""

        def add(batch: DataFrame, epoch: int) -> None:
            if sign is None:
                self.apply(batch, epoch, weight=weight)
            else:
                self.apply(batch.where(F.coalesce(F.col(sign), F.lit(1)) >= 0), epoch, batch.where(F.col(sign) < 0), weight)

        return add

    def base(self) -> int:
        """The last epoch that is in the base; -1 without one."""
        return max(self._epochs("base"), default=-1)

    def read(self, upto: int | None = None) -> DataFrame:
        """The cross-table after all epochs, or those ``upto`` one; instances whose weights have come to 0 are gone."""
        base = self.base()
        if upto is not None and upto < base:
            raise ValueError(f"epochs up to {base} are folded together")
        paths = [f"{self.folder}/changes/epoch={e}" for e in self._epochs("changes") if e > base and (upto is None or e <= upto)]
        paths += [f"{self.folder}/base/epoch={base}"] if base >= 0 else []
        if not paths:
            raise ValueError("nothing has been applied")
        rows = self.spark.read.parquet(*paths).select(*self.variables, WEIGHT)
        return rows.groupBy(*self.variables).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.abs(WEIGHT) > 1e-9)

    def compact(self, upto: int) -> None:
        """Makes the epochs up to one a new base. A base counts once it is written as a whole, so this can be repeated."""
        if upto > self.base():
            self.read(upto).write.mode("overwrite").parquet(f"{self.folder}/base/epoch={upto}")

    def train(self, variables: Sequence[Variable], parents: Mapping[str, Sequence[str]]) -> Model:
        """A network of state indexes from the counts as they are now."""
        return train(self.read(), variables, parents, WEIGHT)

    def _epochs(self, kind: str) -> list[int]:
        """Those that are written as a whole."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(at, "epoch=*/_SUCCESS"))
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done or [])
