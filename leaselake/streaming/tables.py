"""A keyed table as a log of batches over compacted parts, merged when read.

A batch of changes is appended as one folder, so it costs what it holds and not
what the table holds. Readers take the newest row of each key: the changes since a
part was compacted stand before its base. A part (a hash of the key, or a day) is
compacted on its own once its changes are many beside its rows, so each row is
rewritten a bounded number of times, and parts that do not change are left alone.

    log/_b=<number>_<stream>_<batch>/_part=<part>/   changes, in the order of numbers
    base/_part=<part>/_v=<number>/                   rows after changes up to number

A folder appears whole, by renaming; the file system must rename folders
atomically, which object stores do not. A base is used once its ``_SUCCESS`` is
there, and what it replaces is deleted afterwards, so a run that dies in between
leaves a whole table. Batches and compactions of one table have one writer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaselake.scratch import file_system, with_conf

#: Changes of a part, as a share of its rows, and batches of a table, from which it
#: is compacted.
SHARE, BATCHES = 0.2, 50
#: Parts that a key's hash chooses from.
PARTS = 16
_OWN = ("_part", "_b", "_v", "_number", "_r", "deleted")


def stream_id(spark: SparkSession) -> str:
    """Id of the streaming query that runs now: it stays with its checkpoint, and a
    new checkpoint, whose batches count from 0 again, has another. Empty outside."""
    return (spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "").replace("-", "")


@contextmanager
def dealt_out(spark: SparkSession) -> Iterator[None]:
    """Within it, ``rebalance`` deals rows by their part to all partitions, and splits
    large ones: a stream's session plans without adaptive execution and would leave
    them where they are, each task with a file of every part; merged partitions would
    leave all parts' files to one task."""
    with with_conf(spark, {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        yield


def hash_part(key: str, parts: int = PARTS) -> Column:
    return F.lpad(F.pmod(F.xxhash64(key), F.lit(parts)).cast("string"), 3, "0")


class LogTable:
    """``schema`` is DDL of the rows, ``keys`` names them, ``part`` is the column
    expression of a row's part: a text, never null, that a row's key decides."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], part: Column, blank: bool = False):
        """``blank``: nulls of columns other than keys are read as empty texts, such as
        those of a column that older rows do not have."""
        self.spark, self.path, self.schema, self.keys, self.part, self.blank = spark, path, schema, keys, part, blank
        self.columns = spark.createDataFrame([], schema).columns
        if clash := set(_OWN) & set(self.columns):
            raise ValueError(f"columns {sorted(clash)} are the table's own")

    # Folders --------------------------------------------------------------------

    def _names(self, where: str) -> list[str]:
        fs, at = file_system(self.spark, f"{self.path}/{where}" if where else self.path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, where: str) -> None:
        fs, at = file_system(self.spark, f"{self.path}/{where}")
        fs.delete(at, True)

    def exists(self) -> bool:
        fs, at = file_system(self.spark, self.path)
        return fs.exists(at)

    def create(self, made_by: str = "") -> None:
        fs, at = file_system(self.spark, f"{self.path}/log")
        fs.mkdirs(at)
        if made_by:
            fs.mkdirs(file_system(self.spark, f"{self.path}/made/{made_by}")[1])

    def drop(self, unless_made_by: str = "") -> None:
        """Delete the table, but not one that ``create`` made for the same batch."""
        fs, at = file_system(self.spark, self.path)
        if not unless_made_by or not fs.exists(file_system(self.spark, f"{self.path}/made/{unless_made_by}")[1]):
            fs.delete(at, True)

    def batches(self) -> list[tuple[int, str]]:
        """(number, stream and batch) of the batches in the log, in order."""
        names = [n[3:].split("_", 1) for n in self._names("log") if n.startswith("_b=")]
        return sorted((int(number), made_by) for number, made_by in names)

    def bases(self) -> dict[str, int]:
        """Number up to which each part is compacted."""
        found = {}
        fs, _ = file_system(self.spark, self.path)
        for name in self._names("base"):
            done = [int(v[3:]) for v in self._names(f"base/{name}") if fs.exists(file_system(self.spark, f"{self.path}/base/{name}/{v}/_SUCCESS")[1])]
            if done:
                found[name.removeprefix("_part=")] = max(done)
        return found

    # Reading --------------------------------------------------------------------

    def _changes(self, bases: dict[str, int]) -> DataFrame:
        """Rows of the log that no base holds: ``_part, _number, deleted``, columns."""
        batches = self.batches()
        if not batches:
            return self.spark.createDataFrame([], f"_part string, _number long, deleted boolean, {self.schema}")
        read = self.spark.read.schema(f"{self.schema}, deleted boolean, _b string, _part string").option("basePath", f"{self.path}/log")
        rows = read.parquet(*[f"{self.path}/log/_b={n}_{by}" for n, by in batches]).withColumn("_number", F.split("_b", "_")[0].cast("long"))
        if bases:
            done = F.create_map(*[F.lit(x) for pair in bases.items() for x in pair])  # a part each
            rows = rows.where(F.col("_number") > F.coalesce(done[F.col("_part")], F.lit(-1)))
        return rows.select("_part", "_number", "deleted", *self.columns)

    def _base(self, bases: dict[str, int]) -> DataFrame:
        if not bases:
            return self.spark.createDataFrame([], f"_part string, {self.schema}")
        read = self.spark.read.schema(f"{self.schema}, _part string, _v long").option("basePath", f"{self.path}/base")
        return read.parquet(*[f"{self.path}/base/_part={p}/_v={v}" for p, v in bases.items()]).select("_part", *self.columns)

    def _merged(self, bases: dict[str, int], parts: list[str] | None = None) -> DataFrame:
        changes, base = self._changes(bases), self._base(bases)
        if parts is not None:
            changes, base = changes.where(F.col("_part").isin(parts)), base.where(F.col("_part").isin(parts))
        by = [F.col("_part"), *[F.col(k).alias(f"_{k}") for k in self.keys]]
        newest = changes.groupBy(*by).agg(F.max_by(F.struct("deleted", *self.columns), "_number").alias("_r"))
        same = reduce(lambda a, b: a & b, [base[k].eqNullSafe(newest[f"_{k}"]) for k in self.keys], base["_part"] == newest["_part"])
        kept = base.join(newest.select("_part", *[f"_{k}" for k in self.keys]), same, "left_anti")
        return kept.unionByName(newest.where(~F.col("_r.deleted")).select("_part", *[F.col("_r")[c].alias(c) for c in self.columns]))

    def read(self) -> DataFrame:
        """The table as it is now. A day's rows are found by its part: a filter on the
        part's column, if it is one, reaches the folders."""
        return self._filled(self._merged(self.bases()))

    def read_parts(self, parts: list[str]) -> DataFrame:
        return self._filled(self._merged(self.bases(), parts))

    def _filled(self, rows: DataFrame) -> DataFrame:
        return rows.select([F.coalesce(c, F.lit("")).alias(c) if self.blank and c not in self.keys else c for c in self.columns])

    # Writing --------------------------------------------------------------------

    def append(self, changed: DataFrame, batch_id: int) -> bool:
        """Append a batch once: rows of ``schema``, one a key, and ``deleted`` if any
        goes. A stream's batches count up; one that runs a second time changes nothing,
        and False is returned."""
        stream = stream_id(self.spark)
        made_by, batches, bases = f"{stream}_{batch_id}", self.batches(), self.bases()
        if self._folded(stream) >= batch_id or any(by == made_by for _, by in batches):
            return False
        number = max([n for n, _ in batches] + list(bases.values()) + [-1]) + 1
        gone = F.col("deleted") if "deleted" in changed.columns else F.lit(False)
        rows = changed.select(*self.columns, gone.alias("deleted"), self.part.alias("_part"))
        hidden, name = f"{self.path}/_{made_by}", f"{self.path}/log/_b={number}_{made_by}"
        # a part's rows of one batch in few files; skewed parts are split
        with dealt_out(rows.sparkSession):
            rows.hint("rebalance", F.col("_part")).write.mode("overwrite").partitionBy("_part").parquet(hidden)
        self.create()
        fs, at = file_system(self.spark, name)
        if not fs.rename(file_system(self.spark, hidden)[1], at):
            raise OSError(f"{name} could not be put in place")
        return True

    def compact(self, share: float = SHARE, batches: int = BATCHES, least: int = 1) -> list[str]:
        """Fold the changes of parts that have many into their bases; all parts with
        changes once the log holds over ``batches`` batches. Gives the parts. Parts
        without a base wait until ``least`` batches have changed them: what one batch
        brought is as it would be in a base."""
        bases = self.bases()
        self._clean(bases)
        found = self.batches()
        if not found:
            return []
        top = found[-1][0]
        early: set[str] = set()
        if least > 1 and len(found) <= batches:
            changed = Counter(p.removeprefix("_part=") for n, by in found for p in self._names(f"log/_b={n}_{by}") if p.startswith("_part="))
            early = {p for p, n in changed.items() if p not in bases and n < least}
            if len(early) == len(changed):
                return []
        waiting = {r["_part"]: r["n"] for r in self._changes(bases).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a part
        held = {r["_part"]: r["n"] for r in self._base(bases).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
        due = sorted(p for p, n in waiting.items() if p not in early and (len(found) > batches or n > share * held.get(p, 0) and held.get(p, 0) + n > 1))
        if due:
            hidden = f"{self.path}/_compact"
            self._delete("_compact")
            with dealt_out(self.spark):
                self._merged(bases, due).hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(hidden)
            for part in due:
                self._put_base(hidden, part, top)
            self._delete("_compact")
        return due

    def _put_base(self, hidden: str, part: str, number: int) -> None:
        fs, to = file_system(self.spark, f"{self.path}/base/_part={part}/_v={number}")
        _, made = file_system(self.spark, f"{hidden}/_part={part}")
        _, mark = file_system(self.spark, f"{hidden}/_part={part}/_SUCCESS")
        fs.mkdirs(made)  # all rows of the part may be gone
        fs.create(mark, True).close()
        fs.mkdirs(to.getParent())
        if not fs.rename(made, to):
            raise OSError(f"{to} could not be put in place")

    def _folded(self, stream: str) -> int:
        """The last batch of a stream that left the log."""
        return max([int(n.split("_", 1)[1]) for n in self._names("done") if n.split("_", 1)[0] == stream], default=-1)

    def _clean(self, bases: dict[str, int]) -> None:
        """Delete what the compaction before this one replaced, which readers may have
        used until now: older bases, and batches that every part has folded."""
        for part, number in bases.items():
            for v in self._names(f"base/_part={part}"):
                if int(v[3:]) < number:
                    self._delete(f"base/_part={part}/{v}")
        for number, by in self.batches():
            parts = [n.removeprefix("_part=") for n in self._names(f"log/_b={number}_{by}") if n.startswith("_part=")]
            if all(bases.get(p, -1) >= number for p in parts):
                stream, batch = by.split("_", 1)
                last = self._folded(stream)
                if int(batch) > last:  # its batch may run again
                    fs, mark = file_system(self.spark, f"{self.path}/done/{by}")
                    fs.create(mark, True).close()
                    self._delete(f"done/{stream}_{last}")
                self._delete(f"log/_b={number}_{by}")

    def drop_parts(self, first: str, last: str) -> list[str]:
        """Delete the parts outside of ``first`` to ``last``, as text; gives them."""
        gone = set()
        for where in ["base", *[f"log/_b={n}_{by}" for n, by in self.batches()]]:
            for name in self._names(where):
                if name.startswith("_part=") and not first <= name.removeprefix("_part=") <= last:
                    self._delete(f"{where}/{name}")
                    gone.add(name.removeprefix("_part="))
        return sorted(gone)


def dimension_table(spark: SparkSession, path: str, columns: list[str]) -> LogTable:
    """A dimension: text columns by ``key``, dealt by its hash, nulls as empty texts."""
    return LogTable(spark, path, ", ".join(f"`{c}` string" for c in ["key", *columns]), ["key"], hash_part("key"), blank=True)


def day_table(spark: SparkSession, path: str, schema: str, keys: list[str], day: str = "cur_date") -> LogTable:
    """A summary table whose parts are days."""
    return LogTable(spark, path, schema, keys, F.col(day))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def drop_old_days(table: LogTable, today: str, keep: int = 100, ahead: int = 30) -> list[str]:
    """Delete the days more than ``keep`` before ``today`` and more than ``ahead``
    after it, as the summary tables' range says."""
    dates = [F.date_add(F.lit(today).cast("date"), n).cast("string") for n in (-keep, ahead)]
    first, last = table.spark.range(1).select(*dates).first()
    return table.drop_parts(first, last)
