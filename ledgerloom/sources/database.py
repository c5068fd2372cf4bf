"""Tables of databases, read in ranges of their key that hold about as many rows each, and bulk loads that are seen whole."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import dense_keys
from .readers import with_provenance

#: Buckets of a histogram query for each wanted range, and rows a fetch.
FINE, FETCH = 8, 50_000
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


def _plain(name: str) -> str:
    """Names go into SQL text, so only plain ones are taken."""
    if not NAME.fullmatch(name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


@dataclass
class Database:
    """A JDBC url with its options (driver, user, password); session is run on each connection, such as SET TIME ZONE 'UTC'.

    Columns are named as the database has them, case included; quote is what it puts around a name.
    """

    spark: SparkSession
    url: str
    options: dict[str, str] = field(default_factory=dict)
    session: str = ""
    quote: str = '"'
    rename: str = "RENAME TABLE {old} TO {new}"

    def _read(self):  # noqa: ANN202
        reader = self.spark.read.format("jdbc").option("url", self.url).option("fetchsize", FETCH).options(**self.options)
        return reader.option("sessionInitStatement", self.session) if self.session else reader

    def _column(self, name: str) -> str:
        return f"{self.quote}{_plain(name)}{self.quote}"

    def ask(self, sql: str) -> DataFrame:
        """A query that the database answers; for aggregates, whose results are small."""
        return self._read().option("query", sql).load()

    def run(self, *statements: str) -> None:
        """Statements without a result, on one connection of the driver."""
        properties = self.spark._jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            for s in statements:
                statement = connection.createStatement()
                statement.execute(s)
                statement.close()
        finally:
            connection.close()

    def wait(self, tries: int = 10, pause: float = 1.0, probe: str = "VALUES 1") -> None:
        """Until the database answers; after so many tries its own error."""
        for k in range(tries):
            try:
                self.run(probe)
                return
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(pause)

    def exists(self, name: str) -> bool:
        try:
            self.ask(f"SELECT 1 AS one FROM {_plain(name)} WHERE 1 = 0").schema  # noqa: B018
        except Exception:  # noqa: BLE001
            return False
        return True

    def ranges(self, name: str, key: str, parts: int) -> list[tuple[int, int, int]]:
        """(low, high, rows) of ranges of a whole-number key, ascending, with at most about rows / parts rows each.

        The database counts rows in equal buckets of the key; buckets with too many are counted again in finer ones, until they are small or
        hold one key. Neighbours are put together as far as they fit. So keys that crowd in a few places are as well dealt as even ones; what
        comes to the driver is FINE counts a range.
        """
        _plain(name)
        key = self._column(key)
        low, high, n = self.ask(f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT({key}) AS n FROM {name}").first()
        if not n:
            return []
        most = -(-int(n) // parts)
        open_, done = [(int(low), int(high), int(n))], []
        while open_:
            lo, hi, rows = open_.pop()
            if rows <= most // 2 or lo == hi:
                done.append((lo, hi, rows))
                continue
            width = -(-(hi - lo + 1) // (FINE * max(2, -(-rows // max(1, most)))))
            # quotients towards zero, as no difference of keys is sure to fit the key's type
            inner = f"SELECT ({key} - MOD({key}, {width})) / {width} AS b FROM {name} WHERE {key} BETWEEN {lo} AND {hi}"
            for b, k in self.ask(f"SELECT b, COUNT(*) AS k FROM ({inner}) x GROUP BY b").collect():
                first, last = int(b) * width - (width - 1) * (b <= 0), int(b) * width + (width - 1) * (b >= 0)
                open_.append((max(lo, first), min(hi, last), int(k)))
        out: list[tuple[int, int, int]] = []
        for lo, hi, rows in sorted(done):
            if out and out[-1][2] + rows <= most:
                out[-1] = (out[-1][0], hi, out[-1][2] + rows)
            else:
                out.append((lo, hi, rows))
        return out

    def table(self, name: str, columns: list[str], key: str, source: str, parts: int = 16, numbered: bool = True) -> DataFrame:
        """Columns of a table with provenance, a task for each range of ranges() with a cursor of its own; rows without a key are a range too.

        _line is the row's number by key (equal keys in any order of their columns), or the key itself with numbered=False, which needs no sort.
        The ranges reach to either side of the least and greatest key, so rows that come in while the table is read are not lost to the plan.
        """
        chosen, k = ", ".join(map(self._column, columns)), self._column(key)
        cuts = [r[0] for r in self.ranges(name, key, parts)][1:]
        tests = [f"{k} < {cuts[0]}", *(f"{k} >= {a} AND {k} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)), f"{k} >= {cuts[-1]}"] if cuts else [f"{k} IS NOT NULL"]
        reader = self._read()
        options = {"fetchsize": str(FETCH), **self.options} | ({"sessionInitStatement": self.session} if self.session else {})
        df = reader.jdbc(self.url, f"(SELECT {chosen} FROM {_plain(name)}) t", predicates=[*tests, f"{k} IS NULL"], properties=options)
        if not numbered:
            return with_provenance(df, source, F.col(key))
        order = [F.col(key).asc_nulls_last(), *(F.col(c).asc() for c in columns if c != key)]
        return with_provenance(dense_keys(df, order, "_number"), source, F.col("_number")).drop("_number")

    def load(self, df: DataFrame, name: str, parts: int = 8, types: str = "") -> int:
        """Replaces a table by df and gives its rows. The rows go into a table beside it, are counted there, and take the old one's place by renaming.

        A load that fails, or that lost or doubled rows (a task that ran twice, say), leaves the old table.
        """
        beside, old = f"{_plain(name)}_load", f"{name}_old"
        self.run(*(f"DROP TABLE {t}" for t in (beside, old) if self.exists(t)))
        writer = df.repartition(parts).write.format("jdbc").option("url", self.url).option("dbtable", beside).option("batchsize", FETCH).options(**self.options)
        (writer.option("createTableColumnTypes", types) if types else writer).mode("overwrite").save()
        loaded, wanted = self.ask(f"SELECT COUNT(*) AS n FROM {beside}").first()[0], df.count()
        if int(loaded) != wanted:
            raise RuntimeError(f"{name}: {loaded} rows were loaded of {wanted}")
        short = old.rpartition(".")[2]
        moves = [self.rename.format(old=name, new=short)] if self.exists(name) else []
        self.run(*moves, self.rename.format(old=beside, new=name.rpartition(".")[2]))
        if moves:
            self.run(f"DROP TABLE {old}")
        return wanted
