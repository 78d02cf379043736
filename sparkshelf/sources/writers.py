"""Writers for tables of files: a commit log over one or several tables, upserts, replace-by-key, staged swaps, change logs.

A store is a folder of table versions and a log. A write makes new versions and then commits them by one entry of the log, so readers see the old
or the new rows of all its tables and never a mixture, and a job that dies leaves the old ones in place. All paths go through Hadoop's file systems."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """Tables under ``path`` with a log of commits.

    An entry of the log says for each table which folder holds it. It is written whole under another name and then renamed to its number, which fails if
    the number is taken; so an entry is there whole or not at all, and a writer that dies before the rename leaves a file that nobody reads. Entries that can't be
    read (of other makers, or cut off) keep their numbers and are stepped over. The rename is exclusive where the file system's is (HDFS and its like);
    object stores that copy instead need one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def _fs(self, at: str):
        p = self.jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        """Numbers that the log has given out, in order, whatever their entries hold."""
        fs, p = self._fs(f"{self.path}/_commits")
        return sorted(int(s.getPath().getName()) for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getPath().getName().isdigit())

    def _entry(self, number: int) -> dict[str, str] | None:
        fs, p = self._fs(f"{self.path}/_commits/{number:09d}")
        try:
            stream = fs.open(p)
        except Exception:
            if fs.exists(p):
                raise
            return None  # cleaned away since it was listed
        try:
            found = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or "null")
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) else None

    def log(self) -> list[tuple[int, dict[str, str]]]:
        """(number, folders by table) of the commits that are kept, oldest first."""
        return [(n, e) for n in self._numbers() if (e := self._entry(n)) is not None]

    def _newest(self, back: int = 0) -> tuple[int, dict[str, str]]:
        """The number that the next commit takes, and the entry ``back`` commits before the newest; reads no more entries than that."""
        numbers = self._numbers()
        for n in reversed(numbers):
            entry = self._entry(n)
            if entry is not None and back == 0:
                return numbers[-1] + 1, entry
            back -= entry is not None
        return (numbers[-1] + 1 if numbers else 0), {}

    def _table(self, folder: str | None) -> DataFrame | None:
        return None if folder is None else self.spark.read.parquet(f"{self.path}/{folder}")

    def read(self, table: str, back: int = 0) -> DataFrame | None:
        """The newest version of a table, or that of ``back`` commits before; None if there is none."""
        return self._table(self._newest(back)[1].get(table))

    def _stored(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, number: int, entry: Mapping[str, str]) -> bool:
        """Puts an entry under this number; False if another writer has taken it."""
        fs, made = self._fs(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(dict(entry)), "utf-8"))
        out.close()
        _, wanted = self._fs(f"{self.path}/_commits/{number:09d}")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(wanted.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, wanted, options)
        except Exception as e:
            taken = fs.exists(wanted)
            fs.delete(made, False)
            if taken:
                return False
            raise e
        return True

    def write(self, tables: Mapping[str, DataFrame]) -> None:
        """Writes all rows of the tables first, then commits them together: of writers at once the last one holds. Other tables stay as they are."""
        made = {t: self._stored(df) for t, df in tables.items()}
        while True:
            number, entry = self._newest()
            if self._commit(number, {**entry, **made}):
                return

    def update(self, change: Callable[[Callable[[str], DataFrame | None]], Mapping[str, DataFrame]], attempts: int = 20) -> None:
        """Commits what change makes of the newest versions (it is given a reader of them); if another writer was first, change is done again on
        theirs, so no update of any table is lost."""
        for _ in range(attempts):
            number, entry = self._newest()
            made = {t: self._stored(df) for t, df in change(lambda t, entry=entry: self._table(entry.get(t))).items()}
            if self._commit(number, {**entry, **made}):
                return
        raise RuntimeError(f"other writers were first {attempts} times")

    def rollback(self) -> None:
        """Commits the entry before the newest again; no row is rewritten."""
        number, _ = self._newest()
        _, before = self._newest(1)
        if not before:
            raise ValueError("there is no earlier version")
        if not self._commit(number, before):
            raise RuntimeError("another writer was first")

    def clean(self, keep: int = 10, hours: float = 24.0) -> int:
        """Removes entries of the log but for the newest ``keep``, and what no kept entry names and nobody has touched for ``hours``: folders of old versions
        and of writers that died, and entries that never got a number. Returns how many folders went. hours must be longer than any write
        or read takes: a write is safe before its commit only by its age."""
        if keep < 1:
            raise ValueError("the newest commit stays")
        kept = self.log()[-keep:]
        named = {folder for _, entry in kept for folder in entry.values()}
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return 0
        old = self.jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
        gone = 0
        for n in self._numbers():
            if kept and n < kept[0][0]:
                fs.delete(self._fs(f"{self.path}/_commits/{n:09d}")[1], False)
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if s.isDirectory() and name != "_commits" and name not in named and s.getModificationTime() <= old:
                gone += bool(fs.delete(s.getPath(), True))
        _, commits = self._fs(f"{self.path}/_commits")
        for s in fs.listStatus(commits) if fs.exists(commits) else []:
            if s.getPath().getName().startswith(".") and not s.getPath().getName().endswith(".crc") and s.getModificationTime() <= old:
                fs.delete(s.getPath(), False)
        return gone


class Versioned:
    """A store of one table."""

    TABLE = "rows"

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    def versions(self) -> list[str]:
        """Folders of the committed versions, oldest first."""
        return [entry[self.TABLE] for _, entry in self.store.log()]

    def read(self, back: int = 0) -> DataFrame | None:
        """The newest version, or one ``back`` versions before it; None if there is none."""
        return self.store.read(self.TABLE, back)

    def write(self, df: DataFrame) -> DataFrame:
        self.store.write({self.TABLE: df})
        return self.read()

    def update(self, change: Callable[[DataFrame | None], DataFrame], attempts: int = 20) -> DataFrame:
        """Commits change of the newest version as the one after it; see Store.update."""
        self.store.update(lambda read: {self.TABLE: change(read(self.TABLE))}, attempts)
        return self.read()

    def rollback(self) -> DataFrame:
        self.store.rollback()
        return self.read()

    def clean(self, keep: int = 10, hours: float = 24.0) -> int:
        return self.store.clean(keep, hours)

    def _stored(self, df: DataFrame) -> str:
        return self.store._stored(df)

    def _commit(self, number: int, name: str) -> bool:
        return self.store._commit(number, {self.TABLE: name})


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their keys; of new rows of one key, any one."""
    new = new.dropDuplicates(keys)
    return new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def _blank(c: Column, kind: str) -> Column:
    return c.isNull() | (F.trim(c) == "") if kind == "string" else c.isNull()


def merge_known(old: DataFrame | None, new: DataFrame, keys: list[str], never: tuple[str, ...] = (), positive: tuple[str, ...] = ()) -> DataFrame:
    """Upsert that never blanks a known value: null or empty text keeps the old value, as does 0 in ``positive`` columns; ``never`` columns keep theirs in
    any case. 0 and false elsewhere are values."""
    new = new.dropDuplicates(keys)
    if old is None:
        return new
    kinds = dict(new.dtypes)
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in new.columns if c not in keys])
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        if c not in kinds:
            out.append(F.col(c))
            continue
        fresh = F.col(f"__{c}")
        empty = _blank(fresh, kinds[c])
        if c in positive:
            empty = empty | (fresh <= 0)
        if c in never:
            empty = empty | F.col(c).isNotNull()
        out.append(F.when(empty, F.coalesce(F.col(c), fresh)).otherwise(fresh).alias(c))
    return old.join(n, keys, "full_outer").select(*out)


def replace_keys(old: DataFrame | None, new: DataFrame, keys: list[str], emptied: DataFrame | None = None) -> DataFrame:
    """All old rows of the keys in new (or in emptied) go, then the new rows are added."""
    if old is None:
        return new
    gone = new.select(*keys) if emptied is None else new.select(*keys).union(emptied.select(*keys))
    return old.join(gone.distinct(), keys, "left_anti").unionByName(new)


def swap_staged(live: DataFrame, quarantine: DataFrame, staged: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live, quarantine, previous): staged rows replace those of their videos, with a reason into quarantine; previous keeps what was replaced."""
    videos = staged.select(key).distinct()
    before = live.join(videos, key, "left_semi").unionByName(quarantine.join(videos, key, "left_semi"), allowMissingColumns=True)
    ok = staged.where("reason is null").drop("reason")
    new_live = live.join(videos, key, "left_anti").unionByName(ok, allowMissingColumns=True)
    new_quarantine = quarantine.join(videos, key, "left_anti").unionByName(staged.where("reason is not null"), allowMissingColumns=True)
    return new_live, new_quarantine, before


def changes_only(history: DataFrame, points: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """Points to append to a history: those above 0 that differ from the point before them, in the history or among themselves."""
    last = history.groupBy(key).agg(F.max_by(value, F.struct(ts, value)).alias("__last"))
    w = Window.partitionBy(key).orderBy(ts, value)
    p = points.where(F.col(value) > 0).join(last, key, "left").withColumn("__before", F.coalesce(F.lag(value).over(w), F.col("__last")))
    return p.where(~F.col("__before").eqNullSafe(F.col(value))).drop("__last", "__before")


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows that are not in old with the same values (nulls equal): what a write need touch."""
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return new.withColumn("__h", h).join(old.select(key, h.alias("__h")), [key, "__h"], "left_anti").drop("__h")


def references(targets: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, total, message): how many rows of each child refer to a target; rows with a total may not be deleted."""
    parts = None
    for name, (child, column) in children.items():
        n = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
        parts = n if parts is None else parts.unionByName(n)
    said = parts.groupBy(key).agg(F.sum("n").alias("total"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", F.col("n").cast("string"), "what"))), ", ").alias("message"))
    return targets.select(key).join(said, key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("message", F.lit("")).alias("message"))


def cascade(tables: dict[str, tuple[DataFrame, str, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """tables: name -> (rows, column, delete or nullify). Rows of the gone keys are deleted, or lose the reference."""
    g = gone.select(F.col(key).alias("__g")).distinct()
    out = {}
    for name, (df, column, how) in tables.items():
        if how == "delete":
            out[name] = df.join(g, F.col(column) == F.col("__g"), "left_anti")
        else:
            out[name] = df.join(g, F.col(column) == F.col("__g"), "left").withColumn(column, F.when(F.col("__g").isNull(), F.col(column))).drop("__g")
    return out


def load_once(old: DataFrame | None, header: DataFrame, hash_column: str = "file_hash") -> DataFrame:
    """The header if its file hash is new; no rows if it was loaded before."""
    return header if old is None else header.join(old.select(hash_column), hash_column, "left_anti")


def stamp_seen(df: DataFrame, key: Column, seen: DataFrame, seen_key: str, now: Column, stamp: str = "last_seen_at") -> DataFrame:
    s = seen.select(F.col(seen_key).alias("__s")).distinct()
    return df.withColumn("__k", key).join(s, F.col("__k") == F.col("__s"), "left").withColumn(stamp, F.when(F.col("__s").isNotNull(), now).otherwise(F.col(stamp))).drop("__k", "__s")


def replace_auto_links(links: DataFrame, matches: DataFrame, review: str = "review_id") -> DataFrame:
    """The automatic links of the matched reviews give way to the matches that have a family; human links stay."""
    gone = links.where("source = 'auto'").join(matches.select(review), review, "left_semi")
    kept = links.join(gone.select(review, "source").distinct(), [review, "source"], "left_anti")
    return kept.unionByName(matches.where("family_id is not null").withColumn("source", F.lit("auto")).select(*links.columns))


def derived_links(old: DataFrame) -> DataFrame:
    """Links from rows of an older shape: full confidence means that a person made them."""
    return old.where("family_id is not null").withColumn("source", F.when(F.col("confidence") == 100, "human").otherwise("auto"))


def report_lines(report: list[dict]) -> str:
    """A plain text report of a step runner."""
    lines = []
    for r in report:
        tail = r["error"] or (f"{r['count']} rows" if r["count"] is not None else "")
        lines.append(f"{r['status']:>8}  {r['step']}" + (f": {tail}" if tail else ""))
    return "\n".join(lines)


def append_trace(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines, whole."""
    df.write.mode("append").json(path)


#: Fixed value: characters of a preview.
PREVIEW = 2000


def previews(df: DataFrame, limit: int = PREVIEW) -> DataFrame:
    """df with its texts cut to ``limit`` characters."""
    return df.select(*[F.left(c, F.lit(limit)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def append_telemetry(df: DataFrame, path: str, limit: int = PREVIEW) -> None:
    """Appends rows as JSON lines, texts cut to previews of ``limit`` characters."""
    append_trace(previews(df, limit), path)
