"""Lines that many documents share, found through levelled sorted runs of line hashes.

Documents arrive in batches. A run is a table of line keys, sorted and bucketed by key, with the number of documents that
hold each and the largest of their ids. Each key is in one run: a batch is merge-anti-joined with the runs, and the keys
that none of them has become a run of their own; the others only add what they count to the run that has
them, as increments beside it. ``fan_out`` runs of a level are compacted, with their increments, into one
of the next, so a key is rewritten a logarithmic number of times. Keys are 128 bits of two
differently seeded hashes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.text import ascii_lower, lines, stripped, text_hash, whole
from jobtide.llm.workspace import Workspace

MIN_CHARS = 40
MIN_DOCS = 5
FAN_OUT = 2
KEY = ["h1", "h2"]
#: Lines of a batch for each core of the cluster, and keys of a bucket, about.
CORE_LINES = 1 << 18
BUCKET_LINES = 1 << 21
#: Parts in which lines are stored; a batch is some of them or a part of one.
SLICES = 8


@dataclass
class Run:
    """A bucketed table of keys that no other run has, and folders of increments to them."""

    table: str
    increments: list[str] = field(default_factory=list)


class LineRuns:
    """Runs ``h1, h2, n_docs, last_id`` by level, in a workspace.

    Tables share one number of buckets, so joins with a run move no row of it or of a batch. ``close`` drops them all.
    """

    def __init__(self, space: Workspace, fan_out: int = FAN_OUT, buckets: int | None = None):
        self.space, self.fan_out = space, fan_out
        self.spark = space.spark
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = []
        self._tables: set[str] = set()

    def _store(self, keys: DataFrame) -> str:
        table = f"line_run_{uuid.uuid4().hex}"
        self._tables.add(table)
        (
            keys.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", self.space.path(table))
            .saveAsTable(table)
        )
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.space.drop(table)
        self._tables.discard(table)

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def add(self, held: DataFrame) -> None:
        """Add a batch of ``h1, h2, id``: one row for each line of each document.

        No document may occur in two batches; within one, repeats of a key count once.
        """
        keys = (
            held.groupBy(*KEY, "id")
            .agg(F.lit(1).alias("one"))
            .groupBy(*KEY)
            .agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id"))
        )
        batch = self._store(keys)
        unseen = self.spark.table(batch)
        for run in self.runs():
            known = self.spark.table(run.table).select(*KEY)
            name = f"more-{uuid.uuid4().hex}"
            self.space.save(self.spark.table(batch).join(known, KEY, "left_semi"), name)
            run.increments.append(name)
            unseen = unseen.join(known, KEY, "left_anti")
        if self.levels:
            fresh = self._store(unseen)
            self._drop(batch)
        else:
            fresh, self.levels = batch, [[]]
        self.levels[0].append(Run(fresh))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fan_out:
                if len(self.levels) == level + 1:
                    self.levels.append([])
                self.levels[level + 1].append(Run(self._store(self._merged(full))))
                self.levels[level] = []
                for run in full:
                    self._drop(run.table)
                    self.space.drop(*run.increments)
            level += 1

    def _merged(self, runs: list[Run]) -> DataFrame:
        """One row for each key of some runs, its increments added.

        A union is made of the files, not of the tables: Spark takes a union of bucketed scans for
        bucketed but lines their partitions up one after another, so equal keys would stay apart.
        """
        schema = self.spark.table(runs[0].table).schema
        folders = [name for run in runs for name in (run.table, *run.increments)]
        rows = self.spark.read.schema(schema).parquet(*map(self.space.path, folders))
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))

    def shared(self, min_docs: int) -> DataFrame:
        """``h1, h2, last_id`` of the keys that at least ``min_docs`` documents hold, run by run."""
        found = None
        for run in self.runs():
            own = self._merged([run]).where(F.col("n_docs") >= min_docs).select(*KEY, "last_id")
            found = own if found is None else found.union(own)
        return found

    def close(self) -> None:
        for run in self.runs():
            self.space.drop(*run.increments)
        for table in list(self._tables):
            self._drop(table)
        self.levels = []


def _batches(n_lines: int, at_once: int) -> int:
    """As many as the lines need, so that slices are read whole or, beyond their number, a few times."""
    wanted = max(1, -(-n_lines // at_once))
    return 1 << (wanted - 1).bit_length() if wanted <= SLICES else -(-wanted // SLICES) * SLICES


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int | None = None,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """All rows and columns, with the text cut to its kept lines, and ``n_lines, n_dropped``.

    A line's key is the line without white space at its ends and with A-Z in lower
    case. Keys of at least ``min_chars`` code points in at least ``min_docs`` documents
    lose all lines except those in the document of the largest id. A null text is one
    empty line and stays null; a text without dropped lines stays byte for byte. Rows of
    one id are one document; null ids are one document below all others, whose
    shared lines go wherever another id holds them. New columns replace those
    of the same name. Without ``batches`` their number follows the lines and the cores of the cluster.
    """
    space = Workspace(docs.sparkSession)
    numbered = docs.select(
        F.col(id_col).alias("id"), whole(text_col).alias("t")
    ).select("id", text_hash(F.col("t")).alias("text_id"), F.posexplode(lines(F.col("t"))).alias("pos", "line"))
    key = stripped(F.col("line"))
    keyed = (
        numbered.select("id", "text_id", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "text_id", "pos", ascii_lower(F.col("key")).alias("key"))
        .select(
            "id",
            "text_id",
            "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int").alias("slice"),
        )
    )
    held = space.save(keyed, "lines", partition_by="slice")
    n_lines = held.count()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    batches = batches or _batches(n_lines, CORE_LINES * cores)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    store = LineRuns(space, fan_out, max(partitions, -(-n_lines // BUCKET_LINES)))
    try:
        for batch in range(batches):
            own = F.pmod(F.xxhash64("id"), F.lit(batches)) == batch
            slices = [s for s in range(SLICES) if batches % SLICES or s == batch % SLICES]
            slices = [s for s in slices if SLICES % batches or s % batches == batch]
            store.add(held.where(own & F.col("slice").isin(slices)).select(*KEY, "id"))
        shared = space.save(store.shared(min_docs), "shared")
    finally:
        store.close()
    lost = (
        held.join(shared, KEY)
        .where(~F.col("id").eqNullSafe(F.col("last_id")))
        .groupBy(F.col("id").alias("lost_id"), F.col("text_id").alias("lost_text"))
        .agg(F.collect_set("pos").alias("lost"))
    )
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("t"),
        text_hash(whole(text_col)).alias("text_id"),
    )
    same = rows.id.eqNullSafe(lost.lost_id) & (rows.text_id == lost.lost_text)
    split = lines(F.col("t"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "lost")
    kept = F.when(F.col("lost").isNull(), F.col("t")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    )
    cut = rows.join(lost, same, "left").select(
        "row",
        kept.alias("kept"),
        F.size(lines(whole("t"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    new = {"n_lines", "n_dropped"}
    return cut.select(
        *(
            (F.col("kept") if c == text_col else F.col("row")[c]).alias(c)
            for c in docs.columns
            if c not in new
        ),
        *sorted(new),
    )
