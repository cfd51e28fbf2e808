"""Line dedup that documents can enter and leave: sharded cuckoo filters before exact reference counts.

A line's key is the line without blanks at both ends, A-Z in lower case. The
index keeps, in the shared folder, only files that are added to:

- *lines*: the place of every line with a key of at least ``MIN_CHARS`` code
  points, with the key's 128-bit BLAKE2b digest (equal digests count as equal);
- *counts*: the exact table, a row for each key that a change touched: how many
  lines hold it and the smallest and largest document; the newest row counts;
- *filters*: a cuckoo filter for each shard of the keys with the keys that some
  line holds.

An insertion folds its lines by key before the shuffle and asks the key's shard.
A key that the filter has not seen is new: its row is written as it is. Only the
others, known ones and the filter's few mistakes, meet the exact table, and the
mistakes enter the filter as keys of their own. A deletion counts the keys of the
documents that leave anew from the lines that stay and takes keys without lines
out of the filter, so inserting and deleting the same documents restores every
answer. A filter over its load is built anew from the exact table.

A key that two documents hold loses its lines in all but the smallest document.

Edge cases: a null or empty text is one empty line, which is kept. Rows that share
an id are one document, also all rows without one, which come after all others;
such rows drop the same keys each, and cannot be deleted by id. Lines may be of
any length; repeated lines of one document stay. An empty table changes nothing.
Other columns are carried along by ``cut`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmine.llm.common import unused
from flowmine.llm.cuckoo import CuckooFilter
from flowmine.session import shared_folder

MIN_CHARS = 10
#: Keys that one shard should hold, and insertions that ``dedup_report`` deals a table into.
SHARD_KEYS, BATCHES = 500_000, 3
#: Lines in a batch that extraction gives out.
GIVEN = 50_000
BLANKS = b" \t\n\x0b\x0c\r"
_LINES = "id long, h long, part int, at int, k1 long, k2 long"
_COUNTS = "k1 long, k2 long, refs long, first long, last long, nulls long, fresh boolean"


def line_key(line: bytes) -> bytes | None:
    """The digest of a line's key, none for a short one."""
    key = line.strip(BLANKS).lower()
    if len(key) < 4 * MIN_CHARS and (len(key) < MIN_CHARS or len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, h, part, text) to the keyed lines."""
    for batch in batches:
        texts = batch.column(3).cast(pa.binary())
        rows, at, digests = [], [], []

        def out() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            own = batch.select([0, 1, 2]).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(at, pa.int32()), pa.array(keys[:, 0]), pa.array(keys[:, 1])],
                ["id", "h", "part", "at", "k1", "k2"])

        for row, text in enumerate(texts):
            for place, line in enumerate((text.as_py() or b"").split(b"\n")):
                digest = line_key(line)
                if digest is not None:
                    rows.append(row)
                    at.append(place)
                    digests.append(digest)
            if len(rows) >= GIVEN:
                yield out()
                rows, at, digests = [], [], []
        if rows:
            yield out()


def _filter_keys(table: pa.Table) -> np.ndarray:
    return table.column("k2").to_numpy().view(np.uint64)


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The keys with whether the shard's filter may hold them."""
    found = CuckooFilter.from_bytes(filters.column("blob")[0].as_py()).contains(_filter_keys(keys)) \
        if filters.num_rows else np.zeros(keys.num_rows, bool)
    return keys.drop_columns("shard").append_column("maybe", pa.array(found))


def _blob(shard: int, held: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "room": pa.array([held.room], pa.int64()),
                     "size": pa.array([held.size], pa.int64()), "blob": pa.array([held.to_bytes()], pa.binary())})


def _change(key: tuple, changes: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's filter with keys added (``up``) and removed."""
    held = CuckooFilter.from_bytes(filters.column("blob")[0].as_py())
    up = changes.column("up").to_numpy(zero_copy_only=False)
    keys = _filter_keys(changes)
    held.remove(keys[~up])
    held.add(keys[up])
    return _blob(key[0].as_py(), held)


def _build(key: tuple, live: pa.Table) -> pa.Table:
    """A shard's filter from its keys, with room for as many again."""
    held = CuckooFilter(2 * live.num_rows)
    held.add(_filter_keys(live))
    return _blob(key[0].as_py(), held)


def _held_twice(first: str = "first", last: str = "last", nulls: str = "nulls") -> Column:
    return (F.col(first) != F.col(last)) | (F.col(first).isNotNull() & (F.col(nulls) > 0))


class LineIndex:
    """Lines of documents that came and did not leave; see the module.

    ``LineIndex(spark)`` starts an empty index in a folder of its own or at
    ``path``; ``LineIndex.open(spark, path)`` goes on with the last state there.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shard_keys: int = SHARD_KEYS):
        self.spark, self.shard_keys = spark, shard_keys
        self.path = path or f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
        self.state: dict = {"version": 0, "bits": 0, "lines": [], "counts": [], "gone": [], "filters": None}

    @classmethod
    def open(cls, spark: SparkSession, path: str, shard_keys: int = SHARD_KEYS) -> LineIndex:
        out = cls(spark, path, shard_keys)
        last = spark.read.option("recursiveFileLookup", "true").schema("version long, state string").parquet(
            f"{path}/state").orderBy(F.desc("version")).first()
        out.state = json.loads(last["state"])
        return out

    # -- files ------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{self.state['version']}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str], schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else out

    def _commit(self) -> None:
        """The state becomes valid with this one small file."""
        row = self.spark.range(1).select(F.lit(self.state["version"]).cast("long").alias("version"),
                                         F.lit(json.dumps(self.state)).alias("state"))
        row.coalesce(1).write.parquet(f"{self.path}/state/{self.state['version']}-{uuid.uuid4().hex}")

    def _shard(self) -> Column:
        return F.shiftright(F.shiftrightunsigned("k1", 33).cast("int"), 31 - self.state["bits"]).alias("shard")

    # -- exact table ------------------------------------------------------

    def _versions(self) -> DataFrame:
        """All rows of the exact table with their version."""
        tables = [self._read([name], _COUNTS).withColumn("v", F.lit(v)) for v, name in self.state["counts"]]
        out = self.spark.createDataFrame([], _COUNTS + ", v int") if not tables else tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def counts(self, rows: DataFrame | None = None) -> DataFrame:
        """(k1, k2, refs, first, last, nulls): the newest row of each key, of those in ``rows`` if given."""
        rows = self._versions() if rows is None else rows
        if len(self.state["counts"]) > 1:
            rows = rows.groupBy("k1", "k2").agg(F.max_by(F.struct("refs", "first", "last", "nulls"), "v").alias("x")) \
                .select("k1", "k2", "x.*")
        return rows.select("k1", "k2", "refs", "first", "last", "nulls")

    def compact(self) -> None:
        """One row a key in the exact table, none for keys without lines."""
        self.state["version"] += 1
        name = self._write(self.counts().filter("refs > 0").withColumn("fresh", F.lit(False)), "counts")
        self.state["counts"] = [[self.state["version"], name]]
        self._commit()

    def lines(self) -> DataFrame:
        """(id, h, at, k1, k2) of the keyed lines of documents that are in."""
        tables = [self._read([n], _LINES).withColumn("v", F.lit(v)) for v, n in self.state["lines"]]
        if not tables:
            return self._read([], "id long, h long, at int, k1 long, k2 long")
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        gone = [self._read([n], "id long").withColumn("gone", F.lit(v)) for v, n in self.state["gone"]]
        if gone:
            left = gone[0]
            for t in gone[1:]:
                left = left.unionByName(t)
            left = left.groupBy("id").agg(F.max("gone").alias("gone"))
            out = out.join(left, "id", "left").filter("gone is null or v > gone")
        return out.select("id", "h", "at", "k1", "k2")

    # -- filters ----------------------------------------------------------

    def filters(self) -> DataFrame:
        names = [self.state["filters"]] if self.state["filters"] else []
        return self._read(names, "shard int, room long, size long, blob binary")

    def _refilter(self, changes: DataFrame) -> None:
        """Filters after ``changes`` (k1, k2, up), which the exact table already holds."""
        schema = "shard int, room long, size long, blob binary"
        now = self.filters()
        sums = changes.groupBy(self._shard()).agg(F.count_if("up").alias("adds"))
        both = now.select("shard", "room", "size").join(sums, "shard", "full").withColumn(
            "full", F.coalesce("room", F.lit(-1)) < F.coalesce("adds", F.lit(0)))
        told, some = both.agg(F.coalesce(F.sum(F.coalesce("size", F.lit(0)) + F.coalesce("adds", F.lit(0))), F.lit(0)),
                              F.count_if("full") > 0).first()
        bits = self.state["bits"]
        while told > 2 * (self.shard_keys << bits):
            bits += 1
        alive = self.counts().filter("refs > 0").select("k1", "k2")
        if bits != self.state["bits"] or not self.state["filters"]:      # other shards: all are built anew
            self.state["bits"] = bits
            out = alive.withColumn("shard", self._shard()).groupBy("shard").applyInArrow(_build, schema)
        else:
            own = changes.withColumn("shard", self._shard())
            anew = None
            if some:                                                     # these are built anew, from their exact keys
                full = self._read([self._write(both.filter("full").select("shard"), "full")], "shard int")
                anew = alive.withColumn("shard", self._shard()).join(full, "shard", "left_semi").groupBy("shard") \
                    .applyInArrow(_build, schema)
                now, own = now.join(full, "shard", "left_anti"), own.join(full, "shard", "left_anti")
            touched = now.join(sums.select("shard"), "shard", "left_semi")
            out = own.groupBy("shard").cogroup(touched.groupBy("shard")).applyInArrow(_change, schema)
            out = out.unionByName(now.join(sums.select("shard"), "shard", "left_anti").select(*out.columns))
            out = out if anew is None else out.unionByName(anew)
        self.state["filters"] = self._write(out, "filters")

    # -- changes ----------------------------------------------------------

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int = 1) -> None:
        """Take in documents; with ``batches`` in so many insertions, dealt by a hash of the id."""
        body = F.col(text).cast("string")
        ids = F.col(id_col).cast("long")
        rows = docs.select(ids.alias("id"), F.xxhash64(body).alias("h"),
                           F.pmod(F.xxhash64(ids), F.lit(batches)).cast("int").alias("part"), body.alias("text"))
        found = rows.mapInArrow(_extract, _LINES)
        self.state["version"] += 1
        name = f"lines/{self.state['version']}-{uuid.uuid4().hex}"
        if batches == 1:
            found.write.parquet(f"{self.path}/{name}")
            self._take_in(name)
            return
        found.withColumn("own", F.col("part")).write.partitionBy("own").parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(_LINES + ", own int").parquet(f"{self.path}/{name}")
        for part in sorted(r[0] for r in written.select("own").distinct().collect()):        # at most ``batches``
            self._take_in(f"{name}/own={part}")
            self.state["version"] += 1

    def _take_in(self, name: str) -> None:
        v = self.state["version"]
        keys = self._read([name], _LINES).groupBy("k1", "k2").agg(
            F.count(F.lit(1)).alias("refs"), F.min("id").alias("first"), F.max("id").alias("last"),
            F.count_if(F.col("id").isNull()).alias("nulls"))
        if not self.state["filters"]:
            rows = keys.withColumn("fresh", F.lit(True))
        else:
            probed = keys.withColumn("shard", self._shard()).groupBy("shard").cogroup(
                self.filters().select("shard", "blob").groupBy("shard")).applyInArrow(
                    _probe, "k1 long, k2 long, refs long, first long, last long, nulls long, maybe boolean")
            path = self._write(probed, "probed")
            probed = self._read([path], "k1 long, k2 long, refs long, first long, last long, nulls long, maybe boolean")
            maybe = probed.filter("maybe").drop("maybe")
            names = ("refs", "first", "last", "nulls")
            old = self.counts(self._versions().join(maybe.select("k1", "k2"), ["k1", "k2"], "left_semi"))
            old = old.select("k1", "k2", *[F.col(c).alias(f"old_{c}") for c in names])
            none = F.coalesce("old_refs", F.lit(0)) == 0
            # A key that had lost all its lines starts afresh.
            merged = maybe.join(old, ["k1", "k2"], "left").select(
                "k1", "k2", (F.col("refs") + F.coalesce("old_refs", F.lit(0))).alias("refs"),
                F.when(none, F.col("first")).otherwise(F.least("first", "old_first")).alias("first"),
                F.when(none, F.col("last")).otherwise(F.greatest("last", "old_last")).alias("last"),
                F.when(none, F.col("nulls")).otherwise(F.col("nulls") + F.col("old_nulls")).alias("nulls"),
                none.alias("fresh"))
            rows = probed.filter("not maybe").drop("maybe").withColumn("fresh", F.lit(True)).unionByName(merged)
        written = self._write(rows, "counts")
        self.state["counts"].append([v, written])
        self.state["lines"].append([v, name])
        self._refilter(self._read([written], _COUNTS).filter("fresh").select("k1", "k2", F.lit(True).alias("up")))
        self._commit()

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents out; ids that are not in change nothing."""
        leaving = ids.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
        before = self.lines()
        touched = before.join(leaving, "id", "left_semi").select("k1", "k2").distinct()
        self.state["version"] += 1
        v = self.state["version"]
        touched = self._read([self._write(touched, "touched")], "k1 long, k2 long")
        self.state["gone"].append([v, self._write(leaving, "gone")])
        stay = self.lines().join(touched, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(
            F.count(F.lit(1)).alias("refs"), F.min("id").alias("first"), F.max("id").alias("last"),
            F.count_if(F.col("id").isNull()).alias("nulls"))
        rows = touched.join(stay, ["k1", "k2"], "left").select(
            "k1", "k2", F.coalesce("refs", F.lit(0)).alias("refs"), "first", "last",
            F.coalesce("nulls", F.lit(0)).alias("nulls"), F.lit(False).alias("fresh"))
        written = self._write(rows, "counts")
        self.state["counts"].append([v, written])
        if self.state["filters"]:
            self._refilter(self._read([written], _COUNTS).filter("refs = 0").select("k1", "k2", F.lit(False).alias("up")))
        self._commit()

    # -- answers ----------------------------------------------------------

    def drops(self) -> DataFrame:
        """(id, h, places) of the documents that lose lines; h is the xxhash64 of the text, places count from 0."""
        twice = self.counts().filter((F.col("refs") > 0) & _held_twice()).select("k1", "k2", "first")
        # Written, so that the join has a plain exchange on both sides and a line of very many documents is split.
        twice = self._read([self._write(twice, "twice")], "k1 long, k2 long, first long")
        lost = self.lines().join(twice, ["k1", "k2"]).filter(~F.col("id").eqNullSafe(F.col("first")))
        return lost.groupBy("id", "h").agg(F.collect_set("at").alias("places"))

    def _with_places(self, docs: DataFrame, id_col: str, text: str, name: str) -> DataFrame:
        none, head, hashed = (unused(docs, c) for c in ("line_none", "line_id", "line_hash"))
        ids = F.col(id_col).cast("long")
        lost = self.drops().select(F.col("id").isNull().alias(none), F.coalesce("id", F.lit(0)).alias(head),
                                   F.col("h").alias(hashed), F.col("places").alias(name))
        keyed = docs.withColumns({none: ids.isNull(), head: F.coalesce(ids, F.lit(0).cast("long")),
                                  hashed: F.xxhash64(F.col(text).cast("string"))})
        return keyed.join(lost, [none, head, hashed], "left").drop(none, head, hashed)

    def report(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(id, n_lines, n_dropped, kept_sha256) of documents that are in."""
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        schema = "id long, n_lines long, n_dropped long, kept_sha256 string"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for body, places in zip(batch.column("text").cast(pa.binary()), batch.column("places")):
                    lines = (body.as_py() or b"").split(b"\n")
                    gone = set(places.as_py() or ())
                    kept = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
                    out.append((len(lines), len(gone), hashlib.sha256(b"\n".join(kept)).hexdigest()))
                columns = list(zip(*out)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.string())], ["id", "n_lines", "n_dropped", "kept_sha256"])
        return self._with_places(rows, "id", "text", "places").select("id", "text", "places").mapInArrow(run, schema)

    def cut(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` without the lines that they lose, other columns unchanged; a null text stays null."""
        name = unused(docs, "line_places")
        found = self._with_places(docs, id_col, text, name)
        kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col(name), i)), "\n")
        return found.withColumn(text, F.when(F.col(name).isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int = BATCHES,
                 shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every row: a fresh index takes the table in and reports on it."""
    index = LineIndex(docs.sparkSession, shard_keys=shard_keys)
    index.insert(docs, id_col, text, batches)
    return index.report(docs, id_col, text)
