"""The keys that a stream has delivered so far, looked up without reading them all.

Keys lie in runs. A run holds the new keys of one micro-batch, or of several whose runs were
merged, cut by the leading bits of the key's hash into files of about ``KEYS_PER_FILE`` keys each,
however large the run is. Beside every file lies a Bloom filter as rows (word, bits). A micro-batch
reads the filters of the files whose hash range holds one of its keys, and then opens only the files
of which a filter says that they can hold one: none for new keys, one for a repeated key, whatever
the history.

``FAN`` runs of one level are merged to a run of the next, so the number of runs grows with the
logarithm of the history. Everything a micro-batch writes has the batch in its name and
replaces what an interrupted attempt left; the list of runs is written last and only then counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS_PER_FILE = 1 << 20
FAN = 8
#: Words of 64 bits for one key of a filter: about eleven bits per key, four of them set.
WORDS_PER_KEY = 1 / 6
RUN_SCHEMA = "run string, level int, bits int, words long, keys long"
LOOKUP_SCHEMA = "runs int, filters_read long, files_opened long, keys_read long"


class Run(NamedTuple):
    """A set of files: 2 ** ``bits`` hash ranges, each with a filter of ``words`` words."""

    run: str
    level: int
    bits: int
    words: int
    keys: int


class Lookup(NamedTuple):
    """The keys of a batch that are known, and what was read to find out."""

    known: DataFrame | None
    runs: int
    filters_read: int
    files_opened: int
    keys_read: int


def _bucket(h: Column, bits: Column) -> Column:
    """The hash range of a hash: its leading bits."""
    return F.when(bits == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(_h, 64 - _bits)").cast("int"))


def _filter_places(words: Column) -> list[Column]:
    """Word and mask of a key in the filter of its file: four bits of one word."""
    word = F.pmod(F.xxhash64("_h", F.lit(1)), words).alias("_word")
    masks = [f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(_h, 2), {6 * i}) & 63 as int))" for i in range(4)]
    return [word, F.expr(" | ".join(masks)).alias("_mask")]


class KeyIndex:
    """Runs of keys below one folder; ``key`` names the key column."""

    def __init__(self, spark: SparkSession, folder: str, key: str, keys_per_file: int = KEYS_PER_FILE, fan: int = FAN):
        self.spark, self.folder, self.key, self.keys_per_file, self.fan = spark, folder, key, keys_per_file, fan

    def runs(self, batch_id: int) -> list[Run]:
        """The runs that hold all keys up to a batch: at most ``fan`` for each level."""
        if batch_id < 0:
            return []
        rows = self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.folder}/runs/batch={batch_id}").collect()
        return [Run(*r) for r in rows]

    def lookup(self, keys: DataFrame, runs: list[Run]) -> Lookup:
        """Which keys are in a run. Only names of hash ranges and files come to the driver."""
        if not runs:
            return Lookup(None, 0, 0, 0, 0)
        listed = F.array(*[F.struct(F.lit(r.run).alias("run"), F.lit(r.bits).alias("bits"), F.lit(r.words).alias("words")) for r in runs])
        each = keys.select(F.col(self.key), F.xxhash64(self.key).alias("_h"), F.explode(listed).alias("_run"))
        each = each.select(self.key, "_h", F.col("_run.run").alias("run"), F.col("_run.bits").alias("_bits"), F.col("_run.words").alias("_words"))
        each = each.withColumn("bucket", _bucket(F.col("_h"), F.col("_bits")))
        asked = [tuple(r) for r in each.select("run", "bucket").distinct().collect()]
        if not asked:
            return Lookup(None, len(runs), 0, 0, 0)
        filters = self._read("filters", asked, "run string, bucket int, word long, bits long")
        probes = each.select(self.key, "run", "bucket", *_filter_places(F.col("_words")))
        maybe = probes.join(filters, ["run", "bucket"]).filter((F.col("_word") == F.col("word")) & (F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask")))
        opened = [tuple(r) for r in maybe.select("run", "bucket").distinct().collect()]
        if not opened:
            return Lookup(None, len(runs), len(asked), 0, 0)
        held = self._read("keys", opened, f"run string, bucket int, {self.key} string")
        return Lookup(held.select(self.key), len(runs), len(asked), len(opened), held.count())

    def _read(self, kind: str, files: list[tuple[str, int]], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/run={run}/bucket={bucket}" for run, bucket in files]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def add(self, keys: DataFrame, batch_id: int, runs: list[Run]) -> list[Run]:
        """The runs after the new keys of a batch, with full levels merged; counts once ``publish`` has run."""
        size = keys.count()
        if size:
            runs = [*runs, self._written(keys, f"{batch_id}-0", 0, size)]
        level = 0
        while len(full := [r for r in runs if r.level == level]) >= self.fan:
            reader = self.spark.read.schema(f"{self.key} string").option("basePath", f"{self.folder}/keys")
            together = reader.parquet(*[f"{self.folder}/keys/run={r.run}" for r in full])
            merged = self._written(together, f"{batch_id}-{level + 1}", level + 1, sum(r.keys for r in full))
            runs = [*[r for r in runs if r.level != level], merged]
            level += 1
        return runs

    def publish(self, batch_id: int, runs: list[Run], lookup: Lookup) -> None:
        """From here on the runs hold all keys up to the batch."""
        note = self.spark.createDataFrame([tuple(lookup)[1:]], LOOKUP_SCHEMA)
        note.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lookups/batch={batch_id}")
        self.spark.createDataFrame(runs, RUN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/runs/batch={batch_id}")

    def lookups(self) -> DataFrame:
        """What each micro-batch has read."""
        return self.spark.read.parquet(f"{self.folder}/lookups")

    def _written(self, keys: DataFrame, run: str, level: int, size: int) -> Run:
        """A run of distinct keys: one file for each hash range, and the rows of its filter."""
        bits = max(0, (-(-size // self.keys_per_file) - 1).bit_length())
        words = max(1, int(WORDS_PER_KEY * size / (1 << bits)))
        rows = keys.select(self.key, F.xxhash64(self.key).alias("_h"), F.lit(bits).alias("_bits"))
        rows = rows.withColumn("bucket", _bucket(F.col("_h"), F.col("_bits"))).drop("_bits")
        # A hash range lies in one task, so it becomes one file.
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "_h")
        dealt.select(self.key, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/keys/run={run}")
        marks = rows.select("bucket", *_filter_places(F.lit(words).cast("long"))).groupBy("bucket", F.col("_word").alias("word")).agg(F.bit_or("_mask").alias("bits"))
        # Every hash range has a filter, also one without keys.
        empty = self.spark.range(1 << bits).select(F.col("id").cast("int").alias("bucket"), F.lit(-1).cast("long").alias("word"), F.lit(0).cast("long").alias("bits"))
        filters = marks.unionByName(empty).repartition("bucket").sortWithinPartitions("bucket", "word")
        filters.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/filters/run={run}")
        return Run(run, level, bits, words, size)
