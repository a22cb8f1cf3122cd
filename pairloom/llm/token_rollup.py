"""Token counts by source, language and tokenizer version, kept up by deltas instead of recounting.

A ledger is a folder in shared storage. A batch of signed events becomes one small table of summed deltas under the batch's name;
committing a name again changes nothing, so a retried batch is counted once. Totals are sums of deltas. Folding replaces the
deltas so far by their sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import fresh_path, pinned

KEYS = ("source", "lang", "tokenizer")
SUMS = ("documents", "tokens", "chars")
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long, chars long"
#: Tokenizer versions of the query: pattern of a token.
VERSIONS = {"words-1": "[^\\x20\\x09-\\x0D]+", "marks-2": "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]"}


def counted(docs: DataFrame, version: str) -> DataFrame:
    """(doc_id, text, source, lang, ...) -> (doc_id, source, lang, tokenizer, tokens, chars). Null texts count 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.regexp_count(text, F.lit(VERSIONS[version])).cast("long").alias("tokens"), F.length(text).cast("long").alias("chars"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts that replace others: the old ones leave, the new ones come."""
    return deletes(old).unionByName(inserts(new))


class Ledger:
    """Committed deltas under ``path``. Batches may be committed in any order and by several drivers, one driver a name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        """Spark's success mark is written last: a batch that broke off has none, and its next commit overwrites it."""
        return self._fs().exists(self._path(f"deltas/{batch}/_SUCCESS"))

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Add (source, lang, tokenizer, tokens, chars, sign) events under a name; False if that name is committed already."""
        if self.committed(batch):
            return False
        sign = F.col("sign")
        sums = events.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("documents"), F.sum(sign * F.col("tokens")).cast("long").alias("tokens"), F.sum(sign * F.col("chars")).cast("long").alias("chars"))
        changed = sums.filter((F.col("documents") != 0) | (F.col("tokens") != 0) | (F.col("chars") != 0))
        changed.select(*KEYS, *SUMS).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        return True

    def batches(self) -> list[str]:
        """Names of the committed deltas that are not folded yet."""
        root = self._path("deltas")
        if not self._fs().exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(root)]
        return sorted(n for n in names if self.committed(n))

    def _base(self) -> str | None:
        root = self._path("base")
        if not self._fs().exists(root):
            return None
        done = [n for n in (s.getPath().getName() for s in self._fs().listStatus(root)) if self._fs().exists(self._path(f"base/{n}/_SUCCESS"))]
        return max(done, key=int, default=None)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens, chars); combinations without documents are left out."""
        return self._sums(self._base(), self.batches())

    def _sums(self, base: str | None, names: list[str]) -> DataFrame:
        """Totals of a base and exactly the named deltas; a batch committed meanwhile is not in them."""
        paths = [f"{self.path}/deltas/{b}" for b in names if not self._folded(b, base)] + ([f"{self.path}/base/{base}/sums"] if base else [])
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]).filter(F.col("documents") != 0)

    def _folded(self, batch: str, base: str | None) -> bool:
        return base is not None and self._fs().exists(self._path(f"base/{base}/names/{batch}"))

    def fold(self) -> None:
        """Write the sum of the deltas so far as a new base. Its names and sums count from the moment its success mark stands; a batch
        that is committed meanwhile is in neither and stays a delta."""
        base, names = self._base(), self.batches()
        new = str(int(base or 0) + 1)
        self._sums(base, names).write.mode("overwrite").parquet(f"{self.path}/base/{new}/sums")
        for name in names:
            self._fs().create(self._path(f"base/{new}/names/{name}"), True).close()
        self._fs().create(self._path(f"base/{new}/_SUCCESS"), True).close()


def maintained(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A day of a ledger over ``docs``: all documents come, those with an id divisible by 7 go (that batch arrives twice), the counts
    of those with an id of remainder 1 by 5 are revised by a later tokenizer; totals after a fold and one more replay.

    Null ids come and never go. Null sources and languages are groups of their own. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, path or fresh_path(spark, "rollup"))
    first, second = VERSIONS
    old = pinned(counted(docs, first))
    gone: Column = F.coalesce(F.col("doc_id") % 7 == 0, F.lit(False))
    late: Column = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False)) & ~gone
    ledger.commit("1-load", inserts(old))
    ledger.commit("2-removed", deletes(old.filter(gone)))
    ledger.commit("2-removed", deletes(old.filter(gone)))
    ledger.fold()
    ledger.commit("3-revised", revisions(old.filter(late), counted(docs.filter(late), second)))
    ledger.commit("1-load", inserts(old))
    return ledger.totals()


SQL = """
SELECT source, lang, CASE WHEN late THEN 'marks-2' ELSE 'words-1' END AS tokenizer, count(*) AS documents,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), CASE WHEN late THEN '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]' ELSE '[^\\x20\\x09-\\x0D]+' END))) AS BIGINT) AS tokens,
       CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars
FROM (SELECT *, coalesce(doc_id % 5 = 1, false) AS late FROM documents WHERE coalesce(doc_id % 7 <> 0, true)) d
GROUP BY ALL
"""
