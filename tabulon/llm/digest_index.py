"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a table of one row per distinct text, bucketed and sorted by digest. New rows
are reduced to one per digest, anti-joined with the index by sort-merge (the index side
needs neither shuffle nor sort), and what is new is appended. Texts never take part in a
join; only digests and numbers do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.groups import attach_groups
from tabulon.session import materialise

#: Digests that a bucket should hold, so that it sorts within one task; an index is made for
#: ROOM times the digests of its first batch, with at least LEAST_BUCKETS.
BUCKET_ROWS = 2_000_000
ROOM = 4
LEAST_BUCKETS = 32
#: The most buckets that Spark allows a table unless told otherwise.
MOST_BUCKETS = 100_000
BLANKS = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, points): SHA-256 of the normalised text and the code points of the original."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("points"),
    )


def buckets_for(digests: int) -> int:
    """Buckets of an index whose first batch has this many digests."""
    return min(max(-(-digests * ROOM // BUCKET_ROWS), LEAST_BUCKETS), MOST_BUCKETS)


class DigestIndex:
    """A bucketed table (digest, keep_id, points); one row per distinct text seen so far.

    The number of buckets is given or follows from the first batch (``buckets_for``); it is kept
    in the table's properties, so that later sessions append to the same buckets.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table, self.asked = spark, table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    @property
    def buckets(self) -> int:
        """The buckets of the table as it was made."""
        row = self.spark.sql(f"SHOW TBLPROPERTIES {self.table} ('digest.buckets')").first()
        return int(row["value"])

    def create(self, id_type: str, digests: int) -> None:
        """An empty index, unless there is one, for a first batch of so many digests."""
        if not self.exists():
            buckets = self.asked or buckets_for(digests)
            self.spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, keep_id {id_type}, points BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
                f"TBLPROPERTIES ('digest.buckets' = '{buckets}')"
            )

    def append(self, rows: DataFrame) -> None:
        """Add (digest, keep_id, points); their digests must be new."""
        buckets = self.buckets
        placed = rows.select("digest", "keep_id", "points").repartition(buckets, "digest")  # a file per bucket
        writer = placed.write.bucketBy(buckets, "digest").sortBy("digest")
        writer.format("parquet").mode("append").saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _best(rows: DataFrame) -> DataFrame:
    """One row per digest: most code points, then the smallest id (null ids last)."""
    order = F.struct(F.col("points"), F.col("doc_id").isNotNull().alias("named"), (-F.col("doc_id")).alias("small"))
    return rows.groupBy("digest").agg(
        F.max_by("doc_id", order).alias("keep_id"), F.max("points").alias("points"), F.count(F.lit(1)).alias("group_size")
    )


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of a new batch; the index grows.

    A row stays if no text of the index equals its own and it is the best of its equals in
    the batch. ``keep_id`` is the id that the index holds for the text, ``group_size`` counts
    the batch. Rows that repeat id and text are all marked kept; ``first_rows`` keeps one.
    Null texts count as empty; an empty batch leaves the index as it is.
    """
    rows = materialise(digest_rows(docs, id_col, text_col))
    best = materialise(_best(rows))
    index.create(best.schema["keep_id"].dataType.simpleString(), best.count())
    held = index.read().select("digest")
    fresh = materialise(best.hint("merge").join(held, "digest", "left_anti"))
    index.append(fresh)
    # The index now holds every digest of the batch; what it says is the result.
    new = fresh.select("digest", F.lit(True).alias("new"))
    groups = materialise(
        best.select("digest", "group_size").hint("merge").join(index.read().select("digest", "keep_id"), "digest")
        .join(new, "digest", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    )
    return attach_groups(rows, groups, ["digest"], "group_size", rows.count()).select(
        "doc_id", "keep_id", "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a batch that stay, with all their columns; of rows equal in id and text, one.

    Only the ids that lose rows are joined; ids with several rows, if any, are settled by
    their digest.
    """
    found = materialise(deduplicate(docs, index, id_col, text_col))
    lost = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("lost_id"))
    several = materialise(
        found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        .select(F.col("doc_id").alias("lost_id"))
    )
    nameless = found.where("doc_id IS NULL").limit(1).count()
    lost = lost.unionByName(several).distinct()
    out = docs.join(lost, docs[id_col] == lost["lost_id"], "left_anti")
    if nameless or several.limit(1).count():
        out = out.where(F.col(id_col).isNotNull()).unionByName(_settled(docs, found, several, id_col, text_col))
    return out.select(*docs.columns)


def _settled(docs: DataFrame, found: DataFrame, several: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per kept (id, text) among rows whose id is null or repeated."""
    odd = docs.join(several, docs[id_col] == several["lost_id"], "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    odd = odd.withColumn("__sha", F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    odd = odd.join(kept, odd[id_col].eqNullSafe(kept["kept_id"]) & (odd["__sha"] == kept["kept_sha"]), "left_semi")
    longest = F.struct(F.char_length(F.coalesce(F.col(text_col), F.lit(""))), *[F.col(f"`{c}`") for c in (text_col,)])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    best = odd.groupBy(F.col(id_col).alias("__id"), "__sha").agg(F.max_by(whole, longest).alias("__row"))
    return best.select("__row.*")
