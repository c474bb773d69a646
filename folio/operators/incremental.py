"""Incremental work: fingerprints, checkpoints, library records, expiry, deletes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as t

VERSION = 3


def chapter_shape(chapters: Column) -> Column:
    """Titles and lengths of the paragraphs of chapters, an array of (title, paragraphs)."""
    each = F.transform(chapters, lambda c: F.concat(t.text(c["title"]), F.lit("|"), F.array_join(F.transform(c["paragraphs"], lambda p: F.length(t.text(p)).cast("string")), ",")))
    return F.array_join(each, "||")


def doc_signature(level: str, text: str = "text", title: str = "source", shape: Column | None = None, format: Column | None = None) -> Column:
    """A hash of version, level, source format, title, length, head and tail of the text, and the chapters' shape."""
    c = t.text(F.col(text))
    tail = F.substring(c, F.greatest(F.length(c) - 3_499, F.lit(1)), F.lit(3_500))
    parts = [F.lit(str(VERSION)), F.lit(level), F.lit("") if format is None else t.text(format), t.text(F.col(title)), F.length(c).cast("string"), F.substring(c, 1, 3_500), tail, F.lit("") if shape is None else t.text(shape)]
    return F.sha2(F.concat_ws("::", *parts), 256)


def file_signature(files: DataFrame) -> DataFrame:
    """Files (name, size, last_modified, type, page_count) with a signature that follows each of them."""
    return files.withColumn("signature", F.sha2(F.concat_ws("::", *[t.text(F.col(c).cast("string")) for c in ("name", "size", "last_modified", "type", "page_count")]), 256))


def resume(df: DataFrame, checkpoint: DataFrame, key=("signature", "para")) -> tuple[DataFrame, DataFrame]:
    """What the checkpoint has of these rows, and what is still to be done."""
    latest = upsert_checkpoint(checkpoint, None, key)
    return df.join(latest.drop("saved_at"), list(key)), df.join(latest.select(*key), list(key), "left_anti")


def upsert_checkpoint(old: DataFrame, new: DataFrame | None, key=("signature", "para"), at: str = "saved_at") -> DataFrame:
    """The latest row of each key; of rows saved at once the greatest by its other columns in order of name."""
    both = old if new is None else old.unionByName(new)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at), *[F.desc(c) for c in sorted(both.columns) if c not in (*key, at)]))).where("_n = 1").drop("_n")


def upsert_library(library: DataFrame, records: DataFrame) -> DataFrame:
    """Books by id, the latest update of each; created_at stays that of the first."""
    both = library.unionByName(records).withColumn("created_at", F.min("created_at").over(Window.partitionBy("id")))
    return upsert_checkpoint(both, None, ("id",), "updated_at")


def _combined(place: Column, digest: Column) -> list[Column]:
    """Sums that stand for the digests of children with their places; they add up in any order, so a node of very many children is no single group."""
    both = F.sha2(F.concat_ws(":", place.cast("string"), digest), 256)
    part = lambda at: F.sum(F.conv(F.substring(both, at, 15), 16, 10).cast("decimal(38,0)"))
    return [part(1).alias("_a"), part(16).alias("_b"), F.count("*").alias("children")]


def hash_tree(paragraphs: DataFrame, book: str = "book", chapter: str = "chapter", para: str = "para", text: str = "text") -> DataFrame:
    """level (paragraph, chapter, book), book, chapter, para, digest, children: fingerprints of paragraphs by their text, and of chapters and books by their children's in order."""
    leaf = paragraphs.select(book, chapter, para, F.sha2(t.text(F.col(text)), 256).alias("digest"))
    own = F.sha2(F.concat_ws(":", F.col("_a").cast("string"), F.col("_b").cast("string"), F.col("children").cast("string")), 256).alias("digest")
    chapters = leaf.groupBy(book, chapter).agg(*_combined(F.col(para), F.col("digest"))).select(book, chapter, own, "children")
    books = chapters.groupBy(book).agg(*_combined(F.col(chapter), F.col("digest"))).select(book, own, "children")
    level = lambda name: F.lit(name).alias("level")
    out = leaf.select(level("paragraph"), "*", F.lit(0).cast("long").alias("children"))
    for name, rows in (("chapter", chapters), ("book", books)):
        out = out.unionByName(rows.select(level(name), "*"), allowMissingColumns=True)
    return out


def tree_changes(new: DataFrame, old: DataFrame, book: str = "book", chapter: str = "chapter") -> dict[str, DataFrame]:
    """Of two hash trees what is new, level by level: books with another digest, in these the chapters whose digest the book hadn't, and in these the paragraphs whose digest it hadn't.

    Moved chapters and paragraphs aren't new. Below an unchanged node nothing is compared.
    """

    def fresh(rows: DataFrame, name: str) -> DataFrame:
        had = old.where(F.col("level") == name).select(F.col(book).alias("_of"), F.col("digest").alias("_had")).distinct()
        return rows.join(had, F.col(book).eqNullSafe(F.col("_of")) & (F.col("digest") == F.col("_had")), "left_anti")

    def inside(name: str, above: DataFrame, keys: list[str]) -> DataFrame:
        some = above.select(*[F.col(k).alias(f"_{k}") for k in keys])
        return new.where(F.col("level") == name).join(some, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")

    books = fresh(new.where("level = 'book'"), "book")
    chapters = fresh(inside("chapter", books, [book]), "chapter")
    return {"book": books, "chapter": chapters, "paragraph": fresh(inside("paragraph", chapters, [book, chapter]), "paragraph")}


class Library:
    """A library as a Parquet table in folders by a hash of the key: an upsert reads and rewrites the folders of its own rows only.

    `buckets` belongs to the table and must stay the same. Rows are merged by `merge` (old, new), as upsert_checkpoint does by default: the
    latest by `at` of each key. Writing the same rows again changes nothing, so an upsert that failed before its commit is simply done again; the
    commit itself replaces one folder after the other, and a driver lost between the removal of a folder and its renewal loses that folder.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", at: str = "updated_at", buckets: int = 256, merge=None):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self.merge = merge or (lambda old, new: upsert_checkpoint(old, new, (key,), at))

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _exists(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _stored(self) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return self.spark.read.schema(empty.schema).parquet(self.path) if self._exists() else empty

    def rows(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _touched(self, placed: DataFrame) -> list[int]:
        """At most `buckets` numbers."""
        return [r.bucket for r in placed.select("bucket").distinct().collect()]

    def pending(self, signed: DataFrame) -> DataFrame:
        """Rows (key, signature, ...) that the library doesn't hold with this signature; folders of other keys aren't read."""
        placed = self._placed(signed)
        held = self._stored().where(F.col("bucket").isin(self._touched(placed))).select(self.key, "signature", "bucket")
        return placed.join(held, ["bucket", self.key, "signature"], "left_anti").drop("bucket")

    def upsert(self, records: DataFrame) -> None:
        """Merges records with the library's columns in, by rewriting the folders of their keys; nothing is written for no records."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        # computed once: read for its folders, then written
        placed = self._placed(records.select(*names)).persist(StorageLevel.DISK_ONLY)
        try:
            touched = self._touched(placed)
            if not touched:
                return
            old = self._stored().where(F.col("bucket").isin(touched)).drop("bucket")
            merged = self._placed(self.merge(old, placed.drop("bucket"))).repartition("bucket")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        finally:
            placed.unpersist()


def list_library(library: DataFrame) -> DataFrame:
    """All books without their payload, newest first."""
    return library.drop("source_data", "study_book").orderBy(F.desc("updated_at"), "id")


def get_book(library: DataFrame, book_id: str) -> DataFrame:
    return library.where(F.col("id") == book_id)


def delete_books(table: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")


def cascade_delete(ids: DataFrame, library: DataFrame, checkpoints: DataFrame, ocr: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Library, checkpoints and OCR rows without the books of these ids, joined by signature."""
    gone = library.join(ids.distinct(), "id", "left_semi").select("signature").distinct()
    return delete_books(library, ids), checkpoints.join(gone, "signature", "left_anti"), ocr.join(gone, "signature", "left_anti")
