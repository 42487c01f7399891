"""A persisted archive: fields, page indexes, tags, texts and postings of files, made once and searched while more come.

    archive = Archive(spark, "/shared/archive")
    archive.build(files)                       # files(file_id, content); known ones are skipped
    archive.search("invoice", kind="text")
    archive.compact()                          # many batches become one
    archive.abort()                            # from another thread: ends the builds of this object

Every build writes one batch folder of each table, under a name of its own (the next number and a random part, so builders at
once never meet), and the list of its files last, which is renamed into place: a build that is lost or aborted on the way
leaves nothing that is read, and a search sees whole batches only.  All batches of a table are one scan of one
table, however many there are.

Postings are lists by trigram and block of pages, range-partitioned and sorted by trigram in small row groups: the file format's
statistics let a search read its trigrams' row groups only.  Texts and tags lie by file and page.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, pages, ptoca, search, tags
from ..sources import framing
from ..sources.tables import deleted, listed, moved

TABLES = ("fields", "pages", "tags", "texts", "postings")
_FILES = "file_id string, mark bigint, size bigint, version bigint"
#: Bytes of a row group of the tables that searches read in part.
ROW_GROUP = 1 << 20
#: Up to so many candidate files are named to the scan of texts and tags.
NAMED = 1000


class Archive:
    def __init__(self, spark: SparkSession, folder: str, row_group: int = ROW_GROUP):
        self.spark, self.folder, self.row_group, self.tag = spark, folder.rstrip("/"), row_group, f"archive-{uuid.uuid4().hex}"
        self.aborts = 0

    def _batches(self) -> list[str]:
        """The names of the batches that are whole, in order: one listing."""
        return sorted(n.partition("=")[2] for n in listed(self.spark, f"{self.folder}/files") if n.startswith("batch="))

    def _read(self, name: str, batches: list[str]) -> DataFrame:
        """A table of these batches, with batch, as one scan."""
        read = self.spark.read.option("basePath", f"{self.folder}/{name}")
        return (read.schema(f"{_FILES}, batch string") if name == "files" else read).parquet(*[f"{self.folder}/{name}/batch={b}" for b in batches])

    def files(self) -> DataFrame:
        """file_id, mark (of the content), size, version (the build that brought the content) and batch (where its rows lie) of all files."""
        batches = self._batches()
        return self._read("files", batches) if batches else self.spark.createDataFrame([], f"{_FILES}, batch string")

    def _live(self) -> DataFrame:
        """file_id and batch of what counts of each file: its last version."""
        best = F.max_by("batch", F.struct("version", "batch")).alias("batch")
        return self.files().groupBy("file_id").agg(best)

    def table(self, name: str) -> DataFrame:
        """A table of all files; of a file that came again with other content, the last version counts."""
        if name not in TABLES:
            raise ValueError(f"{name} is none of {', '.join(TABLES)}")
        batches = self._batches()
        if not batches:
            raise ValueError("nothing was built")
        return self._read(name, batches).join(self._live(), ["file_id", "batch"], "left_semi").drop("batch")

    def state(self) -> dict:
        """Number of batches, files and pages."""
        batches = self._batches()
        return {"batches": len(batches), "files": self._live().count() if batches else 0, "pages": self.table("pages").count() if batches else 0}

    def reset(self) -> None:
        """Forgets everything; the lists of files go first."""
        for name in ("files", *TABLES, "incoming"):
            deleted(self.spark, f"{self.folder}/{name}")

    def abort(self) -> None:
        """Ends the builds and compactions of this object that run in other threads; they raise and leave no batch."""
        self.aborts += 1
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    # ---- building

    def _next(self) -> tuple[int, str]:
        """The number behind the last batch's, and a name that no other builder has."""
        last = self._batches()[-1:]
        number = int(last[0][1:].partition("-")[0]) + 1 if last else 0
        return number, f"b{number:09d}-{uuid.uuid4().hex}"

    def _put(self, name: str, batch: str, df: DataFrame, order: list[str], merge: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Writes a batch of a table; with an order, range-partitioned, merged (rows equal in the order are together) and sorted in small row groups."""
        path = f"{self.folder}/{name}/batch={batch}"
        if order:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df = merge(df.repartitionByRange(n, *order)).sortWithinPartitions(*order)
        how = {"parquet.block.size": str(self.row_group)} if order else {}
        df.write.mode("overwrite").options(**how).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _published(self, batch: str, make: Callable[[], DataFrame]) -> None:
        """Runs make, which writes the tables and gives the list of files, and publishes the list; on any failure the batch goes."""
        try:
            make().write.mode("overwrite").parquet(f"{self.folder}/files/.passing-{batch}")
            moved(self.spark, f"{self.folder}/files/.passing-{batch}", f"{self.folder}/files/batch={batch}")
        except BaseException:
            for name in TABLES:
                deleted(self.spark, f"{self.folder}/{name}/batch={batch}")
            deleted(self.spark, f"{self.folder}/files/.passing-{batch}")
            raise

    @contextlib.contextmanager
    def _abortable(self):
        """Jobs inside carry the tag that abort() cancels by; what comes behind an abort raises."""
        context, before = self.spark.sparkContext, self.aborts
        context.addJobTag(self.tag)

        def check() -> None:
            if self.aborts != before:
                raise InterruptedError("the build was aborted")

        try:
            yield check
        finally:
            context.removeJobTag(self.tag)

    def build(self, files: DataFrame) -> int:
        """Adds the files that aren't known with this content; how many."""
        with self._abortable() as check:
            return self._build(files, check)

    def _build(self, files: DataFrame, check: Callable[[], None]) -> int:
        marked = files.select("file_id", F.xxhash64("content").alias("mark"), F.length("content").cast("long").alias("size"))
        latest = self.files().groupBy("file_id").agg(F.max_by("mark", F.struct("version", "batch")).alias("__mark"))
        fresh = marked.join(latest, "file_id", "left").where("__mark IS NULL OR __mark <> mark").drop("__mark")
        number, batch = self._next()
        incoming = f"{self.folder}/incoming/{batch}"
        fresh.write.mode("overwrite").parquet(incoming)  # contents are hashed once
        try:
            new = self.spark.read.schema(fresh.schema).parquet(incoming)
            if not (n := new.count()):
                return 0

            def make() -> DataFrame:
                put = lambda name, df, *order: self._put(name, batch, df, list(order))
                sf = put("fields", framing.frames(files.join(new.select("file_id"), "file_id", "left_semi")))  # the files are framed here, and nowhere else
                index = put("pages", pages.page_index(sf))
                placed = asof.tag_pages(tags.tags(sf), index, ["file_id"])
                said = put("tags", search.search_tags(placed.withColumnRenamed("offset", "seq"), ["file_id"], "page_pos"), "file_id", "page_pos")
                texts = put("texts", search.search_pages(ptoca.page_texts(sf, index), ["file_id"], "page_pos", "text"), "file_id", "page_pos")
                posted = search.posting_blocks(texts, ["file_id"], "text_lower", "text").unionByName(search.posting_blocks(said, ["file_id"], "combined_lower", "tag"))
                self._put("postings", batch, posted, ["trigram", "scope", "file_id", "block"], lambda lists: search.merged_blocks(lists, ["file_id"]))
                check()
                return new.withColumn("version", F.lit(number).cast("long"))

            self._published(batch, make)
            return n
        finally:
            deleted(self.spark, incoming)

    def compact(self) -> int:
        """Rewrites what counts of all batches as one and deletes them; how many there were.

        Files keep their versions, so a build at the same time that brings a file again still counts.  A search that
        began before can lose the tables it reads: run it again.
        """
        with self._abortable() as check:
            return self._compact(check)

    def _compact(self, check: Callable[[], None]) -> int:
        before = self._batches()
        if len(before) < 2:
            return len(before)
        _, batch = self._next()
        orders = {"tags": ["file_id", "page_pos"], "texts": ["file_id", "page_pos"], "postings": ["trigram", "scope", "file_id", "block"]}
        live = self._read("files", before).groupBy("file_id").agg(F.max_by(F.struct("mark", "size", "version", "batch"), F.struct("version", "batch")).alias("f")).select("file_id", "f.*")

        def make() -> DataFrame:
            for name in TABLES:
                self._put(name, batch, self._read(name, before).join(live.select("file_id", "batch"), ["file_id", "batch"], "left_semi").drop("batch"), orders.get(name, []))
            check()
            return live.select("file_id", "mark", "size", "version")

        self._published(batch, make)
        for b in before:
            deleted(self.spark, f"{self.folder}/files/batch={b}")
        for b in before:
            for name in TABLES:
                deleted(self.spark, f"{self.folder}/{name}/batch={b}")
        return len(before)

    # ---- reading

    def page_index(self, file_id: str | None = None) -> DataFrame:
        """The stored page index, of one file or all."""
        index = self.table("pages")
        return index if file_id is None else index.where(F.col("file_id") == file_id)

    def search(self, query: str, kind: str = "all", most: int = search.MOST, file_id: str | None = None) -> DataFrame:
        """The first hits over what is built so far.

        Where the postings leave few files, these are named to the scans of texts and tags, which then skip the others' row groups.
        """
        posted, names = self.table("postings"), None if file_id is None else [file_id]
        if names:
            posted = posted.where(F.col("file_id") == file_id)
        elif len(query.strip()) >= 3:
            found = search.block_candidates(posted, ["file_id"], query).select("file_id").distinct().limit(NAMED + 1).collect()
            names = [r.file_id for r in found] if len(found) <= NAMED else None
        of = lambda name: self.table(name) if names is None else self.table(name).where(F.col("file_id").isin(names))
        return search.search(of("texts"), of("tags"), ["file_id"], query, kind, most, posted)

    def build_stream(self, files: DataFrame, checkpoint: str):
        """Builds every new batch of a stream of files; searches between batches see what is there."""

        def put(batch: DataFrame, _: int) -> None:
            self.build(batch)

        return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
