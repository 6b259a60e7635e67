"""Search by a persisted inverted index: posting lists of trigrams, in hash buckets.

Pages are put together in blocks, of as many as a task meets one after another. A trigram has one list for each block: the numbers
of the pages in the block that have it. So a list costs two bytes for each page, and what is shuffled and sorted are lists. A table beside
them tells which page a number is.

A page's text is folded (A-Z) and padded, so that each of its places begins a trigram. A needle's literal stretches between wild
characters tell trigrams that every matching page has; the rarest of them are looked up in their buckets alone, their lists are
intersected, and what remains is verified against the pages, of which also only the buckets of candidates are read. A
stretch of one or two characters is the beginning of some trigram. Needles without any literal character read all pages.

New pages are appended to the lists. Postings of pages that were changed or deleted do no harm, as the verification reads the pages
themselves; `build` makes the lists anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspan.functions.text import folded, like_column
from mailspan.sources.buckets import BucketTable
from mailspan.sources.folders import dealt, written

#: Lists that are intersected for a needle: further ones would cost more reading than they save verification.
RAREST = 3
PAD = "\0\0"
#: A block ends at so many pages, or at so many entries of its lists.
BLOCK_PAGES, BLOCK_ENTRIES = 4096, 1 << 19
_POSTING, _COUNT, _PLACE = "gram string, block long, n int, slots array<smallint>", "gram string, n long", "block long, slot smallint, documentId string, pageNumber int"


def fold(needle: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in needle)


def glob(needle: str) -> str:
    """A pattern that finds what LIKE finds between two %. Each stretch is taken where it comes first and never looked for again, as no later place
    would leave more to the stretches behind it: a text is read once, where LIKE would try every place with every other."""
    one = lambda x: "".join("." if c == "_" else c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in x)
    return r"(?s)\A" + "".join(f"(?>.*?{one(x)})" for x in needle.split("%") if x)


def demanded(needle: str) -> tuple[list[str], str | None]:
    """Trigrams that every match has; or, if no stretch has three characters, the longest stretch."""
    stretches = [x for x in re.split("[%_]+", fold(needle)) if x]
    grams = sorted({x[i : i + 3] for x in stretches for i in range(len(x) - 2)})
    return grams, None if grams or not stretches else max(stretches, key=len)


def _stretches(column: str, size: int) -> str:
    """SQL: the stretches of `size` characters in a short text, A-Z folded."""
    return f"transform(sequence(1, greatest(1, length({column}) - {size - 1})), i -> substring({folded(column)}, i, {size}))"


def _lister(longer: tuple[int, ...]) -> Callable:
    """For mapInArrow on documentId, pageNumber, ocrText: the lists of each block, and a row without a trigram for each of its pages."""
    most_pages, most_entries, pad = BLOCK_PAGES, BLOCK_ENTRIES, PAD

    def lists(batches):  # a closure, which Spark sends to workers that do not have this package
        from itertools import accumulate, chain, repeat
        from uuid import uuid4

        import numpy as np
        import pyarrow as pa

        def block(pages, codes, stretches):
            # trigrams as three numbers of 21 bits, in order with their pages
            code, slot = np.concatenate(codes), np.repeat(np.arange(len(codes), dtype=np.int16), [len(c) for c in codes])
            order = np.argsort(code, kind="stable")
            code, slot = code[order], slot[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            each = code[first]
            said = np.stack([each >> 42, each >> 21 & 0x1FFFFF, each & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
            grams = [*(said[i : i + 3] for i in range(0, len(said), 3)), *stretches, *repeat(None, len(pages))]
            sizes = [*np.diff(first, append=len(code)).tolist(), *map(len, stretches.values()), *repeat(1, len(pages))]
            rest = np.fromiter(chain(*stretches.values(), range(len(pages))), np.int16)
            slots = pa.ListArray.from_arrays(pa.array(list(accumulate(sizes, initial=0)), pa.int32()), pa.array(np.concatenate([slot, rest])))
            none = [None] * (len(grams) - len(pages))
            docs, numbers = pa.array(none + [d for d, _ in pages], pa.string()), pa.array(none + [k for _, k in pages], pa.int32())
            columns = [pa.array(grams, pa.string()), pa.array([uuid4().int >> 65] * len(grams), pa.int64()), pa.array(sizes, pa.int32()), slots, docs, numbers]
            return pa.RecordBatch.from_arrays(columns, ["gram", "block", "n", "slots", "documentId", "pageNumber"])

        pages, codes, stretches, n = [], [], {}, 0
        for batch in batches:
            for doc, page, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())):
                t = text.as_py().lower().decode("utf-8", "replace")  # of bytes, A-Z alone are folded
                x = np.frombuffer((t + pad).encode("utf-32-le"), "<u4").astype(np.int64)
                codes.append(np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]))
                more = {t[i : i + size] for size in longer for i in range(len(t) - size + 1)}
                for g in more:
                    stretches.setdefault(g, []).append(len(pages))
                pages.append((doc.as_py(), page.as_py()))
                n += len(codes[-1]) + len(more)
                if len(pages) == most_pages or n >= most_entries:
                    yield block(pages, codes, stretches)
                    pages, codes, stretches, n = [], [], {}, 0
        if pages:
            yield block(pages, codes, stretches)

    return lists


@dataclass(frozen=True)
class TrigramIndex:
    """Posting lists below `path` for the pages in `pages` (bucketed by documentId): of trigrams, and of stretches of the lengths in `longer`."""

    path: str
    pages: BucketTable
    buckets: int = 64
    longer: tuple[int, ...] = ()

    def _bucket(self, column: str = "gram"):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def build(self, spark: SparkSession) -> TrigramIndex:
        self._write(self.pages.read(spark), "overwrite")
        return self

    def add(self, pages: DataFrame) -> None:
        """Postings of new pages, or of new texts of old ones."""
        self._write(pages, "append")

    def _write(self, pages: DataFrame, mode: str) -> None:
        text = pages.filter("ocrText <> ''").select("documentId", F.col("pageNumber").cast("int").alias("pageNumber"), "ocrText")
        # written once, as the numbers of blocks are drawn by lot
        made = written(text.mapInArrow(_lister(self.longer), f"{_POSTING}, documentId string, pageNumber int"), "lists")
        made.filter("gram is null").select("block", F.expr("slots[0]").alias("slot"), "documentId", "pageNumber").write.mode(mode).parquet(f"{self.path}/places")
        # sorted by trigram, so that its lists are a run of rows, and row groups are skipped by their statistics
        rows = dealt(made.filter("gram is not null").select("gram", "block", "n", "slots").withColumn("bucket", self._bucket()), "bucket").sortWithinPartitions("bucket", "gram", "block")
        rows.write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/postings")
        self._count(pages.sparkSession)

    def _count(self, spark: SparkSession) -> None:
        counts = spark.read.schema(f"{_POSTING}, bucket int").parquet(f"{self.path}/postings").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
        dealt(counts, "bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts")

    def _placed(self, spark: SparkSession, hits: DataFrame) -> DataFrame:
        """documentId, pageNumber in the place of block, slot."""
        rest = [c for c in hits.columns if c not in ("block", "slot")]
        return hits.join(spark.read.schema(_PLACE).parquet(f"{self.path}/places"), ["block", "slot"]).select(*rest, "documentId", "pageNumber")

    def _read(self, spark: SparkSession, what: str, schema: str, grams: Iterable[str] | None = None) -> DataFrame:
        """Rows of some trigrams, from the folders of their buckets."""
        rows = spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{what}")
        if grams is None:
            return rows
        grams = list(grams)
        of = [r.b for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(self._bucket().alias("b")).distinct().collect()] if grams else []
        return rows.filter(F.col("bucket").isin(of) & F.col("gram").isin(grams))

    def lists(self, spark: SparkSession, needles: list[str]) -> tuple[DataFrame, list[str]]:
        """(needle, gram, wanted) of the lists to intersect, where a page has to be in `wanted` of them; and needles that tell nothing. Needles
        with a trigram that no page has are not there."""
        asked = {x: demanded(x) for x in needles}
        exact = {g for grams, _ in asked.values() for g in grams}
        # as many numbers as the needles have trigrams
        n = {r.gram: r.n for r in self._read(spark, "counts", _COUNT, exact).select("gram", "n").collect()} if exact else {}
        rows = []
        for needle, (grams, _) in asked.items():
            if grams and all(g in n for g in grams):
                best = sorted(grams, key=lambda g: (n[g], g))[:RAREST]
                rows += [(needle, g, len(best)) for g in best]
        out = spark.createDataFrame(rows, "needle string, gram string, wanted int")
        short = {needle: s for needle, (_, s) in asked.items() if s is not None}
        if short:  # any trigram that begins with the stretch will do: found in the dictionary
            some = spark.createDataFrame(list(short.items()), "needle string, stretch string")
            words = self._read(spark, "counts", _COUNT).filter("length(gram) = 3")
            begins = words.join(F.broadcast(some), F.col("gram").startswith(F.col("stretch")))  # as many rows as needles
            out = out.unionByName(begins.select("needle", "gram", F.lit(1).alias("wanted")))
        return out, [needle for needle, (grams, s) in asked.items() if not grams and s is None]

    def postings(self, spark: SparkSession, lists: DataFrame) -> DataFrame:
        """The lists of these trigrams; only their buckets are read."""
        grams = [r.gram for r in lists.select("gram").distinct().collect()]  # trigrams of the needles, not of the pages
        return self._read(spark, "postings", _POSTING, grams)

    def search(self, spark: SparkSession, needles: list[str]) -> DataFrame:
        """needle, documentId of documents with a page that contains the needle (% and _ are wild, A-Z fold), each pair once."""
        lists, blind = self.lists(spark, list(dict.fromkeys(needles)))
        lists = written(lists, "lists")
        hits = self.postings(spark, lists).join(F.broadcast(lists), "gram").groupBy("needle", "wanted", "block").agg(F.collect_list("slots").alias("of"))
        # a page of several lists is in all of them, or in any of a short stretch's; both are lists of one block's pages
        both = F.expr("if(wanted = 1, array_distinct(flatten(of)), if(size(of) < wanted, cast(array() as array<smallint>), aggregate(of, of[0], (x, y) -> array_intersect(x, y))))")
        per_page = hits.select("needle", "block", F.explode(both).alias("slot")).groupBy("block", "slot").agg(F.collect_list("needle").alias("asked"))
        found = written(self._placed(spark, per_page), "candidates")
        pages = self.pages.read(spark, None if blind else self.pages.touched(found)).select("documentId", "pageNumber", "ocrText").filter("ocrText is not null")
        # an old text of a page may have told it, too
        found = found.groupBy("documentId", "pageNumber").agg(F.array_distinct(F.flatten(F.collect_list("asked"))).alias("asked"))
        out = pages.join(found, ["documentId", "pageNumber"], "left" if blind else "inner")
        if blind:
            out = out.withColumn("asked", F.concat(F.coalesce("asked", F.expr("cast(array() as array<string>)")), F.array(*map(F.lit, blind))))
        # each text is folded once
        plain = f"contains(t, {folded('n')})"
        wild = {x: glob(fold(x)) for x in needles if "%" in x or "_" in x}
        holds = plain
        if wild:
            out = out.withColumn("globs", F.create_map(*(F.lit(v) for pair in wild.items() for v in pair)))
            holds = f"if(map_contains_key(globs, n), t rlike globs[n], {plain})"
        matched = F.expr(f"transform(array({folded('ocrText')}), t -> filter(asked, n -> {holds}))[0]")
        return out.select(F.explode(matched).alias("needle"), "documentId").distinct()

    def asked(self, needles: DataFrame) -> DataFrame:
        """needle, gram, bucket: the longest stretches of each needle that the index has lists of; null where there are none."""
        whole = "array_max(transform(split(needle, '[%_]'), x -> length(x)))"
        sizes = [f"when {whole} >= {n} then {_stretches('needle', n)}" for n in sorted(self.longer, reverse=True)]
        parts = f"filter(case {' '.join(sizes)} when true then {_stretches('needle', 3)} end, g -> length(g) >= 3 and not g rlike '[%_]')"
        return written(needles.select("needle", F.explode_outer(F.array_distinct(F.expr(parts))).alias("gram")).withColumn("bucket", self._bucket()), "asked")

    def candidates(self, spark: SparkSession, asked: DataFrame) -> DataFrame:
        """needle, documentId, pageNumber of the pages in the shortest list of each needle."""
        of = [r.bucket for r in asked.filter("gram is not null").select("bucket").distinct().collect()]  # at most `buckets` numbers
        inside = lambda what, schema: self._read(spark, what, schema).filter(F.col("bucket").isin(of))
        often = asked.filter("gram is not null").join(inside("counts", _COUNT), ["bucket", "gram"], "left")
        rarest = often.groupBy("needle").agg(F.min_by(F.struct("bucket", "gram"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("needle", "g.*")
        hits = rarest.join(inside("postings", _POSTING), ["bucket", "gram"]).select("needle", "block", F.explode("slots").alias("slot"))
        return written(self._placed(spark, hits), "candidates")

    def containing(self, spark: SparkSession, needles: DataFrame) -> DataFrame:
        """needle, documentId, pageNumber for a table of distinct needles (needle): each is looked up by the rarest of its longest stretches. The
        buckets of all of these are read, and of the pages those of candidates."""
        asked = self.asked(needles)
        found = self.candidates(spark, asked)
        pages = self.pages.read(spark, self.pages.touched(found)).select("documentId", "pageNumber", "ocrText")
        out = pages.join(found, ["documentId", "pageNumber"]).filter(F.expr(like_column("ocrText", "needle")))
        # needles without a trigram of their own meet all pages, as nothing tells them apart
        loose = asked.filter("gram is null").select("needle")
        if not loose.isEmpty():
            out = out.unionByName(self.pages.read(spark).select("documentId", "pageNumber", "ocrText").join(loose, F.expr(like_column("ocrText", "needle"))))
        return out.select("needle", "documentId", "pageNumber").distinct()
