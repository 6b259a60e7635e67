"""Phrase collocations: frequent phrases of words that occur together more often than their parts suggest.

Identical pieces of text become one piece with a multiplicity. Their n-grams are counted level by level: an n-gram can only be
frequent if both (n-1)-grams in it are, so that a bitmap of the frequent ones' hashes, of a fixed size, leaves out what
cannot be (a collision lets a rare n-gram through to the count, which is exact). Tasks count before the shuffle, then each hash bucket
is counted by duckdb, which writes to disk what exceeds its memory. The parts of a candidate are found by requests that are shuffled to
where the parts' counts lie.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspan.llm._common import arrow_batches, table, written

#: Occurrences of a candidate, its most words, how many phrases of a language are told, and the score's unit.
LEAST, LONGEST, TOP, UNIT = 100, 5, 2000, 1000
#: A candidate goes if a longer one has at least so many hundredths of its occurrences.
COVERED = 100
#: Slots of the bitmap that is broadcast (8 MiB), those of one aggregated part of it, and memory of one bucket's count.
SLOT_BITS, PART_BITS, BUCKET_MEMORY = 26, 15, "256MB"
BATCH_PIECES = 10_000
#: Multipliers of the hash.
STEP, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("c", pa.int64())])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(df: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, piece (its words with one blank between them), m (how often it occurs). Null texts are empty, null languages `und`."""
    text = F.translate(F.coalesce(df[text_column].cast("string"), F.lit("")), _UPPER, _LOWER)
    split = df.select(F.coalesce(df[lang_column].cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\n-\r]")).alias("p"))
    return split.select("lang", F.expr(r"trim(regexp_replace(p, r'[ \t]+', ' '))").alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def counted(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[pa.RecordBatch]:
    """Sums of c by (lang, gram), those of at least `least`. Memory is bounded: the rest is on the task's own disk, and only while it runs."""
    import duckdb

    with tempfile.TemporaryDirectory(prefix="counts-") as at, duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": at, "preserve_insertion_order": False}) as con:
        rows = pa.RecordBatchReader.from_batches(_COUNTS, batches)  # noqa: F841  (read by name)
        yield from con.sql("SELECT lang, gram, sum(c)::BIGINT AS c FROM rows GROUP BY ALL HAVING sum(c) >= ?", params=[least]).to_arrow_reader(50_000)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _first(langs: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mixed(langs * np.uint64(STEP) + words)


def _next(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mixed(grams * np.uint64(STEP) + words)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def grams(batches: Iterator[pa.RecordBatch], n: int, frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, gram, c) for the n-grams of pieces (lang, piece, m) in which both (n-1)-grams have their bit in `frequent`."""
    for b in batches:
        if not b.num_rows:
            continue
        split = pc.split_pattern(b.column(1), " ")
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, lang = split.flatten().dictionary_encode(), b.column(0).dictionary_encode()
        code, vocabulary = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
        of = np.repeat(np.arange(b.num_rows), lengths)
        lang_code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of]
        m = b.column(2).to_numpy(zero_copy_only=False)[of]
        if n == 1:
            both, place = np.unique(lang_code * len(vocabulary) + code, return_inverse=True)
            sums = np.zeros(len(both), np.int64)
            np.add.at(sums, place, m)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(both // len(vocabulary))), vocabulary.take(pa.array(both % len(vocabulary))), pa.array(sums)], schema=_COUNTS)
            continue
        left = np.cumsum(lengths)[of] - np.arange(len(of))  # words from here to the piece's end
        words = _word_hashes(vocabulary.to_pylist())[code]
        h = _first(_word_hashes(lang.dictionary.to_pylist())[lang_code], words)
        for k in range(1, n - 1):  # hashes of the (k+1)-grams that begin here; those that leave the piece are never looked at
            h = _next(h[:-1], words[k:])
        slot = _slots(h)
        known = (frequent[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
        at = np.flatnonzero(known[:-1] & known[1:] & (left[: len(known) - 1] >= n))
        if len(at):
            joined = pc.binary_join_element_wise(*(vocabulary.take(pa.array(code[at + j])) for j in range(n)), " ")
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(lang_code[at])), joined, pa.array(m[at])], schema=_COUNTS)


def _with_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = _word_hashes(b.column(0).to_pylist())
        split = [g.split(" ") for g in b.column(1).to_pylist()]
        if split:
            h = _first(langs, _word_hashes([g[0] for g in split]))
            for j in range(1, len(split[0])):  # all grams of a level have as many words
                h = _next(h, _word_hashes([g[j] for g in split]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_slots(h))], names=["lang", "gram", "c", "slot"])


def _bitmap(level: DataFrame) -> np.ndarray:
    """Bits of the level's slots: at most 2^(SLOT_BITS - PART_BITS) rows of 4 KiB reach the driver, whatever the input."""
    part = F.shiftright("slot", PART_BITS)
    rows = level.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << PART_BITS) - 1)).alias("bits")).collect()
    out = np.zeros((1 << SLOT_BITS) >> 3, np.uint8)
    for r in rows:
        start = (r.part << PART_BITS) >> 3
        out[start : start + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def frequent_phrases(parts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, gram, words, c of all phrases of up to `longest` words that occur at least `least` times in `pieces`."""
    spark = parts.sparkSession
    arrow_batches(spark, BATCH_PIECES)
    levels, bits = [], None
    for n in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(bits) if bits is not None else None

        def here(batches: Iterator[pa.RecordBatch], n: int = n, shared=shared) -> Iterator[pa.RecordBatch]:
            return counted(grams(batches, n, None if shared is None else shared.value))

        def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _with_slots(counted(batches, least))

        told = parts.mapInArrow(here, "lang string, gram string, c long")
        level = written(told.repartition("lang", "gram").mapInArrow(there, "lang string, gram string, c long, slot long"), f"level{n}")
        if shared is not None:
            shared.unpersist()
        levels.append(level.select("lang", "gram", F.lit(n).alias("words"), "c"))
        if n < longest:
            bits = _bitmap(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out


def collocations(df: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the occurrences of the phrase and of the two parts of its worst cut, n those of all words of the language,
    score floor(1000 * a * n / (l * r)), in exact arithmetic. A phrase all of whose occurrences are in a longer candidate is left
    out. Ties: the smaller cut; then by occurrences and by the phrase's bytes. Null texts are empty, null languages are `und`;
    repeated rows count each; whole texts are read, however long; an empty table gives no rows; other columns of `df` are
    ignored, whatever their names.
    """
    parts = written(pieces(df, text_column, lang_column), "pieces")
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    total = parts.groupBy("lang").agg(F.sum(words * F.col("m")).cast("long").alias("n"))
    known = frequent_phrases(parts, least, longest)
    candidates = known.filter("words >= 2")

    # requests for the parts' counts, sent to where these lie
    w = candidates.withColumn("w", F.split("gram", " ")).withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    sides = F.expr("array(struct('l' as side, array_join(slice(w, 1, k), ' ') as part), struct('r' as side, array_join(slice(w, k + 1, words - k), ' ') as part))")
    requests = w.select("lang", "gram", "c", "k", F.inline(sides))
    counts = known.select("lang", F.col("gram").alias("part"), F.col("c").alias("f"))
    answers = requests.join(counts, ["lang", "part"]).groupBy("lang", "gram", "c", "k").agg(F.max(F.expr("if(side = 'l', f, null)")).alias("l"), F.max(F.expr("if(side = 'r', f, null)")).alias("r"))
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    scored = answers.join(total, "lang").withColumn("score", F.expr(f"cast({UNIT} as decimal(4, 0)) * {exact('c')} * cast(n as decimal(15, 0)) div ({exact('l')} * {exact('r')})"))
    worst = scored.groupBy("lang", "gram", "c", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))

    # each candidate tells the phrases inside it how often it occurs
    inside = F.expr("flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), i -> array_join(slice(w, i, s), ' '))))")
    longer = candidates.filter("words >= 3").withColumn("w", F.split("gram", " ")).select("lang", F.explode(inside).alias("gram"), F.col("c").alias("longer"))
    covered = longer.groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    left = worst.join(covered, ["lang", "gram"], "left").filter(f"longer is null or 100 * longer < {COVERED} * c")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = left.select("lang", F.col("gram").alias("phrase"), F.col("c").alias("a"), "x.l", "x.r", "n", "x.score")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLE_SQL = {
    "op11_collocations": f"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, gram, words, count(*) AS c FROM (
    SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i : i + words - 1], ' '))) AS gram FROM p, (SELECT unnest(range(1, {LONGEST + 1})) AS words) WHERE len(w) >= words)
  GROUP BY ALL HAVING count(*) >= {LEAST}),
ca AS (SELECT *, string_split(gram, ' ') AS w FROM f WHERE words >= 2),
cut AS (SELECT ca.lang, ca.gram, ca.c, k, l.c AS l, r.c AS r, ({UNIT}::HUGEINT * ca.c * n) // (l.c::HUGEINT * r.c) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM ca) ca JOIN total USING (lang)
  JOIN f l ON l.lang = ca.lang AND l.gram = array_to_string(w[1 : k], ' ') JOIN f r ON r.lang = ca.lang AND r.gram = array_to_string(w[k + 1 :], ' ')),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS gram, max(c) AS longer FROM (SELECT *, unnest(range(1, words - s + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS s FROM ca)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, c DESC, gram) AS rank, gram AS phrase, c AS a, l, r, n, score::BIGINT AS score
FROM worst JOIN total USING (lang) LEFT JOIN inside USING (lang, gram) WHERE longer IS NULL OR 100 * longer < {COVERED} * c
QUALIFY rank <= {TOP}"""
}
