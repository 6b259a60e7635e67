"""Fuzzy line deduplication with DataFrame functions only: normalised lines get a SimHash in blocks, lines that agree in
enough blocks are candidates (pigeonhole), edit similarity verifies them, and of each connected group of lines the first
occurrence stays.

Each block of a SimHash is taken over the words that a hash deals to it: 60 bits, each the majority of these words' hash
bits. A word that is changed, put in or left out touches one block, so lines that differ in fewer words than they have
blocks agree in some block, whatever the bits. Lines of few words have to agree in two of four blocks. Long lines have
more blocks, as the same share of edits touches more words. Blocks of fewer words than LEAST_FEATURES are no keys: they
would bring all lines together that hold a common word.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspan.llm._common import table, written
from mailspan.llm._graph import components, joined

#: Lines of fewer words and fewer characters are left alone. Linked: the edit distance is at most 100 - SIMILARITY hundredths
#: of the longer line.
LEAST_WORDS, LEAST_CHARS, SIMILARITY = 5, 24, 90
#: Classes of lines by their number of features, distinct words: the least number, and how many blocks a SimHash of the class
#: has. In the first class two blocks have to agree. Lines a little over a least number are also found in the class below.
CLASSES, LEAST_FEATURES = ((0, 4), (24, 4), (48, 8), (96, 16)), 3
#: Of the longest lines the features with the smallest hashes, so many, make the SimHash.
FEATURES = 96
#: Edit distances are first summed over aligned pieces of so many characters, which bounds that of a longer line from above
#: in time linear in its length; what this bound does not accept is compared whole. A line of one piece is exact at once.
#: Lines up to LONG characters are compared whole at once.
PIECE, LONG = 512, 2048
#: Anchors: the longest words of a line, as these are rare. A line has as many as can be touched by the edits that are
#: allowed and one more, but of words under ANCHOR_LETTERS letters only as many as make ANCHORS in all.
ANCHORS, ANCHOR_LETTERS = 16, 8
#: Up to so many rows of a few numbers are broadcast, and so many bytes of rows with lists; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
#: Rounds in which the members of a key are compared with one of them, before all pairs that may be left are.
STAR_ROUNDS = 2
#: 15 counters of 4 bits in a long, and the highest bit of each.
_LANE, _HIGH = 0x0111111111111111, 0x0888888888888888


def words_of(line: str) -> str:
    """SQL: the words of a line in lower case, with ASCII white space, marks and controls between them."""
    return rf"array_remove(split(lower({line}), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), '')"


def normalised(line: str) -> str:
    """SQL: the words of a line with one blank between them."""
    return f"array_join({words_of(line)}, ' ')"


def anchors(words: str, norm: str) -> str:
    """SQL: the hashes of the anchors among `words`, the longest first; an order that does not depend on the line."""
    # hashes below their word's length, so that one sort of longs serves
    ranked = f"sort_array(array_distinct(transform({words}, w -> shiftleft(bigint(63 - least(length(w), 63)), 32) | (hash(w) & 4294967295L))))"
    touched = f"length({norm}) * (100 - {SIMILARITY}) div {SIMILARITY} + 1"
    wanted = f"least({touched}, greatest({ANCHORS}, size(filter(r, a -> a < {(64 - ANCHOR_LETTERS) << 32}L))))"
    return f"element_at(transform(array({ranked}), r -> transform(slice(r, 1, cast({wanted} as int)), a -> cast((a & 4294967295L) - 2147483648L as int))), 1)"


def simhash(features: str) -> str:
    """SQL: 60 bits, each 1 if it is in more than half of the hashes `features`. Of more than 15 hashes the counters run over,
    alike for alike hashes."""
    sums = [f"aggregate({features}, 0L, (t, h) -> t + (shiftrightunsigned(h, {j}) & {_LANE}L))" for j in range(4)]
    bits = [f"shiftright(({x} + (7 - least(7, size({features}) div 2)) * {_LANE}L) & {_HIGH}L, {3 - j})" for j, x in enumerate(sums)]
    return " | ".join(bits)


def block_keys(hashes: str) -> str:
    """SQL: the keys of a line with the features `hashes`: of the blocks in its class, and in the one below if it is near."""
    n, each = f"size({hashes})", []
    for c, (least, blocks) in enumerate(CLASSES):
        above = CLASSES[c + 1][0] if c + 1 < len(CLASSES) else None
        used = hashes if above else f"slice(sort_array({hashes}), 1, {FEATURES})"
        sims = f"transform(transform(sequence(0, {blocks - 1}), b -> filter(hs, h -> h & {blocks - 1} = b)), g -> named_struct('s', {simhash('g')}, 'n', size(g)))"
        if c:
            keys = f"transform({sims}, (s, i) -> if(s.n < {LEAST_FEATURES}, null, xxhash64({c}, i, s.s)))"
        else:
            pairs = ", ".join(f"if(s[{i}].n + s[{j}].n < {LEAST_FEATURES}, null, xxhash64({10 * i + j}, s[{i}].s, s[{j}].s))" for i, j in combinations(range(blocks), 2))
            keys = f"transform(array({sims}), s -> array({pairs}))[0]"
        inside = f"{n} >= {least}" + (f" and {n} <= {above * 10 // 9 + 2}" if above else "")
        each.append(f"if({inside}, transform(array({used}), hs -> {keys})[0], cast(array() as array<bigint>))")
    return f"filter(concat({', '.join(each)}), k -> k is not null)"


def hashed_lines(docs: DataFrame, typos: bool = False) -> DataFrame:
    """A row for each line of `docs` (doc_id, th, text) that counts: where it is, its hash (h1, h2), length and keys."""
    # made within an outer explode, so that no filter is inferred or pushed down that would split every line once more
    each = rf"filter(transform(split(text, '\n'), (x, i) -> named_struct('pos', i, 'words', {words_of('x')})), l -> size(l.words) >= {LEAST_WORDS} or length(array_join(l.words, ' ')) >= {LEAST_CHARS})"
    lines = docs.select("doc_id", "th", F.explode_outer(F.expr(each)).alias("l")).filter("l is not null").select("doc_id", "th", "l.pos", "l.words")
    lines = lines.withColumn("norm", F.array_join("words", " "))
    # without blanks between words: pairs of characters
    few = "transform(array(split(norm, '')), cs -> transform(cs, (c, i) -> xxhash64(c, get(cs, i + 1))))[0]"
    lines = lines.withColumn("hs", F.expr(f"array_distinct(if(size(words) >= {LEAST_WORDS}, transform(words, w -> xxhash64(w)), {few}))"))
    keys = F.expr(block_keys("hs"))
    if typos:
        keys = F.concat(keys, F.expr(f"transform({anchors('words', 'norm')}, a -> xxhash64(-1, a))"))
    return lines.select("doc_id", "th", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), F.length("norm").alias("chars"), F.array_distinct(keys).alias("keys"))


def edits(x: str, y: str) -> str:
    """SQL: the edit distance of `x` and `y`, piece by piece; pieces that differ in more than 15 % count in full."""
    pieces = lambda c: f"regexp_extract_all({c}, '(?s).{{1,{PIECE}}}', 0)"
    longer = "greatest(length(coalesce(a, '')), length(coalesce(b, '')))"
    each = f"zip_with({pieces(x)}, {pieces(y)}, (a, b) -> named_struct('n', {longer}, 'd', if(a = b, 0, levenshtein(coalesce(a, ''), coalesce(b, ''), {longer} * 15 div 100))))"
    return f"aggregate({each}, 0, (t, s) -> t + if(s.d >= 0, s.d, s.n))"


def walked(x: str, y: str, limit: str) -> str:
    """SQL: an upper bound of the edit distance of `x` and `y`, over `limit` if it stops early: their words are walked through side
    by side, and one or two words that only one of them has are stepped over."""
    xs, get = f"split({x}, ' ')", lambda k: f"get(ys, t.c + {k})"
    state = lambda c, d: f"named_struct('c', t.c + {c}, 'd', t.d + {d}, 'l', t.l)"
    whole = lambda w: f"length({w}) + 1"  # noqa: E731  with its blank
    change = f"levenshtein(s.w, {get(0)}, t.l - t.d)"
    step = f"""case when t.d > t.l then t
        when s.w = {get(0)} then {state(1, 0)}
        when {get(0)} is null then {state(0, whole("s.w"))}
        when s.w = {get(1)} then {state(2, whole(get(0)))}
        when s.v = {get(0)} then {state(0, whole("s.w"))}
        when s.w = {get(2)} then {state(3, f"{whole(get(0))} + {whole(get(1))}")}
        when s.u = {get(0)} then {state(0, whole("s.w"))}
        else {state(1, f"if({change} < 0, t.l + 1, {change})")} end"""
    rest = "t.d + if(t.c < size(ys), length(array_join(slice(ys, t.c + 1, size(ys)), ' ')) + 1, 0)"
    ahead = "transform(xs, (w, i) -> named_struct('w', w, 'v', get(xs, i + 1), 'u', get(xs, i + 2)))"
    start = f"named_struct('c', 0, 'd', 0, 'l', cast({limit} as int))"
    # each list is made once, as the variable of a lambda
    one = f"transform(array(split({y}, ' ')), ys -> aggregate({ahead}, {start}, (t, s) -> {step}, t -> {rest}))[0]"
    return f"transform(array({xs}), xs -> {one})[0]"


def similar(x: str, y: str) -> str:
    """SQL: whether the edit distance of `x` and `y` is within the limit.

    Quick answers first, each a bound of the distance: a walk through the words of both; for long lines an edit takes away no
    more than three of a line's sequences of three characters, and lines differ in no more than their pieces do. What they
    leave open is compared whole; of shorter lines that costs no more than these two bounds would.
    """
    limit = f"((100 - {SIMILARITY}) * greatest(length({x}), length({y})) div 100)"
    long = f"greatest(length({x}), length({y})) > {LONG}"
    grams = lambda c: f"array_distinct(regexp_extract_all({c}, r'(?s)(?=(...))', 1))"
    other = f"{long} and size(array_except({grams(x)}, {grams(y)})) > 3 * {limit}"
    pieces = f"{long} and {edits(x, y)} <= {limit}"
    return f"case when {walked(x, y, limit)} <= {limit} then true when {other} then false when {pieces} then true else levenshtein({x}, {y}, cast({limit} as int)) >= 0 end"


def _few(rows: DataFrame, lists: str | None = None) -> DataFrame:
    """For a join: broadcast if it has been measured to be small, else hashed, as the other side is the large one."""
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(lists) * 16 if lists else F.lit(0)), F.lit(0)).alias("b")).first()
    return F.broadcast(rows) if size.n <= BROADCAST_ROWS and 32 * size.n * bool(lists) + size.b <= BROADCAST_BYTES else rows.hint("shuffle_hash")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, norm of the lines `wanted` (id, doc_id, th, pos)."""
    per_doc = wanted.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct("id", "pos")).alias("at"))
    per_doc = written(per_doc, "wanted")
    same = docs["doc_id"].eqNullSafe(per_doc["d"]) & (docs["th"] == per_doc["t"])
    found = docs.join(_few(per_doc, "at"), same)
    found = found.withColumn("lines", F.split("text", "\n"))
    return found.select(F.explode_outer(F.expr(f"transform(at, x -> named_struct('id', x.id, 'norm', {normalised('lines[x.pos]')}))")).alias("x")).select("x.id", "x.norm").dropDuplicates(["id"])


def _verified(docs: DataFrame, lines: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs (src, dst) of `near` whose lines are similar enough."""
    near = written(near.distinct(), "near")
    ids = near.select(F.col("src").alias("id")).union(near.select("dst")).distinct()
    place = F.struct("doc_id", "th", "pos")
    found = lines.join(_few(ids), lines["h1"] == ids["id"]).groupBy("id").agg(F.min(place).alias("first"))
    texts = written(_texts(docs, found.select("id", "first.doc_id", "first.th", "first.pos")), "texts")
    one, two = texts.select(F.col("id").alias("src"), F.col("norm").alias("x")), texts.select(F.col("id").alias("dst"), F.col("norm").alias("y"))
    pairs = near.join(one, "src").join(two, "dst").select("src", "dst", "x", "y")
    # dealt out anew as work, not bytes, is what counts; written, as a filter would else move below the exchange
    pairs = written(pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "pairs")
    return written(pairs.filter(F.expr(similar("x", "y"))).select("src", "dst"), "links")


def _sizes(a: str, b: str) -> str:
    """SQL: whether lines of these lengths can be similar enough."""
    return f"100 * abs({a} - {b}) <= {100 - SIMILARITY} * greatest({a}, {b})"


def similar_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """node, component for the lines (by h1) that are connected by similarity."""
    keyed = lines.select(F.explode("keys").alias("key"), F.col("h1").alias("id"), "chars")
    heads = written(keyed.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("most")).filter("head < most").select("key", "head"), "heads")
    # a row for each key and line, of the keys that several lines have; from here on only these lines count
    met = written(keyed.join(_few(heads.select("key")), "key").distinct(), "met")
    labels = None
    # first the members of a key with one of them, so that a group of near copies costs in proportion to its size
    for turn in range(STAR_ROUNDS + 1):
        if labels is None:
            left = met.withColumn("group", F.col("id"))
        else:
            named = met.join(labels, met["id"] == labels["node"], "left").withColumn("group", F.coalesce("component", "id")).drop("node", "component")
            open_keys = named.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("key")
            left = written(named.join(open_keys, "key", "left_semi"), "left")
        if turn < STAR_ROUNDS:
            # another member each time; never one that was compared with all others before
            order = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
            one = left.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "chars", "group")).alias("h"))
            one = one.select("key", F.col("h.id").alias("a"), F.col("h.chars").alias("ca"), F.col("h.group").alias("ga"))
            pairs = left.join(one, "key").filter(F.expr(f"group <> ga and {_sizes('chars', 'ca')}")).select(F.col("a"), F.col("id").alias("b"))
        else:
            a, b = (left.select("key", *(F.col(c).alias(f"{c}{x}") for c in ("id", "chars", "group"))) for x in "12")
            pairs = a.join(b, (a["key"] == b["key"]) & (F.col("id1") < F.col("id2")) & (F.col("group1") != F.col("group2")) & F.expr(_sizes("chars1", "chars2"))).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
        links = _verified(docs, lines, pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")))
        labels = components(links) if labels is None else joined(labels, links)
    return labels


def removals(docs: DataFrame, typos: bool = False) -> DataFrame:
    """d, t, gone: for the documents (doc_id, th) that lose lines the numbers of these."""
    lines = written(hashed_lines(docs, typos), "lines")
    groups = written(similar_lines(docs, lines), "groups")
    place = F.struct("doc_id", "th", "pos")
    kinds = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    kinds = kinds.join(groups, kinds["h1"] == groups["node"], "left")
    alone = kinds.filter("component is null and n > 1").select("h1", "h2", F.col("first").alias("keeper"))
    linked = kinds.filter("component is not null").select("h1", "h2", "component", "first")
    keeper = linked.groupBy("component").agg(F.min("first").alias("keeper"))
    doubled = written(alone.unionByName(linked.join(keeper, "component").select("h1", "h2", "keeper")), "doubled")
    again = lines.select("doc_id", "th", "pos", "h1", "h2").join(_few(doubled), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("keeper")))
    return written(again.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set("pos").alias("gone")), "gone")


def dedup_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", typos: bool = False) -> DataFrame:
    """`df` with repeated lines taken out of the text, plus n_removed (how many).

    Lines are alike if they are equal when normalised, or agree in blocks of their SimHashes and have similar texts; with
    `typos`, also if they share an anchor and have similar texts. The occurrence with the smallest (id, text hash, line
    number) of a group stays; null ids come first. Lines of fewer than LEAST_WORDS words and LEAST_CHARS characters, null and
    empty texts stay as they are; a text may lose all its lines and is then empty. Rows of equal id and text are one document
    and keep or lose the same lines. Long lines are compared whole; in scripts without blanks, pairs of characters stand for
    words. Columns other than the text stay; one named n_removed is replaced.
    """
    carried = [c for c in df.columns if c not in (text_column, "n_removed")]
    docs = df.select(df[id_column].alias("doc_id"), F.coalesce(F.xxhash64(df[text_column]), F.lit(0)).alias("th"), df[text_column].cast("string").alias("text"))
    gone = removals(docs, typos)
    wide = df.select(F.struct(*carried).alias("_own"), df[id_column].alias("_id"), F.coalesce(F.xxhash64(df[text_column]), F.lit(0)).alias("_th"), df[text_column].cast("string").alias("_text"))
    out = wide.join(_few(gone, "gone"), F.col("_id").eqNullSafe(F.col("d")) & (F.col("_th") == F.col("t")), "left")
    text = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.expr("array_join(filter(split(_text, '\n'), (x, i) -> not array_contains(gone, i)), '\n')"))
    return out.withColumn("_new", text).select(*[F.col("_new").alias(c) if c == text_column else F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(c) if c == "n_removed" else F.col("_own")[c].alias(c) for c in [*[c for c in df.columns if c != "n_removed"], "n_removed"]])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
