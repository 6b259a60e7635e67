import random

import pytest
from pyspark.sql import functions as F

from mailspan.operators import arabic

GOLDEN = {
    "كتب": (1729, 4490, 78, 1878, 129, 29, 103, 3),
    "الطالب": (6577, 1282, 79, 5079, 177, 77, 75, 15),
    "المدرسة": (2208, 3692, 71, 3871, 8, 8, 75, 15),
    "في": (2089, 3821, 189, 789, 89, 89, 101, 1),
}


def test_features(spark):
    df = spark.createDataFrame([(1, " ".join(GOLDEN)), (2, None)], "sentence_id int, text string")
    rows = arabic.features(arabic.tokens(df)).collect()
    got = {r.word: (r.word_id, r.root_id, r.pattern_id, r.bpe_ids[0], r.proclitic_id, r.enclitic_id, r.char_ids[0], r.diac_ids[0]) for r in rows if r.token_idx}
    assert got == GOLDEN
    assert all(len(r.char_ids) == 16 and len(r.bpe_ids) == 4 for r in rows) and sum(r.token_idx == 0 for r in rows) == 2


def model(word: str, mark: str) -> str:
    """Row by row: letters with their marks, the case marks of the last letter replaced."""
    letter = lambda c: "ء" <= c <= "ي" or c == "ٱ"
    is_mark = lambda c: "ً" <= c <= "ٕ" or c == "ٰ" or "ؗ" <= c <= "ؚ"
    if not any(map(letter, word)):
        return word
    units = []
    for c in word:
        if is_mark(c):
            if units and letter(units[-1][0]):
                units[-1] += c
        else:
            units.append(c)
    at = max(i for i, u in enumerate(units) if letter(u[0]))
    kept = [c for c in units[at][1:] if c not in "ًٌٍَُِْ"]
    if "ّ" in kept:
        kept.remove("ّ")
        kept.insert(0, "ّ")
    units[at] = units[at][0] + "".join(kept) + mark
    return "".join(units)


def test_endings_like_the_model(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("بتكلمىَُِّْٰ x1") for _ in range(rng.randrange(9))) for _ in range(2000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("m", F.lit(arabic.DAMMA))
    rows = df.select("w", F.expr(arabic.with_ending("w", "m")).alias("x")).withColumn("y", F.expr(arabic.with_ending("x", f"'{arabic.DAMMA}'"))).collect()
    assert all(r.x == model(r.w, arabic.DAMMA) and r.y == r.x for r in rows)


def test_sentence(spark):
    df = spark.createDataFrame([(1, "كتب الطالب في المدرسة")], "sentence_id int, text string")
    told = spark.createDataFrame([(1, 1, 0, 1, 0), (1, 2, 1, 2, 1), (1, 3, 4, 10, 0), (1, 4, 1, 5, 3)], "sentence_id int, token_idx int, head long, rel long, case long")
    nodes = arabic.diacritized(arabic.tokens(df), told)
    assert arabic.sentences_of(nodes).first().diacritized == "كَتَبَ الطَّالِبُ فِي الْمَدْرَسَةِ"
    assert nodes.filter("token_idx = 0").first().source == "root"


@pytest.mark.parametrize("word, pos, stem", [("كتب", "NOUN", "كُتُب"), ("كتب", "PROPN", "كُتُب"), ("كتب", "ADJ", "كَتَبَ"), ("xyz", "NOUN", None)])
def test_lexicon(spark, word, pos, stem):
    df = spark.createDataFrame([(word, pos)], "bare string, pos string")
    assert arabic.looked_up(df).first().stem == stem
