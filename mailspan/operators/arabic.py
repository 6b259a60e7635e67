"""Rule-based Arabic: token features, part of speech, morphology, stems, case endings and diacritized sentences, all as
Catalyst expressions. Predictions of heads, relations and cases are an input table; what a model would add is theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ── Fixed values ─────────────────────────────────────────────────────────────────────────────────────────────────────
MOST_WORDS, MOST_CHARS, SUBWORDS = 32, 16, 4
BUCKETS, CHARS, DIACS, ROOTS, PATTERNS, PIECES, PROCLITICS, ENCLITICS = 8192, 300, 20, 5000, 200, 8000, 200, 100
PREPOSITIONS = [
    "إلى", "في", "من", "على", "عن", "حتى", "منذ", "خلال", "بين", "عبر",
]
CONJUNCTIONS = [
    "و", "أو", "ثم", "ف", "لكن", "بل", "أم",
]
TAGGED_PARTICLES = [
    "لا", "لم", "لن", "ما", "هل", "أ", "قد", "إن", "أن", "سوف",
]
PRONOUNS = [
    "هو", "هي", "هم", "هن", "أنا", "نحن", "أنت", "أنتم", "الذي", "التي", "الذين", "هذا", "هذه", "ذلك", "تلك",
]
PARTICLES = [
    "إن", "أن", "لا", "لم", "لن", "ما", "هل", "قد", "سوف", "إذا", "لو", "كي", "حتى", "يا",
]
COMMON_VERBS = [
    "كان", "قال", "كتب", "ذهب", "جعل", "علم", "وجد", "أخذ", "ترك", "بدأ", "رأى", "جاء", "أصبح", "ظل", "بات", "صار", "ليس", "مازال", "وضع", "أعلن",
    "أكد", "طلب", "حقق", "أضاف", "أشار", "عاد", "دعا", "قرر", "أوضح", "اعتبر", "قدم", "حصل", "نفى", "أجرى", "وصل", "خرج", "دخل", "فتح", "أكل", "شرب",
    "درس", "فهم", "قرأ", "سمع", "رجع", "نزل", "ركب", "سأل", "أراد", "حمل", "وقع",
]
PREFIXES = [
    "وال", "فال", "بال", "كال", "لل", "وب", "ول", "وي", "فب", "فل", "في", "ال", "لي", "لن", "لا", "ست", "سي", "سن", "سأ", "سـ", "و", "ف", "ب", "ل",
    "ك", "ي", "ت", "ن", "أ", "س",
]
SUFFIXES = [
    "كما", "هما", "كم", "هم", "هن", "نا", "ها", "ون", "ين", "ان", "ات", "وا", "تم", "تن", "ية", "ته", "تك", "ك", "ه", "ي", "ا", "ة", "ت", "ن",
]
NOT_CONSONANTS = "\u064e\u064f\u0650\u0651\u0652\u064b\u064c\u064d\u0670اوىيءئؤإأآ"
CASES = {1: "Nom", 2: "Acc", 3: "Gen", 4: "Jus"}
RELATIONS = [
    "_", "root", "nsubj", "obj", "iobj", "obl", "advmod", "amod", "nmod", "det", "case", "conj", "cc", "punct", "flat", "compound", "appos", "acl",
    "advcl", "cop", "mark", "dep", "parataxis", "fixed", "vocative", "nummod", "flat:foreign", "nsubj:pass", "csubj", "xcomp", "ccomp", "orphan",
]
RELATION_NAMES = [
    "root", "nsubj", "obj", "obl", "amod", "nmod", "cc", "conj", "mark", "advmod",
]
CASE_NAMES = {"Nom": ("مرفوع", "Nominative (مرفوع)"), "Acc": ("منصوب", "Accusative (منصوب)"), "Gen": ("مجرور", "Genitive (مجرور)"), "Jus": ("مجزوم", "Jussive (مجزوم)")}
INDECLINABLE = ("ADP", "CCONJ", "SCONJ", "PART", "DET", "INTJ", "PRON")
FATHATAN, DAMMATAN, KASRATAN, FATHA, DAMMA, KASRA, SHADDA, SUKUN = "\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652"
LETTER, MARK, CASE_MARK = r"\u0621-\u064a\u0671", r"\u064b-\u0655\u0670\u0617-\u061a", r"\u064b-\u0650\u0652"
#: (word, part of speech, stem with its marks); of a word with several the first one is its first.
STEMS = [
    ("ذهب", "VERB", "ذَهَبَ"),
    ("كتب", "VERB", "كَتَبَ"),
    ("كتب", "NOUN", "كُتُب"),
    ("قرأ", "VERB", "قَرَأَ"),
    ("علم", "VERB", "عَلِمَ"),
    ("علم", "NOUN", "عِلْم"),
    ("قال", "VERB", "قَالَ"),
    ("كان", "VERB", "كَانَ"),
    ("كان", "AUX", "كَانَ"),
    ("رجع", "VERB", "رَجَعَ"),
    ("وجد", "VERB", "وَجَدَ"),
    ("أكل", "VERB", "أَكَلَ"),
    ("دخل", "VERB", "دَخَلَ"),
    ("خرج", "VERB", "خَرَجَ"),
    ("فتح", "VERB", "فَتَحَ"),
    ("درس", "VERB", "دَرَسَ"),
    ("درس", "NOUN", "دَرْس"),
    ("فهم", "VERB", "فَهِمَ"),
    ("جلس", "VERB", "جَلَسَ"),
    ("سمع", "VERB", "سَمِعَ"),
    ("نظر", "VERB", "نَظَرَ"),
    ("وصل", "VERB", "وَصَلَ"),
    ("حمل", "VERB", "حَمَلَ"),
    ("وقع", "VERB", "وَقَعَ"),
    ("ركب", "VERB", "رَكِبَ"),
    ("سأل", "VERB", "سَأَلَ"),
    ("شرب", "VERB", "شَرِبَ"),
    ("لعب", "VERB", "لَعِبَ"),
    ("ضرب", "VERB", "ضَرَبَ"),
    ("نزل", "VERB", "نَزَلَ"),
    ("طلب", "VERB", "طَلَبَ"),
    ("جعل", "VERB", "جَعَلَ"),
    ("أخذ", "VERB", "أَخَذَ"),
    ("ترك", "VERB", "تَرَكَ"),
    ("بدأ", "VERB", "بَدَأَ"),
    ("رأى", "VERB", "رَأَى"),
    ("جاء", "VERB", "جَاءَ"),
    ("أصبح", "VERB", "أَصْبَحَ"),
    ("صار", "VERB", "صَارَ"),
    ("وضع", "VERB", "وَضَعَ"),
    ("أعلن", "VERB", "أَعْلَنَ"),
    ("أكد", "VERB", "أَكَّدَ"),
    ("حقق", "VERB", "حَقَّقَ"),
    ("أضاف", "VERB", "أَضَافَ"),
    ("أشار", "VERB", "أَشَارَ"),
    ("عاد", "VERB", "عَادَ"),
    ("قرر", "VERB", "قَرَّرَ"),
    ("أوضح", "VERB", "أَوْضَحَ"),
    ("قدم", "VERB", "قَدَّمَ"),
    ("حصل", "VERB", "حَصَلَ"),
    ("أجرى", "VERB", "أَجْرَى"),
    ("أراد", "VERB", "أَرَادَ"),
    ("عرف", "VERB", "عَرَفَ"),
    ("بعث", "VERB", "بَعَثَ"),
    ("حضر", "VERB", "حَضَرَ"),
    ("ظهر", "VERB", "ظَهَرَ"),
    ("نام", "VERB", "نَامَ"),
    ("مشى", "VERB", "مَشَى"),
    ("غسل", "VERB", "غَسَلَ"),
    ("زرع", "VERB", "زَرَعَ"),
    ("صنع", "VERB", "صَنَعَ"),
    ("يذهب", "VERB", "يَذْهَبُ"),
    ("يكتب", "VERB", "يَكْتُبُ"),
    ("يقرأ", "VERB", "يَقْرَأُ"),
    ("يعلم", "VERB", "يَعْلَمُ"),
    ("يقول", "VERB", "يَقُولُ"),
    ("يأكل", "VERB", "يَأْكُلُ"),
    ("يشرب", "VERB", "يَشْرَبُ"),
    ("يلعب", "VERB", "يَلْعَبُ"),
    ("يدرس", "VERB", "يَدْرُسُ"),
    ("يفهم", "VERB", "يَفْهَمُ"),
    ("يجلس", "VERB", "يَجْلِسُ"),
    ("يسمع", "VERB", "يَسْمَعُ"),
    ("ينظر", "VERB", "يَنْظُرُ"),
    ("كتاب", "NOUN", "كِتَاب"),
    ("طالب", "NOUN", "طَالِب"),
    ("معلم", "NOUN", "مُعَلِّم"),
    ("مدرسة", "NOUN", "مَدْرَسَة"),
    ("بيت", "NOUN", "بَيْت"),
    ("ولد", "NOUN", "وَلَد"),
    ("رجل", "NOUN", "رَجُل"),
    ("يوم", "NOUN", "يَوْم"),
    ("ماء", "NOUN", "مَاء"),
    ("سماء", "NOUN", "سَمَاء"),
    ("أرض", "NOUN", "أَرْض"),
    ("نور", "NOUN", "نُور"),
    ("عمل", "NOUN", "عَمَل"),
    ("قلم", "NOUN", "قَلَم"),
    ("باب", "NOUN", "بَاب"),
    ("حديقة", "NOUN", "حَدِيقَة"),
    ("سيارة", "NOUN", "سَيَّارَة"),
    ("جامعة", "NOUN", "جَامِعَة"),
    ("دروس", "NOUN", "دُرُوس"),
    ("بنت", "NOUN", "بِنْت"),
    ("أم", "NOUN", "أُمّ"),
    ("أب", "NOUN", "أَب"),
    ("أخ", "NOUN", "أَخ"),
    ("شمس", "NOUN", "شَمْس"),
    ("قمر", "NOUN", "قَمَر"),
    ("نهر", "NOUN", "نَهْر"),
    ("بحر", "NOUN", "بَحْر"),
    ("جبل", "NOUN", "جَبَل"),
    ("شجرة", "NOUN", "شَجَرَة"),
    ("مدينة", "NOUN", "مَدِينَة"),
    ("قرية", "NOUN", "قَرْيَة"),
    ("شارع", "NOUN", "شَارِع"),
    ("طريق", "NOUN", "طَرِيق"),
    ("وقت", "NOUN", "وَقْت"),
    ("ساعة", "NOUN", "سَاعَة"),
    ("صباح", "NOUN", "صَبَاح"),
    ("مساء", "NOUN", "مَسَاء"),
    ("ليل", "NOUN", "لَيْل"),
    ("طعام", "NOUN", "طَعَام"),
    ("لغة", "NOUN", "لُغَة"),
    ("كلمة", "NOUN", "كَلِمَة"),
    ("جملة", "NOUN", "جُمْلَة"),
    ("حرف", "NOUN", "حَرْف"),
    ("سؤال", "NOUN", "سُؤَال"),
    ("جواب", "NOUN", "جَوَاب"),
    ("الكتاب", "NOUN", "الْكِتَاب"),
    ("الطالب", "NOUN", "الطَّالِب"),
    ("المعلم", "NOUN", "الْمُعَلِّم"),
    ("المدرسة", "NOUN", "الْمَدْرَسَة"),
    ("البيت", "NOUN", "الْبَيْت"),
    ("اليوم", "NOUN", "الْيَوْم"),
    ("السماء", "NOUN", "السَّمَاء"),
    ("العلم", "NOUN", "الْعِلْم"),
    ("الدرس", "NOUN", "الدَّرْس"),
    ("المعلمون", "NOUN", "الْمُعَلِّمُون"),
    ("الدروس", "NOUN", "الدُّرُوس"),
    ("المدارس", "NOUN", "الْمَدَارِس"),
    ("الماء", "NOUN", "الْمَاء"),
    ("الأرض", "NOUN", "الْأَرْض"),
    ("النور", "NOUN", "النُّور"),
    ("الشمس", "NOUN", "الشَّمْس"),
    ("القمر", "NOUN", "الْقَمَر"),
    ("الولد", "NOUN", "الْوَلَد"),
    ("البنت", "NOUN", "الْبِنْت"),
    ("الرجل", "NOUN", "الرَّجُل"),
    ("الباب", "NOUN", "الْبَاب"),
    ("البحر", "NOUN", "الْبَحْر"),
    ("كبير", "ADJ", "كَبِير"),
    ("صغير", "ADJ", "صَغِير"),
    ("جديد", "ADJ", "جَدِيد"),
    ("قديم", "ADJ", "قَدِيم"),
    ("جميل", "ADJ", "جَمِيل"),
    ("طويل", "ADJ", "طَوِيل"),
    ("قصير", "ADJ", "قَصِير"),
    ("سريع", "ADJ", "سَرِيع"),
    ("بطيء", "ADJ", "بَطِيء"),
    ("قوي", "ADJ", "قَوِيّ"),
    ("ضعيف", "ADJ", "ضَعِيف"),
    ("الكبيرة", "ADJ", "الْكَبِيرَة"),
    ("الجديدة", "ADJ", "الْجَدِيدَة"),
    ("الجميلة", "ADJ", "الْجَمِيلَة"),
    ("جديدة", "ADJ", "جَدِيدَة"),
    ("إلى", "ADP", "إِلَى"),
    ("في", "ADP", "فِي"),
    ("من", "ADP", "مِنْ"),
    ("على", "ADP", "عَلَى"),
    ("عن", "ADP", "عَنْ"),
    ("حتى", "ADP", "حَتَّى"),
    ("منذ", "ADP", "مُنْذُ"),
    ("إن", "PART", "إِنَّ"),
    ("أن", "PART", "أَنَّ"),
    ("ما", "PART", "مَا"),
    ("لا", "PART", "لَا"),
    ("قد", "PART", "قَدْ"),
    ("هل", "PART", "هَلْ"),
    ("لم", "PART", "لَمْ"),
    ("لن", "PART", "لَنْ"),
    ("هذا", "DET", "هٰذَا"),
    ("هذه", "DET", "هٰذِهِ"),
    ("ذلك", "DET", "ذٰلِكَ"),
    ("هو", "PRON", "هُوَ"),
    ("هي", "PRON", "هِيَ"),
    ("هم", "PRON", "هُمْ"),
    ("هن", "PRON", "هُنَّ"),
    ("أنا", "PRON", "أَنَا"),
    ("نحن", "PRON", "نَحْنُ"),
    ("أنت", "PRON", "أَنْتَ"),
    ("أجمل", "VERB", "أَجْمَلَ"),
    ("أجمل", "ADJ", "أَجْمَل"),
]
# ─────────────────────────────────────────────────────────────────────────────────────────────────────────────────────


def _in(column: str, words: list[str] | tuple[str, ...]) -> str:
    return f"{column} in ({', '.join(repr(w) for w in words)})"


def _array(words: list[str]) -> str:
    return f"array({', '.join(repr(w) for w in words)})"


def bare(word: str) -> str:
    """SQL: the word without diacritics."""
    return rf"regexp_replace({word}, r'[{MARK}]', '')"


def tokens(sentences: DataFrame, text: str = "text") -> DataFrame:
    """sentence_id, token_idx, word: a root token and then the first 31 words of each sentence; null is empty."""
    words = rf"slice(concat(array('<ROOT>'), filter(split({text}, r'(?U)\s+'), w -> w <> '')), 1, {MOST_WORDS})"
    return sentences.select("sentence_id", F.posexplode(F.expr(f"coalesce({words}, array('<ROOT>'))")).alias("token_idx", "word"))


def word_bucket(word: str = "word", buckets: int = BUCKETS) -> str:
    """SQL: fold of 31 * h + code modulo the buckets, at least 1."""
    return f"greatest(1, aggregate(filter(split({word}, ''), c -> c <> ''), 0, (h, c) -> (h * 31 + ascii(c)) % {buckets}))"


def stable_hash(word: str, bins: int) -> str:
    """SQL: the first 8 bytes of the MD5 as a signed number, without its sign, modulo the bins; 0 for the empty word."""
    return f"if({word} = '', 0, cast(abs(cast(conv(substr(md5({word}), 1, 16), 16, -10) as bigint)) % {bins} as int))"


def guessed_pos(word: str = "word") -> str:
    """SQL: 5 preposition, 6 conjunction, 8 particle, 10 pronoun, else 1."""
    return f"case when {_in(word, PREPOSITIONS)} then 5 when {_in(word, CONJUNCTIONS)} then 6 when {_in(word, TAGGED_PARTICLES)} then 8 when {_in(word, PRONOUNS)} then 10 else 1 end"


def with_root(df: DataFrame, word: str = "word") -> DataFrame:
    """`df` plus root: one prefix and one suffix off (the first listed that leaves two letters), then up to three consonants."""
    w = df.withColumn("_p", F.expr(f"if(length({word}) < 2, '', coalesce(try_element_at(filter({_array(PREFIXES)}, p -> startswith({word}, p) and length({word}) - length(p) >= 2), 1), ''))"))
    w = w.withColumn("_w", F.expr(f"substring({word}, length(_p) + 1)"))
    w = w.withColumn("_s", F.expr(f"if(length({word}) < 2, '', coalesce(try_element_at(filter({_array(SUFFIXES)}, s -> endswith(_w, s) and length(_w) - length(s) >= 2), 1), ''))"))
    w = w.withColumn("_w", F.expr("left(_w, length(_w) - length(_s))")).withColumn("_c", F.translate("_w", NOT_CONSONANTS, ""))
    return w.withColumn("root", F.expr(f"case when length({word}) < 2 then {word} when _c = '' then _w else left(_c, 3) end")).drop("_p", "_w", "_s", "_c")


def features(token: DataFrame) -> DataFrame:
    """`token` plus the ids that a model reads: word, part of speech, root, pattern, clitics, pieces, and padded characters.
    The root token has 0 everywhere and mask 1."""
    w = with_root(token).withColumn("_id", F.expr(f"cast({word_bucket()} as bigint)"))
    codes = f"transform(slice(filter(split(word, ''), c -> c <> ''), 1, {MOST_CHARS}), c -> cast(ascii(c) as bigint))"

    def padded(values: str, n: int) -> str:
        return f"concat({values}, array_repeat(0L, {n} - size({values})))"

    is_root = "token_idx = 0"
    scalar = {"word_id": "_id", "pos_tag": guessed_pos(), "root_id": stable_hash("root", ROOTS), "pattern_id": stable_hash("word", PATTERNS), "proclitic_id": f"_id % {PROCLITICS}", "enclitic_id": f"_id % {ENCLITICS}"}
    w = w.withColumns({k: F.expr(f"if({is_root}, 0L, cast({v} as bigint))") for k, v in scalar.items()})
    w = w.withColumn("_codes", F.expr(f"if({is_root}, cast(array() as array<bigint>), {codes})"))
    return w.withColumns(
        {
            "char_ids": F.expr(padded(f"transform(_codes, c -> greatest(1L, c % {CHARS}))", MOST_CHARS)),
            "diac_ids": F.expr(padded(f"transform(_codes, c -> c % {DIACS})", MOST_CHARS)),
            "bpe_ids": F.expr(f"array_repeat(if({is_root}, 0L, cast({stable_hash('word', PIECES)} as bigint)), {SUBWORDS})"),
            "mask": F.lit(1).cast("long"),
        }
    ).drop("_id", "_codes", "root")


def padded_sentences(featured: DataFrame) -> DataFrame:
    """A sentence a row, its tokens' features in order and padded with zeros to 32 tokens."""
    names = [c for c in featured.columns if c not in ("sentence_id", "token_idx", "word")]
    got = featured.groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("token_idx", "word", *names))).alias("t"))
    width = {"char_ids": MOST_CHARS, "diac_ids": MOST_CHARS, "bpe_ids": SUBWORDS}
    flat = lambda c: F.flatten(F.col(f"t.{c}")) if c in width else F.col(f"t.{c}")
    return got.select("sentence_id", F.col("t.word").alias("words"), *[F.concat(flat(c), F.array_repeat(F.lit(0).cast("long"), (MOST_WORDS - F.size("t")) * width.get(c, 1))).alias(c) for c in names])


def lexicon(spark: SparkSession) -> DataFrame:
    """word, pos, stem, ord: fewer than 200 rows."""
    return spark.createDataFrame([(*row, i) for i, row in enumerate(STEMS)], "word string, pos string, stem string, ord int")


def looked_up(df: DataFrame, stems: DataFrame | None = None, word: str = "bare", pos: str = "pos") -> DataFrame:
    """`df` plus stem: that of the word's part of speech, of the noun for proper nouns and numbers, or its first one."""
    stems = stems if stems is not None else lexicon(df.sparkSession)
    by_word = F.broadcast(stems.groupBy(F.col("word").alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "stem"))).alias("_m"), F.min_by("stem", "ord").alias("_first")))  # fewer than 200 rows
    w = df.join(by_word, df[word] == F.col("_k"), "left")
    return w.withColumn("stem", F.expr(f"coalesce(_m[{pos}], if({pos} in ('PROPN', 'NUM'), _m['NOUN'], null), _first)")).drop("_k", "_m", "_first")


def relation_of(key: str) -> str:
    """SQL: the relation's tag; an unknown key is `dep`."""
    return f"coalesce(try_element_at({_array(RELATIONS)}, cast({key} as int) + 1), 'dep')"


def case_of(key: str) -> str:
    return "case " + " ".join(f"when {key} = {k} then '{v}'" for k, v in CASES.items()) + " end"


def _verb_prefix(word: str) -> str:
    return f"(length({word}) >= 3 and left({word}, 1) in ('ي', 'ت', 'ن', 'أ') and not startswith({word}, 'ال'))"


def inferred_pos(word: str = "bare", relation: str = "relation") -> str:
    """SQL: part of speech, by relation, closed word lists, the shape of verbs, and relation again."""
    verb = f"{word} <> '' and ({_in(word, COMMON_VERBS)} or {_verb_prefix(word)} or (length({word}) = 3 and not startswith({word}, 'ال')))"
    return f"""case {relation} when 'case' then 'ADP' when 'cc' then 'CCONJ' when 'mark' then 'SCONJ' when 'det' then 'DET' when 'punct' then 'PUNCT' when 'nummod' then 'NUM' else
        case when {_in(word, PARTICLES)} then 'PART' when {_in(word, PREPOSITIONS)} then 'ADP' when {_in(word, CONJUNCTIONS)} then 'CCONJ' when {_in(word, PRONOUNS)} then 'PRON'
        when {relation} = 'root' or ({verb}) then 'VERB' when {relation} = 'amod' then 'ADJ' when {relation} = 'advmod' then 'ADV'
        when {relation} in ('xcomp', 'ccomp', 'advcl', 'acl') then 'VERB' else 'NOUN' end end"""


def with_morphology(df: DataFrame) -> DataFrame:
    """`df` (bare, relation, pos) plus definite, gender, number, plural_type, construct, verb_form."""
    return df.withColumns(
        {
            "definite": F.expr("startswith(bare, 'ال') and length(bare) > 2"),
            "gender": F.expr("if(endswith(bare, 'ة') or endswith(bare, 'ات'), 'fem', 'masc')"),
            "number": F.expr("if(endswith(bare, 'ون') or endswith(bare, 'ين') or endswith(bare, 'ات'), 'plur', 'sing')"),
            "plural_type": F.expr("case when endswith(bare, 'ون') or endswith(bare, 'ين') then 'sound_masc' when endswith(bare, 'ات') then 'sound_fem' else '' end"),
            "construct": F.expr("relation in ('nmod', 'flat', 'compound')"),
            "verb_form": F.expr(f"case when pos <> 'VERB' then '' when {_verb_prefix('bare')} then 'pres' else 'past' end"),
        }
    )


def case_mark() -> Column:
    """The case ending's mark from case_name, pos and morphology; null where the word keeps its form."""
    nunation = "not definite and not construct"
    either = lambda a, b: f"if({nunation}, '{a}', '{b}')"
    return F.expr(
        f"""case when case_name is null or {_in('pos', INDECLINABLE)} then null
        when pos in ('VERB', 'AUX') then case when verb_form in ('past', 'imp') then null when case_name = 'Nom' then '{DAMMA}' when case_name = 'Acc' then '{FATHA}' when case_name = 'Jus' then '{SUKUN}' end
        when plural_type = 'sound_masc' then '{FATHA}'
        when plural_type = 'sound_fem' then if(case_name = 'Nom', {either(DAMMATAN, DAMMA)}, {either(KASRATAN, KASRA)})
        when number = 'dual' then '{KASRA}' when endswith(bare, 'ى') then null
        when case_name = 'Nom' then {either(DAMMATAN, DAMMA)} when case_name = 'Acc' then {either(FATHATAN, FATHA)} when case_name = 'Gen' then {either(KASRATAN, KASRA)} when case_name = 'Jus' then '{SUKUN}' end"""
    )


def with_ending(word: str, mark: str) -> str:
    """SQL: the word with the case marks of its last letter replaced; shadda first, then other marks, then the new one.
    Marks with no letter before them go; a word without letters stays as it is."""
    clean = rf"regexp_replace({word}, r'(^|[^{LETTER}{MARK}])[{MARK}]+', '$1')"
    split = rf"r'(?s)^(.*[{LETTER}])([{MARK}]*)([^{LETTER}]*)\z'"
    part = lambda n: f"regexp_extract({clean}, {split}, {n})"
    kept = rf"regexp_replace({part(2)}, r'[{CASE_MARK}]', '')"
    one_shadda = f"if(contains({kept}, '{SHADDA}'), concat('{SHADDA}', regexp_replace({kept}, '^([^{SHADDA}]*){SHADDA}', '$1')), {kept})"
    return rf"if({word} rlike r'[{LETTER}]', concat({part(1)}, {one_shadda}, {mark}, {part(3)}), {word})"


def diacritized(token: DataFrame, predictions: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """Syntax nodes: a row for each token with relation, case, pos, morphology, stem, ending and the word with its marks.

    predictions: sentence_id, token_idx, head, rel, case; where a row or value is missing it is 0.
    """
    w = token.join(predictions.select("sentence_id", "token_idx", "head", "rel", "case"), ["sentence_id", "token_idx"], "left")
    w = w.withColumns({"head": F.coalesce(F.col("head").cast("long"), F.lit(0)), "rel": F.coalesce(F.col("rel").cast("long"), F.lit(0)), "case": F.coalesce(F.col("case").cast("long"), F.lit(0))})
    w = w.withColumns({"bare": F.expr(bare("word")), "relation": F.expr(relation_of("rel")), "case_name": F.expr(case_of("`case`"))})
    w = w.withColumn("pos", F.expr(f"if(token_idx = 0 and word = '<ROOT>', 'X', {inferred_pos()})"))
    w = looked_up(with_morphology(w), stems)
    w = w.withColumns({"stem": F.expr("if(token_idx = 0, '', coalesce(stem, ''))"), "case_diacritic": F.when(F.col("token_idx") > 0, case_mark())})
    w = w.withColumn("base", F.expr("if(trim(stem) = '', bare, stem)"))
    return w.select(
        "sentence_id", "token_idx", F.col("bare").alias("word"), F.expr(f"if(case_diacritic is null, base, {with_ending('base', 'case_diacritic')})").alias("diacritized"), "stem",
        F.coalesce("case_diacritic", F.lit("")).alias("case_diacritic"), "head", "pos", "relation", "case_name", F.col("case").alias("case_key"), F.col("rel").alias("relation_key"), "definite", "number", "gender",
        (F.col("token_idx") == 0).alias("is_root"),
        F.expr(r"case when token_idx = 0 then 'root' when trim(stem) <> '' then 'lexicon' when not bare rlike r'[ء-ي]' then 'passthrough' else 'none' end").alias("source"),
    )


def sentences_of(nodes: DataFrame) -> DataFrame:
    """sentence_id, diacritized: the words but for the root, in order."""
    got = nodes.filter("not is_root").groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("token_idx", "diacritized"))).alias("w"))
    return got.select("sentence_id", F.array_join(F.col("w.diacritized"), " ").alias("diacritized"))


def case_label(case_name: str = "case_name", language: str = "ar") -> Column:
    i, fallback = (0, "مبني") if language == "ar" else (1, "Indeclinable (مبني)")
    cases = " ".join(f"when '{k}' then '{v[i]}'" for k, v in CASE_NAMES.items())
    unknown = "مبني" if language == "ar" else "Unknown"
    return F.expr(f"case when {case_name} is null then '{fallback}' else case {case_name} {cases} else '{unknown}' end end")


def relation_label() -> Column:
    """The relation, or where it is blank a name by its key."""
    return F.expr(f"if(trim(relation) <> '', relation, coalesce(try_element_at({_array(RELATION_NAMES)}, cast(relation_key as int) + 1), concat('dep_', relation_key)))")
