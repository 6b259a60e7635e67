"""Scalar functions of the mail application: dates, labels, file names, prompts, and sounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailspan.functions.text import utrim

# Texts of the chat replies and the prompt.
CHAT_INTENTS = (
    ("summarize", ("summarize", "zusammenfass")),
    ("deadline", ("deadline", "frist")),
    ("draft", ("draft", "antwort", "response")),
    ("sender", ("sender", "absender", "who")),
)
PROMPT_HEAD = (
    "You are a helpful assistant specializing in German postal correspondence management.",
    "You help users understand, organize, and respond to official letters and documents.",
)
PROMPT_INSTRUCTIONS = (
    "## Instructions",
    "- Respond in the same language as the document (German or Arabic).",
    "- When asked to draft a reply, use formal German letter format.",
    "- Be concise and helpful.",
    "- If you're unsure about something, say so rather than guessing.",
)
PAGE_BREAK = "\n\n--- Page Break ---\n\n"
PROFILE_LABELS = {"AUTHORITY": "Authority", "PERSON": "Person", "FAMILY_MEMBER": "Family", "USER_SELF": "You"}
LANGUAGE_LABELS = {"de": "🇩🇪 German", "ar": "🇸🇦 Arabic", "en": "🇬🇧 English"}


def formatted_date(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "dd.MM.yyyy")


def relative_time(millis: Column, now: Column) -> Column:
    """What a list shows for a time: minutes, hours or days ago, else the date. The clock is an argument."""
    ago = now - millis
    whole = lambda unit: F.floor(ago / unit).cast("string")
    return (
        F.when(ago < 60_000, F.lit("Just now"))
        .when(ago < 3_600_000, F.concat(whole(60_000), F.lit(" min ago")))
        .when(ago < 86_400_000, F.concat(whole(3_600_000), F.lit("h ago")))
        .when(ago < 604_800_000, F.concat(whole(86_400_000), F.lit("d ago")))
        .otherwise(formatted_date(millis))
    )


def stable_id(*parts: Column) -> Column:
    """An id that a second run makes again."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def enum_label(name: Column) -> Column:
    return F.initcap(F.lower(name))


def initials(name: Column, n: int = 1) -> Column:
    return F.upper(F.left(name, F.lit(n)))


def percent(confidence: Column) -> Column:
    """Whole percent of a float32 confidence, cut off."""
    return (confidence.cast("float") * F.lit(100).cast("float")).cast("int")


def percent_text(mean: Column) -> Column:
    """`93%`, halves up; no value is `NaN%`."""
    return F.format_string("%.0f%%", F.coalesce(mean.cast("double"), F.lit(float("nan"))) * 100)


def profile_subtitle(kind: Column, organization: Column) -> Column:
    label = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PROFILE_LABELS.items()])
    return F.concat_ws(" · ", label, organization)


def language_label(language: Column) -> Column:
    known = F.coalesce(*[F.when(language == k, F.lit(v)) for k, v in LANGUAGE_LABELS.items()])
    return F.coalesce(known, F.concat(F.lit("🌐 "), F.coalesce(language, F.lit("Unknown"))))


def chat_intent(message: Column) -> Column:
    """Which canned reply a message gets: the first intent of which a keyword occurs."""
    low, out = F.lower(message), None
    for name, words in CHAT_INTENTS:
        hit = None
        for w in words:
            hit = low.contains(w) if hit is None else hit | low.contains(w)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("help"))


def pdf_file_name(title: Column) -> Column:
    return F.concat(F.lit("PAM_"), F.left(F.regexp_replace(title, "[^a-zA-Z0-9_-]", "_"), F.lit(50)), F.lit(".pdf"))


def a4_layout(width: Column, height: Column) -> Column:
    """Where an image stands on an A4 page of 595 x 842 points: scale, left, top; null for an unreadable image."""
    w, h = width.cast("double"), height.cast("double")
    scale = F.least(595 / w, 842 / h)
    return F.when((width > 0) & (height > 0), F.struct(scale.alias("scale"), ((595 - w * scale) / 2).alias("left"), ((842 - h * scale) / 2).alias("top")))


def is_arabic(text: Column) -> Column:
    return text.rlike("[؀-ۿݐ-ݿ]")


def speech_tokens(text: Column) -> Column:
    """Token ids of a text: a..z from 43, blank 16, . ! ? , as 4 5 6 3, all else 0."""
    return F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), _codes)


def _codes(c: Column) -> Column:
    marks = {" ": 16, ".": 4, "!": 5, "?": 6, ",": 3}
    out = F.when((c >= "a") & (c <= "z"), F.ascii(c) - 97 + 43)
    for k, v in marks.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(0))


def phonemes(text: Column) -> Column:
    """Code points, 255 at most."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.least(F.ascii(c), F.lit(255)))


def pcm16(samples: Column) -> Column:
    """Little-endian 16-bit PCM of samples from -1 to 1, clipped, cut off towards zero."""

    def one(x: Column) -> Column:
        n = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("int")
        h = F.lpad(F.hex(n.bitwiseAND(F.lit(0xFFFF)).cast("long")), 4, "0")
        return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))

    return F.unhex(F.array_join(F.transform(samples, one), ""))


def blank_to_null(value: str) -> str:
    """SQL: null for blank, else the value as it is."""
    return f"if({utrim(value)} = '', null, {value})"

