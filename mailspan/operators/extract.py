"""Entities of letters: language, layout zones, contacts, dates, references, amounts, deadlines and the field list, as
staged projections of Catalyst expressions. Each stage is a `select` of its own, so that no array lambda is written out
twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspan.functions.text import ahead, all_found, begins, empty, first, found, has, last, low, odd_spaces, rx, since, tells, trimmed, trimmed_lines, units, utrim, whole, words

# ── Fixed values: word lists and patterns ────────────────────────────────────────────────────────────────────────────
GERMAN = [
    "der", "die", "das", "und", "ist", "von", "mit", "für", "auf", "den", "des", "ein", "eine", "nicht", "sich", "auch", "werden", "haben", "sehr",
    "geehrte", "freundlichen", "grüßen", "bitte", "betreff", "straße", "stadt", "herrn", "frau", "gmbh", "e.v.", "bundesrepublik",
]
ENGLISH = [
    "the", "and", "for", "with", "from", "this", "that", "have", "been", "dear", "sincerely", "regards", "please", "subject", "reference",
]
SUBJECT_LINE = r"(betreff|betrifft|subject|re:)\s*[:.]?\s*.+"
SUBJECT_KEY = r"^(betreff|betrifft|subject|re)\s*[:.]?\s*"
SUBJECT_TEXT = r"(?:betreff|betrifft|subject)\s*[:.]\s*(.+)"
ADDRESS_START = r"(an\s|herrn|frau|firma|z\.\s?hd\.|familie).*"
POSTAL_IN_LINE = r".*\d{5}\s+\w+.*"
POSTAL_GENERIC = r".*\d{4,5}\s+[A-Z].*"
LEGAL_FORM = r"gmbh|e\.\s?v\.|ag|ohg|kg|gbr|ltd|inc|co\."
AUTHORITY = "amt|behörde|finanzamt|stadt|gemeinde|kreis|land|bundes|ministerium|kammer|versicherung|kasse|anstalt"
STREET = r".*(?:straße|str\.|weg|platz|allee|gasse|ring|damm|ufer).*\d+.*"
STREET_POSTAL = r".*\d+[a-z]?\s*,?\s*\d{5}.*"
RECEIVER_STREET = r".*(?:straße|str\.|weg|platz|allee|gasse|ring|damm|ufer|avenue|street|road).*\d+.*"
RECEIVER_LEGAL = r"gmbh|e\.v\.|ag|ohg|firma|co\."
SALUTATION = r"(herrn?|frau|mr\.?|mrs\.?|ms\.?)\s+"
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
LABELLED_DATE = r"(?:datum|date|vom|berlin|münchen|hamburg|köln|frankfurt|stuttgart),?\s*(\d{1,2}\.\s*\d{1,2}\.\s*\d{4})"
LONG_DATE = rf"(\d{{1,2}}\.\s*(?:{MONTHS})\s*\d{{4}})"
SHORT_DATE = r"(\d{1,2}\.\d{1,2}\.\d{4})"
#: (label, pattern), in the order in which they are looked for.
REFERENCES = (
    ("File Reference (Aktenzeichen)", r"(?:aktenzeichen|az\.?)\s*[:.]?\s*([A-Za-z0-9\-/\.\s]{3,30})"),
    ("Business Reference", r"(?:geschäftszeichen|gz\.?)\s*[:.]?\s*([A-Za-z0-9\-/\.\s]{3,30})"),
    ("Our Reference", r"(?:unser zeichen|uns\.?\s*z(?:eichen)?)\s*[:.]?\s*([A-Za-z0-9\-/\.\s]{3,30})"),
    ("Your Reference", r"(?:ihr zeichen)\s*[:.]?\s*([A-Za-z0-9\-/\.\s]{3,30})"),
    ("Customer Number", r"(?:kunden[\-\s]?nr\.?|kundennummer)\s*[:.]?\s*([A-Za-z0-9\-]{3,20})"),
    ("Contract Number", r"(?:vertrags[\-\s]?nr\.?|vertragsnummer)\s*[:.]?\s*([A-Za-z0-9\-]{3,20})"),
    ("Invoice Number", r"(?:rechnungs[\-\s]?nr\.?|rechnungsnummer)\s*[:.]?\s*([A-Za-z0-9\-]{3,20})"),
    ("Tax Number", r"(?:steuer[\-\s]?nr\.?|steuernummer)\s*[:.]?\s*([0-9/\-]{5,20})"),
    ("Tax ID", r"(?:steuer[\-\s]?id|steueridentifikationsnummer)\s*[:.]?\s*(\d{11})"),
    ("Insurance Number", r"(?:versicherungs[\-\s]?nr\.?)\s*[:.]?\s*([A-Za-z0-9\-]{3,20})"),
)
#: Words of which each match of `REFERENCES` begins with one, in turn.
REFERENCE_WORDS = (("az", "aktenzeichen"), ("gz", "geschäftszeichen"), ("uns",), ("ihr zeichen",), ("kunden",), ("vertrags",), ("rechnungs",), ("steuer",), ("steuer",), ("versicherungs",))
IBAN = r"[A-Z]{2}\d{2}[\s]?(?:\d{4}[\s]?){4}\d{0,4}"
NUMBER = r"[\d.]+,\d{2}"
AMOUNT = rf"(?:EUR|€)\s*{NUMBER}|{NUMBER}\s*(?:EUR|€)"
DEADLINES = (
    r"(?:frist|bis zum|spätestens|deadline|bis spätestens)\s*[:.]?\s*(\d{1,2}\.\d{1,2}\.\d{4})",
    rf"(?:frist|bis zum|spätestens)\s*[:.]?\s*(\d{{1,2}}\.\s*(?:{MONTHS})\s*\d{{4}})",
    r"(?:innerhalb von|within|binnen)\s+(\d+)\s+(?:Tagen?|Wochen?|Monaten?|days?|weeks?|months?)",
)
#: Words of which one is in each match of `DEADLINES`, in turn.
DEADLINE_WORDS = (("frist", "bis zum", "bis spätestens", "spätestens", "deadline"), ("frist", "bis zum", "spätestens"), ("innerhalb von", "within", "binnen"))
#: Stretches of which one is in each of `MONTHS`.
MONTH_WORDS = ("uar", "märz", "april", "mai", "jun", "jul", "august", "ber")
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
PHONE_WORDS = (("tel", "fon", "phone", "mobil"), ("fax",))
PHONES = (r"(?:tel\.?|telefon|fon|phone|mobil)\s*[:.]?\s*([+\d\s\-/()]{8,})", r"(?:fax)\s*[:.]?\s*([+\d\s\-/()]{8,})")
#: The first type of which a word occurs in the text (an amount and an IBAN make an invoice, too); else an official letter.
TYPE_WORDS = (
    ("INVOICE", ["rechnung", "invoice"]),
    ("INVOICE", ["mahnung"]),
    ("NOTICE", ["bescheid", "steuerbescheid"]),
    ("NOTICE", ["mitteilung", "benachrichtigung"]),
    ("FORM", ["antrag", "formular", "ausfüllen"]),
    ("CONTRACT", ["vertrag", "contract", "vereinbarung"]),
    ("CONTRACT", ["kündigung"]),
    ("CERTIFICATE", ["zeugnis", "certificate", "bescheinigung"]),
    ("RECEIPT", ["quittung", "receipt"]),
)
DEFAULT_TYPE = "OFFICIAL_LETTER"
MOST_AMOUNTS, MOST_DEADLINES, PREVIEW_LINES, PREVIEW_CHARS = 5, 3, 5, 500
# ─────────────────────────────────────────────────────────────────────────────────────────────────────────────────────

FIELD = "struct<fieldName: string, fieldValue: string, fieldType: string, confidence: float>"


def _words(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def language(text: str = "text", lower: str | None = None, odd: str | None = None) -> Column:
    """`ar`, `en` or `de`. lower: the text in lower case, where a column has it; odd: likewise its `odd_spaces`."""
    split = words(lower, odd) if lower and odd else rf"split({lower or f'lower({text})'}, r'(?U)\s+')"
    told = f"filter({split}, w -> w in {_words(GERMAN + ENGLISH)})"
    # an Arabic letter takes a byte more than others, so that few such bytes tell that there are few such letters
    arabic = f"octet_length({text}) - length({text}) > length({text}) * 0.3D and length({text}) - length(regexp_replace({text}, '[؀-ۿ]', '')) > {units(text)} * 0.3D"
    hits = f"transform(array({told}), t -> named_struct('de', size(filter(t, w -> w in {_words(GERMAN)})), 'en', size(filter(t, w -> w in {_words(ENGLISH)}))))"
    return F.expr(f"case when {arabic} then 'ar' else transform({hits}, h -> case when h.de > h.en and h.de >= 3 then 'de' when h.en > h.de and h.en >= 3 then 'en' else 'de' end)[0] end")


_NONE = "cast(array() as array<string>)"


def _when(condition: str, found_: str) -> str:
    return f"if(not ({condition}), {_NONE}, {found_})"  # null stays null


def emails(text: str = "text") -> Column:
    # no match is longer than a line
    told = rf"array_join(filter(split({text}, '\n'), x -> contains(x, '@')), '\n')"
    return F.expr(_when(f"contains({text}, '@')", f"array_distinct({all_found(told, EMAIL, 0)})"))


def _phones(folded: str) -> str:
    """From the folded text, as no letter is in a number."""
    each = (_when(tells(folded, *w), all_found(folded, ahead("".join(x[0] for x in w), p), 1)) for p, w in zip(PHONES, PHONE_WORDS))
    return f"array_distinct(transform(concat({', '.join(each)}), p -> {trimmed('p')}))"


def phones(text: str = "text", folded: str | None = None) -> Column:
    """folded: `low` of the text, where a column has it; so below."""
    return F.expr(_phones(folded or low(text)))


def ibans(text: str = "text") -> Column:
    return F.expr(rf"array_distinct(filter(transform({all_found(text, IBAN, 0)}, v -> regexp_replace(v, r'(?U)\s', '')), v -> length(v) between 18 and 34))")


def amounts(text: str = "text", folded: str | None = None) -> Column:
    folded = folded or low(text)
    # a match has a comma, and begins in its line or with a currency
    before = f"substring_index({folded}, ',', 1)"
    place = f"least(nullif(locate('eur', {folded}), 0), nullif(locate('€', {folded}), 0), length({before}) - length(substring_index({before}, '\\n', -1)) + 1)"
    # single characters, as those are looked up in a table; the range has € and other scripts' digits
    pattern = ahead(r"e.0123456789\u0660-\x{10FFFF}", AMOUNT.lower())
    each = f"transform({all_found(f'substring({folded}, {place})', pattern, 0)}, v -> concat(regexp_extract(v, {rx(NUMBER)}, 0), ' €'))"
    return F.expr(_when(f"contains({folded}, ',') and {tells(folded, 'eur', '€')}", f"slice(array_distinct({each}), 1, {MOST_AMOUNTS})"))


def deadlines(text: str = "text", folded: str | None = None) -> Column:
    folded = folded or low(text)
    date, long_date, span = DEADLINES
    one, two, three = (tells(folded, *w) for w in DEADLINE_WORDS)
    # only the name of a month has letters, whose case is kept
    got = (
        _when(one, all_found(folded, ahead("fbsd", date.lower()), 1)),
        _when(f"{two} and {tells(folded, *MONTH_WORDS)} and {folded} rlike {rx(ahead('fbs', long_date.lower()))}", all_found(text, long_date, 1, True)),
        _when(three, all_found(folded, ahead("iwb", span.lower()), 1)),
    )
    return F.expr(f"slice(array_distinct(transform(concat({', '.join(got)}), v -> {trimmed('v')})), 1, {MOST_DEADLINES})")


def references(text: str = "text", folded: str | None = None) -> Column:
    """array of (label, value): the first match of each pattern. With `folded`, of a text in valid UTF-8, a text is only read from its first word on."""
    whole_text, folded = folded is None, folded or low(text)

    def value(pattern: str, begin: tuple[str, ...]) -> str:
        rest = text if whole_text else since(text, folded, *begin)
        return f"if({tells(folded, *begin)}, {utrim(f'regexp_extract({rest}, {rx(pattern, True)}, 1)')}, '')"

    each = ", ".join(f"named_struct('label', '{label}', 'value', {value(p, begin)})" for (label, p), begin in zip(REFERENCES, REFERENCE_WORDS))
    return F.expr(f"filter(array({each}), x -> x.value <> '')")


def document_type(text: str = "text", paid: str = "false", lower: str | None = None) -> Column:
    """paid: SQL for whether the letter has an amount and an IBAN."""
    cases = []
    for i, (kind, words) in enumerate(TYPE_WORDS):
        any_word = tells(lower or f"lower({text})", *words)
        cases.append(f"when {any_word}{f' or {paid}' if i == 0 else ''} then '{kind}'")
    return F.expr(f"case {' '.join(cases)} else '{DEFAULT_TYPE}' end")


def zones(df: DataFrame, text: str = "text", odd: str | None = None) -> DataFrame:
    """`df` plus letterhead, address, metadata, subject_line, body and footer: the layout zones of the letter in `text`. odd: a column that has its `odd_spaces`."""
    w = df.withColumn("_l", F.expr(trimmed_lines(text, odd))).withColumn("_n", F.size("_l"))
    w = w.withColumn("_opens", F.expr(f"if(_n < 5, null, {first('sequence(2, least(12, _n - 1))', f"{begins('_l[i]', 'aAhHfFzZ')} and {whole('_l[i]', ADDRESS_START, True)}", 'i', 'int')})"))
    # a line before one with a postal code opens the address as well; only lines before `_opens` matter
    before = first("sequence(2, coalesce(_opens - 1, least(12, _n - 1)))", f"{units('_l[i]')} between 5 and 50 and i + 1 < _n and {whole('try_element_at(_l, i + 2)', POSTAL_IN_LINE)}", "i", "int")
    w = w.withColumns(
        {
            "_subject": F.expr(f"if(_n < 5, -1, cast(array_position(transform(_l, x -> {begins('x', 'bBsS\u017frR')} and {whole('x', SUBJECT_LINE, True)}), true) as int) - 1)"),
            "_start": F.expr(f"case when _n < 5 then -1 when _opens = 2 then 2 else coalesce({before}, _opens, -1) end"),
        }
    )
    end = first("sequence(_start, least(_start + 5, _n - 1))", f"{whole('_l[i]', POSTAL_IN_LINE)} or {whole('_l[i]', POSTAL_GENERIC)}", "i", "int")
    w = w.withColumn("_end", F.expr(f"if(_start < 0, -1, coalesce({end}, least(_start + 3, _n - 1)))"))
    w = w.withColumn("letterhead", F.expr("slice(_l, 1, case when _n < 5 then 2 when _start > 0 then _start else 4 end)"))
    w = w.withColumn("_meta_end", F.expr("if(_subject > 0, _subject, least(_n, greatest(_end + 4, 14)))")).withColumn("_meta", F.expr("greatest(_end + 1, size(letterhead))"))
    none = "cast(array() as array<string>)"
    w = w.withColumns(
        {
            "address": F.expr(f"if(_start < 0, {none}, slice(_l, _start + 1, _end - _start + 1))"),
            "metadata": F.expr(f"if(_n >= 5 and _meta < _meta_end, slice(_l, _meta + 1, least(_meta_end, _n) - _meta), {none})"),
            "subject_line": F.expr("if(_subject >= 0, _l[_subject], null)"),
            "_body": F.expr("if(_subject >= 0, _subject + 1, _meta_end)"),
            "_foot": F.expr("greatest(0, _n - 8)"),
        }
    )
    w = w.withColumns(
        {
            "body": F.expr(f"case when _n < 5 then _l when _body < _foot then slice(_l, _body + 1, _foot - _body) else {none} end"),
            "footer": F.expr(f"if(_n < 5, {none}, slice(_l, _foot + 1, _n - _foot))"),
        }
    )
    return w.drop("_l", "_n", "_opens", "_subject", "_start", "_end", "_meta_end", "_meta", "_body", "_foot")


def contacts(df: DataFrame) -> DataFrame:
    """`df` (with zones) plus sender and receiver: structs of name, organization, street, postalCode, city, phone, email; null without name and organization."""
    numbers = r"[0-9]{3,}"
    w = df.withColumn("_s", F.expr("concat(letterhead, footer)")).withColumn("_joined", F.expr(r"array_join(_s, '\n')")).withColumn("_folded", F.expr(low("_joined")))
    digit = "(left(x, 1) between '0' and '9' or left(x, 1) > '~')"  # or another script's
    w = w.withColumns(
        {
            "_org": F.expr(first("_s", has(low("x"), f"{LEGAL_FORM}|{AUTHORITY}"))),
            "_person": F.expr(first("letterhead", f"{units('x')} between 3 and 50 and not {has('x', numbers)}")),
            "_street": F.expr(first("_s", f"{whole('x', STREET, True)} or {whole('x', STREET_POSTAL)}")),
            "_postal": F.expr(first("_s", f"{digit} and {whole('x', r'\d{5}\s+\w+.*')}")),
            "_email": F.expr(f"if(contains(_joined, '@'), {found(r"array_join(filter(_s, x -> contains(x, '@')), '\n')", EMAIL, 0)}, null)"),
            "_phone": F.expr(f"try_element_at({_phones('_folded')}, 1)"),
        }
    )
    w = w.withColumns(
        {
            "_sname": F.expr("if(_org is not null, null, _person)"),
            "_sorg": F.expr("coalesce(_org, if(_person <=> try_element_at(letterhead, 1), null, try_element_at(letterhead, 1)))"),
            "_kinds": F.expr(
                f"""transform(filter(address, x -> not {empty('x')}), x -> named_struct('x', x, 'k', case
                when {whole('x', r'\d{4,5}\s+.+')} then 'a'
                when {whole('x', RECEIVER_STREET, True)} or {whole('x', r'.*\d+[a-z]?$', True)} then 'b'
                when {whole('x', SALUTATION + '.+', True)} then 'c'
                when {has(low('x'), RECEIVER_LEGAL)} then 'd'
                when {units('x')} between 3 and 50 and not {has('x', r'\d{3,}')} then 'e' end))"""
            ),
        }
    )
    w = w.withColumns({f"_{k}": F.expr(f"{last('_kinds', f"x.k = '{k}'")}.x") for k in "abcd"} | {"_e": F.expr(f"try_element_at(filter(_kinds, x -> x.k = 'e'), 1).x")})
    w = w.withColumns(
        {
            "_rname": F.expr(f"coalesce({utrim(f"regexp_replace(_c, r'(?iU)^{SALUTATION}', '')")}, _e)"),
            "_rzip": F.expr(found("_a", r"(\d{4,5})\s+(.+)")),
            "_rcity": F.expr(utrim(found("_a", r"(\d{4,5})\s+(.+)", 2))),
        }
    )
    none = "cast(null as string)"
    w = w.withColumns(
        {
            "sender": F.expr(
                f"""if(_sname is null and _sorg is null, null, named_struct('name', _sname, 'organization', _sorg, 'street', _street,
                'postalCode', {found('_postal', r'(\d{5})')}, 'city', {utrim(found('_postal', r'\d{5}\s+(.+)'))}, 'phone', _phone, 'email', _email))"""
            ),
            "receiver": F.expr(f"if(_rname is null and _d is null, null, named_struct('name', _rname, 'organization', _d, 'street', _b, 'postalCode', _rzip, 'city', _rcity, 'phone', {none}, 'email', {none}))"),
        }
    )
    return w.drop("_s", "_joined", "_folded", "_org", "_person", "_street", "_postal", "_email", "_phone", "_sname", "_sorg", "_kinds", "_a", "_b", "_c", "_d", "_e", "_rname", "_rzip", "_rcity")


def document_date(text: str = "text") -> Column:
    """From the metadata zone, else from the first 30 % of the text."""
    joined = "array_join(metadata, ' ')"
    top = f"substring({text}, 1, cast({units(text)} * 0.3D as int))"
    return F.expr(f"coalesce(replace({found(joined, LABELLED_DATE, 1, True)}, ' ', ''), {found(joined, LONG_DATE, 1, True)}, {found(top, SHORT_DATE)})")


def subject(text: str = "text", folded: str | None = None) -> Column:
    """From the subject line (then no other place counts), else from anywhere in the text."""
    return F.expr(f"if(subject_line is not null, nullif({utrim(f"regexp_replace(subject_line, r'(?iU){SUBJECT_KEY}', '')")}, ''), if({tells(folded or low(text), 'betreff', 'betrifft', 'subject')}, {utrim(found(text, SUBJECT_TEXT, 1, True))}, null))")


def preview() -> Column:
    """The first lines of the body that say something."""
    return F.expr(rf"left(array_join(slice(filter(body, x -> {units('x')} > 10 and not ({begins('x', '-_=')} and {whole('x', r'^[\-_=]+$')})), 1, {PREVIEW_LINES}), ' '), {PREVIEW_CHARS})")


def address_of(contact: str) -> str:
    """SQL: street, postal code and city of a contact as one line."""
    place = f"concat(coalesce(concat({contact}.postalCode, ' '), ''), coalesce({contact}.city, ''))"
    return f"concat(coalesce({contact}.street, ''), if({contact}.postalCode is null and {contact}.city is null, '', concat(if(coalesce({contact}.street, '') = '', '', ', '), {place})))"


def _field(name: str, value: str, kind: str, confidence: float, when: str | None = None) -> str:
    made = f"named_struct('fieldName', {name}, 'fieldValue', {value}, 'fieldType', '{kind}', 'confidence', cast({confidence} as float))"
    return f"if({when or f'{value} is not null'}, {made}, null)"


def extract(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` plus lang, sender, receiver, date, subject, referenceNumbers, deadline, documentType and fields.

    fields: array of (fieldName, fieldValue, fieldType, confidence) in the order in which they were found. Blank texts
    have no fields, and keep what `language` said, if `df` has that column; null is blank.
    """
    given = "language" if "language" in df.columns else "cast(null as string)"
    # bytes that are no text become marks, as in each pattern, so that places are the same in both cases
    w = df.withColumn("_t", F.expr(f"coalesce(make_valid_utf8({text}), '')"))
    w = w.withColumn("_odd", F.expr(odd_spaces("_t")))
    w = contacts(zones(w, "_t", "_odd")).withColumn("_lower", F.lower("_t")).withColumn("_low", F.expr(low("_t", "_lower")))
    w = w.withColumns({"lang": language("_t", "_lower", "_odd"), "date": document_date("_t"), "subject": subject("_t", "_low"), "_refs": references("_t", "_low"), "_ibans": ibans("_t"), "_amounts": amounts("_t", "_low"), "_due": deadlines("_t", "_low"), "_preview": preview(), "_emails": emails("_t"), "_phones": phones("_t", "_low")})
    fixed = [
        _field("'Sender Name'", "sender.name", "PERSON_NAME", 0.85),
        _field("'Sender Organization'", "sender.organization", "ORGANIZATION", 0.80),
        _field("'Sender Address'", address_of("sender"), "ADDRESS", 0.75, "sender.street is not null"),
        _field("'Sender Phone'", "sender.phone", "PHONE", 0.85),
        _field("'Sender Email'", "sender.email", "EMAIL", 0.95),
        _field("'Receiver Name'", "receiver.name", "PERSON_NAME", 0.80),
        _field("'Receiver Organization'", "receiver.organization", "ORGANIZATION", 0.75),
        _field("'Receiver Address'", address_of("receiver"), "ADDRESS", 0.70, "receiver.street is not null"),
        _field("'Document Date'", "date", "DATE", 0.90),
        _field("'Subject'", "subject", "SUBJECT", 0.90),
    ]

    def many(array: str, name: str, kind: str, confidence: float) -> str:
        return f"transform({array}, v -> named_struct('fieldName', '{name}', 'fieldValue', v, 'fieldType', '{kind}', 'confidence', cast({confidence} as float)))"

    refs = "transform(_refs, r -> named_struct('fieldName', r.label, 'fieldValue', r.value, 'fieldType', 'REFERENCE_NUMBER', 'confidence', cast(0.8 as float)))"
    shown = f"filter(array({_field("'Content Preview'", '_preview', 'TEXT', 0.70, f'not {empty("_preview")}')}), x -> x is not null)"
    w = w.withColumn("_f", F.expr(f"concat(filter(array({', '.join(fixed)}), x -> x is not null), {refs}, {many('_ibans', 'IBAN', 'IBAN', 0.92)}, {many('_amounts', 'Amount', 'OTHER', 0.80)}, {many('_due', 'Deadline', 'DEADLINE', 0.80)}, {shown})"))
    w = w.withColumn("_f", F.expr(f"concat(_f, {many('array_except(_emails, _f.fieldValue)', 'Email', 'EMAIL', 0.95)})"))
    w = w.withColumn("_f", F.expr(f"concat(_f, {many('array_except(_phones, _f.fieldValue)', 'Phone', 'PHONE', 0.85)})"))
    w = w.withColumn("_blank", F.expr(empty("_t")))
    unless = lambda value: F.expr(f"if(_blank, null, {value})")
    w = w.withColumns(
        {
            "documentType": F.when(~F.col("_blank"), document_type("_t", "(size(_amounts) > 0 and size(_ibans) > 0)", "_lower")),
            "lang": F.expr(f"if(_blank, {given}, lang)"),
            "sender": unless("sender"),
            "receiver": unless("receiver"),
            "date": unless("date"),
            "subject": unless("subject"),
            "referenceNumbers": F.expr("if(_blank, cast(array() as array<string>), _refs.value)"),
            "deadline": unless("try_element_at(_due, 1)"),
            "fields": F.expr(f"if(_blank, cast(array() as array<{FIELD}>), _f)"),
        }
    )
    return w.drop("_t", "_odd", "_lower", "_low", "_f", "_refs", "_ibans", "_amounts", "_due", "_preview", "_emails", "_phones", "_blank", "letterhead", "address", "metadata", "subject_line", "body", "footer")


def result(extracted: DataFrame, *keys: str) -> DataFrame:
    """keys and result: all that was found in a letter as one value."""
    return extracted.select(*keys, F.struct("fields", "documentType", F.col("lang").alias("language"), "sender", "receiver", "date", "subject", "referenceNumbers", "deadline").alias("result"))


def fields_long(extracted: DataFrame, *keys: str) -> DataFrame:
    """A row for each field: the keys, seq (from 0), fieldName, fieldValue, fieldType, confidence.

    An outer explode whose null rows are dropped after it: of an inner one the optimizer infers a filter on the array,
    and pushing that through the stages would write the whole extraction out many times over.
    """
    return extracted.select(*keys, F.posexplode_outer("fields").alias("seq", "f")).filter("seq is not null").select(*keys, "seq", "f.*")
