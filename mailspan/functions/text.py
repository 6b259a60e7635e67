"""SQL expressions for the text semantics that all operators share, as strings for `expr`.

Patterns use Unicode classes and case folding throughout, which Java's regex has behind a flag.
"""

from __future__ import annotations


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A raw SQL literal of `pattern` with Unicode classes."""
    return f"r'(?{'i' if ignore_case else ''}U){pattern}'"


def whole(column: str, pattern: str, ignore_case: bool = False) -> str:
    """Whether `pattern` matches all of `column`; false for null."""
    return f"coalesce({column} rlike {rx(rf'\A(?:{pattern})\z', ignore_case)}, false)"


def has(column: str, pattern: str, ignore_case: bool = False) -> str:
    return f"coalesce({column} rlike {rx(pattern, ignore_case)}, false)"


def found(column: str, pattern: str, group: int = 1, ignore_case: bool = False) -> str:
    """The group of the first match, null without one."""
    return f"nullif(regexp_extract({column}, {rx(pattern, ignore_case)}, {group}), '')"


def all_found(column: str, pattern: str, group: int = 1, ignore_case: bool = False) -> str:
    return f"regexp_extract_all({column}, {rx(pattern, ignore_case)}, {group})"


def utrim(column: str) -> str:
    """Without Unicode white space at either end."""
    return rf"regexp_replace({column}, r'^[\s\p{{Z}}\x1c-\x1f]+|[\s\p{{Z}}\x1c-\x1f]+$', '')"


def blank(column: str) -> str:
    return f"({utrim(column)} = '')"


def plain_ends(column: str) -> str:
    """Whether the first and the last character are visible ASCII ones, so that there is nothing to trim: far cheaper than the pattern."""
    return f"(left({column}, 1) between '!' and '~' and right({column}, 1) between '!' and '~')"


def trimmed(column: str) -> str:
    """`utrim` of a mere column or variable, without the pattern where the ends show that nothing would change."""
    return f"if({plain_ends(column)}, {column}, {utrim(column)})"


def empty(column: str) -> str:
    """`blank` of a mere column or variable, in the same way."""
    return f"if({plain_ends(column)}, false, {blank(column)})"


def units(column: str) -> str:
    """Length in UTF-16 units; that of ASCII is known without encoding it."""
    return f"if(octet_length({column}) = length({column}), length({column}), cast(octet_length(encode({column}, 'UTF-16BE')) / 2 as int))"


def lines(column: str) -> str:
    return rf"split({column}, r'\r\n|\n|\r')"


def odd_spaces(column: str) -> str:
    """Whether a column has, or may have, white space other than spaces and line feeds. Single characters are looked up in a table; the range has more than white space."""
    return rf"({column} rlike r'[\t\x0B\f\r\x1c\x1d\x1e\x1f\x85\xA0\u1680-\u3000]')"


def trimmed_lines(column: str, odd: str | None = None) -> str:
    """The lines of a mere column, each under `utrim`. Split at one character, which needs no pattern, where no \\r is in it, and trimmed one by one only
    if some line may have a character at an end that could go. odd: a column that has `odd_spaces` of it."""
    each = rf"if(contains({column}, '\r'), {lines(column)}, split({column}, '\n'))"
    ends = rf"left({column}, 1) = ' ' or right({column}, 1) = ' ' or contains({column}, ' \n') or contains({column}, '\n ')"
    return rf"if({odd or odd_spaces(column)} or {ends}, transform({each}, x -> {utrim('x')}), {each})"


def words(column: str, odd: str) -> str:
    """A mere column split at white space; there may be empty ones. Where it has no `odd_spaces`, as a column tells, no pattern is needed."""
    return rf"if({odd}, split({column}, r'(?U)\s+'), split(replace({column}, '\n', ' '), ' '))"


def first(array: str, condition: str, variable: str = "x", kind: str = "string") -> str:
    """The first element that meets the condition, null without one; no condition is computed after it."""
    return f"aggregate({array}, cast(null as {kind}), (_found, {variable}) -> if(_found is not null, _found, if({condition}, {variable}, null)))"


#: Characters that the patterns' case folding takes for ASCII letters, and these letters.
_ALIKE = ("\u0130\u0131\u017f\u212a", "iisk")


def low(column: str, lower: str | None = None) -> str:
    """Each character of a mere column as the patterns' case folding has it. A pattern that ignores case matches a text where the same pattern in lower case,
    which is far cheaper, matches this; places are the same. lower: the column in lower case, where another column has it."""
    odd = " or ".join(f"contains({column}, '{c}')" for c in _ALIKE[0])
    alike = f"translate({column}, '{_ALIKE[0]}', '{_ALIKE[1]}')"
    return f"if({odd}, lower({alike}), {lower})" if lower else f"lower(if({odd}, {alike}, {column}))"


def since(column: str, among: str, *words: str) -> str:
    """The column from the first of the words in `among` on, where each character has its place in the column, too."""
    return f"substring({column}, least({', '.join(f"nullif(locate('{w}', {among}), 0)" for w in words)}, length({among})))"


def ahead(letters: str, pattern: str) -> str:
    """The pattern, tried only where one of the characters with which its matches begin is next."""
    return f"(?=[{letters}])(?:{pattern})"


def tells(column: str, *words: str) -> str:
    """Whether one of the words is in the column."""
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


def begins(column: str, letters: str) -> str:
    """Whether the first character is one of these, at a fraction of a pattern's cost."""
    return f"left({column}, 1) in ({', '.join(repr(c) for c in letters)})"


def last(array: str, condition: str, variable: str = "x") -> str:
    return f"try_element_at(filter({array}, {variable} -> {condition}), -1)"


def folded(column: str) -> str:
    """A-Z in lower case, everything else untouched."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def pieces(column: str, size: int) -> str:
    """All stretches of `size` characters, A-Z folded: a look ahead from each place, so that a text is read once, however long it is."""
    return rf"regexp_extract_all({folded(column)}, r'(?s)(?=(.{{{size}}}))', 1)"


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def like_any_case(column: str, needle: str) -> str:
    """Whether the literal `needle` occurs in `column` under LIKE: % and _ in it are wild, only A-Z fold, nothing escapes.
    Without wild characters it is a plain containment, which the optimiser can push down."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in needle)
    if "%" in needle or "_" in needle:
        return f"coalesce({folded(column)} like {sql_string('%' + low + '%')} escape '\\0', false)"
    return f"coalesce(contains({folded(column)}, {sql_string(low)}), false)"


def like_column(column: str, needle: str) -> str:
    """The same with a needle from a column: % and _ in it are wild, too."""
    return f"({folded(column)} like concat('%', {folded(needle)}, '%') escape '\\0')"
