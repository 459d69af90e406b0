"""String functions with byte lengths and ASCII character classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r"  # what strip removes by default


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def add(a, b) -> Column:
    return F.concat(_c(a), _c(b))


def multiply(s, n) -> Column:
    return F.repeat(_c(s), F.greatest(_c(n).cast("int"), F.lit(0)))


def mod(fmt: str, *args) -> Column:
    return F.format_string(fmt, *map(_c, args))


def lower(s) -> Column:
    return F.translate(_c(s), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def upper(s) -> Column:
    return F.translate(_c(s), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def swapcase(s) -> Column:
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(_c(s), low + up, up + low)


def capitalize(s) -> Column:
    return F.concat(upper(F.substring(_c(s), 1, 1)), lower(F.substring(_c(s), 2, 2**31 - 1)))


def title(s) -> Column:
    """A letter after anything but a letter is upper case, other letters are lower case."""
    words = F.regexp_extract_all(_c(s), F.lit("[A-Za-z]+|[^A-Za-z]+"), 0)
    return F.array_join(F.transform(words, capitalize), "")


def strip(s, chars: str = BLANKS) -> Column:
    return F.btrim(_c(s), F.lit(chars))


def lstrip(s, chars: str = BLANKS) -> Column:
    return F.ltrim(_c(s), F.lit(chars))


def rstrip(s, chars: str = BLANKS) -> Column:
    return F.rtrim(_c(s), F.lit(chars))


def _padding(s: Column, n: Column, fill: str) -> Column:
    return F.repeat(F.lit(fill), F.greatest(n, F.lit(0)).cast("int"))


def ljust(s, width: int, fill: str = " ") -> Column:
    return F.concat(_c(s), _padding(_c(s), width - F.octet_length(_c(s)), fill))


def rjust(s, width: int, fill: str = " ") -> Column:
    return F.concat(_padding(_c(s), width - F.octet_length(_c(s)), fill), _c(s))


def center(s, width: int, fill: str = " ") -> Column:
    """The odd pad goes to the right."""
    room = F.greatest(width - F.octet_length(_c(s)), F.lit(0))
    left = F.floor(room / 2)
    return F.concat(_padding(_c(s), left, fill), _c(s), _padding(_c(s), room - left, fill))


def zfill(s, width: int) -> Column:
    v = _c(s)
    signed = v.startswith("-") | v.startswith("+")
    body = F.when(signed, F.substring(v, 2, 2**31 - 1)).otherwise(v)
    return F.concat(F.when(signed, F.substring(v, 1, 1)).otherwise(""), _padding(v, width - F.octet_length(v), "0"), body)


def replace(s, old: str, new: str, count: int = -1) -> Column:
    if count < 0:
        return F.replace(_c(s), F.lit(old), F.lit(new))
    parts = F.split(_c(s), _quoted(old), count + 1)
    return F.array_join(parts, new)


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def equal(a, b) -> Column:
    return _c(a) == _c(b)


def not_equal(a, b) -> Column:
    return _c(a) != _c(b)


def less(a, b) -> Column:
    return _c(a) < _c(b)


def less_equal(a, b) -> Column:
    return _c(a) <= _c(b)


def greater(a, b) -> Column:
    return _c(a) > _c(b)


def greater_equal(a, b) -> Column:
    return _c(a) >= _c(b)


def compare(a, b, op: str) -> Column:
    return {"==": equal, "!=": not_equal, "<": less, "<=": less_equal, ">": greater, ">=": greater_equal}[op](a, b)


def str_len(s) -> Column:
    return F.octet_length(_c(s))


def _part(s: Column, start: int, end: int | None) -> Column:
    """The bytes [start, end) as a string; a negative end means to the end."""
    if end is None or end < 0:
        return F.substring(s, start + 1, 2**31 - 1)
    return F.substring(s, start + 1, max(end - start, 0))


def count(s, sub: str, start: int = 0, end: int | None = None) -> Column:
    """Occurrences that don't overlap."""
    part = _part(_c(s), start, end)
    if sub == "":
        return F.length(part) + 1
    return ((F.octet_length(part) - F.octet_length(F.replace(part, F.lit(sub), F.lit("")))) / len(sub.encode())).cast("int")


def startswith(s, prefix: str, start: int = 0, end: int | None = None) -> Column:
    return _part(_c(s), start, end).startswith(prefix)


def endswith(s, suffix: str, start: int = 0, end: int | None = None) -> Column:
    return _part(_c(s), start, end).endswith(suffix)


def _bytes_before(s: Column, place: Column) -> Column:
    """Bytes in front of the 1-based character place."""
    return F.octet_length(F.substring(s, F.lit(1), place - 1))


def find(s, sub: str, start: int = 0, end: int | None = None) -> Column:
    """The byte place of the first occurrence, or -1."""
    part = _part(_c(s), start, end)
    at = F.locate(sub, part)
    return F.when(at == 0, F.lit(-1)).otherwise(_bytes_before(part, at) + start).cast("int")


def rfind(s, sub: str, start: int = 0, end: int | None = None) -> Column:
    part = _part(_c(s), start, end)
    tail = F.substring_index(part, sub, -1)
    hit = F.octet_length(part) - F.octet_length(tail) - len(sub.encode()) + start
    return F.when(F.lit(sub == ""), F.octet_length(part) + start).when(F.instr(part, sub) == 0, F.lit(-1)).otherwise(hit).cast("int")


def index(s, sub: str, start: int = 0, end: int | None = None) -> Column:
    at = find(s, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


def rindex(s, sub: str, start: int = 0, end: int | None = None) -> Column:
    at = rfind(s, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


def isalpha(s) -> Column:
    return F.rlike(_c(s), F.lit("^[A-Za-z]+\\z"))


def isalnum(s) -> Column:
    return F.rlike(_c(s), F.lit("^[A-Za-z0-9]+\\z"))


def isdigit(s) -> Column:
    return F.rlike(_c(s), F.lit("^[0-9]+\\z"))


isdecimal = isnumeric = isdigit


def isspace(s) -> Column:
    return F.rlike(_c(s), F.lit("^[ \\t\\n\\x0B\\f\\r]+\\z"))


def islower(s) -> Column:
    return F.rlike(_c(s), F.lit("[a-z]")) & ~F.rlike(_c(s), F.lit("[A-Z]"))


def isupper(s) -> Column:
    return F.rlike(_c(s), F.lit("[A-Z]")) & ~F.rlike(_c(s), F.lit("[a-z]"))


def istitle(s) -> Column:
    return F.rlike(_c(s), F.lit("[A-Za-z]")) & (_c(s) == title(s))


def join(sep: str, s) -> Column:
    """The separator between the characters of each element."""
    return F.array_join(F.split(_c(s), ""), sep)


def expandtabs(s, size: int = 8) -> Column:
    """Tabs to spaces up to the next stop; columns count from each line's start."""

    def line(text: Column) -> Column:
        step = lambda acc, part: F.when(acc.isNull(), part).otherwise(F.concat(acc, F.repeat(F.lit(" "), (size - F.octet_length(acc) % size).cast("int")), part))
        return F.aggregate(F.split(text, "\t"), F.lit(None).cast("string"), step)

    return F.array_join(F.transform(F.split(_c(s), "\n"), line), "\n")


def partition(s, sep: str) -> Column:
    v = _c(s)
    at = F.locate(sep, v)
    found = F.array(F.substring(v, F.lit(1), at - 1), F.lit(sep), F.substring(v, at + len(sep), F.length(v)))
    return F.when(at == 0, F.array(v, F.lit(""), F.lit(""))).otherwise(found)


def rpartition(s, sep: str) -> Column:
    v = _c(s)
    tail = F.substring_index(v, sep, -1)
    head = F.substring(v, F.lit(1), F.length(v) - F.length(tail) - len(sep))
    return F.when(F.instr(v, sep) == 0, F.array(F.lit(""), F.lit(""), v)).otherwise(F.array(head, F.lit(sep), tail))


def split(s, sep: str | None = None, maxsplit: int = -1) -> Column:
    """Without a separator at runs of white space, none of them kept."""
    limit = maxsplit + 1 if maxsplit >= 0 else -1
    if sep is None:
        return F.filter(F.split(strip(s), "[ \t\n\r]+", limit), lambda x: x != "")
    return F.split(_c(s), _quoted(sep), limit)


def rsplit(s, sep: str | None = None, maxsplit: int = -1) -> Column:
    parts = split(s, sep)
    if maxsplit < 0:
        return parts
    n = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), n - maxsplit), " " if sep is None else sep)
    return F.when(n <= maxsplit + 1, parts).otherwise(F.concat(F.array(head), F.slice(parts, n - maxsplit + 1, F.lit(max(maxsplit, 0)))))


def splitlines(s, keepends: bool = False) -> Column:
    pattern = "(?<=\\n)|(?<=\\r)(?!\\n)" if keepends else "\\r\\n|\\n|\\r"
    return F.filter(F.split(F.regexp_replace(_c(s), "(\\r\\n|\\n|\\r)\\z", "") if not keepends else _c(s), pattern), lambda x: F.lit(not keepends) | (x != ""))


def translate(s, source: str, target: str, delete: str = "") -> Column:
    return F.translate(_c(s), delete + source, "") if not target and not source else F.translate(F.translate(_c(s), delete, "") if delete else _c(s), source, target)


def encode(s, charset: str = "UTF-8") -> Column:
    return F.encode(_c(s), charset)


def decode(b, charset: str = "UTF-8", errors: str = "strict") -> Column:
    """Errors: strict raises; ignore and replace give '' and '?' for the whole element."""
    if errors == "strict":
        return F.decode(_c(b), charset)
    return F.when(F.is_valid_utf8(_c(b).cast("string")), F.decode(_c(b), charset)).otherwise("" if errors == "ignore" else "?")
