"""Text as columns: white space, lines, tokens, labels.  All but ``fold_texts`` stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what counts as white space, for Java's regular expressions.
WS = r"[\s\x0B\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Fixed value: what ends a line.
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"

CHARS_PER_TOKEN = 4
SNIPPET_CHARS = 240


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at either end; Spark's trim takes spaces only."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def squeeze(c: Column | str) -> Column:
    """Stripped, with every run of white space as one space."""
    return F.trim(F.regexp_replace(_col(c), f"{WS}+", " "))


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """(characters, what each folds to, those that fold to several) by Unicode's full case folding, as Python has it."""
    folded = {c: f for c in map(chr, range(0x80, 0x110000)) if (f := c.casefold()) != c}
    single = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folded.items() if len(f) > 1}


def _bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def casefold(c: Column | str) -> Column:
    """Without case, as ``str.casefold`` does it; texts of ASCII alone take the short way."""
    given, single, several = _foldings()
    given, single = given + "".join(map(chr, range(65, 91))), single + "".join(map(chr, range(97, 123)))
    odd = "[" + "".join(several) + "]"
    pairs = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])

    def longer(wide: Column) -> Column:
        each = F.transform(F.split(wide, ""), lambda x: F.coalesce(F.try_element_at(pairs, x), x))
        return F.when(wide.rlike(odd), F.array_join(each, "")).otherwise(wide)

    def folded(text: Column) -> Column:
        plain = F.octet_length(text) == F.length(text)
        return F.when(plain, F.lower(text)).otherwise(_bound(F.translate(text, given, single), longer))

    return _bound(_col(c), folded)


def fold(c: Column | str) -> Column:
    """Squeezed and without case."""
    return casefold(squeeze(c))


@F.arrow_udf(T.StringType())
def _folded(texts: pa.Array) -> pa.Array:
    # A few at a time: of a whole batch, strings would take several times its size.
    pieces = (texts.slice(at, 64) for at in range(0, len(texts), 64))
    found = [pa.array([None if t is None else t.casefold() for t in piece.to_pylist()], pa.string()) for piece in pieces]
    return pa.concat_arrays(found) if found else texts.cast(pa.string())


def fold_texts(c: Column | str) -> Column:
    """Like ``fold``, for whole texts: in Python, where a long text is folded far faster, and once."""
    return _folded(squeeze(c))


def lines(c: Column | str) -> Column:
    """The lines of a text, without the empty one that a final line end leaves."""
    parts = F.split(_col(c), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def decode_utf8(c: Column | str) -> Column:
    """Bytes as text with bad sequences replaced and line ends as line feeds."""
    return F.regexp_replace(F.make_valid_utf8(_col(c).cast("string")), "\r\n?", "\n")


def estimate_tokens(c: Column | str) -> Column:
    return F.ceil(F.length(_col(c)) / CHARS_PER_TOKEN)


def snippet(c: Column | str, chars: int = SNIPPET_CHARS) -> Column:
    flat = squeeze(c)
    return F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, chars)), F.lit("...")))


def citation(project: Column | str, rel_path: Column | str, heading: Column | str) -> Column:
    """``project / file``, with ``> heading`` where there is one."""
    where = F.concat(_col(project), F.lit(" / "), _col(rel_path))
    return F.when(F.coalesce(_col(heading), F.lit("")) == "", where).otherwise(F.concat(where, F.lit(" > "), _col(heading)))


def human_bytes(c: Column | str) -> Column:
    n = _col(c).cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


def duration(seconds: Column | str) -> Column:
    s = _col(seconds)
    return F.when(s < 60, F.lit("under a minute")).otherwise(F.format_string("~%d min", F.ceil(s / 60)))


def day(c: Column | str) -> Column:
    """The date of an ISO time as it stands, in its own offset; ``unknown`` where there is none."""
    head = F.substring(_col(c), 1, 10)
    return F.coalesce(F.when(F.try_to_date(head, "yyyy-MM-dd").isNotNull(), head), F.lit("unknown"))


def source_line(source: Column | str, date: Column | str, changed: Column | str) -> Column:
    known = F.when(_col(date) == "unknown", F.lit("undated")).otherwise(F.concat_ws(" ", _col(source), _col(date)))
    return F.concat(known, F.when(_col(changed), F.lit(", changed since indexed")).otherwise(F.lit("")))


def neutralise(c: Column | str) -> Column:
    """So that a passage cannot close its own block."""
    return F.replace(_col(c), F.lit("<<<"), F.lit("< <<"))


def glob_regex(pattern: str) -> str:
    """A file-name pattern (``*``, ``?``, ``[seq]``, ``[!seq]``) for rlike, without case."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", r"\\")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]")
            i = close
        else:
            out.append("\\" + c if not c.isalnum() and c.isascii() and c not in " _" else c)
        i += 1
    return "(?is)^" + "".join(out) + "$"


def matches_any(name: Column | str, patterns: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | _col(name).rlike(glob_regex(pattern))
    return found
