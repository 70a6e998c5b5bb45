"""Text reduction, token budget and reference functions, all built-in expressions.

Whitespace means Unicode White_Space; lengths are UTF-8 bytes; nulls stay null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glyphs that carry no text, and the bytes that cost extra tokens.
DECORATIVE = "▶→←▼▲•·◆◇◊✓✗✔✘‣⁃◦"
COSTLY = "/:.?#&=%~"
MARKER = "\n…[truncated]"
MARKER_COST = 15


#: Unicode White_Space as a plain class (faster than a property test), and the same without the line feed.
_SPACES = r"\x20\t\r\f\x0B\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: ASCII is ruled out first: the class itself is a chain of tests.
_GLYPHS = rf"(?![\x00-\x7F])[{DECORATIVE}]"
_ANY = f"[\\n{_SPACES}]+"


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_ANY}|{_ANY}$", "")


def compress_text(c: Column) -> Column:
    """Glyphs out, whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, _GLYPHS, ""), _ANY, " "))


def compress_block(c: Column) -> Column:
    """``compress_text`` line by line, as passes over the whole text; runs of blank lines become one."""
    flat = F.regexp_replace(F.regexp_replace(c, _GLYPHS, ""), f"[{_SPACES}]+", " ")
    return trim_space(F.regexp_replace(F.regexp_replace(flat, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def token_cost(c: Column) -> Column:
    """Quarter tokens: a byte counts one, a costly byte three."""
    n = F.octet_length(c)
    return (n + 2 * (n - F.octet_length(F.translate(c, COSTLY, "")))).cast("long")


def token_estimate(c: Column) -> Column:
    return F.floor(token_cost(c) / 4).cast("long")


def truncate_tokens(c: Column, most: Column | int) -> Column:
    """The longest prefix whose cost leaves room for the marker, found by bisection on characters."""
    steps = max(1, (max(4 * most - MARKER_COST, 0) + 1).bit_length()) if isinstance(most, int) else 24
    most = F.lit(most) if isinstance(most, int) else most
    room = F.greatest(4 * most.cast("long") - MARKER_COST, F.lit(0).cast("long"))
    # A character costs one at least, so the cut lies in the first ``room`` characters.
    head = F.substring(c, F.lit(1), room.cast("int"))
    state = F.struct(F.lit(0).alias("lo"), F.length(head).alias("hi"), head.alias("head"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        fits = token_cost(F.substring(s["head"], F.lit(1), mid)) <= room
        return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid - 1).alias("hi"), s["head"].alias("head"))

    cut = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step, lambda s: F.substring(s["head"], F.lit(1), s["lo"]))
    return F.when(token_estimate(c) <= most, c).otherwise(F.concat(cut, F.lit(MARKER)))


def cited(c: Column) -> Column:
    """Ordered distinct numbers that stand in square brackets."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def ref_block(refs: Column) -> Column:
    """``References:`` and a line for each (index, url); empty for none."""
    lines = F.array_join(F.transform(refs, lambda r: F.concat(F.lit("["), r["index"].cast("string"), F.lit("] "), r["url"])), "\n")
    return F.when(F.size(refs) > 0, trim_space(F.concat(F.lit("References:\n"), lines))).otherwise("")


def assemble(body: Column, block: Column) -> Column:
    return F.when(block == "", body).otherwise(F.concat(body, F.lit("\n\n"), block))


def refs_cited(refs: Column, text: Column) -> Column:
    return F.filter(refs, lambda r: F.array_contains(cited(text), r["index"].cast("bigint")))


def refs_contained(refs: Column, text: Column) -> Column:
    return F.filter(refs, lambda r: text.contains(r["url"]))


def title_dedup(body: Column, title: Column) -> Column:
    """Drop a first line that equals the title after ``compress_text``, and the line breaks after it."""
    first = F.regexp_extract(body, r"^[^\n]*", 0)
    rest = F.regexp_replace(F.substring(body, F.length(first) + 1, F.length(body)), r"^\n+", "")
    return F.when((title != "") & (compress_text(first) == compress_text(title)), rest).otherwise(body)
