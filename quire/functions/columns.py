"""Column expressions: the native twins of the scalar functions. All of them stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec

from .text import CLOSING, LIST_MARKER, NUMBERED_CODE, PAGE_NUMBER, ROMAN, TERMINAL, WIDE

#: Inside of a class: white space as the scalar functions have it, that of Unicode included, which `\s` of the pattern language lacks.
BLANKS = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
BLANK = f"[{BLANKS}]"
CJK_CLASS = "[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]"


def parse_number(text: Column) -> Column:
    """A leading 0 is put in, garbage is 0."""
    whole = F.regexp_replace(F.regexp_replace(text, r"^(-?)\.", "$10."), r"\.$", ".0")
    return F.coalesce(F.when(whole.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), whole).try_cast("double"), F.lit(0.0))


def hex_bytes(digits: Column) -> Column:
    """Bytes of hexadecimal digits, an odd last one followed by 0."""
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def utf16_text(data: Column) -> Column:
    """A36, C4."""
    return F.decode(data, "UTF-16BE")


def normal_paragraph(text: Column) -> Column:
    """K9: white space squeezed and stripped."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def normal_header(text: Column) -> Column:
    """H12 to H14."""
    digits = F.regexp_replace(F.regexp_replace(text, BLANK, ""), "[0-9]+", "#")
    return F.regexp_replace(digits, f"([{ROMAN}]{{1,7}})([^{ROMAN}]|$)", "#$2")


def header_core(text: Column) -> Column:
    """H8."""
    return F.translate(normal_header(text), "#", "")


def page_number_only(normal: Column) -> Column:
    """H15."""
    return normal.rlike(PAGE_NUMBER)


def list_marker(text: Column) -> Column:
    """G21."""
    return text.rlike(LIST_MARKER.replace(r"\s", BLANK))


def numbered_code(text: Column) -> Column:
    """G28."""
    return text.rlike(NUMBERED_CODE.replace(r"\s", BLANK))


def ends_sentence(text: Column) -> Column:
    """G34."""
    closing = "".join("\\" + c for c in CLOSING)
    return text.rlike(f"[{TERMINAL}][{closing}]*{BLANK}*$")


def has_cjk(text: Column) -> Column:
    """G38."""
    return text.rlike(CJK_CLASS)


def latin_share(text: Column) -> Column:
    """Share of ASCII letters among what isn't white space; 0 for blank text."""
    shown = F.length(F.regexp_replace(text, BLANK, ""))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(shown > 0, letters / shown).otherwise(F.lit(0.0))


def code_line(text: Column, size: Column) -> Column:
    """G27, G30."""
    small = (size <= 7.5) & (size > 0) & text.rlike("[A-Za-z]") & ~has_cjk(text) & (latin_share(text) >= 0.5)
    return numbered_code(text) | small


def segment_space(gap: Column, size: Column, before: Column, after: Column) -> Column:
    """The blank between two segments, given the characters that meet."""
    wide = has_cjk(before), has_cjk(after)
    met = (F.length(before) > 0) & (F.length(after) > 0)
    latin = met & ~wide[0] & ~wide[1] & (before.rlike("[A-Za-z]") | after.rlike("[A-Za-z]"))
    blank = (latin & (gap >= 0.25 * size)) | (gap > 2.0 * size) | ((gap > 0.3 * size) & ~(met & wide[0] & wide[1]))
    return F.when((before == "-") | (after == "-"), "").when(blank, " ").otherwise("")


def display_width(text: Column) -> Column:
    """Columns on a terminal."""
    narrow = F.regexp_replace(text, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in WIDE) + "]", "")
    return 2 * F.length(text) - F.length(narrow)


def script_kinds(text: Column) -> Column:
    """How many kinds of script a text has."""
    kinds = ["[\\x{3041}-\\x{309F}]", "[\\x{30A1}-\\x{30FF}]", "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}]", "[A-Za-z]"]
    other = f"[^{BLANKS}" + "".join(k[1:-1] for k in kinds) + "]"
    return reduce(Column.__add__, [text.rlike(k).cast("int") for k in [*kinds, other]])


# Matrices as structs of a to f


def multiply(m: Column, n: Column) -> Column:
    """C41."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"),
        (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"),
        (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"),
        (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"),
        (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    """C42."""
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def matrix(*values: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(k) for k, v in zip("abcdef", values, strict=True)])


def device_size(m: Column) -> Column:
    """C46."""
    return F.sqrt(m["c"] * m["c"] + m["d"] * m["d"])


# Groups and windows


def truncated_quantile(ranked_value: Column, rank: Column, count: Column, q: float) -> Column:
    """Aggregate over rows that carry their rank (from 0) in the group and its size: the value at the truncated place. No group is collected into an array."""
    return F.max(F.when(rank == F.floor(q * (count - 1)), ranked_value))


def line_band(baseline: Column, page: WindowSpec, share: float = 0.15) -> Column:
    """Top, bottom or middle of the page's span of baselines."""
    low, high = F.min(baseline).over(page), F.max(baseline).over(page)
    return F.when(high <= low, "middle").when(baseline >= high - share * (high - low), "top").when(baseline <= low + share * (high - low), "bottom").otherwise("middle")

