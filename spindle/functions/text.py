"""Text functions on Columns: words, keyword sets, similarity, hashes, lines, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.functions import vocabulary as V

UNIT = "\x1f"


def let(value: Column, body) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and the signs of names like c++, c# and .net; repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9+#.]+"), F.lit(0))


def keywords(text: Column, *, topic: bool = False) -> Column:
    """Sorted distinct tokens of three characters or more that aren't stop words; topic drops follow-up verbs too."""
    dropped = [*V.STOP_WORDS, *(V.FOLLOW_UP_WORDS if topic else ())]
    kept = F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(dropped))
    return F.array_sort(F.array_distinct(kept))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when(common == 0, 0.0).otherwise(common / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Common members as a share of the smaller set."""
    common = F.size(F.array_intersect(a, b))
    return F.when(common == 0, 0.0).otherwise(common / F.least(F.size(a), F.size(b)))


def blend(a: Column, b: Column) -> Column:
    return 0.5 * jaccard(a, b) + 0.5 * overlap(a, b)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def chunk_id(repository: Column, path: Column, symbol: Column, kind: Column, start: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (repository, path, symbol, kind, start)]
    return F.sha1(F.concat_ws(UNIT, *parts).cast("binary"))


def repository_id(root: Column) -> Column:
    return F.substring(F.sha1(root.cast("binary")), 1, 16)


def token_estimate(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def line_count(text: Column) -> Column:
    """Lines of a text; a final line end opens no new line."""
    text = F.coalesce(text, F.lit(""))
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.when(text == "", 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def span(all_lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1 and both included, within bounds."""
    first, last = F.greatest(start, F.lit(1)), F.least(end, F.size(all_lines))
    return F.when(last < first, "").otherwise(F.array_join(F.slice(all_lines, first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "\n"))


def first_line(text: Column, most: int = 160) -> Column:
    """The first line with something visible, trimmed and cut; empty if there is none."""
    seen = F.filter(lines(text), lambda x: F.trim(x) != "")
    return F.coalesce(F.substring(F.trim(F.get(seen, F.lit(0))), 1, most), F.lit(""))


def normalized_query(text: Column) -> Column:
    """Control characters and runs of white space as one blank, trimmed."""
    plain = F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def readable_size(size: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Column:
    """size in the largest of units that it reaches, with one decimal; of two as near the even one, as printf has it."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units, 1):
        tenths = F.rint(size / float(1024**power) * 10)  # format_string alone rounds halves up
        shown = F.concat(F.format_string("%.1f", tenths / 10), F.lit(f" {unit}"))
        out = F.when(size >= 1024**power, shown).otherwise(out)
    return out


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))


def word_pattern(words) -> str:
    """A pattern for any of words as whole words; those with a blank match anywhere.

    Boundaries are spelt out, as engines differ in what they take as word characters. After a sign
    such as + a boundary needs a word character to follow.
    """
    letter, other = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    plain = {w: "".join("\\" + c if c in "+.#-*?()[]{}|^$" else c for c in w) for w in words}
    out = [plain[w] for w in plain if " " in w]
    # words that end alike share what must stand around them, so that a place is looked at once
    for whole, after in ((True, f"(?:$|{other})"), (False, letter)):
        own = [plain[w] for w in plain if " " not in w and (w[-1].isalnum() or w[-1] == "_") == whole]
        if own:
            out.append(f"(?:^|{other})(?:{'|'.join(own)}){after}")
    return "|".join(out)


def any_pattern(parts) -> str:
    """A pattern for any of parts as substrings."""
    return "|".join("".join("\\" + c if c in "+.#-*?()[]{}|^$" else c for c in p) for p in parts)


def english_list(items: Column) -> Column:
    n = F.size(items)
    last = F.element_at(items, -1)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, items[0]).when(n == 2, F.concat(items[0], F.lit(" and "), items[1])).otherwise(F.concat(head, F.lit(", and "), last))
