"""Text measuring, cleaning and cutting as column expressions. A null text gives null unless said otherwise."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s\x1c-\x1f\x85"
#: Texts that a task makes strings of at a time.
ROWS_PER_PIECE = 500


@lru_cache
def wide_class() -> str:
    """The inside of a regex class of the wide and full-width characters, from the Unicode tables."""
    ranges, start = [], None
    for c in range(0x110001):
        wide = c < 0x110000 and not 0xD800 <= c < 0xE000 and unicodedata.east_asian_width(chr(c)) in "FW"
        if wide and start is None:
            start = c
        if not wide and start is not None:
            ranges.append((start, c - 1))
            start = None
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def display_width(text: Column) -> Column:
    """Columns that the text takes: two for a wide or full-width character, one for any other."""
    # No character before U+1100 is wide, and most texts have none from there on.
    wide = F.char_length(F.regexp_replace(text, f"[^{wide_class()}]+", ""))
    return F.char_length(text) + F.when(text.rlike(r"[\x{1100}-\x{10FFFF}]"), wide).otherwise(F.lit(0))


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space, of Unicode's too, become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U)[{SPACE}]+", " "))


def char_type(char: Column) -> Column:
    """SPACE, LATIN (one column) or ASIAN (two); the space test comes first, so U+3000 is SPACE."""
    return F.when(char.rlike(f"(?U)^[{SPACE}]"), "SPACE").when(display_width(char) == 1, "LATIN").otherwise("ASIAN")


def tokenize(text: Column) -> Column:
    """Runs of one-column characters stay together; each space and each wide character is a token; an empty text is one empty token."""
    found = F.regexp_extract_all(text, F.lit(f"(?Us)[^{SPACE}{wide_class()}]+|."), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def split_long_token(token: Column, width: int) -> Column:
    """Pieces of ``width`` code points; [] of an empty token."""
    n = F.ceil(F.char_length(token) / width).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(token, i * width + 1, F.lit(width)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def render_template(text: Column, mapping: dict[str, str]) -> Column:
    """``--Name`` and ``--{Name}`` become the mapping's value, ``----`` becomes ``--``; unknown slots stay.

    The text is cut once into slots, marks and what stands between them, from left to right, so that a value
    is never looked at again. A name begins with a letter or ``_`` and is as long as it can be.
    """
    name = "[A-Za-z_][A-Za-z0-9_]*"
    parts = F.regexp_extract_all(text, F.lit(rf"----|--{name}|--\{{{name}\}}|--|[^-]+|-"), F.lit(0))
    slots = {"----": "--"} | {slot: value for key, value in mapping.items() for slot in (f"--{key}", f"--{{{key}}}")}
    table = F.create_map(*[F.lit(x) for pair in slots.items() for x in pair])
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("--"), F.coalesce(F.try_element_at(table, x), x)).otherwise(x)), "")


def initial_letter(text: Column) -> Column:
    """The first character in upper case, which may be several (SS of ß); null of an empty text."""
    return F.nullif(F.upper(F.substring(text, 1, 1)), F.lit(""))


def restyled(old: Column, new: Column) -> Column:
    """``new``, or ``old`` where the two are the same but for white space at their ends; a null counts as no text."""
    cut = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), f"(?U)[{SPACE}]+\\z", "")
    return F.when(cut(old) == cut(new), old).otherwise(new)


#: No character before it takes two columns.
FIRST_WIDE = "\u1100"


class _Widths(dict):
    def __missing__(self, c: str) -> int:
        self[c] = 2 if unicodedata.east_asian_width(c) in "FW" else 1
        return self[c]


_WIDTHS = _Widths()


def _narrow(s: str) -> bool:
    return s.isascii() or max(s) < FIRST_WIDE


def _measure(s: str) -> int:
    return len(s) if _narrow(s) else sum(map(_WIDTHS.__getitem__, s))


def _rows(line: str, width: int) -> list[str]:
    """The rows of a line that is too wide, each found at once by where it must end.

    A row that a fitting token fills is closed, and a space after it goes. A token that did not fit into the row before, or
    is the rest of one that was too long, leaves its row open even if it fills it, so that a space after it starts the next row and stays.
    """
    n, out, at, fresh = len(line), [], 0, True
    if _narrow(line):
        edges = None
        end_of = lambda i: i + width
        span = lambda i, j: j - i
    else:
        sums = [0, *accumulate(map(_WIDTHS.__getitem__, line))]
        wide = [b - a == 2 for a, b in pairwise(sums)]
        # Where tokens begin and end: at spaces and at wide characters.
        edges = [k for k in range(1, n) if wide[k] or wide[k - 1] or line[k] == " " or line[k - 1] == " "] + [n]
        end_of = lambda i: bisect_right(sums, sums[i] + width) - 1
        span = lambda i, j: sums[j] - sums[i]

    def last_edge(i: int, j: int) -> int:
        """The last place up to ``j`` where a token ends, or ``i``."""
        if edges is not None:
            return max(i, edges[k - 1]) if (k := bisect_right(edges, j)) else i
        if line[j] == " " or line[j - 1] == " ":
            return j
        return line.rfind(" ", i, j) + 1 or i

    def token_end(i: int) -> int:
        if edges is not None:
            return edges[bisect_right(edges, i)]
        return i + 1 if line[i] == " " else k if (k := line.find(" ", i)) >= 0 else n

    while at < n:
        end = end_of(at)
        if end >= n and span(at, n) <= width:
            out.append(line[at:].rstrip())
            break
        edge = last_edge(at, end)
        if edge > at:
            out.append(line[at:edge].rstrip())
            fresh = span(at, edge) == width and (fresh or token_end(at) < edge)
            at = edge
            if fresh and at < n and line[at] == " ":
                at += 1
            continue
        edge = token_end(at)
        while edge - at > width and span(at, edge) > width:
            out.append(line[at : at + width])
            at += width
        fresh = False
        if span(at, edge) >= width:
            out.append(line[at:edge].rstrip())
            at = edge
    return out


def wrap_lines(text: str, width: int, once: bool = False) -> tuple[str, bool]:
    """Greedy wrapping by display width; gives the lines joined by newlines and whether any line was cut.

    With ``once`` the first line that is too wide is broken in two, and what follows is the text from
    the place that the broken line's length gives; narrow lines before it run together.
    """
    out, cut = [], False
    for raw in text.splitlines():
        line = " ".join(raw.split())
        if _measure(line) <= width:
            out.append(line)
            continue
        cut, rows = True, _rows(line, width)
        if once:
            broken = rows[0] + "\n" + " ".join(rows[1:])
            return "".join(out) + broken + text[len(broken) :].rstrip(), True
        out += rows
    return "\n".join(out), cut


def wrap_text(text: Column, width: int, once: bool = False) -> Column:
    """struct<text, is_wrapped>: the text wrapped at ``width`` columns, everywhere or once; null stays null."""
    kind = pa.struct([("text", pa.string()), ("is_wrapped", pa.bool_())])

    @F.arrow_udf("text string, is_wrapped boolean")
    def wrap(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Only a few texts of a batch are strings of Python at a time, and none of their rows wait for the others.
        for texts in batches:
            for k in range(0, len(texts), ROWS_PER_PIECE):
                rows = [(None, None) if t is None else wrap_lines(t, width, once) for t in texts.slice(k, ROWS_PER_PIECE).to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))

    return wrap(text)
