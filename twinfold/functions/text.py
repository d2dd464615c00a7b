"""Text parses: answer labels, complete answers, reasoning traces, prefixes, spans and edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, and edge marks that a complete answer may carry: fixed values.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EDGE = r"""\x20"'`.,;:!?"""

#: What a word is made of, in any script.
LETTER = r"[\p{L}\p{N}_]"


def stripped(text: Column) -> Column:
    """The text without white space at its edges, line ends and tabs included."""
    return F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+\z", "")


def _labels(labels: Sequence[str] | Column) -> Column:
    return labels if isinstance(labels, Column) else F.array(*map(F.lit, labels))


def strict_label(text: Column, labels: Sequence[str] | Column) -> Column:
    """The text itself if, stripped, it is one of the labels (a list, or an array of the row)."""
    t = stripped(text)
    return F.when(F.array_contains(_labels(labels), t), t)


def relaxed_label(text: Column, labels: Sequence[str] | Column) -> Column:
    """The one label that stands in the text as a whole word; null if none or several do. Labels are words as they stand, not patterns."""
    plain = lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_\s])", r"\\$1")
    found = F.filter(_labels(labels), lambda w: F.regexp_like(text, F.concat(F.lit(f"(?<!{LETTER})"), plain(w), F.lit(f"(?!{LETTER})"))))
    return F.when(F.size(found) == 1, F.get(found, 0))


def label_class(text: Column, labels: Sequence[str] | Column, correct: Column, terminated: Column | None = None) -> Column:
    """correct, wrong or invalid by the strict label; a text whose generation didn't end by itself is invalid."""
    t = strict_label(text, labels)
    t = t if terminated is None else F.when(terminated, t)
    return F.when(t.isNull(), "invalid").when(t == correct, "correct").otherwise("wrong")


def folded(text: Column) -> Column:
    """The text with its cases folded: what differs in case alone, "Straße" and "STRASSE" too, becomes equal.

    Upper case, then lower case; the final sigma is like the others, and the dotless i stays apart from the dotted one. (The sigma is
    translated between the two: lower(upper(x)) by itself would be planned as lower(x).)
    """
    dotless = "\u0131"
    kept = F.transform(F.split(text, dotless, -1), lambda x: F.lower(F.translate(F.upper(x), "\u03a3", "\u03c3")))
    return F.array_join(kept, dotless)


def complete_answer(text: Column) -> Column:
    """The text, cases folded, without white space at its edges and, within these, without marks and spaces."""
    return folded(F.regexp_replace(stripped(text), rf"^[{EDGE}]+|[{EDGE}]+\z", ""))


def answer_class(text: Column, correct: Column, stale: Column) -> Column:
    """correct, stale or other, by the complete answer; the expected ones are brought to the same form. Null is other."""
    answer = complete_answer(text)
    return F.when(answer == complete_answer(correct), "correct").when(answer == complete_answer(stale), "stale").otherwise("other")


def after_marker(text: Column, marker: str, truncated: Column, end: str = "") -> Column:
    """What follows the last marker, stripped and without the end token; null if there is no marker or the text was truncated."""
    tail = F.substring_index(text, marker, -1)
    return F.when(F.contains(text, F.lit(marker)) & ~truncated, stripped(F.replace(tail, F.lit(end)) if end else tail))


def first_case(cases: Mapping[str, Column], otherwise: str) -> Column:
    """The name of the first case that holds, in order: an error taxonomy. Null conditions don't hold."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in cases.items()), F.lit(otherwise))


def tags(cases: Mapping[str, Column], between: str = "+") -> Column:
    """The names of all cases that hold, in order, joined; empty if none does."""
    return F.concat_ws(between, *(F.when(c, F.lit(n)) for n, c in cases.items()))


def prefix_candidate(text: Column, candidates: Sequence[str]) -> Column:
    """The first candidate (in order) that the text starts with, whatever the case; null if none."""
    return F.get(F.filter(F.array(*map(F.lit, candidates)), lambda c: F.startswith(F.lower(text), F.lower(c))), 0)


def temporal_gap(order: Column, later: Column, earlier: Column) -> Column:
    """Positions between two items of an order; null if either is missing."""
    a, b = F.array_position(order, later), F.array_position(order, earlier)
    return F.when((a > 0) & (b > 0), a - b - 1)


def span_gap(a_end: Column, b_start: Column) -> Column:
    """Tokens between two half-open spans; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), b_start - a_end)


def span_distance(start: Column, end: Column, position: Column) -> Column:
    """Distance of a position to a half-open span; 0 inside."""
    return F.greatest(F.lit(0), start - position, position - end + 1)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """text with the first occurrence of old replaced."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by halving."""
    n = F.least(F.length(a), F.length(b))
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))  # any length that a string can have
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((s <= n - at) & (F.substring(a, at + 1, s) == F.substring(b, at + 1, s)), at + s).otherwise(at))


def changed_middle(a: Column, b: Column) -> Column:
    """The part of b between the longest prefix and (of the rest) the longest suffix it shares with a."""
    p = common_prefix(a, b)
    rest_a, rest_b = F.substring(a, p + 1, F.length(a)), F.substring(b, p + 1, F.length(b))
    s = common_prefix(F.reverse(rest_a), F.reverse(rest_b))
    return F.substring(rest_b, F.lit(1), F.length(rest_b) - s)


def name_value_distance(pieces: Column, name: Column, value: Column) -> Column:
    """Tokens strictly between the last token of a name and the first of a value; null if either isn't there.

    pieces: the tokens' own strings. The name ends with the first token that completes it; so does the value, which begins with the last
    token from which it is still whole.
    """
    bound = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  (x is computed once)
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda a, p: F.array_append(a, F.element_at(a, -1) + F.coalesce(F.length(p), F.lit(0))))  # of the tokens in the text, after 0

    def completed(s: Column, word: Column) -> Column:
        at = F.instr(s["text"], word)
        return F.when(at > 0, F.size(F.filter(s["ends"], lambda e: e < at - 1 + F.length(word))))

    def begun(s: Column, end: Column) -> Column:
        upto = F.substring(s["text"], F.lit(1), F.get(s["ends"], end))
        last = F.length(upto) - F.instr(F.reverse(upto), F.reverse(value)) + 1 - F.length(value)  # letters before the value's last occurrence
        return F.size(F.filter(F.slice(s["ends"], F.lit(1), end), lambda e: e <= last)) - 1

    def distance(s: Column) -> Column:
        return bound(completed(s, value), lambda end: F.when(end > 0, begun(s, end) - completed(s, name)))

    return bound(F.struct(ends.alias("ends"), F.array_join(pieces, "").alias("text")), distance)


def utc_stamp(time: Column | None = None) -> Column:
    """A timestamp (or now) as 2026-01-31T12:00:00Z."""
    at = F.current_timestamp() if time is None else time
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
