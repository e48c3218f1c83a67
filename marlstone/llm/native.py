"""Pieces of SQL for work on arrays within a row.

Each function takes and returns SQL text, so that an operator that must stay
inside the JVM is one expression over built-in functions. A value that is used
more than once is bound with ``let``: Spark would otherwise compute it anew at
each mention inside a lambda.
"""

from __future__ import annotations

#: What words are split by: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\\x20\\x09-\\x0D]+"


def let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` stands for ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def words(text: str) -> str:
    """The words of a text, in order."""
    return f"filter(split({text}, '{BLANKS}'), word -> word <> '')"


def lower_bound(array: str, value: str) -> str:
    """The first index of a sorted array (a name, or cheap) whose element is not below ``value``; its size if none is."""
    return (
        f"(aggregate(transform(sequence(CAST(ceil(log2(size({array}) + 1)) AS INT), 0, -1), bit -> shiftleft(1, bit)), -1,"
        f" (at, step) -> if(at + step < size({array}) AND get({array}, at + step) < {value}, at + step, at)) + 1)"
    )


def running(array: str, merge: str, empty: str) -> str:
    """Running totals of an array under ``merge`` (a template of a and b), in log2(size) passes; ``empty``: SQL for an empty array."""
    step = merge.format(a="get(part, i - shiftleft(1, bit))", b="x")
    return let(
        "whole",
        array,
        f"if(size(whole) = 0, {empty}, aggregate(sequence(0, CAST(ceil(log2(size(whole))) AS INT)), whole,"
        f" (part, bit) -> transform(part, (x, i) -> if(i >= shiftleft(1, bit), {step}, x))))",
    )
