"""Array expressions that keep a document's work inside its own row.

They are SQL text for ``F.expr``: nested lambdas read better there, and one
parse is much quicker than assembling them call by call from Python.
"""

from __future__ import annotations


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it as ``name`` in ``body``.

    Catalyst may inline a projected expression into a lambda that mentions it,
    which would evaluate it again for every array element. A lambda variable
    cannot be inlined.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def count_items(items: str, min_count: int = 1) -> str:
    """``array<T>`` -> ``array<struct<item T, n bigint>>``, items seen at least
    ``min_count`` times, in sorted order.

    Sorting puts equal items side by side, so counts are distances between the
    places where a run starts: O(m log m) for m items, no shuffle. If single
    items do not count, they go first: most of a text occurs once.
    """
    ordered = f"sort_array({items})"
    run_starts = "array_compact(transform(s, (x, i) -> case when i = 0 or x <> get(s, i - 1) then i end))"
    runs = """transform(starts, (p, j) -> named_struct(
        'item', get(s, p),
        'n', cast(coalesce(get(starts, j + 1), size(s)) - p as bigint)))"""
    if min_count > 1:
        ordered = let(ordered, "a", "filter(a, (x, i) -> x = get(a, i + 1) or x = get(a, i - 1))")
    if min_count > 2:
        runs = f"filter({runs}, r -> r.n >= {min_count})"
    return let(ordered, "s", let(run_starts, "starts", runs))


def sum_of(items: str, field: str) -> str:
    """Sum one integer field of an array of structs."""
    return f"aggregate({items}, 0L, (total, x) -> total + x.{field})"


def search_steps(items: str) -> str:
    """Falling powers of two that together reach every place of an array."""
    top = f"cast(log2(size({items}) + 1) as int)"
    return f"transform(sequence(0, {top}), i -> cast(shiftleft(1L, {top} - i) as int))"


def place_in(items: str, value: str, steps: str) -> str:
    """Place (from 0) of ``value`` in a sorted array by binary search with its
    ``search_steps``; NULL if it is not there."""
    below = f"aggregate({steps}, 0, (p, step) -> case when get({items}, p + step - 1) < {value} then p + step else p end)"
    return let(below, "p", f"case when get({items}, p) = {value} then p end")
