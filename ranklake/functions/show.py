"""Highlighting and snippets as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import query as Q
from .text import TextOptions


def _hit(text: str, options: TextOptions):
    leaves = Q.scored(Q.normalized(Q.parse(text), options))
    whole = sorted({t for x in leaves if x.kind != "prefix" for t in x.tokens})
    starts = sorted({x.tokens[0] for x in leaves if x.kind == "prefix"})

    def test(t: Column) -> Column:
        parts = ([t.isin(*whole)] if whole else []) + [F.startswith(t, F.lit(p)) for p in starts]
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    return test


def _marked(tokens: Column, test, start: str, end: str) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.when(test(t), F.concat(F.lit(start), t, F.lit(end))).otherwise(t)), " ")


def highlight(tokens: Column, query: str, start: str = "<b>", end: str = "</b>", options: TextOptions = TextOptions()) -> Column:
    """A document's tokens joined by spaces, with those that a positive term of the query means marked."""
    return _marked(tokens, _hit(query, options), start, end)


def snippet(tokens: Column, query: str, max_tokens: int = 24, start: str = "<b>", end: str = "</b>", options: TextOptions = TextOptions()) -> Column:
    """A window of max_tokens around the first hit, marked, with dots where the document goes on."""
    if max_tokens < 1:
        raise Q.QueryError("a snippet has one token at least")
    test = _hit(query, options)
    first = F.coalesce(F.try_element_at(F.filter(F.transform(tokens, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull()), F.lit(1)), F.lit(0))
    n = F.size(tokens)
    begin = F.greatest(F.lit(0), F.least(first - max_tokens // 2, n - max_tokens))
    inner = _marked(F.slice(tokens, begin + 1, max_tokens), test, start, end)
    return F.concat(F.when(begin > 0, "... ").otherwise(""), inner, F.when(begin + max_tokens < n, " ...").otherwise(""))
