"""The query language: lexer, parser, normalization, and predicates over token arrays.

Without parentheses and upper-case AND, OR, NOT a query is classic: ``+term``
must occur, ``-term`` must not, others should; else it is a boolean expression
in which juxtaposition is OR.  ``"a b"`` is a phrase, ``ab*`` a prefix.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import TextOptions, normalize_token

MOST_TOKENS, DEEPEST = 1024, 128
BLANKS = " \t\n\v\f\r"
MUST, MUST_NOT, SHOULD = "must", "must_not", "should"


class QueryError(ValueError):
    """A query string or its options can't be used."""


@dataclass(frozen=True)
class Leaf:
    kind: str  # term, prefix or phrase
    tokens: tuple[str, ...]
    occur: str = SHOULD


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    parts: tuple[Node | Leaf, ...]


@dataclass(frozen=True)
class Query:
    """leaves: of a classic query; root: of a boolean one (None if nothing is left of it)."""

    leaves: tuple[Leaf, ...] = ()
    root: Node | Leaf | None = None
    boolean: bool = False


def lex(text: str) -> list[tuple[str, Leaf | None]]:
    out: list[tuple[str, Leaf | None]] = []
    i = 0
    while True:
        while i < len(text) and text[i] in BLANKS:
            i += 1
        if i >= len(text):
            return out
        ch = text[i]
        if ch in "+-()":
            out.append((ch, None))
            i += 1
        elif ch == '"':
            end = text.find('"', i + 1)
            if end < 0:
                raise QueryError("a phrase has no closing quote")
            words = text[i + 1 : end].split()
            if not words:
                raise QueryError("a phrase is empty")
            if len(words) > MOST_TOKENS:
                raise QueryError("a phrase is too long")
            out.append(("leaf", Leaf("phrase", tuple(words))))
            i = end + 1
        else:
            start = i
            while i < len(text) and text[i] not in BLANKS + "()":
                i += 1
            word = text[start:i]
            if word in ("AND", "OR", "NOT"):
                out.append((word, None))
            elif word == "*":
                raise QueryError("a prefix is empty")
            elif word.endswith("*"):
                out.append(("leaf", Leaf("prefix", (word[:-1],))))
            else:
                out.append(("leaf", Leaf("term", (word,))))
        if len(out) > MOST_TOKENS:
            raise QueryError("a query has too many tokens")


class _Parser:
    def __init__(self, tokens: list[tuple[str, Leaf | None]]) -> None:
        self.tokens, self.at, self.depth = tokens, 0, 0

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def nested(self, parse):
        if self.depth >= DEEPEST:
            raise QueryError("a query is nested too deeply")
        self.at += 1
        self.depth += 1
        out = parse()
        self.depth -= 1
        return out

    def either(self) -> Node | Leaf:
        node = self.both()
        while True:
            kind = self.peek()
            if kind == "OR":
                self.at += 1
            elif kind not in ("leaf", "(", "+", "-", "NOT"):
                return node
            node = Node("or", (node, self.both()))

    def both(self) -> Node | Leaf:
        node = self.unary()
        while self.peek() == "AND":
            self.at += 1
            node = Node("and", (node, self.unary()))
        return node

    def unary(self) -> Node | Leaf:
        kind = self.peek()
        if kind == "+":
            return self.nested(self.unary)
        if kind in ("-", "NOT"):
            return Node("not", (self.nested(self.unary),))
        if kind == "(":
            node = self.nested(self.either)
            if self.peek() != ")":
                raise QueryError("a parenthesis is not closed")
            self.at += 1
            return node
        if kind == "leaf":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise QueryError("a query misses a term")


def parse(text: str) -> Query:
    tokens = lex(text)
    if any(k in ("(", ")", "AND", "OR", "NOT") for k, _ in tokens):
        p = _Parser(tokens)
        root = p.either()
        if p.at != len(tokens):
            raise QueryError("a query goes on after its end")
        return Query(root=root, boolean=True)
    leaves, occur, waiting = [], SHOULD, False
    for kind, leaf in tokens:
        if kind in "+-":
            occur, waiting = (MUST if kind == "+" else MUST_NOT), True
        else:
            leaves.append(replace(leaf, occur=occur))
            occur, waiting = SHOULD, False
    if waiting:
        raise QueryError("a sign has no term")
    return Query(leaves=tuple(leaves))


def _normal_leaf(leaf: Leaf, options: TextOptions) -> Leaf | None:
    # the beginning of a word has no stem
    own = replace_stem(options) if leaf.kind == "prefix" else options
    kept = tuple(n for t in leaf.tokens if (n := normalize_token(t, own)) is not None)
    return replace(leaf, tokens=kept) if kept else None


def replace_stem(options: TextOptions) -> TextOptions:
    return TextOptions(options.lowercase or options.stem_english, options.stopwords, False, options.fold_diacritics)


def normalized(query: Query, options: TextOptions) -> Query:
    """Terms as the index has them; what is dropped as a stopword leaves the expression."""

    def walk(node: Node | Leaf) -> Node | Leaf | None:
        if isinstance(node, Leaf):
            return _normal_leaf(node, options)
        parts = [w for p in node.parts if (w := walk(p)) is not None]
        if not parts:
            return None
        return Node(node.op, tuple(parts)) if node.op == "not" or len(parts) > 1 else parts[0]

    if query.boolean:
        return Query(root=walk(query.root), boolean=True)
    return Query(leaves=tuple(n for x in query.leaves if (n := _normal_leaf(x, options)) is not None))


def simple(query: Query) -> bool:
    """Whether the query only ranks, without a condition on documents."""

    def alike(node: Node | Leaf | None) -> bool:
        if node is None:
            return True
        if isinstance(node, Leaf):
            return node.kind == "term"
        return node.op == "or" and all(map(alike, node.parts))

    if query.boolean:
        return alike(query.root)
    return all(x.occur == SHOULD and x.kind in ("term", "prefix") for x in query.leaves)


def scored(query: Query) -> list[Leaf]:
    """The leaves that score, each as often as it stands; negated ones don't."""
    out: list[Leaf] = []

    def walk(node: Node | Leaf | None, positive: bool) -> None:
        if isinstance(node, Leaf):
            if positive:
                out.append(node)
        elif node is not None:
            for p in node.parts:
                walk(p, positive != (node.op == "not"))

    if query.boolean:
        walk(query.root, True)
    else:
        out = [x for x in query.leaves if x.occur != MUST_NOT]
    return out


def leaf_predicate(leaf: Leaf, tokens: Column) -> Column:
    if leaf.kind == "term":
        return F.array_contains(tokens, leaf.tokens[0])
    if leaf.kind == "prefix":
        return F.exists(tokens, lambda t: F.startswith(t, F.lit(leaf.tokens[0])))
    n = len(leaf.tokens)
    if n == 1:
        return F.array_contains(tokens, leaf.tokens[0])
    phrase = F.array(*[F.lit(t) for t in leaf.tokens])
    places = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    whole = F.exists(places, lambda i: F.slice(tokens, i, n) == phrase)
    # few documents have the words' letters one after another; only those are looked through by place
    letters = F.contains(F.array_join(tokens, " "), F.lit(" ".join(leaf.tokens)))
    return F.when(letters, F.when(F.size(tokens) >= n, whole).otherwise(False)).otherwise(False)


def predicate(query: Query, tokens: Column) -> Column:
    """Whether a document's tokens match; a query of which nothing is left matches none.

    The tokens are bound to a variable: a condition is moved to where the texts
    are read, and would take a text apart for each mention, or place, of its tokens.
    """
    return F.exists(F.array(tokens), lambda own: _predicate(query, own))


def _predicate(query: Query, tokens: Column) -> Column:

    def walk(node: Node | Leaf) -> Column:
        if isinstance(node, Leaf):
            return leaf_predicate(node, tokens)
        parts = [walk(p) for p in node.parts]
        if node.op == "not":
            return ~parts[0]
        return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts)

    if query.boolean:
        return F.lit(False) if query.root is None else walk(query.root)
    of = {o: [leaf_predicate(x, tokens) for x in query.leaves if x.occur == o] for o in (MUST, SHOULD, MUST_NOT)}
    parts = list(of[MUST])
    if not parts and of[SHOULD]:
        parts = [reduce(lambda a, b: a | b, of[SHOULD])]
    parts += [~p for p in of[MUST_NOT]]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)
