"""Operator 9: secret scans with a trigram index, in SQL expressions only.

From each rule's pattern a Boolean query of trigrams is derived: trigrams that
every match must hold, the few rarest of those that must all be there. A posting
says that a document's lower-cased text contains a trigram. Postings are
intersected and united as the queries say, and only candidates are verified with
a rule's pattern. A rule without mandatory trigrams scans every text.

The postings can be had in two orders. By trigram (`postings`, an inverted index
as a table, each part of it in the order of trigrams) they are stored once for
any number of scans: `scanned` then takes the candidates from the index, grouped
by document, and joins them to the documents, which is a broadcast up to
MOST_SENT candidates; `secret_report` works so. By document they are made beside
the text, and only as far as a query needs them, so that neither texts nor
postings are shuffled; this is how `scanned` works without an index.

Defined results: null and empty texts have no spans; a document whose id is
null is matched null-safely; rows that repeat an id share its postings in a
stored index and are each verified on their own text, so each gives its own row;
an empty table gives an empty result; of other columns only those asked for are
read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import carries, small_side, written
from .spans import found, literal, told

_parser = re._parser  # the standard library's pattern parser

#: More strings than this aren't followed through a pattern; their trigrams are required instead.
FOLLOW = 24
#: Of trigrams that must all be there, so many of the rarest are asked for.
RAREST = 3
#: Candidates of a stored index that are broadcast at most (some 100 bytes each); beyond, texts are shuffled to meet them.
MOST_SENT = 500_000
#: Letters by how common they are in English (fixed order); other characters are taken to be rarer.
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: str = "TRUE"


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base rules come first; the others are added by the method.
BASE = (
    Rule("assign", ASSIGN, f"length(regexp_extract($m, {literal(ASSIGN)}, 2)) >= 6"),
    Rule("access", r"AKIA[A-Z0-9]+", "length($m) >= 20"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


# --- Boolean trigram queries: ("and", ...), ("or", ...), a trigram, or True


def _both(*parts):
    flat = []
    for p in parts:
        flat += p[1:] if isinstance(p, tuple) and p[0] == "and" else [] if p is True else [p]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _either(*parts):
    if any(p is True for p in parts):
        return True
    held = {p: frozenset(p[1:]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts}
    flat = [p for p in held if not any(held[q] < held[p] for q in held)]  # a part that needs more than another is no news
    return flat[0] if len(flat) == 1 else ("or", *flat)


def _of_strings(strings: set[str]):
    """One of the strings is in the text."""
    return _either(*(_both(*(s[k : k + 3] for k in range(len(s) - 2))) for s in sorted(strings)))


def _walk(items):
    """(the set of all strings that the items can match, or None, and the query that holds for any match)."""
    strings, whole = {""}, True
    query = True
    for op, arg in items:
        name = str(op)
        own, need = None, True
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "IN":
            if all(str(o) == "LITERAL" for o, _ in arg):
                own = {chr(v).lower() for _, v in arg}
        elif name == "SUBPATTERN":
            own, need = _walk(arg[-1])
        elif name == "BRANCH":
            each = [_walk(x) for x in arg[1]]
            own = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
            need = _either(*(_both(q, _of_strings(s)) if s is not None else q for s, q in each)) if own is None else True
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            got, q = _walk(inner)
            if got is not None and most == 1:
                own, need = (got | {""}, True) if least == 0 else (got, q)
            elif got is not None and least == most and len(got) == 1:
                own = {next(iter(got)) * least}
            elif least > 0:
                need = _both(q, _of_strings(got)) if got is not None else q
        if own is not None and len(own) > FOLLOW:
            own, need = None, _both(need, _of_strings(own))
        query = _both(query, need)
        if own is None:
            query = _both(query, _of_strings(strings))
        elif len(strings) * len(own) > FOLLOW:
            query, strings, whole = _both(query, _of_strings(strings)), own, False
        else:
            strings = {a + b for a in strings for b in own}
        if own is None:
            whole, strings = False, {""}
    return (strings if whole else None), _both(query, True if whole else _of_strings(strings))


def trigram_query(pattern: str):
    """The Boolean query of lower-case trigrams that every text with a match satisfies; True if there is none."""
    strings, query = _walk(_parser.parse(pattern))
    return _both(query, _of_strings(strings)) if strings is not None else query


def rarest(query):
    """The query with RAREST trigrams of each conjunction, the rarest first; it holds wherever the query does."""
    if not isinstance(query, tuple):
        return query
    parts = [rarest(p) for p in query[1:]]
    if query[0] == "or":
        return ("or", *parts)
    by = lambda t: -sum(_COMMON.find(c) % (len(_COMMON) + 1) for c in t)
    plain = sorted((p for p in parts if isinstance(p, str)), key=by)[:RAREST]
    return ("and", *plain, *(p for p in parts if not isinstance(p, str)))


def trigrams(query) -> list[str]:
    return [] if query is True else [query] if isinstance(query, str) else sorted({t for p in query[1:] for t in trigrams(p)})


def condition(query, present) -> str:
    """The query as a SQL condition; present(trigram) gives the condition for one."""
    if query is True:
        return "TRUE"
    if isinstance(query, str):
        return present(query)
    return "(" + (" AND " if query[0] == "and" else " OR ").join(condition(p, present) for p in query[1:]) + ")"


# --- the index


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_op_posting, trigram): the id and the trigram's number, for each of the trigrams that a lower-cased text contains."""
    listed = ", ".join(f"named_struct('n', {k}, 't', {literal(t)})" for k, t in enumerate(trigrams))
    hit = f"transform(filter(array({listed}), x -> contains(low, x.t)), x -> x.n)"
    return docs.select(F.col(id_col).alias("_op_posting"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low")).select("_op_posting", F.explode(F.expr(hit)).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, object], trigrams: list[str]) -> DataFrame:
    """(_op_posting, a boolean column _op_c_<kind> for each rule): the intersected postings of documents that some query accepts."""
    words = [f"w{k}" for k in range(len(trigrams) // 60 + 1)]
    held = index.groupBy("_op_posting").agg(*(F.expr(f"bit_or(CASE WHEN trigram div 60 = {k} THEN shiftleft(1L, CAST(trigram % 60 AS INT)) ELSE 0L END)").alias(w) for k, w in enumerate(words)))
    at = {t: k for k, t in enumerate(trigrams)}

    def present(t: str) -> str:
        return f"(w{at[t] // 60} & {1 << at[t] % 60}L) <> 0"

    marked = held.select("_op_posting", *(F.expr(condition(q, present)).alias(f"_op_c_{kind}") for kind, q in queries.items()))
    return marked.where(" OR ".join(f"_op_c_{kind}" for kind in queries))


def wanted(rules: tuple[Rule, ...]) -> tuple[dict[str, object], list[str]]:
    """The queries of the rules that have one, and their trigrams."""
    queries = {r.kind: rarest(trigram_query(r.pattern)) for r in rules}
    queries = {k: q for k, q in queries.items() if q is not True}
    return queries, sorted({t for q in queries.values() for t in trigrams(q)})


@carries
def scanned(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """docs with a column secret_spans (kind, start, stop, text), ordered by start, then by rule; a column of that name is replaced.

    index: the postings of docs for the trigrams of `wanted`, if they are stored.
    """
    queries, listed = wanted(rules)
    text = f"coalesce(`{text_col}`, '')"
    if index is None:
        low = docs.withColumn("_op_low", F.lower(F.expr(text)))
        marks = [F.expr(condition(q, lambda t: f"contains(_op_low, {literal(t)})")).alias(f"_op_c_{k}") for k, q in queries.items()]
        marked = low.select(*docs.columns, *marks)
    else:
        held = small_side(candidates(index, queries, listed), MOST_SENT)
        marked = docs.join(held, docs[id_col].eqNullSafe(held["_op_posting"]), "left")
    each = [found(text, r.pattern, r.kind, r.keep, f"_op_c_{r.kind}" if r.kind in queries else f"{text} RLIKE {literal(r.pattern)}") for r in rules]
    order = "CASE s.kind " + " ".join(f"WHEN '{r.kind}' THEN {k}" for k, r in enumerate(rules)) + " END"
    ranked = f"transform(array_sort(transform(concat({', '.join(each)}), s -> named_struct('start', s.start, 'k', {order}, 's', s))), x -> x.s)"
    return marked.withColumn("secret_spans", F.expr(ranked)).select(*(c for c in docs.columns if c != "secret_spans"), "secret_spans")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row, by an index that is written first."""
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    texts = docs.select(id_col, text_col)
    index = written(postings(texts, wanted(BASE + MORE)[1], id_col, text_col).sortWithinPartitions("trigram"))
    found_in = scanned(texts, id_col=id_col, text_col=text_col, index=index).select(id_col, "secret_spans")
    counts = [F.expr(f"CAST(size(filter(secret_spans, s -> s.kind = '{r.kind}')) AS LONG)").alias(f"n_{r.kind}") for r in BASE]
    only = f"filter(secret_spans, s -> s.kind IN ({base}))"
    return found_in.select(id_col, *counts, F.sha2(F.expr(told(only)), 256).alias("base_sha256"), F.expr(told("secret_spans")).alias("spans"))


@carries
def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret's span replaced by the mark; spans that overlap give one mark."""
    step = (
        f"(a, s) -> named_struct('at', greatest(a.at, s.stop), 'out', CASE WHEN s.start >= a.at THEN concat(a.out, substring(`{text_col}`, a.at + 1, s.start - a.at), {literal(mark)}) ELSE a.out END)"
    )
    new = f"aggregate(secret_spans, named_struct('at', 0, 'out', ''), {step}, a -> concat(a.out, substring(`{text_col}`, a.at + 1)))"
    out = scanned(docs, id_col=id_col, text_col=text_col)
    return out.withColumn(text_col, F.expr(f"CASE WHEN size(secret_spans) = 0 THEN `{text_col}` ELSE {new} END")).drop("secret_spans")

