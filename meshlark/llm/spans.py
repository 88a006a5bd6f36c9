"""Spans of patterns as SQL expressions: places of matches without leaving the JVM."""

from __future__ import annotations

#: Matches that are gathered in one array before it is set aside.
BLOCK = 500
SPAN = "array<struct<kind string, start int, stop int, text string, before string, after string>>"
#: Characters before a span that are kept with it.
CONTEXT = 32


def literal(pattern: str) -> str:
    """A SQL string literal whose value is the pattern."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(text: str, pattern: str, kind: str, keep: str = "TRUE", may: str | None = None) -> str:
    """All leftmost non-overlapping matches of pattern in the column `text`, as SPAN.

    keep: a condition on $m, the matched text; a match that fails is dropped.
    may: a cheap condition on the text without which no match is possible.

    The parts between matches and the matches alternate; the places are sums of their lengths.
    """
    p = literal(pattern)
    after_part = f"right(concat(a.tail, right(p.part, {CONTEXT})), {CONTEXT})"  # what stands before the match, without a look at the whole text
    span = f"named_struct('kind', '{kind}', 'start', a.at + length(p.part), 'stop', a.at + length(p.part) + length(p.m), 'text', p.m, 'before', {after_part}, 'after', p.z)"
    step = (
        f"(a, p) -> named_struct('at', a.at + length(p.part) + length(p.m), 'tail', right(concat({after_part}, right(p.m, {CONTEXT})), {CONTEXT}), "
        f"'out', CASE WHEN {keep.replace('$m', 'p.m')} THEN concat(a.out, array({span})) ELSE a.out END)"
    )
    zipped = (
        "zip_with(zip_with(slice(parts, 1, size(ms)), ms, (x, y) -> named_struct('part', x, 'm', y)), "
        "zip_with(slice(parts, 2, size(ms)), slice(concat(ms, array('')), 2, size(ms)), (x, y) -> CASE WHEN x = '' THEN left(y, 1) ELSE left(x, 1) END), (x, z) -> named_struct('part', x.part, 'm', x.m, 'z', z))"
    )
    # in blocks, as an array that grows by one copies all before it
    block = f"aggregate(slice(ps, b * {BLOCK} + 1, {BLOCK}), named_struct('at', o.at, 'tail', o.tail, 'out', CAST(array() AS {SPAN})), {step})"
    blocks = f"aggregate(sequence(0, (size(ps) - 1) div {BLOCK}), named_struct('at', 0, 'tail', '', 'out', CAST(array() AS array<{SPAN}>)), (o, b) -> transform(array({block}), i -> named_struct('at', i.at, 'tail', i.tail, 'out', concat(o.out, array(i.out))))[0], o -> flatten(o.out))"
    walk = f"transform(array(split({text}, {p}, -1)), parts -> transform(array({zipped}), ps -> {blocks})[0])[0]"
    once = f"transform(array(regexp_extract_all({text}, {p}, 0)), ms -> CASE WHEN size(ms) = 0 THEN CAST(array() AS {SPAN}) ELSE {walk} END)[0]"
    return f"CASE WHEN {may} THEN {once} ELSE CAST(array() AS {SPAN}) END" if may else once


def told(spans: str) -> str:
    """kind:start:stop, joined by commas."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"
