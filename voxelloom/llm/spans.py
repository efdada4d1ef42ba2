"""Pattern matches with their places, by SQL functions alone.

``regexp_extract_all`` gives the matches and ``split`` by the same pattern what lies between; adding up
lengths (in code points) gives every match's start. Patterns must not match the empty string, and are
written so that a failed attempt costs little: possessive repeats, and starts only where a match can be
leftmost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"


def _sql(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


#: Matches whose lengths are added up one by one; whole blocks of them are added up first, so that a text
#: with very many matches costs no square of their number.
BLOCK = 256
#: The ends of a gap that are looked at first for its outer words.
ENDS = 80


def _words(x: str) -> str:
    return rf"filter(split({x}, r'\s+'), w -> w <> '')"


def _outer_words(x: str) -> str:
    """Last two words and first word of a text. A piece of ``ENDS`` characters is enough if it holds a word more."""
    tail, head = _words(f"right({x}, {ENDS})"), _words(f"left({x}, {ENDS})")
    last = f"reverse(slice(reverse(IF(length({x}) <= {ENDS} OR size({tail}) > 2, {tail}, {_words(x)})), 1, 2))"
    return f"named_struct('n', length({x}), 'last', {last}, 'first', get(IF(length({x}) <= {ENDS} OR size({head}) > 1, {head}, {_words(x)}), 0))"


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, str | None]], context: str | None = None) -> DataFrame:
    """Adds a column of (s, e, m) per name: start, end (exclusive) and match of each leftmost match.

    ``patterns``: name to (pattern, cheap SQL test that any text with a match passes, or None). The regular
    expressions run once per row, then lengths are added up. Matches of the pattern ``context``, which are
    whole words, also get their two words before (array ``left``) and one after (``right``).
    """
    found, lengths, sums, places = {}, {}, {}, {}
    for name, (pattern, test) in patterns.items():
        p = _sql(pattern)
        test = f"({test}) AND " if test else ""
        gap = _outer_words("x") if name == context else "length(x)"
        found[f"_{name}"] = F.expr(f"CASE WHEN {test}{text} rlike {p} THEN struct(regexp_extract_all({text}, {p}, 0) AS m, transform(split({text}, {p}, -1), x -> {gap}) AS gap) END")
        n = ".n" if name == context else ""
        m, gap, own = f"_{name}.m", f"_{name}.gap", f"_{name}_n"
        lengths[own] = F.expr(f"zip_with({m}, slice({gap}, 1, size({m})), (x, g) -> length(x) + g{n})")
        blocks = f"transform(sequence(0, size({own}) div {BLOCK}), b -> aggregate(slice({own}, b * {BLOCK} + 1, {BLOCK}), 0, (a, v) -> a + v))"
        sums[f"_{name}_b"] = F.expr(f"CASE WHEN size({own}) > 0 THEN {blocks} END")
        before = f"aggregate(slice(_{name}_b, 1, i div {BLOCK}), 0, (a, v) -> a + v) + aggregate(slice({own}, i - i % {BLOCK} + 1, i % {BLOCK}), 0, (a, v) -> a + v) + {gap}[i]{n}"
        more, kind = "", SPAN
        if name == context:
            old = f"concat(IF(i > 1, array({m}[i - 2]), array()), IF(i > 0, slice({gap}[i - 1].last, -1, 1), array()), IF(i > 0, array({m}[i - 1]), array()), {gap}[i].last)"
            more = f", 'left', reverse(slice(reverse({old}), 1, 2)), 'right', coalesce({gap}[i + 1].first, get({m}, i + 1))"
            kind = SPAN.replace("m:string", "m:string,left:array<string>,right:string")
        places[name] = F.expr(f"coalesce(transform({m}, (x, i) -> named_struct('s', {before}, 'e', {before} + length(x), 'm', x{more})), cast(array() AS {kind}))")
    return df.withColumns(found).withColumns(lengths).withColumns(sums).withColumns(places).drop(*found, *lengths, *sums)


def tagged(names: dict[str, int]) -> Column:
    """One array of (s, k, e) over span columns, k the number given to each, in order of s and k."""
    parts = [F.expr(f"transform({c}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))") for c, k in names.items()]
    return F.array_sort(F.concat(*parts))


def counted(spans: str, kinds: list[str]) -> list[Column]:
    """n_<kind>: how many of an array of (s, k, e) are of each kind."""
    return [F.expr(f"cast(size(filter({spans}, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(kinds)]


def listed(spans: str, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined, of an array of (s, k, e)."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
