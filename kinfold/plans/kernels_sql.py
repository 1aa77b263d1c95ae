"""The string kernels as DuckDB expressions, written from their definitions: a longest common subsequence is counted with
one integer as a row of bits, so the shorter side may have up to 120 letters."""

from __future__ import annotations


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two expressions; ``b`` gives the bits."""
    mask = f"coalesce(list_sum(list_transform(range(length({b})), lambda j: CASE WHEN substr({b}, CAST(j + 1 AS INTEGER), 1) = c THEN 1::HUGEINT << CAST(j AS INTEGER) ELSE 0::HUGEINT END)), 0)::HUGEINT"
    full = f"((1::HUGEINT << CAST(length({b}) AS INTEGER)) - 1)"
    step = f"(((r + (r & {mask})) | (r - (r & {mask}))) & {full})"
    return f"(length({b}) - bit_count(list_reduce(string_split({a}, ''), lambda r, c: {step}, {full})))"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 200.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})) END)"


def words(a: str) -> str:
    return f"list_filter(string_split({a}, ' '), lambda w: w <> '')"


def joined(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


def token_sort(a: str, b: str) -> str:
    """Needs the sorted texts as columns: see :func:`measured`."""
    return ratio(a, b)


def windows(short: str, long: str) -> str:
    """Best ratio of ``short`` with its windows in ``long``, cut ones at both ends included."""
    lo, hi = f"greatest(0, e - length({short}))", f"least(length({long}), e)"
    window = f"substr({long}, CAST({lo} + 1 AS INTEGER), CAST({hi} - {lo} AS INTEGER))"
    return f"list_max(list_transform(range(1, length({short}) + length({long})), lambda e: 200.0::DOUBLE * {lcs(window, short)} / (length({short}) + {hi} - {lo})))"


def partial(a: str, b: str) -> str:
    one, two = f"CASE WHEN length({a}) <= length({b}) THEN {windows(a, b)} ELSE 0 END", f"CASE WHEN length({b}) <= length({a}) THEN {windows(b, a)} ELSE 0 END"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN CASE WHEN {a} = {b} THEN 100.0 ELSE 0.0 END ELSE greatest({one}, {two}) END)"


#: Columns that the token kernels need, from columns a and b.
PARTS = f"""a, b, {joined(words("a"))} AS sa, {joined(words("b"))} AS sb, list_distinct({words("a")}) AS xa, list_distinct({words("b")}) AS xb"""
SETS = f"""*, {joined("list_filter(xa, lambda w: list_contains(xb, w))")} AS base, {joined("list_filter(xa, lambda w: NOT list_contains(xb, w))")} AS la, {joined("list_filter(xb, lambda w: NOT list_contains(xa, w))")} AS lb"""
FULL = """*, CASE WHEN base = '' THEN la ELSE base || ' ' || la END AS fa, CASE WHEN base = '' THEN lb ELSE base || ' ' || lb END AS fb"""
_BASE = "200.0::DOUBLE * length(base) / (length(base) + length({f}))"
KERNELS = {
    "ratio": ratio("a", "b"),
    "token_sort": ratio("sa", "sb"),
    "token_set": f"(CASE WHEN len(xa) = 0 OR len(xb) = 0 THEN 0.0 WHEN base <> '' AND (la = '' OR lb = '') THEN 100.0 WHEN base = '' THEN {ratio('fa', 'fb')} ELSE greatest({ratio('fa', 'fb')}, {_BASE.format(f='fa')}, {_BASE.format(f='fb')}) END)",
    "partial": partial("a", "b"),
    "partial_token_set": f"(CASE WHEN len(xa) = 0 OR len(xb) = 0 THEN 0.0 WHEN base <> '' THEN 100.0 ELSE {partial('la', 'lb')} END)",
    "jaro_winkler": "(CASE WHEN a = b THEN 1.0 ELSE jaro_winkler_similarity(a, b) END)",
}


def measured(source: str, wanted: dict[str, str]) -> str:
    """A query for (a, b) and the wanted kernels (column name to kernel) of every distinct pair a, b of ``source``."""
    columns = ", ".join(f"{KERNELS[k]} AS {n}" for n, k in wanted.items())
    return f"SELECT a, b, {columns} FROM (SELECT {FULL} FROM (SELECT {SETS} FROM (SELECT {PARTS} FROM (SELECT DISTINCT a, b FROM {source}))))"
