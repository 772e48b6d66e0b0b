"""DuckDB SQL that finds, resolves and masks spans, for checking the Spark plans.

DuckDB's expressions know word boundaries in ASCII only, so the SQL scans a copy of the
text in which other letters are ``_`` and other signs ``~``, place by place, and takes
the matches' texts from the original.
"""

from __future__ import annotations

from veilwork.functions.names import AMBIGUOUS, DEFAULT_NAMES, NO_SURNAME
from veilwork.functions.patterns import CATEGORIES, TOKEN

LETTERS = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}]"
MARK = "chr(57344)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def name_patterns() -> list[tuple[str, str]]:
    """``(pattern, condition)`` of the dictionary patterns."""
    every = "|".join(sorted(DEFAULT_NAMES, key=len, reverse=True))
    alone = sorted(set(DEFAULT_NAMES) - set(AMBIGUOUS), key=len, reverse=True)
    single = "|".join(v for n in alone for v in (n.capitalize(), n.upper()))
    no = ", ".join(map(quoted, NO_SURNAME))
    return [
        (rf"\b(?i:{every})\s+(?:[A-Z]\.\s+)?[A-Z][a-z]{{1,20}}\b", "true"),
        (rf"\b[A-Z][a-z]{{1,20}},\s*(?i:{every})(?:\s+[A-Z]\.?)?\b", f"split_part(part, ',', 1) not in ({no})"),
        (rf"\b(?:{single})\b", "true"),
    ]


def patterns(categories: list[str]) -> list[tuple[str, str, str]]:
    out = []
    for key in categories:
        cat = CATEGORIES[key]
        digit = r"regexp_matches(part, '\d')" if cat.needs_digit else "true"
        out += [(key, p, digit) for p in cat.patterns]
        if key == "names":
            out += [(key, p, cond) for p, cond in name_patterns()]
    return out


def spans(source: str, categories: list[str], custom: list[tuple[str, str]] = ()) -> str:
    """CTEs up to ``m(key, seq, category, s, e)``: all hits; ``t(key, text, plain)``: the texts.

    ``custom``: further (category, pattern).
    """
    found = [*patterns(categories), *((c, p, "true") for c, p in custom)]
    parts = " union all ".join(
        f"select key, {i} as seq, {quoted(c)} as category, "
        f"string_split(regexp_replace(plain, {quoted(p)}, {MARK} || '\\0' || {MARK}, 'g'), {MARK}) as parts, {quoted(cond)} as rule "
        f"from t where regexp_matches(plain, {quoted(p)})"
        for i, (c, p, cond) in enumerate(found)
    )
    rules = " ".join(f"when {i} then {cond}" for i, (_, _, cond) in enumerate(found))
    return f"""
with t as (
  select key, text, regexp_replace(regexp_replace(replace(text, chr(160), ' '), '{LETTERS}', '_', 'g'), '[^\\x00-\\x7F]', '~', 'g') as plain
  from ({source})),
p as (select key, seq, category, unnest(parts) as part, generate_subscripts(parts, 1) as pos from ({parts})),
o as (
  select *, cast(coalesce(sum(length(part)) over (partition by key, seq order by pos rows between unbounded preceding and 1 preceding), 0) as int) as s
  from p),
m as (
  select key, seq, category, s, cast(s + length(part) as int) as e from o
  where pos % 2 = 0 and length(part) > 0 and case seq {rules} end)"""


def resolved(source: str, categories: list[str], custom: list[tuple[str, str]] = ()) -> str:
    """CTEs up to ``r(key, s, e, category)``: hits after the fold, state by state."""
    return (
        spans(source, categories, custom).replace("with t as", "with recursive t as", 1)
        + """,
n as (select *, row_number() over (partition by key order by s, s - e, seq) as k from m),
f as (
  select key, k, s, e, category from n where k = 1
  union all
  select n.key, n.k,
         case when n.s < f.e and n.e - n.s <= f.e - f.s then f.s else n.s end,
         case when n.s < f.e and n.e - n.s <= f.e - f.s then f.e else n.e end,
         case when n.s < f.e and n.e - n.s <= f.e - f.s then f.category else n.category end
  from f join n on n.key = f.key and n.k = f.k + 1),
r as (select f.key, f.s, f.e, f.category from f left join n on n.key = f.key and n.k = f.k + 1 where n.key is null or n.s >= f.e)"""
    )


def masked(cte: str, table: str = "r", token: str = TOKEN) -> str:
    """``(key, masked)`` of every text, from the spans in ``table``; touching spans share a token."""
    return f"""{cte},
g as (
  select {table}.key, s, e, text,
         coalesce(lag(e) over (partition by {table}.key order by s), 0) as before, row_number() over (partition by {table}.key order by s) as no
  from {table} join t on t.key = {table}.key),
h as (
  select key, string_agg(substring(text, before + 1, s - before) || case when no > 1 and s = before then '' else {quoted(token)} end, '' order by s) as head,
         max(e) as e from g group by key)
select t.key, case when h.key is null then text else head || substring(text, e + 1) end as masked
from t left join h on h.key = t.key"""
