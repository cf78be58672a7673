"""SQL forms of the name-key functions, for the DuckDB twins."""

from __future__ import annotations

from ..functions import names


def alnum(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def translit(x: str) -> str:
    key = alnum(x)
    for old, new in names.SUBSTITUTIONS:
        key = f"replace({key}, '{old}', '{new}')"
    return f"regexp_replace(regexp_replace({key}, 'us$', 'os'), 'um$', 'on')"


def translit_keys(variants: str) -> str:
    keys = f"list_filter(list_transform({variants}, lambda v: {translit('v')}), lambda k: k <> '')"
    return f"list_distinct({keys} || list_transform(list_filter({keys}, lambda k: k LIKE '%ai'), lambda k: left(k, len(k) - 1)))"


def variants(col: str, parenthetical: bool, container: bool, head: bool) -> str:
    """Distinct normalised variants of a name column."""
    generic = "(" + ", ".join(f"'{w}'" for w in names.GENERIC_WORDS) + ")"
    text = f"trim(regexp_replace({col}, '^[^\\p{{L}}\\p{{N}}_]+', ''))"
    bare = f"trim(regexp_replace({text}, '\\s*\\([^)]*\\)', '', 'g'))"
    inner = f"list_transform(regexp_extract_all({text}, '\\(([^)]*)\\)', 1), lambda p: trim(p))"
    alias = "(?i)^(?:alt\\.?|aka|also called)\\s+"
    if not parenthetical:
        inner = f"list_filter({inner}, lambda p: regexp_matches(p, '{alias}'))"
    parts = [f"[{text}, {bare}]", f"list_transform({inner}, lambda p: regexp_replace(p, '{alias}', ''))"]
    for b in (text, bare):
        for p in names.PREFIXES:
            parts.append(f"CASE WHEN starts_with(lower({b}), '{p}') THEN [substr({b}, {len(p) + 1})] ELSE [] END")
        if container:
            for w in ("at", "near", "of"):
                guard = f"contains(lower({b}), ' {w} ')"
                if w == "of":
                    guard += f" AND regexp_extract(lower(regexp_extract({b}, '(?i)^(.*?)\\s+of\\s+', 1)), '(\\S+)$', 1) IN {generic}"
                parts.append(f"CASE WHEN {guard} THEN [regexp_extract({b}, '(?i)^.*?\\s+{w}\\s+(.*)$', 1)] ELSE [] END")
        if head:
            ws = f"string_split_regex({b}, '\\s+')"
            parts.append(
                f"list_transform(list_filter(range(1, len({ws})), lambda k: len(list_filter({ws}[len({ws}) - k + 1:], lambda w: lower(w) NOT IN {generic})) = 0), "
                f"lambda k: array_to_string({ws}[1:len({ws}) - k], ' '))"
            )
    raw = " || ".join(parts)
    return f"list_distinct(list_filter(list_transform({raw}, lambda v: {alnum('v')}), lambda k: k <> '' AND k NOT IN {generic}))"
