"""The same expressions as DuckDB SQL, from which the queries' checks are built."""

from __future__ import annotations

from folio.functions import text as t


def q(value: str) -> str:
    """A literal; patterns lose Java's flag for Unicode case, which is the rule there."""
    return "'" + value.replace("'", "''").replace("(?iu)", "(?i)") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(t.SPACE + '+')}, ' ', 'g'))"


def trim_all(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{t.SPACE}+|{t.SPACE}+$')}, '', 'g')"


def clean_text(x: str) -> str:
    out = f"regexp_replace(replace(coalesce({x}, ''), chr(173), ''), {q(f'([{t.LETTER}])-' + chr(92) + 'n' + f'([{t.LETTER}])')}, '\\1\\2', 'g')"
    for pattern, by in ((r"[ \t]+\n", "chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)")):
        out = f"regexp_replace({out}, {q(pattern)}, {by}, 'g')"
    return trim_all(out)


def clean_block(x: str) -> str:
    out = f"replace(coalesce({x}, ''), chr(173), '')"
    for pattern, by in ((r"[ \t]+", "' '"), (r"\n{3,}", "chr(10) || chr(10)")):
        out = f"regexp_replace({out}, {q(pattern)}, {by}, 'g')"
    return trim_all(out)


def sentences(x: str, least: int = 1) -> str:
    found = f"regexp_extract_all({norm(x)}, {q(t.SENTENCE)})"
    whole = f"CASE WHEN len({found}) > 0 THEN {found} WHEN {norm(x)} <> '' THEN [{norm(x)}] ELSE [] END"
    return f"list_filter(list_transform({whole}, lambda s: trim(s)), lambda s: length(s) >= {least})"


def raw_words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({norm(x)}), {q(t.NOT_WORD)}, ' ', 'g'), ' '), lambda w: w <> '')"


def in_list(x: str, words) -> str:
    return f"{x} IN ({', '.join(map(q, words))})"


def any_of(x: str, words) -> str:
    return f"regexp_matches({x}, {q(t.any_of(words))})"


def anchors(x: str, most: int = 32) -> str:
    each = " || ".join(f"regexp_extract_all(coalesce({x}, ''), {q(p)})" for p in t.ANCHORS)
    found = f"list_filter(list_transform({each}, lambda v: {norm('v')}), lambda v: length(v) > 1)"
    return f"list_filter({found}, lambda v, i: list_position({found}, v) = i)[1:{most}]"


def unique_ci(values: str, most: int) -> str:
    clean = f"list_filter(list_transform({values}, lambda v: {norm('v')}), lambda v: v <> '')"
    return f"list_filter({clean}, lambda v, i: list_position(list_transform({clean}, lambda u: lower(u)), lower(v)) = i)[1:{most}]"


def accessible(x: str, connectives) -> str:
    pattern = r"(?i) *, *(" + "|".join(connectives) + ") +"
    spoken = f"list_transform({sentences(x)}, lambda s: {norm(f'regexp_replace(regexp_replace(s, {q(" *; *")}, {q(". ")}, {q("g")}), {q(pattern)}, {q(". " + chr(92) + "1 ")}, {q("g")})')})"
    return f"array_to_string(list_filter({spoken}, lambda s: s <> ''), chr(10) || chr(10))"
