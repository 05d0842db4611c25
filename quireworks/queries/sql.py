"""Pieces that the DuckDB statements share."""

from __future__ import annotations

#: White space as in functions.patterns, for RE2.
S = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NS = S.replace("[", "[^", 1)
NL = "chr(10)"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{S}+|{S}+\z', '', 'g')"


def collapse(x: str, to: str = " ") -> str:
    return f"regexp_replace({x}, '{S}+', '{to}', 'g')"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{S}+'), lambda w: w <> ''))::BIGINT"


def preview(x: str) -> str:
    flat = trim(collapse(x))
    return f"CASE WHEN length({flat}) > 80 THEN left({flat}, 80) || '…' ELSE {flat} END"


ITEM = rf"^[0-9]+[.)]{S}+(.*)\z"
BULLET = rf"^[-*]{S}+(.*)\z"
HEADING = rf"^(#{{1,6}}){S}+(.*)\z"
CELLS = r"list_transform(string_split(regexp_replace(regexp_replace({0}, '^\|', ''), '\|\z', ''), '|'), lambda c: " + trim("c") + ")"

#: Blocks of the Markdown files mf.
BLOCKS = rf"""bc AS (SELECT file_id, list_filter(list_transform(regexp_split_to_array(text, '\n{S}*\n+'), lambda c: {trim("c")}), lambda c: c <> '') AS cs FROM mf),
bl AS (SELECT file_id, i - 1 AS block_no, list_transform(string_split(cs[i], chr(10)), lambda l: {trim("l")}) AS ls FROM (SELECT file_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM bc)),
bk AS (
  SELECT *, CASE WHEN len(ls) = 1 AND regexp_matches(ls[1], '{HEADING}') THEN 'heading'
    WHEN len(list_filter(ls, lambda l: NOT starts_with(l, '|'))) = 0 THEN 'table'
    WHEN len(list_filter(ls, lambda l: NOT regexp_matches(l, '{ITEM}'))) = 0 THEN 'ordered'
    WHEN len(list_filter(ls, lambda l: NOT regexp_matches(l, '{BULLET}'))) = 0 THEN 'unordered'
    WHEN len(list_filter(ls, lambda l: NOT starts_with(l, '>'))) = 0 THEN 'blockquote' ELSE 'paragraph' END AS k FROM bl),
bi AS (
  SELECT *, CASE k WHEN 'ordered' THEN list_transform(ls, lambda l: {trim(f"regexp_extract(l, '{ITEM}', 1)")}) WHEN 'unordered' THEN list_transform(ls, lambda l: {trim(f"regexp_extract(l, '{BULLET}', 1)")}) END AS items,
    CASE WHEN k = 'table' THEN {CELLS.replace("{0}", "ls[1]")} END AS header FROM bk),
b AS (
  SELECT file_id, block_no, CASE WHEN items IS NOT NULL THEN 'list' ELSE k END AS kind, CASE WHEN k = 'heading' THEN length(regexp_extract(ls[1], '{HEADING}', 1)) END AS level,
    CASE WHEN items IS NOT NULL THEN k = 'ordered' END AS ordered, items, header, CASE WHEN k = 'table' THEN greatest(len(ls) - 2, 0) END AS n_rows,
    CASE WHEN k = 'heading' THEN {trim(f"regexp_extract(ls[1], '{HEADING}', 2)")} WHEN k = 'table' THEN array_to_string(header, ' ') WHEN items IS NOT NULL THEN array_to_string(items, ' ')
      WHEN k = 'blockquote' THEN {trim(f"array_to_string(list_transform(ls, lambda l: regexp_replace(l, '^>{S}?', '')), ' ')")} ELSE array_to_string(ls, ' ') END AS text FROM bi)"""
