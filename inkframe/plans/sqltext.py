"""SQL of the constant tables, for the statements that the queries are compared with."""

from __future__ import annotations

from inkframe.sources.dims import BANK_PUNCT, DIGITS, GRIDS, KERNING, LOWER, MATCH_NGRAMS, PUNCT_NAMES, TEMPLATE_NGRAMS, UPPER


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else quote(x) if isinstance(x, str) else f"{x}" for x in row) + ")" for row in rows) + ")"


BANK = f"""bank AS (
  SELECT substr('{LOWER}', CAST(i AS INTEGER) + 1, 1) AS char, v AS variant, 25 + 3 * v + i % 5 AS w, 40 + 2 * v AS h, 19 + 3 * v + i % 5 AS ink_w, 34 + 2 * v AS ink_h FROM range(26) t(i), range(3) u(v)
  UNION ALL SELECT substr('{UPPER}', CAST(i AS INTEGER) + 1, 1), v, 35 + 3 * v, 55 + 2 * v, 29 + 3 * v, 49 + 2 * v FROM range(26) t(i), range(2) u(v)
  UNION ALL SELECT substr({quote(BANK_PUNCT)}, CAST(i AS INTEGER) + 1, 1), 0, 8, 15, 4, 9 FROM range({len(BANK_PUNCT)}) t(i))"""


def bank_with(ngrams: tuple[str, ...]) -> str:
    more = ", ".join(f"({quote(n)}, 0, {25 * len(n)}, 40, {25 * len(n) - 6}, 34)" for n in ngrams)
    return f"{BANK[:-1]}\n  UNION ALL SELECT * FROM (VALUES {more}))"


def bank_tokens(ngrams: tuple[str, ...]) -> str:
    """Tokens of texts that are set with a bank of these n-grams, the longest first."""
    first = "|".join(sorted(ngrams, key=lambda n: -len(n)))
    return f"list_transform(regexp_extract_all(coalesce(text, ''), '(?is)({first}|[^\\x20\\x09-\\x0D])', 1), lambda t: CASE WHEN length(t) > 1 THEN lower(t) ELSE t END)"


KEYS = "keys AS (SELECT char, count(*) AS k FROM bank GROUP BY char)"
SWAP = "CASE WHEN regexp_matches({0}, '^\\p{{Ll}}$') THEN upper({0}) ELSE lower({0}) END"
CATEGORY = "CASE WHEN length({0}) > 1 THEN 'bigrams' WHEN regexp_matches({0}, '^\\p{{Ll}}$') THEN 'lowercase' WHEN regexp_matches({0}, '^\\p{{Lu}}$') THEN 'uppercase' WHEN regexp_matches({0}, '^\\p{{Nd}}$') THEN 'digits' ELSE 'punctuation' END"
TOKENS = f"list_transform(regexp_extract_all(coalesce(text, ''), '(?is)({'|'.join(MATCH_NGRAMS)}|[^\\x20\\x09-\\x0D])', 1), lambda t: CASE WHEN length(t) > 1 THEN lower(t) ELSE t END)"
WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
CHARS = "list_filter(string_split(coalesce({0}, ''), ''), lambda c: c <> '')"
ALPHABET = "alphabet(char, class) AS " + values([(c, k) for k, cs in (("lowercase", LOWER), ("uppercase", UPPER), ("digits", DIGITS), ("punctuation", BANK_PUNCT)) for c in cs])
KERN = "kern(pair, factor) AS " + values([(k, f"{v}") for k, v in KERNING.items()]).replace("'0.7'", "0.7::DOUBLE").replace("'1.15'", "1.15::DOUBLE")


def cells_sql(ngrams: tuple[str, ...] = TEMPLATE_NGRAMS) -> str:
    """Cells by page: labels in reading order, each with its variants, up to the page's grid."""
    parts = {
        1: (list(LOWER[:15]), 4),
        2: (list(LOWER[15:]), 4),
        3: ([f"upper_{c}" for c in UPPER], 2),
    }
    pieces = []
    for page, (labels, k) in parts.items():
        pieces.append(f"SELECT {page} AS page, (i - 1) * {k} + v AS cell, labels[i] AS label, v AS variant FROM (SELECT [{', '.join(map(quote, labels))}] AS labels), range(1, {len(labels) + 1}) t(i), range({k}) u(v)")
    at = 0
    for labels, k in (([f"digit_{d}" for d in DIGITS], 3), (list(PUNCT_NAMES), 2), (list(ngrams), 1)):
        pieces.append(f"SELECT 4 AS page, {at} + (i - 1) * {k} + v AS cell, labels[i] AS label, v AS variant FROM (SELECT [{', '.join(map(quote, labels))}] AS labels), range(1, {len(labels) + 1}) t(i), range({k}) u(v)")
        at += len(labels) * k
    grids = values([(p, c, r) for p, (c, r) in GRIDS.items()])
    names = values(list(PUNCT_NAMES.items()))
    return f"""filled AS ({' UNION ALL '.join(pieces)}), grids(page, cols, rows) AS {grids}, punct(name, sign) AS {names},
cells AS (SELECT CAST(g.page AS BIGINT) AS page, CAST(c AS BIGINT) AS cell, CAST(c // g.cols AS BIGINT) AS "row", CAST(c % g.cols AS BIGINT) AS col, f.label, CAST(coalesce(f.variant, 0) AS BIGINT) AS variant,
  CASE WHEN f.label LIKE 'upper\\_%' ESCAPE '\\' OR f.label LIKE 'digit\\_%' ESCAPE '\\' THEN substr(f.label, 7) ELSE coalesce(p.sign, f.label) END AS display
  FROM grids g, range(88) t(c) LEFT JOIN filled f ON f.page = g.page AND f.cell = c LEFT JOIN punct p ON p.name = f.label WHERE c < g.cols * g.rows)"""
