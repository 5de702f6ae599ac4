"""Porter's stemmer (1980) as SQL expressions, one select for each step.

The expressions are SQL that Spark and other engines read alike but for the name of the function that
matches a regular expression. Words of one or two letters stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_CONSONANT, _VOWEL = "[^aeiou]", "[aeiouy]"
_C, _V = f"{_CONSONANT}[^aeiouy]*", f"{_VOWEL}[aeiou]*"
#: Patterns of a stem: some vowel; at least one, exactly one, at least two vowel-consonant
#: sequences; and consonants, a vowel and a consonant other than w, x and y.
_HAS_VOWEL = f"^({_C})?{_VOWEL}"
_ONE_OR_MORE = f"^({_C})?{_V}{_C}"
_ONE = f"^({_C})?{_V}{_C}({_V})?$"
_TWO_OR_MORE = f"^({_C})?{_V}{_C}{_V}{_C}"
_SHORT = f"^{_C}{_VOWEL}[^aeiouwxy]$"

#: The suffixes of steps 2, 3 and 4 with what takes their place, longest first.
STEP_2 = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "tional": "tion", "biliti": "ble", "entli": "ent", "ousli": "ous", "ation": "ate",
    "alism": "al", "aliti": "al", "iviti": "ive", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "ator": "ate", "eli": "e",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "sion", "tion", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _cut(n: int, more: str = "") -> str:
    stem = f"substr(w, 1, length(w) - {n})"
    return f"concat({stem}, '{more}')" if more else stem


def _suffixes(table: dict[str, str], pattern: str, match: str) -> str:
    cases = [f"WHEN w LIKE '%{s}' THEN CASE WHEN {match}({_cut(len(s))}, '{pattern}') THEN {_cut(len(s), to)} ELSE w END" for s, to in table.items()]
    return f"CASE {' '.join(cases)} ELSE w END"


def steps(match: str) -> list[str]:
    """The expressions of the steps over a word ``w``. ``#`` stands where step 1b took a suffix."""
    last, before = "substr(w, length(w) - 1, 1)", "substr(w, length(w) - 2, 1)"
    ions = {s: s[0] if s in ("sion", "tion") else "" for s in STEP_4}
    return [
        "CASE WHEN w LIKE 'y%' THEN concat('Y', substr(w, 2)) ELSE w END",
        f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_cut(2)} WHEN w LIKE '%s' AND NOT w LIKE '%ss' THEN {_cut(1)} ELSE w END",
        f"""CASE WHEN w LIKE '%eed' THEN CASE WHEN {match}({_cut(3)}, '{_ONE_OR_MORE}') THEN {_cut(1)} ELSE w END
             WHEN w LIKE '%ed' AND {match}({_cut(2)}, '{_HAS_VOWEL}') THEN {_cut(2, '#')}
             WHEN w LIKE '%ing' AND {match}({_cut(3)}, '{_HAS_VOWEL}') THEN {_cut(3, '#')} ELSE w END""",
        f"""CASE WHEN NOT w LIKE '%#' THEN w WHEN w LIKE '%at#' OR w LIKE '%bl#' OR w LIKE '%iz#' THEN {_cut(1, 'e')}
             WHEN {last} = {before} AND {match}(w, '[^aeiouylsz]#$') THEN {_cut(2)}
             WHEN {match}({_cut(1)}, '{_SHORT}') THEN {_cut(1, 'e')} ELSE {_cut(1)} END""",
        f"CASE WHEN w LIKE '%y' AND {match}({_cut(1)}, '{_HAS_VOWEL}') THEN {_cut(1, 'i')} ELSE w END",
        _suffixes(STEP_2, _ONE_OR_MORE, match),
        _suffixes(STEP_3, _ONE_OR_MORE, match),
        # what stands before -ion belongs to the stem
        "CASE " + " ".join(f"WHEN w LIKE '%{s}' THEN CASE WHEN {match}({_cut(len(s) - len(ions[s]))}, '{_TWO_OR_MORE}') THEN {_cut(len(s), ions[s])} ELSE w END" for s in STEP_4) + " ELSE w END",
        f"""CASE WHEN w LIKE '%e' AND ({match}({_cut(1)}, '{_TWO_OR_MORE}') OR {match}({_cut(1)}, '{_ONE}') AND NOT {match}({_cut(1)}, '{_SHORT}')) THEN {_cut(1)} ELSE w END""",
        f"CASE WHEN w LIKE '%ll' AND {match}(w, '{_TWO_OR_MORE}') THEN {_cut(1)} ELSE w END",
        "lower(w)",
    ]


def stem(words: DataFrame, column: str, out: str = "stem") -> DataFrame:
    """words with the stem of a column of lower-case words. Meant for tables of distinct words."""
    rows = words.selectExpr("*", f"`{column}` AS w")
    for step in steps("regexp_like"):
        rows = rows.selectExpr(*[f"`{c}`" for c in words.columns], f"CASE WHEN length(`{column}`) <= 2 THEN w ELSE {step} END AS w")
    return rows.withColumnRenamed("w", out)


def stem_sql(table: str, column: str, match: str = "regexp_matches") -> str:
    """The same as common table expressions that end in one named ``stems`` (column, w), for the SQL side."""
    out, source = [f"stem0 AS (SELECT DISTINCT {column}, {column} AS w FROM {table})"], "stem0"
    for i, step in enumerate(steps(match), 1):
        out.append(f"stem{i} AS (SELECT {column}, CASE WHEN length({column}) <= 2 THEN w ELSE {step} END AS w FROM {source})")
        source = f"stem{i}"
    return ",\n".join([*out, f"stems AS (SELECT * FROM {source})"])
