"""SQL twins of the operators: the same results said in SQL over the raw tables."""

from __future__ import annotations

from typing import NamedTuple

from ..functions.text import LOWER, TOKEN, UPPER, py_lower
from ..lang.search import Phrase, phrases
from ..operators.score import phrase_brackets
from ..operators.search import window_of

NL = "chr(10)"


class Word(NamedTuple):
    """A token written out by hand: its word, kind of match, and from where to where it may stand after the one before."""

    word: str | None
    match: str
    lo: int = 0
    hi: int = 0


#: Phrases of some expressions in order, written out by hand: with these a row doesn't rest on the library's own reading.
BY_HAND = {
    "worthless moron": [(Word("worthless", "fuzzy"), Word("moron", "fuzzy", -50, 50))],
    "'idiot | 'clown | ^patheti": [(Word("clown", "exact"),), (Word("idiot", "exact"),), (Word("patheti", "prefix"),)],
    "('idiot | 'loser) (the | 'and)": [(Word(a, "exact"), Word(b, k, -50, 50)) for a in ("idiot", "loser") for b, k in (("and", "exact"), ("the", "fuzzy"))],
    "worthless~'the | 'scum": [(Word("scum", "exact"),), (Word("worthless", "fuzzy"), Word(None, "spaces", 1, 1), Word("the", "exact", -50, 50))],
}
#: Words kept for a first token of 1 to 7 bytes; of longer ones 500.
CANDIDATES = (2, 6, 15, 39, 97, 244, 500)


def phrases_of(expression: str) -> list:
    return BY_HAND.get(expression) or phrases(expression)


def _window(t) -> tuple[int, int]:
    return (t.lo, t.hi) if isinstance(t, Word) else window_of(t)


def _limit(word: str) -> int:
    return CANDIDATES[min(len(word.encode()), len(CANDIDATES)) - 1]


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ci(w: str) -> str:
    return f"translate({w}, '{UPPER}', '{LOWER}')"


BASE = f"""
doc AS (
  SELECT doc_id, '/corpus/' || source || '/' || lang || '/2024-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '-'
    || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || '_doc' || doc_id || '.' || ['txt', 'md', 'log'][1 + doc_id % 3] AS path,
    make_date(2024, 1 + doc_id % 12, 1 + doc_id % 28) AS path_date, doc_id % 3 = 2 AS single, coalesce(text, '') AS text
  FROM documents
),
ln AS (
  SELECT doc_id, unnest(ls) AS line_text, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line
  FROM (SELECT doc_id, CASE WHEN text = '' THEN [''] WHEN suffix(text, {NL}) THEN string_split(text, {NL})[:-2] ELSE string_split(text, {NL}) END AS ls FROM doc)
),
tk AS (
  SELECT doc_id, line, CASE WHEN line_text = '' THEN [''] ELSE regexp_extract_all(regexp_replace(line_text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '{TOKEN}') END AS ts FROM ln
),
positions AS MATERIALIZED (
  SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, i) - 1 AS INTEGER) AS pos, word
  FROM (SELECT doc_id, line, unnest(ts) AS word, generate_subscripts(ts, 1) AS i FROM tk)
),
words AS MATERIALIZED (SELECT word, {ci("word")} AS word_ci, strlen(word) AS word_len FROM (SELECT DISTINCT word FROM positions))
"""


def with_base(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *ctes]) + "\n" + body


def matches(kind: str, s: str, w: str = "word", wci: str = "word_ci", edits: int = 2) -> str:
    if kind == "spaces":
        return f"starts_with({w}, ' ')"
    low = py_lower(s)
    if kind == "fuzzy":
        fit = f"contains({wci}, {quote(low)}) OR (strlen({w}) >= 2 AND contains({quote(low)}, {wci}))"
        if len(s.encode()) > edits:
            fit += f" OR (strlen({w}) > {edits} AND contains(substr({wci}, 1, 3), {quote(low[:1])}) AND levenshtein({quote(s)}, {wci}) <= {edits})"
    else:
        side, own = (wci, quote(low)) if s == low else (w, quote(s))
        fit = {"exact": f"{side} = {own}", "prefix": f"starts_with({side}, {own})", "suffix": f"suffix({side}, {own})"}[kind]
    return f"({w} <> '' AND CASE WHEN unicode({w}) < 128 THEN ({fit}) ELSE {w} = {quote(s)} END)"


def candidates(phrase: Phrase) -> str:
    t = phrase[0]
    if t.word is None:
        return "SELECT word, 1.0 AS cscore FROM words WHERE starts_with(word, ' ')"
    s, low, n = quote(t.word), quote(py_lower(t.word)), float(len(t.word.encode()))
    value = (
        f"CASE WHEN word = {s} THEN 1.0 WHEN word_ci = {low} THEN 0.9 WHEN contains(word, {s}) THEN CAST({n} AS DOUBLE) / word_len "
        f"WHEN contains(word_ci, {low}) THEN CAST(0.9 * {n} AS DOUBLE) / word_len ELSE 1 - CAST(levenshtein({low}, word_ci) AS DOUBLE) / {n} END"
    )
    return f"SELECT word, CAST({value} AS DOUBLE) AS cscore FROM words WHERE {matches(t.match, t.word)} ORDER BY round(cscore, 9) DESC, word LIMIT {_limit(t.word)}"


def combinations(phrase: Phrase, scope: str = "", by_line: bool = True) -> str:
    """doc_id, n_starts, pos0, word0, ... as one SELECT."""
    cols = ", ".join(f"p{i}.pos AS pos{i}, p{i}.word AS word{i}" for i in range(len(phrase)))
    out = f"""SELECT p0.doc_id, p0.n_starts, p0.line, {cols}
      FROM (SELECT positions.*, doc.single, count(*) OVER (PARTITION BY doc_id) AS n_starts FROM positions JOIN doc USING (doc_id)
        WHERE word IN (SELECT word FROM ({candidates(phrase)})) {scope}) p0"""
    for i, t in enumerate(phrase[1:], 1):
        lo, hi = _window(t)
        line = f" AND (NOT p0.single OR p{i}.line = p0.line)" if by_line else ""
        inner = f"SELECT positions.* FROM positions JOIN words USING (word) WHERE {matches(t.match, t.word or '')}"
        out += f"\n      JOIN ({inner}) p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos BETWEEN p{i - 1}.pos + ({lo}) AND p{i - 1}.pos + ({hi}){line}"
    return out


def score(phrase: Phrase, brackets: str = "0") -> str:
    n = len(phrase)
    sums: dict[str, list[str]] = {k: [] for k in ("s", "f", "exact", "ci_exact", "sf", "fs", "ci_sf", "ci_fs", "edits", "fuzzy_s", "fuzzy_f")}
    for i, t in enumerate(phrase):
        if t.word is None:
            for k in ("s", "f", "exact"):
                sums[k].append("1")
            continue
        w, wci, s, low, ls, lf = f"word{i}", ci(f"word{i}"), quote(t.word), quote(py_lower(t.word)), float(len(t.word.encode())), f"strlen(word{i})"
        kind = (
            f"CASE WHEN {w} = {s} THEN 'exact' WHEN {wci} = {low} THEN 'ci_exact' WHEN contains({w}, {s}) THEN 'sf' WHEN contains({s}, {w}) THEN 'fs' "
            f"WHEN contains({wci}, {low}) THEN 'ci_sf' WHEN contains({low}, {wci}) THEN 'ci_fs' ELSE 'edits' END"
        )
        for k, v in {"exact": lf, "ci_exact": lf, "sf": ls, "fs": lf, "ci_sf": ls, "ci_fs": lf, "edits": f"levenshtein({low}, {wci})"}.items():
            sums[k].append(f"CASE WHEN {kind} = '{k}' THEN {v} ELSE 0 END")
        sums["fuzzy_s"].append(f"CASE WHEN {kind} = 'edits' THEN {ls} ELSE 0 END")
        sums["fuzzy_f"].append(f"CASE WHEN {kind} = 'edits' THEN {lf} ELSE 0 END")
        sums["s"].append(str(ls))
        sums["f"].append(lf)
    v = {k: "CAST(" + (" + ".join(x) or "0") + " AS DOUBLE)" for k, x in sums.items()}
    ratio = lambda a, b: f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)"
    total = f"({v['s']} + {v['f']})"
    distinct = f"len(list_distinct([{', '.join(f'pos{i}' for i in range(n))}]))"
    dist = " + ".join(f"abs(pos{i} - pos{i - 1})" for i in range(1, n)) or "0"
    back = " + ".join(f"CASE WHEN pos{i} < pos{i - 1} THEN 1 ELSE 0 END" for i in range(1, n)) or "0"
    mean = f"(CASE WHEN {distinct} = 1 THEN 0.0 ELSE CAST({dist} AS DOUBLE) / greatest({distinct} - 1, 1) END)"
    near = f"(CASE WHEN {mean} <= 1 THEN 1.0 ELSE 1 - CAST(0.20 AS DOUBLE) * {mean} / 50 END)"
    case = "CAST(1.10 AS DOUBLE)" if any(t.word and t.word != py_lower(t.word) for t in phrase) else "CAST(1 AS DOUBLE)"
    parts = (
        f"{case} * 2 * {ratio(v['exact'], total)} + 2 * {ratio(v['ci_exact'], total)} + {case} * {ratio(v['sf'], v['f'])} + {case} * CAST(0.8 AS DOUBLE) * {ratio(v['fs'], v['s'])}"
        f" + {ratio(v['ci_sf'], v['f'])} + CAST(0.8 AS DOUBLE) * {ratio(v['ci_fs'], v['s'])}"
        f" + CASE WHEN {v['fuzzy_s']} > 0 THEN 2 * {ratio(v['fuzzy_f'], total)} * (1 - {ratio(v['edits'], v['fuzzy_s'])}) ELSE 0.0 END"
    )
    d = "CAST({} AS DOUBLE)".format
    return f"(1 + {d('0.1')} * {n}) * (1 + {d('0.1')} * {distinct} / {n}) * (1 - {d('0.1')} * ({back}) / {n}) * (1 + {d('0.1')} * ({brackets})) * {near} * ({parts})"


#: Matching brackets: an opening one and the next one at its depth, if that closes.
BRACKETS = """
marks AS (
  SELECT doc_id, pos, CASE WHEN word IN ('(', ')') THEN '(' WHEN word IN ('[', ']') THEN '[' ELSE '{' END AS kind, word IN ('(', '[', '{') AS opens
  FROM positions WHERE word IN ('(', ')', '[', ']', '{', '}')
),
levels AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id, kind ORDER BY pos) + CASE WHEN opens THEN 0 ELSE 1 END AS depth FROM marks),
brackets AS (
  SELECT doc_id, pos AS open_pos, close_pos
  FROM (SELECT *, lead(pos) OVER w AS close_pos, lead(opens) OVER w AS next_opens FROM levels WINDOW w AS (PARTITION BY doc_id, kind, depth ORDER BY pos))
  WHERE opens AND NOT next_opens
)
"""


def phrase_results(phrase: Phrase, phrase_id: int, scope: str = "") -> str:
    """doc_id, phrase_id, score, positions (array), words (array) of a phrase's kept matches."""
    n = range(len(phrase))
    pairs = " + ".join(f"(SELECT count(*) FROM brackets b WHERE b.doc_id = c.doc_id AND b.open_pos = pos{a} AND b.close_pos = pos{b})" for a, b in phrase_brackets(phrase)) or "0"
    order = ", ".join(f"pos{i}, word{i}" for i in n)
    return f"""SELECT doc_id, {phrase_id} AS phrase_id, score, [{', '.join(f'pos{i}' for i in n)}] AS spots, pos0
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos0 ORDER BY round(score, 6) DESC, {order}) AS nth
        FROM (SELECT c.*, {score(phrase, pairs)} AS score FROM ({combinations(phrase, scope)}) c))
      WHERE nth <= greatest(5, ceil(CAST(50 AS DOUBLE) / n_starts))"""


def results_cte(expression: str, scope: str = "", name: str = "results") -> str:
    parts = [phrase_results(p, i, scope) for i, p in enumerate(phrases_of(expression)) if p]
    pre = BRACKETS.strip() + ",\n" if any(phrase_brackets(p) for p in phrases_of(expression)) else ""
    return pre + f"{name} AS MATERIALIZED (" + "\n    UNION ALL ".join(parts) + ")"


RANKED = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, pos0, spots, phrase_id) AS rank FROM results"


def exists_cte(expression: str, name: str = "hits") -> str:
    parts = [f"SELECT doc_id FROM ({combinations(p, by_line=False)})" for p in phrases_of(expression) if p]
    return f"{name} AS MATERIALIZED (" + " UNION ".join(parts) + ")"
