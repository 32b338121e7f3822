"""Personal data in texts, in DataFrame operations only.

Regular expressions propose spans, a check confirms them (Luhn for cards, mod 97 for bank accounts,
ranges for addresses and numbers), and words nearby raise or lower a score in percent. Nearby is what
stands within ``NEAR`` code points of the span, as far as the next span proposed for the same kind.
Base kinds are kept whatever their score; the others from ``LEAST`` on, and only where no letter,
digit or hyphen touches them. Spans of different kinds may overlap.

A text is cut at the matches of an expression; a match starts where the pieces and matches before it
end. Starts are summed in chunks, so that a text with very many matches takes time in proportion.
Expressions are written so that none of them backtracks over a run: a run is entered at its first
character, or where the last match ended.

Spans count code points, end exclusive. A null text counts as empty, an empty text has no spans. Every
row is searched by itself: repeated rows give repeated rows, an empty table gives none. Other columns
stay, but for one named pii, which the result replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import read

NEAR = 40
LEAST = 50
RAISE = 30
#: From here on a span counts as sure.
SURE = 80
CHUNK = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Kind:
    """valid: SQL over the match m. admits: an expression without which no text can hold a match that
    passes. words, against: alternatives that raise and lower the score."""

    kind: str
    pattern: str
    admits: str
    valid: str
    prior: int
    words: str
    against: str = ""
    base: bool = False


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_MOD97 = """aggregate(split(concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4)), ''), 0,
    (r, c) -> CASE WHEN c = '' THEN r WHEN c BETWEEN '0' AND '9' THEN (10 * r + cast(c AS int)) % 97 ELSE (100 * r + ascii(c) - 55) % 97 END)"""

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 85, "e-?mail|mail|mailto|contact|kontakt|correo|courriel", "example|package|version", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", rf"m RLIKE '^{_PART}([.]{_PART}){{3}}$'", 60, "ip|ipv4|host|server|address|addr|client|login", "version|release|section|chapter|v", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", f"length({_DIGITS}) BETWEEN 14 AND 19 AND luhn_check({_DIGITS})", 65, "card|credit|debit|visa|mastercard|amex|payment|karte|tarjeta|carte", "order|invoice|isbn|serial|tracking", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "[+][0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15", 65, "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon", "order|invoice|score", True),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "[A-Z][A-Z][0-9][0-9]", f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97} = 1", 70, "iban|account|bank|bic|swift|konto|cuenta|compte"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]", "NOT m RLIKE '^(000|666|9..)|-00-|0000$'", 40, "ssn|social security"),
)


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPAN = "array<struct<start:int,place:int,end:int,kind:string,score:int>>"


def _sums(a: str) -> str:
    """SQL for the running sums of an array of whole numbers."""
    before = f"aggregate(slice({a}, 1, c * {CHUNK}), 0, (s, x) -> s + x)"
    chunk = f"aggregate(slice({a}, c * {CHUNK} + 1, {CHUNK}), array({before}), (acc, x) -> array_append(acc, element_at(acc, -1) + x))"
    return f"flatten(transform(sequence(0, (size({a}) - 1) div {CHUNK}), c -> slice({chunk}, 2, {CHUNK})))"


def _near(words: str) -> str:
    lit = _lit(f"(^|[^a-z])({words})([^a-z]|$)")
    return " OR ".join(f"translate({side}, '{UPPER}', '{LOWER}') RLIKE {lit}" for side in (f"right(y.p[i], {NEAR})", f"left(y.p[i + 1], {NEAR})"))


def _spans(text: str, k: Kind, place: int) -> str:
    """SQL for the kind's spans by start. Each ``transform(array(x), name -> ...)[0]`` names a value
    that is computed once."""
    score = f"{k.prior} + CASE WHEN {_near(k.words)} THEN {RAISE} ELSE 0 END"
    if k.against:
        score += f" - CASE WHEN {_near(k.against)} THEN {RAISE} ELSE 0 END"
    score = f"least(greatest({score}, 0), 100)"
    span = f"named_struct('start', y.at[i] - length(y.m[i]), 'place', {place}, 'end', y.at[i], 'kind', '{k.kind}', 'score', {score})"
    passes = "transform(array(y.m[i]), m -> {})[0]".format(k.valid)
    if not k.base:
        touches = _lit("[A-Za-z0-9-]")
        free = f"(i = 0 OR y.p[i] <> '') AND (i = size(y.m) - 1 OR y.p[i + 1] <> '') AND NOT right(y.p[i], 1) RLIKE {touches} AND NOT left(y.p[i + 1], 1) RLIKE {touches}"
        passes = f"{free} AND {passes}"
    checked = f"filter(sequence(0, size(y.m) - 1), i -> {passes})"
    lengths = "transform(z.m, (x, i) -> length(z.p[i]) + length(x))"
    placed = f"transform(transform(array({lengths}), a -> named_struct('m', z.m, 'p', z.p, 'at', {_sums('a')})), y -> transform({checked}, i -> {span}))[0]"
    found = f"transform(array(named_struct('m', regexp_extract_all({text}, {_lit(k.pattern)}, 0), 'p', split({text}, {_lit(k.pattern)}, -1))), z -> CASE WHEN size(z.m) > 0 THEN {placed} END)[0]"
    if not k.base:
        found = f"filter({found}, s -> s.score >= {LEAST})"
    empty = f"cast(array() AS {_SPAN})"
    return f"CASE WHEN {text} RLIKE {_lit(k.admits)} THEN coalesce({found}, {empty}) ELSE {empty} END"


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds ``pii``: array<struct<start,place,end,kind,score>> by start, then kind as listed."""
    col = f"coalesce(`{text}`, '')"
    return docs.withColumn("pii", F.sort_array(F.concat(*[F.expr(_spans(col, k, place)) for place, k in enumerate(kinds)])))


def redact(found: DataFrame, text: str = "text", least: int = 0) -> DataFrame:
    """Puts the name of its kind, in brackets, in place of each span with a score of ``least`` or more
    and drops ``pii``. Of spans that overlap the first gives the name. Texts without such spans stay as
    they are, null ones too."""
    fold = f"""aggregate(filter(pii, s -> s.score >= {least}), named_struct('at', 0, 'out', cast(array() AS array<string>)),
        (acc, s) -> named_struct(
          'at', greatest(acc.at, s.end),
          'out', CASE WHEN s.start < acc.at THEN acc.out
                      ELSE concat(acc.out, array(substring(`{text}`, acc.at + 1, s.start - acc.at), concat('[', upper(s.kind), ']'))) END),
        acc -> concat(array_join(acc.out, ''), substring(`{text}`, acc.at + 1)))"""
    return found.withColumn(text, F.expr(f"CASE WHEN size(pii) > 0 THEN {fold} ELSE `{text}` END")).drop("pii")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ", ".join(f"'{k.kind}'" for k in KINDS if k.base)
    joined = "concat_ws(',', transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    count = "cast(size(filter(pii, s -> {0})) AS bigint)"
    return found.select(
        "doc_id",
        *[F.expr(count.format(f"s.kind = '{k.kind}'")).alias(f"n_{k.kind}") for k in KINDS if k.base],
        F.sha2(F.expr(joined.format(f"filter(pii, s -> s.kind IN ({base}))")), 256).alias("base_sha256"),
        F.expr(joined.format("pii")).alias("spans"),
        F.expr(count.format(f"s.score >= {SURE}")).alias("n_sure"),
    )


#: What the expressions, checks and words mean, once more and plainly, for DuckDB.
_PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len([x for x in string_split(m, '.') if length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 4) AS INT) > 255]) = 0"),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        "length(d) BETWEEN 14 AND 19 AND list_sum([CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) WHEN CAST(d[i] AS INT) > 4 THEN 2 * CAST(d[i] AS INT) - 9 ELSE 2 * CAST(d[i] AS INT) END for i in range(1, length(d) + 1)]) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
    "iban": (
        r"[A-Z][A-Z][0-9][0-9](\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?",
        """length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce([CAST(x AS INT) for x in string_split('0' || array_to_string(
          [CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END for c in string_split(replace(m, ' ', '')[5:] || m[1:4], '')], ''), '')], lambda a, b: (10 * a + b) % 97) = 1""",
    ),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(m, '^(000|666|9..)|-00-|0000$')"),
}


def _oracle() -> str:
    one = []
    for place, k in enumerate(KINDS):
        pattern, valid = _PLAIN[k.kind]
        lit = "'" + pattern + "'"

        def near(words: str) -> str:
            return " OR ".join(f"regexp_matches(translate({side}, '{UPPER}', '{LOWER}'), '(^|[^a-z])({words})([^a-z]|$)')" for side in (f"right(b, {NEAR})", f"left(a, {NEAR})"))

        lowered = f"CASE WHEN {near(k.against)} THEN {RAISE} ELSE 0 END" if k.against else "0"
        free = "true" if k.base else "(i = 1 OR b <> '') AND (i = n OR a <> '') AND NOT regexp_matches(right(b, 1), '[A-Za-z0-9-]') AND NOT regexp_matches(left(a, 1), '[A-Za-z0-9-]')"
        one.append(f"""
  SELECT doc_id, rid, {place} AS place, '{k.kind}' AS kind, s, e, least(greatest({k.prior} + CASE WHEN {near(k.words)} THEN {RAISE} ELSE 0 END - {lowered}, 0), 100) AS score
  FROM (SELECT doc_id, rid, i, len(ms) AS n, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d, p[i] AS b, p[i + 1] AS a,
      list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS s, s + length(ms[i]) AS e
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, rid, regexp_extract_all(t, {lit}, 0) AS ms, string_split_regex(t, {lit}) AS p FROM d)))
  WHERE {free} AND {valid} {'' if k.base else f'AND score >= {LEAST}'}""")
    base = ", ".join(f"'{k.kind}'" for k in KINDS if k.base)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(one)})
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{k.kind}') AS n_{k.kind}" for k in KINDS if k.base)},
  sha256(coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place), '') AS spans,
  count(*) FILTER (score >= {SURE}) AS n_sure
FROM d LEFT JOIN f USING (rid) GROUP BY d.rid, d.doc_id
"""


OP13_SQL = _oracle()
