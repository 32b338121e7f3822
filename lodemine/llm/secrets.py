"""Secret scans over a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query of trigrams is derived that every match must
satisfy. The index has a posting list of documents for each trigram that any query names, written to
the shared folder by trigram, so that only the lists that are asked for are read. Of each conjunction
the ``RAREST`` trigrams with the shortest lists are intersected (a document that holds all trigrams
holds these, so that nothing is lost), conjunctions of a rule are united. Only documents that a rule's
query admits are searched with its expression; a rule whose expression forces no trigram is run on all
documents. The admitted ids are broadcast while they are few, else joined by shuffle.

Spans count code points, end exclusive. A null text counts as empty, an empty text has no spans.
Postings are kept by doc_id: rows that share a doc_id (or have none) only widen each other's
candidates, each row is verified on its own text. Repeated rows give repeated rows, an empty table
gives none. Other columns stay as they are, but for one named secrets, which the result replaces, and
the names _key, _text and _may_*, which are used inside.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import drop_tables, materialize, read


@dataclass(frozen=True)
class Rule:
    """A match counts if its group (0: all of it) has at least min_length characters."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1
    base: bool = False


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # the runs of [0-9a-f]+ with 24 characters or more are the matches of this, being maximal
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

# A query is a set of conjunctions, each a frozenset of trigrams: any of them, all of its trigrams.
# {frozenset()} holds for every text.
Query = frozenset
ANY: Query = frozenset([frozenset()])
MOST_STRINGS, MOST_TERMS = 64, 64
#: Trigrams of a conjunction whose lists are intersected.
RAREST = 3
#: Up to so many admitted ids are broadcast.
BROADCAST_ROWS = 250_000


def _absorb(terms) -> Query:
    """Without conjunctions that another one implies."""
    out: list[frozenset] = []
    for t in sorted(set(terms), key=lambda t: (len(t), sorted(t))):
        if not any(o <= t for o in out):
            out.append(t)
    return frozenset(out)


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_TERMS:  # either alone is still mandatory
        return min(a, b, key=len)
    return _absorb(x | y for x in a for y in b)


def _strings(texts: frozenset) -> Query:
    return _absorb(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in texts)


def trigram_query(pattern: str) -> Query:
    """What trigrams, in lower case, a text must hold to match the pattern."""

    def walk(nodes) -> tuple[frozenset | None, Query]:
        """All strings that the nodes match (None: too many), and what a match requires."""
        run, need, exact = frozenset([""]), ANY, True

        def flush() -> None:
            nonlocal run, need, exact
            need, run, exact = _and(need, _strings(run)), frozenset([""]), False

        for op, arg in nodes:
            strings, inner = None, ANY
            if op is sre.LITERAL:
                strings = frozenset([chr(arg).lower()])
            elif op is sre.IN:
                strings = _class(arg)
            elif op is sre.SUBPATTERN:
                strings, inner = walk(arg[3])
            elif op is sre.BRANCH:
                parts = [walk(x) for x in arg[1]]
                if all(s is not None for s, _ in parts):
                    strings = frozenset().union(*(s for s, _ in parts))
                inner = _absorb(t for s, q in parts for t in (_and(q, _strings(s)) if s is not None else q))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                least, most, body = arg
                strings, inner = walk(body)
                one = _and(inner, _strings(strings)) if strings is not None else inner
                if strings is not None and most is not sre.MAXREPEAT and least == most and len(strings) ** most <= MOST_STRINGS:
                    all_of = frozenset([""])
                    for _ in range(most):
                        all_of = frozenset(a + b for a in all_of for b in strings)
                    strings = all_of
                elif strings is not None and (least, most) == (0, 1):
                    strings |= {""}
                elif strings is not None and least and len(run) * len(strings) <= MOST_STRINGS:
                    run = frozenset(a + b for a in run for b in strings)  # the first repetition
                    flush()
                    continue
                else:
                    strings, inner = None, one if least else ANY
            elif op is sre.AT:
                continue
            if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
                run = frozenset(a + b for a in run for b in strings)
            elif strings is not None and len(strings) <= MOST_STRINGS:
                flush()
                run = strings
            else:
                flush()
                need = _and(need, inner)
        if exact:
            return run, ANY
        return None, _and(need, _strings(run))

    strings, need = walk(sre_parser.parse(pattern))
    return _strings(strings) if strings is not None else need


def _class(items, most: int = 8) -> frozenset | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < most:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= most else None


def postings(docs: DataFrame, grams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index of the given trigrams, written by gram (its position in grams): the keys of
    the documents that hold it, each list dealt over a number of files."""
    low = docs.select(F.col(key).alias("key"), F.lower(text).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    files = min(max(docs.sparkSession.sparkContext.defaultParallelism, 8), 1024)
    lists = low.select("key", F.explode(held).alias("gram")).repartition("gram", F.pmod(F.xxhash64("key"), F.lit(files)))
    return materialize(lists, "postings", partition_by=["gram"])


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, and a boolean column for each rule with mandatory trigrams; only keys that some query
    admits. The shortest lists of each conjunction are intersected."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    grams = sorted({g for q in queries.values() for t in q for g in t})
    index = postings(docs, grams, key, text)
    length = dict.fromkeys(grams, 0) | {grams[r["gram"]]: r["count"] for r in index.groupBy("gram").count().collect()}
    asked = {kind: [sorted(sorted(t), key=length.__getitem__)[:RAREST] for t in sorted(q, key=sorted)] for kind, q in queries.items()}
    at = {g: i for i, g in enumerate(grams)}
    lists = index.filter(F.col("gram").isin(sorted({at[g] for q in asked.values() for t in q for g in t})))
    met = lists.groupBy("key").agg(F.collect_set("gram").alias("_grams"))

    def holds(q: list[list[str]]) -> Column:
        every = [F.forall(F.array(*[F.lit(at[g]) for g in t]), lambda g: F.array_contains("_grams", g)) for t in q]
        return F.exists(F.array(*every), lambda x: x)

    flags = met.select("key", *[holds(q).alias(f"_may_{kind}") for kind, q in asked.items()])
    out = materialize(flags.filter(" OR ".join(f"_may_{kind}" for kind in queries)), "secret-candidates")
    drop_tables(docs.sparkSession, index)
    return out


def _spans(text: str, rule: Rule, place: int) -> str:
    """SQL for the rule's spans as array<struct<start,place,end,kind>>. The text is split at the
    matches; a match starts where the pieces and matches before it end."""
    lit = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    made = f"""transform(array(named_struct(
        'm', transform(regexp_extract_all({text}, {lit}, 0), x -> length(x)),
        'v', transform(regexp_extract_all({text}, {lit}, {rule.group}), x -> length(x)),
        'p', transform(split({text}, {lit}, -1), x -> length(x)))),
      z -> aggregate(sequence(0, size(z.m) - 1),
        named_struct('at', 0, 'out', cast(array() AS array<struct<start:int,place:int,end:int,kind:string>>)),
        (acc, i) -> named_struct(
          'at', acc.at + z.p[i] + z.m[i],
          'out', if(z.v[i] >= {rule.min_length},
                    array_append(acc.out, named_struct('start', acc.at + z.p[i], 'place', {place}, 'end', acc.at + z.p[i] + z.m[i], 'kind', '{rule.kind}')),
                    acc.out)),
        acc -> acc.out))[0]"""
    return f"CASE WHEN {text} RLIKE {lit} THEN {made} ELSE cast(array() AS array<struct<start:int,place:int,end:int,kind:string>>) END"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``secrets``: array<struct<start,place,end,kind>> by start, then rule as listed."""
    may = candidates(docs, rules, key, text)
    flags = [c for c in may.columns if c != "key"]
    side = may.withColumnRenamed("key", "_key")
    side = F.broadcast(side) if may.count() <= BROADCAST_ROWS else side.hint("shuffle_hash")
    rows = docs.join(side, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    rows = rows.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    empty = "cast(array() AS array<struct<start:int,place:int,end:int,kind:string>>)"
    parts = []
    for place, rule in enumerate(rules):
        sql = _spans("_text", rule, place)
        parts.append(F.expr(f"CASE WHEN _may_{rule.kind} THEN {sql} ELSE {empty} END" if f"_may_{rule.kind}" in flags else sql))
    return rows.withColumn("secrets", F.sort_array(F.concat(*parts))).drop("_text", *flags)


def redact(scanned: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Puts the mask in place of each run of overlapping spans and drops ``secrets``. Texts without
    spans stay as they are, null ones too."""
    fold = f"""aggregate(secrets, named_struct('at', 0, 'out', ''),
        (acc, s) -> named_struct(
          'at', greatest(acc.at, s.end),
          'out', CASE WHEN s.start < acc.at THEN acc.out
                      ELSE concat(acc.out, substring({text}, acc.at + 1, s.start - acc.at), '{mask}') END),
        acc -> concat(acc.out, substring({text}, acc.at + 1)))"""
    return scanned.withColumn(text, F.expr(f"CASE WHEN size(secrets) > 0 THEN {fold} ELSE {text} END")).drop("secrets")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    joined = "concat_ws(',', transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(secrets, s -> s.kind = '{r.kind}')) AS bigint)").alias(f"n_{r.kind}") for r in RULES if r.base],
        F.sha2(F.expr(joined.format(f"filter(secrets, s -> s.kind IN ({base}))")), 256).alias("base_sha256"),
        F.expr(joined.format("secrets")).alias("spans"),
    )


def _oracle() -> str:
    """The same by plain regular expressions on every text, for DuckDB."""
    one = []
    for place, r in enumerate(RULES):
        lit = "'" + r.pattern.replace("'", "''") + "'"
        one.append(f"""
  SELECT doc_id, rid, {place} AS place, '{r.kind}' AS kind,
    list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS s,
    s + length(m[i]) AS e
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, rid, regexp_extract_all(t, {lit}, 0) AS m, regexp_extract_all(t, {lit}, {r.group}) AS v,
           string_split_regex(t, {lit}) AS p FROM d))
  WHERE length(v[i]) >= {r.min_length}""")
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(one)})
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)},
  sha256(coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place), '') AS spans
FROM d LEFT JOIN f USING (rid) GROUP BY d.rid, d.doc_id
"""


OP3_SQL = _oracle()
