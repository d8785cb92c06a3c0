"""Secret scans over a trigram inverted index, in DataFrame functions throughout.

From each rule's regular expression a Boolean query over trigrams is derived that every text with a match satisfies.
An index holds, for the trigrams that occur in queries, the documents that contain them; postings are intersected
and united as the queries say, and only candidates are searched with the expression itself.  A rule without
mandatory trigrams is searched for in all documents.

Positions come from what a split leaves between matches: running sums over the lengths of both.
"""

from __future__ import annotations

import re._constants as C
import re._parser as sre
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import attach, stored

EACH = 3  # trigrams asked for of each mandatory string; more cost an index entry each and shut out hardly any more
BLOCK = 256  # matches whose positions are summed in one fold


@dataclass(frozen=True)
class Rule:
    """``pattern`` means the same to Java and Python; with ``group``, that group has ``least`` letters or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# What counts as a secret.  The first three are the base kinds.  A run of hexadecimal digits or of an
# access key's letters is as long as it can be, so its least length may stand in the expression.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")

# A query: None (all documents), a trigram, or ("and" | "or", queries).
Query = None | str | tuple


def _all(parts: list[Query], word: str) -> Query:
    if word == "or" and None in parts:
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (word, tuple(parts))


def _spread(found: list[str]) -> list[str]:
    """At most ``EACH`` of the trigrams of one string, from its beginning to its end."""
    n = len(found)
    return found if n <= EACH else [found[i * (n - 1) // (EACH - 1)] for i in range(EACH)]


def _of_strings(strings: set[str]) -> Query:
    """The texts that hold one of ``strings``."""
    each = {s: {s[i : i + 3] for i in range(len(s) - 2)} for s in sorted(strings)}
    # what asks for more than another does adds nothing
    needed = [s for s, t in each.items() if not any(u < t or (u == t and r < s) for r, u in each.items())]
    return _all([_all(_spread([s[i : i + 3] for i in range(len(s) - 2)]), "and") for s in needed], "or")


def _walk(items, most: int = 64) -> tuple[set[str] | None, Query]:
    """(the strings that the items stand for exactly, or None; what any text with a match satisfies)."""
    strings: set[str] | None = {""}
    exact, found = True, []

    def cut():
        nonlocal strings, exact
        found.append(_of_strings(strings))
        strings, exact = {""}, False

    for op, value in items:
        some, also = None, None
        if op is C.LITERAL:
            some = {chr(value).lower()}
        elif op is C.IN:
            if all(o is C.LITERAL for o, _ in value):
                some = {chr(v).lower() for _, v in value}
        elif op is C.SUBPATTERN:
            some, also = _walk(value[3])
        elif op is C.BRANCH:
            branches = [_walk(b) for b in value[1]]
            if all(s is not None for s, _ in branches):
                some = set().union(*(s for s, _ in branches))
            also = _all([q for _, q in branches], "or")
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = value
            inner, query = _walk(sub)
            also = query if low else None
            if inner is not None and high == 1:
                some = inner | ({""} if not low else set())
        if some is not None and len(strings) * len(some) <= most:
            strings = {a + b for a in strings for b in some}
        else:
            cut()
            found.append(_of_strings(some) if some is not None else also)
    query = _all([*found, _of_strings(strings)], "and")
    return (strings if exact else None), query


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that a regular expression implies."""
    return _walk(sre.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    if query is None or isinstance(query, str):
        return {query} - {None}
    return set().union(*map(trigrams, query[1]))


def _holds(query: Query, present: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(present, query)
    join = Column.__and__ if query[0] == "and" else Column.__or__
    return reduce(join, (_holds(q, present) for q in query[1]))


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Inverted index (trigram, _doc) of ``docs`` (_doc, _text) for the trigrams asked for."""
    low = docs.select("_doc", F.lower("_text").alias("_low"))  # a step of its own: lowered once for all trigrams
    held = low.select("_doc", F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in wanted)).alias("_held"))
    return held.select("_doc", F.explode("_held").alias("trigram")).filter("trigram is not null")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(_doc, _rules): documents whose postings satisfy a query, and the kinds of those queries."""
    present = index.groupBy("_doc").agg(F.collect_set("trigram").alias("present"))
    kinds = F.array_compact(F.array(*(F.when(_holds(q, F.col("present")), F.lit(k)) for k, q in queries.items())))
    return present.select("_doc", kinds.alias("_rules")).filter(F.size("_rules") > 0)


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one.  Blocks keep the fold's growing array short."""

    def before(block):
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(block, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    # Each array stands in the expression once: inside a lambda it would be worked out again for every element.
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(lengths, i + 1, BLOCK))
    summed = F.transform(blocks, lambda b: F.struct(before(b).alias("inside"), F.size(b).alias("n")))
    starts = before(F.transform(summed, lambda x: F.element_at(x["inside"], -1)))
    both = F.arrays_zip(summed.alias("a"), starts.alias("s"))
    both = F.filter(both, lambda x: x["a"].isNotNull())
    return F.flatten(F.transform(both, lambda x: F.transform(F.slice(x["a"]["inside"], 1, x["a"]["n"]), lambda y: y + x["s"])))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Matches from left to right as array of (start, order, end); code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.char_length(x).cast("long"))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length)
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x).cast("long"))
    # what stands before each match, its length, and the length of its group; the last gap has no match behind it
    rows = F.filter(F.arrays_zip(between.alias("gap"), lengths.alias("length"), sizes.alias("size")), lambda x: x["length"].isNotNull())
    ends = F.transform(rows, lambda x: x["gap"] + x["length"])
    rows = F.arrays_zip(rows.alias("m"), _running(ends).alias("ahead"))
    found = F.transform(rows, lambda x: F.struct((x["ahead"] + x["m"]["gap"]).alias("start"), x["m"].alias("m")))
    kept = F.filter(found, lambda x: x["m"]["size"] >= rule.least)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), (x["start"] + x["m"]["length"]).alias("end")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: identifier, ``secrets`` array of (start, kind, end) by start, then by the order of ``rules``.

    Matches of a rule do not overlap and are found from left to right; those of different rules may overlap.
    Null and empty texts have none.  Repeated rows and null identifiers give a row each; other columns are
    ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.xxhash64(F.to_json(F.struct(F.col(id_col).alias("i"))), text)
    docs = df.select(F.col(id_col).alias("_id"), doc.alias("_doc"), text.alias("_text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    if indexed:
        wanted = sorted(set().union(*map(trigrams, indexed.values())))
        found = stored(candidates(postings(docs, wanted), indexed))
        docs = attach(docs, found, ["_doc"], "left", size="_rules")
    else:
        docs = docs.withColumn("_rules", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")
    text, parts = F.col("_text"), []
    for n, r in enumerate(rules):
        asked = F.coalesce(F.array_contains("_rules", r.kind), F.lit(False)) if r.kind in indexed else F.lit(True)
        parts.append(F.when(asked & text.rlike(r.pattern), _spans(r, n, text)).otherwise(none))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    every = F.transform(F.array_sort(F.concat(*parts)), lambda x: F.struct(x["start"].alias("start"), F.get(kinds, x["order"]).alias("kind"), x["end"].alias("end")))
    return docs.select(F.col("_id").alias(id_col), every.alias("secrets"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    return found.select(id_col, *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def digest_sql() -> str:
    """The same rows by SQL over ``documents``: every rule searched for in every text."""
    quote = lambda s: s.replace("'", "''")
    parts = []
    for n, r in enumerate(RULES):
        p = quote(r.pattern)
        parts.append(f"""SELECT doc_id, {n} AS o, '{r.kind}' AS kind, m, g, i,
 list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m,
 regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS s FROM docs)) WHERE length(g[i]) >= {r.least}""")
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 spans AS (SELECT doc_id, o, kind, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(m[i]) AS BIGINT) AS w FROM ({' UNION ALL '.join(parts)}))
 SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(w, ',' ORDER BY a, o) FILTER (kind IN ({base})), '')) AS base_sha256,
 coalesce(string_agg(w, ',' ORDER BY a, o), '') AS spans FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""
