"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, collocations, decontaminate, divergence, exact_dedup, line_dedup, secrets, simhash, substring_dedup, suffix_dedup, token_count, token_output, toxicity


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Per document: lines before and after, and the digest of what is left of its text."""
    documents = table(spark, path, "documents")
    count = lambda text: F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))
    marked = documents.select("doc_id", "text", count(F.col("text")).alias("n_lines"))
    left = line_dedup.drop_repeated_chunks(marked)
    return left.select("doc_id", "n_lines", count(F.col("text")).alias("lines_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_token_counts(spark: SparkSession, path: str) -> DataFrame:
    return token_count.token_counts(table(spark, path, "documents"))


def op3_token_files(spark: SparkSession, path: str) -> DataFrame:
    return token_output.token_files(table(spark, path, "documents"))


def op4_suffix_dedup(spark: SparkSession, path: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, path, "documents"))


def op5_decontaminate(spark: SparkSession, path: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, path, "documents"), table(spark, path, "benchmark"))


def op6_exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, path, "documents"))


def op7_secrets(spark: SparkSession, path: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, path, "documents")))


def op8_simhash(spark: SparkSession, path: str) -> DataFrame:
    return simhash.near_dedup(table(spark, path, "documents"))


def op9_bpe(spark: SparkSession, path: str) -> DataFrame:
    return bpe.encode(table(spark, path, "documents")).drop("ids")


def op10_toxicity(spark: SparkSession, path: str) -> DataFrame:
    documents = table(spark, path, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, path, "labels")))


def op11_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Per document: words before, words taken out, and the digest of those that stay."""
    left = substring_dedup.drop_repeats(table(spark, path, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, path: str) -> DataFrame:
    return collocations.collocations(table(spark, path, "documents"))


def op13_source_divergence(spark: SparkSession, path: str) -> DataFrame:
    return divergence.source_divergence(table(spark, path, "documents"))


SQL = {
    "op6_exact_dedup": r"""
        WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM norm""",
}
SQL["op7_secrets"] = secrets.digest_sql()
SQL["op11_substring_dedup"] = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    k AS (SELECT r, p, sha256(array_to_string(ws[p:p + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS p FROM d)),
    again AS (SELECT r, p FROM k QUALIFY count(*) OVER (PARTITION BY h) > 1),
    gone AS (SELECT DISTINCT r, p + i AS q FROM again, range(35) t(i)),
    w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM d),
    left_over AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS t FROM w ANTI JOIN gone USING (r, q) GROUP BY r)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN left_over USING (r)"""
SQL["op12_collocations"] = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
    n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
    g AS (SELECT lang, ws[p:p + k - 1] AS g, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, range(1, 5) s(k)) GROUP BY ALL HAVING count(*) >= 30),
    cuts AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * c.f // (x.f + y.f) AS score
      FROM (SELECT *, unnest(range(1, len(g))) AS k FROM g WHERE len(g) > 1) c JOIN g x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    longer AS (SELECT lang, s, max(f) AS most FROM (SELECT lang, f, g[i:i + m - 1] AS s FROM (SELECT *, unnest(range(1, len(g) - m + 2)) AS i FROM g, range(2, 4) t(m) WHERE m < len(g))) GROUP BY lang, s),
    rows AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.s = b.g
      WHERE most IS NULL OR 100 * most < 80 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM rows JOIN n USING (lang) QUALIFY rank <= 2000"""
SQL["op13_source_divergence"] = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
    groups AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    size AS (SELECT lang, source, coalesce(t, 0) AS t, coalesce(v, 0) AS v FROM groups
      LEFT JOIN (SELECT lang, source, sum(n) AS t FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
    p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (t + v)::HUGEINT AS p
      FROM size JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
    whole AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(t) + any_value(v))::HUGEINT AS q
      FROM c JOIN (SELECT lang, sum(t) AS t, any_value(v) AS v FROM size GROUP BY lang) USING (lang) GROUP BY lang, term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
    parts AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM groups g JOIN groups h ON g.lang = h.lang AND g.source != h.source
      LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [x for name, x in globals().items() if name.startswith("op")]
    return {f.__name__: f for f in found if callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
