"""Operator 10: URL filter by host rules and a weighted vocabulary.

Rules (host, path, verdict) fit their host and its subdomains where the url's
path starts with the rule's; the longest fitting rule decides.  Other urls are
judged by an Aho-Corasick automaton over the lower-cased url: a term counts
where no letter or digit adjoins it.  One strict term, or ``SOFT_LIMIT``
distinct soft terms, block the url.

Results in corner cases: a null url, or one without ``://``, has an empty host
and path, fits no rule, and its text is judged by the vocabulary alone (null:
allow); percent escapes are not decoded; a host keeps its port and user.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# The default vocabulary: weight 2 is strict, weight 1 soft.
STRICT = ["spam", "cheap-pills", "viagra", "cialis", "casino", "porn", "xxx", "malware", "phishing", "warez", "escort", "camgirls"]
SOFT = ["pills", "cheap", "free", "bet", "poker", "loan", "loans", "win", "bonus", "sale", "deal", "deals", "discount",
        "adult", "dating", "crack", "torrent", "jackpot", "payday", "replica", "farm", "clickbait", "giveaway", "coupon"]
VOCABULARY = {**{t: 1 for t in SOFT}, **{t: 2 for t in STRICT}}
SOFT_LIMIT = 2


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path)."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    none = F.lit("")
    return F.coalesce(F.translate(host, upper, lower), none), F.coalesce(path, none)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest fitting rule, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def count_terms(urls: DataFrame, column: str = "url", vocabulary: dict[str, int] = VOCABULARY) -> DataFrame:
    """``urls`` with strict_hits and soft_hits, the numbers of distinct terms."""
    names = urls.columns
    schema = T.StructType([*urls.schema.fields, T.StructField("strict_hits", T.LongType()), T.StructField("soft_hits", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            automaton.add_word(term, (term, weight))
        if vocabulary:
            automaton.make_automaton()
        for batch in batches:
            hits = []
            for url in batch.column(column).to_pylist():
                found = {}
                text = (url or "").lower()
                for end, (term, weight) in automaton.iter(text) if vocabulary else ():
                    start = end - len(term) + 1
                    if not (start and text[start - 1].isalnum()) and not text[end + 1:end + 2].isalnum():
                        found[term] = weight
                hits.append((sum(w == 2 for w in found.values()), sum(w == 1 for w in found.values())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array([h[i] for h in hits], pa.int64()) for i in (0, 1)], names + ["strict_hits", "soft_hits"])

    return urls.mapInArrow(run, schema)


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: dict[str, int] = VOCABULARY, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits and soft_hits."""
    rows = count_terms(pages.select("page_id", "url"), "url", vocabulary)
    host, path = url_parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "strict_hits", "soft_hits")
    name, said = rule_for(F.col("host"), F.col("path"), rules)
    judged = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(said, judged).alias("verdict"),
                       "strict_hits", "soft_hits")


def _sql() -> str:
    """The same rows in DuckDB SQL, vocabulary and rules written out."""
    def hits(terms: list[str]) -> str:
        tests = (f"(CASE WHEN regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') THEN 1 ELSE 0 END)" for t in terms)
        return " + ".join(tests)

    return f"""
    WITH p AS (
      SELECT page_id, lower(coalesce(url, '')) AS u,
             CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    h AS (
      SELECT page_id, u,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM p),
    r AS (
      SELECT *, {hits(STRICT)} AS strict_hits, {hits(SOFT)} AS soft_hits,
        CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
      FROM h)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
                WHEN rule IS NOT NULL THEN 'block'
                WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict,
           CAST(strict_hits AS BIGINT) AS strict_hits, CAST(soft_hits AS BIGINT) AS soft_hits
    FROM r"""


ORACLE = _sql()
