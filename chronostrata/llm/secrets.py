"""Secrets by corpus-wide ownership frequency.

Candidates are values that are assigned to a name such as token or api_key, and keys of known shape. Each
distinct value is counted over the whole corpus, whatever pattern found it: in how many repositories, and for
how many owners, it occurs. A value that several owners have was copied from an example; one that a single owner
has, and that looks like a live credential, is theirs:

    example    COPIED or more owners, or a placeholder (a word such as example, or few distinct characters)
    shared     2 up to COPIED - 1 owners
    live       one owner

The owner of a row is its owner column, here the document's source; a repository is the owner's part that the
repository column names, here its language. Counting first by (value, owner, repository) keeps a value that is
copied everywhere from meeting in one task row by row. Values are hashed where they are found: no exchange
carries them in clear.

A value that several patterns find has the kind of the first of KINDS, and a place that two of them find counts
once. Null and empty texts have no candidates. A null owner or repository counts as one of its own. A value that
occurs repeatedly in one document is one row with its number of occurrences; repeated rows add up. Rows without
an id are kept, with a null id. Values are taken whole, however long; they appear as SHA-256 hashes only. Extra
columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Owners from which on a value counts as a copied example.
COPIED = 3
#: Distinct characters below which a value is a placeholder.
VARIED = 8
#: kind -> pattern with the value as its first group, as in SQL. The syntax is what Java and RE2 have in common.
SQL_PATTERNS = {
    "assigned": r"""(?i)(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth[_-]?key)[A-Za-z0-9_-]*["']?[ \t]*(?:=>|:=|={1,3}|:)[ \t]*["']?([A-Za-z0-9+/_.=-]{8,})""",
    "access_key": r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "platform_token": r"\b((?:ghp|gho|ghs|ghr)_[A-Za-z0-9]{36})\b",
    "private_key": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END)",
}
#: A name may begin and go on with other words. A value is whole: between quotes, else up to a space, quote,
#: bracket or separator, and isn't a call. Shorter values than VARIED are placeholders, so that they aren't taken.
_NAME = r"""(?i)(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth[_-]?key)[A-Za-z0-9_-]*+\\?["']?\]?[ \t]*+(?>=>|:=|={1,3}|:)[ \t]*+"""
#: In quotes, a reference such as ${NAME} isn't a value.
_REFERENCE = r"""(?!\$?\{++[^{}\r\n"']*+\}++["']|\$\([^()\r\n"']*+\)["']|<[^<>\r\n"']*+>["'])"""
_QUOTED = "|".join(rf"""(?<=(?<!\\){q}){_REFERENCE}(?!(?:[^{q}\\\r\n]|\\.){{0,{VARIED - 1}}}{q})[^\r\n]{{{VARIED},}}?(?={q})(?<!(?<!\\)\\)""" for q in "\"'")
_BARE = rf"""[^\s"'`,;&|<>(){{}}\[\]\\=:][^\s"'`,;&|<>(){{}}\[\]\\]{{{VARIED - 1},}}+(?![(\[{{])"""
PATTERNS = SQL_PATTERNS | {"assigned": rf"""{_NAME}\\?["']?({_QUOTED}|{_BARE})"""}
#: The kinds, those told by their shape first.
KINDS = ("access_key", "platform_token", "private_key", "assigned")
#: Every candidate's text has one of these, in lower case: texts without them are told by a search for substrings.
HINTS = ("token", "secret", "passw", "key", "akia", "asia", "ghp_", "gho_", "ghs_", "ghr_")
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|your[_-]|xxxx|1234567|abcdef0"


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """(doc_id, owner, repo, kind, value) for each occurrence; kind is a number of KINDS."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.col(text_col).cast("string").alias("text"))
    # a lambda's argument is computed once, a column in an alternative again and again
    base = base.where(F.exists(F.array(F.lower("text")), lambda low: functools.reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in HINTS))))

    def of(k: int) -> Column:
        values = F.regexp_extract_all("text", F.lit(PATTERNS[KINDS[k]]), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))

    return base.select("doc_id", "owner", "repo", F.explode(F.concat(*map(of, range(len(KINDS))))).alias("c")).select("doc_id", "owner", "repo", "c.kind", "c.value")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", copied: int = COPIED) -> DataFrame:
    """(doc_id, kind, secret_hash, n_occurrences, n_owners, n_repositories, n_total, verdict) for each document and value."""
    placeholder = F.col("value").rlike(PLACEHOLDER) | (F.size(F.array_distinct(F.split("value", ""))) < VARIED)
    found = candidates(docs, id_col, text_col, owner_col, repo_col).select("doc_id", "owner", "repo", "kind", F.sha2("value", 256).alias("h"), placeholder.alias("p"))
    # every place of a value of known shape is found by that pattern, so that the most of a kind is the number of places
    by_kind = found.groupBy("doc_id", "owner", "repo", "h", "kind").agg(F.count("*").alias("n"), F.first("p").alias("p"))
    by_doc = by_kind.groupBy("doc_id", "owner", "repo", "h").agg(F.max("n").alias("n"), F.min("kind").alias("kind"), F.first("p").alias("p"))
    by_doc = materialise(by_doc, "secrets")  # few rows, and the texts are read once
    by_repo = by_doc.groupBy("h", "owner", "repo").agg(F.sum("n").alias("n"), F.first("p").alias("p"))
    # a repository is told by its owner too; nulls are values like others in a grouping
    by_owner = by_repo.groupBy("h", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"), F.first("p").alias("p"))
    counts = by_owner.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"), F.sum("n").alias("n_total"), F.first("p").alias("p"))
    verdict = F.when((F.col("n_owners") >= copied) | F.col("p"), "example").when(F.col("n_owners") > 1, "shared").otherwise("live")
    rows = by_doc.groupBy("doc_id", "h").agg(F.sum("n").alias("n_occurrences"), F.min("kind").alias("kind"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return rows.join(counts, "h").select("doc_id", kind.alias("kind"), F.col("h").alias("secret_hash"), "n_occurrences", "n_owners", "n_repositories", "n_total", verdict.alias("verdict"))


def _sql_pattern(p: str) -> str:
    return p.replace("'", "''")


#: find_secrets() with its defaults, for DuckDB, with the patterns that RE2 can run: the driver's tables hold no other forms.
SQL = f"""
WITH c AS ({" UNION ALL ".join(f"SELECT doc_id, source, lang, {k} AS k, unnest(regexp_extract_all(text, '{_sql_pattern(SQL_PATTERNS[kind])}', 1)) AS value FROM documents" for k, kind in enumerate(KINDS))}
), d AS (
    SELECT doc_id, source, lang, value, max(n) AS n, min(k) AS k FROM (SELECT doc_id, source, lang, value, k, count(*) AS n FROM c GROUP BY ALL) GROUP BY doc_id, source, lang, value
), o AS (
    SELECT value, sum(n) AS n_total,
        count(DISTINCT coalesce('s' || source, 'n')) AS n_owners,
        count(DISTINCT coalesce('s' || source, 'n') || '/' || coalesce('s' || lang, 'n')) AS n_repositories
    FROM d GROUP BY value
)
SELECT doc_id, [{", ".join(f"'{k}'" for k in KINDS)}][min(k) + 1] AS kind, sha256(value) AS secret_hash, CAST(sum(n) AS BIGINT) AS n_occurrences,
    any_value(n_owners) AS n_owners, any_value(n_repositories) AS n_repositories, CAST(any_value(n_total) AS BIGINT) AS n_total,
    any_value(CASE WHEN n_owners >= {COPIED} OR regexp_matches(value, '{PLACEHOLDER}') OR len(list_distinct(string_split(value, ''))) < {VARIED} THEN 'example'
        WHEN n_owners > 1 THEN 'shared' ELSE 'live' END) AS verdict
FROM d JOIN o USING (value) GROUP BY doc_id, value
"""
