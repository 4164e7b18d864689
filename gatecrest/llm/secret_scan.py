"""Secret scan by corpus-wide ownership frequency.

A candidate that many repositories and owners share is an example that people copy; one that a single owner has looks
live. Candidates are hashed where they are found, so no secret leaves the scan.
"""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecrest.llm.common import cut

#: The whole block with its headers, up to its END line: keys of one type share their beginnings. A block that has no END
#: line before the next BEGIN or END, or before the text ends, goes as far as its headers and lines of base64. Possessive, so
#: that long blocks take no stack.
PRIVATE_KEY = (
    r"(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:"
    r"(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*+[A-Za-z-]++:[^\n]*+)*+(?:\s*+[A-Za-z0-9+/=]{16,}+)*+(?:\s*+[A-Za-z0-9+/]*+=)?+))"
)
#: What stands between the name of a secret and its value, in code and in configuration.
IS = r"""["']?\s*(?:=>|[:=])\s*["']?"""
#: Kind, pattern (group 1 is the credential) and literals in lower case of which the text must hold one before the pattern is tried.
KINDS = (
    ("aws_access_key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})", ("akia", "asia")),
    ("assigned_token", r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|secret[_-]?key)" + IS + r"([A-Za-z0-9_+/=.-]{16,})", ("token", "secret", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key")),
    ("password", r"(?i)(?:password|passwd|pwd)" + IS + r"""([^\s"'<>,;]{8,})""", ("passw", "pwd")),
    ("private_key", PRIVATE_KEY, ("private key",)),
    ("github_token", r"(gh[pousr]_[A-Za-z0-9]{36,})", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("bearer_jwt", r"(eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,})", ("eyj",)),
)
#: A credential that says it is none, or of fewer than DISTINCT different characters, looks like no live one.
PLACEHOLDER, DISTINCT = r"(?i)example|sample|dummy|placeholder|change.?me|your[_-]|insert|x{4,}|[*]{4,}|[$][{]", 6
#: From so many distinct owners on a candidate is an example.
EXAMPLE_OWNERS = 3


def dull(secret: Column) -> Column:
    """Whether a candidate is a placeholder, or of too little variety."""
    return secret.rlike(PLACEHOLDER) | (F.size(F.array_distinct(F.split(secret, ""))) < DISTINCT)


def _named(kind: str, secret: Column) -> Column:
    plain = F.lit(False) if kind == "private_key" else dull(secret)  # long enough to hold such words by chance
    return F.struct(F.lit(kind).alias("kind"), F.sha2(secret, 256).alias("secret_hash"), plain.alias("dull"))


def candidates(text: Column, lower: Column) -> Column:
    """Array of (kind, secret_hash, dull) of all matches in the whole text. lower: the text in lower case."""
    none = F.array().cast("array<struct<kind:string,secret_hash:string,dull:boolean>>")
    found = []
    for kind, pattern, words in KINDS:
        hashes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), partial(_named, kind))
        found.append(F.when(reduce(or_, (F.contains(lower, F.lit(w)) for w in words)), hashes).otherwise(none))
    return F.concat(*found)


def scan(docs: DataFrame, owner: str = "source", language: str = "lang", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, kind, secret_hash, occurrences, n_documents, n_repositories, n_owners, verdict) of each document and candidate.

    A document's owner is its ``source``; its repository is the source and language together. A candidate that at least
    ``example_owners`` owners have, or that looks like a placeholder (see PLACEHOLDER and DISTINCT), is an 'example'; of
    the others one of a single owner is 'live', those of more are 'shared'. Documents of unknown owner (null) count
    together as one owner. n_documents counts distinct ids.

    A null text has no candidate; a null doc_id is reported as null, and all null ids count as one document. Repeated
    rows add to occurrences. Only doc_id, text and the owner columns are read. No rows give no rows.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.col(owner), F.lit("")).alias("owner"), F.concat_ws("/", F.coalesce(F.col(owner), F.lit("")), F.coalesce(F.col(language), F.lit(""))).alias("repository"))
    hits = docs.where("text is not null").select("doc_id", "owner", "repository", F.explode(candidates(F.col("text"), F.lower("text"))).alias("x"))
    hits = cut(hits.select("doc_id", "owner", "repository", "x.kind", "x.secret_hash", "x.dull").groupBy("doc_id", "owner", "repository", "kind", "secret_hash", "dull").agg(F.count("*").alias("occurrences")))
    key = ["kind", "secret_hash"]  # dull follows from it
    places = hits.groupBy(*key, "owner", "repository").agg(F.bool_or("dull").alias("dull"))
    spread = places.groupBy(*key, "owner").agg(F.count("*").alias("r"), F.bool_or("dull").alias("dull")).groupBy(*key).agg(F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"), F.bool_or("dull").alias("dull"))
    documents = hits.groupBy(*key, "doc_id").agg(F.sum("occurrences").alias("occurrences"))
    counts = documents.groupBy(*key).agg(F.count("*").alias("n_documents"))
    verdict = F.when((F.col("n_owners") >= example_owners) | F.col("dull"), "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    return documents.join(spread.join(counts, key), key).select("doc_id", *key, "occurrences", "n_documents", "n_repositories", "n_owners", verdict.alias("verdict"))


def oracle(example_owners: int = EXAMPLE_OWNERS) -> str:
    """The same in SQL with patterns of its own, except that a private key goes by its first 64 characters; the given tables have none."""
    gap = "[\"'']?[[:space:]]*(?:=>|:|=)[[:space:]]*[\"'']?"
    kinds = {
        "aws_access_key": "\\b((?:AKIA|ASIA)[0-9A-Z]{16})",
        "assigned_token": f"(?i)(?:token|secret|api_key|api-key|apikey|access_key|access-key|accesskey|secret_key|secret-key|secretkey){gap}([[:alnum:]_+/=.-]{{16,}})",
        "password": f"(?i)(?:pwd|passw(?:or)?d){gap}([^[:space:]\"''<>,;]{{8,}})",
        "private_key": "(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=[:space:]]{0,64})",
        "github_token": "(gh[opsur]_[[:alnum:]]{36,})",
        "bearer_jwt": "(eyJ[[:alnum:]_-]{10,}[.][[:alnum:]_-]{10,}[.][[:alnum:]_-]{10,})",
    }
    words = "example|sample|dummy|placeholder|change.?me|your[-_]|insert|xxxx|[*][*][*][*]|[$][{]"
    arms = " UNION ALL ".join(f"SELECT doc_id, source, lang, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS s FROM documents" for kind, p in kinds.items())
    return f"""WITH hits AS ({arms}),
    hashed AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository, kind, sha256(s) AS secret_hash, kind <> 'private_key' AND (regexp_matches(s, '(?i){words}') OR len(list_distinct(string_split(s, ''))) < 6) AS dull FROM hits),
    spread AS (SELECT kind, secret_hash, count(DISTINCT doc_id)::BIGINT AS n_documents, count(DISTINCT repository)::BIGINT AS n_repositories, count(DISTINCT owner)::BIGINT AS n_owners, bool_or(dull) AS dull FROM hashed GROUP BY 1, 2),
    per AS (SELECT doc_id, kind, secret_hash, count(*)::BIGINT AS occurrences FROM hashed GROUP BY 1, 2, 3)
    SELECT doc_id, kind, secret_hash, occurrences, n_documents, n_repositories, n_owners,
      CASE WHEN n_owners >= {example_owners} OR dull THEN 'example' WHEN n_owners = 1 THEN 'live' ELSE 'shared' END AS verdict
    FROM per JOIN spread USING (kind, secret_hash)"""
