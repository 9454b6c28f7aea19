"""Column expressions on file content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is taken for a secret, and what stands in its place; applied in this order.
REDACTIONS: list[tuple[str, str]] = [
    (r"(AKIA[0-9A-Z]{16})", "[REDACTED:AWS_ACCESS_KEY]"),
    (r"(?i)(aws_secret[_\s]*(?:access_)?key)\s*[=\s:]\s*[\"']?([A-Za-z0-9/+=]{40})[\"']?", "$1=[REDACTED:AWS_SECRET_KEY]"),
    (r"(?i)((?:gh[pousr]|github_pat)_[A-Za-z0-9_]{20,})", "[REDACTED:GITHUB_TOKEN]"),
    (r"(?i)([\"']?(?:api[_-]?key|apikey)[\"']?\s*[=:]\s*)[\"']?([A-Za-z0-9_\-/+=]{20,})[\"']?", "$1\"[REDACTED:API_KEY]\""),
    (r"(?s)-----BEGIN (?:ENCRYPTED |RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----.*?-----END (?:ENCRYPTED |RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "[REDACTED:PRIVATE_KEY]"),
    (r"(-----BEGIN (?:ENCRYPTED |RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)", "[REDACTED:PRIVATE_KEY_HEADER]"),
    (r"(-----END (?:ENCRYPTED |RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)", "[REDACTED:PRIVATE_KEY_HEADER]"),
    (r"(\[REDACTED:PRIVATE_KEY_HEADER\](?:\r?\n[A-Za-z0-9+/=]{16,})+)", "[REDACTED:PRIVATE_KEY_HEADER]\n[REDACTED:PRIVATE_KEY_BODY]"),
    (r"(?i)([\"']?(?:password|passwd|pwd)[\"']?\s*[=:]\s*)(\")((?:\\.|[^\"\\])*)(\")", "$1$2[REDACTED:PASSWORD]$2"),
    (r"(?i)([\"']?(?:password|passwd|pwd)[\"']?\s*[=:]\s*)(')((?:\\.|[^'\\])*)(')", "$1$2[REDACTED:PASSWORD]$2"),
    (r"(?i)([\"']?(?:password|passwd|pwd)[\"']?\s*[=:]\s*)(?!none|null|false|true)([^\s\"',}]+)", "$1[REDACTED:PASSWORD]"),
    (r"((?:mysql|postgres|postgresql|mongodb(?:\+srv)?|rediss?|amqps?)://(?:[^:@/\s]+)?:)([^@\s]+)(@)", "$1[REDACTED:CONN_STRING_PASSWORD]$3"),
    (r"(?i)([\"']?(?:secret|token|key|password|credential|auth)[^\s\"'=:]*[\"']?\s*[=:]\s*)[\"']?([A-Za-z0-9_\-/+=]{32,})[\"']?", "$1\"[REDACTED:SECRET]\""),
]


def token_estimate(c: Column) -> Column:
    """UTF-8 bytes at 2.5 for each token, rounded down."""
    return F.floor(F.octet_length(c) * 2 / 5).cast("long")


def line_count(c: Column) -> Column:
    """Line feeds and one."""
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")


def redact(c: Column) -> Column:
    for pattern, instead in REDACTIONS:
        c = F.regexp_replace(c, pattern, instead)
    return c


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def palette_index(c: Column, colours: int = 20) -> Column:
    """MD5 of a text as a number, modulo the number of colours: hex digits folded one by one."""
    digits = F.transform(F.split(F.md5(c), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: (a * 16 + d) % colours)


def json_object(c: Column) -> Column:
    """A JSON object in a model's answer: as it is, without a code fence, or from the first to the last brace; else null."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    span = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    bare = lambda x: F.trim(x, F.lit(" \n\r\t"))
    valid = lambda x: F.when(F.json_object_keys(x).isNotNull(), x)
    return F.coalesce(valid(bare(c)), valid(bare(fence)), valid(span))
