"""Which field names and which text values count as sensitive."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names after lowercasing and dropping "_", "-", " " and ".".
REMOVED_SUFFIXES = ["email", "accountid", "conversationid", "hostname"]
REMOVED_NAMES = [
    "prompt",
    "prompts",
    "response",
    "responses",
    "sourcecode",
    "command",
    "commandline",
    "arguments",
    "output",
    "body",
    "password",
    "token",
    "accesstoken",
    "apikey",
    "authorization",
    "secret",
]
REDACTED_NAMES = ["commandarguments", "commandargs"]
HASHED_NAMES = ["filepath", "filepaths", "filename", "filenames"]
PROHIBITED_CONTENT_WORDS = ["prompt", "response", "source"]

# Names a reviewed document must not contain ("." is kept when comparing).
PROHIBITED_DOCUMENT_NAMES = [
    "prompt",
    "prompts",
    "response",
    "responses",
    "sourcecode",
    "command",
    "commandline",
    "commandarguments",
    "commandargs",
    "filepath",
    "filepaths",
    "filename",
    "filenames",
    "password",
    "token",
    "accesstoken",
    "apikey",
    "authorization",
    "secret",
]

# Secret detectors. @B is a word boundary over ASCII word characters, which
# Java's \b is not, and (?iu) folds case over all of Unicode.
SECRET_PATTERNS = {
    "authorization_header": r"(?iu)@B(?:bearer|basic)[\t\n\f\r ]+[a-z0-9._~+/=-]{12,}@B",
    "service_key": r"@B(?:sk|ghp|github[_-]pat)[_-][a-zA-Z0-9_-]{16,}@B",
    "cloud_key_id": r"@BAKIA[0-9A-Z]{16}@B",
    "private_key": r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----",
}
# A text that matches a pattern contains one of these. Scanning for them is many times faster
# than trying the pattern at every character.
PATTERN_HINTS = {
    "authorization_header": r"(?iu)bearer|basic",
    "service_key": r"sk[_-]|ghp[_-]|pat[_-]",
    "cloud_key_id": "AKIA",
    "private_key": "-----BEGIN ",
}
SECRET_ALPHABET = r"\A[a-zA-Z0-9.+/=_-]{32,}\z"
ENTROPY_LIMIT = 4.3

ASCII_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


# Names are compared in lower case, letter by letter. Besides the ASCII letters two others have an
# ASCII letter as lower case; both checks of names, here and in the walk, share this rule.
FOLDED_LETTERS = {"\u0130": "i", "\u212a": "k"}
_UPPER = string.ascii_uppercase + "".join(FOLDED_LETTERS)
_LOWER = string.ascii_lowercase + "".join(FOLDED_LETTERS.values())


def prohibited_document_name(name: Column) -> Column:
    return F.translate(name, _UPPER + "_- ", _LOWER).isin(PROHIBITED_DOCUMENT_NAMES)


def matches_pattern(text: Column, detector: str) -> Column:
    hint = text.rlike(PATTERN_HINTS[detector])
    return hint & text.rlike(SECRET_PATTERNS[detector].replace("@B", ASCII_BOUNDARY))


def shannon_entropy(text: Column) -> Column:
    """Bits per character. One pass over the text per distinct character."""
    length = F.length(text)
    shares = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda char: (length - F.length(F.replace(text, char, F.lit("")))) / length,
    )
    return F.aggregate(shares, F.lit(0.0), lambda total, share: total - share * F.log2(share))


def high_entropy(text: Column) -> Column:
    """Long text over a key-like alphabet whose characters are spread almost evenly."""
    return F.when(text.rlike(SECRET_ALPHABET), shannon_entropy(text) >= ENTROPY_LIMIT).otherwise(False)


def secret_detector(text: Column) -> Column:
    """Name of the first detector that fires on the text, NULL when none does."""
    hits = [F.when(matches_pattern(text, name), name) for name in SECRET_PATTERNS]
    return F.coalesce(*hits, F.when(high_entropy(text), "high_entropy"))
