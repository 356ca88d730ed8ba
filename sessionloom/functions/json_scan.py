"""A reader for JSON documents that the engine's parser refuses because of its limits.

The parser admits 1,000 nested containers, strings of 20 million characters and 128 MiB in all. This
reader goes through a text of any size once, token by token. It keeps the open containers and, of
each, only what was found in it, never the document itself.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.json_walk import fold_name
from sessionloom.functions.sensitive import (
    ASCII_BOUNDARY,
    ENTROPY_LIMIT,
    PROHIBITED_DOCUMENT_NAMES,
    SECRET_ALPHABET,
    SECRET_PATTERNS,
)

# Ship these helpers with the job, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the deepest nesting that counts as valid JSON.
MAX_DEPTH = 10_000
# Longer texts among the kept members are only told apart by whether they are blank.
KEPT_CHARS = 1_000_000

SCAN_TYPE = (
    T.StructType()
    .add("members", T.StringType())
    .add("path", T.StringType())
    .add("code", T.StringType())
)

_PLAIN = r'[^"\\\x00-\x1f]*+'
_TOKEN = re.compile(
    rf'[ \t\n\r]*+(?:([{{}}\[\]:,])|("{_PLAIN}(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{{4}}){_PLAIN})*+")'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null))"
)
_END = re.compile(r"[ \t\n\r]*+\Z")
_SEPARATORS = str.maketrans("", "", "_- ")
_DETECTORS = [
    (name, re.compile(pattern.replace("(?iu)", "(?i)").replace("@B", ASCII_BOUNDARY)))
    for name, pattern in SECRET_PATTERNS.items()
]
_ALPHABET = re.compile(SECRET_ALPHABET.replace(r"\z", r"\Z"))


def detector_of(text: str) -> str | None:
    """Name of the first detector that fires on the text; the rules of ``secret_detector``."""
    for name, pattern in _DETECTORS:
        if pattern.search(text):
            return name
    if _ALPHABET.match(text):
        shares = [count / len(text) for count in Counter(text).values()]
        if -sum(share * math.log2(share) for share in shares) >= ENTROPY_LIMIT:
            return "high_entropy"
    return None


class _Open:
    """An open container: the key or index it stands under, and what was found in it so far.

    ``found`` maps the keys of an object that lead to a violation to (rest of the path, code), since a
    repeated key replaces the one before; of a list only the first violation counts.
    """

    __slots__ = ("is_list", "key", "count", "found")

    def __init__(self, is_list: bool):
        self.is_list, self.key, self.count, self.found = is_list, None, 0, {}

    def note(self, violation: tuple[str, str] | None) -> None:
        """What the value under the current key or index holds: (path below it, code) or nothing."""
        if self.is_list:
            if violation and not self.found:
                self.found[0] = (f"[{self.count}]{violation[0]}", violation[1])
            self.count += 1
            return
        if fold_name(self.key).translate(_SEPARATORS) in PROHIBITED_DOCUMENT_NAMES:
            violation = ("", "prohibited_field")
        if violation:
            self.found[self.key] = violation
        else:
            self.found.pop(self.key, None)

    def first(self) -> tuple[str, str] | None:
        """The first violation in the order of keys or indexes, with its path from this container on."""
        if not self.found:
            return None
        if self.is_list:
            return self.found[0]
        key = min(self.found)
        rest, code = self.found[key]
        return f".{key}{rest}", code


def scan_document(text: str, kept: tuple[str, ...]) -> tuple[str, str | None, str | None] | None:
    """Members, path and code of a text that is one JSON value; None if it is none.

    ``members`` is a small JSON object of the members named in ``kept``, containers empty (a
    value that is no object is given as itself, an empty one); ``path`` and ``code`` tell the first
    prohibited name or likely secret in the order of keys, a name before what it holds.
    """
    stack: list[_Open] = []
    members: dict[str, str] = {}
    at, whole, want = 0, None, "value"
    while True:
        found = _TOKEN.match(text, at)
        if not found:
            break
        at = found.end()
        mark, string, number, word = found.groups()
        top = stack[-1] if stack else None
        if want == "key" or (want == "key or end" and mark != "}"):
            if string is None:
                return None
            top.key, want = json.loads(string), "colon"
            continue
        if want == "colon":
            if mark != ":":
                return None
            want = "value"
            continue
        closed = None
        if want == "comma or end" and mark == ",":
            want = "value" if top.is_list else "key"
            continue
        if mark in ("}", "]"):
            empty = want == ("value or end" if mark == "]" else "key or end")
            if not top or top.is_list != (mark == "]") or not (empty or want == "comma or end"):
                return None
            closed = stack.pop()
            if stack:
                stack[-1].note(closed.first())
        elif want not in ("value", "value or end") or mark in (":", ","):
            return None
        elif mark:
            if len(stack) >= MAX_DEPTH:
                return None
            if len(stack) == 1 and not top.is_list and top.key in kept:
                members[top.key] = "[]" if mark == "[" else "{}"
            stack.append(_Open(mark == "["))
            want = "value or end" if mark == "[" else "key or end"
            continue
        else:
            if len(stack) == 1 and not top.is_list and top.key in kept:
                members[top.key] = _short(string) if string else number or word
            if top:
                code = detector_of(json.loads(string)) if string else None
                top.note(("", code) if code else None)
        if not stack:
            whole = closed
            break
        want = "comma or end"
    if stack or not _END.match(text, at) or (whole is None and want != "value") or at == 0:
        return None
    if whole is None or whole.is_list:
        return "[]" if whole else text[:at].strip(), None, None
    path, code = whole.first() or (None, None)
    listed = ",".join(f"{json.dumps(name)}:{value}" for name, value in members.items())
    return f"{{{listed}}}", path and path[1:], code


def _short(string: str) -> str:
    if len(string) <= KEPT_CHARS:
        return string
    return '" "' if not json.loads(string).strip() else '"x"'


def document_scanner(kept: tuple[str, ...]):
    """Function of a JSON text giving members, path and code; NULL for NULL and for no single JSON value."""

    @F.arrow_udf(SCAN_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        found = [None if text.as_py() is None else scan_document(text.as_py(), kept) for text in texts]
        names = ["members", "path", "code"]
        rows = [None if row is None else dict(zip(names, row)) for row in found]
        return pa.array(rows, pa.struct([(name, pa.string()) for name in names]))

    return scan
