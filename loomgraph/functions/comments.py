"""Comment stripping by character scanners, and the Arrow UDFs around them.

Strings keep their text, because import paths live in them; ``decontent`` blanks it afterwards for rules that read code only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD_BEFORE_REGEX = frozenset("return typeof case in of delete void instanceof new else do yield await throw".split())
_SIGNS_BEFORE_REGEX = frozenset("=([,;:?!&|{}+-*%~^")


def _blank(text: str) -> str:
    return "\n" * text.count("\n")


def _string_end(s: str, at: int) -> int:
    """Place after the closing quote of a single-line string that opens at ``at``, or -1."""
    k, quote = at + 1, s[at]
    while k < len(s) and s[k] != "\n":
        if s[k] == "\\":
            k += 2
            continue
        if s[k] == quote:
            return k + 1
        k += 1
    return -1


def _template_end(s: str, at: int) -> int:
    """Place after the closing backtick of a template that opens at ``at``, or -1; nested templates count."""
    k, depth = at + 1, 0
    while k < len(s):
        c = s[k]
        if c == "\\":
            k += 2
            continue
        if depth == 0 and c == "`":
            return k + 1
        if c == "$" and s[k + 1 : k + 2] == "{":
            depth, k = depth + 1, k + 2
            continue
        if depth:
            if c == "`":
                inner = _template_end(s, k)
                if inner < 0:
                    return -1
                k = inner
                continue
            depth += (c == "{") - (c == "}")
        k += 1
    return -1


def _regex_end(s: str, at: int) -> int:
    """Place after a regular expression literal that opens at ``at``, or -1."""
    k, in_class = at + 1, False
    while k < len(s) and s[k] != "\n":
        c = s[k]
        if c == "\\":
            k += 2
            continue
        if c == "/" and not in_class:
            k += 1
            while k < len(s) and s[k].isalpha():
                k += 1
            return k
        in_class = c == "[" or in_class and c != "]"
        k += 1
    return -1


def _may_open_regex(out: list[str], following: str) -> bool:
    if following in ("", " ", "="):
        return False
    before = "".join(out[-3:])[-40:].rstrip()
    if not before or before[-1] in _SIGNS_BEFORE_REGEX:
        return True
    m = re.search(r"[A-Za-z_$]+$", before)
    return bool(m) and m[0] in _WORD_BEFORE_REGEX


def strip_c_comments(s: str) -> str:
    """Without block and line comments of C-like languages; text of multi-line templates goes, what they interpolate stays.

    A quote that doesn't close on its line, and a backtick that never closes, is an ordinary character.
    """
    out: list[str] = []
    k = 0
    while k < len(s):
        c, two = s[k], s[k : k + 2]
        if two == "/*":
            end = s.find("*/", k + 2)
            end = len(s) if end < 0 else end + 2
            out.append(_blank(s[k:end]) or " ")
            k = end
        elif two == "//":
            end = s.find("\n", k)
            k = len(s) if end < 0 else end
        elif c == "/" and _may_open_regex(out, s[k + 1 : k + 2]) and (end := _regex_end(s, k)) > 0:
            out.append(s[k:end])
            k = end
        elif c == "`" and (end := _template_end(s, k)) > 0:
            body = s[k:end]
            out.append(_template(body) if "\n" in body else body)
            k = end
        elif c in "\"'" and (end := _string_end(s, k)) > 0:
            out.append(s[k:end])
            k = end
        else:
            m = _PLAIN.match(s, k)
            end = m.end() if m else k + 1
            out.append(s[k:end])
            k = end
    return "".join(out)


_PLAIN = re.compile(r"[^/`\"']+")


def _template(body: str) -> str:
    """A multi-line template with its text blanked and its interpolations stripped of comments in turn."""
    out, k = ["`"], 1
    while k < len(body) - 1:
        if body[k] == "\\":
            k += 2
        elif body.startswith("${", k):
            start, depth, k = k + 2, 1, k + 2
            while k < len(body) - 1 and depth:
                if body[k] == "`" and (end := _template_end(body, k)) > 0:
                    k = end
                    continue
                if body[k] in "\"'" and (end := _string_end(body, k)) > 0:
                    k = end
                    continue
                depth += (body[k] == "{") - (body[k] == "}")
                k += 1
            out.append("${" + strip_c_comments(body[start : k - 1]) + "}")
        else:
            if body[k] == "\n":
                out.append("\n")
            k += 1
    return "".join(out) + "`"


_PYTHON = re.compile(r"(?P<triple>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<comment>#[^\n]*)")


def strip_python_comments(s: str) -> str:
    """Without ``#`` comments; triple-quoted strings are blanked, their line feeds stay; other strings stay."""
    return _PYTHON.sub(lambda m: m[0] if m["string"] else _blank(m[0]) if m["triple"] else "", s)


def strip_comments(text: str, ext: str) -> str:
    return strip_python_comments(text) if ext == ".py" else strip_c_comments(text)


_WHOLE_LINE = re.compile(r"^[ \t]*(?:--|#).*$", re.M)
_STRINGS = re.compile(r"`[^`\n]*`|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"")


def decontent(text: str, ext: str) -> str:
    """Comment-free text with whole-line ``--`` and ``#`` comments and the bodies of single-line strings blanked."""
    return _STRINGS.sub(lambda m: m[0][0] * 2, _WHOLE_LINE.sub("", strip_comments(text, ext)))


def strip_fences(text: str) -> tuple[str, bool]:
    """Markdown without the lines of fenced blocks (line count kept), and whether a fence never closes.

    A fence is three or more backticks or tildes after up to three spaces and any block quote marks; it closes with a bare run of the
    same character.
    """
    out, open_with = [], ""
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if not open_with and m:
            open_with = m[1][0]
            out.append("")
        elif open_with and m and m[1][0] == open_with and not m[2].strip():
            open_with = ""
            out.append("")
        else:
            out.append("" if open_with else line)
    return "\n".join(out), bool(open_with)


_FENCE = re.compile(r"\s{0,3}(?:>\s?)*(`{3,}|~{3,})(.*)$")


def strip_inline_code(text: str) -> str:
    return re.sub(r"`[^`\n]*`", "", text)


def read_jsonc(text: str) -> object | None:
    """Strict JSON first; else without comments and trailing commas; None if that fails too."""
    for t in (text, re.sub(r",(\s*[}\]])", r"\1", _json_comments(text))):
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


_JSON = re.compile(r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*[\s\S]*?\*/")


def _json_comments(text: str) -> str:
    return _JSON.sub(lambda m: m[1] or "", text)


def _udf(f: Callable[..., object], kind: T.DataType = T.StringType()) -> Callable[..., Column]:
    """An Arrow UDF of one or two columns. A worker holds a batch and its result, and few of their rows as Python strings at a time; using the UDF makes batches small."""
    made = pa.bool_() if isinstance(kind, T.BooleanType) else pa.string()

    def column(*arrays: pa.Array) -> pa.Array:
        cut = lambda k: zip(*(a.slice(k, _ROWS).to_pylist() for a in arrays), strict=True)
        done = [pa.array([None if row[0] is None else f(*row) for row in cut(k)], made) for k in range(0, len(arrays[0]), _ROWS)]
        return pa.concat_arrays(done) if done else pa.array([], made)

    def one(a: pa.Array) -> pa.Array:
        return column(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return column(a, b)

    by_count = {1: F.arrow_udf(one, kind), 2: F.arrow_udf(two, kind)}

    def applied(*c: Column | str) -> Column:
        _small_batches()
        return by_count[len(c)](*c)

    return applied


_ROWS = 64


def _small_batches(rows: int = 1000, size: int = 32 << 20) -> None:
    """At most so many rows and about so many bytes in a batch for Python, set in the session, as Spark reads both when a frame runs; smaller ones of the user's are kept."""
    spark = SparkSession.active()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key)).lower()
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


#: Arrow UDFs: text and extension, or text alone.
clean_text = _udf(strip_comments)
code_text = _udf(decontent)
without_fences = _udf(lambda t: strip_fences(t)[0])
fence_open = _udf(lambda t: strip_fences(t)[1], T.BooleanType())
json_text = _udf(lambda t: None if (j := read_jsonc(t)) is None else json.dumps(j, sort_keys=True))
