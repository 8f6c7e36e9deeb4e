"""String and JSON scalar functions (TXT-*, PRJ-10, PRJ-18).

All are ``Column -> Column`` built from Spark's own expressions, so they stay
inside whole-stage codegen.  Regex notes for matching Python semantics:

* Python ``.`` excludes only ``\\n``; Java's also excludes ``\\r``, U+0085,
  U+2028/9, so patterns with ``.`` carry ``(?d)`` (UNIX_LINES).
* Python ``str.strip()`` removes all Unicode whitespace; Spark's ``trim`` only
  spaces, so :func:`py_strip` uses a ``(?U)`` regex.
* ``regexp_extract`` returns ``''`` for both "matched an empty group" and
  "no match", so every extraction is guarded by ``rlike``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scheme import BOOL_FALSE, BOOL_TRUE

# FIXED VALUES: patterns of the answer formats the scorers recognise.
BOXED_ANY = r"\\boxed\{([^}]*)\}"        # \boxed{...}, may be empty
BOXED_NONEMPTY = r"\\boxed\{([^}]+)\}"   # \boxed{...}, at least one char
BRACKET = r"(?d)\[(.*?)\]"               # [ ... ]
ANSWER_TAG = r"(?d)<answer>(.*?)</answer>"
ANSWER_TAG_NO_LT = r"<answer>([^<]+)</answer>"
FIRST_PHRASE = r"^([^.\n,!?]+)"
TAG_SPACING = r"(?U)\s*(<|>|/)\s*"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), r"(?U)\A\s+|\s+\z", "")


def first_match(c, patterns: list[str], default: Column) -> Column:
    """Group 1 of the first pattern that matches, else ``default``."""
    c = _c(c)
    out = default
    for p in reversed(patterns):
        out = F.when(c.rlike(p), F.regexp_extract(c, p, 1)).otherwise(out)
    return out


def tighten_tags(c) -> Column:
    """TXT-01: drop whitespace around ``<``, ``>`` and ``/``."""
    return F.regexp_replace(_c(c), TAG_SPACING, "$1")


def boxed_reward(c) -> Column:
    r"""TXT-02: first of ``\boxed{..}`` (may be empty), ``[..]``,
    ``<answer>..</answer>``, else the whole text."""
    c = _c(c)
    return first_match(c, [BOXED_ANY, BRACKET, ANSWER_TAG], c)


def boxed_judge(c) -> Column:
    r"""TXT-03: ``\boxed{..}`` with at least one character, else the stripped text."""
    c = _c(c)
    return first_match(c, [BOXED_NONEMPTY], py_strip(c))


def answer_phrase(c) -> Column:
    """TXT-04: boxed, then ``<answer>``, then the first phrase before
    ``. newline , ! ?`` of the stripped text; each result stripped."""
    c = _c(c)
    s = py_strip(c)
    phrase = F.when(s.rlike(FIRST_PHRASE), py_strip(F.regexp_extract(s, FIRST_PHRASE, 1))).otherwise(s)
    return (F.when(c.rlike(BOXED_NONEMPTY), py_strip(F.regexp_extract(c, BOXED_NONEMPTY, 1)))
            .when(c.rlike(ANSWER_TAG_NO_LT), py_strip(F.regexp_extract(c, ANSWER_TAG_NO_LT, 1)))
            .otherwise(phrase))


def _locate(sub: str, c: Column, pos: Column) -> Column:
    return F.call_function("locate", F.lit(sub), c, pos)


def format_ok(c) -> Column:
    r"""TXT-05: 1.0 when the whole text matches
    ``<think>.*</think>.*\boxed{.*}.*`` with dot-all, else 0.0.

    Evaluated as a chain of leftmost ``locate`` calls instead of a
    backtracking regex: the earliest ``</think>`` after the opening tag, the
    earliest ``\boxed{`` after it and any ``}`` after that exist exactly when
    the full match exists.  Linear in the text length.
    """
    c = F.coalesce(_c(c), F.lit(""))
    p1 = _locate("</think>", c, F.lit(8))
    p2 = F.when(p1 > 0, _locate("\\boxed{", c, p1 + 8)).otherwise(F.lit(0))
    p3 = F.when(p2 > 0, _locate("}", c, p2 + 7)).otherwise(F.lit(0))
    ok = c.startswith("<think>") & (p3 > 0)
    return F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))


def boolean_word(c) -> Column:
    """TXT-06: true/yes/1/y/t -> true, false/no/0/n/f -> false, else null."""
    low = F.lower(py_strip(_c(c)))
    return (F.when(low.isin(*BOOL_TRUE), F.lit(True))
            .when(low.isin(*BOOL_FALSE), F.lit(False))
            .otherwise(F.lit(None).cast("boolean")))


JUDGE_SCHEMA = "correct boolean, explanation string"


def parse_judge_reply(c) -> Column:
    """TXT-07: struct(correct, explanation, status).

    Strip; drop a leading "```json" and a trailing "```"; parse
    ``{correct, explanation}``.  Text that is not a JSON object falls back to
    correct = reply contains "true" (any case) and the explanation
    "Error parsing JSON, content: <reply>".  A JSON object missing a field
    gets status ``missing_field`` (the caller routes it to rejects).
    """
    s = py_strip(_c(c))
    j = F.when(s.startswith("```json"), F.substring(s, 8, 1 << 30)).otherwise(s)
    j = F.when(j.endswith("```"), F.call_function("left", j, F.length(j) - 3)).otherwise(j)
    j = py_strip(j)
    keys = F.json_object_keys(j)
    parsed = F.from_json(j, JUDGE_SCHEMA)
    is_obj = keys.isNotNull()
    has_both = F.array_contains(keys, "correct") & F.array_contains(keys, "explanation")
    fallback_correct = F.lower(s).contains("true")
    status = (F.when(~is_obj, F.lit("parse_error")).when(~has_both, F.lit("missing_field"))
              .otherwise(F.lit("ok")))
    return F.struct(
        F.when(is_obj & has_both, parsed["correct"]).when(~is_obj, fallback_correct).alias("correct"),
        F.when(is_obj & has_both, parsed["explanation"])
         .when(~is_obj, F.concat(F.lit("Error parsing JSON, content: "), s)).alias("explanation"),
        status.alias("status"),
    )


def task_type(c) -> Column:
    """PRJ-10: 'cls' or 'qa' from a task id.

    Null/blank -> cls; strip whitespace, strip '_', lower, split on
    ``[_\\W]+``; last token cls -> cls, qa/qna -> qa, else cls.  'q&a' splits
    into 'q','a' and so is cls; a trailing separator leaves an empty last
    token -> cls.
    """
    c = _c(c)
    s = F.lower(F.regexp_replace(py_strip(c), r"\A_+|_+\z", ""))
    last = F.element_at(F.split(s, r"(?U)[_\W]+", -1), -1)
    blank = c.isNull() | (py_strip(c) == "")
    return (F.when(blank, F.lit("cls"))
            .when(last.isin("qa", "qna", "q&a"), F.lit("qa"))
            .otherwise(F.lit("cls")))


def decode_text(c, strict: bool = False) -> Column:
    """PRJ-18: UTF-8 bytes to string.  ``strict`` raises on bad bytes."""
    c = _c(c)
    if strict:
        return F.when(F.try_validate_utf8(F.decode(c, "UTF-8")).isNull() & c.isNotNull(),
                      F.raise_error(F.lit("invalid UTF-8"))).otherwise(F.decode(c, "UTF-8"))
    return F.decode(c, "UTF-8")


def exact_match(a, b, strip: bool = False) -> Column:
    """RWD-01: 1.0 when equal after lower (and strip when ``strip``)."""
    a, b = _c(a), _c(b)
    if strip:
        a, b = py_strip(a), py_strip(b)
    return F.when(F.lower(a) == F.lower(b), F.lit(1.0)).otherwise(F.lit(0.0))
