"""Text search: exact, case-insensitive and by pattern, with overlapping hits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(pattern: str) -> str:
    return r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"


def _ahead(pattern: str, case_insensitive: bool) -> str:
    """A pattern that matches, without length, before every hit; case is folded in the match, so places are those of the text itself."""
    return f"{'(?iu)' if case_insensitive else ''}(?={_quoted(pattern)})"


def count_hits(text: Column, pattern: str, case_insensitive: bool = False) -> Column:
    """Overlapping hits of a text; an empty pattern has none. A lookahead counts them, so the text is passed over once."""
    if not pattern:
        return F.lit(0).cast("long")
    return F.regexp_count(text, F.lit(_ahead(pattern, case_insensitive))).cast("long")


def hits(docs: DataFrame, key: str, pattern: str, text: str = "text", case_insensitive: bool = False, max_results: int = 0) -> DataFrame:
    """A row for each overlapping hit: key, char_start, char_end, matched_text; the first max_results of a document (0: all).

    The hits of a text are one array in its own row, so nothing is shuffled.
    Where max_results are asked for, the text is cut before its first hits and
    the parts' running length is where they start; all hits are found by one
    pass of an Arrow function, as their number is not bounded.
    """
    n = len(pattern)
    if not n:
        return docs.select(key, F.lit(0).cast("long").alias("char_start"), F.lit(0).cast("long").alias("char_end"), F.col(text).alias("matched_text")).limit(0)
    if not max_results:
        return _found(docs, key, re.escape(pattern), text, case_insensitive, 0)
    whole = F.col(text)
    starts = F.aggregate(
        F.split(whole, _ahead(pattern, case_insensitive), max_results + 2),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, part: F.struct((acc["at"] + F.length(part)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    at_once = whole.rlike(("(?iu)" if case_insensitive else "") + r"\A" + _quoted(pattern))
    own = F.slice(starts, F.when(at_once, 1).otherwise(2), F.lit(max_results))
    found = F.transform(own, lambda k: F.struct(k.cast("long").alias("char_start"), (k + n).cast("long").alias("char_end"), F.substr(whole, k + 1, F.lit(n)).alias("matched_text")))
    return docs.select(key, F.explode(found).alias("h")).select(key, "h.*")


#: Classes of the search dialect, as Java (and RE2) and as Python write them.
_CLASSES = {
    "java": {"d": "[0-9]", "D": "[^0-9]", "w": r"[\p{L}\p{N}_]", "W": "[^a-zA-Z0-9_]", "s": r"[\s\p{Z}]", "S": r"[^ \t\n\r]"},
    "python": {"d": "[0-9]", "D": "[^0-9]", "w": r"\w", "W": "[^a-zA-Z0-9_]", "s": r"\s", "S": r"[^ \t\n\r]"},
}


def translate_pattern(pattern: str, dialect: str = "java") -> str:
    """A pattern of the search dialect in another one.

    The dialect has literals, '.', \\d \\D \\w \\W \\s \\S, classes, * + ? {n} {n,m} and
    alternation; parentheses, ^ and $ are literals. A malformed class or brace
    raises ValueError.
    """
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            nxt = pattern[at + 1 : at + 2]
            if not nxt:
                raise ValueError("nothing after a backslash")
            out.append(_CLASSES[dialect].get(nxt) or re.escape(nxt))
            at += 2
        elif c == "[":
            end = pattern.find("]", at + (3 if pattern[at + 1 : at + 2] == "^" else 2))
            if end < 0:
                raise ValueError("class without end")
            body = pattern[at + 1 : end]
            lead = "^" if body.startswith("^") else ""
            out.append("[" + lead + re.sub(r"[\[\]&^]", lambda m: "\\" + m[0], body[len(lead) :]) + "]")
            at = end + 1
        elif c == "{":
            m = re.match(r"\{(\d+)(,(\d*))?\}", pattern[at:])
            if not m or not out:
                raise ValueError("malformed count")
            out.append(m[0])
            at += len(m[0])
        else:
            out.append(c if c in "*+?|" else r"[^\n]" if c == "." else re.escape(c))
            at += 1
    return "".join(out)


def count_pattern(text: Column, pattern: str, case_insensitive: bool = False) -> Column:
    """Hits of a pattern that do not overlap."""
    return F.regexp_count(text, F.lit(("(?i)" if case_insensitive else "") + translate_pattern(pattern))).cast("long")


def pattern_hits(docs: DataFrame, key: str, pattern: str, text: str = "text", case_insensitive: bool = False, max_results: int = 0) -> DataFrame:
    """A row for each start at which a pattern matches (hits may overlap): key, char_start, char_end, matched_text."""
    return _found(docs, key, translate_pattern(pattern, "python"), text, case_insensitive, max_results)


def _found(docs: DataFrame, key: str, source: str, text: str, case_insensitive: bool, max_results: int) -> DataFrame:
    compiled = re.compile(f"(?=({source}))", re.IGNORECASE if case_insensitive else 0)

    @F.arrow_udf("array<struct<char_start:long,char_end:long,matched_text:string>>")
    def find(texts):
        import pyarrow as pa

        starts, ends, own, offsets = [], [], [], [0]
        for t in texts:
            for m in compiled.finditer(t.as_py() or ""):
                if m[1]:
                    starts.append(m.start(1))
                    ends.append(m.end(1))
                    own.append(m[1])
                    if max_results and len(own) - offsets[-1] == max_results:
                        break
            offsets.append(len(own))
        rows = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(own, pa.string())], names=["char_start", "char_end", "matched_text"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return docs.select(key, F.explode(find(F.col(text))).alias("h")).select(key, "h.*")
