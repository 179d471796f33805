"""Text functions as column expressions; each keeps to built-in functions unless it says otherwise."""

from __future__ import annotations

import bisect
import difflib
import functools
import re
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def lit_list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def project_path(encoded: Column) -> Column:
    """Directory name of a project back to its path; anything with `..` is refused."""
    path = F.concat(F.lit("/"), F.replace(F.regexp_replace(encoded, "^-", ""), F.lit("-"), F.lit("/")))
    return F.when(encoded.contains(".."), "/invalid/path").otherwise(path)


def last_component(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def component_after(path: Column, name: str, otherwise: Column) -> Column:
    """The path component after the first one called ``name``."""
    parts = F.split(path, "/")
    return F.coalesce(F.get(parts, F.nullif(F.array_position(parts, name), F.lit(0)).cast("int")), otherwise)


def stem(path: Column) -> Column:
    return F.regexp_replace(last_component(path), r"(?<=.)\.[^.]*$", "")


def chunk_id(content: Column, session: Column, salt: Column) -> Column:
    return F.substring(F.sha2(F.concat(content, session, salt), 256), 1, 16)


def time_text(ts: Column) -> Column:
    """A UTC timestamp as `YYYY-MM-DD HH:MM:SS[.ffffff]+00:00`."""
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def scoped_id(machine: Column, chunk: Column) -> Column:
    return F.sha2(F.concat(machine, F.lit("\0"), chunk), 256)


def cut(text: Column, n: int) -> Column:
    """The first n characters, with `...` if there were more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def cut_at_word(text: Column, n: int) -> Column:
    """At most n characters, cut at the last space if it lies in the last 30 %."""
    head = F.substring(text, 1, n)
    back = F.instr(F.reverse(head), " ")
    space = F.when(back > 0, F.lit(n) - back).otherwise(-1)  # from 0
    short = F.when(space >= n * 0.7, F.left(head, space)).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(short, F.lit("...")))


def comparable(text: Column) -> Column:
    """Lower case, single spaces, no punctuation; in that order."""
    words = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    return F.regexp_replace(words, r"(?U)[^\w\s]", "")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, "[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def code_blocks(text: Column) -> Column:
    """Fenced blocks as structs of language and code."""
    pattern = F.lit(r"(?s)```(\w*)\n(.*?)```")
    both = F.zip_with(F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2), lambda a, b: F.struct(
        F.when(a == "", "text").otherwise(a).alias("language"), F.trim(b, F.lit(" \t\n\r")).alias("code")))
    return F.filter(both, lambda x: x["code"] != "")


def turn(project: Column, user: Column, assistant: Column) -> Column:
    head = F.concat(F.lit("In project "), project)
    return (
        F.when((user != "") & (assistant != ""), F.concat(head, F.lit(", user asked:\n"), user, F.lit("\n\nAssistant responded:\n"), assistant))
        .when(user != "", F.concat(head, F.lit(", user asked:\n"), user, F.lit("\n\n[No assistant response]")))
        .otherwise(F.concat(head, F.lit(", assistant response:\n"), assistant))
    )


def grouped_turn(project: Column, user: Column | None, assistant: Column | None) -> Column:
    """Turn templates of the formats that gather all replies to a user."""
    head = F.concat(F.lit("In project "), project)
    if user is None:
        return F.concat(head, F.lit(", assistant responded:\n"), assistant)
    if assistant is None:
        return F.concat(head, F.lit(", user said:\n"), user)
    return F.concat(head, F.lit(", user asked:\n"), user, F.lit("\n\nAssistant responded:\n"), F.coalesce(assistant, F.lit("")))


def file_change(project: Column, path: Column, operation: Column, summary: Column, user: Column | None = None) -> Column:
    head = F.concat(F.lit("In project "), project, F.lit(", file "), path, F.lit(" was "), operation)
    if user is None:
        return F.concat(head, F.lit(".\nSummary: "), summary)
    return F.concat(head, F.lit(". "), summary, F.lit(". This was in response to: "), cut(user, fixed.USER_TEXT_IN_FILE_CHANGE))


def session_summary(project: Column, summary: Column, message: Column) -> Column:
    text = F.trim(F.coalesce(F.nullif(F.trim(summary), F.lit("")), message))
    return F.concat(F.lit("Session summary for "), project, F.lit(":\n"), text)


def shell_operation(command: Column) -> Column:
    """The first file operation that a shell command shows: struct of file_path, operation, summary."""
    found = []
    for pattern, operation, summary in fixed.SHELL_OPERATIONS:
        group = re.compile(pattern.replace("?<", "?P<")).groupindex["path"]
        path = F.regexp_extract(command, pattern, group)
        found.append(F.when(path != "", F.struct(path.alias("file_path"), F.lit(operation).alias("operation"), F.lit(summary).alias("summary"))))
    return F.coalesce(*found)


def patch_operations(patch: Column, headers: list[tuple[str, str, str]] = fixed.PATCH_HEADERS) -> Column:
    """File operations named by the header lines of a patch."""

    def parsed(line: Column) -> Column:
        told = None
        for head, operation, summary in headers:
            row = F.struct(F.trim(F.substring(line, len(head) + 1, 1 << 30)).alias("file_path"), F.lit(operation).alias("operation"), F.lit(summary).alias("summary"))
            told = F.when(line.startswith(head), row) if told is None else told.when(line.startswith(head), row)
        return told

    return F.array_compact(F.transform(F.split(patch, r"\R"), parsed))


def redact_url(url: Column) -> Column:
    """A URL without user and password; the host in lower case then."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@[^/?#:]*(.*)$", 1)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@"), F.concat(scheme, F.lit("://"), host, rest)).otherwise(url)


def reason_text(value: Column, default: str = "unknown") -> Column:
    plain = F.trim(F.regexp_replace(value, "[^A-Za-z0-9_.:-]+", "_"), F.lit("_"))
    return F.substring(F.coalesce(F.nullif(plain, F.lit("")), F.lit(default)), 1, 120)


def client_name(value: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(value, r"[\x00-\x1f\x7f]+", " ")), 1, 256)


def file_terms(path: Column) -> Column:
    """Search terms for a file: path, name, folder, name without extension; none for unsafe paths."""
    base = F.regexp_extract(path, "[^/]*$", 0)
    folder = F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "(?<=.)/$", "")
    bare = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    terms = F.array(path, F.nullif(base, F.lit("")), F.when((folder != "") & (folder != "/"), folder), F.when((bare != "") & (bare != base), bare))
    safe = (F.trim(path) != "") & ~path.contains("..")
    return F.when(safe, F.array_distinct(F.array_compact(terms))).otherwise(F.array().cast("array<string>"))


def cache_key(query: Column, project: Column, kind: Column, limit: Column, *more: Column) -> Column:
    """Key of a cached search; every filter takes part."""
    parts = [F.trim(F.lower(query)), F.coalesce(project, F.lit("")), kind, limit.cast("string"), *[F.coalesce(m.cast("string"), F.lit("")) for m in more]]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def message_text(blocks: Column) -> Column:
    """Flatten message blocks (type, text, name, file_path, command, content) to one text."""

    def block(b: Column) -> Column:
        used = F.concat(F.lit("[Used "), b["name"])
        command = F.regexp_replace(F.substring(F.coalesce(b["command"], F.lit("")), 1, 100), "[\n\r]", " ")
        tool = (
            F.when(b["name"].isin("Read", "Edit", "Write"), F.concat(used, F.lit(" on "), F.coalesce(b["file_path"], F.lit("unknown")), F.lit("]")))
            .when(b["name"] == "Bash", F.concat(F.lit("[Ran command: "), command, F.lit("]")))
            .otherwise(F.concat(used, F.lit("]")))
        )
        short = F.length(b["content"]) < 500
        result = F.when(short, F.concat(F.lit("[Result: "), b["content"], F.lit("]"))).otherwise("[Tool result truncated]")
        return F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"] == "tool_use", tool).when(b["type"] == "tool_result", result)

    return F.array_join(F.array_compact(F.transform(blocks, block)), "\n")


def file_operations(blocks: Column) -> Column:
    """Write and edit operations of tool blocks (id, name, file_path, old_string, new_string)."""

    def op(b: Column) -> Column:
        path = F.coalesce(b["file_path"], F.lit("unknown"))
        row = lambda operation, summary: F.struct(path.alias("file_path"), F.lit(operation).alias("operation"), summary.alias("summary"), b["id"].alias("tool_id"))
        replaced = F.concat(F.lit("Replaced '"), cut(b["old_string"], 100), F.lit("' with '"), cut(b["new_string"], 100), F.lit("'"))
        edit = (b["name"] == "Edit") & b["old_string"].isNotNull() & b["new_string"].isNotNull()
        return F.when(b["type"] == "tool_use", F.when(b["name"] == "Write", row("write", F.lit("Created/overwrote file"))).when(edit, row("edit", replaced)))

    return F.array_compact(F.transform(blocks, op))


# --- Arrow functions: sequential cuts, Unicode forms and similarity have no built-in counterpart ---


_PARAGRAPH, _LINE, _SENTENCE = re.compile(r"(?=\n\n)"), re.compile(r"\n"), re.compile(r"[.!?](?= )")


def _last_within(points: np.ndarray, above: int, most: int) -> int:
    """The largest of the sorted points in (above, most], or -1."""
    k = int(np.searchsorted(points, most, "right")) - 1
    return int(points[k]) if k >= 0 and points[k] > above else -1


def split_text(text: str, most: int = fixed.SPLIT_MAX, overlap: int = fixed.SPLIT_OVERLAP) -> list[str]:
    """Overlapping parts of at most ``most`` characters, cut at paragraphs or sentences where one ends near.

    All places where a part may end are found in one pass; each part looks up
    the last that lies in its final SPLIT_SEARCH characters.
    """
    if len(text) <= most:
        return [text]
    ends = lambda pattern, past: np.fromiter((m.start() + past for m in pattern.finditer(text)), np.int64)
    paragraphs, lines, marks = ends(_PARAGRAPH, 2), ends(_LINE, 1), ends(_SENTENCE, 1)
    spans = [(0, 0)]
    while spans[-1][1] < len(text):
        begin = max(spans[-1][0] + 1, spans[-1][1] - overlap) if spans[-1][1] else 0
        last = begin + most
        if last >= len(text):
            spans.append((begin, len(text)))
            continue
        low = max(begin, last - fixed.SPLIT_SEARCH) + 1  # a break at the first place of the region does not count
        stop = _last_within(paragraphs, low + 1, last)
        if stop < 0:
            stop = max(_last_within(lines, low, last), _last_within(marks, low, last - 1))  # the blank behind a mark lies in the part's region
        spans.append((begin, stop if stop >= 0 else last))
    return [text[a:z] for a, z in spans[1:]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_parts(texts: pd.Series) -> pd.Series:
    return texts.map(split_text, na_action="ignore")


#: Characters of which a match of the second and third rule of NOISE is made, once blanks are in place, and how many it has at least.
_MADE_OF = [(b"0123456789abcdefABCDEF\t\n\r :,", 16), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", 40)]


@functools.lru_cache(1)
def _cleaning() -> tuple[np.ndarray, list[tuple[np.ndarray, int, re.Pattern, str]]]:
    """Which characters are blanked out, by their categories; of the rules within stretches of few characters, which these are, the least length, pattern and replacement."""
    gone = np.fromiter((unicodedata.category(chr(c))[0] not in fixed.KEPT_CATEGORIES for c in range(sys.maxunicode + 1)), bool)
    gone[[9, 10, 13, *range(0x20, 0x7F)]] = False
    rules = []
    for (letters, least), (pattern, put) in zip(_MADE_OF, fixed.NOISE[1:3], strict=True):
        inside = np.zeros(128, bool)
        inside[list(letters)] = True
        rules.append((inside, least, re.compile(pattern), put))
    return gone, rules


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _without_long_runs(codes: np.ndarray) -> np.ndarray:
    """Two of every character that stands four times or more in a row, lines' ends aside."""
    same = codes[1:] == codes[:-1]
    four = same[:-2] & same[1:-1] & same[2:] & (codes[3:] != 10)
    if not four.any():
        return codes
    within = np.zeros(len(codes), bool)  # third and later places of a long run
    within[2:-1] = four
    within[3:] |= four
    return codes[~within]


def clean_for_embedding(text: str) -> str:
    """Unicode NFC; letters, numbers, punctuation and marks kept; long runs, hex and base64 shortened.

    The rules of NOISE in their order. Single characters are compared as arrays; patterns go
    through stretches alone that can hold a match, as they have no other characters in them.
    """
    gone, rules = _cleaning()
    codes = _codes(text if text.isascii() else unicodedata.normalize("NFC", text))
    codes = _without_long_runs(np.where(gone[codes], np.uint32(32), codes)) if len(codes) else codes
    for inside, least, pattern, put in rules:
        edges = np.flatnonzero(np.diff(inside[np.minimum(codes, 127)], prepend=False, append=False))
        first, last = edges[::2], edges[1::2]
        long = last - first >= least
        parts, done = [], 0
        for a, z in zip(first[long].tolist(), last[long].tolist(), strict=True):
            parts += [codes[done:a], _codes(pattern.sub(put, _text(codes[a:z])))]
            done = z
        codes = np.concatenate([*parts, codes[done:]]) if parts else codes
    blank = codes == 32
    blank[1:] &= blank[:-1].copy()
    blank[:1] = False
    return _text(codes[~blank]).strip()


@F.pandas_udf(T.StringType())
def clean_text(texts: pd.Series) -> pd.Series:
    return texts.map(clean_for_embedding, na_action="ignore")


#: Common runs of up to so many characters are looked up; longer ones begin with a run of so many.
_RUN = 8


def _common_runs(a: str, b: str) -> tuple[list[int], list[int], list[dict[str, list[int]]]]:
    """Runs of characters that ``difflib`` starts matches from, that stand in both texts.

    Places in ``a`` where one begins, the most characters it may have, and by length (up to _RUN) the runs with their
    places in ``b``.
    """
    x, y = _codes(a), _codes(b)
    times = np.bincount(y, minlength=int(x.max()) + 1)
    starts = times > 0
    if len(b) >= 200:  # characters of more than a hundredth of a long text start no match
        starts &= times <= len(b) // 100 + 1
    here, there = np.flatnonzero(starts[x]).tolist(), np.flatnonzero(starts[y]).tolist()
    most: dict[int, int] = {}
    runs: list[dict[str, list[int]]] = [{}]
    for n in range(1, _RUN + 1):
        if n > 1:  # a run of n is one of n - 1 there and at the next place
            here = [i for i, k in zip(here, here[1:]) if k == i + 1]  # noqa: B905
            there = [j for j, k in zip(there, there[1:]) if k == j + 1]  # noqa: B905
        wanted = {a[i : i + n] for i in here}
        there = [j for j in there if b[j : j + n] in wanted]
        known: dict[str, list[int]] = {}
        for j in there:
            known.setdefault(b[j : j + n], []).append(j)
        here = [i for i in here if a[i : i + n] in known]
        if not here:
            break
        runs.append(known)
        most.update(dict.fromkeys(here, n))
    else:
        for i in reversed(here):
            most[i] = max(_RUN, most.get(i + 1, 0) + 1)
    places = sorted(most)
    return places, [most[i] for i in places], runs


def _equal(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters are the same from i and from j on, ``most`` at most."""
    n, step = 0, 1
    while step and n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, 2 * step
        else:
            step //= 2
            most = min(most, n + 2 * step)
    return n


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two comparable texts, as ``difflib`` has it.

    ``difflib`` starts matches of long texts from runs of rare characters only, takes the longest run, of those the
    first, and goes on to the left and to the right of the match; for each match it goes through all characters of the
    first text and all their places in the second. Here the places of common runs are known beforehand. To the left
    of a match all runs are shorter, to the right of it none is longer, so the search on the right ends with the
    first run of that length: places are gone through about as often as there are lengths, not once a match.
    """
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    places, most, runs = _common_runs(a, b)
    matched, open_ = 0, [(0, len(a), 0, len(b), len(a))]
    while open_:
        alo, ahi, blo, bhi, bound = open_.pop()
        i, j, size = alo, blo, 0
        for p in range(bisect.bisect_left(places, alo), bisect.bisect_left(places, ahi)) if bound else ():
            if most[p] <= size:
                continue
            at = places[p]
            n = min(most[p], ahi - at, bhi - blo)
            if n <= size:
                continue
            where, found = -1, 0
            if n >= _RUN:
                known = runs[_RUN][a[at : at + _RUN]]
                for k in range(bisect.bisect_left(known, blo), bisect.bisect_right(known, bhi - _RUN)):
                    z, least = known[k], max(found, size)
                    if least == n or bhi - z <= least:
                        break
                    if a[at + least] == b[z + least] and (m := _RUN + _equal(a, at + _RUN, b, z + _RUN, min(n, bhi - z) - _RUN)) > least:
                        where, found = z, m
                n = _RUN - 1
            while not found and n > size:
                known = runs[n][a[at : at + n]]
                k = bisect.bisect_left(known, blo)
                if k < len(known) and known[k] <= bhi - n:
                    where, found = known[k], n
                n -= 1
            most[p] = found or size  # in parts of these ranges it is no longer
            if found > size:
                i, j, size = at, where, found
                if size == bound:
                    break
        run = size
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        size += _equal(a, i + size, b, j + size, min(ahi - i, bhi - j) - size)
        if size:
            matched += size
            open_ += [x for x in ((alo, i, blo, j, max(run - 1, 0)), (i + size, ahi, j + size, bhi, run)) if x[0] < x[1] and x[2] < x[3]]
    return 2.0 * matched / (len(a) + len(b))


def alike(a: str, b: str, least: float, equal: bool) -> bool:
    """Whether the ratio exceeds ``least`` (or equals it); cheap upper bounds settle most pairs."""
    if not a or not b:
        return False
    matcher = difflib.SequenceMatcher(None, a, b)
    return all(r() >= least if equal else r() > least for r in (matcher.real_quick_ratio, matcher.quick_ratio, matcher.ratio))


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def comparable_text(text: str) -> str:
    return re.sub(r"[^\w\s]", "", " ".join(text.lower().split()))
