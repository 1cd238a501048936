"""Column functions that read records out of free text: names, periods, contacts, metadata, links, code."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import content_hash, strip, trimmed, unescaped

# The forms of periods, addresses and labels in records.
PERIOD = r"(?i)20\d{2}(?:\s*[./年\-]\s*\d{1,2}\s*月?)?\s*[-~—–至到]\s*(?:20\d{2}(?:\s*[./年\-]\s*\d{1,2}\s*月?)?|至今|现在|present|now)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# a date behind a number, such as P1380000 2010.07, is no part of a phone number
PHONE = r"1(?<!\d1)[3-9]\d(?:[\s-]?\d{4}){2}(?![./]?\d)"
WEB = r"(?:https?://\S+|(?:github|gitee)\.com/[\w./-]+)"
NAME_LABEL = r"姓\s*名\s*[:：]\s*([^\s,，|｜/／]{2,6})"
PLACE_LABEL = r"(?:现居|居住地|所在地|城市|所在城市)\s*[:：]?\s*([^\s,，|｜/／]{2,8})"
TITLE_LABEL = r"(?:岗位|职位|职务)(?:名称)?\s*[:：]\s*([^\n|｜,，]{2,30})"
COMPANY_LABEL = r"公司(?:名称)?\s*[:：]\s*([^\n|｜,，]{2,30})"
PREFERRED = ["加分", "优先", "nice to have", "bonus", "锦上添花"]
# Elements whose content is never shown, host names that are local.
HIDDEN = ["script", "style", "noscript", "template", "iframe", "object", "embed", "form"]
LOCAL_NAMES = ["localhost", "localhost.localdomain", "metadata.google.internal"]
LOCAL_SUFFIXES = [".localhost", ".local", ".localdomain", ".internal", ".cluster.local"]
# What gives programming languages away, in order of preference.
CODE_HINTS: dict[str, list[str]] = {
    "python": [r"(?m)^\s*def\s+\w+\s*\(", r"(?m)^\s*(?:class|import|from)\s+\w+", r"\bself\b", r"(?m):\s*$"],
    "java": [r"\bpublic\s+(?:static\s+)?(?:class|void|int|boolean|String)\b", r"\bSystem\.out\b", r"\bprivate\s+\w+", r"\b(?:int\[\]|List<|Map<|new\s+\w+\[)"],
    "javascript": [r"\b(?:const|let)\s+\w+\s*=", r"=>", r"\bfunction\s+\w+\s*\(", r"\bconsole\.log\b"],
    "cpp": [r"#include\s*<", r"\bstd::", r"\bvector\s*<", r"\busing\s+namespace\s+std\b"],
    "go": [r"(?m)^\s*package\s+\w+", r"\bfunc\s+\w+\s*\(", r":="],
}
# What a review of code looks for; the language that a rule is for, or none for all.
CODE_RULES: list[tuple[str, str, str]] = [
    ("shared_default", "python", r"def\s+\w+\s*\([^)]*=\s*[\[{]"),
    ("range_of_length", "python", r"range\s*\(\s*len\s*\("),
    ("endless_loop", "", r"\bwhile\s+True\s*:"),
    ("string_identity", "java", r'"[^"\n]*"\s*==|==\s*"[^"\n]*"'),
    ("loose_equality", "javascript", r"(?<![=!<>])==(?!=)|(?<![=!<>])!=(?!=)"),
    ("flushed_output", "cpp", r"\bstd::endl\b"),
    ("size_in_condition", "cpp", r"for\s*\([^)]*\.size\s*\(\s*\)"),
]
MEMORY_HINTS = ["lru_cache", "@cache", "memo", "dp[", "dp ="]
_HAN = r"[\x{4e00}-\x{9fff}]"
Names = Mapping[str, Sequence[str]]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _quoted(words: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 or c == " " else "\\" + c for c in words)


def _has_han(word: str) -> bool:
    return any("一" <= c <= "鿿" for c in word)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it is used.

    Spark puts a column's expression wherever the column is used, and doesn't share what
    stands in lambdas and branches; a variable of a lambda holds a value.
    """
    return F.get(F.transform(F.array(value), lambda held: use(held)), F.lit(0))


def has_match(text: Column, pattern: str) -> Column:
    """Like ``rlike``, for lambdas: there, rlike decodes its pattern anew for each value."""
    return F.regexp_instr(text, F.lit(pattern)) > 0


def _place(low: Column, alias: str) -> Column:
    """Where an alias begins, 0 or null if nowhere. One with Han characters may stand anywhere, others by themselves."""
    at = F.instr(low, alias)
    if not _has_han(alias):  # a plain search is much faster than a pattern, and most texts lack most aliases
        at = F.when(F.contains(low, F.lit(alias)), F.regexp_instr(low, F.lit(f"(?<![a-z0-9+#]){_quoted(alias)}(?![a-z0-9+#])")))
    return at


def _first(places: list[Column]) -> Column:
    return F.array_min(F.filter(F.array(*places), lambda at: at > 0))


def _in_order(places: list[tuple[str, Column]]) -> Column:
    rows = F.array(*(F.struct(at.alias("at"), F.lit(name).alias("name")) for name, at in places))
    return F.transform(F.array_sort(F.filter(rows, lambda x: x["at"] > 0)), lambda x: x["name"])


def found_names(text: str | Column, names: Names) -> Column:
    """Names of which an alias stands in a text, in the order of their first places."""
    return once(F.lower(F.coalesce(_c(text), F.lit(""))), lambda low: _in_order([(name, _first([_place(low, a) for a in aliases])) for name, aliases in names.items()]))


def found_words(text: str | Column, words: Sequence[str], fold: bool = True) -> Column:
    """Words that occur anywhere in a text, in the order of their first places."""
    text = F.coalesce(_c(text), F.lit(""))
    return once(F.lower(text) if fold else text, lambda t: _in_order([(w, F.instr(t, w.lower() if fold else w)) for w in words]))


def canonical(name: str | Column, names: Names) -> Column:
    """The first name that equals a string without regard to case, or has an alias in it; else the string itself."""
    bare = strip(name)
    low = F.lower(bare)
    out = None
    for known, aliases in names.items():
        hit = low == known.lower()
        for a in aliases:
            hit = hit | (F.coalesce(_place(low, a), F.lit(0)) > 0)
        out = F.when(hit, known) if out is None else out.when(hit, known)
    return bare if out is None else out.otherwise(bare)


def external_text(markup: str | Column, max_chars: int) -> Column:
    """Bounded plain text of untrusted markup.

    Nothing is left of what stands within hidden elements, however deep they are nested: each
    opening tag of one counts up, each closing tag counts down, and text is kept where the
    count is zero. Within script and style only their own end counts as a tag. Other tags
    become blanks; entities are resolved, control characters and runs of blanks become one
    blank. Line feeds stay. Texts without hidden elements take no Python.
    """
    text = F.coalesce(_c(markup).cast("string"), F.lit(""))
    hidden = once(text, lambda t: F.when(t.rlike(rf"(?i)</?({'|'.join(HIDDEN)})\b") & t.contains("<") & t.contains(">"), t))

    def read(x: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(x["text"], r"(?s)<!--.*?-->", " "), _TAG, " ")
        bare = F.when(~(x["text"].contains("<") & x["text"].contains(">")), x["text"]).otherwise(F.coalesce(x["shown"], plain))
        flat = F.regexp_replace(F.regexp_replace(unescaped(bare), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), r"[ \t]+", " ")
        return F.substr(strip(flat), F.lit(1), F.lit(max(0, max_chars)))

    return once(F.struct(text.alias("text"), _shown(hidden).alias("shown")), read)  # a function in Python can't stand in a lambda


_TAG = r"""<[A-Za-z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[A-Za-z/!?][^>]*+>"""
_MARKUP = re.compile(r"""<!--.*?-->|<(/?)([A-Za-z][^\s/>]*)(?:[^>"']|"[^"]*"|'[^']*')*>|<[A-Za-z/!?][^>]*>""", re.DOTALL)
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("script", "style")}


def shown_text(markup: str) -> str:
    """What stands outside of hidden elements, with blanks for tags."""
    out, depth, at = [], 0, 0
    while found := _MARKUP.search(markup, at):
        if not depth:
            out.append(markup[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if name in HIDDEN and found[1]:
            depth = max(0, depth - 1)
        elif name in HIDDEN and not found[0].endswith("/>"):
            depth += 1
            if name in _RAW_ENDS:
                end = _RAW_ENDS[name].search(markup, at)
                at, depth = (end.end(), depth - 1) if end else (len(markup), depth)
    return " ".join([*out, *[markup[at:]] * (not depth)])


@F.pandas_udf(T.StringType())
def _shown(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(shown_text, na_action="ignore")


def first_given(raw: str | Column, keys: Sequence[str]) -> Column:
    """The first of several keys of a JSON object that isn't empty."""
    return F.get(F.filter(F.array(*(F.get_json_object(_c(raw), f"$.{k}") for k in keys)), lambda v: v != ""), F.lit(0))


def json_string(value: Column) -> Column:
    """A string as JSON, quoted and escaped."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def stable_json(fields: Column) -> Column:
    """A map of strings as JSON with sorted keys, with a blank behind commas and colons."""
    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(json_string(e["key"]), F.lit(": "), F.coalesce(json_string(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def metadata_digest(fields: Column, length: int = 20) -> Column:
    """A hash of a map that doesn't depend on the order of its keys; empty for none."""
    return F.when(F.coalesce(F.size(fields), F.lit(0)) <= 0, "").otherwise(content_hash(stable_json(fields), length))


def scalar_metadata(fields: Column) -> Column:
    """A map without null values."""
    return F.map_filter(fields, lambda _, v: v.isNotNull())


@F.pandas_udf(T.StringType())
def _compatible(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:  # Spark has no function for this normal form
        yield part.str.normalize("NFKC")


def company_key(name: str | Column) -> Column:
    """A key under which spellings of one name meet: compatible characters, no white space, small letters."""
    text = external_text(name, 200)
    plain = F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(_compatible(text))
    return F.lower(F.regexp_replace(plain, r"\s+", ""))


def company_id(key: str | Column) -> Column:
    """company: with what of the key can stand in an id, or else its hash."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(_c(key)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("company:"), F.when(slug != "", F.substr(slug, F.lit(1), F.lit(72))).otherwise(content_hash(key, 20)))


def periods(text: str | Column) -> Column:
    """Periods such as 2021.07-2023.06, without blanks and with a hyphen between their ends."""
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(PERIOD), F.lit(0))
    return F.transform(found, lambda p: F.regexp_replace(F.translate(p, "—–~ \t\n\x0b\f\r", "---"), r"[至到](?=20\d{2})", "-"))


def _year_parts(part: Column) -> tuple[Column, Column]:
    form = r"^(20\d{2})(?:\D{0,2}(\d{1,2}))?"
    month = once(F.regexp_extract(part, form, 2).try_cast("int"), lambda m: F.when(m.between(1, 12), m).otherwise(1))
    return F.regexp_extract(part, form, 1).try_cast("int"), (month - 1) / F.lit(12.0)


def _year(part: Column) -> Column:
    year, share = _year_parts(part)
    return year + share


def period_bounds(period: str | Column, as_of: Column) -> Column:
    """struct<low, high> of a period in years; an open end is ``as_of``, and what can't be read is null."""
    now = F.year(as_of) + (F.month(as_of) - 1) / F.lit(12.0)

    def read(ends: Column) -> Column:
        high = once(trimmed(F.get(ends, F.lit(1))), lambda end: F.when(end.isin("至今", "现在", "present", "now"), now).otherwise(_year(end)))
        return F.struct(_year(trimmed(F.get(ends, F.lit(0)))).alias("low"), high.alias("high"))

    def both(x: Column) -> Column:
        good = x["low"].isNotNull() & x["high"].isNotNull()
        return F.struct(F.when(good, x["low"]).alias("low"), F.when(good, x["high"]).alias("high"))

    def ends(p: Column) -> Column:  # a split would compile its pattern for each period
        at = F.regexp_instr(p, F.lit("[-~—–]"))
        return once(at, lambda at: F.when(at > 0, F.array(F.substr(p, F.lit(1), at - 1), F.substr(p, at + 1))).otherwise(F.array(p)))

    return once(once(once(_c(period), ends), read), both)


def span_years(found: Column, as_of: Column) -> Column:
    """Years from the first start to the last end of an array of periods, to a tenth; null if none can be read."""
    bounds = F.filter(F.transform(found, lambda p: period_bounds(p, as_of)), lambda b: b["low"].isNotNull())
    years = lambda b: F.array_max(F.transform(b, lambda x: x["high"])) - F.array_min(F.transform(b, lambda x: x["low"]))
    return once(once(bounds, years), lambda n: F.when(n.isNotNull(), F.round(F.greatest(F.lit(0.0), n), 1)))


def period_years(period: str | Column, as_of: Column) -> Column:
    """How many years a period takes; null if it can't be read.

    The start's year and its share of a year are taken off one after the other, as SQL does,
    so that sums agree to the last bit and a quarter of a year is rounded alike.
    """
    start = strip(F.get(F.split(_c(period), "[-~—–]", 2), F.lit(0)))
    year, share = _year_parts(start)
    return period_bounds(period, as_of)["high"] - year - share


def _lines(text: Column, limit: int = -1) -> Column:
    return F.split(text, r"\r\n|\r|\n", limit)


def _head(text: Column, n: int) -> Column:
    """The first n lines, without a split of what follows."""
    return F.array_join(F.slice(_lines(text, n + 1), 1, n), "\n")


def contact(text: str | Column, cities: Sequence[str]) -> Column:
    """struct<email, phone, website, name, location>: the first of each in a text, null where there is none."""
    text = F.coalesce(_c(text), F.lit(""))
    given = lambda x: once(x, lambda v: F.nullif(v, F.lit("")))
    found = lambda signs, pattern, group=0: F.when(reduce(or_, (F.contains(text, F.lit(s)) for s in signs)), F.regexp_extract(text, pattern, group))
    bare = F.transform(F.slice(_lines(text, 7), 1, 6), lambda x: strip(F.regexp_replace(x, r"^[\s\-*•·●▪◦>#]+", "")))
    named = F.filter(bare, lambda x: x.rlike(f"^{_HAN}{{2,4}}$") & ~x.rlike("简历|个人|求职"))
    near = found_words(_head(text, 12), cities, fold=False)
    return F.struct(
        given(found(["@"], EMAIL)).alias("email"),
        given(F.regexp_replace(F.regexp_extract(text, PHONE, 0), r"[\s-]", "")).alias("phone"),
        given(F.regexp_replace(found(["://", ".com/"], WEB), "[。，,;；]+$", "")).alias("website"),
        F.coalesce(given(found(["姓"], NAME_LABEL, 1)), F.get(named, F.lit(0))).alias("name"),
        F.coalesce(given(found(["居", "所在地", "城市"], PLACE_LABEL, 1)), F.get(near, F.lit(0))).alias("location"),
    )


def posting(text: str | Column, names: Names, cities: Sequence[str], preferred: Sequence[str] = PREFERRED, title: str | Column = "", company: str | Column = "", city: str | Column = "") -> Column:
    """struct<title, company, city, required, preferred> of a job text; hints win over what the text says.

    Names on lines with a mark of preference are preferred, all others required. The first
    ten lines say the city, or else the whole text.
    """
    hint = lambda x: F.when(strip(F.lit(x) if isinstance(x, str) else x) != "", strip(F.lit(x) if isinstance(x, str) else x))
    said = lambda given, text, label: F.coalesce(hint(given), strip(F.regexp_extract(text, label, 1)))

    def read(text: Column) -> Column:
        marked = F.filter(_lines(text), lambda x: F.lower(x).rlike("|".join(map(_quoted, preferred))))
        near, anywhere = found_words(_head(text, 10), cities, fold=False), found_words(text, cities, fold=False)
        both = F.struct(found_names(F.array_join(marked, "\n"), names).alias("wanted"), found_names(text, names).alias("every"))
        return once(
            both,
            lambda found: F.struct(
                said(title, text, TITLE_LABEL).alias("title"),
                said(company, text, COMPANY_LABEL).alias("company"),
                F.coalesce(hint(city), F.get(near, F.lit(0)), F.get(anywhere, F.lit(0)), F.lit("")).alias("city"),
                F.array_except(found["every"], found["wanted"]).alias("required"),
                F.filter(found["every"], lambda x: F.array_contains(found["wanted"], x)).alias("preferred"),
            ),
        )

    return once(F.coalesce(_c(text), F.lit("")), read)


def code_language(code: str | Column, hints: Mapping[str, Sequence[str]] = CODE_HINTS) -> Column:
    """The language with the most hints in a text, the first of equals; empty without any."""
    code = F.coalesce(_c(code), F.lit(""))
    scores = []
    for i, (name, patterns) in enumerate(hints.items()):
        hits = F.lit(0)
        for p in patterns:
            hits = hits + F.when(code.rlike(p), 1).otherwise(0)
        scores.append(F.struct(hits.alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.when(best["hits"] > 0, best["name"]).otherwise("")


def loop_depth(code: str | Column) -> Column:
    """The deepest nesting of for and while lines by their indentation.

    A line closes the loops that are indented as far as itself or further. Empty lines and
    comments don't count.
    """
    lines = F.split(F.coalesce(_c(code), F.lit("")), r"\r\n|\r|\n")
    lines = F.filter(lines, lambda x: ~x.rlike(r"^\s*(#|$)"))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("deepest"))

    def step(acc: Column, line: Column) -> Column:
        indent = F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))
        still = F.filter(acc["open"], lambda x: x < indent)
        still = F.when(line.rlike(r"^\s*(?:for|while)\b"), F.concat(still, F.array(indent))).otherwise(still)
        return F.struct(still.alias("open"), F.greatest(acc["deepest"], F.size(still)).alias("deepest"))

    return F.aggregate(lines, start, step, lambda acc: acc["deepest"])


def code_findings(code: str | Column, language: str | Column) -> Column:
    """Names of what a review finds, in alphabetical order. Rules of Python hold for code of no known language too.

    Besides ``CODE_RULES``: loops within loops, and functions that call themselves without
    remembering results. A loop without end is no finding where the code breaks out of it.
    """
    code, language = F.coalesce(_c(code), F.lit("")), _c(language)
    found = []
    for name, kind, pattern in CODE_RULES:
        hit = code.rlike(pattern)
        if kind:
            hit = hit & (language.isin("python", "") if kind == "python" else language == kind)
        if name == "endless_loop":
            hit = hit & ~code.contains("break")
        found.append(F.when(hit, name))
    found.append(F.when(loop_depth(code) >= 2, "nested_loops"))
    called = F.exists(F.regexp_extract_all(code, F.lit(r"(?m)^\s*def\s+(\w+)\s*\("), F.lit(1)), lambda f: F.regexp_count(code, F.concat(F.lit(r"\b"), f, F.lit(r"\s*\("))) >= 2)
    remembers = F.lit(False)
    for hint in MEMORY_HINTS:
        remembers = remembers | code.contains(hint)
    found.append(F.when(called & ~remembers & language.isin("python", ""), "plain_recursion"))
    return F.array_sort(F.array_compact(F.array(*found)))


def entry_parts(line: str | Column) -> Column:
    """The parts of a heading of an entry, without its periods."""
    bare = strip(F.regexp_replace(_c(line), PERIOD, " "))
    marks = "|｜/／·•，;； \t\n\x0b\f\r"
    return F.filter(F.split(F.translate(bare, marks, "," * len(marks)), ","), lambda x: x != "")


def company_and_title(line: str | Column, title_words: Sequence[str], company_marks: Sequence[str]) -> Column:
    """struct<company, title> of a heading: the first part with a word of titles, and the first other part with a mark of companies, or else the first other part."""
    has = lambda words: (lambda x: has_match(F.lower(x), "|".join(_quoted(w.lower()) for w in words)))
    first = lambda parts: F.coalesce(F.get(parts, F.lit(0)), F.lit(""))

    def read(x: Column) -> Column:
        others = F.filter(x["parts"], lambda p: p != x["title"])
        return F.struct(once(others, lambda o: F.coalesce(F.get(F.filter(o, has(company_marks)), F.lit(0)), first(o))).alias("company"), x["title"].alias("title"))

    titled = once(entry_parts(line), lambda parts: F.struct(parts.alias("parts"), first(F.filter(parts, has(title_words))).alias("title")))
    return once(titled, read)


def resume(text: str | Column, names: Names, cities: Sequence[str], as_of: Column) -> Column:
    """struct<contact, skills, periods, years>: years reach from the first start to the last end, null without periods."""
    found = periods(text)
    return F.struct(contact(text, cities).alias("contact"), found_names(text, names).alias("skills"), found.alias("periods"), span_years(found, as_of).alias("years"))


def bounded_text(text: str | Column, max_lines: int = 200, max_bytes: int = 25_000) -> Column:
    """struct<text, truncated>: the first lines of a text, cut to so many bytes at the end of a line if there is one."""
    lines = F.split(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\r\n?", "\n"), "\n")
    # a line feed at the end begins no line
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    head = F.array_join(F.slice(lines, 1, max_lines), "\n")
    raw = F.encode(head, "UTF-8")
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, max_bytes).cast("string")), r"�+\z", "")
    cut = F.when(F.regexp_replace(cut, r"(?s)\n[^\n]*\z", "") != "", F.regexp_replace(cut, r"(?s)\n[^\n]*\z", "")).otherwise(cut)
    long = F.octet_length(head) > max_bytes
    return F.struct(F.when(long, cut).otherwise(head).alias("text"), (long | (F.size(lines) > max_lines)).alias("truncated"))


def mention_ids(value: str | Column) -> Column:
    """Ids of a JSON list of mentions: strings, or objects with id, userId or _id."""
    items = F.from_json(_c(value), "array<string>")

    def one(x: Column) -> Column:
        keyed = F.coalesce(*(F.when(strip(F.get_json_object(x, f"$.{k}")) != "", strip(F.get_json_object(x, f"$.{k}"))) for k in ("id", "userId", "_id")))
        return F.when(x.rlike(r"^\s*\{"), keyed).otherwise(F.when(strip(x) != "", strip(x)))

    return F.coalesce(F.array_compact(F.transform(items, one)), F.array().cast("array<string>"))


def selected_paths(text: str | Column) -> Column:
    """Paths of a reply: a JSON list, an object with such a list under paths, or one for each line, perhaps behind a dash."""
    bare = strip(text)
    as_list = F.when(bare.rlike(r"^\["), F.from_json(bare, "array<string>"))
    as_object = F.when(bare.rlike(r"^\{"), F.from_json(F.get_json_object(bare, "$.paths"), "array<string>"))
    lines = F.transform(F.filter(F.split(bare, r"\r\n|\r|\n"), lambda x: strip(x) != ""), lambda x: strip(F.regexp_replace(x, "^[- ]+|[- ]+$", "")))
    found = F.transform(F.coalesce(as_list, as_object), strip)
    return F.when(found.isNotNull(), F.filter(found, lambda x: x != "")).when(bare.rlike(r"^[\[{]"), F.array().cast("array<string>")).otherwise(lines)


def json_object(text: str | Column) -> Column:
    """What stands from the first brace to the last one, or the text itself."""
    bare = strip(text)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(bare)


def url_problem(url: str | Column) -> Column:
    """Why an address may not be fetched, or null: scheme, host, credentials, address, local, label."""
    url = _c(url)
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(authority, r"(?:^|@)(\[[^\]]*\]|[^@:\[\]]*)(?::\d*)?$", 1), r"^\[|\]$", ""), r"\.+$", ""))
    four = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inner = host.rlike(r"^(0|10|127)\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.0\.[02]\.|^192\.168\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\.|^2(2[4-9]|[3-5]\d)\.")
    six = host.contains(":")
    local = host.isin(LOCAL_NAMES)
    for suffix in LOCAL_SUFFIXES:
        local = local | host.endswith(suffix)
    return (
        F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme")
        .when((authority == "") | (host == ""), "host")
        .when(authority.rlike("^[^@]+@") & ~authority.rlike("^:?@"), "credentials")
        .when((four & inner) | (six & ~host.rlike("^[23][0-9a-f]{3}:") | host.rlike("^2001:(0?db8|0{0,4}:)")), "address")
        .when(local, "local")
        .when(~four & ~six & ~host.contains("."), "label")
    )


def thousands(low: str | Column, high: str | Column, months: str | Column) -> Column:
    """A monthly range such as 25-40K, with the months of a year unless they are twelve."""
    show = lambda x: F.bround(_c(x) / 1000).cast("long").cast("string")
    more = F.when(_c(months).isNotNull() & ~_c(months).isin(0, 12), F.concat(F.lit("·"), _c(months).cast("string"), F.lit("薪"))).otherwise("")
    return F.concat(show(low), F.lit("-"), show(high), F.lit("K"), more)


def score_bar(score: str | Column, width: int = 18) -> Column:
    """A bar of a score from 0 to 100 with the number behind it."""
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(_c(score).cast("double"), F.lit(0.0))))
    filled = F.bround(value / 100 * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), width - filled), F.lit("] "), F.format_string("%5.1f", value))


def record_text(fields: Sequence[tuple[str, str | Column]], body: str | Column) -> Column:
    """A line for each labelled field, an empty line, and the body."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(_c(value).cast("string"), F.lit(""))) for label, value in fields]
    return strip(F.concat_ws("\n", *lines, F.lit(""), F.coalesce(_c(body), F.lit(""))))


def route_fit(interests: Column, title: Column, skills: Column, routes: Names) -> Column:
    """(route, fit, hits) of every route: 50, 10 for each key word among interests, and 8 for one in the title or else 3 among skills; 0 to 100."""
    interests, title, skills = F.lower(interests), F.lower(title), F.lower(skills)
    out = []
    for route, words in routes.items():
        fit, hits = F.lit(50), F.lit(0)
        for w in words:
            in_title, in_skills = title.contains(w), skills.contains(w)
            fit = fit + F.when(interests.contains(w), 10).otherwise(0) + F.when(in_title, 8).when(in_skills, 3).otherwise(0)
            hits = hits + F.when(interests.contains(w), 1).otherwise(0) + F.when(in_title | in_skills, 1).otherwise(0)
        out.append(F.struct(F.lit(route).alias("route"), F.greatest(F.lit(0), F.least(F.lit(100), fit)).alias("fit"), hits.alias("hits")))
    return F.array(*out)


def visible_sections(held: Column, allowed: Column, known: Sequence[str]) -> Column:
    """struct<included, excluded>: the known sections that are allowed and hold something, and the others."""
    every = F.array(*map(F.lit, known))
    included = F.filter(every, lambda s: F.array_contains(allowed, s) & F.array_contains(held, s))
    return F.struct(included.alias("included"), F.array_except(every, included).alias("excluded"))
