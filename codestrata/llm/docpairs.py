"""Functions paired with their documentation, without those whose documentation says nothing.

Source files are parsed by :mod:`codestrata.llm.gll`, which also finds the functions of broken files; a pair exists only for a function
that the parser found. A callable's documentation is cleaned of markers, markup, tags and directives; what is left must have wording of its own, beyond placeholders, pointers elsewhere and
the words of the callable's name. Descriptions repeated all over the corpus are templates and dropped by hash counts.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codestrata.llm import gll
from codestrata.tables import materialize, spread

CALLABLE_KINDS = ("function", "method", "constructor", "func", "def", "fn")
TEMPLATE_SHARE = 0.0005  # of all documented callables that a description must have to be a template
TEMPLATE_LEAST = 20

# Words that say nothing of a function's own.
FILLER = frozenset("""a an the of to for in on at by with from into and or is are be was it its this that these those which as given via
 function functions func fn method methods constructor routine procedure helper callable used use uses performs perform does do did will can may should
 main simple just our your new all any some each implementation implements implement called calls call handles handle executes execute
 responsible der die das den ein eine und für von zu im la le les de du des un une et pour el los las una y para o os as um uma e""".split())
PLACEHOLDER = frozenset("""todo tbd tba fixme xxx hack wip na n none null nil nothing undefined empty blank missing pending unknown undocumented uncommented placeholder
 add added write written insert enter put fill provide describe described description descriptions desc document documented documenting documentation doc docs
 docstring docstrings javadoc comment comments commented summary text here later soon yet not no goes go come comes needs need needed me be explain explains explanation what
 why how does done in details detail lorem ipsum dolor sit amet stub dummy sample example auto generated self explanatory obvious coming work progress title name
 beschreibung fehlt noch folgt dokumentation dokumentieren ergänzen à documenter compléter faire voir documentar pendiente descripción descripcion falta por completar
 descrição pendente documentado descrever opis brak uzupełnić dodać później описание будет позже дописать добавить нет документации документация""".split())
POINTER = frozenset("""see also cf same above below as ditto refer reference references header headers interface interfaces base class superclass super parent parents inherited inherit inherits
 inheritdoc overridden overrides override overriding non javadoc declaration declared definition defined spec specification docs documentation comment comments method
 siehe oben wie voir ci-dessus véase arriba ver acima zob patrz wyżej см выше issue ticket wiki readme link details more info for per идём""".split())
_EMPTY = FILLER | PLACEHOLDER | POINTER
_CJK_EMPTY = ("待补充", "待完善", "暂无", "无", "描述", "说明", "同上", "见上", "待定", "未填写", "待写")

_MARKER = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?!\w)|//+[/!<]?|#+:?(?!\w*!)|--+|;+|%+|<!--|\"\"\"|'''|r\"\"\"|=begin|=end)?[ \t]?", re.M)
_TAIL = re.compile(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$", re.M)
_DIRECTIVE = re.compile(
    r"(?i)^\s*(?:@?(?:noqa|nosec|nolint|nosonar|noinspection|ts-(?:ignore|nocheck|expect-error|check)|pylint|flake8|mypy|pyright|isort|fmt|yapf|eslint(?:-[\w-]+)?|jshint|jslint|tslint|prettier-ignore"
    r"|stylelint(?:-[\w-]+)?|clang-(?:format|tidy)|istanbul|c8|v8|rubocop|region|endregion|pragma|go:\w+|\+build|type:\s*ignore|coverage|cppcheck-suppress|resharper|suppresswarnings|phpcs|sonar|rustfmt|checkstyle|codacy|lint)"
    r"\b(?:[:\-\s(].{0,80})?|line \d+.*)$")
_DIRECTIVE_MORE = re.compile(r"(?i)^(?:pragma|lint|type|coverage|region|endregion|fmt|sonar)$")
_LICENCE = re.compile(r"(?i)spdx-license|licen[cs]ed under|all rights reserved|^\W*copyright\b|^\W*(?:\(c\)|©)\s|\blicen[cs]e\b.*\b(?:terms|applies|see)\b|^\W*\(c\) \d|permission is hereby granted|lizenziert unter")
_TODO = re.compile(r"(?i)^\W*@?(?:todo|fixme|xxx|hack|tbd)\b.*$")
_METADATA = re.compile(r"(?i)^\s*[@\\:](?:since|author|authors|version|date|copyright|license|created|modified|deprecated|category|package|module|namespace|access|public|private|protected|static|async|override|inheritdoc|internal|api|file|group|ingroup|memberof|class|constructor|function|method|name|final|abstract|virtual|readonly|hidden|ignore|see|link|todo|test|generated|suppress)\b:?.*$")
_TAG = re.compile(
    r"(?i)^\s*(?:[@\\](?:param|arg|argument|tparam|prop|property|field)(?:\[[\w,]+\])?\s*(?:\{[^}]*\})?\s*[\w.$\[\]=*&]*|:(?:param|arg|argument|parameter|key|keyword|raises?|except|exception|type|vartype|var|ivar|rtype|return|returns|yields?)\b[^:\n]*:"
    r"|[@\\](?:returns?|retval|result|yields?|throws?|exception|raises?)\b\s*(?:\{[^}]*\})?|[@\\](?:brief|details|short|note|remarks?|summary|desc|description|warning|pre|post|invariant|example|sa|see|type|typedef|template)\b\s*(?:\{[^}]*\})?)\s*[-:–—]*\s*")
_TYPE_TAG = re.compile(r"(?i)^\s*(?::(?:type|rtype|vartype)\b[^:\n]*:|[@\\](?:type|typedef|template)\b).*$")
_THROWS = re.compile(r"(?i)^\s*[@\\](?:throws?|exception|raises?)\b")
_SECTION = re.compile(r"(?i)^\s*(?:args|arguments|params|parameters|returns?|yields?|raises|throws|exceptions?|examples?|notes?|attributes|see also|side effects|inputs?|outputs?|return value)\s*:?\s*$")
_ITEM = re.compile(r"^\s*[*-]?\s*(\w+)\s*(?:\([^)]*\))?\s*:\s*(.*)$")
_XML_PARAM = re.compile(r"(?i)<(?:param|typeparam|exception|see|seealso|paramref|inheritdoc)\b[^>]*?/?>")
_MARKUP = re.compile(r"<!--|-->|</?[A-Za-z][^<>]*>|\{@\w+[^}]*\}|&(?:\w+|#\d+);|!\[[^\]]*\]\([^)]*\)|[`*_~]{1,3}(?=\w)|(?<=\w)[`*_~]{1,3}")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
_CODE_LINE = re.compile(
    r"^\s*(?:(?:return|if|else|for|while|switch|case|break|continue|var|let|const|int|auto|float|double|bool|string|def|fn|func|function|import|from|include|using|print|throw|raise|try|new|delete|yield|assert|pass)\b.*[;{}()=:]\s*.*"
    r"|[\w.$>\[\]-]+\s*(?:\+=|-=|\*=|/=|:=|=)\s*\S.*|[\w.$:>-]+\(.*\)\s*[;{]?|.*[;{}]|[{}()\[\];]+)\s*$")


def _is_code(line: str) -> bool:
    """A line of disabled code rather than of prose."""
    if not _CODE_LINE.match(line):
        return False
    return not re.search(r"(?:[^\W\d_]{2,},? ){4,}", re.sub(r"[\"'][^\"']*[\"']", "", line)) or bool(re.search(r"[;{}]\s*$", line) and re.search(r"[=(]", line))


def stem(word: str) -> str:
    """A crude stem, enough to tell 'closes', 'closing' and 'closed' from other words but not from 'close'."""
    w = word.lower()
    for end in ("isations", "izations", "isation", "ization", "ations", "ation", "ators", "ator", "ings", "ing", "ments", "ment", "ions", "ion", "iers", "ier", "ies", "ied", "ers", "ors", "er", "or", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)]
            break
    w = w.rstrip("eyi") if len(w) > 3 else w
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def name_stems(name: str | None) -> set[str]:
    parts = [p.lower() for p in _PARTS.findall(name or "")]
    return {stem(p) for p in parts} | {stem("".join(parts)), *parts}


def wording(doc: str) -> tuple[list[str], str]:
    """The lines of a documentation comment that are wording, and the same as clean text.

    Comment markers, rules, markup, directives, licence lines, to-do notes, tags without wording and disabled code are gone; wording behind a tag stays.
    """
    text = _TAIL.sub("", _MARKER.sub("", doc.replace("\r\n", "\n").replace("\r", "\n")))
    text = _XML_PARAM.sub("", text)
    kept: list[str] = []
    section = False
    for line in text.split("\n"):
        raw = line.strip()
        if not raw:
            section = False
            continue
        if _DIRECTIVE.match(raw) or _LICENCE.search(raw) or _TODO.match(raw) or _TYPE_TAG.match(raw):
            continue
        if _SECTION.match(raw):
            section = True
            continue
        body, about = raw, None
        tag = _TAG.match(raw)
        if tag:
            body = raw[tag.end():]
            about = re.findall(r"\w+", tag.group())[-1:]
            if _THROWS.match(raw):
                body = re.sub(r"^[\w.:]+\s*", "", body)
        elif _METADATA.match(raw):
            continue
        elif section and (item := _ITEM.match(line)):
            body, about = item[2], [item[1]]
        elif section and re.fullmatch(r"\W*\w+\W*", raw):
            continue
        body = _MARKUP.sub(" ", body)
        if not tag and _is_code(body.strip()):
            continue
        words = _WORD.findall(body)
        if about is not None and {w.lower() for w in words} - FILLER <= {w.lower() for w in about}:
            continue
        if words:
            kept.append(re.sub(r"\s+", " ", body).strip(" \t*/#"))
    return kept, "\n".join(kept)


def own_words(lines: list[str], name: str | None) -> list[str]:
    """The words that are neither filler, placeholder or pointer, nor of the name."""
    known = name_stems(name)
    plain = re.sub(r"[^\W\d]", lambda m: m.group().lower(), "".join(_PARTS.findall(name or "")))
    out = []
    for line in lines:
        for w in _WORD.findall(line):
            low = w.lower()
            if low.isdigit() or len(low) < 2 and low.isascii() or low in _EMPTY or low in _CJK_EMPTY:
                continue
            if low in known or stem(low) in known or low == plain:
                continue
            if all(len(p) < 2 or p.lower() in known or stem(p) in known or p.lower() in _EMPTY for p in _PARTS.findall(w)):
                continue
            out.append(low)
    return out


def describe(doc: str | None, name: str | None) -> str | None:
    """The clean description, or None where the documentation is empty or trivial."""
    if not doc:
        return None
    lines, text = wording(doc)
    return text if lines and own_words(lines, name) else None


def template_key(description: str, name: str | None) -> int:
    """A hash of a description with the words of the name blanked, for counting."""
    words = _WORD.findall(description.lower())
    known = name_stems(name)
    return xxhash.xxh3_64_intdigest(" ".join("*" if w in known or stem(w) in known else w for w in words)) - (1 << 63)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.column("name").to_pylist()
        found = [describe(d, n) for d, n in zip(b.column("doc").to_pylist(), names)]
        keys = [template_key(d, n) if d else None for d, n in zip(found, names)]
        columns = [b.column(c) for c in ("sid", "project", "file_id", "file", "name", "line")] + [pa.array(found, pa.string()), pa.array(keys, pa.int64())]
        out = pa.RecordBatch.from_arrays(columns, ["sid", "project", "file_id", "file", "name", "line", "description", "template"])
        yield out.filter(pa.array([d is not None for d in found], pa.bool_()))


def callables(symbols: DataFrame) -> DataFrame:
    kind: Column = F.lower(F.regexp_replace(F.coalesce("kind", F.lit("")), r"^\s+|\s+$", ""))
    return symbols.where(kind.isin(*CALLABLE_KINDS) & F.col("sid").isNotNull())


_PAIR = "sid string, project string, file_id long, file string, name string, line int, description string"


def described(symbols: DataFrame) -> DataFrame:
    """The callables with a description of their own, templates dropped; repeated rows count once."""
    source = callables(symbols).where(F.length("doc") > 0).select("sid", "project", "file_id", "file", "name", "line", "doc")
    rows = materialize(spread(source, 1).mapInArrow(_describe, _PAIR + ", template long").dropDuplicates(["sid"]), "described")
    total = source.select("sid").distinct().count()
    bound = max(TEMPLATE_LEAST, TEMPLATE_SHARE * total)
    # Each template has at least this share of all, so there are at most 1 / TEMPLATE_SHARE of them.
    templates = rows.groupBy("template").agg(F.count("*").alias("n"), F.approx_count_distinct("name").alias("names")).where(
        (F.col("n") >= bound) & (F.col("names") > 1)).select("template")
    return rows.join(F.broadcast(templates), "template", "left_anti").drop("template")


def _lines(text: str) -> str:
    """The text with every line end as one line feed, positions kept."""
    return text if "\r" not in text else re.sub(r"\r(?!\n)", "\n", text)


def _parsed(batches: Iterator[pa.RecordBatch], with_code: bool) -> Iterator[pa.RecordBatch]:
    """(file_id, name, line[, whole, code]) of the functions of each text; of several of one name on one line the first."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in _FOUND.names}
        for k, ext, text in zip(*(batch.column(c).to_pylist() for c in ("file_id", "ext", "text"))):
            if not text:
                continue
            plain, line, at = _lines(text), 1, 0
            seen: set[tuple[str, int]] = set()
            for f in gll.functions(plain, ext):
                line, at = line + plain.count("\n", at, f.start), f.start
                if (f.name, line) in seen:
                    continue
                seen.add((f.name, line))
                for c, v in zip(_FOUND.names, (k, f.name, line, f.whole, text[f.start : f.end].rstrip("\r\n") if with_code else None)):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=_FOUND)


_FOUND = pa.schema([("file_id", pa.int64()), ("name", pa.string()), ("line", pa.int32()), ("whole", pa.bool_()), ("code", pa.string())])


def documented_pairs(symbols: DataFrame, texts: DataFrame, with_code: bool = True) -> DataFrame:
    """(sid, project, file_id, name, description, whole[, code]) of each callable that the parser finds in its file and whose documentation says something.

    A callable is found if a function of its name starts on its ``line``. ``code`` is what the parser takes the function to be, ``whole`` tells that it is not torn, as in a
    broken file. Callables without a text, name or line, and those whose text has no such function, give no pair. Equal rows count once. The language goes by the
    extension of the symbols' path. Each text is shuffled and parsed once, and only where a callable of its file is documented; its functions are then joined as rows, so no
    file is a group, however many callables it has. ``with_code=False`` leaves the code out of that join.
    """
    rows = described(symbols).where("file_id IS NOT NULL AND name IS NOT NULL AND line > 0")
    wanted = rows.groupBy("file_id").agg(F.lower(F.regexp_extract(F.coalesce(F.min("file"), F.lit("")), r"(\.[A-Za-z0-9]+)$", 1)).alias("ext"))
    held = texts.where("file_id IS NOT NULL AND text IS NOT NULL").select("file_id", "text")
    found = wanted.join(held, "file_id").mapInArrow(lambda b: _parsed(b, with_code), "file_id long, name string, line int, whole boolean, code string")
    kept = ["sid", "project", "file_id", "name", "description", "whole", *(["code"] if with_code else [])]
    return rows.join(found, ["file_id", "name", "line"]).select(*kept).dropDuplicates(["sid"])


def file_functions(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, name, line, end_line, whole, description) of every function found by parsing, with the comment before it if that says something.

    Needs no symbol table. ``whole`` is false where a broken file lacks the function's end. Null and empty texts have no functions.
    """
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for k, ext, text in zip(b["file_id"], b["ext"], b["text"]):
                plain = _lines(text or "")
                feeds = [m.start() for m in re.finditer("\n", plain)]
                for f in gll.functions(plain, ext) if plain else ():
                    doc = text[f.doc[0] : f.doc[1]] if f.doc else None
                    out.append((k, f.name, bisect.bisect_left(feeds, f.start) + 1, bisect.bisect_left(feeds, f.end) + 1, f.whole, describe(doc, f.name)))
            yield pd.DataFrame(out, columns=["file_id", "name", "line", "end_line", "whole", "description"])

    kinds = files.where("file_id IS NOT NULL").groupBy("file_id").agg(F.min("ext").alias("ext"))
    return spread(texts.where("file_id IS NOT NULL").select("file_id", "text").join(kinds, "file_id", "left")).mapInPandas(
        run, "file_id long, name string, line int, end_line int, whole boolean, description string")
