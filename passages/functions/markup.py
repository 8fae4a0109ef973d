"""Wiki markup to plain lines: templates, balanced elements, links, headers.

Balanced markup is not regular, so this part is Python over Arrow batches; see ``clean_pages``.
"""

from __future__ import annotations

import datetime
import html
import operator
import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, quote_plus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.ship import ship

# Element names, prefixes and depths that right results depend on.
DISCARDED = ("gallery", "timeline", "noinclude", "pre", "table", "tr", "td", "th", "caption", "div", "form", "input", "select", "option", "textarea", "ul", "li", "ol", "dl", "dt", "dd", "menu", "dir", "ref", "references", "img", "imagemap", "source", "small", "sub", "sup")
IGNORED = ("abbr", "b", "big", "blockquote", "center", "cite", "em", "font", "h1", "h2", "h3", "h4", "hiero", "i", "kbd", "nowiki", "p", "plaintext", "s", "span", "strike", "strong", "tt", "u", "var", "a", "br", "hr")
ACCEPTED_PREFIXES = ("w", "wiktionary", "wikt")
PROTOCOLS = ("bitcoin:", "ftp://", "ftps://", "geo:", "git://", "gopher://", "http://", "https://", "irc://", "ircs://", "magnet:", "mailto:", "mms://", "news:", "nntp://", "redis://", "sftp://", "sip:", "sips:", "sms:", "ssh://", "svn://", "tel:", "telnet://", "urn:", "worldwind://", "xmpp:", "//")
SWITCHES = ("__NOTOC__", "__FORCETOC__", "__TOC__", "__NEWSECTIONLINK__", "__NONEWSECTIONLINK__", "__NOGALLERY__", "__HIDDENCAT__", "__NOCONTENTCONVERT__", "__NOCC__", "__NOTITLECONVERT__", "__NOTC__", "__START__", "__END__", "__INDEX__", "__NOINDEX__", "__STATICREDIRECT__", "__DISAMBIG__")
TEMPLATE_DEPTH, PARAMETER_DEPTH = 30, 10
_ENTITY = re.compile(r"&#?(\w+);")
_SWITCH = re.compile("|".join(SWITCHES))
_HEADER = re.compile(r"(==+)\s*(.*?)\s*\1")
_EXTERNAL = re.compile(r"\[((?:" + "|".join(map(re.escape, PROTOCOLS)) + r")[^\]\[<>\"\x00-\x20\x7f\s]+)\s*((?:[^\]\[\x00-\x08\x0a-\x1f]|\[\[[^\]\[\x00-\x08\x0a-\x1f]+\]\])*?)\]", re.I)
_PICTURE = re.compile(r"https?://[^\]\[<>\"\x00-\x20\x7f\s]+/[A-Za-z0-9_.,~%\-+&;#*?!=()@\x80-\xff]+\.(?:gif|png|jpg|jpeg)", re.I)
#: Bytes of all template texts together that are sent to every executor at most.
TEMPLATE_BYTES = 256 << 20


def balanced(text: str, opening: str, closing: str) -> list[tuple[int, int]]:
    """Outermost spans between two patterns; an opening without an end is text, and the spans in it count."""
    spans: list[tuple[int, int]] = []
    open_at: list[int] = []
    for m in re.finditer(f"(?P<o>{opening})|(?P<c>{closing})", text, re.I):
        if m.lastgroup == "o":
            open_at.append(m.start())
        elif open_at:
            start = open_at.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, m.end()))
    return spans


def drop_spans(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out.append(text[at:a])
            at = b
        at = max(at, b)
    return "".join(out) + text[at:]


def drop_nested(text: str, opening: str, closing: str) -> str:
    return drop_spans(text, balanced(text, opening, closing))


def split_parts(body: str) -> list[str]:
    """Split at | outside of braces and brackets."""
    parts, depth, at, i = [], 0, 0, 0
    while i < len(body):
        two = body[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
            continue
        if two in ("}}", "]]"):
            depth, i = depth - 1, i + 2
            continue
        if body[i] == "|" and depth <= 0:
            parts.append(body[at:i])
            at = i + 1
        i += 1
    return [*parts, body[at:]]


_OPS = {"+": (1, operator.add), "-": (1, operator.sub), "*": (2, operator.mul), "/": (2, operator.truediv), "div": (2, operator.truediv), "mod": (2, lambda a, b: int(a) % int(b)), "^": (3, lambda a, b: float(a) ** b if abs(b) < 64 else float("nan")), "=": (0, lambda a, b: float(a == b)), "<": (0, lambda a, b: float(a < b)), ">": (0, lambda a, b: float(a > b)), "round": (0, lambda a, b: round(a, int(b)))}


def arithmetic(text: str) -> str:
    """Numbers, + - * / div mod ^ round, comparisons and brackets; anything else is an error text.  Nothing is evaluated as code."""
    tokens = re.findall(r"\d+\.?\d*|\.\d+|div|mod|round|[-+*/^()=<>]|\S", text)
    at = 0

    def primary() -> float:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "(":
            v = climb(0)
            if tokens[at] != ")":
                raise ValueError
            at += 1
            return v
        if t in "+-":
            return primary() if t == "+" else -primary()
        return float(t)

    def climb(least: int) -> float:
        nonlocal at
        left = primary()
        while at < len(tokens) and tokens[at] in _OPS and _OPS[tokens[at]][0] >= least:
            rank, f = _OPS[tokens[at]]
            at += 1
            left = f(left, climb(rank + 1))
        return left

    try:
        v = climb(0)
        if at != len(tokens):
            raise ValueError
        return str(int(v)) if v == int(v) else str(v)
    except (ValueError, IndexError, ZeroDivisionError, OverflowError):
        return '<span class="error"></span>'


Parts = list["str | Braces"]


class Braces:
    """What stands between two or three braces, split at its own bars."""

    def __init__(self, braces: int, parts: list[Parts]):
        self.braces, self.parts = braces, parts


_BRACES = re.compile(r"\{{2,}|\}{2,}|\[\[|\]\]|\|")


def parsed(text: str) -> Parts:
    """Text and matched braces.  A run of closing braces takes three of an opening run if both have them, else two; what stays open is text."""
    root: list[Parts] = [[]]
    stack: list[tuple[int, list[Parts]]] = []  # braces still open, and the parts since
    links, at = [0], 0

    def here() -> Parts:
        return (stack[-1][1] if stack else root)[-1]

    for m in _BRACES.finditer(text):
        if m.start() > at:
            here().append(text[at : m.start()])
        at, run, c = m.end(), len(m[0]), m[0][0]
        if c == "{":
            stack.append((run, [[]]))
            links.append(0)
        elif c == "}":
            while run >= 2 and stack:
                n, parts = stack.pop()
                links.pop()
                take = 3 if min(n, run) >= 3 else 2
                inner = Braces(take, parts)
                run, n = run - take, n - take
                if n >= 2:
                    stack.append((n, [[inner]]))
                    links.append(0)
                else:
                    here().extend(["{" * n, inner] if n else [inner])
            if run:
                here().append("}" * run)
        elif c == "|":
            if stack and not links[-1]:
                stack[-1][1].append([])
            else:
                here().append("|")
        else:
            links[-1] = max(0, links[-1] + (1 if c == "[" else -1))
            here().append(m[0])
    here().append(text[at:])
    while stack:
        n, parts = stack.pop()
        flat: Parts = ["{" * n]
        for i, p in enumerate(parts):
            flat += ["|", *p] if i else p
        here().extend(flat)
    return root[0]


def clock(now: datetime.datetime) -> dict[str, str]:
    """The magic words that tell the time."""
    return {"currentyear": f"{now.year}", "currentmonth": f"{now.month:02d}", "currentday": f"{now.day}", "currenthour": f"{now.hour:02d}", "currenttime": f"{now:%H:%M:%S}"}


class Templates:
    """Template texts by title, with parser functions and magic words (``clock`` makes those of a frozen time).  Each text is parsed once."""

    def __init__(self, texts: dict[str, str], magic: dict[str, str] | None = None):
        self.texts, self.magic = {self.key(k): self.define(v) for k, v in texts.items()}, {"!": "|", **(magic or {})}
        self._trees: dict[str, Parts] = {}

    @staticmethod
    def key(title: str) -> str:
        """Of a title as a page has it or a call names it: the template namespace goes, a leading colon names the main one."""
        own = re.sub(r"[\s_]+", " ", title).strip()
        main = own.startswith(":")
        own = own.lstrip(": ")
        if own.lower().startswith("template:"):
            main, own = False, own.split(":", 1)[1].strip()
        return (":" if main and ":" not in own else "") + own[:1].upper() + own[1:]

    @staticmethod
    def define(text: str) -> str:
        text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
        text = re.sub(r"<noinclude>.*?</noinclude>", "", text, flags=re.S)
        text = re.sub(r"<noinclude\s*>.*$|<noinclude/>", "", text, flags=re.S)
        only = re.findall(r"<onlyinclude>(.*?)</onlyinclude>", text, flags=re.S)
        return "".join(only) if only else re.sub(r"</?includeonly>", "", text)

    def expand(self, text: str, page: dict[str, str] | None = None) -> str:
        """A page's text with its templates; ``page`` has the magic words of the page."""
        return self._text(parsed(text), None, page or {}, 0)

    def _text(self, tree: Parts, params: dict[str, str] | None, page: dict[str, str], depth: int) -> str:
        if depth > TEMPLATE_DEPTH:
            return ""
        return "".join(x if isinstance(x, str) else self._argument(x.parts, params, page, depth) if x.braces == 3 else self._call(x.parts, params, page, depth + 1) for x in tree)

    def _argument(self, parts: list[Parts], params: dict[str, str] | None, page: dict[str, str], depth: int) -> str:
        name = self._text(parts[0], params, page, depth + 1)
        if params is None:  # a page has no parameters
            return "{{{" + "|".join([name, *(self._text(p, None, page, depth + 1) for p in parts[1:])]) + "}}}"
        if name.strip() in params:
            return params[name.strip()]
        return self._text(parts[1], params, page, depth + 1) if len(parts) > 1 else ""

    def _call(self, parts: list[Parts], params: dict[str, str] | None, page: dict[str, str], depth: int) -> str:
        first, *rest = parts
        name = re.sub(r"^\s*(?:subst|safesubst):", "", self._text(first, params, page, depth)).strip()
        for words in (page, self.magic):
            if name.lower() in words and not rest:
                return words[name.lower()]
        if ":" in name:
            function, _, arg = name.partition(":")
            got = self._function(function.strip().lower(), arg.strip(), rest, (params, page), depth)
            if got is not None:
                return got
        return self._template(self.key(name), rest, params, page, depth)

    def _template(self, key: str, rest: list[Parts], params: dict[str, str] | None, page: dict[str, str], depth: int) -> str:
        text = self.texts.get(key)
        if text is None or depth > TEMPLATE_DEPTH:
            return ""
        if redirect := re.match(r"#redirect\s*\[\[([^\]]*)\]\]", text, re.I):
            return self._template(self.key(redirect[1]), rest, params, page, depth + 1)
        values, place = {}, 0
        for p in rest:
            p = self._text(p, params, page, depth)
            named = re.match(r"\s*([^=|\[\]{}<]*?)\s*=(.*)", p, re.S)
            if named:
                values[named[1]] = named[2] if "]]" in named[2] else named[2].strip()
            else:
                place += 1
                values[str(place)] = p if "]]" in p else p.strip()
        if key not in self._trees:
            self._trees[key] = parsed(text)
        return self._text(self._trees[key], values, page, depth)

    def _function(self, name: str, arg: str, rest: list[Parts], frame: tuple, depth: int) -> str | None:
        val = lambda i: self._text(rest[i], *frame, depth).strip() if i < len(rest) else ""
        if name == "#if":
            return val(0) if arg else val(1)
        if name == "#ifeq":
            return val(1) if arg == val(0) else val(2)
        if name == "#iferror":
            return val(0) if 'class="error"' in arg else val(1) if len(rest) > 1 else arg
        if name == "#expr":
            return arithmetic(arg)
        if name == "#switch":
            found, default = False, ""
            for i, p in enumerate(rest):
                key, eq, value = self._text(p, *frame, depth).partition("=")
                if not eq and i == len(rest) - 1:
                    return value.strip() if found and eq else key.strip()
                found = found or key.strip() == arg
                if eq and found:
                    return value.strip()
                if eq and key.strip() == "#default":
                    default = value.strip()
            return default
        if name == "#invoke":
            if arg.lower() == "if empty":
                return next((v for i in range(1, len(rest)) if (v := val(i))), "")
            return f"{val(1)} {val(2)}".strip() if arg.lower() == "convert" else ""
        if name in ("#ifexpr", "#ifexist", "#rel2abs", "#language", "#time", "#timel", "#titleparts"):
            return ""
        simple = {"lc": str.lower, "uc": str.upper, "lcfirst": lambda s: s[:1].lower() + s[1:], "ucfirst": lambda s: s[:1].upper() + s[1:], "urlencode": quote_plus, "int": lambda s: s}
        return simple[name](arg) if name in simple else None


def unescape(text: str) -> str:
    """Known entities with their semicolon; unknown names stay."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]), text)


def internal_links(text: str, keep_links: bool = False) -> str:
    """[[title|...|label]]trail is label and trail; other namespaces than the accepted go, with a colon before them too."""
    out, at = [], 0
    for a, b in balanced(text, r"\[\[", r"\]\]"):
        if a < at:
            continue
        title, *labels = split_parts(text[a + 2 : b - 2])
        prefix, colon, _ = title.removeprefix(":").partition(":")
        trail = re.match(r"\w*", text[b:])[0]
        out.append(text[at:a])
        if not colon or prefix in ACCEPTED_PREFIXES:
            label = internal_links(labels[-1].strip() if labels else title, keep_links)
            out += [f'<a href="{quote(title.rstrip())}">{label}</a>' if keep_links else label, trail]
        at = b + len(trail)
        if colon and prefix not in ACCEPTED_PREFIXES:
            out.append(trail)
    return "".join(out) + text[at:]


def external_links(text: str, keep_links: bool = False) -> str:
    """[URL label] is the label; a label that is a picture's address has no text."""

    def label(m: re.Match) -> str:
        own = m[2]
        if _PICTURE.fullmatch(own):
            own = f'<img src="{own}" alt="">' if keep_links else ""
        return f'<a href="{quote(m[1])}">{own}</a>' if keep_links else own

    return _EXTERNAL.sub(label, text)


def clean(text: str, templates: Templates | None = None, page: dict[str, str] | None = None, keep_links: bool = False) -> str:
    """Templates, tables, links, switches, entities, quotes, comments and elements, placeholders, white space; in this order."""
    text = templates.expand(text, page) if templates else drop_nested(text, r"\{\{", r"\}\}")
    text = drop_nested(text, r"\{\|", r"\|\}")
    text = external_links(text, keep_links)
    text = internal_links(text, keep_links)
    text = _SWITCH.sub("", text)
    parts = re.split(r"(<syntaxhighlight.*?>.*?</syntaxhighlight>)", text, flags=re.S)
    text = "".join(p if i % 2 else unescape(p) for i, p in enumerate(parts))
    text = re.sub(r"'''''(.*?)'''''|'''(.*?)'''", lambda m: m[1] if m[1] is not None else m[2], text)
    text = re.sub(r"''(.*?)''", r'"\1"', text).replace("'''", "").replace("''", '"')
    spans = [m.span() for m in re.finditer(r"<!--.*?-->|<[a-z]+[^<>]*/>", text, re.S | re.I)]
    spans += [m.span() for t in IGNORED if not (keep_links and t == "a") for m in re.finditer(rf"</?{t}\b[^<>]*>", text, re.I)]
    text = drop_spans(text, spans)
    for tag in DISCARDED:
        if f"<{tag}" in text.lower():
            text = drop_nested(text, rf"<\s*{tag}\b[^<>]*>", rf"<\s*/\s*{tag}\s*>")
    text = unescape(text)
    text = re.sub(r"<math\b.*?</math>", "***formula***", text, flags=re.S | re.I)
    text = re.sub(r"<code\b.*?</code>", "***codice***", text, flags=re.S | re.I)
    text = text.replace("<<", "«").replace(">>", "»").replace("\t", " ")
    text = re.sub(r" {2,}", " ", text)
    text = re.sub(r"\.{4,}", "...", text)
    text = re.sub(r"(?m)^[\W_]+$", lambda m: m[0] if m[0].startswith("=") or "***" in m[0] else "", text)
    return text.replace(",,", ",").replace(",.", ".")


_OPEN = {"*": "<ul>", "#": "<ol>", ";": "<dl>"}
_ITEM = {"*": "<li>%s</li>", "#": "<li>%s</li>", ";": "<dt>%s</dt>"}


def compact(text: str, lists: bool = True, to_html: bool = False) -> list[str]:
    """Lines with separators for the headers that have content below them and one token for a list item.

    The line after a list stands as it is, whatever headers wait.  After a header that only list items follow, further
    lines go until the next header.  ``to_html`` gives headers as elements where they stand, and list elements.
    """
    out: list[str] = []
    pending: dict[int, str] = {}
    nested, empty = "", False

    def flush() -> None:
        out.extend(pending[k] for k in sorted(pending))
        pending.clear()

    def close(marks: str) -> None:
        if to_html:
            out.extend(_OPEN[c].replace("<", "</") for c in reversed(marks))

    for line in text.split("\n"):
        if not line:
            continue
        if m := _HEADER.match(line):
            level = len(m[1])
            if to_html:
                out.append(f"<h{level}>{m[2]}</h{level}>")
            pending = {k: v for k, v in pending.items() if k < level}
            pending[level] = f"========,{level},{m[2].replace('.', '')}."
            nested, empty = "", True
        elif line.startswith("++"):
            if title := line[2:-2]:
                out.append(title if title[-1] in "!?" else title + ".")
        elif line[0] == ":":
            continue
        elif line[0] in "*#;":
            marks = re.match(r"[*#;:]+", line)[0]
            body, marks = line[len(marks) :].strip(), marks.replace(":", "")
            same = len(os.path.commonprefix([nested, marks]))
            close(nested[same:])
            if to_html:
                out.extend(_OPEN[c] for c in marks[same:])
            nested = marks
            if body and lists:
                if not to_html:
                    flush()
                out.append("***LIST***. ")
            elif body and to_html:
                out.append(_ITEM[marks[-1]] % body)
        elif nested:
            out.append(line)
            close(nested)
            nested = ""
        elif line[0] in "{|" or line[-1] == "}":
            continue
        elif line[0] == "(" and line[-1] == ")" or not line.strip(".-"):
            continue
        elif pending:
            if not to_html:
                flush()
            pending, empty = {}, False
            out.append(line)
        elif not empty and line[0] != " ":
            out.append(line)
    return out


_WORKER: dict[str, Templates] = {}


def clean_pages(pages: DataFrame, templates: dict[str, str] | DataFrame | None = None, magic: dict[str, str] | None = None, lists: bool = True, to_html: bool = False, keep_links: bool = False) -> DataFrame:
    """page_id, title, body, error of pages (page_id, title, text).

    ``templates``: texts by title, or rows (title, text); they go to every executor once, so more than
    ``TEMPLATE_BYTES`` of them are refused.  A page that cannot be parsed has a null body and an error text.
    """
    spark = pages.sparkSession
    ship(spark)
    if isinstance(templates, DataFrame):
        size = templates.agg(F.sum(F.octet_length("text") + F.octet_length("title"))).head()[0] or 0
        if size > TEMPLATE_BYTES:
            raise ValueError(f"{size} bytes of templates are more than {TEMPLATE_BYTES}")
        templates = {r["title"]: r["text"] or "" for r in templates.select("title", "text").collect()}  # bounded
    elif templates and (size := sum(len(k) + len(v) for k, v in templates.items())) > TEMPLATE_BYTES:
        raise ValueError(f"{size} characters of templates are more than {TEMPLATE_BYTES}")
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast((templates, magic)) if templates else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent and name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = Templates(*sent.value)
        own = _WORKER[name] if sent else None
        for batch in batches:
            bodies, errors = [], []
            titles = batch.column(1).to_pylist()
            for title, text in zip(titles, batch.column(2).to_pylist(), strict=True):
                try:
                    page = {"pagename": title or "", "fullpagename": title or ""}
                    bodies.append("\n".join(compact(clean(text or "", own, page, keep_links), lists, to_html)))
                    errors.append(None)
                except (ValueError, IndexError, RecursionError) as e:
                    bodies.append(None)
                    errors.append(repr(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(titles, pa.string()), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], names=["page_id", "title", "body", "error"])

    return pages.selectExpr("cast(page_id as long) as page_id", "title", "text").mapInArrow(run, "page_id long, title string, body string, error string")
