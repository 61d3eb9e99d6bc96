"""Secret scans: base patterns, and assignments read from source and configuration syntax."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import free_name, map_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")

SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "passcode": 3, "pwd": 3, "pass": 2, "secret": 3, "credential": 3, "token": 3, "bearer": 3, "apikey": 3, "jwt": 3, "auth": 2, "authorization": 2, "private": 1, "access": 1, "signing": 1, "encryption": 1, "api": 1, "key": 1, "salt": 1, "client": 1, "session": 1, "cookie": 1, "dsn": 1, "contraseña": 3, "passwort": 3, "kennwort": 3}
#: Words that stand beside those in names that are run together, as in dbpassword or awssecretkey.
BESIDE = ("db", "my", "user", "app", "admin", "root", "aws", "git", "hub", "web", "hook", "sql", "mail", "smtp", "ftp", "ssh", "id", "default", "master", "service", "account", "login")
#: A name that ends so is about a secret and does not hold one.
ABOUT = frozenset("url uri path file filename dir folder name endpoint type field header prefix suffix length len count size limit regex pattern format label hint env var column table class description message text title placeholder ttl expiry expires".split())
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|_+|<.*>|\$\{.*|\{\{.*|%.*%|null|none|nil|true|false|undefined|example\S*|changeme\S*|your\S*|dummy\S*|test|redacted|todo)$", re.I)
LOCATION = re.compile(r"^(?:[a-z][a-z0-9+.-]*://[^@\s]*|(?:\.{0,2}/)[\w./-]*)$", re.I)
LEAST_SCORE = 4.0
#: Literals that a value put together from names carries on at most.
MOST_PARTS = 64
#: What a text must have for a pair to stand in it, and for a name of weight 2 or more (looked for only after that).
PAIRED = re.compile("[=:(<$]")
NAMED = ("pass", "pwd", "secret", "credential", "token", "bearer", "auth", "jwt", "kennwort", "contrase", "key", "private", "access", "signing", "encryption", "api", "salt", "client", "session", "cookie", "dsn")

#: What runs over lines to its closing mark: opening pattern, closing mark, group. Looked for only as long as a closing mark is ahead, so that lexing is linear.
_OPEN = (
    (r'''"""(?:[^\\]|\\.)*?"""''', '"""', "long"), (r"'''(?:[^\\]|\\.)*?'''", "'''", "long2"), (r"/\*.*?\*/", "*/", "block"), (r"<!--.*?-->", "-->", "hidden"),
)
_REMARK = (
    r"""(?P<remark>(?:(?<=\s)|(?<![\s\S]))(?:\#|//)[^\n]*|(?:(?<=\n)|(?<![\s\S]))[\x20\t]*(?:--|;)[^\n]*)"""
)
_CLOSED = (
    r"""(?P<text>(?<![\w"'\\])[rbfuRBFU]{0,2}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`))"""
    r"""|(?P<env>\$\{\w+(?::?[-=][^}\n]*)?\})"""
    r"""|(?P<tag><[^\W\d][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*/?>)"""
    r"""|(?P<name>[$@]?[^\W\d]\w*(?:(?:[.-]|->|::)\w+)*)"""
    r"""|(?P<op>:=|=>|===?|!=|<=|>=|\+=|\|\||\?\?|\.\.|[=:+.,;()\[\]{}|&<>*\n])"""
    r"""|(?P<other>\\\n|[^\s])"""
)


@lru_cache(32)
def _lex(ahead: tuple[bool, ...], remark: bool) -> re.Pattern:
    """The pattern of tokens; within a comment (remark) there are no further ones."""
    return re.compile("|".join([*(f"(?P<{name}>{opening})" for (opening, _, name), on in zip(_OPEN, ahead, strict=True) if on), *([] if remark else [_REMARK]), _CLOSED]), re.S)


def _tokens(text: str, at: int, end: int, remark: bool):
    last = [-1 if remark else text.rfind(mark, at, end) for _, mark, _ in _OPEN]
    while at < end:
        ahead = tuple(x > at for x in last)
        until = min((x for x in last if x > at), default=end)
        for m in _lex(ahead, remark).finditer(text, at, end):
            if m.start() >= until:
                at = m.start()
                break
            yield m
        else:
            return


#: A value without quotes; what runs on for longer is data and no literal.
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]{1,1000}(?![^\s"'`,;(){}\[\]<>])""")
_ITEM = re.compile(r"""\n[\x20\t]*-[\x20\t]+(?:"([^"\n]*)"|'([^'\n]*)'|([^\s"'#:][^\s:]*))[\x20\t]*(?=\n|\Z)""")
_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"<]*)"|'([^'<]*)')""")
_NAME = re.compile(r"[$@]?[^\W\d][\w.-]*")
_KEY_LIKE = re.compile(r"[^\W\d][\w. -]{0,80}")


def _segments(part: str) -> int:
    """The weight of a part of a name: a sensitive word, its plural, or sensitive words run together with each other and with BESIDE's."""
    if part in SENSITIVE:
        return SENSITIVE[part]
    if part.endswith("s") and part[:-1] in SENSITIVE:
        return SENSITIVE[part[:-1]]
    if not 5 <= len(part) <= 60:
        return 0
    best: list[int | None] = [0] + [None] * len(part)
    for i in range(len(part)):
        if best[i] is not None:
            for w in (*SENSITIVE, *BESIDE):
                if part.startswith(w, i):
                    n = best[i] + SENSITIVE.get(w, 0)
                    best[i + len(w)] = max(n, best[i + len(w)] or 0)
    return best[-1] or 0


@lru_cache(1 << 14)
def weight_of(name: str) -> int:
    """How sensitive a name is, by the words in it; 0 for one that only says where a secret is or what it looks like."""
    parts = [p.lower() for p in re.findall(r"[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[^\W\d_]+", name[:400])]
    return 0 if parts and parts[-1] in ABOUT else min(4, sum(map(_segments, parts)))


def score_literal(name: str, value: str) -> float:
    """How far a literal under a name looks like a secret: the name's sensitive words, the literal's length and its entropy.

    A name without sensitive words, a placeholder, a location and a literal under 8 characters score 0. From LEAST_SCORE on it is one.
    """
    weight = weight_of(name)
    if weight < 2 or len(value) < 8 or PLACEHOLDER.match(value) or LOCATION.match(value) or " " in value and len(value.split()) > 3:
        return 0.0
    counts, n = Counter(value), len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return weight + (entropy - 2.5) + 0.5 * (kinds - 1) if entropy > 2 else 0.0


class Lexer:
    """The names of a text and what is assigned to them.

    pairs: (names, parts, place, defines). parts are what the value is put together from, in order: literals (start, end) or names that stand for others; a part list is a whole
    value. defines is false for what stands in a comment or is only passed or compared: such a pair is scored and gives no constant.
    """

    def __init__(self, text: str, at: int = 0, end: int | None = None, remark: bool = False):
        self.text, self.remark = text, remark
        self.pairs: list[tuple[tuple[str, ...], list, int, bool]] = []
        self.kinds: list[str] = []
        self.spans: list[tuple[int, int]] = []
        end = len(text) if end is None else end
        for m in _tokens(text, at, end, remark):
            kind = m.lastgroup
            if kind in ("remark", "block", "hidden"):
                a = m.start() + len(re.match(r"\s*(?:/\*+|<!--|\#+|//+|--+|;+)", m[0])[0])
                self.pairs += Lexer(text, a, m.end(), True).pairs
            elif m[0] != "\\\n":  # a line that goes on
                self.kinds.append("text" if kind in ("long", "long2") else text[m.start()] if kind == "op" and m.end() - m.start() == 1 else m[0] if kind == "op" else kind)
                self.spans.append(m.span())
        self._parse()

    def _inner(self, k: int) -> tuple[int, int]:
        """The span of a string within its quotes."""
        a, b = self.spans[k]
        while self.text[a] in "rbfuRBFU":
            a += 1
        q = 3 if self.text[a : a + 3] in ('"""', "'''") and b - a >= 6 else 1
        return a + q, b - q

    def _word(self, k: int) -> str:
        a, b = self._inner(k) if self.kinds[k] == "text" else self.spans[k]
        return self.text[a:b]

    def _parse(self) -> None:
        for k, kind in enumerate(self.kinds):
            if kind in ("=", ":", ":=", "=>", "+="):
                self._assignment(k)
            elif kind == "(" and k and self.kinds[k - 1] == "name":
                self._call(k)
            elif kind == "env":
                self._default(k)
            elif kind == "tag":
                self._element(k)

    def _add(self, names, values, at: int, defines: bool = True) -> None:
        names = tuple(dict.fromkeys(n.lstrip("$@") for n in names if n))
        for parts in values:
            if names and parts:
                self.pairs.append((names, parts, at, defines and not self.remark))

    def _names(self, k: int) -> list[str]:
        """The names that an operator assigns to: what stands before it on its line, also with a type on either side or as a key in brackets."""
        kinds, j = self.kinds, k - 1
        if j < 0:
            return []
        if kinds[j] == "text":
            w = self._word(j)
            return [w] if _KEY_LIKE.fullmatch(w) else []
        if kinds[j] == "]":
            if j >= 2 and kinds[j - 1] in ("text", "name") and kinds[j - 2] == "[":
                return [self._word(j - 1)] + ([self._word(j - 3)] if j >= 3 and kinds[j - 3] == "name" else [])
            j -= 2 if j >= 1 and kinds[j - 1] == "[" else 0
        if kinds[k] != ":":  # name: type = …
            i, steps = j, 0
            while i >= 0 and steps < 12 and kinds[i] in ("name", "[", "]", "<", ">", "&", "*", "|", ".", ",", "other"):
                i, steps = i - 1, steps + 1
            if i >= 1 and kinds[i] == ":" and kinds[i - 1] == "name":
                return [self._word(i - 1)]
        if j >= 0 and kinds[j] == "name":
            return [self._word(j)] + ([self._word(j - 1)] if j >= 1 and kinds[j - 1] == "name" and self.text.find("\n", self.spans[j - 1][1], self.spans[j][0]) < 0 else [])
        return []

    def _assignment(self, k: int) -> None:
        names = self._names(k)
        if not names:
            return
        at = self.spans[k][0]
        if k + 1 >= len(self.kinds) or self.kinds[k + 1] == "\n":
            if self.kinds[k] in (":", "="):  # a list below
                p = self.spans[k][1]
                while self.text[p : p + 1] in (" ", "\t", "\r"):
                    p += 1
                while m := _ITEM.match(self.text, p):
                    self._add(names, [[m.span(m.lastindex)]], at, False)
                    p = m.end()
            return
        if self.kinds[k] == ":" and self.spans[k + 1][0] == self.spans[k][1] and self.kinds[k - 1] == "name" and self.kinds[k + 1] == "other":
            return  # a time or a location
        self._add(names, self._values(k + 1), at)

    def _values(self, k: int) -> list[list]:
        """The values that an expression may have: each a list of parts."""
        kinds, n = self.kinds, len(self.kinds)
        out: list[list] = []
        parts: list = []
        depth = 0
        while k < n:
            kind = kinds[k]
            if kind == "text":
                parts.append(self._inner(k))
                k += 1
            elif kind == "env":
                m = re.match(r"\$\{(\w+)(?::?[-=](.*))?\}", self._word(k), re.S)
                a = self.spans[k][0]
                parts.append((a + m.start(2), a + m.end(2)) if m[2] else m[1])
                k += 1
            elif kind == "[" and not parts:
                close = k + 1
                while close < n and kinds[close] in ("text", ",", "\n", "name", "other"):
                    if kinds[close] == "text":
                        out.append([self._inner(close)])
                    close += 1
                return out
            elif kind == "(":
                depth, k = depth + 1, k + 1
            elif kind == ")" and depth:
                depth, k = depth - 1, k + 1
            elif kind == "name" and k + 1 < n and kinds[k + 1] == "(" and self.spans[k][1] == self.spans[k + 1][0]:
                args, k = self._arguments(k + 1)
                lookup = re.search(r"env|get|lookup|fetch|find|read|load|prompt|input", self._word_before(k, args), re.I)
                out += [[x] for _, x in (args[1:] if lookup else args) if isinstance(x, tuple)]
            elif kind == "name" and self._word(k) in ("or", "new", "await", "return", "f", "static", "const", "final"):
                if self._word(k) == "or" and parts:
                    out.append(parts)
                    parts = []
                k += 1
            elif kind in ("||", "??"):
                if parts:
                    out.append(parts)
                parts, k = [], k + 1
            elif kind == "+" or (kind == "." or kind == "..") and parts and k + 1 < n and kinds[k + 1] in ("text", "name"):
                k += 1
            elif kind == "\n" and depth:
                k += 1
            elif parts and not (kind == "name" and kinds[k - 1] in ("+", ".", "..")):
                break
            elif not parts or kind == "name":
                a = self.spans[k][0]
                if kind == "\n":
                    break
                m = _BARE.match(self.text, a)
                if not m:
                    break
                end = a + len(m[0].rstrip(".")) if len(m[0].rstrip(".")) else m.end()
                word = self.text[a:end]
                if depth or parts or kinds[k - 1] in ("+", "..") or k + 1 < n and kinds[k + 1] in ("+", "..") and self.spans[k][1] >= end:
                    if kind != "name":
                        break
                    parts.append(self._word(k).lstrip("$@"))
                    k += 1
                    continue
                parts.append(word.lstrip("$@") if _NAME.fullmatch(word) else (a, end))
                if _NAME.fullmatch(word):
                    parts[-1] = ("?", word.lstrip("$@"), (a, end))  # a name, or a bare literal if there is no such name
                while k < n and self.spans[k][0] < end:
                    k += 1
                if not (k < n and kinds[k] in ("+", ".", "..", "||", "??")):
                    break
            else:
                break
        return [*out, parts] if parts else out

    def _word_before(self, k: int, args: list) -> str:
        return self._called

    def _arguments(self, k: int) -> tuple[list[tuple[int, object]], int]:
        """The arguments of a call that are one string or one name each, as (number, part), and the place after it. k: its bracket. Nested calls are looked at by themselves."""
        self._called = self._word(k - 1)
        kinds, n, depth, number = self.kinds, len(self.kinds), 0, 0
        out: list[tuple[int, object]] = []
        start = k
        while k < n and k - start < 200:
            kind = kinds[k]
            if kind in ("(", "[", "{"):
                depth += 1
            elif kind in (")", "]", "}"):
                depth -= 1
                if not depth:
                    return out, k + 1
            elif kind == "," and depth == 1:
                number += 1
            elif depth == 1 and kind == "text" and kinds[k - 1] in ("(", ",", "\n") and k + 1 < n and kinds[k + 1] in (")", ",", "\n"):
                out.append((number, self._inner(k)))
            elif depth == 1 and kind == "name" and kinds[k - 1] in ("(", ",") and k + 1 < n and kinds[k + 1] in (")", ","):
                out.append((number, self._word(k).lstrip("$@")))
            k += 1
        return out, k

    def _call(self, k: int) -> None:
        """f("literal") under the name f, and f("name", "literal") under the first."""
        args, _ = self._arguments(k)
        at, f = self.spans[k][0], self._word(k - 1)
        if len(args) >= 2 and args[0][0] == 0 and args[1][0] == 1 and isinstance(args[0][1], tuple):
            a, b = args[0][1]
            if _KEY_LIKE.fullmatch(self.text[a:b]):
                self._add([self.text[a:b]], [[args[1][1]]], at, False)
        if not re.match(r"(?:get|find|lookup|fetch|read|load|has|is|check)", re.split(r"[.>:]", f)[-1], re.I):
            self._add([f], [[x] for _, x in args], at, False)

    def _default(self, k: int) -> None:
        m = re.match(r"\$\{(\w+)(?::?[-=](.*))?\}", self._word(k), re.S)
        if m[2]:
            a = self.spans[k][0] + m.start(2)
            self._add([m[1]], [[(a, a + len(m[2]))]], a, False)

    def _element(self, k: int) -> None:
        a, b = self.spans[k]
        tag = re.match(r"<([\w:.-]+)", self.text[a:b])[1]
        pairs = {}
        for m in _ATTRIBUTE.finditer(self.text, a, b):
            pairs[m[1].lower()] = m.span(m.lastindex)
            self._add([m[1]], [[m.span(m.lastindex)]], a, False)
        named = next((pairs[x] for x in ("key", "name", "id", "k") if x in pairs), None)
        name = self.text[named[0] : named[1]] if named else None
        if name and (v := next((pairs[x] for x in ("value", "val", "content", "v") if x in pairs), None)):
            self._add([name], [[v]], a)
        if self.text[b - 2] != "/" and (end := self.text.find("<", b, b + 4000)) > b and self.text.startswith("</", end):
            inner = self.text[b:end]
            if inner.strip():
                c = b + len(inner) - len(inner.lstrip())
                self._add([tag, name] if name else [tag], [[(c, c + len(inner.strip()))]], a)


def _resolved(pairs: list) -> list[list[tuple[int, int]]]:
    """The literals of each pair: names in it stand for the value that they last got before, or else first get after it; along any chain, each pair once."""
    defined: dict[str, list[int]] = {}
    for i, (names, _, at, defines) in enumerate(pairs):
        if defines:
            for n in names:
                defined.setdefault(n, []).append(i)
    places = {n: [pairs[i][2] for i in own] for n, own in defined.items()}

    def source(name: str, i: int) -> int | None:
        own = defined.get(name)
        if not own:
            return None
        k = bisect_left(places[name], pairs[i][2]) - 1
        j = own[k] if k >= 0 else own[0]
        return j if j != i else own[k + 1] if k + 1 < len(own) and own[k + 1] != i else None

    parts: list[list] = []
    waits: dict[int, list[int]] = {}
    missing = [0] * len(pairs)
    for i, (_, own, _, _) in enumerate(pairs):
        out = []
        for x in own:
            if isinstance(x, tuple) and x[0] != "?":
                out.append(x)
                continue
            j = source(x if isinstance(x, str) else x[1], i)
            if j is not None:
                out.append(j)
                waits.setdefault(j, []).append(i)
                missing[i] += 1
            elif not isinstance(x, str):
                out.append(x[2])
        parts.append(out)
    values: list[list[tuple[int, int]]] = [[] for _ in pairs]
    ready = [i for i in range(len(pairs)) if not missing[i]]
    while ready:
        i = ready.pop()
        for x in parts[i]:
            values[i] += values[x] if isinstance(x, int) else [x]
        values[i] = list(dict.fromkeys(values[i]))
        if len(values[i]) > MOST_PARTS:
            values[i] = []
        for j in waits.get(i, ()):
            missing[j] -= 1
            if not missing[j]:
                ready.append(j)
    return values


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlap in each kind; matches that are too short are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if LONG_HEX.search(text):  # a run of 16 is a whole match's part, so what the long form finds is what is left of the short one
        out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return out


def literal_spans(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name, directly or through names that stand for them.

    The text is lexed into strings (with escapes, over lines, put together by signs or by standing side by side), comments, names, operators and tags.
    Every assignment, key, argument, attribute, element, list item and default gives name-literal pairs. Names stand for their literals along any chain:
    in "a = 'kX…'; b = a; db_password = b" the literal of a is scored as db_password, whatever the order. What stands in comments defines no name.
    """
    pairs = sorted(Lexer(text).pairs, key=lambda p: p[2])
    best: dict[tuple[int, int], float] = {}
    for (names, _, _, _), spans in zip(pairs, _resolved(pairs), strict=True):
        if not spans or max(map(weight_of, names)) < 2:
            continue
        value = "".join(text[a:b] for a, b in spans)
        if (s := max(score_literal(n, value) for n in names)) >= LEAST_SCORE:
            for x in spans:
                if x[1] > x[0]:
                    best[x] = max(s, best.get(x, 0))
    return [(a, b, s) for (a, b), s in sorted(best.items())]


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, (start, kind, end) in code points, each in order; literals within a base span add nothing."""
    if not text:
        return [], []
    base = sorted(base_spans(text))
    more = literal_spans(text) if PAIRED.search(text) and any(map(text.lower().__contains__, NAMED)) else []
    if more and base:
        starts = [a for a, _, _ in base]
        reach = list(accumulate((b for _, _, b in base), max))  # how far the spans up to each one go
        more = [(a, b, s) for a, b, s in more if not ((k := bisect_right(starts, a)) and reach[k - 1] >= b)]
    return base, sorted(base + [(a, 3, b) for a, b, _ in more])


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """keep's columns (all, if None) with n_assign, n_access, n_hex, base_sha256 and spans of every whole text.

    spans lists kind:start:end, by start and then in the order assign, access, hex, literal. Null and empty texts have no
    spans; repeated rows stay; an empty table gives no rows; columns with the new names are replaced. No shuffle.
    """

    def make():
        def run(texts):
            out = []
            for t in texts:
                base, every = scan_text(t)
                n = Counter(k for _, k, _ in base)
                out.append((n[0], n[1], n[2], hashlib.sha256(_told(base).encode()).hexdigest(), _told(every)))
            return list(zip(*out, strict=True))

        return run

    new = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    names = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in new}]
    return map_batches(docs, make, new, [text_col], names)


def redact_text(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with every span (overlapping ones together) replaced by the mask."""
    spans = scan_text(text)[1]
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """docs, same columns, with secrets masked in the texts and length_col, if there is one, holding the new lengths of changed texts.

    No row goes: what is clean in a document stays. Null and empty texts stay as they are; repeated rows and an empty table, too.
    """
    new = free_name("redacted", docs.columns)

    def make():
        return lambda texts: [[redact_text(t, mask) for t in texts]]

    out = map_batches(docs, make, [T.StructField(new, T.StringType())], [text_col])
    from pyspark.sql import functions as F

    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col(new).alias(c))
        elif c == length_col:
            cols.append(F.when(F.col(new) == F.col(f"`{text_col}`"), F.col(f"`{c}`")).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)
