"""A lexer and an item parser for Rust sources, as far as the model needs them.

Text becomes a list of token trees; items are read from it by recursive descent, bodies by
looking for the shapes that matter. What cannot be read is reported, never guessed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

PANICS = ("unwrap", "expect", "unwrap_err", "expect_err")
_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)"""
    r"""|(?P<raw>(?:b|c|br|cr)?r(?P<hash>\#*)"(?:.|\n)*?"(?P=hash))|(?P<string>[bc]?"(?:\\(?:.|\n)|[^"\\])*")"""
    r"""|(?P<char>b?'(?:\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])')|(?P<life>'[A-Za-z_][A-Za-z0-9_]*)"""
    r"""|(?P<ident>(?:r\#)?[^\W\d]\w*)|(?P<number>\d(?:[\w]|\.(?=\d)|(?<=[eE])[+-](?=\d))*)"""
    r"""|(?P<op>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||<<=|>>=|[-+*/%^&|=!<>]=|<<|[-+*/%^!&|=<>@.,;:\#$?~])|(?P<open>[(\[{])|(?P<close>[)\]}])""",
)
_PAIR = {"(": ")", "[": "]", "{": "}"}


class Unreadable(Exception):
    """The text is no Rust that this parser knows."""

    def __init__(self, message: str, line: int):
        super().__init__(message)
        self.line = line


@dataclass(slots=True)
class Tok:
    """A token, or a group in brackets with its own tokens."""

    kind: str  # ident, op, life, string, number, char, group
    text: str
    line: int
    inner: list[Tok] = field(default_factory=list)
    end: int = 0

    def group(self, bracket: str) -> bool:
        return self.kind == "group" and self.text == bracket


def lex(text: str) -> list[Tok]:
    """Token trees of a text; comments are dropped, doc comments stay, as items start with them."""
    at, line, stack, out = (text.find("\n") + 1 if text.startswith("#!") and not text.startswith("#![") else 0), 1, [], []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(f"unexpected {text[at]!r}", line)
        kind, piece = m.lastgroup if m.lastgroup != "hash" else "raw", m[0]
        if kind == "line" and piece.startswith("///") and not piece.startswith("////"):
            out.append(Tok("doc", piece, line, end=line))
        if kind == "block":
            if text.startswith("/**", at) and not text.startswith(("/***", "/**/"), at):
                out.append(Tok("doc", "/**", line, end=line))
            depth, at = 1, m.end()
            while depth:
                n = re.compile(r"/\*|\*/").search(text, at)
                if not n:
                    raise Unreadable("comment without an end", line)
                depth += 1 if n[0] == "/*" else -1
                line += text.count("\n", at, n.start())
                at = n.end()
            continue
        if kind == "open":
            stack.append((out, Tok("group", piece, line)))
            out = stack[-1][1].inner
        elif kind == "close":
            if not stack or _PAIR[stack[-1][1].text] != piece:
                raise Unreadable(f"unmatched {piece!r}", line)
            out, group = stack.pop()
            group.end = line
            out.append(group)
        elif kind not in ("space", "line"):
            out.append(Tok("string" if kind == "raw" else kind, piece.removeprefix("r#") if kind == "ident" else piece, line, end=line + piece.count("\n")))
        line += piece.count("\n")
        at = m.end()
    if stack:
        raise Unreadable(f"{stack[-1][1].text!r} without an end", stack[-1][1].line)
    return out


def joined(a: str, b: str) -> str:
    return f"{a}::{b}" if a and b else a or b


def write(tokens: list[Tok]) -> str:
    """Tokens as text with the spacing of types."""
    out = ""
    for t in tokens:
        if t.kind == "doc":
            continue
        piece = t.text + write(t.inner) + _PAIR[t.text] if t.kind == "group" else t.text
        tight = not out or out[-1:] in "<(&[" or out.endswith("::") or piece in ("::", "<", ">", ",", ";", ")", ":") or (t.kind == "group" and t.text == "(" and out[-1:].isalnum() and out.rsplit(" ", 1)[-1] in ("Fn", "FnMut", "FnOnce"))
        out += piece if tight else " " + piece
    return out


class Cursor:
    """A position in a list of tokens."""

    def __init__(self, tokens: list[Tok], line: int = 1):
        self.tokens, self.at, self.line = tokens, 0, line

    def peek(self, ahead: int = 0) -> Tok | None:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else None

    def next(self) -> Tok:
        t = self.peek()
        if t is None:
            raise Unreadable("unexpected end", self.line)
        self.at += 1
        self.line = t.end or t.line
        return t

    def is_(self, *texts: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t is not None and t.kind in ("ident", "op") and t.text in texts

    def take(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.next()
            return True
        return False

    def ident(self) -> str:
        t = self.next()
        if t.kind != "ident":
            raise Unreadable(f"expected a name, found {t.text!r}", t.line)
        return t.text

    def group(self, bracket: str) -> Tok:
        t = self.next()
        if not t.group(bracket):
            raise Unreadable(f"expected {bracket!r}, found {t.text!r}", t.line)
        return t

    def angles(self) -> list[Tok]:
        """What stands between < and its >."""
        out, depth = [], 0
        while True:
            t = self.next()
            if t.kind == "op":
                depth += {"<": 1, "<<": 2, ">": -1, ">>": -2, ">=": -1}.get(t.text, 0)
                if depth <= 0:
                    return out[1:]
            out.append(t)

    def until(self, *stops: str) -> list[Tok]:
        """Tokens before one of the stops outside of angle brackets (a brace group counts as {)."""
        out, depth = [], 0
        while (t := self.peek()) is not None:
            if depth <= 0 and ((t.kind in ("op", "ident") and t.text in stops) or (t.group("{") and "{" in stops)):
                break
            if t.kind == "op":
                depth += {"<": 1, "<<": 2, ">": -1, ">>": -2}.get(t.text, 0)
            out.append(self.next())
        return out


def split(tokens: list[Tok], separator: str = ",") -> list[list[Tok]]:
    """Parts between separators that stand outside of angle brackets."""
    out, part, depth = [], [], 0
    for t in tokens:
        if t.kind == "op":
            depth += {"<": 1, "<<": 2, ">": -1, ">>": -2}.get(t.text, 0)
            if t.text == separator and depth <= 0:
                out.append(part)
                part = []
                continue
        part.append(t)
    return [p for p in [*out, part] if p]


def paths(tokens: list[Tok], bounds_only: bool = False, active: bool = True) -> list[str]:
    """Every path in a type, generic arguments included; bounds_only: those behind impl or dyn."""
    out: list[str] = []
    c = Cursor(tokens)
    active = active and not bounds_only
    while (t := c.peek()) is not None:
        if t.kind == "ident" and t.text in ("impl", "dyn"):
            c.next()
            active = True
        elif t.kind == "ident" and t.text in ("mut", "const", "for", "as", "where", "unsafe", "extern", "fn", "ref", "_"):
            c.next()
            if t.text == "for" and c.is_("<"):
                c.angles()
        elif t.kind == "ident" or (t.text == "::" and t.kind == "op"):
            path, start = ("::" if c.take("::") else ""), True
            while (n := c.peek()) is not None and n.kind == "ident" and (start or c.is_("::", ahead=-1)):
                path += ("" if start else "::") + c.next().text
                start = False
                if c.is_("::") and c.is_("<", ahead=1):
                    c.next()
                if c.is_("<") and active:
                    for part in split(c.angles()):
                        if len(part) > 1 and part[0].kind == "ident" and part[1].text in ("=", ":"):
                            part = part[2:]
                        out += paths(part)
                elif c.is_("<"):
                    c.angles()
                elif (g := c.peek()) is not None and g.group("(") and path.rsplit("::", 1)[-1] in ("Fn", "FnMut", "FnOnce"):
                    inner = c.next().inner
                    out += paths(inner) if active else []
                if not (c.is_("::") and (m := c.peek(1)) is not None and m.kind == "ident"):
                    break
                c.next()
            if active and path:
                out.append(path)
            if c.is_("=") and active:
                c.next()
        elif t.kind == "group":
            inner = c.next().inner
            if t.text == "[":
                inner = split(inner, ";")[0] if inner else []
            if not (bounds_only and t.text == "["):
                out += paths(inner, bounds_only, True)
        else:
            c.next()
            if t.text == "," and bounds_only:
                active = False
    return sorted(set(out))


def bound_paths(tokens: list[Tok]) -> list[str]:
    """Trait paths of `A + B<T> + 'a + ?Sized`."""
    return sorted({p for part in split(tokens, "+") for p in paths([t for t in part if t.text not in ("?", "~") and t.kind != "life"])})


@dataclass
class Attributes:
    names: list[str] = field(default_factory=list)
    cfg: list[str] = field(default_factory=list)
    derives: list[str] = field(default_factory=list)
    path: str | None = None

    @property
    def cfg_test(self) -> bool:
        return any("test" in c for c in self.cfg)

    @property
    def test(self) -> bool:
        return any(n == "test" or n.endswith("::test") for n in self.names)


def attributes(c: Cursor) -> Attributes:
    out = Attributes()
    while c.is_("#") or ((d := c.peek()) is not None and d.kind == "doc"):
        if not c.is_("#"):
            c.next()
            continue
        inner = (c.peek(2) if c.is_("!", ahead=1) else c.peek(1))
        if inner is None or not inner.group("["):
            break
        c.take("#")
        c.take("!")
        body = Cursor(c.next().inner)
        name = write(body.until("=", "(")).split("(")[0].replace(" ", "")
        if name != "doc":
            out.names.append(name)
        if name == "cfg":
            out.cfg.append(write(inner.inner))
        elif name == "derive" and inner.inner[-1].group("("):
            out.derives += [p[0].text for p in split(inner.inner[-1].inner) if len(p) == 1]
        elif name == "path" and inner.inner[-1].kind == "string":
            out.path = inner.inner[-1].text.strip('"')
    return out


def visibility(c: Cursor) -> str:
    if not c.take("pub"):
        return "private"
    t = c.peek()
    if t is not None and t.group("(") and t.inner and t.inner[0].text in ("crate", "super", "self", "in"):
        c.next()
        return "super" if t.inner[0].text == "super" else "crate"
    return "public"


def generics(c: Cursor) -> list[dict]:
    """Type parameters with their bounds."""
    out = []
    if c.is_("<"):
        for part in split(c.angles()):
            if part[0].kind == "life" or part[0].text == "const":
                continue
            bound = split(part[2:], "=")[0] if len(part) > 2 and part[1].text == ":" else []
            out.append({"name": part[0].text, "bounds": bound_paths(bound)})
    return out


def where_clause(c: Cursor, params: list[dict]) -> list[str]:
    """Reads a where clause into params; all its bounds."""
    found: list[str] = []
    if c.take("where"):
        for part in split(c.until("{", ";")):
            colon = next((i for i, t in enumerate(part) if t.text == ":"), None)
            if colon is None or part[0].kind == "life":
                continue
            bounds = bound_paths(part[colon + 1 :])
            found += bounds
            if colon == 1:
                for p in params:
                    if p["name"] == part[0].text:
                        p["bounds"] = sorted({*p["bounds"], *bounds})
    return found


def signature(c: Cursor, is_async: bool) -> dict:
    """A function from its generics on, up to its body or semicolon."""
    params = generics(c)
    inputs, out = c.group("(").inner, []
    receiver = None
    for k, part in enumerate(split(inputs)):
        part = Cursor(part)
        attributes(part)
        own = part.tokens[part.at :]
        colon = next((i for i, t in enumerate(own) if t.text == ":" and t.kind == "op"), None)
        if k == 0 and "self" in [t.text for t in own[: 4 if colon is None else colon]]:
            receiver = "self: " + write(own[colon + 1 :]) if colon is not None else re.sub(r"&('\w+)?\s*", lambda m: "&" + (m[1] + " " if m[1] else ""), write(own))
            continue
        if colon is None:
            continue
        names = [t for t in own[:colon] if t.text not in ("mut", "ref")]
        ty = own[colon + 1 :]
        out.append({"name": names[0].text if len(names) == 1 and names[0].kind == "ident" and names[0].text != "_" else "_", "ty": write(ty), "ty_paths": paths(ty), "bounds": paths(ty, bounds_only=True)})
    ret = c.until("where", "{", ";") if c.take("->") else []
    extra = where_clause(c, params)
    return {
        "params": out, "ret": write(ret) if ret else None, "ret_paths": paths(ret), "generic_bounds": sorted({*(b for p in params for b in p["bounds"]), *extra}),
        "generics": params, "is_async": is_async, "takes_self": receiver is not None, "receiver": receiver,
    }


@dataclass
class Body:
    """What a function's body says."""

    fields: set = field(default_factory=set)
    reads: set = field(default_factory=set)
    self_calls: set = field(default_factory=set)
    calls: list = field(default_factory=list)  # (path, line)
    matches: set = field(default_factory=set)
    panics: list = field(default_factory=list)  # (method, line)
    chains: set = field(default_factory=set)
    foreign: set = field(default_factory=set)
    receivers: set = field(default_factory=set)  # (recv, method, line, ty, callee)
    locals: dict = field(default_factory=dict)

    def chain_list(self) -> list[str]:
        return sorted(c for c in self.chains if not any(len(o) > len(c) and o.endswith("." + c) for o in self.chains))


_KEYWORDS = {"if", "else", "match", "for", "while", "loop", "let", "mut", "ref", "in", "return", "break", "continue", "move", "async", "await", "unsafe", "as", "const", "static", "fn", "where", "dyn", "impl", "pub", "use", "struct", "enum", "trait", "mod", "type"}


def _path_at(c: Cursor) -> str:
    """A path with turbofish arguments left out."""
    out = "::" if c.take("::") else ""
    out += c.ident()
    while c.is_("::"):
        n = c.peek(1)
        if n is not None and n.text == "<":
            c.next()
            c.angles()
        elif n is not None and n.kind == "ident":
            c.next()
            out += "::" + c.ident()
        else:
            break
    return out


def _binding(c: Cursor, body: Body) -> None:
    """After `let`: remembers what a local is declared to be, once its initialiser has been read."""
    start = c.at
    c.take("mut")
    t = c.peek()
    if t is None or t.kind != "ident" or not (c.is_(":", ahead=1) or c.is_("=", ahead=1) or c.is_(";", ahead=1)) or c.is_("==", ahead=1):
        c.at = start
        return
    name, bound = c.ident(), None
    if c.take(":"):
        ty = [x for x in c.until("=", ";") if x.text not in ("&", "mut") and x.kind != "life"]
        if ty and ty[0].kind == "ident" and ty[0].text not in ("dyn", "impl"):
            bound = ("ty", _path_at(Cursor(ty)))
    init = c.until(";", "else") if c.take("=") else []
    scan(init, body)
    if bound is None and init:
        k = Cursor([x for x in init if not (x.text in ("&", "*", "mut") and x.kind in ("op", "ident"))])
        first = k.peek()
        if first is not None and first.kind == "ident" and first.text not in _KEYWORDS:
            path = _path_at(k)
            after = k.peek()
            if after is not None and after.group("(") and _only_unwrapped(k.tokens[k.at + 1 :]):
                bound = ("callee", path)
            elif after is not None and after.group("{") and k.at + 1 == len(k.tokens):
                bound = ("ty", path)
    if bound is None:
        body.locals.pop(name, None)
    else:
        body.locals[name] = bound


def _only_unwrapped(rest: list[Tok]) -> bool:
    """Whether only ?, .await, .unwrap() and .expect(..) follow."""
    k = Cursor(rest)
    while (t := k.peek()) is not None:
        if t.text == "?":
            k.next()
        elif t.text == "." and k.is_("await", ahead=1):
            k.at += 2
        elif t.text == "." and k.is_("unwrap", "expect", ahead=1) and (g := k.peek(2)) is not None and g.group("("):
            k.at += 3
        else:
            return False
    return True


def _postfix(c: Cursor, base: str | None, callee: str | None, body: Body, opaque: bool) -> None:
    """What follows a primary expression: fields, calls, indexes. base is its plain path."""
    chain = [base] if base else None
    clean = True  # nothing but unwrapping since the base
    while (t := c.peek()) is not None:
        if t.text == "?" and t.kind == "op":
            c.next()
            chain = None
        elif t.kind == "group" and t.text in ("(", "["):
            scan(c.next().inner, body, opaque)
            chain, clean, base, callee = None, False, None, None
        elif t.text == "." and t.kind == "op":
            n = c.peek(1)
            if n is None or n.kind not in ("ident", "number"):
                return
            c.next()
            name = c.next()
            if name.text == "await" or name.kind == "number":
                chain = None if name.text == "await" else chain
                clean = clean and name.text == "await"
                continue
            if c.is_("::") and c.is_("<", ahead=1):
                c.next()
                c.angles()
            g = c.peek()
            if g is not None and g.group("("):
                line = name.line
                if name.text in PANICS and not opaque:
                    body.panics.append((name.text, t.line))
                if chain == ["self"]:
                    body.self_calls.add(name.text)
                elif chain and len(chain) == 2 and chain[0] == "self":
                    body.receivers.add((f"self.{chain[1]}", name.text, line, None, None))
                elif clean and base and base != "self" and "::" not in base:
                    kind, value = body.locals.get(base, (None, None))
                    body.receivers.add((base, name.text, line, value if kind == "ty" else None, value if kind == "callee" else None))
                elif clean and callee and not opaque:
                    body.receivers.add(("()", name.text, line, None, callee))
                if chain and len(chain) >= 3:
                    body.chains.add(".".join(chain))
                scan(c.next().inner, body, opaque)
                chain = None
                clean = clean and name.text in ("unwrap", "expect")
                continue
            written = c.is_("=") and chain == ["self"] and not opaque
            if chain == ["self"]:
                body.fields.add(name.text)
                if not written:
                    body.reads.add(name.text)
            else:
                body.foreign.add(name.text)
            chain = [*chain, name.text] if chain else None
            clean = False
        else:
            break
    if chain and len(chain) >= 3:
        body.chains.add(".".join(chain))


def _arms(tokens: list[Tok], body: Body) -> None:
    """Paths of the patterns of a match, and its arms."""
    c = Cursor(tokens)
    while c.peek() is not None:
        attributes(c)
        pattern = []
        while (t := c.peek()) is not None and t.text != "=>":
            pattern.append(c.next())
        if pattern and pattern[0].kind == "ident" and not any(t.text == "|" for t in pattern):
            k = Cursor(pattern)
            path = _path_at(k)
            after = k.peek()
            if (after is not None and after.kind == "group" and after.text in ("(", "{")) or "::" in path:
                body.matches.add(path)
        guard = next((i for i, t in enumerate(pattern) if t.text == "if" and t.kind == "ident"), None)
        if guard is not None:
            scan(pattern[guard:], body)
        c.take("=>")
        t = c.peek()
        arm = [c.next()] if t is not None and t.group("{") else []
        while (t := c.peek()) is not None and t.text != ",":
            if arm and arm[0].group("{") and len(arm) == 1 and not (t.text in (".", "?")):
                break
            arm.append(c.next())
        c.take(",")
        scan(arm, body)


def scan(tokens: list[Tok], body: Body, opaque: bool = False) -> None:
    """Reads a block's tokens; opaque: inside of a macro, where only shapes are known."""
    c = Cursor(tokens)
    while (t := c.peek()) is not None:
        if t.kind == "group":
            c.next()
            scan(t.inner, body, opaque)
            _postfix(c, None, None, body, opaque)
        elif t.text == "#" and t.kind == "op" and not opaque:
            attributes(c)
            if c.is_("#"):
                c.next()
        elif t.kind == "ident" and t.text == "let" and not opaque:
            c.next()
            _binding(c, body)
        elif t.kind == "ident" and t.text == "match" and not opaque:
            c.next()
            scan(c.until("{"), body)
            g = c.peek()
            if g is not None and g.group("{"):
                _arms(c.next().inner, body)
                _postfix(c, None, None, body, opaque)
        elif t.kind == "ident" and t.text in _KEYWORDS and not opaque:
            c.next()
            if t.text in ("fn", "struct", "enum", "trait", "impl", "mod", "use", "type") and not opaque:
                c.until("{", ";")  # items in bodies are not looked into
                if (g := c.peek()) is not None and g.group("{"):
                    c.next()
        elif t.kind == "ident" or (t.text == "::" and t.kind == "op"):
            line, start = t.line, c.at
            try:
                path = _path_at(c)
            except Unreadable:
                c.at = start + 1
                continue
            g = c.peek()
            if c.is_("!") and (m := c.peek(1)) is not None and m.kind == "group":
                c.next()
                scan(c.next().inner, body, True)
                _postfix(c, None, None, body, opaque)
            elif g is not None and g.group("("):
                if not opaque:
                    body.calls.append((path, line))
                scan(c.next().inner, body, opaque)
                _postfix(c, None, path, body, opaque)
            else:
                _postfix(c, path, None, body, opaque)
        else:
            c.next()
