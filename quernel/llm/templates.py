"""A compiler for chat templates: a small sandboxed language, parsed to a tree, folded, and turned into Python closures.

The language: text; `{{ expression }}`; `{# comment #}`; the blocks `if / elif / else`, `for name in expression / else`,
`set name = expression` and `generation`, each closed by `end...`; a dash inside a tag strips the white space beside it.
Expressions: strings, whole numbers, true, false, none, lists, names, `a.b`, `a[b]`, `not`, `and`, `or`, comparisons, `in`,
`is defined / none / string / even / odd`, `+ - * // %` on whole numbers, `+` on two strings or lists, `~`,
`a if c else b` and filters `a | name(arguments)`. In a loop, `loop` has index, index0, first, last, length, previtem and
nextitem; a name that is set keeps its value from there on, after the loop too.

The sandbox: values are None, booleans, whole numbers of 64 bits, strings, lists and dicts. A name or key that begins with
an underscore doesn't compile; a dot or bracket reads keys of dicts and places of lists only, never attributes of Python
objects; nothing can be called but the filters below; loops run over given lists only and stand in at most MAX_LOOPS of each
other; tags nest at most MAX_DEPTH deep, have at most MAX_TOKENS tokens, and sources at most MAX_SOURCE characters. A missing name or key is None, which
prints nothing. Anything else raises TemplateError.

What stands inside `generation` is marked: the sink notes its start and end in code points.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

MAX_SOURCE = 100_000
MAX_DEPTH = 40
MAX_TOKENS = 200
MAX_LOOPS = 2
_BOUND = 1 << 63


class TemplateError(ValueError):
    """The template is not in the language, or asks for what the sandbox forbids."""


# --- filters


def guard(s: str) -> str:
    """Text in which no `<|` is left: one more backslash between `<` and `|`, which `unguard` takes away again."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def unguard(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def header(s: str) -> str:
    """Text on one line, guarded; `unheader` gives it back."""
    return guard(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unheader(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unguard(s))


def _text(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (str, int)):
        return str(x)
    raise TemplateError("a list or dict prints by tojson or join only")


def _listed(x: Any) -> list:
    if not isinstance(x, (list, str)):
        raise TemplateError("not a list")
    return x


FILTERS: dict[str, Callable[..., Any]] = {
    "guard": lambda s: guard(_text(s)),
    "header": lambda s: header(_text(s)),
    "trim": lambda s: _text(s).strip(),
    "upper": lambda s: _text(s).upper(),
    "lower": lambda s: _text(s).lower(),
    "string": _text,
    "length": lambda s: len(_listed(s)),
    "first": lambda s: _listed(s)[0] if s else None,
    "last": lambda s: _listed(s)[-1] if s else None,
    "default": lambda s, other="": other if s is None else s,
    "replace": lambda s, old, new: _text(s).replace(_text(old), _text(new)) if old else _text(s),
    "join": lambda s, by="": _text(by).join(_text(x) for x in _listed(s)),
    "tojson": lambda s: json.dumps(s, ensure_ascii=False, sort_keys=True),
}

TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda x: x is not None,
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "even": lambda x: _whole(x) % 2 == 0,
    "odd": lambda x: _whole(x) % 2 == 1,
}


def _whole(x: Any) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or not -_BOUND <= x < _BOUND:
        raise TemplateError("not a whole number of 64 bits")
    return x


def _plus(a: Any, b: Any) -> Any:
    if (isinstance(a, str) and isinstance(b, str)) or (isinstance(a, list) and isinstance(b, list)):
        return a + b
    return _whole(_whole(a) + _whole(b))


def _divided(a: Any, b: Any, rest: bool) -> int:
    if not _whole(b):
        raise TemplateError("division by zero")
    return _whole(_whole(a) % b if rest else _whole(a) // b)


def _ordered(a: Any, b: Any) -> tuple[Any, Any]:
    if not (isinstance(a, str) and isinstance(b, str)):
        _whole(a), _whole(b)
    return a, b


def _holds(a: Any, b: Any) -> bool:
    if isinstance(b, str) and not isinstance(a, str):
        raise TemplateError("only text is in text")
    if not isinstance(b, (str, list, dict)):
        raise TemplateError("in needs text, a list or a dict")
    return a in b


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key) if isinstance(key, str) else None
    if isinstance(of, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "+": _plus,
    "-": lambda a, b: _whole(_whole(a) - _whole(b)),
    "*": lambda a, b: _whole(_whole(a) * _whole(b)),
    "//": lambda a, b: _divided(a, b, False),
    "%": lambda a, b: _divided(a, b, True),
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: (lambda x: x[0] < x[1])(_ordered(a, b)),
    "<=": lambda a, b: (lambda x: x[0] <= x[1])(_ordered(a, b)),
    ">": lambda a, b: (lambda x: x[0] > x[1])(_ordered(a, b)),
    ">=": lambda a, b: (lambda x: x[0] >= x[1])(_ordered(a, b)),
    "in": _holds,
    "not in": lambda a, b: not _holds(a, b),
    "[]": _item,
}

# --- the tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator, a filter or a test on arguments that are all needed: a function of their values alone."""

    of: Callable[..., Any]
    args: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Choice:
    """kind and, or, not, if: the arguments after the first are worked out only when needed."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    of: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    of: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>//|==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", "is", "if", "else", *_WORDS}


def _tags(source: str) -> Iterator[tuple[str, str]]:
    """Pieces of the source: text, print or block, white space stripped where tags say so."""
    at, strip = 0, False
    for m in [*_TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if m and (m[1] or m[4] or m[7]):
            text = text.rstrip()
        if "{{" in text or "{%" in text or "{#" in text:
            raise TemplateError("a tag is not closed")
        if text:
            yield "text", text
        if m:
            if m[2] is not None:
                yield "print", m[2]
            elif m[5] is not None:
                yield "block", m[5].strip()
            at, strip = m.end(), bool(m[3] or m[6] or m[8])


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at, code = [], 0, code.rstrip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"not understood: {code[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if len(out) > MAX_TOKENS:
        raise TemplateError("a tag is too long")
    return out


def _named(name: str) -> str:
    if name.startswith("_"):
        raise TemplateError("names that begin with an underscore are not allowed")
    return name


class _Expression:
    """Recursive descent over the tokens of one tag; each method reads one level of precedence."""

    def __init__(self, code: str):
        self.tokens, self.at, self.depth = _tokens(code), 0, 0

    def sees(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.sees(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name" or value in _RESERVED:
            raise TemplateError("a name is missing")
        self.at += 1
        return _named(value)

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> Any:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("an expression is too deep")
        out = self.either()
        if self.take("if"):
            test = self.either()
            out = Choice("if", (test, out, self.whole() if self.take("else") else Const(None)))
        self.depth -= 1
        return out

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Choice("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Choice("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        turns = 0
        while self.take("not"):
            turns += 1
        out = self.compared()
        for _ in range(min(turns, 2 + turns % 2)):
            out = Choice("not", (out,))
        return out

    def compared(self) -> Any:
        out = self.summed()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                out = Apply(OPERATORS[op], (out, self.summed()))
            elif self.sees("not"):
                self.at += 1
                self.need("in")
                out = Apply(OPERATORS["not in"], (out, self.summed()))
            elif self.take("is"):
                turned, test = self.take("not"), self.tokens[self.at][1] if self.at < len(self.tokens) else ""
                self.at += 1
                if test not in TESTS:
                    raise TemplateError(f"no test {test!r}")
                out = Apply(TESTS[test], (out,))
                out = Choice("not", (out,)) if turned else out
            else:
                return out

    def summed(self) -> Any:
        out = self.multiplied()
        while op := self.take("+", "-", "~"):
            out = Apply(OPERATORS[op], (out, self.multiplied()))
        return out

    def multiplied(self) -> Any:
        out = self.filtered()
        while op := self.take("*", "//", "%"):
            out = Apply(OPERATORS[op], (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        minus = self.take("-")
        out = self.atom()
        while True:
            if self.take("."):
                out = Apply(_item, (out, Const(self.name())))
            elif self.take("["):
                key = self.whole()
                if isinstance(key, Const) and isinstance(key.value, str):
                    _named(key.value)
                self.need("]")
                out = Apply(_item, (out, key))
            elif self.take("|"):
                name, args = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    args = self.listed(")")
                out = Apply(FILTERS[name], (out, *args))
            else:
                return Apply(OPERATORS["-"], (Const(0), out)) if minus else out

    def listed(self, close: str) -> list:
        items = []
        while not self.take(close):
            items.append(self.whole())
            if not self.sees(close):
                self.need(",")
        return items

    def atom(self) -> Any:
        if self.take("("):
            out = self.whole()
            self.need(")")
            return out
        if self.take("["):
            return ListOf(tuple(self.listed("]")))
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "number":
            self.at += 1
            return Const(_whole(int(value[:30])))
        if kind == "string":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if value in _WORDS:
            self.at += 1
            return Const(_WORDS[value])
        return Name(self.name())


class _Parser:
    def __init__(self, source: str):
        if len(source) > MAX_SOURCE:
            raise TemplateError("the template is too long")
        self.tags, self.at = list(_tags(source)), 0
        self.loops = 0

    def body(self, *ends: str, depth: int = 0, marked: bool = False) -> tuple[tuple, str]:
        """Statements up to a block that begins with one of ends, and that block."""
        if depth > MAX_DEPTH:
            raise TemplateError("tags are too deep")
        out: list[Any] = []
        while self.at < len(self.tags):
            kind, code = self.tags[self.at]
            self.at += 1
            if kind == "text":
                out.append(Text(code))
                continue
            if kind == "print":
                out.append(Print(self.expression(code)))
                continue
            word, _, rest = code.partition(" ")
            if word in ends:
                return tuple(out), code
            inner = {"depth": depth + 1, "marked": marked or word == "generation"}
            if word == "if":
                out.append(self.condition(rest, inner))
            elif word == "for":
                e = _Expression(rest)
                name = e.name()
                e.need("in")
                over = e.whole()
                e.end()
                self.loops += 1
                if self.loops > MAX_LOOPS:
                    raise TemplateError("too many loops in each other")
                body, end = self.body("else", "endfor", **inner)
                self.loops -= 1
                other = self.body("endfor", **inner)[0] if end == "else" else ()
                out.append(For(name, over, body, other))
            elif word == "set":
                e = _Expression(rest)
                name = e.name()
                e.need("=")
                out.append(Set(name, e.whole()))
                e.end()
            elif word == "generation" and not rest:
                if marked:
                    raise TemplateError("generation stands in itself")
                out.append(Generation(self.body("endgeneration", **inner)[0]))
            else:
                raise TemplateError(f"no block {code[:40]!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def condition(self, code: str, inner: dict) -> If:
        test = self.expression(code)
        then, end = self.body("elif", "else", "endif", **inner)
        word, _, rest = end.partition(" ")
        if word == "elif":
            return If(test, then, (self.condition(rest, inner | {"depth": inner["depth"] + 1}),))
        return If(test, then, self.body("endif", **inner)[0] if word == "else" else ())

    def expression(self, code: str) -> Any:
        e = _Expression(code)
        out = e.whole()
        e.end()
        return out


def parse(source: str) -> tuple:
    return _Parser(source).body()[0]


# --- folding


def _assigned(body: Iterable) -> set[str]:
    out: set[str] = set()
    for s in body:
        if isinstance(s, Set):
            out.add(s.name)
        elif isinstance(s, For):
            out |= {s.name, "loop"} | _assigned(s.body) | _assigned(s.other)
        elif isinstance(s, If):
            out |= _assigned(s.then) | _assigned(s.other)
        elif isinstance(s, Generation):
            out |= _assigned(s.body)
    return out


def fold(e: Any, known: dict[str, Any]) -> Any:
    """An expression with everything worked out that depends on constants and known names only."""
    if isinstance(e, Name):
        return Const(known[e.name]) if e.name in known else e
    if isinstance(e, ListOf):
        items = tuple(fold(x, known) for x in e.items)
        return Const([x.value for x in items]) if all(isinstance(x, Const) for x in items) else ListOf(items)
    if isinstance(e, Apply):
        args = tuple(fold(x, known) for x in e.args)
        if all(isinstance(x, Const) for x in args):
            return Const(_applied(e.of, *[x.value for x in args]))
        return Apply(e.of, args)
    if isinstance(e, Choice):
        first, rest = fold(e.args[0], known), e.args[1:]
        if not isinstance(first, Const):
            return Choice(e.kind, (first, *[fold(x, known) for x in rest]))
        yes = bool(first.value)
        if e.kind == "not":
            return Const(not yes)
        if e.kind == "if":
            return fold(rest[0] if yes else rest[1], known)
        return fold(rest[0], known) if yes == (e.kind == "and") else first
    return e


def fold_body(body: Iterable, known: dict[str, Any]) -> tuple:
    """Statements with constant prints as text, decided branches only, and neighbouring texts as one."""
    out: list[Any] = []
    for s in body:
        if isinstance(s, Print):
            of = fold(s.of, known)
            new = [Text(_text(of.value))] if isinstance(of, Const) else [Print(of)]
        elif isinstance(s, If):
            test = fold(s.test, known)
            if isinstance(test, Const):
                new = list(fold_body(s.then if test.value else s.other, known))
            else:
                new = [If(test, fold_body(s.then, known), fold_body(s.other, known))]
        elif isinstance(s, For):
            over, body_ = fold(s.over, known), fold_body(s.body, known)
            new = list(fold_body(s.other, known)) if isinstance(over, Const) and over.value in (None, []) else [For(s.name, over, body_, fold_body(s.other, known))]
        elif isinstance(s, Set):
            new = [Set(s.name, fold(s.of, known))]
        elif isinstance(s, Generation):
            new = [Generation(fold_body(s.body, known))]
        else:
            new = [s]
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif not isinstance(x, Text) or x.text:
                out.append(x)
    return tuple(out)


# --- closures


@dataclass
class Sink:
    """What a rendering writes: parts, their code points, and the marked spans."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


Value = Callable[[dict], Any]
Render = Callable[[dict, Sink], None]


def _applied(of: Callable[..., Any], *args: Any) -> Any:
    try:
        return of(*args)
    except TemplateError:
        raise
    except (TypeError, ValueError) as e:
        raise TemplateError(str(e)) from e


def value(e: Any) -> Value:
    """A closure that works out an expression in a scope."""
    if isinstance(e, Const):
        return lambda scope, x=e.value: x
    if isinstance(e, Name):
        return lambda scope, name=e.name: scope.get(name)
    if isinstance(e, ListOf):
        items = [value(x) for x in e.items]
        return lambda scope: [f(scope) for f in items]
    args = [value(x) for x in e.args]
    if isinstance(e, Choice):
        if e.kind == "not":
            return lambda scope, a=args[0]: not a(scope)
        if e.kind == "if":
            return lambda scope, t=args[0], a=args[1], b=args[2]: a(scope) if t(scope) else b(scope)
        if e.kind == "and":
            return lambda scope, a=args[0], b=args[1]: a(scope) and b(scope)
        return lambda scope, a=args[0], b=args[1]: a(scope) or b(scope)
    if e.of is _item and isinstance(e.args[1], Const):
        return lambda scope, of=args[0], key=e.args[1].value: _item(of(scope), key)
    return lambda scope, of=e.of: _applied(of, *[f(scope) for f in args])


def _each(items: Iterable) -> Iterator[tuple[dict, Any]]:
    """The items, each with what `loop` says of it; looks one item ahead."""
    total = len(items) if isinstance(items, list) else None
    before, ahead = None, iter(items)
    item = next(ahead, _each)
    for k in itertools.count():
        if item is _each:
            return
        after = next(ahead, _each)
        yield {"index": k + 1, "index0": k, "first": k == 0, "last": after is _each, "length": total, "previtem": before, "nextitem": None if after is _each else after}, item
        before, item = item, after


def closure(body: Iterable) -> Render:
    """A closure that writes statements to a sink."""
    steps = [_step(s) for s in body]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, sink: Sink) -> None:
        for f in steps:
            f(scope, sink)

    return run


def _step(s: Any) -> Render:
    if isinstance(s, Text):
        return lambda scope, sink, text=s.text: sink.write(text)
    if isinstance(s, Print):
        return lambda scope, sink, of=value(s.of): sink.write(_text(of(scope)))
    if isinstance(s, Set):

        def assign(scope: dict, sink: Sink, name: str = s.name, of: Value = value(s.of)) -> None:
            scope[name] = of(scope)

        return assign
    if isinstance(s, If):

        def branch(scope: dict, sink: Sink, test: Value = value(s.test), then: Render = closure(s.then), other: Render = closure(s.other)) -> None:
            (then if test(scope) else other)(scope, sink)

        return branch
    if isinstance(s, Generation):

        def marked(scope: dict, sink: Sink, body: Render = closure(s.body)) -> None:
            start = sink.length
            body(scope, sink)
            if sink.length > start:
                sink.spans.append((start, sink.length))

        return marked

    def loop(scope: dict, sink: Sink, rounds: Callable = _rounds(s)) -> None:
        for _ in rounds(scope, sink):
            pass

    return loop


def _rounds(s: For) -> Callable[[dict, Sink], Iterator[None]]:
    """A loop as a generator that stops after each round."""

    def rounds(scope: dict, sink: Sink, over: Value = value(s.over), body: Render = closure(s.body), other: Render = closure(s.other), name: str = s.name) -> Iterator[None]:
        items, none = over(scope), True
        if isinstance(items, (str, int, dict)):
            raise TemplateError("for needs a list")
        outer = {k: scope[k] for k in (name, "loop") if k in scope}
        for state, item in _each([] if items is None else items):
            scope[name], scope["loop"], none = item, state, False
            body(scope, sink)
            yield
        for k in (name, "loop"):
            scope.pop(k, None)
        scope.update(outer)
        if none:
            other(scope, sink)

    return rounds


def _names(tree: Any) -> Iterator[tuple[str, Any]]:
    """All names that a tree reads, and the keys that it reads of them ('' where the name itself is used)."""
    if isinstance(tree, Name):
        yield tree.name, ""
    elif isinstance(tree, Apply) and tree.of is _item and isinstance(tree.args[0], Name) and isinstance(tree.args[1], Const):
        yield tree.args[0].name, tree.args[1].value
    elif isinstance(tree, tuple):
        for x in tree:
            yield from _names(x)
    elif hasattr(tree, "__dataclass_fields__") and not isinstance(tree, Const):
        for f in tree.__dataclass_fields__:
            yield from _names(getattr(tree, f))


class Template:
    """A compiled template: parsed, folded with the constants, and turned into closures.

    `streams` says that messages may be any iterator: one loop of the outermost level reads them, once, and neither their
    number nor loop as a whole is used. Then a conversation of any length is rendered in bounded memory.
    """

    def __init__(self, source: str, constants: dict[str, Any] | None = None):
        tree, known = parse(source), dict(constants or {})
        for name in _assigned(tree):
            known.pop(name, None)  # a name that the template sets isn't constant
        self.tree = fold_body(tree, known)
        outer = [s for s in self.tree if isinstance(s, For) and s.over == Name("messages")]
        uses = list(_names(self.tree))
        self.streams = len(outer) == 1 and sum(n == "messages" for n, _ in uses) == 1 and not any(n == "loop" and k in ("", "length") for n, k in uses)
        self.steps = [(True, _rounds(s)) if isinstance(s, For) else (False, _step(s)) for s in self.tree]

    def turns(self, messages: Iterable[dict], sink: Sink, **scope: Any) -> Iterator[None]:
        """Renders a conversation into a sink, and stops after each round of an outermost loop, when it may be emptied."""
        scope["messages"] = messages if self.streams else list(messages)
        for rounds, step in self.steps:
            if rounds:
                yield from step(scope, sink)
            else:
                step(scope, sink)

    def render(self, messages: Iterable[dict], **scope: Any) -> Sink:
        sink = Sink()
        for _ in self.turns(messages, sink, **scope):
            pass
        return sink
