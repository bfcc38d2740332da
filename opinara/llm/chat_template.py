"""A sandboxed template language for chats, compiled to Python closures.

Source is cut into text and tags, parsed into a syntax tree, constants are folded, and every node
becomes a generator closure. A template sees the messages of a conversation one by one and can do
nothing but compare, join and filter strings: names, fields and filters come from closed lists, there
are no calls, no imports and no attribute access, so a template from an unknown source is safe to run.

Tags: ``{{ expr }}``, ``{% for m in messages %}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% generation %} {% endgeneration %}`` around what the model is trained on, ``{# comment #}``. A
dash inside a tag's brace strips the blanks on that side. Expressions: strings, integers, ``true``,
``false``, ``m.role``, ``m.text``, ``loop.first``, ``loop.last``, ``loop.index0``, ``==``, ``!=``,
``and``, ``or``, ``not``, ``~`` (join), ``|filter`` and parentheses. The message loop may occur once
and not inside another, so a conversation streams through and is never held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

FIELDS = {"m": ("role", "text"), "loop": ("first", "last", "index0")}
_TAG = re.compile(r"\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|~().]))",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t"}

# A piece of output and whether the model is trained on it.
Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template is not part of the language."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Field:
    of: str
    name: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Block:
    """``kind`` is text, out, if, for or generation; ``parts`` holds expressions and lists of blocks."""

    kind: str
    parts: tuple


# --- parsing ----------------------------------------------------------------------------------


class _Expression:
    """Recursive descent over one tag's expression, loosest operator first."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.source, self.filters, self.tokens, at = source, filters, [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "str" else text

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (want and self.peek() != want):
            raise TemplateError(f"expected {want or 'a value'} in {self.source.strip()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source.strip()!r}")
        return out

    def _chain(self, ops: tuple[str, ...], inner: Callable):
        out = inner()
        while self.peek() in ops:
            out = Op(self.take()[1], (out, inner()))
        return out

    def either(self):
        return self._chain(("or",), lambda: self._chain(("and",), self.negated))

    def negated(self):
        if self.peek() == "not":
            self.take()
            return Op("not", (self.negated(),))
        return self._chain(("==", "!="), lambda: self._chain(("~",), self.filtered))

    def filtered(self):
        out = self.value()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            out = Op("|" + name, (out,))
        return out

    def value(self):
        kind, text = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if text == "(":
            out = self.either()
            self.take(")")
            return out
        if text in ("true", "false"):
            return Const(text == "true")
        if text in FIELDS:
            self.take(".")
            name = self.take()[1]
            if name in FIELDS[text]:
                return Field(text, name)
        raise TemplateError(f"unknown value {text!r} in {self.source.strip()!r}")


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(text, out or tag; content) in order, comments dropped and dashes applied."""
    at, strip = 0, False
    for m in [*_TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        tag = m[0] if m else ""
        if tag[2:3] == "-":
            text = text.rstrip()
        if text:
            yield "text", text
        if m:
            at, strip = m.end(), tag[-3:-2] == "-"
            if tag[1] != "#":
                yield ("out" if tag[1] == "{" else "tag"), tag[2:-2].strip("-").strip()


def parse(source: str, filters: Mapping[str, Callable]) -> list[Block]:
    """The syntax tree of a template."""
    pieces = list(_pieces(source))
    at, loops = 0, 0

    def blocks(inside: tuple[str, ...], within: frozenset) -> tuple[list[Block], str]:
        """Blocks up to one of the closing tags ``inside``, and that tag."""
        nonlocal at, loops
        out: list[Block] = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                out.append(Block("text", (content,)))
                continue
            if kind == "out":
                out.append(Block("out", (expression(content, within),)))
                continue
            word = content.split(None, 1)[0] if content else ""
            if word in inside:
                return out, content
            if word == "for":
                if not re.fullmatch(r"for\s+m\s+in\s+messages", content):
                    raise TemplateError(f"only 'for m in messages' may loop, not {content!r}")
                loops += 1
                if within or loops > 1:
                    raise TemplateError("messages are read once, outside other tags")
                out.append(Block("for", (blocks(("endfor",), within | {"for"})[0],)))
            elif word == "generation":
                if "generation" in within:
                    raise TemplateError("generation tags cannot be nested")
                body = blocks(("endgeneration",), within | {"generation"})[0]
                out.append(Block("generation", (body,)))
            elif word == "if":
                arms, tag = [], content
                while tag.split(None, 1)[0] in ("if", "elif"):
                    test = expression(tag.split(None, 1)[1] if " " in tag else "", within)
                    body, tag = blocks(("elif", "else", "endif"), within | {"if"})
                    arms.append((test, body))
                rest = blocks(("endif",), within | {"if"})[0] if tag == "else" else []
                out.append(Block("if", (arms, rest)))
            else:
                raise TemplateError(f"unexpected tag {content!r}")
        if inside:
            raise TemplateError(f"missing {' or '.join(inside)}")
        return out, ""

    def expression(text: str, within: frozenset):
        tree = _Expression(text, filters).parse()
        if "for" not in within and _fields(tree):
            raise TemplateError(f"{text!r} needs a message outside the loop")
        return tree

    return blocks((), frozenset())[0]


def _fields(tree) -> bool:
    return isinstance(tree, Field) or (isinstance(tree, Op) and any(map(_fields, tree.args)))


# --- folding ----------------------------------------------------------------------------------


def _text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return "" if value is None else str(value)


def _operators(filters: Mapping[str, Callable]) -> dict[str, Callable]:
    return {
        "==": lambda a, b: a == b,
        "!=": lambda a, b: a != b,
        "and": lambda a, b: a and b,
        "or": lambda a, b: a or b,
        "not": lambda a: not a,
        "~": lambda a, b: _text(a) + _text(b),
        **{"|" + name: (lambda a, f=f: f(_text(a))) for name, f in filters.items()},
    }


def fold_expression(tree, operators: Mapping[str, Callable]):
    """The tree with every operator on constants replaced by its value."""
    if not isinstance(tree, Op):
        return tree
    args = tuple(fold_expression(a, operators) for a in tree.args)
    if all(isinstance(a, Const) for a in args):
        return Const(operators[tree.name](*[a.value for a in args]))
    return Op(tree.name, args)


def fold(blocks: list[Block], operators: Mapping[str, Callable]) -> list[Block]:
    """Constants folded, dead branches dropped, neighbouring texts joined."""
    out: list[Block] = []

    def add(block: Block) -> None:
        if block.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Block("text", (out[-1].parts[0] + block.parts[0],))
        elif block.parts != ("",):
            out.append(block)

    for block in blocks:
        if block.kind == "out":
            tree = fold_expression(block.parts[0], operators)
            add(Block("text", (_text(tree.value),)) if isinstance(tree, Const) else Block("out", (tree,)))
        elif block.kind == "if":
            arms, rest = [], fold(block.parts[1], operators)
            for test, body in block.parts[0]:
                test = fold_expression(test, operators)
                if isinstance(test, Const) and not test.value:
                    continue
                if isinstance(test, Const):
                    rest = fold(body, operators)
                    break
                arms.append((test, fold(body, operators)))
            for b in [Block("if", (arms, rest))] if arms else rest:
                add(b)
        elif block.kind in ("for", "generation"):
            add(Block(block.kind, (fold(block.parts[0], operators),)))
        else:
            add(block)
    return out


# --- closures ---------------------------------------------------------------------------------


def _expression_closure(tree, operators: Mapping[str, Callable]) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        return lambda env, v=tree.value: v
    if isinstance(tree, Field):
        return lambda env, k=f"{tree.of}.{tree.name}": env[k]
    args = [_expression_closure(a, operators) for a in tree.args]
    if tree.name in ("and", "or"):
        a, b = args
        if tree.name == "and":
            return lambda env: a(env) and b(env)
        return lambda env: a(env) or b(env)
    f = operators[tree.name]
    if len(args) == 1:
        return lambda env, a=args[0]: f(a(env))
    return lambda env, a=args[0], b=args[1]: f(a(env), b(env))


def _closure(blocks: list[Block], operators, trained: bool) -> Callable[[dict], Iterator[Piece]]:
    """All blocks as one generator function of the environment."""
    steps: list[Callable[[dict], Iterable[Piece]]] = []
    for block in blocks:
        if block.kind == "text":
            steps.append(lambda env, piece=(block.parts[0], trained): (piece,))
        elif block.kind == "out":
            value = _expression_closure(block.parts[0], operators)
            steps.append(lambda env, value=value: ((_text(value(env)), trained),))
        elif block.kind == "generation":
            steps.append(_generation(_closure(block.parts[0], operators, True)))
        elif block.kind == "if":
            arms = [
                (_expression_closure(t, operators), _closure(b, operators, trained))
                for t, b in block.parts[0]
            ]
            steps.append(_branch(arms, _closure(block.parts[1], operators, trained)))
        else:
            steps.append(_loop(_closure(block.parts[0], operators, trained)))

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def _generation(body: Callable) -> Callable:
    """One trained piece per tag, also an empty one."""
    return lambda env: (("".join(text for text, _ in body(env)), True),)


def _branch(arms, rest) -> Callable:
    def run(env: dict) -> Iterator[Piece]:
        for test, body in arms:
            if test(env):
                return body(env)
        return rest(env)

    return run


def _loop(body: Callable) -> Callable:
    def run(env: dict) -> Iterator[Piece]:
        messages = iter(env["messages"])
        ahead = next(messages, None)
        index = 0
        while ahead is not None:
            (role, text), ahead = ahead, next(messages, None)
            at = {
                "m.role": role,
                "m.text": text,
                "loop.first": index == 0,
                "loop.last": ahead is None,
                "loop.index0": index,
            }
            yield from body(at)
            index += 1

    return run


def compile_template(
    source: str, filters: Mapping[str, Callable[[str], str]]
) -> Callable[[Iterable[tuple[str, str]]], Iterator[Piece]]:
    """A renderer: (role, text) messages in order -> pieces of output in order."""
    operators = _operators(filters)
    run = _closure(fold(parse(source, filters), operators), operators, False)
    return lambda messages: run({"messages": messages})
