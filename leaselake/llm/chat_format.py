"""Chat formatting: a small sandboxed template language, compiled to closures.

A template is parsed into a syntax tree, constant parts are folded, and each node
becomes a Python closure. Rendering yields pieces of text, each with a mark
whether it stands inside ``{% generation %}``; those pieces are the loss mask.

The language has output ``{{ expression }}``, ``{% for x in expression %}``,
``{% if %}/{% elif %}/{% else %}``, ``{% set %}``, ``{% generation %}`` and
comments ``{# #}``; expressions have literals, names, keys of dictionaries,
comparisons, ``in``, ``and/or/not``, ``+``, ``~`` and named filters. There are no
calls, and a name or key that is not there is an error, so a template reaches
nothing but the values it is given.

Texts are escaped reversibly: ``<`` before any number of backslashes and a ``|``
gets one more backslash, so ``<|`` occurs in the output in control strings only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAT_TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
#: Characters after which a conversation's output goes on in a further segment.
SEGMENT_CHARS = 1 << 20


class TemplateError(ValueError):
    """A template that cannot be parsed, or asks for what it is not given."""


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_line(text: str) -> str:
    """``escape``, and a line end becomes two characters."""
    return escape(text).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_line(text: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S))


FILTERS: dict[str, Callable] = {"escape": escape, "line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}

TAG = re.compile(r"\{\{-?|\{%-?|\{#")
TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.()\[\],=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """("text" | "out" | "tag", content) of a template."""
    at, strip = 0, False
    while at <= len(source):
        found = TAG.search(source, at)
        text = source[at : found.start()] if found else source[at:]
        if strip:
            text = text.lstrip()
        if found and found[0].endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not found:
            return
        kind, close = {"{{": ("out", "}}"), "{%": ("tag", "%}"), "{#": ("comment", "#}")}[found[0][:2]]
        end = source.find(close, found.end())
        if end < 0:
            raise TemplateError(f"{found[0]} is not closed")
        inner = source[found.end() : end]
        strip = kind != "comment" and inner.endswith("-")
        if kind != "comment":
            yield kind, inner[:-1] if strip else inner
        at = end + 2


class _Expression:
    """Recursive descent over one expression's tokens, to tuples of the tree."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        got = self.tokens[self.at]
        if (value is not None and got[1] != value) or (kind is not None and got[0] != kind):
            raise TemplateError(f"{value or kind} expected, found {got[1]!r}")
        self.at += 1
        return got[1]

    def all(self):
        tree = self.either()
        self.end()
        return tree

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"not expected: {self.tokens[self.at][1]!r}")

    def either(self):
        tree = self.both()
        while self.peek() == "or":
            self.take()
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negation()
        while self.peek() == "and":
            self.take()
            tree = ("and", tree, self.negation())
        return tree

    def negation(self):
        if self.peek() == "not":
            self.take()
            return ("not", self.negation())
        return self.comparison()

    def comparison(self):
        tree = self.joined()
        if self.peek() in ("==", "!=", "<", "<=", ">", ">=", "in"):
            return (self.take(), tree, self.joined())
        return tree

    def joined(self):
        tree = self.filtered()
        while self.peek() in ("+", "~"):
            tree = (self.take(), tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.value()
        while self.peek() == "|":
            self.take()
            name = self.take(kind="name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            tree = ("filter", name, tree)
        return tree

    def value(self):
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else None
        token = self.take()
        if kind == "str":
            tree = ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
        elif kind == "int":
            tree = ("const", int(token))
        elif token == "(":
            tree = self.either()
            self.take(")")
        elif kind == "name":
            tree = ("const", {"true": True, "false": False, "none": None}[token]) if token in ("true", "false", "none") else ("name", token)
        else:
            raise TemplateError(f"a value expected, found {token!r}")
        while self.peek() in (".", "["):
            if self.take() == ".":
                tree = ("key", tree, ("const", self.take(kind="name")))
            else:
                tree = ("key", tree, self.either())
                self.take("]")
        return tree


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: f"{a}{b}",
}


def _fold(tree):
    """The tree with constant subtrees worked out."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        inner = _fold(tree[2])
        return ("const", FILTERS[tree[1]](inner[1])) if inner[0] == "const" else ("filter", tree[1], inner)
    parts = [_fold(t) for t in tree[1:]]
    known = all(p[0] == "const" for p in parts)
    if kind == "not":
        return ("const", not parts[0][1]) if known else ("not", *parts)
    if kind in ("and", "or"):
        if parts[0][0] == "const":
            return parts[0] if bool(parts[0][1]) == (kind == "or") else parts[1]
        return (kind, *parts)
    if known and kind in OPERATORS:
        return ("const", OPERATORS[kind](parts[0][1], parts[1][1]))
    return (kind, *parts)


def _evaluator(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda env, value=tree[1]: value
    if kind == "name":

        def named(env, name=tree[1]):
            if name not in env:
                raise TemplateError(f"no name {name}")
            return env[name]

        return named
    if kind == "filter":
        return lambda env, f=FILTERS[tree[1]], inner=_evaluator(tree[2]): f(inner(env))
    if kind == "key":

        def keyed(env, of=_evaluator(tree[1]), key=_evaluator(tree[2])):
            holder, name = of(env), key(env)
            if not isinstance(holder, dict) or name not in holder:
                raise TemplateError(f"no key {name}")
            return holder[name]

        return keyed
    parts = [_evaluator(t) for t in tree[1:]]
    if kind == "not":
        return lambda env: not parts[0](env)
    if kind == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if kind == "or":
        return lambda env: parts[0](env) or parts[1](env)
    return lambda env, f=OPERATORS[kind]: f(parts[0](env), parts[1](env))


def _parse_block(pieces: list, at: int, ends: tuple[str, ...]):
    """Nodes up to a tag whose first word is in ``ends``: (nodes, tag, next)."""
    nodes = []
    while at < len(pieces):
        kind, content = pieces[at]
        at += 1
        if kind == "text":
            nodes.append(("text", content))
            continue
        if kind == "out":
            nodes.append(("out", _fold(_Expression(content).all())))
            continue
        word, _, rest = content.strip().partition(" ")
        if word in ends:
            return nodes, content.strip(), at
        if word == "for":
            e = _Expression(rest)
            name = e.take(kind="name")
            e.take("in")
            over = _fold(e.all())
            body, _, at = _parse_block(pieces, at, ("endfor",))
            nodes.append(("for", name, over, body))
        elif word == "if":
            branches, tag = [], content.strip()
            while tag != "endif":
                last = tag == "else"
                test = ("const", True) if last else _fold(_Expression(tag.partition(" ")[2]).all())
                body, tag, at = _parse_block(pieces, at, ("endif",) if last else ("elif", "else", "endif"))
                branches.append((test, body))
            nodes.append(("if", branches))
        elif word == "set":
            e = _Expression(rest)
            name = e.take(kind="name")
            e.take("=")
            nodes.append(("set", name, _fold(e.all())))
        elif word == "generation":
            body, _, at = _parse_block(pieces, at, ("endgeneration",))
            nodes.append(("generation", body))
        else:
            raise TemplateError(f"no such tag: {content.strip()}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return nodes, "", at


def _simplified(nodes: list) -> list:
    """Constant output becomes text, constant branches are chosen, and texts that
    meet are joined."""
    out: list = []
    for node in nodes:
        if node[0] == "out" and node[1][0] == "const":
            node = ("text", str(node[1][1]))
        if node[0] == "for":
            node = (*node[:3], _simplified(node[3]))
        elif node[0] == "generation":
            node = ("generation", _simplified(node[1]))
        elif node[0] == "if":
            left = []
            for test, body in node[1]:
                if test[0] == "const" and not test[1]:
                    continue
                left.append((test, _simplified(body)))
                if test[0] == "const":
                    break
            if not left:
                continue
            if left[0][0][0] == "const":
                for inner in left[0][1]:
                    _append(out, inner)
                continue
            node = ("if", left)
        _append(out, node)
    return out


def _append(out: list, node) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    else:
        out.append(node)


Piece = tuple[str, bool]


def _generator(nodes: list) -> Callable[[dict, bool], Iterator[Piece]]:
    steps = [_step(n) for n in nodes]

    def run(env: dict, mask: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(env, mask)

    return run


def _step(node) -> Callable[[dict, bool], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        return lambda env, mask: iter([(node[1], mask)])
    if kind == "out":
        value = _evaluator(node[1])
        return lambda env, mask: iter([(str(value(env)), mask)])
    if kind == "generation":
        inner = _generator(node[1])
        return lambda env, mask: inner(env, True)
    if kind == "set":
        value = _evaluator(node[2])

        def put(env, mask):
            env[node[1]] = value(env)
            return iter(())

        return put
    if kind == "if":
        branches = [(_evaluator(test), _generator(body)) for test, body in node[1]]

        def choose(env, mask):
            return next((body(env, mask) for test, body in branches if test(env)), iter(()))

        return choose
    over, body = _evaluator(node[2]), _generator(node[3])

    def loop(env: dict, mask: bool) -> Iterator[Piece]:
        rows, n, none = iter(over(env)), 0, object()
        row = next(rows, none)
        while row is not none:  # one row ahead, so that a stream can say which is last
            after = next(rows, none)
            state = {"index": n + 1, "index0": n, "first": n == 0, "last": after is none}
            yield from body({**env, node[1]: row, "loop": state}, mask)
            row, n = after, n + 1

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A function from values to pieces ``(text, under the loss mask)``. It reads
    a ``messages`` iterator as it goes, so long conversations are streamed."""
    nodes, _, _ = _parse_block(list(_pieces(source)), 0, ())
    run = _generator(_simplified(nodes))
    return lambda values: run(dict(values), False)


FORMATTED = "_id long, segment long, formatted string, loss_starts array<int>, loss_ends array<int>"
_INTS = pa.list_(pa.int32())
FORMATTED_ARROW = pa.schema([("_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("loss_starts", _INTS), ("loss_ends", _INTS)])


def segments(pieces: Iterable[Piece], size: int = SEGMENT_CHARS) -> Iterator[tuple[str, list[int], list[int]]]:
    """Output of bounded length with the spans under the mask, cut outside them."""
    text, at, starts, ends = [], 0, [], []
    for piece, mask in pieces:
        if mask and piece:
            starts.append(at)
            ends.append(at + len(piece))
        text.append(piece)
        at += len(piece)
        if at >= size and not mask:
            yield "".join(text), starts, ends
            text, at, starts, ends = [], 0, [], []
    if text:
        yield "".join(text), starts, ends


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_conversations(rows: DataFrame, template: str = CHAT_TEMPLATE, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered conversations in segments: see ``FORMATTED``. Offsets count code
    points within the segment.

    Turns stand in order of ``turn`` (null first), ties by role and text. Null
    text or role is empty. Rows with a null id form one conversation. Repeated
    rows are repeated turns. An empty table gives no rows; other columns are
    ignored. A conversation is streamed through one task, not held in it.
    """
    compile_template(template)  # errors are raised here, not in the tasks
    chosen = rows.select(
        F.col(id_col).cast("long").alias("_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        held, size = [], 0
        for conv, turns in groupby(_messages(batches), key=lambda r: r[0]):
            messages = ({"role": r[1], "text": r[2]} for r in turns)
            for n, (out, starts, ends) in enumerate(segments(run({"messages": messages}))):
                held.append({"_id": conv, "segment": n, "formatted": out, "loss_starts": starts, "loss_ends": ends})
                size += len(out)
                if size >= 4 * SEGMENT_CHARS:
                    yield pa.RecordBatch.from_pylist(held, schema=FORMATTED_ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=FORMATTED_ARROW)

    ordered = chosen.repartition("_id").sortWithinPartitions("_id", "_turn", "_role", "_text").select("_id", "_role", "_text")
    return ordered.mapInArrow(render, FORMATTED)


READ_BACK = "_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
READ_BACK_ARROW = pa.schema([("_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def turns_of(formatted: str) -> tuple[list[tuple[str, str]], str]:
    """(role, text) of the whole turns at the start of ``formatted``, and what is
    left; made for the default template's markers."""
    turns, at = [], 0
    while formatted.startswith("<|im_start|>", at):
        line = formatted.find("\n", at)
        end = formatted.find("<|im_end|>\n", line)
        if line < 0 or end < 0:
            break
        turns.append((unescape_line(formatted[at + 12 : line]), unescape(formatted[line + 1 : end])))
        at = end + 11
    return turns, formatted[at:]


def read_back(formatted: DataFrame, id_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """Turns and loss texts recovered from the output of ``format_conversations``, as
    counts and digests. ``in_order`` says that rows are partitioned and ordered as
    that leaves them; otherwise segments are put together first. A segment that
    is not the next one of its conversation is an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv, parts in groupby(_messages(batches), key=lambda r: r[0]):
            turns_hash, loss_hash, n, loss_chars, chars, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for place, (_, segment, text, starts, ends) in enumerate(parts):
                if segment != place:
                    raise ValueError(f"conversation {conv}: segment {segment} stands in place {place}")
                chars += len(text)
                for a, b in zip(starts, ends, strict=True):
                    loss = unescape(text[a:b])
                    loss_chars += len(loss)
                    loss_hash.update(loss.encode("utf-8"))
                turns, rest = turns_of(rest + text)
                n += len(turns)
                for role, said in turns:
                    turns_hash.update(f"{role}\n{said}\n".encode())
            if rest:
                raise ValueError(f"conversation {conv} ends inside a turn")
            done.append({"_id": conv, "n_turns": n, "turns_sha256": turns_hash.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss_hash.hexdigest(), "formatted_chars": chars})
            if len(done) == 1000:
                yield pa.RecordBatch.from_pylist(done, schema=READ_BACK_ARROW)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=READ_BACK_ARROW)

    if not in_order:
        formatted = formatted.repartition("_id").sortWithinPartitions("_id", "segment")
    return formatted.mapInArrow(parse, READ_BACK).withColumnRenamed("_id", id_col)


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, 24 + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n'))
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
