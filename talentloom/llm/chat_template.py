"""A compiler of chat templates, and conversations rendered by it with the stretches that training takes its loss from.

The template language has text, ``{{ expression }}``, ``{% for x in list %}``, ``{% if %} {% elif %} {% else %}``, ``{% set %}``, ``{# remarks #}`` and
``{% generation %}`` around what a model has to say; a dash inside a tag eats the white space beside it. Expressions have strings, whole numbers, true,
false, none, names, fields (``m.role``), ``or and not in == != < <= > >= + ~ %`` and filters (``m.text | guard``).

A template is cut into tokens, parsed into a tree of tuples, and folded: constant expressions become values, decided branches go, neighbouring texts melt.
From the tree come Python closures, one per node, which give out pieces of text as they go; nothing is built from source code. It is a sandbox: fields are read
from mappings alone, there are no calls, indexes or attributes of Python objects, filters are the given ones, and loops run over what they are given.

Rendering pulls messages one at a time, so a conversation of any length is formatted while its rows stream by in order.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from talentloom.llm.common import slices


class TemplateError(ValueError):
    """A template that is not in the language, or that a value does not fit."""


# --- tokens -----------------------------------------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_WORD = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>+~%|.(),=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _pieces_of(source: str) -> list[tuple[str, str]]:
    """(kind, inside) of texts, outputs and statements, white space beside dashes eaten."""
    parts = _TAG.split(source)
    out = []
    for k, part in enumerate(parts):
        if k % 2 == 0:
            if k and parts[k - 1].endswith(("-}}", "-%}")):
                part = part.lstrip()
            if k + 1 < len(parts) and parts[k + 1].startswith(("{{-", "{%-")):
                part = part.rstrip()
            if "{{" in part or "{%" in part:
                raise TemplateError(f"a tag stays open in {part!r}")
            if part:
                out.append(("text", part))
        elif not part.startswith("{#"):
            out.append(("output" if part.startswith("{{") else "statement", part[2:-2].strip("-").strip()))
    return out


def _words_of(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        found = _WORD.match(source, at)
        if not found:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    return out


# --- tree -------------------------------------------------------------------------------------------------------------------------------------------

class _Expressions:
    """Reads one expression; binding grows from ``or`` down to filters and fields."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+",), ("%",))
    CONSTANTS = {"true": True, "false": False, "none": None}

    def __init__(self, words: list[tuple[str, str]]):
        self.words, self.at = words, 0

    def whole(self) -> tuple:
        tree = self.level(0)
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return tree

    def next(self, *wanted: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] != "string" and self.words[self.at][1] in wanted:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def level(self, n: int) -> tuple:
        if n == len(self.LEVELS):
            return self.filtered()
        if self.LEVELS[n] == ("not",):
            return ("not", self.level(n)) if self.next("not") else self.level(n + 1)
        tree = self.level(n + 1)
        while True:
            negated = self.LEVELS[n][-1] == "in" and self.words[self.at : self.at + 2] == [("name", "not"), ("name", "in")]
            self.at += negated
            sign = self.next(*self.LEVELS[n])
            if not sign:
                return tree
            tree = ("binary", sign, tree, self.level(n + 1))
            tree = ("not", tree) if negated else tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while sign := self.next("|", "."):
            kind, name = self.words[self.at] if self.at < len(self.words) else ("", "")
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"no name behind {sign!r}")
            self.at += 1
            tree = ("filter", name, tree) if sign == "|" else ("field", tree, name)
        return tree

    def atom(self) -> tuple:
        if self.at >= len(self.words):
            raise TemplateError("expression ends too early")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "string":
            return ("value", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "number":
            return ("value", int(word))
        if word == "(":
            tree = self.level(0)
            if not self.next(")"):
                raise TemplateError("a parenthesis stays open")
            return tree
        if kind != "name":
            raise TemplateError(f"unexpected {word!r}")
        return ("value", self.CONSTANTS[word]) if word in self.CONSTANTS else ("name", word)


def parse(source: str) -> tuple:
    """The tree of a template: ("list", nodes) of text, output, for, if, set and generation nodes."""
    pieces = _pieces_of(source)
    at = 0

    def expression(words):
        return _Expressions(words).whole()

    def block(ends: tuple[str, ...], inside: bool) -> tuple[tuple, str]:
        nonlocal at
        nodes = []
        while at < len(pieces):
            kind, held = pieces[at]
            at += 1
            if kind == "text":
                nodes.append(("text", held))
                continue
            words = _words_of(held)
            if kind == "output":
                nodes.append(("output", expression(words)))
                continue
            head = words[0][1] if words else ""
            if head in ends:
                return ("list", tuple(nodes)), held
            if head == "for" and len(words) > 3 and words[1][0] == "name" and words[2] == ("name", "in"):
                body, _ = block(("endfor",), inside)
                nodes.append(("for", words[1][1], expression(words[3:]), body))
            elif head == "if":
                nodes.append(branches(words[1:], inside))
            elif head == "set" and len(words) > 3 and words[1][0] == "name" and words[2] == ("sign", "="):
                nodes.append(("set", words[1][1], expression(words[3:])))
            elif head == "generation" and len(words) == 1:
                if inside:
                    raise TemplateError("generation inside generation")
                nodes.append(("generation", block(("endgeneration",), True)[0]))
            else:
                raise TemplateError(f"unknown statement {held!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("list", tuple(nodes)), ""

    def branches(condition, inside: bool) -> tuple:
        asked = expression(condition)
        then, end = block(("elif", "else", "endif"), inside)
        words = _words_of(end)
        if words[0][1] == "elif":
            return ("if", asked, then, ("list", (branches(words[1:], inside),)))
        if words[0][1] == "else":
            return ("if", asked, then, block(("endif",), inside)[0])
        return ("if", asked, then, ("list", ()))

    return block((), False)[0]


# --- folding ----------------------------------------------------------------------------------------------------------------------------------------

def _text(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _add(a, b):
    if type(a) is not type(b) or type(a) not in (str, int):
        raise TemplateError("+ takes two strings or two numbers")
    return a + b


def _remainder(a, b):
    if type(a) is not int or type(b) is not int or b == 0:
        raise TemplateError("% takes two numbers, the second not 0")
    return a % b


def _ordered(compare):
    def run(a, b):
        if type(a) is not type(b) or type(a) not in (str, int):
            raise TemplateError("only two strings or two numbers have an order")
        return compare(a, b)
    return run


def _held(a, b):
    if not (isinstance(b, str) and isinstance(a, str)):
        raise TemplateError("in takes two strings")
    return a in b


_BINARY = {"==": operator.eq, "!=": operator.ne, "<": _ordered(operator.lt), "<=": _ordered(operator.le), ">": _ordered(operator.gt), ">=": _ordered(operator.ge),
           "+": _add, "~": lambda a, b: _text(a) + _text(b), "%": _remainder, "in": _held}
FILTERS: dict[str, Callable] = {"trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
                                "length": lambda v: len(_text(v))}


def fold(tree: tuple, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """The tree with constants worked out, decided branches and empty nodes gone, neighbouring texts in one."""
    kind = tree[0]
    if kind in ("value", "name", "text"):
        return tree
    if kind == "field":
        return ("field", fold(tree[1], filters), tree[2])
    if kind == "filter":
        inner = fold(tree[2], filters)
        if tree[1] not in filters:
            raise TemplateError(f"unknown filter {tree[1]!r}")
        return ("value", filters[tree[1]](inner[1])) if inner[0] == "value" else ("filter", tree[1], inner)
    if kind == "not":
        inner = fold(tree[1], filters)
        return ("value", not inner[1]) if inner[0] == "value" else ("not", inner)
    if kind == "binary":
        sign, a, b = tree[1], fold(tree[2], filters), fold(tree[3], filters)
        if a[0] == "value" and sign in ("and", "or"):
            return b if bool(a[1]) == (sign == "and") else a
        if a[0] == b[0] == "value":
            return ("value", _BINARY[sign](a[1], b[1]))
        return ("binary", sign, a, b)
    if kind == "output":
        inner = fold(tree[1], filters)
        return ("text", _text(inner[1])) if inner[0] == "value" else ("output", inner)
    if kind == "set":
        return ("set", tree[1], fold(tree[2], filters))
    if kind == "generation":
        return ("generation", fold(tree[1], filters))
    if kind == "for":
        return ("for", tree[1], fold(tree[2], filters), fold(tree[3], filters))
    if kind == "if":
        asked = fold(tree[1], filters)
        if asked[0] == "value":
            return fold(tree[2] if asked[1] else tree[3], filters)
        return ("if", asked, fold(tree[2], filters), fold(tree[3], filters))
    nodes: list[tuple] = []
    for node in (fold(n, filters) for n in tree[1]):
        for one in node[1] if node[0] == "list" else (node,):
            if one[0] == "text" and nodes and nodes[-1][0] == "text":
                nodes[-1] = ("text", nodes[-1][1] + one[1])
            elif one != ("text", ""):
                nodes.append(one)
    return ("list", tuple(nodes))


# --- closures ---------------------------------------------------------------------------------------------------------------------------------------

#: Marks among the pieces of text: a model's words begin and end; a loop outside others takes its next item.
BEGIN, END, STEP = object(), object(), object()


def _valued(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "value":
        return lambda scope, value=tree[1]: value
    if kind == "name":
        def named(scope, name=tree[1]):
            if name not in scope:
                raise TemplateError(f"unknown name {name!r}")
            return scope[name]
        return named
    if kind == "field":
        inner = _valued(tree[1], filters)

        def field(scope, name=tree[2]):
            held = inner(scope)
            if not isinstance(held, Mapping):
                raise TemplateError(f"no fields to take {name!r} from")
            return held.get(name)
        return field
    if kind == "filter":
        inner, run = _valued(tree[2], filters), filters[tree[1]]
        return lambda scope: run(inner(scope))
    if kind == "not":
        inner = _valued(tree[1], filters)
        return lambda scope: not inner(scope)
    sign, a, b = tree[1], _valued(tree[2], filters), _valued(tree[3], filters)
    if sign == "and":
        return lambda scope: a(scope) and b(scope)
    if sign == "or":
        return lambda scope: a(scope) or b(scope)
    run = _BINARY[sign]
    return lambda scope: run(a(scope), b(scope))


def _rendering(tree: tuple, filters: Mapping[str, Callable], depth: int = 0) -> Callable[[dict], Iterator]:
    kind = tree[0]
    if kind == "list":
        nodes = [_rendering(n, filters, depth) for n in tree[1]]

        def every(scope):
            for node in nodes:
                yield from node(scope)
        return every
    if kind == "text":
        return lambda scope, held=(tree[1],): iter(held)
    if kind == "output":
        inner = _valued(tree[1], filters)
        return lambda scope: iter((_text(inner(scope)),))
    if kind == "set":
        inner = _valued(tree[2], filters)

        def put(scope, name=tree[1]):
            scope[name] = inner(scope)
            return iter(())
        return put
    if kind == "generation":
        body = _rendering(tree[1], filters, depth + 1)

        def marked(scope):
            yield BEGIN
            yield from body(scope)
            yield END
        return marked
    if kind == "if":
        asked, then, other = _valued(tree[1], filters), _rendering(tree[2], filters, depth), _rendering(tree[3], filters, depth)
        return lambda scope: then(scope) if asked(scope) else other(scope)
    items, body = _valued(tree[2], filters), _rendering(tree[3], filters, depth + 1)

    def loop(scope, name=tree[1]):
        given = items(scope)
        if isinstance(given, (str, Mapping)) or not isinstance(given, Iterable):
            raise TemplateError("a loop needs a list")
        inner = dict(scope)
        ahead = iter(given)
        none = object()
        item, index = next(ahead, none), 0
        while item is not none:
            later = next(ahead, none)
            inner[name] = item
            inner["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": later is none}
            if depth == 0:
                yield STEP
            yield from body(inner)
            item, index = later, index + 1
    return loop


class _Once:
    """Messages that stream by: a second loop over them has nothing to read, so it is refused."""

    def __init__(self, messages: Iterator):
        self.messages = messages

    def __iter__(self):
        if self.messages is None:
            raise TemplateError("messages can be looped over only once")
        out, self.messages = self.messages, None
        return out


class Template:
    """A compiled template."""

    def __init__(self, source: str, filters: Mapping[str, Callable] = FILTERS):
        self.tree = fold(parse(source), filters)
        self._run = _rendering(self.tree, filters)

    def pieces(self, **names) -> Iterator:
        """Pieces of text and marks, as they come."""
        return self._run(names)

    def render(self, **names) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the (start, end) places of what stands in generation blocks."""
        parts, spans, size, start = [], [], 0, 0
        for piece in self.pieces(**names):
            if piece is BEGIN:
                start = size
            elif piece is END:
                spans.append((start, size))
            elif piece is not STEP:
                parts.append(piece)
                size += len(piece)
        return "".join(parts), spans


# --- control strings --------------------------------------------------------------------------------------------------------------------------------

class Guard:
    """Escapes control strings inside texts, and takes the escapes out again.

    A backslash goes behind the first character of every control string, and one more where such backslashes stand already, so nothing else of a text
    changes, no guarded text holds a control string, and ``plain`` gives every text back.
    """

    def __init__(self, control: Iterable[str]):
        rests: dict[str, list[str]] = {}
        for c in sorted(set(control)):
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        self._forms = re.compile("|".join(rf"{re.escape(head)}\\*(?={'|'.join(rest)})" for head, rest in rests.items()))

    def guarded(self, text) -> str:
        return self._forms.sub(lambda m: m[0] + "\\", _text(text))

    def plain(self, text: str) -> str:
        return self._forms.sub(lambda m: m[0][:-1] if len(m[0]) > 1 else m[0], text)


#: The strings that mark turns of the production template.
CONTROL = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[TURN]", "[TEXT]", "[/TURN]")
GUARD = Guard(CONTROL)
CHAT = """
{%- for m in messages -%}
  {%- if m.role == 'system' -%}    <<SYS>>{{ m.text | guard }}<</SYS>>
  {%- elif m.role == 'user' -%}    [INST]{{ m.text | guard }}[/INST]
  {%- elif m.role == 'assistant' -%} <s>{% generation %}{{ m.text | guard }}{% endgeneration %}</s>
  {%- else -%}                     [TURN]{{ m.role | guard }}[TEXT]{{ m.text | guard }}[/TURN]
  {%- endif -%}
{%- endfor -%}
"""
_TURNS = re.compile(r"<<SYS>>(.*?)<</SYS>>|\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|\[TURN\](.*?)\[TEXT\](.*?)\[/TURN\]", re.S)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a text that the production template made."""
    at = 0
    while at < len(text):
        found = _TURNS.match(text, at)
        if not found:
            raise TemplateError(f"no turn at {at}")
        system, user, assistant, role, other = found.groups()
        if system is not None:
            yield "system", GUARD.plain(system)
        elif user is not None:
            yield "user", GUARD.plain(user)
        elif assistant is not None:
            yield "assistant", GUARD.plain(assistant)
        else:
            yield GUARD.plain(role), GUARD.plain(other)
        at = found.end()


# --- tables -----------------------------------------------------------------------------------------------------------------------------------------

#: Characters from which on a conversation goes on in another row, at its next turn.
PART_CHARS = 4_000_000


def _parts(pieces: Iterator, most: int) -> Iterator[tuple[str, list[dict]]]:
    """(text, spans) rows of a conversation, cut where a turn begins."""
    held, spans, size, start = [], [], 0, None
    for piece in pieces:
        if piece is BEGIN:
            start = size
        elif piece is END:
            spans.append({"start": start, "end": size})
            start = None
        elif piece is not STEP:
            held.append(piece)
            size += len(piece)
        elif size >= most and start is None:
            yield "".join(held), spans
            held, spans, size = [], [], 0
    yield "".join(held), spans


def formatted(conversations: DataFrame, source: str = CHAT, control: Iterable[str] = CONTROL, part_chars: int = PART_CHARS,
              id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, part, text, loss): conversations rendered by a template, ``loss`` the (start, end) code points of its generation blocks.

    Turns stand in order of turn, ties in order of role and text, nulls first; repeated rows are turns of their own. A null role or text is an empty one,
    rows without id are one conversation, other columns play no part, and a table without rows gives none. A conversation is one row, part 0, unless it is
    longer than ``part_chars``: then its parts follow each other, each of whole turns. Rows of a conversation meet in one task, sorted, and stream through
    the template turn by turn: memory is bounded by a part and a turn, however long the conversation.
    """
    control = tuple(control)
    kind = conversations.schema[id_col].dataType.simpleString()

    def run(batches):
        guard = Guard(control)
        template = Template(source, {**FILTERS, "guard": guard.guarded})
        rows = (row for batch in slices(batches) for row in zip(*(batch.column(k).to_pylist() for k in range(3))))
        out, weight = [], 0
        for key, group in itertools.groupby(rows, key=operator.itemgetter(0)):
            messages = ({"role": r or "", "text": t or ""} for _, r, t in group)
            for n, (text, spans) in enumerate(_parts(template.pieces(messages=_Once(messages)), part_chars)):
                out.append((key, n, text, spans))
                weight += len(text) + 100
                if weight > part_chars:
                    yield _batch(out, id_type)
                    out, weight = [], 0
        if out:
            yield _batch(out, id_type)

    id_type = to_arrow_type(conversations.schema[id_col].dataType)
    asked = conversations.select(F.col(id_col).alias("id"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"),
                                 F.col(turn_col).alias("turn"))
    ordered = asked.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    return ordered.mapInArrow(run, f"id {kind}, part long, text string, loss array<struct<start:long,end:long>>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = (id_type, pa.int64(), pa.string(), _SPANS)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["id", "part", "text", "loss"])


def read_back(rows: DataFrame) -> DataFrame:
    """Rows (id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from what ``formatted`` gave by the production template.

    Turns are found by their marks and unescaped; loss texts are the stretches of ``loss``, unescaped. Parts of a conversation must follow each other, as
    ``formatted`` gives them. Digests grow part by part, so a long conversation takes no more memory than one of its parts.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        held = (row for batch in slices(batches) for row in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "loss"))))
        out = []
        for key, parts in itertools.groupby(held, key=operator.itemgetter(0)):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = n_loss = n_chars = 0
            for _, text, spans in parts:
                for role, said in turns_of(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for span in spans:
                    said = GUARD.plain(text[span["start"] : span["end"]])
                    loss.update(said.encode())
                    n_loss += len(said)
                n_chars += len(text)
            out.append((key, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))
            if len(out) == 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    id_type = to_arrow_type(rows.schema["id"].dataType)
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch_of(out):
        types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=names)

    return rows.select("id", "text", "loss").mapInArrow(
        run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Fixed value: the turns that try the escapes, as a conversation of their own.
TRIAL_ID, TRIAL_TEXT = -7, "</s>[INST] ok [/INST]"


def with_trial(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, whose texts are made of control strings."""
    spark = conversations.sparkSession
    rows = spark.range(2).select(F.lit(TRIAL_ID).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(TRIAL_TEXT).alias("text"))
    kinds = dict(conversations.dtypes)
    names = ("conv_id", "turn", "role", "text")
    return conversations.select(*names).union(rows.select(*[F.col(c).cast(kinds[c]) for c in names]))


SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as role0, text as text0 from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', ''),
sized as (
  select *, regexp_extract_all(text, '<\\*<SYS>>|<\\*</SYS>>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|\[\\*TURN\]|\[\\*TEXT\]|\[\\*/TURN\]') as marks,
         regexp_extract_all(role, '<\\*<SYS>>|<\\*</SYS>>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|\[\\*TURN\]|\[\\*TEXT\]|\[\\*/TURN\]') as role_marks
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role0 nulls first, text0 nulls first)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role0 nulls first, text0 nulls first) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(text) + len(marks)
                + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 19 + length(role) + len(role_marks) end) as bigint) as formatted_chars
from sized group by conv_id
"""
