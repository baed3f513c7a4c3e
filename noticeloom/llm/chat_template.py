"""Chat formatting: a compiler for a small sandboxed template language.

``parse`` turns a template into a syntax tree, ``fold`` evaluates its constant parts, ``compile_template``
generates Python closures from the tree. The language has text, ``{{ expression }}``, ``{% for %}``, ``{% if %}``,
``{% set %}``, ``{% generation %}`` and ``{# comments #}``. A template reaches only the data that it is given:
names, subscripts of mappings and lists, literals, comparisons, ``and or not in``, ``+ ~``, a conditional and the
named filters; there are no calls, no attributes of Python objects and no unbounded loops.
What ``{% generation %}`` encloses is under the loss mask: a renderer returns the text and its masked spans.

Turns are rendered one by one, in a stream sorted by conversation and turn, so memory is bounded by one turn and a
conversation of any length is formatted. Defined results: a null text or role is empty; repeated rows are turns of
their own, ordered by turn, role and text; turns that are null come first; a null conv_id is a conversation too; an
empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import read_table

#: Strings that only the template itself may write; inside texts they are escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>")

#: One turn: header, then the text; only an assistant's own text is under the loss mask.
TEMPLATE = (
    "{%- for m in messages -%}<s><|turn|>{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}<|end|></s>{% endfor %}"
)

FORMATTED = "conv_id long, position long, role string, formatted string, mask array<struct<start:long,end:long>>"


class TemplateError(ValueError):
    """The template is not in the language."""


def escaper(controls: tuple[str, ...] = CONTROLS, line: bool = False) -> Callable[[str], str]:
    """Puts a backslash before each backslash and after the first character of each control string.

    ``unescape`` undoes it. Control strings must not contain a backslash nor begin inside one another."""
    for a in controls:
        if "\\" in a or len(a) < 2 or any(a[-k:] == b[:k] for b in controls for k in range(1, min(len(a), len(b))) if a != b or k < len(a)):
            raise TemplateError(f"control strings must be free of backslashes and overlaps: {a!r}")
    found = re.compile("|".join(["\\\\", *(["\n"] if line else []), *map(re.escape, controls)]))

    def change(m: re.Match) -> str:
        x = m.group()
        return "\\" + x if len(x) == 1 else x[0] + "\\" + x[1:]

    return lambda text: found.sub(change, text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {
    "escape": escaper(),
    "escape_line": escaper(line=True),
    "trim": lambda x: (x or "").strip(),
    "upper": lambda x: (x or "").upper(),
    "lower": lambda x: (x or "").lower(),
    "length": lambda x: len(x or ""),
}

# --- syntax tree: tuples whose first element names the node --------------------------------------------------------

_TAG = re.compile(r"(\{\{-?|\{%-?|\{#)(.*?)(-?\}\}|-?%\}|#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.()\[\],]))")


class _Expr:
    """Recursive descent over one expression; lowest precedence first."""

    def __init__(self, text: str):
        self.items, at = [], 0
        while text[at:].strip():
            if not (m := _TOKEN.match(text, at)):
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "str" and self.items[self.at][1] in words

    def take(self, *words: str) -> bool:
        hit = self.peek(*words)
        self.at += hit
        return hit

    def whole(self) -> tuple:
        node = self.choice()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.take("if"):
            test = self.either()
            return ("choice", test, node, self.choice() if self.take("else") else ("const", ""))
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.summed()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            self.at += 1
            node = ("cmp", self.items[self.at - 1][1], node, self.summed())
        return node

    def summed(self) -> tuple:
        node = self.filtered()
        while self.peek("+", "~"):
            self.at += 1
            node = ("add" if self.items[self.at - 1][1] == "+" else "cat", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.peek(".", "[", "|"):
            op = self.items[self.at][1]
            self.at += 1
            if op == "[":
                node = ("item", node, self.choice())
                if not self.take("]"):
                    raise TemplateError("missing ]")
                continue
            if self.at >= len(self.items) or self.items[self.at][0] != "name":
                raise TemplateError(f"a name must follow {op}")
            name = self.items[self.at][1]
            self.at += 1
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no such filter: {name}")
            node = ("filter", name, node) if op == "|" else ("item", node, ("const", name))
        return node

    def atom(self) -> tuple:
        if self.at >= len(self.items):
            raise TemplateError("an expression ends too early")
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "num":
            return ("const", int(text))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        if text == "(":
            node = self.choice()
            if self.take(")"):
                return node
        raise TemplateError(f"unexpected {text!r}")


def parse(template: str) -> list[tuple]:
    """The template's syntax tree."""
    parts, at, strip = [], 0, False
    for m in _TAG.finditer(template):
        text = template[at : m.start()]
        text = text.lstrip() if strip else text
        parts.append(("text", text.rstrip() if m[1].endswith("-") else text))
        if not m[1].startswith("{#"):
            parts.append(("out" if m[1].startswith("{{") else "tag", m[2].strip()))
        strip, at = m[3].startswith("-"), m.end()
    parts.append(("text", template[at:].lstrip() if strip else template[at:]))
    parts = [p for p in parts if p != ("text", "")]
    if bad := next((t for k, t in parts if k == "text" and re.search(r"\{[{%#]", t)), None):
        raise TemplateError(f"a tag is not closed: {bad!r}")
    nodes, rest = _block(parts, 0, ())
    return nodes


def _block(parts: list, at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int]:
    nodes: list[tuple] = []
    while at < len(parts):
        kind, text = parts[at]
        at += 1
        if kind == "text":
            nodes.append(("text", text))
            continue
        if kind == "out":
            nodes.append(("out", _Expr(text).whole()))
            continue
        word, _, rest = text.partition(" ")
        if word in ends:
            return nodes, at - 1
        if word == "for":
            if not (m := re.fullmatch(r"(\w+) in (.+)", rest.strip(), re.S)):
                raise TemplateError(f"cannot read {text!r}")
            body, at = _block(parts, at, ("endfor",))
            nodes.append(("for", m[1], _Expr(m[2]).whole(), body))
            at = _close(parts, at, "endfor")
        elif word == "if":
            arms, test = [], _Expr(rest).whole()
            while True:
                body, at = _block(parts, at, ("elif", "else", "endif"))
                arms.append((test, body))
                word, _, rest = (parts[at][1] if at < len(parts) else "").partition(" ")
                if word not in ("elif", "else"):
                    break
                at += 1
                test = _Expr(rest).whole() if word == "elif" else ("const", True)
            nodes.append(("if", arms))
            at = _close(parts, at, "endif")
        elif word == "set":
            if not (m := re.fullmatch(r"(\w+)\s*=\s*(.+)", rest.strip(), re.S)):
                raise TemplateError(f"cannot read {text!r}")
            nodes.append(("set", m[1], _Expr(m[2]).whole()))
        elif word == "generation":
            body, at = _block(parts, at, ("endgeneration",))
            nodes.append(("generation", body))
            at = _close(parts, at, "endgeneration")
        else:
            raise TemplateError(f"unknown tag: {text!r}")
    if ends:
        raise TemplateError(f"missing {' or '.join(ends)}")
    return nodes, at


def _close(parts: list, at: int, end: str) -> int:
    if at >= len(parts) or parts[at][1].split(" ")[0] != end:
        raise TemplateError(f"missing {end}")
    return at + 1


def _fold(node: tuple) -> tuple:
    """An expression with its constant parts evaluated."""
    if node[0] in ("const", "name"):
        return node
    node = tuple(_fold(x) if isinstance(x, tuple) else x for x in node)
    return ("const", _expression(node)({})) if all(x[0] == "const" for x in node[1:] if isinstance(x, tuple)) else node


def fold(nodes: list[tuple]) -> list[tuple]:
    """The tree with constant expressions evaluated, dead branches removed and neighbouring texts joined."""
    out: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "out":
            x = _fold(node[1])
            put(("text", _text(x[1])) if x[0] == "const" else ("out", x))
        elif node[0] == "if":
            arms = []
            for test, body in node[1]:
                test = _fold(test)
                if test[0] != "const" or test[1]:
                    arms.append((test, fold(body)))
                if test[0] == "const" and test[1]:
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    put(x)
            elif arms:
                put(("if", arms))
        elif node[0] == "for":
            put(("for", node[1], _fold(node[2]), fold(node[3])))
        elif node[0] == "generation":
            put(("generation", fold(node[1])))
        else:
            put(("set", node[1], _fold(node[2])) if node[0] == "set" else node)
    return out


# --- closures ------------------------------------------------------------------------------------------------------


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def _item(x, k):
    if isinstance(x, dict):
        return x.get(k)
    if isinstance(x, list) and isinstance(k, int) and -len(x) <= k < len(x):
        return x[k]
    return None


_CMP = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in (b or ()),
}


def _expression(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "filter":
        f, x = FILTERS[node[1]], _expression(node[2])
        return lambda env: f(x(env))
    if kind == "cmp":
        f, x, y = _CMP[node[1]], _expression(node[2]), _expression(node[3])
        return lambda env: f(x(env), y(env))
    x, *more = [_expression(n) for n in node[1:]]
    if kind == "not":
        return lambda env: not x(env)
    y = more[0]
    if kind == "item":
        return lambda env: _item(x(env), y(env))
    if kind == "or":
        return lambda env: x(env) or y(env)
    if kind == "and":
        return lambda env: x(env) and y(env)
    if kind == "add":
        return lambda env: x(env) + y(env)
    if kind == "cat":
        return lambda env: _text(x(env)) + _text(y(env))
    z = more[1]
    return lambda env: y(env) if x(env) else z(env)


class _Out:
    """Text so far, and the masked spans."""

    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _body(nodes: list[tuple]) -> Callable[[dict, _Out], None]:
    steps = [_statement(n) for n in nodes]

    def run(env: dict, out: _Out) -> None:
        for step in steps:
            step(env, out)

    return run


def _statement(node: tuple) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.put(text)
    if kind == "out":
        x = _expression(node[1])
        return lambda env, out: out.put(_text(x(env)))
    if kind == "set":
        name, value = node[1], _expression(node[2])
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "generation":
        body = _body(node[1])

        def masked(env: dict, out: _Out) -> None:
            start = out.size
            body(env, out)
            if out.size > start:
                out.spans.append((start, out.size))

        return masked
    if kind == "if":
        arms = [(_expression(test), _body(body)) for test, body in node[1]]

        def branch(env: dict, out: _Out) -> None:
            for test, body in arms:
                if test(env):
                    return body(env, out)

        return branch
    name, values, body = node[1], _expression(node[2]), _body(node[3])

    def loop(env: dict, out: _Out) -> None:
        items = values(env) or []
        for i, x in enumerate(items):
            body(env | {name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, out)

    return loop


def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A renderer: given the data, the text and its masked spans."""
    body = _body(fold(parse(template)))

    def render(data: dict) -> tuple[str, list[tuple[int, int]]]:
        body(dict(data), out := _Out())
        return "".join(out.parts), out.spans

    return render


def compile_turns(template: str) -> tuple[Callable, Callable, Callable]:
    """Closures for what comes before the loop over ``messages``, for one turn, and for what follows the loop.

    For templates that read ``messages`` in one loop at the top only: their turns need nothing but the turn, its
    position and whether it is the last."""
    nodes = fold(parse(template))
    loops = [i for i, n in enumerate(nodes) if n[0] == "for" and n[2] == ("name", "messages")]
    if len(loops) != 1 or str(nodes).count("('name', 'messages')") != 1 or any(n[0] == "set" for n in nodes):
        raise TemplateError("the template must read messages in one loop at the top")
    at = loops[0]
    head, body, tail, name = _body(nodes[:at]), _body(nodes[at][3]), _body(nodes[at + 1 :]), nodes[at][1]

    def whole(run: Callable) -> Callable:
        def render(env: dict) -> tuple[str, list[tuple[int, int]]]:
            run(env, out := _Out())
            return "".join(out.parts), out.spans

        return render

    turn = whole(body)
    return whole(head), lambda x, i, last: turn({name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": last}}), whole(tail)


# --- Spark ---------------------------------------------------------------------------------------------------------


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    df = conversations.select("conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, role, text, whether the conversation ends with it), looking one turn ahead."""
    rows = chain.from_iterable(zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True) for b in batches)
    held = next(rows, None)
    for x in rows:
        yield *held, x[0] != held[0]
        held = x
    if held is not None:
        yield *held, True


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per turn, in order: conv_id, position, role, formatted text and the masked spans in it.

    A conversation's formatted text is that of its rows by position; what the template writes before or after its
    loop belongs to the first or last row."""
    compile_turns(template)  # a bad template fails here, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, turn, tail = compile_turns(template)
        rows, i, size = [], 0, 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], mask)], ["conv_id", "position", "role", "formatted", "mask"])

        mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for conv, role, text, last in _turns(batches):
            pieces = ([head({})] if i == 0 else []) + [turn({"role": role, "text": text}, i, last)] + ([tail({})] if last else [])
            spans, at = [], 0
            for piece, marked in pieces:
                spans += [{"start": at + s, "end": at + e} for s, e in marked]
                at += len(piece)
            rows.append((conv, i, role, "".join(p for p, _ in pieces), spans))
            size += at
            i = 0 if last else i + 1
            if len(rows) >= 5000 or size > 8_000_000:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return _sorted_turns(conversations).mapInArrow(run, FORMATTED)


_READ = re.compile(r"<s><\|turn\|>((?:\\.|[^\\\n])*)\n(.*?)<\|end\|></s>\n?", re.S)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in text that ``TEMPLATE`` made."""
    for m in _READ.finditer(formatted):
        body = m[2]
        body = body[len("[INST]") : -len("[/INST]")] if body.startswith("[INST]") else body
        yield unescape(m[1]), unescape(body)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from ``format_conversations``' rows as they stream by: what reads back from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, state = [], None, None

        def close() -> None:
            out.append((held[0], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for conv, position, text, mask in zip(*(b[c].to_pylist() for c in ("conv_id", "position", "formatted", "mask")), strict=True):
                if position == 0:
                    if held is not None:
                        close()
                    held, state = (conv,), {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                for role, said in read_back(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                for span in mask:
                    said = unescape(text[span["start"] : span["end"]])
                    state["chars"] += len(said)
                    state["loss"].update(said.encode())
                state["size"] += len(text)
            if len(out) >= 5000:
                yield flush()
                out.clear()
        if held is not None:
            close()
        if out:
            yield flush()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("conv_id", "x.*")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(rows))


_ESCAPED = r"""regexp_replace(replace({x}, '\', '\\'), '(<)(s>|/s>|\|turn\|>|\|end\|>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g')"""

OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format(x="text")}) + length(replace({_ESCAPED.format(x="role")}, chr(10), chr(92) || chr(10)))
    + length('<s><|turn|>' || '<|end|></s>') + 1 + CASE WHEN role = 'assistant' THEN 0 ELSE length('[INST][/INST]') END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
