"""Control flow and data flow of Java-like method bodies, one method at a time.

A body is read as statements (if, loops, switch, try, synchronized, jumps and plain
ones), from which a flow graph is built: node 0 is the entry, node 1 the exit.
Methods are independent rows, so all of this is a map over Arrow batches: nothing is
shuffled. A body that cannot be read to its end is taken as far as it goes; a null or
empty one is an edge from entry to exit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

_BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_ASSIGNED = re.compile(r"\b([A-Za-z_$][\w$]*)\s*(?:(?:[-+*/%&|^]|<<|>>>?)?=(?!=)|\+\+|--)|(?:\+\+|--)\s*([A-Za-z_$][\w$]*)")
_COMPOUND = re.compile(r"\b([A-Za-z_$][\w$]*)\s*(?:(?:[-+*/%&|^]|<<|>>>?)=(?!=)|\+\+|--)|(?:\+\+|--)\s*([A-Za-z_$][\w$]*)")
ENTRY, EXIT = 0, 1


@dataclass
class Flow:
    """Nodes as (kind, line, text), edges as (from, to, kind)."""

    nodes: list[tuple[str, int, str]] = field(default_factory=lambda: [("entry", 0, ""), ("exit", 0, "")])
    edges: list[tuple[int, int, str]] = field(default_factory=list)
    deepest: int = 0

    def reachable(self) -> set[int]:
        ahead: dict[int, list[int]] = {}
        for a, b, _ in self.edges:
            ahead.setdefault(a, []).append(b)
        seen, front = {ENTRY}, [ENTRY]
        while front:
            for b in ahead.get(front.pop(), []):
                if b not in seen:
                    seen.add(b)
                    front.append(b)
        return seen

    def complexity(self) -> int:
        """Edges less nodes plus two for every component that the exit belongs to or not."""
        parent = list(range(len(self.nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b, _ in self.edges:
            parent[root(a)] = root(b)
        return len(self.edges) - len(self.nodes) + 2 * len({root(x) for x in range(len(self.nodes))})


class _Reader:
    """Builds the graph while it reads; loose ends are (node, kind of edge) pairs that wait for the next statement."""

    def __init__(self, body: str):
        self.text = _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), body or "")
        self.at, self.flow = 0, Flow()
        self.breaks: list[list[tuple[int, str]]] = []
        self.loops: list[int | None] = []
        self.handlers: list[list[int]] = []

    def read(self) -> Flow:
        ends = self.statements([(ENTRY, "next")], False, 0)
        for node, kind in ends:
            self.flow.edges.append((node, EXIT, kind))
        return self.flow

    def skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def word(self) -> str:
        m = _WORD.match(self.text, self.at)
        return m[0] if m else ""

    def node(self, kind: str, start: int, text: str, ends: list[tuple[int, str]]) -> int:
        k = len(self.flow.nodes)
        self.flow.nodes.append((kind, self.text.count("\n", 0, start) + 1, " ".join(text.split())))
        self.flow.edges += [(n, k, e) for n, e in ends]
        if self.handlers:
            self.handlers[-1].append(k)
        return k

    def brackets(self) -> str:
        """The text of the bracket group that follows."""
        self.skip()
        if self.at >= len(self.text) or self.text[self.at] != "(":
            return ""
        depth, start = 0, self.at
        while self.at < len(self.text):
            depth += {"(": 1, ")": -1}.get(self.text[self.at], 0)
            self.at += 1
            if not depth:
                break
        return self.text[start + 1 : self.at - 1]

    def statements(self, ends: list, inside: bool, depth: int) -> list:
        while True:
            self.skip()
            if self.at >= len(self.text):
                return ends
            if self.text[self.at] == "}":
                self.at += 1
                if inside:
                    return ends
            else:
                ends = self.statement(ends, depth)

    def statement(self, ends: list, depth: int) -> list:
        self.skip()
        self.flow.deepest = max(self.flow.deepest, depth)
        start, word = self.at, self.word()
        if self.at < len(self.text) and self.text[self.at] == "{":
            self.at += 1
            return self.statements(ends, True, depth)
        reader: Callable | None = {"if": self._if, "while": self._while, "for": self._while, "do": self._do, "switch": self._switch, "try": self._try, "synchronized": self._held}.get(word)
        if reader and re.match(r"\s*[({]|\s*\w", self.text[self.at + len(word) :] or " "):
            self.at += len(word)
            return reader(ends, start, depth)
        return self._plain(ends, start, word)

    def _if(self, ends: list, start: int, depth: int) -> list:
        k = self.node("condition", start, self.brackets(), ends)
        then = self.statement([(k, "true")], depth + 1)
        self.skip()
        if self.word() == "else":
            self.at += 4
            return then + self.statement([(k, "false")], depth if re.match(r"\s*if\b", self.text[self.at :]) else depth + 1)
        return [*then, (k, "false")]

    def _body(self, k: int, ends: list, depth: int) -> list:
        """A loop's body; returns what leaves the loop by break."""
        self.breaks.append([])
        self.loops.append(k)
        back = self.statement(ends, depth + 1)
        self.flow.edges += [(n, k, "back") for n, _ in back]
        self.loops.pop()
        return self.breaks.pop()

    def _while(self, ends: list, start: int, depth: int) -> list:
        k = self.node("loop", start, self.brackets(), ends)
        return [(k, "false"), *self._body(k, [(k, "true")], depth)]

    def _do(self, ends: list, start: int, depth: int) -> list:
        head = self.node("do", start, "", ends)
        self.breaks.append([])
        self.loops.append(head)
        inside = self.statement([(head, "next")], depth + 1)
        self.loops.pop()
        self.skip()
        if self.word() == "while":
            at, self.at = self.at, self.at + 5
            k = self.node("loop", at, self.brackets(), inside)
            self.flow.edges.append((k, head, "back"))
            inside = [(k, "false")]
            self.skip()
            self.at += self.text[self.at : self.at + 1] == ";"
        return inside + self.breaks.pop()

    def _switch(self, ends: list, start: int, depth: int) -> list:
        k = self.node("switch", start, self.brackets(), ends)
        self.skip()
        self.at += self.text[self.at : self.at + 1] == "{"
        self.breaks.append([])
        self.loops.append(None)
        falls, default, label = [], False, re.compile(r"(case\b[^:>]*?|default\s*)(?::|->)")
        while True:
            self.skip()
            if self.at >= len(self.text) or self.text[self.at] == "}":
                self.at += 1
                break
            if m := label.match(self.text, self.at):
                default |= m[1].startswith("default")
                self.at = m.end()
                falls = [*falls, (k, "case")]
            else:
                falls = self.statement(falls, depth + 1)
        self.loops.pop()
        return falls + self.breaks.pop() + ([] if default else [(k, "false")])

    def _try(self, ends: list, start: int, depth: int) -> list:
        k = self.node("try", start, self.brackets(), ends)
        self.handlers.append([])
        out = self.statement([(k, "next")], depth + 1)
        inside = [k, *self.handlers.pop()]
        if self.handlers:
            self.handlers[-1] += inside[1:]
        while True:
            self.skip()
            if self.word() != "catch":
                break
            at, self.at = self.at, self.at + 5
            c = self.node("catch", at, self.brackets(), [(n, "throws") for n in inside])
            out = out + self.statement([(c, "next")], depth + 1)
        if self.word() == "finally":
            at, self.at = self.at, self.at + 7
            f = self.node("finally", at, "", out)
            out = self.statement([(f, "next")], depth + 1)
        return out

    def _held(self, ends: list, start: int, depth: int) -> list:
        k = self.node("synchronized", start, self.brackets(), ends)
        return self.statement([(k, "next")], depth + 1)

    def _plain(self, ends: list, start: int, word: str) -> list:
        depth = 0
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == ";" and depth == 0:
                self.at += 1
                break
            if c == "}" and depth == 0:
                break
            depth += {"(": 1, "{": 1, "[": 1, ")": -1, "}": -1, "]": -1}.get(c, 0)
            self.at += 1
        text = self.text[start : self.at].strip().rstrip(";")
        if not text:
            return ends
        k = self.node(word if word in ("return", "throw", "break", "continue") else "statement", start, text, ends)
        if word in ("return", "throw"):
            self.flow.edges.append((k, EXIT, word))
            return []
        if word == "break" and self.breaks:
            self.breaks[-1].append((k, "break"))
            return []
        if word == "continue" and any(x is not None for x in self.loops):
            self.flow.edges.append((k, next(x for x in reversed(self.loops) if x is not None), "continue"))
            return []
        return [(k, "next")]


def read(body: str | None) -> Flow:
    return _Reader(body or "").read()


def assigned(text: str) -> set[str]:
    return {a or b for a, b in _ASSIGNED.findall(text)}


def used(text: str) -> set[str]:
    """Names that are read: all names but those that are only assigned."""
    compound = {a or b for a, b in _COMPOUND.findall(text)}
    left = _ASSIGNED.sub(lambda m: m[0].replace(m[1] or m[2], "", 1) if (m[1] or m[2]) not in compound else m[0], text)
    return set(_WORD.findall(left))


def reaching(flow: Flow) -> list[tuple[str, int, int]]:
    """Name, node that assigns it, node that reads that value: a fixpoint over the graph."""
    gives = [assigned(text) for _, _, text in flow.nodes]
    before: dict[int, list[int]] = {}
    for a, b, _ in flow.edges:
        before.setdefault(b, []).append(a)
    out: list[set[tuple[str, int]]] = [{(v, k) for v in g} for k, g in enumerate(gives)]
    arriving: list[set[tuple[str, int]]] = [set() for _ in flow.nodes]
    changed = True
    while changed:
        changed = False
        for k in range(len(flow.nodes)):
            arriving[k] = set().union(*(out[p] for p in before.get(k, [])))
            new = {(v, k) for v in gives[k]} | {(v, d) for v, d in arriving[k] if v not in gives[k]}
            if new != out[k]:
                out[k], changed = new, True
    return sorted((v, d, k) for k, (_, _, text) in enumerate(flow.nodes) for v, d in arriving[k] if v in used(text))


def _mapped(methods: DataFrame, rows: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(f, m, *row) for f, m, body in zip(batch["file"], batch["name"], batch["body"], strict=True) for row in rows(body)]
            yield pd.DataFrame(found, columns=["file", "name", *names])

    return methods.select("file", "name", "body").mapInPandas(run, f"file string, name string, {columns}")


def flow_edges(methods: DataFrame) -> DataFrame:
    """file, name, src, dst, kind: the flow graph of every method."""
    return _mapped(methods, lambda body: read(body).edges, "src long, dst long, kind string")


def flow_nodes(methods: DataFrame) -> DataFrame:
    """file, name, node, kind, line, text, reachable."""

    def rows(body: str) -> list[tuple]:
        flow = read(body)
        seen = flow.reachable()
        return [(k, *node, k in seen) for k, node in enumerate(flow.nodes)]

    return _mapped(methods, rows, "node long, kind string, line long, text string, reachable boolean")


def flow_metrics(methods: DataFrame) -> DataFrame:
    """file, name, nodes, edges, complexity, unreachable, nesting."""

    def rows(body: str) -> list[tuple]:
        flow = read(body)
        lost = [k for k in range(2, len(flow.nodes)) if k not in flow.reachable()]
        return [(len(flow.nodes), len(flow.edges), flow.complexity(), len(lost), flow.deepest)]

    return _mapped(methods, rows, "nodes long, edges long, complexity long, unreachable long, nesting long")


def value_flows(methods: DataFrame) -> DataFrame:
    """file, name, variable, def_line, use_line: what reaches what, along all paths."""

    def rows(body: str) -> list[tuple]:
        flow = read(body)
        return sorted({(v, flow.nodes[d][1], flow.nodes[u][1]) for v, d, u in reaching(flow)})

    return _mapped(methods, rows, "variable string, def_line long, use_line long")


def tainted(methods: DataFrame, sources: str, sinks: str, cleaners: str) -> DataFrame:
    """file, name, source_line, sink_line: a value of a source reaches a sink through assignments, along some path, and no cleaner on the way."""
    source, sink, cleaner = re.compile(sources), re.compile(sinks), re.compile(cleaners)

    def rows(body: str) -> list[tuple]:
        flow = read(body)
        ahead: dict[tuple[str, int], set[int]] = {}
        for v, d, u in reaching(flow):
            ahead.setdefault((v, d), set()).add(u)
        found = set()
        for start, (_, line, text) in enumerate(flow.nodes):
            if not source.search(text):
                continue
            seen, front = set(), [(v, start) for v in assigned(text)]
            while front:
                v, d = front.pop()
                for u in ahead.get((v, d), ()):
                    said = flow.nodes[u][2]
                    if cleaner.search(said):
                        continue
                    if sink.search(said):
                        found.add((line, flow.nodes[u][1]))
                    new = [(w, u) for w in assigned(said) if (w, u) not in seen]
                    seen.update(new)
                    front += new
        return sorted(found)

    return _mapped(methods, rows, "source_line long, sink_line long")
