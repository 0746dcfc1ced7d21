"""Query-string syntax: words, "phrases", +must, -not, AND, OR, NOT, ( ), field:term, ranges, prefix*, ^boost."""

from __future__ import annotations

import re

from lakeglean.plans import ast
from lakeglean.plans.errors import QueryError

_TOKEN = re.compile(r"""
    (?P<space>\s+) | (?P<open>\() | (?P<close>\)) | (?P<and>(?:AND|&&)(?=[\s(]|$)) | (?P<or>(?:OR|\|\|)(?=[\s(]|$)) | (?P<not>NOT(?=[\s(]|$))
  | (?P<sign>[+-](?=\S)) | (?P<field>(?:[\w.@]|\\.)+:(?=\S))
  | "(?P<phrase>(?:[^"\\]|\\.)*)"(?:~(?P<slop>\d+))?
  | (?P<range>[\[{]\s*(?P<lo>\S+)\s+TO\s+(?P<hi>[^\s\]}]+)\s*[\]}]) | (?P<cmp>[<>]=?)(?P<cv>[^\s()]+)
  | \^(?P<boost>\d+(?:\.\d+)?) | (?P<word>(?:[^\s()"\[\]{}^:]|\\.)+) | (?P<bad>.)
""", re.X)


class _Parser:
    def __init__(self, text: str, compiler, fields: list[str], conjunctive: bool, strict: bool):
        self.c, self.fields, self.conjunctive, self.strict = compiler, fields, conjunctive, strict
        self.tokens = [m for m in _TOKEN.finditer(text) if m.lastgroup != "space"]
        self.i = 0

    def fail(self, why: str) -> None:
        if self.strict:
            raise QueryError(f"syntax error: {why}")

    def peek(self) -> str:
        return self.kind(self.tokens[self.i]) if self.i < len(self.tokens) else "end"

    @staticmethod
    def kind(m) -> str:
        for k in ("open", "close", "and", "or", "not", "sign", "field", "phrase", "range", "cmp", "boost", "word"):
            if m[k] is not None:
                return k
        return "bad"

    def group(self, depth: int = 0) -> ast.Node:
        """Clauses up to ')' or the end. AND binds tighter than OR."""
        must, should, must_not = [], [], []
        chains: list[list] = []  # OR of ANDs
        joined = None
        while self.peek() not in ("end", "close"):
            k = self.peek()
            if k in ("and", "or"):
                self.i += 1
                if not chains and not must and not should or joined:
                    self.fail("an operator without a left side")
                joined = k
                continue
            sign = None
            if k == "not":
                sign, self.i = "-", self.i + 1
            elif k == "sign":
                sign, self.i = self.tokens[self.i]["sign"], self.i + 1
            n = self.clause(depth)
            if n is None:
                joined = None
                continue
            if chains and (joined == "and" or joined is None and self.conjunctive):
                chains[-1].append((sign, n))
            else:
                chains.append([(sign, n)])
            joined = None
        if joined:
            self.fail("an operator without a right side")
        for chain in chains:
            if len(chain) == 1:
                sign, n = chain[0]
                if sign == "-":
                    must_not.append(n)
                elif sign == "+":
                    must.append(n)
                else:
                    should.append(n)
            else:
                should.append(ast.boolean([n for s, n in chain if s != "-"], (), [n for s, n in chain if s == "-"]))
        if not (must or should or must_not):
            return ast.MatchNone()
        if len(must) + len(should) == 1 and not must_not:
            return (must or should)[0]
        return ast.boolean(must, should, must_not)

    def clause(self, depth: int) -> ast.Node | None:
        names = None
        if self.peek() == "field":
            names = [re.sub(r"\\(.)", r"\1", self.tokens[self.i]["field"][:-1])]
            self.i += 1
        k = self.peek()
        if k == "end":
            self.fail("nothing after a field or sign")
            return None
        m = self.tokens[self.i]
        self.i += 1
        if k == "open":
            if depth > 100:
                raise QueryError("syntax error: too deep")
            kept, self.fields = self.fields, names or self.fields
            out = self.group(depth + 1)
            self.fields = kept
            if self.peek() == "close":
                self.i += 1
            else:
                self.fail("a parenthesis is not closed")
        elif k in ("phrase", "range", "cmp", "word"):
            out = self.leaf(m, k, names)
        else:
            self.fail(f"unexpected {m[0]!r}")
            return None
        if out is not None and self.peek() == "boost":
            out.boost *= float(self.tokens[self.i]["boost"])
            self.i += 1
        return out

    def leaf(self, m, k: str, names) -> ast.Node | None:
        if k == "word" and m[0] == "*" and names is None:
            return ast.MatchAll()
        nodes = []
        for name in names or self.fields:
            name, _, b = name.partition("^")
            try:
                n = self.on_field(m, k, name)
            except QueryError:
                if self.strict:
                    raise
                continue
            if n is not None:
                n.boost *= float(b) if b else 1.0
                nodes.append(n)
        if not nodes:
            return None
        return nodes[0] if len(nodes) == 1 else ast.Bool(should=nodes, minimum=1)

    def on_field(self, m, k: str, name: str) -> ast.Node | None:
        t = self.c.target(name)
        if t is None:
            return ast.MatchNone()
        f, path = t
        if k == "phrase":
            text = re.sub(r"\\(.)", r"\1", m["phrase"])
            if f.type not in ("text", "json_object"):
                return self.c.term(f, path, text)
            return self.c.phrase(f, path, text, int(m["slop"] or 0))
        if k == "range":
            ops = {}
            if m["lo"] != "*":
                ops["gte" if m["range"][0] == "[" else "gt"] = self.value(f, m["lo"])
            if m["hi"] != "*":
                ops["lte" if m["range"][-1] == "]" else "lt"] = self.value(f, m["hi"])
            return self.c.q_range({name: ops}) if ops else ast.Exists(f.name, path)
        if k == "cmp":
            return self.c.q_range({name: {{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[m["cmp"]]: self.value(f, m["cv"])}})
        word = m["word"]
        if word == "*":
            return ast.Exists(f.name, path)
        if word.endswith("*") and not word.endswith("\\*") and len(word) > 1 and f.type in ("text", "json_object"):
            tokens = self.c.analysed(f, path, word[:-1])
            return ast.Pattern(f.name, path, "prefix", tokens[-1][1] if tokens else word[:-1])
        word = re.sub(r"\\(.)", r"\1", word)
        if f.type == "json_object":
            options = [self.c.text_query(f, path, word)] if path else [ast.Term(f.name, "*", t) for _, t in self.c.analysed(f, "", word)]
            if (v := self.value(f, word)) is not word and path:
                options.append(self.c.term(f, path, v))
            return ast.any_of(options)
        if f.type != "text":
            return self.c.term(f, path, word)
        tokens = self.c.analysed(f, path, word)
        if len(tokens) > 1 and f.positions:
            return self.c.phrase(f, path, word)
        return ast.any_of([ast.Term(f.name, path, t) for _, t in tokens]) if tokens else None

    @staticmethod
    def value(f, text: str):
        if f.type != "json_object":
            return text
        if text in ("true", "false"):
            return text == "true"
        try:
            return float(text) if re.search(r"[.eE]", text) else int(text)
        except ValueError:
            return text


def parse(text: str, compiler, fields: list[str], conjunctive: bool, strict: bool) -> ast.Node:
    p = _Parser(text, compiler, fields, conjunctive, strict)
    out = p.group()
    while p.peek() != "end":  # a stray ')'
        p.fail("an unmatched parenthesis")
        p.i += 1
        rest = p.group()
        out = ast.any_of([out, rest]) if not isinstance(rest, ast.MatchNone) else out
    return out
