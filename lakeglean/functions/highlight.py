"""HTML snippets of the kept page of hits."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import functions as F


def spans(analyzer, text: str) -> list[tuple[int, int, str]]:
    """(start, end, term) of each token of the text."""
    t, out = analyzer.tokenizer["type"], []
    if t == "raw":
        found = [(0, len(text))]
    else:
        pattern = r"\S+" if t == "whitespace" else analyzer.tokenizer["pattern"] if t == "regex" else r"[^\W_]+"
        found = [m.span() for m in re.finditer(pattern, text)]
    for a, b in found:
        got = _one(analyzer, text[a:b])
        if got is not None:
            out.append((a, b, got))
    return out


def _one(analyzer, word: str) -> str | None:
    got = analyzer.tokens(word)
    return got[0][1] if len(got) == 1 else None


def best_fragment(tokens: list[tuple[int, int, bool, str]], length: int, limit: int) -> tuple[int, int] | None:
    """The window of at most ``limit`` characters with most distinct matched terms, then most matches, then first."""
    best, out = None, None
    for i, (a, _, hit, _) in enumerate(tokens):
        if not hit:
            continue
        terms, n, end = set(), 0, a
        for _, b, h, t in tokens[i:]:
            if b - a > limit:
                break
            if h:
                terms.add(t)
                n += 1
                end = b
        key = (len(terms), n, -a)
        if end > a and (best is None or key > best):
            best, out = key, (a, end)
    if out is None:
        return None
    a, b = out  # the rest of the room is shared before and after, at token edges
    room = limit - (b - a)
    starts = [s for s, *_ in tokens if a - room // 2 <= s <= a]
    a = min(starts, default=a) if a - room // 2 > 0 else 0 if a <= room // 2 else a
    ends = [e for _, e, *_ in tokens if b <= e <= a + limit]
    b = max(ends, default=b)
    return a, length if length <= a + limit else b


def snippet(text: str, analyzer, wanted: list, limit: int, distance) -> str | None:
    """``<b>`` around matched words, everything else escaped; None if nothing matched."""
    terms = {v for k, v in wanted if k == "term"}
    prefixes = tuple(v for k, v in wanted if k == "prefix")
    regexes = [re.compile(v) for k, v in wanted if k == "regex"]
    fuzzy = [v for k, v in wanted if k == "fuzzy"]
    tokens = [(a, b, t in terms or bool(prefixes) and t.startswith(prefixes) or any(r.search(t) for r in regexes) or any(distance(x, t, d) <= d for x, d in fuzzy), t)
              for a, b, t in spans(analyzer, text)]
    part = best_fragment(tokens, len(text), limit)
    if part is None:
        return None
    out, at = [], part[0]
    for a, b, hit, _ in tokens:
        if hit and part[0] <= a and b <= part[1]:
            out += [html.escape(text[at:a]), "<b>", html.escape(text[a:b]), "</b>"]
            at = b
    return "".join(out) + html.escape(text[at:part[1]])


def highlighter(analyzers: dict, wanted: dict[str, list], limit: int):
    """Arrow-batched UDF from a struct of texts to the JSON object of their snippets."""
    from lakeglean.operators.search import osa_distance

    @F.pandas_udf("string")
    def mark(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows.to_dict("records"):
            got = {}
            for name, text in row.items():
                texts = [text] if isinstance(text, str) else list(text) if text is not None and not isinstance(text, float) else []
                for t in texts:
                    s = snippet(t, analyzers[name], wanted[name], limit, osa_distance)
                    if s is not None:
                        got[name] = s
                        break
            out.append(json.dumps(got, ensure_ascii=False))
        return pd.Series(out)

    return mark
