"""Analyzers: tokenizer and filter chains, once as Columns and once in Python.

Both forms give the same tokens, so a query's text is analysed on the driver
exactly as the documents were on the executors.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeglean.functions.stemmer import LANGUAGES

#: The stop words of English.
STOP_WORDS = {"english": ("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with").split()}

DEFAULT = {"tokenizer": "simple", "filters": [{"type": "remove_long", "max": 40}, "lowercase"]}
BUILT_IN = {
    "default": DEFAULT,
    "raw": {"tokenizer": "raw", "filters": []},
    "whitespace": {"tokenizer": "whitespace", "filters": []},
    "en_stem": {"tokenizer": "simple", "filters": [{"type": "remove_long", "max": 40}, "lowercase", {"type": "stemmer", "language": "english"}]},
}
_TOKENIZERS = {"simple": (), "whitespace": (), "raw": (), "ngram": ("min", "max", "prefix_only"), "regex": ("pattern",)}
_FILTERS = {"lowercase": (), "ascii_folding": (), "alpha_num_only": (), "remove_long": ("max",), "stop_words": ("language", "words"), "stemmer": ("language",)}


def _folding() -> tuple[str, str, dict[str, str]]:
    """One-to-one and one-to-many foldings of Latin letters to ASCII, by decomposition."""
    one_from, one_to, many = [], [], {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
    for c in (chr(i) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for i in r):
        base = unicodedata.normalize("NFKD", c)
        base = "".join(x for x in base if not unicodedata.combining(x))
        if c not in many and base != c and base.isascii():
            if len(base) == 1:
                one_from.append(c)
                one_to.append(base)
            elif base:
                many[c] = base
    for c, to in zip("øØłŁđĐıħŧ", "oOlLdDiht"):
        one_from.append(c)
        one_to.append(to)
    return "".join(one_from), "".join(one_to), many


FOLD_FROM, FOLD_TO, FOLD_MANY = _folding()
_FOLD_TABLE = str.maketrans(FOLD_FROM, FOLD_TO) | {ord(k): v for k, v in FOLD_MANY.items()}


class AnalyzerError(ValueError):
    pass


def _part(spec, kinds: dict, what: str) -> dict:
    spec = {"type": spec} if isinstance(spec, str) else dict(spec)
    kind = spec.get("type")
    if kind not in kinds:
        raise AnalyzerError(f"unknown {what} {kind!r}")
    if unknown := set(spec) - {"type", *kinds[kind]}:
        raise AnalyzerError(f"unknown field {sorted(unknown)[0]!r} of {what} {kind}")
    if "language" in spec and spec["language"] not in (LANGUAGES if kind == "stemmer" else STOP_WORDS):
        raise AnalyzerError(f"unknown language {spec['language']!r}")
    return spec


class _Terms(dict):
    """What the filters make of a word, or None; remembered, since every filter looks at one word."""

    LIMIT = 500_000

    def __init__(self, filters: list[dict]):
        super().__init__()
        self.filters = [(f["type"], f) for f in filters]
        self.stops = [frozenset(_stop_words(f)) if k == "stop_words" else None for k, f in self.filters]

    def __missing__(self, word: str) -> str | None:
        term = self._filtered(word)
        if len(self) >= self.LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = term
        return term

    def _filtered(self, w: str) -> str | None:
        for (k, f), stop in zip(self.filters, self.stops):
            if k == "lowercase":
                w = w.lower()
            elif k == "ascii_folding":
                w = w.translate(_FOLD_TABLE)
            elif k == "alpha_num_only":
                if not re.fullmatch(r"[^\W_]+", w):
                    return None
            elif k == "remove_long":
                if len(w.encode()) >= int(f.get("max", 40)):
                    return None
            elif k == "stop_words":
                if w in stop:
                    return None
            else:
                w = LANGUAGES[f["language"]](w)
        return w


class Analyzer:
    """A validated analyzer: ``{"tokenizer": ..., "filters": [...]}`` or a built-in name."""

    def __init__(self, spec):
        if isinstance(spec, str):
            if spec not in BUILT_IN:
                raise AnalyzerError(f"unknown tokenizer {spec!r}")
            spec = BUILT_IN[spec]
        if unknown := set(spec) - {"tokenizer", "filters"}:
            raise AnalyzerError(f"unknown field {sorted(unknown)[0]!r}")
        self.spec = spec
        self.tokenizer = _part(spec.get("tokenizer", "simple"), _TOKENIZERS, "tokenizer")
        self.filters = [_part(f, _FILTERS, "filter") for f in spec.get("filters", [])]
        if self.tokenizer["type"] == "regex":
            re.compile(self.tokenizer["pattern"])
        if self.tokenizer["type"] == "ngram" and not 0 < int(self.tokenizer.get("min", 1)) <= int(self.tokenizer.get("max", 2)):
            raise AnalyzerError("ngram needs 0 < min <= max")
        self.terms = _Terms(self.filters)
        self.stems = next((f["language"] for f in self.filters if f["type"] == "stemmer"), None)

    # -- Python form -------------------------------------------------------
    def tokens(self, text: str | None) -> list[tuple[int, str]]:
        """(position, term); a removed token leaves a gap in the positions."""
        if text is None:
            return []
        t, kind = self.tokenizer, self.tokenizer["type"]
        if kind == "raw":
            words = [text]
        elif kind == "whitespace":
            words = text.split()
        elif kind == "simple":
            words = re.findall(r"[^\W_]+", text)
        elif kind == "regex":
            words = [w for w in re.findall(t["pattern"], text) if w]
        else:
            lo, hi = int(t.get("min", 1)), int(t.get("max", 2))
            starts = range(1 if t.get("prefix_only") else len(text))
            words = [text[i:i + n] for i in starts for n in range(lo, hi + 1) if i + n <= len(text)]
        terms, flat = self.terms, kind == "ngram"
        return [(0 if flat else i, t) for i, w in enumerate(words) if (t := terms[w]) is not None]

    # -- Column form -------------------------------------------------------
    def column(self, text: Column) -> Column:
        """array<struct<pos int, term string>>, all in the JVM unless words are stemmed."""
        if self.stems:
            both = analyse_udf(self)(text)
            return F.when(text.isNotNull(), F.arrays_zip(both["pos"].alias("pos"), both["term"].alias("term")))
        t, kind = self.tokenizer, self.tokenizer["type"]
        if kind == "raw":
            words = F.array(text)
        elif kind == "whitespace":
            words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
        elif kind == "simple":
            words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        elif kind == "regex":
            words = F.filter(F.regexp_extract_all(text, F.lit(t["pattern"]), F.lit(0)), lambda w: w != "")
        else:
            lo, hi = int(t.get("min", 1)), int(t.get("max", 2))
            n = F.length(text)
            starts = F.array(F.lit(1)) if t.get("prefix_only") else F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
            grams = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.when(i + k - 1 <= n, text.substr(i, k)))))
            words = F.filter(grams, lambda w: w.isNotNull())
        flat = kind == "ngram"
        out = F.transform(words, lambda w, i: F.struct((F.lit(0) if flat else i).cast("int").alias("pos"), w.alias("term")))
        for f in self.filters:
            out = _filter_column(out, f)
        return F.when(text.isNotNull(), out)


def _stop_words(f: dict) -> list[str]:
    return list(f["words"]) if "words" in f else STOP_WORDS[f.get("language", "english")]


def _map(tokens: Column, fn) -> Column:
    return F.transform(tokens, lambda t: F.struct(t["pos"].alias("pos"), fn(t["term"]).alias("term")))


def fold_column(c: Column) -> Column:
    c = F.translate(c, FOLD_FROM, FOLD_TO)
    for a, b in FOLD_MANY.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _filter_column(tokens: Column, f: dict) -> Column:
    k = f["type"]
    if k == "lowercase":
        return _map(tokens, F.lower)
    if k == "ascii_folding":
        return _map(tokens, fold_column)
    if k == "alpha_num_only":
        return F.filter(tokens, lambda t: t["term"].rlike(r"^[\p{L}\p{N}]+$"))
    if k == "remove_long":
        return F.filter(tokens, lambda t: F.octet_length(t["term"]) < int(f.get("max", 40)))
    if k == "stop_words":
        return F.filter(tokens, lambda t: ~t["term"].isin(_stop_words(f)))
    raise AnalyzerError(f"unknown filter {k!r}")


def analyse_udf(analyzer: Analyzer):
    """Arrow-batched analysis in Python: text to its positions and terms, as two arrays."""

    @F.pandas_udf("pos array<int>, term array<string>")
    def analyse(texts: pd.Series) -> pd.DataFrame:
        found = [list(zip(*analyzer.tokens(t))) or [(), ()] for t in texts]
        return pd.DataFrame({"pos": [list(p) for p, _ in found], "term": [list(w) for _, w in found]})

    return analyse
