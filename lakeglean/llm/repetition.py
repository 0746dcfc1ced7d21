"""Repetition inside a single document: line-first cleaning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglean.session import materialise, ship

#: Words of a run that counts as repeated.
RUN = 5
#: A document is rejected from this share of lost words on.
REJECT = 0.30
RULES = ("repetition", "punctuation", "navigation", "boilerplate")

_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile("\r\n|[\n\r\\x0b\\x0c\\x85\\u2028\\u2029]")
_LINE_SQL = r"\\r\\n|[\\n\\r\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}]"
_END = re.compile("[.!?:;\\u2026\\u3002\\uff01\\uff1f]['\")\\]}\\u00bb\\u2019\\u201d]*\\s*$")
_TRAIL = re.compile("\\s(?:[|/\\u00b7\\u00bb\\u2022\\u203a]|>+)\\s")
#: A line is boilerplate if it stands in at least so many documents, and in at least this share of them.
SHARED_DOCS, SHARED_SHARE = 20, 1e-4
#: Hashes of boilerplate lines that are broadcast (32 MB); of more lines, those of fewer documents are joined to their documents instead.
SHARED_LINES = 1 << 22
#: Lines of at least so many documents, and broadcast anyway, stay out of that join, where each would be one key.
HEAVY_DOCS = 1 << 16

SCHEMA = ("doc_id long, n_words long, n_repeated long, repeated_share double, n_lines int, n_punctuation int, n_navigation int, n_boilerplate int, "
          "n_lost long, lost_share double, rejected boolean, rejected_for array<string>")


def line_failures(line: str, n_words: int) -> tuple[bool, bool]:
    """(punctuation, navigation): the rules that one line fails by itself.

    Punctuation: four words or more without an end mark. Navigation: two or
    more trail separators and at most three words between two of them. Empty
    lines fail none.
    """
    if not n_words:
        return False, False
    trails = len(_TRAIL.findall(line))
    return n_words >= 4 and not _END.search(line), trails >= 2 and n_words <= 3 * (trails + 1)


def line_hash(line: str) -> int:
    """The hash that Spark's ``xxhash64`` gives the line without the blanks around it, as a signed number."""
    import xxhash

    h = xxhash.xxh64_intdigest(line.strip(" \t").encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


def _hashes(documents: DataFrame, *columns) -> DataFrame:
    """The given columns and ``h``, the hash of a line, once for each line that a document holds."""
    line = f"filter(array_distinct(transform(split(text, '{_LINE_SQL}'), x -> trim(BOTH ' \t' FROM x))), x -> x <> '')"
    return documents.filter("text is not null").select(*columns, F.expr(f"explode({line})").alias("line")).withColumn("h", F.xxhash64("line")).drop("line")


def shared_lines(documents: DataFrame, fewest: int = SHARED_DOCS):
    """The lines that many documents share, the corpus's own boilerplate: those in ``fewest`` documents and more and in SHARED_SHARE of them.

    Returns (hashes, counts, hot): the sorted hashes of those in ``hot``
    documents and more, at most SHARED_LINES, and if others remain a DataFrame
    (h, n) of all, else None.

    Each line counts once for a document that holds it. Lines are hashed where
    texts are read and counted before the shuffle, so a line that a third of all
    documents hold is one row a task.
    """
    import numpy as np

    counts = _hashes(documents).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.filter(F.col("n") >= fewest), "lines")
    least = hot = max(fewest, int(documents.count() * SHARED_SHARE))
    sizes = {int(r["b"]): r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}  # at most 64 rows
    while sum(c for b, c in sizes.items() if 2 ** (b + 1) > hot) > SHARED_LINES:
        hot = 1 << hot.bit_length()
    found = counts.filter(F.col("n") >= hot).select("h").toArrow().column(0).to_numpy(zero_copy_only=False)
    return np.sort(found.astype(np.int64)), counts.filter(F.col("n") >= least) if hot > least else None, hot


def with_lines(documents: DataFrame, counts: DataFrame, hot: int) -> DataFrame:
    """The documents with ``h``: the hashes of those of their lines that are in ``counts`` and in fewer than ``hot`` documents.

    Documents are joined by a hash of all they hold. Should two share it, they
    get the hashes of both, which are all of lines in ``counts`` anyway.
    """
    key = F.xxhash64("doc_id", "text").alias("key")
    heavy = counts.filter(F.col("n") >= max(hot, HEAVY_DOCS)).select("h")
    held = _hashes(documents, key).join(F.broadcast(heavy), "h", "left_anti").join(counts.filter(F.col("n") < hot).select("h"), "h")
    return documents.select("*", key).join(held.groupBy("key").agg(F.collect_set("h").alias("h")), "key", "left").drop("key")


def repeated(keys, docs, run: int = RUN):
    """Mask of the words that lie in a run which already occurred earlier in the same document.

    ``keys`` are 64-bit hashes of words in order, ``docs`` the document of each.
    Each window of ``run`` words gets a hash that includes its document; all
    windows but the first of a hash are repeated, and so are the words they cover.
    """
    import numpy as np

    n = len(keys) - run + 1
    if n <= 0:
        return np.zeros(len(keys), bool)
    with np.errstate(over="ignore"):
        h, m = docs[:n].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
        x = keys.astype(np.uint64)
        x = x ^ (x >> np.uint64(31))
        for k in range(run):
            h += x[k:k + n] * m
            m = m * np.uint64(0xD1342543DE82EF95)
            h ^= h >> np.uint64(27)
    whole = np.flatnonzero(docs[:n] == docs[run - 1:])
    _, first = np.unique(h[whole], return_index=True)
    again = np.ones(len(whole), bool)
    again[first] = False
    edge = np.zeros(len(keys) + 1, np.int64)
    np.add.at(edge, whole[again], 1)
    np.add.at(edge, whole[again] + run, -1)
    return np.cumsum(edge)[:-1] > 0


def _without(line: str, lost) -> str:
    """The line without its lost words and what stands between each and the next word."""
    low = line.casefold()
    place = range(len(line)) if len(low) == len(line) else [i for i, c in enumerate(line) for _ in c.casefold()]
    starts = [place[m.start()] for m in _WORD.finditer(low)] + [len(line)]
    return line[:starts[0]] + "".join(line[a:b] for a, b, gone in zip(starts, starts[1:], lost) if not gone)


def kept(text: str, sizes, failed, lost) -> str:
    """The text without its failed lines and its lost words; of each line the words and whether it failed, of each word whether it is lost."""
    out, at, w = [], 0, 0
    for m, n, fails in zip([*_LINE.finditer(text), None], sizes, failed):
        line, end = (text[at:m.start()], m[0]) if m else (text[at:], "")
        at, gone = m.end() if m else len(text), lost[w:w + n]
        w += n
        if not fails and not (n and gone.all()):
            out += [_without(line, gone) if gone.any() else line, end]
    return "".join(out)


class _Measure:
    """mapInArrow function over (doc_id, text) or (doc_id, text, hashes of further shared lines)."""

    def __init__(self, run: int, reject: float, rules: tuple[str, ...], keep: bool, shared):
        self.run, self.reject, self.rules, self.keep, self.shared = run, reject, rules, keep, shared

    def measure(self, texts, more):
        import numpy as np

        rules, hashes, lines, marks = self.rules, [], [], []
        plain = rules == ("repetition",)
        shared = [h for h in (self.shared.value if self.shared else (), np.unique(np.array(more, np.int64))) if len(h)]
        for d, (_, text) in enumerate(texts):
            for line in _LINE.split(text or ""):
                words = _WORD.findall(line.casefold())
                fails = (False, False) if plain else line_failures(line, len(words))
                lines.append((d, len(words), *(f and r in rules for f, r in zip(fails, RULES[1:])), 0))
                hashes += map(hash, words)
                if shared:
                    marks.append(line_hash(line) if words else 0)
        if not texts:
            return
        table = np.array(lines, np.int64)
        marks = np.array(marks, np.int64)
        for h in shared:
            at = np.minimum(np.searchsorted(h, marks), len(h) - 1)
            table[:, 4] |= (h[at] == marks) & (table[:, 1] > 0)
        doc_of, size = table[:, 0], table[:, 1]
        words_doc = np.repeat(doc_of, size)
        mask = repeated(np.array(hashes, np.int64), words_doc, self.run) if "repetition" in rules else np.zeros(len(hashes), bool)
        failed = table[:, 2:].any(axis=1)
        lost = mask | np.repeat(failed, size)
        count = lambda at, w=None: np.bincount(at, w, len(texts)).astype(np.int64)
        n, rep, gone, per_line = count(words_doc), count(words_doc, mask), count(words_doc, lost), count(doc_of)
        fails = [count(doc_of, table[:, k]) for k in (2, 3, 4)]
        by_rule = [rep, *(count(doc_of, table[:, k] * size) for k in (2, 3, 4))]
        first_line, first_word = np.r_[0, np.cumsum(per_line)], np.r_[0, np.cumsum(n)]
        for d, (doc, text) in enumerate(texts):
            total = int(n[d])
            left = ()
            if self.keep:
                a, b = first_line[d], first_line[d + 1]
                left = (text and kept(text, size[a:b].tolist(), failed[a:b].tolist(), lost[first_word[d]:first_word[d + 1]]),)
            share, away = (rep[d] / total, gone[d] / total) if total else (0.0, 0.0)
            yield (doc, total, int(rep[d]), float(share), int(per_line[d]) if text else 0, *(int(f[d]) for f in fails), int(gone[d]), float(away), bool(total and away >= self.reject),
                   [r for r, lost_by in zip(RULES, by_rule) if total and lost_by[d] / total >= self.reject], *left)

    def __call__(self, batches):
        import pyarrow as pa

        i64, f64, i32 = pa.int64(), pa.float64(), pa.int32()
        types = [i64, i64, i64, f64, i32, i32, i32, i32, i64, f64, pa.bool_(), pa.list_(pa.string())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if self.keep:
            types, names = [*types, pa.string()], [*names, "kept_text"]
        for b in batches:
            rows, texts, size, at = [], [], 0, 0
            more = lambda: b.column(2).slice(at, len(texts)).flatten() if b.num_columns > 2 else ()  # noqa: B023, E731
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.append((d, t))
                size += len(t or "")
                if size > 2_000_000:
                    rows += self.measure(texts, more())
                    texts, size, at = [], 0, at + len(texts)
            rows += self.measure(texts, more())
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def clean_lines(documents: DataFrame, run: int = RUN, reject: float = REJECT, rules: tuple[str, ...] = RULES, keep: bool = False, shared_docs: int = SHARED_DOCS) -> DataFrame:
    """One row for each document: what a cleaning line by line would remove, and whether too much of it.

    Each line is held against the ``rules``: a line failing punctuation,
    navigation or boilerplate (it stands in ``shared_docs`` documents and more
    and in SHARED_SHARE of them) is lost as a whole; under ``repetition`` those words
    of it are lost that lie in a run of ``run`` or more words which already
    occurred earlier in the document, word for word, across line ends and
    overlapping it or not. The document is rejected if at least ``reject`` of
    its words are lost. Case, punctuation and spacing don't matter.

    Columns: doc_id, n_words, n_repeated, repeated_share, n_lines, lines failed
    by rule, n_lost, lost_share, rejected, rejected_for (the rules that would
    reject it each on its own) and with ``keep`` kept_text: what is left without
    the lost lines and words, also of rejected documents. Null, empty and
    wordless texts have shares 0 and are not rejected. Repeated rows come out
    as often as they stand; extra columns are ignored. Each document is worked
    on where it is read, whole; only hashes of lines are shuffled, for the
    boilerplate rule. Texts are shuffled, once, only where more than
    SHARED_LINES lines are boilerplate.
    """
    if unknown := set(rules) - set(RULES):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    if run < 1 or not 0 < reject <= 1:
        raise ValueError("run must be at least 1 and reject in (0, 1]")
    if shared_docs < 2:
        raise ValueError("a line of one document is not shared")
    ship(documents.sparkSession)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = None
    if "boilerplate" in rules:
        hashes, counts, hot = shared_lines(own, shared_docs)
        shared = documents.sparkSession.sparkContext.broadcast(hashes)
        own = own if counts is None else with_lines(own, counts, hot)
    return own.mapInArrow(_Measure(run, reject, tuple(rules), keep, shared), SCHEMA + ", kept_text string" * keep)
