"""Evaluation texts leaking into training text: template windows and slot consistency."""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglean.llm.words import WORD, canonical_words, visible
from lakeglean.session import ship

#: Most words of a template window.
WINDOW = 5
MIN_WORDS = 20
#: One word in so many may be changed, left out or added.
EDIT_EVERY = 8
#: Characters of passages that one pass over the corpus looks for; more items take more passes.
BLOCK_CHARS = 8_000_000

NUMBER, NAME, UNIT = "\x01number", "\x01name", "\x01unit"
#: Units that follow a number.
UNITS = frozenset("b kb mb gb tb kib mib gib tib ms s sec secs second seconds min mins minute minutes h hour hours day days mm cm m km kg g mg usd eur percent rows bytes".split())

SCHEMA = "doc_id long, item_id long, kind string, n_words int, n_edits int, n_slots int"


#: In a passage of more capitals than this share, capitals don't tell names.
MOST_CAPITALS = 0.25


def template(words: list[str], names=frozenset(), units=UNITS) -> list[str]:
    """Numbers, names and units replaced by typed placeholders.

    A word of digits is a number; one that mixes letters and digits (an
    identifier) or stands in ``names`` is a name; a unit counts as such only
    after a number.
    """
    out, before = [], ""
    for w in words:
        if w.isdigit():
            t = NUMBER
        elif w in names or (not w.isalpha() and any(c.isdigit() for c in w)):
            t = NAME
        elif before == NUMBER and w in units:
            t = UNIT
        else:
            t = w
        out.append(t)
        before = t
    return out


def window_word(w: str, names=frozenset(), units=UNITS) -> str:
    """The word as windows hold it: its template, but a unit whatever stands before it, so that one changed word changes one."""
    return UNIT if w in units and w not in names else template([w], names)[0]


_INNER = re.compile(r"(?<=[^\W_])[\s,;:()\"'\u00ab\u00bb\u201c-\u201e-]+([^\W_]+)")


def names_and_units(passages: list[str]) -> tuple[frozenset, frozenset]:
    """Names and units of the passages, found before case is folded.

    A name is capitalised inside a sentence and nowhere in lower case; passages
    in which every fourth word and more is capitalised (German, titles) name
    none. A unit follows at least two different numbers, and more often a number
    than anything else.
    """
    names, small, after, seen = set(), set(), defaultdict(set), Counter()
    number_before = Counter()
    for p in passages:
        shown = visible(p)
        inner = _INNER.findall(shown)
        small.update(w for w in inner if w.islower())
        capitals = [w for w in inner if w[:1].isupper() and w.isalpha() and len(w) > 1]
        if len(capitals) <= MOST_CAPITALS * len(inner):
            names.update(w.casefold() for w in capitals)
        words = canonical_words(p)
        seen.update(words)
        for a, b in zip(words, words[1:]):
            if a.isdigit() and b.isalpha():
                after[b].add(a)
                number_before[b] += 1
    units = {w for w, numbers in after.items() if len(numbers) > 1 and 2 * number_before[w] > seen[w]}
    return frozenset(names - small - units), frozenset(units)


def capitals(words: list[str], raw: list[str]) -> set[str]:
    """Words that a document writes with a capital, if most of its words have none."""
    up = [w for w, r in zip(words, raw) if r[0] != w[0]]
    return set(up) if 2 * len(up) < len(words) else set()


def unchanged_windows(width: int, least: int, every: int) -> int:
    """The fewest unchanged windows of a qualifying run. Any holds one of ``least`` to 2 * least - 1 words, where an edit breaks at most ``width`` windows."""
    return min(n - width + 1 - width * (n // every) for n in range(least, 2 * least))


def window_width(least: int, every: int) -> int:
    """The widest window, up to ``WINDOW`` words, of which a qualifying run always keeps one unchanged."""
    return next((w for w in range(WINDOW, 0, -1) if unchanged_windows(w, least, every) > 0), 1)


def passage(text: str | None) -> str:
    """The longest line of an item's text; the others are instructions and questions."""
    return max((text or "").splitlines() or [""], key=len)


def align(a: list[str], b: list[str], lo: int, hi: int, least: int, every: int, path: bool = False):
    """The longest stretch of ``a`` with ``least`` words and at most one edit in ``every`` that lies in ``b``: (words, edits, steps), or None.

    Exact among all alignments whose places in ``b`` less those in ``a`` stay
    within ``lo`` to ``hi``. Layer e holds for each end (place in a, diagonal)
    the earliest start in ``a`` from which at most e edits lead there: it comes
    by one edit from layer e - 1 and goes on along equal words. Steps, if
    ``path``: (index in a or -1, index in b or -1, cost) in order.
    """
    import numpy as np

    n, width = len(a), hi - lo + 1
    number: dict[str, int] = {}
    x = np.full(width + n - 1, -1)
    for t in range(max(0, -lo), min(len(x), len(b) - lo)):
        x[t] = number.setdefault(b[lo + t], len(number))
    own = np.array([number.get(w, -2) for w in a])
    differ = np.lib.stride_tricks.sliding_window_view(x, width) != own[:, None]
    rows = np.arange(n + 1)[:, None]
    shift = np.zeros((n + 1, width), np.int64)  # falls below all earlier values at each difference, which the minimum can't pass then
    np.cumsum(differ, axis=0, out=shift[1:])
    shift *= n + 1
    layers, best, last = [], None, n // every
    for e in range(last + 1):
        now = np.repeat(rows, width, axis=1)
        if e:
            before = layers[-1]
            np.minimum(now, before, out=now)
            np.minimum(now[1:], before[:-1], out=now[1:])  # changed
            np.minimum(now[1:, :-1], before[:-1, 1:], out=now[1:, :-1])  # left out
            np.minimum(now[:, 1:], before[:, :-1], out=now[:, 1:])  # added
        now = np.minimum.accumulate(now - shift, axis=0) + shift
        layers = [*layers, now] if path else [now]
        words = rows - now
        most = int(words.max())
        if most >= max(least, every * e) and (best is None or most > best[0]):
            best = most, e, divmod(int(words.argmax()), width)
        # more edits: none if the whole is found, or no run of 20 to 39 words is; a run of f edits is c + 1 runs of at most e and c edits
        if most == n or best is None and e >= (2 * least - 1) // every:
            break
        if not any(max(every * f, best[0] + 1 if best else least) <= (f // (e + 1) + 1) * (most + 1) - 1 for f in range(e + 1, last + 1)):
            break
    if best is None:
        return None
    words, e, (i, k) = best
    steps, cost = [], e
    while path and i > layers[e][i, k]:
        s, j = layers[e][i, k], lo + k + i - 1
        j = j if 0 <= j < len(b) else -1
        if not differ[i - 1, k] and layers[e][i - 1, k] == s:
            i, step = i - 1, (i - 1, j, 0)
        elif layers[e - 1][i, k] == s:
            e, step = e - 1, None
        elif layers[e - 1][i - 1, k] == s:
            e, i, step = e - 1, i - 1, (i - 1, j, 1)
        elif k + 1 < width and layers[e - 1][i - 1, k + 1] == s:
            e, i, k, step = e - 1, i - 1, k + 1, (i - 1, -1, 1)
        else:
            e, k, step = e - 1, k - 1, (-1, j, 1)
        steps += [step] if step else []
    return words, cost, steps[::-1]


def best_run(steps: list[tuple[int, int, int]], least: int, every: int) -> tuple[int, int, int, int] | None:
    """The longest stretch (first step, end step, words, edits) with ``least`` words and at most one edit in ``every``.

    Words count on the passage's side. Prefix sums of words - every * edits:
    a stretch qualifies if the sum does not fall, so the earliest start with a
    sum not above the end's gives the longest stretch for that end.
    """
    score, words, edits = [0], [0], [0]
    for i, _, cost in steps:
        words.append(words[-1] + (i >= 0))
        edits.append(edits[-1] + cost)
        score.append(words[-1] - every * edits[-1])
    starts, best = [], None  # starts with falling scores
    for k, s in enumerate(score):
        if not starts or s < score[starts[-1]]:
            starts.append(k)
    for end in range(len(score) - 1, 0, -1):
        if best and words[end] <= best[2]:
            break
        lo, hi = 0, len(starts)
        while lo < hi:
            mid = (lo + hi) // 2
            if score[starts[mid]] <= score[end]:
                hi = mid
            else:
                lo = mid + 1
        if lo < len(starts) and starts[lo] < end:
            a = starts[lo]
            n = words[end] - words[a]
            if n >= least and (best is None or n > best[2]):
                best = (a, end, n, edits[end] - edits[a])
    return best


def consistent(steps, item: list[str], item_t: list[str], doc: list[str]) -> tuple[bool, int]:
    """Whether each slot value of the passage became one value, and each value came from one; and the number of slots changed."""
    there, back, changed = {}, {}, 0
    for i, j, cost in steps:
        if not cost and i >= 0 and item_t[i][0] == "\x01":
            a, b = (item_t[i], item[i]), (item_t[i], doc[j])
            if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                return False, changed
            changed += a != b
    return True, changed


def compare(item: list[str], item_t: list[str], doc: list[str], doc_t: list[str], lo: int, hi: int, least: int, every: int) -> tuple[str, int, int, int] | None:
    """How a stretch of a document reproduces a passage: (kind, words, edits, slots changed), or None.

    If the words themselves qualify, the kind is ``verbatim`` or ``edited``;
    if only the templates do and their slots are consistent,
    ``reparameterised``. Alignments stay within the diagonals lo to hi.
    """
    if run := align(item, doc, lo, hi, least, every):
        return ("verbatim" if not run[1] or align(item, doc, lo, hi, least, len(item) + 1) else "edited"), run[0], run[1], 0
    if run := align(item_t, doc_t, lo, hi, least, every, path=True):
        ok, changed = consistent(run[2], item, item_t, doc)
        if ok and changed:
            return "reparameterised", run[0], run[1], changed
    return None


class Index:
    """Hash table of the template windows of one block of items."""

    def __init__(self, items: list[tuple[int, str]], width: int, names: frozenset, least: int, every: int):
        import numpy as np

        found, units = names_and_units([passage(t) for _, t in items])
        names, self.units = names | found, UNITS | units
        self.width, self.names, self.least, self.every = width, names, least, every
        self.fewest = unchanged_windows(width, least, every)
        self.items = [(i, w, template(w, names, self.units)) for i, w in ((i, canonical_words(passage(t))) for i, t in items) if len(w) >= least]
        keys = [[window_word(w, names, self.units) for w in ws] for _, ws, _ in self.items]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for ts in keys for t in ts}), 1)}
        self.name = self.vocabulary.get(NAME, 0)
        hashes, owners, places = [], [], []
        for n, ts in enumerate(keys):
            h = self._hash(np.array([self.vocabulary[t] for t in ts], np.uint64))
            hashes.append(h)
            owners.append(np.full(len(h), n))
            places.append(np.arange(len(h)))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        hashes, owners, places = cat(hashes, np.uint64), cat(owners, np.int64), cat(places, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.places = hashes[order], owners[order], places[order]
        self.cache: dict[str, int] = {}

    def _hash(self, ids):
        """64-bit hash of each window of ids; the multipliers are powers of an odd constant."""
        import numpy as np

        n, h, m = len(ids) - self.width + 1, None, np.uint64(1)
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            x = ids * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            for k in range(self.width):
                part = x[k:k + n] * m
                h = part if h is None else h + part
                m = m * np.uint64(0xD1342543DE82EF95)
        return h

    def ids(self, words: list[str]) -> list[int]:
        """Window ids of words; 0 for one that no passage has."""
        cache, out = self.cache, []
        if len(cache) > 1_000_000:
            cache.clear()
        for w in words:
            k = cache.get(w)
            if k is None:
                k = cache[w] = self.vocabulary.get(window_word(w, self.names, self.units), 0)
            out.append(k)
        return out

    def search(self, texts: list[tuple[int, str]]):
        """Yields (doc, item, kind, words, edits, slots) for a batch of texts."""
        import numpy as np

        if not len(self.hashes):
            return
        words, caps, flat, starts = [], [], [], [0]
        for _, text in texts:
            shown = visible(text)
            w = WORD.findall(shown.casefold())
            own, up = self.ids(w), set()
            if self.name and not all(own):  # a capitalised word that no passage has may stand for a name
                raw = WORD.findall(shown)
                up = {x for x in capitals(w, raw) if x not in self.vocabulary} if len(raw) == len(w) else up
                own = [k or (self.name if x in up else 0) for k, x in zip(own, w)] if up else own
            words.append(w)
            caps.append(up)
            flat += own
            flat.append(0)  # no window spans two documents
            starts.append(len(flat))
        if len(flat) < self.width:
            return
        ids = np.array(flat, np.uint64)
        h = self._hash(ids)
        zero = np.cumsum(np.r_[0, ids == 0])
        whole = zero[self.width:] == zero[:-self.width]
        at = np.flatnonzero(whole)
        lo = np.searchsorted(self.hashes, h[at], "left")
        hi = np.searchsorted(self.hashes, h[at], "right")
        hit = hi > lo
        at, lo, hi = at[hit], lo[hit], hi[hit]
        if not len(at):
            return
        docs = np.searchsorted(starts, at, "right") - 1
        n = hi - lo
        first = np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(lo, n) + np.arange(n.sum()) - first
        doc, item = np.repeat(docs, n), self.owners[entry]
        diagonal = np.repeat(at - np.array(starts)[docs], n) - self.places[entry]
        order = np.lexsort((diagonal, item, doc))
        doc, diagonal, item = doc[order], diagonal[order], item[order]
        edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), True])
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a < self.fewest:
                continue
            d, i = int(doc[a]), int(item[a])
            found = self._verify(words[d], diagonal[a:b], i, caps[d])
            if found:
                yield (texts[d][0], self.items[i][0], *found)

    def _verify(self, words: list[str], diagonal, i: int, caps: set[str]):
        """The longest leak around the hits, real words before re-parameterised ones.

        ``diagonal``: place in the document less place in the passage of each
        hit, rising. One edit moves an alignment by one diagonal at most, so
        it stays within its number of edits of any of its hits.
        """
        import numpy as np

        _, item, item_t = self.items[i]
        near, far, k = (2 * self.least - 1) // self.every, len(item) // self.every, self.fewest - 1
        close = np.flatnonzero(diagonal[k:] - diagonal[:len(diagonal) - k] <= near)
        spans: list[list[int]] = []
        for d in np.unique(diagonal[np.unique(close[:, None] + np.arange(k + 1))]).tolist():  # bands of diagonals, none much wider than the passage is long
            if spans and d - spans[-1][1] <= 2 * far + 1 and d - spans[-1][0] <= 2 * len(item):
                spans[-1][1] = d
            else:
                spans.append([d, d])
        leaks = []
        for a, b in spans:
            lo, hi = a - far, b + far
            at = max(0, lo - 1)  # a unit shows by the word before
            part = words[at:hi + len(item)]
            leaks.append(compare(item, item_t, part, template(part, self.names | caps, self.units), lo - at, hi - at, self.least, self.every))
        return max(filter(None, leaks), key=lambda x: (x[0] != "reparameterised", x[1], -x[2], x[0]), default=None)


_INDEXES: dict[str, Index] = {}


class _Search:
    """mapInArrow function over (doc_id, text)."""

    def __init__(self, broadcast, key: str):
        self.broadcast, self.key = broadcast, key

    def __call__(self, batches):
        import pyarrow as pa

        if self.key not in _INDEXES:  # one block at a time, kept for this worker's next task
            _INDEXES.clear()
            _INDEXES[self.key] = Index(*self.broadcast.value)
        index = _INDEXES[self.key]
        names = ["doc_id", "item_id", "kind", "n_words", "n_edits", "n_slots"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for b in batches:
            rows, texts, size = [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    texts.append((d, t))
                    size += len(t)
                if size > 2_000_000:
                    rows += index.search(texts)
                    texts, size = [], 0
            if texts:
                rows += index.search(texts)
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def blocks(items: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_CHARS):
    """Items in blocks of at most ``limit`` characters (one item may exceed it), streamed to the driver."""
    block, size = [], 0
    own = items.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).filter(f"`{text_col}` is not null").distinct()
    for i, t in own.toLocalIterator():
        p = passage(t)
        if block and size + len(p) > limit:
            yield block
            block, size = [], 0
        block.append((i, p))
        size += len(p)
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, width: int | None = None, least: int = MIN_WORDS, every: int = EDIT_EVERY,
          names: frozenset = frozenset(), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, kind, n_words, n_edits, n_slots) of each document that holds an item's passage.

    Both sides become words whatever their case, markup, escapes and invisible
    characters, then templates: numbers, names (identifiers, what passages
    capitalise, and ``names``) and units are typed placeholders. Windows of ``width`` template words are joined by hash: the
    items' windows are the build side, a block of at most ``block_chars``
    characters at a time, and each document's windows probe it where they are
    read, so the corpus is never shuffled, in one pass for each block. Pairs
    with enough windows are aligned: ``verbatim`` and ``edited`` reproduce at
    least ``least`` words in a row with at most one in ``every`` changed, left
    out or added; ``reparameterised`` does so as a template whose slots were
    changed consistently.

    Null and empty texts hold nothing and passages below ``least`` words are
    not searched. A document is listed once for each item; repeated rows of
    documents come out once. Extra columns are ignored. Null ids stay null.

    Without ``width`` the windows are as wide as ``least`` and ``every``
    allow; a width of which a qualifying run may keep no window is refused.
    """
    if least < 1 or every < 1:
        raise ValueError("least and every must be at least 1")
    width = window_width(least, every) if width is None else width
    if width < 1 or unchanged_windows(width, least, every) < 1:
        raise ValueError(f"a run of {least} words with one in {every} changed may keep no unchanged window of {width} words")
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for n, block in enumerate(blocks(items, "item_id", "text", block_chars)):
        sent = spark.sparkContext.broadcast((block, width, names, least, every))
        found = docs.mapInArrow(_Search(sent, uuid.uuid4().hex), SCHEMA)
        out = found if not n else out.unionByName(found)
    rank = F.when(F.col("kind") == "reparameterised", 0).otherwise(F.col("n_words"))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct(rank.alias("r"), "n_words", (-F.col("n_edits")).alias("e"), "kind", "n_slots")).alias("b"))
    return best.select("doc_id", "item_id", "b.kind", "b.n_words", (-F.col("b.e")).alias("n_edits"), "b.n_slots")
