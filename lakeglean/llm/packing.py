"""Filling fixed-capacity containers with items: minimum bin slack."""

from __future__ import annotations

import base64
import hashlib
import os
from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglean.session import ship

CAPACITY = 2048
#: Items held back to choose from. More make fuller containers at more cost each.
WINDOW = 512

SCHEMA = "{id} long, piece int, n_pieces int, first_token int, n_tokens int, first_byte long, n_bytes long, container string"


def default_tokenizer() -> str:
    """Path of the public byte-level BPE vocabulary that is installed here."""
    if "LAKEGLEAN_TOKENIZER" in os.environ:
        return os.environ["LAKEGLEAN_TOKENIZER"]
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


#: The vocabulary is broadcast to the workers and must not be larger than this.
VOCABULARY_BYTES = 64 << 20
_LOADED: dict = {}


def read_tokenizer(path: str) -> tuple[str, bytes, str]:
    """(name, ranks file, pattern), read where the query is planned; the workers' machines need no such file."""
    import public_tokenizers

    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of more than {VOCABULARY_BYTES} bytes is too large to send")
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(data).hexdigest(), data, public_tokenizers.PATTERN


def load(name: str, data: bytes, pattern: str):
    """(encoding, bytes of each token) of a ranks file, once for each worker process."""
    if name not in _LOADED:
        import numpy as np
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _LOADED[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _LOADED[name]


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The sub-multiset of ``counts`` (length to number) whose sum is closest to ``room`` from below.

    Bitset subset-sum: bit s of ``reach`` says that the sum s can be made.
    Each length joins in doublings of its count, largest length first; the
    bitsets before each step are kept, and walking back through them yields how
    many of each length were taken. Stops as soon as ``room`` itself is made.
    """
    limit, full = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length) if 0 < length <= room else 0
        take = 1
        while left > 0 and not reach & full:
            n = min(take, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & limit
            left -= n
            take *= 2
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not total:
            break
        if not before >> total & 1:
            total -= length * n
            taken[length] = taken.get(length, 0) + n
    return taken


class Packer:
    """Packs a stream of (length, item); holds at most ``window`` items back."""

    def __init__(self, capacity: int, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.pool: dict[int, deque] = defaultdict(deque)
        self.held = self.bins = 0

    def add(self, length: int, item):
        """Yields the containers, as lists of items, that this item completes."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"an item of {length} does not fit into {self.capacity}")
        if length == self.capacity:
            yield [item]
            return
        self.pool[length].append(item)
        self.held += 1
        if self.held >= self.window:
            while self.held > self.window // 2:
                yield self._one()

    def flush(self):
        while self.held:
            yield self._one()

    def _one(self) -> list:
        anchor = max(self.pool)  # the largest remaining item opens the container
        items = [self._pop(anchor)]
        for length, n in closest({k: len(v) for k, v in self.pool.items()}, self.capacity - anchor).items():
            items += [self._pop(length) for _ in range(n)]
        return items

    def _pop(self, length: int):
        own = self.pool[length]
        item = own.popleft()
        if not own:
            del self.pool[length]
        self.held -= 1
        return item


class _Pack:
    """mapInArrow function: tokenises, cuts over-long texts, packs."""

    def __init__(self, capacity: int, window: int, tokenizer, id_col: str):
        self.capacity, self.window, self.tokenizer, self.id_col = capacity, window, tokenizer, id_col

    def pieces(self, ids, texts):
        encoding, sizes = load(*self.tokenizer.value)
        for doc, text in zip(ids, texts):
            if not text:
                yield doc, 0, 1, 0, 0, 0, 0
                continue
            tokens = encoding.encode_ordinary(text)
            n, n_bytes = len(tokens), len(text.encode())
            if n <= self.capacity:
                yield doc, 0, 1, 0, n, 0, n_bytes
                continue
            ends = sizes[tokens].cumsum()
            cuts = range(0, n, self.capacity)
            for k, a in enumerate(cuts):
                b = min(n, a + self.capacity)
                start = int(ends[a - 1]) if a else 0
                yield doc, k, len(cuts), a, b - a, start, int(ends[b - 1]) - start

    def __call__(self, batches):
        import pyarrow as pa

        packer, part, bins, rows = Packer(self.capacity, self.window), 0, 0, []
        names = [self.id_col, "piece", "n_pieces", "first_token", "n_tokens", "first_byte", "n_bytes", "container"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

        def batch(done):
            cols = list(zip(*done)) if done else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def close(containers):
            nonlocal bins
            for items in containers:
                rows.extend((*item, f"{part}-{bins}") for item in items)
                bins += 1

        for b in batches:
            if b.num_rows:
                part = b.column("part")[0].as_py()
            for p in self.pieces(b.column(self.id_col).to_pylist(), b.column("text").to_pylist()):
                if p[4]:
                    close(packer.add(p[4], p))
                else:
                    rows.append((*p, None))
            if rows:
                yield batch(rows)
                rows = []
        close(packer.flush())
        yield batch(rows)


def pack(documents: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, tokenizer: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lay each text into a container of ``capacity`` tokens.

    One row for each piece: id, piece (from 0), n_pieces, first_token, n_tokens,
    first_byte, n_bytes (of the text's UTF-8), container. A text is cut only
    if it has more than ``capacity`` tokens, into full pieces and a rest;
    together the pieces are the whole text, byte for byte.

    Each partition packs its own rows as they stream by, holding ``window`` of
    them, so nothing is shuffled and memory is bounded however many rows there
    are. A container is opened by the largest item held and filled by the
    bitset subset-sum of :func:`closest`.

    ``tokenizer`` is the path of a ranks file on the machine that plans the
    query; its content, of bounded size, is broadcast.

    A null or empty text has one piece of 0 tokens and no container (null).
    Rows that repeat are packed as often as they come; a null id stays null.
    Other columns of the input are ignored, whatever their names.
    """
    if capacity < 1 or window < 1:
        raise ValueError("capacity and window must be at least 1")
    ship(documents.sparkSession)
    own = documents.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    sent = documents.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer or default_tokenizer()))
    return own.mapInArrow(_Pack(capacity, window, sent, id_col), SCHEMA.format(id=f"`{id_col}`"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, n_items, used, slack) of each container."""
    return (packed.filter("container is not null").groupBy("container")
            .agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used")).withColumn("slack", F.lit(capacity) - F.col("used")))
