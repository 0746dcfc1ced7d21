"""python -m lakeglean.llm.recall DIR [EVERY]: the leaks found in DIR against an exhaustive search without windows.

Each document with an id divisible by EVERY (1) is held against each passage: a
pair is aligned over all diagonals unless no 20 words of the passage in a row
share enough words with the document, which no leak survives.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lakeglean.llm import leakage
from lakeglean.llm.words import canonical_words


def exhaustive(documents, items, least: int = leakage.MIN_WORDS, every: int = leakage.EDIT_EVERY):
    """Yields (doc, item) of each leak; ``documents`` and ``items`` are pairs of id and text."""
    passages = [(i, w) for i, w in ((i, canonical_words(leakage.passage(t))) for i, t in items) if len(w) >= least]
    need = least - (2 * least - 1) // every  # words that a run of 20 to 39 keeps at least, in any 20 of its words in a row
    for d, text in documents:
        doc = canonical_words(text or "")
        own = set(doc)
        for i, words in passages:
            there = [w in own for w in words]
            if max(sum(there[k:k + least]) for k in range(len(words) - least + 1)) >= need and leakage.align(words, doc, -len(words), len(doc), least, every):
                yield d, i


class _Exhaustive:
    def __init__(self, items):
        self.items = items

    def __call__(self, batches):
        import pyarrow as pa

        for b in batches:
            pairs = list(exhaustive(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), self.items.value))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["doc_id", "item_id"])


def main(folder: str, every: int = 1) -> float:
    spark = SparkSession.builder.master("local[*]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter(f"doc_id % {every} = 0").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/eval_items.parquet")
    sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in items.distinct().collect()])
    want = {tuple(r) for r in docs.repartition(64).mapInArrow(_Exhaustive(sent), "doc_id long, item_id long").collect()}
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).filter("kind <> 'reparameterised'").collect()}
    recall = len(want & got) / len(want) if want else 1.0
    print(f"exhaustive {len(want)}, found {len(got)}, missing {len(want - got)}, extra {len(got - want)}, recall {recall:.4f}")
    return recall


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
