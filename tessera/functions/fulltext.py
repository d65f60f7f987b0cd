"""BM25 top k of many texts over many documents, in blocks with numpy and Arrow inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .ranking import top_k

# Documents, texts and terms in a block; one block of each side is all a task looks at at once.
BLOCK_DOCS, BLOCK_TEXTS, BLOCK_TERMS = 2048, 512, 4096
K1, B = 1.2, 0.75


def _packed(documents: DataFrame) -> DataFrame:
    """``ids, docs, lens``: documents in blocks, packed where they lie."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([c])) for c in part.columns], ["ids", "docs", "lens"])

    return documents.select("node_id", "doc", "doc_len").mapInArrow(pack, "ids array<string>, docs array<string>, lens array<int>")


def _blocks(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """``rows`` in blocks of about ``size``, as an array of structs in column ``block``."""
    n = max(1, -(-rows.count() // size))
    return materialise(rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("_no")).agg(
        F.collect_list(F.struct(*rows.columns)).alias("block")).select("block"), name)


def _occurrences(docs: pa.Array, terms: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each term, the documents that hold it and how often. A term with a blank in it is a phrase: its words stand side by side."""
    place = {t: i for i, t in enumerate(terms)}
    parts = pc.split_pattern(docs, " ")
    words = pc.list_flatten(parts).dictionary_encode()
    codes = np.array([place.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy(zero_copy_only=False)]
    row = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)[codes >= 0]
    pairs, tf = np.unique((codes[codes >= 0] * len(docs)) + row, return_counts=True)
    ends = np.searchsorted(pairs, np.arange(len(terms) + 1) * len(docs))
    for i, term in enumerate(terms):
        if " " not in term:
            yield pairs[ends[i]:ends[i + 1]] - i * len(docs), tf[ends[i]:ends[i + 1]]
            continue
        rows = np.flatnonzero(pc.match_substring(docs, f" {term} ").to_numpy(zero_copy_only=False))
        # With the blanks doubled, phrases that follow each other do not share one.
        wide = f" {term.replace(' ', '  ')} "
        yield rows, np.array([d.replace(" ", "  ").count(wide) for d in docs.take(pa.array(rows)).to_pylist()], np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per row of documents times a block: ids, docs, lens and the block's structs."""
    ids, docs, lens, block = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "docs", "lens", "block"))
    for i in range(len(batch)):
        yield ids[i].values, docs[i].values, lens[i].values.to_numpy(zero_copy_only=False), block[i].as_py()


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, docs, _, block in _rows(batch):
            terms = [t["term"] for t in block]
            n = [len(rows) for rows, _ in _occurrences(docs, terms)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(n, pa.int64())], ["term", "n"])


def _scoring(k: int, mean_len: float) -> Callable:
    """(text, node_id, score): of each block of documents, the ``k`` best of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, docs, lens, block in _rows(batch):
                norm = K1 * (1 - B + B * lens / mean_len)
                terms = sorted({t["term"] for text in block for t in text["asked"]})
                gains = {t: (rows, tf * (K1 + 1) / (tf + norm[rows])) for t, (rows, tf) in zip(terms, _occurrences(docs, terms))}
                by_id = np.empty(len(docs), np.int64)
                by_id[np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable")] = np.arange(len(docs))
                texts, places, scores = [], [], []
                for text in block:
                    score = np.zeros(len(docs))
                    for t in text["asked"]:
                        rows, gain = gains[t["term"]]
                        score[rows] += t["idf"] * gain
                    found = np.flatnonzero(score > 0)
                    rounded = -np.round(score[found], 9)
                    if len(found) > k:
                        near = rounded <= np.partition(rounded, k - 1)[k - 1]
                        found, rounded = found[near], rounded[near]
                        found = found[np.lexsort((by_id[found], rounded))[:k]]
                    texts += [text["text"]] * len(found)
                    places.append(found)
                    scores.append(score[found])
                at = np.concatenate([np.empty(0, np.int64), *places])
                yield pa.RecordBatch.from_arrays([
                    pa.array(texts, pa.string()), ids.take(pa.array(at)), pa.array(np.concatenate([np.empty(0), *scores]))], ["text", "node_id", "score"])

    return run


def bm25_topk(terms: DataFrame, documents: DataFrame, n_docs: int, mean_len: float, k: int) -> DataFrame:
    """(text, node_id, score, rank): the ``k`` best documents of each text; ``terms`` has its distinct (text, term), ``documents`` node_id, doc, doc_len.

    Both sides meet block by block, first to count the documents of every term, then to score. Only counts and every block's ``k`` best
    of a text leave a task, so nothing is written or shuffled per document, however common a text's words are.
    """
    vocabulary = _blocks(terms.select("term").distinct(), "term", BLOCK_TERMS, "term_blocks")
    # One side is a few blocks: a plain product, which Spark broadcasts only below its own threshold.
    counts = _packed(documents).crossJoin(vocabulary).mapInArrow(_counting, "term string, n bigint").where("n > 0").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = materialise(terms.join(counts, "term").select("text", "term", idf.alias("idf")), "term_weights")
    asked = _blocks(weighted.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("asked")), "text", BLOCK_TEXTS, "text_blocks")
    found = _packed(documents).crossJoin(asked).mapInArrow(_scoring(k, mean_len or 1.0), "text string, node_id string, score double")
    return top_k(found.withColumn("score", F.round("score", 9)), ["text"], [F.desc("score"), F.col("node_id")], k)
