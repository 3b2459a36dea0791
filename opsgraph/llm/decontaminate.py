"""Benchmark decontamination: a BM25 index of the test items, asked by every training passage with block-max WAND.

The index is of the test items (small, and in blocks of a checked size), so each block travels to the executors and
the training texts stay where they are: no shuffle.  Counts and lengths that scores depend on are of all blocks.  A text is cut into overlapping passages of whole words, once for
each length class of items, so that a copy as long as its item lies in one passage; a passage is a query of its
distinct words, for the items of its class.  Scores are BM25 as a share of what the item scores against itself, so that one
threshold fits short and long items.  What scores at least the threshold is retrieved, all of it, and then checked: the
item's question and answer must both overlap with the text around the passage.  An item is reported with the best of
its passages that pass, whatever passages score more and don't.

Two steps keep it cheap and lose nothing.  The words that most items have are worth little; from an item's whole share
of such words follows how much its other words must score, so passages without that much are left out in numpy before
any search.  The others go through block-max WAND: cursors in item order, a pivot where the terms' best scores could
reach the threshold, and a jump past the block where the blocks' best scores can't.

Null and empty texts, and items without words, match nothing; an item with a null id is one like the others.  Texts of
any length are searched whole, repeated rows each on their own; of an item's passages with equal scores the first that
passes is reported.  A kept column with the name of one that is made here is an error.
"""

from __future__ import annotations

import pickle
import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column_map, discard, materialise, text_of

K1, B = 1.2, 0.75
#: Words from one passage's start to the next one's in the class of the shortest items; each further class has twice as
#: many.  A class holds items of at most a stride's words, and its passages have two strides, so one holds all of a copy.
STRIDE = 48
#: Share of an item's own score that retrieves it, words of a gram, and share of grams of question and of answer.
THRESHOLD, GRAM, OVERLAP = 0.5, 3, 0.5
POSTING_BLOCK = 16
#: Test items' text bytes that one index holds; more items make more passes.
INDEX_BYTES = 8 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """ASCII letters lower-cased, ASCII punctuation and controls as spaces."""
    return (text or "").encode().translate(_FOLD).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer; an item of one sentence has the last third of its words as the answer."""
    sentences = [w for s in re.split(r"(?<=[.?!\n])\s+", text) if (w := words(s))]
    if len(sentences) > 1 and len(sentences[-1]) >= GRAM:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    all_words = [w for s in sentences for w in s]
    cut = len(all_words) - max(1, len(all_words) // 3)
    return all_words[:cut], all_words[cut:]


def stride_of(length: int) -> int:
    """The stride of the class of items of so many words."""
    stride = STRIDE
    while stride < length:
        stride *= 2
    return stride


def shared(part: list[bytes], around: list[bytes]) -> float:
    """Share of a part's distinct grams that stand around a passage; of a part with fewer words than a gram has, the
    whole sequence is one.  A part without words is found."""
    n = min(GRAM, len(part))
    return len(grams(part, n) & grams(around, n)) / len(grams(part, n)) if n else 1.0


def grams(listed: list[bytes], n: int = GRAM) -> set[tuple[bytes, ...]]:
    """Distinct n-grams; of fewer words, the whole sequence."""
    return {tuple(listed[i : i + n]) for i in range(max(1, len(listed) - n + 1))} if listed else set()


class Statistics:
    """Of items with words: how many have a word, how many there are, and their words in all."""

    def __init__(self, items: list[tuple[int | None, str]] = ()):
        self.df, self.items, self.words = Counter(), 0, 0
        self.add(items)

    def add(self, items: list[tuple[int | None, str]]) -> None:
        for _, t in items:
            if listed := words(t):
                self.df.update(set(listed))
                self.items += 1
                self.words += len(listed)


class BenchmarkIndex:
    """Postings with block maxima of items given as (id, text); of a part of the items, with the statistics of all."""

    def __init__(self, items: list[tuple[int | None, str]], statistics: Statistics | None = None):
        items = sorted(((i, t) for i, t in items if words(t)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        statistics = statistics or Statistics(items)
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        listed = [Counter(words(t)) for _, t in items]
        df, n, mean = statistics.df, statistics.items, statistics.words / max(1, statistics.items)
        self.terms = {w: k for k, w in enumerate(sorted({w for c in listed for w in c}))}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        #: Of each item the stride of its class; the words to sum up are listed by class.
        self.strides = [stride_of(sum(c.values())) for c in listed]
        rare_postings: dict[int, list[tuple[int, int, float]]] = {stride: [] for stride in sorted(set(self.strides))}
        self.needed = np.zeros(len(items))
        common = {w for w in self.terms if df[w] > max(2, 0.05 * n)}
        for k, c in enumerate(listed):
            size = sum(c.values())
            raw = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for w, f in c.items()}
            own = sum(raw.values())
            share = {w: v / own for w, v in raw.items()}
            rest = sum(v for w, v in share.items() if w in common)
            loose = common if rest < THRESHOLD - 0.1 else set()  # an item of common words only: all its words count
            self.needed[k] = THRESHOLD - (rest if loose else 0) - 1e-9
            for w, v in share.items():
                postings[self.terms[w]].append((k, v))
                if w not in loose:
                    rare_postings[self.strides[k]].append((self.terms[w], k, v))
        #: Of each term: items in order, scores, best score, last item and best score of each block.
        self.postings = {}
        for t, listed_items in postings.items():
            at, score = [k for k, _ in listed_items], [v for _, v in listed_items]
            blocks = [(at[min(i + POSTING_BLOCK, len(at)) - 1], max(score[i : i + POSTING_BLOCK])) for i in range(0, len(at), POSTING_BLOCK)]
            self.postings[t] = (at, score, max(score), [b for b, _ in blocks], [v for _, v in blocks])
        self._rare = {}
        for stride, triples in rare_postings.items():
            triples.sort()
            first = np.searchsorted(np.array([t for t, _, _ in triples], np.int64), np.arange(len(self.terms) + 1))
            self._rare[stride] = (np.array([k for _, k, _ in triples], np.int64), np.array([v for _, _, v in triples]), first)

    def promising(self, passage: np.ndarray, term: np.ndarray, stride: int) -> np.ndarray:
        """Passages that could reach the threshold for some item of the class; the pairs of passage and term are distinct."""
        n = len(self.ids)
        rare_item, rare_score, rare_from = self._rare[stride]
        first, size = rare_from[term], rare_from[term + 1] - rare_from[term]
        where = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        key = np.repeat(passage, size) * n + rare_item[where]
        keys, at = np.unique(key, return_inverse=True)
        score = np.bincount(at, rare_score[where], len(keys))
        return np.unique(keys[score >= self.needed[keys % n]] // n)

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Block-max WAND: every item (its position) that scores at least the threshold, and its score."""
        lists = [(self.postings[t], [0]) for t in terms if t in self.postings]
        out = []
        while True:
            live = sorted(((p[0][at[0]], p, at) for p, at in lists if at[0] < len(p[0])), key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for i, (_, p, _) in enumerate(live):
                bound += p[2]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            block_bound, end = 0.0, None
            for _, p, _ in live[: pivot + 1]:
                b = bisect_left(p[3], item)
                if b < len(p[3]):
                    block_bound += p[4][b]
                    end = p[3][b] if end is None else min(end, p[3][b])
            if block_bound < threshold - 1e-9:  # no item up to the end of these blocks, or to the next cursor, can reach it
                skip = min(end + 1, live[pivot + 1][0]) if pivot + 1 < len(live) else end + 1
                skip = max(skip, item + 1)
                for _, p, at in live[: pivot + 1]:
                    at[0] = bisect_left(p[0], skip, at[0])
                continue
            score = 0.0
            for _, p, at in live[: pivot + 1]:
                at[0] = bisect_left(p[0], item, at[0])
                if at[0] < len(p[0]) and p[0][at[0]] == item:
                    score += p[1][at[0]]
                    at[0] += 1
            if score >= threshold - 1e-9:
                out.append((item, score))

    def _passages(self, at: np.ndarray, term: np.ndarray, length: int, stride: int):
        """Promising passages of a class, each with its distinct terms, in a text with those terms at those places."""
        v, count = len(self.terms), max(1, -(-(length - 2 * stride) // stride) + 1)
        half = at // stride  # a word is in the passage that starts in its stride and in the one before
        pairs = np.unique(np.concatenate([((half - back) * v + term)[(half - back >= 0) & (half - back < count)] for back in (0, 1)]))
        for passage in self.promising(pairs // v, pairs % v, stride).tolist():
            low, high = np.searchsorted(pairs, [passage * v, (passage + 1) * v])
            yield passage, (pairs[low:high] % v).tolist()

    def matches(self, text: str | None) -> list[dict]:
        """Items found in a text and confirmed, by item id; a passage is numbered by the stride of its item's class."""
        listed = words(text)
        if not listed or not self.ids:
            return []
        term = np.fromiter(map(self.terms.get, listed, repeat(-1)), np.int64, len(listed))
        at = np.flatnonzero(term >= 0)
        if not len(at):
            return []
        retrieved: dict[int, list[tuple[float, int]]] = defaultdict(list)
        for stride in self._rare:
            for passage, terms in self._passages(at, term[at], len(listed), stride):
                for item, score in self.search(terms):
                    if self.strides[item] == stride:
                        retrieved[item].append((-score, passage))
        out = []
        for item, found in sorted(retrieved.items()):
            stride, (question, answer) = self.strides[item], self.parts[item]
            for minus_score, passage in sorted(found):  # best first; the first that passes is reported
                around = listed[max(0, (passage - 2) * stride) : (passage + 4) * stride]
                q, a = shared(question, around), shared(answer, around)
                if q >= OVERLAP and a >= OVERLAP:
                    out.append({"item_id": self.ids[item], "score": round(min(1.0, -float(minus_score)), 6), "question": round(q, 6), "answer": round(a, 6), "passage": passage})
                    break
        return out


MATCH = "struct<item_id:bigint,score:double,question:double,answer:double,passage:int>"


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """The test items in blocks of at most about ``INDEX_BYTES``; one block is on the driver at a time in use."""
    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), text_of(text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = 1 + total // INDEX_BYTES
    for k in range(blocks):
        yield [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()]


def find_benchmark(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep`` columns and ``matches``: the benchmark items confirmed in the row's text; one row for each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if {"matches", "__text"} & set(keep):
        raise ValueError("the column matches is made here")
    match = T.StructType.fromDDL(f"x array<{MATCH}>")[0]
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("matches", match.dataType)])
    spark, out, written, statistics, blocks = df.sparkSession, None, None, Statistics(), 0
    for items in item_blocks(benchmark, item_id, item_text):
        statistics.add(items)
        blocks += 1
    for k, items in enumerate(item_blocks(benchmark, item_id, item_text)):
        sent = spark.sparkContext.broadcast(pickle.dumps(BenchmarkIndex(items, statistics)))
        before = [] if out is None else ["__before"]
        now = T.StructType([*schema] + ([T.StructField("__before", match.dataType), T.StructField("__text", T.StringType())] if out is not None else [T.StructField("__text", T.StringType())]))
        source = df.select(*keep, F.col(text).alias("__text")) if out is None else out.withColumnRenamed("matches", "__before")
        out = source.mapInArrow(_finder(sent, to_arrow_schema(now), [*keep, *before]), now)
        if before:
            out = out.withColumn("matches", F.array_sort(F.concat("__before", "matches"))).drop("__before")
        if k < blocks - 1:  # what one index found is written, so that its broadcast can go
            written, out = written, materialise(out, "matches")
            sent.destroy()
            discard(*([written] if written is not None else []))
            written = out
    return out.drop("__text")


def _finder(sent, arrow: pa.Schema, keep: list[str]):
    name = uuid.uuid4().hex

    def convert(texts: pa.Array) -> dict[str, pa.Array]:
        index = _index(name, sent)
        return {"matches": pa.array([index.matches(t) for t in texts.to_pylist()], arrow.field("matches").type), "__text": texts}

    return column_map(convert, "__text", arrow, keep)


_indexes: dict[str, BenchmarkIndex] = {}


def _index(name: str, sent) -> BenchmarkIndex:
    """The index of a pass, unpacked once a worker."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = pickle.loads(sent.value)
    return _indexes[name]
