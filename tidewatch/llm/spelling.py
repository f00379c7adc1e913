"""Spelling variants of words, by pairs of trie-node numbers.

The words are put in one trie by their beginnings and in another by their ends, and the nodes of both are numbered. A word
of L code points is then two paths of L + 1 numbers, and (node of the first i, node of the last L - j) stands for the word
without the code points between: with j = i + 1 one is skipped, with j = i none is (a place for an insertion). Two words
differ by one replaced code point if they share a skipping pair, by one inserted or deleted if a skipping pair of one is
a whole pair of the other. These are joins of integers that give exactly the neighbours: of a run of equal code points only the
first is skipped for deletions, so that each neighbour comes once. At most one word for each letter shares a pair (90
letters), so no key is hot.

Tries are numbered in ranges of the sorted words: a node on the path of some range's first word has its number from the
trie of those first words (one word a range, known to all tasks), any other lies within one range and is
numbered there.

Defined results: null and empty texts have no words; a null doc_id counts as empty text in the checksum; rows that repeat
count each time; very long texts and runs are read whole; of near words with equal counts the smallest in code-point
order is the form; further columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import LOWER
from tidewatch.sources.scratch import cut, partitions

#: Code points and occurrences of a word, at least; one run in so many loses a code point; how many times more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, DAMAGED, FACTOR = 7, 2, 31, 10
#: Words that a task holds before it hands their counts on.
HELD = 300_000

_LOWER = LOWER.tobytes()
#: A range's numbers begin at its own multiple of this.
_STEP = 1 << 40


def _words(least: int):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)  # what is deleted from a shorter run leaves no word

    def out(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(runs.findall(text.as_buffer().to_pybytes().translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield out(held)
                    held = {}
        yield out(held)

    return run


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word, n."""
    rows = docs.select("doc_id", "text").mapInArrow(_words(least), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def first_trie(firsts: list[str]) -> dict[tuple[int, str], int]:
    """(node, code point) to node of the trie of some words; the root is 0."""
    trie: dict[tuple[int, str], int] = {}
    for word in firsts:
        node = 0
        for c in word:
            node = trie.setdefault((node, c), len(trie) + 1)
    return trie


def trie_paths(words: list[str], trie: dict[tuple[int, str], int], start: int) -> tuple[list[int], list[int]]:
    """Node numbers of all beginnings (the empty one first) of sorted words in a row, and how many each word has."""
    path, before, out, sizes, known = [0], "", [], [], len(trie)
    for word in words:
        same, most = 0, min(len(before), len(word))
        while same < most and before[same] == word[same]:
            same += 1
        del path[same + 1 :]
        for c in word[same:]:
            node = trie.get((path[-1], c)) if path[-1] <= known else None
            if node is None:
                start += 1
                node = start
            path.append(node)
        out += path
        sizes.append(len(path))
        before = word
    return out, sizes


def _numbered(words: DataFrame, reverse: bool) -> DataFrame:
    """word, n, id (in the words' order), path: node numbers by beginnings, or by ends if ``reverse``."""
    key = F.reverse("word") if reverse else F.col("word")
    dealt = words.withColumn("key", key).repartitionByRange(partitions(words, 16), "key").withColumn("range", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    firsts = [r.first for r in dealt.groupBy("range").agg(F.min("key").alias("first")).orderBy("range").collect()]  # one word a range

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        own = t.column("range")[0].as_py() + 1
        nodes, sizes = trie_paths(t.column("key").to_pylist(), first_trie(firsts), own * _STEP)
        offsets = [0]
        for n in sizes:
            offsets.append(offsets[-1] + n)
        path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(nodes, pa.int64()))
        ids = pa.array(range(own * _STEP, own * _STEP + len(t)), pa.int64())
        return pa.table({"word": t.column("word"), "n": t.column("n"), "id": ids, "path": path})

    return dealt.groupBy("range").applyInArrow(run, "word string, n long, id long, path array<long>")


def near_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words with their ids (word, n, id; ids in code-point order), and id, other, n_other for each near word of each word."""
    ends = _numbered(words, True).select("word", F.col("path").alias("suffix"))
    both = cut(_numbered(words, False).withColumnRenamed("path", "prefix").join(ends, "word"), "paths")
    last = F.size("prefix") - 1
    new = lambda i: F.when(i == 0, True).otherwise(F.get("letters", i) != F.get("letters", i - 1))
    rows = both.withColumn("letters", F.split("word", ""))
    skip = rows.select("id", "n", F.explode(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct(F.get("prefix", i).alias("p"), F.get("suffix", last - 1 - i).alias("s"), new(i).alias("new")))).alias("at")).select("id", "n", "at.*")
    whole = rows.select("id", "n", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get("prefix", i).alias("p"), F.get("suffix", last - i).alias("s")))).alias("at")).select("id", "n", "at.*")
    skip = cut(skip, "skipping")
    other = skip.select("p", "s", F.col("id").alias("other"), F.col("n").alias("n_other"))
    replaced = skip.join(other, ["p", "s"]).where("id <> other").select("id", "other", "n_other")
    deleted = skip.where("new").join(whole.select("p", "s", F.col("id").alias("other"), F.col("n").alias("n_other")), ["p", "s"]).select("id", "n", "other", "n_other")
    # each pair is listed from both ends
    ends = F.array(F.struct("id", "other", "n_other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), F.col("n").alias("n_other")))
    return both.select("word", "n", "id"), replaced.unionByName(deleted.select(F.explode(ends).alias("e")).select("e.*"))


def spelling_forms(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word."""
    words, pairs = near_pairs(cut(word_counts(docs, least, count), "words"))
    near = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct("n_other", (-F.col("other")).alias("key"))).alias("best"))
    known = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.n_other") >= factor * F.col("n"), F.col("best")).alias("best"))
    known = cut(known.select("id", "word", "n", "n_near", (-F.col("best.key")).alias("form_id"), F.col("best.n_other").alias("form_n")), "forms")
    # Each form has at least ``factor`` times the count, so chains are short; every round doubles what a row has followed.
    up = known.where("form_id is not null").select("id", F.col("form_id").alias("root_id"))
    while True:
        further = up.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        up = cut(up.join(further, "root_id", "left").select("id", F.coalesce("further", "root_id").alias("root_id"), "further"), "roots")
        if up.where("further is not null").isEmpty():
            break
        up = up.drop("further")
    name = known.select("id", "word")
    ends = known.where("form_id is not null").join(up.select("id", "root_id"), "id")
    ends = ends.join(name.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id").join(name.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id")
    return known.join(ends.select("id", "form", "root"), "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
