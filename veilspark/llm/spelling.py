"""Spelling variants: words one insertion, deletion or replacement apart.

1. Runs of letters are counted per task and then per word; what is seen too rarely or is
   too short is no word.
2. The nodes of the trie of all words are numbered, and those of the trie of all words
   reversed. Both tries are cut into ranges of their sorted words, one task each, along
   border strings chosen from a bounded sample. A prefix that occurs on both sides of a
   border is a prefix of the border string, so such nodes are numbered by a table that
   every task builds alike from the borders alone; all other nodes belong to one range.
3. A word gives, for each position, the pair (prefix node before it, suffix node after
   it), and for each gap the pair (prefix node, suffix node) around it. Words that share
   a pair with one position left out differ in that letter; a word with one left out
   that meets another's gap has one letter more. Equal numbers mean equal strings, so the
   pairs are exact and nothing is compared again. Leaving out any letter of a run of equal
   ones gives the same word, so only the first meets gaps, and no link is found twice.
4. The words of a pair differ in one letter, so there are at most as many as the alphabet
   has, and one more in the gap. Links are reduced at once to a count and the best.
5. A form occurs at least ``ratio`` times as often as its word, so a chain of forms is at
   most log_ratio of the largest count long; roots are found by doubling.

Results for odd input: a null text has no words; a null id counts as an empty one where
letters are left out; very long texts are read whole and a very long word costs time and
rows in proportion to its length; repeated rows count again; of near words of equal count
the smallest in code-point order is the form; an empty table gives no rows; other columns
are not used.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.session import materialise, ship_package

LETTERS, LEAST_LENGTH, LEAST_COUNT, RATIO = "A-Za-zÀ-ÿ", 7, 2, 10
DROP_EVERY = 31
WORDS_PER_RANGE = 100_000
SAMPLE = 40
"""Sampled words per range, from which the borders are taken; they only decide how even the ranges are."""
BORDER_LENGTH = 24
HELD = 200_000
"""Different words that a task counts before it passes them on."""

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SKIP, _SKIP_FIRST, _GAP = 0, 1, 2


def spelled(doc: str, run: str, every: int = DROP_EVERY) -> str:
    """The run, less one letter where its CRC-32 with the document's id is a multiple of ``every``."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1:]
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS,
                least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = DROP_EVERY) -> DataFrame:
    """word, n of all words."""
    ship_package(docs.sparkSession)
    runs = re.compile(f"[{letters}]{{{least_length},}}")  # shorter runs give no word
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where(
        "text IS NOT NULL"
    )

    def run(batches):
        held = Counter()

        def told():
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc = doc.as_py()
                for found, n in Counter(m.translate(_LOW) for m in runs.findall(text.as_py())).items():
                    word = spelled(doc, found, every)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield told()
                    held.clear()
        yield told()

    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def borders(words: DataFrame, key: Column, per_range: int) -> list[str]:
    """Sorted strings that cut the values of ``key`` into ranges of about ``per_range``."""
    ranges = math.ceil(words.count() / per_range)
    if ranges < 2:
        return []
    sample = words.select(F.substring(key, 1, BORDER_LENGTH).alias("key"), F.xxhash64("word").alias("by"))
    keys = sorted({r.key for r in sample.orderBy("by").limit(SAMPLE * ranges).collect()})
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})


def _border_nodes(cuts: list[str]) -> dict[str, int]:
    """A negative number for every prefix of a border, the empty one included."""
    prefixes = sorted({c[:k] for c in cuts for k in range(len(c) + 1)} | {""})
    return {p: -1 - i for i, p in enumerate(prefixes)}


def numbered(words: DataFrame, key: Column, cuts: list[str]) -> DataFrame:
    """word, place (of its key in code-point order), nodes (the numbers of the prefixes of its key, the empty one first)."""
    ship_package(words.sparkSession)

    def ranged(batches):
        for batch in batches:
            part = [bisect_right(cuts, k) for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["word", "key", "part"])

    def number(batches):
        shared = _border_nodes(cuts)
        part, base, nodes, places, before, path = None, 0, 0, 0, "", []
        for batch in batches:
            told = []
            for word, key, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != part:
                    part, base, nodes, places, before, path = of, of << 40, 0, 0, "", [shared[""]]
                depth, most = 0, min(len(before), len(key))
                while depth < most and before[depth] == key[depth]:
                    depth += 1
                del path[depth + 1:]
                for k in range(depth + 1, len(key) + 1):
                    node = shared.get(key[:k]) if k <= BORDER_LENGTH else None
                    if node is None:
                        node, nodes = base + nodes, nodes + 1
                    path.append(node)
                told.append((word, base + places, pa.array(path, pa.int64())))
                places, before = places + 1, key
            if told:
                names, at, paths = zip(*told, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(at, pa.int64()), _lists(paths)], names=["word", "place", "nodes"]
                )

    keyed = words.select("word", key.alias("key")).mapInArrow(ranged, "word string, key string, part int")
    tasks = max(1, len(cuts) + 1)
    return keyed.repartition(tasks, "part").sortWithinPartitions("part", "key").mapInArrow(
        number, "word string, place long, nodes array<long>"
    )


def _lists(arrays) -> pa.Array:
    ends, total = [0], 0
    for a in arrays:
        total += len(a)
        ends.append(total)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(arrays))


def dictionary(words: DataFrame, per_range: int = WORDS_PER_RANGE) -> DataFrame:
    """word, n, id (in code-point order), prefixes, suffixes: the trie nodes of its beginnings, and of its ends by length."""
    forward, back = F.col("word"), F.reverse("word")
    ahead = numbered(words, forward, borders(words, forward, per_range)).withColumnsRenamed({"place": "id", "nodes": "prefixes"})
    behind = numbered(words, back, borders(words, back, per_range)).select("word", F.col("nodes").alias("suffixes"))
    return words.join(ahead, "word").join(behind, "word")


def pairs(entries: DataFrame) -> DataFrame:
    """p, s, kind, n, id: a word's pairs of nodes, with one letter left out (the first of a run of equal ones or not) and in
    its gaps."""
    size = F.size("prefixes") - 1
    at = entries.select(
        "prefixes", "suffixes", "n", "id", size.alias("size"), F.split("word", "").alias("letters"),
        F.explode(F.sequence(F.lit(0), size)).alias("i"),
    )
    prefix = F.get("prefixes", F.col("i"))
    gap = at.select(prefix.alias("p"), F.get("suffixes", F.col("size") - F.col("i")).alias("s"), F.lit(_GAP).alias("kind"), "n", "id")
    first = (F.col("i") == 0) | (F.get("letters", F.col("i") - 1) != F.get("letters", F.col("i")))
    skip = at.where("i < size").select(
        prefix.alias("p"), F.get("suffixes", F.col("size") - F.col("i") - 1).alias("s"),
        F.when(first, _SKIP_FIRST).otherwise(_SKIP).alias("kind"), "n", "id",
    )
    return skip.unionByName(gap)


def neighbours(entries: DataFrame) -> DataFrame:
    """id, n_near, form (the near word's id that has the largest count, the least of equals), form_n."""
    meet = pairs(entries).groupBy("p", "s").agg(F.collect_list(F.struct("kind", "n", "id")).alias("all")).where(F.size("all") > 1)
    links = meet.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where(
        "a.id != b.id AND (greatest(a.kind, b.kind) < 2 OR least(a.kind, b.kind) = 1)"
    )
    best = links.groupBy(F.col("a.id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_near"), F.max(F.struct(F.col("b.n").alias("n"), (-F.col("b.id")).alias("id"))).alias("best")
    )
    return best.select("id", "n_near", (-F.col("best.id")).alias("form"), F.col("best.n").alias("form_n"))


def roots(forms: DataFrame, largest: int, ratio: int) -> DataFrame:
    """id, root for every word that has a form, from (id, form); ``largest``: the largest count of a word."""
    now = forms.select("id", F.col("form").alias("root"))
    steps = 1
    while ratio ** (steps + 1) <= largest:  # else no chain has more links than ``steps``; each round doubles them
        further = now.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        now = materialise(now.join(further, "root", "left").select("id", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
        steps *= 2
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO,
             per_range: int = WORDS_PER_RANGE, **counting) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    if ratio < 2:
        raise ValueError("a form must occur more often than its word")
    words = materialise(word_counts(docs, id_col, text_col, **counting), "spelling-words")
    entries = materialise(dictionary(words, per_range), "spelling-tries")
    best = [F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")]
    near = materialise(
        entries.select("id", "word", "n").join(neighbours(entries), "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *best
        ),
        "spelling-near",
    )
    largest = words.agg(F.max("n")).first()[0] or 0
    formed = near.where("form IS NOT NULL").select("id", "form")
    names = near.select("id", "word")
    told = (
        formed.join(roots(formed, largest, ratio), "id")
        .join(names.withColumnsRenamed({"id": "form", "word": "form_word"}), "form")
        .join(names.withColumnsRenamed({"id": "root", "word": "root_word"}), "root")
        .select("id", "form_word", "root_word")
    )
    return near.join(told, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
