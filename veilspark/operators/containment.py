"""Protected strings inside texts: candidate equi-join, then an exact check."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed
from veilspark.session import grows, materialise, shared_dir, ship_package

# three words in a row with a blank on both sides: whole words of any text holding the string
_SHINGLE = "(?<= )(?=([^ ]+ [^ ]+ [^ ]+) )"
# eight characters that begin with a digit or capital: few places of a text, but found in most personal values
_LONG = "(?s)(?=([0-9A-Z].{7}))"
# every run of four characters; a protected string has at least four
_SHORT = f"(?s)(?=(.{{{fixed.MIN_PROTECTED_CHARS}}}))"
_KINDS = (_SHINGLE, _LONG, _SHORT)
SHARE, BLOCK, TASKS_PER_BLOCK = 1000, 20_000, 64
"""Strings of one anchor that are compared one by one; strings of an automaton; tasks that the texts of one are dealt to."""
LISTED, LISTED_CHARS = 512, 1 << 16
"""Strings of a scope, and characters of them together, that travel with each of its texts as one list."""
_ALNUM = r"\p{L}\p{N}"


def _scoped(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Strings of a scope (a session's vault) grow with the texts, so neither side is broadcast."""
    return grows(df) if scope else df


def _pieces(text: Column, pattern: str) -> Column:
    """Hashes of the distinct runs of a text."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), lambda p: F.xxhash64(p))


def anchors(items: DataFrame, item_text: str, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, item text, kind, run): one run per distinct string, of the first kind that it has, and of those the
    one that the fewest strings of its scope share."""
    unique = items.select(*scope, item_text).distinct()
    by_kind = [_pieces(F.col(item_text), k) for k in _KINDS]
    kind = F.when(F.size(by_kind[0]) > 0, 0).when(F.size(by_kind[1]) > 0, 1).otherwise(2)
    runs = unique.withColumn("_kind", kind).select(
        *scope, item_text, "_kind",
        F.explode(F.when(F.col("_kind") == 0, by_kind[0]).when(F.col("_kind") == 1, by_kind[1]).otherwise(by_kind[2])).alias("_run"),
    )
    shared = runs.groupBy(*scope, "_kind", "_run").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.struct("_kind", "_run"), F.struct("_n", "_run"))
    return (
        _scoped(runs, scope).join(shared, [*scope, "_kind", "_run"]).groupBy(*scope, item_text).agg(best.alias("_best"))
        .select(*scope, item_text, "_best._kind", "_best._run")
    )


def _runs_of(texts: DataFrame, keys: Sequence[str], text: str, anchored: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(text keys, kind, run): the distinct runs of each text, of the kinds that its scope has anchors of."""
    # Only kinds that the text's scope has anchors of are cut into runs.
    cut = range(len(_KINDS))
    if scope:
        wanted = grows(texts).join(anchored.groupBy(*scope).agg(F.collect_set("_kind").alias("_used")), list(scope))
    else:
        cut = sorted(r[0] for r in anchored.select("_kind").distinct().collect())  # three at most
        wanted = texts.withColumn("_used", F.array(*map(F.lit, cut)).cast("array<int>"))
    kinds = F.array(*[F.struct(F.lit(i).alias("_kind"), _pieces(F.col(text), _KINDS[i]).alias("_runs")) for i in cut])
    if not cut:
        kinds = F.array().cast("array<struct<_kind:int,_runs:array<bigint>>>")
    return (
        wanted.select(*keys, F.explode(F.filter(kinds, lambda k: F.array_contains("_used", k["_kind"]))).alias("_k"))
        .select(*keys, "_k._kind", F.explode("_k._runs").alias("_run"))
    )


def candidates(texts: DataFrame, keys: Sequence[str], text: str, anchored: DataFrame, item_text: str,
               scope: Sequence[str] = ()) -> DataFrame:
    """Pairs (text keys, item text) where the text has the item's anchor."""
    return _scoped(_runs_of(texts, keys, text, anchored, scope), scope).join(anchored, [*scope, "_kind", "_run"]).select(*keys, item_text)


def matched(texts: DataFrame, keys: Sequence[str], text: str, anchored: DataFrame, item_text: str,
            scope: Sequence[str] = ()) -> DataFrame:
    """Pairs (text keys, item text) where the item occurs, for strings of which very many have one anchor.

    Such strings are not compared with every text that has their anchor. Those of one anchor form blocks of at most
    ``BLOCK`` strings; a block becomes one automaton with failure links, and a text that has the anchor is read once per
    block, whatever the number of strings in it. Texts of one anchor are dealt to many tasks; a task reads the strings
    of a block from a table in the shared folder, and holds one automaton.
    """
    ship_package(texts.sparkSession)
    place = [*scope, "_kind", "_run"]
    size = materialise(anchored.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")), "match-sizes")
    block = F.pmod(F.xxhash64(item_text), F.col("_blocks")).cast("int")
    part = F.xxhash64(*place, "_block").alias("_part")
    blocks = anchored.join(size, place).withColumn("_block", block).select(part, F.col(item_text).alias("string"))
    folder = shared_dir(texts.sparkSession, "match-blocks")
    blocks.repartition("_part").sortWithinPartitions("_part").write.parquet(folder)
    having = _runs_of(texts, keys, text, anchored, scope).join(size, place).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    ).select(*keys, part)
    read = having.join(texts.select(*keys, text), list(keys)).select(*keys, "_part", F.col(text).alias("_text"))
    schema = texts.select(*keys).withColumn(item_text, F.lit(None).cast("string")).schema

    def run(batches):
        now, automaton = None, None
        for batch in batches:
            rows, found = [], []
            for i, (of, body) in enumerate(zip(batch.column("_part").to_pylist(), batch.column("_text").to_pylist(), strict=True)):
                if of != now:
                    now, automaton = of, _automaton(folder, of)
                hits = {string for _, string in automaton.iter(body)} if body and len(automaton) else ()
                rows += [i] * len(hits)
                found += hits
            at = pa.array(rows, pa.int64())
            columns = [batch.column(c).take(at) for c in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], names=schema.names)

    dealt = read.repartition("_part", F.pmod(F.xxhash64(*keys), F.lit(TASKS_PER_BLOCK))).sortWithinPartitions("_part")
    return dealt.mapInArrow(run, schema)


def _automaton(folder: str, part: int):
    import ahocorasick
    from pyarrow import dataset, fs

    store, root = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder if ":" in folder else f"file:{folder}"))
    strings = dataset.dataset(root, format="parquet", filesystem=store).to_table(columns=["string"], filter=dataset.field("_part") == part)
    out = ahocorasick.Automaton()
    for string in strings.column("string").to_pylist():
        out.add_word(string, string)
    out.make_automaton()
    return out


def _whole(n: int) -> str:
    """Runs of n characters that neither begin nor end inside a run of letters and digits."""
    return (
        rf"(?s)(?:(?<![{_ALNUM}])(?=[{_ALNUM}])|(?=[^{_ALNUM}]))(?=(.{{{n}}}))(?=.{{{n - 1}}}(?:[{_ALNUM}](?![{_ALNUM}])|[^{_ALNUM}]))"
    )


def short_hits(texts: DataFrame, keys: Sequence[str], text: str, items: DataFrame, item_text: str, scope: Sequence[str] = ()) -> DataFrame:
    """Pairs (text keys, item text) of strings under four characters that stand in the text on their own.

    So short a string occurs inside numbers and words all the time, so it counts only where letters and digits do not go
    on around it. Those runs of a text are taken out and meet the strings in an equi-join, which is exact: nothing is
    compared again. Only lengths that the text's scope asks for are taken out.
    """
    lengths = range(1, fixed.MIN_PROTECTED_CHARS)
    asked = items.select(*scope, item_text, F.length(item_text).alias("_n")).where(F.col("_n").isin(*lengths)).distinct()
    if scope:
        wanted = grows(texts).join(asked.groupBy(*scope).agg(F.collect_set("_n").alias("_used")), list(scope))
    else:
        wanted = texts.withColumn("_used", F.array(*[F.lit(r[0]) for r in asked.select("_n").distinct().collect()]).cast("array<int>"))
    runs = F.concat(*[
        F.when(F.array_contains("_used", n), F.regexp_extract_all(F.col(text), F.lit(_whole(n)), F.lit(1)))
        .otherwise(F.array().cast("array<string>")) for n in lengths
    ])
    told = wanted.select(*keys, F.explode(F.array_distinct(runs)).alias(item_text))
    return _scoped(told, scope).join(asked.drop("_n"), [*scope, item_text]).select(*keys, item_text)


def listed(texts: DataFrame, keys: Sequence[str], text: str, items: DataFrame, item_keys: Sequence[str], item_text: str,
           scope: Sequence[str], since: tuple[str, str] | None = None) -> DataFrame:
    """Pairs (text keys, item keys) of scopes with few strings: each text meets its scope's strings in one row.

    A text of a few thousand characters has as many runs, each of which would be a row to shuffle; the strings of a
    session are a few dozen. No run is made here: one row per text, and its work is bounded by ``LISTED``.
    """
    item = F.struct(*[c for c in dict.fromkeys([*item_keys, item_text]) if c not in scope])
    lists = items.groupBy(*scope).agg(F.collect_list(item).alias("_items"))

    def found(i: Column) -> Column:
        inside = F.contains(F.col(text), i[item_text])
        return inside if since is None else (i[since[0]] <= F.col(since[1])) & inside

    complete = texts.select(*dict.fromkeys([*keys, text])).dropna(subset=list(keys))
    # The outer form and a filter above it: for the inner one the optimizer would look for all strings twice.
    pairs = grows(complete).join(lists, list(scope)).select(*keys, F.explode_outer(F.filter("_items", found)).alias("_i"))
    return pairs.where(F.col("_i").isNotNull()).select(*keys, "_i.*")


def containment(
    texts: DataFrame,
    keys: Sequence[str],
    text: str,
    items: DataFrame,
    item_keys: Sequence[str],
    item_text: str,
    scope: Sequence[str] = (),
    least: int = fixed.MIN_PROTECTED_CHARS,
    share: int = SHARE,
    since: tuple[str, str] | None = None,
) -> DataFrame:
    """Pairs (text keys, item keys) where the item text occurs in the text.

    Where a scope has few strings (``LISTED``), its texts get them as a list (``listed``). All others meet by anchors.
    A string can only occur where each of its runs occurs, so each distinct item
    text keeps one anchor: an inner run of three words, else eight characters from
    a digit or capital on, else four characters; among those, the rarest one in its
    scope, so that values of one shape do not meet in it.  Texts give hashes of
    their distinct runs, and the two meet in an equi-join.  Only candidates are
    compared in full.  Where more than ``share`` strings of a scope have one anchor even
    so, they are looked for together (``matched``).  No join strategy is forced.  ``scope``
    columns (for example the session) must be among both key lists.  Strings under
    ``least`` characters are not looked for; ``too_short`` counts them. Of the others,
    those under four count only where they stand on their own (``short_hits``). ``since``: a column of the items and
    one of the text keys; a string counts only where the former is not above the latter.
    """
    wanted = items.filter(F.length(item_text) >= least)
    long = wanted.filter(F.length(item_text) >= fixed.MIN_PROTECTED_CHARS)
    few, columns = None, [*dict.fromkeys([*keys, *item_keys]), item_text]
    if scope:
        long = long.dropna(subset=list(scope))
        large = long.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length(item_text)).alias("_chars"))
        large = large.where((F.col("_n") > LISTED) | (F.col("_chars") > LISTED_CHARS)).select(*scope)
        if large.limit(1).count():
            large = materialise(large, "large-scopes")
            few, long = long.join(grows(large), list(scope), "left_anti"), long.join(grows(large), list(scope), "left_semi")
        else:
            few, long = long, None
    told = None if few is None else listed(texts, keys, text, few, item_keys, item_text, scope, since)
    if long is None and least >= fixed.MIN_PROTECTED_CHARS:
        return told.select(*columns)
    ids = wanted.select(*dict.fromkeys([*scope, *item_keys, item_text]))
    hits = None if long is None else anchored_hits(texts, keys, text, long, item_text, scope, share)
    if least < fixed.MIN_PROTECTED_CHARS:
        short = short_hits(texts, keys, text, wanted, item_text, scope)
        hits = short if hits is None else hits.unionByName(short)
    pairs = _scoped(hits, scope).join(ids, [*scope, item_text]).select(*dict.fromkeys(columns))
    if since is not None:
        pairs = pairs.where(F.col(since[0]) <= F.col(since[1]))
    return (pairs if told is None else told.unionByName(pairs)).select(*columns)


def anchored_hits(texts: DataFrame, keys: Sequence[str], text: str, long: DataFrame, item_text: str, scope: Sequence[str], share: int) -> DataFrame:
    """Pairs (text keys, item text) that meet by anchors, for any number of strings to a scope."""
    anchored = materialise(anchors(long, item_text, scope), "anchors")
    place = [*scope, "_kind", "_run"]
    shared = anchored.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share).drop("_n")
    common = None
    if shared.limit(1).count():
        shared = materialise(shared, "common-anchors")
        common = matched(texts, keys, text, anchored.join(shared, place), item_text, scope)
        anchored = anchored.join(shared, place, "left_anti")
    pairs = candidates(texts, keys, text, anchored, item_text, scope)
    hits = (
        _scoped(pairs, scope).join(texts.select(*keys, text), list(keys))
        .filter(F.contains(F.col(text), F.col(item_text)))
        .select(*keys, item_text)
    )
    return hits if common is None else hits.unionByName(common)


def too_short(items: DataFrame, item_text: str, scope: Sequence[str] = (), least: int = fixed.MIN_PROTECTED_CHARS) -> DataFrame:
    """How many strings of each scope are too short to be looked for."""
    short = F.length(item_text) < least
    return items.groupBy(*scope).agg(F.count_if(F.coalesce(short, F.lit(False))).alias("too_short"))
