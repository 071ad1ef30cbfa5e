"""Dictionary, alias, option, translation, folder and tree lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import saved


def dictionary(entries: DataFrame) -> DataFrame:
    """(key, value): lower-case keys of a-z only, the last insert (by seq) of each."""
    e = entries.select(F.lower("key").alias("key"), "value", "seq").where(F.col("key").rlike(r"^[a-z]*\z"))
    return e.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def exact_lookup(queries: DataFrame, entries: DataFrame, default: Column) -> DataFrame:
    """``queries`` (key, ...) with value, or the default where the key is missing."""
    found = dictionary(entries).withColumnRenamed("key", "k")
    return queries.join(found, F.lower("key") == F.col("k"), "left").withColumn("value", F.coalesce("value", default)).drop("k")


def prefix_lookup(queries: DataFrame, entries: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, rank, key, value): the entries under each prefix, shorter keys first, then by letter; the first ``limit`` if one is given.

    An empty prefix has all entries, one with any other character than a-z none. Entries meet the
    distinct prefixes by their first letters, for the lengths that prefixes have, and are cut
    before they meet the queries, so that many queries of one prefix don't repeat the work.
    """
    words = dictionary(entries)
    asked = queries.select("query_id", F.lower("prefix").alias("prefix")).where(F.col("prefix").rlike(r"^[a-z]*\z"))
    prefixes = asked.select("prefix").distinct()
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    starts = words.join(F.broadcast(lengths)).select("key", "value", F.explode("lengths").alias("n")).where("n <= length(key)").withColumn("prefix", F.expr("substring(key, 1, n)"))
    best = W.partitionBy("prefix").orderBy(F.length("key"), "key")
    ranked = starts.join(prefixes, "prefix", "left_semi").withColumn("rank", F.row_number().over(best))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return asked.join(ranked, "prefix").select("query_id", "rank", "key", "value")


#: How an item may match a probe: whole, whole whatever the case, at its start, at its end, anywhere.
MATCHES = ("exact", "fixed", "starts", "ends", "contains")


def find_first(queries: DataFrame, items: DataFrame, by: str = "text", match: str = "exact") -> DataFrame:
    """``queries`` (list_id, probe) with idx, the least index of an item of the list whose ``by`` (text or data) matches, or -1.

    Other matches than of whole values join by the pieces of the values that have a probe's
    length. A null probe matches nothing, an empty one every value's start, end and inside.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    value = F.col(by).cast("string")
    if match in ("exact", "fixed"):
        low = F.lower if match == "fixed" else (lambda c: c)
        first = items.groupBy(F.col("list_id").alias("l"), low(value).alias("p")).agg(F.min("idx").alias("found"))
        on = low(F.col("probe")) == F.col("p")
    else:
        lengths = queries.where("probe is not null").select("list_id", F.char_length("probe").alias("n")).distinct()
        i = items.select("list_id", "idx", value.alias("v")).join(lengths, "list_id").where("n <= char_length(v)")
        last = F.expr("char_length(v) - n + 1")
        start = {"starts": F.array(F.lit(1)), "ends": F.array(last), "contains": F.sequence(F.lit(1), last)}[match]
        i = i.select("list_id", "idx", "v", "n", F.explode(start).alias("at"))
        first = i.groupBy(F.col("list_id").alias("l"), F.expr("substring(v, at, n)").alias("p")).agg(F.min("idx").alias("found"))
        on = F.col("probe") == F.col("p")
    return queries.join(first, (F.col("list_id") == F.col("l")) & on, "left").withColumn("idx", F.coalesce("found", F.lit(-1))).drop("l", "p", "found")


def resolve_alias(aliases: DataFrame, available: DataFrame) -> DataFrame:
    """(name, grp, real_name): of each name's aliases, in order, the first that is available whatever the case; names without one go.

    Of several spellings of a real name the first of ``available`` (real_name, pos) counts.
    """
    real = available.groupBy(F.lower("real_name").alias("low")).agg(F.min_by("real_name", F.struct("pos", "real_name")).alias("real_name"))
    tried = aliases.select("name", "grp", F.posexplode("aliases").alias("at", "alias"))
    return tried.join(real, F.lower("alias") == F.col("low")).groupBy("name", "grp").agg(F.min_by("real_name", "at").alias("real_name"))


def localize(df: DataFrame, *catalogues: DataFrame, locale: str | None = None) -> DataFrame:
    """``df`` (context, source, ...) with text: the translation in the last catalogue that has one, or the source.

    With a ``locale`` only a catalogue's rows of that locale count. Of repeated entries the greatest translation counts.
    """
    out, names = df, []
    for k, c in enumerate(catalogues):
        names.insert(0, f"t{k}")
        c = c if locale is None else c.where(F.col("locale") == locale)
        out = out.join(c.groupBy("context", "source").agg(F.max("translation").alias(f"t{k}")), ["context", "source"], "left")
    return out.withColumn("text", F.coalesce(*names, "source")).drop(*names)


def existing_folders(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """The rows of ``wanted`` whose path, with / for \\, is in ``listing`` (path)."""
    return wanted.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/"))).join(listing, "path", "left_semi")


def folders_changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(list_id, changed): whether the two lists of paths differ as multisets; a null path is a path like others."""
    both = a.select("list_id", "path", F.lit(1).alias("n")).union(b.select("list_id", "path", F.lit(-1)))
    surplus = both.groupBy("list_id", "path").agg(F.sum("n").alias("n"))
    return surplus.groupBy("list_id").agg(F.bool_or(F.col("n") != 0).alias("changed"))


def add_folders(lists: DataFrame, added: DataFrame) -> DataFrame:
    """``lists`` (list_id, path) with the paths of ``added`` that a list does not hold yet, each once."""
    new = added.select("list_id", "path").where("path <> ''").distinct().join(lists, ["list_id", "path"], "left_anti")
    return lists.select("list_id", "path").union(new)


def visible_nodes(edges: DataFrame) -> DataFrame:
    """(node, depth, path): roots (parent null) always, deeper nodes if neither they nor a deeper ancestor is hidden.

    ``edges``: parent, child, pos, hidden. Ordered by depth and path (the places from the root
    down) the rows stand breadth first. Of several places of a node the one of the least depth counts, then the
    one with the least path, so a cycle ends. Where every node has one place, each knows a way
    up that doubles in every round, and a tree of depth d takes log(d) rounds; else the tree is gone down level by level.
    """
    kids = edges.where("parent is not null and not hidden").select("parent", "child", "pos")
    places = kids.select("child").union(edges.where("parent is null").select("child"))
    if places.groupBy("child").count().where("count > 1").isEmpty():
        return _doubled(edges, kids)
    level = saved(edges.where("parent is null").groupBy(F.col("child").alias("node")).agg(F.lit(0).alias("depth"), F.array(F.min("pos")).alias("path")))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        up = level.select(F.col("node").alias("parent"), "path")
        found = kids.join(up, "parent").select(F.col("child").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("pos")).alias("path"))
        level = saved(found.join(out.select("node"), "node", "left_anti").select("node", "depth", "path").groupBy("node", "depth").agg(F.min("path").alias("path")))
        out = out.union(level)
    return out


def _doubled(edges: DataFrame, kids: DataFrame) -> DataFrame:
    """``visible_nodes`` of a forest. (node, up, path): the places on the way from below ``up`` down to the node; a node whose ``up`` is null has its whole path."""
    roots = edges.where("parent is null").select(F.col("child").alias("node"), F.lit(None).cast(dict(edges.dtypes)["parent"]).alias("up"), F.array("pos").alias("path"))
    found, open_ways = saved(roots), saved(kids.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.array("pos").alias("path")))
    # A way leads up a power of two of steps; what is longer than there are nodes goes round in a cycle.
    left, steps = open_ways.count(), 1
    most = left
    while left and steps <= most:
        above = found.union(open_ways).select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("path").alias("upper"))
        # Ways that end at a node with no place, below something hidden, find nothing here.
        longer = saved(open_ways.join(above, "up").select("node", F.col("far").alias("up"), F.concat("upper", "path").alias("path")))
        found, open_ways = found.union(longer.where("up is null")), longer.where("up is not null")
        left, steps = open_ways.count(), 2 * steps
    return found.select("node", (F.size("path") - 1).alias("depth"), "path")
