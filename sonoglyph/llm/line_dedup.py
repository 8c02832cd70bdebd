"""Operator 10, line dedup (DataFrame functions only): maximal repeated runs of lines from a suffix array.

A document is a sequence of line ids. Suffixes are ranked by their first 2, 4, 8 ... lines: each round sorts the pairs
(rank of a suffix, rank of the suffix that many lines further on) over range partitions and turns their places into the
next ranks, so that the ranks are the suffix array's order as far as it has come. Suffixes whose rank nobody shares are
done; the rounds go on with the others and end when none is left, whose number is the logarithm of the longest repeated
run. Suffixes of equal rank are an interval of the suffix array whose longest common prefix is at least so many lines.

From the longest intervals down, lengths between two powers of 2 are found by halving: an interval is parted by the rank
of what follows its lines, the parts are longer intervals. A part's first suffix in the order of (doc_id, line) stands for
it in the interval that it was part of, so that every suffix is a later copy in just one interval, the longest in which
it is not the first. Its run is that interval's lines; runs that no earlier run of the document covers are maximal, and
their lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sonoglyph.llm.store import cut, discard, free_name, table

#: Lines that a run must have to count as a copy.
MIN_LINES = 2


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, ids): two hashes of each line of each document, with ``xxhash64`` of the text; of rows that repeat
    a doc_id the text of the least hash."""
    lines = F.split("text", "\n", -1)
    ids = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.struct(F.xxhash64("text").alias("text_hash"), ids.alias("ids")).alias("t"))
    return rows.groupBy("doc_id").agg(F.min("t").alias("t")).select("doc_id", "t.text_hash", "t.ids")


def _first_windows(lines: DataFrame) -> DataFrame:
    """(doc_id, at, lines, a, b): a 128-bit id of each window of MIN_LINES = 2 lines, made of two of one line."""
    pairs = F.when(F.size("ids") >= 2, F.transform(F.sequence(F.lit(0), F.size("ids") - 2), lambda i: F.struct(
        F.xxhash64(F.get("ids", i)["a"], F.get("ids", i + 1)["a"]).alias("a"), F.xxhash64(F.get("ids", i)["b"], F.get("ids", i + 1)["b"]).alias("b"))))
    return lines.select("doc_id", F.posexplode(pairs).alias("at", "w")).select("doc_id", "at", F.lit(1).alias("lines"), "w.a", "w.b")


def _rank(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Of windows (doc_id, at, lines, *keys), each of two times ``lines``, those that share their keys with another one:
    (doc_id, at, lines, rank, first_doc_id, first_at), where rank is the number of windows before theirs in the order of the
    keys, and first the earliest of them. Lengths are columns, not constants: all levels run the same compiled code.

    Keys with their counts are sorted by range; a running sum within each range plus the sums of the ranges before it
    is the rank, so no task sees more than its range.
    """
    counts = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "at")).alias("first")).where("c > 1")
    counts = cut(counts.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("range")), "line-keys")
    # a range has one row here; their number is that of the shuffle's partitions
    sums = counts.groupBy("range").agg(F.sum("c").alias("s"))
    before = sums.select("range", (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("before"))
    order = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("*", F.coalesce(F.sum("c").over(order), F.lit(0)).alias("within")).join(before, "range")
    ranks = ranks.select(*keys, (F.col("within") + F.col("before")).alias("rank"), "first")
    ranked = cut(windows.join(ranks, keys).select("doc_id", "at", (F.col("lines") * 2).alias("lines"), "rank", F.col("first.doc_id").alias("first_doc_id"), F.col("first.at").alias("first_at")), "line-ranks")
    discard(counts)
    return ranked


_LATE = "doc_id > first_doc_id or doc_id = first_doc_id and at > first_at"
_INTERVAL = ["lines", "first_doc_id", "first_at"]


def suffix_ranks(lines: DataFrame) -> dict[int, DataFrame]:
    """Of ``line_ids``, by number of lines (2, 4, 8 ...): the suffixes that share so many with another one, see ``_rank``."""
    levels = {2: _rank(_first_windows(lines), ["a", "b"])}
    while not levels[n := max(levels)].isEmpty():
        # windows of twice as many lines: both halves must be shared
        level = levels[n].select("doc_id", "at", "lines", "rank")
        ahead = level.select("doc_id", (F.col("at") - F.col("lines")).alias("at"), F.col("rank").alias("next"))
        levels[2 * n] = _rank(level.withColumnRenamed("rank", "r").join(ahead, ["doc_id", "at"]), ["r", "next"])
    return levels


def _longer(members: DataFrame, following: DataFrame) -> DataFrame:
    """Intervals of ``members`` parted by the lines that follow theirs: (_doc_id, _at, more, a, b), so many, in ``following``."""
    rows = members.join(following, (members["doc_id"] == following["_doc_id"]) & (members["at"] + members["lines"] == following["_at"]), "left").drop("_doc_id", "_at")
    keys = [*_INTERVAL, "a", "b"]
    parts = rows.where("a is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "at")).alias("part")).where("c > 1").drop("c")
    joined = rows.join(parts, keys, "left")
    stays = F.struct(*_INTERVAL)
    goes = F.struct((F.col("lines") + F.col("more")).alias("lines"), F.col("part.doc_id").alias("first_doc_id"), F.col("part.at").alias("first_at"))
    both = F.when(F.col("part").isNull(), F.array(stays)).when(F.col("part") == F.struct("doc_id", "at"), F.array(stays, goes)).otherwise(F.array(goes))
    return cut(joined.select("doc_id", "at", F.explode(both).alias("i")).select("doc_id", "at", "i.*"), "line-intervals")


def intervals(lines: DataFrame) -> DataFrame:
    """Of ``line_ids``: (doc_id, at, lines, first_doc_id, first_at): suffixes and the intervals of the suffix array that they belong to,
    ``lines`` lines in common, of which the first is the earliest copy. Each later copy is in one interval."""
    levels = suffix_ranks(lines)
    members = None
    for n in sorted(levels, reverse=True)[1:]:
        beyond = levels[2 * n].where(_LATE).select("doc_id", "at")
        own = levels[n].join(beyond, ["doc_id", "at"], "left_anti").select("doc_id", "at", "lines", "first_doc_id", "first_at")
        if n > 2:
            following = levels[n // 2].select(F.col("doc_id").alias("_doc_id"), F.col("at").alias("_at"), F.col("lines").alias("more"), F.col("rank").alias("a"), F.lit(0).cast("long").alias("b"))
        else:
            following = lines.select(F.col("doc_id").alias("_doc_id"), F.posexplode("ids").alias("_at", "id")).select("_doc_id", "_at", F.lit(1).alias("more"), "id.a", "id.b")
        made = _longer(own if members is None else members.union(own), following)
        if members is not None:
            discard(members)
        members = made
        discard(levels.pop(2 * n))
    if members is None:
        return lines.select("doc_id", F.lit(0).alias("at"), F.lit(0).alias("lines"), F.col("doc_id").alias("first_doc_id"), F.lit(0).alias("first_at")).where("false")
    return members


def maximal_runs(found: DataFrame) -> DataFrame:
    """Of ``intervals`` the later copies whose lines no later copy that begins a line before them has all."""
    late = found.where(_LATE)
    before = late.select("doc_id", (F.col("at") + 1).cast("int").alias("at"), (F.col("lines") - 1).cast("int").alias("lines"))
    return late.join(before, ["doc_id", "at", "lines"], "left_anti")


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with later copies of repeated runs of two lines or more deleted from text,
    and n_lines, n_deleted and longest (lines of the longest run that the text has in common with another place, its own
    or another document's; 0 without one).

    The first copy in the order of (doc_id, line) stays. Lines are what ``\\n`` parts, compared whole. A null text stays
    null and has no line; an empty text is one line and never part of a run. A text that loses all its lines becomes
    empty. Of rows that repeat a doc_id those of one text, the one of the least hash, are the document and share its
    decisions; the others and those of a null doc_id are left as they are. No rows, no rows. Columns named like the added ones are replaced.
    """
    keep = [c for c in docs.columns if c not in ("text", "n_lines", "n_deleted", "longest")]
    out, kept_, longest = _decided(docs.select(*keep, "text"))
    lines = F.split("text", "\n", -1)
    return out.select(
        *keep, _cleared(kept_).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(kept_).isNull(), 0).otherwise(F.size(lines) - F.size(kept_)).cast("long").alias("n_deleted"),
        F.coalesce(longest, F.lit(0)).cast("long").alias("longest"))


def clear_lines(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with text as ``line_dedup`` leaves it."""
    out, kept_, _ = _decided(docs)
    return out.select(*(_cleared(kept_).alias("text") if c == "text" else c for c in docs.columns))


def _cleared(kept: str) -> Column:
    return F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def _decided(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns more: the lines that stay, null where all do, and the lines of the longest run."""
    id_, hash_, runs, longest, kept_ = (free_name(docs, x) for x in ("_run_id", "_run_hash", "_runs", "_run_longest", "_run_kept"))
    known = cut(line_ids(docs.select("doc_id", "text")), "line-ids")
    found = intervals(known)
    copies = maximal_runs(found).groupBy("doc_id").agg(F.collect_list(F.struct("at", "lines")).alias(runs))
    marks = found.groupBy("doc_id").agg(F.max("lines").alias(longest)).join(copies, "doc_id", "left").join(known.select("doc_id", F.col("text_hash").alias(hash_)), "doc_id").withColumnRenamed("doc_id", id_)
    lines = F.split("text", "\n", -1)
    gone = lambda i: F.exists(runs, lambda r: (r["at"] <= i) & (i < r["at"] + r["lines"]))
    joined = docs.join(marks, (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(hash_)), "left")
    return joined.withColumn(kept_, F.when(F.size(runs) > 0, F.filter(lines, lambda x, i: ~gone(i)))), kept_, longest


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", "longest", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE_SQL = {
    "op10_line_dedup": r"""
with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
w as (select doc_id, pos, line || chr(10) || lead(line) over (partition by doc_id order by pos) as w from l),
late as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as k from w where w is not null) where k > 1),
gone as (select doc_id, pos from late union select doc_id, pos + 1 from late),
kept as (select l.doc_id, count(*) as n_lines, count(g.pos) as n_deleted,
                coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as text
         from l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id),
id as (select doc_id, pos, dense_rank() over (order by line) as id from l),
shared(doc_id, pos, cls, n) as (
  select doc_id, pos, cls, 2 from (select doc_id, pos, dense_rank() over (order by w) as cls, count(*) over (partition by w) as c from w where w is not null) where c > 1
  union all
  select doc_id, pos, cls, n + 1 from (select s.doc_id, s.pos, s.n, min(s.doc_id * 1000000 + s.pos) over (partition by s.cls, id.id) as cls, count(*) over (partition by s.cls, id.id) as c
                                       from shared s join id on id.doc_id = s.doc_id and id.pos = s.pos + s.n) where c > 1),
long as (select doc_id, max(n) as longest from shared group by doc_id)
select doc_id, n_lines, n_deleted, coalesce(longest, 0)::bigint as longest, length(text) as n_chars, md5(text) as text_md5 from kept left join long using (doc_id)
""",
}
