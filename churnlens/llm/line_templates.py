"""Operator 8, line dedup with a log-template tree (DataFrame functions only).

Every line walks a tree of fixed depth: its token count, then its ``LEADING`` first tokens. Tokens
with a digit are variable from the start. Lines that are equal but for digit fields form a template
of their own. The other lines of a leaf are generalised, together with one line for each such
template, which counts for all its texts: the most frequent token of each place, where it holds most
of the lines, is constant, any other place is variable. A line belongs to the template if at least
``SIMILAR`` of its places agree with it.

A leaf holds as many templates as its lines show. The lines that no recurring template of their group
takes move on to smaller groups, the cells of the tokens that recur in the group: all its lines that
have the token at its place. A line of n tokens that agrees with a template at ``SIMILAR`` of its places
has at most (1 - SIMILAR) * n others, so among one more than so many of its rarest recurring tokens one
is the template's own; the line goes to the cells of these tokens (cells of the same lines are one). A
cell that still holds several templates is divided again by the rarest token of each line, until no
group has enough lines. Cells shrink fast, so the rounds do not grow with the templates of a leaf.

A template that recurs in ``MIN_DOCS`` documents of different text or more, or in ``LONG_DOCS`` if
it has ``LONG_TOKENS`` tokens or more, is dropped everywhere but in the document with the least id,
so no passage is lost from the corpus and exact copies of a document don't empty it. Lines of fewer
than ``MIN_TOKENS`` tokens never count.

Only hashes, ids and line numbers are shuffled; the texts are rewritten in place, by a join with
the list of dropped line numbers of the rows that have any.

Defined edge cases: null texts stay null with 0 lines, empty ones empty; repeated rows and exact
copies count as one document; ties for the constant token go to the one that sorts first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.graph import stored

LEADING, MIN_TOKENS, MIN_DOCS, SIMILAR = 4, 5, 5, 0.8
LONG_TOKENS, LONG_DOCS = 50, 2
#: up to so many lists of dropped lines are broadcast; beyond it the texts are joined
BROADCAST_LISTS = 300_000
_BLANK = "[ \\t\\u000B\\f\\r]+"
_UNEVEN = ("\t", "\u000b", "\f", "\r", "  ")


def _even(text: Column) -> Column:
    """The text with single blanks; plain byte searches tell whether the pattern is needed at all."""
    uneven = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in _UNEVEN])
    return F.when(uneven, F.regexp_replace(text, _BLANK, " ")).otherwise(text)


def _masked(line: Column) -> Column:
    """The tokens of a line with single blanks; those with a digit become <*>."""
    plain = F.trim(line)
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(plain)


def line_table(rows: DataFrame) -> DataFrame:
    """(rk, tkey, doc_id, no, size, leaf, template) of each line of ``rows`` (rk, tkey, doc_id, text)."""
    # the array is made before it is exploded, so that each line is masked once and not for every use of it
    lines = F.posexplode(F.transform(F.split(_even(F.col("text")), "\n"), _masked)).alias("no", "m")
    masked = rows.where("text is not null").select("rk", "tkey", "doc_id", lines).where("m <> ''")
    size = F.length("m") - F.length(F.replace("m", F.lit(" "))) + 1
    return masked.withColumn("size", size).where(F.col("size") >= MIN_TOKENS).select(
        "rk", "tkey", "doc_id", "no", "size", F.xxhash64("size", F.substring_index("m", " ", LEADING)).alias("leaf"), F.xxhash64("m").alias("template"))


def _enough(size: Column) -> Column:
    """In how many texts a line of so many tokens must stand to recur."""
    return F.when(size >= LONG_TOKENS, LONG_DOCS).otherwise(MIN_DOCS)


def _recurring(lines: DataFrame, key: str) -> DataFrame:
    """Keys held by enough texts, their number, and the row and line of the least; counted in two
    steps, so that a frequent line is never gathered in one task."""
    weight = F.max("weight") if "weight" in lines.columns else F.lit(1)
    per_text = lines.groupBy(key, "tkey").agg(F.min(F.struct("doc_id", "rk", "no", "tkey")).alias("first"), F.max("size").alias("size"), weight.alias("w"))
    found = per_text.groupBy(key).agg(F.sum("w").alias("texts"), F.min("first").alias("first"), F.max("size").alias("size"))
    return found.where(F.col("texts") >= _enough(F.col("size")))


def _with_lists(rows: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with the line numbers that ``lines`` (rk, no) lists for them."""
    lists = stored(lines.groupBy("rk").agg(F.collect_set("no").alias("listed")), "lists")
    return rows.join(F.broadcast(lists) if lists.count() <= BROADCAST_LISTS else lists, "rk", how)


def _groups(cells: DataFrame) -> DataFrame:
    """(grp, all, words) of the groups that can hold a template: the number of their lines and the token
    that most of them have at each place, null where there is none."""
    top = cells.groupBy("grp", "place").agg(F.max(F.struct("times", "token")).alias("top"), F.sum("times").alias("all"), F.sum("open").alias("open"))
    constant = F.when(2 * F.col("top.times") > F.col("all"), F.col("top.token"))
    found = top.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct("place", constant.alias("token")))).alias("places"), F.max("all").alias("all"), F.max("open").alias("open"))
    return found.where((F.col("open") > 0) & (F.col("all") >= _enough(F.size("places")))).select(
        "grp", "all", F.transform("places", lambda p: p["token"]).alias("words"))


def _cells_of(rest: DataFrame, cells: DataFrame, picks: Column) -> DataFrame:
    """(rk, no, tokens, ..., grp) of the lines with the cells of their ``picks`` rarest recurring tokens as groups;
    a token that all lines of the group share says nothing."""
    own = rest.select("grp", "all", "size", "rk", "no", F.posexplode("tokens").alias("place", "token"))
    recurring = cells.select("grp", "place", "token", "times", "members")
    own = own.join(recurring, ["grp", "place", "token"]).where((F.col("times") < F.col("all")) & (F.col("times") >= _enough(F.col("size"))))
    ranked = own.groupBy("grp", "rk", "no").agg(F.sort_array(F.collect_list(F.struct("times", "place", "members"))).alias("ranked"), F.max("size").alias("n"))
    picked = F.array_distinct(F.transform(F.slice("ranked", F.lit(1), picks), lambda c: F.xxhash64(c["times"], c["members"])))
    chosen = ranked.select("grp", "rk", "no", F.explode(picked).alias("cell"))
    return rest.join(chosen, ["grp", "rk", "no"]).withColumn("grp", F.xxhash64("grp", "cell")).drop("cell")


def _generalised(lines: DataFrame) -> list[DataFrame]:
    """Tables of (rk, no) of the lines to drop, of lines with a group ``grp``, their ``tokens`` and a
    ``weight``; those that are ``exact`` only lend their weight."""
    found, columns = [], lines.columns
    picks = (F.col("n") - F.ceil(F.col("n") * SIMILAR) + 1).cast("int")
    while True:
        each = lines.select("grp", "exact", "weight", F.xxhash64("rk", "no").alias("line"), F.posexplode("tokens").alias("place", "token"))
        cells = stored(each.groupBy("grp", "place", "token").agg(
            F.sum("weight").alias("times"), F.sum((~F.col("exact")).cast("int")).alias("open"), F.bit_xor("line").alias("members")), "cells")
        agree = F.size(F.filter(F.zip_with("tokens", "words", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
        here = stored(lines.join(_groups(cells), "grp").withColumn("near", agree >= F.ceil(F.size("tokens") * SIMILAR)).drop("words"), "grouped")
        recurring = _recurring(here.where("near"), "grp").select("grp", F.col("first.rk").alias("first"))
        taken = stored(here.where("near").join(recurring, "grp").select("rk", "no", "first", "exact").distinct(), "taken")
        found.append(taken.where("not exact and rk <> first").select("rk", "no"))
        settled = taken.where("not exact").select("rk", "no").distinct()
        rest = here.join(settled, ["rk", "no"], "left_anti") if not settled.isEmpty() else here
        lines = stored(_cells_of(rest.drop("near"), cells, picks).select(columns), "open")
        if lines.where("not exact").isEmpty():
            return found
        picks = F.lit(1)


def dropped_lines(rows: DataFrame) -> DataFrame:
    """(rk, no) of the lines to drop; the row that keeps a template's first copy is spared."""
    lines = stored(line_table(rows), "lines")
    leaf = lines.groupBy("template").agg(F.first("leaf").alias("leaf"))
    same = stored(_recurring(lines, "template").join(leaf, "template"), "templates")
    exact = lines.join(same.select("template", F.col("first.rk").alias("first")), "template").where("rk <> first").select("rk", "no")
    # leaves that recur beyond their equal lines are generalised by place
    rest = stored(lines.join(same, "template", "left_anti"), "rest")
    leaves = _recurring(rest, "leaf").select("leaf").unionByName(same.select("leaf")).distinct()
    loose = rest.join(leaves, "leaf", "left_semi").select("rk", "tkey", "doc_id", "no", "size", "leaf", F.lit(1).cast("bigint").alias("weight"), F.lit(False).alias("exact"))
    stand = same.join(rest.select("leaf").distinct(), "leaf", "left_semi").select("first.rk", "first.tkey", "first.doc_id", "first.no", "size", "leaf", F.col("texts").alias("weight"), F.lit(True).alias("exact"))
    loose = stored(loose.unionByName(stand).distinct(), "loose")
    texts = _with_lists(rows.select("rk", "text"), loose, "inner").select("rk", F.split("text", "\n").alias("lines"), F.explode("listed").alias("no"))
    words = F.split(_masked(_even(F.element_at("lines", F.col("no") + 1))), " ")
    tokens = texts.select("rk", "no", F.transform(words, lambda t: F.xxhash64(t)).alias("tokens")).dropDuplicates(["rk", "no"])
    near = _generalised(stored(tokens.join(loose.withColumnRenamed("leaf", "grp"), ["rk", "no"]), "tokens"))
    return reduce(DataFrame.unionByName, near, exact)


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts rewritten, and the columns n_lines and n_dropped at the end."""
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}  # so that no column of the table can clash
    doc_id, text = F.col(names[id_col]).cast("bigint"), F.col(names[text_col]).cast("string")
    own = docs.toDF(*names.values())
    rows = own.select(F.xxhash64(doc_id, text).alias("rk"), F.xxhash64(text).alias("tkey"), doc_id.alias("doc_id"), text.alias("text"))
    out = _with_lists(own.withColumn("rk", F.xxhash64(doc_id, text)), dropped_lines(rows), "left")
    lines = F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("listed", i)), "\n")
    n_dropped = F.coalesce(F.size("listed"), F.lit(0)).cast("bigint")
    kept = {text_col: F.when(F.col("listed").isNull(), text).otherwise(left)}
    return out.select(*[kept.get(c, F.col(n)).alias(c) for c, n in names.items()],
                      F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"), n_dropped.alias("n_dropped"))
