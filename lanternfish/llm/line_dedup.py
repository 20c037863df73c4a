"""Line deduplication over a log-template tree, in DataFrame functions only.

A token that holds a digit, an at sign or a scheme is a variable field from the start and generalised to one mark, so
"Page 3 of 12" and "Page 4 of 12" are one line.  The tree's first level is the number of tokens, the next ones are
the DEPTH leading tokens; below them lie the leaves, each a group of different lines.  In a leaf, every place behind
the leading tokens is judged by how many documents have which token there: a token in fewer than one in SHARE of the
leaf's (document, line) pairs is a value of a variable field and becomes the mark too.  A line's template is what
is left; a line whose template would keep fewer than SIMILARITY percent of its tokens resembles its leaf too little,
and is its own template.

A template that recurs in LEAST_DOCS documents or more is dropped wherever it stands, but for the document of the
smallest doc_id that has it, which keeps all its lines of it.  Short lines recur by chance: a template of fewer than
LEAST_TOKENS constant tokens must stand in SHORT times as many documents for each token that it lacks.

Lines travel as 128 bits of hash with (doc_id, line number); they are counted with partial aggregates, and both sides
of each join are written and joined by sorting, so that adaptive execution splits hot keys and no side must be small.  Only the different lines of leaves that can
have a field (more than one line, more than SHARE pairs) are spelled out, once each, from one place where they
stand.  Texts move twice: to give those lines, and to meet the numbers of their dropped lines.

Defined results: a null text has no lines and stays null; an empty text is one empty line; lines without a token are
never dropped; rows of one doc_id count as one document; rows without a doc_id keep all lines and count for
nothing; repeated rows get equal results; very long texts and lines are handled whole, in time linear in their
lines and tokens; an empty table gives an empty one; extra columns are kept, n_lines and n_dropped replaced where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish import session

DEPTH = 2
SHARE = 5
SIMILARITY = 70
LEAST_DOCS = 3
LEAST_TOKENS, SHORT = 4, 4
#: White space between tokens; a variable token and the mark for it; what neither plain words nor
#: single spaces hold.
SPACE, VARIABLE, MARK = r"[\x09-\x0D\x20]+", r"(?<![^ ])[^ ]*?(?:[0-9@]|://)[^ ]*+", "<*>"
SPECIAL = r"[0-9@\x09-\x0D]|://|  "
_WORD = 32


def _masked(line: Column) -> Column:
    """The replacements run only on lines that have something to replace; one plain search finds these."""
    made = F.regexp_replace(F.trim(F.regexp_replace(line, SPACE, " ")), VARIABLE, MARK)
    return F.when(line.rlike(SPECIAL), made).otherwise(F.trim(line))


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _hashes(line: Column) -> list[Column]:
    """Two independent hashes."""
    return [F.xxhash64(line), F.xxhash64(F.lit("b"), line)]


def _constants(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t != MARK))


def _exploded(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, version, line, words) of every line."""
    rows = docs.where(F.col(text).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", F.xxhash64(text).alias("version"), F.split(text, "\n", -1).alias("lines"))  # before the lines part, else for each of them
    return rows.select("doc_id", "version", F.posexplode("lines").alias("line", "words"))


def _lines(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """(doc_id, version, line, leaf, a, b, constants) of every line; a is null where it has no token."""
    words = F.col("words")
    rows = _exploded(docs, text).select("doc_id", "version", "line", _masked(words).alias("words"))
    wide = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    marks = (F.length(wide) - F.length(F.replace(wide, F.lit(f" {MARK} "), F.lit("")))) / (len(MARK) + 2)
    rows = rows.select("doc_id", "version", "line", "words", _tokens(words).alias("n"), F.when(words.contains(MARK), marks.cast("int")).otherwise(0).alias("marks"))
    a, b = _hashes(words)
    leaf = F.xxhash64("n", F.substring_index(words, " ", depth))
    return rows.select("doc_id", "version", "line", leaf.alias("leaf"), F.when(words != "", a).alias("a"), b.alias("b"), (F.col("n") - F.col("marks")).alias("constants"))


def _numbered(rows: DataFrame, *names: str) -> DataFrame:
    """(doc_id, version, numbers, rows): by document the numbers of its lines that stand in rows as bits, _WORD of them in
    each number, and structs of the named columns in the order of lines."""
    bit = F.pow(F.lit(2.0), F.col("line") % _WORD).cast("long")
    words = rows.groupBy("doc_id", "version", F.floor(F.col("line") / _WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"), *([F.array_sort(F.collect_list(F.struct("line", *names))).alias("rows")] if names else []))
    more = [F.array_sort(F.collect_list(F.struct("word", "rows"))).alias("rows")] if names else []
    found = words.groupBy("doc_id", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"), F.max("word").alias("last"), *more)
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0).cast("long")))
    own = F.transform(F.flatten(F.transform("rows", lambda x: x["rows"])), lambda x: F.struct(*[x[n].alias(n) for n in names]))
    return found.select("doc_id", "version", dense.alias("numbers"), *([own.alias("rows")] if names else []))


def _has(numbers: str, i: Column) -> Column:
    return F.coalesce(F.getbit(F.get(numbers, F.floor(i / _WORD).cast("int")), i % _WORD), F.lit(0)) == 1


def _generalised(docs: DataFrame, lines: DataFrame, text: str, depth: int, share: int, similarity: int) -> DataFrame:
    """(a, b, ta, tb, kept): lines whose template is another line, its hashes and number of constant tokens."""
    groups = session.written(lines.groupBy("leaf", "a", "b").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("doc_id")), "groups")
    leaves = groups.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("total"))
    leaves = session.written(leaves.where((F.col("kinds") > 1) & (F.col("total") > share)).select("leaf", "total"), "leaves", groups.count() // 2)
    members = session.written(groups.join(leaves, "leaf"), "members")
    most = members.count()
    # by document too, so that the many places of a hot line don't meet
    places = lines.select("doc_id", "version", "line", "a", "b").join(members.hint("merge"), ["a", "b", "doc_id"])
    places = places.groupBy("leaf", "a", "b", "doc_id", "docs", "total").agg(F.min(F.struct("version", "line")).alias("at"))
    places = session.written(places.select("doc_id", "at.version", "at.line", "leaf", "a", "b", "docs", "total"), "places")
    wanted = _numbered(places, "leaf", "a", "b", "docs", "total")
    texts = docs.where(F.col(text).isNotNull()).select("doc_id", F.xxhash64(text).alias("version"), F.col(text).alias("text")).join(wanted.hint("merge"), ["doc_id", "version"])
    picked = F.filter(F.split("text", "\n", -1), lambda x, i: _has("numbers", i))  # in the order of rows
    spelled = texts.select(F.explode(F.arrays_zip(picked.alias("line"), F.col("rows").alias("m"))).alias("x")).select("x.m.*", F.split(_masked(F.col("x.line")), " ").alias("tokens"))
    spelled = session.written(spelled.where(F.size("tokens") > depth).dropDuplicates(["a", "b"]), "spelled")  # rows may be repeated
    rest = F.slice("tokens", depth + 1, F.greatest(F.size("tokens") - depth, F.lit(0)))
    values = spelled.select("leaf", "docs", "total", F.posexplode(rest).alias("place", "token")).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n"), F.first("total").alias("total"))
    constant = F.when(F.col("n") * share >= F.col("total"), F.col("token"))
    by_place = values.groupBy("leaf", "place").agg(F.collect_list(constant).alias("tokens"))  # `share` tokens at most
    known = session.written(by_place.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tokens"))), lambda x: x["tokens"]).alias("known")), "constants", most // 2)
    lead = F.slice("tokens", 1, depth)
    made = spelled.join(known, "leaf").select("a", "b", F.concat(lead, F.zip_with(rest, "known", lambda t, c: F.when(F.array_contains(c, t), t).otherwise(MARK))).alias("tokens"))
    made = made.select("a", "b", F.array_join("tokens", " ").alias("template"), _constants(F.col("tokens")).alias("kept"), F.size("tokens").alias("n"))
    ta, tb = _hashes(F.col("template"))
    out = made.where(100 * F.col("kept") >= similarity * F.col("n")).select("a", "b", ta.alias("ta"), tb.alias("tb"), "kept").where("a != ta or b != tb")
    out = session.written(out, "generalised", most)
    session.discard(groups, leaves, members, places, spelled, known)
    return out


def recurring(docs: DataFrame, text: str = "text", depth: int = DEPTH, share: int = SHARE, similarity: int = SIMILARITY, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, version, dropped): the lines to drop as bits, _WORD of them in each number, by document and hash of its text."""
    lines = session.written(_lines(docs, text, depth), "lines")
    some = lines.where("a is not null")
    other = _generalised(docs, some, text, depth, share, similarity)
    named = some.join(other.hint("merge"), ["a", "b"], "left").select("doc_id", F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), F.coalesce("kept", "constants").alias("constants"))
    templates = named.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("docs"), F.min("constants").alias("constants"))
    need = least_docs * F.pow(F.lit(SHORT), F.greatest(LEAST_TOKENS - F.col("constants"), F.lit(0)))
    # written, so that both sides of the join are shuffled for it and a hot template's lines can be split
    templates = session.written(templates.where(F.col("docs") >= need).select("a", "b", "first"), "templates")
    own = templates.join(other, ["a", "b"], "left_anti").unionByName(other.select("a", "b", F.col("ta"), F.col("tb")).join(templates.select(F.col("a").alias("ta"), F.col("b").alias("tb"), "first"), ["ta", "tb"]).select("a", "b", "first"))
    hit = some.select("doc_id", "version", "line", "a", "b").join(own.hint("merge"), ["a", "b"]).where(F.col("doc_id") > F.col("first"))
    return _numbered(hit).select("doc_id", "version", F.col("numbers").alias("dropped"))


def deduplicate(docs: DataFrame, text: str = "text", counts: bool = False, **options) -> DataFrame:
    """docs without dropped lines; with counts also n_lines and n_dropped."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped") or not counts]
    own, has = docs.select([F.col(f"`{c}`") for c in names]), "__dropped"
    marks = recurring(own, text, **options).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("dropped").alias(has))
    joined = own.join(marks, (own["doc_id"] == F.col("__id")) & (F.xxhash64(own[text]) == F.col("__version")), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~_has(has, i)), "\n")
    new = F.when(F.col(has).isNull(), F.col(text)).otherwise(kept)
    out = [new.alias(c) if c == text else F.col(f"`{c}`") for c in names]
    if counts:
        number = F.aggregate(has, F.lit(0), lambda s, w: s + F.bit_count(w))
        out.append(F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"))
        out.append(F.coalesce(number, F.lit(0)).cast("long").alias("n_dropped"))
    return joined.select(out)
