r"""Line deduplication with a deletion-neighbourhood join, in DataFrame functions only.

A line is its words [^\x20\x09\x0B-\x0D]+ between line feeds; lines without words are kept and count for nothing. A line goes if
an earlier line (smaller doc_id, then smaller line number) has the same words, or if both have at least `fuzzy_words` words
and one inserted, deleted or replaced word makes them equal (with five words or more, four fifths agree). Lines are judged
on the input, not on what is left. `edits` is the bound: 1, or 0 for equal lines alone; larger ones are refused, as a line's
neighbourhood would then grow with the square of its words.

1. Equal lines are grouped by a 128-bit hash; each group keeps its earliest place.
2. Two lines one edit apart share the first or the last half of the shorter one. Lines whose halves, with their length,
   occur in no other line are out; this loses nothing.
3. Every other line emits its deletion neighbourhood: the line itself and each variant with one word left out, as hashed
   keys. A key sums hashes of words with their places, as running sums, so that a line's variants cost time in proportion to its
   words, and lines with the same words in another order have other keys. Variants that lack the same word number are a
   replacement apart; a variant and a whole line are an insertion apart.
4. Of each key only the earliest line matters; a line and the earliest of its keys are joined, and the edit is verified on
   the words. Where the earliest is a false friend (equal hashes of other words), all earlier lines of that key are verified instead.

Texts meet lists of line numbers by sort and merge at every size, and Spark splits keys that many rows share. No pairs within a
key are formed (but for such collisions), so a line in a third of all documents costs what others cost.

Edge cases: a null text has no lines and stays null; an empty text stays empty; rows that repeat an id and text are one
document; rows of one id with other texts are told apart by the text's hash, and their lines are ordered by number, then by
that hash; a null id counts as larger than any other, and rows without one are ordered by the text's hash; an empty table
gives an empty result; extra columns of any name pass through.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyframe.llm.shared import cut, table

FUZZY_WORDS = 5
#: A line's place in the order of all lines is a number of 38 digits, which keeps aggregation in hash tables: the id (rows without
#: one follow, told apart by their text's hash), and 62 bits for the line's number and its text's hash.
_REST, _AFTER = 1 << 62, 1 << 63
#: (lines below, bits for the hash): a line number needs few bits in most texts; two bits name the row of this list.
_SIZES = [(1 << 8, 52), (1 << 16, 44), (1 << 24, 36), (1 << 31, 29)]
#: The bits of the hash that all of these have.
_LAST = (1 << 29) - 1


def _id(id_col: str, key: str) -> Column:
    return F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(Decimal(_AFTER)).cast("decimal(20,0)") + F.pmod(F.col(key), F.lit(_AFTER - 1)).cast("decimal(20,0)"))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, "[ \\t\\x0B\\f\\r]+"), lambda w: w != "")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    out = docs.select(F.col(id_col).cast("long").alias("own"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return out.select(_id("own", "key").alias("id"), "key", "text")


def _lines(texts: DataFrame) -> DataFrame:
    """A row a line with words: joined (its words, one space between them), and two hashes."""
    # Only in texts with other white space than single spaces between words are lines taken apart.
    odd = F.contains("text", F.lit("  "))
    for blank in ("\t", "\x0b", "\f", "\r"):
        odd |= F.contains("text", F.lit(blank))
    out = texts.select("id", "key", odd.alias("odd"), F.split("text", "\n", -1).alias("all"))  # once a text, before its lines
    out = out.select("id", "key", "odd", F.posexplode("all").alias("line", "raw"))
    out = out.withColumn("joined", F.when(F.col("odd") | F.col("raw").startswith(" ") | F.col("raw").endswith(" "), F.array_join(_words(F.col("raw")), " ")).otherwise(F.col("raw"))).filter("joined != ''")
    return out.select("id", "key", "line", "joined", F.xxhash64("joined").alias("h1"), F.xxhash64(F.lit(1), "joined").alias("h2"))


def _ref() -> Column:
    line, out = F.col("line").cast("long"), F.lit(None).cast("long")
    for k, (below, bits) in reversed(list(enumerate(_SIZES))):
        low = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
        number = F.lit(k << 60) + F.shiftleft(line, bits) + low
        out = number if k == len(_SIZES) - 1 else F.when(line < below, number).otherwise(out)
    return (F.col("id") * F.lit(_REST).cast("decimal(19,0)") + out.cast("decimal(19,0)")).cast("decimal(38,0)")


def _place(ref: str) -> list[Column]:
    """What a line's place tells: the id, the line's number, and the last bits of its text's hash."""
    rest = f"CAST(pmod({ref}, CAST({_REST} AS decimal(38,0))) AS bigint)"
    # What is left after the remainder is a multiple: the division is exact.
    own = f"CAST(({ref} - pmod({ref}, CAST({_REST} AS decimal(38,0)))) / CAST({_REST} AS decimal(38,0)) AS decimal(20,0))"
    line = f"CASE shiftrightunsigned({rest}, 60) " + " ".join(f"WHEN {k} THEN shiftrightunsigned({rest} & {(1 << 60) - 1}, {bits})" for k, (_, bits) in enumerate(_SIZES)) + " END"
    return [F.expr(own).alias("id"), F.expr(f"CAST({line} AS int)").alias("line"), F.expr(f"{rest} & {_LAST}").alias("last")]


def _halves() -> list[Column]:
    """For each size of the shorter line of a pair, the first and the last half of it."""
    out = []
    for less in (0, 1):
        size = F.col("n") - less
        half = F.floor(size / 2).cast("int")
        out += [F.xxhash64(size, F.lit(0), F.call_function("substring_index", F.col("joined"), F.lit(" "), half)), F.xxhash64(size, F.lit(1), F.call_function("substring_index", F.col("joined"), F.lit(" "), -half))]
    return out


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """(ref, at, variant): at is the number of the word left out, 0 for the line itself."""
    # Hashes of each word with its place, and with the place that it has when a word before it is left out, in two parts of 36
    # bits, whose sums fit a long. A variant's sum is that of the words before, at their places, and of those behind, at the others.
    low = F.lit((1 << 36) - 1)
    parts = {"1": lambda g: F.shiftrightunsigned(g, 28), "2": lambda g: g.bitwiseAND(low)}
    out = lines.select("ref", "n", F.transform("words", lambda w, i: F.xxhash64(w, i)).alias("g"), F.transform("words", lambda w, i: F.xxhash64(w, i - 1)).alias("h"))
    for name, part in parts.items():
        out = out.withColumn(f"all{name}", F.aggregate(F.transform("h", part), F.lit(0).cast("long"), lambda s, x: s + x))
    out = out.repartition("ref").select("ref", "n", "all1", "all2", F.posexplode(F.arrays_zip("g", "h")).alias("at", "w"))
    running = Window.partitionBy("ref").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(part(F.col(f"w.{c}"))).over(running).alias(f"{c}{name}") for name, part in parts.items() for c in ("g", "h")]
    own = [part(F.col("w.g")).alias(f"own{name}") for name, part in parts.items()]
    out = out.select("ref", "n", "at", "all1", "all2", *own, *sums)
    left = F.struct((F.col("at") + 1).alias("at"), (F.col("n") - 1).alias("n"), *[(F.col(f"g{k}") - F.col(f"own{k}") + F.col(f"all{k}") - F.col(f"h{k}")).alias(f"s{k}") for k in parts])
    whole = F.struct(F.lit(0).alias("at"), F.col("n"), *[F.col(f"g{k}").alias(f"s{k}") for k in parts])
    out = out.select("ref", F.explode(F.when(F.col("at") == F.col("n") - 1, F.array(left, whole)).otherwise(F.array(left))).alias("v"))
    return out.select("ref", "v.at", F.xxhash64("v.n", "v.s1", "v.s2").alias("variant"))


def _less(words: str, at: str) -> str:
    return f"CASE WHEN {at} = 0 THEN {words} ELSE concat(slice({words}, 1, {at} - 1), slice({words}, {at} + 1, size({words}))) END"


def _verified(links: DataFrame, words: DataFrame) -> DataFrame:
    """Links (ref, at, other, other_at), with `same`: whether the words without the words named are the same."""
    a = words.select("ref", F.col("words").alias("wa"))
    b = words.select(F.col("ref").alias("other"), F.col("words").alias("wb"))
    return links.join(a, "ref").join(b, "other").withColumn("same", F.expr(f"{_less('wa', 'at')} = {_less('wb', 'other_at')}")).drop("wa", "wb")


def _near(distinct: DataFrame, fuzzy_words: int, texts: DataFrame) -> DataFrame:
    """(ref) of the distinct lines that an earlier one is one edit from."""
    long = distinct.filter(F.col("n") >= fuzzy_words).select("h1", "first", F.explode(F.array("k1", "k2", "k3", "k4")).alias("half"))
    shared = long.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a != b").select("half")
    chosen = cut(long.join(cut(shared, "halves").hint("merge"), "half").select(F.col("first").alias("ref")).distinct(), "chosen")
    # Words are read again for the chosen lines alone: texts meet lists of places.
    places = chosen.select("ref", *_place("ref")).groupBy("id", "last").agg(F.collect_list(F.struct("line", "ref")).alias("places"))
    found = texts.withColumn("last", F.col("key").bitwiseAND(F.lit(_LAST))).join(cut(places, "places").hint("merge"), ["id", "last"])
    # A text is taken apart once (the explode keeps the split from being merged into what follows), and no row carries all of it.
    found = found.select("id", "key", "places", F.explode(F.array(F.split("text", "\n", -1))).alias("all"))
    chosen_lines = F.transform("places", lambda p: F.struct(p["ref"].alias("ref"), p["line"].alias("line"), F.get("all", p["line"]).alias("raw")))
    found = found.select("id", "key", F.explode(chosen_lines).alias("p")).select("id", "key", "p.ref", "p.line", "p.raw")
    # Texts of one id may share the last bits; a place holds more of them.
    words = found.filter(_ref() == F.col("ref")).select("ref", _words(F.col("raw")).alias("words")).withColumn("n", F.size("words"))
    words = cut(words.dropDuplicates(["ref"]), "words")

    rows = _neighbourhood(words)
    earliest = rows.groupBy("variant", "at").agg(F.min("ref").alias("low"), F.max("ref").alias("high"))
    several = earliest.groupBy("variant").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.min(F.when(F.col("at") == 0, F.col("low"))).alias("whole"), F.min(F.when(F.col("at") > 0, F.col("low"))).alias("less"), F.min_by("at", F.when(F.col("at") > 0, F.col("low"))).alias("less_at"))
    several = cut(several.filter("a != b").select("variant", "whole", "less", "less_at"), "several")
    rows = cut(rows.join(several.hint("merge"), "variant"), "rows")
    alike = cut(rows.groupBy("variant", "at").agg(F.min("ref").alias("low")), "alike")
    rows = rows.join(alike, ["variant", "at"])
    other = F.array(
        F.when(F.col("at") > 0, F.struct(F.col("low").alias("other"), F.col("at").alias("other_at"))),
        F.when(F.col("at") > 0, F.struct(F.col("whole").alias("other"), F.lit(0).alias("other_at"))),
        F.when(F.col("at") == 0, F.struct(F.col("less").alias("other"), F.col("less_at").alias("other_at"))),
    )
    links = rows.select("ref", "at", "variant", F.explode(other).alias("o")).select("ref", "at", "variant", "o.other", "o.other_at").filter("other < ref")
    links = cut(_verified(links, words), "links")
    # Where the earliest line of a key has other words after all, every earlier line of that key is looked at.
    missed = links.filter("not same").select("ref", "at", "variant").distinct()
    if missed.limit(1).count():
        every = _neighbourhood(words).select("variant", F.col("ref").alias("other"), F.col("at").alias("other_at"))
        again = missed.join(every, "variant").filter("other < ref and ((at > 0 and (other_at = at or other_at = 0)) or (at = 0 and other_at > 0))")
        links = links.select("ref", "same").union(_verified(again.drop("variant"), words).select("ref", "same"))
    return links.filter("same").select(F.col("ref").alias("first")).distinct()


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fuzzy_words: int = FUZZY_WORDS, edits: int = 1) -> DataFrame:
    """(id, key, removed): numbers of the lines to remove, for each text with any; id as it orders the texts, key is xxhash64(text)."""
    if edits not in (0, 1):
        raise ValueError(f"edits must be 0 or 1, not {edits}")
    texts = _texts(docs, id_col, text_col)
    lines = _lines(texts)
    sized = lines.withColumn("n", F.octet_length("joined") - F.octet_length(F.replace("joined", F.lit(" "), F.lit(""))) + 1)
    distinct = sized.select("h1", "h2", "n", _ref().alias("ref"), *[k.alias(f"k{i}") for i, k in enumerate(_halves(), 1)])
    own = [F.min(c).alias(c) for c in ("n", "k1", "k2", "k3", "k4")]
    distinct = distinct.groupBy("h1", "h2").agg(F.min("ref").alias("first"), F.count("*").alias("times"), *own)
    distinct = cut(distinct, "distinct")
    matter = distinct.select("h1", "h2", "first", "times")
    if edits:
        near = cut(_near(distinct, fuzzy_words, texts), "near").withColumn("near", F.lit(True))
        matter = matter.join(near, "first", "left")
    else:
        matter = matter.withColumn("near", F.lit(False))
    matter = cut(matter.filter("near or times > 1").select("h1", "h2", "first", "near"), "matter")
    going = lines.select("h1", "h2", "id", "key", "line").join(matter.hint("merge"), ["h1", "h2"]).filter(F.col("near") | (_ref() != F.col("first")))
    return cut(going.groupBy("id", "key").agg(F.collect_set("line").alias("removed")), "removed")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fuzzy_words: int = FUZZY_WORDS, edits: int = 1) -> DataFrame:
    """Every row of docs with its columns, the text without the lines that go, n_lines and n_removed (in place of columns of
    these names)."""
    removed = removed_lines(docs, id_col=id_col, text_col=text_col, fuzzy_words=fuzzy_words, edits=edits)
    # Own columns go by number: no name of theirs can meet one of ours.
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{text_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(docs.columns)])
    joined = own.withColumn("id", _id("id", "key")).join(removed.hint("merge"), ["id", "key"], "left").withColumn("lines", F.split("text", "\n", -1))
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(rest, lambda i: F.get("lines", i)), "\n"))
    counts = {"n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")), "n_removed": F.when(F.col("removed").isNull(), F.lit(0)).otherwise(F.size("removed"))}
    columns = [text.alias(c) if c == text_col else F.col(f"own{i}").alias(c) for i, c in enumerate(docs.columns) if c not in counts]
    return joined.select(*columns, *[v.cast("long").alias(k) for k, v in counts.items()])


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The same, by comparing deletion variants as word lists.
OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, list_filter(regexp_split_to_array(l[i], '[ \t\x0B\f\r]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)
), words AS (SELECT * FROM lines WHERE len(w) > 0),
firsts AS (SELECT w, min((doc_id, line)) AS f FROM words GROUP BY w),
variants AS (
  SELECT f, w AS v, 0 AS pos FROM firsts WHERE len(w) >= 5
  UNION ALL
  SELECT f, list_concat(w[1:i - 1], w[i + 1:]) AS v, i AS pos FROM firsts, unnest(range(1, len(w) + 1)) AS u(i) WHERE len(w) >= 5
), same AS (
  SELECT f, min(f) OVER (PARTITION BY v, pos) AS g, pos,
         min(CASE WHEN pos = 0 THEN f END) OVER (PARTITION BY v) AS whole, min(CASE WHEN pos > 0 THEN f END) OVER (PARTITION BY v) AS less
  FROM variants
), near AS (SELECT DISTINCT f FROM same WHERE (pos > 0 AND (g < f OR whole < f)) OR (pos = 0 AND less < f)),
removed AS (
  SELECT words.doc_id, words.line FROM words JOIN firsts USING (w) LEFT JOIN near ON near.f = firsts.f
  WHERE near.f IS NOT NULL OR (words.doc_id, words.line) <> firsts.f
)
SELECT l.doc_id, count(*) AS n_lines, count(r.line) AS n_removed,
       sha256(coalesce(string_agg(l.raw, chr(10) ORDER BY l.line) FILTER (WHERE r.line IS NULL), '')) AS kept_sha256
FROM (SELECT doc_id, i - 1 AS line, l[i] AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)) l
LEFT JOIN removed r ON r.doc_id = l.doc_id AND r.line = l.line
GROUP BY l.doc_id
"""


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, without the lines that go; n_chars follows the text."""
    # The table's own columns of the counts' names stay as they are.
    own = {c: f"own {c}" for c in docs.columns if c in ("n_lines", "n_removed")}
    out = dedup_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])
