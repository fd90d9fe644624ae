"""Line dedup by winnowing, in DataFrame functions alone.

A document is the sequence of its lines with something in them. Of every
``window`` lines in a row the least line hash is selected as a fingerprint, the
first of equals, so two equal runs of ``window`` lines or more share one, and
most windows in a row select the same place. Selected places are joined by their
hash: fingerprints that stand at one place only are dropped. A place that is left
is extended to both sides, to each run of ``window`` lines that selected it, and
runs are compared by two 64-bit hashes of their lines. A longer repeat is a chain
of such runs, so taking all of them together extends each match both ways as far
as it goes. The first run, in order of doc_id and place, stays; the lines of
later ones are deleted.

A line of ``long_words`` words or more is a run of its own as well, and its hash a
fingerprint. So with three and ten, as the query op9 has them, every repeat of
three lines or more and of every line of ten words or more is found, also in
documents of one or two lines; of a repeated passage of over 50 words in whole
lines at most one line of under ten words stays. What stays by definition are
lines of fewer words that repeat alone or in pairs. With a window of one, as the
pipeline has it, every line is a run, so of each line with something in it one
copy is left in the whole table.

Nulls: a null text stays null. Blank lines are no part of runs and stay. Rows
with the same doc_id and text count as one document and are changed alike. A null
doc_id sorts first. All columns stay, whatever their names; ``text`` is replaced,
and ``n_chars`` too where there is one. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_counted, materialize, packed, unpacked

_FULL = r"[^ \t\x0b\x0c\r]"
_WORD = r"[^\x20\x09-\x0D]+"
#: Lines of so many words are runs of their own.
LONG_WORDS = 10
#: A document is told by two hashes of doc_id and text.
KEY = ["key1", "key2"]


def _keys(doc_id: Column, text: Column) -> list[Column]:
    id_ = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return [F.xxhash64(id_, doc_id.isNull(), text).alias("key1"), F.xxhash64(text, F.lit(1), doc_id.isNull(), id_).alias("key2")]


def _is_long(line: Column, window: int, long_words: int) -> Column:
    # with a window of one every line is a run already
    return F.lit(False) if window == 1 else F.regexp_count(line, F.lit(_WORD)) >= long_words


def windows_of(docs: DataFrame, window: int, long_words: int = LONG_WORDS) -> DataFrame:
    """One row a run: doc_id, the document's keys, the number of its first line, its lines (``window``, or 1 for a long line), its names, its fingerprint, and whether it is the first run to select that."""
    full = F.filter(F.split("text", "\n"), lambda x: x.rlike(_FULL))
    lines = F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), _is_long(x, window, long_words).alias("long")))
    listed = docs.where("text is not null").select("doc_id", *_keys(F.col("doc_id"), F.col("text")), lines.alias("lines"))

    def run(at: Column) -> Column:
        part = F.slice("lines", at, window)
        h = F.transform(part, lambda x: x["h"])
        least = F.array_min(h)
        place = at + F.array_position(h, least) - 1
        return F.struct(at.alias("run"), least.alias("fingerprint"), place.cast("int").alias("place"), F.xxhash64(h).alias("name1"), F.xxhash64(F.transform(part, lambda x: x["g"])).alias("name2"))

    last = F.size("lines") - (window - 1)
    runs = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), run)).otherwise(F.array())
    selects = F.transform(F.col("runs"), lambda r, i: F.struct(r["run"].alias("run"), F.lit(window).alias("size"), r["fingerprint"].alias("fingerprint"), r["name1"].alias("name1"), r["name2"].alias("name2"), ((i == 0) | (r["place"] != F.get("runs", i - 1)["place"])).alias("selects")))
    alone = F.filter(F.transform("lines", lambda x, i: F.when(x["long"], F.struct((i + 1).alias("run"), F.lit(1).alias("size"), x["h"].alias("fingerprint"), F.xxhash64(F.array(x["h"])).alias("name1"), F.xxhash64(F.array(x["g"])).alias("name2"), F.lit(True).alias("selects")))), lambda r: r.isNotNull())
    return listed.select("doc_id", *KEY, "lines", runs.alias("runs")).select("doc_id", *KEY, F.inline(F.concat(selects, alone)))


def repeated_runs(docs: DataFrame, window: int = 3, long_words: int = LONG_WORDS) -> DataFrame:
    """The keys of a document and, of each run of its lines that stands before, the first line's number and the number of lines."""
    runs = materialize(windows_of(docs, window, long_words), "runs")
    # only selected places are counted; rows alike in doc_id and text are told apart later, as equal places
    places = runs.groupBy("size", "fingerprint").agg(F.count_if("selects").alias("places"), F.count("*").alias("n")).where("places > 1")
    met = join_counted(runs, materialize(places.drop("places"), "fingerprints"), ["size", "fingerprint"]).select("doc_id", *KEY, "run", "size", "name1", "name2")
    met = materialize(met, "met")
    place = F.struct("doc_id", *KEY, "run")
    # names of runs of one line and of several are of other arrays of hashes, so they don't meet
    first = met.groupBy("name1", "name2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last")
    later = join_counted(met, materialize(first, "first-runs"), ["name1", "name2"]).where(place != F.col("first"))
    return later.select(*KEY, "run", "size").distinct()


def _cleaned(docs: DataFrame, window: int, long_words: int) -> DataFrame:
    """row (the input), text, and runs (first lines and sizes of runs that go, null where none does)."""
    doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
    given = docs.select(packed(docs), doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = repeated_runs(given, window, long_words).groupBy(*KEY).agg(F.collect_set(F.struct("run", "size")).alias("runs"))
    return given.select("row", "text", *_keys(F.col("doc_id"), F.col("text"))).join(gone, KEY, "left")


def _gone() -> Column:
    """The numbers of the lines that go."""
    numbered = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike(_FULL), i)), lambda i: i.isNotNull())
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["run"] - 1, r["run"] + r["size"] - 2))))
    return F.transform(covered, lambda p: F.get(numbered, p))


def _kept_text() -> Column:
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(text)


def dedup_lines(docs: DataFrame, window: int = 3, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents without the lines of later repeated runs; all columns of the input."""
    changed = _cleaned(docs, window, long_words).withColumn("gone", _gone()).withColumn("kept", _kept_text())
    out = changed.withColumn("row", F.col("row").withField("text", F.col("kept").cast(docs.schema["text"].dataType)))
    if "n_chars" in docs.columns:
        n = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.char_length("kept").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("row", F.col("row").withField("n_chars", n))
    return unpacked(out, docs.columns)


def report(docs: DataFrame, window: int = 3, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed and the md5 of the text that is left."""
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    found = _cleaned(docs.select("doc_id", "text"), window, long_words).withColumn("gone", _gone())
    return found.select("row.doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.md5(_kept_text()).alias("text_md5"))


#: The same by definition: a line goes if some run of three lines that holds it equals a run before, or if it has ten words and equals a line before.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), full_lines AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM lines WHERE trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') <> ''
), runs AS (
  SELECT doc_id, p, 3 AS size, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS run FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY p)
  UNION ALL SELECT doc_id, p, 1, line FROM full_lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 10
), ranked AS (
  SELECT doc_id, p, size, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS n FROM runs WHERE run IS NOT NULL
), gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM ranked r JOIN full_lines f ON f.doc_id = r.doc_id AND f.p BETWEEN r.p AND r.p + r.size - 1 WHERE r.n > 1
), cleaned AS (
  SELECT l.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS kept, count(*) AS n_lines
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, md5(kept) AS text_md5 FROM cleaned
"""
