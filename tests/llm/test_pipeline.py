import duckdb

import corpus_pipeline
from manifold_spark.llm import jaccard_join

SF = "/root/testdata/sf0.001"

#: From the purpose: of each line with something in it only the first place, by document and line, stays.
EVERY_LINE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), placed AS (
  SELECT *, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') = '' AS blank, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS n FROM lines
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE blank OR n = 1), '') AS text FROM placed GROUP BY doc_id
"""


def test_lines_leave_one_copy_of_each_line(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, "e\na"), (5, "x\n\n\ny")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert got == {1: f"a\n{long}\nb", 2: "c\nd", 3: "", 4: "e", 5: "x\n\n\ny"}


def test_lines_equal_sql_of_the_purpose(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SF).collect()} == dict(con.execute(EVERY_LINE).fetchall())


def test_one_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["z"])
    text, other, third = " ".join(base), "one text of its own that nobody else has", "alpha beta gamma delta epsilon zeta"
    rows = [(1, text), (1, text), (5, near), (5, other), (None, near), (None, text), (None, third), (None, third), (None, third), (7, third.upper()), (8, None), (9, ""), (9, ""), (None, "left " * 9 + "alone"), (None, "left " * 9 + "alone")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, text), (5, other), (7, third.upper()), (8, None), (9, ""), (9, ""), (None, "left " * 9 + "alone")], key=str)
    # a null id is placed with its group, also where no other row has its very text
    ids = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(spark.createDataFrame([(4, text), (None, near)], "doc_id long, text string")).collect()}
    assert ids == {(4, 56, 4), (None, 56, 4)}


def test_columns_with_the_operators_own_names(spark):
    """Columns may have any name that an operator uses itself; they come out as they went in."""
    own = ["probability", "_lang", "_text", "_key", "_gone", "_id", "_null", "row", "runs", "gone", "key1", "kept", "n", "class", "h", "n_chars"]
    base = [(i, " ".join(f"w{(i * 7 + j * (j + i)) % 97}" for j in range(40)) + f"\nshared line\nline {i}", "en", f"s{i % 3}") for i in range(30)]
    docs = spark.createDataFrame([(*r, *range(len(own))) for r in [*base, base[0], (None, None, None, None)]], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in own))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert [r[c] for c in own[:-1]] == list(range(len(own) - 1)), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_run_is_its_stages(spark):
    """run() by hand: each stage on what the one before kept; ids only leave, and the last stage encodes what is left."""
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= left and len(set(ids)) == len(ids)
        left = set(ids)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == texts.keys() and got
    assert all(got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for d, t in texts.items())
