from __future__ import annotations

from pyspark.sql import functions as F

from lexiframe.functions.normalize import normalize_text
from lexiframe.functions.sqlfuncs import register_functions
from lexiframe.operators import hooks as H
from lexiframe.plans import toys


def test_failing_rows_become_nulls(spark):
    rows = spark.createDataFrame([(1, "abcde"), (2, "aeio")], "doc_id long, text string")
    got = H.safe_apply(rows, toys.model, toys.row, "doc_id", "text", {"vowels": "long"})
    assert {r.doc_id: r.vowels for r in got.collect()} == {1: None, 2: 4}


def test_batches_have_the_asked_size(spark):
    def sizes(model, batch):
        return batch[["id"]].assign(n=len(batch))

    rows = spark.range(0, 25, 1, 1)
    got = H.annotate_with(rows, dict, sizes, "id long, n long", name="sizes", batch_rows=10)
    assert [r.n for r in got.orderBy("id").collect()] == [10] * 20 + [5] * 5


def test_embedder(spark):
    embed = H.embed_with(toys.model, toys.embed)
    row = spark.createDataFrame([("banana",)], "text string").select(embed(F.col("text"))).first()
    assert row[0] == [3.0, 0.0, 0.0, 0.0, 0.0]


def test_sql_functions_agree_with_columns(spark):
    names = register_functions(spark)
    assert {"normalize_text", "strip_html", "expand_chat_words", "is_valid_header", "cosine"} <= set(names)
    texts = ["BTW <b>it's</b> 10:30 \U0001f600 at www.a.b   now_here 'x'", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(normalize_text(F.col("t")).alias("a"), F.expr("normalize_text(t)").alias("b"))
    assert all(r.a == r.b for r in both.collect())
    row = spark.sql(
        "SELECT is_valid_header(array('Id', 'Full name', 'City')) AS h, is_valid_header(array('Id', 'x')) AS n,"
        " round(cosine(array(float(1), float(0)), array(float(1), float(1))), 4) AS c"
    ).first()
    assert (row.h, row.n, row.c) == (True, False, 0.7071)


def test_sql_functions_rewrite_only_what_needs_it(spark):
    register_functions(spark)
    texts = ["a  b", " a\tb ", "a b c", "\n", "", None, "a\u00a0 b\u2003\u2003c", "x \x1f\ny", "h\u00e9 \x0b\u3000 z ", "a:b_c \"d' e"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    names = ["collapse_ws", "strip_html", "strip_urls", "expand_contractions", "expand_chat_words", "demojize", "normalize_text"]
    out = rows.select("t", *(F.expr(f"{n}(t)").alias(n) for n in names), normalize_text(F.col("t")).alias("column"))
    for r in out.collect():
        squeezed = None if r.t is None else " ".join(r.t.split())
        assert (r.collapse_ws, r.expand_chat_words) == (squeezed, squeezed)
        assert (r.strip_html, r.strip_urls, r.expand_contractions, r.demojize) == (r.t, r.t, r.t, r.t)
        assert r.normalize_text == r.column
    for name in ("strip_html", "strip_urls", "expand_contractions"):
        assert "contains" in rows.select(F.expr(f"{name}(t)"))._jdf.queryExecution().optimizedPlan().toString().lower()
