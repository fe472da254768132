"""Every core query against its SQL on the smallest tables."""

import duckdb
import pytest
from compare import same

from millrace.plans import governance, more  # noqa: F401  (add their queries)
from millrace.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE_SQL:
        same(rows, df.columns, duck.execute(ORACLE_SQL[name]))
    else:
        assert rows


def against_sql(spark, folder, name, documents):
    """The query against its SQL on documents of these (doc_id, text)."""
    spark.createDataFrame([(n, text, "en", "src1", len(text or "")) for n, text in documents], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(documents[0][0], 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    same(df.collect(), df.columns, con.execute(ORACLE_SQL[name]))


def test_contextual_ingest_of_odd_documents(spark, tmp_path):
    # texts without a token, and ids whose first eight digits are the same
    against_sql(spark, tmp_path, "i3_contextual_ingest", [(1, "É."), (3, "— …"), (4, "##\n\nñ"), (5, " \n"), (6, None), (7, ""), (8, "Re."), (9, "one two"), (123456786, "a"), (123456787, "b"), (123456790, "c")])


def test_contextual_rows_of_odd_documents(spark, tmp_path):
    # chunks in which no word counts, which are less sure than the rest of their text or deny what it says; no token; long ids
    texts = ("Re.", "the the of", "You may go. " + "alpha beta " * 300, "denied " + "gamma " * 400 + "approved", "É.", "alpha " * 200 + "of " * 200)
    against_sql(spark, tmp_path, "i9_contextual_rows", [(4 * i + 2, t) for i, t in enumerate(texts)] + [(1, "one"), (5, "ñ"), (7, None), (123456786, "a"), (123456787, "b"), (123456790, "c")])
