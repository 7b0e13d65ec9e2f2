"""Stories, near copies and their estimates of documents whose keys or whole rows repeat, or are null."""

import duckdb
import pytest

from tidewire.plans import catalogue

BODY = " ".join(f"w{i}" for i in range(40))
ROWS = [
    (7, BODY), (3, BODY), (None, BODY), (9, BODY + " more"), (9, BODY + " more"), (12, "one of its own"), (12, "one of its own"), (12, "another with that key"),
    (None, "known to no key"), (20, " \n"), (21, None), (22, "w0 w1"), (None, None), (23, BODY + " other end"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("rows")
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["story_clusters", "near_dup_pairs"])
def test_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, folder).select(*want.columns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want.fetchall())) and got


def test_estimates_have_a_row_a_pair(spark, folder):
    pairs = catalogue.QUERIES["near_dup_pairs"](spark, folder).collect()
    got = catalogue.QUERIES["minhash_similarity"](spark, folder).collect()
    assert sorted((r.a, r.b, r.jaccard) for r in got) == sorted(map(tuple, pairs)) and all(r.estimate > 0.5 for r in got)
