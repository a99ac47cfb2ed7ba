"""What scopes permit together, and that the hybrid search keeps to scope and trust."""

import oracle

from tesserak.operators import filters
from tesserak.plans import retrieval

SCOPES = [
    ("whole", None), ("empty", ""), ("slash", "x/y/"), ("back", "x\\y"),
    ("nested", "x"), ("nested", "x/y"), ("nested", None),
    ("apart", "x/y"), ("apart", "x/z"), ("alike", "x/y"), ("alike", "x/yz"),
    ("root", "/x"), ("drive", "C:/x"), ("double", "x//y"), ("up", "x/.."), ("dot", "./x"), ("colon", "x/a:b"), ("nul", "x\u0000"), ("bell", "x/\u0007"), ("slashes", "//"),
    ("mixed", "x/y"), ("mixed", "../x"), (None, None),
]


def test_scopes_of_a_vault_hold_together(spark):
    got = {r.vault: r.prefix for r in filters.permitted(spark.createDataFrame(SCOPES, "vault string, prefix string")).where("vault is not null").collect()}
    assert got == {"whole": None, "empty": None, "slash": "x/y", "back": "x/y", "nested": "x/y"}


def test_rows_by_canonical_scopes(spark):
    paths = ["x/y", "x/y/1.md", "x/yz", "x", "a"]
    rows = [(v, p) for v in sorted({v for v, _ in SCOPES if v}) for p in paths]
    scopes = spark.createDataFrame(SCOPES, "vault string, prefix string")
    got = {(r.vault, r.path) for r in filters.scope_filter(spark.createDataFrame(rows, "vault string, path string"), scopes).collect()}
    assert got == {(v, p) for v in ("whole", "empty") for p in paths} | {(v, p) for v in ("slash", "back", "nested") for p in paths[:2]}


def test_scopes_go_to_the_rows(spark, capsys):
    d = oracle.sf("sf0.001")
    retrieval.governed(spark, d).select("doc_id").explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_hybrid_search_returns_trusted_documents(spark):
    d = oracle.sf("sf0.001")
    allowed = {r.doc_id for r in retrieval.scope_trust_filter(spark, d).select("doc_id").collect()}
    found = {r.doc_id for r in retrieval.hybrid_search_rrf(spark, d).select("doc_id").collect()}
    assert found and found <= allowed
