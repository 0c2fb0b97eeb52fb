"""Queries that must not leave out rows or parts of texts."""

from quirespark.plans import registry


def tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_repeated_edges_counts_every_edge(spark, tmp_path):
    """Edges below the threshold are counted as well."""
    lines = ["Head 1"] * 4 + ["Often"] * 3 + [f"once {chr(97 + i)}" for i in range(13)]
    data = [(i, f"{line}\nbody\nend {chr(97 + i)}", "s") for i, line in enumerate(lines)]
    found = registry.QUERIES["repeated_edges"](spark, tables(spark, tmp_path, documents=(data, "doc_id long, text string, source string"))).collect()
    assert len(found) == 2 + 13 + 20 and {(r.n, r.pages, r.repeated) for r in found} == {(4, 20, True), (3, 20, False), (1, 20, False)}


def test_glossary_match_takes_whole_items(spark, tmp_path):
    """Words and neighbours anywhere in an item are terms, also of an item without two neighbours."""
    items = [(1, "Of Alpha, beta gamma. Later Jay  Gatsby came"), (2, "x, Lonely")]
    docs = [(1, "jay\ngatsbys met a LONELY gamma", "d"), (2, "the Gatsby house; beta, gamma", "d")]
    folder = tables(spark, tmp_path, benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string, source string"))
    found = {(r.term, r.docs, r.score) for r in registry.QUERIES["glossary_match"](spark, folder).collect()}
    assert found == {("Jay", 1, 3), ("Gatsby", 2, 3), ("Jay Gatsby", 2, 3), ("Gatsby came", 1, 2), ("Lonely", 1, 3), ("gamma", 2, 3), ("beta", 1, 3)}
