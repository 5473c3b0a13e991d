"""Repeats of lines that are too short for fuzzy links."""

from motley.llm.queries import op6_fuzzy_lines


def test_short_repeats_go(spark, tmp_path):
    rows = [(1, "Read more\n日本語の行\n--\nonly here"), (2, "read MORE!\nread most\n日本語の行\n--"), (3, "日本語の行")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op6_fuzzy_lines(spark, str(tmp_path)).collect())
    assert got == [(1, rows[0][1], 0), (2, "read most\n--", 2), (3, "", 1)]
