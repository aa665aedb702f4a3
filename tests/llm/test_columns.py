"""Columns of callers that bear the names of what operators make, in any case."""

import corpus_pipeline
from pyspark.sql import functions as F

from lumenark.llm import html_extract, language_id, line_dedup, quality_rules

TEXT = "The valley was quiet that night and it was not until the morning that she saw what had been done to the house and to all of the trees around it"


def documents(spark, n=40):
    words = lambda i: f"{TEXT} number{i} and word{i * 7} of story{i * 13}."
    rows = [(i, words(i), "en" if i % 2 else "fr", f"s{i % 3}", len(words(i))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("Score", "kept", "N_LINES", "Shrunk_Rate", "lang_pred", "a.b")})


def test_operators_replace_clashing_columns_in_any_case(spark, tmp_path):
    docs = documents(spark)
    plain = docs.drop("a.b")
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    pages = plain.select("doc_id", F.col("text").alias("html"), F.lit(1).alias("Text"), F.lit(2).alias("N_Chars"))
    for name, out in {"rules": quality_rules.judge(plain), "language": language_id.identify(plain, model), "lines": line_dedup.dedup_lines(plain), "pages": html_extract.extract(pages)}.items():
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        out.write.parquet(str(tmp_path / name))
        assert spark.read.parquet(str(tmp_path / name)).count() == 40


def test_stages_give_callers_columns_back(spark, tmp_path):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        for r in spark.read.parquet(str(tmp_path / name.replace(" ", "-"))).collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in ("Score", "kept", "N_LINES", "Shrunk_Rate", "lang_pred", "a.b")), name
