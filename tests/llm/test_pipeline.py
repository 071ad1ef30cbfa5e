import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomkit.llm import queries
from tests.llm.test_jaccard_join import brute
from tests.llm.test_training_operators import WORDS, leaks_by_hand, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic ones, common lines, near copies and leaks, written as tables; with nulls, repeats and clashing names."""
    r = random.Random(31)
    item = "the quick brown fox jumps over the lazy dog and then it sleeps for three whole hours in the sun"
    rows = []
    for i in range(240):
        body = text(r, r.randint(20, 60))
        if i % 8 == 0:
            body = body + " blorg " + text(r, 3)
        if i % 7 == 0:
            body = f"all rights reserved by the owner\n{body}\nread more here"
        if i % 20 == 11:
            body = rows[i - 1][1] or body
        if i % 30 == 13:
            body = f"{body}. {item}. {text(r, 5)}"
        rows.append((i, body, "en", f"s{i % 5}" if i % 9 else None, len(body)))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (None, "a text of its own without any number", "en", "s2", 3), rows[5], (5, "same number with another text", "en", "s0", 29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("score", F.lit("s")).withColumn("drops", F.lit(1)).withColumn("lines_total", F.lit(2)).withColumn("row", F.lit(3)).withColumn("others", F.lit(4)).withColumn("words", F.lit(5))
    top = str(tmp_path_factory.mktemp("corpus"))
    docs.coalesce(2).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240) if i % 5], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{top}/benchmark.parquet")
    return top, item


def lines_by_hand(rows):
    """Each text without the lines on three sites or more, but for the first of them by (doc_id, place)."""
    seen = {}
    for r in rows:
        for k, x in enumerate((r.text or "").split("\n")):
            if x.strip(" "):
                seen.setdefault(x.strip(" "), []).append((r.source or "", (r.doc_id is not None, r.doc_id or 0, k)))
    bad = {x: min(at for _, at in v) for x, v in seen.items() if len({s for s, _ in v}) >= 3}
    out = []
    for r in rows:
        keep = [x for k, x in enumerate((r.text or "").split("\n")) if x.strip(" ") not in bad or bad[x.strip(" ")] == (r.doc_id is not None, r.doc_id or 0, k)]
        out.append((r.doc_id, None if r.text is None else "\n".join(keep)))
    return out


def test_stages_equal_brute_force(spark, corpus):
    top, item = corpus
    docs = spark.read.parquet(f"{top}/documents.parquet")
    key = lambda x: (str(x[0]), str(x[1]))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram jaccard join", "benchmark decontamination", "mixing"]
    before, out = docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, top)
        if name != "mixing":
            assert df.columns == docs.columns and df.dtypes == docs.dtypes
            df.write.parquet(f"{top}/{stage.__name__}")
            docs = spark.read.parquet(f"{top}/{stage.__name__}")
            df = docs
        after = df.collect()
        rest = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=key)
        if name == "toxicity":
            assert rest(after) == rest([r for r in before if "blorg" not in (r.text or "")])
        elif name == "line dedup":
            assert rest(after) == sorted(lines_by_hand(before), key=key)
            assert all(r.n_chars in (None, len(r.text or ""), 3) for r in after)
        elif name == "n-gram jaccard join":
            classes = brute([(k, r.text) for k, r in enumerate(before)])
            best = {}
            for k, r in enumerate(before):
                if (r.text or "").split():
                    c = classes[k][0]
                    best[c] = min(best.get(c, (True, 0, k)), (r.doc_id is None, r.doc_id or 0, k))
            kept = {k for _, _, k in best.values()} | {k for k, r in enumerate(before) if not (r.text or "").split()}
            assert rest(after) == rest([r for k, r in enumerate(before) if k in kept]) and len(after) < len(before)
        elif name == "benchmark decontamination":
            gone = {k for k, _ in leaks_by_hand([(k, r.text or "") for k, r in enumerate(before)], [(1, item)])}
            assert rest(after) == rest([r for k, r in enumerate(before) if k not in gone]) and gone
        else:
            size = {}
            for r in before:
                size[r.source] = size.get(r.source, 0) + len(re.findall(r"\S+", r.text or ""))
            for s in size:
                mine = [r for r in after if r.source == s]
                assert all(r.taken == r.copies * r["size"] and 0 < r.taken <= 2 * r["size"] for r in mine)
                assert not mine or abs(sum(r.taken for r in mine) - mine[0].target) <= 70
        before = after


def test_run_applies_all_stages(spark, corpus):
    top, _ = corpus
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, top).collect()), key=str) for _ in range(2))
    assert one == two and 0 < len(one) < 240


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    top, _ = corpus
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{top}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


COLUMNS = {
    "op2_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op3_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op4_quality": {"doc_id", "held_out", "score", "predicted"}, "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_mixing": {"doc_id", "size", "source_size", "target", "taken"}, "op10_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op1_ngram_jaccard_join": {"doc_id", "class_id", "n_links"}, "op9_line_dedup": {"doc_id"},
    "op11_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_give_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.QUERIES[name](spark, SF).collect()
    assert COLUMNS[name] <= set(out[0].__fields__)
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    if name in ("op4_quality", "op6_toxicity"):
        least = 0.5 if name == "op4_quality" else 0.7
        assert all(r.predicted == int(r.score >= least) and isinstance(r.held_out, bool) for r in out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, duck.execute(f"SELECT {quoted} FROM ({queries.ORACLE_SQL[name]})").fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_leaks_of_the_given_tables_are_verbatim_passages(spark):
    found = {(r.doc_id, r.item_id) for r in queries.op5_decontaminate(spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {(d, i) for d, t in docs.items() for i, u in items.items() if u and u in t} <= found
