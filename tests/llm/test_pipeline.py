"""The pipeline against a brute-force version on a small fixture, and the queries against their SQL."""

import base64
import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.conftest import SF
from tests.llm import test_decontaminate, test_quality, test_simhash
from tests.llm.helpers import prose
from trailmark.llm import lines, quality, queries
from trailmark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    item = prose(777, 40, [f"w{i}" for i in range(90)])
    rows = []
    for i in range(160):
        text = prose(i, 90, [f"{a}{b}" for a in ("ba", "ke", "lo", "mi") for b in ("ra", "st", "no", "eld", "x")]) + "\nsite notice number one"
        if i % 20 == 3:
            text += "\n" + " ".join(item.split()[5:30])
        if i % 16 == 5:
            text = rows[-1][1]
        rows.append((i, text, "en", f"s{i % 12}", len(text)))
    rows += [(200 + i, " ".join(w + "***" for w in prose(i, 40).split()), "en", "s1", 9) for i in range(40)]
    rows += [(300, None, "en", "s1", None), (301, "", "en", "s2", 0), (None, prose(5, 70, [f"v{i}" for i in range(200)]), "en", None, 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(240) if i < 160 or i >= 200], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(3, 12, ["qq", "zz"]))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    rules = quality.learn(docs, table(spark, folder, "labels"))
    assert rules
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        after = stage(spark, docs, folder)
        key = lambda r: -1 if r["doc_id"] is None else r["doc_id"]
        ids = {key(r) for r in after.collect()}
        if name == "quality_rules":
            listed = {key(r.row): r.rule for r in quality.decided(docs, rules).collect()}
            want = {key(r) for r in before if (s := test_quality.brute(r["text"])) and not (s[0] < 10 or 100 * s[4] > 20 * s[0]) and not listed[key(r)]}
        elif name == "line_dedup":
            documents = docs.toArrow()  # noqa: F841  read by name
            hashes = {(-1 if d is None else d): h for d, _, _, h, _ in duckdb.sql(lines.sql(lines.LEAST_SITES)).fetchall()}
            assert {key(r): hashlib.sha256(r.text.encode()).hexdigest() for r in after.collect()} == hashes
            want = {key(r) for r in before}
        elif name == "near_dedup":
            brute = test_simhash.brute(docs.collect())
            want = {d for d, _, c in brute if d == c}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
            want = {key(r) for r in before if not test_decontaminate.brute(r["text"], items)[1]}
            assert len(want) < len(before)
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = {key(r) for r in before}
            got = {key(r): r.ids_sha256 for r in after.collect()}
            assert got == {key(r): hashlib.sha256(np.array(library.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest() for r in before}
        assert ids == want, name
        if name != "encoding":
            assert after.columns == columns
            assert len(after.collect()) == len(want)
            docs = spark.createDataFrame(after.collect(), SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {None if i == -1 else i for i in ids}


def test_empty_documents(spark, folder, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copytree(f"{folder}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = lambda t: sorted(str(tuple(r.values())) for r in t.select(sorted(t.column_names)).to_pylist())
    assert rows(queries.queries()[name](spark, SF).toArrow()) == rows(con.sql(queries.oracle_sql()[name]).to_arrow_table())


def test_all_operators_and_the_entry():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 14)] == [1] * 13 and "pipeline" in found
