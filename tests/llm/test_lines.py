import hashlib

import duckdb

from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from trailmark.llm import lines


def by_sql(df):
    documents = df.toArrow()  # noqa: F841  read by name
    return sorted(map(str, duckdb.sql(lines.ORACLE_SQL).fetchall()))


def by_spark(df):
    out = lines.without_boilerplate(df).select("doc_id", F.col("_line_count"), F.col("_line_gone"), F.sha2(F.col("text").cast("binary"), 256), F.length("text").cast("long"))
    return sorted(str(tuple(r)) for r in out.collect())


def fixture(spark):
    common, near, few = "cookie notice, accept all", "eleven sites", "nine sites"
    rows = []
    for i in range(40):
        parts = [prose(i, 12), "", " " + common + " ", "---"]
        parts += [near] * (i < 11) + [few] * (i < 9)
        rows.append((i, "\n".join(parts), "en", f"s{i}", 5, "k"))
    long, shorter = prose(77, 51), prose(78, 50)  # a line of over 50 words on three sites, and one of 50
    rows += [(60 + i, f"{long}\n{shorter}\n{prose(60 + i, 9)}", "en", f"s{i}", 5, "k") for i in range(3)] + [(70, prose(79, 60), "en", "s1", 5, "k"), (71, prose(79, 60) + "\nx", "en", "s1", 5, "k")]
    low = prose(300, 12)  # on eleven sites, though copies of a few of its texts stand on one that sorts first
    rows += [(300 + i, f"{low}\n{prose(301 + i, 6)}", "en", site, 5, "k") for i in range(11) for site in {f"s{i}", "a"}]
    copied = prose(99, 20) + "\n" + prose(98, 20)
    rows += [(100 + i, copied, "en", f"s{i}", 5, "k") for i in range(30)]  # copies of one text aren't boilerplate
    rows += [(200, None, "en", "s1", 5, "k"), (201, "", "en", None, 5, "k"), (None, common, "en", "s3", 5, "k"), (3, rows[3][1], "en", "s3", 5, "k"), (202, common, "en", "s9", 5, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, line string")


def test_equals_sql(spark):
    df = fixture(spark)
    assert by_spark(df) == by_sql(df)


def test_rules(spark):
    df = fixture(spark)
    out = lines.without_boilerplate(df)
    assert out.columns == [*df.columns, "_line_count", "_line_gone"]
    rows = {r.doc_id: r.text for r in out.collect()}
    assert "cookie" in rows[0] and "eleven" in rows[0] and "nine" in rows[5]
    assert all("cookie" not in rows[i] and "eleven" not in rows[i] for i in range(1, 40))
    assert prose(77, 51) in rows[60] and prose(77, 51) not in rows[61] + rows[62] and prose(78, 50) in rows[61] and prose(79, 60) in rows[71]
    assert prose(300, 12) in rows[300] and all(prose(300, 12) not in rows[300 + i] for i in range(1, 11))
    assert rows[100] == rows[129] and rows[200] is None and rows[201] == "" and rows[202] == ""
    assert lines.without_boilerplate(df.limit(0)).count() == 0


def test_margin_counts_exactly(spark, monkeypatch):
    monkeypatch.setattr(lines, "LG_K", 4)  # coarse sketches: the margin's exact counts must decide
    monkeypatch.setattr(lines, "MARGIN", 0.9)
    df = fixture(spark)
    assert by_spark(df) == by_sql(df)
    assert hashlib.sha256(b"").hexdigest() in str(by_spark(df))
