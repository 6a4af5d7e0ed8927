"""Queries over landed answers against their SQL, on postings with odd texts."""

from pathlib import Path

import duckdb
import pytest

from rowloom import catalog
from rowloom.sources import payloads

TEXTS = ["Plain words\nof a posting", "", " ", " \n\t ", " A space before the words", "\n A line before", "\tA tab", "Blanks after \n\t ", "\x0bOther blanks\x0b", "A sign </script> that <b>ends</b> it", 'He said "yes" \\ {x}', "A &amp; B &lt;p&gt;"]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """A folder of tables whose documents have each text under twelve ids."""
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, text, "en", f"src{i % 20}", len(text)) for i, text in enumerate(t for t in TEXTS for _ in range(12))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    (folder / "nation.parquet").symlink_to(Path(sf, "nation.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def duck(odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'; CREATE VIEW nation AS SELECT * FROM '{odd}/nation.parquet'")
    return con


def differing(spark, odd, duck, name: str) -> tuple[set, set]:
    """Rows of the query alone and of its SQL alone."""
    found = catalog.queries()[name](spark, odd)
    columns = sorted(found.columns)
    got = [tuple(r) for r in found.select(*columns).collect()]
    wanted = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert len(got) == len(wanted) == 12 * len(TEXTS)
    return set(got) - set(wanted), set(wanted) - set(got)


def test_jsonld_of_odd_texts(spark, odd, duck):
    assert differing(spark, odd, duck, "landed_jsonld") == (set(), set())


def test_lever_of_odd_texts(spark, odd, duck):
    assert differing(spark, odd, duck, "landed_lever") == (set(), set())


def test_lever_drops_blank_parts(spark):
    raw = spark.createDataFrame([('{"id": "x", "text": "Dev", "descriptionPlain": " \\n", "lists": [{"text": "\\n Need", "content": "<li>a</li>"}], "additionalPlain": "more\\n"}', "s")], "raw string, slug string")
    assert payloads.from_lever(raw).first()["description"] == "Need\na\n\nmore"
