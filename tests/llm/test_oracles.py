"""The queries against their SQL, on small tables with planted cases and on supplied ones."""

import random

import duckdb
import pytest

from quern.llm.licenses import NOTICES
from quern.llm.queries import ORACLE_SQL, QUERIES


def rows_of(spark, folder, name):
    with duckdb.connect() as con:
        for table in ("documents", "pages"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/**/*.parquet'" if (folder / f"{table}.parquet").is_dir() else f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        cursor = con.execute(ORACLE_SQL[name])
        want = [dict(zip([c[0] for c in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    got = [r.asDict() for r in QUERIES[name](spark, str(folder)).collect()]
    return [sorted(repr(sorted(r.items())) for r in rows) for rows in (got, want)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("oracles")
    rng = random.Random(5)
    words = ["alpha", "beta.", "Gamma", "delta,", "|", "###", "é", "Éa", "mit", "license", "the", "of", "İx", "漢字"]
    texts = [None, "", " \t\n", "one two", "one two", "ONE two\x0bthree four five six", "a\n\nb\n", "cc by cc by", "Click here " * 40]
    texts += [f"Filler é then {text.upper()} and more." for _, text, _ in NOTICES]
    texts += [f"{text[: len(text) // 2]} stop" for _, text, _ in NOTICES]
    notices = [text for _, text, _ in NOTICES]  # several in a text, and words of others between them
    texts += [" filler. ".join(notices), " ".join(reversed(notices))]
    texts += [f"{a} and {b}" for a in notices for b in notices if a != b]
    # lines of more than 64 words: prose with few new words, a few words over and over, repeated windows
    texts += [" ".join(f"w{int(400 * rng.random() ** 3)}" for _ in range(3000)) + ".", " ".join(rng.choice("abcdefgh") for _ in range(300)) + ".", "one line. " + "some words that come again and again in it, " * 40]
    for _ in range(60):
        made = [rng.choice(words) if rng.random() < 0.4 else f"w{rng.randrange(900)}" for _ in range(rng.randrange(120))]
        texts.append(" ".join(made))
        if rng.random() < 0.5:
            made = made[: -rng.randrange(1, 9)] + ["end"]
            texts.append(" ".join(made).upper())
        texts.append("".join(w + rng.choice(" \n  ") for w in made))
    spark.createDataFrame([(3 * k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    hosts = ["www.example.com", "example.com", "a.net", "b.net", "spam.org", "good.org", "mid.org", "far.org"]
    paths = ["/en/x", "/es/y?q=/fr/", "/fr/", "", "#top", "/"]
    pages = [(0, None, None), (1, "no scheme", "<a href='//a.net/'>"), (2, "http://", ""), (3, "http://only.org", None)]
    for k in range(4, 160):
        host = rng.choice(hosts)
        html = "".join(f"<a {rng.choice(['href', 'HREF ', 'src'])}={rng.choice(['', '\"', chr(39)])}{rng.choice(['http:', '', 'HTTPS:'])}//{rng.choice(hosts)}/p>" for _ in range(rng.randrange(4)))
        if host == "spam.org":
            html = "<a href=//a.net/fr/>"
        pages.append((k, f"https://{host.upper()}{'/fr/' if host == 'a.net' else rng.choice(paths)}", html))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return out


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_planted_cases(spark, folder, name):
    got, want = rows_of(spark, folder, name)
    assert got == want and len(got) > 100


def test_links_decide_some_hosts(spark, folder):
    said = {r.verdict for r in QUERIES["op4_url_filter"](spark, str(folder)).where("rule is null").collect()}
    assert said == {"allow", "block"}
