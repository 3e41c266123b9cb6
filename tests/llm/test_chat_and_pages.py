"""Chat formatting and language identification."""

import random

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def test_formatting_is_undone():
    from quern.llm.prefix_tree import formatted, parsed

    rng = random.Random(1)
    parts = ["\\", "#", "###", " ", "</turn>", "\n", "a", ":", "user", "### x: ", "é", "<", "/turn>"]
    for _ in range(2000):
        turns = [tuple("".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(2)) for _ in range(3)]
        assert parsed("".join(formatted(r, t) for r, t in turns)) == turns


TURNS = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "good day"), (2, 3, "user", "bye"),
    (3, 0, "system", "be kind"), (3, 1, "user", "hi"), (3, 2, "assistant", "hello"),
    (4, 0, "user", None), (4, None, None, "first"), (5, 0, "assistant", "</turn>\n### \\"), (None, 3, "user", "lost"),
    (6, 0, "user", "twice"), (6, 0, "user", "twice"),
]


def test_tree(spark):
    from quern.llm.prefix_tree import prefix_tree

    nodes, leaves = prefix_tree(spark.createDataFrame(ROWS, TURNS).repartition(3))
    got = {r["node"]: r for r in nodes.collect()}
    end = {r["conv_id"]: r["node"] for r in leaves.collect()}
    assert len(end) == 7 and end[1] == end[3]
    assert len(got) == 11  # of 15 turns, the first conversation's three and a shared start of two are there once
    order = sorted(got.values(), key=lambda r: r["place"])
    assert [r["place"] for r in order] == list(range(11))
    for a, b in zip(order, order[1:], strict=False):
        if a["tree"] == b["tree"]:
            assert b["start"] == a["start"] + a["n_tokens"]  # nothing between, nothing twice
        else:
            assert b["start"] == 0 and b["parent"] is None
    for r in order:
        assert r["position"] == sum(s["end"] - s["start"] for s in r["attends"])
        if r["parent"]:
            p = got[r["parent"]]
            assert r["depth"] == p["depth"] + 1 and r["position"] == p["position"] + p["n_tokens"]
            assert p["place"] < r["place"] and any(s["first"] <= p["place"] <= s["last"] for s in r["attends"])


def test_read_back(spark):
    from quern.llm.prefix_tree import digests, prefix_tree, read_back

    got = {r["conv_id"]: r for r in digests(read_back(*prefix_tree(spark.createDataFrame(ROWS, TURNS)))).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 3, 2: 4, 3: 3, 4: 2, 5: 1, 6: 2, None: 1}
    assert got[1]["turns_sha256"] == got[3]["turns_sha256"] and got[1]["loss_chars"] == 5 and got[5]["loss_chars"] == len("</turn>\n### \\")
    empty = spark.createDataFrame([], TURNS)
    assert digests(read_back(*prefix_tree(empty))).count() == 0


@pytest.mark.parametrize("name", ["op1_chat_prefix_tree", "op2_quality_rules", "op6_near_duplicates", "op10_sharding"])
def test_query_equals_its_sql(spark, name):
    from quern.llm.queries import ORACLE, QUERIES

    con, d = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("conversations", "documents"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, d)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_tokenizer_files_are_a_parameter(spark):
    from pathlib import Path

    path = Path("/opt/tokenizers/byte_bpe_50k.json")
    if not path.exists():
        pytest.skip("no tokenizer file here")
    from quern.llm.prefix_tree import prefix_tree

    nodes, _ = prefix_tree(spark.createDataFrame(ROWS, TURNS), str(path))
    assert all(len(r["tokens"]) == r["n_tokens"] for r in nodes.collect())


PAGES = "page_id long, url string, html string"
EN, FR = "the of and to is that it was for with this are from", "le la les des et une que qui dans pour sur avec est"


def test_pages(spark):
    from quern.llm.language import identify

    docs = spark.createDataFrame([(i, (EN if i % 2 else FR) + f" {i}", "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    html = lambda lang, text: f"<html lang='{lang}'><script>var {FR}</script><p>{text}</p></html>"
    rows = [(i, f"http://a.example.com/en/{i}", html("en", EN)) for i in range(30)] + [(100 + i, f"https://b.example.fr/{i}", html("fr", FR)) for i in range(30)]
    rows += [(200, "http://a.example.com/en/x", html("en", "")), (201, "https://b.example.fr/y", None), (202, None, FR), (203, "::bad::", EN), (None, None, None), (204, "http://a.example.com/en/z", html("en", FR * 30)), (100, rows[30][1], rows[30][2])]
    got = identify(spark.createDataFrame(rows, PAGES), docs).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["lang"] == "en" for i in (*range(30), 200, 203))
    assert all(by[i]["lang"] == "fr" for i in (*range(100, 130), 201, 202, 204))
    assert by[None]["lang"] in ("en", "fr") and 0 < by[None]["confidence"] <= 1
    assert identify(spark.createDataFrame(rows, PAGES).limit(0), docs).count() == 0
    assert {r["lang"] for r in identify(spark.createDataFrame(rows, PAGES), docs.limit(0)).collect()} == {None}


def test_markup_in_linear_time():
    import time

    from quern.llm.language import address, read

    assert read("a<b>c</b>&amp;<script>x</script>d<!-- e -->f < g")[0].split() == ["a", "c", "&", "df", "<", "g"]
    assert read("<html xml:lang='fr'><meta http-equiv=content-language content='en'>x")[1] == "fr"
    assert read("<meta content='de-AT' http-equiv='Content-Language'>x")[1] == "de"
    assert read("<script>var a = '<p>'; </script>seen<style>p")[0].split() == ["seen"]
    assert read(None) == ("", None)
    for part in ("<script ", "<html ", "<", "<!--", "lang=", "<a ", "&amp", "<script></script", "<meta content-language "):
        began = time.perf_counter()
        read(part * (1_000_000 // len(part)))
        assert time.perf_counter() - began < 2, part
    assert address("http://shop.example.co.uk/x") == ("shop.example.co.uk", "example.co.uk", ".uk")
    assert address("http://a.b.example.com/en-GB/x") == ("a.b.example.com", "example.com", "/en")
    assert address("http://co.uk/") == ("co.uk", "co.uk", ".uk")


def test_evidence_by_force(spark):
    """All of the fusion once more, in plain Python, from the same text model."""
    import math

    from quern.llm.language import MOST_GRAMS, address, grams, identify, read, train

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, (EN if i % 2 else FR) + f" {i}", "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    hosts = ["www.a.example.co.uk", "b.example.co.uk", "c.example.fr", "d.example.fr", "e.org", None]
    rows = []
    for i in range(120):
        words = rng.sample((EN + " " + FR).split(), rng.randrange(12))
        host, code = rng.choice(hosts), rng.choice(["en", "fr", "xx", None])
        rows.append((i, f"http://{host}/{rng.choice(['en', 'fr', 'page'])}/{i}" if host else None, f"<html{f' lang={code}' if code else ''}>{' '.join(words)}"))
    clash = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "page_id long, url string, html string, host int, p double")
    langs, table = train(docs)
    k, pull = len(langs), 5.0
    ll, p, places, said = {}, {}, {}, {}
    for i, url, html in rows:
        text, said[i] = read(html)
        g = grams(text)
        n = float(g.sum())
        ll[i] = [float(x) for x in table @ g * min(1.0, MOST_GRAMS / n)] if n else [0.0] * k
        e = [math.exp(x - max(ll[i])) for x in ll[i]]
        p[i] = [x / sum(e) for x in e]
        places[i] = address(url)
    add = lambda ids: [sum(x) for x in zip(*(p[i] for i in ids), strict=True)] or [0.0] * k
    prior = [(x + 1) / (len(rows) + k) for x in add(ll)]
    for r in identify(clash, docs).collect():
        i = r["page_id"]
        host, domain, suffix = places[i]
        post = list(ll[i])
        up = prior
        if domain:
            d = add(j for j in ll if places[j][1] == domain)
            up = [(x + pull * q) / (sum(d) + pull) for x, q in zip(d, prior, strict=True)]
        own = [max(0.0, x - q) for x, q in zip(add(j for j in ll if places[j][0] == host), p[i], strict=True)] if host else [0.0] * k
        post = [a + math.log((x + pull * q) / (sum(own) + pull)) for a, x, q in zip(post, own, up, strict=True)]
        for code, of in ((said[i], said), (suffix, {j: v[2] for j, v in places.items()})):
            if code:
                same, any_code = add(j for j in ll if of[j] == code), add(j for j in ll if of[j])
                post = [a + math.log((x + q) / (w + 1)) for a, x, q, w in zip(post, same, prior, any_code, strict=True)]
        e = [math.exp(x - max(post)) for x in post]
        want = [x / sum(e) for x in e]
        assert r["confidence"] == pytest.approx(max(want)) and r["lang"] == langs[want.index(max(want))]
        assert (r["host"], r["suffix"], r["declared"]) == (host, suffix, said[i])


def test_long_conversations_and_clashing_columns(spark):
    from quern.llm.prefix_tree import digests, prefix_tree, read_back

    long = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * 50) for i in range(400)] + [(2, 0, "user", "x" * 500_000)]
    df = spark.createDataFrame([(*r, 1, "n", "p") for r in long], TURNS + ", place int, node string, path string")
    got = {r["conv_id"]: r for r in digests(read_back(*prefix_tree(df))).collect()}
    assert got[1]["n_turns"] == 400 and got[2]["formatted_chars"] == 500_000 + len("### user: </turn>") + 1


def test_pages_of_the_test_data(spark):
    from quern.llm.queries import op8_language_id

    got = op8_language_id(spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/pages.parquet").count()
    # the address names the language; where text and markup agree with it, so must the result
    clear = [r for r in got if r["suffix"] and r["suffix"] == f"/{r['declared']}" and r["text_lang"] == r["declared"]]
    assert clear and all(r["lang"] == r["declared"] for r in clear)
