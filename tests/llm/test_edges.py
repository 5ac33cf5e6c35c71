"""Each operator on awkward tables: nulls, empty and very long texts, repeated rows, no rows, clashing columns."""

import uuid

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from waypath.llm import exact, language, minhash, packing, pipeline, quality, scoring, sentencepiece, urls, warc, wordpiece

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from here "
CLASH = ["id", "n", "key", "row", "word", "gram", "group", "digest", "size", "text_sha256", "keep_id", "kept", "score", "bucket", "lang_pred", "trusted", "component_id", "_gone", "rank", "url_", "found", "base", "type"]

ROWS = [
    (1, PROSE * 3, "en", "a", 1),
    (2, PROSE * 3, "en", "a", 1),
    (2, PROSE * 3, "en", "a", 1),  # a repeated row
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (None, PROSE, None, "b", 5),
    (None, None, None, None, None),
    (5, " \t\n ", "en", "a", 4),
    (6, "x" * 300_000, "en", "a", 300_000),  # one word
    (7, (PROSE + "né 日本 ▁ ") * 4000, "en", "a", 1),
    (8, "12 34 !! 56", None, "a", 1),
    (9, "le petit chat est dans la maison et il dort bien au chaud ce soir", "fr", "a", 1),
    (10, (PROSE * 3)[:-20], "en", "a", 1),
    (11, "one", "en", "a", 1),
    (12, "one", "en", "a", 1),
    (13, "one\x1ctwo\x85three\xa0four five", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 0), (8, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASH})


OPS = {
    "scoring": lambda d, x: scoring.score(d),
    "exact": lambda d, x: exact.deduplicate(d, exact.DigestIndex(d.sparkSession, f"t_{uuid.uuid4().hex}", 3)),
    "wordpiece": lambda d, x: wordpiece.token_counts(d, BPE),
    "quality": lambda d, x: quality.judge(d, x),
    "language": lambda d, x: language.languages(d),
    "minhash": lambda d, x: minhash.near_duplicates(d),
    "sentencepiece": lambda d, x: sentencepiece.round_trip(d, SP),
    "packing": lambda d, x: packing.pack(d, BPE),
}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", OPS)
def test_rows_are_whole_and_other_columns_do_not_matter(docs, labels, name):
    got = rows(OPS[name](docs, labels))
    if name == "packing":
        assert sum(1 for r in got if r[1] == 0) == len(ROWS)
    else:
        assert len(got) == len(ROWS)
    again = rows(OPS[name](clashing(docs), labels))
    assert [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got] == [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in again]


@pytest.mark.parametrize("name", OPS)
def test_no_rows(docs, labels, name):
    assert OPS[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPS)
def test_only_nulls(spark, labels, name):
    d = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert OPS[name](d, labels).count() == 3


def test_defined_results(docs, labels):
    by = lambda df: {r.doc_id: r for r in df.collect() if r.doc_id is not None}
    e = by(OPS["exact"](docs, labels))
    assert (e[2].keep_id, e[2].group_size, e[1].kept, e[2].kept) == (1, 3, True, False)
    assert e[5].keep_id == 5 and e[3].keep_id == 5 and e[4].keep_id == 5  # of the empty texts the one with most characters
    m = by(OPS["minhash"](docs, labels))
    assert (m[2].component_id, m[12].component_id, m[3].component_id, m[3].n_shingles, m[11].n_shingles) == (1, 11, 3, 0, 1)
    assert not m[2].kept and m[3].kept and m[4].kept and m[5].kept
    g = by(OPS["language"](docs, labels))
    assert [g[i].lang_pred for i in (3, 4, 5, 8)] == ["und"] * 4 and g[8].score == 0
    q = by(OPS["quality"](docs, labels))
    assert q[3].base_failed and q[5].n_words == 0 and q[6].word_chars == 300_000 and not q[3].kept
    s = by(OPS["scoring"](docs, labels))
    assert s[3].n_tokens == s[4].n_tokens == s[5].n_tokens == 1 and s[13].n_tokens == 3
    assert all(r.restored for r in OPS["sentencepiece"](docs, labels).collect())


PAGES = [
    (1, "http://a.example.com/fr/1", "<p>" + "x" * 200),
    (2, "http://a.example.com/fr/1", "<p>" + "x" * 200),
    (2, "http://a.example.com/fr/1", "<p>" + "x" * 200),
    (3, None, None),
    (4, "no scheme", ""),
    (None, "https://B.EXAMPLE.net/es/x?y#z", "<p>" + "x" * 200),
    (5, "http://x.net/fr/", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello"),
    (6, "http://www.example.com/en/ok", "é" * 60),
    (7, "http://example.com/en/ok\r\nX: y", "é" * 60),
    (8, "http://q.org?x=/en/", "y" * 400_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_archives(pages):
    got = warc.archived(pages)
    assert got.count() == len(PAGES)
    r = {x.page_id: x for x in got.collect()}
    assert (r[1].record_type, r[2].record_type, r[2].refers_to, r[None].refers_to) == ("response", "revisit", 1, 1)
    assert (r[7].record_type, r[7].refers_to, r[7].payload_bytes) == ("revisit", 6, 120)
    assert r[3].payload_bytes == 0 and r[3].record_type == "response" and r[5].payload_bytes == len(PAGES[6][2])
    assert rows(warc.archived(clashing(pages))) == rows(got)
    assert warc.archived(pages.limit(0)).count() == 0


def test_captures_are_nested(spark, pages, tmp_path):
    warc.write(pages, f"file://{tmp_path}/w", archives=((0, 2), (100, 1)))
    got = {c.metadata.payload.decode().split("\r\n")[0]: c for c in warc.captures(warc.read(spark, f"file://{tmp_path}/w")).collect()}
    c = got["page-id: 5"]
    assert c.response.payload.decode() == PAGES[6][2] and c.request.payload_bytes == 0 and c.request.http_head.startswith("GET http://x.net/fr/")
    assert got["page-id: 7"].response.target_uri == "http://example.com/en/ok X: y"


def test_parser_reads_plain_and_many_members():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for blob in (record * 3, gzip.compress(record) * 3, gzip.compress(record * 3)):
        assert [b for _, b in warc.parse(blob)] == [b"abc"] * 3
    assert [b for _, b in warc.parse(record + record[:-8])] == [b"abc"]


def test_urls(pages):
    got = urls.judge(pages)
    assert got.count() == len(PAGES)
    r = {x.page_id: x for x in got.collect()}
    assert (r[1].host, r[1].path, r[1].rule, r[1].verdict) == ("a.example.com", "/fr/1", "com/", "allow")
    assert (r[None].host, r[None].rule, r[None].verdict) == ("b.example.net", "net/es/", "block")
    assert (r[6].rule, r[7].rule, r[8].host, r[8].path) == ("www.example.com/en/", "example.com/en/", "q.org", "")
    assert (r[3].host, r[3].path, r[3].rule, r[3].verdict, r[4].host) == ("", "", None, "allow", "")
    assert rows(urls.judge(clashing(pages))) == rows(got)
    assert urls.judge(pages.limit(0)).count() == 0
    assert {x.verdict for x in urls.judge(pages, rules=[]).collect()} == {"allow"}


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for table in (docs, clashing(docs), docs.limit(0)):
        kept = table
        for stage in (pipeline.known_language, pipeline.good_quality, pipeline.distinct_texts, pipeline.distinct_content):
            kept = stage(spark, kept, f"file://{tmp_path}")
            assert kept.columns == table.columns
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert len(set(ids) - {None}) == len([i for i in ids if i is not None])
        assert pipeline.packed(spark, kept, f"file://{tmp_path}").select("doc_id").distinct().count() == len(set(ids))
