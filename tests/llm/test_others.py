"""Chats, archives, pages, the pipeline."""


import pytest
import zstandard
from helpers import agree

from mnemoloom.llm import chat, html, registry, warc

# chats

EVENTS = "conv long, turn long, seq long, kind string, role string, text string"


def fold(spark, rows, **k):
    out = {}
    for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, EVENTS), **k)).orderBy("conv", "block").collect():
        held = out.setdefault(r.conv, ([], []))
        held[0].extend((m.role, m.text) for m in r.messages)
        held[1].extend(r.trained)
    return out


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 1, "start", "user", "Hel"), (1, 0, 2, "delta", None, "lo"), (1, 1, 4, "delta", "assistant", "B"), (1, 1, 3, "start", "assistant", "A"),
        (1, 1, 5, "regenerate", "assistant", None), (1, 1, 6, "delta", None, "C"), (1, 1, 7, "delta", None, "D"),
        (2, 0, 1, "start", "user", "x"), (2, 1, 2, "start", "assistant", "old"), (2, 0, 3, "edit", "user", "y"), (2, 1, 4, "start", "assistant", "new"),
        (3, 0, 1, "start", "user", "x"), (3, 1, 2, "start", "assistant", "gone"), (3, 0, 3, "edit", None, "z"),
    ]
    for block in (1, 2, 32):
        got = fold(spark, rows, block=block)
        assert got[1] == ([("user", "Hello"), ("assistant", "CD")], ["CD"])
        assert got[2] == ([("user", "y"), ("assistant", "new")], ["new"])
        assert got[3] == ([("user", "z")], [])


def test_any_text_reads_back(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<|", "<\\\\|im_end|>\n", "", None, "\n\n", "a<", "|>", "ünï 😀 <|im_end|>\n"]
    rows = [(i % 3, i, i, "message", "assistant" if i % 2 else "ro\\le\nn<|", t) for i, t in enumerate(texts)]
    got = fold(spark, rows, block=2)
    for c in range(3):
        mine = [r for r in rows if r[0] == c]
        assert got[c] == ([(r[4], r[5] or "") for r in mine], [r[5] or "" for r in mine if r[4] == "assistant"])


def test_chats_with_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, "message", None, None), (7, 1, 1, "message", "user", "b"), (7, 1, 1, "message", "user", "a"), (7, 1, 1, "message", "user", "a")]
    got = fold(spark, rows)
    assert got[None] == ([("", "")], []) and got[7][0] == [("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.digest(chat.format_chats(spark.createDataFrame([], EVENTS))).count() == 0


# archives


def test_archives_round_trip(spark):
    rows = [(3, "http://a/\r\nX: y", "same"), (1, "http://b", "same"), (2, None, None), (9, "u", ""), (None, "n", "own"), (5, "http://ü", "é" * 100_000), (1, "http://b", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    digest = lambda t: warc.base32_sha1((t or "").encode())
    want = [("3", 4, digest("same"), "revisit", 1), ("1", 4, digest("same"), "response", None), ("1", 4, digest("same"), "response", None), ("2", 0, digest(""), "response", None), ("9", 0, digest(""), "revisit", 2), ("None", 3, digest("own"), "response", None), ("5", 200_000, digest("é" * 100_000), "response", None)]
    assert got == sorted(want)
    assert {r.record_type for r in warc.round_trip(pages, min_payload=5).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def archive(records, dictionary=b""):
    c = zstandard.ZstdCompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    return warc.dictionary_frame(dictionary) + b"".join(c.compress(r) for r in records)


def test_reader_uses_the_dictionary_and_rejects_faults():
    good = [warc.build_record(i, "http://x", b"payload %d" % i, None, False) for i in range(40)]
    dictionary = zstandard.train_dictionary(2048, good * 20).as_bytes()
    for held in (dictionary, zstandard.ZstdCompressor().compress(dictionary)):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        data = warc.dictionary_frame(held) + b"".join(c.compress(r) for r in good)
        assert [r["payload"] for r in warc.read_archive(data)] == [b"payload %d" % i for i in range(40)]
    assert len(list(warc.read_archive(archive(good)))) == 40
    bad = [
        good[0].replace(b"WARC/1.1", b"HTTP/1.1"), good[0].replace(b"WARC-Date", b"WARC-Data"), good[0][:-1], good[0] + b"x", good[0].replace(b"payload 0", b"payload 9"),
        good[0].replace(b"Content-Length: ", b"Content-Length: x", 1), good[0].replace(b"response\r\n", b"metadata\r\n"),
    ]
    for record in bad:
        with pytest.raises(ValueError):
            list(warc.read_archive(archive([record])))
    with pytest.raises(ValueError):
        list(warc.read_archive(archive(good)[:-3]))
    with pytest.raises(ValueError):
        list(warc.read_archive(warc.dictionary_frame(b"x" * 50)[:20]))


def test_reader_refuses_records_that_unpack_to_too_much(monkeypatch):
    monkeypatch.setattr(warc, "MAX_RECORD", 1 << 20)
    bomb = zstandard.ZstdCompressor(write_content_size=False).compress(b"\0" * (300 << 20))
    with pytest.raises(ValueError, match="unpacks"):
        list(warc.read_archive(warc.dictionary_frame(b"") + bomb))


def test_reader_is_linear():
    """Bytes that the decoder is handed grow with the archive, not with its square."""
    record = warc.build_record(1, "u", b"x" * 300, None, False)
    data = archive([record] * 3000)
    view, at, fed, decompressor = memoryview(data), 8, 0, zstandard.ZstdDecompressor()
    while at < len(data):
        content, end = warc._frame(decompressor, view, at)
        fed += -(-(end - at) // warc.FEED) * warc.FEED
        assert content == record
        at = end
    assert fed < 3000 * 2 * warc.FEED and len(list(warc.read_archive(data))) == 3000


def test_hot_payloads_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, "u", "hot" if i % 3 else f"own {i}") for i in range(60)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("response", None) if i % 3 == 0 or i == 1 else ("revisit", 1) for i in range(60)}


def test_reader_takes_binary_files(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive([warc.build_record(1, "u", b"x", None, False)]))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(r.page_id, r.payload_bytes) for r in warc.read_archives(files).collect()] == [(1, 1)]


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- x --><div class="ad">Buy</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First%s&nbsp;para.<br>more<p>Second <i>in</i>line<ul><li>one<li>two</ul><div class="share-bar">Share</div><form><p>Mail</form>
<section class="comments"><p>Nice!</section></article><aside>Side</aside><div id="sidebar"><p>More</div><footer>&copy; x</footer></body></html>"""


def test_article_without_its_surroundings():
    want = "Head & line\n\nFirst1 para. more\n\nSecond inline\n\none\n\ntwo"
    assert html.extract(PAGE % 1) == want
    wrapper = html.induce([PAGE % i for i in range(4)])
    assert html.extract(PAGE % 1, html.Wrapper.load(wrapper.dump())) == want
    assert html.induce([PAGE % 1] * 9) is None


def test_wrapper_finds_template_without_marks():
    page = "<body><div>Acme portal</div><div class=x><span>Log of the day</span><p>Story {0}.</p><p>Rest {0}.</p></div><div>All rights</div></body>"
    pages = [page.format(i) for i in range(5)]
    assert html.extract(pages[2], html.induce(pages)) == "Story 2.\n\nRest 2."
    assert html.extract(pages[2]).startswith("Acme portal")


@pytest.mark.parametrize("page", ["", None, "<", "<p", "plain", "</p></p>", "<p>a<p>b</div>c", "<script>x", "<!-- never", "<a href='x>y</a>z", "<" * 5000, "<div>" * 3000 + "deep", "&#xD800;&bogus;"])
def test_broken_pages_do_not_crash(page):
    wrapper = html.induce([PAGE % i for i in range(4)] + ["<div>" * 3000 + str(i) for i in range(4)])
    assert isinstance(html.extract(page), str) and isinstance(html.extract(page, wrapper), str)


def test_pages_with_nulls(spark):
    rows = [(i, f"http://h/{i}", PAGE % i, "x") for i in range(6)] + [(None, None, None, "x"), (6, "no url", "", "x"), (6, "no url", "", "x"), (7, None, "<p>a</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.n_chars) for r in html.extract_pages(df).collect()}
    assert (7, 1) in got and (6, 0) in got and (None, 0) in got and html.extract_pages(df).count() == 10
    assert html.extract_pages(df.limit(0)).count() == 0


# everything


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, sf, name):
    agree(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    import corpus_pipeline
    from test_documents import brute_classes, check_packing, features

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), docs
    kept = stages["quality rules"](spark, docs, sf)
    rows = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns and not any(features(r.text)[-1] for r in rows.values())
    known = {r.doc_id for r in stages["language ID"](spark, kept, sf).collect()}
    assert known <= rows.keys() and len(known) >= 0.95 * len(rows)
    classes = brute_classes([(k, r.text) for k, r in rows.items()])
    one = {r.doc_id for r in stages["MinHash near-dedup"](spark, kept, sf).collect()}
    assert one == set(classes.values())
    seen = corpus_pipeline.run(spark, sf).collect()
    check_packing(seen)
    assert {r.doc_id for r in seen} <= one


def run_stages(spark, docs, tmp):
    """The pipeline's stages over any documents, each written and read again."""
    import corpus_pipeline

    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, None)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == docs.columns
        made.write.parquet(f"{tmp}/{i}")
        docs = spark.read.schema(made.schema).parquet(f"{tmp}/{i}")
    return docs.collect()


def test_pipeline_on_awkward_rows(spark, sf, awkward, nothing, tmp_path):
    """Awkward rows with some good ones among them, repeated, without an id, and with columns of clashing names."""
    from test_documents import check_packing, features

    good = [r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if not features(r.text)[-1]][:60]
    rows = [(1000 + r.doc_id, r.text, r.lang, None, r.n_chars, "w", 1, "i", 2, None) for r in good]
    rows += rows[:5] + [(None, *rows[0][1:])] + [(r[0] + 5000, *r[1:]) for r in rows[5:8]]
    got = run_stages(spark, awkward.unionByName(spark.createDataFrame(rows, awkward.schema)), tmp_path / "a")
    check_packing(got)
    ids = [r.doc_id for r in got if r.piece == 0]
    assert len(ids) == len(set(ids)) > 30 and set(ids) <= {r[0] for r in rows if r[0] is None or r[0] < 5000}
    assert run_stages(spark, nothing, tmp_path / "b") == []


def test_pipeline_blots_out_secrets(spark, sf):
    """The secret stage against spans found one by one."""
    import corpus_pipeline
    from test_documents import base_spans

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["secret scans"](spark, docs, sf).collect()}
    for r in docs.collect():
        spans = [tuple(map(int, s.split(":")[1:])) for s in base_spans(r.text).split(",") if s]
        assert all(r.text[a:b] not in out[r.doc_id].text for a, b in spans) and out[r.doc_id].n_chars == len(out[r.doc_id].text or "")
        assert spans or "[REDACTED]" in out[r.doc_id].text or out[r.doc_id].text == r.text
