import html as htmllib
import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import CLASHING, norm, odd_docs, odd_rows, rules, sha
from conftest_paths import SF001, SF01

from vocable.llm import bm25_packing, quality_crf, rule_ledger, sentencepiece_codec, tag_path, toxicity_ftrl, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_sentence_ends_in_many_scripts(spark):
    end = re.compile("[.!?…。！？｡।॥۔؟։።။‼⁇⁈⁉][\"'”’»›)\\]}）」』】〉》]*$")
    texts = ["यह एक वाक्य है। दूसरा भी॥", "کیا یہ جملہ ہے؟ ہاں۔ نہیں", "他说：“好。” 真的？！ 是（对。）", "“Stop.” “Why?” she said. 'No!') (yes).",
             "é è.é a.” ” ) .) ...", "no ends here at all », « x", "", None, "end…» ‼ ⁉”", "a." * 3 + "b", ".\x00 x"]
    got = rule_ledger.measure(pa.array(texts))["n_ends"].tolist()
    assert got == [sum(bool(end.search(w)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    dialogue = " ".join(f"“She said number {i} to him again today.”" for i in range(12))
    hindi = " ".join(["नदी", "के", "किनारे", "एक", "गाँव", "था", "जहाँ", "लोग", "सुबह", "काम", "करते", "थे।"][k % 12] + str(k) * (k % 12 < 11) for k in range(72))
    kept = rule_ledger.apply_policy(rule_ledger.ledger(odd_docs(spark, [(1, dialogue, "en", "s", 1), (2, hindi, "hi", "s", 1)])))
    assert {r.doc_id: r.fail_bits & rule_ledger.BIT["no_sentences"] for r in kept.collect()} == {1: 0, 2: 0}


# ---------------------------------------------------------------- WARC

def odd_pages(spark, partitions=3):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nX: y ü%", None), (4, "", ""), (5, "u", "é" * 40),
            (6, "u", "é" * 60), (7, "u", "é" * 60), (7, "u", "é" * 60), (9, "u", "other" * 30), (9, "u", "more" * 40),
            (0, "u", "<p>short"), (10, "u", "<p>short")]
    return rows, spark.createDataFrame([(*r, 1, "clash") for r in rows],
                                       "page_id long, url string, html string, kind int, segment string").repartition(partitions)


def test_warc_round_trip(spark):
    rows, pages = odd_pages(spark)
    root = warc.write_archives(pages)
    got = warc.read_archives(spark, root).collect()
    first, want, seen = {}, [], set()
    for k, u, h in rows:
        if len((h or "").encode()) >= 100:
            first[h] = min(k, first.get(h, k))
    for k, u, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and (first[h] != k or (k, h) in seen)
        seen.add((k, h))
        want.append((k, u, "revisit" if revisit else "response", first[h] if revisit else None, len(b), sha(b),
                     None if revisit else b))
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_warc_sql_has_the_same_rule_for_repeated_rows(spark):
    import duckdb

    from vocable.llm.queries import OP2_SQL
    rows, pages = odd_pages(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = [tuple(r) for r in warc.archive_round_trip(pages).select(names).collect()]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(got, key=repr) == sorted(con.execute(f"select {', '.join(names)} from ({OP2_SQL})").fetchall(), key=repr)


def test_warc_is_read_in_as_many_tasks_as_segments(spark):
    root = warc.write_archives(spark.read.parquet(f"{SF01}/pages.parquet"), segment_bytes=60_000)
    segments = spark.read.parquet(f"{root}/manifest").select("segment").distinct().count()
    back = warc.read_archives(spark, root)
    per_task = back.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert segments > 4 and sum(n > 0 for n in per_task) == segments
    with pytest.raises(ValueError, match="raise segment_bytes"):
        warc.write_archives(spark.range(9).selectExpr("id as page_id", "'u' as url", "repeat('x', 2000000) as html"), segment_bytes=1)


def test_warc_files_are_the_same_whatever_the_partitions(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    files = []
    for n in (1, 5):
        root = warc.write_archives(pages.repartition(n), segment_bytes=60_000, roll_bytes=20_000)
        m = spark.read.parquet(f"{root}/manifest").collect()
        assert max(r.n_bytes for r in m) <= 20_000 or any(r.n_records == 1 for r in m)
        files.append(sorted((r.file, r.n_records, r.n_bytes, r.file_sha256) for r in m))
    assert files[0] == files[1] and len({f[0].split("-")[0] for f in files[0]}) > 2 and len(files[0]) > 4
    assert sum(f[1] for f in files[0]) == pages.count()


def test_warc_uncommitted_and_damaged_files(spark):
    _, pages = odd_pages(spark)
    root = warc.write_archives(pages)
    fs, path = warc.filesystem(root)
    with fs.open_output_stream(f"{path}/data/99999999-00000.warc.gz", compression=None) as f:      # not in the manifest
        f.write(b"rubbish")
    assert warc.read_archives(spark, root).count() == 12
    name = spark.read.parquet(f"{root}/manifest").first().file
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        data = f.read()
    member = next(warc._members(pa.BufferReader(data)))
    with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(warc.gzip_member(member.replace(b"short", b"shirt")) + data[len(warc.gzip_member(member)):])
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, root).collect()


def test_warc_empty_table(spark):
    _, pages = odd_pages(spark)
    assert warc.archive_round_trip(pages.where("page_id > 99")).count() == 0


# ---------------------------------------------------------------- HTML

@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("only text", "only text"), ("<p>a &lt; b &amp;amp; c &#233;</p>", "a < b &amp; c é"),
    ("<p>one<br>two\n\t three</p><p></p><p>four", "one two three\nfour"),
    ("<html><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>Text, with words.</p><aside>x</aside></article>"
     "<footer>f</footer></html>", "T\nText, with words."),
    ("<article><p>Body text, quite long, and more.</p><div id=comments><p>I say, no.</p></div>"
     "<form><p>Name</p></form><script>var a='<p>x</p>';</script></article>", "Body text, quite long, and more."),
    ("<div class='cookie-notice'><p>We use cookies, really, a lot of them.</p></div><div class=post><p>Real text, here.</p>"
     "<p>More, of it.</p></div><div class=sidebar><p>Popular, posts.</p></div>", "Real text, here.\nMore, of it."),
    ("<p>open <b>bold<p>next</i> <a href='>'>link</a> end", "open bold\nnext link end"),
    ("<!-- c --><p>x</p><!-- open", "x"),
])
def test_tag_path_cases(page, text):
    assert tag_path.extract(page) == text


LONG = "A sentence of the article, with some words. Another one, to make it long enough."


@pytest.mark.parametrize("opening", [
    "<h2 id='search-algorithms'>", "<section id='related-work'>", "<section id='legal-form'>", "<p id='notice-of-appeal'>",
    "<div class='ad-hoc-networks'>", "<div data-id='comments'>", "<p data-role='navigation'>", "<div title='class=ad'>",
    "<p class=notice>", "<section class='text' id=comments>"])
def test_tag_path_names_inside_the_article(opening):
    """Names that hold a word of boilerplate somewhere take no text away."""
    tag = re.match("<([a-z0-9]+)", opening)[1]
    page = f"<div class=post><p>{LONG}</p>{opening}Some text, {LONG}</{tag}><p>{LONG}</p></div>"
    assert tag_path.extract(page) == f"{LONG}\nSome text, {LONG}\n{LONG}"


def test_tag_path_inline_names_and_reference_lists():
    page = (f"<article><p>{LONG} It is <em class='notice'>not</em> cut.</p><p>{LONG}</p><h2>References</h2>"
            "<ol><li><a href=a>First work</a></li><li><a href=b>Second work</a></li></ol></article>")
    assert tag_path.extract(page) == f"{LONG} It is not cut.\n{LONG}\nReferences\nFirst work\nSecond work"
    for name in ("class='ad'", "class=sidebarRight", "class='x cookie-notice'", "id=comments", "class='widget-area'"):
        page = f"<div {name}><p>{LONG}</p></div><div class=post><p>{LONG}</p><p>More. {LONG}</p></div>"
        assert tag_path.extract(page) == f"{LONG}\nMore. {LONG}"


@pytest.mark.parametrize("page", [
    "<div><h1>Title</h1><p>Lead</p><div class=part>{0}{0}{0}{0}</div><div class=part>{0}</div></div>",
    "<div><h1>Title</h1><p>Lead</p><div class=one>{0}{0}{0}{0}</div><div class=two>{0}</div></div>",
    "<div><p>{0}</p><table><tr><td>{0}{0}{0}{0}{0}<td>{0}{0}{0}</table><p>{0}</p></div>",
    "<div><p>{0}</p><ul><li>{0}{0}<li>{0}{0}<li>{0}{0}</ul><p>{0}</p></div>",
    "<body><article><p>{0}</p><p>{0}</p><p>{0}</p></article><article><h1>Second</h1><p>{0}</p><p>{0}</p></article></body>",
    "<main><h1>Title</h1><p>Lead</p><article><p>{0}</p><p>{0}</p></article></main>",
    "<body><article><p>{0}</p><p>{0}</p><p>{0}</p></article><div class=part><p>{0}</p><p>{0}</p></div></body>",
    "<body><h1>Title</h1><p>Lead</p><div class=a><p>{0}</p></div><h2>Next</h2><div class=b><p>{0}</p></div></body>"])
def test_tag_path_keeps_every_section(page):
    """Nothing here is boilerplate: the text is all of the page, whichever element holds most of it."""
    page = page.format(LONG + " ")
    want = re.sub(r"<[^>]*>", " ", page).split()
    assert tag_path.extract(page).split() == want
    menu = "<nav><a href=x>Menu</a></nav>"
    assert tag_path.extract(menu + page + "<div class=sidebar><ul><li><a href=y>Other</a></ul></div>").split() == want


ARTICLE = f"<h1>Title</h1><p>{LONG}</p><h2>Part</h2><p>{LONG} More of it, {LONG}</p><p>Short end.</p>"
WANT = ["Title", LONG, "Part", f"{LONG} More of it, {LONG}", "Short end."]
WORDPRESS = ("<ol class='commentlist'>" + "".join(
    f"<li class='comment even' id='comment-{i}'><article class='comment-body'><footer class='comment-meta'><b class='fn'>Ann {i}</b> says: "
    f"<time>May {i}, 2021 at 10:0{i} am</time></footer><div class='comment-content'><p>What a fine text, I read it {i} times. Thank you, it helped me a lot.</p></div>"
    f"<div class='reply'><a href='#r{i}' class='comment-reply-link'>Reply</a></div></article></li>" for i in range(1, 6)) + "</ol>")
DISQUS = ("<div id='disqus_thread'><div class='thread'><h3>4 Comments</h3>" + "".join(
    f"<div class='post'><span class='author'>user{i}</span> <a class='time-ago'>{i} days ago</a><div class='post-message'><p>I don't agree with this at all, number {i}.</p></div>"
    f"<ul><li><a href='#'>Reply</a></li><li><a href='#'>Share</a></li></ul></div>" for i in range(4)) + "</div></div>")
NAMELESS = "<div class='x1'>" + "".join(
    f"<div class='x2'><div class='x3'>Bob, 2021-05-0{i}</div><div class='x4'>A remark of some length about the text above, and one more.</div>"
    f"<div class='x5'><a href=#>Antworten</a></div></div>" for i in range(1, 5)) + "</div>"


@pytest.mark.parametrize("thread", [
    WORDPRESS, DISQUS, NAMELESS, f"<section id=comments><h2>Comments</h2>{WORDPRESS}</section>",
    "<section id=comments><h2>3 comments</h2><p>bob: I liked it.</p><p>al: me too!</p></section>",
    "<div class='user-discussion'><p>First! Great.</p><p>I think so too.</p><p>Me as well.</p></div>",
    "<section id=comments><div><b>kim</b> <time>10:22</time></div><p>nice text</p><a href=#>reply</a><form><textarea></textarea></form></section>",
    "<div class='related-posts'><h3>More for you</h3><ul><li><a href=a>Another page</a></li><li><a href=b>A third page of ours</a></li></ul></div>",
    "<p class='share'>Share this: <a href=t>Twitter</a> <a href=f>Facebook</a></p>",
    "<ol class='commentlist'><li>Nice one!</li><li>Where can I get this?</li></ol>"])
@pytest.mark.parametrize("frame", ["<body><article>{0}</article>{1}</body>", "<body><main>{0}{1}</main></body>", "<body><div class=post>{0}</div><div class=more>{1}</div></body>",
                                   "<body><article>{0}{1}</article></body>"])
def test_tag_path_leaves_reader_comments_out(frame, thread):
    assert tag_path.extract(frame.format(ARTICLE, thread)).split("\n") == WANT


def test_tag_path_comments_that_are_the_text():
    """Articles about comments stay, and so does a forum thread that is all there is."""
    page = f"<body><article><h1>On comments</h1><section id='comments'><h2>Comments in source code</h2><p>{LONG}</p><p>{LONG}</p></section><h2>End</h2><p>{LONG}</p></article></body>"
    assert tag_path.extract(page).split("\n") == ["On comments", "Comments in source code", LONG, LONG, "End", LONG]
    events = "".join(f"<div class=event><h3>Event {i}</h3><p>On 2021-05-0{i}, {LONG}</p></div>" for i in range(1, 5))
    assert tag_path.extract(f"<body><main>{events}</main></body>").count(LONG) == 4
    forum = "<body><div class=topic>" + "".join(
        f"<div class=post><div class=author>Bob {i}</div><div class=date>2021-05-0{i}</div><div class=body>{LONG}</div><a href=#>Reply</a></div>" for i in range(1, 5)) + "</div></body>"
    assert tag_path.extract(forum).count(LONG) == 4


@pytest.mark.parametrize("unit", ["<div>x", "<a", '<a ">', '<a ">"', "<a '", "<svg>", "</foo>x", "<a><div></a>x", "<ul><li>x", "<span><div>x", "<article>x",
                                  "<table><tr><td>x", "<div class=comment>x<b>"])
def test_tag_path_is_linear_in_broken_and_deep_pages(unit):
    """A megabyte; four times the page takes about four times as long."""
    took = []
    for size in (250_000, 1_000_000):
        page = unit * (size // len(unit)) + ">"
        start = time.process_time()
        tag_path.extract(page)
        took.append(time.process_time() - start)
    assert took[1] < 12 and took[1] < 8 * took[0] + 0.5


def test_tag_path_on_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    src = {r.page_id: r.html for r in pages.collect()}
    for r in tag_path.main_text(pages).collect():
        body = src[r.page_id].split("<article>", 1)[1].split("</article>")[0].replace("<br>", " ")
        want = [" ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_tag_path_awkward_rows(spark):
    rows, pages = odd_pages(spark)
    assert tag_path.main_text(pages).count() == len(rows)
    assert tag_path.main_text(pages.where("page_id > 99")).count() == 0


# ---------------------------------------------------------------- rules

def test_rule_measurements_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    for t in [r.text for r in docs] + [r[1] for r in odd_rows()]:
        got = {k: int(v[0]) for k, v in rule_ledger.measure(pa.array([t], pa.string())).items()}
        assert {k: got[k] for k in rules(t)} == rules(t)


def test_rule_ledger_policies_and_ablation(spark):
    led = rule_ledger.ledger(spark.read.parquet(f"{SF01}/documents.parquet"), keep=["doc_id"]).cache()
    bits = [r.fail_bits for r in led.collect()]
    mask = rule_ledger.POLICIES["v1"]
    for r in rule_ledger.ablation(led).collect():
        bit = rule_ledger.BIT[r.rule]
        assert r.n_failed == sum(b & bit != 0 for b in bits)
        assert r.n_failed_only == sum(b & mask == bit for b in bits)
        assert r.n_kept_without == sum(b & (mask ^ bit) == 0 for b in bits)
    kept = rule_ledger.apply_policy(led).where("kept").count()
    assert kept == sum(b & mask == 0 for b in bits)


def test_rule_ledger_awkward_rows(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r for r in rule_ledger.quality_ledger(docs).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[8].kept is not None
    good = rule_ledger.keep_good(docs)
    assert good.columns == docs.columns and all(r.n_words == "clash" for r in good.collect())
    assert rule_ledger.quality_ledger(odd_docs(spark, [])).count() == 0


# ---------------------------------------------------------------- packing

def check_packing(rows, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    ids = {k: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for k, t in docs}
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, x in pieces.items():
        n = sum(1 for d, _ in docs if d == k)
        assert sum(length for _, length in x) == n * len(ids[k])
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
    assert set(pieces) == set(ids)


def test_packing_keeps_every_id_once(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    check_packing(bm25_packing.retrieval_packing(docs, WORD_BPE).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    rows = [r for r in odd_rows() if r[0] is not None]
    check_packing(bm25_packing.retrieval_packing(odd_docs(spark, rows), WORD_BPE).collect(), [(r[0], r[1]) for r in rows])
    assert bm25_packing.retrieval_packing(odd_docs(spark, []), WORD_BPE).count() == 0


def test_words_are_looked_up_as_the_tokenizer_encodes_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    texts = ["It's we'll 'tis x's. U.S.A., end.", "İstanbul ΣΑΣ é. Å x́.", "<|endoftext|>. <|ENDOFTEXT|>, a<|startoftext|>b",
             "…. a…. 12.5, 3.", " a b.　c", "漢字。 😀!! :-) a.b.c ...", "", None, "Straße. ÀÉ, ﬁ. KK."]
    for chunk in ([t] for t in texts):
        ids, n = bm25_packing.WordCache(WORD_BPE).encode(pa.array(chunk, pa.string()))
        assert ids.tolist() == tok.encode(chunk[0] or "", add_special_tokens=False).ids


def test_bm25_scores():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint32) for _ in range(25)]
    index, q = bm25_packing.Bm25(docs), docs[3]
    avg = np.mean([len(d) for d in docs])
    for d, got in zip(docs, index.scores(q)):
        want = 0.0
        for t in set(q.tolist()):
            df, tf = sum(t in x for x in docs), (d == t).sum()
            idf = max(0.0, np.log((len(docs) - df + 0.5) / (df + 0.5)))
            want += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        assert got == pytest.approx(want)


def test_term_counts_are_those_of_all_documents(spark):
    """Counts and mean length against plain counting; a text draws the same term in any chunk."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    ids = [np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    table, corpus = bm25_packing.tokenised(docs.repartition(5), WORD_BPE, 2)
    n, tokens, df = corpus.n, corpus.tokens, corpus.df
    assert table.count() == n
    want = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=len(df))
    assert (n, tokens) == (len(ids), sum(map(len, ids))) and df.tolist() == want.tolist()
    sig = corpus.signatures(np.concatenate(ids), np.array([len(x) for x in ids]))
    one = [corpus.signatures(x, np.array([len(x)]))[0] for x in ids]
    assert sig.tolist() == one and len(set(one)) > len(ids) // 4
    assert corpus.signatures(np.zeros(0, np.int64), np.zeros(3, np.int64)).tolist() == [np.iinfo(np.int64).max] * 3


def test_packer_prefers_lexical_neighbours():
    a, b = np.arange(100, 400, dtype=np.uint32), np.arange(5000, 5300, dtype=np.uint32)
    docs = [a, b, a[:200], b[:200], a[100:], b[50:], np.arange(9000, 9100, dtype=np.uint32), np.arange(9200, 9300, dtype=np.uint32)]
    p = bm25_packing.Packer(512, 0)
    p.shard(list(range(8)), docs)
    p.finish()
    rows = p.take().to_pylist()
    assert [r["doc_id"] for r in rows if r["sequence_id"] == 0] in ([0, 2, 4], [0, 4, 2], [0, 4])


# ---------------------------------------------------------------- sentencepiece

ODD = ["", "a", " a", "a ", "  a  b  ", "\n\n x\t y", "é😀 漢字 \x00z", "<s> </s> <unk> <0x41>", "a" * 5000, " " * 40 + "x", "a ▁ b"]


def test_sentencepiece_ids_match_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    src = {r.doc_id: r.text for r in docs.collect()}
    for r in sentencepiece_codec.sentencepiece_codec(docs, PIECES).collect():
        assert r.ids == sp.encode(src[r.doc_id]) and r.decoded == src[r.doc_id] and r.round_trip and r.parity
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    odd = odd_docs(spark)
    for r in sentencepiece_codec.sentencepiece_codec(odd, PIECES, verify=False).collect():
        assert r.parity is None
    assert sentencepiece_codec.sentencepiece_codec(odd_docs(spark, []), PIECES).count() == 0


def small_model(kind, **normaliser):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, True
    for k, v in normaliser.items():
        setattr(m.normalizer_spec, k, v)
    for name, typ in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=name, score=0, type=typ)
    for i in range(256):
        m.pieces.add(piece=f"<0x{i:02X}>", score=0, type=6)
    for i, p in enumerate(["▁", "▁a", "b", "c", "a", "ab", "▁ab", "bc", "abc", "▁abc", "cc", "bcc", "d", "dd", "▁d", "é"]):
        m.pieces.add(piece=p, score=-1.0 - 0.3713 * ((i * 7) % 16) ** 1.13, type=1)
    return m.SerializeToString()


@pytest.mark.parametrize("kind", [sentencepiece_codec.UNIGRAM, sentencepiece_codec.BPE])
@pytest.mark.parametrize("fold", [False, True])
def test_sentencepiece_rebuilds_both_model_types(kind, fold):
    import sentencepiece

    data = small_model(kind, add_dummy_prefix=True, remove_extra_whitespaces=fold, escape_whitespaces=True)
    codec, sp = sentencepiece_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["".join(x) for n in range(1, 5) for x in itertools.product("abc d", repeat=n)] + ["abcc ddé zab", "x" * 9]
    ids, n, same = codec.encode(pa.array(texts))
    want = [sp.encode(t) for t in texts]
    got = np.split(ids, np.cumsum(n)[:-1])
    wrong = [t for t, a, b in zip(texts, got, want) if a.tolist() != b]
    assert not wrong and same.all()
    assert codec.decode([x for x in want]) == [sp.decode(x) for x in want]


def test_sentencepiece_odd_texts():
    import sentencepiece

    data = open(PIECES, "rb").read()
    codec, sp = sentencepiece_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in ODD:
        ids, _, same = codec.encode(pa.array([t]))
        assert ids.tolist() == sp.encode(t) and same.all() and codec.decode([ids.tolist()])[0] == t.replace("▁", " ")


def test_sentencepiece_parity_sees_whole_texts(monkeypatch):
    """Words that are encoded well but cut or joined wrongly are no parity."""
    codec = sentencepiece_codec.Codec(open(PIECES, "rb").read())
    texts = pa.array(["one two three", None, "", "two  three one "])
    assert codec.encode(texts)[2].tolist() == [True] * 4
    right = sentencepiece_codec.Codec._words
    monkeypatch.setattr(sentencepiece_codec.Codec, "_words", staticmethod(lambda t: tuple(x[1:] for x in right(t))))
    assert codec.encode(texts)[2].tolist() == [False, True, True, True]


# ---------------------------------------------------------------- classifiers

def held_out(spark, scores, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    return [(r.predicted, labels[r.doc_id]) for r in scores.collect() if r.held_out and r.doc_id in labels]


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_crf.quality(docs, labels)
    pairs = held_out(spark, out, "quality")
    assert np.mean([a == b for a, b in pairs]) > 0.93
    assert out.where("score < 0 or score > 1").count() == 0 and out.count() == docs.count()


def test_quality_awkward_rows(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    none = quality_crf.quality(odd_docs(spark), labels.where("doc_id < 0"))
    assert {r.score for r in none.collect()} == {0.5} and none.count() == len(odd_rows())
    odd_labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (8, None, 1), (None, 1, 1), (17, 0, 1), (20, 1, 0)],
                                       "doc_id long, quality int, toxic int")
    assert quality_crf.quality(odd_docs(spark), odd_labels).count() == len(odd_rows())
    assert toxicity_ftrl.toxicity(odd_docs(spark), odd_labels).count() == len(odd_rows())
    assert quality_crf.quality(odd_docs(spark, []), labels).count() == 0
    assert toxicity_ftrl.toxicity(odd_docs(spark, []), labels).count() == 0


def test_forward_backward_against_all_label_sequences():
    rng = np.random.default_rng(4)
    n_lines = np.array([3, 1, 5])
    node, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    p, pairs = quality_crf.marginals(n_lines, node, trans, True)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in n_lines:
        z, good, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum(node[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            z += s
            good += s * np.array(y)
            for i in range(n - 1):
                both[y[i], y[i + 1]] += s
        want += list(good / z)
        want_pairs += both / z
        at += n
    assert p == pytest.approx(np.array(want)) and pairs == pytest.approx(want_pairs)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity_ftrl.toxicity(docs, labels)
    pairs = held_out(spark, out, "toxic")
    assert np.mean([a == b for a, b in pairs]) > 0.9 and sum(a > b for a, b in pairs) <= 2
    keys, w, _ = toxicity_ftrl.train(docs, labels)
    assert 0 < len(keys) < 20_000 and (np.diff(keys) > 0).all() and (w != 0).all()


def test_ftrl_learns_a_separating_feature_and_stays_sparse():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600)
    rows = [np.unique(np.r_[rng.integers(1, 400, 6), [0] if t else [], 400]).astype(int) for t in y]
    w, bias = toxicity_ftrl.ftrl(rows, y.astype(float), 400)
    assert w[0] > 2 and bias < 0 and (w != 0).sum() < 100


def test_clashing_names_are_used(spark):
    assert set(CLASHING) <= set(odd_docs(spark).columns) and norm(" a\t\tb ") == " a b "


def test_ftrl_against_plain_coordinates():
    """The published update, one coordinate at a time, on dictionaries."""
    rng = np.random.default_rng(4)
    rows = [np.append(np.unique(rng.integers(0, 60, rng.integers(3, 25))), 80) for _ in range(400)]
    y = np.array([float(3 in r or (7 in r and 9 in r)) for r in rows])
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= toxicity_ftrl.L1:
            return 0.0
        sign = 1.0 if zi > 0 else -1.0
        return -(zi - sign * toxicity_ftrl.L1) / ((toxicity_ftrl.BETA + n.get(i, 0.0) ** 0.5) / toxicity_ftrl.ALPHA + toxicity_ftrl.L2)

    for _ in range(toxicity_ftrl.EPOCHS):
        for r, t in zip(rows, y):
            w = {i: weight(i) for i in r}
            g = 1 / (1 + np.exp(-sum(w.values()))) - t
            for i in r:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity_ftrl.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    w, bias = toxicity_ftrl.ftrl(rows, y, 80)
    assert np.allclose(w, [weight(i) for i in range(80)], atol=1e-9) and np.isclose(bias, weight(80), atol=1e-9)
    assert (w == 0).sum() > 30 and w[3] > 0


def test_crf_gradient_against_finite_differences():
    """Labels minus expectations is the slope of the log-likelihood, which is summed over all label sequences here."""
    rng = np.random.default_rng(2)
    n_lines, y = np.array([3, 1, 4, 2]), np.array([1, 0, 0, 1])
    x, w, trans = rng.normal(size=(10, 3)), rng.normal(size=3), rng.normal(size=(2, 2))

    def likelihood(w, trans):
        node, total = x @ w, 0.0
        for a, k, label in zip(np.cumsum(n_lines) - n_lines, n_lines, y):
            def value(path):
                return sum(node[a + i] * v for i, v in enumerate(path)) + sum(trans[u, v] for u, v in itertools.pairwise(path))
            total += value([label] * k) - np.log(sum(np.exp(value(p)) for p in itertools.product((0, 1), repeat=int(k))))
        return total

    p, pairs = quality_crf.marginals(n_lines, x @ w, trans, True)
    edges = n_lines - 1
    seen = np.diag([edges[y == 0].sum(), edges[y == 1].sum()])
    step = 1e-5
    for got, at in ((x.T @ (np.repeat(y, n_lines) - p), w), (seen - pairs, trans)):
        for i in np.ndindex(at.shape):
            at[i] += step
            up = likelihood(w, trans)
            at[i] -= 2 * step
            down = likelihood(w, trans)
            at[i] += step
            assert abs((up - down) / (2 * step) - got[i]) < 1e-6
