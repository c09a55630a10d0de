"""The registered queries themselves, over whole tables, against plain versions that share no code with them."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq

from pulsegrid.llm import html_text, packing, secrets, words


def table(sf_dir, name, *columns):
    return pq.read_table(f"{sf_dir}/{name}.parquet", columns=list(columns)).to_pylist()


def fresh_tokenizer():
    """The library's own tokenizer as the files' description sets it up, with nothing of this repository."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    return library


def test_word_ids_equal_a_fresh_tokenizer(sf_dir):
    own, library = words.WordIds(public_tokenizers.path("word_bpe_49k.json")), fresh_tokenizer()
    rng = np.random.default_rng(2)
    letters = [*"abcdefgh  \t\n'''.,;:!?-_$%&()[]{}#0123456789ABÉéüßçÖñ|<>/\\^~`\"", "​", "ſ", "İ", "漢", "é", "\xa0", "…", "’"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    texts += ["don't can't we'll'd ...'s", "x" * 5000, "hello <|endoftext|> world <|startoftext|>", "", "  ", "a.b.c,,, ((d))", "ÀÉ Ŀ ŉ", "1st 22nd 3.14%"]
    texts += [r["text"] or "" for r in table(sf_dir, "documents", "text")]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    assert own.encode(texts[::-1]) == want[::-1]


def test_op2_equals_a_plain_version(spark, sf_dir):
    """Every column but the places, from the library's ids; the places are gapless and the sequences few."""
    library, want = fresh_tokenizer(), {}
    for r in table(sf_dir, "documents", "doc_id", "text"):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[r["doc_id"], k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    rows = packing.op2_best_two_fit(spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(n for _, n, _ in want.values()) // 2048) * 1.01 + 1


def test_equal_rows_are_dealt_to_many_groups(spark):
    pieces = spark.range(3000).selectExpr("1L AS doc_id", "0 AS piece", "0L AS start", "700L AS length")
    packed = packing.pack_pieces(pieces, 40 * packing.GROUP_DOCS)
    assert packed.selectExpr("sequence_id >> 32 AS g").distinct().count() > 30 and packed.count() == 3000


def test_op5_equals_the_articles(spark, sf_dir):
    """Every page of the table has its main text in an element; the query, which knows nothing of that, gives the same text."""
    import html
    import re

    want = {}
    for r in table(sf_dir, "pages", "page_id", "url", "html"):
        body = re.search(r"(?s)<article>(.*)</article>", r["html"] or "")
        text = re.sub(r"</?(?:p|h\d|li|ul|blockquote)\b[^>]*>", "\0", body[1] if body else "")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x.replace("<br>", " "))).split()) for x in text.split("\0")]
        want[r["page_id"]] = (r["url"], "\n".join(x for x in parts if x))
    got = html_text.op5_recurrent_block_labeller(spark, sf_dir).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_blocks_lose_no_text():
    words = lambda page: " ".join(b.text for b in html_text.blocks(page))
    assert words("a <math>x=2</math> b <noscript>c</noscript> <textarea>d</textarea><object>e</object> <video>f</video>") == "a x=2 b c d e f"
    assert words("<p>before</p><svg><path/><p>after</p>") == "before after"
    assert words("<script>no</script>x<style>no</style>y<iframe>no</iframe>z") == "x y z"
    assert words('<p title="a > b">one</p><p title="never closed>two</p>') == "one two"
    assert words("<head><meta x><p>body text") == "body text"


def test_blocks_take_linear_time():
    import time

    for unit in ("<a \"", "<a x=\"", "<a x=\"b>", "<!", "</", "<p <p", "<div>"):
        times = []
        for n in (20_000, 80_000):
            begin = time.process_time()
            html_text.blocks(unit * n)
            times.append(time.process_time() - begin)
        assert times[1] < 12 * max(times[0], 0.05), unit


def test_articles_without_their_element():
    net = html_text.labeller()
    long = "A paragraph of the article itself, which has several words in it, and ends with a stop."
    menu = "<ul class=qzx><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>About us</a></ul>"
    after = "<section class=comments><h3>Comments</h3><div class=comment><p>Nice post!</p></div></section><div class=footer>&copy; 2020 Owner</div>"
    for start, end in (("<div id=main>", "</div>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div class=story>", "</div>")):
        for n in (1, 2, 6):
            page = f"<html><body>{menu}{start}{f'<p>{long}</p>' * n}{end}{after}</body></html>"
            assert html_text.main_texts([page], net) == ["\n".join([long] * n)], (start, n)


def test_op8_base_part_equals_a_plain_version(spark, sf_dir):
    """Counts, hash and spans of the whole table, from patterns written apart; decoding only adds spans."""
    import hashlib
    import re

    kinds = {"assign": r"""(?ai:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", "access": r"(AKIA[A-Z0-9]+)", "hex": r"([0-9a-f]+)"}
    least, rank = {"assign": 6, "access": 20, "hex": 24}, {"assign": 0, "access": 1, "hex": 2}
    rows = {r["doc_id"]: r for r in secrets.op8_secret_scan(spark, sf_dir).collect()}
    docs = table(sf_dir, "documents", "doc_id", "text")
    assert len(rows) == len(docs)
    for r in docs:
        text = r["text"] or ""
        base = sorted((m.start(), rank[k], m.end(), k) for k, p in kinds.items() for m in re.finditer(p, text) if len(m[1]) >= least[k])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        got = rows[r["doc_id"]]
        assert [got["n_assign"], got["n_access"], got["n_hex"]] == [sum(x[3] == k for x in base) for k in kinds]
        assert got["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got["spans"].split(","))


def test_secret_in_binary_data():
    import base64
    import gzip

    noise = np.random.default_rng(1).integers(0, 256, 5000, np.uint8).tobytes()
    raw = noise + b" password=hunter2abc " + noise
    for payload in (raw, gzip.compress(raw)):
        text = f"a {base64.b64encode(payload).decode()} z"
        assert any(k == "assign" for k, _, _ in secrets.all_spans(text)[1])


def test_op4_scores_and_held_out_accuracy(spark, sf_dir):
    from pulsegrid.llm import quality

    got = {r["doc_id"]: r for r in quality.op4_subword_quality(spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(sf_dir, "labels", "doc_id", "quality")}
    assert len(got) == len(table(sf_dir, "documents", "doc_id"))
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i in labels if i in got and got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in held) / len(held) > 0.9


def test_one_label_of_many_rows_trains_once(spark):
    from pulsegrid.llm import quality

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other words"), (3, "good words")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id bigint, quality int")
    model, bias = quality.fit(docs, labels)
    assert len(model) == 1 << quality.BITS and np.isfinite(bias)


def test_op10_equals_the_library(spark, sf_dir):
    import hashlib

    import tiktoken

    from pulsegrid.llm import bpe

    ranks = {}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.op10_byte_bpe(spark, sf_dir).collect()}
    docs = table(sf_dir, "documents", "doc_id", "text")
    assert len(got) == len(docs)
    for r in docs:
        ids = np.array(library.encode_ordinary(r["text"] or ""), "<u4")
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
