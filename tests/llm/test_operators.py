"""Each operator against a plain version on small hard tables: nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

import binascii
import hashlib
import html
import io
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillframe.llm import common, induced_sort, packed, pairwise_quality, prefix_join, suffix_tree_lm
from quillframe.llm.block_anchors import passage_digests, without_repeats
from quillframe.llm.common import Words
from quillframe.llm.exact_digest import canonical, digest, fingerprints
from quillframe.llm.induced_sort import repeat_starts
from quillframe.llm.prefix_join import near_duplicates
from quillframe.llm.rank_bpe import encode_decode, tokenizer
from quillframe.llm.site_style import Page, extract
from quillframe.llm.suffix_dedup import repeated_bytes
from quillframe.llm.token_files import FrameReader, FrameWriter, token_files
from quillframe.llm.winnow import decontaminate, overlaps

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, block string, body string, score double"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def corpus(seed=1, n=120):
    dice = random.Random(seed)
    words = ["".join(dice.choice("abcdeé") for _ in range(dice.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(dice.choice(words) for _ in range(k))
    passage, long_ = text(60), text(20_000)
    out = [None, "", " \n\t ", "one", "Two words", "x" * 5000, "na " * 700, long_, long_[100:60_000], passage, "😀" * 150 + " fin", "À À ﬁ Straße STRASSE", "a\x00b\x1c c"]
    for k in range(n):
        kind = k % 6
        body = text(dice.choice([3, 12, 40, 150]))
        if kind == 0:
            body = f"{body}\n{passage}\n{text(10)}"
        elif kind == 1 and out[-1]:
            body = out[-1]
        elif kind == 2:
            base = text(120).split()
            out.append(" ".join(base))
            base[dice.randrange(len(base))] = "changed"
            body = " ".join(base)
        out.append(body)
    return [(i * 3 % 1009, t) for i, t in enumerate(out)]


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "clash", "clash", 0.5) for i, t in rows], SCHEMA).repartition(parts)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, r)
    return out


def compare(df, want):
    got = by_id(df)
    assert set(got) == set(want)
    for k, w in want.items():
        assert {c: got[k][c] for c in w} == w, k


# ------------------------------------------------------------------------ 1
def test_token_files(spark, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = {}, 0
    for i, t in sorted(DOCS):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = {"start": at, "n_tokens": len(ids), "ids_crc32": binascii.crc32(np.array(ids, "<u4").tobytes())}
        at += len(ids)
    compare(token_files(spark, docs, public_tokenizers.path("word_bpe_49k.json")), want)


def test_chunks_encode_like_the_library():
    from quillframe.llm.token_files import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own, dice = Tokenizer.from_file(path), encoder(path), random.Random(6)
    texts = ["".join(dice.choice(" ab\n.,'sTÉ1²\x1cH\u0331J\u030cKΣİ<|>\t\u3000ez") for _ in range(dice.randint(0, 40))) for _ in range(800)]
    texts += ["x<|endoftext|>y <|ENDOFTEXT|>", "it's I'LL don't.", "Straße, STRASSE.", "ΣΑΣ Σας", "W\u030aord T\u0308"]
    assert [np.frombuffer(own(t), own.kind).tolist() for t in texts] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_ties_nulls_and_no_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(tuple(r)[:3] for r in token_files(spark, frame(spark, [(5, "b"), (5, "b"), (5, "a c"), (None, "z")]), path).collect() if r.doc_id)
    assert got == [(5, 2, 3), (5, 5, 2), (5, 7, 2)]
    assert token_files(spark, frame(spark, []), path).count() == 0


def test_frames_are_independent_and_checked():
    sink = io.BytesIO()
    sink.close = lambda: None
    w = FrameWriter(sink, 4)
    parts = [np.arange(k, dtype="<u4") for k in (0, 5, 70_000)]
    for k, p in enumerate(parts):
        w.add(k, p.tobytes())
    w.close()
    raw = bytearray(sink.getvalue())
    r = FrameReader(io.BytesIO(raw))
    assert [len(x) for x in r] == [0, 5, 70_000] and (r.document(2) == parts[2]).all() and r.doc_ids.tolist() == [0, 1, 2]
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(p.tobytes() for p in parts)  # any decoder reads it
    raw[-25] ^= 1  # the third document's checksum: footer of 9 bytes, two entries of 12, its last field
    r = FrameReader(io.BytesIO(raw))
    assert len(r.document(1)) == 5
    with pytest.raises(ValueError, match="checksum"):
        r.document(2)


# ------------------------------------------------------------------------ 2
def brute_bytes(rows, length=200):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = {}
    for k, t in rows:
        f = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                f[i : i + length] = b"\1" * length
        out[k] = {"n_bytes": len(t), "n_removed": sum(f), "n_spans": len(re.findall(b"\1+", bytes(f))), "kept_sha256": hashlib.sha256(bytes(x for x, y in zip(t, f, strict=True) if not y)).hexdigest()}
    return out


def test_suffix_dedup(docs):
    compare(repeated_bytes(docs), brute_bytes([(i, (t or "").encode()) for i, t in DOCS]))


def test_suffix_dedup_short_length_repeated_rows_no_rows(spark):
    rows = [(1, "abcabcabcd"), (2, "zzbcabz"), (3, None), (4, "ab"), (5, "aaaaaaaa")]
    compare(repeated_bytes(frame(spark, rows), 4), brute_bytes([(i, (t or "").encode()) for i, t in rows], 4))
    twice = repeated_bytes(frame(spark, [(1, "q" + "w" * 30), (1, "q" + "w" * 30)]), 10).collect()
    assert [r.n_removed for r in twice] == [31, 31]
    assert repeated_bytes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [0, 1, 3])
def test_suffix_dedup_hot_passages(spark, hot):
    dice = random.Random(hot)
    noise = lambda k: "".join(dice.choice("ab cdeé") for _ in range(k))
    line, pair = noise(150), noise(90)
    rows = [(i, (noise(90), pair)[i % 4 == 0] + line + noise(dice.choice([0, 7, 200])) + line * (i % 5 == 0)) for i in range(60)]
    rows += [(100, None), (101, line), (102, line + line)]
    compare(repeated_bytes(frame(spark, rows, 6), hot=hot), brute_bytes([(i, (t or "").encode()) for i, t in rows]))
    short = [(i, noise(3) + "abcdefgh" + noise(3)) for i in range(40)]
    compare(repeated_bytes(frame(spark, short, 6), 10, hot), brute_bytes([(i, t.encode()) for i, t in short], 10))


@pytest.mark.parametrize("seed", range(6))
def test_induced_sort(seed):
    dice = random.Random(seed)
    for _ in range(60):
        length, letters = dice.choice([1, 2, 3, 7]), dice.choice([b"ab", b"a", b"abc", bytes(range(256)), b"\0\1\xff"])
        strings = [bytes(dice.choice(letters) for _ in range(dice.randint(0, 50))) for _ in range(dice.randint(1, 6))]
        c = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[c[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
        assert [x.tolist() for x in repeat_starts(strings, length, dice.choice([0, 1 << 30]))] == want  # in files, in memory


@pytest.mark.parametrize("seed", range(6))
def test_induced_sort_piece_by_piece(monkeypatch, seed):
    dice = random.Random(seed)
    monkeypatch.setattr(induced_sort, "AT_ONCE", dice.choice([1, 2, 5, 16]))
    for _ in range(8):
        letters = [bytes([c]) for c in dice.sample([0, 1, 97, 98, 255], dice.randint(1, 4))]
        strings = [b"".join(dice.choice(letters) for _ in range(dice.randint(0, 60))) for _ in range(dice.randint(1, 6))]
        length = dice.randint(2, 9)
        c = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[c[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
        assert [x.tolist() for x in repeat_starts(strings, length, dice.choice([0, 1 << 30]))] == want


def test_induced_sort_in_files_takes_little_memory(monkeypatch):
    monkeypatch.setattr(induced_sort, "AT_ONCE", 1 << 14)
    raw = np.random.default_rng(3).integers(97, 123, 2_000_000, np.uint8).tobytes()
    strings = [raw[k : k + 300] for k in range(0, len(raw), 300)] * 2
    tracemalloc.start()
    got = repeat_starts(strings, 200, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(x.all() for x in got if len(x))
    assert peak < 8 * len(raw)


# ------------------------------------------------------------------------ 3
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body><header>Site name</header>
<nav><ul><li><a href="/a">Home</a><li><a href='x>y'>About</a></ul></nav><!-- <article>no</article> --><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; &eacute;&#233;&#x1F600; &copy;</h1><p><b>First {n}<br>line<p>Second\n\n  para&nbsp;graph {n} <a href=q>link</a><div class="ad-box">Buy</div><ul><li>One {n}<li>Two</ul>
<table><tr><td>c1<td>c2</table><form><input><p>Search</form><aside>Side</aside><section class="comments"><p>Nice!</section><p>1 < 2 {n}</article>
<div id="sidebar">More</div><footer>Foot</footer></body>"""
TEXT = "Title & éé😀 ©\nFirst {n} line\nSecond para graph {n} link\nOne {n}\nTwo\nc1\nc2\n1 < 2 {n}"


def test_main_text(spark):
    pages = [(k, f"http://h{k % 2}.org/{k}", PAGE.replace("{n}", str(k))) for k in range(12)] + [(90, None, None), (91, "http://h0.org/", ""), (92, "x", "plain & text"), (93, "http://h0.org/q", "<div>" * 3000 + "deep")]
    got = {r.page_id: r for r in extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")).collect()}
    for k in range(12):
        assert got[k].text == TEXT.replace("{n}", str(k))
        assert got[k].n_chars == len(got[k].text) and got[k].url == pages[k][1]
    assert (got[90].text, got[91].text, got[92].text, got[93].text) == ("", "", "plain & text", "deep")
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_without_article(spark):
    body = "<html><body><div><a href=1>Shop</a> <a href=2>News</a> all pages say this</div><div><p>Story number {n} tells of {n} things.</p><p>Then {n} more.</p></div><div>Made with care</div></body></html>"
    got = extract(spark.createDataFrame([(k, "http://site.org/x", body.replace("{n}", str(k))) for k in range(40)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got}[7] == "Story number 7 tells of 7 things.\nThen 7 more."


def test_style_tree_keeps_what_holds_important_blocks(spark):
    paragraphs = "".join(f"<p>Part {k} of story {{n}} tells of {{n}} things.</p>" for k in range(20))
    body = f"<html><body><div>all pages say this</div><div><h1>Story {{n}}</h1>{paragraphs}</div><div>Made with care</div></body></html>"
    copies = "<html><body><div><h1>Copy</h1><p>One text.</p><p>Another text.</p></div></body></html>"
    pages = [(k, "http://long.org/x", body.replace("{n}", str(k))) for k in range(40)] + [(k, f"http://pair.org/{k}", copies) for k in (100, 101)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[7] == "\n".join(["Story 7", *(f"Part {k} of story 7 tells of 7 things." for k in range(20))])
    assert got[100] == got[101] == "Copy\nOne text.\nAnother text."


def test_class_words_do_not_remove_the_main_text():
    text = lambda body: Page(f"<body><div class='sidebar'>Aside</div>{body}<div class=footer>Foot</div></body>").text(lambda k: 1)
    assert text("<div class='content no-sidebar'><article><p>Story</p></article></div>") == "Story"
    assert text("<div id='has-comments'><main><p>Story</p></main><div class='comments'>Nice</div></div>") == "Story"
    assert text("<div class='with-sidebar'><p>A story that is longer than the rest</p><div class='ads'>Buy</div></div>") == "A story that is longer than the rest"
    assert text("<article>Story</article><div class='related'><article>Another story, which is not this</article></div>").split("\n")[0] == "Story"


def test_style_tree_alone_on_many_hosts(spark):
    """No article, no telling tags or names: only what repeats on a host says what is a menu."""
    dice = random.Random(4)
    text = lambda n: " ".join("".join(dice.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for host in range(12):
        menu, notice, foot = [text(2) for _ in range(4)], text(20), text(12)
        for page in range(8):
            body = [text(dice.randint(15, 40)) for _ in range(dice.randint(3, 9))]
            source = f"<div class=k1>{''.join(f'<div><a href=/{k}>{m}</a></div>' for k, m in enumerate(menu))}</div><div class=k2><div>{notice}</div></div><div class=k3>{''.join(f'<div>{b}</div>' for b in body)}</div><div class=k4>{foot}</div>"
            rows.append((host * 100 + page, f"http://h{host}.example/{page}", source))
            want[host * 100 + page] = "\n".join(body)
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_deep_markup_takes_linear_time():
    import time

    start = time.time()
    for source in ("<div>" * 100_000 + "x", "<b>" * 100_000 + "x", "<p>" * 50_000, "<td><p><td>" + "<div>" * 50_000 + "x", "<a href=q>y" * 50_000):
        page = Page(source)
        page.keys(1)
        page.text(lambda k: 1)
    assert time.time() - start < 60


def test_entities_like_the_library():
    for t in ("&amp;lt;", "&notit;", "&#0;", "&#x80;", "&copy2", "&unknown;"):
        assert Page(f"<article>{t}</article>").text(lambda k: 1) == " ".join(html.unescape(t).split())


# ------------------------------------------------------------------------ 4
def brute_tree(rows, depth, least, prior, divergence):
    toks = [(i, [*WORD.findall(lower(t or "")), None]) for i, t in rows]
    train = [t for i, t in toks if zlib.crc32(str(i).encode()) % 10]
    u = Counter(w for t in train for w in t)
    n_all, v = sum(u.values()), len(u)
    kept = {}

    def p(ctx, w):
        for d in range(len(ctx), 0, -1):
            s = ctx[len(ctx) - d :]
            if s in kept:
                return (kept[s][w] + prior * p(s[1:], w)) / (kept[s].total() + prior)
        return (u[w] + 0.1) / (n_all + 0.1 * (v + 1))

    for d in range(1, depth + 1):
        counts = defaultdict(Counter)
        for t in train:
            for i in range(d, len(t)):
                counts[tuple(t[i - d : i])][t[i]] += 1
        new = {}
        for s, c in counts.items():
            n = c.total()
            if n >= least and sum(k * math.log((k - 1 + prior * p(s[1:], w)) / (n - 1 + prior) / p(s[1:], w)) for w, k in c.items()) >= divergence * n:
                new[s] = c
        kept.update(new)
    out = {}
    for i, t in toks:
        out[i] = (len(t), sum(u[w] > 0 for w in t), n_all, sum(math.log10((u[w] + 0.1) / (n_all + 0.1 * (v + 1))) for w in t), sum(math.log10(p(tuple(t[max(0, k - depth) : k]), t[k])) for k in range(len(t))))
    return out, kept


def test_suffix_tree(docs):
    want, kept = brute_tree(DOCS, suffix_tree_lm.DEPTH, suffix_tree_lm.LEAST, suffix_tree_lm.PRIOR, suffix_tree_lm.DIVERGENCE)
    assert any(len(s) == 2 for s in kept)
    got = by_id(suffix_tree_lm.score(docs))
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=3e-4 * n)


def test_suffix_tree_words_unseen_after_frequent_contexts(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(i, "x x zebra x x" if held(i) else "x x y y a b c d " * 1000) for i in range(120)]
    want, kept = brute_tree(rows, suffix_tree_lm.DEPTH, suffix_tree_lm.LEAST, suffix_tree_lm.PRIOR, suffix_tree_lm.DIVERGENCE)
    assert ("x",) in kept and ("x", "x") in kept
    got = by_id(suffix_tree_lm.score(frame(spark, rows)))
    for i, (n, *_, score) in want.items():
        if held(i):
            assert got[i].score == pytest.approx(score, abs=3e-4 * n)  # log10 p(zebra | x x) is below -12


def test_suffix_tree_no_training_rows(spark):
    assert suffix_tree_lm.score(frame(spark, [])).count() == 0
    (r,) = suffix_tree_lm.score(frame(spark, [(None, "a b")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == pytest.approx(0) and r.score == pytest.approx(0)


def test_suffix_tree_memory(spark, monkeypatch):
    """Bytes a token that a task gets and needs besides, where (word, next) pairs are summed up, and those of the words' counts."""
    dice = random.Random(5)
    rows = [(i, " ".join(f"w{dice.randrange(3000 if dice.random() < 0.9 else 1 << 40)}" for _ in range(400))) for i in range(1500)]
    n_tokens = 401 * len(rows)
    taken = {}

    def answer(asked, reply, parts, name, **kw):
        bodies = [bytes(r.body) for r in asked.where("part = 0").select("body").collect()]
        tracemalloc.start()
        replies, _ = reply(bodies)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        taken[name] = tuple(parts * x / n_tokens for x in (sum(map(len, bodies)), peak, sum(map(len, replies))))
        return packed.answer(asked, reply, parts, name, **kw)

    monkeypatch.setattr(suffix_tree_lm, "answer", answer)
    suffix_tree_lm.score(frame(spark, rows), depth=1)
    (_, _, counts), (asked, peak, _) = taken["tree-0"], taken["tree-1"]
    assert asked < 16 and peak < 95 and counts < 0.3, taken


# ------------------------------------------------------------------------ blocks
def test_sizes_follow_the_input(spark, docs, monkeypatch, tmp_path):
    assert common.stored_bytes(docs) == 0 and common.tasks_for(docs) == 4  # rows of the driver lie in no file
    assert packed.block_size(0) == packed.block_size(packed.UNIT) == common.BLOCK and packed.block_size(100 * packed.UNIT) == 10 * common.BLOCK
    path = f"file://{tmp_path}/docs"
    docs.write.parquet(path)
    held = spark.read.parquet(path)
    size = common.stored_bytes(held)
    assert size > 1000
    few = packed.pack(held, "few")
    monkeypatch.setattr(common, "TASK_BYTES", size // 6)
    monkeypatch.setattr(packed, "BLOCK", 1 << 10)
    monkeypatch.setattr(packed, "UNIT", size // 400)
    assert common.tasks_for(held) > 4 and 19 << 10 <= packed.block_size(size) <= 21 << 10
    many = packed.pack(held, "many")
    buckets = lambda t: int(by_name(spark.sql(f"DESCRIBE EXTENDED {t.name}"))["Num Buckets"])
    by_name = lambda df: {r.col_name: r.data_type for r in df.collect()}
    assert buckets(many) == common.tasks_for(held) > buckets(few) == 4
    assert many.frame.count() > few.frame.count()
    compare(passage_digests(held), brute_words(DOCS))


def test_token_files_one_id_many_tasks(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"{k:03d} words" for k in range(400)]
    got = token_files(spark, frame(spark, [(None, t) for t in texts]), path).collect()
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == np.cumsum([0, *[r.n_tokens for r in sorted(got, key=lambda r: r.start)]])[:-1].tolist()
    lib = Tokenizer.from_file(path)
    want = [binascii.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in texts]
    assert [r.ids_crc32 for r in sorted(got, key=lambda r: r.start)] == want


# ------------------------------------------------------------------------ 5
def test_pairwise_quality(spark):
    dice = random.Random(3)
    good = lambda: " ".join("".join(dice.choice("abcdefgh") for _ in range(dice.randint(2, 8))) for _ in range(80)) + "."
    bad = [lambda: good().upper() + "!! " * 20, lambda: " ".join(["spam"] * 60), lambda: good().replace(" ", " | ")]
    rows = [(i, dice.choice(bad)() if i % 4 == 0 else good()) for i in range(400)] + [(900, None), (901, ""), (902, "x" * 100_000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)] + [(5000, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(pairwise_quality.score(docs, pairwise_quality.fit(docs, labels)))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and not got[1 if 1 not in held else 2].held_out
    assert sum(got[i].predicted == (i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3) for i in (900, 901, 902))
    alone = pairwise_quality.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in pairwise_quality.score(docs, alone).collect()} == {0.5}
    assert pairwise_quality.score(frame(spark, []), alone).count() == 0


@pytest.mark.parametrize("sent", [1000, 10])
def test_pairwise_quality_cut_of_all_labels(spark, sent):
    dice = random.Random(4)
    texts = [" ".join("".join(dice.choice("abcdefgh") for _ in range(dice.randint(2, 8))) for _ in range(dice.randint(20, 90))) + "!! | " * (dice.randint(0, 9) if i % 4 else dice.randint(5, 30)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 4) for i in range(300)], "doc_id long, quality int")
    model = pairwise_quality.fit(frame(spark, list(enumerate(texts))), labels, sample=60, sent=sent)
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    raw = [x.encode() for x in texts]
    s = model.raw(pairwise_quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))[train]
    share = sum(i % 4 == 0 for i in train) / len(train)
    assert model.cut == pytest.approx((np.quantile(s, share, method="lower") + np.quantile(s, share, method="higher")) / 2, abs=1e-9)


# ------------------------------------------------------------------------ 6
def brute_words(rows, k=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        f = [0] * len(w)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            if key in seen:
                f[j : j + k] = [1] * k
            seen.add(key)
        out[i] = {"n_words": len(w), "n_removed": sum(f), "kept_sha256": hashlib.sha256(" ".join(x for x, y in zip(w, f, strict=True) if not y).encode()).hexdigest()}
    return out


def test_block_anchors(docs):
    compare(passage_digests(docs), brute_words(DOCS))


def test_block_anchors_other_window_ties_no_rows(spark):
    rows = [(1, "a b c d e f g"), (2, "x b c d e y b c d e"), (3, "q q q q q q q"), (4, None)]
    compare(passage_digests(frame(spark, rows), 4), brute_words(rows, 4))
    text = " ".join(map(str, range(50)))
    assert sorted(r.n_removed for r in passage_digests(frame(spark, [(1, text), (1, text), (2, text)])).collect()) == [0, 0, 50]
    assert passage_digests(frame(spark, [])).count() == 0
    kept = by_id(without_repeats(frame(spark, [(1, f"Start.\n{text}"), (2, f"Other\n{text}\nend.")])))
    assert kept[2].text == "Other\n\nend." and kept[1].text == f"Start.\n{text}" and kept[2].block == "clash"


# ------------------------------------------------------------------------ 7
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_leaks(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for i, t in rows:
        w = ALNUM.findall(lower(t or ""))
        f, met = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    met |= own
                    f[k : k + n] = [1] * n
        out[i] = {"n_words": len(w), "n_hit": sum(f), "n_items": len(met), "items_sha256": hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), "contaminated": sum(f) > 0 and 20 * sum(f) >= len(w)}
    return out


def test_winnowing(spark, docs):
    texts = [t for _, t in DOCS if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[3].split()[4:25])), (2, "Two, WORDS"), (3, None), (4, "!!"), (5, texts[5].upper()), (6, " ".join(texts[3].split()[4:25])), (10, "one"), (7, "nowhere " * 20), (8, texts[0][:90_000])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(DOCS, items)
    assert sum(w["contaminated"] for w in want.values()) > 3
    compare(decontaminate(docs, bench), want)
    compare(decontaminate(docs, bench, block_bytes=100), want)  # a test set in many blocks
    assert decontaminate(frame(spark, []), bench).count() == 0
    assert not any(r.n_hit for r in decontaminate(docs, bench.limit(0)).collect())
    left = by_id(overlaps(docs, bench, keep=tuple(docs.columns), clean=True, block_bytes=100))
    assert set(left) == {i for i, w in want.items() if not w["contaminated"]}
    assert all(r.block == "clash" and r.score == 0.5 for r in left.values())


def test_winnowing_of_one_word_repeated(spark):
    import time

    rows = [(1, "na " * 100_000), (2, "na " * 12), (3, "x " + "na " * 20 + "y")]
    items = spark.createDataFrame([(1, "na " * 50_000), (2, "x y"), (3, "na " * 13)], "item_id long, text string")
    start = time.time()
    got = by_id(decontaminate(frame(spark, rows, 1), items))
    assert time.time() - start < 60
    assert [(got[k].n_hit, got[k].n_items) for k in (1, 2, 3)] == [(100_000, 2), (0, 0), (20, 2)]


# ------------------------------------------------------------------------ 8
def test_rank_bpe(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    odd = [(5000 + k, t) for k, t in enumerate(["x<|endoftext|>y", "it's I'LL 'Re  \n\n b\t", "²³ Ⅷ 12_a", " 　a\x85b\x1c", "日本語" * 60])]
    want = {}
    for i, t in DOCS + odd:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), "ids": ids}
    compare(encode_decode(docs.unionByName(frame(spark, odd)), path, with_ids=True), want)
    assert encode_decode(frame(spark, []), path).count() == 0


def test_rank_bpe_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own, dice = Tokenizer.from_file(path), tokenizer(path), random.Random(8)
    texts = ["".join(dice.choice(" ab\n.,'sté1²\x1c<|>\t ez") for _ in range(dice.randint(0, 60))) for _ in range(500)] + ["ab" * 400, "é" * 120]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_rank_bpe_all_code_points():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), tokenizer(path)
    points = [chr(k) for k in [*range(0x32000), *range(0xE0000, 0xE0200)] if not 0xD800 <= k < 0xE000]
    texts = ["".join(f"~{c}a {c}'m1{c} " for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    for t, mine, theirs in zip(texts, own.encode_many(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(mine, "<u4").tolist() == theirs.ids, t[:40]


# ------------------------------------------------------------------------ 9
def brute_components(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: {"n_shingles": len(s), "component_id": top(i)} for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_join(spark, seed):
    dice = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = list(DOCS)
    base = [dice.choice(words) for _ in range(150)]
    for k in range(70):  # a family of copies with few and with many changes, in chains
        own = list(base)
        for _ in range(dice.choice([0, 1, 2, 3, 5, 8])):
            own[dice.randrange(len(own))] = dice.choice(words)
        if dice.random() < 0.3:
            own = own[dice.randrange(25) :]
        if dice.random() < 0.2:
            base = own
        rows.append((3000 + k, " ".join(own)))
    compare(near_duplicates(frame(spark, rows)), brute_components(rows))


def test_prefix_join_edges(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(frame(spark, [(None, "a b c d e"), (4, "A b C d e"), (7, ""), (8, None), (7, ""), (9, "x"), (9, "X")])).collect())
    assert got == [("4", 1, "None"), ("7", 0, "7"), ("7", 0, "7"), ("8", 0, "8"), ("9", 1, "9"), ("9", 1, "9"), ("None", 1, "None")]


def test_prefix_join_one_id_with_two_texts(spark):
    a = [f"w{k}" for k in range(200)]
    b = [f"x{k}" if k in (40, 41, 42, 43, 44) else w for k, w in enumerate(a)]
    c = [f"y{k}" if k in (150, 151, 152, 153) else w for k, w in enumerate(b)]
    a, b, c = ((1, " ".join(a)), (1, " ".join(b)), (2, " ".join(c)))
    for rows in ([a, b, c], [b, a, c], [c, b, a]):
        assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows, 1)).collect()} == {1: 1, 2: 1}


def test_prefix_join_templates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_join, "SIDE", 5)
    monkeypatch.setattr(prefix_join, "MEMBERS", 2)
    monkeypatch.setattr(prefix_join, "STAR", 3)
    monkeypatch.setattr(prefix_join, "WIDE", 64)
    dice = random.Random(9)
    parts = [" ".join(f"w{dice.randrange(300)}" for _ in range(50)) for _ in range(8)]
    rows = [(k, " ".join(dice.sample(parts, 5))) for k in range(90)]
    # equal prefixes and sizes, other common shingles: one group of several members
    rows += [(200 + k, " ".join(parts[:5]) + " " + " ".join(f"tail{j}" for j in range(k % 3, 30 + k % 3))) for k in range(12)]
    compare(near_duplicates(frame(spark, rows)), brute_components(rows))


def test_words_that_sums_of_bytes_confuse(spark):
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join([w, *(f"k{k}" for k in range(19))])) for i, w in ((1, one), (2, two))]
    assert [r.n_removed for r in passage_digests(frame(spark, rows)).collect()] == [0, 0]
    rows = [(1, f"{one} b c d e"), (2, f"{two} b c d e")]
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 2}
    assert len(np.unique(Words(np.frombuffer(f"{one} {two}".encode(), np.uint8), np.array([0, 2049])).hash)) == 2


# ----------------------------------------------------------------------- 10
def test_exact_digest(docs):
    order = sorted(DOCS)
    want = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        want[i] = {"n_chars": len(t), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fingerprint": digest(canonical(t)), "edited_fingerprint": digest(canonical(new)), "near_edited": float(canonical(new) == canonical(t)), "near_next": float(canonical(nxt) == canonical(t))}
    compare(fingerprints(docs), want)


def test_exact_digest_compares_bytes_under_one_digest(spark, monkeypatch):
    monkeypatch.setattr("quillframe.llm.exact_digest.digest", lambda form: "d" * 32 if form[:1] in b"xyz" else form.hex())
    got = {r.doc_id: r for r in fingerprints(frame(spark, [(1, "x one"), (2, "y two"), (3, "X  one"), (4, "z"), (5, "other"), (6, "Y two")])).collect()}
    assert [got[k].fingerprint for k in (1, 2, 3, 4, 6)] == ["d" * 32, "d" * 32 + "-1", "d" * 32, "d" * 32 + "-2", "d" * 32 + "-1"]
    assert got[5].fingerprint == b"other".hex() and got[1].near_next == 0


def test_texts_longer_than_a_block(spark):
    """A text of over 2 MB, with passages that a short one shares."""
    dice = random.Random(12)
    words = ["".join(dice.choice("abcdefgh") for _ in range(6)) for _ in range(60_000)]
    long_ = " ".join(dice.choice(words) for _ in range(330_000))
    shared = " ".join(long_.split()[200_000:200_060])
    rows = [(1, long_), (2, f"start {shared} end"), (3, None)]
    assert len(long_) > 2 << 20
    assert {r.doc_id: r.n_removed for r in passage_digests(frame(spark, rows)).collect()} == {1: 0, 2: 60, 3: 0}
    got = {r.doc_id: r for r in repeated_bytes(frame(spark, rows)).collect()}
    assert got[2].n_removed == len(shared) + 2 and got[1].n_removed == len(shared) + 2 and got[3].n_bytes == 0
    items = spark.createDataFrame([(7, shared)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate(frame(spark, rows), items).collect()} == {1: 60, 2: 60, 3: 0}


def test_stored_folders(spark):
    from quillframe.llm import common

    class Cluster:
        master = "spark://x"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Cluster(), {}

    with pytest.MonkeyPatch.context() as m:
        m.setattr(common, "ship", lambda _: None)
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            common.shared_dir(Session(), "x")


def test_exact_digest_edges(spark, monkeypatch):
    assert fingerprints(frame(spark, [])).count() == 0
    (r,) = fingerprints(frame(spark, [(3, "abcd")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    rows = fingerprints(frame(spark, [(1, "Ａ  b"), (1, "a B"), (None, "a b"), (2, "c")])).collect()
    assert len({r.fingerprint for r in rows}) == 2 and sum(r.near_next for r in rows) >= 2
