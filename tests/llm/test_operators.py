"""Brute force, round trips and edge cases of the training-data operators."""

import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm import chat, decontaminate, html_text, langid, line_dedup, nearest, packing, pii, sharding, simhash
from quotemill.llm.common import connected

TOKENS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key1 string, row string"


def docs_of(spark, *texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in zip(ids, texts)], DOCS)


ODD = [None, "", "   \n\t", "a", "word " * 30_000, "x" * 100_000, "same text here again and again", "same text here again and again"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, a repeated row, a missing id."""
    return docs_of(spark, *ODD, ODD[6], "no id at all", ids=[*range(8), 6, None])


def test_groups_of_a_random_graph(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long"), 300).collect()}
    assert got == want


def test_edit_distance_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 9)).tolist(), rng.integers(0, 4, rng.integers(0, 14)).tolist()
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            now = [i]
            for j, y in enumerate(text, 1):
                now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y)))
            row = now
        assert decontaminate.best_stretch(item, text)[0] == min(row)


def test_leaks_with_edits_are_found_and_clean_texts_left(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items = [[word() for _ in range(int(rng.integers(15, 50)))] for _ in range(30)]
    texts, planted = [], set()
    for d in range(60):
        text = [word() for _ in range(200)]
        if d < 40:
            leak = list(items[d % 30])
            for _ in range(len(leak) // 8):
                at = int(rng.integers(len(leak)))
                if rng.random() < 0.5:
                    leak[at] = word()
                else:
                    del leak[at]
            at = int(rng.integers(200))
            text[at:at] = [w.upper() + "," for w in leak]
            planted.add((d, d % 30))
        texts.append(" ".join(text))
    docs = docs_of(spark, *texts, None, "")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None), (98, "too short")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert not got - planted and len(got) >= 0.97 * len(planted)
    kept = {r.doc_id for r in decontaminate.decontaminated(docs, bench).select("doc_id").collect()}
    assert kept == set(range(62)) - {d for d, _ in got}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def _pii(text):
    spans = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


def test_pii_against_brute_force(spark):
    texts = [None, "", "mail a@b.c_d@e.fg x@y, é.b+c@host-1.co.uk. @z", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 1.2.3",
             "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 4028005252517056", "call +1 (654) 555-4136. +12 +1234567890123456",
             "üñ" * 50 + " 4111111111111111 a@b.cc " * 3, "a@b.c " * 3000, "1" * 50_000, "a." * 30_000 + "@x", "@" * 1000]
    got = {r.doc_id: r for r in pii.pii_digest(docs_of(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        base = _pii(t)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("iban")] == base, texts[i]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert got[i].n_email == sum(s.startswith("email") for s in base)


def test_pii_checks_ibans_and_context(spark, odd):
    rows = pii.find_pii(docs_of(spark, "iban GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33")).collect()
    assert [(r.doc_id, r.kind, r.start, r.end, r.score) for r in rows if r.kind == "iban"] == [(0, "iban", 5, 32, 1.0)]
    assert pii.pii_digest(odd).count() == 10 and pii.pii_digest(odd.limit(0)).count() == 0


def test_language_is_learnt_and_held_out_rows_are_right(spark, odd):
    rng = np.random.default_rng(4)
    parts = {"aa": ["tha", "ing", "wor", "ked"], "bb": ["sch", "ung", "heit", "über"]}
    rows = []
    for i in range(240):
        lang = "aa" if i % 2 else "bb"
        text = " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(40))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang if i % 5 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.trained(docs)
    got = {r.doc_id: r for r in langid.identify(docs, network).withColumn("h", langid.held_out()).collect()}
    assert all(got[i].h == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i]._lang_pred == ("aa" if i % 2 else "bb") for i in got if got[i].h]) > 0.97
    said = [(r._lang_pred, r._lang_score) for r in langid.identify(odd, network).orderBy("doc_id", "text").collect()]
    assert len(said) == 10 and sum(s == ("und", 0.0) for s in said) == 3 and all(0 <= s[1] <= 1 for s in said)
    assert langid.trained(docs.limit(0)) is None
    assert {r._lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_backpropagation_matches_finite_differences():
    rng = np.random.default_rng(5)
    network = langid.Network(["a", "b", "c"])
    x, y = rng.integers(97, 110, (9, 4)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        p = network.positions(x)
        return float(np.mean(-np.log(p[:, np.arange(4), y])))

    for p, g in zip(network.parameters(), network._gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], np.float32(1e-2)
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.15, abs=2e-3)


def test_chat_round_trip_and_examples(spark):
    said = [(1, 0, "system", "<|end|> <||turn|> <"), (1, 1, "user", "|x"), (1, 2, "assistant", "<|text|>é"), (1, 3, "assistant", None),
            (1, 4, "user", "tail"), (2, 0, "user", ""), (None, 0, None, "x"), (3, 0, "assistant", "r"), (3, 0, "assistant", "r")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    shared = chat.segments(turns)
    got = {r.conv_id: r for r in chat.read_back(shared).collect()}
    for conv in (1, 2, 3, None):
        own = [(r or "", t or "") for c, _, r, t in said if c == conv]
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {(r.conv_id, r.example): r for r in chat.full_texts(shared).collect()}
    assert set(whole) == {(1, 0), (1, 1), (3, 0), (3, 1)}
    first = whole[1, 0]
    assert chat.unescaped(first.text[first.loss_start:first.loss_end]) == "<|text|>é"
    assert first.text.endswith("<|end|>") and whole[1, 1].text.startswith(first.text)
    assert chat.read_back(chat.segments(turns.limit(0))).count() == 0
    exploded = {(r.conv_id, r.example): r for r in chat.examples(shared).collect()}
    assert set(exploded) == set(whole)
    for at, r in exploded.items():
        assert len(whole[at].text) == r.context_chars + len(r.reply) and whole[at].text.endswith(r.reply)
        assert (r.loss_start, r.loss_end) == (whole[at].loss_start, whole[at].loss_end)


def test_chat_long_conversation_null_turn_and_broken_example(spark):
    said = [(1, i, "assistant" if i % 3 else "user", "x" * (i % 50)) for i in range(1500)] + [(2, None, "user", "first"), (2, 0, "user", "then")]
    said += [(3, 0, "user", "<|end|>" * 40_000), (3, 1, "assistant", "<|" * 100_000)]
    shared = chat.segments(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(shared).collect()}
    assert got[1].n_examples == 1000 and got[3].loss_chars == 200_000
    assert got[2].turns_sha256 == hashlib.sha256(b"user\nfirst\nuser\nthen\n").hexdigest()
    texts = chat.full_texts(shared).where("conv_id = 1").collect()
    assert len(texts) == 1000 and max(len(r.text) for r in texts) == got[1].formatted_chars
    shifted = shared.withColumn("context_chars", F.col("context_chars") + 1)
    with pytest.raises(Exception, match="does not continue its context"):
        chat.read_back(shifted).collect()


def test_chat_examples_hold_their_whole_context(spark):
    said = [(1 << 60, 0, "user", "a<|"), (1 << 60, 1, "assistant", "b"), (1 << 60, 2, "user", "c"), (1 << 60, 3, "assistant", "d"),
            (1 << 60, 4, "user", "tail"), (None, 0, "assistant", "x")]
    shared = chat.segments(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))

    def turn(role, text):
        return f"<|turn|>{role}<|text|>{text.replace('<|', '<||')}<|end|>"

    first, reply, then = turn("user", "a<|"), turn("assistant", "b"), turn("user", "c")
    got = {(r.conv_id, r.example): (r.context, r.reply) for r in chat.examples(shared).collect()}
    assert got == {(1 << 60, 0): (first, reply), (1 << 60, 1): (first + reply + then, turn("assistant", "d")),
                   (None, 0): ("", turn("assistant", "x"))}
    back = {r.conv_id: r for r in chat.read_back(shared).collect()}
    assert set(back) == {1 << 60, None} and (back[1 << 60].n_turns, back[1 << 60].n_examples) == (5, 2)
    cut = shared.where("seq <> 2")  # a context that lacks a turn
    with pytest.raises(Exception, match="does not continue its context"):
        chat.read_back(cut).collect()


def test_tokens_match_the_tokenizer_and_packing_is_tight(spark, odd):
    encode = Tokenizer.from_file(TOKENS)
    texts = ["İstanbul ΣΑΣ", "It's 3.14, we'LL go.\n\nfoo,bar. end.", "<|startoftext|> x<|ENDOFTEXT|>y <|endoftext|>.", "\x1c a\x1cb \x85 nbsp\xa0x. y",
             "’s don't ßẞ ﬁ Å K", "日本語 text, a. b", "word́. next, "]
    for t in texts:
        assert np.frombuffer(packing.encoder(TOKENS).encode(t), "<u4").tolist() == encode.encode(t, add_special_tokens=False).ids
    for df in (odd, docs_of(spark, *texts * 20)):
        rows = packing.pack(df, TOKENS, 64, with_ids=True).collect()
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append(r)
            assert r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        for parts in by.values():
            end = 0
            for r in sorted(parts, key=lambda r: r.offset):
                assert r.offset == end
                end += r.length
            assert end <= 64
        total = sum(len(encode.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in df.collect())
        assert sum(r.length for r in rows) == total and len(by) <= total / 64 * 1.05 + 1
    assert packing.pack(odd.limit(0), TOKENS).count() == 0


def test_simhash_groups_against_brute_force(spark, odd):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(b) ^ sum(1 << int(i) for i in rng.integers(0, 64, rng.integers(0, 5))) for b in base for _ in range(40)}
    prints = [np.uint64(p).astype(np.int64).item() for p in sorted(prints)]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, node long")
    codes, group = np.array(prints, np.int64).view(np.uint64), list(range(len(prints)))
    for i in range(len(prints)):
        for j in np.nonzero(np.bitwise_count(codes ^ codes[i]) <= 3)[0].tolist():
            a, b = group[i], group[j]
            if a != b:
                group = [min(a, b) if g in (a, b) else g for g in group]
    for choices, part in (((2, 3, 4), 2048), ((2,), 16), ((4,), 16)):
        old, simhash.PART = simhash.PART, part
        got = {r.node: r.component for r in connected(simhash.links(df, 3, choices), 1000).collect()}
        simhash.PART = old
        assert [got.get(i, i) for i in range(len(prints))] == group
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(odd).collect()}
    assert {r for r in rows if r[0] in (0, 1, 2)} == {(i, "0" * 16, 0) for i in (0, 1, 2)}
    assert {r[2] for r in rows if r[0] in (6, 7)} == {6}
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one(odd).select("doc_id").collect())
    assert (False, 7) not in kept and (False, 6) in kept and (True, 0) in kept
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_html_main_text(spark):
    page = """<html><body><div class="top-menu">Menu</div><div id="content" class="post post-{n}"><h1>T &lt;x&gt; {n}</h1><p>One  two<p>three
    <a href=x>link</a> a < b<ul><li>i1<li>i2</ul><div class="ad-slot">buy</div></div><div class="comments"><p>me too</p></div>
    <aside>side</aside><form>f</form><script>if(a<b){{"</div>"}}</script></body>"""
    htmls = [page.format(n=i) for i in range(5)] + [None, "", "<p", "<!-- open", "<div>" * 3000 + "deep", '<a href="' * 5000, "plain &amp; text"]
    pages = spark.createDataFrame([(i, None if i == 6 else "http://h.example/x", h, "c") for i, h in enumerate(htmls)],
                                  "page_id long, url string, html string, _path string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for i in range(5):
        assert got[i].text == f"T <x> {i}\nOne two\nthree link a < b\ni1\ni2" and got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (5, 6, 8, 9, 11)] == ["", "", "", "deep", "plain & text"]
    assert html_text.host_paths(pages).where("_host = 'h.example'").first()["_path"] == "/html/body/div.post.post-#"
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [50, 5_000, 300_000])
def test_quotations_of_any_length_and_broken_markup(n):
    inside = "a) > leaked <p>words " * (n // 20)
    assert html_text.main_text(f'<p>one <img alt="{inside}" src=x> two</p>', None) == "one two"
    assert html_text.main_text(f"<p title='{inside}'>three</p>", None) == "three"
    for broken in ('<a "', "<a '\"", '<a href="x\' ', "<a '\"<b \"'", '<a "<b\'"', "<!-- x", '<a ""'):
        began = time.perf_counter()
        html_text.main_text("<p>text</p>" + broken * (n // len(broken)), None)
        assert time.perf_counter() - began < 20


def test_repeated_pages_are_each_extracted(spark):
    pages = spark.createDataFrame([(1, "http://h/x", "<p>same &amp; same</p>")] * 3, "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(pages).collect()] == ["same & same"] * 3


def test_lines_exact_and_fuzzy(spark, odd):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 7))
    long_line = [word() for _ in range(400)]
    near = [*long_line[:399], "changed"]
    own = [" ".join(word() for _ in range(12)) for _ in range(4)]
    texts = ["\n".join([own[0], "Terms of use apply, 2020.", "", "-----", " ".join(long_line)]),
             "\n".join([own[1], "TERMS of use apply 2021", "", "-----", " ".join(near), own[1]]), own[2] + "\n" + own[0], None, "", own[0].upper()]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, *texts)).collect()}
    assert got[0].text == texts[0] and got[0]._ld_removed == 0
    assert got[1].text == "\n".join([own[1], "", "-----"]) and got[1]._ld_removed == 3
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == (own[2], None, "", "")
    left = {r.doc_id for r in line_dedup.dedup_lines(docs_of(spark, *texts), drop_emptied=True).collect()}
    assert left == {0, 1, 2, 3, 4}
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == 10 and sum(r.text == ODD[6] for r in rows) == 2  # one row, twice in the table
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_recall_of_changed_lines(spark):
    """Lines of 3 to 80 random words with a few changed ones, as similar as the limit asks."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    vocabulary = ["".join(rng.choice(letters, rng.integers(2, 11))) for _ in range(5000)]
    texts, kinds = [], []
    for n, k in ((3, 0), (5, 1), (8, 1), (12, 1), (20, 2), (40, 2), (40, 5), (80, 4), (80, 10)):
        made = 0
        while made < 60:
            a = rng.choice(vocabulary, n).tolist()
            b = list(a)
            if not k:  # one letter of the longest word
                at = max(range(n), key=lambda i: len(b[i]))
                b[at] = b[at][:-1] + "0"
                b[at] = b[at].replace("0", "z" if a[at][-1] != "z" else "y")
            for at in rng.choice(n, k, replace=False).tolist():
                b[at] = str(rng.choice(vocabulary))
            x, y = " ".join(a), " ".join(b)
            if x == y or sum(max(len(u), len(v)) for u, v in zip(a, b) if u != v) * (k > 0) > 0.2 * max(len(x), len(y)):
                continue  # kept if certainly similar: what replacing the words whole takes
            texts += [x, y]
            kinds.append((n, k))
            made += 1
    got = {r.doc_id: r._ld_removed for r in line_dedup.dedup_lines(docs_of(spark, *texts)).collect()}
    assert not any(got[i] for i in range(0, len(texts), 2))
    for kind in set(kinds):
        hits = [got[2 * i + 1] for i, x in enumerate(kinds) if x == kind]
        assert np.mean(hits) >= 0.9, (kind, np.mean(hits))


def test_lines_that_share_a_passage_cost_no_pairs(spark, monkeypatch):
    """Lines of one passage that are not similar: their pairs are tested in the join, and no table holds them."""
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    passage = [word(12) for _ in range(4)] + [word(4) for _ in range(4)]
    lines = [" ".join([*passage, *(word(10) for _ in range(4))]) for _ in range(200)]
    lines.append(lines[0][:-1] + ("x" if lines[0][-1] != "x" else "y"))  # in another place of the key's order, but similar
    counts, keep = {}, line_dedup.stored

    def counting(df, purpose, files=None):
        out = keep(df, purpose, files)
        counts[purpose] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", counting)
    got = {r.doc_id: r._ld_removed for r in line_dedup.dedup_lines(docs_of(spark, *lines)).collect()}
    assert got == {i: int(i == 200) for i in range(201)}
    assert max(counts.values()) <= 10 * len(lines), counts


def test_few_changed_words_are_told_without_letters(spark, monkeypatch):
    """The answer is the edit distance's; of lines that differ in a word or two it is known from the words alone."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(1, 12)))
    pairs = []
    for n in (2, 5, 12, 40, 95, 130):
        for changes in range(0, max(3, n // 2), max(1, n // 12)):
            a = [word() for _ in range(n)]
            b = list(a)
            for at in rng.choice(n, min(n, changes), replace=False).tolist():
                b[at] = str(rng.choice(["", word(), f"{word()} {word()}"]))
            pairs.append((" ".join(a), " ".join(" ".join(b).split()) or "z"))
    lines = spark.createDataFrame([(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)], "key1 long, norm string")
    marks = line_dedup.signed(line_dedup._normal_texts(lines))
    side = lambda j: marks.where(F.col("key1") % 2 == j).select((F.col("key1") - j).alias("at"), *[F.col(c).alias(f"{c}_{j}") for c in line_dedup.COMPARED])
    met = side(0).join(side(1), "at")

    def close(x, y):
        before = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            now = [i]
            for j, d in enumerate(y, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
            before = now
        return before[-1] <= int(max(len(x), len(y)) * 0.2 + 1e-9)

    want = {}
    for i, (x, y) in enumerate(pairs):
        by_word = max(len(x.split()), len(y.split())) > line_dedup.LONG_LINE
        want[2 * i] = close(x.split(), y.split()) if by_word else close(x, y)
    assert 10 < sum(want.values()) < len(want) - 10
    assert {r.at: r.same for r in met.select("at", line_dedup._similar("_0", "_1", 0.8).alias("same")).collect()} == want
    monkeypatch.setattr(line_dedup, "_edit_distance_within", lambda *a: F.lit(False))
    sure = {r.at for r in met.where(line_dedup._similar("_0", "_1", 0.8)).select("at").collect()}
    assert len(sure) >= 4 and all(want[i] for i in sure)


def test_anchors_are_the_longest_words(spark):
    """Whether or not a line has enough wide words, and however many words are asked for."""
    texts = ["a bb ccc dddd", "same same other", "longestword wideword otherwide anotherwide x y z", "wideword wideword wideword wideword ab",
             "wideword otherwide anotherwide ab cde fghi fghi"]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc long, text string")
    for least in (2, 6):
        got = {r.row: r for r in line_dedup.line_table(docs, least).collect()}
        for i, t in enumerate(texts):
            words = set(t.split())
            assert min(got[i].n, least) == min(len(words), least) and min(got[i].n, 4) == min(len(words), 4)
            alone = spark.createDataFrame([(j, j, w) for j, w in enumerate(sorted(words))], "row long, doc long, text string")
            code = {sorted(words)[r.row]: r.a0 for r in line_dedup.line_table(alone).collect()}
            anchors = [got[i][a] for a in line_dedup.ANCHOR if got[i][a] is not None]
            longest = sorted((len(w) for w in words), reverse=True)[:4]
            back = {c: w for w, c in code.items()}
            assert [len(back[a]) for a in anchors] == longest and len(set(anchors)) == len(anchors)
            assert all((a % 2 == 1) == (len(back[a]) >= line_dedup.LETTERS) for a in anchors)


SIX = [(1, "A"), (2, "A"), (2, "B"), (7, "C"), (7, "C"), (None, "A")]


def test_near_duplicates_are_dropped_by_row(spark):
    said = {c: " ".join(f"{c.lower()}{i}" for i in range(40)) for c in "ABC"}
    docs = docs_of(spark, *[said[t] for _, t in SIX], None, "", ids=[d for d, _ in SIX] + [None, 3])
    left = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert left == sorted([(1, said["A"]), (2, said["B"]), (7, said["C"]), (3, "")], key=str)
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs.limit(0)).count() == 0


def test_leaks_are_dropped_by_row_and_short_items_reported(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "no"), (3, "two words"), (4, " "), (5, None), (1, item)], "item_id long, text string")
    texts = ["x " + item, "clean no doubt two words", item, None, item + " y", "clean no doubt two words", "two, WORDS"]
    docs = docs_of(spark, *texts, ids=[5, 5, None, None, 6, 5, 8])
    found = sorted((r.doc_id or -1, r.item_id, r.distance) for r in decontaminate.find_leaks(docs, bench).collect())
    assert found == sorted([(-1, 1, 0)] * 2 + [(5, 1, 0)] * 2 + [(6, 1, 0)] * 2 + [(5, 2, 0), (5, 3, 0)] * 2 + [(8, 3, 0)])
    left = sorted(((r.doc_id or -1, r.text or "") for r in decontaminate.decontaminated(docs, bench).collect()))
    assert left == [(-1, ""), (5, texts[1]), (5, texts[1]), (8, texts[6])]


def test_leak_search_against_brute_force(spark):
    """Every stretch within the edits allowed is found but for the recall's share; one item is far longer than the rest."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    items = [[word() for _ in range(n)] for n in (6, 9, 15, 30, 60, 600)]
    texts = []
    for _ in range(80):
        leak = list(items[int(rng.integers(6))])
        for _ in range(int(rng.integers(0, int(0.3 * len(leak)) + 1))):
            at = int(rng.integers(len(leak)))
            leak[at:at + int(rng.integers(2))] = [word()] * int(rng.integers(2))
        texts.append([word() for _ in range(30)] + leak + [word() for _ in range(30)])
    number = {}
    ids = lambda ws: [number.setdefault(w, len(number)) for w in ws]
    want = {(d, k) for d, t in enumerate(texts) for k, item in enumerate(items)
            if decontaminate.best_stretch(ids(item), ids(t))[0] <= int(0.2 * len(item) + 1e-9)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs_of(spark, *[" ".join(t) for t in texts]), bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 40


def test_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_REPETITIONS", 1)
    rng = np.random.default_rng(13)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40))) for i in range(20)]
    with pytest.raises(ValueError, match="not reached"):
        decontaminate.Items(rows, similarity=0.3, recall=0.999, samples=1, min_words=1)


def test_jump_hash_moves_only_into_the_new_shard(spark, odd):
    keys = np.random.default_rng(8).integers(-2**62, 2**62, 20_000)
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(b[a != b]) == {16} and abs((a != b).mean() - 1 / 17) < 0.01 and np.bincount(a).min() > 1100
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 10 and {(r.size, r.text_crc32) for r in rows if r.doc_id == 0} == {(1, 0)}
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.standard_normal((400, 6)), 1)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] * 6), (1003, [None] * 6), (1004, [float("inf")] + [0.0] * 5), rows[7]]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows + bad], "vec_id long, embedding array<double>, id string")
    got = {}
    for r in nearest.nearest(df.where("vec_id % 20 = 0"), df, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 400, 20):
        if not v[q].any():
            continue
        scores = {i: nearest.exact_products(v[q:q + 1], v[i:i + 1])[0] for i in range(400) if i != q and v[i].any()}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert [x[1] for x in sorted(got[q])] == want
    assert set(got) <= set(range(0, 400, 20))
    few = df.where("vec_id < 3")
    assert nearest.nearest(few.where("vec_id = 0"), few, 20).count() == 2
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0
