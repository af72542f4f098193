"""Brute force and edge cases of alignment, prefix trie and substring removal."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quotemill.llm import alignment, prefix_trie, substring_dedup

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, hash long, row string, count long"


def docs_of(spark, *texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "y", 2) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


# --- substring removal ---------------------------------------------------------------------------

def brute_removed(docs, width):
    first = {}
    for doc, text in docs:
        words = (text or "").encode().split()
        if doc is not None:
            for i in range(len(words) - width + 1):
                w = tuple(words[i:i + width])
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in docs:
        words = (text or "").encode().split()
        gone = set()
        if doc is not None:
            for i in range(len(words) - width + 1):
                if first[tuple(words[i:i + width])] < doc:
                    gone |= set(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(df, width):
    got = substring_dedup.remove_repeats(df, width)
    rows = got.collect()
    for r in rows:
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(x.end < y.start for x, y in zip(r.removed, r.removed[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)


def test_rolling_hash_is_the_polynomial():
    values = np.random.default_rng(1).integers(0, 1 << 63, 40, dtype=np.uint64)
    for width in (1, 3, 13):
        for base in substring_dedup.BASES:
            got = substring_dedup.rolling(values, width, base)
            x = [int(v) for v in values]
            up = pow(base, -1, 1 << 64)
            want = [sum(x[i + k] * pow(up, k + 1, 1 << 64) for k in range(width)) * base % (1 << 64)
                    for i in range(len(x) - width + 1)]
            assert got.tolist() == want
    assert len(substring_dedup.rolling(values[:2], 3, substring_dedup.BASES[0])) == 0


def test_words_of_equal_bytes_have_equal_values():
    rng = np.random.default_rng(8)
    text = "".join(rng.choice([*"ab\u00e9 \t\n", "\x1c", "\u00a0", "\u2028", "q" * 200], 20_000))
    words, values = substring_dedup.words_of(text), substring_dedup.word_values(text).tolist()
    assert len(words) == len(values) and len(set(words)) == len(set(values)) == len(set(zip(words, values)))
    assert not len(substring_dedup.word_values(None)) and not len(substring_dedup.word_values(" \n"))


def test_lists_survive_packing_and_colliding_hashes_stay_apart():
    h, s = np.array([3, 3, 3, 9, 1 << 63], np.uint64), np.array([1, 2, 1, 5, 5], np.uint16)
    doc = np.array([7, 4, 9, 1, -2], np.int64)
    for a, b in zip(substring_dedup.unpacked(substring_dedup.packed(h, s, doc), 5), (h, s, doc)):
        assert a.tolist() == b.tolist() and a.dtype == b.dtype
    found = substring_dedup._later([(5, substring_dedup.packed(h, s, doc)), (1, substring_dedup.packed(h[3:4], s[3:4], doc[:1]))])
    assert sorted(zip(*(x.tolist() for x in found))) == [(7, 9), (9, 3)]


def test_intervals_merge():
    assert substring_dedup.intervals(np.array([2, 3, 4, 9, 30]), 5) == [(2, 14), (30, 35)]
    assert substring_dedup.intervals(np.zeros(0, np.int64), 5) == []


@pytest.mark.parametrize("piece", [40, 1_000_000])
def test_substrings_against_brute_force(spark, monkeypatch, piece):
    """Few words, so that most windows repeat; whole documents repeat, in any order of ids."""
    monkeypatch.setattr(substring_dedup, "WORDS_AT_ONCE", piece)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 500)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "ä"], rng.integers(0, 30))) for _ in range(120)]
    texts += texts[:20]
    ids = rng.permutation(len(texts)).tolist()
    docs = list(zip(ids, texts))
    assert removed(docs_of(spark, *texts, ids=ids).repartition(5), 4) == brute_removed(docs, 4)


def test_substring_cases(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    long = " ".join(f"x{i}" for i in range(60_000))
    docs = [(3, passage + " tail"), (1, "head " + passage), (2, None), (4, ""), (5, " \t\n"), (6, f"{passage} {passage}"),
            (None, passage), (7, long), (8, long + " more"), (9, "q" * 200_000), (10, passage), (10, "other " + passage),
            (11, f"own twice {passage} x {passage} x"), (1, "head " + passage), (12, passage.replace(" ", "\x0b\n"))]
    got = removed(docs_of(spark, *[t for _, t in docs], ids=[d for d, _ in docs]), 13)
    assert got == brute_removed(docs, 13)
    by = defaultdict(list)
    for d, *rest in got:
        by[d].append(rest[1])
    assert by[1] == [0, 0] and by[3] == [20] and by[None] == [0] and by[7] == [0] and by[8] == [60_000] and by[6] == [40]
    assert sorted(by[10]) == [20, 20]
    assert removed(docs_of(spark).limit(0), 13) == []


# --- alignment -----------------------------------------------------------------------------------

TEXTS = ["Hello world, it's  a test.\n\nNew line\tand tab ", "  leading", "trailing   ", "a\n b\n\n  c", "1234 5678.90%",
         "été übergrößen naïve œuvre", "日本語のテキスト and mix", "emoji 👩‍👩‍👧 text", "<|endoftext|> </s> <s> <unk>", " nbsp em",
         "don't we'll I'VE", "x" * 3000, "\n", " ", "\r\nwin\r\n", "a\x00b\x1cc", "▁ real underline", "fullwidth ＡＢ", "ﬁ ligature",
         "combining é ́", "tab\t\tend", "a  \n  b   \n"]


def whole(text):
    """Tokens of the whole text by the libraries alone, with their bytes."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    other = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in alignment.byte_letters().items()}
    ids_a = one.encode(" " + text, add_special_tokens=False).ids
    ids_b = other.encode(text)
    bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in ids_a]
    bytes_b = []
    for i in ids_b:
        piece = other.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if other.is_byte(i) else piece.replace("▁", " ").encode())
    return ids_a, ids_b, bytes_a, bytes_b


def brute_groups(text):
    if not text:
        return [], [], [], ""
    ids_a, ids_b, bytes_a, bytes_b = whole(text)
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], [], [], ""
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    common = sorted(set(ends_a) & set(ends_b))
    groups, low = [], 0
    for c in common:
        groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if low < e <= c) + "|"
                      + ",".join(str(i) for i, e in zip(ids_b, ends_b) if low < e <= c))
        low = c
    links = [(a, b) for a, e in zip(ids_a, ends_a) if e in set(common) for b, f in zip(ids_b, ends_b) if e == f]
    return ids_a, ids_b, links, ";".join(groups)


def brute_alignment(docs):
    each = [(d, *brute_groups(t)) for d, t in docs]
    counts = Counter(x for _, _, _, links, _ in each for x in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((d, len(a), len(b), len(g.split(";")) if g else 0, len(links),
                    sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for d, a, b, links, g in each), key=str)


def test_chunks_give_the_tokens_of_the_whole():
    one, other = alignment.ByteLevel(A), alignment.Pieces(B)
    rng = np.random.default_rng(3)
    letters = list("abcdeéßñü .,;'!?-0123456789\n\t  \r") + ["the", "ing", "'s", "’", "  ", "\n\n", " ", "日", "\x1c", "👍", "́"]
    texts = TEXTS + ["".join(rng.choice(letters, rng.integers(1, 80))) for _ in range(1500)]
    model_a, model_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    model_a.encode_special_tokens = True
    for t in texts:
        a, b = one.encode(t), other.encode(t)
        ids_b = model_b.encode(t)
        assert a is not None and a.tolist() == model_a.encode(" " + t, add_special_tokens=False).ids, t
        spelled = b"".join(other.spelled[i] for i in ids_b)
        assert (b.tolist() if b is not None else None) == (ids_b if spelled == (" " + t).encode() else None), t


@pytest.mark.parametrize("often", [1, 100_000])
def test_alignment_against_brute_force(spark, monkeypatch, often):
    """With nearly all pairs shuffled and with all broadcast; pieces of a few texts."""
    monkeypatch.setattr(alignment, "TOKENS_AT_ONCE", 100)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (91, ""), (92, TEXTS[0]), (92, TEXTS[0]), (None, TEXTS[5]),
                                                    (93, "word " * 5000)]
    df = docs_of(spark, *[t for _, t in docs], ids=[d for d, _ in docs])
    got = alignment.align_documents(df, A, B, often=often)
    rows = sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
                   for r in got.collect()), key=str)
    assert rows == brute_alignment(docs)
    assert alignment.align_documents(docs_of(spark).limit(0), A, B).count() == 0


# --- prefix trie ---------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, pos long, shard string, depth int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], TURNS)


def brute_rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + said[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    below = defaultdict(lambda: [0, 0, 0])  # children, leaves, saved
    for node in members:
        if node:
            below[node[:-1]][0] += 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            below[node[:d]][1] += below[node][0] == 0
            below[node[:d]][2] += (len(who) - 1) * len(node[-1][1]) if node else 0
    return sorted((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), *below[node],
                   hashlib.sha256(",".join(str(c) for c in who if len(convs[c]) == len(node)).encode()).hexdigest())
                  for node, who in members.items())


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names and {t for _, t in df.dtypes[:-1]} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard,band", [(1024, 64), (8, 2)])
def test_trie_against_brute_force(spark, monkeypatch, shard, band):
    """Many shared turns, missing bases, negative ids; small shards and bands so that nodes cross both."""
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "BAND", band)
    rng = np.random.default_rng(9)
    rows = []
    for c in [*range(0, 60), *range(130, 180), *range(200, 230), -5, -100, 10**15 + 3]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "x", "yy"])))
    assert trie_rows(prefix_trie.conversation_trie(turns_of(spark, rows).repartition(6))) == brute_trie(brute_rebuilt(rows))


def test_trie_cases(spark):
    rows = [(0, 0, "user", "a"), (0, 1, None, None), (1, None, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"),
            (2, 0, "ab", "c"), (3, 0, "a", "bc"), (None, 0, "user", "a"), (None, 1, "user", "b"),
            (700, 0, "user", "z" * 100_000), (701, 0, "user", "z" * 100_000)]
    rows += [(c, t, "user", f"t{t}") for c in (500, 501) for t in range(300)]  # long, and shared to its end
    rows += [(502, t, "user", f"t{t}" if t < 200 else "other") for t in range(260)]
    got = trie_rows(prefix_trie.conversation_trie(turns_of(spark, rows)))
    assert got == brute_trie(brute_rebuilt(rows))
    assert trie_rows(prefix_trie.conversation_trie(turns_of(spark, []))) == []


def test_trie_of_chains_that_leave_chains(spark, monkeypatch):
    """Conversation i leaves conversation i - 1 at depth i: doubling needs several rounds."""
    monkeypatch.setattr(prefix_trie, "OFTEN", 1)
    convs = {i: [("u", f"{min(d, i)}-{d if d <= i else -d}") for d in range(12)] for i in range(12)}
    rows = [(c, p, role, text) for c, said in convs.items() for p, (role, text) in enumerate(said)]
    turned = prefix_trie.turn_rows(turns_of(spark, rows))
    start = turned.select("conv_id").distinct().selectExpr("conv_id", "0L AS pos", "0L AS k1", "0L AS k2", "0L AS chars")
    assert trie_rows(prefix_trie.trie(start.unionByName(turned))) == brute_trie(convs)


def test_a_worker_may_begin_with_an_empty_text(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_powers", {})
    assert len(substring_dedup.word_values("")) == len(substring_dedup.word_values(None)) == 0
    assert len(substring_dedup.word_values("a b")) == 2
