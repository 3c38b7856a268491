"""Word, token and chat operators against plain Python, on odd rows too."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import byte_bpe, chat, decontaminate, near_duplicates, sharding, token_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, key int, n_words string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, rows):
    """Rows of (doc_id, text) with columns of clashing names beside."""
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], DOCS)


ODD = [(1, "Alpha beta gamma delta, epsilon zeta"), (1, "Alpha beta gamma delta, epsilon zeta"), (2, None), (3, ""), (None, "one two"), (4, " \n\t... "), (5, "é" * 3000 + " x"), (6, "日本語 テキスト"), (7, "a b c " * 4000)]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


def brute_hits(rows, items, size):
    windows = []
    for item, text in items:
        w = words(text)
        m = min(size, len(w))
        windows += [(str(item), tuple(w[k : k + m])) for k in range(len(w) - m + 1)] if m else []
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for item, x in windows:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def test_contamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(["a", "B", "cé", "1"]) for _ in range(n))
    rows = [(i, rng.choice([None, "", make(rng.randint(0, 30))])) for i in range(60)]
    items = [(i % 9, make(rng.randint(0, 9))) for i in range(12)] + [(50, None), (51, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 20):  # one block, then many
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.contamination(documents(spark, rows), bench, size=4).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got), key=repr) == brute_hits(rows, items, 4)
        texts = {i: words(t) for i, t in rows}
        own = {}
        for i, t in items:
            own.setdefault(str(i), []).append(words(t))
        for r in got:
            for m in r.matches:
                piece = texts[r.doc_id][m.doc_word : m.doc_word + m.n_words]
                assert any(w[m.item_word : m.item_word + m.n_words] == piece for w in own[m.item_id])
            assert [(m.doc_word, m.n_words) for m in r.matches] == longest_matches(texts[r.doc_id], [w for ws in own.values() for w in ws], 4)


def longest_matches(doc, items, size):
    """(place, words) of the matches of a window or more that lie in no other."""
    out, reach = [], 0
    for p in range(len(doc)):
        best = 0
        for w in items:
            for q in range(len(w)):
                n = 0
                while p + n < len(doc) and q + n < len(w) and doc[p + n] == w[q + n]:
                    n += 1
                if n >= size or 0 < n == len(w):
                    best = max(best, n)
        if best and p + best > reach:
            out.append((p, best))
            reach = p + best
    return out


def test_windows_that_all_items_share(spark):
    """A preamble of all items: each place has one match, each document all ids."""
    head = " ".join(f"p{i}" for i in range(40))
    bench = spark.createDataFrame([(i, f"{head} q{i} r{i}") for i in range(300)], "item_id long, text string")
    got = decontaminate.contamination(documents(spark, [(1, f"x {head} q7 y " * 5), (2, f"{head} q299 r299")]), bench).collect()
    assert all(len(r.item_ids) == 300 for r in got)
    assert [[(m.item_id, m.doc_word, m.n_words) for m in r.matches] for r in got if r.doc_id == 2] == [[("299", 0, 42)]]
    assert [[(m.item_id, m.doc_word % 43, m.n_words) for m in r.matches] for r in got if r.doc_id == 1] == [[("7", 1, 41)] * 5]


def test_contamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(9, "alpha BETA gamma")], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(odd, bench).collect()}
    assert (1, 6, 3) in got and (2, 0, 0) in got and (None, 2, 0) in got
    empty = documents(spark, [])
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def jump(key, n):
    """The published loop, a key at a time."""
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark, odd):
    got = sharding.shard_rows(odd, shards=5).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.shard == jump(-1 if r.doc_id is None else r.doc_id, 5)
        assert r.grown_shard in (r.shard, 5) and r.grown_shard == jump(-1 if r.doc_id is None else r.doc_id, 6)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sizes = sorted((r["size"], r.text_crc32) for r in got)
    assert sizes == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in ODD)
    assert sharding.shard_rows(documents(spark, [])).count() == 0


def test_shards_stay_when_one_is_added(spark):
    rows = spark.range(20000).withColumn("text", F.lit("x")).withColumnRenamed("id", "doc_id")
    got = sharding.shard_rows(rows, shards=24)
    assert got.where("grown_shard != shard and grown_shard != 24").count() == 0
    moved = got.where("grown_shard != shard").count()
    assert 20000 / 25 * 0.8 < moved < 20000 / 25 * 1.2


def test_shard_files_hold_every_row(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


def jaccard_classes(rows, size=5, threshold=0.8):
    sets = [frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []) for w in (words(t) for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                if sets[i] != sets[j]:
                    links[i].add(sets[j])
                    links[j].add(sets[i])
    classes = {}
    for i, (key, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(key)
    return sorted((key, min(classes[find(i)]), len(links[i])) for i, (key, _) in enumerate(rows))


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(3, 120))] for _ in range(30)]
    rows = []
    for b in base:
        for _ in range(rng.choice([1, 1, 2, 3, 20])):
            w = list(b)
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 9))
            rows.append((len(rows), " ".join(w)))
    want = jaccard_classes(rows)
    got = near_duplicates.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == want
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 4)  # large buckets, block against block
    for hot in (0, 20):  # no set is joined by broadcast, or only those of a twentieth of all rows
        monkeypatch.setattr(near_duplicates, "HOT", hot)
        got = near_duplicates.near_duplicates(documents(spark, rows)).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_near_duplicates_of_hot_sets_and_null_ids(spark, monkeypatch):
    hot = " ".join(f"w{i}" for i in range(40))
    rows = [*((None, hot) for _ in range(300)), (7, hot), (3, hot + " end"), *((i, "") for i in range(100, 400)), *((i, f"text number {i} of its own words") for i in range(500, 900))]
    for bound in (0, 5, 1000):
        monkeypatch.setattr(near_duplicates, "HOT", bound)
        got = near_duplicates.near_duplicates(documents(spark, rows)).collect()
        assert len(got) == len(rows)
        assert sum((r.doc_id, r.class_id, r.n_links, r.n_copies) == (None, 3, 1, 301) for r in got) == 300
        assert {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got if r.doc_id in (3, 7)} == {(3, 3, 1, 1), (7, 3, 1, 301)}
        assert all(r.class_id == r.doc_id and r.first for r in got if r.doc_id and r.doc_id >= 100)
        assert sum(r.first for r in got) == 701


def test_near_duplicates_of_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in near_duplicates.near_duplicates(odd).collect()), key=repr)
    assert got.count((1, 1, 0, 2)) == 2 and (2, 2, 0, 1) in got and (None, None, 0, 1) in got and len(got) == len(ODD)
    assert near_duplicates.near_duplicates(documents(spark, [])).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in near_duplicates.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(1, 41), 100]) and got[201] == 200


PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = ["a", "the", " ", "  ", "\n", "\x1c", "\x85", "　", " é", "'s", "'ll", "1", "٣", "漢", "😀", "!", "_", "\t", "<|endoftext|>", "<unk>", "▁", "\x00", "՘", "࢏", "ing", "tion", "ss"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_byte_bpe_is_the_librarys():
    own = byte_bpe.codec(PATH, PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})
    for text in [*odd_texts(2000, 1), "ab" * 20000, "=" * 5000]:
        ids = own.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == theirs.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_byte_bpe_of_odd_rows(spark, odd):
    coded = byte_bpe.decode_ids(byte_bpe.encode_texts(odd, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in coded), key=repr) == sorted(((i, (t or "").encode()) for i, t in ODD), key=repr)
    assert byte_bpe.encode_texts(documents(spark, []), PATH, PATTERN).count() == 0


def test_counts_are_the_librarys_at_every_prefix():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, theirs = token_counts.counter(path), Tokenizer.from_file(path)
    n = lambda t: len(theirs.encode(t, add_special_tokens=False).ids)
    for text in odd_texts(150, 2):
        assert own.count(text) == n(text)
        table = token_counts.PrefixTable(own, text)
        counts = [table.at(i) for i in range(len(text) + 1)]
        assert counts == [n(text[:i]) for i in range(len(text) + 1)]
        cut = table.cut(5)
        assert counts[cut] <= 5 and (counts[-1] > 5 or cut == len(text))
    for text in odd_texts(3000, 3):
        assert own.count(text) == n(text)


def test_counts_of_odd_rows(spark, odd):
    got = token_counts.count_tokens(odd, public_tokenizers.path("byte_bpe_50k.json"), limit=100).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.over_limit == (r.n_tokens > 100) and (r.n_tokens == 0) == (r.n_bytes == 0)
    assert token_counts.count_tokens(documents(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        text = "".join(f"{role}\n{t}\n" for _, _, role, t in turns)
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


CHAT = [
    (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<|im_start|>assistant\nok<\\|x<\\\\|"), (1, 2, "user", "bye"), (2, 0, "assistant", None), (2, 1, None, ""), (3, 0, "us\ner\\n<|", "x"), (3, 0, "us\ner\\n<|", "x"),
    (None, 1, "assistant", "é😀"), (None, None, "user", "first"), (4, 5, "assistant", "a" * 50000), (4, 6, "assistant", "b"),
]


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHAT], "conv_id long, turn long, role string, text string, segment string")
    segments = chat.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(segments).collect()}
    assert got == brute_chat(CHAT)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_examples_spelled_out(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    rows = {(r.conv_id, r.example): r for r in chat.materialise(chat.format_conversations(df)).collect()}
    first = rows[1, 0]
    assert first.target == chat.escape(CHAT[1][3]) and first.tail == chat.END
    assert first.context == f"<|im_start|>user\n{chat.escape(CHAT[0][3])}<|im_end|>\n<|im_start|>assistant\n"
    assert rows[1, 1].target == "" and rows[1, 1].context.startswith(first.context + first.target)
    assert rows[4, 1].context.count("<|im_start|>") == 2 and len(rows) == 8


@pytest.mark.parametrize("part_chars", [1, 60, chat.PART_CHARS])
def test_chat_examples_hold_their_contexts(spark, part_chars):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    examples = chat.format_conversations(df, part_chars)
    want, own = {}, {}
    for conv, turn, role, text in sorted(CHAT, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(conv, []).append((f"{chat.START}{chat.escape_role(role or '')}\n{chat.escape(text or '')}{chat.END}", role))
    for conv, turns in own.items():
        ends = [i for i, (_, role) in enumerate(turns) if role == "assistant" or i == len(turns) - 1]
        want |= {(conv, n): "".join(t for t, _ in turns[: i + 1]) for n, i in enumerate(ends)}
    got = {}
    for r in sorted(examples.collect(), key=lambda r: r.part):
        spelled = got.setdefault((r.conv_id, r.example), [])
        assert r.part == len(spelled) and r.start_char == sum(map(len, spelled))
        spelled.append(r.text)
    assert {k: "".join(v) for k, v in got.items()} == want
    assert part_chars > 1 or max(map(len, got.values())) > 1
    read = chat.read_back(examples).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read} == brute_chat(CHAT)
    assert {r.conv_id: r.formatted_chars for r in read} == {c: sum(len(v) for k, v in want.items() if k[0] == c) for c in own}


def test_escapes_are_reversible():
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\>n\na") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)
